"""A published index: its document, and a pair of files for each shard, as a Spark sink and as tables.

``shard-<n>.bin`` has all codes row by row and then all scales, ``shard-<n>.meta.json.gz`` its icons in the same order,
and ``index.json`` the size and SHA-256 of each file. Rows go to the tasks by shard and are sorted by icon, and the
compressed files carry no time, so another run over the same vectors writes the same bytes.

Tasks write beside the folder, each attempt in a place of its own. When all are done the driver, which gets one line per
shard, moves the files of the attempts that count, adds the empty shards and the document, and then puts the finished
folder in place; a failed run leaves the old one as it was.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.text import confined_path
from .files import int8_codes, pack_shard, verified_shards
from .npz import opened

#: The version and kind of the document.
VERSION, KIND = 1, "icon-embedding-index"
ROWS = "shard int, icon_id long, path string, duplicates int, aux_class int, codes array<tinyint>, scale float"
#: The shape of the document.
DOCUMENT = """
schemaVersion int, kind string, fingerprint string, source struct<repository: string, commit: string>, classes array<string>,
embedding struct<dim: int, dtype: string, scale: string, metric: string>, counts struct<vectors: long>,
clustering struct<count: int, centroidCodes: string, centroidScales: array<double>>,
shards array<struct<id: int, count: int, bytes: long, sha256: string, metaBytes: long, metaSha256: string>>
"""


def _compact(value) -> bytes:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False).encode()


def _files(shard: int, codes: np.ndarray, scales: np.ndarray, icons: list[list]) -> tuple[dict, dict[str, bytes]]:
    """A shard's line in the document, and its files."""
    body, meta = pack_shard(codes, scales), gzip.compress(_compact({"shard": shard, "count": len(icons), "icons": icons}), mtime=0)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    line = {"id": shard, "count": len(icons), "bytes": len(body), "sha256": digest(body), "metaBytes": len(meta), "metaSha256": digest(meta)}
    return line, {f"shard-{shard}.bin": body, f"shard-{shard}.meta.json.gz": meta}


@dataclass
class _Written(WriterCommitMessage):
    place: str = ""
    lines: list[dict] = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"].rstrip("/"), overwrite
        self.head, self.run = json.loads(options["document"]), f"{self.folder}.{uuid.uuid4().hex}"

    def _put(self, path: str, body: bytes) -> None:
        where, path = opened(path)
        with where.open_output_stream(path, compression=None) as f:
            f.write(body)

    def _make(self, path: str) -> None:
        where, path = opened(path)
        where.create_dir(path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        out = _Written(f"{self.run}.tasks/{uuid.uuid4().hex}")
        held: list[pa.RecordBatch] = []
        self._make(out.place)

        def close() -> None:
            rows = pa.Table.from_batches(held)
            dim = self.head["embedding"]["dim"]
            codes = rows.column("codes").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int8).reshape(-1, dim)
            icons = [list(r) for r in zip(*(rows.column(c).to_pylist() for c in ("icon_id", "path", "duplicates", "aux_class")))]
            line, files = _files(rows.column("shard")[0].as_py(), codes, rows.column("scale").to_numpy(), icons)
            for name, body in files.items():
                self._put(f"{out.place}/{name}", body)
            out.lines.append(line)

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for lo, hi in zip(edges, edges[1:]):
                if hi > lo:
                    if held and held[-1].column("shard")[0].as_py() != shards[lo]:
                        close()
                        held = []
                    held.append(batch.slice(lo, hi - lo))
        if held:
            close()
        return out

    def commit(self, messages: list[_Written | None]) -> None:
        where, folder = opened(self.folder)
        if where.get_file_info(folder).type != fs.FileType.NotFound and not self.overwrite:
            raise ValueError(f"{self.folder} exists")
        count, dim = self.head["clustering"]["count"], self.head["embedding"]["dim"]
        self._make(self.run)
        lines = {}
        for message in messages:
            for line in message.lines if message else ():
                if line["id"] in lines or not 0 <= line["id"] < count:
                    raise ValueError(f"shard {line['id']} came twice or is none of the index")
                lines[line["id"]] = line
                for name in (f"shard-{line['id']}.bin", f"shard-{line['id']}.meta.json.gz"):
                    where.move(opened(f"{message.place}/{name}")[1], opened(f"{self.run}/{name}")[1])
        for shard in set(range(count)) - set(lines):
            lines[shard], files = _files(shard, np.empty((0, dim), np.int8), np.empty(0, np.float32), [])
            for name, body in files.items():
                self._put(f"{self.run}/{name}", body)
        document = self.head | {"counts": {"vectors": sum(x["count"] for x in lines.values())}, "shards": [lines[i] for i in range(count)]}
        document["fingerprint"] = hashlib.sha256(_compact(document)).hexdigest()
        self._put(f"{self.run}/index.json", _compact(document))
        self._remove(f"{self.run}.tasks")
        old = f"{self.run}.old"
        if where.get_file_info(folder).type != fs.FileType.NotFound:
            where.move(folder, opened(old)[1])
        where.move(opened(self.run)[1], folder)
        self._remove(old)

    def abort(self, messages: list[_Written | None]) -> None:
        self._remove(f"{self.run}.tasks")
        self._remove(self.run)

    def _remove(self, path: str) -> None:
        where, path = opened(path)
        if where.get_file_info(path).type == fs.FileType.Directory:
            where.delete_dir(path)


class IconIndex(DataSource):
    """``df.write.format("icon_index")`` of rows that come by shard, sorted by icon; see publish()."""

    @classmethod
    def name(cls) -> str:
        return "icon_index"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)


def publish(vectors_by_shard: DataFrame, centroids: DataFrame, folder: str, repository: str, commit: str, classes: list[str]) -> None:
    """Write an index (see clustering.build_index) as a folder of files that readers verify against its document.

    Paths that leave the corpus, missing ids and vectors of another length raise, and nothing is published.
    """
    spark = vectors_by_shard.sparkSession
    rows = centroids.orderBy("shard").collect()  # the index's small fixed table
    if [r["shard"] for r in rows] != list(range(len(rows))):
        raise ValueError("shards must be numbered from 0")
    codes = np.array([list(r["codes"]) for r in rows], np.int8)
    head = {
        "schemaVersion": VERSION, "kind": KIND, "source": {"repository": repository, "commit": commit}, "classes": classes,
        "embedding": {"dim": codes.shape[1], "dtype": "int8", "scale": "per-vector-float32", "metric": "dot"},
        "clustering": {"count": len(rows), "centroidCodes": base64.b64encode(codes.tobytes()).decode(), "centroidScales": [float(r["scale"]) for r in rows]},
    }
    bad = ~confined_path(F.col("path")) | F.col("icon_id").isNull() | (F.size("codes") != codes.shape[1])
    checked = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("malformed icon: "), F.coalesce("path", F.lit("null"))))).otherwise(F.col("path"))
    table = vectors_by_shard.select(F.col("shard").cast("int"), F.col("icon_id").cast("long"), checked.alias("path"), F.col("duplicates").cast("int"), F.col("aux_class").cast("int"), "codes", F.col("scale").cast("float"))
    spark.dataSource.register(IconIndex)
    table.repartition("shard").sortWithinPartitions("shard", "icon_id").write.format("icon_index").option("document", json.dumps(head)).mode("overwrite").save(folder)


def read_document(spark: SparkSession, folder: str) -> DataFrame:
    """The document of a published index, one row; another version, kind or form of vectors raises."""
    df = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(f"{folder.rstrip('/')}/index.json")
    e, c = F.col("embedding"), F.col("clustering")
    sound = {
        "version": F.col("schemaVersion") == VERSION, "kind": F.col("kind") == KIND, "vectors": (e["dtype"] == "int8") & (e["metric"] == "dot") & (e["dim"] >= 8),
        "classes": (F.size(F.array_distinct("classes")) == F.size("classes")) & ~F.exists("classes", lambda x: x.isNull() | (x == "")),
        "clustering": (c["count"] == F.size("shards")) & (c["count"] == F.size(c["centroidScales"])) & (F.octet_length(F.unbase64(c["centroidCodes"])) == c["count"] * e["dim"]),
    }
    problem = F.lit(None).cast("string")
    for what, holds in reversed(sound.items()):
        problem = F.when(~F.coalesce(holds, F.lit(False)), F.lit(what)).otherwise(problem)
    return df.withColumn("kind", F.when(problem.isNull(), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("the index document is unsound: "), problem))))


def document_tables(document: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(centroids, shards): shard, codes, scale, count; and shard, count, bytes, sha256, meta_bytes, meta_sha256."""
    shards = document.where(F.col("kind").isNotNull()).select(F.explode("shards").alias("s")).select(F.col("s.id").alias("shard"), "s.count", "s.bytes", "s.sha256", F.col("s.metaBytes").alias("meta_bytes"), F.col("s.metaSha256").alias("meta_sha256"))
    dim = F.col("embedding.dim")
    coded = document.select(dim.alias("dim"), int8_codes(F.unbase64("clustering.centroidCodes")).alias("all"), F.posexplode("clustering.centroidScales").alias("shard", "scale"))
    coded = coded.select("shard", F.slice("all", F.col("shard") * F.col("dim") + 1, F.col("dim")).alias("codes"), F.col("scale").cast("float").alias("scale"))
    return coded.join(F.broadcast(shards.select("shard", "count")), "shard"), shards  # a row for each shard


@F.pandas_udf(T.StringType())
def _unzipped(blob: pd.Series) -> pd.Series:
    return blob.map(lambda b: gzip.decompress(b).decode() if b is not None else None)


def read_published(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, centroids) of a published index, as clustering.build_index returns them; a file that differs from the document raises."""
    document = read_document(spark, folder)
    centroids, shards = document_tables(document)
    dim = document.select("embedding.dim").first()[0]
    vectors = verified_shards(spark, folder, shards, dim)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.meta.json.gz").load(folder)
    files = files.select(F.regexp_extract("path", r"shard-([0-9]+)\.meta", 1).cast("int").alias("shard"), "content")
    meta = "shard int, count int, icons array<array<string>>"
    listed = shards.join(files, "shard", "left")
    wrong = F.when(F.col("content").isNull(), F.lit(" has no metadata")).when((F.octet_length("content") != F.col("meta_bytes")) | (F.sha2("content", 256) != F.col("meta_sha256")), F.lit(" has other metadata"))
    checked = F.when(wrong.isNull(), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("shard "), F.col("shard").cast("string"), wrong)))
    read = listed.select("shard", "count", F.from_json(_unzipped(checked), meta).alias("m"))
    fits = (F.col("m.shard") == F.col("shard")) & (F.col("m.count") == F.col("count")) & (F.size("m.icons") == F.col("count"))
    icons = F.when(F.coalesce(fits, F.lit(False)), F.col("m.icons")).otherwise(F.raise_error(F.concat(F.lit("shard "), F.col("shard").cast("string"), F.lit(" has metadata of another index"))))
    rows = read.select("shard", F.posexplode(icons).alias("row", "i"))
    rows = rows.select("shard", F.col("row").cast("long").alias("row"), F.col("i")[0].cast("long").alias("icon_id"), F.col("i")[1].alias("path"), F.col("i")[2].cast("int").alias("duplicates"), F.col("i")[3].cast("int").alias("aux_class"))
    return vectors.join(rows, ["shard", "row"]).select("shard", "icon_id", "path", "duplicates", "aux_class", "codes", "scale"), centroids
