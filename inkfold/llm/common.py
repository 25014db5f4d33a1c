"""What the operators share: tables, names that clash, and cuts of the lineage."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters between words; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="inkfold-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone, and with it the folder
        pass


class _Scopes(threading.local):
    """The paths that this thread's open settled() calls have written, innermost last."""

    def __init__(self):
        self.open: list[list[str]] = []


_scopes = _Scopes()


def _new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def _keep(spark: SparkSession, path: str) -> None:
    """The table goes with the settled() call around it, or else when the driver's Python exits."""
    if _scopes.open:
        _scopes.open[-1].append(path)
    else:
        atexit.register(_remove, spark, path)


def stored(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it again: a cut of the lineage that outlives any executor."""
    path = _new_path(df.sparkSession)
    _keep(df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """The table that ``make`` returns, stored; the tables that were stored on the way to it are removed."""
    path = _new_path(spark)
    _scopes.open.append([])
    try:
        df = make()
        df.write.parquet(path)
    finally:
        for inner in _scopes.open.pop():
            _remove(spark, inner)
    _keep(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def name(column: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def carried(docs: DataFrame, new: list[str]) -> list[Column]:
    """The columns of ``docs`` that no new column replaces; new columns win where names clash."""
    taken = {n.lower() for n in new}
    return [name(c) for c in docs.columns if c.lower() not in taken]


class Sealed:
    """A table whose columns have names of our own, "in 0" and so on, so that no name of the caller's meets one of ours."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.df = docs.select(*[name(c).alias(f"in {i}") for i, c in enumerate(self.names)])

    def __getitem__(self, column: str) -> Column:
        return F.col(f"in {[c.lower() for c in self.names].index(column.lower())}")

    def back(self, new: tuple | list = ()) -> list[Column]:
        """The columns under their old names, without those that ``new`` ones replace."""
        taken = {n.lower() for n in new}
        return [F.col(f"in {i}").alias(c) for i, c in enumerate(self.names) if c.lower() not in taken]


def with_key(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``left`` (a stored table) with the columns of ``right``, which has each key once; nulls where it lacks one.

    Keys that hold more than a quarter of a partition's share of the rows go by broadcast: there can be no more of them
    than four times the partitions. Rows with a null key match nothing and need no exchange. The rest is shuffled.
    """
    limit = max(100, left.count() // (4 * partitions(left.sparkSession)))
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on])
    hot = left.where(whole).groupBy(*on).agg(F.count("*").alias("rows of key")).where(F.col("rows of key") > limit).select(*on)
    hot = stored(hot.join(right, on, "left"))
    added = [c for c in right.columns if c not in on]
    empty = left.where(~whole).select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in added])
    rest = left.where(whole).join(F.broadcast(hot.select(*on)), on, "left_anti").join(right, on, "left")
    return rest.unionByName(left.join(F.broadcast(hot), on)).unionByName(empty).select(*left.columns, *added)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key() -> Column:
    """With doc_id it tells rows apart: rows that share both are copies of one document."""
    return F.xxhash64(F.col("text"))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a worker holds few texts at once."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows (of a few numbers each); else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def packed(rows: DataFrame, n: int) -> DataFrame:
    """(pack, body) of ``rows``, which have a column ``pack``, dealt to ``n`` partitions by it.

    A batch sends the rows of a pack as one compressed body, equal rows once and with their number in ``times``, so
    copies of a row don't pile up where they meet.
    """
    names = [c for c in rows.columns if c != "pack"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            table = pa.Table.from_batches([batch]).group_by(["pack", *names], use_threads=False).aggregate([([], "count_all")]).rename_columns({"count_all": "times"})
            pack = table.column("pack").to_numpy()
            order = np.argsort(pack, kind="stable")
            edges = np.flatnonzero(np.concatenate(([True], pack[order][1:] != pack[order][:-1], [True]))) if len(pack) else []
            bodies, table = [], table.select([*names, "times"])
            for lo, hi in zip(edges[:-1], edges[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=options) as out:
                    out.write_table(table.take(pa.array(order[lo:hi])))
                bodies.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(pack[order[edges[:-1]]] if len(edges) else [], pa.int32()), pa.array(bodies, pa.binary())], names=["pack", "body"])

    return rows.mapInArrow(fold, "pack int, body binary").repartition(n, "pack")


def unpacked(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """The rows of a pack's bodies with the given columns, and ``times``."""
    schema = schema.append(pa.field("times", pa.int64()))
    parts = [pa.ipc.open_stream(b).read_all().cast(schema) for b in table.column("body").to_pylist()]
    return pa.concat_tables(parts) if parts else schema.empty_table()


def each_time(rows: DataFrame) -> DataFrame:
    """Each row as often as its ``times`` says."""
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("times")
