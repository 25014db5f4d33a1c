"""Archives of drawings as a Spark data source: ``spark.read.format("npz_strokes")``.

An archive holds an object array for each split, one array of steps (n x 3, 16 bits) for each drawing. A task reads a
range of the drawings of one split of one archive. Nothing in an archive is believed before its size and its SHA-256 are
the trusted ones, and even then its pickles may only build arrays.

Options: ``path``, the folder; ``trusted``, a JSON object from file name to bytes and sha256: these files are read and no
others; ``splits``; ``drawings``, how many a task reads.
"""

from __future__ import annotations

import hashlib
import io
import json
import pickle
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLITS = ("train", "valid", "test")
DRAWINGS = 20_000
SCHEMA = "archive string, split string, drawing long, strokes array<struct<dx:smallint,dy:smallint,pen:smallint>>"
#: What a pickled array of arrays is made of; older archives name numpy's core otherwise.
_BUILDERS = {("numpy._core.multiarray", "_reconstruct"), ("numpy._core.numeric", "_frombuffer"), ("numpy", "ndarray"), ("numpy", "dtype"), ("_codecs", "encode")}
_BATCH = 1000


def confined(name: str) -> bool:
    """Whether a file name stays in its folder."""
    return bool(name) and not any(c in name for c in "/\\\0") and name not in (".", "..")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Arrays(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        module = module.replace("numpy.core", "numpy._core")
        if (module, name) not in _BUILDERS:
            raise ValueError(f"an archive may not hold {module}.{name}")
        return super().find_class(module, name)


def _header(stream) -> tuple[tuple, np.dtype]:
    version = np.lib.format.read_magic(stream)
    shape, _, dtype = np.lib.format.read_array_header_1_0(stream) if version == (1, 0) else np.lib.format.read_array_header_2_0(stream)
    return shape, dtype


@dataclass
class _Range(InputPartition):
    name: str
    split: str
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")
        self.trusted = json.loads(options.get("trusted", "{}"))
        self.splits = options.get("splits", ",".join(SPLITS)).split(",")
        self.drawings = int(options.get("drawings", DRAWINGS))

    def _content(self, name: str) -> bytes:
        where, path = opened(f"{self.folder}/{name}")
        with where.open_input_stream(path, compression=None) as f:
            content = f.read()
        known = self.trusted[name]
        if len(content) != known["bytes"] or hashlib.sha256(content).hexdigest() != known["sha256"]:
            raise ValueError(f"{name} isn't the trusted archive")
        return content

    def partitions(self) -> list[_Range]:
        out = []
        for name in sorted(self.trusted):
            if not confined(name):
                raise ValueError(f"{name!r} leaves the folder")
            where, path = opened(f"{self.folder}/{name}")
            if where.get_file_info(path).size != self.trusted[name]["bytes"]:
                raise ValueError(f"{name} isn't the trusted archive")
            with where.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
                for split in self.splits:
                    with archive.open(f"{split}.npy") as member:
                        (n,) = _header(member)[0]
                    out += [_Range(name, split, lo, min(lo + self.drawings, n)) for lo in range(0, n, self.drawings)]
        return out or [_Range("", "", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        with zipfile.ZipFile(io.BytesIO(self._content(partition.name))) as archive, archive.open(f"{partition.split}.npy") as member:
            shape, dtype = _header(member)
            if dtype != object or len(shape) != 1:
                raise ValueError(f"{partition.name}: {partition.split} must be an array of drawings")
            drawings = _Arrays(member, encoding="latin1").load()
        for lo in range(partition.first, partition.last, _BATCH):
            yield _batch(partition, lo, [np.asarray(d) for d in drawings[lo : min(lo + _BATCH, partition.last)]])


def _batch(partition: _Range, first: int, drawings: list[np.ndarray]) -> pa.RecordBatch:
    for i, d in enumerate(drawings):
        if d.dtype != np.int16 or d.ndim != 2 or d.shape[1] != 3:
            raise ValueError(f"{partition.name}: drawing {first + i} of {partition.split} must have rows of three 16-bit numbers")
    steps = np.concatenate(drawings)
    columns = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(steps[:, k])) for k in range(3)], names=["dx", "dy", "pen"])
    strokes = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, drawings)]), pa.int32()), columns)
    n = len(drawings)
    return pa.RecordBatch.from_arrays([pa.array([partition.name] * n), pa.array([partition.split] * n), pa.array(np.arange(first, first + n)), strokes], names=["archive", "split", "drawing", "strokes"])


class NpzStrokes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz_strokes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_npz(spark: SparkSession, folder: str, trusted: dict[str, dict], splits: tuple[str, ...] = SPLITS, drawings: int = DRAWINGS) -> DataFrame:
    """(archive, split, drawing, strokes) of the trusted archives (name -> bytes, sha256) of a folder."""
    spark.dataSource.register(NpzStrokes)
    return spark.read.format("npz_strokes").option("trusted", json.dumps(trusted)).option("splits", ",".join(splits)).option("drawings", drawings).load(folder)
