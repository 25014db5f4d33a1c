"""Dense numbers in an order, without a task that sees all rows.

Rows are dealt by range, sorted in their partitions and stored; only the size of each partition passes
through the driver, so what is gathered grows with the number of partitions and not with the rows.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_AT, _PART, _SHIFT = "number at", "number part", "number shift"


def _folder(spark: SparkSession) -> str:
    """The folder that the whole cluster shares; a new one of our own where the master is local and none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="inkfold-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone, and with it the folder
        pass


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """The table, written to the shared folder (with a folder for each value of ``by``) and read again; it goes when the driver's Python exits."""
    spark = df.sparkSession
    path = f"{_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    out = df.repartition(by).sortWithinPartitions(by).write.partitionBy(by) if by else df.write
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns])


def _dealt(rows: DataFrame, order: list[Column | str], store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    sort = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return store(sort.withColumn(_AT, F.monotonically_increasing_id())).withColumn(_PART, F.shiftright(_AT, 33))


def numbered(rows: DataFrame, order: list[Column | str], name: str = "place", store: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """``rows`` with a number from 0 in the given order (nulls first where it ascends).

    Rows with equal keys land in one partition: put a column behind the order that tells them apart if there may be
    many. ``store`` cuts the lineage, as the numbers must not change between the count and the use.
    """
    dealt = _dealt(rows, order, store)
    sizes = sorted(tuple(r) for r in dealt.groupBy(_PART).agg(F.count("*")).collect())  # a row for each partition
    before = accumulate([n for _, n in sizes], initial=0)
    shifts = rows.sparkSession.createDataFrame([(p, b - (p << 33)) for (p, _), b in zip(sizes, before)], f"`{_PART}` long, `{_SHIFT}` long")
    return dealt.join(F.broadcast(shifts), _PART).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col(_AT) + F.col(_SHIFT)).alias(name))
