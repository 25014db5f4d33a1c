"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes all rows its predecessor kept and returns the columns of documents; the last adds the shard.
run() writes each stage as Parquet into the shared folder and rereads it, so a lost executor costs a stage's
tasks and never an earlier stage; what a stage stores on its way goes with its end.

Cases: the stages take those of their operators. A row without doc_id passes near-dedup and keeps its own text. Columns
may have any names, with dots, in any case, or those of an operator's results: stages see doc_id, text and source by name
and all others under numbers, and give them back as they were. Only the columns that sharding adds take the place of
input columns of the same names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession

from inkfold.llm import decontamination, host_rules, mixing, near_dup, sharding
from inkfold.llm.common import name, read, settled

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _inner(names: list[str]) -> list[str]:
    """Names for the stages: doc_id, text and source keep theirs, all others get a number."""
    lower = [n.lower() for n in names]
    known = {(names.index(c) if c in names else lower.index(c)): c for c in ("doc_id", "text", "source") if c in lower}
    return [known.get(i, f"in {i}") for i in range(len(names))]


def of_any_columns(stage: Stage) -> Stage:
    """A stage that never meets the other columns' names; what it adds comes behind them."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names, inner = docs.columns, _inner(docs.columns)
        out = stage(spark, docs.toDF(*inner), sf_dir)
        added = [c for c in out.columns if c not in inner]
        taken = {c.lower() for c in added}
        old = [(i, n) for i, n in zip(inner, names) if n.lower() not in taken]
        return out.select(*[name(i) for i, _ in old], *[name(c) for c in added]).toDF(*[n for _, n in old], *added)

    return run_stage


@of_any_columns
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's verdict reject go."""
    return host_rules.judge_hosts(docs).where("kept").select(*map(name, docs.columns))


@of_any_columns
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id."""
    return near_dup.one_of_each(docs)


@of_any_columns
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


@of_any_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix has it."""
    return mixing.repeated(mixing.mix(docs)).select(*map(name, docs.columns))


@of_any_columns
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its shard and its slot there."""
    return sharding.assign_shards(docs, 8)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL can't express the stages' minhashes; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settled(partial(stage, spark, docs, sf_dir), spark)
    return docs
