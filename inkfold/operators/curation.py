"""Curation state and suggestion lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACCEPTED, REJECTED = "accepted", "rejected"
CANONICAL_ID = r"^-?(0|[1-9][0-9]*)$"


def fold_decisions(log: DataFrame) -> DataFrame:
    """(class, candidate_id, decision): the last decision of each candidate; a null one removes it."""
    last = log.groupBy("class", "candidate_id").agg(F.max(F.struct("seq", "decision")).alias("m"))
    return last.select("class", "candidate_id", "m.decision").where(F.col("decision").isNotNull())


def orphans(decisions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Decisions whose class or candidate the manifest doesn't have."""
    return decisions.join(manifest.select("class", "candidate_id"), ["class", "candidate_id"], "left_anti")


def decision_problem(candidate_id: Column, decision: Column) -> Column:
    """What is wrong with a stored decision, or null."""
    return F.when(~F.coalesce(candidate_id.rlike(CANONICAL_ID), F.lit(False)), F.lit("id")).when(~F.coalesce(decision.isin(ACCEPTED, REJECTED), F.lit(False)), F.lit("decision"))


#: The kind and version of a progress document.
PROGRESS_KIND, PROGRESS_VERSION = "quickdraw-curation-progress", 1


def state_problems(head: DataFrame, decisions: DataFrame, reviewed: DataFrame, manifest_head: DataFrame, manifest: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, candidate_id, problem): all that keeps a stored curation state from being restored; empty for a sound one.

    ``head``: kind, version, commit, fingerprint, one row; ``decisions``: class, candidate_id (as written), decision;
    ``reviewed``: class. ``manifest_head``: commit, fingerprint, one row; ``manifest``: class, candidate_id; ``classes``: class.
    """
    want = manifest_head.select(F.col("commit").alias("m_commit"), F.col("fingerprint").alias("m_print"))
    checks = {
        "version": ~F.col("version").eqNullSafe(F.lit(PROGRESS_VERSION)), "kind": ~F.col("kind").eqNullSafe(F.lit(PROGRESS_KIND)),
        "commit": ~F.col("commit").eqNullSafe(F.col("m_commit")), "fingerprint": ~F.col("fingerprint").eqNullSafe(F.col("m_print")),
    }
    found = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]), lambda x: x.isNotNull())
    none = F.lit(None).cast("string")
    of_head = head.join(F.broadcast(want)).select(none.alias("class"), none.alias("candidate_id"), F.explode(found).alias("problem"))  # one row
    known = classes.select("class").distinct()
    stray = decisions.join(known, "class", "left_anti").select("class", "candidate_id", F.lit("class").alias("problem"))
    inside = decisions.join(known, "class", "left_semi").withColumn("problem", decision_problem(F.col("candidate_id"), F.col("decision")))
    offered = manifest.select("class", F.col("candidate_id").cast("string").alias("candidate_id"))
    unknown = inside.where(~F.col("problem").eqNullSafe(F.lit("id"))).join(offered, ["class", "candidate_id"], "left_anti").select("class", "candidate_id", F.lit("candidate").alias("problem"))
    broken = inside.where("problem is not null").select("class", "candidate_id", "problem")
    strange = reviewed.select("class").distinct().join(known, "class", "left_anti").select("class", none.alias("candidate_id"), F.lit("reviewed class").alias("problem"))
    return of_head.unionByName(stray).unionByName(broken).unionByName(unknown).unionByName(strange)


def stats(manifest: DataFrame, decisions: DataFrame, reviewed: DataFrame) -> DataFrame:
    """One row of counts: classes, reviewed classes, accepted and rejected candidates."""
    parts = [
        manifest.select("class").distinct().agg(F.count("*").alias("class_count")),
        reviewed.select("class").distinct().agg(F.count("*").alias("reviewed_count")),
        decisions.agg(F.count_if(F.col("decision") == ACCEPTED).alias("accepted_count"), F.count_if(F.col("decision") == REJECTED).alias("rejected_count")),
    ]
    return parts[0].join(F.broadcast(parts[1])).join(F.broadcast(parts[2]))  # one row each


def progress(manifest: DataFrame, decisions: DataFrame) -> DataFrame:
    """(class, candidates, decided, percent) of each class, whole percents rounded half up."""
    total = manifest.groupBy("class").agg(F.count("*").alias("candidates"))
    done = decisions.groupBy("class").agg(F.count("*").alias("decided"))
    out = total.join(done, "class", "left").select("class", "candidates", F.coalesce("decided", F.lit(0)).alias("decided"))
    return out.withColumn("percent", F.floor(F.col("decided") * 100 / F.col("candidates") + 0.5))


def curated_export(manifest: DataFrame, decisions: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(class, candidate_id): accepted candidates, and a row with a null candidate for reviewed classes without one."""
    accepted = manifest.select("class", "candidate_id").join(decisions.where(F.col("decision") == ACCEPTED).select("class", "candidate_id"), ["class", "candidate_id"], "left_semi")
    bare = manifest.select("class").distinct().join(reviewed.select("class").distinct(), "class", "left_semi").join(accepted.select("class").distinct(), "class", "left_anti")
    return accepted.unionByName(bare.withColumn("candidate_id", F.lit(None).cast(accepted.schema["candidate_id"].dataType)))


def interleave(predictions: DataFrame, candidates: DataFrame, limit: int | None = None, per_class: int | None = None) -> DataFrame:
    """(qid, place, id, label): candidates of the predicted labels in turn, each id once, at its first place.

    ``predictions``: qid, pos, label; ``candidates``: label, rank, id. Repeated labels count at their first position.
    """
    first = predictions.groupBy("qid", "label").agg(F.min("pos").alias("pos"))
    wanted = candidates if per_class is None else candidates.where(F.col("rank") <= per_class)
    rows = first.join(wanted.select("label", "rank", "id"), "label")
    once = rows.groupBy("qid", "id").agg(F.min(F.struct("rank", "pos", "label")).alias("m"))
    out = once.select("qid", "id", "m.label", F.row_number().over(W.partitionBy("qid").orderBy("m.rank", "m.pos", "id")).alias("place"))
    return out if limit is None else out.where(F.col("place") <= limit)


def unknown_labels(predictions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Predicted labels without candidates, and predictions whose probability isn't within 0 and 1."""
    bad = ~F.coalesce(F.col("probability").between(0, 1) & ~F.isnan("probability"), F.lit(False))
    unknown = predictions.join(candidates.select("label").distinct(), "label", "left_anti").select("label", F.lit("unknown label").alias("problem"))
    return unknown.unionByName(predictions.where(bad).select("label", F.lit("probability").alias("problem")))


def class_filter(classes: DataFrame, mvp: DataFrame, reviewed: DataFrame, scope: str = "all", status: str = "all", query: str = "") -> DataFrame:
    """Classes (class, aliases) in a scope ('mvp', 'all') with a status ('pending', 'reviewed', 'all') whose name or alias contains the query."""
    out = classes
    if scope == "mvp":
        out = out.join(mvp.select("class").distinct(), "class", "left_semi")
    if status != "all":
        out = out.join(reviewed.select("class").distinct(), "class", "left_semi" if status == "reviewed" else "left_anti")
    q = query.strip().lower()
    if q:
        out = out.where(F.contains(F.lower("class"), F.lit(q)) | F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit(q))))
    return out


def neighbours(listed: DataFrame, key: str, order: str, group: str) -> DataFrame:
    """Each row with the one before and after it within its group."""
    w = W.partitionBy(group).orderBy(order)
    return listed.withColumn("previous", F.lag(key).over(w)).withColumn("next", F.lead(key).over(w))


def successor(listed: DataFrame, removed: DataFrame, key: str, order: str, group: str) -> DataFrame:
    """(removed key, successor): the next row of the group that stays, or else the one before, null if none is left."""
    gone = removed.select(key).distinct().withColumn("gone", F.lit(True))
    rows = listed.select(group, key, order).join(gone, key, "left").withColumn("stays", F.when(F.col("gone").isNull(), F.col(key)))
    w = W.partitionBy(group).orderBy(order)
    after = F.first("stays", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    before = F.last("stays", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("successor", F.coalesce(after, before)).where("gone").select(key, "successor")


def conflicting_urls(rows: DataFrame, path: str = "path", url: str = "url") -> DataFrame:
    """Paths with several addresses."""
    return rows.select(path, url).distinct().groupBy(path).agg(F.count("*").alias("urls")).where("urls > 1")


def manifest_problems(candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, problem): repeated ids, classes without candidates, candidates of unknown classes."""
    twice = candidates.groupBy("class", "id").agg(F.count("*").alias("n")).where("n > 1").select("class", F.lit("repeated id").alias("problem"))
    none = classes.join(candidates, "class", "left_anti").select("class", F.lit("no candidates").alias("problem"))
    stray = candidates.join(classes, "class", "left_anti").select("class", F.lit("unknown class").alias("problem"))
    return twice.unionByName(none).unionByName(stray).distinct()


def locale_sorted(names: Column) -> Column:
    """An array of names in the order of people: by letters first, then accents and case, as Unicode's collation has it."""
    keyed = F.transform(names, lambda n: F.struct(F.collate(n, "UNICODE").alias("k"), n.alias("n")))
    return F.transform(F.array_sort(keyed), lambda s: s["n"])


def rule_problems(rules: DataFrame, penalties: DataFrame, classes: DataFrame, categories: DataFrame) -> DataFrame:
    """(subject, problem): rules of unknown classes, empty values, unknown categories, penalties that are no finite number.

    ``rules``: kind ('alias', 'preferred', 'excluded'), class, value; ``penalties``: category, points; ``classes``: class;
    ``categories``: category.
    """
    known = categories.select("category").distinct()
    stray = rules.select("class").distinct().join(classes.select("class"), "class", "left_anti").select(F.col("class").alias("subject"), F.lit("unknown class").alias("problem"))
    empty = rules.where(F.coalesce("value", F.lit("")) == "").select(F.col("class").alias("subject"), F.lit("empty value").alias("problem"))
    liked = rules.where("kind = 'preferred' and value <> ''").select(F.col("value").alias("category"))
    lost = liked.unionByName(penalties.select("category")).distinct().join(known, "category", "left_anti").select(F.col("category").alias("subject"), F.lit("unknown category").alias("problem"))
    points = F.col("points").cast("double")
    wild = penalties.where(points.isNull() | F.isnan(points) | (F.abs(points) == float("inf"))).select(F.col("category").alias("subject"), F.lit("penalty").alias("problem"))
    return stray.unionByName(empty).unionByName(lost).unionByName(wild).distinct()


#: The shape of a progress document.
PROGRESS_DOCUMENT = """kind string, schemaVersion int, sourceCommit string, manifestFingerprint string,
decisions map<string, map<string, string>>, reviewedClasses array<string>"""


def progress_document(manifest_head: DataFrame, decisions: DataFrame, reviewed: DataFrame) -> DataFrame:
    """One row, the progress document of one curator: as large as what one person has decided.

    ``manifest_head``: commit, fingerprint, one row; ``decisions``: class, candidate_id, decision; ``reviewed``: class.
    """
    of_class = decisions.groupBy("class").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("candidate_id").cast("string"), "decision")))).alias("d"))
    made = of_class.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", F.map_entries("d").alias("e"))))).alias("m"))
    made = made.select(F.transform_values("m", lambda _, e: F.map_from_entries(e)).alias("decisions"))
    named = reviewed.select("class").distinct().agg(locale_sorted(F.collect_list("class")).alias("reviewedClasses"))
    head = manifest_head.select(F.lit(PROGRESS_KIND).alias("kind"), F.lit(PROGRESS_VERSION).alias("schemaVersion"), F.col("commit").alias("sourceCommit"), F.col("fingerprint").alias("manifestFingerprint"))
    return head.join(F.broadcast(made)).join(F.broadcast(named))  # one row each


def progress_tables(document: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(head, decisions, reviewed) of progress documents, as state_problems takes them."""
    head = document.select("kind", F.col("schemaVersion").alias("version"), F.col("sourceCommit").alias("commit"), F.col("manifestFingerprint").alias("fingerprint"))
    rows = document.select(F.explode("decisions").alias("class", "d")).select("class", F.explode("d").alias("candidate_id", "decision"))
    return head, rows, document.select(F.explode("reviewedClasses").alias("class")).distinct()
