"""Benchmark decontamination by template windows; DataFrame functions only.

1. Texts become tokens; numbers, names (capitalised words inside a sentence) and units after a number become typed
   placeholders, the rest is lower-cased. A re-parameterised question keeps its template.
   Words that only their case or what stands before them makes a name or unit keep their plain form beside it: windows
   with such words are hashed a second time with the words themselves, on both sides, so a copy of an item is found
   whatever its case and line breaks.
2. Windows of ``WINDOW`` template tokens are hashed and joined with the hashed windows of the benchmark. The
   benchmark's hashes are broadcast up to ``MOST_HASHES``, so the windows of the corpus are never shuffled; beyond
   that the join shuffles. A window of placeholders alone is no template, as any eight numbers would fill it: such a
   window of an item is found by its values.
3. Matches of one item lie on diagonals (place in the text minus place in the item). On each diagonal the slots
   must be filled consistently: each value of the item stands for one value of the text. Others are dropped.
4. A document is contaminated if one item has at least ``coverage`` of its windows in it.

Items with fewer than ``WINDOW`` tokens are one window of their own length. So few words stand in many texts by chance:
such an item is found only in a text that has no other tokens. A shape window without slots, or with equal values in its
slots, is an exact copy up to case and punctuation. All lengths come from one pass over the texts, and the patterns need
time and stack in proportion to a text, whatever it holds.

Cases: null texts and texts without tokens match nothing; a null doc_id is judged like any other; rows that share
doc_id and text are judged alike; an empty benchmark or table finds nothing; items that are null or have no tokens
are skipped; an item is told by its item_id and text, so texts that share an id are judged one by one, and one without id
counts like any other (all such as one in n_items, and none in item_ids); extra columns are not read by contaminated(), and clean() returns all columns of its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sealed, settled, small, stored, text_key

WINDOW = 8
COVERAGE = 0.5
#: Up to so many distinct hashes of the benchmark's windows, 8 bytes each, are broadcast.
MOST_HASHES = 2_000_000
#: Unit words that count as units after a number.
UNITS = "mm cm dm m km in ft yd mi mg g kg t oz lb ml cl l s ms sec min h hr hrs hours minutes seconds days weeks months years km/h mph kmh m/s % percent dollars euros cents usd eur gbp meters metres miles grams liters litres degrees".split()

_NAME, _UNIT = "", ""
#: A blank within a line, no-break spaces among them.
_BLANK = r"[\s\u00a0\u2007\u202f&&[^\n]]"


def _tokens(text: Column) -> Column:
    """Words and numbers in order, in lower case; names and units carry a mark in front."""
    units = "|".join(sorted((u for u in UNITS if u.isalpha()), key=len, reverse=True))
    # texts with characters of the marks' own are rare
    bare = F.when(text.contains(_NAME) | text.contains(_UNIT), F.translate(text, _NAME + _UNIT, "")).otherwise(text)
    # a run of blanks within a line counts as one; its first blank is tried before what stands in front of it
    marked = F.regexp_replace(bare, rf"{_BLANK}(?<=[\p{{L}}\p{{N}},;]{_BLANK}){_BLANK}*+(?=\p{{Lu}}\p{{Ll}})", f" {_NAME}")
    marked = F.regexp_replace(marked, rf"(?<=[0-9]){_BLANK}*+(?=(?i:{units})(?![\p{{L}}\p{{N}}]))", f" {_UNIT}")
    return F.regexp_extract_all(F.lower(marked), F.lit(rf"[{_NAME}{_UNIT}]?[\p{{L}}\p{{M}}]++|[0-9]++(?:[.,][0-9]++)*+"), F.lit(0))


def _marked(token: Column) -> Column:
    return token.startswith(_NAME) | token.startswith(_UNIT)


def _word(token: Column) -> Column:
    """The token without its mark."""
    return F.when(_marked(token), F.substring(token, 2, 2**31 - 1)).otherwise(token)


def _slotted(token: Column) -> Column:
    # of all tokens only numbers start below the colon
    return (token < ":") | _marked(token)


def _shape(token: Column) -> Column:
    return F.when(token < ":", F.lit("<number>")).when(token.startswith(_NAME), F.lit("<name>")).when(token.startswith(_UNIT), F.lit("<unit>")).otherwise(token)


def _split(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, _tokens(F.coalesce(F.col("text"), F.lit(""))).alias("tokens"))


def _doubled(level: str, step: int) -> Column:
    return F.zip_with(level, F.slice(level, F.lit(step + 1), F.size(level)), lambda h, other: F.xxhash64(h, other))


def windows(rows: DataFrame, keys: list[str], lengths: list[int], exact: bool, window: int = WINDOW) -> DataFrame:
    """(keys, length, kind, place, hash) of each run of template tokens of the given lengths; of those below ``window``
    only where a run is the whole text.

    Kind 0 has the template, kind 1 has plain words in it where a run has names or units, and kind 2, if ``exact``
    asks for it, all tokens as they are. Hashes of 2, 4, 8... tokens are made of two of the level below, and a window
    of two overlapping ones, so its cost doesn't grow with its length.
    """
    # a condition on the number of tokens would be pushed below them, and cut every text twice
    split = _split(rows, keys)
    split = split.withColumn("h1", F.transform("tokens", lambda t: F.xxhash64(_shape(t))))
    # most words have no mark and the same hash in both
    words = F.transform("tokens", lambda t, i: F.when(_marked(t), F.xxhash64(_word(t))).otherwise(F.get("h1", i)))
    first = {"h1": F.col("h1"), "p1": F.when(F.exists("tokens", _marked), words)}
    if exact:
        first["e1"] = F.transform("tokens", lambda t: F.xxhash64(F.lit("="), _word(t)))
    split = split.select(*keys, *[c.alias(n) for n, c in first.items()])
    kinds = [n[0] for n in first]
    for step in (1 << k for k in range(max(lengths).bit_length() - 1)):
        split = split.withColumns({f"{x}{2 * step}": _doubled(f"{x}{step}", step) for x in kinds})

    def found(kind: str, n: int) -> Column:
        half = 1 << (n.bit_length() - 1)
        starts = F.slice(f"{kind}{half}", F.lit(1), F.greatest(F.size(f"{kind}{half}") - (n - 1), F.lit(0)))
        return starts if n == half else F.transform(starts, lambda h, i: F.xxhash64(F.lit(n), h, F.get(f"{kind}{half}", i + (n - half))))

    split = split.select(*keys, *[F.when(F.col(f"{x}1").isNotNull(), found(x, n)).alias(f"{x} {n}") for x in kinds for n in lengths])

    def every(n: int) -> Column:
        # a window without names and units has one hash
        other = F.transform(f"p {n}", lambda h, i: F.when(h != F.get(f"h {n}", i), h))
        if exact:
            return F.concat(f"h {n}", F.coalesce(other, F.transform(f"h {n}", lambda h: F.lit(None).cast("long"))), f"e {n}")
        return F.when(F.col(f"p {n}").isNull(), F.col(f"h {n}")).otherwise(F.concat(f"h {n}", other))

    alone = lambda n: F.lit(True) if n >= window else F.size(f"h {n}") == 1
    of_length = [F.struct(F.lit(n).alias("length"), F.size(f"h {n}").alias("n"), F.when(alone(n), every(n)).alias("hashes")) for n in lengths]
    each = split.select(*keys, F.explode(F.array(*of_length)).alias("w"))
    each = each.select(*keys, "w.length", "w.n", F.posexplode("w.hashes").alias("at", "hash")).where(F.col("hash").isNotNull())
    return each.select(*keys, "length", F.floor(F.col("at") / F.col("n")).cast("int").alias("kind"), (F.col("at") % F.col("n")).alias("place"), "hash")


def with_slots(hits: DataFrame, rows: DataFrame, keys: list[str], name: str, slots: Column) -> DataFrame:
    """``hits`` with ``slots``, made of the ``tokens`` of their rows."""
    texts = rows.join(small(stored(hits.select(*[F.col(k).alias(f"k_{k}") for k in keys]).distinct())), _same(keys, "", "k_"), "left_semi")
    split = _split(texts, keys).dropDuplicates(keys).select(*[F.col(k).alias(f"s_{k}") for k in keys], "tokens")
    return hits.join(split, _same(keys, "", "s_")).withColumn(name, slots).drop("tokens", *[f"s_{k}" for k in keys])


def _same(keys: list[str], left: str, right: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}{k}").eqNullSafe(F.col(f"{right}{k}"))
    return out


def item_windows(benchmark: DataFrame, window: int) -> DataFrame | None:
    """(item_id, item_th, item_place, kind, hash, length, item_slots) of the items; None if there are none.

    A slot is its place in the window and its value. A window of placeholders alone has no template's hash but that of
    its values, and needs no slots then.
    """
    items = benchmark.select("item_id", text_key().alias("item_th"), "text")
    sized = items.withColumn("n", F.size(_tokens(F.coalesce(F.col("text"), F.lit(""))))).where("n > 0").withColumn("n", F.least("n", F.lit(window)))
    out = None
    for n in sorted(r[0] for r in sized.select("n").distinct().collect()):  # at most ``window`` lengths
        part = windows(sized.where(F.col("n") == n), ["item_id", "item_th"], [n], True, window)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return None
    slot = F.transform(F.slice("tokens", F.col("place") + 1, F.col("length")), lambda t, i: F.when(_slotted(t), F.struct(i.alias("at"), t.alias("value"))))
    out = with_slots(out, items, ["item_id", "item_th"], "item_slots", F.filter(slot, lambda x: x.isNotNull())).withColumnRenamed("place", "item_place")
    bare, by_value = F.size("item_slots") == F.col("length"), F.col("kind") == 2
    none = F.filter("item_slots", lambda x: F.lit(False))
    return out.where(F.when(bare, F.col("kind") > 0).otherwise(~by_value)).withColumn("item_slots", F.when(by_value, none).otherwise(F.col("item_slots")))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, th, item_id, item_th, coverage) for every contaminated text and item."""
    items = item_windows(benchmark, window)
    rows = docs.select("doc_id", text_key().alias("th"), "text")
    if items is None:
        return rows.limit(0).select("doc_id", "th", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("long").alias("item_th"), F.lit(None).cast("double").alias("coverage"))
    items = stored(items)
    wanted = items.groupBy(F.col("item_id").alias("w_item_id"), F.col("item_th").alias("w_item_th")).agg(F.countDistinct("item_place").alias("n_windows"))
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())
    hashes = stored(items.select("hash").distinct())
    of_docs = windows(rows, ["doc_id", "th"], lengths, not items.where("kind = 2").isEmpty(), window)
    hits = stored(of_docs.drop("length", "kind").join(small(hashes, MOST_HASHES), "hash", "left_semi"))
    hits = stored(hits.join(small(items), "hash").withColumn("diagonal", F.col("place") - F.col("item_place")).drop("hash", "kind"))
    item = ["item_id", "item_th"]
    where = ["doc_id", "th", *item, "diagonal"]
    # each value of the item must stand for one value of the text
    values = F.transform("item_slots", lambda x: F.struct(x["value"].alias("of"), _word(F.get("tokens", F.col("place") + x["at"])).alias("value")))
    slotted = with_slots(hits.where(F.size("item_slots") > 0), rows, ["doc_id", "th"], "slots", values)
    pairs = slotted.select(*where, F.explode("slots").alias("p"))
    broken = pairs.groupBy(*where, F.col("p.of").alias("v")).agg(F.min("p.value").alias("lo"), F.max("p.value").alias("hi")).where("lo <> hi").select(*where).distinct()
    sound = hits.join(broken.select(*[F.col(c).alias(f"b_{c}") for c in where]), _same(where, "", "b_"), "left_anti")
    share = sound.groupBy("doc_id", "th", *item).agg(F.countDistinct("item_place").alias("n")).join(small(stored(wanted)), _same(item, "", "w_"))
    return share.where(F.col("n") >= coverage * F.col("n_windows")).select("doc_id", "th", *item, (F.col("n") / F.col("n_windows")).alias("coverage"))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, n_items, item_ids (sorted) and the best coverage."""
    found = matches(docs, benchmark, window, coverage)
    by_doc = stored(found.groupBy(F.col("doc_id").alias("f_id"), F.col("th").alias("f_th")).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max(F.col("item_id").isNull().cast("int")).alias("nameless"), F.max("coverage").alias("coverage")))
    rows = docs.select("doc_id", text_key().alias("th"))
    out = rows.join(small(by_doc), F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")), "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce(F.size("item_ids") + F.col("nameless"), F.lit(0)).alias("n_items"), "item_ids", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    found = settled(lambda: matches(docs, benchmark, window, coverage).select(F.col("doc_id").alias("f_id"), F.col("th").alias("f_th")).distinct(), docs.sparkSession)
    sealed = Sealed(docs)
    same = sealed["doc_id"].eqNullSafe(F.col("f_id")) & (F.xxhash64(sealed["text"]) == F.col("f_th"))
    return sealed.df.join(small(found), same, "left_anti").select(*sealed.back())
