"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.llm import common, decontamination, host_rules, kernels, kneser_ney, mixing, near_dup, pii_surrogates, sharding, substring_dedup, toxicity, url_filter

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Every name that an operator uses inside, and those of its results.
EXTRA = """kept size shard Slot pack f1 th host bucket copies label score n Item_Id id start s_shard s_range range order key rows before whole quota edge last_edge
    of draw words e_source target taken source_size middle copy f_id f_th g_id g_th s_id s_th near again row rn n_words base_failed host_docs host_failed host_rate n_entities
    entity_types x_row fixes ents e kind c tweak made s at place hash tokens h1 p1 typed plain item_place item_slots diagonal coverage u1 u2 run held ruling gain
    tokens_of f2 sig rep times body lang_ component_id th_ rank weight cap level water""".split()
EXTRA += ["in 0", "rows of key", "in", "pii ents", "near rank"]


def sentence(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


LONG = sentence(1, 30_000)
BASE = sentence(2, 120)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)
ROWS = [
    (0, BASE, "en", "a", 1), (1, NEAR, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \n\t ", "en", "b", 0), (5, LONG, "en", "b", 1), (5, LONG, "en", "b", 1),
    (6, "one two", "en", None, 1), (7, "one two", None, "c", 1), (None, BASE, "en", "c", 1), (None, BASE, "en", "c", 1), (8, "same same same same same same same same same same same", "de", "a", 1), (9, "ünï cödé " * 9, "fr", "é", 1), (10, sentence(3, 300), "en", "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in EXTRA})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_kernels_against_plain_python():
    texts = [(t or "").encode() for _, t, *_ in ROWS] + ["É\x0bx\x1cy".encode(), b"\xff a"]
    w = kernels.Words(texts)
    flat = [x for t in texts for x in t.split()]
    assert [w.buffer[a:b] for a, b in zip(w.starts, w.ends)] == flat and list(w.counts) == [len(t.split()) for t in texts]
    by: dict = {}
    for x, h in zip(flat, w.hashes):
        assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)
    for n in (5, 25, 50):
        g, by = kernels.grams(w.hashes, n), {}
        for i, h in enumerate(g):
            assert by.setdefault(tuple(flat[i : i + n]), h) == h
        assert len(set(by.values())) == len(by)
        ok = kernels.gram_mask(w.first, n, len(g))
        doc = np.repeat(np.arange(len(texts)), w.counts)
        assert list(ok) == [doc[i] == doc[i + n - 1] for i in range(len(g))]


def test_long_word_and_long_text_hash_alike():
    whole = kernels.Words([b"x" * 3_000_000 + b" tail " + b"y " * 700_000])
    assert whole.hashes[1] == kernels.Words([b"tail"]).hashes[0] and whole.counts[0] == 700_002


def test_near_dup_cases(docs, none):
    rows = near_dup.near_duplicates(docs).collect()
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows)
    assert got[(0, 116, 0, True)] == 1 and got[(1, 116, 0, False)] == 1
    assert got[(2, 0, 2, True)] == got[(3, 0, 3, True)] == got[(4, 0, 4, True)] == 1
    assert got[(5, len(brute.shingles(LONG)), 5, True)] == 2 and got[(6, 1, 6, True)] == 1 and got[(7, 1, 6, False)] == 1
    assert got[(None, 116, None, True)] == 2
    assert near_dup.near_duplicates(none).count() == 0
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([0, 2, 3, 4, 5, 6, None, None, 8, 9, 10])
    assert near_dup.one_of_each(none).count() == 0


def test_texts_of_one_id_share_a_component(spark):
    rows = [(1, BASE), (1, sentence(9, 90)), (2, NEAR), (3, sentence(9, 90)), (4, sentence(8, 90))]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_crowds_lose_no_link(spark):
    """A crowd of copies of a base, many just above and many just below the similarity, and a chain."""
    r, base, rows = random.Random(5), sentence(4, 100).split(), []
    for i in range(400):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 3, 4, 5])):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    chain = sentence(6, 100).split()
    for i in range(400, 430):
        rows.append((i, " ".join(chain)))
        chain[(i * 37) % 100] = f"link{i}"
        chain[(i * 37 + 11) % 100] = f"link{i}b"
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:50])]
    expected, links = brute.near_dup(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected and links > 1000


def test_a_key_cut_in_one_batch_is_a_crowd_wherever_its_rows_meet(spark):
    """Five rows of a key in one batch, of which three go on, and one row in another: four arrive."""
    sigs = np.arange(6 * 32, dtype=np.uint32).reshape(6, 32)
    sigs[:, :4] = 7
    rows = [(i + 1, s.tobytes()) for i, s in enumerate(sigs)]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 5)
    try:
        pairs = common.stored(near_dup.candidates(spark.createDataFrame(rows, "f1 long, sig binary").coalesce(1), 4).withColumn("agree", F.lit(4)))
    finally:
        spark.conf.set(size, before)
    ends = [(r.a, r.b, r.crowd) for r in pairs.collect() if r.b == 6]
    assert len(ends) == 3 and all(crowd for *_, crowd in ends)
    alone = spark.createDataFrame([], "node long, label long")
    assert {r.f1 for r in near_dup.rest_nodes(pairs, alone).collect()} == {1, 2, 3, 4, 5, 6}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in near_dup.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}
    assert near_dup.components(edges.where("false")).count() == 0


def test_substring_cases(docs, none):
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup.without_repeats(docs).collect())
    assert got == Counter(brute.substring_dedup([(i, t) for i, t, *_ in ROWS]))
    assert substring_dedup.without_repeats(none).count() == 0


def test_substring_overlaps(spark):
    r = random.Random(3)
    passages = [sentence(100 + i, n).split() for i, n in enumerate((49, 50, 51, 60, 130))]
    rows = []
    for i in range(120):
        w = []
        for _ in range(r.randint(1, 4)):
            p = r.choice(passages)
            cut = r.choice([0, 0, 3, 10])
            w += sentence(r.random(), r.randint(0, 30)).split() + p[cut:]
        rows.append((r.randint(0, 90), " ".join(w)))
    got = Counter((x.doc_id, x.n_words, x.n_removed, hashlib.sha256(x.kept_text.encode()).hexdigest()) for x in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter(brute.substring_dedup(rows))
    spans = substring_dedup.without_repeats(spark.createDataFrame([(1, BASE), (2, "x " + BASE + " y")], "doc_id long, text string")).where("doc_id = 2").first()
    assert [tuple(s) for s in spans.removed] == [(1, 121)] and spans.kept_text == "x y"


def test_host_rule_cases(docs, none):
    out = host_rules.judge_hosts(docs).collect()
    for r in out:
        expected = brute.host_base(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == brute.base_failed(r.text) and not (r.kept and r.base_failed)
        assert (r.host_rate is None) == (r.source is None) and r.host == "clash"
    assert len(out) == len(ROWS) and host_rules.judge_hosts(none).count() == 0
    bad = next(r for r in out if r.source == "b")
    assert 0 < bad.host_rate < 1


def test_a_host_that_fails_takes_its_documents_along(spark):
    good, junk = sentence(1, 60), "bad"
    rows = [(i, good if i % 20 == 0 else junk, "spam") for i in range(400)] + [(1000 + i, good, f"h{i % 10}") for i in range(400)] + [(5000, junk, "tiny"), (5001, good, "h1")]
    out = host_rules.judge_hosts(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert not any(kept[i] for i in range(400)) and all(kept[1000 + i] for i in range(400)) and kept[5001]


def test_line_and_symbol_counts():
    texts = ["a b\n\na b\n \nc#*\n a b", "#$%&|<>*", "x\x0by\x0cz\rw", None, "é" * 5]
    got = host_rules.text_counts(texts)
    for i, t in enumerate(texts):
        assert tuple(int(got[c][i]) for c in host_rules.COUNTS) == brute.host_base(t)


def test_mixing_cases(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and sum(r["size"] for r in rows) == sum(len(brute.words(t)) for _, t, *_ in ROWS)
    assert all(r.taken == r.copies * r["size"] <= 2 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    targets = {r.source: r.target for r in rows}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total
    assert mixing.mix(none).count() == 0 and mixing.repeated(mixing.mix(none)).count() == 0
    assert mixing.repeated(mixing.mix(docs)).count() == sum(r.copies for r in rows)
    nothing = docs.withColumn("text", F.lit(None).cast("string"))
    assert {(r["size"], r.target, r.taken) for r in mixing.mix(nothing).collect()} == {(0, 0.0, 0)}


def test_water_filling_equals_the_loop(spark):
    r = random.Random(2)
    for _ in range(3):
        docs = [(i, r.choice(["a", "b", "c", "d", "é", None]), " ".join(["w"] * r.randint(0, 50))) for i in range(200)]
        got = {x.doc_id: x.copies for x in mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect() if x["size"]}
        expected = {i: n for i, n in brute.mix(docs).items() if len(brute.words(dict((d, t) for d, _, t in docs)[i]))}
        assert got == expected


def test_a_quota_that_ends_with_a_bucket(spark):
    """Ten documents of ten words in one source: the rest is five of them, whatever bucket they lie in."""
    for n, empty in ((2, 0), (10, 0), (10, 30)):
        docs = [(i, "a", " ".join(["w"] * 10)) for i in range(n)] + [(100 + i, "a", "") for i in range(empty)]
        df = spark.createDataFrame(docs, "doc_id long, source string, text string")
        rows = mixing.mix(df).collect()
        assert {r.doc_id: r.copies for r in rows} == brute.mix(docs)
        con = duckdb.connect()
        con.execute("create table documents (doc_id bigint, source varchar, text varchar)")
        con.executemany("insert into documents values (?, ?, ?)", docs)
        assert {r.doc_id: r.taken for r in rows} == {r[0]: r[4] for r in con.execute(mixing.SQL).fetchall()}
        assert sum(r.taken for r in rows) == 15 * n


def test_sharding_cases(docs, none):
    rows = sharding.assign_shards(docs, 3).collect()
    assert len(rows) == len(ROWS) and {r.law for r in rows} == {"key"}
    for s in range(3):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    by_key = {}
    for r in rows:
        assert by_key.setdefault(r.doc_id, r.shard) == r.shard and r.grown_shard in (r.shard, 3)
        assert r["size"] == len((r.text or "").encode()) + 1
    assert sharding.assign_shards(none, 3).count() == 0


def test_jump_matches_the_published_loop(spark):
    keys = [0, 1, 2**63, 2**64 - 1, *(random.Random(1).randrange(2**64) for _ in range(200))]
    df = spark.createDataFrame([(str(k),) for k in keys], "k string").withColumn("key", F.col("k").cast("decimal(20,0)"))
    for n in (1, 2, 10, 100):
        assert all(r.s == brute.jump(int(r.k), n) for r in df.select("k", sharding.jump(F.col("key"), n).alias("s")).collect())


QUESTION = "The train left London at 7 with 42 men, and by 9 in the evening Paula saw 42 men in London again"


def test_decontamination_cases(spark, docs, none):
    bench = spark.createDataFrame([(7, QUESTION), (8, "tiny item"), (9, None), (10, "?!")], "item_id long, text string")
    rows = [
        (1, f"{BASE} {QUESTION.upper().lower()} {BASE}"), (2, "The train left Berlin at 3 with 17 men, and by 5 in the evening Maria saw 17 men in Berlin again"),
        (3, "The train left Berlin at 3 with 17 men, and by 5 in the evening Maria saw 18 men in Bremen again"), (4, "The train left London at 7 with 42 men"), (5, "a TINY item here"), (6, None), (6, None), (None, QUESTION), (7, ""), (8, "TINY\n item!"),
    ]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.contaminated, tuple(r.item_ids or ())) for r in decontamination.contaminated(texts, bench).collect()]
    expected = brute.contaminated(rows, [(7, QUESTION), (8, "tiny item"), (10, "?!")])
    assert Counter(got) == Counter((i, bool(f), tuple(x for x, _ in f)) for (i, _), f in zip(rows, expected))
    assert Counter(got) == Counter({(1, True, (7,)): 1, (2, True, (7,)): 1, (3, False, ()): 1, (4, False, ()): 1, (5, False, ()): 1, (6, False, ()): 2, (None, True, (7,)): 1, (7, False, ()): 1, (8, True, (8,)): 1})
    assert Counter(r.doc_id for r in decontamination.clean(texts, bench).collect()) == Counter([3, 4, 5, 6, 6, 7])
    assert decontamination.contaminated(docs, bench).count() == len(ROWS) and decontamination.clean(docs, bench).columns == docs.columns
    assert decontamination.contaminated(none, bench).count() == 0
    assert not any(r.contaminated for r in decontamination.contaminated(texts, bench.where("false")).collect())


def test_items_without_id_or_with_one_for_two_texts(spark):
    """An item is its id and its text: null ids count, and a text under a shared id isn't measured by the other's windows."""
    long = "a much longer text under the same number that shares nothing with the short one beside it and goes on for many words more"
    bench = spark.createDataFrame([(None, QUESTION), (None, "one more nameless item with exactly nine words here"), (3, "a short text of just eight plain words"), (3, long), (4, "Paris"), (5, "What is it")], "item_id long, text string")
    rows = [(1, f"{BASE} {QUESTION} {BASE}"), (2, "see: a short text of just eight plain words!"), (3, f"{long}. a short text of just eight plain words"), (4, "I saw Paris. What is it like"), (5, "paris"), (6, "what is it?"), (7, f"{QUESTION} one more nameless item with exactly nine words here")]
    got = {r.doc_id: (r.contaminated, r.n_items, r.item_ids) for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: (True, 1, []), 2: (True, 1, [3]), 3: (True, 1, [3]), 4: (False, 0, None), 5: (True, 1, [4]), 6: (True, 1, [5]), 7: (True, 1, [])}


def test_copies_of_an_item_with_names_in_any_case_and_spacing(spark):
    item = "Which year did Marie Curie win the Nobel Prize in Physics with Pierre Curie at 5 km from Paris"
    other = item.replace("Marie", "Lise").replace("Pierre", "Jean").replace("Curie", "Meitner").replace("Paris", "Vienna")
    texts = [item.lower(), item.upper(), item.replace(" ", "\n"), item.replace(" ", "  "), item.replace(" ", "\u00a0"), item.title(), f"{BASE}. {item.upper()} {BASE}", other, other.replace(" ", "  ")]
    texts += [other.lower(), other.replace("Jean Meitner", "Jean Hahn"), item.lower().replace("pierre curie", "pierre hahn").replace("prize", "medal")]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.contaminated, r.coverage) for r in decontamination.contaminated(rows, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert {i: got[i] for i in range(9)} == {i: (True, 1.0) for i in range(9)}
    assert not any(got[i][0] for i in range(9, 12))


def test_numbers_alone_are_no_template(spark):
    """Windows of numbers are found by their values, so columns of numbers meet no other item of numbers."""
    r = random.Random(3)
    numbers = lambda n: " ".join(str(r.randint(0, 99)) for _ in range(n))
    item, short = numbers(12), "3 5 7"
    rows = [(i, numbers(300)) for i in range(20)] + [(50, f"{numbers(50)} {item} {numbers(50)}"), (51, f"so {item.replace(' ', chr(10))}"), (52, "(3) 5; 7"), (53, "Then Ann, Bob, Cid, Dan, Eve, Fay, Gus, Hal and 5 km")]
    bench = [(1, item), (2, short), (3, "to Ann, Bob, Cid, Dan, Eve, Fay, Gus, Hal")]
    got = {x.doc_id: (x.item_ids or [], x.coverage) for x in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    expected = brute.contaminated(rows, bench)
    assert {i: ids for i, (ids, _) in got.items()} == {i: [x for x, _ in f] for (i, _), f in zip(rows, expected)}
    assert 1 in got[50][0] and got[51] == ([1], 1.0) and got[52] == ([2], 1.0) and sum(1 in ids for ids, _ in got.values()) == 2


def test_decontamination_of_random_templates(spark):
    r = random.Random(12)
    words = "the a train Paris Ann Bob 5 7 12.5 km kg, is of at left; and\n2,000 ÉMILE Émile m".split(" ")
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(60)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 14)))) for i in range(25)]
    for i, (_, t) in enumerate(items):
        changed = t.replace("Ann", r.choice(["Bob", "Ann"])).replace("5", "9")
        texts[i] += r.choice([" ", ". ", "\n"]) + r.choice([t, t.lower(), t.upper(), changed]) + " end"
    rows = list(enumerate(texts))
    got = {x.doc_id: (x.item_ids or [], x.coverage) for x in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for (i, _), f in zip(rows, brute.contaminated(rows, items)):
        assert got[i] == ([x for x, _ in f], max((c for _, c in f), default=0.0)), texts[i]


def test_texts_that_strain_patterns(spark):
    """Long runs without a blank, and long chains of short parts: time and stack in proportion to the text."""
    rows = [
        (1, ",".join(str(i) for i in range(200_000))), (2, "a" * 2_000_000 + "@"), (3, "x@" + "a." * 200_000), (4, "x@a." * 100_000), (5, "1." * 100_000), (6, "+1 " * 200_000),
        (7, "4111 " * 8_000), (8, "0123456789abcdef" * 10_000), (9, "Mr. " * 8_000), (10, "a" * 1_000_000 + "@b.com " + "Ab" * 500_000), (11, "1-" * 200_000), (12, "(1) " * 200_000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    assert not any(r.contaminated for r in decontamination.contaminated(df, bench).collect())
    got = {r.doc_id: r for r in pii_surrogates.replace_entities(df, "k").select("doc_id", "n_entities", F.length("text").alias("n")).collect()}
    assert {i: got[i].n for i, t in rows if i != 9} == {i: len(t) for i, t in rows if i != 9}  # names change their length
    assert got[10].n_entities == 1 and got[8].n_entities == 1


def test_surrogate_cases(spark, docs, none):
    key = "k"
    rows = [
        (1, "mail Ann.Lee+x@Corp-A.example.COM or ann.lee+x@corp-a.example.com"), (2, "from 10.0.0.1 and 255.9.30.100, not 1.2.3 or 999.1.1.1"), (3, "card 4111-1111 1111-1111 is 4111111111111111, call +49 (030) 555-1234 or (555) 123-4567 or 555-123-4567"),
        (4, "Frau Müller met Mr. John Smith; Mr. Smith left. Mrs. SMITH stayed, Mrs. Ann Smith too. Госпожа Анна Иванова осталась, Κύριος Παύλος Δούκας"), (5, "token = \"DEADBEEFDEADBEEFDEADBEEFDEADBEEF\" ssn 123-45-6789 " + "ab" * 256), (6, None), (7, ""), (None, "no data here 12 34"),
    ]
    got = pii_surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), key).collect()
    assert [(r.text, r.n_entities) for r in got] == brute.surrogates([t for _, t in rows], key)
    out = {r.doc_id: r for r in got}
    a, b = re.findall(r"\S+@\S+", out[1].text)
    assert a.lower() == b.lower() and a.endswith(".COM") and b.endswith(".com") and "lee" not in out[1].text.lower()
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", out[2].text)
    assert [len(x) for x in ips[0].split(".")] == [2, 1, 1, 1] and all(int(o) < 256 for x in ips[:2] for o in x.split(".")) and ips[2] == "999.1.1.1" and "10.0.0.1" not in ips
    spaced, plain, phone, own, same = re.match(r"card (\S+ \S+) is (\d+), call (.*) or (.*) or (.*)", out[3].text).groups()
    assert re.sub(r"\D", "", spaced) == plain != "4111111111111111" and phone.startswith("+49 (") and phone != "+49 (030) 555-1234"
    assert own != "(555) 123-4567" and re.sub(r"\D", "", own) == re.sub(r"\D", "", same)
    # a family is the same with and without first names, in capitals and under any title
    first, smith, alone, capitals, wife, family = re.search(r"Mr\. (\w+) (\w+); Mr\. (\w+) left\. Mrs\. (\w+) stayed, Mrs\. (\w+) (\w+) too", out[4].text).groups()
    assert smith == alone == family == capitals.capitalize() != "Smith" and first.endswith("rio") and wife.endswith("lia") and capitals.isupper()
    assert re.search(r"Госпожа [А-Я][а-я]+лия [А-Я][а-я]+ осталась, Κύριος [Α-Ω]\w+ριος [Α-Ω][α-ω]+$", out[4].text) and "Müller" not in out[4].text
    assert re.search(r'"[0-9A-F]{32}"', out[5].text) and not re.search("DEADBEEF|abab", out[5].text) and "123-45-6789" not in out[5].text and re.search("[0-9a-f]{512}$", out[5].text)
    assert out[6].text is None and out[7].text == "" and out[None].text == "no data here 12 34" and out[None].n_entities == 0
    assert pii_surrogates.replace_entities(docs, key).count() == len(ROWS) and pii_surrogates.replace_entities(none, key).count() == 0
    with pytest.raises(ValueError):
        pii_surrogates.replace_entities(docs, "")


#: Texts and the entities in them, written down before any pattern: what must go, piece by piece, and nothing else.
FOUND = [
    ("Mr. John Paul Smith met Mr. John Smith", ["John", "Paul", "Smith"]), ("Frau Dr. Müller kam", ["Müller"]), ("Mrs. Smith-Jones left", ["Smith-Jones"]), ("Mr. O'Brien and Mr. D’Angelo", ["O'Brien", "D’Angelo"]),
    ("Mr.  John  Smith", ["John", "Smith"]), ("Herr\nWeber ging", ["Weber"]), ("Dr. Adams said", ["Adams"]), ("Mr. John Smith came. John Smith left.", ["John Smith"]), ("Prof. Dr. Anna Lindqvist", ["Anna", "Lindqvist"]),
    ("Mr. J. Smith and Mr. J. R. Tolkien", ["Smith", "Tolkien"]), ("Herr Ludwig van Beethoven spielte", ["Ludwig", "Beethoven"]), ("Señora Ana de la Cruz llegó", ["Ana", "Cruz"]), ("Mme Élise Dupré-Łoś", ["Élise", "Dupré-Łoś"]), ("Mr. Smith's car", ["Smith"]),
    ("Monsieur Jean-Luc Picard arrive", ["Jean-Luc", "Picard"]), ("Ms. Nu\u0301n\u0303ez won", ["Nu\u0301n\u0303ez"]), ("Miss Ann Mary Lou Baker-Hill sang", ["Ann", "Mary", "Lou", "Baker-Hill"]), ("Mr.\u00a0Tom\u00a0Ford", ["Tom", "Ford"]), ("Sra. García y Sr. Pérez", ["García", "Pérez"]),
    ("Госпожа Анна Иванова-Петрова", ["Анна", "Иванова-Петрова"]), ("Κυρία Μαρία Δούκα", ["Μαρία", "Δούκα"]), ("mail a.b@c-d.example.org now", ["a.b@c-d.example"]), ("at 10.1.2.3 and 192.168.0.77", ["10.1.2.3", "192.168.0.77"]), ("see 2001:db8:0:0:8:800:200c:417a", ["2001:db8:0:0:8:800:200c:417a"]),
    ("host fe80:0:1::42ab up", ["fe80:0:1::42ab"]), ("call 743 555 3824 today", ["743 555 3824"]), ("call (743) 555-3824", ["(743) 555-3824"]), ("call 743-555-3824", ["743-555-3824"]), ("call 743.555.3824", ["743.555.3824"]), ("ring +44 20 7946 0958", ["20 7946 0958"]),
    ("ssn 078-05-1120", ["078-05-1120"]), ("card 4111 1111 1111 1111", ["4111 1111 1111 1111"]), ("card 5500-0000-0000-0004", ["5500-0000-0000-0004"]), ("key 0123456789abcdef0123456789abcdef", ["0123456789abcdef0123456789abcdef"]), ("Mr. Smith, Mrs. Smith and Dr. Smith", ["Smith"]),
]
#: Texts without personal data.
KEPT = ["Mr. and so on", "the Dr. 5 way", "at 12:30:45 or a::b and std::vector", "1 200 300 4000 5", "versions 1.2.3 and 999.1.1.1", "John Smith has no title", "rows 4111 1111", "Misses Smart", "Srinagar is a town", "Mrs", "chapter 12-34-56"]


def test_what_is_found_and_what_is_kept(spark):
    rows = [(i, t) for i, (t, _) in enumerate(FOUND)] + [(100 + i, t) for i, t in enumerate(KEPT)]
    out = {r.doc_id: r for r in pii_surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "a key").collect()}
    expected = dict(zip([i for i, _ in rows], brute.surrogates([t for _, t in rows], "a key")))
    for i, (text, gone) in enumerate(FOUND):
        assert all(x not in out[i].text for x in gone), (text, out[i].text)
        # all around the entities stays: what is left of the text without them comes in the same order
        rest = re.split("|".join(map(re.escape, sorted(gone, key=len, reverse=True))), text)
        at = 0
        for part in rest:
            part = re.sub(r"\b[A-Z]\.", "", part) if "J." in text else part
            for word in part.split():
                assert word in out[i].text[at:], (text, out[i].text)
                at = out[i].text.index(word, at) + len(word)
        assert (out[i].text, out[i].n_entities) == expected[i]
    assert [out[100 + i].text for i in range(len(KEPT))] == KEPT
    # coreference: the same parts, with and without a title, have the same surrogates
    a, b, c = re.fullmatch(r"Mr\. (\w+) (\w+) came\. (\w+ \w+) left\.", out[7].text).groups()
    assert c == f"{a} {b}" and a.endswith("rio")
    first, middle, family, again, same = re.fullmatch(r"Mr\. (\w+) (\w+) (\w+) met Mr\. (\w+) (\w+)", out[0].text).groups()
    assert (first, family) == (again, same) and len({first, middle, family}) == 3
    assert re.fullmatch(r"Mr\. [A-Z]\. \w+ and Mr\. [A-Z]\. [A-Z]\. \w+", out[9].text) and re.fullmatch(r"Herr \w+ van \w+ spielte", out[10].text)
    for i in (31, 32):
        assert brute.luhn(re.sub(r"\D", "", FOUND[i][0])) and brute.luhn(re.sub(r"\D", "", out[i].text))


def test_surrogates_stay_distinct_under_collisions(spark):
    """All 100 addresses 1.1.0.0 to 1.1.9.9, whose space is so small that collisions must happen, and all of a@a.co to f@z.co, which leave no room."""
    rows = [(i, f"see 1.1.{i // 10}.{i % 10} now") for i in range(100)]
    rows += [(1000 + i, f"to {chr(97 + i // 26)}@{chr(97 + i % 26)}.co and Mr. {sentence(i, 1).title()} Ab") for i in range(26 * 26)]
    out = pii_surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k2").orderBy("doc_id").collect()
    assert [(r.text, r.n_entities) for r in out] == brute.surrogates([t for _, t in rows], "k2")
    made, real = [r.text.split()[1] for r in out], {t.split()[1] for _, t in rows}
    assert len(set(made)) == len(rows) and not set(made) & real


def test_toxicity_cases(spark, docs, none):
    r, rows, labels = random.Random(4), [], []
    for i in range(400):
        bad = i % 4 == 0
        group = r.choice(["women", "men", "gay", "straight"]) if bad or r.random() < 0.3 else ""
        # the toxic half names women more often, which the swaps must keep from mattering
        group = "women" if bad and r.random() < 0.7 else group
        rows.append((i, f"{sentence(i, 30)} {group} {'vile' if bad and i % 16 else ''}"))
        labels.append((i, int(bad)))
    df, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None), (5000, 7)], "doc_id long, toxic int")
    model = toxicity.learned(df, marks)
    scores = dict(zip("abcde", model.scores(["you vile thing", "hello women", "hello men", None, ""])))
    assert scores["a"] > 0.7 > scores["b"] and abs(scores["b"] - scores["c"]) < 0.1 and scores["d"] == scores["e"] < 0.5
    sets, changes = map(list, zip(*toxicity.sets_and_changes([t for _, t in rows])))
    free = toxicity.fit(sets, np.array([y for _, y in labels]), changes, counterfactual=0.0)
    gap = lambda m: abs(float(np.diff(m.scores(["hello women", "hello men"]))[0]))
    assert gap(model) < gap(free) / 2
    assert toxicity.scored(docs, model).count() == len(ROWS) and toxicity.scored(none, model).count() == 0
    empty = toxicity.learned(df, marks.where("false"))
    assert {x.score for x in toxicity.scored(docs, empty).collect()} == {0.0}


def test_changes_are_those_of_swapped_sentences():
    """The penalty equals the mean squared change of the score of sentences that are really written anew."""
    r = np.random.Generator(np.random.PCG64(1))
    model = toxicity.Model(r.normal(size=1 << toxicity.FEATURE_BITS), 0.3)
    texts = ["the Women, and a gay man: women!", "no group here", "blind muslims saw american americana", "", "black black white"]
    flat, weight = toxicity.weighted_changes([c for _, c in toxicity.sets_and_changes(texts)])
    made = sum(w * float(model.weights[a].sum(dtype=np.float64) - model.weights[g].sum(dtype=np.float64)) ** 2 for (a, g), w in zip(flat, weight))
    expected, naming = 0.0, 0
    for t in texts:
        versions = brute.swapped(t, toxicity.IDENTITY, toxicity.SWAPS)
        if versions:
            naming += 1
            before, *after = model.logits([t, *versions])
            expected += float(np.mean((np.array(after) - before) ** 2))
    terms = [t for v in toxicity.IDENTITY.values() for t in v]
    alone = toxicity.RARE * float(((model.logits(terms) - model.logits([""])[0]) ** 2).sum())
    assert naming == 3 and abs(made - expected / naming - alone) < 1e-4 * made


def test_kneser_ney_equals_brute(spark):
    r = random.Random(5)
    words = ["ab", "abc", "été", "😀x", "가나", "\U00020000龍", "x\x00y", "the", "then"]
    rows = [(i, "en" if i % 3 else None, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(60)] + [(None, "en", "the été"), (3, "en", "가나 가나")]
    rows += [(61, "de", "ab abc")] * 5
    trusted = [i for i in range(30)] + [61]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = Counter((x.doc_id, x.lang, x.perplexity and round(x.perplexity, 5)) for x in kneser_ney.perplexities(df, spark.createDataFrame([(i,) for i in trusted], "doc_id long")).collect())
    expected = brute.kneser_ney([t for i, _, t in rows if i in trusted], [t for *_, t in rows])
    assert got == Counter((i, lang, p and round(p, 5)) for (i, lang, _), p in zip(rows, expected))


def test_the_largest_doc_id_and_copies_of_a_row(spark):
    top = 2**63 - 1
    rows = [(top, f"a {BASE}"), (None, f"b {BASE}")] + [(4, f"c {BASE} d")] * 300 + [(3, BASE)] * 2
    got = Counter((x.doc_id, x.n_words, x.n_removed, hashlib.sha256(x.kept_text.encode()).hexdigest()) for x in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter(brute.substring_dedup(rows)) and {k[0] for k in got} == {top, None, 4, 3}


def test_kneser_ney_cases(spark, docs, none):
    marks = spark.createDataFrame([(0, 1), (10, 1), (5, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    rows = kneser_ney.judge(docs, marks).collect()
    assert len(rows) == len(ROWS)
    assert all((r.perplexity is None) == (r.doc_id in (2, 3)) and (r.perplexity is not None or not r.kept) for r in rows)
    assert all(r.kept for r in rows if r.doc_id in (0, 10))
    assert kneser_ney.judge(none, marks).count() == 0
    assert all(r.kept == (r.perplexity is not None) for r in kneser_ney.judge(docs, marks.where("false")).collect())


def test_kneser_ney_thresholds_equal_brute(spark):
    """Thresholds of a large, a small, a single, an unlabelled and a null language, against the same rule over lists."""
    r = random.Random(12)
    letters = {"en": "abcdefgh", "de": "abcdxyzuvw", "fr": "mnop", "es": "qrst", None: "abcd"}
    size = {"en": 260, "de": 40, "fr": 3, "es": 6, None: 8}
    rows, i = [], 0
    for lang, n in size.items():
        for _ in range(n):
            rows.append((i, lang, " ".join("".join(r.choice(letters[lang]) for _ in range(r.randint(2, 5))) for _ in range(r.randint(1, 12)))))
            i += 1
    trusted = [i for i, lang, _ in rows if lang != "es" and i % 7]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {x.doc_id: x for x in kneser_ney.judge(df, spark.createDataFrame([(i, 1) for i in trusted], "doc_id long, quality int"), quantile=0.9).collect()}
    held = {i for i in trusted if zlib.crc32(str(i).encode()) % 5 == 0}
    expected = brute.thresholds([(i, lang, got[i].perplexity) for i, lang, _ in rows], held, 0.9, kneser_ney.PRIOR)
    assert {lang for i, lang, _ in rows if i in held} >= {"en", "de", None}
    for i, lang, _ in rows:
        assert abs(got[i].threshold - expected[lang]) < 1e-5 and got[i].kept == (got[i].perplexity <= got[i].threshold)
    assert len({round(t, 4) for t in expected.values()}) >= 3


def test_kneser_ney_is_a_distribution(spark):
    """The probabilities of all characters after a seen context sum to one, with the share of unseen ones."""
    text = "abracadabra abracadabra banana bandana cabana " * 3
    r, _ = kneser_ney.runs([text])
    seen, n = np.unique(r, return_counts=True)
    letters = sorted({int(x) & ((1 << kneser_ney.BITS) - 1) for x in seen})
    assert all(int(x) >= 0 for x in seen)
    context = int(seen[len(seen) // 2]) >> kneser_ney.BITS
    asked = {context << kneser_ney.BITS | c for c in [*letters, 9999]}
    counts = {int(x): int(k) for x, k in zip(seen, n)} | {x: 0 for x in asked if x not in set(map(int, seen))}
    logs = {x.run: x.logp for x in kneser_ney.run_logs(spark.createDataFrame(list(counts.items()), "run long, n long")).collect()}
    assert abs(sum(np.exp(logs[x]) for x in asked) - 1) < 1e-9


def test_url_cases(spark):
    rows = [(1, "http://A.Example.COM/en/1?x"), (2, None), (3, "no scheme"), (4, "https://example.com/en/77"), (5, "https://notexample.com/en/7"), (5, "https://notexample.com/en/7"), (None, "x://net/de/"), (6, "a://b://c/d"), (7, "http://example.net/de/81#f"), (8, "")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "verdict", "run", "score")})
    from inkfold.llm.queries import URL_RULES

    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, URL_RULES).collect())
    assert got[(1, "a.example.com", "/en/1", "com/en/", "block")] and got[(4, "example.com", "/en/77", "example.com/en/7", "allow")]
    assert got[(5, "notexample.com", "/en/7", "com/en/", "block")] == 2 and got[(None, "net", "/de/", "net/de/", "allow")] and got[(7, "example.net", "/de/81", "example.net/de/8", "block")]
    assert got[(6, "b:", "//c/d", None, "allow")] or got[(6, "b:", "//c/d", None, "block")]
    for i in (2, 3, 8):
        assert any(k[0] == i and k[1:4] == ("", "", None) for k in got)
    assert url_filter.judge(df.where("false"), URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(df, []).collect()} == {"allow"}


def test_hot_runs_and_urls_go_another_way(spark):
    """The shuffle beyond the broadcast's bound gives the same scores, with one URL in a third of all rows."""
    from inkfold.llm.queries import URL_RULES

    r = random.Random(8)
    rows = [(i, f"http://{r.choice('abc')}.{r.choice(['com/en', 'org/es', 'net/de', 'io/x'])}/{sentence(r.random(), 2).replace(' ', '-')}?q={r.randint(0, 9)}") for i in range(600)]
    rows += [(1000 + i, "ftp://same.io/y#z") for i in range(400)] + [(2000 + i, None) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = [sorted(map(str, url_filter.judge(df, URL_RULES, most_runs=n).collect())) for n in (0, 10**6)]
    assert got[0] == got[1]
    judged = url_filter.judge(df, URL_RULES).collect()
    urls = dict(rows)
    expected = brute.url_model([(urls[x.page_id] or "", x.verdict if x.rule else None) for x in judged])
    for x in judged:
        if x.rule is None:
            assert abs(x.score - expected[urls[x.page_id] or ""][0]) < 2e-6 and x.verdict == ("block" if x.score < x.threshold else "allow")


def test_joins_by_key_keep_every_row(spark):
    rows = [(7, i) for i in range(500)] + [(None, i) for i in range(300)] + [(i, i) for i in range(50)]
    left = common.stored(spark.createDataFrame(rows, "k long, v long"))
    right = spark.createDataFrame([(i, f"r{i}") for i in range(0, 40)], "k long, w string")
    got = Counter(map(tuple, common.with_key(left, right, ["k"]).collect()))
    assert got == Counter((k, v, f"r{k}" if k is not None and k < 40 else None) for k, v in rows)


def test_settled_removes_what_was_stored_inside(spark):
    inside = []

    def make():
        inside.append(common.stored(spark.range(5)))
        return inside[0].where("id > 1")

    out = common.settled(make, spark)
    assert out.count() == 3
    with pytest.raises(Exception):
        inside[0].count()


def test_small_and_stored(spark):
    df = spark.range(10)
    assert "broadcast" in common.small(df, 10)._jdf.queryExecution().toString().lower() and common.stored(df).count() == 10
