import pytest
from pyspark.sql import functions as F

from inkfold.functions import text
from inkfold.operators import lexical

FOOD, NATURE, UI = "Food, Drink & Hospitality", "Nature, Animals & Environment", "UI"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("value, expected", [
    ("332169-star", ["star"]), ("Café_Crème", ["cafe", "creme"]), ("straße", ["stra", "e"]), ("ł-a", ["a"]), ("a a b", ["a", "b"]), ("", []), ("東京", []), ("été", ["ete"]),
])
def test_tokenize(spark, value, expected):
    assert one(spark, text.tokenize(F.lit(value))) == expected
    assert one(spark, text.tokenize_nfkd(F.lit(value))) == expected


def test_tokenize_compatibility_forms(spark):
    assert one(spark, text.tokenize_nfkd(F.lit("ﬁne ①"))) == ["fine"]
    assert one(spark, text.tokenize_nfkd(F.lit(None).cast("string"))) is None
    assert one(spark, text.tokenize_filename(F.lit("Cat.SVG"))) == ["cat"]


@pytest.mark.parametrize("path, ok", [("a/b.svg", True), ("a/b.SVG", False), ("b.svg", False), ("a/../b.svg", False), ("a//b.svg", False), ("a\\c/b.svg", False), (None, False), ("./b.svg", False)])
def test_confined_path(spark, path, ok):
    assert one(spark, text.confined_path(F.lit(path).cast("string"))) is ok


def test_urls(spark):
    assert one(spark, text.encode_component(F.lit("a b,&c!'()*~é"))) == "a%20b%2C%26c!'()*~%C3%A9"
    for url, slug in [("https://github.com/o/r.git", "o/r"), ("https://github.com/o/r/", "o/r"), ("http://github.com/o/r", None), ("https://github.com/o", None), ("https://evil.com/o/r", None), ("https://github.com/o/r?x", None)]:
        assert one(spark, text.repository_slug(F.lit(url))) == slug
    c, p = "b" * 40, "a b/c+d.svg"
    url = one(spark, text.canonical_url(F.lit("o/r"), F.lit(c), F.lit(p)))
    assert url == f"https://cdn.jsdelivr.net/gh/o/r@{c}/a%20b/c%2Bd.svg"
    assert one(spark, text.approved_url(F.lit(url), F.lit(p), F.lit("o/r"), F.lit(c)))
    assert one(spark, text.approved_url(F.lit(url), F.lit(p))) and not one(spark, text.approved_url(F.lit(url), F.lit("x/y.svg")))
    assert not one(spark, text.approved_url(F.lit(url.replace("cdn", "evil")), F.lit(p)))


def test_small_functions(spark):
    assert [one(spark, text.format_bytes(F.lit(n))) for n in (0, 1023, 1024, 1536, 5 * 1024**2)] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 MB"]
    assert [one(spark, text.short_number(F.lit(x))) for x in (1.0, 1.5, 1.23456, 100.0)] == ["1", "1.5", "1.2346", "100"]
    assert one(spark, text.display_label(F.lit("12_a-b_c"))) == "a b c" and one(spark, text.display_label(F.lit("12-"))) == "12-"
    assert one(spark, text.xml_escape(F.lit('<a b="c">&'))) == "&lt;a b=&quot;c&quot;&gt;&amp;"
    assert tuple(one(spark, text.path_parts(F.lit("A/b/c/1-x.SVG")))) == ("A", "b", "1-x") and tuple(one(spark, text.path_parts(F.lit("A/x.svg")))) == ("A", "", "x")


def corpus(spark, names):
    rows = spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(names)], "icon_id long, category string, filename string")
    return rows.select("icon_id", "category", text.tokenize_filename(F.col("filename")).alias("tokens"))


def ranked(spark, names, aliases, name="thing", preferred=(), penalties=(), excluded=()):
    phrases = lexical.phrases_of(spark.createDataFrame([(name,)], "class string"), spark.createDataFrame([(name, a, i + 1) for i, a in enumerate(aliases)], "class string, phrase string, phrase_index int"))
    out = lexical.score_candidates(
        phrases, corpus(spark, names), spark.createDataFrame([(name, c) for c in preferred], "class string, category string"),
        spark.createDataFrame(list(penalties), "category string, points int"), spark.createDataFrame([(name, t) for t in excluded], "class string, token string"),
    )
    return [(names[r.icon_id][1], r.score) for r in out.orderBy("rank").collect()]


def test_candidates(spark):
    assert ranked(spark, [(FOOD, "bottle-cap.svg"), (FOOD, "bottle.svg")], ["bottle cap"], "bottlecap") == [("bottle-cap.svg", 120)]
    assert ranked(spark, [(UI, "cloud-upload.svg"), (NATURE, "cloud.svg")], [], "cloud", [NATURE], [(UI, -30)]) == [("cloud.svg", 160), ("cloud-upload.svg", 80)]
    assert [n for n, _ in ranked(spark, [(UI, "badminton-racket.svg"), (UI, "tennis-racket.svg")], ["racket", "tennis racket"])] == ["tennis-racket.svg", "badminton-racket.svg"]
    assert ranked(spark, [(UI, "camera-off.svg"), (UI, "camera.svg")], [], "camera") == [("camera.svg", 130), ("camera-off.svg", 110)]
    assert [n for n, _ in ranked(spark, [(UI, "ship.svg"), (UI, "battleship.svg")], ["battleship", "ship"])] == ["battleship.svg", "ship.svg"]
    assert [n for n, _ in ranked(spark, [(UI, "playground.svg"), (UI, "swingset-playground.svg"), (UI, "code-playground.svg")], [], "playground", excluded=["code", "swingset"])] == ["playground.svg"]
    assert ranked(spark, [(UI, "a.svg")], ["???"], "???") == []


def test_corpus_paths_and_selection(spark):
    categories = spark.createDataFrame([(0, "Travel & Transportation"), (1, NATURE)], "category_id int, name string")
    packs = spark.createDataFrame([(0, 0, "transport-vectors"), (1, 1, "animal-vectors"), (2, 0, "")], "pack_id int, category_id int, pack string")
    icons = spark.createDataFrame([(0, 0, "ship.svg"), (1, 0, "car.svg"), (2, 1, "cat.svg"), (3, 2, "loose.svg")], "icon_id long, pack_id int, filename string")
    paths = {r.icon_id: r.path for r in lexical.icon_paths(icons, packs, categories).collect()}
    assert paths[3] == "Travel & Transportation/loose.svg" and paths[2] == f"{NATURE}/animal-vectors/cat.svg"
    pick = lambda n: sorted(r.icon_id for r in lexical.first_per_pack(icons, n).collect())
    assert pick(1) == [0, 2, 3] and pick(2) == [0, 1, 2, 3]
    lists = spark.createDataFrame([([3, 0],), ([2, 0],), ([],)], "candidate_ids array<long>")
    assert [r.icon_id for r in lexical.candidate_union(lists).collect()] == [0, 2, 3]
    tree = lexical.icons_of_tree(spark.createDataFrame([(0, "x.svg"), (1, "A/b/c/y.SVG"), (2, "A/z.png")], "seq int, path string")).orderBy("seq").collect()
    assert [(r.category, r.pack, r.filename) for r in tree] == [("", "", "x.svg"), ("A", "b/c", "y.SVG")]
