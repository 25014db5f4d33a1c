"""Surrogates for personal data; DataFrame functions only.

Detection. One pattern finds e-mail addresses, IPv4 and IPv6 addresses, card and social-security numbers, phone numbers
(with a country code, or as ten digits in three groups), long hexadecimal secrets and names after one title or several: any
number of capitalised parts up to six, with hyphens, apostrophes, initials and particles. A full name that has been found
is looked for once more in its text, where it has no title; other names without one are not told from other words. The
pattern's parts need time and stack in proportion to a text, whatever it holds; an e-mail address has at most 64 characters
before its @ and 127 labels behind, and of more the last ones are taken. A text is cut at its matches, and put together
again with the surrogates in their places, so the rest never changes.

Surrogates. What identifies an entity is its letters (in lower case) and digits. Their sequence is encrypted by a
keyed Feistel walk that keeps the class of every character (digit, Latin, Cyrillic or Greek letter; octets of an
address keep their number of digits and stay below 256), which is a bijection on each format: different entities
get different surrogates, equal ones the same in every document and every spelling, and case, separators, top-level
domain and country code stay as they are. A card number whose last digit checks the others (Luhn) gets one that does. First
and family names are replaced each by itself, so "Mr. John Smith" and "Mr. Smith" still share a family name: syllables of
their script (Latin, Cyrillic or Greek; Latin for others) encode a keyed hash, and a first name ends as the titles' gender
has it, if they have one. A name in capitals stays in capitals, an initial is another initial, and particles stay.

Collision checks. The distinct entities and name parts, but for initials, are compared once: a surrogate that equals a real entity, or
another one's surrogate, is drawn again with a tweak until none does. Where real entities leave no room in their
format, addresses may change their number of digits and e-mail addresses get longer from the ``WIDER``th draw on. Those
are few; only documents that hold one are joined with the table of redrawn entities.

Cases: a null text stays null, an empty text and texts without entities stay as they are; repeated rows get equal
results; a null doc_id is treated like any other; an empty table gives an empty result; all columns of the input
come back, and the result columns replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sealed, small, stored

NEW = ["n_entities", "entity_types"]
#: From this draw on a surrogate may leave its format's width; the last draw before giving up.
WIDER, LAST = 4, 100

#: Titles by the gender they say.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"], "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"], "n": ["Dr", "Prof"]}
#: Words between the parts of a name that stay.
PARTICLES = "von van der den de del della di da dos du la le zu zur bin ibn al".split()
#: Syllables of names by script.
SYLLABLES = {"latin": "ba de fi go ku la me ni po ru sa te vi wo xa ze".split(), "cyrillic": "ба де фи го ку ла ме ни по ру са те ви во жа зе".split(), "greek": "βα δε φι γο κυ λα με νι πο ρυ σα τε θι ξο χα ζε".split()}
#: How first names end by script and gender.
ENDINGS = {"latin": {"f": "lia", "m": "rio", "n": "ren"}, "cyrillic": {"f": "лия", "m": "рий", "n": "рен"}, "greek": {"f": "λία", "m": "ριος", "n": "ρεν"}}
#: Letters that stay within their alphabet.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"]

_TITLE = "|".join(sorted((t for v in TITLES.values() for t in v), key=len, reverse=True))
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
_WHITE = r"[\s  ]{1,8}+"
#: One title or several, with what separates them from the name.
_TITLES = rf"(?:{_TITLE})(?:\.?{_WHITE}(?:{_TITLE})(?![\p{{L}}\p{{M}}]))*+\.?{_WHITE}"
#: A part of a name, and what stands between two of them: a blank within a line, after an initial with its point.
_PART = r"(?<![\p{L}\p{M}])\p{Lu}[\p{L}\p{M}]*+(?:['’\-‐‑]\p{Lu}[\p{L}\p{M}]*+)*+"
_GAP = rf"(?:(?<=[^\p{{L}}\p{{M}}]\p{{Lu}})\.)?[ \t  ]{{1,8}}+(?:(?:{'|'.join(PARTICLES)})[ \t  ]{{1,8}}+){{0,3}}+"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++){0,126}\.[A-Za-z]{2,}",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{2,6}}(?::{_HEX}){{1,5}})(?![0-9A-Za-z:])",
    "phone": r"\+[0-9]{1,3}[ .\-]?\(?[0-9]{2,4}\)?(?:[ .\-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![0-9\-.(])(?:\([0-9]{3}\) ?|[0-9]{3}[\-.])[0-9]{3}[\-.][0-9]{4}(?![0-9\-])|(?<![0-9\-.(])(?<![0-9] )[0-9]{3} [0-9]{3} [0-9]{4}(?![0-9\-]| [0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9\-])[0-9]{4}[ \-]?[0-9]{4}[ \-]?[0-9]{4}[ \-]?[0-9]{1,7}(?![0-9\-]*[0-9])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])",
    "name": rf"(?<![\p{{L}}\p{{M}}]){_TITLES}(?:(?:{'|'.join(PARTICLES)})[ \t]{{1,8}}+){{0,3}}+{_PART}(?:{_GAP}{_PART}){{0,5}}+",
}
KINDS = ["secret", "card", "ssn", "phone", "ipv6", "ip", "email"]
PATTERN = "|".join(PATTERNS.values())
#: What every text with an entity has: a quick look before the pattern.
HINT = rf"@|[0-9][0-9. ()\-]{{5,}}|[0-9a-fA-F]{{32}}|{_HEX}:{_HEX}:|(?:{_TITLE})\.?{_WHITE}\p{{L}}"
ROUNDS = 4


def entities(text: Column, pattern: Column) -> Column:
    """The matches in order."""
    return F.regexp_extract_all(text, pattern, F.lit(0))


def with_known_names(ents: Column) -> Column:
    """The pattern for a text with these entities: full names found in it are found without their titles as well."""
    full = F.filter(F.array_distinct(F.transform(F.filter(ents, lambda e: _title(e) != ""), _untitled)), lambda n: n.rlike(rf"^{_PART}{_GAP}{_PART}"))
    # a longer name is tried before one that it begins with
    longest = F.transform(F.sort_array(F.transform(full, lambda n: F.struct(F.length(n).alias("n"), n.alias("name"))), asc=False), lambda s: F.concat(F.lit("\\Q"), s["name"], F.lit("\\E")))
    more = F.concat(F.lit(rf"{PATTERN}|(?<![\p{{L}}\p{{M}}])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{M}])"))
    return F.when(F.size(full) > 0, more).otherwise(F.lit(PATTERN))


def source(e: Column, ents: Column) -> Column:
    """The entity that says what ``e`` is: for a name without a title the first one that has one, else itself."""
    titled = F.filter(ents, lambda t: (_title(t) != "") & (_untitled(t) == e))
    return F.when((_title(e) == "") & (F.size(titled) > 0), F.get(titled, F.lit(0))).otherwise(e)


def entity_type(e: Column) -> Column:
    out = F.lit("name")
    for kind in KINDS:
        out = F.when(e.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def canonical(e: Column, kind: Column) -> Column:
    """What equal entities share: letters in lower case and digits; octets of an address stay apart."""
    return F.when(kind == "ip", e).otherwise(F.regexp_replace(F.lower(e), r"[^\p{L}\p{N}]+", ""))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _number(stream: Column, i: Column) -> Column:
    """A number below 65536 for place ``i``, from a stream of 128 hexadecimal digits (read again from its start if short)."""
    return F.conv(F.substring(stream, F.pmod(i, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _shift(c: Column, by: Column, hexadecimal: Column) -> Column:
    """The character ``by`` places on in its alphabet; others stay."""
    out = c
    for letters in ALPHABETS:
        out = F.when(F.instr(F.lit(letters), c) > 0, F.substring(F.lit(letters), F.pmod(F.instr(F.lit(letters), c) - 1 + by, F.lit(len(letters))) + 1, F.lit(1))).otherwise(out)
    of_hex = F.lit("0123456789abcdef")
    return F.when(hexadecimal, F.substring(of_hex, F.pmod(F.instr(of_hex, c) - 1 + by, F.lit(16)) + 1, F.lit(1))).otherwise(out)


def _shift_octet(tweak: Column):
    def shift(c: Column, by: Column) -> Column:
        n = c.cast("int")
        same = F.when(n >= 100, F.pmod(n - 100 + by, F.lit(156)) + 100).when(n >= 10, F.pmod(n - 10 + by, F.lit(90)) + 10).otherwise(F.pmod(n + by, F.lit(10)))
        return F.when(tweak >= WIDER, F.pmod(n + by, F.lit(256))).otherwise(same).cast("string")

    return shift


def _walk(units: Column, tweak: Column, key: str, shift) -> Column:
    """The Feistel walk over an array of characters or octets: each half moves by a hash of the other."""
    cut = F.greatest(F.floor(F.size(units) / 2).cast("int"), F.lit(1))
    start = F.struct(F.slice(units, F.lit(1), cut).alias("l"), F.slice(units, cut + 1, F.size(units)).alias("r"))

    def moved(half: Column, other: Column, turn: Column, side: str) -> Column:
        stream = F.sha2(F.concat_ws(":", F.lit(key), tweak.cast("string"), turn.cast("string"), F.lit(side), F.array_join(other, ".")).cast("binary"), 512)
        return _let(stream, lambda h: F.transform(half, lambda c, k: _let(_number(h, k), lambda by: shift(c, by))))

    def turn(s: Column, i: Column) -> Column:
        return _let(moved(s["l"], s["r"], i, "l"), lambda l: F.struct(l.alias("l"), moved(s["r"], l, i, "r").alias("r")))

    return _let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn), lambda s: F.concat(s["l"], s["r"]))


def _dressed(e: Column, letters: Column) -> Column:
    """The characters of ``letters`` in the places of the letters and digits of ``e``, in its case."""

    def step(s: Column, c: Column) -> Column:
        new = F.element_at(s["left"], 1)
        put = F.when(c.rlike(r"^\p{Lu}$"), F.upper(new)).otherwise(new)
        used = F.struct(F.concat(s["out"], put).alias("out"), F.slice(s["left"], F.lit(2), F.size(s["left"])).alias("left"))
        return F.when(c.rlike(r"^[\p{L}\p{N}]$"), used).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["left"].alias("left")))

    return F.aggregate(F.split(e, ""), F.struct(F.lit("").alias("out"), letters.alias("left")), step)["out"]


def _syllables(digits: Column, script: str) -> Column:
    """A syllable for each hexadecimal digit."""
    choices = F.array(*map(F.lit, SYLLABLES[script]))
    return F.array_join(F.transform(F.split(digits, ""), lambda d: F.element_at(choices, F.conv(d, 16, 10).cast("int") + 1)), "")


def _title(e: Column) -> Column:
    """The titles of a name with what separates them, empty for other entities."""
    return F.regexp_extract(e, rf"^{_TITLES}", 0)


def _untitled(e: Column) -> Column:
    return F.regexp_replace(e, rf"^{_TITLES}", "")


def _gender(e: Column) -> Column:
    """f, m or n, by the first of a name's titles that says one."""
    said = lambda g: F.regexp_instr(_title(e), F.lit(rf"(?<![\p{{L}}\p{{M}}])(?:{'|'.join(TITLES[g])})(?![\p{{L}}\p{{M}}])"))
    f, m = said("f"), said("m")
    return F.when((f > 0) & ((m == 0) | (f < m)), F.lit("f")).when(m > 0, F.lit("m")).otherwise(F.lit("n"))


def pieces(e: Column, kind: Column) -> Column:
    """array<struct<kind, e>>: what gets a surrogate of its own; of a name its first and family names, else the whole."""
    words = F.regexp_extract_all(_untitled(e), F.lit(_PART), F.lit(0))
    place = lambda w, i, ws: F.when(F.length(w) == 1, F.lit("initial")).when(i < F.size(ws) - 1, F.concat(F.lit("first "), _gender(e))).otherwise(F.lit("family"))
    named = lambda ws: F.transform(ws, lambda w, i: F.struct(place(w, i, ws).alias("kind"), w.alias("e")))
    return F.when(kind == "name", _let(words, named)).otherwise(F.array(F.struct(kind.alias("kind"), e.alias("e"))))


def _named(e: Column, parts: Column) -> Column:
    """A name with other parts in the places of its own; titles, blanks and particles stay."""
    return F.concat(_title(e), _rebuilt(_untitled(e), parts, F.lit(_PART)))


def _luhn(digits: Column) -> Column:
    """The sum of digits that is a multiple of ten where the last one checks the others."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(digits, lambda d, i: F.when(F.pmod(F.size(digits) - i, F.lit(2)) == 0, doubled(d.try_cast("int"))).otherwise(d.try_cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _name(part: Column, kind: Column, tweak: Column, key: str) -> Column:
    """The surrogate of a first or family name."""
    draw = F.md5(F.concat_ws("\x00", F.lit(key), tweak.cast("string"), kind, F.lower(part)).cast("binary"))
    out = None
    for script, name in (("cyrillic", "IsCyrillic"), ("greek", "IsGreek"), ("latin", None)):
        first = lambda g: F.concat(_syllables(F.substring(draw, 1, 7), script), F.lit(ENDINGS[script][g]))  # noqa: E731, B023
        made = _syllables(F.substring(draw, 1, 8), script)
        for g in ENDINGS[script]:
            made = F.when(kind == f"first {g}", first(g)).otherwise(made)
        fits = part.rlike(rf"\p{{{name}}}") if name else F.lit(True)
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return _let(out, lambda s: F.when(part == F.upper(part), F.upper(s)).otherwise(F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 64))))


def surrogate(e: Column, kind: Column, tweak: Column, key: str) -> Column:
    """The surrogate of a piece: a function of the key, the tweak and what equal pieces share."""

    def plain(x: Column) -> Column:
        bare = F.split(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", ""), "")
        free = lambda units: _walk(units, tweak, key, lambda c, by: _shift(c, by, kind.isin("secret", "ipv6")))
        check = lambda units: F.concat(units, F.array(F.pmod(-_luhn(F.concat(units, F.array(F.lit("0")))), F.lit(10)).cast("string")))
        checked = lambda units: _let(free(F.slice(units, F.lit(1), F.size(units) - 1)), check)
        walked = lambda units: F.when((kind == "card") & (F.pmod(_luhn(units), F.lit(10)) == 0), checked(units)).otherwise(free(units))
        # a secret may be very long, but has one case and nothing else in it
        secret = _let(F.array_join(_let(bare, walked), ""), lambda s: F.when(x == F.lower(x), s).otherwise(F.upper(s)))
        return F.when(kind == "secret", secret).otherwise(_dressed(x, _let(bare, walked)))

    # what stays: the country code and the top-level domain
    code = F.when(kind == "phone", F.regexp_extract(e, r"^\+[0-9]{1,3}(?=[ .\-(])", 0)).otherwise(F.lit(""))
    domain = F.when(kind == "email", F.regexp_extract(e, r"\.[A-Za-z]+$", 0)).otherwise(F.lit(""))
    parts = F.struct(code.alias("code"), domain.alias("domain"))
    core = lambda p: F.substring(e, F.length(p["code"]) + 1, F.length(e) - F.length(p["code"]) - F.length(p["domain"]))
    longer = F.when((kind == "email") & (tweak >= WIDER), _syllables(F.substring(F.md5(F.concat_ws("\x00", F.lit(key), tweak.cast("string"), F.lower(e)).cast("binary")), 1, 8), "latin")).otherwise(F.lit(""))
    other = _let(parts, lambda p: F.concat(p["code"], longer, _let(core(p), plain), p["domain"]))
    octets = F.array_join(_let(F.split(e, r"\."), lambda units: _walk(units, tweak, key, _shift_octet(tweak))), ".")
    return F.when(kind == "ip", octets).when(kind.startswith("first ") | (kind == "family"), _name(e, kind, tweak, key)).otherwise(other)


def _replaced(e: Column, said: Column, key: str) -> Column:
    """The first surrogate of an entity whose type isn't known yet; ``said`` is its source()."""

    def whole(kind: Column) -> Column:
        parts = F.transform(pieces(said, kind), lambda p: surrogate(p["e"], p["kind"], F.lit(0), key))
        return F.when(kind == "name", _named(e, parts)).otherwise(surrogate(e, kind, F.lit(0), key))

    return _let(entity_type(e), whole)


def _rebuilt(text: Column, new: Column, pattern: Column) -> Column:
    """``text`` with the matches of a pattern replaced by ``new`` in order."""
    between = F.split(text, pattern, -1)
    return F.array_join(F.flatten(F.zip_with(between, new, lambda b, n: F.array(b, F.coalesce(n, F.lit(""))))), "")


def redrawn(found: DataFrame, key: str) -> DataFrame:
    """(r_kind, r_c, tweak) of the pieces whose first surrogate collides; empty where none does.

    ``found`` has the distinct (e, kind). Each round keeps the smallest piece on a surrogate that several share
    and draws the others again; nobody may take the place of a real one.
    """
    own = found.select("kind", "e", canonical(F.col("e"), F.col("kind")).alias("c"))
    own = stored(own.groupBy("kind", "c").agg(F.min("e").alias("e")).withColumn("tweak", F.lit(0)))
    real = own.select("kind", F.col("c").alias("s"))
    for _ in range(LAST):
        drawn = own.withColumn("made", surrogate(F.col("e"), F.col("kind"), F.col("tweak"), key))
        drawn = stored(drawn.withColumn("s", canonical(F.col("made"), F.col("kind"))))
        several = drawn.groupBy("kind", "s").agg(F.min("c").alias("first"), F.count("*").alias("n")).where("n > 1").select("kind", "s", "first")
        late = drawn.join(several, ["kind", "s"]).where(F.col("c") != F.col("first")).select("kind", "c")
        taken = drawn.join(real, ["kind", "s"], "left_semi").select("kind", "c")
        bad = stored(late.union(taken).distinct())
        if bad.isEmpty():
            return own.where("tweak > 0").select(F.col("kind").alias("r_kind"), F.col("c").alias("r_c"), "tweak")
        own = stored(own.join(bad.withColumn("again", F.lit(1)), ["kind", "c"], "left").select("kind", "c", "e", (F.col("tweak") + F.coalesce("again", F.lit(0))).alias("tweak")))
    raise ValueError("some format of personal data has no room for surrogates")


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text``, the number of entities found and their sorted types."""
    if not key:
        raise ValueError("a key is needed: surrogates without one can be guessed")
    sealed = Sealed(docs)
    text = sealed["text"]
    # most texts hold no digit next to another, no @ and no title: they skip the pattern
    none = F.array().cast("array<string>")
    marked = sealed.df.withColumn("ents", F.coalesce(F.when(text.rlike(HINT), entities(text, F.lit(PATTERN))), none))
    marked = marked.withColumn("pattern", F.when(F.exists("ents", lambda e: _title(e) != ""), with_known_names(F.col("ents"))).otherwise(F.lit(PATTERN)))
    marked = marked.withColumn("ents", F.when(F.col("pattern") != PATTERN, entities(text, F.col("pattern"))).otherwise(F.col("ents")))
    marked = marked.withColumn("said", F.transform("ents", lambda e: F.when(F.col("pattern") != PATTERN, source(e, F.col("ents"))).otherwise(e)))
    found = marked.select(F.explode(F.array_distinct("said")).alias("e")).distinct()
    found = found.select(F.explode(pieces(F.col("e"), entity_type(F.col("e")))).alias("p")).select("p.kind", "p.e").where("kind <> 'initial'").distinct()
    again = stored(redrawn(stored(found), key))

    typed = marked.withColumn("n_entities", F.size("ents").cast("long")).withColumn("entity_types", F.array_sort(F.array_distinct(F.transform("ents", entity_type))))

    def result(rows: DataFrame, new: Column) -> DataFrame:
        made = F.when(F.size("ents") > 0, _rebuilt(text, new, F.col("pattern"))).otherwise(text)
        where = [c.lower() for c in docs.columns].index("text")
        return rows.select(*[(made if c == f"in {where}" else F.col(c)).alias(c) for c in sealed.df.columns], *NEW).select(*sealed.back(NEW), *NEW)

    if again.isEmpty():
        return result(typed, F.zip_with("ents", "said", lambda e, said: _replaced(e, said, key)))
    # documents that hold a redrawn piece are put together from joined surrogates
    some = stored(typed.where(F.size("ents") > 0).withColumn("row", F.monotonically_increasing_id()))
    rows = some.unionByName(typed.where(F.size("ents") == 0).withColumn("row", F.lit(-1).cast("long")))
    each = some.select("row", F.posexplode(F.arrays_zip("ents", "said")).alias("at", "x")).select("row", "at", F.col("x.ents").alias("own"), F.col("x.said").alias("said"))
    each = each.select("row", "at", "own", F.posexplode(pieces(F.col("said"), entity_type(F.col("said")))).alias("k", "p")).select("row", "at", "own", "k", "p.kind", "p.e")
    each = each.join(small(again), (F.col("kind") == F.col("r_kind")) & (canonical(F.col("e"), F.col("kind")) == F.col("r_c")), "left")
    drawn = surrogate(F.col("e"), F.col("kind"), F.coalesce("tweak", F.lit(0)), key)
    part = F.col("kind").startswith("first ") | F.col("kind").isin("family", "initial")
    each = each.select("row", "at", "tweak", "own", part.alias("named"), F.struct("k", drawn.alias("s")).alias("made"))
    whole = each.groupBy("row", "at").agg(F.max("tweak").alias("most"), F.first("own").alias("own"), F.first("named").alias("named"), F.array_sort(F.collect_list("made")).alias("parts")).where("most > 0")
    new = F.when(F.col("named"), _named(F.col("own"), F.transform("parts", lambda m: m["s"]))).otherwise(F.col("parts")[0]["s"])
    whole = whole.select(F.col("row").alias("x_row"), F.struct("at", new.alias("s")).alias("x"))
    fixes = whole.groupBy("x_row").agg(F.map_from_entries(F.collect_list("x")).alias("fixes"))
    joined = rows.join(fixes, F.col("row") == F.col("x_row"), "left").withColumn("each", F.arrays_zip("ents", "said"))
    return result(joined, F.transform("each", lambda x, i: F.coalesce(F.try_element_at("fixes", i), _replaced(x["ents"], x["said"], key))))
