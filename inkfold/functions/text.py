"""Text expressions: tokens, paths, labels, URLs. All native columns but the full Unicode tokenizer."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER_ID = "filename-nfkd-lower-ascii-alpha-v1"


def _decomposed() -> tuple[str, str]:
    """Latin letters whose compatibility form is one ASCII letter with marks, and that letter."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", chr(code)))
        if len(plain) == 1 and plain.isascii() and plain.isalpha():
            source.append(chr(code))
            target.append(plain)
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _decomposed()


def fold_accents(text: Column) -> Column:
    """Latin letters without their marks; combining marks that stand alone vanish."""
    return F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), "[̀-ͯ]", "")


def tokenize(text: Column) -> Column:
    """Distinct runs of a-z after folding and lower-casing, in order. Anything else separates, digits too."""
    return F.array_distinct(F.filter(F.split(F.lower(fold_accents(text)), "[^a-z]+"), lambda t: t != ""))


def tokenize_filename(name: Column) -> Column:
    return tokenize(F.regexp_replace(name, r"(?i)\.svg$", ""))


def _nfkd_tokens(text: str | None) -> list[str] | None:
    if text is None:
        return None
    plain = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", text)).lower()
    return list(dict.fromkeys(t for t in re.split("[^a-z]+", plain) if t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokenize_nfkd(text: pd.Series) -> pd.Series:
    """tokenize() for every script: full compatibility decomposition, which Spark has no function for."""
    return text.map(_nfkd_tokens, na_action="ignore").map(lambda x: x if isinstance(x, list) else None)


def contains_all(tokens: Column, wanted: Column) -> Column:
    """Whether every wanted token is there; true if none is wanted."""
    return F.forall(wanted, lambda t: F.array_contains(tokens, t))


def join_path(*parts: Column) -> Column:
    """Non-empty parts joined by slashes."""
    return F.concat_ws("/", *[F.nullif(p, F.lit("")) for p in parts])


def path_parts(path: Column) -> Column:
    """struct(category, pack, name) of an icon's path."""
    seg = F.split(path, "/", -1)
    pack = F.when(F.size(seg) > 2, F.get(seg, F.lit(1))).otherwise(F.lit(""))
    name = F.regexp_replace(F.element_at(seg, -1), r"(?i)\.svg$", "")
    return F.struct(F.get(seg, F.lit(0)).alias("category"), pack.alias("pack"), name.alias("name"))


def display_label(name: Column) -> Column:
    """A name without its leading number, with spaces for dashes; the name itself if nothing is left."""
    shown = F.trim(F.regexp_replace(F.regexp_replace(name, r"^[0-9]+[-_]", ""), r"[-_]+", " "))
    return F.coalesce(F.nullif(shown, F.lit("")), name)


def confined_path(path: Column) -> Column:
    """Whether a path stays below its root and names an .svg file (in lower case) in some folder."""
    seg = F.split(path, "/", -1)
    ok = path.endswith(".svg") & ~F.contains(path, F.lit("\\")) & (F.size(seg) >= 2) & F.forall(seg, lambda s: ~s.isin("", ".", ".."))
    return F.coalesce(ok, F.lit(False))


def encode_component(text: Column) -> Column:
    """Percent-encoding that keeps A-Z a-z 0-9 - _ . ! ~ * ' ( )."""
    out = F.url_encode(text)
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def repository_slug(url: Column) -> Column:
    """owner/name of an https address on github.com with exactly two segments; null for any other."""
    slug = F.regexp_extract(url, r"^https://github\.com/([^/?#]+/[^/?#]+?)(?:\.git)?/?$", 1)
    return F.nullif(slug, F.lit(""))


def canonical_url(slug: Column, commit: Column, path: Column) -> Column:
    """The pinned CDN address of a file of a repository."""
    encoded = F.array_join(F.transform(F.split(path, "/", -1), encode_component), "/")
    return F.concat(F.lit("https://cdn.jsdelivr.net/gh/"), slug, F.lit("@"), commit, F.lit("/"), encoded)


def approved_url(url: Column, path: Column, slug: Column | None = None, commit: Column | None = None) -> Column:
    """Whether an icon's address is the canonical one of its source, or any pinned CDN address if none is given."""
    if slug is not None and commit is not None:
        return F.coalesce(confined_path(path) & (url == canonical_url(slug, commit, path)), F.lit(False))
    inner = F.regexp_extract(url, r"^https://cdn\.jsdelivr\.net/gh/[^/]+/[^/@]+@[0-9a-f]{40}/([^?#]+)$", 1)
    # a plus sign is no space in a path
    decoded = F.try_url_decode(F.replace(inner, F.lit("+"), F.lit("%2B")))
    return F.coalesce(confined_path(path) & (decoded == path), F.lit(False))


def format_bytes(n: Column) -> Column:
    """A size for people: whole bytes, else one decimal in KB, MB or GB of 1,024."""
    out = F.concat(F.format_string("%.0f", n.cast("double")), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.1f", n / F.lit(float(1024**power))), F.lit(f" {unit}"))).otherwise(out)
    return out


def xml_escape(text: Column) -> Column:
    out = text
    for char, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def short_number(x: Column) -> Column:
    """At most four decimals, without trailing zeros."""
    return F.regexp_replace(F.format_string("%.4f", x), r"\.?0+$", "")


def folder_of(url: Column) -> Column:
    """An address up to its last slash: the base of the files that lie beside it."""
    return F.regexp_replace(url, "[^/]*$", "")


def shard_urls(index_url: Column, shard: Column) -> Column:
    """struct(codes, meta): the addresses of a shard's two files beside its index document."""
    stem = F.concat(folder_of(index_url), F.lit("shard-"), shard.cast("string"))
    return F.struct(F.concat(stem, F.lit(".bin")).alias("codes"), F.concat(stem, F.lit(".meta.json.gz")).alias("meta"))


def merged(first: Column, second: Column) -> Column:
    """Both maps as one; where they share a key the second one's value counts."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(second), k)), second)
