"""Text functions as Spark columns: folding, tokens, slugs, names, URLs, HTML normalisation, highlighting, cropping."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Accented letters and what they fold to.
ACCENTED = "àáâãäåāăąçćčďèéêëēęěğìíîïīłñńňòóôõöøōőŕřśšşťùúûüūůűýÿźžż"
FOLDED = "aaaaaaaaacccdeeeeeeegiiiiilnnnoooooooorrssstuuuuuuuyyzzz"
#: Fixed values of slugs: umlauts become two letters.
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))
#: Block-level tags whose edges separate words.
BLOCK_TAGS = ("p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "tr", "table", "article", "section")
CONTENT_BYTES = 60_000


def fold(c: Column) -> Column:
    """Lower case without accents; ß is ss."""
    return F.replace(F.translate(F.lower(c), ACCENTED, FOLDED), F.lit("ß"), F.lit("ss"))


def folded(word: str) -> str:
    """What fold() makes of a word that the driver holds."""
    return word.lower().translate(str.maketrans(ACCENTED, FOLDED)).replace("ß", "ss")


def tokens(c: Column) -> Column:
    """Folded runs of letters and digits, in order."""
    return F.filter(F.split(fold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def slugify(c: Column) -> Column:
    out = F.trim(F.lower(c))
    for a, b in UMLAUTS:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(F.translate(out, ACCENTED, FOLDED), "[^a-z0-9]+", "-")
    return F.rtrim(F.substring(F.btrim(out, F.lit("-")), 1, 64), F.lit("-"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def humanize_filename(path: Column) -> Column:
    stem = F.regexp_replace(basename(path), r"\.[^./]+$", "")
    return F.initcap(F.trim(F.regexp_replace(F.lower(stem), "[-_]+", " ")))


def strip_host(url: Column) -> Column:
    """Path and query with a leading slash."""
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^([a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*", ""), "#.*$", "")
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def pretty_url(url: Column, kind: Column, home: str = "Home") -> Column:
    """What is shown for a URL: decoded; of a file the last segment; the root has a name."""
    plain = F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)  # a plus sign is no space in a path
    return F.when(kind == "file", basename(plain)).when(plain == "/", F.lit(home)).otherwise(plain)


def page_url(alias: Column, suffix: Column) -> Column:
    return F.when(F.coalesce(alias, F.lit("")).isin("", "index", "/"), F.lit("/")).otherwise(F.concat(F.lit("/"), alias, F.coalesce(suffix, F.lit(".html"))))


def doc_id(uuid: Column, path: Column) -> Column:
    """file-<uuid in hex> if there is a uuid of 16 bytes, else file-path-<md5 of the path>."""
    return F.when(F.octet_length(uuid) == 16, F.concat(F.lit("file-"), F.lower(F.hex(uuid)))).otherwise(F.concat(F.lit("file-path-"), F.md5(path)))


def without_markup(c: Column, keep_script_text: bool = False) -> Column:
    """Serialised blocks, script and style bodies, comments and tags go; edges of block tags become spaces."""
    out = F.regexp_replace(c, r"a:\d+:\{[^{}]*(\{[^{}]*\}[^{}]*)*\}", " ")
    if not keep_script_text:
        out = F.regexp_replace(out, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(out, rf"(?i)</?({'|'.join(BLOCK_TAGS)})\b[^>]*>", " ")
    return F.regexp_replace(out, "<[^>]*>", "")


#: Character references: numbers, and names of HTML 5. One without its semicolon is text, as where a title was cut off.
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """Character references; Spark has no such function."""

    def meant(m: re.Match) -> str:
        return html.unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0])

    return s.map(lambda t: _REFERENCE.sub(meant, t), na_action="ignore")


def squeeze(c: Column) -> Column:
    """Invisible marks go, white space collapses."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[\u00ad\u200b\ufeff]", ""), r"[\s\u00a0]+", " "))


def cut_bytes(c: Column, n: int = CONTENT_BYTES) -> Column:
    """At most n bytes of UTF-8, never part of a character."""
    raw = F.encode(c, "UTF-8")
    cut = F.rtrim(F.make_valid_utf8(F.substring(raw, 1, n).cast("string")), F.lit("\ufffd"))
    return F.when(F.octet_length(c) <= n, c).otherwise(cut)


def normalize(c: Column, keep_script_text: bool = False, most_bytes: int | None = CONTENT_BYTES) -> Column:
    """Plain text of markup: what the index asks for is cut at most_bytes, None leaves it whole."""
    whole = squeeze(unescape(without_markup(F.make_valid_utf8(F.coalesce(c, F.lit(""))), keep_script_text)))
    return whole if most_bytes is None else cut_bytes(whole, most_bytes)


def headline_text(c: Column) -> Column:
    """A headline without tags: of a serialised one (a:2:{s:5:"value";s:3:"...";...}) its value, of others all of it."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    value = F.regexp_extract(raw, r's:5:"value";s:\d+:"(.*?)";(?:[sibdNa]|\})', 1)
    return F.regexp_replace(F.when(raw.startswith("a:") & raw.contains('s:5:"value";s:'), value).otherwise(raw), "<[^>]*>", "")


def serialised_ints(c: Column) -> Column:
    """The positive integers of a serialised list of integers or of digits in strings, in order; of anything else none."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r'(?:i:\d+|s:\d+:"[^"]*");(?:i:|s:\d+:")(-?\d+)"?;'), 1)
    numbers = F.filter(F.transform(found, lambda x: x.cast("int")), lambda x: x > 0)
    return F.when(F.coalesce(c, F.lit("")).startswith("a:"), numbers).otherwise(F.array().cast("array<int>"))


def parsed_date(c: Column) -> Column:
    """A date written d.m.Y, or as an ISO date or timestamp, or as Unix seconds; null for others."""
    iso = F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")))
    seconds = F.when(c.rlike(r"^\d{9,11}$"), F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c.cast("long") / 86400).cast("int")))
    return F.coalesce(F.to_date(F.try_to_timestamp(c, F.lit("d.M.yyyy"))), iso, seconds)


def shown_date(c: Column) -> Column:
    return F.date_format(c, "dd.MM.yyyy")


def highlight(text: Column, terms: list[str]) -> Column:
    """Whole words of `terms`, whatever their case, in <mark>."""
    if not terms:
        return text
    words = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}])({words})(?![\p{{L}}\p{{N}}])", "<mark>$1</mark>")


def mark_words(text: Column, meant: Callable[[Column], Column]) -> Column:
    """Words whose folded form is `meant` (a condition on a token), in <mark>: other spellings of a hit are marked too."""
    runs = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.when(F.coalesce(meant(fold(r)), F.lit(False)), F.concat(F.lit("<mark>"), r, F.lit("</mark>"))).otherwise(r)), "")


def crop(text: Column, terms: list[str] | Callable[[Column], Column], width: int = 30) -> Column:
    """`width` words around the first of `terms` (else the first words), with … where words were left out.

    terms: folded words, or a condition on a folded word.
    """
    meant = terms if callable(terms) else lambda w: w.isin(terms)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    folded = F.transform(words, lambda w: F.regexp_replace(fold(w), r"[^\p{L}\p{N}]+", ""))
    at = F.coalesce(F.array_min(F.filter(F.transform(folded, lambda w, i: F.when(meant(w), i)), lambda i: i.isNotNull())), F.lit(0))
    start = F.greatest(at - width // 2, F.lit(0))
    body = F.array_join(F.slice(words, start + 1, width), " ")
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(F.size(words) > start + width, "…").otherwise(""))


def unmark(c: Column) -> Column:
    """Escape a highlighted text for display, then bring its marks back."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("&lt;mark&gt;", "<mark>"), ("&lt;/mark&gt;", "</mark>")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: SQL functions of this module: name -> parameter and body.
SQL_FUNCTIONS = {
    "fold_text": f"replace(translate(lower(s), '{ACCENTED}', '{FOLDED}'), 'ß', 'ss')",
    "slugify": "rtrim('-', substring(trim(BOTH '-' FROM regexp_replace(translate({}, '{}', '{}'), '[^a-z0-9]+', '-')), 1, 64))",
    "file_extension": r"lower(regexp_extract(s, r'\.([^./]+)$', 1))",
    "plain_text": r"trim(regexp_replace(regexp_replace(s, '<[^>]*>', ' '), r'\s+', ' '))",
}


def register(spark: SparkSession) -> list[str]:
    """Makes the SQL functions known to the session, as expressions that the optimiser sees through; returns their names."""
    lowered = "trim(lower(s))"
    for a, b in UMLAUTS:
        lowered = f"replace({lowered}, '{a}', '{b}')"
    for name, body in SQL_FUNCTIONS.items():
        body = body.format(lowered, ACCENTED, FOLDED) if name == "slugify" else body
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS STRING RETURN {body}")
    return sorted(SQL_FUNCTIONS)
