"""Scalar text, URL and number functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: field caps and the white-space class (wider than Java's \s)
NAME_CAP, TITLE_CAP, SUMMARY_CAP, SLUG_CAP = 120, 200, 500, 64
SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def collapse_whitespace(text: Column) -> Column:
    """Runs of white space become one space; none at either end."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def order_key(text: Column) -> Column:
    """A key that sorts by UTF-16 code units, as documents are ordered; plain strings sort by code points."""
    return F.encode(text, "UTF-16BE")


def utf16_left(text: Column, n: int) -> Column:
    """The first n UTF-16 units; the first half of a pair at the end is left out."""
    units = F.encode(text, "UTF-16BE")
    last = F.hex(F.substring(units, 2 * n - 1, 1))
    short = F.decode(F.substring(units, F.lit(1), F.when(last.between("D8", "DB"), 2 * n - 2).otherwise(2 * n)), "UTF-16BE")
    return F.when(utf16_length(text) == F.length(text), F.substring(text, 1, n)).otherwise(short)


def bounded_field(text: Column, cap: int) -> Column:
    """The collapsed text, or null if blank or over the cap. Caps count UTF-16 units."""
    clean = collapse_whitespace(text)
    return F.when(utf16_length(clean).between(1, cap), clean)


def trim_summary(text: Column, cap: int = SUMMARY_CAP) -> Column:
    """A text within the cap as it is; else cut behind the last full sentence of the window, or hard where it has none."""
    clean = collapse_whitespace(text)
    window = utf16_left(clean, cap)
    sentence = F.regexp_extract(window, r"(?s)^(.+[.!?]) ", 1)
    ends = F.substring(window, -1, 1).isin(".", "!", "?")
    return F.when(utf16_length(clean) <= cap, clean).when(sentence != "", sentence).when(ends, window).otherwise(F.rtrim(window))


def slugify_ascii(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9 joined by hyphens, cut to the cap; null if nothing is left. Texts with accents go
    through ``slugify``."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    slug = F.regexp_replace(F.substring(slug, 1, SLUG_CAP), "-+$", "")
    return F.nullif(slug, F.lit(""))


@F.pandas_udf(StringType())
def _decompose(texts):
    import unicodedata

    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not "̀" <= c <= "ͯ"))


def slugify(text: Column) -> Column:
    return slugify_ascii(F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(_decompose(text)))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def pathname(url: Column) -> Column:
    """The path of a URL, or of one that is relative to a site's root."""
    relative = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "^/+", ""))
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), url_path(url)).otherwise(relative)


def path_key(url: Column) -> Column:
    """The lower-case path without one trailing slash; the root is '/'."""
    path = F.lower(pathname(url))
    return F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/$", ""))


def segments(url: Column) -> Column:
    return F.filter(F.split(pathname(url), "/"), lambda s: s != "")


def id_from_path(url: Column) -> Column:
    """The slug of the last path segment, or null."""
    return slugify_ascii(F.try_element_at(segments(url), F.lit(-1)))


def docs_slug(url: Column, docs_host: str) -> Column:
    """The slug of a URL of the docs host with one path segment, else null."""
    return F.when((url_host(url) == docs_host) & (F.size(segments(url)) == 1), id_from_path(url))


def canonical_url(url: Column, hosts: list[str]) -> Column:
    """https, an approved host, at most 300 characters, no query, fragment, port or credentials."""
    return F.coalesce(url.rlike(r"\Ahttps://[^/?#@:\s]+(/[^?#\s]*)?\z") & url_host(url).isin(*hosts) & (F.length(url) <= 300), F.lit(False))


def round_cents(value: Column) -> Column:
    """Half up on doubles: floor(100 x + 0.5) / 100."""
    return F.floor(value * F.lit(100.0) + F.lit(0.5)).cast("double") / F.lit(100.0)


def id_slug(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A[a-z0-9]+(-[a-z0-9]+)*\z") & (F.length(text) <= SLUG_CAP), F.lit(False))


def non_blank(text: Column, cap: int) -> Column:
    return F.coalesce((utf16_length(text) <= cap) & (collapse_whitespace(text) != ""), F.lit(False))


def unique_list(items: Column, least: int = 1) -> Column:
    return F.coalesce((F.size(items) >= least) & (F.size(F.array_distinct(items)) == F.size(items)), F.lit(False))


def utc_instant(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?Z\z") & F.try_to_timestamp(text).isNotNull(), F.lit(False))


def issue_path(collection: str, index: Column, field: str) -> Column:
    """a[2].b"""
    return F.format_string(f"{collection}[%d].{field}", index)


def is_success(correct: Column, total: Column, threshold: float = 0.8) -> Column:
    return F.coalesce(F.try_divide(correct, total) >= threshold, F.lit(False))
