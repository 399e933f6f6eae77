"""Text functions as column expressions."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NUMERIC = r"^[+-]?(?=\d|\.\d)\d*(\.\d*)?([Ee]([+-]?\d+))?$"
DATE = r"^\d{4}-\d{2}-\d{2}"
#: Lengths of a cleansed value, and of a value that is compared without cleansing.
CLEANSED_MIN, CLEANSED_MAX = 10, 100


def collapse(c: Column) -> Column:
    """Runs of white space are one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_text(c: Column) -> Column:
    """As ``collapse``, with non-breaking entities as spaces."""
    return collapse(F.replace(c, F.lit("&nbsp;"), F.lit(" ")))


@F.pandas_udf(StringType())
def _plain(values: pd.Series) -> pd.Series:
    """Compatibility decomposition without non-spacing marks."""
    return values.map(lambda v: v if v is None or v.isascii() else "".join(c for c in unicodedata.normalize("NFKD", v) if unicodedata.category(c) != "Mn"))


def cleanse(c: Column) -> Column:
    """A value reduced to what should be alike in spelling variants; empty unless it has 10 to 100 characters then.

    Two passes over punctuation beside letters or space consume what they match, so of neighbouring marks some stay.
    """
    one = F.regexp_replace(c, r"(?i)([a-z\s])\p{Punct}", "$1")
    two = F.regexp_replace(one, r"(?i)\p{Punct}([a-z\s])", "$1")
    plain = _plain(F.lower(two))
    key = F.regexp_replace(F.regexp_replace(F.concat(plain, F.lit(" ")), r"s\s", " "), r"\s+", "")
    return F.when(F.length(key).between(CLEANSED_MIN, CLEANSED_MAX), key).otherwise(F.when(c.isNotNull(), ""))


def is_numeric(c: Column) -> Column:
    return c.rlike(NUMERIC)


def format_integer(c: Column) -> Column:
    """A value as an integer, cut towards zero; 0 where it isn't numeric."""
    value = F.trim(c)
    exact = F.when(value.rlike(r"^[+-]?\d{1,18}$"), value).try_cast("bigint")
    return F.coalesce(exact, F.when(is_numeric(value), value).try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def data_type(c: Column) -> Column:
    """blank, numeric, date or text, in this order of tests."""
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "blank").when(is_numeric(c), "numeric").when(c.rlike(DATE), "date").otherwise("text")


def snippet(line: Column, column: Column) -> Column:
    """At most 200 characters of a source line around a column (from 0)."""
    n = F.length(line)
    start = F.when((column > n) | (column < 25), 1).when(column < 200, 26).otherwise(column - 49)
    return F.when(n < 200, line).otherwise(F.substring(line, start, F.lit(200)))


def xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def is_utf8(c: Column) -> Column:
    """Whether binary data is valid UTF-8."""
    return F.is_valid_utf8(c.cast("string"))


def key_values(c: Column) -> Column:
    """Lines ``key: value`` (cut at the first colon) as a map; the values of a repeated key are joined."""
    pairs = F.filter(F.split(c, "\n"), lambda x: F.instr(x, ":") > 0)
    pair = F.transform(pairs, lambda x: F.struct(F.trim(F.split(x, ":", 2)[0]).alias("k"), F.trim(F.split(x, ":", 2)[1]).alias("v")))
    keys = F.array_distinct(F.transform(pair, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_join(F.transform(F.filter(pair, lambda p: p["k"] == k), lambda p: p["v"]), "")))


def row_as_map(names: Column, values: Column) -> Column:
    """A record as a map of its column names."""
    return F.map_from_arrays(names, values)


def metadata_holds(content: Column, operator: str, value: str) -> Column:
    """A date condition: both sides without dashes and blanks, as integers."""
    number = F.regexp_replace(content, r"[-\s]", "").try_cast("bigint")
    limit = int("".join(ch for ch in value if ch not in "- \t\n"))
    return F.coalesce(number > limit if operator == ">" else number < limit, F.lit(False))


def without_noscript(html: Column) -> Column:
    """A rendered page without its noscript elements."""
    return F.regexp_replace(html, r"(?is)<noscript\b[^>]*>.*?</noscript>", "")


def is_binary(field: Column) -> Column:
    """Whether a field has characters that need the binary mode of the CSV parser."""
    return field.rlike(r"[\x00-\x08\x0A-\x1F\x7F-\x{10FFFF}]")


def is_missing(fields: Column, index: Column | int) -> Column:
    """Whether a record has no field of this index (from 0)."""
    return F.size(fields) <= index


def http_date(ts: Column) -> Column:
    """A time as in the headers of answers; the session's time zone is UTC."""
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def localised(key: Column, strings: dict[str, dict[str, str]], lang: str, fallback: str = "*** No string *** ") -> Column:
    """A message in a language, else in English, else a fixed text and the key."""
    def of(which: str) -> Column:
        pairs = [F.lit(x) for pair in strings.get(which, {}).items() for x in pair]
        return F.create_map(*pairs)[key] if pairs else F.lit(None).cast("string")

    return F.coalesce(of(lang), of("eng"), F.concat(F.lit(fallback), key))


@F.pandas_udf(StringType())
def decoded(raw: pd.Series) -> pd.Series:
    """Bytes of a page as text: UTF-8, other bytes as the replacement character, character references replaced."""
    return raw.map(lambda b: None if b is None else html.unescape(bytes(b).decode("utf-8", "replace")))
