"""Language codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims

def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def bare(c: Column) -> Column:
    """Without region, in lower case."""
    return F.lower(F.regexp_replace(c, r"-.*", ""))


def iso_639_2(c: Column) -> Column:
    """639-2/B code: 639-1, a letter or a name to 639-2/T, then to B where it differs; unknown codes as they are."""
    short = bare(c)
    term = F.coalesce(_lookup(dims.ISO_639_1, short), _lookup(dims.ONE_LETTER, short), _lookup(dims.LANGUAGE_NAMES, short), short)
    return F.coalesce(_lookup(dims.ISO_639_2B, term), term)


def language_valid(c: Column) -> Column:
    form = F.lit(False)
    for pattern in dims.LANGUAGE_FORMS:
        form = form | c.rlike(pattern)
    return F.coalesce(form & (_lookup(dims.ISO_639_1, bare(c)).isNotNull() | _lookup(dims.ISO_639_2B, bare(c)).isNotNull()), F.lit(False))


def link_language(hreflang: Column, lang: Column, xml_lang: Column, inherited: Column) -> Column:
    """Language of a link's target: the first attribute that is there, as three letters, else what is inherited."""
    own = F.coalesce(F.nullif(hreflang, F.lit("")), F.nullif(lang, F.lit("")), F.nullif(xml_lang, F.lit("")))
    return F.coalesce(_lookup(dims.ISO_639_1, bare(own)), own, inherited)
