"""Whole scans: the checks of a family over their inputs, as one result table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import links as L
from ..operators import profile as P
from ..operators.results import results, union
from ..shared import cut
from ..sources.html import parse_pages


def web(pages: DataFrame) -> DataFrame:
    """Result rows of the web checks over pages (page_id, url, html). Each page is parsed once: what the checks need of it, and
    not the facts, is written to the shared folder, and the checks read that. A page without a title has none to share."""
    facts = parse_pages(pages, wanted=("links", "anchors", "title", "html_lang", "headings"))
    texts = F.transform("headings", lambda h: h["text"])
    uses = lambda t: F.filter("headings", lambda h: h["text"] == t)
    repeated = F.filter(F.array_distinct(texts), lambda t: F.size(uses(t)) > 1)
    heads = F.transform(repeated, lambda t: F.struct(t.alias("text"), F.array_min(F.transform(uses(t), lambda h: h["line_no"])).alias("line")))
    held = cut(facts.select("page_id", "url", "title", "html_lang", L.broken().alias("broken"), heads.alias("heads")))
    return union(
        results(held.select("url", F.inline("broken")), "BROKEN_ANCHOR", url=F.col("url"), line_no=F.col("line_no"), message=F.concat(F.lit("no anchor "), "fragment")),
        languages_and_titles(held),
        results(held.select("url", F.inline("heads")), "DUPLICATE_HEADINGS", url=F.col("url"), line_no=F.col("line"), message=F.col("text")),
    )


def languages_and_titles(held: DataFrame) -> DataFrame:
    """Result rows of pages (page_id, url, title, html_lang) without a language, with a long title or with that of a page of a smaller
    page_id. ``held`` is read once for each; what is null of a page has no result."""
    titles = held.where("title <> ''").groupBy("title").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1")
    return union(
        results(held.where("html_lang = ''"), "NO_LANG", url=F.col("url"), message="no language on html"),
        results(held.where("length(title) >= 60"), "TITLE_LONG", url=F.col("url"), message=F.col("title")),
        results(held.join(titles, "title").where("page_id <> first"), "DUPLICATE_TITLES", url=F.col("url"), message=F.col("title")),
    )


def open_data(df: DataFrame, line: str, columns: list[str], dictionary: DataFrame | None = None) -> DataFrame:
    """Result rows of the tabular checks: inconsistent spellings, dictionary violations, blank columns."""
    table = P.cells(df, line, columns)
    spelt = P.consistency(table).where(~F.col("match"))
    empty = P.profile(table).where("non_blank = 0")
    parts = [
        results(spelt, "TP_PW_OD_CONT_CONSISTENCY", line_no=F.col("line"), description=F.col("heading"), source_line=F.col("value"), message=F.concat(F.lit("first spelt "), "other_data", F.lit(" on line "), F.col("other_line").cast("string"))),
        results(empty, "OD_DATA", description=F.col("heading"), message="no values"),
    ]
    if dictionary is not None:
        wrong = P.against_dictionary(table, dictionary).where(~F.col("match"))
        parts.append(results(wrong, "TP_PW_OD_DD", line_no=F.col("line"), description=F.col("heading"), source_line=F.col("value"), message="does not match the dictionary"))
    return union(*parts)
