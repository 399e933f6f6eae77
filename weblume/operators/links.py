"""Links of pages, feeds and style sheets as one table, and what is computed from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import mime_branch, url_parts
from ..sources import css, xml
from ..sources.html import CONDITIONALS, parse_pages


def page_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", content_col: str = "html", generated_col: str | None = None) -> DataFrame:
    """One row for each link of each page, with the columns of the link type."""
    facts = parse_pages(pages, id_col, url_col, content_col, generated_col, wanted=("links",))
    return facts.select(id_col, "url", F.inline("links"))


def style_links(pages: DataFrame, id_col: str = "page_id", content_col: str = "html") -> DataFrame:
    """Addresses in the style elements of pages: link_type css, places -1."""
    sheets = pages.select(id_col, F.explode(css.style_text(F.col(content_col))).alias("css"))
    return css.urls(sheets, id_col, F.col("css")).select(id_col, F.lit("css").alias("link_type"), F.col("url").alias("href"), F.lit(-1).alias("line_no"), F.lit(-1).alias("column_no"))


def removed_conditionals(html: Column) -> Column:
    """A page without its conditional comments, on column expressions."""
    return F.regexp_replace(html, CONDITIONALS, "")


def by_branch(documents: DataFrame) -> dict[str, DataFrame]:
    """Documents by the extractor for their MIME type."""
    marked = documents.withColumn("__branch", mime_branch(F.col("mime_type"), F.col("url")))
    return {b: marked.where(F.col("__branch") == b).drop("__branch") for b in ("html", "css", "pdf", "xml")}


def extracted(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, branch, link_type and href of the links of documents of all kinds (id, url, mime_type, content), each by its extractor;
    PDF files and others have none."""
    kinds = by_branch(documents)
    pages = page_links(kinds["html"], id_col, "url", "content").select(id_col, F.lit("html").alias("branch"), "link_type", "href")
    sheets = css.urls(kinds["css"], id_col, F.col("content")).select(id_col, F.lit("css").alias("branch"), F.lit("css").alias("link_type"), F.col("url").alias("href"))
    feeds = xml.links(kinds["xml"], id_col, "url", "content").select(id_col, F.lit("xml").alias("branch"), "link_type", "href")
    return pages.unionByName(sheets).unionByName(feeds)


def type_counts(links: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Links of each page by their type: n_links and n_distinct."""
    return links.groupBy(id_col, "link_type").agg(F.count("*").alias("n_links"), F.countDistinct("href").alias("n_distinct"))


def sections(links: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The links of each content section of each page, in order."""
    held = F.array_sort(F.collect_list(F.struct("pos", "href")))
    return links.groupBy(id_col, "content_section").agg(F.count("*").alias("n_links"), F.transform(held, lambda x: x["href"]).alias("hrefs"))


def parts(links: DataFrame, col: str = "abs_url") -> DataFrame:
    return links.withColumns(url_parts(F.col(col)))


def broken() -> Column:
    """Of a row of facts, the on-page links whose fragment no anchor of the page has: (pos, href, fragment, line_no). Links and
    anchors are in one row, so nothing is joined."""
    inside = F.filter("links", lambda x: x["on_page_id_reference"] & x["href"].startswith("#") & (F.length(x["href"]) > 1))
    named = F.transform(inside, lambda x: F.struct(x["pos"].alias("pos"), x["href"].alias("href"), F.substr(x["href"], F.lit(2)).alias("fragment"), x["line_no"].alias("line_no")))
    return F.filter(named, lambda x: ~F.contains("anchors", F.concat(F.lit(" "), x["fragment"], F.lit(" "))))


def broken_anchors(facts: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One row for each broken on-page link. facts: id, links, anchors (each between spaces)."""
    return facts.select(id_col, F.inline(broken()))


def shared_targets(links: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Addresses that more than one page links to."""
    return links.groupBy("href").agg(F.countDistinct(id_col).alias("pages")).where("pages > 1")


def text_groups(links: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Pages by target, language, alternative text and title: the pages are counted, and the first named.

    A widely used text would gather its pages in one row; they are counted in parts before the shuffle. ``text_pages`` lists them.
    """
    return links.groupBy("href", "lang", "alt", "title").agg(F.countDistinct(id_col).alias("pages"), F.min(id_col).alias("first_page"))


def text_pages(links: DataFrame, url_col: str = "url") -> DataFrame:
    """href, lang, kind (alt, title or anchor), text and url: the distinct pages that give a target's link this text, a row for
    each. Rows, and not one list, as a text of a third of all pages has as many."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("text")) for k in ("alt", "title", "anchor")])
    return links.select("href", "lang", url_col, F.inline(kinds)).where("text <> ''").select("href", "lang", "kind", "text", url_col).distinct()


def inconsistent_texts(links: DataFrame) -> DataFrame:
    """Targets that carry more than one link text in a language."""
    return links.where("link_type = 'a'").groupBy("href", "lang").agg(F.countDistinct("anchor").alias("texts"), F.count("*").alias("links")).where("texts > 1")


def without_ignored(links: DataFrame, ignored: DataFrame, col: str = "href") -> DataFrame:
    """Links but those to listed addresses."""
    return links.join(ignored.select(F.col(ignored.columns[0]).alias("__ignored")), F.col(col) == F.col("__ignored"), "left_anti")
