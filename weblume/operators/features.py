"""Features of pages: counts of tags, attributes, attribute values, PDF links, new windows and multimedia by section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import metadata_holds
from ..functions.urls import suffix


def of_elements(elements: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id, section, feature, line_no, column_no: all features of all elements (columns tag, attr, section, ...)."""
    attr = F.col("attr")
    named = F.flatten(F.transform(F.map_entries(attr), lambda e: F.array(e["key"], F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))))
    pdf = F.when((F.col("tag") == "a") & F.coalesce(attr["href"].endswith(".pdf"), F.lit(False)), "PDF href")
    window = F.when(F.coalesce(attr["target"].rlike("(?i)_blank"), F.lit(False)), "New window")
    every = F.array_compact(F.concat(F.array(F.col("tag")), named, F.array(pdf, window)))
    return elements.select(id_col, "section", F.explode(every).alias("feature"), "line_no", "column_no")


def counts(features: DataFrame, profile: DataFrame | None = None, id_col: str = "page_id") -> DataFrame:
    """id, feature, section, n, line_no and column_no of the first, for the features in the profile (column ``feature``).

    Counts of the content section stand where a page has any there, else those of the page.
    """
    wanted = features if profile is None else features.join(profile.select("feature").distinct(), "feature", "left_semi")
    each = wanted.groupBy(id_col, "section", "feature").agg(F.count("*").alias("n"), F.min(F.struct("line_no", "column_no")).alias("first"))
    best = each.groupBy(id_col).agg(F.max(F.when(F.col("section") == "CONTENT", 1).otherwise(0)).alias("content"))
    chosen = each.join(best, id_col).where((F.col("section") == "CONTENT") | ((F.col("content") == 0) & (F.col("section") == "PAGE")))
    return chosen.select(id_col, "feature", "section", "n", F.col("first.line_no").alias("line_no"), F.col("first.column_no").alias("column_no"))


def of_pages(facts: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The same as ``counts`` from facts whose features were counted in the parse (``wanted=("features",)`` with a profile): a page's
    counts are in one row, so nothing is shuffled."""
    inside = F.filter("features", lambda x: x["section"] == "CONTENT")
    chosen = F.when(F.size(inside) > 0, inside).otherwise(F.filter("features", lambda x: x["section"] == "PAGE"))
    return facts.select(id_col, F.inline(chosen)).select(id_col, "feature", "section", "n", "line_no", "column_no")


def tags_of_pages(facts: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The same as ``tag_counts`` from facts whose tags were counted in the parse."""
    return facts.select(id_col, F.inline("tags")).groupBy("tag").agg(F.sum("n").alias("n"), F.countDistinct(id_col).alias("pages"))


def tag_counts(elements: DataFrame, tags: list[str]) -> DataFrame:
    """Uses of some tags over all pages, and the pages that have them."""
    return elements.where(F.col("tag").isin(tags)).groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


def multimedia(mime: Column, url: Column) -> Column:
    return mime.isin(*dims.MULTIMEDIA_MIME) | suffix(url).isin(*dims.MULTIMEDIA_SUFFIX)


def link_features(links: DataFrame, id_col: str = "page_id") -> DataFrame:
    """PDF and multimedia links of each page by their MIME type and suffix (columns href, mime_type)."""
    kind = F.when((F.col("mime_type") == "application/pdf") | (suffix(F.col("href")) == "pdf"), "PDF href").when(multimedia(F.col("mime_type"), F.col("href")), "multimedia")
    return links.withColumn("feature", kind).where("feature is not null").groupBy(id_col, "feature").agg(F.count("*").alias("n"))


def script_multimedia(pages: DataFrame, id_col: str = "page_id", content: str = "html") -> DataFrame:
    """id and n: uses of a multimedia file, a suffix before a quote, in the text of a page's scripts."""
    texts = F.regexp_extract_all(content, F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1))
    uses = F.aggregate(texts, F.lit(0), lambda a, x: a + F.regexp_count(x, F.lit(rf"(?i)\.({'|'.join(dims.MULTIMEDIA_SUFFIX)})[\"']")))
    return pages.select(id_col, uses.alias("n")).where("n > 0").select(id_col, F.lit("multimedia").alias("feature"), "n")


def metadata_features(metadata: DataFrame, conditions: list[tuple[str, str, str]], id_col: str = "page_id") -> DataFrame:
    """Pages whose metadata meet (tag, operator, value); places are -1, counts 1."""
    rows = [
        metadata.where((F.col("name") == tag) & metadata_holds(F.col("content"), op, value)).select(id_col, F.lit(f"{tag} {op} {value}").alias("feature"), F.lit(1).alias("n"), F.lit(-1).alias("line_no"), F.lit(-1).alias("column_no"))
        for tag, op, value in conditions
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.distinct()


def missing_properties(properties: DataFrame, required: DataFrame, id_col: str) -> DataFrame:
    """id and property of required properties that a document hasn't or has empty. properties: id, ``properties`` (map).

    required is a profile and small; each document is met with it, not with other documents.
    """
    wanted = [r[0] for r in required.select("property").distinct().orderBy("property").collect()]  # a profile is a configuration file
    missing = F.filter(F.array(*[F.lit(p) for p in wanted]) if wanted else F.array().cast("array<string>"), lambda p: F.trim(F.coalesce(F.try_element_at("properties", p), F.lit(""))) == "")
    return properties.select(id_col, F.explode(missing).alias("property"))


def section_names(elements: DataFrame) -> DataFrame:
    """The distinct sections that pages use."""
    return elements.select("section").distinct()
