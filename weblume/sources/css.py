"""Style sheets as rows, on column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULE = r"([^{}]+)\{([^{}]*)\}"
PROPERTY = r"([\w._-]+)\s*:\s*([^;]+)"


def without_comments(css: Column) -> Column:
    return F.regexp_replace(css, r"(?s)/\*.*?\*/", "")


def style_text(html: Column) -> Column:
    """The style elements of a page, in order."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<style[^>]*>(.*?)</style>"), F.lit(1))


def urls(df: DataFrame, key: str, css: Column) -> DataFrame:
    """key, pos and url of every ``url(...)``, without quotes; sheets without one are filtered out first."""
    found = F.regexp_extract_all(without_comments(css), F.lit(r"url\(\s*[\"']?([^\"')]*?)[\"']?\s*\)"), F.lit(1))
    return df.where(css.contains("url(")).select(key, F.posexplode(found).alias("pos", "url")).where(F.trim("url") != "")


def rules(df: DataFrame, key: str, css: Column) -> DataFrame:
    """key, pos, selector, property and value: one row for each property of each selector of each rule, those in ``@media`` too.

    A block without a selector or without braces is skipped.
    """
    sheet = without_comments(css)
    bodies = F.arrays_zip(F.regexp_extract_all(sheet, F.lit(RULE), F.lit(1)).alias("s"), F.regexp_extract_all(sheet, F.lit(RULE), F.lit(2)).alias("b"))
    blocks = df.select(key, F.posexplode(bodies).alias("pos", "r")).select(key, "pos", F.explode(F.split("r.s", ",")).alias("selector"), F.col("r.b").alias("body"))
    pairs = F.arrays_zip(F.regexp_extract_all("body", F.lit(PROPERTY), F.lit(1)).alias("p"), F.regexp_extract_all("body", F.lit(PROPERTY), F.lit(2)).alias("v"))
    return blocks.select(key, "pos", F.trim("selector").alias("selector"), F.explode(pairs).alias("x")).where("selector <> ''").select(key, "pos", "selector", F.col("x.p").alias("property"), F.trim("x.v").alias("value"))


def property_of(styles: DataFrame, key: str, selector: str, name: str) -> DataFrame:
    """The value of a property in the first style with a selector."""
    return styles.where((F.col("selector") == selector) & (F.col("property") == name)).groupBy(key).agg(F.min_by("value", "pos").alias("value"))


def serialise(styles: DataFrame, key: str) -> DataFrame:
    """Sheets written back from their rows."""
    one = styles.groupBy(key, "pos", "selector").agg(F.array_sort(F.collect_list(F.concat("property", F.lit(": "), "value"))).alias("p"))
    text = one.select(key, "pos", F.concat("selector", F.lit(" {\n\t"), F.array_join("p", ";\n\t"), F.lit(";\n}\n")).alias("t"))
    return text.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "").alias("css"))


def computed(df: DataFrame, key: str, styles: Column) -> DataFrame:
    """key, selector, property and value of computed styles, as a browser reports them: JSON objects of properties by element path."""
    read = F.from_json(styles, "map<string,map<string,string>>")
    return df.select(key, F.explode(read).alias("selector", "p")).select(key, "selector", F.explode("p").alias("property", "value"))
