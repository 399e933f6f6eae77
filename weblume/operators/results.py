"""The uniform result table: making rows, selecting test cases, attaching help, capping, scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..schemas import RESULT

_DEFAULTS = {"status": 1, "line_no": -1, "column_no": -1, "page_no": -1}


def results(df: DataFrame, testcase: Column | str, keep: tuple[str, ...] = (), **columns: Column | str | int) -> DataFrame:
    """Result rows; columns that aren't given take their defaults. A source line is cut around its column. ``keep`` names columns of
    ``df`` that stay beside them."""
    given = {k: v if isinstance(v, Column) else F.lit(v) for k, v in columns.items()}
    if "source_line" in given:
        given["source_line"] = snippet(given["source_line"], given.get("column_no", F.lit(-1)))
    given["testcase"] = testcase if isinstance(testcase, Column) else F.lit(testcase)
    return df.select(*[given.get(n, F.lit(_DEFAULTS.get(n, ""))).cast(kind).alias(n) for n, kind in (f.split() for f in RESULT.split(","))], *keep)


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def selected(rows: DataFrame, profile: DataFrame, name: str) -> DataFrame:
    """Results whose test case a profile (columns profile, tcid) selects."""
    return rows.join(profile.where(F.col("profile") == name).select(F.col("tcid").alias("testcase")).distinct(), "testcase", "left_semi")


def with_help(rows: DataFrame, helps: DataFrame, key: str = "testcase") -> DataFrame:
    """help_url of each row's test case, empty where there is none. helps: a row (key, url) for each test case."""
    return rows.drop("help_url").join(helps.select(F.col(helps.columns[0]).alias("__k"), F.col(helps.columns[1]).alias("__u")), F.col(key) == F.col("__k"), "left").withColumn("help_url", F.coalesce("__u", F.lit(""))).drop("__k", "__u")


def capped(rows: DataFrame, key: str | list[str], order: str | list[str], most: int = 1000) -> DataFrame:
    """The first rows of each key; Spark limits each task to them before the shuffle."""
    keys, by = ([key] if isinstance(key, str) else key), ([order] if isinstance(order, str) else order)
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("__rn") <= most).drop("__rn")


def faults(rows: DataFrame, pages: DataFrame, url: str = "url", key: str | None = None) -> DataFrame:
    """url, faults and score (100, less 1 for each fault, 0 at least) of every page. Where pages share addresses, ``key`` names the
    column of both tables that tells them apart; else each has the faults of all."""
    n = rows.groupBy(F.col(key or "url").alias("__key")).agg(F.count("*").alias("n"))
    return pages.select(url, *([key] if key and key != url else [])).join(n, F.col(key or url) == F.col("__key"), "left").select(url, F.coalesce("n", F.lit(0)).alias("faults"), F.greatest(F.lit(0), 100 - F.coalesce("n", F.lit(0))).alias("score"))


def scan_score(page_faults: DataFrame) -> DataFrame:
    """faults, faults_per_page and mean score of a scan."""
    return page_faults.agg(F.sum("faults").alias("faults"), F.round(F.sum("faults") / F.count("*"), 4).alias("faults_per_page"), F.round(F.avg("score"), 4).alias("score"))
