"""Column profiles and consistency of tabular data.

Cells come long: heading, line (orders the file), value. First-occurrence rules are aggregates joined back, not windows, so a
value that fills a third of the lines is counted in part before the shuffle and its join can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cleanse, data_type, is_numeric


def cells(df: DataFrame, line: str, columns: list[str]) -> DataFrame:
    """The cells of some columns, one row for each."""
    pairs = F.array(*[F.struct(F.lit(c).alias("heading"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.col(line).alias("line"), F.inline(pairs)).select("heading", "line", "value")


def type_counts(table: DataFrame) -> DataFrame:
    """heading, type, n, first_data, first_line."""
    return table.withColumn("type", data_type(F.col("value"))).groupBy("heading", "type").agg(F.count("*").alias("n"), F.min_by("value", "line").alias("first_data"), F.min("line").alias("first_line"))


def profile(table: DataFrame) -> DataFrame:
    """heading, type, non_blank, first_data, min, max and sum (of numeric columns; the sum of others is 0)."""
    value = F.col("value")
    filled = F.trim(F.coalesce(value, F.lit(""))) != ""
    number = F.when(is_numeric(value), value.try_cast("double"))
    base = table.groupBy("heading").agg(
        F.count(F.when(filled, 1)).alias("non_blank"), F.min_by("value", "line").alias("first_data"), F.count(F.when(filled & ~F.coalesce(is_numeric(value), F.lit(False)), 1)).alias("other"),
        F.min(F.when(filled, value)).alias("min_text"), F.max(F.when(filled, value)).alias("max_text"), F.min(number).alias("min_number"), F.max(number).alias("max_number"), F.sum(number).alias("total"),
    )
    numeric = (F.col("other") == 0) & (F.col("non_blank") > 0)
    return base.select(
        "heading", F.when(numeric, "numeric").otherwise("text").alias("type"), "non_blank", "first_data", F.when(~numeric, F.col("min_text")).alias("min_text"), F.when(~numeric, F.col("max_text")).alias("max_text"),
        F.when(numeric, F.col("min_number")).alias("min_number"), F.when(numeric, F.col("max_number")).alias("max_number"), F.when(numeric, F.col("total")).otherwise(F.lit(0.0)).alias("sum"),
    )


def consistency_key(value: Column) -> Column:
    """What spellings of a value share; null where a value isn't checked."""
    clean = cleanse(value)
    return F.when(clean != "", clean).when(F.length(value) < 10, F.lower(value))


def consistency(table: DataFrame) -> DataFrame:
    """heading, line, value, match, other_data, other_line: whether each cell is spelt as the first with its key.

    Unchecked and first values match; their other_line is -1.
    """
    keyed = table.withColumn("key", consistency_key(F.col("value")))
    first = keyed.where(F.col("key").isNotNull()).groupBy("heading", "key").agg(F.min(F.struct("line", "value")).alias("first"))
    joined = keyed.join(first, ["heading", "key"], "left")
    differs = F.coalesce(F.col("value") != F.col("first.value"), F.lit(False))
    return joined.select(
        "heading", "line", "value", (~differs).alias("match"), F.when(differs, F.col("first.value")).otherwise("").alias("other_data"), F.when(differs, F.col("first.line")).otherwise(F.lit(-1)).alias("other_line")
    )


def pair_consistency(df: DataFrame, line: str, first: str, second: str) -> DataFrame:
    """Functional dependency: equal first cells (but for case) must be spelt alike and carry the same second cell.

    Pairs of 100 characters or more aren't checked. line, match, first_data, other_data, first_line of the first occurrence.
    """
    flat = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " ")
    cells_ = df.select(F.col(line).alias("line"), flat(first).alias("a"), flat(second).alias("b")).withColumn("key", F.lower("a"))
    checked = F.length("a") + F.length("b") < 100
    origin = cells_.where(checked).groupBy("key").agg(F.min(F.struct("line", "a", "b")).alias("o"))
    joined = cells_.join(origin, "key", "left")
    bad = checked & ((F.col("a") != F.col("o.a")) | (F.col("b") != F.col("o.b")))
    bad = F.coalesce(bad, F.lit(False))
    return joined.select("line", "a", "b", (~bad).alias("match"), F.when(bad, F.col("o.a")).otherwise("").alias("first_data"), F.when(bad, F.col("o.b")).otherwise("").alias("other_data"), F.when(bad, F.col("o.line")).otherwise(F.lit(-1)).alias("first_line"))


def against_dictionary(table: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Cells whose heading is a dictionary term with a pattern, and whether they match it.

    dictionary: term, regex, a row for each term of the data dictionary; it is small and joined by heading.
    """
    return table.join(dictionary.where(F.col("regex") != ""), F.col("heading") == F.col("term")).select("heading", "line", "value", F.coalesce(F.expr("value rlike regex"), F.lit(False)).alias("match"))


def unknown_headings(table: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Headings that the dictionary doesn't have."""
    return table.select("heading").distinct().join(dictionary, F.col("heading") == F.col("term"), "left_anti")


def duplicate_columns(table: DataFrame) -> DataFrame:
    """Groups of columns with equal content: checksum, headings. Contents are told apart by two sums of hashes, 128 bits."""
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), "line", "value").cast("decimal(38,0)"))
    sums = table.groupBy("heading").agg(F.struct(total(1).alias("a"), total(2).alias("b"), F.count("*").alias("n")).alias("checksum"))
    return sums.groupBy("checksum").agg(F.array_sort(F.collect_list("heading")).alias("headings")).where(F.size("headings") > 1)
