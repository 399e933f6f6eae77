"""Helpers shared by the training-data operators."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, delete, delete_at_end, shared_folder  # noqa: F401

#: White space in the contracts of the operators: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salts(spark: SparkSession) -> int:
    """Parts that a key's rows are dealt to where one key may have many of them: as many as an exchange has, 64 at least."""
    return max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))


def settled(rows: DataFrame, keys: list[str], value: Column, by: list[str]) -> DataFrame:
    """The rows whose key occurs more than once, with ``first``, the least ``value`` of their key.

    A key that a third of all rows have doesn't meet in one task: its rows are dealt to parts by a hash of ``by``, each part is
    settled by itself, and what the parts tell (a row for each) is settled by key and joined back to the parts' rows.
    """
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(*by), F.lit(salts(rows.sparkSession))))
    parts = dealt.groupBy(*keys, "__part").agg(F.min(value).alias("first"), F.count("*").alias("n"))
    told = parts.groupBy(*keys).agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_list("__part").alias("parts")).where("n > 1")
    return dealt.join(told.select(*keys, "first", F.explode("parts").alias("__part")), [*keys, "__part"]).drop("__part")


def inline(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small DataFrame of driver-side rows, made by SQL functions alone."""
    made = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(0, 1, 1, 1).select(F.inline(made))


def words_count(text: Column) -> Column:
    """Number of runs of non-space characters; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{SPACE}]+")), F.lit(0)).cast("long")
