"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_made: dict[str, str] = {}
_marked: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is made, but on a local master only, as in tests: on a cluster it would not be shared.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or _made.get(spark.sparkContext.applicationId)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    _made[spark.sparkContext.applicationId] = made = tempfile.mkdtemp(prefix="weblume-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return it without its lineage. What is written goes when the application ends."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    if context.applicationId not in _marked:
        delete_at_end(spark, context.getCheckpointDir())  # the application's own folder in the shared one
        _marked.add(context.applicationId)
    return df.checkpoint()


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data when the application ends."""
    where, files = _path(spark, path)
    files.deleteOnExit(where)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data that nothing reads any more."""
    where, files = _path(spark, path)
    files.delete(where, True)


def numbered(df: DataFrame, key: str, order: list[str], number: str) -> DataFrame:
    """Adds ``number``, from 0 for each key in the order of some columns.

    No key is one task: rows are dealt to ranges of (key, order), written once, numbered in each range, and what a key has in the
    ranges before (a row for each key and range) is added. A null key is a key like any other.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, key, *order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy(F.col(key).alias("__k"), F.col("__range").alias("__r")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__k").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__k", "__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__range", key).orderBy(*order)
    placed = dealt.withColumn("__place", F.row_number().over(inside) - 1)
    met = placed.join(offsets, (F.col("__range") == F.col("__r")) & F.col(key).eqNullSafe(F.col("__k")))
    return met.withColumn(number, (F.col("__place") + F.col("__before")).cast("long")).drop("__range", "__place", "__k", "__r", "__before")
