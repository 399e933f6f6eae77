"""Mixing sources to target weights by pivotal dependent rounding over a distributed reduction tree.

Targets: the sources share the words of all documents by weight, but none gets more than ``cap`` times its own words; what a
capped source leaves is shared by the others (water-filling over the table of sources).

Copies: a document of a source with target t and size S gets t / S expected copies. Whole copies are given at once; the
fraction is settled by pivotal rounding. Two documents with fractions a and b and sizes s and z exchange words: one gains
what the other loses, until one fraction is 0 or 1; the direction is drawn so that expectations are kept. Each step keeps the
words of the source exactly. The first level of the tree settles bounded groups of a source's documents, chosen by hash, in
parallel; each group passes at most one fractional document on, and the next level groups those, until one is left for each
source. That last fraction is taken as so many of the document's words, so that a source meets its target to the word.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, inline, salts, words_count

#: Documents that a group of the reduction tree settles.
GROUP = 2048
#: Copies of one row that a task makes.
PIECE = 8192
#: Weights of the sources in order of their names, repeated.
WEIGHTS = (1, 2, 3)
#: A fraction this near to 0 or 1 is an integer.
TINY = 1e-9
#: Source tables up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 10_000


def _ranked(sizes: DataFrame) -> DataFrame:
    """Adds ``__rank``, from 1 in the order of the sources, null last: ranks of ranges of sources, and the sources before each."""
    ranges = cut(sizes.repartitionByRange(salts(sizes.sparkSession), F.col("source").asc_nulls_last()).withColumn("__range", F.spark_partition_id()))
    before, offsets = 0, []
    for r in ranges.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect():  # a row for each partition
        offsets.append({"__r": r["__range"], "__before": before})
        before += r["n"]
    inside = Window.partitionBy("__range").orderBy(F.col("source").asc_nulls_last())
    known = inline(sizes.sparkSession, offsets, "__r:int,__before:bigint")
    placed = ranges.withColumn("__at", F.row_number().over(inside)).join(F.broadcast(known), F.col("__range") == F.col("__r"))
    return placed.withColumn("__rank", F.col("__at") + F.col("__before")).drop("__range", "__r", "__at", "__before")


def targets(sizes: DataFrame, cap: float = 3.0, weights: tuple = WEIGHTS) -> DataFrame:
    """Adds ``target`` to (source, source_size, ...); one row for each source, null a source like any other.

    The sources that aren't full share one level of words by weight. It is found by rising: sources that the level fills are
    capped and the others share the rest, until no more are filled. Each step is one aggregate; sums are of integers, so they
    are the same in any order.
    """
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = cut(
        _ranked(sizes).withColumn("__w", F.element_at(listed, ((F.col("__rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("__top", F.col("source_size") * F.lit(float(cap))).withColumn("__full", F.col("__top") / F.col("__w"))
    )
    level, filled = 0.0, -1
    while True:
        full = F.col("__full") <= F.lit(level)
        total, taken, weight, n = ranked.agg(F.sum("source_size"), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("__w"))), F.count(F.when(full, 1))).first()
        if n == filled or not weight:
            break
        level, filled = max(level, (total - cap * (taken or 0)) / weight), n
    share = F.least("__top", F.lit(level) * F.col("__w")) if weight else F.col("__top")
    return ranked.select(*sizes.columns, share.alias("target"))


def pivot(fractions: list[float], sizes: list[int], rng: random.Random) -> int:
    """Settle all fractions but at most one in place; the index of that one, or -1."""
    at = -1
    for j, b in enumerate(fractions):
        if not TINY < b < 1 - TINY:
            fractions[j] = float(round(b))
            continue
        if at < 0:
            at = j
            continue
        a, s, z = fractions[at], sizes[at], sizes[j]
        up, down = min((1 - a) * s, b * z), min(a * s, (1 - b) * z)  # words that j can give, and take
        moved = up if rng.random() * (up + down) < down else -down
        a, b = a + moved / s, b - moved / z
        for i, x in ((at, a), (j, b)):
            fractions[i] = x if TINY < x < 1 - TINY else float(round(x))
        open_ = [i for i in (at, j) if 0 < fractions[i] < 1]
        at = open_[0] if open_ else -1
    return at


def _settle(seed: int, level: int):
    def settle(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("__h", "ascending"), ("__id", "ascending"), ("__copy", "ascending")])
        fractions = rows["__f"].to_pylist()
        pivot(fractions, rows["size"].to_pylist(), random.Random(f"{seed}:{level}:{[k.as_py() for k in key]}"))
        return rows.set_column(rows.schema.get_field_index("__f"), "__f", pa.array(fractions, pa.float64()))

    return settle


def times(df: DataFrame, n: str, most: int, number: str, keys: list[str]) -> DataFrame:
    """Each row ``n`` times (``most`` at most), numbered from 0 in ``number``. Where a row stands for many, PIECE are made in a task."""
    pieces = df.withColumn("__piece", F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / PIECE).cast("int"))))
    if most > PIECE:
        pieces = pieces.repartition(salts(df.sparkSession), *keys, "__piece")
    last = F.least(F.col(n), (F.col("__piece") + 1) * PIECE) - 1
    return pieces.withColumn(number, F.explode(F.sequence((F.col("__piece") * PIECE).cast("long"), last.cast("long")))).drop("__piece")


def mix(rows: DataFrame, cap: float = 3.0, seed: int = 77) -> DataFrame:
    """Decide how often each document is taken.

    rows: columns ``__id`` (string, tells documents apart), ``size`` (words, long), ``source``; others are carried along.
    Adds ``source_size``, ``target``, ``copies`` (long, whole copies) and ``part`` (long, words of one more copy; more than 0
    in one document of a source at most). Documents without words get no copies. Rows alike in all columns are counted, and
    then numbered as documents of their own, so a row that fills a third of the table is spread over the groups. An empty table
    stays empty. Ids may be null; texts aren't read here.
    """
    names = rows.columns
    rows = cut(rows.groupBy(*names).agg(F.count("*").alias("__rows")))  # texts are read once; these rows are narrow
    sums = cut(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("__rows")).alias("source_size"), F.sum("__rows").alias("__docs")))
    known = cut(targets(sums, cap)).withColumnRenamed("source", "__source")
    n_sources, most = known.agg(F.count("*"), F.coalesce(F.max("__docs"), F.lit(0))).first()
    hinted = F.broadcast(known) if n_sources <= BROADCAST_ROWS else known
    expected = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(F.col("__x") + F.lit(TINY))
    each = times(rows, "__rows", rows.agg(F.max("__rows")).first()[0] or 0, "__copy", names).drop("__rows")
    todo = (
        each.join(hinted, each["source"].eqNullSafe(known["__source"])).drop("__source")
        .withColumn("__x", expected)
        .withColumn("copies", whole.cast("long"))
        .withColumn("__f", F.greatest(F.col("__x") - whole, F.lit(0.0)))
        .withColumn("__h", F.xxhash64(F.lit(seed), "__id", "__copy"))
        .withColumn("__b", F.pmod("__h", F.ceil(F.col("__docs") / F.lit(float(GROUP)))))
        .drop("__x", "__docs")
    )
    shape, settled, level = todo.schema, [], 0
    groups = max(1, -(-most // GROUP))
    while True:
        open_ = todo.where(F.col("__f") > TINY).groupBy("source", "__b").applyInArrow(_settle(seed, level), shape)
        todo = cut(open_ if level else open_.unionByName(todo.where(F.col("__f") <= TINY).withColumn("__f", F.lit(0.0))))
        done = (F.col("__f") == 0) | (F.col("__f") == 1)
        if groups == 1:
            settled.append(todo)
            break
        settled.append(todo.where(done))
        todo, level, groups = todo.where(~done).withColumn("__b", F.floor(F.col("__b") / F.lit(GROUP))), level + 1, -(-groups // GROUP)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return (
        out.withColumn("copies", F.col("copies") + F.floor("__f").cast("long"))
        .withColumn("part", F.when(F.col("__f") < 1, F.round(F.col("__f") * F.col("size"))).otherwise(F.lit(0)).cast("long"))
        .drop("__f", "__h", "__b", "__copy")
    )


def document_key() -> Column:
    """Tells documents apart, but for repeated rows."""
    return F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text", "source").cast("string"))


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id, size and source of every document, with the key that ``mix`` needs."""
    return docs.select("doc_id", words_count(F.col("text")).alias("size"), "source", document_key().alias("__id"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns. The one document of a source that is taken
    in part is taken whole where the part is half of it or more, and else not."""
    taken = F.col("copies") + F.when(F.col("part") * 2 >= F.greatest("size", F.lit(1)), 1).otherwise(0)
    chosen = cut(mix(narrow(docs)).groupBy("__id").agg(F.sum(taken).alias("__taken")).where("__taken > 0").withColumnRenamed("__id", "__key"))
    most = chosen.agg(F.max("__taken")).first()[0] or 0
    rows = docs.withColumn("__key", document_key()).dropDuplicates(["__key"])
    return times(rows.join(chosen, "__key"), "__taken", most, "__copy", ["__key"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10(docs: DataFrame) -> DataFrame:
    """Contract columns of the mixing query."""
    return mix(narrow(docs)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"), "copies", "part")
