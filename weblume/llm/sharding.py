"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. Rows fall into P logical partitions by a hash of their keys; the number of rows of each is counted.
2. The matrix M[p][s], the number of rows that partition p sends to shard s, is drawn from the multivariate hypergeometric
   law whose margins are the partition counts and the exact shard sizes. A uniform permutation of all rows has this law.
   The matrix has at most FINE x shards numbers and is drawn on the driver from counts alone.
3. Each partition is permuted locally: rank by a random hash; ranks are cut by the matrix row into runs for shards 0, 1, ...
4. After the exchange each shard is permuted again. A shard is not sorted in one task: it is split by the leading bits of
   a second random hash, the offsets of the pieces are summed, and each piece is ranked by itself.

All randomness is a hash of (seed, keys), so retried tasks and reruns agree. Rows that are alike in their keys would share a
partition; where more than ALIKE are, the table is written once with a number for each row, and theirs are dealt by it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, inline

#: Finest number of logical partitions that counts are taken for.
FINE = 32_768
#: Rows that a logical partition should hold, and fewest partitions.
ROWS_PER_PARTITION, FEWEST = 8192, 16
#: Rows alike in their keys that may share a partition.
ALIKE = 8192
#: Rows of a table of one number that is broadcast.
BROADCAST_ROWS = 1 << 20


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` of ``good + bad`` without replacement, for counts of any size.

    Inversion over the probabilities within 12 standard deviations (and 64) of the mode, from ratios of neighbours.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    n = good + bad
    mode = min(max((good + 1) * (draws + 1) // (n + 2), low), high)
    spread = int(12 * (draws * (good / n) * (bad / n) * ((n - draws) / max(n - 1, 1))) ** 0.5) + 64
    k = np.arange(max(low, mode - spread), min(high, mode + spread), dtype=np.float64)
    up = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(up)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return int(max(low, mode - spread) + np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """The communication matrix: a row for each partition, a column for each shard; its margins are the arguments."""
    rng, left = np.random.default_rng(seed), list(sizes)
    rows = []
    for count in counts:
        row, rest, todo = [], sum(left), count
        for have in left:
            x = hypergeometric(rng, have, rest - have, todo)
            row.append(x)
            rest, todo = rest - have, todo - x
        left = [have - x for have, x in zip(left, row)]
        rows.append(row)
    return rows


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Exact sizes of the shards, at most one row apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _counts(rows: DataFrame) -> tuple[dict[int, int], int]:
    """Rows by the finest partitions (FINE at most), and all rows."""
    fine = {r["p"]: r["n"] for r in rows.groupBy(F.pmod("__r1", F.lit(FINE)).alias("p")).agg(F.count("*").alias("n")).collect()}
    return fine, sum(fine.values())


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows, where those of which more than ALIKE are alike have random numbers of their own."""
    numbered = cut(rows.withColumn("__own", F.monotonically_increasing_id()))  # numbered once, as it is written
    many = cut(numbered.groupBy(F.col("__r1").alias("__many")).agg(F.count("*").alias("__n")).where(F.col("__n") > ALIKE).select("__many"))
    small = many.count() <= BROADCAST_ROWS
    found = numbered.join(F.broadcast(many) if small else many, F.col("__r1") == F.col("__many"), "left")
    dealt = {c: F.when(F.col("__many").isNull(), F.col(c)).otherwise(F.xxhash64(c, "__own")) for c in ("__r1", "__r2")}
    return found.withColumns(dealt).drop("__own", "__many")


def shard(df: DataFrame, keys: list[str], shards: int = 16, seed: int = 20_240_917) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard) to ``df``, uniformly at random.

    keys: columns that tell rows apart; rows alike in all of them are numbered and placed independently. Nulls are ordinary values.
    Columns named ``shard`` or ``slot`` are replaced; all others are kept as they are, texts of any length too. An empty table
    stays empty.
    """
    spark = df.sparkSession
    by = [F.col(f"`{k}`") for k in keys]
    rows = df.drop("shard", "slot").withColumns({"__r1": F.xxhash64(F.lit(seed), *by), "__r2": F.xxhash64(F.lit(seed + 1), *by)})
    fine, total = _counts(rows)
    if max(fine.values(), default=0) > ALIKE + 2 * total // FINE:  # only rows alike can fill one so
        rows = _dealt(rows)
        fine, total = _counts(rows)
    parts = FEWEST
    while parts < FINE and parts * ROWS_PER_PARTITION < total:
        parts *= 2
    counts = [sum(fine.get(f, 0) for f in range(p, FINE, parts)) for p in range(parts)]
    drawn = np.cumsum(matrix(counts, shard_sizes(total, shards), seed), axis=1).tolist()
    bounds = inline(spark, [{"__p": p, "__ends": ends} for p, ends in enumerate(drawn)], "__p:bigint,__ends:array<bigint>")

    alike = Window.partitionBy("__p").orderBy("__r1", *by)
    local = Window.partitionBy("__p").orderBy("__o", "__r1", "__same")
    sent = (
        rows.withColumn("__p", F.pmod("__r1", F.lit(parts)))
        .withColumn("__same", F.row_number().over(alike) - F.rank().over(alike))  # number among rows alike
        .withColumn("__o", F.xxhash64("__r1", "__same"))
        .withColumn("__k", F.row_number().over(local).cast("long"))
        .withColumn("__r2", F.xxhash64("__r2", "__same"))
        .join(F.broadcast(bounds), "__p")  # parts rows, FINE at most
        .withColumn("shard", F.size(F.filter("__ends", lambda end: end < F.col("__k"))))
        .withColumn("__piece", F.shiftrightunsigned("__r2", 64 - (parts.bit_length() - 1)))
        .drop("__p", "__k", "__ends", "__o")
    )
    pieces = sent.groupBy("shard", "__piece").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("shard", "__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    inside = Window.partitionBy("shard", "__piece").orderBy("__r2", "__r1", "__same")
    return (
        sent.withColumn("__i", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["shard", "__piece"])  # shards x FINE rows at most, 13 MB for 16 shards
        .withColumn("slot", F.col("__from") + F.col("__i") - 1)
        .select(*[c for c in df.columns if c not in ("shard", "slot")], "shard", "slot")
    )


def op2(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Contract columns of the sharding query: law ``rows``, so shard counts differ by one at most."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("text").alias("__text"))
    return shard(narrow, ["doc_id", "__text"], shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
