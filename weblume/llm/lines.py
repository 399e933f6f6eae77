"""Line dedup by winnowing over line hashes.

Lines are what is between line feeds. Of every RUN = GRAM + GUARD - 1 consecutive lines, the least hash of its GUARD grams of
GRAM lines (the last of equal ones) is selected as a fingerprint, so two equal runs of that many lines select the same one at
the same place. Fingerprint positions are joined; those of more than one position are extended both ways to all runs
that hold them, runs are compared by 128 bits, and every later occurrence of a run (by doc_id, then line) is deleted.

Longer repeats are unions of runs. All on DataFrame functions. Shorter ones stay: the query with every repeated line has single
lines for runs, of which repeats of any length are unions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled

GRAM, GUARD = 2, 3
RUN = GRAM + GUARD - 1


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def fingerprints(docs: DataFrame, gram: int = GRAM, guard: int = GUARD) -> DataFrame:
    """(id, d, fp, at, around, from): the selected fingerprint positions of each text, with the hashes of the lines from line
    ``from`` on that any run with this fingerprint can hold.

    docs: id, d (hash of the text), text.
    """
    run = gram + guard - 1
    hashed = docs.select("id", "d", F.transform(_lines("text"), lambda x: F.xxhash64(x)).alias("l")).where(F.size("l") >= run)
    grams = F.transform(F.sequence(F.lit(1), F.size("l") - gram + 1), lambda i: F.xxhash64(*[F.element_at("l", (i + k).cast("int")) for k in range(gram)]))
    spotted = hashed.withColumn("g", grams)
    least = F.transform(
        F.sequence(F.lit(1), F.size("g") - guard + 1),
        lambda s: -F.array_min(F.transform(F.sequence(F.lit(0), F.lit(guard - 1)), lambda j: F.struct(F.element_at("g", (s + j).cast("int")).alias("v"), (-(s + j)).alias("p"))))["p"],
    )
    chosen = spotted.select("id", "d", "l", "g", F.explode(F.array_distinct(least)).alias("p"))  # p: place of the gram, from 1
    first = F.greatest(F.col("p") - guard + 1, F.lit(1))
    around = F.slice("l", first, F.col("p") + run - first)
    return chosen.select("id", "d", F.element_at("g", F.col("p")).alias("fp"), (F.col("p") - 1).alias("at"), around.alias("around"), (first - 1).alias("from"))


def repeated_runs(docs: DataFrame, gram: int = GRAM, guard: int = GUARD) -> DataFrame:
    """(id, d, start): the runs that occur before, in a document with a smaller id or further up in the same."""
    run = gram + guard - 1
    joined = settled(fingerprints(docs, gram, guard), ["fp"], F.col("at"), ["id", "d"])
    shifts = F.sequence(F.lit(0), F.size("around") - run)
    keyed = F.transform(
        F.filter(shifts, lambda s: s >= 0),
        lambda s: F.struct((F.col("from") + s).alias("start"), F.xxhash64(F.lit(1), *[F.element_at("around", (s + 1 + k).cast("int")) for k in range(run)]).alias("r1"), F.xxhash64(F.lit(2), *[F.element_at("around", (s + 1 + k).cast("int")) for k in range(run)]).alias("r2")),
    )
    runs = joined.where(F.size("around") >= run).select("id", "d", F.inline(keyed)).distinct()
    return _late(runs, ["r1", "r2"])


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(id, d, start): the lines that occur before, as repeated_runs has them for runs of one line; compared by 128 bits."""
    lines = docs.select("id", "d", F.posexplode(_lines("text")).alias("start", "line"))
    return _late(lines.select("id", "d", "start", F.xxhash64(F.lit(1), "line").alias("r1"), F.xxhash64(F.lit(2), "line").alias("r2")), ["r1", "r2"])


def _late(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The (id, d, start) that aren't the least of their key."""
    place = F.struct("id", "start")
    return settled(rows, keys, place, ["id", "start"]).where(place > F.col("first")).select("id", "d", "start")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, guard: int = GUARD) -> DataFrame:
    """id, n_lines, n_removed and kept (the text of the lines that stay; null for a null text, which has no lines).

    An empty text is one empty line. Rows with a null id neither give nor lose lines. Repeated rows have equal results: rows
    that are alike in id and text count as one document. Lines and texts of any length are read whole; the lines of a text meet
    in one row, as they do in the input.
    """
    run = gram + guard - 1
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("d"))
    able = keyed.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "d", "text")
    gone = (
        (repeated_lines(able) if run == 1 else repeated_runs(able, gram, guard))
        .select("id", "d", F.explode(F.sequence("start", F.col("start") + run - 1)).alias("line"))
        .groupBy(F.col("id").alias("gid"), F.col("d").alias("gd")).agg(F.array_sort(F.collect_set("line")).alias("gone"))
    )
    # 1 for each line that goes: gaps of 0 between the sorted places
    flags = F.array_join(
        F.transform("gone", lambda x, i: F.concat(F.repeat(F.lit("0"), (x - F.when(i > 0, F.element_at("gone", F.greatest(i, F.lit(1)))).otherwise(F.lit(-1)) - 1).cast("int")), F.lit("1"))), ""
    )
    marked = keyed.join(gone.select("gid", "gd", F.split(flags, "").alias("flags")), (F.col("id") == F.col("gid")) & (F.col("d") == F.col("gd")), "left").withColumn("lines", _lines("text"))
    stays = F.filter("lines", lambda _, i: (i >= F.size("flags")) | (F.get("flags", i) != "1"))
    n = F.coalesce(F.size("lines"), F.lit(0))
    kept = F.when(F.col("flags").isNull(), F.col("lines")).otherwise(stays)
    out = marked.select("id", F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"), kept.alias("kept"), F.col("text").isNull().alias("none"))
    return out.select(
        F.col("id").alias(id_col), "n_lines", (F.col("n_lines") - F.when(F.col("none"), 0).otherwise(F.size("kept"))).cast("long").alias("n_removed"), F.array_join("kept", "\n").alias("kept")
    )


def op7(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 (of the lines that stay, joined by line feeds; of nothing for a null text)."""
    return dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op7_every_line(docs: DataFrame) -> DataFrame:
    """The columns of op7 where every later occurrence of a line is deleted, whatever the length of the repeat and the text."""
    return dedup(docs, gram=1, guard=1).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


#: The same by brute force: every run of four lines against every other.
ORACLE = r"""
WITH l AS (SELECT doc_id, coalesce(text, '') AS text, text IS NULL AS none, string_split(text, chr(10)) AS x FROM documents),
r AS (SELECT DISTINCT doc_id, text, i, list_slice(x, i, i + 3) AS t FROM (SELECT doc_id, text, x, unnest(generate_series(1, len(x) - 3)) AS i FROM l WHERE NOT none AND len(x) >= 4)),
f AS (SELECT doc_id, text, i, (doc_id, i) > min((doc_id, i)) OVER (PARTITION BY t) AS late FROM r WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, text, list(DISTINCT j) AS gone FROM (SELECT doc_id, text, unnest(generate_series(i, i + 3)) AS j FROM f WHERE late) GROUP BY ALL)
SELECT l.doc_id, CAST(CASE WHEN none THEN 0 ELSE len(x) END AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
 sha256(CASE WHEN gone IS NULL THEN l.text ELSE coalesce(array_to_string(list_filter(x, lambda v, i: NOT list_contains(gone, i)), chr(10)), '') END) AS kept_sha256
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.text = g.text
"""

#: Every line against every other.
ORACLE_EVERY_LINE = r"""
WITH l AS (SELECT doc_id, coalesce(text, '') AS text, text IS NULL AS none, string_split(text, chr(10)) AS x FROM documents),
r AS (SELECT DISTINCT doc_id, text, i, x[i] AS t FROM (SELECT doc_id, text, x, unnest(generate_series(1, len(x))) AS i FROM l WHERE NOT none)),
f AS (SELECT doc_id, text, i, (doc_id, i) > min((doc_id, i)) OVER (PARTITION BY t) AS late FROM r WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, text, list(DISTINCT i) AS gone FROM f WHERE late GROUP BY ALL)
SELECT l.doc_id, CAST(CASE WHEN none THEN 0 ELSE len(x) END AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
 sha256(CASE WHEN gone IS NULL THEN l.text ELSE coalesce(array_to_string(list_filter(x, lambda v, i: NOT list_contains(gone, i)), chr(10)), '') END) AS kept_sha256
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.text = g.text
"""
