"""Benchmark decontamination by a distributed positional inverted index.

Terms: A-Z in lower case; a term is a run of digits, a-z and characters outside ASCII. A window is ``width`` consecutive terms
of a benchmark item; an item of fewer terms, but not none, is one window.

1. The frequencies of the benchmark's terms are counted over all training documents (partial counts before the shuffle), and
   the terms of each window are put in order from the rarest. A window with a term that no document has can't occur.
2. Postings (document, term, position) of the RAREST rarest terms of the windows are stored, one list of positions for each
   document and term. They are cut from the texts where these lie; only postings leave their task.
3. The lists are intersected from the rarest on: a position less the term's offset is a start of the window, and starts stay
   that all lists have. For proximity, a list has a start if it has a position near the term's place.
4. The window's other terms are looked up at their places in the documents that have starts left.

All on DataFrame functions. Documents are told apart by their id and a hash of their text, so nothing meets in one key but
equal rows. Tables of windows and terms are broadcast up to BROADCAST_BYTES, tables of matches up to BROADCAST_ROWS rows;
beyond that they are joined by shuffles, without the corpus's most frequent terms where no window's list needs them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WIDTH = 13
#: Terms of a window whose lists are intersected; windows of few different terms have fewer.
RAREST = 3
#: Bytes of a table of windows or terms that is broadcast (64 for each row, and its texts), and rows (of 32 bytes) of a table of matches.
BROADCAST_BYTES, BROADCAST_ROWS = 64 << 20, 1 << 20
#: Frequent terms that are left out before a shuffle of postings where no list is kept for them.
FREQUENT = 1000
#: The term of the one posting that each document has besides its own; no text has it.
_END = "\x00"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["id", "text_hash"]


def terms(text: Column) -> Column:
    """The array of a text's terms; empty for null."""
    ascii_ = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.split(F.coalesce(low, F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokenised(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``__t`` (terms, where the first and the last may be empty), ``__lead`` (1 if the first is) and ``__n`` (number of terms)."""
    out = df.withColumn("__t", terms(F.col(text_col)))
    lead = F.when(F.col("__t")[0] == "", 1).otherwise(0)
    trail = F.when((F.size("__t") > 1) & (F.element_at("__t", -1) == ""), 1).otherwise(0)
    return out.withColumn("__lead", lead).withColumn("__n", F.size("__t") - lead - trail)


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, terms): the distinct windows of all items; items without terms and without an id have none."""
    items = tokenised(benchmark.where(F.col("item_id").isNotNull()).select("item_id", "text")).where("__n > 0")
    words = F.slice("__t", F.col("__lead") + 1, F.col("__n"))
    starts = F.sequence(F.lit(1), F.greatest(F.col("__n") - width + 1, F.lit(1)))
    return items.select("item_id", words.alias("words"), F.explode(starts).alias("at")).select("item_id", F.slice("words", F.col("at"), width).alias("terms")).distinct()


def _fits(df: DataFrame, texts: Column) -> bool:
    """Whether a table with some bytes of text in each row is small enough to be broadcast."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(texts), F.lit(0))).first()
    return 64 * rows + size <= BROADCAST_BYTES


def _hint(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


@dataclass
class Plan:
    """Windows: w (a number), size, items and ``order``: their different terms from the rarest on, as (n, offset, term, offsets).

    small: whether the table may be broadcast. terms: those whose postings are stored; few: whether these may be. frequency:
    (term, n) of the benchmark's terms that occur.
    """

    windows: DataFrame
    small: bool
    terms: DataFrame
    few: bool
    frequency: DataFrame


def planned(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text_col: str = "text") -> Plan:
    """The distinct windows of the benchmark that may occur in the documents, with their terms in order."""
    made = cut(windows(benchmark, width).groupBy("terms").agg(F.collect_set("item_id").alias("items")).withColumn("w", F.monotonically_increasing_id()))  # numbered once, as it is written
    vocabulary = cut(made.select(F.explode("terms").alias("term")).distinct())
    told = docs.select(F.explode(terms(F.col(text_col))).alias("term"))
    if _fits(vocabulary, F.octet_length("term")):
        counted = told.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count("*").alias("n"))
    else:
        counted = told.groupBy("term").agg(F.count("*").alias("n")).join(vocabulary, "term")
    frequency = cut(counted)
    small = _fits(made, F.aggregate("terms", F.lit(0), lambda a, t: a + F.octet_length(t) + 32) + 16 * F.size("items"))
    places = made.select("w", F.posexplode("terms").alias("offset", "term")).groupBy("w", "term").agg(F.array_sort(F.collect_list("offset")).alias("offsets"))
    entry = F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("offsets")[0].alias("offset"), "term", "offsets")
    order = places.join(_hint(frequency, small), "term", "left").groupBy("w").agg(F.array_sort(F.collect_list(entry)).alias("order"))
    whole = cut(order.where(F.col("order")[0]["n"] > 0).join(made.select("w", F.size("terms").alias("size"), "items"), "w"))
    kept = cut(whole.select(F.explode(F.slice("order", 1, RAREST)).alias("e")).select("e.term").distinct())
    return Plan(whole, small, kept, _fits(kept, F.octet_length("term")), frequency)


def postings(docs: DataFrame, plan: Plan, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, text_hash, n_words) of every row of docs, and the index: (id, text_hash, term, positions), positions from 0."""
    body = tokenised(docs, text_col).select(*_KEY, F.col("__n").alias("n_words"), "__t", "__lead")
    if plan.few:  # one pass yields both
        end = docs.sparkSession.range(0, 1, 1, 1).select(F.lit(_END).alias("term"))
        read = body.select(*_KEY, "n_words", "__lead", F.posexplode(F.array_append("__t", F.lit(_END))).alias("at", "term"))
        found = cut(read.join(F.broadcast(plan.terms.unionByName(end)), "term").select(*_KEY, "n_words", "term", (F.col("at") - F.col("__lead")).alias("at")))
        rows, posted = found.where(F.col("term") == _END).select(*_KEY, "n_words"), found.where(F.col("term") != _END)
    else:
        rows = body.select(*_KEY, "n_words")
        idle = plan.frequency.orderBy(F.desc("n")).limit(FREQUENT).join(plan.terms, "term", "left_anti").select("term")
        read = body.select(*_KEY, F.posexplode("__t").alias("at", "term"), "__lead").join(F.broadcast(idle), "term", "left_anti")  # FREQUENT rows
        posted = read.join(plan.terms, "term").select(*_KEY, "term", (F.col("at") - F.col("__lead")).alias("at"))
    return rows, cut(posted.groupBy(*_KEY, "term").agg(F.array_sort(F.collect_set("at")).alias("positions")))


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["id"].eqNullSafe(right["id"]) & (left["text_hash"] == right["text_hash"])


def starts(index: DataFrame, plan: Plan, slack: int = 0) -> DataFrame:
    """(id, text_hash, w, start): starts of windows that all their stored lists have."""

    def shifted(positions: Column, offsets: Column) -> Column:
        """Starts that a list allows: every offset of its term has a position there, or within ``slack`` of there."""
        near = positions if slack == 0 else F.array_distinct(F.flatten(F.transform(positions, lambda p: F.sequence(p - slack, p + slack))))
        each = F.transform(offsets, lambda o: F.transform(near, lambda p: p - o))
        return F.aggregate(F.slice(each, 2, F.size(each)), each[0], lambda a, b: F.array_intersect(a, b))

    first = plan.windows.select("w", F.col("order")[0]["term"].alias("term"), F.col("order")[0]["offsets"].alias("offsets"), F.slice("order", 2, RAREST - 1).alias("rest"))
    rarest = index.join(_hint(first, plan.small), "term")
    exact = F.transform("positions", lambda p: p - F.col("offsets")[0])  # the rarest term's first use stands in its place
    begun = F.filter(exact if slack else shifted(F.col("positions"), F.col("offsets")), lambda s: s >= (-slack if slack else 0))
    found = rarest.select(*_KEY, "w", begun.alias("starts"), F.explode_outer("rest").alias("e")).where(F.size("starts") > 0)
    left = found.select(*_KEY, "w", "starts", F.col("e.term").alias("need"), F.col("e.offsets").alias("offsets"))
    met = left.join(index, _same(left, index) & (left["need"] == index["term"]), "left")
    kept = F.when(F.col("need").isNull(), F.col("starts")).otherwise(F.array_intersect("starts", F.coalesce(shifted(F.col("positions"), F.col("offsets")), F.array().cast("array<int>"))))
    some = met.select(left["id"], left["text_hash"], "w", kept.alias("starts"))
    lists = some.groupBy(*_KEY, "w").agg(F.collect_list("starts").alias("lists"))  # RAREST - 1 lists at most
    whole = F.aggregate(F.slice("lists", 2, RAREST), F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
    return lists.select(*_KEY, "w", F.explode(whole).alias("start"))


def _in_place(e: Column) -> Column:
    """Whether all uses of a term of the window stand at their places."""
    return F.forall(e["offsets"], lambda o: F.coalesce(F.get("__t", F.col("start") + F.col("__lead") + o) == e["term"], F.lit(False)))


def _nearby(slack: int):
    """Whether each use of a term of the window has a posting of its own within ``slack`` of its place; the first that is free is taken."""

    def near(e: Column) -> Column:
        first = F.greatest(F.col("start") - slack, F.lit(0))
        around = F.slice("__t", first + F.col("__lead") + 1, F.greatest(F.col("start") + F.col("size") + slack - first, F.lit(0)))
        found = F.filter(F.transform(around, lambda t, i: F.when(t == e["term"], i + first)), lambda p: p.isNotNull())

        def take(a: Column, o: Column) -> Column:
            place = F.col("start") + o
            free = F.array_min(F.filter(found, lambda p: (p > a["last"]) & (p >= place - slack) & (p <= place + slack)))
            return F.struct(F.coalesce(free, F.lit(-1)).alias("last"), (a["ok"] & free.isNotNull()).alias("ok"))

        return F.aggregate(e["offsets"], F.struct(F.lit(-1).alias("last"), F.lit(True).alias("ok")), take)["ok"]

    return near


def occurrences(docs: DataFrame, index: DataFrame, plan: Plan, slack: int = 0, text_col: str = "text") -> DataFrame:
    """(id, text_hash, start, size, items) of every window that a document has, start counting terms from 0."""
    begun = cut(starts(index, plan, slack))
    n, test = begun.count(), _nearby(slack) if slack else _in_place
    rest = F.col("order") if slack else F.slice("order", RAREST + 1, F.greatest(F.size("order"), F.lit(1)))
    told = plan.windows.select("w", "size", rest.alias("rest"))
    # the windows' terms stay out of the rows of documents where they can be broadcast
    one = begun.select(*_KEY, F.struct("w", "start").alias("c")) if plan.small else begun.join(told, "w").select(*_KEY, F.struct("w", "start", "size", "rest").alias("c"))
    held = one.groupBy(*_KEY).agg(F.collect_list("c").alias("c"))
    texts = docs.dropDuplicates(_KEY) if n > BROADCAST_ROWS else docs
    met = texts.join(_hint(held, n <= BROADCAST_ROWS), _same(docs, held)).select(docs["id"], docs["text_hash"], text_col, "c")
    each = tokenised(met, text_col).select(*_KEY, "__t", "__lead", F.inline("c"))
    each = each.join(F.broadcast(told), "w") if plan.small else each
    right = each.where(F.forall("rest", test)).select(*_KEY, "w", "start").distinct()
    return right.join(_hint(plan.windows.select("w", "size", "items"), plan.small), "w").drop("w")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash and text; nothing else is read."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))


def near(docs: DataFrame, benchmark: DataFrame, slack: int = 5, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Proximity matches: (id, start, size, items) where every term of a window, each use by a position of its own, lies within
    ``slack`` terms of its place; the first use of the window's rarest term (of equally rare ones the first) stands in its place.
    The text may begin up to ``slack`` terms after the start, which may then be negative. Exact phrases are among the matches.
    """
    slim = keyed(docs, id_col, text_col)
    plan = planned(slim, benchmark, width)
    _, index = postings(slim, plan)
    return occurrences(slim, index, plan, slack).select(F.col("id").alias(id_col), "start", "size", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", keep_repeats: bool = True) -> DataFrame:
    """id, ``text_hash``, n_words, n_hit, items (sorted strings) and contaminated, for every document.

    A document word is hit if it lies in any occurrence of a window; a document is contaminated where words are hit, and those
    are a twentieth of its words or more. Null texts have no words, ids may be null. Repeated rows get a row each, or one with
    keep_repeats off. Texts and terms of any length are read whole. Without benchmark rows nothing is hit.
    """
    slim = keyed(docs, id_col, text_col)
    plan = planned(slim, benchmark, width)
    rows, index = postings(slim, plan)
    found = occurrences(slim, index, plan)
    ends = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))

    def add(done: Column, span: Column) -> Column:
        new = F.greatest(span["end"] - F.greatest(span["start"], done["upto"]), F.lit(0))
        return F.struct((done["n"] + new).alias("n"), F.greatest(done["upto"], span["end"]).alias("upto"))

    none = F.array().cast("array<string>")
    hits = found.groupBy(*_KEY).agg(
        F.aggregate(ends, zero, add)["n"].cast("long").alias("hit"),
        F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("items"))), lambda i: i.cast("string"))).alias("held"),
    )
    rows = rows if keep_repeats else rows.distinct()
    out = rows.join(hits, _same(rows, hits), "left").select(rows["id"].alias(id_col), rows["text_hash"], F.col("n_words").cast("long").alias("n_words"), F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("held", none).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def op5(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contract columns of the decontamination query."""
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op5_proximity(docs: DataFrame, benchmark: DataFrame, slack: int = 3) -> DataFrame:
    """doc_id, n_starts (proximity matches) and n_items (items that have one) of the documents that have any."""
    found = near(docs, benchmark, slack)
    each = found.select("doc_id", "start", "size", F.explode("items").alias("item"))
    return each.groupBy("doc_id").agg(F.countDistinct("start", "size").alias("n_starts"), F.countDistinct("item").alias("n_items"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    judged = cut(contamination(docs, benchmark, keep_repeats=False).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")))
    return docs.join(_hint(judged, judged.count() <= BROADCAST_ROWS), docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash")), "left_anti")


#: The same in SQL for DuckDB: every word position of the documents against every window, by lists.
ORACLE = r"""
WITH tok AS (SELECT doc_id, rn, w FROM (SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, list_slice(w, i, i + 12) AS t FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(t) AS m FROM win),
pos AS (SELECT rn, i, m, list_slice(w, i, i + m - 1) AS t FROM (SELECT rn, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM tok, sizes WHERE len(w) >= m)),
occ AS (SELECT p.rn, p.i, p.m, win.item_id FROM pos p JOIN win ON win.t = p.t),
hit AS (SELECT rn, count(DISTINCT j) AS n FROM (SELECT rn, unnest(generate_series(i, i + m - 1)) AS j FROM occ) GROUP BY rn),
its AS (SELECT rn, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rn, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
 sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM tok LEFT JOIN hit USING (rn) LEFT JOIN its USING (rn)
"""
