"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: 64 majority bits over the XXH64 of all word shingles of a text. Texts with equal fingerprints are one vertex.

Candidates: the 64 bits are cut into BLOCKS runs. Fingerprints that differ in at most RADIUS bits agree in at least
BLOCKS - RADIUS whole runs, so they meet in a bucket for one of the C(BLOCKS, RADIUS) choices of runs: no link is lost.

Comparison: fingerprints are stored vertically, one bit set (bit plane) for each of the 64 bits, with a column for each
fingerprint. Small buckets lie side by side in one row of planes, which is compared with itself shifted by 1, 2, ... columns;
in a large bucket one fingerprint is compared with 64 columns per machine word at a time. The planes, complemented where the
other bit is 1, are added to bitwise counters (ones, twos, fours; what carries out of fours is over the radius) by carry-save
adders, and a block of columns is abandoned as soon as all of its distances exceed the radius. Large buckets are cut into
tiles by hash, and each pair of tiles is compared in a task of its own, so no task holds an unbounded bucket. From a
comparison comes a spanning forest of its links, not the pairs.

Components: large-star and small-star rounds over the links, cut by checkpoints.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SEED = 42
RADIUS = 4
#: Least number of runs that the 64 bits are cut into; with radius 4 and 6 runs, 15 buckets of about 21 bits for each fingerprint.
BLOCKS = 6
#: Fingerprints that a bucket should hold by chance; there are more runs, and so longer keys, where it would be more.
BUCKET = 256
#: Most fingerprints of a tile. A bucket of n is sent n / TILE times: one of ten million (a crowd of texts from one template) makes
#: 12 GB of rows and 190,000 comparisons of two tiles, of some seconds each.
TILE = 16384
#: Buckets up to so many fingerprints are compared many at a time.
SMALL = 16
#: Columns that are compared, and abandoned, together, and fingerprints that pass over them at a time.
COLUMNS, QUERIES = 4096, 128


def shingle_hashes(text: str | None, width: int = 4) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words, repeats included; of all words where there are fewer; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    whole, n = b" ".join(words), len(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    digest, view = xxhash.xxh64_intdigest, whole
    return np.fromiter([digest(view[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], dtype=np.uint64, count=n - width + 1)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: bit i is 1 where more than half of the hashes have it."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, carry: str | None = None) -> DataFrame:
    """id, the carried long column if one is named, and ``fp`` (long, the fingerprint's bits) of every row."""
    kept = [id_col] if carry is None else [id_col, carry]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([majority(shingle_hashes(t, width)) for t in batch.column(len(kept)).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(fps.view(np.int64), pa.int64())], names=[*kept, "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(*kept, text_col).mapInArrow(scan, f"{id_col} {kind}, {'' if carry is None else f'{carry} bigint, '}fp bigint")


def planes(fps: np.ndarray) -> np.ndarray:
    """64 x words bit planes: bit j of plane i is bit i of fingerprint j."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # fingerprints x 64
    padded = np.zeros((64, -(-len(fps) // 64) * 64), dtype=np.uint8)
    padded[:, : len(fps)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def _exceeds(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, over: np.ndarray, radius: int) -> np.ndarray:
    """Bitwise: where the counters hold more than ``radius`` (0 to 7)."""
    more = np.zeros_like(ones)
    for k, plane in enumerate((ones, twos, fours)):
        more = plane & more if radius >> k & 1 else plane | more
    return more | over


def near(fps: np.ndarray, vertical: np.ndarray, radius: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Compare some fingerprints with a block of n columns: (which of them have a near column, rows x n of 0 and 1).

    Planes that are the same in all columns and all of ``fps`` add nothing and are skipped; after every 8 others, those
    fingerprints are dropped from the block whose distances all exceed the radius.
    """
    words = vertical.shape[1]
    valid = np.full(words, ~np.uint64(0))
    if n % 64:
        valid[-1] = np.uint64((1 << (n % 64)) - 1)
    flat, none = fps[0] ^ fps, np.uint64(0)
    varied = int(np.bitwise_or.reduce(flat))
    first = int(fps[0])
    todo = [i for i in range(64) if varied >> i & 1 or ((vertical[i] ^ (~none if first >> i & 1 else none)) & valid).any()]
    rows = np.arange(len(fps))
    ones, twos, fours = (np.zeros((len(fps), words), dtype=np.uint64) for _ in range(3))
    over = np.broadcast_to(~valid, ones.shape).copy()
    for k in range(0, len(todo), 2):
        i = todo[k]
        a = vertical[i] ^ (none - (fps[rows] >> np.uint64(i) & np.uint64(1)))[:, None]
        if k + 1 < len(todo):
            i = todo[k + 1]
            b = vertical[i] ^ (none - (fps[rows] >> np.uint64(i) & np.uint64(1)))[:, None]
            half = a ^ b  # carry-save: ones + a + b
            carry = (a & b) | (ones & half)
            ones ^= half
        else:
            carry = ones & a
            ones ^= a
        carry2 = twos & carry
        twos ^= carry
        over |= fours & carry2  # eight or more
        fours ^= carry2
        if k % 8 == 6 or k + 2 >= len(todo):
            left = (~_exceeds(ones, twos, fours, over, radius)).any(axis=1)
            if not left.all():
                rows, ones, twos, fours, over = rows[left], ones[left], twos[left], fours[left], over[left]
            if not len(rows):
                return rows, np.zeros((0, n), dtype=np.uint8)
    hits = ~_exceeds(ones, twos, fours, over, radius)
    return rows, np.unpackbits(hits.view(np.uint8), axis=1, bitorder="little")[:, :n]


def forest(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``left`` (right is None) or between both: pairs of indices, right's after left's.

    Every fingerprint is compared; only the links that join two trees are kept, so dense groups make no more than one each.
    """
    m = len(left)
    cols, base = (left, 0) if right is None else (right, m)
    tree, out = np.arange(base + len(cols)), []
    for at in range(0, len(cols), COLUMNS):
        block = cols[at : at + COLUMNS]
        vertical, own = planes(block), slice(base + at, base + at + len(block))
        for start in range(0, m, QUERIES):
            rows, hits = near(left[start : start + QUERIES], vertical, radius, len(block))
            for i, hit in zip((rows + start).tolist(), hits):
                other = tree[own][hit.view(bool)]
                others = np.unique(other[other != tree[i]])
                for t in others.tolist():
                    j = int(np.flatnonzero(hit.view(bool) & (tree[own] == t))[0])
                    out.append((i, base + at + j))
                if len(others):
                    tree[np.isin(tree, others)] = tree[i]
    return out


def neighbours(fps: np.ndarray, group: np.ndarray, widest: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links within many small groups at once: pairs of indices. group: a number for each fingerprint, equal ones together.

    All fingerprints are one row of bit planes; the planes are compared with themselves shifted by 1, 2, ... columns, up to
    the size of the widest group. A shift is abandoned as soon as all pairs of one group in it exceed the radius.
    """
    vertical, n = planes(fps), len(fps)
    left, right = [], []
    for shift in range(1, widest):
        same = np.zeros(vertical.shape[1] * 64, dtype=np.uint8)
        same[: n - shift] = group[shift:] == group[:-shift]
        open_ = np.packbits(same, bitorder="little").view(np.uint64)
        if not open_.any():
            break
        after = np.zeros_like(vertical[0])
        ones, twos, fours, over = (np.zeros_like(after) for _ in range(4))
        for i, plane in enumerate(vertical):
            after = plane >> np.uint64(shift)  # groups are under 64 wide
            after[:-1] |= plane[1:] << np.uint64(64 - shift)
            x = plane ^ after
            carry = ones & x
            ones ^= x
            carry2 = twos & carry
            twos ^= carry
            over |= fours & carry2
            fours ^= carry2
            if i % 8 == 7 and not (open_ & ~_exceeds(ones, twos, fours, over, radius)).any():
                break
        else:
            hits = np.flatnonzero(np.unpackbits((open_ & ~_exceeds(ones, twos, fours, over, radius)).view(np.uint8), bitorder="little"))
            left.append(hits)
            right.append(hits + shift)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def block_count(n: int, radius: int = RADIUS) -> int:
    """Number of runs for n fingerprints: the fewest whose keys are long enough. Links don't depend on it."""
    need, blocks = math.log2(max(n, 1) / BUCKET), max(BLOCKS, radius + 1)
    while 64 * (blocks - radius) / blocks < need and blocks < 2 * radius + 4:
        blocks += 1
    return blocks


def links(vertices: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """(a, b): links of ``vertices`` (id long, fp long, distinct fingerprints) that span every component."""
    if not 0 <= radius < blocks or radius > 6:
        raise ValueError("the radius must be under the number of blocks, and 6 at most")
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [sum(((1 << edges[k + 1]) - (1 << edges[k])) for k in chosen) for chosen in itertools.combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    bucketed = vertices.select("id", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("choice", "bits"))
    sizes = bucketed.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1")
    pieces = F.ceil(F.col("n") / F.lit(float(tile))).cast("int")
    tiled = bucketed.join(sizes, ["choice", "bits"]).withColumn("pieces", pieces).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda o: F.struct(F.least("piece", o).alias("x"), F.greatest("piece", o).alias("y")))
    sent = tiled.select("choice", "bits", "id", "fp", "piece", F.explode(pair).alias("pair")).select("choice", "bits", F.col("pair.x").alias("x"), F.col("pair.y").alias("y"), "piece", "id", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (choice, bits, x, y); a group may span batches."""
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*held, *([batch] if batch is not None else [])]) if held or batch is not None else None
            if whole is None or not whole.num_rows:
                continue
            key = [whole[c].to_numpy() for c in ("choice", "bits", "x", "y")]
            change = np.zeros(whole.num_rows - 1, dtype=bool)
            for k in key:
                change |= k[1:] != k[:-1]
            starts = np.concatenate([[0], np.flatnonzero(change) + 1, [whole.num_rows]])
            last = len(starts) - 1 if batch is None else len(starts) - 2  # the last group may go on
            ids, fps, piece = whole["id"].to_numpy(), whole["fp"].to_numpy().view(np.uint64), whole["piece"].to_numpy()
            a_out, b_out = [], []
            sizes = np.diff(starts[: last + 1])
            small = (sizes <= SMALL) & (key[2][starts[:last]] == key[3][starts[:last]])  # one tile
            if small.any():
                number = np.repeat(np.arange(last), sizes)
                rows = np.flatnonzero(small[number])
                i, j = neighbours(fps[rows], number[rows], int(sizes[small].max()), radius)
                a_out += ids[rows[i]].tolist()
                b_out += ids[rows[j]].tolist()
            for g in np.flatnonzero(~small).tolist():
                s, e = int(starts[g]), int(starts[g + 1])
                x, y = key[2][s], key[3][s]
                side = piece[s:e] == x
                order = np.concatenate([np.flatnonzero(side), np.flatnonzero(~side)]) + s
                m = int(side.sum())
                left, right = fps[order[:m]], (None if x == y else fps[order[m:]])
                if len(left) == 0 or (right is not None and len(right) == 0):
                    continue
                for i, j in forest(left, right, radius):
                    a_out.append(int(ids[order[i]]))
                    b_out.append(int(ids[order[j]]))
            rest = whole.slice(int(starts[last]))
            held = rest.combine_chunks().to_batches() if batch is not None else []
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    by = ["choice", "bits", "x", "y"]
    return sent.repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, "a bigint, b bigint").distinct()


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each id of ``pairs`` (a, b) can reach. Ids without a pair aren't listed.

    Large-star and small-star rounds until nothing changes; a path of n ids takes about log2(n) rounds.
    """
    now = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    for _ in range(rounds):
        # large-star: each neighbour larger than u is linked to the least of u and its neighbours
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: u and its smaller neighbours are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = cut(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def classes(marked: DataFrame, id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of ``marked`` (id, fp): the smallest id that it can reach."""
    vertices = cut(marked.groupBy("fp").agg(F.min(id_col).alias("id")))
    numbered = vertices.where(F.col("id").isNotNull())
    found = components(links(numbered, radius, block_count(numbered.count(), radius))).withColumnRenamed("id", "__id")
    return vertices.join(found, F.col("id") == F.col("__id"), "left").select("fp", F.coalesce("component", "id").alias("component_id"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = RADIUS) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id of every row.

    Texts without words (null, empty or white space) have fingerprint 0 and link as others do; texts are read whole, whatever
    their length. Repeated rows have equal results. No other column is read, and an empty table stays empty. Rows whose id is null count only where no row of their fingerprint has an id; their component is then null.
    """
    marked = cut(fingerprints(df, id_col, text_col, width))
    named = classes(marked, id_col, radius)
    return marked.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns: the one with the smallest id.

    Where all ids of a fingerprint are null, one row of it stays.
    """
    hashed = docs.select(id_col, text_col, F.xxhash64(text_col).alias("th"))
    marked = cut(fingerprints(hashed, id_col, text_col, width, "th"))
    named = marked.join(classes(marked, id_col, radius), "fp").withColumn("nameless", F.when(F.col("component_id").isNull(), F.col("fp")))
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("kid"), F.col("th").alias("kth"))).alias("first")
    kept = named.groupBy("component_id", "nameless").agg(first).select("first.kid", "first.kth")
    staying = docs.join(kept, docs[id_col].eqNullSafe(F.col("kid")) & (F.xxhash64(docs[text_col]) == F.col("kth")), "left_semi")
    return staying.withColumn("__th", F.xxhash64(text_col)).dropDuplicates([id_col, "__th"]).drop("__th")


def op8(docs: DataFrame) -> DataFrame:
    """Contract columns of the SimHash query."""
    return near_duplicates(docs)
