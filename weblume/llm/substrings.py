"""Substring dedup by difference-cover anchors.

A word is removed if it lies in a window of WINDOW consecutive words whose word sequence also starts in a document with a
smaller id. Windows are judged on the input.

Cover: the residues COVER modulo PERIOD are a perfect difference set: for any two positions there is a shift under PERIOD that
takes both to residues of the cover. So two equal windows share an anchor, a run of WINDOW - PERIOD + 1 words at cover positions
of both texts, and only a fifth of all positions are hashed and sent.

1. Anchors (hash, text) are sent to their hash; those of more than one text are kept.
2. Matches are extended: in each text every window that holds a shared anchor gets a 128-bit hash of all its words.
3. The least document id of each such window is found; windows that have a smaller one than their own cover removed words.

Equal texts are one text until the end: copies of a document with a smaller id lose all windows at once, so groups of copies
don't grow the exchanges. Word and window hashes are prefix sums over whole batches of texts.

Long texts are read in segments of CHUNK bytes that overlap by the words of a window, so memory is bounded by CHUNK (and the
longest word) and not by the text. A task remembers up to MOST anchors and windows that it has settled: a frequent one is sent
to its key once or a few times a task, and else to keys that are dealt by its texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import words_count

WINDOW = 50
#: A perfect difference set: the differences of its members give each residue but 0 once.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Bytes of text that are hashed together; a longer text is hashed in segments.
CHUNK = 1 << 20
#: Settled anchors, and windows, that a task remembers.
MOST = 1 << 20

_SPACES, _WORD = re.compile(rb"[\x20\x09-\x0D]+"), re.compile(rb"[^\x20\x09-\x0D]+")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as many as were needed so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                powers = np.full(n, base, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(b) for b in _BASES]


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


class Words:
    """The words of some pieces of text (bytes): hash, owner, place in the owner's piece; first word and number of words of each
    piece, and ``base``, the words of its text before it."""

    def __init__(self, texts: list[bytes], base: list[int] | None = None):
        self.base = np.array(base if base is not None else [0] * len(texts), dtype=np.int64)
        raw = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
        space = _SPACE[raw]
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        self.starts, self.ends = starts, np.flatnonzero(~space[:-1] & space[1:]) + 1
        up, down = _POWERS[0].upto(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
        self.hash = _mix((sums[self.ends] - sums[starts]) * down[starts] + (self.ends - starts).astype(np.uint64))
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])  # of the text, before its first byte
        self.first = np.searchsorted(starts, begins[:-1], side="right")
        after = np.append(self.first[1:], len(starts))
        self.count = after - self.first
        self.owner = np.repeat(np.arange(len(texts)), self.count)
        self.place = np.arange(len(starts)) - self.first[self.owner]

    def runs(self, width: int, which: int) -> np.ndarray:
        """Hashes of the runs of ``width`` words from each word on; runs that leave the batch are left out."""
        n = len(self.hash)
        up, down = _POWERS[which].upto(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.hash * up[:n], out=sums[1:])
        m = max(0, n - width + 1)
        return _mix((sums[width : width + m] - sums[:m]) * down[:m])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(word indices, hashes) at the cover positions of texts that have a window."""
        width = WINDOW - PERIOD + 1
        hashes = self.runs(width, 1)
        m = len(hashes)
        cover = np.zeros(PERIOD, dtype=bool)
        cover[list(COVER)] = True
        count = self.count[self.owner[:m]]
        at = np.flatnonzero(cover[(self.place[:m] + self.base[self.owner[:m]]) % PERIOD] & (count >= WINDOW) & (self.place[:m] + width <= count))
        return at, hashes[at]


def _segments(text: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(piece, words before it, words of its own): pieces that overlap by the words that a window may reach into the next."""
    at = base = 0
    while at < len(text):
        m = _SPACES.search(text, at + CHUNK)
        end = m.start() if m else len(text)
        tail, more = end, _WORD.finditer(text, end)
        for _ in range(WINDOW - 1):
            if (w := next(more, None)) is None:
                break
            tail = w.end()
        space = _SPACE[np.frombuffer(b" " + text[at:end], dtype=np.uint8)]
        own = int(np.count_nonzero(space[:-1] & ~space[1:]))
        yield text[at:tail], base, own
        at, base = end, base + own


def _chunks(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes], list[int], list[int]]]:
    """(numbers of their texts, pieces, words before each, own words of each), about CHUNK bytes together; -1 is all words."""
    held: list[tuple[int, bytes, int, int]] = []
    size = 0
    for i, t in enumerate(texts):
        for piece, base, own in [(t, 0, -1)] if len(t) <= 2 * CHUNK else _segments(t):
            if held and size + len(piece) > CHUNK:
                yield tuple(map(list, zip(*held)))
                held, size = [], 0
            held.append((i, piece, base, own))
            size += len(piece)
    if held:
        yield tuple(map(list, zip(*held)))


class _Seen:
    """Numbers that a task has met, MOST at most; then the older ones are forgotten."""

    def __init__(self):
        self.held = [np.zeros(0, dtype=np.int64)] * 2

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=bool)
        for held in self.held:
            if len(held):
                out |= held[np.minimum(held.searchsorted(keys), len(held) - 1)] == keys
        return out

    def add(self, keys: np.ndarray) -> None:
        old, new = self.held
        new = np.union1d(new, keys)
        if len(new) > MOST // 16:
            old, new = (np.union1d(old, new) if len(old) + len(new) <= MOST else new), new[:0]
        self.held = [old, new]


def _bytes(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where the rows of sorted columns differ from the row before."""
    new = np.ones(len(sorted_keys[0]), dtype=bool)
    new[1:] = False
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def _salt(keys: np.ndarray) -> np.ndarray:
    """An odd 32-bit number of each key."""
    return ((keys ^ (keys >> 32)) & 0x7FFFFFFF).astype(np.int32) | 1


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, text) to distinct (h, d, salt). One text of a chunk with an anchor is sent with salt 0; where the chunk has more, all of
    them are sent with another salt, as theirs is known to be shared. Later chunks of the task send theirs with such a salt only,
    so a frequent anchor has few rows of salt 0."""
    seen = _Seen()
    for batch in batches:
        ids = batch.column(0).to_numpy()
        _, new = np.unique(ids, return_index=True)  # copies in one batch count once
        texts = _bytes(batch.column(1).take(pa.array(new)))
        for number, some, base, _ in _chunks(texts):
            words = Words(some, base)
            where, hashes = words.anchors()
            if not len(where):
                continue
            own, hashes = ids[new[np.array(number)[words.owner[where]]]], hashes.view(np.int64)
            order = np.lexsort((own, hashes))
            own, hashes = own[order], hashes[order]
            once = _starts(hashes, own)
            own, hashes = own[once], hashes[once]
            first = _starts(hashes)
            sizes = np.diff(np.append(np.flatnonzero(first), len(first)))
            known = seen.has(hashes[first])
            seen.add(hashes[first][(sizes > 1) & ~known])
            alone, many = first & ~np.repeat(known, sizes), np.repeat((sizes > 1) | known, sizes)
            h, d = np.concatenate([hashes[alone], hashes[many]]), np.concatenate([own[alone], own[many]])
            salt = np.concatenate([np.zeros(int(alone.sum()), dtype=np.int32), _salt(own[many])])
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(d), pa.array(salt)], names=["h", "d", "salt"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, k, text, shared) to (g1, g2, id, k, at, more, salt): windows that hold a shared anchor, where they are first, and
    elsewhere. The salt isn't 0 where the task has met the window with a smaller id, which settles it."""
    seen, least_of = _Seen(), {}
    for batch in batches:
        texts = _bytes(batch.column(2))
        for number, some, base, own_words in _chunks(texts):
            number, words = np.array(number), Words(some, base)
            where, hashes = words.anchors()
            known = [np.asarray(batch.column(3)[int(i)].as_py(), dtype=np.int64) for i in number]
            spread = np.zeros(len(words.hash) + 1, dtype=np.int64)
            owner = words.owner[where]
            edges = np.searchsorted(owner, np.arange(len(some) + 1))
            for i, own in enumerate(known):
                a, b = edges[i], edges[i + 1]
                hit = where[a:b][np.isin(hashes[a:b].view(np.int64), own)]
                if len(hit):
                    first = words.first[i]
                    np.add.at(spread, np.maximum(hit - (PERIOD - 1), first), 1)
                    np.add.at(spread, np.minimum(hit, first + words.count[i] - WINDOW) + 1, -1)
            limit = np.where(np.array(own_words) < 0, words.count, own_words)  # windows that begin in the overlap are the next piece's
            at = np.flatnonzero(np.cumsum(spread)[:-1] > 0)
            at = at[words.place[at] < limit[words.owner[at]]]
            if len(at):
                g1, g2 = (words.runs(WINDOW, w)[at].view(np.int64) for w in (1, 2))
                order = np.lexsort((at, g2, g1, number[words.owner[at]]))  # windows that a text repeats come together
                at, g1, g2 = at[order], g1[order], g2[order]
                own = number[words.owner[at]]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1]) | (own[1:] != own[:-1])
                heads = np.flatnonzero(new)
                sizes = np.diff(np.append(heads, len(at)))
                place = (words.place[at] + words.base[words.owner[at]]).astype(np.int32)
                more = [None] * len(heads)
                for j in np.flatnonzero(sizes > 1).tolist():
                    more[j] = place[heads[j] + 1 : heads[j] + sizes[j]]
                rows = pa.array(own[heads])
                ids, salt = batch.column(0).take(rows), np.zeros(len(heads), dtype=np.int32)
                if pa.types.is_integer(ids.type) and not ids.null_count:
                    value, h1, h2 = ids.to_numpy().astype(np.int64), g1[heads], g2[heads]
                    by = np.lexsort((value, h2, h1))
                    first = np.flatnonzero(_starts(h1[by], h2[by]))
                    many = np.diff(np.append(first, len(by)))
                    least, top = value[by][first], by[first]
                    for j in np.flatnonzero(seen.has(h1[top])).tolist():  # met before in this task
                        if (before := least_of.get((int(h1[top[j]]), int(h2[top[j]])))) is not None:
                            least[j] = min(least[j], before)
                    told = np.flatnonzero(many > 1)
                    seen.add(h1[top[told]])
                    if len(least_of) > MOST:
                        least_of.clear()
                    least_of.update(zip(zip(h1[top[told]].tolist(), h2[top[told]].tolist()), least[told].tolist()))
                    late = value[by] > np.repeat(least, many)
                    salt[by[late]] = _salt(value[by][late])
                columns = [pa.array(g1[heads]), pa.array(g2[heads]), ids, batch.column(1).take(rows), pa.array(place[heads]), pa.array(more, pa.list_(pa.int32())), pa.array(salt)]
                yield pa.RecordBatch.from_arrays(columns, names=["g1", "g2", "id", "k", "at", "more", "salt"])


def removed(n: int, starts: np.ndarray) -> np.ndarray:
    """Which of n words lie in windows that begin at ``starts``."""
    spread = np.zeros(n + 1, dtype=np.int64)
    np.add.at(spread, starts, 1)
    np.add.at(spread, starts + WINDOW, -1)
    return np.cumsum(spread)[:n] > 0


def _result_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, copy, starts) to (id, n_words, n_removed, kept)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows = []
            for text, copy, starts in zip(_bytes(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist()):
                words = text.split()
                n = len(words)
                if copy and n >= WINDOW:
                    rows.append((n, n, ""))
                    continue
                if starts and not copy:
                    gone = removed(n, np.asarray(starts))
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                rows.append((n, n - len(words), b" ".join(words).decode("utf-8", "surrogatepass")))
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed and kept (the words that stay, joined by a space) of every document.

    Null texts have no words. A null id is neither smaller nor larger than another, so such a document keeps its words and
    takes none. Repeated rows have equal results. Texts are told apart by 128 bits of hashes, windows by 128 bits. Texts of any
    length are read whole, in segments. An empty table stays empty, and no other column is read.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("d"), F.xxhash64(F.lit(1), text_col).alias("e"))
    kind = docs.schema[id_col].dataType.simpleString()
    # texts and their copies
    slim = keyed.where(words_count(F.col("text")) >= WINDOW).select("id", "d", "e").distinct()
    firsts = slim.groupBy("d", "e").agg(F.min("id").alias("first"))
    # anchors of more than one text
    anchors = keyed.select("d", "text").mapInArrow(_anchor_rows, "h bigint, d bigint, salt int")
    same = Window.partitionBy("h", "salt")
    shared = anchors.withColumn("__a", F.min("d").over(same)).withColumn("__b", F.max("d").over(same)).where("__a <> __b or salt <> 0")
    held = shared.groupBy("d").agg(F.collect_set("h").alias("shared"))
    # windows that hold one, in the first document of each text
    status = slim.join(firsts, ["d", "e"]).join(held, "d", "left")
    copy = F.coalesce(F.col("first") < F.col("id"), F.lit(False))
    marked = status.select(F.xxhash64("id", "d").alias("skey"), F.col("id").alias("sid"), F.col("e").alias("se"), F.hash("d").alias("k"), copy.alias("copy"), "shared")
    body = keyed.select("id", "text", "e", F.xxhash64("id", "d").alias("key"))  # both joins below read one exchange of this
    same_row = (F.col("key") == F.col("skey")) & F.col("id").eqNullSafe(F.col("sid")) & (F.col("e") == F.col("se"))
    wanted = marked.where(~F.col("copy") & F.col("shared").isNotNull()).drop("copy")
    opened = body.join(wanted, same_row).select("id", "k", "text", "shared")
    windows = opened.mapInArrow(_window_rows, f"g1 bigint, g2 bigint, id {kind}, k int, at int, more array<int>, salt int")
    least = F.min("id").over(Window.partitionBy("g1", "g2", "salt"))
    late = windows.withColumn("least", least).where("least < id or salt <> 0").groupBy(F.col("id").alias("lid"), F.col("k").alias("lk")).agg(F.collect_set("at").alias("first"), F.flatten(F.collect_list("more")).alias("more"))
    # what stays
    starts = F.array_union("first_", "more_").alias("starts")
    late = late.select("lid", "lk", F.col("first").alias("first_"), F.col("more").alias("more_")).select("lid", "lk", starts)
    told = marked.join(late, F.col("sid").eqNullSafe(F.col("lid")) & (F.col("k") == F.col("lk")), "left").where(F.col("copy") | F.col("starts").isNotNull()).select("skey", "sid", "se", "copy", "starts")
    final = body.join(told, same_row, "left").select("id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "starts")
    return final.mapInArrow(_result_rows, f"id {kind}, n_words bigint, n_removed bigint, kept string").withColumnRenamed("id", id_col)


def op4(docs: DataFrame) -> DataFrame:
    """Contract columns of the substring query."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same by brute force: every window of fifty words against every other, by an md5 of its words.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT rn, doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS g FROM (SELECT rn, doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL)),
f AS (SELECT g, min(doc_id) AS least FROM p GROUP BY g),
x AS (SELECT rn, list(DISTINCT j) AS gone FROM (SELECT rn, unnest(generate_series(i, i + 49)) AS j FROM p JOIN f USING (g) WHERE least < doc_id) GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
 sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN x USING (rn)
"""
