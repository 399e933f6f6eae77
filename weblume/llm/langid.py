"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed against it from left to right into longest
phrases that occur in the labelled text (a symbol that never occurs is a phrase of its own). A text needs few phrases in its
own language; phrases times log2 of the sample's length, over the text's symbols, estimates the cross entropy in bits a symbol.
The language with the lowest estimate wins; of equal ones the first by name.

Symbols: letters that occur in the samples, in lower case; every run of other characters is one space; other letters are one
symbol without transitions. Texts are parsed in blocks of BLOCK symbols, so that all blocks of many texts advance together, one
symbol at a time, but phrases cross blocks: a block is parsed from the start state first, then from the state in which the block
before it ended, until both parses are in one state; from there on they are the same. Blocks that end before that pass their
corrected state on.

The transitions of languages with up to DENSE letters are one dense table of at most CELLS entries; those of the others (Han,
Hangul, or too many languages) are kept as sorted keys of state and symbol, some 16 bytes for each.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Bounds of the labelled sample of each language: characters, and documents (in the order of a hash of their ids).
SAMPLE_CHARS, SAMPLE_ROWS = 40_000, 64
#: Bounds of all samples together; where there are more languages, each has an equal share of them (one document at least).
ALL_CHARS, ALL_ROWS = 8_000_000, 32_768
#: Symbols that a language's sample has at least where texts are called foreign to it; a shorter one has too few phrases to tell.
EVIDENCE = 2000
#: Mean length of the phrases of a text under which it is foreign. Labelled texts of 200 characters and more were seen to have 2.5
#: and more, shorter ones 2.0 and more, half of all 6; letters that no sample has are phrases of one.
FOREIGN = 1.75
BLOCK = 512
#: Letters that a language of the dense table has at most, and entries of that table (4 bytes each).
DENSE, CELLS = 250, 1 << 25
#: Blocks that advance together, and states of them that are kept (4 bytes each, 8 in the sparse form).
LANES, TRACE = 4096, 1 << 23
UNKNOWN = "und"
_LETTER, _LETTERS = regex.compile(r"\p{L}"), regex.compile(r"\p{L}+")
_SPACE, _PAD = 0, 1  # symbols; then the unknown letter, then the alphabet
_OTHER, _FIRST = 2, 3


def fold(c: str) -> str:
    """A letter in lower case; as it is where that is more than one character."""
    low = c.lower()
    return low if len(low) == 1 else c


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions (of each state, by symbol) of the suffix automaton of ``codes``; state 0 is the start."""
    nexts, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        here = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = here
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[here] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[here] = copy
        last = here
    return nexts


class Model:
    """Languages with their automata.

    Those with few letters are in one dense table: entry [state, symbol] is twice the offset of the next state's row, plus 1 where
    a phrase begins. Those with many have the key state * width + symbol and the next state of every transition but the starts',
    and the starts' own rows; a step without a key begins a phrase.
    """

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        own = {lang: {fold(c) for c in set(samples[lang]) if _LETTER.match(c)} for lang in self.langs}
        self.letters = {c: _FIRST + i for i, c in enumerate(sorted(set().union(*own.values())))}
        self.width = _FIRST + len(self.letters)
        self.codes = np.full(sys.maxunicode + 1, _SPACE, dtype=np.min_scalar_type(self.width))
        for run in _LETTERS.finditer("".join(map(chr, range(sys.maxunicode + 1)))):
            for i in range(*run.span()):
                self.codes[i] = self.letters.get(fold(chr(i)), _OTHER)
        shared, room, self.narrow = len(self.letters) <= DENSE, CELLS, []
        for k, lang in enumerate(self.langs):  # a suffix automaton has under twice as many states as its text has symbols
            cells = (2 * len(samples[lang]) + 2) * (self.width if shared else _FIRST + len(own[lang]))
            if (shared or len(own[lang]) <= DENSE) and cells <= room:
                self.narrow.append(k)
                room -= cells
        self.wide = [k for k in range(len(self.langs)) if k not in set(self.narrow)]
        # columns of the dense table: the symbols, or for each of its languages the places of its own letters among them
        self.columns = None if shared else np.full((len(self.narrow), self.width), _OTHER, dtype=np.uint8)
        parts, self.starts, self.bits, self.sizes, at = [], [], [], [], 0
        keys, values, self.roots, states = [], [], [], 0
        self.root_rows = np.zeros((len(self.wide), self.width), dtype=np.int64)
        for k, lang in enumerate(self.langs):
            codes = self.encode(samples[lang])
            self.sizes.append(len(codes))
            self.bits.append(math.log2(len(codes) + 2))
            nexts = automaton(codes.tolist())
            if k in self.narrow:
                places, width = np.arange(self.width), self.width
                if self.columns is not None:
                    places = self.columns[self.narrow.index(k)]
                    places[[_SPACE, _PAD]] = _SPACE, _PAD
                    mine = sorted(self.letters[c] for c in own[lang])
                    places[mine] = np.arange(_FIRST, _FIRST + len(mine))
                    width = _FIRST + len(mine)
                table = np.full((len(nexts), width), -1, dtype=np.int32)
                for s, row in enumerate(nexts):
                    if row:
                        table[s, places[list(row)]] = list(row.values())
                begin = table < 0
                begin[0] = True
                root = np.where(table[0] < 0, 0, table[0])
                table = np.where(table < 0, root[None, :], table)
                full = (table * width + at) * 2 + begin
                full[:, _PAD] = at * 2
                parts.append(full.astype(np.int32).ravel())
                self.starts.append(at)
                at += table.size
            else:
                starts = self.root_rows[len(self.roots)]
                starts[:] = states
                starts[list(nexts[0])] = np.array(list(nexts[0].values()), dtype=np.int64) + states
                for s, row in enumerate(nexts[1:], states + 1):
                    keys += [s * self.width + c for c in row]
                    values += [v + states for v in row.values()]
                self.roots.append(states)
                states += len(nexts)
        self.table = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
        keys, values = np.array([*keys, np.iinfo(np.int64).max], dtype=np.int64), np.array([*values, 0], dtype=np.int64)
        order = keys.argsort()
        self.keys, self.values = keys[order], values[order]

    def encode(self, text: str) -> np.ndarray:
        """Symbols of a text, without repeated spaces."""
        codes = self.codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)
        return codes[keep]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each encoded text in each language (texts x languages)."""
        counts = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        if not self.langs:
            return counts
        blocks, owner, before = [], [], []
        for i, codes in enumerate(texts):
            for at in range(0, len(codes), BLOCK):
                before.append(len(blocks) - 1 if at else -1)
                blocks.append(codes[at : at + BLOCK])
                owner.append(i)
        ends = np.zeros((len(self.langs), len(blocks)), dtype=np.int64)  # the state that each block ends in
        order = sorted(range(len(blocks)), key=lambda b: -len(blocks[b]))  # of about one length together, a block before its next
        lanes = max(1, min(LANES, TRACE // (BLOCK * len(self.langs))))
        for at in range(0, len(order), lanes):
            chosen = order[at : at + lanes]
            grid = np.full((len(chosen), len(blocks[chosen[0]])), _PAD, dtype=np.int32)
            for lane, b in enumerate(chosen):
                grid[lane, : len(blocks[b])] = blocks[b]
            found = np.zeros((len(self.langs), len(chosen)), dtype=np.int64)
            for langs, step, starts in ((self.narrow, self._dense, self.starts), (self.wide, self._sparse, self.roots)):
                if langs:
                    found[langs] = self._parse(np.ascontiguousarray(grid.T), step, starts, ends, langs, chosen, before)
            np.add.at(counts, [owner[b] for b in chosen], found.T)
        return counts

    def _parse(self, columns: np.ndarray, step, starts: list[int], ends: np.ndarray, langs: list[int], chosen: list[int], before: list[int]) -> np.ndarray:
        """Phrases of each lane in some languages, and in ``ends`` the last state of each."""
        every, width = np.arange(len(langs)), columns.shape[1]
        state = np.repeat(np.array(starts, dtype=np.int64 if step == self._sparse else np.int32)[:, None], width, axis=1)
        trace = np.empty((len(columns), *state.shape), dtype=state.dtype)
        begun = np.zeros(trace.shape, dtype=bool)
        for k, column in enumerate(columns):
            state, begun[k] = step(state, column[None, :], every[:, None])
            trace[k] = state
        found, place = begun.sum(axis=0), {b: lane for lane, b in enumerate(chosen)}
        ends[np.ix_(langs, chosen)] = state
        extra = np.zeros_like(found)
        lane = np.array([x for x, b in enumerate(chosen) if before[b] >= 0], dtype=np.int64)
        after = {place[before[chosen[x]]]: int(x) for x in lane if before[chosen[x]] in place}  # lanes of one text that follow each other
        which, lane = np.repeat(every, len(lane)), np.tile(lane, len(langs))
        rows = np.array(langs)
        while len(lane):
            previous = np.array([before[chosen[x]] for x in lane])
            now, open_ = ends[rows[which], previous], np.arange(len(lane))
            more = np.zeros(len(lane), dtype=np.int64)
            for k, column in enumerate(columns):
                g, x = which[open_], lane[open_]
                now, begins = step(now, column[x], g)
                more[open_] += begins.astype(np.int64) - begun[k, g, x]
                apart = now != trace[k, g, x]
                open_, now = open_[apart], now[apart]
                if not len(open_):
                    break
            extra[which, lane] = more
            # lanes that never met their first parse end in another state, and the next block of the text starts from it
            last = trace[-1, which, lane].astype(np.int64)
            last[open_] = now
            numbers = np.array([chosen[x] for x in lane])
            changed = np.flatnonzero(ends[rows[which], numbers] != last)
            ends[rows[which[changed]], numbers[changed]] = last[changed]
            again = [(int(which[c]), after[int(lane[c])]) for c in changed if int(lane[c]) in after]
            which, lane = (np.array(v, dtype=np.int64) for v in (zip(*again) if again else ((), ())))
        return found + extra

    def _dense(self, state: np.ndarray, symbol: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states in languages of the dense table, and where phrases begin."""
        entry = self.table.take(state + (symbol if self.columns is None else self.columns[which, symbol]))
        return entry >> 1, (entry & 1).astype(bool)

    def _sparse(self, state: np.ndarray, symbol: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same in the other languages."""
        key = state * self.width + symbol
        place = self.keys.searchsorted(key)
        missed = self.keys.take(place) != key
        state = np.where(missed, self.root_rows[which, symbol], self.values.take(place))
        return state, missed & (symbol != _PAD)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        """Of each text its language, score (the winner's share if each bit of difference halves the odds), bits a symbol, and
        whether it is foreign: its phrases, but for one, are under FOREIGN symbols long."""
        has = [bool(t) and bool(self.langs) and _LETTER.search(t) is not None for t in texts]
        encoded = [self.encode(t) for t, h in zip(texts, has) if h]
        counts = self.phrases(encoded) if encoded else np.zeros((0, 1), dtype=np.int64)
        out, k = [], 0
        for h in has:
            if not h:
                out.append((UNKNOWN, 0.0, 0.0, False))
                continue
            row, n = counts[k] * np.array(self.bits), len(encoded[k])
            best = int(row.argmin())  # the first by name where two are equal
            score = float(1 / np.exp2(np.minimum(0, row[best] - row)).sum())
            out.append((self.langs[best], score, float(row[best] / n), self.sizes[best] >= EVIDENCE and bool((counts[k, best] - 1) * FOREIGN > n)))
            k += 1
        return out


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, chars: int = SAMPLE_CHARS, rows: int = SAMPLE_ROWS, seed: int = 5) -> Model:
    """Learn from labelled documents that aren't held out: of each language, whole texts in the order of a hash of their ids,
    ``rows`` at most, until ``chars`` characters are there (a longer text counts so far).

    Where the languages are more than ALL_ROWS / rows or ALL_CHARS / chars, those bounds are lowered for all alike. A table
    without labels gives a model without languages. Labels are told apart as they are written.
    """
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    order = F.xxhash64(F.lit(seed), "doc_id")
    ranked = labelled.select("lang", "doc_id", order.alias("h")).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id")))
    first = cut(ranked.where(F.col("rank") <= rows).select(F.col("lang").alias("l"), F.col("doc_id").alias("i"), "rank"))
    langs = max(1, first.where("rank = 1").count())
    rows, chars = max(1, min(rows, ALL_ROWS // langs)), max(1, min(chars, ALL_CHARS // langs))
    some = first.where(F.col("rank") <= rows).select("l", "i").distinct()
    if langs <= ALL_ROWS:
        some = F.broadcast(some)  # ALL_ROWS rows at most
    met = labelled.join(some, (F.col("doc_id") == F.col("i")) & (F.col("lang") == F.col("l")), "left_semi")
    chosen = met.select("lang", "doc_id", order.alias("h"), F.substring("text", 1, chars).alias("text")).distinct().collect()
    samples: dict[str, str] = {}
    for r in sorted(chosen, key=lambda r: (r["lang"], r["h"], r["doc_id"], r["text"])):
        have = samples.setdefault(r["lang"], "")
        if len(have) < chars:
            samples[r["lang"]] = f"{have} {r['text']}"[: chars + 1]
    return Model(samples)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """id, carried columns, ``__lang``, ``__score``, ``__bits`` (a symbol) and ``__foreign`` of every row.

    ``und`` where a text is null or has no letter, or nothing was learned. Texts are parsed whole, whatever their length. Rows
    are independent: repeated ones have equal results, ids may be null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample
    names = [id_col, *(c for c in carry or [] if c != id_col)]
    read = text_col if text_col in names else "__text"
    made = {"__lang": pa.string(), "__score": pa.float64(), "__bits": pa.float64(), "__foreign": pa.bool_()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows = shared.value.predict(part.column(read).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(made.values()))], names=[*names, *made])

    added = zip(made, (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()))
    schema = T.StructType([docs.schema[n] for n in names] + [T.StructField(n, k) for n, k in added])
    return docs.select(*[F.col(f"`{n}`") for n in names], *([] if read == text_col else [F.col(text_col).alias("__text")])).mapInArrow(scan, schema)


def known(docs: DataFrame) -> DataFrame:
    """The documents in a learned language, with all their columns; a null ``lang`` becomes the predicted one.

    Texts without a letter go, and those foreign to all samples: even in the language with the fewest, their phrases, but for
    one that the text's end may cut, are under FOREIGN symbols long, so the samples hold little more of them than letters.
    Samples of under EVIDENCE symbols reject nothing. Where no row is labelled no language is learned, and only texts without a
    letter go. Where ``lang`` isn't a string it is left as it is.
    """
    model = fit(docs)
    if not model.langs:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    told = identify(docs, model, carry=docs.columns).where((F.col("__lang") != UNKNOWN) & ~F.col("__foreign"))
    filled = isinstance(docs.schema["lang"].dataType, T.StringType)
    return told.select(*[F.coalesce(F.col("lang"), F.col("__lang")).alias(c) if c == "lang" and filled else F.col(f"`{c}`") for c in docs.columns])


def op9(docs: DataFrame) -> DataFrame:
    """Contract columns of the language query; the id alone is carried beside the text."""
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__bits").alias("bits"))
