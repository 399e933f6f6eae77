"""Language guess by rank distance of character n-grams, and readability.

A text is reduced to ASCII; one to be guessed is cut to 25,000 characters and counted only from 1,000 characters without digits,
labelled ones are counted whole. n-grams of 1 to 5
characters of ``_word_`` are ranked by count, then by name, and 400 are kept; a language's distance is the sum of rank
differences, 400 for n-grams that its model lacks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAMS, LONGEST_WORD, LONGEST_GRAM = 400, 25, 5
MIN_CHARS, MAX_CHARS = 1000, 25_000
NEAR, TOO_NEAR = 1.05, 1.02


def plain(text: Column) -> Column:
    """The text in ASCII, without repeated white space."""
    return F.regexp_replace(F.regexp_replace(text, r"[^\x00-\x7F]", ""), r"[\t-\r ]{2,}", " ")


def reduced(text: Column) -> Column:
    """The characters that are looked at in a text whose language is guessed."""
    return F.substring(plain(text), 1, MAX_CHARS)


def long_enough(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[0-9]", "")) >= MIN_CHARS


def words(text: Column) -> Column:
    """Words of a reduced text: trailing empty ones are dropped, a leading one is kept."""
    cut = F.regexp_replace(text, r"[0-9\t-\r ]+$", "")
    return F.when(cut == "", F.array().cast("array<string>")).otherwise(F.split(cut, r"[0-9\t-\r ]+"))


def exploded_grams(df: DataFrame, word: str, carry: list[str]) -> DataFrame:
    """The carried columns and ``ngram``: all n-grams of framed words, repeats included. No function of arrays is interpreted here."""
    size = F.length(word)
    placed = df.select(*carry, word, F.explode(F.sequence(F.lit(1), size)).alias("__i"))
    each = F.array(*[F.when(F.col("__i") + n - 1 <= size, F.substring(F.col(word), F.col("__i"), F.lit(n))) for n in range(1, LONGEST_GRAM + 1)])
    return placed.select(*carry, F.explode(each).alias("ngram")).where(F.col("ngram").isNotNull())


def top_grams(df: DataFrame, key: str, text: Column, keep: int = GRAMS) -> DataFrame:
    """key, ngram, n and rank (from 0) of the most frequent n-grams of each key's texts.

    Words are counted first, so a word is taken apart once for each key and not for each of its uses.
    """
    each = df.select(key, F.explode(words(text)).alias("word")).groupBy(key, "word").agg(F.count("*").alias("times"))
    framed = each.select(key, "times", F.concat(F.lit("_"), "word", F.lit("_")).alias("framed")).where(F.length("framed") <= LONGEST_WORD)
    counted = exploded_grams(framed, "framed", [key, "times"]).groupBy(key, "ngram").agg(F.sum("times").alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "ngram")
    return counted.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < keep)


def train(df: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, dict[str, int]]:
    """Models of all languages of a labelled corpus: n-gram to rank (from 1). Whole texts count. At most 400 rows a language reach the driver."""
    rows = top_grams(df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, plain(F.col(text)).alias("t")), lang, F.col("t"))
    models: dict[str, dict[str, int]] = {}
    for r in rows.collect():
        models.setdefault(r[lang], {})[r["ngram"]] = r["rank"] + 1
    return models


def codes_of(grams: Iterable[str]) -> np.ndarray:
    """N-grams of up to 5 ASCII characters as numbers in their order: a byte for each, one more than the character, 0 after the last.
    Others, which no reduced text has, are negative."""
    raw = [g.encode() if g.isascii() and len(g) <= LONGEST_GRAM else b"" for g in grams]
    return np.array([int.from_bytes(bytes(c + 1 for c in x).ljust(LONGEST_GRAM, b"\0"), "big") if x else -1 - i for i, x in enumerate(raw)], dtype=np.int64)


class Ranker:
    """Ranks n-grams of texts by numbers: each word is taken apart once, many at a time, and an n-gram is a number from then on.

    The models' n-grams have the first numbers. Words and n-grams are forgotten, but for those, when there are too many.
    """

    WORDS, NAMES = 1 << 18, 1 << 21

    def __init__(self, models: dict[str, dict[str, int]]):
        self.langs = sorted(models)
        self.fixed = sorted(set().union(*models.values())) if models else []
        self.rank = np.full((len(self.langs), len(self.fixed)), -1, dtype=np.int64)
        place = {g: i for i, g in enumerate(self.fixed)}
        for k, lang in enumerate(self.langs):
            self.rank[k, [place[g] for g in models[lang]]] = list(models[lang].values())
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, np.ndarray] = {}
        self.code = codes_of(self.fixed)  # by number
        self.number = self.code.argsort()  # of the codes in their order
        self.sorted = self.code[self.number]

    def learn(self, words: Iterable[str]) -> None:
        """Numbers of the n-grams of new words; words that are too long have none."""
        asked = list(dict.fromkeys(words))
        new = [w for w in asked if w not in self.words]
        if len(self.words) + len(new) > self.WORDS or len(self.code) > self.NAMES:
            self.forget()
            new = asked
        framed = [f"_{w}_".encode("ascii", "replace") for w in new]
        framed = [f if len(f) <= LONGEST_WORD else b"" for f in framed]
        lengths = np.array([len(f) for f in framed], dtype=np.int64)
        text = np.frombuffer(b"".join(framed) + bytes(LONGEST_GRAM), dtype=np.uint8).astype(np.int64) + 1
        size = int(lengths.sum())
        ends = np.repeat(np.cumsum(lengths), lengths)
        owner, at = np.repeat(np.arange(len(new)), lengths), np.arange(size)
        code, codes, owners = np.zeros(size, dtype=np.int64), [], []
        for n in range(1, LONGEST_GRAM + 1):
            code = code + (text[n - 1 : n - 1 + size] << (8 * (LONGEST_GRAM - n)))
            inside = at + n <= ends
            codes.append(code[inside])
            owners.append(owner[inside])
        every, whose = (np.concatenate(x) if new else np.zeros(0, dtype=np.int64) for x in (codes, owners))
        every = every[whose.argsort(kind="stable")]
        fresh = np.setdiff1d(every, self.sorted)
        if len(fresh):
            self.code = np.concatenate([self.code, fresh])
            self.number = self.code.argsort()
            self.sorted = self.code[self.number]
        numbers = self.number[self.sorted.searchsorted(every)]
        counts = np.bincount(whose, minlength=len(new)) if new else []
        self.words.update(zip(new, np.split(numbers, np.cumsum(counts)[:-1]) if new else []))

    def top(self, found: list[str]) -> np.ndarray:
        """Numbers of the 400 most frequent n-grams of the words of a text; ties go by the n-gram."""
        uses = Counter(found)
        try:
            parts = [self.words[w] for w in uses]
        except KeyError:
            self.learn(uses)
            parts = [self.words[w] for w in uses]
        if not parts:
            return np.zeros(0, dtype=np.int64)
        weights = np.repeat(np.fromiter(uses.values(), dtype=np.float64, count=len(uses)), [len(p) for p in parts])
        counts = np.bincount(np.concatenate(parts), weights=weights)
        held = np.flatnonzero(counts)
        n = counts[held]
        if len(held) > GRAMS:
            least = np.partition(n, len(n) - GRAMS)[len(n) - GRAMS]
            held, n = held[n >= least], n[n >= least]
        return held[np.lexsort((self.code[held], -n))[:GRAMS]]

    def distances(self, found: list[str]) -> dict[str, int]:
        top = self.top(found)
        at = np.flatnonzero(top < len(self.fixed))
        rank = self.rank[:, top[at]] if len(at) else np.zeros((len(self.langs), 0), dtype=np.int64)
        away = np.where(rank >= 0, np.abs(rank - at), GRAMS).sum(axis=1) + GRAMS * (len(top) - len(at))
        return dict(zip(self.langs, away.tolist()))


def split_words(text: str) -> list[str]:
    """Words of a reduced text, as ``words`` has them."""
    found = _BREAKS.split(text)
    while found and not found[-1]:
        found.pop()
    return found


_BREAKS = re.compile(r"[0-9\t-\r ]+")


def ranked(text: str) -> list[str]:
    """The 400 most frequent n-grams of a reduced text."""
    ranker = Ranker({})
    top = ranker.top(split_words(text))
    return ["".join(chr(c - 1) for c in code.to_bytes(LONGEST_GRAM, "big") if c) for code in ranker.code[top].tolist()]


def distances(text: str, models: dict[str, dict[str, int]]) -> dict[str, int]:
    return Ranker(models).distances(split_words(text))


def candidates(scores: dict[str, int]) -> list[str]:
    """The best language and those within NEAR of it, in the order of their distances; languages that tie go by name."""
    order = sorted(scores, key=lambda k: (scores[k], k))
    return [k for k in order if scores[k] < NEAR * scores[order[0]] or k == order[0]]


def choose(scores: dict[str, int]) -> tuple[str, int]:
    """(language, 0), or ("", -2) where the runner-up is too near."""
    near = candidates(scores)
    if len(near) > 1 and scores[near[1]] / max(scores[near[0]], 1e-9) < TOO_NEAR:
        return "", -2
    return near[0], 0


def guess(df: DataFrame, models: dict[str, dict[str, int]], id_col: str, text_col: str) -> DataFrame:
    """id, lang, status (0 found, -1 too short, -2 too close), best (the distance) and near (the languages that were too close to tell).
    Each text is scored in its own task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(models)
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, 500):
                texts = [split_words(t) if enough and models else None for t, enough in zip(batch.column(1).slice(at, 500).to_pylist(), batch.column(2).slice(at, 500).to_pylist())]
                ranker.learn(w for t in texts if t is not None for w in t)
                for found in texts:
                    if found is None:
                        rows.append(("", -1, -1, []))
                        continue
                    scores = ranker.distances(found)
                    lang, status = choose(scores)
                    rows.append((lang, status, min(scores.values()), candidates(scores) if status else []))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.string()))], names=["id", "lang", "status", "best", "near"])

    kind = df.schema[id_col].dataType.simpleString()
    slim = df.select(id_col, F.coalesce(reduced(F.col(text_col)), F.lit("")).alias("t")).select(id_col, "t", long_enough(F.col("t")).alias("enough"))
    return slim.mapInArrow(scan, f"id {kind}, lang string, status int, best bigint, near array<string>").withColumnRenamed("id", id_col)


def guess_pages(facts: DataFrame, models: dict[str, dict[str, int]], id_col: str = "page_id") -> DataFrame:
    """``guess`` of pages (id, html_lang, texts by language): only text in the language that a page declares is looked at, all of it
    where none is declared."""
    own = F.filter("texts", lambda t: (t["lang"] == F.col("html_lang")) | (F.col("html_lang") == ""))
    return guess(facts.select(id_col, F.array_join(F.transform(own, lambda t: t["text"]), " ").alias("__text")), models, id_col, "__text")


def readability(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """id, words, sentences, syllables, complex_words, fog and kincaid (cut to integers; -1 up to 100 characters).

    A word is a run of letters; a syllable is a run of vowels, but a final e after another letter than l, and a word has one at
    least; a complex word has three or more. The scores are the published formulas.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    syllables = F.transform("w", lambda w: F.greatest(F.regexp_count(w, F.lit("[aeiouy]+")) - F.when(w.rlike("[^aeiouyl]e$"), 1).otherwise(0), F.lit(1)))
    base = df.select(id_col, F.length(text).alias("chars"), words.alias("w"), F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[.!?]+")).alias("stops"))
    counted = base.select(
        id_col, "chars", F.size("w").cast("long").alias("words"), F.greatest(F.col("stops"), F.lit(1)).cast("long").alias("sentences"), syllables.alias("s")
    ).select("*", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("syllables"), F.size(F.filter("s", lambda x: x >= 3)).cast("long").alias("complex_words"))
    able = (F.coalesce(F.col("chars"), F.lit(0)) > 100) & (F.col("words") > 0)
    fog = 0.4 * (F.col("words") / F.col("sentences") + 100 * F.col("complex_words") / F.col("words"))
    grade = 0.39 * F.col("words") / F.col("sentences") + 11.8 * F.col("syllables") / F.col("words") - 15.59
    return counted.select(id_col, "words", "sentences", "syllables", "complex_words", F.when(able, fog.cast("int")).otherwise(-1).alias("fog"), F.when(able, grade.cast("int")).otherwise(-1).alias("kincaid"))
