"""Secret scans: fixed patterns, and guess costs of the values that stand in a credential context.

Base patterns find assigned secrets, access keys and hexadecimal strings. The method adds spans of kind ``guess``: a value
after a credential word (a wider context; any characters but white space, or what quotes on one line hold) whose cheapest
segmentation would still take an attacker 10 ** ``MIN_GUESSES`` guesses. The segmentation into words, dates, repeats, keyboard walks, sequences and
brute-force spans is found by dynamic programming over the end positions; costs are decimal logarithms and add up.

The dictionary ranks words by their number of guesses: common passwords and words first, then the words of the corpus by the
number of their uses in all texts. Values in a credential context aren't counted, so a secret that copies repeat is no word.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Kinds in their order, base kinds first.
KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")
_CONTEXT = re.compile(rb"""(?<![a-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|auth|credentials?|login|pin)["']?[\x20\t]*(?:[:=]|(?P<prose>[\x20\t]is[\x20\t]))[\x20\t]*(?:"(?P<double>(?:[^"\\\n\r]|\\[^\n\r])+)"|'(?P<single>(?:[^'\\\n\r]|\\[^\n\r])+)'|["']?(?P<bare>[^\x20\x09-\x0D"'`<>]+))""")
#: What follows a credential word, in Java's syntax: it isn't counted as words of the corpus.
_VALUES = r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|auth|credentials?|login|pin)["']?\s*(?:[:=]|\sis\s)\s*(?:"[^"\n\r]*"|'[^'\n\r]*'|\S+)"""
#: Every match of a pattern over credential words has one of these; a text without them isn't searched.
_HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"auth", b"credential", b"login", b"pin")

#: Values that take 10 to this power of guesses or more are reported.
MIN_GUESSES = 8.0
#: Common words of passwords and prose, the most common first; a word's rank is its number of guesses.
WORDS = (
    "password 123456 qwerty letmein welcome admin login dragon monkey master hello freedom whatever shadow sunshine princess football baseball "
    "superman batman trustno iloveyou secret test user root guest changeme default access summer winter spring autumn love money computer "
    "internet company service server system public private token example sample dummy placeholder none null true false your key pass the and "
    "that this with from have not you for are was here there what when will can one two three all any some must should may use used set see "
    "required missing invalid valid correct incorrect wrong right unknown empty unset hidden changed reset expired optional string text value "
    "name number code phrase file account email address phone date time today yesterday never always nothing something anything everything"
).split()
#: Words that are learned from the corpus, and their least and greatest length in characters.
LEARNED, SHORTEST, LONGEST = 20_000, 3, 24
_LEET = str.maketrans("@4301$5!7", "aaeoissit")
#: Rows of a keyboard; neighbours in a row make a walk.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_KEY = {c: (y, x) for y, row in enumerate(KEY_ROWS) for x, c in enumerate(row)}
_DATE = re.compile(r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
_JOIN = math.log10(2)  # for each further segment


def _single(c: str) -> float:
    """Cost of one character by brute force: the size of its class."""
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() else math.log10(33)


class Dictionary:
    """Ranks of words: WORDS, then others in their order."""

    def __init__(self, learned: Iterable[str] = ()):
        self.rank = {w: i for i, w in enumerate(dict.fromkeys([*WORDS, *learned]), 1)}
        self.longest = max(map(len, self.rank))


_KNOWN = Dictionary()


def guess_cost(value: str, known: Dictionary = _KNOWN) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` takes; 0 for an empty value.

    Time is linear in the length: words and dates have a longest length, and runs (repeats, walks, sequences) are extended
    from the run that ended one character before.
    """
    low, n = "".join(c if len(c) == 1 else v for v, c in ((v, v.lower()) for v in value)), len(value)
    plain, rank_of, longest = low.translate(_LEET), known.rank, known.longest
    best = [0.0] + [math.inf] * n
    same = walk = step = 0  # where the runs that end at i begin
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if low[i].isdigit() and (m := _DATE.match(low, i)):
            dates.setdefault(m.end(), []).append(i)
    for end in range(1, n + 1):
        i = end - 1
        cost = best[i] + _single(value[i])
        if i:
            if low[i] != low[i - 1]:
                same = i
            here, last = _KEY.get(low[i]), _KEY.get(low[i - 1])
            if not (here and last and here[0] == last[0] and abs(here[1] - last[1]) == 1):
                walk = i
            if i == 1 or ord(low[i]) - ord(low[i - 1]) not in (1, -1) or (i - step > 1 and ord(low[i]) - ord(low[i - 1]) != ord(low[i - 1]) - ord(low[i - 2])):
                step = i if ord(low[i]) - ord(low[i - 1]) not in (1, -1) else i - 1
        for start, base in ((same, _single(value[same])), (walk, math.log10(47)), (step, math.log10(26))):
            if (run := end - start) >= 3:
                cost = min(cost, best[start] + _JOIN * (start > 0) + base + math.log10(run))
        for start in range(max(0, end - longest), end - 2):
            if rank := rank_of.get(low[start:end]) or rank_of.get(plain[start:end]):
                odd = (value[start:end] != low[start:end]) + (low[start:end] not in rank_of)
                cost = min(cost, best[start] + _JOIN * (start > 0) + math.log10(rank + 1) + _JOIN * odd)
        for start in dates.get(end, ()):
            cost = min(cost, best[start] + _JOIN * (start > 0) + math.log10(365 * 150 if end - start > 4 else 150))
        best[end] = cost
    return best[n]


def spans(text: str | None, known: Dictionary = _KNOWN) -> list[tuple[int, int, int, float | None]]:
    """All spans of a text: (start, kind as an index of KINDS, end, log10 of guesses or None), in code points, in order; spans
    that tie go by kind. Assigned values and those of kind ``guess`` have a cost.

    A span of kind ``guess`` is left out where a base span covers all of it, and letters alone after ``is`` are taken for prose.
    None and an empty text have no spans. Time and memory are linear in the length of a text.
    """
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    low, found = raw.lower(), []  # bytes: only A-Z change
    cost = {}
    if any(x in low for x in _HINTS):
        for m in _ASSIGN.finditer(low):
            if m.end(2) - m.start(2) >= 8:
                found.append((m.start(), 0, m.end()))
                cost[found[-1]] = guess_cost(raw[m.start(2) : m.end(2)].decode(), known)
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(raw)]
    every = set(found)
    if any(x in low for x in _HINTS):
        found.sort()
        starts, reach = [a for a, _, _ in found], list(itertools.accumulate((b for _, _, b in found), max))
        for m in _CONTEXT.finditer(low):
            start, end = m.span(m.lastgroup)
            if m.lastgroup == "bare":
                end -= len(m["bare"]) - len(m["bare"].rstrip(b",;.:!?)]}#*&$%|"))
            before = bisect.bisect_right(starts, start)
            if before and reach[before - 1] >= end:
                continue
            value = raw[start:end].decode("utf-8", "surrogatepass")
            prose = m["prose"] is not None and m.lastgroup == "bare" and value.isalpha()
            log = 0.0 if prose else guess_cost(value, known)
            if log >= MIN_GUESSES:
                cost[start, 3, end] = log
                every.add((start, 3, end))
    if not every:
        return []
    every = sorted(every)
    if len(raw) == len(text):
        return [(a, k, b, cost.get((a, k, b))) for a, k, b in every]
    at = {0: 0}
    marks = sorted({x for a, _, b in every for x in (a, b)})
    for before, here in zip([0, *marks], marks):
        at[here] = at[before] + len(raw[before:here].decode("utf-8", "surrogatepass"))
    return [(at[a], k, at[b], cost.get((a, k, b))) for a, k, b in every]


def learned(df: DataFrame, text_col: str = "text", most: int = LEARNED) -> list[str]:
    """The ``most`` words of all texts that are used most, in this order; ties go by the word. Runs of SHORTEST to LONGEST
    letters in lower case count, but for values in a credential context."""
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    hinted = F.lit(False)
    for hint in _HINTS:
        hinted = hinted | F.contains(text, F.lit(hint.decode()))
    text = F.when(hinted, F.regexp_replace(text, _VALUES, " ")).otherwise(text)
    words = df.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word")).where(F.length("word").between(SHORTEST, LONGEST))
    counted = cut(words.groupBy("word").agg(F.count("*").alias("n")))
    # the least number of uses that matters, from a histogram of some 250 steps; so tasks send few words to the driver
    steps = counted.groupBy(F.floor(F.log2("n") * 4).alias("step")).agg(F.min("n").alias("least"), F.count("*").alias("words")).orderBy(F.desc("step")).collect()
    have, least = 0, 1
    for r in steps:
        have, least = have + r["words"], r["least"]
        if have >= most:
            break
    kept = counted.where(F.col("n") >= least).repartition(8)
    return [r["word"] for r in kept.orderBy(F.desc("n"), "word").limit(most).collect()]


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Iterable[str] | None = None) -> DataFrame:
    """One row for each text: its id (as it is) and ``secrets``, an array of (kind, start, end, log10_guesses).

    A null or empty text has an empty array. Repeated rows have equal results, ids may be null, and no other column is read. Rows
    are independent; nothing is shuffled but the counts of words, where these aren't given (``words``, the most used first).
    """
    known = df.sparkSession.sparkContext.broadcast(Dictionary(learned(df, text_col) if words is None else words))  # LEARNED words

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64())]))
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "log10_guesses": c} for a, k, b, c in spans(t, known.value)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, struct)], names=["id", "secrets"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(scan, f"id {kind}, secrets array<struct<kind:string,start:bigint,end:bigint,log10_guesses:double>>").withColumnRenamed("id", id_col)


def op3(docs: DataFrame) -> DataFrame:
    """Contract columns of the secret scan."""
    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(found):
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("secrets", lambda s: s["kind"] != "guess")
    return find_secrets(docs).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), count("guess"), F.round(F.array_max("secrets.log10_guesses"), 6).alias("max_log10_guesses"))
