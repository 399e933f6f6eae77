import math
import random
import unicodedata
import zlib

import numpy as np
import pytest

from weblume.llm import langid

from .helpers import AWKWARD, empty, extra


def plain_phrases(sample, codes):
    """Greedy longest phrases of a block, by searching the sample."""
    n, i = 0, 0
    while i < len(codes):
        k = 1
        while i + k <= len(codes) and codes[i : i + k] in sample:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_phrases_equal_a_plain_search():
    rng = random.Random(3)
    samples = {"xx": "".join(rng.choice("ab cé") for _ in range(400)), "yy": "".join(rng.choice("abz d") for _ in range(300))}
    model = langid.Model(samples)
    assert model.langs == ["xx", "yy"]
    texts = ["".join(rng.choice("ab czdéqÀ7") for _ in range(n)) for n in (1, 5, 100, 511, 512, 513, 1700)] + ["漢字 ab"]
    encoded = [model.encode(t) for t in texts]
    got = model.phrases(encoded)
    for row, codes in zip(got, encoded):
        for lang, n in zip(model.langs, row):
            known = bytes(model.encode(samples[lang]))
            assert n == plain_phrases(known, bytes(codes))


def test_encoding_folds_case_and_runs():
    model = langid.Model({"xx": "abc é"})
    assert (model.encode("A  b!!\n7c") == model.encode("a b c")).all() and model.encode("Éq漢").tolist() == [model.letters["é"], langid._OTHER, langid._OTHER]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = langid.op9(docs).collect()
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held])
    assert right > 0.97, right
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_nothing_but_text_decides(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    a = langid.identify(docs, model).select("__lang", "__score").collect()
    b = langid.identify(docs.withColumn("lang", F.lit("zz")).withColumn("doc_id", F.lit(7)).withColumn("source", F.lit(None)), model).select("__lang", "__score").collect()
    assert a == b


def test_awkward_tables(spark):
    assert langid.op9(empty(spark)).count() == 0
    rows = langid.op9(extra(spark)).collect()
    assert len(rows) == len(AWKWARD)
    assert [r["lang_pred"] for r in rows][:3] == ["und"] * 3 and [r["score"] for r in rows][:3] == [0.0] * 3
    assert {r["lang_pred"] for r in rows[3:]} <= {"en", "fr", "de"}
    assert not [r for r in rows if r["doc_id"] is None][0]["held_out"]


def test_every_letter_of_the_samples_counts(spark):
    rng = random.Random(7)
    scripts = {"zh": [chr(0x4E00 + i) for i in range(900)], "ja": [chr(0x3041 + i) for i in range(80)] + [chr(0x4E00 + i) for i in range(300, 800)], "ko": [chr(0xAC00 + 7 * i) for i in range(700)], "en": list("abcdefghijklmnop"), "xx": [chr(0x20000 + i) for i in range(40)]}
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randint(1, 4))) for _ in range(400)] for k, v in scripts.items()}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    samples = {k: text(k, 1500) for k in scripts}
    model = langid.Model(samples)
    assert len(model.letters) > 1200 and model.wide and model.narrow and langid._OTHER not in model.encode("".join(samples.values()))
    texts = [text(k, 60) for k in model.langs] + [text("zh", 9) + "q\u00e9" + text("en", 400) + text("ko", 30)]
    encoded = [model.encode(t) for t in texts]
    for row, codes in zip(model.phrases(encoded), encoded):
        for lang, n in zip(model.langs, row):
            known, plain = "".join(map(chr, model.encode(samples[lang]))), "".join(map(chr, codes))
            assert n == plain_phrases(known, plain)
    assert [r[0] for r in model.predict(texts)][:-1] == model.langs
    docs = spark.createDataFrame([(1000 * j + i, text(k, 40), k) for j, k in enumerate(scripts) for i in range(60)], "doc_id long, text string, lang string")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all(r["lang_pred"] == lang[r["doc_id"]] for r in langid.op9(docs).collect())


def test_columns_of_own_letters():
    """More than DENSE letters in all, in languages of few letters each, and a letter whose lower case is two characters."""
    samples = {f"l{k}": "".join(chr(0xAC00 + 100 * k + i) for i in range(100)) * 2 for k in range(3)} | {"tr": "\u0130a\u0130b"}
    model = langid.Model(samples)
    assert not model.wide and model.columns is not None and len(model.letters) == 303
    codes = model.encode(samples["l1"][5:60] + samples["l2"][:7] + "\u0130a")
    want = [plain_phrases("".join(map(chr, model.encode(samples[k]))), "".join(map(chr, codes))) for k in model.langs]
    assert model.phrases([codes])[0].tolist() == want


@pytest.mark.parametrize("block", [1, 3, 16, 64])
def test_phrases_cross_blocks(block, monkeypatch):
    """Long phrases over many blocks: whole texts parse as if there were no blocks, dense and sparse."""
    monkeypatch.setattr(langid, "BLOCK", block)
    monkeypatch.setattr(langid, "LANES", 7)
    rng = random.Random(block)
    line = "".join(rng.choice("abcd ") for _ in range(500))
    samples = {"aa": line, "bb": "".join(rng.choice("ab") for _ in range(300)), "cc": line[::-1]}
    texts = [line[40:400] + line[3:90], line[::-1] * 2, "ab" * 90 + line[:200], "x" * 50, "a", "abq" * 33 + line]
    for dense in (langid.DENSE, 0):
        monkeypatch.setattr(langid, "DENSE", dense)
        model = langid.Model(samples)
        assert bool(model.wide) == (dense == 0)
        encoded = [model.encode(t) for t in texts]
        for row, codes in zip(model.phrases(encoded), encoded):
            for lang, n in zip(model.langs, row):
                assert n == plain_phrases(bytes(model.encode(samples[lang])), bytes(codes))


SCRIPTS = {"en": range(0x61, 0x7B), "ru": range(0x430, 0x450), "th": range(0xE01, 0xE2F), "ka": range(0x10D0, 0x10F1), "el": range(0x3B1, 0x3CA), "zh": range(0x4E00, 0x4F80), "ja": range(0x3041, 0x3097), "ko": range(0xAC00, 0xAE00)}


def plain_predict(samples, text):
    """Language, score and bits of a text by searching the samples, one after another."""
    if text is None or not any(unicodedata.category(c)[0] == "L" for c in text):
        return "und", 0.0
    letters = {c.lower() for s in samples.values() for c in s if unicodedata.category(c)[0] == "L"}

    def flat(t):
        out = []
        for c in t:
            c = c.lower() if unicodedata.category(c)[0] == "L" else " "
            c = c if c == " " or c in letters else "\x01"
            if not (c == " " and out and out[-1] == " "):
                out.append(c)
        return "".join(out)

    bits = {}
    for lang, sample in samples.items():
        known = flat(sample)
        bits[lang] = plain_phrases(known, flat(text)) * math.log2(len(known) + 2)
    best = min(bits, key=lambda k: (bits[k], k))
    return best, 1 / sum(2.0 ** min(0, bits[best] - b) for b in bits.values())


def test_many_scripts_and_labels_equal_a_plain_cross_parse(spark):
    """Eight scripts and a hundred labels: language, score and ``und`` of the whole query against brute force."""
    rng = random.Random(11)
    words = {k: ["".join(chr(rng.choice(v)) for _ in range(rng.randint(2, 5))) for _ in range(120)] for k, v in SCRIPTS.items()}
    words |= {f"x{i:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 6))) for _ in range(40)] for i in range(92)}
    rows = [(1000 * j + i, " ".join(rng.choice(words[k]) for _ in range(14)), k) for j, k in enumerate(words) for i in range(4)]
    rows += [(900_000, None, "en"), (900_001, "12 !?", "ru"), (900_002, "", None), (900_003, "\u03c9\u4e00q " + rows[0][1] * 60, None), (None, rows[9][1], "th"), rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = {}
    for i, text, lang in sorted({r for r in rows if None not in r and zlib.crc32(str(r[0]).encode()) % 3 != 1}):
        samples.setdefault(lang, []).append(text)
    model = langid.fit(docs)
    assert len(model.langs) == len(samples) >= 95 and not set(SCRIPTS) - set(model.langs)
    # the order of a sample's texts is a hash's; its phrases differ with it at the joints, so the plain version reads the fitted ones
    order = {r["doc_id"]: r["h"] for r in docs.selectExpr("doc_id", "xxhash64(5, doc_id) AS h").collect()}
    fitted = {k: "" for k in samples}
    for i, text, lang in sorted({r for r in rows if None not in r and zlib.crc32(str(r[0]).encode()) % 3 != 1}, key=lambda r: (r[2], order[r[0]], r[0])):
        fitted[lang] += " " + text
    got = {(r["doc_id"]): r for r in langid.op9(docs).collect()}
    for i, text, _ in rows:
        lang, score = plain_predict(fitted, text)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-9, (i, text)
    right = [got[r[0]]["lang_pred"] == r[2] for r in rows if None not in r and r[2] in SCRIPTS and r[2] in samples]
    assert sum(right) / len(right) > 0.9


def test_tables_beyond_the_dense_one(spark, monkeypatch):
    """Where the dense table has no room, languages are kept in the sparse form, with equal results."""
    rng = random.Random(2)
    samples = {k: "".join(rng.choice("abcde ") for _ in range(300)) for k in ("p", "q", "r")}
    texts = ["".join(rng.choice("abcdef ") for _ in range(n)) for n in (3, 50, 700, 1500)]
    want = langid.Model(samples).predict(texts)
    monkeypatch.setattr(langid, "CELLS", 6000)
    model = langid.Model(samples)
    assert model.wide and model.narrow and model.predict(texts) == want


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "one two", None), (2, "12", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in langid.op9(docs).collect()] == [("und", 0.0)] * 3
    assert [tuple(r) for r in langid.known(docs).collect()] == [(1, "one two", None)]


def test_stage_rejects_what_no_language_explains(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(1)
    noise = " ".join("".join(rng.choice("jkqvwxz") for _ in range(rng.randint(3, 9))) for _ in range(80))
    plain = docs.where("lang = 'fr' and length(text) > 300").first()
    rows = [(70001, noise, None, "s", 1), (70002, "\u4e00\u4e8c\u4e09\u56db" * 30, None, "s", 1), (70003, plain["text"], None, "s", 1), (70004, "a", None, "s", 1), (70005, "4 %", "en", "s", 1)]
    kept = langid.known(docs.unionByName(spark.createDataFrame(rows, docs.schema))).collect()
    by = {r["doc_id"]: r for r in kept}
    assert len(kept) == docs.count() + 2 and by[70003]["lang"] == "fr" and 70004 in by and not {70001, 70002, 70005} & set(by)


def test_a_long_text(spark):
    """Over a megabyte, in thousands of blocks."""
    text = "the quick brown fox jumps over a lazy dog near ten small rivers " * 20_000
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over", "en"), (2, "der schnelle braune fuchs", "de"), (3, "the lazy dog", "en"), (5, "kleine fluesse", "de"), (6, text, None)], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.op9(docs).collect()}[6] == "en"
