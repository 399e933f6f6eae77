"""The pipeline stage by stage against brute force."""

from collections import Counter, defaultdict

import regex

import corpus_pipeline as cp
from weblume.llm import mixing, sharding

from .helpers import awkward, empty, extra
from .test_simhash import plain_components, plain_fp
from .test_simple_ops import plain_size, plain_targets
from .test_text_ops import plain_contamination


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def stages(spark, docs, sf, tmp_path):
    out = []
    for i, (_, f) in enumerate(cp.STAGES):
        f(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        out.append(docs)
    return out


def test_stages(spark, sf, tmp_path):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    junk = spark.createDataFrame([(9001, "123 %%%", "en", "src1", 7), (9002, None, "en", "src1", 0)], documents.schema)
    first = documents.unionByName(junk)
    known, single, clean, mixed, shards = stages(spark, first, sf, tmp_path)
    assert all(s.columns == documents.columns for s in (known, single, clean, mixed))

    start = rows_of(first)
    assert sorted(rows_of(known)) == sorted(r for r in start if regex.search(r"\p{L}", r[1] or ""))

    want = {c for i, _, c in plain_components([(r[0], plain_fp(r[1])) for r in rows_of(known)])}
    assert sorted(rows_of(single)) == sorted(r for r in rows_of(known) if r[0] in want) and len(want) < known.count()

    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {r[0] for r in plain_contamination([(r[0], r[1]) for r in rows_of(single)], bench) if r[5]}
    assert sorted(rows_of(clean)) == sorted(r for r in rows_of(single) if r[0] not in bad) and bad

    before, after = rows_of(clean), rows_of(mixed)
    sizes, taken, most = Counter(), Counter(), defaultdict(int)
    for r in before:
        sizes[r[3]] += plain_size(r[1])
        most[r[3]] = max(most[r[3]], plain_size(r[1]))
    for r in after:
        taken[r[3]] += plain_size(r[1])
    goal = plain_targets(sizes)
    assert set(after) <= set(before) and max(Counter(after).values()) <= 3
    assert all(abs(taken[s] - goal[s]) <= most[s] / 2 + 1 for s in sizes)

    last = shards.collect()
    assert Counter(tuple(r)[:5] for r in last) == Counter(after)
    slots = defaultdict(list)
    for r in last:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and sorted(map(len, slots.values())) == sorted(x for x in sharding.shard_sizes(len(after), 16) if x)
    assert sorted(rows_of(cp.run(spark, sf)), key=str) == sorted(rows_of(cp.run(spark, sf)), key=str)


def test_stages_take_awkward_tables(spark, sf, tmp_path):
    docs = awkward(spark)
    kept = rows_of(cp.language_id(spark, docs, sf))
    # the only row here that is learned from is the English one with the id 7, so a null language becomes English
    assert Counter(kept) == Counter((r[0], r[1], r[2] or "en", *tuple(r)[3:]) for r in docs.collect() if regex.search(r"\p{L}", r["text"] or ""))
    single = rows_of(cp.simhash_dedup(spark, docs, sf))
    assert sorted((r[0] for r in single), key=str) == sorted({c for _, _, c in plain_components([(r["doc_id"], plain_fp(r["text"])) for r in docs.collect()] ) if c is not None} | {None}, key=str)
    assert Counter(rows_of(cp.decontaminate(spark, docs, sf))) == Counter(tuple(r) for r in docs.collect())
    assert set(rows_of(cp.mix_sources(spark, docs, sf))) <= {tuple(r) for r in docs.collect()}
    for _, f in cp.STAGES:
        assert f(spark, empty(spark), sf).count() == 0
    wide = extra(spark)
    for _, f in cp.STAGES[:-1]:
        out = f(spark, wide, sf)
        assert out.columns == wide.columns and out.filter("size = 'mine' and id = 'mine'").count() == out.count()


def test_copies_are_spread(spark):
    """Rows alike are placed independently."""
    df = spark.range(4000).selectExpr("id % 4 AS doc_id")
    rows = sharding.shard(df, ["doc_id"], 4).collect()
    hits = Counter((r["doc_id"], r["shard"]) for r in rows)
    assert len(hits) == 16 and all(200 < n < 300 for n in hits.values())
    runs = sum(a["doc_id"] == b["doc_id"] for a, b in zip(*[sorted((r for r in rows if r["shard"] == 0), key=lambda r: r["slot"])[i:] for i in (0, 1)]))
    assert runs < 350


def test_mix_writes_copies(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "x", 3), (2, "c d e f", "en", "y", 7), (3, "g " * 60, "en", "z", 120)], "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(r["doc_id"] for r in mixing.mixed(docs).collect()) == {1: 3, 2: 3, 3: 1}
