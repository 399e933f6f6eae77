import random
import re

import numpy as np
import pytest
import xxhash

from weblume.llm import simhash

from .helpers import AWKWARD, empty, extra


def plain_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows):
    """rows: (id, fp); the least id that each row reaches."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            root[f] = root[root[f]]
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted(((i, f"{f:016x}", least.get(find(f))) for i, f in rows), key=str)


def test_small_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(map(tuple, simhash.op8(docs).collect()), key=str)
    assert got == plain_components([(r["doc_id"], plain_fp(r["text"])) for r in docs.collect()])
    assert len({r[2] for r in got}) < len(got)


def test_awkward_tables(spark):
    assert simhash.op8(empty(spark)).count() == 0
    got = sorted(map(tuple, simhash.op8(extra(spark)).collect()), key=str)
    assert got == plain_components([(r[0], plain_fp(r[1])) for r in AWKWARD])


def clustered(n, seed):
    rng, out = random.Random(seed), set()
    centres = [rng.getrandbits(64) for _ in range(5)]
    while len(out) < n:
        f = rng.choice(centres)
        for _ in range(rng.randrange(6)):
            f ^= 1 << rng.randrange(64)
        out.add(f)
    return [*out, 0, 2**64 - 1, 2**63]


@pytest.mark.parametrize("tile,blocks", [(4096, 6), (5, 6), (4096, 5), (64, 8)])
def test_links_span_every_component(spark, tile, blocks):
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(clustered(300, 4))]
    pairs = simhash.links(spark.createDataFrame(rows, "id long, fp long"), blocks=blocks, tile=tile)
    found = {r["id"]: r["component"] for r in simhash.components(pairs).collect()}
    want = plain_components([(i, f % (1 << 64)) for i, f in rows])
    assert sorted((i, found.get(i, i)) for i, _ in rows) == sorted((i, c) for i, _, c in want)


@pytest.mark.parametrize("radius", [0, 3, 4, 6])
def test_bit_sliced_comparison(radius):
    fps = np.array(clustered(200, 5), dtype=np.uint64)
    rows, hits = simhash.near(fps[:70], simhash.planes(fps), radius, len(fps))
    want = np.bitwise_count(fps[:70, None] ^ fps[None, :]) <= radius
    assert (hits.astype(bool) == want[rows]).all() and len(rows) == want.any(axis=1).sum()
    tree = simhash.forest(fps, None, radius)
    assert len(tree) == len(set(tree)) < len(fps)
    assert {frozenset(g) for g in groups(tree, len(fps))} == {frozenset(g) for g in groups(zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps) <= radius)), len(fps))}


def groups(pairs, n):
    at = list(range(n))
    for a, b in pairs:
        x, y = at[a], at[b]
        at = [x if v == y else v for v in at]
    return [[i for i in range(n) if at[i] == v] for v in set(at)]


def test_components_of_a_long_path(spark):
    n = 700
    pairs = spark.createDataFrame([(i, (i + 1)) for i in range(n)] + [(2000, 2001)], "a long, b long")
    got = {r["id"]: r["component"] for r in simhash.components(pairs).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {2000: 2000, 2001: 2000}


def test_fingerprints_of_long_and_short_texts():
    for t in [None, "", " ", "One", "a b c", "a b c d", "A B c D e", "x " * 70000, "é\x0bb\x1cc d\x85e f"]:
        assert simhash.majority(simhash.shingle_hashes(t)) == plain_fp(t)


def test_block_counts():
    assert [simhash.block_count(n) for n in (0, 10**6, 5 * 10**8, 10**10, 10**12)] == [6, 6, 6, 7, 8]


@pytest.mark.parametrize("radius", [0, 4])
def test_neighbours_in_small_groups(radius):
    fps = np.array(clustered(300, 8), dtype=np.uint64)
    rng = np.random.default_rng(1)
    group = np.repeat(np.arange(300), rng.integers(1, 17, 300))[: len(fps)]
    i, j = simhash.neighbours(fps, group, 16, radius)
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if group[a] == group[b] and int(fps[a] ^ fps[b]).bit_count() <= radius}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)
