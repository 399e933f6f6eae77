import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow.compute  # noqa: F401
import pytest

from weblume.llm import chat, decontamination, lines, substrings

from .helpers import AWKWARD, DOCS, awkward, empty, extra


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- substring dedup


def plain_dedup(rows):
    """rows: (id, text); windows of fifty words against every document with a smaller id."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        for a in range(len(w) - 49 if i is not None else 0):
            key = tuple(w[a : a + 50])
            least[key] = min(i, least.get(key, i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for a in range(len(w) - 49 if i is not None else 0):
            if least[tuple(w[a : a + 50])] < i:
                gone.update(range(a, a + 50))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=str)


def test_cover_is_a_difference_cover():
    for a in range(31):
        assert any((x - y) % 31 == a for x in substrings.COVER for y in substrings.COVER)


def test_substrings_of_small_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(map(tuple, substrings.op4(docs).collect()), key=str)
    assert got == plain_dedup(rows) and sum(r[2] for r in got) > 0


def passages(seed, n=40):
    rng = np.random.default_rng(seed)
    vocab = [f"w{k}" for k in range(3000)] + ["é", "\x1cx", "ß\x85"]
    shared = [[vocab[k] for k in rng.integers(0, len(vocab), size)] for size in (49, 50, 51, 80, 150)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.integers(1, 5)):
            parts += [vocab[k] for k in rng.integers(0, len(vocab), rng.integers(0, 60))]
            if rng.random() < 0.7:
                s = shared[rng.integers(len(shared))]
                parts += s[rng.integers(0, 3) :]
        rows.append((int(rng.integers(0, 1000)) if i % 7 else None if i % 14 else 5, rng.choice([" ", "\n", "\t \x0b"]).join(parts)))
    rows += [(7, "z " * 200), (8, "z " * 60), (9, "z " * 49), (3000, rows[3][1]), (3001, rows[3][1]), rows[4]]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_of_planted_passages(spark, seed, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 2000)
    rows = passages(seed)
    got = sorted(map(tuple, substrings.op4(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == plain_dedup(rows)


@pytest.mark.parametrize("chunk,most", [(64, 1 << 20), (700, 16)])
def test_substrings_of_long_texts(spark, chunk, most, monkeypatch):
    """Texts of many segments, with windows over their edges, and a task that forgets what it has settled."""
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    monkeypatch.setattr(substrings, "MOST", most)
    rng = np.random.default_rng(9)
    long = " ".join(f"w{k}" for k in rng.integers(0, 9000, 1500))
    words = long.split()
    rows = [(5, long), (9, " \t" + long[:4000] + "  x  " + long[3000:]), (3, " ".join(words[700:760])), (4, " ".join(words[1440:])), (12, " ".join(words[200:900]) + " y"), (13, "q" * 5000 + " " + " ".join(words[:60])), (14, " ".join(words[:49])), (15, " ".join(words[:60]) * 2)]
    rows += [(100 + i, " ".join(words[300:360]) + f" tail{i}") for i in range(30)]
    got = sorted(map(tuple, substrings.op4(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()), key=str)
    assert got == plain_dedup(rows) and sum(r[2] > 0 for r in got) > 30


def test_substrings_of_a_long_text_in_pieces():
    """Anchors and windows of the pieces are those of the whole text; a megabyte and more."""
    text = " ".join(f"word{k * k % 99991}" for k in range(150_000)).encode()
    assert len(text) > substrings.CHUNK
    whole = substrings.Words([text])
    places, hashes = whole.anchors()
    met = {}
    for number, pieces, base, own in substrings._chunks([text, b"a b", b""]):
        words = substrings.Words(pieces, base)
        at, h = words.anchors()
        met |= {int(p): int(x) for p, x, i in zip(words.place[at] + words.base[words.owner[at]], h, np.array(number)[words.owner[at]]) if i == 0}
    assert met == dict(zip(places.tolist(), hashes.tolist()))


def test_substrings_against_sql(spark, sf):
    from weblume.llm import registry

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM read_parquet('{sf}/documents.parquet')")
    want = sorted(con.sql(registry.ORACLES["op4_substring_dedup"]).fetchall(), key=str)
    assert sorted(map(tuple, registry.QUERIES["op4_substring_dedup"](spark, sf).collect()), key=str) == want


def test_frequent_anchors_are_dealt(spark):
    """A passage in all documents of a task: a few rows meet in its key, the others are dealt by their texts."""
    import pyarrow as pa

    passage = " ".join(f"p{k}" for k in range(60))
    texts = [f"{passage} own{i} {i}" for i in range(9000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, a + 3000), pa.int64()), pa.array(texts[a : a + 3000])], names=["d", "text"]) for a in (0, 3000, 6000)]
    rows = pa.Table.from_batches(list(substrings._anchor_rows(iter(batches))))
    hits = Counter(rows.filter(pa.compute.equal(rows["salt"], 0))["h"].to_pylist())
    assert max(hits.values()) <= 2 and rows.num_rows > 9000 * 5


def test_substrings_of_awkward_tables(spark):
    assert substrings.op4(empty(spark)).count() == 0
    got = sorted(map(tuple, substrings.op4(extra(spark)).collect()), key=str)
    assert got == plain_dedup([(r[0], r[1]) for r in AWKWARD])


# -- decontamination


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_contamination(docs, bench):
    spans = {}
    for item, text in bench:
        w = plain_terms(text)
        for a in range(max(1, len(w) - 12) if w and item is not None else 0):
            spans.setdefault(tuple(w[a : a + 13]), set()).add(str(item))
    sizes, out = {len(s) for s in spans}, []
    for i, text in docs:
        w, hit, items = plain_terms(text), set(), set()
        for m in sizes:
            for a in range(len(w) - m + 1):
                if found := spans.get(tuple(w[a : a + m])):
                    hit.update(range(a, a + m))
                    items |= found
        out.append((i, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


BENCH = [(1, "One TWO three"), (10, "a b c d e f g h i j k l m n o"), (9, "b c d e f g h i j k l m n"), (2, None), (3, "!!"), (4, ""), (None, "one"), (5, "É x é"), (6, "x x x")]


@pytest.mark.parametrize("size,rows,rarest", [(64 << 20, 1 << 20, 3), (0, 0, 3), (64 << 20, 0, 1), (0, 1 << 20, 13)])
def test_contamination(spark, monkeypatch, size, rows, rarest):
    for name, value in (("BROADCAST_BYTES", size), ("BROADCAST_ROWS", rows), ("RAREST", rarest), ("FREQUENT", 2)):
        monkeypatch.setattr(decontamination, name, value)
    docs = [(r[0], r[1]) for r in AWKWARD] + [(20, "z " * 300 + "a b c d e f g h i j k l m n o p"), (21, "--A b,c d e f g h i j k l m n o. one two three"), (22, "É x é É x É é x É"), (23, "x x x x x"), (24, "one two Three " * 4000), (21, "one"), (None, None)]
    got = decontamination.op5(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == plain_contamination(docs, BENCH)


def test_contamination_of_small_documents(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = sorted(map(tuple, decontamination.op5(docs, bench).collect()), key=str)
    assert got == plain_contamination([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    assert any(r[5] for r in got)
    clean = decontamination.clean(docs, bench)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == sorted(r[0] for r in got if not r[5])


def test_contamination_without_rows(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontamination.op5(empty(spark), bench).count() == 0
    rows = decontamination.op5(extra(spark), bench.limit(0)).collect()
    assert len(rows) == len(AWKWARD) and not any(r["contaminated"] or r["n_hit"] for r in rows)


def plain_near(docs, bench, slack):
    """All (id, start, size, items): every window at every place of its rarest term, uses matched to positions one by one."""
    seen = Counter(t for _, x in docs for t in plain_terms(x))
    spans, out = {}, set()
    for item, text in bench:
        w = plain_terms(text)
        for a in range(max(1, len(w) - 12) if w and item is not None else 0):
            spans.setdefault(tuple(w[a : a + 13]), set()).add(item)
    for i, text in docs:
        w = plain_terms(text)
        for span, items in spans.items():
            rarest = min(span, key=lambda t: (seen[t], span.index(t)))
            for p in (p for p, t in enumerate(w) if t == rarest):
                start, ok = p - span.index(rarest), True
                for term in set(span):
                    last = -1
                    for place in (start + o for o, t in enumerate(span) if t == term):
                        free = [q for q in range(max(0, place - slack, last + 1), min(len(w), place + slack + 1)) if w[q] == term]
                        ok, last = ok and bool(free), free[0] if free else len(w)
                if ok:
                    out.add((i, start, len(span), tuple(sorted(items))))
    return out


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha one beta two gamma"), (2, "alpha beta"), (3, "gamma beta alpha"), (4, "alpha " + "x " * 20 + "beta gamma")], "doc_id long, text string")
    assert {r["doc_id"] for r in decontamination.near(docs, bench, slack=3).collect()} == {1}  # in 3, alpha is 4 from its place
    assert {r["doc_id"] for r in decontamination.near(docs, bench, slack=4).collect()} == {1, 3}


@pytest.mark.parametrize("size,rarest", [(64 << 20, 3), (0, 2)])
def test_proximity_equals_brute_force(spark, monkeypatch, size, rarest):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", size)
    monkeypatch.setattr(decontamination, "RAREST", rarest)
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(rng.choice(list("abcdefg"), rng.integers(0, 60)))) for i in range(40)] + [(90, None), (None, "a b a"), (91, ""), (95, "a b c d")]
    bench = [(k, " ".join(rng.choice(list("abcdefg"), k))) for k in (1, 2, 3, 4, 5, 14)] + [(20, "a b a"), (21, None), (None, "c"), (22, "zz a")]
    for slack in (1, 3):
        got = decontamination.near(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), slack).collect()
        rows = [(r["doc_id"], r["start"], r["size"], tuple(sorted(r["items"]))) for r in got]
        assert Counter(rows) == Counter(plain_near(docs, bench, slack)) and rows


def test_proximity_query(spark, sf):
    from weblume.llm import registry

    docs, bench = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = {}
    for i, start, size, items in plain_near(docs, bench, 3):
        starts, held = want.setdefault(i, (set(), set()))
        starts.add((start, size))
        held.update(items)
    got = {r["doc_id"]: (r["n_starts"], r["n_items"]) for r in registry.QUERIES["op5_proximity"](spark, sf).collect()}
    assert got == {i: (len(a), len(b)) for i, (a, b) in want.items()} and got


def test_no_key_gathers_all_documents(spark, monkeypatch):
    """Beyond the broadcast bounds, with a term in all documents: no partition of the postings has more than its share."""
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('common ', id % 50, ' rare', id % 7) AS text")
    slim = decontamination.keyed(docs)
    plan = decontamination.planned(slim, spark.createDataFrame([(1, "common 5 rare5"), (2, "common 6")], "item_id long, text string"))
    rows, index = decontamination.postings(slim, plan)
    sizes = [r["count"] for r in index.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()]
    assert rows.count() == 3000 and max(sizes) < 2 * sum(sizes) / len(sizes)


# -- chat


def test_chat_query_reads_back(spark, sf):
    conv = spark.read.parquet(f"{sf}/conversations.parquet")
    odd = spark.createDataFrame(
        [(90001, 0, "user", None), (90001, 1, "assistant", "\\ <s> </s>\\[INST][/ROLE] <\\s> ünï\n"), (90001, 1, "assistant", "\\"), (90002, None, None, "[ROLE]"), (None, 3, "assistant", "x<"), (90003, 0, "a[/ROLE]b", "[INST]y[/INST]")],
        "conv_id long, turn long, role string, text string",
    )
    both = conv.unionByName(odd)
    rows = [tuple(r) for r in both.collect()] + [(-7, 0, "user", chat.PLANTED), (-7, 1, "assistant", chat.PLANTED)]
    told = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or "")):
        told.setdefault(c, []).append((r or "", x or ""))
    got = {r["conv_id"]: r for r in chat.op1(both).collect()}
    assert got.keys() == told.keys()
    for c, turns in told.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for r, x in turns)), c
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == sha(loss) and got[c]["formatted_chars"] > len(loss)
    made = chat.format_trees(chat.threads(both))
    for r in made.collect():
        assert len(re.findall(r"<s>", r["formatted"])) == len(told[r["tree"]]) == len(re.findall(r"</s>", r["formatted"]))
    assert chat.op1(conv.limit(0)).count() == 1


def test_reply_trees(spark):
    rows = [("t", "r", None, "user", "q", 1.0), ("t", "a", "r", "assistant", "A", 2.0), ("t", "b", "r", "assistant", "B", 5.0), ("t", "c", "a", "user", "C", 9.0), ("t", "d", "c", "assistant", "D", None),
            ("u", "r", "gone", "user", "alone", None), (None, "r", None, "user", "x", 0.0), (None, "s", "r", "assistant", "y", 0.0)]
    messages = spark.createDataFrame(rows, "tree string, node string, parent string, role string, text string, score double")
    every = {(r["tree"], r["leaf"]): r for r in chat.format_trees(messages, None).collect()}
    assert set(every) == {("t", "d"), ("t", "b"), ("u", "r"), (None, "s")}
    assert (every["t", "d"]["rank"], every["t", "d"]["score"], every["t", "b"]["rank"]) == (1, 12.0, 2)
    assert every["t", "d"]["formatted"] == "<s>[ROLE]user[/ROLE][INST]q[/INST]</s><s>[ROLE]assistant[/ROLE]A</s><s>[ROLE]user[/ROLE][INST]C[/INST]</s><s>[ROLE]assistant[/ROLE]D</s>"
    text = every["t", "d"]["formatted"]
    assert [text[s["start"] : s["end"]] for s in every["t", "d"]["loss_spans"]] == ["A", "D"]
    assert len(chat.format_trees(messages).collect()) == 3
    deep = spark.range(300).selectExpr("1 AS tree", "id AS node", "CASE WHEN id > 0 THEN id - 1 END AS parent", "'user' AS role", "cast(id AS string) AS text", "0.0 AS score")
    (only,) = chat.format_trees(deep, None).collect()
    assert [int(x) for x in re.findall(r"\[INST\](\d+)", only["formatted"])] == list(range(300))


def plain_paths(rows):
    """{(tree, leaf): nodes from the root} of (tree, node, parent) rows; the smallest node of a circle is its root."""
    parent = {(t, n): p for t, n, p in rows if p is not None and any((t, p) == r[:2] for r in rows)}
    for key in sorted(parent, key=str):
        seen, at = [key], key
        while at in parent and (key[0], parent[at]) not in seen:
            at = (key[0], parent[at])
            seen.append(at)
        if at in parent:  # round in a circle
            first = (key[0], parent[at])
            del parent[min(seen[seen.index(first) :], key=lambda k: k[1])]
    out = {}
    for t, n, _ in rows:
        if not any((t, n) == (k[0], p) for k, p in parent.items()):
            path = [n]
            while (t, path[-1]) in parent:
                path.append(parent[t, path[-1]])
            out[t, n] = path[::-1]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_reply_trees(spark, seed):
    """Paths, ranks and texts of random trees with scores, missing parents and circles, against a plain walk."""
    rng = np.random.default_rng(seed)
    rows = []
    for tree in [None, *range(1, 12)]:
        n = int(rng.integers(1, 25))
        for node in range(n):
            kind = rng.random()
            parent = None if kind < 0.1 else int(rng.integers(0, n + 2)) if kind < 0.3 else int(rng.integers(0, max(node, 1)))  # some beyond, some in circles
            rows.append((tree, node, parent, str(rng.choice(["user", "assistant"])), f"t{node}", float(rng.integers(0, 4)) if rng.random() < 0.8 else None))
    want, score = plain_paths([r[:3] for r in rows]), {r[:2]: r[5] or 0.0 for r in rows}
    text = {r[:2]: r[4] for r in rows}
    got = chat.format_trees(spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double"), None).collect()
    assert len(got) == len(want)
    for r in got:
        path = want[r["tree"], r["leaf"]]
        assert re.findall(r"\[/ROLE\](?:\[INST\])?(t\d+)", r["formatted"]) == [text[r["tree"], n] for n in path]
        assert r["score"] == sum(score[r["tree"], n] for n in path)
        better = [k for k in want if k[0] == r["tree"] and (-sum(score[k[0], n] for n in want[k]), k[1]) < (-r["score"], r["leaf"])]
        assert r["rank"] == len(better) + 1
    best = chat.format_trees(spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double"), 2).collect()
    assert {(r["tree"], r["leaf"]) for r in best} == {(r["tree"], r["leaf"]) for r in got if r["rank"] <= 2}


def test_replies_in_a_circle(spark):
    """A circle's smallest message is its root; rows stay as many as paths have messages."""
    rows = [(1, 1, 2), (1, 2, 1), (1, 3, 1), (2, 5, 5), (3, 8, 7), (3, 7, 9), (3, 9, 8), (3, 10, 8), (4, 1, None), (4, None, 1)]
    got = {}
    for r in chat.paths(spark.createDataFrame(rows, "tree long, node long, parent long")).collect():
        got.setdefault((r["tree"], r["leaf"]), []).append((-r["up"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {(1, 2): [1, 2], (1, 3): [1, 3], (2, 5): [5], (3, 9): [7, 8, 9], (3, 10): [7, 8, 10], (4, 1): [1]}


def test_chat_of_awkward_tables(spark):
    """Null turns and ids, an empty table, a very long text, ties and clashing columns."""
    from pyspark.sql import functions as F

    long = "<s>é[INST]\\" * 150_000
    rows = [(1, None, "user", "first"), (1, 0, "assistant", long), (1, 0, "assistant", None), (1, 0, None, "n"), (None, None, None, None), (2, 1, "assistant", "x"), (2, 1, "assistant", "x")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("tree", "node", "parent", "score", "rank", "formatted"):
        conv = conv.withColumn(name, F.lit("mine"))
    got = {r["conv_id"]: r for r in chat.op1(conv).collect()}
    turns = [("user", "first"), ("", "n"), ("assistant", ""), ("assistant", long)]
    assert got[1]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for r, x in turns)) and got[1]["loss_sha256"] == sha(long) and got[1]["loss_chars"] == len(long)
    assert got[2]["n_turns"] == 2 and got[2]["loss_chars"] == 2 and got[None]["n_turns"] == 1 and set(got) == {1, 2, None, -7}


# -- lines


def plain_lines(rows):
    first = {}
    docs = sorted({(i, t) for i, t in rows if i is not None and t is not None})
    for i, t in docs:
        x = t.split("\n")
        for a in range(len(x) - 3):
            first[tuple(x[a : a + 4])] = min((i, a), first.get(tuple(x[a : a + 4]), (i, a)))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, 0, 0, sha("")))
            continue
        x, gone = t.split("\n"), set()
        for a in range(len(x) - 3 if i is not None else 0):
            if first[tuple(x[a : a + 4])] < (i, a):
                gone.update(range(a, a + 4))
        out.append((i, len(x), len(gone), sha("\n".join(v for k, v in enumerate(x) if k not in gone))))
    return sorted(out, key=str)


def test_lines(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = np.random.default_rng(3)
    block = ["p", "q", "", "r", "s", "t"]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(r[0], r[1]) for r in AWKWARD]
    rows += [(2000 + k, "\n".join([str(x) for x in rng.integers(0, 3, rng.integers(0, 30))] + block[rng.integers(0, 3) :])) for k in range(40)] + [(3000, "a\n" * 30), (3000, "b\n" * 5)]
    got = sorted(map(tuple, lines.op7(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == plain_lines(rows) and sum(r[2] > 0 for r in got) > 10


def test_a_hot_line_is_dealt(spark):
    """A run that a third of all texts have: the joined rows of its key are spread over the tasks."""
    from weblume.llm.common import settled

    rows = [(i, f"a{i}\nb{i}\n" + ("x\ny\nz\nw\n" if i % 3 == 0 else f"c{i}\nd{i}\n") + f"e{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "xxhash64(text) AS d", "text")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = settled(lines.fingerprints(docs), ["fp"], lines.F.col("at"), ["id"])
        sizes = [r["count"] for r in joined.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) >= 1000 and max(sizes) < 0.5 * sum(sizes)
    got = sorted(map(tuple, lines.op7(docs.selectExpr("id AS doc_id", "text")).collect()), key=str)
    assert got == plain_lines(rows)


def test_lines_of_awkward_tables(spark):
    assert lines.op7(empty(spark)).count() == 0
    assert sorted(map(tuple, lines.op7(extra(spark)).collect()), key=str) == plain_lines([(r[0], r[1]) for r in AWKWARD])


def plain_every_line(rows):
    first = {}
    for i, t in sorted({(i, t) for i, t in rows if i is not None and t is not None}):
        for a, v in enumerate(t.split("\n")):
            first[v] = min((i, a), first.get(v, (i, a)))
    out = []
    for i, t in rows:
        x = [] if t is None else t.split("\n")
        kept = [v for a, v in enumerate(x) if i is None or first[v] >= (i, a)]
        out.append((i, len(x), len(x) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def test_every_repeated_line_goes(spark, sf):
    from weblume.llm import registry

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(r[0], r[1]) for r in AWKWARD]
    rows += [(5000, "only one"), (5001, "only one"), (5002, "x y\nonly one"), (5003, "p\nq"), (5004, "r\np\nq\np\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, lines.op7_every_line(docs).collect()), key=str)
    assert got == plain_every_line(rows) and {(r[0], r[2]) for r in got} >= {(5001, 1), (5002, 1), (5004, 5)}
    assert lines.op7_every_line(empty(spark)).count() == 0
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM read_parquet('{sf}/documents.parquet')")
    of_sql = sorted(con.sql(registry.ORACLES["op7_every_line"]).fetchall(), key=str)
    assert sorted(map(tuple, registry.QUERIES["op7_every_line"](spark, sf).collect()), key=str) == of_sql and sum(r[2] for r in of_sql) > 0
