"""Every operator on texts of more than a megabyte: what stands at their ends counts, and memory chunks are crossed."""

import hashlib
import zlib

import pytest

from weblume.llm import avi, decontamination, lines, mixing, secrets, sharding, simhash, substrings

from .test_simple_ops import check_mix, plain_base, plain_size, with_source
from .test_simhash import plain_components, plain_fp
from .test_text_ops import plain_contamination, plain_dedup, plain_lines

BODY = "\n".join(" ".join(f"w{(i * 7919 + j * 104729) % 50021}" for j in range(25)) for i in range(9000))
PASSAGE = " ".join(f"item{k}" for k in range(60))
SECRET = "token = abcdefgh12345678é " + "0f" * 20
ROWS = [(1, f"{PASSAGE}\nx\ny\nz\nw"), (2, f"{BODY}\n{PASSAGE}\nx\ny\nz\nw\n{SECRET}"), (3, BODY), (4, f"é{BODY[:-1]}"), (5, None), (6, "")]


@pytest.fixture(scope="module")
def docs(spark):
    assert len(BODY) > 1_200_000 > substrings.CHUNK
    return spark.createDataFrame([(i, t, "s") for i, t in ROWS], "doc_id long, text string, source string")


def ordered(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_secrets(docs):
    got = {r["doc_id"]: r["spans"] for r in secrets.op3(docs).collect()}
    for i, text in ROWS:
        base = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in plain_base(text))
        assert got[i] == base and bool(base) == (i == 2)


def test_substrings(docs):
    got = ordered(substrings.op4(docs))
    assert got == plain_dedup(ROWS) and {r[0]: r[2] > 0 for r in got} == {1: False, 2: True, 3: True, 4: True, 5: False, 6: False}


def test_contamination(spark, docs):
    bench = [(9, PASSAGE), (10, "absent words")]
    got = ordered(decontamination.op5(docs, spark.createDataFrame(bench, "item_id long, text string")))
    assert got == plain_contamination(ROWS, bench) and {r[0]: r[2] for r in got}[2] == 60


def test_lines(docs):
    assert ordered(lines.op7(docs)) == plain_lines(ROWS)


def test_fingerprints(docs):
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.op8(docs).collect()}
    assert got == set(plain_components([(i, plain_fp(t)) for i, t in ROWS]))


def test_media(docs):
    got = {r["doc_id"]: r for r in avi.op6(docs).collect()}
    for i, text in ROWS:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (got[i]["n_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"], got[i]["error"]) == (len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), None)


def test_sizes(docs):
    check_mix(with_source(docs))
    assert {r["doc_id"]: r["size"] for r in mixing.op10(docs).collect()} == {i: plain_size(t) for i, t in ROWS}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in sharding.op2(docs).collect()} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS}
