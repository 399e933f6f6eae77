"""PDF files: document properties, addresses of link annotations, and text that is shown, read from the file itself.

This is a reader for plain files: objects and object streams without encryption, streams without a filter or with Flate, literal
and hexadecimal strings, text in fonts with a standard encoding. Files beyond that yield what is found.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STREAM = re.compile(rb"<<((?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
_STRING = rb"(\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>)"
PROPERTIES = ("Title", "Subject", "Keywords", "Author", "Creator", "Producer", "CreationDate", "ModDate")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def text_string(raw: bytes) -> str:
    """A string object as text."""
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1]).decode()
        data = bytes.fromhex(digits + "0" * (len(digits) % 2))
    else:
        data = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], b"" if m[1].strip() == b"" and m[1] != b" " else m[1]), raw[1:-1], flags=re.S)
    if data[:2] == b"\xfe\xff":
        return data[2:].decode("utf-16-be", "replace")
    return data.decode("utf-8" if data[:3] == b"\xef\xbb\xbf" else "latin-1", "replace").lstrip("\ufeff")


def _bodies(blob: bytes) -> list[bytes]:
    """The file and its decoded streams."""
    out = [_STREAM.sub(lambda m: b"<<" + m[1] + b">>", blob)]
    for head, data in _STREAM.findall(blob):
        if b"/FlateDecode" in head:
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                continue
        elif b"/Filter" in head:
            continue
        out.append(data)
    return out


def read(blob: bytes | None) -> dict | None:
    """properties (map), links (addresses in order) and text of a file; None for other data."""
    if not blob or b"%PDF-" not in blob[:1024]:
        return None
    bodies = _bodies(blob)
    properties: dict[str, str] = {}
    for body in bodies:
        for name in PROPERTIES:
            for m in re.finditer(rb"/" + name.encode() + rb"\s*" + _STRING, body):
                properties.setdefault(name, text_string(m[1]))
    pages = sum(len(re.findall(rb"/Type\s*/Page\b(?!s)", b)) for b in bodies)
    links = [text_string(m[1]) for b in bodies for m in re.finditer(rb"/URI\s*" + _STRING, b)]
    shown = []
    for body in bodies[1:]:
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", body, re.S):
            line = "".join(text_string(s) for s in re.findall(_STRING + rb"(?=[^()<>]*?(?:Tj|TJ|'|\"|\[|\(|<|-?\d))", block))
            shown.append(line)
    return {"properties": list((properties | {"Pages": str(pages)}).items()), "links": [x for x in links if x.strip()], "text": "\n".join(shown)}


def files(df: DataFrame) -> DataFrame:
    """From (path, content) of Spark's binary source to (url, properties, links, text)."""
    kind = pa.struct([("properties", pa.map_(pa.string(), pa.string())), ("links", pa.list_(pa.string())), ("text", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                part = batch.slice(at, 50)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([read(b) for b in part.column(1).to_pylist()], kind)], names=["url", "d"])

    made = df.select("path", "content").mapInArrow(scan, "url string, d struct<properties:map<string,string>,links:array<string>,text:string>")
    return made.where("d is not null").select("url", "d.*")


def links(read_files: DataFrame, base: str = "") -> DataFrame:
    """One row for each link annotation: url, href; places are -1."""
    return read_files.select("url", F.explode("links").alias("href"), F.lit(-1).alias("line_no"), F.lit(-1).alias("column_no"))
