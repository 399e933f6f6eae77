"""Feeds, XML and timed text to links and texts, by an event parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import xml_base
from .html import language
from urllib.parse import urljoin

# --- fixed value: the text of a document that can't be parsed
FAILED = "***** XML PARSE FAILED *****"
#: Elements of a feed whose text isn't prose.
FEED_QUIET = frozenset(("icon", "id", "logo", "published", "updated", "uri"))
_WS = re.compile(r"\s+")


def xml_links(content: str | None, base: str) -> list[dict]:
    """``link@href`` inside a feed or rss element. A parse error ends the list where it occurs."""
    out: list[dict] = []
    parser, depth = expat.ParserCreate(), [0]

    def start(tag: str, attrs: dict) -> None:
        if tag in ("feed", "rss"):
            depth[0] += 1
        elif tag == "link" and depth[0] and attrs.get("href", "").strip():
            href = attrs["href"].strip()
            own = attrs.get("hreflang") or attrs.get("lang") or attrs.get("xml:lang")
            out.append({"link_type": "link", "href": href, "abs_url": href if href.startswith("http") else urljoin(xml_base(base), href), "lang": language(own) if own else "unknown", "rel": attrs.get("rel", ""), "line_no": parser.CurrentLineNumber, "column_no": parser.CurrentColumnNumber})

    def end(tag: str) -> None:
        if tag in ("feed", "rss"):
            depth[0] -= 1

    parser.StartElementHandler, parser.EndElementHandler = start, end
    try:
        parser.Parse((content or "").encode(), True)
    except expat.ExpatError:
        pass
    return out


def xml_text(content: str | None, kind: str = "xml") -> dict[str, str]:
    """Text by language. kind: ``feed`` leaves out dates and addresses; ``ttml`` takes its language from ``tt``; both and ``xml``
    follow xml:lang or lang. Text that isn't XML gives one fixed message."""
    spans: dict[str, list[str]] = {}
    parser = expat.ParserCreate()
    parser.buffer_text = True
    stack: list[tuple[str, str]] = []
    state = {"lang": "unknown", "quiet": 0}

    def start(tag: str, attrs: dict) -> None:
        stack.append((tag, state["lang"]))
        own = attrs.get("xml:lang") or attrs.get("lang")
        if own:
            state["lang"] = language(own)
        if kind == "feed" and tag in FEED_QUIET:
            state["quiet"] += 1

    def end(tag: str) -> None:
        _, state["lang"] = stack.pop()
        if kind == "feed" and tag in FEED_QUIET:
            state["quiet"] -= 1

    def text(data: str) -> None:
        if not state["quiet"] and data.strip():
            spans.setdefault(state["lang"], []).append(data)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    try:
        parser.Parse((content or "").encode(), True)
    except expat.ExpatError:
        return {"unknown": FAILED}
    return {k: _WS.sub(" ", " ".join(v)).strip() for k, v in spans.items()}


def texts(df: DataFrame, id_col: str, content_col: str, kind: str = "xml") -> DataFrame:
    """id, lang and text of each language of each document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [list(xml_text(c, kind).items()) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.map_(pa.string(), pa.string()))], names=["id", "t"])

    kind_ = df.schema[id_col].dataType.simpleString()
    made = df.select(id_col, content_col).mapInArrow(scan, f"id {kind_}, t map<string,string>")
    return made.select(F.col("id").alias(id_col), F.explode("t").alias("lang", "text"))


def links(df: DataFrame, id_col: str, url_col: str, content_col: str) -> DataFrame:
    """One row for each feed link."""
    struct = pa.list_(pa.struct([("link_type", pa.string()), ("href", pa.string()), ("abs_url", pa.string()), ("lang", pa.string()), ("rel", pa.string()), ("line_no", pa.int32()), ("column_no", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [xml_links(c, u or "") for u, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, struct)], names=["id", "l"])

    kind = df.schema[id_col].dataType.simpleString()
    made = df.select(id_col, url_col, content_col).mapInArrow(scan, f"id {kind}, l array<struct<link_type:string,href:string,abs_url:string,lang:string,rel:string,line_no:int,column_no:int>>")
    return made.select(F.col("id").alias(id_col), F.inline("l"))


def well_formed(content: str | None) -> str:
    """The parse error of a document, or an empty string."""
    try:
        expat.ParserCreate().Parse((content or "").encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError as e:
        return str(e)
    return ""


def validity(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """Adds ``error``, the parse error of each document, empty for a well-formed one. Validation against levels of a standard is the work
    of outer tools, whose output ``plans.checks.validation`` takes."""
    from pyspark.sql import types as T

    names = df.columns
    at = names.index(content_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([well_formed(c) for c in batch.column(at).to_pylist()], pa.string())], names=[*names, "error"])

    return df.mapInArrow(scan, T.StructType([*df.schema.fields, T.StructField("error", T.StringType())]))
