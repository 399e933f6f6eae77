"""CSV: reader and writer options, and a record parser that tells errors by code."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims


@dataclass(frozen=True)
class Dialect:
    """How records are written. With ``binary`` off, characters beyond tab and plain ASCII are errors."""

    sep: str = ","
    quote: str = '"'
    escape: str = '"'
    allow_loose_quotes: bool = False
    allow_loose_escapes: bool = False
    allow_unquoted_escape: bool = False
    allow_whitespace: bool = False
    blank_is_null: bool = False
    empty_is_null: bool = False
    binary: bool = True
    verbatim: bool = False
    max_line_length: int = 0

    def fault(self) -> int:
        """The error code of a dialect that contradicts itself, or 0."""
        marks = (self.quote, self.escape)
        if self.sep in marks:
            return 1001
        if self.allow_whitespace and any(m in (" ", "\t") for m in marks):
            return 1002
        return 1003 if any(c in "\r\n" for c in (self.sep, *marks) if c) else 0

    def options(self) -> dict[str, str]:
        """The same for Spark's reader and writer."""
        out = {"sep": self.sep, "quote": self.quote, "escape": self.escape, "multiLine": "true", "mode": "PERMISSIVE", "nullValue": "" if self.blank_is_null else "\x00", "emptyValue": ""}
        if self.allow_whitespace:
            out |= {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
        if self.max_line_length:
            out["maxCharsPerColumn"] = str(self.max_line_length)
        return out


def read(spark: SparkSession, path: str, schema: str, dialect: Dialect = Dialect(), header: bool = True) -> DataFrame:
    """Records of files with a known schema; bad ones are kept in ``_corrupt_record`` if the schema has it."""
    return spark.read.options(**dialect.options()).option("columnNameOfCorruptRecord", "_corrupt_record").csv(path, schema=schema, header=header)


def write(df: DataFrame, path: str, dialect: Dialect = Dialect(), header: bool = True) -> None:
    df.write.options(**{k: v for k, v in dialect.options().items() if k not in ("multiLine", "mode", "maxCharsPerColumn")}).csv(path, header=header)


_BEYOND = re.compile(r"[^\x09\x20-\x7E]")


def _beyond(field: str, whole: bool, at: int) -> tuple[int, int]:
    """(code, position) of a field that has characters beyond plain ones, where these are errors. whole: it stands in quotes."""
    if whole:
        for mark, code in (("\n", 2021), ("\r", 2022)):
            if mark in field:
                return code, at + field.rindex(mark)
        return 2026, at + len(field)
    if "\n" in field:
        return 2030, at
    if "\r" in field:
        return (2031, at) if field[0] == "\r" else (2032, at + field.rindex("\r"))
    return 2037, at


def parse(line: str | None, d: Dialect = Dialect()) -> tuple[list[str | None], list[bool], int, int]:
    """One record, its line end cut off: (fields, whether each was quoted, error code, its position). No fields beside an error but 0."""
    if code := d.fault():
        return [], [], code, 0
    if line is None:
        return [], [], 0, 0
    fields, quoted, i, n = [], [], 0, len(line)
    own = d.escape != d.quote  # the escape is a character of its own
    while True:
        if d.allow_whitespace:
            while i < n and line[i] in " \t" and line[i] != d.sep:
                i += 1
        if i < n and line[i] == d.quote:
            begin = i
            i, parts = i + 1, []
            while True:
                if i >= n:
                    return [], [], 4002 if own and line[-2:] == d.escape + d.quote and n - begin > 2 else 2027, i
                c = line[i]
                if c == d.escape and i + 1 < n and line[i + 1] in (d.quote, d.escape) and (own or line[i + 1] == d.quote):
                    parts.append(line[i + 1])
                    i += 2
                elif c == d.escape and i + 1 < n and line[i + 1] == "0":
                    parts.append("\0")
                    i += 2
                elif c == d.quote:
                    i += 1
                    break
                elif c == d.escape and own:
                    if not d.allow_loose_escapes or i + 1 >= n:
                        return [], [], 2025, i
                    parts.append(line[i + 1])
                    i += 2
                else:
                    parts.append(c)
                    i += 1
            if d.allow_whitespace:
                while i < n and line[i] in " \t":
                    i += 1
            if i < n and line[i] != d.sep:
                if line[i] == "\r":
                    return [], [], 2010, i
                return [], [], 2011, i
            value, was = "".join(parts), True
            if not d.binary and _BEYOND.search(value):
                return [], [], *_beyond(value, True, begin + 1)
        else:
            end = line.find(d.sep, i)
            end = n if end < 0 else end
            value, was = line[i:end], False
            if d.quote in value and not d.allow_loose_quotes:
                return [], [], 2034, i + value.index(d.quote)
            if not d.binary and _BEYOND.search(value):
                return [], [], *_beyond(value, False, i)
            if own and value[-2:] == d.escape + "\r":
                return [], [], 4003, end
            if not d.verbatim and ("\r" in value or "\n" in value):
                return [], [], *_beyond(value, False, i)
            if own and len(value) > 1 and value.endswith(d.escape):
                return [], [], 4004, end
            if own and d.allow_unquoted_escape:
                value = re.sub(re.escape(d.escape) + "(.)", r"\1", value)
            value = value.rstrip(" \t") if d.allow_whitespace else value
            i = end
        fields.append(None if value == "" and (d.empty_is_null or (d.blank_is_null and not was)) else value)
        quoted.append(was)
        if i >= n:
            return fields, quoted, 0, 0
        i += 1


def continues(text: str, d: Dialect) -> bool:
    """Whether a record goes on in the next line: its quotes are odd in number."""
    return not d.allow_loose_quotes and text.count(d.quote) % 2 == 1


def joined(lines: Iterable[str], d: Dialect = Dialect()) -> Iterator[tuple[int, str]]:
    """(number of its first line, record) of the lines of a file, from 0. A record longer than ``max_line_length`` takes no further
    line, whatever its quotes."""
    held: list[str] = []
    start = odd = size = 0
    for number, line in enumerate(lines):
        if not held:
            start, odd, size = number, 0, 0
        held.append(line)
        odd ^= continues(line, d)
        size += len(line) + (len(held) > 1)
        if not odd or 0 < d.max_line_length < size:
            yield start, "\n".join(held)
            held = []
    if held:
        yield start, "\n".join(held)


#: Lines of a file that are settled together.
BLOCK = 100_000


def multi_line(lines: DataFrame, file: str, number: str, line: str, dialect: Dialect = Dialect()) -> DataFrame:
    """Records of files whose lines are rows: file, first line number and ``record``, lines joined by line feeds.

    A line begins a record where the quotes of all lines before it are even. Files are cut into blocks of BLOCK lines; what a block
    tells the next (its quotes, and its last line that begins a record) is one row, so a large file isn't one task. Where records
    have a greatest length, what comes after depends on where each was cut off, and a file is read by one task.
    """
    slim = lines.select(F.col(file).alias("f"), F.col(number).cast("long").alias("n"), F.coalesce(F.col(line), F.lit("")).alias("v"))
    if dialect.max_line_length:
        kind = lines.schema[file].dataType

        def read(key: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("n")
            first, numbers = list(joined(rows["v"].to_pylist(), dialect)), rows["n"].to_pylist()
            return pa.table({"f": pa.array([key[0].as_py()] * len(first), rows.schema.field("f").type), "n": pa.array([numbers[k] for k, _ in first], pa.int64()), "record": pa.array([r for _, r in first], pa.string())})

        schema = T.StructType([T.StructField("f", kind), T.StructField("n", T.LongType()), T.StructField("record", T.StringType())])
        return slim.groupBy("f").applyInArrow(read, schema).select(F.col("f").alias(file), F.col("n").alias(number), "record")
    odd = F.lit(0) if dialect.allow_loose_quotes else F.length("v") - F.length(F.replace("v", F.lit(dialect.quote), F.lit("")))
    marked = slim.withColumn("q", odd.cast("long")).withColumn("b", F.floor(F.col("n") / F.lit(float(BLOCK))).cast("long"))
    sums = marked.groupBy("f", "b").agg(F.sum("q").alias("all"))
    before = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    known = sums.select(F.col("f").alias("sf"), F.col("b").alias("sb"), F.coalesce(F.sum("all").over(before), F.lit(0)).alias("past"))
    inside = Window.partitionBy("f", "b").orderBy("n")
    placed = marked.join(known, F.col("f").eqNullSafe(F.col("sf")) & (F.col("b") == F.col("sb"))).drop("sf", "sb")
    placed = placed.withColumn("even", (F.col("past") + F.coalesce(F.sum("q").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) % 2 == 0)
    last = placed.groupBy("f", "b").agg(F.max(F.when(F.col("even"), F.col("n"))).alias("last"))
    carried = last.select(F.col("f").alias("sf"), F.col("b").alias("sb"), F.max("last").over(before).alias("carried"))
    begun = F.max(F.when(F.col("even"), F.col("n"))).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    owned = placed.join(carried, F.col("f").eqNullSafe(F.col("sf")) & (F.col("b") == F.col("sb"))).withColumn("start", F.coalesce(begun, F.col("carried")))
    held = F.array_sort(F.collect_list(F.struct("n", "v")))
    return owned.groupBy("f", "start").agg(held.alias("x")).select(F.col("f").alias(file), F.col("start").alias(number), F.array_join(F.transform("x", lambda r: r["v"]), "\n").alias("record"))


def combine(fields: list[str | None], d: Dialect = Dialect()) -> str:
    """A record; fields with a separator, white space, a quote or a control character are quoted."""
    out = []
    for f in fields:
        if f is None:
            out.append("")
        elif any(c == d.sep or c in (d.quote, d.escape) or c.isspace() or c < " " for c in f):
            body = f.replace(d.escape, d.escape * 2) if d.escape != d.quote else f
            out.append(d.quote + body.replace(d.quote, d.escape + d.quote) + d.quote)
        else:
            out.append(f)
    return d.sep.join(out)


def combine_code(fields: list[str | None], d: Dialect = Dialect()) -> int:
    """The error code of a record that can't be written, or 0."""
    return d.fault() or (2110 if not d.binary and any(f and _BEYOND.search(f) for f in fields) else 0)


def combined(columns: list[Column], sep: str = ",", quote: str = '"') -> Column:
    """``combine`` as a column expression, for the escape that doubles quotes."""

    def one(c: Column) -> Column:
        return F.when(c.isNull(), "").when(c.rlike(rf"[\s\x00-\x1F{sep}{quote}]"), F.concat(F.lit(quote), F.replace(c, F.lit(quote), F.lit(quote * 2)), F.lit(quote))).otherwise(c)

    return F.concat_ws(sep, *[one(c) for c in columns])


def parse_lines(df: DataFrame, id_col: str, line_col: str, dialect: Dialect = Dialect()) -> DataFrame:
    """id, fields, quoted, error (code), error_text and position of every record."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(x, dialect) for x in batch.column(1).to_pylist()]
            kinds = [pa.list_(pa.string()), pa.list_(pa.bool_()), pa.int32(), pa.int32()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns[:3], pa.array([dims.CSV_ERRORS[r[2]] for r in rows], pa.string()), columns[3]], names=["id", "fields", "quoted", "error", "error_text", "position"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, line_col).mapInArrow(scan, f"id {kind}, fields array<string>, quoted array<boolean>, error int, error_text string, position int").withColumnRenamed("id", id_col)


def page_of(df: DataFrame, order: str, offset: int, length: int | None = None) -> DataFrame:
    """Records from an offset on; a negative one counts from the end. Values of ``order`` tell records apart.

    Without a length, the record at the offset is found, and those before it are filtered out: the rest isn't sorted in one task.
    """
    if offset >= 0:
        if length is not None:
            return df.orderBy(order).offset(offset).limit(length)
        first = df.select(order).orderBy(order).offset(offset).first()
        return df.limit(0) if first is None else df.where(F.col(order) >= F.lit(first[0]))
    tail = df.orderBy(F.desc(order)).limit(-offset).orderBy(order)
    return tail if length is None else tail.limit(length)
