"""Planning of requests: robots rules, delays per host, and which answers a bounded cache keeps."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import suffix
from ..shared import numbered

#: Minutes between two requests to a host.
DELAY_MINUTES = 1.0


def host(url: str = "url"):
    return F.lower(F.regexp_extract(url, r"^https?://([^/?#]+)", 1))


def allowed(requests: DataFrame, robots: DataFrame, agent: str = "weblume", url: str = "url") -> DataFrame:
    """Requests with ``allowed`` by their host's robots text. robots: host, robots; a host without a text allows all.

    A host's text is parsed once in a batch of its requests.
    """
    joined = requests.withColumn("__host", host(url)).join(robots.select(F.col("host").alias("__h"), "robots"), F.col("__host") == F.col("__h"), "left")
    names = requests.columns
    position = names.index(url)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsers: dict[str | None, RobotFileParser] = {}
            verdicts = []
            for u, text in zip(batch.column(position).to_pylist(), batch.column(len(names)).to_pylist()):
                if text not in parsers:
                    parsers[text] = RobotFileParser()
                    parsers[text].parse((text or "").splitlines())
                verdicts.append(parsers[text].can_fetch(agent, u or ""))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(verdicts, pa.bool_())], names=[*names, "allowed"])

    from pyspark.sql import types as T

    schema = T.StructType([*requests.schema.fields, T.StructField("allowed", T.BooleanType())])
    return joined.select(*names, "robots").mapInArrow(scan, schema)


def schedule(requests: DataFrame, order: str, delay_minutes: float = DELAY_MINUTES, url: str = "url") -> DataFrame:
    """``start_s``: seconds after the start at which each request may go, one for each host and delay. A host with a third of all
    requests isn't one task."""
    turns = numbered(requests.withColumn("__host", host(url)), "__host", [order], "__turn")
    return turns.withColumn("start_s", (F.col("__turn") * (delay_minutes * 60)).cast("double")).drop("__host", "__turn")


def trimmed(hits: DataFrame, most: int, to: int) -> DataFrame:
    """What a cache of (key, hits) keeps once it has more than ``most`` entries: those with the fewest hits go, all of one
    number of hits at a time, until ``to`` or fewer stay."""
    levels = hits.groupBy("hits").agg(F.count("*").alias("n"))  # one row for each number of hits
    every = Window.orderBy("hits").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    from_here = Window.orderBy("hits").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    keep = levels.withColumn("total", F.sum("n").over(every)).withColumn("left", F.sum("n").over(from_here)).where((F.col("total") <= most) | (F.col("left") <= to))
    return hits.join(keep.select("hits"), "hits", "left_semi").select("key", "hits")


def image_urls(links: DataFrame) -> DataFrame:
    """Each image address once, with the number of its uses: details are read once for all of them."""
    return links.where("link_type = 'img'").groupBy("abs_url").agg(F.count("*").alias("uses"))


def rendered(url: Column) -> Column:
    """Whether a browser is asked for the rendered form of an address: not of images and PDF files."""
    return ~suffix(url).isin("gif", "jpg", "png", "pdf")
