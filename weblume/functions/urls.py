"""Address functions."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def url_parts(c: Column) -> dict[str, Column]:
    """protocol, domain (lower case), dir and query of an http address; empty for others."""
    return {
        "protocol": F.regexp_extract(c, r"^(https?)://", 1), "domain": F.lower(F.regexp_extract(c, r"^https?://([^/\s]+)", 1)),
        "dir": F.regexp_extract(c, r"^https?://[^/]+/([^?#]*)", 1), "query": F.when(c.startswith("http"), F.regexp_extract(c, r"^[^?#]*(.*)$", 1)).otherwise(""),
    }


def is_on_page(href: Column) -> Column:
    return href.rlike(r"^[#?]")


@F.pandas_udf(StringType())
def _join(base: pd.Series, href: pd.Series) -> pd.Series:
    def one(b, h):
        try:
            return None if h is None else urljoin(b or "", h)
        except ValueError:
            return h

    return pd.Series([one(b, h) for b, h in zip(base, href)])


def absolute(href: Column, base: Column, onclick: Column | None = None) -> Column:
    """The address that a link leads to: its onclick unless that is a script, else the href resolved against the base."""
    resolved = _join(base, href)
    if onclick is None:
        return resolved
    return F.when((onclick != "") & ~onclick.startswith("javascript:"), onclick).otherwise(resolved)


def rooted(href: Column, base: Column) -> Column:
    """``absolute`` for addresses that begin with a slash or a protocol, without leaving the JVM; null for others."""
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^(https?:)", 1), href)).when(href.startswith("/"), F.concat(origin, href))


def xml_base(base: str) -> str:
    """The base of a feed: up to the last slash; a bare host gets one."""
    return base if base.endswith("/") else base + "/" if re.fullmatch(r"https?://[^/]+", base) else base[: base.rfind("/") + 1]


def suffix(url: Column) -> Column:
    """Lower-case file suffix of an address."""
    return F.lower(F.regexp_extract(F.regexp_extract(url, r"^([^?#]*)", 1), r"\.([A-Za-z0-9]+)$", 1))


def mime_branch(mime: Column, url: Column) -> Column:
    """Which extractor an answer goes to."""
    return (
        F.when(mime.startswith("text/html"), "html").when(mime.startswith("text/css"), "css").when(mime == "application/pdf", "pdf")
        .when(mime.isin("application/atom+xml", "application/ttml+xml", "application/xhtml+xml", "text/xml", "application/xml") | (suffix(url) == "xml"), "xml").otherwise("none")
    )
