"""Configuration text to dimension tables: language maps and models, profiles, help addresses, section markers, ARIA roles."""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(text: str) -> list[str]:
    return [x.strip() for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their order in each file: path, line_no (from 1), value."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", r"\r?\n").alias("v"))
    return whole.select("path", F.posexplode("v").alias("n", "value")).select("path", (F.col("n") + 1).alias("line_no"), "value")


def language_model(spark: SparkSession, path: str) -> DataFrame:
    """ngram and rank of model files: the leading run of characters that are neither digits nor space, ranked by its line."""
    rows = text_lines(spark, path).withColumn("ngram", F.regexp_extract("value", r"^([^0-9\s]+)", 1)).where("ngram <> ''")
    return rows.select("path", "ngram", F.col("line_no").alias("rank"))


def language_map(text: str) -> list[tuple[str, str]]:
    """(code, model file) of each line; comments and blank lines are left out."""
    return [tuple(x.split(None, 1)) for x in _lines(text) if len(x.split(None, 1)) == 2]


def available_models(listed: list[tuple[str, str]], folder: str) -> tuple[list[tuple[str, str]], list[str]]:
    """The rows whose model is there, and the names of the files that aren't."""
    found = [(c, f) for c, f in listed if os.path.exists(os.path.join(folder, f))]
    return found, sorted({f for _, f in listed} - {f for _, f in found})


def help_urls(text: str) -> list[tuple[str, str, str]]:
    """(testcase, lang, url) of each line."""
    return [tuple(x.split(None, 2)) for x in _lines(text) if len(x.split(None, 2)) == 3]


def profiles(text: str) -> list[tuple[str, str, str, str]]:
    """(profile, lang, tcid, value) of blocks ``<name>_Profile_<lang> "profile"`` ... ``end``. A line ``tcid ID`` selects a test
    case; ``testcase_data ID value`` gives it data; other lines are parameters."""
    rows, open_ = [], None
    for line in _lines(text):
        if m := re.match(r"\w*_Profile_(\w+)\s+(.+)", line):
            open_ = (m[2].strip('"'), m[1])
        elif re.match(r"(?:end|\w*_Profile_End)\b", line, re.I):
            open_ = None
        elif open_:
            word, _, rest = line.partition(" ")
            if word == "tcid":
                rows.append((*open_, rest.strip(), ""))
            elif word == "testcase_data":
                tcid, _, value = rest.strip().partition(" ")
                rows.append((*open_, tcid, value.strip()))
            else:
                rows.append((*open_, word, rest.strip()))
    return rows


def section_markers(text: str) -> list[tuple[str, str, str]]:
    """(section, subsection, marker) between the start and end lines, each marker once: its first place counts."""
    rows, seen, inside = [], set(), False
    for line in _lines(text):
        if line.startswith("CONTENT_SECTION_"):
            inside = line.endswith("START")
            continue
        parts = line.split()
        if inside and len(parts) == 3 and parts[2] not in seen:
            seen.add(parts[2])
            rows.append(tuple(parts))
    return rows


def aria_roles(rdf: str) -> list[dict]:
    """Roles of an RDF taxonomy: id, must_contain, required, scope, supported and subclass_of, and whether it is a landmark (a
    direct subclass of one)."""
    rows = []
    for node in ET.fromstring(rdf).iter():
        if not node.tag.endswith("}Class"):
            continue
        own = next((v for k, v in node.attrib.items() if k.endswith("}ID") or k.endswith("}about")), "").lstrip("#")
        row: dict = {"id": own, "must_contain": [], "required": [], "scope": [], "supported": [], "subclass_of": []}
        for child in node:
            name = child.tag.rpartition("}")[2]
            target = next((v for k, v in child.attrib.items() if k.endswith("}resource")), "").rpartition("#")[2]
            key = {"mustContain": "must_contain", "requiredState": "required", "scope": "scope", "supportedState": "supported", "subClassOf": "subclass_of"}.get(name)
            if key and target:
                row[key].append(target)
        rows.append(row | {"landmark": "landmark" in row["subclass_of"]})
    return rows
