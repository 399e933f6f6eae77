"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

from . import avi, chat, decontamination, langid, lines, mixing, secrets, sharding, simhash, substrings
from .common import table


def _over_documents(op):
    return lambda spark, sf_dir: op(table(spark, sf_dir, "documents"))


def _pipeline(spark, sf_dir):
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)  # it stands at the repository's top and imports this package


QUERIES = {
    "pipeline": _pipeline,
    "op1_chat_format": lambda spark, sf_dir: chat.op1(table(spark, sf_dir, "conversations")),
    "op2_sharding": _over_documents(sharding.op2),
    "op3_secret_scan": _over_documents(secrets.op3),
    "op4_substring_dedup": _over_documents(substrings.op4),
    "op5_decontamination": lambda spark, sf_dir: decontamination.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op5_proximity": lambda spark, sf_dir: decontamination.op5_proximity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op6_avi_media": _over_documents(avi.op6),
    "op7_line_dedup": _over_documents(lines.op7),
    "op7_every_line": _over_documents(lines.op7_every_line),
    "op8_simhash": _over_documents(simhash.op8),
    "op9_language_id": _over_documents(langid.op9),
    "op10_mixing": _over_documents(mixing.op10),
}
ORACLES: dict[str, str] = {"op1_chat_format": chat.ORACLE, "op4_substring_dedup": substrings.ORACLE, "op5_decontamination": decontamination.ORACLE, "op7_line_dedup": lines.ORACLE, "op7_every_line": lines.ORACLE_EVERY_LINE}
