"""All registered queries of the library proper, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import evaluate, govern, match, relate, report, retrieve, texts, validate

FAMILIES = (match, retrieve, texts, evaluate, govern, relate, report, validate)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for family in FAMILIES for k, f in family.QUERIES.items()}
ORACLES: dict[str, str] = {k: q for family in FAMILIES for k, q in family.ORACLES.items()}
