"""Registered queries: a function over ``Views`` and the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalspark.plans.views import VIEWS, Views, ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query. Derived views that ``sql`` reads are put in front of it."""

    def add(f: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Views(spark, sf_dir))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            used = [v for v in VIEWS if re.search(rf"\b(FROM|JOIN|,)\s+{v}\b", sql)]
            head = ctes(*used)
            text = sql.strip()
            if head:
                text = f"WITH RECURSIVE {head}, {text[5:].removeprefix('RECURSIVE ')}" if text.startswith("WITH ") else f"WITH RECURSIVE {head} {text}"
            ORACLES[name] = text
        return f

    return add


def load() -> None:
    """Imports every module that registers queries."""
    from evalspark.plans import answers, coverage, evolution, novelty, pool, questions, selection, skills, sources, text, vectors  # noqa: F401
