"""All registered queries of the panel library and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import panels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PARTS = {"bars": panels.BARS, "ebars": panels.EVENTS_BARS, "fin": panels.FINANCIALS, "dim": panels.DIMENSION, "fills": panels.FILLS}


def rounded(df: DataFrame, out: str) -> DataFrame:
    """Columns by name; ``name:n`` rounds to n places (and turns a negative zero into zero), ``name:d`` writes a date as text."""

    def one(name: str, kind: str):
        c = F.col(name)
        return c if not kind else (c.cast("date").cast("string") if kind == "d" else F.round(c, int(kind)) + F.lit(0.0)).alias(name)

    return df.select(*[one(*x.partition(":")[::2]) for x in out.split()])


def query(name: str, out: str, needs: str = "", ctes: str = "", sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under a name, with its output columns and the SQL that gives the
    same rows: ``needs`` names shared parts, ``ctes`` are further ones and ``sql`` the last select."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), out)
        if sql is not None:
            with_ = ",\n".join(x for x in [*(PARTS[n] for n in needs.split()), ctes.strip().rstrip(",")] if x)
            cols = ", ".join(f'"{c}"' if not n else f"cast(cast({c} as date) as varchar) as {c}" if n == "d" else f"round({c}, {n}) + 0.0e0 as {c}" for c, _, n in (x.partition(":") for x in out.split()))
            SQL[name] = (f"with {with_}\n" if with_ else "") + f"select {cols} from (\n{sql.strip()}\n)"
        return fn

    return add


for _name in ("windows", "evaluation", "relational", "portfolio", "statistics", "quality", "streams", "research", "archive"):
    importlib.import_module(f"tessera.plans.{_name}")
