"""Registry of queries: a Spark callable and, where SQL can say it, the equivalent SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelab.plans.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
GROUPS = ["runs", "stats", "splits", "shapes", "decisions", "routers", "tradeoffs", "training", "scalars",
          "scoring"]


def query(name: str, views: str = "", sql: str | None = None, recursive: bool = False):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
            if recursive:
                ORACLES[name] = ORACLES[name].replace("WITH ", "WITH RECURSIVE ", 1)
        return fn
    return register


def load() -> None:
    for g in GROUPS:
        importlib.import_module(f"routelab.plans.queries_{g}")


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round double columns so that results do not hang on the last bits of a float."""
    return df.select(*[F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`")
                       for n, t in df.dtypes])
