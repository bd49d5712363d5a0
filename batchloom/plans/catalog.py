"""Registered queries, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from batchloom.functions.timing import moment
from batchloom.plans.views import AS_OF, table, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@dataclass(frozen=True)
class Model:
    """The data model at one scale; every attribute is built when asked for."""

    spark: SparkSession
    sf_dir: str
    chunked: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return view(self.spark, self.sf_dir, f"f_{name}", self.chunked)


def as_of():
    return moment(AS_OF)


def register(name: str, sql: str | None = None):
    """Register ``fn(model)`` under ``name``."""

    def keep(fn: Callable[[Model], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Model(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql.replace("{AS_OF}", f"TIMESTAMP '{AS_OF}'"))
        return fn

    return keep


def r6(column, name: str | None = None):
    """Rounded to six digits: sums of doubles depend on the order of the rows."""
    out = F.round(column.cast("double"), 6)
    return out.alias(name) if name else out
