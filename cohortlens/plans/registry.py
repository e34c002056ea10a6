"""Registry of named queries: a Spark builder plus (optionally) its SQL oracle.

A query is ``build(spark, sf_dir) -> DataFrame``.  Its oracle is DuckDB SQL
over the same test views; ``oracle`` is the final SELECT (may use the shared
CTEs of ``oracle_base`` and extra CTEs given in ``ctes``).  Both sides round
double columns to 6 places so summation order cannot change the value hash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.plans.oracle_base import BASE_CTES

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    build: Builder
    oracle: str | None = None
    ctes: str = ""
    doubles: list[str] = field(default_factory=list)
    survey_ids: str = ""

    def oracle_sql(self) -> str | None:
        if self.oracle is None:
            return None
        parts = [BASE_CTES.strip()]
        if self.ctes.strip():
            parts.append(self.ctes.strip().lstrip(","))
        parts.append(f"_result AS (\n{self.oracle.strip()}\n)")
        if self.doubles:
            replace = ", ".join(f"round({c}, 6) AS {c}" for c in self.doubles)
            final = f"SELECT * REPLACE ({replace}) FROM _result"
        else:
            final = "SELECT * FROM _result"
        return "WITH " + ",\n".join(parts) + "\n" + final


REGISTRY: dict[str, Query] = {}


def present(df: DataFrame) -> DataFrame:
    """Round top-level double columns to 6 places (presentation step)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`"), 6).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def register(
    name: str,
    oracle: str | None = None,
    ctes: str = "",
    doubles: list[str] | None = None,
    survey_ids: str = "",
):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn: Builder) -> Builder:
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(spark, sf_dir))

        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, build, oracle, ctes, list(doubles or []), survey_ids)
        return fn

    return deco
