"""All registered queries with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import code, facts, git, graphs, packages, places, texts, trees
from .plans.base import Query

_REGISTRIES = (texts.R, facts.R, graphs.R, code.R, places.R, packages.R, trees.R, git.R)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.q14_hot_list(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: f for r in _REGISTRIES for name, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for r in _REGISTRIES for name, sql in r.sql.items()}
