"""All storage-analytics queries by name, and the same queries as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.lake import Lake, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The folder that holds the package: Python workers on this machine import it from there.
HOME = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Let Python workers find the package where it is not installed."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if HOME not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([HOME, *filter(None, paths)])


def query(name: str, sql: str | None = None):
    """Register a function of a Lake under a name; sql is the DuckDB statement for the same rows."""

    def add(make: Callable[[Lake], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return make(Lake(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_clause(sql)
        return make

    return add


for _module in ("scans", "codecs", "rules", "joins", "audits", "accounts", "layouts", "changes", "policies", "streams"):
    import_module(f"tidemark.plans.{_module}")
