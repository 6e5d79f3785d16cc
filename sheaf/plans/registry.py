"""Registered queries, their DuckDB counterparts and table access."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheaf.session import ship, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ARROW_BYTES = 2 << 20

_REF = re.compile(r"@([a-z]+)\b")


class Tables:
    """The given tables by name, plus rows derived from them by plain SQL."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = tune(ship(spark))
        # Rows may be whole texts, whose terms a task holds for a batch at a time.
        self.spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def derive(self, sql: str) -> DataFrame:
        """Run SQL in the dialect both engines share; ``@t`` names a table."""
        frames = {name: getattr(self, name) for name in set(_REF.findall(sql))}
        escaped = sql.replace("{", "{{").replace("}", "}}")
        return self.spark.sql(_REF.sub(r"{\1}", escaped), **frames)


def for_duckdb(sql: str) -> str:
    return _REF.sub(r"\1", sql)


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is its DuckDB text (``@t`` names a table)."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = for_duckdb(oracle)
        return fn

    return register
