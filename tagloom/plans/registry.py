"""Registry of runnable queries and of the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Data:
    """The tables of one data folder, read with column pruning and pushdown."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Run SQL text whose tables are written ``@name``."""
        names = sorted(set(re.findall(r"@(\w+)", text)))
        body = re.sub(r"@(\w+)", r"{\1}", text.replace("{", "{{").replace("}", "}}"))
        return self.spark.sql(body, **{n: getattr(self, n) for n in names})


def duck(text: str) -> str:
    """The same text for an engine where the tables are plain views."""
    return re.sub(r"@(\w+)", r"\1", text)


def query(name: str, oracle: str | None = None):
    """Register ``fn(data) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: fn(Data(spark, folder))
        if oracle is not None:
            ORACLES[name] = duck(oracle)
        return fn

    return wrap


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(columns: str, rows: list[tuple]) -> str:
    """A VALUES table as SQL text; its size is known to the optimiser, so
    Spark broadcasts it by its own size check."""
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"
