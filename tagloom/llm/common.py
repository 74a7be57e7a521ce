"""Helpers shared by the operators: registration, tables, labels, components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NO_ID = -(1 << 63)  # stands for a null id inside an operator


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Texts travel to Python in batches of about 4 MB instead of 64: with both
    sides' copies, a large batch in each running task is much of an executor's
    memory. A session that set a value of its own keeps it."""
    if spark.conf.get(BATCH) == "67108864b":
        spark.conf.set(BATCH, str(BATCH_BYTES))


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            bounded_batches(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_fold(doc_id: str, folds: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


CRC_SQL = """crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda a, _: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crcs
)"""


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of a text of Latin-1 letters (in UTF-8), as SQL over a
    row of ``CRC_SQL``."""
    codes = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN c = '' THEN [] WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195, ord(c)::BIGINT - 64] END))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1])), 4294967295)"


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable by the edges, for every node
    that has one.

    Rounds of minima over neighbours, combined map-side, each followed by a
    jump to the label's own label; a written table ends each round.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = materialize(both.unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges")
    label = both.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("low"))
    label = materialize(label.select("node", F.least("node", "low").alias("root")), "labels-0")
    step = 0
    while True:
        step += 1
        near = both.join(label.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.min("root").alias("low"))
        moved = label.join(near, "node").select("node", F.least("root", "low").alias("root"), F.col("root").alias("was"))
        far = moved.select(F.col("node").alias("root"), F.col("root").alias("far"))
        jumped = moved.join(far, "root").select("node", F.least("root", "far").alias("root"), "was")
        jumped = materialize(jumped, f"labels-{step}")
        label = jumped.select("node", "root")
        if jumped.filter(F.col("root") != F.col("was")).isEmpty():
            return label
