"""Sharding by histogram sort.

Rows are ordered by (hash of the text, doc_id), so equal texts stand together.
Splitters of that order are found by counting: each round, every task counts
exact bytes and rows below a set of candidate keys, the sums narrow each
splitter's bracket, and new candidates are laid into the brackets that are not
yet within tolerance. Then the rows move once.

Shard splitters divide the bytes; further splitters divide the rows into blocks
that tasks number on their own, so that no task holds a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.llm.common import NO_ID, parts, query, table
from tagloom.session import materialize

EXACT = 0.001  # of a shard's bytes: how far a splitter may be off
WHOLE = 0.02  # the same where this keeps equal texts together
PROBES = 8  # candidates laid into one bracket
SHIFT = 1 << 63


def sortable(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """(hash, id) as 16 bytes that compare like the pair of signed numbers."""
    pair = np.empty((len(h), 2), ">u8")
    pair[:, 0], pair[:, 1] = (np.ascontiguousarray(x).view(np.uint64) ^ np.uint64(SHIFT) for x in (h, ids))
    return pair.view("S16").reshape(-1)


def as_bytes(keys: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(k.to_bytes(16, "big") for k in keys), "S16")


def _count(probes: list[int]):
    """Rows and bytes between neighbouring probes, per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = as_bytes(probes)
        rows, size = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            h, ids, sizes = (batch.column(c).to_numpy() for c in ("h", "id", "size"))
            at = np.searchsorted(cuts, sortable(h, ids), side="right")
            rows += np.bincount(at, minlength=len(rows))
            np.add.at(size, at, sizes)
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(rows[full]), pa.array(size[full])], ["bucket", "rows", "bytes"])

    return run


def splitters(keys: DataFrame, targets: list[tuple[str, float, float, float]], low: int, high: int) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """For each target (measure, value, tolerance, tolerance at borders between
    hashes) the key that divides the rows there, and the exact (rows, bytes)
    below each key tried. ``low`` and ``high`` bound the ids."""
    which = {"rows": 0, "bytes": 1}
    known = {0: (0, 0)}
    probes = [i * (1 << 128) // max(64, 4 * len(targets)) for i in range(1, max(64, 4 * len(targets)))]
    top = 1 << 128
    while True:
        found = {r["bucket"]: (r["rows"], r["bytes"]) for r in keys.mapInArrow(_count(probes), "bucket int, rows bigint, bytes bigint").groupBy("bucket").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).collect()}
        below = np.cumsum([found.get(i, (0, 0)) for i in range(len(probes) + 1)], axis=0).tolist()
        known |= {k: tuple(c) for k, c in zip(probes, below)} | {top: tuple(below[-1])}
        order = sorted(known)
        chosen, probes = [], set()
        for measure, value, exact, whole in targets:
            m = which[measure]
            values = np.array([known[k][m] for k in order])
            at = int(np.searchsorted(values, value, side="left"))
            at = min(max(at, 1), len(order) - 1)
            lo, hi = order[at - 1], order[at]
            near = min((k for k in (lo, hi)), key=lambda k: abs(known[k][m] - value))
            miss = abs(known[near][m] - value)
            step = 1 << 64
            border = near % step == 0
            if miss <= (whole if border else exact):
                chosen.append(near)
                continue
            a, b = -(-(lo + 1) // step), (hi - 1) // step  # borders strictly between
            if b >= a:
                wanted = {a + i * (b - a) // (PROBES - 1) for i in range(PROBES)} if b > a else {a}
                new = {x * step for x in wanted}
            else:
                base = lo // step * step
                a, b = max(lo + 1, base + low), min(hi - 1, base + high + 1)
                new = {a + i * (b - a) // (PROBES - 1) for i in range(PROBES)} if b >= a else set()
            new -= known.keys()
            chosen.append(near)
            probes |= new
        if not probes:
            return chosen, known
        probes = sorted(probes)


def _block(cuts: list[int]):
    def block(h: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(as_bytes(cuts), sortable(h.to_numpy(np.int64), ids.to_numpy(np.int64)), side="right"), dtype="int32")

    return F.pandas_udf(block, "int")


def shards(docs: DataFrame, n: int = 24) -> DataFrame:
    """Every row of ``docs`` with its columns as ``row``, its size (bytes of the
    text plus 8), shard (0 to n - 1) and slot (0, 1, ... in each shard).

    Shards hold nearly the same bytes. Equal texts stay together unless that
    would put a border more than WHOLE of a shard off; a row of more bytes than
    a shard leaves shards empty. Null texts have no bytes; rows with the same
    id and text are ordered by nothing further; a null id comes first; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    keyed = docs.select(
        F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("h"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 8).alias("size"))
    keys = materialize(keyed.select("h", "id", "size"), "shard-keys")
    total = keys.agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    rows, size = total["rows"], total["bytes"] or 0
    per, blocks = size / n, max(1, min(4 * parts(spark), rows))
    targets = [("bytes", per * i, per * EXACT, per * WHOLE) for i in range(1, n)]
    targets += [("rows", rows * i / blocks, rows / blocks / 2, rows / blocks / 2) for i in range(1, blocks)]
    chosen, known = splitters(keys, targets, (total["low"] or 0) + SHIFT, (total["high"] or 0) + SHIFT) if rows else ([0] * len(targets), {0: (0, 0)})
    borders = sorted(chosen[: n - 1])
    cuts = sorted(set(chosen))
    table_rows = []
    for block, low in enumerate([0, *cuts]):
        shard = sum(b <= low for b in borders) if low else sum(b == 0 for b in borders)
        start = borders[shard - 1] if shard else 0
        table_rows.append((block, shard, known[low][0] - known[start][0]))
    places = spark.createDataFrame(pd.DataFrame(table_rows, columns=["block", "shard", "before"]), "block int, shard int, before bigint")
    local = F.row_number().over(W.partitionBy("block").orderBy("h", "id"))
    placed = keyed.withColumn("block", _block(cuts)("h", "id")).withColumn("local", local)
    return placed.join(F.broadcast(places), "block", "left").select("row", "size", "shard", (F.col("before") + F.col("local") - 1).alias("slot"))


@query("op1_histogram_sort_shards")
def op1_histogram_sort_shards(spark: SparkSession, folder: str) -> DataFrame:
    out = shards(table(spark, folder, "documents").select("doc_id", "text"), n=24)
    crc = F.crc32(F.coalesce("row.text", F.lit("")).cast("binary"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
