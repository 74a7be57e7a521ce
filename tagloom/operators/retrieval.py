"""Exact cosine top-k of query vectors against a reference library."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.session import materialize

SIMILARITY_DIGITS = 12  # equal vectors tie whatever the order of summation
MAX_CELLS = 4096  # pivots that reach the driver at most
TILE_CELLS = 1_000_000  # similarities held at once by a task
BROADCAST_BYTES = 64 << 20  # of a library that goes to every executor
MATCH_ROWS = 512  # queries whose matches a task holds at once


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _units(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0.0, 1.0, n)


def _best(q: np.ndarray, r: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, library rows, similarities); the library is sorted by id,
    so a stable sort breaks ties on the lower id."""
    k = min(k, len(r))
    tile = max(1, TILE_CELLS // max(1, len(r)))
    for start in range(0, len(q), tile):
        sims = np.round(q[start : start + tile] @ r.T, SIMILARITY_DIGITS)
        limit = np.partition(sims, len(r) - k, axis=1)[:, len(r) - k]
        for i, row in enumerate(sims):
            near = np.flatnonzero(row >= limit[i])
            near = near[np.argsort(-row[near], kind="stable")][:k]
            yield start + i, near, row[near]


def _emit(q_ids, r_ids, q: np.ndarray, r: np.ndarray, k: int) -> pd.DataFrame:
    out_q, out_r, out_s, out_n = [], [], [], []
    if len(q) and len(r):
        for i, near, sims in _best(q, r, k):
            out_q.append(np.repeat(q_ids[i], len(near)))
            out_r.append(r_ids[near])
            out_s.append(sims)
            out_n.append(np.arange(1, len(near) + 1))
    if not out_q:
        return pd.DataFrame({"q": [], "r": [], "similarity": [], "rank": []})
    return pd.DataFrame(
        {"q": np.concatenate(out_q), "r": np.concatenate(out_r), "similarity": np.concatenate(out_s), "rank": np.concatenate(out_n)}
    )


def _sound(vector: str) -> Column:
    """Whether a vector has a direction: finite components, not all zero."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is above infinity
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vector_topk(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    min_similarity: float | None = None,
    query_id: str = "query_id",
    ref_id: str = "row_index",
    vector: str = "embedding",
    broadcast_limit: int = BROADCAST_BYTES,
    block_rows: int = 8192,
) -> DataFrame:
    """The query rows with (row_index, similarity, rank) of their top-k, exact.

    ``query_id`` and ``row_index`` are BIGINT; all other query columns are
    kept. A vector that is NULL, zero, of another size or holds a NULL, NaN or
    infinite component matches nothing, on either side; the library's size is
    its most frequent one (ties: the larger). The similarity minimum applies
    after the top-k.

    A library whose measured size is below ``broadcast_limit`` goes to every
    executor and the match is a column computed next to the query, so only the
    vector travels to Python and matches are never shuffled to be re-scored.
    Queries are spread first: a split of a file holds far too many of them for
    one task. A larger library is split
    into cells around pivots. A query first visits the nearest cells that hold
    k rows; the k-th similarity found there bounds, by the triangle inequality
    on angles, which other cells can still hold a better row, and only those
    are visited. Cells and their visitors are cut into blocks of about
    ``block_rows``, so a hot cell is spread over many tasks and every block
    product fits in memory.
    """
    r = refs.select(F.col(ref_id).cast("bigint").alias("r"), F.col(vector).alias("v"))
    r = r.filter(_sound("v"))
    sizes = r.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    n, d = (most["n"], most["d"]) if most else (0, 0)
    r = r.filter(F.size("v") == d)
    usable = queries.filter((F.size(vector) == d) & _sound(vector))
    if n == 0:
        empty = {ref_id: F.lit(0).cast("bigint"), "similarity": F.lit(0.0), "rank": F.lit(0)}
        return usable.withColumns(empty).limit(0)
    if n * d * 8 <= broadcast_limit:
        found = _spread(usable, query_id).withColumn("_m", _topk_column(r, k)(F.col(vector)))
        pairs = F.arrays_zip(F.col("_m.r").alias("r"), F.col("_m.s").alias("s"))
        rows = found.select(*queries.columns, F.posexplode(pairs).alias("_pos", "_p"))
        out = rows.select(
            *queries.columns, F.col("_p.r").alias(ref_id), F.col("_p.s").alias("similarity"), (F.col("_pos") + 1).alias("rank")
        )
    else:
        # rows with the same id and vector match alike and are searched once
        keyed = usable.withColumn("_q", F.xxhash64(query_id, vector))
        q = keyed.select(F.col("_q").alias("q"), F.col(vector).alias("v")).dropDuplicates(["q"])
        cells = _topk_cells(q, r, k, n, block_rows).select(F.col("q").alias("_q"), F.col("r").alias(ref_id), "similarity", F.col("rank").cast("int").alias("rank"))
        out = keyed.join(cells, "_q").select(*queries.columns, ref_id, "similarity", "rank")
    return out if min_similarity is None else out.filter(F.col("similarity") >= min_similarity)


def _spread(queries: DataFrame, query_id: str) -> DataFrame:
    """Queries dealt out to all tasks; a split of a file may hold far too many
    of them for one."""
    spark = queries.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return queries.repartition(tasks, query_id)


MATCH = "q bigint, r bigint, similarity double, rank bigint"


def _topk_column(r: DataFrame, k: int):
    library = r.orderBy("r").toPandas()  # size checked by the caller
    shared = r.sparkSession.sparkContext.broadcast((library["r"].to_numpy(), _units(_matrix(library["v"]))))

    @F.pandas_udf("r array<bigint>, s array<double>")
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ids, units = shared.value
        for vectors in batches:
            for start in range(0, len(vectors), MATCH_ROWS):
                some = vectors.iloc[start : start + MATCH_ROWS]
                best = list(_best(_units(_matrix(some)), units, k))
                yield pd.DataFrame({"r": [ids[near] for _, near, _ in best], "s": [sims for _, _, sims in best]})

    return match


def _topk_cells(q: DataFrame, r: DataFrame, k: int, n: int, block_rows: int) -> DataFrame:
    spark = q.sparkSession
    m = min(MAX_CELLS, max(8, math.ceil(n / block_rows)))
    # at most MAX_CELLS vectors reach the driver
    seeds = r.orderBy(F.xxhash64("r"), "r").limit(m).collect()
    pivots = spark.sparkContext.broadcast(_units(np.array([s["v"] for s in seeds], dtype=np.float64)))

    def angles(units: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(units @ pivots.value.T, -1.0, 1.0))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                units = _units(_matrix(pdf["v"]))
                a = angles(units)
                cell = a.argmin(axis=1)
                yield pd.DataFrame({"r": pdf["r"], "v": list(units), "cell": cell, "angle": a[np.arange(len(a)), cell]})

    library = materialize(r.mapInPandas(assign, "r bigint, v array<double>, cell int, angle double"), "topk-library")
    stats = library.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()
    counts, radius = np.zeros(len(seeds), dtype=np.int64), np.zeros(len(seeds))
    for s in stats:
        counts[s["cell"]], radius[s["cell"]] = s["n"], s["radius"]

    def first_cells(a: np.ndarray) -> np.ndarray:
        order = np.argsort(a, kind="stable")
        need = int(np.searchsorted(np.cumsum(counts[order]), min(k, counts.sum()))) + 1
        return order[:need]

    def visit_first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                units = _units(_matrix(pdf["v"]))
                cells = [first_cells(a) for a in angles(units)]
                yield pd.DataFrame({"q": pdf["q"], "v": list(units), "cell": cells})

    def visit_rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                units = _units(_matrix(pdf["v"]))
                cells = []
                for a, kth in zip(angles(units), pdf["kth"].to_numpy(dtype=np.float64)):
                    # a row that ties after rounding may be this much less similar
                    bound = math.pi if np.isnan(kth) else math.acos(max(-1.0, min(1.0, kth - 2 * 10.0**-SIMILARITY_DIGITS)))
                    open_cells = np.flatnonzero((counts > 0) & (a - radius <= bound + 1e-7))
                    cells.append(np.setdiff1d(open_cells, first_cells(a)))
                yield pd.DataFrame({"q": pdf["q"], "v": list(units), "cell": cells})

    def scan(visits: DataFrame, name: str) -> DataFrame:
        """Local top-k of every (visiting queries) x (cell block)."""
        rows = materialize(visits.select("q", "v", F.explode("cell").alias("cell")), name)
        load = {x["cell"]: x["count"] for x in rows.groupBy("cell").count().collect()}
        blocks = [(int(c), max(1, math.ceil(int(counts[c]) / block_rows)), max(1, math.ceil(w / block_rows))) for c, w in load.items()]
        if not blocks:
            return spark.createDataFrame([], MATCH)
        plan = F.create_map(*[x for c, p, s in blocks for x in (F.lit(c), F.struct(F.lit(p).alias("p"), F.lit(s).alias("s")))])
        at = plan[F.col("cell")]
        left = rows.withColumn("slice", F.pmod(F.xxhash64("q"), at["s"]).cast("int")).withColumn(
            "part", F.explode(F.sequence(F.lit(0), at["p"] - 1))
        )
        right = (
            library.filter(F.col("cell").isin(*[c for c, _, _ in blocks]))
            .withColumn("part", F.pmod(F.xxhash64("r"), at["p"]).cast("int"))
            .withColumn("slice", F.explode(F.sequence(F.lit(0), at["s"] - 1)))
        )

        def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"q": [], "r": [], "similarity": [], "rank": []})
            b = b.sort_values("r")
            return _emit(a["q"].to_numpy(), b["r"].to_numpy(), _matrix(a["v"]), _matrix(b["v"]), k)

        keys = ("cell", "part", "slice")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block, MATCH)

    def cut(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("similarity"), "r"))
        return rows.withColumn("rank", place.cast("bigint")).filter(F.col("rank") <= k)

    visit = "q bigint, v array<double>, cell array<int>"
    near = materialize(cut(scan(q.mapInPandas(visit_first, visit), "topk-near")), "topk-first")
    kth = near.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("kth"))
    rest = q.join(kth, "q", "left").mapInPandas(visit_rest, visit)
    far = scan(rest.filter(F.size("cell") > 0), "topk-far")
    return cut(near.unionByName(far))


def reference_count(refs: DataFrame) -> DataFrame:
    return refs.groupBy("character_id").agg(F.count(F.lit(1)).alias("reference_count"))

