"""Quality classifier: histogram gradient-boosted trees over document statistics.

A bounded sample of labelled rows fits the trees on the driver; every text is
then scored in one pass from its statistics, with trees laid out as flat arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import id_fold, query, table
from tagloom.llm.features import STATISTICS, statistics
from tagloom.llm.texts import slices

SAMPLE = 20_000  # labelled rows that fit the trees at most
BINS = 64


@dataclass
class Trees:
    """Complete binary trees: node i has the children 2i+1 and 2i+2."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, leaves)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        margin = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while inner and len(x) and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += leaf[node - inner]
        return 1 / (1 + np.exp(-margin))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, smooth: float = 5.0, least: int = 20) -> Trees:
    """Boosting by second-order gain over binned statistics."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]) if len(x) else np.zeros(x.shape, int)
    width = x.shape[1]
    rate_1 = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(rate_1 / (1 - rate_1)))
    margin, inner = np.full(len(x), base), 2**depth - 1
    out_f, out_t, out_l = [], [], []
    cell = binned + np.arange(width) * BINS
    for _ in range(trees if len(x) else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, BINS)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            place = ((node - first)[:, None] * (width * BINS) + cell).ravel()
            size = many * width * BINS
            gs, hs, ns = (np.bincount(place, np.repeat(v, width), size).reshape(many, width, BINS).cumsum(axis=2) for v in (g, h, np.ones(len(x))))
            gt, ht, nt = gs[:, :, -1:], hs[:, :, -1:], ns[:, :, -1:]
            gain = gs**2 / (hs + smooth) + (gt - gs) ** 2 / (ht - hs + smooth) - gt**2 / (ht + smooth)
            gain[(ns < least) | (nt - ns < least)] = -1
            best = gain.reshape(many, -1).argmax(axis=1)
            for i, b in enumerate(best.tolist()):
                j, c = divmod(b, BINS)
                if gain[i, j, c] > 1e-9 and c < len(edges[j]):
                    feature[first + i], threshold[first + i], cut[first + i] = j, edges[j][c], c
            node = 2 * node + 1 + (binned[np.arange(len(x)), feature[node]] > cut[node])
        where = node - inner
        leaf = -rate * np.bincount(where, g, inner + 1) / (np.bincount(where, h, inner + 1) + smooth)
        margin += leaf[where]
        out_f.append(feature), out_t.append(threshold), out_l.append(leaf)
    shape = (len(out_f), inner)
    return Trees(np.array(out_f, np.int64).reshape(shape), np.array(out_t).reshape(shape), np.array(out_l).reshape(-1, inner + 1), base)


def scored(trees: Trees) -> Callable[[Column], Column]:
    """The trees as a column of texts; other columns stay where they are."""

    def score(text: pa.Array) -> pa.Array:
        parts = [trees.score(statistics(x.column(0))) for x in slices([pa.RecordBatch.from_arrays([text], ["text"])], "text")]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return F.arrow_udf(score, T.DoubleType())


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        x = statistics(batch.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), lists], ["doc_id", "label", "stats"])


def learnt(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Trees:
    """Trees from at most ``limit`` labelled rows outside the held-out fold,
    chosen by a hash of the id and so the same at every run."""
    known = labels.filter(F.col("quality").isin(0, 1)).filter(id_fold("doc_id", 3) != 1)
    known = known.select("doc_id", F.col("quality").cast("double").alias("label")).dropDuplicates(["doc_id"])
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # bounded, so it may travel to all tasks
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    found = sorted(rows.mapInArrow(_statistics, "doc_id bigint, label double, stats array<double>").collect())
    x = np.array([r["stats"] for r in found], np.float64).reshape(len(found), len(STATISTICS))
    return fit_trees(x, np.array([r["label"] for r in found], np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Trees learn from at most ``limit`` labelled rows outside the held-out fold
    (crc32 of the id's text mod 3 is 1); without any, every score is 0.5. Null
    and empty texts have statistics of zero and get the score of those.
    Repeated rows score alike; a null doc_id is scored and not held out; other
    columns are ignored. ``labels`` may lack or repeat ids; labels other than
    0 and 1 are passed over.
    """
    score = scored(learnt(docs, labels, limit))(F.col("text").cast("string"))
    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), score.alias("score"))
    held = F.coalesce(id_fold("doc_id", 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the trees do not
    reject. Trees learn as in ``quality_scores``. Null and empty texts are judged
    by their statistics of zero, equal texts alike, whatever their ids; an empty
    table gives no rows."""
    score = scored(learnt(docs, labels, limit))(F.col("text").cast("string"))
    keyed = docs.select(F.struct(*docs.columns).alias("_all"), score.alias("_score"))
    return keyed.filter("_score >= 0.5").select("_all.*")


@query("op4_histogram_boosted_quality")
def op4_histogram_boosted_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))
