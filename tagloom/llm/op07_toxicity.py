"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words is trained from confirmed toxic texts and
unlabelled ones. With class prior p, the risk is p * E_P[l(f)] plus the risk
of the negatives, E_U[l(-f)] - p * E_P[l(-f)], which is kept from going below
zero: where it does, the step goes the other way.

E_U is over all unlabelled texts. Each round begins with its value and gradient
at the present weights, summed over the whole table; the steps of the round
move from there by the difference that a sample of the texts shows between the
weights then and now. A bounded sample thus steers the steps, and the whole
table sets the risk.

Only telling buckets take part: those that the toxic texts hold clearly more or
less often than all texts do, by counts over the whole table. Most words are
rare, and with few toxic texts the sum of their chance weights would drown the
words that matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.llm.common import id_fold, query, table
from tagloom.llm.features import hashed_words
from tagloom.llm.texts import slices
from tagloom.session import materialize

BITS = 18
POSITIVES, UNLABELLED = 4_000, 4_000  # texts that come to the driver at most
HELD_BYTES = 48 << 20  # of their bucket lists at most
ROUNDS, STEPS = 20, 15  # sums over all unlabelled texts, and steps from each
SLICE = 4096  # weights of a slice of the gradient
TELLING = 3.0  # standard deviations between a bucket's count in toxic texts and the expected one
SKIP = 0xFFFF  # in a coded list: no bucket, only a step of as many


def weight(sizes: np.ndarray) -> np.ndarray:
    return np.maximum(1, sizes) ** -0.25


class SparseRows:
    """Rows of bucket lists, each divided by the fourth root of its length,
    laid out by row and by bucket."""

    def __init__(self, lists: list[np.ndarray]) -> None:
        self.n = len(lists)
        sizes = np.array([len(x) for x in lists], np.int64)
        self.bucket = np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, np.int32)
        row = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        self.full = np.flatnonzero(sizes)
        self.start = (np.cumsum(sizes) - sizes)[self.full]
        self.scale = weight(sizes)
        order = np.argsort(self.bucket, kind="stable")
        self.row = row[order]
        self.seen, self.first = np.unique(self.bucket[order], return_index=True)

    def only(self, keep: np.ndarray) -> SparseRows:
        """The same rows without the buckets that are not to be kept."""
        cut = np.append(self.start, len(self.bucket))
        lists = [np.zeros(0, np.int32)] * self.n
        for i, a, b in zip(self.full.tolist(), cut[:-1].tolist(), cut[1:].tolist()):
            lists[i] = self.bucket[a:b][keep[self.bucket[a:b]]]
        return SparseRows(lists)

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.full):
            out[self.full] = np.add.reduceat(w.astype(np.float32)[self.bucket], self.start)
        return out * self.scale

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        if len(self.seen):
            out[self.seen] = np.add.reduceat((r * self.scale).astype(np.float32)[self.row], self.first)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


Whole = Callable[[np.ndarray], tuple[float, np.ndarray]]


def _unlabelled_risk(rows: SparseRows, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean of l(-f) over rows, its gradient's part by bucket, and by margin."""
    z = rows.dot(w[:-1]) + w[-1]
    r = sigmoid(z) / max(1, rows.n)
    return float(np.logaddexp(0, z).mean()) if rows.n else 0.0, np.append(rows.back(r, len(w) - 1), r.sum()), z


def fit_nnpu(pos: SparseRows, unl: SparseRows, prior: float, whole: Whole | None = None, rounds: int = ROUNDS, steps: int = STEPS, rate: float = 0.1, decay: float = 1e-4, size: int = 1 << BITS) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the corrected logistic risk.

    ``whole(weights)`` gives the mean of l(-f) over all unlabelled texts and its
    gradient; without it the sample ``unl`` is all of them.
    """
    w = np.zeros(size + 1)
    if not pos.n or not unl.n:
        return w[:-1], -40.0 if not pos.n else 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))
    total = rounds * steps
    for t in range(1, total + 1):
        if whole is not None and (t - 1) % steps == 0:
            risk, gradient = whole(w)
            then_risk, then_gradient, _ = _unlabelled_risk(unl, w)
            risk, gradient = risk - then_risk, gradient - then_gradient  # what the sample leaves out
        zp = pos.dot(w[:-1]) + w[-1]
        risk_u, gradient_u, _ = _unlabelled_risk(unl, w)
        if whole is not None:
            risk_u, gradient_u = risk_u + risk, gradient_u + gradient
        negative = risk_u - prior * np.logaddexp(0, zp).mean()
        # gradients of the losses l(f) = log(1 + e^-f) and l(-f) by the margin
        up, down = -sigmoid(-zp) / pos.n, sigmoid(zp) / pos.n
        rp, sign = (prior * up - prior * down, 1.0) if negative >= 0 else (prior * down, -1.0)
        g = np.append(pos.back(rp, size), rp.sum()) + sign * gradient_u + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (0.1 + 0.9 * (1 - t / total))
    return w[:-1], float(w[-1])


def coded(row: np.ndarray, bucket: np.ndarray, rows: int) -> list[bytes]:
    """The ascending buckets of each row as steps of two bytes."""
    step = np.diff(bucket, prepend=0)
    new = np.diff(row, prepend=-1) != 0
    step[new] = bucket[new]
    skips = step // SKIP
    out = np.full(len(step) + int(skips.sum()), SKIP, np.uint16)
    at = np.arange(len(step)) + np.cumsum(skips)
    out[at] = step - skips * SKIP
    ends = np.searchsorted(row, np.arange(rows + 1))
    cut = np.concatenate([[0], at + 1])[ends].tolist()
    return [out[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]


def decoded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of coded lists."""
    flat = lists.cast(pa.large_binary())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] // 2
    data = flat.buffers()[2]
    step = (np.frombuffer(data, np.uint16) if data is not None else np.zeros(0, np.uint16))[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    total = np.concatenate([[0], np.cumsum(step, dtype=np.int64)])
    row = np.repeat(np.arange(len(flat)), np.diff(offsets))
    real = step != SKIP
    return row[real], (total[1:] - total[offsets[:-1]][row])[real]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        row, bucket = hashed_words(batch.column("text"), BITS)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(coded(row, bucket, batch.num_rows), pa.binary())], ["doc_id", "buckets"])


def _margins(batch: pa.RecordBatch, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    row, bucket = decoded(batch.column("buckets"))
    scale = weight(np.bincount(row, minlength=batch.num_rows))
    return np.bincount(row, w[bucket], batch.num_rows) * scale + w[-1], row, bucket, scale


def _kept(keep):
    """The lists without the buckets that do not tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, bucket = decoded(batch.column("buckets"))
            some = keep.value[bucket]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(coded(row[some], bucket[some], batch.num_rows), pa.binary())], ["doc_id", "buckets"])

    return run


def _score(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin, *_ = _margins(batch, weights.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigmoid(margin))], ["doc_id", "score"])

    return run


PARTS = "slice int, n bigint, risk double, part binary"


def _sliced(total: np.ndarray, n: int, risk: float) -> pa.RecordBatch:
    """A task's sums, in slices."""
    cuts = [total[at : at + SLICE].astype(np.float32).tobytes() for at in range(0, len(total), SLICE)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([n] * len(cuts), pa.int64()), pa.array([risk] * len(cuts)), pa.array(cuts, pa.binary())], ["slice", "n", "risk", "part"])


def _risk_parts(weights):
    """A task's rows, risk and gradient."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        gradient, n, risk = np.zeros(len(w)), 0, 0.0
        for batch in batches:
            z, row, bucket, scale = _margins(batch, w)
            r = sigmoid(z)
            gradient[:-1] += np.bincount(bucket, (r * scale)[row], len(w) - 1)
            gradient[-1] += r.sum()
            n, risk = n + batch.num_rows, risk + float(np.logaddexp(0, z).sum())
        yield _sliced(gradient, n, risk)

    return run


def _count_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows, and how many of them hold each bucket."""
    held, n = np.zeros(1 << BITS), 0
    for batch in batches:
        held += np.bincount(decoded(batch.column("buckets"))[1], minlength=1 << BITS)
        n += batch.num_rows
    yield _sliced(held, n, 0.0)


def _summed(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(x, np.float32) for x in parts["part"]], axis=0, dtype=np.float64)
    return pd.DataFrame({"slice": [key[0]], "n": [parts["n"].sum()], "risk": [parts["risk"].sum()], "part": [total.astype(np.float32).tobytes()]})


def _sums(features: DataFrame, run, size: int) -> tuple[int, float, np.ndarray]:
    """(rows, risk, sums) over all rows of ``features(buckets)``. A task sums its
    rows; the sums of the tasks, as many as the session has places for a few
    times over, meet by slices."""
    context = features.sparkSession.sparkContext
    tasks = 4 * max(context.defaultParallelism, int(features.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = features.select("buckets").coalesce(tasks).mapInArrow(run, PARTS)
    found = sorted(parts.groupBy("slice").applyInPandas(_summed, PARTS).collect())
    if not found:
        return 0, 0.0, np.zeros(size)
    return found[0]["n"], found[0]["risk"], np.concatenate([np.frombuffer(r["part"], np.float32) for r in found]).astype(np.float64)


def whole_risk(features: DataFrame) -> Whole:
    """The mean of l(-f) over all rows of ``features(buckets)`` and its gradient,
    as a function of the weights."""
    context = features.sparkSession.sparkContext

    def whole(w: np.ndarray) -> tuple[float, np.ndarray]:
        weights = context.broadcast(w)
        n, risk, gradient = _sums(features, _risk_parts(weights), len(w))
        weights.unpersist()
        return risk / max(1, n), gradient / max(1, n)

    return whole


def telling(pos: SparseRows, features: DataFrame) -> np.ndarray:
    """Whether a bucket's count in the toxic texts departs from the one that its
    share of all rows of ``features`` lets expect; with few toxic texts, less is
    asked for."""
    n, _, held = _sums(features, _count_parts, 1 << BITS)
    expected = held * (pos.n / max(1, n))
    seen = np.bincount(pos.bucket, minlength=1 << BITS)
    return np.abs(seen - expected) >= min(TELLING, pos.n**0.5 / 2) * np.sqrt(expected + 1)


def _sample(features: DataFrame, ids: DataFrame, rows: int) -> SparseRows:
    """The lists of ``ids`` (at most ``rows``), in a fixed order, as many as HELD_BYTES allow."""
    chosen = features.join(F.broadcast(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"])  # bounded by the limit of ids
    sized = chosen.withColumns({"o": F.xxhash64("doc_id"), "b": F.octet_length("buckets")})
    upto = F.sum("b").over(W.orderBy("o", "doc_id"))
    some = sized.withColumn("upto", upto).filter((F.col("upto") <= HELD_BYTES) | (F.col("upto") == F.col("b")))
    lists = some.orderBy("o", "doc_id").select("buckets").limit(rows).toArrow()["buckets"].combine_chunks()
    row, bucket = decoded(lists if isinstance(lists, pa.Array) else lists.chunk(0)) if len(lists) else (np.zeros(0, np.int64),) * 2
    cut = np.searchsorted(row, np.arange(len(lists) + 1)).tolist()
    return SparseRows([bucket[a:b] for a, b in zip(cut[:-1], cut[1:])])


def learnt(features: DataFrame, labels: DataFrame, positives: int, unlabelled: int, prior: float | None) -> tuple[np.ndarray, float, DataFrame]:
    """The model of (doc_id, buckets), from the rows that may be learnt from, and
    the table with its telling buckets alone, to which the model belongs.

    Labels of 0 serve only for the prior (the share of toxic among labelled
    rows), where none is given; every other text is unlabelled, whatever its
    label. Positives and the sample of the unlabelled are bounded in rows and
    bytes; the sums over the unlabelled are not.
    """
    learn = id_fold("doc_id", 4) != 2
    known = labels.filter(F.col("toxic").isin(0, 1)).filter(learn).select("doc_id", "toxic").dropDuplicates(["doc_id"])
    if prior is None:
        count = known.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("p")).first()
        prior = ((count["p"] or 0) + 1) / ((count["n"] or 0) + 10)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.filter("toxic = 1").select("doc_id").orderBy(*order).limit(positives)
    pos = _sample(features.filter(learn), chosen, positives)
    keep = telling(pos, features.filter(learn))
    mask = features.sparkSession.sparkContext.broadcast(keep)
    features = materialize(features.mapInArrow(_kept(mask), "doc_id bigint, buckets binary"), "toxicity-telling")
    texts = features.filter(learn)
    unl = texts.select("doc_id").distinct().orderBy(*order).limit(unlabelled)
    w, bias = fit_nnpu(pos.only(keep), _sample(texts, unl, unlabelled), prior, whole_risk(texts))
    return w, bias, features


def toxicity_scores(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    The model learns from at most ``positives`` toxic texts and from all others
    outside the held-out fold (crc32 of the id's text mod 4 is 2); at most
    ``unlabelled`` of these steer its steps. Without a toxic text all scores are
    near 0. Null, empty and wordless texts, and those without a telling word, get
    the score of the bias alone.
    Repeated rows score alike; a null doc_id is scored, not learnt from and not
    held out; ids that are no whole numbers are an error; other columns are
    ignored; an empty table gives no rows.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = materialize(slim.mapInArrow(_buckets, "doc_id bigint, buckets binary"), "toxicity-words")
    w, bias, features = learnt(features, labels, positives, unlabelled, prior)
    weights = docs.sparkSession.sparkContext.broadcast(np.append(w, bias))
    out = features.mapInArrow(_score(weights), "doc_id bigint, score double")
    held = F.coalesce(id_fold("doc_id", 4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op7_positive_unlabelled_toxicity")
def op7_positive_unlabelled_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))
