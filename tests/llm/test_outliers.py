"""The minimum-covariance-determinant verdict against numpy, for groups of any size."""

import collections
import math
import random

import numpy as np
import pytest

from tagloom.llm import op09_quality_rules as Q

SCHEMA = "doc_id long, text string, lang string, source string"


def quantile_bin(values, share, logarithm=False):
    values = np.asarray(values, float)
    bins = np.sort(np.floor((np.log(values + 1e-9) if logarithm else values) * Q.BINS).astype(int))
    upto = np.searchsorted(bins, bins, side="right")
    return bins[upto >= share * len(bins)].min()


def middle(bin, logarithm=False):
    return math.exp((bin + 0.5) / Q.BINS) if logarithm else (bin + 0.5) / Q.BINS


def solved(x):
    """Mean and Cholesky factor with the floors."""
    n, d = x.shape
    m = x.mean(axis=0)
    cov = (x.T @ x) / n - np.outer(m, m)
    factor = np.zeros((d, d))
    for i in range(d):
        for j in range(i + 1):
            v = max(cov[i, i], 0) + Q.FLOOR[i] ** 2 if i == j else cov[i, j]
            v -= factor[i, :j] @ factor[j, :j]
            factor[i, j] = math.sqrt(max(v, Q.FLOOR[i] ** 2 / 4)) if i == j else v / factor[j, j]
    return m, factor


def distances(x, shape):
    m, factor = shape
    return (np.linalg.solve(factor, (x - m).T) ** 2).sum(axis=0)


def estimate(x):
    quarters = np.array([[middle(quantile_bin(x[:, i], s)) for s in (0.25, 0.5, 0.75)] for i in range(x.shape[1])])
    starts = [(quarters[:, 1], np.diag(np.maximum((quarters[:, 2] - quarters[:, 0]) / 1.349, Q.FLOOR))), solved(x)]
    found = []
    for shape in starts:
        best = None
        for _ in range(Q.STEPS):
            d2 = distances(x, shape)
            bins = np.floor(np.log(d2 + 1e-9) * Q.BINS).astype(int)
            shape = solved(x[bins <= quantile_bin(d2, Q.SHARE, True)])
            det = 2 * np.log(np.diag(shape[1])).sum()
            if best is not None and det >= best[0] - Q.FALL:
                break
            best = (det, shape)
        found.append(best)
    shape = min(found, key=lambda b: b[0])[1]
    q = [middle(quantile_bin(distances(x, shape), s, True), True) for s in (0.25, 0.5, 0.75)]
    scale = max(q[1] / Q.CHI_MEDIAN, 1.0)
    root = [(v / scale) ** (1 / 3) for v in q]
    cut = max((root[1] + Q.NORMAL_FAR * (root[2] - root[0]) / 1.349) ** 3, Q.CHI_FAR)
    return shape, scale, cut


def corpus(sizes, seed):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfghjklmnp" for b in "aeiou" for c in ("", "la", "stre", "nu", "x#", "ly")]
    rows = []
    for (lang, source), n in sizes.items():
        for _ in range(n):
            words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 300))]
            if rng.random() < 0.05:
                words += ["$$$", "###"] * rng.randint(5, 80)
            if rng.random() < 0.1:
                words[20:30] = words[:10]
            rows.append((len(rows), " ".join(words) + "\nhome" * rng.choice([0, 0, 0, 1, 9]), lang, source))
    rows += [(len(rows) + i, t, lang, None) for i, (t, lang) in enumerate([(None, "en"), ("too short", None), ("a " * 80, "de")])]
    return rows


@pytest.mark.parametrize("sizes", [
    {("en", "a"): 140, ("en", "b"): 49, ("en", "c"): 50, ("de", "a"): 10, ("de", None): 1, (None, "a"): 60, ("fr", "a"): 40, ("fr", "b"): 12},
    {("en", "a"): 1}, {("en", "a"): 3, ("de", "b"): 5}, {("en", "a"): 49, ("en", "b"): 49},
])
def test_verdicts_equal_numpy(spark, sizes):
    rows = corpus(sizes, len(sizes))
    docs = spark.createDataFrame(rows, SCHEMA)
    counts = Q.vector(Q.counted(docs.select("doc_id", "text"))).toPandas().set_index("doc_id")
    got = {r.doc_id: r for r in Q.judged(docs.repartition(5)).collect()}
    passed = {i: counts.loc[i, list(Q.VECTOR)].to_numpy(float) for i, r in got.items() if not r.base_failed}
    pair, lang = {r[0]: (r[2], r[3]) for r in rows}, {r[0]: r[2] for r in rows}
    pairs, langs = collections.Counter(pair[i] for i in passed), collections.Counter(lang[i] for i in passed)

    def group(i):
        if pairs[pair[i]] >= Q.LEAST:
            return [j for j in passed if pair[j] == pair[i]]
        return [j for j in passed if lang[j] == lang[i]] if langs[lang[i]] >= Q.LEAST else list(passed)

    known = {}
    for i, x in passed.items():
        members = tuple(group(i))
        if members not in known:
            known[members] = estimate(np.array([passed[j] for j in members]))
        shape, scale, cut = known[members]
        d2 = distances(x[None, :], shape)[0] / scale
        assert abs(got[i].distance - d2) < 1e-6 * max(1, d2) and got[i].kept == (d2 <= cut)
    assert all(not r.kept and r.distance is None for r in got.values() if r.base_failed)
    assert len(got) == len(rows) and passed


def test_distances_do_not_depend_on_the_partitions(spark):
    rows = corpus({("en", "a"): 150, ("de", "b"): 30}, 9)
    docs = spark.createDataFrame(rows, SCHEMA)
    runs = [{r.doc_id: r.distance for r in Q.judged(docs.repartition(n)).collect()} for n in (1, 7)]
    assert all((a is None and runs[1][i] is None) or abs(a - runs[1][i]) < 1e-9 * max(1, a) for i, a in runs[0].items())
