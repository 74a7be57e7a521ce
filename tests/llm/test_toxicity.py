"""The positive-unlabelled risk, its gradient and its sums over the whole table."""

import numpy as np
import pyarrow as pa

from tagloom.llm import op07_toxicity as T


def sparse(rng, n, size):
    return [np.unique(rng.integers(0, size, rng.integers(0, 12))) for _ in range(n)]


def risk(w, pos, unl, prior):
    """By its definition, text by text."""
    def margin(x):
        return sum(w[i] for i in x) * max(1, len(x)) ** -0.25 + w[-1]

    def loss(z):
        return np.log1p(np.exp(-z))

    p = np.mean([loss(margin(x)) for x in pos])
    n = np.mean([loss(-margin(x)) for x in unl]) - prior * np.mean([loss(-margin(x)) for x in pos])
    return prior * p, n, np.mean([loss(-margin(x)) for x in unl])


def test_gradient_of_the_unlabelled_risk_by_differences():
    rng = np.random.default_rng(1)
    rows = sparse(rng, 40, 30)
    w = rng.normal(size=31)
    value, gradient, _ = T._unlabelled_risk(T.SparseRows(rows), w)
    assert abs(value - risk(w, rows, rows, 0.1)[2]) < 1e-6
    for i in range(31):
        e = np.eye(31)[i] * 1e-4
        slope = (risk(w + e, rows, rows, 0.1)[2] - risk(w - e, rows, rows, 0.1)[2]) / 2e-4
        assert abs(slope - gradient[i]) < 1e-5


def test_fit_lowers_the_corrected_risk():
    rng = np.random.default_rng(2)
    size = 60
    pos = [np.unique(np.append(rng.integers(0, 20, 3), rng.integers(20, size, 4))) for _ in range(60)]
    neg = [np.unique(rng.integers(20, size, 6)) for _ in range(300)]
    unl = neg + pos[:30]
    w, b = T.fit_nnpu(T.SparseRows(pos), T.SparseRows(unl), 0.1, size=size)
    full = np.append(w, b)
    start = np.append(np.zeros(size), np.log(0.1 / 0.9))
    total = lambda v: risk(v, pos, unl, 0.1)[0] + max(0.0, risk(v, pos, unl, 0.1)[1])
    assert total(full) < 0.3 * total(start)
    margin = lambda x: w[x].sum() * max(1, len(x)) ** -0.25 + b
    assert np.mean([margin(x) > 0 for x in pos]) > 0.95 and np.mean([margin(x) > 0 for x in neg]) < 0.05


def test_coded_lists_round_trip():
    rng = np.random.default_rng(3)
    lists = [np.unique(rng.integers(0, 1 << 18, rng.choice([0, 1, 3, 500]))) for _ in range(50)] + [np.array([0]), np.array([65535]), np.array([65534, 131069, 262143]), np.zeros(0, int)]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    data = pa.array(T.coded(row, np.concatenate(lists).astype(np.int64), len(lists)), pa.binary())
    for part, some in ((data, lists), (data.slice(7, 20), lists[7:27])):
        r, b = T.decoded(part)
        assert [b[r == i].tolist() for i in range(len(some))] == [x.tolist() for x in some]


def test_sums_over_the_whole_table(spark):
    rng = np.random.default_rng(4)
    lists = [np.unique(rng.integers(0, 1 << T.BITS, 9)) for _ in range(200)]
    row = np.repeat(np.arange(200), [len(x) for x in lists])
    coded = T.coded(row, np.concatenate(lists), 200)
    features = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(coded)], "doc_id bigint, buckets binary").repartition(7)
    w = rng.normal(size=(1 << T.BITS) + 1)
    value, gradient = T.whole_risk(features)(w)
    want, slope, _ = T._unlabelled_risk(T.SparseRows(lists), w)
    assert abs(value - want) < 1e-6 and np.abs(gradient - slope).max() < 1e-6
    assert T.whole_risk(features.limit(0))(w)[0] == 0.0


def test_what_a_small_sample_misses_still_counts():
    """Clean texts of a kind that the sample does not hold share a word with
    toxic ones; the sums over all texts keep them clean."""
    rng = np.random.default_rng(6)
    size = 80
    toxic = lambda: np.unique(np.concatenate([rng.integers(0, 10, 2), [20], rng.integers(30, size, 5)]))
    rare = [np.unique(np.concatenate([[20], rng.integers(10, 20, 2), rng.integers(30, size, 5)])) for _ in range(200)]
    plain = [np.unique(rng.integers(30, size, 8)) for _ in range(1000)]
    pos, unl = [toxic() for _ in range(100)], plain + rare + [toxic() for _ in range(80)]
    everything, sample = T.SparseRows(unl), T.SparseRows(plain[:60])
    flagged = {}
    for name, whole in (("sample", None), ("whole", lambda w: T._unlabelled_risk(everything, w)[:2])):
        w, b = T.fit_nnpu(T.SparseRows(pos), sample, 0.06, whole, size=size)
        flagged[name] = [np.mean([w[x].sum() * len(x) ** -0.25 + b > 0 for x in part]) for part in (pos, rare, plain)]
    assert flagged["whole"][0] > 0.95 and flagged["whole"][1] < 0.05 and flagged["whole"][2] < 0.05
    assert flagged["sample"][1] > 0.5


def test_few_toxic_texts_among_many_rare_words(spark):
    """Thirty toxic texts hold one of five words; every text has many rare ones."""
    rng = np.random.default_rng(7)
    marked = rng.random(2400) < 0.1
    rare = lambda: ["w%x" % x for x in rng.integers(0, 60_000, 150)]
    texts = [" ".join(rare() + [f"slur{rng.integers(0, 5)}"] * int(m)) for m in marked]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id bigint, text string")
    labelled = [*np.flatnonzero(marked)[:40], *np.flatnonzero(~marked)[:360]]
    labels = spark.createDataFrame([(int(i), int(marked[i])) for i in labelled], "doc_id bigint, toxic int")
    found = T.toxicity_scores(docs, labels).toPandas().set_index("doc_id")
    unseen = ~found.index.isin(labelled)
    truth = marked[found.index]
    assert found[unseen & truth]["predicted"].mean() > 0.9 and found[unseen & ~truth]["predicted"].mean() < 0.05
