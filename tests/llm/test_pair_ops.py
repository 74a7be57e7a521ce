"""Operators between texts, and learned scores, against brute force or held-out rows."""

import collections
import random
import re

import numpy as np
import pytest

from tagloom.llm.common import QUERIES, components, table
from tagloom.llm.op03_url_filters import judge
from tagloom.llm.op04_quality import fit_trees, good_documents, quality_scores
from tagloom.llm.op06_ngram_join import jaccard_components, representatives
from tagloom.llm.op07_toxicity import toxicity_scores
from tagloom.llm.op08_line_dedup import repeated_lines, without_repeated_lines

SCHEMA = "doc_id long, text string, lang string, node int, _row string, removed int"


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "en", 1, "x", 2) for i, t in pairs], SCHEMA)


def near_corpus(seed):
    """Copies from two to hundreds, chains at the threshold, a common passage."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    texts = [None, "", " ", "a", "A", "a b", "b a", "a b c"] * 2
    for size in [2] * 25 + [5] * 6 + [150]:
        base = rng.choices(vocabulary, k=rng.randint(8, 260))
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words) + (f" {passage}" if rng.random() < 0.4 else ""))
    texts += [texts[40]] * 60
    texts += [passage + " " + " ".join(rng.choices(vocabulary, k=rng.randint(5, 60))) for _ in range(80)]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts))


def brute_components(pairs, k, num, den):
    sets = {}
    for i, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("seed", "k", "num"), [(1, 4, 85), (2, 5, 80)])
def test_jaccard_components(spark, seed, k, num):
    pairs = near_corpus(seed)
    docs = frame(spark, pairs).repartition(4)
    want = brute_components(pairs, k, num, 100)
    assert {tuple(r) for r in jaccard_components(docs, k, num, 100).collect()} == want
    if k == 5:
        kept = representatives(docs, k, num, 100)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, _, c in want if i == c}
        odd = frame(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (1, "x"), (1, "x")])
        assert representatives(odd).count() == 4
        assert jaccard_components(docs.limit(0)).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 164)] + [(7, x) for x in range(1000, 1300)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: 100 for x in range(100, 165)} | {7: 7} | {x: 7 for x in range(1000, 1300)}


def line_corpus(seed):
    rng = random.Random(seed)
    lines = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 14))) for _ in range(120)]
    texts = [None, "", "\n\n", " x \n\n", "tail\r\n"]
    for _ in range(70):
        lo = rng.randrange(100)
        part = lines[lo : lo + rng.randint(1, 9)] if rng.random() < 0.7 else rng.choices(lines, k=rng.randint(1, 9))
        texts.append("\n".join(x if rng.random() < 0.9 else "  " + x + "\n" for x in part))
    return list(zip(rng.sample(range(1000), len(texts)), texts)) + [(texts.index(None) + 2000, texts[9])] * 2


def brute_removed(pairs, fingerprints, noise, guarantee):
    """Winnowing, first places and both-way extension with lists and loops."""
    docs = {}
    for key in dict.fromkeys(pairs):
        kept = [(i, x.strip(" \t\n\x0b\x0c\r")) for i, x in enumerate((key[1] or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
        docs[key] = ([i for i, _ in kept], [x for _, x in kept])
    places = collections.defaultdict(list)
    for key, prints in fingerprints.items():
        for first, last in prints:
            places[tuple(docs[key][1][first : last + 1])].append((key, first, last))
    removed = collections.defaultdict(set)
    for found in places.values():
        if len(found) < 2:
            continue
        found.sort(key=lambda p: (order[p[0]], p[1]))
        (home, start, _), later = found[0], found[1:]
        there = docs[home][1]
        for key, first, last in later:
            at, here = docs[key]
            lo, hi = first, last
            while lo > 0 and start - (first - lo) > 0 and here[lo - 1] == there[start - (first - lo) - 1]:
                lo -= 1
            while hi + 1 < len(here) and start + hi + 1 - first < len(there) and here[hi + 1] == there[start + hi + 1 - first]:
                hi += 1
            removed[key] |= set(at[lo : hi + 1])
    return {k: sorted(v) for k, v in removed.items()}


order: dict = {}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup(spark, seed):
    from tagloom.llm.op08_line_dedup import fingerprints
    from tagloom.llm.texts import span_hashes

    noise, guarantee = 8, 12
    pairs = line_corpus(seed)
    docs = frame(spark, pairs)
    rows = {(r.doc_id, r.text): r.row for r in docs.selectExpr("doc_id", "text", "xxhash64(text) AS row").collect()}
    order.clear()
    order.update({k: (k[0], v) for k, v in rows.items()})
    prints = {}
    for key in rows:
        lines = [x.strip(" \t\n\x0b\x0c\r") for x in (key[1] or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        data = "\n".join(lines).encode()
        ends = np.cumsum([len(x.encode()) + 1 for x in lines]) - 1 if lines else np.zeros(0, np.int64)
        starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if lines else np.zeros(0, np.int64)
        h = span_hashes(np.frombuffer(data, np.uint8), starts, ends)
        many = np.array([len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines], np.int64)
        gram, first, last = fingerprints(h, many, noise, guarantee)
        # by definition: the smallest gram of each shortest run of ``guarantee`` words
        chosen = set()
        stop = lambda i, n: next((j for j in range(i, len(lines)) if sum(many[i : j + 1]) >= n), None)  # noqa: B023, E731
        value = {}
        for i in range(len(lines)):
            if (j := stop(i, noise)) is not None:
                value[i] = j
        by_gram = dict(zip(first.tolist(), gram.tolist()))
        for i in range(len(lines)):
            if (j := stop(i, guarantee)) is not None:
                inside = [g for g in value if g >= i and value[g] <= j]
                chosen_here = [g for g in inside if g in by_gram]
                assert chosen_here, "a window without a fingerprint"
                chosen.add(min(chosen_here, key=lambda g: (by_gram[g], g)))
        assert chosen == set(first.tolist()) and all(value[a] == b for a, b in zip(first.tolist(), last.tolist()))
        prints[key] = list(zip(first.tolist(), last.tolist()))
    want = brute_removed(list(rows), prints, noise, guarantee)
    got = {(r.doc_id, r.row): r.removed for r in repeated_lines(docs, noise, guarantee).collect()}
    assert got == {(k[0], rows[k]): v for k, v in want.items()}
    assert want
    out = without_repeated_lines(docs, noise, guarantee)
    assert out.columns == docs.columns
    texts = collections.Counter((r.doc_id, r.text) for r in out.collect())
    expected = collections.Counter()
    for key in pairs:
        gone = want.get(key, [])
        text = key[1] if not gone else "\n".join(x for i, x in enumerate(key[1].split("\n")) if i not in gone)
        expected[key[0], text] += 1
    assert texts == expected
    assert without_repeated_lines(docs.limit(0)).collect() == []


def test_long_passages_are_deleted_after_their_first_place(spark):
    passage = "\n".join(" ".join(f"p{i}x{j}" for j in range(9)) for i in range(7))
    docs = frame(spark, [(i, f"own line number {i} of this text\n{passage}\nlast words of {i}") for i in range(40)])
    out = {r.doc_id: r.text for r in without_repeated_lines(docs).collect()}
    assert passage in out[0]
    assert all(out[i] == f"own line number {i} of this text\nlast words of {i}" for i in range(1, 40))


def later_runs(pairs, noise):
    """Lines of every run of at least ``noise`` words that also stands at an
    earlier place, from all runs of all texts."""
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    seen, gone = {}, collections.defaultdict(set)
    for doc, text in sorted(pairs):
        kept = [(i, strip(x)) for i, x in enumerate(text.split("\n")) if strip(x)]
        for a in range(len(kept)):
            for b in range(a, len(kept)):
                run = tuple(x for _, x in kept[a : b + 1])
                if sum(len(x.split()) for x in run) >= noise and seen.setdefault(run, (doc, a)) != (doc, a):
                    gone[doc] |= {i for i, _ in kept[a : b + 1]}
    return {k: sorted(v) for k, v in gone.items()}


def test_a_repeated_line_of_eight_words_goes_whatever_stands_beside_it(spark):
    rng = random.Random(8)
    common = [" ".join(f"c{i}x{j}" for j in range(8 + i % 4)) for i in range(6)]
    pairs = []
    for i in range(120):
        lines = [" ".join(f"o{i}y{n}z{j}" for j in range(rng.randint(1, 14))) for n in range(6)]
        lines[rng.randrange(6)] = rng.choice(common)
        pairs.append((i, "\n".join(lines)))
    want = later_runs(pairs, 8)
    assert sum(map(len, want.values())) == 120 - len(common)
    assert {r.doc_id: r.removed for r in repeated_lines(frame(spark, pairs)).collect()} == want


def test_short_lines_of_a_run_go_though_its_lines_first_stand_apart(spark):
    long = " ".join(f"w{j}" for j in range(9))
    run = f"{long}\nshort tail"
    pairs = [(0, f"{long}\nalone here"), (1, f"first copy\n{run}\nown end 1"), (2, f"second copy\n{run}\nown end 2"), (3, f"a b c d\ne f\n{run}"), (4, f"x\na b c d\ne f\n{long}")]
    want = later_runs(pairs, 8)
    assert want == {1: [1], 2: [1, 2], 3: [2, 3], 4: [1, 2, 3]}
    assert {r.doc_id: r.removed for r in repeated_lines(frame(spark, pairs)).collect()} == want


@pytest.mark.parametrize(("seed", "noise"), [(1, 8), (2, 8), (3, 5), (4, 20)])
def test_every_later_run_of_the_noise_length_goes(spark, seed, noise):
    pairs = [(i, t) for i, t in line_corpus(seed) if t is not None]
    want = later_runs(set(pairs), noise)
    got = {r.doc_id: r.removed for r in repeated_lines(frame(spark, pairs + pairs[:9]), noise).collect()}
    assert want and got == want


PAGES = [
    (1, "http://A.Example.NET/en/x?q"), (2, "https://b.net/#f"), (3, "https://b.net"), (4, "http://x.example.com/de/1"), (5, "http://x.example.com/fr/1"),
    (6, "http://w.org/fr/"), (7, "http://worg/fr/"), (8, None), (9, "nothing"), (10, "s://h://y"), (11, "http://u:p@k.co.uk:80/a"), (11, "http://u:p@k.co.uk:80/a"), (None, "http://10.0.0.1/a"),
]


def test_url_rules_and_reputation(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in PAGES] + [(100 + i, f"http://bad.info/{i}", "x") for i in range(60)] + [(200 + i, f"http://good.info/{i}", "x") for i in range(60)], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(100 + i, 1) for i in range(50)] + [(200 + i, 0) for i in range(50)] + [(999, 1), (5, None)], "page_id long, bad int")
    out = judge(pages, outcomes).collect()
    got = collections.Counter((r.page_id, r.host, r.path, r.rule) for r in out if (r.page_id or 0) < 100)
    assert got == collections.Counter([
        (1, "a.example.net", "/en/x", "example.net/en/"), (2, "b.net", "/", "net/"), (3, "b.net", "", None), (4, "x.example.com", "/de/1", "example.com/de/"),
        (5, "x.example.com", "/fr/1", None), (6, "w.org", "/fr/", "org/fr/"), (7, "worg", "/fr/", None), (8, "", "", None), (9, "", "", None), (10, "h:", "//y", None),
        (11, "u:p@k.co.uk:80", "/a", None), (11, "u:p@k.co.uk:80", "/a", None), (None, "10.0.0.1", "/a", None)])
    verdicts = {r.host: r.verdict for r in out if r.rule is None}
    assert verdicts["bad.info"] == "block" and verdicts["good.info"] == "allow"
    assert judge(pages.limit(0), outcomes).collect() == []
    assert judge(pages, outcomes.limit(0)).filter("rule IS NULL AND verdict = 'block'").count() == 0


def test_trees_walk_like_loops():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    trees = fit_trees(x, y, trees=20, depth=3)
    score = trees.score(x)
    for row, s in list(zip(x, score))[:50]:
        margin = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            margin += leaf[node - len(f)]
        assert abs(1 / (1 + np.exp(-margin)) - s) < 1e-12
    assert ((score > 0.5) == (y == 1)).mean() > 0.95


def auc(y, p):
    wins = np.sign(p[y == 1][:, None] - p[y == 0][None, :])
    return (1 + wins.mean()) / 2


@pytest.mark.parametrize(("name", "label"), [("op4_histogram_boosted_quality", "quality"), ("op7_positive_unlabelled_toxicity", "toxic")])
def test_held_out_scores(spark, name, label):
    folder = "/root/testdata/sf0.1"
    labels = table(spark, folder, "labels").selectExpr("doc_id", f"{label} AS y")
    found = QUERIES[name](spark, folder).filter("held_out").join(labels, "doc_id").toPandas()
    assert auc(found.y.to_numpy(), found.score.to_numpy()) > (0.99 if label == "quality" else 0.9)


def test_scores_of_awkward_rows(spark):
    rng = random.Random(4)
    good = [(i, " ".join(rng.choices(["plain", "words", "of", "prose", "and", "more"], k=80)) + ".") for i in range(200)]
    bad = [(200 + i, " | ".join(rng.choices(["@@", "##", "BUY!!", "idiot"], k=80))) for i in range(200)]
    odd = [(900, None), (901, ""), (902, " "), (903, "w " * 200_000), (None, "no id"), (904, "same"), (904, "same")]
    docs = frame(spark, good + bad + odd)
    labels = spark.createDataFrame([(i, 1, 0, "x") for i, _ in good] + [(i, 0, 1, "x") for i, _ in bad] + [(5, 1, 0, "x"), (None, 1, 1, "x"), (6, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    for score in (quality_scores, toxicity_scores):
        out = score(docs, labels).collect()
        assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
        assert len({r.score for r in out if r.doc_id in (900, 901)}) == 1
        assert score(docs.limit(0), labels).collect() == []
        assert len(score(docs, labels.limit(0)).collect()) == docs.count()
    kept = good_documents(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i, _ in good} <= ids and not ids & {i for i, _ in bad}
