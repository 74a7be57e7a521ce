"""Spelling variants, Merkle manifest and exact dedup against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm.op11_spelling import chosen_pivots, near_words, run_crcs, spelling_forms, word_counts
from tagloom.llm.op12_merkle import folded, manifest, proof_digest
from tagloom.llm.op13_exact_dedup import exact_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, name string, place int, part string, word string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 2, "p", "w", 3) for r in rows], SCHEMA)


def runs_of(text):
    return re.findall("[A-Za-zÀ-ÿ]+", text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_counts(rows, rate):
    n = collections.Counter()
    for doc_id, text, *_ in rows:
        for run in runs_of(text):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % rate == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    return n


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a != b and (a[k:] == b[k + 1 :] if len(a) < len(b) else len(a) == len(b) and a[k + 1 :] == b[k + 1 :])


def brute_forms(n):
    out = {}
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n}
    best = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in near.items() if xs}
    form = {w: best[w] if w in best and n[best[w]] >= 2 * n[w] else None for w in n}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def word_rows(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["x" * 400, "ab" * 90, "É" + "t" * 70]
    rows = [(None, "Plain plain PLAIN été", "en", None, 1), (1, None, None, None, None), (2, "", "", "", 0), (3, " \n\t", "a", "b", 2)]
    for i in range(30):
        rows.append((5000 + i, "stepabbzz " * 3 + "stepaabzz " * (i % 2) + "stepaaazz " * (i % 5 == 0), "en", "s", 1))
    for i in range(150):
        words = []
        for _ in range(rng.randint(1, 40)):
            w = rng.choice(stems)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k, c = rng.randrange(len(w) + 1), rng.choice("abcé")
                w = rng.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((10 + i, rng.choice([" ", "-", "1", " Ā", "　"]).join(words), "en", "s", 1))
    return rows + rows[20:24]


@pytest.mark.parametrize(("seed", "rate"), [(1, 97), (2, 7)])
def test_spelling_forms(spark, seed, rate):
    rows = word_rows(seed)
    docs = frame(spark, rows).repartition(3)
    counts = brute_counts(rows, rate)
    assert {r.word: r.n for r in word_counts(docs, rate=rate).collect()} == counts
    want = brute_forms({w: n for w, n in counts.items() if n >= 3})
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_forms(docs, rate=rate).collect()}
    assert got == want
    assert any(v[0] for v in want.values()) and any(v[1] != v[0] and v[0] for v in want.values())
    assert spelling_forms(docs.limit(0)).collect() == []
    assert spelling_forms(docs.filter("text IS NULL OR text = ''")).collect() == []


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aé"])
def test_every_pair_at_one_edit_is_found(spark, letters):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(5, 8))) for _ in range(900)} | {"aaaaa", "aaaaaa", "aaaaaaa"}
    vocabulary = spark.createDataFrame([(w, 3) for w in words], "word string, n bigint")
    got = [(r.a, r.b) for r in near_words(vocabulary).collect()]
    want = {(a, b) for a in words for b in words if a < b and abs(len(a) - len(b)) < 2 and one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_pivots_are_the_rarest_disjoint_pair():
    rng = np.random.default_rng(3)
    weight = rng.integers(1, 50, (500, 9))
    left, right = chosen_pivots(weight)
    for w, i, j in zip(weight, left, right):
        assert j - i >= 2 and w[i] + w[j] == min(w[a] + w[b] for a in range(9) for b in range(a + 2, 9))


def test_checksums_of_runs():
    rng = random.Random(5)
    texts = [bytes(rng.choices(range(256), k=rng.choice([1, 2, 5, 63, 64, 65, 300]))) for _ in range(200)]
    ends = np.cumsum([len(x) for x in texts])
    before = np.array([zlib.crc32(str(i).encode()) for i in range(200)], np.uint32)
    got = run_crcs(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], ends[:-1]]), ends, before)
    assert got.tolist() == [zlib.crc32(x, int(b)) for x, b in zip(texts, before)]


def sha(*values):
    return hashlib.sha256("".join(values).encode()).hexdigest()


def brute_leaf(row):
    doc_id, text, lang, source, n_chars = row
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def brute_paths(digests):
    """Top of a list of digests, and for each its siblings from below."""
    paths, at, nodes = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(nodes) > 1:
        for path, k in zip(paths, at):
            lo = k // 8 * 8
            path.append(("".join(nodes[lo:k]), "".join(nodes[k + 1 : lo + 8])))
        nodes = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [k // 8 for k in at]
    return nodes[0], paths


def brute_manifest(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, brute_leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, lists = [], []
    for g in order:
        leaves = sorted(groups[g], key=lambda x: x[:3])
        top, paths = brute_paths([x[2] for x in leaves])
        tops.append(top)
        lists.append((leaves, paths))
    root, upper = brute_paths(tops)
    out = []
    for top, above, (leaves, paths) in zip(tops, upper, lists):
        for leaf, path in zip(leaves, paths):
            out.append((leaf[3][0], leaf[2], top, root, sha(*[a + b for a, b in path + above])))
    return out


def manifest_rows(seed, groups):
    rng = random.Random(seed)
    rows = [(None, "no id", "g0", None, 1), (None, "no id either", "g0", "s", None), (5, None, None, None, None), (6, "", "", "", 0), (6, "", "", "", 0), (7, "é1:" * 5000, "é", "-", 3)]
    for i in range(700):
        rows.append((rng.randint(-50, 5000), " ".join(rng.choices("abc", k=3)), f"g{min(rng.randrange(groups), rng.randrange(groups))}", "s", i))
    return rows


@pytest.mark.parametrize(("seed", "groups"), [(1, 1), (2, 3), (3, 90)])
def test_manifest(spark, seed, groups):
    rows = manifest_rows(seed, groups)
    out = manifest(frame(spark, rows).repartition(5)).withColumn("again", folded(F.col("leaf"), F.col("path")))
    got = out.select("row.doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof"), "again").collect()
    assert all(r.again == r.root for r in got)
    assert collections.Counter(tuple(r)[:5] for r in got) == collections.Counter(brute_manifest(rows))


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65])
def test_manifest_of_small_tables(spark, n):
    rows = [(i, f"text {i}", "en", "s", i) for i in range(n)]
    out = manifest(frame(spark, rows))
    got = out.select("row.doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof")).collect()
    assert sorted(map(tuple, got)) == (sorted(brute_manifest(rows)) if n else [])
    wrong = out.filter(folded(F.sha2(F.lit("other").cast("binary"), 256), F.col("path")) == F.col("root"))
    assert wrong.count() == 0


def dedup_rows(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice(["ab ", "c\n", "d\t ", "é", "😀", "　"]) for _ in range(rng.choice([0, 1, 5, 40, 41, 200, 900]))) for _ in range(60)]
    texts = [None, "", " ", "\n\t ", "a", "a ", " a", "a  b", "a\x0bb", "a\x1cb", "a b"] + base
    for t in base:
        for _ in range(rng.choice([0, 1, 3])):
            k = rng.randrange(len(t) + 1)
            texts.append(rng.choice([t, t.replace(" ", "\n\n"), t[:k] + "!" + t[k:], t[:k], t + t]))
    texts += ["hot copy " * 60] * 1300 + ["x" * 64] * 50 + ["x" * 64 * k for k in range(1, 40)]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts)) + [(None, "a"), (None, "only here"), (None, "only here"), (ids[12], texts[12]), (ids[12], texts[12])]


@pytest.mark.parametrize(("seed", "block"), [(1, 8), (2, 64), (3, 1024)])
def test_exact_groups(spark, seed, block):
    rows = dedup_rows(seed)
    got = exact_groups(frame(spark, [(i, t, "en", "s", 1) for i, t in rows]).repartition(4), block).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = collections.Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_groups_of_no_rows(spark):
    assert exact_groups(frame(spark, [])).collect() == []
