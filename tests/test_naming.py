"""Names one by one, and references appended one by one, against the table operators."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tagloom.operators import ranking as K
from tagloom.operators.naming import conflict_free_names
from tagloom.operators.references import listed_references, reference_append


def one_by_one(requests, taken):
    used, out = set(taken), {}
    for at, target in sorted(requests):
        if target is None:
            out[at] = None
            continue
        suffix = (re.findall(r"[^/\\.][^/\\]*?(\.[^./\\]+)$", target) or [""])[0]
        stem, name, i = target[: len(target) - len(suffix)], target, 0
        while name in used:
            i += 1
            name = f"{stem}_{i}{suffix}"
        used.add(name)
        out[at] = name
    return out


CASES = [
    (["a", "a", "a_1"], []), (["a_1", "a", "a", "a"], []), (["a", "a", "a", "a_1", "a_1", "a_2"], ["a", "a_3"]), (["a.jpg", "a.png", "a.jpg", None, "d/a.jpg"], ["a_1.jpg", "a.JPG"]),
    (["a_1_1", "a", "a_1", "a", "a_1", "a"], []), ([".b", ".b", "c.d.e", "c.d.e", "x_01", "x", "x"], ["x"]), ([], ["a"]),
]


@pytest.mark.parametrize("seed", range(len(CASES) + 3))
def test_names_equal_one_by_one(spark, seed):
    rng = random.Random(seed)
    if seed < len(CASES):
        targets, taken = CASES[seed]
    else:
        pool = ["a", "a_1", "a_2", "a_3", "a_1_1", "a_1_2", "a_2_1", "b.jpg", "b_1.jpg", "b_2.jpg", "b_7.jpg"]
        targets = [rng.choice(pool) for _ in range(90)] + ["hot.png"] * 150 + [f"hot_{i}.png" for i in range(1, 200, 7)]
        rng.shuffle(targets)
        taken = [rng.choice(pool) for _ in range(3)] + [f"hot_{i}.png" for i in range(3, 60, 9)]
    requests = [(10 * i + 3, t) for i, t in enumerate(targets)]
    df = spark.createDataFrame(requests, "o bigint, t string").repartition(3)
    got = {r.o: r["name"] for r in conflict_free_names(df, spark.createDataFrame([(t,) for t in taken], "path string"), "o", "t").collect()}
    assert got == one_by_one(requests, taken)


def test_top_per_key_with_its_own_n(spark, monkeypatch):
    rows = spark.range(4000).select((F.col("id") % 3 == 0).cast("int").alias("k"), ((F.col("id") * 37) % 4001).alias("o"))
    rows = rows.withColumn("n", F.when(F.col("k") == 0, 5).otherwise(900))
    want = K.top_per_key(rows, ["k"], ["o"], "n", 900)
    assert "WindowGroupLimit" in want._jdf.queryExecution().toString()
    found = {(r.k, r.o, r["rank"]) for r in want.collect()}
    assert len(found) == 905
    monkeypatch.setattr(K, "FOLD_ROWS", 10)
    assert {(r.k, r.o, r["rank"]) for r in K.top_per_key(rows, ["k"], ["o"], "n", 900).collect()} == found


def test_append_one_by_one(spark):
    rng = random.Random(6)
    near = lambda h: h ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) * rng.randrange(2)
    base = [rng.getrandbits(60) for _ in range(12)]
    sha = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    pixels = {i: rng.choice([None, near(base[i % 12])]) for i in range(30)}  # equal content, equal picture
    refs, adds, listed = [], [], set()
    for e in ("x", "y", "z"):
        for i in range(8):
            path = rng.choice([f" refs\\{e}\\{rng.randrange(6)}.png ", f"refs/{e}/{rng.randrange(6)}.png", "  ", f"refs/{e}/gone{i}.png", f"refs/{e}/{sha(rng.randrange(30))[:16]}.png"])
            refs.append((e, i, path, rng.choice([None, near(rng.choice(base))])))
            if "gone" not in path:
                listed.add(path.replace("\\", "/").strip())
        for i in range(25):
            content = rng.randrange(30)
            adds.append((e, i, rng.choice(["n.PNG", "n.png", "n", "q.JPG"]), f"refs/{e}", sha(content) if rng.random() < 0.9 else None, pixels[content]))
    want = []
    for e in ("x", "y", "z"):
        kept, seen, hashes = [], set(), []
        for _, _, path, h in [r for r in refs if r[0] == e]:
            path = path.replace("\\", "/").strip()
            if path and path not in seen and path in listed:
                kept.append((path, False))
                seen.add(path)
                hashes += [h] if h is not None else []
        for _, _, source, folder, digest, h in [a for a in adds if a[0] == e]:
            if digest is None or (h is not None and any((h ^ x).bit_count() <= 2 for x in hashes)):
                continue
            path = f"{folder}/{digest[:16]}{source[1:].lower() or '.img'}"
            if path not in seen:
                kept.append((path, True))
                seen.add(path)
                hashes += [h] if h is not None else []
        want += [(e, n, p, a) for n, (p, a) in enumerate(kept)]
    references = spark.createDataFrame(refs, "entity_id string, pos int, path string, h bigint")
    files = spark.createDataFrame([(p,) for p in listed], "path string")
    additions = spark.createDataFrame(adds, "entity_id string, pos int, source string, folder string, sha1 string, h bigint")
    got = reference_append(listed_references(references, files), additions).collect()
    assert sorted(map(tuple, got)) == sorted(want)
