"""Operators over single texts against brute force, with the awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tagloom.llm.op01_sharding import shards
from tagloom.llm.op02_token_counts import token_counts
from tagloom.llm.op05_packing import cuts, pack
from tagloom.llm.op09_quality_rules import judged
from tagloom.llm.op10_decontamination import contamination, decontaminated, longest_matches

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, size string, _all int, stats int"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LONG = "lorem ipsum dolor " * 20_000


def rows(texts, ids=None):
    return [(ids[i] if ids else i, t, "en" if i % 3 else None, "s", 1, 7, "x", 2, 3) for i, t in enumerate(texts)]


AWKWARD = [None, "", " \n\t", "a", "a", "word " * 60, LONG, "x" * 3000, "été 日本\u00a0語 😀", "a<|endoftext|>b <|endoftext|>", "\n\na\n", "don't we'll 'tis ''s"]


@pytest.fixture(scope="module")
def awkward(spark):
    docs = spark.createDataFrame(rows(AWKWARD) + rows(AWKWARD[:5]) + [(None, "no id", None, None, 1, 7, "x", 2, 3)], SCHEMA)
    return docs.repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def pieces_of(rng, n):
    alphabet = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "a", "é", "1", "²", "!", "<|endoftext|>", "日本", "😀", "’", "the", "\x1c", "\x85"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_token_counts_equal_the_library(spark, awkward, nothing):
    texts = pieces_of(random.Random(3), 800)
    docs = spark.createDataFrame(rows(texts), SCHEMA).unionByName(awkward)
    coder = Tokenizer.from_file(VOCABULARY)
    got = sorted(tuple(-1 if x is None else x for x in r) for r in token_counts(docs, VOCABULARY).collect())
    want = []
    for r in docs.collect():
        n = len(coder.encode(r.text or "", add_special_tokens=False).ids)
        want.append((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()), n, n > 1024))
    assert got == sorted(want)
    assert token_counts(nothing, VOCABULARY).collect() == []


def test_packing_round_trip(spark, awkward, nothing):
    coder = Tokenizer.from_file(VOCABULARY)
    docs = awkward.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(spark.createDataFrame(rows(["some words here " * (i % 90) for i in range(400)], [1000 + i for i in range(400)]), SCHEMA))
    ids = {r.doc_id: np.array([*coder.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    out = pack(docs, VOCABULARY, capacity=2048, with_ids=True).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == ids.keys()
    for doc, parts in by_doc.items():
        parts.sort(key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in parts) == ids[doc].tobytes()
        assert [r.start for r in parts] == list(np.cumsum([0, *[r.length for r in parts]])[:-1])
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.doc_tokens == len(ids[doc]) for r in parts)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == list(np.cumsum([0, *[r.length for r in parts]])[:-1])
        assert sum(r.length for r in parts) <= 2048
    assert len(by_sequence) <= sum(map(len, ids.values())) / 2048 * 1.02 + 1
    assert len(pack(awkward, VOCABULARY).filter("start = 0").collect()) == awkward.count()  # repeated rows, null ids
    assert pack(nothing, VOCABULARY).collect() == []


def test_cuts_cover_the_length():
    for n in range(1, 5000):
        parts = cuts(n, 2048)
        assert sum(parts) == n and max(parts) <= 2048 and min(parts) > 0


@pytest.mark.parametrize("n", [1, 5, 24])
def test_shards(spark, awkward, nothing, n):
    rng = random.Random(n)
    texts = ["copy of one text"] * 700 + ["w" * rng.randint(0, 400) + str(i) for i in range(1400)]
    docs = spark.createDataFrame(rows(texts), SCHEMA).repartition(5)
    out = shards(docs, n).select("row.doc_id", "row.text", "size", "shard", "slot").collect()
    assert sorted(r.doc_id for r in out) == list(range(len(texts)))
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in out:
        assert r["size"] == len(r.text) + 8
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    mean = sum(sizes.values()) / n
    assert sorted(sizes) == list(range(n)) and all(abs(x - mean) <= 0.05 * mean + 450 for x in sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shards(nothing, n).collect() == []
    odd = shards(awkward, n).collect()
    assert len(odd) == awkward.count() and all(0 <= r.shard < n for r in odd)


def test_rule_counts_and_outliers(spark, awkward, nothing):
    rng = random.Random(1)
    vocabulary = [f"{a}{b}" for a in "bcdfghjklm" for b in ("ala", "ore", "inte", "u", "essa")]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(60, 200))) for _ in range(300)]
    texts += ["### $$$ " + " ".join(w + "%%&&" for w in rng.choices(vocabulary, k=100)) for _ in range(5)]
    texts += ["one two three\nfour\nfour\n four\n" * 20, *[" ".join(rng.choices("ab", k=rng.randint(0, 30))) + "\n" * (i % 3) for i in range(50)]]
    docs = spark.createDataFrame(rows(texts), SCHEMA).unionByName(awkward)
    out = judged(docs).collect()
    assert len(out) == docs.count()
    got = collections.Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    want = collections.Counter()
    for r in docs.collect():
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = collections.Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        want[len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed] += 1
    assert got == want
    kept = {r.doc_id: r.kept for r in out if r.doc_id is not None and r.doc_id >= 20}
    assert all(kept[i] for i in range(20, 300)) and not any(kept[i] for i in range(300, 305))
    assert judged(nothing).collect() == []


def test_a_text_far_out_in_one_count_is_rejected_where_the_others_are_alike(spark):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in "bcdfghjklm" for b in ("ala", "ore", "inte", "u", "essa")]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(60, 200))) for _ in range(400)]
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(100)) + "\nhome" * 11)
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 7, "x", 2, 3) for i, t in enumerate(texts)], SCHEMA)
    out = {r.doc_id: r for r in judged(docs).collect()}
    assert out[400].n_dup_lines == 10 and not out[400].base_failed and out[400].distance < 60 and not out[400].kept
    assert all(out[i].kept for i in range(400))
    assert {r.kept for r in judged(docs, cut=60.0).collect()} == {True}


ITEMS = ["one two three four five six seven eight nine ten eleven twelve", "Alpha beta, gamma!", "", None, "x " * 30, "one two three four five six seven eight nine ten else", "日本 語 x1"]


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contaminated_texts():
    rng = random.Random(9)
    texts = []
    for i in range(150):
        words = [rng.choice(["one", "two", "x", "beta", "zeta", "GAMMA", "alpha"]) for _ in range(rng.randint(0, 40))]
        if i % 3 == 0:
            item = rng.choice([x for x in ITEMS if x]).split()
            at, lo = rng.randint(0, len(words)), rng.randint(0, 2)
            words[at:at] = item[lo:]
        texts.append(rng.choice([" ", ", ", "\n"]).join(words))
    return texts


@pytest.mark.parametrize("limit", [1 << 20, 60])
def test_contamination(spark, awkward, nothing, limit):
    docs = spark.createDataFrame(rows(contaminated_texts()), SCHEMA).unionByName(awkward)
    items = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    want = collections.Counter()
    for r in docs.collect():
        words, hit, found = tokens(r.text), set(), set()
        for k, item in enumerate(ITEMS):
            w = tokens(item)
            size = min(10, len(w))
            windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found.add(str(k))
        want[r.doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()] += 1
    got = contamination(docs, items, 10, limit)
    assert collections.Counter(map(tuple, got.collect())) == want
    assert contamination(nothing, items).collect() == []
    assert contamination(docs, items.limit(0)).filter("n_hit > 0").count() == 0
    kept = decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == sum(n for x, n in want.items() if x[2] == 0)


def test_longest_matches(spark):
    docs = spark.createDataFrame([(5, "zero " + ITEMS[0] + " end"), (6, ITEMS[0].replace("five", "5"))], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    got = {tuple(r) for r in longest_matches(docs, items).collect()}
    assert got == {(5, 1, "0", 0, 12), (5, 1, "5", 0, 10)}


def test_longest_matches_of_awkward_rows(spark, awkward, nothing):
    item = "north wind and the sun were disputing which was the stronger when a traveller came"
    texts = [(1, f"the {item} along"), (1, f"the {item} along"), (2, None), (3, ""), (4, " ".join(item.split()[2:13]) + " x"), (None, item)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([("a", item), ("a", item), (None, "came along"), ("e", ""), ("n", None)], "item_id string, text string")
    got = collections.Counter(map(tuple, longest_matches(docs, items).collect()))
    n = len(item.split())
    want = collections.Counter({(1, 1, "a", 0, n): 4, (4, 0, "a", 2, 11): 2, (None, 0, "a", 0, n): 2, (1, n, "", 0, 2): 2})
    assert got == want
    assert collections.Counter(map(tuple, longest_matches(docs, items, limit=60).collect())) == want
    assert longest_matches(nothing, items).collect() == [] and longest_matches(awkward, items.limit(0)).collect() == []
