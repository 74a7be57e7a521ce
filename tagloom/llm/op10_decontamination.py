"""Benchmark decontamination by suffix arrays over the training texts.

Every shard (a slice of a task's documents) is a sequence of word hashes. Its
suffix array holds the word positions in the order of what follows them, to
the depth that the test suffixes are searched at: ``window`` words, or a whole
shorter item. All suffixes of the test items are binary-searched in every
shard; a match is located in its document and extended to its full length, and
the longest matches give the words that are hit and the items. Positions and
test suffixes whose first words do not occur on the other side, by a table of
bits, are left out before sorting and searching.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import NO_ID, query, table
from tagloom.llm.texts import ALNUM, U, byte_table, gram_hashes, kept, lowered, ragged, slices, span_hashes, text_bytes, words
from tagloom.session import materialize

TEST_BYTES = 32 << 20  # of test text that travels to the tasks at once; more goes in blocks


BITS = 22  # of the tables that leave out what cannot match


def _marked(grams: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << BITS, bool)
    bits[(grams & U((1 << BITS) - 1)).astype(np.int64)] = True
    return bits


def _among(grams: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return bits[(grams & U((1 << BITS) - 1)).astype(np.int64)]


class TestSuffixes:
    """Suffixes of the items of one block, by search depth: ``window`` words,
    or the whole item where it is shorter. Some 30 bytes a word."""

    def __init__(self, ids: list[str], texts: list[str], window: int) -> None:
        self.ids = ids
        buf, offsets = text_bytes(pa.array(texts, pa.string()))
        buf = lowered(buf)
        starts, ends, first = words(buf, offsets, byte_table(words=ALNUM))
        self.h = span_hashes(buf, starts, ends)
        self.first = first
        self.item = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(first))
        self.end = first[1:][self.item] if len(self.item) else np.zeros(0, np.int64)
        size = np.diff(first)
        self.depths = {}
        for d in sorted({min(window, int(n)) for n in size if n}):
            whole = (size >= window) if d == window else (size == d)
            at = np.flatnonzero(whole[self.item] & (np.arange(len(self.h)) + d <= self.end)).astype(np.int32)
            grams = gram_hashes(self.h, d)[at]
            self.depths[d] = (at, grams, _marked(grams))


def prefixes(h: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The first ``depth`` words of each suffix as one comparable value."""
    rows = h[at[:, None] + np.arange(depth)].astype(">u8")
    return np.ascontiguousarray(rows).view(f"S{8 * depth}").reshape(-1)


def suffix_array(h: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in suffix order to ``depth`` words, with their first words."""
    keys = prefixes(h, at, depth)
    order = np.argsort(keys, kind="stable")
    return at[order], keys[order]


def _search(h, doc_end, tests: TestSuffixes) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(training positions, test positions, depth) of all matches."""
    for depth, (test_at, test_grams, bits) in tests.depths.items():
        grams = gram_hashes(h, depth)
        at = np.flatnonzero(_among(grams, bits))
        at = at[at + depth <= doc_end[at]]
        if not len(at):
            continue
        test = test_at[_among(test_grams, _marked(grams[at]))]
        at, keys = suffix_array(h, at, depth)
        test_keys = prefixes(tests.h, test, depth)
        low, high = np.searchsorted(keys, test_keys, "left"), np.searchsorted(keys, test_keys, "right")
        hit = np.flatnonzero(high > low)
        many = (high - low)[hit]
        place = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(hit) else np.zeros(0, np.int64)
        yield at[place], np.repeat(test[hit], many).astype(np.int64), depth


def _located(h, first, doc, doc_end, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(training position, test position, length) of the matches that cannot be
    lengthened, each extended to its full length."""
    out = [(np.zeros(0, np.int64),) * 3]
    for at, test, depth in _search(h, doc_end, tests):
        same_left = (at > first[doc[at]]) & (test > tests.first[tests.item[test]])
        left = np.flatnonzero(same_left)
        same_left[left] = h[at[left] - 1] == tests.h[test[left] - 1]
        at, test = at[~same_left], test[~same_left]
        length = np.full(len(at), depth)
        room = np.minimum(doc_end[at] - at, tests.end[test] - test)
        going = np.flatnonzero(length < room)
        while len(going):
            going = going[h[at[going] + length[going]] == tests.h[test[going] + length[going]]]
            length[going] += 1
            going = going[length[going] < room[going]]
        out.append((at, test, length))
    return tuple(np.concatenate(x) for x in zip(*out))


def _shard(batch: pa.RecordBatch):
    buf, offsets = text_bytes(batch.column("text"))
    buf = lowered(buf)
    starts, ends, first = words(buf, offsets, byte_table(words=ALNUM))
    h = span_hashes(buf, starts, ends)
    doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
    return h, first, doc, first[1:][doc] if len(doc) else np.zeros(0, np.int64)


Block = tuple[str, Broadcast]  # a name, and the ids and texts of its items


def _tests(block: Block, window: int) -> TestSuffixes:
    """A block's tables, built by a worker when it first meets the block; it
    holds those of one block at a time."""
    name, shared = block
    held = kept("test-suffixes", dict)
    if (name, window) not in held:
        held.clear()
        held[name, window] = TestSuffixes(*shared.value, window)
    return held[name, window]


def _spans(block: Block, window: int):
    """Per document: its words, the stretches hit by located matches, the items found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = _tests(block, window)
        for batch in slices(batches, "text"):
            h, first, doc, doc_end = _shard(batch)
            at, test, length = _located(h, first, doc, doc_end, tests)
            found = np.unique(doc[at] * len(tests.ids) + tests.item[test]) if len(at) else np.zeros(0, np.int64)
            order = np.argsort(at, kind="stable")
            at, length = at[order], length[order]
            cut = np.searchsorted(at, first)
            base = np.repeat(first[:-1], np.diff(cut))
            holder = found // max(1, len(tests.ids))
            items = pa.array([tests.ids[i] for i in (found % max(1, len(tests.ids))).tolist()], pa.string())
            item_cut = np.searchsorted(holder, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(np.diff(first), pa.int64()), ragged(cut, at - base, pa.int64()),
                 ragged(cut, at + length - base, pa.int64()), pa.ListArray.from_arrays(pa.array(item_cut, pa.int32()), items)],
                ["doc_id", "row", "n_words", "begins", "ends", "items"])

    return run


def _longest(block: Block, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = _tests(block, window)
        for batch in slices(batches, "text"):
            h, first, doc, doc_end = _shard(batch)
            at, test, length = _located(h, first, doc, doc_end, tests)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc[at])), pa.array(at - first[doc[at]], pa.int64()),
                 pa.array([tests.ids[i] for i in tests.item[test].tolist()], pa.string()),
                 pa.array(test - tests.first[tests.item[test]], pa.int64()), pa.array(length, pa.int64())],
                ["doc_id", "doc_word", "item_id", "item_word", "length"])

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_hit, n_items, sha = [], [], []
        for begins, ends, items in zip(*(batch.column(c).to_pylist() for c in ("begins", "ends", "items"))):
            hit, seen = 0, 0
            for a, b in sorted(zip(begins, ends)):
                hit += max(0, b - max(a, seen))
                seen = max(seen, b)
            names = sorted(set(items))
            n_hit.append(hit)
            n_items.append(len(names))
            sha.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string())],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])


def test_blocks(items: DataFrame, limit: int = TEST_BYTES) -> list[Block]:
    """The test items in blocks of at most about ``limit`` bytes by the measured
    size of all of them. A block's texts are a broadcast; its tables are built
    by the workers."""
    spark = items.sparkSession
    slim = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    size = slim.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = 1 + size // limit
    out = []
    for i in range(n):
        rows = slim.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect() if n > 1 else slim.collect()
        out.append((uuid.uuid4().hex, spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))))
    return out


test_blocks.__test__ = False
TestSuffixes.__test__ = False


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, limit: int = TEST_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256) for every row of ``docs``.

    Words are runs of ASCII letters and digits and non-ASCII characters, A-Z
    in lower case. A window is ``window`` consecutive words of an item, or all
    words of a shorter one; a document's word inside an occurrence of a window
    is hit. Null and wordless texts have no words, no hits and no items, and
    items without words find nothing. Repeated rows each get their row; a null
    item_id counts as the empty string; other columns are ignored.
    """
    slim, schema = _slim(docs), "doc_id bigint, row bigint, n_words bigint, begins array<bigint>, ends array<bigint>, items array<string>"
    blocks = [slim.mapInArrow(_spans(block, window), schema) for block in test_blocks(items, limit)]
    found = blocks[0]
    if len(blocks) > 1:
        for more in blocks[1:]:
            found = found.unionByName(more)
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("begins", "ends", "items")]
        merged = found.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"), *lists, F.count(F.lit(1)).alias("c"))
        copies = F.explode(F.sequence(F.lit(1), (F.col("c") / len(blocks)).cast("int"))).alias("copy")
        found = merged.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_words", "begins", "ends", "items", copies)
    return found.mapInArrow(_digest, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string")


def longest_matches(docs: DataFrame, items: DataFrame, window: int = 10, limit: int = TEST_BYTES) -> DataFrame:
    """(doc_id, doc_word, item_id, item_word, length): the verbatim matches of
    at least a window (or a whole shorter item) that cannot be lengthened, in
    words from 0. Null and wordless texts match nothing; repeated rows of either
    table give their matches each; a null item_id is the empty string; an empty
    table on either side gives no rows."""
    slim, schema = _slim(docs), "doc_id bigint, doc_word bigint, item_id string, item_word bigint, length bigint"
    out = None
    for block in test_blocks(items, limit):
        found = slim.mapInArrow(_longest(block, window), schema)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of an
    item. A row with a null doc_id is judged by its own text like any other."""
    found = contamination(docs.select(F.xxhash64("text").alias("doc_id"), "text"), items, window)
    gone = materialize(found.filter("n_hit > 0").select(F.col("doc_id").alias("_row")).distinct(), "contaminated")
    keyed = docs.select(F.struct(*docs.columns).alias("_all"), F.xxhash64("text").alias("_row"))
    return keyed.join(gone, "_row", "left_anti").select("_all.*")


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op10_suffix_array_decontamination", oracle=rf"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
b AS (SELECT item_id, {WORDS} AS ws FROM benchmark),
q AS (SELECT DISTINCT item_id, k, unnest([array_to_string(ws[i : i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS g
      FROM (SELECT *, least(10, len(ws)) AS k FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM q),
p AS (SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS i, unnest([array_to_string(ws[i : i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS g
      FROM d, ks WHERE len(ws) >= k),
m AS (SELECT p.doc_id, p.i, p.k, q.item_id FROM p JOIN q ON p.k = q.k AND p.g = q.g),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""")
def op10_suffix_array_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=10)
    return found.withColumn("contaminated", F.col("n_hit") > 0)
