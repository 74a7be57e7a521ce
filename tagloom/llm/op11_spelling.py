"""Spelling variants by pivotal grams.

Bigrams of the vocabulary are ranked, rare ones first. A word's gram prefix is
its three rarest bigrams with their ties; its pivots are the two disjoint ones
of the prefix that are rarest together, found by dynamic programming. One edit
leaves a pivot whole: the left one if it falls behind it, else the right one.
Of two words at one edit, that pivot of the word whose prefix ends first in the
ranking lies in the other's prefix too.

Pivots are indexed against prefixes with position limits: a left pivot stands
at the same distance from the start, a right one from the end, and lengths
differ by at most one. What lies beyond the pivot is then equal, and of the
side with the edit one half, so both are part of the key; pairs that meet are
verified by edit distance inside the join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import CRC_SQL, crc32_sql, query, table
from tagloom.llm.texts import MIX_2, STEP, U, lowered, mixed, ragged, signed, slices, span_hashes, text_bytes, words
from tagloom.operators.ranking import root_labels
from tagloom.session import materialize

HELD_WORDS = 200_000  # distinct words that a task counts before it passes them on
LEAD = 0xC3  # first byte of the letters U+00C0 to U+00FF
PLAIN_BYTES = 64  # longer runs are handled one by one
ABSENT = 1 << 40  # weight of a bigram that cannot be a pivot
_CRC = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)  # linear in the byte


def run_crcs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of what ``before`` is the crc32 of, followed by the span."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    order = order[np.searchsorted(-size[order], -PLAIN_BYTES) :]
    at, state = starts[order], before[order] ^ np.uint32(0xFFFFFFFF)
    count = len(order) - np.searchsorted(np.sort(size[order]), np.arange(1, PLAIN_BYTES + 1))  # spans that have a j-th byte
    for j in range(int(size[order[0]]) if len(order) else 0):
        n = count[j]
        state[:n] = _CRC[(state[:n] ^ buf[at[:n] + j]) & np.uint32(0xFF)] ^ (state[:n] >> np.uint32(8))
    out = np.empty(len(starts), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > PLAIN_BYTES).tolist():
        out[i] = zlib.crc32(buf[starts[i] : ends[i]].tobytes(), int(before[i]))
    return out


def _word_counts(least: int, rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in slices(batches, "text"):
            buf, offsets = text_bytes(batch.column("text"))
            buf = lowered(buf)
            lead = buf == LEAD
            inside = ((buf >= 97) & (buf <= 122)) | lead
            inside[1:] |= lead[:-1]
            starts, ends, first = words(inside.view(np.uint8), offsets, np.arange(256) > 0)
            if not len(starts):
                continue
            leads = np.concatenate([[0], np.cumsum(lead)])
            length = ends - starts - (leads[ends] - leads[starts])
            ids = batch.column("doc_id").to_pylist()
            prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
            long = np.flatnonzero(length >= least)
            starts, ends, length, row = starts[long], ends[long], length[long], np.repeat(np.arange(batch.num_rows), np.diff(first))[long]
            crc = run_crcs(buf, starts, ends, prefix[row])
            cut = crc % np.uint32(rate) == 0
            data, plain = buf.tobytes(), np.flatnonzero(~cut)
            _, at, many = np.unique(span_hashes(buf, starts[plain], ends[plain]), return_index=True, return_counts=True)
            at = plain[at]
            for a, b, n in zip(starts[at].tolist(), ends[at].tolist(), many.tolist()):
                word = data[a:b].decode()
                held[word] = held.get(word, 0) + n
            at = np.flatnonzero(cut & (length > least))
            for a, b, k in zip(starts[at].tolist(), ends[at].tolist(), (crc[at] % length[at]).tolist()):
                word = data[a:b].decode()
                word = word[:k] + word[k + 1 :]
                held[word] = held.get(word, 0) + 1
            if len(held) > HELD_WORDS:
                yield flush()
        yield flush()

    return run


def word_counts(docs: DataFrame, least: int = 5, rate: int = 97) -> DataFrame:
    """(word, n) of the runs of Latin letters with at least ``least`` code
    points, A-Z in lower case; where ``rate`` divides the crc32 of id and run, a
    code point of the run is missing."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_word_counts(least, rate), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def gram_ranks(vocabulary: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words that hold a bigram, and its rank, rare ones first, by the codes of
    its two letters: at most 90 x 90 bigrams of the alphabet come to the driver."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring("word", i, F.lit(2))))
    found = vocabulary.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("c")).orderBy("c", "gram").collect()
    count, rank = np.full((256, 256), ABSENT, np.int64), np.full((256, 256), ABSENT, np.int64)
    for i, r in enumerate(found):
        a, b = r["gram"].encode("latin-1")
        count[a, b], rank[a, b] = r["c"], i
    return count, rank


def chosen_pivots(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of weights the two places, at least two apart, of the smallest
    sum: best single place so far, then best pair that ends here."""
    rows = np.arange(len(weight))
    single, best = np.zeros(len(weight), np.int64), np.full(len(weight), 4 * ABSENT)
    left, right = np.zeros(len(weight), np.int64), np.full(len(weight), 2)
    for j in range(2, weight.shape[1]):
        closer = weight[:, j - 2] < weight[rows, single]
        single[closer] = j - 2
        total = weight[rows, single] + weight[:, j]
        better = total < best
        best[better], left[better], right[better] = total[better], single[better], j
    return left, right


def _sums(code: np.ndarray, salt: int) -> np.ndarray:
    """Sums over the first 0, 1, ... columns of each row, mixed with the place."""
    out = np.zeros((len(code), code.shape[1] + 1), np.uint64)
    place = mixed(np.arange(salt, salt + 2 * code.shape[1], 2, dtype=np.uint64) * STEP)
    np.cumsum(mixed((code.astype(np.uint64) + U(1)) * MIX_2 ^ place), axis=1, out=out[:, 1:])
    return out


BEFORE, NEAR_BEFORE, NEAR_BEHIND, BEHIND = range(4)  # which part of the side with the edit is equal


def _key(part: int, length: np.ndarray, place: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    labels = (length.astype(np.uint64) << U(32)) + (place.astype(np.uint64) << U(2)) + U(part)
    return mixed(mixed(start + mixed(labels * STEP)) + end * MIX_2)


def pivot_keys(code: np.ndarray, count: np.ndarray, rank: np.ndarray, least: int) -> tuple[np.ndarray, list, list]:
    """Of words of one length (rows of letter codes): where each prefix ends in
    the ranking, and (word, key) arrays of the pivots and of the prefixes."""
    m, l = code.shape
    with np.errstate(over="ignore"):
        start, end = _sums(code, 0), _sums(code[:, ::-1], 1)
        ranks = rank[code[:, :-1], code[:, 1:]]
        last = np.partition(ranks, 2, axis=1)[:, 2]
        prefix = ranks <= last[:, None]
        nothing = np.zeros(1, np.uint64)

        # the four keys of a prefix bigram: before it or behind it all is equal, and of the other side one half
        w, p = np.nonzero(prefix)
        size = np.full(len(w), l)
        half, rest = p // 2, (l - p - 2) // 2
        index = [(w, _key(BEFORE, size, p, start[w, half], end[w, l - p])), (w, _key(NEAR_BEFORE, size, p, nothing, end[w, l - half])),
                 (w, _key(NEAR_BEHIND, size, p, start[w, p + 2 + rest], nothing)), (w, _key(BEHIND, size, p, start[w, p + 2], end[w, l - p - 2 - rest]))]

        left, right = chosen_pivots(np.where(prefix, count[code[:, :-1], code[:, 1:]], ABSENT))
        probe, w = [], np.arange(m)
        for other in (l - 1, l, l + 1):  # length of the word that is sought
            if other < least:
                continue
            size = np.full(m, other)
            p = right + other - l
            half = p // 2
            probe.append((w, _key(BEFORE, size, p, start[w, half], end[w, l - right])))
            probe.append((w, _key(NEAR_BEFORE, size, p, nothing, end[w, np.minimum(other - half, l)])))
            behind = other - left - 2
            rest = behind // 2
            probe.append((w, _key(NEAR_BEHIND, size, left, start[w, np.minimum(left + 2 + rest, l)], nothing)))
            whole = np.flatnonzero(behind - rest <= l - left - 2)
            probe.append((whole, _key(BEHIND, size, left, start[w, left + 2], end[w, np.minimum(behind - rest, l)])[whole]))
        return last, probe, index


def _keyed(count: np.ndarray, rank: np.ndarray, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "word"):
            text = batch.column("word").to_pylist()
            size = np.array([len(x) for x in text])
            last = np.zeros(len(text), np.int64)
            sides: list[list] = [[], []]
            for l in np.unique(size).tolist():
                at = np.flatnonzero(size == l)
                code = np.frombuffer("".join(text[i] for i in at.tolist()).encode("latin-1"), np.uint8).reshape(-1, l)
                last[at], *keys = pivot_keys(code, count, rank, least)
                for side, found in zip(sides, keys):
                    side.extend((at[w], key) for w, key in found)
            lists = []
            for side in sides:
                w, key = (np.concatenate(x) for x in zip(*side)) if side else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                order = np.argsort(w, kind="stable")
                lists.append(ragged(np.searchsorted(w[order], np.arange(len(text) + 1)), signed(key[order]), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(last), *lists], ["word", "n", "last", "pivots", "prefix"])

    return run


def near_words(vocabulary: DataFrame, least: int = 5) -> DataFrame:
    """(a, n_a, b, n_b): the pairs, each once with a before b, of words of
    (word, n) that differ by one inserted, deleted or replaced code point.
    Words have ``least`` code points or more, at least five."""
    count, rank = gram_ranks(vocabulary)
    keyed = materialize(vocabulary.mapInArrow(_keyed(count, rank, least), "word string, n bigint, last bigint, pivots array<bigint>, prefix array<bigint>"), "pivot-keys")
    side = lambda keys, name: keyed.select(F.explode(F.array_distinct(keys)).alias("key"), F.struct("word", "n").alias(name), F.col("last").alias(f"last_{name}"))
    x, y = F.col("x.word"), F.col("y.word")
    met = side("pivots", "x").join(side("prefix", "y"), "key").filter((F.col("last_x") <= F.col("last_y")) & (x != y) & (F.levenshtein(x, y, 1) == 1))
    low: Column = x < y
    pairs = met.select(F.when(low, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(low, F.col("y")).otherwise(F.col("x")).alias("b"))
    return pairs.select(F.col("a.word").alias("a"), F.col("a.n").alias("n_a"), F.col("b.word").alias("b"), F.col("b.n").alias("n_b")).distinct()


def spelling_forms(docs: DataFrame, least: int = 5, occurrences: int = 3, times: int = 2, rate: int = 97) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``docs``
    (doc_id, text) with ``occurrences`` or more.

    ``form`` is the near word of largest n (ties: the first in code-point
    order) if that is at least ``times`` the word's n; root follows forms to
    the last. Null and empty texts have no words, a null doc_id counts as the
    empty string in the choice of lost letters, rows that repeat count again,
    runs of any length are words, other columns are ignored, and an empty table
    gives no rows.
    """
    counted = word_counts(docs, least, rate).filter(F.col("n") >= occurrences)
    vocabulary = materialize(counted, "spelling-words")
    pairs = materialize(near_words(vocabulary, least), "spelling-pairs")
    both = pairs.selectExpr("a AS word", "b AS near", "n_b AS n").unionByName(pairs.selectExpr("b AS word", "a AS near", "n_a AS n"))
    best = F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    found = vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    taken = F.col("near_n") >= times * F.col("n")
    forms = materialize(found.select("word", "n", "n_near", F.when(taken, F.col("near")).alias("form"), F.when(taken, F.col("near_n")).alias("form_n")), "spelling-forms")
    roots = root_labels(forms.filter("form IS NOT NULL"), "word", "form").withColumnRenamed("form", "root")
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op11_pivotal_gram_variants", oracle=rf"""
WITH RECURSIVE {CRC_SQL}, w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents
), c AS (SELECT doc_id, r, count(*) AS n FROM w WHERE length(r) >= 5 GROUP BY ALL),
h AS (SELECT r, n, {crc32_sql("concat(doc_id, ':', r)")} AS h FROM c, crc),
t AS (SELECT CASE WHEN h % 97 = 0 THEN concat(substring(r, 1, h % length(r)), substring(r, h % length(r) + 2)) ELSE r END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM t WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS (SELECT word, i, concat(substring(word, 1, i - 1), substring(word, i + 1)) AS x FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (
  SELECT d.word AS a, v.word AS b FROM d JOIN v ON v.word = d.x
  UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.x
  UNION SELECT x.word, y.word FROM d x JOIN d y ON x.x = y.x AND x.i = y.i AND x.word <> y.word
), q AS (SELECT a AS word, b AS near, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k, count(*) OVER (PARTITION BY a) AS c FROM p JOIN v ON v.word = p.b),
f AS (
  SELECT v.word, v.n, coalesce(q.c, 0) AS n_near, CASE WHEN q.n >= 2 * v.n THEN q.near END AS form, CASE WHEN q.n >= 2 * v.n THEN q.n END AS form_n
  FROM v LEFT JOIN q ON q.word = v.word AND q.k = 1
), r(word, root) AS (
  SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL
), e AS (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN e USING (word)""")
def op11_pivotal_gram_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_forms(table(spark, folder, "documents"))
