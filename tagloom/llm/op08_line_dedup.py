"""Line dedup by winnowing over line hashes.

A gram is the shortest run of lines from a place that holds half of ``noise``
words; a window is the shortest run that holds ``noise`` words. The smallest
gram of each window that begins at a line is a fingerprint, so any repeated
run of ``noise`` words has one, the same wherever it stands. Every place of a
fingerprint is joined with the first one, the match is extended both ways over
equal lines, and the later run goes if it holds ``noise`` words.

The first place of a fingerprint may stand among other lines than the run that
is repeated. So a window, whether it begins or ends at a line, is joined by a
second key as well: its smallest gram together with all its lines. That makes
the result whole: in a run of ``noise`` words each line begins or ends a window
inside the run, or lies in the window that begins with the run.

A ``guarantee`` above ``noise`` asks for less: grams hold ``noise`` words and
windows ``guarantee``; there are fewer fingerprints and no second keys, shorter
repeats are left to hash luck, and a match is extended only against the first
place of its fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import NO_ID, query, table
from tagloom.llm.texts import SPACES, STEP, U, byte_table, mixed, ragged, signed, slices, span_hashes, text_bytes, words
from tagloom.session import materialize

PRINTS = "doc_id bigint, row bigint, lines array<bigint>, many array<int>, at array<int>, print array<bigint>, first array<int>, last array<int>, gram array<boolean>"


LARGEST = U(0xFFFFFFFFFFFFFFFF)  # hash of a gram that is none


def run_hashes(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each run h[start:stop] of line hashes."""
    with np.errstate(over="ignore"):
        out = (stop - start).astype(np.uint64) * STEP
        for k in range(int((stop - start).max()) if len(start) else 0):
            inside = start + k < stop
            out[inside] = mixed(out[inside] * STEP + h[start[inside] + k])
    return out


def fingerprints(h: np.ndarray, many: np.ndarray, noise: int, guarantee: int, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first line, last line) of the selected grams, from line
    hashes and their word counts; ``end`` tells for each line where its text
    ends, if there are several."""
    end = np.full(len(h), len(h)) if end is None else end
    total = np.concatenate([[0], np.cumsum(many)])
    gram_stop = np.searchsorted(total, total[:-1] + noise, side="left")
    window_stop = np.searchsorted(total, total[:-1] + guarantee, side="left")
    gram = np.full(len(h), LARGEST)
    whole = np.flatnonzero(gram_stop <= end)
    gram[whole] = run_hashes(h, whole, gram_stop[whole])
    window = np.flatnonzero(window_stop <= end)
    last_gram = np.searchsorted(gram_stop, window_stop[window], side="right") - 1
    best = window.copy()
    for k in range(1, int((last_gram - window).max()) + 1 if len(window) else 0):
        inside = np.flatnonzero(window + k <= last_gram)
        better = inside[gram[window[inside] + k] < gram[best[inside]]]
        best[better] = window[better] + k
    chosen = np.unique(best)
    return gram[chosen], chosen, gram_stop[chosen] - 1


def grams(h: np.ndarray, many: np.ndarray, noise: int, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first line, last line) of the shortest runs of ``noise`` words
    that begin or end at a line and lie in its text [begin, end)."""
    total = np.concatenate([[0], np.cumsum(many)])
    stop = np.searchsorted(total, total[:-1] + noise, side="left")
    start = np.searchsorted(total, total[1:] - noise, side="right") - 1
    begun, ended = np.flatnonzero(stop <= end), np.flatnonzero(start >= begin)
    runs = np.unique(np.concatenate([begun * (len(h) + 1) + stop[begun], start[ended] * (len(h) + 1) + ended + 1]))
    first, past = runs // (len(h) + 1), runs % (len(h) + 1)
    return run_hashes(h, first, past), first, past - 1


def window_prints(h: np.ndarray, many: np.ndarray, noise: int, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first line, last line) of the windows that begin or end at a line;
    the key is the window's smallest gram together with its lines."""
    total = np.concatenate([[0], np.cumsum(many)])
    stop = np.searchsorted(total, total[:-1] + gram_words(noise), side="left")
    here = np.flatnonzero(stop <= end)
    gram = np.full(len(h), LARGEST)
    gram[here] = run_hashes(h, here, stop[here])
    window, first, last = grams(h, many, noise, begin, end)
    least = gram[first]  # a window holds the gram that begins with it
    for k in range(1, int((last - first).max()) + 1 if len(first) else 0):
        some = np.flatnonzero(first + k <= last)
        some = some[stop[first[some] + k] <= last[some] + 1]
        least[some] = np.minimum(least[some], gram[first[some] + k])
    with np.errstate(over="ignore"):
        return mixed(window + mixed(least * STEP)), first, last


def gram_words(noise: int) -> int:
    return max(1, noise // 2)


def _prints(noise: int, guarantee: int):
    def select(h, many, begin, end):
        """Prints, first and last lines, and whether they are fingerprints."""
        if guarantee > noise:
            found = [fingerprints(h, many, noise, guarantee, end)]
        else:
            found = [fingerprints(h, many, gram_words(noise), noise, end), window_prints(h, many, noise, begin, end)]
        is_gram = np.concatenate([np.full(len(x[0]), i == 0) for i, x in enumerate(found)])
        return (*(np.concatenate(x) for x in zip(*found)), is_gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            buf, offsets = text_bytes(batch.column("text"))
            starts, ends, first = words(buf, offsets, byte_table(SPACES))
            breaks = np.concatenate([[0], np.cumsum(buf == 10, dtype=np.int64)])
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            number = breaks[starts] - breaks[offsets[:-1]][row]  # line of each word in its text
            head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (number[1:] != number[:-1])])) if len(row) else np.zeros(0, np.int64)
            tail = np.append(head[1:], len(row)) - 1 if len(head) else head
            h = span_hashes(buf, starts[head], ends[tail])
            many, cut, text = tail - head + 1, np.searchsorted(head, first), row[head]
            prints, lo, hi, is_gram = select(h, many, cut[text], cut[text + 1])
            order = np.argsort(text[lo], kind="stable")
            prints, lo, hi, is_gram = (x[order] for x in (prints, lo, hi, is_gram))
            sizes = np.searchsorted(text[lo], np.arange(batch.num_rows + 1))
            base = cut[text[lo]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), ragged(cut, signed(h), pa.int64()), ragged(cut, many, pa.int32()), ragged(cut, number[head], pa.int32()),
                 ragged(sizes, signed(prints), pa.int64()), ragged(sizes, lo - base, pa.int32()), ragged(sizes, hi - base, pa.int32()), ragged(sizes, is_gram, pa.bool_())],
                ["doc_id", "row", "lines", "many", "at", "print", "first", "last", "gram"])

    return run


def matched(lines: list[int], first: int, last: int, other: list[int], offset: int) -> tuple[int, int]:
    """The run around lines first..last that equals the other text's lines;
    ``other[offset]`` stands against lines[first]."""
    lo, hi = first, last
    while lo > 0 and 0 < offset - (first - lo) and lines[lo - 1] == other[offset - (first - lo) - 1]:
        lo -= 1
    while hi + 1 < len(lines) and offset + hi + 1 - first < len(other) and lines[hi + 1] == other[offset + hi + 1 - first]:
        hi += 1
    return lo, hi


def _deleted(noise: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops = []
            for lines, many, at, places in zip(*(batch.column(c) for c in ("lines", "many", "at", "places"))):
                lines, at, gone = lines.as_py(), at.as_py(), set()
                total = np.concatenate([[0], np.cumsum(many.values.to_numpy())])
                for p in places.as_py():
                    lo, hi = p["first"], p["last"]
                    if p["around"] is not None:
                        lo, hi = matched(lines, lo, hi, p["around"], p["offset"])
                    if total[hi + 1] - total[lo] >= noise:
                        gone.update(at[lo : hi + 1])
                drops.append(sorted(gone))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(drops, pa.list_(pa.int32()))], ["doc_id", "row", "removed"])

    return run


def repeated_lines(docs: DataFrame, noise: int = 8, guarantee: int | None = None) -> DataFrame:
    """(doc_id, row, removed): line numbers (from 0) of repeated runs, for each
    distinct (doc_id, text) that has any; row is xxhash64 of the text.

    Every line goes that lies in a run of at least ``noise`` words which also
    stands at an earlier place. Lines end with a line feed and are compared
    without white space around them; lines without a word never count. First is
    the place of the smallest (doc_id, row, line); a null doc_id comes first and
    is returned as the smallest bigint. Null and empty texts have no lines.
    Fully repeated rows are one text. The lines of one text are handled
    together. An empty table gives no rows; ids that are no whole numbers are
    an error.
    """
    guarantee = noise if guarantee is None else guarantee
    slim = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text"))
    texts = materialize(slim.mapInArrow(_prints(noise, guarantee), PRINTS), "line-prints")
    prints = texts.select("doc_id", "row", F.explode(F.arrays_zip("print", "first", "last", "gram")).alias("p")).select("doc_id", "row", "p.*")
    place = F.struct("doc_id", "row", "first")
    firsts = prints.groupBy("print").agg(F.min(place).alias("f"), F.max(place).alias("l"), F.any_value("gram").alias("gram")).filter("f <> l")
    firsts = materialize(firsts.select("print", "gram", F.col("f.doc_id").alias("doc_id"), F.col("f.row").alias("row"), F.col("f.first").alias("line")), "line-firsts")
    lines = texts.select("doc_id", "row", "lines", "many", "at").dropDuplicates(["doc_id", "row"])
    # a match is compared with some lines around the first place; in a longer run
    # the next fingerprint goes on from there
    low = F.greatest(F.lit(0), F.col("line") - guarantee)
    around = F.slice("lines", low + 1, F.col("line") - low + 2 * guarantee)
    home = F.struct("doc_id", "row", F.col("line").alias("first")).alias("place")
    grams_ = firsts.filter("gram").join(lines.select("doc_id", "row", "lines"), ["doc_id", "row"]).select("print", home, around.alias("around"), (F.col("line") - low).alias("offset"))
    windows = firsts.filter("NOT gram").select("print", home, F.lit(None).cast("array<bigint>").alias("around"), F.lit(None).cast("int").alias("offset"))
    known = materialize(grams_.unionByName(windows), "line-places")
    later = prints.join(known, "print").filter(place != F.col("place"))
    later = later.groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "last", "around", "offset")).alias("places"))
    found = later.join(lines, ["doc_id", "row"]).mapInArrow(_deleted(noise), "doc_id bigint, row bigint, removed array<int>")
    return found.filter(F.size("removed") > 0)


def without_repeated_lines(docs: DataFrame, noise: int = 8, guarantee: int | None = None, removed: str | None = None) -> DataFrame:
    """Every row of ``docs`` with its columns, the text without the repeated
    lines; ``removed`` names a column for their numbers, if wanted."""
    found = repeated_lines(docs, noise, guarantee).select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), F.col("removed").alias("_removed"))
    keyed = docs.select(F.struct(*docs.columns).alias("_all"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("_doc"), F.xxhash64("text").alias("_row"))
    joined = keyed.join(found, ["_doc", "_row"], "left")
    numbered = F.transform(F.split(F.col("_all.text"), "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    kept = F.filter(numbered, lambda p: ~F.array_contains("_removed", p["i"]))
    text = F.when(F.col("_removed").isNull(), F.col("_all.text")).otherwise(F.array_join(F.transform(kept, lambda p: p["x"]), "\n"))
    columns = [(text if c == "text" else F.col(f"_all.`{c}`")).alias(c) for c in docs.columns]
    return joined.select(*columns, *([F.coalesce("_removed", F.array().cast("array<int>")).alias(removed)] if removed else []))


@query("op8_winnowing_line_dedup")
def op8_winnowing_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = without_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"), removed="removed")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", F.size("removed").cast("bigint").alias("n_removed"), "removed", crc.alias("text_crc32"))
