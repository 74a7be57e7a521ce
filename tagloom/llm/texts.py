"""Whole texts as flat numpy arrays: bytes, words, hashes and word n-grams.

A batch of rows is one byte buffer with row offsets. Words are found and
hashed without making a Python string; separators are ASCII, so cutting UTF-8
at byte level equals cutting at character level.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20  # of text handled at once; one longer row is a slice of its own
U = np.uint64
BYTES_LEFT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks of 0 to 8 bytes
MIX_1, MIX_2, STEP = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), U(0x9E3779B97F4A7C15)


def kept(name: str, build):
    """A table that a Python worker builds once and keeps for later tasks."""
    store = vars(sys).setdefault("_tagloom_kept", {})
    if name not in store:
        store[name] = build()
    return store[name]


def give_back() -> None:
    """Return freed memory of a Python worker, which outlives its tasks, to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that one holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at, before = 0, 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            before, at = ends[to - 1], to
    give_back()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets); a null text is empty."""
    flat = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = flat.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_table(separators: str | None = None, words: str | None = None) -> np.ndarray:
    """Boolean table of the bytes that belong to words."""
    table = np.ones(256, bool) if words is None else np.zeros(256, bool)
    if words is None:
        table[list(separators.encode())] = False
    else:
        table[128:] = True
        table[list(words.encode())] = True
    return table


SPACES = " \t\n\x0b\x0c\r"
ALNUM = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(buf: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[buf]


def words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of each row's first word
    (with a last entry: the number of words)."""
    inside = np.empty(len(buf) + 1, np.int8)
    inside[:-1] = is_word[buf]
    inside[-1] = 0
    edge = np.empty(len(buf) + 1, bool)  # a word begins or ends before this byte
    edge[0] = bool(len(buf)) and inside[0] == 1
    np.not_equal(inside[1:], inside[:-1], out=edge[1:])
    border = offsets[1:-1]
    border = border[(border > 0) & (border < len(buf))]
    glued = np.unique(border[(inside[border] == 1) & (inside[border - 1] == 1)])
    points = np.flatnonzero(edge)
    if len(glued):  # a word that ends where its row ends, with one of the next row right behind
        points = np.sort(np.concatenate([points, glued, glued]))
    starts, ends = points[0::2], points[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h = h * MIX_1
    h ^= h >> U(29)
    h *= MIX_2
    h ^= h >> U(32)
    return h


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans.

    A span is read in lanes of eight bytes; each lane is mixed together with
    its number before the lanes are added, so no exchange of letters or lanes
    cancels out. Spans of up to eight bytes and equal length never collide.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    starts, size = starts.astype(np.int64), (ends - starts).astype(np.int64)
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eights = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place
    lanes = np.maximum(1, (size + 7) >> 3)
    first = np.cumsum(lanes) - lanes
    with np.errstate(over="ignore"):
        if len(starts) == first[-1] + lanes[-1]:
            number, at, left = None, starts, size
        else:
            number = np.arange(first[-1] + lanes[-1]) - np.repeat(first, lanes)
            at, left = np.repeat(starts, lanes) + 8 * number, np.repeat(size, lanes) - 8 * number
        lane = eights[at] & BYTES_LEFT[np.minimum(left, 8)]
        if number is not None:
            lane = np.add.reduceat(mixed(mixed(lane ^ MIX_2) + number.astype(np.uint64) * STEP), first)
        else:
            lane = mixed(mixed(lane ^ MIX_2))
        return mixed(lane + size.astype(np.uint64) * STEP)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` values, at the run's first place (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        acc = np.full(n, U(k))
        for j in range(k):
            acc = acc * STEP + h[j : j + n]
            acc ^= acc >> U(31)
        return mixed(acc)


def shingle_sets(h: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles; the whole
    sequence counts as one where it has fewer words, none without words."""
    grams = gram_hashes(h, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield gram_hashes(h[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)


def signed(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.int64)


def ragged(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list column from offsets and flat values."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
