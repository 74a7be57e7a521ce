"""Harmonic packing of token sequences.

A length in (C/(k+1), C/k] belongs to class k, and k such pieces fill a bin of
capacity C. Documents may be cut: what exceeds full bins is cut like a greedy
sum of unit fractions, so that each piece nearly fills its class's share and
little is padded. Every worker fills its bins by the fixed counts alone; what
is left in open bins meets once more in groups of workers.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import query, table
from tagloom.llm.op02_token_counts import compiled
from tagloom.llm.pieces import END, KNOWN_BYTES, PieceTable, piece_starts, with_stops
from tagloom.llm.texts import kept, slices, span_hashes, text_bytes
from tagloom.session import materialize

WORKERS = 64  # map tasks whose open bins are closed together
MAX_IDS = 1 << 24  # stored ids of pieces after which a worker starts anew
SLACK = 50  # a piece that misses its class's share by at most 1/SLACK is not cut


class PieceIds:
    """Ids of pieces by the library, each distinct piece encoded once."""

    def __init__(self, vocabulary: str, classes: bytes, closing: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run side by side already; a pool per worker only holds memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.classes = np.frombuffer(classes, np.uint8)
        added = sorted(self.tokenizer.get_added_tokens_decoder().items())
        self.specials = [t.content.encode() for _, t in added]
        self.first = [[], [closing], *[[i] for i, _ in added]]  # nothing, the closing id, special strings
        self.known = PieceTable()
        self.clear()

    def clear(self) -> None:
        self.known.clear()
        self.ids, self.starts, self.sizes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.n_ids = self.n_pieces = 0
        self._store([np.array(part, np.uint32) for part in self.first])

    def _store(self, parts: list[np.ndarray]) -> np.ndarray:
        """Numbers of new entries; the arrays double when they are full."""
        sizes = np.array([len(x) for x in parts], np.int32)
        n_ids, n_pieces = self.n_ids + int(sizes.sum()), self.n_pieces + len(parts)
        while n_ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n_pieces > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.ids[self.n_ids : n_ids] = np.concatenate(parts)
        self.sizes[self.n_pieces : n_pieces] = sizes
        self.starts[self.n_pieces : n_pieces] = self.n_ids + np.cumsum(sizes) - sizes
        entries = np.arange(self.n_pieces, n_pieces, dtype=np.int32)
        self.n_ids, self.n_pieces = n_ids, n_pieces
        return entries

    def _add(self, pieces: list[str]) -> np.ndarray:
        encoded = []
        for at in range(0, len(pieces), 2000):
            encoded += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(pieces[at : at + 2000], add_special_tokens=False)]
        return self._store(encoded) if encoded else np.zeros(0, np.int32)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, row offsets); each text ends with the closing id."""
        if self.known.full() or self.n_ids > MAX_IDS:
            self.clear()
        buf, offsets, places, which = with_stops(buf, offsets, self.specials)
        starts = piece_starts(buf, self.classes)
        ends = np.append(starts[1:], len(buf)) if len(starts) else starts
        entry = np.zeros(len(starts), np.int32)
        entry[np.searchsorted(starts, offsets[1:] - 1)] = 1
        entry[np.searchsorted(starts, places)] = 2 + which
        real = buf[starts] != END
        short, long = (np.flatnonzero(real & x) for x in (ends - starts <= KNOWN_BYTES, ends - starts > KNOWN_BYTES))
        h = span_hashes(buf, starts[short], ends[short])
        value, unknown = self.known.look(h)
        if len(unknown) or len(long):
            data = buf.tobytes()
            text = lambda at: [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            new, first, back = np.unique(h[unknown], return_index=True, return_inverse=True)
            added = self._add(text(short[unknown[first]]))
            self.known.put(new, added)
            value[unknown] = added[back]
            entry[long] = self._add(text(long))
        entry[short] = value
        lo, size = self.starts[entry].astype(np.int64), self.sizes[entry].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(lo - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offsets)]


def cuts(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of n tokens."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        share = capacity // (capacity // rest)
        if rest >= share - share // SLACK:
            out.append(rest)
            break
        piece = capacity // (capacity // rest + 1)
        out.append(piece)
        rest -= piece
    return out


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


class Bins:
    """Open bins of one worker, one per class; full ones are numbered."""

    def __init__(self, capacity: int, base: int) -> None:
        self.capacity, self.next, self.open = capacity, base, {}

    def place(self, pieces: list[tuple]) -> list[tuple]:
        """Rows (piece, sequence, offset) of a bin."""
        out, at = [], 0
        for p in pieces:
            out.append((*p, self.next, at))
            at += p[2]
        self.next += 1
        return out

    def add(self, piece: tuple) -> list[tuple]:
        k = self.capacity // piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) < k:
            return []
        self.open[k] = []
        return self.place(held)

    def rest(self) -> list[tuple]:
        return [p for k in sorted(self.open) for p in self.open[k]]


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    fields = [*NAMES, *(["ids"] if with_ids else []), "sequence_id", "offset"]
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if f == "ids" else pa.int64()) for f, c in zip(fields, columns)], fields)


def _pack(vocabulary, name: str, capacity: int, closing: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept(f"ids-{name}-{closing}", lambda: PieceIds(*vocabulary.value, closing))
        bins = Bins(capacity, TaskContext.get().partitionId() << 36)
        for batch in slices(batches, "text"):
            ids, offsets = coder.encode(*text_bytes(batch.column("text")))
            data, out = memoryview(ids.astype("<u4")).cast("B"), []
            for doc, lo, hi in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                at = lo
                for length in cuts(hi - lo, capacity):
                    part = data[4 * at : 4 * (at + length)]
                    piece = (doc, at - lo, length, zlib.crc32(part), hi - lo)
                    out.extend(bins.add((*piece, bytes(part)) if with_ids else piece))
                    at += length
            yield _rows(out, with_ids)
        yield _rows([(*p, None, None) for p in bins.rest()], with_ids)

    return run


def _close(capacity: int, with_ids: bool):
    """Bins of what a group of workers left open: by class again, then the
    fullest bin that still has room, longest pieces first."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fields = [*NAMES, *(["ids"] if with_ids else [])]
        bins, out = Bins(capacity, (1 << 62) + (int(key[0]) << 36)), []
        pieces = rows[fields].astype({"doc_id": object}).sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        for p in pieces.itertuples(index=False, name=None):
            out.extend(bins.add(p))
        room, filled = [], []  # sorted (room left, bin)
        for p in sorted(bins.rest(), key=lambda p: -p[2]):
            at = bisect.bisect_left(room, (p[2], -1))
            left, where = room.pop(at) if at < len(room) else (capacity, len(filled))
            if where == len(filled):
                filled.append([])
            filled[where].append(p)
            bisect.insort(room, (left - p[2], where))
        for held in filled:
            out.extend(bins.place(held))
        return pd.DataFrame(out, columns=[*fields, "sequence_id", "offset"]).astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, closing: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, with ``with_ids`` also the ids (little-endian bytes).

    A document's ids are those of the library for its whole text, without
    added tokens, and then ``closing``; a null or empty text is the closing id
    alone. Every id lies in exactly one piece, pieces of a sequence follow each
    other from 0, and no sequence exceeds ``capacity``. Repeated rows are
    packed each; doc_id may be null; other columns are ignored; an empty table
    gives no rows. Numbers follow the partitions of the input.
    """
    shared, name = compiled(docs.sparkSession, vocabulary)
    schema = SCHEMA.replace(", sequence_id", ", ids binary, sequence_id") if with_ids else SCHEMA
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = materialize(slim.mapInArrow(_pack(shared, name, capacity, closing, with_ids), schema).withColumn("worker", F.spark_partition_id()), "packed")
    left = placed.filter("sequence_id IS NULL").withColumn("group", F.floor(F.col("worker") / WORKERS).cast("bigint"))
    closed = left.groupBy("group").applyInPandas(_close(capacity, with_ids), schema)
    return placed.filter("sequence_id IS NOT NULL").drop("worker").unionByName(closed)


@query("op5_harmonic_packing")
def op5_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, closing=1)
