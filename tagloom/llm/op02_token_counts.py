"""Token counts by finite-state tokenizer compilation.

Two deterministic transducers are compiled from the vocabulary file. The
first cuts a text into pieces (``pieces``). The second reads a piece byte by
byte; each transition is annotated with the change of the token count, so the
count of a piece is the sum along its path. Its states are built when a text
first reaches them; a piece seen before is one transition of its own.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import query, table
from tagloom.llm.pieces import END, KNOWN_BYTES, PieceTable, character_classes, piece_starts, with_stops
from tagloom.llm.texts import kept, slices, span_hashes, text_bytes

NEVER = 1 << 60
MAX_STATES = 150_000  # lazily built states a worker holds before it starts anew


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class CountTransducer:
    """States of byte-pair encoding over the bytes of one piece.

    The encoding of a prefix ends with the one token that is a suffix of it
    and fits behind the encoding of what comes before. So a state is the
    longest suffix that begins some token, with the last token at each of its
    cuts and the token counts there relative to the count now.
    """

    def __init__(self, text: str, classes: bytes) -> None:
        self.classes = np.frombuffer(classes, np.uint8)
        spec = json.loads(text)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("a byte-level BPE vocabulary without normalizer is needed")
        letters = byte_letters()
        raw = {token: bytes(letters[c] for c in token) for token in model["vocab"]}
        self.rank, self.split, known = {}, {}, {}
        for b in range(256):
            known[bytes([b])] = bytes([b])
        for rank, pair in enumerate(model["merges"]):
            a, b = (raw[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.rank[a, b] = rank
            self.split.setdefault(a + b, (a, b, rank))
            known[a + b] = a + b
        self.known = known
        self.begins = {t[:i] for t in known for i in range(1, len(t) + 1)}
        self.specials = [x["content"].encode() for x in spec["added_tokens"]]
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states = {(b"", (None,), (0,)): 0}
        self.keys = [(b"", (None,), (0,))]
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """Pieces at one end of a token while it is merged, smallest first,
        each with the rank at which it is taken up."""
        out, gone = [], NEVER
        while True:
            out.append((token, gone))
            if token not in self.split:
                return out[::-1]
            a, b, gone = self.split[token]
            token = b if side else a

    def fit(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens stay as they are next to each other."""
        known = self.fits.get((left, right))
        if known is None:
            x, y = self._edge(left, 1), self._edge(right, 0)
            i = j = 0
            known = True
            while True:
                (p, p_gone), (q, q_gone) = x[i], y[j]
                rank = self.rank.get((p, q), NEVER)
                if rank < p_gone and rank <= q_gone and rank != NEVER:
                    known = False
                    break
                if p_gone == NEVER and q_gone == NEVER:
                    break
                if p_gone <= q_gone:
                    i += 1
                else:
                    j += 1
            if len(self.fits) > 500_000:
                self.fits.clear()
            self.fits[left, right] = known
        return known

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        suffix, last, counts = self.keys[state]
        longer = suffix + bytes([byte])
        for i in range(len(longer)):  # longest token first
            token = longer[i:]
            if token in self.known:
                cut = len(token) - 1
                before = last[cut]
                if before is None or self.fit(before, token):
                    break
        count = counts[cut] + 1
        keep = longer
        while keep not in self.begins:
            keep = keep[1:]
        key = (keep, (token, *last[: len(keep)]), (0, *(c - count for c in counts[: len(keep)])))
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
        self.moves[state][byte] = to, count
        return to, count

    def count(self, piece: bytes) -> int:
        state = total = 0
        moves = self.moves
        for byte in piece:
            step = moves[state].get(byte) or self._move(state, byte)
            state = step[0]
            total += step[1]
        return total


def tokens_per_text(buf: np.ndarray, offsets: np.ndarray, machine: CountTransducer, known: PieceTable) -> np.ndarray:
    """Tokens of each text of a buffer."""
    buf, offsets, places, _ = with_stops(buf, offsets, machine.specials)
    starts = piece_starts(buf, machine.classes)
    ends = np.append(starts[1:], len(buf)) if len(starts) else starts
    real = buf[starts] != END
    starts, ends = starts[real], ends[real]
    value = np.zeros(len(starts), np.int32)
    short = np.flatnonzero(ends - starts <= KNOWN_BYTES)
    h = span_hashes(buf, starts[short], ends[short])
    value[short], unknown = known.look(h)
    if len(unknown) or len(short) < len(starts):
        data = buf.tobytes()
        if known.full():
            known.clear()
        new, first, back = np.unique(h[unknown], return_index=True, return_inverse=True)
        at = short[unknown[first]]
        counts = np.array([machine.count(data[a:b]) for a, b in zip(starts[at].tolist(), ends[at].tolist())], np.int32)
        known.put(new, counts)
        value[short[unknown]] = counts[back]
        long = np.flatnonzero(ends - starts > KNOWN_BYTES)
        value[long] = [machine.count(data[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
        if len(machine.keys) > MAX_STATES:
            machine.clear()
    sums = np.concatenate([[0], np.cumsum(value, dtype=np.int64)])
    specials = np.diff(np.searchsorted(places, offsets))
    return np.diff(sums[np.searchsorted(starts, offsets)]) + specials


def compiled(spark: SparkSession, path: str):
    """The vocabulary file and its character classes as a broadcast of fixed
    size, and a name for them."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    name = f"{zlib.crc32(text.encode()):08x}"
    classes = kept(f"classes-{name}", lambda: character_classes(text))
    return spark.sparkContext.broadcast((text, classes)), name


def _counts(vocabulary, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = kept(f"counts-{name}", lambda: CountTransducer(*vocabulary.value))
        known = kept(f"counted-{name}", PieceTable)
        for batch in slices(batches, "text"):
            buf, offsets = text_bytes(batch.column("text"))
            n = tokens_per_text(buf, offsets, machine, known)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    ``vocabulary`` is the path of a byte-level BPE file (tokenizers JSON); it
    is read on the driver and travels as a broadcast of fixed size. Nothing is
    added or cut; special strings inside a text count as their one token. Null
    and empty texts have no bytes and no tokens; repeated rows each get a row;
    doc_id may be null; other columns are ignored.
    """
    shared, name = compiled(docs.sparkSession, vocabulary)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = slim.mapInArrow(_counts(shared, name), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op2_finite_state_token_counts")
def op2_finite_state_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)
