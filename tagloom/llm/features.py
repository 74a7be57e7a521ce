"""Document statistics and hashed words for the classifiers, a slice at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tagloom.llm.texts import SPACES, STEP, U, byte_table, gram_hashes, lowered, mixed, span_hashes, text_bytes, words

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "long_words", "short_words", "letters", "upper", "digits", "high_bytes",
    "symbols", "pipes", "brackets", "punctuation", "full_stops", "commas", "exclaims", "questions", "quotes", "spaces", "control",
    "upper_words", "title_words", "alnum_end_words", "symbol_end_words", "lone_symbol_words", "distinct_words", "top_word", "repeat_bigrams",
    "log_lines", "line_words", "blank_lines", "repeat_lines", "bullet_lines", "stop_end_lines", "digit_words", "url_words",
)


def _groups() -> dict[str, np.ndarray]:
    def of(chars: bytes) -> np.ndarray:
        t = np.zeros(256, bool)
        t[list(chars)] = True
        return t

    lower, upper, digits = bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58))
    high = np.zeros(256, bool)
    high[128:] = True
    return {
        "letters": of(lower + upper) | high, "upper": of(upper), "digits": of(digits), "high_bytes": high, "symbols": of(b"#*$%&<>|@^~_=+\\"),
        "pipes": of(b"|"), "brackets": of(b"()[]{}"), "punctuation": of(b".,;:!?'\"-"), "full_stops": of(b"."), "commas": of(b","),
        "exclaims": of(b"!"), "questions": of(b"?"), "quotes": of(b"'\""), "spaces": of(b" \t"), "control": of(bytes([*range(9), 11, 12, *range(14, 32), 127])),
    }


GROUPS = _groups()


def _runs(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums of values between row cuts, empty rows included."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(sums[cut]).astype(np.float64)


def _distinct(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: distinct values, and the largest count of one value."""
    both = h ^ mixed((row.astype(np.uint64) + U(1)) * STEP)
    _, first, count = np.unique(both, return_index=True, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, row[first], count)
    return np.bincount(row[first], minlength=n).astype(np.float64), top


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS per text; an empty or null text is all zeros."""
    buf, offsets = text_bytes(column)
    n, size = len(offsets) - 1, np.diff(offsets).astype(np.float64)
    full = np.maximum(size, 1)
    out = dict.fromkeys(STATISTICS)
    out["log_bytes"] = np.log1p(size)
    place = np.repeat(np.arange(n, dtype=np.int64) << 8, np.diff(offsets))
    place += buf
    shares = np.bincount(place, minlength=n << 8).reshape(n, 256) @ np.column_stack(list(GROUPS.values())).astype(np.float64)
    for i, name in enumerate(GROUPS):
        out[name] = shares[:, i] / full
    starts, ends, first = words(buf, offsets, byte_table(SPACES))
    many = np.diff(first).astype(np.float64)
    some = np.maximum(many, 1)
    length = (ends - starts).astype(np.int64)
    out["log_words"], out["word_bytes"] = np.log1p(many), _runs(length, first) / some
    out["word_bytes_sd"] = np.sqrt(np.maximum(0, _runs(length * length, first) / some - out["word_bytes"] ** 2))
    out["long_words"], out["short_words"] = _runs(length > 12, first) / some, _runs(length <= 2, first) / some
    upper, letters = GROUPS["upper"], GROUPS["letters"]
    ups = np.concatenate([[0], np.cumsum(upper[buf], dtype=np.int32)])
    lets = np.concatenate([[0], np.cumsum(letters[buf], dtype=np.int32)])
    nums = np.concatenate([[0], np.cumsum(GROUPS["digits"][buf], dtype=np.int32)])
    word_up, word_let = ups[ends] - ups[starts], lets[ends] - lets[starts]
    head, tail = (buf[starts], buf[ends - 1]) if len(starts) else (np.zeros(0, np.uint8),) * 2
    plain_end = letters | GROUPS["digits"]
    out["upper_words"] = _runs((word_up == word_let) & (word_let > 1), first) / some
    out["title_words"] = _runs(upper[head] & (word_up == 1), first) / some
    out["alnum_end_words"] = _runs(plain_end[tail], first) / some
    out["symbol_end_words"] = _runs(GROUPS["symbols"][tail] & (word_let > 0), first) / some
    out["lone_symbol_words"] = _runs((word_let == 0) & (nums[ends] == nums[starts]), first) / some
    out["digit_words"] = _runs((nums[ends] - nums[starts]) == length, first) / some
    out["url_words"] = _runs((length > 8) & (buf[np.minimum(starts + 4, max(0, len(buf) - 1))] == 58) if len(starts) else np.zeros(0, bool), first) / some
    h, row = span_hashes(buf, starts, ends), np.repeat(np.arange(n), np.diff(first))
    distinct, top = _distinct(h, row, n)
    out["distinct_words"], out["top_word"] = distinct / some, top / some
    pairs = gram_hashes(h, 2)
    same = row[:-1] == row[1:] if len(row) else np.zeros(0, bool)
    kinds, _ = _distinct(pairs[same], row[:-1][same], n)
    out["repeat_bigrams"] = 1 - kinds / np.maximum(1, np.bincount(row[:-1][same], minlength=n)) if len(row) else np.zeros(n)
    out["repeat_bigrams"] = np.where(many > 1, out["repeat_bigrams"], 0)
    lo, hi, line_cut = words(buf, offsets, byte_table("\n"))
    lines = np.diff(line_cut).astype(np.float64)
    breaks = _runs(buf == 10, offsets)
    any_line = np.maximum(lines, 1)
    out["log_lines"], out["line_words"] = np.log1p(lines), many / any_line
    out["blank_lines"] = np.maximum(0, breaks + 1 - lines) / (breaks + 1) * (size > 0)
    line_row = np.repeat(np.arange(n), np.diff(line_cut))
    kinds, _ = _distinct(span_hashes(buf, lo, hi), line_row, n)
    out["repeat_lines"] = np.where(lines > 0, 1 - kinds / any_line, 0)
    line_head, line_tail = (buf[lo], buf[hi - 1]) if len(lo) else (np.zeros(0, np.uint8),) * 2
    out["bullet_lines"] = _runs(np.isin(line_head, list(b"-*+>|#")), line_cut) / any_line
    out["stop_end_lines"] = _runs(np.isin(line_tail, list(b".!?:;\"")), line_cut) / any_line
    return np.column_stack([out[name] for name in STATISTICS])


BARE = "".join(map(chr, range(33))) + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\x7f"


PREFIXES = (4, 5, 6)  # bytes of a word's beginning that are features besides the word


def hashed_words(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket): the distinct words of each text (A-Z lowered, without
    ASCII punctuation) and their beginnings in 2^bits buckets, by row."""
    buf, offsets = text_bytes(column)
    buf = lowered(buf)
    starts, ends, first = words(buf, offsets, byte_table(BARE))
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    h = span_hashes(buf, starts, ends)
    buckets, owners = [h], [row]
    for size in PREFIXES:
        long = np.flatnonzero(ends - starts > size)
        with np.errstate(over="ignore"):
            buckets.append(mixed(span_hashes(buf, starts[long], starts[long] + size) + U(size) * STEP))
        owners.append(row[long])
    bucket, row = (np.concatenate(buckets) >> U(64 - bits)).astype(np.int64), np.concatenate(owners)
    pair = np.unique((row << bits) | bucket)
    return pair >> bits, pair & ((1 << bits) - 1)
