"""Pre-tokenizer of byte-level BPE as a deterministic transducer.

The machine reads one symbol per byte (the class of a character at its first
byte, a neutral symbol at the others) and emits where pieces begin: before
this character, or, where the decision waited for it, before the last one.
A buffer is cut into chunks; each chunk's map from start state to end state is
found by running all states until they agree, the maps are composed by a
parallel prefix scan, and every chunk then runs once from its known state.
"""

from __future__ import annotations

import numpy as np

from tagloom.llm.texts import kept

END = 0xFF  # never a byte of UTF-8; stands after each text and for special strings
CONT, SPACE, WHITE, DIGIT, OTHER, QUOTE, LETTER, T_LIKE, R, E, V, L_, STOP = range(13)
S, LET, NUM, OTH, P, Q, WP, WQ, A, AR, AV, AL = range(12)
N_STATES, N_SYMBOLS = 12, 16
HERE, LAST = 1, 2  # a piece begins before this character / before the last one
CHUNK = 512
KNOWN_BYTES = 64  # longer pieces are encoded each time and never taken for a known one


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission for (state, symbol), at state * 16 + symbol.

    The machine of  's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?other+|s+(?!S)|s+ .
    """
    letters = {LETTER, T_LIKE, R, E, V, L_}
    fresh = {SPACE: P, WHITE: Q, DIGIT: NUM, OTHER: OTH, QUOTE: A, STOP: S} | {x: LET for x in letters}
    glued = {DIGIT: NUM, OTHER: OTH, QUOTE: OTH} | {x: LET for x in letters}
    run = {LET: letters, NUM: {DIGIT}, OTH: {OTHER, QUOTE}}
    nxt, out = np.zeros((N_STATES, N_SYMBOLS), np.uint8), np.zeros((N_STATES, N_SYMBOLS), np.uint8)
    nxt[:, CONT] = np.arange(N_STATES)
    for c in range(1, 13):
        white = {SPACE: WP, WHITE: WQ}.get(c)
        for state in range(N_STATES):
            to, emit = fresh[c], HERE
            if c in run.get(state, ()):
                to, emit = state, 0
            elif state in (P, Q, WP, WQ) and white is not None:
                to, emit = white, 0
            elif state == P and c in glued:
                to, emit = glued[c], 0
            elif state == WP and c in glued:
                to, emit = glued[c], LAST
            elif state == WQ and c != STOP:
                emit = HERE | LAST
            elif state == A:
                if c == T_LIKE:
                    to, emit = S, 0
                elif c in (R, V, L_):
                    to, emit = {R: AR, V: AV, L_: AL}[c], 0
                elif c in (OTHER, QUOTE):
                    to, emit = OTH, 0
            elif (state, c) in ((AR, E), (AV, E), (AL, L_)):
                to, emit = S, 0
            elif state in (AR, AV, AL):
                to, emit = (LET, LAST) if c in letters else (fresh[c], HERE | LAST)
            nxt[state, c], out[state, c] = to, emit
    return nxt.reshape(-1), out.reshape(-1)


# The characters with the White_Space property.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def character_classes(vocabulary: str) -> bytes:
    """Symbol of every code point, as the tokenizer of this file sees it: each
    stands between a letter and a digit, and the cuts tell what it is."""
    from tokenizers import Tokenizer

    cut = Tokenizer.from_str(vocabulary).pre_tokenizer
    table = np.full(0x110000, OTHER, np.uint8)
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 50_000):
        some = np.array(every[at : at + 50_000])
        begins = np.zeros(3 * len(some) + 1, bool)
        begins[[lo for _, (lo, _) in cut.pre_tokenize_str("".join(f"a{chr(c)}1" for c in some))]] = True
        table[some[~begins[1::3]]] = LETTER
        table[some[~begins[2::3]]] = DIGIT
    for codes, symbol in ((WHITE_SPACE, WHITE), (b" ", SPACE), (b"'", QUOTE), (b"stmd", T_LIKE), (b"r", R), (b"e", E), (b"v", V), (b"l", L_)):
        table[list(codes)] = symbol
    return table.tobytes()


def with_stops(buf: np.ndarray, offsets: np.ndarray, specials: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with a stop byte behind each and special strings overwritten
    by stops; new offsets; the places of the special strings and which they are."""
    rows = len(offsets) - 1
    out = np.full(len(buf) + rows, END, np.uint8)
    out[np.arange(len(buf)) + np.repeat(np.arange(rows), np.diff(offsets))] = buf
    offsets = offsets + np.arange(rows + 1)
    found = []
    for which, special in enumerate(specials):
        data, at = out.tobytes(), -1
        while (at := data.find(special, at + 1)) >= 0:
            if out[at] != END:
                out[at : at + len(special)] = END
                found.append((at, which))
    places = np.array(sorted(found), np.int64).reshape(-1, 2)
    return out, offsets, places[:, 0], places[:, 1]


def symbols(buf: np.ndarray, classes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf), np.uint8)
    stop = buf == END
    lead = (buf & 0xC0) != 0x80
    text = np.where(stop, np.uint8(32), buf).tobytes().decode("utf-8", "surrogatepass")
    out[lead] = classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    out[stop] = STOP
    return out


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps (rows) under composition."""
    step = 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    return maps


def piece_starts(buf: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte positions at which pieces begin; every stop byte is a piece of its own."""
    if not len(buf):
        return np.zeros(0, np.int64)
    nxt, out = kept("piece-machine", _machine)
    n = len(buf)
    chunks = -(-n // CHUNK)
    code = np.zeros(chunks * CHUNK, np.uint8)  # filled up with the neutral symbol
    code[:n] = symbols(buf, classes)
    lanes = np.ascontiguousarray(code.reshape(chunks, CHUNK).T)
    state = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], chunks, axis=1)
    here = np.arange(chunks)
    maps = np.empty((chunks, N_STATES), np.uint8)
    at = 0
    while at < CHUNK and len(here):
        stop = min(CHUNK, max(64, 2 * at))
        for j in range(at, stop):
            state = nxt.take(state * np.uint8(N_SYMBOLS) + lanes[j, here])
        at = stop
        same = (state == state[0]).all(axis=0)
        if at < CHUNK and same.any():  # one state stands for all from here on
            one, who = state[0, same], here[same]
            for j in range(at, CHUNK):
                one = nxt.take(one * np.uint8(N_SYMBOLS) + lanes[j, who])
            maps[who] = one[:, None]
            state, here = state[:, ~same], here[~same]
    maps[here] = state.T
    ends = compose(maps)[:, S]
    now = np.concatenate([[np.uint8(S)], ends[:-1]])
    emitted = np.empty((CHUNK, chunks), np.uint8)
    for j in range(CHUNK):
        index = now * np.uint8(N_SYMBOLS) + lanes[j]
        emitted[j] = out.take(index)
        now = nxt.take(index)
    emitted = emitted.T.reshape(-1)[:n]
    begins = (emitted & HERE) != 0
    late = np.flatnonzero(emitted & LAST) - 1
    while len(inner := np.flatnonzero((buf[late] & 0xC0) == 0x80)):
        late[inner] -= 1
    begins[late] = True
    return np.flatnonzero(begins)


class PieceTable:
    """Value of a piece by its hash: open addressing with a few probes in flat
    arrays; the rest in a dictionary. Starts anew when it is full."""

    SHIFTS = (0, 13, 27, 41)

    def __init__(self, bits: int = 21) -> None:
        self.mask = (1 << bits) - 1
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(self.mask + 1, np.uint64)
        self.value = np.zeros(self.mask + 1, np.int32)
        self.size = 0
        self.rest: dict[int, int] = {}

    def _slot(self, h: np.ndarray, shift: int) -> np.ndarray:
        return ((h >> np.uint64(shift)) & np.uint64(self.mask)).astype(np.int64)

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and the places whose piece is unknown."""
        out = np.full(len(h), -1, np.int32)
        left = np.arange(len(h))
        for shift in self.SHIFTS:
            where = self._slot(h[left], shift)
            hit = self.key[where] == h[left]
            out[left[hit]] = self.value[where[hit]]
            left = left[~hit]
            if not len(left):
                return out, left
        if self.rest:
            found = [self.rest.get(x, -1) for x in h[left].tolist()]
            out[left] = found
            left = left[out[left] < 0]
        return out, left

    def put(self, h: np.ndarray, values: list[int]) -> None:
        values = np.asarray(values, np.int32)
        for shift in self.SHIFTS:
            slots = self._slot(h, shift)
            free = np.flatnonzero(self.key[slots] == 0)
            _, one = np.unique(slots[free], return_index=True)
            take = free[one]
            self.key[slots[take]], self.value[slots[take]] = h[take], values[take]
            self.size += len(take)
            h, values = np.delete(h, take), np.delete(values, take)
        self.rest.update(zip(h.tolist(), values.tolist()))

    def full(self) -> bool:
        return self.size > self.mask * 3 // 4 or len(self.rest) > 200_000
