"""N-gram Jaccard join over parity sketches.

A document is the set of its distinct k-word shingles. The hash range is cut
into blocks, and each shingle flips one bit of its block's wide stretch of the
sketch; a stretch is mostly zeros and is held as the XOR of a 64-bit code per
bit that is set. Two sketches differ in no more blocks than their sets differ
in shingles. Sets that reach the similarity differ in at most D shingles, hence
of D + 1 + e blocks at least 1 + e are equal. Sizes fall into bands; a band fixes D, and a set takes
part in its own band and in the bands its larger partners can lie in. Equal
block words meet by a hash exchange, pairs that meet are verified on whole
sets, and components follow from the verified links.

Blocks with no or one shingle say little and meet often. At least 1 + e blocks
hold the same shingles in both sets, so a set with at most e such weak blocks
leaves them out: some block that both hold alike is not weak, and both emit it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import NO_ID, components, parts, query, table
from tagloom.llm.texts import (
    MIX_2,
    SPACES,
    STEP,
    U,
    byte_table,
    give_back,
    lowered,
    mixed,
    ragged,
    shingle_sets,
    slices,
    span_hashes,
    text_bytes,
    words,
)
from tagloom.session import materialize

BLOCK_KEYS = 1 << 20  # keys that a mapper groups at once
BUCKETS = 16  # of keys in a reducer, which holds one of them at a time
LIST_ROWS = 128  # members of one tile
LEAST_WORDS = 8  # 64-bit words of the smallest folded sketch that pairs are filtered by


def allowed_difference(a: int, b: int, num: int, den: int) -> int:
    """Largest symmetric difference of sets of sizes a and b with den*I >= num*U."""
    return (den - num) * (a + b) // (den + num)


def bands(largest: int, num: int, den: int) -> list[int]:
    """Lower ends of the size bands, each about den/num times the one before."""
    ends = [1]
    while ends[-1] <= largest * den // num:
        ends.append(max(ends[-1] + 1, ends[-1] * den // num))
    return ends


def block_keys(s: np.ndarray, ends: list[int], num: int, den: int) -> np.ndarray:
    """Keys of one set: its block words under every band it takes part in."""
    if not len(s):
        return np.zeros(0, np.uint64)
    own = int(np.searchsorted(ends, len(s), side="right")) - 1
    last = int(np.searchsorted(ends, len(s) * den // num, side="right")) - 1
    with np.errstate(over="ignore"):
        code = mixed(s * STEP)
    out = []
    for band in range(own, last + 1):
        top = ends[band + 1] - 1
        d = allowed_difference(top, top, num, den)
        if d == 0:
            continue  # only equal sets reach the similarity
        spare = 1 + d // 10
        n = d + 1 + spare
        block = ((s >> U(32)) * U(n)) >> U(32)  # ascending, as s is
        cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        word = np.zeros(n, np.uint64)
        word[block[cut]] = np.bitwise_xor.reduceat(code, cut)
        size = np.bincount(block.astype(np.int64), minlength=n)
        at = np.arange(n, dtype=np.uint64)
        for weak in (size <= 1, size == 0):
            if np.count_nonzero(weak) <= spare:
                at = at[~weak]
                break
        place = at + (U(band + 1) << U(40))
        out.append(mixed(word[at.astype(np.int64)] ^ mixed(place * STEP)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    buf, offsets = text_bytes(batch.column("text"))
    buf = lowered(buf)
    starts, ends, first = words(buf, offsets, byte_table(SPACES))
    return shingle_sets(span_hashes(buf, starts, ends), first, k)


def set_id(s: np.ndarray) -> int:
    """One number for a whole set; equal sets are one node of the join."""
    with np.errstate(over="ignore"):
        h = mixed(np.array([np.bitwise_xor.reduce(mixed(s * MIX_2)) + np.add.reduce(mixed(s)) * STEP + U(len(s))], dtype=np.uint64))
    return int(h.view(np.int64)[0])


DOC, LIST, PACKED = range(3)  # what a row of the exchange holds
EXCHANGED = "bucket int, kind int, doc bigint, n bigint, node bigint, data binary"
FOUND = "doc bigint, n bigint, node bigint, sketch binary, key bigint, members array<bigint>"


def folded(s: np.ndarray) -> bytes:
    """The sketch of a set folded to about a bit per shingle, a power of two
    of words; two of them, the longer folded to the shorter, still differ in
    no more bits than the sets in shingles."""
    size = max(LEAST_WORDS, 1 << (max(1, len(s) // 64) - 1).bit_length())
    word = np.zeros(size, np.uint64)
    np.bitwise_xor.at(word, ((s >> U(40)) & U(size - 1)).astype(np.int64), U(1) << (s & U(63)))
    return word.tobytes()


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of sketches (rows) of two lengths, row by row."""
    n = min(a.shape[-1], b.shape[-1])
    a, b = (x if x.shape[-1] == n else np.bitwise_xor.reduce(x.reshape(*x.shape[:-1], x.shape[-1] // n, n), axis=-2) for x in (a, b))
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def by_length(sketches: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, sketches as rows) of each length."""
    sizes = np.array([len(x) // 8 for x in sketches], np.int64)
    return [(at, np.frombuffer(b"".join(sketches[i] for i in at.tolist()), np.uint64).reshape(len(at), -1)) for at in (np.flatnonzero(sizes == n) for n in np.unique(sizes))]


def pack_keys(key: np.ndarray, node: np.ndarray) -> bytes:
    """Rows ordered by node as one string: each node once, 48 bits of a key."""
    head = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    count = np.diff(np.append(head, len(node)))
    return b"".join([np.array([len(head), len(key)], np.int64).tobytes(), node[head].tobytes(), count.astype(np.int32).tobytes(), (key >> U(32)).astype(np.uint32).tobytes(), (key >> U(16)).astype(np.uint16).tobytes()])


def unpack_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = np.frombuffer(data, np.int64, 2).tolist()
    node, count = np.frombuffer(data, np.int64, n, 16), np.frombuffer(data, np.int32, n, 16 + 8 * n)
    high, low = np.frombuffer(data, np.uint32, m, 16 + 12 * n), np.frombuffer(data, np.uint16, m, 16 + 12 * n + 4 * m)
    return (high.astype(np.uint64) << U(32)) | (low.astype(np.uint64) << U(16)), np.repeat(node, count)


def _lists(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Distinct (key, node) rows: one row per key with its smallest node, and
    for keys of several nodes their tiles."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node = key[fresh], node[fresh]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(key)))
    tiles = []
    for at, n in zip(head[size > 1].tolist(), size[size > 1].tolist()):
        for lo in range(at, at + n, LIST_ROWS):  # each tile begins with the key's smallest node
            tile = node[lo : min(lo + LIST_ROWS, at + n)]
            tiles.append((int(key[at]), tile if lo == at else np.append(node[at], tile)))
    return key[head], node[head], tiles


def _map_keys(k: int, num: int, den: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = bands(1 << 20, num, den)
        held, rows = [], 0

        def flush():
            key = np.concatenate([x for x, _ in held])
            node = np.concatenate([np.full(len(x), y, np.int64) for x, y in held])
            key, node, tiles = _lists(key & ~U(0xFFFF), node)
            bucket = mixed(key) % U(buckets)
            order = np.lexsort((node, bucket))
            key, node, bucket = key[order], node[order], bucket[order].astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            out = [(int(bucket[a]), pack_keys(key[a:b], node[a:b]), False) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(key)])]
            for key_, tile in tiles:  # travels on as a finished list
                out.append((key_ % buckets, np.concatenate([[np.uint64(key_).view(np.int64)], tile]).tobytes(), True))
            for at in range(0, len(out), 10_000):
                some = out[at : at + 10_000]
                none = pa.array([None] * len(some), pa.int64())
                kinds = [LIST if x[2] else PACKED for x in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in some], pa.int32()), pa.array(kinds, pa.int32()), none, none, none, pa.array([x[1] for x in some], pa.binary())],
                    ["bucket", "kind", "doc", "n", "node", "data"])

        for batch in slices(batches, "text"):
            nodes, sizes, sketch = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64), []
            for i, s in enumerate(_sets(batch, k)):
                nodes[i], sizes[i] = set_id(s), len(s)
                sketch.append(folded(s))
                while len(s) >= ends[-2] * num // den:
                    ends.extend(bands(2 * len(s), num, den)[len(ends) :])
                keys = block_keys(s, ends, num, den)
                if len(keys):
                    held.append((keys, nodes[i]))
                    rows += len(keys)
                if rows >= BLOCK_KEYS:
                    yield from flush()
                    held, rows = [], 0
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.abs(nodes % buckets).astype(np.int32)), pa.array(np.full(len(nodes), DOC, np.int32)), pa.array(ids.astype(np.int64)),
                 pa.array(sizes), pa.array(nodes, mask=sizes == 0), pa.array(sketch, pa.binary())],
                ["bucket", "kind", "doc", "n", "node", "data"])
        if held:
            yield from flush()

    return run


def _found(tiles: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(tiles), 5000):
        key, members = zip(*tiles[at : at + 5000])
        none = pa.array([None] * len(key), pa.int64())
        lists = ragged(np.concatenate([[0], np.cumsum([len(x) for x in members])]), np.concatenate(members), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array([None] * len(key), pa.binary()), pa.array(key, pa.int64()), lists], ["doc", "n", "node", "sketch", "key", "members"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes documents and finished lists on, and lists the nodes of each key
    that came from more than one mapper. Rows come sorted by bucket; the keys
    of one bucket are held at a time."""
    packed, at = [], None

    def flush():
        key, node = (np.concatenate(x) for x in zip(*packed))
        packed.clear()
        _, _, tiles = _lists(key, node)
        yield from _found([(int(np.uint64(key).view(np.int64)), nodes) for key, nodes in tiles])

    for batch in batches:
        kind, bucket = batch.column("kind").to_numpy(), batch.column("bucket").to_numpy()
        doc = batch.filter(pa.array(kind == DOC))
        none = pa.array([None] * doc.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [doc.column("doc"), doc.column("n"), doc.column("node"), doc.column("data"), none, pa.array([None] * doc.num_rows, pa.list_(pa.int64()))],
            ["doc", "n", "node", "sketch", "key", "members"])
        data = batch.column("data")
        lists = [np.frombuffer(x, np.int64) for x in data.filter(pa.array(kind == LIST)).to_pylist()]
        yield from _found([(int(x[0]), x[1:]) for x in lists])
        for i in np.flatnonzero(kind == PACKED).tolist():
            if bucket[i] != at and packed:
                yield from flush()
            at = bucket[i]
            packed.append(unpack_keys(data[i].as_py()))
    if packed:
        yield from flush()
    give_back()


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            wanted = batch.column("node").to_pylist()
            rows = [(w, s) for w, s in zip(wanted, _sets(batch, k)) if set_id(s) == w]
            yield pa.RecordBatch.from_pydict({
                "node": pa.array([w for w, _ in rows], pa.int64()),
                "items": pa.array([s.tobytes() for _, s in rows], pa.binary()),
            })

    return run


def _linked(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("items_a"), batch.column("items_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = min(len(x), len(y)), max(len(x), len(y))
                if small * den < large * num:
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(den * common >= num * (small + large - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _near_pairs(pairs: DataFrame, small: DataFrame, num: int, den: int, name: str) -> DataFrame:
    """Pairs whose sizes and sketches do not rule the similarity out, so that
    whole sets travel for few pairs only."""
    a = small.select(F.col("node").alias("a"), F.struct("n", "sketch").alias("sketch_a"))
    b = small.select(F.col("node").alias("b"), F.struct("n", "sketch").alias("sketch_b"))
    return materialize(pairs.join(a, "a").join(b, "b").mapInArrow(_near(num, den), "a bigint, b bigint"), name)


def _sets_of(nodes: DataFrame, rows: DataFrame, slim: DataFrame, k: int, name: str) -> DataFrame:
    """The whole set of each node, from the text of its first document."""
    holders = materialize(rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")), f"{name}-holders")
    texts = slim.join(holders, "doc_id").select("node", "text")
    return materialize(texts.mapInArrow(_set_rows(k), "node bigint, items binary"), name)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, name: str) -> DataFrame:
    """Pairs (a < b) whose whole sets reach the similarity."""
    a = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
    b = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    return materialize(pairs.join(a, "a").join(b, "b").mapInArrow(_linked(num, den), "a bigint, b bigint"), name)


def _near(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("sketch_a"), batch.column("sketch_b")
            na, nb = (x.field("n").to_numpy() for x in (a, b))
            sa, sb = (x.field("sketch").to_pylist() for x in (a, b))
            near = np.minimum(na, nb) * den >= np.maximum(na, nb) * num
            left = np.flatnonzero(near)
            for at, x in by_length([sa[i] for i in left.tolist()]):
                for to, y in by_length([sb[i] for i in left[at].tolist()]):
                    at_ = left[at[to]]
                    near[at_] = distances(x[to], y) <= (den - num) * (na[at_] + nb[at_]) // (den + num)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near))

    return run


def _across(num: int, den: int):
    """Pairs of a tile pair that lie in different components and whose sketches
    do not rule the similarity out."""

    def side(rows):
        return [(at, x, *(np.array([rows[i][f] for i in at.tolist()], np.int64) for f in ("node", "root", "n"))) for at, x in by_length([r["sketch"] for r in rows])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("left"), batch.column("right")):
                for _, x, na, ra, sa in side(left.as_py()):
                    for _, y, nb, rb, sb in side(right.as_py()):
                        near = ra[:, None] != rb[None, :]
                        near &= np.minimum(sa[:, None], sb[None, :]) * den >= np.maximum(sa[:, None], sb[None, :]) * num
                        i, j = np.nonzero(near)
                        close = distances(x[i], y[j]) <= (den - num) * (sa[i] + sb[j]) // (den + num)
                        i, j = i[close], j[close]
                        low, high = np.minimum(na[i], nb[j]), np.maximum(na[i], nb[j])
                        yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["a", "b"])

    return run


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches folded to their smallest length."""
    for batch in batches:
        sketches = batch.column("sketch").to_pylist()
        out = [b""] * len(sketches)
        for at, x in by_length(sketches):
            for i, row in zip(at.tolist(), np.bitwise_xor.reduce(x.reshape(len(x), -1, LEAST_WORDS), axis=1)):
                out[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array(out, pa.binary())], ["node", "n", "sketch"])


def _open_pairs(members: DataFrame, roots: DataFrame, small: DataFrame, num: int, den: int) -> DataFrame:
    """Untried pairs: nodes under one key whose components still differ. Keys
    of two nodes were tried as they are."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 2")
    some = materialize(members.join(sizes, "key"), "ngram-members")
    rooted = some.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialize(rooted, "ngram-rooted")
    keys = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    tiles = F.ceil(F.col("size") / LIST_ROWS).cast("int")
    rows = rooted.join(keys, "key").select("key", "node", "root", tiles.alias("tiles"))
    # most open keys have the same few members as others: one stands for all of them
    lists = rows.filter("tiles = 1").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "root"))).alias("members"))
    lists = lists.dropDuplicates(["members"]).select("key", F.lit(1).alias("tiles"), F.explode("members").alias("m")).select("key", "m.node", "m.root", "tiles")
    rows = materialize(lists.unionByName(rows.filter("tiles > 1")), "ngram-open-members")
    short = small.mapInArrow(_short, "node bigint, n bigint, sketch binary")
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    cut = rows.join(short, "node").groupBy("key", "tiles", tile.alias("tile")).agg(F.collect_list(F.struct("node", "root", "n", "sketch")).alias("left"))
    cut = materialize(cut, "ngram-tiles")
    whole = cut.select("left", F.col("left").alias("right"))
    other = cut.filter("tiles > 1").select("key", F.col("tile").alias("tile_b"), F.col("left").alias("right"))
    crossed = cut.filter("tiles > 1").join(other, "key").filter("tile < tile_b").select("left", "right")
    return whole.unionByName(crossed).mapInArrow(_across(num, den), "a bigint, b bigint").distinct()


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Rows link when den * intersection >= num * union of their shingle sets;
    component_id is the smallest doc_id reachable. Texts that are null or have
    no word have an empty set and link with nothing. Fewer than k words make
    one shingle of the whole sequence. Repeated rows are rows of one node. A
    null doc_id sorts before all others and comes back as null; other columns
    are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    tasks = parts(spark)
    mapped = slim.mapInArrow(_map_keys(k, num, den, tasks * BUCKETS), EXCHANGED)
    dealt = mapped.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket")
    found = materialize(dealt.mapInArrow(_meet, FOUND), "ngram-found")

    rows = found.filter(F.col("doc").isNotNull()).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "node")
    small = found.filter(F.col("node").isNotNull()).select("node", "n", "sketch").dropDuplicates(["node"])
    lists = found.filter(F.col("members").isNotNull()).select("key", "members")
    members = lists.select("key", F.explode("members").alias("node")).distinct()
    second = F.when(F.size("members") > 8, F.pmod("key", F.size("members")).cast("int")).otherwise(F.lit(0))
    star = lists.select(F.col("members")[0].alias("x"), F.col("members")[second].alias("z"), F.explode(F.slice("members", 2, LIST_ROWS)).alias("y"))
    pairs = star.select("y", F.explode(F.array_distinct(F.array("x", F.when(F.col("z") != F.col("y"), F.col("z")).otherwise(F.col("x"))))).alias("x"))
    pairs = materialize(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct(), "ngram-pairs")

    near = _near_pairs(pairs, small, num, den, "ngram-near")
    ends = lambda x: x.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _sets_of(ends(near), rows, slim, k, "ngram-sets")
    links = _verified(near, sets, num, den, "ngram-links")
    roots = components(links)
    more = materialize(_open_pairs(members, roots, small, num, den), "ngram-open")
    more = _near_pairs(more, small, num, den, "ngram-near-2")
    if not more.isEmpty():
        other = _sets_of(ends(more).join(sets.select("node"), "node", "left_anti"), rows, slim, k, "ngram-sets-2")
        links = links.unionByName(_verified(more, sets.unionByName(other), num, den, "ngram-links-2"))
        roots = components(links)

    full = rows.filter("node IS NOT NULL").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    full = materialize(full.select("doc_id", "n_shingles", "root"), "ngram-roots")
    low = full.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = full.join(low, "root").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(rows.filter("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select(*[F.when(F.col(c) != NO_ID, F.col(c)).alias(c) if c != "n_shingles" else F.col(c) for c in out.columns])


def representatives(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near copies the one of
    the smallest doc_id; all columns are kept. Rows without a doc_id stay."""
    found = jaccard_components(docs.filter("doc_id IS NOT NULL"), k, num, den)
    gone = found.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@query("op6_ngram_jaccard_join", oracle=r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 4 THEN [array_to_string(ws[i : i + 3], ' ') FOR i IN range(1, len(ws) - 2)]
                                    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS sh
  FROM w
), x AS (SELECT doc_id, unnest(sh) AS sh FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (
  SELECT p.a, p.b FROM p JOIN s sa ON sa.doc_id = p.a JOIN s sb ON sb.doc_id = p.b
  WHERE 100 * i >= 85 * (len(sa.sh) + len(sb.sh) - i)
), e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e2.b FROM r JOIN e2 ON e2.a = r.root)
SELECT r.doc_id, CAST(max(len(s.sh)) AS BIGINT) AS n_shingles, min(root) AS component_id
FROM r JOIN s ON s.doc_id = r.doc_id GROUP BY r.doc_id""")
def op6_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"), k=4, num=85, den=100)
