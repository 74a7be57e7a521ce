"""Order-dependent choices that scale with hot keys."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.session import materialize


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in the given order; combined map-side, so a hot key
    reaches its reducer as one row per task."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*rows.columns)


def top_n(rows: DataFrame, keys: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    """Rows of rank <= n per key; Spark limits each task's groups before the shuffle."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(name, place).filter(F.col(name) <= n)


def group_numbers(rows: DataFrame, key: str, order: str, width: int = 1 << 16, name: str = "n") -> DataFrame:
    """1-based running number per key by a BIGINT order column.

    Numbers are taken inside order ranges of ``width`` and shifted by the
    counts of earlier ranges, so one hot key is numbered by many tasks.
    """
    cut = rows.withColumn("_range", F.floor(F.col(order) / width))
    local = F.row_number().over(W.partitionBy(key, "_range").orderBy(order))
    sizes = cut.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(F.col(key), "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = cut.withColumn("_local", local).join(offsets, [key, "_range"])
    return numbered.withColumn(name, F.col("_before") + F.col("_local")).drop("_range", "_local", "_before")


def running_numbers(rows: DataFrame, keys: list[str], order: list, name: str = "n") -> DataFrame:
    """0-based running number per key by any order that sorts.

    Rows are sorted by ranges of (key, order) and numbered inside their range;
    earlier ranges of the key shift them. At most one offset per range and key
    that meet, so neither a hot key nor no key at all is numbered by one task.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    ranges = materialize(ranges.withColumns({"_range": F.spark_partition_id(), "_line": F.monotonically_increasing_id()}), "numbered")
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    sizes = ranges.groupBy(key.alias("_key"), "_range").agg(F.min("_line").alias("begin"), F.count(F.lit(1)).alias("size"))
    lists = sizes.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_range", "begin", "size"))).alias("all"))
    before = lambda i: F.aggregate(F.slice("all", 1, i), F.lit(0).cast("bigint"), lambda a, x: a + x["size"])
    shifts = lists.select("_key", F.explode(F.transform("all", lambda x, i: F.struct(x["_range"].alias("_range"), (before(i) - x["begin"]).alias("_shift")))).alias("s"))
    shifts = materialize(shifts.select("_key", "s.*"), "number-shifts")
    numbered = ranges.withColumn("_key", key).alias("r").join(shifts.alias("s"), F.col("r._key").eqNullSafe(F.col("s._key")) & (F.col("r._range") == F.col("s._range")))
    return numbered.select(*[F.col(f"r.`{c}`") for c in rows.columns], (F.col("r._line") + F.col("s._shift")).alias(name))


def running_sums(rows: DataFrame, keys: list[str], order: list, value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the key, by ranges like
    ``running_numbers``."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.withColumn("_value", value).repartitionByRange(n, *keys, *order)
    ranges = materialize(ranges.withColumn("_range", F.spark_partition_id()), "summed")
    inside = F.sum("_value").over(W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    sizes = ranges.groupBy(*keys, "_range").agg(F.sum("_value").alias("_total"))
    before = F.sum("_total").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(*keys, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    summed = ranges.withColumn("_inside", inside).join(offsets, [*keys, "_range"])
    return summed.withColumn(name, F.col("_before") + F.coalesce("_inside", F.lit(0))).drop("_value", "_range", "_inside", "_before")


def top_per_key(rows: DataFrame, keys: list[str], order: list, n: str, most: int, name: str = "rank") -> DataFrame:
    """Rows of rank <= the column ``n`` per key; no ``n`` is above ``most``.

    For a moderate ``most`` each task first keeps its own best rows of a key,
    so a hot key brings few of them to its reducer; beyond that ranks are
    running numbers over ranges of the order."""
    if most <= FOLD_ROWS:
        place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
        return rows.withColumn(name, place).filter((F.col(name) <= most) & (F.col(name) <= F.col(n)))
    ranked = running_numbers(rows, keys, order, name)
    return ranked.withColumn(name, (F.col(name) + 1).cast("int")).filter(F.col(name) <= F.col(n))


FOLD_ROWS = 10_000  # of a group that one task folds at most; a larger one is cut into components
COMPONENT_ROWS = 200_000  # of a component, on ids and keys alone, that one task walks; a larger one goes in rounds


def shuffled(df: DataFrame) -> DataFrame:
    """A join side that grows with the input. Spark would judge it by the bytes
    of the file it comes from, before rows are multiplied and without their
    compression, and build it whole in the driver."""
    return df.hint("merge")


def _large(rows: DataFrame, keys: list[str], limit: int, name: str) -> DataFrame:
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > limit)
    return materialize(sizes.select(*keys), name)


def _split(rows: DataFrame, keys: list[str], limit: int, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups small enough for a fold, and those of the others, if any."""
    large = _large(rows, keys, limit, name)
    if large.isEmpty():
        return rows, None
    return rows.join(large, keys, "left_anti"), rows.join(large, keys, "left_semi")


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges(u, v)`` (BIGINT): equal labels are
    connected.

    Each node hooks to its smallest neighbour if that is smaller; the forest is
    flattened by pointer jumping and its roots, at most about half of the
    nodes, make the next graph. Logarithmic in the nodes, also for a chain.
    """
    both = edges.filter("u <> v").select("u", "v")
    both = materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "component-edges")
    label, step = both.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct(), 0
    while not both.isEmpty():
        step += 1
        hook = both.groupBy("u").agg(F.min("v").alias("up")).filter("up < u")
        root = materialize(root_labels(hook, "u", "up", shuffled), f"component-roots-{step}")
        moved = label.join(shuffled(root.select(F.col("u").alias("label"), "up")), "label", "left")
        label = materialize(moved.select("node", F.coalesce("up", "label").alias("label")), f"component-labels-{step}")
        for side in ("u", "v"):
            to = root.select(F.col("u").alias(side), F.col("up").alias("_to"))
            both = both.join(shuffled(to), side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
        both = materialize(both.select("u", "v").filter("u <> v").distinct(), f"component-edges-{step}")
    return label


def greedy_distinct(rows: DataFrame, group: str, order: str, keys: tuple[str, str]) -> DataFrame:
    """Keep a row unless an earlier kept row of its group shares one of two keys.

    Exact. Groups of at most FOLD_ROWS rows are walked once, on ids and keys
    alone. In a larger one only the first row of a pair of keys can stay; the
    graph whose nodes are the keys and whose edges these rows is cut into its
    components, and each is walked on its own. Only a component of more than
    COMPONENT_ROWS goes in rounds and never meets in one task; how many rounds
    depends on the order of its rows. A NULL key never conflicts. ``order`` is
    unique within a group.
    """
    rows = materialize(rows, "greedy-rows")
    small, large = _split(rows, [group], FOLD_ROWS, "greedy-large")
    a, b = keys
    slim = lambda some: some.select(group, order, F.col(a).cast("string").alias("_a"), F.col(b).cast("string").alias("_b"))
    walk = _walk_distinct(group, order)
    schema = rows.select(group, order).schema
    chosen = slim(small).groupBy(group).applyInPandas(walk, schema)
    if large is not None:
        free = large.filter(F.col(a).isNull() & F.col(b).isNull()).select(group, order)
        pairs = slim(large).filter("_a IS NOT NULL OR _b IS NOT NULL")
        pairs = materialize(pairs.groupBy(group, "_a", "_b").agg(F.min(order).alias(order)), "greedy-pairs")
        node = lambda k: F.xxhash64(group, F.lit(k), k)  # noqa: E731  two keys of one hash only join their components
        edges = pairs.filter("_a IS NOT NULL AND _b IS NOT NULL").select(node("_a").alias("u"), node("_b").alias("v"))
        own = F.when(F.col("_a").isNotNull(), node("_a")).otherwise(node("_b"))
        labels = component_labels(edges).withColumnsRenamed({"node": "_node", "label": "_label"})
        parts = pairs.withColumn("_node", own).join(shuffled(labels), "_node", "left").withColumn("_part", F.coalesce("_label", "_node")).drop("_node", "_label")
        parts = materialize(parts, "greedy-parts")
        walked, huge = _split(parts, [group, "_part"], COMPONENT_ROWS, "greedy-huge")
        chosen = chosen.unionByName(walked.groupBy(group, "_part").applyInPandas(walk, schema)).unionByName(free)
        if huge is not None:
            chosen = chosen.unionByName(_distinct_rounds(huge.drop("_part"), group, order, ("_a", "_b")).select(group, order))
    return rows.join(shuffled(chosen), [group, order], "left_semi").select(*rows.columns)


def _walk_distinct(group: str, order: str):
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        seen_a, seen_b, keep = set(), set(), []
        for x, y in zip(pdf["_a"], pdf["_b"]):
            x, y = (None if pd.isna(v) else v for v in (x, y))
            new = (x is None or x not in seen_a) and (y is None or y not in seen_b)
            keep.append(new)
            if new:
                seen_a.add(x)
                seen_b.add(y)
        return pdf.loc[keep, [group, order]]

    return walk


def _distinct_rounds(rows: DataFrame, group: str, order: str, keys: tuple[str, str]) -> DataFrame:
    """The same without folding a group: in each round the rows that come first
    under both of their keys are kept and every row that shares a key with them
    leaves."""
    a, b = keys
    open_rows, kept, step = materialize(rows, "greedy-0"), None, 0
    while not open_rows.isEmpty():
        step += 1
        firsts = open_rows
        for k in (a, b):
            low = open_rows.filter(F.col(k).isNotNull()).groupBy(group, k).agg(F.min(order).alias(f"_{k}"))
            firsts = firsts.join(shuffled(low), [group, k], "left")
        free = [F.col(f"_{k}").isNull() | (F.col(f"_{k}") == F.col(order)) for k in (a, b)]
        chosen = materialize(firsts.filter(free[0] & free[1]).select(*rows.columns), f"greedy-kept-{step}")
        kept = chosen if kept is None else kept.unionByName(chosen)
        rest = open_rows.join(shuffled(chosen.select(group, order)), [group, order], "left_anti")
        for k in (a, b):
            rest = rest.join(shuffled(chosen.filter(F.col(k).isNotNull()).select(group, k)), [group, k], "left_anti")
        open_rows = materialize(rest.select(*rows.columns), f"greedy-{step}")
    return rows.limit(0) if kept is None else kept


def _ball(h: Column) -> Column:
    flips = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)])
    return F.concat(F.array(h), F.transform(flips, lambda m: h.bitwiseXOR(m)))


def near_pairs(rows: DataFrame, group: str, order: str, hashed: str) -> DataFrame:
    """(group, low, high): order values of hashes at distance 1 or 2 in a group.

    Two 64-bit hashes differ in at most two bits exactly when their one-bit
    neighbourhoods meet, so both sides emit 65 values and an equi-join finds
    them; distinct hashes bound a meeting value to 65 rows.
    """
    balls = rows.select(group, order, F.explode(_ball(F.col(hashed))).alias("_x"))
    other = balls.select(group, F.col(order).alias("_other"), "_x")
    pairs = balls.join(shuffled(other), [group, "_x"]).filter(F.col(order) < F.col("_other"))
    return pairs.select(group, F.col(order).alias("low"), F.col("_other").alias("high")).distinct()


def keep_unlike(rows: DataFrame, group: str, order: str, hashed: str, accepted: str | None = None) -> DataFrame:
    """Greedy near-duplicate removal: a row stays unless an earlier kept row of
    its group has a hash within two bits. NULL hashes stay. Rows flagged in
    ``accepted`` are kept as they are. Groups of more than FOLD_ROWS distinct
    hashes are cut into components of near pairs; only a component that is
    itself larger goes in rounds."""
    flag = F.col(accepted) if accepted else F.lit(False)
    marked = rows.withColumn("_in", flag)
    hashes = marked.filter(F.col(hashed).isNotNull())
    # equal hashes: only the first can stay, the others share its fate
    firsts = hashes.groupBy(group, hashed).agg(F.min(order).alias(order), F.bool_or("_in").alias("_in"))
    firsts = materialize(firsts, "unlike-hashes")
    small, large = _split(firsts, [group], FOLD_ROWS, "unlike-large")
    walk, schema = _walk_unlike(group, order, hashed), firsts.select(group, order).schema
    kept = small.select(group, order, hashed, "_in").groupBy(group).applyInPandas(walk, schema)
    if large is not None:
        # hashes that are near each other, directly or through others, are walked together
        near = materialize(near_pairs(large, group, order, hashed), "unlike-pairs")
        labels = component_labels(near.select(F.xxhash64(group, "low").alias("u"), F.xxhash64(group, "high").alias("v")))
        labels = labels.withColumnsRenamed({"node": "_node", "label": "_part"})
        parts = large.withColumn("_node", F.xxhash64(group, order)).join(shuffled(labels), "_node", "left")
        alone = parts.filter("_part IS NULL").select(group, order)
        parts = materialize(parts.filter("_part IS NOT NULL").select(group, order, hashed, "_in", "_part"), "unlike-parts")
        walked, huge = _split(parts, [group, "_part"], FOLD_ROWS, "unlike-huge")
        kept = kept.unionByName(alone).unionByName(walked.groupBy(group, "_part").applyInPandas(walk, schema))
        if huge is not None:
            kept = kept.unionByName(_unlike_rounds(huge.drop("_part"), group, order, hashed))
    kept = kept.withColumn("_kept", F.lit(True))
    stay = marked.join(shuffled(kept), [group, order], "left")
    keep = F.col("_in") | F.col(hashed).isNull() | F.coalesce("_kept", F.lit(False))
    return stay.filter(keep).select(*rows.columns)


def _walk_unlike(group: str, order: str, hashed: str):
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        given = pdf["_in"].to_numpy(bool)
        h = pdf[hashed].to_numpy(np.int64).view(np.uint64)
        kept, n, keep = np.zeros(len(h), np.uint64), 0, given.copy()
        for i in range(len(h)):
            if given[i] or not (np.bitwise_count(kept[:n] ^ h[i]) <= 2).any():
                keep[i], kept[n], n = True, h[i], n + 1
        return pdf.loc[keep, [group, order]]

    return walk


def _unlike_rounds(firsts: DataFrame, group: str, order: str, hashed: str) -> DataFrame:
    edges = materialize(near_pairs(firsts, group, order, hashed), "unlike-pairs")
    kept, open_rows, step = firsts.filter("_in").select(group, order), firsts.filter(~F.col("_in")).select(group, order), 0
    new = kept
    while True:
        step += 1
        hit = edges.join(shuffled(new.select(group, F.col(order).alias("low"))), [group, "low"], "left_semi")
        open_rows = materialize(
            open_rows.join(shuffled(hit.select(group, F.col("high").alias(order))), [group, order], "left_anti"), f"unlike-{step}"
        )
        if open_rows.isEmpty():
            break
        waits = edges.join(shuffled(open_rows.select(group, F.col(order).alias("low"))), [group, "low"], "left_semi")
        new = materialize(
            open_rows.join(shuffled(waits.select(group, F.col("high").alias(order))), [group, order], "left_anti"), f"unlike-new-{step}"
        )
        kept = kept.unionByName(new)
        open_rows = open_rows.join(shuffled(new), [group, order], "left_anti")
    return kept


def root_labels(parents: DataFrame, node: str, parent: str, side: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Root of each node of a forest by pointer jumping (log-depth rounds);
    ``side`` may mark the join side, as ``shuffled`` does."""
    links, step = materialize(parents.select(node, F.col(parent).alias("_up")), "roots-0"), 0
    while True:
        step += 1
        up = links.select(F.col(node).alias("_up"), F.col("_up").alias("_next"))
        jumped = links.join(side(up), "_up", "left").select(node, F.coalesce("_next", "_up").alias("_up"), (F.coalesce("_next", "_up") != F.col("_up")).alias("_moved"))
        jumped = materialize(jumped, f"roots-{step}")
        links = jumped.select(node, "_up")
        if jumped.filter("_moved").isEmpty():
            return links.select(node, F.col("_up").alias(parent))
