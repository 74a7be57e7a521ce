"""Merkle dataset manifest with nested-interval labels.

Each group's rows, in order, are the leaves of a tree in which every ``arity``
consecutive nodes become one; the groups' tops are the leaves of one more
tree. A node carries the interval of leaf ranks that it covers. A parent holds
its children with their intervals, so the siblings of a node are what the
parent's interval has beyond the node's own: those that end before it and
those that begin after it. Ancestors are attached from the top down by
containment joins within a level, bucketed by rank / arity^level, and what is
above a node travels once for all leaves below it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import CRC_SQL, crc32_sql, id_fold, parts, query, table
from tagloom.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encoded(value: Column) -> Column:
    """A value with its size in front, so that neighbours cannot run together."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256)


def joined_digest(digests: Column) -> Column:
    return F.sha2(F.concat_ws("", digests).cast("binary"), 256)


def ranked(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``rank`` (from 0 in its ``part``) and ``many`` (rows of the part) to
    rows in the order of (part, *order). Rows are sorted by ranges, so a large
    part is numbered by many tasks; the table of offsets has at most one row
    per range and part that meet."""
    ranges = rows.repartitionByRange(parts(rows.sparkSession), "part", *order).sortWithinPartitions("part", *order)
    ranges = materialize(ranges.withColumns({"range": F.spark_partition_id(), "line": F.monotonically_increasing_id()}), name)
    sizes = ranges.groupBy("part", "range").agg(F.min("line").alias("begin"), F.count(F.lit(1)).alias("rows"))
    lists = sizes.groupBy("part").agg(F.sum("rows").alias("many"), F.array_sort(F.collect_list(F.struct("range", "begin", "rows"))).alias("ranges"))
    before = lambda i: F.aggregate(F.slice("ranges", 1, i), F.lit(0).cast("bigint"), lambda a, x: a + x["rows"])
    shifts = F.transform("ranges", lambda x, i: F.struct(x["range"].alias("range"), (before(i) - x["begin"]).alias("shift")))
    offsets = materialize(lists.select("part", "many", F.explode(shifts).alias("r")).select("part", "many", "r.*"), f"{name}-offsets")
    return ranges.join(offsets, ["part", "range"]).withColumn("rank", F.col("line") + F.col("shift")).drop("range", "line", "shift")


def levels(leaves: DataFrame, arity: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Nodes of (part, rank, many, digest, row), level by level, each with its
    interval [lo, hi] and its children; and the top (part, depth, hi, digest)
    of each part. A part of one leaf has that leaf as its top, under a node of
    level 1 that hashes nothing."""
    below = leaves.select("part", "many", F.col("rank").alias("lo"), F.col("rank").alias("hi"), "digest", "row")
    out, tops, level = [], None, 0
    while True:
        level += 1
        child = ["lo", "hi", "digest", *(["row"] if level == 1 else [])]
        nodes = below.groupBy("part", F.floor(F.col("lo") / arity**level).alias("bucket")).agg(
            F.first("many").alias("many"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sort_array(F.collect_list(F.struct(*child))).alias("children"))
        one = F.col("many") == 1
        nodes = nodes.withColumn("digest", F.when(one, F.col("children")[0]["digest"]).otherwise(joined_digest(F.transform("children", lambda c: c["digest"]))))
        nodes = materialize(nodes, f"{name}-level-{level}")
        out.append(nodes)
        top = nodes.filter(F.col("many") <= arity**level).select("part", F.lit(level).alias("depth"), "hi", "digest")
        tops = top if tops is None else tops.unionByName(top)
        below = nodes.filter(F.col("many") > arity**level).select("part", "many", "lo", "hi", "digest")
        if below.isEmpty():
            return out, materialize(tops, f"{name}-tops")


def attached(nodes: list[DataFrame], tops: DataFrame, arity: int, above: list[str], name: str) -> DataFrame:
    """(row, leaf, path, *above) for every leaf: ``path`` has, from the leaf up,
    what stands left and right of the node in its parent. ``tops`` (part, depth,
    hi, path, *above) say what is above each part."""
    found = None
    for level in range(len(nodes), 0, -1):
        here = tops.filter(F.col("depth") == level).select("part", F.lit(0).cast("bigint").alias("bucket"), F.lit(0).cast("bigint").alias("from"), F.col("hi").alias("to"), "path", *above)
        over = here if found is None else here.unionByName(found)
        inside = (F.col("from") <= F.col("lo")) & (F.col("hi") <= F.col("to"))
        one = nodes[level - 1].drop("digest").join(over, ["part", "bucket"]).filter(inside)
        one = one.select("part", "many", "children", F.explode("children").alias("c"), "path", *above)
        beside = lambda far: F.concat_ws("", F.transform(F.filter("children", far), lambda x: x["digest"]))
        step = F.struct(beside(lambda x: x["hi"] < F.col("c.lo")).alias("left"), beside(lambda x: x["lo"] > F.col("c.hi")).alias("right"))
        path = F.when(F.col("many") == 1, F.col("path")).otherwise(F.concat(F.array(step), F.col("path")))
        if level == 1:
            return one.select(F.col("c.row").alias("row"), F.col("c.digest").alias("leaf"), path.alias("path"), *above)
        bucket = F.floor(F.col("c.lo") / arity ** (level - 1))
        found = one.select("part", bucket.alias("bucket"), F.col("c.lo").alias("from"), F.col("c.hi").alias("to"), path.alias("path"), *above)
        found = materialize(found, f"{name}-above-{level - 1}")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest gives with the siblings on its path."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    return joined_digest(F.transform(path, lambda step: F.concat(step["left"], step["right"])))


PATH = "array<struct<left:string,right:string>>"


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None, arity: int = 8) -> DataFrame:
    """(row, leaf, path, subroot, root) for every row of ``docs``.

    ``row`` holds the columns of ``carry`` (by default ``order``), ``path`` the
    digests left and right of the leaf and its ancestors; ``folded`` computes a
    root from it. Leaves of a group ascend by ``order`` (null first) and, where
    it is repeated, by their digest; groups ascend bytewise, null first. Null,
    empty and very long values are told apart by their sizes; repeated rows are
    leaves of their own; other columns are ignored; an empty table gives no
    rows and has no root.
    """
    carry = {order: F.col(order)} if carry is None else carry
    part = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    kept = F.struct(*[c.alias(k) for k, c in carry.items()])
    leaves = docs.select(part.alias("part"), F.col(order).alias("at"), leaf_digest([F.col(c) for c in fields]).alias("digest"), kept.alias("row"))
    leaves = ranked(leaves, ["at", "digest"], "merkle-leaves").drop("at")
    nodes, tops = levels(leaves, arity, "merkle")
    subroots = tops.select(F.lit("").alias("part"), F.col("part").alias("group"), "depth", "hi", "digest")
    upper = ranked(subroots, ["group"], "merkle-groups").select("part", "rank", "many", "digest", F.struct("group", "depth", "hi").alias("row"))
    upper_nodes, root = levels(upper, arity, "merkle-upper")
    root = root.select("part", "depth", "hi", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    over = attached(upper_nodes, root, arity, ["root"], "merkle-upper")
    over = materialize(over.select(F.col("row.group").alias("part"), "row.depth", "row.hi", "path", F.col("leaf").alias("subroot"), "root"), "merkle-subroots")
    return attached(nodes, over, arity, ["subroot", "root"], "merkle")


def _levels_sql(source: str, name: str) -> str:
    """Nodes (g, lvl, k, d, c): the k-th of c nodes of a level of tree g."""
    return f"""{name} AS (
  SELECT g, 0 AS lvl, k, d, count(*) OVER (PARTITION BY g) AS c FROM {source}
  UNION ALL
  SELECT g, lvl, k, d, count(*) OVER (PARTITION BY g) FROM (
    SELECT g, lvl + 1 AS lvl, k // 8 AS k, sha256(string_agg(d, '' ORDER BY k)) AS d FROM {name} WHERE c > 1 GROUP BY g, lvl, k // 8)
)"""


def _sides_sql(source: str, nodes: str) -> str:
    """Per leaf (g, k) of a tree and level: what stands left and right."""
    return f"""SELECT s.g, s.k, a.lvl, coalesce(string_agg(b.d, '' ORDER BY b.k) FILTER (b.k < a.k), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.k) FILTER (b.k > a.k), '') AS r
  FROM {source} s JOIN {nodes} a ON a.g = s.g AND a.c > 1 AND a.k = s.k // (8 ** a.lvl)::BIGINT
  JOIN {nodes} b ON b.g = a.g AND b.lvl = a.lvl AND b.k // 8 = a.k // 8 GROUP BY s.g, s.k, a.lvl"""


_LEAF = "sha256(concat({}))".format(", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END" for c in ("doc_id", "source", "lang", "n_chars", "{text}")))


@query("op12_merkle_manifest", oracle=rf"""
WITH RECURSIVE {CRC_SQL}, t AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_LEAF.format(text='text')} AS d,
    CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {_LEAF.format(text=f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed
  FROM documents, crc
), leaf AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS k FROM t),
{_levels_sql('leaf', 'node')},
sub AS (SELECT '' AS g, g AS lang, d, row_number() OVER (ORDER BY g) - 1 AS k FROM node WHERE c = 1),
{_levels_sql('sub', 'up')},
root AS (SELECT d AS root FROM up WHERE c = 1),
low AS ({_sides_sql('leaf', 'node')}),
high AS (SELECT sub.lang, x.* FROM ({_sides_sql('sub', 'up')}) x JOIN sub USING (k)),
step AS (
  SELECT g, k, lvl, l, r FROM low
  UNION ALL SELECT leaf.g, leaf.k, 100 + high.lvl, l, r FROM leaf JOIN high ON high.lang = leaf.g
), path AS (
  SELECT leaf.doc_id, leaf.d, leaf.changed, leaf.g, list({{'l': l, 'r': r}} ORDER BY lvl) FILTER (lvl IS NOT NULL) AS p, coalesce(string_agg(l || r, '' ORDER BY lvl), '') AS proof
  FROM leaf LEFT JOIN step USING (g, k) GROUP BY leaf.doc_id, leaf.d, leaf.changed, leaf.g, leaf.k
), fold AS (
  SELECT doc_id, coalesce(changed, d) AS v, p, 1 AS i FROM path
  UNION ALL SELECT doc_id, sha256(p[i].l || v || p[i].r), p, i + 1 FROM fold WHERE i <= coalesce(len(p), 0)
)
SELECT path.doc_id, path.d AS leaf, sub.d AS subroot, root, sha256(proof) AS proof_sha256, fold.v AS folded_root, fold.v = root AS verified
FROM path JOIN sub ON sub.lang = path.g JOIN fold ON fold.doc_id = path.doc_id AND fold.i = coalesce(len(fold.p), 0) + 1, root""")
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    changed = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]
    altered = F.when(id_fold("doc_id", 3) == 0, leaf_digest(changed))
    out = manifest(docs, carry={"doc_id": F.col("doc_id"), "altered": altered})
    again = out.withColumn("folded_root", folded(F.coalesce("row.altered", "leaf"), F.col("path")))
    return again.select("row.doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
