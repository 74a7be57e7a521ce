"""Exact dedup by deterministic block naming.

A normalised text is cut into blocks of a fixed number of bytes. Blocks are
sorted, and each run of equal ones is named by an integer, the smallest place
at which it stands. Adjacent names are then paired and pairs named in the same
way, again and again, until one name is left of each text. Equal names of a
level stand for equal bytes, so no two texts share an identity by chance: the
hash below only deals the blocks out. Columns and SQL only.

A block that holds many rows is dealt out over salts; the few names that it
gets are brought together by the block itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.llm.common import parts, query, table
from tagloom.session import materialize

BLOCK = 1024  # bytes
HOT_LEAST = 1000  # rows of one block below which it is never salted
NO_NAME = -1  # stands right of a last name without a partner


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null counts as empty."""
    # single spaces, the usual case, stay as they are
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def block_names(texts: DataFrame, block: int) -> DataFrame:
    """(row, i, n, place, name) of every block of (row, n, body): ``i`` is its
    number of ``n`` in the text, ``place`` its own integer."""
    spark = texts.sparkSession
    total = texts.agg(F.sum("n").alias("n")).first()["n"] or 0
    most = max(HOT_LEAST, total // (32 * parts(spark)))  # rows of one block that a task gets
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring("body", i * block + 1, F.lit(block)))
    blocks = texts.select("row", "n", F.posexplode(cut).alias("i", "block")).withColumn("h", F.xxhash64("block"))
    hot = blocks.groupBy("h").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > most)
    hot = materialize(hot.select("h", F.ceil(F.col("rows") / most).alias("salts")), "block-hot")  # at most 32 per partition
    placed = blocks.withColumn("place", F.monotonically_increasing_id()).join(F.broadcast(hot), "h", "left")
    placed = placed.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("row", "i"), F.col("salts")), F.lit(0)))
    name = F.min("place").over(W.partitionBy("h", "salt", "block"))
    first = F.when(F.col("salts").isNotNull() & (F.col("place") == name), F.col("block"))
    named = materialize(placed.select("row", "i", "n", "place", name.alias("name"), first.alias("hot_block")), "block-names")
    # of a salted block: one row per salt
    several = named.filter(F.col("hot_block").isNotNull()).groupBy("hot_block").agg(F.min("name").alias("low"), F.collect_list("name").alias("names"))
    low = materialize(several.select("low", F.explode("names").alias("name")).filter("name <> low"), "block-low")
    return named.drop("hot_block").join(F.broadcast(low), "name", "left").select("row", "i", "n", "place", F.coalesce("low", "name").alias("name"))


def pair_names(names: DataFrame, level: int) -> DataFrame:
    """The next level of (row, i, n, place, name): two adjacent names become one."""
    left, right = F.max(F.when(F.col("i") % 2 == 0, F.col("name"))), F.max(F.when(F.col("i") % 2 == 1, F.col("name")))
    pairs = names.groupBy("row", F.shiftright("i", 1).alias("i")).agg(
        F.shiftright(F.first("n") + 1, 1).alias("n"), F.min("place").alias("place"), left.alias("left"), F.coalesce(right, F.lit(NO_NAME)).alias("right"))
    pairs = materialize(pairs, f"name-pairs-{level}")
    shared = pairs.groupBy("left", "right").agg(F.min("place").alias("name"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    shared = materialize(shared, f"name-shared-{level}")  # a pair that stands once is named by its own place
    named = pairs.join(shared, ["left", "right"], "left").select("row", "i", "n", "place", F.coalesce("name", "place").alias("name"))
    return materialize(named, f"names-{level}")


def identities(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, level, name) for each text of (row, n, body): equal bytes exactly
    where level and name are equal."""
    names, level, out = block_names(texts, block), 0, None
    while True:
        whole = names.filter("n = 1").select("row", F.lit(level).alias("level"), "name")
        out = whole if out is None else out.unionByName(whole)
        names = names.filter("n > 1")
        if names.isEmpty():
            return out
        level += 1
        names = pair_names(names, level)


def exact_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``
    (doc_id, text).

    Texts are equal when they are identical after each run of white space is
    replaced by one space; null counts as empty, and an empty text is a text.
    Of equal texts the row of the smallest doc_id is kept, one row where the id
    is repeated; a null doc_id comes after all others. Other columns are
    ignored; an empty table gives no rows. Ids may be of any type that can be
    ordered.
    """
    text = normalised(F.col("text"))
    read = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.cast("binary").alias("body"))
    size = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / block)).cast("int")
    texts = materialize(read.select("row", "doc_id", size.alias("n"), F.sha2("body", 256).alias("text_sha256"), "body"), "dedup-texts")
    found = materialize(identities(texts.select("row", "n", "body"), block).join(texts.select("row", "doc_id", "text_sha256"), "row"), "dedup-identities")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    groups = found.groupBy("level", "name").agg(first, F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    groups = materialize(groups.select("level", "name", F.col("first.doc_id").alias("keep"), F.col("first.row").alias("keep_row"), "rows"), "dedup-groups")
    joined = found.join(groups, ["level", "name"], "left")
    alone = F.col("rows").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("rows", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256")


@query("op13_block_naming_dedup", oracle=r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
g AS (SELECT x, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)""")
def op13_block_naming_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(table(spark, folder, "documents"))
