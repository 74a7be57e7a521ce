"""File names that do not collide, chosen for a whole table at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.ranking import running_numbers, running_sums
from tagloom.session import materialize

FAMILY = ["stem", "suffix"]  # names of a family differ by their number alone
NUMBER = r"_([1-9][0-9]{0,17})$"


def _parts(path: Column) -> tuple[Column, Column]:
    suffix = F.regexp_extract(path, r"[^/\\.][^/\\]*?(\.[^./\\]+)$", 1)
    return F.substring(path, F.lit(1), F.char_length(path) - F.char_length(suffix)), suffix


def _numbered(names: DataFrame) -> DataFrame:
    """Those of ``names(path, ...)`` that end in a number, with the family and
    the number ``k`` that they are of."""
    stem, suffix = _parts(F.col("path"))
    rows = names.withColumns({"stem": stem, "suffix": suffix}).withColumn("k", F.regexp_extract("stem", NUMBER, 1)).filter("k <> ''")
    return rows.withColumns({"stem": F.regexp_replace("stem", NUMBER, ""), "k": F.col("k").cast("bigint")})


def _allocated(requests: DataFrame, obstacles: DataFrame) -> DataFrame:
    """(stem, suffix, at, k): for each request, in the order of ``at``, the
    smallest number of its family that is free then.

    ``obstacles(stem, suffix, k, since)`` are numbers taken from the beginning
    (NULL) or from a time on. A number once taken stays so, hence a family's
    numbers ascend, and request j would meet the obstacle k when j = k - (those
    below k that block). It blocks if it is the older one. Each pass settles at
    least the smallest open obstacle of every family; the requests then fall
    into the gaps.
    """
    turns = running_numbers(requests.select(*FAMILY, "at"), FAMILY, ["at"], "j").withColumn("j", F.col("j") + 1)
    turns = materialize(turns, "name-turns")
    flags = obstacles.withColumn("blocks", F.col("since").isNull())
    while True:
        met = running_sums(flags, FAMILY, ["k"], F.col("blocks").cast("bigint"), "below").withColumn("j", F.col("k") - F.col("below"))
        met = met.join(turns.withColumnRenamed("at", "turn"), [*FAMILY, "j"], "left")
        now = F.col("since").isNull() | F.coalesce(F.col("since") < F.col("turn"), F.lit(False))
        met = materialize(met.select(*FAMILY, "k", "since", "j", "blocks", now.alias("now")), "name-obstacles")
        flags = met.select(*FAMILY, "k", "since", F.col("now").alias("blocks"))
        if met.filter("blocks <> now").isEmpty():
            break
    gaps = met.filter("now").select(*FAMILY, "j", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("at"))
    merged = gaps.unionByName(turns.select(*FAMILY, "j", F.lit(1).alias("kind"), "at"))
    placed = running_numbers(merged, FAMILY, ["j", "kind"], "k")  # the gaps before a request push its number up
    return placed.filter("kind = 1").select(*FAMILY, "at", (F.col("k") + 1).alias("k"))


def conflict_free_names(requests: DataFrame, taken: DataFrame, order: str, target: str, name: str = "name") -> DataFrame:
    """``requests`` with a ``name`` each, all distinct and none in ``taken(path)``.

    As if one by one, in the order of the unique BIGINT column ``order``: the
    target itself if it is free, else the target with the first free number,
    ``stem_1.suffix``, ``stem_2.suffix``, .... Numbered names meet targets of
    the same table and existing paths like any other name. A NULL target gets
    no name. Hot targets are numbered by many tasks. Passes repeat while a name
    given by number turns out to be a target that comes later, at most once per
    number nested in a target.
    """
    wanted = requests.filter(F.col(target).isNotNull()).select(F.col(order).cast("bigint").alias("at"), F.col(target).alias("path"))
    stem, suffix = _parts(F.col("path"))
    wanted = materialize(wanted.withColumns({"stem": stem, "suffix": suffix}), "name-requests")
    firsts = materialize(wanted.groupBy("path", *FAMILY).agg(F.min("at").alias("first")), "name-firsts")
    taken = taken.select("path").filter("path IS NOT NULL").distinct()
    gone = materialize(firsts.join(taken, "path", "left_semi").select("path"), "name-gone")
    static = _numbered(taken).withColumn("since", F.lit(None).cast("bigint"))
    literal = _numbered(firsts.select("path", "first")).withColumnRenamed("first", "since")
    both = static.select(*FAMILY, "k", "since", F.lit(0).alias("o")).unionByName(literal.select(*FAMILY, "k", "since", F.lit(1).alias("o")))
    obstacles = both.groupBy(*FAMILY, "k").agg(F.min_by("since", "o").alias("since"))
    obstacles = materialize(obstacles.join(firsts.select(*FAMILY), FAMILY, "left_semi"), "name-obstacles-0")
    lost = gone  # targets that their first request does not get
    while True:
        own = firsts.join(lost, "path", "left_anti").select("path", F.col("first").alias("at"))
        numbered = wanted.join(own, ["path", "at"], "left_anti")
        given = materialize(_allocated(numbered, obstacles), "names-given")
        late = literal.join(given, [*FAMILY, "k"]).filter(F.col("at") < F.col("since")).select("path")
        now = materialize(gone.unionByName(late).distinct(), "name-lost")
        if now.join(lost, "path", "left_anti").isEmpty() and lost.join(now, "path", "left_anti").isEmpty():
            break
        lost = now
    names = own.select("at", F.col("path").alias(name)).unionByName(given.select("at", F.concat("stem", F.lit("_"), "k", "suffix").alias(name)))
    return requests.join(names.withColumnRenamed("at", "_at"), F.col(order) == F.col("_at"), "left").drop("_at")
