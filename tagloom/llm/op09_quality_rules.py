"""Quality rules: fixed counts, then robust multivariate outliers.

Transformed statistics of each text form a vector; per language and source the
minimum-covariance-determinant centre and scatter are estimated by
concentration steps (the rows nearest to the current centre give the next
one) from two starts until the determinant falls no more, and vectors too far
by Mahalanobis distance are rejected. A pair of few rows is judged by its
language, and a language of few rows by all, so that every row is judged.
Columns and SQL only: arrays inside a text, aggregates between texts.
Quantiles are read from histograms of fixed bins, which are the same however
the rows are dealt out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.llm.common import query, table
from tagloom.session import materialize

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
VECTOR = ("x0", "x1", "x2", "x3", "x4")
SHARE = 0.6  # of a group's rows that concentration steps keep
STEPS = 50  # of concentration at most; they end when no determinant falls
FALL = 1e-9  # of a log-determinant that counts
LEAST = 50  # rows of a pair or language with an estimate of its own
BINS = 1000  # of a histogram in a unit of its value, or in a factor of e
FLOOR = (0.3, 0.1, 0.4, 0.4, 0.4)  # standard deviations that the estimate is not to go below
CHI_MEDIAN = 4.351  # median of chi-square with five degrees of freedom
CHI_FAR = 20.515  # its 0.999 quantile, the least squared distance to be rejected
NORMAL_FAR = 3.0902  # the normal's 0.999 quantile


def counted(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = lambda a: F.transform(a, lambda x: F.xxhash64(x))
    first = docs.withColumns({
        "_words": F.when(F.btrim(text, F.lit(SPACE)) == "", F.array().cast("array<bigint>")).otherwise(hashed(F.split(F.btrim(text, F.lit(SPACE)), "[\\x20\\x09-\\x0D]+"))),
        "_lines": hashed(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")),
        "word_chars": F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("bigint"),
    }).drop("text")
    n = F.size("_words")
    at = lambda name, i: F.get(F.col(name), i)
    windows = F.transform(F.slice("_words", 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, at("_words", i + 1), at("_words", i + 2)))
    second = first.select("*", n.cast("bigint").alias("n_words"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"), windows.alias("_windows"))
    third = second.withColumn("_some", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    # texts with a repeated window: windows in hash order, those beside an equal one, by place
    order = F.array_sort(F.transform(F.when(F.col("_some"), F.col("_windows")), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    fourth = third.withColumn("_order", order).drop("_windows", "_words", "_lines")
    same = F.filter("_order", lambda p, i: (p["x"] == F.get(F.col("_order"), i - 1)["x"]) | (p["x"] == F.get(F.col("_order"), i + 1)["x"]))
    fifth = fourth.withColumn("_places", F.array_sort(F.transform(same, lambda p: p["i"]))).drop("_order")
    steps = F.transform("_places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("_places"), i + 1) - p, F.lit(3))))
    total = F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return fifth.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("bigint"))).drop("_places", "_some")


def vector(rows: DataFrame) -> DataFrame:
    """The transformed statistics, on scales where clean texts spread evenly."""
    some = F.greatest(F.col("n_words"), F.lit(1))
    return rows.withColumns({
        "x0": F.log1p("n_words"), "x1": F.log1p(F.col("word_chars") / some), "x2": F.log1p(1000 * F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        "x3": F.log1p(20 * F.col("n_repeat_words") / some), "x4": F.log1p("n_dup_lines"),
    })


def _solved(moments: DataFrame) -> DataFrame:
    """Centre m0.. and inverse Cholesky factor: from (group, n, s_i, s_ij) the
    columns m_i and l_ij with covariance = L L', floors on the diagonal."""
    d = range(len(VECTOR))
    out = moments.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in d})
    for i in d:
        for j in range(i + 1):
            cov = F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")
            if i == j:
                cov = F.greatest(cov, F.lit(0.0)) + FLOOR[i] ** 2
            part = cov
            for k in range(j):
                part = part - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(part, F.lit(FLOOR[i] ** 2 / 4))) if i == j else part / F.col(f"l{j}{j}"))
    return out.select("group", "n", *[f"m{i}" for i in d], *[f"l{i}{j}" for i in d for j in range(i + 1)])


def _with_distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    d = range(len(VECTOR))
    for i in d:
        z = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}{k}") * F.col(f"z{k}")
        rows = rows.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
    total = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in d[1:]), F.col("z0") * F.col("z0"))
    return rows.withColumn("d2", total).drop(*[f"z{i}" for i in d])


def _moments(rows: DataFrame) -> DataFrame:
    d = range(len(VECTOR))
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in d] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i in d for j in range(i + 1)]
    return rows.groupBy("group").agg(F.count(F.lit(1)).cast("double").alias("n"), *sums)


def _measured(rows: DataFrame, shape: DataFrame) -> DataFrame:
    names = [c for c in shape.columns if c != "group"]
    return _with_distance(rows.join(shape, "group")).drop(*names)


def _bin(value: Column, logarithm: bool = False) -> Column:
    return F.floor((F.ln(value + 1e-9) if logarithm else value) * BINS).cast("int")


def _quantiles(rows: DataFrame, key: list[str], bin: Column, shares: tuple[float, ...]) -> DataFrame:
    """Per key the first bins q0, q1, ... up to which lie the shares of its rows."""
    counts = rows.groupBy(*key, bin.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.partitionBy(*key).orderBy("bin"))  # as many rows as there are bins
    total = F.sum("c").over(W.partitionBy(*key))
    counts = counts.select(*key, "bin", upto.alias("upto"), total.alias("total"))
    return counts.groupBy(*key).agg(*[F.min(F.when(F.col("upto") >= s * F.col("total"), F.col("bin"))).alias(f"q{i}") for i, s in enumerate(shares)])


def _middle(bin: str, logarithm: bool = False) -> Column:
    value = (F.col(bin) + 0.5) / BINS
    return F.exp(value) if logarithm else value


QUARTERS = (0.25, 0.5, 0.75)


def _from_quartiles(rows: DataFrame) -> DataFrame:
    """Start at the medians, spread by the quartiles, without covariances."""
    d = range(len(VECTOR))
    values = rows.select("group", F.posexplode(F.array(*VECTOR)).alias("i", "x"))
    found = _quantiles(values, ["group", "i"], _bin(F.col("x")), QUARTERS)
    spread = (_middle("q2") - _middle("q0")) / 1.349
    wide = found.groupBy("group").agg(*[x for i in d for x in (F.max(F.when(F.col("i") == i, _middle("q1"))).alias(f"m{i}"), F.max(F.when(F.col("i") == i, spread)).alias(f"w{i}"))])
    cells = [(F.greatest(F.col(f"w{i}"), F.lit(FLOOR[i])) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in d for j in range(i + 1)]
    return wide.select("group", F.lit(0.0).alias("n"), *[f"m{i}" for i in d], *cells)


def _log_determinant() -> Column:
    return 2 * sum((F.ln(f"l{i}{i}") for i in range(1, len(VECTOR))), F.ln("l00"))


def _concentrated(rows: DataFrame, start: DataFrame, name: str) -> DataFrame:
    """``start`` after concentration steps, per group the shape of the least
    determinant, with that as ``det``."""
    best, shape = None, materialize(start, f"outlier-{name}")
    for step in range(STEPS):
        far = _measured(rows, shape).withColumn("bin", _bin(F.col("d2"), True))
        limit = materialize(_quantiles(far, ["group"], F.col("bin"), (SHARE,)), f"outlier-{name}-limit-{step}")
        near = far.join(limit, "group").filter("bin <= q0")
        shape = _solved(_moments(near)).withColumn("det", _log_determinant())
        if best is not None:
            old = best.select("group", F.col("det").alias("_old"), F.struct(*best.columns).alias("_best"))
            both = shape.select("group", F.struct(*best.columns).alias("_new"), "det").join(old, "group")
            falls = F.col("det") < F.col("_old") - FALL
            shape = both.select(F.when(falls, F.col("_new")).otherwise(F.col("_best")).alias("s"), falls.alias("falls")).select("s.*", "falls")
        shape = materialize(shape, f"outlier-{name}-{step}")
        if best is not None and shape.filter("falls").isEmpty():
            return best
        best = shape = shape.drop("falls")
    return best


def shapes(rows: DataFrame) -> DataFrame:
    """Centre, factor, scale and cut per group of (group, x0..x4).

    Concentration steps run from the medians and from the mean of all rows;
    the lesser determinant stays. ``scale``, at least one, corrects for the
    rows that the estimate left out. Cube roots of chi-square values are close
    to normal: ``cut`` is the 0.999 quantile of the normal with the median and
    quartiles of the cube roots of the group's own squared distances, at least
    that of chi-square."""
    starts = [_from_quartiles(rows), _solved(_moments(rows))]
    # both starts of a group take their steps together, under names of their own
    own = [F.concat(F.lit(f"{o} "), F.col("group")) for o in range(len(starts))]
    start = reduce(DataFrame.unionByName, [s.withColumn("group", name) for s, name in zip(starts, own)])
    found = _concentrated(rows.withColumn("group", F.explode(F.array(*own))), start, "steps")
    found = found.select(F.substring("group", 1, 1).alias("_o"), F.expr("substring(group, 3)").alias("group"), *[c for c in found.columns if c != "group"])
    names = [c for c in found.columns if c not in ("group", "det", "_o")]
    best = found.groupBy("group").agg(F.min_by(F.struct(*names), F.struct("det", "_o")).alias("s"))
    shape = materialize(best.select("group", "s.*"), "outlier-shape")
    quarters = _quantiles(_measured(rows, shape), ["group"], _bin(F.col("d2"), True), QUARTERS)
    q = [_middle(f"q{i}", True) for i in range(3)]
    scale = quarters.withColumn("scale", F.greatest(q[1] / CHI_MEDIAN, F.lit(1.0)))
    root = [F.cbrt(x / F.col("scale")) for x in q]
    far = F.pow(root[1] + NORMAL_FAR * (root[2] - root[0]) / 1.349, F.lit(3.0))
    scale = scale.select("group", "scale", F.greatest(far, F.lit(CHI_FAR)).alias("cut"))
    return shape.drop("n").join(scale, "group")


def _groups(rows: DataFrame) -> DataFrame:
    """(lang, source, group, parts) of the pairs: the group that judges a pair,
    and those whose estimate its rows take part in. A pair or language of at
    least LEAST rows is a group; all rows are one if anything else needs it."""
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.groupBy("lang").agg(F.sum("n").alias("lang_n"), (F.min("n") < LEAST).alias("lang_used"))
    both = sizes.alias("s").join(total.alias("t"), F.col("s.lang").eqNullSafe(F.col("t.lang"))).select("s.lang", "s.source", "n", "lang_n", "lang_used")
    needed = total.filter((F.col("lang_n") < LEAST) & F.col("lang_used")).limit(1).select(F.lit("all").alias("every"))
    pair, language = F.concat(F.lit("pair "), F.to_json(F.struct("lang", "source"))), F.concat(F.lit("language "), F.to_json(F.struct("lang")))
    own, wide = F.col("n") >= LEAST, F.col("lang_n") >= LEAST
    both = both.join(needed, F.lit(True), "left")  # one row at most
    parts = F.array_compact(F.array(F.when(own, pair), F.when(wide & F.col("lang_used"), language), F.col("every")))
    return materialize(both.select("lang", "source", F.when(own, pair).when(wide, language).otherwise("all").alias("group"), parts.alias("parts")), "rule-groups")


def judged(docs: DataFrame, cut: float | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, lang, source) with its counts,
    base_failed, the squared distance (null where the base failed) and kept.
    ``cut`` replaces the groups' own cuts.

    Null and empty texts have no words and fail the base. A null language or
    source is a value of its own. A pair of fewer than LEAST rows is judged by
    the estimate of its language, and that of a smaller language by all rows,
    however few these are. Repeated rows get a row each and all count; other
    columns are ignored.
    """
    slim = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = materialize(vector(counted(slim)).withColumn("base_failed", failed), "rule-counts")
    passed = rows.filter(~F.col("base_failed"))
    names = _groups(passed)

    def with_group(some: DataFrame, how: str) -> DataFrame:
        same = F.col("r.lang").eqNullSafe(F.col("g.lang")) & F.col("r.source").eqNullSafe(F.col("g.source"))
        return some.alias("r").join(names.alias("g"), same, how).select("r.*", "g.group", "g.parts")

    spread = with_group(passed, "inner").select(F.explode("parts").alias("group"), *VECTOR)
    shape = materialize(shapes(spread), "rule-shapes")
    out = _with_distance(with_group(rows, "left").join(shape, "group", "left"))
    d2 = F.when(~F.col("base_failed"), F.col("d2") / F.col("scale"))
    kept = ~F.col("base_failed") & (d2 <= (F.col("cut") if cut is None else F.lit(cut)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", d2.alias("distance"), F.coalesce(kept, F.lit(False)).alias("kept"))


@query("op9_robust_outlier_rules")
def op9_robust_outlier_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return judged(docs).drop("distance")
