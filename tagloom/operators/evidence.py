"""From ranked matches to entity names.

``queries(query_id, image_id, region, weight, embedding)`` - region 0 is the
full image; ``refs(row_index, character_id, character_name, embedding)``.
Groups per image stay small: an image has a few regions and each brings at
most ``candidate_limit`` matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.functions import vectors as V
from tagloom.operators.retrieval import BROADCAST_BYTES, reference_count, vector_topk
from tagloom.session import materialize, small_side

# Fixed values of the ranking rules.
MIN_CANDIDATES, CANDIDATES_PER_K = 96, 64
REGION_SUPPORT_RATIO, REGION_BONUS, REGION_BONUS_MAX = 0.92, 0.03, 2
ROW_BONUS, ROW_BONUS_MAX = 0.012, 3
SINGLE_REFERENCE_FACTOR, WEAK_HEAD = 0.93, 0.62
SECONDARY_RATIO = 0.70
LIBRARY_STEPS = ((2000, 0.06), (1000, 0.04))
REGION_REUSE_RATIO = 0.92
FEATURE_VALUES = 20  # of a library row besides style and face, names counted as four


def candidate_limit(top_k: int) -> int:
    return max(MIN_CANDIDATES, CANDIDATES_PER_K * max(1, top_k))


def attribute_profile(refs: DataFrame, spec: V.AttributeSpec) -> DataFrame:
    """Per entity: dominant hair and eye groups over its references.

    Reduced to distinct (entity, group) before grouping, so the arrays are no
    longer than the group vocabulary.
    """
    rows = V.with_attribute_features(refs.select("character_id", "embedding"), "embedding", "f", spec).select(
        "character_id",
        V.dominant_group(F.col("f"), "hair").alias("hair"),
        V.dominant_group(F.col("f"), "eyes").alias("eyes"),
    )
    pairs = rows.distinct().groupBy("character_id")
    keep = lambda c: F.sort_array(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    sets = pairs.agg(keep("hair").alias("hair_groups"), keep("eyes").alias("eye_groups"))
    return sets.filter((F.size("hair_groups") > 0) | (F.size("eye_groups") > 0))


def profile_join(matches: DataFrame, profiles: DataFrame) -> DataFrame:
    return matches.join(profiles, "character_id", "left")


def match_scores(
    queries: DataFrame, refs: DataFrame, spec: V.AttributeSpec, top_k: int, profiles: DataFrame | None = None, limits: DataFrame | None = None
) -> DataFrame:
    """(image_id, region, character_id, character_name, row_index, score) of re-scored matches.

    ``limits(image_id, minimum, top_k)`` gives each image its own number of
    candidates (at most that of ``top_k``); its columns are kept."""
    q = V.with_attribute_features(queries.filter(F.col("weight") > 0), "embedding", "q", spec)
    # what goes along with every match is as narrow as the pair terms allow
    q = q.select("query_id", "image_id", "region", "weight", V.strong_details(F.col("q")).alias("q"), "embedding")
    matches = vector_topk(q, refs, candidate_limit(top_k), min_similarity=0.0).drop("embedding")
    carry = []
    if limits is not None:
        carry = ["minimum", "top_k"]
        own = F.greatest(F.lit(MIN_CANDIDATES), CANDIDATES_PER_K * F.col("top_k"))
        matches = matches.join(limits.select("image_id", *carry), "image_id").filter(F.col("rank") <= own)
    # everything about the library in one table, so matches meet one join
    named = refs.filter((F.trim("character_name") != "") & (F.trim("character_id") != ""))
    profiles = attribute_profile(refs, spec) if profiles is None else profiles
    library = V.with_attribute_features(named, "embedding", "r", spec)
    library = profile_join(library.select("row_index", "character_id", "character_name", "r"), profiles)
    library = small_side(library, "library-features")
    # below the size at which the vectors went to every executor, their features
    # do too and no match moves; beyond, matches are dealt out but not sorted
    held = library.count() * 8 * (len(spec.style) + len(spec.face) + FEATURE_VALUES)
    rows = matches.join(F.broadcast(library) if held <= BROADCAST_BYTES else library.hint("shuffle_hash"), "row_index")
    hair, eyes = V.dominant_group(F.col("q"), "hair"), V.dominant_group(F.col("q"), "eyes")
    factor = V.correlation_multiplier(
        hair, F.col("q.hair_best"), eyes, F.col("q.eyes_best"), F.col("hair_groups"), F.col("eye_groups")
    )
    adjustment = V.attribute_adjustment(F.col("q"), F.col("r"), strong=True)
    score = V.region_adjust_weight(F.col("similarity") * factor, adjustment, F.col("weight"))
    scored = rows.select("image_id", "region", "character_id", "character_name", "row_index", score.alias("score"), *carry)
    return scored.filter(F.col("score") > 0)


def character_evidence(matches: DataFrame, floor: float | Column) -> DataFrame:
    """One row per (image, entity); a single shuffle on that pair. The limits
    of the image, where the matches hold them, are kept."""
    carry = [c for c in ("minimum", "top_k") if c in matches.columns]
    head = F.col("region") > 0
    least = (floor if isinstance(floor, Column) else F.lit(floor)) * REGION_SUPPORT_RATIO
    support = F.when(head & (F.col("score") >= least), F.col("region"))
    best_head = F.max(F.when(head, F.struct(F.col("score"), (-F.col("region")).alias("neg"))))
    rows = matches.groupBy("image_id", "character_id", *carry).agg(
        F.max("character_name").alias("character_name"),
        F.max("score").alias("best_score"),
        best_head.alias("h"),
        F.size(F.collect_set(support)).alias("supported_regions"),
        F.size(F.collect_set("row_index")).alias("reference_rows"),
    )
    return rows.select(
        "image_id",
        "character_id",
        "character_name",
        "best_score",
        F.coalesce("h.score", F.lit(0.0)).alias("best_head_score"),
        F.coalesce(-F.col("h.neg"), F.lit(-1)).alias("best_head_region"),
        "supported_regions",
        "reference_rows",
        *carry,
    )


def evidence_score(evidence: DataFrame, counts: DataFrame, heads: DataFrame, top_k: int | Column) -> DataFrame:
    """Add ``score``; ``counts`` are references per entity, ``heads`` regions per image."""
    rows = evidence.join(small_side(counts, "reference-counts"), "character_id", "left").join(heads, "image_id", "left")
    regions, refs = F.col("supported_regions"), F.col("reference_rows")
    score = (
        F.col("best_score")
        + F.when(regions >= 2, F.least(F.lit(REGION_BONUS_MAX), regions - 1) * REGION_BONUS).otherwise(F.lit(0.0))
        + F.when(refs >= 2, F.least(F.lit(ROW_BONUS_MAX), refs - 1) * ROW_BONUS).otherwise(F.lit(0.0))
    )
    weak = (
        (top_k > 1 if isinstance(top_k, Column) else F.lit(top_k > 1))
        & (F.coalesce("head_regions", F.lit(0)) >= 2)
        & (F.coalesce("reference_count", F.lit(1)) <= 1)
        & (F.col("best_head_score") < WEAK_HEAD)
    )
    return rows.withColumn("score", F.round(F.when(weak, score * SINGLE_REFERENCE_FACTOR).otherwise(score), 9))


def ranked(scores: DataFrame) -> DataFrame:
    order = W.partitionBy("image_id").orderBy(F.desc("score"), "character_id")
    return scores.withColumn("rank", F.row_number().over(order))


def top2_margin(scores: DataFrame, minimum: float, margin: float) -> DataFrame:
    """Single mode: the best entity if it clears the minimum and the margin."""
    best2 = ranked(scores).filter(F.col("rank") <= 2).groupBy("image_id").agg(
        F.max_by("character_id", -F.col("rank")).alias("character_id"),
        F.max_by("character_name", -F.col("rank")).alias("character_name"),
        F.max("score").alias("score"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
    )
    gap = F.col("second").isNull() | (F.col("score") - F.col("second") >= margin)
    return best2.filter((F.col("score") >= minimum) & gap).drop("second")


def secondary_ratio(library_rows: Column) -> Column:
    result = F.lit(SECONDARY_RATIO)
    steps = F.when(library_rows >= LIBRARY_STEPS[0][0], F.lit(SECONDARY_RATIO + LIBRARY_STEPS[0][1]))
    for rows, delta in LIBRARY_STEPS[1:]:
        steps = steps.when(library_rows >= rows, F.lit(SECONDARY_RATIO + delta))
    return steps.otherwise(result)


def relative_cutoff(scores: DataFrame, minimum: float | Column, library_rows: int) -> DataFrame:
    """Multi mode: keep scores near enough to the image's best."""
    best = F.max("score").over(W.partitionBy("image_id"))
    minimum = minimum if isinstance(minimum, Column) else F.lit(minimum)
    required = F.greatest(minimum, F.col("best") * secondary_ratio(F.lit(library_rows)))
    rows = scores.withColumn("best", best)
    return rows.filter((F.col("best") >= minimum) & (F.col("score") >= required))


def region_exclusive_select(candidates: DataFrame, top_k: int | Column) -> DataFrame:
    """Greedy choice: an entity whose head region is taken is skipped unless its
    head score is near the best score. (image_id, rank, character_id, character_name)

    A column ``top_k`` has one value per image."""
    item = F.struct(
        (-F.col("score")).alias("neg"), "character_id", "character_name",
        F.col("best_head_region").cast("int").alias("region"), F.col("best_head_score").alias("head"),
    )
    lists = candidates.groupBy("image_id").agg(
        F.sort_array(F.collect_list(item)).alias("list"), F.max("score").alias("best"), F.max(top_k if isinstance(top_k, Column) else F.lit(top_k)).alias("most")
    )
    start = F.struct(
        F.array().cast("array<struct<character_id:string,character_name:string>>").alias("chosen"),
        F.array().cast("array<int>").alias("used"),
    )

    def step(acc: Column, c: Column, best: Column, most: Column) -> Column:
        taken = (c["region"] > 0) & F.array_contains(acc["used"], c["region"])
        skip = (F.size(acc["chosen"]) >= most) | (taken & (c["head"] < best * REGION_REUSE_RATIO))
        pick = F.array(F.struct(c["character_id"].alias("character_id"), c["character_name"].alias("character_name")))
        return F.when(skip, acc).otherwise(
            F.struct(
                F.concat(acc["chosen"], pick).alias("chosen"),
                F.when(c["region"] > 0, F.concat(acc["used"], F.array(c["region"]))).otherwise(acc["used"]).alias("used"),
            )
        )

    folded = F.aggregate(F.col("list"), start, lambda acc, c: step(acc, c, F.col("best"), F.col("most")))
    chosen = lists.select("image_id", folded["chosen"].alias("chosen"))
    return chosen.select("image_id", F.posexplode("chosen").alias("rank", "c")).select(
        "image_id", (F.col("rank") + 1).alias("rank"), "c.character_id", "c.character_name"
    )


def resolve_characters(
    queries: DataFrame,
    refs: DataFrame,
    spec: V.AttributeSpec,
    minimum: float,
    top_k: int = 1,
    margin: float = 0.0,
    profiles: DataFrame | None = None,
) -> DataFrame:
    """Weighted region queries -> (image_id, rank, character_id, character_name)."""
    top_k = max(1, top_k)
    refs = small_side(refs, "library")  # read for the match, the features, the profiles and the counts
    heads = queries.groupBy("image_id").agg((F.count(F.lit(1)) - 1).alias("head_regions"))
    evidence = character_evidence(match_scores(queries, refs, spec, top_k, profiles), max(0.0, minimum))
    scores = evidence_score(evidence, reference_count(refs), heads, top_k)
    if top_k <= 1:
        best = top2_margin(scores, minimum, margin)
        return best.select("image_id", F.lit(1).alias("rank"), "character_id", "character_name")
    return region_exclusive_select(relative_cutoff(scores, minimum, refs.count()), top_k)


def resolve_by_image(
    queries: DataFrame, refs: DataFrame, spec: V.AttributeSpec, limits: DataFrame, margin: float = 0.0, profiles: DataFrame | None = None
) -> DataFrame:
    """As ``resolve_characters``, with ``limits(image_id, minimum, top_k)`` per
    image, for instance from ``tags.effective_threshold`` and
    ``tags.effective_top_k``; images without limits are left out."""
    limits = limits.select("image_id", F.greatest(F.lit(0.0), F.col("minimum")).alias("minimum"), F.greatest(F.lit(1), F.col("top_k").cast("int")).alias("top_k"))
    limits = materialize(limits, "resolve-limits")
    most = limits.agg(F.max("top_k")).first()[0] or 1
    refs = small_side(refs, "library")  # read for the match, the features, the profiles and the counts
    heads = queries.groupBy("image_id").agg((F.count(F.lit(1)) - 1).alias("head_regions"))
    evidence = character_evidence(match_scores(queries, refs, spec, most, profiles, limits), F.col("minimum"))
    scores = materialize(evidence_score(evidence, reference_count(refs), heads, F.col("top_k")), "resolve-scores")
    one = top2_margin(scores.filter("top_k = 1"), 0.0, margin).join(limits, "image_id").filter("score >= minimum")
    one = one.select("image_id", F.lit(1).alias("rank"), "character_id", "character_name")
    many = relative_cutoff(scores.filter("top_k > 1"), F.col("minimum"), refs.count())
    return one.unionByName(region_exclusive_select(many, F.col("top_k")))
