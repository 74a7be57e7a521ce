"""Vector arithmetic and attribute terms as Column expressions in DOUBLE."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 for empty, unequal or zero vectors."""
    size = norm(a) * norm(b)
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (size > 0)
    return F.when(usable, dot(a, b) / size).otherwise(F.lit(0.0))


def l2_normalize(v: Column, zero_to_null: bool = False) -> Column:
    zero = F.lit(None) if zero_to_null else F.transform(v, lambda x: x.cast("double"))
    return let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(zero))


def tag_score_at(v: Column, position: int | Column) -> Column:
    """Score at a vocabulary position, clipped to 0..1, 0 when out of range."""
    at = F.lit(position) if isinstance(position, int) else position
    raw = F.when(at >= 0, F.get(v, at)).cast("double")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(raw, F.lit(0.0))))


def scores_at(v: Column, positions: list[int]) -> Column:
    """Clipped scores at a list of positions; one expression whatever its length."""
    return F.transform(F.array(*[F.lit(p) for p in positions]), lambda p: tag_score_at(v, p))


def max_group_score(v: Column, positions: list[int]) -> Column:
    return F.array_max(scores_at(v, positions)) if positions else F.lit(0.0)


def dominant_index(scores: Column, min_score: float) -> Column:
    """0-based place of the best score, first one on ties, NULL below the minimum."""
    best = F.array_max(scores)
    return F.when((best >= min_score) & (best > 0), F.array_position(scores, best).cast("int") - 1)


@dataclass(frozen=True)
class AttributeSpec:
    """Vocabulary positions and groups of the attributes used in re-scoring."""

    hair: list[tuple[str, int, str]] = field(default_factory=list)
    eyes: list[tuple[str, int, str]] = field(default_factory=list)
    style: list[int] = field(default_factory=list)
    face: list[int] = field(default_factory=list)
    multi_person: list[int] = field(default_factory=list)
    closed_eyes: int | None = None


# Fixed values of the attribute terms.
STRONG_QUERY, REFERENCE_MATCH, REFERENCE_MISS, MAX_ADJUSTMENT = 0.55, 0.42, 0.18, 0.28
HAIR_BONUS, HAIR_PENALTY, EYE_BONUS, EYE_PENALTY = 0.11, 0.30, 0.08, 0.22
STYLE_BONUS, STYLE_PENALTY, FACE_BONUS, FACE_PENALTY = 0.035, 0.050, 0.120, 0.120
FACE_QUERY, FACE_MATCH, FACE_MISS = 0.25, 0.28, 0.10


def _best(scores: Column, tags: list[tuple[str, int, str]], name: str) -> list[Column]:
    ranked = F.sort_array(scores, asc=False)
    place = F.array_position(scores, F.array_max(scores)).cast("int")
    groups = F.array(*[F.lit(g) for _, _, g in tags]) if tags else F.array(F.lit(""))
    return [
        place.alias(f"{name}_place"),
        F.get(ranked, F.lit(0)).alias(f"{name}_best"),
        F.get(ranked, F.lit(1)).alias(f"{name}_second"),
        F.coalesce(F.get(groups, place - 1), F.lit("")).alias(f"{name}_group"),
    ]


def with_attribute_features(df: DataFrame, vector: str, name: str, spec: AttributeSpec) -> DataFrame:
    """Add a struct of everything the pair terms need from one vector.

    Built once per row before the join, so a match costs a few comparisons
    and no second walk over two whole vectors. The score arrays are columns
    of their own first: Catalyst then evaluates each only once.
    """
    v = F.col(vector)
    empty = F.array().cast("array<double>")
    pick = lambda tags: scores_at(v, [p for _, p, _ in tags]) if len(tags) >= 2 else F.array(F.lit(0.0), F.lit(0.0))
    closed = tag_score_at(v, spec.closed_eyes) if spec.closed_eyes is not None else F.lit(0.0)
    arrays = {
        "_hair": pick(spec.hair),
        "_eyes": pick(spec.eyes),
        "_style": scores_at(v, spec.style) if spec.style else empty,
        "_face": scores_at(v, spec.face) if spec.face else empty,
        "_multi": max_group_score(v, spec.multi_person),
    }
    features = F.struct(
        F.size(v).alias("dim"),
        *_best(F.col("_hair"), spec.hair, "hair"),
        *_best(F.col("_eyes"), spec.eyes, "eyes"),
        F.col("_style").alias("style"),
        F.col("_face").alias("face"),
        F.col("_multi").alias("multi"),
        closed.alias("closed"),
    )
    return df.withColumns(arrays).withColumn(name, features).drop(*arrays)


def exclusive_term(q: Column, r: Column, name: str, bonus: float, penalty: Column) -> Column:
    q_best, r_best = q[f"{name}_best"], r[f"{name}_best"]
    q_group, r_group = q[f"{name}_group"], r[f"{name}_group"]
    confidence = F.greatest(F.lit(0.0), q_best - q[f"{name}_second"])
    low = F.least(q_best, r_best)
    return (
        F.when((q_best < STRONG_QUERY) | (confidence < 0.10) | (r_best < REFERENCE_MATCH), F.lit(0.0))
        .when(q[f"{name}_place"] == r[f"{name}_place"], low * bonus)
        .when((q_group != "") & (q_group == r_group), low * bonus * 0.80)
        .when((q_group == "multi") | (r_group == "multi"), F.lit(0.0))
        .otherwise(-penalty * low * F.least(F.lit(1.0), confidence + 0.35))
    )


def detail_term(
    q: Column,
    r: Column,
    bonus: float,
    penalty: Column,
    query_min: float = STRONG_QUERY,
    match_min: float = REFERENCE_MATCH,
    miss_max: float = REFERENCE_MISS,
) -> Column:
    """Bonus for strong query tags the reference shares, penalty for missing ones."""

    def one(x: Column, y: Column) -> Column:
        return (
            F.when(x < query_min, F.lit(0.0))
            .when(y >= match_min, F.least(x, y) * bonus)
            .when(y <= miss_max, -penalty * x)
            .otherwise(F.lit(0.0))
        )

    return F.aggregate(F.zip_with(q, r, one), F.lit(0.0), lambda s, x: s + x)


def strong_details(q: Column) -> Column:
    """A query's feature struct with only those style and face scores that a pair
    can gain or lose by, and their places: a row that goes along with each match
    of the query is a third as long."""

    def strong(name: str, least: float) -> list[Column]:
        places = F.filter(F.transform(q[name], lambda x, i: F.when(x >= least, i)), lambda i: i.isNotNull())
        return [places.alias(f"{name}_at"), F.filter(q[name], lambda x: x >= least).alias(name)]

    kept = ["dim", *[f"{n}_{x}" for n in ("hair", "eyes") for x in ("place", "best", "second", "group")], "multi", "closed"]
    return F.struct(*[q[c].alias(c) for c in kept], *strong("style", STRONG_QUERY), *strong("face", FACE_QUERY))


def attribute_adjustment(q: Column, r: Column, strong: bool = False) -> Column:
    """Sum of the hair, eye, style and face terms of two feature structs; the
    query's may be one of ``strong_details``."""
    other = lambda name: F.transform(q[f"{name}_at"], lambda i: F.get(r[name], i)) if strong else r[name]
    scene = F.greatest(F.lit(0.35), F.lit(1.0) - q["multi"] * 0.75)
    eye = F.when(q["closed"] >= 0.45, scene * F.greatest(F.lit(0.25), F.lit(1.0) - q["closed"])).otherwise(scene)
    total = (
        exclusive_term(q, r, "hair", HAIR_BONUS, scene * HAIR_PENALTY)
        + exclusive_term(q, r, "eyes", EYE_BONUS, eye * EYE_PENALTY)
        + detail_term(q["style"], other("style"), STYLE_BONUS, scene * STYLE_PENALTY)
        + detail_term(q["face"], other("face"), FACE_BONUS, scene * FACE_PENALTY, FACE_QUERY, FACE_MATCH, FACE_MISS)
    )
    clipped = F.greatest(F.lit(-MAX_ADJUSTMENT), F.least(F.lit(MAX_ADJUSTMENT), total))
    return F.when(q["dim"] == r["dim"], clipped).otherwise(F.lit(0.0))


PROFILE_MIN_SCORE, CORRELATION_MIN_SCORE = 0.42, 0.58


def dominant_group(f: Column, name: str, min_score: float = PROFILE_MIN_SCORE) -> Column:
    """Group of the dominant tag of a feature struct, empty when too weak."""
    strong = (f[f"{name}_best"] >= min_score) & (f[f"{name}_best"] > 0)
    return F.when(strong, f[f"{name}_group"]).otherwise(F.lit(""))


def correlation_multiplier(
    hair_group: Column, hair_score: Column, eye_group: Column, eye_score: Column, hair: Column, eyes: Column
) -> Column:
    """Factor for agreement of the query groups with an entity profile (NULL profile: 1)."""

    def state(group: Column, score: Column, profile: Column) -> Column:
        usable = (group != "") & (score >= CORRELATION_MIN_SCORE) & (F.size(profile) > 0)
        hit = F.array_contains(profile, group) | F.array_contains(profile, F.lit("multi"))
        return F.when(usable & hit, F.lit(1)).when(usable & ~hit, F.lit(-1)).otherwise(F.lit(0))

    h, e = state(hair_group, hair_score, hair), state(eye_group, eye_score, eyes)
    factor = (
        F.when(h == 1, F.lit(1.05)).when(h == -1, F.lit(0.88)).otherwise(F.lit(1.0))
        * F.when(e == 1, F.lit(1.03)).when(e == -1, F.lit(0.92)).otherwise(F.lit(1.0))
        * F.when((h == -1) & (e == -1), F.lit(0.90)).otherwise(F.lit(1.0))
    )
    bounded = F.greatest(F.lit(0.70), F.least(F.lit(1.18), factor))
    return F.when(hair.isNull() & eyes.isNull(), F.lit(1.0)).otherwise(bounded)


def region_adjust_weight(similarity: Column, adjustment: Column, weight: Column) -> Column:
    """Scale the adjustment by the region weight, clip to 0..1, apply the weight."""
    scaled = (
        F.when(weight <= 0.65, adjustment * 0.40).when(weight < 0.90, adjustment * 0.70).otherwise(adjustment)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity + scaled)) * weight


# ------------------------------------------------------------ pixel hashes


def average_hash(pixels: Column) -> Column:
    """64-bit mask of pixels at or above the mean, first pixel in the top bit."""
    total = F.aggregate(pixels, F.lit(0).cast("bigint"), lambda s, x: s + x)
    size = F.size(pixels)
    return F.when(size > 0, F.aggregate(
        pixels,
        F.lit(0).cast("bigint"),
        lambda h, x: F.shiftleft(h, 1).bitwiseOR(F.when(x * size >= total, F.lit(1)).otherwise(F.lit(0)).cast("bigint")),
    ))


def hamming_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
