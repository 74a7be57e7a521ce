"""Quality audit of a reference library.

The report is two flat tables (references, entities) plus a one-row summary;
an entity's reference items are never gathered into one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import vectors as V
from tagloom.session import small_side


@dataclass(frozen=True)
class AuditSpec:
    """Vocabulary positions and thresholds of the audit."""

    hair: list[tuple[str, int]] = field(default_factory=list)
    eyes: list[tuple[str, int]] = field(default_factory=list)
    single_subject: list[int] = field(default_factory=list)
    multi_person: list[int] = field(default_factory=list)
    screenshot_noise: list[int] = field(default_factory=list)
    no_humans: int | None = None
    min_single_subject: float = 0.55
    max_multi_person: float = 0.45
    max_screenshot_noise: float = 0.45
    max_no_humans: float = 0.55
    dominant_score: float = 0.55
    outlier_similarity: float = 0.78
    low_consistency: float = 0.76


def dominant_tag(v: Column, tags: list[tuple[str, int]], minimum: float) -> Column:
    """Best tag of a set if strong enough, the first listed on ties, else ''."""
    place = V.dominant_index(V.scores_at(v, [p for _, p in tags]), minimum)
    return F.coalesce(F.get(F.array(*[F.lit(n) for n, _ in tags]), place), F.lit(""))


def reference_signals(refs: DataFrame, spec: AuditSpec) -> DataFrame:
    v = F.col("embedding")
    return refs.select(
        "row_index",
        "character_id",
        *(["image_path"] if "image_path" in refs.columns else []),
        "embedding",
        V.max_group_score(v, spec.single_subject).alias("single_subject"),
        V.max_group_score(v, spec.multi_person).alias("multi_person"),
        V.max_group_score(v, spec.screenshot_noise).alias("screenshot_noise"),
        (V.tag_score_at(v, spec.no_humans) if spec.no_humans is not None else F.lit(0.0)).alias("no_humans"),
        dominant_tag(v, spec.hair, spec.dominant_score).alias("dominant_hair"),
        dominant_tag(v, spec.eyes, spec.dominant_score).alias("dominant_eyes"),
    )


# Issue types and their details.
SUBJECT, PEOPLE, NOISE, EMPTY, OUTLIER = "low_subject_focus", "multi_person_content", "screenshot_noise", "no_humans", "vector_outlier"
DETAILS = {
    SUBJECT: "single-subject score=%.3f < %.3f", PEOPLE: "multi-person score=%.3f >= %.3f", NOISE: "screenshot-noise score=%.3f >= %.3f", EMPTY: "no_humans score=%.3f >= %.3f",
    OUTLIER: "Low similarity to character centroid.", "single_reference": "Only one reference image in library.", "hair_color_conflict": "Conflicting dominant hair tags: %s",
    "eye_color_conflict": "Conflicting dominant eye tags: %s", "outlier_reference": "Outlier references: %d", "low_internal_consistency": "Mean pairwise similarity=%.3f < %.3f",
}


def _issue(when: Column, name: str, *values: Column) -> Column:
    detail = F.format_string(DETAILS[name], *values) if values else F.lit(DETAILS[name])
    return F.when(when, F.struct(F.lit(name).alias("type"), detail.alias("detail")))


def has_issue(name: str) -> Column:
    return F.exists("issues", lambda x: x["type"] == name)


def _conflict(labels: list[str], counts: Column) -> Column:
    """Labels that occur, sorted, if there are several and none is a stable
    majority; NULL otherwise."""
    names = F.array(*[F.lit(x) for x in labels]).cast("array<string>")
    seen = F.filter(F.arrays_zip(names.alias("n"), counts.alias("c")), lambda x: x["c"] > 0)
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    stable = (total >= 3) & (F.array_max(counts) / total >= 0.75)
    return F.when((F.size(seen) > 1) & ~stable, F.sort_array(F.transform(seen, lambda x: x["n"])))


def audit_statistics(refs: DataFrame, spec: AuditSpec) -> DataFrame:
    """Per entity, in one aggregate over its references: their number, the mean
    vector, the mean pair similarity (from the length of the mean unit vector)
    and the conflicting labels (from a count per label of the vocabulary)."""
    rows = reference_signals(refs.filter(F.trim("character_id") != ""), spec)
    hair, eyes = (list(dict.fromkeys(n for n, _ in tags)) for tags in (spec.hair, spec.eyes))
    counts = lambda column, labels: F.array(*[F.count_if(F.col(column) == x) for x in labels]).cast("array<bigint>")
    vector = F.transform("embedding", lambda x: x.cast("double"))
    per = rows.groupBy("character_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(V.norm(F.col("embedding")) > 0).alias("nonzero"), Summarizer.mean(array_to_vector(vector)).alias("mean"),
        Summarizer.mean(array_to_vector(V.l2_normalize(F.col("embedding")))).alias("unit"), counts("dominant_hair", hair).alias("hair"), counts("dominant_eyes", eyes).alias("eyes"))
    n, unit = F.col("n"), F.col("unit")
    per = per.withColumns({"mean": vector_to_array("mean"), "unit": vector_to_array("unit")})
    pairs = (V.dot(unit, unit) * n * n - F.col("nonzero")) / (n * (n - 1))
    out = per.select(
        "character_id", n.alias("reference_count"), F.when((n > 1) & (V.norm(F.col("mean")) > 0), F.col("mean")).alias("centroid"), F.when(n > 1, pairs).otherwise(F.lit(1.0)).alias("mean_similarity"),
        _conflict(hair, F.col("hair")).alias("hair_conflict"), _conflict(eyes, F.col("eyes")).alias("eye_conflict"))
    return small_side(out, "audit-statistics")


def audit_references(refs: DataFrame, spec: AuditSpec, statistics: DataFrame | None = None) -> DataFrame:
    """One row per reference, with ``image_path`` if there is one, its signals
    and its issues as (type, detail)."""
    statistics = audit_statistics(refs, spec) if statistics is None else statistics
    signals = reference_signals(refs.filter(F.trim("character_id") != ""), spec)
    rows = signals.join(statistics.select("character_id", "centroid"), "character_id")
    far = F.coalesce(V.cosine_similarity(F.col("embedding"), F.col("centroid")) < spec.outlier_similarity, F.lit(False))
    c, limit = F.col, lambda x: F.lit(float(x))
    issues = F.array_compact(F.array(
        _issue(c("single_subject") < spec.min_single_subject, SUBJECT, c("single_subject"), limit(spec.min_single_subject)),
        _issue(c("multi_person") >= spec.max_multi_person, PEOPLE, c("multi_person"), limit(spec.max_multi_person)),
        _issue(c("screenshot_noise") >= spec.max_screenshot_noise, NOISE, c("screenshot_noise"), limit(spec.max_screenshot_noise)),
        _issue(c("no_humans") >= spec.max_no_humans, EMPTY, c("no_humans"), limit(spec.max_no_humans)),
        _issue(c("centroid").isNotNull() & far, OUTLIER),
    ))
    return rows.withColumn("issues", issues).select(*signals.columns, "issues")


def audit_entities(refs: DataFrame, names: DataFrame, spec: AuditSpec, include_clean: bool = True) -> DataFrame:
    """One row per entity with its issues and the counts the summary needs.

    The references are read twice: for the statistics, and against them."""
    statistics = audit_statistics(refs, spec)
    per = audit_references(refs, spec, statistics).groupBy("character_id").agg(
        F.count_if(F.size("issues") > 0).alias("issue_references"),
        *[F.count_if(has_issue(name)).alias(column) for column, name in (("multi_person", PEOPLE), ("screenshot_noise", NOISE), ("low_subject", SUBJECT), ("outliers", OUTLIER))],
    )
    rows = per.join(statistics, "character_id").join(names.select("character_id", "display_name"), "character_id", "left")
    c = F.col
    issues = F.array_compact(F.array(
        _issue(c("reference_count") <= 1, "single_reference"),
        _issue(c("hair_conflict").isNotNull(), "hair_color_conflict", F.array_join("hair_conflict", ", ")),
        _issue(c("eye_conflict").isNotNull(), "eye_color_conflict", F.array_join("eye_conflict", ", ")),
        _issue(c("outliers") > 0, "outlier_reference", c("outliers")),
        _issue(c("mean_similarity") < spec.low_consistency, "low_internal_consistency", c("mean_similarity"), F.lit(float(spec.low_consistency))),
    ))
    rows = rows.withColumns({"display_name": F.coalesce("display_name", "character_id"), "issues": issues}).drop("centroid")
    return rows if include_clean else rows.filter((F.size("issues") > 0) | (F.col("issue_references") > 0))


def audit_order(entities: DataFrame) -> DataFrame:
    return entities.orderBy(F.desc(F.size("issues")), F.desc("issue_references"), "display_name")


def audit_summary(entities: DataFrame) -> DataFrame:
    has = lambda name: F.count_if(has_issue(name))
    return entities.agg(
        F.count(F.lit(1)).alias("character_count"),
        F.coalesce(F.sum("reference_count"), F.lit(0)).alias("reference_row_count"),
        has("single_reference").alias("single_reference_characters"),
        F.coalesce(F.sum("multi_person"), F.lit(0)).alias("multi_person_references"),
        F.coalesce(F.sum("screenshot_noise"), F.lit(0)).alias("screenshot_noise_references"),
        F.coalesce(F.sum("low_subject"), F.lit(0)).alias("low_subject_references"),
        has("hair_color_conflict").alias("feature_conflict_characters"),
        has("outlier_reference").alias("outlier_reference_characters"),
        has("low_internal_consistency").alias("low_consistency_characters"),
        F.count_if((F.size("issues") > 0) | (F.col("issue_references") > 0)).alias("characters_with_any_issue"),
    )
