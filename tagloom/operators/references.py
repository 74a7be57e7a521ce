"""Reference quality: centroids, outliers, consistency, the identity filter.

Group statistics are map-side combined vector sums, so one entity that holds
a third of all rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.functions import vectors as V
from tagloom.operators.ranking import first_per_key, keep_unlike, running_numbers, top_per_key
from tagloom.session import materialize

# Fixed values of the identity filter.
CENTROID_MIN, AVATAR_MIN, AVATAR_BAND, SEED_AVATAR_MIN = 0.45, 0.52, 0.10, 0.50
MAX_SEEDS, MIN_SIDE, MAX_REFERENCES = 8, 96, 30


def vector_centroid(rows: DataFrame, key: str, vector: str = "embedding", unit: bool = False) -> DataFrame:
    """(key, n, centroid); ``unit`` scales it to length 1, NULL if it is zero."""
    v = array_to_vector(F.transform(vector, lambda x: x.cast("double")))
    means = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(v).alias("m"))
    mean = means.select(key, "n", vector_to_array("m").alias("centroid"))
    return mean.withColumn("centroid", V.l2_normalize(F.col("centroid"), zero_to_null=True)) if unit else mean


def vector_outliers(rows: DataFrame, key: str, threshold: float = 0.78, vector: str = "embedding") -> DataFrame:
    """Rows whose cosine to their group's centroid is below the threshold."""
    centroids = vector_centroid(rows, key, vector).filter((F.col("n") > 1) & (V.norm(F.col("centroid")) > 0))
    joined = rows.join(centroids, key).withColumn("centroid_similarity", V.cosine_similarity(F.col(vector), F.col("centroid")))
    return joined.filter(F.col("centroid_similarity") < threshold).drop("centroid", "n")


def pair_statistics(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Per group: members, unordered pairs, summed and mean pair cosine.

    Uses |sum of unit vectors|^2 = members + 2 * (sum over pairs), so no pair
    is ever formed; groups of one have similarity 1.
    """
    unit = V.l2_normalize(F.col(vector))
    units = rows.select(key, unit.alias("_u"), (V.norm(F.col(vector)) > 0).alias("_some"))
    sums = units.groupBy(key).agg(
        F.count(F.lit(1)).alias("members"),
        F.count_if("_some").alias("_nonzero"),
        Summarizer.mean(array_to_vector("_u")).alias("_m"),
    )
    total = sums.withColumn("_m", vector_to_array("_m"))
    n = F.col("members")
    pairs = n * (n - 1) / 2
    pair_sum = (V.dot(F.col("_m"), F.col("_m")) * n * n - F.col("_nonzero")) / 2
    return total.select(
        key,
        "members",
        pairs.cast("bigint").alias("pairs"),
        F.when(n > 1, pair_sum).otherwise(F.lit(0.0)).alias("pair_similarity_sum"),
        F.when(n > 1, pair_sum / pairs).otherwise(F.lit(1.0)).alias("mean_similarity"),
    )


def attribute_conflict(labels: DataFrame, key: str, label: str) -> DataFrame:
    """Conflicting labels per group: more than one, no stable majority, sorted."""
    counts = labels.filter(F.col(label) != "").groupBy(key, label).agg(F.count(F.lit(1)).alias("c"))
    stats = counts.groupBy(key).agg(
        F.count(F.lit(1)).alias("kinds"),
        F.max("c").alias("top"),
        F.sum("c").alias("n"),
        F.sort_array(F.collect_set(label)).alias("labels"),
    )
    stable = (F.col("n") >= 3) & (F.col("top") / F.col("n") >= 0.75)
    return stats.filter((F.col("kinds") > 1) & ~stable).select(key, "labels")


def min_size(width: Column, height: Column, side: int = MIN_SIDE) -> Column:
    return F.least(width, height) >= side


def remaining_quota(limit: int, current: Column) -> Column:
    """Free places under a limit clamped to 1..30."""
    return F.greatest(F.lit(0), F.lit(max(1, min(MAX_REFERENCES, limit))) - current)


# ----------------------------------------------------------- identity filter


def seed_rows(avatars: DataFrame, references: DataFrame, limit: int = MAX_SEEDS) -> DataFrame:
    """Avatar first, then references in order, distinct paths, first ``limit``.

    Inputs ``avatars(entity_id, path, vector)`` and ``references(entity_id,
    pos, path, vector)``; only existing files are listed, a vector may be NULL.
    """
    first = avatars.select("entity_id", F.lit(-1).cast("bigint").alias("pos"), "path", "vector")
    rows = first.unionByName(references.select("entity_id", F.col("pos").cast("bigint").alias("pos"), "path", "vector"))
    unique = rows.groupBy("entity_id", "path").agg(F.min("pos").alias("pos"), F.min_by("vector", "pos").alias("vector"))
    order = W.partitionBy("entity_id").orderBy("pos", "path")
    picked = unique.withColumn("seed", F.row_number().over(order)).filter(F.col("seed") <= limit)
    return picked.withColumn("vector", V.l2_normalize(F.col("vector"), zero_to_null=True))


def seed_state(seeds: DataFrame) -> DataFrame:
    """Per entity: seed counts, the avatar vector, the centre of the clean seeds.

    An entity has at most ``MAX_SEEDS`` seeds, so they are handled as one
    short array and need no further join. Seeds far from the avatar do not count.
    """
    listed = seeds.groupBy("entity_id").agg(F.collect_list(F.struct("pos", "vector")).alias("s"))
    rows = listed.select(
        "entity_id",
        F.size("s").alias("seeds"),
        F.exists("s", lambda x: x["pos"] == -1).alias("has_avatar"),
        F.get(F.filter("s", lambda x: x["pos"] == -1), F.lit(0))["vector"].alias("avatar_vector"),
        F.filter("s", lambda x: x["vector"].isNotNull()).alias("u"),
    )
    near = lambda x: V.dot(x["vector"], F.col("avatar_vector")) >= SEED_AVATAR_MIN
    clean = F.filter("u", lambda x: F.col("avatar_vector").isNull() | (x["pos"] == -1) | near(x))
    rows = rows.withColumn("c", F.transform(clean, lambda x: x["vector"]))
    total = F.aggregate(F.slice("c", 2, MAX_SEEDS), F.get("c", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    rows = rows.withColumn("sum", F.when(F.size("c") > 0, total))
    return rows.select(
        "entity_id", "seeds", "has_avatar", "avatar_vector", F.size("u").alias("seed_vectors"), F.size("c").alias("seed_count"),
        V.l2_normalize(F.col("sum"), zero_to_null=True).alias("centroid"),
    )


def clean_seeds(seeds: DataFrame) -> DataFrame:
    """The seeds themselves that agree with the avatar, as rows."""
    avatar = seeds.filter(F.col("pos") == -1).select("entity_id", F.col("vector").alias("avatar"))
    rows = seeds.filter(F.col("vector").isNotNull()).join(avatar, "entity_id", "left")
    near = V.dot(F.col("vector"), F.col("avatar")) >= SEED_AVATAR_MIN
    return rows.filter(F.col("avatar").isNull() | (F.col("pos") == -1) | near)


def identity_filter(
    candidates: DataFrame,
    avatars: DataFrame,
    references: DataFrame,
    limits: DataFrame | int,
    entities: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Choose candidates that look like the entity; (kept, report).

    ``entities(entity_id)`` are reported even without any candidate.

    ``candidates(entity_id, pos, path, width, height, vector)``; a NULL vector
    is an unreadable image. ``limits`` is one number or (entity_id, quota). An
    entity with very many candidates is ranked by many tasks.
    """
    most = max(1, limits) if isinstance(limits, int) else (limits.agg(F.max("quota")).first()[0] or 0)
    state = seed_state(seed_rows(avatars, references))
    rows = candidates.join(state, "entity_id", "left")
    if isinstance(limits, int):
        rows = rows.withColumn("quota", F.lit(max(1, limits)))
    else:
        rows = rows.join(limits.select("entity_id", "quota"), "entity_id")
    v = V.l2_normalize(F.col("vector"), zero_to_null=True)
    usable = min_size(F.col("width"), F.col("height")) & F.col("centroid").isNotNull()
    rows = rows.withColumn("_v", F.when(usable, v))
    to_centroid = F.when(F.col("_v").isNotNull(), V.dot(F.col("_v"), F.col("centroid")))
    to_avatar = F.when(F.col("_v").isNotNull() & F.col("avatar_vector").isNotNull(), V.dot(F.col("_v"), F.col("avatar_vector")))
    scored = rows.select(
        "entity_id", "pos", "path", "quota",
        F.coalesce("seeds", F.lit(0)).alias("seeds"),
        F.coalesce("seed_vectors", F.lit(0)).alias("seed_vectors"),
        F.coalesce("seed_count", F.lit(0)).alias("seed_count"),
        F.coalesce("has_avatar", F.lit(False)).alias("has_avatar"),
        F.col("avatar_vector").isNotNull().alias("avatar_seen"),
        F.col("centroid").isNotNull().alias("centered"),
        to_centroid.alias("centroid_similarity"),
        F.coalesce(to_avatar, to_centroid).alias("avatar_similarity"),
    )
    scored = scored.withColumn("weighted", F.col("centroid_similarity") * 0.65 + F.col("avatar_similarity") * 0.35)
    scored = materialize(scored, "identity-scored")  # vectors are done with; three readers follow

    same = ("quota", "seeds", "seed_vectors", "seed_count", "has_avatar", "avatar_seen", "centered")
    state = scored.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.count("weighted").alias("scored_count"),
        F.max("avatar_similarity").alias("best_avatar"),
        F.max("weighted").alias("best_similarity"),
        *[F.any_value(c).alias(c) for c in same],
    )
    passed = (F.col("seeds") == 0) | ((F.col("seed_vectors") == 0) & ~F.col("has_avatar"))
    good = (F.col("centroid_similarity") >= CENTROID_MIN) & (
        ~F.col("avatar_seen") | (F.col("avatar_similarity") >= dynamic_floor(F.col("best_avatar")))
    )
    kept = scored.join(state.select("entity_id", "best_avatar"), "entity_id").filter(passed | good)
    kept = kept.withColumn("_less", -F.round(F.coalesce("weighted", F.lit(0.0)), 12))
    kept = top_per_key(kept, ["entity_id"], ["_less", "pos"], "quota", most)
    kept = kept.select("entity_id", "rank", "pos", "path", "weighted", "centroid_similarity", "avatar_similarity")

    counts = kept.groupBy("entity_id").agg(F.count(F.lit(1)).alias("kept_count"), F.min("weighted").alias("worst_kept"))
    mode = (
        F.when(F.col("seeds") == 0, "passthrough_no_seed")
        .when((F.col("seed_vectors") == 0) & F.col("has_avatar"), "reject_no_seed_vector")
        .when(F.col("seed_vectors") == 0, "passthrough_no_seed_vector")
        .when(F.col("seed_count") == 0, "reject_no_clean_seed_vector")
        .when(~F.col("centered"), "reject_invalid_seed_center")
        .when(F.col("scored_count") == 0, "reject_no_candidate_vector")
        .when(F.col("kept_count") > 0, "filtered")
        .otherwise("reject_low_confidence")
    )
    report = state.join(counts, "entity_id", "left").select(
        "entity_id",
        mode.alias("mode"),
        "candidate_count",
        "scored_count",
        F.coalesce("kept_count", F.lit(0)).alias("kept_count"),
        F.col("seed_count").cast("bigint").alias("seed_count"),
        F.when(F.col("avatar_seen"), dynamic_floor(F.col("best_avatar"))).otherwise(F.lit(0.0)).alias("avatar_dynamic_floor"),
        F.coalesce("best_similarity", F.lit(0.0)).alias("best_similarity"),
        F.coalesce("worst_kept", F.lit(0.0)).alias("worst_kept_similarity"),
    )
    if entities is not None:
        bare = entities.select("entity_id").distinct().join(state.select("entity_id"), "entity_id", "left_anti")
        zeros = [F.lit(0).cast(report.schema[c].dataType).alias(c) for c in report.columns[2:]]
        report = report.unionByName(bare.select("entity_id", F.lit("empty").alias("mode"), *zeros))
    return kept, report


def dynamic_floor(best_avatar: Column) -> Column:
    return F.greatest(F.lit(AVATAR_MIN), best_avatar - AVATAR_BAND)


def reference_prune(references: DataFrame, avatars: DataFrame) -> DataFrame:
    """References that survive a filter seeded by the avatar alone.

    Entities with a single reference keep it.
    """
    sizes = references.groupBy("entity_id").agg(F.count(F.lit(1)).alias("quota"))
    many = references.join(sizes.filter(F.col("quota") > 1), "entity_id", "left_semi")
    kept, _ = identity_filter(many, avatars, many.limit(0), sizes.filter(F.col("quota") > 1))
    single = references.join(sizes.filter(F.col("quota") == 1), "entity_id", "left_semi")
    return kept.select("entity_id", "pos", "path").unionByName(single.select("entity_id", "pos", "path"))


# ------------------------------------------------------------ new references


def listed_references(references: DataFrame, files: DataFrame) -> DataFrame:
    """``references(entity_id, pos, path, ...)`` that count: slashes unified,
    not blank, the first of equal paths of an entity, present in ``files(path)``."""
    rows = references.withColumn("path", X.strip(F.translate("path", "\\", "/"))).filter("path <> ''")
    rows = rows.join(files.select("path").distinct(), "path", "left_semi").select(*references.columns)
    return first_per_key(rows, ["entity_id", "path"], ["pos"])


def reference_name(folder: Column, content_sha1: Column, source: Column) -> Column:
    """Path of a stored file: its folder, 16 digits of its digest, its extension."""
    return F.concat(folder, F.lit("/"), F.substring(content_sha1, 1, 16), F.coalesce(F.nullif(X.extension(source), F.lit("")), F.lit(".img")))


def reference_append(references: DataFrame, additions: DataFrame) -> DataFrame:
    """(entity_id, ordinal, path, added): the references of each entity with new
    files behind them.

    ``references(entity_id, pos, path, h)`` are listed ones;
    ``additions(entity_id, pos, source, folder, sha1, h)`` are files, NULL
    ``sha1`` for a missing one; ``h`` is the picture hash, NULL if it cannot be
    read. A new file is left out if its stored name is there already or if its
    hash is within two bits of one that is kept before it.
    """
    old = references.select("entity_id", F.lit(0).alias("layer"), F.col("pos").cast("bigint").alias("pos"), "path", "h")
    new = additions.filter("sha1 IS NOT NULL").withColumn("path", reference_name(F.col("folder"), F.col("sha1"), F.col("source")))
    new = new.join(references.select("entity_id", "path"), ["entity_id", "path"], "left_anti")
    new = first_per_key(new.select("entity_id", F.lit(1).alias("layer"), F.col("pos").cast("bigint").alias("pos"), "path", "h"), ["entity_id", "path"], ["pos"])
    rows = running_numbers(old.unionByName(new), ["entity_id"], ["layer", "pos", "path"], "o").withColumn("old", F.col("layer") == 0)
    kept = keep_unlike(materialize(rows, "reference-files"), "entity_id", "o", "h", accepted="old")
    return running_numbers(kept, ["entity_id"], ["o"], "ordinal").select("entity_id", "ordinal", "path", (~F.col("old")).alias("added"))


def reference_augment(candidates: DataFrame, avatars: DataFrame, references: DataFrame, limit: int = MAX_REFERENCES) -> tuple[DataFrame, DataFrame]:
    """(references after the run, summary per entity with free places).

    ``candidates(entity_id, pos, path, width, height, vector, source, folder,
    sha1, h)`` fill the free places of their entity, chosen by the identity
    filter, unless they look like a reference. ``references(entity_id, pos,
    path, vector, h)`` are listed ones. Summary: entity_id, quota, added.
    """
    counts = references.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    quotas = candidates.select("entity_id").distinct().join(counts, "entity_id", "left")
    quotas = quotas.select("entity_id", remaining_quota(limit, F.coalesce("n", F.lit(0))).alias("quota")).filter(F.col("quota") > 0)
    quotas = materialize(quotas, "augment-quotas")
    wanted = candidates.join(quotas, "entity_id", "left_semi")
    chosen, _ = identity_filter(wanted.select("entity_id", "pos", "path", "width", "height", "vector"), avatars, references.select("entity_id", "pos", "path", "vector"), quotas)
    files = wanted.select("entity_id", "pos", "source", "folder", "sha1", "h").join(chosen.select("entity_id", "pos", "rank"), ["entity_id", "pos"])
    after = reference_append(references, files.drop("pos").withColumnRenamed("rank", "pos"))
    after = materialize(after, "augment-references")
    added = after.filter("added").groupBy("entity_id").agg(F.count(F.lit(1)).alias("added"))
    return after, quotas.join(added, "entity_id", "left").select("entity_id", "quota", F.coalesce("added", F.lit(0)).alias("added"))
