"""Prediction normalisation and keyword order.

Tables: ``predictions(image_id, pos, tag, category, score)``; ordered tag
lists are long tables ``(image_id, pos, tag)``. A list is reduced to distinct
canonical tags before it is grouped by image, so no group is larger than the
taxonomy, however many rows one image has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.functions.text import extension, let, normalize_token
from tagloom.session import small_side

FEATURE_CATEGORIES = ("general", "rating")
DEFAULT_RANK = 999


def alias_map(aliases: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(token, canonical_id) from ``aliases(token, canonical_id, ordinal, deprecated)``.

    A canonical id is its own first alias; canonicals outside the taxonomy and
    empty tokens drop; deprecated ids overlay; the later entry wins.
    """
    known = aliases.join(taxonomy.select(F.col("tag_id").alias("canonical_id")).distinct(), "canonical_id", "left_semi")
    own = (
        known.filter(~F.col("deprecated"))
        .groupBy("canonical_id")
        .agg((F.min("ordinal") - 0.5).alias("ordinal"))
        .select(F.col("canonical_id").alias("token"), "canonical_id", "ordinal", F.lit(False).alias("deprecated"))
    )
    return (
        known.select("token", "canonical_id", F.col("ordinal").cast("double").alias("ordinal"), "deprecated")
        .unionByName(own)
        .select(normalize_token(F.col("token")).alias("token"), "canonical_id", "deprecated", "ordinal")
        .filter(F.col("token") != "")
        .groupBy("token")
        .agg(F.max_by("canonical_id", F.struct("deprecated", "ordinal")).alias("canonical_id"))
    )


def canonical_join(predictions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Attach the canonical id of each prediction's tag; unknown tags drop."""
    return predictions.withColumn("token", normalize_token(F.col("tag"))).join(aliases, "token")


def taxonomy_join(tags: DataFrame, taxonomy: DataFrame, tag: str = "tag") -> DataFrame:
    """Attach category and localised name, the id standing in for a missing name."""
    t = taxonomy.select(F.col("tag_id").alias(tag), "category_id", F.col("name").alias("_name"))
    return tags.join(t, tag, "left").withColumn("name", F.coalesce("_name", tag)).drop("_name")


def threshold_filter(
    rows: DataFrame, taxonomy: DataFrame, thresholds: DataFrame, minimum: float, tag: str = "canonical_id"
) -> DataFrame:
    """Keep score >= tag threshold, else category threshold, else the minimum."""
    by_tag = thresholds.filter(F.col("scope") == "tag").select(F.col("key").alias(tag), F.col("min_score").alias("_tag_min"))
    by_category = thresholds.filter(F.col("scope") == "category").select(
        F.col("key").alias("category_id"), F.col("min_score").alias("_category_min")
    )
    rules = (
        taxonomy.select(F.col("tag_id").alias(tag), "category_id")
        .join(by_category, "category_id", "left")
        .join(by_tag, tag, "full_outer")
        .select(tag, F.coalesce("_tag_min", "_category_min").alias("_min"))
    )
    return rows.join(rules, tag, "left").filter(F.col("score") >= F.coalesce("_min", F.lit(minimum))).drop("_min")


def drop_blocked(rows: DataFrame, blocked: DataFrame, tag: str = "canonical_id") -> DataFrame:
    return rows.join(blocked.select(F.col("tag_id").alias(tag)), tag, "left_anti")


def keep_known(rows: DataFrame, taxonomy: DataFrame, tag: str = "tag") -> DataFrame:
    return rows.join(taxonomy.select(F.col("tag_id").alias(tag)).distinct(), tag, "left_semi")


def canonicalize(
    predictions: DataFrame,
    aliases: DataFrame,
    taxonomy: DataFrame,
    thresholds: DataFrame,
    blocked: DataFrame,
    minimum: float,
) -> DataFrame:
    """Predictions -> (image_id, pos, tag, score), best score first."""
    rows = predictions.filter(F.col("category").isin(*FEATURE_CATEGORIES))
    rows = canonical_join(rows, aliases)
    rows = drop_blocked(threshold_filter(rows, taxonomy, thresholds, minimum), blocked)
    best = rows.groupBy("image_id", F.col("canonical_id").alias("tag")).agg(
        F.min(F.struct((-F.col("score")).alias("neg"), F.col("pos"))).alias("k")
    )
    order = W.partitionBy("image_id").orderBy("k.neg", "k.pos", "tag")
    return best.select("image_id", F.row_number().over(order).alias("pos"), "tag", (-F.col("k.neg")).alias("score"))


def works(predictions: DataFrame, work_map: DataFrame, minimum: float = 0.70) -> DataFrame:
    """Copyright tags -> distinct (image_id, pos, work) in order of first sight."""
    rows = predictions.filter((F.col("category") == "copyright") & (F.col("score") >= minimum))
    hits = rows.withColumn("token", normalize_token(F.col("tag"))).join(work_map, "token")
    return hits.groupBy("image_id", "work").agg(F.min("pos").alias("pos")).select("image_id", "pos", "work")


def subject_count(
    predictions: DataFrame, nouns: tuple[str, ...], flags: tuple[str, ...], min_score: float = 0.35, max_count: int = 3
) -> DataFrame:
    """Expected number of subjects per image from counting tags."""
    token = normalize_token(F.col("tag"))
    usable = (F.col("category") == "general") & (F.col("score") >= max(0.0, min_score))
    number = F.expr("try_cast(n AS INT)")
    rows = predictions.select(
        "image_id",
        F.when(usable, F.regexp_extract(token, rf"^(\d+)({'|'.join(nouns)})$", 1)).alias("n"),
        (usable & token.isin(*flags)).alias("flag"),
    )
    counts = rows.groupBy("image_id").agg(F.max(number).alias("explicit"), F.bool_or("flag").alias("many"))
    guess = F.when(F.col("explicit") > 0, F.col("explicit")).when(F.col("many"), F.lit(3)).otherwise(F.lit(1))
    return counts.select("image_id", F.greatest(F.lit(1), F.least(guess, F.lit(max(1, max_count)))).alias("subject_count"))


def effective_threshold(base: float, count: Column, floor: float) -> Column:
    base, floor = max(0.0, base), max(0.0, floor)
    return F.when(count <= 1, F.lit(base)).otherwise(F.lit(min(base, floor)))


def effective_top_k(base: int, count: Column, heads: Column) -> Column:
    low = F.lit(max(1, base))
    wanted = F.least(F.greatest(count, F.lit(1)), F.greatest(heads, F.lit(0)))
    return F.when(heads <= 0, low).otherwise(F.greatest(low, wanted))


def head_score(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted tag score per image, floored at 0; the last duplicate name wins."""
    rows = (
        predictions.filter(F.col("category") == "general")
        .withColumn("token", normalize_token(F.col("tag")))
        .join(weights.select(normalize_token(F.col("tag")).alias("token"), "weight"), "token")
    )
    last = rows.groupBy("image_id", "token", "weight").agg(F.max_by("score", "pos").alias("score"))
    total = last.groupBy("image_id").agg(F.sum(F.col("score") * F.col("weight")).alias("s"))
    return total.select("image_id", F.greatest(F.lit(0.0), F.col("s")).alias("head_score"))


# ------------------------------------------------------- precision controls


def first_per_tag(tags: DataFrame) -> DataFrame:
    return tags.groupBy("image_id", "tag").agg(F.min("pos").alias("pos")).select("image_id", "pos", "tag")


def groups_overlap(groups: list[tuple[str, list[str]]]) -> bool:
    members = [t for _, tags in groups for t in set(tags)]
    return len(members) != len(set(members))


def exclusive_first(tags: DataFrame, groups: list[tuple[str, list[str]]]) -> DataFrame:
    """Keep the first tag of each mutually exclusive group.

    Groups run in order and do not see tags an earlier group removed. Disjoint
    groups (checked here) need one window; overlapping ones are folded over the
    image's tag list, which holds each taxonomy tag at most once.
    """
    if not groups:
        return tags
    if not groups_overlap(groups):
        group = F.coalesce(*[F.when(F.col("tag").isin(*m), F.lit(g)) for g, m in groups])
        first = F.min("pos").over(W.partitionBy("image_id", "_group"))
        marked = tags.withColumn("_group", group).withColumn("_first", first)
        return marked.filter(F.col("_group").isNull() | (F.col("pos") == F.col("_first"))).drop("_group", "_first")

    listed = tags.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("pos", "tag"))).alias("list"))
    rules = F.array(*[F.array(*[F.lit(t) for t in members]) for _, members in groups])

    def apply(kept: Column, group: Column) -> Column:
        winner = F.get(F.filter(kept, lambda e: F.array_contains(group, e["tag"])), F.lit(0))["tag"]
        return let(winner, lambda w: F.filter(kept, lambda e: ~F.array_contains(group, e["tag"]) | (e["tag"] == w)))

    return listed.select("image_id", F.inline(F.aggregate(rules, F.col("list"), apply)))


def cap_categories(tags: DataFrame, taxonomy: DataFrame, caps: DataFrame, default: int = DEFAULT_RANK) -> DataFrame:
    """At most N tags per category in list order; tags without category drop."""
    rules = taxonomy.select(F.col("tag_id").alias("tag"), "category_id").join(caps, "category_id", "left")
    place = F.row_number().over(W.partitionBy("image_id", "category_id").orderBy("pos"))
    rows = tags.join(rules, "tag").withColumn("_place", place)
    return rows.filter(F.col("_place") <= F.coalesce("cap", F.lit(default))).select("image_id", "pos", "tag")


def precision_filter(
    tags: DataFrame,
    taxonomy: DataFrame,
    blocked: DataFrame,
    groups: list[tuple[str, list[str]]],
    caps: DataFrame,
) -> DataFrame:
    """Block, unknown, distinct, exclusive groups, caps - in that order.

    What the rules say of a tag is one small table; groups and caps work on the
    image's list of distinct tags. Two shuffles in all."""
    rules = taxonomy.select(F.col("tag_id").alias("tag"), "category_id").dropDuplicates(["tag"])
    rules = drop_blocked(rules, blocked, "tag").join(caps.select("category_id", "cap"), "category_id", "left")
    rules = small_side(rules.select("tag", F.struct("category_id", F.coalesce("cap", F.lit(DEFAULT_RANK)).alias("cap")).alias("rule")), "precision-rules")
    first = tags.join(rules, "tag").groupBy("image_id", "tag").agg(F.min("pos").alias("pos"), F.any_value("rule").alias("rule"))
    item = F.struct("pos", "tag", "rule.category_id", "rule.cap")
    listed = first.groupBy("image_id").agg(F.sort_array(F.collect_list(item)).alias("list"))
    kept = F.transform(precise_features(F.col("list"), groups), lambda e: F.struct(e["pos"].alias("pos"), e["tag"].alias("tag")))
    return listed.select("image_id", F.inline(kept))


def display_sort(tags: DataFrame, taxonomy: DataFrame, category_rank: DataFrame, tag_rank: DataFrame) -> DataFrame:
    """Re-number the distinct tags of an image by category rank, tag rank and
    old position; the ranks of a tag are one small table, the order is taken on
    the image's list."""
    cat = category_rank.select("category_id", F.col("rank").alias("_cat"))
    ranks = (
        taxonomy.select(F.col("tag_id").alias("tag"), "category_id")
        .join(cat, "category_id", "left")
        .join(tag_rank.select(F.col("tag_id").alias("tag"), F.col("rank").alias("_tag")), "tag", "full_outer")
        .select("tag", F.coalesce("_cat", F.lit(DEFAULT_RANK)).alias("c"), F.coalesce("_tag", F.lit(DEFAULT_RANK)).alias("t"))
    )
    place = F.struct(F.coalesce("c", F.lit(DEFAULT_RANK)), F.coalesce("t", F.lit(DEFAULT_RANK)), "pos", "tag")
    rows = tags.join(small_side(ranks, "display-ranks"), "tag", "left").select("image_id", place.alias("place"), "tag")
    listed = rows.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("place", "tag"))).alias("list"))
    numbered = listed.select("image_id", F.posexplode("list").alias("pos", "e"))
    return numbered.select("image_id", (F.col("pos") + 1).alias("pos"), "e.tag")


def as_lists(rows: DataFrame, value: str, name: str, key: str = "image_id") -> DataFrame:
    """Ordered array per key from an already distinct long table."""
    arr = F.transform(F.sort_array(F.collect_list(F.struct("pos", value))), lambda e: e[value])
    return rows.groupBy(key).agg(arr.alias(name))


def keyword_list(characters: Column, tag_names: Column, work_names: Column) -> Column:
    """Names, then sorted tag names, then works; first of equals kept."""
    empty = F.array().cast("array<string>")
    parts = [F.coalesce(c, empty) for c in (characters, tag_names, work_names)]
    return F.array_distinct(F.filter(F.concat(*parts), lambda k: k.isNotNull() & (F.trim(k) != "")))


def preview_with_forced(tags: Column, forced: list[str], limit: int = 8) -> Column:
    """First tags; a forced tag that fell out takes the last place."""
    head = F.slice(tags, 1, limit)
    missing = F.filter(
        F.array(*[F.lit(t) for t in forced]), lambda t: F.array_contains(tags, t) & ~F.array_contains(head, t)
    )
    swapped = F.concat(F.slice(tags, 1, limit - 1), F.slice(missing, 1, 1))
    return F.when((F.size(tags) > limit) & (F.size(missing) > 0), swapped).otherwise(head)


def token_rules(
    aliases: DataFrame,
    taxonomy: DataFrame,
    thresholds: DataFrame,
    blocked: DataFrame,
    caps: DataFrame,
    category_rank: DataFrame,
    tag_rank: DataFrame,
    work_map: DataFrame,
    minimum: float,
) -> DataFrame:
    """All rules of a token in one small table: (token, rule STRUCT, work).

    One join with this table replaces a chain of joins over the predictions.
    It is written, because estimates through several joins are far too high and
    would make Spark shuffle the predictions by token.
    """
    by_tag = thresholds.filter(F.col("scope") == "tag").select(F.col("key").alias("tag"), F.col("min_score").alias("_t"))
    by_category = thresholds.filter(F.col("scope") == "category").select(F.col("key").alias("category_id"), F.col("min_score").alias("_c"))
    rows = (
        aliases.withColumnRenamed("canonical_id", "tag")
        .join(blocked.select(F.col("tag_id").alias("tag")), "tag", "left_anti")
        .join(taxonomy.select(F.col("tag_id").alias("tag"), "category_id", "name"), "tag")
        .join(by_tag, "tag", "left").join(by_category, "category_id", "left").join(caps, "category_id", "left")
        .join(category_rank.select("category_id", F.col("rank").alias("_cr")), "category_id", "left")
        .join(tag_rank.select(F.col("tag_id").alias("tag"), F.col("rank").alias("_tr")), "tag", "left")
    )
    rule = F.struct(
        "tag", "category_id", F.coalesce("name", "tag").alias("name"), F.coalesce("_t", "_c", F.lit(minimum)).alias("min_score"),
        F.coalesce("cap", F.lit(DEFAULT_RANK)).alias("cap"), F.coalesce("_cr", F.lit(DEFAULT_RANK)).alias("category_rank"),
        F.coalesce("_tr", F.lit(DEFAULT_RANK)).alias("tag_rank"),
    )
    table = rows.select("token", rule.alias("rule")).join(work_map.select("token", "work"), "token", "full_outer")
    return small_side(table, "token-rules")


def label_values(predictions: DataFrame, rules: DataFrame, character_min: float, work_min: float = 0.70) -> DataFrame:
    """Predictions with (kind, value, neg): 0 for a feature, 1 a character, 2 a
    work, null where the row counts for nothing; its place in the list is
    (neg, pos). The rules are looked up by token, so this works on a stream."""
    rows = predictions.withColumn("token", normalize_token(F.col("tag"))).join(rules, "token", "left")
    category, score = F.col("category"), F.col("score")
    feature = category.isin(*FEATURE_CATEGORIES) & (score >= F.col("rule.min_score"))
    character = (category == "character") & (score >= character_min)
    work = (category == "copyright") & (score >= work_min) & F.col("work").isNotNull()
    return rows.select(
        *predictions.columns,
        F.when(feature, 0).when(character, 1).when(work, 2).alias("kind"),
        F.when(feature, F.col("rule.tag")).when(character, F.col("tag")).otherwise(F.col("work")).alias("value"),
        F.when(feature, -score).otherwise(F.lit(0.0)).alias("neg"),
    )


def labels_of(first: DataFrame, rules: DataFrame) -> DataFrame:
    """(image_id, features, characters, works) from distinct (image_id, kind,
    value, place)."""
    # the rule is looked up again on the reduced rows, so it is not shuffled
    known = rules.filter(F.col("rule").isNotNull()).groupBy(F.col("rule.tag").alias("value")).agg(F.any_value("rule").alias("rule"))
    known = small_side(known.withColumn("kind", F.lit(0)), "tag-rules")
    first = first.join(known, ["kind", "value"], "left")
    listed = first.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("kind", "place", "value", "rule"))).alias("all"))

    def names(kind: int) -> Column:
        return F.transform(F.filter("all", lambda e: e["kind"] == kind), lambda e: e["value"])

    features = F.transform(F.filter("all", lambda e: e["kind"] == 0), lambda e: e["rule"])
    return listed.select("image_id", features.alias("features"), names(1).alias("characters"), names(2).alias("works"))


def image_labels(predictions: DataFrame, rules: DataFrame, character_min: float, work_min: float = 0.70) -> DataFrame:
    """One pass over the predictions: (image_id, features, characters, works).

    ``features`` are ordered rule structs, best score first; the others ordered
    names. A row belongs to one category and so to one list. Rows shrink to
    distinct (image, list, value) before they are gathered by image, so a hot
    image brings no more than the vocabulary.
    """
    rows = label_values(predictions, rules, character_min, work_min).filter(F.col("kind").isNotNull())
    return labels_of(rows.groupBy("image_id", "kind", "value").agg(F.min(F.struct("neg", "pos")).alias("place")), rules)


def precise_features(features: Column, groups: list[tuple[str, list[str]]]) -> Column:
    """Exclusive groups in order, then category caps, on an image's feature list."""
    def apply(kept: Column, group: Column) -> Column:
        winner = F.get(F.filter(kept, lambda e: F.array_contains(group, e["tag"])), F.lit(0))["tag"]
        return let(winner, lambda w: F.filter(kept, lambda e: ~F.array_contains(group, e["tag"]) | (e["tag"] == w)))

    def cap(kept: Column) -> Column:
        earlier = lambda e, i: F.filter(F.slice(kept, F.lit(1), i), lambda o: o["category_id"] == e["category_id"])
        return F.filter(kept, lambda e, i: F.size(earlier(e, i)) < e["cap"])

    if groups:
        rules = F.array(*[F.array(*[F.lit(t) for t in members]) for _, members in groups])
        features = F.aggregate(rules, features, apply)
    return let(features, cap)


def displayed_names(features: Column) -> Column:
    """Localised names by category rank, tag rank and list place."""
    ranked = F.transform(
        features, lambda e, i: F.struct(e["category_rank"].alias("c"), e["tag_rank"].alias("t"), i.alias("i"), e["name"].alias("n"))
    )
    return F.transform(F.sort_array(ranked), lambda e: e["n"])


def annotation_records(images: DataFrame, labels: DataFrame, root: str, now: str) -> DataFrame:
    """One record per image of ``images(image_id, image_path)``."""
    empty = F.array().cast("array<string>")
    prefix = root.rstrip("/") + "/"
    path = F.translate(F.col("image_path"), "\\", "/")
    relative = F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)
    tags = F.transform("features", lambda e: e["tag"])
    return images.join(labels, "image_id", "left").select(
        "image_id",
        relative.alias("image_path"),
        F.coalesce("characters", empty).alias("characters"),
        F.coalesce(tags, empty).alias("feature_tags"),
        F.coalesce("works", empty).alias("source_game"),
        F.lit(False).alias("review_required"),
        F.lit("labeled_draft").alias("status"),
        F.lit(now).alias("created_at"),
    )


def run_summary(records: DataFrame, writable: Column, keywords: str = "keywords") -> DataFrame:
    """Counts of one run: found, written, targets, updated, skipped."""
    filled = F.size(keywords) > 0
    return records.agg(
        F.count(F.lit(1)).alias("images_found"),
        F.count(F.lit(1)).alias("queue_written"),
        F.count_if(writable).alias("targets"),
        F.count_if(writable & filled).alias("updated"),
        F.count_if(writable & ~filled).alias("skipped"),
    )


# ------------------------------------------------------------- rule tables


def merge_rule_rows(base: DataFrame, extra: DataFrame, key: list[str], value: list[str], last_wins: bool = False) -> DataFrame:
    """Union of two rule tables by key; base first (or the extension, for caps)."""
    both = base.withColumn("_layer", F.lit(0)).unionByName(extra.withColumn("_layer", F.lit(1)))
    order = F.struct("_layer", "ordinal")
    pick = F.max_by if last_wins else F.min_by
    columns = [pick(v, order).alias(v) for v in value]
    return both.groupBy(*key).agg(*columns, F.min(order).alias("_first")).select(
        *key, *value, F.col("_first._layer").alias("layer"), F.col("_first.ordinal").alias("ordinal")
    )


def category_filter(tags: DataFrame, always: tuple[str, ...] = FEATURE_CATEGORIES, guarded: dict[str, float] | None = None) -> DataFrame:
    """Tags of the categories that always count, and of ``guarded`` ones from
    their score on (by default works from 0.70)."""
    keep = F.col("category").isin(*always)
    for name, least in (guarded if guarded is not None else {"copyright": 0.70}).items():
        keep = keep | ((F.col("category") == name) & (F.col("score") >= least))
    return tags.filter(keep)


def target_records(records: DataFrame, statuses: list[str], extensions: tuple[str, ...] | list[str]) -> DataFrame:
    """Records of writable files in one of the states; every state if none is named."""
    kept = records.filter(extension(F.col("image_path")).isin(*extensions))
    return kept.filter(F.col("status").isin(*statuses)) if statuses else kept


def keyword_export(records: DataFrame, keywords: DataFrame, statuses: list[str], extensions: tuple[str, ...] | list[str]) -> DataFrame:
    """Target records with their ordered keywords; images without any drop."""
    return target_records(records, statuses, extensions).join(keywords, "image_id")


def with_resolved(labels: DataFrame, resolved: DataFrame) -> DataFrame:
    """``labels`` with the characters of ``resolved(image_id, rank,
    character_name)`` in place of those the tagger named; an image that only
    one side knows is kept. The resolver bounds the names of an image."""
    names = resolved.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("rank", "character_name"))).alias("_names"))
    rows = labels.join(names, "image_id", "full_outer")
    return rows.withColumn("characters", F.transform(F.coalesce("_names", F.array().cast("array<struct<rank:int,character_name:string>>")), lambda e: e["character_name"])).drop("_names")
