"""Query regions of an image: candidate boxes, scoring, greedy choice.

The scorer is the user's: a Column function from the row to a score vector.
An image has at most 26 evaluated boxes by construction, which bounds every
group below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import boxes as B
from tagloom.functions import vectors as V
from tagloom.session import materialize

# Fixed values of the region choice: evaluated boxes (first, fallback) by mode.
EVAL_SINGLE, EVAL_MULTI = (12, 8), (16, 10)
FALLBACK_SCORE = 0.30
NMS_IOU, SAME_VECTOR = 0.28, 0.985


def head_score_from_vector(v: Column, weights: list[tuple[int, float]]) -> Column:
    total = F.lit(0.0)
    for position, weight in weights:
        total = total + V.tag_score_at(v, position) * weight
    return F.greatest(F.lit(0.0), total)


def target_count(count: Column) -> Column:
    return F.greatest(F.lit(1), F.least(count, F.lit(B.MAX_HEAD_REGIONS)))


def _limits(count: Column) -> tuple[Column, Column]:
    single = count <= 1
    first = F.when(single, F.lit(EVAL_SINGLE[0])).otherwise(F.lit(EVAL_MULTI[0]))
    return first, first + F.when(single, F.lit(EVAL_SINGLE[1])).otherwise(F.lit(EVAL_MULTI[1]))


def explode_boxes(images: DataFrame) -> DataFrame:
    """One row per candidate box of ``images(image_id, width, height, subject_count, ...)``."""
    boxes = B.candidate_boxes(F.col("width"), F.col("height"), F.col("subject_count"))
    return images.select("*", F.posexplode(boxes).alias("box_no", "box"))


def score_boxes(rows: DataFrame, scorer: Callable[[DataFrame], Column], weights: list[tuple[int, float]]) -> DataFrame:
    """Add vector, head score and effective score; boxes the scorer fails on drop."""
    scored = rows.withColumn("vector", scorer(rows)).filter(F.col("vector").isNotNull())
    scored = scored.withColumns({
        "head_score": head_score_from_vector(F.col("vector"), weights),
        "area": B.area_ratio(F.col("box"), F.col("width"), F.col("height")),
    })
    effective = B.effective_region_score(F.col("head_score"), F.col("area"))
    keep = ("image_id", "subject_count", "box_no", "box", "vector", "head_score", "area")
    return scored.withColumn("effective", effective).select(*keep, "effective")


def nms_select(scored: DataFrame) -> DataFrame:
    """Greedy choice per image: (image_id, chosen ARRAY, target).

    Ranked by effective score, then smaller area; a box that overlaps a chosen
    one or has nearly its vector is skipped; stops at the target count.
    """
    item = F.struct(
        (-F.round("effective", 12)).alias("neg"), "area", "box_no", "head_score", "box", "vector"
    )
    lists = scored.groupBy("image_id").agg(
        F.sort_array(F.collect_list(item)).alias("list"), target_count(F.max("subject_count")).alias("target")
    )
    start = F.array().cast("array<struct<box_no:int,head_score:double,box:struct<l:int,t:int,r:int,b:int>,vector:array<double>>>")

    def step(chosen: Column, c: Column, target: Column) -> Column:
        clash = F.exists(
            chosen, lambda o: (B.box_iou(c["box"], o["box"]) >= NMS_IOU) | (V.cosine_similarity(c["vector"], o["vector"]) >= SAME_VECTOR)
        )
        pick = F.array(F.struct(c["box_no"].alias("box_no"), c["head_score"].alias("head_score"), c["box"].alias("box"), c["vector"].alias("vector")))
        return F.when((F.size(chosen) >= target) | clash, chosen).otherwise(F.concat(chosen, pick))

    folded = F.aggregate(F.col("list"), start, lambda acc, c: step(acc, c, F.col("target")))
    return lists.select("image_id", folded.alias("chosen"), "target")


def region_queries(images: DataFrame, scorer: Callable[[DataFrame], Column], weights: list[tuple[int, float]]) -> DataFrame:
    """(image_id, region, weight, embedding): the full image, then head regions.

    ``images`` also holds the full-image ``vector``. A first set of boxes is
    scored for every image, a second one only where the first gave too few or
    too weak regions; images without any region get three fixed crops.
    """
    images = images.withColumnRenamed("vector", "full_vector")
    first, last = _limits(F.col("subject_count"))
    boxes = explode_boxes(images)
    one = materialize(score_boxes(boxes.filter(F.col("box_no") < first), scorer, weights), "regions-first")
    picked = nms_select(one)
    weak = (F.size("chosen") < F.col("target")) | (F.coalesce(F.get("chosen", F.lit(0))["head_score"], F.lit(0.0)) < FALLBACK_SCORE)
    tried = images.select("image_id").join(picked, "image_id", "left")  # an image whose boxes all failed tries again as well
    again = materialize(tried.filter(F.col("chosen").isNull() | weak).select("image_id"), "regions-again")
    more = boxes.filter((F.col("box_no") >= first) & (F.col("box_no") < last)).join(again, "image_id", "left_semi")
    two = score_boxes(more, scorer, weights)
    second = nms_select(one.join(again, "image_id", "left_semi").unionByName(two))
    chosen = picked.join(again, "image_id", "left_anti").unionByName(second)
    heads = chosen.select("image_id", F.posexplode("chosen").alias("pos", "c")).select(
        "image_id", (F.col("pos") + 1).alias("region"), B.region_weight(F.col("c.head_score")).alias("weight"), F.col("c.vector").alias("embedding")
    )
    specs = F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip("ltrb", box)], F.lit(w).alias("w")) for box, w in B.FALLBACK_REGIONS])
    bare = images.join(heads.select("image_id").distinct(), "image_id", "left_anti")
    crops = bare.select("*", F.posexplode(specs).alias("pos", "s"))
    crops = crops.withColumn("box", B.crop_box(F.col("width"), F.col("height"), F.col("s.l"), F.col("s.t"), F.col("s.r"), F.col("s.b")))
    crops = crops.filter(F.col("box").isNotNull())
    fixed = crops.withColumn("embedding", scorer(crops)).filter(F.col("embedding").isNotNull()).select(
        "image_id", (F.col("pos") + 1).alias("region"), F.col("s.w").alias("weight"), "embedding"
    )
    full = images.select("image_id", F.lit(0).alias("region"), F.lit(B.FULL_IMAGE_WEIGHT).alias("weight"), F.col("full_vector").alias("embedding"))
    return full.unionByName(heads).unionByName(fixed)
