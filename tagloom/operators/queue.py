"""The annotation queue: selection, replace, append, keyword append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import distinct_case_free, distinct_texts, path_key, strip


def queue_selection(queue: DataFrame, selected: DataFrame) -> DataFrame:
    """Last queue row per selected path key: ``queue(path, line_no, ...)``."""
    keyed = queue.withColumn("path_key", path_key(F.col("path")))
    wanted = selected.select(path_key(F.col("path")).alias("path_key")).distinct()
    rows = keyed.join(wanted, "path_key", "left_semi")
    others = [c for c in rows.columns if c not in ("path_key", "line_no")]
    last = rows.groupBy("path_key").agg(F.max_by(F.struct(*others), "line_no").alias("_r"), F.max("line_no").alias("line_no"))
    return last.select("path_key", "line_no", "_r.*")


def _merged(queue: DataFrame, edits: DataFrame) -> DataFrame:
    new = edits.select(path_key(F.col("image_path")).alias("_key"), F.col("image_path").alias("_path"), F.col("feature_tags").alias("_tags"))
    return queue.withColumn("_key", path_key(F.col("image_path"))).join(new, "_key", "full_outer")


def _finish(rows: DataFrame, columns: list[str], now: str) -> DataFrame:
    edited = F.col("_path").isNotNull()
    empty = F.array().cast("array<string>")
    filled = {
        "image_path": F.coalesce("image_path", "_path"),
        "characters": F.coalesce("characters", empty),
        "source_game": F.coalesce("source_game", empty),
        "review_required": F.coalesce("review_required", F.lit(False)),
        "status": F.coalesce("status", F.lit("labeled_draft")),
        "created_at": F.coalesce("created_at", F.lit(now)),
        "updated_at": F.when(edited, F.lit(now)).otherwise(F.col("updated_at")),
    }
    return rows.withColumns(filled).select(*columns)


def queue_replace(queue: DataFrame, edits: DataFrame, now: str) -> DataFrame:
    """Replace the tags of edited paths, add missing rows, defaults only where absent."""
    rows = _merged(queue, edits)
    tags = F.when(F.col("_path").isNotNull(), distinct_texts(F.col("_tags"))).otherwise(F.col("feature_tags"))
    return _finish(rows.withColumn("feature_tags", tags), queue.columns, now)


def queue_append(queue: DataFrame, edits: DataFrame, now: str) -> DataFrame:
    """Append tags in order, each once; add missing rows."""
    rows = _merged(queue, edits)
    empty = F.array().cast("array<string>")
    both = distinct_texts(F.concat(F.coalesce("feature_tags", empty), F.coalesce("_tags", empty)))
    tags = F.when(F.col("_path").isNotNull(), both).otherwise(F.col("feature_tags"))
    return _finish(rows.withColumn("feature_tags", tags), queue.columns, now)


def metadata_append(selected: DataFrame, existing: DataFrame, replace: bool = False, names: DataFrame | None = None) -> DataFrame:
    """Keywords to write per selected item: ``selected(key, tokens)`` united
    with ``existing(key, keywords)``, old ones first; ``replace`` drops the old.

    ``names(token, name)`` gives display names; a token without one stands for
    itself. New keywords are distinct without regard to case. Keys are unique.
    """
    empty = F.array().cast("array<string>")
    if names is not None:
        tokens = selected.select("key", F.posexplode("tokens").alias("pos", "raw")).withColumn("token", strip(F.col("raw")))
        shown = tokens.join(names.select("token", F.nullif(strip(F.col("name")), F.lit("")).alias("name")), "token", "left")
        item = F.struct("pos", F.coalesce("name", "token").alias("name"))
        shown = shown.groupBy("key").agg(F.sort_array(F.collect_list(item)).alias("items"))
        shown = shown.select("key", F.transform("items", lambda e: e["name"]).alias("tokens"))
        selected = selected.select("key").join(shown, "key", "left").withColumn("tokens", F.coalesce("tokens", empty))
    selected = selected.withColumn("tokens", distinct_case_free(F.col("tokens")))
    rows = selected.join(existing, "key", "left")
    old = empty if replace else F.coalesce("keywords", empty)
    return rows.select("key", distinct_texts(F.concat(old, F.col("tokens"))).alias("keywords"))


def bulk_summary(items: DataFrame) -> DataFrame:
    """One row from per-entity results (added, pruned, failed)."""
    changed = (F.col("added") > 0) | (F.col("pruned") > 0)
    return items.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(changed & ~F.col("failed")).alias("updated"),
        F.count_if(~changed & ~F.col("failed")).alias("skipped"),
        F.count_if("failed").alias("failed"),
        F.coalesce(F.sum("added"), F.lit(0)).alias("added"),
        F.coalesce(F.sum("pruned"), F.lit(0)).alias("pruned"),
    )


def drop_tagged(rows: DataFrame, tagged: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no tags yet."""
    return rows.join(tagged.select(key), key, "left_anti")
