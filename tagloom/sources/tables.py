"""Vector tables, keyword write sets and landed metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import localize
from tagloom.functions.text import extension, metadata_tokens, path_key

# Formats that also carry the Windows keyword field.
XP_EXTENSIONS = (".jpg", ".jpeg", ".tif", ".tiff")


def keyword_write_set(rows: DataFrame) -> DataFrame:
    """Fields a metadata writer applies per file: keywords joined with '; '."""
    text = F.array_join("keywords", "; ")
    xp = F.when(extension(F.col("image_path")).isin(*XP_EXTENSIONS), text)
    return rows.filter(F.size("keywords") > 0).withColumns(
        {"subject": text, "iptc_keywords": text, "xp_keywords": xp}
    )


def _field_tokens(payload: Column, name: str) -> Column:
    """Tokens of a field that holds one text or a list of texts."""
    value = F.try_variant_get(payload, f"$.{name}", "variant")
    many = F.try_variant_get(value, "$", "array<string>")
    one = F.array(F.try_variant_get(value, "$", "string"))
    is_list = F.schema_of_variant(value).startswith("ARRAY")
    return metadata_tokens(F.array_join(F.when(is_list, many).otherwise(one), ";"))


def metadata_source(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """Existing keywords per selected file from landed metadata.

    ``rows(batch, batch_pos, payload)`` holds JSON texts, ``selected(batch,
    batch_pos, path)`` the files asked for. A payload belongs to the file it
    names, else to the file at its place in the batch. Subject and Keywords
    come first; the Windows field counts only if they give nothing.
    """
    v = F.try_parse_json("payload")
    parsed = rows.select("batch", "batch_pos", v.alias("v")).filter(F.col("v").isNotNull())
    first = F.array_distinct(F.concat(_field_tokens(F.col("v"), "Subject"), _field_tokens(F.col("v"), "Keywords")))
    tokens = F.when(F.size(first) > 0, first).otherwise(_field_tokens(F.col("v"), "XPKeywords"))
    parsed = parsed.select(
        "batch", "batch_pos", path_key(F.try_variant_get("v", "$.SourceFile", "string")).alias("named"), tokens.alias("tokens")
    ).filter(F.size("tokens") > 0)
    keys = selected.select("batch", "batch_pos", path_key(F.col("path")).alias("key"))
    by_name = parsed.join(keys.select(F.col("key").alias("named")).distinct(), "named", "left_semi")
    by_place = (
        parsed.join(keys.select(F.col("key").alias("named")).distinct(), "named", "left_anti")
        .join(keys, ["batch", "batch_pos"])
    )
    both = by_name.select("batch", "batch_pos", F.col("named").alias("key"), "tokens").unionByName(
        by_place.select("batch", "batch_pos", "key", "tokens")
    )
    return both.groupBy("key").agg(F.max_by("tokens", F.struct("batch", "batch_pos")).alias("tokens"))


def write_vector_table(refs: DataFrame, path: str, model: str, now: str) -> None:
    """Vectors plus a one-row metadata table."""
    refs.write.parquet(f"{path}/rows")
    meta = refs.agg(F.count(F.lit(1)).alias("count"), F.max(F.size("embedding")).alias("dimension"))
    meta.select(F.lit(model).alias("model"), "dimension", "count", F.lit(now).alias("build_time")).write.parquet(f"{path}/meta")


def read_vector_table(spark: SparkSession, path: str, strict_dimension: bool = False) -> DataFrame:
    """Load vectors; a row count that differs from the metadata is an error.

    A differing dimension is ignored unless ``strict_dimension`` is set.
    """
    rows = spark.read.parquet(f"{path}/rows")
    meta = spark.read.parquet(f"{path}/meta").first()
    if rows.count() != meta["count"]:
        raise ValueError("vector rows and metadata lengths differ")
    if strict_dimension:
        check = F.assert_true(F.size("embedding") == meta["dimension"], F.lit("vector dimension differs"))
        rows = rows.filter(check.isNull())
    return rows


LIBRARY = (
    "ARRAY<STRUCT<id:STRING,display_name:STRING,aliases:ARRAY<STRUCT<name:STRING,language:STRING>>,"
    "provider:STRING,provider_entity_id:STRING,provider_links:ARRAY<STRUCT<provider:STRING,provider_entity_id:STRING>>>>"
)


def library_records(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Entities of landed library files, other columns kept: records with an
    id, their alias entries and links. A body that is no list, or that does not
    parse, has none."""
    others = [c for c in bodies.columns if c != body]
    lists = bodies.filter(F.startswith(F.trim(F.col(body)), F.lit("[")))
    rows = lists.select(*others, F.explode(F.filter(F.from_json(body, LIBRARY), lambda r: r["id"].isNotNull())).alias("r"))
    return rows.select(
        *others, "r.id", "r.display_name", localize.alias_entries(F.col("r.display_name"), F.col("r.aliases")).alias("aliases"),
        localize.provider_links(F.col("r.provider"), F.col("r.provider_entity_id"), F.col("r.provider_links")).alias("provider_links"),
    )
