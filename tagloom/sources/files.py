"""File listings, path lists, record ids, JSON and CSV in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from tagloom.functions.text import extension, path_key, strip

# Three default extension lists.
SCAN_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif", ".tif", ".tiff")
QUEUE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif")
WRITABLE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff")

LINK = t.StructType([t.StructField("provider", t.StringType()), t.StructField("provider_entity_id", t.StringType())])
ALIAS = t.StructType([t.StructField("name", t.StringType()), t.StructField("language", t.StringType())])
RECORD_SCHEMA = (
    "image_id STRING, image_path STRING, characters ARRAY<STRING>, feature_tags ARRAY<STRING>, "
    "source_game ARRAY<STRING>, review_required BOOLEAN, status STRING, created_at STRING"
)


def scan_media(
    spark: SparkSession, root: str, extensions: tuple[str, ...] = SCAN_EXTENSIONS, recursive: bool = True
) -> DataFrame:
    """(path, length) of the media files under a root, in path order.

    Only the listing is read: the content column is pruned.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    return media_paths(files.select("path", "length"), extensions)


def media_paths(files: DataFrame, extensions: tuple[str, ...] = SCAN_EXTENSIONS) -> DataFrame:
    """The rows of ``files(path, ...)`` that are media files, in path order."""
    return files.filter(extension(F.col("path")).isin(*extensions)).orderBy("path")


def scan_path_list(lines: DataFrame, extensions: tuple[str, ...], root: str = "") -> DataFrame:
    """``lines(line_no, value)`` -> distinct usable paths, first spelling kept."""
    path = strip(F.col("value"))
    if root:
        absolute = path.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:)")
        path = F.when(absolute, path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    rows = lines.select("line_no", path.alias("path")).filter(strip(F.col("value")) != "")
    rows = rows.filter(extension(F.col("path")).isin(*extensions))
    first = rows.groupBy(path_key(F.col("path")).alias("key")).agg(F.min_by("path", "line_no").alias("path"))
    return first.select("path").orderBy("path")


def content_id(content: Column) -> Column:
    return F.sha1(content)


def pending_queue(images: DataFrame, now: str) -> DataFrame:
    """Empty-label records for ``images(image_id, image_path)``."""
    none = F.array().cast("array<string>")
    return images.select(
        "image_id",
        "image_path",
        none.alias("characters"),
        none.alias("feature_tags"),
        none.alias("source_game"),
        F.lit(True).alias("review_required"),
        F.lit("pending").alias("status"),
        F.lit(now).alias("created_at"),
    )


def write_jsonl(df: DataFrame, path: str) -> int:
    """Write JSON lines; the row count is observed in the same job."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.json(path)
    return seen.get["rows"]


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Read JSON lines. Blank lines are skipped; ``strict`` fails on a bad line,
    otherwise bad and non-object lines drop."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).filter(F.trim("value").startswith("{"))
    return parse_json_lines(lines, "value", schema)


def parse_json_lines(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """The tolerant parse over a text column; other columns are kept."""
    probe = F.from_json(
        F.col(column), schema + ", _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}
    )
    rows = lines.filter(F.trim(column).startswith("{")).withColumn("_r", probe)
    good = rows.filter(F.col("_r").isNotNull() & F.col("_r._corrupt").isNull())
    others = [c for c in lines.columns if c != column]
    return good.select(*others, "_r.*").drop("_corrupt")


def write_csv(df: DataFrame, path: str) -> int:
    """Header plus rows; an empty input is an error."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("header", True).csv(path)
    rows = seen.get["rows"]
    if rows == 0:
        raise ValueError("no rows to write")
    return rows


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(pos, name, category) of a vocabulary CSV with explicit positions."""
    return spark.read.schema("pos INT, name STRING, category STRING").option("header", True).csv(path)


def vocab_positions(vocab: DataFrame, name: Column, last_wins: bool = True) -> DataFrame:
    """One position per name: the last duplicate, or the first for audits."""
    pick = F.max if last_wins else F.min
    return vocab.groupBy(name.alias("name")).agg(pick("pos").alias("pos")).filter(F.col("name") != "")
