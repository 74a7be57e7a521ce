"""Landed rule documents (JSON) to rule tables.

Documents are read by schema; what differs between them stays VARIANT. A base
document and any number of extensions are merged field by field, each field
under its own law:

- ordered lists: union, the first of equals keeps its place;
- objects with an id (categories, their tags, post rules): the base's objects,
  then the extensions' of ids not seen before;
- named lists (exclusive groups, display layers): union per name; a name that
  no extension touches stays as it is;
- caps: whole numbers of at least 0, the last valid one counts;
- aliases: union per canonical id; deprecated ids: the last one counts.

Every law is an aggregate over long rows, so documents may be many and large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.text import strip
from tagloom.operators.ranking import running_numbers

# The fields of the documents. An extension holds them under the section's name.
SECTIONS = {
    "taxonomy": "categories ARRAY<VARIANT>, mutually_exclusive_groups MAP<STRING, VARIANT>",
    "priority_rules": (
        "tag_priority_order ARRAY<VARIANT>, display_tag_priority ARRAY<VARIANT>, adult_display_layer_order ARRAY<VARIANT>, "
        "adult_display_layers MAP<STRING, VARIANT>, post_rules ARRAY<VARIANT>, "
        "conflict_resolution STRUCT<blocked_tags: ARRAY<VARIANT>, adult_hard_review_tags: ARRAY<VARIANT>, max_tags_per_category: MAP<STRING, VARIANT>>"
    ),
    "synonyms": "canonical_to_aliases MAP<STRING, VARIANT>, deprecated_tags MAP<STRING, VARIANT>",
}
LISTS = ("tag_priority_order", "display_tag_priority", "adult_display_layer_order", "conflict_resolution.blocked_tags", "conflict_resolution.adult_hard_review_tags")


def read_documents(spark: SparkSession, base: str, extensions: list[str] | None = None) -> DataFrame:
    """(layer, number, body): whole files under ``base`` as layer 0 and those
    under each extension path as the next layers, numbered by file name."""
    parts = []
    for layer, path in enumerate([base, *(extensions or [])]):
        files = spark.read.text(path, wholetext=True).select(F.lit(layer).alias("layer"), F.input_file_name().alias("file"), F.col("value").alias("body"))
        parts.append(running_numbers(files, ["layer"], ["file"], "number").select("layer", "number", "body"))
    return reduce(DataFrame.unionByName, parts)


def section(documents: DataFrame, name: str) -> DataFrame:
    """(layer, number, r): one section of (layer, number, body); fields of the
    wrong kind, and documents that are no object, hold nothing."""
    fields = SECTIONS[name]
    inner = ", ".join(f"{k}: {v}" for k, v in (f.split(" ", 1) for f in _split_fields(fields)))
    extension = F.from_json("body", f"{name} STRUCT<{inner}>")[name]
    return documents.select("layer", "number", F.when(F.col("layer") == 0, F.from_json("body", fields)).otherwise(extension).alias("r")).filter("r IS NOT NULL")


def _split_fields(fields: str) -> list[str]:
    out, depth, word = [], 0, ""
    for c in fields:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word.strip())
            word = ""
        else:
            word += c
    return [*out, word.strip()]


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text(v: Column, path: str = "$") -> Column:
    return strip(F.try_variant_get(v, path, "string"))


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


ORDER = ("layer", "number", "at")


def _numbered(rows: DataFrame, keys: list[str], name: str = "ordinal") -> DataFrame:
    return running_numbers(rows, keys, ["o"], name).drop("o")


def ranked_lists(documents: DataFrame) -> DataFrame:
    """(list, ordinal, value): the ordered lists of the priority rules, texts
    only, from 0."""
    rules = section(documents, "priority_rules")
    parts = [rules.select(F.lit(name.split(".")[-1]).alias("list"), "layer", "number", F.posexplode(f"r.{name}").alias("at", "v")) for name in LISTS]
    rows = reduce(DataFrame.unionByName, parts).filter(_kind(F.col("v")) == "STRING").withColumn("value", _text(F.col("v"))).filter("value <> ''")
    return _numbered(rows.groupBy("list", "value").agg(F.min(F.struct(*ORDER)).alias("o")), ["list"]).select("list", "ordinal", "value")


def named_lists(rows: DataFrame, texts_only: bool) -> DataFrame:
    """(name_ordinal, name, ordinal, value) from (layer, number, at, name, v):
    names in the order of first sight, values by the law of named lists."""
    rows = rows.select("layer", "number", "at", F.when(F.col("layer") == 0, F.col("name")).otherwise(strip(F.col("name")) if texts_only else F.col("name")).alias("name"), _items(F.col("v")).alias("items"))
    rows = rows.filter("items IS NOT NULL AND name <> ''")
    names = rows.groupBy("name").agg(F.min(F.struct(*ORDER)).alias("o"), (F.max("layer") > 0).alias("touched"))
    names = running_numbers(names, [], ["o"], "name_ordinal").drop("o")
    values = rows.select("layer", "number", "at", "name", F.posexplode("items").alias("place", "v"))
    if texts_only:
        values = values.filter((F.col("layer") == 0) | (_kind(F.col("v")) == "STRING"))
    values = values.withColumn("raw", F.try_variant_get("v", "$", "string")).join(names, "name")
    value = F.when(F.col("touched"), strip(F.col("raw"))).otherwise(F.col("raw"))
    values = values.withColumn("value", value).filter(F.col("value").isNotNull() & (~F.col("touched") | (F.col("value") != "")))
    first = values.groupBy("name_ordinal", "name", "value").agg(F.min(F.struct(*ORDER, "place")).alias("o"))
    return _numbered(first, ["name"]).select("name_ordinal", "name", "ordinal", "value")


def exclusive_groups(documents: DataFrame) -> DataFrame:
    """(name_ordinal, name, ordinal, value) of the mutually exclusive groups."""
    rows = section(documents, "taxonomy").select("layer", "number", F.posexplode("r.mutually_exclusive_groups").alias("at", "name", "v"))
    return named_lists(rows, texts_only=False)


def display_layers(documents: DataFrame) -> DataFrame:
    rows = section(documents, "priority_rules").select("layer", "number", F.posexplode("r.adult_display_layers").alias("at", "name", "v"))
    return named_lists(rows, texts_only=True)


def taxonomy(documents: DataFrame) -> DataFrame:
    """(tag_id, category_id, ordinal, body): each tag's category and its object
    as JSON. Extensions add tags of new ids to a category of the same id and
    new categories at the end; a tag in several places counts at its last."""
    found = section(documents, "taxonomy").select("layer", "number", F.posexplode("r.categories").alias("at", "v"))
    found = found.select(F.struct(*ORDER).alias("own"), "layer", _text(F.col("v"), "$.id").alias("category_id"), F.try_variant_get("v", "$.tags", "array<variant>").alias("tags"))
    found = found.filter("category_id <> ''")
    base = F.max(F.when(F.col("layer") == 0, F.col("own")))
    home = found.groupBy("category_id").agg(F.coalesce(base, F.min("own")).alias("home"))
    tags = found.select("own", "layer", "category_id", F.posexplode("tags").alias("place", "tag")).filter(_kind(F.col("tag")).startswith("OBJECT"))
    tags = tags.withColumn("tag_id", _text(F.col("tag"), "$.id")).filter("tag_id <> ''").join(home, "category_id")
    whole = (F.col("layer") == 0) | (F.col("own") == F.col("home"))  # lists that are taken as they are
    order = F.struct(F.when(whole, F.col("own")).otherwise(F.col("home")).alias("home"), (~whole).alias("added"), "own", "place")
    tags = tags.select("category_id", "tag_id", whole.alias("whole"), F.struct(order.alias("o"), F.to_json("tag").alias("body")).alias("e"))
    kept = tags.groupBy("category_id", "tag_id").agg(
        F.coalesce(F.max_by("e", F.when(F.col("whole"), F.col("e.o"))), F.min_by("e", F.when(~F.col("whole"), F.col("e.o")))).alias("e"))
    last = kept.groupBy("tag_id").agg(F.max_by(F.struct("category_id", "e"), F.col("e.o")).alias("k"))
    rows = last.select("tag_id", "k.category_id", F.col("k.e.o").alias("o"), F.col("k.e.body").alias("body"))
    return _numbered(rows, []).select("tag_id", "category_id", "ordinal", "body")


def category_caps(documents: DataFrame) -> DataFrame:
    """(category_id, cap): texts and numbers that hold a whole number; others
    leave the earlier cap."""
    rows = section(documents, "priority_rules").select("layer", "number", F.posexplode("r.conflict_resolution.max_tags_per_category").alias("at", "category_id", "v"))
    number = F.try_variant_get("v", "$", "bigint")
    cap = F.when((F.col("layer") > 0) & (number < 0), F.lit(0).cast("bigint")).otherwise(number)
    rows = rows.withColumn("cap", cap).filter("cap IS NOT NULL")
    return rows.groupBy("category_id").agg(F.max_by("cap", F.struct(*ORDER)).alias("cap"))


def post_rules(documents: DataFrame) -> DataFrame:
    """(ordinal, rule_id, body): all rules of the base, then those of new ids."""
    rows = section(documents, "priority_rules").select("layer", "number", F.posexplode("r.post_rules").alias("at", "v"))
    rows = rows.select("layer", F.struct(*ORDER).alias("o"), F.when(_kind(F.col("v")).startswith("OBJECT"), F.coalesce(_text(F.col("v"), "$.id"), F.lit(""))).alias("rule_id"), F.to_json("v").alias("body"))
    base, more = rows.filter("layer = 0"), rows.filter("layer > 0 AND rule_id <> ''")
    first = more.groupBy("rule_id").agg(F.min_by(F.struct("o", "body"), "o").alias("k")).select("rule_id", "k.o", "k.body")
    new = first.join(base.filter("rule_id <> ''").select("rule_id").distinct(), "rule_id", "left_anti")
    return _numbered(base.select("rule_id", "o", "body").unionByName(new), []).select("ordinal", "rule_id", "body")


def alias_rows(documents: DataFrame) -> DataFrame:
    """(token, canonical_id, ordinal, deprecated), as ``tags.alias_map`` takes
    them: a canonical id comes before its own aliases, deprecated ids last."""
    rules = section(documents, "synonyms")
    lists = rules.select("layer", "number", F.posexplode("r.canonical_to_aliases").alias("at", "name", "v")).withColumn("canonical_id", strip(F.col("name"))).filter("canonical_id <> ''")
    home = lists.groupBy("canonical_id").agg(F.min(F.struct(*ORDER)).alias("home"))
    tokens = lists.select("layer", "number", "at", "canonical_id", F.posexplode(_items(F.col("v"))).alias("place", "item")).withColumn("token", _text(F.col("item"))).filter("token <> ''")
    tokens = tokens.groupBy("canonical_id", "token").agg(F.min(F.struct(*ORDER, "place")).alias("own")).join(home, "canonical_id")
    own = home.select("canonical_id", F.col("canonical_id").alias("token"), F.struct("home.*", F.lit(-1).alias("place")).alias("own"), "home")
    old = rules.select("layer", "number", F.posexplode("r.deprecated_tags").alias("at", "name", "v"))
    old = old.withColumn("token", strip(F.col("name"))).withColumn("canonical_id", _text(F.col("v"))).filter("token <> '' AND canonical_id <> ''")
    old = old.groupBy("token").agg(F.max_by("canonical_id", F.struct(*ORDER)).alias("canonical_id"), F.min(F.struct(*ORDER)).alias("home"))
    rows = tokens.unionByName(own).select("token", "canonical_id", F.struct(F.lit(False).alias("deprecated"), "home", "own").alias("o"))
    rows = rows.unionByName(old.select("token", "canonical_id", F.struct(F.lit(True).alias("deprecated"), "home", F.struct("home.*", F.lit(0).alias("place")).alias("own")).alias("o")))
    return _numbered(rows.withColumn("deprecated", F.col("o.deprecated")), []).select("token", "canonical_id", "ordinal", "deprecated")


def rule_tables(taxonomies: DataFrame, priorities: DataFrame, synonyms: DataFrame) -> dict[str, DataFrame]:
    """All rule tables of three kinds of documents, by name."""
    return {
        "taxonomy": taxonomy(taxonomies), "groups": exclusive_groups(taxonomies), "lists": ranked_lists(priorities), "layers": display_layers(priorities),
        "caps": category_caps(priorities), "post_rules": post_rules(priorities), "aliases": alias_rows(synonyms),
    }
