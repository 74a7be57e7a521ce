"""Queries over predictions: thresholds, canonical tags, keyword lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tagloom.functions.text import extension
from tagloom.operators import tags as T
from tagloom.plans.fixtures import (
    COUNT_PREDICTIONS, DISJOINT_GROUPS, IMAGES, MINIMUM, OVERLAPPING_GROUPS, PREDICTIONS, RULES, rule, rule_ctes,
)
from tagloom.plans.registry import Data, query, values
from tagloom.session import materialize
from tagloom.sources import rules as R
from tagloom.sources.files import WRITABLE_EXTENSIONS

NOW = "2024-01-01T00:00:00"
ROOT = "/data/lib"


def _token(c: str) -> str:
    return f"regexp_replace(replace(replace(lower(trim({c})), '-', '_'), ' ', '_'), '[^a-z0-9_]+', '', 'g')"


def _in(tags: list[str]) -> str:
    return "(" + ", ".join(f"'{t}'" for t in tags) + ")"


def _fold_ctes() -> str:
    parts, prev = [], "known_first"
    for i, (_, members) in enumerate(OVERLAPPING_GROUPS):
        name = f"fold{i}"
        parts.append(
            f"{name} AS (SELECT image_id, pos, tag FROM (SELECT *, min(CASE WHEN tag IN {_in(members)} THEN pos END)"
            f" OVER (PARTITION BY image_id) AS w FROM {prev}) WHERE tag NOT IN {_in(members)} OR pos = w)"
        )
        prev = name
    return ", ".join(parts) + f", folded AS (SELECT * FROM {prev})"


CTES = f"""WITH {rule_ctes()},
predictions AS ({PREDICTIONS}),
images AS ({IMAGES}),
known_alias AS (SELECT * FROM aliases WHERE canonical_id IN (SELECT tag_id FROM taxonomy)),
alias_rows AS (
  SELECT {_token('token')} AS token, canonical_id, deprecated, CAST(ordinal AS DOUBLE) AS ordinal FROM known_alias
  UNION ALL SELECT {_token('canonical_id')}, canonical_id, FALSE, min(ordinal) - 0.5 FROM known_alias WHERE NOT deprecated GROUP BY canonical_id),
alias_map AS (
  SELECT token, canonical_id FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY deprecated DESC, ordinal DESC) AS rn
    FROM alias_rows WHERE token <> '') WHERE rn = 1),
matched AS (SELECT p.*, a.token, a.canonical_id FROM predictions p JOIN alias_map a ON {_token('p.tag')} = a.token),
passed AS (
  SELECT m.* FROM matched m LEFT JOIN taxonomy t ON t.tag_id = m.canonical_id
  LEFT JOIN thresholds c ON c.scope = 'category' AND c.key = t.category_id
  LEFT JOIN thresholds g ON g.scope = 'tag' AND g.key = m.canonical_id
  WHERE m.score >= coalesce(g.min_score, c.min_score, {MINIMUM})),
canon AS (
  SELECT image_id, canonical_id AS tag, score, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, pos, canonical_id) AS pos
  FROM (SELECT *, row_number() OVER (PARTITION BY image_id, canonical_id ORDER BY score DESC, pos) AS rn FROM passed
        WHERE category IN ('general', 'rating') AND canonical_id NOT IN (SELECT tag_id FROM blocked)) WHERE rn = 1),
raw_list AS (SELECT image_id, pos, {_token('tag')} AS tag FROM predictions),
known_first AS (
  SELECT image_id, tag, min(pos) AS pos FROM (SELECT image_id, tag, pos FROM canon)
  WHERE tag IN (SELECT tag_id FROM taxonomy) AND tag NOT IN (SELECT tag_id FROM blocked) GROUP BY image_id, tag),
{_fold_ctes()},
precise AS (
  SELECT image_id, pos, tag FROM (
    SELECT f.*, c.cap, row_number() OVER (PARTITION BY image_id, t.category_id ORDER BY pos) AS place
    FROM folded f JOIN taxonomy t ON t.tag_id = f.tag LEFT JOIN caps c ON c.category_id = t.category_id)
  WHERE place <= coalesce(cap, 999)),
sorted AS (
  SELECT p.image_id, p.tag, coalesce(t.name, p.tag) AS name,
         row_number() OVER (PARTITION BY p.image_id ORDER BY coalesce(cr.rank, 999), coalesce(tr.rank, 999), p.pos) AS pos
  FROM precise p JOIN taxonomy t ON t.tag_id = p.tag LEFT JOIN category_rank cr ON cr.category_id = t.category_id
  LEFT JOIN tag_rank tr ON tr.tag_id = p.tag),
characters AS (
  SELECT image_id, tag AS name, min(pos) AS pos FROM predictions WHERE category = 'character' AND score >= 0.85 GROUP BY image_id, tag),
works AS (
  SELECT image_id, work, min(pos) AS pos FROM predictions JOIN work_map ON {_token('tag')} = token
  WHERE category = 'copyright' AND score >= 0.70 GROUP BY image_id, work),
keyword_rows AS (
  SELECT image_id, keyword, min(o) AS o FROM (
    SELECT image_id, name AS keyword, pos AS o FROM (SELECT image_id, name, row_number() OVER (PARTITION BY image_id ORDER BY pos, name) AS pos FROM characters)
    UNION ALL SELECT image_id, name, 1000 + pos FROM sorted
    UNION ALL SELECT image_id, work, 2000 + row_number() OVER (PARTITION BY image_id ORDER BY pos, work) FROM works)
  GROUP BY image_id, keyword),
keywords AS (SELECT image_id, string_agg(keyword, '; ' ORDER BY o) AS keywords, count(*) AS n FROM keyword_rows GROUP BY image_id)
"""


# ------------------------------------------------------------------ inputs


def predictions(d: Data):
    return d.sql(PREDICTIONS)


def aliases(d: Data):
    return T.alias_map(rule(d, "aliases"), rule(d, "taxonomy"))


def canon(d: Data):
    return T.canonicalize(
        predictions(d), aliases(d), rule(d, "taxonomy"), rule(d, "thresholds"), rule(d, "blocked"), MINIMUM
    )


def precise(d: Data):
    return T.precision_filter(
        canon(d).select("image_id", "pos", "tag"), rule(d, "taxonomy"), rule(d, "blocked"), OVERLAPPING_GROUPS, rule(d, "caps")
    )


def sorted_tags(d: Data):
    rows = T.display_sort(precise(d), rule(d, "taxonomy"), rule(d, "category_rank"), rule(d, "tag_rank"))
    return T.taxonomy_join(rows, rule(d, "taxonomy"))


def work_rows(d: Data):
    return T.works(predictions(d), rule(d, "work_map"))


def token_rules(d: Data):
    return T.token_rules(
        aliases(d), rule(d, "taxonomy"), rule(d, "thresholds"), rule(d, "blocked"), rule(d, "caps"), rule(d, "category_rank"),
        rule(d, "tag_rank"), rule(d, "work_map"), MINIMUM,
    )


def labels(d: Data):
    return T.image_labels(predictions(d), token_rules(d), 0.85)


def keywords(d: Data):
    """(image_id, keywords ARRAY) for every image that has any."""
    tags = T.displayed_names(T.precise_features(F.col("features"), OVERLAPPING_GROUPS))
    rows = labels(d).select("image_id", T.keyword_list(F.col("characters"), tags, F.col("works")).alias("keywords"))
    return rows.filter(F.size("keywords") > 0)


def big(df, *names):
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in names else c for c in df.columns])


# ----------------------------------------------------------------- queries


@query("alias_canonical_join", CTES + "SELECT image_id, CAST(pos AS BIGINT) AS pos, tag, canonical_id, score FROM matched")
def _(d):
    return big(T.canonical_join(predictions(d), aliases(d)).select("image_id", "pos", "tag", "canonical_id", "score"), "pos")


@query("taxonomy_join", CTES + "SELECT image_id, CAST(pos AS BIGINT) AS pos, r.tag, t.category_id, coalesce(t.name, r.tag) AS name FROM raw_list r LEFT JOIN taxonomy t ON t.tag_id = r.tag")
def _(d):
    rows = predictions(d).select("image_id", "pos", T.normalize_token(F.col("tag")).alias("tag"))
    return big(T.taxonomy_join(rows, rule(d, "taxonomy")), "pos")


@query("tag_threshold_filter", CTES + "SELECT image_id, CAST(pos AS BIGINT) AS pos, canonical_id, score FROM passed")
def _(d):
    rows = T.canonical_join(predictions(d), aliases(d))
    kept = T.threshold_filter(rows, rule(d, "taxonomy"), rule(d, "thresholds"), MINIMUM)
    return big(kept.select("image_id", "pos", "canonical_id", "score"), "pos")


@query("tag_category_filter", CTES + "SELECT image_id, CAST(pos AS BIGINT) AS pos, tag, category, score FROM predictions WHERE category IN ('general','rating') OR (category = 'copyright' AND score >= 0.70)")
def _(d):
    return big(T.category_filter(predictions(d)), "pos")


@query("blocklist_filter", CTES + "SELECT image_id, CAST(pos AS BIGINT) AS pos, canonical_id FROM matched WHERE canonical_id NOT IN (SELECT tag_id FROM blocked)")
def _(d):
    rows = T.drop_blocked(T.canonical_join(predictions(d), aliases(d)), rule(d, "blocked"))
    return big(rows.select("image_id", "pos", "canonical_id"), "pos")


@query("known_tag_filter", CTES + "SELECT image_id, CAST(pos AS BIGINT) AS pos, tag FROM raw_list WHERE tag IN (SELECT tag_id FROM taxonomy)")
def _(d):
    rows = predictions(d).select("image_id", "pos", T.normalize_token(F.col("tag")).alias("tag"))
    return big(T.keep_known(rows, rule(d, "taxonomy")).select("image_id", "pos", "tag"), "pos")


@query("tag_canonicalize", CTES + "SELECT image_id, CAST(pos AS BIGINT) AS pos, tag, score FROM canon")
def _(d):
    return big(canon(d), "pos")


@query("copyright_game_join", CTES + "SELECT image_id, CAST(pos AS BIGINT) AS pos, work FROM works")
def _(d):
    return big(work_rows(d), "pos")


@query("infer_character_count", f"""WITH p AS ({COUNT_PREDICTIONS}), x AS (
  SELECT image_id, CASE WHEN category = 'general' AND score >= 0.35 THEN {_token('tag')} END AS t FROM p)
SELECT image_id, CAST(greatest(1, least(3, CASE WHEN coalesce(max(n), 0) > 0 THEN max(n) WHEN bool_or(many) THEN 3 ELSE 1 END)) AS BIGINT) AS subject_count
FROM (SELECT image_id, TRY_CAST(regexp_extract(t, '^(\\d+)(ring|bolt)$', 1) AS INT) AS n, coalesce(t IN ('multiple_gear', 'multiple_rod'), FALSE) AS many FROM x)
GROUP BY image_id""")
def _(d):
    rows = T.subject_count(d.sql(COUNT_PREDICTIONS), ("ring", "bolt"), ("multiple_gear", "multiple_rod"))
    return big(rows, "subject_count")


@query("effective_threshold", """SELECT l_orderkey AS image_id, CAST(l_linenumber AS BIGINT) AS line, l_partkey, l_suppkey, l_quantity,
 CASE WHEN l_linenumber <= 1 THEN 0.55::DOUBLE ELSE 0.48::DOUBLE END AS threshold,
 CAST(CASE WHEN l_suppkey - 20 <= 0 THEN 2 ELSE greatest(2, least(greatest(l_linenumber, 1), greatest(l_suppkey - 20, 0))) END AS BIGINT) AS top_k FROM @lineitem""")
def _(d):
    n, heads = F.col("l_linenumber"), F.col("l_suppkey") - 20
    return d.lineitem.select(
        F.col("l_orderkey").alias("image_id"), n.cast("bigint").alias("line"), "l_partkey", "l_suppkey", "l_quantity",
        T.effective_threshold(0.55, n, 0.48).alias("threshold"),
        T.effective_top_k(2, n, heads).cast("bigint").alias("top_k"),
    )


@query("head_score", CTES + f""", last AS (
 SELECT image_id, token, score FROM (SELECT image_id, {_token('tag')} AS token, score, row_number() OVER (PARTITION BY image_id, {_token('tag')} ORDER BY pos DESC, score DESC) AS rn
   FROM predictions WHERE category = 'general') WHERE rn = 1)
SELECT image_id, round(greatest(0, sum(score * weight)), 6) AS head_score
FROM last JOIN (SELECT {_token('tag')} AS token, weight FROM head_weights) USING (token) GROUP BY image_id""")
def _(d):
    scored = T.head_score(predictions(d).withColumn("pos", F.struct("pos", "score")), rule(d, "head_weights"))
    return scored.select("image_id", F.round("head_score", 6).alias("head_score"))


@query("exclusive_group_first", CTES + f"""SELECT image_id, CAST(pos AS BIGINT) AS pos, tag FROM (
 SELECT *, min(pos) OVER (PARTITION BY image_id, g) AS w FROM (
  SELECT image_id, pos, tag, CASE WHEN tag IN {_in(DISJOINT_GROUPS[0][1])} THEN 1 WHEN tag IN {_in(DISJOINT_GROUPS[1][1])} THEN 2 END AS g FROM canon))
WHERE g IS NULL OR pos = w""")
def _(d):
    rows = T.exclusive_first(canon(d).select("image_id", "pos", "tag"), DISJOINT_GROUPS)
    return big(rows.select("image_id", "pos", "tag"), "pos")


@query("exclusive_group_fold", CTES + "SELECT image_id, CAST(pos AS BIGINT) AS pos, tag FROM folded")
def _(d):
    rows = T.first_per_tag(T.keep_known(T.drop_blocked(canon(d), rule(d, "blocked"), "tag"), rule(d, "taxonomy")))
    return big(T.exclusive_first(rows, OVERLAPPING_GROUPS), "pos")


@query("category_cap", CTES + """SELECT image_id, CAST(pos AS BIGINT) AS pos, tag FROM (
 SELECT c.*, k.cap, row_number() OVER (PARTITION BY image_id, t.category_id ORDER BY pos) AS place
 FROM canon c JOIN taxonomy t ON t.tag_id = c.tag LEFT JOIN caps k ON k.category_id = t.category_id) WHERE place <= coalesce(cap, 999)""")
def _(d):
    return big(T.cap_categories(canon(d), rule(d, "taxonomy"), rule(d, "caps")), "pos")


@query("precision_filter", CTES + "SELECT image_id, CAST(pos AS BIGINT) AS pos, tag FROM precise")
def _(d):
    return big(precise(d), "pos")


@query("display_sort", CTES + "SELECT image_id, CAST(pos AS BIGINT) AS pos, tag, name FROM sorted")
def _(d):
    return big(sorted_tags(d).select("image_id", "pos", "tag", "name"), "pos")


@query("score_sort", CTES + "SELECT image_id, CAST(pos AS BIGINT) AS pos, tag, score FROM predictions")
def _(d):
    # a range-partitioned sort: one hot image is split over several tasks
    rows = predictions(d).orderBy("image_id", F.desc("score"), "pos")
    return big(rows.select("image_id", "pos", "tag", "score"), "pos")


@query("keyword_list", CTES + "SELECT image_id, keywords, CAST(n AS BIGINT) AS n FROM keywords")
def _(d):
    return keywords(d).select(
        "image_id", F.array_join("keywords", "; ").alias("keywords"), F.size("keywords").cast("bigint").alias("n")
    )


@query("preview_with_forced", CTES + """, listed AS (SELECT image_id, list(tag ORDER BY pos) AS tags FROM canon GROUP BY image_id)
SELECT image_id, CASE WHEN len(tags) > 2 AND list_contains(tags, 'new_bolt') AND NOT list_contains(tags[1:2], 'new_bolt')
  THEN tags[1] || '、new_bolt' ELSE array_to_string(tags[1:2], '、') END AS preview FROM listed""")
def _(d):
    rows = T.as_lists(canon(d), "tag", "tags")
    preview = T.preview_with_forced(F.col("tags"), ["new_bolt"], 2)
    return rows.select("image_id", F.array_join(preview, "、").alias("preview"))


RECORD_SQL = """records AS (
 SELECT i.image_id, CASE WHEN starts_with(i.image_path, '/data/lib/') THEN substr(i.image_path, 11) ELSE i.image_path END AS image_path,
  coalesce(c.v, '') AS characters, coalesce(t.v, '') AS feature_tags, coalesce(w.v, '') AS source_game
 FROM images i
 LEFT JOIN (SELECT image_id, string_agg(name, '|' ORDER BY pos, name) AS v FROM characters GROUP BY image_id) c USING (image_id)
 LEFT JOIN (SELECT image_id, string_agg(tag, '|' ORDER BY pos) AS v FROM canon GROUP BY image_id) t USING (image_id)
 LEFT JOIN (SELECT image_id, string_agg(work, '|' ORDER BY pos, work) AS v FROM works GROUP BY image_id) w USING (image_id))"""


def records(d: Data):
    return T.annotation_records(d.sql(IMAGES).select("image_id", "image_path"), labels(d), ROOT, NOW)


def flat_records(df):
    lists = ("characters", "feature_tags", "source_game")
    return df.select(*[F.array_join(c, "|").alias(c) if c in lists else c for c in df.columns])


@query("annotation_record", CTES + f", {RECORD_SQL} SELECT *, FALSE AS review_required, 'labeled_draft' AS status, '{NOW}' AS created_at FROM records")
def _(d):
    return flat_records(records(d))


@query("tagging_run", CTES + f", {RECORD_SQL} SELECT image_id, image_path, characters, feature_tags, source_game FROM records")
def _(d):
    return flat_records(records(d)).select("image_id", "image_path", "characters", "feature_tags", "source_game")


WRITABLE = "lower(regexp_extract(image_path, '\\.[^./]+$')) IN (" + ", ".join(f"'{e}'" for e in WRITABLE_EXTENSIONS) + ")"


@query("target_record_filter", f"WITH images AS ({IMAGES}) SELECT image_id, image_path, status FROM images WHERE status IN ('F', 'P') AND {WRITABLE}")
def _(d):
    return T.target_records(d.sql(IMAGES), ["F", "P"], WRITABLE_EXTENSIONS)


def keyword_export(d: Data):
    """Records -> ordered localised keywords; images without any drop."""
    return T.keyword_export(d.sql(IMAGES), keywords(d), ["F", "P"], WRITABLE_EXTENSIONS)


@query("keyword_export", CTES + f"SELECT image_id, image_path, keywords FROM images JOIN keywords USING (image_id) WHERE status IN ('F', 'P') AND {WRITABLE}")
def _(d):
    return keyword_export(d).select("image_id", "image_path", F.array_join("keywords", "; ").alias("keywords"))


@query("keyword_sink", CTES + f"""SELECT image_id, keywords AS subject, keywords AS iptc_keywords,
 CASE WHEN regexp_matches(lower(image_path), '\\.(jpg|jpeg|tif|tiff)$') THEN keywords END AS xp_keywords
 FROM images JOIN keywords USING (image_id) WHERE status IN ('F', 'P') AND {WRITABLE}""")
def _(d):
    from tagloom.sources.tables import keyword_write_set

    out = keyword_write_set(keyword_export(d))
    return out.select("image_id", "subject", "iptc_keywords", "xp_keywords")


@query("run_summary", CTES + f""", r AS (SELECT i.*, {WRITABLE} AND status IN ('F','P') AS w, coalesce(k.n, 0) > 0 AS filled FROM images i LEFT JOIN keywords k USING (image_id))
SELECT count(*) AS images_found, count(*) AS queue_written, count(*) FILTER (w) AS targets, count(*) FILTER (w AND filled) AS updated,
 count(*) FILTER (w AND NOT filled) AS skipped FROM r""")
def _(d):
    writable = extension(F.col("image_path")).isin(*WRITABLE_EXTENSIONS) & F.col("status").isin("F", "P")
    rows = d.sql(IMAGES).join(keywords(d), "image_id", "left")
    filled = rows.withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    return T.run_summary(filled, writable)


# ------------------------------------------------------------- rule tables

RANK_BASE = "SELECT p_name AS tag_id, min(p_partkey) AS ordinal FROM @part WHERE p_size <= 25 GROUP BY p_name"
RANK_EXTRA = "SELECT p_name AS tag_id, min(p_partkey) AS ordinal FROM @part WHERE p_size > 20 GROUP BY p_name"


# Documents: parts of size 1 to 10 make the base, each further size is an extension.
RULE_ROWS = "SELECT CASE WHEN p_size <= 10 THEN 0 ELSE p_size END AS doc, p_type, p_name, split_part(p_name, ' ', 2) AS noun, p_brand, p_partkey FROM @part"


def _document(body: str, name: str) -> str:
    """One JSON document per ``doc`` of a table that has the fields in ``body``."""
    return f"CASE WHEN doc = 0 THEN to_json(struct({body})) ELSE to_json(named_struct('{name}', struct({body}))) END"


def _named(key: str, value: str, alias: str) -> str:
    return f"SELECT doc, map_from_entries(array_sort(collect_list(struct(k, v)))) AS {alias} FROM (SELECT doc, {key} AS k, array_sort(collect_set({value})) AS v FROM rows GROUP BY doc, {key}) GROUP BY doc"


RULE_DOCUMENTS = f"""
WITH rows AS ({RULE_ROWS}),
tags AS (SELECT doc, p_type AS id, array_sort(collect_set(struct(concat(' ', p_name) AS id, concat(p_name, ' ', doc) AS name_en))) AS tags FROM rows GROUP BY doc, p_type),
categories AS (SELECT doc, array_sort(collect_list(struct(id, tags))) AS categories FROM tags GROUP BY doc),
exclusive AS ({_named('noun', 'p_name', 'mutually_exclusive_groups')}),
ranks AS (SELECT doc, transform(array_sort(collect_list(struct(k, p_name))), x -> x.p_name) AS tag_priority_order FROM (SELECT doc, p_name, min(p_partkey) AS k FROM rows GROUP BY doc, p_name) GROUP BY doc),
layers AS ({_named('p_brand', 'p_name', 'adult_display_layers')}),
caps AS (SELECT doc, map_from_entries(array_sort(collect_set(struct(p_type, CASE WHEN doc = 0 THEN '5' WHEN doc % 3 = 1 THEN 'none' WHEN doc % 3 = 2 THEN concat('-', doc) ELSE concat(' ', doc) END)))) AS max_tags_per_category FROM rows GROUP BY doc),
posts AS (SELECT doc, array_sort(collect_set(struct(p_brand AS id, doc AS source))) AS post_rules FROM rows GROUP BY doc),
names AS ({_named('p_name', 'p_type', 'canonical_to_aliases')})
SELECT CAST(doc > 0 AS INT) AS layer, doc AS number,
 {_document('categories, mutually_exclusive_groups', 'taxonomy')} AS taxonomy,
 {_document('tag_priority_order, adult_display_layers, struct(max_tags_per_category) AS conflict_resolution, post_rules', 'priority_rules')} AS priorities,
 {_document('canonical_to_aliases', 'synonyms')} AS synonyms
FROM categories JOIN exclusive USING (doc) JOIN ranks USING (doc) JOIN layers USING (doc) JOIN caps USING (doc) JOIN posts USING (doc) JOIN names USING (doc)"""


def _named_sql(kind: str, key: str) -> str:
    return f"""SELECT '{kind}' AS kind, k AS k1, p_name AS k2, dense_rank() OVER (ORDER BY home, k) - 1 AS n,
  CAST(row_number() OVER (PARTITION BY k ORDER BY d, p_name) - 1 AS VARCHAR) AS v FROM (
    SELECT *, min(d) OVER (PARTITION BY k) AS home FROM (SELECT {key} AS k, p_name, min(doc) AS d FROM r GROUP BY ALL))"""


@query("rule_merge", f"""WITH r AS ({RULE_ROWS}),
t AS (SELECT p_type, p_name, min(doc) AS d, any_value(home) AS home FROM (SELECT *, min(doc) OVER (PARTITION BY p_type) AS home FROM r) GROUP BY p_type, p_name)
SELECT 'tag' AS kind, p_type AS k1, p_name AS k2, row_number() OVER (ORDER BY home, p_type, d > home, d, p_name) - 1 AS n, concat(p_name, ' ', d) AS v
FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY home DESC, p_type DESC) AS last FROM t) WHERE last = 1
UNION ALL {_named_sql('group', 'noun')}
UNION ALL {_named_sql('layer', 'p_brand')}
UNION ALL SELECT 'rank', 'tag_priority_order', p_name, row_number() OVER (ORDER BY doc, k) - 1, '' FROM (
  SELECT p_name, doc, k, row_number() OVER (PARTITION BY p_name ORDER BY doc) AS i FROM (SELECT doc, p_name, min(p_partkey) AS k FROM r GROUP BY doc, p_name)) WHERE i = 1
UNION ALL SELECT 'cap', p_type, '', CASE WHEN max(doc) = 0 THEN 5 WHEN max(doc) % 3 = 2 THEN 0 ELSE max(doc) END, '' FROM r WHERE doc = 0 OR doc % 3 <> 1 GROUP BY p_type
UNION ALL SELECT 'post', p_brand, '', row_number() OVER (ORDER BY min(doc), p_brand) - 1, CAST(min(doc) AS VARCHAR) FROM r GROUP BY p_brand
UNION ALL SELECT 'alias', p_name, token, row_number() OVER (ORDER BY home, p_name, own, d, token) - 1, '' FROM (
  SELECT p_name, p_type AS token, 1 AS own, d, min(d) OVER (PARTITION BY p_name) AS home FROM t
  UNION ALL SELECT p_name, p_name, 0, 0, min(doc) FROM r GROUP BY p_name)""")
def _(d):
    documents = materialize(d.sql(RULE_DOCUMENTS), "rule-documents")
    body = lambda name: documents.select("layer", "number", F.col(name).alias("body"))
    tables = R.rule_tables(body("taxonomy"), body("priorities"), body("synonyms"))
    nothing, json = F.lit(""), lambda path: F.get_json_object("body", path)
    named = lambda kind, rows: rows.select(F.lit(kind).alias("kind"), F.col("name").alias("k1"), F.col("value").alias("k2"), F.col("name_ordinal").alias("n"), F.col("ordinal").cast("string").alias("v"))
    parts = [
        tables["taxonomy"].select(F.lit("tag").alias("kind"), F.col("category_id").alias("k1"), F.col("tag_id").alias("k2"), F.col("ordinal").alias("n"), json("$.name_en").alias("v")),
        named("group", tables["groups"]), named("layer", tables["layers"]),
        tables["lists"].select(F.lit("rank"), "list", "value", "ordinal", nothing), tables["caps"].select(F.lit("cap"), "category_id", nothing, "cap", nothing),
        tables["post_rules"].select(F.lit("post"), "rule_id", nothing, "ordinal", json("$.source")), tables["aliases"].select(F.lit("alias"), "canonical_id", "token", "ordinal", nothing),
    ]
    return reduce(lambda a, b: a.union(b), parts)


@query("vocab_union", f"""SELECT tag_id, CAST(layer AS BIGINT) AS layer, ordinal FROM (
 SELECT *, row_number() OVER (PARTITION BY tag_id ORDER BY layer, ordinal) AS rn FROM (
  SELECT *, 0 AS layer FROM ({RANK_BASE}) UNION ALL SELECT *, 1 FROM ({RANK_EXTRA}))) WHERE rn = 1""")
def _(d):
    return big(T.merge_rule_rows(d.sql(RANK_BASE), d.sql(RANK_EXTRA), ["tag_id"], []), "layer")
