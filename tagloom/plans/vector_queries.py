"""Queries over vectors: retrieval, re-scoring, profiles, audit, identity filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import vectors as V
from tagloom.operators import audit as A
from tagloom.operators import evidence as E
from tagloom.operators import ranking as K
from tagloom.operators import references as R
from tagloom.operators.retrieval import reference_count, vector_topk
from tagloom.operators.tags import effective_threshold, effective_top_k
from tagloom.plans.registry import Data, query

# Colour tags and the groups near colours share.
HAIR_GROUPS = {
    "black_hair": "neutral_dark", "blonde_hair": "light_neutral", "brown_hair": "neutral_dark",
    "blue_hair": "cool_blue", "green_hair": "green_cyan", "grey_hair": "neutral_dark",
    "orange_hair": "warm_red_orange", "pink_hair": "magenta_purple", "purple_hair": "magenta_purple",
    "red_hair": "warm_red_orange", "silver_hair": "light_neutral", "white_hair": "light_neutral",
    "aqua_hair": "cool_blue",
}
EYE_GROUPS = {
    "black_eyes": "neutral_dark", "brown_eyes": "neutral_dark", "blue_eyes": "cool_blue",
    "green_eyes": "green_cyan", "grey_eyes": "neutral_dark", "orange_eyes": "warm_red_orange",
    "pink_eyes": "magenta_purple", "purple_eyes": "magenta_purple", "red_eyes": "warm_red_orange",
    "yellow_eyes": "warm_red_orange", "aqua_eyes": "cool_blue",
}
SPEC = V.AttributeSpec(
    hair=[(n, i, g) for i, (n, g) in enumerate(HAIR_GROUPS.items())],
    eyes=[(n, 13 + i, g) for i, (n, g) in enumerate(EYE_GROUPS.items())],
    style=list(range(24, 40)),
    face=list(range(40, 55)),
    multi_person=list(range(55, 64)),
    closed_eyes=60,
)
AUDIT = A.AuditSpec(
    hair=[(n, i) for i, n in enumerate(HAIR_GROUPS)],
    eyes=[(n, 13 + i) for i, n in enumerate(EYE_GROUPS)],
    single_subject=[24, 25, 26],
    multi_person=list(range(55, 64)),
    screenshot_noise=[27, 28, 29],
    no_humans=30,
    outlier_similarity=0.45,
)
MIN_SCORE, TOP_K, MARGIN = 0.78, 3, 0.05


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def _cos(a: str, b: str) -> str:
    return f"({_dot(a, b)} / (sqrt({_dot(a, a)}) * sqrt({_dot(b, b)})))"


def _features(v: str, p: str) -> str:
    def best(name: str, cut: str, groups) -> str:
        return (
            f"list_max({cut}) AS {p}{name}_best, list_position({cut}, list_max({cut})) AS {p}{name}_place, "
            f"list_sort({cut}, 'DESC')[2] AS {p}{name}_second, {_list(groups)}[list_position({cut}, list_max({cut}))] AS {p}{name}_group"
        )

    return (
        best("hair", f"{v}[1:13]", HAIR_GROUPS.values()) + ", " + best("eyes", f"{v}[14:24]", EYE_GROUPS.values())
        + f", {v}[25:40] AS {p}style, {v}[41:55] AS {p}face, list_max({v}[56:64]) AS {p}multi, {v}[61] AS {p}closed"
    )


def _exclusive(name: str, bonus: float, penalty: str) -> str:
    q, r = f"q_{name}", f"r_{name}"
    return (
        f"(CASE WHEN {q}_best < 0.55 OR {q}_best - {q}_second < 0.10 OR {r}_best < 0.42 THEN 0 "
        f"WHEN {q}_place = {r}_place THEN least({q}_best, {r}_best) * {bonus} "
        f"WHEN {q}_group = {r}_group THEN least({q}_best, {r}_best) * {bonus} * 0.80 "
        f"ELSE -({penalty}) * least({q}_best, {r}_best) * least(1.0, {q}_best - {q}_second + 0.35) END)"
    )


def _detail(name: str, bonus: float, penalty: str, low: float, match: float, miss: float) -> str:
    q, r = f"q_{name}", f"r_{name}"
    return (
        f"list_sum(list_transform(range(1, len({q}) + 1), lambda i: CASE WHEN {q}[i] < {low} THEN 0::DOUBLE "
        f"WHEN {r}[i] >= {match} THEN least({q}[i], {r}[i]) * {bonus} WHEN {r}[i] <= {miss} THEN -({penalty}) * {q}[i] ELSE 0::DOUBLE END))"
    )


SCENE = "greatest(0.35, 1.0 - q_multi * 0.75)"
EYE_SCALE = f"({SCENE} * CASE WHEN q_closed >= 0.45 THEN greatest(0.25, 1.0 - q_closed) ELSE 1.0 END)"
HAIR_TERM = _exclusive("hair", 0.11, f"0.30 * {SCENE}")
EYE_TERM = _exclusive("eyes", 0.08, f"0.22 * {EYE_SCALE}")
STYLE_TERM = _detail("style", 0.035, f"0.050 * {SCENE}", 0.55, 0.42, 0.18)
FACE_TERM = _detail("face", 0.120, f"0.120 * {SCENE}", 0.25, 0.28, 0.10)
ADJUST = f"greatest(-0.28, least(0.28, {HAIR_TERM} + {EYE_TERM} + {STYLE_TERM} + {FACE_TERM}))"


def _state(name: str) -> str:
    g = f"CASE WHEN q_{name}_best >= 0.42 THEN q_{name}_group ELSE '' END"
    return f"CASE WHEN {g} <> '' AND q_{name}_best >= 0.58 AND len({name}_groups) > 0 THEN CASE WHEN list_contains({name}_groups, {g}) THEN 1 ELSE -1 END ELSE 0 END"


FACTOR = f"""(CASE WHEN hair_groups IS NULL AND eyes_groups IS NULL THEN 1.0::DOUBLE ELSE greatest(0.70, least(1.18,
 CASE {_state('hair')} WHEN 1 THEN 1.05 WHEN -1 THEN 0.88 ELSE 1.0 END::DOUBLE * CASE {_state('eyes')} WHEN 1 THEN 1.03 WHEN -1 THEN 0.92 ELSE 1.0 END::DOUBLE
 * CASE WHEN {_state('hair')} = -1 AND {_state('eyes')} = -1 THEN 0.90 ELSE 1.0 END::DOUBLE)) END)"""
WEIGHT = "CASE region WHEN 0 THEN 0.60::DOUBLE WHEN 1 THEN 0.95::DOUBLE ELSE 1.10::DOUBLE END"

CTES = f"""WITH raw AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
refs AS (SELECT vec_id AS row_index, CAST(label AS VARCHAR) AS character_id, n_name AS character_name,
  list_transform(e, lambda x: least(1.0, greatest(0.0, 3.0 * x))) AS v FROM raw LEFT JOIN nation ON n_nationkey = label),
q AS (SELECT row_index AS query_id, CAST(floor(row_index / 3.0) AS BIGINT) AS image_id, row_index % 3 AS region, v,
  {WEIGHT.replace('region', 'row_index % 3')} AS weight FROM refs),
rf AS (SELECT row_index, character_id, v AS r_v, {_features('v', 'r_')} FROM refs),
qf AS (SELECT query_id, image_id, region, weight, v AS q_v, {_features('v', 'q_')} FROM q),
profile AS (
  SELECT character_id, coalesce(list_sort(list(DISTINCT CASE WHEN r_hair_best >= 0.42 THEN r_hair_group END) FILTER (r_hair_best >= 0.42)), []) AS hair_groups,
    coalesce(list_sort(list(DISTINCT CASE WHEN r_eyes_best >= 0.42 THEN r_eyes_group END) FILTER (r_eyes_best >= 0.42)), []) AS eyes_groups FROM rf GROUP BY character_id),
neighbours AS (SELECT qf.*, rf.*, p.hair_groups, p.eyes_groups FROM qf JOIN rf ON rf.row_index = qf.query_id + 1 LEFT JOIN profile p USING (character_id)),
sims AS (SELECT query_id, row_index, round({_cos('q.v', 'refs.v')}, 12) AS similarity FROM q, refs),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, row_index) AS rank FROM sims)),
"""


def match_ctes(k: int) -> str:
    limit = max(96, 64 * k)
    return CTES + f"""m AS (
  SELECT qf.image_id, qf.region, rf.character_id, rf.row_index,
    greatest(0, least(1, similarity * {FACTOR} + {ADJUST} * CASE WHEN weight <= 0.65 THEN 0.40 WHEN weight < 0.90 THEN 0.70 ELSE 1.0 END)) * weight AS score
  FROM (SELECT * FROM top WHERE rank <= {limit} AND similarity >= 0) t JOIN qf USING (query_id) JOIN rf USING (row_index) LEFT JOIN profile p ON p.character_id = rf.character_id),
ev AS (
  SELECT image_id, character_id, max(score) AS best_score, coalesce(max(score) FILTER (region > 0), 0) AS best_head_score,
    coalesce(arg_max(region, score) FILTER (region > 0), -1) AS best_head_region,
    count(DISTINCT region) FILTER (region > 0 AND score >= {MIN_SCORE} * 0.92) AS supported_regions, count(DISTINCT row_index) AS reference_rows
  FROM m WHERE score > 0 GROUP BY image_id, character_id),
sc AS (
  SELECT ev.*, round((best_score + CASE WHEN supported_regions >= 2 THEN 0.03 * least(2, supported_regions - 1) ELSE 0 END
     + CASE WHEN reference_rows >= 2 THEN 0.012 * least(3, reference_rows - 1) ELSE 0 END)
     * CASE WHEN {k} > 1 AND h.heads >= 2 AND c.n <= 1 AND best_head_score < 0.62 THEN 0.93 ELSE 1 END, 9) AS score
  FROM ev JOIN (SELECT character_id, count(*) AS n FROM refs GROUP BY 1) c USING (character_id)
  JOIN (SELECT image_id, count(*) - 1 AS heads FROM q GROUP BY 1) h USING (image_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, character_id) AS rank, max(score) OVER (PARTITION BY image_id) AS best FROM sc)
"""


# ------------------------------------------------------------------ inputs


def refs(d: Data):
    scores = F.transform("embedding", lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double") * 3.0)))
    rows = d.embeddings.select(F.col("vec_id").alias("row_index"), "label", scores.alias("embedding"))
    names = d.nation.select(F.col("n_nationkey").alias("label"), F.col("n_name").alias("character_name"))
    return rows.join(names, "label", "left").select(
        "row_index", F.col("label").cast("string").alias("character_id"), "character_name", "embedding"
    )


def region_queries(d: Data):
    region = F.col("query_id") % 3
    weight = F.when(region == 0, F.lit(0.60)).when(region == 1, F.lit(0.95)).otherwise(F.lit(1.10))
    return refs(d).select(F.col("row_index").alias("query_id"), "embedding").select(
        "query_id", F.floor(F.col("query_id") / 3).alias("image_id"), region.alias("region"), weight.alias("weight"), "embedding"
    )


def neighbours(d: Data):
    """Each query vector next to the reference with the next id."""
    q = region_queries(d).select("query_id", "region", "weight", F.col("embedding").alias("qv"))
    r = refs(d).select((F.col("row_index") - 1).alias("query_id"), "row_index", "character_id", F.col("embedding").alias("rv"))
    q = V.with_attribute_features(q, "qv", "q", SPEC)
    r = V.with_attribute_features(r, "rv", "r", SPEC)
    return q.join(r, "query_id").join(E.attribute_profile(refs(d), SPEC), "character_id", "left")


def rounded(df, *names, digits=6):
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if c in names else c for c in df.columns])


def longs(df, *names):
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in names else c for c in df.columns])


# ----------------------------------------------------------------- queries


@query("cosine_similarity", CTES + f"SELECT query_id, row_index, round({_cos('q_v', 'r_v')}, 6) AS similarity FROM neighbours")
def _(d):
    return rounded(neighbours(d).select("query_id", "row_index", V.cosine_similarity(F.col("qv"), F.col("rv")).alias("similarity")), "similarity")


@query("l2_normalize", CTES + f"SELECT row_index, CAST(i AS BIGINT) AS pos, round(v[i] / sqrt({_dot('v', 'v')}), 6) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM refs)")
def _(d):
    unit = refs(d).select("row_index", F.posexplode(V.l2_normalize(F.col("embedding"))).alias("pos", "x"))
    return rounded(unit.select("row_index", (F.col("pos") + 1).cast("bigint").alias("pos"), "x"), "x")


@query("tag_score_at", """SELECT vec_id, greatest(0.0, least(1.0, CAST(embedding[3] AS DOUBLE))) AS third,
 CASE WHEN vec_id % 90 < 64 THEN greatest(0.0, least(1.0, CAST(embedding[CAST(vec_id % 90 + 1 AS INT)] AS DOUBLE))) ELSE 0.0 END AS placed FROM embeddings""")
def _(d):
    v = F.col("embedding")
    return d.embeddings.select("vec_id", V.tag_score_at(v, 2).alias("third"), V.tag_score_at(v, (F.col("vec_id") % 90).cast("int")).alias("placed"))


@query("max_group_score", CTES + "SELECT row_index, round(list_max(v[56:64]), 6) AS score FROM refs")
def _(d):
    return rounded(refs(d).select("row_index", V.max_group_score(F.col("embedding"), SPEC.multi_person).alias("score")), "score")


@query("dominant_tag", CTES + f"""SELECT row_index, CASE WHEN r_hair_best >= 0.55 THEN {_list(HAIR_GROUPS)}[r_hair_place] ELSE '' END AS tag,
 CASE WHEN r_hair_best >= 0.42 THEN r_hair_group ELSE '' END AS hair_group FROM rf""")
def _(d):
    v = F.col("embedding")
    rows = V.with_attribute_features(refs(d), "embedding", "f", SPEC).withColumn("tag", A.dominant_tag(v, AUDIT.hair, 0.55))
    return rows.select("row_index", "tag", V.dominant_group(F.col("f"), "hair").alias("hair_group"))


@query("attribute_profile", CTES + "SELECT character_id, array_to_string(hair_groups, '|') AS hair, array_to_string(eyes_groups, '|') AS eyes FROM profile")
def _(d):
    p = E.attribute_profile(refs(d), SPEC)
    return p.select("character_id", F.array_join("hair_groups", "|").alias("hair"), F.array_join("eye_groups", "|").alias("eyes"))


@query("reference_count", "SELECT CAST(label AS VARCHAR) AS character_id, count(*) AS reference_count FROM embeddings GROUP BY label")
def _(d):
    return reference_count(refs(d))


@query("exclusive_attribute_adjustment", CTES + f"SELECT query_id, round({HAIR_TERM}, 6) + 0.0 AS hair, round({EYE_TERM}, 6) + 0.0 AS eyes FROM neighbours")
def _(d):
    q, r = F.col("q"), F.col("r")
    scene = F.greatest(F.lit(0.35), F.lit(1.0) - q["multi"] * 0.75)
    eye = F.when(q["closed"] >= 0.45, scene * F.greatest(F.lit(0.25), F.lit(1.0) - q["closed"])).otherwise(scene)
    rows = neighbours(d).select(
        "query_id",
        V.exclusive_term(q, r, "hair", V.HAIR_BONUS, scene * V.HAIR_PENALTY).alias("hair"),
        V.exclusive_term(q, r, "eyes", V.EYE_BONUS, eye * V.EYE_PENALTY).alias("eyes"),
    )
    return rounded(rows, "hair", "eyes")


@query("detail_attribute_adjustment", CTES + f"SELECT query_id, round({STYLE_TERM}, 6) + 0.0 AS style, round({FACE_TERM}, 6) + 0.0 AS face FROM neighbours")
def _(d):
    q, r = F.col("q"), F.col("r")
    scene = F.greatest(F.lit(0.35), F.lit(1.0) - q["multi"] * 0.75)
    rows = neighbours(d).select(
        "query_id",
        V.detail_term(q["style"], r["style"], V.STYLE_BONUS, scene * V.STYLE_PENALTY).alias("style"),
        V.detail_term(q["face"], r["face"], V.FACE_BONUS, scene * V.FACE_PENALTY, V.FACE_QUERY, V.FACE_MATCH, V.FACE_MISS).alias("face"),
    )
    return rounded(rows, "style", "face")


@query("attribute_score_adjustment", CTES + f"SELECT query_id, round({ADJUST}, 6) + 0.0 AS adjustment FROM neighbours")
def _(d):
    return rounded(neighbours(d).select("query_id", V.attribute_adjustment(F.col("q"), F.col("r")).alias("adjustment")), "adjustment")


def _factor():
    q = F.col("q")
    return V.correlation_multiplier(
        V.dominant_group(q, "hair"), q["hair_best"], V.dominant_group(q, "eyes"), q["eyes_best"], F.col("hair_groups"), F.col("eye_groups")
    )


@query("correlation_multiplier", CTES + f"SELECT query_id, round({FACTOR}, 6) AS factor FROM neighbours")
def _(d):
    return rounded(neighbours(d).select("query_id", _factor().alias("factor")), "factor")


@query("region_adjust_weight", CTES + f"""SELECT query_id, round(greatest(0, least(1, {_cos('q_v', 'r_v')} + {ADJUST} *
 CASE WHEN weight <= 0.65 THEN 0.40 WHEN weight < 0.90 THEN 0.70 ELSE 1.0 END)) * weight, 6) AS score FROM neighbours""")
def _(d):
    score = V.region_adjust_weight(V.cosine_similarity(F.col("qv"), F.col("rv")), V.attribute_adjustment(F.col("q"), F.col("r")), F.col("weight"))
    return rounded(neighbours(d).select("query_id", score.alias("score")), "score")


@query("profile_join", CTES + "SELECT query_id, row_index, coalesce(array_to_string(hair_groups, '|'), '') AS hair FROM neighbours")
def _(d):
    return neighbours(d).select("query_id", "row_index", F.coalesce(F.array_join("hair_groups", "|"), F.lit("")).alias("hair"))


@query("vector_topk_join", CTES + "SELECT query_id, row_index, round(similarity, 6) AS similarity, rank FROM top WHERE rank <= 5 AND similarity >= 0.4")
def _(d):
    top = vector_topk(region_queries(d).select("query_id", "embedding"), refs(d), 5, min_similarity=0.4).drop("embedding")
    return longs(rounded(top, "similarity"), "rank")


@query("topk_per_query", "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM @events) WHERE rank <= 3")
def _(d):
    rows = longs(K.top_n(d.events.select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.col("event_id")], 3), "rank")
    return rows.select("user_id", "event_id", "rank")


def evidence(d: Data, k: int = TOP_K):
    return E.character_evidence(E.match_scores(region_queries(d), refs(d), SPEC, k), MIN_SCORE)


def scores(d: Data, k: int = TOP_K):
    heads = region_queries(d).groupBy("image_id").agg((F.count(F.lit(1)) - 1).alias("head_regions"))
    return E.evidence_score(evidence(d, k), reference_count(refs(d)), heads, k)


@query("character_evidence", match_ctes(TOP_K) + "SELECT image_id, character_id, round(best_score, 6) AS best_score, round(best_head_score, 6) AS best_head_score, best_head_region, supported_regions, reference_rows FROM ev")
def _(d):
    rows = evidence(d).drop("character_name")
    return longs(rounded(rows, "best_score", "best_head_score"), "best_head_region", "supported_regions", "reference_rows")


@query("evidence_score", match_ctes(TOP_K) + "SELECT image_id, character_id, round(score, 6) AS score FROM sc")
def _(d):
    return rounded(scores(d).select("image_id", "character_id", "score"), "score")


SINGLE_SQL = match_ctes(1) + f"""SELECT image_id, character_id, round(score, 6) AS score FROM (
 SELECT *, lead(score) OVER (PARTITION BY image_id ORDER BY rank) AS second FROM rk) WHERE rank = 1 AND score >= {MIN_SCORE} AND (second IS NULL OR score - second >= {MARGIN})"""


@query("top2_margin", SINGLE_SQL)
def _(d):
    best = E.top2_margin(scores(d, 1), MIN_SCORE, MARGIN)
    return rounded(best.select("image_id", "character_id", "score"), "score")


RATIO = "(SELECT CASE WHEN count(*) >= 2000 THEN 0.76 WHEN count(*) >= 1000 THEN 0.74 ELSE 0.70 END::DOUBLE FROM refs)"


@query("relative_cutoff", match_ctes(TOP_K) + f"SELECT image_id, character_id, round(score, 6) AS score FROM rk WHERE best >= {MIN_SCORE} AND score >= greatest({MIN_SCORE}, best * {RATIO})")
def _(d):
    library = refs(d)
    rows = E.relative_cutoff(scores(d), MIN_SCORE, library.count())
    return rounded(rows.select("image_id", "character_id", "score"), "score")


def resolve_sql(k: int) -> str:
    cut = f"kept AS (SELECT image_id, character_id, score, best_head_region AS reg, best_head_score AS head, best, row_number() OVER (PARTITION BY image_id ORDER BY rank) AS n FROM rk WHERE best >= {MIN_SCORE} AND score >= greatest({MIN_SCORE}, best * {RATIO}))"
    return match_ctes(k).replace("WITH ", "WITH RECURSIVE ", 1) + f""", {cut},
walk AS (
  SELECT image_id, n, [character_id] AS chosen, CASE WHEN reg > 0 THEN [reg] ELSE []::BIGINT[] END AS used FROM kept WHERE n = 1
  UNION ALL
  SELECT w.image_id, k.n, CASE WHEN s THEN w.chosen ELSE list_append(w.chosen, k.character_id) END,
    CASE WHEN NOT s AND k.reg > 0 THEN list_append(w.used, k.reg) ELSE w.used END
  FROM walk w JOIN (SELECT * FROM kept) k ON k.image_id = w.image_id AND k.n = w.n + 1,
  LATERAL (SELECT len(w.chosen) >= {k} OR (k.reg > 0 AND list_contains(w.used, k.reg) AND k.head < k.best * 0.92) AS s)),
done AS (SELECT image_id, arg_max(chosen, n) AS chosen FROM walk GROUP BY image_id)
SELECT image_id, CAST(i AS BIGINT) AS rank, chosen[i] AS character_id FROM (SELECT image_id, chosen, unnest(range(1, len(chosen) + 1)) AS i FROM done)"""


@query("region_exclusive_select", resolve_sql(TOP_K))
def _(d):
    library = refs(d)
    rows = E.region_exclusive_select(E.relative_cutoff(scores(d), MIN_SCORE, library.count()), TOP_K)
    return longs(rows.select("image_id", "rank", "character_id"), "rank")


@query("character_resolve", resolve_sql(TOP_K))
def _(d):
    rows = E.resolve_characters(region_queries(d), refs(d), SPEC, MIN_SCORE, TOP_K)
    return longs(rows.select("image_id", "rank", "character_id"), "rank")


BY_IMAGE_SQL = f"""SELECT image_id, rank, character_id FROM ({resolve_sql(TOP_K)}) WHERE image_id % 3 > 0
 UNION ALL SELECT image_id, CAST(1 AS BIGINT), character_id FROM ({SINGLE_SQL}) WHERE image_id % 3 = 0"""


def resolved_by_image(d: Data):
    queries = region_queries(d)
    # images with one expected subject and images with several
    count = F.when(F.col("image_id") % 3 == 0, 1).otherwise(TOP_K)
    limits = queries.select("image_id").distinct().select("image_id", effective_threshold(MIN_SCORE, count, MIN_SCORE).alias("minimum"), effective_top_k(1, count, count).alias("top_k"))
    return E.resolve_by_image(queries, refs(d), SPEC, limits, MARGIN)


@query("character_resolve_by_image", BY_IMAGE_SQL)
def _(d):
    return longs(resolved_by_image(d).select("image_id", "rank", "character_id"), "rank")


# ------------------------------------------------------- reference quality

CENTROIDS = """cen AS (SELECT character_id, i, avg(v[i]) AS x FROM (SELECT character_id, v, unnest(range(1, 65)) AS i FROM refs) GROUP BY 1, 2),
cent AS (SELECT character_id, list(x ORDER BY i) AS c FROM cen GROUP BY 1), sizes AS (SELECT character_id, count(*) AS n FROM refs GROUP BY 1)"""


@query("vector_centroid", CTES + CENTROIDS + " SELECT character_id, CAST(i AS BIGINT) AS pos, round(x, 6) AS x, n FROM cen JOIN sizes USING (character_id)")
def _(d):
    c = R.vector_centroid(refs(d), "character_id")
    rows = c.select("character_id", "n", F.posexplode("centroid").alias("pos", "x"))
    return rounded(rows.select("character_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "x", "n"), "x")


@query("vector_outliers", CTES + CENTROIDS + f""" SELECT row_index, character_id, round({_cos('v', 'c')}, 6) AS centroid_similarity
 FROM refs JOIN cent USING (character_id) JOIN sizes USING (character_id) WHERE n > 1 AND {_cos('v', 'c')} < 0.58""")
def _(d):
    rows = R.vector_outliers(refs(d), "character_id", 0.58)
    return rounded(rows.select("row_index", "character_id", "centroid_similarity"), "centroid_similarity")


PAIRS = f"""pairs AS (SELECT a.character_id, count(*) AS n, sum({_cos('a.v', 'b.v')}) AS s FROM refs a JOIN refs b
 ON a.character_id = b.character_id AND a.row_index < b.row_index GROUP BY 1), sizes AS (SELECT character_id, count(*) AS members FROM refs GROUP BY 1)"""


@query("mean_pairwise_similarity", CTES + PAIRS + " SELECT character_id, round(coalesce(s / n, 1), 6) AS mean_similarity FROM sizes LEFT JOIN pairs USING (character_id)")
def _(d):
    rows = R.pair_statistics(refs(d), "character_id")
    return rounded(rows.select("character_id", "mean_similarity"), "mean_similarity")


@query("group_pair_join", CTES + PAIRS + " SELECT character_id, members, coalesce(n, 0) AS pairs, round(coalesce(s, 0), 4) AS pair_similarity_sum FROM sizes LEFT JOIN pairs USING (character_id)")
def _(d):
    rows = R.pair_statistics(refs(d), "character_id").drop("mean_similarity")
    return rounded(rows, "pair_similarity_sum", digits=4)


@query("attribute_conflict", """SELECT user_id, string_agg(event_type, '|' ORDER BY event_type) AS labels FROM (
 SELECT user_id, event_type, count(*) AS c, sum(count(*)) OVER (PARTITION BY user_id) AS n, max(count(*)) OVER (PARTITION BY user_id) AS top FROM @events GROUP BY 1, 2)
 GROUP BY user_id HAVING count(*) > 1 AND NOT (max(n) >= 3 AND max(top) / max(n) >= 0.75)""")
def _(d):
    rows = R.attribute_conflict(d.events.select("user_id", "event_type"), "user_id", "event_type")
    return rows.select("user_id", F.array_join("labels", "|").alias("labels"))


AUDIT_SQL = CTES + CENTROIDS + f""", {PAIRS.split(', sizes AS')[0]},
sig AS (SELECT r.row_index, r.character_id, list_max(v[25:27]) AS single_subject, list_max(v[56:64]) AS multi_person, list_max(v[28:30]) AS screenshot_noise, v[31] AS no_humans,
  CASE WHEN r_hair_best >= 0.55 THEN {_list(HAIR_GROUPS)}[r_hair_place] ELSE '' END AS dominant_hair, CASE WHEN r_eyes_best >= 0.55 THEN {_list(EYE_GROUPS)}[r_eyes_place] ELSE '' END AS dominant_eyes,
  s.n > 1 AND {_cos('v', 'c')} < 0.45 AS outlier FROM refs r JOIN rf ON rf.row_index = r.row_index JOIN cent ON cent.character_id = r.character_id JOIN sizes s ON s.character_id = r.character_id),
items AS (SELECT *, list_filter([CASE WHEN single_subject < 0.55 THEN 'low_subject_focus' END, CASE WHEN multi_person >= 0.45 THEN 'multi_person_content' END,
  CASE WHEN screenshot_noise >= 0.45 THEN 'screenshot_noise' END, CASE WHEN no_humans >= 0.55 THEN 'no_humans' END, CASE WHEN outlier THEN 'vector_outlier' END], lambda x: x IS NOT NULL) AS issues FROM sig),
hair AS (SELECT character_id FROM (SELECT character_id, dominant_hair, count(*) AS c FROM sig WHERE dominant_hair <> '' GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 1 AND NOT (sum(c) >= 3 AND max(c) / sum(c) >= 0.75)),
eye AS (SELECT character_id FROM (SELECT character_id, dominant_eyes, count(*) AS c FROM sig WHERE dominant_eyes <> '' GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 1 AND NOT (sum(c) >= 3 AND max(c) / sum(c) >= 0.75)),
ent AS (SELECT i.character_id, count(*) AS reference_count, count(*) FILTER (len(issues) > 0) AS issue_references, count(*) FILTER (multi_person >= 0.45) AS mp,
  count(*) FILTER (screenshot_noise >= 0.45) AS sn, count(*) FILTER (single_subject < 0.55) AS ls, count(*) FILTER (outlier) AS ol FROM items i GROUP BY 1),
rep AS (SELECT e.*, coalesce(n_name, e.character_id) AS display_name, coalesce(p.s / p.n, 1) AS ms, list_filter([CASE WHEN reference_count <= 1 THEN 'single_reference' END,
  CASE WHEN e.character_id IN (SELECT character_id FROM hair) THEN 'hair_color_conflict' END, CASE WHEN e.character_id IN (SELECT character_id FROM eye) THEN 'eye_color_conflict' END,
  CASE WHEN ol > 0 THEN 'outlier_reference' END, CASE WHEN coalesce(p.s / p.n, 1) < 0.32 THEN 'low_internal_consistency' END], lambda x: x IS NOT NULL) AS issues
  FROM ent e LEFT JOIN pairs p USING (character_id) LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = e.character_id AND n_regionkey < 4)
"""
AUDIT_RUN = A.AuditSpec(**{**AUDIT.__dict__, "low_consistency": 0.32})


def display_names(d: Data):
    rows = d.nation.filter(F.col("n_regionkey") < 4)
    return rows.select(F.col("n_nationkey").cast("string").alias("character_id"), F.col("n_name").alias("display_name"))


def audit_entities(d: Data):
    return A.audit_entities(refs(d), display_names(d), AUDIT_RUN)


def _joined(field: str):
    return F.array_join(F.transform("issues", lambda x: x[field]), "|")


@query("library_audit", AUDIT_SQL + """SELECT character_id, display_name, reference_count, issue_references, round(ms, 6) AS mean_similarity, array_to_string(issues, '|') AS issues,
 array_to_string(list_filter([CASE WHEN reference_count <= 1 THEN 'Only one reference image in library.' END, 'Conflicting dominant hair tags: ' || (SELECT string_agg(DISTINCT dominant_hair, ', ' ORDER BY dominant_hair) FROM sig s WHERE s.character_id = rep.character_id AND dominant_hair <> '' AND list_contains(issues, 'hair_color_conflict')),
  'Conflicting dominant eye tags: ' || (SELECT string_agg(DISTINCT dominant_eyes, ', ' ORDER BY dominant_eyes) FROM sig s WHERE s.character_id = rep.character_id AND dominant_eyes <> '' AND list_contains(issues, 'eye_color_conflict')),
  CASE WHEN ol > 0 THEN 'Outlier references: ' || ol END, CASE WHEN ms < 0.32 THEN printf('Mean pairwise similarity=%.3f < 0.320', ms) END], lambda x: x IS NOT NULL), '|') AS details FROM rep""")
def _(d):
    rows = audit_entities(d).select(
        "character_id", "display_name", "reference_count", "issue_references", "mean_similarity", _joined("type").alias("issues"), _joined("detail").alias("details")
    )
    return rounded(rows, "mean_similarity")


@query("library_audit_references", AUDIT_SQL + """SELECT row_index, character_id, round(single_subject, 4) AS single_subject, round(multi_person, 4) AS multi_person,
 round(screenshot_noise, 4) AS screenshot_noise, round(no_humans, 4) AS no_humans, dominant_hair, dominant_eyes, 'refs/' || row_index AS image_path, array_to_string(issues, '|') AS issues,
 array_to_string(list_filter([CASE WHEN single_subject < 0.55 THEN printf('single-subject score=%.3f < 0.550', single_subject) END, CASE WHEN multi_person >= 0.45 THEN printf('multi-person score=%.3f >= 0.450', multi_person) END,
  CASE WHEN screenshot_noise >= 0.45 THEN printf('screenshot-noise score=%.3f >= 0.450', screenshot_noise) END, CASE WHEN no_humans >= 0.55 THEN printf('no_humans score=%.3f >= 0.550', no_humans) END,
  CASE WHEN outlier THEN 'Low similarity to character centroid.' END], lambda x: x IS NOT NULL), '|') AS details FROM items""")
def _(d):
    with_path = refs(d).withColumn("image_path", F.concat(F.lit("refs/"), "row_index"))
    rows = A.audit_references(with_path, AUDIT_RUN).drop("embedding").withColumns({"issues": _joined("type"), "details": _joined("detail")})
    return rounded(rows, "single_subject", "multi_person", "screenshot_noise", "no_humans", digits=4)


@query("audit_sort", AUDIT_SQL + "SELECT character_id, CAST(len(issues) AS BIGINT) AS issue_count, issue_references, display_name FROM rep ORDER BY 2 DESC, 3 DESC, 4")
def _(d):
    rows = A.audit_order(audit_entities(d))
    return rows.select("character_id", F.size("issues").cast("bigint").alias("issue_count"), "issue_references", "display_name")


def _has(name: str) -> str:
    return f"count(*) FILTER (list_contains(issues, '{name}'))"


@query("library_audit_summary", AUDIT_SQL + f"""SELECT count(*) AS character_count, CAST(sum(reference_count) AS BIGINT) AS reference_row_count, {_has('single_reference')} AS single_reference_characters,
 CAST(sum(mp) AS BIGINT) AS multi_person_references, CAST(sum(sn) AS BIGINT) AS screenshot_noise_references, CAST(sum(ls) AS BIGINT) AS low_subject_references,
 {_has('hair_color_conflict')} AS feature_conflict_characters, {_has('outlier_reference')} AS outlier_reference_characters, {_has('low_internal_consistency')} AS low_consistency_characters,
 count(*) FILTER (len(issues) > 0 OR issue_references > 0) AS characters_with_any_issue FROM rep""")
def _(d):
    return A.audit_summary(audit_entities(d))


@query("reference_record_join", CTES + "SELECT row_index, r.character_id, coalesce(n_name, r.character_id) AS display_name FROM refs r LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = r.character_id AND n_regionkey < 4")
def _(d):
    rows = refs(d).select("row_index", "character_id").join(display_names(d), "character_id", "left")
    return rows.select("row_index", "character_id", F.coalesce("display_name", "character_id").alias("display_name"))


# --------------------------------------------------------- identity filter
# avatar = first vector of an entity (entity 7 has none, that of 8 is unreadable),
# references = every row of entities below 9, candidates = every row; a vector
# whose first component is large is unreadable, the next ones give the size.

def _loop_cos(a: str, b: str) -> str:
    def dot(x: str, y: str) -> str:
        return f"list_sum(list_transform(range(1, 65), lambda i: {x}[i] * {y}[i]))"

    return f"({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})))"


IDENTITY = """ids AS (SELECT row_index AS pos, character_id AS entity_id, CASE WHEN v[1] > 0.75 THEN NULL ELSE v END AS v,
  CAST(floor(100 + 400 * v[2]) AS BIGINT) AS width, CAST(floor(60 + 400 * v[3]) AS BIGINT) AS height FROM refs),
av AS (SELECT entity_id, arg_min(pos, pos) AS pos FROM ids WHERE entity_id <> '7' AND entity_id <> '9' GROUP BY 1),
avatars AS (SELECT i.entity_id, i.pos, CASE WHEN i.entity_id = '8' THEN NULL ELSE i.v END AS v FROM ids i JOIN av USING (entity_id, pos)),
seed_all AS (SELECT entity_id, pos AS path, -1 AS pos, v FROM avatars UNION ALL SELECT entity_id, pos, pos, v FROM ids WHERE entity_id NOT IN ('9', '6')),
seed_one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, path ORDER BY pos) AS rn FROM seed_all) WHERE rn = 1),
seeds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY pos) AS seed FROM seed_one) WHERE seed <= 8),
av_vec AS (SELECT entity_id, v AS av FROM seeds WHERE pos = -1),
clean AS (SELECT s.* FROM seeds s LEFT JOIN av_vec USING (entity_id) WHERE s.v IS NOT NULL AND (av IS NULL OR s.pos = -1 OR COS_SV_AV >= 0.50)),
cen1 AS (SELECT entity_id, i, avg(v[i] / sqrt(list_dot_product(v, v))) AS x FROM (SELECT entity_id, v, unnest(range(1, 65)) AS i FROM clean) GROUP BY 1, 2),
cen2 AS (SELECT entity_id, list(x ORDER BY i) AS c FROM cen1 GROUP BY 1),
st AS (SELECT e.entity_id, e.n AS candidate_count, coalesce(s.n, 0) AS seeds, coalesce(s.nv, 0) AS seed_vectors, coalesce(cl.n, 0) AS seed_count, a.entity_id IS NOT NULL AS has_avatar, av_vec.av, c
  FROM (SELECT entity_id, count(*) AS n FROM ids GROUP BY 1) e LEFT JOIN (SELECT entity_id, count(*) AS n, count(v) AS nv FROM seeds GROUP BY 1) s USING (entity_id)
  LEFT JOIN (SELECT entity_id, count(*) AS n FROM clean GROUP BY 1) cl USING (entity_id) LEFT JOIN (SELECT DISTINCT entity_id FROM avatars) a USING (entity_id)
  LEFT JOIN av_vec USING (entity_id) LEFT JOIN cen2 USING (entity_id)),
scored AS (SELECT i.entity_id, i.pos, (st.seeds = 0 OR (st.seed_vectors = 0 AND NOT has_avatar)) AS pass, av,
  CASE WHEN least(width, height) >= 96 AND v IS NOT NULL AND c IS NOT NULL THEN COS_V_C END AS cs,
  CASE WHEN least(width, height) >= 96 AND v IS NOT NULL AND c IS NOT NULL THEN CASE WHEN av IS NULL THEN COS_V_C ELSE COS_V_AV END END AS a_s
  FROM ids i JOIN st USING (entity_id)),
ww AS (SELECT *, 0.65 * cs + 0.35 * a_s AS w, max(a_s) OVER (PARTITION BY entity_id) AS ba FROM scored),
kept0 AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY round(coalesce(w, 0), 12) DESC, pos) AS rank FROM ww WHERE pass OR (cs >= CMIN AND (av IS NULL OR a_s >= greatest(0.52, ba - 0.10)))),
kept AS (SELECT * FROM kept0 WHERE rank <= LIMIT_N)""".replace("COS_SV_AV", _loop_cos("s.v", "av")).replace("COS_V_C", _loop_cos("v", "c")).replace("COS_V_AV", _loop_cos("v", "av")).replace("CMIN", "0.45").replace("LIMIT_N", "12")


def identity_inputs(d: Data):
    v = F.col("embedding")
    at = lambda i, low: F.floor(F.get(v, F.lit(i)) * 400 + low)
    rows = refs(d).select(
        F.col("character_id").alias("entity_id"), F.col("row_index").alias("pos"), F.col("row_index").cast("string").alias("path"),
        at(1, 100).alias("width"), at(2, 60).alias("height"), F.when(F.get(v, F.lit(0)) <= 0.75, v).alias("vector"),
    )
    first = rows.filter(~F.col("entity_id").isin("7", "9")).groupBy("entity_id").agg(F.min("pos").alias("pos"))
    avatars = rows.join(first, ["entity_id", "pos"]).withColumn("vector", F.when(F.col("entity_id") != "8", F.col("vector")))
    references = rows.filter(~F.col("entity_id").isin("6", "9"))
    return rows, avatars, references


@query("identity_filter", CTES + IDENTITY + """ SELECT st.entity_id, CASE WHEN seeds = 0 THEN 'passthrough_no_seed' WHEN seed_vectors = 0 AND has_avatar THEN 'reject_no_seed_vector'
 WHEN seed_vectors = 0 THEN 'passthrough_no_seed_vector' WHEN seed_count = 0 THEN 'reject_no_clean_seed_vector' WHEN c IS NULL THEN 'reject_invalid_seed_center'
 WHEN coalesce(sn, 0) = 0 THEN 'reject_no_candidate_vector' WHEN kn > 0 THEN 'filtered' ELSE 'reject_low_confidence' END AS mode,
 candidate_count, coalesce(sn, 0) AS scored_count, coalesce(kn, 0) AS kept_count, seed_count, round(CASE WHEN av IS NOT NULL THEN greatest(0.52, ba - 0.10) ELSE 0 END, 6) AS avatar_dynamic_floor,
 round(coalesce(bw, 0), 6) AS best_similarity, round(coalesce(wk, 0), 6) AS worst_kept_similarity
 FROM st LEFT JOIN (SELECT entity_id, count(w) AS sn, max(w) AS bw, max(ba) AS ba FROM ww GROUP BY 1) USING (entity_id) LEFT JOIN (SELECT entity_id, count(*) AS kn, min(w) AS wk FROM kept GROUP BY 1) USING (entity_id)
 UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'empty', 0, 0, 0, 0, 0, 0, 0 FROM nation WHERE CAST(n_nationkey AS VARCHAR) NOT IN (SELECT entity_id FROM st)""")
def _(d):
    rows, avatars, references = identity_inputs(d)
    every = d.nation.select(F.col("n_nationkey").cast("string").alias("entity_id"))
    _, report = R.identity_filter(rows, avatars, references, 12, every)
    return rounded(report, "avatar_dynamic_floor", "best_similarity", "worst_kept_similarity")


@query("dynamic_floor_filter", CTES + IDENTITY + " SELECT entity_id, pos, rank, round(w, 6) AS weighted FROM kept")
def _(d):
    rows, avatars, references = identity_inputs(d)
    kept, _ = R.identity_filter(rows, avatars, references, 12)
    return longs(rounded(kept.select("entity_id", "pos", "rank", "weighted"), "weighted"), "rank")


@query("seed_selection", CTES + IDENTITY + " SELECT entity_id, path, pos, seed FROM clean")
def _(d):
    _, avatars, references = identity_inputs(d)
    rows = R.clean_seeds(R.seed_rows(avatars, references))
    return rows.select("entity_id", F.col("path").cast("bigint").alias("path"), "pos", F.col("seed").cast("bigint").alias("seed"))


PRUNE = IDENTITY.replace("WHERE entity_id NOT IN ('9', '6')", "WHERE FALSE").replace("LIMIT_N", "99999999").replace("rank <= 12", "TRUE").replace(
    "FROM (SELECT entity_id, count(*) AS n FROM ids GROUP BY 1) e", "FROM (SELECT entity_id, count(*) AS n FROM ids GROUP BY 1 HAVING count(*) > 1) e"
)


@query("reference_prune", CTES + PRUNE + " SELECT entity_id, pos FROM kept UNION ALL SELECT entity_id, min(pos) FROM ids GROUP BY 1 HAVING count(*) = 1")
def _(d):
    rows, avatars, _ = identity_inputs(d)
    return R.reference_prune(rows, avatars).select("entity_id", "pos")


@query("min_size_filter", CTES + "SELECT row_index FROM refs WHERE least(CAST(floor(100 + 400 * v[2]) AS BIGINT), CAST(floor(60 + 400 * v[3]) AS BIGINT)) >= 96")
def _(d):
    rows, _, _ = identity_inputs(d)
    return rows.filter(R.min_size(F.col("width"), F.col("height"))).select(F.col("pos").alias("row_index"))


@query("remaining_quota", "SELECT c_nationkey, c_mktsegment, CAST(greatest(0, 30 - count(*)) AS BIGINT) AS quota FROM @customer GROUP BY 1, 2")
def _(d):
    rows = d.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("c_nationkey", "c_mktsegment", R.remaining_quota(40, F.col("n")).alias("quota"))
