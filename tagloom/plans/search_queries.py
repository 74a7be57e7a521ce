"""Queries over search: filters, flags, merges, pages, quotas, the queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import localize as L
from tagloom.functions import text as X
from tagloom.operators import queue as Q
from tagloom.operators import search as S
from tagloom.operators.naming import conflict_free_names
from tagloom.plans.entity_queries import CANDIDATES, _overlap, candidates, longs
from tagloom.plans.fixtures import RULES, rule
from tagloom.plans.registry import Data, query, values
from tagloom.plans.text_queries import SEARCH_TEXT, key, uniq

NOW = "2024-01-01T00:00:00"
# one request per brand, asking for a word of one of its names
REQUESTS = """SELECT p_brand AS request_id, CASE WHEN count(*) % 3 = 0 THEN concat(split_part(min(p_name), ' ', 2), '!') WHEN count(*) % 3 = 1 THEN 'Genshin' ELSE concat('Saga ', p_brand) END AS query FROM @part GROUP BY p_brand"""
BASE = f"WITH candidates AS ({CANDIDATES}), requests AS ({REQUESTS})"


def near(a: str, b: str) -> str:
    return f"({_overlap(a, b)} >= 2)"


@query("library_search", f"SELECT doc_id FROM @documents WHERE contains(concat_ws(' ', {SEARCH_TEXT.format('source')}, {SEARCH_TEXT.format('text')}), 'theou') AND contains(concat_ws(' ', {SEARCH_TEXT.format('source')}, {SEARCH_TEXT.format('text')}), 'src1')")
def _(d):
    return documents_found(d).filter("hit").select("doc_id")


def documents_found(d: Data):
    hay = S.library_haystack(F.col("source"), F.col("text"), F.array().cast("array<string>"), F.array().cast("array<string>"))
    return d.documents.select("doc_id", S.matches_terms(hay, "The-Ou  SRC1").alias("hit"))


@query("library_search_counts", f"SELECT count(*) AS total, count(*) FILTER (WHERE contains(concat_ws(' ', {SEARCH_TEXT.format('source')}, {SEARCH_TEXT.format('text')}), 'theou') AND contains(concat_ws(' ', {SEARCH_TEXT.format('source')}, {SEARCH_TEXT.format('text')}), 'src1')) AS matched FROM @documents")
def _(d):
    return documents_found(d).agg(F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("matched"))


@query("grouped_item_search", "SELECT source, doc_id FROM @documents WHERE contains(source, 'src1') OR contains(lower(text), 'src1') OR contains(lower(lang), 'src1')")
def _(d):
    return S.grouped_item_search(d.documents, "source", F.concat_ws(" ", "text", "lang"), " SRC1 ").select("source", "doc_id")


MATCH = f"""(CASE WHEN {key('query')} = '' THEN FALSE WHEN len({key('query')}) = 1 THEN contains(lower(display_name), lower(query)) OR contains(lower(source_title), lower(query))
 ELSE {near(key('query'), key('display_name'))} OR {near(key('query'), key('source_title'))} END)"""


@query("candidate_query_filter", BASE + f" SELECT request_id, candidate_id FROM candidates JOIN requests USING (request_id) WHERE {MATCH}")
def _(d):
    return S.candidate_query_filter(candidates(d), d.sql(REQUESTS)).select("request_id", "candidate_id")


@query("request_hit_flags", BASE + f""" SELECT request_id, bool_or({near(key('query'), key('display_name'))}) AS name_hit, bool_or({near(key('query'), key('display_name'))}) AS display_hit,
 bool_or({near(key('query'), key('source_title'))}) AS source_hit, count(*) AS n FROM candidates JOIN requests USING (request_id) GROUP BY request_id""")
def _(d):
    return S.request_hit_flags(candidates(d), d.sql(REQUESTS))


@query("source_strict_filter", f"""WITH h AS (SELECT source AS request_id, doc_id, {key('text')} AS t FROM @documents), f AS (SELECT *, contains(t, 'the') AS nm, contains(t, 'theou') AND contains(t, 'the') AS st FROM h),
a AS (SELECT request_id, bool_or(st) AS s FROM f WHERE nm GROUP BY 1) SELECT request_id, doc_id FROM f JOIN a USING (request_id) WHERE nm AND (st OR NOT s)""")
def _(d):
    hits = d.documents.select(F.col("source").alias("request_id"), "doc_id", "text")
    keys = F.array(F.lit("the")), F.array(F.lit("theou"))
    return S.source_strict_filter(hits, F.col("text"), *keys, within=False).select("request_id", "doc_id")


@query("work_membership_filter", f"SELECT p_partkey FROM @part WHERE {near(key('p_type'), key('p_brand'))} OR contains('smallred', split_part(p_name, ' ', 1)) OR contains(split_part(p_name, ' ', 1), 'smallred')")
def _(d):
    works = F.array(F.substring_index("p_name", " ", 1), F.lit(""), F.lit(None))
    return d.part.filter(S.in_work(F.lit("Small Red"), works)).select("p_partkey")


@query("drop_tagged", "SELECT doc_id FROM @documents WHERE doc_id NOT IN (SELECT doc_id FROM @labels)")
def _(d):
    return Q.drop_tagged(d.documents.select("doc_id"), d.labels, "doc_id")


@query("queue_selection_join", "SELECT '/u/' || user_id AS path_key, arg_max(event_type, event_id) AS event_type, max(event_id) AS line_no FROM @events WHERE user_id IN (SELECT c_custkey FROM @customer) GROUP BY user_id")
def _(d):
    queue = d.events.select(F.concat(F.lit("/U/"), "user_id").alias("path"), F.col("event_id").alias("line_no"), "event_type")
    chosen = d.customer.select(F.concat(F.lit("\\u\\"), "c_custkey").alias("path"))
    return Q.queue_selection(queue, chosen).select("path_key", "event_type", "line_no")


# ------------------------------------------------------------------- merging

NS = f"CASE WHEN {key('source_title')} <> '' THEN {key('display_name')} || ':' || {key('source_title')} ELSE {key('display_name')} END"
GREEDY = """SELECT request_id, n, CASE WHEN ok THEN [lk] ELSE []::VARCHAR[] END AS a, CASE WHEN ok THEN [ns] ELSE []::VARCHAR[] END AS b, CASE WHEN ok THEN [tag] ELSE []::VARCHAR[] END AS kept FROM (SELECT *, TRUE AS ok FROM seq WHERE n = 1)
UNION ALL SELECT w.request_id, s.n, CASE WHEN ok THEN list_append(a, lk) ELSE a END, CASE WHEN ok THEN list_append(b, ns) ELSE b END, CASE WHEN ok THEN list_append(kept, tag) ELSE kept END
FROM walk w JOIN seq s ON s.request_id = w.request_id AND s.n = w.n + 1, LATERAL (SELECT NOT ((lk IS NOT NULL AND list_contains(a, lk)) OR list_contains(b, ns)) AS ok)"""
MERGE_CTES = f"""WITH RECURSIVE candidates AS ({CANDIDATES}), requests AS ({REQUESTS}),
items AS (SELECT request_id, CASE WHEN provider = 'bangumi' THEN 1 ELSE 0 END AS layer, ordinal, candidate_id || '' AS tag, lower(provider || ':' || provider_entity_id) AS lk, {NS} AS ns FROM candidates),
seq AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY layer, ordinal) AS n FROM items), walk AS ({GREEDY}),
done AS (SELECT request_id, arg_max(kept, n) AS kept FROM walk GROUP BY 1)"""


@query("priority_merge", MERGE_CTES + " SELECT request_id, CAST(kept[i] AS BIGINT) AS candidate_id, CAST(i AS BIGINT) AS pos FROM (SELECT request_id, kept, unnest(range(1, least(len(kept), 20) + 1)) AS i FROM done)")
def _(d):
    c = candidates(d)
    first, second = c.filter(F.col("provider") != "bangumi"), c.filter(F.col("provider") == "bangumi")
    return longs(S.priority_merge(first, second, 20).select("request_id", "candidate_id", "pos"), "pos")


@query("union_all_sources", BASE + """ SELECT request_id, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY request_id, lower(provider || ':' || provider_entity_id || ':' || display_name || ':' || source_title)
  ORDER BY CASE provider WHEN 'Anilist' THEN 0 WHEN 'bangumi' THEN 1 ELSE 2 END, ordinal) AS rn FROM candidates) WHERE rn = 1""")
def _(d):
    c = candidates(d)
    parts = [c.filter(F.col("provider") == p) for p in ("Anilist", "bangumi", "jikan")]
    return S.union_all_sources(*parts).select("request_id", "candidate_id")


def _roles(rows):
    """Split candidates into the five source lists by provider and size."""
    p, small = F.col("provider"), F.col("p_size") <= 25
    return (
        rows.filter((p == "Anilist") & small), rows.filter((p == "Anilist") & ~small),
        rows.filter((p == "bangumi") & small), rows.filter((p == "bangumi") & ~small), rows.filter(p == "jikan"),
    )


LINK_OR_NULL = "lower(provider || ':' || provider_entity_id)"
CHOICE = f"""WITH RECURSIVE candidates AS (SELECT request_id || '-' || p_size AS rid, * FROM ({CANDIDATES})), requests AS (SELECT DISTINCT rid, query FROM candidates JOIN ({REQUESTS}) q ON q.request_id = candidates.request_id),
c AS (SELECT c.*, query, CASE WHEN provider = 'jikan' THEN 'fb' WHEN provider = 'Anilist' THEN CASE WHEN p_size <= 25 THEN 'na' ELSE 'sa' END ELSE CASE WHEN p_size <= 25 THEN 'nb' ELSE 'sb' END END AS role,
  {near(key('query'), key('display_name'))} AS dh, {near(key('query'), key('source_title'))} AS sh FROM candidates c JOIN requests USING (rid)),
f AS (SELECT rid, {', '.join(f"count(*) FILTER (role = '{r}') > 0 AS {r}, coalesce(bool_or(dh) FILTER (role = '{r}'), FALSE) AS {r}d, coalesce(bool_or(sh) FILTER (role = '{r}'), FALSE) AS {r}s" for r in ('na', 'sa', 'nb', 'sb', 'fb'))} FROM c GROUP BY rid),
g AS (SELECT *, sa AND (sas OR NOT nad) AS ps FROM f),
h AS (SELECT *, CASE WHEN ps THEN sa ELSE na END AS aa, CASE WHEN ps THEN sad OR sas ELSE nad OR nas END AS ah, nb OR sb AS ba FROM g),
i AS (SELECT *, ba AND ((nbd AND NOT nad) OR (ps AND NOT nad AND NOT nbd)) AS bf, aa AND (ah OR ps) AS us FROM h),
plan AS (SELECT *, CASE WHEN ba AND us AND NOT bf THEN 'a+b' WHEN ba THEN CASE WHEN aa THEN 'b+a' ELSE 'b' END WHEN us THEN CASE WHEN ps THEN 'a-source' ELSE 'a' END WHEN fb THEN 'fallback' ELSE 'none' END AS choice FROM i),
items AS (SELECT c.rid AS request_id, choice, candidate_id, ordinal, candidate_id || '' AS tag, CASE WHEN choice IN ('a+b', 'b+a', 'b') THEN {LINK_OR_NULL} END AS lk,
   CASE WHEN choice IN ('a+b', 'b+a', 'b') THEN {NS} ELSE '#' || candidate_id END AS ns,
   CASE role WHEN 'nb' THEN CASE WHEN nbd THEN 0 ELSE 1 END WHEN 'sb' THEN CASE WHEN nbd THEN 1 ELSE 0 END ELSE 0 END + CASE WHEN role IN ('na', 'sa') THEN CASE WHEN choice = 'a+b' THEN 1 ELSE 4 END WHEN role = 'fb' THEN 1 ELSE 2 END AS layer
  FROM c JOIN plan USING (rid) WHERE (role = 'na' AND NOT ps AND choice IN ('a+b', 'b+a', 'a', 'a-source')) OR (role = 'sa' AND ps AND choice IN ('a+b', 'b+a', 'a', 'a-source')) OR (role IN ('nb', 'sb') AND choice IN ('a+b', 'b+a', 'b')) OR (role = 'fb' AND choice = 'fallback')),
seq AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY layer, ordinal) AS n FROM items), walk AS ({GREEDY}),
done AS (SELECT request_id, arg_max(kept, n) AS kept FROM walk GROUP BY 1)
SELECT d.request_id, choice, CAST(kept[k] AS BIGINT) AS candidate_id, CAST(k AS BIGINT) AS pos FROM (SELECT request_id, kept, unnest(range(1, least(len(kept), 12) + 1)) AS k FROM done) d JOIN plan ON plan.rid = d.request_id"""


@query("provider_choice", CHOICE)
def _(d):
    c = candidates(d)
    asked = c.join(d.sql(REQUESTS), "request_id").withColumn("request_id", F.concat_ws("-", "request_id", "p_size"))
    requests = asked.select("request_id", "query").distinct()
    out = S.provider_choice(requests, *_roles(asked.drop("query")), limit=12)
    return longs(out.select("request_id", "choice", "candidate_id", "pos"), "pos")


@query("source_title_enrich", BASE + """, r AS (SELECT 'x' || s_suppkey AS e, s_name AS title FROM supplier), t AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ordinal) AS n FROM candidates WHERE lower(provider) = 'bangumi' AND source_title = '')
SELECT c.candidate_id, CASE WHEN t.n <= 3 THEN coalesce(r.title, c.source_title) ELSE c.source_title END AS source_title FROM candidates c LEFT JOIN t USING (candidate_id) LEFT JOIN r ON r.e = c.provider_entity_id""")
def _(d):
    related = d.supplier.select(F.concat(F.lit("x"), "s_suppkey").alias("provider_entity_id"), F.lit(1).alias("pos"), F.col("s_name").alias("title"))
    blank = related.withColumns({"pos": F.lit(0), "title": F.lit(" ")})
    return S.source_title_enrich(candidates(d), related.unionByName(blank), "bangumi", 3).select("candidate_id", "source_title")


@query("unseen_first_page", """WITH p AS (SELECT user_id, event_id, event_id IN (SELECT event_id FROM @events WHERE event_type IN ('view', 'click', 'signup')) AS seen FROM @events)
SELECT user_id AS session, event_id AS key, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen, event_id) AS rank FROM p) WHERE rank <= 30""")
def _(d):
    pool = d.events.select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), F.col("event_id").alias("key"))
    seen = d.events.filter(F.col("event_type").isin("view", "click", "signup")).select(F.col("user_id").alias("session"), F.col("event_id").alias("key"))
    return longs(S.unseen_first_page(pool, seen, 30).select("session", "key", "rank"), "rank")


@query("tiered_quota_fill", r"""WITH h AS (SELECT regexp_extract(url, '([a-z]+)(/|$)', 1) AS request_id, CASE WHEN starts_with(url, 'https') THEN 0 ELSE 1 END AS tier, page_id AS pos, regexp_extract(url, '^[a-z]+://([^?#]*/)', 1) AS url FROM @pages),
f AS (SELECT request_id, url, min((tier, pos)) AS o FROM h WHERE url <> '' GROUP BY 1, 2) SELECT request_id, url, rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY o) AS rank FROM f) WHERE rank <= 25""")
def _(d):
    u = F.col("url")
    hits = d.pages.select(
        F.regexp_extract(u, "([a-z]+)(/|$)", 1).alias("request_id"), F.when(u.startswith("https"), 0).otherwise(1).alias("tier"),
        F.col("page_id").alias("pos"), F.regexp_extract(u, "^[a-z]+://([^?#]*/)", 1).alias("url"),
    )
    return longs(S.tiered_quota_fill(hits, 25).select("request_id", "url", "rank"), "rank")


@query("popular_topn", """WITH e AS (SELECT *, max(event_id) OVER () AS most FROM @events), p AS (SELECT CAST(floor(event_id / 50.0) AS BIGINT) AS page, event_id AS pos, user_id || ':' || event_type AS key FROM e WHERE event_id <> floor(most * 0.8)),
l AS (SELECT min(page) AS last FROM (SELECT page FROM p GROUP BY page HAVING count(*) < 50))
SELECT key, min(pos) AS pos FROM p, l WHERE page <= coalesce(last, page) GROUP BY key ORDER BY 2 LIMIT 400""")
def _(d):
    most = d.events.agg(F.max("event_id")).first()[0]
    e = d.events.filter(F.col("event_id") != int(most * 0.8))  # one page after four fifths of the table is short
    pages = e.select(F.floor(F.col("event_id") / 50).alias("page"), F.col("event_id").alias("pos"), F.concat_ws(":", "user_id", "event_type").alias("key"))
    return S.popular_topn(pages, 50, 400, second=pages).select("key", "pos")


NAME_REQUESTS = "SELECT doc_id, concat(source, '/', CASE doc_id % 6 WHEN 3 THEN 'a_1.jpg' WHEN 4 THEN 'b.jpg' WHEN 5 THEN 'a_2_1.jpg' ELSE 'a.jpg' END) AS target FROM @documents"
NAMES_TAKEN = "SELECT DISTINCT concat(source, CASE lang WHEN 'de' THEN '/a_3.jpg' WHEN 'fr' THEN '/b.jpg' ELSE '/a_1_1.jpg' END) AS path FROM @documents WHERE lang <> 'en'"


@query("conflict_free_names", f"""WITH RECURSIVE req AS (SELECT *, regexp_extract(target, '^[^/]+') AS g, row_number() OVER (PARTITION BY regexp_extract(target, '^[^/]+') ORDER BY doc_id) AS n FROM ({NAME_REQUESTS})),
taken AS (SELECT regexp_extract(path, '^[^/]+') AS g, list(path) AS used FROM ({NAMES_TAKEN}) GROUP BY 1),
walk AS (
  SELECT r.g, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS VARCHAR) AS name, coalesce(any_value(used), []) AS used FROM req r LEFT JOIN taken USING (g) GROUP BY r.g
  UNION ALL
  SELECT g, n, doc_id, name, list_append(used, name) FROM (
    SELECT r.g, r.n, r.doc_id, used, CASE WHEN NOT list_contains(used, target) THEN target ELSE concat(replace(target, '.jpg', ''), '_',
      list_filter(range(1, r.n + 5), lambda i: NOT list_contains(used, concat(replace(target, '.jpg', ''), '_', i, '.jpg')))[1], '.jpg') END AS name
    FROM walk w JOIN req r ON r.g = w.g AND r.n = w.n + 1)
) SELECT doc_id, name FROM walk WHERE n > 0""")
def _(d):
    return conflict_free_names(d.sql(NAME_REQUESTS), d.sql(NAMES_TAKEN), "doc_id", "target").select("doc_id", "name")


@query("image_url_candidates", f"""SELECT p_partkey, array_to_string(list_slice({uniq("CASE WHEN p_type IN ('PROMO', 'LARGE') THEN ['u/' || p_brand, 'u/' || p_type] WHEN p_type = 'SMALL' THEN ['u/' || p_type, 'u/' || p_brand, 'u/' || p_name] ELSE ['u/' || p_name] END")}, 1, 2), '|') AS urls FROM @part""")
def _(d):
    u = lambda c: F.concat(F.lit("u/"), c)
    pictures = F.struct(u("p_brand").alias("large"), u("p_type").alias("medium"), u("p_brand").alias("small"), F.lit("").alias("grid"))
    provider = F.when(F.col("p_type").isin("PROMO", "LARGE"), "Anilist").when(F.col("p_type") == "SMALL", "bangumi").otherwise("jikan")
    return d.part.select("p_partkey", F.array_join(S.image_url_candidates(provider, pictures, u("p_name"), 2), "|").alias("urls"))


# --------------------------------------------------------------------- queue

QUEUE = "SELECT doc_id, source || '/' || doc_id || '.jpg' AS image_path, lang || '|' || source AS tags, CASE WHEN n_chars > 1000 THEN 'done' ELSE '' END AS status FROM @documents WHERE lang <> 'fr'"
EDITS = "SELECT doc_id, upper(source) || '/' || doc_id || '.jpg' AS image_path, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS t1, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'src1' END AS t2 FROM @labels JOIN @documents USING (doc_id)"


def queue_inputs(d: Data):
    docs = d.documents.filter(F.col("lang") != "fr")
    empty = F.array().cast("array<string>")
    queue = docs.select(
        F.concat("source", F.lit("/"), "doc_id", F.lit(".jpg")).alias("image_path"), empty.alias("characters"), F.array("lang", "source").alias("feature_tags"),
        empty.alias("source_game"), F.lit(True).alias("review_required"), F.when(F.col("n_chars") > 1000, "done").otherwise("").alias("status"),
        F.lit("2023").alias("created_at"), F.lit(None).cast("string").alias("updated_at"),
    )
    rows = d.labels.join(d.documents, "doc_id")
    tags = F.array(F.when(F.col("quality") == 1, "good").otherwise("bad"), F.when(F.col("toxic") == 1, "toxic").otherwise("src1"), F.lit(" "))
    edits = rows.select(F.concat(F.upper("source"), F.lit("\\"), "doc_id", F.lit(".jpg")).alias("image_path"), tags.alias("feature_tags"))
    return queue, edits


QUEUE_SQL = f"""WITH q AS ({QUEUE}), e AS ({EDITS}) SELECT lower(coalesce(q.image_path, e.image_path)) AS path, {{tags}} AS tags, coalesce(q.status, 'labeled_draft') AS status,
 CASE WHEN q.doc_id IS NULL THEN '{NOW}' ELSE '2023' END AS created_at, CASE WHEN e.doc_id IS NULL THEN '' ELSE '{NOW}' END AS updated_at FROM q FULL JOIN e USING (doc_id)"""


def queue_out(rows):
    return rows.select(
        F.lower(F.translate("image_path", "\\", "/")).alias("path"), F.array_join("feature_tags", "|").alias("tags"), "status", "created_at",
        F.coalesce("updated_at", F.lit("")).alias("updated_at"),
    )


@query("queue_replace", QUEUE_SQL.replace("{tags}", "CASE WHEN e.doc_id IS NULL THEN tags ELSE t1 || '|' || t2 END"))
def _(d):
    return queue_out(Q.queue_replace(*queue_inputs(d), NOW))


@query("queue_append", QUEUE_SQL.replace("{tags}", f"CASE WHEN e.doc_id IS NULL THEN tags ELSE array_to_string({uniq('list_concat(string_split(coalesce(tags, chr(124)), chr(124)), [t1, t2])')}, '|') END"))
def _(d):
    return queue_out(Q.queue_append(*queue_inputs(d), NOW))


@query("metadata_append", f"""SELECT doc_id AS key, array_to_string({uniq("list_concat([source, lang], CASE lang WHEN 'en' THEN ['English', 'EN', g] WHEN 'de' THEN ['Deutsch', 'DE', g] ELSE [lang, g] END)")}, '|') AS keywords
FROM (SELECT d.*, CASE WHEN quality = 1 THEN 'G' ELSE lang END AS g FROM @documents d JOIN @labels USING (doc_id))""")
def _(d):
    rows = d.labels.join(d.documents, "doc_id").select(
        F.col("doc_id").alias("key"), F.array("lang", F.upper("lang"), F.when(F.col("quality") == 1, F.lit("G")).otherwise(F.lit(" "))).alias("tokens"))
    old = d.documents.select(F.col("doc_id").alias("key"), F.array("source", F.lit(""), "lang").alias("keywords"))
    names = d.sql(values("token, name", [("en", "English"), ("de", " Deutsch "), ("es", " ")]))
    return Q.metadata_append(rows, old, names=names).select("key", F.array_join("keywords", "|").alias("keywords"))


@query("bulk_summary", """SELECT count(*) AS processed, count(*) FILTER (a + p > 0 AND NOT f) AS updated, count(*) FILTER (a + p = 0 AND NOT f) AS skipped, count(*) FILTER (f) AS failed, CAST(sum(a) AS BIGINT) AS added, CAST(sum(p) AS BIGINT) AS pruned
 FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS a, count(*) FILTER (event_type = 'signup' AND value > 15) AS p, max(value) > 99 AS f FROM @events GROUP BY user_id)""")
def _(d):
    e = d.events.groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("added"), F.count_if((F.col("event_type") == "signup") & (F.col("value") > 15)).alias("pruned"),
        (F.max("value") > 99).alias("failed"),
    )
    return Q.bulk_summary(e)


@query("editor_groups", f"""WITH taxonomy AS ({RULES['taxonomy']}) SELECT 'feature' AS kind, category_id AS group_name, coalesce(name, tag_id) AS label, tag_id AS value FROM taxonomy WHERE replace(tag_id, '_', ' ') IN (SELECT p_name FROM @part)
 UNION ALL SELECT 'character', n_name, s_name, CAST(s_suppkey AS VARCHAR) FROM @supplier JOIN @nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0""")
def _(d):
    used = d.part.select(F.translate("p_name", " ", "_").alias("tag_id")).distinct()
    tags = rule(d, "taxonomy").join(used, "tag_id", "left_semi")
    people = d.supplier.filter(F.col("s_acctbal") > 0).join(d.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    none = F.lit(None).cast("array<struct<name:string,language:string>>")
    names = people.select(
        F.col("n_name").alias("group_name"),
        L.localized_alias(F.col("s_name"), none, "ja-JP", editor=True).alias("label"), F.col("s_suppkey").cast("string").alias("value"),
    )
    return S.editor_groups(tags, names)
