"""Queries over entity libraries: joins, imports, merges, maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import localize as L
from tagloom.functions import text as X
from tagloom.functions import vectors as V
from tagloom.operators import entities as N
from tagloom.operators import ranking as K
from tagloom.operators import references as Q
from tagloom.operators.tags import run_summary  # noqa: F401
from tagloom.plans.fixtures import RULES, rule
from tagloom.plans.registry import Data, query
from tagloom.plans.text_queries import key, slug, uniq, variant_keys, ws

NOW = "2024-01-01T00:00:00"

# entities: every part under its name and size; candidates: every part again,
# with longer names for some types and other ids and works
ENTITIES = """
SELECT concat('e', CAST(p_partkey AS VARCHAR(20))) AS id, p_partkey AS ordinal, concat(p_name, ' ', CAST(p_size AS VARCHAR(9))) AS display_name,
  CASE p_type WHEN 'MEDIUM' THEN '' WHEN 'SMALL' THEN concat('Genshin - ', p_brand) WHEN 'PROMO' THEN 'Genshin Impact' ELSE concat('Saga ', p_brand) END AS source_title,
  CASE WHEN p_size > 45 THEN 'manual' WHEN p_type = 'LARGE' THEN 'anilist' ELSE 'bangumi' END AS provider,
  CASE WHEN p_size > 45 THEN '' ELSE concat('ID', CAST(p_partkey AS VARCHAR(20))) END AS provider_entity_id, p_brand, p_size, p_type
FROM @part
"""
CANDIDATES = """
SELECT p_partkey AS candidate_id, p_partkey AS ordinal, p_brand AS request_id,
  CASE p_type WHEN 'LARGE' THEN concat(upper(p_name), '-', CAST(p_size AS VARCHAR(9)), ' ', p_brand) WHEN 'PROMO' THEN p_name WHEN 'ECONOMY' THEN concat('Quux ', CAST(p_partkey AS VARCHAR(20))) ELSE concat(p_name, ' ', CAST(p_size AS VARCHAR(9))) END AS display_name,
  CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN concat('Genshin (', p_brand, ')') ELSE concat('Saga ', p_brand) END AS source_title,
  CASE WHEN p_type = 'LARGE' THEN 'Anilist' WHEN p_type = 'STANDARD' THEN 'jikan' ELSE 'bangumi' END AS provider,
  CASE WHEN p_size > 40 THEN '' WHEN p_size > 30 THEN concat('id', CAST(p_partkey AS VARCHAR(20))) ELSE concat('x', CAST(p_partkey % 500 AS VARCHAR(20))) END AS provider_entity_id,
  CASE WHEN p_size > 10 THEN concat('http://', p_brand) ELSE '' END AS avatar_url, p_name, p_size
FROM @part
"""

LINKS = """ent_links AS (SELECT link_key, arg_min(id, ordinal) AS id FROM (
  SELECT lower(provider || ':' || provider_entity_id) AS link_key, id, ordinal FROM entities WHERE provider_entity_id <> ''
  UNION ALL SELECT lower('jikan:J' || p_size), id, ordinal FROM entities WHERE p_size > 20) GROUP BY link_key)"""
LINK = "CASE WHEN provider_entity_id <> '' THEN lower(provider || ':' || provider_entity_id) END"


def _overlap(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 WHEN contains({b}, {a}) THEN len({a}) WHEN contains({a}, {b}) THEN len({b}) ELSE 0 END"


def _cut(c: str) -> str:
    for tokens in (X.TITLE_SEPARATORS, ("（",), ("(",)):
        spots = ", ".join(f"CASE WHEN instr({c}, '{t}') > 1 THEN instr({c}, '{t}') END" for t in tokens)
        c = f"(CASE WHEN coalesce({spots}) IS NULL THEN {c} ELSE trim(substr({c}, 1, coalesce({spots}) - 1)) END)"
    return c


SOURCES = f"""titles AS (SELECT DISTINCT source_title AS t FROM entities UNION SELECT DISTINCT source_title FROM candidates),
src AS (SELECT t, {uniq(variant_keys('t'))} AS v, CASE WHEN k = 'genshin' OR starts_with(k, 'genshin_') THEN 'genshin_impact' WHEN k = '' THEN 'unknown_source' ELSE k END AS c
  FROM (SELECT t, {slug(_cut('t'))} AS k FROM titles)),
compat AS (SELECT a.t AS l, b.t AS r FROM src a, src b WHERE a.t = '' OR b.t = '' OR a.c = b.c OR len(list_filter(a.v, lambda x: len(list_filter(b.v,
  lambda y: (contains(y, x) AND len(x) >= 4) OR (contains(x, y) AND len(y) >= 4))) > 0)) > 0)"""
BASE = f"""WITH entities AS ({ENTITIES}), candidates AS ({CANDIDATES}), {LINKS}, {SOURCES}"""


def _identity(name: str, entity_keys: str, candidate_keys: str) -> str:
    """``{name}(candidate_id, ordinal)``: first entity of the same identity, from
    keys (ordinal, source_title, k) and (candidate_id, source_title, d, k)."""
    return f"""{name}_e AS ({entity_keys}), {name}_c AS ({candidate_keys}),
{name}_kp AS (SELECT l, r, {_overlap('l', 'r')} AS o FROM (SELECT DISTINCT k AS l FROM {name}_c), (SELECT DISTINCT k AS r FROM {name}_e)),
{name}_1 AS (SELECT c.candidate_id, min(e.ordinal) AS ordinal FROM {name}_c c JOIN {name}_kp kp ON kp.l = c.k AND kp.o >= 4 JOIN {name}_e e ON e.k = kp.r JOIN compat ON compat.l = c.source_title AND compat.r = e.source_title GROUP BY 1),
{name}_2 AS (SELECT c.candidate_id, min(e.ordinal) AS ordinal FROM (SELECT DISTINCT candidate_id, d FROM {name}_c) c JOIN {name}_kp kp ON kp.l = c.d AND kp.o >= 5 JOIN {name}_e e ON e.k = kp.r GROUP BY 1),
{name} AS (SELECT candidate_id, min(ordinal) AS ordinal FROM (SELECT * FROM {name}_1 UNION ALL SELECT * FROM {name}_2) GROUP BY 1)"""


def _candidate_keys(source: str) -> str:
    return f"SELECT candidate_id, source_title, k, d FROM (SELECT candidate_id, source_title, {key('display_name')} AS d, unnest([{key('display_name')}, {key('source_title')}]) AS k FROM {source}) WHERE k <> ''"


IDENT = _identity(
    "ident", f"SELECT DISTINCT ordinal, source_title, {key('display_name')} AS k FROM entities UNION SELECT ordinal, source_title, {key('p_brand')} FROM entities WHERE p_size = 7",
    _candidate_keys("candidates"))


def entities(d: Data):
    alias = F.when(F.col("p_size") == 7, F.array(F.struct(F.col("p_brand").alias("name"), F.lit("en-US").alias("language"))))
    link = F.when(F.col("p_size") > 20, F.array(F.struct(F.lit("Jikan").alias("provider"), F.concat(F.lit("j"), "p_size").alias("provider_entity_id"))))
    return d.sql(ENTITIES).withColumns({"aliases": alias, "provider_links": link})


def candidates(d: Data):
    return d.sql(CANDIDATES).withColumn("aliases", F.array().cast("array<string>"))


def longs(df, *names):
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in names else c for c in df.columns])


@query("provider_link_join", BASE + f" SELECT candidate_id, l.id FROM candidates LEFT JOIN ent_links l ON l.link_key = {LINK}")
def _(d):
    return N.provider_link_join(candidates(d), entities(d)).select("candidate_id", "id")


@query("existing_candidate_antijoin", BASE + f""", c AS (SELECT *, {LINK} AS lk, coalesce({LINK}, lower(provider) || ':' || {key('display_name')} || ':' || {key('source_title')}) AS ck FROM candidates)
SELECT request_id, min(candidate_id) AS candidate_id FROM c WHERE lk IS NULL OR lk NOT IN (SELECT link_key FROM ent_links) GROUP BY request_id, ck""")
def _(d):
    return N.existing_candidate_antijoin(candidates(d), entities(d)).select("request_id", "candidate_id")


@query("source_compatible", BASE + " SELECT c.candidate_id, e.id, (c.source_title, e.source_title) IN (SELECT (l, r) FROM compat) AS compatible FROM candidates c JOIN entities e ON e.ordinal = c.ordinal + 1")
def _(d):
    c = N.with_source_keys(candidates(d).select("candidate_id", F.col("source_title").alias("l"), (F.col("ordinal") + 1).alias("ordinal")), "l", "l", rule(d, "source_aliases"))
    e = N.with_source_keys(entities(d).select("id", "ordinal", F.col("source_title").alias("r")), "r", "r", rule(d, "source_aliases"))
    ok = N.source_compatible(F.col("l"), F.col("r"), F.col("l_canonical"), F.col("r_canonical"), F.col("l_variants"), F.col("r_variants"))
    return c.join(e, "ordinal").select("candidate_id", "id", ok.alias("compatible"))


@query("identity_fuzzy_join", BASE + f", {IDENT} SELECT candidate_id, id FROM ident JOIN (SELECT DISTINCT ordinal, id FROM entities) USING (ordinal)")
def _(d):
    return N.identity_fuzzy_join(candidates(d), entities(d), aliases=rule(d, "source_aliases"))


NEW_ID = f"'custom_' || {slug('display_name')} || '_' || substr(sha1(display_name || '|' || source_title || '|' || provider || '|' || provider_entity_id), 1, 8)"


@query("library_import", BASE.replace("WITH", "WITH RECURSIVE", 1) + f""", {IDENT}, c AS (SELECT *, {LINK} AS lk FROM candidates),
linked AS (SELECT c.*, l.id AS link_id, e.id AS same_id FROM c LEFT JOIN ent_links l ON l.link_key = lk LEFT JOIN ident i USING (candidate_id) LEFT JOIN entities e ON e.ordinal = i.ordinal),
rest AS (SELECT *, min(ordinal) OVER (PARTITION BY coalesce(lk, '#' || candidate_id)) AS owner FROM linked WHERE link_id IS NULL AND same_id IS NULL),
own AS (SELECT * FROM rest WHERE ordinal = owner),
{_identity("batch", f"SELECT ordinal, source_title, {key('display_name')} AS k FROM own WHERE {key('display_name')} <> ''", _candidate_keys("own"))},
parent AS (SELECT own.ordinal, least(own.ordinal, coalesce(b.ordinal, own.ordinal)) AS up FROM own LEFT JOIN batch b USING (candidate_id)),
climb AS (SELECT ordinal, up FROM parent UNION SELECT c.ordinal, p.up FROM climb c JOIN parent p ON p.ordinal = c.up),
root AS (SELECT ordinal AS owner, min(up) AS root FROM climb GROUP BY 1),
ids AS (SELECT ordinal AS root, {NEW_ID} AS id FROM own)
SELECT candidate_id, 'existing' AS action, link_id AS id FROM linked WHERE link_id IS NOT NULL
UNION ALL SELECT candidate_id, 'merge', same_id FROM linked WHERE link_id IS NULL AND same_id IS NOT NULL
UNION ALL SELECT candidate_id, CASE WHEN ordinal = root THEN 'new' WHEN ordinal = owner THEN 'merge' ELSE 'existing' END, ids.id FROM rest JOIN root USING (owner) JOIN ids USING (root)""")
def _(d):
    return N.library_import(candidates(d), entities(d), aliases=rule(d, "source_aliases")).select("candidate_id", "action", "id")


@query("library_import_new", BASE + f""", c AS (SELECT *, coalesce({LINK}, '#' || candidate_id) AS lk FROM candidates WHERE NOT coalesce({LINK} IN (SELECT link_key FROM ent_links), FALSE)),
own AS (SELECT lk, arg_min({NEW_ID}, ordinal) AS id, min(ordinal) AS owner FROM c GROUP BY lk)
SELECT candidate_id, CASE WHEN ordinal = owner THEN 'new' ELSE 'existing' END AS action, id FROM c JOIN own USING (lk)
UNION ALL SELECT candidate_id, 'existing', l.id FROM candidates JOIN ent_links l ON l.link_key = {LINK}""")
def _(d):
    return N.library_import(candidates(d), entities(d), strategy="new")


MERGES = f"merges AS (SELECT e.id, c.* FROM candidates c JOIN entities e ON e.ordinal = c.candidate_id - c.p_size % 3)"
PRIO = "CASE lower(provider) WHEN 'anilist' THEN 4 WHEN 'bangumi' THEN 3 WHEN 'jikan' THEN 2 WHEN 'manual' THEN 1 ELSE 0 END"


def merges(d: Data):
    c = candidates(d).withColumn("_at", F.col("candidate_id") - F.col("p_size") % 3)
    ids = entities(d).select("id", F.col("ordinal").alias("_at"))
    return c.join(ids, "_at").drop("_at")


@query("library_merge", BASE + f""", {MERGES}, m AS (SELECT *, {PRIO} AS pr FROM merges),
best AS (SELECT id, provider AS bp, provider_entity_id AS be, pr FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pr DESC, ordinal DESC) AS rn FROM m WHERE provider_entity_id <> '') WHERE rn = 1),
ft AS (SELECT id, arg_min(source_title, ordinal) AS ft FROM m WHERE source_title <> '' GROUP BY id),
fa AS (SELECT id, arg_min(avatar_url, ordinal) AS fa FROM m WHERE avatar_url <> '' GROUP BY id),
b AS (SELECT e.id, e.provider, e.provider_entity_id, {PRIO.replace('provider', 'e.provider')} AS ep, best.*, coalesce(nullif(e.source_title, ''), ft, '') AS t, coalesce(fa, '') AS avatar FROM entities e LEFT JOIN best ON best.id = e.id LEFT JOIN ft ON ft.id = e.id LEFT JOIN fa ON fa.id = e.id),
lg AS (SELECT id, source_title AS lt FROM (SELECT m.id, m.source_title, row_number() OVER (PARTITION BY m.id ORDER BY len(m.source_title) DESC, m.ordinal) AS rn FROM m JOIN b ON b.id = m.id
  WHERE len(m.source_title) > len(b.t) AND b.t <> '' AND (b.t, m.source_title) IN (SELECT (l, r) FROM compat)) WHERE rn = 1)
SELECT b.id, CASE WHEN pr >= ep THEN bp ELSE provider END AS provider, CASE WHEN pr >= ep THEN be ELSE provider_entity_id END AS provider_entity_id,
 coalesce(lt, t) AS source_title, avatar AS avatar_url FROM b LEFT JOIN lg ON lg.id = b.id""")
def _(d):
    rows = N.merged_fields(entities(d).withColumn("avatar_url", F.lit("")), merges(d), rule(d, "source_aliases"))
    return rows.select("id", "provider", "provider_entity_id", "source_title", "avatar_url")


@query("library_merge_aliases", BASE + f""", {MERGES}, a AS (SELECT id, 0 AS layer, 0 AS o, 0 AS p, display_name AS name FROM entities UNION ALL SELECT id, 0, 0, 1, p_brand FROM entities WHERE p_size = 7
  UNION ALL SELECT id, 1, ordinal, 0, display_name FROM merges)
SELECT id, arg_min(name, (layer, o, p)) AS name, 'en-US' AS language FROM a GROUP BY id, lower(name)""")
def _(d):
    return N.merged_aliases(entities(d), merges(d))


@query("library_merge_links", BASE + f""", {MERGES}, l AS (SELECT id, 0 AS layer, 0 AS o, provider, provider_entity_id FROM entities UNION ALL SELECT id, 0, 1, 'Jikan', 'j' || p_size FROM entities WHERE p_size > 20
  UNION ALL SELECT id, 1, ordinal, provider, provider_entity_id FROM merges)
SELECT id, arg_min(provider, (layer, o)) AS provider, arg_min(provider_entity_id, (layer, o)) AS provider_entity_id FROM l WHERE provider_entity_id <> '' GROUP BY id, lower(provider || ':' || provider_entity_id)""")
def _(d):
    return N.merged_links(entities(d), merges(d))


@query("library_upsert", BASE + f""", c AS (SELECT *, {LINK} AS lk FROM candidates), f AS (SELECT *, row_number() OVER (PARTITION BY coalesce(lk, '#' || candidate_id) ORDER BY ordinal) AS rn FROM c
  WHERE lk IS NULL OR lk NOT IN (SELECT link_key FROM ent_links))
SELECT {NEW_ID.replace("provider_entity_id)", "provider_entity_id || CASE WHEN lk IS NULL THEN '#' || ordinal ELSE '' END)")} AS id, display_name, source_title, provider, '{NOW}' AS created_at FROM f WHERE rn = 1
UNION ALL SELECT id, display_name, source_title, provider, '2023-01-01T00:00:00' FROM entities""")
def _(d):
    old = entities(d).withColumns({"enabled": F.lit(True), "created_at": F.lit("2023-01-01T00:00:00"), "updated_at": F.lit("2023-01-01T00:00:00")})
    return N.library_upsert(old, candidates(d), NOW).select("id", "display_name", "source_title", "provider", "created_at")


@query("library_update", BASE + f""", p AS (SELECT 'e' || s_suppkey * 3 AS id, s_name AS display_name FROM supplier)
SELECT e.id, coalesce(p.display_name, e.display_name) AS display_name, CASE WHEN p.id IS NULL THEN 'old' ELSE '{NOW}' END AS updated_at, FALSE AS missing FROM entities e LEFT JOIN p USING (id)
UNION ALL SELECT id, '', '', TRUE FROM p WHERE id NOT IN (SELECT id FROM entities)""")
def _(d):
    patches = d.supplier.select(F.concat(F.lit("e"), F.col("s_suppkey") * 3).alias("id"), F.concat(F.lit(" "), "s_name").alias("display_name"))
    rows, missing = N.library_update(entities(d).withColumn("updated_at", F.lit("old")), patches, NOW)
    out = rows.select("id", "display_name", "updated_at", F.lit(False).alias("missing"))
    return out.unionByName(missing.select("id", F.lit("").alias("display_name"), F.lit("").alias("updated_at"), F.lit(True).alias("missing")))


@query("library_enable", "SELECT 'e' || p_partkey AS id, s_suppkey IS NULL AS enabled FROM @part LEFT JOIN @supplier ON s_suppkey = p_partkey")
def _(d):
    off = d.supplier.select(F.concat(F.lit("e"), "s_suppkey").alias("id"), F.lit(False).alias("enabled"))
    rows, _ = N.library_update(entities(d).select("id").withColumn("enabled", F.lit(True)), off, NOW)
    return rows


@query("library_delete", "SELECT count(*) AS total, count(p_partkey) AS deleted, count(*) - count(p_partkey) AS missing, (SELECT count(*) FROM @part WHERE p_partkey NOT IN (SELECT c_custkey * 2 FROM @customer)) AS remaining FROM @customer LEFT JOIN @part ON p_partkey = c_custkey * 2")
def _(d):
    ids = d.customer.select(F.concat(F.lit("e"), F.col("c_custkey") * 2).alias("id"))
    rest, summary = N.library_delete(entities(d), ids)
    return summary.withColumn("remaining", rest.agg(F.count(F.lit(1))).scalar())


@query("library_lookup", BASE + " SELECT id, display_name FROM entities WHERE ordinal IN (SELECT c_custkey FROM customer)")
def _(d):
    wanted = d.customer.select(F.concat(F.lit("e"), "c_custkey").alias("id"))
    return N.library_lookup(entities(d), wanted).select("id", "display_name")


@query("library_listing", BASE + " SELECT id, display_name AS name, source_title AS work, CAST(CASE WHEN p_size > 30 THEN 2 ELSE 0 END AS BIGINT) AS reference_count, CASE WHEN p_size < 5 THEN '' ELSE '✓' END AS mark FROM entities")
def _(d):
    refs = F.array(F.when(F.col("p_size") > 30, F.col("id")).otherwise(""), F.lit(" "), F.when(F.col("p_size") > 30, F.col("p_brand")).otherwise(""))
    none = F.lit(None).cast("array<struct<name:string,language:string>>")
    rows = entities(d).withColumns({"reference_images": refs, "enabled": F.col("p_size") >= 5, "source_aliases": none})
    return N.library_listing(rows, "zh-CN")


@query("enabled_reference_filter", BASE + " SELECT e.id, c.c_name AS path FROM entities e JOIN customer c ON c.c_custkey = e.ordinal WHERE e.p_size > 10 OR e.p_size < 3")
def _(d):
    enabled = F.when(F.col("p_size") > 10, F.lit(True)).when(F.col("p_size") >= 3, F.lit(False))
    refs = entities(d).select("id", F.format_string("Customer#%09d", "ordinal").alias("path"), enabled.alias("enabled"))
    files = d.customer.select(F.col("c_name").alias("path"))
    return N.enabled_references(refs, files).select("id", "path")


@query("source_groups", "SELECT source AS source_title, count(*) AS character_count FROM @documents WHERE source <> '' GROUP BY source")
def _(d):
    return N.source_groups(document_entities(d))[0]


@query("source_group_aliases", "SELECT source AS source_title, source AS name, 'en-US' AS language FROM @documents GROUP BY source UNION ALL SELECT source, min(upper(source) || '-' || lang), 'en-US' FROM @documents GROUP BY source, lower(source || lang)")
def _(d):
    return N.source_groups(document_entities(d))[1]


def document_entities(d: Data):
    alias = F.array(F.struct(F.concat(F.upper("source"), F.lit("-"), "lang").alias("name"), F.lit("").alias("language")))
    return d.documents.select(
        F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("ordinal"), F.col("source").alias("source_title"), alias.alias("source_aliases")
    )


@query("source_rename", "SELECT doc_id, CASE WHEN source = 'src3' AND lang = 'en' THEN 'Series Three' ELSE source END AS source_title, source = 'src3' AND lang = 'en' AS changed FROM @documents")
def _(d):
    rows = d.documents.select("doc_id", F.col("source").alias("source_title"), "lang")
    return N.source_rename(rows, F.lit("src3"), F.lit("Series Three"), F.col("lang") == "en").drop("lang")


@query("source_alias_set", "SELECT doc_id, CASE WHEN source = 'src4' THEN 'src4:en-US|四:zh-CN' ELSE '' END AS aliases, source = 'src4' AS changed FROM @documents")
def _(d):
    rows = d.documents.select("doc_id", F.col("source").alias("source_title"), F.array().cast("array<struct<name:string,language:string>>").alias("source_aliases"))
    new = F.array(F.struct(F.lit("四").alias("name"), F.lit("").alias("language")), F.struct(F.lit("SRC4").alias("name"), F.lit("en").alias("language")))
    out = N.source_alias_set(rows, "src4", new)
    text = F.array_join(F.transform("source_aliases", lambda a: F.concat(a["name"], F.lit(":"), a["language"])), "|")
    return out.select("doc_id", text.alias("aliases"), "changed")


@query("alias_diff", """WITH a AS (SELECT lower(source) AS k, lang, arg_min(source, doc_id) AS name FROM @documents WHERE n_chars < 2000 GROUP BY 1, 2), b AS (SELECT lower(source) AS k, lang, arg_min(upper(source), doc_id) AS name FROM @documents WHERE n_chars >= 2000 GROUP BY 1, 2)
SELECT 'current' AS side, name, lang AS language FROM a ANTI JOIN b USING (k, lang) UNION ALL SELECT 'existing', name, lang FROM b ANTI JOIN a USING (k, lang)""")
def _(d):
    rows = d.documents.select(F.col("source").alias("name"), F.col("lang").alias("language"), F.col("doc_id").alias("ordinal"), "n_chars")
    left = rows.filter(F.col("n_chars") < 2000).drop("n_chars")
    right = rows.filter(F.col("n_chars") >= 2000).drop("n_chars").withColumn("name", F.upper("name"))
    return N.alias_diff(left, right)


SIG = "CAST('0x' || substr(md5(CAST({o} AS VARCHAR) || chr(1) || {cols}), 1, 15) AS BIGINT)"


@query("dataset_signature", f"SELECT count(*) AS rows, bit_xor({SIG.format(o='p_partkey', cols='p_name || chr(1) || p_brand')}) AS signature FROM @part")
def _(d):
    return N.dataset_signature(d.part, F.col("p_partkey"), F.col("p_name"), F.col("p_brand"))


@query("coalescing_lookup_join", """WITH idx AS (SELECT k, arg_max(p_partkey, p_partkey) AS entry FROM (SELECT replace(p_name, ' ', '') AS k, p_partkey FROM @part WHERE p_size > 25 UNION ALL SELECT split_part(p_name, ' ', 2), p_partkey FROM @part WHERE p_type = 'LARGE') GROUP BY k)
SELECT p_partkey, coalesce(a.entry, b.entry, c.entry, -1) AS entry FROM @part LEFT JOIN idx a ON a.k = replace(p_name, ' ', '') LEFT JOIN idx b ON b.k = split_part(p_name, ' ', 1) LEFT JOIN idx c ON c.k = split_part(p_name, ' ', 2)""")
def _(d):
    full = d.part.filter(F.col("p_size") > 25).select(X.ascii_key(F.col("p_name")).alias("key"), F.col("p_partkey").alias("entry"), F.col("p_partkey").alias("ordinal"))
    short = d.part.filter(F.col("p_type") == "LARGE").select(F.substring_index("p_name", " ", -1).alias("key"), F.col("p_partkey").alias("entry"), F.col("p_partkey").alias("ordinal"))
    n = F.col("p_name")
    keys = F.array(X.ascii_key(n), X.ascii_key(F.substring_index(n, " ", 1)), X.ascii_key(F.substring_index(n, " ", -1)))
    return N.coalescing_lookup(d.part.select("p_partkey", "p_name"), "p_partkey", keys, full.unionByName(short), F.lit(-1).cast("bigint")).select("p_partkey", "entry")


@query("name_lookup_join", BASE + """, idx AS (SELECT k, arg_min(id, (ordinal, p)) AS id FROM (SELECT lower(display_name) AS k, id, ordinal, 0 AS p FROM entities UNION ALL SELECT lower(p_brand), id, ordinal, 1 FROM entities WHERE p_size = 7) GROUP BY k)
SELECT candidate_id, idx.id FROM candidates JOIN idx ON idx.k = lower(display_name)""")
def _(d):
    c = candidates(d).select("candidate_id", F.lower(X.strip(F.col("display_name"))).alias("key"))
    return c.join(N.name_index(entities(d)), "key").select("candidate_id", "id")


@query("feature_resolve_cascade", f"""WITH taxonomy AS ({RULES['taxonomy']}), aliases AS ({RULES['aliases']}), tok AS (
  SELECT p_partkey AS item_id, CASE WHEN p_size > 40 THEN replace(p_name, ' ', '_') WHEN p_size > 20 THEN upper(p_name[1]) || replace(p_name[2:], ' ', ' - ') WHEN p_size > 10 THEN p_name ELSE 'Small-' || split_part(p_name, ' ', 2) END AS raw FROM @part),
n AS (SELECT *, lower(trim(regexp_replace(raw, '[_\\-\\s]+', '_', 'g'), '_')) AS norm FROM tok), al AS (SELECT lower(token) AS k, arg_min(canonical_id, ordinal) AS tag FROM aliases GROUP BY 1)
SELECT item_id, coalesce(t1.tag_id, t2.tag_id, a1.tag, a2.tag) AS tag FROM n LEFT JOIN taxonomy t1 ON t1.tag_id = raw LEFT JOIN taxonomy t2 ON t2.tag_id = norm LEFT JOIN al a1 ON a1.k = lower(raw) LEFT JOIN al a2 ON a2.k = norm
WHERE coalesce(t1.tag_id, t2.tag_id, a1.tag, a2.tag) IS NOT NULL""")
def _(d):
    n = F.col("p_name")
    token = (
        F.when(F.col("p_size") > 40, F.translate(n, " ", "_"))
        .when(F.col("p_size") > 20, F.concat(F.upper(F.substring(n, 1, 1)), F.replace(F.substring(n, 2, 99), F.lit(" "), F.lit(" - "))))
        .when(F.col("p_size") > 10, F.concat(F.lit("Tags: "), n))
        .otherwise(F.concat(F.lit("Small-"), F.substring_index(n, " ", -1)))
    )
    tokens = d.part.select(F.col("p_partkey").alias("item_id"), F.lit(0).alias("pos"), token.alias("token"))
    return N.feature_cascade(tokens, rule(d, "taxonomy"), rule(d, "aliases")).select("item_id", "tag")


@query("alias_entries", """WITH x AS (SELECT p_partkey, unnest([0, 1, 2, 3]) AS i, p_name, p_brand, p_type FROM @part),
e AS (SELECT p_partkey, i, CASE i WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_type ELSE upper(p_name) END AS name, CASE WHEN i = 1 THEN 'ja-JP' ELSE 'en-US' END AS language FROM x)
SELECT p_partkey, arg_min(name, i) AS name, language, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY min(i)) AS BIGINT) AS pos FROM e GROUP BY p_partkey, lower(name), language""")
def _(d):
    # a list of plain texts and objects with different field names
    items = F.concat(
        F.lit('[{"display_name":"'), "p_brand", F.lit('","lang":"ja_jp"},"'), "p_type", F.lit('",{"alias":"'), F.upper("p_name"), F.lit('","language":"en"},"", {"name":" "}]')
    )
    variants = F.try_variant_get(F.parse_json(items), "$", "array<variant>")
    rows = d.part.select("p_partkey", F.posexplode(L.alias_entries_from_variant(F.col("p_name"), variants)).alias("pos", "e"))
    return rows.select("p_partkey", "e.name", "e.language", (F.col("pos") + 1).cast("bigint").alias("pos"))


@query("provider_links", """WITH l AS (
  SELECT p_partkey, 1 AS o, CASE WHEN p_size % 3 = 0 THEN 'manual' ELSE p_brand END AS provider, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END AS e FROM @part
  UNION ALL SELECT p_partkey, 2, 'MANUAL', upper(p_name) FROM @part UNION ALL SELECT p_partkey, 3, p_brand, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END FROM @part
  UNION ALL SELECT p_partkey, 4, lower(p_brand), CASE WHEN p_size % 5 = 0 THEN p_name ELSE lower(p_type) END FROM @part),
f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, lower(provider), lower(e) ORDER BY o) AS n FROM l WHERE e <> '')
SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY o) AS pos, provider, e AS provider_entity_id FROM f WHERE n = 1""")
def _(d):
    link = lambda p, e: F.struct(p.alias("provider"), e.alias("provider_entity_id"))
    size, blank = F.col("p_size"), F.lit("  ")
    links = F.array(
        link(F.lit("MANUAL"), F.upper("p_name")), link(F.col("p_brand"), F.when(size % 2 == 0, blank).otherwise(F.col("p_type"))),
        link(F.lower("p_brand"), F.when(size % 5 == 0, F.col("p_name")).otherwise(F.lower("p_type"))),
    )
    first = L.provider_links(F.when(size % 3 == 0, blank).otherwise(F.col("p_brand")), F.when(size % 7 == 0, blank).otherwise(F.col("p_name")), links)
    rows = d.part.select("p_partkey", F.posexplode(first).alias("pos", "l"))
    return rows.select("p_partkey", (F.col("pos") + 1).cast("bigint").alias("pos"), "l.provider", "l.provider_entity_id")


@query("ordered_distinct", f"SELECT p_partkey, array_to_string({uniq('[split_part(p_name, chr(32), 1), split_part(p_name, chr(32), 2), p_brand, p_type, lower(p_type)]')}, '|') AS list FROM @part")
def _(d):
    words = F.concat(F.split("p_name", " "), F.array(F.lit(" "), F.col("p_brand")), F.array(F.substring_index("p_name", " ", 1), F.col("p_type"), F.lower("p_type")))
    return d.part.select("p_partkey", F.array_join(X.distinct_texts(words), "|").alias("list"))


# ---------------------------------------------------------------- pixel hashes
# variants of a vector's hash differ in up to three scattered bits

HASHES = """SELECT vec_id, label, embedding FROM @embeddings"""


def hashes(d: Data):
    px = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1.0) * 128).cast("int"))
    rows = d.embeddings.select("vec_id", "label", px.alias("pixels")).withColumn("h", V.average_hash(F.col("pixels")))
    return rows


PIXELS = """px AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1.0) * 128) AS BIGINT)) AS p FROM embeddings),
hs AS (SELECT vec_id, label, CAST(CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE u END AS BIGINT) AS h FROM (
  SELECT vec_id, label, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN p[i] * 64 >= list_sum(p) THEN 1::HUGEINT << (64 - i)::INT ELSE 0::HUGEINT END)) AS HUGEINT) AS u FROM px))"""


@query("average_hash", f"WITH {PIXELS} SELECT vec_id, h FROM hs")
def _(d):
    return hashes(d).select("vec_id", "h")


@query("hamming_distance", f"WITH {PIXELS} SELECT a.vec_id, CAST(bit_count(xor(a.h, b.h)) AS BIGINT) AS distance FROM hs a JOIN hs b ON b.vec_id = a.vec_id + 1")
def _(d):
    h = hashes(d).select("vec_id", "h")
    other = h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("g"))
    return h.join(other, "vec_id").select("vec_id", V.hamming_distance(F.col("h"), F.col("g")).cast("bigint").alias("distance"))


def variants(d: Data):
    """Hashes of a label's pictures, four of each, with up to three bits flipped."""
    rows = hashes(d).select("vec_id", "label", "h", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    flips = F.lit(0).cast("bigint")
    for step, every in ((7, 1), (11, 2), (13, 3)):
        bit = F.expr(f"shiftleft(1L, CAST((vec_id * {step} + j * {step + 2}) % 62 AS INT))")
        flips = flips.bitwiseXOR(F.when((F.col("vec_id") + F.col("j") * F.col("j")) % 4 >= every, bit).otherwise(F.lit(0).cast("bigint")))
    return rows.select("vec_id", "label", "j", (F.col("vec_id") * 4 + F.col("j")).alias("ordinal"), F.col("h").bitwiseXOR(flips).alias("h"))


def _flip(step: int, every: int) -> str:
    return f"CASE WHEN (vec_id + j * j) % 4 >= {every} THEN (1::BIGINT << CAST((vec_id * {step} + j * {step + 2}) % 62 AS INT)) ELSE 0::BIGINT END"


VARIANTS = f"""{PIXELS}, var AS (SELECT vec_id, label, j, vec_id * 4 + j AS ordinal, xor(xor(xor(h, {_flip(7, 1)}), {_flip(11, 2)}), {_flip(13, 3)}) AS h FROM (SELECT *, unnest(range(0, 4)) AS j FROM hs))"""


def _greedy(source: str, accepted: str) -> str:
    """``walk(label, n, hit, kept)``: rows of (label, o, h, old) in the order o; a
    row of ``accepted`` or one without a near kept hash is taken."""
    return f"""seq AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY o) AS n FROM ({source})),
walk AS (
  SELECT label, CAST(0 AS BIGINT) AS n, FALSE AS taken, CAST([] AS BIGINT[]) AS kept FROM seq GROUP BY label
  UNION ALL
  SELECT label, n, taken, CASE WHEN taken THEN list_append(kept, h) ELSE kept END FROM (
    SELECT s.label, s.n, s.h, kept, {accepted} OR len(list_filter(kept, lambda k: bit_count(xor(k, s.h)) <= 2)) = 0 AS taken FROM walk w JOIN seq s ON s.label = w.label AND s.n = w.n + 1)
)"""


@query("phash_dedupe_join", f"""WITH RECURSIVE {VARIANTS}, {_greedy("SELECT label, vec_id, j, ordinal AS o, h FROM var", "FALSE")}
SELECT vec_id, CAST(j AS BIGINT) AS j FROM seq JOIN walk USING (label, n) WHERE taken""")
def _(d):
    return longs(K.keep_unlike(variants(d), "label", "ordinal", "h").select("vec_id", "j"), "j")


# old references: variant 0 of most pictures, some blank, repeated or gone; new
# files: every variant, some missing, two variants of some pictures alike
OLD_PATH = "concat('refs/', CAST(vec_id % 40 AS VARCHAR(9)), '.png')"


@query("reference_append", f"""WITH RECURSIVE {VARIANTS},
old AS (SELECT label, min(vec_id) AS pos, {OLD_PATH} AS path, arg_min(h, vec_id) AS h FROM var WHERE j = 0 AND vec_id % 3 > 0 AND vec_id % 40 < 35 GROUP BY label, {OLD_PATH}),
new AS (SELECT label, min(ordinal) AS pos, 'refs/' || label || '/' || substr(sha1('c' || vec_id || '-' || CASE WHEN vec_id % 5 = 0 THEN 0 ELSE j END), 1, 16) || '.jpg' AS path,
  arg_min(h, ordinal) AS h FROM var WHERE (vec_id + j) % 9 > 0 GROUP BY label, path),
{_greedy("SELECT label, path, h, TRUE AS old, pos AS o FROM old UNION ALL SELECT label, path, h, FALSE, 1000000000000 + pos FROM new", "s.old")}
SELECT CAST(label AS VARCHAR) AS entity_id, row_number() OVER (PARTITION BY label ORDER BY n) - 1 AS ordinal, path, NOT old AS added FROM seq JOIN walk USING (label, n) WHERE taken""")
def _(d):
    rows = variants(d).select(F.col("label").cast("string").alias("entity_id"), "vec_id", "j", "ordinal", "h")
    path = F.expr(OLD_PATH)
    raw = F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("  "), F.translate(path, "/", "\\"))).otherwise(path)
    old = rows.filter("j = 0").select("entity_id", F.col("vec_id").alias("pos"), F.when(F.col("vec_id") % 3 == 0, F.lit("  ")).otherwise(raw).alias("path"), "h")
    files = rows.select(path.alias("path")).filter(F.col("vec_id") % 40 < 35).distinct()
    content = F.concat(F.lit("c"), "vec_id", F.lit("-"), F.when(F.col("vec_id") % 5 == 0, 0).otherwise(F.col("j")))
    new = rows.select(
        "entity_id", F.col("ordinal").alias("pos"), F.lit("up/x.JPG").alias("source"), F.concat(F.lit("refs/"), "entity_id").alias("folder"),
        F.when((F.col("vec_id") + F.col("j")) % 9 > 0, F.sha1(content.cast("binary"))).alias("sha1"), "h")
    return Q.reference_append(Q.listed_references(old, files), new)
