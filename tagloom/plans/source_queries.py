"""Queries over sources and sinks: files, JSON, CSV, payloads, HTML, rosters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import localize as L
from tagloom.functions import text as X
from tagloom.plans.registry import Data, query
from tagloom.plans.text_queries import key, uniq
from tagloom.session import work_folder
from tagloom.sources import files as S
from tagloom.sources import payloads as P
from tagloom.sources import tables as B

NOW = "2024-01-01T00:00:00"


def longs(df, *names):
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in names else c for c in df.columns])


@query("scan_media", r"""SELECT regexp_extract(url, '([^/]+)$', 1) AS file, lower(replace(url, '\', '/')) AS key, strlen(html) AS length
 FROM @pages WHERE regexp_matches(lower(url), '[^/\\.][^/\\]*\.(html|org)$')""")
def _(d):
    rows = S.media_paths(d.pages.select(F.col("url").alias("path"), F.octet_length("html").cast("bigint").alias("length")), (".html", ".org"))
    return rows.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), X.path_key(F.col("path")).alias("key"), "length")


@query("scan_path_list", r"SELECT arg_min(url, page_id) AS path FROM @pages WHERE regexp_matches(lower(url), '[^/\\.][^/\\]*\.(html|org)$') GROUP BY lower(url)")
def _(d):
    lines = d.pages.select(F.col("page_id").alias("line_no"), F.concat(F.lit(" "), "url").alias("value"))
    blanks = d.pages.select(F.col("page_id").alias("line_no"), F.lit("  ").alias("value"))
    upper = d.pages.select((F.col("page_id") + (1 << 40)).alias("line_no"), F.upper("url").alias("value"))
    return S.scan_path_list(lines.unionByName(blanks).unionByName(upper), (".html", ".org"))


@query("content_sha1_id", "SELECT doc_id, sha1(text) AS id FROM @documents")
def _(d):
    return d.documents.select("doc_id", S.content_id(F.col("text").cast("binary")).alias("id"))


@query("pending_queue", f"SELECT sha1(text) AS image_id, source || '/' || doc_id || '.jpg' AS image_path, '' AS labels, TRUE AS review_required, 'pending' AS status, '{NOW}' AS created_at FROM @documents")
def _(d):
    images = d.documents.select(S.content_id(F.col("text").cast("binary")).alias("image_id"), F.concat("source", F.lit("/"), "doc_id", F.lit(".jpg")).alias("image_path"))
    rows = S.pending_queue(images, NOW)
    labels = F.array_join(F.concat("characters", "feature_tags", "source_game"), "|")
    return rows.select("image_id", "image_path", labels.alias("labels"), "review_required", "status", "created_at")


@query("jsonl_sink", "SELECT doc_id, md5(text) AS text, source, (SELECT count(*) FROM @documents) AS written FROM @documents")
def _(d):
    path = work_folder(d.spark, "jsonl")
    written = S.write_jsonl(d.documents.select("doc_id", "text", "source"), path)
    rows = S.read_jsonl(d.spark, path, "doc_id BIGINT, text STRING, source STRING", strict=True)
    return rows.select("doc_id", F.md5("text").alias("text"), "source", F.lit(written).cast("bigint").alias("written"))


@query("jsonl_source", "SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM @events WHERE event_type NOT IN ('error', 'signup', 'view')")
def _(d):
    t = F.col("event_type")
    line = (
        F.when(t == "error", F.substring("props", 1, 5)).when(t == "signup", F.concat(F.lit("["), "props", F.lit("]"))).when(t == "view", F.lit("  "))
        .otherwise(F.concat(F.lit(" "), "props"))
    )
    return S.parse_json_lines(d.events.select("event_id", line.alias("line")), "line", "k BIGINT")


@query("library_source", f"""SELECT p_partkey, p_name AS id, {uniq("[p_brand || ':' || 'en-US', p_name || ':' || 'ja-JP']")}[1] AS first_alias, CAST(2 AS BIGINT) AS alias_count, 'manual:' || p_type AS link FROM @part WHERE p_size <= 40""")
def _(d):
    record = F.struct(
        F.col("p_name").alias("id"), F.col("p_brand").alias("display_name"), F.array(F.struct(F.col("p_name").alias("name"), F.lit("ja").alias("language"))).alias("aliases"),
        F.lit("").alias("provider"), F.col("p_type").alias("provider_entity_id"),
    )
    text = F.to_json(F.array(record))
    broken = F.when(F.col("p_size") > 45, F.substring(text, 1, 20)).when(F.col("p_size") > 40, F.to_json(record)).otherwise(text)
    rows = B.library_records(d.part.select("p_partkey", broken.alias("body")))
    entries, links = F.col("aliases"), F.col("provider_links")
    show = lambda e: F.concat_ws(":", e["name"], e["language"])
    return rows.select(
        "p_partkey", "id", show(F.get(entries, F.lit(0))).alias("first_alias"), F.size(entries).cast("bigint").alias("alias_count"),
        F.concat_ws(":", F.get(links, F.lit(0))["provider"], F.get(links, F.lit(0))["provider_entity_id"]).alias("link"),
    )


@query("vocab_source", "SELECT replace(p_name, ' ', '_') AS name, max(p_partkey) AS last_pos, min(p_partkey) AS first_pos FROM @part GROUP BY 1")
def _(d):
    path = work_folder(d.spark, "vocab")
    S.write_csv(d.part.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.col("p_type").alias("category")), path)
    vocab = S.read_vocab(d.spark, path)
    name = X.normalize_token(F.col("name"))
    last, first = S.vocab_positions(vocab, name), S.vocab_positions(vocab, name, last_wins=False)
    rows = last.withColumnRenamed("pos", "last_pos").join(first.withColumnRenamed("pos", "first_pos"), "name")
    return longs(rows, "last_pos", "first_pos")


@query("csv_sink", "SELECT p_partkey, p_name, p_brand, (SELECT count(*) FROM @part) AS written FROM @part")
def _(d):
    path = work_folder(d.spark, "csv")
    written = S.write_csv(d.part.select("p_partkey", "p_name", "p_brand"), path)
    rows = d.spark.read.schema("p_partkey BIGINT, p_name STRING, p_brand STRING").option("header", True).csv(path)
    return rows.withColumn("written", F.lit(written).cast("bigint"))


@query("vector_table", "SELECT vec_id AS row_index, CAST(label AS VARCHAR) AS character_id, CAST(len(embedding) AS BIGINT) AS dimension, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM @embeddings")
def _(d):
    path = work_folder(d.spark, "vectors")
    B.write_vector_table(d.embeddings.select(F.col("vec_id").alias("row_index"), F.col("label").cast("string").alias("character_id"), "embedding"), path, "scores", NOW)
    rows = B.read_vector_table(d.spark, path, strict_dimension=True)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("row_index", "character_id", F.size("embedding").cast("bigint").alias("dimension"), F.round(total, 4).alias("total"))


@query("metadata_source", f"""SELECT 'd/' || doc_id || '.jpg' AS key, CASE lang WHEN 'en' THEN source || '|x' WHEN 'fr' THEN source WHEN 'de' THEN 'a|' || source ELSE source || '|y' END AS tokens FROM @documents WHERE n_chars > 100""")
def _(d):
    # one payload per file, the fields filled in different ways by language
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    field = (
        F.when(F.col("lang") == "en", F.concat(F.lit('"Subject": ['), q(F.col("source")), F.lit(', "x", "??"], "XPKeywords": "no"')))
        .when(F.col("lang") == "fr", F.concat(F.lit('"Keywords": '), q(F.col("source"))))
        .when(F.col("lang") == "de", F.concat(F.lit('"Subject": "a; ", "Keywords": '), q(F.concat(F.lit("a；"), "source"))))
        .otherwise(F.concat(F.lit('"Subject": " ", "XPKeywords": '), q(F.concat("source", F.lit("; y")))))
    )
    named = F.when(F.col("n_chars") > 1000, F.concat(F.lit('"SourceFile": "D/'), "doc_id", F.lit('.jpg", '))).otherwise(F.lit('"SourceFile": "elsewhere.jpg", '))
    body = F.when(F.col("n_chars") > 100, F.concat(F.lit("{"), named, field, F.lit("}"))).otherwise(F.lit("{broken"))
    rows = d.documents.select(F.floor(F.col("doc_id") / 60).alias("batch"), F.col("doc_id").alias("batch_pos"), body.alias("payload"))
    chosen = d.documents.select(F.floor(F.col("doc_id") / 60).alias("batch"), F.col("doc_id").alias("batch_pos"), F.concat(F.lit("d\\"), "doc_id", F.lit(".jpg")).alias("path"))
    return B.metadata_source(rows, chosen).select("key", F.array_join("tokens", "|").alias("tokens"))


# ------------------------------------------------------------------- payloads
# every part row lands one response page that lists it twice, with decoration


def flat(rows):
    place = F.col("ordinal").cast("bigint").bitwiseAND(F.lit((1 << P.PAGE_BITS) - 1)).alias("ordinal")
    return longs(rows.select("request_id", place, "provider", "provider_entity_id", "display_name", "source_title", "avatar_url", F.array_join("aliases", "|").alias("aliases")), "ordinal")


@query("provider_payload_anilist", """SELECT p_partkey AS request_id, CAST(o AS BIGINT) AS ordinal, 'anilist' AS provider, CAST(p_partkey AS VARCHAR) AS provider_entity_id, CASE o WHEN 1 THEN p_name ELSE p_brand END AS display_name,
 CASE WHEN o = 2 THEN '' WHEN p_size > 25 THEN p_type ELSE p_brand END AS source_title, CASE o WHEN 1 THEN 'm/' || p_type ELSE '' END AS avatar_url,
 CASE o WHEN 1 THEN p_name || '|' || p_brand || '|' || split_part(p_name, ' ', 2) || '|' || p_name || '空' ELSE p_brand END AS aliases FROM @part, (SELECT unnest([1, 2]) AS o)""")
def _(d):
    title = F.struct(F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(" ").alias("english"), F.col("p_brand").alias("romaji"))
    nick = F.array(F.substring_index("p_name", " ", -1), F.lit("unrelated"), F.concat("p_name", F.lit("空")), F.col("p_name"))
    one = F.struct(
        F.col("p_partkey").alias("id"), F.struct(F.col("p_name").alias("full"), F.col("p_brand").alias("native"), nick.alias("alternative")).alias("name"),
        F.struct(F.array(F.struct(title.alias("title"))).alias("nodes")).alias("media"), F.struct(F.lit("").alias("large"), F.concat(F.lit("m/"), "p_type").alias("medium")).alias("image"),
    )
    two = F.struct(F.col("p_partkey").alias("id"), F.struct(F.lit("").alias("full"), F.concat("p_brand", F.lit(" ")).alias("native"), F.lit("zz").alias("alternativeSpoiler")).alias("name"))
    bare = F.struct(F.col("p_partkey").alias("id"), F.struct(F.lit(" ").alias("full")).alias("name"))
    body = F.concat(F.lit('{"data":{"Page":{"characters":['), F.to_json(one), F.lit(","), F.to_json(one), F.lit(","), F.to_json(bare), F.lit(","), F.to_json(two), F.lit("]}}}"))
    return flat(P.people_payload(d.part.select(F.col("p_partkey").alias("request_id"), F.lit(1).alias("page"), body.alias("body"))))


@query("provider_payload_media", """SELECT s_suppkey AS request_id, CAST(o AS BIGINT) AS ordinal, 'anilist' AS provider, s_suppkey || '-' || o AS provider_entity_id, s_name || CASE o WHEN 1 THEN '' ELSE '!' END AS display_name, n_name AS source_title,
 '' AS avatar_url, s_name || CASE o WHEN 1 THEN '' ELSE '!' END AS aliases FROM @supplier JOIN @nation ON n_nationkey = s_nationkey, (SELECT unnest([1, 2]) AS o)""")
def _(d):
    node = lambda n, suffix: F.struct(F.struct(
        F.concat_ws("-", "s_suppkey", F.lit(n)).alias("id"), F.struct(F.concat("s_name", F.lit(suffix)).alias("userPreferred")).alias("name")).alias("node"))
    media = F.struct(F.struct(F.col("n_name").alias("native")).alias("title"), F.struct(F.array(node(1, ""), node(1, ""), node(2, "!"), node(3, "?")).alias("edges")).alias("characters"))
    body = F.concat(F.lit('{"data":{"Page":{"media":['), F.to_json(media), F.lit("]}}}"))
    rows = d.supplier.join(d.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    return flat(P.media_payload(rows.select(F.col("s_suppkey").alias("request_id"), F.lit(1).alias("page"), body.alias("body")), 2))


def infobox_body():
    box = F.concat(
        F.lit('[{"key":"简体中文名","value":"'), "p_name", F.lit('"},{"key":"别名","value":[{"v":"'), "p_type", F.lit('"},{"k":"罗马字","v":"'), "p_brand",
        F.lit('／'), "p_name", F.lit('"},"plain"]},{"key":"出处","value":["https://x.org/a", {"v":"'), F.concat("p_brand", F.lit(" work")), F.lit('"}]},{"key":"生日","value":"1"}]'),
    )
    return F.when(F.col("p_size") > 10, box).otherwise(F.lit("null"))


ALIASES = f"array_to_string({uniq('[p_brand, p_name, p_type, chr(112) || chr(108) || chr(97) || chr(105) || chr(110)]')}, '|')"


@query("provider_payload_bangumi", f"""SELECT p_partkey AS request_id, CAST(1 AS BIGINT) AS ordinal, 'bangumi' AS provider, CAST(p_partkey AS VARCHAR) AS provider_entity_id, p_brand AS display_name, CASE WHEN p_size > 10 THEN p_brand || ' work' ELSE '' END AS source_title,
 's/' || p_type AS avatar_url, CASE WHEN p_size > 10 THEN {ALIASES} ELSE p_brand END AS aliases FROM @part""")
def _(d):
    item = F.concat(F.lit('{"id":'), "p_partkey", F.lit(',"name":"'), "p_brand", F.lit('","images":{"large":"","small":"s/'), "p_type", F.lit('"},"infobox":'), infobox_body(), F.lit("}"))
    body = F.concat(F.lit('{"data":['), item, F.lit(","), item, F.lit(',{"id":1,"name":" "}]}'))
    return flat(P.entry_payload(d.part.select(F.col("p_partkey").alias("request_id"), F.lit(1).alias("page"), body.alias("body"))))


BOX = "ARRAY<STRUCT<key:STRING,value:STRING>>"


@query("infobox_source_title", "SELECT p_partkey, CASE WHEN p_size > 10 THEN p_brand || ' work' ELSE '' END AS title FROM @part")
def _(d):
    return d.part.select("p_partkey", P.infobox_source_title(F.from_json(infobox_body(), BOX)).alias("title"))


@query("infobox_aliases", f"SELECT p_partkey, CASE WHEN p_size > 10 THEN {ALIASES} ELSE p_brand END AS aliases FROM @part")
def _(d):
    return d.part.select("p_partkey", F.array_join(P.infobox_aliases(F.col("p_brand"), F.from_json(infobox_body(), BOX)), "|").alias("aliases"))


@query("provider_payload_subjects", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS w FROM @part WHERE {key('p_type')} = 'promo'),
x AS (SELECT p_brand, p_name, w, p_type, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY w) AS rn FROM r WHERE w <= 3)
SELECT p_brand AS request_id, row_number() OVER (PARTITION BY p_brand ORDER BY w) AS ordinal, 'bangumi' AS provider, p_name AS provider_entity_id, upper(p_name) AS display_name, p_type AS source_title, '' AS avatar_url, upper(p_name) AS aliases FROM x WHERE rn = 1""")
def _(d):
    person = F.struct(F.col("p_name").alias("id"), F.upper("p_name").alias("name"))
    work = F.struct(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.col("p_type").alias("name_cn"), F.array(person, person, F.struct(F.lit("").alias("id"), F.lit("x").alias("name"))).alias("characters"))
    landed = d.part.select(F.col("p_brand").alias("request_id"), F.col("p_partkey").alias("page"), F.concat(F.lit('{"data":['), F.to_json(work), F.lit("]}")).alias("body"))
    requests = d.part.select(F.col("p_brand").alias("request_id")).distinct().withColumn("query", F.lit("pro-mo"))
    return flat(P.subject_payload(landed, requests, 20))


@query("provider_payload_jikan", """SELECT p_partkey AS request_id, CAST(1 AS BIGINT) AS ordinal, 'jikan' AS provider, CAST(p_partkey AS VARCHAR) AS provider_entity_id, p_name AS display_name, 'MyAnimeList' AS source_title, 'j/' || p_brand AS avatar_url,
 CASE WHEN p_size > 25 THEN p_name || '|' || split_part(p_name, ' ', 1) ELSE p_name || '|' || p_name || '２空' END AS aliases FROM @part""")
def _(d):
    nick = F.when(F.col("p_size") > 25, F.concat(F.lit('["'), F.substring_index("p_name", " ", 1), F.lit('","nope"]'))).otherwise(F.concat(F.lit('"'), "p_name", F.lit('２空"')))
    item = F.concat(F.lit('{"mal_id":'), "p_partkey", F.lit(',"name":"'), "p_name", F.lit('","nicknames":'), nick, F.lit(',"images":{"jpg":{"image_url":"j/'), "p_brand", F.lit('"}}}'))
    body = F.concat(F.lit('{"data":['), item, F.lit(","), item, F.lit("]}"))
    return flat(P.list_payload(d.part.select(F.col("p_partkey").alias("request_id"), F.lit(1).alias("page"), body.alias("body"))))


# ---------------------------------------------------------------- html, roster


def table_pages(d: Data):
    """One page per supplier whose first table has a header and one roster row."""
    row = F.concat(
        F.lit("<html><p>x</p><table class='a'><tr><th>No</th><th>Name</th></tr>\n<tr><td>1</td><td> <b>"), "s_name", F.lit("</b>\n &amp; Co</td><td>r</td><td>E"), "s_nationkey",
        F.lit("</td><td>W</td><td>T</td><td>F</td><td>Released "), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("s_nationkey")), "MMMM dd, yyyy"), F.lit("<sup>1</sup></td></tr></table><table><tr><td>no</td></tr></table></html>"),
    )
    return d.supplier.select("s_suppkey", row.alias("html"))


@query("html_first_table", """SELECT s_suppkey, CAST(0 AS BIGINT) AS row_no, 'No|Name' AS cells FROM @supplier UNION ALL SELECT s_suppkey, 1, '1|' || s_name || ' & Co|r|E' || s_nationkey || '|W|T|F|Released ' || strftime(date '2020-01-01' + s_nationkey, '%B %d, %Y') || ' 1' FROM @supplier""")
def _(d):
    rows = P.html_first_table(table_pages(d), "s_suppkey", "html")
    return longs(rows.select("s_suppkey", "row_no", F.array_join("cells", "|").alias("cells")), "row_no")


@query("html_embedded_json", r"""SELECT page_id, url, CAST(0 AS BIGINT) AS pos, 'T&' || page_id AS title FROM @pages""")
def _(d):
    ok = F.concat(F.lit("{&quot;murl&quot;:&quot;"), "url", F.lit("&quot;,&quot;t&quot;:&quot;T&amp;"), "page_id", F.lit("&quot;}"))
    html = F.concat("html", F.lit('<a class="iusc" style="x" m="'), ok, F.lit('"></a><a class="iusc" m="{bad"></a><a class="iusc" m="[1]"></a><a class="iusc" m="{&quot;murl&quot;:&quot;ftp://x&quot;}"></a>'))
    rows = P.html_embedded_json(d.pages.select("page_id", html.alias("html")), ["page_id"], "html", r'class="iusc"[^>]*\sm="([^"]+)"', "murl STRING, t STRING", "murl")
    return longs(rows.select("page_id", "url", "pos", F.col("o.t").alias("title")), "pos")


def roster_landed(d: Data):
    entry = F.struct(
        F.col("p_name").alias("EN"), F.col("p_brand").alias("CHS"), F.concat_ws("-", "p_type", "p_size").alias("code"), (F.col("p_size") % 6).alias("rank"),
        F.date_format(F.lit("2021-05-06").cast("date"), "yyyy-MM-dd'T'HH:mm").alias("release"),
    )
    body = F.to_json(F.create_map(F.col("p_partkey").cast("string"), entry))
    return d.part.select("p_partkey", body.alias("body"))


@query("roster_api_source", """SELECT k AS key, arg_max(p_partkey, p_partkey) AS ordinal, arg_max(p_brand, p_partkey) AS chs FROM (SELECT replace(p_name, ' ', '') AS k, p_partkey, p_brand FROM @part UNION ALL SELECT lower(p_type) || p_size, p_partkey, p_brand FROM @part) GROUP BY k""")
def _(d):
    entries = P.roster_entries(roster_landed(d))
    index = P.roster_index(entries, F.col("p_partkey"))
    return index.select("key", "ordinal", F.col("entry.CHS").alias("chs"))


@query("roster_build", """WITH idx AS (SELECT k, arg_max(p_name, p_partkey) AS en, arg_max(p_brand, p_partkey) AS chs, arg_max(p_type || '-' || p_size, p_partkey) AS code, arg_max(p_size % 6, p_partkey) AS rk FROM (
  SELECT replace(p_name, ' ', '') AS k, * FROM @part UNION ALL SELECT lower(p_type) || p_size, * FROM @part) GROUP BY k),
r AS (SELECT p_partkey, CASE WHEN p_size > 40 THEN p_name WHEN p_size > 30 THEN 'Mx ' || p_type || p_size WHEN p_size > 20 THEN p_type || p_size || ' Zed' WHEN p_size > 10 THEN 'Nick' ELSE 'Nobody Known' END AS n, p_size FROM @part)
SELECT p_partkey, 'g_' || replace(lower(n), ' ', '_') AS id, coalesce(chs, '') AS canonical_name_zh, n AS canonical_name_en, CASE WHEN en IS NULL THEN n WHEN n = en THEN n || '|' || code ELSE n || '|' || en || '|' || code END AS aliases,
 CASE WHEN en IS NULL THEN '' ELSE CASE rk WHEN 4 THEN 'S' WHEN 3 THEN 'A' WHEN 2 THEN 'B' ELSE CAST(rk AS VARCHAR) END END AS rarity, '2022-03-04' AS release_date
FROM r LEFT JOIN idx ON idx.k = CASE WHEN p_size > 40 THEN replace(lower(n), ' ', '') WHEN p_size > 30 THEN replace(replace(lower(n), 'mx ', ''), ' ', '') WHEN p_size > 20 THEN replace(lower(n), ' zed', '') WHEN p_size > 10 THEN 'redring' END""")
def _(d):
    size, code = F.col("p_size"), F.concat("p_type", "p_size")
    name = (
        F.when(size > 40, F.col("p_name")).when(size > 30, F.concat(F.lit("Mx "), code)).when(size > 20, F.concat(code, F.lit(" Zed")))
        .when(size > 10, "Nick").otherwise("Nobody Known")
    )
    cells = F.array(F.lit("1"), name, *[F.lit(c) for c in "abcde"], F.lit("on March 04, 2022."))
    rows = d.part.select("p_partkey", F.lit(1).alias("row_no"), cells.alias("cells"))
    index = P.roster_index(P.roster_entries(roster_landed(d)), F.col("p_partkey"))
    out = P.roster_build(rows, "p_partkey", index, "g", "game_b", {"Nick": "Red Ring"}, graded=True)
    return out.select("p_partkey", "id", "canonical_name_zh", "canonical_name_en", "aliases", "rarity", "release_date")
