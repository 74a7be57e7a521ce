"""Queries over texts: keys, tokens, predicates, localisation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tagloom.functions import localize as L
from tagloom.functions import text as X
from tagloom.operators import entities as N
from tagloom.plans.fixtures import SOURCE_SPELLINGS, rule
from tagloom.plans.registry import Data, query

TITLES = """
SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN concat('Genshin - ', p_name) WHEN 'LARGE' THEN concat('Blue Archive (', p_brand, ')')
  WHEN 'SMALL' THEN concat(p_name, ' | ', p_brand, ' - ', p_name) WHEN 'MEDIUM' THEN '' ELSE concat(' ZZZ ', p_name) END AS title,
  p_name, p_brand, p_type, p_size FROM @part
"""
PAIRS = """SELECT a.p_partkey, replace(a.p_name, ' ', '') AS a,
  CASE WHEN b.p_size > 25 THEN substr(b.p_name, instr(b.p_name, ' ') + 1) ELSE replace(b.p_name, ' ', '') END AS b
FROM @part a JOIN @part b ON b.p_partkey = a.p_partkey + 1"""

WS = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def ws(c: str) -> str:
    return WS.format(c)


def key(c: str) -> str:
    return rf"regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def tok_u(c: str) -> str:
    return rf"regexp_replace(replace(replace(lower({ws(c)}), '-', '_'), ' ', '_'), '[^\p{{L}}\p{{N}}_]+', '', 'g')"


def slug(c: str) -> str:
    return f"trim({tok_u(c)}, '_')"


def uniq(arr: str) -> str:
    """Distinct, non-empty values in first-seen order."""
    f = f"list_filter({arr}, lambda z: z <> '')"
    return f"list_filter({f}, lambda x, i: list_position({f}, x) = i)"


def joined(arr: str) -> str:
    return f"array_to_string({uniq(arr)}, '|')"


def bar(c):
    return F.array_join(c, "|")


@query("normalize_token", r"SELECT p_partkey, regexp_replace(replace(replace(lower(concat(' ', p_name, '-', p_type, '! ')), '-', '_'), ' ', '_'), '^_|_$|[^a-z0-9_]+', '', 'g') AS token FROM @part")
def _(d):
    raw = F.concat(F.lit(" "), "p_name", F.lit("-"), "p_type", F.lit("! "))
    return d.part.select("p_partkey", X.normalize_token(raw).alias("token"))


@query("normalize_token_unicode", f"SELECT doc_id, md5({tok_u('text')}) AS token, md5({slug('text')}) AS slug FROM @documents")
def _(d):
    c = F.col("text")
    return d.documents.select("doc_id", F.md5(X.normalize_token_unicode(c)).alias("token"), F.md5(X.slug(c)).alias("slug"))


@query("match_key", f"SELECT doc_id, md5({key('text')}) AS key FROM @documents")
def _(d):
    return d.documents.select("doc_id", F.md5(X.match_key(F.col("text"))).alias("key"))


@query("ascii_key", r"SELECT p_partkey, regexp_replace(lower(p_brand || ' & ' || p_name), '[^a-z0-9]+', '', 'g') AS key, trim(regexp_replace(lower(p_brand || ' & ' || p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM @part")
def _(d):
    raw = F.concat("p_brand", F.lit(" & "), "p_name")
    return d.part.select("p_partkey", X.ascii_key(raw).alias("key"), X.ascii_slug(raw).alias("slug"))


def _cut(c: str, tokens) -> str:
    spots = ", ".join(f"CASE WHEN instr({c}, '{t}') > 1 THEN instr({c}, '{t}') END" for t in tokens)
    spot = f"least({spots})" if len(tokens) > 1 else f"({spots})"
    return f"(CASE WHEN {spot} IS NULL THEN {c} ELSE {ws(f'substr({c}, 1, {spot} - 1)')} END)"


SPELLINGS = [(k, sorted({re.sub(r"[^\w]+", "", x.lower().replace(" ", "_").replace("-", "_")).strip("_") for x in (k, *v)})) for k, v in SOURCE_SPELLINGS.items()]
CANON_CTES = f"""t AS ({TITLES}), t1 AS (SELECT *, {_cut(ws('title'), X.TITLE_SEPARATORS)} AS c1 FROM t), t2 AS (SELECT *, {_cut('c1', ('（',))} AS c2 FROM t1),
t3 AS (SELECT *, {_cut('c2', ('(',))} AS c3 FROM t2), t4 AS (SELECT *, coalesce(nullif({slug('c3')}, ''), nullif({slug('title')}, '')) AS k FROM t3),
titles AS (SELECT p_partkey, p_name, p_brand, p_type, title, CASE WHEN k IS NULL THEN 'unknown_source' """ + " ".join(
    "WHEN " + " OR ".join(f"k = '{s}' OR starts_with(k, '{s}_')" for s in spellings) + f" THEN '{name}'" for name, spellings in SPELLINGS
) + " ELSE k END AS source_key FROM t4)"


@query("canonical_source_key", f"WITH {CANON_CTES} SELECT p_partkey, source_key FROM titles")
def _(d):
    rows = N.canonical_sources(d.sql(TITLES).select("p_partkey", "title"), "title", rule(d, "source_aliases"), "source_key")
    return rows.select("p_partkey", "source_key")


def variant_keys(c: str, seps=X.SOURCE_KEY_SEPARATORS) -> str:
    return "[" + ", ".join([key(c)] + [key(f"split_part({c}, '{s}', 1)") for s in seps]) + "]"


@query("title_variant_keys", f"WITH t AS ({TITLES}) SELECT p_partkey, {joined(variant_keys('title'))} AS keys FROM t")
def _(d):
    return d.sql(TITLES).select("p_partkey", bar(X.title_variant_keys(F.col("title"))).alias("keys"))


REV = "array_to_string(list_reverse(string_split({0}, ' ')), '{1}')"


@query("name_variant_keys", f"SELECT p_partkey, {joined('[' + key('p_name') + ', ' + key(REV.format('p_name', ' ')) + ']')} AS keys FROM @part")
def _(d):
    return d.part.select("p_partkey", bar(X.name_variant_keys(F.col("p_name"))).alias("keys"))


def dtoken(c: str) -> str:
    t = f"replace(replace(replace(lower({ws(c)}), '’', ''''), '-', '_'), ' ', '_')"
    return f"trim(regexp_replace(regexp_replace({t}, '[^0-9a-z_:'']', '_', 'g'), '_+', '_', 'g'), '_')"


NAME_TOKENS = "[" + dtoken("p_name") + ", " + dtoken(REV.format("p_name", "_")) + "]"
SOURCE_TOKENS = "[" + ", ".join([dtoken("title")] + [dtoken(f"split_part({ws('title')}, '{s}', 1)") for s in X.TOKEN_SEPARATORS]) + "]"


@query("tag_token", f"""WITH t AS ({TITLES}), x AS (SELECT p_partkey, {uniq(NAME_TOKENS)} AS n, {uniq(SOURCE_TOKENS)} AS s FROM t)
SELECT p_partkey, array_to_string(n, '|') AS name_tokens, array_to_string(s, '|') AS source_tokens,
 array_to_string(flatten(list_transform(n, lambda a: list_transform(s, lambda b: a || '_(' || b || ')'))), '|') AS tags FROM x""")
def _(d):
    n, s = F.col("p_name"), F.col("title")
    return d.sql(TITLES).select(
        "p_partkey", bar(X.name_tokens(n)).alias("name_tokens"), bar(X.source_tokens(s)).alias("source_tokens"),
        bar(X.synthesized_tags(n, s)).alias("tags"),
    )


@query("split_aliases", f"SELECT p_partkey, {joined('[p_name, p_brand, p_type, replace(p_name, chr(32), chr(45))]')} AS aliases FROM @part")
def _(d):
    raw = F.concat(
        "p_name", F.lit("／"), "p_brand", F.lit(" ,、"), "p_name", F.lit("| "), "p_type", F.lit("，"), F.translate("p_name", " ", "-"), F.lit("/")
    )
    return d.part.select("p_partkey", bar(X.split_aliases(raw)).alias("aliases"))


TOKENS_SQL = rf"""tok AS (SELECT doc_id, token, min(i) AS i FROM (
  SELECT doc_id, {ws('parts[i]')} AS token, i FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '[;；,，/、]') AS parts FROM @documents)))
  WHERE token <> '' AND NOT regexp_matches(token, '^[?？�]+$') GROUP BY doc_id, token)"""


@query("metadata_tokens", f"WITH {TOKENS_SQL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos, md5(token) AS token FROM tok")
def _(d):
    rows = d.documents.select("doc_id", F.posexplode(X.metadata_tokens(F.col("text"))).alias("pos", "token"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.md5("token").alias("token"))


PREFIXED = """SELECT p_partkey, concat(CASE p_size % 9 WHEN 0 THEN '标签： ' WHEN 1 THEN ' Tags:' WHEN 2 THEN 'タグ: ' WHEN 3 THEN '태그：' WHEN 4 THEN 'tags: ' WHEN 5 THEN 'Tags ' WHEN 6 THEN 'Tags:Tags: ' WHEN 7 THEN 'x标签：' ELSE '' END,
  p_name, CASE WHEN p_size > 25 THEN ' Tags: ' ELSE '' END) AS text FROM @part"""


@query("strip_tag_prefix", rf"SELECT p_partkey, {ws(r"regexp_replace(trim(text), '^(标签|Tags|タグ|태그)[:：]\s*', '')")} AS text FROM ({PREFIXED})")
def _(d):
    return d.sql(PREFIXED).select("p_partkey", X.strip_tag_prefix(F.col("text")).alias("text"))


SEARCH_TEXT = r"regexp_replace(regexp_replace(lower({0}), '[_\-\s]+', '', 'g'), '[^\p{{L}}\p{{N}}\x{{4E00}}-\x{{9FFF}}\x{{3040}}-\x{{30FF}}\x{{AC00}}-\x{{D7AF}}]+', '', 'g')"


@query("library_search_text", f"SELECT doc_id, md5({SEARCH_TEXT.format('text')}) AS text FROM @documents")
def _(d):
    return d.documents.select("doc_id", F.md5(X.library_search_text(F.col("text"))).alias("text"))


@query("humanize_id", """SELECT p_partkey, array_to_string(list_transform(string_split(replace(lower(p_brand), '#', '-#') || ' ' || p_name, ' '),
 lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM (SELECT p_partkey, p_name, p_type AS p_brand FROM @part)""")
def _(d):
    raw = F.concat(F.lower("p_type"), F.lit("__"), F.translate("p_name", " ", "-"), F.lit(" "))
    return d.part.select("p_partkey", X.humanize_id(raw).alias("name"))


@query("localized_name", """SELECT p_partkey, CASE WHEN p_size > 40 THEN p_brand WHEN p_type = 'PROMO' THEN concat(p_name, '-ja') WHEN p_size >= 15 THEN p_name ELSE 'Long Hair' END AS ja,
 CASE WHEN p_type = 'SMALL' THEN p_brand WHEN p_type = 'LARGE' THEN concat(p_name, '-zh') WHEN p_size >= 15 THEN p_name ELSE 'Long Hair' END AS zh FROM @part""")
def _(d):
    names = F.create_map(
        F.lit("ja_JP"), F.when(F.col("p_size") > 40, F.col("p_brand")).otherwise(" "),
        F.lit("zh"), F.when(F.col("p_type") == "SMALL", F.col("p_brand")).otherwise(""),
    )
    fields = {
        "name_ja": F.when(F.col("p_type") == "PROMO", F.concat("p_name", F.lit("-ja"))),
        "name_en": F.when(F.col("p_size") >= 15, F.col("p_name")),
        "name_zh": F.when(F.col("p_type") == "LARGE", F.concat("p_name", F.lit("-zh"))).otherwise(" "),
    }
    tag = F.lit("long_hair")
    return d.part.select(
        "p_partkey", L.localized_name(names, fields, tag, "ja-JP").alias("ja"), L.localized_name(names, fields, tag, "zh-CN").alias("zh")
    )


NAMED = """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS shown, CASE WHEN p_size > 30 THEN concat(p_brand, '-j') ELSE '' END AS ja, CASE WHEN p_size % 5 = 0 THEN concat(p_type, '-k') ELSE '' END AS ko,
  CASE WHEN p_type = 'PROMO' THEN concat('中', p_name) ELSE '' END AS zh, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS en FROM @part"""


@query("localized_alias", f"""SELECT p_partkey, coalesce(zh, en, ja, ko, '') AS zh, coalesce(ja, en, ko, zh, '') AS ja, coalesce(ko, ja, en, zh, '') AS editor_ko
 FROM (SELECT p_partkey, nullif(zh, '') AS zh, nullif(ja, '') AS ja, nullif(ko, '') AS ko, coalesce(nullif(shown, ''), nullif(en, '')) AS en FROM ({NAMED}))""")
def _(d):
    entry = lambda n, lang: F.struct(F.col(n).alias("name"), F.lit(lang).alias("language"))
    entries = F.array(entry("ko", "ko_KR"), entry("ja", "ja"), entry("zh", ""), entry("en", "en-US"))
    alias = lambda lang, **how: L.localized_alias(F.col("shown"), entries, lang, **how)
    return d.sql(NAMED).select("p_partkey", alias("zh-CN").alias("zh"), alias("ja-JP").alias("ja"), alias("ko-KR", editor=True).alias("editor_ko"))


@query("language_code", """SELECT doc_id, CASE lang WHEN 'zh' THEN 'zh-CN' WHEN 'en' THEN 'en-US' WHEN 'ja' THEN 'ja-JP' WHEN 'ko' THEN 'ko-KR' ELSE 'zh-CN' END AS exact,
 CASE WHEN lang IN ('en', 'ja', 'ko', 'zh') THEN CASE lang WHEN 'zh' THEN 'zh-CN' WHEN 'en' THEN 'en-US' WHEN 'ja' THEN 'ja-JP' ELSE 'ko-KR' END ELSE 'en-US' END AS by_prefix FROM @documents""")
def _(d):
    return d.documents.select(
        "doc_id", L.language_code(F.upper("lang")).alias("exact"), L.language_code_by_prefix(F.concat("lang", F.lit("-XX")), "en-US").alias("by_prefix")
    )


OVERLAP = "CASE WHEN a = '' OR b = '' THEN 0 WHEN contains(b, a) THEN len(a) WHEN contains(a, b) THEN len(b) ELSE 0 END"


@query("substring_overlap", f"WITH p AS ({PAIRS}) SELECT p_partkey, CAST({OVERLAP} AS BIGINT) AS overlap, CAST(CASE WHEN a = '' THEN 0 ELSE 4 END AS BIGINT) AS needed, {OVERLAP} >= 2 AS meaningful FROM p")
def _(d):
    a, b = F.col("a"), F.col("b")
    return d.sql(PAIRS).select(
        "p_partkey", X.substring_overlap(a, b).cast("bigint").alias("overlap"), X.minimum_match_length(a).cast("bigint").alias("needed"),
        X.meaningful_match(a, b).alias("meaningful"),
    )


LCS = "list_max(flatten(list_transform(range(1, len(a) + 1), lambda i: list_transform(range(1, len(a) - i + 2), lambda n: CASE WHEN contains(b, substr(a, i, n)) THEN n ELSE 0 END))))"


@query("lcs_len", f"WITH p AS ({PAIRS}) SELECT p_partkey, CAST({LCS} AS BIGINT) AS n FROM p")
def _(d):
    return d.sql(PAIRS).select("p_partkey", X.lcs_len(F.col("a"), F.col("b")).cast("bigint").alias("n"))


@query("name_variant_predicate", f"WITH p AS ({PAIRS}) SELECT p_partkey, contains(a, b) OR contains(b, a) AS variant, p_partkey % 3 = 0 OR contains(a, b) OR contains(b, a) AS foreign_variant FROM p")
def _(d):
    a, b = F.col("a"), F.col("b")
    ending = F.when(F.col("p_partkey") % 3 == 0, "空").otherwise("!")
    return d.sql(PAIRS).select(
        "p_partkey", X.name_variant_predicate(F.upper(b), F.array(a)).alias("variant"),
        X.name_variant_predicate(F.concat(b, ending), F.array(a)).alias("foreign_variant"),
    )


@query("alias_pipe", f"SELECT p_partkey, {joined('[p_name, p_brand, p_type]')} AS aliases FROM @part")
def _(d):
    c = F.array(F.col("p_name"), F.concat(F.lit(" "), "p_brand"), F.lit(" "), F.col("p_name"), F.col("p_type"))
    return d.part.select("p_partkey", X.alias_pipe(c).alias("aliases"))


@query("release_date", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS released,
 strftime(o_orderdate, '%Y-%m-%d') AS prefix FROM @orders""")
def _(d):
    day = F.date_format("o_orderdate", "MMMM dd, yyyy")
    text = F.when(F.col("o_orderstatus") == "P", F.lit("to be announced")).otherwise(F.concat(F.lit("Released "), day, F.lit(" (1.0)")))
    return d.orders.select(
        "o_orderkey", X.release_date(text).alias("released"), X.date_prefix(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("prefix")
    )


@query("rarity_map", """SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN '5' WHEN 'LARGE' THEN '5' WHEN 'SMALL' THEN '4' ELSE '' END AS star,
 CASE p_size WHEN 4 THEN 'S' WHEN 3 THEN 'A' WHEN 2 THEN 'B' ELSE CAST(p_size AS VARCHAR) END AS grade FROM @part""")
def _(d):
    rank = F.when(F.col("p_type") == "PROMO", "QUALITY_ORANGE").when(F.col("p_type") == "LARGE", "QUALITY_ORANGE_SP").when(
        F.col("p_type") == "SMALL", "QUALITY_PURPLE").otherwise(F.col("p_type"))
    return d.part.select("p_partkey", X.star_rarity(rank).alias("star"), X.grade_rarity(F.col("p_size")).alias("grade"))


@query("path_key", r"SELECT page_id, lower(url) AS absolute, lower('/root/' || regexp_replace(url, '^[a-z]+://', '')) AS relative FROM @pages")
def _(d):
    back = F.translate(F.regexp_replace("url", "^[a-z]+://", ""), "/", "\\")
    return d.pages.select("page_id", X.path_key(F.col("url")).alias("absolute"), X.path_key(back, "/root/").alias("relative"))


MEDIA = r"SELECT page_id, regexp_replace(url, '(/[0-9]+)', '\\1/revision/latest/scale-to-width-down/300') AS url FROM @pages"


@query("url_variants", rf"""WITH m AS ({MEDIA.replace(chr(92) * 2, chr(92))}), x AS (SELECT *, regexp_matches(url, '^[a-z]+://[^/?#]*example\.com[/?#]') AS hosted,
  regexp_extract(url, '^([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*(.*)$', 1) AS rest, regexp_extract(url, '(#.*)$', 1) AS frag FROM m)
SELECT page_id, {joined("[url, CASE WHEN hosted THEN replace(path, '/revision/latest/scale-to-width-down/300', '/revision/latest') || rest ELSE url END, CASE WHEN hosted AND contains(path, '/revision/latest') THEN regexp_replace(path, '/revision/latest.*$', '') || rest ELSE url END, CASE WHEN hosted AND contains(path, '/revision/latest') THEN regexp_replace(path, '/revision/latest.*$', '') || frag ELSE url END, CASE WHEN starts_with(rest, '?') THEN path || frag ELSE url END]")} AS urls FROM x""")
def _(d):
    url = F.regexp_replace("url", r"^(\D*?(?:/\D*?)*)(/[0-9]+)", "$1$2/revision/latest/scale-to-width-down/300")
    return d.pages.select("page_id", bar(X.url_variants(url, "example.com")).alias("urls"))


@query("url_or_domain_predicate", r"""WITH u AS (SELECT page_id, url, regexp_replace(url, '^[a-z]+://', '') AS bare, replace(regexp_replace(url, '^[a-z]+://', ''), '.', ' ') AS words FROM @pages)
SELECT page_id, TRUE AS full_url, regexp_matches(regexp_extract(bare, '^([^/?#:]*)', 1), '^[a-z0-9-]+(\.[a-z0-9-]+)+$') AS bare, FALSE AS words FROM u""")
def _(d):
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    return d.pages.select(
        "page_id", X.looks_like_url(F.col("url")).alias("full_url"), X.looks_like_url(bare).alias("bare"),
        X.looks_like_url(F.translate(bare, ".", " ")).alias("words"),
    )


HAN = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}"
HANG = r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}"
KANA = r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{FF66}-\x{FF9D}"


@query("script_predicates", rf"""WITH x AS (SELECT doc_id, text, regexp_extract(text, '[{HAN}{HANG}{KANA}]') AS m FROM @documents)
SELECT doc_id, regexp_matches(text, '[{HAN}]') AND NOT regexp_matches(text, '[\x{{3040}}-\x{{30FF}}]') AS han_query,
 regexp_replace(regexp_replace(text, '[^\p{{L}}]', '', 'g'), '[A-Za-z]', '', 'g') <> '' AS non_ascii,
 CASE WHEN regexp_matches(m, '[{HANG}]') THEN 'ko-KR' WHEN regexp_matches(m, '[{KANA}]') THEN 'ja-JP' WHEN m <> '' THEN 'zh-CN' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en-US' ELSE 'zh-CN' END AS language FROM x""")
def _(d):
    c = F.col("text")
    return d.documents.select(
        "doc_id", X.is_han_query(c).alias("han_query"), X.has_non_ascii_letters(c).alias("non_ascii"), X.infer_language(c).alias("language")
    )


TOKENS = "SELECT doc_id, translate(substr(text, CAST(1 + doc_id % 40 AS INT), CAST(doc_id % 4 AS INT)), 'aeiou', '?？�??') AS token FROM @documents"


@query("malformed_token_predicate", rf"SELECT doc_id, regexp_matches({ws('token')}, '^[?？\x{{FFFD}}]*$') AS malformed FROM ({TOKENS})")
def _(d):
    return d.sql(TOKENS).select("doc_id", X.is_malformed_token(F.col("token")).alias("malformed"))

