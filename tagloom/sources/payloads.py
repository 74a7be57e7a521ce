"""Landed provider payloads (JSON, HTML) to flat candidate tables.

``landed(request_id, page, body)``; the output has ``request_id``, ``ordinal``
and the candidate columns. One body is one response page, so the arrays walked
here are no longer than a page; requests spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.functions.localize import first_entries
from tagloom.operators.entities import coalescing_lookup
from tagloom.operators.ranking import first_per_key
from tagloom.operators.search import top_n
from tagloom.session import dealt

PERSON = (
    "id STRING, name STRUCT<full:STRING,native:STRING,userPreferred:STRING,alternative:STRING,alternativeSpoiler:STRING>,"
    " image STRUCT<large:STRING,medium:STRING>"
)
TITLE = "title:STRUCT<english:STRING,romaji:STRING,native:STRING>"
PEOPLE_PAGE = (
    "data STRUCT<Page:STRUCT<characters:ARRAY<STRUCT<" + PERSON.replace(" STRING", ":STRING").replace(" STRUCT", ":STRUCT")
    + f",media:STRUCT<nodes:ARRAY<STRUCT<{TITLE}>>>>>>>"
)
MEDIA_PAGE = (
    f"data STRUCT<Page:STRUCT<media:ARRAY<STRUCT<{TITLE},characters:STRUCT<edges:ARRAY<STRUCT<node:STRUCT<"
    + PERSON.replace(" STRING", ":STRING").replace(" STRUCT", ":STRUCT") + ">>>>>>>>"
)
IMAGES = "STRUCT<large:STRING,medium:STRING,small:STRING,grid:STRING>"
ENTRY_PAGE = f"data ARRAY<STRUCT<id:STRING,name:STRING,name_cn:STRING,images:{IMAGES},infobox:ARRAY<STRUCT<key:STRING,value:STRING>>>>"
LIST_PAGE = "data ARRAY<STRUCT<mal_id:STRING,name:STRING,name_kanji:STRING,nicknames:STRING,images:STRUCT<jpg:STRUCT<image_url:STRING>>>>"
SUBJECT_PAGE = f"data ARRAY<STRUCT<id:STRING,name:STRING,name_cn:STRING,characters:ARRAY<STRUCT<id:STRING,name:STRING,images:{IMAGES}>>>>"

# Infobox keys that name a work, and marks of name-like keys.
SOURCE_KEYS = ("引用来源", "出处", "来源", "所属作品", "登场作品")
NAME_MARKS = ("名", "别名", "昵称")
NO_TEXTS = "array<string>"
PAGE_BITS = 32  # places in an array stay below 2^31, so no item runs into the next page


def text_or_list(raw: Column) -> Column:
    """Texts of a field that holds one text or a JSON list; objects give v or k."""
    items = F.when(raw.startswith("["), F.from_json(raw, "ARRAY<STRING>")).when(raw.isNotNull(), F.array(raw))
    pick = lambda t: F.when(
        t.startswith("{"), X.first_text(F.get_json_object(t, "$.v"), F.get_json_object(t, "$.k"))
    ).otherwise(X.strip(t))
    return F.filter(F.transform(F.coalesce(items, F.array().cast(NO_TEXTS)), pick), lambda t: t != "")


def with_variants(base: Column, extra: Column) -> Column:
    """Add each extra name that is a plausible variant of the names so far."""
    start = X.let(X.distinct_texts(base), lambda names: F.struct(names.alias("names"), X.match_keys(names).alias("keys")))

    def add(held: Column, alias: Column) -> Column:
        more = F.struct(
            F.array_union(held["names"], F.array(X.strip(alias))).alias("names"), F.array_union(held["keys"], F.array(X.match_key(alias))).alias("keys")
        )
        return F.when(X.name_variant_predicate(alias, held["keys"]), more).otherwise(held)

    return F.aggregate(extra, start, add, lambda held: held["names"])


def _flatten(landed: DataFrame, items: Column, key) -> DataFrame:
    """Explode the parsed items of each page, first of equal keys kept, in order."""
    named = F.filter(items, lambda i: i["display_name"] != "")
    unique = X.let(named, lambda arr: first_entries(arr, key))
    rows = landed.select("request_id", "page", F.posexplode(unique).alias("pos", "i"))
    # page number in the high bits, place in the low ones: no shuffle, no window
    ordinal = F.shiftleft(F.col("page").cast("bigint"), PAGE_BITS) + F.col("pos") + 1
    return rows.select("request_id", ordinal.alias("ordinal"), "i.*")


def _title(t: Column) -> Column:
    return X.first_text(t["english"], t["romaji"], t["native"])


def _person(p: Column, title: Column, provider: str = "anilist") -> Column:
    n = p["name"]
    extra = F.concat(text_or_list(n["alternative"]), text_or_list(n["alternativeSpoiler"]))
    return F.struct(
        F.lit(provider).alias("provider"),
        X.strip(p["id"]).alias("provider_entity_id"),
        X.first_text(n["full"], n["userPreferred"], n["native"]).alias("display_name"),
        title.alias("source_title"),
        X.first_text(p["image"]["large"], p["image"]["medium"]).alias("avatar_url"),
        with_variants(F.array(n["full"], n["native"], n["userPreferred"]), extra).alias("aliases"),
    )


def _person_key(c: Column) -> Column:
    return F.lower(F.concat_ws(":", c["provider_entity_id"], c["display_name"], c["source_title"]))


def _dealt(landed: DataFrame) -> DataFrame:
    """Pages dealt out to all tasks before they are parsed."""
    return dealt(landed, "request_id", "page")


def _empty(items: Column) -> Column:
    return F.coalesce(items, F.array())


def people_payload(landed: DataFrame) -> DataFrame:
    """Person search pages: names, first listed work, picture, name variants."""
    items = _empty(F.from_json("body", PEOPLE_PAGE)["data"]["Page"]["characters"])
    parsed = F.transform(items, lambda p: _person(p, _title(F.get(p["media"]["nodes"], F.lit(0))["title"])))
    return _flatten(_dealt(landed), parsed, _person_key)


def media_payload(landed: DataFrame, limit: int) -> DataFrame:
    """Work pages: every character of a work, the work title as source."""
    media = _empty(F.from_json("body", MEDIA_PAGE)["data"]["Page"]["media"])
    nodes = lambda m: F.transform(_empty(m["characters"]["edges"]), lambda e: _person(e["node"], _title(m["title"])))
    rows = _flatten(_dealt(landed), F.flatten(F.transform(media, nodes)), _person_key)
    return top_n(rows, ["request_id"], ["ordinal"], limit).drop("rank")


def infobox_values(infobox: Column, marks: tuple[str, ...]) -> Column:
    """Texts of the entries whose key holds one of the marks, in order."""
    def named(e: Column) -> Column:
        hits = [F.contains(F.coalesce(e["key"], F.lit("")), F.lit(m)) for m in marks]
        hit = hits[0]
        for h in hits[1:]:
            hit = hit | h
        return hit

    return F.flatten(F.transform(F.filter(_empty(infobox), named), lambda e: text_or_list(e["value"])))


def infobox_source_title(infobox: Column) -> Column:
    usable = F.filter(infobox_values(infobox, SOURCE_KEYS), lambda t: ~X.looks_like_url(t))
    return F.coalesce(F.get(usable, F.lit(0)), F.lit(""))


def infobox_aliases(display_name: Column, infobox: Column) -> Column:
    names = F.concat(F.array(display_name), infobox_values(infobox, NAME_MARKS))
    return F.array_distinct(F.flatten(F.transform(names, X.split_aliases)))


def entry_payload(landed: DataFrame, provider: str = "bangumi") -> DataFrame:
    """Entry pages whose aliases and work title sit in an infobox."""
    items = _empty(F.from_json("body", ENTRY_PAGE)["data"])

    def one(p: Column) -> Column:
        i = p["images"]
        return F.struct(
            F.lit(provider).alias("provider"),
            X.strip(p["id"]).alias("provider_entity_id"),
            X.strip(p["name"]).alias("display_name"),
            infobox_source_title(p["infobox"]).alias("source_title"),
            X.first_text(i["large"], i["medium"], i["small"], i["grid"]).alias("avatar_url"),
            infobox_aliases(X.strip(p["name"]), p["infobox"]).alias("aliases"),
        )

    return _flatten(_dealt(landed), F.transform(items, one), lambda c: F.lower(F.concat_ws(":", c["provider_entity_id"], c["display_name"])))


def subject_payload(landed: DataFrame, requests: DataFrame, limit: int, subjects: int = 3, provider: str = "bangumi") -> DataFrame:
    """Works whose title matches the query, the first ``subjects`` of them, and
    their characters, distinct by id."""
    works = _dealt(landed).select("request_id", "page", F.posexplode(_empty(F.from_json("body", SUBJECT_PAGE)["data"])).alias("pos", "w"))
    works = works.join(requests.select("request_id", "query"), "request_id")
    title = X.first_text(F.col("w.name_cn"), F.col("w.name"))
    fits = X.meaningful_match(X.match_key(F.col("query")), X.match_key(title)) & (X.strip(F.col("w.id")) != "")
    chosen = top_n(works.withColumn("title", title).filter(fits), ["request_id"], ["page", "pos"], subjects, "work_no")
    people = chosen.select("request_id", "work_no", "title", F.posexplode(_empty(F.col("w.characters"))).alias("person_no", "p"))
    named = people.select(
        "request_id", "work_no", "person_no", F.lit(provider).alias("provider"), X.strip(F.col("p.id")).alias("provider_entity_id"),
        X.strip(F.col("p.name")).alias("display_name"), F.col("title").alias("source_title"),
        X.first_text(F.col("p.images.large"), F.col("p.images.medium"), F.col("p.images.small"), F.col("p.images.grid")).alias("avatar_url"),
    ).filter((F.col("provider_entity_id") != "") & (F.col("display_name") != ""))
    keyed = named.withColumn("_key", F.lower("provider_entity_id"))
    first = first_per_key(keyed, ["request_id", "_key"], ["work_no", "person_no"]).withColumn("aliases", F.array("display_name"))
    best = top_n(first, ["request_id"], ["work_no", "person_no"], limit, "ordinal")
    return best.select("request_id", "ordinal", "provider", "provider_entity_id", "display_name", "source_title", "avatar_url", "aliases")


def list_payload(landed: DataFrame, provider: str = "jikan", source_title: str = "MyAnimeList") -> DataFrame:
    """List pages without a work: a fixed source title, nicknames filtered."""
    items = _empty(F.from_json("body", LIST_PAGE)["data"])

    def one(p: Column) -> Column:
        return F.struct(
            F.lit(provider).alias("provider"),
            X.strip(p["mal_id"]).alias("provider_entity_id"),
            X.first_text(p["name"], p["name_kanji"]).alias("display_name"),
            F.lit(source_title).alias("source_title"),
            X.strip(p["images"]["jpg"]["image_url"]).alias("avatar_url"),
            with_variants(F.array(p["name"], p["name_kanji"]), text_or_list(p["nicknames"])).alias("aliases"),
        )

    return _flatten(_dealt(landed), F.transform(items, one), lambda c: F.lower(F.concat_ws(":", c["provider_entity_id"], c["display_name"])))


# ------------------------------------------------------------------------ html


def unescape(c: Column) -> Column:
    """Named and numeric entities that occur in attribute values and cells."""
    # Entity names; '&amp;' comes last so that nothing is decoded twice.
    for name, text in (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#160;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(text))
    return c


def html_first_table(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, row_no, cells) of the first table of each page; nested tables are
    out of scope."""
    table = F.regexp_extract(html, r"(?is)<table\b[^>]*>(.*?)</table>", 1)
    body = pages.select(key, F.posexplode(F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=<tr\b|</tr>|$)"), F.lit(1))).alias("row_no", "r"))
    cells = F.regexp_extract_all("r", F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)(?=<t[hd]\b|</t[hd]>|$)"), F.lit(1))
    plain = lambda t: X.strip(F.regexp_replace(unescape(F.regexp_replace(t, r"<[^>]*>", " ")), r"(?U)\s+", " "))
    rows = body.select(key, "row_no", F.transform(cells, plain).alias("cells"))
    return rows.filter(F.size("cells") > 0)


def html_embedded_json(pages: DataFrame, keys: list[str], html: str, pattern: str, schema: str, url: str) -> DataFrame:
    """Objects held as JSON in an HTML attribute (group 1 of the pattern); bad
    JSON, non-objects and non-http URLs drop."""
    raw = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    rows = pages.select(*keys, F.posexplode(raw).alias("pos", "raw")).withColumn("json", unescape(F.col("raw")))
    rows = rows.filter(F.col("json").startswith("{")).withColumn("o", F.from_json("json", schema))
    link = X.strip(F.replace(F.col(f"o.{url}"), F.lit("&amp;"), F.lit("&")))
    return rows.filter(F.lower(link).rlike("^https?://")).select(*keys, "pos", link.alias("url"), "o")


# ---------------------------------------------------------------------- roster

ROSTER_ENTRY = "EN STRING, CHS STRING, code STRING, rank STRING, release STRING"


def roster_entries(landed: DataFrame, body: str = "body") -> DataFrame:
    """A JSON object of id -> entry as rows (id, pos, entry)."""
    entry = "STRUCT<" + ROSTER_ENTRY.replace(" STRING", ":STRING") + ">"
    pairs = F.map_entries(F.from_json(body, f"MAP<STRING,{entry}>"))
    others = [c for c in landed.columns if c != body]
    return landed.select(*others, F.posexplode(pairs).alias("pos", "e")).select(
        *others, "pos", F.col("e.key").alias("entry_id"), F.col("e.value").alias("entry")
    )


def roster_index(entries: DataFrame, ordinal: Column) -> DataFrame:
    """(key, entry, ordinal): entries under their name and their code, the last wins."""
    keys = F.array(X.ascii_key(F.col("entry.EN")), X.ascii_key(F.coalesce("entry.code", F.lit(""))))
    rows = entries.select("entry", ordinal.alias("ordinal"), F.explode(F.array_distinct(keys)).alias("key")).filter(F.col("key") != "")
    return rows.groupBy("key").agg(F.max_by("entry", "ordinal").alias("entry"), F.max("ordinal").alias("ordinal"))


def roster_build(
    rows: DataFrame, row_id: str, index: DataFrame, prefix: str, game: str, nicknames: dict[str, str] | None = None, graded: bool = False
) -> DataFrame:
    """Table rows (cells) joined with API entries: id, names, aliases, rarity, date.

    Tried in order: nickname, full name, first word, last word. ``graded``
    rows hold their date in cell 7 and a numeric rank.
    """
    cell = lambda i: F.get(F.col("cells"), F.lit(i))
    width = 8 if graded else 6
    body = rows.filter((F.col("row_no") > 0) & (F.size("cells") >= width)).withColumn("name_en", cell(1))
    name = F.col("name_en")
    nick = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in nicknames.items() for x in kv]), name), name) if nicknames else name
    tries = F.array(nick, name, F.substring_index(name, " ", 1), F.substring_index(name, " ", -1)) if graded else F.array(name)
    joined = coalescing_lookup(body, row_id, F.transform(tries, X.ascii_key), index)
    e = F.col("entry")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return joined.select(
        row_id,
        F.concat(F.lit(prefix + "_"), X.ascii_slug(name)).alias("id"),
        F.lit(game).alias("game"),
        blank(e["CHS"]).alias("canonical_name_zh"),
        name.alias("canonical_name_en"),
        (X.alias_pipe(F.array(name, e["EN"], e["code"])) if graded else F.lit("")).alias("aliases"),
        (F.when(e.isNotNull(), X.grade_rarity(e["rank"])).otherwise("") if graded else X.star_rarity(e["rank"])).alias("rarity"),
        (X.release_date(cell(7)) if graded else X.date_prefix(e["release"])).alias("release_date"),
    )
