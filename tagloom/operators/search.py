"""Search: query filters, request flags, source choice, pages and quotas.

Candidates carry ``request_id`` and ``ordinal``; requests are a table
``(request_id, query)``. Everything is keyed by request, nothing is
compared across requests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.operators.entities import provider_key
from tagloom.operators.ranking import first_per_key, greedy_distinct, top_n


def library_haystack(display: Column, source: Column, aliases: Column, source_aliases: Column) -> Column:
    names = F.concat(F.array(display, source), F.coalesce(aliases, F.array()), F.coalesce(source_aliases, F.array()))
    parts = F.filter(F.transform(names, X.library_search_text), lambda t: t != "")
    return F.array_join(parts, " ")


def matches_terms(haystack: Column, query: str) -> Column:
    """Every term of a free query occurs; an empty query matches all."""
    terms = [X.library_search_text(F.lit(t)) for t in query.split()]
    hits = [(t == "") | F.contains(haystack, t) for t in terms]
    return reduce(lambda a, b: a & b, hits) if hits else F.lit(True)


def matches_candidate(query: Column, display: Column, source: Column, aliases: Column) -> Column:
    """Substring either way with two letters; a one-letter query looks at the
    raw fields; a non-ASCII query of three letters also takes a common part of
    two letters and 67 % of the query."""
    fields = F.concat(F.array(display, source), F.coalesce(aliases, F.array()))
    raw = F.lower(X.strip(query))

    def wide(q: Column) -> Column:
        keys = X.match_keys(fields)
        near = F.exists(keys, lambda k: X.meaningful_match(q, k))
        part = F.greatest(F.lit(2), F.ceil(F.length(q) * 0.67).cast("int"))
        loose = F.exists(keys, lambda k: X.has_non_ascii_letters(k) & X.shares_window(q, k, part))
        loose = X.has_non_ascii_letters(q) & (F.length(q) >= 3) & loose
        single = F.exists(fields, lambda f: F.contains(F.lower(F.coalesce(f, F.lit(""))), raw))
        return F.when(q == "", F.lit(False)).when(F.length(q) == 1, (raw != "") & single).otherwise(near | loose)

    return X.let(X.match_key(query), wide)


def candidate_query_filter(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    hit = matches_candidate(F.col("query"), F.col("display_name"), F.col("source_title"), F.col("aliases"))
    return candidates.join(requests.select("request_id", "query"), "request_id").filter(hit).drop("query")


def request_hit_flags(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, name_hit, display_hit, source_hit, n) per request with candidates."""
    q = X.match_key(F.col("query"))
    rows = candidates.join(requests.select("request_id", q.alias("q")), "request_id")
    near = lambda c: (F.col("q") != "") & X.meaningful_match(F.col("q"), X.match_key(c))
    names = F.concat(F.array("display_name"), F.coalesce("aliases", F.array()))
    return rows.groupBy("request_id").agg(
        F.bool_or(F.exists(names, near)).alias("name_hit"),
        F.bool_or(near(F.col("display_name"))).alias("display_hit"),
        F.bool_or(near(F.col("source_title"))).alias("source_hit"),
        F.count(F.lit(1)).alias("n"),
    )


def either_contains(text: Column, keys: Column, within: bool = True) -> Column:
    """Some key is contained in the text's key or, ``within``, contains it; no
    keys match all."""
    near = lambda t, k: F.contains(t, k) | F.contains(k, t) if within else F.contains(t, k)
    hit = X.let(X.match_key(text), lambda t: (t != "") & F.exists(keys, lambda k: near(t, k)))
    return (F.size(keys) == 0) | hit


def source_strict_filter(hits: DataFrame, text: Column, name_keys: Column, source_keys: Column, within: bool = True) -> DataFrame:
    """Hits that name the entity and, if any hit of the request does, the work too.

    Without work keys, or when the strict pass finds nothing, the name is enough.
    A short title may lie ``within`` a key; in running text that says nothing.
    """
    flagged = hits.withColumns({"_name": either_contains(text, name_keys, within), "_strict": (F.size(source_keys) > 0) & either_contains(text, source_keys, within)})
    named = flagged.filter("_name")
    tier = named.groupBy("request_id").agg(F.bool_or("_strict").alias("_any"))
    return named.join(tier, "request_id").filter(F.col("_strict") | ~F.col("_any")).drop("_name", "_strict", "_any")


def in_work(work: Column, works: Column) -> Column:
    """A listed work contains or is contained in the wanted one; no wish fits all."""
    def near(wanted: Column) -> Column:
        keys = X.match_keys(works)
        return (wanted == "") | F.exists(keys, lambda k: F.contains(k, wanted) | F.contains(wanted, k))

    return X.let(X.match_key(work), near)


def grouped_item_search(items: DataFrame, group: str, text: Column, query: str) -> DataFrame:
    """Items of groups whose name has the text, else the items that have it."""
    word = query.strip().lower()
    if not word:
        return items
    return items.filter(F.contains(F.lower(F.col(group)), F.lit(word)) | F.contains(F.lower(text), F.lit(word)))


# -------------------------------------------------------------------- merging


def merge_keys() -> tuple[Column, Column]:
    """(provider:id, name:work) of a candidate; NULL where it says nothing, so
    that blank links or names never make two candidates equal."""
    source = X.match_key(F.col("source_title"))
    name = X.match_key(F.col("display_name"))
    name_work = F.when(source != "", F.concat_ws(":", name, source)).otherwise(F.nullif(name, F.lit("")))
    p = F.lower(X.strip(F.col("provider")))
    e = F.lower(X.strip(F.col("provider_entity_id")))
    return F.when((p != "") | (e != ""), F.concat_ws(":", p, e)), name_work


def priority_merge(primary: DataFrame, supplement: DataFrame, limit: int) -> DataFrame:
    """Primary then supplement, dropping a candidate whose provider key or
    name:work key was kept before; ``pos`` is the new order within the request."""
    cols = [c for c in primary.columns if c != "ordinal"]
    both = primary.withColumn("_layer", F.lit(0)).unionByName(supplement.withColumn("_layer", F.lit(1)))
    # ordinals are unique per request and layer
    both = both.withColumn("_order", F.col("_layer") * F.lit(1 << 62) + F.col("ordinal"))
    link, name_work = merge_keys()
    keyed = both.withColumns({"_a": link, "_b": name_work})
    kept = greedy_distinct(keyed, "request_id", "_order", ("_a", "_b"))
    best = top_n(kept, ["request_id"], ["_order"], limit, "pos")
    return best.select(*cols, "ordinal", "pos")


def union_all_sources(*sources: DataFrame) -> DataFrame:
    """Union in the given order, distinct by provider:id:name:work."""
    layered = [s.withColumn("tier", F.lit(i)) for i, s in enumerate(sources)]
    both = reduce(DataFrame.unionByName, layered)
    key = F.lower(F.concat_ws(":", "provider", "provider_entity_id", "display_name", "source_title"))
    return first_per_key(both.withColumn("_key", key), ["request_id", "_key"], ["tier", "ordinal"]).drop("_key")


def provider_choice(
    requests: DataFrame,
    name_a: DataFrame,
    source_a: DataFrame,
    name_b: DataFrame,
    source_b: DataFrame,
    fallback: DataFrame,
    limit: int,
    title_search: bool = True,
) -> DataFrame:
    """Choose and merge the candidate lists of each request.

    Lists: first source by name and by work, second source by name and by
    work, a third source as fallback. Whether a list is used, and in which
    order, follows from the hit flags and the script of the query; ``choice``
    names the result.
    """
    def flags(rows: DataFrame, prefix: str) -> DataFrame:
        f = request_hit_flags(rows, requests)
        return f.select("request_id", *[F.col(c).alias(f"{prefix}_{c}") for c in f.columns if c != "request_id"])

    table = requests
    for prefix, rows in (("na", name_a), ("sa", source_a), ("nb", name_b), ("sb", source_b), ("fb", fallback)):
        table = table.join(flags(rows, prefix), "request_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0

    prefer_source = some("sa_n") & (yes("sa_source_hit") | ~yes("na_name_hit"))
    a_any = F.when(prefer_source, some("sa_n")).otherwise(some("na_n"))
    a_hit = F.when(prefer_source, yes("sa_name_hit") | yes("sa_source_hit")).otherwise(yes("na_name_hit") | yes("na_source_hit"))
    b_any = some("nb_n") | some("sb_n")
    b_first = b_any & (
        X.is_han_query(F.col("query"))
        | (yes("nb_display_hit") & ~yes("na_name_hit"))
        | (F.lit(title_search) & prefer_source & ~yes("na_name_hit") & ~yes("nb_display_hit"))
    )
    usable = a_any & (a_hit | prefer_source)
    choice = (
        F.when(b_any & usable & ~b_first, "a+b")
        .when(b_any, F.when(a_any, "b+a").otherwise("b"))
        .when(usable, F.when(prefer_source, "a-source").otherwise("a"))
        .when(some("fb_n"), "fallback")
        .otherwise("none")
    )
    plan = table.select("request_id", choice.alias("choice"), prefer_source.alias("prefer_source"), yes("nb_display_hit").alias("b_name_first"))

    def part(rows: DataFrame, keep: Column, layer: Column) -> DataFrame:
        return rows.join(plan, "request_id").filter(keep).withColumn("_layer", layer)

    c, ps, bn = F.col("choice"), F.col("prefer_source"), F.col("b_name_first")
    b_layer = F.when(c == "a+b", 2).otherwise(1)
    a_layer = F.when(c == "a+b", 1).otherwise(4)
    takes_a, takes_b = c.isin("a+b", "b+a", "a", "a-source"), c.isin("a+b", "b+a", "b")
    pool = reduce(DataFrame.unionByName, [
        part(name_a, takes_a & ~ps, a_layer),
        part(source_a, takes_a & ps, a_layer),
        part(name_b, takes_b, b_layer + F.when(bn, 0).otherwise(1)),
        part(source_b, takes_b, b_layer + F.when(bn, 1).otherwise(0)),
        part(fallback, c == "fallback", F.lit(1)),
    ])
    # a single list is taken as it is, merged lists drop repeats
    order = F.col("_layer").cast("bigint") * F.lit(1 << 58) + F.col("ordinal")
    pool = pool.withColumn("_order", order).drop("_layer", "prefer_source", "b_name_first")
    merged = c.isin("a+b", "b+a", "b")
    link, name_work = merge_keys()
    keyed = pool.withColumns({"_a": F.when(merged, link), "_b": F.when(merged, name_work)})
    kept = greedy_distinct(keyed, "request_id", "_order", ("_a", "_b"))
    return top_n(kept, ["request_id"], ["_order"], limit, "pos").drop("_a", "_b", "_order")


def source_title_enrich(candidates: DataFrame, related: DataFrame, provider: str, at_most: int) -> DataFrame:
    """Fill empty or URL-like work titles from ``related(provider_entity_id, pos, title)``.

    The first non-empty title counts; at most n candidates of a request are tried.
    """
    wants = (F.lower(X.strip(F.col("provider"))) == provider) & (
        (X.strip(F.col("source_title")) == "") | X.looks_like_url(F.col("source_title"))
    )
    tried = top_n(candidates.filter(wants).select("request_id", "ordinal"), ["request_id"], ["ordinal"], at_most, "_n")
    titles = related.withColumn("title", X.strip(F.col("title"))).filter(F.col("title") != "")
    first = titles.groupBy("provider_entity_id").agg(F.min_by("title", "pos").alias("_title"))
    rows = candidates.join(tried, ["request_id", "ordinal"], "left").join(first, "provider_entity_id", "left")
    title = F.when(F.col("_n").isNotNull(), F.coalesce("_title", "source_title")).otherwise(F.col("source_title"))
    return rows.withColumn("source_title", title).drop("_n", "_title")


# ---------------------------------------------------------------------- pages


def unseen_first_page(pool: DataFrame, seen: DataFrame, n: int) -> DataFrame:
    """First n of ``pool(session, pos, key)``: unseen ones first, then seen ones."""
    old = seen.select("session", "key").distinct().withColumn("_seen", F.lit(1))
    rows = pool.join(old, ["session", "key"], "left").withColumn("_seen", F.coalesce("_seen", F.lit(0)))
    return top_n(rows, ["session"], ["_seen", "pos"], n).drop("_seen")


def tiered_quota_fill(hits: DataFrame, n: int) -> DataFrame:
    """Fill a quota from ordered tiers with distinct URLs: ``hits(request_id, tier, pos, url)``."""
    rows = hits.withColumn("url", X.strip(F.col("url"))).filter(F.col("url") != "")
    first = first_per_key(rows, ["request_id", "url"], ["tier", "pos"])
    return top_n(first, ["request_id"], ["tier", "pos"], n)


def popular_topn(pages: DataFrame, page_size: int, n: int, second: DataFrame | None = None) -> DataFrame:
    """First n distinct candidates of ``pages(page, pos, key)`` up to the first
    short page; the second source counts only if the first is empty."""
    def distinct_pages(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("page").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") < page_size)
        last = sizes.agg(F.min("page")).scalar()
        return first_per_key(rows.filter(F.col("page") <= F.coalesce(last, F.col("page"))), ["key"], ["page", "pos"])

    out = distinct_pages(pages)
    if second is not None:
        empty = pages.limit(1).agg(F.count(F.lit(1)) == 0).scalar()
        out = out.unionByName(distinct_pages(second).filter(empty))
    return out.orderBy("page", "pos").limit(n)


# --------------------------------------------------------- pictures, editors

# The order in which a provider's picture sizes are tried.
PICTURE_ORDER = {
    "anilist": ("large", "medium"),
    "bangumi": ("medium", "large", "small", "grid"),
}


def image_url_candidates(provider: Column, pictures: Column, avatar: Column, at_most: int) -> Column:
    """Distinct picture addresses in the provider's order, the avatar last
    where the provider also names one; other providers have the avatar alone."""
    order = F.array(avatar)
    for name, sizes in PICTURE_ORDER.items():
        order = F.when(F.lower(provider) == name, F.concat(F.array(*[pictures[s] for s in sizes]), F.array(avatar))).otherwise(order)
    return F.slice(X.distinct_texts(order), 1, at_most)


def editor_groups(tags: DataFrame, characters: DataFrame) -> DataFrame:
    """Choices of the tag editor, (kind, group_name, label, value), as one
    sorted table: a group is a run of rows, never one row that holds all items.

    ``tags(category_id, name, tag_id)`` and ``characters(group_name, label, value)``.
    """
    features = tags.select(F.lit("feature").alias("kind"), F.col("category_id").alias("group_name"), F.coalesce("name", "tag_id").alias("label"), F.col("tag_id").alias("value"))
    people = characters.select(F.lit("character").alias("kind"), "group_name", "label", "value")
    return features.unionByName(people).orderBy("kind", F.lower("group_name"), F.lower("label"), "value")
