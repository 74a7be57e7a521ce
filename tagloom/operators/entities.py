"""Identity of entities: provider links, fuzzy names, imports and merges.

``entities(id, ordinal, display_name, aliases ARRAY<STRUCT<name,language>>,
source_title, provider, provider_entity_id, provider_links, ...)`` and
``candidates(candidate_id, ordinal, provider, provider_entity_id,
display_name, source_title, avatar_url, aliases ARRAY<STRING>)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import localize as L
from tagloom.functions import text as X
from tagloom.operators.ranking import first_per_key, root_labels
from tagloom.session import dealt, materialize, small_side

# The source whose identity wins in a merge.
PROVIDER_PRIORITY = {"anilist": 4, "bangumi": 3, "jikan": 2, "manual": 1}


def provider_key(provider: Column, entity_id: Column) -> Column:
    """Lower-case 'provider:id', NULL when there is no id."""
    e = X.strip(entity_id)
    p = F.coalesce(F.nullif(X.strip(provider), F.lit("")), F.lit("manual"))
    return F.when(e != "", F.lower(F.concat(p, F.lit(":"), e)))


def provider_priority(c: Column) -> Column:
    result = F.lit(0)
    low = F.lower(X.strip(c))
    for name, rank in PROVIDER_PRIORITY.items():
        result = F.when(low == name, F.lit(rank)).otherwise(result)
    return result


def entity_links(entities: DataFrame) -> DataFrame:
    """(link_key, id): the first entity that holds a link."""
    links = L.provider_links(F.col("provider"), F.col("provider_entity_id"), F.col("provider_links"))
    rows = dealt(entities, "id").select("id", "ordinal", F.explode(links).alias("l"))
    keyed = rows.select(L.link_key(F.col("l")).alias("link_key"), "id", "ordinal")
    return keyed.groupBy("link_key").agg(F.min_by("id", "ordinal").alias("id"))


def provider_link_join(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Candidates with the id of the entity that has their provider link."""
    # rows without a link spread over keys that no link has: they hold no ':'
    none = F.concat(F.lit("#"), F.xxhash64(*candidates.columns))
    keyed = candidates.withColumn("link_key", F.coalesce(provider_key(F.col("provider"), F.col("provider_entity_id")), none))
    return keyed.join(entity_links(entities), "link_key", "left").drop("link_key")


def candidate_key(prefix: str = "") -> Column:
    """Provider key, else provider:name:source."""
    name = F.concat_ws(":", F.lower(X.strip(F.col("provider"))), X.match_key(F.col("display_name")), X.match_key(F.col("source_title")))
    return F.coalesce(provider_key(F.col("provider"), F.col("provider_entity_id")), name)


def existing_candidate_antijoin(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Drop linked candidates, then keep the first per candidate key and request."""
    keyed = candidates.withColumn("link_key", provider_key(F.col("provider"), F.col("provider_entity_id")))
    fresh = keyed.join(entity_links(entities), "link_key", "left_anti").withColumn("_key", candidate_key())
    return first_per_key(fresh, ["request_id", "_key"], ["ordinal"]).drop("_key", "link_key")


# ----------------------------------------------------------- fuzzy identity


def canonical_sources(titles: DataFrame, title: str, aliases: DataFrame | None, name: str) -> DataFrame:
    """``titles`` with the canonical key of each work.

    ``aliases(alias, canonical)`` is the vocabulary of works: a title whose slug
    is an alias, or begins with one and a word end, gets the canonical key of
    the longest such alias; others keep their slug. Without a table every title
    does. The prefixes of distinct slugs, up to the words of the longest alias,
    meet the aliases in an equi-join.
    """
    rows = titles.withColumn("_slug", X.source_slug(F.col(title)))
    if aliases is None:
        return rows.withColumn(name, F.coalesce("_slug", F.lit(X.UNKNOWN_SOURCE))).drop("_slug")
    own = aliases.select(F.col("canonical").alias("alias"), "canonical")
    known = aliases.select("alias", "canonical").unionByName(own).select(X.slug(F.col("alias")).alias("prefix"), "canonical").filter("prefix <> ''")
    known = small_side(known.groupBy("prefix").agg(F.min("canonical").alias("canonical")), "source-aliases")
    longest = known.agg(F.max(F.size(F.split("prefix", "_")))).first()[0] or 1
    words = F.split("_slug", "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.size(words), F.lit(longest))), lambda n: F.array_join(F.slice(words, 1, n), "_"))
    met = rows.select("_slug").filter("_slug IS NOT NULL").distinct().select("_slug", F.explode(prefixes).alias("prefix")).join(known, "prefix")
    found = met.groupBy("_slug").agg(F.max_by("canonical", F.length("prefix")).alias("_canonical"))
    found = small_side(found, "source-names")
    return rows.join(found, "_slug", "left").withColumn(name, F.coalesce("_canonical", "_slug", F.lit(X.UNKNOWN_SOURCE))).select(*titles.columns, name)


def with_source_keys(rows: DataFrame, title: str, prefix: str, aliases: DataFrame | None = None) -> DataFrame:
    """Add the canonical key and the variant keys of a work title."""
    named = canonical_sources(rows, title, aliases, f"{prefix}_canonical")
    return named.withColumn(f"{prefix}_variants", X.title_variant_keys(F.col(title)))


def source_compatible(left: Column, right: Column, lc: Column, rc: Column, lv: Column, rv: Column) -> Column:
    """Either title empty, same canonical key, or variants that overlap enough."""
    overlap = F.exists(
        lv, lambda a: F.exists(rv, lambda b: X.substring_overlap(a, b) >= F.greatest(F.lit(2), X.minimum_match_length(a)))
    )
    return (X.strip(left) == "") | (X.strip(right) == "") | (lc == rc) | overlap


def _substrings(key: Column, lengths: list[int], least: Column) -> Column:
    """All substrings of the listed lengths from ``least`` on."""
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: (n >= least) & (n <= F.length(key)))
    cuts = F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(key) - n + 1), lambda i: F.substring(key, i, n)))
    return F.array_distinct(F.flatten(cuts))


def _lengths(keys: DataFrame) -> list[int]:
    """Distinct key lengths - a handful of numbers."""
    return sorted(r[0] for r in keys.select(F.length("key")).distinct().collect())


def containing_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r, overlap) of distinct keys where one contains the other.

    A containment is an equality between a key and a substring of the other,
    so both directions are equi-joins: no block of similar names is ever
    multiplied out and nothing is compared twice. The overlap is at least two
    and what the left key asks for; shorter parts never reach a join, so one
    short name does not meet every name that holds it.
    """
    key = F.col("key")
    least = F.greatest(F.lit(2), X.minimum_match_length(key))
    left, right = left.distinct(), right.distinct().filter(F.length("key") >= 2)
    big_left = left.select(key.alias("l"), F.explode(_substrings(key, _lengths(right) or [1], least)).alias("key"))
    left = left.filter(F.length("key") >= least)
    big_right = right.select(key.alias("r"), F.explode(_substrings(key, _lengths(left) or [1], F.lit(2))).alias("key"))
    inside = big_left.join(right, "key").select("l", F.col("key").alias("r"))
    around = big_right.join(left, "key").select(F.col("key").alias("l"), "r")
    return inside.union(around).distinct().withColumn("overlap", F.least(F.length("l"), F.length("r")))


BLANK, ANY = "blank", "any"  # work keys of untitled works


def work_keys(left: DataFrame, right: DataFrame, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(title, work) of both sides: two titles are compatible exactly when they
    share a work key.

    ``left`` and ``right`` are distinct titles. A title has its canonical key;
    the right one its variants and the left one the right variants that one of
    its own contains or is contained in, found once per distinct variant. An
    untitled right work has a key that every left one has, and the other way
    round. So works never meet works in a product.
    """
    # written first: Spark would leave out the distinct below another one and find the keys of every row
    distinct = lambda rows, name: materialize(rows.select(F.col("title").alias("t")).distinct(), name)
    title = lambda rows: with_source_keys(rows, "t", "t", aliases).select(F.col("t").alias("title"), "t_canonical", "t_variants")
    left, right = (materialize(title(distinct(rows, f"{side}-titles")), f"{side}-works") for side, rows in (("left", left), ("right", right)))
    of = lambda rows: rows.select("title", F.explode("t_variants").alias("key"))
    pairs = containing_pairs(of(left).select("key"), of(right).select("key"))
    by_variant = of(left).withColumnRenamed("key", "l").join(pairs, "l").select("title", F.concat(F.lit("v:"), "r").alias("work"))
    empty = X.strip(F.col("title")) == ""
    keys = lambda always, untitled: F.array_compact(F.array(F.concat(F.lit("c:"), "t_canonical"), F.lit(always), F.when(empty, F.lit(untitled))))
    lefts = left.select("title", F.explode(keys(BLANK, ANY)).alias("work")).unionByName(by_variant).distinct()
    rights = right.select("title", F.explode(keys(ANY, BLANK)).alias("work")).unionByName(of(right).select("title", F.concat(F.lit("v:"), "key").alias("work"))).distinct()
    return small_side(lefts, "left-work-keys"), small_side(rights, "right-work-keys")


HOT_ROWS = 4096  # of a join key that one task gets


def salted_join(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Equi-join in which a key may hold any number of rows of ``many``: those
    of a hot key are dealt out over salts, and its rows of ``few`` go to each."""
    sizes = many.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_ROWS)
    hot = small_side(sizes.select(key, F.ceil(F.col("_n") / HOT_ROWS).cast("int").alias("_salts")), "hot-keys")
    salt = F.pmod(F.xxhash64(*[c for c in many.columns if c != key]), F.coalesce("_salts", F.lit(1))).cast("int")
    dealt = many.join(hot, key, "left").withColumn("_salt", salt).drop("_salts")
    spread = few.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(spread, [key, "_salt"]).drop("_salt")


def identity_fuzzy_join(candidates: DataFrame, entities: DataFrame, strict_source: bool = False, aliases: DataFrame | None = None) -> DataFrame:
    """(candidate_id, id): first entity, in ordinal order, with the same identity.

    A name key contains the other with enough letters and the works agree, or
    the display name matches with one letter more whatever the work. Candidate
    keys include the work title; ``strict_source`` drops that and the second
    rule. ``aliases(alias, canonical)`` names works that have several titles.

    Per name pair the entities are first reduced to the first one of each work
    key, so a name in m works on one side and n on the other costs m + n rows.
    """
    names = F.array(F.col("display_name"), *([] if strict_source else [F.col("source_title")]))
    c_keys = dealt(candidates, "candidate_id").select(
        "candidate_id", F.coalesce("source_title", F.lit("")).alias("title"), X.match_key(F.col("display_name")).alias("display"),
        F.explode(X.match_keys(F.concat(names, F.coalesce("aliases", F.array())))).alias("l"),
    )
    e_names = F.concat(F.array("display_name"), F.transform(F.coalesce("aliases", F.array()), lambda a: a["name"]))
    e_keys = dealt(entities, "ordinal").select(
        "ordinal", F.coalesce("source_title", F.lit("")).alias("title"), F.explode(X.match_keys(e_names)).alias("r")
    )
    # equal names collapse before anything is paired
    c_keys = materialize(c_keys, "candidate-keys")
    e_side = materialize(e_keys.groupBy("r", "title").agg(F.min("ordinal").alias("ordinal")), "entity-keys")
    pairs = materialize(containing_pairs(c_keys.select(F.col("l").alias("key")), e_side.select(F.col("r").alias("key"))), "name-pairs")
    c_works, e_works = work_keys(c_keys.select("title").distinct(), e_side.select("title").distinct(), aliases)
    need = X.minimum_match_length(F.col("l"))

    enough = pairs.filter(F.col("overlap") >= F.greatest(F.lit(2), need)).select("l", "r")
    firsts = e_side.join(e_works, "title").groupBy("r", "work").agg(F.min("ordinal").alias("ordinal"))
    firsts = salted_join(firsts, enough, "r").groupBy("l", "work").agg(F.min("ordinal").alias("ordinal"))
    by_work = c_keys.select("l", "title").distinct().join(c_works, "title").join(firsts, ["l", "work"])
    by_name = by_work.groupBy("l", "title").agg(F.min("ordinal").alias("ordinal"))
    hits = c_keys.join(by_name, ["l", "title"]).select("candidate_id", "ordinal")
    if not strict_source:
        e_first = e_side.groupBy("r").agg(F.min("ordinal").alias("ordinal"))
        long_enough = pairs.filter(F.col("overlap") >= F.greatest(F.lit(2), need + 1))
        by_display = long_enough.join(e_first, "r").groupBy(F.col("l").alias("display")).agg(F.min("ordinal").alias("ordinal"))
        shown = c_keys.filter(F.col("display") != "").select("candidate_id", "display").distinct()
        hits = hits.unionByName(shown.join(by_display, "display").select("candidate_id", "ordinal"))
    best = hits.groupBy("candidate_id").agg(F.min("ordinal").alias("ordinal"))
    return best.join(entities.select("ordinal", "id"), "ordinal").select("candidate_id", "id")


# ------------------------------------------------------------ import, merge


def new_entity_id(display: Column, source: Column, provider: Column, entity_id: Column) -> Column:
    """slug plus 8 hex digits of the stable fields, equal on every rerun."""
    name = F.coalesce(F.nullif(X.slug(display), F.lit("")), F.lit("character"))
    digest = F.substring(F.sha1(F.concat_ws("|", display, source, provider, entity_id).cast("binary")), 1, 8)
    return F.concat(F.lit("custom_"), name, F.lit("_"), digest)


def _new_id(place: Column | None = None) -> Column:
    """Id of a candidate; ``place`` tells apart equal ones without a link."""
    provider = F.coalesce(F.nullif(X.strip(F.col("provider")), F.lit("")), F.lit("manual"))
    entity = X.strip(F.col("provider_entity_id"))
    entity = entity if place is None else F.concat(entity, place)
    return new_entity_id(X.strip(F.col("display_name")), X.strip(F.col("source_title")), provider, entity)


def library_import(candidates: DataFrame, entities: DataFrame, strategy: str = "auto", aliases: DataFrame | None = None) -> DataFrame:
    """(candidate_id, action, id) with action existing / merge / new.

    A link match keeps the entity; an identity match merges (not under
    strategy ``new``); the rest is new. New candidates are closed among
    themselves: the first of equal links, then the first identity match, give
    the entity that the others join. Unlike one-by-one imports, aliases won
    inside the same batch do not widen later matches.
    """
    linked = materialize(provider_link_join(dealt(candidates, "candidate_id"), entities), "import-linked")
    done = linked.filter(F.col("id").isNotNull()).select("candidate_id", F.lit("existing").alias("action"), "id")
    rest = linked.filter(F.col("id").isNull()).drop("id")
    if strategy != "new":
        merges = materialize(identity_fuzzy_join(rest, entities, aliases=aliases), "import-merge")
        done = done.unionByName(merges.select("candidate_id", F.lit("merge").alias("action"), "id"))
        rest = rest.join(merges, "candidate_id", "left_anti")
    keyed = rest.withColumn("_link", F.coalesce(provider_key(F.col("provider"), F.col("provider_entity_id")), F.concat(F.lit("#"), F.col("candidate_id").cast("string"))))
    owner = keyed.groupBy("_link").agg(F.min("ordinal").alias("owner"))
    keyed = materialize(keyed.join(owner, "_link"), "import-new")
    own = keyed.filter(F.col("ordinal") == F.col("owner")).drop("owner")
    if strategy == "new":
        roots = own.select("ordinal", F.col("ordinal").alias("root"))
    else:
        as_entities = own.select(
            F.col("ordinal").alias("id"), "ordinal", "display_name", "source_title",
            F.transform(F.coalesce("aliases", F.array()), lambda a: F.struct(a.alias("name"), F.lit("").alias("language"))).alias("aliases"),
        )
        first = identity_fuzzy_join(own, as_entities, aliases=aliases).withColumnRenamed("id", "match")
        parent = own.join(first, "candidate_id", "left").select(
            "ordinal", F.least(F.coalesce("match", "ordinal"), F.col("ordinal")).alias("root")
        )
        roots = root_labels(parent, "ordinal", "root")
    ids = own.select(F.col("ordinal").alias("root"), _new_id().alias("id"))
    named = keyed.join(roots.withColumnRenamed("ordinal", "owner"), "owner").join(ids, "root")
    action = F.when(F.col("ordinal") == F.col("root"), "new").when(F.col("ordinal") == F.col("owner"), "merge").otherwise("existing")
    return done.unionByName(named.select("candidate_id", action.alias("action"), "id"))


def merged_fields(entities: DataFrame, merges: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Scalar fields of entities after merging ``merges(id, <candidate columns>)``.

    The highest provider priority wins the identity (the later of equals), the
    avatar is kept, a longer compatible title replaces the title.
    """
    has_link = F.col("provider_entity_id") != ""
    rank = F.struct(provider_priority(F.col("provider")).alias("p"), F.col("ordinal").alias("o"))
    best = F.struct("provider", "provider_entity_id")
    firsts = merges.groupBy("id").agg(
        F.max(F.when(has_link, provider_priority(F.col("provider")))).alias("_p"),
        F.max_by(best, F.when(has_link, rank)).alias("_link"),
        F.min_by(F.nullif(X.strip(F.col("source_title")), F.lit("")), F.when(X.strip(F.col("source_title")) != "", F.col("ordinal"))).alias("_title"),
        F.min_by("avatar_url", F.when(X.strip(F.col("avatar_url")) != "", F.col("ordinal"))).alias("_avatar"),
    )
    rows = entities.join(firsts, "id", "left")
    wins = F.col("_p") >= provider_priority(F.col("provider"))
    rows = rows.withColumns({
        "provider": F.when(wins, F.col("_link.provider")).otherwise(F.col("provider")),
        "provider_entity_id": F.when(wins, F.col("_link.provider_entity_id")).otherwise(F.col("provider_entity_id")),
        "avatar_url": X.first_text(F.col("avatar_url"), F.col("_avatar")),
        "source_title": X.first_text(F.col("source_title"), F.col("_title")),
    }).drop("_p", "_link", "_title", "_avatar")

    titles = merges.select("id", X.strip(F.col("source_title")).alias("t"), "ordinal").filter(F.col("t") != "")
    titles = titles.groupBy("id", "t").agg(F.min("ordinal").alias("ordinal"))
    base = rows.select("id", F.col("source_title").alias("b")).filter(F.col("b") != "")
    both = titles.join(base, "id").filter(F.length("t") > F.length("b"))
    both = with_source_keys(with_source_keys(both, "t", "t", aliases), "b", "b", aliases)
    fit = source_compatible(F.col("b"), F.col("t"), F.col("b_canonical"), F.col("t_canonical"), F.col("b_variants"), F.col("t_variants"))
    longer = both.filter(fit).groupBy("id").agg(F.max_by("t", F.struct(F.length("t"), -F.col("ordinal"))).alias("_longer"))
    return rows.join(longer, "id", "left").withColumn("source_title", F.coalesce("_longer", "source_title")).drop("_longer")


def merged_aliases(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """(id, name, language) after the merge, distinct by case-free name and language.

    A long table: an entity with very many new names stays spread out.
    """
    old = entities.select("id", F.lit(0).alias("_layer"), F.lit(0).cast("bigint").alias("ordinal"), F.posexplode(L.alias_entries(F.col("display_name"), F.col("aliases"))).alias("pos", "e"))
    names = F.concat(F.array("display_name"), F.coalesce("aliases", F.array()))
    new = merges.select("id", F.lit(1).alias("_layer"), F.col("ordinal").cast("bigint").alias("ordinal"), F.posexplode(names).alias("pos", "n"))
    new = new.select("id", "_layer", "ordinal", "pos", L.alias_entry(F.col("n"), F.lit("")).alias("e"))
    rows = old.unionByName(new).select("id", "_layer", "ordinal", "pos", "e.name", "e.language").filter(F.col("name") != "")
    keyed = rows.withColumn("_key", F.lower("name"))
    return first_per_key(keyed, ["id", "_key", "language"], ["_layer", "ordinal", "pos"]).select("id", "name", "language")


def merged_links(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """(id, provider, provider_entity_id) after the merge, distinct without case."""
    links = L.provider_links(F.col("provider"), F.col("provider_entity_id"), F.col("provider_links"))
    old = entities.select("id", F.lit(0).alias("_layer"), F.lit(0).cast("bigint").alias("ordinal"), F.explode(links).alias("l"))
    old = old.select("id", "_layer", "ordinal", "l.provider", "l.provider_entity_id")
    new = merges.select("id", F.lit(1).alias("_layer"), F.col("ordinal").cast("bigint").alias("ordinal"), "provider", "provider_entity_id")
    rows = old.unionByName(new).filter(F.col("provider_entity_id") != "")
    keyed = rows.withColumn("_key", F.lower(F.concat_ws(":", "provider", "provider_entity_id")))
    return first_per_key(keyed, ["id", "_key"], ["_layer", "ordinal"]).select("id", "provider", "provider_entity_id")


# -------------------------------------------------------------- maintenance


def library_upsert(entities: DataFrame, additions: DataFrame, now: str) -> DataFrame:
    """Entities plus the additions whose link is not there yet."""
    keyed = additions.withColumn("_link", provider_key(F.col("provider"), F.col("provider_entity_id")))
    fresh = keyed.join(entity_links(entities).withColumnRenamed("link_key", "_link"), "_link", "left_anti")
    linked = first_per_key(fresh.filter(F.col("_link").isNotNull()), ["_link"], ["ordinal"])
    rows = linked.unionByName(fresh.filter(F.col("_link").isNull()).select(*linked.columns))
    new = rows.select(
        _new_id(F.when(F.col("_link").isNull(), F.concat(F.lit("#"), F.col("ordinal").cast("string"))).otherwise(F.lit(""))).alias("id"),
        X.strip(F.col("display_name")).alias("display_name"),
        X.strip(F.col("source_title")).alias("source_title"),
        F.coalesce(F.nullif(X.strip(F.col("provider")), F.lit("")), F.lit("manual")).alias("provider"),
        X.strip(F.col("provider_entity_id")).alias("provider_entity_id"),
        F.lit(True).alias("enabled"),
        F.lit(now).alias("created_at"),
        F.lit(now).alias("updated_at"),
    )
    return entities.select(*new.columns).unionByName(new)


def library_update(entities: DataFrame, patches: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Patch every non-NULL field of ``patches(id, ...)`` except the id; returns
    (entities, unknown ids)."""
    fields = [c for c in patches.columns if c != "id"]
    renamed = patches.select("id", *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_hit"))
    rows = entities.join(renamed, "id", "left")
    rows = rows.withColumns({c: F.coalesce(f"_{c}", c) for c in fields})
    if "updated_at" in entities.columns:
        rows = rows.withColumn("updated_at", F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("updated_at")))
    texts = {c: X.strip(F.col(c)) for c in ("display_name", "source_title", "provider_entity_id") if c in rows.columns}
    rows = rows.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in texts.items()})
    if "aliases" in rows.columns:
        rows = rows.withColumn("aliases", F.when(F.col("_hit"), L.alias_entries(F.col("display_name"), F.col("aliases"))).otherwise(F.col("aliases")))
    missing = patches.join(entities, "id", "left_anti").select("id")
    return rows.select(*entities.columns), missing


def library_delete(entities: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining entities, one-row summary total / deleted / missing)."""
    wanted = ids.select("id").distinct()
    hits = wanted.join(entities.select("id").withColumn("_hit", F.lit(True)), "id", "left")
    summary = hits.agg(
        F.count(F.lit(1)).alias("total"), F.count("_hit").alias("deleted"), F.count_if(F.col("_hit").isNull()).alias("missing")
    )
    return entities.join(wanted, "id", "left_anti"), summary


def source_rename(entities: DataFrame, old: Column, new: Column, only: Column | None = None) -> DataFrame:
    """Rename a work on matching rows; ``changed`` flags them."""
    hit = (X.strip(F.col("source_title")) == old) & (new != "") & (old != "") & (old != new)
    hit = hit if only is None else hit & only
    return entities.withColumn("changed", hit).withColumn("source_title", F.when(hit, new).otherwise(F.col("source_title")))


def source_alias_set(entities: DataFrame, title: str, aliases: Column) -> DataFrame:
    """Set the aliases of a work on all its entities."""
    hit = X.strip(F.col("source_title")) == title
    entries = L.alias_entries(F.lit(title), aliases)
    return entities.withColumn("changed", hit).withColumn("source_aliases", F.when(hit, entries).otherwise(F.col("source_aliases")))


def source_groups(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Works as two tables: (source_title, character_count) in title order, and
    their distinct aliases (source_title, name, language). Ids are not gathered:
    membership is the entity table itself."""
    titled = entities.withColumn("source_title", X.strip(F.col("source_title"))).filter(F.col("source_title") != "")
    groups = titled.groupBy("source_title").agg(F.count_distinct("id").alias("character_count"))
    entries = L.alias_entries(F.col("source_title"), F.col("source_aliases"))
    rows = titled.select("source_title", "ordinal", F.posexplode(entries).alias("pos", "e"))
    keyed = rows.select("source_title", "ordinal", "pos", "e.name", "e.language", F.lower("e.name").alias("_key"))
    first = first_per_key(keyed, ["source_title", "_key", "language"], ["ordinal", "pos"])
    return groups.orderBy(F.lower("source_title")), first.select("source_title", "name", "language")


def alias_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Aliases only on one side, by case-free name and language: (side, name, language)."""
    def keyed(rows: DataFrame) -> DataFrame:
        named = rows.select(X.strip(F.col("name")).alias("name"), "language", "ordinal").filter(F.col("name") != "")
        return first_per_key(named.withColumn("_key", F.lower("name")), ["_key", "language"], ["ordinal"])

    a, b = keyed(left), keyed(right)
    only_a = a.join(b.select("_key", "language"), ["_key", "language"], "left_anti").withColumn("side", F.lit("current"))
    only_b = b.join(a.select("_key", "language"), ["_key", "language"], "left_anti").withColumn("side", F.lit("existing"))
    return only_a.unionByName(only_b).select("side", "name", "language").orderBy("side", F.lower("name"))


def dataset_signature(rows: DataFrame, order: Column, *columns: Column) -> DataFrame:
    """Order-dependent digest of a table without gathering it: every row is
    hashed together with its position and the hashes are XOR-ed."""
    text = F.concat_ws("\u0001", order.cast("string"), *columns)
    bits = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    return rows.select(bits.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor("h").alias("signature"))


def coalescing_lookup(rows: DataFrame, row_id: str, keys: Column, index: DataFrame, default: Column | None = None) -> DataFrame:
    """First key of an ordered key list that the index knows: (row_id, entry).

    ``index(key, entry, ordinal)``, the later registration wins.
    """
    entries = index.filter(F.col("key") != "").groupBy("key").agg(F.max_by("entry", "ordinal").alias("entry"))
    tried = rows.select(row_id, F.posexplode(keys).alias("pos", "key"))
    hits = tried.join(entries, "key").groupBy(row_id).agg(F.min_by("entry", "pos").alias("entry"))
    found = rows.join(hits, row_id, "left")
    return found if default is None else found.withColumn("entry", F.coalesce("entry", default))


def name_index(entities: DataFrame) -> DataFrame:
    """(key, id): case-free names and aliases, the first registration wins."""
    names = F.concat(F.array("display_name"), F.transform(F.coalesce("aliases", F.array()), lambda a: a["name"]))
    rows = entities.select("id", "ordinal", F.posexplode(names).alias("pos", "n"))
    keyed = rows.select("id", F.struct("ordinal", "pos").alias("o"), F.lower(X.strip(F.col("n"))).alias("key"))
    return keyed.filter(F.col("key") != "").groupBy("key").agg(F.min_by("id", "o").alias("id"))


def feature_cascade(tokens: DataFrame, taxonomy: DataFrame, aliases: DataFrame) -> DataFrame:
    """Free tokens -> tag ids: exact id, normalised id, alias, normalised alias.

    ``tokens(item_id, pos, token)``; (item_id, pos, tag), first of equals kept.
    Runs of '_', '-' and blanks become one '_' (the evident intent).
    """
    raw = X.strip_tag_prefix(F.col("token"))
    rows = tokens.select("item_id", "pos", raw.alias("raw")).filter(F.col("raw") != "")
    rows = rows.withColumn("norm", F.lower(F.regexp_replace(F.regexp_replace("raw", r"(?U)[_\-\s]+", "_"), "^_+|_+$", "")))
    ids = taxonomy.select("tag_id").distinct()
    named = aliases.select(F.lower(X.strip(F.col("token"))).alias("key"), "canonical_id", "ordinal").filter(F.col("key") != "")
    named = named.groupBy("key").agg(F.min_by("canonical_id", "ordinal").alias("tag"))
    out = (
        rows.join(ids.select(F.col("tag_id").alias("raw"), F.col("tag_id").alias("t1")), "raw", "left")
        .join(ids.select(F.col("tag_id").alias("norm"), F.col("tag_id").alias("t2")), "norm", "left")
        .withColumn("k3", F.lower("raw"))
        .join(named.select(F.col("key").alias("k3"), F.col("tag").alias("t3")), "k3", "left")
        .join(named.select(F.col("key").alias("norm"), F.col("tag").alias("t4")), "norm", "left")
    )
    found = out.select("item_id", "pos", F.coalesce("t1", "t2", "t3", "t4").alias("tag")).filter(F.col("tag").isNotNull())
    return found.groupBy("item_id", "tag").agg(F.min("pos").alias("pos")).select("item_id", "pos", "tag")


# ------------------------------------------------------------------- reading


def library_lookup(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """Entities whose id is asked for."""
    return entities.join(ids.select("id"), "id", "left_semi")


def library_listing(entities: DataFrame, language: str) -> DataFrame:
    """One line per entity (id, display_name, aliases, source_title,
    source_aliases, reference_images, enabled): names in a language, the number
    of references, and a mark for those in use."""
    filled = F.filter("reference_images", lambda r: X.strip(r) != "")
    return entities.select(
        "id", L.localized_alias(F.col("display_name"), F.col("aliases"), language).alias("name"),
        L.localized_alias(F.col("source_title"), F.col("source_aliases"), language).alias("work"),
        F.coalesce(F.size(filled), F.lit(0)).cast("bigint").alias("reference_count"),
        F.when(F.col("enabled"), "✓").otherwise("").alias("mark"),
    )


def enabled_references(references: DataFrame, files: DataFrame) -> DataFrame:
    """``references(id, path, enabled)`` of entities in use whose file exists;
    an entity without a flag is in use."""
    return references.filter(F.coalesce("enabled", F.lit(True))).join(files.select("path"), "path", "left_semi")
