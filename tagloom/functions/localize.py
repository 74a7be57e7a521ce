"""Language codes and localised names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.text import humanize_id, infer_language, let, strip

LANGUAGES = ("zh-CN", "en-US", "ja-JP", "ko-KR")

# Exact spellings of language tags.
LANGUAGE_TAGS = {
    "zh": "zh-CN", "zh-cn": "zh-CN", "zh_cn": "zh-CN", "zh-hans": "zh-CN", "zh-tw": "zh-CN",
    "zh_tw": "zh-CN", "zh-hant": "zh-CN",
    "en": "en-US", "en-us": "en-US", "en_us": "en-US",
    "ja": "ja-JP", "ja-jp": "ja-JP", "ja_jp": "ja-JP",
    "ko": "ko-KR", "ko-kr": "ko-KR", "ko_kr": "ko-KR",
}

# Map keys and single fields that may hold a localised name.
NAME_KEYS = {
    "zh-CN": ("zh-CN", "zh_CN", "zh-Hans", "zh", "zh-hans"),
    "en-US": ("en-US", "en_US", "en", "en-us"),
    "ja-JP": ("ja-JP", "ja_JP", "ja", "ja-jp"),
    "ko-KR": ("ko-KR", "ko_KR", "ko", "ko-kr"),
}
NAME_FIELDS = {
    "zh-CN": ("name_zh_cn", "name_zh"),
    "en-US": ("name_en_us", "name_en"),
    "ja-JP": ("name_ja_jp", "name_ja", "name_en"),
    "ko-KR": ("name_ko_kr", "name_ko", "name_en"),
}


def language_code(c: Column, default: str = "zh-CN") -> Column:
    """Exact table lookup, the default for anything else."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_TAGS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(strip(c))), F.lit(default))


def language_code_by_prefix(c: Column, default: Column | str = "zh-CN") -> Column:
    """Prefix variant used by the entity library."""
    low = F.lower(strip(c))
    result = F.when(low.startswith("zh"), F.lit("zh-CN"))
    for code in LANGUAGES[1:]:
        result = result.when(low.startswith(code[:2]), F.lit(code))
    return result.otherwise(F.lit(default) if isinstance(default, str) else default)


def localized_name(names: Column, fields: dict[str, Column], tag_id: Column, language: str) -> Column:
    """Name by language: the name map, then single fields, then the humanised id."""
    blank_to_null = lambda c: F.nullif(strip(c), F.lit(""))
    tries = [blank_to_null(F.try_element_at(names, F.lit(k))) for k in NAME_KEYS[language]]
    tries += [blank_to_null(fields[f]) for f in NAME_FIELDS[language] if f in fields]
    late = ("name_zh", "name_en") if language == "zh-CN" else ("name_en",)
    tries += [blank_to_null(fields[f]) for f in late if f in fields]
    return F.coalesce(*tries, F.nullif(humanize_id(tag_id), F.lit("")), strip(tag_id))


def preferred_languages(requested: str, editor: bool = False) -> list[str]:
    order = ("ja-JP", "en-US", "zh-CN", "ko-KR") if editor else ("en-US", "ja-JP", "ko-KR", "zh-CN")
    return list(dict.fromkeys((requested, *order)))


def first_entries(entries: Column, key) -> Column:
    """Entries whose key was not seen earlier in the array, order kept."""
    return let(
        F.transform(entries, key),
        lambda keys: F.filter(entries, lambda e, i: F.array_position(keys, F.get(keys, i)) == i + 1),
    )


def alias_entry(name: Column, language: Column) -> Column:
    return let(
        strip(name),
        lambda text: F.struct(
            text.alias("name"), language_code_by_prefix(language, infer_language(text)).alias("language")
        ),
    )


def alias_entries(display_name: Column, entries: Column) -> Column:
    """Distinct (name, language) entries, the display name first.

    ``entries`` is ARRAY<STRUCT<name, language>>; an empty language is inferred
    from the letters of the name.
    """
    head = F.array(alias_entry(display_name, F.lit("")))
    tail = F.transform(F.coalesce(entries, F.array()), lambda e: alias_entry(e["name"], e["language"]))
    kept = F.filter(F.concat(head, tail), lambda e: e["name"] != "")
    return let(kept, lambda k: first_entries(k, lambda e: F.concat(F.lower(e["name"]), F.lit("\u0000"), e["language"])))


def alias_entries_from_variant(display_name: Column, items: Column) -> Column:
    """Same for ARRAY<VARIANT>, whose items are plain texts or objects."""

    def text(v: Column, *paths: str) -> Column:
        return F.coalesce(*[F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in paths])

    def entry(v: Column) -> Column:
        is_object = F.schema_of_variant(v).startswith("OBJECT")
        name = F.when(is_object, text(v, "$.name", "$.display_name", "$.value", "$.alias")).otherwise(
            F.try_variant_get(v, "$", "string")
        )
        language = F.when(is_object, text(v, "$.language", "$.lang"))
        return F.struct(
            F.coalesce(name, F.lit("")).alias("name"), F.coalesce(language, F.lit("")).alias("language")
        )

    return alias_entries(display_name, F.transform(items, entry))


def localized_alias(default: Column, entries: Column, language: str, editor: bool = False) -> Column:
    """First alias in the order of preferred languages, else the default text."""

    def pick(all_entries: Column) -> Column:
        def of(code: str) -> Column:
            return F.get(F.filter(all_entries, lambda e: e["language"] == code), F.lit(0))["name"]

        return F.coalesce(*[of(code) for code in preferred_languages(language, editor)])

    return F.coalesce(let(alias_entries(default, entries), pick), strip(default))


def provider_links(provider: Column, entity_id: Column, links: Column) -> Column:
    """Primary link, then listed links, distinct without regard to case."""

    def link(p: Column, e: Column) -> Column:
        return F.struct(
            F.coalesce(F.nullif(strip(p), F.lit("")), F.lit("manual")).alias("provider"),
            strip(e).alias("provider_entity_id"),
        )

    both = F.concat(
        F.array(link(provider, entity_id)),
        F.transform(F.coalesce(links, F.array()), lambda x: link(x["provider"], x["provider_entity_id"])),
    )
    kept = F.filter(both, lambda x: x["provider_entity_id"] != "")
    return let(kept, lambda k: first_entries(k, link_key))


def link_key(link: Column) -> Column:
    return F.lower(F.concat(link["provider"], F.lit(":"), link["provider_entity_id"]))
