"""Text keys, tokens and predicates as Column expressions (no Python UDFs)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators that end the main part of a work title.
TITLE_SEPARATORS = (" - ", " – ", " — ", "|", "｜")
SOURCE_KEY_SEPARATORS = (" - ", " – ", " — ", "|", ":", "：", "（", "(")
SEARCH_KEY_SEPARATORS = (" - ", " – ", " — ", "|", ":", "(")
TOKEN_SEPARATORS = (" - ", " – ", " — ", "|", "(")

# The characters that count as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Code ranges that tell the writing system of a character.
HANGUL = r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}"
KANA = r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{FF66}-\x{FF9D}"
HAN = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}"
HAN_QUERY = (
    HAN + r"\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression once, so a long chain does not repeat it in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every kind of white space; NULL becomes the empty string."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")), F.lit(WHITE_SPACE))


def first_text(*cols: Column) -> Column:
    """First column that holds a non-blank text, trimmed; else empty."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in cols], F.lit(""))


def distinct_texts(arr: Column) -> Column:
    """Trimmed, non-empty values in first-seen order."""
    return F.array_distinct(F.filter(F.transform(arr, strip), lambda x: x != ""))


def distinct_case_free(arr: Column) -> Column:
    """As ``distinct_texts``, where spellings that differ in case are one value."""
    texts = F.filter(F.transform(arr, strip), lambda x: x != "")
    keys = lambda xs: F.transform(xs, F.lower)
    return let(texts, lambda xs: let(keys(xs), lambda ks: F.filter(xs, lambda x, i: F.array_position(ks, F.get(ks, i)) == i + 1)))


def normalize_token(c: Column) -> Column:
    """Lower-case ASCII token with '_' for '-' and blank.

    Names such as ``two-tone hair`` are normalised on both sides of a lookup,
    so raw and normalised spellings meet.
    """
    return F.regexp_replace(F.translate(F.lower(strip(c)), "- ", "__"), "[^a-z0-9_]+", "")


def normalize_token_unicode(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(strip(c)), "- ", "__"), r"[^\p{L}\p{N}_]+", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(normalize_token_unicode(c), "^_+|_+$", "")


def match_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", "")


def match_keys(arr: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(arr, match_key), lambda k: k != ""))


def ascii_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def ascii_slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _cut_before(text: Column, tokens: tuple[str, ...]) -> Column:
    """Text before the earliest token that does not open the text."""
    spots = [F.when(F.instr(text, t) > 1, F.instr(text, t)) for t in tokens]
    spot = F.least(*spots) if len(spots) > 1 else spots[0]
    return F.when(spot.isNull(), text).otherwise(strip(F.substring(text, F.lit(1), spot - 1)))


def _cutter(tokens: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda text: _cut_before(text, tokens)


UNKNOWN_SOURCE = "unknown_source"  # the key of an untitled work


def source_slug(c: Column) -> Column:
    """Work title without its suffix, slugged; NULL if nothing is left."""
    title = strip(c)
    for tokens in (TITLE_SEPARATORS, ("（",), ("(",)):
        title = let(title, _cutter(tokens))
    return F.coalesce(F.nullif(slug(title), F.lit("")), F.nullif(slug(c), F.lit("")))


def title_variant_keys(c: Column, separators: tuple[str, ...] = SOURCE_KEY_SEPARATORS) -> Column:
    text = strip(c)
    return match_keys(F.array(text, *[F.substring_index(text, s, 1) for s in separators]))


def _words(c: Column) -> Column:
    return F.filter(F.split(strip(c), r"(?U)[\s_]+"), lambda w: w != "")


def name_variant_keys(c: Column) -> Column:
    """Keys of a name and of its words in reverse order."""
    w = _words(c)
    return match_keys(F.array(strip(c), F.array_join(w, " "), F.array_join(F.reverse(w), " ")))


def tag_token(c: Column) -> Column:
    t = F.translate(F.lower(strip(c)), "’- ", "'__")
    t = F.regexp_replace(F.regexp_replace(t, "[^0-9a-z_:']", "_"), "_+", "_")
    return F.regexp_replace(t, "^_+|_+$", "")


def name_tokens(c: Column) -> Column:
    w = _words(c)
    raw = F.array(strip(c), F.array_join(w, "_"), F.array_join(F.reverse(w), "_"))
    return F.array_distinct(F.filter(F.transform(raw, tag_token), lambda t: t != ""))


def source_tokens(c: Column) -> Column:
    text = strip(c)
    raw = F.array(text, *[F.substring_index(text, s, 1) for s in TOKEN_SEPARATORS])
    return F.array_distinct(F.filter(F.transform(raw, tag_token), lambda t: t != ""))


def synthesized_tags(name: Column, source: Column) -> Column:
    """Every ``name_(source)`` tag of the name and source tokens."""
    src = source_tokens(source)
    pairs = F.transform(
        name_tokens(name),
        lambda n: F.transform(src, lambda s: F.concat(n, F.lit("_("), s, F.lit(")"))),
    )
    return F.array_distinct(F.flatten(pairs))


def split_aliases(c: Column) -> Column:
    return distinct_texts(F.split(strip(c), "[／/|,，、]+"))


def is_malformed_token(c: Column) -> Column:
    text = strip(c)
    return (text == "") | text.rlike(r"^[?？\x{FFFD}]+$")


def metadata_tokens(c: Column) -> Column:
    parts = distinct_texts(F.split(F.coalesce(c, F.lit("")), "[;；,，/、]"))
    return F.filter(parts, lambda t: ~is_malformed_token(t))


def strip_tag_prefix(c: Column) -> Column:
    return strip(F.regexp_replace(strip(c), r"^(标签|Tags|タグ|태그)[:：]\s*", ""))


def library_search_text(c: Column) -> Column:
    """Lower case without separators and symbols; the CJK ranges stay whole."""
    return F.regexp_replace(
        F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]+", ""
    )


def humanize_id(c: Column) -> Column:
    """'long_hair' -> 'Long Hair'; a letter after any non-letter is upper-cased."""
    text = strip(F.regexp_replace(strip(c), r"(?U)[_\-\s]+", " "))
    pieces = F.split(text, r"(?<=\P{L})(?=\p{L})")
    return F.array_join(F.transform(pieces, F.initcap), "")


def alias_pipe(arr: Column) -> Column:
    return F.array_join(distinct_texts(arr), "|")


def path_key(c: Column, root: str = "") -> Column:
    p = F.translate(c, "\\", "/")
    if root:
        p = F.when(p.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:)"), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))
    return F.lower(p)


def extension(c: Column) -> Column:
    """Lower-case extension with its dot, from the last path segment."""
    return F.lower(F.regexp_extract(c, r"[^/\\.][^/\\]*?(\.[^./\\]+)$", 1))


# ---------------------------------------------------------------- overlaps


def substring_overlap(a: Column, b: Column) -> Column:
    """Length of the text that the other one contains, 0 if neither does."""
    return (
        F.when((a == "") | (b == ""), F.lit(0))
        .when(F.contains(b, a), F.length(a))
        .when(F.contains(a, b), F.length(b))
        .otherwise(F.lit(0))
    )


def has_non_ascii_letters(c: Column) -> Column:
    return c.rlike(r"[\p{L}&&[^\x{00}-\x{7F}]]")


def minimum_match_length(c: Column) -> Column:
    return F.when(c == "", F.lit(0)).when(has_non_ascii_letters(c), F.lit(2)).otherwise(F.lit(4))


def meaningful_match(a: Column, b: Column) -> Column:
    return substring_overlap(a, b) >= 2


def lcs_len(a: Column, b: Column) -> Column:
    """Longest common substring length of two short keys, inside the JVM.

    The running best only grows, so one pass over the start positions is
    enough: a start extends the best by as many letters as still match.
    """

    def grow(best: Column, i: Column) -> Column:
        lengths = F.sequence(F.lit(1), F.length(a) - i + 1)
        fits = F.filter(lengths, lambda n: (n > best) & F.contains(b, F.substring(a, i, n)))
        return F.greatest(best, F.coalesce(F.array_max(fits), F.lit(0)))

    return F.when((a == "") | (b == ""), F.lit(0)).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), F.lit(0), grow)
    )


def shares_window(a: Column, b: Column, n: Column) -> Column:
    """True when some n-letter window of ``a`` occurs in ``b``."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(a) - n + 1, F.lit(1)))
    return (F.length(a) >= n) & F.exists(starts, lambda i: F.contains(b, F.substring(a, i, n)))


def name_variant_predicate(alias: Column, keys: Column) -> Column:
    key = match_key(alias)
    return (strip(alias) != "") & (
        has_non_ascii_letters(alias)
        | ((key != "") & F.exists(keys, lambda k: (k != "") & (F.contains(k, key) | F.contains(key, k))))
    )


# --------------------------------------------------------------- predicates


def looks_like_url(c: Column) -> Column:
    text = F.lower(strip(c))
    host = F.regexp_extract(text, r"^([^/?#:]*)", 1)
    return text.rlike(r"^(https?:)?//") | host.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$")


def is_han_query(c: Column) -> Column:
    return c.rlike(f"[{HAN_QUERY}]") & ~c.rlike(r"[\x{3040}-\x{30FF}]")


def infer_language(c: Column) -> Column:
    """Language told by the first Hangul, kana or Han character."""
    mark = F.regexp_extract(c, f"[{HANGUL}{KANA}{HAN}]", 0)
    return (
        F.when(mark.rlike(f"[{HANGUL}]"), F.lit("ko-KR"))
        .when(mark.rlike(f"[{KANA}]"), F.lit("ja-JP"))
        .when(mark != "", F.lit("zh-CN"))
        .when(c.rlike("[A-Za-z]"), F.lit("en-US"))
        .otherwise(F.lit("zh-CN"))
    )


# ---------------------------------------------------------- dates, maps, urls

# Rarity enums.
STAR_RARITY = {"QUALITY_ORANGE": "5", "QUALITY_ORANGE_SP": "5", "QUALITY_PURPLE": "4"}
GRADE_RARITY = {"4": "S", "3": "A", "2": "B"}


def release_date(c: Column) -> Column:
    text = F.regexp_extract(c, r"([A-Za-z]+ \d{2}, \d{4})", 1)
    day = F.try_to_timestamp(text, F.lit("MMMM dd, yyyy"))
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(""))


def date_prefix(c: Column) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, 10)


def _lookup(table: dict[str, str], key: Column, default: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), default)


def star_rarity(c: Column) -> Column:
    return _lookup(STAR_RARITY, F.coalesce(c, F.lit("")), F.lit(""))


def grade_rarity(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    return _lookup(GRADE_RARITY, text, text)


def url_variants(c: Column, media_host: str = "wikia.nocookie.net") -> Column:
    """The URL, then its full-size, original-file and query-less forms."""
    url = strip(c)
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    no_query = F.regexp_replace(url, r"\?[^#]*", "")
    path = F.regexp_extract(url, r"^([^?#]*)", 1)
    rest = F.substring(url, F.length(path) + 1, F.length(url))
    full_size = F.concat(
        F.regexp_replace(path, r"^(.*?/revision/latest)/scale-to-width-down/\d+", "$1"), rest
    )
    original = F.regexp_replace(path, r"/revision/latest.*$", "")
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    hosted = host.endswith(media_host)
    has_revision = hosted & F.contains(path, F.lit("/revision/latest"))
    return distinct_texts(
        F.array(
            url,
            F.when(hosted, full_size).otherwise(url),
            F.when(has_revision, F.concat(original, rest)).otherwise(url),
            F.when(has_revision, F.concat(original, fragment)).otherwise(url),
            F.when(url.rlike(r"^[^#]*\?[^#]"), no_query).otherwise(url),
        )
    )
