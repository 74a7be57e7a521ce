"""Hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from tagloom.functions import boxes as B
from tagloom.functions import localize as L
from tagloom.functions import text as X
from tagloom.functions import vectors as V
from tagloom.operators import entities as N
from tagloom.operators import evidence as E
from tagloom.operators import references as R
from tagloom.operators import search as S
from tagloom.operators import tags as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "fn, text, want",
    [
        (X.normalize_token, " Two-Tone Hair! ", "two_tone_hair"),
        (X.normalize_token, "蓝发", ""),
        (X.match_key, "蔚蓝档案 Blue-Archive", "蔚蓝档案bluearchive"),
        (X.ascii_slug, "Orphie Magnusson & Magus", "orphie_magnusson_magus"),
        (X.source_slug, "|a|b (c)", "ab"),
        (X.source_slug, " - ", None),
        (X.release_date, "Released July 04, 2024 (1.0)", "2024-07-04"),
        (X.release_date, "Smarch 99, 2024", ""),
        (X.metadata_tokens, "a；b, c/d、a;??", ["a", "b", "c", "d"]),
        (X.humanize_id, "long_hair", "Long Hair"),
        (X.humanize_id, "2girls", "2Girls"),
        (X.extension, "a.b/c.JPG", ".jpg"),
        (X.extension, "a.b/.hidden", ""),
        (X.infer_language, "abc かな 漢字", "ja-JP"),
    ],
)
def test_text(spark, fn, text, want):
    assert one(spark, fn(F.lit(text))) == want


def test_canonical_sources_follow_their_table(spark):
    titles = ["Genshin - Chapter 2", "Genshin Impact Two", "Genshinx", "原神", "", None, "|a|b (c)", "Blue Archive", "blue_archives"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string")
    tables = [
        None, [("genshin", "genshin_impact"), ("原神", "genshin_impact"), ("Blue-Archive", "ba")],
        [("genshin", "other"), ("genshin impact", "longer"), ("ab", "letters"), ("", "nothing")],
    ]
    want = [
        ["genshin", "genshin_impact_two", "genshinx", "原神", "unknown_source", "unknown_source", "ab", "blue_archive", "blue_archives"],
        ["genshin_impact", "genshin_impact", "genshinx", "genshin_impact", "unknown_source", "unknown_source", "ab", "ba", "blue_archives"],
        ["other", "longer", "genshinx", "原神", "unknown_source", "unknown_source", "letters", "blue_archive", "blue_archives"],
    ]
    for rows, expected in zip(tables, want):
        aliases = None if rows is None else spark.createDataFrame(rows, "alias string, canonical string")
        got = N.canonical_sources(frame, "t", aliases, "key").orderBy("i").collect()
        assert [r.key for r in got] == expected


def test_two_sided_text(spark):
    lit = F.lit
    assert one(spark, X.lcs_len(lit("abcdxyz"), lit("zzcdxy"))) == 4
    assert one(spark, X.substring_overlap(lit("ab"), lit("xaby"))) == 2
    assert one(spark, S.matches_candidate(lit("初音未来"), lit("初音未x"), lit(""), F.array())) is True
    assert one(spark, S.matches_candidate(lit("初音未来"), lit("初音"), lit(""), F.array())) is True
    assert one(spark, S.matches_candidate(lit("初音未来"), lit("x初音y"), lit(""), F.array())) is False


def test_localized_alias(spark):
    entries = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("language")) for n, c in (("X", "ja-JP"), ("Y", "en-US"))])
    assert one(spark, L.localized_alias(F.lit("Y"), entries, "zh-CN")) == "Y"


def test_subject_count(spark):
    def count(*tags):
        rows = [(1, i, t, "general", s) for i, (t, s) in enumerate(tags)] or [(1, 0, "solo", "general", 0.9)]
        df = spark.createDataFrame(rows, "image_id int, pos int, tag string, category string, score double")
        nouns, flags = ("girl", "girls", "boy", "boys"), ("multiple_girls", "multiple_boys", "multiple_boys_and_girls")
        return T.subject_count(df, nouns, flags).first()["subject_count"]

    assert count(("2girls", 0.40), ("multiple_girls", 0.90)) == 2
    assert count(("multiple_girls", 0.90)) == 3
    assert count() == 1
    assert count(("6+girls", 0.50), ("6girls", 0.50)) == 3


def test_effective_threshold(spark):
    assert one(spark, T.effective_threshold(0.55, F.lit(2), 0.48)) == 0.48
    assert one(spark, T.effective_threshold(0.55, F.lit(1), 0.48)) == 0.55


def tag_list(spark, tags):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(tags)], "image_id int, pos int, tag string")


def in_order(df):
    return [r["tag"] for r in df.orderBy("pos").collect()]


def test_exclusive_fold(spark):
    groups = [("g1", ["a", "b"]), ("g2", ["b", "c"])]
    assert in_order(T.exclusive_first(tag_list(spark, "cba"), groups)) == ["c"]
    disjoint = [("g1", ["a", "b"]), ("g2", ["c"])]
    assert in_order(T.exclusive_first(tag_list(spark, "cba"), disjoint)) == ["c", "b"]


def test_category_cap(spark):
    taxonomy = spark.createDataFrame([("t1", "x"), ("t2", "x"), ("t3", "y"), ("t4", "x")], "tag_id string, category_id string")
    caps = spark.createDataFrame([("x", 2)], "category_id string, cap int")
    assert in_order(T.cap_categories(tag_list(spark, ["t1", "t2", "t3", "t4"]), taxonomy, caps)) == ["t1", "t2", "t3"]


def test_display_sort(spark):
    taxonomy = spark.createDataFrame([("t1", "B"), ("t2", "A")], "tag_id string, category_id string")
    ranks = spark.createDataFrame([("A", 0), ("B", 1)], "category_id string, rank int")
    none = spark.createDataFrame([], "tag_id string, rank int")
    assert in_order(T.display_sort(tag_list(spark, ["t1", "t2", "t3"]), taxonomy, ranks, none)) == ["t2", "t1", "t3"]


def test_preview(spark):
    tags = F.array(*[F.lit(f"t{i}") for i in range(10)])
    assert one(spark, T.preview_with_forced(tags, ["t8"])) == [f"t{i}" for i in range(7)] + ["t8"]


def box(l, t, r, b):
    return F.struct(*[F.lit(v).alias(k) for k, v in zip("ltrb", (l, t, r, b))])


def test_boxes(spark):
    assert one(spark, B.box_iou(box(0, 0, 10, 10), box(5, 5, 15, 15))) == pytest.approx(25 / 175)
    assert tuple(one(spark, B.crop_box(F.lit(200), F.lit(200), 0.2, 0.0, 0.8, 0.6))) == (40, 0, 160, 120)
    assert one(spark, B.crop_box(F.lit(100), F.lit(100), 0.2, 0.0, 0.8, 0.6)) is None


SPEC = V.AttributeSpec(hair=[("red", 0, "warm"), ("blue", 1, "cool"), ("aqua", 2, "cool")])


def features(spark, *vectors):
    df = spark.createDataFrame([(list(map(float, v)),) for v in vectors], "v array<double>").coalesce(1)
    return V.with_attribute_features(df.withColumn("n", F.monotonically_increasing_id()), "v", "f", SPEC)


def test_exclusive_attribute(spark):
    def term(q, r, bonus, penalty):
        a = features(spark, q).select(F.lit(1).alias("k"), F.col("f").alias("q"))
        b = features(spark, r).select(F.lit(1).alias("k"), F.col("f").alias("r"))
        return a.join(b, "k").select(V.exclusive_term(F.col("q"), F.col("r"), "hair", bonus, F.lit(penalty))).first()[0]

    assert term((0.2, 0.9, 0), (0.8, 0, 0), 0.11, 0.30) == pytest.approx(-0.24)
    assert term((0.2, 0.9, 0), (0, 0, 0.8), 0.11, 0.30) == pytest.approx(0.0704)


def test_detail_attribute(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, V.detail_term(arr(0.6), arr(0.5), 0.035, F.lit(0.05))) == pytest.approx(0.0175)
    assert one(spark, V.detail_term(arr(0.6), arr(0.1), 0.035, F.lit(0.05))) == pytest.approx(-0.03)


def test_correlation(spark):
    lit = F.lit
    both = lambda g: V.correlation_multiplier(lit("a"), lit(0.9), lit("b"), lit(0.9), F.array(lit(g[0])), F.array(lit(g[1])))
    assert one(spark, both("ab")) == pytest.approx(1.0815)
    assert one(spark, both("xy")) == pytest.approx(0.72864)


def test_relative_cutoff(spark):
    for rows, want in ((500, 0.56), (1500, 0.592), (2500, 0.608)):
        assert one(spark, E.secondary_ratio(F.lit(rows)) * 0.8) == pytest.approx(want)


def test_pairwise_mean(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("a", [1.0, 0.0]), ("b", [0.0, 0.0])], "k string, embedding array<double>")
    got = {r["k"]: r["mean_similarity"] for r in R.pair_statistics(df, "k").collect()}
    assert got == {"a": pytest.approx(1 / 3), "b": 1.0}


@pytest.mark.parametrize("labels, want", [("aaab", None), ("aab", ["a", "b"]), ("ab", ["a", "b"]), (["", "a"], None)])
def test_conflict(spark, labels, want):
    rows = R.attribute_conflict(spark.createDataFrame([("k", x) for x in labels], "k string, x string"), "k", "x").collect()
    assert (rows[0]["labels"] if rows else None) == want


def test_hashes(spark):
    assert one(spark, V.hamming_distance(F.lit(5), F.lit(3))) == 2
    assert one(spark, V.average_hash(F.array_repeat(F.lit(7), 64))) == -1


def test_dynamic_floor(spark):
    assert one(spark, R.dynamic_floor(F.lit(0.70))) == pytest.approx(0.60)


def test_priority_merge(spark):
    schema = "request_id int, ordinal int, provider string, provider_entity_id string, display_name string, source_title string"
    first = spark.createDataFrame([(1, 1, "p", "p1", "A", "S")], schema)
    second = spark.createDataFrame([(1, 1, "p", "p2", "a", "s"), (1, 2, "p", "p3", "B", "S")], schema)
    got = S.priority_merge(first, second, 10).orderBy("pos").collect()
    assert [r["provider_entity_id"] for r in got] == ["p1", "p3"]


def test_unseen_first_page(spark):
    pool = spark.createDataFrame([(1, i, k) for i, k in enumerate("abcd")], "session int, pos int, key string")
    seen = spark.createDataFrame([(1, "a"), (1, "b")], "session int, key string")
    got = S.unseen_first_page(pool, seen, 3).orderBy("rank").collect()
    assert [r["key"] for r in got] == ["c", "d", "a"]
