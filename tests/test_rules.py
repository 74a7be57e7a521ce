"""Rule documents against the laws written out with lists and dictionaries."""

import json

from pyspark.sql import functions as F

from tagloom.operators.ranking import running_numbers
from tagloom.sources.rules import alias_rows, category_caps, display_layers, exclusive_groups, post_rules, ranked_lists, read_documents, rule_tables, taxonomy


def documents(spark, base, *extensions):
    rows = [(0, 0, json.dumps(base))] + [(1, i, json.dumps(x) if not isinstance(x, str) else x) for i, x in enumerate(extensions)]
    return spark.createDataFrame(rows, "layer int, number bigint, body string").repartition(3)


def tag(i, name):
    return {"id": i, "name_en": name}


def test_categories_and_groups(spark):
    base = {
        "categories": [
            {"id": "hair", "tags": [tag("a", "A"), tag(" b ", "B"), tag("b", "B again"), {"name_en": "no id"}, 5]},
            {"id": "eyes", "tags": [tag("c", "C"), tag("a", "A in eyes")]},
            {"id": "", "tags": [tag("lost", "L")]}, 7, {"id": "none"},
        ],
        "mutually_exclusive_groups": {"z first": [" a", "b", "b", 3], "kept": [" raw ", " raw "], "broken": "text"},
    }
    one = {"taxonomy": {
        "categories": [{"id": "hair ", "tags": [tag("a", "other A"), tag("d", "D"), tag("d", "D again")]}, {"id": "new", "tags": [tag("e", "E"), tag("e", "E again")]}],
        "mutually_exclusive_groups": {"z first": ["b ", "q", ""], "added": ["x"], "broken": ["y"], "kept": "no list"}}}
    two = {"taxonomy": {"categories": [{"id": "new", "tags": [tag("e", "third E"), tag("f", "F")]}, "x"], "mutually_exclusive_groups": [1]}}
    docs = documents(spark, base, one, two, "[1]", "broken", '{"taxonomy": 5}')
    got = [(r.tag_id, r.category_id, json.loads(r.body)["name_en"]) for r in taxonomy(docs).orderBy("ordinal").collect()]
    assert got == [("b", "hair", "B again"), ("d", "hair", "D"), ("c", "eyes", "C"), ("a", "eyes", "A in eyes"), ("e", "new", "E again"), ("f", "new", "F")]
    groups = [(r.name, r.ordinal, r.value) for r in exclusive_groups(docs).orderBy("name_ordinal", "ordinal").collect()]
    assert groups == [("z first", 0, "a"), ("z first", 1, "b"), ("z first", 2, "3"), ("z first", 3, "q"), ("kept", 0, " raw "), ("added", 0, "x"), ("broken", 0, "y")]


def test_priority_rules(spark):
    base = {
        "tag_priority_order": [" a ", "b", "a", 3, None, ""], "display_tag_priority": "none", "adult_display_layers": {"low": [" x", "x"], "high": ["y", "z"]},
        "conflict_resolution": {"blocked_tags": ["q"], "max_tags_per_category": {"hair": 3, "eyes": "4", "bad": "x", "neg": -2}},
        "post_rules": [{"id": "r1", "v": 1}, {"v": "no id"}, {"id": "r1", "v": 2}],
    }
    one = {"priority_rules": {
        "tag_priority_order": ["c", "b"], "display_tag_priority": ["t"], "adult_display_layers": {" high ": ["w", "y", 4], "": ["n"], "top": ["o"]},
        "conflict_resolution": {"blocked_tags": ["r", "q"], "adult_hard_review_tags": ["h"], "max_tags_per_category": {"hair": "no", "eyes": -1, "new": 2.7, "flag": True, "half": "2.5", "list": [1], "gone": None}},
        "post_rules": [{"id": "r1", "v": 9}, {"id": " r2 ", "v": 3}, {"id": "r2", "v": 4}, {"v": 5}, 6]}}
    two = {"priority_rules": {"conflict_resolution": {"max_tags_per_category": {"hair": " 7 "}}, "post_rules": {"id": "r3"}}}
    docs = documents(spark, base, one, two)
    lists = [(r["list"], r.ordinal, r.value) for r in ranked_lists(docs).orderBy("list", "ordinal").collect()]
    assert lists == [
        ("adult_hard_review_tags", 0, "h"), ("blocked_tags", 0, "q"), ("blocked_tags", 1, "r"), ("display_tag_priority", 0, "t"),
        ("tag_priority_order", 0, "a"), ("tag_priority_order", 1, "b"), ("tag_priority_order", 2, "c")]
    layers = [(r.name, r.value) for r in display_layers(docs).orderBy("name_ordinal", "ordinal").collect()]
    assert layers == [("low", " x"), ("low", "x"), ("high", "y"), ("high", "z"), ("high", "w"), ("top", "o")]
    assert {r.category_id: r.cap for r in category_caps(docs).collect()} == {"hair": 7, "eyes": 0, "neg": -2, "new": 2, "flag": 1}
    rules = [(r.rule_id, json.loads(r.body)["v"]) for r in post_rules(docs).orderBy("ordinal").collect()]
    assert rules == [("r1", 1), ("", "no id"), ("r1", 2), ("r2", 3)]


def test_aliases(spark):
    base = {"canonical_to_aliases": {"blue_hair": ["Blue", " azure "], "red_hair": "none", " ": ["x"]}, "deprecated_tags": {"old": "blue_hair", "older": "red_hair"}}
    one = {"synonyms": {"canonical_to_aliases": {"blue_hair": ["azure", "navy", ""], "green_hair": []}, "deprecated_tags": {"old": " green_hair ", "x": ""}}}
    got = [(r.token, r.canonical_id, r.deprecated) for r in alias_rows(documents(spark, base, one)).orderBy("ordinal").collect()]
    assert got == [
        ("blue_hair", "blue_hair", False), ("Blue", "blue_hair", False), ("azure", "blue_hair", False), ("navy", "blue_hair", False),
        ("red_hair", "red_hair", False), ("green_hair", "green_hair", False), ("old", "green_hair", True), ("older", "red_hair", True)]


def test_files_in_order_and_nothing_at_all(spark, tmp_path):
    for folder, name, body in (("base", "t.json", {"tag_priority_order": ["a"]}), ("ext", "b.json", {"priority_rules": {"tag_priority_order": ["c"]}}), ("ext", "a.json", {"priority_rules": {"tag_priority_order": ["b"]}})):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(json.dumps(body, indent=1))
    docs = read_documents(spark, str(tmp_path / "base"), [str(tmp_path / "ext")])
    assert [r.value for r in ranked_lists(docs).orderBy("ordinal").collect()] == ["a", "b", "c"]
    empty = docs.limit(0)
    assert all(t.collect() == [] for t in rule_tables(empty, empty, empty).values())


def test_running_numbers(spark):
    rows = spark.range(5000).select((F.col("id") % 7 == 0).alias("k"), F.when(F.col("id") % 7 != 1, F.col("id") % 3).alias("g"), F.struct(F.xxhash64("id").alias("x"), "id").alias("o"))
    got = running_numbers(rows, ["k", "g"], ["o"]).collect()
    groups = {}
    for r in got:
        groups.setdefault((r.k, r.g), []).append(r)
    assert sum(map(len, groups.values())) == 5000
    for part in groups.values():
        assert [r.n for r in sorted(part, key=lambda r: tuple(r.o))] == list(range(len(part)))
    assert sorted(r.n for r in running_numbers(rows, [], ["o"]).collect()) == list(range(5000))
