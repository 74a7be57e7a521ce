"""Derived inputs: rule tables and tables built from the given data.

Each text runs unchanged in Spark SQL and in the checking engine; tables of
the data folder are written ``@name``.
"""

from __future__ import annotations

from tagloom.plans.registry import Data, values

FIRST = ("blue", "cold", "hot", "large", "new", "old", "red", "small")
SECOND = ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")
UNKNOWN = {"old_rod", "new_rod"}

TAG_IDS = [f"{a}_{b}" for a in FIRST for b in SECOND if f"{a}_{b}" not in UNKNOWN]
ZH_WORDS = {"blue": "蓝", "red": "红", "hot": "热", "cold": "冷"}


def _name(tag: str) -> str | None:
    first, second = tag.split("_")
    return f"{ZH_WORDS[first]} {second}" if first in ZH_WORDS else None


# Canonical work keys and the spellings that lead to them: an input of the
# operators; these are the works that the queries know.
SOURCE_SPELLINGS = {
    "blue_archive": ("blue_archive", "bluearchive", "蔚蓝档案", "ブルーアーカイブ", "블루아카이브"),
    "genshin_impact": (
        "genshin_impact", "genshinimpact", "genshin", "yuanshen", "yuan_shen", "原神", "げんしん",
    ),
    "honkai_star_rail": (
        "honkai_star_rail", "honkai_starrail", "hsr", "崩坏星穹铁道", "崩壊スターレイル",
        "崩壞星穹鐵道", "붕괴스타레일",
    ),
    "honkai_impact_3rd": (
        "honkai_impact_3rd", "honkai_impact3rd", "崩坏3", "崩壊3rd", "붕괴3rd",
    ),
    "zenless_zone_zero": (
        "zenless_zone_zero", "zenlesszonezero", "zzz", "绝区零", "ゼンレスゾーンゼロ", "젠레스존제로",
    ),
}


RULES = {
    "source_aliases": values("alias, canonical", [(x, k) for k, spellings in SOURCE_SPELLINGS.items() for x in spellings]),
    "taxonomy": values(
        "tag_id, category_id, ordinal, name",
        [(t, t.split("_")[0], i, _name(t)) for i, t in enumerate(TAG_IDS)],
    ),
    # every tag under its own name, some under a second one, one deprecated id
    "aliases": values(
        "token, canonical_id, ordinal, deprecated",
        [(t.replace("_", " "), t, 10 * i, False) for i, t in enumerate(TAG_IDS)]
        + [(f"Small-{s}", f"large_{s}", 1000 + i, False) for i, s in enumerate(SECOND[:3])]
        + [("蓝色", "blue_anvil", 1100, False), ("old rod", "old_rod", 1101, False)]
        + [("old gizmo", "new_gizmo", 2000, True)],
    ),
    "blocked": values("tag_id", [("cold_plate",), ("hot_rod",)]),
    "thresholds": values(
        "scope, key, min_score",
        [("category", "red", 0.49), ("category", "new", 0.55), ("category", "old", 0.71), ("tag", "blue_bolt", 0.35), ("tag", "red_ring", 0.81)],
    ),
    "caps": values("category_id, cap", [("red", 1), ("blue", 2), ("small", 0)]),
    "category_rank": values("category_id, rank", [("red", 0), ("new", 1), ("blue", 2), ("cold", 3)]),
    "tag_rank": values("tag_id, rank", [("new_gear", 0), ("red_bolt", 1), ("blue_widget", 2), ("hot_anvil", 3)]),
    "work_map": values("token, work", [("blue_ring", "work_a"), ("red_ring", "work_b"), ("old_bolt", "work_b"), ("new_rod", "work_c")]),
    "head_weights": values(
        "tag, weight",
        [("blue ring", 0.35), ("Red-Ring", 0.18), ("new_bolt", 0.24), ("old gear", -0.45), ("hot plate", -0.20), ("cold_rod", 0.12)],
    ),
}
MINIMUM = 0.61
OVERLAPPING_GROUPS = [
    ("g1", ["red_ring", "blue_ring", "new_ring"]),
    ("g2", ["blue_ring", "hot_ring", "cold_ring"]),
    ("g3", ["large_bolt", "small_bolt", "new_bolt", "old_bolt"]),
]
DISJOINT_GROUPS = [
    ("first", [t for t in TAG_IDS if t.endswith(("_ring", "_rod"))]),
    ("second", [t for t in TAG_IDS if t.endswith(("_gear", "_bolt"))]),
]

PREDICTIONS = """
SELECT l_orderkey AS image_id, l_linenumber AS pos, p_name AS tag,
       CASE p_type WHEN 'PROMO' THEN 'copyright' WHEN 'STANDARD' THEN 'rating'
                   WHEN 'LARGE' THEN 'character' ELSE 'general' END AS category,
       l_quantity / 50.0 AS score
FROM @lineitem JOIN @part ON l_partkey = p_partkey
"""

COUNT_PREDICTIONS = """
SELECT l_orderkey AS image_id, l_linenumber AS pos,
       CASE WHEN l_returnflag = 'A' THEN concat('multiple ', split_part(p_name, ' ', 2))
            ELSE concat(CAST(l_linenumber AS VARCHAR(9)), split_part(p_name, ' ', 2)) END AS tag,
       CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 'rating' ELSE 'general' END AS category,
       l_quantity / 50.0 AS score
FROM @lineitem JOIN @part ON l_partkey = p_partkey
"""

IMAGES = """
SELECT o_orderkey AS image_id,
       concat(CASE WHEN o_orderstatus = 'F' THEN '/data/lib/' ELSE '/other/' END,
              CAST(o_orderkey AS VARCHAR(20)),
              CASE o_orderpriority WHEN '1-URGENT' THEN '.GIF' WHEN '5-LOW' THEN '.png' ELSE '.jpg' END) AS image_path,
       o_orderstatus AS status
FROM @orders
"""


def rule(data: Data, name: str):
    # a literal table of fixed size: one partition, so small rule joins need no shuffle
    return data.sql(RULES[name]).coalesce(1)


def rule_ctes() -> str:
    return ", ".join(f"{k} AS ({v})" for k, v in RULES.items())
