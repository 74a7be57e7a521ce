"""Queries over regions, scorers, streams and the reference augmentation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tagloom.functions import boxes as B
from tagloom.operators import models as M
from tagloom.operators import references as R
from tagloom.operators import regions as G
from tagloom.plans.entity_queries import PIXELS, _greedy, hashes
from tagloom.plans.fixtures import IMAGES as TAG_IMAGES
from tagloom.plans.registry import Data, query
from tagloom.plans.tag_queries import CTES as TAG_CTES
from tagloom.plans.tag_queries import NOW, RECORD_SQL, ROOT, flat_records, predictions, token_rules
from tagloom.plans.vector_queries import CTES, IDENTITY, _cos, identity_inputs, longs, rounded
from tagloom.session import delete_paths, work_folder
from tagloom.sources.files import parse_json_lines
from tagloom.streaming import streams as ST

WEIGHTS = [(0, 0.35), (5, 0.18), (9, 0.24), (13, 0.28), (20, 0.12), (31, -0.45), (40, -0.20), (50, 0.30)]

# one image per vector, its size from two components, its subject count from the label
IMAGES = """SELECT vec_id AS image_id, CAST(floor(60 + 900 * abs(CAST(embedding[{i1}] AS DOUBLE))) AS INT) AS width, CAST(floor(90 + 900 * abs(CAST(embedding[{i2}] AS DOUBLE))) AS INT) AS height,
 CAST(CASE WHEN label < 4 THEN 1 WHEN label < 7 THEN 2 ELSE 3 END AS INT) AS subject_count FROM @embeddings"""
DUCK_IMAGES = IMAGES.format(i1=2, i2=3)
SPARK_IMAGES = IMAGES.format(i1=1, i2=2)


def images(d: Data):
    full = F.transform("embedding", lambda x: F.abs(x.cast("double")) * 3.0)
    rows = d.embeddings.select(F.col("vec_id").alias("image_id"), full.alias("vector"))
    return d.sql(SPARK_IMAGES).join(rows, "image_id")


def crop_scorer(rows):
    """Stands in for a model: a fixed function of the image vector and the box."""
    v, b = F.col("full_vector" if "full_vector" in rows.columns else "vector"), F.col("box")
    return F.transform(v, lambda x, i: x * ((b["l"] + 3 * b["t"] + 5 * i) % 7 + 4) / 10.0)


def _list(rows) -> str:
    return "[" + ", ".join("[" + ", ".join(f"{x!r}e0" for x in row) + "]" for row in rows) + "]"


def _bands(middle: str, half: str, heights) -> str:
    return f"[{{'l': greatest(0e0, {middle} - {half}), 't': y[1], 'r': least(1e0, {middle} + {half}), 'b': y[2]}} FOR y IN {_list(heights)}]"


def _ratios(n: int) -> str:
    base = f"[{{'l': x[1], 't': x[2], 'r': x[3], 'b': x[4]}} FOR x IN {_list(B.BASE_REGIONS)}]"
    probes = f"flatten(flatten([[{_bands('c', 'w', B.PROBE_HEIGHTS)} FOR w IN {_list([B.PROBE_HALF_WIDTHS])}[1]] FOR c IN {_list([B.PROBE_CENTERS])}[1]]))"
    split = f"flatten([{_bands(f'((i + 0.5e0) * (1e0 / {n}))', f'(least(0.5e0, greatest(0.28e0, 0.95e0 / {n})) / 2e0)', B.SPLIT_HEIGHTS)} FOR i IN range(0, {n})])"
    return f"list_concat({split}, list_concat({base}, {probes}))" if n > 1 else f"list_concat({base}, {probes})"


BOXES = f"""img AS ({DUCK_IMAGES}), ratio AS (SELECT c, unnest(s) AS s, generate_subscripts(s, 1) AS o FROM (VALUES (1, {_ratios(1)}), (2, {_ratios(2)}), (3, {_ratios(3)})) v(c, s)),
px AS (SELECT image_id, width, height, subject_count, o, greatest(0, least(width - 1, round_even(width * s.l, 0)))::BIGINT AS l, greatest(0, least(height - 1, round_even(height * s.t, 0)))::BIGINT AS t, s FROM img JOIN ratio ON c = subject_count),
px2 AS (SELECT *, greatest(l + 1, least(width, round_even(width * s.r, 0)))::BIGINT AS r, greatest(t + 1, least(height, round_even(height * s.b, 0)))::BIGINT AS b FROM px),
fit AS (SELECT image_id, width, height, subject_count, l, t, r, b, min(o) AS o FROM px2 WHERE r - l >= 96 AND b - t >= 96 GROUP BY ALL),
box AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY o) - 1 AS box_no FROM fit)"""


@query("crop_box", f"WITH img AS ({DUCK_IMAGES}), c AS (SELECT image_id, greatest(0, round_even(width * 0.20, 0))::BIGINT AS l, round_even(width * 0.80, 0)::BIGINT AS r, round_even(height * 0.60, 0)::BIGINT AS b FROM img) SELECT image_id, l, CAST(0 AS BIGINT) AS t, r, b FROM c WHERE r - l >= 96 AND b >= 96")
def _(d):
    box = B.crop_box(F.col("width"), F.col("height"), 0.20, 0.0, 0.80, 0.60)
    rows = d.sql(SPARK_IMAGES).select("image_id", box.alias("x")).filter(F.col("x").isNotNull())
    return longs(rows.select("image_id", "x.l", "x.t", "x.r", "x.b"), "l", "t", "r", "b")


@query("candidate_boxes", f"WITH {BOXES} SELECT image_id, box_no, l, t, r, b FROM box")
def _(d):
    rows = G.explode_boxes(d.sql(SPARK_IMAGES)).select("image_id", "box_no", "box.l", "box.t", "box.r", "box.b")
    return longs(rows, "box_no", "l", "t", "r", "b")


@query("box_distinct", f"WITH {BOXES} SELECT image_id, count(*) AS boxes FROM box GROUP BY image_id")
def _(d):
    sizes = B.candidate_boxes(F.col("width"), F.col("height"), F.col("subject_count"))
    return longs(d.sql(SPARK_IMAGES).select("image_id", F.size(sizes).alias("boxes")).filter(F.col("boxes") > 0), "boxes")


def _iou(a: str, b: str) -> str:
    w, h = f"(least({a}.r, {b}.r) - greatest({a}.l, {b}.l))", f"(least({a}.b, {b}.b) - greatest({a}.t, {b}.t))"
    area = lambda x: f"(({x}.r - {x}.l) * ({x}.b - {x}.t))"
    return f"(CASE WHEN {w} <= 0 OR {h} <= 0 THEN 0 ELSE ({w} * {h})::DOUBLE / ({area(a)} + {area(b)} - {w} * {h})::DOUBLE END)"


@query("box_iou", f"WITH {BOXES} SELECT x.image_id, x.box_no, round({_iou('x', 'y')}, 6) AS iou FROM box x JOIN box y ON x.image_id = y.image_id AND y.box_no = x.box_no + 1")
def _(d):
    rows = G.explode_boxes(d.sql(SPARK_IMAGES)).select("image_id", "box_no", "box")
    nxt = rows.select("image_id", (F.col("box_no") - 1).alias("box_no"), F.col("box").alias("other"))
    iou = rows.join(nxt, ["image_id", "box_no"]).select("image_id", "box_no", B.box_iou(F.col("box"), F.col("other")).alias("iou"))
    return longs(rounded(iou, "iou"), "box_no")


VECTOR = "list_transform(range(1, 65), lambda i: abs(CAST(embedding[i] AS DOUBLE)) * 3.0 * ((l + 3 * t + 5 * (i - 1)) % 7 + 4) / 10.0)"
HEAD = "greatest(0, " + " + ".join(f"least(1.0, v[{p + 1}]) * {w}" for p, w in WEIGHTS) + ")"
SCORED = BOXES + f""", vec AS (SELECT box.*, {VECTOR} AS v FROM box JOIN embeddings ON vec_id = image_id),
scored AS (SELECT *, {HEAD} AS head, ((r - l) * (b - t))::DOUBLE / (width * height)::DOUBLE AS area FROM vec),
eff AS (SELECT *, head - greatest(0, area - 0.18) * 0.60 AS e FROM scored)"""


@query("effective_region_score", f"WITH {SCORED} SELECT image_id, box_no, round(head, 6) AS head_score, round(e, 6) + 0.0 AS effective, round(0.95 + least(0.30, greatest(0, head)), 6) AS weight FROM eff")
def _(d):
    rows = G.score_boxes(G.explode_boxes(images(d)), crop_scorer, WEIGHTS)
    out = rows.select("image_id", "box_no", "head_score", "effective", B.region_weight(F.col("head_score")).alias("weight"))
    return longs(rounded(out, "head_score", "effective", "weight"), "box_no")


@query("nms_select", f"""WITH RECURSIVE {SCORED}, seq AS (SELECT *, subject_count AS target, row_number() OVER (PARTITION BY image_id ORDER BY round(e, 12) DESC, area, box_no) AS n FROM eff WHERE box_no < CASE WHEN subject_count <= 1 THEN 12 ELSE 16 END),
walk AS (SELECT image_id, n, [{{'box_no': box_no, 'l': l, 't': t, 'r': r, 'b': b, 'v': v}}] AS ch FROM seq WHERE n = 1
 UNION ALL SELECT w.image_id, s.n, CASE WHEN len(ch) >= s.target OR len(list_filter(ch, lambda c: {_iou('c', 's')} >= 0.28 OR {_cos('c.v', 's.v')} >= 0.985)) > 0 THEN ch
   ELSE list_append(ch, {{'box_no': s.box_no, 'l': s.l, 't': s.t, 'r': s.r, 'b': s.b, 'v': s.v}}) END FROM walk w JOIN seq s ON s.image_id = w.image_id AND s.n = w.n + 1),
done AS (SELECT image_id, arg_max(ch, n) AS ch FROM walk GROUP BY 1) SELECT image_id, CAST(i AS BIGINT) AS rank, ch[i].box_no AS box_no FROM (SELECT image_id, ch, unnest(range(1, len(ch) + 1)) AS i FROM done)""")
def _(d):
    rows = G.explode_boxes(images(d)).filter(F.col("box_no") < F.when(F.col("subject_count") <= 1, 12).otherwise(16))
    chosen = G.nms_select(G.score_boxes(rows, crop_scorer, WEIGHTS))
    out = chosen.select("image_id", F.posexplode("chosen").alias("rank", "c"))
    return out.select("image_id", (F.col("rank") + 1).cast("bigint").alias("rank"), F.col("c.box_no").cast("bigint").alias("box_no"))


def _walk(name: str, source: str) -> str:
    """Greedy choice over a ranked list of boxes: ``{name}_done(image_id, ch)``."""
    return f"""{name}_seq AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(e, 12) DESC, area, box_no) AS n FROM ({source})),
{name}_walk AS (SELECT image_id, n, [{{'l': l, 't': t, 'r': r, 'b': b, 'v': v, 'head': head}}] AS ch FROM {name}_seq WHERE n = 1
 UNION ALL SELECT w.image_id, s.n, CASE WHEN len(ch) >= s.subject_count OR len(list_filter(ch, lambda c: {_iou('c', 's')} >= 0.28 OR {_cos('c.v', 's.v')} >= 0.985)) > 0 THEN ch
   ELSE list_append(ch, {{'l': s.l, 't': s.t, 'r': s.r, 'b': s.b, 'v': s.v, 'head': s.head}}) END FROM {name}_walk w JOIN {name}_seq s ON s.image_id = w.image_id AND s.n = w.n + 1),
{name}_done AS (SELECT image_id, arg_max(ch, n) AS ch FROM {name}_walk GROUP BY 1)"""


def _crop(i: int, box: tuple, weight: float) -> str:
    l, t, r, b = box
    return f"""SELECT image_id, {i + 1} AS region, {weight!r} AS weight, l, t FROM (SELECT image_id, x.l, x.t, greatest(x.l + 1, least(width, round_even(width * {r!r}, 0)))::BIGINT AS r, greatest(x.t + 1, least(height, round_even(height * {b!r}, 0)))::BIGINT AS b
 FROM (SELECT image_id, width, height, greatest(0, least(width - 1, round_even(width * {l!r}, 0)))::BIGINT AS l, greatest(0, least(height - 1, round_even(height * {t!r}, 0)))::BIGINT AS t FROM img) x) WHERE r - l >= 96 AND b - t >= 96"""


@query("region_queries", f"""WITH RECURSIVE {SCORED},
{_walk('one', "SELECT * FROM eff WHERE box_no < CASE WHEN subject_count <= 1 THEN 12 ELSE 16 END")},
again AS (SELECT img.image_id FROM img LEFT JOIN one_done d USING (image_id) WHERE d.image_id IS NULL OR len(ch) < subject_count OR ch[1].head < 0.30),
{_walk('two', "SELECT * FROM eff WHERE image_id IN (SELECT image_id FROM again) AND box_no < CASE WHEN subject_count <= 1 THEN 20 ELSE 26 END")},
chosen AS (SELECT * FROM one_done WHERE image_id NOT IN (SELECT image_id FROM again) UNION ALL SELECT * FROM two_done),
heads AS (SELECT image_id, i AS region, 0.95 + least(0.30, greatest(0, ch[i].head)) AS weight, ch[i].v AS v FROM (SELECT *, unnest(range(1, len(ch) + 1)) AS i FROM chosen)),
crops AS ({" UNION ALL ".join(_crop(i, box, w) for i, (box, w) in enumerate(B.FALLBACK_REGIONS))}),
fixed AS (SELECT c.image_id, region, weight, {VECTOR} AS v FROM crops c JOIN embeddings ON vec_id = c.image_id WHERE c.image_id NOT IN (SELECT image_id FROM heads)),
every AS (SELECT vec_id AS image_id, 0 AS region, {B.FULL_IMAGE_WEIGHT!r} AS weight, list_transform(range(1, 65), lambda i: abs(CAST(embedding[i] AS DOUBLE)) * 3.0) AS v FROM embeddings
 UNION ALL SELECT * FROM heads UNION ALL SELECT * FROM fixed)
SELECT image_id, CAST(region AS BIGINT) AS region, round(CAST(weight AS DOUBLE), 6) AS weight, round(list_sum(v), 4) AS total FROM every""")
def _(d):
    rows = G.region_queries(images(d), crop_scorer, WEIGHTS)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return rows.select("image_id", F.col("region").cast("bigint").alias("region"), F.round("weight", 6).alias("weight"), F.round(total, 4).alias("total"))


# --------------------------------------------------------------------- scorers


def make_predict():
    """A fixed 64 x 64 linear model with a clip to 0..1."""
    matrix = ((np.arange(64)[:, None] * 3 + np.arange(64)[None, :] * 5) % 11) / 10.0

    def predict(inputs: np.ndarray) -> np.ndarray:
        return np.clip(np.asarray(inputs, dtype=np.float64) @ matrix, 0.0, 1.0)

    return predict


SCORES = "list_transform(range(0, 64), lambda j: greatest(0.0, least(1.0, list_sum(list_transform(range(0, 64), lambda i: CAST(embedding[i + 1] AS DOUBLE) * ((i * 3 + j * 5) % 11) / 10.0)))))"


def scored(d: Data):
    score = M.vector_scorer(make_predict, 64)
    return M.model_score(d.embeddings.select("vec_id", "label", "embedding"), score("embedding"))


@query("model_score", f"WITH s AS (SELECT vec_id, {SCORES} AS s FROM @embeddings) SELECT vec_id, CAST(i - 1 AS BIGINT) AS pos, round(s[i], 5) AS score FROM (SELECT *, unnest(range(1, 65)) AS i FROM s)")
def _(d):
    rows = scored(d).select("vec_id", F.posexplode("scores").alias("pos", "score"))
    return longs(rounded(rows, "score", digits=5), "pos")


@query("explode_predictions", f"""WITH s AS (SELECT vec_id, {SCORES} AS s FROM @embeddings), v AS (SELECT p_partkey AS pos, p_name, p_type FROM @part)
SELECT vec_id, CAST(i - 1 AS BIGINT) AS pos, p_name AS tag, p_type AS category, round(s[i], 5) AS score FROM (SELECT *, unnest(range(1, 65)) AS i FROM s) JOIN v ON pos = i - 1""")
def _(d):
    vocab = d.part.select(F.col("p_partkey").cast("int").alias("pos"), F.col("p_name").alias("name"), F.col("p_type").alias("category"))
    return longs(rounded(M.explode_predictions(scored(d), vocab, "vec_id", "scores"), "score", digits=5), "pos")


def make_embedder():
    """Fails on inputs whose first value is large, like an unreadable file."""
    return lambda items: [None if x is None or x[0] > 0.1 else [float(y) * 2.0 for y in x] for x in items]


EMBEDDED = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 2.0) AS v FROM @embeddings),
u AS (SELECT vec_id, label, CASE WHEN v[1] <= 0.2 THEN list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) END AS v FROM e)"""


def _weighted(v: str):
    """All components, each with its place as weight."""
    return F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)


@query("image_embed", f"WITH {EMBEDDED} SELECT vec_id, round(v[4], 5) + 0.0 AS fourth, CAST(len(v) AS BIGINT) AS dimension, round(list_sum(list_transform(range(1, 65), lambda i: v[i] * i)), 4) + 0.0 AS weighted FROM u")
def _(d):
    rows = M.image_embed(d.embeddings, M.content_scorer(make_embedder)(F.col("embedding")))
    size = F.when(F.col("vector").isNotNull(), F.size("vector")).cast("bigint")
    out = rows.select("vec_id", F.get("vector", F.lit(3)).alias("fourth"), size.alias("dimension"), (F.round(_weighted("vector"), 4) + 0.0).alias("weighted"))
    return rounded(out, "fourth", digits=5)


@query("build_reference_vectors", f"""WITH {EMBEDDED} SELECT CAST(label AS VARCHAR) AS character_id, n_name AS character_name, 'f/' || e.vec_id AS image_path, CAST(64 AS BIGINT) AS dimension,
 round(list_sum(list_transform(range(1, 65), lambda i: v[i] * i)), 4) + 0.0 AS weighted FROM e JOIN @nation ON n_nationkey = label WHERE n_regionkey < 4 AND NOT v[1] > 0.2""")
def _(d):
    path = F.concat(F.lit("f/"), "vec_id")
    refs = d.embeddings.select(F.col("label").cast("string").alias("character_id"), F.col("vec_id").alias("pos"), path.alias("path"))
    files = d.embeddings.select(path.alias("path"), F.col("embedding").alias("content"))
    names = d.nation.select(F.col("n_nationkey").cast("string").alias("character_id"), F.col("n_name").alias("character_name"), F.when(F.col("n_regionkey") >= 4, F.lit(False)).alias("enabled"))
    rows = M.build_reference_vectors(refs, files, M.content_scorer(make_embedder), names)
    weighted = (F.round(_weighted("embedding"), 4) + 0.0).alias("weighted")
    return rows.select("character_id", "character_name", "image_path", F.size("embedding").cast("bigint").alias("dimension"), weighted)


# --------------------------------------------------------------------- streams


def in_batches(rows, order: str, batches: int):
    """The rows in ``batches`` steps of ascending ``order``."""
    last = rows.agg(F.max(order)).first()[0]
    for i in range(batches):
        yield rows.filter(F.floor(F.col(order) * batches / (last + 1)) == i)


def written_batches(rows, order: str, batches: int, path: str, write) -> int:
    """Write rows in ``batches`` steps of ascending ``order``, each by several
    tasks; the number of files that each step has."""
    files = 4
    for step in in_batches(rows, order, batches):
        write(step.repartition(files), path)
    return files


def event_stream(d: Data, batches: int, session=None):
    path = work_folder(d.spark, "events")
    files = written_batches(d.events, "event_id", batches, path, lambda df, to: df.write.mode("append").parquet(to))
    return (session or d.spark).readStream.schema(d.events.schema).option("maxFilesPerTrigger", files).parquet(path)


PREDICTION = "image_id BIGINT, image_path STRING, n_rows BIGINT, pos BIGINT, tag STRING, category STRING, score DOUBLE"


def prediction_rows(d: Data, path: str):
    """Predictions with their image's path and number of rows, and the place in the stream."""
    rows = predictions(d).repartition("image_id")  # one shuffle for the numbers and the rows
    counts = rows.groupBy("image_id").agg(F.countDistinct("pos", "tag", "category", "score").alias("n_rows"))
    sizes = d.sql(TAG_IMAGES).select("image_id", "image_path").join(counts, "image_id", "left")
    found = sizes.join(rows, "image_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    found = found.withColumn("at", F.pmod(F.xxhash64("image_id", "pos"), F.lit(300)))
    found.write.option("compression", "zstd").parquet(path)
    return d.spark.read.schema(found.schema).parquet(path)


@query("stream_records", TAG_CTES + f", {RECORD_SQL} SELECT *, FALSE AS review_required, 'labeled_draft' AS status, '{NOW}' AS created_at FROM records")
def _(d):
    """Prediction lines, broken ones among them, come in batches that cut through the images.

    The stream is started again for each batch of lines; lines that were read
    to the end go."""
    out = work_folder(d.spark, "records")
    # all files are compressed well, so a split of the usual size would hold very many rows
    session = ST.own_session(d.spark, ST.DROP_SHUFFLES | {"spark.sql.files.maxPartitionBytes": "16m"})
    found = prediction_rows(Data(session, d.folder), f"{out}/predictions")
    good = F.to_json(F.struct(*[x.split()[0] for x in PREDICTION.split(", ")]))
    pair = F.explode(F.when(F.xxhash64("image_id", "pos") % 5 == 0, F.array(good, F.substring(good, 1, 9), F.lit("log line"))).otherwise(F.array(good)))
    rules, batches = token_rules(d), 3
    for i, step in enumerate(in_batches(found, "at", batches)):
        step.select(pair.alias("value")).write.option("compression", "gzip").text(f"{out}/lines")
        if i == batches - 1:
            delete_paths(d.spark, [f"{out}/predictions"])
        lines = parse_json_lines(session.readStream.text(f"{out}/lines"), "value", PREDICTION)
        ST.stream_annotations(lines, rules, 0.85, ROOT, NOW, f"{out}/rows", f"{out}/checkpoint")
        delete_paths(d.spark, [f"{out}/lines"])
    return flat_records(ST.read_annotations(d.spark, f"{out}/rows")).withColumn("image_id", F.col("image_id").cast("bigint"))


@query("stream_latest_by_key", "SELECT '/u/' || user_id AS path_key, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM @events GROUP BY user_id")
def _(d):
    out = work_folder(d.spark, "latest")
    rows = event_stream(d, 3).select(F.concat(F.lit("/U/"), "user_id").alias("path"), "event_id", "event_type")
    ST.stream_latest(rows, "path", "event_id", f"{out}/rows", f"{out}/checkpoint", buckets=16)
    return ST.read_latest(d.spark, f"{out}/rows", "event_id").select("path_key", "event_id", "event_type")


def _page_sql(batch: int) -> str:
    """The page of a batch: keys that no earlier page showed first, each kind by position."""
    shown = " UNION ALL ".join(f"SELECT session, key FROM p{i}" for i in range(batch)) or "SELECT session, key FROM k WHERE false"
    return f"""p{batch} AS (SELECT * FROM (SELECT k.*, row_number() OVER (PARTITION BY k.session ORDER BY s.key IS NOT NULL, pos) AS rank
  FROM k LEFT JOIN (SELECT DISTINCT * FROM ({shown})) s ON s.session = k.session AND s.key = k.key WHERE batch = {batch}) WHERE rank <= 4)"""


@query("stream_unseen_session", f"""WITH k AS (
  SELECT user_id AS session, CAST(floor(event_id * 3 / (last + 1)) AS BIGINT) AS batch, event_type || '-' || CAST(floor(value / 20) AS BIGINT) AS key, min(event_id) AS pos
  FROM @events, (SELECT max(event_id) AS last FROM @events) GROUP BY ALL),
{_page_sql(0)}, {_page_sql(1)}, {_page_sql(2)}
SELECT session, rank, key, pos, batch FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2)""")
def _(d):
    out = work_folder(d.spark, "unseen")
    key = F.concat_ws("-", "event_type", F.floor(F.col("value") / 20).cast("string"))
    pools = lambda session: event_stream(d, 3, session).select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), key.alias("key"))
    ST.stream_unseen_pages(d.spark, pools, 4, f"{out}/rows", f"{out}/checkpoint")
    return d.spark.read.parquet(f"{out}/rows").select("session", F.col("rank").cast("bigint").alias("rank"), "key", "pos", F.col("batch").cast("bigint").alias("batch"))


# ---------------------------------------------------------------- augmentation

AUGMENT = IDENTITY.replace("FROM ids WHERE entity_id NOT IN ('9', '6')", "FROM old").replace("seed_all AS", "old AS (SELECT * FROM ids JOIN (SELECT row_index AS pos, v[4] AS v4 FROM refs) x USING (pos) WHERE v4 = 0 AND entity_id NOT IN ('9', '6')),\nquota AS (SELECT e.entity_id, greatest(0, 30 - count(o.pos)) AS quota FROM (SELECT DISTINCT entity_id FROM ids) e LEFT JOIN old o USING (entity_id) GROUP BY 1),\nseed_all AS", 1).replace("rank <= 12", "rank <= (SELECT quota FROM quota q WHERE q.entity_id = kept0.entity_id)")


NEW_FILES = """SELECT entity_id AS label, h, TRUE AS old, pos AS o FROM old JOIN hs ON vec_id = pos
  UNION ALL SELECT entity_id, h, FALSE, 1000000000000 + rank FROM kept JOIN hs ON vec_id = pos WHERE entity_id IN (SELECT entity_id FROM quota WHERE quota > 0)"""


@query("reference_augment", CTES.replace("WITH", "WITH RECURSIVE", 1) + AUGMENT + f""", {PIXELS}, {_greedy(NEW_FILES, "s.old")}
SELECT q.entity_id, coalesce(n, 0) AS added, CAST(quota AS BIGINT) AS quota FROM quota q
 LEFT JOIN (SELECT label, count(*) AS n FROM seq JOIN walk USING (label, n) WHERE taken AND NOT old GROUP BY label) x ON x.label = q.entity_id WHERE quota > 0""")
def _(d):
    """Quota, identity filter, near-duplicate check against the references, summary."""
    rows, avatars, _ = identity_inputs(d)
    fourth = d.embeddings.select(F.col("vec_id").alias("pos"), (F.get("embedding", F.lit(3)) <= 0).alias("old"))
    h = hashes(d).select(F.col("vec_id").alias("pos"), "h")
    references = rows.join(fourth.filter("old").drop("old"), "pos", "left_semi").filter(~F.col("entity_id").isin("6", "9")).join(h, "pos")
    files = rows.join(h, "pos").withColumns({"source": F.lit("new.png"), "folder": F.lit("refs"), "sha1": F.sha1(F.col("path").cast("binary"))})
    _, summary = R.reference_augment(files, avatars, references, 30)
    return summary.select("entity_id", "added", F.col("quota").cast("bigint").alias("quota"))
