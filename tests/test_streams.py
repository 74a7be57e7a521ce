"""Streams: images assembled over batches, the bucketed table of last records,
settings of other streams; and vectors that match nothing."""

import json
import math
import random
import time
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagloom.operators import retrieval
from tagloom.operators import tags as T
from tagloom.operators.retrieval import vector_topk
from tagloom.plans import load_all, region_queries
from tagloom.plans.region_queries import PREDICTION
from tagloom.plans.registry import QUERIES, Data
from tagloom.plans.tag_queries import token_rules
from tagloom.sources.files import parse_json_lines
from tagloom.streaming import streams as ST

FOLDER = "/root/testdata/sf0.001"
load_all()


def test_images_are_written_once_when_they_are_whole(spark, tmp_path):
    rng = random.Random(4)
    names = [f"{a} {b}" for a in ("blue", "red", "cold", "new") for b in ("anvil", "bolt", "gear", "ring")]
    rows = []
    for image in range(60):
        n = rng.randint(0, 6)
        tags = [(i, rng.choice(names), rng.choice(["general", "copyright", "character"]), rng.choice([0.3, 0.75, 0.9])) for i in range(n)]
        rows += [(image, f"/data/lib/{image}.jpg", n, *t) for t in tags] or [(image, f"/data/lib/{image}.jpg", 0, None, None, None, None)]
    rng.shuffle(rows)
    fields = [x.split()[0] for x in PREDICTION.split(", ")]
    cuts = [0, len(rows) // 4, len(rows) // 2, len(rows)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        lines = [json.dumps(dict(zip(fields, r))) for r in rows[a:b]]
        # a line that comes twice, broken lines
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join([*lines, lines[0], lines[1][:12], "log"]) + "\n")
    rules = token_rules(Data(spark, FOLDER))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run(limit):
        stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
        ST.stream_annotations(parse_json_lines(stream, "value", PREDICTION), rules, 0.85, "/data/lib", "now", out, checkpoint, buckets=3)
        return sorted(tuple(map(str, r)) for r in ST.read_annotations(spark, out).collect())

    got = run(3)
    frame = spark.createDataFrame(rows, PREDICTION)
    labels = T.image_labels(frame.filter("pos IS NOT NULL").drop("image_path", "n_rows"), rules, 0.85)
    want = T.annotation_records(frame.select("image_id", "image_path").distinct(), labels, "/data/lib", "now")
    assert got == sorted(tuple(map(str, r)) for r in want.collect())
    assert len(list(Path(out).glob("batch=*"))) == 3
    # the last batch again, as after a failure before its commit
    last = max(int(p.name) for p in Path(checkpoint, "commits").iterdir() if p.name.isdigit())
    for p in Path(checkpoint, "commits").glob(f"*{last}*"):
        p.unlink()
    assert run(3) == got


def test_open_images_are_a_table(spark, tmp_path):
    """No rows of a bucket meet in a state: the rows held are files, two versions at most."""
    for i in range(4):
        lines = [json.dumps({"image_id": x, "image_path": f"/{x}", "n_rows": 4, "pos": i, "tag": "blue bolt", "category": "general", "score": 0.9}) for x in range(20)]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join(lines) + "\n")
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    out, checkpoint = tmp_path / "out", tmp_path / "checkpoint"
    ST.stream_annotations(parse_json_lines(stream, "value", PREDICTION), token_rules(Data(spark, FOLDER)), 0.85, "/", "now", str(out), str(checkpoint))
    assert ST.read_annotations(spark, str(out)).count() == 20
    assert sorted(p.name for p in Path(out, "held").glob("batch=*")) == ["batch=2", "batch=3"]
    assert not Path(checkpoint, "state").exists()


def shuffle_files(spark):
    names = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(names.size()) if (n := names.apply(i).getName()).startswith("shuffle_")}


def test_open_images_take_little_disk(spark, tmp_path):
    """Rows are held as they came, records are compressed, and no batch leaves shuffled rows behind."""
    images, names = 3000, ["blue bolt", "red ring", "new gear", "large rod"]
    for i in range(4):
        lines = [json.dumps({"image_id": x, "image_path": f"/data/lib/{x}.jpg", "n_rows": 4, "pos": i, "tag": names[(x + i) % 4], "category": "general", "score": (x * 7 + i) % 50 / 50}) for x in range(images)]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join(lines) + "\n")
    rules, settings, before = token_rules(Data(spark, FOLDER)), dict(spark.conf.getAll), shuffle_files(spark)
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    out = tmp_path / "out"
    ST.stream_annotations(parse_json_lines(stream, "value", PREDICTION), rules, 0.85, "/data/lib", "now", str(out), str(tmp_path / "checkpoint"), buckets=2)
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:  # they go in the background
        time.sleep(0.2)
    assert not left
    assert dict(spark.conf.getAll) == settings
    records = ST.read_annotations(spark, str(out))
    text = records.select(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0]
    size = lambda *folders: sum(p.stat().st_size for x in folders for p in x.rglob("*") if p.suffix in (".txt", ".json", ".gz", ".parquet"))
    assert size(out / "held" / "batch=3") < size(tmp_path / "in") / 15
    assert size(*out.glob("batch=*")) < text / 5
    assert records.count() == images


def test_a_stream_of_records_leaves_its_result_only(spark, tmp_path, monkeypatch):
    """The query's own lines and tables go; its rows are those of the same rules without a stream."""
    rng, names = random.Random(7), [f"{a} {b}" for a in ("blue", "red", "cold", "new") for b in ("anvil", "bolt", "gear", "ring")]
    parts = [(i, rng.choice(names), rng.choice(["PROMO", "STANDARD", "LARGE", "SMALL"])) for i in range(40)]
    orders = [(i, rng.choice("FOP"), rng.choice(["1-URGENT", "5-LOW", "3-MEDIUM"])) for i in range(200)]
    items = [(o, p + 1, rng.randrange(40), float(rng.randint(1, 50))) for o in range(180) for p in range(rng.randint(0, 6))]
    tables = {"part": (parts, "p_partkey bigint, p_name string, p_type string"), "orders": (orders, "o_orderkey bigint, o_orderstatus string, o_orderpriority string"), "lineitem": (items, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_quantity double")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    monkeypatch.setattr(region_queries, "work_folder", lambda spark, name: str(tmp_path / name))
    got = QUERIES["stream_records"](spark, str(tmp_path))
    assert sorted(p.name for p in (tmp_path / "records").iterdir()) == ["checkpoint", "rows"]
    want = QUERIES["annotation_record"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    assert got.count() == 200


def test_shown_keys_are_a_table(spark, tmp_path):
    """No session meets in a state of its own: shown keys are files, two versions at most."""
    for i in range(4):
        lines = [json.dumps({"session": x, "pos": 10 * i + p, "key": f"k{p}"}) for x in range(20) if i != 2 or x < 5 for p in (5, 3, 4, 3, 1, 2, 0)]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join(lines) + "\n")

    def run(name, idle):
        pools = lambda session: session.readStream.schema("session bigint, pos bigint, key string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        ST.stream_unseen_pages(spark, pools, 4, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"), idle)
        pages = {}
        for r in spark.read.parquet(str(tmp_path / name)).orderBy("rank").collect():
            pages.setdefault((r["session"], r["batch"]), []).append(r["key"])
        return pages

    got = run("long", ST.IDLE_MS)
    assert len(got) == 3 * 20 + 5
    assert got[3, 0] == got[9, 0] == ["k0", "k1", "k2", "k3"]
    assert got[3, 1] == got[9, 1] == ["k4", "k5", "k0", "k1"]
    assert got[3, 2] == got[3, 3] == got[9, 3] == ["k0", "k1", "k2", "k3"]  # all were shown
    checkpoint = tmp_path / "long-checkpoint"
    assert not list((checkpoint / "state").rglob("*.zip"))
    assert sorted(p.name for p in Path(checkpoint, "shown").glob("batch=*")) == ["batch=2", "batch=3"]
    # the last batch again, as after a failure before its commit
    for p in (checkpoint / "commits").glob("*3*"):
        p.unlink()
    assert run("long", ST.IDLE_MS) == got
    # sessions that end at once see the same page each time
    assert {tuple(v) for v in run("short", 0).values()} == {("k0", "k1", "k2", "k3")}


def test_latest_table_stays_small_and_survives_a_replay(spark, tmp_path):
    rng = random.Random(2)
    table = ST.LatestTable(spark, str(tmp_path / "latest"), "at", buckets=4)
    want, sizes = {}, []

    def batch(rows):
        df = spark.createDataFrame(rows, "path_key string, name string, at bigint")
        return df.groupBy("path_key").agg(F.max_by(F.struct("name"), "at").alias("record"), F.max("at").alias("at"))

    for n in range(14):
        rows = [(f"k{rng.randrange(40)}", f"v{n}-{i}", rng.randrange(1000)) for i in range(30)]
        for k, v, at in sorted(rows, key=lambda r: r[2]):
            if at > want.get(k, (-1, ""))[0]:
                want[k] = (at, v)
        rows = list({k: (k, v, at) for k, v, at in sorted(rows, key=lambda r: r[2]) if want[k] == (at, v) or at < want[k][0]}.values())
        table.write(batch(rows), n)
        if n % 5 == 4:  # the batch runs a second time
            table.write(batch(rows), n)
        sizes.append(len(list(Path(tmp_path, "latest", "rows").glob("batch=*/bucket=*"))))
    got = {r.path_key: (r["at"], r["name"]) for r in table.read().collect()}
    assert got == want
    assert max(sizes) <= 8  # two versions of each bucket at most
    assert len(list(Path(tmp_path, "latest", "live").glob("batch=*"))) <= 2


def test_a_stream_leaves_the_settings_alone(spark):
    before = dict(spark.conf.getAll)
    session = ST.own_session(spark, {"spark.sql.streaming.noDataMicroBatches.enabled": "false"})
    assert session.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "false"
    assert session.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    assert dict(spark.conf.getAll) == before


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_vectors_without_a_direction_match_nothing(spark, limit):
    good = [[1.0, 0.0, 0.5], [0.2, 1.0, 0.0], [0.0, 0.3, 1.0], [1.0, 1.0, 1.0]]
    bad = [None, [], [1.0], [0.0, 0.0, 0.0], [math.nan, 1.0, 0.0], [math.inf, 1.0, 0.0], [None, 1.0, 0.0], [1.0, 2.0, 3.0, 4.0]]
    frame = lambda vectors, name: spark.createDataFrame(list(enumerate(vectors)), f"{name} bigint, embedding array<double>")
    clean = vector_topk(frame(good, "query_id"), frame(good, "row_index"), 3, broadcast_limit=limit)
    mixed = vector_topk(frame(good + bad, "query_id"), frame(good + bad, "row_index"), 3, broadcast_limit=limit)
    rows = lambda df: sorted((r.query_id, r["rank"], r.row_index, round(r.similarity, 9)) for r in df.collect())
    assert rows(clean) == rows(mixed) and len(rows(clean)) == 12
    assert rows(vector_topk(frame(good, "query_id"), frame(bad[:7], "row_index"), 3, broadcast_limit=limit)) == []


def test_matches_leave_a_task_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MATCH_ROWS", 4, raising=False)
    refs = spark.createDataFrame([(i, [1.0, i / 7]) for i in range(9)], "r bigint, v array<double>")
    vectors = pd.Series([[1.0, x / 5] for x in range(10)])
    pieces = list(retrieval._topk_column(refs, 3).func(iter([vectors, vectors[:0]])))
    assert [len(p) for p in pieces] == [4, 4, 2] and all(len(r) == 3 for p in pieces for r in p["r"])
