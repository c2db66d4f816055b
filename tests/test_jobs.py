"""Marks, queues, resumable jobs, the prompt index, guidance classes and evidence on hand-written rows."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomery import storage
from loomery.functions import guidance
from loomery.operators import jobs, lifecycle, parameters
from loomery.operators.prompt_index import PromptIndex

DAY = datetime(2024, 5, 1)
ROWS = "id long, created timestamp, updated timestamp, v string"


def at(hours):
    return None if hours is None else DAY + timedelta(hours=hours)


def test_sync_takes_rows_of_the_marks_own_time_once(spark, tmp_path):
    table = storage.KeyedTable.create(spark.createDataFrame([], ROWS), f"file://{tmp_path}/t", "id", 4)
    source, taken = {}, []

    def put(*rows):
        source.update({i: (i, at(c), at(u), v) for i, c, u, v in rows})
        taken.append(jobs.sync(table, spark.createDataFrame(list(source.values()), ROWS)))

    put((1, 1, None, "a"), (2, 2, None, "b"), (3, 2, None, "c"))
    put((4, 2, None, "late, the mark's own time"), (5, 1, None, "older than the mark"))
    put((1, 1, 3, "updated"), (6, None, None, "no time"))
    put()
    assert taken == [3, 1, 1, 0] and table.version() == 3
    assert {r.id: r.v for r in table.read().collect()} == {1: "updated", 2: "b", 3: "c", 4: "late, the mark's own time"}


def test_sync_that_stops_before_its_commit_is_run_again(spark, tmp_path, monkeypatch):
    table = storage.KeyedTable.create(spark.createDataFrame([], ROWS), f"file://{tmp_path}/t", "id", 4)
    source = spark.createDataFrame([(1, at(1), None, "a"), (2, at(2), None, "b")], ROWS)
    with monkeypatch.context() as m:
        m.setattr(storage.KeyedTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            jobs.sync(table, source)
    assert table.notes("sync mark") == [] and table.read().count() == 0
    assert jobs.sync(table, source) == 2 and jobs.sync(table, source) == 0 and table.read().count() == 2


def test_a_batch_counts_once(spark, tmp_path, monkeypatch):
    table = storage.KeyedTable.create(spark.createDataFrame([("a", 5)], "key string, count long"), f"file://{tmp_path}/t", "key", 4)
    queue = jobs.FacetQueue(table)
    batch = lambda *rows: spark.createDataFrame(rows, "key string, delta int")
    queue.put(batch(("a", 1), ("b", 2), ("b", 1)), 7)
    queue.put(batch(("a", 1), ("b", 2), ("b", 1)), 7)
    queue.put(batch(("a", -2), ("c", 1)), 8)
    with monkeypatch.context() as m:
        m.setattr(storage.KeyedTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            queue.drain()
    assert queue.counted() == set() and queue.drain() == 2 and queue.counted() == {7, 8}
    queue.put(batch(("a", 1), ("b", 2), ("b", 1)), 7)  # a replay after it was counted
    queue.put(batch(("c", -1), ("c", 1)), 9)  # changes nothing, and is counted too
    assert queue.drain() == 1 and queue.drain() == 0 and queue.counted() == {7, 8, 9}
    assert dict(table.read().collect()) == {"a": 4, "b": 3, "c": 1}


def parse(rows):
    return parameters.parse_blocks(rows, "original", ["id"]).select("id", "steps", "seed")


def library(spark, n=60):
    rows = [(i, f"cat\nSteps: {i}, Seed: {i * 2}" if i % 5 else None, "image", i % 11 == 0, i % 3, None, None) for i in range(n)]
    return spark.createDataFrame(rows, "id long, original string, media_type string, is_deleted boolean, parser_version int, steps long, seed long")


def test_a_cancelled_job_goes_on_where_it_stopped(spark, tmp_path):
    whole = storage.KeyedTable.create(library(spark), f"file://{tmp_path}/a", "id", 6)
    steps = list(jobs.reparse(whole, parse, 2, job="one", buckets_a_step=2))
    assert [s["done"] for s in steps] == [2, 4, 6] and steps[-1]["parsed"] == sum(1 for i in range(60) if i % 5 and i % 11 and i % 3 < 2)
    parted = storage.KeyedTable.create(library(spark), f"file://{tmp_path}/b", "id", 6)
    next(jobs.reparse(parted, parse, 2, job="two", buckets_a_step=2))

    def cancelled(rows):
        spark.sparkContext.cancelJobsWithTag("two")
        return rows.select("id", F.raise_error("cancelled").cast("long").alias("steps"))

    with pytest.raises(Exception, match="cancelled"):
        list(jobs.reparse(parted, cancelled, 2, job="two", buckets_a_step=2))
    rest = list(jobs.reparse(parted, parse, 2, job="two", buckets_a_step=2))
    assert [s["done"] for s in rest] == [4, 6] and list(jobs.reparse(parted, parse, 2, job="two")) == []
    assert sorted(map(tuple, parted.read().collect())) == sorted(map(tuple, whole.read().collect()))
    assert [s["parsed"] for s in jobs.reparse(parted, parse, 3, job="two", buckets_a_step=6)] == [sum(1 for i in range(60) if i % 5 and i % 11)]


TEXTS = ["The cat sat on the mat.", "a cat, sat", "concatenate satin", "THE CAT  SAT", "cat-sat on", None, "", "ärger über Äpfel", "one two three two three four", "on the cat's mat 12 34"]
PHRASES = ["cat", "cat sat", "t sa", "at, s", "the cat", "three four", "two three t", "e", "Ü", "über ä", "  ", "-", "mat.", "2 3", "cat's", "nothing", "one three", " on", "on "]


def test_prompt_index_equals_a_scan(spark, tmp_path):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choices("abc  .,-Ä", k=30)) for _ in range(120)]
    assets = spark.createDataFrame(list(enumerate(texts)), "id int, prompt string")
    index = PromptIndex(spark, f"file://{tmp_path}/index", 4)
    index.add(assets.withColumn("prompt", F.when(F.col("id") % 4 == 0, "cat sat three four e").otherwise(F.col("prompt"))), "id", "prompt")
    index.add(assets.where("id % 4 = 0"), "id", "prompt")
    for phrase in [*PHRASES, *("".join(rng.choices("abc  .,", k=rng.randint(1, 5))) for _ in range(6))]:
        want = {i for i, t in enumerate(texts) if phrase.lower() in (t or "").lower()}
        assert {r.id for r in index.search(assets, "id", "prompt", phrase).collect()} == want, phrase
    index.remove(assets.where("id < 3"), "id")
    gone = {r.id for r in index.candidates("cat").collect()}
    assert {"0", "1", "2"}.isdisjoint(gone) and {"3", "4", "9"} <= gone


def test_prompt_index_reads_the_partitions_of_its_words(spark, tmp_path):
    index = PromptIndex(spark, f"file://{tmp_path}/index", 16)
    index.add(spark.createDataFrame([(i, f"word{i} next{i}") for i in range(200)], "id int, prompt string"), "id", "prompt")
    for read in (index.postings(F.col("word") == "word7", "word7"), index.postings(F.col("word").endswith("d77"))):
        assert read.count() == 1
        plan = read._jdf.queryExecution().executedPlan().toString()
        filters = plan.split("PartitionFilters: [")[1].split("]")[0]
        assert "bucket" in filters and "xxhash" not in filters  # folded to one partition before the scan
    assert index.postings(F.col("word") == "word7", "word7").inputFiles() and len(list((tmp_path / "index" / "postings" / "segment=0").glob("bucket=*"))) == 16


NAMES = [
    ("models/ip-adapter_faceid-plusv2.safetensors", None, "ipadapter", "faceid-plus"),
    ("ip_adapter_plus_face.bin", "", "ipadapter", "plus-face"),
    ("control_v11p_sd15_canny.pth", None, "controlnet", "canny"),
    ("t2i-adapter_depth (0.8)", None, "t2iadapter", "depth"),
    ("Soft Edge (HED)", None, "controlnet", "scribble"),
    ("reference.safetensors", None, "ipadapter", "plus"),
    ("precise canny", None, "controlnet", "canny"),
    ("controlnet_precise", None, "controlnet", "canny"),
    ("plus_depth", None, "controlnet", "depth"),
    ("whatever", "cc498871", "controlnet", "canny"),
    ("ip-adapter", "466e0767", "controlnet", "openpose"),
    ("whatever", "00000000", None, None),
    (None, None, None, None),
    ("C:\\models\\ControlNet-Tile.GGUF", None, "controlnet", "tile"),
]


def test_guidance_classes(spark):
    rows = spark.createDataFrame([(i, n, h) for i, (n, h, _, _) in enumerate(NAMES)], "id int, name string, hash string")
    got = {r.id: (r.g.category, r.g.subtype) if r.g else (None, None) for r in rows.select("id", guidance.classify(F.col("name"), F.col("hash")).alias("g")).collect()}
    assert got == {i: (c, s) for i, (_, _, c, s) in enumerate(NAMES)}


def test_evidence_and_its_conflicts(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(40), rng.choice("fg"), rng.randrange(4), rng.choice([None, "x", "y"])) for _ in range(400)]
    got = {(r.a, r.f): (r.value, r["rank"], r.n, r.conflict) for r in parameters.evidence(spark.createDataFrame(rows, "a int, f string, r int, v string"), ["a", "f"], "r", "v").collect()}
    want = {}
    for key in {(a, f) for a, f, _, v in rows if v}:
        own = sorted((r, v) for a, f, r, v in rows if (a, f) == key and v)
        want[key] = (own[0][1], own[0][0], len(own), len(Counter(v for _, v in own)) > 1)
    assert got == want


def test_identities_move_through_every_table(spark):
    moves = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (200, 201), (200, 202), (300, 300), (400, 100)]
    table = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    tables = {
        "members": (table([("c", 1), ("c", 39), ("c", 40), ("d", 100), ("d", 200), ("d", 5000)], "collection string, asset_id long"), ["asset_id"]),
        "edges": (table([(1, 2, "x"), (3, 200, "x"), (None, 300, "y"), (400, 7, "z")], "source_id long, target_id long, role string"), ["source_id", "target_id"]),
    }
    moved = lifecycle.move_identity(tables, table(moves, "old_id long, new_id long"))
    assert sorted(map(tuple, moved["members"].collect())) == [("c", 40), ("d", 100), ("d", 201), ("d", 5000)]
    assert sorted(map(tuple, moved["edges"].collect()), key=str) == sorted([(40, 40, "x"), (40, 201, "x"), (None, 300, "y"), (400, 40, "z")], key=str)
