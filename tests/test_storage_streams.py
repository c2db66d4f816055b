"""Keyed tables, keyword lookup and renames across micro-batches."""

from __future__ import annotations

import os
import random
import time
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomery import storage
from loomery.operators import keywords, library, lifecycle
from loomery.streaming import changes, renames


def merge(old, new):
    return lifecycle.upsert(old, new, "id", {"kept": lifecycle.stored})


def files(path):
    return {str(f.relative_to(path)): (f.stat().st_mtime_ns, f.stat().st_size) for f in Path(path).rglob("data/**/*.parquet")}


@pytest.fixture
def held(spark, tmp_path):
    rows = spark.range(1000).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"), F.lit(1).alias("kept"))
    return storage.KeyedTable.create(rows, f"file://{tmp_path}/t", "id", 8)


def test_a_commit_writes_the_touched_partitions_only(spark, tmp_path, held):
    before = files(tmp_path / "t")
    news = spark.createDataFrame([(5, "changed", 9), (2000, "new", 9), (6, "v6", 9)], "id long, value string, kept int")
    assert held.merge(news, merge)["changed"] == 1 and held.version() == 1
    got = {r.id: (r.value, r.kept) for r in held.read().collect()}
    assert got == {i: (f"v{i}", 1) for i in range(1000)} | {5: ("changed", 1), 2000: ("new", 9)}
    after = files(tmp_path / "t")
    assert all(after[f] == stamp for f, stamp in before.items())  # nothing old is touched, and little is added
    touched = {r.b for r in news.where("id <> 6").select(held.bucket(8).alias("b")).collect()}
    assert {f.split("/")[1] for f in set(after) - set(before)} == {f"bucket={b}" for b in touched}
    assert {b for b, v in held.listing().items() if v == 1} == touched
    assert held.read(0).count() == 1000 and held.read(0).where("id = 5").first().value == "v5"  # the version before is still there


def test_a_commit_that_changes_nothing_writes_nothing(spark, tmp_path, held):
    before = files(tmp_path / "t")
    assert set(held.merge(spark.createDataFrame([(5, "v5", 7)], "id long, value string, kept int"), merge)) == {"same", "untouched"}
    assert held.merge(spark.createDataFrame([], "id long, value string, kept int"), merge) == {}
    assert files(tmp_path / "t") == before and held.version() == 0


def test_a_commit_that_stops_half_way_is_not_seen(spark, held, monkeypatch):
    news = spark.createDataFrame([(5, "changed", 9), (None, "null key", 2)], "id long, value string, kept int")
    with monkeypatch.context() as m:
        m.setattr(storage.KeyedTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            held.merge(news, merge)
    assert held.version() == 0 and held.read().where("value = 'changed'").count() == 0
    again = storage.KeyedTable(spark, held.path, "id")
    again.merge(news, merge)
    assert again.version() == 1 and again.read().count() == 1001 and again.read().where("id is null").first().value == "null key"


def test_rows_of_random_commits(spark, held):
    rng, want = random.Random(3), {i: f"v{i}" for i in range(1000)}
    for k in range(3):
        rows = {rng.randrange(1500): f"k{k}-{j}" for j in range(40)}
        held.merge(spark.createDataFrame([(i, v, 1) for i, v in rows.items()], "id long, value string, kept int"), merge)
        want |= rows
    assert {r.id: r.value for r in held.read().collect()} == want and held.version() == 3


def test_keywords_equal_a_plain_search(spark):
    rng = random.Random(8)
    letters = "abAB é%_.*(\\漢😀"
    texts = [(i, "".join(rng.choices(letters, k=rng.choice([0, 1, 3, 10, 40])))) for i in range(300)] + [(300, None), (301, "abab"), (302, "abab")]
    words = sorted({"".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(400)}) + ["", "  ", None, "nowhere at all", " Ab "]
    rows = spark.createDataFrame([(i, t, "old") for i, t in texts], "id int, t string, keywords string")
    got = {r.id: r.keywords for r in keywords.containing(rows, "t", spark.createDataFrame([(w,) for w in words], "keyword string")).collect()}
    low = sorted({w.strip(" ").lower() for w in words if w and w.strip(" ")}, key=lambda w: w.encode())
    assert got == {i: [w for w in low if w in (t or "").lower()] for i, t in texts}


def test_more_keywords_than_an_expression_could_hold(spark):
    words = spark.range(50_000).select(F.concat(F.lit("key"), F.col("id").cast("string"), F.lit("x")).alias("keyword"))
    names = spark.createDataFrame([("A Key49999X here",), ("key50000x",), ("key7",), (None,), ("A Key49999X here",)], "name string")
    got = library.token_matches(names, words).collect()
    assert sorted((r.name or "", r.flagged) for r in got) == [("", False), ("A Key49999X here", True), ("A Key49999X here", True), ("key50000x", False), ("key7", False)]
    assert not library.token_matches(names, words.limit(0)).where("flagged").count()


START = datetime(2024, 1, 1)


def write(spark, folder, rows):
    """One log file; rows: (seq, kind, path, milliseconds)."""
    os.makedirs(folder, exist_ok=True)
    data = [(s, k, p, START + timedelta(milliseconds=ms)) for s, k, p, ms in rows]
    spark.createDataFrame(data, renames.LOG).coalesce(1).write.mode("append").json(f"file://{folder}")
    time.sleep(0.02)  # files are read in the order of their times


def run(spark, tmp_path, **options):
    seen = []
    handle = lambda batch, n: seen.extend((r.kind, r.path, r.old_path) for r in batch.collect())
    renames.watch(renames.stateful_session(spark), f"file://{tmp_path}/log", f"file://{tmp_path}/state", handle, by_event=True, files_a_batch=1, once=True, **options).awaitTermination()
    return seen


def test_a_rename_over_two_batches_is_one(spark, tmp_path):
    log = str(tmp_path / "log")
    write(spark, log, [(1, "rename_from", "/a/1.png", 0), (2, "modify", "/a/9.png", 5), (3, "modify", "/a/9.png", 6), (4, "rename_from", "/b/1.png", 10)])
    write(spark, log, [(5, "rename_to", "/a/2.png", 200), (6, "rename_to", "/c/5.png", 210)])
    first = run(spark, tmp_path)
    assert sorted(first, key=str) == sorted([("modify", "/a/9.png", None), ("rename", "/a/2.png", "/a/1.png"), ("create", "/c/5.png", None)], key=str)
    # the query starts again from its checkpoint; what waits in /b goes once time has passed
    write(spark, log, [(7, "modify", "/z/1.png", 2000)])
    assert sorted(run(spark, tmp_path), key=str) == sorted([("modify", "/z/1.png", None), ("remove", "/b/1.png", None)], key=str)


def test_halves_apart_by_more_than_the_wait_are_two_changes(spark, tmp_path):
    log = str(tmp_path / "log")
    write(spark, log, [(1, "rename_from", "/a/1.png", 0), (2, "rename_from", "/a/2.png", 200)])
    write(spark, log, [(3, "rename_to", "/a/3.png", 260)])
    write(spark, log, [(4, "create", "/z/1.png", 9000)])
    assert sorted(run(spark, tmp_path), key=str) == sorted([("remove", "/a/1.png", None), ("rename", "/a/3.png", "/a/2.png"), ("create", "/z/1.png", None)], key=str)


def plain(rows):
    waiting, out = {}, Counter()
    for _, kind, path, _ in sorted(rows):
        queue = waiting.setdefault(path.rsplit("/", 1)[0], [])
        if kind == "rename_from":
            queue.append(path)
        elif kind == "rename_to":
            out[("rename", path, queue.pop(0)) if queue else ("create", path, None)] += 1
        else:
            out[(kind, path, None)] += 1
    out.update(("remove", path, None) for queue in waiting.values() for path in queue)
    return out


@pytest.mark.parametrize("cuts", [[], [40], [13, 14, 70]])
def test_any_batches_give_what_one_queue_gives(spark, tmp_path, cuts):
    rng = random.Random(5)
    rows = [(i, rng.choice(["rename_from", "rename_to", "rename_from", "rename_to", "remove"]), f"/{rng.choice('ab')}/{i}.png", i) for i in range(100)]
    for lo, hi in zip([0, *cuts], [*cuts, 100], strict=True):
        write(spark, str(tmp_path / "log"), rows[lo:hi])
    write(spark, str(tmp_path / "log"), [(1000, "create", "/z/end.png", 10**9)])
    got = Counter(run(spark, tmp_path, wait_ms=10**6))
    want = plain([*rows, (1000, "create", "/z/end.png", 0)])
    assert got == want
    batch = spark.createDataFrame([r[:3] for r in rows], changes.CHANGES)
    assert {tuple(r) for r in changes.coalesce(batch).collect()} == set(want) - {("create", "/z/end.png", None)}


def test_an_idle_folder_is_flushed_by_the_clock(spark, tmp_path):
    write(spark, str(tmp_path / "log"), [(1, "rename_from", "/a/1.png", 0)])
    seen = []
    query = renames.watch(renames.stateful_session(spark), f"file://{tmp_path}/log", f"file://{tmp_path}/state", lambda batch, n: seen.extend(map(tuple, batch.collect())))
    try:
        until = time.time() + 90
        while not seen and time.time() < until:
            time.sleep(0.25)
    finally:
        query.stop()
    assert seen == [("remove", "/a/1.png", None)]
