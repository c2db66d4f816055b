"""Language, names, dates, parsing, lifecycle and streams on hand-written rows."""

from __future__ import annotations

import json
import random
import re
import struct
import time
import zlib
from datetime import datetime

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomery.functions import dates, text
from loomery.operators import collections, duplicates, facets, library, lifecycle, parameters, provenance
from loomery.operators.search import Fields, FilterState, apply_filter, compile_query, parse_chips, tokenize, validate
from loomery.plans import assets, registry
from loomery.sources import files
from loomery.streaming import changes

FIELDS = Fields(id="id", prompt="prompt", model="model", steps="steps")


def _value(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_tokens_and_readiness():
    assert [(t.key, t.text, t.negated) for t in tokenize('cat -"a b" model:x !lora:y')] == [(None, "cat", False), (None, "a b", True), ("model", "x", False), ("lora", "y", True)]
    assert [validate(q)[0] for q in ('"open', "model:", "steps:abc", "date:2024-13", "steps:>20 date:2024")] == ["pending", "pending", "invalid", "invalid", "ready"]
    state, rest = parse_chips("lora:x tool:y cat -model:z")
    assert state.resources == {"loras": (("x",),)} and state.tools == ("y",) and rest == "cat -model:z"


ROWS = [(1, "A red cat", "sdxl", 20), (2, "blue dog", None, 30), (3, None, "flux", None), (4, "cat and dog 100%", "sd", 40)]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.booleans(), st.sampled_from(["cat", "dog", "red", "%", "steps:>25"])), min_size=1, max_size=4))
def test_predicates_equal_a_row_evaluator(spark, terms):
    query = " ".join(("-" if neg else "") + t for neg, t in terms)

    def holds(row):
        for neg, term in terms:
            if term.startswith("steps"):
                value = None if row[3] is None else row[3] > 25
            else:
                value = None if row[1] is None else term in row[1].lower()
            if value is None or value == neg:
                return False
        return True

    table = spark.createDataFrame(ROWS, "id int, prompt string, model string, steps int")
    assert {r.id for r in compile_query(query, FIELDS).apply(table, "id").collect()} == {r[0] for r in ROWS if holds(r)}


def test_or_groups_and_unknown_keys(spark):
    table = spark.createDataFrame(ROWS, "id int, prompt string, model string, steps int")
    ids = lambda q: {r.id for r in compile_query(q, FIELDS).apply(table, "id").collect()}
    assert ids("red OR blue") == {1, 2} and ids("OR cat") == {1, 4} and ids("nokey:x cat") == {1, 4} and ids('"nokey:x"') == set()


def test_dates():
    assert dates.search_bounds("before", "2025").end == datetime(2026, 1, 1)
    assert dates.search_bounds("date", "2024-02-03..2024-01") == dates.Bounds(datetime(2024, 1, 1), datetime(2024, 2, 4))
    assert dates.search_bounds("date", "2024-12") == dates.Bounds(datetime(2024, 12, 1), datetime(2025, 1, 1))
    assert dates.preset_bounds("week", datetime(2024, 1, 20, 5)).start == datetime(2024, 1, 13)


@pytest.mark.parametrize(("name", "want"), [("a/B_c.pth", "B_c"), ("x\\y.safetensors", "y"), ("foo.pt", "foo"), ("v1.5", "v1.5")])
def test_names(spark, name, want):
    assert _value(spark, text.clean_name(F.lit(name))) == want


def test_references_and_keys(spark):
    assert [_value(spark, text.canonical_reference(F.lit(x))) for x in ("a (0.80)", "b:0.5", " c ")] == ["a", "b", "c"]
    assert _value(spark, text.match_key(F.lit("My-Model_v2.ckpt"))) == "mymodelv2" and _value(spark, text.match_key(F.lit(None).cast("string"))) == ""
    assert _value(spark, text.match_key_candidates(F.lit("Style - Big, Cat.pt"))) == ["stylebigcat", "bigcat", "cat"]
    assert [_value(spark, text.format_reference(F.lit("a"), F.lit(w))) for w in (1.0, 0.8)] == ["a", "a (0.80)"]
    assert [_value(spark, text.generation_type(F.lit(p))) for p in ("/o/txt2img-images/a", "C:\\x-grids\\a", "/b")] == ["txt2img", "grid", "unknown"]
    assert [_value(spark, text.model_file_type(F.lit(p))) for p in ("m/Lora/a.pt", "m/vae/a.pt")] == ["loras", None]
    seeds = ['{"seed":0}', '{"seed":123}', '{"model":"a"}', '{"seed":"123"}', "{bad", '{"seed":false}', None]
    assert [_value(spark, text.json_integer(F.lit(j).cast("string"), "$.seed")) for j in seeds] == [0, 123, None, None, None, None, None]
    assert _value(spark, text.is_placeholder_prompt(F.lit("Positive prompt: None,"))) is True


def split_parameters(line: str) -> list[tuple[str, str]]:
    """(key, value) pairs of 'Key: value, ...'; commas in quotes and brackets do not part."""
    parts, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(line):
        if c == '"' and (i == 0 or line[i - 1] != "\\"):
            quoted = not quoted
        elif not quoted and c in "([{":
            depth += 1
        elif not quoted and c in ")]}":
            depth = max(depth - 1, 0)
        elif c == "," and not quoted and depth == 0:
            parts.append(line[start:i])
            start = i + 1
    parts.append(line[start:])
    pairs = (p.partition(": ") for p in parts)
    return [(k.strip(), v.strip().strip('"')) for k, _, v in pairs if v.strip()]


def _pairs(line: str) -> list[tuple[str, str]]:
    """As split_parameters, of the parts that hold ': '."""
    parts, depth, quoted, current = [], 0, False, ""
    for i, c in enumerate(line):
        if c == "," and not quoted and depth == 0:
            parts, current = [*parts, current], ""
            continue
        quoted ^= c == '"' and line[max(i - 1, 0) : i] != "\\"
        depth = depth if quoted or c == '"' else depth + 1 if c in "([{" else max(depth - 1, 0) if c in ")]}" else depth
        current += c
    return [(p.split(": ", 1)[0].strip(" "), p.split(": ", 1)[1].strip(" ").strip('"')) for p in [*parts, current] if ": " in p and p.split(": ", 1)[1].strip(" ")]


def parse_block(block: str) -> dict:
    """Positive prompt, negative prompt and parameters of one text block."""
    prepared = re.sub(r"(Negative prompt: |Steps: )", r"\n\1", block.replace("\0", ""))
    where, positive, negative, lines = "positive", [], [], []
    for line in filter(None, map(str.strip, prepared.splitlines())):
        if line.startswith("Negative prompt:"):
            where, line = "negative", line[len("Negative prompt:") :].strip()
        if line.startswith(parameters.BLOCK_STARTS):
            where = "parameters"
        if line:
            {"positive": positive, "negative": negative, "parameters": lines}[where].append(line)
    found = {}
    for line in lines:
        for key, value in split_parameters(line):
            found.setdefault(key, value)
    size = re.fullmatch(r"(\d+)x(\d+)", found.get("Size", ""))
    sampler = " ".join(filter(None, (found.get("Sampler"), found.get("Scheduler"))))
    return {
        "positive": _prompt("\n".join(positive)),
        "negative": _prompt(" ".join(negative)),
        "steps": _number(int, found.get("Steps")),
        "sampler": sampler or None,
        "cfg": _number(float, found.get("CFG scale") or found.get("CFG")),
        "seed": _number(int, found.get("Seed")),
        "width": int(size[1]) if size else None,
        "height": int(size[2]) if size else None,
        "model": next((found[k] for k in ("Model", "Checkpoint", "Model name", "SD model") if k in found), None),
        "model_hash": max((found[k] for k in ("Model hash", "sd_model_hash") if k in found), key=len, default=None),
        "vae": found.get("VAE"),
        "clip_skip": _number(int, found.get("Clip skip")),
        "denoise": _number(float, found.get("Denoising strength")),
        "version": found.get("Version"),
    }


def _prompt(value: str) -> str | None:
    bare = re.sub(r"(?i)^positive prompt:", "", value.strip()).strip(" \t\n,;")
    return None if bare.lower() in text.PLACEHOLDERS else value.strip()


def _number(kind, value):
    try:
        return kind(value)
    except (TypeError, ValueError):
        return None


def test_parameter_blocks():
    found = parse_block('cat, dog\nNegative prompt: bad\nworse\nSteps: 20, Sampler: Euler a, Seed: 5, Size: 64x32, Model: "a, b", CFG scale: 7')
    assert (found["positive"], found["negative"], found["steps"], found["width"], found["model"], found["cfg"]) == ("cat, dog", "bad worse", 20, 64, "a, b", 7.0)
    assert parse_block("")["positive"] is None and parse_block("x Steps: y")["steps"] is None


def test_video_modes_and_probe(spark):
    assert [_value(spark, parameters.video_mode(F.lit(x))) for x in ("Depth LipSync", "LoadImage", "plain")] == ["audio_lip_sync", "image_to_video", "unknown"]
    probe = '{"media":{"track":[{"@type":"General","Duration":"2.5"},{"@type":"Video","Width":"64","Height":"32","FrameRate":"29.970","Rotation":"-90"}]}}'
    x = _value(spark, parameters.probe_media(F.lit(probe)))
    assert (x.width, x.duration_ms, x.frame_rate_num, x.frame_rate_den, x.rotation) == (64, 2500, 2997, 100, 270)


def test_png_chunks():
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"tEXt", b"parameters\0Steps: 1") + chunk(b"zTXt", b"z\0\0" + zlib.compress(b"packed")) + chunk(b"IEND", b"")
    assert files.png_chunks(png) == {"parameters": "Steps: 1", "z": "packed"}
    with pytest.raises(ValueError):
        files.png_chunks(b"no")


def test_upsert_and_duplicates(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    new = spark.createDataFrame([(2, "b"), (3, "c"), (4, "d")], "id int, v string")
    got = {r.id: (r.v, r["__change"]) for r in lifecycle.upsert(old, new, "id", {"v": lifecycle.fill}).collect()}
    assert got == {1: ("a", "untouched"), 2: ("b", "same"), 3: ("c", "changed"), 4: ("d", "new")}
    assets = spark.createDataFrame([(1, "x", False, True, True), (2, "x", True, False, None), (3, "y", False, False, False)], "id int, digest string, favorite boolean, pinned boolean, masked boolean")
    members = spark.createDataFrame([("c", 2), ("c", 1), ("d", 2)], "collection_id string, asset_id int")
    kept, moved = duplicates.resolve(assets, members, spark.createDataFrame([(1, 2), (1, 3)], "keep_id int, drop_id int"))
    assert sorted(map(tuple, kept.collect())) == [(1, "x", True, True, True), (3, "y", False, False, False)]
    assert sorted(map(tuple, moved.collect())) == [("c", 1), ("d", 1)]


def test_tombstones_with_bad_membership(spark):
    rows = spark.createDataFrame([(1, '["a"]', None), (2, "{bad", None), (3, '{"a":1}', None), (4, '"a"', None), (5, None, None), (6, "[]", None)], "id int, memberships string, removed_at timestamp")
    assets, members, bad = lifecycle.restore(rows, rows.select("id"))
    assert assets.count() == 6 and [tuple(r) for r in members.collect()] == [("a", 1)] and sorted(r.id for r in bad.collect()) == [2, 3, 4]


def test_references(spark):
    rows = spark.createDataFrame([(1, '{"references":[{"role":"mask","name":"x"},{"role":"mask","name":"x"},{"role":"odd","name":" y "}]}'), (2, "{bad"), (3, None)], "id int, j string")
    found, bad = provenance.extract_references(rows, "id", "j")
    assert sorted(map(tuple, found.collect())) == [(1, "mask", "x"), (1, "other", "y")] and [r.source_id for r in bad.collect()] == [2]


def test_change_feed_pairs_renames(spark):
    rows = [(1, "rename_from", "/a/1.png"), (2, "rename_from", "/a/2.png"), (3, "rename_to", "/a/3.png"), (4, "modify", "/a/4.png"), (5, "modify", "/a/4.png"), (6, "create", "/a/thumbs/5.png")]
    got = changes.coalesce(changes.targets(spark.createDataFrame(rows, changes.CHANGES)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("rename", "/a/3.png", "/a/1.png"), ("remove", "/a/2.png", None), ("modify", "/a/4.png", None)], key=str)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.booleans())), min_size=1, max_size=25), st.integers(1, 7), st.booleans(), st.booleans())
def test_pages_hold_every_row_once(spark, values, size, down, pin):
    rows = [(i, v, p) for i, (v, p) in enumerate(values)]
    table = spark.createDataFrame(rows, "id int, v int, p boolean")
    found = [r.id for page in library.pages(table, "v", "id", size, descending=down, pinned="p" if pin else None) for r in page]
    null = lambda v: (v is None, -(v or 0)) if down else (v is not None, v or 0)
    assert found == [i for i, v, p in sorted(rows, key=lambda r: (not r[2] if pin else 0, *null(r[1]), -r[0] if down else r[0]))]


@pytest.mark.parametrize("down", [True, False])
@pytest.mark.parametrize("pin", [None, "p"])
def test_pages_at_once_equal_the_walk(spark, down, pin):
    rows = [(i, None if i % 3 == 0 else float(i * 7919 % 50), None if i % 5 == 0 else i % 7 == 0) for i in range(700)]
    table = spark.createDataFrame(rows, "id int, v double, p boolean").repartition(3)
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges, however few rows
    try:
        got = library.paged(table, "v", "id", 97, descending=down, pinned=pin)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    walk = list(library.pages(table, "v", "id", 97, descending=down, pinned=pin))
    assert got.columns == ["id", "v", "p", "page", "place"] and len(walk) == 8
    assert sorted((r.page, r.place, r.id) for r in got.collect()) == [(n, i, r.id) for n, page in enumerate(walk) for i, r in enumerate(page)]
    assert library.paged(table.where("false"), "v", "id", 97).collect() == []


@pytest.mark.parametrize("name", ["page_nulls_down", "page_nulls_up"])
def test_page_queries_hold_all_assets(spark, sf_dir, name):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    got = assets.QUERIES[name](spark, sf_dir).orderBy("page", "place").collect()
    assert [60 * r.page + r.place for r in got] == list(range(orders.count()))
    assert {r.id for r in got} == {r.o_orderkey for r in orders.select("o_orderkey").collect()}
    down, rows = name == "page_nulls_down", assets._assets(spark, sf_dir)
    for cursor in (None, {"rating": None, "id": 1000}):  # a page after any row is a stretch of them
        page = [r.id for r in library.page(rows, "rating", "id", descending=down, cursor=cursor, limit=60).collect()]
        at = next(i for i, r in enumerate(got) if r.id == page[0])
        assert page == [r.id for r in got[at : at + 60]] and (at == 0) == (cursor is None)


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_dates_are_utc_wherever_the_host_is(spark, monkeypatch, zone):
    monkeypatch.setenv("TZ", zone)
    time.tzset()
    try:
        rows = spark.sql("SELECT id, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS t, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS n FROM range(-3, 4)")
        for column in ("t", "n"):
            fields = Fields(id="id", timestamp=column)
            assert {r.id for r in compile_query("date:2024", fields).apply(rows, "id").collect()} == {0, 1, 2, 3}
            assert {r.id for r in apply_filter(rows, FilterState(date_preset="today"), fields, now=datetime(2023, 12, 31, 5)).collect()} == {-3, -2, -1}
            assert dict(library.timeline(rows, column, datetime(2024, 1, 1, 12)).select("bucket", "count").collect()) == {"today": 4, "yesterday": 3}
    finally:
        monkeypatch.undo()
        time.tzset()


def test_visibility_keeps_unknown_categories(spark):
    rows = spark.createDataFrame([(1, None, None), (2, True, None), (3, None, True), (4, False, False)], "id int, gone boolean, mid boolean")
    fields = Fields(id="id", deleted="gone", intermediate="mid")
    assert [r.id for r in apply_filter(rows, FilterState(), fields).orderBy("id").collect()] == [1, 4]
    assert [r.id for r in apply_filter(rows, FilterState(show_intermediates=True), fields).orderBy("id").collect()] == [1, 3, 4]


def test_or_join_keeps_repeated_rows(spark):
    left = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z")], "a int, b string")
    right = spark.createDataFrame([(1, "x"), (9, "z")], "c int, d string")
    got = facets.match_either(left, right, (F.col("a"), F.col("c")), (F.col("b"), F.col("d")), ["a", "d"])
    assert sorted(map(tuple, got.collect())) == [(1, "x"), (1, "x"), (3, "z")]


def test_orphans_are_of_their_facet(spark):
    used = spark.createDataFrame([("loras", "x", None), ("loras", "Y", None), ("checkpoints", "q", "h1"), ("checkpoints", "r", "h2")], "facet string, name string, hash string")
    table = spark.createDataFrame([("embeddings", "x", None), ("loras", "y", None), ("checkpoints", "other", "h1"), ("loras", "o", "h2")], "facet string, name string, hash string")
    assert sorted(r.name for r in facets.orphans(used, table).collect()) == ["r", "x"]


def test_swap_turns_at_once_and_survives_a_failed_rebuild(spark):
    make = lambda n: spark.createDataFrame([("loras", f"n{n}", n), ("tools", "t", n)], "facet string, name string, count int")
    try:
        first = facets.swap(make(1), "facet_swap")
        broken = make(2).withColumn("count", F.raise_error(F.lit("no")).cast("int"))
        with pytest.raises(Exception, match="no"):
            facets.swap(broken, "facet_swap")
        assert sorted(r["count"] for r in spark.table("facet_swap").collect()) == [1, 1]
        second = facets.swap(make(3), "facet_swap")
        assert sorted(r["count"] for r in spark.table("facet_swap").collect()) == [3, 3] and not spark.catalog.tableExists(first)
        facets.rebuild_types(spark.createDataFrame([("loras", "m", 4)], "facet string, name string, count int"), "facet_swap")
        spark.catalog.refreshTable(second)
        assert sorted((r.facet, r["count"]) for r in spark.table("facet_swap").collect()) == [("loras", 4), ("tools", 3)]
    finally:
        for name in [t.name for t in spark.catalog.listTables() if t.name.startswith("facet_swap")]:
            spark.sql(f"DROP {'VIEW' if name == 'facet_swap' else 'TABLE'} IF EXISTS {name}")


def test_winners_do_not_depend_on_the_order_of_rows(spark):
    new = [(1, "b", 2), (1, "a", 3), (1, None, 1)]
    for rows in (new, new[::-1]):
        table = spark.createDataFrame(rows, "id int, v string, at int")
        old = spark.createDataFrame([(1, "z", 0)], "id int, v string, at int")
        assert lifecycle.upsert(old, table, "id", order=["at"]).first().v == "a"
        assert lifecycle.upsert(old, table, "id").first().v == "b"
        assets = spark.createDataFrame([(i, "x", False, False, None) for i in (1, 2, 3)], "id int, digest string, favorite boolean, pinned boolean, masked boolean")
        pairs = spark.createDataFrame([(2, 3), (1, 3)] if rows is new else [(1, 3), (2, 3)], "keep_id int, drop_id int")
        members = spark.createDataFrame([("c", 3)], "collection_id string, asset_id int")
        assert [tuple(r) for r in duplicates.resolve(assets, members, pairs)[1].collect()] == [("c", 1)]


def test_best_rows_equal_a_sorted_order(spark):
    rows = spark.createDataFrame([("a", True, None, 1, "t1"), ("a", True, 5, 2, "t2"), ("a", None, 9, 3, "t3"), ("a", True, 5, 4, None), ("b", False, None, 5, "t5")], "k string, pinned boolean, at int, id int, thumb string")
    order = [("pinned", True), ("at", True), ("id", False)]
    assert {r.k: r.id for r in library.first_by(rows, ["k"], order).collect()} == {"a": 2, "b": 5}
    got = {r.k: (r["count"], r.thumb, r.safe_thumb) for r in collections.with_thumbnails(rows.withColumn("private", F.col("id") == 2), "k", order, "thumb", "private").collect()}
    assert got == {"a": (4, "t2", None), "b": (1, "t5", "t5")}
    with pytest.raises(ValueError):
        library.best_key(rows, [("thumb", True)])


def test_id_lists_do_not_grow_with_a_group(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "LIST_IDS", 10)
    rows = spark.range(95).select("id", F.when(F.col("id") < 90, "x").otherwise(F.col("id").cast("string")).alias("digest"))
    found = duplicates.id_lists(rows, "digest").collect()
    ids = [json.loads(r.ids) for r in found]
    assert sorted(sum(ids, [])) == list(range(90)) and all(x == sorted(x) for x in ids) and max(map(len, ids)) < 30 and {r.copies for r in found} == {90}


def test_similar_names_equal_all_pairs(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(120)]
    rows = spark.createDataFrame([(i, w, i % 2) for i, w in enumerate(words)], "id int, n string, w int")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for threshold in (0.6, 0.8, 1.0):
        want = {(i, j) for i in range(120) for j in range(i + 1, 120) if i % 2 == j % 2 and 1 - distance(words[i], words[j]) / max(len(words[i]), len(words[j]), 1) >= threshold - 1e-12}
        assert {(r.a, r.b) for r in duplicates.similar_names(rows, "id", "n", "w", threshold).collect()} == want


def test_similar_names_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "CHUNK", 4, raising=False)
    names = ["large red bolt", "large red bold", "small red bolt", "large reed bolt", "", None]
    held = [(i, names[i * 7 % 6], i % 2) for i in range(90)] + [(3, names[3], 1), (None, names[0], 0), (91, names[0], None)]
    rows = spark.createDataFrame(held, "id int, n string, w int")
    like = {frozenset((names[0], names[1])): 0.928571, frozenset((names[0], names[3])): 0.933333, frozenset((names[1], names[3])): 0.866667}
    want = []
    for i, n, w in held:
        for j, m, v in held:
            if None not in (i, j, w) and w == v and i < j:
                alike = 1.0 if (n or "") == (m or "") else like.get(frozenset((n, m)), 0.0)
                want += [(w, i, j, alike)] * (alike >= 0.8)
    found = duplicates.similar_names(rows, "id", "n", "w").withColumn("similarity", F.round("similarity", 6))
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    # rows are paired from saved lists: no step joins, groups or compares pairs of rows
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Join|Aggregate|levenshtein", plan)


def _odd_parts(spark, path):
    rows = [(k, n, b, t, 1, 1.0) for k, (n, b, t) in enumerate([("red bolt", "B1", "SMALL"), (None, "B1", "SMALL"), (None, "B1", "SMALL"), ("red bold", "B1", "SMALL"), ("red bolt", None, "SMALL"), ("red bolt", "B1", None), ("", "B1", ""), ("", "B1", "")] * 30, -120)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{path}/part.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["similar_names", "similarity_pairs"])
def test_similar_names_of_odd_parts_equal_sql(spark, tmp_path, name):
    d = _odd_parts(spark, tmp_path)
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{d}/part.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(tuple(r) for r in registry.queries()[name](spark, d).select(*columns).collect()) == sorted(want.fetchall())


def test_parameter_blocks_of_many_shapes(spark):
    nested = 'x\nSteps: 3, Hashes: {"a, b": {"c": [1, 2]}, "d": 1}, Version: v1 (a, b), CFG: 4, Note: "open, Seed: 9'
    blocks = [nested, "a\nNegative prompt: \nSeed: 3, Model: m\nNegative prompt: again\nmore", "p, Steps: 4, Size: 1x2x3, Seed: -5, Model hash: ab, sd_model_hash: abcd, Sampler: , Scheduler: Karras", "Positive prompt: none,\nSteps: x, CFG scale: .5, Steps: 7", "cat", "cat\nSteps: 20", "cat\nNegative prompt: bad\nSteps: 5, Seed: 7, Size: 8x9", "Steps: 1, Sampler: Euler a, Model: m", "", None, "a\nb\nNegative prompt: c\nd\nSteps: 2, CFG scale: 1.5"]
    rows = spark.createDataFrame(list(enumerate(blocks)), "id int, block string")
    got = {r.id: r for r in parameters.parse_blocks(rows, "block", ["id"]).collect()}
    for i, block in enumerate(blocks):
        want = parse_block(block or "")
        assert all(got[i][k] == v for k, v in want.items())


def test_parameter_values_of_a_megabyte(spark):
    n = 1_000_000
    deep = "".join(random.Random(4).choice("([{x, ") for _ in range(5000))
    values = {
        "plain": ("y" * n, "y" * n),
        "quoted": ('"' + "a, b: " * (n // 6) + '"', "a, b: " * (n // 6)),
        "bracketed": ("{" + "[k: 1, (2)], " * (n // 13) + "}", "{" + "[k: 1, (2)], " * (n // 13) + "}"),
        "nested": ("(" * 2000 + ", " + ")" * 2000, "(" * 2000 + ", " + ")" * 2000),
        "commas": (",", ""),
    }
    blocks = [(k, f"cat\nSteps: 20, Version: {v}, Seed: 7") for k, (v, _) in values.items()]
    blocks += [("unclosed", "cat\nSteps: 20, Seed: 7, Version: (" + "a, " * (n // 3)), ("open quote", 'cat\nSteps: 20, Seed: 7, Version: "' + "b, " * (n // 3)), ("many", "cat\nSteps: 20, " + "k: v, " * 100_000 + "Seed: 7"), ("deep", f"cat\nSteps: 20, Seed: 7, Version: {deep}"), ("number", "cat\nSteps: 20, CFG scale: " + "1" * n + "x, Seed: 7")]
    got = {r.id: r for r in parameters.parse_blocks(spark.createDataFrame(blocks, "id string, block string"), "block", ["id"]).collect()}
    assert all((r.steps, r.seed, r.positive) == (20, 7, "cat") for r in got.values())
    assert all(got[k].version == (want or None) or k == "commas" for k, (_, want) in values.items())
    assert got["unclosed"].version == ("(" + "a, " * (n // 3)).strip() and got["deep"].version == deep.strip() and got["number"].cfg is None


def test_split_parameters_equals_a_scanner(spark):
    rng = random.Random(6)
    lines = ["".join(rng.choices('ab:,"\\()[]{} ', weights=[3, 3, 6, 4, 2, 1, 2, 2, 1, 1, 1, 1, 6], k=rng.randint(0, 60))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(lines)), "id int, line string")
    got = {r.id: [(x.key, x.value) for x in r.p] for r in rows.select("id", parameters.split_parameters(F.col("line")).alias("p")).collect()}
    assert all(got[i] == _pairs(line) for i, line in enumerate(lines)) and sum(len(x) > 1 for x in got.values()) > 100


def test_duplicate_lists_are_whole(spark, monkeypatch):
    from loomery.plans import library as plans

    docs = spark.createDataFrame([(i, "same" if i < 2500 else f"other {i}", 5) for i in range(2600)], "doc_id long, text string, n_chars long")
    monkeypatch.setattr(plans, "_table", lambda spark, d, name: docs)
    found = plans.duplicate_groups(spark, "").collect()
    assert sorted(i for r in found for i in json.loads(r.ids)) == list(range(2500)) and {(r.copies, r.redundant) for r in found} == {(2500, 2499)} and len(found) == 3


def test_sources(spark, tmp_path):
    root = tmp_path / "lib"
    (root / "out" / "txt2img-images" / "day").mkdir(parents=True)
    (root / ".thumbnails").mkdir()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"tEXt", b"parameters\0Steps: 1") + chunk(b"IEND", b"")
    (root / "out" / "txt2img-images" / "day" / "a.PNG").write_bytes(png)
    (root / "b.jpg").write_bytes(b"broken")
    (root / "c.mp4").write_bytes(b"v")
    (root / ".thumbnails" / "t.png").write_bytes(png)
    (root / "c.workflow.json").write_text('{"a":1}')
    (root / "models" / "Lora").mkdir(parents=True)
    (root / "models" / "Lora" / "x.safetensors").write_bytes(b"x")
    (root / "models" / "vae").mkdir()
    (root / "models" / "vae" / "y.pt").write_bytes(b"y")
    listing = files.list_media(spark, str(root))
    name = lambda p: p.rpartition("/")[2]
    assert {(name(r.path), r.media_type) for r in listing.collect()} == {("a.PNG", "image"), ("b.jpg", "image"), ("c.mp4", "video")}
    cursor = files.high_water(listing).first().cursor
    assert files.list_media(spark, str(root), since=datetime(2001, 1, 1)).count() == 3 and cursor.year > 2001
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(root)).filter("path like '%.PNG' or path like '%.jpg'")
    chunks = {name(r.path): (r.chunks, r.error) for r in files.read_chunks(content).collect()}
    assert chunks == {"a.PNG": ({"parameters": "Steps: 1"}, None), "b.jpg": (None, "not a JPEG file")}
    assert [tuple(r) for r in files.sidecars(spark, str(root)).collect()] == [("c", '{"a":1}')]
    everything = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(root)).select("path")
    assert [(r.name, r.type) for r in files.model_inventory(everything).collect()] == [("x", "loras")]
    assert [r.folder.rpartition("/lib/")[2] for r in files.output_roots(listing.withColumn("path", F.regexp_replace("path", "^.*/lib/", "/lib/"))).collect()] == ["out/txt2img-images/day"]
    (tmp_path / "cache.json").write_text('{"hashes": {"m/x": {"sha256": "AB", "mtime": 1.5}, "none": {"mtime": 2}}}')
    assert [tuple(r) for r in files.hash_cache(spark, str(tmp_path / "cache.json")).collect()] == [("m/x", "ab", 1.5)]


def test_sinks(spark, tmp_path):
    rows = spark.range(5)
    files.export(rows, f"{tmp_path}/export")
    manifest = spark.read.json(f"{tmp_path}/export/manifest").first()
    assert spark.read.parquet(f"{tmp_path}/export/rows").count() == manifest.rows == 5 and json.loads(manifest["columns"]) == ["id"]
    for day in (1, 2, 3):
        files.snapshot({"rows": rows}, f"{tmp_path}/backup", datetime(2024, 1, day))
    assert files.prune(spark, f"{tmp_path}/backup", 2) == ["snapshot-20240101-000000"]
    assert sorted(p.name for p in (tmp_path / "backup").iterdir()) == ["snapshot-20240102-000000", "snapshot-20240103-000000"]


def test_watched_folder_updates_the_assets(spark, tmp_path):
    (tmp_path / "log").mkdir()
    assets, seen = spark.createDataFrame([("/a/1.png",), ("/a/2.png",), ("/a/4.png",)], "path string"), []

    def handle(batch, n):
        seen.append(sorted(r.path for r in changes.apply_changes(assets, batch).collect()))

    lines = [{"seq": 1, "kind": "rename_from", "path": "/a/1.png"}, {"seq": 2, "kind": "rename_to", "path": "/a/3.png"}, {"seq": 3, "kind": "remove", "path": "/a/2.png"}, {"seq": 4, "kind": "remove", "path": "/a/4.txt"}]
    (tmp_path / "log" / "1.json").write_text("\n".join(map(json.dumps, lines)))
    for _ in range(2):  # the second run finds nothing new
        changes.watch(spark, str(tmp_path / "log"), str(tmp_path / "state"), handle, once=True).awaitTermination()
    assert seen == [["/a/3.png", "/a/4.png"]]
    rows = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01', timestamp'2024-03-01'), (2, timestamp'2024-02-01', null) AS t(id, created, updated)")
    fresh, mark = changes.sync_since(rows, "2024-02-10")
    assert [r.id for r in fresh.collect()] == [1] and mark.first().mark == datetime(2024, 3, 1)
