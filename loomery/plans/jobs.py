"""Queries for synchronisation, queues, resumable jobs, the prompt index, guidance classes and evidence."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery import storage
from loomery.functions import guidance
from loomery.operators import jobs, library, lifecycle, parameters
from loomery.operators.prompt_index import PromptIndex


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sync_increments(spark: SparkSession, d: str) -> DataFrame:
    """Three increments of events by day. Half of a day's rows are there when it is the newest; the others come later with
    the mark's own time. A fourth one finds nothing."""
    rows = _table(spark, d, "events").select(F.col("event_id").alias("id"), F.date_trunc("day", "ts").alias("created"), F.lit(None).cast("timestamp").alias("updated"), "event_type")
    cuts = rows.agg(F.percentile_approx(F.unix_seconds("created"), [0.3, 0.7]).alias("q")).first().q or [0, 0]
    held = storage.KeyedTable.create(rows.limit(0), storage.scratch(spark, "synced"), "id", 8)
    day = F.unix_seconds("created")
    shown = [rows.where((day < c) | ((day == c) & (F.col("id") % 2 == 0))) for c in cuts]
    taken = [jobs.sync(held, source) for source in (*shown, rows, rows)]
    return held.read().select("id", "created", "event_type", F.lit(taken[-1]).cast("long").alias("taken_last"))


def facet_queue(spark: SparkSession, d: str) -> DataFrame:
    """Counts by priority out of five batches, some put in twice, counted in two commits with a replay between."""
    changes = _table(spark, d, "orders").select(F.col("o_orderpriority").alias("key"), (F.col("o_orderkey") % 5).alias("batch"), F.when(F.col("o_orderstatus") == "P", -1).otherwise(1).alias("delta"))
    empty = spark.createDataFrame([], "key string, count long")
    queue = jobs.FacetQueue(storage.KeyedTable.create(empty, storage.scratch(spark, "facets"), "key", 4))
    for batch in (0, 1, 1, 2):
        queue.put(changes.where(F.col("batch") == batch), batch)
    queue.drain()
    for batch in (1, 3, 4):
        queue.put(changes.where(F.col("batch") == batch), batch)
    queue.drain()
    return queue.table.read().select("key", "count", F.lit(queue.drain()).alias("left"))


def reparse_steps(spark: SparkSession, d: str) -> DataFrame:
    """A job that stops after its first step and is run again under its name."""
    block = F.concat(F.col("p_name"), F.lit("\nSteps: "), F.col("p_size").cast("string"), F.lit(", Seed: "), F.col("p_partkey").cast("string"))
    assets = _table(spark, d, "part").select(F.col("p_partkey").alias("id"), block.alias("original"), F.lit("image").alias("media_type"), (F.col("p_partkey") % 7 == 0).alias("is_deleted"), F.when(F.col("p_partkey") % 3 == 0, 2).otherwise(1).alias("parser_version"), F.lit(None).cast("long").alias("steps"), F.lit(None).cast("long").alias("seed"))
    held = storage.KeyedTable.create(assets, storage.scratch(spark, "assets"), "id", 8)

    def parse(rows: DataFrame) -> DataFrame:
        return parameters.parse_blocks(rows, "original", ["id"]).select("id", "steps", "seed")

    next(jobs.reparse(held, parse, 2, job="nightly"))
    steps = list(jobs.reparse(held, parse, 2, job="nightly"))
    return held.read().select("id", "steps", "seed", "parser_version").withColumn("done", F.lit(steps[-1]["done"]))


PHRASES = ["the", "e in", "on the ", "the. ", "12", "zqxj", "an "]


def prompt_index(spark: SparkSession, d: str) -> DataFrame:
    """Documents that contain some phrases, by an index of two segments: the second one replaces a third of the first."""
    docs = _table(spark, d, "documents").select("doc_id", "text")
    index = PromptIndex(spark, storage.scratch(spark, "prompts"), 16)
    index.add(docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.reverse("text")).otherwise(F.col("text"))), "doc_id", "text")
    index.add(docs.where("doc_id % 3 = 0"), "doc_id", "text")
    found = [index.search(docs, "doc_id", "text", p).select("doc_id", F.lit(p).alias("phrase")) for p in PHRASES]
    return reduce(DataFrame.unionByName, found)


_NAMES = ["ip-adapter_faceid_plus", "ip_adapter-faceid", "portrait", "ip_plus-face", "full_face", "IP-Adapter-Plus", "ipadapter_light", "ipad_composition", "ip_style", "ip-adapter", "control_canny", "Depth", "openpose", "soft edge sketch", "cnet_softedge", "lineart", "control_normal", "inpaint", "tile", "mlsd", "segmentation", "control_ip2p", "shuffle", "recolor", "control_precise", "controlnet", "reference", "precise"]
_NAMES += [f"t2i-adapter_{x}" for x in ("canny", "zoe", "pose", "hed", "lineart", "bae", "inpaint", "resample", "mlsd", "ade20k", "instruct", "shuffle", "recolor", "precise", "colour")] + ["anything", "t2iadapter_full", "ip-adapter_depth"]
_HASHES = [h for found in guidance.SIGNATURES.values() for h in found]


def guidance_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of names made of part, of every rule; every ninth has a known hash."""
    rows = _table(spark, d, "part")
    word = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES) + 1).cast("int"))
    name = F.concat(F.lit("models\\guide/"), word, F.lit("-"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, ".safetensors").otherwise(" (0.8).pt"))
    signature = F.when(F.col("p_partkey") % 9 == 0, F.element_at(F.array(*map(F.lit, _HASHES)), (F.floor(F.col("p_partkey") / 9) % len(_HASHES) + 1).cast("int")))
    return rows.select("p_partkey", guidance.classify(name, signature).alias("g")).select("p_partkey", "g.category", "g.subtype", "g.rule")


def evidence_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Modes, flags and states of an order as evidence of its lines, the first line's counting most."""
    rows = _table(spark, d, "lineitem")
    values = F.create_map(F.lit("mode"), F.concat(F.lit("m"), (F.col("l_suppkey") % 7).cast("string")), F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.when(F.col("l_linenumber") > 1, F.col("l_linestatus")))
    candidates = rows.select("l_orderkey", F.col("l_linenumber").alias("rank"), F.explode(values).alias("field", "value"))
    return parameters.evidence(candidates, ["l_orderkey", "field"], "rank", "value")


def identity_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Customers that move, some of them twice and two along a cycle, in their memberships, edges and counts."""
    ids = _table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    to = lambda by, n: ids.where(F.col("k") % 10 == by).select(F.col("k").alias("old_id"), (F.col("k") + n).alias("new_id"))
    moves = to(0, 1).unionByName(to(1, 1)).unionByName(to(5, 1)).unionByName(to(6, -1))
    orders = _table(spark, d, "orders")
    members = orders.select(F.col("o_orderstatus").alias("collection"), F.col("o_custkey").alias("asset_id")).distinct()
    edges = orders.select(F.col("o_custkey").alias("source_id"), (F.col("o_custkey") % 20).alias("target_id")).distinct()
    moved = lifecycle.move_identity({"members": (members, ["asset_id"]), "edges": (edges, ["source_id", "target_id"])}, moves)
    own = moved["members"].select(F.lit("members").alias("what"), F.col("collection").alias("a"), F.col("asset_id").cast("string").alias("b"))
    return own.unionByName(moved["edges"].select(F.lit("edges").alias("what"), F.col("source_id").cast("string").alias("a"), F.col("target_id").cast("string").alias("b")))


def media_stats_joined(spark: SparkSession, d: str) -> DataFrame:
    """Orders that a join with their lines brought several times, each counted once."""
    rows = _table(spark, d, "orders").join(_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), "o_orderkey")
    return library.media_stats(rows, {"open": F.col("o_orderstatus") == "O"}, "o_custkey", "o_orderkey")


def thumbnail_queue_page(spark: SparkSession, d: str) -> DataFrame:
    """The page of the queue after a cursor."""
    rows = _table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "t").alias("thumb"), F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderdate").cast("timestamp")).alias("modified"), F.lit(None).cast("timestamp").alias("thumb_at"), F.lit(False).alias("upgradeable"))
    failures = rows.select("id", F.lit("2000-01-01").cast("timestamp").alias("failed_at")).limit(0)
    return lifecycle.thumbnail_queue(rows, failures, F.lit("2024-01-01").cast("timestamp"), 50, {"modified": datetime(1996, 6, 1), "id": 500}).select("id")


QUERIES = {f.__name__: f for f in (identity_cascade, media_stats_joined, thumbnail_queue_page, sync_increments, facet_queue, reparse_steps, prompt_index, guidance_classes, evidence_conflicts)}


def _has(words: list) -> str:
    return "(" + " OR ".join("(" + " AND ".join(f"contains(n, '{w}')" for w in ((x,) if isinstance(x, str) else x)) + ")" for x in words) + ")"


def _guidance_sql() -> str:
    quoted = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    cases, rule = [], 0
    for (category, subtype), hashes in guidance.SIGNATURES.items():
        rule += 1
        cases.append(f"WHEN list_contains({quoted(hashes)}, h) THEN '{category}|{subtype}|{rule}'")
    for family, here, kinds in (("ipadapter", "ip OR (NOT t2i AND NOT kind AND (strong OR (likely AND NOT control)))", guidance.IP_KINDS), ("t2iadapter", "t2i", guidance.CONTROL_KINDS), ("controlnet", "control OR kind", guidance.CONTROL_KINDS)):
        for subtype, words in kinds:
            rule += 1
            cases.append(f"WHEN ({here}) AND {_has(words)} THEN '{family}|{subtype}|{rule}'")
    flags = ", ".join(f"{_has(words)} AS {name}" for name, words in (("ip", guidance.IP_NAMES), ("control", guidance.CONTROL_NAMES), ("t2i", guidance.T2I_NAMES), ("kind", guidance.CONTROL_WORDS), ("strong", guidance.IP_WORDS), ("likely", guidance.IP_LIKELY)))
    return f"""
WITH p AS (SELECT p_partkey, replace(replace(lower({quoted(_NAMES)}[p_partkey % {len(_NAMES)} + 1] || '-' || p_partkey), ' ', '_'), '-', '_') AS n, CASE WHEN p_partkey % 9 = 0 THEN {quoted(_HASHES)}[p_partkey // 9 % {len(_HASHES)} + 1] ELSE '' END AS h FROM part),
f AS (SELECT *, {flags} FROM p),
c AS (SELECT p_partkey, string_split(CASE {' '.join(cases)} END, '|') AS c FROM f)
SELECT p_partkey, c[1] AS category, c[2] AS subtype, CAST(c[3] AS INTEGER) AS rule FROM c"""


_EVIDENCE = "SELECT l_orderkey, 'mode' AS field, l_linenumber AS rank, 'm' || CAST(l_suppkey % 7 AS VARCHAR) AS value FROM lineitem UNION ALL SELECT l_orderkey, 'flag', l_linenumber, l_returnflag FROM lineitem UNION ALL SELECT l_orderkey, 'status', l_linenumber, l_linestatus FROM lineitem WHERE l_linenumber > 1"

_MOVED = "CASE {0} % 10 WHEN 0 THEN {0} + 2 WHEN 1 THEN {0} + 1 ELSE {0} END"

SQL = {
    "identity_cascade": f"WITH c AS (SELECT c_custkey AS k, {_MOVED.format('c_custkey')} AS n FROM customer), o AS (SELECT o_orderstatus AS s, coalesce(c.n, o_custkey) AS a, coalesce(t.n, o_custkey % 20) AS b FROM orders LEFT JOIN c ON c.k = o_custkey LEFT JOIN c t ON t.k = o_custkey % 20) SELECT DISTINCT 'members' AS what, s AS a, CAST(a AS VARCHAR) AS b FROM o UNION ALL SELECT DISTINCT 'edges', CAST(a AS VARCHAR), CAST(b AS VARCHAR) FROM o",
    "media_stats_joined": "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS open, CAST(coalesce(sum(o_custkey), 0) AS BIGINT) AS total_size FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)",
    "thumbnail_queue_page": "WITH q AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS m FROM orders WHERE o_orderkey % 2 = 1) SELECT id FROM q WHERE m < TIMESTAMP '1996-06-01' OR m IS NULL OR (m = TIMESTAMP '1996-06-01' AND id > 500) ORDER BY m DESC NULLS LAST, id LIMIT 50",
    "sync_increments": "SELECT event_id AS id, date_trunc('day', ts) AS created, event_type, CAST(0 AS BIGINT) AS taken_last FROM events",
    "facet_queue": "SELECT o_orderpriority AS key, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN -1 ELSE 1 END) AS BIGINT) AS count, 0 AS left FROM orders GROUP BY 1",
    "reparse_steps": "SELECT p_partkey AS id, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 3 <> 0 THEN CAST(p_size AS BIGINT) END AS steps, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 3 <> 0 THEN p_partkey END AS seed, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 7 <> 0 THEN 2 ELSE 1 END AS parser_version, 8 AS done FROM part",
    "prompt_index": " UNION ALL ".join(f"SELECT doc_id, '{p}' AS phrase FROM documents WHERE contains(lower(text), '{p}')" for p in PHRASES),
    "guidance_classes": _guidance_sql(),
    "evidence_conflicts": f"WITH c AS (SELECT *, min(rank) OVER (PARTITION BY l_orderkey, field) AS best FROM ({_EVIDENCE})) SELECT l_orderkey, field, min(value) FILTER (rank = best) AS value, min(rank) AS rank, count(*) AS n, min(value) <> max(value) AS conflict FROM c GROUP BY 1, 2",
}
