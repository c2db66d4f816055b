"""Queries for filters, scopes, catalogs and maintenance on an asset table that is made of orders.

The same expressions make the tables in Spark and in the oracle's SQL, so only the operator differs.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions import text
from loomery.operators import duplicates, facets, library, lifecycle, parameters, provenance, search
from loomery.operators.search import Fields, FilterState, Tables, apply_filter, compile_query
from loomery.sources import files

ASSETS = [
    "o_orderkey AS id",
    "'/lib/' || CAST(o_custkey % 7 AS STRING) || '/' || CAST(o_orderkey AS STRING) || '.png' AS path",
    "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Unknown' ELSE 'M' || CAST(o_custkey % 4 AS STRING) END AS model",
    "'bad ' || o_orderpriority AS negative",
    "'a cat by ' || o_orderpriority AS prompt",
    "o_orderpriority AS tool",
    "CASE WHEN o_orderkey % 2 = 0 THEN 'DPM_' || o_orderstatus ELSE 'dpm-' || o_orderstatus END AS sampler",
    "CASE o_orderkey % 3 WHEN 0 THEN 'txt2img' WHEN 1 THEN 'img2img' ELSE 'grid' END AS generation_type",
    "CASE WHEN o_orderkey % 9 = 0 THEN 'video' ELSE 'image' END AS media_type",
    "o_orderkey % 3 = 0 AS is_favorite",
    "o_orderkey % 4 = 0 AS is_pinned",
    "o_orderkey % 11 = 0 AS is_deleted",
    "CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS is_intermediate",
    "o_orderkey % 13 = 0 AS is_grid",
    "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderkey % 17 = 0 END AS is_asset",
    "o_orderkey % 19 = 0 AS scope_hidden",
    "o_orderkey % 7 = 0 AS privacy_hidden",
    "CASE WHEN o_orderkey % 8 > 0 THEN o_totalprice END AS rating",
    "CASE o_orderkey % 4 WHEN 0 THEN '{\"model\":\"J' || CAST(o_custkey % 3 AS STRING) || '\",\"upscaled\":true,\"seed\":' || CAST(o_custkey AS STRING) || ',\"steps\":20,\"cfg\":7.5,\"positivePrompt\":\"\",\"positive_prompt\":\"x\"}' WHEN 1 THEN '{\"upscaled\":false,\"seed\":\"5\",\"sampler\":\"Euler_a\",\"modelHash\":\"h' || CAST(o_custkey % 50 AS STRING) || '\"}' WHEN 2 THEN '{bad' ELSE NULL END AS metadata_json",
    "'u' || CAST(o_custkey % 3 AS STRING) AS owner_id",
    "CASE WHEN o_orderkey % 5 > 0 THEN 'h' || CAST(o_custkey % 40 AS STRING) ELSE '' END AS model_hash",
    "CASE WHEN o_custkey % 2 = 0 THEN 'name' || CAST(o_custkey % 40 AS STRING) ELSE ' ' END AS model_name",
    "CASE WHEN o_orderkey % 3 > 0 THEN '/t/' || CAST(o_orderkey AS STRING) END AS thumb",
    "o_orderdate AS ts",
    "o_custkey AS size",
]
FIELDS = Fields(
    id="id", prompt="prompt", negative="negative", path="path", json="metadata_json", model="model", sampler="sampler", tool="tool", timestamp="ts", deleted="is_deleted", intermediate="is_intermediate", grid="is_grid", source_asset="is_asset", owner_hidden="scope_hidden", privacy_hidden="privacy_hidden"
)
BARE = Fields(id="id", prompt="prompt", negative="negative", path="path", json="metadata_json", model="model", sampler="sampler", tool="tool", timestamp="ts")
BRIDGE = ["l_orderkey AS asset_id", "CASE l_linenumber % 3 WHEN 0 THEN 'loras' WHEN 1 THEN 'controlnets' ELSE 'ip_adapters' END AS kind", "'Res' || CAST(l_partkey % 20 AS STRING) || ' (0.80)' AS name"]
MEMBERS = ["'c' || CAST(l_suppkey % 4 AS STRING) AS collection_id", "l_orderkey AS asset_id"]
MODELS = ["'h' || CAST(p_partkey % 60 AS STRING) AS hash", "CASE p_partkey % 4 WHEN 0 THEN 'disk_scan' WHEN 1 THEN 'lookup_failed' WHEN 2 THEN 'harvest_x' ELSE NULL END AS lookup_source", "CASE WHEN p_partkey % 3 = 0 THEN 'f' ELSE '' END AS filename", "CASE WHEN p_partkey % 5 = 0 THEN 1 END AS remote_version", "p_name AS name", "'loras' AS resource_type"]


def _made(spark: SparkSession, d: str, table: str, expressions: list[str]) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet").selectExpr(*expressions)


def _assets(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d, "orders", ASSETS)


def _tables(spark: SparkSession, d: str) -> Tables:
    smart = {"s": FilterState(query="cat", generation_types=("txt2img",), date_preset="custom", date_start="1995", date_end="1996")}
    return Tables(bridge=_made(spark, d, "lineitem", BRIDGE), membership=_made(spark, d, "lineitem", MEMBERS), smart=smart)


_WITH = f"WITH a AS (SELECT {', '.join(ASSETS)} FROM orders), b AS (SELECT {', '.join(BRIDGE)} FROM lineitem), m AS (SELECT {', '.join(MEMBERS)} FROM lineitem), mo AS (SELECT {', '.join(MODELS)} FROM part) "
_SHOWN = "NOT is_deleted AND NOT scope_hidden AND NOT coalesce(is_intermediate, false) AND NOT is_grid AND NOT coalesce(is_asset, false)"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _filter(name: str, state: FilterState, sql: str, *, fields: Fields = BARE, side: bool = False, now: datetime | None = None) -> None:
    """Registers a filter over the assets that returns ids."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return apply_filter(_assets(spark, d), state, fields, _tables(spark, d) if side else None, now=now).select("id")

    QUERIES[name], SQL[name] = run, f"{_WITH} SELECT id FROM a WHERE {sql}"


def _query(sql: str):
    """Registers a function under its name with its SQL."""

    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, _WITH + sql
        return f

    return put


_HAS = "EXISTS (SELECT 1 FROM b WHERE b.asset_id = a.id AND kind = '{}' AND contains(lower(name), '{}'))"
_IN = "EXISTS (SELECT 1 FROM m WHERE m.asset_id = a.id AND collection_id = '{}')"
_filter("filter_visible", FilterState(), _SHOWN, fields=FIELDS)
_filter("filter_view_toggles", FilterState(show_intermediates=True, show_grids=True), "NOT is_deleted AND NOT scope_hidden AND NOT coalesce(is_asset, false)", fields=FIELDS)
_filter("filter_privacy_hidden", FilterState(hide_private=True), f"{_SHOWN} AND NOT privacy_hidden", fields=FIELDS)
_filter("filter_media_type", FilterState(media_type="video"), "media_type = 'video'")
_filter("filter_favorites_pinned", FilterState(favorites=True, pinned=True), "is_favorite AND is_pinned")
_filter("filter_models_unknown", FilterState(models=(("m1", "M2"), ("Unknown",))), "lower(model) IN ('m1', 'm2') OR model IS NULL OR lower(model) IN ('', 'unknown')")
_filter("filter_models_aliases", FilterState(models=(("m1", "M2"),)), "lower(model) IN ('m1', 'm2')")
_filter("filter_tools_all", FilterState(tools=("1-urgent",), tools_mode="all"), "lower(tool) = '1-urgent'")
_filter("filter_tools_all_of_two", FilterState(tools=("1-URGENT", "3-MEDIUM"), tools_mode="all", query="cat"), "tool = '1-URGENT' AND tool = '3-MEDIUM'")
_filter("filter_generation_types", FilterState(generation_types=("txt2img", "grid")), "generation_type IN ('txt2img', 'grid')")
_filter("filter_samplers", FilterState(samplers=("DPM f", "dpm-O")), "replace(replace(lower(sampler), '_', ' '), '-', ' ') IN ('dpm f', 'dpm o')")
_filter("filter_collection", FilterState(collection="c1"), _IN.format("c1"), side=True)
_filter("filter_smart_collection", FilterState(collection="s"), "contains(prompt, 'cat') AND generation_type = 'txt2img' AND ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1997-01-01'", side=True)
_filter("filter_smart_own_date", FilterState(collection="s", date_preset="custom", date_start="1997-02", date_end="1997-01"), "generation_type = 'txt2img' AND ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1997-03-01'", side=True)
_filter("filter_collection_lora", FilterState(collection="c2", resources={"loras": (("res3", "RES4"),)}), f"{_IN.format('c2')} AND EXISTS (SELECT 1 FROM b WHERE b.asset_id = a.id AND kind = 'loras' AND name IN ('Res3 (0.80)', 'Res4 (0.80)'))", side=True)
_filter("filter_excluded_list", FilterState(excluded_ids=(1, 2, 3, 5, 8)), "id NOT IN (1, 2, 3, 5, 8)")
_filter("filter_date_month", FilterState(date_preset="month"), "ts >= TIMESTAMP '1998-05-02'", now=datetime(1998, 6, 1, 13))
_filter("filter_date_today", FilterState(date_preset="today"), "ts >= TIMESTAMP '1998-06-01' AND ts < TIMESTAMP '1998-06-02'", now=datetime(1998, 6, 1, 13))
for _name, _text, _sql in (
    ("key_model", "model:m1", "contains(lower(coalesce(model, '')), 'm1') OR (id % 4 = 0 AND contains(metadata_json, '\"model\":\"M1'))"),
    ("key_model_json", "model:j2", "id % 4 = 0 AND contains(metadata_json, '\"model\":\"J2')"),
    ("key_negative", "neg:urgent -negative:zzz", "contains(lower(negative), 'urgent')"),
    ("key_path", "file:/3/ -path:9.png", "contains(path, '/3/') AND NOT contains(path, '9.png')"),
    ("key_all", "all:upscaled", "contains(coalesce(path, ''), 'upscaled') OR contains(coalesce(metadata_json, ''), 'upscaled')"),
    ("key_all_negated", "-all:upscaled", "NOT contains(path, 'upscaled') AND NOT contains(metadata_json, 'upscaled')"),
    ("key_sampler", "sampler:dpm_f", "contains(lower(sampler), 'dpm_f')"),
    ("key_controlnet", "cn:res7 -controlnet:res17", f"{_HAS.format('controlnets', 'res7')} AND NOT {_HAS.format('controlnets', 'res17')}"),
    ("key_ip_adapter", "ip:res1 !ipadapter:res11", f"{_HAS.format('ip_adapters', 'res1')} AND NOT {_HAS.format('ip_adapters', 'res11')}"),
    ("key_upscaled", "upscaled:true", "id % 4 = 0"),
    ("key_not_upscaled", "upscaled:false", "id % 4 = 1"),
    ("key_unknown", "nokey:x cat", "contains(prompt, 'cat')"),
    ("key_dates", "after:1996-03 before:1997", "ts >= TIMESTAMP '1996-03-01' AND ts < TIMESTAMP '1998-01-01'"),
):
    _filter(_name, FilterState(query=_text), _sql, side=True)


@_query("SELECT id FROM a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.asset_id = a.id AND collection_id = 'c3')")
def filter_excluded_table(spark: SparkSession, d: str) -> DataFrame:
    tables = Tables(excluded=_made(spark, d, "lineitem", MEMBERS).filter("collection_id = 'c3'"))
    return apply_filter(_assets(spark, d), FilterState(), BARE, tables).select("id")


def _all_pages(name: str, descending: bool) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        """All pages of all assets; those of null ratings are the last ones down and the first ones up."""
        found = library.paged(_assets(spark, d).select("id", "rating"), "rating", "id", 60, descending=descending)
        return found.select(F.col("page").cast("int").alias("page"), "place", "id", "rating")

    order = "rating DESC NULLS LAST, id DESC" if descending else "rating ASC NULLS FIRST, id ASC"
    QUERIES[name] = run
    SQL[name] = f"{_WITH}, r AS (SELECT id, rating, row_number() OVER (ORDER BY {order}) - 1 AS n FROM a) SELECT CAST(n // 60 AS INTEGER) AS page, CAST(n % 60 AS INTEGER) AS place, id, rating FROM r"


_all_pages("page_nulls_down", True)
_all_pages("page_nulls_up", False)


def _used(spark: SparkSession, d: str) -> DataFrame:
    return _assets(spark, d).filter("model_hash <> ''").groupBy(F.lit("checkpoints").alias("facet"), F.col("model_name").alias("name"), F.col("model_hash").alias("hash")).agg(F.count("*").alias("count"), F.min("ts").alias("first_used"), F.max("ts").alias("last_used"))


_USED = ", u AS (SELECT 'checkpoints' AS facet, model_name AS name, model_hash AS hash, count(*) AS count, min(ts) AS first_used, max(ts) AS last_used FROM a WHERE model_hash <> '' GROUP BY 2, 3), f AS (SELECT DISTINCT CASE WHEN p_partkey % 7 = 0 THEN 'loras' ELSE 'checkpoints' END AS facet, 'NAME' || CAST(p_partkey % 9 AS VARCHAR) AS name, 'h' || CAST(p_partkey % 11 + 20 AS VARCHAR) AS hash FROM part WHERE p_size < 30) "


def _facets(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d, "part", ["p_size", "CASE WHEN p_partkey % 7 = 0 THEN 'loras' ELSE 'checkpoints' END AS facet", "'NAME' || CAST(p_partkey % 9 AS STRING) AS name", "'h' || CAST(p_partkey % 11 + 20 AS STRING) AS hash"]).filter("p_size < 30").drop("p_size").distinct()


@_query(_USED.lstrip() + "SELECT facet, name, hash, count FROM u WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.facet = u.facet AND (f.hash = u.hash OR lower(f.name) = lower(u.name)))")
def facet_orphans(spark: SparkSession, d: str) -> DataFrame:
    return facets.orphans(_used(spark, d), _facets(spark, d)).select("facet", "name", "hash", "count")


@_query(_USED.lstrip() + "SELECT facet, lower(name) AS key, min(hash) AS hash, CAST(sum(count) AS BIGINT) AS count, min(first_used) AS first_used, max(last_used) AS last_used FROM u GROUP BY 1, 2")
def facet_rollup(spark: SparkSession, d: str) -> DataFrame:
    return facets.rollup(_used(spark, d)).drop("name")


@_query("SELECT tool AS name, count(*) FILTER (id % 500 = 1) AS count FROM a GROUP BY 1")
def facet_zero_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _assets(spark, d).select(F.col("tool").alias("name"), "id")
    return facets.with_zero_counts(rows, rows.filter("id % 500 = 1"), "name")


@_query("SELECT p_brand AS name, CAST((SELECT count(*) FROM part q WHERE q.p_brand = p.p_brand) + (SELECT count(*) FROM part q WHERE p.p_brand = 'Brand#13' AND q.p_brand = 'Brand#22') AS BIGINT) AS count FROM (SELECT DISTINCT p_brand FROM part) p")
def facet_alias_counts(spark: SparkSession, d: str) -> DataFrame:
    brands = _made(spark, d, "part", ["'brand' AS facet", "p_brand AS name"])
    groups = brands.distinct().withColumn("aliases", F.when(F.col("name") == "Brand#13", F.array(F.lit("brand_#22.pth"), F.lit("BRAND#13"))))
    counts = brands.groupBy("facet", text.match_key(F.col("name")).alias("key")).agg(F.count("*").alias("count"))
    return facets.scoped_alias_counts(groups, counts).select("name", "count")


@_query("SELECT name, count, CAST(row_number() OVER (ORDER BY count DESC, name) AS INTEGER) AS place FROM (SELECT p_brand AS name, count(*) AS count FROM part GROUP BY 1)")
def facet_sorted(spark: SparkSession, d: str) -> DataFrame:
    rows = _made(spark, d, "part", ["p_brand AS name"]).groupBy("name").agg(F.count("*").alias("count"))
    return facets.numbered(rows, "count_desc").select("name", "count", "place")


@_query("SELECT mo.resource_type, mo.name, mo.hash, coalesce((SELECT max(s_suppkey) FROM supplier WHERE 'h' || CAST(s_suppkey % 50 AS VARCHAR) = mo.hash), -1) AS local_modified FROM mo WHERE lookup_source = 'disk_scan'")
def facet_local_models(spark: SparkSession, d: str) -> DataFrame:
    scanned = _made(spark, d, "supplier", ["'h' || CAST(s_suppkey % 50 AS STRING) AS hash", "s_suppkey AS modified"])
    return facets.local_models(_made(spark, d, "part", MODELS).withColumn("scanned_at", F.lit(-1).cast("long")), scanned).drop("scanned_at")


_LOOKUP = "used AS (SELECT DISTINCT hash FROM (SELECT model_hash AS hash FROM a WHERE NOT scope_hidden UNION ALL SELECT 'h' || CAST(o_custkey % 50 AS VARCHAR) FROM orders WHERE o_orderkey % 4 = 1 AND o_orderkey % 19 <> 0)) "


@_query(
    "," + _LOOKUP + "SELECT hash FROM used WHERE hash <> '' AND hash NOT IN (SELECT hash FROM mo) UNION SELECT hash FROM mo WHERE remote_version IS NULL AND (filename <> '' OR lookup_source = 'disk_scan' OR hash IN (SELECT hash FROM used)) "
    "AND (coalesce(lookup_source, '') <> 'harvest_x' OR hash IN (SELECT hash FROM used)) AND (coalesce(lookup_source, '') <> 'lookup_failed')"
)
def hashes_to_resolve(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    models = _made(spark, d, "part", MODELS).withColumn("scanned_at", F.lit("2024-01-01 12:00:00").cast("timestamp"))
    return lifecycle.hashes_to_resolve(_assets(spark, d), models, now)


@_query(", k AS (SELECT hash, bool_and(coalesce(lookup_source, '') = 'lookup_failed') AS failed FROM mo GROUP BY 1), n AS (SELECT model_hash, bool_or(trim(model_name) <> '') AS named FROM a LEFT JOIN k ON k.hash = a.model_hash WHERE NOT scope_hidden AND model_hash <> '' AND (k.hash IS NULL OR k.failed) GROUP BY 1) SELECT count(*) FILTER (named) AS named, count(*) FILTER (NOT named) AS unknown FROM n")
def hashes_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.unresolved_counts(_assets(spark, d), _made(spark, d, "part", MODELS))


@_query("SELECT id, CASE WHEN starts_with(path, '/lib/3/') THEN owner_id <> 'u1' ELSE scope_hidden END AS scope_hidden FROM a")
def owner_scope(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.refresh_owner_scope(_assets(spark, d), "/LIB/3/", "owner", " u1 ").select("id", "scope_hidden")


@_query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0 OR c_nationkey % 3 = 1")
def owner_collections(spark: SparkSession, d: str) -> DataFrame:
    rows = _made(spark, d, "customer", ["c_custkey AS id", "CASE WHEN c_custkey % 2 = 1 THEN 'external' END AS source", "'u' || CAST(c_nationkey % 3 AS STRING) AS owner_id"])
    return lifecycle.scoped_collections(rows, "owner", "u1").select("id")


_THUMBS = "t AS (SELECT p_partkey AS key, CASE p_partkey % 3 WHEN 0 THEN '/t/' || CAST(p_partkey AS VARCHAR) WHEN 1 THEN '/lib/' || CAST(p_partkey % 7 AS VARCHAR) || '/' || CAST(p_partkey AS VARCHAR) || '.png' END AS best_thumb, CASE WHEN p_partkey % 2 = 0 THEN 'safe' END AS safe_thumb, CASE WHEN p_partkey % 3 = 2 THEN p_partkey END AS thumb_asset FROM part), h AS (SELECT * FROM a WHERE scope_hidden), x AS (SELECT t.*, EXISTS (SELECT 1 FROM h WHERE CAST(h.id AS VARCHAR) = t.best_thumb OR h.path = t.best_thumb OR h.thumb = t.best_thumb OR h.id = t.thumb_asset) AS hit FROM t) "


@_query("," + _THUMBS + "SELECT key, CASE WHEN hit THEN safe_thumb ELSE best_thumb END AS best_thumb, CASE WHEN NOT hit THEN thumb_asset END AS thumb_asset, CASE WHEN hit THEN safe_thumb IS NULL ELSE false END AS thumb_sensitive FROM x")
def owner_thumbnails(spark: SparkSession, d: str) -> DataFrame:
    rows = _made(spark, d, "part", ["p_partkey AS key", "CASE p_partkey % 3 WHEN 0 THEN '/t/' || CAST(p_partkey AS STRING) WHEN 1 THEN '/lib/' || CAST(p_partkey % 7 AS STRING) || '/' || CAST(p_partkey AS STRING) || '.png' END AS best_thumb", "CASE WHEN p_partkey % 2 = 0 THEN 'safe' END AS safe_thumb", "CAST(CASE WHEN p_partkey % 3 = 2 THEN p_partkey END AS STRING) AS thumb_asset", "false AS thumb_sensitive"])
    assets = _assets(spark, d).withColumn("id", F.col("id").cast("string"))
    return lifecycle.hide_owner_thumbnails(rows, assets).select("key", "best_thumb", F.col("thumb_asset").cast("long").alias("thumb_asset"), "thumb_sensitive")


@_query(", w AS (SELECT DISTINCT CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN '/t/' || CAST(o_orderkey AS VARCHAR) ELSE 'none' END AS mark FROM orders), k AS (SELECT CAST(id AS VARCHAR) AS mark, 0 AS r, id FROM a UNION ALL SELECT path, 1, id FROM a UNION ALL SELECT thumb, 2, id FROM a WHERE thumb IS NOT NULL) SELECT w.mark, CAST((SELECT first(k.id ORDER BY k.r, k.id) FROM k WHERE k.mark = w.mark) AS BIGINT) AS asset_id FROM w")
def identity_lookup(spark: SparkSession, d: str) -> DataFrame:
    wanted = _made(spark, d, "orders", ["CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey AS STRING) WHEN 1 THEN '/t/' || CAST(o_orderkey AS STRING) ELSE 'none' END AS mark"]).distinct()
    assets = _assets(spark, d).select(F.col("id").cast("string").alias("id"), "path", "thumb")
    return lifecycle.find_identity(wanted, assets).select("mark", F.col("asset_id").cast("long").alias("asset_id"))


@_query("SELECT p_partkey, contains(lower(p_name), 'cold') OR contains(lower(p_name), 'wid') AS flagged FROM part")
def keyword_names(spark: SparkSession, d: str) -> DataFrame:
    rows = _made(spark, d, "part", ["p_partkey", "p_name AS name"])
    keywords = spark.createDataFrame([("Cold",), (" wid ",), (None,), ("",)], "keyword string")
    return library.token_matches(rows, keywords).select("p_partkey", "flagged")


@_query("SELECT count(*) AS count FROM a WHERE starts_with(path, '/lib/3/')")
def path_prefix_count(spark: SparkSession, d: str) -> DataFrame:
    return library.prefix_count(_assets(spark, d), "path", "/Lib/3\\")


@_query("SELECT id, CAST(CASE WHEN id % 4 = 0 THEN 20 END AS INTEGER) AS steps, CASE WHEN id % 4 = 0 THEN size END AS seed, CAST(CASE WHEN id % 4 = 0 THEN 7.5 END AS DOUBLE) AS cfg, CASE WHEN id % 4 = 1 THEN 'euler a' WHEN id % 4 = 3 THEN sampler END AS sampler, CASE WHEN id % 4 = 0 THEN 'x' END AS positive FROM a")
def parameter_backfill(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.backfill_parameters(_assets(spark, d)).select("id", "steps", "seed", "cfg", "sampler", "positive")


def _reparsed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _assets(spark, d).select("id", "path", "tool", "media_type", "is_deleted", F.when(F.col("id") % 4 < 2, F.concat(F.lit("a cat\nSteps: "), F.col("size").cast("string"))).alias("original"), F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("int")).alias("parser_version"), F.lit(7).cast("long").alias("steps"))
    return lifecycle.reparse(rows, lambda x: parameters.parse_blocks(x, "original", ["id"]).select("id", "steps"), 2, folder="/lib/2")


_DUE = "NOT is_deleted AND media_type <> 'video' AND id % 4 < 2 AND (id % 3 = 0 OR id % 3 < 2) AND starts_with(path, '/lib/2/')"


@_query(f"SELECT id, CASE WHEN {_DUE} THEN size ELSE 7 END AS steps, CASE WHEN {_DUE} THEN 2 WHEN id % 3 > 0 THEN CAST(id % 3 AS INTEGER) END AS parser_version FROM a")
def reparse_assets(spark: SparkSession, d: str) -> DataFrame:
    return _reparsed(spark, d)[0].select("id", "steps", "parser_version")


@_query(f"SELECT id, 'steps' AS field, '7' AS before, CAST(size AS VARCHAR) AS after FROM a WHERE {_DUE} AND size <> 7")
def reparse_diff(spark: SparkSession, d: str) -> DataFrame:
    return _reparsed(spark, d)[1]


@_query("SELECT id, path NOT IN (SELECT path FROM a WHERE id % 3 > 0) AS missing FROM a")
def missing_files(spark: SparkSession, d: str) -> DataFrame:
    rows = _assets(spark, d).select(F.col("path").alias("id"), F.col("id").alias("number"))
    return lifecycle.mark_missing(rows, _assets(spark, d).filter("id % 3 > 0").select("path")).select(F.col("number").alias("id"), "missing")


@_query("SELECT id, coalesce((SELECT last(l_quantity > 25 ORDER BY l_linenumber) FROM lineitem WHERE l_orderkey = a.id), false) AS corrupt FROM a WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = a.id GROUP BY l_linenumber HAVING count(*) > 1)")
def corrupt_files(spark: SparkSession, d: str) -> DataFrame:
    checks = _made(spark, d, "lineitem", ["l_orderkey AS id", "l_linenumber AS checked_at", "CASE WHEN l_quantity > 25 THEN 'bad' END AS error"])
    twice = checks.groupBy("id", "checked_at").count().filter("count > 1").select("id").distinct()
    return lifecycle.mark_corrupt(_assets(spark, d).select("id"), checks).join(twice, "id", "left_anti")


@_query("SELECT id, CASE WHEN id % 3 = 0 OR id % 4 > 0 THEN thumb END AS thumb, CASE WHEN id % 3 > 0 AND id % 4 = 0 THEN size + 1 ELSE size END AS size FROM a")
def video_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = _assets(spark, d).select("id", "thumb", "size", F.col("ts").alias("modified"))
    new = rows.filter("id % 3 > 0").select("id", "modified", (F.col("size") + F.when(F.col("id") % 4 == 0, 1).otherwise(0)).alias("size"))
    return lifecycle.reset_on_change(rows, new, ["thumb"]).select("id", "thumb", "size")


@_query("SELECT id FROM a WHERE (thumb IS NULL OR id % 5 = 0) AND id % 4 > 0 ORDER BY ts DESC, id LIMIT 40")
def thumbnail_queue(spark: SparkSession, d: str) -> DataFrame:
    rows = _assets(spark, d).select("id", "thumb", F.col("ts").alias("modified"), F.when(F.col("id") % 2 == 0, F.col("ts")).alias("thumb_at"), (F.col("id") % 5 == 0).alias("upgradeable"))
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    failures = rows.select("id", F.when(F.col("id") % 4 == 0, F.lit("2023-12-31 23:30:00")).otherwise("2023-12-31 22:00:00").cast("timestamp").alias("failed_at"))
    return lifecycle.thumbnail_queue(rows, failures, now, 40).select("id")


@_query("SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 ELSE 0 END + CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END AS BIGINT) AS failure_count FROM orders WHERE o_orderkey % 3 <> 2 AND (o_orderkey % 2 = 0 OR o_orderkey % 3 = 1)")
def thumbnail_failures(spark: SparkSession, d: str) -> DataFrame:
    """Failures of even ids after results: ids with remainder 1 of 3 fail again or anew, those with 2 succeed."""
    old = _made(spark, d, "orders", ["o_orderkey AS id", "o_orderkey % 4 AS failure_count", "'x' AS last_error", "o_orderdate AS failed_at"]).filter("id % 2 = 0")
    results = _made(spark, d, "orders", ["o_orderkey AS id", "CASE WHEN o_orderkey % 3 = 1 THEN 'y' END AS error", "o_orderdate AS at"]).filter("id % 3 > 0")
    return lifecycle.thumbnail_results(old, results).select("id", "failure_count")


@_query("SELECT id FROM a WHERE NOT scope_hidden AND NOT is_deleted AND media_type = 'image' AND id % 5 > 0 ORDER BY ts DESC, id LIMIT 30")
def failure_list(spark: SparkSession, d: str) -> DataFrame:
    rows = _assets(spark, d)
    failures = rows.select("id", (F.col("id") % 5).alias("failure_count"), F.col("ts").alias("failed_at"))
    return lifecycle.failure_list(failures, rows.withColumn("missing", F.lit(False)), 30).select("id")


@_query("SELECT name FROM mo UNION SELECT model_name FROM a")
def harvest_names(spark: SparkSession, d: str) -> DataFrame:
    known = _made(spark, d, "part", MODELS).select("name").distinct()
    return lifecycle.harvest(known, _assets(spark, d).select(F.col("model_name").alias("name")))


@_query("SELECT id, coalesce((SELECT min(name) FROM mo WHERE mo.hash = a.model_hash), model_name) AS resolved FROM a")
def resolved_names(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.resolve_names(_assets(spark, d).withColumn("model_hash", F.upper("model_hash")), _made(spark, d, "part", MODELS)).select("id", "resolved")


@_query("SELECT id, coalesce(thumb, tool) AS tool FROM a")
def reverted(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.revert(_assets(spark, d), {"tool": "thumb"}).select("id", "tool")


@_query("SELECT id, CASE id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE contains(lower(prompt), 'urgent') END AS privacy_hidden FROM a")
def privacy_reindex(spark: SparkSession, d: str) -> DataFrame:
    rows = _assets(spark, d).withColumn("masked", F.when(F.col("id") % 3 < 2, F.col("id") % 3 == 0))
    return lifecycle.reindex_privacy(rows, [" URGENT", ""], None)[0].select("id", "privacy_hidden")


@_query("SELECT l_orderkey AS source_id, l_returnflag AS role FROM lineitem WHERE l_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 3 = 0")
def edges_replaced(spark: SparkSession, d: str) -> DataFrame:
    edges = _made(spark, d, "lineitem", ["l_orderkey AS source_id", "l_returnflag AS role"])
    return provenance.replace_edges(edges, _made(spark, d, "orders", ["o_orderkey AS source_id", "'new' AS role"]).filter("source_id % 3 = 0"))


@_query(", e AS (SELECT DISTINCT l_orderkey AS source_id, CASE l_linenumber % 3 WHEN 0 THEN 'mask' WHEN 1 THEN 'init' ELSE 'zzz' END AS role, CASE l_linenumber % 3 WHEN 0 THEN 3 WHEN 1 THEN 0 ELSE 5 END AS r FROM lineitem) SELECT source_id, string_agg(role, '|' ORDER BY r) AS roles FROM e GROUP BY 1")
def edges_grouped(spark: SparkSession, d: str) -> DataFrame:
    edges = _made(spark, d, "lineitem", ["l_orderkey AS source_id", "'n' AS name", "1 AS target_id", "CASE l_linenumber % 3 WHEN 0 THEN 'mask' WHEN 1 THEN 'init' ELSE 'zzz' END AS role"])
    return provenance.grouped(edges).select("source_id", F.array_join("roles", "|").alias("roles"))


@_query("SELECT DISTINCT collection_id, CASE WHEN asset_id % 5 = 0 THEN asset_id + 1 ELSE asset_id END AS asset_id FROM m")
def identity_moved(spark: SparkSession, d: str) -> DataFrame:
    moves = _made(spark, d, "orders", ["o_orderkey AS old_id", "o_orderkey + 1 AS new_id"]).filter("old_id % 5 = 0")
    return lifecycle.remap(_made(spark, d, "lineitem", MEMBERS).distinct(), moves, "asset_id")


@_query("SELECT id FROM a WHERE id % 3 = 0 OR id % 4 = 0")
def reimported(spark: SparkSession, d: str) -> DataFrame:
    """Files without a known row (remainder 0 of 3) and those whose size differs (remainder 0 of 4)."""
    rows = _assets(spark, d)
    known = rows.filter("id % 3 > 0").select(F.col("path").alias("id"), F.col("ts").alias("modified"), "size")
    listing = rows.select("path", F.col("ts").alias("modified"), (F.col("size") + F.when(F.col("id") % 4 == 0, 1).otherwise(0)).alias("size"))
    found = lifecycle.reimport(known, listing)
    return found.select(F.regexp_extract("id", r"(\d+)\.png$", 1).cast("long").alias("id"))


@_query("SELECT id, coalesce(CASE WHEN id % 5 = 0 THEN 'manual' END, CASE WHEN id % 7 = 0 THEN 'side' END, CASE WHEN privacy_hidden THEN model_name ELSE thumb END, 'remote') AS thumb FROM a")
def thumbnail_choice(spark: SparkSession, d: str) -> DataFrame:
    pick = facets.choose_thumbnail(F.when(F.col("id") % 5 == 0, "manual"), F.when(F.col("id") % 7 == 0, "side"), F.col("thumb"), F.lit("remote"), F.col("privacy_hidden"), F.col("model_name"))
    return _assets(spark, d).select("id", pick.alias("thumb"))


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, 'click' AS tool FROM events")
def json_written(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet")
    doc = text.json_remove(text.json_set(text.json_set(F.col("props"), {"tool": F.lit("view"), "gone": F.lit("1")}), {"tool": F.lit("click")}), "gone")
    return rows.select("event_id", F.get_json_object(doc, "$.k").alias("k"), F.get_json_object(doc, "$.tool").alias("tool")).filter(F.get_json_object(doc, "$.gone").isNull())


@_query("SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'loras' WHEN 2 THEN 'ip_adapters' WHEN 3 THEN 'control_nets' WHEN 4 THEN 'checkpoint' WHEN 5 THEN 'embeddings' WHEN 6 THEN 'hypernetworks' END AS kind FROM customer")
def model_kinds(spark: SparkSession, d: str) -> DataFrame:
    folders = ["m/Lora/a.pt", "m/loras2/vae/unet/a.pt", "models/x/my-IPAdapter.bin", "m\\t2i_adapter\\a.pth", "m/UNETs/a.ckpt", "embeddings/seg/a.pt", "m/hypernetwork/a.pt", "m/segm/checkpoints/a.pt"]
    path = F.element_at(F.array(*map(F.lit, folders)), (F.col("c_custkey") % 8 + 1).cast("int"))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", text.model_file_type(path).alias("kind"))


@_query("SELECT digest, doc_id AS id FROM (SELECT sha256(text) AS digest, doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1")
def duplicate_members(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"))
    return duplicates.members(rows, "digest")


@_query("SELECT count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS redundant FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def duplicate_total(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"))
    return duplicates.redundant_total(rows, "digest")


@_query("SELECT p_brand, x.p_suppkey AS a, y.p_suppkey AS b, round(1 - levenshtein(x.n, y.n) / CAST(greatest(length(x.n), length(y.n)) AS DOUBLE), 6) AS similarity FROM (SELECT p_brand, p_partkey AS p_suppkey, p_type || ' ' || p_name AS n FROM part) x JOIN (SELECT p_brand, p_partkey AS p_suppkey, p_type || ' ' || p_name AS n FROM part) y USING (p_brand) WHERE x.p_suppkey < y.p_suppkey AND 1 - levenshtein(x.n, y.n) / CAST(greatest(length(x.n), length(y.n)) AS DOUBLE) >= 0.8")
def similar_names(spark: SparkSession, d: str) -> DataFrame:
    rows = _made(spark, d, "part", ["p_brand", "p_partkey", "p_type || ' ' || p_name AS n"])
    return duplicates.similar_names(rows.filter("n IS NOT NULL"), "p_partkey", "n", "p_brand", digits=6)


@_query("SELECT owner_id, count(*) AS count, CASE WHEN owner_id <> 'u2' THEN 'n' || owner_id END AS user_name FROM a GROUP BY 1")
def owner_counts(spark: SparkSession, d: str) -> DataFrame:
    users = spark.createDataFrame([("u0", "nu0"), ("u1", "nu1"), ("u9", "x")], "owner_id string, user_name string")
    return files.owners(_assets(spark, d), users)


@_query("SELECT 'generation_type' AS field, generation_type AS value, count(*) AS count FROM a GROUP BY 2 UNION ALL SELECT 'media_type', media_type, count(*) FROM a GROUP BY 2")
def catalog_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return files.diagnostics(_assets(spark, d), ["generation_type", "media_type"])


@_query("SELECT s_suppkey AS board_id, l_orderkey AS asset_id FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE s_nationkey % 3 = 1")
def board_members(spark: SparkSession, d: str) -> DataFrame:
    boards = _made(spark, d, "supplier", ["s_suppkey AS board_id", "'u' || CAST(s_nationkey % 3 AS STRING) AS owner_id"])
    return files.boards(boards, _made(spark, d, "lineitem", ["l_suppkey AS board_id", "l_orderkey AS asset_id"]), "u1").select("board_id", "asset_id")


@_query("SELECT id FROM a WHERE id % 3 = 0 UNION SELECT l_orderkey FROM lineitem")
def known_identities(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.known_ids(_assets(spark, d).filter("id % 3 = 0"), _made(spark, d, "lineitem", ["l_orderkey AS id"]))


@_query("SELECT id, CASE WHEN id % 3 > 0 THEN tool END AS tool, CASE id % 2 WHEN 0 THEN 'x|y' ELSE 'x' END AS names FROM a")
def metadata_merged(spark: SparkSession, d: str) -> DataFrame:
    rows = _assets(spark, d)
    primary = rows.select("id", F.when(F.col("id") % 3 == 1, F.col("tool")).alias("tool"), F.array(F.lit("x")).alias("names"))
    secondary = rows.filter("id % 2 = 0 or id % 3 = 2").select("id", F.when(F.col("id") % 3 == 2, F.col("tool")).alias("tool"), F.when(F.col("id") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).alias("names"))
    return lifecycle.merge_metadata(primary, secondary, "id", ["names"]).select("id", "tool", F.array_join("names", "|").alias("names"))


@_query("SELECT 'orders' AS \"table\", count(*) AS count FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'region', count(*) FROM region")
def catalog_counts(spark: SparkSession, d: str) -> DataFrame:
    return files.table_counts({name: spark.read.parquet(f"{d}/{name}.parquet") for name in ("orders", "part", "region")})


@_query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'audio_lip_sync' WHEN 1 THEN 'image_to_video' ELSE 'unknown' END AS mode, CASE p_partkey % 3 WHEN 0 THEN 'catalog' WHEN 1 THEN 'graph' ELSE 'block' END AS route FROM part")
def media_routes(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % n + 1).cast("int"))
    mode = parameters.video_mode(pick(["Depth LipSync", "LoadImage", "plain", ""], 4))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", mode.alias("mode"), parameters.route(pick(["InvokeX", "my comfy", "other"], 3)).alias("route"))


@_query("SELECT p_partkey, p_size AS width, p_size * 2 AS height, CAST(p_size * 500 AS BIGINT) AS duration_ms, CASE WHEN p_size % 2 = 0 THEN 25 ELSE 2997 END AS num, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 100 END AS den, 270 AS rotation FROM part")
def media_probe(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/part.parquet")
    number = lambda c: c.cast("string")
    doc = F.concat(F.lit('{"media":{"track":[{"@type":"General","Duration":"'), number(F.col("p_size") / 2), F.lit('"},{"@type":"Video","Width":"'), number(F.col("p_size")), F.lit('","Height":"'), number(F.col("p_size") * 2), F.lit('","FrameRate":"'), F.when(F.col("p_size") % 2 == 0, "25.000").otherwise("29.970"), F.lit('","Rotation":"-90"}]}}'))
    m = parameters.probe_media(doc)
    return rows.select("p_partkey", m["width"].alias("width"), m["height"].alias("height"), m["duration_ms"].alias("duration_ms"), m["frame_rate_num"].alias("num"), m["frame_rate_den"].alias("den"), m["rotation"].alias("rotation"))


@_query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand || ' (0.80)' ELSE p_brand END AS shown, CASE WHEN p_partkey % 2 = 0 THEN 'UniPC' ELSE 'Dpm ' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) END AS sampler, starts_with(p_type, 'P') AS inside FROM part")
def shown_names(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/part.parquet")
    weight = F.when(F.col("p_partkey") % 3 == 0, 0.8).when(F.col("p_partkey") % 3 == 1, 1.0)
    sampler = text.display_sampler(F.when(F.col("p_partkey") % 2 == 0, " UNIPC ").otherwise(F.concat(F.lit("dpm_"), "p_type")))
    inside = text.path_within(F.concat(F.lit("\\\\?\\C:\\Lib\\"), F.substring("p_type", 1, 1), F.lit("\\a.png")), F.lit("c:/lib/p/"))
    return rows.select("p_partkey", text.format_reference(F.col("p_brand"), weight).alias("shown"), sampler.alias("sampler"), inside.alias("inside"))
