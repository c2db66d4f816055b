"""Queries for the search language, the filters, pages and joins, on driver tables in their roles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions import text
from loomery.operators import library
from loomery.operators.search import Fields, FilterState, Tables, apply_filter, compile_query, having_resources

DOCS = Fields(id="doc_id", prompt="text", tool="source")
ORDERS = Fields(id="o_orderkey", tool="o_orderpriority", cfg="o_totalprice", timestamp="o_orderdate", sampler="o_orderstatus")
EVENTS = Fields(id="event_id", json="props", tool="event_type", timestamp="ts", seed="user_id")


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _search(query: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return compile_query(query, DOCS).apply(_table(spark, d, "documents"), "doc_id").select("doc_id", "n_chars")

    return run


def search_numeric_range(spark: SparkSession, d: str) -> DataFrame:
    state = FilterState(query="cfg:>1000", cfg=(None, 50000.0))
    return apply_filter(_table(spark, d, "orders"), state, ORDERS).select("o_orderkey", "o_totalprice")


def search_date(query: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return compile_query(query, ORDERS).apply(_table(spark, d, "orders"), "o_orderkey").select("o_orderkey")

    return run


def search_json_key(spark: SparkSession, d: str) -> DataFrame:
    rows = compile_query("tool:click -seed:7", EVENTS).apply(_table(spark, d, "events"), "event_id")
    return rows.filter(text.json_integer(F.col("props"), "$.k") > 50).select("event_id", text.json_integer(F.col("props"), "$.k").alias("k"))


def search_date_preset(spark: SparkSession, d: str) -> DataFrame:
    state = FilterState(date_preset="week")
    return apply_filter(_table(spark, d, "events"), state, EVENTS, now=datetime(2024, 1, 20)).groupBy("event_type").agg(F.count("*").alias("n"))


def search_samplers_tools(spark: SparkSession, d: str) -> DataFrame:
    state = FilterState(samplers=("O", "F"), tools=("1-URGENT", "Unknown"))
    return apply_filter(_table(spark, d, "orders"), state, ORDERS).select("o_orderkey")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset_id"), F.lit("loras").alias("kind"), F.concat(F.lit("part"), F.pmod("l_partkey", F.lit(20)).cast("string"), F.when(F.pmod("l_linenumber", F.lit(2)) == 0, " (0.80)").otherwise("")).alias("name"))


def semi_join_any(spark: SparkSession, d: str) -> DataFrame:
    return having_resources(_table(spark, d, "orders"), "o_orderkey", _parts(spark, d), "loras", [("part3",), ("part5", "part6")]).select("o_orderkey")


def semi_join_all(spark: SparkSession, d: str) -> DataFrame:
    return having_resources(_table(spark, d, "orders"), "o_orderkey", _parts(spark, d), "loras", [("part3",), ("part5", "part6")], "all").select("o_orderkey")


def search_bridge(spark: SparkSession, d: str) -> DataFrame:
    return compile_query("lora:part7 -lora:part1", ORDERS).apply(_table(spark, d, "orders"), "o_orderkey", _parts(spark, d)).select("o_orderkey")


def anti_join_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Customers without the ones that bought at least once at a high price."""
    dear = _table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("asset_id"))
    state, rows = FilterState(), _table(spark, d, "customer")
    return apply_filter(rows, state, Fields(id="c_custkey"), Tables(excluded=dear)).select("c_custkey", "c_name")


def page_first(spark: SparkSession, d: str) -> DataFrame:
    return library.page(_table(spark, d, "events"), "ts", "event_id", limit=100).select("event_id", "ts")


def page_keyset(spark: SparkSession, d: str) -> DataFrame:
    return library.page(_table(spark, d, "orders"), "o_totalprice", "o_orderkey", cursor={"o_totalprice": 100000.0, "o_orderkey": 0}, limit=100).select("o_orderkey", "o_totalprice")


def page_keyset_pinned(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "orders").withColumn("pinned", F.col("o_orderstatus") == "P")
    return library.page(rows, "o_totalprice", "o_orderkey", pinned="pinned", cursor={"pinned": True, "o_totalprice": 5000.0, "o_orderkey": 10**12}, limit=200).select("o_orderkey", "pinned")


def scoped_count(spark: SparkSession, d: str) -> DataFrame:
    return compile_query("the -and", DOCS).apply(_table(spark, d, "documents"), "doc_id").agg(F.count("*").alias("n"))


def global_count(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").agg(F.count("*").alias("n"))


QUERIES = {
    "search_plain_and": _search("the and"),
    "search_or_group": _search("idiot OR clown"),
    "search_negative": _search("the -and"),
    "search_phrase": _search('"of the" -"in the"'),
    "search_numeric_range": search_numeric_range,
    "search_date_month": search_date("date:1995-03"),
    "search_date_range": search_date("date:1995-01..1995-02-10"),
    "search_before_year": search_date("before:1996"),
    "search_json_key": search_json_key,
    "search_date_preset": search_date_preset,
    "search_samplers_tools": search_samplers_tools,
    "search_bridge": search_bridge,
    "semi_join_any": semi_join_any,
    "semi_join_all": semi_join_all,
    "anti_join_exclusion": anti_join_exclusion,
    "page_first": page_first,
    "page_keyset": page_keyset,
    "page_keyset_pinned": page_keyset_pinned,
    "scoped_count": scoped_count,
    "global_count": global_count,
}

_HAS = "contains(lower(text), '{}')"
_PART = "SELECT l_orderkey, 'part' || CAST(l_partkey % 20 AS VARCHAR) AS name FROM lineitem"

SQL = {
    "search_plain_and": f"SELECT doc_id, n_chars FROM documents WHERE {_HAS.format('the')} AND {_HAS.format('and')}",
    "search_or_group": f"SELECT doc_id, n_chars FROM documents WHERE {_HAS.format('idiot')} OR {_HAS.format('clown')}",
    "search_negative": f"SELECT doc_id, n_chars FROM documents WHERE {_HAS.format('the')} AND NOT {_HAS.format('and')}",
    "search_phrase": f"SELECT doc_id, n_chars FROM documents WHERE {_HAS.format('of the')} AND NOT {_HAS.format('in the')}",
    "search_numeric_range": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 50000",
    "search_date_month": "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-04-01'",
    "search_date_range": "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-02-11'",
    "search_before_year": "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'",
    "search_json_key": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE contains(lower(event_type), 'click') AND NOT contains(CAST(user_id AS VARCHAR), '7') AND CAST(json_extract(props, '$.k') AS BIGINT) > 50",
    "search_date_preset": "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-13' GROUP BY event_type",
    "search_samplers_tools": "SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) IN ('o', 'f') AND (lower(o_orderpriority) = '1-urgent' OR o_orderpriority IS NULL OR lower(o_orderpriority) IN ('', 'unknown'))",
    "search_bridge": f"WITH b AS ({_PART}) SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM b WHERE l_orderkey = o_orderkey AND contains(name, 'part7')) AND NOT EXISTS (SELECT 1 FROM b WHERE l_orderkey = o_orderkey AND contains(name, 'part1'))",
    "semi_join_any": f"WITH b AS ({_PART}) SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM b WHERE l_orderkey = o_orderkey AND name IN ('part3', 'part5', 'part6'))",
    "semi_join_all": f"WITH b AS ({_PART}) SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM b WHERE l_orderkey = o_orderkey AND name = 'part3') AND EXISTS (SELECT 1 FROM b WHERE l_orderkey = o_orderkey AND name IN ('part5', 'part6'))",
    "anti_join_exclusion": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "page_first": "SELECT event_id, ts FROM events ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 100",
    "page_keyset": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 100000 OR (o_totalprice = 100000 AND o_orderkey < 0) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 100",
    "page_keyset_pinned": "WITH r AS (SELECT *, o_orderstatus = 'P' AS pinned FROM orders) SELECT o_orderkey, pinned FROM r WHERE NOT pinned OR o_totalprice < 5000 OR (o_totalprice = 5000 AND o_orderkey < 1000000000000) ORDER BY pinned DESC, o_totalprice DESC, o_orderkey DESC LIMIT 200",
    "scoped_count": f"SELECT count(*) AS n FROM documents WHERE {_HAS.format('the')} AND NOT {_HAS.format('and')}",
    "global_count": "SELECT count(*) AS n FROM documents",
}
