"""Names every query of the library with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomery.operators import library as pages
from loomery.operators.search import Fields, compile_query
from loomery.plans import assets, graphs, jobs, library, search


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = compile_query("the -and", Fields(id="doc_id", prompt="text")).apply(docs, "doc_id")
    return pages.page(found, "n_chars", "doc_id", limit=50).select("doc_id", "source", "n_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**search.QUERIES, **library.QUERIES, **assets.QUERIES, **graphs.QUERIES, **jobs.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**search.SQL, **library.SQL, **assets.SQL, **graphs.SQL, **jobs.SQL}
