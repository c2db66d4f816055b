"""Provenance edges between assets: references by name, their resolution, both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ["init", "control", "ip_adapter", "mask", "other"]


def extract_references(rows: DataFrame, asset_id: str, json: str) -> tuple[DataFrame, DataFrame]:
    """((source_id, role, name) without repeats, (source_id) of rows whose JSON is invalid).

    JSON: an object with an array references of {role, name}; roles unknown here become other.
    """
    kind = "struct<references: array<struct<role: string, name: string>>>"
    parsed = rows.select(F.col(asset_id).alias("source_id"), F.col(json).alias("j"), F.try_parse_json(json).alias("v"))
    bad = parsed.filter("j is not null and v is null").select("source_id")
    found = parsed.filter("v is not null").select("source_id", F.explode(F.from_json("j", kind)["references"]).alias("r"))
    role = F.when(F.col("r.role").isin(ROLES), F.col("r.role")).otherwise("other")
    return found.filter("r.name is not null and trim(r.name) <> ''").select("source_id", role.alias("role"), F.trim("r.name").alias("name")).dropDuplicates(), bad


def resolve_unique(edges: DataFrame, assets: DataFrame) -> DataFrame:
    """edges with target_id where exactly one asset has the name, else null."""
    unique = assets.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("one")).select("name", F.when(F.col("n") == 1, F.col("one")).alias("target_id"))
    return edges.join(unique, "name", "left")


def replace_edges(edges: DataFrame, fresh: DataFrame) -> DataFrame:
    """All edges of the sources in fresh are replaced."""
    return edges.join(fresh.select("source_id").distinct(), "source_id", "left_anti").unionByName(fresh.select(*edges.columns))


def role_rank(role: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ROLES)), role), F.lit(0)), F.lit(len(ROLES))).cast("int")


def grouped(edges: DataFrame) -> DataFrame:
    """(source_id, name, target_id, roles in rank order)."""
    roles = F.transform(F.sort_array(F.collect_set(F.struct(role_rank(F.col("role")).alias("rank"), "role"))), lambda x: x.role)
    return edges.groupBy("source_id", "name", "target_id").agg(roles.alias("roles"))


def forward(edges: DataFrame, assets: DataFrame) -> DataFrame:
    """Every edge with its source, and its target where that is known."""
    sources = assets.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    targets = assets.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"))
    return edges.join(sources, "source_id").join(targets, "target_id", "left")


def backlinks(edges: DataFrame, assets: DataFrame) -> DataFrame:
    """(used_id, source_id, role): assets that an edge names by id or by name."""
    by_id = edges.filter("target_id is not null").select(F.col("target_id").alias("used_id"), "source_id", "role")
    by_name = edges.filter("target_id is null").join(assets.select("name", F.col("id").alias("used_id")), "name").select("used_id", "source_id", "role")
    return by_id.unionByName(by_name).distinct()
