"""Upserts, tombstones, merges and moves as joins that rewrite a table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery import storage
from loomery.functions import text
from loomery.operators.library import best_key

#: Rounds in which moves of ids are doubled: 2^16 moves in a row.
MAX_MOVES = 16

Policy = Callable[[Column, Column], Column]

# column policies of an upsert: (stored, incoming) -> kept
incoming: Policy = lambda old, new: new
stored: Policy = lambda old, new: old
fill: Policy = lambda old, new: F.coalesce(old, new)
prefer: Policy = lambda old, new: F.coalesce(new, old)


def upsert(table: DataFrame, rows: DataFrame, key: str, policies: dict[str, Policy] | None = None, order: list[str] | None = None) -> DataFrame:
    """table with rows merged in by key, and __change: new, changed, same or untouched.

    Columns without a policy take the incoming value. A row in which nothing would change is same.
    Of several rows of one key the last in order counts (by default of all their columns).
    """
    policies = policies or {}
    others = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*(order or others))).alias("__row")) if others else rows.distinct()
    last = last.select(key, *[F.col(f"__row.`{c}`").alias(c) for c in others])
    old, new = table.withColumn("__old", F.lit(True)).alias("o"), last.withColumn("__new", F.lit(True)).alias("n")
    both = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    inserted, kept = F.col("__old").isNull(), F.col("__new").isNull()
    values, changed = [F.coalesce(f"o.{key}", f"n.{key}").alias(key)], F.lit(False)
    for c in (c for c in table.columns if c != key):
        a = F.col(f"o.{c}")
        if c not in rows.columns:
            values.append(a.alias(c))
            continue
        merged = policies.get(c, incoming)(a, F.col(f"n.{c}"))
        values.append(F.when(inserted, F.col(f"n.{c}")).when(kept, a).otherwise(merged).alias(c))
        changed = changed | ~merged.eqNullSafe(a)
    change = F.when(inserted, "new").when(kept, "untouched").when(changed, "changed").otherwise("same")
    return both.select(*values, change.alias("__change"))


def rebuild_bridge(bridge: DataFrame, changed_ids: DataFrame, fresh: DataFrame) -> DataFrame:
    """Bridge rows of changed assets anew, all others as they were."""
    return bridge.join(changed_ids, "asset_id", "left_anti").unionByName(fresh.join(changed_ids, "asset_id", "left_semi").select(*bridge.columns))


def to_tombstones(assets: DataFrame, membership: DataFrame, ids: DataFrame, removed_at: Column) -> tuple[DataFrame, DataFrame]:
    """(assets left, tombstones with memberships as a JSON array)."""
    lists = membership.groupBy(F.col("asset_id").alias("id")).agg(F.to_json(F.array_sort(F.collect_list("collection_id"))).alias("memberships"))
    gone = assets.join(ids.select("id"), "id", "left_semi").join(lists, "id", "left")
    return assets.join(ids.select("id"), "id", "left_anti"), gone.withColumn("memberships", F.coalesce("memberships", F.lit("[]"))).withColumn("removed_at", removed_at)


def restore(tombstones: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assets, memberships, ids whose membership JSON is no list: restored without memberships)."""
    back = tombstones.join(ids.select("id"), "id", "left_semi")
    is_list = F.coalesce(F.schema_of_variant(F.try_parse_json("memberships")).startswith("ARRAY"), F.lit(False))
    lists = F.when(is_list, F.from_json("memberships", "array<string>"))
    bad = back.filter(F.col("memberships").isNotNull() & ~is_list).select("id")
    members = back.select(F.col("id").alias("asset_id"), F.explode(lists).alias("collection_id")).filter("collection_id is not null").select("collection_id", "asset_id")
    return back.drop("memberships", "removed_at"), members, bad


def three_way(original: Column, local: Column, remote: Column) -> Column:
    """The side that differs from the original; if both do, the local one."""
    return F.when(~local.eqNullSafe(original), local).when(~remote.eqNullSafe(original), remote).otherwise(original)


def remap(table: DataFrame, moves: DataFrame, column: str) -> DataFrame:
    """column with ids replaced by moves (old_id, new_id); rows that become equal are one."""
    new = moves.select(F.col("old_id").alias(column), "new_id")
    return table.join(new, column, "left").select(*[F.coalesce("new_id", column).alias(c) if c == column else F.col(c) for c in table.columns]).distinct()


def move_identity(tables: dict[str, tuple[DataFrame, list[str]]], moves: DataFrame) -> dict[str, DataFrame]:
    """Every table after the ids in its columns went through moves (old_id, new_id): assets, memberships, bridges, edges,
    facets alike. tables: {name: (table, its id columns)}.

    Moves that follow one another (a to b, b to c) are one move to their end. Of several moves of one id the smallest
    new_id counts, and a move along a cycle is none. Ids that meet become one row where the rest of the row is equal.
    """
    step = moves.where("old_id <> new_id").groupBy("old_id").agg(F.min("new_id").alias("new_id"))
    step, settled = storage.saved(step, "moves"), -1
    for _ in range(MAX_MOVES):
        on = step.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("further"))
        ahead = storage.saved(step.join(on, "new_id", "left").select("old_id", F.coalesce("further", "new_id").alias("new_id"), F.col("further").isNotNull().alias("moved")), "moves")
        step, before, settled = ahead.select("old_id", "new_id"), settled, ahead.where("not moved").count()
        if settled == before:  # what is left goes in circles
            break
    ends = step.join(step.select(F.col("old_id").alias("new_id")), "new_id", "left_anti").select("old_id", "new_id")
    return {name: reduce(lambda t, c: remap(t, ends, c), columns, table) for name, (table, columns) in tables.items()}


def new_files(listing: DataFrame, *known: DataFrame) -> DataFrame:
    """Files of a listing that none of the id tables (id) knows, newest first."""
    ids = known[0].select("id")
    for other in known[1:]:
        ids = ids.union(other.select("id"))
    return listing.join(ids.distinct(), listing.path == F.col("id"), "left_anti").orderBy(F.desc("modified"), "path")


def reimport(assets: DataFrame, listing: DataFrame) -> DataFrame:
    """Files that are new or whose time or size differ; user columns of known ones are kept for them."""
    files = listing.select(F.col("path").alias("id"), F.col("modified").alias("new_modified"), F.col("size").alias("new_size"))
    joined = files.join(assets.withColumn("__known", F.lit(True)), "id", "left")
    return joined.filter(F.col("__known").isNull() | ~F.col("modified").eqNullSafe(F.col("new_modified")) | ~F.col("size").eqNullSafe(F.col("new_size"))).drop("__known")


def mark_missing(assets: DataFrame, listing: DataFrame) -> DataFrame:
    """assets with missing: whether the listing lacks the file."""
    there = listing.select(F.col("path").alias("id")).distinct().withColumn("__there", F.lit(True))
    return assets.join(there, "id", "left").withColumn("missing", F.col("__there").isNull()).drop("__there")


def reset_on_change(assets: DataFrame, incoming_rows: DataFrame, columns: list[str]) -> DataFrame:
    """Video upsert: derived columns are cleared only where time or size differ (null-safe)."""
    new = incoming_rows.select("id", F.col("modified").alias("__m"), F.col("size").alias("__s"))
    joined = assets.join(new, "id", "left")
    differs = F.col("__s").isNotNull() & (~F.col("modified").eqNullSafe(F.col("__m")) | ~F.col("size").eqNullSafe(F.col("__s")))
    return joined.select(*[F.when(~differs, F.col(c)).alias(c) if c in columns else F.coalesce(F.when(differs, F.col({"modified": "__m", "size": "__s"}[c])), F.col(c)).alias(c) if c in ("modified", "size") else F.col(c) for c in assets.columns])


def thumbnail_queue(assets: DataFrame, failures: DataFrame, now: Column, limit: int, cursor: dict | None = None) -> DataFrame:
    """Assets whose thumbnail is missing, outdated or upgradeable and that did not fail within the last hour, newest first;
    those after a cursor (modified, id of the last one of the page before) if it is given."""
    held = failures.filter(F.col("failed_at") > now - F.expr("INTERVAL 1 HOUR")).select("id")
    need = F.col("thumb").isNull() | (F.col("thumb_at") < F.col("modified")) | F.coalesce(F.col("upgradeable"), F.lit(False))
    if cursor is not None:
        at = F.lit(cursor["modified"])
        older = F.col("modified").isNull() if cursor["modified"] is None else (F.col("modified") < at) | F.col("modified").isNull()
        need = need & ((older & ~F.col("modified").eqNullSafe(at)) | (F.col("modified").eqNullSafe(at) & (F.col("id") > F.lit(cursor["id"]))))
    return assets.filter(need).join(held, "id", "left_anti").orderBy(F.col("modified").desc_nulls_last(), "id").limit(limit)


def harvest(dictionary: DataFrame, names: DataFrame) -> DataFrame:
    """dictionary with the distinct names that it lacks added; known ones stay as they are."""
    fresh = names.select(*dictionary.columns).filter("name is not null").dropDuplicates(["name"]).join(dictionary.select("name"), "name", "left_anti")
    return dictionary.unionByName(fresh.select(*dictionary.columns))


def resolve_names(assets: DataFrame, dictionary: DataFrame) -> DataFrame:
    """resolved: the dictionary's name of the hash, else the raw model name."""
    names = dictionary.filter("hash is not null").groupBy(F.lower("hash").alias("h")).agg(F.min("name").alias("__name"))
    return assets.join(names, F.lower("model_hash") == F.col("h"), "left").withColumn("resolved", F.coalesce("__name", "model_name")).drop("h", "__name")


def revert(assets: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns go back to their parsed baseline where there is one: {column: baseline column}."""
    return assets.withColumns({c: F.coalesce(F.col(b), F.col(c)) for c, b in columns.items()})


def reindex_privacy(assets: DataFrame, keywords: list[str], fingerprint: str | None) -> tuple[DataFrame, str]:
    """privacy_hidden anew, unless the keywords' fingerprint says nothing changed; returns the fingerprint too."""
    mark = hashlib.sha256("\n".join(sorted({k.strip().lower() for k in keywords if k.strip()})).encode()).hexdigest()
    if mark == fingerprint:
        return assets, mark
    return assets.withColumn("privacy_hidden", text.privacy_hidden(F.col("masked"), F.col("prompt"), keywords)), mark


def merge_metadata(primary: DataFrame, secondary: DataFrame, key: str, lists: list[str], prefer_secondary: list[str] | None = None) -> DataFrame:
    """Fill what is missing from secondary, or prefer it for some columns; lists are joined without repeats, in order."""
    prefer_secondary = prefer_secondary or []
    both = primary.alias("p").join(secondary.alias("s"), key, "left")
    out = [F.col(key)]
    for c in (c for c in primary.columns if c != key):
        if c not in secondary.columns:
            out.append(F.col(f"p.{c}"))
        elif c in lists:
            empty = F.array().cast(primary.schema[c].dataType)
            out.append(F.array_union(F.coalesce(f"p.{c}", empty), F.coalesce(f"s.{c}", empty)).alias(c))
        else:
            out.append((F.coalesce(f"s.{c}", f"p.{c}") if c in prefer_secondary else F.coalesce(f"p.{c}", f"s.{c}")).alias(c))
    return both.select(*out)


def dedupe_inventory(files: DataFrame) -> DataFrame:
    """One row for each path and type: the hash of the best source that has one (verified, then scanned, then
    newest, then the smallest hash), the other columns of the best source, and how many copies there were."""
    others = [c for c in files.columns if c not in ("path", "type", "hash")]
    rows = files.withColumn("__none", F.col("hash").isNull())
    place = best_key(rows, [("verified", True), ("scanned", True), ("modified", True), ("__none", False), ("hash", False)])
    found = rows.groupBy("path", "type").agg(F.min_by(F.struct(*others), place).alias("__row"), F.min_by("hash", F.when(F.col("hash").isNotNull(), place)).alias("hash"), F.count("*").alias("copies"))
    return found.select("path", "type", *[F.col(f"__row.`{c}`").alias(c) for c in others], "hash", "copies")


def reparse(assets: DataFrame, parse: Callable[[DataFrame], DataFrame], version: int, *, force: bool = False, folder: str | None = None, tool: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(assets, diff) after the outdated ones were parsed again by parse: (id, original) -> (id, parsed columns).

    Parsed are images that are not deleted, have an original text and an older parser_version (all, if
    forced), below a folder or of a tool if given. diff: (id, field, before, after) of the values that changed.
    """
    due = ~F.coalesce(F.col("is_deleted"), F.lit(False)) & (F.coalesce("media_type", F.lit("image")) != "video") & (F.coalesce("original", F.lit("")) != "")
    if not force:
        due = due & (F.coalesce("parser_version", F.lit(-1)) < version)
    if folder is not None:
        due = due & text.path_within(F.col("path"), F.lit(folder))
    if tool is not None:
        due = due & (F.lower("tool") == tool.lower())
    parsed = parse(assets.filter(due).select("id", "original"))
    fields = [c for c in parsed.columns if c != "id" and c in assets.columns]
    new = parsed.select("id", *[F.col(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__done"))
    both = assets.join(new, "id", "left")
    done = F.coalesce("__done", F.lit(False))
    out = both.select(*[F.when(done, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.when(done, F.lit(version)).otherwise(F.col(c)).alias(c) if c == "parser_version" else F.col(c) for c in assets.columns])
    changed = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("before"), F.col(f"__{c}").cast("string").alias("after")) for c in fields])
    diff = both.filter("__done").select("id", F.explode(changed).alias("d")).select("id", "d.*").filter(~F.col("before").eqNullSafe(F.col("after")))
    return out, diff


def backfill_parameters(assets: DataFrame, json: str = "metadata_json") -> DataFrame:
    """Parameter columns taken from the JSON anew wherever there is one; other rows keep theirs."""
    get = lambda path: F.get_json_object(F.col(json), path)
    values = {
        "steps": get("$.steps").try_cast("int"),
        "seed": text.json_integer(F.col(json), "$.seed"),
        "cfg": get("$.cfg").try_cast("double"),
        "sampler": text.normalize_sampler(get("$.sampler")),
        "generation_type": get("$.generationType"),
        "positive": F.coalesce(F.nullif(get("$.positivePrompt"), F.lit("")), F.nullif(get("$.positive_prompt"), F.lit(""))),
        "negative": F.coalesce(F.nullif(get("$.negativePrompt"), F.lit("")), F.nullif(get("$.negative_prompt"), F.lit(""))),
    }
    return assets.withColumns({c: F.when(F.col(json).isNotNull(), v).otherwise(F.col(c) if c in assets.columns else F.lit(None)) for c, v in values.items()})


def refresh_owner_scope(assets: DataFrame, folder: str, mode: str, owner: str | None = None) -> DataFrame:
    """scope_hidden anew for assets below folder: none are hidden in mode legacy or all, all in unselected, and in
    owner those of others. Assets elsewhere stay as they are. The flag is equal after a second run."""
    if mode == "owner" and not (owner or "").strip():
        raise ValueError("owner scope needs an owner")
    hidden = {"legacy": F.lit(False), "all": F.lit(False), "unselected": F.lit(True), "owner": ~F.col("owner_id").eqNullSafe(F.lit((owner or "").strip()))}[mode]
    inside = F.lower(F.regexp_replace("path", r"\\", "/")).startswith(f"{folder.rstrip('/').lower()}/")
    return assets.withColumn("scope_hidden", F.when(inside, hidden).otherwise(F.col("scope_hidden")))


def scoped_collections(collections: DataFrame, mode: str | None, owner: str | None = None) -> DataFrame:
    """Own collections, and those of the external source as far as the owner scope shows them; without a scope none of them."""
    foreign = F.coalesce("source", F.lit("own")) == "external"
    shown = {"legacy": F.lit(True), "all": F.lit(True), "owner": F.coalesce(F.col("owner_id") == F.lit(owner), F.lit(False))}.get(mode, F.lit(False))
    return collections.filter(~foreign | shown)


def hide_owner_thumbnails(facets: DataFrame, assets: DataFrame) -> DataFrame:
    """Facets whose thumbnail is a hidden asset, by id, path or thumbnail, show their safe one; without one they are sensitive."""
    hidden = assets.filter("scope_hidden")
    marks = hidden.select(F.explode(F.array("id", "path", "thumb")).alias("mark")).filter("mark is not null and mark <> ''").distinct()
    flagged = facets.join(marks.select(F.col("mark").alias("best_thumb"), F.lit(True).alias("__a")), "best_thumb", "left")
    by_id = hidden.select(F.col("id").alias("thumb_asset"), F.lit(True).alias("__b")).distinct()
    flagged = flagged.join(by_id, "thumb_asset", "left").withColumn("__hit", F.coalesce("__a", "__b", F.lit(False)))
    safe = F.coalesce("safe_thumb", F.lit("")) != ""
    changed = {"best_thumb": F.when(F.col("__hit"), F.col("safe_thumb")).otherwise(F.col("best_thumb")), "thumb_asset": F.when(~F.col("__hit"), F.col("thumb_asset")), "thumb_sensitive": F.when(F.col("__hit"), ~safe).otherwise(F.col("thumb_sensitive"))}
    return flagged.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in facets.columns])


def find_identity(wanted: DataFrame, assets: DataFrame) -> DataFrame:
    """wanted (mark) with the asset that has it as id, else as path, else as thumbnail; the smallest id of several."""
    kinds = F.array(*[F.struct(F.lit(i).alias("rank"), F.col(c).alias("mark")) for i, c in enumerate(("id", "path", "thumb"))])
    marks = assets.select(F.col("id").alias("asset_id"), F.explode(kinds).alias("k")).select("asset_id", "k.*").filter("mark is not null and mark <> ''")
    best = marks.join(wanted.select("mark").distinct(), "mark", "left_semi").groupBy("mark").agg(F.min_by("asset_id", F.struct("rank", "asset_id")).alias("asset_id"))
    return wanted.join(best, "mark", "left")


def hashes_to_resolve(assets: DataFrame, models: DataFrame, now: Column) -> DataFrame:
    """Distinct hashes to look up: used ones that no model has, and models without a remote version that are on disk,
    named or in use, unless a lookup failed within the last day."""
    used = assets.filter(~F.coalesce("scope_hidden", F.lit(False))).select(F.explode(F.array(F.col("model_hash"), F.get_json_object("metadata_json", "$.modelHash"))).alias("hash")).filter("hash is not null").distinct()
    missing = used.join(models.select("hash"), "hash", "left_anti")
    source = F.coalesce("lookup_source", F.lit(""))
    rows = models.filter("remote_version is null").join(used.withColumn("__used", F.lit(True)), "hash", "left").withColumn("__used", F.coalesce("__used", F.lit(False)))
    local = (F.coalesce("filename", F.lit("")) != "") | (source == "disk_scan") | source.startswith("local_cache") | F.col("__used")
    again = (source != "lookup_failed") | F.col("scanned_at").isNull() | (F.col("scanned_at") < now - F.expr("INTERVAL 1 DAY"))
    rows = rows.filter(local & (~source.startswith("harvest_") | F.col("__used")) & again).select("hash")
    return missing.unionByName(rows).select(F.trim("hash").alias("hash")).filter("hash <> ''").distinct()


def unresolved_counts(assets: DataFrame, models: DataFrame) -> DataFrame:
    """One row: distinct unresolved hashes that some asset has a model name for, and those without any."""
    known = models.groupBy("hash").agg(F.max(F.coalesce(F.col("lookup_source") != "lookup_failed", F.lit(True))).alias("__ok"))
    rows = assets.filter(~F.coalesce("scope_hidden", F.lit(False)) & (F.coalesce("model_hash", F.lit("")) != "")).join(known, F.col("model_hash") == F.col("hash"), "left").filter("__ok is null or not __ok")
    per = rows.groupBy("model_hash").agg(F.bool_or(F.trim(F.coalesce("model_name", F.lit(""))) != "").alias("named"))
    return per.agg(F.count_if("named").alias("named"), F.count_if(~F.col("named")).alias("unknown"))


def mark_corrupt(assets: DataFrame, checks: DataFrame) -> DataFrame:
    """assets with corrupt: whether the last check (id, checked_at, error) of the file ended in an error."""
    last = checks.groupBy("id").agg(F.max_by(F.col("error").isNotNull(), "checked_at").alias("__bad"))
    return assets.join(last, "id", "left").withColumn("corrupt", F.coalesce("__bad", F.lit(False))).drop("__bad")


def thumbnail_results(failures: DataFrame, results: DataFrame) -> DataFrame:
    """failures (id, failure_count, last_error, failed_at) after results (id, error, at): a success clears the
    row, a failure counts up."""
    last = results.groupBy("id").agg(F.max_by(F.struct("error", "at"), "at").alias("r"), F.count_if(F.col("error").isNotNull()).alias("n"))
    both = failures.join(last, "id", "full")
    failed = F.col("r").isNull() | F.col("r.error").isNotNull()
    return both.filter(failed).select("id", (F.coalesce("failure_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("failure_count"), F.coalesce("r.error", "last_error").alias("last_error"), F.coalesce("r.at", "failed_at").alias("failed_at"))


def failure_list(failures: DataFrame, assets: DataFrame, limit: int) -> DataFrame:
    """Newest failures of visible, present images; ties by id."""
    there = assets.filter("not coalesce(scope_hidden, false) and not coalesce(is_deleted, false) and not coalesce(missing, false) and media_type = 'image'")
    return failures.filter("failure_count > 0").join(there.select("id", "path"), "id").orderBy(F.col("failed_at").desc_nulls_last(), "id").limit(limit)


def known_ids(*tables: DataFrame) -> DataFrame:
    """Distinct ids of active and removed assets alike."""
    return reduce(DataFrame.unionByName, [t.select("id") for t in tables]).distinct()
