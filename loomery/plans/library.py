"""Queries for statistics, facets, collections, duplicates, provenance, names and lifecycle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery import storage
from loomery.functions import text
from loomery.operators import collections, duplicates, facets, keywords, library, lifecycle, parameters, provenance
from loomery.operators.search import Fields, FilterState, apply_filter
from loomery.streaming import changes, renames

NOW = datetime(2024, 2, 15)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def media_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "lineitem")
    return library.media_stats(rows, {"returned": F.col("l_returnflag") == "R", "open": F.col("l_linestatus") == "O"}, "l_linenumber")


def avg_positive(spark: SparkSession, d: str) -> DataFrame:
    return library.mean_positive(_table(spark, d, "lineitem"), "l_quantity")


def histogram_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return library.histogram(_table(spark, d, "part"), F.nullif(F.col("p_brand"), F.lit("Brand#11")))


def keyword_top40(spark: SparkSession, d: str) -> DataFrame:
    return library.keyword_counts(_table(spark, d, "documents"), "text")


def param_ranges(spark: SparkSession, d: str) -> DataFrame:
    return library.ranges(_table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_linenumber"])


def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return library.distinct_values(_table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


def filtered_counters(spark: SparkSession, d: str) -> DataFrame:
    return library.counters(_table(spark, d, "orders"), {"open": F.col("o_orderstatus") == "O", "urgent": F.col("o_orderpriority") == "1-URGENT", "large": F.col("o_totalprice") > 200000})


def smart_counts_one_pass(spark: SparkSession, d: str) -> DataFrame:
    return library.counts_long(_table(spark, d, "events"), {"views": F.col("event_type") == "view", "high": F.col("value") > 50, "early": F.col("ts") < F.lit(datetime(2024, 1, 10))})


def timeline_buckets(spark: SparkSession, d: str) -> DataFrame:
    return library.timeline(_table(spark, d, "events"), "ts", NOW).select("bucket", "count")


def facet_counts_union(spark: SparkSession, d: str) -> DataFrame:
    return facets.scoped_counts(_table(spark, d, "orders"), {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")})


def facet_bridge_counts(spark: SparkSession, d: str) -> DataFrame:
    bridge = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset_id"), F.lit("parts").alias("kind"), F.concat(F.lit("P"), F.pmod("l_partkey", F.lit(50)).cast("string"), F.lit(":0.8")).alias("name"))
    scope = _table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return facets.bridge_counts(scope, bridge, "o_orderkey")


def facet_disjunctive(spark: SparkSession, d: str) -> DataFrame:
    """Each facet counted under all filters but its own."""
    rows, fields = _table(spark, d, "orders"), Fields(id="o_orderkey", tool="o_orderpriority", sampler="o_orderstatus")
    state = FilterState(tools=("1-URGENT",), samplers=("F",))
    tools = apply_filter(rows, state, fields, exclude=["tools"]).groupBy(F.lit("tool").alias("facet"), F.col("o_orderpriority").alias("name"))
    samplers = apply_filter(rows, state, fields, exclude=["samplers"]).groupBy(F.lit("sampler").alias("facet"), F.col("o_orderstatus").alias("name"))
    return tools.agg(F.count("*").alias("count")).unionByName(samplers.agg(F.count("*").alias("count")))


def _uses(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    parts = _table(spark, d, "part")
    rows = _table(spark, d, "lineitem").join(parts.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    use_id = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    uses = rows.select(F.lit("brand").alias("facet"), F.concat("p_brand", F.when(F.col("l_linenumber") == 1, " (0.80)").otherwise("")).alias("name"), use_id.alias("asset_id"), F.col("l_shipdate").alias("used_at"), use_id.cast("string").alias("thumb"), (F.col("l_returnflag") == "R").alias("pinned"), (F.col("l_linestatus") == "O").alias("safe"))
    known = parts.select(F.lit("brand").alias("facet"), F.concat("p_brand", F.lit(".safetensors")).alias("name"), (F.col("p_size") > 10).alias("local")).union(parts.limit(0).select(F.lit("brand"), F.lit(""), F.lit(False)))
    return uses, known


def facet_build_ranked(spark: SparkSession, d: str) -> DataFrame:
    return facets.build(*_uses(spark, d)).select("facet", "key", "count", "best_thumb", "safe_thumb", "local")


def facet_refresh(spark: SparkSession, d: str) -> DataFrame:
    """A table built without the newest uses, refreshed for the touched names; equal to the full build."""
    uses, known = _uses(spark, d)
    newest = F.col("used_at") >= F.lit(datetime(1998, 1, 1))
    stale = facets.build(uses.filter(~newest), known)
    return facets.refresh(stale, uses, known, uses.filter(newest).select("facet", "name")).select("facet", "key", "count", "best_thumb", "safe_thumb", "local")


def facet_alias_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "part").withColumn("name", F.concat(F.when(F.col("p_size") % 2 == 0, F.upper("p_brand")).otherwise(F.regexp_replace("p_brand", "#", "_#")), F.lit(".pth")))
    counts = rows.groupBy(F.lit("brand").alias("facet"), "name").agg(F.count("*").alias("count"), F.min("p_size").alias("first_used"), F.max("p_size").alias("last_used"))
    return facets.merge_aliases(counts).select("match_key", "count", "first_used", "last_used")


def or_join_split(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "customer").select(F.col("c_custkey").alias("ck"), F.col("c_nationkey").alias("cn"))
    s = _table(spark, d, "supplier").select(F.col("s_suppkey").alias("sk"), F.col("s_nationkey").alias("sn"))
    return facets.match_either(c, s, (F.col("ck"), F.col("sk")), (F.col("cn"), F.col("sn")), ["ck", "sk"])


def collection_thumbs(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "orders").select(F.col("o_custkey").alias("collection"), F.col("o_orderkey").alias("thumb"), (F.col("o_orderstatus") == "F").alias("private"), "o_totalprice", (F.col("o_orderpriority") == "1-URGENT").alias("pinned"))
    return collections.with_thumbnails(rows, "collection", [("pinned", True), ("o_totalprice", True), ("thumb", False)], "thumb", "private")


def membership_move(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "orders").select(F.col("o_orderstatus").alias("collection_id"), F.col("o_custkey").alias("asset_id")).distinct()
    some = _table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("asset_id"))
    return collections.move(rows, some, "O", "P")


def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    files = _table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"), "text")
    hashed = duplicates.size_collisions(files).select("id", F.sha2("text", 256).alias("digest"))
    return duplicates.id_lists(hashed, "digest").select("digest", "copies", (F.col("copies") - 1).alias("redundant"), "part", "ids")


def duplicate_resolution(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    assets = docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"), (F.col("doc_id") % 3 == 0).alias("favorite"), (F.col("doc_id") % 5 == 0).alias("pinned"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 4 == 0).alias("masked"))
    keep = assets.groupBy("digest").agg(F.min("id").alias("keep_id"))
    pairs = assets.join(keep, "digest").select("keep_id", F.col("id").alias("drop_id"))
    members = docs.select(F.col("source").alias("collection_id"), F.col("doc_id").alias("asset_id"))
    return duplicates.resolve(assets, members, pairs)[0].select("id", "favorite", "pinned", "masked")


def first_value_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("path"), F.lit("t").alias("type"), (F.col("s_acctbal") > 0).alias("verified"), (F.col("s_suppkey") % 2 == 0).alias("scanned"), F.col("s_suppkey").alias("modified"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")).alias("hash"))
    return lifecycle.dedupe_inventory(rows).select("path", "hash", "copies")


def _turns(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _table(spark, d, "conversations")
    assets = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("name"))
    edges = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("source_id"), F.col("role"), F.concat_ws("/", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")).alias("name"))
    return assets, edges


def graph_forward(spark: SparkSession, d: str) -> DataFrame:
    assets, edges = _turns(spark, d)
    return provenance.forward(provenance.resolve_unique(edges, assets), assets).select("source_id", "target_id", "source_name", "target_name")


def graph_backlinks(spark: SparkSession, d: str) -> DataFrame:
    assets, edges = _turns(spark, d)
    return provenance.backlinks(provenance.resolve_unique(edges, assets), assets)


def unique_resolution(spark: SparkSession, d: str) -> DataFrame:
    assets = _table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.lit("/"), F.pmod("c_custkey", F.lit(200)).cast("string")).alias("name"))
    return provenance.resolve_unique(assets.select("name").distinct(), assets)


def keyword_flag(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "documents")
    return rows.select("doc_id", text.privacy_hidden(F.when(F.col("doc_id") % 7 == 0, False), F.col("text"), ["Idiot", "clown", " trash "]).alias("hidden"))


def keyword_index(spark: SparkSession, d: str) -> DataFrame:
    """Fragments of all part names, most with a number, looked for in all documents."""
    fragment = F.expr("substring(p_name, CAST(1 + p_partkey % 7 AS INT), size) || CASE WHEN p_partkey % 5 > 0 THEN CAST(p_partkey % 1000 AS STRING) ELSE '' END")
    words = _table(spark, d, "part").withColumn("size", F.explode(F.array(*map(F.lit, [1, 2, 3, 5])))).select(fragment.alias("keyword"))
    found = keywords.containing(_table(spark, d, "documents").select("doc_id", "text"), "text", words)
    return found.select("doc_id", F.size("keywords").cast("long").alias("n"), F.try_element_at("keywords", F.lit(1)).alias("first"))


def upsert_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Two commits to a keyed table: new and changed prices, then the same rows again, which changes nothing."""
    rows = _table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    held = storage.KeyedTable.create(rows.filter("o_orderkey % 4 <> 0"), storage.scratch(spark, "orders"), "o_orderkey", 16)
    news = rows.filter("o_orderkey % 4 = 0 or o_orderkey % 7 = 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    merge = lambda old, new: lifecycle.upsert(old, new, "o_orderkey", {"o_orderstatus": lifecycle.stored})
    held.merge(news, merge)
    held.merge(news, merge)
    return held.read().withColumn("version", F.lit(held.version()))


def name_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "part").withColumn("raw", F.concat(F.lit("C:\\models/"), "p_name", F.when(F.col("p_size") % 2 == 0, ".pth").otherwise(".safetensors")))
    return rows.select("p_partkey", text.clean_name(F.col("raw")).alias("name"), text.match_key(F.col("raw")).alias("match_key"))


def path_class(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/out/"), F.element_at(F.array(*map(F.lit, ["txt2img-images", "IMG2IMG", "extras-images", "x-grids", "misc"])), (F.col("page_id") % 5 + 1).cast("int")), F.lit("/a.png"))
    return _table(spark, d, "pages").select("page_id", text.generation_type(path).alias("kind"))


def url_clean(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", F.lower(text.basename(F.col("url"))).alias("base"))


def similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Names within a brand that are alike at 0.9 or more."""
    rows = _table(spark, d, "part").select("p_brand", "p_partkey", F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 97).cast("string")).alias("n")).filter("n IS NOT NULL")
    return duplicates.similar_names(rows, "p_partkey", "n", "p_brand", 0.9, 6).select("a", "b", "similarity")


def json_explode(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    old, new = rows.filter("o_orderkey % 4 <> 0"), rows.filter("o_orderkey % 4 <> 1").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return lifecycle.upsert(old, new, "o_orderkey", {"o_totalprice": lifecycle.stored, "o_orderpriority": lifecycle.fill}).withColumnRenamed("__change", "change")


def three_way_merge(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    local, remote = F.when(k % 2 == 0, "L").otherwise(F.col("o_orderstatus")), F.when(k % 3 == 0, "R").otherwise(F.col("o_orderstatus"))
    return _table(spark, d, "orders").select("o_orderkey", lifecycle.three_way(F.col("o_orderstatus"), local, remote).alias("status"))


def tombstone_restore(spark: SparkSession, d: str) -> DataFrame:
    """Assets and memberships after some were removed and half of those restored."""
    assets = _table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    members = _table(spark, d, "orders").select(F.col("o_orderstatus").alias("collection_id"), F.col("o_custkey").alias("asset_id")).distinct()
    kept, gone = lifecycle.to_tombstones(assets, members, assets.filter("id % 2 = 0"), F.lit(NOW))
    back, links, _ = lifecycle.restore(gone, gone.filter("id % 4 = 0"))
    return kept.unionByName(back).join(links.groupBy(F.col("asset_id").alias("id")).agg(F.count("*").alias("restored_links")), "id", "left")


def import_new_files(spark: SparkSession, d: str) -> DataFrame:
    listing = _table(spark, d, "pages").select(F.col("url").alias("path"), F.length("html").alias("size"), F.col("page_id").alias("modified"))
    known = listing.filter("modified % 3 = 0").select(F.col("path").alias("id"))
    return lifecycle.new_files(listing, known, listing.filter("modified % 5 = 0").select(F.col("path").alias("id"))).select("path", "modified")


def parse_params(spark: SparkSession, d: str) -> DataFrame:
    """Text blocks of three shapes, parsed back: whole, without a negative prompt, and a prompt alone."""
    rows = _table(spark, d, "part")
    values = F.concat(F.lit("Steps: "), F.col("p_size").cast("string"), F.lit(", Sampler: Euler a, CFG scale: 7.5, Seed: "), F.col("p_partkey").cast("string"), F.lit(", Size: 512x768, Model: \"x, y\", Clip skip: 2"))
    kind, prompt = F.col("p_partkey") % 3, F.concat(F.col("p_name"), F.lit(", <lora:fine:0.8>"))
    block = F.when(kind == 0, F.concat(prompt, F.lit("\nNegative prompt: blurry, bad "), "p_brand", F.lit("\n"), values)).when(kind == 1, F.concat(prompt, F.lit("\n"), values)).otherwise(prompt)
    return parameters.parse_blocks(rows.select("p_partkey", block.alias("block")), "block", ["p_partkey"]).select("p_partkey", "positive", "negative", "steps", "sampler", "cfg", "seed", "width", "height", "model", "clip_skip")


def prompt_tokens(spark: SparkSession, d: str) -> DataFrame:
    prompt = F.concat(F.lit("<lora:"), F.col("p_brand"), F.lit(":0.7> "), F.when(F.col("p_size") % 2 == 0, "embedding:style <detail-b> <LORA:second:1>").otherwise(F.concat(F.lit("plain "), "p_name")), F.when(F.col("p_size") % 3 == 0, " <hypernet:h:1>").otherwise(""))
    t = parameters.prompt_tokens(prompt)
    return _table(spark, d, "part").select("p_partkey", F.array_join(t["loras"], "|").alias("loras"), F.array_join(t["hypernets"], "|").alias("hypernets"), F.array_join(t["embeddings"], "|").alias("embeddings"))


def catalog_json(spark: SparkSession, d: str) -> DataFrame:
    """Documents of four generations: flat with a model object, prompt parts below an envelope's image, an
    envelope as text, and an envelope with generation and a model name."""
    name, brand, size = F.col("p_name"), F.col("p_brand"), F.col("p_size")
    flat = F.to_json(F.struct(name.alias("positive_prompt"), F.struct(brand.alias("name"), F.lit("sha:abc").alias("hash")).alias("model"), size.alias("steps"), F.lit(7.5).alias("guidance"), F.lit("euler").alias("scheduler"), F.struct(F.lit("v").alias("name")).alias("vae"), size.alias("clip_skip")))
    parts = F.array(F.struct(name.alias("prompt"), F.lit(1.0).alias("weight")), F.struct(F.lit("tail").alias("prompt"), F.lit(0.5).alias("weight")))
    image = F.struct(F.struct(parts.alias("prompt"), size.alias("steps"), F.lit(5).alias("cfg_scale"), F.lit("lms").alias("sampler"), F.lit("txt2img").alias("type")).alias("image"))
    below = F.concat(F.lit('{"model_weights":"'), brand, F.lit('","sd-metadata":'), F.to_json(image), F.lit("}"))
    text_ = F.to_json(F.struct(F.to_json(F.struct(name.alias("positivePrompt"), F.lit("bad").alias("negativePrompt"), F.struct(brand.alias("model_name")).alias("model"), F.lit(True).alias("hrf_enabled"), F.lit("esrgan").alias("hrf_method"))).alias("invokeai_metadata")))
    made = F.to_json(F.struct(F.struct(F.struct(brand.alias("model"), F.lit("ddim").alias("sampler_name"), F.lit(0).alias("clip_skip"), F.lit(True).alias("is_intermediate")).alias("generation")).alias("dream_metadata")))
    kind = F.col("p_partkey") % 4
    m = parameters.catalog_metadata(F.when(kind == 0, flat).when(kind == 1, below).when(kind == 2, text_).otherwise(made))
    return _table(spark, d, "part").select("p_partkey", m.alias("m")).select("p_partkey", "m.model", "m.model_hash", "m.positive", "m.negative", "m.steps", "m.cfg", "m.sampler", "m.type", "m.vae", "m.clip_skip", "m.upscaler", "m.intermediate")


def _change_log(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "modify", "click", "create", "purchase", "rename_from", "signup", "rename_to", "error", "remove")]), F.col("event_type"))
    path = F.concat(F.lit("/lib/"), F.pmod("user_id", F.lit(10)).cast("string"), F.lit("/"), F.col("user_id").cast("string"), F.lit(".png"))
    return _table(spark, d, "events").select(F.col("event_id").alias("seq"), kind.alias("kind"), path.alias("path"), F.col("ts").alias("at"))


def stream_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """Changes made of events, through a file stream in one micro-batch."""
    root = storage.scratch(spark, "changes")
    _change_log(spark, d).drop("at").write.json(f"{root}/log")
    changes.watch(spark, f"{root}/log", f"{root}/state", lambda batch, n: batch.write.mode("append").parquet(f"{root}/out"), once=True).awaitTermination()
    return spark.read.schema(renames.RESOLVED).parquet(f"{root}/out").groupBy("kind").agg(F.count("*").alias("n"))


def stream_renames(spark: SparkSession, d: str) -> DataFrame:
    """The same changes in several micro-batches, in the order of their time; halves of a rename wait in the state. The
    last file holds a change long after, for which all that still waits expires."""
    root, log = storage.scratch(spark, "renames"), _change_log(spark, d)
    cuts = log.agg(F.percentile_approx("seq", [i / 6 for i in range(1, 6)]).alias("q")).first().q or []
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):  # one file after the other, as a watcher writes them
        part = log.where((F.lit(lo).isNull() | (F.col("seq") > F.lit(lo))) & (F.lit(hi).isNull() | (F.col("seq") <= F.lit(hi))))
        part.coalesce(1).write.mode("append").json(f"{root}/log")
    late = log.agg(F.max("seq").alias("seq"), (F.max("at") + F.expr("INTERVAL 1000 DAYS")).alias("at"))
    late.select((F.col("seq") + 1).alias("seq"), F.lit("tick").alias("kind"), F.lit("/tick.png").alias("path"), "at").coalesce(1).write.mode("append").json(f"{root}/log")
    side = renames.stateful_session(spark)
    keep = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{root}/out")
    renames.watch(side, f"{root}/log", f"{root}/state", keep, wait_ms=100 * 24 * 3600 * 1000, by_event=True, files_a_batch=1, once=True).awaitTermination()
    found = spark.read.schema(f"{renames.RESOLVED}, batch long").parquet(f"{root}/out").where("kind <> 'tick'")
    return found.select("kind", "path", "old_path").distinct()


QUERIES = {
    f.__name__: f
    for f in (
        media_stats, avg_positive, histogram_coalesce, keyword_top40, param_ranges, distinct_values, filtered_counters, smart_counts_one_pass, timeline_buckets,
        facet_counts_union, facet_bridge_counts, facet_disjunctive, facet_build_ranked, facet_refresh, facet_alias_merge, or_join_split,
        collection_thumbs, membership_move, duplicate_groups, duplicate_resolution, first_value_dedupe,
        graph_forward, graph_backlinks, unique_resolution, keyword_flag, keyword_index, upsert_partitions, name_clean, path_class, url_clean, similarity_pairs, json_explode,
        upsert_merge, three_way_merge, tombstone_restore, import_new_files, parse_params, prompt_tokens, catalog_json, stream_coalesce, stream_renames,
    )
}

_FACET = """
WITH u AS (SELECT p_brand AS name, l_orderkey * 10 + l_linenumber AS id, l_shipdate AS used_at, l_returnflag = 'R' AS pinned, l_linestatus = 'O' AS safe FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT lower(name) AS key, count(DISTINCT id) AS n FROM u GROUP BY 1),
b AS (SELECT lower(name) AS key, id, row_number() OVER (PARTITION BY lower(name) ORDER BY pinned DESC, used_at DESC, id) AS r FROM u),
s AS (SELECT lower(name) AS key, id, row_number() OVER (PARTITION BY lower(name) ORDER BY pinned DESC, used_at DESC, id) AS r FROM u WHERE safe),
k AS (SELECT lower(p_brand) AS key, bool_or(p_size > 10) AS local FROM part GROUP BY 1)
SELECT 'brand' AS facet, k.key, coalesce(c.n, 0) AS count, CAST(b.id AS VARCHAR) AS best_thumb, CAST(s.id AS VARCHAR) AS safe_thumb, k.local
FROM k LEFT JOIN c USING (key) LEFT JOIN b ON b.key = k.key AND b.r = 1 LEFT JOIN s ON s.key = k.key AND s.r = 1
"""
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_TURN = "WITH a AS (SELECT conv_id * 1000 + turn AS id, conv_id || '/' || turn AS name FROM conversations), u AS (SELECT name, CASE WHEN count(*) = 1 THEN min(id) END AS one FROM a GROUP BY name), e AS (SELECT conv_id * 1000 + turn AS source_id, role, conv_id || '/' || (turn - 1) AS name FROM conversations), r AS (SELECT e.*, u.one AS target_id FROM e LEFT JOIN u USING (name))"

_RENAMES = """
WITH l AS (SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'modify' WHEN 'click' THEN 'create' WHEN 'purchase' THEN 'rename_from' WHEN 'signup' THEN 'rename_to' ELSE 'remove' END AS kind,
  '/lib/' || CAST(user_id % 10 AS VARCHAR) || '/' || CAST(user_id AS VARCHAR) || '.png' AS path, user_id % 10 AS folder FROM events),
s AS (SELECT *, sum(CASE WHEN kind = 'rename_from' THEN 1 ELSE -1 END) OVER (PARTITION BY folder ORDER BY seq) AS w FROM l WHERE kind IN ('rename_from', 'rename_to')),
t AS (SELECT *, kind = 'rename_to' AND w < least(0, coalesce(min(w) OVER (PARTITION BY folder ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS alone FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY folder, kind ORDER BY seq) AS n FROM t WHERE NOT alone),
p AS (SELECT CASE WHEN b.path IS NULL THEN 'remove' ELSE 'rename' END AS kind, coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NOT NULL THEN a.path END AS old_path
  FROM n a LEFT JOIN n b ON b.folder = a.folder AND b.n = a.n AND b.kind = 'rename_to' WHERE a.kind = 'rename_from'),
u AS (SELECT * FROM p UNION SELECT 'create', path, NULL FROM t WHERE alone UNION SELECT kind, path, NULL FROM l WHERE kind IN ('modify', 'create', 'remove'))"""

SQL = {
    "media_stats": "SELECT count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'O') AS open, CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS total_size FROM lineitem",
    "avg_positive": "SELECT CAST(floor(avg(l_quantity) + 0.5) AS BIGINT) AS mean FROM lineitem WHERE l_quantity > 0",
    "histogram_coalesce": "SELECT coalesce(nullif(p_brand, 'Brand#11'), 'Unknown') AS name, count(*) AS count FROM part GROUP BY 1",
    "keyword_top40": f"WITH w AS (SELECT unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+')) AS text FROM documents) SELECT text, count(*) AS value FROM w WHERE length(text) > 3 AND text NOT IN ({_STOP}) AND NOT regexp_full_match(text, '[0-9]+') GROUP BY text ORDER BY value DESC, text LIMIT 40",
    "param_ranges": "SELECT min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, min(l_discount) AS min_l_discount, max(l_discount) AS max_l_discount, min(l_linenumber) AS min_l_linenumber, max(l_linenumber) AS max_l_linenumber FROM lineitem",
    "distinct_values": "SELECT DISTINCT 'l_returnflag' AS field, l_returnflag AS value FROM lineitem UNION SELECT DISTINCT 'l_linestatus', l_linestatus FROM lineitem",
    "filtered_counters": "SELECT count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_totalprice > 200000) AS large FROM orders",
    "smart_counts_one_pass": "SELECT 'views' AS name, count(*) AS count FROM events WHERE event_type = 'view' UNION ALL SELECT 'high', count(*) FROM events WHERE value > 50 UNION ALL SELECT 'early', count(*) FROM events WHERE ts < TIMESTAMP '2024-01-10'",
    "timeline_buckets": "SELECT CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN CASE WHEN date_trunc('day', ts) = TIMESTAMP '2024-02-15' THEN 'today' WHEN date_trunc('day', ts) = TIMESTAMP '2024-02-14' THEN 'yesterday' ELSE strftime(ts, '%Y-%m-%d') END ELSE strftime(ts, '%Y-%m') END AS bucket, count(*) AS count FROM events GROUP BY 1",
    "facet_counts_union": "SELECT 'status' AS facet, o_orderstatus AS name, count(*) AS count FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2",
    "facet_bridge_counts": "SELECT 'parts' AS facet, 'p' || CAST(l_partkey % 50 AS VARCHAR) AS name, count(DISTINCT l_orderkey) AS count FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 2",
    "facet_disjunctive": "SELECT 'tool' AS facet, o_orderpriority AS name, count(*) AS count FROM orders WHERE o_orderstatus = 'F' GROUP BY 2 UNION ALL SELECT 'sampler', o_orderstatus, count(*) FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 2",
    "facet_build_ranked": _FACET,
    "facet_refresh": _FACET,
    "facet_alias_merge": "WITH n AS (SELECT replace(lower(p_brand), '_', '') AS match_key, p_size FROM part) SELECT match_key, count(*) AS count, min(p_size) AS first_used, max(p_size) AS last_used FROM n GROUP BY 1",
    "or_join_split": "SELECT c_custkey AS ck, s_suppkey AS sk FROM customer, supplier WHERE c_custkey = s_suppkey OR c_nationkey = s_nationkey",
    "collection_thumbs": "WITH r AS (SELECT o_custkey AS collection, o_orderkey AS thumb, o_orderstatus = 'F' AS private, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority = '1-URGENT' DESC, o_totalprice DESC, o_orderkey) AS r, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderpriority = '1-URGENT' DESC, o_totalprice DESC, o_orderkey) AS s FROM orders) SELECT collection, count(*) AS count, max(CASE WHEN r = 1 THEN thumb END) AS thumb, max(CASE WHEN s = 1 AND NOT private THEN thumb END) AS safe_thumb FROM r GROUP BY 1",
    "membership_move": "WITH m AS (SELECT DISTINCT o_orderstatus AS collection_id, o_custkey AS asset_id FROM orders) SELECT DISTINCT CASE WHEN collection_id = 'O' AND asset_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'P' ELSE collection_id END AS collection_id, asset_id FROM m",
    "duplicate_groups": "WITH d AS (SELECT sha256(text) AS digest, doc_id, count(*) OVER (PARTITION BY text) AS copies FROM documents) SELECT digest, copies, copies - 1 AS redundant, CAST('0x' || md5(CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) % ((copies + 999) // 1000) AS part, '[' || string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) || ']' AS ids FROM d WHERE copies > 1 GROUP BY ALL",
    "duplicate_resolution": "WITH g AS (SELECT min(doc_id) AS id, bool_or(doc_id % 3 = 0) AS favorite, bool_or(doc_id % 5 = 0) AS pinned, bool_or(doc_id % 2 = 0 AND doc_id % 4 = 0) AS yes, bool_or(doc_id % 2 = 0 AND doc_id % 4 <> 0) AS no FROM documents GROUP BY sha256(text)) SELECT id, favorite, pinned, CASE WHEN yes AND NOT no THEN true WHEN no AND NOT yes THEN false END AS masked FROM g",
    "first_value_dedupe": "WITH r AS (SELECT CAST(s_nationkey AS VARCHAR) AS path, s_acctbal > 0 AS v, s_suppkey % 2 = 0 AS s, s_suppkey AS m, CASE WHEN s_suppkey % 3 > 0 THEN s_name END AS h FROM supplier), f AS (SELECT path, h, row_number() OVER (PARTITION BY path ORDER BY v DESC, s DESC, m DESC) AS n FROM r WHERE h IS NOT NULL) SELECT r.path, f.h AS hash, count(*) AS copies FROM r LEFT JOIN f ON f.path = r.path AND f.n = 1 GROUP BY 1, 2",
    "graph_forward": f"{_TURN} SELECT r.source_id, r.target_id, s.name AS source_name, t.name AS target_name FROM r JOIN a s ON s.id = r.source_id LEFT JOIN a t ON t.id = r.target_id",
    "graph_backlinks": f"{_TURN} SELECT DISTINCT coalesce(r.target_id, n.id) AS used_id, r.source_id, r.role FROM r LEFT JOIN a n ON r.target_id IS NULL AND n.name = r.name WHERE coalesce(r.target_id, n.id) IS NOT NULL",
    "unique_resolution": "SELECT c_mktsegment || '/' || CAST(c_custkey % 200 AS VARCHAR) AS name, CASE WHEN count(*) = 1 THEN min(c_custkey) END AS target_id FROM customer GROUP BY 1",
    "keyword_flag": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN false ELSE contains(lower(text), 'idiot') OR contains(lower(text), 'clown') OR contains(lower(text), 'trash') END AS hidden FROM documents",
    "keyword_index": "WITH k AS (SELECT DISTINCT lower(trim(substring(p_name, CAST(1 + p_partkey % 7 AS BIGINT), size) || CASE WHEN p_partkey % 5 > 0 THEN CAST(p_partkey % 1000 AS VARCHAR) ELSE '' END)) AS k FROM part, (VALUES (1), (2), (3), (5)) s(size)), h AS (SELECT doc_id, k FROM documents JOIN k ON contains(lower(text), k) WHERE k <> '') SELECT d.doc_id, count(k) AS n, min(k) AS first FROM documents d LEFT JOIN h USING (doc_id) GROUP BY 1",
    "upsert_partitions": "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CAST(1 AS INTEGER) AS version FROM orders",
    "name_clean": "SELECT p_partkey, trim(p_name) AS name, regexp_replace(lower(trim(p_name)), '[\\s_.,-]+', '', 'g') AS match_key FROM part",
    "path_class": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'txt2img' WHEN 1 THEN 'img2img' WHEN 2 THEN 'extras' WHEN 3 THEN 'grid' ELSE 'unknown' END AS kind FROM pages",
    "url_clean": "SELECT page_id, lower(CASE WHEN list_extract(regexp_split_to_array(trim(url), '[\\\\/]'), -1) <> '' THEN list_extract(regexp_split_to_array(trim(url), '[\\\\/]'), -1) ELSE trim(url) END) AS base FROM pages",
    "similarity_pairs": "WITH r AS (SELECT p_brand, p_partkey AS k, p_name || ' ' || CAST(p_partkey % 97 AS VARCHAR) AS n FROM part), s AS (SELECT a.k AS a, b.k AS b, 1 - levenshtein(a.n, b.n) / CAST(greatest(length(a.n), length(b.n)) AS DOUBLE) AS similarity FROM r a JOIN r b ON a.p_brand = b.p_brand AND a.k < b.k) SELECT a, b, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.9",
    "json_explode": "SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events",
    "upsert_merge": "WITH r AS (SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS o_orderpriority FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 1 AND o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderpriority, CASE WHEN o_orderkey % 4 = 0 THEN 'new' WHEN o_orderkey % 4 = 1 THEN 'untouched' WHEN o_orderkey % 5 = 0 THEN 'changed' ELSE 'same' END AS change FROM r",
    "three_way_merge": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'L' WHEN o_orderkey % 3 = 0 THEN 'R' ELSE o_orderstatus END AS status FROM orders",
    "tombstone_restore": "WITH m AS (SELECT o_custkey AS id, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1) SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN m.n END AS restored_links FROM customer LEFT JOIN m ON m.id = c_custkey WHERE c_custkey % 2 <> 0 OR c_custkey % 4 = 0",
    "import_new_files": "SELECT url AS path, page_id AS modified FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0 OR page_id % 5 = 0)",
    "parse_params": "SELECT p_partkey, p_name || ', <lora:fine:0.8>' AS positive, CASE WHEN k = 0 THEN 'blurry, bad ' || p_brand END AS negative, CASE WHEN k < 2 THEN CAST(p_size AS BIGINT) END AS steps, CASE WHEN k < 2 THEN 'Euler a' END AS sampler, CASE WHEN k < 2 THEN CAST(7.5 AS DOUBLE) END AS cfg, CASE WHEN k < 2 THEN p_partkey END AS seed, CASE WHEN k < 2 THEN CAST(512 AS INTEGER) END AS width, CASE WHEN k < 2 THEN CAST(768 AS INTEGER) END AS height, CASE WHEN k < 2 THEN 'x, y' END AS model, CASE WHEN k < 2 THEN CAST(2 AS INTEGER) END AS clip_skip FROM (SELECT *, p_partkey % 3 AS k FROM part)",
    "prompt_tokens": "SELECT p_partkey, p_brand || CASE WHEN p_size % 2 = 0 THEN '|second' ELSE '' END AS loras, CASE WHEN p_size % 3 = 0 THEN 'h' ELSE '' END AS hypernets, CASE WHEN p_size % 2 = 0 THEN 'style|detail_b' ELSE '' END AS embeddings FROM part",
    "catalog_json": "SELECT p_partkey, p_brand AS model, CASE WHEN k = 0 THEN 'abc' END AS model_hash, CASE k WHEN 1 THEN p_name || ' tail' WHEN 3 THEN NULL ELSE p_name END AS positive, CASE WHEN k = 2 THEN 'bad' END AS negative, CASE WHEN k < 2 THEN CAST(p_size AS BIGINT) END AS steps, CAST(CASE k WHEN 0 THEN 7.5 WHEN 1 THEN 5 END AS DOUBLE) AS cfg, CASE k WHEN 0 THEN 'euler' WHEN 1 THEN 'lms' WHEN 3 THEN 'ddim' END AS sampler, CASE WHEN k = 1 THEN 'txt2img' END AS type, CASE WHEN k = 0 THEN 'v' END AS vae, CASE WHEN k = 0 AND p_size > 0 THEN p_size END AS clip_skip, CASE WHEN k = 2 THEN 'esrgan' END AS upscaler, k = 3 AS intermediate FROM (SELECT *, p_partkey % 4 AS k FROM part)",
    "stream_coalesce": f"{_RENAMES} SELECT kind, count(*) AS n FROM u GROUP BY 1",
    "stream_renames": f"{_RENAMES} SELECT kind, path, old_path FROM u",
}
