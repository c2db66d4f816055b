"""Node graphs of workflows as tables of nodes and links: output selection, sampler reachability, model chains.

A workflow is JSON {id: {class_type, mode, inputs}}; an input [id, slot] is a link. Graphs of all assets are walked
together, level by level, so the work follows the number of links and no graph is held in one place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery import storage
from loomery.functions import text

# Input names in order of preference.
IMAGE_INPUTS = ["images", "image", "pixels", "samples", "latent", "latents"]
LATENT_INPUTS = ["latent_image", "samples", "latent", "latents"]
REROUTE_INPUTS = ["", "value", "input", "any"]
MODEL_INPUTS = ["model", "ckpt", "base_model", "COMBO", "MODEL", "VAE", "CLIP"]
MODEL_NAMES = ["ckpt_name", "unet_name"]

#: Links of one search, and samplers in a row; longer paths and cycles end there.
MAX_DEPTH, MAX_SAMPLERS = 50, 20

_NODE = "map<string, struct<class_type: string, mode: int, inputs: map<string, string>>>"


def nodes(rows: DataFrame, graph: str, workflow: str) -> DataFrame:
    """(graph, node, type, mode, inputs) of every node; rows whose JSON is null or no object of nodes have none."""
    found = rows.select(F.col(graph).alias("graph"), F.explode(F.from_json(F.col(workflow), _NODE)).alias("node", "n"))
    return found.where("n is not null").select("graph", "node", F.coalesce("n.class_type", F.lit("")).alias("type"), F.coalesce("n.mode", F.lit(0)).alias("mode"), "n.inputs")


def links(nodes: DataFrame) -> DataFrame:
    """(graph, node, input, source): inputs that are links to a node of their graph."""
    raw = nodes.select("graph", "node", F.explode("inputs").alias("input", "raw")).where(F.col("raw").startswith("["))
    pair = F.from_json("raw", "array<string>")
    ends = raw.withColumn("pair", pair).where(F.size("pair") == 2).select("graph", "node", "input", F.col("pair")[0].alias("source"))
    return ends.join(nodes.select("graph", F.col("node").alias("source")), ["graph", "source"], "left_semi").select("graph", "node", "input", "source")


def is_sampler(kind: Column) -> Column:
    plain = F.contains(kind, F.lit("KSampler")) & ~F.contains(kind, F.lit("Select")) & ~F.contains(kind, F.lit("Provider"))
    return plain | kind.isin("SamplerCustomAdvanced", "SamplerCustom") | F.contains(kind, F.lit("StyleAlignedReferenceSampler"))


def output_kind(kind: Column) -> Column:
    """save, preview or null by a node's type, whatever its case and punctuation."""
    bare = F.lower(F.regexp_replace(kind, "[^A-Za-z0-9]", ""))
    has = lambda x: F.contains(bare, F.lit(x))
    return F.when(has("preview") & has("image") & ~has("save"), "preview").when((bare == "sdpromptsaver") | (has("save") & has("image")), "save")


def _place(name: Column, names: list[str]) -> Column:
    """Where a name stands in a list, null if nowhere."""
    return F.nullif(F.array_position(F.array(*map(F.lit, names)), name), F.lit(0))


def _first_link(links: DataFrame, names: list[str]) -> DataFrame:
    """(graph, node, source): the link of the input that comes first among names."""
    ranked = links.withColumn("place", _place(F.col("input"), names)).where("place is not null")
    return ranked.groupBy("graph", "node").agg(F.min_by("source", F.struct("place", "source")).alias("source"))


def moves(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(graph, node, way, source, next): where a search that is at a node in some way goes on.

    way is image or latent on the way to a sampler, and sampler at one; latent inputs lead on from a sampler. An
    encoder of images turns from latent back to image. A reroute has one source.
    """
    typed = links.join(nodes.select("graph", "node", "type"), ["graph", "node"])
    rerouted = _first_link(typed.where("type = 'Reroute'"), REROUTE_INPUTS + IMAGE_INPUTS).withColumn("way", F.explode(F.array(F.lit("image"), F.lit("latent")))).withColumn("to", F.col("way"))
    plain = typed.where("type <> 'Reroute'").withColumn("sampler", is_sampler(F.col("type")))
    image, latent = F.col("input").isin(IMAGE_INPUTS), F.col("input").isin(LATENT_INPUTS)
    pair = lambda way, to: F.struct(F.lit(way).alias("way"), F.lit(to).alias("to"))
    ways = F.array_compact(
        F.array(
            F.when(F.col("sampler") & latent, pair("sampler", "latent")),
            F.when(~F.col("sampler") & image, pair("image", "image")),
            F.when(~F.col("sampler") & latent, pair("latent", "latent")),
            F.when(~F.col("sampler") & image & F.col("type").startswith("VAEEncode"), pair("latent", "image")),
        )
    )
    found = plain.select("graph", "node", "source", F.explode(ways).alias("w")).select("graph", "node", "source", "w.way", "w.to").unionByName(rerouted.select("graph", "node", "source", "way", "to")).distinct()
    ends = nodes.select("graph", F.col("node").alias("source"), is_sampler(F.col("type")).alias("sampler"))
    return found.join(ends, ["graph", "source"]).select("graph", "node", "way", "source", F.when(F.col("sampler"), "sampler").otherwise(F.col("to")).alias("next"))


def outputs(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(graph, node): the nodes that save an image, or else those that show one; muted and bypassed ones (mode 2, 4) and
    those without an image input do not count."""
    fed = links.where(F.col("input").isin(IMAGE_INPUTS)).select("graph", "node").distinct()
    found = nodes.where(~F.col("mode").isin(2, 4)).withColumn("kind", output_kind(F.col("type"))).where("kind is not null").join(fed, ["graph", "node"], "left_semi")
    saves = found.where("kind = 'save'").select("graph").distinct()
    return found.where("kind = 'save'").select("graph", "node").unionByName(found.where("kind = 'preview'").join(saves, "graph", "left_anti").select("graph", "node"))


def walk(begin: DataFrame, moves: DataFrame, depth: int) -> DataFrame:
    """(graph, origin, node, way) of all that searches from begin (the same columns) meet within so many moves, saved.

    A recursive query. Each level holds every state once, so paths that meet again do not multiply, and the depth
    ends cycles. It runs in a session of its own: Spark's limit of a million rows is meant for one small graph, and
    adaptive planning of some fifty small levels takes longer than they do.
    """
    spark = begin.sparkSession
    side = storage.side_session(spark, spark__sql__cteRecursionRowLimit="-1", spark__sql__adaptive__enabled="false")
    tables = {name: side.read.schema(df.schema).parquet(storage.saved(df, name).saved_path) for name, df in (("begin", begin.select("graph", "origin", "node", "way")), ("moves", moves))}
    found = side.sql(
        f"""
    WITH RECURSIVE r(graph, origin, node, way, depth) AS (
      SELECT graph, origin, node, way, 0 FROM {{begin}}
      UNION ALL
      SELECT DISTINCT r.graph, r.origin, m.source, m.next, r.depth + 1 FROM r
      JOIN {{moves}} m ON m.graph = r.graph AND m.node = r.node AND m.way = r.way WHERE r.depth < {depth})
    SELECT DISTINCT graph, origin, node, way FROM r""",
        **tables,
    )
    path = storage.saved(found, "walked").saved_path
    return spark.read.schema(found.schema).parquet(path)


def selection(rows: DataFrame, graph: str, workflow: str) -> DataFrame:
    """(graph, outputs, roots, ambiguous) of every graph that has an output: its output nodes, and the root samplers
    behind them, numbers first. More than one root is ambiguous.

    From the outputs images lead to samplers; from a sampler latents lead to the samplers that feed it, and so on up
    to those that no sampler feeds, the roots. A sampler whose feeders only feed each other is its own root. Each
    search takes MAX_DEPTH links at most, or fewer where no graph has as many states; MAX_SAMPLERS samplers may follow
    one another.
    """
    all_nodes = storage.saved(nodes(rows, graph, workflow), "nodes")
    all_links = storage.saved(links(all_nodes), "links")
    ends = outputs(all_nodes, all_links)
    steps = storage.saved(moves(all_nodes, all_links), "moves")
    largest = all_nodes.groupBy("graph").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first().n
    kinds = all_nodes.select("graph", "node", is_sampler(F.col("type")).alias("sampler"))
    begin = ends.join(kinds, ["graph", "node"]).select("graph", F.lit("").alias("origin"), "node", F.when(F.col("sampler"), "sampler").otherwise("image").alias("way"))
    first = walk(begin, steps.where("way <> 'sampler'"), min(MAX_DEPTH, largest)).where("way = 'sampler'").select("graph", "node")
    feeders = steps.where("way = 'sampler'").select("graph", F.col("node").alias("origin"), F.col("source").alias("node"), F.col("next").alias("way"))
    fed = walk(feeders, steps.where("way <> 'sampler'"), min(MAX_DEPTH, 2 * largest)).where("way = 'sampler'")
    pairs = storage.saved(fed.select("graph", F.col("origin").alias("node"), F.lit("").alias("way"), F.col("node").alias("source"), F.lit("").alias("next")), "feeders")
    above = walk(first.select("graph", F.col("node").alias("origin"), "node", F.lit("").alias("way")), pairs, min(MAX_SAMPLERS, largest))
    tops = above.join(pairs.select("graph", "node").distinct(), ["graph", "node"], "left_anti").groupBy("graph", "origin").agg(F.collect_set("node").alias("tops"))
    roots = first.withColumnRenamed("node", "origin").join(tops, ["graph", "origin"], "left").select("graph", F.explode(F.coalesce("tops", F.array("origin"))).alias("root")).distinct()
    found = ends.groupBy("graph").agg(_in_order(F.collect_set("node")).alias("outputs")).join(roots.groupBy("graph").agg(_in_order(F.collect_set("root")).alias("roots")), "graph", "left")
    return found.select("graph", "outputs", F.coalesce("roots", F.array().cast("array<string>")).alias("roots"), (F.coalesce(F.size("roots"), F.lit(0)) > 1).alias("ambiguous"))


def _in_order(ids: Column) -> Column:
    """Node ids sorted as numbers, others after them as text."""
    keyed = F.transform(ids, lambda x: F.struct(F.when(x.rlike("^[0-9]{1,20}$"), x.cast("decimal(20,0)")).isNull().alias("text"), F.when(x.rlike("^[0-9]{1,20}$"), x).cast("decimal(20,0)").alias("number"), x.alias("id")))
    return F.transform(F.array_sort(keyed), lambda x: x["id"])


def chain_steps(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(graph, node, next, names, model) of the nodes that a model passes through: next is the node that it comes from,
    names what the node adds (a LoRA), model what it loads, which ends the chain."""
    typed = links.join(nodes.select("graph", "node", "type"), ["graph", "node"])
    before = _first_link(typed.where("type = 'Reroute'"), REROUTE_INPUTS).unionByName(_first_link(typed.where("type <> 'Reroute'"), MODEL_INPUTS))
    value = lambda name: F.when(~F.col("inputs")[name].startswith("["), F.nullif(F.col("inputs")[name], F.lit("")))
    model = F.coalesce(*[value(n) for n in MODEL_NAMES])
    lora = F.when(F.col("type").isin("LoraLoader", "LoraLoaderModelOnly"), value("lora_name"))
    own = nodes.select("graph", "node", text.clean_name(model).alias("model"), F.when(lora.isNotNull(), F.array(text.clean_name(lora))).otherwise(F.array().cast("array<string>")).alias("names"))
    return own.join(before, ["graph", "node"], "left").select("graph", "node", F.when(F.col("model").isNull(), F.col("source")).alias("next"), "names", "model")


def chains(steps: DataFrame, limit: int = 20) -> DataFrame:
    """(graph, node, names, model, whole) for every node of steps: the names along its chain of at most limit nodes, the
    node's own first, each once; the model that the chain ends in; whole is false for cycles and longer chains, which
    have no model.

    Pointer jumping: after k rounds a node knows the next 2^k nodes, so limit nodes take log2(limit) joins. What a node
    knows is bounded by limit, and each round is saved.
    """
    at = lambda name, i: F.struct(i.alias("at"), name.alias("name"))
    held = steps.select("graph", "node", "next", F.transform("names", lambda x: at(x, F.lit(0))).alias("names"), "model", F.lit(1).alias("hops"))
    for _ in range(math.ceil(math.log2(limit))):
        held = storage.saved(held, "chain")
        ahead = held.select("graph", F.col("node").alias("next"), F.col("next").alias("n"), F.col("names").alias("more"), F.col("model").alias("m"), F.col("hops").alias("h"))
        further = F.transform("more", lambda x: at(x["name"], x["at"] + F.col("hops")))
        names = F.when(F.col("more").isNull(), F.col("names")).otherwise(F.concat("names", further))
        held = held.join(ahead, ["graph", "next"], "left").select("graph", "node", F.col("n").alias("next"), names.alias("names"), F.coalesce("model", "m").alias("model"), (F.col("hops") + F.coalesce("h", F.lit(0))).alias("hops"))
    whole = F.col("next").isNull() & (F.col("hops") <= limit)
    own = F.transform(F.filter("names", lambda x: x["at"] < limit), lambda x: x["name"])
    return held.select("graph", "node", F.array_distinct(own).alias("names"), F.when(whole, F.col("model")).alias("model"), whole.alias("whole"))


def models(rows: DataFrame, graph: str, workflow: str, limit: int = 20) -> DataFrame:
    """(graph, sampler, loras, model, whole) of every sampler with a model input, the LoRAs nearest to it first."""
    all_nodes = storage.saved(nodes(rows, graph, workflow), "nodes")
    all_links = storage.saved(links(all_nodes), "links")
    found = chains(chain_steps(all_nodes, all_links), limit)
    samplers = all_nodes.where(is_sampler(F.col("type"))).select("graph", F.col("node").alias("sampler"))
    fed = all_links.where("input = 'model'").select("graph", F.col("node").alias("sampler"), F.col("source").alias("node"))
    return samplers.join(fed, ["graph", "sampler"]).join(found, ["graph", "node"]).select("graph", "sampler", F.col("names").alias("loras"), "model", "whole")
