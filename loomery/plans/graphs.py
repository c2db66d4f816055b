"""Queries over workflows written from conversations: a turn is a node, its number the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators import graphs


def _written(rows: DataFrame, kind: Column, inputs: dict[str, Column]) -> DataFrame:
    """(graph, workflow): JSON of the nodes of each conversation; an input's value is JSON text, null where there is none."""
    given = F.map_filter(F.create_map(*[x for name, value in inputs.items() for x in (F.lit(name), value)]), lambda _, v: v.isNotNull())
    body = F.concat_ws(",", F.transform(F.map_entries(given), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])))
    node = F.concat(F.lit('"'), F.col("turn").cast("string"), F.lit('":{"class_type":"'), kind, F.lit('","inputs":{'), body, F.lit("}}"))
    return rows.groupBy(F.col("conv_id").alias("graph")).agg(F.concat(F.lit("{"), F.concat_ws(",", F.collect_list(node)), F.lit("}")).alias("workflow"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.length("text").alias("size"))
    return rows.join(rows.groupBy("conv_id").agg(F.max("turn").alias("last")), "conv_id")


def _link(to: Column) -> Column:
    return F.concat(F.lit('["'), to.cast("string"), F.lit('",0]'))


def graph_roots(spark: SparkSession, d: str) -> DataFrame:
    """Output nodes and root samplers: with paths that meet again, cycles in every fourth graph, two outputs in every third."""
    rows, turn, last, conv = _turns(spark, d), F.col("turn"), F.col("last"), F.col("conv_id")
    kinds = F.array(*map(F.lit, ["KSampler", "VAEDecode", "LatentUpscale", "VAEEncode", "ImageScale"]))
    inner = F.element_at(kinds, ((F.col("size") + turn) % 5 + 1).cast("int"))
    kind = F.when(turn == last, F.when(conv % 5 == 0, "PreviewImage").otherwise("SaveImage")).when((conv % 3 == 0) & (turn == last - 1), "Image Save").otherwise(inner)
    inputs = {
        "samples": F.when((turn > 0) & (turn % 2 == 1), _link(turn - 1)),
        "image": F.when((turn > 0) & (turn % 2 == 0), _link(turn - 1)).when((turn == 0) & (conv % 4 == 0) & (last > 1), _link(last - 1)),
        "latent": F.when(turn >= 3, _link(turn - 3)),
        "text": F.lit('"some text"'),
    }
    found = graphs.selection(_written(rows, kind, inputs), "graph", "workflow")
    return found.select("graph", F.array_join("outputs", ",").alias("outputs"), F.array_join("roots", ",").alias("roots"), "ambiguous")


def graph_models(spark: SparkSession, d: str) -> DataFrame:
    """Models and LoRAs in order behind the sampler of each graph: whole chains, cycles, missing links."""
    rows, turn, last, conv = _turns(spark, d), F.col("turn"), F.col("last"), F.col("conv_id")
    loads = (turn == 0) & (conv % 4 != 1)
    lora = (turn > 0) & (turn < last) & (F.col("size") % 3 > 0)
    kind = F.when(turn == last, "KSampler").when(loads, "CheckpointLoaderSimple").when(lora, "LoraLoader").otherwise("ModelSampling")
    inputs = {
        "model": F.when((turn == 1) & (conv % 7 == 3), _link(F.lit(999))).when(turn > 0, _link(turn - 1)).when(conv % 4 == 1, _link(last - 1)),
        "ckpt_name": F.when(loads, F.concat(F.lit('"models/base'), F.col("size").cast("string"), F.lit('.safetensors"'))),
        "lora_name": F.when(lora, F.concat(F.lit('"style'), turn.cast("string"), F.lit('.pt"'))),
    }
    found = graphs.models(_written(rows, kind, inputs), "graph", "workflow")
    return found.select("graph", "sampler", F.array_join("loras", ",").alias("loras"), "model", "whole")


QUERIES = {f.__name__: f for f in (graph_roots, graph_models)}

_T = "t AS (SELECT conv_id AS g, turn, length(text) AS size, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)"

SQL = {
    "graph_roots": f"""
WITH RECURSIVE {_T},
n AS (SELECT g, turn, CASE WHEN turn = last THEN CASE WHEN g % 5 = 0 THEN 'preview' ELSE 'save' END WHEN g % 3 = 0 AND turn = last - 1 THEN 'save'
  WHEN (size + turn) % 5 = 0 THEN 'sampler' WHEN (size + turn) % 5 = 3 THEN 'encode' ELSE 'other' END AS kind, last FROM t),
e AS (SELECT g, turn AS a, turn - 1 AS b, turn % 2 = 1 AS latent, true AS image FROM n WHERE turn > 0
  UNION ALL SELECT g, 0, last - 1, false, true FROM n WHERE turn = 0 AND g % 4 = 0 AND last > 1
  UNION ALL SELECT g, turn, turn - 3, true, true FROM n WHERE turn >= 3),
f AS (SELECT DISTINCT n.g, n.turn, n.kind FROM n JOIN e ON e.g = n.g AND e.a = n.turn WHERE kind IN ('save', 'preview')),
o AS (SELECT g, turn FROM f WHERE kind = 'save' OR g NOT IN (SELECT g FROM f WHERE kind = 'save')),
m AS (SELECT DISTINCT e.g, e.a, w.way, e.b, CASE WHEN s.kind = 'sampler' THEN 'sampler' ELSE w.nxt END AS nxt
  FROM e JOIN n ON n.g = e.g AND n.turn = e.a JOIN n s ON s.g = e.g AND s.turn = e.b
  JOIN (VALUES ('sampler', 'latent'), ('image', 'image'), ('latent', 'latent'), ('latent', 'image')) w(way, nxt)
  ON CASE WHEN n.kind = 'sampler' THEN w.way = 'sampler' AND e.latent ELSE (w.way = 'image' AND e.image) OR (w.way = 'latent' AND w.nxt = 'latent' AND e.latent) OR (w.way = 'latent' AND w.nxt = 'image' AND e.image AND n.kind = 'encode') END),
i AS (SELECT g, turn, 'image' AS way, 0 AS depth FROM o UNION SELECT i.g, m.b, m.nxt, i.depth + 1 FROM i JOIN m ON m.g = i.g AND m.a = i.turn AND m.way = i.way WHERE i.way <> 'sampler' AND i.depth < 50),
l AS (SELECT g, a AS origin, b AS turn, nxt AS way, 0 AS depth FROM m WHERE way = 'sampler' UNION SELECT l.g, l.origin, m.b, m.nxt, l.depth + 1 FROM l JOIN m ON m.g = l.g AND m.a = l.turn AND m.way = l.way WHERE l.way <> 'sampler' AND l.depth < 50),
p AS (SELECT DISTINCT g, origin, turn FROM l WHERE way = 'sampler'),
u AS (SELECT DISTINCT g, turn AS origin, turn, 0 AS depth FROM i WHERE way = 'sampler' UNION SELECT u.g, u.origin, p.turn, u.depth + 1 FROM u JOIN p ON p.g = u.g AND p.origin = u.turn WHERE u.depth < 20),
k AS (SELECT DISTINCT g, origin, turn FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.g = u.g AND p.origin = u.turn)),
q AS (SELECT g, turn FROM k UNION SELECT g, origin FROM u WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.g = u.g AND k.origin = u.origin))
SELECT o.g AS graph, string_agg(CAST(o.turn AS VARCHAR), ',' ORDER BY o.turn) AS outputs,
  coalesce((SELECT string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FROM (SELECT DISTINCT turn FROM q WHERE q.g = o.g)), '') AS roots,
  (SELECT count(DISTINCT turn) FROM q WHERE q.g = o.g) > 1 AS ambiguous FROM o GROUP BY o.g""",
    "graph_models": f"""
WITH RECURSIVE {_T},
n AS (SELECT g, turn, last, CASE WHEN turn = 0 AND g % 4 <> 1 THEN 'base' || size END AS model, CASE WHEN turn > 0 AND turn < last AND size % 3 > 0 THEN 'style' || turn END AS lora,
  CASE WHEN turn = 0 AND g % 4 <> 1 THEN NULL WHEN turn = 1 AND g % 7 = 3 THEN NULL WHEN turn > 0 THEN turn - 1 ELSE last - 1 END AS nxt FROM t),
r AS (SELECT g, turn, nxt AS pos, 0 AS depth FROM n WHERE turn = last AND turn > 0 AND nxt IS NOT NULL
  UNION ALL SELECT r.g, r.turn, n.nxt, depth + 1 FROM r JOIN n ON n.g = r.g AND n.turn = r.pos WHERE depth < 32),
v AS (SELECT r.g, r.turn, r.depth, n.lora, n.model FROM r JOIN n ON n.g = r.g AND n.turn = r.pos WHERE r.depth < 20),
l AS (SELECT g, turn, lora, min(depth) AS depth FROM v WHERE lora IS NOT NULL GROUP BY 1, 2, 3)
SELECT s.g AS graph, CAST(s.turn AS VARCHAR) AS sampler, coalesce((SELECT string_agg(lora, ',' ORDER BY depth) FROM l WHERE l.g = s.g), '') AS loras,
  CASE WHEN c.n <= 20 THEN (SELECT max(model) FROM v WHERE v.g = s.g) END AS model, c.n <= 20 AS whole
FROM (SELECT DISTINCT g, turn FROM r) s JOIN (SELECT g, count(*) AS n FROM r WHERE pos IS NOT NULL GROUP BY 1) c USING (g)""",
}
