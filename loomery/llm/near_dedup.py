"""MinHash near-dedup with sequential Bayesian verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import shared
from loomery.llm.similarity import NearComponents, Plan, make_units

#: The contract's similarity: at least 85 hundredths of three-word shingle sets.
CONTRACT = Plan(words=3, percent=85, rows=6, miss=1e-6)
#: The default of near-duplicate operators: five words, at least 0.8.
DEFAULT = Plan(words=5, percent=80, rows=5, miss=1e-6)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", plan: Plan = DEFAULT) -> DataFrame:
    """docs with n_shingles, component_id (smallest doc_id reachable over links) and kept added.

    Words are [^\\x20\\x09-\\x0D]+, A-Z lower-cased. A text without words, or null, has an empty
    set, is linked with nothing and is its own component. Repeated rows are copies of each
    other and share a component. Rows with a null doc_id take no part: their component_id is
    null and they are kept. kept is true where doc_id equals component_id, so of rows repeated
    with that doc_id all are. Columns named like an added one are replaced; the others stay.
    """
    added = ("n_shingles", "component_id", "kept")
    names = [c for c in docs.columns if c not in added]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != text]).alias("row"), F.col(f"`{doc_id}`").alias("order_id"), F.col(f"`{text}`").alias("text"))
    units = make_units(rows, "text", plan)
    there = units.where("order_id is not null")
    search = NearComponents(there, ["order_id"], plan)
    found = search.members(search.run()).select("h1", "h2", F.col("head.order_id").alias("component_id"))
    linked = there.where("n > 0").join(found, ["h1", "h2"]).select("row", "unit_text", "n", "component_id", (F.col("order_id") == F.col("component_id")).alias("kept"))
    alone = units.where("order_id is null or n = 0").select("row", "unit_text", "n", F.col("order_id").alias("component_id"), F.lit(True).alias("kept"))
    out = linked.unionByName(alone)
    own = [F.col("unit_text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in names]
    return out.select(*own, F.col("n").alias("n_shingles"), "component_id", "kept")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read_texts(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")
    return near_duplicates(docs, plan=CONTRACT).select("doc_id", "n_shingles", "component_id", "kept")


#: Plain set intersection of all pairs that share a shingle, for tables of test size.
OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT DISTINCT x AS doc_id, x AS reached FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reached),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id, coalesce(m.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
