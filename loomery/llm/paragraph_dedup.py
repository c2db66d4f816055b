"""Substring dedup: near copies of lines by MinHash banding and exact Jaccard, and repeated passages anywhere in the texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import shared
from loomery.llm.passages import repeated_passages
from loomery.llm.similarity import NearComponents, Plan, make_units

#: Three rows a band keep the bands few; fourteen of them and the pruning miss at most one in ten thousand pairs at 0.8.
PLAN = Plan(words=5, percent=80, rows=3, miss=1e-4, batches=2)
MIN_WORDS = 40


def split_paragraphs(docs: DataFrame, doc_id: str, text: str, min_words: int) -> DataFrame:
    """(doc_id, text_hash, paragraph, start, end, body) for the lines of at least min_words words.

    paragraph counts the lines of a text from 0; start and end are code point offsets.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("text")).where("text is not null")
    names = ["doc_id", "text_hash", "paragraph", "start", "end", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows, spots, starts, ends, bodies = [], [], [], [], []
                for i, value in enumerate(batch.column(2)):
                    start = 0
                    for spot, line in enumerate(value.as_py().split("\n")):
                        if len(line) >= 2 * min_words - 1 and len(line.encode().split()) >= min_words:
                            rows.append(i)
                            spots.append(spot)
                            starts.append(start)
                            ends.append(start + len(line))
                            bodies.append(line)
                        start += len(line) + 1
                take = pa.array(rows, pa.int64())
                columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(spots, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(bodies, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, paragraph int, start long, end long, body string")


def repeated_paragraphs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, plan: Plan = PLAN) -> DataFrame:
    """One row for each paragraph that has a near copy: doc_id, text_hash, paragraph, start, end,
    cluster_doc_id and cluster_paragraph (the first of its component by doc_id and place) and removed.

    Paragraphs are lines of at least min_words words; components join those whose shingle sets
    are similar to the plan's percent or more. Every member but the first is removed. Null and
    short texts have no paragraphs; repeated rows are alike, so the copies of a first paragraph
    that share its doc_id and place all stay. Null doc_ids come first in the order.
    """
    units = make_units(split_paragraphs(docs, doc_id, text, min_words), "body", plan)
    search = NearComponents(units, ["doc_id", "text_hash", "paragraph"], plan)
    found = search.members(search.run()).where("members > 1").select("h1", "h2", "head")
    place = F.struct("doc_id", "text_hash", "paragraph")
    out = units.join(found, ["h1", "h2"]).withColumn("removed", ~place.eqNullSafe(F.col("head")))
    out = out.select("doc_id", "text_hash", "paragraph", "start", "end", F.col("head.doc_id").alias("cluster_doc_id"), F.col("head.paragraph").alias("cluster_paragraph"), "removed")
    out = shared.saved(out, "paragraphs")
    shared.release(docs.sparkSession, units, search.classes)
    return out


def drop_paragraphs(docs: DataFrame, repeats: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the removed paragraphs; the other lines stay joined by \\n, other columns as they are."""
    gone = repeats.where("removed").groupBy("doc_id", "text_hash").agg(F.collect_set("paragraph").alias("gone_lines"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "gone_lines")
    body = F.col(f"d.`{text}`")
    joined = docs.alias("d").join(gone, F.col(f"d.`{doc_id}`").eqNullSafe(F.col("gone_id")) & (F.xxhash64(body) == F.col("gone_hash")), "left")
    lines = F.split(body, "\n", -1)
    kept = F.array_join(F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("gone_lines", i), x)), lambda x: x.isNotNull()), "\n")
    return joined.select(*[F.when(F.col("gone_lines").isNull(), body).otherwise(kept).alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns])


def drop_passages(docs: DataFrame, repeats: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the removed spans (start, end) of repeats, of passages, paragraphs or both; other columns as they are."""
    spans = repeats.where("removed").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct(F.col("start"), F.col("end")))).alias("gone_spans"))
    spans = spans.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "gone_spans")
    body = F.col(f"d.`{text}`")
    joined = docs.alias("d").join(spans, F.col(f"d.`{doc_id}`").eqNullSafe(F.col("gone_id")) & (F.xxhash64(body) == F.col("gone_hash")), "left")
    kept = F.aggregate(
        "gone_spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(F.concat(acc.out, F.substring(body, acc.at.cast("int") + 1, F.greatest(s.start - acc.at, F.lit(0)).cast("int"))).alias("out"), F.greatest(acc.at, s.end).alias("at")),
        lambda acc: F.concat(acc.out, F.substring(body, acc.at.cast("int") + 1, F.length(body))),
    )
    return joined.select(*[F.when(F.col("gone_spans").isNull(), body).otherwise(kept).alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read_texts(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")
    lines = repeated_paragraphs(docs).select("doc_id", "paragraph", "start", "end", "cluster_doc_id", "cluster_paragraph", F.lit(None).cast("long").alias("cluster_start"), "removed")
    return lines.unionByName(repeated_passages(docs).drop("text_hash"), allowMissingColumns=True)
