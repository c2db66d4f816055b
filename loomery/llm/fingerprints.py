"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import shared
from loomery.llm.arrays import SpanHasher, mix, row_slices, text_buffers
from loomery.llm.similarity import text_sets

WORDS = 5


@dataclass(frozen=True)
class Layout:
    """bins (a power of two) minima of which bits low-order bits are stored. 512 x 4 bits estimate a likeness with a
    standard error of at most 0.024."""

    bins: int = 512
    bits: int = 4

    @property
    def size(self) -> int:
        return self.bins * self.bits // 8


def _donors(layout: Layout, attempt: int) -> np.ndarray:
    """For every bin the bin it asks in this attempt; a hash of both, alike for all texts."""
    ask = mix(np.arange(layout.bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt + 1))
    return (ask % np.uint64(layout.bins)).astype(np.int64)


def binned(sets: list[np.ndarray], layout: Layout) -> np.ndarray:
    """(sets, bins) minima. Each hash falls into one bin; an empty bin takes the minimum of the first
    non-empty bin that its own sequence of hashes hits. A text without shingles keeps all ones."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), layout.bins), empty)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    if sizes.sum() == 0:
        return out
    # sets are sorted, so bins by high bits come in order and a bin's first hash is its minimum
    flat = np.concatenate(sets)
    place = np.repeat(np.arange(len(sets)), sizes) * layout.bins + (flat >> np.uint64(64 - layout.bins.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    out.ravel()[place[first]] = flat[first]
    own = out.copy()
    row, spot = np.nonzero((out == empty) & (sizes > 0)[:, None])
    attempt = 0
    while len(row):
        value = own[row, _donors(layout, attempt)[spot]]
        found = value != empty
        out[row[found], spot[found]] = value[found]
        row, spot, attempt = row[~found], spot[~found], attempt + 1
    return out


def packed(minima: np.ndarray, layout: Layout) -> np.ndarray:
    """(sets, size) bytes: the low bits of every minimum, low bins first.

    Minima are hashed with their bin, so a value that fills many bins of a short text shows
    other bits in each and does not agree with another value in all of them by one chance.
    """
    salt = np.arange(layout.bins, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    low = (mix(minima ^ salt) & np.uint64((1 << layout.bits) - 1)).astype(np.uint8)
    bits = (low[:, :, None] >> np.arange(layout.bits, dtype=np.uint8)) & 1
    return np.packbits(bits.reshape(len(minima), -1), axis=1, bitorder="little")


def likeness(left: np.ndarray, right: np.ndarray, left_empty: np.ndarray, right_empty: np.ndarray, layout: Layout) -> np.ndarray:
    """Estimated Jaccard likeness of rows of packed fingerprints, from 0 to 1.

    Unrelated minima agree in all stored bits once in 2 ** bits; that share is taken out. Two
    texts without words are alike, one without and one with are not.
    """
    bits = np.unpackbits(left ^ right, axis=1, bitorder="little").reshape(len(left), layout.bins, layout.bits)
    chance = 1 / (1 << layout.bits)
    agree = 1 - bits.any(2).mean(1)
    found = np.clip((agree - chance) / (1 - chance), 0, 1)
    return np.where(left_empty | right_empty, (left_empty & right_empty).astype(float), found)


def fingerprint_column(texts: pa.Array, hasher: SpanHasher, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Packed fingerprints of a text column and which rows have no shingle."""
    parts, empty = [], []
    for _, sets in text_sets(texts, WORDS, hasher):
        for lo in range(0, len(sets), 256):
            parts.append(packed(binned(sets[lo : lo + 256], layout), layout))
        empty.extend(len(x) == 0 for x in sets)
    return (np.concatenate(parts) if parts else np.zeros((0, layout.size), dtype=np.uint8)), np.array(empty, dtype=bool)


def fingerprint(docs: DataFrame, *, text: str = "text", layout: Layout | None = None) -> DataFrame:
    """docs with fingerprint (hex string) added; a null or empty text has that of no shingles. Rows are
    handled one by one; a column of that name is replaced."""
    layout = layout or Layout()
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "fingerprint"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in batches:
            marks, _ = fingerprint_column(batch.column(batch.schema.get_field_index(text)), hasher, layout)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m.tobytes().hex() for m in marks], pa.string())], names=[*batch.schema.names, "fingerprint"])

    return kept.mapInArrow(run, f"{schema}, fingerprint string")


def in_order(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, list[int]]:
    """Rows (doc_id, text, tail) range-dealt and sorted by doc_id; after the last row of every shard stands
    a tail row, the first row of the next shard that has one (after the last shard: of the first)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    bounds = shared.range_bounds(rows, "doc_id", shared.shard_count(spark, rows.agg(F.sum(F.octet_length("text"))).first()[0]))
    shard = shared.shard_udf(bounds)
    dealt = rows.withColumn("shard", shard("doc_id")).withColumn("tie", F.xxhash64("text"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")
    first = dealt.groupBy("shard").agg(F.min(order).alias("o")).orderBy("shard").collect()  # one short row a shard
    tails = []
    for here, after in zip(first, [*first[1:], *first[:1]], strict=True):
        tails.append((here.shard, after.shard, after.o.doc_id, after.o.tie))
    goal = spark.createDataFrame(tails, "goal int, shard int, doc_id long, tie long")
    same = (F.col("d.shard") == F.col("g.shard")) & F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.tie") == F.col("g.tie"))
    # as many goals as shards
    copies = dealt.alias("d").join(F.broadcast(goal).alias("g"), same).groupBy("g.goal", "d.doc_id", "d.tie").agg(F.min("d.text").alias("text"))
    tail = copies.select(F.col("goal").alias("shard"), "doc_id", "tie", "text", F.lit(True).alias("tail"))
    both = dealt.select("shard", "doc_id", "tie", "text", F.lit(False).alias("tail")).unionByName(tail)
    n = len(bounds) + 1
    return both.repartitionById(n, "shard").sortWithinPartitions("tail", F.asc_nulls_last("doc_id"), "tie").select("doc_id", "text", "tail"), bounds


def edited(text: str, following: str) -> str:
    """text with its last quarter (rounded down) replaced by as many first code points of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprint_pairs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", layout: Layout | None = None) -> DataFrame:
    """For every row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the next row in ascending doc_id order (rows of equal doc_id by a
    hash of their text, null doc_ids last); after the last comes the first, and a single row
    follows itself. Null reads as empty. Other columns are not carried.
    """
    layout = layout or Layout()
    shared.bound_batches(docs.sparkSession)
    ordered, _ = in_order(docs, doc_id, text)

    def emit(ids: list, texts: list[str], hasher: SpanHasher) -> pa.RecordBatch:
        """Rows for all but the last text, which only follows."""
        changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
        own, own_empty = fingerprint_column(pa.array(texts, pa.large_string()), hasher, layout)
        new, new_empty = fingerprint_column(pa.array(changed, pa.large_string()), hasher, layout)
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([len(x) for x in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
            pa.array([m.tobytes().hex() for m in own[:-1]]),
            pa.array([m.tobytes().hex() for m in new]),
            pa.array(likeness(own[:-1], new, own_empty[:-1], new_empty, layout)),
            pa.array(likeness(own[:-1], own[1:], own_empty[:-1], own_empty[1:], layout)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        last_id, last_text = None, None
        for whole in batches:
            offsets, _ = text_buffers(whole.column(1))
            for lo, hi in row_slices(offsets, 4 << 20):
                ids, texts = whole.column(0).slice(lo, hi - lo).to_pylist(), whole.column(1).slice(lo, hi - lo).to_pylist()
                if last_text is not None:
                    ids, texts = [last_id, *ids], [last_text, *texts]
                last_id, last_text = ids[-1], texts[-1]
                if len(texts) > 1:
                    yield emit(ids[:-1], texts, hasher)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("doc_id", "text").mapInArrow(run, schema)


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read_texts(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")
    return fingerprint_pairs(docs)
