"""Mixing sources to target weights: fixed-length blocks, counts drawn for each output shard, permuted indexes.

The words of a source, in an order by hashes of its documents, are packed into blocks of BLOCK_WORDS. Every
output shard draws how many of its slots each source fills; the draws are multinomial given that all shards
together take each source's target (so a target is met to the word, which free draws would miss by a random
walk). The j-th slot of a source takes block p(j) of a pseudorandom permutation p of its block indexes, another
one for each pass, so no block comes a third time before all came twice. Blocks are then joined by their index.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm import arrays, shared

BLOCK_WORDS = 512
#: Slots of one output shard, at least; and at least so many for each source, so that a shard's draw costs less than its slots.
SHARD_SLOTS, SLOTS_A_SOURCE = 1024, 16
#: Documents of a source that are numbered together.
CHUNK_ROWS = 20_000


def sized(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, text_hash, size) of every row, saved; size counts the runs of other than [\\x20\\x09-\\x0D]."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{text}`").cast("string").alias("text"))
    return shared.saved(rows.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), size.alias("size")), "sizes")


def targets(rows: DataFrame, cycle: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, rank, source_size, target) of sized rows: the sources by code point, null last, weigh `cycle`, repeating.

    Together they get `share` of all words by weight; a target stops at `most` times its source's size, and what
    is over is shared out among the others by weight until none is above. One row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(by_name).cast("int"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), F.pmod(F.col("rank") - 1, F.lit(len(cycle))) + 1)
    found = found.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(most)))
    # in the order of most / weight those that stop come first: the level is that of the first that does not
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    over, left = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)) - F.coalesce(F.sum("most").over(over), F.lit(0.0))) / F.sum("weight").over(left)
    found = found.withColumn("level", level).withColumn("place", F.row_number().over(order))
    free = F.min_by("level", F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("place"))).over(Window.partitionBy())
    return found.withColumn("free", free).select("source", "rank", "source_size", F.coalesce(F.least(F.col("free") * F.col("weight"), "most"), "most").alias("target"))


def _rounds(index: np.ndarray, bits: int, key: int, back: bool) -> np.ndarray:
    """One pass of a Feistel network over 2 * bits binary digits."""
    half, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    left, right = index >> half, index & mask
    for r in (3, 2, 1, 0) if back else (0, 1, 2, 3):
        if back:
            left, right = right ^ (arrays.mix(left + np.uint64((key + r * 0x9E3779B97F4A7C15) & (2**64 - 1))) & mask), left
        else:
            left, right = right, left ^ (arrays.mix(right + np.uint64((key + r * 0x9E3779B97F4A7C15) & (2**64 - 1))) & mask)
    return (left << half) | right


def permuted(index: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n), or its inverse, at some indexes: values out of range go round again."""
    bits = max((int(n - 1).bit_length() + 1) // 2, 1)
    out = _rounds(index.astype(np.uint64), bits, key, back)
    while (out_of := out >= np.uint64(n)).any():
        out[out_of] = _rounds(out[out_of], bits, key, back)
    return out.astype(np.int64)


def _key(*parts: int) -> int:
    """A 64-bit key out of numbers."""
    with np.errstate(over="ignore"):
        return int(functools.reduce(lambda h, x: arrays.mix(np.array([h ^ np.uint64(int(x) & (2**64 - 1))], dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019))[0], parts, np.uint64(0)))


def _slot_counts(seed: int, length: int):
    """Adds to sources (rank, source_size, target): quota in words, blocks, last (words of the last block), slots, and cut
    (words that the last slot takes)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for rank, size, target in zip(frame["rank"], frame["source_size"], frame["target"], strict=True):
                blocks, quota = -(-size // length), int(target + 0.5)
                last = size - (blocks - 1) * length if blocks else 0
                full, more = divmod(quota, size) if size else (0, 0)
                slots, cut = full * blocks, last
                if more:  # a pass that ends early: the short block counts if it comes before the end
                    short = int(permuted(np.array([blocks - 1]), blocks, _key(seed, rank, full), back=True)[0])
                    n = -(-more // length)
                    if short < n:
                        n = -(-(more + length - last) // length)
                    held = (n - 1) * length - (length - last if short < n - 1 else 0)
                    slots, cut = slots + n, more - held
                else:
                    cut = length  # whole passes: the last slot is whole, whichever block it is
                rows.append((rank, quota, blocks, last, slots, cut))
            yield pd.concat([frame.reset_index(drop=True), pd.DataFrame(rows, columns=["r", "quota", "blocks", "last", "slots", "cut"], dtype="int64").drop(columns="r")], axis=1)

    return run


def _split(rng: np.random.Generator, held: np.ndarray, n: int) -> np.ndarray:
    """How many of n slots, drawn without replacement out of held, each source gets."""
    out, total = np.zeros_like(held), int(held.sum())
    for i in np.flatnonzero(held):
        own, rest = int(held[i]), total - int(held[i])
        if total < 10**9:
            got = int(rng.hypergeometric(own, rest, n))
        else:  # numpy draws from smaller populations only: the normal limit, kept within what is possible
            p = own / total
            got = round(n * p + rng.standard_normal() * (n * p * (1 - p) * (total - n) / max(total - 1, 1)) ** 0.5)
            got = min(max(got, n - rest, 0), own, n)
        out[i], n, total = got, n - got, rest
        if not n:
            break
    return out


def shard_draws(slots: np.ndarray, width: int, seed: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, counts, slots of each source in the shards before) of the shards first to last - 1.

    The slots of all sources are dealt over shards of `width` by halving the range of shards; a draw depends on the
    range only, so every task finds the same ones.
    """
    total = int(slots.sum())

    def walk(lo: int, hi: int, held: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if lo >= last or hi <= first:
            return
        if hi - lo == 1:
            yield lo, held, before
            return
        mid = (lo + hi) // 2
        left = _split(np.random.Generator(np.random.PCG64(_key(seed, lo, hi))), held, min(mid * width, total) - lo * width)
        yield from walk(lo, mid, left, before)
        yield from walk(mid, hi, held - left, before + left)

    if total:
        yield from walk(0, -(-total // width), slots, np.zeros_like(slots))


def _slots(path: str, width: int, seed: int, length: int):
    """(shard, slot, rank, block, take) of a range of shards; the sources are read from the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if sources is None:
                fs, root = shared.filesystem(path)
                sources = ds.dataset(root, filesystem=fs, format="parquet").to_table(columns=["rank", "blocks", "slots", "cut"]).sort_by("rank")
                ranks, blocks, slots, cut = (c.to_numpy().astype(np.int64) for c in sources.columns)
            shards = batch.column(0).to_numpy()
            for shard, counts, before in shard_draws(slots, width, seed, int(shards[0]), int(shards[-1]) + 1):
                own = [np.zeros(0, dtype=np.int64)] * 3
                for i in np.flatnonzero(counts):
                    j = before[i] + np.arange(counts[i])
                    block, take = np.empty(len(j), dtype=np.int64), np.where(j == slots[i] - 1, cut[i], length)
                    for p in np.unique(j // blocks[i]):
                        some = j // blocks[i] == p
                        block[some] = permuted(j[some] % blocks[i], int(blocks[i]), _key(seed, int(ranks[i]), int(p)))
                    own = [np.append(a, b) for a, b in zip(own, (np.full(len(j), ranks[i]), block, take), strict=True)]
                order = np.random.Generator(np.random.PCG64(_key(seed, shard))).permutation(len(own[0]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), shard)), pa.array(np.arange(len(order))), *[pa.array(x[order]) for x in own]], names=["shard", "slot", "rank", "block", "take"])

    return run


class Mixture:
    """What mix() finds.

    docs: (doc_id, text_hash, rank, start, size, source_size, target) of every row; start is the place of its first
    word among the words of its source. spans: (shard, slot, rank, block, place, doc_id, text_hash, start, first, n):
    n words of a document from its word `first` on stand at `place` of a block that a slot of an output shard takes.
    """

    def __init__(self, docs: DataFrame, spans: DataFrame) -> None:
        self.docs, self.spans = docs, spans

    def texts(self, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(shard, slot, place, doc_id, n, text): the spans with their words as they stand in docs."""
        key = ["rank", "start", "doc_id", "text_hash"]
        pieces = self.spans.groupBy(*key).agg(F.collect_list(F.struct("shard", "slot", "place", "first", "n")).alias("pieces"))  # as many as the document's words allow
        body = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "text_hash"])
        both = pieces.alias("p").join(body.alias("b"), F.col("p.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("p.text_hash") == F.col("b.text_hash")))
        kind = docs.schema[doc_id].dataType.simpleString()

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    raw = batch.column(1)[i].as_py().encode("utf-8", "surrogatepass")
                    begin, end = arrays.word_spans(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
                    found = batch.column(2)[i].as_py()
                    out = [raw[begin[x["first"]] : end[x["first"] + x["n"] - 1]].decode("utf-8", "surrogatepass") for x in found]
                    numbers = [pa.array([x[c] for x in found], pa.int64()) for c in ("shard", "slot", "place", "n")]
                    yield pa.RecordBatch.from_arrays([*numbers[:3], pa.concat_arrays([batch.column(0).slice(i, 1)] * len(found)), numbers[3], pa.array(out, pa.string())], names=["shard", "slot", "place", "doc_id", "n", "text"])

        return both.select("p.doc_id", "b.text", "p.pieces").mapInArrow(cut, f"shard long, slot long, place long, doc_id {kind}, n long, text string")


def mix(docs: DataFrame, *, cycle: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, length: int = BLOCK_WORDS, seed: int = 7, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> Mixture:
    """The mixture of all rows of docs.

    Null and empty texts have no words, null sources are one source, the last; null ids and repeated rows are
    documents of their own; an empty table gives an empty mixture; other columns are not read. A source's target
    is met to the word (rounded), whatever the size; no document is taken more than ceil(most) times.
    """
    spark = docs.sparkSession
    rows = sized(docs, doc_id=doc_id, source=source, text=text)
    chunks = 1 + rows.count() // CHUNK_ROWS
    aims = targets(rows, cycle, share, most)
    sources = shared.saved(aims.mapInPandas(_slot_counts(seed, length), "source string, rank int, source_size long, target double, quota long, blocks long, last long, slots long, cut long").coalesce(1), "sources")
    # words before a document in its source: those of earlier chunks and of earlier rows of its chunk
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(chunks)))
    order = Window.partitionBy("source", "chunk").orderBy("doc_id", "text_hash", "size")
    rows = rows.withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    totals = rows.groupBy("source", "chunk").agg(F.sum("size").alias("total"))
    begins = totals.withColumn("begin", F.sum("total").over(Window.partitionBy("source").orderBy("chunk")) - F.col("total"))
    begins = begins.join(sources.select("rank", "source_size", "target", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s"))).drop("s", "total")
    placed = rows.alias("r").join(begins.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.chunk") == F.col("b.chunk")))
    placed = shared.saved(placed.select("r.doc_id", "r.text_hash", "b.rank", (F.col("b.begin") + F.col("r.before")).alias("start"), "r.size", "b.source_size", "b.target"), "placed")

    seen = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("slots"), F.count("*").alias("n")).first()
    width = max(SHARD_SLOTS, SLOTS_A_SOURCE * seen.n)
    shards = -(-seen.slots // width)
    slots = spark.range(0, shards, 1, 1 + shards // 256).mapInArrow(_slots(sources.saved_path, width, seed, length), "shard long, slot long, rank long, block long, take long")
    pieces = placed.where("size > 0").select("*", F.explode(F.expr(f"sequence(start div {length}, (start + size - 1) div {length})")).alias("block"))
    head = F.greatest(F.col("start"), F.col("block") * length)
    tail = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * length)
    pieces = pieces.select(F.col("rank").cast("long").alias("rank"), "block", "doc_id", "text_hash", "start", (head - F.col("block") * length).alias("place"), (head - F.col("start")).alias("first"), (tail - head).alias("words"))
    # Spark takes the slots for as small as the range of shards that they are made of: no side may be broadcast
    spans = pieces.join(slots.hint("merge"), ["rank", "block"]).where("place < take").withColumn("n", F.least("words", F.col("take") - F.col("place")))
    return Mixture(placed, spans.select("shard", "slot", "rank", "block", "place", "doc_id", "text_hash", "start", "first", "n"))


def op12_mixing(spark, sf_dir: str) -> DataFrame:
    docs = shared.read_texts(spark, f"{sf_dir}/documents.parquet", "doc_id", "source", "text")
    mixture = mix(docs)
    taken = mixture.spans.groupBy(F.col("rank").alias("k"), F.col("start").alias("s")).agg(F.sum("n").alias("taken"))
    rows = mixture.docs
    both = rows.join(taken, (F.col("rank") == F.col("k")) & (F.when(F.col("size") > 0, F.col("start")) == F.col("s")), "left")
    return both.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
