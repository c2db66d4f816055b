"""Ranked lexical search: an inverted index in shards, searched by MaxScore.

Every task turns its own rows into shards of bounded size (no shuffle): for each term of a shard its postings
(document, occurrences) and, for its upper bound, the most occurrences and the shortest document. A search
reads each shard once and keeps, for each query, the best documents so far over all shards of its task; the
score of the last of them is the threshold that prunes the next shards.

Scores are integers. A document's m is 10 + (90 * n * N) div L; a term of weight w adds
w * ((10^9 * tf) div (1000 * tf + 8 * m)), which grows with tf and falls with n, so that the most occurrences
with the shortest document bound it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomery.llm import shared, words

#: A shard is closed once it has so many bytes of text or documents; a text is never divided.
SHARD_BYTES, SHARD_DOCS = 8 << 20, 1 << 16
#: Bytes of query terms that are held in a worker at once; more queries are more passes over the index.
BLOCK_BYTES = 4 << 20
#: Stands for a null doc_id, which is last among equal scores.
NO_ID = np.iinfo(np.int64).max

_INDEX = "n_docs long, n_words long, doc_ids binary, lengths binary, terms binary, term_ends binary, ends binary, places binary, counts binary, top_counts binary, least_lengths binary"


def build_index(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all rows, saved in the shared folder: one row a shard.

    Null and empty texts have no terms and are not counted; repeated rows are documents of their own; a null
    doc_id is found like any other. Other columns are not read.
    """
    shared.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return shared.saved(rows.mapInArrow(_index, _INDEX), "lexical-index", "zstd")


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _Shard()
    for batch in batches:
        ids = pc.fill_null(batch.column(0), NO_ID).to_numpy(zero_copy_only=False)
        for part in words.word_slices(batch.column(1)):
            if part.first > held.last_row and held.full():
                yield held.row()
                held = _Shard()
            held.add(ids, part)
        held.last_row = -1  # rows of the next batch count from 0
    if held.ids:
        yield held.row()


class _Shard:
    """Rows gathered until they are a shard."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.last_row = 0, -1

    def full(self) -> bool:
        return self.size >= SHARD_BYTES or len(self.ids) >= SHARD_DOCS

    def add(self, ids: np.ndarray, part: words.Slice) -> None:
        lengths = part.lengths
        rows, codes, counts = part.pairs()
        where = np.full(len(lengths), -1, dtype=np.int64)
        for i in np.flatnonzero(lengths):
            if part.first + int(i) == self.last_row:  # a long text goes on
                self.lengths[-1] += int(lengths[i])
            else:
                self.ids.append(int(ids[part.first + i]))
                self.lengths.append(int(lengths[i]))
                self.last_row = part.first + int(i)
            where[i] = len(self.ids) - 1
        self.parts.append((part.distinct, codes, where[rows], counts))
        self.size += int(lengths.sum()) * 6

    def row(self) -> pa.RecordBatch:
        terms = pa.concat_arrays([p[0] for p in self.parts]).dictionary_encode()
        known, n = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(self.ids)
        before = np.cumsum([0] + [len(p[0]) for p in self.parts])
        keys = np.concatenate([known[b + p[1]] * n + p[2] for b, p in zip(before, self.parts, strict=False)])
        counts = np.concatenate([p[3] for p in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, counts = keys[heads], np.add.reduceat(counts, heads)
        places, lengths = keys % n, np.array(self.lengths, dtype=np.int64)
        ends = np.searchsorted(keys // n, np.arange(len(terms.dictionary)), side="right")
        starts = np.append(0, ends[:-1])
        raw, spots = words.binary_parts(terms.dictionary)
        row = {
            "n_docs": n,
            "n_words": int(lengths.sum()),
            "doc_ids": np.array(self.ids, dtype=np.int64).tobytes(),
            "lengths": lengths.tobytes(),
            "terms": raw[: spots[-1]].tobytes(),
            "term_ends": spots.astype(np.int32).tobytes(),
            "ends": ends.astype(np.int32).tobytes(),
            "places": places.astype(np.uint16 if n <= 1 << 16 else np.uint32).tobytes(),
            "counts": counts.astype(np.int32).tobytes(),
            "top_counts": np.maximum.reduceat(counts, starts).astype(np.int64).tobytes(),
            "least_lengths": np.minimum.reduceat(lengths[places], starts).tobytes(),
        }
        kinds = {k: pa.int64() if k.startswith("n_") else pa.binary() for k in row}
        return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for k, v in row.items()], names=list(row))


def _places_of(wanted: pa.Array, batch: pa.RecordBatch, i: int) -> np.ndarray:
    """Where the terms of shard i have each wanted term, or -1."""
    spots, data = batch.column("term_ends")[i].as_buffer(), batch.column("terms")[i].as_buffer()
    terms = pa.Array.from_buffers(pa.binary(), spots.size // 4 - 1, [None, spots, data])
    return pc.fill_null(pc.index_in(wanted, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _frequencies(vocabulary):
    """Document counts of the query terms, summed up in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(vocabulary.value, pa.binary())
        total = np.zeros(len(wanted), dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                at = _places_of(wanted, batch, i)
                ends = np.frombuffer(batch.column("ends")[i].as_buffer(), dtype=np.int32)
                total[at >= 0] += np.diff(ends, prepend=0)[at[at >= 0]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "df"])

    return run


class _Postings:
    """One shard as a search of a block of queries sees it; impacts of a term are computed when first asked for."""

    def __init__(self, batch: pa.RecordBatch, i: int, wanted: pa.Array, weights: np.ndarray, n_docs: int, n_words: int) -> None:
        read = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), dtype=kind)
        self.at, self.weights = _places_of(wanted, batch, i), weights
        self.ids, lengths = read("doc_ids", np.int64), read("lengths", np.int64)
        self.m = 10 + (90 * lengths * n_docs) // n_words
        self.ends, self.counts = read("ends", np.int32), read("counts", np.int32)
        self.places = read("places", np.uint16 if len(self.ids) <= 1 << 16 else np.uint32)
        there, top, least = self.at[self.at >= 0], read("top_counts", np.int64), read("least_lengths", np.int64)
        self.bounds = np.zeros(len(self.at), dtype=np.int64)
        self.bounds[self.at >= 0] = weights[self.at >= 0] * ((1_000_000_000 * top[there]) // (1000 * top[there] + 8 * (10 + (90 * least[there] * n_docs) // n_words)))
        self.ready: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def list(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, impacts) of a term."""
        found = self.ready.get(term)
        if found is None:
            k = self.at[term]
            a, b = (self.ends[k - 1] if k else 0), self.ends[k]
            places, tf = self.places[a:b].astype(np.int64), self.counts[a:b].astype(np.int64)
            found = self.ready[term] = places, self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * self.m[places]))
        return found


def max_score(shard: _Postings, terms: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of all documents of a shard that may be among the k best, given that k documents elsewhere
    already score at least `least`; scores are whole.

    Terms go by upper bound, largest first. While the bounds of the terms from here on reach the threshold, a
    document of these terms alone could qualify: they are essential, and their lists are read whole. Then only
    documents met so far are probed, as long as what they have and the bounds of the rest reach the threshold.
    """
    terms = terms[shard.bounds[terms] > 0]
    terms = terms[np.argsort(-shard.bounds[terms], kind="stable")]
    rest = np.append(np.cumsum(shard.bounds[terms][::-1])[::-1], 0)
    held, done = np.zeros(len(shard.ids), dtype=np.int64), 0
    while done < len(terms) and rest[done] >= least:
        places, impacts = shard.list(int(terms[done]))
        held[places] += impacts
        done += 1
        if len(held) > k and rest[done] < held.max():  # so many documents have at least this already
            least = max(least, int(np.partition(held, len(held) - k)[len(held) - k]))
    at = np.flatnonzero((held > 0) & (held + rest[done] >= least))
    scores = held[at]
    for j in range(done, len(terms)):
        if not len(at):
            break
        places, impacts = shard.list(int(terms[j]))
        spots = np.minimum(np.searchsorted(places, at), len(places) - 1)
        scores = scores + np.where(places[spots] == at, impacts[spots], 0)
        may = scores + rest[j + 1] >= least
        at, scores = at[may], scores[may]
    return at, scores


class _Search:
    """The k best documents of every query of a block over all shards of a task."""

    def __init__(self, block, weights: np.ndarray, n_docs: int, n_words: int, k: int, kind: pa.DataType) -> None:
        self.block, self.weights, self.n_docs, self.n_words, self.k, self.kind = block, weights, n_docs, n_words, k, kind

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, items, codes, bounds = self.block.value
        wanted, none = pa.array(vocabulary, pa.binary()), np.zeros(0, dtype=np.int64)
        best = [(none, none)] * len(items)
        for batch in batches:
            for i in range(batch.num_rows):
                shard = _Postings(batch, i, wanted, self.weights, self.n_docs, self.n_words)
                for q in range(len(items)):
                    terms = codes[bounds[q] : bounds[q + 1]]
                    ids, scores = best[q]
                    at, more = max_score(shard, terms[shard.at[terms] >= 0], int(scores[-1]) if len(ids) == self.k else 1, self.k)
                    if len(at):
                        ids, scores = np.concatenate([ids, shard.ids[at]]), np.concatenate([scores, more])
                        order = np.lexsort((ids, -scores))[: self.k]
                        best[q] = ids[order], scores[order]
        for lo in range(0, len(items), 1024):
            some = range(lo, min(lo + 1024, len(items)))
            ids = np.concatenate([best[q][0] for q in some])
            out = [pa.array([items[q] for q in some for _ in best[q][0]], self.kind), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(np.concatenate([best[q][1] for q in some]))]
            yield pa.RecordBatch.from_arrays(out, names=["item_id", "doc_id", "score"])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.word_slices(batch.column(1)):
            rows, codes, _ = part.pairs()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows + part.first)), part.distinct.take(pa.array(codes))], names=["item_id", "term"])


def search(index: DataFrame, items: DataFrame, *, item_id: str = "item_id", text: str = "text", k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item with a score above 0, equal scores by doc_id.

    Rows of one item_id (null is one too) are one item with the terms of all of them; null texts have none; an
    item without a term that some document has gets no row. Terms of all items are held in blocks of about
    BLOCK_BYTES; each block reads the index once.
    """
    spark = index.sparkSession
    field = items.schema[item_id]
    pairs = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(_item_terms, f"item_id {field.dataType.simpleString()}, term binary").distinct()
    pairs = shared.saved(pairs, "query-terms")
    sums = index.agg(F.sum("n_docs").alias("n"), F.sum("n_words").alias("l")).first()
    n = 1 + (pairs.agg(F.sum(F.octet_length("term") + 16).alias("b")).first().b or 0) // BLOCK_BYTES
    found = None
    for block in range(n if sums.n else 0):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == block).groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")).orderBy("item_id").collect()
        if not own:
            continue
        vocabulary = sorted({bytes(t) for r in own for t in r.terms})
        code = {t: i for i, t in enumerate(vocabulary)}
        codes = np.array([code[bytes(t)] for r in own for t in r.terms], dtype=np.int64)
        frequencies = index.select("terms", "term_ends", "ends").mapInArrow(_frequencies(spark.sparkContext.broadcast(vocabulary)), "term int, df long")
        df = {r.term: r.df for r in frequencies.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # at most the terms of a block
        weights = np.array([math.floor(1000 * math.log((2 * sums.n + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))], dtype=np.int64)
        held = spark.sparkContext.broadcast((vocabulary, [r.item_id for r in own], codes, np.cumsum([0] + [len(r.terms) for r in own])))
        best = index.mapInArrow(_Search(held, weights, sums.n, sums.l, k, to_arrow_type(field.dataType)), f"item_id {field.dataType.simpleString()}, doc_id long, score long")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], f"item_id {field.dataType.simpleString()}, rank int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    docs = shared.read_texts(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")
    return search(build_index(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Every document scored for every item.
OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), g AS (SELECT count(*) AS n, sum(len(w)) AS l FROM d WHERE len(w) > 0),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY 1, 2),
f AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT n FROM g) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
m AS (SELECT r, doc_id, CAST(10 + (90 * len(w) * (SELECT n FROM g)) // (SELECT l FROM g) AS BIGINT) AS m FROM d WHERE len(w) > 0),
s AS (SELECT q.item_id, m.r, m.doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY 1, 2, 3),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
