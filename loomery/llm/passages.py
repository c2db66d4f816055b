"""Passages of more than 50 words that occur twice or more, wherever they lie in their texts.

Every run of 51 words holds 27 windows of 25 words; the one of the smallest hash is its
anchor, and equal runs have equal anchors. So anchors that occur once rule out nearly all
runs, and only the runs of repeated anchors are compared whole, at every offset. No passage
is missed, whatever line breaks and other words are around it. Equal texts are compared once,
and what repeats within a text is found there; only what is left is shuffled by its hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm import shared
from loomery.llm.arrays import _INVERSE, _MULTIPLIER, LOWER_TABLE, SpanHasher, _powers, mix, row_slices, text_buffers, word_spans
from loomery.llm.components import components

RUN, WINDOW = 51, 25
_WIDTH = RUN - WINDOW + 1
_HASHED_WORDS = 1 << 16


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over every width consecutive values."""
    out, held = x, 1
    while 2 * held <= width:
        out, held = op(out[:-held], out[held:]), 2 * held
    n = len(x) - width + 1
    return out[:n] if held == width else op(out[:n], out[width - held : width - held + n])


class Runs:
    """Words, anchors and runs of the texts of one slice."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, hasher: SpanHasher) -> None:
        self.raw, self.offsets = raw, offsets
        self.begin, self.stop = word_spans(raw, offsets)
        self.cuts = np.searchsorted(self.begin, offsets)
        n = len(self.begin)
        hashes = []
        for a in range(0, n, _HASHED_WORDS):
            lo, hi = self.begin[a : a + _HASHED_WORDS], self.stop[a : a + _HASHED_WORDS]
            hashes.append(hasher(LOWER_TABLE[raw[lo[0] : hi[-1]]], lo - lo[0], hi - lo[0]))
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        self.up, self.down = _powers(_MULTIPLIER, n + 1), _powers(_INVERSE, n + 1)
        if n < RUN:
            self.valid, self.low = np.zeros(0, dtype=bool), np.zeros(0, dtype=np.uint64)
            self.grams = self.low
            return
        ends = np.repeat(self.cuts[1:], np.diff(self.cuts))
        self.valid = np.arange(n - RUN + 1) + RUN <= ends[: n - RUN + 1]
        self.grams = np.maximum(self.spans(WINDOW, 1), np.uint64(1))
        self.low = sliding(self.grams, _WIDTH, np.minimum)

    def spans(self, k: int, seed: int) -> np.ndarray:
        """Hashes of every k consecutive words."""
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(self.words + np.uint64(seed)) * self.up[: len(self.words)], dtype=np.uint64)))
        return mix((sums[k:] - sums[:-k]) * self.down[: len(self.words) - k + 1])

    def anchors(self) -> np.ndarray:
        """Word positions of the anchors of all runs."""
        if not self.valid.any():
            return np.zeros(0, dtype=np.int64)
        edge = np.zeros(_WIDTH - 1, dtype=np.uint64)
        top = sliding(np.concatenate((edge, np.where(self.valid, self.low, np.uint64(0)), edge)), _WIDTH, np.maximum)
        return np.flatnonzero((top == self.grams) & (top > 0))


def _slices(column: pa.Array, hasher: SpanHasher) -> Iterator[tuple[int, Runs]]:
    offsets, raw = text_buffers(column)
    for lo, hi in row_slices(offsets):
        a, b = int(offsets[lo]), int(offsets[hi])
        yield lo, Runs(raw[a:b], offsets[lo : hi + 1] - a, hasher)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _points(runs: Runs) -> np.ndarray:
    """Code points before every byte."""
    return np.concatenate(([0], np.cumsum((runs.raw & 0xC0) != 0x80, dtype=np.int64)))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct anchors of every text and how often each is in it; a row without anchor has the words of
    a text of at least RUN, and where the first begins and the last ends."""
    hasher = SpanHasher(seed=31)
    for batch in batches:
        for lo, runs in _slices(batch.column(2), hasher):
            at = runs.anchors()
            row = np.searchsorted(runs.cuts, at, side="right") - 1
            order = np.lexsort((runs.grams[at], row))
            row, gram = row[order], runs.grams[at][order]
            new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]))) if len(row) else np.zeros(0, dtype=np.int64)
            times = np.diff(np.append(new, len(row)))
            whole = np.flatnonzero(np.diff(runs.cuts) >= RUN)
            points = _points(runs)
            first, last = runs.begin[runs.cuts[whole]], runs.stop[runs.cuts[whole + 1] - 1]
            base = points[runs.offsets[whole]]
            take = pa.array(lo + np.concatenate((row[new], whole)))
            n, m = len(new), len(whole)
            pad = lambda x, left: pa.array(np.concatenate((np.zeros(left, dtype=np.int64), x)), mask=np.arange(left + len(x)) < left)
            anchor = pa.array(np.concatenate((gram[new].view(np.int64), np.zeros(m, dtype=np.int64))), mask=np.arange(n + m) >= n)
            words = pa.array(np.concatenate((times, np.diff(runs.cuts)[whole])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), anchor, words, pad(points[first] - base, n), pad(points[last] - base, n)], names=["doc_id", "text_hash", "anchor", "times", "start", "end"])


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of known anchors: at (word), last, start and end (code points), and either h1 and h2, for the first
    of its kind in the text, with again if others follow, or own: the word at which the first begins.
    Runs that follow each other and repeat the same stretch are one row, up to the last."""
    hasher = SpanHasher(seed=31)
    names = ["doc_id", "text_hash", "at", "last", "start", "end", "h1", "h2", "again", "own"]
    for batch in batches:
        for lo, runs in _slices(batch.column(2), hasher):
            one, two = (runs.spans(RUN, 2), runs.spans(RUN, 3)) if len(runs.low) else (runs.low, runs.low)
            points = _points(runs)
            for i in range(len(runs.cuts) - 1):
                a, b = int(runs.cuts[i]), int(runs.cuts[i + 1]) - RUN + 1
                if b <= a:
                    continue
                known = np.array(batch.column(3)[lo + i].values, dtype=np.int64).view(np.uint64)
                at = a + np.flatnonzero(np.isin(runs.low[a:b], known))
                if not len(at):
                    continue
                _, first, kind, count = np.unique(one[at], return_index=True, return_inverse=True, return_counts=True)
                leads = first[kind]
                new = leads == np.arange(len(at))
                ref = at[leads]
                # a row begins at every first run, and where what repeats does not go on nearby
                starts = new | np.append(True, new[:-1] | (np.diff(at) != 1) | (np.abs(np.diff(ref)) > RUN))
                head = np.flatnonzero(starts)
                tail = np.append(head[1:], len(at)) - 1
                fresh = new[head]
                base = points[runs.offsets[i]]
                take = pa.array(np.full(len(head), lo + i))
                columns = [pa.array(at[head] - a), pa.array(at[tail] - a), pa.array(points[runs.begin[at[head]]] - base), pa.array(points[runs.stop[at[tail] + RUN - 1]] - base)]
                hashes = [pa.array(h[at[head]].view(np.int64), mask=~fresh) for h in (one, two)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *columns, *hashes, pa.array((count[kind] > 1)[head], mask=~fresh), pa.array(ref[head] - a, mask=fresh)], names=names)


def repeated_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each maximal span of repeated runs of 51 words: doc_id, text_hash, start, end
    (code points), cluster_doc_id and cluster_start (the first span of its component) and removed.

    Words are those of the near-duplicate operators and may lie on several lines. A run's first
    place by (doc_id, text_hash, position) is kept, the others are removed; spans of kept runs and
    of removed ones are rows of their own. What is removed is kept at an earlier place, also
    within a document. Documents of equal text are one span each, from the first word to the last;
    only the one with the smallest doc_id is kept, and its passages are compared with other texts.
    Rows repeated with their doc_id are alike and one row here; null doc_ids come first.
    """
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    shared.bound_batches(spark)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("text")).where(F.length("text") >= 2 * RUN - 1)
    found = shared.saved(rows.mapInArrow(_anchor_rows, f"doc_id {kind}, text_hash long, anchor long, times long, start long, end long"), "anchors")
    whole = shared.saved(found.where("anchor is null").select("doc_id", "text_hash", "start", "end"), "whole-texts")
    firsts = whole.groupBy("text_hash").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("there"), "doc_id")).alias("f")).select("text_hash", F.col("f.doc_id").alias("doc_id"))
    firsts = shared.saved(firsts, "texts")
    anchors = found.where("anchor is not null").select("text_hash", "anchor", "times")
    # of equal texts, the anchors count once
    ends = anchors.groupBy("anchor").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi"), F.max("times").alias("times"))
    repeated = shared.saved(ends.where("lo <> hi or times > 1").select("anchor"), "repeated-anchors")
    known = anchors.join(repeated, "anchor").groupBy("text_hash").agg(F.collect_set("anchor").alias("known")).join(firsts, "text_hash")
    known = shared.saved(known.select(F.col("text_hash").alias("kh"), F.col("doc_id").alias("kd"), "known"), "known")
    shared.release(spark, repeated, found, firsts)
    held = rows.join(known, (F.col("text_hash") == F.col("kh")) & F.col("doc_id").eqNullSafe(F.col("kd"))).select("doc_id", "text_hash", "text", "known")
    runs = shared.saved(held.mapInArrow(_run_rows, f"doc_id {kind}, text_hash long, at long, last long, start long, end long, h1 long, h2 long, again boolean, own long"), "runs")
    shared.release(spark, known)
    place = F.struct("doc_id", "text_hash", "at")
    fresh = runs.where("own is null").select("doc_id", "text_hash", "at", "start", "end", "h1", "h2", "again")
    leads = fresh.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("other"), F.max("again").alias("again"))
    leads = shared.saved(leads.where("again or not (first <=> other)").select("h1", "h2", "first"), "first-runs")
    shared.release(spark)
    far = fresh.join(leads, ["h1", "h2"]).select("doc_id", "text_hash", "at", F.col("at").alias("last"), "start", "end", "first", (~place.eqNullSafe(F.col("first"))).alias("removed"))
    far = shared.saved(far, "far-runs")
    near = runs.where("own is not null").select("doc_id", "text_hash", "at", "last", "start", "end", F.struct("doc_id", "text_hash", F.col("own").alias("at")).alias("first"), F.lit(True).alias("removed"))
    near = shared.saved(near, "near-runs")
    shared.release(spark, runs, leads)

    # runs of one removal that follow each other, word by word, in their text and at the first place
    order = Window.partitionBy("doc_id", "text_hash", "removed").orderBy("at")
    same = [F.col("first.doc_id").eqNullSafe(F.lag("first.doc_id").over(order)), F.col("first.text_hash") == F.lag("first.text_hash").over(order)]
    steady = same[0] & same[1] & (F.col("first.at") - F.col("at") == F.lag(F.col("first.at") - F.col("at")).over(order)) & (F.col("at") - F.lag("last").over(order) <= 1)
    numbered = far.unionByName(near).withColumn("new", F.when(steady, 0).otherwise(1)).withColumn("chain", F.sum("new").over(order))
    chains = numbered.groupBy("doc_id", "text_hash", "removed", "chain").agg(F.min("at").alias("at"), F.max("last").alias("last"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("first").alias("first"))
    joined = F.when(F.col("at") <= F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)) + RUN, 0).otherwise(1)
    chains = shared.saved(chains.withColumn("new", joined).withColumn("span", F.sum("new").over(order)).drop("new"), "chains")
    shared.release(spark, far, near)
    spans = chains.groupBy("doc_id", "text_hash", "removed", "span").agg(F.min("at").alias("at"), F.max("last").alias("last"), F.min("start").alias("start"), F.max("end").alias("end"))
    spans = shared.saved(spans.withColumn("sid", F.monotonically_increasing_id()), "spans")
    keys = ["doc_id", "text_hash", "removed", "span"]
    later = chains.where("removed").alias("c").join(spans.alias("s"), F.expr(" and ".join(f"c.{k} <=> s.{k}" for k in keys))).select(F.col("s.sid").alias("a"), F.col("c.first").alias("place"))
    heads = spans.where("not removed").select(F.col("sid").alias("b"), F.struct("doc_id", "text_hash").alias("own"), F.col("at").alias("lo"), F.col("last").alias("hi"))
    # a first place within a text may itself be removed; then the two spans of that text are tied
    edges = later.join(heads, F.expr("place.doc_id <=> own.doc_id and place.text_hash = own.text_hash and place.at between lo and hi")).select("a", "b")
    inner = spans.where("removed").select(F.col("sid").alias("b"), F.struct("doc_id", "text_hash").alias("own"), F.col("at").alias("lo"), F.col("last").alias("hi"))
    ties = later.join(inner, F.expr("place.doc_id <=> own.doc_id and place.text_hash = own.text_hash and place.at between lo and hi")).select("a", "b")
    links = components(edges.unionByName(ties.where("a <> b")).distinct())
    linked = spans.join(links.withColumnRenamed("key", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    # saved before they are joined, so that the joins can split a large component or a text with many copies
    lead = shared.saved(linked.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash", "start")).alias("head")), "heads")
    parts = linked.join(lead, "component").select("doc_id", "text_hash", "start", "end", F.col("head.doc_id").alias("cluster_doc_id"), F.col("head.start").alias("cluster_start"), "removed")

    copied = whole.groupBy("text_hash").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("lo"), F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("hi")).where("not (lo <=> hi)").select("text_hash", F.col("lo.doc_id").alias("cluster_doc_id"))
    copied = shared.saved(copied, "copied-texts")
    copies = whole.distinct().join(copied, "text_hash")
    texts = copies.select("doc_id", "text_hash", "start", "end", "cluster_doc_id", F.col("start").alias("cluster_start"), (~F.col("doc_id").eqNullSafe(F.col("cluster_doc_id"))).alias("removed"))
    return parts.unionByName(texts)
