"""MinHash banding, sequential Bayesian pruning and exact verification of word-shingle sets.

A unit is one text (a document or a paragraph). Units with equal shingle sets form a class
that is handled once. Classes that share a band hash are a bucket; instead of all pairs of a
bucket, each member is first compared with the bucket's smallest member, and only members
that are still in different components afterwards are compared further. What is returned are
components, and for these that loses nothing: a pair inside one component adds no link.
One pass over the texts makes sets, band hashes and sketches; afterwards only texts that
share a bucket with another one are shuffled, once, and pairs are looked up among them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm import shared
from loomery.llm.arrays import SpanHasher, mix, row_slices, shingles, text_buffers, word_hashes
from loomery.llm.components import components

STAR_ROUNDS = 2
#: Buckets up to this size are joined with themselves; the members of larger ones are compared block by block.
SMALL_BUCKET = 32
#: Members of a block whose sketches alone are compared, and members and bytes of text of a block compared on full sets; a
#: task holds two of them.
SKETCH_BLOCK, BLOCK, BLOCK_BYTES = 8192, 1024, 4 << 20
#: Candidate pairs that the prior of their similarity is fitted to.
PRIOR_PAIRS = 4096
_CHUNK = 1 << 15


@dataclass(frozen=True)
class Plan:
    """percent: similarity in whole hundredths at which two sets are linked. miss: the chance at
    most that a pair at just that similarity, compared once, is lost by banding and pruning together.
    rows hashes make a band; the number of bands follows from three quarters of miss, the
    cut-offs of the pruning from the rest, shared by the batches."""

    words: int = 5
    percent: int = 80
    rows: int = 4
    miss: float = 1e-6
    batch: int = 32
    batches: int = 5

    @property
    def bands(self) -> int:
        return math.ceil(math.log(0.75 * self.miss) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def hashes(self) -> int:
        return max(self.bands * self.rows, self.batch * self.batches)


#: A Beta distribution of the similarity of candidate pairs; this one knows nothing.
UNIFORM = (1.0, 1.0)


@cache
def _posteriors(plan: Plan, prior: tuple[float, float]) -> list[np.ndarray]:
    """For every batch t and number m of equal bytes so far, P(similarity >= percent | m). A byte is equal if the minima
    are, or by chance (1 in 256)."""
    s = (np.arange(4000) + 0.5) / 4000
    equal = s + (1 - s) / 256
    start = (prior[0] - 1) * np.log(s) + (prior[1] - 1) * np.log1p(-s)
    out = []
    for t in range(plan.batches):
        n = (t + 1) * plan.batch
        m = np.arange(n + 1)[:, None]
        log = start + m * np.log(equal) + (n - m) * np.log1p(-equal)
        weight = np.exp(log - log.max(axis=1, keepdims=True))
        out.append(weight[:, s >= plan.percent / 100].sum(axis=1) / weight.sum(axis=1))
    return out


def _lost(n: int, cut: int, p: float) -> float:
    """The chance of fewer than cut equal ones among n."""
    return sum(math.comb(n, m) * p**m * (1 - p) ** (n - m) for m in range(cut))


@cache
def cutoffs(plan: Plan, prior: tuple[float, float] = UNIFORM) -> tuple[int, ...]:
    """The fewest equal bytes with which a pair stays after each batch: those from which the posterior chance of reaching
    percent is at least a bound. The bound is the largest one at which a pair at just percent is lost over all batches
    with a chance of at most a quarter of miss, whatever the prior."""
    tails, p, n = _posteriors(plan, prior), plan.percent / 100, [(t + 1) * plan.batch for t in range(plan.batches)]
    cuts = lambda bound: tuple(int(np.searchsorted(np.maximum.accumulate(x), bound)) for x in tails)
    lo, hi = -80.0, 0.0  # of the bound's logarithm
    for _ in range(50):
        mid = (lo + hi) / 2
        if sum(map(_lost, n, cuts(math.exp(mid)), [p] * len(n))) <= 0.25 * plan.miss:
            lo = mid
        else:
            hi = mid
    return cuts(math.exp(lo))


def min_matches(n: int, plan: Plan, prior: tuple[float, float] = UNIFORM) -> int:
    """The cut-off after the batch that ends at n bytes."""
    return cutoffs(plan, prior)[n // plan.batch - 1]


def fitted_prior(matches: np.ndarray, n: int) -> tuple[float, float]:
    """The Beta distribution with the mean and variance of the pairs' similarities, as their equal bytes among n tell them;
    what the sketches themselves scatter is taken off the variance."""
    if len(matches) < 2:
        return UNIFORM
    s = np.clip((matches / n - 1 / 256) * 256 / 255, 0.001, 0.999)
    mean, spread = float(s.mean()), float(s.var() - (s * (1 - s)).mean() / n)
    size = mean * (1 - mean) / max(spread, 1e-4) - 1
    return (round(min(max(mean * size, 0.1), 100.0), 2), round(min(max((1 - mean) * size, 0.1), 100.0), 2))


def sequential_keep(left: np.ndarray, right: np.ndarray, plan: Plan, prior: tuple[float, float] = UNIFORM) -> np.ndarray:
    """Which rows survive: signatures are compared a batch at a time; a pair leaves once its posterior chance of reaching
    percent is under the bound."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), dtype=np.int32)
    for t, cut in enumerate(cutoffs(plan, prior)):
        span = slice(t * plan.batch, (t + 1) * plan.batch)
        matches[alive] += (left[alive, span] == right[alive, span]).sum(1, dtype=np.int32)
        alive = alive[matches[alive] >= cut]
    keep = np.zeros(len(left), dtype=bool)
    keep[alive] = True
    return keep


def text_sets(column: pa.Array, k: int, hasher: SpanHasher) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) for slices of a text column."""
    offsets, raw = text_buffers(column)
    for lo, hi in row_slices(offsets):
        a, b = int(offsets[lo]), int(offsets[hi])
        words, cuts = word_hashes(raw[a:b], offsets[lo : hi + 1] - a, hasher)
        edges = cuts.tolist()
        yield lo, [np.unique(shingles(words[x:y], k)) for x, y in zip(edges[:-1], edges[1:], strict=True)]


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """(sets, n) minima of n hash functions; every set has members."""
    out = np.empty((len(sets), n), dtype=np.uint64)
    factors, lo = _multipliers(n), 0
    while lo < len(sets):
        hi, size = lo + 1, len(sets[lo])
        while hi < len(sets) and size + len(sets[hi]) <= _CHUNK:
            size, hi = size + len(sets[hi]), hi + 1
        flat = np.concatenate(sets[lo:hi])
        starts = np.concatenate(([0], np.cumsum([len(x) for x in sets[lo : hi - 1]], dtype=np.int64)))
        turned = np.empty_like(flat)
        for i in range(n):
            np.multiply(flat, factors[i], out=turned)
            out[lo:hi, i] = np.minimum.reduceat(turned, starts)
        lo = hi
    return mix(out)


def band_hashes(sig: np.ndarray, plan: Plan) -> np.ndarray:
    """(sets, bands) bucket keys."""
    rows = sig[:, : plan.bands * plan.rows].reshape(len(sig), plan.bands, plan.rows)
    h = np.broadcast_to(mix(np.arange(1, plan.bands + 1, dtype=np.uint64)), rows.shape[:2]).copy()
    for i in range(plan.rows):
        h = mix(h * np.uint64(0xA0761D6478BD642F) + rows[:, :, i])
    return h.view(np.int64)


def make_units(rows: DataFrame, text: str, plan: Plan) -> DataFrame:
    """rows with uid, n (size of the shingle set), h1 and h2 (128-bit hash of the set), buckets (band
    hashes) and sketch (low bytes of the signature; the last four are null if the set is empty), saved.

    The column holding the text is named unit_text afterwards. uid is fixed once saved.
    """
    kept = [c for c in rows.columns if c != text]
    source = rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("unit_text"))
    made = ["n", "h1", "h2", "buckets", "sketch"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields) + ", n long, h1 long, h2 long, buckets array<bigint>, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in batches:
            for lo, sets in text_sets(batch.column(batch.num_columns - 1), plan.words, hasher):
                n = np.array([len(x) for x in sets], dtype=np.int64)
                there = np.flatnonzero(n)
                h1, h2, bands, marks = ([None] * len(sets) for _ in range(4))
                if len(there):
                    sig = signatures([sets[i] for i in there], plan.hashes)
                    own, low = band_hashes(sig, plan), sig[:, : plan.batch * plan.batches].astype(np.uint8)
                    for k, i in enumerate(there.tolist()):
                        h1[i] = int(mix(sets[i]).sum().view(np.int64))
                        h2[i] = int(mix(sets[i] ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64))
                        bands[i], marks[i] = own[k], low[k].tobytes()
                columns = [pa.array(n), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, len(sets)).columns, *columns], names=[*batch.schema.names, *made])

    shared.bound_batches(rows.sparkSession)
    return shared.saved(source.mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id()), "units", compression="zstd")


def _candidates(frame: pd.DataFrame, plan: Plan, prior: tuple[float, float]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, rows, roots) for every row of part i: rows of part j of other components that sizes and sketches do not rule
    out. The caller may join roots meanwhile."""
    marks = np.frombuffer(b"".join(frame["sketch"]), dtype=np.uint8).reshape(len(frame), -1)
    parts, sizes = frame["part"].to_numpy(), frame["n"].to_numpy()
    roots = np.unique(frame["component"].to_numpy(), return_inverse=True)[1]
    left, right = np.flatnonzero(parts == frame["i"].iloc[0]), np.flatnonzero(parts == frame["j"].iloc[0])
    for x in left:
        there = right[(roots[right] != roots[x]) & ((parts[right] != parts[x]) | (right > x))]
        there = there[100 * np.minimum(sizes[there], sizes[x]) >= plan.percent * np.maximum(sizes[there], sizes[x])]
        if len(there):
            there = there[sequential_keep(np.broadcast_to(marks[x], (len(there), marks.shape[1])), marks[there], plan, prior)]
        if len(there):
            yield x, there, roots


def sketch_forest(frame: pd.DataFrame, plan: Plan, prior: tuple[float, float]) -> pd.DataFrame:
    """Pairs of one or two blocks that their sketches do not rule out, fewer than there are members: each joins two components
    if those before it do."""
    keys, found = frame["key"].to_numpy(), []
    for x, there, roots in _candidates(frame, plan, prior):
        for y in there:
            if roots[y] != roots[x]:
                found.append((min(keys[x], keys[y]), max(keys[x], keys[y])))
                roots[roots == roots[y]] = roots[x]
    return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64).assign(group=frame["group"].iloc[0])


def compare_blocks(frame: pd.DataFrame, plan: Plan, prior: tuple[float, float]) -> pd.DataFrame:
    """Links between the components of one or two blocks with texts; each link joins two that were apart."""
    keys, hasher, sets, found = frame["key"].to_numpy(), SpanHasher(), {}, []

    def own(x: int) -> np.ndarray:
        if x not in sets:
            sets[x] = next(text_sets(pa.array([frame["unit_text"].iloc[x]], pa.large_string()), plan.words, hasher))[1][0]
        return sets[x]

    for x, there, roots in _candidates(frame, plan, prior):
        for y in there:
            if roots[y] != roots[x]:
                common = len(np.intersect1d(own(x), own(y), assume_unique=True))
                if 100 * common >= plan.percent * (len(own(x)) + len(own(y)) - common):
                    found.append((keys[x], keys[y]))
                    roots[roots == roots[y]] = roots[x]
    return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)


class NearComponents:
    """Finds the components of similar classes among saved units."""

    def __init__(self, units: DataFrame, order: list[str], plan: Plan) -> None:
        self.plan, self.units, self.spark = plan, units, units.sparkSession
        first = F.min(F.struct(*order)).alias("first")
        self.classes = shared.saved(units.where("n > 0").groupBy("h1", "h2").agg(F.min("uid").alias("cid"), first, F.count("*").alias("copies")), "classes")

    def run(self) -> DataFrame:
        """(key, component) of the classes that are linked with another one."""
        reps = self.units.select(F.col("uid").alias("key"), "buckets").join(self.classes.select(F.col("cid").alias("key")), "key", "left_semi")
        rows = reps.select(F.explode("buckets").alias("bucket"), "key")
        # sums of a bucket are saved before they are joined, so that the join can split a hot bucket
        leads = shared.saved(rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("key").alias("lead")).where("size > 1"), "leads")
        buckets = shared.saved(rows.join(leads, "bucket"), "buckets")
        shared.release(self.spark, leads)
        # the only shuffle of whole texts: those that some other class shares a bucket with
        texts = self.units.select(F.col("uid").alias("key"), "n", "sketch", "unit_text")
        self.held = shared.saved(texts.join(buckets.select("key").distinct(), "key"), "candidates", compression="zstd")
        shared.release(self.spark)
        stars = shared.saved(buckets.where("key <> lead").groupBy("key").agg(F.min("lead").alias("lead")).select(F.col("lead").alias("a"), F.col("key").alias("b")), "stars")
        self.prior = self.fit_prior(stars)
        tried = self.verify(stars)
        for _ in range(STAR_ROUNDS - 1):
            open_rows = self.unsettled(buckets, tried)
            leads = shared.saved(open_rows.groupBy("bucket").agg(F.min(F.struct("component", "key")).alias("lead")), "leads")
            pairs = open_rows.join(leads, "bucket").where("component <> lead.component").select(F.col("lead.key").alias("x"), "key")
            pairs = pairs.select(F.least("x", "key").alias("a"), F.greatest("x", "key").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
            one = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
            more = self.verify(one)
            both = shared.saved(tried.unionByName(more), "tried")
            shared.release(self.spark, tried, more, open_rows, leads)
            tried = both
        open_rows = self.unsettled(buckets, tried)
        rest = self.verify(self.small_pairs(open_rows).join(tried.select("a", "b"), ["a", "b"], "left_anti"))
        large = self.large_links(open_rows)
        links = tried.where("linked").select("a", "b").unionByName(rest.where("linked").select("a", "b")).unionByName(large)
        found = components(links)
        shared.release(self.spark, tried, rest, large, open_rows, buckets, self.held)
        return found

    def fit_prior(self, pairs: DataFrame) -> tuple[float, float]:
        """The prior of the similarity of candidate pairs, from the PRIOR_PAIRS of smallest hash."""
        n = self.plan.batch * self.plan.batches
        some = pairs.orderBy(F.xxhash64("a", "b"), "a", "b").limit(PRIOR_PAIRS)
        marks = lambda key, name: self.held.select(F.col("key").alias(key), F.col("sketch").alias(name))
        both = some.join(marks("a", "sa"), "a").join(marks("b", "sb"), "b").select("sa", "sb").collect()
        return fitted_prior(np.array([np.count_nonzero(np.frombuffer(r.sa, dtype=np.uint8) == np.frombuffer(r.sb, dtype=np.uint8)) for r in both]), n)

    def unsettled(self, buckets: DataFrame, tried: DataFrame) -> DataFrame:
        """Rows of the buckets whose members are in several components so far."""
        found = components(tried.where("linked").select("a", "b"))
        rows = buckets.select("bucket", "key").join(found, "key", "left").select("bucket", "key", F.coalesce("component", "key").alias("component"))
        mixed = rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
        mixed = shared.saved(mixed.select("bucket", "size"), "mixed")
        out = shared.saved(rows.join(mixed, "bucket"), "unsettled")
        shared.release(self.spark, mixed)
        return out

    def small_pairs(self, rows: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) of keys that share a small bucket and are in different components."""
        small = rows.where(F.col("size") <= SMALL_BUCKET).select("bucket", "key", "component")
        other = small.select("bucket", F.col("key").alias("other"), F.col("component").alias("other_component"))
        return small.join(other, "bucket").where("key < other and component <> other_component").select(F.col("key").alias("a"), F.col("other").alias("b")).distinct()

    def large_links(self, rows: DataFrame) -> DataFrame:
        """Links (a, b) between different components among members of large buckets, saved.

        Buckets that share members are one group. Its members are dealt into blocks, and a task compares the sketches of
        two blocks: what leaves it are pairs that would join components, fewer than it has members, whose texts are then
        fetched and verified. Where all of a group's pairs hold, its components are settled, since every other pair that
        the sketches leave lies within one. Only groups with a pair that fails are compared again block by block on
        their texts, within tasks.
        """
        plan, prior = self.plan, self.prior
        large = rows.where(F.col("size") > SMALL_BUCKET)
        leads = shared.saved(large.groupBy("bucket").agg(F.min("key").alias("a")), "leads")
        groups = components(large.join(leads, "bucket").select("a", F.col("key").alias("b")))
        nodes = large.select("key", "component").distinct().join(groups.withColumnRenamed("component", "group"), "key")
        nodes = shared.saved(nodes.join(self.held.select("key", "n", "sketch"), "key"), "large")
        columns = ["group", "key", "component", "part", "n", "sketch"]
        tasks = self.dealt(nodes, F.count("*") / SKETCH_BLOCK, columns)
        tried = tasks.groupBy("group", "i", "j").applyInPandas(lambda frame: sketch_forest(frame, plan, prior), "a long, b long, `group` long")
        tried = shared.saved(tried.distinct(), "forest")
        judged = self.verify(tried.select("a", "b").distinct())
        failed = judged.where("not linked").join(tried, ["a", "b"]).select("group").distinct()
        again = shared.saved(nodes.join(failed, "group", "left_semi").drop("component"), "again")
        found = judged.where("linked").select("a", "b")
        if not again.isEmpty():
            now = shared.saved(components(found.unionByName(nodes.where("key <> component").select(F.col("key").alias("a"), F.col("component").alias("b")))), "settled")
            full = again.join(now, "key", "left").withColumn("component", F.coalesce("component", "key")).join(self.held.select("key", "unit_text"), "key")
            tasks = self.dealt(full, F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("unit_text")) / BLOCK_BYTES), [*columns, "unit_text"])
            found = found.unionByName(tasks.groupBy("group", "i", "j").applyInPandas(lambda frame: compare_blocks(frame, plan, prior), "a long, b long"))
        found = shared.saved(found, "large-links")
        shared.release(self.spark, leads, nodes, tried, judged, again)
        return found

    def dealt(self, nodes: DataFrame, parts: Column, columns: list[str]) -> DataFrame:
        """nodes dealt over the tasks (group, i, j) of every two parts of a group."""
        parts = shared.saved(nodes.groupBy("group").agg(F.ceil(parts).cast("int").alias("parts")), "parts")
        own = nodes.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
        spread = own.select(*columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
        tasks = spread.select(*columns, F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"))
        # tasks of few bytes and much work: their number is fixed, so that they are not put together
        return tasks.repartition(4 * shared.shuffle_width(self.spark), "group", "i", "j")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """(a, b, linked) for pairs (a, b), saved: pruned by their signatures, then compared on full sets."""
        plan, prior = self.plan, self.prior
        left = self.held.select(F.col("key").alias("a"), F.col("sketch").alias("sa"))
        right = self.held.select(F.col("key").alias("b"), F.col("sketch").alias("sb"))

        def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sides = [np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for i in (2, 3)]
                keep = sequential_keep(*sides, plan, prior) if batch.num_rows else np.zeros(0, dtype=bool)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep)], names=["a", "b", "keep"])

        judged = shared.saved(pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(prune, "a long, b long, keep boolean"), "judged")
        both = judged.where("keep").select("a", "b").join(self.held.select(F.col("key").alias("b"), F.col("unit_text").alias("tb")), "b")
        both = both.join(self.held.select(F.col("key").alias("a"), F.col("unit_text").alias("ta")), "a").select("a", "b", "ta", "tb")

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, held, own = SpanHasher(), None, None
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    keys, linked = batch.column(0).to_pylist(), []
                    for lo, sets in text_sets(batch.column(3), plan.words, hasher):
                        for row, mine in enumerate(sets, lo):
                            if held != keys[row]:
                                held, own = keys[row], next(text_sets(batch.column(2).slice(row, 1), plan.words, hasher))[1][0]
                            common = len(np.intersect1d(own, mine, assume_unique=True))
                            linked.append(100 * common >= plan.percent * (len(own) + len(mine) - common))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

        found = shared.saved(both.mapInArrow(exact, "a long, b long, linked boolean").unionByName(judged.where("not keep").select("a", "b", F.lit(False).alias("linked"))), "tried")
        shared.release(self.spark, judged)
        return found

    def members(self, linked: DataFrame) -> DataFrame:
        """(h1, h2, cid, copies, first, head): head is the smallest first unit of the class's component."""
        own = self.classes.join(linked.withColumnRenamed("key", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        heads = shared.saved(own.groupBy("component").agg(F.min("first").alias("head"), F.sum("copies").alias("members")), "heads")
        return own.join(heads, "component").select("h1", "h2", "cid", "component", "first", "copies", "head", "members")
