"""Ranked search, mixing and resampling against brute force, on odd rows and skewed tables."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.llm import lexical, mixing, resampling, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

ODD = [(1, "The the THE cat."), (2, None), (3, ""), (4, "---"), (5, "Ärger ÄRGER naïve 漢字 x1"), (None, "cat cat dog"), (7, "cat dog " * 40), (7, "cat dog " * 40), (8, "w" * 300 + " cat"), (9, "dog"), (10, "zebra\ncat\tdog dog")]


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def many(n, seed):
    rng, vocabulary = random.Random(seed), [f"w{i}" for i in range(300)]
    return [(i, " ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(300)], k=rng.randint(0, 60)))) for i in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    extra = [(i, t, "clash") for i, t in ODD + many(300, 3)]
    return spark.createDataFrame(extra, "doc_id long, text string, score string")


@pytest.mark.parametrize("limit", [1 << 20, 64])
def test_words_of_slices(limit):
    import pyarrow as pa

    texts = [t for _, t in ODD] + ["a b c " * 100, "é" * 500, "tail"]
    found = [[] for _ in texts]
    for part in words.word_slices(pa.array(texts), limit):
        for i, n in enumerate(part.lengths):
            found[part.first + i] += [bytes(part.distinct[c].as_py()) for c in part.codes[part.bounds[i] : part.bounds[i] + n]]
    assert found == [[w.encode() for w in tokens(t)] for t in texts]


def test_crc32_of_spans():
    rng = random.Random(1)
    spans = [bytes(rng.randrange(256) for _ in range(n)) for n in [0, 1, 5, 95, 96, 97, 400, 3, 3]]
    ends = np.cumsum([0] + [len(s) for s in spans])
    got = words.crc32_spans(np.frombuffer(b"".join(spans), dtype=np.uint8), ends[:-1], np.diff(ends))
    assert got.tolist() == [zlib.crc32(s) for s in spans]


def brute_search(docs, items, k=10):
    own = [(i, Counter(tokens(t))) for i, t in docs if tokens(t)]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(w for _, c in own for w in c)
    out = []
    for item in {i for i, _ in items}:
        terms = {w for i, t in items if i == item for w in tokens(t)}
        scored = []
        for doc, c in own:
            m = 10 + (90 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in terms if c[w])
            if s > 0:
                scored.append((-s, math.inf if doc is None else doc))
        out += [(item, r + 1, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


ITEMS = [(1, "the cat"), (2, None), (3, "!!"), (4, "漢字 ärger"), (5, "w0 w1 w2 w3 w17 w200 w299 w250"), (5, "w7 Dog"), (None, "zebra w5"), (6, "unknown")]


@pytest.mark.parametrize("shard", [8 << 20, 300])
def test_search_equals_brute_force(spark, odd, monkeypatch, shard):
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = lexical.search(lexical.build_index(odd.repartition(3)), items).collect()
    assert sorted(map(tuple, got), key=repr) == brute_search(ODD + many(300, 3), ITEMS)


def test_search_in_blocks_of_queries(spark, odd, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 40)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = lexical.search(lexical.build_index(odd), items, k=3).collect()
    assert sorted(map(tuple, got), key=repr) == brute_search(ODD + many(300, 3), ITEMS, 3)


def test_search_of_nothing(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(lexical.build_index(odd.limit(0)), items).collect() == []
    assert lexical.search(lexical.build_index(odd.where("text is null")), items).collect() == []
    assert lexical.search(lexical.build_index(odd), items.limit(0)).collect() == []


def test_max_score_prunes_and_keeps_every_qualifying_document():
    class Shard:
        ids = np.arange(2000)
        lists = {0: (np.array([3, 900]), np.array([100, 90])), 1: (np.arange(0, 2000, 2), np.full(1000, 10)), 2: (np.arange(2000), np.full(2000, 5))}
        bounds = np.array([100, 10, 5])
        read = []

        def list(self, t):
            self.read.append(t)
            return self.lists[t]

    shard = Shard()
    at, scores = lexical.max_score(shard, np.array([0, 1, 2]), 104, 2)
    assert dict(zip(at.tolist(), scores.tolist(), strict=True)) == {3: 105, 900: 105}
    assert len(lexical.max_score(shard, np.array([1, 2]), 104, 2)[0]) == 0
    assert shard.read[3:] == []  # neither list of the second search could qualify alone


def brute_mix_targets(docs):
    size = Counter()
    for _, source, text in docs:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in size else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    fixed, total = {}, 1.5 * sum(size.values())
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return size, fixed
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free}
        above = [s for s in free if share[s] > 2 * size[s]]
        if not above:
            return size, fixed | share
        fixed |= {s: 2.0 * size[s] for s in above}


def mixed_rows(n=400):
    rng = random.Random(5)
    rows = [(i, "big" if i % 3 == 0 else rng.choice(["a", "b", "é", "z", None]), " ".join(f"{i}x{j}" for j in range(rng.choice([0, 1, 3, 50, 700])))) for i in range(n)]
    return rows + [(None, "a", "null id words"), (5, "b", "again"), (5, "b", "again"), (6, "empty", None), (7, "empty", "  "), (8, "tiny", "one")]


def test_mixture_meets_targets_and_texts(spark):
    rows = mixed_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, rank int")
    mixture = mixing.mix(docs.repartition(3), length=16)
    size, want = brute_mix_targets(rows)
    placed = mixture.docs.collect()
    assert Counter((r.doc_id, r.size) for r in placed) == Counter((i, len(re.findall(r"\S+", t or ""))) for i, _, t in rows)
    by_rank = {r.rank: r for r in placed}
    assert sorted((r.source_size, round(r.target, 6)) for r in by_rank.values()) == sorted((size[s], round(want[s], 6)) for s in want)
    spans = mixture.spans.collect()
    taken = Counter()
    for s in spans:
        taken[s["rank"]] += s.n
    assert all(taken[k] == int(r.target + 0.5) for k, r in by_rank.items())
    per_word = Counter((s["rank"], s.start + s["first"] + j) for s in spans for j in range(s.n))
    assert max(per_word.values()) <= 2
    for k, r in by_rank.items():  # a second time only after all words came once
        times = [per_word[k, w] for w in range(r.source_size)]
        assert not times or max(times) - min(times) <= 1
    slots = Counter((s.shard, s.slot) for s in spans)
    assert {s.shard for s in spans} == set(range(max(s.shard for s in spans) + 1)) and len(slots) > 1
    pieces = mixture.texts(docs).collect()
    assert sorted((p.shard, p.slot, p.place, p.n) for p in pieces) == sorted((s.shard, s.slot, s.place, s.n) for s in spans)
    own = {}
    for i, _, t in rows:
        own.setdefault(i, []).append(t)
    assert all(len(p.text.split()) == p.n and any(p.text in (t or "") for t in own[p.doc_id]) for p in pieces)


def test_mixture_again_and_of_nothing(spark):
    docs = spark.createDataFrame(mixed_rows(60), "doc_id long, source string, text string")
    one = mixing.mix(docs.repartition(5), length=16).spans.collect()
    two = mixing.mix(docs.coalesce(1), length=16).spans.collect()
    assert Counter(map(tuple, one)) == Counter(map(tuple, two))
    for nothing in (docs.limit(0), docs.where("text is null")):
        assert mixing.mix(nothing).spans.collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    index = np.arange(n)
    there = mixing.permuted(index, n, 99)
    assert sorted(there.tolist()) == index.tolist()
    assert mixing.permuted(there, n, 99, back=True).tolist() == index.tolist()


def test_shard_draws_from_any_task():
    slots = np.array([700, 0, 33, 5000, 1])
    whole = list(mixing.shard_draws(slots, 100, 3, 0, 58))
    assert sum(c.sum() for _, c, _ in whole) == slots.sum() and (sum(c for _, c, _ in whole) == slots).all()
    assert all(c.sum() == 100 for _, c, _ in whole[:-1])
    part = list(mixing.shard_draws(slots, 100, 3, 17, 21))
    assert [(s, c.tolist(), b.tolist()) for s, c, b in part] == [(s, c.tolist(), b.tolist()) for s, c, b in whole[17:21]]
    large = np.array([3 * 10**9, 10**9])
    left = mixing._split(np.random.default_rng(1), large, 2 * 10**9)
    assert left.sum() == 2 * 10**9 and abs(left[0] / 1.5e9 - 1) < 1e-3


def brute_resample(docs, target, longest=1, buckets=10_000, least=20, percent=10):
    def features(text):
        w = tokens(text)
        return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)), Counter(bucket(f) for x in target for f in features(x))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets))))
    rows = []
    for i, x in docs:
        f = features(x)
        weight = sum(gain(bucket(w)) for w in f) // len(f) if f else 0
        h = int(sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(tokens(x)) >= least])
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    n = percent * len(order) // 100
    for k, r in enumerate(order):
        r[4] = k + 1 if k < n else None
    return sorted([tuple(r[:4]) + (r[4] if r[4] is not True and r[4] is not False else None,) for r in rows], key=repr)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_brute_force(spark, odd, monkeypatch, longest):
    monkeypatch.setattr(resampling, "BLOCK_ROWS", 7)
    target = ["w1 w3 cat", None, "the w9 w200 !"]
    got = resampling.resample(odd.repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, percent=30)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(ODD + many(300, 3), target, longest, percent=30)


def test_resampling_of_long_text_in_slices():
    import pyarrow as pa

    text = " ".join(f"t{i % 977}" for i in range(3000))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["a b", text, None])], names=["doc_id", "text"])

    def entries(limit):
        original = words.word_slices
        words.word_slices = lambda column: original(column, limit)
        try:
            return [{k: bytes(b.column(k)[0].as_py()) for k in ("n_words", "row_ends", "buckets", "counts")} for b in resampling._Count(3, 10_000)([batch])]
        finally:
            words.word_slices = original

    assert entries(500) == entries(1 << 20)


def test_resampling_of_nothing(spark, odd):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(odd.limit(0), none).collect() == []
    got = resampling.resample(odd, none)
    assert got.count() == len(ODD) + 300 and got.where("rank is not null").count() == sum(len(tokens(t)) >= 20 for _, t in ODD + many(300, 3)) // 10


def test_ranks_of_ties(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("score"))
    got = {r.doc_id: r.rank for r in resampling.ranked(rows.repartition(7), "score", "doc_id", 2000).collect()}
    want = sorted(range(5000), key=lambda i: (-(i % 3), i))
    assert {i: r for i, r in got.items() if r is not None} == {i: k + 1 for k, i in enumerate(want[:2000])} and len(got) == 5000
