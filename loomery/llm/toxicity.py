"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

1. Voters: seed lexicons of word beginnings, patterns, and terms mined from a bounded sample of
   labelled rows (words and word beginnings that stand out in toxic texts). Each fires or not.
2. Label model: a class, and for every voter its chance to fire given the class and given the one
   voter it depends on most, so correlated voters do not count twice. Expectation maximisation
   over the votes of all training rows estimates the chances, the dependencies (a forest, by
   conditional mutual information) and how often given labels are wrong: a label is a vote too.
3. Classifier: logistic regression over hashed words, word beginnings and fired expressions,
   trained on the posterior labels of a bounded sample of labelled and unlabelled rows and
   scaled to the labels among them, scores every whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import shared
from loomery.llm.arrays import LOWER_TABLE, SpanHasher, mix, row_slices, text_buffers
from loomery.llm.decontamination import _NORMAL_TABLE

#: Bounds of the fit, whatever the input: rows in the sample (half of them labelled, where there are as many) and mined voters.
MAX_SAMPLE = 8_000
MAX_MINED = 96
FOLDS, HELD_OUT = 5, 0

BITS = 18
PREFIXES = (4, 5)

#: Seed lexicons: a few common insults and words of contempt in four languages, as word beginnings.
LEXICONS = {
    "en insults": ["idiot", "moron", "loser", "scum", "clown", "jerk"],
    "en contempt": ["stupid", "trash", "worthless", "pathetic", "disgusting", "dumb"],
    "de insults": ["idiot", "trottel", "abschaum", "versager"],
    "de contempt": ["dumm", "widerlich", "wertlos"],
    "fr insults": ["idiot", "imbécile", "crétin", "ordure"],
    "fr contempt": ["stupide", "pathétique", "minable"],
    "es insults": ["idiota", "imbécil", "basura"],
    "es contempt": ["estúpid", "patétic", "asqueros", "inútil"],
}
_INSULT = r"(?:idiot\w*|moron\w*|stupid\w*|loser\w*|trash|scum|worthless|pathetic|disgusting|clown\w*|dumb\w*)"
_MASKED = r"id[1!]ot|m0r0n|l0ser|st[u*]p[1!*]d|tr[@*]sh|sc[*]m"
_HATE = r"shut up|go away and|i hate you|kill yourself"
#: Pattern voters.
PATTERNS = {
    "address": rf"\byou(?: are|'re)?(?: such)?(?: an?)? {_INSULT}",
    "doubled": rf"\b{_INSULT}\b\W+(?:\w+\W+){{0,3}}{_INSULT}\b",
    "masked": rf"\b(?:{_MASKED})\b",
    "hate": rf"\b(?:{_HATE})\b",
}
#: All expressions that are looked for, whatever the case; a lexicon's words stand at the beginning of a word.
EXPRESSIONS = {**{name: rf"(?:^|[^\pL\pN_])(?:{'|'.join(words)})" for name, words in LEXICONS.items()}, **PATTERNS}
#: Found in every text that any of them matches: the others need only be tried there.
HINT = "|".join([*sorted({w for words in LEXICONS.values() for w in words}), _MASKED, _HATE])


def expressions_in(column: pa.Array) -> np.ndarray:
    """(rows, expressions): which of them a text holds."""
    out = np.zeros((len(column), len(EXPRESSIONS)), dtype=bool)
    rows = np.flatnonzero(pc.fill_null(pc.match_substring_regex(column, HINT, ignore_case=True), False).to_numpy(zero_copy_only=False))
    if len(rows):
        some = column.take(pa.array(rows))
        for i, expression in enumerate(EXPRESSIONS.values()):
            out[rows, i] = pc.match_substring_regex(some, expression, ignore_case=True).to_numpy(zero_copy_only=False)
    return out


def features(raw: np.ndarray, offsets: np.ndarray, hasher: SpanHasher, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct features of consecutive texts, sorted: hashed words and their first 4 and 5
    code points; only those that the table keep marks, if it is given."""
    low = LOWER_TABLE[raw]
    is_word = _NORMAL_TABLE[raw] != 32
    inner = offsets[1:-1]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[inner] = True
    before = np.concatenate(([False], is_word[:-1])) & ~cut[:-1]
    starts = np.flatnonzero(is_word & ~before)
    after = np.concatenate((is_word[1:], [False])) & ~cut[1:]
    ends = np.flatnonzero(is_word & ~after) + 1
    if len(starts) == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    row = np.searchsorted(offsets, starts, side="right") - 1
    heads = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    spot = np.searchsorted(heads, starts)
    parts = [hasher(low, starts, ends)]
    for k in PREFIXES:
        stop = np.minimum(heads[np.minimum(spot + k, len(heads) - 1)], ends)
        parts.append(hasher(low, starts, stop) ^ np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF))
    ids = (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)
    rows = np.tile(row, len(parts))
    if keep is not None:
        there = keep[ids]
        ids, rows = ids[there], rows[there]
    both = np.unique((rows << BITS) | ids)
    return both >> BITS, both & ((1 << BITS) - 1)


def each_features(column: pa.Array, hasher: SpanHasher, keep: np.ndarray | None = None) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, features of each row) of a text column."""
    offsets, raw = text_buffers(column)
    for lo, hi in row_slices(offsets):
        a, b = int(offsets[lo]), int(offsets[hi])
        row, ids = features(raw[a:b], offsets[lo : hi + 1] - a, hasher, keep)
        cuts = np.searchsorted(row, np.arange(hi - lo + 1))
        yield lo, [ids[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


@dataclass
class Voters:
    """The expressions, then one voter for each mined feature."""

    mined: np.ndarray

    @property
    def n(self) -> int:
        return len(EXPRESSIONS) + len(self.mined)

    def votes(self, column: pa.Array, hasher: SpanHasher) -> np.ndarray:
        """(rows, voters): 1 where a voter fires."""
        out = np.zeros((len(column), self.n), dtype=np.uint8)
        out[:, : len(EXPRESSIONS)] = expressions_in(column)
        place = np.full(1 << BITS, -1, dtype=np.int64)
        place[self.mined] = len(EXPRESSIONS) + np.arange(len(self.mined))
        for lo, part in each_features(column, hasher, place >= 0):
            for i, ids in enumerate(part, lo):
                out[i, place[ids]] = 1
        return out


def mine(seen: np.ndarray, bad: np.ndarray, clean: int, toxic: int) -> Voters:
    """The features that stand out most in toxic rows of a labelled sample: seen and bad are the rows with each
    feature, and the toxic ones among them."""
    if not clean or not toxic:
        return Voters(np.zeros(0, dtype=np.int64))
    good = seen - bad
    ratio = np.log((bad + 0.5) / (toxic + 1)) - np.log((good + 0.5) / (clean + 1))
    worth = np.where((bad >= 5) & (bad > good), ratio * np.sqrt(bad), 0)
    best = np.lexsort((np.arange(len(worth)), -worth))[:MAX_MINED]
    return Voters(best[worth[best] > 0])


#: Weight of a voter's chance without its parent in that with it, and the error of labels before the first round.
SHRINK, LABEL_ERROR, ROUNDS = 2.0, 0.002, 6
#: Labels are taken to be wrong this often at most, so that the classes stay those that labels mean.
MAX_LABEL_ERROR = 0.01


@dataclass
class LabelModel:
    """prior: share of toxic rows. fire[c, v, s]: chance that voter v fires in class c when its parent is
    silent (s 0) or fires (s 1); parent[v] is -1 for none, then both are alike. error[c]: chance that the
    label of a row of class c is wrong."""

    prior: float
    fire: np.ndarray
    parent: np.ndarray
    error: np.ndarray

    @classmethod
    def start(cls, voters: int) -> LabelModel:
        fire = np.empty((2, voters, 2))
        fire[0], fire[1] = 0.01, 0.14
        return cls(0.1, fire, np.full(voters, -1), np.full(2, LABEL_ERROR))

    def posterior(self, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Chance that each row is toxic. labels: 0, 1, or nan for none."""
        fired = votes.astype(np.float64)
        above = np.where(self.parent >= 0, fired[:, self.parent], 0.0)
        on = np.log(self.fire[1]) - np.log(self.fire[0])
        off = np.log1p(-self.fire[1]) - np.log1p(-self.fire[0])
        odds = np.log(self.prior / (1 - self.prior)) + off[:, 0].sum()
        odds = odds + fired @ (on - off)[:, 0] + above @ (off[:, 1] - off[:, 0]) + (fired * above) @ ((on - off)[:, 1] - (on - off)[:, 0])
        odds = odds + np.where(np.isnan(labels), 0.0, np.where(labels > 0.5, np.log((1 - self.error[1]) / self.error[0]), np.log(self.error[1] / (1 - self.error[0]))))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    @classmethod
    def estimate(cls, mass: np.ndarray, pairs: np.ndarray, told: np.ndarray) -> LabelModel:
        """From expected counts: rows by class, rows by class in which two voters fire, labels by class and value."""
        alone = np.einsum("cvv->cv", pairs)
        chance = (alone + 0.1) / (mass[:, None] + 0.2)
        parent = dependencies(mass, pairs)
        fire = np.repeat(chance[:, :, None], 2, axis=2)
        for v in np.flatnonzero(parent >= 0):
            j = parent[v]
            fire[:, v, 1] = (pairs[:, v, j] + SHRINK * chance[:, v]) / (alone[:, j] + SHRINK)
            fire[:, v, 0] = (np.maximum(alone[:, v] - pairs[:, v, j], 0) + SHRINK * chance[:, v]) / (np.maximum(mass - alone[:, j], 0) + SHRINK)
        wrong = np.array([told[0, 1], told[1, 0]])
        error = np.clip((wrong + LABEL_ERROR) / (told.sum(1) + 1), 1e-3, MAX_LABEL_ERROR)
        return cls(float(np.clip(mass[1] / mass.sum(), 1e-4, 0.9)), np.clip(fire, 1e-6, 1 - 1e-6), parent, error)


def dependencies(mass: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Parent of every voter in the forest of largest conditional mutual information, or -1. Pairs whose
    agreement within the classes chance explains (one in a hundred thousand) are not joined."""
    n, voters = mass.sum(), pairs.shape[1]
    total = np.zeros((voters, voters))
    for c in range(2):
        both, m = pairs[c] / max(mass[c], 1e-9), mass[c] / max(n, 1e-9)
        p = np.diag(both)
        for a in (0, 1):
            for b in (0, 1):
                pa_, pb = (p if a else 1 - p)[:, None], (p if b else 1 - p)[None, :]
                joint = both if a and b else p[:, None] - both if a else p[None, :] - both if b else 1 - p[:, None] - p[None, :] + both
                joint = np.maximum(joint, 0)
                total += m * np.where(joint > 0, joint * (np.log(np.maximum(joint, 1e-300)) - np.log(np.maximum(pa_ * pb, 1e-300))), 0)
    np.fill_diagonal(total, 0)
    total[2 * n * total < 23.0] = 0
    parent, reached = np.full(voters, -1), np.zeros(voters, dtype=bool)
    for root in range(voters):
        if reached[root]:
            continue
        reached[root] = True
        best, by = np.where(reached, -1.0, total[root]), np.full(voters, root)
        while (v := int(best.argmax())) >= 0 and best[v] > 0:
            reached[v], parent[v] = True, by[v]
            better = ~reached & (total[v] > best)
            best[better], by[better] = total[v][better], v
            best[v] = -1
    return parent


def fit_label_model(votes: DataFrame, voters: int) -> LabelModel:
    """Expectation maximisation over all rows (votes binary, toxic int or null); each round is one
    pass in which tasks send sums over their rows, as large as the voters are many."""
    spark = votes.sparkSession
    model = LabelModel.start(voters)
    votes = votes.select("votes", "toxic")
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)

        def tally(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            mass, pairs, told = np.zeros(2), np.zeros((2, voters, voters)), np.zeros((2, 2))
            for whole in batches:
                for at in range(0, whole.num_rows, 8192):
                    rows, labels = unpacked(whole.slice(at, 8192), voters)
                    p = sent.value.posterior(rows, labels)
                    fired = rows.astype(np.float64)
                    for c, w in enumerate((1 - p, p)):
                        mass[c] += w.sum()
                        pairs[c] += fired.T @ (fired * w[:, None])
                        for value in (0, 1):
                            told[c, value] += w[labels == value].sum()
            x = np.concatenate((mass, pairs.ravel(), told.ravel()))
            there = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(x[there])], names=["i", "x"])

        found = votes.mapInArrow(tally, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
        x = np.zeros(6 + 2 * voters * voters)
        x[found["i"].to_numpy()] = found["x"].to_numpy()
        if x[:2].sum() == 0:
            break
        model = LabelModel.estimate(x[:2], x[2:-4].reshape(2, voters, voters), x[-4:].reshape(2, 2))
    return model


def unpacked(batch: pa.RecordBatch, voters: int) -> tuple[np.ndarray, np.ndarray]:
    """Votes and labels (nan for none) of rows (votes binary, toxic int)."""
    rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, voters)
    return rows, np.array([np.nan if x is None else float(x > 0) for x in batch.column(1).to_pylist()])


#: Log-likelihood ratio from which a feature enters the classifier; by chance one in ten thousand passes it.
MIN_EVIDENCE = 15.0


def telling(seen: np.ndarray, bad: np.ndarray, n: float, n1: float) -> np.ndarray:
    """Which features are in toxic rows more or less often than chance explains (and in three rows or more).
    seen and bad: rows with each feature, and their toxicity summed; n and n1: of all rows."""
    evidence = np.zeros(len(seen))
    for count, total, share in ((bad, seen, n1 / n), (seen - bad, seen, 1 - n1 / n), (n1 - bad, n - seen, n1 / n), (n - n1 - (seen - bad), n - seen, 1 - n1 / n)):
        evidence += 2 * np.maximum(count, 0) * np.log(np.maximum(count, 1e-9) / np.maximum(total * share, 1e-9))
    return (seen >= 3) & (evidence >= MIN_EVIDENCE)


_TURNS = mix(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)


def marks(ids: np.ndarray) -> bytes:
    """Sixteen minima of hashed features, by which near copies are told."""
    return (mix(ids.astype(np.uint64)[None, :] * _TURNS[:, None] + _TURNS[:, None]).min(1) if len(ids) else np.zeros(len(_TURNS), dtype=np.uint64)).tobytes()


def distinct_rows(found: list[bytes], bands: int = 4, rows: int = 4) -> np.ndarray:
    """Rows of the sample without near copies of earlier ones, whose words would count once for each copy."""
    seen: set[tuple] = set()
    keep = []
    for i, x in enumerate(found):
        own = {(b, x[8 * rows * b : 8 * rows * (b + 1)]) for b in range(bands)}
        if not own & seen:
            keep.append(i)
        seen |= own
    return np.array(keep, dtype=np.int64)


#: Labelled rows of either class from which the classifier's scores are scaled to the labels.
MIN_TOLD = 20


def fit_linear(sample: list[np.ndarray], p: np.ndarray, size: int, l2: float = 1e-4, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on binary features (ids below size) with soft labels p."""
    w, n = np.zeros(size), len(sample)
    if n == 0:
        return w, -4.0
    ids = np.concatenate(sample)
    row = np.repeat(np.arange(n), [len(x) for x in sample])
    active, ids = np.unique(ids, return_inverse=True)
    x = np.zeros(len(active))
    m, v = np.zeros(len(active) + 1), np.zeros(len(active) + 1)
    bias = float(np.log(np.clip(p.mean(), 1e-3, 0.999) / (1 - np.clip(p.mean(), 1e-3, 0.999))))
    for t in range(1, steps + 1):
        score = bias + np.bincount(row, weights=x[ids], minlength=n)
        gap = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - p) / n
        grad = np.append(np.bincount(ids, weights=gap[row], minlength=len(active)) + l2 * x, gap.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        x, bias = x - step[:-1], bias - step[-1]
    w[active] = x
    return w, float(bias)


def scaled(raw: np.ndarray, truth: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift under which the raw scores of labelled rows fit their labels best (Newton's method, with
    labels drawn a little towards each other as they are few)."""
    n1, n0 = truth.sum(), len(truth) - truth.sum()
    goal = np.where(truth > 0.5, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack((raw, np.ones(len(raw))))
    at = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -30, 30)))
        grad = x @ (p - goal) + 1e-3 * (at - [1.0, 0.0])
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), grad)
        at = at - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def fold(doc_id: str) -> int:
    return zlib.crc32(doc_id.encode()) % FOLDS


def _held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT


@dataclass
class ToxicityModel:
    """weights: of the hashed features, then of the expressions."""

    weights: np.ndarray
    bias: float
    label_model: LabelModel

    def score(self, docs: DataFrame, *, text: str = "text") -> DataFrame:
        """docs with score (0 to 1) and predicted (1 from 0.5 on) added, columns of these names replaced; null reads as empty."""
        shared.bound_batches(docs.sparkSession)
        kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")])
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
        sent = docs.sparkSession.sparkContext.broadcast((self.weights.astype(np.float32), self.bias))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, bias = sent.value
            hashed, fired = weights[: 1 << BITS], weights[1 << BITS :].astype(np.float64)
            hasher, keep = SpanHasher(seed=23), hashed != 0
            for batch in batches:
                column = batch.column(batch.schema.get_field_index(text))
                found = np.array([hashed[ids].sum(dtype=np.float64) for _, part in each_features(column, hasher, keep) for ids in part])
                score = 1 / (1 + np.exp(-np.clip(found + expressions_in(column) @ fired + bias, -30, 30)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

        return kept.mapInArrow(run, f"{schema}, score double, predicted int")


class _Sample:
    """A bounded sample of training rows, saved as (rid, toxic, ids, votes, marks); only sums and short rows come to the driver."""

    def __init__(self, rows: DataFrame) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = SpanHasher(seed=23)
            for batch in batches:
                for lo, part in each_features(batch.column(1), hasher):
                    own = batch.slice(lo, len(part))
                    yield pa.RecordBatch.from_arrays([own.column(0), pa.array([x.astype("<i4").tobytes() for x in part], pa.binary()), pa.array([marks(x) for x in part], pa.binary()), own.column(1)], names=["toxic", "ids", "marks", "text"])

        self.rows = shared.saved(rows.mapInArrow(run, "toxic int, ids binary, marks binary, text string").withColumn("rid", F.monotonically_increasing_id()), "toxic-sample")
        found = self.rows.select("rid", "toxic", "marks").orderBy("rid").collect()  # about max_sample short rows
        self.once = [found[i] for i in distinct_rows([bytes(r.marks) for r in found])]

    def sums(self, weight: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
        """How many of the weighted rows have each feature, and the sum of their weights."""
        sent = self.rows.sparkSession.sparkContext.broadcast(weight)  # as many as the sample has rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, weighted = np.zeros(1 << BITS), np.zeros(1 << BITS)
            for batch in batches:
                for rid, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if rid in sent.value:
                        own = np.frombuffer(ids.as_buffer(), dtype="<i4")
                        seen[own] += 1
                        weighted[own] += sent.value[rid]
            there = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(seen[there]), pa.array(weighted[there])], names=["i", "seen", "weighted"])

        found = self.rows.select("rid", "ids").mapInArrow(run, "i int, seen double, weighted double").groupBy("i").agg(F.sum("seen").alias("seen"), F.sum("weighted").alias("weighted")).toPandas()  # as many as there are features at most
        out = np.zeros((2, 1 << BITS))
        out[:, found["i"].to_numpy()] = found["seen"].to_numpy(), found["weighted"].to_numpy()
        return out[0], out[1]

    def votes(self, voters: Voters) -> dict[int, np.ndarray]:
        sent = self.rows.sparkSession.sparkContext.broadcast(voters)
        found = self.rows.select("rid", "text").mapInArrow(_voting(sent, "rid"), "rid long, votes binary").collect()  # about max_sample short rows
        return {r.rid: np.frombuffer(r.votes, dtype=np.uint8) for r in found}

    def picked(self, keep: np.ndarray) -> dict[int, np.ndarray]:
        """The features of every row that keep marks: of those that tell, few."""
        sent = self.rows.sparkSession.sparkContext.broadcast(keep)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [np.frombuffer(x.as_buffer(), dtype="<i4") for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[sent.value[x]].tobytes() for x in own], pa.binary())], names=["rid", "ids"])

        return {r.rid: np.frombuffer(r.ids, dtype="<i4") for r in self.rows.select("rid", "ids").mapInArrow(run, "rid long, ids binary").collect()}


def _voting(sent, key: str):
    """(key, votes) of batches (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher(seed=23)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sent.value.votes(batch.column(1), hasher)], pa.binary())], names=[key, "votes"])

    return run


def _among(rate: float) -> Column:
    """Whether an id's 64-bit hash is among the lowest `rate` of all; fine enough for any number of rows."""
    return F.lit(True) if rate >= 1 else F.xxhash64("id") < F.lit(int(rate * 2**64) - 2**63).cast("long")


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_sample: int = MAX_SAMPLE) -> ToxicityModel:
    """Fits on the rows outside the held-out fold (crc32 of the id as text, mod 5, is 0).

    The sample has about max_sample rows, those of smallest id hash: half of it labelled rows and half
    others, where there are as many of both. The label model sees the votes of all training rows, labelled
    or not; the classifier learns its posteriors of the sample. Null labels and null ids are not used; of
    several labels of an id the largest counts. Without labels no voters are mined, and the expressions are
    toxic whatever the classifier learns.
    """
    spark = docs.sparkSession
    shared.bound_batches(spark)
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).where("id is not null").where(~_held_out())
    known = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("toxic")).where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    n, total = known.where(~_held_out()).count(), rows.count()
    told = min(n, max(max_sample // 2, max_sample - max(total - n, 0)))
    rates = [min(1.0, told / max(n, 1)), min(1.0, (max_sample - told) / max(total - n, 1))]
    near = rows.where(_among(max(rates))).join(known, "id", "left")
    sample = _Sample(near.where(F.when(F.col("toxic").isNotNull(), _among(rates[0])).otherwise(_among(rates[1]))).select("toxic", "text"))
    if total and not sample.once:
        raise RuntimeError("the sample of a table with rows is empty")

    gold = {r.rid: float(r.toxic > 0) for r in sample.once if r.toxic is not None}
    seen, bad = sample.sums(gold)
    toxic = int(sum(gold.values()))
    voters = mine(seen, bad, len(gold) - toxic, toxic)
    sent = spark.sparkContext.broadcast(voters)
    kind = rows.schema["id"].dataType.simpleString()
    all_votes = shared.saved(rows.mapInArrow(_voting(sent, "id"), f"id {kind}, votes binary").join(known, "id", "left").select("votes", "toxic"), "votes")
    model = fit_label_model(all_votes, voters.n)

    own = sample.votes(voters)
    votes = np.array([own[r.rid] for r in sample.once], dtype=np.uint8).reshape(len(sample.once), voters.n)
    posterior = model.posterior(votes, np.array([np.nan if r.toxic is None else float(r.toxic > 0) for r in sample.once]))
    size = (1 << BITS) + len(EXPRESSIONS)
    weights, bias = np.zeros(size), -4.0
    if len(posterior):
        seen, bad = sample.sums(dict(zip([r.rid for r in sample.once], posterior.tolist(), strict=True)))
        hashed = sample.picked(telling(seen, bad, len(posterior), posterior.sum()))
        fired = [(1 << BITS) + np.flatnonzero(v[: len(EXPRESSIONS)]) for v in votes]
        sets = [np.concatenate((hashed[r.rid], x)) for r, x in zip(sample.once, fired, strict=True)]
        weights, bias = fit_linear(sets, posterior, size)
        told = [(sets[i], float(r.toxic > 0)) for i, r in enumerate(sample.once) if r.toxic is not None]
        if min(toxic, len(gold) - toxic) >= MIN_TOLD:
            slope, shift = scaled(np.array([weights[x].sum() + bias for x, _ in told]), np.array([y for _, y in told]))
            weights, bias = slope * weights, slope * bias + shift
    if not n:
        weights[1 << BITS :] = np.maximum(weights[1 << BITS :], 4.0 - bias)
    shared.release(spark, all_votes, sample.rows)
    return ToxicityModel(weights, bias, model)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read_texts(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = fit(docs, labels).score(docs)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
