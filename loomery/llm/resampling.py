"""Importance resampling towards a target distribution, on a sparse count matrix.

Documents become rows of a document-by-bucket matrix of hashed word runs, kept as CSR blocks in the shared
folder. Its column sums, and those of the target's matrix, give the gain of every bucket; the product of the
matrix and the gains gives the weights; Gumbel noise keyed by doc_id and a top-k draw without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm import shared, words

BUCKETS = 10_000
#: A block is closed once it has so many entries or rows; a row is never divided and has at most one entry a bucket.
BLOCK_ENTRIES, BLOCK_ROWS = 1 << 19, 1 << 14
#: Relative rank error of the quantile that narrows a draw down before it is sorted.
ACCURACY = 10_000

_BLOCK = "doc_ids array<long>, n_words binary, row_ends binary, buckets binary, counts binary"


def count_matrix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """The matrix of all rows, saved in the shared folder: one row a CSR block.

    Features are the runs of 1 to `longest` consecutive words, joined by one space; the bucket is the CRC-32 of
    their bytes modulo `buckets`. Null and empty texts are rows without entries; repeated rows are rows of their
    own; null ids stay null. Other columns are not read.
    """
    shared.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return shared.saved(rows.mapInArrow(_Count(longest, buckets), _BLOCK), "count-matrix", "zstd")


class _Block:
    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.words: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.buckets: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.rows = self.entries = 0

    def add(self, ids: pa.Array, n_words: np.ndarray, sizes: np.ndarray, buckets: np.ndarray, counts: np.ndarray) -> None:
        for held, new in zip((self.ids, self.words, self.sizes, self.buckets, self.counts), (ids, n_words, sizes, buckets, counts), strict=True):
            held.append(new)
        self.rows, self.entries = self.rows + len(ids), self.entries + len(buckets)

    def row(self) -> pa.RecordBatch:
        join = lambda parts, kind: pa.array([np.concatenate(parts).astype(kind).tobytes()], pa.binary())
        ids = pa.concat_arrays(self.ids)
        columns = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), join(self.words, np.int64), pa.array([np.cumsum(np.concatenate(self.sizes)).astype(np.int64).tobytes()], pa.binary()), join(self.buckets, np.uint32), join(self.counts, np.uint32)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_ids", "n_words", "row_ends", "buckets", "counts"])


class _Count:
    """Texts to CSR blocks. A long text comes in slices: its counts are summed up densely until the next row begins."""

    def __init__(self, longest: int, buckets: int) -> None:
        self.longest, self.buckets = longest, buckets

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            open_row, dense, n_words, tail = -1, None, 0, []
            parts = words.word_slices(texts)
            part = next(parts, None)
            while part is not None:
                after = next(parts, None)
                if after is not None and after.first == part.first or part.first == open_row:
                    if open_row != part.first:
                        open_row, dense, n_words, tail = part.first, np.zeros(self.buckets, dtype=np.int64), 0, []
                    _, found, counts, tail = self.features(part, tail)
                    np.add.at(dense, found, counts)
                    n_words += len(part.codes)
                    if after is None or after.first != open_row:
                        some = np.flatnonzero(dense)
                        block.add(ids.slice(open_row, 1), np.array([n_words]), np.array([len(some)]), some, dense[some])
                else:
                    rows, found, counts, _ = self.features(part, [])
                    block.add(ids.slice(part.first, len(part.lengths)), part.lengths, np.bincount(rows, minlength=len(part.lengths)), found, counts)
                if block.entries >= BLOCK_ENTRIES or block.rows >= BLOCK_ROWS:
                    yield block.row()
                    block = _Block()
                part = after
        if block.rows:
            yield block.row()

    def features(self, part: words.Slice, tail: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """(row, bucket, count) of a slice, and its last words. tail: the last words of the text so far."""
        raw, spots = words.binary_parts(part.distinct)
        crc = words.crc32_spans(raw, spots[:-1], np.diff(spots))
        rows, found = np.repeat(np.arange(len(part.bounds) - 1), part.lengths), [crc[part.codes]]
        places = [rows]
        if self.longest > 1:
            terms = part.distinct.take(pa.array(part.codes)).to_pylist()
            run = [*tail, *terms]
            owner = np.concatenate([np.zeros(len(tail), dtype=np.int64), rows])
            for n in range(2, self.longest + 1):
                begin = np.arange(len(run) - n + 1)
                begin = begin[(owner[begin] == owner[begin + n - 1]) & (begin + n > len(tail))] if len(begin) else begin
                runs = [b" ".join(run[i : i + n]) for i in begin]
                ends = np.cumsum([0] + [len(x) for x in runs])
                found.append(words.crc32_spans(np.frombuffer(b"".join(runs), dtype=np.uint8), ends[:-1], np.diff(ends)))
                places.append(owner[begin])
            tail = run[-(self.longest - 1) :]
        keys, counts = np.unique(np.concatenate(places) * self.buckets + np.concatenate(found).astype(np.int64) % self.buckets, return_counts=True)
        return keys // self.buckets, keys % self.buckets, counts, tail


def _read(batch: pa.RecordBatch, name: str, i: int, kind: type) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_buffer(), dtype=kind)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The sums of all columns; tasks sum up their blocks before the shuffle, and `buckets` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                total += np.bincount(_read(batch, "buckets", i, np.uint32), weights=_read(batch, "counts", i, np.uint32), minlength=buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in matrix.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed distributions, rounded down, of every bucket."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the matrix times the gains, divided by the row sums, rounded down; 0 without features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts = _read(batch, "counts", i, np.uint32).astype(np.int64)
                ends = np.append(0, _read(batch, "row_ends", i, np.int64))
                summed = lambda x: np.diff(np.append(0, np.cumsum(x))[ends])  # noqa: B023, E731
                n, total = summed(counts), summed(counts * gain[_read(batch, "buckets", i, np.uint32)])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, pa.array(_read(batch, "n_words", i, np.int64)), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of sha256('seed:doc_id'); a null id reads as 'null'."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))


def ranked(rows: DataFrame, score: str, tie: str, n: int) -> DataFrame:
    """rows with rank: 1 to n in descending order of score, ties to the smaller tie (null last); null for all others.

    A quantile of bounded size gives a score that at least n rows reach; only these are sorted, range by range,
    and their place is the count of the ranges before and that within the range.
    """
    total = rows.count()
    if not n:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    share = 1 - n / total - 2 / ACCURACY
    least = rows.agg(F.percentile_approx(score, share, ACCURACY).alias("q")).first().q if share > 0 else None
    may = F.lit(True) if least is None else F.col(score) >= least
    others = [c for c in rows.columns if c not in (score, tie)]
    order = rows.where(may).orderBy(F.desc(score), F.col(tie).asc_nulls_last(), *others)
    order = shared.saved(order.withColumn("__place", F.monotonically_increasing_id()), "ranked")
    sizes = order.groupBy(F.shiftright("__place", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row a partition
    if sum(r.n for r in sizes) < n:
        raise RuntimeError("the quantile left out rows that are drawn")
    before, starts = 0, []
    for r in sizes:
        starts.append((r.part, before))
        before += r.n
    parts = F.broadcast(rows.sparkSession.createDataFrame(starts, "__part long, __before long"))
    place = F.col("__before") + F.col("__place").bitwiseAND((1 << 33) - 1) + 1
    top = order.join(parts, F.shiftright("__place", 33) == F.col("__part")).select(*rows.columns, F.when(place <= n, place).alias("rank"))
    return top if least is None else top.unionByName(rows.where(~may).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, *, longest: int = 1, buckets: int = BUCKETS, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text); rank is null where it is not drawn.

    Of the documents with at least `least_words` words, floor(percent * N / 100) are drawn, best scores first,
    ties to the smaller doc_id. An empty side is allowed: without target texts all rare buckets gain alike.
    """
    matrix = count_matrix(docs, longest=longest, buckets=buckets)
    aim = count_matrix(target.withColumn("doc_id", F.lit(0)), longest=longest, buckets=buckets)
    rows = weights(matrix, gains(column_sums(matrix, buckets), column_sums(aim, buckets)))
    rows = shared.saved(rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scores")
    shared.drop(matrix, aim)
    long_enough = F.col("n_words") >= least_words
    drawn = ranked(rows.where(long_enough), "score", "doc_id", percent * rows.where(long_enough).count() // 100)
    return drawn.unionByName(rows.where(~long_enough).withColumn("rank", F.lit(None).cast("long"))).drop("n_words")


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs = shared.read_texts(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


#: CRC-32 by its table, byte by byte over the distinct words.
OP13_SQL = r"""
WITH RECURSIVE c AS (SELECT i, CAST(i AS UBIGINT) AS v, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS UBIGINT)) ELSE v >> 1 END, k + 1 FROM c WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM c WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
u AS (SELECT r, unnest(w) AS word FROM d),
x AS (SELECT DISTINCT word FROM (SELECT word FROM u UNION ALL SELECT word FROM b)),
h AS (SELECT word, hex(encode(word)) AS z FROM x),
y AS (SELECT word, [CAST('0x' || z[2 * j + 1 : 2 * j + 2] AS UBIGINT) FOR j IN range(len(z) // 2)] AS bytes FROM h),
k AS (SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), bytes), LAMBDA a, e : xor(a >> 8, t[CAST(xor(a, e) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) % 10000 AS bucket FROM y, tab),
s AS (SELECT bucket, count(*) AS s FROM u JOIN k USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (word) GROUP BY 1),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS s, (SELECT coalesce(sum(t), 0) FROM t) AS t),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.t, 0) + 1) * CAST(n.s + 10000 AS DOUBLE) / ((s.s + 1) * CAST(n.t + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
p AS (SELECT r, count(*) AS n_features, sum(gain) AS total FROM u JOIN k USING (word) JOIN g USING (bucket) GROUP BY 1),
o AS (SELECT r, doc_id, coalesce(n_features, 0) AS n_features, CAST(coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS BIGINT) AS weight, CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) AS h FROM d LEFT JOIN p USING (r)),
f AS (SELECT r, doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM o),
e AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM f WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM f LEFT JOIN e USING (r)
"""
