"""Line dedup: sharded cuckoo filters in front of exact reference-count tables.

An index is three tables in the shared folder. postings has one row for each document and
distinct long line key; refs counts these references exactly and knows the largest doc_id of
a key; filters holds one cuckoo filter per shard of the keys with at least min_docs
references, which are all that as many documents can hold. Each table is a list of parts: an
insertion adds its postings, a deletion the ids that are gone, both the new counts of the keys
they touch, and new filters of the shards in which a key crosses the threshold; what was there
stays as it is, so every step can be taken back, and compact() puts the parts together. Filters
only spare the exact join rows that cannot match; the join and a count of distinct doc_ids
among what is left decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import shared
from loomery.llm.arrays import LOWER
from loomery.llm.cuckoo import CuckooFilter

MIN_CHARS = 40
MIN_DOCS = 5
_WHITE = b" \t\n\x0b\x0c\r"

#: Bytes of all filters together that may be broadcast; beyond, each shard's rows go to tasks with its filter.
BROADCAST_BYTES = 32 << 20
#: Postings of one such task; a shard with more, such as that of a hot line, is dealt over several.
ROWS_A_TASK = 2_000_000


def line_key(line: bytes) -> bytes:
    return line.strip(_WHITE).translate(LOWER)


def _points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _long_keys(text: bytes, min_chars: int) -> list[bytes]:
    """Hash of the key of every line, empty where the key is too short."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(_WHITE) if len(line) >= min_chars else b""
        out.append(_hash(key.translate(LOWER)) if len(key) >= min_chars and _points(key) >= min_chars else b"")
    return out


def line_postings(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, text_hash) for each row and distinct long key in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                keys, rows = [], []
                for i, value in enumerate(batch.column(2).cast(pa.large_binary())):
                    found = set(_long_keys(value.as_py() or b"", min_chars)) - {b""}
                    keys.extend(found)
                    rows.extend([i] * len(found))
                halves = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(take), batch.column(1).take(take)], names=["h1", "h2", "doc_id", "text_hash"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "h1 long, h2 long, doc_id long, text_hash long")


def _count(postings: DataFrame) -> DataFrame:
    return postings.groupBy("h1", "h2").agg(F.count("*").alias("refs"), F.max("doc_id").alias("last_doc"))


def _shard(n: int):
    return F.pmod(F.col("h2"), F.lit(n)).cast("int")


def _build_filters(frequent: DataFrame, shards: int) -> DataFrame:
    """One row (shard, filter) for each shard that has keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            shard = parts[0][1][:1]
            made = CuckooFilter.build(np.concatenate([k for k, _ in parts]))
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array([made.to_bytes()], pa.binary())], names=["shard", "filter"])

    dealt = frequent.select("h1", _shard(shards).alias("shard")).repartitionById(shards, "shard")
    return dealt.mapInArrow(run, "shard int, filter binary")


@dataclass(frozen=True)
class LineIndex:
    """An immutable state; insert and delete return the next one, which shares the tables of this one.

    posting_parts and gone_parts: (version, table); postings of a version lose the documents that are gone in a later
    one. ref_parts and filter_parts: tables of rows with their version; of each key and shard the newest row counts.
    """

    posting_parts: tuple[tuple[int, DataFrame], ...]
    gone_parts: tuple[tuple[int, DataFrame], ...]
    ref_parts: tuple[DataFrame, ...]
    filter_parts: tuple[DataFrame, ...]
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS
    version: int = 0

    @classmethod
    def build(cls, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int | None = None) -> LineIndex:
        """Index of all rows of docs. Rows that share a doc_id are references of their own, but one document
        when lines are judged.

        Null and empty texts have no long line. A null doc_id counts and ranks below all others.
        """
        shards = shards or shared.shuffle_width(docs.sparkSession)
        postings = shared.saved(line_postings(docs, doc_id, text, min_chars), "line-postings")
        return cls._of(postings, shards, min_chars, min_docs)

    @classmethod
    def _of(cls, postings: DataFrame, shards: int, min_chars: int, min_docs: int) -> LineIndex:
        refs = shared.saved(_count(postings), "line-refs")
        filters = shared.saved(_build_filters(refs.where(F.col("refs") >= min_docs), shards), "line-filters")
        zero = F.lit(0).alias("version")
        return cls(((0, postings),), (), (refs.select("*", zero),), (filters.select("*", zero),), shards, min_chars, min_docs)

    @property
    def postings(self) -> DataFrame:
        """All postings of documents that are not gone."""
        parts = []
        for version, part in self.posting_parts:
            for later, gone in self.gone_parts:
                if later > version:
                    part = part.join(gone, "doc_id", "left_anti").select("h1", "h2", "doc_id", "text_hash")
            parts.append(part)
        return reduce(DataFrame.unionByName, parts)

    @property
    def refs(self) -> DataFrame:
        """(h1, h2, refs, last_doc) of every key."""
        return self._newest(self.ref_parts, ["h1", "h2"], ["refs", "last_doc"]).where("refs > 0")

    @property
    def filters(self) -> DataFrame:
        return self._newest(self.filter_parts, ["shard"], ["filter"])

    @staticmethod
    def _newest(parts: tuple[DataFrame, ...], keys: list[str], values: list[str]) -> DataFrame:
        if len(parts) == 1:
            return parts[0].select(*keys, *values)
        best = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.max_by(F.struct(*values), "version").alias("best"))
        return best.select(*keys, "best.*")

    def insert(self, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
        """With all rows of docs. Written are their postings, the counts of their keys, and filters that change."""
        new = shared.saved(line_postings(docs, doc_id, text, self.min_chars), "line-postings")
        counts = _count(new)
        was = self.refs.join(counts.select("h1", "h2"), ["h1", "h2"], "left_semi")
        now = was.unionByName(counts).groupBy("h1", "h2").agg(F.sum("refs").alias("refs"), F.max("last_doc").alias("last_doc"))
        return self._next(was, now, postings=new)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents whose ids doc_ids holds in its first column. Written are the ids, the counts of their keys,
        taken anew from what is left, and filters that change."""
        gone = shared.saved(doc_ids.select(F.col(doc_ids.columns[0]).cast("long").alias("doc_id")).distinct(), "line-gone")
        touched = shared.saved(self.postings.join(gone, "doc_id", "left_semi").select("h1", "h2").distinct(), "line-touched")
        left = _count(self.postings.join(touched, ["h1", "h2"], "left_semi").join(gone, "doc_id", "left_anti"))
        was = self.refs.join(touched, ["h1", "h2"], "left_semi")
        none = touched.join(left, ["h1", "h2"], "left_anti").select("h1", "h2", F.lit(0).cast("long").alias("refs"), F.lit(None).cast("long").alias("last_doc"))
        return self._next(was, left.unionByName(none), gone=gone)

    def _next(self, was: DataFrame, now: DataFrame, *, postings: DataFrame | None = None, gone: DataFrame | None = None) -> LineIndex:
        """The state after the counts of some keys changed from was to now."""
        version = self.version + 1
        now = shared.saved(now.withColumn("version", F.lit(version)), "line-refs")
        frequent = lambda x: x.where(F.col("refs") >= self.min_docs).select("h1", "h2")
        up = frequent(now).join(frequent(was), ["h1", "h2"], "left_anti").select("h1", "h2", F.lit(1).alias("step"))
        down = frequent(was).join(frequent(now), ["h1", "h2"], "left_anti").select("h1", "h2", F.lit(-1).alias("step"))
        changes = shared.saved(up.unionByName(down).select(_shard(self.shards).alias("shard"), "h1", "step"), "line-changes")
        refs = (*self.ref_parts, now)

        def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            kept = CuckooFilter.from_bytes(left["filter"].iloc[0]) if len(left) else CuckooFilter.for_size(len(right))
            kept.delete(right.loc[right["step"] < 0, "h1"].to_numpy())
            full = not kept.insert(right.loc[right["step"] > 0, "h1"].to_numpy())
            return pd.DataFrame({"shard": np.array([key[0]], dtype=np.int32), "filter": [None if full else kept.to_bytes()]})

        held = self.filters.join(changes.select("shard").distinct(), "shard", "left_semi")
        stepped = shared.saved(held.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(run, "shard int, filter binary"), "line-filters-next")
        full = stepped.where("filter is null").select("shard")
        every = frequent(self._newest(refs, ["h1", "h2"], ["refs", "last_doc"])).select(_shard(self.shards).alias("shard"), "h1")
        larger = every.join(full, "shard", "left_semi").groupBy("shard").applyInPandas(lambda k, x: pd.DataFrame({"shard": np.array([k[0]], dtype=np.int32), "filter": [CuckooFilter.build(x["h1"].to_numpy()).to_bytes()]}), "shard int, filter binary")
        filters = stepped.where("filter is not null").unionByName(larger) if not full.isEmpty() else stepped
        filters = shared.saved(filters.withColumn("version", F.lit(version)), "line-filters")
        shared.drop(changes, stepped)
        own = ((version, postings),) if postings is not None else ()
        less = ((version, gone),) if gone is not None else ()
        return replace(self, posting_parts=self.posting_parts + own, gone_parts=self.gone_parts + less, ref_parts=refs, filter_parts=(*self.filter_parts, filters), version=version)

    def compact(self) -> LineIndex:
        """The same state in one part each, for when the parts have become many."""
        return self._of(shared.saved(self.postings, "line-postings"), self.shards, self.min_chars, self.min_docs)

    def probable(self) -> DataFrame:
        """The postings whose keys pass the filters: all of frequent keys, few others."""
        postings = self.postings
        size = self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
        if size <= BROADCAST_BYTES:
            held = postings.sparkSession.sparkContext.broadcast({r.shard: bytes(r.filter) for r in self.filters.collect()})
            return postings.mapInArrow(_Probe(held, self.shards), postings.schema)
        rows = postings.withColumn("shard", _shard(self.shards))
        columns = postings.columns
        sizes = sorted(rows.groupBy("shard").count().collect())  # one short row a shard
        spans = [-(-n // ROWS_A_TASK) for _, n in sizes]
        starts = np.concatenate(([0], np.cumsum(spans))).tolist()
        if not sizes:
            return postings
        places = postings.sparkSession.createDataFrame([(k, a, n) for (k, _), a, n in zip(sizes, starts, spans, strict=False)], "shard int, start int, span int")
        places = F.broadcast(places)  # as many rows as shards
        spread = rows.join(places, "shard").select((F.col("start") + F.pmod(F.xxhash64("doc_id", "h1"), "span")).cast("int").alias("task"), *columns, F.lit(None).cast("binary").alias("filter"))
        held = self.filters.join(places, "shard").select(F.explode(F.sequence("start", F.col("start") + F.col("span") - 1)).alias("task"), *[F.lit(None).cast("long").alias(c) for c in columns], "filter")
        dealt = spread.unionByName(held).repartitionById(starts[-1], "task").sortWithinPartitions(F.col("filter").isNull())
        return dealt.select(*columns, "filter").mapInArrow(_probe_own, postings.schema)

    def drops(self) -> DataFrame:
        """(doc_id, text_hash, keys): for each document the hashes of the keys whose lines it loses."""
        frequent = self.refs.where(F.col("refs") >= self.min_docs).select("h1", "h2", "last_doc")
        hits = shared.saved(self.probable().join(frequent, ["h1", "h2"]).select("h1", "h2", "doc_id", "text_hash", "last_doc"), "line-hits")
        held_by = hits.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("docs"))
        # saved, so that the join meets a table and can split a hot line
        found = shared.saved(held_by.where(F.col("docs") >= self.min_docs).select("h1", "h2"), "line-frequent")
        lost = hits.join(found, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
        return lost.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("h1", "h2")).alias("keys"))


class _Probe:
    def __init__(self, held, shards: int) -> None:
        self.held, self.shards = held, shards

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {k: CuckooFilter.from_bytes(v) for k, v in self.held.value.items()}
        for batch in batches:
            h1, shard = batch.column(0).to_numpy(), batch.column(1).to_numpy() % self.shards
            keep = np.zeros(len(h1), dtype=bool)
            for k in np.unique(shard):
                if int(k) in filters:
                    at = np.flatnonzero(shard == k)
                    keep[at] = filters[int(k)].contains(h1[at])
            yield batch.filter(pa.array(keep))


def _probe_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = None
    for batch in batches:
        filters = batch.column(batch.schema.get_field_index("filter"))
        if own is None and batch.num_rows and filters[0].is_valid:
            own = CuckooFilter.from_bytes(filters[0].as_py())
        rows = batch.filter(pa.array(filters.is_null()))
        if own is not None and rows.num_rows:
            rows = rows.filter(pa.array(own.contains(rows.column(0).to_numpy())))
            yield rows.select(["h1", "h2", "doc_id", "text_hash"])


def dedup_lines(docs: DataFrame, index: LineIndex, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs after the frequent lines went, with n_lines, n_dropped and kept_sha256 added.

    A text is split at \\n; null or empty is one empty line. The key of a line is the line
    without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased. Keys of at least min_chars code
    points in at least min_docs documents lose all their lines except in the largest doc_id
    that holds them (every repeated row with that doc_id keeps them). Null text stays null
    and its digest is that of the empty text; other columns are kept, those named like the
    three added ones are replaced.
    """
    min_chars = index.min_chars
    added = ("n_lines", "n_dropped", "kept_sha256")
    own = [F.col(f"d.`{c}`") for c in docs.columns if c not in added]
    lost = index.drops().select(F.col("doc_id").alias("lost_doc"), F.col("text_hash").alias("lost_hash"), F.col("keys").alias("lost_keys"))
    same = F.col(f"d.`{doc_id}`").cast("long").eqNullSafe(F.col("lost_doc")) & (F.xxhash64(F.col(f"d.`{text}`")) == F.col("lost_hash"))
    joined = docs.alias("d").join(lost, same, "left").select(*own, "lost_keys")
    fields = [f for f in joined.schema.fields if f.name != "lost_keys"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_lines long, n_dropped long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                spot, key_spot = batch.schema.get_field_index(text), batch.schema.get_field_index("lost_keys")
                texts, lines, dropped, digests = [], [], [], []
                for value, keys in zip(batch.column(spot).cast(pa.large_binary()), batch.column(key_spot), strict=True):
                    raw = value.as_py()
                    parts = (raw or b"").split(b"\n")
                    gone = 0
                    kept = raw or b""
                    if keys.is_valid:
                        values = keys.values.flatten()
                        pairs = np.stack([v.to_numpy() for v in values], axis=1)
                        lost_here = {x.tobytes() for x in pairs}
                        stay = [p for p, h in zip(parts, _long_keys(kept, min_chars), strict=True) if h not in lost_here]
                        gone, kept = len(parts) - len(stay), b"\n".join(stay)
                    texts.append(None if raw is None else kept)
                    lines.append(len(parts))
                    dropped.append(gone)
                    digests.append(hashlib.sha256(kept).hexdigest())
                columns = [pa.array(texts, pa.binary()).cast(pa.string()) if i == spot else batch.column(i) for i in range(batch.num_columns) if i != key_spot]
                names = [n for i, n in enumerate(batch.schema.names) if i != key_spot]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests)], names=[*names, *added])

    return joined.mapInArrow(run, schema)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read_texts(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")
    return dedup_lines(docs, LineIndex.build(docs)).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP6_SQL = """
WITH r AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM r),
k AS (SELECT r, doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d),
f AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
g AS (SELECT k.r, k.doc_id, k.i, k.line, f.key IS NOT NULL AND k.doc_id <> f.last_doc AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM g GROUP BY r, doc_id
"""
