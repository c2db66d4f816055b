"""Benchmark decontamination: one Aho-Corasick automaton over all item windows, each text scanned once.

Normal form: A-Z lower-cased, words are runs of [0-9a-z] and non-ASCII characters. The automaton reads word
ids, so a pattern is a window of ten symbols and begins and ends at word borders. Offsets of hit words lead
back into the original text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm import automaton, shared

#: Other ASCII bytes separate words; A-Z become a-z; bytes of non-ASCII characters stay.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_NORMAL_TABLE = np.frombuffer(NORMAL, dtype=np.uint8)

#: Bytes of item text that one automaton may hold: some 25 million states of 16 bytes, built by one task (1.4 GB for 20 MB), kept in one
#: file that the workers of a host map. A larger benchmark is cut into blocks, and every block is one more scan.
BLOCK_BYTES = 24 << 20

_loaded: dict[str, automaton.WordAutomaton] = {}


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


def _item_rows(items: DataFrame) -> DataFrame:
    """(item, normal) of the items that have words: the id as text and the words joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            normal = [b" ".join(normal_words(x)).decode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(normal, pa.string())], names=["item", "normal"])

    keyed = items.select(F.col("item").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text is not null")
    return keyed.mapInArrow(run, "item string, normal string").where("normal <> ''")


def decontaminate(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """Adds to every row of docs what it shares with the items.

    docs: any rows; null text has no words, repeated rows are answered one by one. items: null
    ids or texts match nothing, equal windows of several items count for all of them, an item
    of fewer than `window` words is one window, an item without words none. An empty side is
    allowed. Columns of docs stay as they are except those named like an added one, which are
    replaced: n_words, n_hit (words inside any occurrence), n_items, items_sha256 (of the
    item ids, sorted as strings, joined by commas), contaminated, and hits, an array of
    (start, end) code point offsets into the original text, one for each run of hit words.
    """
    spark = docs.sparkSession
    shared.bound_batches(spark)
    rows = _item_rows(items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{item_text}`").alias("text")))
    added = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hits array<struct<start:long,end:long>>"
    names = {x.split()[0] for x in added.split(", ") if " " in x}
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    schema = f"{_ddl(kept)}, {added}"
    total = rows.agg(F.sum(F.octet_length("normal"))).first()[0] or 0
    if not total:
        return kept.mapInArrow(_Answer(text, None), schema)
    n = 1 if total <= BLOCK_BYTES else -(-2 * total // BLOCK_BYTES)
    paths = _automata(rows, n, window)
    if n == 1:
        return kept.mapInArrow(_Answer(text, paths[0]), schema)
    body = F.col(f"`{text}`").cast("string")
    texts = kept.select(F.xxhash64(body).alias("text_hash"), F.md5(body).alias("text_sum"), body.alias("text")).where("text is not null")
    found = None
    for path in paths:
        scan = texts.mapInArrow(_Find(path), "text_hash long, text_sum string, found array<struct<first:long,last:long,items:array<string>>>")
        found = scan if found is None else found.unionByName(scan)
    found = found.distinct().groupBy("text_hash", "text_sum").agg(F.flatten(F.collect_list("found")).alias("found"))
    both = kept.alias("d").join(found.alias("f"), (F.xxhash64(F.col(f"d.`{text}`").cast("string")) == F.col("f.text_hash")) & (F.md5(F.col(f"d.`{text}`").cast("string")) == F.col("f.text_sum")), "left")
    return both.select(*[F.col(f"d.`{c}`") for c in kept.columns], F.col("f.found").alias("__found")).mapInArrow(_Answer(text, None, ready=True), schema)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _automata(rows: DataFrame, n: int, window: int) -> list[str]:
    """Files of the automata of n blocks of items, each built by one task."""
    spark = rows.sparkSession
    folder = shared.scratch(spark, "automata")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.select(["item", "normal"]) for b in batches]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        items, texts = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns)
        fs, root = shared.filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.arrow"  # an attempt that is lost leaves a file that nobody reads
        automaton.write(automaton.build(items, texts, window), fs, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])

    blocks = rows.coalesce(1) if n == 1 else rows.withColumn("block", F.pmod(F.xxhash64("item", "normal"), F.lit(n)).cast("int")).repartitionById(n, "block")
    return [r.path for r in blocks.mapInArrow(run, "path string").collect()]  # one a block


def _open(path: str | None) -> automaton.WordAutomaton | None:
    """The automaton of a file; a worker holds one at a time."""
    if path is not None and path not in _loaded:
        _loaded.clear()
        _loaded[path] = automaton.read(*shared.filesystem(path))
    return _loaded.get(path)


class _Find:
    """Matches of one block in the texts that have any."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _open(self.path)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("items", pa.list_(pa.string()))]))
        for batch in batches:
            found = automaton.matches(batch.column(2), own)[1]
            spots = sorted(found)
            rows = [[{"first": a, "last": b, "items": own.items_of(s)} for a, b, s in found[i]] for i in spots]
            take = pa.array(spots, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(rows, kind)], names=["text_hash", "text_sum", "found"])


class _Answer:
    """The added columns, from an automaton, or from the matches in the last column if they are ready."""

    def __init__(self, text: str, path: str | None, ready: bool = False) -> None:
        self.text, self.path, self.ready = text, path, ready

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _open(self.path)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                yield self.answer(whole.slice(at, 2048), own)

    def answer(self, batch: pa.RecordBatch, own: automaton.WordAutomaton | None) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index(self.text)).cast(pa.large_string())
        n_words, found = automaton.matches(texts, own)
        kept = batch
        if self.ready:
            kept = batch.select(range(batch.num_columns - 1))
            ready = batch.column(batch.num_columns - 1).to_pylist()
            found = {i: [(m["first"], m["last"], m["items"]) for m in x] for i, x in enumerate(ready) if x}
        covered = {i: _merge([(a, b) for a, b, _ in x]) for i, x in found.items()}
        ids = {i: sorted({name for s in {s if isinstance(s, int) else tuple(s) for _, _, s in x} for name in (own.items_of(s) if isinstance(s, int) else s)}) for i, x in found.items()}
        every = range(batch.num_rows)
        hit = [sum(b - a for a, b in covered.get(i, ())) for i in every]
        columns = [
            pa.array(n_words, pa.int64()),
            pa.array(hit, pa.int64()),
            pa.array([len(ids.get(i, ())) for i in every], pa.int64()),
            pa.array([hashlib.sha256(",".join(ids.get(i, ())).encode()).hexdigest() for i in every]),
            pa.array([h > 0 for h in hit]),
            pa.array([_offsets(texts[i].as_py().encode("utf-8", "surrogatepass"), covered[i]) if i in covered else [] for i in every], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ]
        names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits"]
        return pa.RecordBatch.from_arrays([*kept.columns, *columns], names=[*kept.schema.names, *names])


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _offsets(raw: bytes, covered: list[tuple[int, int]]) -> list[dict]:
    """Word ranges of the normal form as code point offsets of the original."""
    if not covered:
        return []
    data = np.frombuffer(raw, dtype=np.uint8)
    is_word = _NORMAL_TABLE[data] != 32
    edge = np.diff(np.concatenate(([0], is_word.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return [{"start": int(points[starts[a]]), "end": int(points[ends[b - 1]])} for a, b in covered]


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = shared.read_texts(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: Every run of as many words as some window has, compared as text.
OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), k AS (SELECT item, w, least(len(w), 10) AS size FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item, size, array_to_string(w[j : j + size - 1], ' ') AS run FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS j FROM k)),
h AS (SELECT r, j, size, array_to_string(w[j : j + size - 1], ' ') AS run FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS j FROM d, (SELECT DISTINCT size FROM k) WHERE len(w) >= size)),
f AS (SELECT h.r, h.j, h.size, g.item FROM h JOIN g ON g.run = h.run AND g.size = h.size),
c AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(j, j + size)) AS place FROM f) GROUP BY 1),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM f) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
