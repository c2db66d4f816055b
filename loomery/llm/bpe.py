"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding with offsets."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import shared
from loomery.llm.arrays import row_slices, text_buffers
from loomery.llm.wordcache import WordCache

_LONG = 64


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank merges first, the leftmost of equals."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > _LONG:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2]) for i in range(len(word) - 1)]
    while True:
        best, at = None, -1
        for i, rank in enumerate(pairs):
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1])
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap and linked parts: n log n for words without breaks."""
    n = len(word)
    end = list(range(1, n + 1))  # end of the part that begins here, 0 once it is swallowed
    before = list(range(-1, n - 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the two parts has changed since
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (rank := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        if (j := before[i]) >= 0 and (rank := ranks.get(word[j:stop])) is not None:
            heapq.heappush(heap, (rank, j, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


@cache
def _encoder(path: str) -> WordCache:
    ranks = load_ranks(path)
    return WordCache(lambda words: [merge_word(w, ranks) for w in words])


@cache
def _tokens(path: str) -> tuple[list[bytes], np.ndarray]:
    """Bytes of every id and their lengths."""
    ranks = load_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table, np.array([len(t) for t in table], dtype=np.int64)


@cache
def _arena(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids one after the other, and where each begins."""
    table, lengths = _tokens(path)
    return np.frombuffer(b"".join(table), dtype=np.uint8), np.cumsum(lengths) - lengths


def offsets_of(ids: np.ndarray, path: str) -> np.ndarray:
    """Where in the UTF-8 text each id begins."""
    lengths = _tokens(path)[1][ids]
    return np.cumsum(lengths) - lengths


def decode_range(ids: np.ndarray, offsets: np.ndarray, path: str, begin: int = 0, end: int | None = None) -> bytes:
    """Bytes begin to end (by default all) of the text that has these ids at these offsets; only the ids that
    hold them are decoded, each put at its offset."""
    lo = max(int(np.searchsorted(offsets, begin, side="right")) - 1, 0)
    hi = len(ids) if end is None else int(np.searchsorted(offsets, end, side="left"))
    if lo >= hi:
        return b""
    arena, starts = _arena(path)
    own, first = ids[lo:hi], int(offsets[lo])
    lengths = _tokens(path)[1][own]
    out = np.zeros(int(offsets[hi - 1] - first + lengths[-1]), dtype=np.uint8)
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(offsets[lo:hi] - first, lengths) + within] = arena[np.repeat(starts[own], lengths) + within]
    return out[max(begin - first, 0) : None if end is None else end - first].tobytes()


def encode(docs: DataFrame, vocabulary: str | None = None, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs with ids (array<int>) and offsets (array<long>): where in the
    UTF-8 text each id begins.

    Ids are those of the public rank files' library with the public pattern and no special
    tokens. Null and empty texts have no ids; repeated rows are encoded one by one; columns
    named ids or offsets are replaced. vocabulary is a path that exists on every executor.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in ("ids", "offsets")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    shared.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids in _encoded(batches, path):
            cuts = pa.array([0, *accumulate(map(len, ids))], pa.int32())
            flat = np.concatenate(ids)
            spots = np.concatenate([offsets_of(x, path) for x in ids])
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(cuts, pa.array(flat.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(spots))], names=[*kept, "ids", "offsets"])

    return rows.mapInArrow(run, f"{schema}{', ' * bool(kept)}ids array<int>, offsets array<bigint>")


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of batches whose last column is the text, and the ids of their rows."""
    encoder = _encoder(path)
    for batch in batches:
        offsets, raw = text_buffers(batch.column(batch.num_columns - 1))
        for lo, ids in encoder.encode_column(offsets, raw, row_slices):
            yield batch.slice(lo, len(ids)), ids


def decode_ids(ids, path: str) -> bytes:
    """Bytes of a sequence of ids."""
    table = _tokens(path)[0]
    return b"".join(map(table.__getitem__, ids))


def decode(encoded: DataFrame, vocabulary: str | None = None, *, ids: str = "ids") -> DataFrame:
    """encoded with a column decoded (binary) added; null ids decode to null."""
    path = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    kept = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c != "decoded"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            for lo in range(0, batch.num_rows, 512):
                part = [None if not x.is_valid else decode_ids(x.values.to_numpy().tolist(), path) for x in lists.slice(lo, 512)]
                rest = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(part, pa.binary())], names=[*rest.schema.names, "decoded"])

    return kept.mapInArrow(run, f"{schema}, decoded binary")


def _decoded_sha256(ids: np.ndarray, path: str) -> str:
    offsets, digest = offsets_of(ids, path), hashlib.sha256()
    for lo in range(0, len(ids), 1 << 17):
        part = slice(lo, lo + (1 << 17))
        digest.update(decode_range(ids[part], offsets[part], path))
    return digest.hexdigest()


def digests(docs: DataFrame, vocabulary: str | None = None, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the bytes
    that the ids decode to): texts are encoded as by encode, and decoded from ids and offsets, in one pass."""
    path = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__text"))
    shared.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [str(i) for i in range(len(_tokens(path)[0]))]
        for part, ids in _encoded(batches, path):
            values = [x.tolist() for x in ids]
            coded = [hashlib.sha256(",".join(map(names.__getitem__, x)).encode()).hexdigest() for x in values]
            decoded = [_decoded_sha256(x, path) for x in ids]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in values], pa.int64()), pa.array(coded), pa.array(decoded)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(shared.read_texts(spark, f"{sf_dir}/documents.parquet", "doc_id", "text"))
