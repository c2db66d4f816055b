"""Token ids in binary files: frequency-ranked, byte-aligned variable-length codes, separate control bytes.

Ids are replaced by their rank in the whole corpus, so the most frequent ones take one byte.
A control byte holds the lengths of four codes (two bits each, length less one), the data
bytes hold the codes, low byte first. A document's codes begin at a byte of their own in
both, so documents are copied into files without being coded again. A file is a row of
blocks; a block is a header, a table of its documents, their control bytes, their data.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import shared
from loomery.llm.arrays import row_slices, text_buffers
from loomery.llm.wordcache import WordCache

END_ID = 2
MAGIC = b"RANKVB01"
BLOCK_BYTES = 4 << 20
ROLL_BYTES = 256 << 20

_HEAD = struct.Struct("<QQQ")  # documents, control bytes, data bytes
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<u8"), ("data", "<u8")])

#: Lengths of the four codes of every control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


@cache
def _tokenizer(path: str) -> tuple[WordCache, int]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    # the library's model reads a pre-token as one printable character a byte: printable Latin-1
    # stands for itself, the other bytes follow in order from U+0100 on
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(256)) - set(plain))
    shown = {b: b for b in plain} | {b: 0x100 + i for i, b in enumerate(others)}
    tokenize = tokenizer.model.tokenize
    return WordCache(lambda words: [[t.id for t in tokenize(w.decode("latin-1").translate(shown))] for w in words]), tokenizer.get_vocab_size()


@cache
def _added(path: str) -> tuple[list[str], re.Pattern | None, dict[str, int]]:
    """Contents of the added tokens of a tokenizer file, a pattern that finds them (longest first, with the white
    space they take), and their ids."""
    with open(path, encoding="utf-8") as source:
        tokens = sorted((t for t in json.load(source)["added_tokens"] if t["content"]), key=lambda t: -len(t["content"]))
    if not tokens:
        return [], None, {}

    def found(t: dict) -> str:
        body = re.escape(t["content"])
        body = rf"(?<!\w){body}(?!\w)" if t.get("single_word") else body
        return (r"\s*" if t.get("lstrip") else "") + f"(?P<t{t['id']}>{body})" + (r"\s*" if t.get("rstrip") else "")

    return [t["content"] for t in tokens], re.compile("|".join(map(found, tokens))), {f"t{t['id']}": t["id"] for t in tokens}


def encode_around(text: str, words: WordCache, path: str) -> np.ndarray:
    """Ids of a text cut at its added tokens before it is split into words."""
    _, pattern, known = _added(path)
    parts, between, at = [], [], 0
    for m in pattern.finditer(text):
        parts.append(text[at : m.start()])
        between.append(known[m.lastgroup])
        at = m.end()
    parts.append(text[at:])
    offsets, raw = text_buffers(pa.array(parts, pa.large_string()))
    ids = [x for _, part in words.encode_column(offsets, raw, row_slices) for x in part]
    out = [ids[0]]
    for token, x in zip(between, ids[1:], strict=True):
        out += [np.array([token], dtype=np.uint32), x]
    return np.concatenate(out)


def id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, doc_id: str, text: str, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, tie, n, ids): ids as little-endian unsigned integers (16 bits if they fit) with end_id appended, saved."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("tie"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_, size = _tokenizer(vocabulary)
        kind = id_type(max(size, end_id + 1))
        for batch in batches:
            offsets, raw = text_buffers(batch.column(2))
            holds = np.zeros(batch.num_rows, dtype=bool)
            for content in _added(vocabulary)[0]:
                holds |= pc.fill_null(pc.match_substring(batch.column(2), content), False).to_numpy(zero_copy_only=False)
            for lo, ids in cache_.encode_column(offsets, raw, row_slices):
                part = batch.slice(lo, len(ids))
                for i in np.flatnonzero(holds[lo : lo + len(ids)]).tolist():
                    ids[i] = encode_around(part.column(2)[i].as_py(), cache_, vocabulary)
                ended = [np.append(x, np.uint32(end_id)).astype(kind) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in ended], pa.int64()), pa.array([x.tobytes() for x in ended], pa.large_binary()).cast(pa.binary())], names=["doc_id", "tie", "n", "ids"])

    return shared.saved(rows.mapInArrow(run, "doc_id long, tie long, n long, ids binary"), "token-ids", compression="zstd")


def rank_table(coded: DataFrame, vocabulary_size: int) -> np.ndarray:
    """Ids in order of falling frequency over all documents, ties by id; as many as the vocabulary has."""

    kind = id_type(vocabulary_size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary_size, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                np.add.at(total, np.frombuffer(value.as_buffer(), dtype=kind), 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], names=["id", "n"])

    counts = coded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # as long as the vocabulary
    total = np.zeros(vocabulary_size, dtype=np.int64)
    total[counts["id"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy(dtype=np.int64)
    return np.lexsort((np.arange(vocabulary_size), -total)).astype("<u4")


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of a sequence of ranks."""
    ranks = ranks.astype(np.uint32)
    lens = 1 + (ranks >= 1 << 8).astype(np.int64) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    codes[: len(ranks)] = lens - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(1, dtype=np.uint8)
    keep = np.arange(4) < lens[:, None]
    return control.tobytes(), ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks of control and data bytes, their lengths looked up for whole control bytes."""
    lens = LENGTHS[control].ravel()[:n]
    keep = np.arange(4) < lens[:, None]
    out = np.zeros((n, 4), dtype=np.uint8)
    out[keep] = data
    return out.view("<u4").ravel()


def write_tokens(docs: DataFrame, out: str, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = END_ID, shards: int | None = None, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the ids of all rows in ascending doc_id order to files below out; returns the manifest.

    Null and empty texts give the end id alone. Rows of equal doc_id follow each other in the
    order of a hash of their text; rows with a null doc_id come last. The tokenizer's added
    tokens are found in texts, as the library's encode does. Other columns are not read. An empty table gives an empty
    manifest. Files sorted by name are in document order.
    """
    spark = docs.sparkSession
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    coded = tokenize(docs, doc_id, text, path, end_id)
    size = max(_tokenizer(path)[1], end_id + 1)
    by_rank = rank_table(coded, size)
    fs, root = shared.filesystem(out)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/ranks.u32", compression=None) as sink:
        sink.write(by_rank.tobytes())
    ranks = np.empty(size, dtype=np.uint32)
    ranks[by_rank] = np.arange(size, dtype=np.uint32)
    kind = id_type(size)
    sent = spark.sparkContext.broadcast(ranks)  # as long as the vocabulary

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                pairs = [pack(sent.value[np.frombuffer(x.as_buffer(), dtype=kind)]) for x in part.column(3)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([a for a, _ in pairs], pa.binary()), pa.array([b for _, b in pairs], pa.binary())], names=["doc_id", "tie", "n", "control", "data"])

    packed = coded.mapInArrow(code, "doc_id long, tie long, n long, control binary, data binary")
    bounds = shared.range_bounds(coded, "doc_id", shards or shared.shard_count(spark, coded.agg(F.sum("n")).first()[0]))
    dealt = packed.withColumn("shard", shared.shard_udf(bounds)("doc_id")).repartitionById(len(bounds) + 1, "shard")
    ordered = dealt.sortWithinPartitions(F.asc_nulls_last("doc_id"), "tie").select("doc_id", "n", "control", "data")
    manifest = "file string, temp string, shard int, seq int, docs long, ids long, bytes long, sha256 string"
    return shared.commit_files(shared.saved(ordered.mapInArrow(_Writer(out, roll_bytes), manifest), "tokens-pending"), out, "tokens-manifest")


class _Writer:
    """Writes the rows of one shard as blocks; yields a manifest row for each file."""

    def __init__(self, out: str, roll_bytes: int) -> None:
        self.out, self.roll_bytes = out, roll_bytes

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = shared.filesystem(self.out)
        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        made, sink, held = [], None, 0
        table, controls, datas = [], [], []

        def put(piece: bytes) -> None:
            sink.write(piece)
            hasher.update(piece)
            row[6] += len(piece)

        def flush() -> None:
            if table:
                control, data = b"".join(controls), b"".join(datas)
                put(_HEAD.pack(len(table), len(control), len(data)))
                for piece in (np.array(table, dtype=_DOC).tobytes(), control, data):
                    put(piece)
                row[4] += len(table)
                row[5] += sum(x[2] for x in table)
                for x in (table, controls, datas):
                    x.clear()

        for batch in batches:
            for key, n, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    fs.create_dir(f"{root}/_temporary", recursive=True)
                    name = f"part-{shard:06d}-{len(made):05d}.tok"
                    row = [name, f"_temporary/{name}.{attempt}", shard, len(made), 0, 0, 0, ""]
                    sink, hasher, held = fs.open_output_stream(f"{root}/{row[1]}", compression=None), hashlib.sha256(), 0
                    put(MAGIC)
                table.append((0 if key is None else key, key is None, n, len(data)))
                controls.append(control)
                datas.append(data)
                held += len(control) + len(data) + _DOC.itemsize
                if held >= BLOCK_BYTES:
                    flush()
                    held = 0
                    if row[6] >= self.roll_bytes:
                        sink.close()
                        made.append((*row[:7], hasher.hexdigest()))
                        sink = None
        if sink is not None:
            flush()
            sink.close()
            made.append((*row[:7], hasher.hexdigest()))
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = ["file", "temp", "shard", "seq", "docs", "ids", "bytes", "sha256"]
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)], names=names)


def read_blocks(source) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document table, control bytes, data bytes) of every block of a file."""
    if source.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    while head := source.read(_HEAD.size):
        docs, control, data = _HEAD.unpack(head)
        table = np.frombuffer(source.read(docs * _DOC.itemsize), dtype=_DOC)
        yield table, np.frombuffer(source.read(control), dtype=np.uint8), np.frombuffer(source.read(data), dtype=np.uint8)


def read_tokens(manifest: DataFrame, out: str, digest_only: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of all documents in the files of a manifest.

    start counts the ids of all documents before. ids (array<int>) is left out if digest_only.
    One task streams a file block by block.
    """
    rows = manifest.select("file", "ids").orderBy("file").collect()  # one short row a file
    before, starts = 0, []
    for r in rows:
        starts.append((r.file, before))
        before += r.ids
    files = manifest.sparkSession.createDataFrame(starts, "file string, before long")
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *([] if digest_only else ["ids"])]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), *([] if digest_only else [pa.list_(pa.int32())])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = shared.filesystem(out)
        with fs.open_input_stream(f"{root}/ranks.u32", compression=None) as source:
            by_rank = np.frombuffer(source.read(), dtype="<u4")
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{file}", compression=None) as source:
                    for table, control, data in read_blocks(source):
                        found, c, d = [], 0, 0
                        for key, null, n, size in table.tolist():
                            width = -(-n // 4)
                            ids = by_rank[unpack(control[c : c + width], data[d : d + size], n)]
                            found.append((None if null else key, start, n, zlib.crc32(ids.tobytes()), *([] if digest_only else [ids.astype(np.int32)])))
                            start, c, d = start + n, c + width, d + size
                        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)], names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<int>")
    return files.repartition(shared.shuffle_width(manifest.sparkSession), "file").mapInArrow(run, schema)


def op5_token_id_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read_texts(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")
    out = shared.scratch(spark, "tokens")
    return read_tokens(write_tokens(docs, out), out, digest_only=True)
