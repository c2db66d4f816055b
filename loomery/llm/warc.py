"""WARC: a deterministic sharded writer, its commit protocol, and a streaming reader.

Records are range-partitioned by key (cut points from range_bounds, so the same rows give
the same files), sorted inside each shard, written as one gzip member each, and rolled to a
new file once the compressed size reaches roll_bytes. Every file is written under a name of
its task attempt; the names of successful attempts go through a pending manifest that Spark
commits, then files are renamed (again safely after a lost executor) and the final manifest
appears. Readers take only what the manifest lists.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import shared

ROLL_BYTES = 256 << 20
MIN_REVISIT_BYTES = 100
_DATE = "1970-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = "file string, temp string, shard int, seq int, records long, bytes long, sha256 string"


def write_warc(pages: DataFrame, out: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", roll_bytes: int = ROLL_BYTES, shards: int | None = None, min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str = _DATE) -> DataFrame:
    """Writes one record for each row and returns the manifest.

    Payload is html in UTF-8 (null: empty). Of equal payloads of at least min_revisit_bytes
    the one with the smallest page_id is a response, the others are revisits of it; of
    repeated rows with that page_id one is, and the others are revisits of their own page. Rows with a null page_id sort last and
    are responses always. A null url becomes urn:page:<id>; line breaks in one are escaped.
    An empty table gives an empty manifest. Other columns of pages are not read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2(F.encode("html", "UTF-8"), 256), "size": F.octet_length("html")})
    keys = rows.where(F.col("size") >= min_revisit_bytes).where("page_id is not null").select("page_id", "digest")
    # saved, so that the join can split a payload that very many pages have
    firsts = shared.saved(keys.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-firsts")
    roles = keys.join(firsts, "digest")
    n = shards or shared.shard_count(spark, rows.agg(F.sum("size")).first()[0])
    bounds = shared.range_bounds(rows.select("page_id"), "page_id", n)
    stream = rows.select("page_id", "digest", "url", "html", F.lit(None).cast("long").alias("first_id")).unionByName(roles.select("page_id", "digest", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "first_id"))
    shard = shared.shard_udf(bounds)
    dealt = stream.withColumn("shard", shard("page_id")).repartitionById(len(bounds) + 1, "shard")
    # a role precedes the pages it is about
    ordered = dealt.sortWithinPartitions(F.asc_nulls_last("page_id"), "digest", F.desc_nulls_last("first_id"), F.asc_nulls_first("url"))
    pending = shared.saved(ordered.mapInArrow(_Writer(out, roll_bytes, date), _MANIFEST), "warc-pending")
    return shared.commit_files(pending, out, "warc-manifest")


def _safe(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


def _head(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _record_id(page: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page}/{digest}/{copy}')}>"


def warc_record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, copy: int, date: str) -> bytes:
    """One record with regenerated headers and digests; first is the response's page_id for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", _record_id(page, digest, copy)),
        ("WARC-Date", date),
        ("WARC-Target-URI", f"urn:page:{page}" if url is None else _safe(url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Page-ID", "" if page is None else str(page)),
    ]
    if first is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(first, digest, 0)), ("WARC-Refers-To-Page-ID", str(first))]
    fields.append(("Content-Length", str(len(block))))
    return _head(fields) + block + b"\r\n\r\n"


class _Writer:
    """Writes the sorted rows of one shard; yields a manifest row for each finished file."""

    def __init__(self, out: str, roll_bytes: int, date: str) -> None:
        self.out, self.roll_bytes, self.date = out, roll_bytes, date

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = shared.filesystem(self.out)
        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        sink, made, seq = None, [], 0
        role: tuple | None = None
        last, copy = None, 0
        for batch in batches:
            ids, digests, urls, firsts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "digest", "url", "first_id"))
            htmls = batch.column(batch.schema.get_field_index("html")).cast(pa.large_binary())
            for i, (page, digest, url, first) in enumerate(zip(ids, digests, urls, firsts, strict=True)):
                if first is not None:
                    role = (page, digest, first)
                    continue
                copy = copy + 1 if last == (page, digest) else 0
                last = (page, digest)
                refers = role[2] if role is not None and role[:2] == last else None
                if refers == page and copy == 0:
                    refers = None
                if sink is None:
                    fs.create_dir(f"{root}/_temporary", recursive=True)
                    name = f"part-{shard:06d}-{seq:05d}.warc.gz"
                    temp = f"_temporary/{name}.{attempt}"
                    sink, hasher, size, records = fs.open_output_stream(f"{root}/{temp}", compression=None), hashlib.sha256(), 0, 0
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(warc_record(page, url, htmls[i].as_py(), digest, refers, copy, self.date)) + packer.flush()
                sink.write(member)
                hasher.update(member)
                size, records = size + len(member), records + 1
                if size >= self.roll_bytes:
                    sink.close()
                    made.append((name, temp, shard, seq, records, size, hasher.hexdigest()))
                    sink, seq = None, seq + 1
        if sink is not None:
            sink.close()
            made.append((name, temp, shard, seq, records, size, hasher.hexdigest()))
        names = ["file", "temp", "shard", "seq", "records", "bytes", "sha256"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], names=names)


def read_warc(manifest: DataFrame, out: str) -> DataFrame:
    """The records of the files that a manifest lists, each file streamed by one task and checked.

    Columns: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload
    (null for a revisit), file, record_id. A record whose digests do not fit its content is
    an error, as is a file whose record count differs from the manifest.
    """
    n = shared.shuffle_width(manifest.sparkSession)
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, file string, record_id string"
    # the files are many more than the rows of the manifest are long: one task reads few of them
    return manifest.select("file", "records").repartition(n, "file").mapInArrow(_Reader(out), schema)


def iter_records(source, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every gzip member of a stream."""
    unpacker, data, rest = zlib.decompressobj(31), [], b""
    while True:
        piece = rest or source.read(chunk)
        if not piece:
            break
        data.append(unpacker.decompress(piece))
        rest = unpacker.unused_data
        if unpacker.eof:
            whole = b"".join(data)
            head, _, body = whole.partition(b"\r\n\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
            yield fields, body[: int(fields["content-length"])]
            unpacker, data = zlib.decompressobj(31), []
    if any(data):
        raise ValueError("the stream ends inside a record")


class _Reader:
    def __init__(self, out: str) -> None:
        self.out = out

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = shared.filesystem(self.out)
        for batch in batches:
            for file, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, seen = [], 0, 0
                with fs.open_input_stream(f"{root}/{file}", compression=None) as source:
                    for fields, block in iter_records(source):
                        row = self.row(fields, block, file)
                        rows.append(row)
                        held, seen = held + len(row["payload"] or b""), seen + 1
                        if held > 8 << 20 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                            rows, held = [], 0
                if seen != records:
                    raise ValueError(f"{file} holds {seen} records, its manifest says {records}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    @staticmethod
    def row(fields: dict[str, str], block: bytes, file: str) -> dict:
        http, _, payload = block.partition(b"\r\n\r\n")
        revisit, digest = fields["warc-type"] == "revisit", fields["warc-payload-digest"].partition(":")[2]
        size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
        if f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["warc-block-digest"]:
            raise ValueError(f"a block of {file} does not fit its digest")
        if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"a payload of {file} does not fit its digest")
        page, first = fields["warc-page-id"], fields.get("warc-refers-to-page-id")
        return {"page_id": int(page) if page else None, "url": fields["warc-target-uri"], "record_type": fields["warc-type"], "refers_to": int(first) if first else None, "payload_digest": digest, "payload_bytes": size, "payload": None if revisit else payload, "file": file, "record_id": fields["warc-record-id"]}


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("file", pa.string()), ("record_id", pa.string())])


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = shared.scratch(spark, "warc")
    manifest = write_warc(pages, out)
    return read_warc(manifest, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, page_id IS NOT NULL AND payload_bytes >= 100 AS alike,
    row_number() OVER (PARTITION BY payload_digest, page_id IS NULL ORDER BY page_id) AS place, min(page_id) OVER (PARTITION BY payload_digest) AS first_id
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN alike AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN alike AND place > 1 THEN first_id END AS refers_to
FROM f
"""
