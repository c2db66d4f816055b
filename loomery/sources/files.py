"""Listings of media files, embedded text chunks, sidecars, model inventories, catalogs and snapshots."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from datetime import datetime
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions import text

# Media extensions and byte budgets of embedded text.
IMAGES = ["png", "jpg", "jpeg", "webp"]
VIDEOS = ["mp4", "webm", "mov", "m4v", "mkv"]
MAX_CHUNK_BYTES = 16 << 20
MAX_SIDECAR_BYTES = 2 << 20


def list_media(spark: SparkSession, root: str, since: datetime | None = None) -> DataFrame:
    """(path, size, modified, media_type) below root without thumbnails, newer than since if given. Contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if since is not None:
        reader = reader.option("modifiedAfter", since.strftime("%Y-%m-%dT%H:%M:%S"))
    return classify_files(reader.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")))


def classify_files(listing: DataFrame) -> DataFrame:
    """Media files of a listing with media_type; thumbnail folders and other files go."""
    extension = F.lower(F.element_at(F.split("path", r"\."), -1))
    kind = F.when(extension.isin(IMAGES), "image").when(extension.isin(VIDEOS), "video")
    return listing.withColumn("media_type", kind).filter(F.col("media_type").isNotNull() & ~F.lower("path").rlike(r"[/\\]\.?thumb(?:nail)?s?[/\\]"))


def high_water(listing: DataFrame) -> DataFrame:
    return listing.agg(F.max("modified").alias("cursor"))


def png_chunks(data: bytes) -> dict[str, str]:
    """Text chunks of a PNG (tEXt, zTXt, iTXt) within the byte budget."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    out, at, left = {}, 8, MAX_CHUNK_BYTES
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IEND":
            break
        if kind not in (b"tEXt", b"zTXt", b"iTXt") or size > left:
            continue
        key, _, rest = body.partition(b"\0")
        if kind == b"zTXt":
            rest = _inflate(rest[1:], left)
        elif kind == b"iTXt":
            packed, (_, _, rest) = rest[:1] == b"\1", (rest[2:].partition(b"\0")[0], b"", rest[2:].partition(b"\0")[2].partition(b"\0")[2])
            rest = _inflate(rest, left) if packed else rest
        left -= len(rest)
        out[key.decode("latin-1")] = rest.decode("utf-8" if kind == b"iTXt" else "latin-1", "replace")
    return out


def _inflate(data: bytes, limit: int) -> bytes:
    tool = zlib.decompressobj()
    out = tool.decompress(data, limit)
    if tool.unconsumed_tail:
        raise ValueError("a text chunk is over its budget")
    return out


def jpeg_comment(data: bytes) -> dict[str, str]:
    """Comment and EXIF user comment of a JPEG, as far as they are text."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    out, at = {}, 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xFE:
            out["comment"] = body.decode("utf-8", "replace")
        elif data[at + 1] == 0xE1 and (spot := body.find(b"UNICODE\0")) >= 0:
            out["parameters"] = body[spot + 8 :].decode("utf-16-be", "replace").rstrip("\0")
        at += 2 + size
    return out


def webp_chunks(data: bytes) -> dict[str, str]:
    """XMP and EXIF user comment of a WebP."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    out, at = {}, 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        if kind == b"XMP ":
            out["xmp"] = body.decode("utf-8", "replace")
        elif kind == b"EXIF" and (spot := body.find(b"UNICODE\0")) >= 0:
            out["parameters"] = body[spot + 8 :].decode("utf-16-be", "replace").rstrip("\0")
        at += 8 + size + size % 2
    return out


def read_chunks(files: DataFrame) -> DataFrame:
    """(path, chunks map, error) of binaryFile rows (path, content); a bad file is a row with an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, data in zip(frame["path"], frame["content"], strict=True):
                read = png_chunks if data[:4] == b"\x89PNG" else webp_chunks if data[:4] == b"RIFF" else jpeg_comment
                try:
                    rows.append((path, read(bytes(data)), None))
                except (ValueError, struct.error, zlib.error) as bad:
                    rows.append((path, None, str(bad)))
            yield pd.DataFrame(rows, columns=["path", "chunks", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, chunks map<string,string>, error string")


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(base, json) of *.workflow.json files within the size limit, to be joined by base name."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.workflow.json").load(root)
    return rows.filter(F.col("length") <= MAX_SIDECAR_BYTES).select(F.regexp_replace(text.basename(F.col("path")), r"\.workflow\.json$", "").alias("base"), F.decode("content", "UTF-8").alias("json"))


def model_inventory(listing: DataFrame) -> DataFrame:
    """Model files of a listing with their type by folder; unsupported folders go."""
    models = listing.filter(F.lower("path").rlike(text.ASSET_EXTENSION))
    return models.withColumns({"type": text.model_file_type(F.col("path")), "name": text.clean_name(F.col("path"))}).filter("type is not null")


def hash_cache(spark: SparkSession, path: str) -> DataFrame:
    """(name, hash, modified) of a cache file {"hashes": {name: {"sha256", "mtime"}}}."""
    kind = "struct<hashes: map<string, struct<sha256: string, mtime: double>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)["hashes"]).alias("name", "entry"))
    return rows.select("name", F.lower("entry.sha256").alias("hash"), F.col("entry.mtime").alias("modified")).filter("hash is not null")


def catalog(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int = 16, **options: str) -> DataFrame:
    """A table of an external catalog read in ranges of a numeric column instead of by offset."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, **options)
    return reader.load()


def since_mark(rows: DataFrame, mark: Column, *columns: str) -> DataFrame:
    """Rows created or updated after the high-water mark."""
    return rows.filter(F.greatest(*[F.coalesce(c, F.lit(datetime(1970, 1, 1))) for c in columns]) > mark)


def boards(boards_table: DataFrame, members: DataFrame, owner: str | None = None) -> DataFrame:
    """Boards of an owner (or all) with their members."""
    rows = boards_table if owner is None else boards_table.filter(F.col("owner_id") == owner)
    return rows.join(members, "board_id")


def owners(rows: DataFrame, users: DataFrame) -> DataFrame:
    """(owner_id, count, user_name): owners without a user row stay."""
    return rows.groupBy("owner_id").agg(F.count("*").alias("count")).join(users.select("owner_id", "user_name"), "owner_id", "left")


def diagnostics(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, count) for every column in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(pairs.alias("p")).select("p.*").groupBy("field", "value").agg(F.count("*").alias("count"))


def output_roots(listing: DataFrame, depth: int = 4) -> DataFrame:
    """Folders at most depth below the root that look like generator output folders."""
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    marks = F.lower(folder).rlike(r"/(txt2img|img2img|extras)-(images|grids)(/|$)|/outputs?(/|$)")
    return listing.select(folder.alias("folder")).distinct().filter(marks & (F.size(F.split("folder", "/")) <= depth + 3))


def export(rows: DataFrame, out: str) -> None:
    """Rows as Parquet and a manifest as JSON beside them."""
    rows.write.parquet(f"{out}/rows")
    rows.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(json.dumps(rows.columns))).write.json(f"{out}/manifest")


def snapshot(tables: dict[str, DataFrame], root: str, stamp: datetime) -> str:
    """A dated copy of all tables below root; older ones are pruned by their names elsewhere."""
    out = f"{root}/snapshot-{stamp:%Y%m%d-%H%M%S}"
    for name, df in tables.items():
        df.write.parquet(f"{out}/{name}")
    return out


def expired(names: list[str], keep: int) -> list[str]:
    """Snapshot names beyond the newest keep."""
    return sorted((n for n in names if n.startswith("snapshot-")), reverse=True)[keep:]


def prune(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Deletes all but the newest keep snapshots below root; returns the names that went."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = expired([x.getPath().getName() for x in fs.listStatus(path)], keep)
    for name in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path, name), True)
    return gone


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, count) of every table of a catalog, in one job."""
    counts = [df.agg(F.count("*").alias("count")).select(F.lit(name).alias("table"), "count") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)
