"""Operator 3, media columns: content-addressed payloads in tar shards.

A text's bytes, padded with zeros to rows of 64 samples, are stored as an 8-bit greyscale PNG named by the SHA-256 of
its samples. Each distinct payload is written once, into tar shards in the shared folder; rows carry its digest, shard,
offset and length. Metadata columns come from range reads of the 33 header bytes alone; features from reads of the
whole stored form.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .common import cut, portions, salted_join, table, text_or_empty

WIDTH = 64
#: Bytes after which a task begins another shard.
SHARD_BYTES = 256 << 20
#: The ids and digests of further copies are broadcast to the writers while they take up to so many bytes (ID_BYTES
#: each); beyond that they are joined by a shuffle.
BROADCAST_BYTES, ID_BYTES = 16 << 20, 64
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None) -> tuple[int, bytes]:
    """Bytes in the text (null: none), and those bytes padded with zeros to a positive multiple of WIDTH."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: bytes) -> bytes:
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1)  # filter 0 before each row
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first HEADER bytes of the stored form."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", head[16:25])


def decode_png(data: bytes) -> bytes:
    """The samples; for files that encode_png made (greyscale, 8 bits, filter 0), with their checksums verified."""
    width, height, _ = read_header(data)
    at, packed = 8, io.BytesIO()
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("damaged PNG")
        if kind == b"IDAT":
            packed.write(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(packed.getvalue()), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("unknown filter")
    return lines[:, 1:].tobytes()


class _Shards:
    """Tar shards of one task, written as a stream; a new one begins after SHARD_BYTES."""

    def __init__(self, folder: str):
        self.folder, self.out = folder, None

    def add(self, name: str, data: bytes) -> tuple[str, int]:
        """Shard and offset of the data."""
        if self.out is None:
            self.uri = f"{self.folder}/{uuid4().hex}.tar"
            self.out, self.at = store.open_new(self.uri), 0
        info = tarfile.TarInfo(name)
        info.size = len(data)
        self.out.write(info.tobuf(tarfile.USTAR_FORMAT) + data + b"\0" * (-len(data) % 512))
        place = self.uri, self.at + 512
        self.at += 512 + len(data) + -len(data) % 512
        if self.at >= SHARD_BYTES:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def _digest(text: Column) -> Column:
    """SHA-256 of payload(text), as binary."""
    size = F.octet_length(text)
    padding = F.when(size == 0, WIDTH).otherwise(F.pmod(-size, F.lit(WIDTH)))
    return F.unhex(F.sha2(F.concat(text, F.repeat(F.lit("\0"), padding)).cast("binary"), 256))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, digest (SHA-256 of the padded payload) of every row; a table that is kept."""
    text = text_or_empty()
    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), _digest(text).alias("digest")))


def store_payloads(docs: DataFrame, known: DataFrame, folder: str | None = None) -> DataFrame:
    """digest, uri, offset, length: one row for each distinct payload of docs, whose digests are `known`.

    Of equal payloads the row with the smallest doc_id writes; a payload that two tasks wrote all the same (rows equal
    in doc_id, null ids) is listed once. Failed attempts leave shards that no row names.
    """
    folder = folder or store.new_folder(docs.sparkSession, "media")
    copies = known.groupBy("digest").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    others = cut(known.join(copies, "digest").where("doc_id <> head").select(F.col("doc_id").alias("_other"), F.col("digest").alias("_same")))
    skip = F.broadcast(others) if others.count() * ID_BYTES <= BROADCAST_BYTES else others
    writers = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(skip, (F.col("doc_id") == F.col("_other")) & (_digest(text_or_empty()) == F.col("_same")), "left_anti")

    def run(batches):
        shards, seen = _Shards(folder), set()
        try:
            for batch in portions(batches):
                rows = []
                for t in batch.column("text"):
                    samples = payload(t.as_py())[1]
                    digest = hashlib.sha256(samples)
                    if digest.digest() in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(digest.digest())
                    stored = encode_png(samples)
                    rows.append((digest.digest(), *shards.add(f"{digest.hexdigest()}.png", stored), len(stored)))
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["digest", "uri", "offset", "length"])
        finally:
            shards.close()

    index = cut(writers.mapInArrow(run, "digest binary, uri string, offset long, length long"))
    least = F.min(F.struct("uri", "offset", "length"))
    return cut(index.groupBy("digest").agg(least.alias("at")).select("digest", "at.*")) if index.groupBy("digest").count().where("count > 1").limit(1).count() else index


def fill_metadata(index: DataFrame) -> DataFrame:
    """index with width, height and bits, from range reads of the headers alone."""
    schema = f"{', '.join(f'{n} {t}' for n, t in index.dtypes)}, width int, height int, bits int"

    def run(batches):
        reader = store.Reader()
        for batch in batches:
            found = [read_header(reader.read(u, o, HEADER)) for u, o in zip(batch.column("uri").to_pylist(), batch.column("offset").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[k] for f in found], pa.int32()) for k in range(3))], [*batch.schema.names, "width", "height", "bits"])
        reader.close()

    return index.mapInArrow(run, schema)


def features(samples: bytes) -> str:
    """Sum of samples, of differences between neighbours, and a histogram of 16 bins."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    bins = np.bincount(x >> 4, minlength=16)
    return f"{WIDTH}x{len(x) // WIDTH};sum={x.sum()};edge={np.abs(np.diff(x)).sum()};hist={','.join(map(str, bins.tolist()))}"


def read_payloads(index: DataFrame) -> DataFrame:
    """digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, uri, offset, length, width, height, bits."""
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        reader = store.Reader()
        for batch in batches:
            rows = []
            for digest, uri, offset, length in zip(*(batch.column(c).to_pylist() for c in ("digest", "uri", "offset", "length")), strict=True):
                stored = reader.read(uri, offset, length)
                samples = decode_png(stored)
                rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), features(samples)))
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            meta = ["uri", "offset", "length", "width", "height", "bits"]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), *(batch.column(m) for m in meta)], [*names, *meta])
        reader.close()

    return index.mapInArrow(run, "digest binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, uri string, offset long, length long, width int, height int, bits int")


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, n_bytes and the media columns of every row of docs.

    Null and empty texts have a payload of 64 zeros; equal texts share one payload; repeated rows and null doc_ids get
    their columns like any other; an empty table gives an empty result. doc_ids are cast to long. Other columns of docs
    are not read. The rows of a payload that very many documents share are parted among tasks.
    """
    known = digests(docs)
    found = cut(read_payloads(fill_metadata(store_payloads(docs, known, folder))))
    return salted_join(known, found, ["digest"], known.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), known.count(), F.col("doc_id"))


def op3_tar_shards(spark, sf_dir: str) -> DataFrame:
    out = media_columns(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "uri", "offset", "length", "width", "height")
