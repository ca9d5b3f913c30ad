"""Media columns: content-addressed payloads in tar shards; rows carry digest, offset and length.

A payload is stored as an 8-bit grey PNG image, 64 samples wide, and each different payload once in the whole store:
payloads with copies meet by digest before they are written, those without go straight from their task to its shard.
Metadata columns come from the images' first 33 bytes, read as ranges; features from the samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_few, fresh_path, materialize, open_store, slices

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33
#: Payloads with copies that are told to all tasks at most (some 100 bytes each); beyond, all payloads meet by digest.
BROADCAST_ROWS = 300_000


def padded(raw: bytes) -> bytes:
    """raw with bytes 0 appended up to a positive multiple of WIDTH."""
    return raw + bytes(-len(raw) % WIDTH or WIDTH * (not raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 6) -> bytes:
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # each row starts with filter 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def png_size(head: bytes) -> tuple[int, int]:
    """Width and height from the first HEADER bytes of a PNG file; ValueError if they aren't those of 8-bit grey."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or head[24:26] != b"\x08\x00":
        raise ValueError("not an 8-bit grey PNG")
    return struct.unpack(">II", head[16:24])


def from_png(stored: bytes) -> bytes:
    width, height = png_size(stored[:HEADER])
    body, at = [], 8
    while at < len(stored):
        (n,), kind = struct.unpack(">I", stored[at : at + 4]), stored[at + 4 : at + 8]
        if kind == b"IDAT":
            body.append(stored[at + 8 : at + 8 + n])
        at += n + 12
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("only rows without a filter are read")
    return rows[:, 1:].tobytes()


def _tar_header(name: str, size: int) -> bytes:
    """A ustar header; sizes from 8 GiB in base 256."""
    octal = f"{size:011o}".encode() + b"\0" if size < 1 << 33 else b"\x80" + size.to_bytes(11, "big")
    head = bytearray(512)
    head[0 : len(name)] = name.encode()
    head[100:108], head[108:116], head[116:124] = b"0000644\0", b"0000000\0", b"0000000\0"
    head[124:136], head[136:148], head[148:156] = octal, b"00000000000\0", b" " * 8
    head[156:157], head[257:265] = b"0", b"ustar\x0000"
    head[148:156] = f"{sum(head):06o}".encode() + b"\0 "
    return bytes(head)


@dataclass
class Store:
    """rows: key, n_bytes, payload (SHA-256 of the payload), one for each input row; addresses: payload, digest (SHA-256
    of the stored form), folder, shard, offset, length, one for each different payload. Both are written tables."""

    rows: DataFrame
    addresses: DataFrame


def store(docs: DataFrame, folder: str | None = None, text: str = "text", key: str = "doc_id", level: int = 6, broadcast_rows: int = BROADCAST_ROWS) -> Store:
    """Write every different payload once.

    Repeated rows and null keys have rows of their own; a null text counts as empty. A shard's name has the task
    attempt in it, and only the addresses of tasks that ended well are kept, so a lost or repeated task leaves at
    most an unused file.
    """
    folder = folder or fresh_path(docs.sparkSession, "media")
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    named = docs.select(F.col(key).alias("k"), raw.alias("raw")).select("k", "raw", F.octet_length("raw").cast("long").alias("n_bytes"))
    named = named.withColumn("payload", F.unhex(F.sha2(F.expr(f"rpad(raw, cast(greatest(1, ceil(n_bytes / {WIDTH})) * {WIDTH} as int), X'00')"), 256)))
    rows = materialize(named.select("k", "n_bytes", "payload"), "media-rows")
    copied = broadcast_if_few(materialize(rows.groupBy("payload").agg(F.count("*").alias("n")).filter("n > 1").select("payload"), "media-copies"), broadcast_rows)

    def run(batches):
        task, out, at = TaskContext.get(), None, 0
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.tar"
        fs, base = open_store(folder)
        try:
            for batch in slices(batches, "raw"):
                places = []
                for content in batch.column("raw").to_pylist():
                    stored = to_png(padded(content), level)
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(f"{base}/{name}")
                    digest = hashlib.sha256(stored).digest()
                    out.write(_tar_header(f"{digest.hex()}.png", len(stored)) + stored + bytes(-len(stored) % 512))
                    places.append((digest, at + 512, len(stored)))
                    at += 512 + len(stored) + -len(stored) % 512
                digest, offset, length = zip(*places, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("payload"), pa.array(digest, pa.binary()), pa.array([folder] * len(places)), pa.array([name] * len(places)), pa.array(offset, pa.int64()), pa.array(length, pa.int64())],
                    ["payload", "digest", "folder", "shard", "offset", "length"],
                )
            if out is not None:
                out.write(bytes(1024))
        finally:
            if out is not None:
                out.close()

    texts = named.select("payload", "raw")
    single = texts.join(copied, "payload", "left_anti")
    # copies meet after each task has put its own ones together
    merged = texts.join(copied, "payload", "left_semi").groupBy("payload").agg(F.first("raw").alias("raw"))
    schema = "payload binary, digest binary, folder string, shard string, offset bigint, length bigint"
    written = single.select("payload", "raw").mapInArrow(run, schema).union(merged.select("payload", "raw").mapInArrow(run, schema))
    return Store(rows.withColumnRenamed("k", key), materialize(written, "media-addresses"))


def _ranges(addresses: DataFrame, read, names: list[str], schema: str) -> DataFrame:
    """read(file, offset, length, digest) for every address, in the order of the shards."""

    def run(batches):
        at, file = None, None
        for batch in batches:
            found = []
            for digest, folder, shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("digest", "folder", "shard", "offset", "length")), strict=True):
                if at != (folder, shard):
                    if file:
                        file.close()
                    fs, base = open_store(folder)
                    at, file = (folder, shard), fs.open_input_file(f"{base}/{shard}")
                found.append(read(file, offset, length, digest))
            if found:
                fields = dict(zip(names, zip(*found, strict=True), strict=True))
                yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names} | fields)
        if file:
            file.close()

    parts = int(addresses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = addresses.repartitionByRange(parts, "folder", "shard", "offset").sortWithinPartitions("folder", "shard", "offset")
    return placed.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in addresses.schema.fields) + f", {schema}")


def headers(addresses: DataFrame) -> DataFrame:
    """addresses with media_width and media_height, from reads of HEADER bytes."""
    return _ranges(addresses, lambda file, offset, length, digest: png_size(file.read_at(HEADER, offset)), ["media_width", "media_height"], "media_width bigint, media_height bigint")


def feature(samples: np.ndarray) -> str:
    """Mean, deviation, entropy, mean step and an 8-bin histogram of the samples."""
    counts = np.bincount(samples, minlength=256)
    shares = counts[counts > 0] / len(samples)
    step = np.abs(np.diff(samples.astype(np.int16))).mean() if len(samples) > 1 else 0.0
    bins = counts.reshape(8, 32).sum(axis=1) / len(samples)
    return ",".join(f"{x:.4f}" for x in (samples.mean(), samples.std(), -(shares * np.log2(shares)).sum(), step, *bins))


def contents(addresses: DataFrame) -> DataFrame:
    """addresses with what each holds: payload_bytes, payload_sha256, tail_crc32, feature.

    Stored bytes that differ from their digest raise ValueError.
    """

    def read(file, offset, length, digest):
        stored = file.read_at(length, offset)
        if hashlib.sha256(stored).digest() != digest:
            raise ValueError(f"damaged payload {digest.hex()}")
        payload = from_png(stored)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), feature(np.frombuffer(payload, np.uint8))

    return _ranges(addresses, read, ["payload_bytes", "payload_sha256", "tail_crc32", "feature"], "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, feature string")
