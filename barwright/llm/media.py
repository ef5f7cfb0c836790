"""Media columns: content-addressed payloads in tar shards.

A payload is stored as a grey 8-bit PNG image, one byte a sample, ``WIDTH`` samples a row, as a member of a tar shard named by the
payload's SHA-256. Rows carry digest, shard, offset and length. Each task stores a payload once in its shard and points all rows with that
payload to it; ``index`` gives one place per digest over all shards. Header-only range reads (``HEADER`` bytes a member) fill the
metadata columns. Shards are cut at ``SHARD_BYTES``, so memory is bounded by a payload and a batch.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barwright.llm.files import Reader, Writer
from barwright.llm.shared import keep, scratch_path

UNIT, WIDTH = 576, 576
HEADER = 33  # signature and first chunk of a PNG
SHARD_BYTES = 64 << 20
STRETCH, TASK_BYTES = 4 << 20, 32 << 20
MAGIC = b"\x89PNG\r\n\x1a\n"
LEVEL = 6


def payload(text: str | bytes | None) -> bytes:
    """UTF-8 of a text, filled with bytes 255 to a positive multiple of UNIT; null is empty."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw + b"\xff" * (UNIT - len(raw) % UNIT if len(raw) % UNIT or not raw else 0)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(samples: bytes) -> bytes:
    """PNG of a payload: each row of samples behind a filter byte 0."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    return MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(
        b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header(head: bytes) -> tuple[str, int, int, int]:
    """Format, width, height and bits of a sample from the first HEADER bytes."""
    if head[:8] != MAGIC or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not a PNG header")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return "png", width, height, bits


def decode(data: bytes) -> bytes:
    """The payload of a PNG that ``encode`` wrote; every chunk's checksum is tested."""
    _, width, height, _ = header(data[:HEADER])
    at, body = 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at:at + 4])
        kind, part = data[at + 4:at + 8], data[at + 8:at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n:at + 12 + n])[0] != zlib.crc32(kind + part):
            raise ValueError("a chunk of the image is damaged")
        if kind == b"IDAT":
            body.append(part)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only filter 0 is read")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """A 64-bit average hash in hexadecimal: which of 64 equal stretches of the samples lie above the mean of all."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    part = x.reshape(64, -1).sum(axis=1)  # UNIT is a multiple of 64
    return np.packbits(part * 64 > part.sum()).tobytes().hex()


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Write payloads of texts to tar shards in ``folder``. Per row: doc_id, n_bytes, digest, shard, offset, length, held in a table in the
    shared folder, so that its rows and the shards they name stay together.

    Null and empty texts are one payload. Repeated texts share a digest. Extra columns are left out.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, places = None, {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                raw = text.as_py() or b""
                body = payload(raw)
                digest = hashlib.sha256(body).hexdigest()
                if digest not in places:
                    if out is None or out.size >= SHARD_BYTES:
                        if out is not None:
                            _finish(out)
                        out, places = Writer(folder, ".tar"), {}
                    image = encode(body)
                    info = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
                    info.size = len(image)
                    out.write(info.tobuf(tarfile.USTAR_FORMAT))
                    places[digest] = out.name, out.write(image), len(image)
                    out.write(b"\0" * (-len(image) % 512))
                rows.append((doc_id, len(raw), digest, *places[digest]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        if out is not None:
            _finish(out)

    names = ["doc_id", "n_bytes", "digest", "shard", "offset", "length"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        each, "doc_id long, n_bytes long, digest string, shard string, offset long, length long")
    return keep(rows, "media")[0]


def _finish(out: Writer) -> None:
    out.write(b"\0" * 1024)
    out.close()


def index(rows: DataFrame) -> DataFrame:
    """One row per digest: the first of its places by shard and offset."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def _near(rows: DataFrame) -> DataFrame:
    """Rows dealt by stretches of shards, in the order of their offsets. The rows are small and the bytes they name are not, so the number of
    tasks comes from the latter."""
    stored = rows.agg(F.sum("length")).first()[0] or 0
    return (rows.withColumn("stretch", F.expr(f"offset div {STRETCH}")).repartition(max(1, -(-stored // TASK_BYTES)), "shard", "stretch")
            .sortWithinPartitions("shard", "offset").drop("stretch"))


def with_metadata(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` of ``store`` with format, width, height, bits, from reads of HEADER bytes each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for batch in batches:
            heads = [header(reader.read(s, o, HEADER)) for s, o in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist())]
            if heads:
                extra = [pa.array(c, k) for c, k in zip(zip(*heads), (pa.string(), pa.int32(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "format", "width", "height", "bits"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return _near(rows).mapInArrow(each, kind + ", format string, width int, height int, bits int")


def with_payload(rows: DataFrame, folder: str, dealt: bool = False) -> DataFrame:
    """``rows`` with what the stored bytes, read back and decoded, say: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature. Fails where a stored payload is not the one its digest names."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last, value = Reader(folder), None, None
        for batch in batches:
            values = []
            for at in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length", "digest"))):
                if at != last:  # rows of one payload follow each other
                    data = reader.read(*at[:3])
                    body = decode(data)
                    sha = hashlib.sha256(body).hexdigest()
                    if sha != at[3]:
                        raise ValueError(f"{at[0]} at {at[1]}: another payload than {at[3]}")
                    last, value = at, (len(body), sha, zlib.crc32(body[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(body))
                values.append(value)
            if values:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                extra = [pa.array(c, k) for c, k in zip(zip(*values), kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *names])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return (rows if dealt else _near(rows)).mapInArrow(
        each, kind + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store, then fill metadata from headers and digests from whole payloads. One row per row of ``docs``."""
    folder = folder or scratch_path(docs.sparkSession, "shards")
    return with_payload(with_metadata(store(docs, folder), folder), folder, dealt=True)  # in the order that metadata left


def members(data: bytes) -> list[str]:
    """Names in a shard, by the standard library's tar reader."""
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        return tar.getnames()
