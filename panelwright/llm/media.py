"""Media columns over content-addressed payloads in tar shards.

A text's payload is its UTF-8 bytes and zero bytes up to a positive multiple of 64. It is stored as
an 8-bit greyscale PNG of width 64 (lossless), under the name of the payload's SHA-256, in tar shards
of about ``SHARD_BYTES``. A task writes its own shards and stores a payload once; where several tasks
met the same payload, the first place (by shard, offset) is the one that all rows point to. Rows carry
digest, shard, offset and length. Metadata columns come from header-only range reads (the first 33 bytes
of the stored form); features from range reads of whole payloads, once for each digest.

Shards lie in the shared folder. A shard's name has a random part, and only places that were written
as part of a completed task enter the index, so a repeated task can't leave a broken reference.

Null text is empty: 64 zero bytes. Equal texts have equal values; repeated and null ids keep their rows.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat_text, materialise, open_store, row_blocks, shared_dir

WIDTH = 64
SHARD_BYTES = 64 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33


def payload_of(text: bytes) -> bytes:
    """``text`` and zero bytes up to a positive multiple of 64."""
    return text + bytes((-len(text)) % WIDTH or (0 if text else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """Rows of 64 eight-bit grey samples, each after a filter byte 0."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first 33 bytes; an error if they aren't those of a PNG."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth


def from_png(stored: bytes) -> bytes:
    """The payload of a PNG that ``to_png`` made; checks every chunk."""
    width, _, _ = png_header(stored[:HEADER_BYTES])
    at, data = 8, b""
    while at < len(stored):
        (n,) = struct.unpack(">I", stored[at : at + 4])
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


class ShardWriter:
    """Tar members one after another; ``add`` returns shard, offset and length of the member's data."""

    def __init__(self, folder: str, label: str):
        self.folder, self.label, self.out = folder, label, None
        self.seen: dict[bytes, tuple[str, int, int]] = {}

    def _roll(self) -> None:
        self.close()
        fs, path = open_store(self.folder)
        fs.create_dir(path, recursive=True)
        self.shard = f"{self.label}-{uuid.uuid4().hex}.tar"
        self.out, self.at = fs.open_output_stream(f"{path}/{self.shard}", compression=None), 0

    def add(self, digest: bytes, make) -> tuple[str, int, int]:
        if digest not in self.seen:
            data = make()
            if self.out is None or self.at > SHARD_BYTES:
                self._roll()
            info = tarfile.TarInfo(f"{digest.hex()}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            body = head + data + bytes(-len(data) % 512)
            self.out.write(body)
            self.seen[digest] = (self.shard, self.at + len(head), len(data))
            self.at += len(body)
        return self.seen[digest]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


_PLACED = "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Write the payloads of ``docs(doc_id, text)``; one row ``(doc_id, n_bytes, digest, shard, offset, length)`` each."""

    def tasks(batches):
        from pyspark import TaskContext

        writer = ShardWriter(folder, f"s{TaskContext.get().partitionId():06d}")
        for batch in batches:
            for a, b in row_blocks(batch.column(1)):
                data, off = flat_text(batch.column(1).slice(a, b - a))
                raw, ends = data.tobytes(), off.tolist()
                rows = []
                for x, y in zip(ends[:-1], ends[1:], strict=True):
                    payload = payload_of(raw[x:y])
                    digest = hashlib.sha256(payload).digest()
                    rows.append((y - x, digest, *writer.add(digest, lambda p=payload: to_png(p))))
                n, digest, shard, offset, length = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(shard),
                     pa.array(offset, pa.int64()), pa.array(length, pa.int64())],
                    names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"],
                )
        writer.close()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tasks, _PLACED)


def _ranges(places: DataFrame, folder: str, row, schema: str, limit: int | None) -> DataFrame:
    """``row(bytes)`` for each place, shard by shard in order of offset; ``limit``: only so many first bytes."""

    def tasks(batches):
        fs, path = open_store(folder)
        name, source = None, None
        for batch in batches:
            shards, offsets, lengths = (batch.column(i).to_pylist() for i in (1, 2, 3))
            rows = []
            for shard, offset, length in zip(shards, offsets, lengths, strict=True):
                if shard != name:
                    if source is not None:
                        source.close()
                    name, source = shard, fs.open_input_file(f"{path}/{shard}")
                source.seek(offset)
                rows.append(row(source.read(min(length, limit or length))))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c)) for c in cols)], names=["digest", *names]
            )
        if source is not None:
            source.close()

    names = [x.split()[0] for x in schema.split(", ")]
    dealt = places.select("digest", "shard", "offset", "length").repartition("shard", F.floor(F.col("offset") / (8 << 20)))
    return dealt.sortWithinPartitions("shard", "offset").mapInArrow(tasks, f"digest binary, {schema}")


def places(placed: DataFrame) -> DataFrame:
    """One place for each digest."""
    first = placed.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p"))
    return first.select("digest", "p.shard", "p.offset", "p.length")


def media_metadata(where: DataFrame, folder: str) -> DataFrame:
    """``(digest, width, height, depth)`` by header-only range reads."""
    return _ranges(where, folder, png_header, "width long, height long, depth long", HEADER_BYTES)


def media_features(where: DataFrame, folder: str) -> DataFrame:
    """Features of the stored bytes, read back: sizes, digests, and mean, deviation and entropy of the samples."""

    def row(stored: bytes):
        width, height, depth = png_header(stored[:HEADER_BYTES])
        payload = from_png(stored)
        counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
        p = counts[counts > 0] / len(payload)
        values = np.arange(256)
        mean = float(counts @ values) / len(payload)
        sd = max(float(counts @ (values * values)) / len(payload) - mean * mean, 0.0) ** 0.5
        feature = f"png:{width}x{height}x{depth} mean={mean:.4f} sd={sd:.4f} entropy={-float(p @ np.log2(p)) + 0.0:.4f}"
        return (
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored),
            hashlib.sha256(stored).hexdigest(), feature,
        )

    return _ranges(
        where, folder, row,
        "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
        None,
    )


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store the texts of ``docs`` and return their media columns, one row for each document.

    The index (digest, shard, offset, length, and the header's width, height and depth) is part of
    the result.
    """
    folder = folder or shared_dir(docs.sparkSession, "media")
    placed = materialise(store(docs, folder), "media-index")
    where = materialise(places(placed), "media-places")
    facts = media_features(where, folder).join(media_metadata(where, folder), "digest").join(where, "digest")
    return placed.select("doc_id", "n_bytes", "digest").join(facts, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "shard", "offset", "length", "width", "height", "depth",
    )


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
