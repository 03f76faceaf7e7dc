"""Helpers that the training-data operators share: shared folders, Arrow text blocks, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one numpy block holds; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes of the Arrow batches that Spark and its Python workers hand each other; its own bound is 10,000 rows, however long.
BATCH_BYTES = 4 << 20


# ---------------------------------------------------------------- shared storage


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder URI under ``spark.checkpoint.dir``, which every executor can reach.

    The session's own setting is used where there is one. Only where it is unset (as in local
    tests) a folder below the warehouse is set for this session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, outlives executors."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Bounds this session's Arrow batches by bytes as well, unless it has a bound of its own.

    An executor holds a few such batches for each task, outside its heap and in its Python workers.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None and spark.sparkContext.getConf().get(name) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def open_store(uri: str):
    """``(filesystem, path)`` of a folder URI, for the files that Spark's writers can't make.

    Plain paths and ``file:`` URIs are local (shared) folders; other schemes go to pyarrow's
    filesystems (hdfs, s3, gs).
    """
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


# ---------------------------------------------------------------- text blocks


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def row_blocks(column: pa.Array, limit: int = BLOCK_BYTES, max_rows: int = 4000) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold about ``limit`` bytes each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and (held + size > limit or i - start >= max_rows):
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


# ---------------------------------------------------------------- words and their hashes

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The same table with A-Z hashed as a-z.
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
_PLACE = _RNG.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for key, base in (("up", _P), ("down", _P_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word ``[^\\x20\\x09-\\x0D]+``, and how many words each row has."""
    n = len(data)
    inside = ~_SPACE[data]
    starts, ends = inside.copy(), inside.copy()
    if n:
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = off[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        starts[cut] |= inside[cut]
        ends[cut - 1] |= inside[cut - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.diff(np.searchsorted(s, off))


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial over a random byte table, then a finaliser."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[:-1], out=sums[1:])
    h = (sums[e] - sums[s]) * down[s]
    return mix(h + (e - s).astype(np.uint64) * _PLACE[7])


def shingle_keys(data: np.ndarray, off: np.ndarray, width: int = 5, wide: bool = False) -> tuple[np.ndarray, ...]:
    """The rows' distinct word shingles as sorted keys ``row << 52 | hash`` and the rows' set sizes; if ``wide``, their
    whole 64-bit hashes too.

    A row with fewer than ``width`` words has its whole sequence as one shingle, a row without
    words has none. At most 4096 rows.
    """
    s, e, words = word_spans(data, off)
    h = span_hashes(data, s, e)
    first = np.concatenate([[0], np.cumsum(words)])[:-1]
    count = np.where(words >= width, words - width + 1, (words > 0).astype(np.int64))
    rows = np.repeat(np.arange(len(words)), count)
    at = np.repeat(first - np.concatenate([[0], np.cumsum(count)])[:-1], count) + np.arange(count.sum())
    size = np.minimum(words, width)[rows]
    total = size.astype(np.uint64)
    for j in range(width):
        there = size > j
        total[there] += h[at[there] + j] * _PLACE[j]
    total = mix(total)
    keys = (rows.astype(np.uint64) << np.uint64(52)) | (total >> np.uint64(12))
    if wide:
        order = np.argsort(keys)
        order = order[np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))]
        keys, more = keys[order], (total[order],)
    else:
        keys, more = np.unique(keys), ()
    return keys, np.bincount((keys >> np.uint64(52)).astype(np.int64), minlength=len(words)), *more
