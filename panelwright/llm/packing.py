"""Harmonic sequence packing.

A document is its ids and the end id. A whole document of length ``n`` belongs to the class ``k = capacity // n``
(lengths in ``(capacity/(k+1), capacity/k]``), and a bin of that class takes exactly ``k`` documents. What they leave free is
filled with pieces cut from documents longer than a sequence. Up to ``KEPT`` ids of these wait for gaps; of what
comes beyond, full sequences are cut, and the remainder is classed by its length like a document. If no long document is left
and more than ``OPEN_BINS`` bins have gaps, the bin with the largest gap is dissolved and its documents fill the others.
So documents that fit into a sequence are hardly ever cut, and only the last sequence of a partition has padding.

Every partition fills its own bins: no shuffle. When a partition ends, documents in incomplete classes fill gaps, and
the rest follows one after the other.

Null or empty text: the end id alone. Rows with equal or null ids are packed row by row. A partition's
sequence ids start at ``partition << 32``. Ids of documents may be any long.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat_text, row_blocks
from .tokens import byte_bpe, default_path

CAPACITY, END_ID = 1024, 0
#: Ids of long documents that wait for gaps, and bins that wait for ids.
KEPT, OPEN_BINS = 1 << 18, 512
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)

#: A piece: document id, its ids as little-endian unsigned 32-bit numbers, the document's ids before it, all of the document's.
Piece = tuple[int | None, bytes, int, int]


class Packer:
    """Bins of one partition; finished sequences are rows (see ``SCHEMA``) in ``rows``."""

    def __init__(self, base: int, capacity: int = CAPACITY, kept: int = KEPT, open_bins: int = OPEN_BINS):
        self.capacity, self.next, self.kept, self.open_bins = capacity, base, kept, open_bins
        self.classes: dict[int, list[Piece]] = {}
        self.filler: deque[Piece] = deque()
        self.held = 0
        self.waiting: list[tuple[int, list[Piece]]] = []
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Pack a document, given as its ids."""
        total = len(ids) >> 2
        if total <= self.capacity:
            self._classed((doc_id, ids, 0, total))
            return
        self._fill_with((doc_id, ids, 0, total))
        while self.held > self.kept:
            own, raw, start, total = self.filler.popleft()
            self.held -= len(raw) >> 2
            size = 4 * self.capacity
            full = len(raw) // size * size
            for at in range(0, full, size):
                self._emit([(own, raw[at : at + size], start + (at >> 2), total)])
            if full < len(raw):
                self._classed((own, raw[full:], start + (full >> 2), total))

    def _classed(self, piece: Piece) -> None:
        k = self.capacity // (len(piece[1]) >> 2)
        own = self.classes.setdefault(k, [])
        own.append(piece)
        if len(own) == k:
            del self.classes[k]
            self._close(own)

    def _close(self, own: list[Piece]) -> None:
        """A bin with all its documents: cut what is free from long documents."""
        gap = self.capacity - (sum(len(x[1]) for x in own) >> 2)
        while gap and self.filler:
            gap -= self._cut_into(own, gap)
        if not gap:
            self._emit(own)
            return
        self.waiting.append((gap, own))
        if len(self.waiting) > self.open_bins:
            self._dissolve()

    def _cut_into(self, own: list[Piece], gap: int) -> int:
        doc_id, raw, start, total = self.filler.popleft()
        n = min(gap, len(raw) >> 2)
        own.append((doc_id, raw[: 4 * n], start, total))
        if 4 * n < len(raw):
            self.filler.appendleft((doc_id, raw[4 * n :], start + n, total))
        self.held -= n
        return n

    def _fill_with(self, piece: Piece) -> None:
        """Take ``piece`` as one to cut from: waiting bins first."""
        self.filler.append(piece)
        self.held += len(piece[1]) >> 2
        while self.waiting and self.filler:
            gap, own = self.waiting.pop()
            while gap and self.filler:
                gap -= self._cut_into(own, gap)
            if gap:
                self.waiting.append((gap, own))
            else:
                self._emit(own)

    def _dissolve(self) -> None:
        at = max(range(len(self.waiting)), key=lambda i: self.waiting[i][0])
        _, own = self.waiting.pop(at)
        for piece in own:
            self._fill_with(piece)

    def _emit(self, own: list[Piece]) -> None:
        offset = 0
        for doc_id, raw, start, total in own:
            n = len(raw) >> 2
            self.rows.append((doc_id, start, n, zlib.crc32(raw), total, self.next, offset))
            offset += n
        self.next += 1

    def finish(self) -> None:
        """Pack all that waits."""
        for _, own in sorted(self.classes.items()):
            for piece in own:
                self._fill_with(piece)
        self.classes = {}
        while len(self.waiting) > 1 and not self.filler:
            self._dissolve()
        while self.filler:
            self._close([])
        for _, own in self.waiting:
            self._emit(own)
        self.waiting = []


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences of ``capacity`` ids; one row per piece (see ``SCHEMA``).

    Other columns are left out. ``offset`` is the place in the sequence, gapless from 0;
    ``ids_crc32`` is over the piece's ids as little-endian unsigned 32-bit numbers.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    path = tokenizer_path or default_path("byte_bpe_50k.json")

    def tasks(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = byte_bpe(path)
        packer = Packer(TaskContext.get().partitionId() << 32, capacity)

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*packer.rows, strict=True)]
            packer.rows = []
            return pa.RecordBatch.from_arrays(columns, schema=_FIELDS)

        for batch in batches:
            for a, b in row_blocks(batch.column(1)):
                data, off = flat_text(batch.column(1).slice(a, b - a))
                ids, at = encoder.encode(data, off)
                raw = np.insert(ids, at[1:], END_ID).astype("<u4").tobytes()
                ends = (4 * (at + np.arange(len(at)))).tolist()
                for doc_id, start, end in zip(batch.column(0).slice(a, b - a).to_pylist(), ends[:-1], ends[1:], strict=True):
                    packer.add(doc_id, raw[start:end])
                if packer.rows:
                    yield out()
        packer.finish()
        if packer.rows:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(tasks, SCHEMA)


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
