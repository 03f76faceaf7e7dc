"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``FRAME_BYTES``. A bundle ends with the seek table of
the Zstandard seekable format: a skippable frame with the compressed and decompressed size of each frame, the
number of frames and the magic number 0x8F92EAB1. Reading starts at that footer. The index maps a record
identifier to its bundle, its frame and the record's offset and length in that frame (``fetch``); the seek table maps the frame
to its place in the file, so a record costs one frame.

Of the records with equal payloads of at least ``min_bytes``, the one with the least page id is written
as a response, the others as revisits that refer to it and have no body, as the WARC format has it.
Only (digest, length, id) are shuffled to find these; the join that hands the answer to the pages is by
page id and digest.

Null html is an empty payload, null url an empty one. Rows with equal page ids are separate records; of those with one
payload the first by url can be the response, the others revisit it. A page without an id is never
referred to: it revisits an equal payload of a page with an id, and is a response where there is none. Only
``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, open_store, row_blocks, shared_dir

MIN_BYTES = 0
BUNDLE_BYTES, FRAME_BYTES = 64 << 20, 64 << 10
#: Records that a task reads back, about, and frames of a bundle that stay together.
READ_RECORDS, READ_FRAMES = 2000, 64
#: Html bytes that a task turns into Python strings at once.
TEXT_BYTES = 4 << 20
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_DATE = "2024-01-01T00:00:00Z"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, place: int = 1) -> str:
    """The identifier of the ``place``-th record of a page id and payload."""
    more = f"/{place}" if place > 1 else ""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}{more}')}"


def make_record(page_id, url: str, payload: bytes, digest: str, refers_to, place: int = 1) -> bytes:
    """A response record, or a revisit of page ``refers_to`` if that isn't None."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id, digest, place)}>",
        f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"X-Refers-To-Page: {refers_to}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (with lower-case names) and body of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length")
    return headers, rest[:n]


class BundleWriter:
    """Records in frames and, at the end, the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.out, self.sizes, self.at = out, [], 0
        self.frame_bytes, self.open, self.held = frame_bytes, [], 0
        self._zstd = zstandard.ZstdCompressor(level=3)

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Put a record into the open frame; its frame number, and its offset and length there."""
        place = len(self.sizes), self.held, len(record)
        self.open.append(record)
        self.held += len(record)
        if self.held >= self.frame_bytes:
            self._end_frame()
        return place

    def _end_frame(self) -> None:
        frame = self._zstd.compress(b"".join(self.open))
        self.out.write(frame)
        self.sizes.append((len(frame), self.held))
        self.at += len(frame)
        self.open, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self._end_frame()
        entries = np.array(self.sizes, "<u4").tobytes()
        body = entries + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(body)) + body)
        self.out.close()


class BundleReader:
    """Random access to the frames of a bundle through its footer; the last frame is kept."""

    def __init__(self, source):
        import zstandard

        self.source = source
        size = source.size()
        source.seek(size - 9)
        frames, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != _SEEKABLE:
            raise ValueError("no seek table")
        source.seek(size - 9 - 8 * frames)
        table = np.frombuffer(source.read(8 * frames), "<u4").reshape(-1, 2).astype(np.int64)
        self.sizes = table
        self.offsets = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.kept: tuple[int, bytes] = (-1, b"")
        self._zstd = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        if self.kept[0] != number:
            self.source.seek(int(self.offsets[number]))
            raw = self.source.read(int(self.sizes[number, 0]))
            self.kept = number, self._zstd.decompress(raw, int(self.sizes[number, 1]))
        return self.kept[1]

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


#: What tells records apart, none of it null: page id, whether there is none, payload.
_KEY = ["id", "no_id", "sha1"]


def _with_roles(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``(page_id, url, html, place, response_id)``: ``place`` numbers the records of one page id and payload; a revisit has the
    page id of its response. The pages are shuffled once, by ``_KEY``, for both."""
    html = F.coalesce("html", F.lit(""))
    pages = pages.select(
        "page_id", "url", "html", F.coalesce("page_id", F.lit(0)).alias("id"), F.col("page_id").isNull().alias("no_id"), F.sha1(html.cast("binary")).alias("sha1")
    )
    named = pages.filter(F.octet_length(html) >= min_bytes).select("page_id", *_KEY)
    first = named.groupBy("sha1").agg(F.min("page_id").alias("response_id"), F.count("*").alias("k")).filter("k > 1 and response_id is not null")
    shared = named.join(first, "sha1").select(*_KEY, "response_id").distinct()
    place = F.row_number().over(Window.partitionBy(*_KEY).orderBy("url"))
    rows = pages.withColumn("place", place).join(shared, _KEY, "left")
    response = (F.col("page_id") == F.col("response_id")) & (F.col("place") == 1)
    return rows.select("page_id", "url", "html", "place", F.when(~F.coalesce(response, F.lit(False)), F.col("response_id")).alias("response_id"))


_INDEX = "record_id string, bundle string, frame long, offset long, length long"


def write_bundles(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as bundles in ``folder``; the index of their records (see ``_INDEX``)."""

    def tasks(batches):
        fs, path = open_store(folder)
        fs.create_dir(path, recursive=True)
        bundle, name = None, None
        for batch in batches:
            for a, b in row_blocks(batch.column(2), TEXT_BYTES):
                index = []
                for page_id, url, html, place, of in zip(*(c.to_pylist() for c in batch.slice(a, b - a).columns), strict=True):
                    payload = (html or "").encode()
                    digest = _digest(payload)
                    if bundle is None or bundle.at > BUNDLE_BYTES:
                        if bundle is not None:
                            bundle.close()
                        name = f"b-{uuid.uuid4().hex}.warc.zst"
                        bundle = BundleWriter(fs.open_output_stream(f"{path}/{name}", compression=None))
                    at = bundle.add(make_record(page_id, url or "", payload, digest, of, place))
                    index.append((record_id(page_id, digest, place), name, *at))
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*index, strict=True))), names=[x.split()[0] for x in _INDEX.split(", ")])
        if bundle is not None:
            bundle.close()

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return _with_roles(pages, min_bytes).mapInArrow(tasks, _INDEX)


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, bundle string, frame long"


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of a stored index (it is counted), read back from the archives through their seek tables."""

    def tasks(batches):
        fs, path = open_store(folder)
        name, reader = None, None
        for batch in batches:
            rows = []
            if not batch.num_rows:
                continue
            for wanted, bundle, frame, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle != name:
                    if reader is not None:
                        reader.source.close()
                    name, reader = bundle, BundleReader(fs.open_input_file(f"{path}/{bundle}"))
                headers, body = parse_record(reader.record(frame, offset, length))
                if headers["warc-record-id"] != f"<{wanted}>":
                    raise ValueError("another record")
                http, _, payload = body.partition(b"\r\n\r\n")
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                kind = headers["warc-type"]
                n = int(http.rpartition(b"Content-Length: ")[2])
                if kind == "response" and (len(payload) != n or _digest(payload) != digest):
                    raise ValueError("damaged payload")
                page, refers = headers["x-page-id"], headers.get("x-refers-to-page")
                rows.append((int(page) if page else None, n, digest, kind, int(refers) if refers else None))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, cols, kinds), *batch.columns[:3]], names=[x.split()[0] for x in _READ.split(", ")]
            )
        if reader is not None:
            reader.source.close()

    # a number of partitions that is given isn't lowered to fit the few bytes of the index
    parts = max(1, min(-(-index.count() // READ_RECORDS), 100_000))
    dealt = index.repartition(parts, "bundle", F.floor(F.col("frame") / READ_FRAMES)).sortWithinPartitions("bundle", "frame", "offset")
    return dealt.select("record_id", "bundle", "frame", "offset", "length").mapInArrow(tasks, _READ)


def fetch(index: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """The records whose identifiers are in ``wanted(record_id)``, each by reading its frame alone."""
    return read_records(index.join(wanted.select("record_id").distinct(), "record_id", "left_semi"), folder)


def archive_round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``pages`` as bundles and read them back: one row for each page (see ``_READ``)."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    index = materialise(write_bundles(pages, folder, min_bytes), "warc-index")
    return read_records(index, folder)


def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
