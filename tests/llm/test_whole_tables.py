"""The registered queries of vectors, media and archives against plain versions over whole small tables."""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
from oracle import DATA

from panelwright.llm import QUERIES

SF = f"{DATA}/sf0.01"


def test_op3_links_and_components(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ok = [r for r in rows if r["label"] is not None and r["embedding"] and None not in r["embedding"]]
    ok = [r for r in ok if np.isfinite(r["embedding"]).all() and np.any(r["embedding"])]
    ids, label = np.array([r["vec_id"] for r in ok]), np.array([r["label"] for r in ok])
    x = np.array([r["embedding"] for r in ok], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    least = ids.copy()
    for _ in range(len(ids)):
        new = np.minimum(least, np.where(linked, least[None, :], least.max() + 1).min(1))
        if (new == least).all():
            break
        least = new
    want = {r["vec_id"]: (0, r["vec_id"], True) for r in rows}
    want |= {int(i): (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, linked.sum(1), least, strict=True)}
    got = QUERIES["op3_hnsw_neardup"](spark, SF).collect()
    assert len(got) == len(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == want


def test_op6_payloads(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        raw = (r["text"] or "").encode()
        whole = raw + bytes(-len(raw) % 64 if raw else 64)
        want[r["doc_id"]] = (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
    got = QUERIES["op6_media_columns"](spark, SF).collect()
    assert len(got) == len(want)
    assert {r["doc_id"]: (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got} == want


def test_op8_records(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    first: dict[bytes, int] = {}
    for page in sorted(pages):
        first.setdefault(pages[page], page)
    want = {}
    for page, raw in pages.items():
        of = first[raw]
        kind = "response" if of == page else "revisit"
        want[page] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, None if of == page else of)
    got = QUERIES["op8_warc_bundles"](spark, SF).collect()
    assert len(got) == len(want)
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == want
