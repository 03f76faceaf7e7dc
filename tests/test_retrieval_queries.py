"""Searches for many texts at once give each what a search for it alone gives."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from oracle import DATA, compare, connect

from panelwright.operators import retrieval
from panelwright.queries import ORACLE_SQL, QUERIES


def test_every_50th_document_is_searched(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    got = QUERIES["t03_tfidf_every_50th"](spark, f"{DATA}/sf0.001").collect()
    asked = {r["doc_id"]: r["text"] for r in docs.filter("doc_id % 50 = 0").collect()}
    assert {r["query_id"] for r in got} == set(asked) and len(asked) > 1
    chunks = docs.selectExpr("doc_id as chunk_id", "text")
    some = max(asked)
    alone = [(r["chunk_id"], round(r["similarity"], 6)) for r in retrieval.similar_chunks(chunks, asked[some], 10).collect()]
    assert sorted(alone) == sorted((r["chunk_id"], r["similarity"]) for r in got if r["query_id"] == some)


def test_found_chunks_are_formatted_by_query(spark):
    rows = [(1, "a", "P", "s", "T", 2), (1, "b", "P", "s", "T", 1), (2, "c", "Q", "unknown", "", 1)]
    chunks = spark.createDataFrame(rows, "query_id int, text string, provider string, source string, ticker string, place int")
    got = {r["query_id"]: r["block"] for r in retrieval.formatted_chunks(chunks, "place", ("query_id",)).collect()}
    assert got == {1: "  - [P/s, T] b\n  - [P/s, T] a", 2: "  - [Q/unknown, ] c"}
    assert retrieval.formatted_chunks(chunks.limit(0), "place").count() == 0


def test_blocks_lose_no_chunk(spark, monkeypatch):
    """Many small blocks give what the SQL gives, and an id that is there twice is one chunk, for few and for many texts."""
    monkeypatch.setattr(retrieval, "CHUNKS", 30)
    monkeypatch.setattr(retrieval, "ASKED", 2)
    folder = f"{DATA}/sf0.001"
    assert compare(spark, connect(folder), "t03_tfidf_every_50th", QUERIES["t03_tfidf_every_50th"], ORACLE_SQL["t03_tfidf_every_50th"], folder) is None
    chunks = spark.createDataFrame([(1, "red apple"), (1, "green apple"), (2, "green pear"), (3, None)], "chunk_id long, text string")
    index = retrieval.index_of(chunks)
    assert {r["chunk_id"]: dict(zip(r["terms"], r["counts"], strict=True)) for r in index.rows.collect()} == {1: {"red": 1, "apple": 2, "green": 1}, 2: {"green": 1, "pear": 1}, 3: {}}
    asked = spark.createDataFrame([(7, "green apple")], "query_id long, text string")
    many = [(r["chunk_id"], round(r["similarity"], 9)) for r in retrieval.similar_chunks(index, asked, 5).collect()]
    assert many == [(r["chunk_id"], round(r["similarity"], 9)) for r in retrieval.similar_chunks(index, "green apple", 5).collect()] and len(many) == 2


def test_products_of_a_block(monkeypatch):
    """Dense and other terms, a few queries and products at a time: every chunk that is among the three most alike is there."""
    for name, value in (("DENSE", 4), ("TOGETHER", 3), ("PRODUCTS", 7)):
        monkeypatch.setattr(retrieval, name, value)
    draw = np.random.default_rng(1)
    c, q, idf = draw.poisson(0.4, (40, 25)), draw.poisson(0.4, (8, 25)), draw.uniform(1, 6, 25)
    change = np.where(np.arange(25) % 3 == 0, -0.05 * idf**2, 0.0)
    c[:, 0], q[:, 0] = 1, 1
    own = np.sqrt(idf**2 + change)
    square, q_norm = ((c * idf) ** 2).sum(1), np.sqrt(((q * own) ** 2).sum(1))
    lists = lambda x, of: [of(i, np.flatnonzero(x[i])) for i in range(len(x))]
    ids = lambda x: pa.array(lists(x, lambda i, at: at.tolist()), pa.list_(pa.int64()))
    chunks = pa.table({"chunk_id": range(40), "ids": ids(c), "counts": pa.array(lists(c, lambda i, at: c[i, at].tolist()), pa.list_(pa.int32())), "scale": 1 / np.sqrt(square)})
    asked = pa.table({"query_id": range(8), "ids": ids(q), "counts": pa.array(lists(q, lambda i, at: (q[i, at] * own[at] ** 2).tolist())), "changes": pa.array(lists(q, lambda i, at: change[at].tolist())), "scale": 1 / q_norm})
    got = {(r["query_id"], r["chunk_id"]): (r["low"], r["high"]) for r in retrieval._multiplied(chunks, asked, 3).to_pylist()}
    for i in range(8):
        norm = np.sqrt(square + (c**2 * change * (q[i] > 0)).sum(1))
        like = (c * q[i] * own**2).sum(1) / norm / q_norm[i]
        for j in np.argsort(-like)[:3]:
            low, high = got[i, int(j)]
            assert low <= like[j] <= high <= 1.01 * low
