"""Searches for many texts hold one batch of chunks at a time and carry on no more than each query's best."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from panelwright.operators import retrieval

def _batch(part: int, side: int, ids: np.ndarray, x: np.ndarray, weight: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
    """Rows of the search: x(row, term) are counts."""
    held = [np.flatnonzero(row) for row in x]
    lists = lambda of, kind: pa.array([of(i, at) for i, at in enumerate(held)], pa.list_(kind))
    none, own, n = pa.nulls(len(x), pa.int64()), pa.array(ids, pa.int64()), len(x)
    columns = {
        "part": pa.array([part] * n, pa.int32()), "side": pa.array([side] * n, pa.int32()), "query_id": none if side else own, "chunk_id": own if side else none,
        "ids": lists(lambda i, at: at, pa.int64()), "counts": lists(lambda i, at: x[i, at], pa.int32()), "dfs": lists(lambda i, at: df[at], pa.int64()),
        "scale": pa.array(1 / np.sqrt(((x * weight) ** 2).sum(1))),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def test_a_part_passes_by_in_batches(monkeypatch):
    """What a task holds doesn't grow with its chunks; the three best of each query are those of all pairs, for two parts one after the other."""
    for name, value in (("ROWS", 64), ("HELD", 1_000), ("DENSE", 50), ("TOGETHER", 4), ("PRODUCTS", 10_000)):
        monkeypatch.setattr(retrieval, name, value)
    draw, total, n_terms = np.random.default_rng(2), 2_000, 1_000
    df = draw.integers(1, 900, n_terms)
    idf, own = np.log((1 + total) / (1 + df)) + 1, np.log((1 + total) / (2 + df)) + 1
    some = lambda n: (draw.random((n, n_terms)) < 0.02) * draw.integers(1, 4, (n, n_terms))
    asked, peak = some(6), {}
    for n in (200, 2_000):
        parts = [np.concatenate([some(n - 6), asked, asked]) for _ in range(2)]
        batches = []
        for part, chunks in enumerate(parts):
            batches.append(_batch(part, 0, np.arange(6) + 10 * part, asked, own, df))
            batches += [_batch(part, 1, np.arange(len(chunks))[at : at + 100], chunks[at : at + 100], idf, df) for at in range(0, len(chunks), 100)]
        tracemalloc.start()
        found = pa.Table.from_batches(list(retrieval._passed(iter(batches), total, 3))).to_pylist()
        peak[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(found) == 2 * 6 * 3
        for part, chunks in enumerate(parts):
            for i, q in enumerate(asked):
                weight = np.where(q > 0, own, idf)
                like = (chunks * q * weight**2).sum(1) / np.sqrt(((chunks * weight) ** 2).sum(1)) / np.sqrt(((q * own) ** 2).sum())
                want = sorted(range(len(chunks)), key=lambda j, like=like: (-round(like[j], 9), j))[:3]
                got = sorted((-round(r["similarity"], 9), r["chunk_id"]) for r in found if r["query_id"] == i + 10 * part)
                assert [j for _, j in got] == want and np.allclose([-x for x, _ in got], like[want], atol=2e-9)
    assert peak[2_000] < 1.3 * peak[200]


def test_copies_are_not_all_carried_on(spark, monkeypatch):
    """Each of 40 queried copies has 400 equal chunks: the least ids are found, and no more than the best are written."""
    rows: dict[str, int] = {}

    def counted(df, label, written=retrieval.written):
        made = written(df, label)
        rows[label] = max(rows.get(label, 0), made.count())
        return made

    monkeypatch.setattr(retrieval, "written", counted)
    texts = [(i, "red apples and green pears" if i < 400 else "three other words") for i in range(410)]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string")
    asked = chunks.filter("chunk_id % 10 = 0 and chunk_id < 400 or chunk_id = 409").withColumnRenamed("chunk_id", "query_id")
    got = sorted((r["query_id"], r["chunk_id"]) for r in retrieval.similar_chunks(chunks, asked, 3).collect())
    assert got == sorted([(q, c) for q in range(0, 400, 10) for c in range(3)] + [(409, c) for c in (400, 401, 402)])
    assert max(rows.values()) < 1_000, rows


def test_unknown_words_and_no_chunks(spark):
    """A query of unknown words finds nothing, next to one that finds its chunk; no chunk, nothing found."""
    chunks = spark.createDataFrame([(1, "red apples"), (2, None)], "chunk_id long, text string")
    asked = spark.createDataFrame([(7, "zzz yyy"), (8, "red zzz"), (9, None)], "query_id long, text string")
    got = retrieval.similar_chunks(chunks, asked, 3).collect()
    alone = retrieval.similar_chunks(chunks, "red zzz", 3).collect()
    assert [(r["query_id"], r["chunk_id"], round(r["similarity"], 9)) for r in got] == [(8, 1, round(alone[0]["similarity"], 9))]
    assert retrieval.similar_chunks(chunks.limit(0), asked, 3).count() == 0
    assert retrieval.similar_chunks(chunks, asked.filter("query_id = 9"), 3).count() == 0
