"""Groups in which nearly all vectors link with all: links, components and memory of a task."""

from __future__ import annotations

import tracemalloc

import numpy as np

from panelwright.llm import embeddup
from panelwright.llm.embeddup import Links, Shard, compare, near_duplicate_vectors
from panelwright.llm.hnsw import Hnsw


def _vectors(n: int, seed: int) -> np.ndarray:
    """Two thirds around one direction, at cosines about the threshold; the others anywhere."""
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(0).normal(size=16)
    near = middle + rng.normal(size=(2 * n // 3, 16)) * 0.09
    return np.concatenate([near, rng.normal(size=(n - len(near), 16))])


def _shard(vectors: np.ndarray, first: int) -> Shard:
    ids = np.arange(first, first + len(vectors))
    graph = Hnsw.build((vectors / np.linalg.norm(vectors, axis=1)[:, None]).astype(np.float32))
    return Shard(ids, ids, 1 + ids % 3, vectors, graph.levels, graph.links)


def _plain(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    linked = unit @ unit.T >= 0.98
    np.fill_diagonal(linked, False)
    least = np.arange(len(unit))
    while True:
        new = np.minimum(least, np.where(linked, least[None, :], len(unit)).min(1))
        if (new == least).all():
            return linked, least
        least = new


def test_bits_are_the_hits():
    rng = np.random.default_rng(1)
    hit = rng.random((600, 301)) < 0.1
    rows, columns = Links(600, 301), Links(600, 301)
    for a in range(0, 600, 256):
        rows.add_rows(a, hit[a : a + 256])
    for a in range(0, 301, 256):
        columns.add_columns(a, hit[:, a : a + 256].T)
    for links in (rows, columns):
        assert (np.concatenate([x for _, x in links.blocks()]) == hit).all()


def test_five_thousand_near_vectors_in_bounded_memory():
    one, two = _shard(_vectors(4000, 1), 0), _shard(_vectors(1000, 2), 4000)
    linked, _ = _plain(np.concatenate([one.unit, two.unit]))
    assert linked.sum() > 4_000_000  # 47 bytes a pair would be 190 MB
    weights = np.concatenate([one.weights, two.weights])
    tracemalloc.start()
    sums, _ = compare(one, one, 0.98)
    both, label = compare(one, two, 0.98)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    assert (sums == linked[:4000, :4000] @ weights[:4000]).all()
    assert (both == np.concatenate([linked[:4000, 4000:] @ weights[4000:], linked[4000:, :4000] @ weights[:4000]])).all()
    cross = linked.copy()
    cross[:4000, :4000] = cross[4000:, 4000:] = False
    least = np.arange(5000)
    while True:
        new = np.minimum(least, np.where(cross, least[None, :], 5000).min(1))
        if (new == least).all():
            break
        least = new
    assert (label == least).all()


def test_exhaustive_blocks_find_the_same(monkeypatch):
    monkeypatch.setattr(Shard, "beam", lambda self, q, threshold: None)
    v = _vectors(700, 3)
    one, two = _shard(v[:370], 0), _shard(v[370:], 370)
    linked, _ = _plain(np.concatenate([one.unit, two.unit]))
    weights = np.concatenate([one.weights, two.weights])
    want = np.concatenate([linked[:370, 370:] @ weights[370:], linked[370:, :370] @ weights[:370]])
    assert (compare(one, two, 0.98)[0] == want).all()


def test_dense_groups_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(embeddup, "SHARD", 150)
    v = _vectors(700, 3)
    linked, least = _plain(v / np.linalg.norm(v, axis=1)[:, None])
    df = spark.createDataFrame([(i, x, "l") for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>, label string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicate_vectors(df).collect()}
    assert got == {i: (int(n), int(c)) for i, (n, c) in enumerate(zip(linked.sum(1), least, strict=True))}
