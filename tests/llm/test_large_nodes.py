"""Nodes that stay large to the last level of the trees lose no candidate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from panelwright.llm import neardup


def test_large_nodes_of_the_last_level_are_compared_whole(spark, monkeypatch):
    """Pairs of equal minwise values in a node whose other classes share nearly all of them: the hub is close to its own pair only."""
    monkeypatch.setattr(neardup, "DEPTH", 2)
    monkeypatch.setattr(neardup, "GRID", 7)
    draw = np.random.default_rng(5)
    base, rows = draw.integers(0, 1 << 32, neardup.HASHES, dtype=np.uint32), []
    for pair in range(30):
        own = base.copy()
        own[-6:] = pair
        rows += [(2 * pair, own.tobytes()), (2 * pair + 1, own.tobytes())]
    reps = spark.createDataFrame([(r, bytearray(sig)) for r, sig in rows], "rep long, sig binary")
    big = spark.createDataFrame([(r, 99, 60, 0.9) for r, _ in rows], "rep long, node long, n long, score double")
    labels = spark.createDataFrame([], "id long, component long")
    got = {(r["a"], r["b"]) for r in neardup.next_levels(big, reps, labels, 0.99).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(30)}


def test_near_misses_of_a_large_node_are_no_candidates(spark, monkeypatch):
    """90 texts whose minwise values pass the floor, few of them linked: the last level returns no more than the links that join components."""
    monkeypatch.setattr(neardup, "DEPTH", 2)
    monkeypatch.setattr(neardup, "GRID", 20)
    monkeypatch.setattr(neardup, "COLUMNS", 64)
    texts = []
    for d in range(90):
        words = [f"w{i}" for i in range(100)]
        for place in (20, 50, 80) if d >= 12 else (10 + 20 * (d // 4),) * 3:
            words[place] = f"x{d}"
        if d < 12:
            words[60 + 10 * (d // 4)] = f"y{d // 4}"
        texts.append((d, " ".join(words)))
    frame = spark.createDataFrame(texts, "rep long, text string")
    close = neardup.estimate_floor(85)
    reps = frame.withColumn("sig", F.lit(bytearray(np.ones(neardup.HASHES, np.uint32).tobytes())))
    big = spark.createDataFrame([(d, 99, 90, 0.9) for d in range(90)], "rep long, node long, n long, score double")
    labels = spark.createDataFrame([(d, 4 * (d // 4)) for d in range(8)], "id long, component long")
    found = neardup.next_levels(big, reps.select("rep", "sig"), labels, close, lambda ids: frame.join(ids, "rep")).collect()
    assert len(found) < 2 * 90  # the hub's and the links; before, 3,993
    sets = [{tuple(t.split()[i : i + 5]) for i in range(96)} for _, t in texts]
    comp = [4 * (d // 4) if d < 8 else d for d in range(90)]
    pairs = ((i, j) for i in range(90) for j in range(i + 1, 90) if comp[i] != comp[j])
    links = {(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    kept = links & {(r["a"], r["b"]) for r in found}
    assert 0 < len(kept) and _least(comp, kept) == _least(comp, links)


def _least(comp: list[int], links: set[tuple[int, int]]) -> list[int]:
    comp = list(comp)
    for i, j in sorted(links) * len(comp):
        comp[i] = comp[j] = min(comp[i], comp[j])
    return comp
