"""Components end as soon as the table is one star for each."""

from __future__ import annotations

from panelwright.llm import graph


def _components(spark, links) -> dict[int, int]:
    return {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}


def test_stars_take_no_step(spark, monkeypatch):
    monkeypatch.setattr(graph, "_stars", None)
    assert _components(spark, [(1, 2), (3, 1), (1, 2), (5, 5), (7, None), (8, 9)]) == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    assert _components(spark, []) == {}


def test_paths_and_cycles(spark):
    links = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 32), (32, 30), (40, 42), (41, 42)]
    assert _components(spark, links) == dict.fromkeys(range(21), 0) | dict.fromkeys((30, 31, 32), 30) | dict.fromkeys((40, 41, 42), 40)
