"""A level of the trees branches each row of a large node once."""

from __future__ import annotations

import numpy as np

from panelwright.llm import neardup


def _group(spark, n: int = 80):
    """``n`` classes that share nearly all minwise values, each a component of its own."""
    draw = np.random.default_rng(6)
    base, rows = draw.integers(0, 1 << 32, neardup.HASHES, dtype=np.uint32), []
    for r in range(n):
        own = base.copy()
        own[draw.choice(neardup.HASHES, 3, replace=False)] = draw.integers(0, 1 << 32, 3, dtype=np.uint32)
        rows.append((r, bytearray(own.tobytes())))
    reps = spark.createDataFrame(rows, "rep long, sig binary")
    big = spark.createDataFrame([(r, 99, n, 0.9) for r in range(n)], "rep long, node long, n long, score double")
    return reps, big, spark.createDataFrame([], "id long, component long")


def test_rows_of_a_level_are_made_once_and_stubborn_nodes_end(spark, monkeypatch):
    made, old = {level: spark.sparkContext.accumulator(0) for level in range(2, neardup.DEPTH + 1)}, neardup._branch

    def counted(parents, level):
        count = made[level]

        def tasks(batches):
            for batch in batches:
                count.add(batch.num_rows)
                yield batch

        return old(parents.mapInArrow(tasks, parents.schema), level)

    monkeypatch.setattr(neardup, "_branch", counted)
    reps, big, labels = _group(spark)
    found = neardup.next_levels(big, reps, labels, 0.85).collect()
    got = [made[level].value for level in made]
    assert got[0] == 80 and got[1] <= 160  # before, each level's rows were made twice
    assert not any(got[neardup.LATE - 1 :])  # at level LATE the nodes still hold nearly all classes, and are compared whole
    assert len({(r["a"], r["b"]) for r in found}) > 0.8 * 80 * 79 / 2  # all classes are close
