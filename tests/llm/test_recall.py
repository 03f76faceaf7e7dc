"""How many links of near copies the trees find, against a join of all shingles."""

from __future__ import annotations

import random

from oracle import DATA

from panelwright.llm import neardup


def _recall(docs) -> tuple[int, int]:
    found = neardup.recall(docs, neardup.near_duplicates(docs)).first()
    return found["links"], found["found"]


def test_recall_on_the_documents(spark):
    links, found = _recall(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"))
    assert links > 0 and found >= 0.9 * links


def test_recall_on_a_group_of_near_copies(spark):
    """600 texts, each with one word of the same 140 changed: pairs are just above the threshold."""
    draw = random.Random(3)
    words = [f"w{i}" for i in range(140)]
    rows = []
    for d in range(600):
        own = list(words)
        own[draw.randrange(140)] = f"x{d}"
        rows.append((d, " ".join(own)))
    links, found = _recall(spark.createDataFrame(rows, "doc_id long, text string"))
    assert links > 1000 and found >= 0.9 * links
