"""Inputs on which an operator once did less than its whole job."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from panelwright.llm import chat, lm, neardup


def test_op7_hot_context_has_its_probabilities(spark):
    """A context of more tokens than a shard, with Zipf successors: every text's score against exact probabilities."""
    rng = np.random.default_rng(5)
    weight = 1 / np.arange(1, 60_001)
    drawn = rng.permutation(60_000)[rng.choice(60_000, 1_200_000, p=weight / weight.sum())]
    texts = [" ".join(f"hot w{x}" for x in part) for part in np.split(drawn, 60)]
    asked = np.unique(drawn, return_index=False)[::300].tolist() + np.argsort(-np.bincount(drawn))[:40].tolist()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    meta = lm.train(docs)
    assert len(meta["plan"]["hot"]) == 1
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame([(x, f"hot w{x}") for x in asked], docs.schema), meta).collect()}

    n = np.bincount(drawn, minlength=60_000)
    last = np.bincount([part[-1] for part in np.split(drawn, 60)], minlength=60_000)
    successors, kinds = len(drawn), int((n > 0).sum())
    slots = meta["tokens"] + meta["vocabulary"] + 1
    d = lm.DISCOUNT
    for x in asked:
        first = (60 - d) / 60 + d * 1 / 60 * (successors + 1) / slots
        word = (n[x] - d) / successors + d * kinds / successors * (n[x] + 1) / slots
        after = (1 if n[x] > last[x] else 0) + (1 if last[x] else 0)
        end = max(last[x] - d, 0) / n[x] + d * after / n[x] * 61 / slots
        assert abs(got[x] - np.log10([first, word, end]).sum()) < 0.03, x


def test_op7_code_book_keeps_the_sum():
    n = np.unique(np.random.default_rng(1).zipf(1.3, 50_000))
    gain = (n - lm.DISCOUNT) / n.sum()
    codes, levels = lm.code_book(gain)
    assert len(levels) <= 256 and abs(levels[codes].sum() / gain.sum() - 1) < 1e-9
    assert np.abs(np.log(levels[codes] / gain)).max() <= np.log(gain.max() / gain.min()) / 256 + 1e-9
    few = np.array([0.5, 0.25, 0.5])
    codes, levels = lm.code_book(few)
    assert (levels[codes] == few).all()


def test_pipeline_takes_near_copies_of_four_fifths(spark):
    """One replaced word of 57 is a Jaccard of 48 / 58 = 0.83, one of 45 is 36 / 46 = 0.78; op1's own threshold is 0.85."""
    long, short = [f"long{i}" for i in range(57)], [f"short{i}" for i in range(45)]
    other = lambda words: [*words[:20], "other", *words[21:]]
    rows = [(i, " ".join(x)) for i, x in enumerate([long, other(long), short, other(short)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()) == [0, 2, 3]
    assert sorted(r["doc_id"] for r in neardup.near_duplicates(docs).collect() if r["kept"]) == [0, 1, 2, 3]


@pytest.fixture
def many_tasks(spark):
    """Small partitions stay apart, and there are as many as a large table would have."""
    new = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_op4_long_conversations_and_turns_without_one(spark, many_tasks):
    """A conversation that spans many tasks, its snapshots, and turns of no conversation, which aren't one conversation."""
    said = [(i // 3, f"r{i % 3}", f"t{i % 7}") for i in range(3000)]
    rows = [(1, *x) for x in said] + [(2, *x) for x in said[:1999]] + [(3, *x) for x in said] + [(4, *x) for x in said[:1500]] + [(4, 500, "r0", "else")]
    rows += [(None, 0, "user", "a"), (None, 1, "user", "b"), (None, 2, "user", "b"), (None, 0, "r0", "t0"), (5, 0, "user", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    out = sorted((r["conv_id"] or 0, r["n_turns"], r["copies"], r["rendered"]) for r in chat.render(turns).collect())
    line = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    full, part = ("".join(line(*x[1:]) for x in y) for y in (said, said[:1500]))
    want = [(0, 1, 2, line("user", "b")), (1, 3000, 2, full), (4, 1501, 1, part + line("r0", "else")), (5, 1, 2, line("user", "a"))]
    assert out == want
    parts = {(r["conv_id"], r["part"]) for r in chat.placed(turns).select("conv_id", "part").distinct().collect()}
    assert sum(conv_id == 1 for conv_id, _ in parts) > 1
