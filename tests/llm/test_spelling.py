"""Spelling variants against all pairs of a small dictionary."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from panelwright.llm import spelling


def one_apart(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(count: dict[str, int]) -> set[tuple]:
    by_size: dict[int, list[str]] = {}
    for w in count:
        by_size.setdefault(len(w), []).append(w)
    near = {w: [v for s in (-1, 0, 1) for v in by_size.get(len(w) + s, []) if one_apart(w, v)] for w in count}
    form = {w: min(near[w], key=lambda v: (-count[v], v), default=None) for w in count}
    form = {w: f if f is not None and count[f] >= 10 * count[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), count[form[w]] if form[w] else None) for w, n in count.items()}


def plain_words(docs) -> dict[str, int]:
    count = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def _rows(df) -> list[tuple]:
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


@pytest.mark.parametrize("limit", [2, 5, 32])
def test_variants_match_all_pairs(spark, limit):
    """Dense blocks, repeated letters (many places for one insertion), short and accented words, chains of forms."""
    draw, count = random.Random(7), {}
    letters = "abÿé"
    for size in (1, 2, 3, 6, 7, 8, 9):
        for _ in range(90):
            count["".join(draw.choice(letters) for _ in range(size))] = 10 ** draw.randrange(6) * draw.randrange(1, 4)
    count |= {"a" * k: 3**k for k in range(1, 14)} | {"intern" + c + "tional": 5 for c in "abcdefghijklmnopqrstuvwxyzàáâ"} | {"interntional": 2}
    got = _rows(spelling.variants(spark.createDataFrame(list(count.items()), "word string, n long"), limit=limit))
    assert len(got) == len(count)
    assert set(got) == plain_variants(count)


def test_op12_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    got = _rows(spelling.op12_spelling_variants(spark, folder))
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = plain_variants(plain_words([tuple(r) for r in docs]))
    assert len(got) == len(want) and set(got) == want


def test_op12_odd_documents(spark, odd_documents, no_documents, tmp_path):
    more = [(100 + i, f"wonderful WONDERFUL wonderfull wonderfÜl {'Straße' * 3} {'z' * 5000}") for i in range(40)]
    docs = odd_documents.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    no_documents.write.parquet(f"{tmp_path}/none/documents.parquet")
    got = _rows(spelling.op12_spelling_variants(spark, f"{tmp_path}/odd"))
    want = plain_variants(plain_words([(r.doc_id, r.text) for r in docs.collect()]))
    assert len(got) == len(want) and set(got) == want and len(want) > 3
    assert _rows(spelling.op12_spelling_variants(spark, f"{tmp_path}/none")) == []
