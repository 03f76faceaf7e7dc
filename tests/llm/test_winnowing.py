"""Fingerprints against a plain rolling hash, window by window."""

from __future__ import annotations

import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from panelwright.llm import winnowing as w

_MASK = (1 << 64) - 1


def _number(word: str) -> int:
    return xxhash.xxh64(word.encode(), seed=42).intdigest()


def plain(text: str) -> list[tuple[int, int]]:
    k, size = w.GRAM, w.WINDOW
    words = re.findall("[^\\x20\\x09-\\x0D]{1,%d}" % w.PIECE, text.lower())
    if len(words) < k:
        whole = 42
        for word in words:
            whole = xxhash.xxh64(_number(word).to_bytes(8, "little"), seed=whole).intdigest()
        return [(0, whole >> w.PLACE_BITS + 1)] if words else []
    hashes, h = [], 0
    for i, word in enumerate(words):
        h = ((h << 1) & _MASK) ^ _number(word) ^ ((_number(words[i - k]) << k) & _MASK if i >= k else 0)
        hashes += [h >> w.PLACE_BITS + 1] if i >= k - 1 else []
    out = []
    for i in range(max(1, len(hashes) - size + 1)):
        seen = hashes[i : i + size]
        place = i + max(j for j, x in enumerate(seen) if x == min(seen))
        if not out or out[-1][0] != place:
            out.append((place, min(seen)))
    return out


def _texts() -> list[str | None]:
    line = [f"word{i * i % 89}" if i % 3 else f"Of-{i}" for i in range(2200)]
    short = [" ".join(line[:n]) for n in (1, 2, 3, 4, 5, 6, 7, 8, 13, 14, 511, 512, 513, 517, 518, 519, 1024, 1025, 1030)]
    # ties in every window, long runs, supplementary code points, all white space
    odd = ["a " * 3000, "ab cd " * 700, "x" * 5000, "𝔸é日\n" * 400, "日本語" * 200, "", None, " \t\n ", " ".join(line), "\t " + " ".join(line[:60]), "Same words " * 9, "same  WORDS " * 9]
    return short + odd


def _plain_rows(rows: list[tuple[int, str | None]]) -> list[tuple]:
    rows, found = [(d, t or "") for d, t in rows], []
    join = lambda x: ",".join(f"{h:x}:{i}" for i, h in x)

    def near(a, b):
        a, b = {h for _, h in a}, {h for _, h in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, new = plain(t), plain(edited)
        sha = hashlib.sha256(edited.encode()).hexdigest()
        found.append((d, len(t), sha, join(own), join(new), near(own, new), near(own, plain(after))))
    return found


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _query_rows(spark, docs, folder) -> list[tuple]:
    docs.write.parquet(f"{folder}/documents.parquet")
    return [tuple(r) for r in w.op13_winnowing(spark, str(folder)).select(COLUMNS).collect()]


def test_op13_matches_brute_force(spark, tmp_path):
    texts = _texts()
    for n, order in enumerate((texts, texts[::-1], texts[::2] + texts[1::2])):
        rows = [(3 * i - 7, t) for i, t in enumerate(order)]
        got = _query_rows(spark, spark.createDataFrame(rows, "doc_id long, text string"), tmp_path / str(n))
        assert sorted(got) == _plain_rows(rows)


def test_op13_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = sorted(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    got = w.op13_winnowing(spark, folder).select(COLUMNS).collect()
    assert sorted(tuple(r) for r in got) == _plain_rows([tuple(r) for r in rows])


def test_op13_odd_documents(spark, odd_documents, no_documents, tmp_path):
    got = _query_rows(spark, odd_documents, tmp_path / "odd")
    assert len(got) == odd_documents.count()
    by_id = {r[0]: r for r in got}
    assert by_id[4][1:4] == (0, by_id[4][2], "") and by_id[1][3] == by_id[2][3] and by_id[None][1] > 0
    assert _query_rows(spark, no_documents, tmp_path / "none") == []
    one = spark.createDataFrame([(5, "all alone " * 30)], "doc_id long, text string")
    assert _query_rows(spark, one, tmp_path / "one") == _plain_rows([(5, "all alone " * 30)])


def test_shared_passages_share_a_hash(spark):
    """Any ``GUARANTEE`` words in a row that two texts share give a common hash, wherever they stand."""
    passage = " ".join(f"w{i * i * 7}" for i in range(w.GUARANTEE))
    texts = [("q " * i + passage + " z" * (60 - i),) for i in range(60)]
    prints = [set(r[0]) for r in spark.createDataFrame(texts, "text string").select(F.transform(w.winnow(F.col("text")), lambda p: p["hash"])).collect()]
    assert set.intersection(*prints)


def test_op13_stays_in_the_jvm(spark):
    plan = w.op13_winnowing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
