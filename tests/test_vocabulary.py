"""Terms as whole words: what counts as one, and that a scan costs little more than the text's reading."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from panelwright.operators import selection

OLD = "(^|[^a-z0-9_])data([^a-z0-9_]|$)"


def test_terms_are_whole_words(spark):
    texts = ["data", "Data!", "(data)", "x data", "data\n", "\ndata", "\u00e9data\u00e9", "data data_", "databases", "metadata", "data_", "_data", "data2 metadata data", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"] for r in selection.vocabulary_matches(docs, {"data": "q"}).collect()}
    want = {r["id"] for r in docs.filter(F.lower("text").rlike(OLD)).collect()}
    assert got == want and {0, 1, 2, 3, 4, 5, 6, 7, 12} == got
    assert [r["id"] for r in selection.vocabulary_matches(docs.limit(0).unionByName(spark.createDataFrame([(1, "a c++ b"), (2, "c+")], "id int, text string")), {"c++": "q"}).collect()] == [1]


def test_scan_is_much_faster_than_a_pattern_that_begins_with_a_choice(spark):
    docs = spark.range(2000).select(F.col("id"), F.concat(F.repeat(F.lit("some words of a text "), 500), F.col("id").cast("string")).alias("text")).cache()
    docs.count()

    def seconds(df) -> float:
        took = []
        for _ in range(3):
            at = time.perf_counter()
            assert df.count() == 0
            took.append(time.perf_counter() - at)
        return min(took)

    assert seconds(selection.vocabulary_matches(docs, {"data": "q"})) < seconds(docs.filter(F.lower("text").rlike(OLD))) / 2
