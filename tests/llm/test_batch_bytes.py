"""The pipeline's stages get texts in Arrow batches of bounded bytes, also where 10,000 rows are many bytes."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelwright.llm.common import BATCH_BYTES

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_batches_are_bounded_by_bytes(spark, name, stage):
    text = F.repeat(F.concat(F.lit("some words of prose "), F.col("id").cast("string"), F.lit(" ")), 400)
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"))
    old = spark.conf.get(NAME, None)
    try:
        spark.conf.unset(NAME)
        stage(spark, docs.limit(20), "")

        def tasks(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

        sizes = [r["n"] for r in docs.select("text").mapInArrow(tasks, "n long").collect()]
        assert sum(sizes) > 4 * BATCH_BYTES and max(sizes) <= 1.25 * BATCH_BYTES, (name, sizes)  # before, one batch
        spark.conf.set(NAME, "1000000")
        stage(spark, docs.limit(20), "")
        assert spark.conf.get(NAME) == "1000000"
    finally:
        spark.conf.set(NAME, old) if old is not None else spark.conf.unset(NAME)
