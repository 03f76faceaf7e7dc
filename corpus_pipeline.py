"""A corpus in four stages, each written as Parquet and read again as the next one's documents.

1. Language identification: documents go whose language can't be told (``und``: null text or no letters). What stays is
   unchanged, and if no document is labelled all stay.
2. Near-duplicates (a similarity of 0.8 or more): of each group one document stays, the one with the least id. Of rows
   with equal id and text one stays, the first by the other columns; rows with that id and another text, or with a null id, stay.
3. Personal data: every span is replaced by its kind in brackets, and ``n_chars`` follows.
4. Packing into sequences of 1,024 ids (the last stage: its columns are those of the pieces).

All stages bound the bytes of the session's Arrow batches (``bound_batches``). All but the last return the columns they get. Null texts can't reach the second stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.llm import langid, neardup, packing, pii
from panelwright.llm.common import bound_batches, materialise

#: Least similarity of near-duplicates in percent; 85 is the contract of op1_minhash_neardup alone.
PERCENT = 80


def _spare(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    made, model = _spare(docs, "language"), langid.fit(docs)
    if not model[0]:
        return docs
    found = langid.with_language(docs, model, into=made)
    return found.filter(F.col(f"{made}.lang_pred") != "und").select(*(F.col(f"`{c}`") for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    made = _spare(docs, "kept_id")
    groups = neardup.near_duplicates(docs, PERCENT)
    kept = groups.filter("kept").select(F.col("doc_id").alias(made)).distinct()
    named = docs.filter("doc_id is not null").join(kept, F.col("doc_id") == F.col(made), "left_semi")
    rest = [F.to_json(F.struct(f"`{c}`")) for c in docs.columns if c not in ("doc_id", "text")]
    place = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.concat_ws(",", *rest)))
    again = _spare(docs, "again")
    named = named.withColumn(again, place).filter(F.col(again) == 1).drop(again)
    return named.unionByName(docs.filter("doc_id is null"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    made = _spare(docs, "pii")
    found = pii.with_personal_data(docs, into=made)
    new = {"text": F.col(f"{made}.redacted"), "n_chars": F.length(f"{made}.redacted").cast("long")}
    return found.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("personal_data", redacted),
    ("packing", packed),
]
#: The stages learn, join by similarity and tokenize, which SQL can't express; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
