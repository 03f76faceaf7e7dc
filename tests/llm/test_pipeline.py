"""The pipeline's stages take effect, stage by stage, on their own input."""

from __future__ import annotations

from oracle import DATA

import corpus_pipeline
from panelwright.llm import langid, neardup, pii

SF = f"{DATA}/sf0.001"


def test_stages(spark, odd_documents):
    docs = odd_documents
    names = docs.columns
    known = corpus_pipeline.known_language(spark, docs, SF)
    assert known.columns == names
    ids = sorted((r["doc_id"] for r in known.collect()), key=lambda x: (x is None, x))
    want = {r["doc_id"] for r in langid.identify(docs).collect() if r["lang_pred"] != "und"}
    assert set(ids) == want and 4 not in want and 7 in want
    single = corpus_pipeline.one_of_each_group(spark, known, SF)
    assert single.columns == names
    kept = {r["doc_id"] for r in neardup.near_duplicates(known).collect() if r["kept"]}
    assert {r["doc_id"] for r in single.collect()} == kept | {None} and single.count() == len(kept) + 1
    clean = corpus_pipeline.redacted(spark, single, SF)
    assert clean.columns == names
    rows = {r["doc_id"]: r for r in clean.collect()}
    assert rows[9]["text"] == "mail [EMAIL] or [PHONE], [IP] card [CARD] end" and rows[9]["n_chars"] == len(rows[9]["text"])
    assert rows[1]["text"] == docs.filter("doc_id = 1").first()["text"]
    packed = corpus_pipeline.packed(spark, clean, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(rows)


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), "stage")
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, docs.collect()))


def test_redaction_merges_overlaps():
    assert pii.redact("a bcd e", [(2, 3, 4), (3, 1, 5)]) == "a [PHONE] e"
