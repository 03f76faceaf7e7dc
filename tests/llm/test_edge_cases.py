"""Each operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import hashlib
import re

import pytest

from panelwright.llm import chat, embeddup, langid, lm, media, neardup, packing, pii, sentencepieces, warc

DOCS = {
    "neardup": neardup.near_duplicates, "pii": pii.personal_data, "langid": langid.identify, "media": media.media_columns,
    "lm": lambda d: lm.score(d, lm.train(d)), "sentencepiece": sentencepieces.digest,
}


@pytest.mark.parametrize("name", DOCS)
def test_a_row_for_each_row(name, odd_documents):
    out = DOCS[name](odd_documents).toPandas()
    assert len(out) == odd_documents.count()
    assert out["doc_id"].isna().sum() == 1


@pytest.mark.parametrize("name", DOCS)
def test_empty_table(name, no_documents):
    assert DOCS[name](no_documents).count() == 0


def test_neardup_components(odd_documents):
    out = {r["doc_id"]: r for r in neardup.near_duplicates(odd_documents).collect()}
    assert out[2]["component_id"] == out[3]["component_id"] == 1
    assert out[1]["kept"] and not out[2]["kept"]
    assert [out[k]["n_shingles"] for k in (4, 5, 6)] == [0, 0, 0] and all(out[k]["kept"] for k in (4, 5, 6))
    assert out[8]["component_id"] == 7 and out[7]["n_shingles"] == 1
    assert out[None]["component_id"] is None and out[None]["kept"] is None


def test_pii_rules_and_digest(odd_documents):
    out = {r["doc_id"]: r for r in pii.personal_data(odd_documents).collect()}
    assert [out[9][k] for k in ("n_email", "n_ip", "n_card", "n_phone")] == [1, 1, 1, 1]
    assert out[4]["base_sha256"] == hashlib.sha256(b"").hexdigest() and out[4]["spans"] == ""


def test_language_of_odd_texts(odd_documents):
    out = {r["doc_id"]: r for r in langid.identify(odd_documents).collect()}
    assert {out[k]["lang_pred"] for k in (4, 5, 6, 12)} == {"und"} and out[4]["score"] == 0
    assert out[11]["lang_pred"] != "und" and all(0 <= r["score"] <= 1 for r in out.values())


def test_media_round_trip(odd_documents):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in odd_documents.collect()}
    for r in media.media_columns(odd_documents).collect():
        raw = texts[r["doc_id"]]
        whole = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest())
        assert media.from_png(media.to_png(whole)) == whole and r["height"] * 64 == len(whole)


def test_packing_holds_each_id_once(odd_documents):
    rows = packing.pack(odd_documents).toPandas()
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].iloc[0] == 0 and (own["offset"].diff().dropna().to_numpy() == own["length"].to_numpy()[:-1]).all()
        assert own["length"].sum() <= 1024
    per_row = rows[rows["doc_id"] == 10].sort_values("start")
    assert per_row["length"].sum() == per_row["doc_tokens"].iloc[0] and (per_row["start"].diff().dropna().to_numpy() == per_row["length"].to_numpy()[:-1]).all()
    assert rows[rows["doc_id"] == 4]["doc_tokens"].tolist() == [1]


def test_packing_empty_table(no_documents):
    assert packing.pack(no_documents).count() == 0


def test_warc_odd_pages(spark):
    rows = [(1, "u", "<p>a</p>"), (2, "u", "<p>a</p>"), (2, "u", "<p>b</p>"), (None, "u", "<p>a</p>"), (4, None, None), (5, "u v\nw", ""), (None, "u", "<p>c</p>")]
    out = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in out), key=repr)
    want = [(1, 8, "response", None), (2, 8, "revisit", 1), (2, 8, "response", None), (None, 8, "revisit", 1), (4, 0, "response", None), (5, 0, "revisit", 4),
            (None, 8, "response", None)]
    assert got == sorted(want, key=repr)
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_repeated_ids(spark):
    """A page id with two payloads that others had first, and a row that occurs twice."""
    for rows, want in (
        ([(1, "a"), (2, "b"), (3, "a"), (3, "b")], [(1, "response", None), (2, "response", None), (3, "revisit", 1), (3, "revisit", 2)]),
        ([(1, "a"), (1, "a")], [(1, "response", None), (1, "revisit", 1)]),
    ):
        out = warc.archive_round_trip(spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")).collect()
        assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in out), key=repr) == sorted(want, key=repr)
        assert len({r["record_id"] for r in out}) == len(rows)


def test_warc_fetches_records_by_identifier(spark):
    rows = [(i, "u", f"<p>{i % 700}</p>" * 40) for i in range(1500)]
    folder = warc.shared_dir(spark, "warc-test")
    index = warc.materialise(warc.write_bundles(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), folder), "warc-index")
    frames = index.groupBy("bundle", "frame").count()
    assert frames.count() < index.count() / 5 and index.filter("offset > 0").count() > 0
    some = index.filter("pmod(xxhash64(record_id), 100) = 0")
    want = {r["record_id"] for r in some.collect()}
    assert {r["record_id"] for r in warc.fetch(index, folder, some).collect()} == want and want


def test_chat_prefixes_and_copies(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"),
            (4, 0, "user", None), (5, None, None, "x"), (None, 0, "user", "q")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.render(turns).collect()}
    assert set(out) == {2, 4, 5, None} and out[2]["copies"] == 2 and out[2]["n_turns"] == 2
    assert out[2]["rendered"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert chat.render(turns.limit(0)).count() == 0


def test_chat_plan_is_native(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat.render(turns)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_vectors_that_cannot_link(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [0.0, 0.0], 0), (5, None, 0), (6, [1.0, None], 0), (7, [float("nan"), 1.0], 0),
            (8, [1.0, 0.0], None), (9, [], 0), (10, [1.0, 0.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = [(r["vec_id"], r["n_links"], r["component_id"]) for r in embeddup.near_duplicate_vectors(vectors).collect()]
    assert sorted(x for x in out if x[0] in (1, 2)) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert all(n == 0 and c == i for i, n, c in out if i not in (1, 2))
    assert embeddup.near_duplicate_vectors(vectors.limit(0)).count() == 0


LEAST, MOST = -(1 << 63), (1 << 63) - 1


def test_extreme_ids(spark):
    """The least and the greatest long, as ids of copies."""
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(LEAST, text), (MOST, text), (-(1 << 62), text + " x"), (MOST - 1, "other words than these")], "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert out == {LEAST: LEAST, MOST: LEAST, -(1 << 62): LEAST, MOST - 1: MOST - 1}
    assert {r["doc_id"] for r in packing.pack(docs).collect()} == set(out)
    vectors = spark.createDataFrame([(LEAST, [1.0, 0.0], 0), (MOST, [1.0, 0.001], 0), (5, [0.0, 1.0], 0)], "vec_id long, embedding array<double>, label int")
    assert {r["vec_id"]: r["component_id"] for r in embeddup.near_duplicate_vectors(vectors).collect()} == {LEAST: LEAST, MOST: LEAST, 5: 5}


def test_neardup_repeated_ids_with_other_texts(spark):
    """Rows of one id are one document: it links what its texts link to."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b + " more"), (4, "else")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()) == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4)]


def test_vectors_of_repeated_ids_and_sizes(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (1, [0.0, 1.0], 1), (3, [0.0, 1.0], 1), (7, [1e200, 0.0], 2), (8, [1e-200, 0.0], 2), (9, [1e200, 1e200], 2)]
    out = embeddup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (7, 1, 7), (8, 1, 7), (9, 0, 9)]
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == want
