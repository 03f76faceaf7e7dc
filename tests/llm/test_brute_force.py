"""Operators against plain versions of themselves on the small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from oracle import DATA, compare, connect

from panelwright import llm
from panelwright.llm import eliasfano, langid, packing, pii, sentencepieces, tokens

SF = f"{DATA}/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_sql(spark, name):
    assert compare(spark, connect(f"{DATA}/sf0.01"), name, llm.QUERIES[name], llm.ORACLE_SQL[name], f"{DATA}/sf0.01") is None


def test_op1(spark, documents):
    sets = {}
    for i, t in documents.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in sets}
    ids = sorted(sets)
    for _ in range(3):
        for i in ids:
            for j in ids:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
    got = {r["doc_id"]: r for r in llm.QUERIES["op1_minhash_neardup"](spark, SF).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == least
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


def test_op1_groups_of_near_copies(spark):
    """Large groups of copies with edits: components are those of all pairs."""
    from panelwright.llm import neardup

    rng = np.random.default_rng(3)
    rows, sets = [], []
    for g in range(3):
        base = [f"w{g}_{x}" for x in rng.integers(0, 10_000, 150)]
        for _ in range(120):
            own = list(base)
            for k in rng.integers(0, 150, rng.integers(0, 5)):
                own[k] = f"e{rng.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(own)))
            sets.append({tuple(own[k : k + 5]) for k in range(146)})
    label = list(range(len(rows)))
    for _ in range(6):
        for i in range(len(rows)):
            for j in range(i):
                if label[i] != label[j] and i // 120 == j // 120:
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                        label[i] = label[j] = min(label[i], label[j])
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == label


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_op2_rules():
    rng = np.random.default_rng(1)
    for _ in range(4000):
        t = "".join(rng.choice(list("ab1290@@..-+% (é"), rng.integers(1, 40)))
        assert plain_spans(t) == pii.base_spans(t), t


def test_op2_over_the_table(spark, documents):
    for r in llm.QUERIES["op2_pii_bilstm_crf"](spark, SF).collect():
        base = plain_spans(documents[r["doc_id"]] or "")
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == kind for _, k, _ in base) for kind in range(4)]
        text = pii.joined(base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(r["spans"].split(","))


def test_op2_tagger_learns(spark):
    """Precision and recall by kind on windows of documents that weren't trained on, and forms that the rules miss."""
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    w = pii.train(pii.corpus_windows(docs.filter("doc_id % 5 <> 0")), rounds=pii.ROUNDS)
    x, y = pii.corpus_windows(docs.filter("doc_id % 5 = 0"), 800, seed=5)
    assert all(p > 0.75 and r > 0.75 for p, r in pii.quality(x, y, w).values()), pii.quality(x, y, w)
    address = "jörg.müller@exämple-" + "a" * 40 + ".de"
    for before in (0, 450, 500, 580, 640, 1100):
        ((base, every),) = pii.find_spans(["x " * (before // 2) + address + " und weiter" * 20], w)
        assert base == [] and every == [(before, 0, before + len(address))]
    # a rule knows the end of the address only: both spans stay, and redaction leaves nothing of it
    for before in ("", "mail ", "und so weiter " * 90):
        text = before + "anna.müller@web.de und mehr"
        ((base, every),) = pii.find_spans([text], w)
        at = len(before)
        assert base == [(at + 7, 0, at + 18)] and every == [(at, 0, at + 18), (at + 7, 0, at + 18)]
        assert pii.redact(text, every) == before + "[EMAIL] und mehr"
    long = "und so weiter " * 5000 + "a.b@c.org" + " und weiter" * 5000
    ((base, every),) = pii.find_spans([long], w)
    assert base == every == [(70_000, 0, 70_009)]


def test_op2_spans_do_not_depend_on_other_texts():
    w = pii.train(rounds=120)
    texts = ["call (030) 123 45 678 or jörg@exämple.de", "und so weiter " * 300 + "4111.1111.1111.1111", "", "short"]
    alone = [pii.find_spans([t], w)[0] for t in texts]
    pii._DECODED.clear()
    assert pii.find_spans(texts, w) == alone


def test_op2_spans_reach_their_tokens_ends():
    text = "x +49 (030) 1234567, (030) 123 45 678; jörg@exämple.de. 4111.1111.1111.1111"
    for kind, whole in ((3, "+49 (030) 1234567"), (3, "(030) 123 45 678"), (0, "jörg@exämple.de"), (2, "4111.1111.1111.1111")):
        a = text.index(whole)
        b = a + len(whole)
        for cut in ((a, b), (a + 1, b), (a, b - 1), (a - 1, b + 1 if b < len(text) else b), (a + 1, b - 2)):
            assert pii.widened(kind, text, *cut) == (a, b), (whole, cut)


def test_op2_best_sequences():
    """Viterbi against all sequences of four labels."""
    rng, sequences = np.random.default_rng(4), np.stack(np.meshgrid(*[range(pii.LABELS)] * 4, indexing="ij"), -1).reshape(-1, 4)
    trans = (rng.normal(size=(pii.LABELS, pii.LABELS)) + pii._mask()).astype(np.float32)
    emit = rng.normal(size=(4, pii.LABELS, 20)).astype(np.float32)
    begins = np.where((sequences[:, 0] % 2 == 0) & (sequences[:, 0] > 0), pii._FORBIDDEN, 0)
    for row, found in enumerate(pii._viterbi(emit, trans)):
        scores = begins + sum(emit[t, sequences[:, t], row] for t in range(4)) + sum(trans[sequences[:, t - 1], sequences[:, t]] for t in range(1, 4))
        assert found.tolist() == sequences[scores.argmax()].tolist()


def test_op2_bound_skips_no_window(spark):
    """Where Viterbi is left out, outside throughout is its result; most windows of prose are such."""
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    w, rng = pii.train(pii.corpus_windows(docs.filter("doc_id % 5 <> 0")), rounds=pii.ROUNDS), np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abc de@.-+ 0129"), 200, p=[0.1] * 5 + [0.05] * 10)) for _ in range(200)]
    texts += [r.text[i : i + 200] for r in docs.filter("text is not null").limit(50).collect() for i in range(0, len(r.text) - 200, 400)]
    x = np.stack([pii.symbols(t) for t in texts])
    emit = pii.emissions(x, w)
    skipped = pii._all_outside(emit, w["trans"])
    best = pii._viterbi(emit, w["trans"])
    assert not best[skipped].any() and 0 < skipped.sum()


def test_op5_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = llm.QUERIES["op5_language_mixture"](spark, f"{DATA}/sf0.01").collect()
    fold = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in truth}
    assert all(r["held_out"] == fold[r["doc_id"]] for r in got)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert sum(held) >= 0.97 * len(held)


def test_op5_mixture_finds_both_languages():
    rng = np.random.default_rng(0)
    langs = {"a": "xyzzy qwerty plugh".split(), "b": "foobar spam eggs".split()}
    from panelwright.llm.common import flat_text
    import pyarrow as pa

    logp = np.zeros((2, langid.BUCKETS))
    for i, own in enumerate(langs.values()):
        data, _ = flat_text(pa.array([" ".join(rng.choice(own, 500))]))
        counts = np.bincount(langid._trigrams(data), minlength=langid.BUCKETS) + 0.5
        logp[i] = np.log(counts / counts.sum())
    text = " ".join(["xyzzy plugh"] * 30 + ["spam eggs"] * 10)
    (share,) = langid.infer(*flat_text(pa.array([text])), logp.astype(np.float32))
    assert abs(share[0] - 0.75) < 0.05 and abs(share[1] - 0.25) < 0.05


def test_op5_against_plain_expectation_maximisation(spark):
    """The registered query's languages and shares, by loops over words: seven languages, and texts of up to six of them."""
    rng = np.random.default_rng(4)
    own = {f"l{k}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 8))) for _ in range(12)] for k in range(7)}
    rows = [(i, " ".join(rng.choice(own[f"l{i % 7}"], 80)), f"l{i % 7}") for i in range(70)]
    rows += [(100 + m, " ".join(x for k in range(m) for x in rng.choice(own[f"l{k}"], 60)), None) for m in range(1, 7)] + [(200, "", "l1"), (201, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, logp = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    for i, text, _ in rows:
        words = (text or "").split()
        if not words:
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["languages"]) == ("und", 0.0, [])
            continue
        like = []
        for word in words:  # a word's trigrams are those around its letters, its neighbours being spaces
            codes = langid._trigrams(np.frombuffer(f" {word} ".encode(), np.uint8))[1:-1]
            like.append(logp[:, codes].astype(float).sum(1))
        like = np.exp(np.maximum(np.array(like) - np.max(like, 1, keepdims=True), -30))

        def fitted(active):
            share = active / active.sum()
            for _ in range(500):
                part = like * share
                share = (part / part.sum(1, keepdims=True)).mean(0)
            return share, np.log((like * share).sum(1)).sum()

        order, best, top = np.argsort(-fitted(np.ones(7))[0], kind="stable"), None, -np.inf
        for k in range(1, 8):
            share, total = fitted(np.isin(np.arange(7), order[:k]).astype(float))
            value = total - (k - 1) * (langid.PENALTY + 0.5 * np.log(len(words)))
            if value <= top:
                break
            best, top = share, value
        shares = {x["lang"]: x["share"] for x in got[i]["languages"]}
        assert all(abs(shares.get(x, 0) - y) < 0.02 for x, y in zip(langs, best, strict=True)), i
    assert len(got[106]["languages"]) == 6


def test_op7(spark, documents):
    toks = {i: [*words(t), "\n"] for i, t in documents.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    count, pairs, ctx, nexts = collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for i, w in toks.items():
        if not held[i]:
            count.update(w)
            for a, b in zip(["\t", *w], w, strict=False):
                pairs[a, b] += 1
                ctx[a] += 1
                nexts[a].add(b)
    n, v = sum(count.values()), len(count)
    for r in llm.QUERIES["op7_ngram_trie"](spark, SF).collect():
        w = toks[r["doc_id"]]
        base = [(count[x] + 1) / (n + v + 1) for x in w]
        p = [
            (max(pairs[a, x] - 0.75, 0) / ctx[a] + 0.75 * len(nexts[a]) / ctx[a] * b) if ctx[a] else b
            for a, x, b in zip(["\t", *w], w, base, strict=False)
        ]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(map(math.log10, base)), rel_tol=1e-9)
        assert abs(r["score"] - sum(map(math.log10, p))) <= 0.05 * len(w)


def test_op7_small_shards_give_the_same(spark):
    from panelwright.llm import lm

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = {r["doc_id"]: r for r in lm.score(docs, lm.train(docs)).collect()}
    for r in lm.score(docs, lm.train(docs, per_shard=700)).collect():
        assert r["base_score"] == one[r["doc_id"]]["base_score"] and abs(r["score"] - one[r["doc_id"]]["score"]) <= 0.05 * r["n_tokens"]


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, top in ((0, 5), (1, 1), (1, 10**9), (500, 40), (3000, 10**12), (2000, 2001)):
        x = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        ef = eliasfano.EliasFano.of(x, top)
        assert (ef.at(np.arange(n)) == x).all()
        q = rng.integers(0, top, 300).astype(np.uint64)
        assert (ef.successor(q, np.zeros(300, np.int64), np.full(300, n)) == np.searchsorted(x, q)).all()


ODD = ["a  b   c \n\n d  e", "  x", "é è  y", "it's  can't 'll", " lead", "trail  ", "\t\ttab a", "<|endoftext|> a", "日本 語 テキスト  です", "", "a\u0085 b", "x\x0b y \x0c z",
       "　 a", "naïve café\n\n\nfoo 12 3.4 -- !!", "a×,b ÷.c é,d ē! x\n\ny\nz\n é\n日", "don't we'll é's O'Neil", "\na\n", "a\n\n", "a\n b\n\tc"]


def test_memoised_byte_bpe_equals_the_tokenizer(documents):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from panelwright.llm.common import flat_text

    path = tokens.default_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = [*ODD, *list(documents.values())[:40]]
    ids, at = tokens.byte_bpe(path).encode(*flat_text(pa.array(texts)))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_op9_parity_and_decoding(spark, documents):
    import sentencepiece

    path = sentencepieces.default_path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(i, t) for i, t in enumerate([*ODD, *list(documents.values())[:20]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in sentencepieces.decode(sentencepieces.encode(docs)).collect():
        assert r["ids"] == own.encode(r["text"]) and r["decoded"] == r["text"]
    assert all(r["parity"] and r["n_tokens"] == len(own.encode(rows[r["doc_id"]][1])) for r in sentencepieces.digest(docs).collect())


def unigram_model(pieces, byte_fallback: bool) -> bytes:
    """A unigram model file: pieces ``(text, score, type)`` and the trainer's and normaliser's settings."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(number, kind, value):
        return varint(number << 3 | kind) + (varint(len(value)) + value if kind == 2 else value)

    raw = b"".join(field(1, 2, field(1, 2, t.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, varint(k))) for t, s, k in pieces)
    trainer = field(3, 0, varint(1)) + field(35, 0, varint(int(byte_fallback)))
    normaliser = field(1, 2, b"identity") + field(3, 0, varint(1)) + field(4, 0, varint(0)) + field(5, 0, varint(1))
    return raw + field(2, 2, trainer) + field(3, 2, normaliser)


def test_op9_unigram_with_byte_fallback(tmp_path):
    """Scores decide the pieces, characters outside the vocabulary become bytes, and the library agrees."""
    import sentencepiece

    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.choice(list("abcde"), rng.integers(1, 5))) for _ in range(120)})
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", -20.0, 6) for b in range(256))]
    pieces += [(t, float(-rng.uniform(1, 9)), 1) for w in words for t in (w, "▁" + w)] + [("▁", -4.0, 1)]
    path = tmp_path / "unigram.model"
    path.write_bytes(unigram_model(pieces, True))
    own = sentencepieces.Backend(str(path), 1)
    assert own.model["type"] == sentencepieces.UNIGRAM and own.model["byte_fallback"]
    texts = [" ".join("".join(rng.choice(list("abcdeé日x"), rng.integers(1, 9), p=[0.19] * 5 + [0.02, 0.02, 0.01])) for _ in range(8)) for _ in range(60)] + [""]
    ids, same, decoded = own.verified(texts)
    reference = sentencepiece.SentencePieceProcessor(model_file=str(path))
    assert all(same) and ids == reference.encode(texts) and decoded == texts


def test_op10_ids_and_padding(spark, documents):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_path("byte_bpe_50k.json"))
    rows = packing.op10_harmonic_packing(spark, SF).collect()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for i, t in documents.items():
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences = len({r["sequence_id"] for r in rows})
    assert sum(r["length"] for r in rows) > 0.98 * 1024 * sequences
    short = [own for own in pieces.values() if own[0]["doc_tokens"] <= 1024]
    assert sum(len(own) == 1 for own in short) > 0.9 * len(short)


def test_op10_every_id_once():
    """Packing of random lengths: each document's ids in order, sequences without gaps, padding in the last one only."""
    rng = np.random.default_rng(0)
    kinds = [lambda: rng.integers(1, 3000), lambda: rng.integers(520, 700), lambda: rng.integers(1, 20), lambda: rng.choice([1, 341, 1024, 1025, 5000])]
    for draw in kinds:
        for kept, open_bins in ((0, 1), (3000, 5), (1 << 18, 512)):
            packer = packing.Packer(0, 1024, kept, open_bins)
            docs = {i: rng.integers(0, 50_000, int(draw()), dtype=np.uint32).astype("<u4").tobytes() for i in range(300)}
            for i, raw in docs.items():
                packer.add(i, raw)
            packer.finish()
            by, sequences = collections.defaultdict(list), collections.defaultdict(list)
            for r in packer.rows:
                by[r[0]].append(r)
                sequences[r[5]].append(r)
            for i, raw in docs.items():
                at = 0
                for _, start, n, crc, total, _, _ in sorted(by[i], key=lambda r: r[1]):
                    assert start == at and crc == zlib.crc32(raw[4 * at : 4 * (at + n)]) and total == len(raw) // 4
                    at += n
                assert at == len(raw) // 4
            for own in sequences.values():
                offsets = np.cumsum([0, *(r[2] for r in own)])
                assert [r[6] for r in own] == offsets[:-1].tolist() and offsets[-1] <= 1024
            assert 1024 * len(sequences) - sum(len(x) // 4 for x in docs.values()) < 1024