"""Language identification by multilingual mixture inference.

Each language has a smoothed distribution over hashed byte trigrams. A document is a mixture: each of
its words comes from one language, with the likelihood of the word's trigrams, and expectation-
maximisation finds the proportions, until none moves by more than ``TOLERANCE``. The language set is chosen by penalised likelihood: the sets
of the 1, 2, 3, ... largest proportions are fitted again, as long as each further language raises the log
likelihood by more than ``PENALTY`` and half the logarithm of the number of words.

The classifier learns from labelled documents outside the held-out fold, at most about
``TRAIN_DOCUMENTS`` of each language, taken by a hash of the id (all of them where there are fewer).
The model is a table of (languages x 32,768) floats, the only thing that is broadcast; its size depends on the number of
languages, not on the corpus, and more than ``MAX_LANGUAGES`` are refused.

Null text, or one without letters: ``und``, score 0. So is everything if no document is labelled.
Language, source and id are never inputs of a prediction. Rows with equal or null ids keep their rows;
a null id is not held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat_text, row_blocks, word_spans

BUCKETS = 1 << 15
TRAIN_DOCUMENTS, MAX_LANGUAGES = 20_000, 500
TOLERANCE, PENALTY = 1e-3, 3.0
FOLDS, HELD_OUT = 4, 2

#: Bytes as the model sees them: A-Z as a-z, letters and bytes of other scripts as they are, all else a space.
_SEEN = np.full(256, 32, np.uint32)
_SEEN[97:123] = np.arange(97, 123)
_SEEN[65:91] = np.arange(97, 123)
_SEEN[128:] = np.arange(128, 256)


def held_out(doc_id: str = "doc_id", folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def _trigrams(data: np.ndarray) -> np.ndarray:
    """The bucket of the trigram around each byte; ends of the block are spaces."""
    seen = np.full(len(data) + 2, 32, np.uint32)
    seen[1:-1] = _SEEN[data]
    code = (seen[:-2] << np.uint32(16)) | (seen[1:-1] << np.uint32(8)) | seen[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(17)


def _lettered_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the words that hold a letter or a byte of another script."""
    s, e, words = word_spans(data, off)
    rows = np.repeat(np.arange(len(words)), words)
    seen = np.concatenate([[0], np.cumsum(_SEEN[data] != 32)])
    ok = seen[e] > seen[s]
    return s[ok], e[ok], rows[ok]


def trigram_counts(labelled: DataFrame) -> DataFrame:
    """``(lang, bucket, n)`` over ``labelled(lang, text)``, summed in the tasks before the shuffle."""

    def tasks(batches):
        names: dict[str, int] = {}
        sums = np.zeros((0, BUCKETS), np.int64)
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, b in row_blocks(batch.column(1)):
                data, off = flat_text(batch.column(1).slice(a, b - a))
                s, e, rows = _lettered_words(data, off)
                own = np.array([names.setdefault(x, len(names)) for x in langs[a:b]], np.int64)
                if len(names) > len(sums):
                    sums = np.concatenate([sums, np.zeros((len(names) - len(sums), BUCKETS), np.int64)])
                size = e - s
                first = np.cumsum(size) - size
                at = np.repeat(s - first, size) + np.arange(size.sum())
                codes = np.repeat(own[rows], size) * BUCKETS + _trigrams(data)[at]
                sums += np.bincount(codes, minlength=len(sums) * BUCKETS).reshape(sums.shape)
        for name, i in names.items():
            there = np.flatnonzero(sums[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(there), pa.string()), pa.array(there), pa.array(sums[i][there])], names=["lang", "bucket", "n"]
            )

    rows = labelled.select("lang", "text").mapInArrow(tasks, "lang string, bucket long, n long")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, most: int = TRAIN_DOCUMENTS) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of the buckets, from ``docs(doc_id, text, lang)``."""
    train = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    train = train.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, BUCKETS), np.float32)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, most / sizes[k]))])[F.col("lang")]
    taken = train.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    counts = np.zeros((len(langs), BUCKETS))
    table = trigram_counts(taken).toPandas()
    counts[table["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), table["bucket"].to_numpy(int)] = table["n"]
    smooth = counts + 0.5
    return langs, np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)


def _only(like: np.ndarray, rows: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of the rows to ``keep``, and their rows numbered anew."""
    mine = keep[rows]
    return like[mine], (np.cumsum(keep) - 1)[rows[mine]]


def _mixture(like: np.ndarray, rows: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the ``active`` languages of each row (rows x languages) and the log likelihood.

    ``like`` (words x languages) belongs to ``rows``, which are sorted and all there. Rows that stand still are left out of further steps.
    """
    out = active / active.sum(1, keepdims=True)
    live, own, at, share = np.arange(len(active)), like, rows, out
    while len(live):
        first = np.flatnonzero(np.diff(at, prepend=-1))
        part = own * share[at]
        part /= part.sum(1, keepdims=True)
        new = np.add.reduceat(part, first) / np.diff(np.append(first, len(at)))[:, None]
        still = np.abs(new - share).max(1) <= TOLERANCE
        out[live], share = new, new
        if still.any():
            own, at = _only(own, at, ~still)
            live, share = live[~still], new[~still]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    return out, np.add.reduceat(np.log((like * out[rows]).sum(1)), first)


def infer(data: np.ndarray, off: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Proportions of the chosen languages (rows x languages); none for a row without letters."""
    shares = np.zeros((len(off) - 1, len(logp)))
    s, e, rows = _lettered_words(data, off)
    if not len(s) or not len(logp):
        return shares
    codes = _trigrams(data)
    edges = np.stack([s, e], 1).ravel()
    like = np.empty((len(s), len(logp)))
    for k, table in enumerate(logp):
        sums = np.concatenate([[0.0], np.cumsum(table[codes], dtype=np.float64)])[edges]
        like[:, k] = sums[1::2] - sums[::2]
    like -= like.max(1, keepdims=True)
    np.exp(np.maximum(like, -30.0), out=like)
    present, first, words = np.unique(rows, return_index=True, return_counts=True)
    dense = np.searchsorted(present, rows)
    share, _ = _mixture(like, dense, np.ones((len(present), len(logp))))
    rank = np.argsort(np.argsort(-share, 1, kind="stable"), 1)
    chosen = (rank < 1).astype(float)
    top = np.add.reduceat(np.log((like * chosen[dense]).sum(1)), first)
    live, own, at = np.arange(len(present)), like, dense
    for k in range(2, len(logp) + 1):
        fitted, total = _mixture(own, at, (rank[live] < k).astype(float))
        value = total - (k - 1) * (PENALTY + 0.5 * np.log(words[live]))
        better = value > top[live]
        top[live[better]], chosen[live[better]] = value[better], fitted[better]
        own, at = _only(own, at, better)
        live = live[better]
        if not len(live):
            break
    shares[present] = chosen
    return shares


_FOUND = "lang_pred string, score double, languages array<struct<lang: string, share: double>>"


def _predicted(column: pa.Array, langs: list[str], logp: np.ndarray) -> list[dict]:
    out = []
    for a, b in row_blocks(column):
        part = column.slice(a, b - a)
        data, off = flat_text(part)
        shares = infer(data, off, logp)
        # a row with nothing but marks outside ASCII has words here, but maybe no letter
        ascii_letters = np.concatenate([[0], np.cumsum((_SEEN[data] != 32) & (data < 128))])
        for i in np.flatnonzero(shares.any(1) & (ascii_letters[off[1:]] == ascii_letters[off[:-1]])).tolist():
            if not any(map(str.isalpha, part[i].as_py())):
                shares[i] = 0
        for row in shares:
            own = sorted(((langs[i], min(float(row[i]), 1.0)) for i in np.flatnonzero(row).tolist()), key=lambda x: (-x[1], x[0]))
            lang, score = own[0] if own else ("und", 0.0)
            out.append({"lang_pred": lang, "score": score, "languages": [{"lang": x, "share": y} for x, y in own]})
    return out


def with_language(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", into: str = "language") -> DataFrame:
    """Adds the struct column ``into`` (lang_pred, score, and the chosen languages with their shares) to ``docs``, keeping all its columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(_FOUND)
    def predict(column: pa.Array) -> pa.Array:
        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))])
        return pa.array(_predicted(column, *shared.value), kind)

    return docs.withColumn(into, predict(F.col(text)))


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, languages)`` for each row of ``docs(doc_id, text, lang)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    found = with_language(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score", "language.languages")


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
