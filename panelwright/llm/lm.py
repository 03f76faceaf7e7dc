"""Language-model scoring with an Elias-Fano n-gram trie of two levels.

Level one holds the training words (64-bit hashes, sorted, in shards by hash range) and their counts; a
word's id is its rank. Level two holds the successors of each word: Elias-Fano pointers to where a
context's successors begin, the successors themselves as one Elias-Fano sequence in which a context's ids
are offset by its place (so it is monotone, and a lookup is a successor search relative to the
context), and one byte for each smoothed probability, an index into the shard's code book, whose values lie
at equal ratios (see ``code_book``). All arrays
are mapped from files in the shared folder; neither level passes through the driver or is broadcast.

With D = ``DISCOUNT``, P(w | v) = max(c(v w) - D, 0) / c(v) + D n(v) / c(v) * base(w), n(v) being the number
of v's successors, and P(w | v) = base(w) if v wasn't seen. base is the add-one unigram of the contract. A text's first
word has the context BEGIN, and the end token is a word like the others.

Counts come from all documents outside the held-out fold, summed in the tasks before every shuffle. A
context with more than ``SHARD_TOKENS`` tokens has several shards of its own, by successor.

Null text is empty: one token, the end. Rows with equal or null ids keep their rows; a null id is not held out.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat_text, materialise, open_store, row_blocks, shared_dir, span_hashes, word_spans
from .eliasfano import Arrays, EliasFano
from .langid import held_out

DISCOUNT, FOLDS, HELD_OUT = 0.75, 7, 2
SHARD_TOKENS = 1_000_000
#: Distinct keys that a task sums before it hands them on.
TASK_KEYS = 700_000
#: Text bytes that a task hashes at once.
HASHED_BYTES = 1 << 20
END, BEGIN = np.uint64(0x1D8AF066C9B50E4F), np.uint64(0x6A3F9C1E55D2B70D)


def _sign(h):
    """Hashes in signed order, as Spark's longs have it."""
    return h.view(np.int64)


def token_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words and its end token; how many tokens each row has."""
    s, e, words = word_spans(data, off)
    h = span_hashes(data, s, e)
    return np.insert(h, np.cumsum(words), END), words + 1


class Summer:
    """Sums counts by key in sorted runs of bounded size."""

    def __init__(self, most: int = TASK_KEYS):
        self.most, self.parts, self.held = most, [], 0

    def add(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        found, n = np.unique(keys, return_counts=True)
        self.parts.append((found, n))
        self.held += len(found)
        if self.held > 2 * self.most:
            merged = self._merged()
            if len(merged[0]) > self.most:
                return merged
            self.parts, self.held = [merged], len(merged[0])
        return None

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in self.parts])
        n = np.concatenate([x for _, x in self.parts])
        self.parts, self.held = [], 0
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        return keys[first], np.add.reduceat(n, first) if len(first) else n

    def rest(self) -> tuple[np.ndarray, np.ndarray] | None:
        return self._merged() if self.parts else None


def _counted(texts: DataFrame, keys_of, shard_of=None) -> DataFrame:
    """``(key long, n long)`` summed in each task, and ``shard long`` if there is ``shard_of(keys)``; ``keys_of(data, off)`` gives int64 keys."""
    names = ["key", "n"] + ["shard"] * (shard_of is not None)

    def tasks(batches):
        sums = Summer()

        def out(found):
            columns = [found[0], found[1].astype(np.int64)] + ([shard_of(found[0])] if shard_of else [])
            return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=names)

        for batch in batches:
            for a, b in row_blocks(batch.column(0), HASHED_BYTES):
                full = sums.add(keys_of(*flat_text(batch.column(0).slice(a, b - a))))
                if full is not None:
                    yield out(full)
        last = sums.rest()
        if last is not None:
            yield out(last)

    return texts.select("text").mapInArrow(tasks, ", ".join(f"{x} long" for x in names))


# ---------------------------------------------------------------- level one


def _write_words(counts: DataFrame, folder: str, shards: int) -> DataFrame:
    """A file for each hash range of ``counts(key, n)``; ``(shard, file, words)``."""

    def tasks(batches):
        keys, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            n.append(batch.column(1).to_numpy())
        keys, n = np.concatenate(keys), np.concatenate(n)
        if not len(keys):
            return
        fs, path = open_store(folder)
        fs.create_dir(path, recursive=True)
        name = f"words-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
            Arrays.dump(out, {"keys": keys, "n": n})
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(keys[0])]), pa.array([name]), pa.array([len(keys)])], names=["first", "file", "words"]
        )

    dealt = counts.repartitionByRange(shards, "key")
    return dealt.sortWithinPartitions("key").mapInArrow(tasks, "first long, file string, words long")


class Words:
    """Level one: ids and counts of word hashes."""

    def __init__(self, folder: str, shards: list[tuple[int, str, int]]):
        self.firsts = np.array([x[0] for x in shards], np.int64)
        self.bases = np.concatenate([[0], np.cumsum([x[2] for x in shards])]).astype(np.int64)
        self.folder, self.names, self.open = folder, [x[1] for x in shards], {}

    def shard(self, i: int) -> dict[str, np.ndarray]:
        """The arrays of one shard, mapped when they are first asked for."""
        if i not in self.open:
            self.open[i] = Arrays.load(f"{self.folder}/{self.names[i]}")
        return self.open[i]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1: none) and count of sorted keys."""
        ids, n = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        cuts = [*np.searchsorted(keys, self.firsts).tolist(), len(keys)]
        for i in range(len(self.names)):
            a, b = cuts[i], cuts[i + 1]
            if a < b:
                own = self.shard(i)
                at = np.searchsorted(own["keys"], keys[a:b])
                at = np.minimum(at, len(own["keys"]) - 1)
                hit = own["keys"][at] == keys[a:b]
                ids[a:b][hit] = self.bases[i] + at[hit]
                n[a:b][hit] = own["n"][at[hit]]
        return ids, n

    def count_of(self, word: int) -> int:
        shard = int(np.searchsorted(self.bases, word, "right")) - 1
        return int(self.shard(shard)["n"][word - self.bases[shard]])


@lru_cache(maxsize=2)
def _words(folder: str, shards: tuple) -> Words:
    return Words(folder, list(shards))


# ---------------------------------------------------------------- level two


def _shard_of(context: np.ndarray, successor: np.ndarray, plan: dict) -> np.ndarray:
    """The number of the shard that has these pairs."""
    shard = np.searchsorted(plan["starts"], context, "right") - 1
    at = np.searchsorted(plan["hot"], context)
    at = np.minimum(at, max(len(plan["hot"]) - 1, 0))
    if len(plan["hot"]):
        hot = plan["hot"][at] == context
        shard[hot] = plan["hot_first"][at[hot]] + successor[hot] * plan["hot_shards"][at[hot]] // plan["words"]
    return shard


def _plan(words: int, counts: DataFrame, shard_rows: list, per_shard: int) -> dict:
    """Shards of about ``per_shard`` tokens: ranges of contexts, and own ones for each larger context.

    The driver gets a row for every shard, none for every word.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = sorted((r["key"], r["n"]) for r in counts.filter(F.col("n") > per_shard).collect())
    level = Words(shard_rows[0], shard_rows[1]) if hot else None
    hot_ids = level.find(np.array([k for k, _ in hot], np.int64))[0] if hot else np.zeros(0, np.int64)
    ranges = max(1, -(-total // per_shard))
    starts = np.unique(np.arange(ranges, dtype=np.int64) * words // ranges)
    parts = np.array([-(-n // per_shard) for _, n in hot], np.int64)
    firsts = len(starts) + np.concatenate([[0], np.cumsum(parts)])[:-1] if hot else np.zeros(0, np.int64)
    return {
        "starts": starts, "hot": hot_ids, "hot_shards": parts, "hot_first": firsts.astype(np.int64), "words": words,
        "shards": len(starts) + int(parts.sum()),
    }


def code_book(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each gain and the value of each byte.

    Up to 256 different gains keep their values. More are dealt into 256 steps of equal ratio between the least and
    the greatest, each step having the mean of its gains: no gain is off by more than (greatest / least)^(1/256),
    and the gains' sum stays.
    """
    levels, codes = np.unique(gain, return_inverse=True)
    if len(levels) > 256:
        step = np.log(gain / levels[0]) * (256 / np.log(levels[-1] / levels[0]))
        _, codes = np.unique(np.minimum(step.astype(np.int64), 255), return_inverse=True)
        levels = np.bincount(codes, gain) / np.bincount(codes)
    return codes.astype(np.uint8), levels


def _write_successors(pairs: DataFrame, folder: str, plan: dict, words_at: tuple) -> DataFrame:
    """A file for each shard of ``pairs(shard, key, n)``, the key being context * 2^31 + successor."""
    words = plan["words"]

    def flush(parts):
        shard = parts[0][0]
        key = np.concatenate([x[1] for x in parts])
        n = np.concatenate([x[2] for x in parts])
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, n = key[first], np.add.reduceat(n, first)
        context, successor = key >> 31, key & ((1 << 31) - 1)
        lowest, highest = int(context[0]), int(context[-1])
        span = highest - lowest + 1
        pointers = np.searchsorted(context, np.arange(lowest, highest + 2))
        # all of a context's tokens have a successor: c(v) is the word's own count
        own_totals = np.add.reduceat(n, np.flatnonzero(np.diff(context, prepend=-1)))
        present = context[np.flatnonzero(np.diff(context, prepend=-1))]
        if lowest == highest and lowest in plan["hot"]:
            own_totals = np.array([_words(*words_at).count_of(lowest)])
        totals = own_totals[np.searchsorted(present, context)]
        gain = np.maximum(n - DISCOUNT, 1e-9) / totals
        codes, levels = code_book(gain)
        fs, path = open_store(folder)
        fs.create_dir(path, recursive=True)
        name = f"next-{uuid.uuid4().hex}"
        ef_p = EliasFano.of(pointers, len(key) + 1)
        ef_s = EliasFano.of((context - lowest) * words + successor, span * words)
        with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
            Arrays.dump(out, {
                "size": np.array([lowest, highest, ef_p.n, ef_p.width, ef_s.n, ef_s.width], np.int64),
                "p_low": ef_p.low, "p_high": ef_p.high, "p_ones": ef_p.ones,
                "s_low": ef_s.low, "s_high": ef_s.high, "s_ones": ef_s.ones,
                "codes": codes, "levels": levels,
            })
        return pa.RecordBatch.from_arrays(
            [pa.array([int(shard)]), pa.array([name]), pa.array([lowest]), pa.array([highest]), pa.array([len(key)])],
            names=["shard", "file", "lowest", "highest", "pairs"],
        )

    def write(batches):
        parts = []
        for batch in batches:
            shard, key, n = (batch.column(i).to_numpy() for i in range(3))
            for piece in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
                if len(piece):
                    if parts and parts[0][0] != shard[piece[0]]:
                        yield flush(parts)
                        parts = []
                    parts.append((shard[piece[0]], key[piece], n[piece]))
        if parts:
            yield flush(parts)

    dealt = pairs.select("shard", "key", "n").repartition(max(1, plan["shards"]), "shard")
    return dealt.sortWithinPartitions("shard", "key").mapInArrow(
        write, "shard long, file string, lowest long, highest long, pairs long"
    )


class Successors:
    """Level two of one shard."""

    def __init__(self, uri: str):
        x = Arrays.load(uri)
        self.lowest, self.highest, n_p, w_p, n_s, w_s = x["size"].tolist()
        self.pointers = EliasFano(n_p, w_p, x["p_low"], x["p_high"], x["p_ones"])
        self.items = EliasFano(n_s, w_s, x["s_low"], x["s_high"], x["s_ones"])
        self.codes, self.levels = x["codes"], x["levels"]

    def find(self, context: np.ndarray, successor: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Quantised gain of each pair (0: none), and the number of the context's successors in this shard."""
        gain, many = np.zeros(len(context)), np.zeros(len(context), np.int64)
        inside = np.flatnonzero((context >= self.lowest) & (context <= self.highest))
        if len(inside):
            place = context[inside] - self.lowest
            start = self.pointers.at(place).astype(np.int64)
            end = self.pointers.at(place + 1).astype(np.int64)
            many[inside] = end - start
            want = (place * words + np.maximum(successor[inside], 0)).astype(np.uint64)
            at = self.items.successor(want, start, end)
            ok = np.flatnonzero((at < end) & (successor[inside] >= 0))
            ok = ok[self.items.at(at[ok]) == want[ok]]
            gain[inside[ok]] = self.levels[self.codes[at[ok]]]
        return gain, many


class Model:
    """Both levels, mapped from the shared folder."""

    def __init__(self, meta: dict):
        self.meta = meta
        self.words = _words(meta["folder"], meta["words_files"])
        self.files, self.open = {k: (name, pairs) for k, name, pairs in meta["next_files"]}, {}
        plan = meta["plan"]
        self.hot_many = np.zeros(len(plan["hot"]), np.int64)
        for i, (first, parts) in enumerate(zip(plan["hot_first"].tolist(), plan["hot_shards"].tolist(), strict=True)):
            self.hot_many[i] = sum(self.files[s][1] for s in range(first, first + parts) if s in self.files)

    def shard(self, k: int) -> Successors | None:
        """One shard of level two, mapped when it is first asked for."""
        if k not in self.open:
            self.open[k] = Successors(f"{self.meta['folder']}/{self.files[k][0]}") if k in self.files else None
        return self.open[k]

    def base(self, count: np.ndarray) -> np.ndarray:
        return (count + 1) / (self.meta["tokens"] + self.meta["vocabulary"] + 1)

    def bigrams(self, context: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gain of each pair of ids and the number of the context's successors."""
        plan, words = self.meta["plan"], self.meta["plan"]["words"]
        gain, many = np.zeros(len(context)), np.zeros(len(context), np.int64)
        shard = _shard_of(context, np.maximum(successor, 0), plan)
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            own = self.shard(int(shard[part[0]])) if len(part) else None
            if own is not None:
                gain[part], many[part] = own.find(context[part], successor[part], words)
        if len(plan["hot"]):
            at = np.minimum(np.searchsorted(plan["hot"], context), len(plan["hot"]) - 1)
            hot = plan["hot"][at] == context
            many[hot] = self.hot_many[at[hot]]
        return gain, many

    def score(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and score of each row."""
        h, tokens = token_hashes(data, off)
        h = _sign(h)
        first = np.cumsum(tokens) - tokens
        begin = np.append(h, _sign(np.array([BEGIN]))[0])
        found, back = np.unique(begin, return_inverse=True)
        ids, n = self.words.find(found)
        ids, n = ids[back], n[back]
        before = np.empty(len(h), np.int64)
        before[1:] = np.arange(len(h) - 1)
        before[first] = len(h)
        # equal pairs of a block are looked up once
        context, successor, of = ids[before], ids[:-1], n[before]
        base = self.base(n[:-1])
        p = base.copy()
        seen = np.flatnonzero(context >= 0)
        if len(seen):
            key = (context[seen] << 31) | (successor[seen] + 1)
            pairs, back = np.unique(key, return_inverse=True)
            gain, many = self.bigrams(pairs >> 31, (pairs & ((1 << 31) - 1)) - 1)
            p[seen] = gain[back] + DISCOUNT * many[back] / of[seen] * base[seen]
        return (
            tokens, np.add.reduceat((n[:-1] > 0).astype(np.int64), first), np.add.reduceat(np.log10(base), first),
            np.add.reduceat(np.log10(p), first),
        )


@lru_cache(maxsize=2)
def _model(key: str, frozen) -> Model:
    return Model(frozen.meta)


class _Frozen:
    """Wraps the model's facts so that they can be part of a cache call without being hashed."""

    def __init__(self, meta: dict):
        self.meta = meta

    def __hash__(self) -> int:
        return 0

    def __eq__(self, other) -> bool:
        return True


def train(texts: DataFrame, folder: str | None = None, per_shard: int = SHARD_TOKENS) -> dict:
    """Count ``texts(text)`` and write the trie; the facts that scoring needs (file names, sizes, totals)."""
    spark = texts.sparkSession
    folder = folder or shared_dir(spark, "lm")
    begin = int(_sign(np.array([BEGIN]))[0])

    def words_and_begin(data, off):
        h, tokens = token_hashes(data, off)
        return _sign(np.append(h, np.full(len(tokens), BEGIN)))

    counts = materialise(_counted(texts, words_and_begin).groupBy("key").agg(F.sum("n").alias("n")), "lm-counts")
    facts = counts.agg(
        F.count("*"), F.coalesce(F.sum(F.when(F.col("key") != begin, F.col("n"))), F.lit(0)),
        F.coalesce(F.sum((F.col("key") == begin).cast("int")), F.lit(0)),
    ).first()
    words = int(facts[0])
    if words >= 1 << 31:
        raise ValueError("ids of 31 bits are too few")
    files = materialise(_write_words(counts, folder, max(1, -(-words // 1_000_000))), "lm-words").collect()
    word_files = tuple(sorted((r["first"], r["file"], r["words"]) for r in files))
    plan = _plan(words, counts, (folder, word_files), per_shard) if words else None

    next_files: tuple = ()
    if words:

        def pair_keys(data, off):
            level = _words(folder, word_files)
            h, tokens = token_hashes(data, off)
            with_begin = _sign(np.insert(h, np.cumsum(tokens) - tokens, BEGIN))
            found, back = np.unique(with_begin, return_inverse=True)
            ids = level.find(found)[0][back]
            keys = (ids[:-1] << 31) | ids[1:]
            end = np.cumsum(tokens + 1)[:-1]
            return np.delete(keys, end - 1)

        pairs = _counted(texts, pair_keys, lambda key: _shard_of(key >> 31, key & ((1 << 31) - 1), plan))
        written = materialise(_write_successors(pairs, folder, plan, (folder, word_files)), "lm-next").collect()
        next_files = tuple(sorted((r["shard"], r["file"], r["pairs"]) for r in written))
    return {
        "folder": folder, "words_files": word_files, "next_files": next_files, "plan": plan, "tokens": int(facts[1]),
        "vocabulary": words - int(facts[2]),
    }


def score(docs: DataFrame, meta: dict) -> DataFrame:
    """``(doc_id, n_tokens, n_known, base_score, score)`` for each row of ``docs(doc_id, text)``."""
    frozen = _Frozen(meta)

    def tasks(batches):
        model = _model(meta["folder"], frozen) if meta["plan"] else None
        for batch in batches:
            for a, b in row_blocks(batch.column(1), HASHED_BYTES):
                data, off = flat_text(batch.column(1).slice(a, b - a))
                if model is not None:
                    cols = model.score(data, off)
                else:  # nothing was learned: every token has probability 1
                    tokens = token_hashes(data, off)[1]
                    cols = (tokens, np.zeros(b - a, np.int64), np.zeros(b - a), np.zeros(b - a))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *map(pa.array, cols)],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        tasks, "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )


def op7_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fold = held_out("doc_id", FOLDS, HELD_OUT)
    meta = train(docs.filter(~fold))
    return score(docs, meta).select(
        "doc_id", fold.alias("held_out"), "n_tokens", "n_known", F.lit(meta["tokens"]).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
