"""Spelling variants: words one edit apart, grouped under the far more frequent form.

One inserted, deleted or replaced code point leaves the first or the second half of a word as it is. So each word stands in a
forward dictionary, sorted by its first half, and in a reversed one, sorted by its second half from the end; words that share
a half are neighbours there, a block. For a pair the halves are those of the longer word (``m`` code points), so a word is
listed with ``m`` its own length and once more with ``m`` one above that, as the shorter of a pair.

A block with more than ``LIMIT`` words is subdivided the same way: what its words don't share yet has halves too, and the edit
leaves one of them intact. Subdividing ends where a single code point is open; such a block has as many words as there are
letters. Blocks are then scanned in sorted order and their pairs verified; only near pairs leave a task. The place of a pair's
edit is its first difference, which lies in exactly one block, so no pair is found twice.

Null words and texts count for nothing; words are compared by code points, ties broken by their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: Letters of a word; only A-Z are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT = 7, 2
#: How many times as frequent as a word its form is, at least.
RATIO = 10
#: Words of a block that are compared with each other; larger blocks are subdivided.
LIMIT = 32


# ---------------------------------------------------------------- the dictionary


def runs(docs: DataFrame, min_length: int) -> DataFrame:
    """``(doc_id, run)``: maximal runs of letters of at least ``min_length`` code points, A-Z lower-cased, one row for each occurrence."""
    found = F.regexp_extract_all(F.col("text").cast("string"), F.lit("[%s]{%d,}" % (LETTERS, min_length)), F.lit(0))
    rows = docs.select("doc_id", F.explode(found).alias("run"))
    return rows.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def counted(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)`` of a table with one ``word`` a row; counts are gathered before the shuffle."""
    long_enough = words.filter(F.length("word") >= min_length)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


# ---------------------------------------------------------------- blocks of words that share a half


def _halved(rows: DataFrame) -> DataFrame:
    """Every row's two sub-blocks: its open part's first half shared as well, and its second half.

    ``rows(word, n, m, lo, hi)``: of the ``m`` code points of the longer word, ``lo`` at the start and ``hi`` at the end are
    shared. Of ``r`` open ones the edit spares the first r // 2 or else, being among these, the last r - r // 2.
    """
    open_ = F.col("m") - F.col("lo") - F.col("hi")
    half = F.floor(open_ / 2).cast("int")
    both = F.array(
        F.struct((F.col("lo") + half).alias("lo"), F.col("hi").alias("hi")),
        F.struct(F.col("lo").alias("lo"), (F.col("hi") + open_ - half).alias("hi")),
    )
    # with one open code point there is nothing to halve
    parts = rows.select("word", "n", "m", F.explode(F.when(half > 0, both).otherwise(F.slice(both, 1, 1))).alias("part"))
    held = parts.select("word", "n", "m", "part.*")
    start = F.substring("word", F.lit(1), F.col("lo"))
    end = F.reverse(F.right("word", F.col("hi")))
    return held.withColumn("block", F.concat_ws("/", "m", "lo", "hi", start, end))


def _first_blocks(words: DataFrame) -> DataFrame:
    """The forward and the reversed dictionary: rows by shared half, for a word as the longer and as the shorter of a pair."""
    size = F.length("word")
    as_any = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("m"))
    return _halved(as_any.select("word", "n", "m", F.lit(0).alias("lo"), F.lit(0).alias("hi")))


_PAIRS = pa.schema([("word", pa.string()), ("other", pa.string()), ("other_n", pa.int64())])


def _near_of_block(words: list[tuple[str, int]], m: int, lo: int, hi: int) -> Iterator[tuple[str, int, str, int]]:
    """Pairs of a block whose first difference is in its open part and which are equal after it."""
    longer = [w for w in words if len(w[0]) == m]
    shorter = [w for w in words if len(w[0]) < m]
    for k, (v, v_n) in enumerate(longer):
        for others, skipped in ((longer[:k], 1), (shorter, 0)):
            for u, u_n in others:
                i, end = lo, min(m - hi, len(u))
                while i < end and u[i] == v[i]:
                    i += 1
                if i < m - hi and u[i + skipped :] == v[i + 1 :]:
                    yield u, u_n, v, v_n


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs, both ways, of rows sorted by block; holds one block at a time."""
    block, held = None, []

    def rows(done: list[list[tuple]]) -> pa.RecordBatch:
        out = [(a, b, b_n) for found in done for u, u_n, v, v_n in found for a, b, b_n in ((u, v, v_n), (v, u, u_n))]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_PAIRS)], schema=_PAIRS)

    for batch in batches:
        done = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("m", "lo", "hi", "block", "word", "n")), strict=True):
            if row[3] != block:
                done.append(list(_near_of_block(held, *place)) if len(held) > 1 else [])
                block, held, place = row[3], [], row[:3]
            held.append(row[4:])
        yield rows(done)
    if held:
        yield rows([list(_near_of_block(held, *place))])


def _scanned(rows: DataFrame) -> DataFrame:
    ranged = rows.repartitionByRange("block").sortWithinPartitions("block").select("m", "lo", "hi", "block", "word", "n")
    return ranged.mapInArrow(_scan, "word string, other string, other_n long")


def near_pairs(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(word, other, other_n)`` for every two of ``words(word, n)`` (distinct) that are one edit apart, both ways."""
    level, found = materialise(_first_blocks(words), "spelling-halves"), []
    while True:
        is_longer = F.length("word") == F.col("m")
        sizes = level.groupBy("block").agg(F.count("*").alias("size"), F.max(is_longer).alias("any"), F.first(F.col("m") - F.col("lo") - F.col("hi")).alias("open"))
        # blocks of one word, or without a longer word, have no pair
        sizes = materialise(sizes.filter(F.col("any") & (F.col("size") > 1)), "spelling-sizes")
        large = (F.col("size") > limit) & (F.col("open") > 1)
        found.append(_scanned(level.join(sizes.filter(~large).select("block"), "block", "left_semi")))
        rest = sizes.filter(large).select("block")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, found)
        level = materialise(_halved(level.join(rest, "block", "left_semi")), "spelling-halves")


# ---------------------------------------------------------------- forms and roots


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms(word, form)``: where following forms ends. Each step doubles the way that a word has gone."""
    way = materialise(forms.select("word", F.col("form").alias("to")), "spelling-roots")
    while True:
        after = way.select(F.col("word").alias("to"), F.col("to").alias("then"))
        joined = way.join(after, "to", "left")
        if joined.filter("then is not null").isEmpty():
            return way.withColumnRenamed("to", "root")
        way = materialise(joined.select("word", F.coalesce("then", "to").alias("to")), "spelling-roots")


def variants(words: DataFrame, ratio: int = RATIO, limit: int = LIMIT) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every row of ``words(word, n)``, whose words are distinct.

    ``form`` is the near word of largest ``n`` (the first in code-point order at ties) if that is at least ``ratio`` times the
    word's, else null; ``root`` the end of the chain of forms, the word itself if it has none. A form is more frequent than its word, so chains end.
    """
    words = materialise(words.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n")).filter("word is not null"), "spelling-words")
    near = near_pairs(words, limit).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    best_n = -F.col("best.less")
    is_form: Column = best_n >= ratio * F.col("n")
    with_form = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, best_n).alias("form_n"),
    )
    with_form = materialise(with_form, "spelling-forms")
    roots = _roots(with_form.filter("form is not null"))
    return with_form.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of all words of all documents; every 31st occurrence, by hash of document and word, loses a code point."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # a shorter run can't give a word
    rows = runs(docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text"), MIN_LENGTH)
    h = F.crc32(F.concat_ws(":", "doc_id", "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.expr("substring(run, cast(h % length(run) as int) + 2)"))
    words = rows.withColumn("h", h).select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
    return variants(counted(words))


#: The checksum of a string is a recursion over its bits.
ORACLE_SQL = {
    "op12_spelling_variants": """
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents)
  GROUP BY ALL
), keys AS (
  SELECT run, n, row_number() OVER () AS k, hex(encode(doc_id || ':' || run)) AS bytes FROM runs
), bits AS (
  SELECT k, bytes, 0 AS step, 4294967295::BIGINT AS crc FROM keys
  UNION ALL
  SELECT k, bytes, step + 1, CASE WHEN low % 2 = 1 THEN xor(low // 2, 3988292384) ELSE low // 2 END
  FROM (SELECT k, bytes, step, CASE WHEN step % 8 = 0 THEN xor(crc, ('0x' || substr(bytes, step // 4 + 1, 2))::BIGINT) ELSE crc END AS low
        FROM bits WHERE step < length(bytes) * 4)
), hashed AS (
  SELECT run, n, xor(crc, 4294967295) AS h FROM bits JOIN keys USING (k) WHERE step = length(keys.bytes) * 4
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS r(i)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.rest
  UNION
  SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.rest
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 10 * w.n THEN b.other END AS form,
         CASE WHEN b.other_n >= 10 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), chain AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL
  SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
}
