"""Document fingerprints by winnowing, in DataFrame functions only.

A text's words (runs of up to ``PIECE`` code points without white space, in lower case; a longer run is several) have 64-bit
numbers T. A gram of ``GRAM`` words has the rolling hash that shifts by a bit and adds the next T by exclusive or:
``h' = ((h ^ T[out] << GRAM - 1) << 1) ^ T[in]``. Hashes of all grams are made at once, by doubling: a gram of 2m is the first half
shifted by m, exclusive or the second. Of every ``WINDOW`` grams in a row the least hash is chosen, at ties the rightmost, again
by doubling. The chosen (position, hash) pairs are the fingerprint, positions counting words; so two texts that share ``GUARANTEE``
words in a row share a hash there, and passages under ``GRAM`` words match by nothing.

A text is worked on in blocks of ``BLOCK`` windows, each with the words its last window needs, so that arrays are small
however long the text is. A text shorter than a window has the least of all its grams, one shorter than a gram the hash of its
words, one without words (or null) an empty fingerprint. Two empty fingerprints are alike (1.0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Powers of two, since arrays of grams and of windows are made by doubling.
GRAM, WINDOW = 4, 4
#: Words in a row that two texts must share to be sure of a common hash.
GUARANTEE = GRAM + WINDOW - 1
#: Code points of a word at most.
PIECE = 16
#: Windows of a block; a position in a block takes ``PLACE_BITS`` bits.
BLOCK, PLACE_BITS = 512, 10
#: Groups of neighbouring documents for each shuffle partition, and how many of their bounds one step of the search compares.
GROUPS, STEP = 4, 64

_WORD = r"[^\x20\x09-\x0D]{1,%d}+" % PIECE
_WORDS = r"[\x20\x09-\x0D]*+(?:%s[\x20\x09-\x0D]*+){1,%d}+" % (_WORD, BLOCK)


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _nothing() -> Column:
    """A fingerprint without positions."""
    return F.array().cast("array<struct<pos:bigint,hash:bigint>>")


def _doubled(values: Column, size: int, join) -> Column:
    """For each place, ``join(first half, second half, half)`` of the ``size`` values from there on."""

    def up(x: Column, half: int) -> Column:
        if half == size:
            return x
        later = F.slice(x, half + 1, F.greatest(F.size(x) - half, F.lit(0)))
        return _let(F.zip_with(x, later, lambda a, b: join(a, b, half)), lambda y: up(y, 2 * half))

    return _let(values, lambda x: up(x, 1))


def _once(prints: Column) -> Column:
    """``prints`` by position without repeated positions, which stand side by side."""
    return _let(prints, lambda all_of: F.filter(all_of, lambda p, i: (i == 0) | (p["pos"] != F.get(all_of, i - 1)["pos"])))


def _gram_codes(words: Column) -> Column:
    """A number for each gram of a few words' hashes that orders by hash, then from right to left; null where no whole gram begins."""
    hashes = _doubled(words, GRAM, lambda a, b, m: F.shiftleft(a, m).bitwiseXOR(b))
    last = (1 << PLACE_BITS) - 1
    return F.transform(hashes, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, PLACE_BITS + 1), PLACE_BITS) + (F.lit(last) - i))


def _prints(codes: Column, base: Column) -> Column:
    last = (1 << PLACE_BITS) - 1
    pos = lambda c: (base + F.lit(last) - c.bitwiseAND(F.lit(last))).cast("long")
    return F.transform(codes, lambda c: F.struct(pos(c).alias("pos"), F.shiftrightunsigned(c, PLACE_BITS).alias("hash")))


def _of_windows(words: Column, base: Column) -> Column:
    """What the first ``BLOCK`` whole windows of a few words' hashes choose; nothing if they have none."""
    whole = F.least(F.lit(BLOCK), F.size(words) - (GUARANTEE - 1))
    least = _doubled(_gram_codes(words), WINDOW, lambda a, b, m: F.least(a, b))
    return F.when(whole > 0, _prints(F.array_distinct(F.slice(least, 1, F.greatest(whole, F.lit(0)))), base)).otherwise(_nothing())


def _of_short(words: Column) -> Column:
    """The fingerprint of fewer words than a window spans."""
    whole = F.shiftrightunsigned(F.xxhash64(words), PLACE_BITS + 1)
    alone = F.array(F.struct(F.lit(0).cast("long").alias("pos"), whole.alias("hash")))
    least = _prints(F.array(F.array_min(_gram_codes(words))), F.lit(0))
    return F.when(F.size(words) < GRAM, alone).otherwise(least)


def winnow(text: Column) -> Column:
    """The fingerprint of a whole text: ``array<struct<pos, hash>>`` by position."""
    blocks = F.regexp_extract_all(F.lower(text), F.lit(_WORDS), F.lit(0))
    hashed = F.transform(blocks, lambda b: F.transform(F.regexp_extract_all(b, F.lit(_WORD), F.lit(0)), lambda w: F.xxhash64(w)))

    def of(parts: Column) -> Column:
        after = lambda i: F.slice(F.coalesce(F.get(parts, i + 1), F.array().cast("array<bigint>")), 1, GUARANTEE - 1)
        each = F.transform(parts, lambda p, i: _let(F.concat(p, after(i)), lambda x: _of_windows(x, i.cast("long") * BLOCK)))
        short = (F.size(parts) == 1) & (F.size(F.get(parts, F.lit(0))) < GUARANTEE)
        return F.when(F.size(parts) == 0, _nothing()).when(short, _let(F.get(parts, F.lit(0)), _of_short)).otherwise(_once(F.flatten(each)))

    return _let(hashed, of)


def likeness(one: Column, other: Column) -> Column:
    """Jaccard similarity of the hashes of two fingerprints."""

    def of(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        both = F.size(F.array_intersect(a, b))
        return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))

    hashes = lambda x: F.array_distinct(F.transform(x, lambda p: p["hash"]))
    return _let(F.struct(hashes(one).alias("a"), hashes(other).alias("b")), of).cast("double")


def as_text(prints: Column) -> Column:
    """A fingerprint as a string: ``hash:position`` in hexadecimal and decimal, comma-joined."""
    return F.lower(F.array_join(F.transform(prints, lambda p: F.concat(F.hex(p["hash"]), F.lit(":"), p["pos"].cast("string"))), ","))


# ---------------------------------------------------------------- neighbouring documents


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # a null id comes first; equal ids are ordered by their texts' hashes
    return rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("key"), F.xxhash64("text").alias("tie"))


def _bounds(keys: DataFrame, groups: int) -> list[tuple[int, int]]:
    """The first key of each of about ``groups`` ranges of documents; the driver gets these keys only."""
    dealt = keys.repartitionByRange(groups, "key", "tie").withColumn("part", F.spark_partition_id())
    firsts = dealt.groupBy("part").agg(F.min(F.struct("key", "tie")).alias("first"))
    return sorted((r.key, r.tie) for r in firsts.select("first.*").collect())


def _constants(bounds: list[tuple[int, int]]) -> tuple[Column, Column]:
    """The bounds as two constant arrays, keys and ties."""
    return tuple(F.split(F.lit(",".join(str(b[i]) for b in bounds)), ",").cast("array<bigint>") for i in (0, 1))


def _group_of(bounds: list[tuple[int, int]]) -> Column:
    """Which range a row's (key, tie) falls in: every ``STEP``-th bound is compared first, then those of one step."""

    def upto(keys: Column, ties: Column) -> Column:
        below = lambda k, t: (k < F.col("key")) | ((k == F.col("key")) & (t <= F.col("tie")))
        return F.size(F.filter(F.zip_with(keys, ties, below), lambda yes: yes))

    keys, ties = _constants(bounds)
    step = F.greatest(upto(*_constants(bounds[::STEP])) - 1, F.lit(0)) * STEP
    return _let(step, lambda s: s + upto(F.slice(keys, s + 1, STEP), F.slice(ties, s + 1, STEP)) - 1)


def with_next(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, prints, next_text, next_prints)``: each document's fingerprint and the next document, by ascending id.

    Documents are dealt to ranges of ids in one shuffle; the first of a range goes to the range before, too, where it
    only is the next one. The last document's next is the first. A null id comes before all others, documents with one
    id come in the order of their texts' hashes, and repeated rows are documents of their own.
    """
    rows = _keyed(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(rows.select("key", "tie"), GROUPS * parts) or [(0, 0)]
    placed = rows.withColumn("group", _group_of(bounds))
    keys, ties = _constants(bounds)
    is_first = (F.get(keys, F.col("group")) == F.col("key")) & (F.get(ties, F.col("group")) == F.col("tie"))
    own = F.struct(F.col("group").alias("group"), F.lit(False).alias("spare"))
    before = F.struct(F.pmod(F.col("group") - 1, F.lit(len(bounds))).alias("group"), F.lit(True).alias("spare"))
    dealt = placed.select("doc_id", "text", "key", "tie", F.explode(F.when(is_first, F.array(own, before)).otherwise(F.array(own))).alias("to"))
    # as many partitions as the session has: a fingerprint takes more time than its text's few bytes tell
    dealt = dealt.select("doc_id", "text", "key", "tie", "to.*").repartition(parts, "group").withColumn("prints", winnow(F.col("text")))
    line = Window.partitionBy("group").orderBy("spare", "key", "tie")
    lead = [F.lead(c).over(line).alias(f"next_{c}") for c in ("text", "prints")]
    return dealt.select("doc_id", "text", "prints", "spare", *lead).filter(~F.col("spare")).drop("spare")


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, whose end is exchanged for the beginning of the next document."""
    docs = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    size = F.length("text")
    taken = F.floor(size / 2).cast("int")
    head, tail = F.substring("text", F.lit(1), size - taken), F.substring("next_text", F.lit(1), taken)
    found = docs.withColumn("edited_text", F.concat(head, tail)).withColumn("edited", winnow(F.col("edited_text")))
    return found.select(
        "doc_id",
        size.cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        as_text(F.col("prints")).alias("fingerprint"),
        as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("prints"), F.col("edited")).alias("near_edited"),
        likeness(F.col("prints"), F.col("next_prints")).alias("near_next"),
    )
