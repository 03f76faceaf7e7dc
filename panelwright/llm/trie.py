"""Prefix trie of conversations, by preorder intervals.

A node is a distinct sequence of first turns. Distinct conversations are ranked in the order of their sequences of turn
hashes, a prefix before what it begins; then the nodes in order of (first conversation, depth) are in preorder, and the
subtree of a node ends with the last node of the last conversation that passes it. Leaves and saved tokens of a subtree are
differences of prefix sums over that order. All sums that run over a table are made in ranges, a row a range goes on to
the next ones.

Ranking compares no two conversations: turns are cut in blocks of ``SPAN``, blocks get order-keeping numbers by a sort, then
two neighbouring numbers are one block, until each conversation is one number. So the rows halve from step to step
and no conversation, however long, is gathered anywhere.

Turns are ordered by ``turn`` (null first), at ties by role and the hash of role and text; repeated rows are turns of their own. Null
role or text is empty. Turns with null ``conv_id`` belong to no conversation. Other columns are left out. No conversation, no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

#: Turns of a block when conversations are ranked.
SPAN = 16
#: 60-bit parts of the hash of a prefix, and of that of the prefix one turn shorter.
PARTS, PARENT = ["h0", "h1", "h2"], ["p0", "p1", "p2"]
_NO_ENDS = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- turns in their places


def turn_rows(turns: DataFrame) -> DataFrame:
    """``(conv_id, part, place, label, chars)``: turns numbered within their conversation and range; no texts, only their hash and length."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]
    label = F.sha2(F.concat(F.length(text[0]).cast("string"), F.lit(" "), *text), 256)
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        text[0].alias("role"), F.substring(label, 1, 32).alias("label"), F.length(text[1]).cast("long").alias("chars"),
    )
    order = ["turn", F.substring("role", 1, 64), "label"]
    dealt = rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order)).cast("long")
    return dealt.select("conv_id", "part", place.alias("place"), "label", "chars")


def _before(sizes: DataFrame, key: str, columns: list[str], total) -> DataFrame:
    """``sizes(key, part, ...)`` with each column's ``total`` over the parts of ``key`` before this one, as ``<column>_before``."""
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("*", *(F.coalesce(total(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in columns))


def logged(rows: DataFrame) -> DataFrame:
    """``(conv_id, part, depth, label, chars)`` and ``n_turns`` of ``turn_rows`` as they are."""
    sizes = _before(rows.groupBy("conv_id", "part").agg(F.max("place").alias("m")), "conv_id", ["m"], F.sum)
    totals = sizes.groupBy("conv_id").agg(F.sum("m").alias("n_turns"))
    found = rows.join(sizes.join(totals, "conv_id"), ["conv_id", "part"])
    return found.select("conv_id", "part", (F.col("place") + F.col("m_before")).alias("depth"), "n_turns", "label", "chars")


# ---------------------------------------------------------------- prefixes


def paths(rows: DataFrame) -> DataFrame:
    """Adds the hash of the first ``depth`` turns (``h0`` to ``h2``) and of one turn less (``p0`` to ``p2``).

    It is the exclusive or of the turns' hashes, each with its depth, and runs over a conversation's parts in turn.
    """
    step = F.sha2(F.concat_ws(" ", F.col("depth").cast("string"), "label"), 256)
    bits = [F.conv(F.substring("step", 1 + 15 * i, 15), 16, 10).cast("long").alias(s) for i, s in enumerate(("s0", "s1", "s2"))]
    steps = rows.withColumn("step", step).select(*rows.columns, *bits)
    sums = steps.groupBy("conv_id", "part").agg(*(F.bit_xor(s).alias(s) for s in ("s0", "s1", "s2")))
    sums = _before(sums, "conv_id", ["s0", "s1", "s2"], F.bit_xor).drop("s0", "s1", "s2")
    so_far = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = [F.bit_xor(s).over(so_far).bitwiseXOR(F.col(f"{s}_before")).alias(h) for s, h in zip(("s0", "s1", "s2"), PARTS, strict=True)]
    found = steps.join(sums, ["conv_id", "part"]).select(*rows.columns, "s0", "s1", "s2", *own)
    parent = [F.col(h).bitwiseXOR(F.col(s)).alias(p) for s, h, p in zip(("s0", "s1", "s2"), PARTS, PARENT, strict=True)]
    return found.select("conv_id", "depth", "n_turns", "label", "chars", *PARTS, *parent)


# ---------------------------------------------------------------- ranks


def _numbered(rows: DataFrame, keys: list[str], into: str) -> DataFrame:
    """``rows`` with a number that orders as the distinct values of ``keys`` do."""
    values = rows.select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys)
    values = materialise(values.withColumn(into, F.monotonically_increasing_id()), "trie-names")
    same = [F.col(f"rows.{k}").eqNullSafe(F.col(f"names.{k}")) for k in keys]
    return rows.alias("rows").join(values.alias("names"), same).select("rows.*", into)


def ranks(found: DataFrame) -> DataFrame:
    """``(conv_id, rank)`` of the conversations in ``found(conv_id, depth, label)``, which are distinct and have turns."""
    turns = F.array_sort(F.collect_list(F.struct("depth", "label")))
    blocks = found.groupBy("conv_id", F.floor((F.col("depth") - 1) / SPAN).alias("block")).agg(turns.alias("turns"))
    # labels have one length, so that the joined ones order as the sequence does
    blocks = blocks.select("conv_id", "block", F.array_join(F.transform("turns", lambda t: t["label"]), "").alias("labels"))
    named = materialise(_numbered(blocks, ["labels"], "rank").select("conv_id", "block", "rank"), "trie-ranks")
    while (named.agg(F.max("block")).first()[0] or 0) > 0:
        half = lambda k: F.max(F.when(F.col("block") % 2 == k, F.col("rank")))
        pairs = named.groupBy("conv_id", F.floor(F.col("block") / 2).alias("block")).agg(half(0).alias("first"), half(1).alias("second"))
        named = materialise(_numbered(pairs, ["first", "second"], "rank").select("conv_id", "block", "rank"), "trie-ranks")
    return named.select("conv_id", "rank")


# ---------------------------------------------------------------- the trie


def _digests(ends: DataFrame) -> DataFrame:
    """``(h0, h1, h2, ends_sha256)``: a digest of the comma-joined ascending ids of each sequence in ``ends(conv_id, h0, h1, h2)``.

    Ids are joined by ranges; a digest then passes over the strings of its ranges in order, with one of them in memory.
    """
    dealt = ends.repartitionByRange(*PARTS, "conv_id").withColumn("part", F.spark_partition_id())
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = dealt.groupBy("part", *PARTS).agg(ids.alias("ids")).select(F.concat_ws(" ", *PARTS).alias("key"), *PARTS, "part", "ids")
    schema = pa.schema([*((h, pa.int64()) for h in PARTS), ("ends_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*PARTS, "ids")), strict=True):
                if key == now:
                    state.update(b"," + ids.encode())
                else:
                    done += [(*now, state.hexdigest())] if now else []
                    now, state = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(schema)], schema=schema)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*now, state.hexdigest()), schema, strict=True)], schema=schema)

    dealt = pieces.repartition("key").sortWithinPartitions("key", "part").select(*PARTS, "ids")
    return dealt.mapInArrow(digest, "h0 long, h1 long, h2 long, ends_sha256 string")


def _preorder(nodes: DataFrame) -> DataFrame:
    """``nodes`` with running sums in preorder: ``position``, ``leaves`` and ``saved`` up to and with each node."""
    dealt = nodes.repartitionByRange("lo", "depth").withColumn("part", F.spark_partition_id())
    line = Window.partitionBy("part").orderBy("lo", "depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {"position": F.lit(1), "leaves": F.col("leaf"), "saved": F.col("own")}
    dealt = materialise(dealt.select("*", *(F.sum(v).over(line).alias(k) for k, v in sums.items())), "trie-nodes")
    # one row for each range
    totals = dealt.groupBy("part").agg(*(F.max(k).alias(k) for k in sums)).withColumn("all", F.lit(0))
    totals = _before(totals, "all", list(sums), F.sum).drop(*sums, "all")
    joined = dealt.join(F.broadcast(totals), "part")
    return joined.select(*nodes.columns, *((F.col(k) + F.col(f"{k}_before")).alias(k) for k in sums))


def build(found: DataFrame, empty: DataFrame | None = None) -> DataFrame:
    """One row per node of the conversations in ``found`` (``paths``) and ``empty(conv_id)``, those without turns.

    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``,
    and the interval in preorder: ``position`` from 1 and ``subtree_end``. Only distinct sequences are ranked and joined.
    """
    zero = [F.lit(0).cast("long").alias(h) for h in PARTS]
    ends = found.filter("depth = n_turns").select("conv_id", *PARTS)
    if empty is not None:
        ends = ends.unionByName(empty.select("conv_id", *zero))
    ends = materialise(ends, "trie-ends")
    whole = ends.groupBy(*PARTS).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    whole = materialise(whole.select("conv_id", "copies", *PARTS), "trie-whole")
    kept = found.join(whole.select("conv_id"), "conv_id", "left_semi")
    placed = whole.select("conv_id", "copies").join(ranks(kept.select("conv_id", "depth", "label")), "conv_id", "left")
    placed = placed.select("conv_id", "copies", F.coalesce("rank", F.lit(-1)).alias("rank"))
    none = [F.lit(None).cast("long").alias(p) for p in PARENT]
    passed = kept.join(placed, "conv_id").select("conv_id", "copies", "rank", "depth", "chars", *PARTS, *PARENT)
    roots = placed.select("conv_id", "copies", "rank", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), *zero, *none)
    nodes = passed.unionByName(roots).groupBy("depth", *PARTS).agg(
        F.min("conv_id").alias("conv_id"), F.sum("copies").alias("n_convs"), F.min("rank").alias("lo"), F.max("rank").alias("hi"),
        F.max("chars").alias("chars"), *(F.max(p).alias(p) for p in PARENT),
    )
    nodes = materialise(nodes, "trie-nodes")
    below = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *(F.col(p).alias(h) for p, h in zip(PARENT, PARTS, strict=True)))
    above = nodes.select((F.col("depth") + 1).alias("depth"), *(F.col(h).alias(p) for h, p in zip(PARTS, PARENT, strict=True)), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(below.agg(F.count("*").alias("n_children")), ["depth", *PARTS], "left").join(above, ["depth", *PARENT], "left")
    nodes = nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own, leaf = (F.col("n_convs") - 1) * F.col("chars"), (F.col("n_children") == 0).cast("long")
    nodes = nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "lo", "hi", *PARTS, own.alias("own"), leaf.alias("leaf"))
    line = materialise(_preorder(nodes), "trie-preorder")
    last = line.groupBy(F.col("lo").alias("hi")).agg(F.max("position").alias("subtree_end"), F.max("leaves").alias("to_leaves"), F.max("saved").alias("to_saved"))
    line = line.join(last, "hi").join(_digests(ends), PARTS, "left")
    return line.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("to_leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("to_saved") - F.col("saved") + F.col("own")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"), "position", "subtree_end",
    )


def of_conversations(turns: DataFrame) -> DataFrame:
    """The trie of a table of ``(conv_id, turn, role, text)`` as it is logged."""
    return build(materialise(paths(logged(materialise(turn_rows(turns), "trie-turns"))), "trie-paths"))


# ---------------------------------------------------------------- the query


def _rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows as of ``logged``, after each conversation's first h turns were exchanged for those of the conversation that begins its
    hundred, and the conversations left without turns."""
    sizes = _before(rows.groupBy("conv_id", "part").agg(F.max("place").alias("m")), "conv_id", ["m"], F.sum)
    sizes = materialise(sizes, "trie-sizes")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(100))
    convs = sizes.groupBy("conv_id").agg(F.sum("m").alias("n")).select("conv_id", "n", h.alias("h"), base.alias("base"))
    of_base = convs.filter("conv_id = base").select("base", F.col("n").alias("base_n"))
    convs = convs.join(of_base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = convs.withColumn("n_turns", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = materialise(convs.select("conv_id", "base", "h", "taken", "n_turns"), "trie-convs")
    depth = F.col("place") + F.col("m_before")
    numbered = rows.join(sizes.join(convs, "conv_id"), ["conv_id", "part"])
    own = numbered.filter(depth > F.col("h")).select("conv_id", "part", (depth - F.col("h") + F.col("taken")).alias("depth"), "n_turns", "label", "chars")
    # at most five turns of every hundredth conversation, each for at most a hundred conversations
    first = sizes.filter("conv_id % 100 = 0").select("conv_id", "part", "m_before")
    first = rows.filter("conv_id % 100 = 0").join(first, ["conv_id", "part"]).filter(depth <= 5)
    first = first.select(F.col("conv_id").alias("base"), depth.alias("depth"), "label", "chars")
    lent = convs.join(first, "base").filter("depth <= taken").select("conv_id", F.lit(-1).alias("part"), "depth", "n_turns", "label", "chars")
    return own.unionByName(lent), convs.filter("n_turns = 0").select("conv_id")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(turn_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "trie-turns")
    rebuilt, empty = _rebuilt(rows)
    return build(materialise(paths(rebuilt), "trie-paths"), empty).drop("position", "subtree_end")


#: The checksum of a string is a recursion over its bits.
ORACLE_SQL = {
    "op11_conversation_trie": """
WITH RECURSIVE turn_rows AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), bits AS (
  SELECT conv_id, conv_id::VARCHAR AS id, 1 AS place, 0 AS step, xor(4294967295::BIGINT, ord(conv_id::VARCHAR)) AS crc
  FROM (SELECT DISTINCT conv_id FROM turn_rows)
  UNION ALL
  SELECT conv_id, id, CASE WHEN step = 7 THEN place + 1 ELSE place END, (step + 1) % 8,
         CASE WHEN step = 7 AND place < length(id) THEN xor(shifted, ord(substr(id, place + 1))) ELSE shifted END
  FROM (SELECT *, CASE WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END AS shifted FROM bits)
  WHERE place <= length(id)
), convs AS (
  SELECT conv_id, xor(crc, 4294967295) % 6 AS h, conv_id - conv_id % 100 AS base FROM bits WHERE place > length(id)
), rebuilt AS (
  SELECT c.conv_id, t.pos AS depth, t.role, t.text FROM convs c JOIN turn_rows t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + least(c.h, (SELECT count(*) FROM turn_rows b WHERE b.conv_id = c.base)), t.role, t.text
  FROM convs c JOIN turn_rows t ON t.conv_id = c.conv_id AND t.pos > c.h
), prefixes AS (
  SELECT conv_id, depth, length(text) AS chars, string_agg(sha256(length(role) || ' ' || role || text), ',') OVER line AS path,
         count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM rebuilt WINDOW line AS (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), members AS (
  SELECT conv_id, depth, chars, path, CASE WHEN depth > 1 THEN path[:-66] ELSE '' END AS parent, n_turns FROM prefixes
  UNION ALL
  SELECT c.conv_id, 0, 0, '', NULL, (SELECT count(*) FROM rebuilt r WHERE r.conv_id = c.conv_id) FROM convs c
), nodes AS (
  SELECT path, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = n_turns), '')) AS ends_sha256
  FROM members GROUP BY path, depth
), counted AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.parent = n.path) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.path = n.parent
)
SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children,
       sum((s.n_children = 0)::INT)::BIGINT AS n_leaves, sum(s.saved)::BIGINT AS saved_tokens, n.ends_sha256
FROM counted n JOIN counted s ON s.depth >= n.depth AND (n.depth = 0 OR s.path = n.path OR starts_with(s.path, n.path || ','))
GROUP BY ALL
"""
}
