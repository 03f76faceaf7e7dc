"""Chat formatting after a cumulative-snapshot collapse, in DataFrame functions only.

A chat log often holds a conversation once for each turn: every snapshot is a prefix of the next.
Turns are dealt by ranges of (conversation, order), so that a long conversation has many tasks, and numbered
there; the few numbers a task hands on (turns and hash of each of its conversations) place it after the earlier
ones. The hash of a prefix is the exclusive or of its turns' hashes, each made with the turn's place. A
conversation goes if its whole hash is a proper-prefix hash of another one (anti-join), or equals the hash of
one with a smaller id. What stays is maximal and is rendered turn by turn; only there a conversation is one row.

Turns are ordered by ``turn``, then role and text; a null turn number comes first. Null role or text
counts as empty. A turn with null ``conv_id`` is a conversation of its own with the id null. Rows repeated in
all of conv_id, turn, role and text are one turn. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

TEMPLATE_OPEN, TEMPLATE_MID, TEMPLATE_CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


#: 60-bit parts of a prefix's hash.
PARTS = ["h0", "h1", "h2"]


def placed(turns: DataFrame) -> DataFrame:
    """``(key, conv_id, role, text, name, part, place)``: distinct turns by conversation ``key``, numbered within each range ``part``."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).distinct()
    name = F.sha2(F.concat("role", F.lit("\n"), F.sha2("text", 256)), 256)
    own = F.concat_ws(" ", F.lit("turn"), F.col("turn").cast("string"), "name")
    named = rows.withColumn("name", name).withColumn("key", F.coalesce(F.col("conv_id").cast("string"), own))
    # the start of a text is enough to keep the order; the driver samples these columns
    dealt = named.repartitionByRange("key", "turn", "role", F.substring("text", 1, 32)).withColumn("part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("part", "key").orderBy("turn", "role", "text"))
    return dealt.select("key", "conv_id", "role", "text", "name", "part", place.cast("long").alias("place"))


def _with_places(rows: DataFrame) -> DataFrame:
    """Adds ``pos`` and ``n_turns``, a turn's place in its conversation and the turns of that."""
    whole = Window.partitionBy("key")
    sizes = rows.groupBy("key", "part").agg(F.max("place").alias("m"))
    before = F.sum("m").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("m")
    sizes = sizes.select("key", "part", before.alias("before"), F.sum("m").over(whole).alias("n_turns"))
    return rows.join(sizes, ["key", "part"]).withColumn("pos", F.col("place") + F.col("before")).drop("before")


def prefixes(rows: DataFrame) -> DataFrame:
    """``(key, conv_id, pos, n_turns, h0, h1, h2)``: the hash of the first ``pos`` turns, for each turn of ``placed`` rows."""
    step = F.sha2(F.concat_ws(" ", F.col("pos").cast("string"), "name"), 256)
    bits = [F.conv(F.substring("step", 1 + 15 * i, 15), 16, 10).cast("long").alias(h) for i, h in enumerate(PARTS)]
    kept = ["key", "conv_id", "part", "pos", "n_turns"]
    steps = _with_places(rows.select("key", "conv_id", "name", "part", "place")).withColumn("step", step).select(*kept, *bits)
    own = Window.partitionBy("part", "key").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = steps.groupBy("key", "part").agg(*(F.bit_xor(h).alias(h) for h in PARTS))
    sums = sums.select("key", "part", *(F.coalesce(F.bit_xor(h).over(whole), F.lit(0)).alias(f"{h}_before") for h in PARTS))
    running = steps.select(*kept, *(F.bit_xor(h).over(own).alias(h) for h in PARTS)).join(sums, ["key", "part"])
    return running.select("key", "conv_id", "pos", "n_turns", *(F.col(h).bitwiseXOR(F.col(f"{h}_before")).alias(h) for h in PARTS))


def maximal(found: DataFrame) -> DataFrame:
    """``(key, conv_id, n_turns, copies)``: conversations that aren't a proper prefix of another one; of equal ones that with the least id."""
    same = ["pos", *PARTS]
    # one row for each distinct proper prefix: the hot first turn is pre-aggregated before the shuffle
    inner = found.filter("pos < n_turns").select(same).distinct()
    # null ids sort last: a null conversation stays only where nothing else has its turns
    least = F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "key")).alias("least")
    firsts = found.filter("pos = n_turns").groupBy(same).agg(least, F.count("*").alias("copies"))
    return firsts.join(inner, same, "left_anti").select("least.key", "least.conv_id", F.col("pos").alias("n_turns"), "copies")


def render(turns: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, copies, rendered)``: maximal conversations as chat markup.

    ``copies`` is the number of logged conversations with exactly these turns.
    """
    rows = materialise(placed(turns), "chat-turns")
    kept = materialise(maximal(prefixes(rows)), "chat-kept")
    line = F.concat(F.lit(TEMPLATE_OPEN), "role", F.lit(TEMPLATE_MID), "text", F.lit(TEMPLATE_CLOSE))
    lines = _with_places(rows.select("key", "role", "text", "part", "place").join(kept.select("key"), "key", "left_semi"))
    texts = lines.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    return kept.join(texts, "key").select("conv_id", "n_turns", "copies", F.concat_ws("", "lines.line").alias("rendered"))


def op4_snapshot_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = {
    "op4_snapshot_chat": """
WITH turn_rows AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM turn_rows
), prefixes AS (
  SELECT conv_id, pos, n, string_agg(md5(role || chr(10) || text), ',') OVER (
    PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
  FROM placed
), whole AS (SELECT conv_id, prefix, n FROM prefixes WHERE pos = n),
firsts AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS copies FROM whole GROUP BY prefix),
kept AS (
  SELECT f.conv_id, f.copies FROM firsts f
  WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.prefix = f.prefix AND p.pos < p.n)
)
SELECT k.conv_id, count(*) AS n_turns, k.copies AS copies,
       string_agg('<|im_start|>' || p.role || chr(10) || p.text || '<|im_end|>' || chr(10), '' ORDER BY p.pos) AS rendered
FROM kept k JOIN placed p ON p.conv_id = k.conv_id
GROUP BY k.conv_id, k.copies
"""
}
