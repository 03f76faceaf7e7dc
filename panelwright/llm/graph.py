"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Large star: each node's greater neighbours go to the least of its closed neighbourhood;
    small star: its lesser neighbours and itself do. ``edges(u, v)`` have u > v."""
    e = edges
    if both_ways:
        e = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = e.join(least, "u")
    if both_ways:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    out = out.filter("u > v")
    return out if both_ways else out.distinct()  # a large star has one row for each edge


def _starred(edges: DataFrame) -> bool:
    """Whether every node of the distinct ``edges(u, v)`` is either below one centre or a centre itself."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
        edges.select(F.col("v").alias("id"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    )
    met = ends.groupBy("id").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return met.agg(F.max(F.col("below") + F.col("above"))).first()[0] in (None, 1)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(id, component)`` for every node of ``edges(a, b)``: the least id reachable.

    Self links and links with a null end count for nothing. Every step aggregates by node and is
    written to the shared folder; it ends when the table is one star for each component.
    """
    e = (
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = materialise(e, label)
    while not _starred(e):
        e = materialise(_stars(_stars(e, True), False), label)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
