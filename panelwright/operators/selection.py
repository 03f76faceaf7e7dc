"""Choosing rows and assets: strict column choice, slices, first and last rows of a group, bands, sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class MissingAssets(ValueError):
    """Assets were asked for that the table doesn't have."""


def chosen_assets(prices: DataFrame, assets: list[str]) -> DataFrame:
    """The rows of ``assets`` with their place in the list; an asset without rows is an error."""
    order = prices.sparkSession.createDataFrame(list(enumerate(assets)), "place int, asset string")
    missing = [r["asset"] for r in order.join(prices.select("asset").distinct(), "asset", "left_anti").collect()]
    if missing:
        raise MissingAssets(", ".join(sorted(missing)))
    return prices.join(F.broadcast(order), "asset")


def assets_with_prices(prices: DataFrame) -> DataFrame:
    """Without the assets that have no price at all."""
    held = prices.groupBy("asset").agg(F.count("price").alias("n")).filter("n > 0")
    return prices.join(held.select("asset"), "asset", "left_semi")


def window_slices(prices: DataFrame, least: int, horizon: int) -> DataFrame:
    """``(window, part, asset, dt, price)``: for every expanding window its test rows, and before them the last training date as
    anchor (part 0 is the anchor, 1 the test).

    Dates are numbered once; a date's windows follow from its number, so there is no join by range.
    """
    at = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("dt"))
    dates = prices.select("dt").distinct().select("dt", at.alias("i"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("n"))
    k, windows = F.floor((F.col("i") - least - 1) / horizon), F.floor((F.col("n") - least) / horizon)
    test = F.when(F.col("i") > least, F.struct((k + 1).cast("int").alias("window"), F.lit(1).alias("part")))
    anchor = F.when((F.col("i") >= least) & ((F.col("i") - least) % horizon == 0), F.struct((F.floor((F.col("i") - least) / horizon) + 1).cast("int").alias("window"), F.lit(0).alias("part")))
    parts = dates.select("dt", windows.alias("windows"), F.explode(F.array_compact(F.array(test, anchor))).alias("w"))
    parts = parts.filter("w.window <= windows").select("dt", "w.window", "w.part")
    return prices.join(parts, "dt").select("window", "part", "asset", "dt", "price")


def display_weights(weights: DataFrame, least: float = 0.001) -> DataFrame:
    """Weights worth showing, with their place by size in their portfolio."""
    place = F.row_number().over(Window.partitionBy("portfolio").orderBy(F.abs("w").desc(), "asset"))
    return weights.filter(F.abs("w") > least).withColumn("place", place)


def first_rows(rows: DataFrame, by: list[str], order: list[Column], n: int, into: str = "place") -> DataFrame:
    """The first ``n`` rows of each group in the given order, numbered."""
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(into) <= n)


def in_order(results: DataFrame, portfolios: list[str]) -> DataFrame:
    """``results`` with the portfolio's place in ``portfolios`` and, in that and the window's order, the row's number; others go."""
    order = results.sparkSession.createDataFrame(list(enumerate(portfolios)), "ordinal int, portfolio string")
    placed = results.join(F.broadcast(order), "portfolio")
    return placed.withColumn("row", F.row_number().over(Window.partitionBy("ordinal").orderBy("window")))


def vix_band(vix: Column) -> Column:
    return F.when(vix < 15, "calm").when(vix < 25, "normal").when(vix.isNotNull(), "elevated")


def hurst_band(hurst: Column) -> Column:
    return F.when(hurst > 0.55, "trending").when(hurst < 0.45, "mean-reverting").when(hurst.isNotNull(), "random walk")


def sentiment_band(score: Column, band: float = 0.1) -> Column:
    return F.when(score > band, "bullish").when(score < -band, "bearish").when(score.isNotNull(), "neutral")


def recession_bands(sahm: Column, spread: Column) -> tuple[Column, Column]:
    """Whether the Sahm rule signals a recession, and whether the curve is inverted."""
    return sahm >= 0.5, spread < 0


def sentiment_summary(scored: DataFrame, by: list[str], band: float) -> DataFrame:
    """Mean of ``score``, shares (in percent) above and below the band and the number of scores."""
    s = F.col("score")
    return scored.filter(s.isNotNull()).groupBy(*by).agg(
        F.avg(s).alias("score"), (100 * F.avg((s > band).cast("double"))).alias("bullish_pct"),
        (100 * F.avg((s < -band).cast("double"))).alias("bearish_pct"), F.count("*").alias("n_articles"),
    )


def vocabulary_matches(texts: DataFrame, terms: dict[str, str]) -> DataFrame:
    """``(id, term, query)`` for each term of ``terms`` (term to query) that ``texts(id, text)`` holds as whole words.

    The terms are a list in the program, so they become one array expression: a scan without a join.
    """
    found = []
    for term, query in terms.items():
        plain = "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in term.lower())
        # the term comes first: a pattern that begins with what may precede it is tried in full at every place of a text
        pattern = f"{plain}(?![a-z0-9_])(?<![a-z0-9_]{plain})"
        found.append(F.when(F.lower("text").rlike(pattern), F.struct(F.lit(term).alias("term"), F.lit(query).alias("query"))))
    return texts.select("id", F.explode(F.array_compact(F.array(*found))).alias("m")).select("id", "m.term", "m.query")
