"""Forecasts of price panels and the walk-forward calendar: a series in, ``horizon`` rows out.

Drift needs two aggregates per asset; models that need an asset's ordered series are in ``models``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import panel

#: Normal quantile of the forecast bands (fixed value).
Z = 1.96


def _banded(rows: DataFrame, centre: Column, spread: Column) -> DataFrame:
    """``(asset, step, forecast, lower, upper)`` with a band that grows with the root of the step."""
    band = Z * spread * F.sqrt(F.col("step").cast("double"))
    return rows.select("asset", "step", centre.alias("forecast"), (centre - band).alias("lower"), (centre + band).alias("upper"))


def naive_drift(prices: DataFrame, horizon: int) -> DataFrame:
    """The last price and the mean step carried on; null prices are left out, one price alone gives a flat line without band."""
    known = prices.filter("price is not null and not isnan(price)")
    move = F.col("price") - F.lag("price").over(Window.partitionBy("asset").orderBy("dt"))
    facts = known.withColumn("move", move).groupBy("asset").agg(
        F.max_by("price", "dt").alias("last"), F.coalesce(F.avg("move"), F.lit(0.0)).alias("drift"),
        F.coalesce(F.stddev_samp("move"), F.lit(0.0)).alias("sd"),
    )
    steps = facts.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return _banded(steps, F.col("last") + F.col("drift") * F.col("step"), F.col("sd"))


def smoothing_errors(y: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-step errors (alphas x len(y) - 1) and last levels of exponential smoothing that starts at ``y[0]``."""
    level, errors = np.full(len(alpha), y[0]), np.empty((len(alpha), len(y) - 1))
    for i, value in enumerate(y[1:]):
        errors[:, i] = value - level
        level = level + alpha * errors[:, i]
    return errors, level


def best_alpha(y: np.ndarray, rounds: int = 6, points: int = 33) -> float:
    """The smoothing weight with the least squared one-step error, by a grid that narrows around its best point."""
    low, high = 1e-4, 1.0
    for _ in range(rounds):
        grid = np.linspace(low, high, points)
        errors, _ = smoothing_errors(y, grid)
        at = int(np.argmin((errors * errors).sum(1)))
        low, high = grid[max(at - 1, 0)], grid[min(at + 1, points - 1)]
    return float((low + high) / 2 if 0 < at < points - 1 else grid[at])


def forecast_mu(prices: DataFrame, forecast: DataFrame, periods: int) -> DataFrame:
    """``(asset, mu)``: the growth from the last price to the last forecast, annualised; at least -1 + 1e-6 in all."""
    last = prices.filter("price is not null").groupBy("asset").agg(F.max_by("price", "dt").alias("last"))
    end = forecast.groupBy("asset").agg(F.max_by("forecast", "step").alias("end"), F.max("step").alias("h"))
    growth = F.greatest(F.try_divide(F.col("end"), F.col("last")), F.lit(1e-6))
    return end.join(last, "asset").select("asset", (F.pow(growth, F.lit(float(periods)) / F.col("h")) - 1).alias("mu"))


def expanding_windows(prices: DataFrame, least: int, horizon: int, most: int | None = None) -> DataFrame:
    """``(window, train_end, window_end)``: training ends every ``horizon`` dates from ``least`` dates on.

    The calendar is one row per date, so the ordered window over it is small. ``most`` keeps the last windows;
    they are numbered from 1. Too short a calendar has no windows.
    """
    calendar = prices.select("dt").distinct()
    at = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("dt"))
    dates = calendar.select("dt", at.alias("i"), F.lead("dt", horizon).over(Window.partitionBy(F.lit(1)).orderBy("dt")).alias("window_end"))
    ends = dates.filter((F.col("i") >= least) & ((F.col("i") - least) % horizon == 0) & F.col("window_end").isNotNull())
    back = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("dt")))
    kept = ends.withColumn("back", back).filter(F.col("back") <= most) if most else ends
    return kept.select(F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("dt")).alias("window"), F.col("dt").alias("train_end"), "window_end")


def drift_states(prices: DataFrame, windows: DataFrame) -> DataFrame:
    """``(window, asset, last, drift, scale)`` at each window's training end: the last price, the mean step and the mean absolute step so far.

    They are running aggregates, one pass over the panel; windows meet it at their ends' dates only.
    """
    so_far = Window.partitionBy("asset").orderBy("dt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("asset").orderBy("dt").rowsBetween(Window.unboundedPreceding, -1)
    dense = panel.densify(prices, leading=False)
    steps = dense.withColumn("step", F.abs(F.col("price") - F.last("price", ignorenulls=True).over(before)))
    last, first = F.last("price", ignorenulls=True).over(so_far), F.first("price", ignorenulls=True).over(so_far)
    n = F.count("price").over(so_far)
    drift = F.when(n > 1, (last - first) / (n - 1)).otherwise(0.0)
    states = steps.select("asset", F.col("dt").alias("train_end"), last.alias("last"), drift.alias("drift"), F.avg("step").over(so_far).alias("scale"))
    return states.filter("last is not null").join(windows.select("window", "train_end"), "train_end").drop("train_end")


def window_returns(returns: DataFrame, windows: DataFrame) -> DataFrame:
    """``(window, asset, dt, r)``: the returns after each window's training end, up to its own end.

    Windows don't overlap, so a date has one: the last one that began before it, found in one ordered pass over the dates of both
    tables, which is joined back by date.
    """
    marks = windows.select(F.col("train_end").alias("dt"), F.struct("window", "window_end").alias("w"))
    dates = returns.select("dt").distinct().withColumn("w", F.lit(None).cast("struct<window:int,window_end:date>"))
    both = dates.unionByName(marks.select("dt", F.col("w").cast("struct<window:int,window_end:date>").alias("w")))
    # a date that ends the training of a window still belongs to the one before
    order = Window.partitionBy(F.lit(1)).orderBy("dt", F.col("w").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = both.select("dt", "w", F.last("w", ignorenulls=True).over(order).alias("of")).filter("w is null and of is not null and dt <= of.window_end")
    return returns.join(at.select("dt", "of.window"), "dt").select("window", "asset", "dt", "r")


def summary_of_windows(results: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and sample deviation of ``metrics`` by portfolio; the deviation of a single window is 0."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.when(F.count("*") == 1, F.coalesce(F.stddev_samp(m), F.lit(0.0))).otherwise(F.stddev_samp(m)).alias(f"{m}_std")]
    return results.groupBy("portfolio").agg(*aggs)


def compared_to_previous(results: DataFrame, metric: str) -> DataFrame:
    """Each window's metric, that of the portfolio's window before, and the change."""
    before = F.lag(metric).over(Window.partitionBy("portfolio").orderBy("window"))
    return results.select("portfolio", "window", metric, before.alias("previous")).withColumn("change", F.col(metric) - F.col("previous"))


def win_rate(results: DataFrame, first: str, second: str, metric: str) -> DataFrame:
    """Share of windows in which ``first`` is above ``second``; a window that lacks either is a loss, null if one never occurs."""
    by = results.filter(F.col("portfolio").isin(first, second)).groupBy("window").agg(
        F.max(F.when(F.col("portfolio") == first, F.col(metric))).alias("x"), F.max(F.when(F.col("portfolio") == second, F.col(metric))).alias("y"),
        F.max(F.col("portfolio") == first).alias("has_x"), F.max(F.col("portfolio") == second).alias("has_y"),
    )
    won = F.avg(F.coalesce(F.col("x") > F.col("y"), F.lit(False)).cast("double"))
    return by.agg(F.when(F.max("has_x") & F.max("has_y"), won).alias("win_rate"))
