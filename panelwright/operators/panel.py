"""Price panels in long form: ``prices(asset, dt, price)``. Every operator is one window or one shuffle by asset or date."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Periods per year of each sampling frequency (fixed values).
PERIODS = {"daily": 252, "weekly": 52, "monthly": 12, "yearly": 1}


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the folder that executors share: later steps start from it, not from its plan."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def period_end(dt: Column, frequency: str) -> Column:
    """The label of a date's bin: its Friday, month end or year end."""
    if frequency == "weekly":
        return F.next_day(F.date_sub(dt, 1), "FRI")
    if frequency == "monthly":
        return F.last_day(dt)
    if frequency == "yearly":
        return F.make_date(F.year(dt), F.lit(12), F.lit(31))
    if frequency == "daily":
        return F.to_date(dt)
    raise ValueError(frequency)


def average_prices(rows: DataFrame, asset: Column, at: Column, value: Column, frequency: str = "weekly") -> DataFrame:
    """A panel of averages per asset and bin."""
    return rows.groupBy(asset.alias("asset"), period_end(F.to_date(at), frequency).alias("dt")).agg(F.avg(value).alias("price"))


def resample_last(prices: DataFrame, frequency: str) -> DataFrame:
    """The last known price of each bin; bins without one are dropped."""
    known = prices.filter("price is not null and not isnan(price)")
    return known.groupBy("asset", period_end(F.col("dt"), frequency).alias("dt")).agg(F.max_by("price", known["dt"]).alias("price"))


def densify(prices: DataFrame, leading: bool = True) -> DataFrame:
    """Every asset on every date of the shared calendar, null where it has no price; without ``leading``, from its own first date on.

    Dates are numbered, a row each; an asset's row meets its first date's number and is carried on to the last one. So the
    panel is made of equal joins, and one of late-listed assets holds no dates before they exist. ``prices`` is written once and read three times.
    """
    clean = written(prices.withColumn("price", F.nanvl("price", F.lit(None).cast("double"))), "prices")
    dates = Window.partitionBy(F.lit(1))
    calendar = clean.select("dt").distinct().select("dt", F.row_number().over(dates.orderBy("dt")).alias("i"), F.count("*").over(dates).alias("n"))
    calendar = written(calendar.select("dt", "i", F.col("n").cast("int").alias("n")), "calendar")
    firsts = clean.groupBy("asset").agg(F.min("dt").alias("dt")).join(calendar, "dt")
    grid = firsts.select("asset", F.explode(F.sequence(F.lit(1) if leading else F.col("i"), F.col("n"))).alias("i")).join(calendar.select("dt", "i"), "i")
    return grid.select("asset", "dt").join(clean, ["asset", "dt"], "left")


def forward_fill(prices: DataFrame) -> DataFrame:
    """Gaps take the last known price; what precedes the first price stays null; dates without any price go."""
    w = Window.partitionBy("asset").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    filled = prices.withColumn("price", F.last("price", ignorenulls=True).over(w))
    any_known = F.max(F.col("price").isNotNull()).over(Window.partitionBy("dt"))
    return filled.withColumn("known", any_known).filter("known").drop("known")


def returns(prices: DataFrame) -> DataFrame:
    """``(asset, dt, r)``: simple returns over the panel's own calendar; null prices give null returns."""
    last = F.lag("price").over(Window.partitionBy("asset").orderBy("dt"))
    return prices.select("asset", "dt", (F.try_divide(F.col("price"), last) - 1).alias("r"))


def rebase(prices: DataFrame, to: float = 100.0) -> DataFrame:
    """Prices as multiples of the asset's first known price."""
    w = Window.partitionBy("asset").orderBy("dt").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first("price", ignorenulls=True).over(w)
    return prices.select("asset", "dt", (F.try_divide(F.col("price"), first) * to).alias("price"))


def complete_cases(rows: DataFrame, value: str = "r") -> DataFrame:
    """Dates on which every asset has a value."""
    assets = rows.agg(F.countDistinct("asset").alias("n_assets"))
    held = rows.groupBy("dt").agg(F.count(value).alias("n_held")).join(F.broadcast(assets)).filter("n_held = n_assets")
    return rows.join(held.select("dt"), "dt", "left_semi")


def with_history(prices: DataFrame, least: int) -> DataFrame:
    """Assets with at least ``least`` known prices."""
    enough = prices.groupBy("asset").agg(F.count("price").alias("n")).filter(F.col("n") >= least)
    return prices.join(enough.select("asset"), "asset", "left_semi")
