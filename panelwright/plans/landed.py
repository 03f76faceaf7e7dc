"""Queries of the payload parsers. Prices land as payloads made from the weekly panel; parsers of other payloads are tested on fixed answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import panel
from ..sources import payloads, stores
from .panels import _PANEL, _rounded, weekly, weekly_returns

#: Symbols of a request for several.
BATCH = 3

# ---------------------------------------------------------------- landing


def _days(prices: DataFrame, day: Column) -> DataFrame:
    return prices.groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("dt", day.alias("day"), "price"))).alias("x"))


def landed_yahoo(prices: DataFrame) -> DataFrame:
    x = _days(prices, F.unix_seconds(F.col("dt").cast("timestamp_ltz")) + 14 * 3600)
    pick = lambda c: F.transform("x", lambda r: r[c])
    result = F.struct(F.struct(F.lit("America/New_York").alias("exchangeTimezoneName")).alias("meta"), pick("day").alias("timestamp"), F.struct(F.array(F.struct(pick("price").alias("adjclose"))).alias("adjclose")).alias("indicators"))
    return x.select("asset", F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart"))).alias("payload"))


def landed_tiingo(prices: DataFrame) -> DataFrame:
    x = _days(prices, F.concat(F.col("dt").cast("string"), F.lit("T00:00:00.000Z")))
    return x.select("asset", F.to_json(F.transform("x", lambda r: F.struct(r["day"].alias("date"), r["price"].alias("adjClose")))).alias("payload"))


def landed_alpha_vantage(prices: DataFrame) -> DataFrame:
    x = _days(prices, F.col("dt").cast("string"))
    series = F.map_from_entries(F.transform("x", lambda r: F.struct(r["day"], F.create_map(F.lit("5. adjusted close"), r["price"].cast("string")))))
    note = F.struct(F.lit("rate limit").alias("Note"))
    return x.select("asset", F.to_json(F.struct(series.alias("Time Series (Daily)"))).alias("payload")).unionByName(x.select("asset", F.to_json(note).alias("payload")))


def landed_twelve_data(prices: DataFrame) -> DataFrame:
    x = _days(prices, F.col("dt").cast("string"))
    values = F.transform("x", lambda r: F.struct(r["day"].alias("datetime"), r["price"].cast("string").alias("close")))
    # a request asks for a few symbols
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("asset")) - 1
    batch = prices.select("asset").distinct().select("asset", F.floor(place / BATCH).alias("batch"))
    every = x.join(batch, "asset").groupBy("batch").agg(F.map_from_entries(F.collect_list(F.struct("asset", F.struct(values.alias("values"))))).alias("m"), F.collect_list("asset").alias("asked"))
    single = x.limit(0).select(F.array("asset").alias("asked"), F.to_json(F.struct(F.struct(F.col("asset").alias("symbol")).alias("meta"), values.alias("values"))).alias("payload"))
    return every.select("asked", F.to_json("m").alias("payload")).unionByName(single)


def s03_yahoo_chart(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(payloads.yahoo_chart(landed_yahoo(weekly(spark, d))))


def s04_twelve_data(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(payloads.twelve_data(landed_twelve_data(weekly(spark, d))))


def s05_alpha_vantage(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(payloads.alpha_vantage(landed_alpha_vantage(weekly(spark, d)), "1994-01-01", "1996-12-31"))


def s06_tiingo(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(payloads.tiingo(landed_tiingo(weekly(spark, d))))


def s07_first_source(spark: SparkSession, d: str) -> DataFrame:
    prices = weekly(spark, d)
    none, two = payloads.tiingo(landed_tiingo(prices.filter("price < 0"))), payloads.twelve_data(landed_twelve_data(prices))
    return _rounded(payloads.first_source([("tiingo", none), ("twelvedata", two), ("alpha vantage", prices)]))


def _filled(spark: SparkSession, d: str) -> DataFrame:
    prices = weekly(spark, d)
    some, one = prices.filter("asset not in ('3-MEDIUM', '5-LOW')"), prices.filter("asset = '5-LOW'")
    return payloads.filled_by_asset([("yfinance", some), ("tiingo", payloads.tiingo(landed_tiingo(one))), ("alpha vantage", prices)])


def s01_filled_panel(spark: SparkSession, d: str) -> DataFrame:
    """The whole load: sources by priority, then one calendar with gaps filled forward."""
    return _rounded(panel.forward_fill(panel.densify(_filled(spark, d).select("asset", "dt", "price"))))


def s08_filled_assets(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_filled(spark, d))


def s08_provenance(spark: SparkSession, d: str) -> DataFrame:
    return payloads.provenance(_filled(spark, d), "yfinance")


def s09_vix(spark: SparkSession, d: str) -> DataFrame:
    """The last value of one series and the change to the one before; no row where it has none."""
    one = weekly(spark, d).filter("asset = '2-HIGH' and price is not null").groupBy("asset").agg(F.max_by("price", "dt").alias("vix"), F.max("dt").alias("dt"))
    return _rounded(one)


def factor_lines(spark: SparkSession, d: str) -> DataFrame:
    """A published factor file: a title, a header, daily lines in percent, a blank, and a second table."""
    r = weekly_returns(spark, d).groupBy("dt").agg(*(F.max(F.when(F.col("asset") == a, F.round(10 * F.col("r"), 4))).alias(c) for a, c in zip(("1-URGENT", "2-HIGH", "3-MEDIUM"), "msh", strict=True)))
    data = r.filter("m is not null and s is not null and h is not null").select(
        (10 + F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("dt"))).alias("i"), F.concat_ws(",", F.date_format("dt", "yyyyMMdd"), *(F.col(c).cast("string") for c in "msh"), F.lit("0.05")).alias("line")
    )
    other = [(0, "This file was made from the panel"), (1, ""), (2, ",Mkt-RF,SMB,HML,RF"), (10**8, ""), (10**8 + 1, "Annual"), (10**8 + 2, "199501, 1.0, 2.0, 3.0, 4.0"), (10**8 + 3, "Copyright")]
    return data.unionByName(spark.createDataFrame(other, "i int, line string"))


def s14_zipped_factors(spark: SparkSession, d: str) -> DataFrame:
    """The factor file as it is published, in a ZIP archive, which is written and read again."""
    folder = stores.fresh_folder(spark, "zip")
    stores.save_zip(factor_lines(spark, d).withColumn("file", F.lit("factors")), folder)
    return _rounded(payloads.factor_block(payloads.zipped_lines(spark, folder).select("i", "line"), ["mkt_rf", "smb", "hml", "rf"]), 8)


def s14_factor_block(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(factors(spark, d), 8)


def factors(spark: SparkSession, d: str) -> DataFrame:
    return payloads.factor_block(factor_lines(spark, d), ["mkt_rf", "smb", "hml", "rf"])


_FACTORS = _PANEL + """, wide AS (
  SELECT dt, round(10 * max(r) FILTER (asset = '1-URGENT'), 4) AS m, round(10 * max(r) FILTER (asset = '2-HIGH'), 4) AS s, round(10 * max(r) FILTER (asset = '3-MEDIUM'), 4) AS h FROM rets GROUP BY dt
), fac AS (SELECT dt, m / 100 AS mkt_rf, s / 100 AS smb, h / 100 AS hml, 0.0005::DOUBLE AS rf FROM wide WHERE m IS NOT NULL AND s IS NOT NULL AND h IS NOT NULL)"""
_ALL = f"WITH {_PANEL} SELECT asset, dt, round(price, 6) AS price FROM panel"
_SOURCE = "CASE asset WHEN '3-MEDIUM' THEN 'alpha vantage' WHEN '5-LOW' THEN 'tiingo' ELSE 'yfinance' END"

ORACLE_SQL = {
    "s03_yahoo_chart": _ALL, "s04_twelve_data": _ALL, "s06_tiingo": _ALL,
    "s05_alpha_vantage": f"{_ALL} WHERE dt BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'",
    "s07_first_source": f"WITH {_PANEL} SELECT asset, dt, round(price, 6) AS price, 'twelvedata' AS source FROM panel",
    "s01_filled_panel": f"WITH {_PANEL} SELECT asset, dt, round(price, 6) AS price FROM filled",
    "s08_filled_assets": f"WITH {_PANEL} SELECT asset, dt, round(price, 6) AS price, {_SOURCE} AS source FROM panel",
    "s08_provenance": "SELECT 'yfinance + alpha vantage for 3-MEDIUM; tiingo for 5-LOW' AS source",
    "s09_vix": f"WITH {_PANEL} SELECT asset, round(arg_max(price, dt), 6) AS vix, max(dt) AS dt FROM panel WHERE asset = '2-HIGH' GROUP BY asset",
    "s14_zipped_factors": f"WITH {_FACTORS} SELECT dt, round(mkt_rf, 8) AS mkt_rf, round(smb, 8) AS smb, round(hml, 8) AS hml, rf FROM fac",
    "s14_factor_block": f"WITH {_FACTORS} SELECT dt, round(mkt_rf, 8) AS mkt_rf, round(smb, 8) AS smb, round(hml, 8) AS hml, rf FROM fac",
}
QUERIES = {k: globals()[k] for k in ORACLE_SQL}
