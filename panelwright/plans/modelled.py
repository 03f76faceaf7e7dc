"""Queries of the model-based forecasts, volatilities and tests, of stores, and of what the service answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import backtest, extension, models, optimise, panel, retrieval
from ..sources import stores
from ..streaming import appended, bars, filled_stream, latest
from .forecasts import HORIZON, LEAST, STEP, _DRIFT
from .panels import _PANEL, _rounded, weekly, weekly_returns
from .portfolios import _problem, filled_weekly


def _store(spark: SparkSession, label: str) -> str:
    """A fresh folder that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def e02_ets(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(models.all_assets(weekly(spark, d), HORIZON, "ets"), 2)


def e04_arima(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(models.all_assets(weekly(spark, d), HORIZON, "arima"), 2)


def e05_regression(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(models.all_assets(weekly(spark, d), HORIZON, "ml_regression"), 2)


def e06_network(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(models.all_assets(weekly(spark, d), HORIZON, "lstm", told=True), 4)


def e07_all_models(spark: SparkSession, d: str) -> DataFrame:
    """How far ahead each registered model goes, for every asset, and whether its bands enclose the forecast."""
    parts = [models.all_assets(weekly(spark, d), 3, m).withColumn("model", F.lit(m)) for m in sorted(models.FORECASTERS)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("model", "asset").agg(F.count("*").alias("steps"), F.min((F.col("lower") <= F.col("forecast")) & (F.col("forecast") <= F.col("upper"))).alias("enclosed"))


def v04_forecast_variances(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(models.forecast_variances(weekly_returns(spark, d), HORIZON), 4)


def v05_garch_covariance(spark: SparkSession, d: str) -> DataFrame:
    r = weekly_returns(spark, d)
    return _rounded(models.garch_covariance(r, panel.complete_cases(r), HORIZON), 3)


def v05_fallback_covariance(spark: SparkSession, d: str) -> DataFrame:
    """Too short a history for the model: the sample variances are on the diagonal."""
    r = weekly_returns(spark, d)
    short = r.withColumn("i", F.row_number().over(Window.partitionBy("asset").orderBy("dt"))).filter("i <= 90").drop("i")
    return _rounded(models.garch_covariance(short, panel.complete_cases(short), HORIZON).filter("asset_i = asset_j").select(F.col("asset_i").alias("asset"), "cov"))


def v08_stationarity(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(models.stationarity(weekly_returns(spark, d)), 3)


def w09_lookback_features(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of the ten returns before each return, and the first of them."""
    w = Window.partitionBy("asset").orderBy("dt")
    before = w.rowsBetween(-models.LOOKBACK, -1)
    rows = weekly_returns(spark, d).select("asset", "dt", "r", F.lag("r", models.LOOKBACK).over(w).alias("first"), F.avg("r").over(before).alias("mean"), F.stddev_pop("r").over(before).alias("std"))
    return _rounded(rows.filter("first is not null"))


def w11_rolling_length(spark: SparkSession, d: str) -> DataFrame:
    """About a quarter of a year, between six periods and a quarter of the history."""
    n = weekly_returns(spark, d).groupBy("asset").agg(F.count("*").alias("n"))
    return n.select("asset", F.greatest(F.lit(6), F.least(F.floor(F.col("n") / 4), F.lit(round(52 * 3 / 12)))).cast("int").alias("window"))


def b05_single_window(spark: SparkSession, d: str) -> DataFrame:
    """One window: the last dates held out, metrics of the three portfolio types."""
    return _rounded(backtest.walk_forward(filled_weekly(spark, d), LEAST, STEP, 1))


def s28_chunk_store(spark: SparkSession, d: str) -> DataFrame:
    folder, docs = _store(spark, "chunks"), spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source")
    stores.save_chunks(docs.filter("doc_id < 10"), ["b", "A"], folder)
    stores.save_chunks(docs, ["a", "B"], folder)
    stores.save_chunks(docs.limit(0), ["A", "b"], folder)
    return stores.load_chunks(spark, ["B", "a"], folder).groupBy("source").agg(F.count("*").alias("n"))


def s29_tracked_runs(spark: SparkSession, d: str) -> DataFrame:
    folder = _store(spark, "runs")
    run = spark.range(1).select(F.lit("run-1").alias("run_id"), F.lit("naive").alias("model"))
    values = weekly(spark, d).groupBy(F.lit("run-1").alias("run_id"), F.col("asset").alias("metric")).agg(F.max("price").alias("value"))
    stores.save_run(run, {"horizon": "12", "frequency": "weekly"}, values, folder)
    read = lambda t: spark.read.parquet(f"{folder}/{t}")
    n = read("run_params").groupBy("run_id").agg(F.count("*").alias("n_params"))
    return _rounded(read("runs").join(n, "run_id").join(read("run_metrics"), "run_id"))


def s30_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Of the greatest price of each week, which any order of reading gives to the last bit."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    week = panel.period_end(F.to_date("o_orderdate"), "weekly")
    return stores.fingerprint(orders.groupBy(F.col("o_orderpriority").alias("asset"), week.alias("dt")).agg(F.max("o_totalprice").alias("price")))


def s34_sql_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts from SQL text, by a table function over each asset's prices."""
    extension.register(spark)
    weekly(spark, d).createOrReplaceTempView("weekly_prices")
    return _rounded(spark.sql(f"SELECT asset, step, forecast, lower, upper FROM price_forecast(TABLE(weekly_prices) PARTITION BY asset ORDER BY (dt), {HORIZON}, 'naive')"), 4)


def s34_sql_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics from SQL text, as aggregates."""
    extension.register(spark)
    weekly_returns(spark, d).createOrReplaceTempView("weekly_returns_of_orders")
    return _rounded(spark.sql("SELECT asset, sharpe_ratio(r, 0.04D, 52) AS sharpe_ratio, max_drawdown(r, dt) AS max_drawdown FROM weekly_returns_of_orders GROUP BY asset"), 5)


def x07_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The share of documents whose judged text passes: here those that a label calls good."""
    verdict = F.when(F.col("quality") == 1, F.lit("PASS: grounded")).when(F.col("quality") == 0, F.lit("FAIL: not supported"))
    return _rounded(retrieval.verdict_rate(spark.read.parquet(f"{d}/labels.parquet").select(verdict.alias("verdict"))))


def s32_csv_results(spark: SparkSession, d: str) -> DataFrame:
    folder = _store(spark, "csv")
    stores.save_csv(_rounded(weekly(spark, d)), folder)
    return spark.read.option("header", True).schema("asset string, dt date, price double").csv(folder)


def x07_hourly_bars(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark.read.parquet(f"{d}/events.parquet"))


def x07_streamed_bars(spark: SparkSession, d: str) -> DataFrame:
    """The same bars from a stream of the events, each as the last batch that changed it has it."""
    events = spark.read.parquet(f"{d}/events.parquet")
    folder = _store(spark, "stream")
    events.write.parquet(f"{folder}/in")
    return latest(bars(spark.readStream.schema(events.schema).parquet(f"{folder}/in"), late="40 days"), folder, ["asset", "dt"])


def x07_streamed_fill(spark: SparkSession, d: str) -> DataFrame:
    """Values below 10 count as gaps, which a stream fills with its state."""
    events = spark.read.parquet(f"{d}/events.parquet")
    price = F.when(F.col("value") >= 10, F.col("value"))
    prices = events.select(F.col("event_type").alias("asset"), F.col("ts").alias("dt"), F.col("event_id").alias("id"), price.alias("price"))
    folder = _store(spark, "stream")
    prices.write.parquet(f"{folder}/in")
    return _rounded(appended(filled_stream(spark.readStream.schema(prices.schema).parquet(f"{folder}/in"), "1 day"), folder))


def s34_forecast(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(models.all_assets(weekly(spark, d), 5, "naive"), 2)


def s34_optimize(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(optimise.max_sharpe(_problem(spark, d), ["portfolio"], 0.35).select("asset", "w"), 4)


ORACLE_SQL = {
    "e07_all_models": f"""WITH {_PANEL} SELECT model, asset, 3::BIGINT AS steps, true AS enclosed FROM (SELECT DISTINCT asset FROM panel),
  (VALUES ('arima'), ('ets'), ('lstm'), ('ml_regression'), ('naive'), ('theta')) t(model)""",
    "v05_fallback_covariance": f"""WITH {_PANEL}, short AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY dt) AS i FROM rets) WHERE i <= 90)
SELECT asset, round(var_samp(r) * 52, 6) AS cov FROM short GROUP BY asset""",
    "w09_lookback_features": f"""WITH {_PANEL} SELECT asset, dt, round(r, 6) AS r, round("first", 6) AS "first", round(mean, 6) AS mean, round(std, 6) AS std FROM (
  SELECT asset, dt, r, lag(r, 10) OVER (PARTITION BY asset ORDER BY dt) AS "first", avg(r) OVER w AS mean, stddev_pop(r) OVER w AS std FROM rets
  WINDOW w AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) WHERE "first" IS NOT NULL""",
    "w11_rolling_length": f"WITH {_PANEL} SELECT asset, CAST(greatest(6, least(count(*) // 4, 13)) AS INTEGER) AS \"window\" FROM rets GROUP BY asset",
    "s28_chunk_store": "SELECT source, count(*) AS n FROM documents GROUP BY 1",
    "s29_tracked_runs": f"WITH {_PANEL} SELECT 'run-1' AS run_id, 'naive' AS model, 2::BIGINT AS n_params, asset AS metric, round(max(price), 6) AS value FROM panel GROUP BY asset",
    "s30_fingerprint": """WITH week AS (SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) + CAST((12 - isodow(o_orderdate)) % 7 AS INTEGER) AS dt, max(o_totalprice) AS price FROM orders GROUP BY 1, 2
), own AS (SELECT sha256(asset || chr(10) || string_agg(strftime(dt, '%Y-%m-%d') || '|' || replace(printf('%a', price), 'p+', 'p'), chr(10) ORDER BY dt)) AS h FROM week GROUP BY asset
), buckets AS (SELECT sha256(string_agg(h, '' ORDER BY h)) AS h FROM own GROUP BY h[:3]) SELECT sha256(string_agg(h, '' ORDER BY h)) AS fingerprint FROM buckets""",
    "s32_csv_results": f"WITH {_PANEL} SELECT asset, dt, round(price, 6) AS price FROM panel",
    "x07_hourly_bars": "SELECT event_type AS asset, date_trunc('hour', ts) AS dt, arg_min(value, (ts, value)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, value)) AS close, count(*) AS n FROM events GROUP BY 1, 2",
    "x07_streamed_bars": "SELECT event_type AS asset, date_trunc('hour', ts) AS dt, arg_min(value, (ts, value)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, value)) AS close, count(*) AS n FROM events GROUP BY 1, 2",
    "x07_streamed_fill": """SELECT event_type AS asset, ts AS dt, event_id AS id, round(last_value(CASE WHEN value >= 10 THEN value END IGNORE NULLS) OVER (
  PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS price FROM events""",
    "s34_sql_forecast": f"""WITH {_DRIFT} SELECT asset, CAST(step AS INTEGER) AS step, round(last + drift * step, 4) AS forecast,
  round(last + drift * step - 1.96::DOUBLE * sd * sqrt(step), 4) AS lower, round(last + drift * step + 1.96::DOUBLE * sd * sqrt(step), 4) AS upper FROM facts, range(1, {HORIZON + 1}) t(step)""",
    "s34_sql_metrics": f"""WITH {_PANEL}, e AS (SELECT asset, dt, r, r - (power(1.04, 1.0 / 52) - 1) AS e, product(1 + r) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING) AS g FROM rets
), f AS (SELECT *, g / greatest(max(g) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING), 1.0) - 1 AS fall FROM e)
SELECT asset, round(avg(e) / stddev_samp(e) * sqrt(52), 5) AS sharpe_ratio, round(least(min(fall), 0), 5) AS max_drawdown FROM f GROUP BY asset""",
    "x07_verdicts": "SELECT count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pass_rate FROM labels",
    "s34_forecast": f"""WITH {_DRIFT} SELECT asset, CAST(step AS INTEGER) AS step, round(last + drift * step, 2) AS forecast,
  round(last + drift * step - 1.96::DOUBLE * sd * sqrt(step), 2) AS lower, round(last + drift * step + 1.96::DOUBLE * sd * sqrt(step), 2) AS upper FROM facts, range(1, 6) t(step)""",
}
QUERIES = {k: globals()[k] for k in [*ORACLE_SQL, "e02_ets", "e04_arima", "e05_regression", "e06_network", "v04_forecast_variances", "v05_garch_covariance", "v08_stationarity", "b05_single_window", "s34_optimize"]}
