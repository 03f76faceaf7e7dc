"""Queries of forecasts and walk-forward windows over the weekly panel of the orders, and of text retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forecast, models, retrieval
from .panels import _PANEL, _rounded, weekly, weekly_returns

HORIZON, LEAST, STEP = 12, 52, 13


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return forecast.expanding_windows(weekly(spark, d), LEAST, STEP)


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Every asset held on its own in every window: ``(window, portfolio, period_return)``."""
    held = forecast.window_returns(weekly_returns(spark, d), _windows(spark, d))
    return held.groupBy("window", F.col("asset").alias("portfolio")).agg((F.product(1 + F.col("r")) - 1).alias("period_return"))


def e01_naive_drift(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(forecast.naive_drift(weekly(spark, d), HORIZON), 4)


def e03_theta(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(models.all_assets(weekly(spark, d), HORIZON, "theta"), 4)


def e08_forecast_mu(spark: SparkSession, d: str) -> DataFrame:
    prices = weekly(spark, d)
    return _rounded(forecast.forecast_mu(prices, forecast.naive_drift(prices, HORIZON), 52))


def w12_expanding_windows(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d)


def w07_compared_windows(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(forecast.compared_to_previous(_results(spark, d), "period_return"))


def a03_window_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(forecast.summary_of_windows(_results(spark, d), ["period_return"]))


def a05_win_rate(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(forecast.win_rate(_results(spark, d), "1-URGENT", "5-LOW", "period_return"))


def t03_tfidf_top(spark: SparkSession, d: str) -> DataFrame:
    """The ten documents most like the first benchmark passage (a query by example)."""
    first = spark.read.parquet(f"{d}/benchmark.parquet").orderBy("item_id").select("text").first()
    asked = first["text"] if first else ""
    chunks = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    return _rounded(retrieval.similar_chunks(chunks, asked, 10))


def t03_tfidf_every_50th(spark: SparkSession, d: str) -> DataFrame:
    """For each document whose id is divisible by 50 the ten documents most like it, of all."""
    chunks = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    asked = chunks.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    return _rounded(retrieval.similar_chunks(chunks, asked, 10))


_DRIFT = _PANEL + """, moves AS (SELECT asset, dt, price, price - lag(price) OVER (PARTITION BY asset ORDER BY dt) AS d FROM panel
), facts AS (SELECT asset, arg_max(price, dt) AS last, coalesce(avg(d), 0) AS drift, coalesce(stddev_samp(d), 0) AS sd FROM moves GROUP BY asset)"""
_WINDOWS = _PANEL + f""", calendar AS (
  SELECT dt, row_number() OVER (ORDER BY dt) AS i, lead(dt, {STEP}) OVER (ORDER BY dt) AS window_end FROM (SELECT DISTINCT dt FROM panel)
), win AS (
  SELECT row_number() OVER (ORDER BY dt) AS "window", dt AS train_end, window_end FROM calendar
  WHERE i >= {LEAST} AND (i - {LEAST}) % {STEP} = 0 AND window_end IS NOT NULL
), res AS (
  SELECT win."window", r.asset AS portfolio, product(1 + r.r) - 1 AS x FROM rets r JOIN win ON r.dt > win.train_end AND r.dt <= win.window_end GROUP BY 1, 2)"""

ORACLE_SQL = {
    "e01_naive_drift": f"""WITH {_DRIFT} SELECT asset, CAST(step AS INTEGER) AS step, round(last + drift * step, 4) AS forecast,
  round(last + drift * step - 1.96::DOUBLE * sd * sqrt(step), 4) AS lower, round(last + drift * step + 1.96::DOUBLE * sd * sqrt(step), 4) AS upper
FROM facts, range(1, {HORIZON + 1}) t(step)""",
    "e08_forecast_mu": f"""WITH {_DRIFT}
SELECT asset, round(power(greatest((last + drift * {HORIZON}) / last, 1e-6), 52.0 / {HORIZON}) - 1, 6) AS mu FROM facts""",
    "w12_expanding_windows": f"""WITH {_WINDOWS} SELECT "window", train_end, window_end FROM win""",
    "w07_compared_windows": f"""WITH {_WINDOWS} SELECT portfolio, "window", round(x, 6) AS period_return,
  round(lag(x) OVER w, 6) AS previous, round(x - lag(x) OVER w, 6) AS change FROM res WINDOW w AS (PARTITION BY portfolio ORDER BY "window")""",
    "a03_window_summary": f"""WITH {_WINDOWS} SELECT portfolio, round(avg(x), 6) AS period_return_mean,
  round(CASE WHEN count(*) = 1 THEN coalesce(stddev_samp(x), 0) ELSE stddev_samp(x) END, 6) AS period_return_std FROM res GROUP BY portfolio""",
    "a05_win_rate": f"""WITH {_WINDOWS}, p AS (
  SELECT "window", max(x) FILTER (portfolio = '1-URGENT') AS a, max(x) FILTER (portfolio = '5-LOW') AS b
  FROM res WHERE portfolio IN ('1-URGENT', '5-LOW') GROUP BY 1)
SELECT round(CASE WHEN count(a) > 0 AND count(b) > 0 THEN avg(CASE WHEN a > b THEN 1.0::DOUBLE ELSE 0 END) END, 6) AS win_rate FROM p""",
    "t03_tfidf_top": r"""
WITH words AS (SELECT doc_id AS chunk_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')) AS term FROM documents
), counts AS (SELECT chunk_id, term, count(*) AS n FROM words GROUP BY 1, 2
), asked AS (
  SELECT term, count(*) AS q FROM (SELECT unnest(regexp_extract_all(lower((SELECT text FROM benchmark ORDER BY item_id LIMIT 1)), '[\p{L}\p{N}_]{2,}')) AS term) GROUP BY 1
), df AS (SELECT term, count(*) AS df FROM counts GROUP BY 1
), idf AS (
  SELECT term, q, ln((1.0 + (SELECT count(*) + 1 FROM documents)) / (1.0 + coalesce(df, 0) + CASE WHEN q IS NULL THEN 0 ELSE 1 END)) + 1 AS idf
  FROM df FULL JOIN asked USING (term)
), qn AS (SELECT sqrt(sum(q * idf * q * idf)) AS q_norm FROM idf WHERE q IS NOT NULL
), per AS (
  SELECT chunk_id, sqrt(sum(n * idf * n * idf)) AS norm, sum(n * idf * q * idf) AS dot FROM counts JOIN idf USING (term) GROUP BY 1)
SELECT chunk_id, round(dot / (norm * q_norm), 6) AS similarity FROM per, qn WHERE dot > 0 ORDER BY round(dot / (norm * q_norm), 9) DESC, chunk_id LIMIT 10""",
    "t03_tfidf_every_50th": r"""
WITH words AS (SELECT doc_id AS chunk_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')) AS term FROM documents
), counts AS (SELECT chunk_id, term, count(*) AS n FROM words GROUP BY 1, 2
), df AS (SELECT term, count(*) AS df FROM counts GROUP BY 1
), asked AS (SELECT chunk_id AS query_id, term, n AS q FROM counts WHERE chunk_id % 50 = 0
), idf AS (
  SELECT query_id, term, q, ln((1.0 + (SELECT count(*) + 1 FROM documents)) / (1.0 + df + CASE WHEN q IS NULL THEN 0 ELSE 1 END)) + 1 AS idf
  FROM (SELECT DISTINCT query_id FROM asked) CROSS JOIN df LEFT JOIN asked USING (query_id, term)
), qn AS (SELECT query_id, sqrt(sum(q * idf * q * idf)) AS q_norm FROM idf WHERE q IS NOT NULL GROUP BY 1
), per AS (
  SELECT query_id, chunk_id, sqrt(sum(n * idf * n * idf)) AS norm, sum(n * idf * q * idf) AS dot FROM counts JOIN idf USING (term) GROUP BY 1, 2
), scored AS (SELECT query_id, chunk_id, dot / (norm * q_norm) AS s FROM per JOIN qn USING (query_id) WHERE dot > 0)
SELECT query_id, chunk_id, round(s, 6) AS similarity FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) <= 10""",
}
QUERIES = {k: globals()[k] for k in [*ORACLE_SQL, "e03_theta"]}
