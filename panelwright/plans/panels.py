"""Queries over the price panel of the orders (asset: priority, weekly average of the total) and the hourly one of the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, moments, panel

ROUND = 6


def _rounded(df: DataFrame, digits: int = ROUND) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def weekly(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return panel.average_prices(orders, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return panel.average_prices(orders, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), "daily")


def weekly_benchmark(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    prices = panel.average_prices(orders, F.lit("all"), F.col("o_orderdate"), F.col("o_totalprice"))
    return panel.returns(prices).filter("r is not null").select("dt", F.col("r").alias("rb"))


def weekly_returns(spark: SparkSession, d: str) -> DataFrame:
    return panel.returns(panel.forward_fill(panel.densify(weekly(spark, d)))).filter("r is not null")


def equal_weights(returns: DataFrame) -> DataFrame:
    assets = returns.select("asset").distinct()
    n = assets.agg(F.count("*").alias("n"))
    return assets.join(F.broadcast(n)).select(F.lit("equal").alias("portfolio"), "asset", (1 / F.col("n")).alias("w"))


def a01_weekly_panel(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(weekly(spark, d))


def a01_monthly_last(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(panel.resample_last(weekly(spark, d), "monthly"))


def a01_weekly_last(spark: SparkSession, d: str) -> DataFrame:
    """The last daily average of each week."""
    return _rounded(panel.resample_last(daily(spark, d), "weekly"))


def a01_yearly_last(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(panel.resample_last(daily(spark, d), "yearly"))


def w05_hourly_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    hourly = events.groupBy(F.col("event_type").alias("asset"), F.date_trunc("hour", "ts").alias("dt")).agg(F.avg("value").alias("price"))
    return _rounded(panel.forward_fill(panel.densify(hourly)))


def m01_returns(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(weekly_returns(spark, d))


def p05_assets_with_history(spark: SparkSession, d: str) -> DataFrame:
    return panel.with_history(weekly(spark, d), 200).groupBy("asset").agg(F.count("price").alias("n"))


def p09_rebased_prices(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(panel.rebase(panel.forward_fill(panel.densify(weekly(spark, d)))), 4)


def m22_performance_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.summarise(weekly_returns(spark, d), weekly_benchmark(spark, d)))


def m02_portfolio_returns(spark: SparkSession, d: str) -> DataFrame:
    r = panel.complete_cases(weekly_returns(spark, d))
    return _rounded(metrics.portfolio_returns(r, equal_weights(r)))


def m03_buy_and_hold(spark: SparkSession, d: str) -> DataFrame:
    r = panel.complete_cases(weekly_returns(spark, d))
    return _rounded(metrics.buy_and_hold(r, equal_weights(r))[0])


def m03_drifted_weights(spark: SparkSession, d: str) -> DataFrame:
    r = panel.complete_cases(weekly_returns(spark, d))
    return _rounded(metrics.buy_and_hold(r, equal_weights(r))[1])


def m23_turnover(spark: SparkSession, d: str) -> DataFrame:
    r = panel.complete_cases(weekly_returns(spark, d))
    w = equal_weights(r)
    return _rounded(metrics.turnover(w, metrics.buy_and_hold(r, w)[1]))


def m24_transaction_cost(spark: SparkSession, d: str) -> DataFrame:
    r = panel.complete_cases(weekly_returns(spark, d))
    w = equal_weights(r)
    path, _ = metrics.buy_and_hold(r, w)
    return _rounded(metrics.charge_first_period(path, metrics.turnover(w, w.limit(0)), 10.0))


def m25_correlation(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.correlation(weekly_returns(spark, d)))


def v10_rolling_sharpe(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.rolling_sharpe(weekly_returns(spark, d), 12))


def v09_hurst(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.hurst(panel.forward_fill(panel.densify(weekly(spark, d)))))


def v01_historical_mu(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(moments.historical_mu(weekly_returns(spark, d)))


def v02_ledoit_wolf(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(moments.ledoit_wolf(panel.complete_cases(weekly_returns(spark, d))))


def q05_greatest_return(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(moments.greatest_return(moments.historical_mu(weekly_returns(spark, d)), 0.0, 0.35))


def q06_portfolio_statistics(spark: SparkSession, d: str) -> DataFrame:
    r = panel.complete_cases(weekly_returns(spark, d))
    return _rounded(moments.portfolio_statistics(equal_weights(r), moments.historical_mu(r), moments.ledoit_wolf(r)))


_PANEL = """
panel AS (
  SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) + CAST((12 - isodow(o_orderdate)) % 7 AS INTEGER) AS dt, avg(o_totalprice) AS price
  FROM orders GROUP BY 1, 2
), grid AS (SELECT a.asset, t.dt FROM (SELECT DISTINCT asset FROM panel) a CROSS JOIN (SELECT DISTINCT dt FROM panel) t
), filled AS (
  SELECT g.asset, g.dt, last_value(p.price IGNORE NULLS) OVER (PARTITION BY g.asset ORDER BY g.dt ROWS UNBOUNDED PRECEDING) AS price
  FROM grid g LEFT JOIN panel p ON p.asset = g.asset AND p.dt = g.dt
), rets AS (
  SELECT * FROM (SELECT asset, dt, price / lag(price) OVER (PARTITION BY asset ORDER BY dt) - 1 AS r FROM filled) WHERE r IS NOT NULL
), cc AS (
  SELECT * FROM rets WHERE dt IN (SELECT dt FROM rets GROUP BY dt HAVING count(*) = (SELECT count(DISTINCT asset) FROM rets))
), wts AS (SELECT 'equal' AS portfolio, asset, 1.0::DOUBLE / count(*) OVER () AS w FROM (SELECT DISTINCT asset FROM cc))"""
_DAY = "day AS (SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS dt, avg(o_totalprice) AS price FROM orders GROUP BY 1, 2)"
_HOLD = _PANEL + """, held AS (
  SELECT c.asset, c.dt, w.w * product(1 + c.r) OVER (PARTITION BY c.asset ORDER BY c.dt ROWS UNBOUNDED PRECEDING) AS value FROM cc c JOIN wts w USING (asset)
), v AS (SELECT dt, sum(value) AS v FROM held GROUP BY dt
), path AS (SELECT 'equal' AS portfolio, dt, v / coalesce(lag(v) OVER (ORDER BY dt), 1) - 1 AS r FROM v
), ends AS (SELECT 'equal' AS portfolio, asset, value / sum(value) OVER () AS w FROM held WHERE dt = (SELECT max(dt) FROM held))"""
_COV = """, x AS (SELECT asset, dt, r - avg(r) OVER (PARTITION BY asset) AS x FROM cc
), s AS (SELECT a.asset AS asset_i, b.asset AS asset_j, sum(a.x * b.x) / count(*) AS s FROM x a JOIN x b USING (dt) GROUP BY 1, 2
), f AS (SELECT sum(s) FILTER (asset_i = asset_j) AS tr, sum(s * s) AS s2, sqrt(count(*)) AS k FROM s
), q AS (SELECT sum(q * q) AS q2, count(*) AS n FROM (SELECT dt, sum(x * x) AS q FROM x GROUP BY dt)
), d AS (SELECT tr / k AS m, s2 / k - (tr / k) * (tr / k) AS d2, least((q2 / n - s2) / (n * k), s2 / k - (tr / k) * (tr / k)) AS b2 FROM f, q
), cov AS (
  SELECT asset_i, asset_j, ((1 - coalesce(b2 / nullif(d2, 0), 0)) * s + coalesce(b2 / nullif(d2, 0), 0) * CASE WHEN asset_i = asset_j THEN m ELSE 0 END) * 52 AS cov
  FROM s, d
), mu AS (SELECT asset, power(product(1 + r), 52.0 / count(*)) - 1 AS mu FROM rets GROUP BY asset)"""
_RFP = "(power(1.04, 1.0 / 52) - 1)"

ORACLE_SQL = {
    "a01_weekly_panel": f"WITH {_PANEL} SELECT asset, dt, round(price, 6) AS price FROM panel",
    "a01_weekly_last": f"WITH {_DAY} SELECT asset, day.dt + CAST((12 - isodow(day.dt)) % 7 AS INTEGER) AS dt, round(arg_max(price, day.dt), 6) AS price FROM day GROUP BY asset, day.dt + CAST((12 - isodow(day.dt)) % 7 AS INTEGER)",
    "a01_yearly_last": f"WITH {_DAY} SELECT asset, make_date(year(day.dt), 12, 31) AS dt, round(arg_max(price, day.dt), 6) AS price FROM day GROUP BY asset, year(day.dt)",
    "a01_monthly_last": f"WITH {_PANEL} SELECT asset, last_day(dt) AS dt, round(arg_max(price, dt), 6) AS price FROM panel GROUP BY 1, 2",
    "w05_hourly_forward_fill": """
WITH p AS (SELECT event_type AS asset, date_trunc('hour', ts) AS dt, avg(value) AS price FROM events GROUP BY 1, 2),
g AS (SELECT a.asset, t.dt FROM (SELECT DISTINCT asset FROM p) a CROSS JOIN (SELECT DISTINCT dt FROM p) t)
SELECT g.asset, g.dt, round(last_value(p.price IGNORE NULLS) OVER (PARTITION BY g.asset ORDER BY g.dt ROWS UNBOUNDED PRECEDING), 6) AS price
FROM g LEFT JOIN p ON p.asset = g.asset AND p.dt = g.dt""",
    "m01_returns": f"WITH {_PANEL} SELECT asset, dt, round(r, 6) AS r FROM rets",
    "p05_assets_with_history": f"WITH {_PANEL} SELECT asset, count(price) AS n FROM panel GROUP BY asset HAVING count(price) >= 200",
    "p09_rebased_prices": f"""WITH {_PANEL} SELECT asset, dt, round(price / first_value(price IGNORE NULLS) OVER (
  PARTITION BY asset ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * 100, 4) AS price FROM filled""",
    "m22_performance_summary": f"""
WITH {_PANEL}, bp AS (
  SELECT CAST(o_orderdate AS DATE) + CAST((12 - isodow(o_orderdate)) % 7 AS INTEGER) AS dt, avg(o_totalprice) AS price FROM orders GROUP BY 1
), bench AS (SELECT * FROM (SELECT dt, price / lag(price) OVER (ORDER BY dt) - 1 AS rb FROM bp) WHERE rb IS NOT NULL
), w AS (
  SELECT asset, dt, r, product(1 + r) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING) AS wealth,
         quantile_cont(r, 0.05) OVER (PARTITION BY asset) AS q, r - {_RFP} AS e FROM rets
), dd AS (
  SELECT w.*, wealth / greatest(max(wealth) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING), 1) - 1 AS dd, b.rb
  FROM w LEFT JOIN bench b USING (dt)
), a AS (
  SELECT asset, count(*) AS n, product(1 + r) AS g, stddev_samp(r) AS sd, avg(e) AS em, stddev_samp(e) AS es, sqrt(avg(power(least(e, 0), 2))) AS down,
    min(dd) AS mdd, sqrt(avg(power(100 * dd, 2))) AS ulcer, skewness(r) AS sk, kurtosis(r) AS ku, any_value(q) AS var, avg(r) FILTER (r <= q) AS cvar,
    sum(greatest(e, 0)) AS gains, sum(greatest(-e, 0)) AS losses, count(rb) AS nb, product(1 + r) FILTER (rb IS NOT NULL) AS gs, product(1 + rb) AS gb,
    covar_samp(r, rb) AS cov, var_samp(rb) AS vb, avg(r - rb) AS am, stddev_samp(r - rb) AS asd
  FROM dd GROUP BY asset
), o AS (SELECT *, power(g, 52.0 / n) - 1 AS ann, cov / nullif(vb, 0) AS b, em / nullif(es, 0) AS sp FROM a)
SELECT asset, n AS n_periods, round(g - 1, 6) AS period_return, round(ann, 6) AS annual_return, round(sd * sqrt(52), 6) AS annual_volatility,
  round(sp * sqrt(52), 6) AS sharpe_ratio, round(sqrt((1 + 0.5 * sp * sp) / n) * sqrt(52), 6) AS sharpe_se, round(em / nullif(down, 0) * sqrt(52), 6) AS sortino_ratio,
  round(ann / nullif(abs(mdd), 0), 6) AS calmar_ratio, round(gains / losses, 6) AS omega_ratio, round(mdd, 6) AS max_drawdown, round(ulcer, 6) AS ulcer_index,
  round(sk, 6) AS skewness, round(ku, 6) AS kurtosis, round(var, 6) AS var_95, round(cvar, 6) AS cvar_95, round(b, 6) AS beta,
  round(am * 52 / nullif(asd * sqrt(52), 0), 6) AS information_ratio, round((ann - 0.04) / nullif(b, 0), 6) AS treynor_ratio,
  round(power(gs, 52.0 / nb) - 1 - (0.04 + b * (power(gb, 52.0 / nb) - 1 - 0.04)), 6) AS jensens_alpha
FROM o""",
    "m02_portfolio_returns": f"WITH {_PANEL} SELECT portfolio, dt, round(sum(w * r), 6) AS r FROM cc JOIN wts USING (asset) GROUP BY 1, 2",
    "m03_buy_and_hold": f"WITH {_HOLD} SELECT portfolio, dt, round(r, 6) AS r FROM path",
    "m03_drifted_weights": f"WITH {_HOLD} SELECT portfolio, asset, round(w, 6) AS w FROM ends",
    "m23_turnover": f"WITH {_HOLD} SELECT 'equal' AS portfolio, round(sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))), 6) AS turnover FROM wts a FULL JOIN ends b USING (asset)",
    "m24_transaction_cost": f"""WITH {_HOLD} SELECT portfolio, dt,
  round(CASE WHEN row_number() OVER (ORDER BY dt) = 1 THEN (1 + r) * (1 - 10 / 1e4) - 1 ELSE r END, 6) AS r FROM path""",
    "m25_correlation": f"WITH {_PANEL} SELECT a.asset AS asset_i, b.asset AS asset_j, round(corr(a.r, b.r), 6) AS corr FROM rets a JOIN rets b USING (dt) WHERE a.asset <= b.asset GROUP BY 1, 2",
    "v10_rolling_sharpe": f"""WITH {_PANEL} SELECT asset, dt, round(CASE WHEN count(r) OVER w = 12 THEN
  avg(r - {_RFP}) OVER w / nullif(stddev_samp(r - {_RFP}) OVER w, 0) * sqrt(52) END, 6) AS sharpe FROM rets
  WINDOW w AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
    "v09_hurst": f"""WITH {_PANEL}, numbered AS (SELECT asset, price, row_number() OVER (PARTITION BY asset ORDER BY dt) AS i FROM filled
), taus AS (
  SELECT a.asset, k.k, stddev_pop(b.price - a.price) AS tau FROM numbered a CROSS JOIN range(2, 20) k(k) JOIN numbered b ON b.asset = a.asset AND b.i = a.i + k.k GROUP BY 1, 2
), counts AS (SELECT asset, count(price) AS n FROM filled GROUP BY asset)
SELECT asset, round(CASE WHEN any_value(n) >= 40 AND min(tau) > 0 THEN regr_slope(ln(tau), ln(k)) END, 6) AS hurst FROM taus JOIN counts USING (asset) GROUP BY asset""",
    "v01_historical_mu": f"WITH {_PANEL} SELECT asset, round(power(product(1 + r), 52.0 / count(*)) - 1, 6) AS mu FROM rets GROUP BY asset",
    "v02_ledoit_wolf": f"WITH {_PANEL}{_COV} SELECT asset_i, asset_j, round(cov, 6) AS cov FROM cov",
    "q05_greatest_return": f"""WITH {_PANEL}{_COV}, r AS (SELECT asset, mu, row_number() OVER (ORDER BY mu DESC, asset) AS k FROM mu)
SELECT asset, round(mu, 6) AS mu, round(least(greatest(1 - (k - 1) * 0.35::DOUBLE, 0), 0.35::DOUBLE), 6) AS w FROM r""",
    "q06_portfolio_statistics": f"""WITH {_PANEL}{_COV}, cmu AS (SELECT asset, power(product(1 + r), 52.0 / count(*)) - 1 AS mu FROM cc GROUP BY asset
), g AS (SELECT sum(w * mu) AS er, sum(w * w) AS hhi FROM wts JOIN cmu USING (asset)
), k AS (
  SELECT sqrt(sum(a.w * b.w * c.cov)) AS vol, sum(CASE WHEN asset_i = asset_j THEN abs(a.w) * sqrt(c.cov) END) AS parts
  FROM cov c JOIN wts a ON a.asset = c.asset_i JOIN wts b ON b.asset = c.asset_j)
SELECT 'equal' AS portfolio, round(er, 6) AS expected_return, round(vol, 6) AS volatility, round((er - 0.04) / vol, 6) AS sharpe,
  round(parts / vol, 6) AS diversification_ratio, round(hhi, 6) AS hhi FROM g, k""",
}
QUERIES = {k: globals()[k] for k in ORACLE_SQL}
