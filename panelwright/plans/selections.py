"""Queries that choose, order and band rows, and that exercise the shared expressions, over the tables and the weekly panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import forecast, metrics, moments, panel, selection
from .forecasts import HORIZON, LEAST, STEP, _DRIFT, _WINDOWS, _results, _windows
from .panels import _COV, _PANEL, _rounded, weekly, weekly_returns

CHOSEN = ["5-LOW", "1-URGENT"]
#: Terms searched for in the documents and the query that each stands for.
TERMS = {"data": "data quality", "the": "definite articles", "license": "software licenses", "cc by": "open licenses"}


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p01_chosen_assets(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(selection.chosen_assets(weekly(spark, d), CHOSEN))


def p02_assets_with_prices(spark: SparkSession, d: str) -> DataFrame:
    prices = weekly(spark, d).withColumn("price", F.when(F.col("asset") != "3-MEDIUM", F.col("price")))
    return _rounded(selection.assets_with_prices(prices))


def p06_window_slices(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(selection.window_slices(weekly(spark, d), LEAST, STEP))


def p07_display_weights(spark: SparkSession, d: str) -> DataFrame:
    weights = moments.greatest_return(moments.historical_mu(weekly_returns(spark, d)), 0.0, 0.35)
    return _rounded(selection.display_weights(weights.select(F.lit("greatest").alias("portfolio"), "asset", "w")))


def p10_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return selection.vocabulary_matches(docs, TERMS).groupBy("term", "query").agg(F.count("*").alias("n"))


def p11_bands(spark: SparkSession, d: str) -> DataFrame:
    vix = weekly_returns(spark, d).groupBy("asset").agg((100 * F.stddev_samp("r")).alias("vix"))
    h = metrics.hurst(panel.forward_fill(panel.densify(weekly(spark, d))))
    both = vix.join(h, "asset")
    sahm, inverted = selection.recession_bands(F.col("vix") / 100, F.col("hurst") - 0.01)
    return both.select(
        "asset", selection.vix_band(F.col("vix")).alias("vix_band"), selection.hurst_band(F.col("hurst")).alias("hurst_band"),
        selection.sentiment_band(F.col("hurst") - 0.1).alias("sentiment"), sahm.alias("recession"), inverted.alias("inverted"),
    )


def o02_ordered_results(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(selection.in_order(_results(spark, d), ["5-LOW", "3-MEDIUM", "1-URGENT"]))


def o01_price_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each asset's rows numbered in the order of their dates."""
    return _rounded(selection.first_rows(weekly(spark, d), ["asset"], [F.col("dt")], 1 << 30, "row"))


def o04_first_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").select("doc_id", "source")
    return selection.first_rows(docs, ["source"], [F.col("doc_id")], 3)


def o05_last_windows(spark: SparkSession, d: str) -> DataFrame:
    return forecast.expanding_windows(weekly(spark, d), LEAST, STEP, 5)


def o06_least_deviation(spark: SparkSession, d: str) -> DataFrame:
    """For every asset the portfolio window with the least and the one with the greatest return; the first wins a tie."""
    return _results(spark, d).groupBy("portfolio").agg(
        F.min_by("window", F.struct("period_return", "window")).alias("worst"), F.max_by("window", F.struct("period_return", -F.col("window"))).alias("best")
    )


def u02_distinct_union(spark: SparkSession, d: str) -> DataFrame:
    """Priorities of the first status' orders, then those of the others, each once, in order."""
    sets = _read(spark, d, "orders").groupBy("o_orderstatus").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
    both = sets.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("o_orderstatus", "p"))), lambda x: x["p"])).alias("p"))
    return both.select(F.posexplode(F.array_distinct("p")).alias("place", "asset"))


def u04_customers_without_orders(spark: SparkSession, d: str) -> DataFrame:
    missing = _read(spark, d, "customer").join(_read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return missing.groupBy("c_nationkey").agg(F.count("*").alias("n"))


def u05_universe(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "orders").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("universe"))


def a04_plain_summary(spark: SparkSession, d: str) -> DataFrame:
    by = _results(spark, d).groupBy("portfolio")
    return _rounded(by.agg(F.avg("period_return").alias("mean"), F.stddev_samp("period_return").alias("std"), F.max("period_return").alias("best")))


def a06_first_per_window(spark: SparkSession, d: str) -> DataFrame:
    """One figure per window (that of the first portfolio), averaged over windows."""
    first = selection.first_rows(_results(spark, d), ["window"], [F.col("portfolio")], 1)
    return _rounded(first.agg(F.avg("period_return").alias("mean"), F.count("*").alias("n")))


def a07_windows(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).groupBy("portfolio").agg(F.countDistinct("window").alias("n_windows"))


def a08_provider_counts(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").groupBy(F.col("source").alias("provider")).agg(F.count("*").alias("n"))


def m21_mase(spark: SparkSession, d: str) -> DataFrame:
    """Drift forecasts from every window's training end, scored over its test dates."""
    return _rounded(_mase(spark, d))


def _mase(spark: SparkSession, d: str) -> DataFrame:
    prices = weekly(spark, d)
    slices = selection.window_slices(prices, LEAST, STEP).filter("part = 1")
    step = F.row_number().over(metrics.Window.partitionBy("window", "asset").orderBy("dt")).alias("step")
    ahead = F.col("last") + F.col("drift") * F.col("step")
    scored = slices.select("window", "asset", step, "price").join(forecast.drift_states(prices, _windows(spark, d)), ["window", "asset"])
    error = scored.groupBy("window", "asset").agg(F.avg(F.abs(F.col("price") - ahead)).alias("mae"), F.first("scale").alias("scale"))
    return error.select("window", "asset", F.try_divide("mae", "scale").alias("mase"))


def a09_window_mase(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_mase(spark, d).groupBy("window").agg(F.avg("mase").alias("mase")))


def a11_sentiment(spark: SparkSession, d: str) -> DataFrame:
    scored = _read(spark, d, "lineitem").select(F.col("l_returnflag").alias("ticker"), ((F.col("l_discount") - 0.05) * 4).alias("score"))
    return _rounded(selection.sentiment_summary(scored, ["ticker"], 0.11))


def _last(spark: SparkSession, d: str) -> DataFrame:
    dates = _read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("asset")).agg(F.max(F.to_date("o_orderdate")).alias("dt"))
    return dates


def f03_future_dates(spark: SparkSession, d: str) -> DataFrame:
    parts = [fn.future_dates(_last(spark, d), HORIZON, f).select(F.lit(f).alias("frequency"), "*") for f in ("daily", "weekly", "monthly", "yearly")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def f04_dates(spark: SparkSession, d: str) -> DataFrame:
    """Event times as epoch seconds, compact stamps and RFC 822 dates, read back as ISO."""
    at = F.date_trunc("second", "ts")
    events = _read(spark, d, "events").select(
        "event_id", F.unix_seconds(at.cast("timestamp_ltz")).alias("epoch"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'").alias("compact"),
        F.concat(F.lit("Tue, "), F.date_format(at, "d MMM yyyy HH:mm:ss"), F.lit(" GMT")).alias("rfc"),
    )
    return events.select(
        "event_id", fn.iso_utc(F.timestamp_seconds("epoch")).alias("of_epoch"), fn.iso_of_compact(F.col("compact")).alias("of_compact"),
        fn.iso_of_rfc822(F.col("rfc")).alias("of_rfc822"), fn.iso_of_compact(F.col("rfc")).alias("of_other"),
        fn.session_date(F.col("epoch"), F.lit(None).cast("string")).alias("session"),
    )


def f07_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


def f08_json(spark: SparkSession, d: str) -> DataFrame:
    """A field of a JSON text, with a default where it is missing, and the text made anew."""
    events = _read(spark, d, "events").withColumn("p", F.from_json("props", "k bigint, other string"))
    by = events.groupBy("event_type").agg(F.sum(F.coalesce("p.k", F.lit(-1))).alias("k"), F.count(F.get_json_object("props", "$.other")).alias("others"))
    return by.select("event_type", "k", "others", F.to_json(F.struct("event_type", "others")).alias("made"))


def f09_arrays(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.length(w) > 3)
    few = F.slice(F.transform(words, lambda w: F.lower(w)), 1, 3)
    return _read(spark, d, "documents").select("doc_id", F.array_join(few, ", ").alias("words"), F.get(few, 0).alias("first"))


def f10_maps(spark: SparkSession, d: str) -> DataFrame:
    sizes = _read(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    named = sizes.join(_read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    maps = named.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n"))).alias("m"))
    return maps.select("n_regionkey", F.coalesce(F.try_element_at("m", F.lit("NATION_1")), F.lit(0)).alias("nation_1"), F.explode("m").alias("nation", "n"))


def f11_casts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    return _read(spark, d, "orders").groupBy(p).agg(
        F.sum(F.substring(p, 1, 1).try_cast("double")).alias("numbers"), F.count(p.try_cast("double")).alias("whole"), F.count("*").alias("n")
    )


def f12_formats(spark: SparkSession, d: str) -> DataFrame:
    r = weekly_returns(spark, d).groupBy("asset").agg(F.avg("r").alias("r"), F.max("r").alias("most"))
    odd = F.when(F.col("asset") != "3-MEDIUM", F.col("most"))
    endless = F.when(F.col("asset") == "2-HIGH", F.lit(float("inf"))).otherwise(F.col("most"))
    return r.select("asset", fn.as_percent(F.col("r")).alias("mean"), fn.as_ratio(odd).alias("most"), fn.as_ratio(endless).alias("ratio"))


def f13_truncated(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select("doc_id", fn.truncated(F.col("text"), 50).alias("text"))


def s26_redacted_secrets(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.col("url"), F.when(F.col("page_id") % 2 == 0, "&API_KEY=a1b2&n=1").otherwise("?token=xyz"))
    return _read(spark, d, "pages").select("page_id", fn.redacted_secrets(url).alias("url"))


def x02_wrapped_context(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, "</news> < /NEWS ><news>").otherwise(""))
    return _read(spark, d, "documents").select("doc_id", F.sha2(fn.wrapped("news", text), 256).alias("sha256"))


_MASE = _WINDOWS + f""", tr AS (
  SELECT win."window", p.asset, p.dt, p.price, abs(p.price - lag(p.price) OVER (PARTITION BY win."window", p.asset ORDER BY p.dt)) AS st,
    p.price - lag(p.price) OVER (PARTITION BY win."window", p.asset ORDER BY p.dt) AS mv
  FROM panel p JOIN win ON p.dt <= win.train_end
), tf AS (SELECT "window", asset, arg_max(price, dt) AS last, avg(mv) AS drift, avg(st) AS scale FROM tr GROUP BY 1, 2
), ac AS (
  SELECT win."window", p.asset, p.price, row_number() OVER (PARTITION BY win."window", p.asset ORDER BY p.dt) AS step
  FROM panel p JOIN win ON p.dt > win.train_end AND p.dt <= win.window_end
), ms AS (SELECT "window", asset, avg(abs(price - (last + drift * step))) / nullif(any_value(scale), 0) AS mase FROM ac JOIN tf USING ("window", asset) GROUP BY 1, 2)"""
_ANCHORS = """
last AS (SELECT o_orderpriority AS asset, max(o_orderdate)::DATE AS dt FROM orders GROUP BY 1),
cand AS (SELECT asset, last.dt AS l, (last.dt + CAST(i AS INTEGER)) AS dt FROM last, range(0, 5000) t(i)),
anchors AS (
  SELECT 'daily' AS frequency, asset, dt FROM cand WHERE isodow(dt) <= 5
  UNION ALL SELECT 'weekly', asset, dt FROM cand WHERE isodow(dt) = 5
  UNION ALL SELECT 'monthly', asset, dt FROM cand WHERE dt = last_day(dt)
  UNION ALL SELECT 'yearly', asset, dt FROM cand WHERE month(dt) = 12 AND day(dt) = 31)"""
_ISO = "strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S+00:00')"

ORACLE_SQL = {
    "p01_chosen_assets": f"""WITH {_PANEL} SELECT asset, dt, round(price, 6) AS price, CAST(CASE asset WHEN '5-LOW' THEN 0 ELSE 1 END AS INTEGER) AS place
FROM panel WHERE asset IN ('5-LOW', '1-URGENT')""",
    "p02_assets_with_prices": f"WITH {_PANEL} SELECT asset, dt, round(price, 6) AS price FROM panel WHERE asset <> '3-MEDIUM'",
    "p06_window_slices": f"""WITH {_WINDOWS} SELECT CAST(win."window" AS INTEGER) AS "window", CAST(CASE WHEN p.dt = train_end THEN 0 ELSE 1 END AS INTEGER) AS part, asset, dt, round(price, 6) AS price
FROM panel p JOIN win ON p.dt >= train_end AND p.dt <= window_end""",
    "p07_display_weights": f"""WITH {_PANEL}{_COV}, r AS (SELECT asset, mu, row_number() OVER (ORDER BY mu DESC, asset) AS k FROM mu),
w AS (SELECT asset, least(greatest(1 - (k - 1) * 0.35::DOUBLE, 0), 0.35::DOUBLE) AS w FROM r)
SELECT 'greatest' AS portfolio, asset, round(w, 6) AS w, CAST(row_number() OVER (ORDER BY abs(w) DESC, asset) AS INTEGER) AS place FROM w WHERE abs(w) > 0.001""",
    "p10_vocabulary": r"""SELECT term, query, count(*) AS n FROM documents, (VALUES
  ('data', 'data quality', '(^|[^a-z0-9_])data([^a-z0-9_]|$)'), ('the', 'definite articles', '(^|[^a-z0-9_])the([^a-z0-9_]|$)'),
  ('license', 'software licenses', '(^|[^a-z0-9_])license([^a-z0-9_]|$)'), ('cc by', 'open licenses', '(^|[^a-z0-9_])cc by([^a-z0-9_]|$)')) t(term, query, p)
WHERE regexp_matches(lower(text), p) GROUP BY 1, 2""",
    "p11_bands": f"""WITH {_PANEL}, numbered AS (SELECT asset, price, row_number() OVER (PARTITION BY asset ORDER BY dt) AS i FROM filled
), taus AS (
  SELECT a.asset, k.k, stddev_pop(b.price - a.price) AS tau FROM numbered a CROSS JOIN range(2, 20) k(k) JOIN numbered b ON b.asset = a.asset AND b.i = a.i + k.k GROUP BY 1, 2
), h AS (SELECT asset, regr_slope(ln(tau), ln(k)) AS h FROM taus GROUP BY asset), v AS (SELECT asset, 100 * stddev_samp(r) AS v FROM rets GROUP BY asset)
SELECT asset, CASE WHEN v < 15 THEN 'calm' WHEN v < 25 THEN 'normal' ELSE 'elevated' END AS vix_band,
  CASE WHEN h > 0.55 THEN 'trending' WHEN h < 0.45 THEN 'mean-reverting' ELSE 'random walk' END AS hurst_band,
  CASE WHEN h - 0.1 > 0.1 THEN 'bullish' WHEN h - 0.1 < -0.1 THEN 'bearish' ELSE 'neutral' END AS sentiment, v / 100 >= 0.5 AS recession, h - 0.01 < 0 AS inverted
FROM h JOIN v USING (asset)""",
    "o01_price_rows": f"WITH {_PANEL} SELECT asset, dt, round(price, 6) AS price, CAST(row_number() OVER (PARTITION BY asset ORDER BY dt) AS INTEGER) AS row FROM panel",
    "o02_ordered_results": f"""WITH {_WINDOWS}, o AS (SELECT * FROM (VALUES (0, '5-LOW'), (1, '3-MEDIUM'), (2, '1-URGENT')) t(ordinal, portfolio))
SELECT portfolio, "window", round(x, 6) AS period_return, CAST(ordinal AS INTEGER) AS ordinal,
  CAST(row_number() OVER (PARTITION BY ordinal ORDER BY "window") AS INTEGER) AS row FROM res JOIN o USING (portfolio)""",
    "o04_first_documents": """SELECT doc_id, source, CAST(place AS INTEGER) AS place FROM (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) WHERE place <= 3""",
    "o05_last_windows": f"""WITH {_WINDOWS} SELECT CAST(row_number() OVER (ORDER BY train_end) AS INTEGER) AS "window", train_end, window_end
FROM (SELECT * FROM win ORDER BY train_end DESC LIMIT 5)""",
    "o06_least_deviation": f"""WITH {_WINDOWS} SELECT portfolio, arg_min("window", (x, "window")) AS worst, arg_max("window", (x, -"window")) AS best FROM res GROUP BY portfolio""",
    "u02_distinct_union": """WITH s AS (SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders), f AS (SELECT p, min((s, p)) AS k FROM s GROUP BY p)
SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS place, p AS asset FROM f""",
    "u04_customers_without_orders": "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 1",
    "u05_universe": "SELECT string_agg(p, ',' ORDER BY p) AS universe FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)",
    "a04_plain_summary": f"""WITH {_WINDOWS} SELECT portfolio, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(max(x), 6) AS best FROM res GROUP BY 1""",
    "a06_first_per_window": f"""WITH {_WINDOWS}, f AS (SELECT "window", arg_min(x, portfolio) AS x FROM res GROUP BY 1) SELECT round(avg(x), 6) AS mean, count(*) AS n FROM f""",
    "a07_windows": f"""WITH {_WINDOWS} SELECT portfolio, count(DISTINCT "window") AS n_windows FROM res GROUP BY 1""",
    "a08_provider_counts": "SELECT source AS provider, count(*) AS n FROM documents GROUP BY 1",
    "m21_mase": f"""WITH {_MASE} SELECT CAST("window" AS INTEGER) AS "window", asset, round(mase, 6) AS mase FROM ms""",
    "a09_window_mase": f"""WITH {_MASE} SELECT CAST("window" AS INTEGER) AS "window", round(avg(mase), 6) AS mase FROM ms GROUP BY 1""",
    "a11_sentiment": """WITH s AS (SELECT l_returnflag AS ticker, (l_discount - 0.05::DOUBLE) * 4 AS s FROM lineitem)
SELECT ticker, round(avg(s), 6) AS score, round(100 * avg(CASE WHEN s > 0.11::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 6) AS bullish_pct,
  round(100 * avg(CASE WHEN s < -0.11::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 6) AS bearish_pct, count(*) AS n_articles FROM s GROUP BY 1""",
    "f03_future_dates": f"""WITH {_ANCHORS} SELECT frequency, asset, CAST(k - 1 AS INTEGER) AS step, dt FROM (
  SELECT *, row_number() OVER (PARTITION BY frequency, asset ORDER BY dt) AS k FROM anchors) WHERE k BETWEEN 2 AND {HORIZON + 1}""",
    "f04_dates": f"SELECT event_id, {_ISO} AS of_epoch, {_ISO} AS of_compact, {_ISO} AS of_rfc822, '' AS of_other, ts::DATE AS session FROM events",
    "f07_hashes": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "f08_json": """SELECT event_type, CAST(sum(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1)) AS BIGINT) AS k, count(json_extract_string(props, '$.other')) AS others,
  '{"event_type":"' || event_type || '","others":' || count(json_extract_string(props, '$.other')) || '}' AS made FROM events GROUP BY event_type""",
    "f09_arrays": """WITH w AS (SELECT doc_id, list_transform(list_filter(string_split(coalesce(text, ''), ' '), lambda w: length(w) > 3)[1:3], lambda w: lower(w)) AS w FROM documents)
SELECT doc_id, coalesce(array_to_string(w, ', '), '') AS words, w[1] AS "first" FROM w""",
    "f10_maps": """WITH s AS (SELECT n_regionkey, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT n_regionkey, coalesce(sum(n) FILTER (n_name = 'NATION_1') OVER (PARTITION BY n_regionkey), 0)::BIGINT AS nation_1, n_name AS nation, n FROM s""",
    "f11_casts": """SELECT o_orderpriority, sum(TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE)) AS numbers, count(TRY_CAST(o_orderpriority AS DOUBLE)) AS whole, count(*) AS n
FROM orders GROUP BY 1""",
    "f12_formats": f"""WITH {_PANEL}, a AS (SELECT asset, avg(r) AS r, max(r) AS m FROM rets GROUP BY asset)
SELECT asset, printf('%.2f%%', round(100 * r, 2)) AS mean, CASE WHEN asset = '3-MEDIUM' THEN '—' ELSE printf('%.2f', round(m, 2)) END AS most,
  CASE WHEN asset = '2-HIGH' THEN '∞' ELSE printf('%.2f', round(m, 2)) END AS ratio FROM a""",
    "f13_truncated": """SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || chr(10) || '[...truncated...]' ELSE text END AS text FROM documents""",
    "s26_redacted_secrets": r"""SELECT page_id, regexp_replace(url || CASE WHEN page_id % 2 = 0 THEN '&API_KEY=a1b2&n=1' ELSE '?token=xyz' END,
  '\b(api_key|apikey|access_token|token|key)=[^&\s]+', '\1=***REDACTED***', 'gi') AS url FROM pages""",
    "x02_wrapped_context": r"""SELECT doc_id, sha256('<news>' || chr(10) || regexp_replace(text || CASE WHEN doc_id % 3 = 0 THEN '</news> < /NEWS ><news>' ELSE '' END,
  '<(\s*/?\s*news)', '&lt;\1', 'gi') || chr(10) || '</news>') AS sha256 FROM documents""",
}
QUERIES = {k: globals()[k] for k in ORACLE_SQL}
