"""Walk-forward comparison: portfolios optimised from history, from forecasts and in hindsight, held over each test window.

Windows are a key of every table, so all of them are estimated side by side; only the solver runs in a group of one window and
method, whose rows are a matrix of its assets. What links windows, the cost of moving from the drifted weights of the window before, is a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import factors, forecast, metrics, models, moments, optimise, panel
from .panel import written

#: Portfolio types in their order (fixed values).
HISTORICAL, FORECAST, REALIZED = "Historical-based", "Forecast-based", "Realized-optimal"
ORDER = [HISTORICAL, FORECAST, REALIZED]

_KEY = ["window", "asset"]


def _ledoit_wolf(returns: DataFrame, periods: int, factors_: int) -> DataFrame:
    return moments.ledoit_wolf(returns, periods, ("window",))


def _principal(returns: DataFrame, periods: int, factors_: int) -> DataFrame:
    """Windows of one asset have no factor, but their variance."""
    alone = returns.groupBy("window").agg(F.countDistinct("asset").alias("n")).filter("n = 1").select("window")
    single, rest = returns.join(alone, "window", "left_semi"), written(returns.join(alone, "window", "left_anti"), "complete")
    own = single.groupBy("window", F.col("asset").alias("asset_i"), F.col("asset").alias("asset_j")).agg((F.var_samp("r") * periods).alias("cov"))
    return own if rest.isEmpty() else factors.pca_covariance(rest, factors_, periods, ("window",)).unionByName(own)


#: Covariance estimators of complete returns ``(window, asset, dt, r)``, by name: periods a year and number of factors in, ``(window, asset_i, asset_j, cov)`` out.
COVARIANCES: dict[str, Callable[[DataFrame, int, int], DataFrame]] = {"ledoit_wolf": _ledoit_wolf, "pca_factor": _principal}
#: The covariance that only the forecast-based portfolio may have.
GARCH = "garch"


def _keyed(rows: DataFrame) -> DataFrame:
    """``window`` and ``asset`` as one asset, for operators that know assets only."""
    return rows.withColumn("asset", F.struct(*_KEY)).drop("window")


def _unkeyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("window", F.col("asset.window")).withColumn("asset", F.col("asset.asset"))


def _asset_returns(prices: DataFrame) -> DataFrame:
    return _unkeyed(panel.returns(_keyed(prices))).select("window", "asset", "dt", "r").filter("r is not null")


def _window_returns(prices: DataFrame) -> DataFrame:
    """``(window, asset, dt, r)`` of complete dates, the first of which has none."""
    r = _asset_returns(prices)
    assets = r.groupBy("window").agg(F.countDistinct("asset").alias("n"))
    whole = r.groupBy("window", "dt").agg(F.count("*").alias("held")).join(assets, "window").filter("held = n").select("window", "dt")
    return r.join(whole, ["window", "dt"], "left_semi")


def memberships(prices: DataFrame, windows: DataFrame, horizon: int) -> DataFrame:
    """``(dt, window, is_train, is_test)``: the windows that each date of the panel belongs to, for training or as test (its anchor included).

    Training ends ``horizon`` dates apart, so a date's number tells its windows; both tables have a row a date at most.
    """
    at = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("dt"))
    calendar = prices.select("dt").distinct().select("dt", at.alias("i"))
    first = windows.filter("window = 1").join(calendar, calendar["dt"] == windows["train_end"]).select(F.col("i").alias("first"), F.lit(1).alias("one"))
    last = windows.agg(F.max("window").alias("last"), F.lit(1).alias("one"))
    dates = calendar.withColumn("one", F.lit(1)).join(F.broadcast(first.join(last, "one")), "one")
    ahead = F.col("i") - F.col("first")
    tested = F.greatest(F.lit(1), F.ceil(ahead / horizon).cast("int"))  # the first that ends with or after it
    inside = dates.filter(tested <= F.col("last")).select("dt", "i", "first", "last", F.explode(F.sequence(tested, F.col("last"))).alias("window"))
    end = F.col("first") + (F.col("window") - 1) * horizon
    marked = inside.select("dt", "window", (F.col("i") <= end).alias("is_train"), F.col("i").between(end, end + horizon).alias("is_test"))
    return marked.filter("is_train or is_test")


def slices(prices: DataFrame, least: int, horizon: int, most: int | None = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training rows, test rows with their anchor date, both ``(window, asset, dt, price)`` of assets with ``least`` training prices, and the windows.

    ``most`` keeps the last windows; without it there are as many as the panel has room for.
    """
    windows = written(forecast.expanding_windows(prices, least, horizon, most), "windows")
    inside = prices.filter("price is not null").join(memberships(prices, windows, horizon), "dt")
    train = inside.filter("is_train").select(*_KEY, "dt", "price")
    held = train.groupBy(*_KEY).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(*_KEY)
    test = inside.filter("is_test").select(*_KEY, "dt", "price")
    # every estimate starts from these rows
    return written(train.join(held, _KEY, "left_semi"), "train"), written(test.join(held, _KEY, "left_semi"), "test"), windows


def estimates(
    train: DataFrame, test: DataFrame, horizon: int, periods: int, forecaster: Callable[[DataFrame, int], DataFrame] | str,
    covariance: str = "ledoit_wolf", forecast_covariance: str | None = None, n_factors: int = 10,
) -> DataFrame:
    """``(window, portfolio, asset_i, asset_j, mu_i, cov)``: the problem of each portfolio type of each window.

    ``covariance`` names one of ``COVARIANCES``; the forecast-based portfolio has the same one, or that of ``forecast_covariance`` (one of them, or ``GARCH``).
    """
    if covariance not in COVARIANCES or forecast_covariance not in (None, GARCH, *COVARIANCES):
        raise ValueError(f"no covariance {covariance} or {forecast_covariance}")
    past, future = written(_window_returns(train), "past"), written(_window_returns(test), "future")
    cov, cov_test = (written(COVARIANCES[covariance](r, periods, n_factors), "cov") for r in (past, future))
    if forecast_covariance == GARCH:
        cov_ahead = models.garch_covariance(_asset_returns(train), past, horizon, periods, ("window",))
    else:
        cov_ahead = COVARIANCES[forecast_covariance](past, periods, n_factors) if forecast_covariance else cov
    mu, mu_test = (moments.historical_mu(r, periods, ("window",)) for r in (past, future))
    keyed = _keyed(train)
    ahead = _forecasts(keyed, horizon, forecaster)
    mu_forecast = _unkeyed(forecast.forecast_mu(keyed, ahead, periods)).select(*_KEY, "mu")
    parts = [(HISTORICAL, mu, cov), (FORECAST, mu_forecast, cov_ahead), (REALIZED, mu_test, cov_test)]
    out = [written(optimise.problems(m, c, ["window"]).withColumn("portfolio", F.lit(name)), "problem") for name, m, c in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _forecasts(keyed: DataFrame, horizon: int, forecaster: Callable[[DataFrame, int], DataFrame] | str) -> DataFrame:
    """Forecasts of windowed assets, by a function of prices or by the name of a model."""
    if not isinstance(forecaster, str):
        return forecaster(keyed, horizon)
    rows = _unkeyed(keyed).select(*_KEY, "dt", "price")
    return _keyed(models.all_assets(rows, horizon, forecaster, ("window",)))


def window_mase(train: DataFrame, test: DataFrame, horizon: int, forecaster: Callable[[DataFrame, int], DataFrame] | str) -> DataFrame:
    """``(window, forecast_mase)``: the forecast's scaled error, averaged over the window's assets."""
    place = F.row_number().over(Window.partitionBy(*_KEY).orderBy("dt")) - 1
    actual = _keyed(test.withColumn("step", place).filter("step > 0")).select("asset", "step", F.col("price").alias("actual"))
    keyed = _keyed(train)
    scored = actual.join(_forecasts(keyed, horizon, forecaster), ["asset", "step"])
    return _unkeyed(metrics.mase(keyed, scored)).groupBy("window").agg(F.avg("mase").alias("forecast_mase"))


def held_with_costs(test: DataFrame, weights: DataFrame, bps: float) -> tuple[DataFrame, DataFrame]:
    """``(portfolio, dt, r)`` and ``(window, portfolio, turnover)``: weights bought at each window's start and held; the first period
    pays for the move from the drifted weights of the portfolio's window before, in the first window from cash. In the paths ``portfolio`` is a struct with the window."""
    keyed = weights.select(F.struct("window", "portfolio").alias("portfolio"), "asset", "w", "window")
    rows = _window_returns(test)
    path, drifted = metrics.buy_and_hold(rows.join(keyed, ["window", "asset"]).select("portfolio", "asset", "dt", "r"), keyed.select(F.col("portfolio").alias("p"), "asset", "w"), "p")
    order = weights.select("window", "portfolio").distinct()
    before = order.withColumn("next", F.lead("window").over(Window.partitionBy("portfolio").orderBy("window"))).filter("next is not null")
    old = drifted.select(F.col("portfolio.window").alias("window"), F.col("portfolio.portfolio").alias("portfolio"), "asset", "w").join(before, ["window", "portfolio"])
    old = old.select(F.struct(F.col("next").alias("window"), "portfolio").alias("portfolio"), "asset", "w")
    costs = metrics.turnover(keyed.select("portfolio", "asset", "w"), old)
    return metrics.charge_first_period(path, costs, bps), costs


def walk_forward(
    prices: DataFrame, least: int, horizon: int, most: int | None = 5, cap: float = 1.0, short: bool = False, rf: float = 0.04, periods: int = 52, bps: float = 10.0,
    forecaster: Callable[[DataFrame, int], DataFrame] | str = forecast.naive_drift, covariance: str = "ledoit_wolf", forecast_covariance: str | None = None, n_factors: int = 10,
) -> DataFrame:
    """One row for each window and portfolio type, with the window's end, assets and forecast error and the held portfolio's metrics."""
    train, test, windows = slices(prices, least, horizon, most)
    problem = estimates(train, test, horizon, periods, forecaster, covariance, forecast_covariance, n_factors)
    weights = optimise.max_sharpe(problem, ["window", "portfolio"], cap, short, rf)
    weights = written(weights, "weights")
    path = written(held_with_costs(test, weights, bps)[0], "path")
    perf = metrics.summarise(path.select(F.col("portfolio").alias("asset"), "dt", "r"), None, periods, rf)
    n_assets = weights.groupBy("window").agg(F.countDistinct("asset").alias("n_assets"))
    rest = [c for c in perf.columns if c != "asset"]
    out = perf.select(F.col("asset.window").alias("window"), F.col("asset.portfolio").alias("portfolio"), *rest)
    return out.join(windows.select("window", "window_end"), "window").join(n_assets, "window").join(window_mase(train, test, horizon, forecaster), "window", "left")


def sharpe_gaps(results: DataFrame) -> DataFrame:
    """``(window, gap, ceiling)``: how far the forecast's Sharpe ratio is above the historical one and below the realized one."""
    of = lambda name: F.max(F.when(F.col("portfolio") == name, F.col("sharpe_ratio")))
    by = results.groupBy("window").agg(of(HISTORICAL).alias("h"), of(FORECAST).alias("f"), of(REALIZED).alias("z"))
    return by.select("window", (F.col("f") - F.col("h")).alias("gap"), (F.col("z") - F.col("f")).alias("ceiling"))
