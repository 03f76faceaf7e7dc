"""Performance metrics of return streams ``returns(asset, dt, r)`` as aggregates and running windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .moments import pair_moments


def periodic_rate(annual: float, periods: int) -> float:
    return (1 + annual) ** (1 / periods) - 1


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def annualised(growth: Column, n: Column, periods: int) -> Column:
    return F.when((n > 0) & (growth > 0), F.pow(growth, F.lit(float(periods)) / n) - 1)


def drawdowns(returns: DataFrame) -> DataFrame:
    """Adds wealth, its running peak (1 at least) and the drawdown."""
    w = Window.partitionBy("asset").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    wealth = returns.withColumn("wealth", F.product(1 + F.col("r")).over(w))
    peak = F.greatest(F.max("wealth").over(w), F.lit(1.0))
    return wealth.withColumn("drawdown", F.col("wealth") / peak - 1)


def summarise(returns: DataFrame, bench: DataFrame | None = None, periods: int = 52, rf: float = 0.04, level: float = 0.95) -> DataFrame:
    """All metrics of every asset; with ``bench(dt, rb)`` those relative to it as well, on shared dates.

    One shuffle by asset serves the windows and the aggregate.
    """
    rfp = periodic_rate(rf, periods)
    known = returns.filter("r is not null")
    tail = known.groupBy("asset").agg(F.percentile("r", F.lit(1 - level)).alias("var_q"))
    rows = drawdowns(known).join(tail, "asset")
    rows = rows.join(bench, "dt", "left") if bench is not None else rows.withColumn("rb", F.lit(None).cast("double"))
    r, rb, root = F.col("r"), F.col("rb"), float(periods) ** 0.5
    e, both = r - rfp, F.col("rb").isNotNull()
    agg = rows.groupBy("asset").agg(
        F.count("*").alias("n"), F.product(1 + r).alias("g"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"),
        F.avg(e).alias("e_mean"), F.stddev_samp(e).alias("e_sd"), F.sqrt(F.avg(F.pow(F.least(e, F.lit(0.0)), 2))).alias("down"),
        F.min("drawdown").alias("mdd"), F.sqrt(F.avg(F.pow(100 * F.col("drawdown"), 2))).alias("ulcer"),
        F.skewness(r).alias("g1"), F.kurtosis(r).alias("g2"), F.first("var_q").alias("var"),
        F.avg(F.when(r <= F.col("var_q"), r)).alias("cvar"),
        F.sum(F.greatest(e, F.lit(0.0))).alias("gains"), F.sum(F.greatest(-e, F.lit(0.0))).alias("losses"),
        F.sum(both.cast("int")).alias("nb"), F.product(F.when(both, 1 + r)).alias("gs"), F.product(1 + rb).alias("gb"),
        F.covar_samp(r, rb).alias("cov"), F.var_samp(F.when(both, rb)).alias("vb"),
        F.avg(r - rb).alias("a_mean"), F.stddev_samp(r - rb).alias("a_sd"),
    )
    n = F.col("n")
    ann, sharpe_p = annualised(F.col("g"), n, periods), _ratio(F.col("e_mean"), F.col("e_sd"))
    beta = F.when(F.col("nb") > 1, _ratio(F.col("cov"), F.col("vb")))
    mdd = F.col("mdd")
    out = {
        "period_return": F.col("g") - 1, "annual_return": ann, "annual_volatility": F.col("sd") * root, "sharpe_ratio": sharpe_p * root,
        "sharpe_se": F.when(n > 1, F.sqrt((1 + 0.5 * sharpe_p * sharpe_p) / n) * root), "sortino_ratio": _ratio(F.col("e_mean"), F.col("down")) * root,
        "calmar_ratio": _ratio(ann, F.abs(mdd)),
        "omega_ratio": F.when(F.col("losses") > 0, F.col("gains") / F.col("losses")).when(F.col("gains") > 0, F.lit(float("inf"))),
        "max_drawdown": mdd, "ulcer_index": F.col("ulcer"),
        "skewness": F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)),
        "kurtosis": F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)),
        "var_95": F.col("var"), "cvar_95": F.coalesce("cvar", "var"),
    }
    if bench is not None:
        nb = F.col("nb")
        out |= {
            "beta": beta, "information_ratio": _ratio(F.col("a_mean") * periods, F.col("a_sd") * root), "treynor_ratio": _ratio(ann - rf, beta),
            "jensens_alpha": annualised(F.col("gs"), nb, periods) - (rf + beta * (annualised(F.col("gb"), nb, periods) - rf)),
        }
    return agg.select("asset", F.col("n").alias("n_periods"), *(v.alias(k) for k, v in out.items()))


def portfolio_returns(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """``(portfolio, dt, r)`` at constant weights, on the dates given (use complete cases)."""
    held = returns.join(weights, "asset")
    return held.groupBy("portfolio", "dt").agg(F.sum(F.col("w") * F.col("r")).alias("r"))


def buy_and_hold(returns: DataFrame, weights: DataFrame, portfolio: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns of drifting holdings, and the weights at the end; if ``returns`` have a ``portfolio`` of their own, ``portfolio`` names that of ``weights``."""
    w = Window.partitionBy("portfolio", "asset").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    joined = returns.join(weights, "asset") if portfolio is None else returns.join(weights.withColumnRenamed(portfolio, "portfolio"), ["portfolio", "asset"])
    held = joined.withColumn("value", F.col("w") * F.product(1 + F.col("r")).over(w))
    by_date = held.groupBy("portfolio", "dt").agg(F.sum("value").alias("v"), F.sum("w").alias("start"))
    before = F.coalesce(F.lag("v").over(Window.partitionBy("portfolio").orderBy("dt")), "start")
    path = by_date.select("portfolio", "dt", (F.try_divide(F.col("v"), before) - 1).alias("r"))
    last = held.groupBy("portfolio", "asset").agg(F.max_by("value", "dt").alias("value"))
    total = F.sum("value").over(Window.partitionBy("portfolio"))
    return path, last.select("portfolio", "asset", F.try_divide(F.col("value"), total).alias("w"))


def turnover(new: DataFrame, old: DataFrame) -> DataFrame:
    """Sum of absolute weight changes over the union of both portfolios' assets."""
    both = new.select("portfolio", "asset", F.col("w").alias("w_new")).join(
        old.select("portfolio", "asset", F.col("w").alias("w_old")), ["portfolio", "asset"], "full_outer"
    )
    change = F.abs(F.coalesce("w_new", F.lit(0.0)) - F.coalesce("w_old", F.lit(0.0)))
    return both.groupBy("portfolio").agg(F.sum(change).alias("turnover"))


def charge_first_period(path: DataFrame, costs: DataFrame, bps: float) -> DataFrame:
    """The first period of each portfolio pays ``turnover * bps / 10,000``."""
    first = F.row_number().over(Window.partitionBy("portfolio").orderBy("dt")) == 1
    paid = (1 + F.col("r")) * (1 - F.col("turnover") * bps / 1e4) - 1
    return path.join(costs, "portfolio").withColumn("first", first).select("portfolio", "dt", F.when(F.col("first"), paid).otherwise(F.col("r")).alias("r"))


def correlation(returns: DataFrame) -> DataFrame:
    """``(asset_i, asset_j, corr)`` on pairwise complete dates, i <= j, from products of blocks of assets; null where either is constant there."""
    known = returns.filter("r is not null")
    # an asset's mean is taken off first, so that the sums of squares don't cancel
    centred = known.withColumn("x", F.col("r") - F.avg("r").over(Window.partitionBy("asset")))
    n = F.col("n")

    def spread(total: str, squares: str) -> Column:
        value = n * F.col(squares) - F.col(total) * F.col(total)
        return F.when(value > 1e-13 * n * F.col(squares), value)

    top = n * F.col("s") - F.col("sx") * F.col("sy")
    corr = F.try_divide(top, F.sqrt(spread("sx", "sxx")) * F.sqrt(spread("sy", "syy")))
    return pair_moments(centred, []).select("asset_i", "asset_j", corr.alias("corr"))


def rolling_sharpe(returns: DataFrame, window: int, periods: int = 52, rf: float = 0.04) -> DataFrame:
    """Sharpe ratio over the last ``window`` periods, null before that."""
    w = Window.partitionBy("asset").orderBy("dt").rowsBetween(1 - window, 0)
    e = F.col("r") - periodic_rate(rf, periods)
    full = F.count("r").over(w) == window
    return returns.select("asset", "dt", F.when(full, _ratio(F.avg(e).over(w), F.stddev_samp(e).over(w)) * float(periods) ** 0.5).alias("sharpe"))


def hurst(prices: DataFrame, max_lag: int = 20) -> DataFrame:
    """Slope of ln(deviation of k-step differences) on ln k, k = 2 .. max_lag - 1; null if too short or constant."""
    w, lags = Window.partitionBy("asset").orderBy("dt"), range(2, max_lag)
    steps = prices.select("asset", "price", *((F.col("price") - F.lag("price", k).over(w)).alias(f"d{k}") for k in lags))
    taus = steps.groupBy("asset").agg(F.count("price").alias("n"), *(F.stddev_pop(f"d{k}").alias(f"t{k}") for k in lags))
    long = taus.select("asset", "n", F.expr(f"stack({len(lags)}, {', '.join(f'{k}, t{k}' for k in lags)}) as (k, tau)"))
    slope = F.regr_slope(F.ln("tau"), F.ln(F.col("k").cast("double")))
    return long.groupBy("asset").agg(F.when((F.first("n") >= 2 * max_lag) & (F.min("tau") > 0), slope).alias("hurst"))


def mase(train: DataFrame, scored: DataFrame) -> DataFrame:
    """Mean absolute error of ``scored(asset, actual, forecast)`` over the mean absolute step of ``train``."""
    step = F.abs(F.col("price") - F.lag("price").over(Window.partitionBy("asset").orderBy("dt")))
    scale = train.withColumn("step", step).groupBy("asset").agg(F.avg("step").alias("scale"))
    error = scored.groupBy("asset").agg(F.avg(F.abs(F.col("actual") - F.col("forecast"))).alias("mae"))
    return error.join(scale, "asset").select("asset", _ratio(F.col("mae"), F.col("scale")).alias("mase"))
