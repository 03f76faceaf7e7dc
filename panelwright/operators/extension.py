"""What a user adds to SQL: forecasts as a table function over partitions of a price table, metrics as aggregates of a group's returns.

    register(spark)
    spark.sql("SELECT * FROM price_forecast(TABLE(prices) PARTITION BY asset ORDER BY (dt), 12, 'theta')")
    spark.sql("SELECT asset, sharpe_ratio(r, 0.04, 52) FROM returns GROUP BY asset")
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from . import models


class PriceForecast:
    """The forecast of one partition, which is one asset's prices in order of date; below the least history, or where a fit fails, the drift."""

    def __init__(self) -> None:
        self.asset, self.prices, self.horizon, self.model = None, [], 0, "naive"

    def eval(self, row: Row, horizon: int, model: str) -> None:
        self.asset, self.horizon, self.model = row["asset"], horizon, model
        if row["price"] is not None and not np.isnan(row["price"]):
            self.prices.append(float(row["price"]))

    def terminate(self):
        if self.prices:
            centre, band, fitted = models.one_series(np.array(self.prices), self.horizon, *models.named(self.model))
            for i in range(self.horizon):
                yield self.asset, i + 1, float(centre[i]), float(centre[i] - band[i]), float(centre[i] + band[i]), fitted


def sharpe_ratio(r: pd.Series, rf: pd.Series, periods: pd.Series) -> float | None:
    """Annualised mean excess return over its deviation; null where that is 0."""
    n = int(periods.iloc[0])
    e = r.dropna() - ((1 + rf.iloc[0]) ** (1 / n) - 1)
    sd = e.std(ddof=1)
    return float(e.mean() / sd * n**0.5) if sd > 0 else None


def max_drawdown(r: pd.Series, dt: pd.Series) -> float | None:
    """The deepest fall of compounded returns, in order of date, below their peak so far (the start included)."""
    grown = np.cumprod(1 + r.iloc[np.argsort(dt.to_numpy(), kind="stable")].dropna().to_numpy(float))
    return float(min(0.0, (grown / np.maximum(np.maximum.accumulate(grown), 1.0) - 1).min())) if len(grown) else None


def register(spark: SparkSession) -> None:
    """Make ``price_forecast``, ``sharpe_ratio`` and ``max_drawdown`` known to the session's SQL."""
    forecast = F.udtf(PriceForecast, returnType="asset string, step int, forecast double, lower double, upper double, fitted boolean")
    spark.udtf.register("price_forecast", forecast)
    for f in (sharpe_ratio, max_drawdown):
        spark.udf.register(f.__name__, F.pandas_udf(f, "double"))
