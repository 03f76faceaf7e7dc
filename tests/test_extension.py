"""SQL text with forecasts and metrics of the library."""

from __future__ import annotations

import datetime

import pytest

from panelwright.operators import extension, metrics, models, panel


def test_sql_gives_what_the_operators_give(spark):
    """Nulls, an asset without a price and a short history included."""
    extension.register(spark)
    start = datetime.date(2024, 1, 1)
    series = {"long": [100 + t * t % 17 for t in range(60)], "gaps": [None if t % 7 == 3 else 50.0 + t % 5 for t in range(50)], "short": [1.0, 2.0], "none": [None]}
    rows = [(a, start + datetime.timedelta(days=i), None if x is None else float(x)) for a, xs in series.items() for i, x in enumerate(xs)]
    prices = spark.createDataFrame(rows, "asset string, dt date, price double").repartition(7, "dt")
    prices.createOrReplaceTempView("some_prices")
    for model in ("naive", "theta", "ets"):
        got = spark.sql(f"SELECT * FROM price_forecast(TABLE(some_prices) PARTITION BY asset ORDER BY (dt), 5, '{model}')").collect()
        want = models.all_assets(prices, 5, model, told=True).collect()
        key = lambda r: (r["asset"], r["step"])
        assert len(got) == len(want) == 15
        assert [tuple(r) for r in sorted(got, key=key)] == [tuple(r) for r in sorted(want, key=key)]
    with pytest.raises(Exception, match="no forecast model"):
        spark.sql("SELECT * FROM price_forecast(TABLE(some_prices) PARTITION BY asset ORDER BY (dt), 5, 'nothing')").collect()
    panel.returns(prices.filter("price is not null")).filter("r is not null").createOrReplaceTempView("some_returns")
    got = {r["asset"]: r for r in spark.sql("SELECT asset, sharpe_ratio(r, 0.04D, 52) AS s, max_drawdown(r, dt) AS m FROM some_returns GROUP BY asset").collect()}
    for r in metrics.summarise(spark.table("some_returns"), None, 52, 0.04).collect():
        own = got.pop(r["asset"])
        assert own["m"] == pytest.approx(r["max_drawdown"]) and own["s"] == (None if r["sharpe_ratio"] is None else pytest.approx(r["sharpe_ratio"]))
    assert not got
