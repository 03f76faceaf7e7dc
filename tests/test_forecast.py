"""Hand-worked cases of the forecasts, windows and text preparation."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import forecast, models, recurrent, retrieval


def _prices(spark, series: dict):
    start = datetime.date(2024, 1, 1)
    rows = [(a, start + datetime.timedelta(days=i), x) for a, xs in series.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "asset string, dt date, price double")


def test_theta_of_a_line_carries_half_of_its_slope(spark):
    got = models.all_assets(_prices(spark, {"line": [100 + 0.5 * t for t in range(150)], "two": [1.0, 2.0]}), 4, "theta").collect()
    line = sorted((r["step"], r["forecast"]) for r in got if r["asset"] == "line")
    assert [x for _, x in line] == pytest.approx([174.5 + 0.25 * h for h in range(1, 5)], abs=1e-3)
    # too short a history: the drift
    assert sorted(r["forecast"] for r in got if r["asset"] == "two") == pytest.approx([3.0, 4.0, 5.0, 6.0])


def test_drift_skips_nulls_and_needs_no_second_price(spark):
    got = {(r["asset"], r["step"]): r for r in forecast.naive_drift(_prices(spark, {"a": [1.0, None, 3.0, 5.0], "b": [7.0], "c": [None]}), 2).collect()}
    assert got["a", 2]["forecast"] == pytest.approx(9.0) and got["a", 2]["lower"] == pytest.approx(9.0)
    assert got["b", 2]["forecast"] == 7.0 and ("c", 1) not in got


def test_windows_are_numbered_from_one_and_may_be_none(spark):
    prices = _prices(spark, {"a": [float(i) for i in range(1, 31)]})
    assert [r["window"] for r in forecast.expanding_windows(prices, 10, 5).orderBy("window").collect()] == [1, 2, 3, 4]
    last = forecast.expanding_windows(prices, 10, 5, most=2).orderBy("window").collect()
    assert [(r["window"], r["window_end"].day) for r in last] == [(1, 25), (2, 30)]
    assert forecast.expanding_windows(prices, 40, 5).count() == 0


def test_win_rate_counts_a_missing_value_as_a_loss(spark):
    rows = [(1, "x", 2.0), (1, "y", 1.0), (2, "x", None), (2, "y", 1.0), (3, "x", 3.0)]
    results = spark.createDataFrame(rows, "window int, portfolio string, m double")
    assert forecast.win_rate(results, "x", "y", "m").first()["win_rate"] == pytest.approx(1 / 3)
    assert forecast.win_rate(results, "x", "z", "m").first()["win_rate"] is None
    single = forecast.summary_of_windows(results.filter("window = 3"), ["m"]).first()
    assert (single["m_mean"], single["m_std"]) == (3.0, 0.0)


def test_retrieval_finds_the_named_symbol_and_nothing_without_shared_terms(spark):
    texts = [(1, "NVDA raises its outlook"), (2, "AAPL opens a new store"), (3, None), (4, "")]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string")
    assert [r["chunk_id"] for r in retrieval.similar_chunks(chunks, "what of NVDA outlook", 3).collect()] == [1]
    assert retrieval.similar_chunks(chunks, "zzz", 3).count() == 0
    assert retrieval.similar_chunks(chunks, "a new store", 3, stop_words=["new", "store"]).count() == 0


def test_titles_and_verdicts(spark):
    rows = spark.createDataFrame([(1, "A  b", "x"), (2, "a B", None), (3, "", "y"), (4, None, "z")], "i int, title string, description string")
    assert sorted(r["i"] for r in retrieval.first_of_each_title(rows, "title", "i").collect()) == [1, 3, 4]
    made = [r[0] for r in rows.orderBy("i").select(retrieval.chunk_text(F.col("title"), F.col("description"))).collect()]
    assert made == ["A  b. x", "a B.", None, None]
    judged = spark.createDataFrame([("**PASS** fine",), ("FAIL",), ("passing",), (None,)], "verdict string")
    assert retrieval.verdict_rate(judged).first().asDict() == {"n": 4, "pass_rate": 0.25}


def test_models_follow_a_line_and_fall_back(spark):
    line = [100 + 0.5 * t for t in range(120)]
    for name in ("ets", "arima"):
        got = sorted((r["step"], r["forecast"]) for r in models.all_assets(_prices(spark, {"a": line}), 3, name).collect())
        assert [x for _, x in got] == pytest.approx([160.0, 160.5, 161.0], abs=0.1), name
    short = _prices(spark, {"a": line[:20], "b": [None, 3.0]})
    drift = {(r["asset"], r["step"]): r["forecast"] for r in forecast.naive_drift(short, 2).collect()}
    for name in models.FORECASTERS:
        assert {(r["asset"], r["step"]): pytest.approx(r["forecast"]) for r in models.all_assets(short, 2, name).collect()} == drift
    models.register("flat", lambda y, h: (np.full(h, y[-1]), np.zeros(h)))
    assert {r["forecast"] for r in models.all_assets(_prices(spark, {"a": line}), 3, "flat").collect()} == {line[-1]}
    del models.FORECASTERS["flat"]


def test_unit_roots_and_volatility():
    rng = np.random.default_rng(2)
    noise, walk = rng.normal(size=400), np.cumsum(rng.normal(size=400))
    assert models.unit_root(noise)[1] < 0.01 and models.unit_root(walk)[1] > 0.1 and models.unit_root(noise[:19]) is None
    assert models.unit_root_p(-2.86) == pytest.approx(0.05, abs=1e-3) and models.unit_root_p(-3.43) == pytest.approx(0.01, abs=1e-3)
    r = rng.normal(0, 0.015, 600)
    assert models.garch_variance(r, 10) ** 0.5 == pytest.approx(0.015, rel=0.15) and models.garch_variance(r[:99], 10) is None
    calm = np.concatenate([r, 0.3 * r])
    assert models.garch_variance(calm, 5) < 0.5 * calm.var()


@pytest.mark.parametrize(("ar", "ma"), [([0.6], []), ([0.5, -0.3], [0.4]), ([], [0.7, 0.2]), ([0.2, 0.1, -0.4], [0.5, 0.3, -0.2])])
def test_likelihood_is_that_of_the_whole_covariance(ar, ma):
    """The filter's likelihood, forecasts and their errors against the Gaussian law of 60 points and the 5 after them."""
    ar, ma = np.array(ar), np.array(ma)
    rng, psi = np.random.default_rng(6), [1.0]
    for j in range(1, 400):
        psi.append((ma[j - 1] if j <= len(ma) else 0.0) + sum(a * psi[j - k - 1] for k, a in enumerate(ar) if j > k))
    psi = np.array(psi)
    lags = np.array([psi[: 400 - k] @ psi[k:] for k in range(65)])
    cov = lags[np.abs(np.subtract.outer(range(65), range(65)))]
    x = np.linalg.cholesky(cov)[:60, :60] @ rng.normal(size=60)
    own = cov[:60, :60]
    variance = x @ np.linalg.solve(own, x) / 60
    want = -0.5 * (60 * np.log(2 * np.pi * variance) + np.linalg.slogdet(own)[1] + 60)
    assert models.likelihood(x, ar, ma) == pytest.approx((want, variance), rel=1e-8)
    _, _, state = models.innovations(x, ar, ma)
    move, _ = models._state(ar, ma)
    got = [(np.linalg.matrix_power(move, h) @ state)[0] for h in range(5)]
    assert got == pytest.approx(list(cov[60:, :60] @ np.linalg.solve(own, x)), abs=1e-8)


def test_arima_finds_the_order_of_its_process():
    rng, x = np.random.default_rng(8), [0.0]
    for e in rng.normal(size=400):
        x.append(0.7 * x[-1] + e)
    y = 100 + np.cumsum(x)
    centre, band = models.arima(y, 6)
    # an AR(1) of the steps: each is about 0.7 of the one before
    steps = np.diff(np.concatenate([[y[-1]], centre]))
    assert steps == pytest.approx(list(x[-1] * 0.7 ** np.arange(1, 7)), abs=0.35) and (np.diff(band) > 0).all()
    assert band[0] == pytest.approx(1.96, rel=0.1)


def test_network_gradient_and_forecast(spark):
    rng = np.random.default_rng(9)
    x, y, w = rng.normal(size=(7, 5)), rng.normal(size=7), recurrent.fresh(4, seed=1)
    _, grads = recurrent.gradient(w, x, y)
    for name, weights in w.items():
        for at in np.ndindex(weights.shape):
            old, losses = weights[at], []
            for d in (1e-5, -1e-5):
                weights[at] = old + d
                losses.append(recurrent.gradient(w, x, y)[0])
            weights[at] = old
            assert grads[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=1e-7), (name, at)
    swing = (100 + 5 * np.sin(np.arange(160) / 3)).tolist()
    prices = _prices(spark, {"swing": swing, "short": swing[:80]})
    first, again = ([tuple(r) for r in models.all_assets(prices, 4, "lstm", told=True).orderBy("asset", "step").collect()] for _ in range(2))
    assert first == again and [r[-1] for r in first] == [False] * 4 + [True] * 4
    drift = {(r["asset"], r["step"]): r["forecast"] for r in forecast.naive_drift(prices, 4).collect()}
    ahead = 100 + 5 * np.sin(np.arange(160, 164) / 3)
    for asset, step, centre, low, high, fitted in first:
        assert low < centre < high and (centre == pytest.approx(drift[asset, step])) != fitted
        assert not fitted or centre == pytest.approx(ahead[step - 1], abs=2)
