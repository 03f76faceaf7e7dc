"""Optimised portfolios against their optimality conditions, and the walk-forward comparison on a hand-made panel."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from oracle import DATA, compare, connect

from panelwright.operators import backtest, factors, optimise, panel, selection
from panelwright.queries import ORACLE_SQL, QUERIES


def _problems():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n = int(rng.integers(1, 12))
        f = rng.normal(size=(n, n))
        yield rng.uniform(-0.05, 0.2, n), f @ f.T / n + 1e-4 * np.eye(n), bool(rng.random() < 0.3), float(rng.choice([1.0, 0.35, 0.5, 0.2]))


def test_critical_line_meets_the_optimality_conditions():
    for mu, cov, short, cap in _problems():
        low, high = optimise.bounds(cap, short, len(mu))
        points = optimise.turning_points(mu, cov, low, high)
        for lam in (0, 0.01, 0.1, 0.5, 2):
            w = optimise.at_lambda(points, lam)
            assert abs(w.sum() - 1) < 1e-8 and (w >= low - 1e-8).all() and (w <= high + 1e-8).all()
            gradient = cov @ w - lam * mu
            # no weight that may fall has a greater gradient than one that may rise
            assert gradient[w > low + 1e-7].max(initial=-9) <= gradient[w < high - 1e-7].min(initial=9) + 1e-6


def test_greatest_sharpe_ratio_is_the_frontiers_best():
    for mu, cov, _, cap in _problems():
        low, high = optimise.bounds(cap, False, len(mu))
        points = optimise.turning_points(mu, cov, low, high)
        sharpe = lambda w: (mu @ w - 0.04) / np.sqrt(w @ cov @ w)  # noqa: B023, E731
        w = optimise.greatest_sharpe(points, mu, cov, 0.04)
        if mu @ points[0][1] > 0.04:
            tried = [optimise.at_return(points, mu, r)[1] for r in np.linspace(mu @ points[-1][1], mu @ points[0][1], 200)]
            assert sharpe(w) >= max(map(sharpe, tried)) - 1e-9
        else:
            assert w == pytest.approx(optimise.least_variance(points))


def test_updates_agree_with_an_inverse():
    rng = np.random.default_rng(3)
    f = rng.normal(size=(60, 60))
    cov = f @ f.T / 60 + 1e-3 * np.eye(60)
    free = optimise._Free(cov, 0)
    for step in range(1, 400):
        if len(free.assets) < 2 or (rng.random() < 0.6 and len(free.assets) < 60):
            free.enter(int(rng.choice(np.setdiff1d(np.arange(60), free.assets))))
        else:
            free.leave(int(rng.integers(len(free.assets))))
        assert np.allclose(free.inverse, np.linalg.inv(cov[np.ix_(free.assets, free.assets)]), rtol=1e-6, atol=1e-8), step


def test_every_frontier_point_meets_its_conditions():
    for mu, cov, short, cap in _problems():
        low, high = optimise.bounds(cap, short, len(mu))
        points, held = optimise.line(mu, cov, low, high)
        for r in np.linspace(mu @ points[-1][1], mu @ points[0][1], 25):
            lam, w = optimise.at_return(points, mu, r)
            assert mu @ w == pytest.approx(r, abs=1e-9) and optimise.kkt(mu, held, low, high, lam, w) < 1e-6


def test_degenerate_problems_have_portfolios(spark):
    """Equal assets, no variance at all, more assets than dates, means below the risk-free rate; what isn't a number has null weights."""
    few = np.random.default_rng(2).normal(size=(3, 8)) / 50
    cases = {
        "equal": (np.full(4, 0.1), np.full((4, 4), 0.04)), "still": (np.array([0.01, 0.02, 0.03]), np.zeros((3, 3))),
        "few": (few.mean(0) * 52, np.cov(few.T)), "low": (np.full(3, -0.2), np.diag([0.04, 0.01, 0.09])), "one": (np.array([0.1]), np.zeros((1, 1))),
        "nan": (np.array([np.nan, 0.1]), np.eye(2)),
    }
    rows = [(p, f"a{i}", f"a{j}", float(mu[i]), float(cov[i, j])) for p, (mu, cov) in cases.items() for i in range(len(mu)) for j in range(len(mu))]
    problem = spark.createDataFrame(rows, "portfolio string, asset_i string, asset_j string, mu_i double, cov double")
    for cap, short in ((1.0, False), (0.5, False), (0.6, True)):
        got = {}
        for r in optimise.max_sharpe(problem, ["portfolio"], cap, short).collect():
            got.setdefault(r["portfolio"], []).append(r["w"])
        assert got.pop("nan") == [None, None]
        assert {p: pytest.approx(1, abs=1e-4) for p in got} == {p: sum(w) for p, w in got.items()}
        assert max(x for w in got.values() if len(w) > 1 for x in w) <= cap + 1e-5
        points = optimise.frontier(problem, ["portfolio"], cap, short).collect()
        assert {r["portfolio"] for r in points} == set(cases) - {"nan"} and max(r["kkt"] for r in points) < 1e-6
    least = [r["w"] for r in optimise.max_sharpe(problem.filter("portfolio = 'low'"), ["portfolio"]).orderBy("asset").collect()]
    inverse = np.array([1 / 0.04, 1 / 0.01, 1 / 0.09])
    assert least == pytest.approx(list(inverse / inverse.sum()), abs=1e-4)


def test_frontier_rises_and_degenerates(spark):
    rows = [(p, f"a{i}", f"a{j}", 0.05 * i if p == "x" else 0.1, 0.04 * (1 + i) if i == j else 0.005) for p in "xy" for i in range(3) for j in range(3)]
    problem = spark.createDataFrame(rows, "portfolio string, asset_i string, asset_j string, mu_i double, cov double")
    out = optimise.frontier(problem, ["portfolio"]).orderBy("point").collect()
    x = [(r["expected_return"], r["volatility"]) for r in out if r["portfolio"] == "x"]
    assert len(x) == 25 and x == sorted(x) and sorted(v for _, v in x) == [v for _, v in x]
    assert sum(r["portfolio"] == "y" for r in out) == 1
    capped = optimise.max_sharpe(problem, ["portfolio"], 0.2).collect()
    assert {r["w"] for r in capped} == {0.33333}


@pytest.fixture(scope="module")
def late_panel(spark):
    rng = np.random.default_rng(1)
    days = [datetime.date(2023, 1, 1) + datetime.timedelta(days=i) for i in range(400)]
    rows = []
    for k, asset in enumerate(["AAA", "BBB", "CCC"]):
        path = 100 * np.cumprod(1 + rng.normal(3e-4 * (k + 1), 0.01, 400))
        rows += [(asset, day, float(p)) for i, (day, p) in enumerate(zip(days, path, strict=True)) if asset != "CCC" or i >= 150]
    return days, rows, spark.createDataFrame(rows, "asset string, dt date, price double")


@pytest.mark.parametrize("model", [None, "theta"])
@pytest.mark.parametrize("covariance", ["ledoit_wolf", "pca_factor", backtest.GARCH])
def test_walk_forward_with_a_late_listed_asset(late_panel, covariance, model):
    _, _, prices = late_panel
    chosen = {"forecast_covariance": covariance} if covariance == backtest.GARCH else {"covariance": covariance}
    chosen |= {"forecaster": model} if model else {}
    out = backtest.walk_forward(prices, 90, 60, 5, periods=252, bps=10.0, **chosen).orderBy("window").collect()
    assert len(out) == 15 and {r["portfolio"] for r in out} == set(backtest.ORDER)
    assert [r["n_assets"] for r in out if r["portfolio"] == backtest.REALIZED] == [2, 2, 2, 3, 3]
    assert {r["n_periods"] for r in out} == {60} and all(r["forecast_mase"] > 0 for r in out)


def test_costs_follow_the_drifted_weights(spark, late_panel):
    """The first window is bought from cash: it costs bps of 1."""
    days, rows, prices = late_panel
    train, test, _ = backtest.slices(prices, 90, 60, 5)
    weights = spark.createDataFrame([(w, "p", a, 0.5) for w in (1, 2) for a in ("AAA", "BBB")], "window int, portfolio string, asset string, w double")
    _, costs = backtest.held_with_costs(test, weights, 10.0)
    paid = {r["portfolio"]["window"]: r["turnover"] for r in costs.collect()}
    by = {(a, d): p for a, d, p in rows}
    grown = [by[a, days[149]] / by[a, days[89]] for a in ("AAA", "BBB")]
    assert paid[1] == pytest.approx(1.0) and paid[2] == pytest.approx(abs(grown[0] / sum(grown) - 0.5) * 2)


@pytest.mark.parametrize("most", [1, 4, 12, None])
def test_every_date_is_in_its_windows(late_panel, most):
    """As many windows as there is room for."""
    days, rows, prices = late_panel
    train, test, windows = backtest.slices(prices, 90, 20, most)
    ends = [i for i in range(90, 400, 20) if i + 20 <= 400]
    ends = ends[-most:] if most else ends
    known = {(a, d) for a, d, _ in rows}
    long = {(w, a) for w, e in enumerate(ends, 1) for a in ("AAA", "BBB", "CCC") if sum((a, d) in known for d in days[:e]) >= 90}
    assert windows.count() == len(ends)
    assert {(r.window, r.asset, r.dt) for r in train.collect()} == {(w, a, d) for w, a in long for d in days[: ends[w - 1]] if (a, d) in known}
    assert {(r.window, r.asset, r.dt) for r in test.collect()} == {(w, a, d) for w, a in long for d in days[ends[w - 1] - 1 : ends[w - 1] + 20] if (a, d) in known}


def test_principal_factors_match_a_decomposition(spark):
    """Three factors and noise, two windows of unlike assets; no group holds the matrix."""
    rng, rows, want = np.random.default_rng(4), [], {}
    for window, n, t in ((1, 50, 200), (2, 4, 30)):
        r = rng.normal(size=(t, 3)) @ rng.uniform(0.3, 1.2, (3, n)) / 100 + rng.normal(size=(t, n)) * 0.003
        rows += [(window, f"a{j:02d}", datetime.date(2024, 1, 1) + datetime.timedelta(days=i), float(r[i, j])) for i in range(t) for j in range(n)]
        s = np.cov(r.T)
        values, vectors = np.linalg.eigh(s)
        common = (vectors[:, -3:] * values[-3:]) @ vectors[:, -3:].T
        want[window] = (common + np.diag(np.maximum(np.diag(s - common), factors.LEAST_VARIANCE))) * 252, values[-3:].sum() / values.sum()
    returns = spark.createDataFrame(rows, "window int, asset string, dt date, r double")
    got = {w: np.zeros_like(m) for w, (m, _) in want.items()}
    for r in factors.pca_covariance(returns, 3, 252, ("window",)).collect():
        got[r.window][int(r.asset_i[1:]), int(r.asset_j[1:])] = r["cov"]
    _, told = factors.principal_factors(returns, 3, ("window",))
    for r in told.collect():
        assert r.n_factors == 3 and r.cumulative == pytest.approx(want[r.window][1], rel=1e-8)
        assert got[r.window] == pytest.approx(want[r.window][0], rel=1e-6, abs=1e-9)
    with pytest.raises(ValueError, match="factor"):
        factors.pca_covariance(returns.filter("asset = 'a01'"), 3)


def test_densify_starts_at_the_first_date(spark):
    rows = [("a", datetime.date(2024, 1, i), float(i)) for i in (1, 2, 4)] + [("b", datetime.date(2024, 1, i), 1.0) for i in (3, 4)]
    prices = spark.createDataFrame(rows, "asset string, dt date, price double")
    whole, late = panel.densify(prices), panel.densify(prices, leading=False)
    assert whole.count() == 8 and {(r.asset, r.dt.day, r.price) for r in late.collect()} == {("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, None), ("a", 4, 4.0), ("b", 3, 1.0), ("b", 4, 1.0)}
    plan = whole._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_missing_assets_are_an_error(spark):
    prices = spark.createDataFrame([("a", datetime.date(2024, 1, 1), 1.0)], "asset string, dt date, price double")
    with pytest.raises(selection.MissingAssets, match="b"):
        selection.chosen_assets(prices, ["a", "b"])


def test_two_assets_below_the_riskless_return_keep_their_greatest_ratio(spark):
    """Returns below the riskless one: the least variance mixes the assets, the greatest ratio doesn't."""
    rows = [("p", i, j, m, c) for i, m in (("a", 0.01), ("b", 0.005)) for j, c in ((i, 0.04), ("b" if i == "a" else "a", 0.01))]
    problem = spark.createDataFrame(rows, "portfolio string, asset_i string, asset_j string, mu_i double, cov double")
    got = {r["asset"]: r["w"] for r in optimise.max_sharpe(problem, ["portfolio"], below="one_asset", clean=False).collect()}
    assert got == {"a": 1.0, "b": 0.0}
    mixed = {r["asset"]: r["w"] for r in optimise.max_sharpe(problem, ["portfolio"]).collect()}
    assert mixed == {"a": 0.5, "b": 0.5}


def test_sharpe_of_two_matches_sql_on_the_larger_tables(spark):
    folder = f"{DATA}/sf0.1"
    assert compare(spark, connect(folder), "q02_max_sharpe_of_two", QUERIES["q02_max_sharpe_of_two"], ORACLE_SQL["q02_max_sharpe_of_two"], folder) is None
