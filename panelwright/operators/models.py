"""Forecast models and tests that need an asset's ordered series: one group for each asset, each a few thousand numbers.

Every forecaster takes ``prices(asset, dt, price)`` and a horizon and gives ``(asset, step, forecast, lower, upper)``. Below
``LEAST`` prices, or where a fit fails, it is the drift forecast. ``register`` adds a model of one's own.
"""

from __future__ import annotations

from collections.abc import Callable
from math import erf

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import forecast, moments, recurrent
from .forecast import Z

#: Least history of a forecast, of a volatility model and of the unit root test (fixed values).
LEAST, LEAST_VOLATILITY, LEAST_UNIT_ROOT, LEAST_NETWORK = 30, 100, 20, 90
#: Returns before the predicted one, trees, their depth and rate of the boosted regression (fixed values).
LOOKBACK, TREES, TREE_DEPTH, RATE = 10, 200, 3, 0.05

Result = tuple[np.ndarray, np.ndarray] | None


def drift(y: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Forecast and half width of its band: the mean step carried on."""
    moves, steps = np.diff(y), np.arange(1, horizon + 1)
    mean, sd = (moves.mean() if len(moves) else 0.0), (moves.std(ddof=1) if len(moves) > 1 else 0.0)
    return y[-1] + mean * steps, Z * sd * np.sqrt(steps)


def least(f: Callable[[np.ndarray], float], start: np.ndarray, step: np.ndarray, rounds: int = 400) -> np.ndarray:
    """A minimum by the simplex method of Nelder and Mead."""
    points = np.vstack([start, start + np.diag(step)])
    values = np.array([f(p) for p in points])
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if np.abs(values[-1] - values[0]) <= 1e-10 * (1 + abs(values[0])):
            break
        centre, worst = points[:-1].mean(0), points[-1]
        tried = centre + (centre - worst)
        at = f(tried)
        if at < values[0]:
            further = centre + 2 * (centre - worst)
            far = f(further)
            points[-1], values[-1] = (further, far) if far < at else (tried, at)
        elif at < values[-2]:
            points[-1], values[-1] = tried, at
        else:
            inner = centre + 0.5 * ((tried if at < values[-1] else worst) - centre)
            near = f(inner)
            if near < min(at, values[-1]):
                points[-1], values[-1] = inner, near
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(p) for p in points[1:]]
    return points[np.argmin(values)]


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def _share(x: float, low: float = 0.0, high: float = 1.0) -> float:
    return low + (high - low) / (1 + np.exp(-np.clip(x, -40, 40)))


def ets(y: np.ndarray, horizon: int) -> Result:
    """Exponential smoothing with a damped additive trend; weights, damping and initial state by least squared one-step errors."""
    scale = y.std() or 1.0

    def run(p):
        a, phi = _share(p[0], 1e-4, 1 - 1e-4), _share(p[2], 0.8, 0.995)
        b = a * _share(p[1])
        level, trend, errors = p[3] * scale + y[0], p[4] * scale, np.empty(len(y))
        for t, value in enumerate(y):
            ahead = level + phi * trend
            errors[t] = value - ahead
            level, trend = ahead + a * errors[t], phi * trend + b * errors[t]
        return errors, level, trend, phi

    start = np.array([_logit(0.5), _logit(0.1), 1.0, 0.0, (y[1] - y[0]) / scale])
    best = least(lambda p: float((run(p)[0] ** 2).sum()), start, np.array([1.0, 1.0, 1.0, 0.1, 0.1]))
    errors, level, trend, phi = run(best)
    steps = np.arange(1, horizon + 1)
    return level + trend * np.cumsum(phi**steps), Z * errors.std(ddof=1) * np.sqrt(steps)


def theta(y: np.ndarray, horizon: int) -> Result:
    n, step = len(y), np.arange(1, horizon + 1)
    alpha = forecast.best_alpha(y)
    errors, level = forecast.smoothing_errors(y, np.array([alpha]))
    slope = np.polyfit(np.arange(n), y, 1)[0]
    centre = level[0] + slope / 2 * (step - 1 + 1 / alpha - (1 - alpha) ** n / alpha)
    return centre, Z * float(errors[0].std(ddof=1)) * np.sqrt(step)


def _stable(p: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary polynomial from free numbers, by partial autocorrelations."""
    out: list[float] = []
    for r in np.tanh(p):
        out = [c - r * d for c, d in zip(out, out[::-1], strict=True)] + [r]
    return np.array(out)


def _state(ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transition and shock of an ARMA process in state-space form; the first state is the series."""
    size = max(len(ar), len(ma) + 1)
    move, shock = np.diag(np.ones(size - 1), 1), np.zeros(size)
    move[: len(ar), 0], shock[0], shock[1 : len(ma) + 1] = ar, 1.0, ma
    return move, shock


def innovations(x: np.ndarray, ar: np.ndarray, ma: np.ndarray, to_state: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """One-step errors, their variances (as multiples of the shocks') and the state ahead of a stationary, invertible ARMA process, by the Kalman filter.

    It starts from the stationary variance. Once the state's variance stands still the errors follow the process's own recursion, which is
    taken where the last state isn't asked for.
    """
    move, shock = _state(ar, ma)
    size, noise, n = len(shock), np.outer(shock, shock), len(x)
    p = np.linalg.solve(np.eye(size * size) - np.kron(move, move), noise.ravel()).reshape(size, size)
    a, v, f, still = np.zeros(size), np.empty(n), np.ones(n), False
    for t in range(n):
        if still and not to_state and t >= size:
            break
        if not still:
            wide = p[0, 0]
            gain = move @ p[:, 0] / wide
            after = move @ p @ move.T + noise - np.outer(gain, gain) * wide
            still, p = bool(np.abs(after - p).max() < 1e-12 * wide), after
        v[t], f[t] = x[t] - a[0], wide
        a = move @ a + gain * v[t]
    else:
        return v, f, a
    f[t:] = wide
    rest = x[t:].copy()
    for k, c in enumerate(ar):
        rest -= c * x[t - k - 1 : n - k - 1]
    past, theta = v[:t].tolist(), ma.tolist()
    for e in rest.tolist():
        for k, c in enumerate(theta, 1):
            e -= c * past[-k]
        past.append(e)
    return np.array(past), f, None


def likelihood(x: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[float, float]:
    """Exact Gaussian log-likelihood of an ARMA process with the shocks' variance at its best, and that variance."""
    v, f, _ = innovations(x, ar, ma, False)
    variance = float(np.mean(v * v / f))
    if not variance > 0:
        return -np.inf, variance
    return float(-0.5 * (len(x) * (np.log(2 * np.pi * variance) + 1) + np.log(f).sum())), variance


def arima(y: np.ndarray, horizon: int, most: int = 3) -> Result:
    """ARIMA(p, 1, q) without a constant, p and q up to ``most``, of least AIC by the exact likelihood of the differences."""
    x, found = np.diff(y), None
    scale = x.std() or 1.0
    for p in range(most + 1):
        for q in range(most + 1):
            if p == q == 0:
                continue
            loss = lambda v: -likelihood(x / scale, _stable(v[:p]), -_stable(v[p:]))[0]  # noqa: B023, E731
            v = least(loss, np.full(p + q, 0.05), np.full(p + q, 0.3), 60 * (p + q))
            lowest = loss(v)
            if np.isfinite(lowest) and (found is None or 2 * lowest + 2 * (p + q + 1) < found[0]):
                found = 2 * lowest + 2 * (p + q + 1), _stable(v[:p]), -_stable(v[p:])
    if found is None:
        return None
    _, ar, ma = found
    (move, shock), (_, _, state), (_, variance) = _state(ar, ma), innovations(x, ar, ma), likelihood(x, ar, ma)
    steps, psi = [], []
    for _ in range(horizon):
        steps.append(state[0])
        psi.append(shock[0])
        state, shock = move @ state, move @ shock
    # a level's error sums those of its steps
    spread = np.sqrt(variance * np.cumsum(np.cumsum(psi) ** 2))
    return y[-1] + np.cumsum(steps), 1.959963984540054 * spread


class Boosted:
    """Regression trees of depth ``TREE_DEPTH`` fitted one after the other to the residuals, with all split points tried."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.start, self.trees, self.order = float(y.mean()), [], np.argsort(x, 0, kind="stable")
        fit = np.full(len(y), self.start)
        for _ in range(TREES):
            tree = self._tree(x, y - fit, np.ones(len(y), bool), TREE_DEPTH)
            self.trees.append(tree)
            fit += RATE * self._of(tree, x)
        self.fitted = fit

    def _tree(self, x, r, own, depth):
        n, total = int(own.sum()), float(r[own].sum())
        best = None
        if depth and n > 1:
            for j in range(x.shape[1]):
                at = self.order[:, j][own[self.order[:, j]]]
                left, k = np.cumsum(r[at])[:-1], np.arange(1, n)
                gain = left**2 / k + (total - left) ** 2 / (n - k)
                gain[x[at[1:], j] <= x[at[:-1], j]] = -1.0
                i = int(np.argmax(gain))
                if gain[i] > 0 and (best is None or gain[i] > best[0] + 1e-15):
                    best = gain[i], j, (x[at[i], j] + x[at[i + 1], j]) / 2
        if best is None:
            return total / n
        _, j, cut = best
        low = own & (x[:, j] <= cut)
        return j, cut, self._tree(x, r, low, depth - 1), self._tree(x, r, own & ~low, depth - 1)

    def _of(self, tree, x) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, cut, low, high = tree
        return np.where(x[:, j] <= cut, self._of(low, x), self._of(high, x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.start + RATE * sum(self._of(t, x) for t in self.trees)


def features(returns: np.ndarray) -> np.ndarray:
    """The last ``LOOKBACK`` returns, their mean and their deviation."""
    return np.concatenate([returns, [returns.mean(), returns.std()]])


def regression(y: np.ndarray, horizon: int) -> Result:
    """Boosted trees from the last returns to the next one, applied to its own predictions; the band is that of the fit's errors."""
    r = np.diff(y) / y[:-1]
    rows = len(r) - LOOKBACK
    if rows < 20:
        return None
    model = Boosted(np.array([features(r[i : i + LOOKBACK]) for i in range(rows)]), r[LOOKBACK:])
    window = list(r[-LOOKBACK:])
    for _ in range(horizon):
        window.append(float(model.predict(features(np.array(window[-LOOKBACK:]))[None])[0]))
    centre = y[-1] * np.cumprod(1 + np.array(window[LOOKBACK:]))
    return centre, Z * centre * (r[LOOKBACK:] - model.fitted).std(ddof=1) * np.sqrt(np.arange(1, horizon + 1))


def network(y: np.ndarray, horizon: int) -> Result:
    """A recurrent network trained on the asset's own returns; its predicted returns are compounded, the band is that of the fit's errors."""
    found = recurrent.returns_ahead(np.diff(y) / y[:-1], horizon)
    if found is None:
        return None
    centre = y[-1] * np.cumprod(1 + found[0])
    return centre, Z * centre * found[1] * np.sqrt(np.arange(1, horizon + 1))


FORECASTERS: dict[str, Callable[[np.ndarray, int], Result]] = {"naive": drift, "ets": ets, "theta": theta, "arima": arima, "ml_regression": regression, "lstm": network}


def register(name: str, model: Callable[[np.ndarray, int], Result]) -> None:
    """Add a model: a series and a horizon in, forecast and half width of the band out, or None for the drift forecast."""
    FORECASTERS[name] = model


def named(model: str) -> tuple[Callable[[np.ndarray, int], Result], int]:
    """The model of that name and the prices it needs at least."""
    if model not in FORECASTERS:
        raise ValueError(f"no forecast model {model}")
    return FORECASTERS[model], LEAST_NETWORK if model == "lstm" else LEAST


def one_series(y: np.ndarray, horizon: int, fit: Callable[[np.ndarray, int], Result], lowest: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Forecast, half width of its band and whether ``fit`` made them; else, or below its least history, they are the drift's."""
    found = None
    if len(y) >= lowest:
        try:
            found = fit(y, horizon)
        except (ArithmeticError, np.linalg.LinAlgError, ValueError):
            found = None
    fitted = found is not None and bool(np.isfinite(found[0]).all())
    return (*(found if fitted else drift(y, horizon)), fitted)


def all_assets(prices: DataFrame, horizon: int, model: str = "naive", by: tuple[str, ...] = (), told: bool = False) -> DataFrame:
    """``(*by, asset, step, forecast, lower, upper)`` of every asset by the named model; with ``told`` also ``fitted``: false where the drift forecast stands in."""
    (fit, lowest), keys, kinds = named(model), [*by, "asset"], dict(prices.dtypes)

    def one(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        centre, band, fitted = one_series(table.sort_values("dt")["price"].to_numpy(float), horizon, fit, lowest)
        rows = {"step": np.arange(1, horizon + 1), "forecast": centre, "lower": centre - band, "upper": centre + band} | ({"fitted": fitted} if told else {})
        return pd.DataFrame({**dict(zip(keys, key, strict=True)), **rows})

    known = prices.filter("price is not null and not isnan(price)").select(*keys, "dt", "price")
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "step int, forecast double, lower double, upper double", *(["fitted boolean"] if told else [])])
    return known.groupBy(*keys).applyInPandas(one, schema)


# ---------------------------------------------------------------- volatility


def garch_variance(r: np.ndarray, horizon: int) -> float | None:
    """Mean forecast variance over ``horizon`` steps of a GARCH(1, 1) with mean 0; None if it can't be fitted."""
    if len(r) < LEAST_VOLATILITY:
        return None
    x = 100 * r
    square, start = x * x, float((x * x).mean())
    if start <= 0:
        return None

    def variances(p):
        keep = _share(p[1], 0, 0.9999)
        a = keep * _share(p[2])
        omega, b, v = np.exp(p[0]), keep - a, np.empty(len(x) + 1)
        v[0] = start
        for t in range(len(x)):
            v[t + 1] = omega + a * square[t] + b * v[t]
        return v, omega, keep

    def loss(p):
        v = np.maximum(variances(p)[0][:-1], 1e-12)
        return float(0.5 * (np.log(v) + square / v).sum())

    best = least(loss, np.array([np.log(0.05 * start), _logit(0.95), _logit(0.1)]), np.array([0.5, 0.5, 0.5]))
    v, omega, keep = variances(best)
    ahead, total = v[-1], 0.0
    for _ in range(horizon):
        total += ahead
        ahead = omega + keep * ahead
    mean = total / horizon / 1e4
    return float(mean) if np.isfinite(mean) and mean > 0 else None


def forecast_variances(returns: DataFrame, horizon: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, asset, variance, fitted)`` a period: the GARCH forecast, or the sample variance where there is none."""
    keys, kinds = [*by, "asset"], dict(returns.dtypes)

    def one(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        r = table.sort_values("dt")["r"].to_numpy(float)
        found = garch_variance(r, horizon)
        own = r.var(ddof=1) if found is None else found
        return pd.DataFrame({**{c: [v] for c, v in zip(keys, key, strict=True)}, "variance": [own], "fitted": [found is not None]})

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "variance double, fitted boolean"])
    return returns.filter("r is not null").select(*keys, "dt", "r").groupBy(*keys).applyInPandas(one, schema)


def garch_coverage(variances: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, n_fitted, n_fallback, fallback)`` of ``forecast_variances``: how many assets have a GARCH forecast, and which have none."""
    left = F.array_sort(F.collect_list(F.when(~F.col("fitted"), F.col("asset"))))
    return variances.groupBy(*by).agg(F.count_if("fitted").alias("n_fitted"), F.count_if(~F.col("fitted")).alias("n_fallback"), left.alias("fallback"))


def garch_covariance(returns: DataFrame, complete: DataFrame, horizon: int, periods: int = 52, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, asset_i, asset_j, cov)``: forecast volatilities with the correlations of the shrunk covariance of ``complete`` cases."""
    cov, v = moments.ledoit_wolf(complete, periods, by), forecast_variances(returns, horizon, by)
    same = cov.filter("asset_i = asset_j").withColumnRenamed("asset_i", "asset")
    own = same.join(v, [*by, "asset"]).select(*by, "asset", F.sqrt(F.try_divide(F.col("variance") * periods, F.col("cov"))).alias("k"))
    scaled = cov
    for side in ("asset_i", "asset_j"):
        scaled = scaled.join(own.select(*by, F.col("asset").alias(side), F.col("k").alias(f"k_{side}")), [*by, side])
    return scaled.select(*by, "asset_i", "asset_j", (F.col("cov") * F.col("k_asset_i") * F.col("k_asset_j")).alias("cov"))


# ---------------------------------------------------------------- unit roots

#: MacKinnon's (1994) response surface of the test with a constant (fixed values).
_STAR, _MOST, _FEWEST = -1.61, 2.74, -18.83
_SMALL, _LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)


def unit_root_p(statistic: float) -> float:
    if statistic > _MOST:
        return 1.0
    if statistic < _FEWEST:
        return 0.0
    terms = _SMALL if statistic <= _STAR else _LARGE
    return 0.5 * (1 + erf(sum(c * statistic**k for k, c in enumerate(terms)) / 2**0.5))


def unit_root(x: np.ndarray) -> tuple[float, float] | None:
    """Statistic and p-value of the augmented Dickey-Fuller test with a constant; lags by least AIC on common rows."""
    n = len(x)
    if n < LEAST_UNIT_ROOT or x.std() == 0:
        return None
    most = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    d = np.diff(x)

    def fit(lags: int, skip: int) -> tuple[float, float]:
        y = d[skip:]
        design = np.column_stack([x[skip:-1], *(d[skip - k : -k] for k in range(1, lags + 1)), np.ones(len(y))])
        beta, _, _, _ = np.linalg.lstsq(design, y, rcond=None)
        rest = y - design @ beta
        s2 = rest @ rest / (len(y) - design.shape[1])
        aic = len(y) * (np.log(2 * np.pi * (rest @ rest) / len(y)) + 1) + 2 * design.shape[1]
        return aic, beta[0] / np.sqrt(s2 * np.linalg.inv(design.T @ design)[0, 0])

    lags = min(range(most + 1), key=lambda k: fit(k, most)[0])
    statistic = float(fit(lags, lags)[1])
    return statistic, unit_root_p(statistic)


def stationarity(returns: DataFrame) -> DataFrame:
    """``(asset, statistic, p_value, stationary)``; nulls for fewer than 20 returns."""

    def one(table: pd.DataFrame) -> pd.DataFrame:
        found = unit_root(table.sort_values("dt")["r"].to_numpy(float))
        s, p = found if found else (None, None)
        return pd.DataFrame({"asset": [table["asset"].iloc[0]], "statistic": [s], "p_value": [p], "stationary": [None if p is None else bool(p < 0.05)]})

    return returns.filter("r is not null").select("asset", "dt", "r").groupBy("asset").applyInPandas(one, "asset string, statistic double, p_value double, stationary boolean")
