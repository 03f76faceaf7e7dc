"""Portfolios under weight limits by the critical line: the efficient frontier's turning points, and from them the greatest Sharpe
ratio, the least variance, a target return or a quadratic utility.

A problem is the means and covariances of one portfolio's assets: rows ``(portfolio, asset_i, asset_j, mu_i, cov)`` that Spark groups, so
portfolios (windows, methods) are solved side by side; a group is a matrix of its assets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Risk aversions that the search with short positions tries (fixed values); weights below ``TINY`` become 0, others have ``DIGITS`` digits.
AVERSIONS = (0.01, 0.05, 0.1, 0.3, 0.5, 1, 2, 5, 10, 20, 50)
TINY, DIGITS = 1e-4, 5
#: Shares of the mean variance that are added to singular covariances, in turn; worst condition of an inverse; changes between its renewals.
RIDGES, WORST, RENEWED = (0.0, 1e-7, 1e-6, 1e-5, 1e-3), 1e10, 10


def bounds(cap: float, short: bool, n: int) -> tuple[float, float]:
    """Limits of a weight; a cap too small for ``n`` weights that sum to 1 is raised to 1 / n."""
    high = max(cap, 1 / n)
    return (-cap if short else 0.0), high


def turning_points(mu: np.ndarray, cov: np.ndarray, low: float, high: float) -> list[tuple[float, np.ndarray]]:
    """``(lam, weights)`` from the greatest return down to the least variance (lam = 0).

    The weights minimise w'Sw / 2 - lam * mu'w with sum 1 and low <= w <= high, and are linear in lam between two points.
    """
    n = len(mu)
    mu = mu + 1e-9 * np.arange(n)[::-1] * max(1.0, float(np.abs(mu).max()))  # ties: the first asset
    if n * high <= 1 + 1e-12:
        return [(0.0, np.full(n, 1 / n))]
    high *= 1 + 1e-9  # limits that fill 1 exactly would leave no free asset
    w = np.full(n, low)
    for i in np.argsort(-mu, kind="stable"):
        w[i] = min(high, low + 1 - w.sum())
        if w.sum() >= 1 - 1e-15:
            break
    free, lam, points, last = _Free(cov, int(i)), np.inf, [(np.inf, w.copy())], -1

    while True:
        own = free.assets
        rest = np.setdiff1d(np.arange(n), own)
        fixed = free.inverse @ (cov[np.ix_(own, rest)] @ w[rest])
        one, m = free.inverse.sum(1), free.inverse @ mu[own]
        level = np.array([1 - w[rest].sum() + fixed.sum(), -m.sum()]) / one.sum()
        a, b = level[0] * one - fixed, m + level[1] * one  # free weights are a + lam * b
        # a free weight meets a limit, or the gradient of a limited one meets that of the free ones
        to = np.where(b < 0, high, low)
        still = cov[np.ix_(rest, own)]
        c0, c1 = still @ a + cov[np.ix_(rest, rest)] @ w[rest] - level[0], still @ b - mu[rest] - level[1]
        with np.errstate(divide="ignore", invalid="ignore"):
            meets = np.where((np.abs(b) > 1e-15) & (len(own) > 1), (to - a) / b, -1.0)
            opens = np.where(np.abs(c1) > 1e-15, -c0 / c1, -1.0)
        at, who = np.concatenate([meets, opens]), np.concatenate([own, rest])
        # the change just made isn't undone at the same place
        ahead = np.inf if np.isinf(lam) else lam - np.where(who == last, 1e-8, 1e-14) * max(1.0, lam)
        at = np.where((at < ahead) & np.isfinite(at), at, -1.0)
        k = int(np.argmax(at))
        lam = max(float(at[k]), 0.0)
        w[own] = a + lam * b
        points.append((lam, w.copy()))
        if lam <= 0:
            return points
        last = int(who[k])
        if k < len(own):
            w[last] = to[k]
            free.leave(k)
        else:
            free.enter(last)


class _Free:
    """The free assets and the inverse of their covariances, which is updated when one enters or leaves and renewed now and then."""

    def __init__(self, cov: np.ndarray, first: int):
        self.cov, self.assets, self.changes = cov, [first], 0
        self._renew()

    def _renew(self) -> None:
        own = self.cov[np.ix_(self.assets, self.assets)]
        if not np.isfinite(own).all() or np.linalg.cond(own) > WORST:
            raise np.linalg.LinAlgError("the free assets' covariances are singular")
        self.inverse = np.linalg.inv(own)

    def _counted(self) -> bool:
        self.changes += 1
        return self.changes % RENEWED == 0

    def enter(self, i: int) -> None:
        c = self.cov[self.assets, i]
        u = self.inverse @ c
        left = self.cov[i, i] - c @ u
        self.assets.append(i)
        if self._counted() or left <= self.cov[i, i] / WORST:
            return self._renew()
        out = np.empty((len(u) + 1, len(u) + 1))
        out[:-1, :-1], out[:-1, -1], out[-1, :-1], out[-1, -1] = self.inverse + np.outer(u, u) / left, -u / left, -u / left, 1 / left
        self.inverse = out

    def leave(self, k: int) -> None:
        del self.assets[k]
        if self._counted():
            return self._renew()
        kept = np.arange(len(self.inverse)) != k
        column = self.inverse[kept, k]
        self.inverse = self.inverse[np.ix_(kept, kept)] - np.outer(column, column) / self.inverse[k, k]


def line(mu: np.ndarray, cov: np.ndarray, low: float, high: float) -> tuple[list[tuple[float, np.ndarray]], np.ndarray] | None:
    """Turning points, and the covariances they hold for: those given or, where they are singular, these with the least of ``RIDGES`` on the
    diagonal that is enough. None where means or covariances aren't numbers."""
    if not (np.isfinite(mu).all() and np.isfinite(cov).all()):
        return None
    size, gain = float(np.trace(cov)) / len(mu) or 1.0, float(np.abs(mu).max()) or 1.0
    for ridge in RIDGES:
        held = cov + ridge * size * np.eye(len(mu))
        unit = float(np.trace(held)) / len(mu) or 1.0
        try:
            # in units of the mean variance and the greatest mean
            points = turning_points(mu / gain, held / unit, low, high)
            if all(w.min() > low - 1e-6 and w.max() < high + 1e-6 and abs(w.sum() - 1) < 1e-6 for _, w in points):
                return [(lam * unit / gain, w) for lam, w in points], held
        except np.linalg.LinAlgError:
            pass
    return [(0.0, np.full(len(mu), 1 / len(mu)))], cov


def least_variance(points) -> np.ndarray:
    return points[-1][1]


def at_lambda(points, lam: float) -> np.ndarray:
    """The weights that minimise w'Sw / 2 - lam * mu'w."""
    for (hi, w1), (lo, w0) in zip(points[:-1], points[1:], strict=True):
        if lam >= lo:
            if not np.isfinite(hi) or hi == lo:
                return w0 if lam == lo else w1
            t = min(1.0, (lam - lo) / (hi - lo))
            return w0 + t * (w1 - w0)
    return points[-1][1]


def at_return(points, mu: np.ndarray, target: float) -> tuple[float, np.ndarray]:
    """``(lam, weights)`` of least variance with the return ``target``, which lies between those of the end points."""
    for (hi, w1), (lo, w0) in zip(points[:-1], points[1:], strict=True):
        r1, r0 = mu @ w1, mu @ w0
        if r0 <= target <= r1:
            t = 0.0 if r1 == r0 else (target - r0) / (r1 - r0)
            return (lo if t == 0 or np.isinf(hi) else lo + t * (hi - lo)), w0 + t * (w1 - w0)
    return points[-1] if target < mu @ points[-1][1] else points[0]


def kkt(mu: np.ndarray, cov: np.ndarray, low: float, high: float, lam: float, w: np.ndarray) -> float:
    """How far ``w`` is from the conditions of least w'Sw / 2 - lam * mu'w with sum 1 and limits, as a share of the mean variance and the gradient's terms.

    The gradient of a weight that may fall must not be above that of one that may rise.
    """
    g, room = cov @ w - lam * mu, 1e-7
    worst = max(g[w > low + room].max(initial=-np.inf) - g[w < high - room].min(initial=np.inf), 0.0)
    return float(worst / max(np.trace(cov) / len(mu), np.abs(lam * mu).max(), 1e-300))


def _ratio(w: np.ndarray, mu: np.ndarray, cov: np.ndarray, rf: float) -> float:
    return float((mu @ w - rf) / np.sqrt(max(w @ cov @ w, 1e-30)))


def greatest_sharpe(points, mu: np.ndarray, cov: np.ndarray, rf: float) -> np.ndarray:
    """The frontier's weights of greatest Sharpe ratio; without a return above ``rf`` those of least variance."""
    if (mu @ points[0][1]) <= rf:
        return least_variance(points)
    best, found = -np.inf, points[-1][1]
    for (_, w1), (_, w0) in zip(points[:-1], points[1:], strict=True):
        d = w1 - w0
        e, g = mu @ w0 - rf, mu @ d
        q0, q1, q2 = w0 @ cov @ w0, w0 @ cov @ d, d @ cov @ d
        slope = g * q1 - e * q2
        inner = [(e * q1 - g * q0) / slope] if abs(slope) > 1e-18 else []
        for t in (0.0, 1.0, *(x for x in inner if 0 < x < 1)):
            w = w0 + t * d
            sharpe = _ratio(w, mu, cov, rf)
            if sharpe > best + 1e-12:
                best, found = sharpe, w
    return found


def one_asset(mu: np.ndarray, cov: np.ndarray, rf: float) -> np.ndarray:
    """The weights of the one asset of greatest Sharpe ratio.

    Without limits and without a return above ``rf`` no mixture has a greater ratio: shortfalls are linear in the weights and risks convex, so the ratio is greatest at a corner.
    """
    return np.eye(len(mu))[int(np.argmax([_ratio(w, mu, cov, rf) for w in np.eye(len(mu))]))]


def utility_scan(points, mu: np.ndarray, cov: np.ndarray, rf: float) -> np.ndarray:
    """The best Sharpe ratio among the portfolios of the utilities mu'w - aversion / 2 * w'Sw."""
    tried = [at_lambda(points, 1 / a) for a in AVERSIONS]
    return max(tried, key=lambda w: _ratio(w, mu, cov, rf))


def cleaned(w: np.ndarray) -> np.ndarray:
    return np.round(np.where(np.abs(w) < TINY, 0.0, w), DIGITS)


def _problem(table: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    names = sorted(table["asset_i"].unique())
    cov = table.pivot(index="asset_i", columns="asset_j", values="cov").loc[names, names].to_numpy(float)
    mu = table.drop_duplicates("asset_i").set_index("asset_i")["mu_i"].loc[names].to_numpy(float)
    return names, mu, (cov + cov.T) / 2


def problems(mu: DataFrame, cov: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, asset_i, asset_j, mu_i, cov)`` of ``mu(*by, asset, mu)`` and ``cov(*by, asset_i, asset_j, cov)``."""
    return cov.join(mu.select(*by, F.col("asset").alias("asset_i"), F.col("mu").alias("mu_i")), [*by, "asset_i"])


def max_sharpe(problem: DataFrame, by: list[str], cap: float = 1.0, short: bool = False, rf: float = 0.04, below: str = "least_variance", clean: bool = True) -> DataFrame:
    """``(*by, asset, w)``: weights of the greatest Sharpe ratio of each problem, cleaned unless told otherwise; null weights where means or covariances aren't numbers.

    Where no return is above ``rf``, ``below`` decides: ``least_variance``, or ``one_asset`` for the greatest of the negative ratios, which needs weights without limits.
    """
    if below not in ("least_variance", "one_asset") or (below == "one_asset" and (short or cap < 1)):
        raise ValueError(below)

    def solve(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        names, mu, cov = _problem(table)
        low, high = bounds(cap, short, len(names))
        found, w = line(mu, cov, low, high), None
        if found:
            points, cov = found
            if below == "one_asset" and mu.max() <= rf:
                w = one_asset(mu, cov, rf)
            else:
                w = utility_scan(points, mu, cov, rf) if short else greatest_sharpe(points, mu, cov, rf)
            w = cleaned(w) if clean else w
        return pd.DataFrame({**dict(zip(by, key, strict=True)), "asset": names, "w": w})

    kinds = dict(problem.dtypes)
    return problem.groupBy(*by).applyInPandas(solve, ", ".join([*(f"{c} {kinds[c]}" for c in by), "asset string, w double"]))


def frontier(problem: DataFrame, by: list[str], cap: float = 1.0, short: bool = False, n_points: int = 25) -> DataFrame:
    """``(*by, point, expected_return, volatility, total, least, most, kkt)``: least variances for returns from that of the least-variance portfolio almost to the greatest.

    ``total``, ``least`` and ``most`` are the weights' sum and extremes, ``kkt`` how far they are from the conditions of least variance. One point where there
    is one asset, or no portfolio has a greater return; none where means or covariances aren't numbers.
    """
    names_of = ["expected_return", "volatility", "total", "least", "most", "kkt"]

    def sweep(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        names, mu, cov = _problem(table)
        low, high = bounds(cap, short, len(names))
        found, ws = line(mu, cov, low, high), []
        if found:
            points, cov = found
            start, end = mu @ least_variance(points), mu @ points[0][1]
            many = len(names) > 1 and end > start + 1e-9 * np.abs(mu).max()
            ws = [at_return(points, mu, r) for r in np.linspace(start, start + 0.999 * (end - start), n_points)] if many else [(0.0, least_variance(points))]
        rows = [(mu @ w, np.sqrt(max(w @ cov @ w, 0.0)), w.sum(), w.min(), w.max(), kkt(mu, cov, low, high, lam, w)) for lam, w in ws]
        out = pd.DataFrame(rows, columns=names_of)
        out.insert(0, "point", range(len(rows)))
        for i, (c, v) in enumerate(zip(by, key, strict=True)):
            out.insert(i, c, v)
        return out

    kinds = dict(problem.dtypes)
    return problem.groupBy(*by).applyInPandas(sweep, ", ".join([*(f"{c} {kinds[c]}" for c in by), "point int", *(f"{c} double" for c in names_of)]))
