"""Factor models: compounding factors to periods, exposures by least squares, and covariances with a factor structure."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .moments import pair_sums
from .panel import written

#: Least observations of a regression (fixed value) and least idiosyncratic variance.
LEAST_OBSERVATIONS, LEAST_VARIANCE = 30, 1e-10
#: Vectors beside the wanted ones, share of the greatest variance at which power steps end, pieces of a covariance matrix's rows.
MORE, STILL, PIECES = 10, 1e-12, 8
FACTORS3, FACTORS5 = ["mkt_rf", "smb", "hml"], ["mkt_rf", "smb", "hml", "rmw", "cma"]


def period_of_days(days: DataFrame, ends: DataFrame) -> DataFrame:
    """``days`` with ``period``: the first of ``ends(dt)`` at or after each day; days after the last end, and up to the first, go.

    Both tables share one ordered window over dates, so there is no join by range.
    """
    marked = days.select("dt", F.lit(None).cast("date").alias("end")).distinct().unionByName(ends.select("dt", F.col("dt").alias("end")).distinct())
    ahead = Window.partitionBy(F.lit(1)).orderBy(F.desc("dt"), F.col("end").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    first = F.min("end").over(Window.partitionBy(F.lit(1)))
    at = marked.select("dt", "end", F.last("end", ignorenulls=True).over(ahead).alias("period"), first.alias("first"))
    at = at.filter("end is null and period is not null and dt > first").select("dt", "period")
    return days.join(at, "dt")


def compounded_factors(factors: DataFrame, ends: DataFrame) -> DataFrame:
    """Daily ``factors(dt, mkt_rf, ..., rf)`` compounded over each period that ends with one of ``ends(dt)``; ``dt`` is that end.

    The market is compounded as mkt_rf + rf, less the compounded rf. The first period is left out, as its beginning isn't known.
    """
    names = [c for c in FACTORS5 if c in factors.columns and c != "mkt_rf"]
    grown = lambda x: F.product(1 + x) - 1
    by = period_of_days(factors, ends).groupBy("period").agg(
        (grown(F.col("mkt_rf") + F.col("rf")) - grown(F.col("rf"))).alias("mkt_rf"), *(grown(F.col(c)).alias(c) for c in names), grown(F.col("rf")).alias("rf")
    )
    return by.withColumnRenamed("period", "dt")


def exposures(returns: DataFrame, factors: DataFrame, periods: int) -> DataFrame:
    """``(asset, alpha_annualised, factor loadings, r_squared, n_obs)`` of each asset's excess returns on the factors, by least squares.

    The sums of products are one aggregate by asset on shared dates; only its row of a few numbers is solved in Python. Assets with
    fewer than ``LEAST_OBSERVATIONS`` shared dates, or collinear factors, have no row.
    """
    names = [c for c in FACTORS5 if c in factors.columns]
    joined = returns.join(factors, "dt").dropna(subset=["r", "rf", *names]).withColumn("y", F.col("r") - F.col("rf")).withColumn("one", F.lit(1.0))
    x = ["one", *names]
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"s_{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if i <= j]
    sums += [F.sum(F.col(a) * F.col("y")).alias(f"y_{i}") for i, a in enumerate(x)] + [F.sum(F.col("y") * F.col("y")).alias("yy")]
    gram = joined.groupBy("asset").agg(F.count("*").alias("n"), *sums).filter(F.col("n") >= LEAST_OBSERVATIONS)

    def solve(tables):
        for t in tables:
            out = []
            for r in t.itertuples(index=False):
                a = np.array([[getattr(r, f"s_{min(i, j)}_{max(i, j)}") for j in range(len(x))] for i in range(len(x))])
                b = np.array([getattr(r, f"y_{i}") for i in range(len(x))])
                if np.linalg.matrix_rank(a, hermitian=True) < len(x):
                    continue
                beta = np.linalg.solve(a, b)
                total = r.yy - b[0] ** 2 / r.n
                out.append((r.asset, (1 + beta[0]) ** periods - 1, *beta[1:], 1 - (r.yy - beta @ b) / total if total > 0 else None, r.n))
            yield pd.DataFrame(out, columns=["asset", "alpha_annualised", *names, "r_squared", "n_obs"])

    loadings = ", ".join(f"{c} double" for c in names)
    return gram.mapInPandas(solve, f"asset string, alpha_annualised double, {loadings}, r_squared double, n_obs long")


def sample_covariance(returns: DataFrame) -> DataFrame:
    """``(asset_i, asset_j, cov, n)`` of complete cases, both triangles."""
    centred = returns.withColumn("x", F.col("r") - F.avg("r").over(Window.partitionBy("asset"))).withColumn("_all", F.lit(1))
    return pair_sums(centred, ["_all"]).select("asset_i", "asset_j", (F.col("s") / (F.col("n") - 1)).alias("cov"), "n")


# ---------------------------------------------------------------- principal factors


def _partial_products(keys: list[str]):
    """For each key of a task's rows: Q'Q, Q'SQ and (SQ)'SQ over these rows."""

    def run(tables):
        for t in tables:
            out = []
            for key, part in t.groupby(keys, sort=False):
                q, y = np.stack(part["q"].to_numpy()), np.stack(part["y"].to_numpy())
                out.append((*key, (q.T @ q).ravel(), (q.T @ y).ravel()))
            yield pd.DataFrame(out, columns=[*keys, "c", "h"])

    return run


def _ritz(c: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values, greatest first, and coefficient columns of the Ritz vectors in a basis with products ``c`` and ``h`` = Q'SQ."""
    d, u = np.linalg.eigh((c + c.T) / 2)
    root = np.where(d > d[-1] * 1e-12, 1 / np.sqrt(np.maximum(d, 1e-300)), 0.0)
    f = u * root  # an orthonormal basis is Q f; directions that aren't there are 0
    values, vectors = np.linalg.eigh(f.T @ ((h + h.T) / 2) @ f)
    return values[::-1], (f @ vectors)[:, ::-1]


def principal_factors(returns: DataFrame, factors: int = 10, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """``(*by, asset, variance, loads)`` and ``(*by, n_factors, explained, cumulative)`` of complete cases.

    ``loads`` are the assets' components times the factors' deviations, so that their products are the common part of the covariances.
    A few more vectors than factors are turned towards the leading ones by block power steps: the covariances times the vectors are two
    aggregates, by date and by asset, and no matrix of assets is made; a task only meets products of a few vectors. Steps end when the factors' variances
    change by less than a share of ``STILL``. ``factors`` is held between 2 and 30 and below the numbers of assets and of dates; where no factor is possible it's an error.
    """
    keys = list(by) or ["_all"]
    rows = returns if by else returns.withColumn("_all", F.lit(1))
    x = written(rows.withColumn("x", F.col("r") - F.avg("r").over(Window.partitionBy(*keys, "asset"))).select(*keys, "asset", "dt", "x"), "centred")
    own = x.groupBy(*keys, "asset").agg((F.sum(F.col("x") * F.col("x")) / (F.count("*") - 1)).alias("variance"), F.count("*").alias("n"))
    facts = own.groupBy(*keys).agg(F.count("*").alias("assets"), F.min("n").alias("n"), F.sum("variance").alias("total"))
    k = F.least(F.greatest(F.lit(2), F.lit(min(factors, 30))), F.col("assets") - 1, F.col("n") - 1)
    facts = written(facts.select(*keys, "n", "total", k.cast("int").alias("k"), F.least(k + MORE, F.col("assets")).cast("int").alias("size")), "facts")
    least, size = facts.agg(F.min("k"), F.max("size")).first()
    if least is None or least < 1:
        raise ValueError("too few assets or dates for a factor")
    start = F.array(*((F.pmod(F.xxhash64("asset", F.lit(c)), F.lit(2000003)) / 1000001.0 - 1) for c in range(size)))
    q, before = own.select(*keys, "asset", start.alias("q")), None
    kinds = dict(x.dtypes)
    named = ", ".join(f"{c} {kinds[c]}" for c in keys)

    def solve(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        c, h = (np.sum(np.stack(table[name].to_numpy()), 0).reshape(size, size) for name in ("c", "h"))
        values, vectors = _ritz(c, h)
        return pd.DataFrame({**{n: [v] for n, v in zip(keys, key, strict=True)}, "values": [values.tolist()], "vectors": [vectors.T.ravel().tolist()]})

    while True:
        z = x.join(q, [*keys, "asset"]).groupBy(*keys, "dt").agg(F.array(*(F.sum(F.col("x") * F.col("q")[c]) for c in range(size))).alias("z"))
        y = x.join(z, [*keys, "dt"]).groupBy(*keys, "asset").agg(F.array(*(F.sum(F.col("x") * F.col("z")[c]) for c in range(size))).alias("y"))
        y = y.join(facts.select(*keys, "n"), keys).withColumn("y", F.transform("y", lambda v: v / (F.col("n") - 1))).drop("n")
        both = written(q.join(y, [*keys, "asset"]), "vectors")
        sums = both.mapInPandas(_partial_products(keys), f"{named}, c array<double>, h array<double>")
        found = written(sums.groupBy(*keys).applyInPandas(solve, f"{named}, values array<double>, vectors array<double>"), "ritz")
        now = np.array([v for (v,) in found.join(facts, keys).orderBy(*keys).select(F.slice("values", 1, F.col("k"))).toPandas().itertuples(index=False)], dtype=object)
        now = np.concatenate([np.asarray(v, float) for v in now])
        mixed = lambda column, scale: F.array(*(
            F.aggregate(F.zip_with(column, F.slice("vectors", 1 + c * size, size), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) * scale(F.col("values")[c]) for c in range(size)
        ))
        turned = both.join(found, keys)
        if before is not None and np.abs(now - before).max() <= STILL * np.abs(now).max():
            break
        # a power step on each Ritz vector
        q = turned.select(*keys, "asset", mixed("y", lambda v: F.when(v > 0, 1 / v).otherwise(0.0)).alias("q"))
        before = now
    loads = turned.join(facts.select(*keys, "k"), keys).withColumn("loads", F.slice(mixed("q", lambda v: F.sqrt(F.greatest(v, F.lit(0.0)))), 1, F.col("k")))
    share = F.transform(F.slice("values", 1, F.col("k")), lambda v: F.try_divide(v, F.col("total")))
    told = found.join(facts, keys).select(*by, F.col("k").alias("n_factors"), share.alias("explained"))
    told = told.withColumn("cumulative", F.aggregate("explained", F.lit(0.0), lambda s, v: s + v))
    return written(loads.join(own.select(*keys, "asset", "variance"), [*keys, "asset"]).select(*by, "asset", "variance", "loads"), "loads"), told


def pca_covariance(returns: DataFrame, factors: int = 10, periods: int = 52, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, asset_i, asset_j, cov)``: the part of the first principal factors plus each asset's own rest of variance, annualised."""
    loads, _ = principal_factors(returns, factors, by)
    left = loads.select(*by, F.col("asset").alias("asset_i"), "variance", F.col("loads").alias("a"), F.pmod(F.xxhash64("asset"), F.lit(PIECES)).alias("piece"))
    right = loads.select(*by, F.col("asset").alias("asset_j"), F.col("loads").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PIECES - 1).cast("long"))).alias("piece"))
    common = F.aggregate(F.zip_with("a", "b", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    pairs = left.join(right, [*by, "piece"]).select(*by, "asset_i", "asset_j", "variance", common.alias("common"))
    rest = F.when(F.col("asset_i") == F.col("asset_j"), F.greatest(F.col("variance") - F.col("common"), F.lit(LEAST_VARIANCE))).otherwise(0.0)
    return pairs.select(*by, "asset_i", "asset_j", ((F.col("common") + rest) * periods).alias("cov"))
