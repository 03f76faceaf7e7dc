"""Means, covariances and what follows from them and given weights, as distributed aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Assets of a block: a task holds two blocks over ten years of dates and the products of their assets.
BLOCK = 256

_SUMS = ("s", "sx", "sy", "sxx", "syy")


def historical_mu(returns: DataFrame, periods: int = 52, by: tuple[str, ...] = ()) -> DataFrame:
    """Annualised compounded mean of each asset's own returns."""
    known = returns.filter("r is not null")
    return known.groupBy(*by, "asset").agg((F.pow(F.product(1 + F.col("r")), F.lit(float(periods)) / F.count("*")) - 1).alias("mu"))


def pair_moments(values: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, asset_i, asset_j, n, s, sx, sy, sxx, syy)`` with asset_i <= asset_j, for pairs of assets that share a date.

    ``values(*by, asset, dt, x)`` gives, over the shared dates, their number and the sums of x_i x_j, x_i, x_j and the squares. Assets
    are dealt into blocks of about ``BLOCK`` by hash. A task multiplies two blocks over ten years of dates as matrices, so a value is
    shuffled once for each block and a pair once for each ten years, whatever the number of dates or the size of a ``by`` group. Null
    values count for nothing; a value that isn't finite makes the sums of its pairs NaN.
    """
    kinds = {f.name: f.dataType for f in values.schema}
    known = values.filter("x is not null").select(*by, "asset", "dt", F.col("x").cast("double").alias("x"))
    blocks = known.agg(F.greatest(F.lit(1), F.ceil(F.countDistinct("asset") / BLOCK)).cast("int").alias("blocks"))
    dealt = known.join(F.broadcast(blocks)).withColumn("block", F.pmod(F.xxhash64("asset"), F.col("blocks")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *by, "asset", "dt", "x", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.floor(F.year("dt") / 10).alias("decade")
    )

    def multiply(table: pa.Table) -> pa.Table:
        table = table.sort_by("asset").combine_chunks()  # so that an earlier place is a lesser name
        asset, date = (table.column(c).combine_chunks().dictionary_encode("encode") for c in ("asset", "dt"))
        asset, date = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (asset, date))
        at = date.indices.to_numpy(), asset.indices.to_numpy()
        block = np.zeros(len(asset.dictionary), int)
        block[at[1]] = table.column("block").to_numpy()
        x, q, m, bad = np.zeros((4, len(date.dictionary), len(block)))
        value = table.column("x").to_numpy()
        finite = np.isfinite(value)
        np.add.at(x, at, np.where(finite, value, 0))
        np.add.at(q, at, np.where(finite, value, 0) ** 2)
        np.add.at(m, at, 1)
        np.add.at(bad, at, ~finite)
        n, spoilt = m.T @ m, bad.T @ m
        apart = table.column("low")[0] != table.column("high")[0]
        wanted = block[:, None] != block if apart else np.ones_like(n, bool)
        i, j = np.nonzero(np.triu((n > 0) & wanted))
        clean = np.where((spoilt + spoilt.T)[i, j] > 0, np.nan, 1.0)
        sx, sxx = x.T @ m, q.T @ m
        sums = [(x.T @ x)[i, j], sx[i, j], sx[j, i], sxx[i, j], sxx[j, i]]
        return pa.table(
            [*(pa.repeat(table.column(c)[0], len(i)) for c in by), asset.dictionary.take(pa.array(i)), asset.dictionary.take(pa.array(j))]
            + [pa.array(n[i, j].astype(np.int64)), *(pa.array(v * clean) for v in sums)],
            names=[*by, "asset_i", "asset_j", "n", *_SUMS],
        )

    fields = [*((c, kinds[c]) for c in by), ("asset_i", kinds["asset"]), ("asset_j", kinds["asset"]), ("n", T.LongType()), *((c, T.DoubleType()) for c in _SUMS)]
    parts = cells.groupBy(*by, "low", "high", "decade").applyInArrow(multiply, T.StructType([T.StructField(*f) for f in fields]))
    return parts.groupBy(*by, "asset_i", "asset_j").agg(*(F.sum(c).alias(c) for c in ("n", *_SUMS)))


def pair_sums(values: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, asset_i, asset_j, s, n)``: sums over dates of the products x_i x_j of ``values(*by, asset, dt, x)``, both triangles."""
    pair, turned = F.struct("asset_i", "asset_j"), F.struct(F.col("asset_j").alias("asset_i"), F.col("asset_i").alias("asset_j"))
    both = F.when(F.col("asset_i") == F.col("asset_j"), F.array(pair)).otherwise(F.array(pair, turned))
    return pair_moments(values, by).select(*by, F.inline(both), "s", "n")


def ledoit_wolf(returns: DataFrame, periods: int = 52, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, asset_i, asset_j, cov)``: shrinkage of the sample covariance to a multiple of the identity, annualised.

    ``returns`` must be complete cases. The shrinkage intensity is a one-pass sum over dates, so the only
    wide step is the join by date, whose output is aggregated by pair at once.
    """
    keys = list(by) or ["_all"]
    returns = returns if by else returns.withColumn("_all", F.lit(1))
    centred = returns.withColumn("x", F.col("r") - F.avg("r").over(Window.partitionBy(*keys, "asset")))
    s = pair_sums(centred, keys).select(*keys, "asset_i", "asset_j", (F.col("s") / F.col("n")).alias("s"))
    facts = s.groupBy(*keys).agg(
        F.sum(F.when(F.col("asset_i") == F.col("asset_j"), F.col("s"))).alias("trace"), F.sum(F.col("s") * F.col("s")).alias("s2"),
        F.sqrt(F.count("*")).alias("k"),
    )
    norms = centred.groupBy(*keys, "dt").agg(F.sum(F.col("x") * F.col("x")).alias("q"))
    fourth = norms.groupBy(*keys).agg(F.sum(F.col("q") * F.col("q")).alias("q2"), F.count("*").alias("n"))
    m = F.col("trace") / F.col("k")
    delta2 = F.col("s2") / F.col("k") - m * m
    beta2 = F.least((F.col("q2") / F.col("n") - F.col("s2")) / (F.col("n") * F.col("k")), delta2)
    shrink = facts.join(fourth, keys).select(*keys, m.alias("m"), F.coalesce(F.try_divide(beta2, delta2), F.lit(0.0)).alias("shrinkage"))
    target = F.when(F.col("asset_i") == F.col("asset_j"), F.col("m")).otherwise(0.0)
    value = ((1 - F.col("shrinkage")) * F.col("s") + F.col("shrinkage") * target) * periods
    return s.join(shrink, keys).select(*by, "asset_i", "asset_j", value.alias("cov"))


def portfolio_statistics(weights: DataFrame, mu: DataFrame, cov: DataFrame, rf: float = 0.04) -> DataFrame:
    """Expected return, volatility, Sharpe ratio, diversification ratio and concentration of each portfolio.

    Weights are laid on the assets of ``mu`` and ``cov``: an asset without a weight has weight 0.
    """
    wi = weights.select("portfolio", F.col("asset").alias("asset_i"), F.col("w").alias("wi"))
    wj = weights.select("portfolio", F.col("asset").alias("asset_j"), F.col("w").alias("wj"))
    # pairs with a weight of 0 add nothing, so the inner joins are the whole sum
    pairs = wi.join(cov, "asset_i").join(wj, ["portfolio", "asset_j"])
    risk = pairs.groupBy("portfolio").agg(
        F.sqrt(F.sum(F.col("wi") * F.col("wj") * F.col("cov"))).alias("volatility"),
        F.sum(F.when(F.col("asset_i") == F.col("asset_j"), F.abs("wi") * F.sqrt("cov"))).alias("parts"),
    )
    gain = weights.join(mu, "asset", "left").groupBy("portfolio").agg(
        F.sum(F.col("w") * F.coalesce("mu", F.lit(0.0))).alias("expected_return"), F.sum(F.col("w") * F.col("w")).alias("hhi")
    )
    vol = F.nullif("volatility", F.lit(0.0))
    return gain.join(risk, "portfolio", "left").select(
        "portfolio", "expected_return", "volatility", F.try_divide(F.col("expected_return") - rf, vol).alias("sharpe"),
        F.try_divide(F.col("parts"), vol).alias("diversification_ratio"), "hhi",
    )


def greatest_return(mu: DataFrame, low: float, high: float) -> DataFrame:
    """Weights in [low, high] with sum 1 and the greatest return: filled from the best asset down.

    One row per asset, so the single ordered window is over as many rows as there are assets. A ``high`` too small for the weights to
    reach 1 is raised to 1 / n; a ``low`` that is too large lowered to it.
    """
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("mu"), "asset"))
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    low, high = F.least(F.lit(low), 1 / n), F.greatest(F.lit(high), 1 / n)
    room = 1 - n * low - (rank - 1) * (high - low)
    return mu.select("asset", "mu", (low + F.least(F.greatest(room, F.lit(0.0)), high - low)).alias("w"))
