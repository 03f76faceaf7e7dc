"""Products of blocks of assets against plain sums, with gaps, several groups, repeated rows and values that aren't finite."""

from __future__ import annotations

import datetime
import math

import numpy as np
import pandas as pd
import pytest

from panelwright.operators import metrics, moments

DAYS = [datetime.date(1999, 12, 27) + datetime.timedelta(30 * i) for i in range(40)]


@pytest.fixture
def values():
    rng = np.random.default_rng(3)
    rows = [(w, f"a{i:02d}", d, float(rng.normal())) for w in (1, 2) for i in range(14) for d in DAYS if rng.random() < 0.8 and not (w == 2 and i == 5)]
    rows += [(1, "late", DAYS[-1], 2.0), (1, "early", DAYS[0], 3.0), (1, "null", DAYS[0], None)]
    return rows + [(1, "a03", *r[2:]) for r in rows if r[:2] == (1, "a03")][:3]


@pytest.mark.parametrize("block", [3, 256])
def test_pair_moments_are_the_plain_sums(spark, monkeypatch, values, block):
    monkeypatch.setattr(moments, "BLOCK", block)
    df = spark.createDataFrame(values, "window int, asset string, dt date, x double")
    got = {(r.window, r.asset_i, r.asset_j): (r.n, *(round(v, 9) for v in (r.s, r.sx, r.sy, r.sxx, r.syy))) for r in moments.pair_moments(df, ["window"]).collect()}
    t = pd.DataFrame([v for v in values if v[3] is not None], columns=["window", "asset", "dt", "x"])
    pairs = t.merge(t, on=["window", "dt"], suffixes=("_i", "_j"))
    pairs = pairs[pairs.asset_i <= pairs.asset_j]
    want = {
        k: (len(g), *(round(v, 9) for v in ((g.x_i * g.x_j).sum(), g.x_i.sum(), g.x_j.sum(), (g.x_i**2).sum(), (g.x_j**2).sum())))
        for k, g in pairs.groupby(["window", "asset_i", "asset_j"])
    }
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-8) for k in want)
    assert (1, "early", "late") not in got
    both = {(r.window, r.asset_i, r.asset_j) for r in moments.pair_sums(df, ["window"]).collect()}
    assert both == set(want) | {(w, j, i) for w, i, j in want}


def test_values_that_are_not_finite_spoil_their_pairs_only(spark):
    rows = [("a", DAYS[0], float("inf")), ("a", DAYS[1], 1.0), ("b", DAYS[0], 1.0), ("c", DAYS[1], 2.0)]
    df = spark.createDataFrame(rows, "asset string, dt date, x double")
    got = {(r.asset_i, r.asset_j): r.s for r in moments.pair_moments(df, []).collect()}
    assert math.isnan(got["a", "a"]) and math.isnan(got["a", "b"])
    assert (got["a", "c"], got["b", "b"], got["c", "c"]) == (2.0, 1.0, 4.0)


def test_no_rows(spark):
    df = spark.createDataFrame([], "asset string, dt date, x double")
    assert moments.pair_moments(df, []).count() == 0
    assert metrics.correlation(df.withColumnRenamed("x", "r")).count() == 0


def test_correlation_on_shared_dates(spark, monkeypatch, values):
    monkeypatch.setattr(moments, "BLOCK", 5)
    rows = [v[1:] for v in values if v[0] == 2] + [("flat", d, 0.1) for d in DAYS]
    got = {(r.asset_i, r.asset_j): r.corr for r in metrics.correlation(spark.createDataFrame(rows, "asset string, dt date, r double")).collect()}
    wide = pd.DataFrame(rows, columns=["asset", "dt", "r"]).pivot(index="dt", columns="asset", values="r")
    want = wide.corr()
    for i in wide:
        for j in wide:
            if i <= j and "flat" not in (i, j):
                assert got[i, j] == pytest.approx(want.loc[i, j], abs=1e-12)
    assert got["a00", "flat"] is None and got["flat", "flat"] is None
