"""Altering the future must not move the past: for features and for every generator."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import features
from tidemark.plans import strategies

CUT = 220


def poisoned(pdf: pd.DataFrame, flat: bool) -> pd.DataFrame:
    out = pdf.copy()
    late = out.groupby("series").cumcount() > CUT
    if flat:
        out.loc[late, ["open", "high", "low", "close"]] = 1e6
    else:
        up = np.arange(late.sum()) % 2 == 0
        out.loc[late, "open"], out.loc[late, "close"] = np.where(up, 10.0, 500.0), np.where(up, 500.0, 10.0)
        out.loc[late, "high"], out.loc[late, "low"] = 600.0, 5.0
    out.loc[late, "volume"] = 1e9
    return out


def past(df, columns):
    x = df.toPandas().sort_values(["series", "ts"])
    return x[x.groupby("series").cumcount() <= CUT][columns].astype(float).to_numpy()


@pytest.mark.parametrize("flat", [True, False])
def test_features(spark, walk, flat):
    pdf, names = walk(300, 2), ["direction", "strength", "persistence", "stability", "energy", "compression_release", "participation"]
    build = lambda p: past(features.feature_frame(spark.createDataFrame(p), 4, 12, 4, 12, 30, 6), names)
    a, b = build(pdf), build(poisoned(pdf, flat))
    assert np.array_equal(np.isnan(a), np.isnan(b)) and np.allclose(a, b, rtol=1e-9, equal_nan=True)
    assert (~np.isnan(a)).sum(0).min() > 50


OPTIONS = {"turnaround_v1": {"warmup": 10}, "turnaround_v2": {"warmup": 10, "trend": 20, "extension": 5, "low": 1.2, "high": 0.8}, "ema_cross": {"fast": 5, "slow": 20, "warmup": 10}, "tsmom": {"lookback": 10}, "donchian": {"entry": 20, "leave": 10}, "multi_horizon": {"lookbacks": (5, 10), "vol": 10}}


@pytest.mark.parametrize("name", sorted(strategies.BUILDERS))
def test_generators(spark, walk, name):
    pdf, flags = walk(300, 2), ["long_entry", "long_exit", "short_entry", "short_exit"]
    build = lambda p: past(strategies.BUILDERS[name](spark.createDataFrame(p), **OPTIONS.get(name, {})), flags)
    a, b = build(pdf), build(poisoned(pdf, False))
    assert np.array_equal(a, b) and a[:, 0].sum() > 0


def test_all_signals_equal_each_generator(spark, walk):
    df, names = spark.createDataFrame(walk(300, 2)), ["turnaround_v2", "tsmom", "donchian", "trend_rider"]
    tall = strategies.all_signals(df, names, **OPTIONS)
    for n in names:
        one = strategies.BUILDERS[n](df, **OPTIONS.get(n, {})).select("series", "ts", *strategies.FLAGS)
        other = tall.where(f"strategy = '{n}'").select("series", "ts", *strategies.FLAGS)
        assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()
