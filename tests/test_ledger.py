import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger


def folded(rows):
    """The position rule, bar by bar."""
    out, pos = [], 0
    for le, lx, se, sx in rows:
        if le and lx:
            le = lx = False
        if se and sx:
            se = sx = False
        if le and se:
            le = se = False
        if pos > 0:
            pos = -1 if se else 0 if lx else 1
        elif pos < 0:
            pos = 1 if le else 0 if sx else -1
        else:
            pos = 1 if le else -1 if se else 0
        out.append(pos)
    return out


def test_native_position_is_the_ordered_fold(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.random((4000, 4)) < 0.2, columns=ledger.FLAGS)
    pdf["series"], pdf["ts"], pdf["close"] = np.repeat([f"s{i}" for i in range(80)], 50), np.tile(pd.date_range("2024-01-01", periods=50, freq="h"), 80), rng.uniform(90, 110, 4000)
    got = ledger.net_position(spark.createDataFrame(pdf)).toPandas().sort_values(["series", "ts"])
    want = np.concatenate([folded(g[list(ledger.FLAGS)].to_numpy().tolist()) for _, g in pdf.groupby("series")])
    assert np.array_equal(got["held"], want)
    trades = ledger.trades(ledger.net_position(spark.createDataFrame(pdf))).toPandas()
    opened = sum(sum(1 for a, b in zip([0, *w], w) if b and a != b) for w in (folded(g[list(ledger.FLAGS)].to_numpy().tolist()) for _, g in pdf.groupby("series")))
    assert len(trades) == opened


def test_equity_and_drawdown_start_at_par(spark):
    pdf = pd.DataFrame({"series": "s", "ts": pd.date_range("2024-01-01", periods=4), "ret": [-0.1, 0.0, 0.05, -0.2]})
    got = ledger.equity_curve(spark.createDataFrame(pdf)).toPandas().sort_values("ts")
    assert np.allclose(got["equity"], np.cumprod(1 + pdf["ret"])) and np.isclose(got["drawdown"].iloc[0], -0.1)
    x = ledger.risk_statistics(ledger.equity_curve(spark.createDataFrame(pdf)), 365).first()
    assert np.isclose(x["total_return"], got["equity"].iloc[-1] - 1) and x["drawdown_bars"] == 4
    ruin = pdf.assign(ret=[-0.1, -1.0, 0.5, 0.5])
    assert ledger.equity_curve(spark.createDataFrame(ruin)).where("equity = 0").count() == 3


def test_stops_close_inside_the_bar_and_allow_a_new_entry(spark):
    pdf = pd.DataFrame({"series": "s", "ts": pd.date_range("2024-01-01", periods=5), "open": [10.0, 10, 9, 10, 10], "high": [10.5, 10, 9, 11, 11], "low": [9.5, 9.9, 8, 10, 10], "close": [10.0, 10, 8.5, 10, 10], "long_entry": [True, False, False, True, False], "long_exit": False, "short_entry": False, "short_exit": False, "setup_stop": [0.05, None, None, 0.05, None]})
    got = ledger.stopped_positions(spark.createDataFrame(pdf)).toPandas().sort_values("ts")
    assert got["held"].tolist() == [1, 1, 0, 1, 1] and got["stop_hit"].iloc[2] == 9.0


def test_costs_of_a_round_trip(spark):
    pdf = pd.DataFrame({"series": "s", "ts": pd.date_range("2024-01-01", periods=3), "close": [100.0, 110, 120], "held": [1, 1, 0]})
    t = ledger.trades(spark.createDataFrame(pdf), 1000.0, 0.5, 0.001, 0.01).first()
    entry, leave, q = 101.0, 118.8, 5.0
    assert np.isclose(t["pnl"], q * (leave - entry) - 0.001 * q * (entry + leave)) and t["status"] == "closed"
    free = ledger.trades(spark.createDataFrame(pdf), 1000.0, 0.5, 0.0, 0.0)
    s = ledger.stressed(spark.createDataFrame(pdf), (2.0,), 0.001, 0.01)
    w = ledger.cost_waterfall(ledger.trades(s, 1000.0, 0.5, F.col("fee_rate"), F.col("slippage_rate"), ("series", "multiple", "fee_rate", "slippage_rate")), free, cash=1000.0).toPandas()
    assert set(w["multiple"]) == {1.0, 2.0}
    assert np.allclose(w["gross_return"] * 1000 - w["fees"] - w["slippage"] - w["funding"] - w["size_effect"], w["net_return"] * 1000)


def test_exit_modes_are_checked(spark, walk):
    from tidemark.plans import strategies

    x = strategies.turnaround_v1(spark.createDataFrame(walk(100, 1)), warmup=5)
    with pytest.raises(ValueError):
        ledger.with_exits(x, "trend_structure")
    with pytest.raises(ValueError):
        ledger.with_exits(x, "trend_failure")
    with pytest.raises(ValueError):
        ledger.with_exits(x, "other")


def test_band_keeps_the_last_submitted_level(spark):
    pdf = pd.DataFrame({"series": "s", "ts": pd.date_range("2024-01-01", periods=5), "close": 1.0, "target": [0.0, 0.05, 0.12, 0.2, 0.25]})
    got = ledger.banded(spark.createDataFrame(pdf), 0.1).toPandas().sort_values("ts")["submitted"]
    assert got.isna().tolist() == [False, True, False, True, False]
