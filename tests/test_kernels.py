import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.functions import windows as k


def by_series(pdf, f):
    return pd.concat([f(g.sort_values("ts")) for _, g in pdf.groupby("series")])


def test_exponential_means_match_the_recursion(spark, walk):
    pdf = walk(700, 2)
    got = k.ema_columns(spark.createDataFrame(pdf), {"a": ("close", 3), "b": ("close", 24), "c": ("close", 200)}).toPandas().sort_values(["series", "ts"])
    for name, span in (("a", 3), ("b", 24), ("c", 200)):
        want = by_series(pdf, lambda g: g["close"].ewm(span=span, adjust=False).mean())
        assert np.allclose(got[name], want, rtol=1e-11)


def test_ew_std_matches_with_leading_nulls(spark, walk):
    pdf = walk(300, 1)
    df = spark.createDataFrame(pdf).withColumn("r", k.pct_change(F.col("close")))
    got = k.ew_std(df, "v", "r", 20).toPandas().sort_values("ts")["v"]
    want = pdf["close"].pct_change().ewm(span=20, adjust=False).std()
    assert np.allclose(got[2:], want[2:], rtol=1e-8) and got[:2].isna().all()


def test_trailing_kernels_match_pandas(spark, walk):
    pdf = walk(300, 1)
    c = F.col("close")
    df = spark.createDataFrame(pdf).select("ts", k.rolling_mean(c, 20).alias("m"), k.rolling_std(c, 20).alias("s"), k.rolling_percentile(c, 20).alias("p"), k.rolling_zscore(c, 20).alias("z"))
    got, r = df.toPandas().sort_values("ts"), pdf["close"].rolling(20)
    assert np.allclose(got["m"], r.mean(), equal_nan=True) and np.allclose(got["s"], r.std(), equal_nan=True)
    assert np.allclose(got["z"], (pdf["close"] - r.mean()) / r.std(), equal_nan=True)
    assert np.allclose(got["p"], r.rank() / 20, equal_nan=True)


def test_flat_series_have_no_division_by_zero(spark, walk):
    pdf = walk(80, 1).assign(open=5.0, high=5.0, low=5.0, close=5.0)
    df = spark.createDataFrame(pdf)
    from tidemark.operators.features import feature_frame

    got = feature_frame(df, 3, 6, 3, 6, 12, 3).toPandas().sort_values("ts").iloc[40:]
    assert (got["strength"] == 0).all() and (got["stability"] == 1).all() and (got["direction"] == 0).all() and (got["persistence"] == 0).all()


def test_warmups_are_checked(spark, walk):
    with pytest.raises(ValueError):
        k.warmed(F.col("close"), -1)
    with pytest.raises(ValueError):
        k.require_length(spark.createDataFrame(walk(10, 1)), 10)


def test_timeframes():
    assert times.timeframe_ms("4h") == 14_400_000 and times.timeframe_ms("1w") == times.timeframe_ms("1wk")
    with pytest.raises(ValueError):
        times.timeframe_ms("1M")


def test_chunks_with_halos_equal_the_whole_series(spark, walk):
    from tidemark.functions import halo

    pdf = walk(400, 2)
    pdf = pdf[(pdf.index % 400 < 100) | (pdf.index % 37 == 0) | (pdf.index % 400 > 300)]  # gaps: some chunks have a row or none
    df, c = spark.createDataFrame(pdf), F.col("close")
    kernel = lambda x: x.withColumns({"m": k.rolling_max(c, 25), "r": k.pct_change(c, 10), "n": F.count("close").over(k.trailing(25))})
    whole, cut = (x.select("series", "ts", "m", "r", "n") for x in (kernel(df), halo.in_chunks(df, 3 * 3_600_000, 24, kernel)))
    assert whole.exceptAll(cut).isEmpty() and cut.exceptAll(whole).isEmpty() and cut.count() == len(pdf)
