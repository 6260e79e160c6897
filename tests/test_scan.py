"""Chunked walks and bands give the rows of the plain folds; the containment join in ranges that of a plain search."""

import random

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tidemark.functions import windows
from tidemark.operators import align, ledger, lifecycle


def plain_band(x, threshold, held=0.0):
    out = []
    for i, v in enumerate(x):
        if abs(v - held) >= threshold:
            out.append(i)
            held = v
    return out, held


@pytest.mark.parametrize("seed", range(30))
def test_band_by_jumps(seed):
    rng = np.random.default_rng(seed)
    x = np.round(np.clip(np.cumsum(rng.normal(0, 0.1, rng.integers(1, 200))), -1, 1), int(rng.integers(1, 4)))
    threshold, held = float(rng.choice([0.05, 0.2, 0.25, 3.0])), float(rng.choice([0.0, 0.3, -0.8]))
    places, end = plain_band(x, threshold, held)
    assert ledger.band_chain(x, threshold, held) == places
    assert ledger.band_advance(held, ledger.band_summary(x, threshold), threshold) == end


@pytest.mark.parametrize("seed", range(10))
def test_chunk_maps_equal_the_walk(seed):
    rng = random.Random(seed)
    m = lifecycle.Lifecycle(min_dwell=rng.randint(1, 4), cooldown=rng.randint(0, 5), exhaustion_dwell=rng.randint(1, 6))
    table = lifecycle.moves(m)
    calm = rng.random()
    rows = [(lifecycle.ADVANCING * (rng.random() < calm) | lifecycle.FAILING * (rng.random() < 0.05) | lifecycle.CROWDED * (rng.random() < 0.1), rng.choice([-1, 0, 1]), rng.random() < 0.5) for _ in range(60)]
    ends, shape, d = lifecycle.chunk_map(table, rows), lifecycle.configurations(table), table.shape[3] // 2
    for number in rng.sample(range(len(ends)), 50):
        at = [int(v) for v in np.unravel_index(number, shape)]
        at = (at[0], at[1], at[2] - d, at[3] - 1)
        for row in rows:
            at = lifecycle.moved(table, at, *row)
        assert ends[number] == np.ravel_multi_index((at[0], at[1], at[2] + d, at[3] + 1), shape)


def test_walk_and_band_over_chunks(spark, walk):
    pdf = walk(300, 2, 3)
    rng = np.random.default_rng(1)
    pdf = pdf.assign(direction=rng.normal(0, 0.5, len(pdf)).clip(-1, 1), strength=rng.random(len(pdf)), stability=rng.random(len(pdf)), crowding=0.5, energy=rng.random(len(pdf)), target=np.where(rng.random(len(pdf)) < 0.05, None, np.round(np.sin(np.arange(len(pdf)) / 9) + rng.normal(0, 0.1, len(pdf)), 2)))
    df = spark.createDataFrame(pdf.astype({"target": float}))
    m = lifecycle.Lifecycle(enter_strength=0.3, exit_strength=0.05, direction_floor=0.01, stability_floor=0.01, min_dwell=1, cooldown=2, exhaustion_dwell=3)
    a, b = lifecycle.walk(df, m, keep=("close",)), lifecycle.walk(df, m, keep=("close",), chunk_ms=6 * 3_600_000)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.select("state").distinct().count() > 3
    df = df.replace(float("nan"), None, subset=["target"])
    a, b = ledger.banded(df, 0.2).toPandas(), ledger.banded(df, 0.2, chunk_ms=6 * 3_600_000).toPandas()
    for s, x in a.sort_values("ts").groupby("series"):
        y = b[b["series"] == s].sort_values("ts")
        known = x[x["target"].notna()]
        places, _ = plain_band(known["target"].to_numpy(), 0.2)
        assert list(x[x["submitted"].notna()]["ts"]) == list(known.iloc[places]["ts"]) == list(y[y["submitted"].notna()]["ts"])
    empty = ledger.banded(df.limit(0), 0.2, chunk_ms=1000)
    assert empty.isEmpty() and empty.columns == [*df.columns, "submitted"]
    with pytest.raises(ValueError, match="negative"):
        ledger.banded(df, -0.1)


@pytest.mark.parametrize("width", [600_000, 86_400_000])
def test_containment_in_ranges(spark, walk, width):
    """Sparse bars, so that some ranges have settlements alone; several settlements a bar, some before the first and past the last one."""
    rng, pdf = np.random.default_rng(4), walk(60, 3, 8)
    start, end = pdf["ts"].min() - pd.Timedelta("3h"), pdf["ts"].max() + pd.Timedelta("5h")
    at = start + pd.to_timedelta(rng.random(400) * (end - start).total_seconds(), unit="s").floor("ms")
    funding = pd.DataFrame({"series": rng.choice(["s0", "s1", "s2", "other"], 400), "settled": at, "rate": np.where(rng.random(400) < 0.1, np.nan, rng.normal(0, 1, 400))})
    funding.loc[:20, "settled"] = rng.choice(pdf["ts"], 21)
    df, f = spark.createDataFrame(pdf), spark.createDataFrame(funding).replace(float("nan"), None, subset=["rate"])
    got = {(r.series, r.ts, r.settled, r.rate) for r in align.contained(df, f, width).toPandas().itertuples()}
    want = set()
    for s, x in pdf.sort_values("ts").groupby("series"):
        opens = x["ts"].to_numpy()
        last = opens[-1] + np.median(np.diff(opens).astype("int64") // 1_000_000).astype("timedelta64[ms]")
        for r in funding[(funding["series"] == s) & funding["rate"].notna()].itertuples():
            i = np.searchsorted(opens, np.datetime64(r.settled), side="right") - 1
            if i >= 0 and np.datetime64(r.settled) < last:
                want.add((s, pd.Timestamp(opens[i]), r.settled, r.rate))
    assert got == want and len(got) > 150


def test_ranks_by_sorted_windows(spark, walk):
    rng, pdf = np.random.default_rng(6), walk(200, 2, 9)
    pdf = pdf.assign(x=np.where(rng.random(len(pdf)) < 0.02, np.nan, np.round(rng.normal(0, 1, len(pdf)), 1)))
    df = spark.createDataFrame(pdf).replace(float("nan"), None, subset=["x"])
    want = df.select("series", "ts", windows.rolling_percentile(F.col("x"), 15).alias("rx"), windows.rolling_percentile(F.col("volume"), 30).alias("rv"))
    for chunk in (None, 4 * 3_600_000):
        got = windows.rank_columns(df, {"rx": ("x", 15), "rv": ("volume", 30)}, chunk).select("series", "ts", "rx", "rv")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
