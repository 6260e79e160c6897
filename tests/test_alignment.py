import pandas as pd
import pytest

from tidemark.operators import align
from tidemark.sources import bars as b


def frames(spark, bars, funding):
    x = spark.createDataFrame(pd.DataFrame({"series": "s", "ts": pd.to_datetime(bars, format="mixed"), "open": 1.0, "close": 1.0}))
    f = spark.createDataFrame(pd.DataFrame({"series": "s", "settled": pd.to_datetime(funding, format="mixed"), "rate": [0.1 * (i + 1) for i in range(len(funding))]}))
    return x, f


def test_settlements_belong_to_the_bar_that_contains_them(spark):
    bars = ["2024-01-01 00:00", "2024-01-01 04:00", "2024-01-01 08:00"]
    funding = ["2024-01-01 03:59:59.999", "2024-01-01 04:00", "2024-01-01 04:00:00.047", "2023-12-31 23:00", "2024-01-01 11:59", "2024-01-01 12:00"]
    got = align.with_funding(*frames(spark, bars, funding)).toPandas().sort_values("ts")["funding_rate"].round(6).tolist()
    assert got == [0.1, 0.5, 0.5]


def test_coverage_needs_a_repeated_cadence(spark):
    bars = pd.date_range("2024-01-01", periods=12, freq="4h")
    whole = pd.date_range("2024-01-01", periods=6, freq="8h")
    assert align.coverage_gaps(*frames(spark, bars, whole)).count() == 0
    assert align.coverage_gaps(*frames(spark, bars, whole.delete(3))).count() == 1
    assert align.coverage_gaps(*frames(spark, bars, whole.delete([0]))).count() == 1
    two = align.coverage_gaps(*frames(spark, bars, whole[[0, 2]])).toPandas()
    assert len(two) == 1 and two["gap_end"].iloc[0] == pd.Timestamp("2024-01-03")
    with pytest.raises(ValueError):
        align.attach_funding(*frames(spark, bars, whole.delete(3)))


def test_reason_diff_tells_missing_names_from_nulls(spark):
    schema = "series string, ts timestamp, feature_names array<string>, feature_values array<double>"
    at = pd.Timestamp("2024-01-01").to_pydatetime()
    a = spark.createDataFrame([("s", at, ["x", "y"], [1.0, None])], schema)
    c = spark.createDataFrame([("s", at, ["x", "z"], [1.0, None])], schema)
    got = {(r["name"], r["difference"]) for r in align.reason_diff(a, c).collect()}
    assert got == {("y", "only in a"), ("z", "only in b")}


def test_upsert_keeps_the_newest_version(spark):
    schema = "k string, v double, updated_at timestamp"
    t = [pd.Timestamp(f"2024-01-0{i}").to_pydatetime() for i in (1, 2)]
    old = spark.createDataFrame([("a", 1.0, t[1]), ("b", 1.0, t[0])], schema)
    new = spark.createDataFrame([("a", 2.0, t[0]), ("b", 2.0, t[0]), ("c", 2.0, t[0])], schema)
    assert {r["k"]: r["v"] for r in b.upsert(old, new, ("k",)).collect()} == {"a": 1.0, "b": 2.0, "c": 2.0}


def test_append_only_sink_skips_what_is_stored(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("b", 3)], "k string, v int")
    assert [(r["k"], r["v"]) for r in b.append_new(old, new, ["k"]).collect()] == [("b", 3)]


def test_written_partitions_are_overwritten_alone(spark, tmp_path, sf_dir):
    x = b.keyed_bars(spark, sf_dir)
    b.write_bars(x, str(tmp_path / "bars"))
    perp = x.where("market_type = 'perp'").limit(0)
    b.write_bars(perp, str(tmp_path / "bars"))
    assert spark.read.parquet(str(tmp_path / "bars")).count() == x.count()
