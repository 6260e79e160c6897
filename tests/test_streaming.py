"""Streams give the rows of the batch rules, whatever the micro-batches, late bars and corrections."""

import json
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.windows import series_window
from tidemark.operators import features, ledger, lifecycle
from tidemark.plans import strategies
from tidemark.streaming import engine
from tidemark.streaming.rules import FIELDS, SIDES, make

MACHINE = {"enter_strength": 0.5, "exit_strength": 0.25, "direction_floor": 0.02, "stability_floor": 0.05, "min_dwell": 2, "cooldown": 3, "exhaustion_dwell": 4}
WINDOWS = {"fast": 5, "slow": 12, "atr": 5, "span": 12, "rank": 40, "vol": 5}
OPTIONS = {
    "turnaround_v1": {"warmup": 5}, "turnaround_v2": {"trend": 30, "extension": 5, "low": 1.001, "high": 0.999, "warmup": 20}, "sma_pullback": {"span": 12, "warmup": 12}, "trend_rider": {"span": 12, "period": 9, "allow_shorts": True, "warmup": 12},
    "tsmom": {"lookback": 17}, "ema_cross": {"fast": 4, "slow": 9, "warmup": 30}, "donchian": {"entry": 14, "leave": 6}, "multi_horizon": {"lookbacks": (3, 8), "vol": 11, "threshold": 0.2},
    "state_machine_v1": {"machine": MACHINE, "warmup": 60, **WINDOWS}, "state_machine_v2": {"machine": MACHINE, "warmup": 60, "band": 0.1, **WINDOWS},
}


class Held:
    """State in memory with the calls that the processors make."""

    def __init__(self):
        self.value, self.items, self.map = None, [], {}

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value if self.value is not None else iter(self.items)

    def update(self, v):
        self.value = v

    def put(self, v):
        self.items = list(v)

    def appendList(self, v):
        self.items += list(v)

    def clear(self):
        self.items = []

    def iterator(self):
        return iter(list(self.map.items()))

    def updateValue(self, k, v):
        self.map[k] = v

    def removeKey(self, k):
        self.map.pop(k)


class Handle:
    def getListState(self, *a):
        return Held()

    getValueState = getMapState = getListState


def stream(pdf, rules, batches, **more):
    """All rows of a series in micro-batches given as lists of row numbers."""
    p = engine.SignalProcessor(rules, **more)
    p.init(Handle())
    out = [x for b in batches for x in p.handleInputRows(("s",), iter([pdf.iloc[b]]), None)]
    out = [x.astype({"side": object, "level": float, "state": object, "features": object}) for x in out]
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["strategy", "ts", "kind", "side", "revision"]), p


def newest(x):
    last = x.groupby(["strategy", "ts"])["revision"].transform("max")
    return x[(x["revision"] == last) & (x["kind"] != "retract")]


def sides(x, name):
    x = newest(x)
    return {(r.ts, r.side) for r in x[(x["strategy"] == name) & (x["kind"] == "signal")].itertuples()}


@pytest.fixture(scope="module")
def bars(walk):
    return walk(260, 1, 11).assign(series="s")


def batch_flags(spark, bars, name, exits):
    x = spark.createDataFrame(bars)
    options = dict(OPTIONS[name])
    if name == "state_machine_v1":
        options = {"warmup": options["warmup"]}
        f = features.feature_frame(x, *[WINDOWS[k] for k in ("fast", "slow", "atr", "span", "rank", "vol")])
        df = strategies.state_machine_v1(features.lifecycle_frame(f, WINDOWS["rank"]), lifecycle.Lifecycle(**MACHINE), **options)
    else:
        df = strategies.BUILDERS[name](x, **options)
    warmup = make(name, OPTIONS[name]).warmup
    if exits:
        df = ledger.with_exits(strategies.k.ema_columns(df, {"_e": ("close", 20)}), exits["mode"], exits.get("failure_bars", 4), exits.get("sma", 40), "_e")
    df = df.withColumn("_n", F.row_number().over(series_window())).where(F.col("_n") > warmup)
    rows = df.select("ts", *ledger.FLAGS).toPandas()
    return {(r.ts, side) for r in rows.itertuples() for side, flag in zip(SIDES, (r.long_entry, r.long_exit, r.short_entry, r.short_exit)) if flag}


MODES = [{}, {"mode": "continuation_failure", "failure_bars": 2}, {"mode": "trend_failure", "trend_span": 20}, {"mode": "trend_structure", "sma": 15, "failure_bars": 3}]


@pytest.mark.parametrize("name", [n for n in OPTIONS if n != "state_machine_v2"])
def test_every_generator_equals_its_batch_rows(spark, bars, name):
    for exits in MODES:
        options = dict(OPTIONS[name])
        if exits.get("mode") == "trend_structure":
            if name not in ("turnaround_v1", "sma_pullback"):
                continue
            if name == "turnaround_v1":
                with pytest.raises(ValueError, match="turn shorts off"):
                    stream(bars, {name: (options, exits)}, [list(range(len(bars)))])
                continue
        want = batch_flags(spark, bars, name, exits)
        assert want
        for cuts in ([len(bars)], [1, 2, 3, 50, 51, 140, len(bars)], range(1, len(bars) + 1)):
            parts = np.split(np.arange(len(bars)), list(cuts)[:-1])
            got, _ = stream(bars, {name: (options, exits)}, parts)
            assert sides(got, name) == want


def test_levels_and_reasons_equal_the_batch(spark, bars):
    x = spark.createDataFrame(bars)
    f = features.feature_frame(x, *[WINDOWS[k] for k in ("fast", "slow", "atr", "span", "rank", "vol")])
    df = strategies.state_machine_v2(features.lifecycle_frame(f, WINDOWS["rank"]), lifecycle.Lifecycle(**MACHINE), warmup=60)
    df = ledger.banded(df, 0.1).withColumn("_n", F.row_number().over(series_window())).where("_n > 60").toPandas().sort_values("ts")
    parts = np.split(np.arange(len(bars)), [7, 90, 91, 200])
    got, _ = stream(bars, {"state_machine_v2": (OPTIONS["state_machine_v2"], {})}, parts)
    levels = got[got["kind"] == "target"].set_index("ts")["level"]
    want = df[df["submitted"].notna()].set_index("ts")["submitted"]
    assert len(want) > 5 and list(levels.index) == list(want.index) and np.allclose(levels, want)
    reasons = got[got["kind"] == "reason"]
    assert list(reasons["state"]) == list(df["state"]) and list(reasons["ts"]) == list(df["ts"])
    for c in ("direction", "strength", "stability", "energy"):
        mine = np.array([r[c] for r in reasons["features"]], dtype=float)
        assert np.allclose(mine, df[c].to_numpy(float), equal_nan=True)


def test_corrections_late_and_repeated_bars(bars):
    """A corrected newest bar is decided anew from where the rule stood before it; older bars are counted and change nothing."""
    rng, rows, parts = np.random.default_rng(2), [], []
    for i in range(len(bars)):
        bar = bars.iloc[i]
        part = []
        for _ in range(int(rng.integers(0, 3))):  # wrong copies first
            rows.append(bar.to_dict() | {"close": bar["close"] + float(rng.normal(0, 2)), "open": bar["open"] + 1})
            part.append(len(rows) - 1)
            if rng.random() < 0.5:
                parts.append(part)
                part = []
        rows.append(bar.to_dict())
        part.append(len(rows) - 1)
        if i > 3 and rng.random() < 0.2:
            parts.append(part)
            rows.append(bars.iloc[i - 2].to_dict() | {"close": 1.0})
            part = [len(rows) - 1]
        parts.append(part)
    feed = pd.DataFrame(rows)
    rules = {n: (o, {}) for n, o in OPTIONS.items()}
    clean, _ = stream(bars, rules, [list(range(len(bars)))])
    got, p = stream(feed, rules, [x for x in parts if x])
    for name in OPTIONS:
        assert sides(got, name) == sides(clean, name)
    for kind, column in (("target", "level"), ("reason", "state")):
        a, b = (newest(x)[newest(x)["kind"] == kind].sort_values(["strategy", "ts"]) for x in (got, clean))
        assert list(a["ts"]) == list(b["ts"]) and list(a[column]) == list(b[column])
    about = json.loads(p.about.value[0])
    assert about["late"] > 10 and about["revised"] > 50 and (got["kind"] == "retract").any()


def test_rules_that_come_between_batches(bars):
    """A rule counts from the bars after it, as a run of its own from there would; one that is switched off says no more."""
    feed = bars.assign(strategy=None, options=None, exits=None, active=None).astype({"strategy": object, "options": object, "exits": object, "active": object})
    rule = lambda name, active=True: pd.DataFrame([{"series": "s", "ts": pd.NaT, "strategy": name, "options": json.dumps(OPTIONS[name]), "exits": "", "active": active}]).reindex(columns=feed.columns)
    p = engine.SignalProcessor()
    p.init(Handle())
    out = []
    for part in (rule("tsmom"), feed[:100], pd.concat([rule("donchian"), feed[100:180]]), pd.concat([rule("tsmom", False), feed[180:]])):
        out += list(p.handleInputRows(("s",), iter([part]), None))
    got = pd.concat(out)
    whole, _ = stream(bars[:180], {"tsmom": (OPTIONS["tsmom"], {})}, [list(range(180))])
    later, _ = stream(bars[100:], {"donchian": (OPTIONS["donchian"], {})}, [list(range(160))])
    assert sides(got, "tsmom") == sides(whole, "tsmom") and sides(got, "donchian") == sides(later, "donchian")


def test_refusals(bars):
    for bad in (("nonsense", {}, {}), ("tsmom", {}, {"mode": "setup_invalidation_stop"}), ("tsmom", {}, {"mode": "trend_failure"}), ("state_machine_v2", {"band": -1}, {})):
        with pytest.raises(ValueError):
            make(*bad)
    with pytest.raises(ValueError, match="some bars carry funding"):
        stream(bars.assign(funding_rate=[0.1] * 5 + [None] * (len(bars) - 5)), {"tsmom": ({}, {})}, [list(range(5)), list(range(5, 9))])
    forming = bars.assign(closed=[True] * 259 + [False])
    _, p = stream(forming, {"tsmom": ({}, {})}, [list(range(260))])
    _, q = stream(forming, {"tsmom": ({}, {})}, [list(range(260))], forming=True)
    assert [json.loads(v[0])["seen"] for x in (p, q) for v in x.memory.map.values()] == [259, 260]


def test_the_ring_stays_short(bars):
    _, p = stream(bars, {"tsmom": ({"lookback": 5}, {})}, [[i] for i in range(len(bars))])
    assert len(p.ring.items) <= 2 * 6 + 65


def test_coverage_frontier():
    p = engine.CoverageProcessor(1000)
    p.init(Handle())
    t = lambda s: pd.Timestamp(s, unit="s")
    rows = lambda *x: iter([pd.DataFrame(x, columns=["series", "ts", "value", "kind"])])
    out = []
    for part in (rows(("a", t(0), 1.0, 0), ("a", t(1), 2.0, 0)), rows(("a", t(0.5), 0.1, 1)), rows(("a", t(1), 0.2, 1)), rows(("a", t(1.9), 0.3, 1), ("a", t(0), 9.0, 0)), rows(("a", t(5), None, 2))):
        out.append([(r.close, None if r.settled is pd.NaT else r.settled.timestamp(), r.rate, r.late) for x in p.handleInputRows(("a",), part, None) for r in x.itertuples()])
    assert out == [[], [], [(1.0, 0.5, 0.1, 0)], [], [(2.0, 1.0, 0.2, 1), (2.0, 1.9, 0.3, 1)]]


def folder():
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def test_spark_runs_micro_batches_with_history_and_rules(spark, walk):
    """Files one by one, history from a table, a rule for one series only: the rows of the processor over whole series."""
    pdf = walk(120, 3, 5)
    cut = pdf["ts"].sort_values().iloc[120]
    df, at = spark.createDataFrame(pdf), folder()
    for lo, hi in ((1, 2), (2, 3)):
        part = df.where(F.col("ts") > F.lit(cut)).where(F.pmod(F.dayofmonth("ts"), F.lit(1)) == 0)
        mid = F.lit(pdf["ts"].sort_values().iloc[250])
        (part.where(F.col("ts") <= mid) if lo == 1 else part.where(F.col("ts") > mid)).coalesce(1).write.mode("append").parquet(f"{at}/in")
    rule = spark.createDataFrame([("s1", "tsmom", '{"lookback": 7}', "", True)], "series string, strategy string, options string, exits string, active boolean")
    rule.coalesce(1).write.parquet(f"{at}/rules")
    stream_bars = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    rules = spark.readStream.schema(rule.schema).parquet(f"{at}/rules")
    out = engine.signal_stream(stream_bars, {"donchian": (OPTIONS["donchian"], {})}, rules, df.where(F.col("ts") <= F.lit(cut)))
    got = engine.run_all(out, f"{at}/out", f"{at}/state", ["series", "strategy", "ts", "kind", "side", "revision"]).toPandas()
    want = set()
    for s, x in pdf.sort_values("ts").groupby("series"):
        a, _ = stream(x, {"donchian": (OPTIONS["donchian"], {})}, [list(range(len(x)))])
        want |= {(s, "donchian", r.ts, r.side) for r in a.itertuples() if r.ts > cut}
        if s == "s1":
            later = x[x["ts"] > cut]
            b, _ = stream(later, {"tsmom": ({"lookback": 7}, {})}, [list(range(len(later)))])
            want |= {(s, "tsmom", r.ts, r.side) for r in b.itertuples()}
    assert {(r.series, r.strategy, r.ts, r.side) for r in got.itertuples()} == want and len(got) == len(want)


def test_snapshots_are_complete_and_strict(spark, walk):
    pdf, at = walk(60, 3, 5), folder()
    end = pdf["ts"].max()
    df = spark.createDataFrame(pdf).select("series", "ts", "close")
    close = spark.createDataFrame([(None, (end + pd.Timedelta("400D")).to_pydatetime(), None)], df.schema)
    for part in (df.where(F.col("ts") <= F.lit(pdf["ts"].median())), df.where(F.col("ts") > F.lit(pdf["ts"].median())), close):
        part.coalesce(1).write.mode("append").parquet(f"{at}/in")
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    got = engine.run_all(engine.snapshot_rows(s, 900_000), f"{at}/out", f"{at}/state", ["ts_close", "series"], strict=True, time="ts_close").toPandas()
    assert len(got) == len(pdf) and (got.groupby("ts_close")["series"].count() == got.groupby("ts_close")["present"].max()).all()
    df.limit(1).coalesce(1).write.mode("append").parquet(f"{at}/in")
    with pytest.raises(ValueError, match="after their instant was closed"):
        engine.run_all(engine.snapshot_rows(s, 900_000), f"{at}/out", f"{at}/state", ["ts_close", "series"], strict=True, time="ts_close")


def test_epochs_that_are_replayed_add_nothing(spark):
    at = folder()
    rows = lambda *x: spark.createDataFrame([(k, pd.Timestamp(t).to_pydatetime(), v) for k, t, v in x], "k string, ts timestamp, v int")
    write = engine.epoch_sink(f"{at}/sink", ["k", "ts"])
    first, second = rows(("a", "2024-01-01", 2), ("a", "2024-01-01", 1), ("b", "2024-01-02", 3)), rows(("a", "2024-01-01", 9), ("c", "2024-01-02", 4), ("b", "2024-01-03", 5))
    read = lambda: sorted((r["k"], str(r["ts"])[:10], r["v"]) for r in spark.read.parquet(f"{at}/sink").collect())
    for epoch, batch in ((0, first), (1, second), (1, second), (0, first), (1, second)):
        write(batch, epoch)
    assert read() == [("a", "2024-01-01", 1), ("b", "2024-01-02", 3), ("b", "2024-01-03", 5), ("c", "2024-01-02", 4)]
