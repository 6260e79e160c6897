"""Registered queries over streams: bars of the given tables in slices of time, one micro-batch each, and the SQL of the batch rule."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.store import shared_folder
from tidemark.oracles import BANDED, STATES, TARGETS
from tidemark.queries import DAILY, FUNDING, HOURLY, ORACLE_SQL as BATCH_SQL, rounded
from tidemark.sources import bars as b
from tidemark.streaming import engine, signals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SLICES = 4
#: The generators of the streams, with warmups that the test tables' series fill; those of the batch queries.
SHORT = {n: {} for n in ("sma_pullback", "trend_rider", "tsmom", "donchian", "multi_horizon")} | {"turnaround_v1": {"warmup": 100}, "turnaround_v2": {"warmup": 400}, "ema_cross": {"warmup": 400}}
WARMUPS = {"turnaround_v1": 100, "turnaround_v2": 400, "sma_pullback": 40, "trend_rider": 40, "tsmom": 96, "ema_cross": 400, "donchian": 96, "multi_horizon": 192}
LOOSE = {"enter_strength": 0.5, "exit_strength": 0.25, "direction_floor": 0.02, "stability_floor": 0.05, "min_dwell": 2, "cooldown": 3, "exhaustion_dwell": 4}
MACHINE = {"machine": LOOSE, "warmup": 200, "fast": 12, "slow": 48, "atr": 12, "span": 48, "rank": 96, "vol": 12}
KEY = ["series", "strategy", "ts", "kind", "side", "revision"]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def in_slices(spark: SparkSession, df: DataFrame, slices: int = SLICES, end: bool = False) -> DataFrame:
    """A table as a stream of slices of time, a micro-batch each. With `end` a last one has a row without a series, far later, which moves the watermark past all others."""
    at = shared_folder(spark, "stream")
    df.write.parquet(f"{at}/whole")
    whole = spark.read.schema(df.schema).parquet(f"{at}/whole")
    ms = F.unix_millis("ts")
    cuts = [None, *whole.agg(F.percentile_approx(ms, [i / slices for i in range(1, slices)])).first()[0], None]
    parts = [whole.where(F.lit(True) if lo is None else ms > lo).where(F.lit(True) if hi is None else ms <= hi) for lo, hi in zip(cuts, cuts[1:])]
    if end:
        last = whole.agg((F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"))
        parts.append(last.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]))
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{at}/slices")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/slices")


def ran(spark: SparkSession, stream: DataFrame, key: list[str], **more) -> DataFrame:
    return engine.run_all(stream, shared_folder(spark, "sink"), shared_folder(spark, "state"), key, **more)


def sides_sql(names: list[str], falls: int | None = None) -> str:
    """series, ts, strategy, side of the batch rules after their warmups, with the exits of `falls` adverse closes if any."""
    parts = []
    for name in names:
        exits = ("x.long_exit", "x.short_exit") if falls is None else ("x.long_exit OR falls", "x.short_exit OR rises")
        parts.append(f"""SELECT x.series, x.ts, '{name}' AS strategy, unnest(list_filter([CASE WHEN x.long_entry THEN 'enter_long' END, CASE WHEN {exits[0]} THEN 'exit_long' END, CASE WHEN x.short_entry THEN 'enter_short' END, CASE WHEN {exits[1]} THEN 'exit_short' END], lambda s: s IS NOT NULL)) AS side
FROM ({BATCH_SQL[name]}) x JOIN runs r ON r.series = x.series AND r.ts = x.ts WHERE r.n > {WARMUPS[name]}""")
    n = falls or 1
    return f"""WITH {DAILY}, moves AS (SELECT series, ts, row_number() OVER w AS n, close - lag(close) OVER w AS d FROM bars WINDOW w AS (PARTITION BY series ORDER BY ts)),
runs AS (SELECT series, ts, n, sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) OVER t = {n} AS falls, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) OVER t = {n} AS rises FROM moves WINDOW t AS (PARTITION BY series ORDER BY ts ROWS {n - 1} PRECEDING))
""" + " UNION ALL ".join(parts)


@query(sides_sql(sorted(SHORT), 4))
def streamed_strategies(spark, sf_dir):
    """Signals of eight generators with the exits of four adverse closes, from one stream of all series."""
    exits = {"mode": "continuation_failure", "failure_bars": 4}
    out = ran(spark, engine.signal_stream(in_slices(spark, b.daily_bars(spark, sf_dir)), {n: (o, exits) for n, o in SHORT.items()}), KEY)
    return out.select("series", "ts", "strategy", "side")


@query(f"WITH RECURSIVE {STATES}, {TARGETS}, t AS (SELECT * FROM targets WHERE n > 200), f AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS k FROM (SELECT *, coalesce(lag(s) OVER (PARTITION BY series ORDER BY ts), 0) AS b FROM (SELECT *, sign(target) AS s FROM targets))) SELECT series, ts, unnest(list_filter([CASE WHEN s > 0 THEN 'enter_long' END, CASE WHEN b > 0 THEN 'exit_long' END, CASE WHEN s < 0 THEN 'enter_short' END, CASE WHEN b < 0 THEN 'exit_short' END], lambda x: x IS NOT NULL)) AS side FROM f WHERE s <> b AND n > 200")
def streamed_machine_signals(spark, sf_dir):
    """Side changes of the lifecycle's target, from the stream of bars: features, ranks and the walk in state."""
    s = engine.signal_stream(in_slices(spark, b.daily_bars(spark, sf_dir)), {"state_machine_v1": (MACHINE, {})}, reasons=False)
    return ran(spark, s, KEY).select("series", "ts", "side")


@query(f"WITH RECURSIVE {STATES}, {TARGETS}, {BANDED} SELECT series, ts, round(submitted, 6) AS level, CASE WHEN submitted > 0 THEN 'enter_long' WHEN submitted < 0 THEN 'enter_short' WHEN before < 0 THEN 'exit_short' ELSE 'exit_long' END AS side FROM banded WHERE submitted IS NOT NULL AND n > 200")
def streamed_targets(spark, sf_dir):
    """Levels that the lifecycle submits, measured by a band from the last submitted one, with the side that each names."""
    s = engine.signal_stream(in_slices(spark, b.daily_bars(spark, sf_dir)), {"state_machine_v2": (MACHINE | {"band": 0.1}, {})}, reasons=False)
    return rounded(ran(spark, s, KEY).select("series", "ts", "level", "side"), "level")


@query(f"WITH RECURSIVE {STATES} SELECT series, ts, state, round(direction, 6) AS direction, round(strength, 6) AS strength, round(stability, 6) AS stability, round(energy, 6) AS energy FROM states WHERE n > 200")
def streamed_reasons(spark, sf_dir):
    """State and features of each bar past the warmup."""
    s = engine.signal_stream(in_slices(spark, b.daily_bars(spark, sf_dir)), {"state_machine_v2": (MACHINE | {"band": 3.0}, {})})
    x = ran(spark, s, KEY).where("kind = 'reason'")
    return x.select("series", "ts", "state", *[F.round(F.col("features")[c], 6).alias(c) for c in ("direction", "strength", "stability", "energy")])


@query(sides_sql(["tsmom", "ema_cross", "donchian"]))
def streamed_corrections(spark, sf_dir):
    """The newest bar of each slice comes with a wrong close and is corrected with the next one, which also repeats old bars: the rows that stand in the end are those of right bars."""
    x, ms = b.daily_bars(spark, sf_dir), F.unix_millis("ts")
    at = shared_folder(spark, "stream")
    x.write.parquet(f"{at}/whole")
    whole = spark.read.schema(x.schema).parquet(f"{at}/whole")
    cuts = whole.agg(F.percentile_approx(ms, [0.3, 0.6])).first()[0]
    bounds = list(zip([None, *cuts], [*cuts, None]))
    for lo, hi in bounds:
        part = whole.where(F.lit(True) if lo is None else ms > lo).where(F.lit(True) if hi is None else ms <= hi)
        newest = whole.where(ms <= hi).groupBy("series").agg(F.max("ts").alias("ts")) if hi else None
        if newest is not None:
            wrong = part.join(newest.hint("merge"), ["series", "ts"], "left_semi").withColumn("close", F.col("close") * 3)
            part = part.join(newest.hint("merge"), ["series", "ts"], "left_anti").unionByName(wrong)
        if lo is not None:
            old = whole.where(ms <= lo)
            right = old.join(old.groupBy("series").agg(F.max("ts").alias("ts")).hint("merge"), ["series", "ts"], "left_semi")
            part = part.unionByName(right).unionByName(old.where(ms <= lo - 30 * 86_400_000).where(F.dayofmonth("ts") == 1).withColumn("close", F.lit(1.0)))
        part.coalesce(1).write.mode("append").parquet(f"{at}/slices")
    s = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/slices")
    out = ran(spark, engine.signal_stream(s, {n: (SHORT[n], {}) for n in ("tsmom", "ema_cross", "donchian")}), KEY)
    return engine.newest_rows(out).select("series", "ts", "strategy", "side")


CUT_MS = 883_612_800_000


@query(f"""WITH {DAILY}, m AS (SELECT series, ts, 'tsmom' AS strategy, row_number() OVER w > 96 AS ready, close / lag(close, 96) OVER w - 1 AS r FROM bars WHERE series IN ('s0', 's1') WINDOW w AS (PARTITION BY series ORDER BY ts)
UNION ALL SELECT series, ts, 'late', row_number() OVER w > 20, close / lag(close, 20) OVER w - 1 FROM bars WHERE series = 's1' AND epoch_ms(ts) > {CUT_MS} WINDOW w AS (PARTITION BY series ORDER BY ts))
SELECT series, strategy, CAST(count_if(r > 0) AS BIGINT) AS up, CAST(count_if(r < 0) AS BIGINT) AS down, min(ts) AS first_ts FROM m WHERE ready AND r <> 0 GROUP BY series, strategy""")
def streamed_rule_map(spark, sf_dir):
    """A strategy map that grows: a rule for two of the series, and from 1998 a second one for one of them, added between two runs of the same stream."""
    x = b.daily_bars(spark, sf_dir)
    at, sink, state = (shared_folder(spark, n) for n in ("stream", "sink", "state"))
    kind = "series string, strategy string, options string, exits string, active boolean"
    rule = lambda *rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{at}/rules")
    ms = F.unix_millis("ts")
    x.withColumn("first", ms <= CUT_MS).repartition(1).write.partitionBy("first").parquet(f"{at}/whole")
    out = None
    for first in (True, False):
        spark.read.schema(x.schema).parquet(f"{at}/whole/first={str(first).lower()}").coalesce(1).write.mode("append").parquet(f"{at}/bars")
        rule(*[(s, "tsmom", "{}", "", True) for s in ("s0", "s1")] if first else [("s1", "donchian", "{}", "", False), ("s1", "turnaround_v1", json.dumps({"warmup": 9}), "", False)])
        if not first:
            rule(("s1", "late", json.dumps({"rule": "tsmom", "lookback": 20}), "", True))
        bars, rules = (spark.readStream.schema(k).parquet(f"{at}/{n}") for n, k in (("bars", x.schema), ("rules", kind)))
        out = engine.run_all(engine.signal_stream(bars, rule_rows=rules), sink, state, KEY)
    at_once = out.groupBy("series", "strategy", "ts").agg(F.bool_or(F.col("side") == "enter_long").alias("up"), F.bool_or(F.col("side") == "enter_short").alias("down"))
    return at_once.groupBy("series", "strategy").agg(F.count_if("up").alias("up"), F.count_if("down").alias("down"), F.min("ts").alias("first_ts"))


@query(f"WITH {HOURLY} SELECT * FROM bars")
def streamed_complete_bars(spark, sf_dir):
    """Tumbling bars of the event stream over several micro-batches, none lost: a closing row lets the last ones go, and late rows would be an error."""
    x = b.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return ran(spark, signals.event_bars(in_slices(spark, x, end=True)), ["series", "ts"], strict=True)


@query(f"WITH {HOURLY} SELECT ts + INTERVAL 3599999 MILLISECOND AS ts_close, series, close, count(*) OVER (PARTITION BY ts) AS present FROM bars")
def streamed_snapshot_rows(spark, sf_dir):
    """Series present at each close, let go by a timer of that instant."""
    s = in_slices(spark, b.hourly_bars(spark, sf_dir), end=True)
    return ran(spark, engine.snapshot_rows(s, 3_600_000), ["ts_close", "series"], strict=True, time="ts_close")


@query(f"WITH {HOURLY}, {FUNDING}, s AS (SELECT series, max(settled) AS z FROM funding GROUP BY series) SELECT b.series, b.ts, close, f.settled, coalesce(rate, 0.0) AS rate FROM bars b JOIN s USING (series) LEFT JOIN funding f ON b.series = f.series AND f.settled >= b.ts AND f.settled < b.ts + INTERVAL 1 HOUR WHERE b.ts + INTERVAL 1 HOUR <= CASE WHEN b.series < 'd' THEN TIMESTAMP '2100-01-01' ELSE s.z END")
def streamed_covered_bars(spark, sf_dir):
    """Bars with their settlements once their own series is settled past them; two of the series end and let their last bar go, the others wait on."""
    bars = in_slices(spark, b.hourly_bars(spark, sf_dir))
    funding = in_slices(spark, b.settlements(spark, sf_dir).select("series", F.col("settled").alias("ts"), "rate"), 3)
    at = shared_folder(spark, "ends")
    b.hourly_bars(spark, sf_dir).where("series < 'd'").groupBy("series").agg(F.max("ts").alias("ts")).withColumn("kind", F.lit(2)).coalesce(1).write.parquet(at)
    # the ends come in a run of their own, after all else
    ends_at, sink, state = (shared_folder(spark, n) for n in ("ends", "sink", "state"))
    last = spark.read.parquet(at).select("series", "ts")
    last.limit(0).coalesce(1).write.parquet(ends_at)
    ends = spark.readStream.schema(last.schema).parquet(ends_at)
    joined = engine.covered_bars(bars, funding.select("series", F.col("ts").alias("settled"), "rate"), 3_600_000, ends)
    engine.run_all(joined, sink, state, [])  # each bar is let go once, and settlements of one instant are rows of their own
    last.coalesce(1).write.mode("append").parquet(ends_at)
    return engine.run_all(joined, sink, state, []).drop("late")


@query(f"WITH {HOURLY}, {FUNDING} SELECT b.series, b.ts, close, settled, coalesce(rate, 0.0) AS rate FROM bars b LEFT JOIN funding f ON b.series = f.series AND settled >= b.ts AND settled < b.ts + INTERVAL 1 HOUR")
def streamed_funding_join(spark, sf_dir):
    """Bars joined to settlements, stream to stream, each bar held back until the settlements' watermark is past it; what the watermark has passed leaves the state."""
    bars, funding = in_slices(spark, b.hourly_bars(spark, sf_dir)), in_slices(spark, b.settlements(spark, sf_dir).select("series", F.col("settled").alias("ts"), "rate"))
    return ran(spark, signals.withheld_until_funded(bars, funding.select("series", F.col("ts").alias("settled"), "rate")), [])  # the join emits each pair once


@query(sides_sql(["tsmom"]))
def streamed_sink_twice(spark, sf_dir):
    """A stream that is run again from the start over the same sink adds nothing to it."""
    sink, s = shared_folder(spark, "sink"), in_slices(spark, b.daily_bars(spark, sf_dir))
    out = None
    for _ in range(2):
        out = engine.run_all(engine.signal_stream(s, {"tsmom": ({}, {})}), sink, shared_folder(spark, "state"), KEY)
    return out.select("series", "ts", "strategy", "side")


@query(f"SELECT * FROM ({sides_sql(['donchian', 'tsmom'])}) WHERE epoch_ms(ts) > {CUT_MS}")
def primed_strategies(spark, sf_dir):
    """History from the table fills the state before the first bar of the stream; only later bars give signals."""
    x = b.daily_bars(spark, sf_dir)
    history, rest = x.where(F.unix_millis("ts") <= CUT_MS), x.where(F.unix_millis("ts") > CUT_MS)
    s = engine.signal_stream(in_slices(spark, rest), {n: (SHORT[n], {}) for n in ("donchian", "tsmom")}, history=history)
    return ran(spark, s, KEY).select("series", "ts", "strategy", "side")

