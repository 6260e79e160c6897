"""Bars, one signal rule, a level and the lifecycle as streams with bounded state; engine.py runs all generators.

The state of a series is what its newest bar needs (a few previous bars, running means, where the lifecycle stands), so the
work for a bar doesn't grow with the history. Late bars are dropped and counted, a repeated newest bar replaces the last one and
is counted, and nothing is emitted before the warmup. Batch and stream give the same signals.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SIGNAL_SCHEMA = "series string, ts timestamp, side string, close double, late long, revised long"
STATE_SCHEMA = "memory string"
BAR_COLUMNS = ("series", "ts", "open", "high", "low", "close", "volume")


def event_bars(events: DataFrame, width: str = "1 hour", delay: str = "0 seconds") -> DataFrame:
    """Tumbling bars of a stream of events (event_id, ts, event_type, value), emitted when the watermark has passed them; event_id orders those of one instant."""
    at = F.struct("ts", "event_id")
    x = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("series"))
    x = x.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").cast("double").alias("volume"))
    return x.select("series", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def snapshot_stream(bars: DataFrame, width_ms: int, delay: str = "0 seconds") -> DataFrame:
    """One row for each close instant, complete when a later bar has arrived: what was present, as parallel arrays."""
    x = bars.withColumn("ts_close", F.timestamp_millis(F.unix_millis("ts") + width_ms - 1)).withWatermark("ts_close", delay)
    return x.groupBy("ts_close").agg(F.sort_array(F.collect_list(F.struct("series", "close"))).alias("bars"), F.count("*").alias("present"))


def without_repeats(bars: DataFrame, delay: str = "1 day") -> DataFrame:
    """Exact repeats of a bar are dropped while the watermark still covers it; a revision has another hash and passes."""
    x = bars.withColumn("_hash", F.xxhash64("open", "high", "low", "close", "volume")).withWatermark("ts", delay)
    return x.dropDuplicatesWithinWatermark(["series", "ts", "_hash"]).drop("_hash")


def withheld_until_funded(bars: DataFrame, funding: DataFrame, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Bars of a width joined to the settlements inside them (stream to stream); a bar waits until the settlements' watermark is past it.

    They meet by series and stretch of four widths, so a bar looks at the settlements near it only, in as many tasks as there
    are stretches. A settlement in the first width of its stretch may belong to a bar that opens in the one before: it is sent to both.
    """
    us = F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {width})")
    into = lambda c: F.pmod(F.unix_micros(c), 4 * us)
    stretch = lambda c: ((F.unix_micros(c) - into(c)) / (4 * us)).cast("long")
    b = bars.withWatermark("ts", delay).withColumn("stretch", stretch(F.col("ts"))).alias("b")
    f = funding.select(F.col("series").alias("f_series"), "settled", "rate").withWatermark("settled", delay)
    at, early = stretch(F.col("settled")), into(F.col("settled")) < us
    f = f.withColumn("f_stretch", F.explode(F.when(early, F.array(at, at - 1)).otherwise(F.array(at)))).alias("f")
    on = F.expr(f"series = f_series AND stretch = f_stretch AND settled >= ts AND settled < ts + INTERVAL {width}")
    return b.join(f, on, "left_outer").select("series", "ts", "close", "settled", F.coalesce("rate", F.lit(0.0)).alias("rate"))


class ReversalMemory:
    """The newest two bars and counters of a series: what the reversal pattern needs."""

    def __init__(self, text: str | None = None):
        m = json.loads(text) if text else {}
        self.bars: list = m.get("bars", [])  # newest last: (ts ms, open, close)
        self.seen, self.late, self.revised = m.get("seen", 0), m.get("late", 0), m.get("revised", 0)

    def text(self) -> str:
        return json.dumps({"bars": self.bars, "seen": self.seen, "late": self.late, "revised": self.revised})

    def add(self, at: int, open_: float, close: float) -> bool:
        """Whether the bar is a new one."""
        if self.bars and at < self.bars[-1][0]:
            self.late += 1
            return False
        if self.bars and at == self.bars[-1][0]:
            self.revised += 1
            self.bars[-1] = [at, open_, close]
            return False
        self.bars = [*self.bars[-2:], [at, open_, close]]
        self.seen += 1
        return True

    def sides(self, warmup: int) -> list[str]:
        if self.seen <= warmup or len(self.bars) < 3:
            return []
        (_, o2, c2), (_, o1, c1), (_, o0, c0) = self.bars[-3:]
        if c2 < o2 and c1 < o1 and c0 > o0:
            return ["exit_short", "enter_long"]
        if c2 > o2 and c1 > o1 and c0 < o0:
            return ["exit_long", "enter_short"]
        return []


def reversal_signals(bars: DataFrame, warmup: int = 2, emit_after_ms: int | None = None) -> DataFrame:
    """A row for each signal of the newest closed bar: exits before entries. Works on a stream, and on a batch table too.

    Bars up to emit_after_ms only fill the state: history that primes the stream.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = ReversalMemory(state.get[0] if state.exists else None)
        rows = []
        for pdf in batches:
            for r in pdf.sort_values("ts", kind="stable").itertuples():
                ms = int(r.ts.value // 1_000_000)
                if memory.add(ms, float(r.open), float(r.close)) and (emit_after_ms is None or ms > emit_after_ms):
                    rows += [(key[0], r.ts, side, float(r.close), memory.late, memory.revised) for side in memory.sides(warmup)]
        state.update((memory.text(),))
        if rows:
            yield pd.DataFrame(rows, columns=["series", "ts", "side", "close", "late", "revised"])

    return bars.groupBy("series").applyInPandasWithState(fold, SIGNAL_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


LEVEL_SCHEMA = "series string, ts timestamp, target double, submitted boolean, side string"


def ema_level_signals(bars: DataFrame, fast: int = 48, slow: int = 192, warmup: int = 100, band: float = 0.25) -> DataFrame:
    """A target level from two running means, submitted when it moved by the band from the last submitted one; the side follows from both.

    The level is the spread's share of the price, a hundredfold, within -1 and 1. The state is two means, a count and a level.
    """
    a, b = 2 / (fast + 1), 2 / (slow + 1)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, f, s, n, held = json.loads(state.get[0]) if state.exists else (None, None, None, 0, None)
        rows = []
        for pdf in batches:
            for r in pdf.sort_values("ts", kind="stable").itertuples():
                ms = int(r.ts.value // 1_000_000)
                if at is not None and ms <= at:
                    continue
                at, n, c = ms, n + 1, float(r.close)
                f, s = (c, c) if f is None else (a * c + (1 - a) * f, b * c + (1 - b) * s)
                if n <= warmup:
                    continue
                level = max(-1.0, min(1.0, 100 * (f - s) / c))
                moved = held is None or abs(level - held) >= band
                before, after = (held or 0.0), (level if moved else held or 0.0)
                side = "enter_long" if after > 0 >= before else "enter_short" if after < 0 <= before else "hold"
                if moved:
                    held = level
                    rows.append((key[0], r.ts, level, True, side))
        state.update((json.dumps((at, f, s, n, held)),))
        if rows:
            yield pd.DataFrame(rows, columns=["series", "ts", "target", "submitted", "side"])

    return bars.groupBy("series").applyInPandasWithState(fold, LEVEL_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def lifecycle_stream(frame: DataFrame, machine, warmup: int = 0) -> DataFrame:
    """series, ts, state of a stream of lifecycle inputs: the automaton's few numbers are all that is kept."""
    from tidemark.operators.lifecycle import START, STATES, moved, moves, predicates, row_bits

    table = moves(machine)
    rows = predicates(frame, machine).select("series", "ts", row_bits().alias("bits"), "lean", F.coalesce(F.col("direction") > 0, F.lit(False)).alias("positive"))

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, stands, n = json.loads(state.get[0]) if state.exists else (None, START, 0)
        out = []
        for pdf in batches:
            for r in pdf.sort_values("ts", kind="stable").itertuples():
                ms = int(r.ts.value // 1_000_000)
                if at is not None and ms <= at:
                    continue
                at, n = ms, n + 1
                stands = moved(table, tuple(stands), int(r.bits), int(r.lean), bool(r.positive))
                if n > warmup:
                    out.append((key[0], r.ts, STATES[stands[0]]))
        state.update((json.dumps((at, stands, n)),))
        if out:
            yield pd.DataFrame(out, columns=["series", "ts", "state"])

    return rows.groupBy("series").applyInPandasWithState(fold, "series string, ts timestamp, state string", STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def append_sink(path: str, key: list[str]):
    """foreachBatch function of an append-only sink: rows whose key is stored already are skipped, so a replayed batch adds nothing."""
    from tidemark.sources.bars import append_new

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            batch = append_new(spark.read.schema(batch.schema).parquet(path), batch, key)
        batch.write.mode("append").parquet(path)

    return write


def run_to_end(stream: DataFrame, sink: str, checkpoint: str, key: list[str]) -> DataFrame:
    """Run a bounded stream until all its input is read and return what the sink holds."""
    q = stream.writeStream.outputMode("append").foreachBatch(append_sink(sink, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(T.StructType(stream.schema.fields)).parquet(sink)
