"""Signals, targets and reasons of many series and strategies from one stream of bars.

State is keyed by series: a ring of its newest bars, which all strategies share, and for each strategy a few numbers before
and after the newest bar. So the work for a bar doesn't grow with the history, and a correction of the newest bar takes
the strategy back to where it stood before it and lets it decide again. Rules come with the stream as rows of their own, so
one added between two micro-batches counts from the next bar on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.rules import FIELDS, SIDES, make

SIGNALS = "series string, strategy string, ts timestamp, kind string, side string, close double, level double, state string, features map<string,double>, revision long, late long, revised long"
BAR = "at long, open double, high double, low double, close double, volume double"
RULE_COLUMNS = ("strategy", "options", "exits", "active")


def side_of(level: float, before: float) -> str:
    """A level names its own direction; zero leaves what was held."""
    return "enter_long" if level > 0 else "enter_short" if level < 0 else "exit_short" if before < 0 else "exit_long"


class SignalProcessor(StatefulProcessor):
    """Rows of a series: rules first, then bars in time order. A rule's name is its generator's, or its options name that as `rule`.

    A bar older than the newest is counted as late and emits nothing; one of the same instant replaces it and is counted as
    revised. rules are those of every series, by strategy: (options, exits). Bars up to emit_after_ms emit nothing.
    """

    def __init__(self, rules: dict[str, tuple[dict, dict]] | None = None, emit_after_ms: int | None = None, forming: bool = False, reasons: bool = True):
        self.rules, self.emit_after_ms, self.forming, self.reasons = rules or {}, emit_after_ms, forming, reasons

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", BAR)
        self.about = handle.getValueState("about", "json string")
        self.memory = handle.getMapState("memory", "strategy string", "json string")
        self.made: dict = {}

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """History that fills the state before the first bar and emits nothing."""
        for _ in self.taken(key[0], initialState, silent=True):
            pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self.taken(key[0], pd.concat(list(rows), ignore_index=True))

    def close(self) -> None:
        pass

    def rule(self, memory: dict):
        name = json.dumps([memory["strategy"], memory["options"], memory["exits"]], sort_keys=True)
        if name not in self.made:
            self.made[name] = make(memory["strategy"], memory["options"], memory["exits"])
        return self.made[name]

    def memories(self, pdf: pd.DataFrame) -> dict[str, dict]:
        """What each strategy keeps, after the rules among the rows; a rule given anew starts anew, an inactive one ends."""
        found = {k[0]: json.loads(v[0]) for k, v in self.memory.iterator()}
        fresh = lambda name, o, e: {"strategy": o.get("rule", name), "options": {k: v for k, v in o.items() if k != "rule"}, "exits": e, "seen": 0, "before": {}, "after": {}}
        for name, (options, exits) in self.rules.items():
            found.setdefault(name, fresh(name, options, exits))
        if "strategy" in pdf:
            for r in pdf[pdf["strategy"].notna()].itertuples():
                if r.active is None or r.active:
                    found[r.strategy] = fresh(r.strategy, json.loads(r.options or "{}"), json.loads(r.exits or "{}"))
                elif found.pop(r.strategy, None):
                    self.memory.removeKey((r.strategy,))
        return found

    def taken(self, series: str, pdf: pd.DataFrame, silent: bool = False) -> Iterator[pd.DataFrame]:
        memories = self.memories(pdf)
        about = json.loads(self.about.get()[0]) if self.about.exists() else {"newest": None, "revision": 0, "late": 0, "revised": 0, "held": 0, "funded": None}
        bars = pdf[pdf["ts"].notna()]
        if "closed" in bars and not self.forming:
            bars = bars[bars["closed"].fillna(True).astype(bool)]
        if len(bars) and "funding_rate" in bars:
            about["funded"] = self.consistent(series, about["funded"], bars["funding_rate"].notna())
        at = bars["ts"].to_numpy("datetime64[ms]").astype(np.int64)
        order = np.argsort(at, kind="stable")
        newest = about["newest"]
        late = at[order] < (newest[0] if newest else -(1 << 62))
        about["late"] += int(late.sum())
        order = order[~late]
        last = np.append(np.diff(at[order]) > 0, True)[: len(order)]  # of rows of one instant the last counts
        about["revised"] += int((~last).sum())
        order = order[last]
        todo = [[int(at[i]), *map(float, row)] for i, row in zip(order, bars[list(FIELDS)].to_numpy(float)[order])]
        again = bool(todo and newest and todo[0][0] == newest[0])
        about["revised"] += again
        if not todo:
            self.about.update((json.dumps(about),))
            for name, m in memories.items():
                self.memory.updateValue((name,), (json.dumps(m),))
            return
        behind = [list(r) for r in self.ring.get()] if about["held"] else []
        whole = np.array([*behind, *([newest] if newest and not again else []), *todo], dtype=float).reshape(-1, 6)
        revision = about["revision"] + 1 if again else 0
        out, reach = [], 1
        for name, m in sorted(memories.items()):
            rule = self.rule(m)
            reach = max(reach, rule.reach)
            mine = todo[1:] if again and not m["seen"] else todo  # a rule that came after the newest bar has nothing to take back
            if mine:
                out += self.decided(series, name, m, rule, whole, mine, again and mine is todo, revision, about, silent)
            self.memory.updateValue((name,), (json.dumps(m),))
        settled = [*([newest] if newest and not again else []), *todo[:-1]]
        if about["held"] + len(settled) > 2 * reach + 64:
            kept = [*behind, *settled][-reach:]
            self.ring.put([tuple(r) for r in kept])
            about["held"] = len(kept)
        elif settled:
            self.ring.appendList([tuple(r) for r in settled])
            about["held"] += len(settled)
        about |= {"newest": todo[-1], "revision": revision if len(todo) == 1 else 0}
        self.about.update((json.dumps(about),))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SIGNALS.split(", ")])

    @staticmethod
    def consistent(series: str, funded: bool | None, has: pd.Series) -> bool:
        """All bars of a series carry funding, or none does."""
        funded = bool(has.iloc[0]) if funded is None else funded
        if (has != funded).any():
            raise ValueError(f"{series}: some bars carry funding and others don't")
        return funded

    def decided(self, series, name, m, rule, whole, todo, again, revision, about, silent) -> list[tuple]:
        """Rows of one strategy for the bars to do; its memory `m` moves on."""
        from tidemark.streaming.rules import Run

        seen = m["seen"] - again
        base = m["before"] if again else m["after"]
        start = min(seen, rule.reach, len(whole) - len(todo))
        part = whole[len(whole) - len(todo) - start :]
        run = Run({f: part[:, i + 1] for i, f in enumerate(FIELDS)}, start, base | {"seen": seen})
        found = rule.compute(run)
        m |= {"seen": seen + len(todo), "before": base | run.last, "after": base | run.after}
        rows = []
        if silent:
            return rows
        for i, bar in enumerate(todo):
            if seen + i < rule.warmup or (self.emit_after_ms is not None and bar[0] <= self.emit_after_ms):
                continue
            ts, number = pd.Timestamp(bar[0], unit="ms"), revision if i == 0 else 0
            row = lambda kind, side=None, level=None, state=None, features=None: (series, name, ts, kind, side, bar[4], level, state, features, number, about["late"], about["revised"])  # noqa: B023, E731
            if number:
                rows.append(row("retract"))
            if "level" in found:
                if found["submitted"][i]:
                    level, before = found["submitted"][i]
                    rows.append(row("target", side_of(level, before), level))
            else:
                rows += [row("signal", side) for side in SIDES if found[side][i]]
            if self.reasons and "state" in found:
                values = {k: None if np.isnan(x[i]) else float(x[i]) for k, x in found["features"].items()}
                rows.append(row("reason", None, None, found["state"][i], values))
        return rows


def signal_stream(bars: DataFrame, rules: dict[str, tuple[dict, dict]] | None = None, rule_rows: DataFrame | None = None, history: DataFrame | None = None, emit_after_ms: int | None = None, forming: bool = False, reasons: bool = True) -> DataFrame:
    """Rows of SIGNALS from a stream of bars, as they are decided; newest_rows() keeps what wasn't taken back.

    rules apply to all series, rule_rows (a stream of series, strategy, options, exits, active) to single ones. Bars may have
    closed (false: still forming, dropped unless `forming`) and funding_rate. history (a batch of bars) primes the state.
    """
    few = ["series", "ts", *FIELDS, *[c for c in ("closed", "funding_rate") if c in bars.columns]]
    rows = bars.select(*few)
    if rule_rows is not None:
        control = rule_rows.select("series", "strategy", "options", "exits", "active")
        rows = rows.unionByName(control, allowMissingColumns=True)
    started = history.select("series", "ts", *FIELDS).groupBy("series") if history is not None else None
    processor = SignalProcessor(rules, emit_after_ms, forming, reasons)
    with_store(bars.sparkSession)
    return rows.groupBy("series").transformWithStateInPandas(processor, SIGNALS, "append", "None", started)


def newest_rows(signals: DataFrame) -> DataFrame:
    """Rows of the last revision of each bar, without those that only take back."""
    last = F.max("revision").over(W.partitionBy("series", "strategy", "ts"))
    return signals.withColumn("_last", last).where("revision = _last AND kind <> 'retract'").drop("_last")


def with_store(spark: SparkSession) -> None:
    """The state store that keeps lists, maps and timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class SnapshotProcessor(StatefulProcessor):
    """Bars of one close instant; a timer lets them go when the watermark has passed it. A series that comes twice counts with its later row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getMapState("bars", "series string", "close double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.bars.exists():
            self.handle.registerTimer(int(key[0].timestamp() * 1000))
        for pdf in rows:
            for r in pdf.itertuples():
                if r.series is not None:
                    self.bars.updateValue((r.series,), (float(r.close),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = [(k[0], v[0]) for k, v in self.bars.iterator()]
        self.bars.clear()
        for lo in range(0, len(found), 10_000):
            part = found[lo : lo + 10_000]
            yield pd.DataFrame({"ts_close": key[0], "series": [s for s, _ in part], "close": [c for _, c in part], "present": len(found)})

    def close(self) -> None:
        pass


def snapshot_rows(bars: DataFrame, width_ms: int, delay: str = "0 seconds") -> DataFrame:
    """ts_close, series, close and how many series are present at that close, once a later bar has come; a row each, however many series there are."""
    x = bars.select("series", "close", F.timestamp_millis(F.unix_millis("ts") + width_ms - 1).alias("ts_close")).withWatermark("ts_close", delay)
    with_store(bars.sparkSession)
    return x.groupBy("ts_close").transformWithStateInPandas(SnapshotProcessor(), "ts_close timestamp, series string, close double, present long", "append", "EventTime")


class CoverageProcessor(StatefulProcessor):
    """Bars of a series wait until its own settlements have come past their end; a slow series holds no other.

    Rows are bars (kind 0), settlements (1) and the end of the series (2), after which nothing more is waited for. A bar not
    later than one already let go is counted as late.
    """

    def __init__(self, width_ms: int):
        self.width_ms = width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getListState("bars", "at long, close double")
        self.rates = handle.getListState("rates", "us long, rate double")
        self.about = handle.getValueState("about", "frontier long, done long, late long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        frontier, done, late = self.about.get() if self.about.exists() else (-(1 << 62), -(1 << 62), 0)
        us = pdf["ts"].to_numpy("datetime64[us]").astype(np.int64)
        kind = pdf["kind"].to_numpy()
        bars, rates = sorted(map(tuple, self.bars.get())), sorted(map(tuple, self.rates.get()))
        new = [(int(t), float(v)) for t, v, b in zip(us, pdf["value"], kind) if b == 0]
        late += sum(t <= done for t, _ in new)
        bars = sorted(dict(bars + [b for b in new if b[0] > done]).items())  # a bar that comes twice counts with its later row
        rates = sorted(rates + [(int(t), float(v)) for t, v, b in zip(us, pdf["value"], kind) if b == 1 and v == v])
        frontier = (1 << 62) if (kind == 2).any() else max([frontier, *us[kind == 1].tolist()])
        width = 1000 * self.width_ms
        go = [b for b in bars if b[0] + width <= frontier]
        out, at = [], np.array([t for t, _ in rates], dtype=np.int64)
        for t, close in go:
            lo, hi = np.searchsorted(at, [t, t + width])
            out += [(key[0], t, close, s, r, late) for s, r in rates[lo:hi]] or [(key[0], t, close, None, 0.0, late)]
        if go:
            done = go[-1][0]
            bars, rates = bars[len(go) :], [x for x in rates if x[0] >= done + width]
        for state, held in ((self.bars, bars), (self.rates, rates)):
            state.put(held) if held else state.clear()
        self.about.update((frontier, done, late))
        if out:
            x = pd.DataFrame(out, columns=["series", "ts", "close", "settled", "rate", "late"])
            yield x.assign(ts=pd.to_datetime(x["ts"], unit="us"), settled=pd.to_datetime(x["settled"].astype("Int64"), unit="us"))

    def close(self) -> None:
        pass


def covered_bars(bars: DataFrame, funding: DataFrame, width_ms: int, ends: DataFrame | None = None) -> DataFrame:
    """series, ts, close, settled, rate, late: bars with the settlements inside them, each once its own series is settled past its end.

    `ends` is a stream of (series, ts): series of which nothing more comes, whose last bars are let go as they are.
    """
    x = bars.select("series", "ts", F.col("close").alias("value"), F.lit(0).alias("kind"))
    x = x.unionByName(funding.select("series", F.col("settled").alias("ts"), F.col("rate").alias("value"), F.lit(1).alias("kind")))
    if ends is not None:
        x = x.unionByName(ends.select("series", "ts", F.lit(None).cast("double").alias("value"), F.lit(2).alias("kind")))
    with_store(bars.sparkSession)
    return x.groupBy("series").transformWithStateInPandas(CoverageProcessor(width_ms), "series string, ts timestamp, close double, settled timestamp, rate double, late long", "append", "None")


def epoch_sink(path: str, key: list[str], time: str = "ts", period: str = "month"):
    """foreachBatch function of an append-only sink that adds each key once, however often an epoch is replayed.

    Without a key all rows of an epoch are kept: a stream that emits each row once may have rows that are alike.
    Rows are kept by the period of their time and by epoch. A batch meets only the stored keys of its own periods and of earlier
    epochs, so what it reads doesn't grow with the sink, and an epoch that is run again writes over its own files. Of rows that
    repeat a key within a batch the first in the order of all columns stays.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        x = batch.withColumn("_period", F.to_date(F.date_trunc(period, time))).withColumn("_epoch", F.lit(epoch))
        order = [F.col(c).cast("string") if t.startswith(("map", "struct")) else F.col(c) for c, t in batch.dtypes]
        if key:
            x = x.withColumn("_first", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_first = 1").drop("_first")
        x = x.persist()
        try:
            periods = [r[0] for r in x.select("_period").distinct().collect()]  # of one micro-batch
            if key and stored(spark, path):
                old = spark.read.schema(x.schema).parquet(path).where(F.col("_period").isin(periods) & (F.col("_epoch") < epoch)).select(*key)
                x_new = x.join(old.hint("shuffle_hash"), key, "left_anti")
            else:
                x_new = x
            x_new.repartition("_period").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_period", "_epoch").parquet(path)
        finally:
            x.unpersist()

    return write


def stored(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def run_all(stream: DataFrame, sink: str, checkpoint: str, key: list[str], strict: bool = False, time: str = "ts") -> DataFrame:
    """Run a bounded stream until all its input is read and return what the sink holds.

    With strict, rows that came after their watermark are an error, as they would be missing from the result.
    """
    spark = stream.sparkSession
    q = stream.writeStream.outputMode("append").foreachBatch(epoch_sink(sink, key, time)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    dropped = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in json.loads(p.json)["stateOperators"])
    if strict and dropped:
        raise ValueError(f"{dropped} rows came after their instant was closed")
    if not stored(spark, sink):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(sink).select(*stream.columns)
