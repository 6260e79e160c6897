"""Timeframes and calendar arithmetic as Column expressions (UTC, milliseconds)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_UNIT_MS = {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
SIZING_DAYS, SHARPE_DAYS = 365.25, 365.0


def timeframe_ms(timeframe: str) -> int:
    """Width of a timeframe such as 15m, 4h, 1d, 1w or 1wk; months have no fixed width and are refused."""
    found = re.fullmatch(r"([1-9][0-9]*)(s|m|h|d|w|wk)", timeframe)
    if not found:
        raise ValueError(f"timeframe {timeframe!r} has no fixed width")
    return int(found[1]) * _UNIT_MS[found[2][0]]


def timeframe_ms_col(timeframe: Column) -> Column:
    """The same for a column; null where there is no fixed width."""
    number = F.regexp_extract(timeframe, r"^([1-9][0-9]*)(s|m|h|d|w|wk)$", 1)
    unit = F.regexp_extract(timeframe, r"^([1-9][0-9]*)(s|m|h|d|w|wk)$", 2)
    ms = F.when(unit == "wk", _UNIT_MS["w"])
    for u, n in _UNIT_MS.items():
        ms = ms.when(unit == u, n)
    return F.when(number != "", number.cast("long") * ms)


def bars_per_year(width_ms: Column | int, days: float = SIZING_DAYS) -> Column:
    """SIZING_DAYS for volatility sizing, SHARPE_DAYS for Sharpe ratios."""
    return F.lit(days * 86_400_000.0) / width_ms


def close_ms(ts: Column, width_ms: Column | int) -> Column:
    """Last millisecond that a bar covers."""
    return F.unix_millis(ts) + width_ms - 1


def window_ends(bars: DataFrame) -> DataFrame:
    """series, first_ts, end_ts (exclusive): last open plus the median spacing; a series of one bar is open-ended (null)."""
    w = W.partitionBy("series").orderBy("ts")
    gaps = bars.select("series", "ts", (F.unix_millis(F.lead("ts").over(w)) - F.unix_millis("ts")).alias("gap"))
    ends = gaps.groupBy("series").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.percentile("gap", F.lit(0.5)).cast("long").alias("spacing_ms"))
    return ends.withColumn("end_ts", F.timestamp_millis(F.unix_millis("last_ts") + F.col("spacing_ms")))


def dwell_ms(start: Column, end: Column) -> Column:
    return F.unix_millis(end) - F.unix_millis(start)


def dwell_text(ms: Column) -> Column:
    """A duration in days and hours."""
    hours = F.floor(ms / 3_600_000)
    return F.concat(F.floor(hours / 24).cast("string"), F.lit("d "), (hours % 24).cast("string"), F.lit("h"))
