"""Signal generators over all series at once: long_entry, long_exit, short_entry, short_exit, and target levels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import windows as k
from tidemark.operators.lifecycle import Lifecycle, side_changes, signed_target

FLAGS = ("long_entry", "long_exit", "short_entry", "short_exit")


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _flags(df: DataFrame, warmup: int, long_entry: Column, long_exit: Column, short_entry: Column, short_exit: Column, allow_shorts: bool = True, **more: Column) -> DataFrame:
    """Flags, false in the warmup. Without shorts only the short entry is off: what closes a long still does."""
    short_entry = short_entry if allow_shorts else F.lit(False)
    return df.withColumns({n: k.warmed(_no(c), warmup, F.lit(False)) for n, c in zip(FLAGS, (long_entry, long_exit, short_entry, short_exit))} | more)


def reversal_pattern() -> tuple[Column, Column]:
    """Two falling bars and then a rising one, and the mirror image."""
    red, green = F.col("close") < F.col("open"), F.col("close") > F.col("open")
    up = k.lag(red.cast("int")).eqNullSafe(F.lit(1)) & k.lag(red.cast("int"), 2).eqNullSafe(F.lit(1)) & green
    down = k.lag(green.cast("int")).eqNullSafe(F.lit(1)) & k.lag(green.cast("int"), 2).eqNullSafe(F.lit(1)) & red
    return up, down


def turnaround_v1(bars: DataFrame, allow_shorts: bool = True, warmup: int = 4000) -> DataFrame:
    up, down = reversal_pattern()
    df = bars.withColumns({"_up": up, "_down": down if allow_shorts else F.lit(False)})
    return _flags(df, warmup, F.col("_up"), F.col("_down"), F.col("_down"), F.col("_up")).drop("_up", "_down")


def turnaround_v2(bars: DataFrame, trend: int = 200, extension: int = 20, low: float = 0.99, high: float = 1.01, allow_shorts: bool = True, warmup: int = 4000) -> DataFrame:
    up, down = reversal_pattern()
    df = k.ema_columns(bars, {"_trend": ("close", trend), "_ext": ("close", extension)}).withColumns({"_up": up, "_down": down})
    long = F.col("_up") & (F.col("close") > F.col("_trend")) & (F.col("close") < F.col("_ext") * low)
    short = F.col("_down") & (F.col("close") < F.col("_trend")) & (F.col("close") > F.col("_ext") * high)
    short = short if allow_shorts else F.lit(False)
    return _flags(df, warmup, long, short, short, long).drop("_up", "_down", "_trend", "_ext")


def sma_pullback(bars: DataFrame, span: int = 40, most: float = 1.2, warmup: int = 40) -> DataFrame:
    up, _ = reversal_pattern()
    df = bars.withColumns({"_up": up, "_sma": k.rolling_mean(F.col("close"), span)})
    off = F.lit(False)
    return _flags(df, warmup, F.col("_up") & (F.col("close") > F.col("_sma")) & (F.col("close") < F.col("_sma") * most), off, off, off).drop("_up", "_sma")


def trend_filter(span: int = 40) -> Column:
    return _no(F.col("close") > k.rolling_mean(F.col("close"), span))


def momentum_filter(period: int = 26) -> Column:
    return _no(k.pct_change(F.col("close"), period) > 0)


def volatility_filter(atr: str = "atr", most: float = 0.08) -> Column:
    return _no(F.try_divide(atr, "close") < most)


def regime_exit(span: int = 40) -> Column:
    return _no(F.col("close") < k.rolling_mean(F.col("close"), span))


def momentum_exit(period: int = 26) -> Column:
    return _no(k.pct_change(F.col("close"), period) < 0)


def atr_scale(atr: str = "atr", target: float = 0.06, least: float = 0.3, most: float = 1.0) -> Column:
    """Target over the range's share of the price, within bounds; the least where it is unknown."""
    ratio = F.try_divide(atr, "close")
    return F.when(ratio > 0, F.least(F.greatest(target / ratio, F.lit(least)), F.lit(most))).otherwise(least)


def with_atr(bars: DataFrame, period: int = 14, name: str = "atr") -> DataFrame:
    return k.ema_columns(bars.withColumn("_tr", k.true_range()), {name: ("_tr", period)}).drop("_tr")


def trend_rider(bars: DataFrame, span: int = 40, period: int = 26, atr: int = 14, most: float = 0.10, failure: int = 3, allow_shorts: bool = False, warmup: int = 40) -> DataFrame:
    up, down = reversal_pattern()
    df = with_atr(bars, atr).withColumns({"_up": up, "_down": down, "_trend": trend_filter(span), "_regime": regime_exit(span), "_mom": momentum_exit(period), "_falls": k.adverse_run(failure), "_rises": k.adverse_run(failure, False), "_calm": volatility_filter("atr", most)})
    long = F.col("_up") & F.col("_trend") & F.col("_calm")
    short = F.col("_down") & ~F.col("_trend") & F.col("_calm") if allow_shorts else F.lit(False)
    out = _flags(df, warmup, long, short | F.col("_falls") | F.col("_regime") | F.col("_mom"), short, long | F.col("_rises") | ~F.col("_regime") | ~F.col("_mom"), size=atr_scale("atr"))
    return out.drop("_up", "_down", "_trend", "_regime", "_mom", "_falls", "_rises", "_calm", "atr")


def tsmom(bars: DataFrame, lookback: int = 96, allow_shorts: bool = True) -> DataFrame:
    r = k.pct_change(F.col("close"), lookback)
    return _flags(bars, lookback, r > 0, r < 0, r < 0, r > 0, allow_shorts)


def ema_cross(bars: DataFrame, fast: int = 48, slow: int = 192, allow_shorts: bool = True, warmup: int | None = None) -> DataFrame:
    df = k.ema_columns(bars, {"_fast": ("close", fast), "_slow": ("close", slow)})
    up, down = F.col("_fast") > F.col("_slow"), F.col("_fast") < F.col("_slow")
    return _flags(df, 20 * max(fast, slow) if warmup is None else warmup, up, down, down, up, allow_shorts).drop("_fast", "_slow")


def donchian(bars: DataFrame, entry: int = 96, leave: int = 48, allow_shorts: bool = True) -> DataFrame:
    """Channels of the bars before the current one."""

    def edge(f, c: str, n: int) -> Column:
        w = k.series_window().rowsBetween(-n, -1)
        return F.when(F.count(c).over(w) == n, f(c).over(w))

    c = F.col("close")
    return _flags(bars, max(entry, leave), c > edge(F.max, "high", entry), c < edge(F.min, "low", leave), c < edge(F.min, "low", entry), c > edge(F.max, "high", leave), allow_shorts)


def multi_horizon(bars: DataFrame, lookbacks: tuple[int, ...] = (24, 48, 96, 192), vol: int = 96, threshold: float = 0.0, allow_shorts: bool = True) -> DataFrame:
    if not lookbacks or threshold < 0:
        raise ValueError("lookbacks must not be empty and the threshold not negative")
    df = bars.withColumn("_r", k.pct_change(F.col("close"))).withColumn("_v", k.rolling_std(F.col("_r"), vol))
    scores = [k.pct_change(F.col("close"), n) / F.nullif(F.col("_v") * n**0.5, F.lit(0.0)) for n in lookbacks]
    df = df.withColumn("score", sum(scores[1:], scores[0]) / len(scores))
    up, down = F.col("score") > threshold, F.col("score") < -threshold
    return _flags(df, max(*lookbacks, vol), up, down, down, up, allow_shorts).drop("_r", "_v")


def state_machine_v1(frame: DataFrame, m: Lifecycle = Lifecycle(), allow_shorts: bool = True, warmup: int = 0) -> DataFrame:
    """Flags where the lifecycle's target changes sides; `frame` is the lifecycle frame."""
    df = side_changes(signed_target(frame, m, allow_shorts))
    return _flags(df, warmup, *[F.col(c) for c in FLAGS])


def state_machine_v2(frame: DataFrame, m: Lifecycle = Lifecycle(), allow_shorts: bool = True, warmup: int = 0) -> DataFrame:
    """The lifecycle's target as a level, 0 in the warmup."""
    return signed_target(frame, m, allow_shorts).withColumn("target", k.warmed(F.col("target"), warmup, F.lit(0.0)))


#: Generators that need bars alone, by name.
BUILDERS: dict[str, Callable[..., DataFrame]] = {"turnaround_v1": turnaround_v1, "turnaround_v2": turnaround_v2, "sma_pullback": sma_pullback, "trend_rider": trend_rider, "tsmom": tsmom, "ema_cross": ema_cross, "donchian": donchian, "multi_horizon": multi_horizon}
WARMUPS = {"turnaround_v1": 4000, "turnaround_v2": 4000, "sma_pullback": 40, "trend_rider": 40, "tsmom": 96, "ema_cross": 3840, "donchian": 96, "multi_horizon": 192}


def all_signals(bars: DataFrame, names: list[str] | None = None, **options: dict) -> DataFrame:
    """series, ts, strategy and flags of every generator in one tall table.

    The generators are put on one frame one after the other, so bars are read and shuffled once for all of them.
    """
    names, df = names or list(BUILDERS), k.by_series(bars)
    for n in names:
        known = set(df.columns)
        df = BUILDERS[n](df, **options.get(n, {}))
        flags = F.struct(F.lit(n).alias("strategy"), *FLAGS).alias(f"_flags_{n}")
        df = df.select(*[c for c in df.columns if c in known], flags)
    return df.select("series", "ts", F.explode(F.array(*[f"_flags_{n}" for n in names])).alias("x")).select("series", "ts", "x.*")
