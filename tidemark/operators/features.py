"""State features of bar series: how price leans, how efficiently it moves, and how that ranks in its own history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import windows as k

FAST, SLOW, ATR, SPAN, RANK, VOL = 24, 96, 24, 96, 480, 24
ACCRUAL, CARRY = 6, 180
MIN_INSTRUMENTS = 2
LIFECYCLE = ("direction", "strength", "stability", "crowding", "energy")
#: Bars before each feature is measured, with the default windows.
WARMUP = {"direction": 5 * SLOW, "strength": SPAN, "persistence": SPAN, "stability": SPAN, "energy": VOL + RANK - 1, "compression": VOL + RANK - 1, "compression_release": VOL + RANK, "participation": RANK, "crowding": ACCRUAL + CARRY - 2}


def with_inputs(bars: DataFrame) -> DataFrame:
    """Columns that several kernels read: rn, tr, ln_close, log_return."""
    df = bars.withColumns({"rn": F.row_number().over(k.series_window()), "tr": k.true_range(), "ln_close": F.log("close")})
    return df.withColumn("log_return", F.col("ln_close") - k.lag("ln_close"))


def feature_frame(bars: DataFrame, fast: int = FAST, slow: int = SLOW, atr: int = ATR, span: int = SPAN, rank: int = RANK, vol: int = VOL, chunk_ms: int | None = None) -> DataFrame:
    """bars with the price and volume features, NULL inside each one's warmup. One shuffle by series serves all windows.

    chunk_ms: the ranks' windows run over chunks of a series of so much time.
    """
    df = k.ema_columns(with_inputs(k.by_series(bars)), {"ema_fast": ("close", fast), "ema_slow": ("close", slow)})
    r2, residual = k.log_fit(span)
    net, path = F.abs(F.col("close") - k.lag("close", span)), k.rolling_sum(F.col("step"), span)
    df = df.withColumn("step", F.abs(F.col("close") - k.lag("close")))
    df = df.withColumns({"trf": k.true_range_fraction(atr), "trf_span": k.true_range_fraction(span), "r2": r2, "residual": residual, "net": net, "path": path, "rv": k.realised_volatility(vol)})
    scale = (abs(slow - fast) / 2) ** 0.5 or 1.0
    ratio = F.when(F.col("trf") == 0, 0.0).otherwise((F.col("ema_fast") - F.col("ema_slow")) / F.col("close") / F.col("trf"))
    scatter = F.when(F.col("trf_span") == 0, 0.0).otherwise(F.least(F.greatest(F.col("residual") / (F.col("trf_span") * span**0.5), F.lit(0.0)), F.lit(1.0)))
    df = df.withColumns({
        "direction": k.warmed(F.tanh(ratio / scale), 5 * max(fast, slow)),
        "strength": k.warmed(F.when(F.col("path") == 0, 0.0).otherwise(F.col("net") / F.col("path")), span),
        "persistence": k.warmed(F.col("r2"), span),
        "stability": k.warmed(1.0 - scatter, span),
    })
    df = k.rank_columns(df, {"energy": ("rv", rank), "participation": ("volume", rank)}, chunk_ms)
    df = df.withColumns({"energy": k.warmed(F.col("energy"), vol + rank - 1), "participation": k.warmed(F.col("participation"), rank)})
    df = df.withColumn("compression", 1.0 - F.col("energy"))
    df = df.withColumn("compression_release", k.warmed(-(F.col("compression") - k.lag("compression")), vol + rank))
    return df.drop("step", "r2", "residual", "net", "path")


def crowding(bars: DataFrame, accrual: int = ACCRUAL, zwindow: int = CARRY) -> DataFrame:
    """bars with crowding, from 0 to 1; a table without a funding_rate column is refused."""
    if "funding_rate" not in bars.columns:
        raise ValueError("crowding needs a funding_rate column; attach one by the containment join")
    df = bars.withColumn("_accrued", k.rolling_sum(F.col("funding_rate"), accrual))
    return df.withColumn("crowding", k.warmed((F.tanh(k.rolling_zscore(F.col("_accrued"), zwindow)) + 1) / 2, accrual + zwindow - 2)).drop("_accrued")


def breadth(bars: DataFrame, least: int = MIN_INSTRUMENTS) -> DataFrame:
    """Share of instruments whose close is above their open at each instant that has enough of them."""
    return bars.groupBy("ts").agg(F.avg((F.col("close") > F.col("open")).cast("double")).alias("breadth"), F.count("*").alias("instruments")).where(F.col("instruments") >= least)


def confirms(bars: DataFrame, leader: str, quorum: float = 0.5) -> DataFrame:
    """ts and whether at least the quorum of the followers moves the way the leader does; false without leader, its move or followers."""
    if not 0 <= quorum <= 1:
        raise ValueError("quorum must lie in 0..1")
    sign = F.signum(F.col("close") - F.col("open"))
    at = bars.groupBy("ts").agg(F.max(F.when(F.col("series") == leader, sign)).alias("lead"), *[F.sum(((F.col("series") != leader) & (sign == s)).cast("int")).alias(f"n{i}") for i, s in enumerate((-1, 1))], F.sum((F.col("series") != leader).cast("int")).alias("followers"))
    agree = F.when(F.col("lead") > 0, F.col("n1")).when(F.col("lead") < 0, F.col("n0"))
    return at.select("ts", F.coalesce((F.col("followers") > 0) & (F.col("lead") != 0) & (agree / F.col("followers") >= quorum), F.lit(False)).alias("confirmed"), "followers")


def availability(frame: DataFrame, names: list[str]) -> DataFrame:
    """series, feature, values and whether it can be diagnosed, with the reason if not."""
    long = frame.unpivot(["series"], [F.col(n).cast("double").alias(n) for n in names if n in frame.columns], "feature", "value")
    found = long.groupBy("series", "feature").agg(F.count("value").alias("values"))
    reason = F.when((F.col("feature") == "crowding") & (F.col("values") == 0), "no funding").when(F.col("values") == 0, "shorter than the warmup")
    return found.withColumns({"computable": F.col("values") > 0, "reason": F.coalesce(reason, F.lit(""))})


def lifecycle_frame(frame: DataFrame, rank: int = RANK, chunk_ms: int | None = None) -> DataFrame:
    """Inputs of the lifecycle: direction as it is, strength and stability ranked, energy, and crowding or a neutral constant with a flag."""
    w = W.partitionBy("series")
    funded = F.count("crowding").over(w) > 0 if "crowding" in frame.columns else F.lit(False)
    crowd = F.when(funded, F.col("crowding")).otherwise(0.5) if "crowding" in frame.columns else F.lit(0.5)
    df = k.rank_columns(frame.withColumns({"crowding": crowd, "crowding_measured": funded}), {"_strength": ("strength", rank), "_stability": ("stability", rank)}, chunk_ms)
    df = df.withColumns({"strength": F.col("_strength"), "stability": F.col("_stability")}).drop("_strength", "_stability")
    return df.withColumn("measurable", measurable())


def measurable() -> Column:
    found = F.lit(True)
    for c in LIFECYCLE:
        found = found & F.col(c).isNotNull() & ~F.isnan(c)
    return found


def derived_warmup(convergence_bars: int, rank: int = RANK, funded: bool = False, multiple: int = 8) -> int:
    """Bars before lifecycle states count: the slowest input, and several times the machine's memory."""
    needs = [WARMUP["direction"], WARMUP["strength"] + rank - 1, WARMUP["stability"] + rank - 1, WARMUP["energy"]] + ([WARMUP["crowding"]] if funded else [])
    return max(needs) + multiple * convergence_bars
