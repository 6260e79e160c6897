"""From signals to positions, orders, trades, equity and risk.

Positions and trades are native: an entry that survives the conflict rules sets the position whatever it was, so the position
is the sign of the last entry unless a matching exit came later. Only what really depends on cash held, on the last
submitted level or on a stop inside the bar is folded row by row, for each series (and cost multiple) by itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import windows as k
from tidemark.functions.scan import by_chunks

FLAGS = ("long_entry", "long_exit", "short_entry", "short_exit")
EXIT_MODES = ("continuation_failure", "opposite_signal_only", "trend_failure", "trend_structure", "setup_invalidation_stop")


def resolved(signals: DataFrame) -> DataFrame:
    """An entry and an exit of one side cancel; then two entries cancel."""
    le, lx, se, sx = (F.col(c) for c in FLAGS)
    x = signals.withColumns({"long_entry": le & ~lx, "long_exit": lx & ~le, "short_entry": se & ~sx, "short_exit": sx & ~se})
    return x.withColumns({"long_entry": le & ~se, "short_entry": se & ~le})


def net_position(signals: DataFrame, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """signals with held (after the bar, -1, 0 or 1) and position (one bar later, what the bar's return is earned on)."""
    w = W.partitionBy(*keys).orderBy("ts")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    x = resolved(signals).withColumn("_n", F.row_number().over(w))
    entry = F.when(F.col("long_entry"), 1).when(F.col("short_entry"), -1)
    x = x.withColumns({
        "_side": F.last(entry, True).over(upto),
        "_at": F.coalesce(F.last(F.when(entry.isNotNull(), F.col("_n")), True).over(upto), F.lit(0)),
        "_lx": F.coalesce(F.last(F.when(F.col("long_exit"), F.col("_n")), True).over(upto), F.lit(0)),
        "_sx": F.coalesce(F.last(F.when(F.col("short_exit"), F.col("_n")), True).over(upto), F.lit(0)),
    })
    out = F.when(F.col("_side").isNull() | ((F.col("_side") == 1) & (F.col("_lx") > F.col("_at"))) | ((F.col("_side") == -1) & (F.col("_sx") > F.col("_at"))), 0).otherwise(F.col("_side"))
    x = x.withColumn("held", out.cast("int"))
    return x.withColumn("position", F.coalesce(F.lag("held").over(w), F.lit(0))).drop("_n", "_side", "_at", "_lx", "_sx")


def with_exits(signals: DataFrame, mode: str = "continuation_failure", failure_bars: int = 4, sma: int = 40, trend_ema: str | None = None) -> DataFrame:
    """Exit flags of a mode: the signals' own, and what the mode adds. trend_failure needs the name of an EMA column."""
    lx, sx = F.col("long_exit"), F.col("short_exit")
    if mode in ("opposite_signal_only", "setup_invalidation_stop"):
        return signals
    if mode == "continuation_failure":
        if failure_bars < 1:
            raise ValueError("failure_bars must be 1 at least")
        return signals.withColumns({"long_exit": lx | k.adverse_run(failure_bars), "short_exit": sx | k.adverse_run(failure_bars, False)})
    if mode == "trend_failure":
        if trend_ema is None:
            raise ValueError("trend_failure needs the strategy's EMA")
        return signals.withColumns({"long_exit": lx | F.coalesce(F.col("close") < F.col(trend_ema), F.lit(False)), "short_exit": sx | F.coalesce(F.col("close") > F.col(trend_ema), F.lit(False))})
    if mode == "trend_structure":
        if not signals.where("short_entry").isEmpty():
            raise ValueError("trend_structure has no short exits: turn shorts off")
        return signals.withColumns({"long_exit": sma_break(sma) | k.adverse_run(failure_bars), "short_exit": F.lit(False)})
    raise ValueError(f"exit mode must be one of {EXIT_MODES}")


def sma_break(n: int) -> Column:
    return F.coalesce(F.col("close") < k.rolling_mean(F.col("close"), n), F.lit(False))


def setup_stop(signals: DataFrame) -> DataFrame:
    """setup_stop: distance to the low (high) of the last three bars as a share of the close, on entry bars, where it is positive."""
    long = (F.col("close") - k.rolling_min(F.col("low"), 3)) / F.col("close")
    short = (k.rolling_max(F.col("high"), 3) - F.col("close")) / F.col("close")
    d = F.when(F.col("long_entry"), long).when(F.col("short_entry"), short)
    return signals.withColumn("_d", d).withColumn("setup_stop", F.when(F.col("_d") > 0, F.col("_d"))).drop("_d")


def stop_price(signals: DataFrame, fraction: str = "setup_stop") -> DataFrame:
    d = F.when(F.col("long_entry"), F.col("close") * (1 - F.col(fraction))).when(F.col("short_entry"), F.col("close") * (1 + F.col(fraction)))
    return signals.withColumn("stop_price", d)


def entry_size(signals: DataFrame, cash: float, pct: float, scale: Column | None = None) -> DataFrame:
    """Units bought with a share of the initial cash, on entry bars; 0 elsewhere."""
    size = cash * pct * (F.lit(1.0) if scale is None else scale) / F.col("close")
    return signals.withColumn("entry_size", F.when(F.col("long_entry") | F.col("short_entry"), size).otherwise(0.0))


def entry_shares(capital: float, fraction: Column, price: Column, entry: Column) -> Column:
    return F.when(entry, capital * fraction / price).otherwise(0.0)


def vol_weights(bars: DataFrame, target: float, bars_per_year: float, span: int = 60, most: float = 2.0) -> DataFrame:
    """vol_weight: target over exponentially weighted yearly volatility within [0, most], 0 for the first 20 spans and where unknown."""
    if target <= 0 or most <= 0:
        raise ValueError("target and most must be positive")
    x = k.ew_std(bars.withColumn("_ret", k.pct_change(F.col("close"))), "_vol", "_ret", span)
    year = F.col("_vol") * bars_per_year**0.5
    weight = F.when(year > 0, F.least(target / year, F.lit(most))).otherwise(0.0)
    return x.withColumns({"realised_vol": year, "vol_weight": k.warmed(weight, 20 * span, F.lit(0.0))}).drop("_ret", "_vol")


def fill_price(close: Column, buy: Column, slippage: Column | float) -> Column:
    return close * F.when(buy, 1 + F.lit(slippage)).otherwise(1 - F.lit(slippage))


def fee(quantity: Column, price: Column, rate: Column | float) -> Column:
    return F.lit(rate) * quantity * price


def stressed(df: DataFrame, multiples: tuple[float, ...], fee_rate: float, slippage: float) -> DataFrame:
    """df for each cost multiple, 1 always among them; fees and slippage are multiplied, funding never."""
    if any(m <= 0 for m in multiples):
        raise ValueError("multiples must be positive")
    rows = [(float(m), fee_rate * m, slippage * m) for m in sorted({1.0, *multiples})]
    few = df.sparkSession.createDataFrame(rows, "multiple double, fee_rate double, slippage_rate double")
    return df.crossJoin(F.broadcast(few))  # a fixed handful of multiples


def trades(positions: DataFrame, cash: float = 10_000.0, pct: float = 0.95, fee_rate: Column | float = 0.0006, slippage: Column | float = 0.0002, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Round trips from net_position(): entry and exit bar and price, fees of both legs, profit and return; the last may be open.

    A change of sign closes one trade and opens the next on the same bar. Size is fixed at entry by the initial cash.
    """
    w = W.partitionBy(*keys).orderBy("ts")
    x = positions.withColumn("_before", F.coalesce(F.lag("held").over(w), F.lit(0))).where(F.col("held") != F.col("_before"))
    x = x.select(*keys, "ts", "close", "held", *([] if isinstance(fee_rate, float) else ["fee_rate", "slippage_rate"]))
    x = x.withColumns({"exit_ts": F.lead("ts").over(w), "exit_close": F.lead("close").over(w)}).where("held <> 0")
    long = F.col("held") > 0
    rate, slip = (F.lit(v) if isinstance(v, float) else v for v in (fee_rate, slippage))
    x = x.withColumns({"direction": F.when(long, "long").otherwise("short"), "entry_price": fill_price(F.col("close"), long, slip), "exit_price": fill_price(F.col("exit_close"), ~long, slip)})
    x = x.withColumn("quantity", F.lit(cash * pct) / F.col("close"))
    x = x.withColumns({"entry_fee": fee(F.col("quantity"), F.col("entry_price"), rate), "exit_fee": fee(F.col("quantity"), F.col("exit_price"), rate)})
    gross = F.col("held") * F.col("quantity") * (F.col("exit_price") - F.col("entry_price"))
    x = x.withColumn("pnl", gross - F.col("entry_fee") - F.col("exit_fee"))
    return x.select(*keys, F.col("ts").alias("entry_ts"), "direction", "quantity", "entry_price", "entry_fee", "exit_ts", "exit_price", "exit_fee", "pnl", (F.col("pnl") / (F.col("quantity") * F.col("entry_price"))).alias("return"), F.when(F.col("exit_ts").isNull(), "open").otherwise("closed").alias("status"))


def cash_limited(trade: DataFrame, cash: float, fee_rate: float, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Trades with quantities that the running balance can pay for: a buy takes at most balance / (price * (1 + fee)).

    A fold over each key's trades, which are few beside its bars.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, balance, out = pdf.sort_values("entry_ts", kind="stable"), cash, []
        for t in pdf.itertuples():
            sign = 1 if t.direction == "long" else -1
            q = max(0.0, min(t.quantity, balance / (t.entry_price * (1 + fee_rate)))) if sign > 0 else t.quantity
            balance -= sign * q * t.entry_price + fee_rate * q * t.entry_price
            if t.exit_price is not None and not np.isnan(t.exit_price):
                balance += sign * q * t.exit_price - fee_rate * q * t.exit_price
            out.append((q, balance))
        q = np.array([x for x, _ in out])
        scale = np.divide(q, pdf["quantity"], out=np.zeros(len(q)), where=pdf["quantity"].to_numpy() != 0)
        return pdf.assign(quantity=q, balance=[b for _, b in out], entry_fee=pdf["entry_fee"] * scale, exit_fee=pdf["exit_fee"] * scale, pnl=pdf["pnl"] * scale)

    return trade.groupBy(*keys).applyInPandas(fold, T.StructType([*trade.schema.fields, T.StructField("balance", T.DoubleType())]))


def next_beyond(x: np.ndarray, threshold: float) -> np.ndarray:
    """For each place the first later one whose value is the threshold or more away; len(x) where there is none.

    A table of minima and maxima of stretches of 1, 2, 4, ... places: a place moves on by the longest stretches that stay
    inside its band, the longest first.
    """
    n, low, high = len(x), [x], [x]
    while 1 << len(low) < n:
        half = 1 << (len(low) - 1)
        for table, f in ((low, np.minimum), (high, np.maximum)):
            t = table[-1]
            table.append(np.concatenate([f(t[: n - half], t[half:]), np.full(half, np.nan)]))
    at = np.arange(1, n + 1)
    for j in reversed(range(len(low))):
        fits = at + (1 << j) <= n
        k = np.where(fits, at, 0)
        inside = fits & (np.maximum(high[j][k] - x, x - low[j][k]) < threshold)
        at = np.where(inside, at + (1 << j), at)
    return at


def band_chain(x: np.ndarray, threshold: float, held: float) -> list[int]:
    """Places of the values that are submitted, each the first that is the threshold or more away from the one before; `held` comes first."""
    after = next_beyond(np.concatenate([[held], x]), threshold)
    out, at = [], int(after[0])
    while at <= len(x):
        out.append(at - 1)
        at = int(after[at])
    return out


def band_summary(x: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """What a stretch makes of any held value: its records up and down, and the value held in the end after each of them.

    The first value out of the band of a held one is a record of the stretch, and all that follows depends on that place alone.
    """
    after = next_beyond(x, threshold)
    last = np.arange(len(x))
    while (go := after[last] < len(x)).any():  # doubling: everyone jumps on to where its own next one has come to
        last = np.where(go, last[np.minimum(after[last], len(x) - 1)], last)
    up = np.flatnonzero(np.append(True, x[1:] > np.maximum.accumulate(x)[:-1]))
    down = np.flatnonzero(np.append(True, x[1:] < np.minimum.accumulate(x)[:-1]))
    return up, x[up], x[last[up]], down, x[down], x[last[down]]


def band_advance(held: float, summary: tuple[np.ndarray, ...], threshold: float) -> float:
    up, high, up_end, down, low, down_end = summary
    i = int(np.argmax(high - held >= threshold)) if (high - held >= threshold).any() else -1
    j = int(np.argmax(held - low >= threshold)) if (held - low >= threshold).any() else -1
    if i < 0 and j < 0:
        return held
    return float(up_end[i] if j < 0 or 0 <= i and up[i] <= down[j] else down_end[j])


def banded(targets: DataFrame, threshold: float, chunk_ms: int | None = None) -> DataFrame:
    """submitted: the target where it moved by the threshold or more from the last submitted one, else NULL. No threshold submits each.

    The book starts flat, so the first is measured from 0. A null target is never submitted. With chunk_ms a series is spread over chunks of so much time.
    """
    if threshold < 0:
        raise ValueError(f"the threshold must not be negative, got {threshold}")
    if threshold == 0:
        return targets.withColumn("submitted", F.col("target"))

    def values(pdf: pd.DataFrame) -> np.ndarray:
        return pdf["target"].dropna().to_numpy(float)

    def replay(pdf: pd.DataFrame, held: float) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        known = np.flatnonzero(pdf["target"].notna())
        out = np.full(len(pdf), np.nan)
        at = known[band_chain(values(pdf), threshold, held)]
        out[at] = pdf["target"].to_numpy(float)[at]
        return pdf.assign(submitted=pd.Series(out).astype("Float64").where(~np.isnan(out), None))

    schema = T.StructType([*targets.schema.fields, T.StructField("submitted", T.DoubleType())])
    if chunk_ms is None:
        return targets.groupBy("series").applyInPandas(lambda pdf: replay(pdf, 0.0), schema)
    summary = lambda pdf: band_summary(values(pdf), threshold) if len(values(pdf)) else None
    return by_chunks(targets, ("series",), chunk_ms, 0.0, summary, lambda held, s: held if s is None else band_advance(held, s, threshold), replay, schema)


def target_orders(targets: DataFrame, cash: float, pct: float) -> DataFrame:
    """desired (units, from the last submitted level), order (change of it) and position_fraction of the initial cash."""
    w = k.series_window()
    desired = F.when(F.col("submitted").isNotNull(), F.col("submitted") * (cash * pct) / F.col("close"))
    x = targets.withColumn("desired", F.coalesce(F.last(desired, True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0)))
    x = x.withColumn("order", F.col("desired") - F.coalesce(F.lag("desired").over(w), F.lit(0.0)))
    return x.withColumn("position_fraction", F.col("desired") * F.col("close") / cash)


def stopped_positions(signals: DataFrame) -> DataFrame:
    """held and stop_hit under a protective stop: a position closes inside the bar that trades through its stop and may be entered anew.

    The stop does not trail. The path matters, so each series is folded in order; `signals` has resolved flags, prices and setup_stop.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        pos, stop, held, hits = 0, None, [], []
        for r in pdf.itertuples():
            hit = pos != 0 and stop is not None and ((pos > 0 and r.low <= stop) or (pos < 0 and r.high >= stop))
            exit_at = (min(r.open, stop) if pos > 0 else max(r.open, stop)) if hit else None
            if hit:
                pos, stop = 0, None
            entry = 1 if r.long_entry else -1 if r.short_entry else 0
            if entry and entry != pos:
                pos = entry
                stop = None if r.setup_stop is None or np.isnan(r.setup_stop) else r.close * (1 - entry * r.setup_stop)
            elif (pos > 0 and r.long_exit) or (pos < 0 and r.short_exit):
                pos, stop = 0, None
            held.append(pos)
            hits.append(exit_at)
        return pdf.assign(held=np.array(held, dtype="int32"), stop_hit=pd.Series(hits, index=pdf.index, dtype="float64"))

    return signals.groupBy("series").applyInPandas(fold, T.StructType([*signals.schema.fields, T.StructField("held", T.IntegerType()), T.StructField("stop_hit", T.DoubleType())]))


def held_notional(positions: DataFrame, units: str = "units") -> DataFrame:
    """Signed value held into each bar, at its open."""
    return positions.withColumn("notional", F.coalesce(k.lag(units) * F.col("open"), F.lit(0.0)))


def slippage_paid(orders: DataFrame, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Sum of quantity * reference * slippage of fills (buy, price, quantity, slippage_rate); the reference is the price before it."""
    reference = F.col("price") / F.when(F.col("buy"), 1 + F.col("slippage_rate")).otherwise(1 - F.col("slippage_rate"))
    return orders.groupBy(*keys).agg(F.sum(F.col("quantity") * reference * F.col("slippage_rate")).alias("slippage_paid"), F.count("*").alias("fills"))


def bar_returns(positions: DataFrame, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """ret: the close's change times the position of the bar, 0 where there is none."""
    w = W.partitionBy(*keys).orderBy("ts")
    return positions.withColumn("ret", F.coalesce((F.try_divide("close", F.lag("close").over(w)) - 1) * F.col("position"), F.lit(0.0)))


def equity_curve(returns: DataFrame, keys: tuple[str, ...] = ("series",), flow: str | None = None) -> DataFrame:
    """equity (from 1), with cumulated flows if any, and drawdown below the highest point, which is 1 at the start."""
    upto = W.partitionBy(*keys).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    ruined = F.max(F.when(F.col("ret") <= -1, 1).otherwise(0)).over(upto)
    x = returns.withColumn("equity", F.when(ruined == 1, 0.0).otherwise(F.exp(F.sum(F.log1p(F.greatest("ret", F.lit(-0.999999999999)))).over(upto))))
    if flow:
        x = x.withColumn("equity", F.col("equity") + F.sum(flow).over(upto))
    return x.withColumn("drawdown", F.col("equity") / F.greatest(F.max("equity").over(upto), F.lit(1.0)) - 1)


def risk_statistics(curve: DataFrame, bars_per_year: float, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Totals, drawdown and its longest duration in bars, yearly return and volatility, Sharpe, Sortino, Calmar, Omega, ruin."""
    w = W.partitionBy(*keys).orderBy("ts")
    x = curve.withColumn("_n", F.row_number().over(w)).withColumn("_r", F.coalesce(F.try_divide("equity", F.coalesce(F.lag("equity").over(w), F.lit(1.0))) - 1, F.lit(0.0)))
    x = x.withColumn("_top", F.last(F.when(F.col("drawdown") >= 0, F.col("_n")), True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    year = float(bars_per_year)
    a = x.groupBy(*keys).agg(
        F.count("*").alias("bars"), F.max_by("equity", "_n").alias("end_value"), F.min("drawdown").alias("max_drawdown"), F.max(F.col("_n") - F.coalesce("_top", F.lit(0))).alias("drawdown_bars"),
        F.avg("_r").alias("_mean"), F.stddev_samp("_r").alias("_sd"), F.sqrt(F.avg(F.pow(F.least("_r", F.lit(0.0)), 2))).alias("_down"),
        F.sum(F.greatest("_r", F.lit(0.0))).alias("_gain"), (-F.sum(F.least("_r", F.lit(0.0)))).alias("_loss"), F.min("equity").alias("least_equity"), F.count_if(F.col("equity") <= 0).alias("ruined_bars"),
    )
    a = a.withColumn("annual_return", F.when(F.col("end_value") > 0, F.pow("end_value", F.lit(year) / F.col("bars")) - 1))
    ratio = lambda p, q: F.when(q > 0, p / q)
    return a.select(
        *keys, "bars", (F.col("end_value") - 1).alias("total_return"), "end_value", "max_drawdown", "drawdown_bars", "annual_return", (F.col("_sd") * year**0.5).alias("annual_volatility"),
        F.coalesce(ratio(F.col("_mean") * year**0.5, F.col("_sd")), F.lit(0.0)).alias("sharpe"), ratio(F.col("_mean") * year**0.5, F.col("_down")).alias("sortino"), ratio(F.col("annual_return"), -F.col("max_drawdown")).alias("calmar"), ratio(F.col("_gain"), F.col("_loss")).alias("omega"), "least_equity", "ruined_bars",
    )


def beats(a: Column, a_ruined: Column, b: Column, b_ruined: Column) -> Column:
    """Whether a is better than b; NULL where either curve is ruined, which can't be compared."""
    return F.when(~a_ruined & ~b_ruined, a > b)


def trade_statistics(trade: DataFrame, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    closed = F.col("status") == "closed"
    gain, loss = F.sum(F.when(closed & (F.col("pnl") > 0), F.col("pnl"))), F.sum(F.when(closed & (F.col("pnl") < 0), -F.col("pnl")))
    return trade.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.count_if(closed).alias("closed"), (F.count_if(closed & (F.col("pnl") > 0)) / F.nullif(F.count_if(closed), F.lit(0))).alias("win_rate"),
        (gain / loss).alias("profit_factor"), F.sum(F.col("entry_fee") + F.coalesce("exit_fee", F.lit(0.0))).alias("fees_paid"), F.sum(F.when(closed, F.col("pnl"))).alias("closed_net"),
    )


def benchmark_return(bars: DataFrame) -> DataFrame:
    return bars.groupBy("series").agg((F.try_divide(F.max_by("close", "ts"), F.min_by("close", "ts")) - 1).alias("benchmark_return"))


def fill_markers(trade: DataFrame, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Entry points and the exits of closed trades, by time and kind."""
    entry = trade.select(*keys, F.col("entry_ts").alias("ts"), F.lit("entry").alias("kind"), "direction", F.col("entry_price").alias("price"))
    leave = trade.where("status = 'closed'").select(*keys, F.col("exit_ts").alias("ts"), F.lit("exit").alias("kind"), "direction", F.col("exit_price").alias("price"))
    return entry.unionByName(leave).orderBy(*keys, "ts", "kind")


def cost_waterfall(costed: DataFrame, costless: DataFrame, funding: DataFrame | None = None, cash: float = 10_000.0) -> DataFrame:
    """For each series and multiple: gross return without costs, fees, slippage, funding, what costs changed in size, and the net."""
    closed = lambda t: t.where("status = 'closed'")
    gross = closed(costless).groupBy("series").agg(F.sum("pnl").alias("gross"))
    slip = F.col("quantity") * (F.col("entry_price") - F.col("entry_price") / F.when(F.col("direction") == "long", 1 + F.col("slippage_rate")).otherwise(1 - F.col("slippage_rate")))
    slip_out = F.col("quantity") * (F.col("exit_price") - F.col("exit_price") / F.when(F.col("direction") == "long", 1 - F.col("slippage_rate")).otherwise(1 + F.col("slippage_rate")))
    x = closed(costed).groupBy("series", "multiple").agg(F.sum("pnl").alias("net"), F.sum(F.col("entry_fee") + F.col("exit_fee")).alias("fees"), F.sum(F.abs(slip) + F.abs(slip_out)).alias("slippage"))
    x = x.join(gross, "series", "left")
    x = x.join(funding.select("series", F.col("paid").alias("funding")), "series", "left") if funding is not None else x.withColumn("funding", F.lit(0.0))
    x = x.withColumns({"funding": F.coalesce("funding", F.lit(0.0)), "gross": F.coalesce("gross", F.lit(0.0))}).withColumn("net", F.col("net") - F.col("funding"))
    return x.select("series", "multiple", (F.col("gross") / cash).alias("gross_return"), "fees", "slippage", "funding", (F.col("gross") - F.col("net") - F.col("fees") - F.col("slippage") - F.col("funding")).alias("size_effect"), (F.col("net") / cash).alias("net_return"))
