"""Joins of series in time: settlements to the bars that contain them, coverage, snapshots, and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.times import window_ends


#: Time range of a series that one task of the containment join gets.
RANGE_MS = 7 * 86_400_000


def contained(bars: DataFrame, funding: DataFrame, range_ms: int = RANGE_MS) -> DataFrame:
    """series, ts (the bar), settled and rate of each settlement that lies inside the bars' window.

    A settlement belongs to the last bar that opens at or before it. Series are cut into ranges of time: within a range bars
    and settlements are put in one order and the last bar is carried forward; what the ranges before leave behind, one row a
    range, is carried along the series by itself. So tasks grow with the rows, not with the number of series.
    """
    both = bars.select("series", F.col("ts").alias("at"), F.lit(0).alias("kind"), F.col("ts").alias("bar"), F.lit(None).cast("double").alias("rate")).unionByName(
        funding.where("rate is not null").select("series", F.col("settled").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("timestamp").alias("bar"), F.col("rate").cast("double").alias("rate"))
    )
    both = both.withColumn("range", F.floor(F.unix_millis("at") / range_ms))
    earlier = W.partitionBy("series").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = both.groupBy("series", "range").agg(F.max("bar").alias("newest")).withColumn("carried", F.max("newest").over(earlier))
    ranges = ranges.join(window_ends(bars).select("series", "end_ts").hint("merge"), "series").select("series", "range", "carried", "end_ts")
    order = W.partitionBy("series", "range").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("bar", F.last("bar", ignorenulls=True).over(order)).where("kind = 1").join(ranges.hint("merge"), ["series", "range"])
    found = found.withColumn("bar", F.coalesce("bar", "carried")).where("bar is not null")
    return found.where(F.col("end_ts").isNull() | (F.col("at") < F.col("end_ts"))).select("series", F.col("bar").alias("ts"), F.col("at").alias("settled"), "rate")


def with_funding(bars: DataFrame, funding: DataFrame) -> DataFrame:
    """bars with funding_rate: the sum of the rates settled in the bar, exactly 0 where none was."""
    per_bar = contained(bars, funding).groupBy("series", "ts").agg(F.sum("rate").alias("funding_rate"))
    return bars.join(per_bar, ["series", "ts"], "left").withColumn("funding_rate", F.coalesce("funding_rate", F.lit(0.0)))


def funding_cash(positions: DataFrame, funding: DataFrame, position: str = "position") -> DataFrame:
    """positions with cash_flow = -position * rates settled in the bar."""
    x = with_funding(positions, funding)
    return x.withColumn("cash_flow", -F.col(position) * F.col("funding_rate"))


def funding_ledger(positions: DataFrame, funding: DataFrame, position: str = "position") -> DataFrame:
    """One row for each settlement that is charged: bar, settled, notional, rate, cash_flow."""
    held = positions.select("series", "ts", F.col(position).alias("notional"))
    x = contained(positions, funding).join(held, ["series", "ts"])
    return x.select("series", F.col("ts").alias("bar"), "settled", "notional", "rate", (-F.col("notional") * F.col("rate")).alias("cash_flow"))


def coverage_gaps(bars: DataFrame, funding: DataFrame) -> DataFrame:
    """series, gap_start, gap_end of stretches of the bars' window without settlements.

    The cadence is the median spacing and must be seen twice (within a tenth); without it, or with fewer than two
    settlements, the whole window is a gap. At the head one cadence is missing, inside one and a half, at the tail more than one.
    """
    window = window_ends(bars).select("series", "first_ts", "end_ts")
    x = funding.where("rate is not null").join(window, "series").where((F.col("settled") >= F.col("first_ts")) & (F.col("end_ts").isNull() | (F.col("settled") < F.col("end_ts"))))
    w = W.partitionBy("series").orderBy("settled")
    x = x.select("series", "settled", F.lead("settled").over(w).alias("next")).withColumn("gap", F.unix_micros("next") - F.unix_micros("settled"))
    cadence = x.groupBy("series").agg(F.percentile("gap", F.lit(0.5)).alias("cadence"), F.min("settled").alias("first"), F.max("settled").alias("last"), F.count("*").alias("n"))
    x = x.join(cadence, "series")
    repeated = x.groupBy("series").agg(F.count_if(F.abs(F.col("gap") - F.col("cadence")) <= F.col("cadence") * 0.1).alias("repeats"))
    known = window.join(cadence, "series", "left").join(repeated, "series", "left").withColumn("sure", F.coalesce((F.col("n") >= 2) & (F.col("repeats") >= 2), F.lit(False)))
    whole = known.where("not sure").select("series", F.col("first_ts").alias("gap_start"), F.col("end_ts").alias("gap_end"))
    head = known.where("sure").where(F.unix_micros("first") - F.unix_micros("first_ts") >= F.col("cadence")).select("series", F.col("first_ts").alias("gap_start"), F.col("first").alias("gap_end"))
    tail = known.where("sure").where(F.unix_micros("end_ts") - F.unix_micros("last") > F.col("cadence")).select("series", F.col("last").alias("gap_start"), F.col("end_ts").alias("gap_end"))
    sure = known.where("sure").select("series")
    inner = x.where(F.col("gap") > F.col("cadence") * 1.5).join(sure, "series", "left_semi").select("series", F.col("settled").alias("gap_start"), F.col("next").alias("gap_end"))
    return whole.unionByName(head).unionByName(inner).unionByName(tail)


def funding_status(bars: DataFrame, funding: DataFrame, required: bool) -> DataFrame:
    """series, gaps and status: attached, no column, or refused (where funding is required and not covered), with the reason."""
    gaps = coverage_gaps(bars, funding).groupBy("series").agg(F.count("*").alias("gaps"), F.min("gap_start").alias("first_gap"))
    x = bars.select("series").distinct().join(gaps, "series", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)))
    bad = F.lit("refused") if required else F.lit("no column")
    return x.select("series", "gaps", F.when(F.col("gaps") == 0, "attached").otherwise(bad).alias("status"), F.when(F.col("gaps") > 0, F.concat(F.lit("gap from "), F.date_format("first_gap", "yyyy-MM-dd HH:mm"))).otherwise("").alias("reason"))


def attach_funding(bars: DataFrame, funding: DataFrame, required: bool = True) -> DataFrame:
    """Bars of covered series with their funding column. Required funding that is not covered is an error that names the series."""
    status = funding_status(bars, funding, required)
    bad = status.where("status = 'refused'").orderBy("series").limit(5).collect()
    if bad:
        raise ValueError("funding does not cover " + "; ".join(f"{r['series']} ({r['reason']})" for r in bad))
    return with_funding(bars.join(status.where("status = 'attached'").select("series"), "series", "left_semi"), funding)


def funded_bars(bars: DataFrame, span: DataFrame) -> DataFrame:
    """Bars between the first and last settlement; series without settlements keep their whole history."""
    x = bars.join(span.select("series", "first_settled", "last_settled"), "series", "left")
    return x.where(F.col("first_settled").isNull() | F.col("ts").between(F.col("first_settled"), F.col("last_settled"))).select(*bars.columns)


def widened_start(starts: DataFrame, nth: DataFrame, width_ms: int) -> DataFrame:
    """The earlier of a window's start and one bar before the n-th newest settlement."""
    x = starts.join(nth.select("series", "settled"), "series", "left")
    return x.select("series", F.least("start", F.timestamp_millis(F.unix_millis("settled") - width_ms)).alias("start"))


def snapshots(bars: DataFrame, width_ms: int) -> DataFrame:
    """close_ms and a map from series to its bar; a series without a bar at an instant is absent."""
    x = bars.withColumn("close_ms", F.unix_millis("ts") + width_ms - 1)
    bar = F.struct("open", "high", "low", "close", "volume")
    return x.groupBy("close_ms").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("series", bar)))).alias("bars"), F.count("*").alias("present"))


def unknown_roles(bars: DataFrame, roles: DataFrame) -> DataFrame:
    """Instruments of the roles table (series, role) that have no bars."""
    return roles.join(bars.select("series").distinct(), "series", "left_anti")


def traded(bars: DataFrame, roles: DataFrame) -> DataFrame:
    return bars.join(roles.where("role = 'trade'").select("series"), "series", "left_semi")


def bar_diff(live: DataFrame, stored: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """For each live bar: whether the stored one is absent, and how many columns differ by more than the tolerance."""
    columns = [c for c in ("open", "high", "low", "close", "volume", "funding_rate") if c in live.columns and c in stored.columns]
    b = stored.select("series", "ts", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_there"))
    x = live.join(b, ["series", "ts"], "left")
    off = [F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")) & F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) > tolerance, F.lit(True)), 1).otherwise(0) for c in columns]
    return x.select("series", "ts", F.col("_there").isNull().alias("absent"), F.when(F.col("_there").isNotNull(), sum(off[1:], off[0])).otherwise(0).alias("differing"))


def signal_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(series, ts, side) of one set only, and which."""
    a, b = (x.select("series", "ts", "side").distinct() for x in (a, b))
    return a.exceptAll(b).withColumn("only_in", F.lit("a")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("b")))


def reason_diff(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Names that differ for a bar: a missing name is not a null value, and a row of one side only counts by all its names."""

    def long(x: DataFrame, v: str) -> DataFrame:
        return x.select("series", "ts", F.explode(F.map_from_arrays("feature_names", "feature_values")).alias("name", v)).withColumn(f"has_{v}", F.lit(True))

    both = long(a, "x").join(long(b, "y"), ["series", "ts", "name"], "full_outer")
    same = F.col("x").eqNullSafe(F.col("y")) | F.coalesce(F.abs(F.col("x") - F.col("y")) <= tolerance, F.lit(False))
    missing = F.col("has_x").isNull() | F.col("has_y").isNull()
    return both.where(missing | ~same).select("series", "ts", "name", F.when(F.col("has_x").isNull(), "only in b").when(F.col("has_y").isNull(), "only in a").otherwise("value").alias("difference"))


def verdict(checks: DataFrame) -> DataFrame:
    """One row from (section, exercised, failures): fail, pass, or pass without all sections exercised."""
    x = checks.agg(F.sum("failures").alias("f"), F.bool_and(F.col("exercised") > 0).alias("all"))
    return x.select(F.when(F.col("f") > 0, "fail").when(F.col("all"), "pass").otherwise("pass, not all exercised").alias("verdict"))


def forming(ts: Column, width_ms: int, newest: Column) -> Column:
    return F.unix_millis(ts) + width_ms > F.unix_millis(newest)
