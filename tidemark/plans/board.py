"""Board views: what is stored, the latest row of each series and strategy, staleness, reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.bars import catalog


def datasets(stored: DataFrame, market_type: str | None = None) -> DataFrame:
    x = catalog(stored)
    return x if market_type is None else x.where(F.col("market_type") == market_type)


def latest_rows(bars: DataFrame, states: DataFrame, signals: DataFrame, warmups: dict[str, int], closes: int = 5) -> DataFrame:
    """One row for each series and strategy: as_of, state, newest signal, the last closes; a series inside the warmup is a row with the reason."""
    spark = bars.sparkSession
    few = spark.createDataFrame(list(warmups.items()), "strategy string, warmup int")
    last = F.slice(F.reverse(F.sort_array(F.collect_list(F.struct("ts", "close")))), 1, closes)
    # only the newest bars are collected
    from pyspark.sql import Window as W

    newest = bars.withColumn("_b", F.row_number().over(W.partitionBy("series").orderBy(F.desc("ts")))).withColumn("_n", F.count("*").over(W.partitionBy("series")))
    base = newest.where(F.col("_b") <= closes).groupBy("series").agg(F.max("ts").alias("as_of"), F.max("_n").alias("bars"), F.transform(last, lambda x: x["close"]).alias("closes"))
    state = states.groupBy("series").agg(F.max_by("state", "ts").alias("state"))
    flags = ("long_entry", "long_exit", "short_entry", "short_exit")
    named = F.concat_ws(",", *[F.when(F.col(c), c) for c in flags])
    fired = signals.where(F.col("long_entry") | F.col("long_exit") | F.col("short_entry") | F.col("short_exit"))
    newest_signal = fired.groupBy("series", "strategy").agg(F.max("ts").alias("signal_ts"), F.max_by(named, "ts").alias("signal"))
    x = base.join(state, "series", "left").crossJoin(F.broadcast(few)).join(newest_signal, ["series", "strategy"], "left")
    refused = F.col("bars") <= F.col("warmup")
    return x.select("series", "strategy", "as_of", "bars", F.when(~refused, F.col("state")).alias("state"), F.when(~refused, F.col("signal_ts")).alias("signal_ts"), F.when(~refused, F.col("signal")).alias("signal"), "closes", F.when(refused, F.concat(F.lit("needs more than "), F.col("warmup").cast("string"), F.lit(" bars"))).otherwise("").alias("reason"))


def staleness(board: DataFrame, now: Column, days: int = 31) -> DataFrame:
    """stale: a perpetual behind the newest bar of its kind, or another series not written for so many days."""
    newest = board.groupBy("market_type").agg(F.max("last_ts").alias("newest"))
    x = board.join(newest, "market_type")
    return x.withColumn("stale", F.when(F.col("market_type") == "perp", F.col("last_ts") < F.col("newest")).otherwise(F.datediff(now, "written_at") > days))


def reach(stored: DataFrame, warmups: dict[str, int]) -> DataFrame:
    """For each series and strategy whether the stored bars reach past the warmup."""
    few = stored.sparkSession.createDataFrame(list(warmups.items()), "strategy string, warmup int")
    return catalog(stored).crossJoin(F.broadcast(few)).select("exchange", "market_type", "symbol", "timeframe", "strategy", "bars", "warmup", (F.col("bars") > F.col("warmup")).alias("reached"))


def provenance(run_id: str, exit_mode: str, warmups: dict[str, int], bars: DataFrame) -> DataFrame:
    few = bars.sparkSession.createDataFrame(list(warmups.items()), "strategy string, warmup int")
    span = bars.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("bars"))
    return few.crossJoin(F.broadcast(span)).withColumns({"run_id": F.lit(run_id), "exit_mode": F.lit(exit_mode)})


def state_view(frame: DataFrame, states: DataFrame, features: list[str]) -> DataFrame:
    """Bars, state and features; nothing of the ledger is computed."""
    return frame.select("series", "ts", "close", *features).join(states.select("series", "ts", "state"), ["series", "ts"])


def why_layer(view: DataFrame, features: list[str]) -> DataFrame:
    """series, ts, state and a map from feature to value (null where it is not measured)."""
    return view.select("series", "ts", "state", F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*features)).alias("features"))
