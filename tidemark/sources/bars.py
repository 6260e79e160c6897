"""Bars and settlements: reading, normalising, keeping, and the test tables' bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ("exchange", "market_type", "symbol", "timeframe")
PRICES = ("open", "high", "low", "close", "volume")
DECIMAL = T.DecimalType(38, 18)
BAR_SCHEMA = T.StructType([*(T.StructField(c, T.StringType(), False) for c in KEY), T.StructField("ts", T.TimestampType(), False), *(T.StructField(c, DECIMAL, False) for c in PRICES), T.StructField("source", T.StringType()), T.StructField("updated_at", T.TimestampType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(rows: DataFrame, series: Column, ts: Column, price: Column, order: list[str], volume: Column) -> DataFrame:
    x = rows.select(series.alias("series"), ts.cast("timestamp").alias("ts"), price.alias("price"), F.struct(*order).alias("at"), volume.alias("size"))
    return x.groupBy("series", "ts").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("size").cast("double").alias("volume")
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long daily series from lineitem: four series by supplier, price per unit, volume in units."""
    x = table(spark, sf_dir, "lineitem")
    return _bars(x, F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string")), F.col("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"], F.col("l_quantity"))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly series from events, one for each type; hours without events have no bar."""
    x = table(spark, sf_dir, "events")
    return _bars(x, F.col("event_type"), F.date_trunc("hour", F.col("ts").cast("timestamp")), F.col("value"), ["ts", "event_id"], F.lit(1))


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series from orders, one for each priority."""
    x = table(spark, sf_dir, "orders")
    return _bars(x, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), ["o_orderkey"], F.lit(1))


def settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, settled (irregular instants) and rate from the events."""
    x = table(spark, sf_dir, "events")
    return x.select(F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("settled"), ((F.col("value") - 50) / 100000).alias("rate"))


def keyed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars in the stored form: the four-part key, decimals and the source."""
    b = hourly_bars(spark, sf_dir)
    return b.select(
        F.lit("venue").alias("exchange"), F.when(F.col("series") < "d", "perp").otherwise("spot").alias("market_type"), F.col("series").alias("symbol"), F.lit("1h").alias("timeframe"), "ts", *[F.col(c).cast(DECIMAL).alias(c) for c in PRICES], F.lit("events").alias("source"), F.col("ts").alias("updated_at")
    )


def normalise(rows: DataFrame, sequence: str, **identity: str) -> DataFrame:
    """Stored bars from a raw batch: identity attached, prices required, one row for each key and instant, the last in sequence.

    Rows that lack a price or an instant are an error of the batch and are refused by the count that invalid() gives.
    """
    x = rows.withColumns({k: F.lit(v) for k, v in identity.items()})
    newest = F.row_number().over(W.partitionBy(*KEY, "ts").orderBy(F.desc(sequence)))
    return x.withColumn("_newest", newest).where("_newest = 1").select(*KEY, "ts", *[F.col(c).cast("string").cast(DECIMAL).alias(c) for c in PRICES], *[c for c in ("source", "updated_at") if c in x.columns])


def invalid(rows: DataFrame) -> DataFrame:
    """Rows that break a bar's invariants: a missing value, high below low, a price outside them, or negative volume."""
    missing = F.col("ts").isNull()
    for c in PRICES:
        missing = missing | F.col(c).isNull()
    outside = (F.col("high") < F.col("low")) | (F.greatest("open", "close") > F.col("high")) | (F.least("open", "close") < F.col("low")) | (F.col("volume") < 0)
    return rows.where(missing | F.coalesce(outside, F.lit(False)))


def upsert(stored: DataFrame, new: DataFrame, key: tuple[str, ...], version: str = "updated_at") -> DataFrame:
    """Rows of both, one for each key, the one of the highest version; at equal versions a new row wins.

    One partial aggregate by key; the whole row travels as a struct.
    """
    rest = [c for c in stored.columns if c not in key]
    both = stored.select(*stored.columns, F.lit(0).alias("_new")).unionByName(new.select(*stored.columns, F.lit(1).alias("_new")))
    kept = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("_row"))
    return kept.select(*key, *[F.col("_row")[c].alias(c) for c in rest]).select(*stored.columns)


def write_bars(bars: DataFrame, path: str) -> None:
    """Overwrite the partitions (market_type, timeframe) that bars has, rows of a series together and in order."""
    spark = bars.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        bars.repartition("market_type", "timeframe", "symbol").sortWithinPartitions("exchange", "symbol", "ts").write.mode("overwrite").partitionBy("market_type", "timeframe").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def load_bars(stored: DataFrame, start=None, end=None, **key: str) -> DataFrame:
    """Bars of the given parts of the key from start to end, both inclusive, with double prices, in order; no rows give an empty typed table."""
    x = stored
    for k, v in key.items():
        x = x.where(F.col(k) == v)
    if start is not None:
        x = x.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        x = x.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    return x.select(*KEY, "ts", *[F.col(c).cast("double").alias(c) for c in PRICES]).orderBy(*KEY, "ts")


def catalog(stored: DataFrame) -> DataFrame:
    return stored.groupBy(*KEY).agg(F.count("*").alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("updated_at").alias("written_at"))


def funding_span(funding: DataFrame) -> DataFrame:
    return funding.groupBy("series").agg(F.min("settled").alias("first_settled"), F.max("settled").alias("last_settled"), F.count("*").alias("settlements"))


def nth_newest_settlement(funding: DataFrame, n: int, before=None) -> DataFrame:
    x = funding if before is None else funding.where(F.col("settled") < F.lit(before).cast("timestamp"))
    rank = F.row_number().over(W.partitionBy("series").orderBy(F.desc("settled")))
    return x.withColumn("_rank", rank).where(F.col("_rank") == n).drop("_rank")


def load_funding(funding: DataFrame, start_ms: int, end_ms: int, series: str | None = None) -> DataFrame:
    """Settlements from start to end in milliseconds, inclusive, with the milliseconds beside the instant."""
    x = funding if series is None else funding.where(F.col("series") == series)
    return x.withColumn("settled_ms", F.unix_millis("settled")).where(F.col("settled_ms").between(start_ms, end_ms)).orderBy("series", "settled_ms")


def parse_klines(raw: DataFrame, now_ms: int, json: str = "payload") -> DataFrame:
    """Bars from JSON arrays of arrays (open ms, o, h, l, c, v, close ms, ...); bars that are still forming are dropped."""
    rows = raw.select(*[c for c in raw.columns if c != json], F.explode(F.from_json(json, "array<array<string>>")).alias("k"))
    at = lambda i: F.get("k", F.lit(i))
    x = rows.select(*[c for c in raw.columns if c != json], F.timestamp_millis(at(0).cast("long")).alias("ts"), *[at(i + 1).cast(DECIMAL).alias(c) for i, c in enumerate(PRICES)], at(6).cast("long").alias("close_ms"))
    return x.where(F.col("close_ms") < now_ms)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def parse_funding(raw: DataFrame, json: str = "payload") -> DataFrame:
    """Exact decimals; an empty mark price is missing."""
    rows = raw.select(*[c for c in raw.columns if c != json], F.explode(F.from_json(json, "array<struct<symbol:string,fundingTime:long,fundingRate:string,markPrice:string>>")).alias("x"))
    return rows.select(*[c for c in raw.columns if c != json], "x.symbol", F.col("x.fundingTime").alias("funding_time_ms"), F.timestamp_millis("x.fundingTime").alias("settled"), blank_to_null(F.col("x.fundingRate")).cast(DECIMAL).alias("rate"), blank_to_null(F.col("x.markPrice")).cast(DECIMAL).alias("mark_price"))


def parse_open_interest(raw: DataFrame, json: str = "payload") -> DataFrame:
    rows = raw.select(*[c for c in raw.columns if c != json], F.explode(F.from_json(json, "array<struct<symbol:string,timestamp:long,sumOpenInterest:string,sumOpenInterestValue:string>>")).alias("x"))
    return rows.select(*[c for c in raw.columns if c != json], "x.symbol", F.col("x.timestamp").alias("ts_ms"), blank_to_null(F.col("x.sumOpenInterest")).cast(DECIMAL).alias("open_interest"), blank_to_null(F.col("x.sumOpenInterestValue")).cast(DECIMAL).alias("open_interest_usd"))


def parse_rows(raw: DataFrame, json: str = "payload") -> DataFrame:
    """Bars from lists of [ms, o, h, l, c, v]; of one instant the last is kept."""
    rows = raw.select(*[c for c in raw.columns if c != json], F.posexplode(F.from_json(json, "array<array<double>>")).alias("_seq", "k"))
    x = rows.select(*[c for c in raw.columns if c != json], "_seq", F.timestamp_millis(F.get("k", F.lit(0)).cast("long")).alias("ts"), *[F.get("k", F.lit(i + 1)).alias(c) for i, c in enumerate(PRICES)])
    last = F.row_number().over(W.partitionBy(*[c for c in raw.columns if c != json], "ts").orderBy(F.desc("_seq")))
    return x.withColumn("_last", last).where("_last = 1").drop("_last", "_seq")


def back_adjusted(bars: DataFrame, adjusted: str = "adj_close") -> DataFrame:
    """Open, high and low by the factor of the adjusted close, which becomes the close; incomplete rows are dropped."""
    factor = F.col(adjusted) / F.col("close")
    x = bars.withColumns({c: F.col(c) * factor for c in ("open", "high", "low")}).withColumn("close", F.col(adjusted))
    return x.drop(adjusted).dropna(subset=[*PRICES])


def missing_instruments(universe: DataFrame, landed: DataFrame, key: str = "symbol") -> DataFrame:
    """Instruments of the universe without any landed bar."""
    return universe.join(landed.select(key).distinct(), key, "left_anti")


def append_new(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new whose key is not stored yet, one for each key; what an append-only sink really inserts."""
    first = F.row_number().over(W.partitionBy(*key).orderBy(*[F.col(c) for c in key]))
    fresh = new.join(stored.select(*key).distinct(), key, "left_anti")
    return fresh.withColumn("_first", first).where("_first = 1").drop("_first").select(*new.columns)


def load_signals(stored: DataFrame, **only: str) -> DataFrame:
    """In order of bar and id, so that a reversal's exit comes before its entry."""
    for k, v in only.items():
        stored = stored.where(F.col(k) == v)
    return stored.orderBy("ts", "id")


def reasons_valid(reasons: DataFrame) -> DataFrame:
    """Reason rows with as many values as names and no NaN; null values are allowed."""
    return reasons.where((F.size("feature_names") == F.size("feature_values")) & ~F.exists("feature_values", lambda v: F.coalesce(F.isnan(v), F.lit(False))))


def split_forming(bars: DataFrame, width_ms: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """Closed bars, and those still forming at `now`."""
    closed = F.unix_millis("ts") + width_ms <= F.unix_millis(now)
    return bars.where(closed), bars.where(~closed)


def write_run(path: str, run_id: str, tables: dict[str, DataFrame], config: dict) -> None:
    """A run's header and its tables (trades, funding, equity, statistics), Parquet and JSON under the run's folder."""
    import json

    some = next(iter(tables.values()))
    header = some.sparkSession.createDataFrame([(run_id, config.get("mode", "backtest"), json.dumps(config, sort_keys=True))], "run_id string, mode string, config string")
    header.coalesce(1).write.mode("errorifexists").json(f"{path}/run_id={run_id}/header")
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/run_id={run_id}/{name}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """For JSON artifacts: no NaN leaves the engine."""
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def replayed(bars: DataFrame, width_ms: int, sequence: str) -> DataFrame:
    """Bars in the order of a replay, by close instant and series; of repeated bars the last in sequence."""
    last = F.row_number().over(W.partitionBy("series", "ts").orderBy(F.desc(sequence)))
    x = bars.withColumn("_last", last).where("_last = 1").drop("_last", sequence)
    return x.withColumn("ts_close_ms", F.unix_millis("ts") + width_ms - 1).orderBy("ts_close_ms", "series")


def mixed_funding(bars: DataFrame) -> DataFrame:
    """Series of which some bars carry a funding rate and others none; a consistent feed has none of them."""
    n = bars.groupBy("series").agg(F.count("funding_rate").alias("funded"), F.count("*").alias("bars"))
    return n.where((F.col("funded") > 0) & (F.col("funded") < F.col("bars")))
