"""Registered queries over the given tables, and the SQL that each is compared with.

Warmups are cut to what the test tables' series have bars for. Doubles are rounded to six digits where sums of them differ by order.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import halo, times
from tidemark.functions import windows as k
from tidemark.operators import align, features, ledger, lifecycle
from tidemark.plans import board, strategies, studies
from tidemark.sources import bars as b
from tidemark.streaming import signals as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PRICES = ("open", "high", "low", "close", "volume")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


DAILY = """p AS (SELECT 's' || (l_suppkey % 4) AS series, l_shipdate AS ts, l_extendedprice / l_quantity AS price, l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM lineitem),
bars AS (SELECT series, ts, first(price ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS close, sum(l_quantity) AS volume FROM p GROUP BY series, ts)"""
HOURLY = """bars AS (SELECT event_type AS series, date_trunc('hour', ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY event_type, date_trunc('hour', ts))"""
ORDERS = """bars AS (SELECT o_orderpriority AS series, o_orderdate AS ts, first(o_totalprice ORDER BY o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY o_orderpriority, o_orderdate)"""
FUNDING = """funding AS (SELECT event_type AS series, ts AS settled, (value - 50) / 100000 AS rate FROM events)"""


# bars and tables ------------------------------------------------------------------------------------------------------


@query(f"WITH {DAILY} SELECT * FROM bars")
def daily_bars(spark, sf_dir):
    return b.daily_bars(spark, sf_dir)


@query(f"WITH {HOURLY} SELECT * FROM bars")
def hourly_bars(spark, sf_dir):
    return b.hourly_bars(spark, sf_dir)


@query(f"WITH {ORDERS} SELECT * FROM bars")
def order_bars(spark, sf_dir):
    return b.order_bars(spark, sf_dir)


@query(f"""WITH {HOURLY}, c AS (SELECT *, false AS revised FROM bars WHERE epoch_ms(ts) // 3600000 % 7 <> 0 UNION ALL SELECT series, ts, open, high, low, close + 1, volume, true FROM bars WHERE epoch_ms(ts) // 3600000 % 7 = 0)
SELECT 'venue' AS exchange, series AS symbol, ts, CAST(close AS DOUBLE) AS close FROM c""")
def normalise_last_wins(spark, sf_dir):
    """A raw batch with corrections of every seventh hour: the later row of an instant is kept."""
    x = b.hourly_bars(spark, sf_dir)
    again = x.where(F.pmod(F.floor(F.unix_millis("ts") / 3600000), F.lit(7)) == 0).withColumn("close", F.col("close") + 1)
    raw = x.withColumn("seq", F.lit(1)).unionByName(again.withColumn("seq", F.lit(2))).withColumnRenamed("series", "symbol")
    out = b.normalise(raw, "seq", exchange="venue", market_type="spot", timeframe="1h", source="events")
    return out.select("exchange", "symbol", "ts", F.col("close").cast("double").alias("close"))


@query(f"""WITH {HOURLY} SELECT series AS symbol, count(*) AS bars, CAST(count_if(date_trunc('day', ts) = TIMESTAMP '2024-01-05') AS BIGINT) AS corrected, round(sum(CASE WHEN date_trunc('day', ts) = TIMESTAMP '2024-01-05' THEN close + 1 ELSE close END), 4) AS closes FROM bars GROUP BY series""")
def upsert_bars(spark, sf_dir):
    stored = b.keyed_bars(spark, sf_dir)
    day = stored.where(F.date_trunc("day", "ts") == F.lit("2024-01-05").cast("timestamp"))
    new = day.withColumns({"close": (F.col("close") + 1).cast(b.DECIMAL), "updated_at": F.col("updated_at") + F.expr("INTERVAL 1 DAY")})
    x = b.upsert(stored, new, (*b.KEY, "ts"))
    changed = F.date_trunc("day", "ts") == F.lit("2024-01-05").cast("timestamp")
    return x.groupBy("symbol").agg(F.count("*").alias("bars"), F.count_if(changed).alias("corrected"), F.round(F.sum(F.col("close").cast("double")), 4).alias("closes"))


@query(f"WITH {HOURLY} SELECT 'venue' AS exchange, CASE WHEN series < 'd' THEN 'perp' ELSE 'spot' END AS market_type, series AS symbol, '1h' AS timeframe, ts, open, high, low, close, volume FROM bars WHERE series = 'click' AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-09'")
def load_bars(spark, sf_dir):
    return b.load_bars(b.keyed_bars(spark, sf_dir), "2024-01-03", "2024-01-09", symbol="click")


@query(f"WITH {HOURLY} SELECT 'venue' AS exchange, CASE WHEN series < 'd' THEN 'perp' ELSE 'spot' END AS market_type, series AS symbol, '1h' AS timeframe, count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts, max(ts) AS written_at FROM bars GROUP BY series")
def catalog(spark, sf_dir):
    return b.catalog(b.keyed_bars(spark, sf_dir))


@query(f"WITH {FUNDING} SELECT series, min(settled) AS first_settled, max(settled) AS last_settled, count(*) AS settlements FROM funding GROUP BY series")
def funding_span(spark, sf_dir):
    return b.funding_span(b.settlements(spark, sf_dir))


@query(f"WITH {FUNDING} SELECT series, settled, rate FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY settled DESC) AS r FROM funding WHERE settled < TIMESTAMP '2024-01-25') WHERE r = 3")
def nth_newest_settlement(spark, sf_dir):
    return b.nth_newest_settlement(b.settlements(spark, sf_dir), 3, "2024-01-25")


@query(f"WITH {FUNDING} SELECT series, settled, rate, (epoch_us(settled) // 1000) AS settled_ms FROM funding WHERE (epoch_us(settled) // 1000) BETWEEN 1704240000000 AND 1705000000000")
def load_funding(spark, sf_dir):
    return b.load_funding(b.settlements(spark, sf_dir), 1704240000000, 1705000000000)


@query(f"WITH {HOURLY} SELECT series, ts, open, high, low, close, volume, epoch_ms(ts) + 3599999 AS close_ms FROM bars WHERE epoch_ms(ts) + 3599999 < 1706000000000")
def parse_klines(spark, sf_dir):
    """Hourly bars as landed JSON arrays, one payload a series, parsed back; bars that are still forming are dropped."""
    x = b.hourly_bars(spark, sf_dir)
    ms = F.unix_millis("ts")
    kline = F.array(ms.cast("string"), *[F.col(c).cast("string") for c in PRICES], (ms + 3599999).cast("string"))
    raw = x.groupBy("series", F.date_trunc("day", "ts").alias("day")).agg(F.to_json(F.collect_list(kline)).alias("payload")).drop("day")
    return b.parse_klines(raw, 1706000000000).withColumns({c: F.col(c).cast("double") for c in PRICES})


@query(f"WITH {FUNDING} SELECT series, (epoch_us(settled) // 1000) AS funding_time_ms, round(rate, 9) AS rate, CASE WHEN (epoch_us(settled) // 1000) % 2 = 0 THEN 100.5 END AS mark_price FROM funding")
def parse_funding(spark, sf_dir):
    x = b.settlements(spark, sf_dir)
    ms = F.unix_millis("settled")
    item = F.struct(F.col("series").alias("symbol"), ms.alias("fundingTime"), F.format_string("%.12f", "rate").alias("fundingRate"), F.when(ms % 2 == 0, "100.5").otherwise("").alias("markPrice"))
    raw = x.groupBy("series", F.date_trunc("hour", "settled").alias("hour")).agg(F.to_json(F.collect_list(item)).alias("payload")).drop("hour")
    out = b.parse_funding(raw)
    return out.select("series", "funding_time_ms", F.round(F.col("rate").cast("double"), 9).alias("rate"), F.col("mark_price").cast("double").alias("mark_price"))


@query(f"WITH {ORDERS} SELECT series, ts, round(open * 0.5, 6) AS open, round(high * 0.5, 6) AS high, round(low * 0.5, 6) AS low, round(close * 0.5, 6) AS close FROM bars")
def back_adjusted(spark, sf_dir):
    x = b.back_adjusted(b.order_bars(spark, sf_dir).withColumn("adj_close", F.col("close") * 0.5))
    return rounded(x, "open", "high", "low", "close").drop("volume")


@query("SELECT n_name AS symbol FROM nation WHERE n_name NOT IN (SELECT upper(event_type) FROM events)")
def missing_instruments(spark, sf_dir):
    universe = b.table(spark, sf_dir, "nation").select(F.col("n_name").alias("symbol"))
    return b.missing_instruments(universe, b.hourly_bars(spark, sf_dir).select(F.upper("series").alias("symbol")))


@query(f"WITH {HOURLY}, m AS (SELECT max(ts) AS now FROM bars) SELECT series, CAST(count_if(ts + INTERVAL 1 HOUR <= now) AS BIGINT) AS closed, CAST(count_if(ts + INTERVAL 1 HOUR > now) AS BIGINT) AS forming FROM bars, m GROUP BY series")
def split_forming(spark, sf_dir):
    x = b.hourly_bars(spark, sf_dir)
    newest = x.agg(F.max("ts").alias("now"))
    closed, forming = b.split_forming(x.crossJoin(F.broadcast(newest)), 3600000, F.col("now"))
    both = closed.select("series", F.lit(1).alias("c")).unionByName(forming.select("series", F.lit(0).alias("c")))
    return both.groupBy("series").agg(F.sum("c").alias("closed"), F.sum(1 - F.col("c")).alias("forming"))


# windows and features ---------------------------------------------------------------------------------------------------


@query(f"""WITH {DAILY}, x AS (SELECT *, lag(close) OVER w AS c1, lag(close, 5) OVER w AS c5, row_number() OVER w AS n, avg(close) OVER t AS m, sum(volume) OVER t AS s, min(low) OVER t AS lo, max(high) OVER t AS hi, stddev_samp(close) OVER t AS sd, list(close) OVER t AS l
 FROM bars WINDOW w AS (PARTITION BY series ORDER BY ts), t AS (PARTITION BY series ORDER BY ts ROWS 19 PRECEDING)),
y AS (SELECT *, avg(greatest(high - low, abs(high - c1), abs(low - c1)) / close) OVER (PARTITION BY series ORDER BY ts ROWS 19 PRECEDING) AS f FROM x)
SELECT series, ts, close - c1 AS diff, round(close / c5 - 1, 6) AS change5, round(CASE WHEN n >= 20 THEN m END, 6) AS mean20, round(CASE WHEN n >= 20 THEN s END, 6) AS sum20, CASE WHEN n >= 20 THEN lo END AS min20, CASE WHEN n >= 20 THEN hi END AS max20, round(CASE WHEN n >= 20 THEN sd END, 6) AS std20,
 round(CASE WHEN n >= 20 THEN CASE WHEN sd = 0 THEN 0 ELSE (close - m) / sd END END, 5) AS z20, round(CASE WHEN n >= 20 THEN (len(list_filter(l, lambda v: v < close)) + (len(list_filter(l, lambda v: v = close)) + 1) / 2) / 20 END, 6) AS rank20, greatest(high - low, abs(high - c1), abs(low - c1)) AS tr, round(CASE WHEN n >= 20 THEN f END, 6) AS trf20 FROM y""")
def trailing_windows(spark, sf_dir):
    x = b.daily_bars(spark, sf_dir).withColumn("tr", k.true_range())
    c = F.col("close")
    x = x.select(
        "series", "ts", k.change(c).alias("diff"), k.pct_change(c, 5).alias("change5"), k.rolling_mean(c, 20).alias("mean20"), k.rolling_sum(F.col("volume"), 20).alias("sum20"), k.rolling_min(F.col("low"), 20).alias("min20"), k.rolling_max(F.col("high"), 20).alias("max20"),
        k.rolling_std(c, 20).alias("std20"), F.round(k.rolling_zscore(c, 20), 5).alias("z20"), k.rolling_percentile(c, 20).alias("rank20"), "tr", k.true_range_fraction(20).alias("trf20"),
    )
    return rounded(x, "change5", "mean20", "sum20", "std20", "rank20", "trf20")


EMA = """n AS (SELECT series, ts, close, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS i FROM bars)"""


def ema_sql(span: int, name: str, source: str = "n", column: str = "close") -> str:
    """Exponential mean as a weighted sum over all earlier rows that still weigh anything."""
    d = 1 - 2 / (span + 1)
    return f"""{name} AS (SELECT a.series, a.ts, sum(b.{column} * pow({d!r}, a.i - b.i) * CASE WHEN b.i = 0 THEN 1 ELSE {1 - d!r} END) AS v FROM {source} a JOIN {source} b ON a.series = b.series AND b.i <= a.i AND b.i >= a.i - {int(48 / (2 / (span + 1)))} GROUP BY a.series, a.ts)"""


@query(f"WITH {ORDERS}, {EMA}, {ema_sql(12, 'f')}, {ema_sql(48, 's')} SELECT f.series, f.ts, round(f.v, 4) AS ema12, round(s.v, 4) AS ema48 FROM f JOIN s ON f.series = s.series AND f.ts = s.ts")
def exponential_means(spark, sf_dir):
    x = k.ema_columns(b.order_bars(spark, sf_dir), {"ema12": ("close", 12), "ema48": ("close", 48)})
    return rounded(x.select("series", "ts", "ema12", "ema48"), "ema12", "ema48", digits=4)


@query(f"""WITH {ORDERS}, t AS (SELECT series, ts, close, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, row_number() OVER w - 1 AS i FROM bars WINDOW w AS (PARTITION BY series ORDER BY ts)), {ema_sql(14, 'a', 't', 'tr')}
SELECT a.series, a.ts, round(a.v, 4) AS atr14, round(CASE WHEN a.v > 0 THEN least(greatest(0.06 / (a.v / t.close), 0.3), 1.0) ELSE 0.3 END, 6) AS scale FROM a JOIN t ON a.series = t.series AND a.ts = t.ts""")
def average_true_range(spark, sf_dir):
    x = strategies.with_atr(b.order_bars(spark, sf_dir), 14, "atr14").withColumn("scale", strategies.atr_scale("atr14"))
    return x.select("series", "ts", F.round("atr14", 4).alias("atr14"), F.round("scale", 6).alias("scale"))


@query(f"""WITH {DAILY}, x AS (SELECT series, ts, ln(close) AS y, CAST(row_number() OVER (PARTITION BY series ORDER BY ts) AS DOUBLE) AS t FROM bars),
z AS (SELECT series, ts, t, stddev_samp(y) OVER w AS sd, covar_samp(y, t) OVER w AS cv FROM x WINDOW w AS (PARTITION BY series ORDER BY ts ROWS 47 PRECEDING)), r AS (SELECT *, CASE WHEN sd = 0 THEN 0 ELSE least(greatest(cv * cv / (48 * 49 / 12.0 * sd * sd), 0), 1) END AS r2 FROM z)
SELECT series, ts, round(CASE WHEN t >= 48 THEN r2 END, 5) AS r2, round(CASE WHEN t >= 48 THEN sd * sqrt(1 - r2) END, 5) AS residual FROM r""")
def log_price_fit(spark, sf_dir):
    r2, residual = k.log_fit(48)
    return features.with_inputs(b.daily_bars(spark, sf_dir)).select("series", "ts", F.round(r2, 5).alias("r2"), F.round(residual, 5).alias("residual"))


@query()
def ew_volatility(spark, sf_dir):
    """Yearly exponentially weighted volatility and the size it gives."""
    return ledger.vol_weights(b.order_bars(spark, sf_dir), 0.4, 365.25, span=20).select("series", "ts", F.round("realised_vol", 6).alias("realised_vol"), F.round("vol_weight", 6).alias("vol_weight"))


@query(f"""WITH {DAILY}, x AS (SELECT *, row_number() OVER w AS n, max(close) OVER w AS peak, sum(volume) OVER w AS cum, close - lag(close) OVER w AS d FROM bars WINDOW w AS (PARTITION BY series ORDER BY ts)),
y AS (SELECT *, sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY ts ROWS 2 PRECEDING) = 3 AS falls FROM x)
SELECT series, ts, peak, cum AS cum_volume, falls, CASE WHEN n > 10 THEN close END AS warmed FROM y""")
def running_kernels(spark, sf_dir):
    x = b.daily_bars(spark, sf_dir)
    return x.select("series", "ts", k.running_max(F.col("close")).alias("peak"), k.running_sum(F.col("volume")).alias("cum_volume"), k.adverse_run(3).alias("falls"), k.warmed(F.col("close"), 10).alias("warmed"))


@query(f"""WITH {DAILY}, g AS (SELECT series, ts, epoch_ms(lead(ts) OVER (PARTITION BY series ORDER BY ts)) - epoch_ms(ts) AS gap FROM bars),
e AS (SELECT series, min(ts) AS first_ts, max(ts) AS last_ts, CAST(quantile_cont(gap, 0.5) AS BIGINT) AS spacing_ms FROM g GROUP BY series)
SELECT series, first_ts, last_ts, spacing_ms, last_ts + spacing_ms * INTERVAL 1 MILLISECOND AS end_ts, round(365.25 * 86400000 / spacing_ms, 6) AS sizing_bars, round(365.0 * 86400000 / spacing_ms, 6) AS sharpe_bars FROM e""")
def window_ends(spark, sf_dir):
    x = times.window_ends(b.daily_bars(spark, sf_dir))
    return x.withColumns({"sizing_bars": F.round(times.bars_per_year(F.col("spacing_ms")), 6), "sharpe_bars": F.round(times.bars_per_year(F.col("spacing_ms"), times.SHARPE_DAYS), 6)})


@query("""WITH t AS (SELECT 1 + event_id % 30 AS k, CASE event_id % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'h' WHEN 2 THEN 'w' ELSE 'M' END AS unit FROM events)
SELECT k || unit AS timeframe, CASE unit WHEN 'm' THEN k * 60000 WHEN 'h' THEN k * 3600000 WHEN 'w' THEN k * 604800000 ELSE -1 END AS ms, count(*) AS events FROM t GROUP BY k, unit""")
def timeframes(spark, sf_dir):
    """Widths of timeframes written as text, one made from each event; months have none (-1)."""
    text = F.concat((1 + F.col("event_id") % 30).cast("string"), F.element_at(F.array(*map(F.lit, "mhwM")), (F.col("event_id") % 4 + 1).cast("int")))
    x = b.table(spark, sf_dir, "events").select(text.alias("timeframe"))
    return x.select("timeframe", F.coalesce(times.timeframe_ms_col(F.col("timeframe")), F.lit(-1)).alias("ms")).groupBy("timeframe", "ms").agg(F.count("*").alias("events"))


def frame(spark, sf_dir) -> DataFrame:
    return features.feature_frame(b.daily_bars(spark, sf_dir))


ROUNDED = ("direction", "strength", "persistence", "stability", "energy", "compression", "compression_release", "participation")


@query()
def feature_frame(spark, sf_dir):
    """All state features of the daily series."""
    return rounded(frame(spark, sf_dir).select("series", "ts", "close", *ROUNDED), *ROUNDED)


@query(f"""WITH {DAILY}, x AS (SELECT series, ts, close, row_number() OVER w AS n, abs(close - lag(close, 96) OVER w) AS net, abs(close - lag(close) OVER w) AS step FROM bars WINDOW w AS (PARTITION BY series ORDER BY ts)),
y AS (SELECT *, sum(step) OVER (PARTITION BY series ORDER BY ts ROWS 95 PRECEDING) AS path FROM x) SELECT series, ts, round(CASE WHEN n > 96 THEN CASE WHEN path = 0 THEN 0 ELSE net / path END END, 6) AS strength FROM y""")
def strength(spark, sf_dir):
    return rounded(frame(spark, sf_dir).select("series", "ts", "strength"), "strength")


@query(f"""WITH {DAILY}, r AS (SELECT series, ts, volume, row_number() OVER w AS n, ln(close) - ln(lag(close) OVER w) AS lr FROM bars WINDOW w AS (PARTITION BY series ORDER BY ts)),
v AS (SELECT *, CASE WHEN n > 24 THEN stddev_samp(lr) OVER (PARTITION BY series ORDER BY ts ROWS 23 PRECEDING) END AS rv FROM r),
l AS (SELECT *, list(rv) OVER t AS lv, list(volume) OVER t AS lw FROM v WINDOW t AS (PARTITION BY series ORDER BY ts ROWS 479 PRECEDING))
SELECT series, ts, round(CASE WHEN n > 503 THEN (len(list_filter(lv, lambda q: q < rv)) + (len(list_filter(lv, lambda q: q = rv)) + 1) / 2) / 480 END, 6) AS energy, round(CASE WHEN n > 480 THEN (len(list_filter(lw, lambda q: q < volume)) + (len(list_filter(lw, lambda q: q = volume)) + 1) / 2) / 480 END, 6) AS participation FROM l""")
def energy_and_participation(spark, sf_dir):
    return rounded(frame(spark, sf_dir).select("series", "ts", "energy", "participation"), "energy", "participation")


@query(f"WITH {HOURLY} SELECT ts, round(avg(CASE WHEN close > open THEN 1.0 ELSE 0.0 END), 6) AS breadth, count(*) AS instruments FROM bars GROUP BY ts HAVING count(*) >= 2")
def breadth(spark, sf_dir):
    return rounded(features.breadth(b.hourly_bars(spark, sf_dir)), "breadth")


@query(f"""WITH {HOURLY}, s AS (SELECT ts, series, sign(close - open) AS g FROM bars), a AS (SELECT ts, max(CASE WHEN series = 'click' THEN g END) AS lead, CAST(count_if(series <> 'click') AS BIGINT) AS followers, count_if(series <> 'click' AND g = -1) AS dn, count_if(series <> 'click' AND g = 1) AS up FROM s GROUP BY ts)
SELECT ts, coalesce(followers > 0 AND lead <> 0 AND CASE WHEN lead > 0 THEN up WHEN lead < 0 THEN dn END / followers >= 0.5, false) AS confirmed, followers FROM a""")
def confirms(spark, sf_dir):
    return features.confirms(b.hourly_bars(spark, sf_dir), "click")


def funded(spark, sf_dir) -> DataFrame:
    return align.with_funding(b.hourly_bars(spark, sf_dir), b.settlements(spark, sf_dir))


@query()
def crowding(spark, sf_dir):
    return rounded(features.crowding(funded(spark, sf_dir), 6, 60).select("series", "ts", "crowding"), "crowding")


@query()
def feature_availability(spark, sf_dir):
    x = features.crowding(features.feature_frame(funded(spark, sf_dir), 6, 24, 6, 24, 120, 6))
    return features.availability(x, [*ROUNDED, "crowding"])


# lifecycle ----------------------------------------------------------------------------------------------------------------


def machine_frame(spark, sf_dir) -> DataFrame:
    """Inputs of the lifecycle with windows that the test tables' series fill."""
    x = features.lifecycle_frame(features.feature_frame(b.daily_bars(spark, sf_dir), 12, 48, 12, 48, 96, 12), 96)
    return x.select("series", "ts", *PRICES, *features.LIFECYCLE, "measurable", "crowding_measured")


LOOSE = lifecycle.Lifecycle(enter_strength=0.5, exit_strength=0.25, direction_floor=0.02, stability_floor=0.05, min_dwell=2, cooldown=3, exhaustion_dwell=4)


@query()
def lifecycle_states(spark, sf_dir):
    return lifecycle.walk(machine_frame(spark, sf_dir), LOOSE)


@query()
def state_occupancy(spark, sf_dir):
    return rounded(lifecycle.occupancy(lifecycle_states(spark, sf_dir)), "share")


@query()
def state_transitions(spark, sf_dir):
    return lifecycle.transitions(lifecycle_states(spark, sf_dir), 200)


@query()
def transition_audit(spark, sf_dir):
    """Changes of state of each series, and how many of them the lifecycle doesn't allow (none)."""
    states = lifecycle_states(spark, sf_dir)
    bad = lifecycle.illegal_transitions(states).agg(F.coalesce(F.sum("times"), F.lit(0)).alias("illegal"))
    return lifecycle.transitions(states).groupBy("series").agg(F.count("*").alias("changes")).crossJoin(F.broadcast(bad))


@query()
def lifecycle_targets(spark, sf_dir):
    return rounded(lifecycle.signed_target(machine_frame(spark, sf_dir), LOOSE).select("series", "ts", "state", "target"), "target")


@query()
def side_change_events(spark, sf_dir):
    x = lifecycle.side_changes(lifecycle.signed_target(machine_frame(spark, sf_dir), LOOSE))
    return rounded(x.where(F.col("long_entry") | F.col("long_exit") | F.col("short_entry") | F.col("short_exit")).select("series", "ts", *ledger.FLAGS, "size"), "size")


@query()
def convergence_audit(spark, sf_dir):
    x = machine_frame(spark, sf_dir)
    cold = lifecycle.walk(x.where(F.col("ts") >= F.lit("1997-01-01").cast("timestamp")), LOOSE)
    late = F.col("ts") >= F.lit("1998-01-01").cast("timestamp")
    return lifecycle.convergence(lifecycle.walk(x, LOOSE).where(late), cold.where(late))


@query(f"""WITH {HOURLY}, f AS (SELECT *, close > open AS up, row_number() OVER w AS n FROM bars WINDOW w AS (PARTITION BY series ORDER BY ts)),
g AS (SELECT *, n - sum(CASE WHEN up THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY ts) AS island FROM f) SELECT series, min(ts) AS start, count(*) AS length FROM g WHERE up GROUP BY series, island""")
def run_lengths(spark, sf_dir):
    return lifecycle.run_lengths(b.hourly_bars(spark, sf_dir).withColumn("up", F.col("close") > F.col("open")), "up")


# strategies -------------------------------------------------------------------------------------------------------------


def flags(df: DataFrame) -> DataFrame:
    return df.select("series", "ts", *ledger.FLAGS)


PATTERN = """f AS (SELECT *, row_number() OVER w AS n, coalesce(lag(close < open) OVER w AND lag(close < open, 2) OVER w AND close > open, false) AS up, coalesce(lag(close > open) OVER w AND lag(close > open, 2) OVER w AND close < open, false) AS down FROM bars WINDOW w AS (PARTITION BY series ORDER BY ts))"""


@query(f"WITH {DAILY}, {PATTERN} SELECT series, ts, up AND n > 100 AS long_entry, down AND n > 100 AS long_exit, down AND n > 100 AS short_entry, up AND n > 100 AS short_exit FROM f")
def turnaround_v1(spark, sf_dir):
    return flags(strategies.turnaround_v1(b.daily_bars(spark, sf_dir), warmup=100))


@query()
def turnaround_v2(spark, sf_dir):
    return flags(strategies.turnaround_v2(b.daily_bars(spark, sf_dir), warmup=400))


@query(f"WITH {DAILY}, {PATTERN}, s AS (SELECT *, avg(close) OVER (PARTITION BY series ORDER BY ts ROWS 39 PRECEDING) AS sma FROM f) SELECT series, ts, up AND n > 40 AND close > sma AND close < sma * 1.2 AS long_entry, false AS long_exit, false AS short_entry, false AS short_exit FROM s")
def sma_pullback(spark, sf_dir):
    return flags(strategies.sma_pullback(b.daily_bars(spark, sf_dir)))


@query()
def trend_rider(spark, sf_dir):
    return flags(strategies.trend_rider(b.daily_bars(spark, sf_dir)))


@query(f"WITH {DAILY}, x AS (SELECT series, ts, row_number() OVER w AS n, close / lag(close, 96) OVER w - 1 AS r FROM bars WINDOW w AS (PARTITION BY series ORDER BY ts)) SELECT series, ts, coalesce(n > 96 AND r > 0, false) AS long_entry, coalesce(n > 96 AND r < 0, false) AS long_exit, coalesce(n > 96 AND r < 0, false) AS short_entry, coalesce(n > 96 AND r > 0, false) AS short_exit FROM x")
def tsmom(spark, sf_dir):
    return flags(strategies.tsmom(b.daily_bars(spark, sf_dir)))


@query()
def ema_cross(spark, sf_dir):
    return flags(strategies.ema_cross(b.daily_bars(spark, sf_dir), warmup=400))


CHANNEL = """x AS (SELECT series, ts, close, row_number() OVER w AS n, max(high) OVER (w ROWS BETWEEN 96 PRECEDING AND 1 PRECEDING) AS eh, min(low) OVER (w ROWS BETWEEN 96 PRECEDING AND 1 PRECEDING) AS el, max(high) OVER (w ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING) AS xh, min(low) OVER (w ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING) AS xl FROM bars WINDOW w AS (PARTITION BY series ORDER BY ts)),
sig AS (SELECT series, ts, close, n, n > 96 AND close > eh AS long_entry, n > 96 AND close < xl AS long_exit, n > 96 AND close < el AS short_entry, n > 96 AND close > xh AS short_exit FROM x)"""


@query(f"WITH {DAILY}, {CHANNEL} SELECT series, ts, long_entry, long_exit, short_entry, short_exit FROM sig")
def donchian(spark, sf_dir):
    return flags(strategies.donchian(b.daily_bars(spark, sf_dir)))


@query()
def multi_horizon(spark, sf_dir):
    return flags(strategies.multi_horizon(b.daily_bars(spark, sf_dir)))


@query()
def state_machine_v1(spark, sf_dir):
    return flags(strategies.state_machine_v1(machine_frame(spark, sf_dir), LOOSE, warmup=200))


@query()
def state_machine_v2(spark, sf_dir):
    return rounded(strategies.state_machine_v2(machine_frame(spark, sf_dir), LOOSE, warmup=200).select("series", "ts", "target"), "target")


@query()
def all_signals(spark, sf_dir):
    """How often each generator fires on each series."""
    short = {n: {"warmup": 400} for n in ("turnaround_v1", "turnaround_v2", "ema_cross")}
    x = strategies.all_signals(b.daily_bars(spark, sf_dir), **short)
    return x.groupBy("series", "strategy").agg(*[F.count_if(c).alias(f"{c}s") for c in ledger.FLAGS])


# exits, ledger, costs -------------------------------------------------------------------------------------------------------


def channel(spark, sf_dir) -> DataFrame:
    return strategies.donchian(b.daily_bars(spark, sf_dir))


RESOLVED = """r1 AS (SELECT series, ts, close, n, long_entry AND NOT long_exit AS le, long_exit AND NOT long_entry AS lx, short_entry AND NOT short_exit AS se, short_exit AND NOT short_entry AS sx FROM sig),
r2 AS (SELECT series, ts, close, n, le AND NOT se AS le, lx, se AND NOT le AS se, sx FROM r1)"""
POSITION = """q1 AS (SELECT *, last_value(CASE WHEN le THEN 1 WHEN se THEN -1 END IGNORE NULLS) OVER w AS side, coalesce(last_value(CASE WHEN le OR se THEN n END IGNORE NULLS) OVER w, 0) AS n_in, coalesce(max(CASE WHEN lx THEN n END) OVER w, 0) AS alx, coalesce(max(CASE WHEN sx THEN n END) OVER w, 0) AS asx FROM r2 WINDOW w AS (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING)),
pos AS (SELECT series, ts, close, n, CASE WHEN side IS NULL OR (side = 1 AND alx > n_in) OR (side = -1 AND asx > n_in) THEN 0 ELSE side END AS held FROM q1)"""


@query(f"WITH {DAILY}, {CHANNEL}, {RESOLVED} SELECT series, ts, le AS long_entry, lx AS long_exit, se AS short_entry, sx AS short_exit FROM r2")
def conflict_resolution(spark, sf_dir):
    return flags(ledger.resolved(channel(spark, sf_dir)))


@query(f"WITH {DAILY}, {CHANNEL}, {RESOLVED}, {POSITION} SELECT series, ts, held, coalesce(lag(held) OVER (PARTITION BY series ORDER BY ts), 0) AS position FROM pos")
def net_position(spark, sf_dir):
    return ledger.net_position(channel(spark, sf_dir)).select("series", "ts", "held", "position")


@query()
def exit_modes(spark, sf_dir):
    """Exits that each mode adds, over the reversal pattern's long side."""
    x = k.ema_columns(strategies.turnaround_v1(b.daily_bars(spark, sf_dir), allow_shorts=False, warmup=100), {"trend": ("close", 50)})
    return studies.exit_mode_census(x, ("continuation_failure", "opposite_signal_only", "trend_failure", "trend_structure"), failure_bars=3, trend_ema="trend")


@query(f"""WITH {DAILY}, {PATTERN}, s AS (SELECT *, min(low) OVER w AS lo, max(high) OVER w AS hi FROM f WINDOW w AS (PARTITION BY series ORDER BY ts ROWS 2 PRECEDING)), d AS (SELECT series, ts, close, up AND n > 100 AS le, down AND n > 100 AS se, CASE WHEN up AND n > 100 THEN (close - lo) / close WHEN down AND n > 100 THEN (hi - close) / close END AS d FROM s)
SELECT series, ts, round(d, 6) AS setup_stop, CASE WHEN le THEN close * (1 - d) ELSE close * (1 + d) END AS stop_price, round(9500.0 / close, 6) AS entry_size FROM d WHERE (le OR se) AND d > 0""")
def setup_stops(spark, sf_dir):
    x = ledger.setup_stop(strategies.turnaround_v1(b.daily_bars(spark, sf_dir), warmup=100))
    x = ledger.entry_size(ledger.stop_price(x), 10_000.0, 0.95)
    return x.where("setup_stop is not null").select("series", "ts", F.round("setup_stop", 6).alias("setup_stop"), "stop_price", F.round("entry_size", 6).alias("entry_size"))


@query()
def protective_stops(spark, sf_dir):
    x = ledger.setup_stop(ledger.resolved(strategies.turnaround_v1(b.daily_bars(spark, sf_dir), warmup=100)))
    return rounded(ledger.stopped_positions(x).select("series", "ts", "held", "stop_hit"), "stop_hit")


TRADES = """ch AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY series ORDER BY ts), 0) AS b4 FROM pos), ev AS (SELECT series, ts, close, held, lead(ts) OVER w AS exit_ts, lead(close) OVER w AS exit_close FROM ch WHERE held <> b4 WINDOW w AS (PARTITION BY series ORDER BY ts)),
tr AS (SELECT series, ts AS entry_ts, CASE WHEN held > 0 THEN 'long' ELSE 'short' END AS direction, held, 9500.0 / close AS quantity, close * CASE WHEN held > 0 THEN 1.0002 ELSE 0.9998 END AS entry_price, exit_ts, exit_close * CASE WHEN held > 0 THEN 0.9998 ELSE 1.0002 END AS exit_price FROM ev WHERE held <> 0),
tp AS (SELECT *, 0.0006 * quantity * entry_price AS entry_fee, 0.0006 * quantity * exit_price AS exit_fee, held * quantity * (exit_price - entry_price) - 0.0006 * quantity * entry_price - 0.0006 * quantity * exit_price AS pnl FROM tr)"""


@query(f"WITH {DAILY}, {CHANNEL}, {RESOLVED}, {POSITION}, {TRADES} SELECT series, entry_ts, direction, round(quantity, 5) AS quantity, round(entry_price, 4) AS entry_price, exit_ts, round(exit_price, 4) AS exit_price, round(pnl, 3) AS pnl, CASE WHEN exit_ts IS NULL THEN 'open' ELSE 'closed' END AS status FROM tp")
def trade_ledger(spark, sf_dir):
    x = ledger.trades(ledger.net_position(channel(spark, sf_dir)))
    return x.select("series", "entry_ts", "direction", F.round("quantity", 5).alias("quantity"), F.round("entry_price", 4).alias("entry_price"), "exit_ts", F.round("exit_price", 4).alias("exit_price"), F.round("pnl", 3).alias("pnl"), "status")


@query(f"""WITH {DAILY}, {CHANNEL}, {RESOLVED}, {POSITION}, {TRADES}, c AS (SELECT * FROM tp WHERE exit_ts IS NOT NULL) SELECT t.series, count(*) AS trades, CAST(count(exit_ts) AS BIGINT) AS closed, round(count_if(pnl > 0) / count(exit_ts), 6) AS win_rate, round(sum(CASE WHEN pnl > 0 THEN pnl END) / sum(CASE WHEN pnl < 0 THEN -pnl END), 4) AS profit_factor,
 round(sum(entry_fee + coalesce(exit_fee, 0)), 3) AS fees_paid, round(sum(pnl), 3) AS closed_net FROM tp t GROUP BY t.series""")
def trade_statistics(spark, sf_dir):
    x = ledger.trade_statistics(ledger.trades(ledger.net_position(channel(spark, sf_dir))))
    return x.select("series", "trades", "closed", F.round("win_rate", 6).alias("win_rate"), F.round("profit_factor", 4).alias("profit_factor"), F.round("fees_paid", 3).alias("fees_paid"), F.round("closed_net", 3).alias("closed_net"))


@query(f"WITH {DAILY}, {CHANNEL}, {RESOLVED}, {POSITION}, {TRADES} SELECT series, entry_ts AS ts, 'entry' AS kind, direction, round(entry_price, 4) AS price FROM tp UNION ALL SELECT series, exit_ts, 'exit', direction, round(exit_price, 4) FROM tp WHERE exit_ts IS NOT NULL")
def fill_markers(spark, sf_dir):
    x = ledger.fill_markers(ledger.trades(ledger.net_position(channel(spark, sf_dir))))
    return x.withColumn("price", F.round("price", 4))


@query()
def cash_limited_trades(spark, sf_dir):
    x = ledger.cash_limited(ledger.trades(ledger.net_position(channel(spark, sf_dir))), 10_000.0, 0.0006)
    return rounded(x.select("series", "entry_ts", "quantity", "pnl", "balance"), "quantity", "pnl", "balance", digits=4)


@query()
def target_orders(spark, sf_dir):
    x = lifecycle.signed_target(machine_frame(spark, sf_dir), LOOSE)
    x = ledger.target_orders(ledger.banded(x.select("series", "ts", "close", "target"), 0.1), 10_000.0, 0.95)
    return rounded(x.where("`order` <> 0").select("series", "ts", "target", "submitted", "desired", "order", "position_fraction"), "target", "submitted", "desired", "order", "position_fraction")


RETURNS = """ret AS (SELECT series, ts, n, close, coalesce(lag(held) OVER w, 0) AS position, coalesce((close / lag(close) OVER w - 1) * coalesce(lag(held) OVER w, 0), 0) AS ret FROM pos WINDOW w AS (PARTITION BY series ORDER BY ts)),
eq0 AS (SELECT *, max(CASE WHEN ret <= -1 THEN 1 ELSE 0 END) OVER w AS ruin, exp(sum(ln(1 + greatest(ret, -0.999999999999))) OVER w) AS e0 FROM ret WINDOW w AS (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING)), eq1 AS (SELECT *, CASE WHEN ruin = 1 THEN 0 ELSE e0 END AS equity FROM eq0),
eq AS (SELECT *, equity / greatest(max(equity) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING), 1) - 1 AS drawdown FROM eq1)"""


@query(f"WITH {ORDERS}, {CHANNEL}, {RESOLVED}, {POSITION}, {RETURNS} SELECT series, ts, round(ret, 6) AS ret, round(equity, 6) AS equity, round(drawdown, 6) AS drawdown FROM eq")
def equity_curve(spark, sf_dir):
    x = ledger.equity_curve(ledger.bar_returns(ledger.net_position(strategies.donchian(b.order_bars(spark, sf_dir)))))
    return rounded(x.select("series", "ts", "ret", "equity", "drawdown"), "ret", "equity", "drawdown")


@query()
def risk_statistics(spark, sf_dir):
    x = ledger.equity_curve(ledger.bar_returns(ledger.net_position(strategies.tsmom(b.order_bars(spark, sf_dir), 20))))
    x = ledger.risk_statistics(x, 365.0)
    return rounded(x, *[c for c in x.columns if c not in ("series", "bars", "drawdown_bars", "ruined_bars")])


@query()
def cost_waterfall(spark, sf_dir):
    """Closed trades of the channel strategy at three multiples of the costs, beside the costless run."""
    p = ledger.net_position(channel(spark, sf_dir))
    s = ledger.stressed(p, (1.0, 2.0, 4.0), 0.0006, 0.0002)
    costed = ledger.trades(s, fee_rate=F.col("fee_rate"), slippage=F.col("slippage_rate"), keys=("series", "multiple", "fee_rate", "slippage_rate"))
    x = ledger.cost_waterfall(costed, ledger.trades(p, fee_rate=0.0, slippage=0.0))
    return rounded(x, "gross_return", "fees", "slippage", "funding", "size_effect", "net_return", digits=4)


@query(f"WITH {DAILY} SELECT series, round(arg_max(close, ts) / arg_min(close, ts) - 1, 6) AS benchmark_return FROM bars GROUP BY series")
def benchmark_return(spark, sf_dir):
    return rounded(ledger.benchmark_return(b.daily_bars(spark, sf_dir)), "benchmark_return")


# alignment ----------------------------------------------------------------------------------------------------------------

CONTAINED = """e AS (SELECT series, max(ts) + CAST(quantile_cont(gap, 0.5) AS BIGINT) * INTERVAL 1 MILLISECOND AS end_ts FROM (SELECT series, ts, epoch_ms(lead(ts) OVER (PARTITION BY series ORDER BY ts)) - epoch_ms(ts) AS gap FROM bars) GROUP BY series),
inside AS (SELECT f.series, f.settled, f.rate, b.ts FROM funding f ASOF JOIN bars b ON f.series = b.series AND f.settled >= b.ts JOIN e ON e.series = f.series WHERE f.settled < e.end_ts)"""


@query(f"WITH {HOURLY}, {FUNDING}, {CONTAINED} SELECT b.series, b.ts, b.close, round(coalesce(sum(i.rate), 0), 9) AS funding_rate FROM bars b LEFT JOIN inside i ON b.series = i.series AND b.ts = i.ts GROUP BY b.series, b.ts, b.close")
def funding_containment(spark, sf_dir):
    return funded(spark, sf_dir).select("series", "ts", "close", F.round("funding_rate", 9).alias("funding_rate"))


@query(f"WITH {HOURLY}, {FUNDING}, {CONTAINED} SELECT i.series, i.ts AS bar, i.settled, b.open AS notional, i.rate, round(-b.open * i.rate, 9) AS cash_flow FROM inside i JOIN bars b ON b.series = i.series AND b.ts = i.ts")
def funding_ledger(spark, sf_dir):
    x = align.funding_ledger(b.hourly_bars(spark, sf_dir), b.settlements(spark, sf_dir), "open")
    return x.withColumn("cash_flow", F.round("cash_flow", 9))


@query(f"WITH {HOURLY}, {FUNDING}, {CONTAINED}, p AS (SELECT series, ts, coalesce(lag(volume) OVER (PARTITION BY series ORDER BY ts) * open, 0) AS notional FROM bars) SELECT p.series, count(*) AS bars, round(sum(-p.notional * coalesce(r.rate, 0)), 6) AS cash_flow FROM p LEFT JOIN (SELECT series, ts, sum(rate) AS rate FROM inside GROUP BY series, ts) r ON p.series = r.series AND p.ts = r.ts GROUP BY p.series")
def funding_cash_flow(spark, sf_dir):
    x = align.funding_cash(ledger.held_notional(b.hourly_bars(spark, sf_dir), "volume"), b.settlements(spark, sf_dir), "notional")
    return x.groupBy("series").agg(F.count("*").alias("bars"), F.round(F.sum("cash_flow"), 6).alias("cash_flow"))


def regular_funding(spark, sf_dir) -> DataFrame:
    """A settlement each eight hours of each series, without those of three days."""
    day = b.hourly_bars(spark, sf_dir).select("series", F.date_trunc("day", "ts").alias("d")).distinct()
    x = day.select("series", F.explode(F.array(*[F.timestamp_millis(F.unix_millis("d") + h * 3600000) for h in (0, 8, 16)])).alias("settled"), F.lit(0.0001).alias("rate"))
    return x.where(~F.dayofmonth("settled").isin(9, 10, 20))


@query()
def coverage_gaps(spark, sf_dir):
    return align.coverage_gaps(b.hourly_bars(spark, sf_dir), regular_funding(spark, sf_dir))


@query()
def funding_status(spark, sf_dir):
    return align.funding_status(b.hourly_bars(spark, sf_dir), regular_funding(spark, sf_dir), required=True)


@query(f"WITH {HOURLY}, {FUNDING}, s AS (SELECT series, min(settled) AS a, max(settled) AS z FROM funding GROUP BY series) SELECT b.series, b.ts, b.close FROM bars b LEFT JOIN s USING (series) WHERE s.a IS NULL OR b.ts BETWEEN s.a AND s.z")
def funded_window(spark, sf_dir):
    return align.funded_bars(b.hourly_bars(spark, sf_dir), b.funding_span(b.settlements(spark, sf_dir))).select("series", "ts", "close")


@query(f"WITH {HOURLY}, {FUNDING}, n AS (SELECT series, settled FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY settled DESC) AS r FROM funding) WHERE r = 5), s AS (SELECT series, max(ts) AS start FROM bars GROUP BY series) SELECT s.series, least(s.start, n.settled - INTERVAL 1 HOUR) AS start FROM s LEFT JOIN n USING (series)")
def widened_start(spark, sf_dir):
    starts = b.hourly_bars(spark, sf_dir).groupBy("series").agg(F.max("ts").alias("start"))
    x = align.widened_start(starts, b.nth_newest_settlement(b.settlements(spark, sf_dir).withColumn("settled", F.date_trunc("second", "settled")), 5), 3600000)
    return x.withColumn("start", F.date_trunc("second", "start"))


ORACLE_SQL["widened_start"] = ORACLE_SQL["widened_start"].replace("least(s.start, n.settled - INTERVAL 1 HOUR)", "least(s.start, date_trunc('second', n.settled) - INTERVAL 1 HOUR)")


@query(f"WITH {HOURLY} SELECT epoch_ms(ts) + 3599999 AS close_ms, count(*) AS present, round(sum(close), 6) AS closes FROM bars GROUP BY ts")
def snapshots(spark, sf_dir):
    x = align.snapshots(b.hourly_bars(spark, sf_dir), 3600000)
    return x.select("close_ms", "present", F.round(F.aggregate(F.map_values("bars"), F.lit(0.0), lambda a, v: a + v["close"]), 6).alias("closes"))


@query(f"WITH {HOURLY} SELECT series, ts, close FROM bars WHERE series IN ('click', 'view', 'purchase') AND series <> 'view'")
def traded_instruments(spark, sf_dir):
    roles = b.hourly_bars(spark, sf_dir).select("series").distinct().select("series", F.when(F.col("series").isin("click", "purchase"), "trade").otherwise("context").alias("role"))
    return align.traded(b.hourly_bars(spark, sf_dir), roles).select("series", "ts", "close")


@query(f"WITH {HOURLY} SELECT series, CAST(count_if(day(ts) = 7) AS BIGINT) AS absent, CAST(count_if(day(ts) = 8) AS BIGINT) AS differing, count(*) AS bars FROM bars GROUP BY series")
def bar_diff(spark, sf_dir):
    live = b.hourly_bars(spark, sf_dir)
    stored = live.where(F.dayofmonth("ts") != 7).withColumn("close", F.when(F.dayofmonth("ts") == 8, F.col("close") + 0.5).otherwise(F.col("close")))
    x = align.bar_diff(live, stored)
    return x.groupBy("series").agg(F.count_if("absent").alias("absent"), F.count_if(F.col("differing") > 0).alias("differing"), F.count("*").alias("bars"))


@query(f"WITH {DAILY}, {PATTERN} SELECT series, ts, 'long_entry' AS side, 'a' AS only_in FROM f WHERE up AND n > 100 AND n <= 300")
def signal_diff(spark, sf_dir):
    def entries(warmup):
        return strategies.turnaround_v1(b.daily_bars(spark, sf_dir), warmup=warmup).where("long_entry").select("series", "ts", F.lit("long_entry").alias("side"))

    return align.signal_diff(entries(100), entries(300))


def why(spark, sf_dir) -> DataFrame:
    f = frame(spark, sf_dir)
    return f.select("series", "ts", F.array(F.lit("strength"), F.lit("energy")).alias("feature_names"), F.array("strength", "energy").alias("feature_values"))


@query()
def reason_diff(spark, sf_dir):
    """Reasons of two runs, one with strength altered on one day of the month and without a year."""
    a = why(spark, sf_dir)
    other = a.where(F.year("ts") != 1997).withColumn("feature_values", F.transform("feature_values", lambda v, i: F.when((i == 0) & (F.dayofmonth("ts") == 3), v + 0.5).otherwise(v)))
    return align.reason_diff(a, other).groupBy("series", "name", "difference").agg(F.count("*").alias("bars"))


@query(f"WITH {HOURLY} SELECT 'fail' AS verdict FROM (SELECT count(*) AS n FROM bars) WHERE n > 0")
def run_verdict(spark, sf_dir):
    d = bar_diff(spark, sf_dir)
    checks = d.agg(F.lit("bars").alias("section"), F.sum("bars").alias("exercised"), F.sum(F.col("absent") + F.col("differing")).alias("failures"))
    return align.verdict(checks)


# studies --------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {DAILY}, x AS (SELECT series, ts, close, abs(close - lag(close) OVER w) AS step, lead(close, 1) OVER w AS c1, lead(close, 7) OVER w AS c7 FROM bars WINDOW w AS (PARTITION BY series ORDER BY ts)), y AS (SELECT *, sum(step) OVER v AS path, count(step) OVER v AS n FROM x WINDOW v AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 2 FOLLOWING AND 7 FOLLOWING))
SELECT series, ts, round(c7 / c1 - 1, 6) AS fwd_6, round(CASE WHEN n = 6 AND path > 0 THEN abs(c7 - c1) / path END, 6) AS fer_6 FROM y""")
def forward_labels(spark, sf_dir):
    return rounded(studies.with_labels(b.daily_bars(spark, sf_dir), (6,)).select("series", "ts", "fwd_6", "fer_6"), "fwd_6", "fer_6")


def labelled(spark, sf_dir) -> DataFrame:
    return studies.with_labels(frame(spark, sf_dir), (4, 16))


@query(f"""WITH {DAILY}, x AS (SELECT series, ts, close / lag(close, 24) OVER w - 1 AS x, lead(close, 5) OVER w / lead(close, 1) OVER w - 1 AS y FROM bars WINDOW w AS (PARTITION BY series ORDER BY ts)), k AS (SELECT * FROM x WHERE x IS NOT NULL AND y IS NOT NULL),
r AS (SELECT series, rank() OVER (PARTITION BY series ORDER BY x) + (count(*) OVER (PARTITION BY series, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY series ORDER BY y) + (count(*) OVER (PARTITION BY series, y) - 1) / 2 AS ry FROM k) SELECT series, count(*) AS pairs, round(corr(rx, ry), 6) AS ic FROM r GROUP BY series""")
def information_coefficient(spark, sf_dir):
    x = studies.with_labels(b.daily_bars(spark, sf_dir).withColumn("momentum", k.pct_change(F.col("close"), 24)), (4,))
    return rounded(studies.rank_ic(studies.long_pairs(x, ["momentum"], (4,)), ["series"]), "ic")


@query()
def split_half_ic(spark, sf_dir):
    x = studies.split_half_ic(studies.long_pairs(labelled(spark, sf_dir), ["direction", "strength", "energy"], (4, 16)), ["series", "feature", "horizon"])
    return rounded(studies.ic_verdict(x), "ic", "ic_first", "ic_second")


@query()
def feature_diagnostics(spark, sf_dir):
    x = studies.feature_diagnostics(frame(spark, sf_dir), list(ROUNDED))
    return rounded(x, *[c for c in x.columns if c not in ("series", "feature")])


@query(f"""WITH {DAILY}, x AS (SELECT series, close, volume, high - low AS spread FROM bars) SELECT series, 'close' AS a, 'volume' AS b, round(corr(close, volume), 6) AS r FROM x GROUP BY series UNION ALL SELECT series, 'close', 'spread', round(corr(close, spread), 6) FROM x GROUP BY series UNION ALL SELECT series, 'volume', 'spread', round(corr(volume, spread), 6) FROM x GROUP BY series""")
def correlations(spark, sf_dir):
    x = b.daily_bars(spark, sf_dir).withColumn("spread", F.col("high") - F.col("low"))
    return rounded(studies.correlations(x, ["close", "volume", "spread"]), "r")


@query()
def closest_partner(spark, sf_dir):
    r = studies.correlations(frame(spark, sf_dir), list(ROUNDED))
    x = studies.closest_partner(r).withColumn("redundant", F.abs("r") >= 0.9)
    return rounded(x, "r")


CELLS = {"entry": [20, 40, 80], "leave": [10, 20, 40]}


def surface(spark, sf_dir) -> DataFrame:
    cells = studies.grid(spark, CELLS, ("entry", "leave"))
    return studies.surface_returns(studies.donchian_surface_signals(b.daily_bars(spark, sf_dir), cells), ("series", "cell", "entry", "leave"))


def points(spark, sf_dir) -> DataFrame:
    return studies.evaluate(surface(spark, sf_dir), ("series", "cell", "entry", "leave"), 80)


@query(f"""WITH {ORDERS}, {CHANNEL}, {RESOLVED}, {POSITION}, r0 AS (SELECT series, ts, n, coalesce(lag(held) OVER w, 0) AS position, coalesce(lag(held) OVER w, 0) <> lag(coalesce(held, 0), 2, 0) OVER w AS moved, coalesce((close / lag(close) OVER w - 1) * coalesce(lag(held) OVER w, 0), 0) AS ret FROM pos WINDOW w AS (PARTITION BY series ORDER BY ts))
SELECT series, round(CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(365.0) ELSE 0 END, 6) AS sharpe, CAST(count_if(moved) AS BIGINT) AS trades, count(*) AS bars FROM r0 WHERE n > 96 GROUP BY series""")
def strategy_evaluation(spark, sf_dir):
    x = ledger.bar_returns(ledger.net_position(strategies.donchian(b.order_bars(spark, sf_dir))))
    return rounded(studies.evaluate(x, ("series",), 96).select("series", "sharpe", "trades", "bars"), "sharpe")


@query()
def parameter_surface(spark, sf_dir):
    return rounded(points(spark, sf_dir), "total_return", "sharpe", "max_drawdown")


@query()
def stability_score(spark, sf_dir):
    p = points(spark, sf_dir)
    x = studies.stability_score(p).join(studies.best_cell(p), "series")
    return rounded(x, "stability", "sharpe", "total_return")


@query()
def surface_heat_map(spark, sf_dir):
    x = studies.heat_map(points(spark, sf_dir), "entry", "leave", CELLS["leave"])
    return rounded(x.select("series", "entry", *[F.col(str(v)).alias(f"leave_{v}") for v in CELLS["leave"]]), *[f"leave_{v}" for v in CELLS["leave"]])


@query()
def walk_forward(spark, sf_dir):
    x = studies.walk_forward(surface(spark, sf_dir), ("series", "cell", "entry", "leave"), 600, 300)
    return rounded(x, "train_sharpe", "test_sharpe", "test_return")


@query()
def walk_forward_summary(spark, sf_dir):
    x = studies.chained(studies.walk_forward(surface(spark, sf_dir), ("series", "cell", "entry", "leave"), 600, 300))
    return rounded(x, "oos_return", "mean_test_sharpe")


@query()
def perturbation(spark, sf_dir):
    keys = ("series", "cell", "entry", "leave")
    r = surface(spark, sf_dir)
    cut = F.lit("1999-01-01").cast("timestamp")
    x = studies.perturbation(studies.evaluate(r.where(F.col("ts") < cut), keys, 80), studies.evaluate(r.where(F.col("ts") >= cut), keys, 0), ("entry", "leave"))
    return rounded(x, "train_sharpe", "test_sharpe")


@query()
def deflated_sharpe(spark, sf_dir):
    x = studies.deflated_sharpe(studies.return_moments(surface(spark, sf_dir), ("series", "cell")))
    return x.select("series", "cell", F.round("sr", 6).alias("sr"), F.round("skew", 4).alias("skew"), F.round("kurt", 4).alias("kurt"), F.round("sr0", 6).alias("sr0"), F.round("dsr", 5).alias("dsr"))


@query(f"""WITH {DAILY}, m AS (SELECT series, ts, close / lag(close) OVER (PARTITION BY series ORDER BY ts) - 1 AS ret FROM bars), k AS (SELECT * FROM m WHERE ret IS NOT NULL)
SELECT series, CAST(count(*) AS DOUBLE) AS n, round(avg(ret) / stddev_samp(ret), 6) AS sr, round(skewness(ret), 4) AS skew FROM k GROUP BY series""")
def return_moments(spark, sf_dir):
    x = b.daily_bars(spark, sf_dir).withColumn("ret", k.pct_change(F.col("close"))).where("ret is not null")
    return studies.return_moments(x, ("series",)).select("series", "n", F.round("sr", 6).alias("sr"), F.round("skew", 4).alias("skew"))


def gated(spark, sf_dir) -> DataFrame:
    x = studies.trend_label(studies.with_half(labelled(spark, sf_dir)), "fer_16")
    return x.withColumns({"calm": F.col("energy") <= 0.4, "strong": F.col("strength") >= 0.15, "both": (F.col("energy") <= 0.4) & (F.col("strength") >= 0.15)})


@query()
def lift_table(spark, sf_dir):
    x = studies.rate_table(gated(spark, sf_dir), "calm")
    return rounded(x, *x.columns[3:])


@query()
def embargo_change(spark, sf_dir):
    """Lift with all training rows, and without those whose label reaches over the split."""
    x = gated(spark, sf_dir)
    a, c = studies.rate_table(x, "calm"), studies.rate_table(studies.embargoed(x, 16), "calm")
    out = a.select("series", "half", "bars", "lift_pp").join(c.select("series", "half", F.col("bars").alias("bars_kept"), F.col("lift_pp").alias("lift_kept")), ["series", "half"])
    return rounded(out, "lift_pp", "lift_kept")


@query()
def gate_verdicts(spark, sf_dir):
    x = gated(spark, sf_dir)
    singles = studies.rate_table(x, "calm").withColumn("gate", F.lit("calm")).unionByName(studies.rate_table(x, "strong").withColumn("gate", F.lit("strong")))
    gap = studies.composite_gap(studies.rate_table(x, "both"), singles)
    verdict = studies.lift_verdict(singles, ["gate"], 1.0)
    return rounded(gap.join(verdict, "gate"), "least_gap_pp", "mean_lift")


@query()
def coverage_threshold(spark, sf_dir):
    return rounded(studies.coverage_threshold(studies.with_half(frame(spark, sf_dir)), "energy", 0.25), "enter", "leave", "train_coverage", "test_coverage")


@query()
def conditional_ic(spark, sf_dir):
    x = labelled(spark, sf_dir).where("energy is not null")
    p = studies.long_pairs(x, ["direction"], (4,)).join(x.select("series", "ts", "energy"), ["series", "ts"])
    return rounded(studies.conditional_ic(p, ["series"], "energy"), "ic", "ic_first", "ic_second")


@query()
def persistence_rows(spark, sf_dir):
    x = studies.persistence(frame(spark, sf_dir).withColumn("on", F.col("energy") <= 0.4), "on")
    return rounded(x, *[c for c in x.columns if c not in ("series", "runs", "longest")])


@query()
def feature_dropout(spark, sf_dir):
    """Occupied states with each input of the lifecycle in turn held neutral."""
    x = studies.dropout(machine_frame(spark, sf_dir), ["strength", "stability", "energy"], {"strength": 0.5, "stability": 0.5, "energy": 0.5})
    states = lifecycle.walk(x, LOOSE, ("series", "dropped"))
    return rounded(lifecycle.occupancy(states, ("series", "dropped")), "share")


@query()
def entry_size_census(spark, sf_dir):
    x = strategies.with_atr(strategies.turnaround_v1(b.daily_bars(spark, sf_dir), warmup=100)).withColumn("size", strategies.atr_scale("atr"))
    return rounded(studies.entry_size_census(x), "least", "median", "most")


@query()
def start_invariance(spark, sf_dir):
    """Entries of the channel strategy after 1998 that depend on where its history begins (none), for each series."""
    cut, start = F.lit("1998-01-01").cast("timestamp"), F.lit("1997-01-01").cast("timestamp")
    x = b.daily_bars(spark, sf_dir)
    d = studies.start_invariance(strategies.donchian, x, cut, start).groupBy("series").agg(F.count("*").alias("differing"))
    return x.groupBy("series").agg(F.count("*").alias("bars")).join(d, "series", "left").na.fill(0)


@query()
def label_anchor_audit(spark, sf_dir):
    return studies.label_anchor_audit(b.daily_bars(spark, sf_dir), 6, F.lit("1998-01-01").cast("timestamp"))


@query(f"WITH {HOURLY}, {FUNDING}, s AS (SELECT series, max(settled) AS z FROM funding GROUP BY series) SELECT series, ts, close FROM (SELECT b.*, row_number() OVER (PARTITION BY b.series ORDER BY ts DESC) AS r FROM bars b JOIN s USING (series) WHERE ts <= z) WHERE r <= 50")
def last_covered(spark, sf_dir):
    return studies.last_covered(b.hourly_bars(spark, sf_dir), b.funding_span(b.settlements(spark, sf_dir)), 50).select("series", "ts", "close")


# board ----------------------------------------------------------------------------------------------------------------------


@query()
def board_rows(spark, sf_dir):
    x = b.daily_bars(spark, sf_dir)
    states = lifecycle.walk(machine_frame(spark, sf_dir), LOOSE)
    signals = strategies.all_signals(x, ["tsmom", "donchian", "turnaround_v1"])
    return board.latest_rows(x, states, signals, {n: strategies.WARMUPS[n] for n in ("tsmom", "donchian", "turnaround_v1")})


@query(f"WITH {HOURLY}, c AS (SELECT series, count(*) AS bars FROM bars GROUP BY series), w AS (SELECT * FROM (VALUES ('tsmom', 96), ('ema_cross', 3840)) t(strategy, warmup)) SELECT 'venue' AS exchange, CASE WHEN series < 'd' THEN 'perp' ELSE 'spot' END AS market_type, series AS symbol, '1h' AS timeframe, strategy, bars, warmup, bars > warmup AS reached FROM c, w")
def timeframe_reach(spark, sf_dir):
    return board.reach(b.keyed_bars(spark, sf_dir), {"tsmom": 96, "ema_cross": 3840})


@query(f"WITH {HOURLY}, c AS (SELECT CASE WHEN series < 'd' THEN 'perp' ELSE 'spot' END AS market_type, series AS symbol, max(ts) AS last_ts FROM bars GROUP BY series), m AS (SELECT market_type, max(last_ts) AS newest FROM c GROUP BY market_type) SELECT symbol, CASE WHEN market_type = 'perp' THEN last_ts < newest ELSE date_diff('day', last_ts, TIMESTAMP '2024-03-01') > 31 END AS stale FROM c JOIN m USING (market_type)")
def staleness(spark, sf_dir):
    x = board.staleness(board.datasets(b.keyed_bars(spark, sf_dir)), F.lit("2024-03-01").cast("timestamp"))
    return x.select("symbol", "stale")


@query(f"WITH {DAILY}, m AS (SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS bars FROM bars) SELECT strategy, warmup, first_ts, last_ts, bars, 'run' AS run_id, 'continuation_failure' AS exit_mode FROM (VALUES ('tsmom', 96), ('donchian', 96)) t(strategy, warmup), m")
def provenance(spark, sf_dir):
    return board.provenance("run", "continuation_failure", {"tsmom": 96, "donchian": 96}, b.daily_bars(spark, sf_dir))


@query()
def state_view(spark, sf_dir):
    f = machine_frame(spark, sf_dir)
    names = ["direction", "strength", "stability", "energy"]
    x = board.why_layer(board.state_view(f, lifecycle.walk(f, LOOSE), names), names)
    return x.select("series", "ts", "state", *[F.round(F.col("features")[n], 6).alias(n) for n in names])


# streams --------------------------------------------------------------------------------------------------------------------


def _folder(spark) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _streamed(spark, df: DataFrame, name: str, slices: int = 4) -> tuple[DataFrame, str]:
    """A table as a file stream: slices of time one after the other, each series in one file of a slice.

    Where a watermark spans all series, one slice is read as one micro-batch instead.
    """
    at = _folder(spark)
    df.write.parquet(f"{at}/whole")
    whole = spark.read.schema(df.schema).parquet(f"{at}/whole")
    if slices == 1:
        return spark.readStream.schema(df.schema).parquet(f"{at}/whole"), at
    ms = F.unix_millis("ts")
    cuts = [None, *whole.agg(F.percentile_approx(ms, [i / slices for i in range(1, slices)])).first()[0], None]
    for lo, hi in zip(cuts, cuts[1:]):
        part = whole if lo is None else whole.where(ms > lo)
        part = part if hi is None else part.where(ms <= hi)
        part.repartition("series").write.mode("append").parquet(f"{at}/{name}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/{name}"), at


@query(f"WITH {DAILY}, {PATTERN} SELECT series, ts, unnest(CASE WHEN up THEN ['exit_short', 'enter_long'] ELSE ['exit_long', 'enter_short'] END) AS side, close FROM f WHERE (up OR down) AND n > 2")
def streamed_reversal_signals(spark, sf_dir):
    """Signals of the bar stream, in several micro-batches with state for each series; the SQL is the batch rule."""
    x, at = _streamed(spark, b.daily_bars(spark, sf_dir), "bars")
    out = stream.run_to_end(stream.reversal_signals(x), f"{at}/signals", f"{at}/state", ["series", "ts", "side"])
    return out.select("series", "ts", "side", "close")


@query()
def streamed_levels(spark, sf_dir):
    x, at = _streamed(spark, b.hourly_bars(spark, sf_dir), "bars")
    out = stream.run_to_end(stream.ema_level_signals(x, 12, 48, 50), f"{at}/levels", f"{at}/state", ["series", "ts"])
    return rounded(out, "target")


@query()
def streamed_lifecycle(spark, sf_dir):
    """States of the lifecycle as a stream: the same rows as lifecycle_states."""
    x, at = _streamed(spark, machine_frame(spark, sf_dir).select("series", "ts", *features.LIFECYCLE), "frame")
    return stream.run_to_end(stream.lifecycle_stream(x, LOOSE), f"{at}/states", f"{at}/state", ["series", "ts"])


@query()
def stream_equals_batch(spark, sf_dir):
    """Signals of the stream and of the batch rule that the other doesn't have, for each series (none)."""
    streamed = streamed_reversal_signals(spark, sf_dir)
    x = strategies.turnaround_v1(b.daily_bars(spark, sf_dir), warmup=2)
    sides = F.when(F.col("long_entry"), F.array(F.lit("exit_short"), F.lit("enter_long"))).otherwise(F.array(F.lit("exit_long"), F.lit("enter_short")))
    batch = x.where(F.col("long_entry") | F.col("short_entry")).select("series", "ts", F.explode(sides).alias("side"))
    d = align.signal_diff(streamed, batch).groupBy("series").agg(F.count("*").alias("differing"))
    return streamed.groupBy("series").agg(F.count("*").alias("signals")).join(d, "series", "left").na.fill(0)


@query(f"WITH {HOURLY} SELECT * FROM bars WHERE ts + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events)")
def streamed_event_bars(spark, sf_dir):
    """Tumbling bars of the event stream whose window the watermark has passed."""
    x = b.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    s, at = _streamed(spark, x, "events", 1)
    return stream.run_to_end(stream.event_bars(s), f"{at}/bars", f"{at}/state", ["series", "ts"])


@query(f"WITH {HOURLY} SELECT ts + INTERVAL 3599999 MILLISECOND AS ts_close, count(*) AS present, string_agg(series, ',' ORDER BY series) AS series FROM bars GROUP BY ts")
def streamed_snapshots(spark, sf_dir):
    """Snapshots of all series at each close, once a later bar has come."""
    s, at = _streamed(spark, b.hourly_bars(spark, sf_dir), "bars", 1)
    x = stream.snapshot_stream(s, 3600000).withColumn("series", F.concat_ws(",", F.transform("bars", lambda r: r["series"]))).drop("bars")
    return stream.run_to_end(x, f"{at}/snapshots", f"{at}/state", ["ts_close"])


# parsers, sinks and audits -------------------------------------------------------------------------------------------------


@query(f"WITH {FUNDING} SELECT series, epoch_us(settled) // 1000 AS ts_ms, round(1000 + rate, 9) AS open_interest, CASE WHEN (epoch_us(settled) // 1000) % 3 <> 0 THEN 5.5 END AS open_interest_usd FROM funding")
def parse_open_interest(spark, sf_dir):
    x, ms = b.settlements(spark, sf_dir), F.unix_millis("settled")
    item = F.struct(F.col("series").alias("symbol"), ms.alias("timestamp"), F.format_string("%.12f", 1000 + F.col("rate")).alias("sumOpenInterest"), F.when(ms % 3 != 0, "5.5").otherwise(" ").alias("sumOpenInterestValue"))
    out = b.parse_open_interest(x.groupBy("series", F.date_trunc("hour", "settled").alias("hour")).agg(F.to_json(F.collect_list(item)).alias("payload")).drop("hour"))
    return out.select("series", "ts_ms", F.round(F.col("open_interest").cast("double"), 9).alias("open_interest"), F.col("open_interest_usd").cast("double").alias("open_interest_usd"))


@query(f"WITH {HOURLY} SELECT series, ts, open, high, low, close + 1 AS close, volume FROM bars")
def parse_rows(spark, sf_dir):
    """Rows as landed lists, each instant twice: the later one is kept."""
    x = b.hourly_bars(spark, sf_dir)
    row = lambda c: F.array(F.unix_millis("ts").cast("double"), *[F.col(p) for p in PRICES[:3]], c, F.col("volume"))
    lists = x.groupBy("series", F.date_trunc("day", "ts").alias("day")).agg(F.to_json(F.concat(F.collect_list(row(F.col("close"))), F.collect_list(row(F.col("close") + 1)))).alias("payload"))
    return b.parse_rows(lists.drop("day")).select("series", "ts", *PRICES)


@query(f"WITH {DAILY}, {PATTERN} SELECT series, ts, 'enter_long' AS side, close FROM f WHERE up AND n > 100 AND year(ts) >= 1998")
def append_only_signals(spark, sf_dir):
    """What a second, overlapping batch really adds to an append-only sink."""
    x = strategies.turnaround_v1(b.daily_bars(spark, sf_dir), warmup=100).where("long_entry").select("series", "ts", F.lit("enter_long").alias("side"), "close")
    return b.append_new(x.where(F.year("ts") < 1998), x, ["series", "ts", "side"])


@query(f"WITH {DAILY}, {PATTERN} SELECT series, ts, unnest(CASE WHEN up THEN [1, 2] ELSE [3, 4] END) AS id FROM f WHERE (up OR down) AND n > 100 AND series = 's1'")
def signal_reader(spark, sf_dir):
    x = strategies.turnaround_v1(b.daily_bars(spark, sf_dir), warmup=100).where("long_entry or short_entry")
    rows = x.select("series", "ts", F.explode(F.when(F.col("long_entry"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(3), F.lit(4)))).alias("id"))
    return b.load_signals(rows, series="s1")


@query()
def reason_rows(spark, sf_dir):
    """Reasons fit to be stored, for each series: equal lengths, no NaN, nulls allowed."""
    x = why(spark, sf_dir)
    bad = x.where(F.dayofmonth("ts") == 5).withColumn("feature_names", F.slice("feature_names", 1, 1))
    return b.reasons_valid(x.unionByName(bad)).groupBy("series").agg(F.count("*").alias("rows"))


@query(f"WITH {DAILY} SELECT series, count(*) AS bars FROM bars GROUP BY series")
def run_artifacts(spark, sf_dir):
    """A run's tables written under its folder and read again."""
    at = _folder(spark)
    b.write_run(at, "r1", {"equity": b.daily_bars(spark, sf_dir), "statistics": b.nan_to_null(ledger.benchmark_return(b.daily_bars(spark, sf_dir)))}, {"mode": "backtest", "fee": 0.0006})
    return spark.read.parquet(f"{at}/run_id=r1/equity").groupBy("series").agg(F.count("*").alias("bars"))


@query(f"WITH {HOURLY} SELECT series, ts, open, high, low, close + 1 AS close, volume, epoch_ms(ts) + 3599999 AS ts_close_ms FROM bars")
def replay_order(spark, sf_dir):
    x = b.hourly_bars(spark, sf_dir)
    both = x.withColumn("seq", F.lit(1)).unionByName(x.withColumns({"close": F.col("close") + 1, "seq": F.lit(2)}))
    return b.replayed(both, 3600000, "seq")


@query(f"WITH {HOURLY}, {FUNDING}, {CONTAINED}, r AS (SELECT series, ts, sum(rate) AS rate FROM inside GROUP BY series, ts) SELECT b.series, count(r.rate) AS funded, count(*) AS bars FROM bars b LEFT JOIN r ON b.series = r.series AND b.ts = r.ts GROUP BY b.series HAVING count(r.rate) > 0 AND count(r.rate) < count(*)")
def mixed_funding(spark, sf_dir):
    """Series whose feed carries funding on some bars only, here where bars without a settlement have none."""
    per_bar = align.contained(b.hourly_bars(spark, sf_dir), b.settlements(spark, sf_dir)).groupBy("series", "ts").agg(F.sum("rate").alias("funding_rate"))
    return b.mixed_funding(b.hourly_bars(spark, sf_dir).join(per_bar, ["series", "ts"], "left"))


@query(f"WITH {DAILY}, m AS (SELECT series, (epoch_ms(max(ts)) - epoch_ms(min(ts))) // 3600000 AS h FROM bars GROUP BY series) SELECT series, (h // 24) || 'd ' || (h % 24) || 'h' AS span FROM m")
def series_spans(spark, sf_dir):
    x = b.daily_bars(spark, sf_dir).groupBy("series").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    return x.select("series", times.dwell_text(times.dwell_ms(F.col("a"), F.col("z"))).alias("span"))


@query(f"WITH {DAILY}, {CHANNEL}, {RESOLVED}, {POSITION}, {TRADES}, fills AS (SELECT series, quantity, entry_price AS price, direction = 'long' AS buy FROM tp UNION ALL SELECT series, quantity, exit_price, direction <> 'long' FROM tp WHERE exit_ts IS NOT NULL) SELECT series, round(sum(quantity * price / CASE WHEN buy THEN 1.0002 ELSE 0.9998 END * 0.0002), 4) AS slippage_paid, count(*) AS fills FROM fills GROUP BY series")
def slippage_paid(spark, sf_dir):
    t = ledger.trades(ledger.net_position(channel(spark, sf_dir)))
    first = t.select("series", "quantity", F.col("entry_price").alias("price"), (F.col("direction") == "long").alias("buy"))
    last = t.where("status = 'closed'").select("series", "quantity", F.col("exit_price").alias("price"), (F.col("direction") != "long").alias("buy"))
    return rounded(ledger.slippage_paid(first.unionByName(last).withColumn("slippage_rate", F.lit(0.0002))), "slippage_paid", digits=4)


@query()
def ruin_comparison(spark, sf_dir):
    """Whether the trend rule beats the channel rule on each series; unknown where either curve is ruined."""
    def stats(x, name):
        r = ledger.risk_statistics(ledger.equity_curve(ledger.bar_returns(ledger.net_position(x))), 365.0)
        return r.select("series", F.col("total_return").alias(name), (F.col("ruined_bars") > 0).alias(f"{name}_ruined"))

    x = b.order_bars(spark, sf_dir)
    both = stats(strategies.tsmom(x, 20), "trend").join(stats(strategies.donchian(x, 20, 10), "channel"), "series")
    return both.select("series", "trend_ruined", "channel_ruined", ledger.beats(F.col("trend"), F.col("trend_ruined"), F.col("channel"), F.col("channel_ruined")).alias("trend_wins"))


@query("SELECT lower(n_name) AS series, CASE n_regionkey WHEN 0 THEN 'context' ELSE 'trade' END AS role FROM nation WHERE lower(n_name) NOT IN (SELECT event_type FROM events)")
def unknown_roles(spark, sf_dir):
    """Roles given to instruments, those of the bars and the nations; the latter have no bars."""
    bars = b.hourly_bars(spark, sf_dir)
    given = b.table(spark, sf_dir, "nation").select(F.lower("n_name").alias("series"), F.when(F.col("n_regionkey") == 0, "context").otherwise("trade").alias("role"))
    return align.unknown_roles(bars, bars.select("series").distinct().withColumn("role", F.lit("context")).union(given))


@query(f"WITH {DAILY}, {PATTERN} SELECT series, ts, unnest(CASE WHEN up THEN ['exit_short', 'enter_long'] ELSE ['exit_long', 'enter_short'] END) AS side FROM f WHERE (up OR down) AND n > 2 AND ts > TIMESTAMP '1999-01-01'")
def primed_stream_signals(spark, sf_dir):
    """The bar stream whose bars up to 1999 are history that fills the state and emits nothing."""
    x, at = _streamed(spark, b.daily_bars(spark, sf_dir), "bars")
    out = stream.run_to_end(stream.reversal_signals(x, emit_after_ms=915148800000), f"{at}/signals", f"{at}/state", ["series", "ts", "side"])
    return out.select("series", "ts", "side")


@query(f"WITH {HOURLY} SELECT series, ts, open, high, low, close, volume FROM bars")
def streamed_without_repeats(spark, sf_dir):
    """Each bar arrives twice; the repeats are dropped while the watermark covers them."""
    x = b.hourly_bars(spark, sf_dir)
    s, at = _streamed(spark, x.union(x), "bars", 1)
    return stream.run_to_end(stream.without_repeats(s), f"{at}/once", f"{at}/state", ["series", "ts"]).select("series", "ts", *PRICES)


@query(ORACLE_SQL["donchian"])
def donchian_in_chunks(spark, sf_dir):
    """The channel rule with series cut into quarters of a year, as for series too long for one task; rows of the first 96 bars have no signal."""
    no = lambda c: F.coalesce(c, F.lit(False))
    c, w = F.col("close"), k.series_window()

    def edge(f, column, n):
        span = w.rowsBetween(-n, -1)
        return F.when(F.count(column).over(span) == n, f(column).over(span))

    def kernel(x):
        x = x.withColumn("_ready", F.count("close").over(w.rowsBetween(-96, -1)) == 96)
        rules = (c > edge(F.max, "high", 96), c < edge(F.min, "low", 48), c < edge(F.min, "low", 96), c > edge(F.max, "high", 48))
        return x.withColumns({n: no(F.col("_ready") & r) for n, r in zip(ledger.FLAGS, rules)}).drop("_ready")

    return flags(halo.in_chunks(b.daily_bars(spark, sf_dir), 90 * 86_400_000, 96, kernel))


# SQL of further queries -----------------------------------------------------------------------------------------------------

BY_TIME = "WINDOW w AS (PARTITION BY series ORDER BY ts)"
ORACLE_SQL |= {
    "multi_horizon": f"""WITH {DAILY}, r AS (SELECT *, row_number() OVER w AS n, close / lag(close) OVER w - 1 AS r, close / lag(close, 24) OVER w - 1 AS m1, close / lag(close, 48) OVER w - 1 AS m2, close / lag(close, 96) OVER w - 1 AS m3, close / lag(close, 192) OVER w - 1 AS m4 FROM bars {BY_TIME}),
v AS (SELECT *, stddev_samp(r) OVER t AS sd, count(r) OVER t AS k FROM r WINDOW t AS (PARTITION BY series ORDER BY ts ROWS 95 PRECEDING)), s AS (SELECT series, ts, n > 192 AS ready, CASE WHEN k = 96 AND sd > 0 THEN (m1 / (sd * sqrt(24)) + m2 / (sd * sqrt(48)) + m3 / (sd * sqrt(96)) + m4 / (sd * sqrt(192))) / 4 END AS score FROM v)
SELECT series, ts, coalesce(ready AND score > 0, false) AS long_entry, coalesce(ready AND score < 0, false) AS long_exit, coalesce(ready AND score < 0, false) AS short_entry, coalesce(ready AND score > 0, false) AS short_exit FROM s""",
    "ema_cross": f"""WITH {DAILY}, {EMA}, {ema_sql(48, "f")}, {ema_sql(192, "s")}
SELECT n.series, n.ts, n.i >= 400 AND f.v > s.v AS long_entry, n.i >= 400 AND f.v < s.v AS long_exit, n.i >= 400 AND f.v < s.v AS short_entry, n.i >= 400 AND f.v > s.v AS short_exit FROM n JOIN f ON f.series = n.series AND f.ts = n.ts JOIN s ON s.series = n.series AND s.ts = n.ts""",
    "turnaround_v2": f"""WITH {DAILY}, {PATTERN}, {EMA}, {ema_sql(200, "t")}, {ema_sql(20, "e")}, s AS (SELECT f.series, f.ts, n > 400 AND up AND close > t.v AND close < e.v * 0.99 AS le, n > 400 AND down AND close < t.v AND close > e.v * 1.01 AS se FROM f JOIN t ON f.series = t.series AND f.ts = t.ts JOIN e ON f.series = e.series AND f.ts = e.ts)
SELECT series, ts, le AS long_entry, se AS long_exit, se AS short_entry, le AS short_exit FROM s""",
    "trend_rider": f"""WITH {DAILY}, {PATTERN}, t AS (SELECT series, ts, close, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, row_number() OVER w - 1 AS i FROM bars {BY_TIME}), {ema_sql(14, "a", "t", "tr")},
d AS (SELECT series, ts, close - lag(close) OVER w AS d, close / lag(close, 26) OVER w - 1 AS mom, avg(close) OVER (w ROWS 39 PRECEDING) AS sma FROM bars {BY_TIME}),
g AS (SELECT *, sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) OVER u = 3 AS falls, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) OVER u = 3 AS rises FROM d WINDOW u AS (PARTITION BY series ORDER BY ts ROWS 2 PRECEDING)),
s AS (SELECT f.series, f.ts, n > 40 AS ready, up AND close > sma AND a.v / close < 0.10 AS long, falls, rises, close < sma AS below, coalesce(mom < 0, false) AS losing FROM f JOIN g ON f.series = g.series AND f.ts = g.ts JOIN a ON f.series = a.series AND f.ts = a.ts)
SELECT series, ts, ready AND long AS long_entry, ready AND (falls OR below OR losing) AS long_exit, false AS short_entry, ready AND (long OR rises OR NOT below OR NOT losing) AS short_exit FROM s""",
    "ew_volatility": f"""WITH {ORDERS}, q AS (SELECT series, ts, row_number() OVER w AS n, close / lag(close) OVER w - 1 AS ret FROM bars {BY_TIME}), rr AS (SELECT series, ts, ret, ret * ret AS sq, row_number() OVER w - 1 AS i FROM q WHERE ret IS NOT NULL {BY_TIME}), {ema_sql(20, "m1", "rr", "ret")}, {ema_sql(20, "m2", "rr", "sq")},
k AS (SELECT rr.series, rr.ts, rr.i, m1.v AS a1, m2.v AS a2, pow((19 / 21.0) * (19 / 21.0), rr.i) AS d2 FROM rr JOIN m1 ON rr.series = m1.series AND rr.ts = m1.ts JOIN m2 ON rr.series = m2.series AND rr.ts = m2.ts),
y AS (SELECT series, ts, CASE WHEN i > 0 THEN sqrt(greatest((a2 - a1 * a1) / (1 - (d2 + pow(2 / 21.0, 2) * (1 - d2) / (1 - pow(19 / 21.0, 2)))), 0)) * sqrt(365.25) END AS year FROM k)
SELECT q.series, q.ts, round(year, 6) AS realised_vol, round(CASE WHEN n > 400 AND year > 0 THEN least(0.4 / year, 2.0) ELSE 0.0 END, 6) AS vol_weight FROM q LEFT JOIN y ON q.series = y.series AND q.ts = y.ts""",
    "risk_statistics": f"""WITH {ORDERS}, x AS (SELECT series, ts, close, row_number() OVER w AS n, close / lag(close, 20) OVER w - 1 AS r FROM bars {BY_TIME}),
sig AS (SELECT series, ts, close, n, coalesce(n > 20 AND r > 0, false) AS long_entry, coalesce(n > 20 AND r < 0, false) AS long_exit, coalesce(n > 20 AND r < 0, false) AS short_entry, coalesce(n > 20 AND r > 0, false) AS short_exit FROM x), {RESOLVED}, {POSITION}, {RETURNS},
z AS (SELECT *, coalesce(equity / nullif(coalesce(lag(equity) OVER w, 1), 0) - 1, 0) AS r, last_value(CASE WHEN drawdown >= -1e-12 THEN n END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS top FROM eq {BY_TIME}),
a AS (SELECT series, count(*) AS bars, arg_max(equity, n) AS end_value, min(drawdown) AS max_drawdown, max(n - coalesce(top, 0)) AS drawdown_bars, avg(r) AS mean, stddev_samp(r) AS sd, sqrt(avg(pow(least(r, 0), 2))) AS down, sum(greatest(r, 0)) AS gain, -sum(least(r, 0)) AS loss, min(equity) AS least_equity, CAST(count_if(equity <= 0) AS BIGINT) AS ruined_bars FROM z GROUP BY series),
y AS (SELECT *, CASE WHEN end_value > 0 THEN pow(end_value, 365.0 / bars) - 1 END AS annual_return FROM a)
SELECT series, bars, round(end_value - 1, 6) AS total_return, round(end_value, 6) AS end_value, round(max_drawdown, 6) AS max_drawdown, drawdown_bars, round(annual_return, 6) AS annual_return, round(sd * sqrt(365.0), 6) AS annual_volatility, round(coalesce(CASE WHEN sd > 0 THEN mean * sqrt(365.0) / sd END, 0), 6) AS sharpe,
 round(CASE WHEN down > 0 THEN mean * sqrt(365.0) / down END, 6) AS sortino, round(CASE WHEN max_drawdown < 0 THEN annual_return / -max_drawdown END, 6) AS calmar, round(CASE WHEN loss > 0 THEN gain / loss END, 6) AS omega, round(least_equity, 6) AS least_equity, ruined_bars FROM y""",
    "crowding": f"""WITH {HOURLY}, {FUNDING}, {CONTAINED}, b AS (SELECT b.series, b.ts, coalesce(sum(i.rate), 0) AS rate FROM bars b LEFT JOIN inside i ON b.series = i.series AND b.ts = i.ts GROUP BY b.series, b.ts),
s AS (SELECT series, ts, row_number() OVER w AS n, CASE WHEN count(rate) OVER u = 6 THEN sum(rate) OVER u END AS s FROM b WINDOW w AS (PARTITION BY series ORDER BY ts), u AS (PARTITION BY series ORDER BY ts ROWS 5 PRECEDING)),
z AS (SELECT series, ts, n, s, avg(s) OVER u AS m, stddev_samp(s) OVER u AS sd, count(s) OVER u AS k FROM s WINDOW u AS (PARTITION BY series ORDER BY ts ROWS 59 PRECEDING))
SELECT series, ts, round(CASE WHEN n > 64 AND k = 60 THEN (tanh(CASE WHEN sd = 0 THEN 0 ELSE (s - m) / sd END) + 1) / 2 END, 6) AS crowding FROM z""",
    "entry_size_census": f"""WITH {DAILY}, {PATTERN}, t AS (SELECT series, ts, close, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, row_number() OVER w - 1 AS i FROM bars {BY_TIME}), {ema_sql(14, "a", "t", "tr")},
s AS (SELECT f.series, CASE WHEN n > 100 AND (up OR down) THEN CASE WHEN a.v > 0 THEN least(greatest(0.06 / (a.v / close), 0.3), 1.0) ELSE 0.3 END END AS s FROM f JOIN a ON f.series = a.series AND f.ts = a.ts)
SELECT series, count(s) AS entries, CAST(count_if(s <> 1) AS BIGINT) AS not_one, round(min(s), 6) AS least, round(quantile_cont(s, 0.5), 6) AS median, round(max(s), 6) AS most, count(DISTINCT round(s, 9)) AS sizes FROM s GROUP BY series""",
    "start_invariance": f"WITH {DAILY} SELECT series, count(*) AS bars, CAST(0 AS BIGINT) AS differing FROM bars GROUP BY series",
    "label_anchor_audit": f"WITH {DAILY} SELECT series, count(*) AS labels, CAST(0 AS BIGINT) AS moved FROM bars WHERE ts >= TIMESTAMP '1998-01-01' GROUP BY series",
    "stream_equals_batch": f"WITH {DAILY}, {PATTERN} SELECT series, CAST(2 * count(*) AS BIGINT) AS signals, CAST(0 AS BIGINT) AS differing FROM f WHERE (up OR down) AND n > 2 GROUP BY series",
    "reason_rows": f"WITH {DAILY} SELECT series, count(*) AS rows FROM bars GROUP BY series",
}
REGULAR = """days AS (SELECT DISTINCT series, date_trunc('day', ts) AS d FROM bars), funding AS (SELECT series, CAST(d AS TIMESTAMP) + h * INTERVAL 1 HOUR AS settled FROM days, (VALUES (0), (8), (16)) t(h) WHERE day(d) NOT IN (9, 10, 20))"""
GAPS = """e AS (SELECT series, min(ts) AS first_ts, max(ts) + CAST(quantile_cont(gap, 0.5) AS BIGINT) * INTERVAL 1 MILLISECOND AS end_ts FROM (SELECT series, ts, epoch_ms(lead(ts) OVER (PARTITION BY series ORDER BY ts)) - epoch_ms(ts) AS gap FROM bars) GROUP BY series),
s AS (SELECT f.series, settled, lead(settled) OVER (PARTITION BY f.series ORDER BY settled) AS next FROM funding f JOIN e USING (series) WHERE settled >= first_ts AND settled < end_ts), g AS (SELECT *, epoch_us(next) - epoch_us(settled) AS gap FROM s),
c AS (SELECT series, quantile_cont(gap, 0.5) AS cadence, min(settled) AS first, max(settled) AS last, count(*) AS n FROM g GROUP BY series), p AS (SELECT g.series, count_if(abs(gap - cadence) <= cadence * 0.1) AS repeats FROM g JOIN c USING (series) GROUP BY g.series),
k AS (SELECT e.series, first_ts, end_ts, cadence, first, last, coalesce(n >= 2 AND repeats >= 2, false) AS sure FROM e LEFT JOIN c USING (series) LEFT JOIN p USING (series)),
gaps AS (SELECT series, first_ts AS gap_start, end_ts AS gap_end FROM k WHERE NOT sure UNION ALL SELECT series, first_ts, first FROM k WHERE sure AND epoch_us(first) - epoch_us(first_ts) >= cadence UNION ALL SELECT g.series, settled, next FROM g JOIN k USING (series) WHERE sure AND gap > cadence * 1.5 UNION ALL SELECT series, last, end_ts FROM k WHERE sure AND epoch_us(end_ts) - epoch_us(last) > cadence)"""
ORACLE_SQL["coverage_gaps"] = f"WITH {HOURLY}, {REGULAR}, {GAPS} SELECT series, gap_start, gap_end FROM gaps"
ORACLE_SQL["funding_status"] = f"""WITH {HOURLY}, {REGULAR}, {GAPS}, h AS (SELECT series, count(*) AS n, min(gap_start) AS first_gap FROM gaps GROUP BY series)
SELECT k.series, coalesce(h.n, 0) AS gaps, CASE WHEN h.n > 0 THEN 'refused' ELSE 'attached' END AS status, CASE WHEN h.n > 0 THEN 'gap from ' || strftime(first_gap, '%Y-%m-%d %H:%M') ELSE '' END AS reason FROM k LEFT JOIN h USING (series)"""


# smaller operators ----------------------------------------------------------------------------------------------------------


@query(f"WITH {DAILY}, x AS (SELECT series, ts, close, row_number() OVER w AS n, close / lag(close, 26) OVER w - 1 AS r, avg(close) OVER (w ROWS 39 PRECEDING) AS m FROM bars {BY_TIME}) SELECT series, ts, coalesce(r > 0, false) AS rising, n >= 40 AND close > m AS above, coalesce(r < 0, false) AS falling, n >= 40 AND close < m AS below FROM x")
def filters(spark, sf_dir):
    """Momentum and trend as filters of entries, and as exits."""
    return b.daily_bars(spark, sf_dir).select("series", "ts", strategies.momentum_filter(26).alias("rising"), strategies.trend_filter(40).alias("above"), strategies.momentum_exit(26).alias("falling"), strategies.regime_exit(40).alias("below"))


@query(f"WITH {ORDERS}, r AS (SELECT series, ts, coalesce(close / lag(close) OVER w - 1, 0) AS r FROM bars {BY_TIME}) SELECT series, ts, round(exp(sum(ln(1 + r)) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING)), 6) AS growth FROM r")
def compounded_returns(spark, sf_dir):
    x = b.order_bars(spark, sf_dir).withColumn("r", F.coalesce(k.pct_change(F.col("close")), F.lit(0.0)))
    return x.select("series", "ts", F.round(k.running_product(F.col("r")), 6).alias("growth"))


@query(f"WITH {DAILY}, {CHANNEL} SELECT series, ts, round(CASE WHEN long_entry THEN 10000.0 * 0.95 / close ELSE 0 END, 6) AS shares FROM sig")
def entry_share_counts(spark, sf_dir):
    x = channel(spark, sf_dir)
    return x.select("series", "ts", F.round(ledger.entry_shares(10_000.0, F.lit(0.95), F.col("close"), F.col("long_entry")), 6).alias("shares"))


@query(f"WITH {FUNDING}, s AS (SELECT series, epoch_us(settled) // 1000 AS ms, max(rate) AS rate FROM funding GROUP BY series, settled) SELECT series, count(*) AS settlements, CAST(count_if(ms % 5 = 0) AS BIGINT) AS corrected, CAST(round(sum(CAST(CASE WHEN ms % 5 = 0 THEN rate + 1 ELSE rate END AS DECIMAL(18, 9))), 6) AS DOUBLE) AS rates FROM s GROUP BY series")
def upsert_funding(spark, sf_dir):
    """Stored settlements with a newer batch that corrects some of them: one row for each series and instant, the newer one.

    Of stored settlements of one instant the highest rate stands. Rates have seven digits and are summed as decimals, so the sixth one rounds alike in any order.
    """
    x = b.settlements(spark, sf_dir).groupBy("series", "settled").agg(F.max("rate").alias("rate")).withColumn("updated_at", F.lit(1))
    new = x.where(F.unix_millis("settled") % 5 == 0).withColumns({"rate": F.col("rate") + 1, "updated_at": F.lit(2)})
    out = b.upsert(x, new, ("series", "settled"))
    return out.groupBy("series").agg(F.count("*").alias("settlements"), F.count_if(F.col("updated_at") == 2).alias("corrected"), F.round(F.sum(F.col("rate").cast("decimal(18, 9)")), 6).cast("double").alias("rates"))


@query(f"WITH {DAILY} SELECT series, CAST(503 + 8 * (2 + 2 + 2 + 4 + 3 + 2) AS INTEGER) AS warmup, greatest(count(*) - (503 + 8 * (2 + 2 + 2 + 4 + 3 + 2)), 0) AS usable, count(*) AS bars FROM bars GROUP BY series")
def lifecycle_warmup(spark, sf_dir):
    """Bars of each series before and after the warmup that the features' windows and the lifecycle's memory give."""
    warmup = features.derived_warmup(LOOSE.convergence_bars, 96)
    x = b.daily_bars(spark, sf_dir).withColumn("n", F.row_number().over(k.series_window()))
    return x.groupBy("series").agg(F.lit(warmup).alias("warmup"), F.count_if(F.col("n") > warmup).alias("usable"), F.count("*").alias("bars"))


@query()
def redundant_pairs(spark, sf_dir):
    """Pairs of features that correlate by nine tenths or more, with the sign."""
    x = studies.redundant_pairs(studies.correlations(frame(spark, sf_dir), list(ROUNDED)), 0.9)
    return rounded(x, "r", digits=4)
