"""SQL of features, lifecycle, targets and bands, and of the queries over them: plain windows and recursive walks, row after row."""

from __future__ import annotations

from tidemark.queries import CHANNEL, DAILY, EMA, PATTERN, POSITION, RESOLVED, TRADES, ema_sql
from tidemark.queries import ORACLE_SQL as BATCH

W = "(PARTITION BY series ORDER BY ts)"


def frame_sql(fast: int, slow: int, atr: int, span: int, rank: int, vol: int) -> str:
    """CTEs up to `frame`: the features of the daily bars, raw, and `n`, the number of each bar."""
    over = lambda k: f"(PARTITION BY series ORDER BY ts ROWS {k - 1} PRECEDING)"
    share = lambda x, ready: f"CASE WHEN {ready} AND count({x}) OVER {over(rank)} = {rank} THEN (len(list_filter(list({x}) OVER {over(rank)}, lambda q: q < {x})) + (len(list_filter(list({x}) OVER {over(rank)}, lambda q: q = {x})) + 1) / 2) / {rank} END"
    return f"""{DAILY}, {EMA}, {ema_sql(fast, 'e_fast')}, {ema_sql(slow, 'e_slow')},
f0 AS (SELECT *, row_number() OVER {W} AS n, ln(close) AS y, greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})) / close AS trc, abs(close - lag(close) OVER {W}) AS step, ln(close) - ln(lag(close) OVER {W}) AS lr, abs(close - lag(close, {span}) OVER {W}) AS net FROM bars),
f1 AS (SELECT *, avg(trc) OVER {over(atr)} AS trf, avg(trc) OVER {over(span)} AS trs, sum(step) OVER {over(span)} AS path, stddev_samp(y) OVER {over(span)} AS sd, covar_samp(y, n) OVER {over(span)} AS cv, CASE WHEN n > {vol} THEN stddev_samp(lr) OVER {over(vol)} END AS rv FROM f0),
f2 AS (SELECT f1.*, CASE WHEN n > {5 * max(fast, slow)} THEN tanh(CASE WHEN trf = 0 THEN 0 ELSE (a.v - b.v) / close / trf END / sqrt({abs(slow - fast)} / 2)) END AS direction, CASE WHEN n > {span} THEN CASE WHEN path = 0 THEN 0 ELSE net / path END END AS strength,
  CASE WHEN sd = 0 THEN 0 ELSE least(greatest(cv * cv / ({span} * {span + 1} / 12 * sd * sd), 0), 1) END AS r2 FROM f1 JOIN e_fast a ON a.series = f1.series AND a.ts = f1.ts JOIN e_slow b ON b.series = f1.series AND b.ts = f1.ts),
f3 AS (SELECT *, CASE WHEN n > {span} THEN r2 END AS persistence, CASE WHEN n > {span} THEN 1 - CASE WHEN trs = 0 THEN 0 ELSE least(greatest(sd * sqrt(1 - r2) / (trs * sqrt({span})), 0), 1) END END AS stability FROM f2),
frame AS MATERIALIZED (SELECT series, ts, open, high, low, close, volume, n, direction, strength, persistence, stability, {share('rv', f'n > {vol + rank - 1}')} AS energy, {share('volume', f'n > {rank}')} AS participation, {share('strength', 'true')} AS strength_rank, {share('stability', 'true')} AS stability_rank FROM f3)"""


#: The lifecycle's inputs with the windows of the test tables, its bits and its walk with loose thresholds, row after row.
FRAME = f"""{frame_sql(12, 48, 12, 48, 96, 12)},
machine AS MATERIALIZED (SELECT series, ts, open, high, low, close, volume, n, direction, strength_rank AS strength, stability_rank AS stability, 0.5 AS crowding, energy FROM frame)"""


def walk_sql(source: str = "machine", name: str = "states", walk: str = "walk") -> str:
    """CTEs: the walk over a table (series, ts, n from 1 without gaps, direction, strength, stability, energy)."""
    return f"""{walk}_bits AS MATERIALIZED (SELECT series, ts, n, coalesce(strength >= 0.5 AND abs(direction) >= 0.02 AND energy <= 1.0, false) AS adv, direction IS NULL OR strength IS NULL OR stability IS NULL OR energy IS NULL OR strength < 0.25 OR coalesce(stability < 0.05, false) AS weak, CASE WHEN direction >= 0.02 THEN 1 WHEN direction <= -0.02 THEN -1 ELSE 0 END AS lean, coalesce(direction > 0, false) AS up FROM {source}),
{walk} AS (
  SELECT DISTINCT series, CAST(0 AS BIGINT) AS n, 'compression' AS state, 0 AS age, 0 AS streak, 0 AS side FROM {source}
  UNION ALL
  SELECT series, n, state, CASE WHEN state = was THEN least(age + 1, 4) ELSE 1 END, streak, CASE WHEN state = was THEN side WHEN state = 'breakout' THEN CASE WHEN up THEN 1 ELSE -1 END WHEN state IN ('reset', 'compression') THEN 0 ELSE side END FROM (
    SELECT *, CASE WHEN was = 'compression' THEN CASE WHEN age >= 2 AND streak = 2 AND NOT weak THEN 'breakout' ELSE was END
      WHEN was IN ('breakout', 'confirmed') THEN CASE WHEN weak OR side * lean < 0 THEN 'reset' WHEN age >= 2 AND streak = 2 THEN CASE was WHEN 'breakout' THEN 'confirmed' ELSE 'riding' END WHEN streak = -2 THEN 'reset' ELSE was END
      WHEN was = 'riding' THEN CASE WHEN weak OR side * lean < 0 THEN 'reset' WHEN NOT adv THEN 'exhaustion' ELSE was END
      WHEN was = 'exhaustion' THEN CASE WHEN weak OR side * lean < 0 OR age >= 4 THEN 'reset' ELSE was END
      ELSE CASE WHEN age >= 3 THEN 'compression' ELSE was END END AS state FROM (
      SELECT w.series, b.n, w.state AS was, w.age, w.side, CASE WHEN b.adv THEN least(greatest(w.streak, 0) + 1, 2) ELSE greatest(least(w.streak, 0) - 1, -2) END AS streak, b.adv, b.weak, b.lean, b.up
      FROM {walk} w JOIN {walk}_bits b ON b.series = w.series AND b.n = w.n + 1)
  )
), {name} AS MATERIALIZED (SELECT m.*, w.state FROM {source} m JOIN {walk} w ON w.series = m.series AND w.n = m.n)"""


STATES = f"{FRAME}, {walk_sql()}"
TARGETS = """targets AS MATERIALIZED (SELECT *, CASE WHEN direction IS NOT NULL AND strength IS NOT NULL AND strength >= 1 / 3 AND direction <> 0 THEN sign(direction) * CASE WHEN strength >= 2 / 3 THEN 1 ELSE -1 END * CASE state WHEN 'breakout' THEN 0.35 WHEN 'confirmed' THEN 0.7 WHEN 'riding' THEN 1.0 WHEN 'exhaustion' THEN 0.55 ELSE 0 END ELSE 0 END AS target FROM states)"""


def band_sql(threshold: float, warmup: int = 0) -> str:
    return f"""band AS (
  SELECT DISTINCT series, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS held, CAST(NULL AS DOUBLE) AS submitted, CAST(0 AS DOUBLE) AS before FROM targets
  UNION ALL
  SELECT b.series, t.n, CASE WHEN abs(t.x - b.held) >= {threshold} THEN t.x ELSE b.held END, CASE WHEN abs(t.x - b.held) >= {threshold} THEN t.x END, b.held FROM band b JOIN (SELECT series, n, CAST(CASE WHEN n > {warmup} THEN target ELSE 0 END AS DOUBLE) AS x FROM targets) t ON t.series = b.series AND t.n = b.n + 1
), banded AS (SELECT t.*, b.submitted, b.before FROM targets t JOIN band b ON b.series = t.series AND b.n = t.n)"""


BANDED = band_sql(0.1, 200)
SIDES = f"""sided AS (SELECT *, coalesce(lag(side) OVER {W}, 0) AS before FROM (SELECT *, sign(target) AS side FROM targets)),
events AS (SELECT *, side <> before AND side > 0 AS long_entry, side <> before AND before > 0 AS long_exit, side <> before AND side < 0 AS short_entry, side <> before AND before < 0 AS short_exit FROM sided)"""
CHANGES = f"""changes AS (SELECT *, n - lag(n) OVER {W} AS dwell FROM (SELECT series, ts, n, state, lag(state) OVER {W} AS before FROM states) WHERE before IS NULL OR before <> state)"""
FEATURES = ("direction", "strength", "persistence", "stability", "energy", "compression", "compression_release", "participation")
WIDE = f"""{frame_sql(24, 96, 24, 96, 480, 24)},
wide AS (SELECT *, 1 - energy AS compression, CASE WHEN n > 504 THEN -((1 - energy) - lag(1 - energy) OVER {W}) END AS compression_release FROM frame)"""

ORACLE_SQL = {
    "feature_frame": f"WITH {WIDE} SELECT series, ts, close, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURES)} FROM wide",
    "lifecycle_states": f"WITH RECURSIVE {STATES} SELECT series, ts, state FROM states",
    "streamed_lifecycle": f"WITH RECURSIVE {STATES} SELECT series, ts, state FROM states",
    "state_occupancy": f"WITH RECURSIVE {STATES} SELECT series, state, count(*) AS bars, round(count(*) / sum(count(*)) OVER (PARTITION BY series), 6) AS share FROM states GROUP BY series, state",
    "state_transitions": f"WITH RECURSIVE {STATES}, {CHANGES} SELECT series, ts, before AS from_state, state AS to_state, CAST(dwell AS BIGINT) AS dwell, n <= 200 AS in_warmup FROM changes WHERE before IS NOT NULL",
    "transition_audit": f"""WITH RECURSIVE {STATES}, {CHANGES}, legal AS (SELECT * FROM (VALUES ('compression', 'breakout'), ('breakout', 'confirmed'), ('breakout', 'reset'), ('confirmed', 'riding'), ('confirmed', 'reset'), ('riding', 'exhaustion'), ('riding', 'reset'), ('exhaustion', 'reset'), ('reset', 'compression')) t(a, z))
SELECT series, count(*) AS changes, CAST((SELECT count(*) FROM changes c WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM legal WHERE a = c.before AND z = c.state)) AS BIGINT) AS illegal FROM changes WHERE before IS NOT NULL GROUP BY series""",
    "lifecycle_targets": f"WITH RECURSIVE {STATES}, {TARGETS} SELECT series, ts, state, round(target, 6) AS target FROM targets",
    "side_change_events": f"WITH RECURSIVE {STATES}, {TARGETS}, {SIDES} SELECT series, ts, long_entry, long_exit, short_entry, short_exit, round(abs(target), 6) AS size FROM events WHERE side <> before",
    "state_machine_v1": f"WITH RECURSIVE {STATES}, {TARGETS}, {SIDES} SELECT series, ts, long_entry AND n > 200 AS long_entry, long_exit AND n > 200 AS long_exit, short_entry AND n > 200 AS short_entry, short_exit AND n > 200 AS short_exit FROM events",
    "state_machine_v2": f"WITH RECURSIVE {STATES}, {TARGETS} SELECT series, ts, round(CASE WHEN n > 200 THEN target ELSE 0 END, 6) AS target FROM targets",
    "target_orders": f"""WITH RECURSIVE {STATES}, {TARGETS}, {band_sql(0.1)}, d AS (SELECT *, coalesce(last_value(submitted * 9500.0 / close IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS desired FROM banded),
o AS (SELECT *, desired - coalesce(lag(desired) OVER {W}, 0) AS o FROM d) SELECT series, ts, round(target, 6) AS target, round(submitted, 6) AS submitted, round(desired, 6) AS desired, round(o, 6) AS "order", round(desired * close / 10000.0, 6) AS position_fraction FROM o WHERE o <> 0""",
    "state_view": f"WITH RECURSIVE {STATES} SELECT series, ts, state, {', '.join(f'round({c}, 6) AS {c}' for c in ('direction', 'strength', 'stability', 'energy'))} FROM states",
    "convergence_audit": f"""WITH RECURSIVE {STATES}, late AS MATERIALIZED (SELECT * REPLACE (row_number() OVER {W} AS n) FROM machine WHERE ts >= TIMESTAMP '1997-01-01'), {walk_sql('late', 'cold', 'cold_walk')}
SELECT a.series, count(*) AS bars, CAST(count_if(a.state <> b.state) AS BIGINT) AS differing FROM states a JOIN cold b ON a.series = b.series AND a.ts = b.ts WHERE a.ts >= TIMESTAMP '1998-01-01' GROUP BY a.series""",
}

# studies over the feature frame ---------------------------------------------------------------------------------------------

#: The wide frame with halves, the forward efficiency of 16 bars, its tercile cuts of the training half, and three gates.
GATED = f"""{WIDE}, halved AS MATERIALIZED (SELECT *, CASE WHEN n <= floor(count(*) OVER (PARTITION BY series) * 0.6) THEN 'train' ELSE 'test' END AS half FROM wide),
l0 AS (SELECT *, abs(close - lag(close) OVER {W}) AS d, lead(close) OVER {W} AS c1, lead(close, 17) OVER {W} AS c17 FROM halved),
l1 AS (SELECT *, CASE WHEN count(d) OVER v = 16 AND sum(d) OVER v > 0 THEN abs(c17 - c1) / sum(d) OVER v END AS fer FROM l0 WINDOW v AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 2 FOLLOWING AND 17 FOLLOWING)),
cuts AS (SELECT series, quantile_cont(fer, 2 / 3) AS top FROM l1 WHERE half = 'train' GROUP BY series),
gated AS MATERIALIZED (SELECT l1.*, CASE WHEN fer IS NOT NULL THEN fer >= top END AS trending, energy <= 0.4 AS calm, strength >= 0.15 AS strong, energy <= 0.4 AND strength >= 0.15 AS both_gates, row_number() OVER (PARTITION BY series, half ORDER BY ts DESC) AS back FROM l1 JOIN cuts USING (series))"""


def rates_sql(gate: str, source: str = "gated") -> str:
    """series, half (and full), bars and the rates inside and outside a gate."""
    one = f"""SELECT series, {{half}} AS half, count(*) AS bars, avg(CAST(trending AS INT)) AS base_rate, avg(CASE WHEN {gate} THEN CAST(trending AS INT) END) AS inside_rate, avg(CASE WHEN NOT {gate} THEN CAST(trending AS INT) END) AS outside_rate, avg(CAST({gate} AS INT)) AS coverage FROM {source} WHERE trending IS NOT NULL AND {gate} IS NOT NULL GROUP BY series{{by}}"""
    return one.format(half="half", by=", half") + " UNION ALL " + one.format(half="'full'", by="")


PAIRS = f"{WIDE}, pairs AS (" + " UNION ALL ".join(f"SELECT series, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM wide GROUP BY series" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]) + ")"
SIGNALS = ("turnaround_v1", "turnaround_v2", "sma_pullback", "trend_rider", "tsmom", "ema_cross", "donchian", "multi_horizon")
ORACLE_SQL |= {
    "all_signals": " UNION ALL ".join(f"SELECT series, '{n}' AS strategy, {', '.join(f'CAST(count_if({c}) AS BIGINT) AS {c}s' for c in ('long_entry', 'long_exit', 'short_entry', 'short_exit'))} FROM ({BATCH[n].replace('n > 100', 'n > 400') if n == 'turnaround_v1' else BATCH[n]}) GROUP BY series" for n in SIGNALS),
    "lift_table": f"WITH {GATED}, r AS ({rates_sql('calm')}) SELECT series, half, bars, round(base_rate, 6) AS base_rate, round(inside_rate, 6) AS inside_rate, round(outside_rate, 6) AS outside_rate, round(coverage, 6) AS coverage, round((inside_rate - base_rate) * 100, 6) AS lift_pp, round((inside_rate - outside_rate) * 100, 6) AS separation_pp FROM r",
    "embargo_change": f"WITH {GATED}, kept AS (SELECT * FROM gated WHERE half = 'test' OR back > 17), a AS ({rates_sql('calm')}), c AS ({rates_sql('calm', 'kept')}) SELECT series, half, a.bars, round((a.inside_rate - a.base_rate) * 100, 6) AS lift_pp, c.bars AS bars_kept, round((c.inside_rate - c.base_rate) * 100, 6) AS lift_kept FROM a JOIN c USING (series, half)",
    "gate_verdicts": f"""WITH {GATED}, s AS (SELECT *, 'calm' AS gate FROM ({rates_sql('calm')}) UNION ALL SELECT *, 'strong' FROM ({rates_sql('strong')})), b AS ({rates_sql('both_gates')}),
g AS (SELECT s.series, s.gate, (b.inside_rate - s.inside_rate) * 100 AS gap FROM s JOIN b USING (series, half) WHERE half <> 'full'), v AS (SELECT gate, bool_and(coalesce(inside_rate - base_rate > 0, false)) AS all_positive, avg((inside_rate - base_rate) * 100) AS mean_lift FROM s WHERE half <> 'full' GROUP BY gate)
SELECT gate, series, round(min(gap), 6) AS least_gap_pp, bool_and(gap >= 0) AS both_halves, any_value(all_positive) AS all_positive, round(any_value(mean_lift), 6) AS mean_lift, any_value(all_positive AND mean_lift >= 1) AS passes FROM g JOIN v USING (gate) GROUP BY gate, series""",
    "coverage_threshold": f"""WITH {GATED}, c AS (SELECT series, quantile_cont(energy, 0.25) AS enter, quantile_cont(energy, 0.5) AS leave FROM halved WHERE half = 'train' GROUP BY series)
SELECT h.series, round(enter, 6) AS enter, round(leave, 6) AS leave, round(avg(CASE WHEN half = 'train' THEN CAST(energy <= enter AS INT) END), 6) AS train_coverage, round(avg(CASE WHEN half = 'test' THEN CAST(energy <= enter AS INT) END), 6) AS test_coverage FROM halved h JOIN c USING (series) WHERE energy IS NOT NULL GROUP BY h.series, enter, leave""",
    "persistence_rows": f"""WITH {WIDE}, f AS (SELECT series, ts, n, energy <= 0.4 AS g, CAST(energy <= 0.4 AS INT) AS x, lag(CAST(energy <= 0.4 AS INT)) OVER {W} AS p FROM wide),
i AS (SELECT *, n - sum(CASE WHEN g THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM f), r AS (SELECT series, island, count(*) AS length FROM i WHERE g GROUP BY series, island),
q AS (SELECT series, count(*) AS runs, round(quantile_cont(length, 0.25), 6) AS p25, round(quantile_cont(length, 0.5), 6) AS median, round(quantile_cont(length, 0.75), 6) AS p75, round(avg(length), 6) AS mean, max(length) AS longest FROM r GROUP BY series)
SELECT s.series, s.share, s.autocorrelation, runs, p25, median, p75, mean, longest FROM (SELECT series, round(avg(x), 6) AS share, round(corr(x, p), 6) AS autocorrelation FROM f GROUP BY series) s LEFT JOIN q USING (series)""",
    "redundant_pairs": f"WITH {PAIRS} SELECT series, a, b, round(r, 4) AS r FROM pairs WHERE abs(r) >= 0.9",
    "closest_partner": f"WITH {PAIRS}, both_ways AS (SELECT series, a AS feature, b AS partner, r FROM pairs UNION ALL SELECT series, b, a, r FROM pairs), m AS (SELECT *, row_number() OVER (PARTITION BY series, feature ORDER BY round(abs(r), 9) DESC, partner DESC) AS k FROM both_ways WHERE r IS NOT NULL AND NOT isnan(r)) SELECT series, feature, partner, round(r, 6) AS r, abs(r) >= 0.9 AS redundant FROM m WHERE k = 1",
    "exit_modes": f"""WITH {DAILY}, {PATTERN}, {EMA}, {ema_sql(50, 'e')}, s AS (SELECT f.series, f.ts, up AND n > 100 AS sx, false AS lx, f.close < e.v AS below, f.close > e.v AS above, f.close - lag(f.close) OVER (PARTITION BY f.series ORDER BY f.ts) AS d, f.close < avg(f.close) OVER (PARTITION BY f.series ORDER BY f.ts ROWS 39 PRECEDING) AND n >= 40 AS broken FROM f JOIN e ON e.series = f.series AND e.ts = f.ts),
t AS (SELECT *, sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) OVER v = 3 AS falls, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) OVER v = 3 AS rises FROM s WINDOW v AS (PARTITION BY series ORDER BY ts ROWS 2 PRECEDING)),
m AS (SELECT series, lx, sx, 'opposite_signal_only' AS mode, false AS more FROM t UNION ALL SELECT series, lx, sx, 'continuation_failure', (falls AND NOT lx) OR (rises AND NOT sx) FROM t UNION ALL SELECT series, lx, sx, 'trend_failure', (below AND NOT lx) OR (above AND NOT sx) FROM t UNION ALL SELECT series, lx, sx, 'trend_structure', (broken OR falls) AND NOT lx FROM t)
SELECT series, mode, CAST(count_if(more) AS BIGINT) AS added, CAST(count_if(lx OR sx) AS BIGINT) AS own FROM m GROUP BY series, mode""",
    "cost_waterfall": f"""WITH {DAILY}, {CHANNEL}, {RESOLVED}, {POSITION}, {TRADES}, free AS (SELECT series, sum(held * quantity * (exit_close - close)) AS gross FROM (SELECT *, 9500.0 / close AS quantity FROM ev WHERE held <> 0 AND exit_ts IS NOT NULL) GROUP BY series),
c AS (SELECT series, multiple, held, close, exit_close, 9500.0 / close AS q, close * (1 + held * 0.0002 * multiple) AS a, exit_close * (1 - held * 0.0002 * multiple) AS z FROM ev, (VALUES (1.0), (2.0), (4.0)) m(multiple) WHERE held <> 0 AND exit_ts IS NOT NULL),
s AS (SELECT series, CAST(multiple AS DOUBLE) AS multiple, sum(held * q * (z - a) - 0.0006 * multiple * q * (a + z)) AS net, sum(0.0006 * multiple * q * (a + z)) AS fees, sum(q * (abs(a - close) + abs(z - exit_close))) AS slip FROM c GROUP BY series, multiple)
SELECT series, multiple, round(gross / 10000.0, 4) AS gross_return, round(fees, 4) AS fees, round(slip, 4) AS slippage, 0.0 AS funding, round(gross - net - fees - slip, 4) AS size_effect, round(net / 10000.0, 4) AS net_return FROM s JOIN free USING (series)""",
    "reason_diff": f"""WITH {WIDE}, a AS (SELECT series, ts, unnest(['strength', 'energy']) AS name, unnest([strength, energy]) AS x FROM wide), b AS (SELECT series, ts, name, CASE WHEN name = 'strength' AND day(ts) = 3 THEN x + 0.5 ELSE x END AS y FROM a WHERE year(ts) <> 1997)
SELECT a.series, a.name, CASE WHEN b.series IS NULL THEN 'only in a' ELSE 'value' END AS difference, count(*) AS bars FROM a LEFT JOIN b ON a.series = b.series AND a.ts = b.ts AND a.name = b.name WHERE b.series IS NULL OR (x IS NOT NULL AND abs(x - y) > 1e-9) GROUP BY ALL""",
}

# parameter surfaces -----------------------------------------------------------------------------------------------------------

CELLS = [(i, e, x) for i, (e, x) in enumerate((e, x) for e in (20, 40, 80) for x in (10, 20, 40))]
_EDGES = ", ".join(f"CASE WHEN n > {k} THEN max(high) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) END AS hi{k}, CASE WHEN n > {k} THEN min(low) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) END AS lo{k}" for k in (10, 20, 40, 80))
_FLAGS = " UNION ALL ".join(f"SELECT series || '|{i}|{e}|{x}' AS series, ts, close, n, coalesce(close > hi{e}, false) AS long_entry, coalesce(close < lo{x}, false) AS long_exit, coalesce(close < lo{e}, false) AS short_entry, coalesce(close > hi{x}, false) AS short_exit FROM edges" for i, e, x in CELLS)
_NAMES = "split_part(series, '|', 1) AS series, CAST(split_part(series, '|', 2) AS INTEGER) AS cell, CAST(split_part(series, '|', 3) AS INTEGER) AS entry, CAST(split_part(series, '|', 4) AS INTEGER) AS leave"
#: Returns of all nine cells of the channel rule, a series named by its cell, and its evaluation after 80 bars.
SURFACE = f"""{DAILY}, edges AS (SELECT *, {_EDGES} FROM (SELECT *, row_number() OVER {W} AS n FROM bars)), sig AS ({_FLAGS}), {RESOLVED}, {POSITION},
lagged AS (SELECT series, ts, n, close, coalesce(lag(held) OVER {W}, 0) AS position, close / lag(close) OVER {W} - 1 AS change FROM pos),
ret AS MATERIALIZED (SELECT *, coalesce(change * position, 0) AS ret, coalesce(position <> lag(position) OVER {W}, false) AS moved FROM lagged)"""
POINTS = f"""{SURFACE}, grown AS (SELECT *, CASE WHEN max(CAST(ret <= -1 AS INT)) OVER u = 1 THEN 0 ELSE exp(sum(ln(1 + greatest(ret, -0.999999999999))) OVER u) END AS equity FROM ret WHERE n > 80 WINDOW u AS (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING)),
fallen AS (SELECT *, equity / greatest(max(equity) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING), 1) - 1 AS drawdown FROM grown),
points AS (SELECT {_NAMES}, arg_max(equity, ts) - 1 AS total_return, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(365.0) ELSE 0 END AS sharpe, min(drawdown) AS max_drawdown, CAST(count_if(moved) AS BIGINT) AS trades, count(*) AS bars FROM fallen GROUP BY fallen.series)"""
_SHARPE = "CASE WHEN {q} - {s} * {s} / {n} > 1e-18 THEN {s} / {n} / sqrt(({q} - {s} * {s} / {n}) / ({n} - 1)) * sqrt(365.0) ELSE 0 END"
FOLDS = f"""{SURFACE}, sums AS (SELECT series, CASE WHEN n <= 600 THEN -1 ELSE (n - 601) // 300 END AS fold, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS q, sum(ln(CASE WHEN ret > -1 THEN 1 + ret END)) AS g FROM ret GROUP BY ALL),
before AS (SELECT *, sum(n) OVER b AS bn, sum(s) OVER b AS bs, sum(q) OVER b AS bq FROM sums WINDOW b AS (PARTITION BY series ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
scored AS (SELECT {_NAMES}, fold, n, g, {_SHARPE.format(n='bn', s='bs', q='bq')} AS train_sharpe, {_SHARPE.format(n='n', s='s', q='q')} AS test_sharpe FROM before WHERE fold >= 0),
folds AS (SELECT series, CAST(fold AS INTEGER) AS fold, cell, train_sharpe, test_sharpe, n AS bars, exp(g) - 1 AS test_return FROM (SELECT *, row_number() OVER (PARTITION BY series, fold ORDER BY train_sharpe DESC, cell) AS k FROM scored) WHERE k = 1)"""

ORACLE_SQL |= {
    "parameter_surface": f"WITH {POINTS} SELECT series, cell, entry, leave, round(total_return, 6) AS total_return, round(sharpe, 6) AS sharpe, round(max_drawdown, 6) AS max_drawdown, trades, bars FROM points",
    "stability_score": f"""WITH {POINTS}, s AS (SELECT series, count(*) AS cells, avg(sharpe) * avg(CAST(sharpe > 0 AS INT)) / (1 + stddev_pop(sharpe)) AS stability FROM points GROUP BY series), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY round(sharpe, 9) DESC, cell) AS k FROM points) WHERE k = 1)
SELECT series, cells, round(stability, 6) AS stability, cell, entry, leave, round(sharpe, 6) AS sharpe, round(total_return, 6) AS total_return FROM s JOIN b USING (series)""",
    "surface_heat_map": f"WITH {POINTS} SELECT series, entry, {', '.join(f'round(max(CASE WHEN leave = {x} THEN sharpe END), 6) AS leave_{x}' for x in (10, 20, 40))} FROM points GROUP BY series, entry",
    "walk_forward": f"WITH {FOLDS} SELECT series, fold, cell, round(train_sharpe, 6) AS train_sharpe, round(test_sharpe, 6) AS test_sharpe, bars, round(test_return, 6) AS test_return FROM folds",
    "walk_forward_summary": f"WITH {FOLDS} SELECT series, count(*) AS folds, count(DISTINCT cell) AS winners, round(exp(sum(ln(1 + test_return))) - 1, 6) AS oos_return, round(avg(test_sharpe), 6) AS mean_test_sharpe FROM folds GROUP BY series",
    "perturbation": f"""WITH {SURFACE}, parts AS (SELECT *, ts < TIMESTAMP '1999-01-01' AS train FROM ret), ev AS (SELECT {_NAMES}, train, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(365.0) ELSE 0 END AS sharpe FROM parts WHERE NOT train OR n > 80 GROUP BY parts.series, train),
r AS (SELECT *, dense_rank() OVER (PARTITION BY series ORDER BY entry) AS i, dense_rank() OVER (PARTITION BY series ORDER BY leave) AS j FROM ev WHERE train), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY sharpe DESC, cell) AS k FROM r) WHERE k = 1)
SELECT r.series, r.cell, r.entry, r.leave, round(r.sharpe, 6) AS train_sharpe, round(t.sharpe, 6) AS test_sharpe FROM r JOIN w ON w.series = r.series AND abs(r.i - w.i) + abs(r.j - w.j) <= 1 JOIN ev t ON t.series = r.series AND t.cell = r.cell AND NOT t.train""",
}
_NEUTRAL = " UNION ALL ".join(f"SELECT series || '|{d}' AS series, ts, n, direction, {', '.join(f'CASE WHEN {c} IS NOT NULL THEN 0.5 END AS {c}' if c == d else c for c in ('strength', 'stability', 'energy'))} FROM machine" for d in ("", "strength", "stability", "energy"))
ORACLE_SQL["feature_dropout"] = f"""WITH RECURSIVE {FRAME}, dropped AS MATERIALIZED ({_NEUTRAL}), {walk_sql('dropped', 'dropped_states', 'dropped_walk')}
SELECT split_part(series, '|', 1) AS series, split_part(series, '|', 2) AS dropped, state, count(*) AS bars, round(count(*) / sum(count(*)) OVER (PARTITION BY dropped_states.series), 6) AS share FROM dropped_states GROUP BY dropped_states.series, state"""
