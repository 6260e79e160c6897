"""Studies about features, signals and parameters: information coefficients, lift, surfaces, walk-forward, deflated Sharpe."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import windows as k
from tidemark.functions.times import SHARPE_DAYS
from tidemark.operators import ledger

MIN_PAIRS = 30
HALVES_FLOOR = 0.01
#: Sharpe ratios on the surface count 365 days a year; these are daily bars.
BARS_PER_YEAR = SHARPE_DAYS


# labels ------------------------------------------------------------------------------------------------------------------


def forward_return(h: int, close: str = "close") -> Column:
    """Return from the next bar over h bars; NULL in the last h + 1 rows."""
    if h < 1:
        raise ValueError("horizon must be 1 at least")
    w = k.series_window()
    return F.try_divide(F.lead(close, h + 1).over(w), F.lead(close, 1).over(w)) - 1


def forward_efficiency(h: int, step: str = "step") -> Column:
    """Net move over path length of the h bars after the next one; needs the column step (absolute change). 0/0 is NULL."""
    w = k.series_window()
    ahead = w.rowsBetween(2, h + 1)
    net = F.abs(F.lead("close", h + 1).over(w) - F.lead("close", 1).over(w))
    path = F.when(F.count(step).over(ahead) == h, F.sum(step).over(ahead))
    return F.when(path > 0, net / path)


def with_labels(frame: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    x = frame.withColumn("step", F.abs(F.col("close") - k.lag("close")))
    return x.withColumns({**{f"fwd_{h}": forward_return(h) for h in horizons}, **{f"fer_{h}": forward_efficiency(h) for h in horizons}}).drop("step")


def label_anchor_audit(bars: DataFrame, h: int, cut: Column) -> DataFrame:
    """For each series how many labels before `cut` moved when all rows up to it were altered, and whether the one at it did not move with the next row."""
    x = with_labels(bars, (h,)).select("series", "ts", F.col(f"fer_{h}").alias("a"))
    poisoned = bars.withColumn("close", F.when(F.col("ts") <= cut, F.lit(1e6) + F.hash("ts") % 97).otherwise(F.col("close")))
    y = with_labels(poisoned, (h,)).select("series", "ts", F.col(f"fer_{h}").alias("b"))
    both = x.join(y, ["series", "ts"]).where(F.col("ts") >= cut)
    return both.groupBy("series").agg(F.count("*").alias("labels"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("moved"))


# information coefficients ------------------------------------------------------------------------------------------------


def long_pairs(frame: DataFrame, features: list[str], horizons: tuple[int, ...], label: str = "fwd") -> DataFrame:
    """series, ts, feature, horizon, x, y of the pairs where both are known."""
    x = frame.select("series", "ts", *features, *[f"{label}_{h}" for h in horizons])
    x = x.unpivot(["series", "ts", *[f"{label}_{h}" for h in horizons]], features, "feature", "x")
    x = x.unpivot(["series", "ts", "feature", "x"], [f"{label}_{h}" for h in horizons], "horizon", "y")
    return x.where("x is not null and y is not null").withColumn("horizon", F.regexp_extract("horizon", "([0-9]+)$", 1).cast("int"))


def average_rank(by: list[str], x: str) -> Column:
    """Rank with ties at their average."""
    return F.rank().over(W.partitionBy(*by).orderBy(x)) + (F.count("*").over(W.partitionBy(*by, x)) - 1) / 2


def rank_ic(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Spearman correlation of x and y in each group; NULL with fewer than MIN_PAIRS pairs or a constant side."""
    r = pairs.withColumns({"rx": average_rank(by, "x"), "ry": average_rank(by, "y")})
    a = r.groupBy(*by).agg(F.count("*").alias("pairs"), F.corr("rx", "ry").alias("c"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"))
    return a.select(*by, "pairs", F.when((F.col("pairs") >= MIN_PAIRS) & (F.col("sx") > 0) & (F.col("sy") > 0), F.col("c")).alias("ic"))


def split_half_ic(pairs: DataFrame, by: list[str]) -> DataFrame:
    """IC of all pairs and of the first and second half of them in time, and whether the halves agree."""
    w = W.partitionBy(*by).orderBy("ts")
    half = F.when(F.row_number().over(w) <= F.floor(F.count("*").over(W.partitionBy(*by)) / 2), 1).otherwise(2)
    cut = rank_ic(pairs.withColumn("half", half), [*by, "half"]).groupBy(*by).agg(F.max(F.when(F.col("half") == 1, F.col("ic"))).alias("ic_first"), F.max(F.when(F.col("half") == 2, F.col("ic"))).alias("ic_second"))
    agree = (F.signum("ic_first") == F.signum("ic_second")) & (F.least(F.abs("ic_first"), F.abs("ic_second")) >= HALVES_FLOOR)
    return rank_ic(pairs, by).join(cut, by).withColumn("halves_agree", F.coalesce(agree, F.lit(False)))


def feature_diagnostics(frame: DataFrame, features: list[str]) -> DataFrame:
    """Coverage, quartiles, lag-1 autocorrelation and turnover (mean absolute change) of each feature of each series."""
    x = frame.unpivot(["series", "ts"], features, "feature", "x")
    before = F.lag("x").over(W.partitionBy("series", "feature").orderBy("ts"))
    x = x.withColumn("p", before)
    q = lambda v: F.percentile("x", F.lit(v))
    a = x.groupBy("series", "feature").agg(
        (F.count("x") / F.count("*")).alias("coverage"), F.min("x").alias("least"), q(0.5).alias("median"), F.max("x").alias("most"), (q(0.75) - q(0.25)).alias("iqr"),
        F.corr("x", "p").alias("autocorrelation"), F.avg(F.abs(F.col("x") - F.col("p"))).alias("turnover"),
    )
    return a


def correlations(frame: DataFrame, features: list[str]) -> DataFrame:
    """series, a, b, r for each pair of features (a before b), over the rows where both are known; one aggregation."""
    pairs = list(itertools.combinations(features, 2))
    a = frame.groupBy("series").agg(*[F.corr(x, y).alias(f"{x}|{y}") for x, y in pairs])
    long = a.unpivot(["series"], [f"`{x}|{y}`" for x, y in pairs], "pair", "r")
    return long.select("series", F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "r")


def closest_partner(r: DataFrame) -> DataFrame:
    """For each feature the one it correlates with most, and the signed correlation; of those alike to nine digits the last by name."""
    both = r.select("series", F.col("a").alias("feature"), F.col("b").alias("partner"), "r").unionByName(r.select("series", F.col("b").alias("feature"), F.col("a").alias("partner"), "r"))
    best = F.max_by(F.struct("partner", "r"), F.struct(F.round(F.abs("r"), 9), F.col("partner")))
    return both.where("r is not null").groupBy("series", "feature").agg(best.alias("m")).select("series", "feature", "m.partner", "m.r")


def redundant_pairs(r: DataFrame, least: float = 0.9) -> DataFrame:
    return r.where(F.abs("r") >= least).orderBy("series", F.desc(F.abs("r")), "a", "b")


def ic_verdict(ics: DataFrame, bar: float = 0.10, weak: float = 0.05) -> DataFrame:
    """passes and the reasons against, from ic, ic_first, ic_second and halves_agree."""
    low = F.least(F.abs("ic_first"), F.abs("ic_second"))
    why = F.concat_ws("; ", F.when(F.col("ic").isNull() | (F.abs("ic") < bar), f"|IC| below {bar}"), F.when(~F.col("halves_agree"), "halves disagree"), F.when(low.isNull() | (low < weak), f"weaker half below {weak}"))
    return ics.withColumn("reasons", why).withColumn("passes", F.col("reasons") == "")


# splits, gates and lift ---------------------------------------------------------------------------------------------------


def with_half(frame: DataFrame, share: float = 0.6) -> DataFrame:
    """half: train for the first share of each series' bars, then test."""
    n = F.count("*").over(W.partitionBy("series"))
    return frame.withColumn("half", F.when(F.row_number().over(k.series_window()) <= F.floor(n * share), "train").otherwise("test"))


def embargoed(frame: DataFrame, h: int) -> DataFrame:
    """Rows whose label doesn't reach over the split: the last h + 1 training rows are dropped."""
    back = F.row_number().over(W.partitionBy("series", "half").orderBy(F.desc("ts")))
    return frame.withColumn("_back", back).where((F.col("half") == "test") | (F.col("_back") > h + 1)).drop("_back")


def trend_label(frame: DataFrame, label: str) -> DataFrame:
    """trending: whether the label lies in the training half's top tercile; NULL where the label is."""
    cuts = frame.where("half = 'train'").groupBy("series").agg(F.percentile(label, F.lit(1 / 3)).alias("cut_low"), F.percentile(label, F.lit(2 / 3)).alias("cut_high"))
    x = frame.join(cuts, "series", "left")
    return x.withColumn("trending", F.when(F.col(label).isNotNull(), F.col(label) >= F.col("cut_high"))).withColumn("tercile", F.when(F.col(label) <= F.col("cut_low"), 1).when(F.col(label) <= F.col("cut_high"), 2).when(F.col(label).isNotNull(), 3))


def rate_table(frame: DataFrame, gate: str, label: str = "trending") -> DataFrame:
    """series, half (full, train, test): base rate, rate inside the gate, coverage and lift in points; one pass by grouping sets."""
    known = frame.where(F.col(label).isNotNull() & F.col(gate).isNotNull())
    y, g = F.col(label).cast("double"), F.col(gate)
    a = known.rollup("series", "half").agg(F.count("*").alias("bars"), F.avg(y).alias("base_rate"), F.avg(F.when(g, y)).alias("inside_rate"), F.avg(F.when(~g, y)).alias("outside_rate"), F.avg(g.cast("double")).alias("coverage"), F.grouping("half").alias("_all"), F.grouping("series").alias("_every"))
    a = a.where("_every = 0").withColumn("half", F.when(F.col("_all") == 1, "full").otherwise(F.col("half")))
    return a.select("series", "half", "bars", "base_rate", "inside_rate", "outside_rate", "coverage", ((F.col("inside_rate") - F.col("base_rate")) * 100).alias("lift_pp"), ((F.col("inside_rate") - F.col("outside_rate")) * 100).alias("separation_pp"))


def coverage_threshold(frame: DataFrame, feature: str, coverage: float, low_side: bool = True) -> DataFrame:
    """Threshold that admits the share of training rows, what it admits in each half, and the exit threshold at twice the share."""
    p, p2 = (coverage, min(1.0, 2 * coverage)) if low_side else (1 - coverage, max(0.0, 1 - 2 * coverage))
    cut = frame.where("half = 'train'").groupBy("series").agg(F.percentile(feature, F.lit(p)).alias("enter"), F.percentile(feature, F.lit(p2)).alias("leave"))
    x = frame.where(F.col(feature).isNotNull()).join(cut, "series")
    inside = F.col(feature) <= F.col("enter") if low_side else F.col(feature) >= F.col("enter")
    return x.groupBy("series", "enter", "leave").agg(*[F.avg(F.when(F.col("half") == h, inside.cast("double"))).alias(f"{h}_coverage") for h in ("train", "test")])


def conditional_ic(pairs: DataFrame, by: list[str], condition: str, parts: int = 3) -> DataFrame:
    """IC of x and y inside equal shares of the condition, with right-closed edges at its exact quantiles."""
    edges = pairs.groupBy(*by).agg(F.percentile(condition, F.array(*[F.lit(i / parts) for i in range(1, parts)])).alias("_e"))
    x = pairs.join(edges, by)
    bucket = F.size(F.filter("_e", lambda e: F.col(condition) > e)) + 1
    return split_half_ic(x.withColumn("bucket", bucket), [*by, "bucket"])


def persistence(flags: DataFrame, flag: str) -> DataFrame:
    """Runs of a flag: how many, their median, mean, quartiles and longest, its share and lag-1 autocorrelation."""
    from tidemark.operators.lifecycle import run_lengths

    runs = run_lengths(flags, flag).groupBy("series").agg(F.count("*").alias("runs"), *[F.percentile("length", F.lit(p)).alias(n) for n, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))], F.avg("length").alias("mean"), F.max("length").alias("longest"))
    x = flags.withColumn("_x", F.col(flag).cast("double")).withColumn("_p", k.lag("_x"))
    return x.groupBy("series").agg(F.avg("_x").alias("share"), F.corr("_x", "_p").alias("autocorrelation")).join(runs, "series", "left")


def lift_verdict(lifts: DataFrame, by: list[str], bar: float) -> DataFrame:
    """Over all series and halves: every lift positive, and the mean at least the bar."""
    x = lifts.where("half <> 'full'")
    return x.groupBy(*by).agg(F.bool_and(F.coalesce(F.col("lift_pp") > 0, F.lit(False))).alias("all_positive"), F.avg("lift_pp").alias("mean_lift")).withColumn("passes", F.col("all_positive") & (F.col("mean_lift") >= bar))


def composite_gap(composite: DataFrame, singles: DataFrame, bar: float = 0.0) -> DataFrame:
    """Inside rate of a composite gate minus each single gate's (column gate), and whether both halves reach the bar."""
    x = composite.where("half <> 'full'").select("series", "half", F.col("inside_rate").alias("_c")).join(singles.where("half <> 'full'"), ["series", "half"])
    x = x.withColumn("gap_pp", (F.col("_c") - F.col("inside_rate")) * 100)
    return x.groupBy("series", "gate").agg(F.min("gap_pp").alias("least_gap_pp"), F.bool_and(F.col("gap_pp") >= bar).alias("both_halves"))


# parameter surfaces ----------------------------------------------------------------------------------------------------


def grid(spark: SparkSession, axes: dict[str, list], known: tuple[str, ...]) -> list[dict]:
    """Cells of a grid in order; unknown or empty axes are refused."""
    bad = [a for a in axes if a not in known or not axes[a]]
    if bad or not axes:
        raise ValueError(f"unknown or empty axes: {bad}")
    return [dict(zip(axes, values)) for values in itertools.product(*axes.values())]


def donchian_surface_signals(bars: DataFrame, cells: list[dict]) -> DataFrame:
    """Flags of all cells at once: each distinct window is computed once, then the cells pick theirs."""
    c, w = F.col("close"), k.series_window()
    edges = {}
    for n in sorted({x[a] for x in cells for a in ("entry", "leave")}):
        span = w.rowsBetween(-n, -1)
        edges |= {f"_hi{n}": F.when(F.count("high").over(span) == n, F.max("high").over(span)), f"_lo{n}": F.when(F.count("low").over(span) == n, F.min("low").over(span))}
    x = bars.withColumns(edges)
    no = lambda e: F.coalesce(e, F.lit(False))
    row = lambda i, p: F.struct(F.lit(i).alias("cell"), F.lit(p["entry"]).alias("entry"), F.lit(p["leave"]).alias("leave"), no(c > F.col(f"_hi{p['entry']}")).alias("long_entry"), no(c < F.col(f"_lo{p['leave']}")).alias("long_exit"), no(c < F.col(f"_lo{p['entry']}")).alias("short_entry"), no(c > F.col(f"_hi{p['leave']}")).alias("short_exit"))
    return x.select("series", "ts", "close", F.explode(F.array(*[row(i, p) for i, p in enumerate(cells)])).alias("p")).select("series", "ts", "close", "p.*")


def surface_returns(signals: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return ledger.bar_returns(ledger.net_position(signals, keys), keys)


def evaluate(returns: DataFrame, keys: tuple[str, ...], warmup: int, bars_per_year: float = BARS_PER_YEAR) -> DataFrame:
    """total_return, sharpe, max_drawdown (from 1 at the start) and trades (bars whose position changed) after the warmup."""
    w = W.partitionBy(*keys).orderBy("ts")
    x = returns.withColumns({"_n": F.row_number().over(w), "_moved": F.coalesce(F.col("position") != F.lag("position").over(w), F.lit(False)).cast("int")}).where(F.col("_n") > warmup)
    x = ledger.equity_curve(x, keys)
    a = x.groupBy(*keys).agg(F.max_by("equity", "ts").alias("_end"), F.avg("ret").alias("_mean"), F.stddev_samp("ret").alias("_sd"), F.min("drawdown").alias("max_drawdown"), F.sum("_moved").alias("trades"), F.count("*").alias("bars"))
    return a.select(*keys, (F.col("_end") - 1).alias("total_return"), F.when(F.col("_sd") > 0, F.col("_mean") / F.col("_sd") * bars_per_year**0.5).otherwise(0.0).alias("sharpe"), "max_drawdown", "trades", "bars")


def stability_score(points: DataFrame) -> DataFrame:
    """Mean Sharpe times the share of positive ones over one plus their deviation; 0 with fewer than two cells."""
    s = F.col("sharpe")
    return points.groupBy("series").agg(F.count("*").alias("cells"), F.when(F.count("*") < 2, 0.0).otherwise(F.avg(s) * F.avg((s > 0).cast("double")) / (1 + F.stddev_pop(s))).alias("stability"))


def best_cell(points: DataFrame) -> DataFrame:
    """The cell of the highest Sharpe ratio; ratios that agree to nine digits tie, since cells of the same trades sum the same returns in any order, and the first such cell counts."""
    best = F.max_by(F.struct("cell", "entry", "leave", "sharpe", "total_return"), F.struct(F.round("sharpe", 9), -F.col("cell")))
    return points.groupBy("series").agg(best.alias("b")).select("series", "b.*")


def heat_map(points: DataFrame, rows: str, columns: str, values: list, measure: str = "sharpe") -> DataFrame:
    return points.groupBy("series", rows).pivot(columns, values).agg(F.first(measure)).orderBy("series", rows)


def walk_forward(returns: DataFrame, keys: tuple[str, ...], first: int, block: int) -> DataFrame:
    """For each fold the cell that did best on all bars before it, and its Sharpe on the fold's block; anchored training.

    Sums of returns by block are the only thing that folds need, so bars are read once however many folds there are.
    """
    w = W.partitionBy(*keys).orderBy("ts")
    x = returns.withColumn("_n", F.row_number().over(w) - 1)
    blocks = x.withColumn("fold", F.when(F.col("_n") < first, -1).otherwise(F.floor((F.col("_n") - first) / block)).cast("int"))
    s = blocks.groupBy(*keys, "fold").agg(F.count("*").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"), F.sum(F.log1p("ret")).alias("g"))
    before = W.partitionBy(*keys).orderBy("fold").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns({f"_{c}": F.sum(c).over(before) for c in "nsq"})
    sharpe = lambda n, a, b: F.when((b - a * a / n) > 1e-18, a / n / F.sqrt((b - a * a / n) / (n - 1)) * BARS_PER_YEAR**0.5).otherwise(0.0)
    s = s.where(F.col("fold") >= 0).withColumns({"train_sharpe": sharpe(F.col("_n"), F.col("_s"), F.col("_q")), "test_sharpe": sharpe(F.col("n"), F.col("s"), F.col("q"))})
    pick = F.max_by(F.struct("cell", "train_sharpe", "test_sharpe", "n", "g"), F.struct("train_sharpe", -F.col("cell")))
    return s.groupBy("series", "fold").agg(pick.alias("p")).select("series", "fold", "p.cell", "p.train_sharpe", "p.test_sharpe", F.col("p.n").alias("bars"), (F.exp("p.g") - 1).alias("test_return"))


def chained(folds: DataFrame) -> DataFrame:
    """Distinct winners and the out-of-sample curve's end over the chained folds."""
    return folds.groupBy("series").agg(F.count("*").alias("folds"), F.count_distinct("cell").alias("winners"), (F.exp(F.sum(F.log1p("test_return"))) - 1).alias("oos_return"), F.avg("test_sharpe").alias("mean_test_sharpe"))


def perturbation(points: DataFrame, test_points: DataFrame, axes: tuple[str, str]) -> DataFrame:
    """The winner's neighbours, one step along one axis, with their Sharpe ratios in training and test."""
    rank = {a: F.dense_rank().over(W.partitionBy("series").orderBy(a)) for a in axes}
    x = points.withColumns({f"i_{a}": r for a, r in rank.items()})
    top = x.groupBy("series").agg(F.max_by(F.struct(*[f"i_{a}" for a in axes]), F.struct("sharpe", -F.col("cell"))).alias("w"))
    near = x.join(top, "series").where(sum([F.abs(F.col(f"i_{a}") - F.col(f"w.i_{a}")) for a in axes], F.lit(0)) <= 1)
    return near.select("series", "cell", *axes, F.col("sharpe").alias("train_sharpe")).join(test_points.select("series", "cell", F.col("sharpe").alias("test_sharpe")), ["series", "cell"])


# deflated Sharpe ----------------------------------------------------------------------------------------------------------


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def expected_max_sharpe(sigma: float, trials: int) -> float:
    """The Sharpe ratio that the best of so many trials without skill is expected to show."""
    if trials < 2:
        return 0.0
    gamma = 0.5772156649015329
    return sigma * ((1 - gamma) * normal_quantile(1 - 1 / trials) + gamma * normal_quantile(1 - 1 / (trials * math.e)))


def normal_cdf_col(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26 for the error function; the error is below 2e-7."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    y = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-z * z)
    return F.when(x >= 0, (1 + y) / 2).otherwise((1 - y) / 2)


def return_moments(returns: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """bars, per-bar Sharpe, bias-corrected skew and excess kurtosis."""
    n = F.count("ret").cast("double")
    g1, g2 = F.skewness("ret"), F.kurtosis("ret")
    return returns.groupBy(*keys).agg(n.alias("n"), F.try_divide(F.avg("ret"), F.stddev_samp("ret")).alias("sr"), (g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurt"))


def deflated_sharpe(moments: DataFrame, by: str = "series") -> DataFrame:
    """Probability that each cell's Sharpe beats what the best of all cells would show by luck."""
    trials = moments.groupBy(by).agg(F.stddev_samp("sr").alias("sigma"), F.count("*").alias("trials"))
    few = trials.select("trials").distinct().collect()  # numbers of cells: one value for a full grid
    spread = {r["trials"]: expected_max_sharpe(1.0, r["trials"]) for r in few}
    unit = F.create_map(*[F.lit(v) for pair in spread.items() for v in pair])
    x = moments.join(trials, by).withColumn("sr0", F.coalesce("sigma", F.lit(0.0)) * unit[F.col("trials")])
    z = (F.col("sr") - F.col("sr0")) * F.sqrt(F.col("n") - 1) / F.sqrt(1 - F.col("skew") * F.col("sr") + (F.col("kurt") + 2) / 4 * F.col("sr") * F.col("sr"))
    return x.withColumn("dsr", normal_cdf_col(z))


# censuses and audits --------------------------------------------------------------------------------------------------------


def dropout(frame: DataFrame, features: list[str], neutral: dict[str, float]) -> DataFrame:
    """The frame once for each feature, with that one neutral (NULL stays), and once as it is (dropped = '')."""
    names = frame.sparkSession.createDataFrame([("",), *((f,) for f in features)], "dropped string")
    x = frame.crossJoin(F.broadcast(names))  # one row for each feature
    return x.withColumns({f: F.when((F.col("dropped") == f) & F.col(f).isNotNull(), F.lit(neutral[f])).otherwise(F.col(f)) for f in features})


def entry_size_census(sized: DataFrame, size: str = "size") -> DataFrame:
    s = F.when(F.col("long_entry") | F.col("short_entry"), F.col(size))
    return sized.groupBy("series").agg(F.count(s).alias("entries"), F.count_if(s != 1).alias("not_one"), F.min(s).alias("least"), F.percentile(s, F.lit(0.5)).alias("median"), F.max(s).alias("most"), F.count_distinct(F.round(s, 9)).alias("sizes"))


def exit_mode_census(signals: DataFrame, modes: tuple[str, ...], **options) -> DataFrame:
    """For each mode the exits that it adds to the signals' own, and those that pass through."""
    out = None
    for m in modes:
        x = ledger.with_exits(signals.withColumns({"_lx": F.col("long_exit"), "_sx": F.col("short_exit")}), m, **options)
        a = x.groupBy("series").agg(F.count_if((F.col("long_exit") & ~F.col("_lx")) | (F.col("short_exit") & ~F.col("_sx"))).alias("added"), F.count_if(F.col("_lx") | F.col("_sx")).alias("own")).withColumn("mode", F.lit(m))
        out = a if out is None else out.unionByName(a)
    return out


def start_invariance(build: Callable[[DataFrame], DataFrame], bars: DataFrame, cut: Column, start: Column) -> DataFrame:
    """Entries after `cut` that differ between the whole history and one that begins at `start`."""
    from tidemark.operators.align import signal_diff

    def entries(x: DataFrame) -> DataFrame:
        return x.where(F.col("ts") > cut).unpivot(["series", "ts"], ["long_entry", "short_entry"], "side", "on").where("on")

    return signal_diff(entries(build(bars)), entries(build(bars.where(F.col("ts") >= start))))


def last_covered(bars: DataFrame, span: DataFrame, n: int) -> DataFrame:
    """The newest n bars of each series that are not past its last settlement."""
    x = bars.join(span.select("series", "last_settled"), "series").where("ts <= last_settled")
    return x.withColumn("_b", F.row_number().over(W.partitionBy("series").orderBy(F.desc("ts")))).where(F.col("_b") <= n).drop("_b", "last_settled")
