"""Causal kernels over bar series. Row t depends on rows up to t only; missing values are NULL.

All fixed windows share one specification, so a whole feature frame needs one shuffle. Exponential means are a blocked
affine scan: a weighted running sum inside short blocks that starts from the mean at the end of the block before.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def series_window() -> WindowSpec:
    return W.partitionBy("series").orderBy("ts")


def by_series(df: DataFrame) -> DataFrame:
    """Rows dealt by series to as many tasks as the session shuffles to.

    Windows over series cost far more than their bytes tell, so series aren't put together by size, which adaptive execution would do.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "series")


def trailing(n: int) -> WindowSpec:
    return series_window().rowsBetween(1 - n, 0)


def _full(x: Column, n: int, value: Column) -> Column:
    """value where the window holds n values that are not null."""
    return F.when(F.count(x).over(trailing(n)) == n, value)


def lag(x: Column | str, k: int = 1) -> Column:
    return F.lag(x, k).over(series_window())


def change(x: Column, k: int = 1) -> Column:
    return x - lag(x, k)


def pct_change(x: Column, k: int = 1) -> Column:
    return F.try_divide(x, lag(x, k)) - 1


def rolling_mean(x: Column, n: int) -> Column:
    return _full(x, n, F.avg(x).over(trailing(n)))


def rolling_sum(x: Column, n: int) -> Column:
    return _full(x, n, F.sum(x).over(trailing(n)))


def rolling_min(x: Column, n: int) -> Column:
    return _full(x, n, F.min(x).over(trailing(n)))


def rolling_max(x: Column, n: int) -> Column:
    return _full(x, n, F.max(x).over(trailing(n)))


def rolling_std(x: Column, n: int) -> Column:
    return _full(x, n, F.stddev_samp(x).over(trailing(n)))


def rolling_percentile(x: Column, n: int) -> Column:
    """Share of the last n values below the current one, ties at their middle rank."""
    values = F.collect_list(x).over(trailing(n))
    below = F.size(F.filter(values, lambda v: v < x))
    same = F.size(F.filter(values, lambda v: v == x))
    return _full(x, n, (below + (same + 1) / 2) / n)


def sorted_ranks(x: np.ndarray, n: int) -> np.ndarray:
    """rolling_percentile() of an array whose missing values are NaN: the window is a sorted list, a value comes in and one goes out each step."""
    held, missing, out = [], 0, np.full(len(x), np.nan)
    values = x.tolist()
    for i, v in enumerate(values):
        if v == v:
            insort(held, v)
        else:
            missing += 1
        if i >= n:
            old = values[i - n]
            if old == old:
                del held[bisect_left(held, old)]
            else:
                missing -= 1
        if i >= n - 1 and not missing:
            below = bisect_left(held, v)
            out[i] = (below + (bisect_right(held, v, below) - below + 1) / 2) / n
    return out


def rank_columns(bars: DataFrame, wanted: dict[str, tuple[str, int]], chunk_ms: int | None = None) -> DataFrame:
    """Add rolling percentiles {name: (column, n)}: the share of the last n values below the current one, ties at their middle rank.

    A task holds one window of a column, not an array for each row. With chunk_ms a series is cut into chunks of so much time,
    each with the rows before it that the longest window reaches.
    """
    from tidemark.functions.halo import in_chunks

    schema = T.StructType([*bars.schema.fields, *(T.StructField(name, T.DoubleType()) for name in wanted)])

    def kernel(df: DataFrame) -> DataFrame:
        out = T.StructType([*df.schema.fields, *schema.fields[len(bars.columns) :]])

        def rank(table: pa.Table) -> pa.Table:
            table = table.sort_by("ts")
            for name, (column, n) in wanted.items():
                table = table.append_column(name, pa.array(sorted_ranks(table.column(column).cast(pa.float64()).to_numpy(zero_copy_only=False), n), from_pandas=True))
            return table

        return by_series(df.groupBy("series").applyInArrow(rank, out))

    if chunk_ms is None:
        return kernel(bars)
    return in_chunks(bars, chunk_ms, max(n for _, n in wanted.values()) - 1, kernel)


def rolling_zscore(x: Column, n: int) -> Column:
    """0 where the window has no spread."""
    std = F.stddev_samp(x).over(trailing(n))
    return _full(x, n, F.when(std == 0, 0.0).otherwise((x - F.avg(x).over(trailing(n))) / std))


def true_range() -> Column:
    """The first bar has high - low alone."""
    before = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def true_range_fraction(n: int, tr: str = "tr") -> Column:
    """Mean of true range over close; needs the column `tr`."""
    return rolling_mean(F.try_divide(tr, "close"), n)


def log_fit(n: int, log_close: str = "ln_close", number: str = "rn") -> tuple[Column, Column]:
    """R squared (0 when flat, within 0..1) and residual deviation of a straight line through ln close; needs columns ln_close and rn."""
    y, t = F.col(log_close), F.col(number).cast("double")
    sd = F.stddev_samp(y).over(trailing(n))
    cov = F.covar_samp(y, t).over(trailing(n))
    time_variance = n * (n + 1) / 12.0
    r2 = F.when(sd == 0, 0.0).otherwise(F.least(F.greatest(cov * cov / (time_variance * sd * sd), F.lit(0.0)), F.lit(1.0)))
    return _full(y, n, r2), _full(y, n, sd * F.sqrt(1 - r2))


def realised_volatility(n: int, log_close: str = "ln_close") -> Column:
    """Deviation of the last n log returns; needs column log_return."""
    return rolling_std(F.col("log_return"), n)


def adverse_run(n: int, falling: bool = True) -> Column:
    """Whether the last n closes were all lower (or all higher) than the one before each."""
    d = F.col("close") - lag("close")
    hit = F.coalesce(d < 0 if falling else d > 0, F.lit(False)).cast("int")
    return F.sum(hit).over(trailing(n)) == n


def warmed(x: Column, warmup: int, otherwise: Column | None = None) -> Column:
    """x after the first `warmup` rows of a series, before them `otherwise` (NULL)."""
    if warmup < 0:
        raise ValueError(f"warmup must not be negative, got {warmup}")
    ready = F.row_number().over(series_window()) > warmup
    return F.when(ready, x) if otherwise is None else F.when(ready, x).otherwise(otherwise)


def require_length(bars: DataFrame, warmup: int) -> None:
    """Refuse series that end inside the warmup."""
    short = bars.groupBy("series").count().where(F.col("count") <= warmup).orderBy("series").limit(5).collect()
    if short:
        raise ValueError(f"series not longer than the warmup of {warmup} bars: {[r['series'] for r in short]}")


def running_max(x: Column) -> Column:
    return F.max(x).over(series_window().rowsBetween(W.unboundedPreceding, 0))


def running_sum(x: Column) -> Column:
    return F.sum(x).over(series_window().rowsBetween(W.unboundedPreceding, 0))


def running_product(x: Column) -> Column:
    """Product of 1 + x; null once a factor is not positive (the curve is ruined)."""
    ok = F.min(F.when(1 + x > 0, 1).otherwise(0)).over(series_window().rowsBetween(W.unboundedPreceding, 0))
    return F.when(ok == 1, F.exp(running_sum(F.log1p(x))))


def ema_columns(bars: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Add exponential means y = a*x + (1-a)*y, y0 = x0, for {name: (column, span)} with a = 2/(span+1).

    A column may be null in its leading rows only. Rows are cut into blocks so short that the weights stay well inside a
    double; a block's running sum starts from the mean at the end of the block before. That end is its own sum and those
    of the three blocks before it: what lies further back weighs less than 1e-20. So the scan is made of windows by
    series alone, with no join and no second read.
    """
    w = series_window()
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    df = bars.withColumn("_rn", F.row_number().over(w) - 1)
    for name, (column, span) in wanted.items():
        d = 1 - 2.0 / (span + 1)
        if d <= 0:
            df = df.withColumn(name, F.col(column).cast("double"))
            continue
        size = max(2, int(12 / -math.log(d)))
        df = df.withColumns({"_block": F.floor(F.col("_rn") / size), "_p": (F.col("_rn") % size).cast("int"), "_k": F.count(column).over(upto)})
        x = F.when(F.col("_k") == 1, F.col(column)).otherwise(F.col(column) * (1 - d))
        inside = W.partitionBy("series", "_block").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
        df = df.withColumn("_s", F.coalesce(F.sum(x * F.pow(F.lit(d), -F.col("_p"))).over(inside), F.lit(0.0)) * F.pow(F.lit(d), F.col("_p")))
        end = sum((F.coalesce(F.lag("_s", i * size).over(w), F.lit(0.0)) * d ** (i * size) for i in range(1, 4)), F.col("_s"))
        df = df.withColumn("_end", F.when(F.col("_p") == size - 1, end))
        carry = F.coalesce(F.last("_end", ignorenulls=True).over(before), F.lit(0.0))
        df = df.withColumn(name, F.when(F.col("_k") > 0, F.col("_s") + carry * F.pow(F.lit(d), F.col("_p") + 1)))
    return df.drop("_rn", "_block", "_p", "_k", "_s", "_end")


def ew_std(bars: DataFrame, out: str, column: str, span: float) -> DataFrame:
    """Bias-corrected exponentially weighted deviation (adjust=False) of a column whose leading rows may be null."""
    a = 2.0 / (span + 1)
    df = bars.withColumn("_square", F.col(column) * F.col(column))
    df = ema_columns(df, {"_m1": (column, span), "_m2": ("_square", span)})
    k = F.count(column).over(series_window().rowsBetween(W.unboundedPreceding, 0)) - 1  # steps since the first value
    d2 = F.pow(F.lit((1 - a) * (1 - a)), k)
    weights = d2 + a * a * (1 - d2) / (1 - (1 - a) * (1 - a))
    return df.withColumn(out, F.when(k > 0, F.sqrt(F.greatest((F.col("_m2") - F.col("_m1") * F.col("_m1")) / (1 - weights), F.lit(0.0))))).drop("_square", "_m1", "_m2")
