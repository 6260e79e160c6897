"""Trailing windows over series that are too long for one task.

A series is cut into chunks of time. Each chunk gets the rows before it that its windows reach back to (its halo), so chunks
are independent tasks; the halo's own results are dropped. Results are those of the uncut series for kernels that look back
at most a fixed number of rows and have no other memory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def in_chunks(bars: DataFrame, width_ms: int, back: int, kernel: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """kernel(bars) computed chunk by chunk; `back` is how many rows before a row its windows reach.

    Gaps are no matter: where a chunk has fewer rows than its successor needs, earlier chunks lend theirs too. Only counts
    by series and chunk meet in one window; rows are shuffled by series and chunk.
    """
    x = bars.withColumn("_chunk", F.floor(F.unix_millis("ts") / width_ms))
    counts = x.groupBy("series", "_chunk").agg(F.count("*").alias("_n"))
    # chunks after this one that may need its rows, each with the number of rows that lie between
    later = W.partitionBy("series").orderBy("_chunk").rowsBetween(1, back)
    needs = counts.withColumn("_later", F.collect_list(F.struct("_chunk", "_n")).over(later))
    step = lambda acc, c: F.struct((acc["sum"] + c["_n"]).alias("sum"), F.when(acc["sum"] < back, F.array_append(acc["to"], F.struct(c["_chunk"].alias("chunk"), acc["sum"].alias("between")))).otherwise(acc["to"]).alias("to"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<chunk:bigint,between:bigint>>").alias("to"))
    needs = needs.select("series", "_chunk", F.aggregate("_later", start, step, lambda acc: acc["to"]).alias("_to"))
    from_end = F.row_number().over(W.partitionBy("series", "_chunk").orderBy(F.desc("ts")))
    rows = x.withColumn("_end", from_end).join(needs.hint("merge"), ["series", "_chunk"])
    to = F.concat(F.array(F.struct(F.col("_chunk").alias("chunk"), F.lit(False).alias("halo"))), F.transform(F.filter("_to", lambda t: F.col("_end") + t["between"] <= back), lambda t: F.struct(t["chunk"].alias("chunk"), F.lit(True).alias("halo"))))
    dealt = rows.withColumn("_at", F.explode(to)).select(*bars.columns, F.col("_at.chunk").alias("_chunk"), F.col("_at.halo").alias("_halo"))
    # the kernel's windows are by `series`: for their sake a chunk is a series
    alone = dealt.withColumn("_series", F.col("series")).withColumn("series", F.concat_ws("\u0001", "series", "_chunk"))
    return kernel(alone).where(~F.col("_halo")).withColumn("series", F.col("_series")).drop("_series", "_chunk", "_halo")
