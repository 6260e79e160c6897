"""Mixing sources to target weights by temperature.

Source weights are token shares raised to an exponent between 0 and 1. The exponent is found by bisection: the largest
entropy target that the limit on repetitions allows. The weights times the budget are token budgets; each is realised as
whole passes over the source and a part of one more. In each pass the source is cut into blocks by a hash of the pass and
the document, and the blocks' order is that pass's permutation, so no source is ever sorted or held in one task. The part
pass takes whole blocks in their order, then whole smaller blocks of the next one, then its documents one by one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, met, row_hash, table, written

#: Blocks of a source in a pass, and smaller blocks in each of these.
BLOCKS = 1024
#: Exponents tried in one aggregation: each round narrows the interval by so many.
FAN = 15
#: So many sources' plans are broadcast at most.
BROADCAST_SOURCES = 10_000
#: So many keys of repeated rows are broadcast at most (8 MB).
BROADCAST_COPIES = 1_000_000
SALTS = 64
SEED = 17


def token_count(text: Column) -> Column:
    """Words of a text and one end; a null text has the end alone."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1


def source_tokens(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("source_docs"))


def _at(sources: DataFrame, exponents: list[float], total: int) -> list[tuple[float, float, float]]:
    """(entropy, largest and smallest weight over share) of the weights for each exponent, by one aggregation."""
    share = F.col("source_tokens") / F.lit(float(total))
    found = sources.agg(*[f for a in exponents for f in (F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(F.pow(share, F.lit(a)))), F.max(F.pow(share, F.lit(a - 1))), F.min(F.pow(share, F.lit(a - 1))))]).first()
    out = []
    for i in range(len(exponents)):
        z, zlog, most, least = found[4 * i : 4 * i + 4]
        out.append((math.log(z) - zlog / z, most / z, least / z))
    return out


def temperature(sources: DataFrame, target_entropy: float, repetition_limit: float, budget: float | None) -> tuple[float, float]:
    """The exponent, and the budget as a multiple of all tokens.

    target_entropy is a share of the largest possible entropy, log(sources). With no budget the smallest one that takes every
    source at least once counts. The exponent falls from 1 (the sources' own shares) until the entropy is met, but not so far
    that a source would be repeated more often than the limit.
    """
    first = sources.agg(F.sum("source_tokens"), F.count("*")).first()
    total, n = first[0], first[1]
    goal = target_entropy * math.log(n) if n > 1 else 0.0

    def enough(state: tuple[float, float, float]) -> bool:
        """Whether the exponent need not, or must not, fall further."""
        entropy, most, least = state
        return entropy >= goal or most * (budget if budget is not None else 1 / least) >= repetition_limit

    def allowed(state: tuple[float, float, float]) -> bool:
        return state[1] * (budget if budget is not None else 1 / state[2]) <= repetition_limit * (1 + 1e-9)

    low, high = 0.0, 1.0  # enough at low, or 0 is taken; not enough at high, or 1 is taken
    if enough(_at(sources, [1.0], total)[0]):
        low = 1.0
    while high - low > 1e-9:
        steps = [low + (high - low) * (i + 1) / (FAN + 1) for i in range(FAN)]
        states = _at(sources, steps, total)
        reach = [i for i, s in enumerate(states) if enough(s)]
        k = reach[-1] if reach else -1
        low, high = (steps[k] if k >= 0 else low), (steps[k + 1] if k + 1 < FAN else high)
    state = _at(sources, [high], total)[0]
    return high, budget if budget is not None else 1 / state[2]


def mix_sources(docs: DataFrame, tokens: Column | None = None, target_entropy: float = 0.95, repetition_limit: float = 4.0, budget: float | None = 1.0, seed: int = SEED) -> DataFrame:
    """All columns of docs for each time a row is taken, with mix_pass, mix_block, mix_key (order inside the block), mix_tokens and mix_weight.

    budget is a multiple of all tokens, or None for the least that takes every row once. A null source is a source of its
    own. A document is taken in each whole pass of its source and in the part pass while the budget lasts; the last one taken
    may go past it. Repeated rows are rows of their own; texts that are null or empty count one token. An empty table gives none.
    Columns of docs with the names above are replaced; its other columns may have any names and types, maps too. Rows are
    told apart by a hash of all columns, and those alike in all of them by a number.
    """
    names = ("mix_pass", "mix_block", "mix_key", "mix_tokens", "mix_weight")
    docs = docs.drop(*names)
    size = token_count(F.col("text")) if tokens is None else tokens
    # docs' own columns travel in one struct, so their names meet none of the plan's
    whole = docs.select(row_hash(docs).alias("_row"), "source", size.alias("tokens"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    light = written(whole.select("_row", "source", "tokens"), "tokens")
    whole, light = told_apart(whole, light)
    sources = written(source_tokens(light), "sources")
    if sources.isEmpty():
        return docs.select("*", *[F.lit(None).cast(t).alias(n) for n, t in zip(names, ("int", "int", "long", "long", "double"))])
    exponent, multiple = temperature(sources, target_entropy, repetition_limit, budget)
    total = sources.agg(F.sum("source_tokens")).first()[0]
    raised = F.pow(F.col("source_tokens") / F.lit(float(total)), F.lit(exponent))
    norm = sources.agg(F.sum(raised)).first()[0]
    plan = sources.withColumn("weight", raised / F.lit(norm)).withColumn("take", F.col("weight") * F.lit(multiple * total))
    plan = plan.withColumn("passes", F.floor(F.col("take") / F.col("source_tokens") + 1e-9).cast("int"))
    rest = F.col("take") - F.col("passes") * F.col("source_tokens")
    plan = written(plan.withColumn("rest", F.when(rest >= 0.5, rest).otherwise(0.0)), "plan")
    few = plan.count() <= BROADCAST_SOURCES
    parts = with_plan(light, plan.select("source", "passes", "rest"), few).withColumn("_key", pass_key(F.col("passes"), seed))
    parts = parts.withColumns({"b1": block(F.col("_key")), "b2": small_block(F.col("_key"))})
    # where the budget of each source's part pass ends: the block, the smaller block in it, the last document in that
    first = cut_group(parts, "b1", F.col("rest"))
    parts = with_plan(parts, first.select("source", F.col("b1").alias("cut1"), F.col("left").alias("left1")), few).where(F.col("b1") == F.col("cut1"))
    second = cut_group(parts, "b2", F.col("left1"))
    parts = with_plan(parts, second.select("source", F.col("b2").alias("cut2"), F.col("left").alias("left2")), few).where(F.col("b2") == F.col("cut2"))
    so_far = F.sum("tokens").over(W.partitionBy("source").orderBy("_key", "_row").rowsBetween(W.unboundedPreceding, -1))
    taken = parts.withColumn("before", F.coalesce(so_far, F.lit(0))).where(F.col("before") < F.col("left2"))
    last = taken.groupBy("source").agg(F.max(F.struct("_key", "_row")).alias("top"))
    cuts = plan.select("source", "weight", "passes")
    for x in (first.select("source", F.col("b1").alias("cut1")), second.select("source", F.col("b2").alias("cut2")), last):
        x = x.withColumnRenamed("source", "_source")
        cuts = cuts.join(x.hint("merge"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    cuts = written(cuts, "cuts")
    for spent in (light, sources, plan, first, second):
        discard(spent)
    rows = with_plan(whole.withColumnRenamed("tokens", "mix_tokens"), cuts, few)
    k = pass_key(F.col("passes"), seed)
    in_small = (small_block(k) < F.col("cut2")) | ((small_block(k) == F.col("cut2")) & (F.struct(k.alias("_key"), F.col("_row")) <= F.col("top")))
    in_part = F.coalesce((block(k) < F.col("cut1")) | ((block(k) == F.col("cut1")) & in_small), F.lit(False))
    times = F.col("passes") + in_part.cast("int")
    out = rows.where(times > 0).withColumn("mix_pass", F.explode(F.sequence(F.lit(0), times - 1)))
    mine = pass_key(F.col("mix_pass"), seed)
    return out.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns], "mix_pass", block(mine).alias("mix_block"), mine.alias("mix_key"), "mix_tokens", F.col("weight").alias("mix_weight"))


def told_apart(whole: DataFrame, light: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with a _row of its own for each row: copies of a row are numbered, in groups by the task that wrote them.

    whole has _row, source, tokens and _doc, light (stored) the first three. Without copies both stay as they are.
    """
    copies = written(light.groupBy("_row").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    n = copies.count()
    if not n:
        return whole, light
    keys = copies.select("_row")
    keys = F.broadcast(keys) if n <= BROADCAST_COPIES else keys.hint("merge")
    again = met(whole, copies, "_row", light.count()).drop("copies")
    again = written(again.withColumns({"_task": F.spark_partition_id(), "_own": F.monotonically_increasing_id()}), "repeated")
    before = F.sum("n").over(W.partitionBy("_row").orderBy("_task").rowsBetween(W.unboundedPreceding, -1))
    starts = again.groupBy("_row", "_task").agg(F.count("*").alias("n")).select("_row", "_task", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_row", "_task").orderBy("_own"))
    again = again.withColumn("_place", place).join(starts.hint("merge"), ["_row", "_task"])
    number = F.xxhash64("_row", F.col("_before") + F.col("_place"))
    again = written(again.select(number.alias("_row"), "source", "tokens", "_doc"), "numbered")
    light = written(light.join(keys, "_row", "left_anti").unionByName(again.select("_row", "source", "tokens")), "tokens")
    return whole.join(keys, "_row", "left_anti").unionByName(again), light


def pass_key(number: Column, seed: int) -> Column:
    """A row's place in the permutation of a pass."""
    return F.xxhash64("_row", number, F.lit(seed))


def block(key: Column) -> Column:
    return F.pmod(key, F.lit(BLOCKS)).cast("int")


def small_block(key: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 20), F.lit(BLOCKS)).cast("int")


def cut_group(parts: DataFrame, by: str, rest: Column) -> DataFrame:
    """For each source the group in which its budget ends, and what of the budget is left there; sums of at most BLOCKS groups."""
    sums = parts.groupBy("source", by).agg(F.sum("tokens").alias("t"), F.max(rest).alias("rest"))
    before = F.coalesce(F.sum("t").over(W.partitionBy("source").orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = sums.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("t") >= F.col("rest")))
    return written(ends.select("source", by, (F.col("rest") - F.col("before")).alias("left")), "cut")


def with_plan(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """Rows with the plan of their source (inner). Few sources are broadcast, many joined with hot ones salted."""
    plan = plan.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if few:
        return rows.join(F.broadcast(plan), same).drop("_source")
    plan = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_own", F.pmod(F.col("_row"), F.lit(SALTS)).cast("int"))
    return rows.join(plan.hint("merge"), same & (F.col("_own") == F.col("_salt"))).drop("_source", "_salt", "_own")


def query_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "mix_pass", "mix_block", "mix_key", "mix_tokens", "mix_weight")
