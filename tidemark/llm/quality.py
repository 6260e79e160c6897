"""Quality rules whose thresholds adapt to each language and source.

Every text gets whole-text statistics. Mergeable quantile sketches (KLL, combined on the map side and across tasks) of
the logarithms of its rates are kept for each language and source. A group's thresholds are fences around its own
quartiles, a multiple of the distance between them away, so they move with the group's level and with its spread; there is no
absolute distance. Texts outside a fence of their own group are rejected, as are those that fail the base rules.

A count n among m things has the smoothed rate (n + 0.5) / (m + 1): most texts have none of what is counted, and then the
rate says how many things showed none, so quartiles differ and one symbol in a short text is no outlier.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, table, text_buffer, windows, word_bounds, word_hashes, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rates with adaptive thresholds, and whether low values are outliers too.
FENCES = {"symbol_rate": False, "dup_line_rate": False, "repeat_rate": False, "mean_chars": True}
#: How many quartile distances beyond a quartile the fences are (Tukey's far-out points).
REACH = 3.0
#: Pairs of quantiles whose distance is the spread: the first that is not zero counts, in units of the quartile distance of a normal one.
SPREADS = ((0.25, 0.75, 1.0), (0.1, 0.9, 1.9), (0.01, 0.99, 3.45), (0.0, 1.0, 6.0))
#: Groups with fewer texts than this use the thresholds of their language over all sources.
LEAST_GROUP = 30
#: So many groups' thresholds are broadcast at most; beyond, they are joined by a shuffle with hot groups salted.
BROADCAST_GROUPS = 10_000
SALTS = 32

STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def text_statistics(column: pa.Array) -> list[np.ndarray]:
    """For each text the columns of STATISTICS."""
    texts = ["" if t is None else t for t in column.to_pylist()]
    n = len(texts)
    buf, bounds = text_buffer(column)
    doc, starts, ends = word_bounds(buf, bounds)
    hashes = word_hashes(buf, starts, ends)
    n_words = np.bincount(doc, minlength=n)
    whites = np.array([sum(map(t.count, " \t\n\x0b\x0c\r")) for t in texts], dtype=np.int64)
    word_chars = np.array([len(t) for t in texts], dtype=np.int64) - whites
    symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], dtype=np.int64)
    lines, twice = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        real = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
        lines[i], twice[i] = len(real), len(real) - len(set(real))
    at, shingle = windows(doc, hashes, WINDOW)
    repeated = np.zeros(n, np.int64)
    if len(at):
        order = np.lexsort((shingle, doc[at]))
        d, s = doc[at][order], shingle[order]
        same = (d[1:] == d[:-1]) & (s[1:] == s[:-1])
        often = np.zeros(len(at), dtype=bool)
        often[1:] |= same
        often[:-1] |= same
        covered = np.zeros(len(doc) + 1, dtype=np.int64)
        first = at[order[often]]
        covered[first] += 1
        covered[first + WINDOW] -= 1
        repeated = np.bincount(doc[np.cumsum(covered[:-1]) > 0], minlength=n)
    return [n_words, word_chars, symbols, twice, repeated, lines]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the statistics of every whole text; a null text has no words."""

    def measure(batches):
        for batch in batches:
            for part in chunks(batch):
                kept = [part.column(i) for i in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, pa.int64()) for x in text_statistics(part.column(1)))], names=["doc_id", "lang", "source", *(x.split()[0] for x in STATISTICS.split(", "))])

    return docs.select("doc_id", "text", "lang", "source").mapInArrow(measure, f"doc_id long, lang string, source string, {STATISTICS}")


def with_rates(stats: DataFrame) -> DataFrame:
    """The base rules, and the smoothed rates; mean_chars is characters a word."""
    smoothed = lambda n, m: (F.col(n) + 0.5) / (F.col(m) + 1)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.withColumns({
        "base_failed": base,
        "symbol_rate": smoothed("n_symbols", "n_words"),
        "dup_line_rate": smoothed("n_dup_lines", "n_lines"),
        "repeat_rate": smoothed("n_repeat_words", "n_words"),
        "mean_chars": smoothed("word_chars", "n_words"),
    })


def thresholds(rates: DataFrame, fences: dict = FENCES, least: int = LEAST_GROUP, sketch_k: int = 200, reach: float = REACH) -> DataFrame:
    """_lang, _source and lowest and highest allowed value of each rate, from sketches of all texts of a group that pass the base rules.

    A null language or source is the group of the empty string. Groups of fewer than `least` texts take the fences of their
    language. A group whose quartiles are equal takes its spread from quantiles farther out; one whose values are all the
    same allows that value.
    """
    logs = [F.log(c).alias(c) for c in fences]
    keyed = rates.where(~F.col("base_failed")).select(F.coalesce("lang", F.lit("")).alias("_lang"), F.coalesce("source", F.lit("")).alias("_source"), *logs)
    sketches = keyed.groupBy("_lang", "_source").agg(F.count("*").alias("_n"), *[F.kll_sketch_agg_double(c, F.lit(sketch_k)).alias(c) for c in fences])
    sketches = written(sketches, "sketches")
    by_lang = sketches.groupBy("_lang").agg(*[F.kll_merge_agg_double(c).alias(f"_all_{c}") for c in fences])
    joined = sketches.join(by_lang.hint("merge"), "_lang")
    out = [F.col("_lang"), F.col("_source")]
    for c, both in fences.items():
        sketch = F.when(F.col("_n") >= least, F.col(c)).otherwise(F.col(f"_all_{c}"))
        at = lambda q, s=sketch: F.kll_sketch_get_quantile_double(s, F.lit(q))
        spread = F.coalesce(*[F.nullif((at(hi) - at(lo)) / unit, F.lit(0.0)) for lo, hi, unit in SPREADS], F.lit(0.0))
        low = F.exp(at(0.25) - reach * spread) * (1 - 1e-9) if both else F.lit(0.0)
        out += [low.alias(f"_low_{c}"), (F.exp(at(0.75) + reach * spread) * (1 + 1e-9)).alias(f"_high_{c}")]
    return joined.select(*out)


def keep_rules(docs: DataFrame, fences: dict = FENCES, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """doc_id, lang, source, statistics, rates, base_failed, the failed adaptive rules and kept of each row of docs.

    Null and empty texts have no words and fail the base rules. Repeated rows are each judged. An empty table gives no rows.
    Columns other than doc_id, text, lang and source are not read.
    """
    rates = with_rates(written(with_statistics(docs), "statistics"))
    limits = written(thresholds(rates, fences), "limits")
    keyed = rates.withColumns({"_lang": F.coalesce("lang", F.lit("")), "_source": F.coalesce("source", F.lit(""))})
    if limits.count() <= broadcast_groups:
        joined = keyed.join(F.broadcast(limits), ["_lang", "_source"], "left")
    else:
        salted = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["_lang", "_source", "_salt"], "left").drop("_salt")
    broken = [F.when((F.col(c) < F.col(f"_low_{c}")) | (F.col(c) > F.col(f"_high_{c}")), F.lit(c)) for c in fences]
    joined = joined.withColumn("failed_rules", F.concat_ws(",", *broken))
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == "")).drop(*[f"_{x}_{c}" for x in ("low", "high") for c in fences], "_lang", "_source")


def query_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keep_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")
