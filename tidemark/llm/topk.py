"""Exact top-k search by inner product with pivot-table elimination.

Vectors become integers, floor(256 * x). The distance of two vectors follows from their norms and inner product, so a
lower bound of the distance is an upper bound of the score. The pivot table, made once and written, holds every vector's
distances to some pivots; by the triangle inequality the largest difference of two of its rows bounds their distance from below.
Vectors are dealt to blocks by their nearest pivot. A block's least and largest distances to the pivots bound the scores of
all its vectors, so a query has a bound for each block. Queries meet their blocks in the order of these bounds, a few
blocks a round, and carry their k-th score along: blocks whose bound does not reach it are never read for them. Inside a
block the rows are bounded by the table in the same way and evaluated best bound first, until no bound reaches the k-th score.
The result is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, table, written

SCALE = 256
PIVOTS = 24
#: Rows in a block of vectors, queries in a part, and blocks in a part, about.
BLOCK = 4096
#: Blocks of a query, in the order of their bounds, after which a round ends and its k-th score is carried on.
ROUNDS = (1, 9)
#: Candidates of a query that are evaluated first; each further step takes four times as many.
STEP = 128
#: Integers below this are exact as doubles.
EXACT = 2.0**53


def integer_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """row (a number of its own), id, dim and v (array<long>) of each vector without null or non-finite component; others take no part."""
    x = F.col(vector_column)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.where(F.col(id_column).isNotNull() & x.isNotNull() & fine).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), F.size(x).alias("dim"), F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("v")
    )


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS) -> dict[int, np.ndarray]:
    """For each of at most 64 lengths of vectors, `pivots` rows with the lowest hashes of the ids; other lengths have none."""
    dims = [r["dim"] for r in vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(64).collect()]
    out = {}
    for dim in dims:
        rows = vectors.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id", "row").limit(pivots).collect()
        out[dim] = np.array([r["v"] for r in rows], dtype=np.float64).reshape(len(rows), dim)
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Squares and products of these integers are exact as doubles up to 2**53."""
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def pivot_table(vectors: DataFrame, pivots: dict[int, np.ndarray], most: int = PIVOTS) -> DataFrame:
    """row, id, dim, v, sq (squared norm), near (number of the nearest pivot) and dist (to each pivot; as many for all, the last repeated)."""

    def measure(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = part.column(3).flatten().to_numpy().astype(np.float64).reshape(len(part), dim)
                p = pivots.get(int(dim), np.zeros((0, int(dim))))
                d = distances(x, p) if len(p) else np.zeros((len(part), 1))
                d = d[:, np.minimum(np.arange(most), d.shape[1] - 1)]
                columns = [pa.array((x * x).sum(1)), pa.array(d.argmin(1).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, most, dtype=np.int32)), pa.array(d.reshape(-1)))]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=["row", "id", "dim", "v", "sq", "near", "dist"])

    return vectors.select("row", "id", "dim", "v").mapInArrow(measure, "row long, id long, dim int, v array<long>, sq double, near int, dist array<double>")


def score_bounds(query_table: np.ndarray, query_square: np.ndarray, low: np.ndarray, high: np.ndarray, square: np.ndarray) -> np.ndarray:
    """queries x rows upper bounds of the inner product, where rows lie between low and high of each pivot's distance."""
    gap = np.zeros((len(query_table), len(low)))
    for p in range(query_table.shape[1]):
        own = query_table[:, p, None]
        np.maximum(gap, own - high[None, :, p], out=gap)
        np.maximum(gap, low[None, :, p] - own, out=gap)
    both = query_square[:, None] + square[None, :]
    gap = np.maximum(gap * (1 - 1e-9) - 1e-6, 0)  # what rounding may have added
    return (both * (1 + 1e-12) - gap * gap) / 2 + 1e-6


def search_block(queries: dict, rows: dict, k: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the query, id and score of each query's k best rows of a block that reach its score so far; its own row is left out.

    queries and rows hold row, id, v, sq and dist as arrays, queries also `least`, the k-th score so far (-inf: none).
    """
    order = np.argsort(rows["id"], kind="stable")
    rows = {n: x[order] for n, x in rows.items()}
    exact = max(float(queries["sq"].max()), float(rows["sq"].max())) < EXACT
    x = rows["v"].astype(np.float64) if exact else rows["v"]
    found = [], [], []
    for lo in range(0, len(queries["row"]), 64):
        q = {n: c[lo : lo + 64] for n, c in queries.items()}
        v = q["v"].astype(np.float64) if exact else q["v"]
        bound = score_bounds(q["dist"], q["sq"], rows["dist"], rows["dist"], rows["sq"])
        own = q["row"][:, None] == rows["row"][None, :]
        bound[own] = -np.inf
        for i in range(len(v)):
            least, size = q["least"][i], step
            ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
            left = np.flatnonzero((bound[i] >= least) & (bound[i] > -np.inf))
            while len(left):
                if len(left) > size:
                    by = np.argpartition(-bound[i][left], size - 1)
                    now, left = left[by[:size]], left[by[size:]]
                else:
                    now, left = left, left[:0]
                got = (x[now] @ v[i] if len(now) < len(x) // 2 else (x @ v[i])[now]).astype(np.int64)
                fine = got >= least
                ids, scores = np.concatenate([ids, rows["id"][now[fine]]]), np.concatenate([scores, got[fine]])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k:  # a row whose bound equals the last score may still win by its smaller id
                    least = max(least, scores[-1])
                    left = left[bound[i][left] >= least]
                size *= 4
            found[0].append(np.full(len(ids), q["row"][i]))
            found[1].append(ids)
            found[2].append(scores)
    return tuple(np.concatenate(f).astype(np.int64) for f in found)


def stacked(column: pd.Series, kind: type) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(kind)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query, ties to the smaller id.

    Both tables come from integer_vectors(), queries being rows of vectors, and are read more than once: pass stored ones. A
    query row is compared with all rows of its own dimension but itself. Rows that repeat an id are rows of their own: each
    is a candidate of the others, and as queries each has a ranking of its own under the same query_id. Scores are exact
    up to 2**63. Fewer than k rows give fewer results; an empty table gives none.
    """
    points = choose_pivots(vectors, pivots)
    n, m = vectors.count(), queries.count()
    spent = [held := written(pivot_table(vectors, points, pivots), "pivot_table")]
    cells = held.groupBy("dim", "near").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))  # 64 * pivots rows at most, and one for each dim beyond
    cell = lambda df: df.join(cells.hint("shuffle_hash"), ["dim", "near"]).withColumn("block", F.concat_ws(":", "dim", "near", F.pmod(F.xxhash64("row"), F.col("parts")).cast("string"))).drop("parts", "near")
    spent.append(dealt := written(cell(held), "dealt"))
    sides = [f(F.col("dist")[i]) for f in (F.min, F.max) for i in range(pivots)]
    ranges = dealt.groupBy("dim", "block").agg(F.max("sq").alias("sq"), F.array(*sides).alias("sides"))
    spent.append(ranges := written(ranges.withColumn("bp", F.pmod(F.xxhash64("block"), F.lit(max(1, n // block // BLOCK))).cast("int")), "ranges"))
    asked = dealt.join(queries.select("row").hint("merge"), "row", "left_semi")
    parts = max(1, -(-m // BLOCK))
    spent.append(asked := written(asked.drop("block").withColumn("qp", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")), "queries"))

    def block_bounds(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"row": pd.Series(dtype="int64"), "block": pd.Series(dtype="object"), "bound": pd.Series(dtype="float64")})
        span = stacked(r["sides"], np.float64)
        b = score_bounds(stacked(q["dist"], np.float64), q["sq"].to_numpy(), span[:, :pivots], span[:, pivots:], r["sq"].to_numpy())
        return pd.DataFrame({"row": np.repeat(q["row"].to_numpy(), len(r)), "block": np.tile(r["block"].to_numpy(), len(q)), "bound": b.reshape(-1)})

    grid = lambda df, name, most: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    left = grid(asked.select("dim", "qp", "row", "sq", "dist"), "bp", max(1, n // block // BLOCK)).groupBy("dim", "qp", "bp")
    bounds = left.cogroup(grid(ranges, "qp", parts).groupBy("dim", "qp", "bp")).applyInPandas(block_bounds, "row long, block string, bound double")
    spent.append(bounds := written(bounds.withColumn("place", F.row_number().over(W.partitionBy("row").orderBy(F.desc("bound"), "block"))), "bounds"))

    def search(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("row", "vec_id", "score")})
        sides = [{"row": t["row"].to_numpy(), "id": t["id"].to_numpy(), "v": stacked(t["v"], np.int64), "sq": t["sq"].to_numpy(), "dist": stacked(t["dist"], np.float64)} for t in (q, r)]
        sides[0]["least"] = q["least"].fillna(-np.inf).to_numpy()
        return pd.DataFrame(dict(zip(("row", "vec_id", "score"), search_block(*sides, k))))

    best, by_score = None, W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    for first, last in zip((0, *ROUNDS), (*ROUNDS, None)):
        pairs = bounds.where(F.col("place") > first) if last is None else bounds.where((F.col("place") > first) & (F.col("place") <= last))
        least = F.lit(None).cast("double").alias("least")
        if best is not None:
            worst = best.groupBy("row").agg(F.min("score").alias("worst"), F.count("*").alias("n")).where(F.col("n") == k).select("row", F.col("worst").cast("double").alias("least"))
            pairs = pairs.join(worst.hint("merge"), "row", "left").where("least is null or bound >= least")
            least = F.col("least")
        spent.append(pairs := written(pairs.select("row", "block", least), "pairs"))
        if pairs.isEmpty():
            break
        mine = pairs.join(asked.hint("merge"), "row").select("block", "qp", "row", "id", "v", "sq", "dist", "least")
        need = mine.select(F.col("block").alias("rb"), F.col("qp").alias("part")).distinct()
        rows = dealt.join(need.hint("merge"), F.col("block") == F.col("rb")).select("rb", "part", "row", "id", "v", "sq", "dist")
        new = mine.groupBy("block", "qp").cogroup(rows.groupBy("rb", "part")).applyInPandas(search, "row long, vec_id long, score long")
        new = new if best is None else best.select("row", "vec_id", "score").union(new)
        spent.append(best := written(new.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k), "best"))
    if best is None:
        best = bounds.select("row", F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score"), F.lit(0).alias("rank")).limit(0)
    out = written(best.join(queries.select("row", F.col("id").alias("query_id")).hint("merge"), "row").select("query_id", "rank", "vec_id", "score"), "top")
    for t in spent:
        discard(t)
    return out


def query_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(integer_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors, vectors.where(F.col("id") % 50 == 0))


SQL_TOP_K = """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.own, q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(r.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.own <> r.own AND len(q.x) = len(r.x) WHERE q.vec_id % 50 = 0
), t AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5
"""
