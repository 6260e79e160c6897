import math
import re

import numpy as np
import pytest

from tidemark.llm import mixing, topk


def brute(rows, k, every):
    ok = {i: np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64) for i, v in rows if v is not None and None not in v and all(map(math.isfinite, v))}
    out = set()
    for q in ok:
        if q % every == 0:
            scores = sorted((-int(ok[q] @ ok[x]), x) for x in ok if x != q and len(ok[x]) == len(ok[q]))[:k]
            out |= {(q, r + 1, x, -s) for r, (s, x) in enumerate(scores)}
    return out


@pytest.mark.parametrize("block", [40, 4096])
def test_top_k_equals_brute_force(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(60)]  # ties
    rows += [(400, None), (401, [0.1, None] * 4), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (450, [0.5] * 3), (451, [0.25] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = topk.integer_vectors(df)
    got = {tuple(r) for r in topk.top_k(v, v.where("id % 50 = 0"), 5, pivots=6, block=block).collect()}
    assert got == brute(rows, 5, 50)


def test_bounds_leave_most_rows_out():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 60, (20, 16))
    rows = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 4, (4000, 16)))
    pivots = rows[:24]
    d = topk.distances(rows, pivots)
    true = np.sqrt(((rows[100] - rows) ** 2).sum(1))
    assert (np.abs(d - d[100]).max(1) <= true + 1e-6).all()


def test_repeated_ids_and_large_values(spark):
    """Rows that share an id are candidates of one another and queries of their own; products beyond 2**53 are exact."""
    rows = [(50, [1.0, 0.0]), (50, [0.5, 0.5]), (1, [0.25, 0.0]), (50, [1.0, 0.0])]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1))
    got = sorted(tuple(r) for r in topk.top_k(v, v.where("id = 50"), 5, pivots=2).collect())
    lists = {0: [(50, 65536), (50, 32768), (1, 16384)], 1: [(50, 32768), (50, 32768), (1, 8192)], 3: [(50, 65536), (50, 32768), (1, 16384)]}
    assert got == sorted((50, r + 1, i, s) for x in lists.values() for r, (i, s) in enumerate(x))
    big = [(i, [float(2**20 + i), float(2**20 - i)]) for i in range(8)]
    v = topk.integer_vectors(spark.createDataFrame(big, "vec_id long, embedding array<double>").coalesce(1))
    assert {tuple(r) for r in topk.top_k(v, v.where("id % 2 = 0"), 3, pivots=3).collect()} == brute(big, 3, 2)


def test_blocks_are_eliminated(spark):
    """Clustered vectors: queries meet few of the blocks, and the result stays exact."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (6, 8))
    rows = [(i, [float(x) for x in np.float32(centres[i % 6] + rng.normal(0, 0.02, 8))]) for i in range(600)]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1))
    assert {tuple(r) for r in topk.top_k(v, v.where("id % 50 = 0"), 5, pivots=12, block=40).collect()} == brute(rows, 5, 50)
    p = topk.choose_pivots(v, 12)[8]
    x = np.array([r["v"] for r in v.collect()], dtype=np.float64)
    t, sq = topk.distances(x, p), (x * x).sum(1)
    near = t.argmin(1)
    low, high, most = (np.array([f(a[near == c]) for c in np.unique(near)]) for f, a in ((lambda y: y.min(0), t), (lambda y: y.max(0), t), (lambda y: y.max(), sq)))
    bound = topk.score_bounds(t[:12], sq[:12], low, high, most)
    kth = np.sort(x[:12] @ x.T, 1)[:, -6]
    assert (bound >= kth[:, None]).mean() < 0.7


def test_empty_vectors(spark):
    v = topk.integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(v, v).count() == 0


def tokens(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1


@pytest.mark.parametrize("options", [{}, {"target_entropy": 1.0, "repetition_limit": 1.5, "budget": None}, {"target_entropy": 1.0, "repetition_limit": 50.0, "budget": 2.5}])
@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_mix_meets_its_budgets(spark, monkeypatch, options, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), ["big", "mid", "small", None][int(rng.choice(4, p=[0.7, 0.2, 0.06, 0.04]))]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, **options).toPandas()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + tokens(t)
    total, multiple = sum(size.values()), options.get("budget", 1.0)
    weight = {s: got[got["source"].isna() if s is None else got["source"] == s]["mix_weight"].iloc[0] for s in size}
    assert abs(sum(weight.values()) - 1) < 1e-9
    multiple = multiple if multiple is not None else 1 / min(weight[s] / (size[s] / total) for s in size)
    for s in size:
        mine = got[got["source"].isna() if s is None else got["source"] == s]
        over = mine["mix_tokens"].sum() - weight[s] * multiple * total
        assert -1 <= over < 60
        assert weight[s] * multiple / (size[s] / total) <= options.get("repetition_limit", 4.0) * (1 + 1e-6)
    assert not got.duplicated(["doc_id", "mix_pass"]).any()
    if options.get("budget", 1.0) is None:
        assert set(got["doc_id"]) == set(range(900))
    first = got[got["mix_pass"] == 0]
    assert (first["mix_block"] == (first["mix_key"] % 1024)).all()


def test_mix_of_odd_and_empty_tables(odd_docs, no_docs):
    out = mixing.mix_sources(odd_docs, budget=None, repetition_limit=2.0)
    assert set(out.columns) > set(odd_docs.columns) and out.select("doc_id").distinct().count() == odd_docs.select("doc_id").distinct().count()
    assert mixing.mix_sources(no_docs).count() == 0


def test_mix_equals_brute_force(spark):
    """Every row and pass of the mix, from shares, exponent, budgets and permutations computed plainly."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), ["a", "b", "c", None][int(rng.choice(4, p=[0.8, 0.1, 0.06, 0.04]))]) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + tokens(t)
    total = sum(size.values())

    def weights(a):
        x = {s: (n / total) ** a for s, n in size.items()}
        return {s: v / sum(x.values()) for s, v in x.items()}

    for goal, limit in ((0.8, 4.0), (1.0, 3.0)):
        lo, hi = 0.0, 1.0
        for _ in range(60):
            a = (lo + hi) / 2
            w = weights(a)
            entropy = -sum(v * math.log(v) for v in w.values())
            met = entropy >= goal * math.log(len(w)) or max(w[s] * total / size[s] for s in w) >= limit
            lo, hi = (a, hi) if met else (lo, a)
        w, want = weights(hi), set()
        for s in size:
            take = w[s] * total
            passes = math.floor(take / size[s] + 1e-9)
            own = df.where(F.col("source").eqNullSafe(F.lit(s))).withColumn("_row", F.xxhash64("doc_id", "text", "source"))
            own = own.withColumn("k", mixing.pass_key(F.lit(passes), mixing.SEED)).select("doc_id", "text", "k", "_row", mixing.block(F.col("k")).alias("b1"), mixing.small_block(F.col("k")).alias("b2")).collect()
            want |= {(r["doc_id"], p) for r in own for p in range(passes)}
            left = take - passes * size[s]
            for r in sorted(own, key=lambda r: (r["b1"], r["b2"], r["k"], r["_row"])):
                if left < 0.5:
                    break
                want.add((r["doc_id"], passes))
                left -= tokens(r["text"])
        got = {(r["doc_id"], r["mix_pass"]) for r in mixing.mix_sources(df, target_entropy=goal, repetition_limit=limit).collect()}
        assert len(got ^ want) <= 4, (len(got), len(want), sorted(got ^ want, key=str)[:9])  # budgets that differ by less than a token


def test_mix_bears_internal_names(spark):
    df = spark.createDataFrame([(i, f"w {i}", "ab"[i % 2], 0.5, i, {"k": i}, "x", 7, 8) for i in range(30)], "doc_id long, text string, source string, weight double, passes int, top map<string,int>, cut1 string, _source int, _row int")
    out = mixing.mix_sources(df, budget=None)
    assert out.columns[: len(df.columns)] == df.columns
    assert {(r["doc_id"], r["_row"], r["_source"], r["top"]["k"]) for r in out.collect()} == {(i, 8, 7, i) for i in range(30)}
