import hashlib
import random

import numpy as np
import pytest

from tidemark.llm.common import written
from tidemark.llm.tree_codes import Tree, assign, codebook_digest, codes, gathered, integer_vectors, quantised, with_label_error


def brute(points, entries):
    d = ((points[:, None, :] - entries[None, :, :]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


@pytest.mark.parametrize("seed", range(20))
def test_dual_trees_assign_like_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, m, w = int(rng.integers(1, 700)), int(rng.integers(1, 70)), int(rng.integers(1, 6))
    wide = int(rng.choice([2, 40, 100_000]))  # narrow ranges give many ties
    points = rng.integers(-wide, wide + 1, (n, w)) + rng.integers(0, 4, (n, 1)) * 5 * wide
    entries = points[rng.integers(0, n, m)] if seed % 2 else rng.integers(-wide, wide + 1, (m, w))
    rows, book = Tree.over(points, 8), Tree.over(entries, 1)
    got = np.empty(n, np.int64)
    got[rows.order] = codes(rows, entries, book)
    want, _ = brute(points, entries)
    assert (got == want).all()
    sums, counts = np.zeros_like(entries), np.zeros(m, np.int64)
    gathered(rows, entries, book, sums, counts)
    for e in range(m):
        assert counts[e] == (want == e).sum() and (sums[e] == points[want == e].sum(0)).all()


def test_clustered_nodes_are_assigned_whole():
    rng = np.random.default_rng(3)
    middles = rng.integers(-1000, 1000, (16, 4))
    points = middles[rng.integers(0, 16, 4096)] + rng.integers(-5, 6, (4096, 4))
    rows, book = Tree.over(points, 32), Tree.over(middles, 1)
    whole, _, leaves = assign(rows, middles, book)
    assert (rows.end[whole] - rows.first[whole]).sum() > 3000 and len(leaves) < 128 // 4


def test_large_integers_are_exact():
    entries = np.array([[2**28, -(2**28)], [2**28 - 1, -(2**28)]])
    points = np.array([[2**28, -(2**28)], [2**28 - 1, 1 - 2**28], [-(2**28), 2**28]])
    assert (codes(Tree.over(points, 4), entries, Tree.over(entries, 1)) == brute(points, entries)[0]).all()


def lloyd(rows, parts, entries, rounds):
    """rows: (id, label, integers); ids ascending, nulls last."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = np.array([r[2] for r in rows], dtype=np.int64)
    books = np.split(np.array([r[2] for r in order[:entries]], dtype=np.int64), parts, axis=1)
    for _ in range(rounds):
        for p, y in enumerate(np.split(x, parts, axis=1)):
            c, _ = brute(y, books[p])
            for e in set(c.tolist()):
                books[p][e] = y[c == e].sum(0) // (c == e).sum()
    found = [brute(y, books[p]) for p, y in enumerate(np.split(x, parts, axis=1))]
    return [("".join(f"{f[0][i]:02x}" for f in found), int(sum(f[1][i] for f in found))) for i in range(len(rows))], books


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, error long, copies string")


def test_rounds_over_many_blocks(spark):
    rng = random.Random(1)
    rows = [(rng.choice([i, 7, None]), [rng.choice([0.1, -0.3, rng.gauss(0, 0.2)]) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(300)]
    df = table(spark, [(*r, 5, "x") for r in rows])
    coded, books = quantised(integer_vectors(df), 4, 16, 3, block=37, leaf=4)
    out = with_label_error(coded).collect()
    ints = [(i, label, np.floor(1024 * np.array(v)).astype(int).tolist()) for i, v, label in rows]
    want, want_books = lloyd(ints, 4, 16, 3)
    assert all((a == b).all() for a, b in zip(books, want_books))
    key = lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else v for v in x)
    assert sorted(((r["id"], r["label"], r["code"], r["error"]) for r in out), key=key) == sorted(((i, label, *w) for (i, label, _), w in zip(ints, want)), key=key)
    for label in (None, 1, 2):
        assert {r["label_error"] for r in out if r["label"] == label} == {sum(w[1] for r, w in zip(ints, want) if r[1] == label)}
    assert codebook_digest(books) == hashlib.sha256(",".join(map(str, np.concatenate([b.reshape(-1) for b in want_books]))).encode()).hexdigest()


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    bad = [None, [0.0, nan, 0.0, 0.0], [inf, 0.0, 0.0, 0.0], [None, 0.0, 0.0, 0.0], [], [1.0] * 5, [1.0] * 8, [1e30, 0.0, 0.0, 0.0]]
    good = [[0.0009, -0.0001, 0.5, 1.0], [3.0, -2.0, 1.0, 0.0]]
    df = table(spark, [(i, v, None, i, None) for i, v in enumerate(bad + good)])
    coded, books = quantised(integer_vectors(df))
    out = with_label_error(coded).collect()
    assert sorted((r["id"], r["code"], r["error"], r["label_error"]) for r in out) == [(8, "00000000", 0, 0), (9, "01010101", 0, 0)]
    assert [b[0][0] for b in books] == [0, -1, 512, 1024]


def test_empty_table(spark):
    coded, books = quantised(integer_vectors(table(spark, [])))
    assert not with_label_error(written(coded)).count() and not books
