import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import spelling
from tidemark.llm.common import written
from tidemark.llm.spelling import roots, spelling_groups, word_counts


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, times=10):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= times * n else None
        out[w] = (n, len(near), form, counts[form] if form else None)
    rows = {}
    for w, (n, k, form, m) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows[w] = (w, n, k, form, m, root)
    return rows


def as_words(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    return written(df.select(F.encode("word", "ISO-8859-1").alias("w"), "n"))


def check(df, counts):
    got = {r["word"]: tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()}
    want = brute(counts)
    assert len(got) == len(want)
    assert not [(got.get(w), r) for w, r in want.items() if got.get(w) != r][:5]


@pytest.mark.parametrize(("seed", "alphabet", "shortest", "longest", "dense"), [(1, "ab", 1, 8, 4), (2, "abé", 3, 7, 3), (3, "aaab", 7, 12, 2), (4, "abcdefghijÿ", 5, 6, 512)])
def test_near_words_equal_brute_force(spark, seed, alphabet, shortest, longest, dense):
    rng = random.Random(seed)
    counts = {"".join(rng.choice(alphabet) for _ in range(rng.randint(shortest, longest))): rng.choice([2, 3, 3, 20, 30, 200, 5000]) for _ in range(350)}
    check(spelling_groups(as_words(spark, counts), dense=dense), counts)


def test_hot_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HOT", 20)  # keys of a twentieth of the members are hot
    monkeypatch.setattr(spelling, "TOGETHER", 3)
    rng = random.Random(9)
    counts = {"prefix" + "".join(rng.choice("abcd") for _ in range(6)): rng.randint(2, 99) for _ in range(300)}
    check(spelling_groups(as_words(spark, counts), dense=8), counts)


def test_long_words_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TILE", 16)
    rng = random.Random(4)
    base = "".join(rng.choice("abc") for _ in range(20_000))
    counts = {base: 50, base[:9000] + "z" + base[9001:]: 4, base[:-1]: 700, base[1:]: 3, "x" + base[1:]: 9}
    counts |= {"aaaaaaa" + x: 2 for x in ("", "a", "b", "ab", "ba", "bb", "aa")}
    check(spelling_groups(as_words(spark, counts)), counts)


def test_roots_follow_long_chains(spark):
    forms = [(f"w{i}".encode(), f"w{i + 1}".encode()) for i in range(23)] + [(b"x", b"w20")]
    got = {bytes(r["w"]): bytes(r["root"]) for r in roots(written(spark.createDataFrame(forms, "w binary, form binary"))).collect()}
    assert len(got) == 24 and set(got.values()) == {b"w23"}


def test_words_of_texts(spark, odd_docs, no_docs, docs):
    for df in (docs, odd_docs, no_docs):
        counts = Counter()
        for r in df.collect():
            for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
                run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] += 1
        want = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
        got = {bytes(r["w"]).decode("latin-1"): r["n"] for r in word_counts(df).collect()}
        assert got == want
    assert not spelling_groups(written(word_counts(no_docs))).count()
