import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, neardup
from tidemark.llm.components import components


def bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def brute(rows):
    bags, parent = [bag(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, b in enumerate(bags):
        for s in b:
            holders.setdefault(s, []).append(i)
    for a, c in {p for h in holders.values() for p in itertools.combinations(h, 2)}:
        both = sum((bags[a] & bags[c]).values())
        if both >= 0.8 * (sum(bags[a].values()) + sum(bags[c].values()) - both):
            parent[find(a)] = find(c)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return Counter((rows[i][0], min((rows[j][0] for j in g if rows[j][0] is not None), default=None)) for g in groups.values() for i in g)


def classes(df):
    return Counter((r["doc_id"], r["class_id"]) for r in neardup.duplicate_classes(df).collect())


def test_classes_equal_brute_force(spark, docs):
    extra = [(10**6 + i, t) for i, t in enumerate(["", None, "a b", "A b", "a b c d e f", "  a b c d e f ", " ".join(["x y z"] * 300), " ".join(["x y z"] * 290)])] + [(5, "other text here")] * 2
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    assert classes(df) == brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_a_chain_and_a_large_group(spark):
    """Near copies by the hundred, and a chain whose ends are unlike: all linked through their neighbours."""
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    base, rows = word(120), []
    for i in range(150):
        x = list(base)
        x[int(rng.integers(0, 120))] = f"new{i}"
        rows.append((i, " ".join(x)))
    chain = word(300)
    for i in range(8):
        rows.append((1000 + i, " ".join(chain[12 * i : 12 * i + 200])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert classes(df) == brute(rows)


def test_hundreds_of_clusters_in_large_buckets(spark):
    """Texts that are mostly one passage share large buckets; only near copies in pairs and triples belong together."""
    rng = np.random.default_rng(11)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage, rows = word(174), []
    for i in range(300):
        own = word(9)
        rows += [(3 * i + j, " ".join(passage + own + word(18))) for j in range(2 + i % 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len({c for _, c in want}) == 300
    assert classes(df) == want


def test_pairs_inside_one_body(spark):
    """600 texts of one long body: a pair's similarity is 0.827, that of others 0.793, so every text is in every large bucket."""
    rng = np.random.default_rng(23)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**7, n)]
    body, rows = word(600), []
    for i in range(300):
        own = word(14)
        rows += [(2 * i + j, " ".join(body + own + word(64))) for j in range(2)]
    got = classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert got == Counter((i, i // 2 * 2) for i, _ in rows)


def test_one_row_of_each_class_stays(spark):
    """Repeated and null ids: classes are of texts, and none is lost."""
    a, b, c = "one two three four five six seven", "other words stand in this text here", "and a third text without any id at all"
    rows = [(5, a, 1), (5, b, 2), (1, b, 3), (None, c, 4), (None, c, 5), (None, a, 6), (7, b, 7), (7, b, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, copies long")
    got = sorted((r["text"], r["doc_id"]) for r in neardup.without_copies(df).collect())
    assert got == sorted([(a, 5), (b, 1), (c, None)])
    assert neardup.without_copies(df).columns == df.columns
    mapped = df.withColumn("_key", F.create_map(F.lit("k"), F.col("copies")))
    assert sorted((r["text"], r["_key"]["k"]) for r in neardup.without_copies(mapped).collect() if r["doc_id"] != None) == sorted([(a, 1), (b, 3)])  # noqa: E711
    assert neardup.without_copies(df.limit(0)).count() == 0


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 3)
    rows = [(i, "the very same text of more than five words" if i % 2 else f"text {i} of its own {i + 1} {i + 2} {i * 7}") for i in range(60)]
    want = Counter((i, 1 if i % 2 else i) for i, _ in rows)
    assert classes(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_processes_are_split_alike():
    """A weight's processes end in its units, and those that two weights share have the same points."""
    own, low, x = neardup.split_processes(np.full(3, 12345, np.uint64), np.array([1, 6, 700]), np.full(3, 1e9))
    points = [dict(zip(low[own == i].tolist(), x[own == i])) for i in range(3)]
    assert [sorted(p) for p in points] == [list(range(n)) for n in (1, 6, 700)]
    assert points[0].items() <= points[1].items() <= points[2].items()
    assert abs(np.mean(list(points[2].values())) - 1) < 0.15  # first points of processes of rate 1


def test_odd_and_empty_tables(odd_docs, no_docs):
    assert sum(classes(odd_docs).values()) == odd_docs.count()
    assert not classes(no_docs)
    got = {(r["doc_id"], r["class_id"]) for r in neardup.duplicate_classes(odd_docs).collect()}
    assert (6, 5) in got and (1, 0) in got and (None, None) in got


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    x = np.sort(rng.integers(0, 2**63, 400, dtype=np.uint64))
    wa, wb = rng.integers(1, 9, 400), rng.integers(1, 9, 400)
    want, got = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum(), []
    for seed in range(30):
        h = neardup.mix(x + np.uint64(seed * 7919))
        sig = [neardup.bag_signatures(np.zeros(400, np.int64), h, w, 1)[0] for w in (wa, wb)]
        got.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(got) - want) < 0.04


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[find(a)] = find(b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == set(parent)
    pairs = {(find(n), r) for n, r in got.items()}
    assert len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})


@pytest.mark.parametrize("text", ["", "a", "a b c d", "a b c d e"])
def test_short_texts_have_at_most_one_shingle(text):
    import pyarrow as pa

    doc, hashes, counts = neardup.words(pa.array([text]), lower=True)
    assert len(neardup.shingles(doc, hashes, counts)[0]) == min(1, len(text.split()))


@pytest.mark.parametrize("cells", [3, 1 << 12])
def test_the_exact_finish_needs_no_counts_by_element(spark, monkeypatch, cells):
    """Elements go out for the prefixes alone, and whatever cells they fall into, all similar pairs of different roots are found."""
    monkeypatch.setattr(neardup, "CELLS", cells)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    bags = [np.sort(np.concatenate([rng.choice(base, 50 + i % 9, replace=False), rng.integers(0, 2**63, i % 5, dtype=np.uint64)])) for i in range(80)]
    rows = spark.createDataFrame([(i, i // 20) for i in range(80)], "node long, root long")
    bag = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(bags)], "node long, bag binary")
    first = neardup.prefixes(bag.join(rows, "node").select("node", "bag", "root"), neardup.cell_counts(bag), 0.8)
    assert first.count() == sum(len(x) - int(np.ceil(0.8 * len(x) - 1e-6)) + 1 for x in bags)
    got = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in neardup.apart(rows, bag, 0.8).collect()}
    shared = {(i, j): len(np.intersect1d(bags[i], bags[j])) for i in range(80) for j in range(i) if i // 20 != j // 20}
    want = {(j, i) for (i, j), n in shared.items() if n >= 0.8 * (len(bags[i]) + len(bags[j]) - n)}
    assert len(want) > 50 and want <= got


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    sc, jvm = spark.sparkContext, spark._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_few_pairs_do_not_shuffle_all_multisets(spark, monkeypatch, most):
    """Only what the pairs' nodes have is shuffled if pairs can be broadcast; the links are the same if they can't."""
    monkeypatch.setattr(neardup, "BROADCAST_NODES", most)
    rng = np.random.default_rng(8)
    bags = [np.sort(rng.integers(0, 2**63, 300, dtype=np.uint64)) for _ in range(1000)]
    bags[7], sig = np.sort(np.concatenate([bags[3][:290], bags[7][:10]])), b"\1" * 4 * neardup.PLACES
    compared = common.written(spark.createDataFrame([(i, sig, x.tobytes()) for i, x in enumerate(bags)], "node long, sig binary, bag binary").repartition(4))
    pairs = common.written(spark.createDataFrame([(3, 7), (3, 9), (12, 700)], "a long, b long"))
    before = shuffled(spark)
    assert [tuple(r) for r in neardup.verified(pairs, compared, 0.8).collect()] == [(3, 7)]
    assert most == 0 or shuffled(spark) - before < 100_000  # all multisets are 2.4 MB
