import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.common import written
from tidemark.llm.cost_packing import balanced_plan, items, pack_by_cost, placed

FILE = public_tokenizers.path("word_bpe_49k.json")


def naive(lengths, capacity, linear):
    """The rule document by document: cheapest sequence with room, else cut for the roomiest; costs of the sequences in the end."""
    total = sum(lengths)
    rooms = [capacity] * (total // capacity) + [1 << b for b in reversed(range(20)) if total % capacity >> b & 1]
    room, cost, left, cuts = list(rooms), [0] * len(rooms), sorted(lengths), 0
    while left:
        n = left.pop()
        fits = [i for i in range(len(room)) if room[i] >= n]
        if fits:
            i = min(fits, key=lambda i: (cost[i], i))
            room[i] -= n
            cost[i] += linear * n + n * n
        else:
            most = max(room)
            i = min((i for i in range(len(room)) if room[i] == most), key=lambda i: (cost[i], i))
            room[i], cuts = 0, cuts + 1
            left = sorted([*left, n - most])
    return rooms, cost, cuts


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_the_rule_one_by_one(seed):
    rng = random.Random(seed)
    lengths = [min(64, 1 + int(rng.expovariate(1 / rng.choice([4, 12, 40])))) for _ in range(rng.randint(1, 400))]
    histogram = {k: lengths.count(k) for k in set(lengths)}
    runs = balanced_plan(histogram, 64, 10)
    length = np.repeat(list(histogram), list(histogram.values()))
    rank = np.concatenate([np.arange(n) for n in histogram.values()])
    which, start, size, seq, offset = placed(runs, length, rank)
    rooms, cost, cuts = naive(lengths, 64, 10)
    # each token of a document once, each place of a sequence once
    assert sorted(zip(which[np.repeat(np.arange(len(which)), size)], np.concatenate([np.arange(s, s + n) for s, n in zip(start, size)]))) == [(i, j) for i, n in enumerate(length) for j in range(n)]
    filled = {}
    for s, o, n in sorted(zip(seq, offset, size)):
        assert o == filled.get(s, 0)
        filled[s] = o + n
    assert [filled[i] for i in range(len(rooms))] == rooms and len(which) == len(lengths) + cuts
    if not cuts:  # costs are those of whole documents
        mine = np.bincount(seq, 10 * size + size * size, len(rooms))
        assert sorted(mine) == sorted(cost)


def check(out, docs):
    tok = Tokenizer.from_file(FILE)
    want = []
    for r in docs.collect():
        want.append((r["doc_id"], np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [1], dtype="<u4")))
    assert out["length"].sum() == sum(len(x) for _, x in want)
    x = out.sort_values(["sequence_id", "offset"])
    ends = x.groupby("sequence_id")["length"].sum()
    assert (x["offset"] == x.groupby("sequence_id")["length"].cumsum() - x["length"]).all()
    odd = ends[ends != 2048]
    assert (ends <= 2048).all() and all(n & (n - 1) == 0 for n in odd) and len(odd) == len(set(odd))
    texts = {}
    for doc, ids in want:
        texts.setdefault(doc, []).append(ids)
    for r in out.itertuples():
        doc = None if r.doc_id != r.doc_id else r.doc_id
        assert any(len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in texts[doc])
    single = {d: v[0] for d, v in texts.items() if len(v) == 1 and d is not None}
    for doc, ids in single.items():
        g = out[out["doc_id"] == doc].sort_values("start")
        assert (g["start"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() == len(ids)


def test_whole_documents(docs):
    out = pack_by_cost(written(items(docs, FILE))).toPandas()
    check(out, docs)


def test_odd_empty_and_repeated_rows(spark, odd_docs, no_docs):
    check(pack_by_cost(written(items(odd_docs, FILE))).toPandas(), odd_docs)
    assert not len(pack_by_cost(written(items(no_docs, FILE))).toPandas())
    copies = spark.range(3000).selectExpr("7L AS doc_id", "'same words here' AS text")
    out = pack_by_cost(written(items(copies, FILE))).toPandas()
    assert not out.duplicated(["sequence_id", "offset"]).any()
    check(out, copies)
