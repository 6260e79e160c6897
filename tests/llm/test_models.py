import math
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import common, maxent_lm, toxicity


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_base_scores_are_exact(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", lowered(r["text"])) + [None] for r in docs.collect()}
    c = Counter(w for i, ws in text.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    rows = maxent_lm.language_model_scores(docs, block_bytes=50_000).collect()
    assert len(rows) == len(text)
    for r in rows:
        ws = text[r["doc_id"]]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 5 and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)


def test_the_model_beats_the_base_on_held_out_texts(spark):
    rows = maxent_lm.language_model_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.9 * sum(r["base_score"] for r in rows)  # logarithms: a tenth better


def test_scores_do_not_depend_on_partitions(spark, docs):
    found = [{r["doc_id"]: r["score"] for r in maxent_lm.language_model_scores(docs.repartition(n), block_bytes=60_000).collect()} for n in (1, 7)]
    assert found[0].keys() == found[1].keys()
    assert all(abs(x - found[1][i]) < 1e-4 * abs(x) for i, x in found[0].items())


def test_language_model_on_odd_and_empty_tables(odd_docs, no_docs):
    rows = maxent_lm.language_model_scores(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(math.isfinite(r["score"]) for r in rows)
    assert maxent_lm.language_model_scores(no_docs).count() == 0


def test_next_words_sum_to_one():
    """p(word | history) over all words of the vocabulary, the end and the unseen word, for random weights and histories."""
    rng = np.random.default_rng(0)
    m, size = maxent_lm, 64
    vocabulary = rng.integers(1, 2**60, 80, dtype=np.uint64) * np.uint64(8)
    vocabulary[9] = m.END
    cls = np.concatenate([np.arange(m.SINGLE), m.SINGLE + np.arange(80 - m.SINGLE) % (m.UNSEEN - m.SINGLE)])
    share = rng.random(80)
    share /= np.bincount(cls, weights=share, minlength=m.CLASSES)[cls]
    unseen = np.uint64(123456)
    index = {int(h): i for i, h in enumerate(vocabulary)}
    votes = rng.normal(0, 1, (m.CELLS, m.GROUPS)).astype(np.float32)
    weights, bias = rng.normal(0, 1, (3 * size + 2 * m.GROUPS + 1, m.CLASSES)).astype(np.float32), rng.normal(0, 1, m.CLASSES).astype(np.float32)
    words = [vocabulary[i] for i in range(80) if i != 9]
    for length in (0, 1, 2, 15):
        history = [words[i] for i in rng.integers(0, 12, length)] + [unseen] * (length > 5)
        total = np.zeros(len(m.AGAIN))
        for w in [*vocabulary, unseen]:
            hashes = np.array([*history, w, m.END], np.uint64)
            cut = np.array([0, len(hashes)])
            k = np.array([cls[index[int(h)]] if int(h) in index else m.UNSEEN for h in hashes])
            u = np.array([share[index[int(h)]] if int(h) in index else 1.0 for h in hashes])
            which = np.unique(hashes, return_inverse=True)[1]
            code = k.astype(np.uint32) | (hashes >> np.uint64(3) & np.uint64(0xFFFF)).astype(np.uint32) << np.uint32(8) | m.running_groups(hashes, cut, votes)[0].astype(np.uint32) << np.uint32(24)
            at = len(history)
            p = m.class_logs(code, cut, weights, bias, size)[at]
            total += 10 ** (p + m.word_terms(which, np.zeros(len(hashes), np.int64), k, u)[at])
        assert np.allclose(total, 1, atol=1e-4), total


def plain_steps(code, cut, weights, bias, size):
    """maxent_lm.block_steps with fancy indexing and np.add.reduceat."""
    m, w = maxent_lm, np.vstack([weights, bias[None]])
    scale = np.full(len(w), 1e-2, np.float32)
    for lo, hi, _, target, rows in m.histories(code, cut, size, m.STEP_TOKENS):
        x = np.exp(np.minimum(w[rows[0]] + w[rows[1]] + w[rows[2]] + w[rows[3]] + w[-1], 60))
        x *= (-1 / x.sum(1))[:, None]
        x[np.arange(hi - lo), target] += 1
        for r in [*rows, np.full(hi - lo, len(w) - 1)]:
            order = np.argsort(r, kind="stable")
            own = r[order]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            total = np.add.reduceat(x[order], first)
            scale[own[first]] += (total * total).mean(-1)
            w[own[first]] += m.RATE * total / np.sqrt(scale[own[first]])[:, None]
    return w, np.flatnonzero(scale > 1e-2)


def seconds(run):
    times = []
    for _ in range(3):
        begin = time.thread_time()
        out = run()
        times.append(time.thread_time() - begin)
    return min(times), out


def test_gradient_steps_are_those_of_plain_sums_in_less_time():
    rng, m, size = np.random.default_rng(3), maxent_lm, 1 << 13
    n = 3 * m.STEP_TOKENS + 77
    word = (50_000 ** rng.random(n)).astype(np.uint32)  # as often as their ranks say
    code = word % m.CLASSES | (word % 7 == 0).astype(np.uint32) << 7 | (word * 40503 & 0xFFFF) << 8 | rng.integers(0, 2 * m.GROUPS + 1, n).astype(np.uint32) << 24
    code, cut = code.astype(np.uint32), np.append(np.arange(0, n, 90), n)
    weights, bias = rng.normal(0, 0.1, (3 * size + 2 * m.GROUPS + 1, m.CLASSES)).astype(np.float32), rng.normal(0, 1, m.CLASSES).astype(np.float32)
    plain, (w, moved) = seconds(lambda: plain_steps(code, cut, weights, bias, size))
    own, (v, also) = seconds(lambda: m.block_steps(code, cut, weights, bias, size))
    assert np.allclose(v, w, atol=1e-3) and (moved == also).all()
    assert own < 0.75 * plain, (own, plain)


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 65, 3000])
def test_segment_sums(n):
    rng = np.random.default_rng(n)
    x, at = rng.normal(size=(max(n, 1), 3)), rng.permutation(n)
    first = np.unique(np.append(rng.integers(0, max(n, 1), n // 9), 0))[: max(n, 0)]
    want = np.array([x[p].sum(0) for p in np.split(at, first[1:])]) if n else np.zeros((0, 3))
    assert np.allclose(maxent_lm.segment_sums(x, at, first), want)


def test_terms_of_a_text_are_the_sums_of_its_tokens():
    rng = np.random.default_rng(1)
    cut = np.cumsum([0, 1, 16, 17, 200, 1, 33])
    which = np.minimum(rng.zipf(1.3, cut[-1]), 60) - 1
    doc, cls, share = np.repeat(np.arange(6), np.diff(cut)), which % 5, np.full(cut[-1], 1e-12)
    share[which > 3] = 0.02
    assert np.allclose(maxent_lm.word_terms(which, doc, cls, share, cut=cut), np.add.reduceat(maxent_lm.word_terms(which, doc, cls, share), cut[:-1]), rtol=1e-12)


def test_word_hashes_are_those_of_each_word_alone_in_bounded_memory():
    base, most = common._BASE, (1 << 64) - 1
    texts = ["Ab\x0bc", None, "", "x " * 40_000 + "END", "w" * (common.HASH_BYTES + 9) + " y", "é🙂 Ünï"]
    doc, got, _ = common.words(pa.array(texts), lower=True)
    words = [(i, w) for i, t in enumerate(texts) for w in re.findall(rb"[^\x20\x09-\x0D]+", lowered(t).encode())]
    assert doc.tolist() == [i for i, _ in words]
    for w, h in {w: h for (_, w), h in zip(words, got)}.items():
        total, power = 0, 1
        for byte in w:
            total, power = total + int(common._BYTE_KEYS[byte]) * power & most, power * base & most
        assert common.mix(np.array([total], np.uint64))[0] == h
    text = pa.array(["some words of a text " * 100] * 1000)
    tracemalloc.start()
    maxent_lm.token_hashes(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * text.nbytes


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_is_the_levenshtein_ball():
    rng = np.random.default_rng(5)
    words, stems = ["loser", "moron", "idiot", "worthless", "bad"], ["vequ"]
    a = toxicity.Automaton(words, stems, frozenset({"moron"}))
    allowed = {w: 0 if w == "moron" else toxicity.edits_allowed(w) for w in words}
    tried = list(words) + ["vequta", "veq", "vequ"]
    for w in words * 60:
        x = list(w)
        for _ in range(int(rng.integers(1, 4))):
            k = int(rng.integers(0, len(x) + 1))
            x = [x[:k] + x[k + 1 :], x[:k] + ["z"] + x[k:], x[:k] + ["o"] + x[k + 1 :]][int(rng.integers(0, 3))]
        tried.append("".join(x))
    tried = [t for t in tried if t]
    code, _, starts, ends = toxicity.tokens([" ".join(tried)])
    state = a.read(code, starts, ends)
    for t, s in zip(tried, state):
        near = [w for w in words if distance(t, w) <= allowed[w]]
        stem = t.startswith("vequ")
        assert (a.hit[s] >= 0) == bool(near or stem), t
        if near and not stem:
            assert a.distance[s] == min(distance(t, w) for w in near)


def made_up(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abdefghiklmnoprstu"), int(rng.integers(3, 8))))
    bad, docs, labels = ["loser", "worthless", "scumbag"], [], []
    for i in range(1200):
        ws, toxic = [word() for _ in range(60)], int(i % 5 == 0)
        if toxic:
            for _ in range(2):
                w = bad[int(rng.integers(0, 3))]
                ws[int(rng.integers(0, 60))] = w if i % 10 else w[:2] + "x" + w[3:]
        docs.append((i, " ".join(ws)))
        labels.append((i, 1, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_texts_with_misspellings(spark):
    docs, labels = made_up(spark)
    out = toxicity.score(docs, toxicity.train(docs, labels)).where("pmod(crc32(cast(doc_id AS string)), 4) = 2").toPandas()
    truth, guess = out["doc_id"] % 5 == 0, out["tox_score"] >= toxicity.THRESHOLD
    assert (guess & ~truth).sum() == 0 and (guess & truth).sum() >= 0.95 * truth.sum()


def test_toxicity_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    docs, labels = made_up(spark)
    model = toxicity.train(docs, labels)
    out = toxicity.score(odd_docs, model)
    assert out.count() == odd_docs.count() and out.where("tox_score is null or tox_score not between 0 and 1").count() == 0
    assert toxicity.score(no_docs, model).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, none).where(f"tox_score >= {toxicity.THRESHOLD}").count() == 0


def test_quoted_hits_count_apart():
    a = toxicity.Automaton(["loser"], [])
    x, _ = toxicity.hits(["you loser go", "he wrote \"you loser go\" then", "nothing here"], a, frozenset())
    assert x[0, 0] > 0 and x[0, 3] == 0 and x[1, 0] == 0 and x[1, 3] > 0 and not x[2].any()


@pytest.mark.parametrize("text, words", [("Hello, ###World### x", ["hello", "world", "x"]), ("", []), ("***", [])])
def test_words_without_marks(text, words):
    code, _, s, e = toxicity.tokens([text])
    assert [code[a:z].tobytes().decode("utf-32-le") for a, z in zip(s, e)] == words


def test_terms_of_other_scripts_match_their_own_words():
    from tidemark.llm import toxicity

    model = toxicity.Automaton(["дурак", "βλάκας", "笨蛋"], ["идиот"])
    for word, term in (("Дурак", "дурак"), ("дуррак", "дурак"), ("βλάκας", "βλάκας"), ("笨蛋", "笨蛋"), ("ИДИОТСКИЙ", "идиот"), ("привет", None), ("plain", None)):
        code, _, starts, ends = toxicity.tokens([word])
        hit = int(model.hit[model.read(code, starts, ends)[0]])
        assert (model.terms[hit] if hit >= 0 else None) == term
