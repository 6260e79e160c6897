import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm.common import written
from tidemark.llm.packing import fullest, minimum_slack_plan, pack, tokenizer_pieces
from tidemark.llm.token_ids import TokenMemo

FILE = public_tokenizers.path("word_bpe_49k.json")


def test_ids_equal_whole_text_encoding():
    tok, rng = Tokenizer.from_file(FILE), random.Random(5)
    alphabet = "ab1²'<|é\x85\xa0 \nΣſßŉ́🙂_-İ5\x1f"
    texts = ["it's don't ##'s we'll", "İstanbul ΣΑΣ", "<|endoftext|> x<|startoftext|>y", "日本語 ok", ""] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    memo = TokenMemo(tok, most=200)  # small, so it starts anew often
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    for lo in range(0, len(texts), 50):
        b = bounds[lo : lo + 51]
        buf = np.frombuffer(b"".join(raw[lo : lo + 50]), dtype=np.uint8)
        ids, cut = memo.ids(buf, b - b[0])
        for t, a, z in zip(texts[lo : lo + 50], cut, cut[1:]):
            assert ids[a:z].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_fullest_is_the_best_subset():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= room}
        chosen = fullest(counts, room)
        assert sum(chosen) == max(sums) and all(chosen.count(k) <= counts[k] for k in chosen)


def test_plan_uses_every_piece_once():
    rng = random.Random(2)
    histogram = {rng.randint(1, 100): rng.randint(1, 500) for _ in range(60)}
    used = {}
    for times, need in minimum_slack_plan(histogram, 100):
        assert sum(k * n for k, n in need.items()) <= 100
        for k, n in need.items():
            used[k] = used.get(k, 0) + times * n
    assert used == histogram


def packed(docs):
    return pack(written(tokenizer_pieces(docs, FILE))).toPandas()


def check(out, rows, tok):
    assert len(out) == sum(max(1, -(-(len(tok.encode(t or "", add_special_tokens=False).ids) + 1) // 4096)) for t in rows)
    x = out.sort_values(["sequence_id", "offset"])
    assert (x.groupby("sequence_id")["length"].sum() <= 4096).all()
    assert (x["offset"] == x.groupby("sequence_id")["length"].cumsum() - x["length"]).all()


def test_packing_of_whole_documents(docs):
    tok, out = Tokenizer.from_file(FILE), packed(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check(out, texts.values(), tok)
    for doc, g in out.groupby("doc_id"):
        ids = np.array(tok.encode(texts[doc], add_special_tokens=False).ids + [1], dtype="<u4")
        for r in g.itertuples():
            assert r.start == r.piece * 4096 and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert out["sequence_id"].nunique() <= -(-out["length"].sum() // 4096) + 1


def test_odd_and_empty_tables(odd_docs, no_docs):
    check(packed(odd_docs), [r["text"] for r in odd_docs.collect()], Tokenizer.from_file(FILE))
    assert len(packed(no_docs)) == 0


def test_a_hot_length_is_spread(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'same words here' AS text")
    out = packed(docs)
    assert len(out) == 3000 and not out.duplicated(["sequence_id", "offset"]).any()
