"""Rows that are repeated whole, in any number, are rows of their own where rows count, and one where a bound of rows holds."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.llm.common import written
from tidemark.llm.mixing import mix_sources
from tidemark.llm.packing import numbered, pack, tokenizer_pieces
from tidemark.llm.pii import base_spans
from tidemark.llm.topk import SQL_TOP_K, integer_vectors, top_k
from tidemark.llm.toxicity import labelled_sample


def test_mixing_keeps_its_budget(spark):
    """Three rows repeated three hundred times beside a hundred others: no source takes more than its budget and one row."""
    rows = [(i, "a b c d e f g h i j k l m n", "s") for i in (1, 2, 3) for _ in range(300)] + [(100 + i, "a b c d", "t") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mix_sources(df, budget=0.18).toPandas()
    total = 900 * 15 + 100 * 5
    for s, x in out.groupby("source"):
        due = x["mix_weight"].iloc[0] * 0.18 * total
        assert due <= x["mix_tokens"].sum() + 1e-6 and x["mix_tokens"].sum() < due + x["mix_tokens"].max()
    assert out[out["source"] == "s"]["doc_id"].nunique() == 3
    whole = mix_sources(df, budget=None, repetition_limit=1.5).groupBy("doc_id").count().toPandas()
    assert (whole[whole["doc_id"] < 100]["count"] >= 300).all() and len(whole) == 103


def test_toxicity_sample_is_bounded_in_rows(spark):
    docs = spark.range(3000).selectExpr("3L AS doc_id", "concat('text ', id % 4) AS text").union(spark.range(50).selectExpr("id + 100", "'other'"))
    labels = spark.range(200).selectExpr("id AS doc_id", "1 AS toxic")
    assert labelled_sample(docs, labels, 10).count() <= 10
    assert sorted(r["text"] for r in labelled_sample(docs, labels, 1000).where("text LIKE 'text%'").collect()) == [f"text {i}" for i in range(4)]


def test_search_leaves_out_the_row_not_its_id(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 4)], None) for i in [50, 50, 100, *range(1, 30), 7, 7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    v = written(integer_vectors(df))
    got = top_k(v, v.where("id % 50 = 0")).toPandas()
    embeddings = df.toPandas()  # noqa: F841
    want = duckdb.sql(SQL_TOP_K).df()
    columns = ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got[columns].to_numpy())) == sorted(map(tuple, want[columns].to_numpy())) and len(got) == 15


def test_packing_ranks_copies_apart(spark):
    import public_tokenizers

    docs = spark.range(4000).selectExpr("1L AS doc_id", "'the same words' AS text")
    pieces = written(numbered(tokenizer_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))))
    out = pack(pieces).toPandas()
    assert list(out.columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert len(out) == 4000 and not out.duplicated(["sequence_id", "offset"]).any()


@pytest.mark.parametrize("text", ["1" * 1_000_000, "1" * 999_990 + ".2.3.4", "1.2.3." * 150_000, ("9" * 500 + ".") * 2000, "+1" * 500_000, "a@b" * 300_000, "1 " * 500_000])
def test_base_patterns_take_a_megabyte(text):
    import time

    began = time.process_time()
    found = base_spans(text)
    assert time.process_time() - began < 4
    assert len(found["ip"]) == (112_500 if text.startswith("1.2") else 0)
