from __future__ import annotations

import pytest

#: Texts that every operator must bear.
ODD = [None, "", " ", "\n\n\t", "one", "a b c d e f g h", "a b c d e f g h", "é🙂 ünï 日本語 x", "x " * 30_000, "w" * 50_000, "\x00\x1f zero", "a\x85b\xa0c", "token = \"abcdef123456\" joe@example.com +1 (499) 555-6503 192.168.1.1", "the idiot said \"moron\"", "<|endoftext|> don't"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with nulls in all columns, repeated rows, and extra columns named like internal ones."""
    rows = [(i, t, ["en", None, "de"][i % 3], ["s0", None][i % 2], None if t is None else len(t), i, "x", 1.5) for i, t in enumerate(ODD)]
    rows += [(3, "\n\n\t", "en", "s0", 3, 0, "y", 2.5)] * 2 + [(None, "no id at all here", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long, bucket string, score double")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
