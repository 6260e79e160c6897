"""Rules with memory over series that are too long for one task.

A series is cut into chunks of time. Each chunk is summed up by what it makes of any memory it may start from; the summaries,
which are small, are walked along each series and give every chunk the memory it really starts from; then all chunks are
replayed at once. Rows are shuffled by series and chunk, and no task gets more than a chunk of them.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.store import stored


def by_chunks(rows: DataFrame, keys: tuple[str, ...], width_ms: int, start: Any, summary: Callable[[pd.DataFrame], Any], advance: Callable[[Any, Any], Any], replay: Callable[[pd.DataFrame, Any], pd.DataFrame], schema: T.StructType) -> DataFrame:
    """replay(chunk, memory) of every chunk of width_ms of the keys' rows in time order.

    summary(chunk) is such that advance(memory, summary) is the memory after the chunk, for any memory before it; `start` is
    the memory before the first row. An empty table gives an empty table.
    """
    x = stored(rows.withColumn("_chunk", F.floor(F.unix_millis("ts") / width_ms)), "chunks")
    of_keys = T.StructType([x.schema[c] for c in (*keys, "_chunk")])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        found = pickle.dumps(summary(pdf.sort_values("ts", kind="stable")))
        return pdf[[*keys, "_chunk"]].head(1).assign(_summary=[found])

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, memory, out = pdf.sort_values("_chunk"), start, []
        for s in pdf["_summary"]:
            out.append(pickle.dumps(memory))
            memory = advance(memory, pickle.loads(s))
        return pdf[[*keys, "_chunk"]].assign(_start=out)

    def again(pdf: pd.DataFrame, memory: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({f.name: [] for f in schema.fields})
        return replay(pdf.sort_values("ts", kind="stable"), pickle.loads(memory["_start"].iloc[0]))[schema.names]

    summaries = x.groupBy(*keys, "_chunk").applyInPandas(one, T.StructType([*of_keys.fields, T.StructField("_summary", T.BinaryType())]))
    starts = stored(summaries.groupBy(*keys).applyInPandas(along, T.StructType([*of_keys.fields, T.StructField("_start", T.BinaryType())])), "starts")
    return x.groupBy(*keys, "_chunk").cogroup(starts.groupBy(*keys, "_chunk")).applyInPandas(again, schema)
