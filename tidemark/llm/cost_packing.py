"""Cost-balanced packing of tokenised documents without padding.

A document's cost is estimated as a linear part for its tokens and a quadratic part for attention inside it. Documents go, in
descending order of length, each to the sequence of lowest cost that has room for it; one that fits nowhere is cut, and its
first part fills the roomiest sequence while the rest takes its turn again as a shorter document. There are as many sequences
of full capacity as the tokens fill, and what is left over makes sequences of different powers of two, so every sequence
ends full.

The plan is made on the histogram of lengths, whose size is the capacity however many documents there are: sequences
that received the same lengths are one class, and a step of the plan gives each sequence of the cheapest class a document.
Documents then get ranks inside their length in salted groups, and their places by rank. The documents that the plan cuts
are the last ranks of a length, so only the groups which hold those carry token ids through the shuffle.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, table, text_buffer, written
from .packing import RANK_GROUP, worker_memo

CAPACITY = 2048
#: A token's linear cost in units of the attention between two tokens: six times the width of a model of width 512.
LINEAR = 3072
#: Salted groups of a length are this many at most, so their table stays small.
MOST_SALTS = 1 << 16


def items(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """row, doc_id, start, length, doc_tokens, crc and ids of each document, those longer than the capacity cut into full pieces and a rest.

    ids has the token ids of pieces that may be cut again, two bytes each where the vocabulary allows, and is null for full ones.
    """

    def tokenise(batches):
        for batch in batches:
            for part in chunks(batch):
                memo = worker_memo(tokenizer_file)
                kind = "<u2" if memo.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
                ids, bounds = memo.ids(*text_buffer(part.column(1)))
                sizes = np.diff(bounds) + 1
                ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
                count = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(part)), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                first = ((np.cumsum(sizes) - sizes)[doc] + start).tolist()
                spans = [ids[a : a + n] for a, n in zip(first, length.tolist())]
                crc = [zlib.crc32(x.tobytes()) for x in spans]
                raw = [None if len(x) == capacity else x.astype(kind).tobytes() for x in spans]
                columns = [part.column(0).take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sizes[doc], pa.int64()), pa.array(crc, pa.int64()), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "crc", "ids"])

    more = [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "crc")]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *more, T.StructField("ids", T.BinaryType())])
    return docs.select("doc_id", "text").mapInArrow(tokenise, schema).withColumn("row", F.monotonically_increasing_id())


#: Columns of a run of ranks: first rank, first sequence, how many in each sequence, offset of the first, tokens taken if cut (0: whole), rank of the first rest.
RANK, SEQUENCE, EACH, OFFSET, TAKEN, REST = range(6)


def balanced_plan(histogram: dict[int, int], capacity: int = CAPACITY, linear: int = LINEAR) -> dict[int, np.ndarray]:
    """For each length the runs of ranks that go to the same class of sequences; all sequences end full.

    Rests of cut documents take the ranks after those of the histogram. A class is popped by (cost, first sequence); it is
    given several documents at once when it stays the cheapest. `parked` holds, by room, classes with less room than the length.
    """
    total = sum(k * n for k, n in histogram.items())
    full = total // capacity
    rooms = ([(full, capacity)] if full else []) + [(1, 1 << b) for b in reversed(range(capacity.bit_length())) if total % capacity >> b & 1]
    parked: list[list] = [[] for _ in range(capacity + 1)]
    first = 0
    for size, room in rooms:
        parked[room].append((0, first, size, 0))  # cost, first sequence, how many, tokens so far
        first += size
    ranks, runs = dict(histogram), {}
    cheapest: list[tuple] = []  # classes with room for the length, the room last
    for length in range(capacity, 0, -1):
        for c in parked[length]:
            heapq.heappush(cheapest, (*c, length))
        parked[length] = []
        at, price, largest = 0, linear * length + length * length, length - 1
        while at < ranks.get(length, 0):
            count = ranks[length] - at
            if cheapest:
                cost, seq, size, done, room = heapq.heappop(cheapest)
                each = min(room // length, max(1, count // size))
                if cheapest:
                    each = min(each, max(1, (cheapest[0][0] - cost) // price + 1))
                some = min(size, count)
                runs.setdefault(length, []).append((at, seq, each, done, 0, 0))
                at += some * each
                if some < size:
                    heapq.heappush(cheapest, (cost, seq + some, size - some, done, room))
                new, room = (cost + each * price, seq, some, done + each * length), room - each * length
                if room >= length:
                    heapq.heappush(cheapest, (*new, room))
                elif room:
                    parked[room].append(new)
            else:
                while not parked[largest]:
                    largest -= 1
                parked[largest].sort(reverse=True)
                cost, seq, size, done = parked[largest].pop()
                some, rest = min(size, count), length - largest
                runs.setdefault(length, []).append((at, seq, 1, done, largest, ranks.get(rest, 0)))
                ranks[rest] = ranks.get(rest, 0) + some
                at += some
                if some < size:
                    parked[largest].append((cost, seq + some, size - some, done))
    return {k: np.array(v, dtype=np.int64) for k, v in runs.items()}


def placed(runs: dict[int, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """For documents by length and rank, their pieces: number of the document, tokens before it there, length, sequence and offset."""
    which, start, out = np.arange(len(length)), np.zeros(len(length), np.int64), []
    while len(which):
        order = np.argsort(length, kind="stable")
        which, start, length, rank = which[order], start[order], length[order], rank[order]
        cuts = np.flatnonzero(np.diff(length, prepend=-1))
        run = np.concatenate([runs[int(length[a])][np.searchsorted(runs[int(length[a])][:, RANK], rank[a:z], side="right") - 1] for a, z in zip(cuts, [*cuts[1:], len(length)])])
        on, taken = rank - run[:, RANK], run[:, TAKEN]
        out.append((which, start, np.where(taken, taken, length), run[:, SEQUENCE] + on // run[:, EACH], run[:, OFFSET] + on % run[:, EACH] * length))
        go = taken > 0
        which, start, length, rank = which[go], (start + taken)[go], (length - taken)[go], (run[:, REST] + on)[go]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 5


def pack_by_cost(pieces: DataFrame, capacity: int = CAPACITY, linear: int = LINEAR, rank_group: int = RANK_GROUP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece; `pieces` is a stored table of items().

    Sequences are filled from 0 without a gap and to the end: those of the capacity, and beside them less than one
    capacity's tokens in sequences of different powers of two. Every row is placed, however often it is repeated (rows are told
    apart by their number), and rows of a null doc_id too. An empty table gives an empty table.
    """
    if capacity & (capacity - 1):
        raise ValueError(f"the capacity must be a power of two, got {capacity}")
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = balanced_plan(histogram, capacity, linear)
    salts = {k: min(-(-n // rank_group), MOST_SALTS) for k, n in histogram.items()}
    cut = {k: int(x[x[:, TAKEN] > 0, RANK].min()) if (x[:, TAKEN] > 0).any() else histogram.get(k, 0) for k, x in runs.items()}

    def salted(few: DataFrame, *columns: str) -> DataFrame:
        x = pieces.select("row", "length", *columns).join(F.broadcast(few), "length")  # at most `capacity` rows
        return x.withColumn("_salt", F.pmod(F.xxhash64("row"), "_salts").cast("int"))

    few = spark.createDataFrame([(k, n, cut[k]) for k, n in salts.items()], "length long, _salts int, _cut long")
    sizes = salted(few).groupBy("length", "_salt", "_cut").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = written(sizes.select("length", "_salt", "_cut", before.alias("_before"), "_n"), "starts")
    last = starts.where(F.col("_before") + F.col("_n") > F.col("_cut")).groupBy("length").agg(F.min("_salt").alias("at")).collect()  # one row a length
    carry = {r["length"]: r["at"] for r in last}
    few = spark.createDataFrame([(k, n, carry.get(k, n)) for k, n in salts.items()], "length long, _salts int, _carry int")
    x = salted(few, "doc_id", "start", "doc_tokens", "crc", "ids")
    x = x.withColumn("ids", F.when(F.col("_salt") >= F.col("_carry"), F.col("ids"))).drop("_salts", "_carry")
    own = F.row_number().over(W.partitionBy("length", "_salt").orderBy("row"))
    ranked = x.withColumn("_own", own).join(starts.select("length", "_salt", "_before").hint("merge"), ["length", "_salt"])
    ranked = ranked.select("doc_id", "start", "length", "doc_tokens", "crc", "ids", (F.col("_own") - 1 + F.col("_before")).alias("rank"))

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            which, start, size, sequence, offset = placed(runs, length, batch.column("rank").to_numpy())
            at = pa.array(which)
            crc = batch.column("crc").to_numpy()[which]
            for i in np.flatnonzero(size < length[which]):
                raw = batch.column("ids")[int(which[i])].as_py()
                ids = np.frombuffer(raw, dtype=f"<u{len(raw) // int(length[which[i]])}")
                crc[i] = zlib.crc32(ids[start[i] : start[i] + size[i]].astype("<u4").tobytes())
            columns = [batch.column("doc_id").take(at), pa.array(batch.column("start").to_numpy()[which] + start), pa.array(size), pa.array(crc), batch.column("doc_tokens").take(at), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    more = [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    return ranked.mapInArrow(place, T.StructType([pieces.schema["doc_id"], *more]))


def query_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the contract; `documents` alone is read, null texts count as empty."""
    import public_tokenizers

    return pack_by_cost(written(items(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), "items"))
