"""Best-fit packing of tokenised documents by minimum bin slack.

A sequence holds at most `capacity` tokens. Only documents longer than that are cut. The packing plan is made on
the histogram of piece lengths, which has at most `capacity` entries however many pieces there are: for each
sequence a bitset subset-sum over the lengths still on hand finds the fullest feasible combination, and it is taken
as often as its lengths last. Each such step uses up a length, so the plan has few steps. Pieces then get
ranks inside their length (in small salted groups) and their places in the plan by rank.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, table, text_buffer, written
from .token_ids import TokenMemo

CAPACITY = 4096
#: Pieces of one length and salt that are ranked in one window partition, about.
RANK_GROUP = 256

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


_MEMOS: dict[str, TokenMemo] = {}


def worker_memo(tokenizer_file: str) -> TokenMemo:
    """One for each Python worker and tokenizer."""
    if tokenizer_file not in _MEMOS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _MEMOS[tokenizer_file] = TokenMemo(Tokenizer.from_file(tokenizer_file))
    return _MEMOS[tokenizer_file]


def tokenizer_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` tokens of each document; a null text counts as empty and gives the end id alone.

    The tokenizer drops white space and encodes its pieces apart, so each worker remembers the ids of pieces met before.
    """

    def pieces(batches):
        for batch in batches:
            for part in chunks(batch):
                ids, bounds = worker_memo(tokenizer_file).ids(*text_buffer(part.column(1)))
                sizes = np.diff(bounds) + 1
                ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
                count = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(part)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                first = (np.cumsum(sizes) - sizes)[doc] + start
                raws = [ids[a:z].tobytes() for a, z in zip(first.tolist(), (first + length).tolist())]
                columns = [part.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(x) for x in raws], pa.int64()), pa.array(raws, pa.binary())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                keep = len(names) if with_ids else len(names) - 1
                yield pa.RecordBatch.from_arrays(columns[:keep], names=names[:keep])

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES + (", ids binary" if with_ids else ""))


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, each at most as often as counts has it, whose sum is the largest that fits into room.

    Bit s of `reach` says that some of the lengths so far sum to s; the states before each step are kept to walk back.
    Long lengths come first, and the search stops when the room is filled exactly.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, bundle = min(counts[length], room // length), 1
        while left:
            take = min(bundle, left)
            more = (reach | reach << (take * length)) & mask
            if more != reach:
                steps.append((length, take, reach))
                reach = more
            left -= take
            bundle *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * take
            total -= take * length
    return chosen


def minimum_slack_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(how many sequences, {length: how often in each}) until all pieces are placed.

    Each sequence starts from the longest piece left, as minimum bin slack does to keep hard pieces from the end.
    """
    left, plan = {k: v for k, v in histogram.items() if v}, []
    while left:
        head = max(left)
        left[head] -= 1
        rest = fullest({k: v for k, v in left.items() if v}, capacity - head)
        left[head] += 1
        need: dict[int, int] = {head: 1}
        for x in rest:
            need[x] = need.get(x, 0) + 1
        times = min(left[k] // n for k, n in need.items())
        plan.append((times, need))
        for k, n in need.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
    return plan


def places(plan: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length the runs of ranks that a step of the plan takes: first rank, first sequence, how often in each, offset of the first."""
    used: dict[int, int] = {}
    runs: dict[int, list] = {}
    sequence = 0
    for times, need in plan:
        offset = 0
        for length, n in need.items():
            runs.setdefault(length, []).append((used.get(length, 0), sequence, n, offset))
            used[length] = used.get(length, 0) + times * n
            offset += n * length
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in runs.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, rank_group: int = RANK_GROUP) -> DataFrame:
    """Add sequence_id and offset to a table of pieces (doc_id, piece, length, ...), read more than once: pass a stored table.

    Every piece is placed once; offsets in a sequence are gapless from 0. Repeated pieces are each placed; a column
    piece_row, if there is one, tells them apart (see numbered()), so that many of them are ranked in many tasks. A piece longer
    than the capacity is an error. Columns named sequence_id or offset are replaced. An empty table gives an empty table.
    """
    spark, pieces = pieces.sparkSession, pieces.drop("sequence_id", "offset")
    columns = [c for c in pieces.columns if c != "piece_row"]
    apart = ["piece_row"] if "piece_row" in pieces.columns else ["doc_id", "piece", "ids_crc32"]
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    if any(k is None or not 0 < k <= capacity for k in histogram):
        raise ValueError(f"lengths must be 1 to {capacity}")
    runs = places(minimum_slack_plan(histogram, capacity))
    few = spark.createDataFrame([(k, -(-v // rank_group)) for k, v in histogram.items()], "length long, _salts long")
    salted = pieces.join(F.broadcast(few), "length")  # at most `capacity` rows
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64(*apart), "_salts")).drop("_salts")
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("length", "_salt").orderBy(*apart))
    ranked = salted.withColumn("_own", own).join(starts.hint("merge"), ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_own") - 1 + F.col("_before")).select(*columns, "_rank")

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                run = runs[int(k)][np.searchsorted(runs[int(k)][:, 0], rank[at], side="right") - 1]
                on = rank[at] - run[:, 0]
                sequence[at] = run[:, 1] + on // run[:, 2]
                offset[at] = run[:, 3] + on % run[:, 2] * k
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "_rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    schema = T.StructType([*pieces.select(*columns).schema.fields, *(T.StructField(c, T.LongType()) for c in ("sequence_id", "offset"))])
    return ranked.mapInArrow(place, schema)


def numbered(pieces: DataFrame) -> DataFrame:
    """pieces with piece_row, a number of its own for each row once the table is written."""
    return pieces.withColumn("piece_row", F.monotonically_increasing_id())


def query_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = written(numbered(tokenizer_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))), "pieces")
    return pack(pieces)
