"""Helpers shared by the training-data operators: tables, the shared folder, words of texts in numpy."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy handles at once inside a task; it bounds a Python worker's memory.
CHUNK_BYTES = 1 << 21
#: Bytes of them that are hashed at once, or one word.
HASH_BYTES = 1 << 17
#: Rows of an Arrow batch; whole texts of them are held at once, in the JVM and in Python.
BATCH_ROWS = 2000

#: Keys of more than one row in HOT are joined by a broadcast; there are fewer of them than this.
HOT = 10_000

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_KEYS = np.random.Generator(np.random.PCG64(20240101)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER_KEYS = _BYTE_KEYS[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_WINDOW_KEYS = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS texts go to Python workers; a lower setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the cluster's checkpoint folder.

    Only a session on one machine (a local master, as in tests) may name none; it gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, keep: str = "table", rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    With `rows`, a bound of the row count, it is written as one file for each 100,000 rows, eight at least.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{keep}-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(max(8, rows // 100_000))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def met(rows: DataFrame, other: DataFrame, on: str, total: int) -> DataFrame:
    """rows joined with `other`, which has one row for each key and in `copies` how many of the rows have it.

    Keys of more than one row in HOT are HOT at most and are broadcast, so that no task gets all rows of one; the others are
    joined by a shuffle.
    """
    hot, rest = other.where(F.col("copies") * HOT > total), other.where(F.col("copies") * HOT <= total)
    if hot.isEmpty():
        return rows.join(other.hint("merge"), on)
    hot = F.broadcast(hot)
    return rows.join(hot, on).unionByName(rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(rest.hint("merge"), on))


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A hash of all columns of a row, maps included."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = columns or df.columns
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kinds.get(c, "") or "variant" in kinds.get(c, "") else F.col(f"`{c}`") for c in names])


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and each text's bounds there; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def chunks(batch: pa.RecordBatch, name: str = "text", most: int = CHUNK_BYTES):
    """Slices of a batch with at most `most` bytes of text each, or one row."""
    n = len(batch)
    if not n:
        return
    _, bounds = text_buffer(batch.column(batch.schema.get_field_index(name)))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
        yield batch.slice(at, min(to, n) - at)
        at = to


def word_bounds(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first byte and end byte of each word [^\\x20\\x09-\\x0D]+."""
    if not len(buf):
        e = np.zeros(0, np.int64)
        return e, e, e
    solid = (buf != 32) & (buf - np.uint8(9) > 4)
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    first[cut] = solid[cut]
    last[cut - 1] = solid[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(starts, bounds))), starts, ends


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words, the same in every process.

    A word's bytes are weighed by the powers of _BASE from its own first byte on: by those of the whole slice, and then by the
    inverse of the one at its first byte.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    keys = _LOWER_KEYS if lower else _BYTE_KEYS
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + HASH_BYTES, side="right")))
        a, z = int(starts[lo]), int(ends[hi - 1])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        sums = np.zeros(z - a + 1, np.uint64)
        keys.take(buf[a:z], out=sums[1:], mode="clip")
        sums[1:] *= _powers(z - a)[: z - a]
        np.cumsum(sums, out=sums)
        out[lo:hi] = (sums.take(e) - sums.take(s)) * _INVERSES.take(s)
        lo = hi
    return mix(out)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = _powers_of(_BASE, n)
    return _POWERS


def _powers_of(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, dtype=np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


_POWERS, _INVERSES = _powers_of(_BASE, HASH_BYTES), _powers_of(pow(_BASE, -1, 1 << 64), HASH_BYTES)


def words(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a column of texts: text number and hash of each word, and the number of words of each text."""
    buf, bounds = text_buffer(column)
    doc, starts, ends = word_bounds(buf, bounds)
    return doc, word_hashes(buf, starts, ends, lower), np.bincount(doc, minlength=len(column))


def windows(doc: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word's number and hash of each window of `size` words that lies inside one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    x = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        x += hashes[at + k] * _WINDOW_KEYS[k]
    return at, mix(x)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until the table has no such column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name
