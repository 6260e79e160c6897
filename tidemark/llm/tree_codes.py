"""Vector codes by product quantisation, with Lloyd's rounds run on two trees.

Vectors become integers, floor(1024 * x), and are cut into equal parts, each with a codebook of its own. The rows of a task
are dealt to blocks; a block keeps, for each part, a tree of bounding boxes over its rows with the sum of every node. They are
made once and stored. A round sends the codebooks, which have a tree as well, to the blocks. Pairs of a node of rows and a node
of entries are met from the top: a pair whose least possible distance exceeds another's largest one for the same rows is
dropped, and once entries stand alone, one that is nowhere in the box nearer than the entry nearest to its middle. Rows whose
node has one entry left are assigned at once by the node's stored sum. Leaves that keep several entries compare their rows
with those by integers. All bounds are integers too, so the result is that of comparing every part with every entry.

A task returns sums and counts by entry, at most as many rows as there are entries; nothing else is shuffled in a round.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, free_name, met, table, written

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Rows of a block, and rows of a leaf of its trees at most.
BLOCK, LEAF = 16384, 32
#: Pairs of nodes that numpy handles at once; it bounds a task's memory.
PAIRS = 1 << 15
#: Integers below this are exact as doubles.
EXACT = 1 << 53


def integer_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", parts: int = PARTS) -> DataFrame:
    """id, label and v (array<long>) of the rows that take part.

    Those are rows whose vector is not null, has neither null nor non-finite components nor such as make a squared distance
    exceed a long, and is of the most frequent length that `parts` divides (ties: the larger). Rows that repeat an id each take
    part, and so do rows of a null id or label.
    """
    x = F.col(vector_column)
    fine = vectors.where(x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & (F.size(x) > 0) & (F.size(x) % parts == 0))
    most = fine.groupBy(F.size(x).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = most[0]["dim"] if most else parts
    limit = int((2.0**62 / (dim // parts)) ** 0.5 / 2 / SCALE) - 1
    fine = fine.where((F.size(x) == dim) & F.forall(x, lambda c: F.abs(c) < limit))
    return fine.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("v"))


class Tree:
    """Boxes over points: nodes level by level, each halved at the median of its widest side until `leaf` points are left.

    order has the points' numbers as the leaves hold them; node j of a level of 2**l has points n*j >> l to n*(j+1) >> l.
    """

    def __init__(self, n: int, points: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray, order: np.ndarray | None = None):
        self.n, self.points, self.low, self.high, self.sums, self.order = n, points, low, high, sums, order
        self.depth = (len(low) + 1).bit_length() - 2
        level = np.repeat(np.arange(self.depth + 1), 1 << np.arange(self.depth + 1))
        j = np.arange(len(low)) + 1 - (1 << level)
        self.first, self.end = n * j >> level, n * (j + 1) >> level

    @classmethod
    def over(cls, points: np.ndarray, leaf: int) -> Tree:
        n = len(points)
        depth, order = max(0, (n // leaf).bit_length() - 1 if leaf > 1 else n.bit_length() - 1), np.arange(n)
        while n >> depth > leaf and n >> (depth + 1):
            depth += 1
        low, high, sums = [], [], []
        for level in range(depth + 1):
            cuts = n * np.arange((1 << level) + 1) >> level
            low.append(np.minimum.reduceat(points, cuts[:-1]))
            high.append(np.maximum.reduceat(points, cuts[:-1]))
            sums.append(np.add.reduceat(points, cuts[:-1], dtype=np.int64))
            if level < depth:
                part = np.repeat(np.arange(1 << level), np.diff(cuts))
                widest = (high[-1] - low[-1]).argmax(1)
                by = np.lexsort((points[np.arange(n), widest[part]], part))
                points, order = points[by], order[by]
        return cls(n, points, *(np.concatenate(x) for x in (low, high, sums)), order)


def pair_bounds(rows: Tree, node: np.ndarray, book: Tree, ent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance of a point of a node to an entry of a node."""
    least, most = np.empty(len(node), np.int64), np.empty(len(node), np.int64)
    for a in range(0, len(node), PAIRS):
        i, j = node[a : a + PAIRS], ent[a : a + PAIRS]
        over, under = book.low[j] - rows.high[i], rows.low[i] - book.high[j]
        gap, span = np.maximum(np.maximum(over, under), 0), np.maximum(-over, -under)
        least[a : a + PAIRS], most[a : a + PAIRS] = (gap * gap).sum(1), (span * span).sum(1)
    return least, most


def groups(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each run of equal numbers, and which run each place is in."""
    first = np.flatnonzero(np.diff(node, prepend=-1))
    return first, np.repeat(np.arange(len(first)), np.diff(first, append=len(node)))


def not_beaten(rows: Tree, node: np.ndarray, entries: np.ndarray, ent: np.ndarray) -> np.ndarray:
    """Which pairs of a node and a single entry stay: somewhere in the box the entry may be better than the one nearest to its middle.

    Better is nearer, or as near with a smaller number.
    """
    middle = np.empty(len(node), np.int64)
    for a in range(0, len(node), PAIRS):
        i, j = node[a : a + PAIRS], ent[a : a + PAIRS]
        off = 2 * entries[j] - rows.low[i] - rows.high[i]
        middle[a : a + PAIRS] = (off * off).sum(1)
    first, run = groups(node)
    best = np.lexsort((ent, middle, node))[first]  # node is in ascending order
    champion = ent[best][run]
    square, keep = (entries * entries).sum(1), np.empty(len(node), bool)
    for a in range(0, len(node), PAIRS):
        i, j, c = node[a : a + PAIRS], ent[a : a + PAIRS], champion[a : a + PAIRS]
        slope = entries[j] - entries[c]
        lead = square[j] - square[c] - 2 * np.maximum(rows.low[i] * slope, rows.high[i] * slope).sum(1)
        keep[a : a + PAIRS] = (lead < 0) | ((lead == 0) & (j <= c))
    return keep


def assign(rows: Tree, entries: np.ndarray, book: Tree) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Nodes assigned whole, the entry of each, and the uncertain leaves with the entries each keeps, in ascending order."""
    node = ent = np.zeros(1, np.int64)
    level = deep = 0
    whole, given, open_leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    single = False
    while len(node):
        if not single:
            least, most = pair_bounds(rows, node, book, ent)
            first, run = groups(node)
            keep = least <= np.minimum.reduceat(most, first)[run]
            node, ent = node[keep], ent[keep]
            if deep == book.depth:  # leaves of the entries' tree become their entries
                count = book.end[ent] - book.first[ent]
                at = np.repeat(book.first[ent] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                node, ent, single = np.repeat(node, count), book.order[at], True
        if single:
            keep = not_beaten(rows, node, entries, ent)
            node, ent = node[keep], ent[keep]
            first, run = groups(node)
            alone = np.diff(first, append=len(node)) == 1
            whole.append(node[first[alone]])
            given.append(ent[first[alone]])
            node, ent = node[~alone[run]], ent[~alone[run]]
            if level == rows.depth:
                first, _ = groups(node)
                open_leaves = [(int(node[a]), np.sort(ent[a:z])) for a, z in zip(first, np.append(first[1:], len(node)))]
                break
        down = min(2, book.depth - deep)  # the entries' tree is gone down two levels at a time
        deep += down
        for _ in range(down):
            node, ent = np.repeat(node, 2), (2 * ent[:, None] + [1, 2]).reshape(-1)
        if level < rows.depth:
            level += 1
            by = np.argsort(node, kind="stable")
            node, ent = node[by], ent[by]
            first, run = groups(node)
            size = np.diff(first, append=len(node))
            at = np.concatenate([np.tile(np.arange(a, a + n), 2) for a, n in zip(first, size)]) if len(first) else np.zeros(0, np.int64)
            side = np.concatenate([np.repeat([1, 2], n) for n in size]) if len(first) else np.zeros(0, np.int64)
            node, ent = 2 * node[at] + side, ent[at]
        else:
            by = np.argsort(node, kind="stable")
            node, ent = node[by], ent[by]
    return np.concatenate(whole), np.concatenate(given), open_leaves


def nearest(points: np.ndarray, entries: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """For each point the nearest of the kept entries (ascending), ties to the lower number."""
    e = entries[kept]
    most = max(int(np.abs(points).max()), int(np.abs(e).max()), 1)
    if 8 * points.shape[1] * most * most < EXACT:
        points, e = points.astype(np.float64), e.astype(np.float64)
    return kept[((e * e).sum(1)[None, :] - 2 * (points @ e.T)).argmin(1)]


def codes(rows: Tree, entries: np.ndarray, book: Tree) -> np.ndarray:
    """The entry of each point, as the leaves hold them."""
    whole, given, leaves = assign(rows, entries, book)
    out = np.empty(rows.n, np.int64)
    for i, e in zip(whole.tolist(), given.tolist()):
        out[rows.first[i] : rows.end[i]] = e
    for i, kept in leaves:
        out[rows.first[i] : rows.end[i]] = nearest(rows.points[rows.first[i] : rows.end[i]], entries, kept)
    return out


def gathered(rows: Tree, entries: np.ndarray, book: Tree, sums: np.ndarray, counts: np.ndarray) -> None:
    """Add to each entry the sum and number of its points; whole nodes by their stored sums."""
    whole, given, leaves = assign(rows, entries, book)
    np.add.at(sums, given, rows.sums[whole])
    np.add.at(counts, given, rows.end[whole] - rows.first[whole])
    for i, kept in leaves:
        points = rows.points[rows.first[i] : rows.end[i]]
        e = nearest(points, entries, kept)
        np.add.at(sums, e, points)
        np.add.at(counts, e, 1)


def tree_blocks(vectors: DataFrame, parts: int = PARTS, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """A row for each block of integer_vectors(): ids, labels, and for all parts end to end the trees' arrays as bytes."""

    def build(ids, labels, v):
        x = np.stack(v)
        kind = np.int16 if len(x) and np.abs(x).max() < 1 << 15 else np.int64
        trees = [Tree.over(p, leaf) for p in np.split(x, parts, axis=1)]
        raw = lambda name, k: pa.array([b"".join(np.ascontiguousarray(getattr(t, name), dtype=k).tobytes() for t in trees)], pa.binary())
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        columns = [one(ids), one(labels), pa.array([len(x)], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([np.dtype(kind).str]), raw("points", kind), raw("low", kind), raw("high", kind), raw("sums", np.int64), raw("order", np.int32)]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "labels", "n", "dim", "kind", "points", "low", "high", "sums", "order"])

    def blocks(batches):
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, block - n)
                at, n = at + len(part), n + len(part)
                held.append(part)
                if n == block:
                    yield built(held)
                    held, n = [], 0
        if n:
            yield built(held)

    def built(held):
        t = pa.Table.from_batches(held).combine_chunks()
        v = t.column("v").chunk(0)
        return build(t.column("id").chunk(0), t.column("label").chunk(0), v.flatten().to_numpy().reshape(len(t), -1))

    schema = T.StructType([T.StructField("ids", T.ArrayType(vectors.schema["id"].dataType)), T.StructField("labels", T.ArrayType(vectors.schema["label"].dataType)), *(T.StructField(c, T.IntegerType()) for c in ("n", "dim")), T.StructField("kind", T.StringType()), *(T.StructField(c, T.BinaryType()) for c in ("points", "low", "high", "sums", "order"))])
    return vectors.mapInArrow(blocks, schema)


def trees_of(row: dict, parts: int) -> list[Tree]:
    n, width = row["n"], row["dim"] // parts
    read = lambda name, kind, wide: np.frombuffer(row[name], kind).reshape(parts, -1, wide).astype(np.int64, copy=False)
    points, low, high, sums = (read(c, np.dtype(row["kind"]) if c != "sums" else np.int64, width) for c in ("points", "low", "high", "sums"))
    order = np.frombuffer(row["order"], np.int32).reshape(parts, n) if "order" in row else [None] * parts
    return [Tree(n, points[p], low[p], high[p], sums[p], order[p]) for p in range(parts)]


def lloyd_round(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after each entry became the mean, rounded down, of its parts; entries without parts stay."""
    parts, width = len(books), books[0].shape[1]

    def gather(batches):
        over = [Tree.over(b, 1) for b in books]
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for row in batch.to_pylist():
                for p, t in enumerate(trees_of(row, parts)):
                    gathered(t, books[p], over[p], sums[p], counts[p])
        for p in range(parts):
            used = np.flatnonzero(counts[p])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(used) * width + 1, width, dtype=np.int32)), pa.array(sums[p][used].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[p][used]), flat], names=["part", "entry", "n", "total"])

    found = blocks.select("n", "dim", "kind", "points", "low", "high", "sums").mapInArrow(gather, "part int, entry int, n long, total array<long>")
    found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"))
    new = [b.copy() for b in books]
    for r in found.collect():  # parts * entries rows at most
        new[r["part"]][r["entry"]] = [x // r["n"] for x in r["total"]]
    return new


def quantised(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK, leaf: int = LEAF) -> tuple[DataFrame, list[np.ndarray]]:
    """id, label, code (numbers of the entries in hex, two digits each up to 256 entries) and error of each row of integer_vectors(), and the codebooks.

    A codebook starts as that part of the rows with the smallest ids (ties: by vector; null ids last), of all rows if there
    are fewer. Without rows the codebooks are empty.
    """
    start = vectors.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    schema = T.StructType([vectors.schema["id"], vectors.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not start:
        return vectors.sparkSession.createDataFrame([], schema), []
    books = list(np.split(np.array([r["v"] for r in start], dtype=np.int64), parts, axis=1))
    blocks = written(tree_blocks(vectors, parts, block, leaf), "tree_blocks")
    for _ in range(rounds):
        books = lloyd_round(blocks, books)
    digits = max(2, len(f"{entries - 1:x}"))

    def encode(batches):
        over = [Tree.over(b, 1) for b in books]
        names = np.array([f"{i:0{digits}x}" for i in range(entries)])
        for batch in batches:
            for i, row in enumerate(batch.drop_columns(["ids", "labels"]).to_pylist()):
                code, error = np.full(row["n"], "", dtype=f"<U{digits * parts}"), np.zeros(row["n"], np.int64)
                for p, t in enumerate(trees_of(row, parts)):
                    c, mine = codes(t, books[p], over[p]), np.empty(t.n, np.int64)
                    off = t.points - books[p][c]
                    error[t.order] += (off * off).sum(1)
                    mine[t.order] = c
                    code = np.char.add(code, names[mine])
                ids, labels = (batch.column(c)[i].values for c in ("ids", "labels"))
                for a in range(0, row["n"], 4096):
                    yield pa.RecordBatch.from_arrays([ids.slice(a, 4096), labels.slice(a, 4096), pa.array(code[a : a + 4096].tolist(), pa.string()), pa.array(error[a : a + 4096])], names=["id", "label", "code", "error"])

    out = written(blocks.mapInArrow(encode, schema), "codes")
    discard(blocks)
    return out, books


def codebook_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all integers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """The stored table coded() with label_error, the errors of all rows of the same label; null labels are together."""
    key = free_name(coded, "_label_key")
    x = coded.withColumn(key, F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = x.groupBy(key).agg(F.sum("error").alias("label_error"), F.count("*").alias("copies"))
    return met(x, written(sums, "label_errors"), key, coded.count()).drop(key, "copies")


def query_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = quantised(integer_vectors(table(spark, sf_dir, "embeddings")))
    return with_label_error(coded).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))


_ROUND_SQL = """
near{k} AS MATERIALIZED (
  SELECT r, p, min({{'d': a.s + b.s - 2 * list_inner_product(a.y, b.y), 'e': b.e}}) AS m FROM parts a JOIN book{k} b USING (p) GROUP BY r, p
), mean{k} AS (
  SELECT p, e, list(f ORDER BY i) AS y FROM (
    SELECT p, m.e AS e, i, floor(sum(y[i]) / count(*)) AS f FROM near{k} JOIN parts USING (r, p), unnest(range(1, len(y) + 1)) AS t(i) GROUP BY p, m.e, i
  ) GROUP BY p, e
), book{n} AS MATERIALIZED (
  SELECT p, e, y, list_inner_product(y, y) AS s FROM (SELECT p, e, coalesce(m.y, b.y) AS y FROM book{k} b LEFT JOIN mean{k} m USING (p, e))
),"""

SQL_TREE_CODES = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS r, * FROM (
    SELECT vec_id, label, list_transform(embedding, lambda c: floor(CAST(c AS DOUBLE) * 1024)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)
), parts AS MATERIALIZED (
  SELECT r, p, y, list_inner_product(y, y) AS s FROM (SELECT r, p, x[p * len(x) // 4 + 1 : (p + 1) * len(x) // 4] AS y FROM kept, range(4) AS t(p))
), book0 AS MATERIALIZED (SELECT p, r - 1 AS e, y, s FROM parts WHERE r <= 256),
""" + "".join(_ROUND_SQL.format(k=k, n=k + 1) for k in range(4)) + """
last AS MATERIALIZED (
  SELECT r, p, min({'d': a.s + b.s - 2 * list_inner_product(a.y, b.y), 'e': b.e}) AS m FROM parts a JOIN book4 b USING (p) GROUP BY r, p
), coded AS (
  SELECT r, string_agg(lower(printf('%02x', m.e)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM last GROUP BY r
), digest AS (
  SELECT sha256(string_agg(CAST(CAST(y[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM book4, unnest(range(1, len(y) + 1)) AS t(i)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), digest
"""
