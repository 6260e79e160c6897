"""Near duplicates by BagMinHash: weighted Jaccard similarity of the multisets of five-word shingles.

Texts of the same words are one node. Over the weight axis of each shingle runs a Poisson process, and only its points
below the shingle's weight count. The process is hierarchical: the whole axis [0, 2**31) has one, whose first point is drawn;
it is then split into the processes of its two halves, one of which has that point and the other a later one of its own,
and so on down to units. Parts beyond the weight are dropped, and so are parts whose first point lies beyond the time that
fills all places, with all that is below them: however large a weight, only the parts with early points are split. The same
shingle is split alike in all texts, so what two weights share is the same points. Every point falls to one of the
signature's places, which keeps its earliest point, so two signatures agree in a place with the weighted Jaccard
similarity as probability. Signatures are banded; in each bucket every node is compared with its neighbour in a random order
(so a bucket of n nodes makes n pairs), each pair is verified on the full multisets, and buckets that still hold several
components are dealt at random, in further rounds, to blocks in which each node outside the largest component meets the
likeliest node of another one. What large buckets still hold apart then is compared exactly: all similar pairs of different components share one of their rarest shingles (prefix filter), and a node
meets the likeliest nodes of another component first, more and more of them until the two are one or all have been tried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, discard, free_name, met, mix, row_hash, table, windows, words, written
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
PLACES, BAND = 64, 4
#: Pairs whose signatures agree in a smaller share of places than this are not verified (0.8 minus over 5 deviations).
LEAST_ESTIMATE = 0.5
#: Rounds; after the first, buckets up to SMALL nodes compare all nodes of different components. Larger ones
#: that the rounds leave unresolved are finished by apart(). Nodes of a bucket that are put in one order, about.
ROUNDS, SMALL, SPREAD = 6, 32, 1024
#: Least share of places in which two signatures agree for their nodes to meet in the rounds after the first; below it the exact finish finds them.
LIKELY = 0.65
#: So many nodes are broadcast at most (16 MB) when their texts or multisets are read again, and half as many pairs.
BROADCAST_NODES = 1_000_000

#: Nodes of one shingle that are held at once when its nodes are compared with one another.
BLOCK = 1024
#: Cells of the counts by which elements are put in order; the driver gets so many numbers at most (8 MB) and sends them to all tasks.
CELLS = 1 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(doc: np.ndarray, hashes: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each shingle; a text of fewer words has one, of all its words, and a text without words none."""
    at, h = windows(doc, hashes, size)
    d = doc[at]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.cumsum(counts) - counts
        whole = np.array([mix(np.sum(hashes[first[i] : first[i] + counts[i]] * (np.arange(counts[i], dtype=np.uint64) * np.uint64(2) + np.uint64(3)), keepdims=True) + np.uint64(counts[i]))[0] for i in short], dtype=np.uint64)
        d, h = np.concatenate([d, short]), np.concatenate([h, whole])
    order = np.lexsort((h, d))
    return d[order], h[order]


def weights(d: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, with how often each occurs; d, h sorted."""
    if not len(d):
        return d, h, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])]))
    return d[new], h[new], np.diff(np.append(new, len(d)))


#: The weight axis is [0, 2**TOP): a text of 2**31 bytes has fewer words.
TOP = 31
_ROOT, _LEVEL, _LOW = np.uint64(0x5851F42D4C957F2D), np.uint64(0xD1342543DE82EF95), np.uint64(0xAEF17502108EF2D9)


def waiting_time(x: np.ndarray, rate: float | np.ndarray) -> np.ndarray:
    """Exponential times of random bits."""
    return np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53) / -rate


def split_processes(h: np.ndarray, w: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the shingle, lower end and first point of each unit of [0, weight) whose first point is within the shingle's limit."""
    own, low, x = np.arange(len(h)), np.zeros(len(h), np.uint64), waiting_time(mix(h + _ROOT), 2.0**TOP)
    top = int(w.max()).bit_length() if len(w) else 0
    for level in range(TOP, 0, -1):
        seed = mix(h + low * _LOW + np.uint64(level * int(_LEVEL) % 2**64))
        goes_right = (seed & np.uint64(1)).astype(bool)  # the half that the first point falls into
        if level > top:  # all weights lie in the left half
            late = np.flatnonzero(goes_right)
            x[late] += waiting_time(seed[late], 2.0 ** (level - 1))
            continue
        other, middle = x + waiting_time(seed, 2.0 ** (level - 1)), low + np.uint64(1 << (level - 1))
        left, right = np.where(goes_right, other, x), np.where(goes_right, x, other)
        a, b = np.flatnonzero(left <= limit[own]), np.flatnonzero((right <= limit[own]) & (middle < w[own].astype(np.uint64)))
        low, x, own, h = np.concatenate([low[a], middle[b]]), np.concatenate([left[a], right[b]]), np.concatenate([own[a], own[b]]), np.concatenate([h[a], h[b]])
    return own, low, x


def bag_signatures(d: np.ndarray, h: np.ndarray, w: np.ndarray, texts: int, places: int = PLACES) -> np.ndarray:
    """texts x places identities (uint32) of the earliest points; rows of texts without shingles are zero."""
    out = np.zeros((texts, places), np.uint32)
    total = np.bincount(d, weights=w, minlength=texts)
    limit = np.where(total > 0, places * (np.log(places) + 3) / np.maximum(total, 1), 0)
    todo = total > 0
    while todo.any():
        at = np.flatnonzero(todo[d])
        own, low, t = split_processes(h[at], w[at], limit[d[at]])
        own = at[own]
        s, step = mix(h[own] + low * _LOW), 0
        found = [], [], []
        while len(s):
            x = mix(s + np.array([step], np.uint64) * _GOLD)
            y = mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            found[0].append(d[own] * places + (y % np.uint64(places)).astype(np.int64))
            found[1].append(t)
            found[2].append(mix(y))
            t = t + waiting_time(x, 1.0)
            live = t <= limit[d[own]]
            s, t, own, step = s[live], t[live], own[live], step + 1
        key, when, who = (np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(found, (np.int64, np.float64, np.uint64)))
        order = np.lexsort((when, key))
        key, who = key[order], who[order]
        first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        key, who = key[first], who[first]
        full = np.bincount(key // places, minlength=texts) == places
        done = full & todo
        take = done[key // places]
        out.reshape(-1)[key[take]] = (who[take] >> np.uint64(32)).astype(np.uint32)
        todo &= ~done
        limit = limit * 2
    return out


def text_keys(doc: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit key of the words of each text in their order."""
    first = np.cumsum(counts) - counts
    place = np.arange(len(doc)) - first[doc]
    x = mix(hashes ^ mix(place.astype(np.uint64) + np.uint64(1)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    return mix(sums[first + counts] - sums[first] + counts.astype(np.uint64) * _GOLD).view(np.int64)


def row_key() -> Column:
    """A row's key: the hash of its id and text."""
    return F.xxhash64("doc_id", "text")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key (of id and text), node (key of the words) and sig of each row; null and blank texts have an empty sig."""

    def make(batches):
        for batch in batches:
            for part in chunks(batch):
                doc, hashes, counts = words(part.column(2), lower=True)
                sig = bag_signatures(*weights(*shingles(doc, hashes, counts)), len(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(text_keys(doc, hashes, counts)), pa.array([x.tobytes() if n else b"" for x, n in zip(sig, counts)], pa.binary())], names=["doc_id", "key", "node", "sig"]
                )

    return docs.select("doc_id", row_key().alias("key"), "text").mapInArrow(make, "doc_id long, key long, node long, sig binary")


def bands(nodes: DataFrame) -> DataFrame:
    """bucket, node for each band of each node that has a signature."""

    def make(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).astype(np.uint64).reshape(-1, PLACES // BAND, BAND)
            key = np.zeros(sig.shape[:2], np.uint64) + np.arange(1, PLACES // BAND + 1, dtype=np.uint64) * _GOLD
            for k in range(BAND):
                key = mix(key + sig[:, :, k] * np.uint64(2 * k + 0x9E3779B1))
            node = np.repeat(batch.column(0).to_numpy(), PLACES // BAND)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(node)], names=["bucket", "node"])

    return nodes.where(F.length("sig") > 0).select("node", "sig").mapInArrow(make, "bucket long, node long")


def bags(docs: DataFrame) -> DataFrame:
    """node and its multiset of shingles as a sorted array of uint64, each further occurrence with a value of its own."""

    def make(batches):
        for batch in batches:
            for part in chunks(batch):
                doc, hashes, counts = words(part.column(0), lower=True)
                d, h = shingles(doc, hashes, counts)
                new = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])]) if len(d) else np.zeros(0, bool)
                begin = np.maximum.accumulate(np.where(new, np.arange(len(d)), 0)) if len(d) else np.zeros(0, np.int64)
                h = mix(h + (np.arange(len(d)) - begin).astype(np.uint64) * _GOLD)
                order = np.lexsort((h, d))
                h = h[order]
                cut = np.searchsorted(d, np.arange(len(part) + 1))
                rows = pa.RecordBatch.from_arrays([part.column(1), pa.array([h[a:z].tobytes() for a, z in zip(cut, cut[1:])], pa.binary())], names=["node", "bag"])
                yield rows.filter(pa.array(text_keys(doc, hashes, counts) == part.column(1).to_numpy()))  # a doc_id may stand for other texts too

    return docs.select("text", "node").mapInArrow(make, "node long, bag binary")


def among(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows without those that are of none of the nodes, left out before a join shuffles them; all rows if the nodes are too many to broadcast."""
    if nodes.count() > BROADCAST_NODES:
        return rows
    return rows.join(F.broadcast(nodes), "node", "left_semi")


def verified(pairs: DataFrame, compared: DataFrame, similarity: float) -> DataFrame:
    """a, b of those pairs whose multisets' Jaccard similarity is high enough; compared has the node, sig and bag of each.

    Pairs whose signatures agree too seldom are left out before their multisets are read. Pairs that can be broadcast go to
    the table of their a, and only what their b has is shuffled with them: few pairs don't shuffle the whole table.
    """
    a, b = (compared.select(F.col("node"), F.col("node").alias(end), F.col("sig").alias(sig), F.col("bag").alias(bag)) for end, sig, bag in (("a", "p", "x"), ("b", "q", "y")))
    if 2 * pairs.count() <= BROADCAST_NODES:
        left = a.drop("node").join(F.broadcast(pairs), "a")
        both = left.join(among(b, pairs.select(F.col("b").alias("node"))).drop("node").hint("merge"), "b")
    else:
        both = pairs.join(a.drop("node").hint("merge"), "a").join(b.drop("node").hint("merge"), "b")

    def check(batches):
        for batch in batches:
            p, q = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint32).reshape(-1, PLACES) for i in (2, 3))
            keep = (p == q).mean(1) >= LEAST_ESTIMATE
            for i in np.flatnonzero(keep):
                x, y = (np.frombuffer(batch.column(k)[int(i)].as_buffer(), dtype=np.uint64) for k in (4, 5))
                small, large = (x, y) if len(x) < len(y) else (y, x)
                shared = 0
                if len(small) >= similarity * len(large):
                    at = np.searchsorted(large, small)
                    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep[i] = shared >= similarity * (len(x) + len(y) - shared) and shared > 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "p", "q", "x", "y").mapInArrow(check, "a long, b long")


def neighbours(rows: DataFrame) -> DataFrame:
    """a, b of each node and the one before it in a random order of its bucket.

    rows has bucket, node and size (of the bucket). Buckets of many nodes are dealt at random to parts of about SPREAD, so
    no task gets a whole one and a node is in two pairs of a bucket at most.
    """
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / SPREAD)).cast("int")
    before = F.lag("node").over(Window.partitionBy("bucket", "_part").orderBy("node"))  # nodes are hashes already
    x = rows.withColumn("_part", part).select("node", before.alias("mate")).where("mate is not null")
    return x.select(F.least("node", "mate").alias("a"), F.greatest("node", "mate").alias("b"))


def likely_mates(rows: DataFrame, r: int) -> DataFrame:
    """a, b of each node outside the largest component of its part of a bucket, and the node of another component whose signature agrees best.

    rows has bucket, node, size, root and sig. Buckets are dealt at random, anew in each round r, to parts of about SPREAD
    nodes; the signatures of a part are compared in blocks, and pairs that agree in less than LIKELY of the places aren't made.
    """

    def best(part: pa.Table) -> pa.Table:
        node, root = (part.column(c).to_numpy() for c in ("node", "root"))
        sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, PLACES)
        names, which, count = np.unique(root, return_inverse=True, return_counts=True)
        outside = np.flatnonzero(which != count.argmax())
        a, b = [], []
        for lo in range(0, len(outside), 64):
            i = outside[lo : lo + 64]
            agree = (sig[i, None, :] == sig[None, :, :]).mean(2)
            agree[which[i][:, None] == which[None, :]] = -1
            j = agree.argmax(1)
            fine = agree[np.arange(len(i)), j] >= LIKELY
            a.append(node[i[fine]])
            b.append(node[j[fine]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    part = F.pmod(F.xxhash64("node", F.lit(r)), F.ceil(F.col("size") / SPREAD)).cast("int")
    return rows.select("bucket", part.alias("_part"), "node", "root", "sig").groupBy("bucket", "_part").applyInArrow(best, "a long, b long")


def cells(elements: np.ndarray, size: int) -> np.ndarray:
    """Cell of each element in a table of so many counts."""
    return (mix(elements.view(np.uint64)) % np.uint64(size)).astype(np.int64)


def cell_counts(bag: DataFrame) -> np.ndarray:
    """How many elements of all bags fall into each of CELLS cells: of one size, however many bags there are."""
    size = CELLS

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 200):
                total += np.bincount(cells(np.frombuffer(b"".join(batch.slice(at, 200).column(0).to_pylist()), dtype=np.int64), size), minlength=size)
        cell = np.flatnonzero(total)
        for at in range(0, len(cell), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(cell[at : at + 10_000]), pa.array(total[cell[at : at + 10_000]])], names=["cell", "n"])

    found = bag.select("bag").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


def prefixes(bag: DataFrame, counts: np.ndarray, similarity: float) -> DataFrame:
    """token, node, root, n and place of the first elements of each bag, those of the least counts of their cells."""
    spread = bag.sparkSession.sparkContext.broadcast(counts)

    def make(batches):
        held = spread.value
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                bags = part.column(2).to_pylist()
                n = np.array([len(x) // 8 for x in bags], dtype=np.int64)
                owner, token = np.repeat(np.arange(len(part)), n), np.frombuffer(b"".join(bags), dtype=np.int64)
                order = np.lexsort((token, held[cells(token, len(held))], owner))
                owner, token = owner[order], token[order]
                place = np.arange(len(token)) - (np.cumsum(n) - n)[owner] + 1
                first = place <= (n - np.ceil(similarity * n - 1e-6).astype(np.int64) + 1)[owner]
                owner, token, place = owner[first], token[first], place[first]
                node, root = (part.column(k).to_numpy()[owner] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token, node, root, n[owner], place)], names=["token", "node", "root", "n", "place"])

    return bag.select("node", "root", "bag").mapInArrow(make, "token long, node long, root long, n long, place long")


def apart(rows: DataFrame, bag: DataFrame, similarity: float) -> DataFrame:
    """a, b and `shared` (common prefix elements) of different root among the nodes of rows (node, root): at least all pairs that are similar enough.

    a lies outside the largest component that the pair's element has.

    Elements are in one order for all bags, those of rare cells first. The first common element of a similar pair is then
    among the first n - ceil(similarity n) + 1 of the larger bag and n - ceil(2 similarity / (1 + similarity) n) + 1 of the
    smaller one. That holds in any order: counts by cell, in place of a join with counts by element, only say which are rare.
    """
    own = written(among(bag, rows.select("node")).join(rows.hint("merge"), "node").select("node", "bag", "root"), "unresolved")
    first = written(prefixes(own, cell_counts(own), similarity), "prefixes")
    # each token's largest component is not compared with itself
    roots = first.groupBy("token", "root").agg(F.count("*").alias("size")).groupBy("token").agg(F.max_by("root", "size").alias("main"), F.sum("size").alias("all"), F.count("*").alias("roots"))
    post = first.join(roots.where("roots > 1").select("token", "main", F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks")).hint("merge"), "token")
    post = written(post.select("token", "node", "root", "n", "place", "blocks", (F.col("root") == F.col("main")).alias("is_main")), "prefixes_met")
    probe = post.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    index = post.where(F.col("place") <= F.col("n") - F.ceil(2 * similarity / (1 + similarity) * F.col("n") - 1e-6) + 1)
    index = index.select("token", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.col("node").alias("other"), F.col("root").alias("other_root"), F.col("n").alias("m"), F.col("place").alias("other_place"), F.col("is_main").alias("other_main"))
    # what follows the first common element bounds how many a pair can share
    shared = 1 + F.least(F.col("n") - F.col("place"), F.col("m") - F.col("other_place")) >= (F.col("n") + F.col("m")) * similarity / (1 + similarity) - 1e-6
    fits = shared & (F.col("root") != F.col("other_root")) & (F.col("m") >= F.col("n") * similarity - 1e-6) & ((F.col("m") < F.col("n")) | (F.col("m") == F.col("n")) & (F.col("other") < F.col("node")))
    close = None
    for x, y, a, b in ((probe.where("not is_main"), index, "node", "other"), (probe.where("is_main"), index.where("not other_main"), "other", "node")):
        part = x.join(y.hint("merge"), ["token", "block"]).where(fits).select(F.col(a).alias("a"), F.col(b).alias("b"))
        close = part if close is None else close.union(part)
    close = written(close.groupBy("a", "b").agg(F.count("*").alias("shared")), "close")
    for x in (own, first, post):
        discard(x)
    return close


def duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY, rounds: int = ROUNDS) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of its class) of each row of docs.

    Words are compared without regard to the case of A to Z. Texts without words, null ones too, are copies of one
    another. A row without doc_id gets the class of its text; class_id is null where no row of a class has a doc_id. A
    doc_id of several texts has a row, and maybe a class, for each. Repeated rows get a row each, an empty table none.
    Columns other than doc_id and text are not read.
    """
    return classified(docs, similarity, rounds).select("doc_id", "class_id")


def without_copies(docs: DataFrame, similarity: float = SIMILARITY, rounds: int = ROUNDS) -> DataFrame:
    """One row of each class of near duplicates, all columns: that of the smallest doc_id, rows without one last.

    Classes are of texts, not of ids: each class keeps a row, whatever ids repeat or are null. Of rows with the same doc_id
    and text one is kept, that of the lowest hash of all columns. An empty table gives none.
    """
    columns, key, n = docs.columns, free_name(docs, "_key"), free_name(docs, "copies")
    rows = written(classified(docs, similarity, rounds), "classified")
    total = rows.count()
    each = rows.groupBy("key").agg(F.min("class").alias("class"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "copies")).alias("least")
    chosen = written(each.groupBy("class").agg(least).select(F.col("least.key").alias(key), F.col("least.copies").alias("copies")), "chosen")
    discard(rows)
    keyed = docs.withColumn(key, row_key())
    if n != "copies":  # the table has such a column
        keyed = keyed.withColumnRenamed("copies", n)
    kept = met(keyed, chosen, key, total)
    repeated = chosen.where("copies > 1").isEmpty()
    own = [F.col(n).alias("copies") if c == "copies" else F.col(f"`{c}`") for c in columns]
    once = (kept if repeated else kept.where(F.col("copies") == 1)).select(*own)
    if repeated:
        return once
    several = kept.where(F.col("copies") > 1).groupBy(key).agg(F.min_by(F.struct(*own), row_hash(docs, [c if c != "copies" else n for c in columns])).alias("row"))
    return once.union(several.select(*[F.col("row").getField(c).alias(c) for c in columns]))


def classified(docs: DataFrame, similarity: float, rounds: int) -> DataFrame:
    """doc_id, key (of id and text), class (the smallest node of its class) and class_id of each row."""
    spark = docs.sparkSession
    sketch = written(sketches(docs), "sketch")
    total = sketch.count()
    nodes = written(sketch.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("key").alias("key"), F.max("sig").alias("sig"), F.count("*").alias("copies")), "nodes")
    spent = [members := written(bands(nodes), "members")]  # tables that nothing reads once the classes are known
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    spent.append(members := written(members.join(sizes.hint("merge"), "bucket"), "shared"))
    shared = members.count()
    # texts of the nodes that share a bucket are read again, one row for each; signatures and multisets of the others are not compared
    spent.append(involved := written(members.select("node").distinct().join(nodes.select("node", "key", "sig").hint("merge"), "node"), "involved", shared))
    sigs, ids = involved.select("node", "sig"), involved.select(F.col("key").alias("_key"), F.col("node").alias("_node"))
    ids = F.broadcast(ids) if involved.count() <= BROADCAST_NODES else ids.hint("merge")
    found = docs.select("text", row_key().alias("_key")).join(ids, "_key")
    spent.append(bag := written(bags(found.select("text", F.col("_node").alias("node"))), "bags"))
    if bag.count() > involved.count():  # rows that are repeated whole
        spent.append(bag := written(bag.groupBy("node").agg(F.max("bag").alias("bag")), "bags"))
    spent.append(bag := written(bag.join(sigs.hint("merge"), "node"), "compared"))
    large = members.where(F.col("size") > SMALL)
    edges, tested, roots = None, None, None
    for r in range(rounds):
        if roots is None:
            rows = members.withColumn("root", F.col("node"))
        else:
            rows = members.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
            mixed = rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
            if r > 1:  # in small buckets all have met
                rows = rows.where(F.col("size") > SMALL)
            spent.append(rows := written(rows.join(mixed.hint("merge"), "bucket"), "mixed", shared))
            members = rows.select("bucket", "node", "size")
        if r:
            pairs = likely_mates(rows.where(F.col("size") > SMALL).join(sigs.hint("merge"), "node"), r)
        else:
            pairs = neighbours(rows)
        if r == 1:  # few are left: in small buckets all nodes of different components meet
            other = rows.where(F.col("size") <= SMALL)
            mates = other.select("bucket", F.col("node").alias("b"), F.col("root").alias("other"))
            pairs = pairs.union(other.join(mates.hint("merge"), "bucket").where("root <> other and node < b").select(F.col("node").alias("a"), "b"))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested.hint("merge"), ["a", "b"], "left_anti")
        spent.append(pairs := written(pairs, "pairs", shared))
        if pairs.isEmpty():
            break
        tested = pairs if tested is None else tested.union(pairs)
        spent.append(new := written(verified(pairs, bag, similarity), "links", shared))
        if not new.isEmpty():
            edges = new if edges is None else edges.union(new)
            spent.append(roots := components(edges))
        elif roots is None:
            roots = spark.createDataFrame([], "node long, root long")
    if roots is not None:  # large buckets that the rounds did not resolve
        rows = large.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
        spent.append(rows := written(rows.join(mixed.hint("merge"), "bucket").select("node", "root").distinct(), "unresolved", shared))
        close = None if rows.isEmpty() else apart(rows, bag, similarity)
        most = 1  # a node is compared with so many nodes of another component, four times as many in each further round
        while close is not None:
            spent.append(close)
            known = [roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab"]
            left = close.join(known[0].hint("merge"), "a", "left").join(known[1].hint("merge"), "b", "left")
            left = left.select("a", "b", "shared", F.coalesce("a_root", "a").alias("a_root"), F.coalesce("b_root", "b").alias("b_root")).where("a_root <> b_root")
            place = F.row_number().over(Window.partitionBy("a", "b_root").orderBy(F.desc("shared"), F.xxhash64("b")))
            spent.append(left := written(left.select("a", "b", "shared", place.alias("place")), "left"))
            if left.isEmpty():
                break
            spent.append(new := written(verified(left.where(F.col("place") <= most).select("a", "b"), bag, similarity), "links"))
            close, most = left.where(F.col("place") > most).select("a", "b", "shared"), 4 * most
            if not new.isEmpty():
                edges = new if edges is None else edges.union(new)
                spent.append(roots := components(edges))
    own = nodes.select("node", F.col("node").alias("class"), F.col("rep").alias("class_id"), "copies")
    if edges is not None:
        spent.append(known := written(roots.join(nodes.select("node", "rep").hint("merge"), "node"), "known", shared))
        least = known.groupBy("root").agg(F.min("rep").alias("least_rep"), F.min("node").alias("least_node"))
        merged = written(known.join(least.hint("merge"), "root").select("node", "least_rep", "least_node"), "merged", shared)
        own = own.join(merged.hint("merge"), "node", "left")
        own = own.select("node", F.coalesce("least_node", "class").alias("class"), F.when(F.col("least_node").isNull(), F.col("class_id")).otherwise(F.col("least_rep")).alias("class_id"), "copies")
    classes = written(own, "classes")
    for x in spent:
        discard(x)
    return met(sketch.select("doc_id", "key", "node"), classes, "node", total).select("doc_id", "key", "class", "class_id")


def query_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_classes(table(spark, sf_dir, "documents"))
