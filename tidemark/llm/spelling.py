"""Spelling variants: words that differ by one character, found by dense tiles of common prefix and suffix lengths.

Two words of m and m or m + 1 characters are one edit apart if their common prefix and suffix together reach the longer
length minus one. The edit lies in the first or in the second half of the m characters, so what is beside that half is
shared: each word takes part, as the shorter and as the longer one, in a group for each half. A group's words make a padded matrix
of code points, and blocks of it are compared with each other character by character from both ends. Groups of too many words
aren't compared: their words go on to the two halves of the half and so on, until one character is left, which the
alphabet bounds. A pair may meet in several groups and counts in that of the foremost stretch.

Forms are words of many more occurrences one edit away; roots follow the forms by pointer doubling.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, discard, table, written

#: Least code points and occurrences of a word, how many times as frequent its form must be, and which crc32 loses a character.
LEAST_LENGTH, LEAST_COUNT, TIMES, SPOIL = 7, 2, 10, 31
#: Words of a group that are compared densely; larger groups are split further.
DENSE = 512
#: Small groups are compared together, about so many words at once; cells of a tile.
TOGETHER, TILE = 64, 1 << 20

LATIN = "ISO-8859-1"
MEMBER = "w binary, n long, m int, a int, z int, role int"


def spoilt(doc_id: Column, run: Column, spoil: int = SPOIL) -> Column:
    """The run, without one of its characters where the crc32 of document and run says so; a null doc_id counts as empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % spoil == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, spoil: int = SPOIL) -> DataFrame:
    """w (the word in Latin-1 bytes, one a code point) and n of each word of all whole texts; null texts have none.

    Runs shorter than the least length can't become words, so the pattern leaves them out at once.
    """
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lower, F.lit(f"[a-zÀ-ÿ]{{{least_length},}}"), F.lit(0))).alias("run"))
    words = runs.select(spoilt(F.col("doc_id"), F.col("run"), spoil).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count).select(F.encode("word", LATIN).alias("w"), "n")


def halves(members: DataFrame) -> DataFrame:
    """Each member of a stretch a..z of the m characters in the groups of its two halves, with the hash of what lies beside them."""
    mid = F.greatest(F.col("a") + 1, F.floor((F.col("a") + F.col("z")) / 2).cast("int"))
    two = F.array(F.struct(F.col("a"), mid.alias("z")), F.struct(mid.alias("a"), F.col("z")))
    x = members.withColumn("_half", F.explode(two)).select("w", "n", "m", "role", F.col("_half.a").alias("a"), F.col("_half.z").alias("z")).where("a < z")
    tail = F.col("m") - F.col("z")
    beside = F.xxhash64(F.substring("w", F.lit(1), F.col("a")), F.substring(F.col("w"), F.length("w") - tail + 1, tail))
    return x.select("w", "n", "m", "a", "z", "role", beside.alias("key"))


def padded(column: pa.Array, width: int) -> np.ndarray:
    """A matrix of the bytes of a column, zeros behind shorter ones."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)
    at = bounds[:-1, None] + np.arange(width)
    return np.where(at < bounds[1:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefix of each row of a with each of b."""
    same = np.ones((len(a), len(b)), bool)
    out = np.zeros((len(a), len(b)), np.int32)
    for x, y in zip(a.T, b.T):
        same &= x[:, None] == y[None, :]
        if not same.any():
            break
        out += same
    return out


def compare(words: np.ndarray, role: np.ndarray, m: int, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word (best first; role 0: m characters, 1: one more) the number of near ones that count here, and the first of them (-1: none)."""
    count, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)

    def tile(i: np.ndarray, j: np.ndarray, longer: int, both: bool) -> None:
        x, y = words[i, :m], words[j, : m + longer]
        ahead, behind = common(x, y[:, :m]), common(x[:, ::-1], y[:, longer:][:, ::-1])
        near = (ahead + behind >= m - 1 + longer) & (ahead >= a) & (behind >= m - z)
        if a:
            near &= behind < m - a  # else the stretch before has it
        if not longer:
            near &= ahead < m
        for mine, others, hits in ((i, j, near), (j, i, near.T))[: 1 + both]:
            some = hits.any(1)
            count[mine] += hits.sum(1)
            best[mine[some]] = np.minimum(best[mine[some]], others[hits[some].argmax(1)])

    short, long = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    side = max(1, int(TILE**0.5))
    blocks = [short[k : k + side] for k in range(0, len(short), side)]
    for k, i in enumerate(blocks):
        for j in blocks[k:]:
            tile(i, j, 0, j is not i)
        for at in range(0, len(long), side):
            tile(i, long[at : at + side], 1, True)
    return count, np.where(count > 0, best, -1)


NEAR = "near long, best binary, best_n long"


def tiles(batches, dense: int = DENSE):
    """Rows sorted by m, a, z and key to what each word has near in its group; members of groups too large come back with near null."""
    names = ["w", "n", "m", "a", "z", "role", "near", "best", "best_n"]  # MEMBER and NEAR

    def refused(part: pa.RecordBatch) -> pa.RecordBatch:
        none = [pa.nulls(len(part), t) for t in (pa.int64(), pa.binary(), pa.int64())]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:6]), *none], names=names)

    def compared(part: pa.RecordBatch):
        """Rows of one stretch whose groups are whole."""
        m, a, z = (part.column(c)[0].as_py() for c in ("m", "a", "z"))
        key, role = part.column("key").to_numpy(), part.column("role").to_numpy()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(first, append=len(key))
        fit = (size > 1) & (np.add.reduceat(role == 0, first) > 0)
        kept = np.flatnonzero(np.repeat(fit, size))
        if not len(kept):
            return
        part, role, size = part.take(pa.array(kept)), role[kept], size[fit]
        n, chars = part.column("n").to_numpy(), max(1, TILE // (m + 1))
        edge, at, pack = np.cumsum(size), 0, 0
        while at < len(kept):
            # whole groups, about TOGETHER words of them, one group at least
            pack = max(pack + 1, int(np.searchsorted(edge, at + min(TOGETHER, chars), side="right")))
            to = int(edge[pack - 1])
            words = padded(part.column("w").slice(at, to - at), m + 1)
            order = np.lexsort((words.view(f"S{m + 1}").reshape(-1), -n[at:to]))
            count, best = compare(words[order], role[at:to][order], m, a, z)
            hit = np.flatnonzero(count)
            if len(hit):
                rows, by = at + order[hit], at + order[best[hit]]
                some = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names[:6]), pa.array(count[hit]), part.column("w").take(pa.array(by)), pa.array(n[by])], names=names)
            at = to

    def whole(batch: pa.RecordBatch):
        """Rows whose groups are all here."""
        key = batch.column("key").to_numpy()
        stretch = [batch.column(c).to_numpy() for c in ("m", "a", "z")]
        new = np.append(True, np.any([c[1:] != c[:-1] for c in stretch], axis=0))
        band = np.flatnonzero(new)
        new[1:] |= key[1:] != key[:-1]
        first = np.flatnonzero(new)
        size = np.diff(first, append=len(key))
        large = np.repeat((size > dense) & (stretch[2][first] - stretch[1][first] > 1), size)
        if large.any():
            yield refused(batch.filter(pa.array(large)))
        for at, to in zip(band, np.append(band[1:], len(key))):
            if not large[at:to].all():
                yield from compared(batch.slice(at, to - at).filter(pa.array(~large[at:to])))

    held, large = None, None  # rows of the last group so far; the group known to be too large
    for batch in batches:
        if not len(batch):
            continue
        names_of = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("m", "a", "z", "key")])
        if large is not None:
            same = (names_of == large[:, None]).all(0)
            more = int(same.argmin()) if not same.all() else len(batch)
            if more:
                yield refused(batch.slice(0, more))
            batch, names_of = batch.slice(more), names_of[:, more:]
            if not len(batch):
                continue
            large = None
        last = names_of[:, -1]
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        own = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("m", "a", "z", "key")])
        tail = len(batch) - int((own == last[:, None]).all(0)[::-1].cumprod().sum())
        if tail:
            yield from whole(batch.slice(0, tail))
        held = batch.slice(tail)
        if len(held) > dense and last[2] - last[1] > 1:
            yield refused(held)
            held, large = None, last
    if held is not None:
        yield from compared(held)


def near_words(words: DataFrame, dense: int = DENSE) -> DataFrame:
    """w, n_near, best and best_n (the near word of most occurrences, ties to the first in code-point order) of each word that has a near one.

    `words` is a stored table of distinct w and n. A key that many members share is split before the shuffle, so no task gets its rows.
    """
    role = F.explode(F.array(F.struct(F.length("w").alias("m"), F.lit(0).alias("role")), F.struct((F.length("w") - 1).alias("m"), F.lit(1).alias("role"))))
    x = words.withColumn("_in", role).where(F.col("_in.m") > 0).select("w", "n", F.col("_in.m").alias("m"), F.lit(0).alias("a"), F.col("_in.m").alias("z"), F.col("_in.role").alias("role"))
    group, found, spent = ["m", "a", "z", "key"], [], []
    members = halves(x)
    while True:
        members = written(members, "members")
        sizes = members.groupBy(*group).agg(F.count("*").alias("size"))
        total = members.count()
        hot = sizes.where((F.col("size") * HOT > total) & (F.col("size") > dense) & (F.col("z") - F.col("a") > 1)).select(*group)
        hot = F.broadcast(written(hot, "hot"))  # fewer than HOT rows
        dealt = members.join(hot, group, "left_anti").repartition(*group).sortWithinPartitions(*group)
        out = written(dealt.mapInArrow(lambda b: tiles(b, dense), f"{MEMBER}, {NEAR}"), "near")
        found.append(out.where("near IS NOT NULL").select("w", "near", "best", "best_n"))
        spent += [members, out]
        more = out.where("near IS NULL").select(*[c.split()[0] for c in MEMBER.split(", ")])
        more = more.unionByName(members.join(hot, group, "left_semi").select(*more.columns))
        if more.isEmpty():
            break
        members = halves(more)
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    first = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    near = written(every.groupBy("w").agg(F.sum("near").alias("n_near"), first.alias("_first")).select("w", "n_near", F.col("_first.w").alias("best"), (-F.col("_first.m")).alias("best_n")), "near_words")
    for t in spent:
        discard(t)
    return near


def roots(forms: DataFrame) -> DataFrame:
    """w and root of the words of a stored table (w, form): the last word reached by forms.

    Each round doubles how far a word sees; a form is TIMES as frequent as its word, so few rounds do.
    """
    seen = written(forms.select("w", F.col("form").alias("root")), "roots")
    while True:
        ahead = seen.select(F.col("w").alias("root"), F.col("root").alias("_next"))
        new = written(seen.join(ahead.hint("merge"), "root", "left").select("w", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        discard(seen)
        seen = new.select("w", "root")
        if new.where("_moved").isEmpty():
            return seen


def spelling_groups(words: DataFrame, times: int = TIMES, dense: int = DENSE) -> DataFrame:
    """word, n, n_near, form, form_n, root of each row of a stored table of distinct words (w, n); see word_counts().

    The form is the near word of most occurrences if it has `times` as many as the word, else null; the root is where forms
    lead, the word itself without one. An empty table gives an empty table.
    """
    x = words.join(near_words(words, dense).hint("merge"), "w", "left")
    fit = F.col("best_n") >= times * F.col("n")
    x = written(x.select("w", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fit, F.col("best")).alias("form"), F.when(fit, F.col("best_n")).alias("form_n")), "forms")
    x = x.join(roots(x.where("form IS NOT NULL")).hint("merge"), "w", "left")
    word = lambda c: F.decode(c, LATIN)
    return x.select(word(F.col("w")).alias("word"), "n", "n_near", word(F.col("form")).alias("form"), "form_n", word(F.coalesce("root", "w")).alias("root"))


def query_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = written(word_counts(table(spark, sf_dir, "documents")), "words")
    return spelling_groups(words).select("word", "form", "root", "n", "n_near", "form_n")


SQL_SPELLING = """
WITH RECURSIVE bits AS MATERIALIZED (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), once AS MATERIALIZED (
  SELECT doc, run, count(*) AS c, hex(encode(doc || ':' || run)) AS x FROM runs WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1]))) AS h
  FROM once, bits
), words AS MATERIALIZED (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT c, CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed
  ) WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2
), less AS MATERIALIZED (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM words, unnest(range(length(word))) AS t(i)
), near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT DISTINCT l.word, w.word, w.n FROM less l JOIN words w ON w.word = l.rest
  UNION ALL SELECT DISTINCT w.word, l.word, l.n FROM less l JOIN words w ON w.word = l.rest
), best AS (
  SELECT word, count(*) AS n_near, min({'m': -n, 'w': other}) AS b FROM near GROUP BY word
), forms AS MATERIALIZED (
  SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 10 * w.n THEN b.w END AS form, CASE WHEN -b.m >= 10 * w.n THEN -b.m END AS form_n
  FROM words w LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root, 0 AS steps FROM forms
  UNION ALL SELECT k.word, f.form, steps + 1 FROM walk k JOIN forms f ON f.word = k.root WHERE f.form IS NOT NULL
)
SELECT word, form, root, n, n_near, CAST(form_n AS BIGINT) AS form_n FROM forms JOIN (SELECT word, arg_max(root, steps) AS root FROM walk GROUP BY word) USING (word)
"""
