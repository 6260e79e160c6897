"""Toxicity by a learned lexicon whose trie is intersected with Levenshtein automata, and by the context of each hit.

From a bounded sample of labelled texts come the terms (whole words, and stems that many words share) that mark toxic
texts. Trie and automata together are one deterministic automaton: its states are sets of (trie node, edits), so it reads a
word once and knows the terms within the allowed distance. In tasks numpy steps it through all words of a batch at
once. Hits inside quotation marks, or beside words that attribute speech, count apart; a logistic model weighs them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, discard, table, written

#: The lexicon and the weights are fitted on at most so many labelled texts, those of the lowest hashes.
SAMPLE_ROWS = 12_000
#: A term must mark so many sampled texts that no earlier term marks, and this share of the texts with it must be toxic.
LEAST_TEXTS, LEAST_SHARE = 6, 0.8
#: Size of the lexicon, and of the terms that it is chosen from: parameters of the model, like SAMPLE_ROWS.
MOST_TERMS, MOST_CANDIDATES = 400, 5000
STEM_SIZES = (4, 5, 6, 7, 8)
THRESHOLD = 0.3
#: Marks that open or close a quotation, and words that attribute speech to others.
QUOTES = "\"“”„«»"
ATTRIBUTION = ("said", "says", "wrote", "called", "quote", "quoted", "quotes", "term", "sagte", "schrieb", "zitat", "dijo", "cita", "dit", "citation")
CONTEXT = 6

_WIDE = 0x250
_LOWER = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 else i for i in range(_WIDE)], dtype=np.uint32)
_INSIDE = np.array([chr(i).isalnum() for i in range(_WIDE)] + [True])
_BREAK = np.array([i in (9, 10, 11, 12, 13, 32) for i in range(_WIDE)] + [False])


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, and text number, start and end of each word, without marks at its ends."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    small = np.minimum(code, _WIDE)
    code = np.where(code < _WIDE, _LOWER[np.minimum(code, _WIDE - 1)], code)
    wide = np.flatnonzero(code >= _WIDE)
    if len(wide):
        points, which = np.unique(code[wide], return_inverse=True)
        code[wide] = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in points.tolist()], dtype=np.uint32)[which]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    at = np.flatnonzero(_INSIDE[small])
    if not len(at):
        e = np.zeros(0, np.int64)
        return code, e, e, e
    run = np.cumsum(_BREAK[small], dtype=np.int64)[at]
    doc = np.searchsorted(bounds, at, side="right") - 1
    new = np.concatenate([[True], (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    return code, doc[first], at[first], at[np.append(first[1:], len(at)) - 1] + 1


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Words within the allowed distance of a term; stems match the beginning of a word without edits.

    moves[state, symbol] is the next state (0: dead); hit[state] the term that a word ending there means, -1 for none;
    distance[state] its edits. State 1 is the start.
    """

    def __init__(self, words: list[str], stems: list[str], strict: frozenset = frozenset()):
        """The words in `strict` allow no edits."""
        self.terms = [*words, *stems]
        limit = [0 if t in strict or i >= len(words) else edits_allowed(t) for i, t in enumerate(self.terms)]
        self.alphabet = sorted({c for t in self.terms for c in t})
        self.points = np.array([ord(c) for c in self.alphabet], dtype=np.uint32)  # sorted; symbol 0: any other
        children: list[dict[str, int]] = [{}]
        ends: list[dict[str, int]] = [{}]
        allowed = [0]
        for i, t in enumerate(self.terms):
            stem, node = i >= len(words), 0
            most = limit[i]
            allowed[0] = max(allowed[0], most)
            for c in t:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append({})
                    allowed.append(0)
                node = children[node][c]
                allowed[node] = max(allowed[node], most)
            ends[node]["stem" if stem else "word"] = i

        def closed(items) -> frozenset:
            best: dict[int, int] = {}
            todo = list(items)
            while todo:
                node, e = todo.pop()
                if e > allowed[node] or best.get(node, 9) <= e:
                    continue
                best[node] = e
                todo += [(child, e + 1) for child in children[node].values()]
            return frozenset(best.items())

        start = closed([(0, 0)])
        number, order, rows, stem_state = {start: 1}, [start], [], {}
        hits, distances = [-1, -1], [0, 0]

        def of(state: frozenset) -> int:
            if not state:
                return 0
            if state not in number:
                number[state] = len(order) + 1
                order.append(state)
            return number[state]

        at = 0
        while at < len(order):
            state = order[at]
            moves = []
            for c in [None, *self.alphabet]:
                to = []
                for node, e in state:
                    for x, child in children[node].items():
                        to.append((child, e if x == c else e + 1))
                    to.append((node, e + 1))
                nodes = closed(to)
                stems_hit = [ends[n]["stem"] for n, e in nodes if e == 0 and "stem" in ends[n]]
                moves.append(("stem", stems_hit[0]) if stems_hit else of(nodes))
            rows.append(moves)
            at += 1
        n = len(order)
        for k, state in enumerate(order):
            own = [(e, ends[node]["word"]) for node, e in state if "word" in ends[node] and e <= limit[ends[node]["word"]]]
            if k:
                hits.append(min(own)[1] if own else -1)
                distances.append(min(own)[0] if own else 0)
        for moves in rows:
            for i, m in enumerate(moves):
                if isinstance(m, tuple):
                    if m[1] not in stem_state:
                        stem_state[m[1]] = n + 1 + len(stem_state)
                    moves[i] = stem_state[m[1]]
        self.moves = np.zeros((n + 1 + len(stem_state), len(self.alphabet) + 1), np.int32)
        self.moves[1 : n + 1] = rows
        for s in stem_state.values():
            self.moves[s] = s
        self.hit = np.array(hits + list(stem_state), dtype=np.int32)
        self.distance = np.array(distances + [0] * len(stem_state), dtype=np.int32)
        self.is_stem = np.array([0] * (n + 1) + [1] * len(stem_state), dtype=bool)

    def symbols(self, code: np.ndarray) -> np.ndarray:
        """The symbol of each code point."""
        if not len(self.points):
            return np.zeros(len(code), np.int64)
        at = np.minimum(np.searchsorted(self.points, code), len(self.points) - 1)
        return np.where(self.points[at] == code, at + 1, 0)

    def read(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The state after each word."""
        state = np.ones(len(starts), np.int32)
        live, k = np.arange(len(starts)), 0
        while len(live):
            at = starts[live] + k
            more = at < ends[live]
            live, at = live[more], at[more]
            state[live] = self.moves[state[live], self.symbols(code[at])]
            live = live[state[live] > 0]
            k += 1
        return state


FEATURES = ("exact", "stem", "fuzzy", "quoted", "density", "any")


def hits(texts: list[str], automaton: Automaton, exceptions: frozenset) -> tuple[np.ndarray, list[tuple[int, str, str]]]:
    """Features of each text, and (text number, term, word) of the inexact hits."""
    code, doc, starts, ends = tokens(texts)
    state = automaton.read(code, starts, ends)
    found = np.flatnonzero(automaton.hit[state] >= 0)
    counts = np.zeros((len(texts), 4))
    fuzzy_words = []
    if len(found):
        quote = np.isin(code, np.array([ord(c) for c in QUOTES], np.uint32))
        before = np.cumsum(quote)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        for i in found.tolist():
            d, s = doc[i], state[i]
            kind = 1 if automaton.is_stem[s] else 0 if automaton.distance[s] == 0 else 2
            if kind == 2:
                word = code[starts[i] : ends[i]].tobytes().decode("utf-32-le", "surrogatepass")
                if word in exceptions:
                    continue
                fuzzy_words.append((int(d), automaton.terms[automaton.hit[s]], word))
            lo, hi = bounds[d], bounds[d + 1]
            ahead = before[starts[i]] - (before[lo - 1] if lo else 0)
            behind = before[hi - 1] - before[ends[i] - 1]
            quoted = ahead % 2 == 1 and behind > 0
            if not quoted:
                near = range(max(0, i - CONTEXT), min(len(doc), i + CONTEXT + 1))
                around = {code[starts[j] : ends[j]].tobytes().decode("utf-32-le", "surrogatepass") for j in near if doc[j] == d}
                quoted = behind + ahead > 0 and not around.isdisjoint(ATTRIBUTION)
            counts[d, 3 if quoted else kind] += 1
    plain = counts[:, :3].sum(1)
    size = np.maximum(np.bincount(doc, minlength=len(texts)), 1)
    return np.column_stack([np.log1p(counts), np.log1p(200 * plain / size), plain > 0]), fuzzy_words


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights and bias by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w)) * l2
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class ToxicityModel:
    def __init__(self, words: list[str], stems: list[str], strict: frozenset, exceptions: frozenset, weights: np.ndarray):
        self.automaton, self.exceptions, self.weights = Automaton(words, stems, strict), exceptions, weights

    def scores(self, texts: list[str]) -> np.ndarray:
        x, _ = hits(texts, self.automaton, self.exceptions)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def split_remainder():
    """The fold of a document by its id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text and toxic of at most `rows` labelled texts outside the held-out fold, those of the lowest id hashes.

    A doc_id with several labels is toxic if one of them says so; one with several texts gives them all, each once, as far as
    `rows` lasts: repeated rows are one.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(split_remainder() != 2).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    known = written(known, "labels")
    share = 1.2 * rows / max(known.count(), 1)  # so that few more than `rows` are sorted
    few = known if share >= 1 else known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    few = written(few.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id").limit(rows), "labelled")
    texts = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").withColumn("_hash", F.xxhash64("text"))
    texts = texts.groupBy("doc_id", "_hash").agg(F.max("text").alias("text"), F.max("_toxic").alias("toxic"))
    order = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id", "_hash")
    sample = written(texts.orderBy(*order).limit(rows).select("text", "toxic"), "sample")
    discard(known)
    discard(few)
    return sample


def term_counts(sample: DataFrame) -> DataFrame:
    """term (a word, or '^' and a stem), toxic texts and other texts that have it."""

    def count(batches):
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for part in chunks(batch):
                texts = [t or "" for t in part.column(0).to_pylist()]
                toxic = part.column(1).to_pylist()
                for t, y in zip(texts, toxic):
                    code, _, starts, ends = tokens([t])
                    raw = code.tobytes().decode("utf-32-le", "surrogatepass")
                    own = {raw[a:z] for a, z in zip(starts.tolist(), ends.tolist())}
                    own |= {f"^{w[:n]}" for w in own for n in STEM_SIZES if len(w) > n}
                    for w in own:
                        counts.setdefault(w, [0, 0])[0 if y else 1] += 1
        items = list(counts.items())
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in items], pa.string()), pa.array([c[0] for _, c in items], pa.int64()), pa.array([c[1] for _, c in items], pa.int64())], names=["term", "toxic", "other"])

    return sample.mapInArrow(count, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def choose_terms(candidates: dict[str, tuple[int, int]], texts: list[set[str]]) -> tuple[list[str], list[str]]:
    """Words and stems, each the one that marks most texts not yet marked; a stem needs three candidate words.

    Words that mark many texts, though always beside such terms, follow. Of near copies `texts` holds one.
    """
    heirs: dict[str, int] = {}
    for w in candidates:
        if w[0] != "^":
            for n in STEM_SIZES:
                if len(w) > n:
                    heirs[f"^{w[:n]}"] = heirs.get(f"^{w[:n]}", 0) + 1
    left = {t: {i for i, have in enumerate(texts) if t in have} for t in candidates if t[0] != "^" or heirs.get(t, 0) >= 3}
    chosen: list[str] = []
    while left and len(chosen) < MOST_TERMS:
        best = max(left, key=lambda t: (len(left[t]), candidates[t][0] - 5 * candidates[t][1], -len(t), t))
        gone = left.pop(best)
        if len(gone) < LEAST_TEXTS:
            break
        chosen.append(best)
        for t in left:
            left[t] = left[t] - gone
    often: dict[str, int] = {}
    for have in texts:
        for t in have:
            often[t] = often.get(t, 0) + 1
    sure = [t for t, n in often.items() if t[0] != "^" and n >= max(20, len(texts) // 100, 20 * candidates[t][1]) and t not in chosen and not any(s[0] == "^" and t.startswith(s[1:]) for s in chosen)]
    chosen += sorted(sure, key=lambda t: (-often[t], t))[: MOST_TERMS - len(chosen)]
    return [t for t in chosen if t[0] != "^"], [t[1:] for t in chosen if t[0] == "^"]


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit lexicon, exceptions and weights on the labelled sample. Without toxic texts the lexicon is empty and all scores are low."""
    sample = labelled_sample(docs, labels, rows)
    share = F.col("toxic") / (F.col("toxic") + F.col("other"))
    counts = term_counts(sample).where((F.col("toxic") >= LEAST_TEXTS // 2) & (share >= LEAST_SHARE)).orderBy(F.desc("toxic"), "term").limit(MOST_CANDIDATES).collect()
    candidates = {r["term"]: (r["toxic"], r["other"]) for r in counts}

    def present(batches):
        for batch in batches:
            for part in chunks(batch):
                out, prints = [], []
                for t in part.column(0).to_pylist():
                    code, _, starts, ends = tokens([t or ""])
                    raw = code.tobytes().decode("utf-32-le", "surrogatepass")
                    own = {raw[a:z] for a, z in zip(starts.tolist(), ends.tolist())}
                    raws = [w.encode("utf-8", "surrogatepass") for w in own] or [b""]
                    prints.append(" ".join(str(min(xxhash.xxh32_intdigest(w, seed) for w in raws)) for seed in range(4)))  # alike in near copies
                    own |= {f"^{w[:n]}" for w in own for n in STEM_SIZES if len(w) > n}
                    out.append(sorted(w for w in own if w in candidates))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string())), pa.array(prints, pa.string())], names=["terms", "print"])

    marked = sample.where("toxic = 1").mapInArrow(present, "terms array<string>, print string").collect()  # at most `rows`
    texts = [set(r["terms"]) for r in {r["print"]: r for r in sorted(marked, key=lambda r: (r["print"], r["terms"]))}.values()]
    words, stems = choose_terms(candidates, texts)
    automaton = Automaton(words, stems)

    def measure(batches):
        for batch in batches:
            for part in chunks(batch):
                x, fuzzy = hits([t or "" for t in part.column(0).to_pylist()], automaton, frozenset())
                inexact: list[list[str]] = [[] for _ in range(len(part))]
                for d, *pair in fuzzy:
                    inexact[d] += pair
                yield pa.RecordBatch.from_arrays([part.column(1).cast(pa.int32()), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(inexact, pa.list_(pa.string()))], names=["toxic", "x", "inexact"])

    seen = sample.mapInArrow(measure, "toxic int, x array<double>, inexact array<string>").collect()  # at most `rows`
    discard(sample)
    marks: dict[str, list[int]] = {}
    for r in seen:  # terms and words alternate in inexact
        for w in set(r["inexact"][1::2]) | {f"^{t}" for t in r["inexact"][::2]}:
            marks.setdefault(w, [0, 0])[0 if r["toxic"] else 1] += 1
    exceptions = frozenset(w for w, (a, b) in marks.items() if w[0] != "^" and b and a < 3 * b)
    strict = frozenset(w[1:] for w, (a, b) in marks.items() if w[0] == "^" and b and a < 9 * b)  # terms with harmless neighbours
    again = [r for r in seen if not strict.intersection(r["inexact"][::2])]
    x = np.array([r["x"] for r in again]).reshape(len(again), len(FEATURES))
    y = np.array([r["toxic"] for r in again], dtype=float)
    weights = fit_logistic(x, y) if len(again) and y.any() else np.append(np.zeros(len(FEATURES)), -6.0)
    return ToxicityModel(words, stems, strict, exceptions, weights)


def score(docs: DataFrame, model: ToxicityModel, name: str = "tox_score") -> DataFrame:
    """All columns of docs and, as `name`, the score from the whole text alone; a null text counts as empty.

    Each row has a score of its own, repeated rows the same one; an empty table gives none. A column of docs called `name`
    is replaced; other columns may have any names.
    """
    docs = docs.drop(name)
    columns = docs.columns

    def judge(batches):
        for batch in batches:
            for part in chunks(batch):
                texts = [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(texts), pa.float64())], names=[*columns, name])

    return docs.mapInArrow(judge, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def query_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", F.coalesce(split_remainder() == 2, F.lit(False)).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"))
