"""Personal data: base patterns, and a linear-chain conditional random field over word shapes that adds to them.

The field is trained on the driver from a small labelled table (at most `most_rows` rows) and has a few thousand
weights. Tasks decode every word of every text with Viterbi in numpy. Where a word's own scores for "nothing" lead by more
than any labels of its neighbours could make up for, every best path has "nothing" there; such words cut a text into
stretches that are decoded apart, many at a time, with the same result as the whole.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, table, text_buffer, word_bounds, word_hashes

#: Kinds in order, their patterns and their checks.
KINDS = ("email", "ip", "card", "phone")
_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_HEAD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # runs of digits are taken whole: a part of one matches no more than all of it
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What the field can add: the kinds above and numbers that identify a person.
LABELS = ("O", *KINDS, "id")

#: Labelled examples: word/label pairs, a word without a label is O. Formats that the patterns miss, and what must stay.
LABELLED = """
call/O me at (555)/phone 123-4567/phone today
phone (212)/phone 555-0187/phone ext
tel 555-123-4567/phone or write
ring 415-555-2671/phone after six
office 020/phone 7946/phone 0958/phone london
mobile (415)/phone 555-2671/phone please
fax 312.555.0143/phone thanks
dial 1-800-555-0199/phone now
reach us (030)/phone 901820/phone berlin
tel. 089/phone 1234567/phone munich
cell 646-555-0111/phone and home 646-555-0112/phone
write john.doe/email (at)/email example.com/email soon
mail jane/email [at]/email mail2.example/email now
contact max.muster/email (at)/email web.de/email bitte
email bob/email (at)/email site.org/email or call
ssn 123-45-6789/id on file
social security 987-65-4321/id given
his ssn is 078-05-1120/id ok
her number 219-09-9999/id listed
passport no AB1234567/O was seen
iban DE89/id 3704/id 0044/id 0532/id 0130/id 00/id pay
iban GB29/id NWBK/id 6016/id 1331/id 9268/id 19/id now
card 4111/card 1111/card 1111/card 1111/card exp
visa 5500/card 0000/card 0000/card 0004/card used
host 10.0.0.1/ip up
server 192.168.1.20/ip port 8080
write to a.b@mail.example.com/email today
mail 12@mail3.example.com/email now
born in 1984 in the town
in 2019 there were 350 people
page 12 of 340 shows it
about 25 percent of 1200 units
version 3.14.2 was out in 2020
chapter 7 verse 21 says
the 1990s and 2000s were long
at 10:30 on 12 may 2021 we met
costs 1,299.00 or 15.50 each
room 404 floor 3 block 12
isbn 978-3-16-148410-0 in print
see figure 3-2 and table 4-11 below
token = 8f14e45fceea167a5a36dedd4bea2543 here
key 1eb9c654e721b4f812088970e66a6345cee33dd6 there
sum 123456 plus 654321 gives 777777
score 3-1 and 2-0 at home
model x200 and a4 paper
the and of to 5 in 12 for 100
year 1850-1900 and 1914-1918 war
copyright 2010-2020 all rights
under section 12(3) of act 44
win 1000000 coins in 30 days
@home and @work are handles
the 1st the 2nd the 3rd
room no. 12-14 and 16-18 open
phone number of the house is green
call me in 5 minutes or 10
ip address of the host
"""

def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def at_most_255(digits: str) -> bool:
    """Whether a number of any length, leading zeros too, is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind that pass its check; a match that fails is dropped and not retried."""
    emails, past, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _EMAIL_HEAD:
            start -= 1
        tail = _EMAIL_TAIL.match(text, at) if start < at else None
        if tail:
            emails.append((start, tail.end()))
            past = tail.end()
        at = text.find("@", max(at + 1, past))
    ips = [m.span() for m in _IP.finditer(text) if all(at_most_255(x) for x in m[0].split("."))] if "." in text else []
    cards = []
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                cards.append(m.span())
    phones = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []
    return dict(zip(KINDS, (emails, ips, cards, phones)))


_KEPT_WORDS = frozenset("phone tel tel. call dial ring reach cell mobile fax office ssn security iban card visa mail email write contact number host server ip".split())


def shape(word: str) -> tuple[str, ...]:
    """The observed features of a word: its shape, the shape with runs joined, its ends, and words that announce data."""
    full = re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"[^\x00-\x7f]", "u", word[:40]))))
    short = re.sub(r"(.)\1+", r"\1+", full)
    low = word.lower()
    digits = sum(c in "0123456789" for c in word)
    return (
        f"full={full if len(full) <= 20 else short}", f"short={short}", f"last={full[-1:]}", f"first={full[:1]}", f"digits={min(digits, 12)}",
        f"length={min(len(word), 14)}", f"at={'@' in word}", f"cue={low if low in _KEPT_WORDS else ''}", f"way={low.strip('()[]') == 'at' and low != 'at'}",
        f"date={bool(re.fullmatch('(18|19|20)[0-9][0-9]', word))}", f"alpha={word.isalpha()}",
    )


_ASCII = {c: "0" if chr(c).isdigit() else "a" if chr(c).islower() else "A" if chr(c).isupper() else chr(c) for c in range(128)}
_OTHER = re.compile(r"[^\x00-\x7f]")


def signature(word: str) -> tuple:
    """What shape() depends on: words of one signature have one shape."""
    low, length = word.lower(), len(word)
    full = (word[:40] if word.isascii() else _OTHER.sub("u", word[:40])).translate(_ASCII)
    digits = full.count("0") if length <= 40 else sum(map(word.count, "0123456789"))
    year = length == 4 and digits == 4 and word[:2] in ("18", "19", "20")
    return full, min(length, 14), digits, year, word.isalpha(), low if low in _KEPT_WORDS else low.strip("()[]") == "at" and low != "at", length > 40 and "@" in word


class ShapeField:
    """Linear-chain field: emission weights of each feature at offsets -1, 0 and 1, and transition weights."""

    def __init__(self, labelled: list[tuple[list[str], list[str]]], rounds: int = 250, rate: float = 0.15, l2: float = 0.002):
        self.index: dict[str, int] = {}
        self.memo: dict[str, np.ndarray] = {}
        k = len(LABELS)
        sequences = [([self._row(w, grow=True) for w in words], np.array([LABELS.index(x) for x in tags])) for words, tags in labelled]
        n = len(self.index)
        self.weights, self.moves = np.zeros((3, n + 1, k)), np.zeros((k, k))  # row n: the word before the first and after the last
        sums = [np.zeros_like(self.weights), np.zeros_like(self.moves)]
        for _ in range(rounds):
            step_w, step_m = -l2 * self.weights, -l2 * self.moves
            for rows, tags in sequences:
                scores = self._emit(rows)
                unary, pair = self._marginals(scores)
                gold = np.eye(k)[tags]
                for t in range(len(rows)):
                    for o in (-1, 0, 1):
                        at = rows[t + o] if 0 <= t + o < len(rows) else [n]
                        np.add.at(step_w[o + 1], at, (gold[t] - unary[t]) / len(sequences))
                step_m += (sum(np.outer(a, b) for a, b in zip(gold, gold[1:])) - pair) / len(sequences)
            for x, g, s in zip((self.weights, self.moves), (step_w, step_m), sums):
                s += g * g
                x += rate * g / (np.sqrt(s) + 1e-8)
        self.memo = {}

    def _row(self, word: str, grow: bool = False) -> list[int]:
        if grow:
            return [self.index.setdefault(f, len(self.index)) for f in shape(word)]
        return [self.index[f] for f in shape(word) if f in self.index]

    def _emit(self, rows: list[list[int]]) -> np.ndarray:
        edge = [len(self.index)]
        padded = [edge, *rows, edge]
        return np.array([sum(self.weights[o][padded[t + o]].sum(0) for o in range(3)) for t in range(len(rows))])

    def _marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = scores.shape
        e, m = np.exp(scores - scores.max(1, keepdims=True)), np.exp(self.moves)
        ahead, back = np.empty((n, k)), np.ones((n, k))
        ahead[0] = e[0] / e[0].sum()
        for t in range(1, n):
            x = (ahead[t - 1] @ m) * e[t]
            ahead[t] = x / x.sum()
        pair = np.zeros((k, k))
        for t in range(n - 1, 0, -1):
            x = m @ (e[t] * back[t])
            joint = np.outer(ahead[t - 1], e[t] * back[t]) * m
            pair += joint / joint.sum()
            back[t - 1] = x / x.sum()
        unary = ahead * back
        return unary / unary.sum(1, keepdims=True), pair

    def word_scores(self, word: str) -> np.ndarray:
        """3 x labels: what the word gives to the word after it, itself and the word before it."""
        key = signature(word)
        found = self.memo.get(key)
        if found is None:
            rows = self._row(word)
            found = self.weights[:, rows].sum(1)
            if len(self.memo) > 50_000:
                self.memo.clear()
            self.memo[key] = found
        return found

    def scores(self, table: np.ndarray, which: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """words x labels scores in context; table[which] has each word's word_scores, doc the number of its text."""
        edge = self.weights[:, len(self.index)]
        out = table[which, 1]
        same = doc[1:] == doc[:-1]
        before = np.broadcast_to(edge[0], (len(which), len(LABELS))).copy()
        before[1:][same] = table[which[:-1][same], 0]
        out += before
        behind = np.broadcast_to(edge[2], (len(which), len(LABELS))).copy()
        behind[:-1][same] = table[which[1:][same], 2]
        return out + behind

    def certain(self, scores: np.ndarray) -> np.ndarray:
        """Words that every best path leaves without a label: exchanging the label for O gains more than both moves can lose."""
        m = self.moves
        lost = np.maximum((m - m[:, :1]).max(0), 0) + np.maximum((m - m[:1]).max(1), 0)
        return (scores[:, :1] - scores[:, 1:] > lost[1:] + 1e-9).all(1)

    def label(self, scores: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The best label of each word; texts are the runs of equal doc."""
        out = np.zeros(len(scores), np.int8)
        open_ = np.flatnonzero(~self.certain(scores))
        if not len(open_):
            return out
        new = np.flatnonzero(np.concatenate([[True], (np.diff(open_) > 1) | (doc[open_[1:]] != doc[open_[:-1]])]))
        first, last = open_[new], open_[np.append(new[1:], len(open_)) - 1]
        # a stretch takes along the words without label at its ends
        left = (first > 0) & (doc[np.maximum(first - 1, 0)] == doc[first])
        right = (last + 1 < len(doc)) & (doc[np.minimum(last + 1, len(doc) - 1)] == doc[last])
        begin, length = first - left, last + right + 1 - (first - left)
        order = np.argsort(length, kind="stable")
        while len(order):  # the longest first; cells of one batch are bounded
            now, order = order[-max(1, 200_000 // int(length[order[-1]])) :], order[: -max(1, 200_000 // int(length[order[-1]]))]
            most = int(length[now].max())
            at = begin[now, None] + np.arange(most)
            inside = np.arange(most) < length[now, None]
            part = scores[np.where(inside, at, 0)]
            part[:, 0, 1:] -= 1e9 * left[now, None]
            ends = np.flatnonzero(right[now])
            part[ends, length[now[ends]] - 1, 1:] -= 1e9
            out[at[inside]] = self.viterbi(part, length[now])[inside]
        return out

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best labels of sequences x words x labels, each as long as its length says."""
        n, most, k = scores.shape
        best, back = scores[:, 0], np.zeros((most, n, k), np.int8)
        for t in range(1, most):
            step = best[:, :, None] + self.moves[None]
            back[t] = step.argmax(1)
            best = np.where((lengths > t)[:, None], step.max(1) + scores[:, t], best)
        labels, now = np.zeros((n, most), np.int8), best.argmax(1)
        for t in range(most - 1, -1, -1):
            labels[:, t] = now
            now = np.where(lengths > t, back[t][np.arange(n), now], now) if t else now
        return labels

    def decode(self, windows: list[list[str]]) -> list[np.ndarray]:
        """The best label of each word of each sequence."""
        table = np.array([self.word_scores(w) for words in windows for w in words]).reshape(-1, 3, len(LABELS))
        doc = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
        labels = self.label(self.scores(table, np.arange(len(table)), doc), doc)
        return np.split(labels, np.cumsum([len(w) for w in windows])[:-1])


def parse_labelled(text: str = LABELLED) -> list[tuple[list[str], list[str]]]:
    out = []
    for line in text.strip().split("\n"):
        pairs = [x.rsplit("/", 1) if "/" in x and x.rsplit("/", 1)[-1] in LABELS else [x, "O"] for x in line.split()]
        out.append(([w for w, _ in pairs], [t for _, t in pairs]))
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(parse_labelled(), "words array<string>, labels array<string>")


def train(labelled: DataFrame, most_rows: int = 2000) -> ShapeField:
    """Fit the field on at most most_rows rows (words, labels), in a fixed order."""
    rows = labelled.orderBy("words", "labels").limit(most_rows).collect()
    return ShapeField([(list(r["words"]), list(r["labels"])) for r in rows if r["words"]])


_TRIM = "#*$%&|<>,;:!?\"'"


def added_spans(texts: list[str], found: list[dict], field: ShapeField) -> list[list[tuple[str, int, int]]]:
    """Spans that the field finds and that touch no base span: runs of one label, without symbols at the ends."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    buf, bounds = text_buffer(pa.array(texts, pa.string()))
    doc, starts, ends = word_bounds(buf, bounds)
    if not len(doc):
        return out
    _, first, which = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    raw = buf.tobytes()
    table = np.array([field.word_scores(raw[a:z].decode().strip(_TRIM) or "-") for a, z in zip(starts[first].tolist(), ends[first].tolist())])
    labels = field.label(field.scores(table, which, doc), doc)
    new = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])]))
    past = np.append(new[1:], len(labels))
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])  # code points before each byte
    known: dict[int, tuple[list[int], np.ndarray]] = {}
    for i, j in zip(new, past):
        if not labels[i]:
            continue
        d = int(doc[i])
        t, origin = texts[d], points[bounds[d]]
        a, b = int(points[starts[i]] - origin), int(points[ends[j - 1]] - origin)
        while a < b and t[a] in _TRIM:
            a += 1
        while b > a and t[b - 1] in _TRIM + ".":
            b -= 1
        label = LABELS[labels[i]]
        digits = sum(map(t[a:b].count, "0123456789"))
        fits = digits >= 7 if label in ("phone", "card", "id") else digits >= 4 if label == "ip" else True
        if d not in known:
            base = sorted(span for spans in found[d].values() for span in spans)
            known[d] = [x for x, _ in base], np.maximum.accumulate([y for _, y in base] or [0])
        begins, reach = known[d]
        k = bisect.bisect_left(begins, b)  # base spans that begin before the end; one of them may reach over the start
        if a < b and fits and not (k and reach[k - 1] > a):
            out[d].append((label, a, b))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (LABELS.index(x[0]), x[1])))


def find(docs: DataFrame, field: ShapeField, redact: bool = False) -> DataFrame:
    """Spans of personal data in each whole text; a null text counts as empty and has none.

    Returns doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base matches, and spans: base ones and those the
    field adds, as kind:start:end in code points. With redact, only the columns of docs, each span in `text` replaced by its
    kind in brackets (a null text stays null). Repeated rows are each scanned; an empty table gives no rows. Columns other
    than doc_id and text are not read, or with redact come through as they are, whatever their names.
    """
    columns = docs.columns
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def scan(batches):
        for batch in batches:
            for part in chunks(batch):
                raw = part.column(part.schema.get_field_index("text")).to_pylist()
                texts = [t or "" for t in raw]
                found = [base_spans(t) for t in texts]
                base = [[(k, a, b) for k in KINDS for a, b in f[k]] for f in found]
                spans = [x + y for x, y in zip(base, added_spans(texts, found, field))]
                if redact:
                    clean = [t if t is None else replaced(t, s) for t, s in zip(raw, spans)]
                    yield pa.RecordBatch.from_arrays([pa.array(clean, pa.string()) if c == "text" else part.column(i) for i, c in enumerate(part.schema.names)], names=columns)
                else:
                    counts = [pa.array([len(f[k]) for f in found], pa.int64()) for k in KINDS]
                    sha = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string())
                    yield pa.RecordBatch.from_arrays([part.column(0), *counts, sha, pa.array([joined(s) for s in spans], pa.string())], names=names)

    if redact:
        return docs.mapInArrow(scan, docs.schema)
    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def query_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), train(labelled_table(spark)))
