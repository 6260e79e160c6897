"""Token ids of many texts with a word tokenizer, in numpy, remembering the ids of pieces that were met before."""

from __future__ import annotations

import numpy as np

from .common import _WHITE, word_hashes

#: Classes of characters below U+0250 as the tokenizer's pre-tokenizer has them: white, letters, numbers, the rest.
WHITE, LETTER, NUMBER, OTHER, ODD = range(5)
_CLASS = np.full(0x280, ODD, dtype=np.uint8)
_CLASS[:0x250] = OTHER
for _a, _z in ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F)):
    _CLASS[_a : _z + 1] = LETTER
for _a, _z in ((0x30, 0x39), (0xB2, 0xB3), (0xB9, 0xB9), (0xBC, 0xBE)):
    _CLASS[_a : _z + 1] = NUMBER
_CLASS[[*range(9, 14), 0x20, 0x85, 0xA0]] = WHITE
#: Characters whose words the tokenizer takes whole: contractions, special tokens, and one whose lower case is two characters.
_CLASS[[ord("'"), ord("<"), 0x130]] = ODD


def pieces(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of each piece that the tokenizer encodes apart, and whether it is a whole odd word.

    Pieces are runs of letters, single numbers and runs of other characters; a word with an odd character stays whole.
    """
    n = len(buf)
    lead = (buf & 0xC0) != 0x80
    code = buf.astype(np.int32)
    two = np.flatnonzero((buf >= 0xC2) & (buf < 0xCA))
    code[two] = (code[two] & 0x1F) << 6 | (code[two + 1] & 0x3F)
    kind = np.full(n, ODD, dtype=np.uint8)
    plain = (buf < 0x80) | ((buf >= 0xC2) & (buf < 0xCA))
    kind[plain] = _CLASS[code[plain]]
    follow = np.flatnonzero(~lead)
    for _ in range(3):  # continuation bytes take the class of their character
        kind[follow] = kind[follow - 1]
    # words between ASCII white space, and those with an odd character
    ascii_white = _WHITE[buf]
    new = np.zeros(n, dtype=bool)
    new[bounds[:-1][bounds[:-1] < n]] = True
    new[1:] |= ascii_white[:-1]
    word = np.cumsum(new | ascii_white, dtype=np.int32)
    odd = np.zeros(int(word[-1]) + 1 if n else 1, dtype=bool)
    odd[word[(kind == ODD) & ~ascii_white]] = True
    whole = odd[word] & ~ascii_white
    first = new.copy()
    first[1:] |= (kind[1:] != kind[:-1]) | ((kind[1:] == NUMBER) & lead[1:])
    first = np.where(whole, new, first & lead)
    first[bounds[:-1][bounds[:-1] < n]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], n)
    kept = whole[starts] | (kind[starts] != WHITE)
    starts, ends = starts[kept], ends[kept]
    return starts, ends, whole[starts]


class TokenMemo:
    """Ids of pieces by their hash, at most `most` pieces; then it starts anew."""

    def __init__(self, tokenizer, most: int = 1_000_000):
        self.tokenizer, self.most = tokenizer, most
        self.ends = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
        for token, i in tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.hashes, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _encode(self, words: list[str], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end and how many each word has; ordinary pieces are encoded many at once, split where a word ends."""
        sizes, ids = np.zeros(len(words), np.int64), [np.zeros(0, np.uint32)] * len(words)
        plain = np.flatnonzero(~whole)
        for lo in range(0, len(plain), 4096):
            part = plain[lo : lo + 4096]
            got = np.array(self.tokenizer.encode(" ".join([words[i] for i in part]), add_special_tokens=False).ids, dtype=np.uint32)
            cuts = np.flatnonzero(self.ends[got]) + 1
            if len(cuts) == len(part):
                for i, x in zip(part, np.split(got, cuts[:-1])):
                    ids[i] = x
            else:
                whole[part] = True
        for lo in range(0, len(odd := np.flatnonzero(whole)), 4096):
            part = odd[lo : lo + 4096]
            for i, e in zip(part, self.tokenizer.encode_batch([words[i] for i in part], add_special_tokens=False)):
                ids[i] = np.array(e.ids, dtype=np.uint32)
        sizes[:] = [len(x) for x in ids]
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), sizes

    def ids(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a buffer end to end, and each text's bounds there."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        starts, ends, whole = pieces(buf, bounds)
        hashes = word_hashes(buf, starts, ends)
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, unique)
        known = place < len(self.hashes)
        known[known] = self.hashes[place[known]] == unique[known]
        if not known.all():
            if len(self.hashes) + int((~known).sum()) > self.most:
                self.clear()
                known[:] = False
            new = np.flatnonzero(~known)
            raw = buf.tobytes()
            words = [raw[a:z].decode() for a, z in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            got, sizes = self._encode(words, whole[first[new]].copy())
            while self.used + len(got) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(got)] = got
            at = self.used + np.cumsum(sizes) - sizes
            self.used += len(got)
            into = np.searchsorted(self.hashes, unique[new])
            self.hashes, self.at, self.size = np.insert(self.hashes, into, unique[new]), np.insert(self.at, into, at), np.insert(self.size, into, sizes)
            place = np.searchsorted(self.hashes, unique)
        at, size = self.at[place][which], self.size[place][which].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        out = self.pool[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        return out, total[np.searchsorted(starts, bounds)]
