"""Token ids of whole texts by a public tokenizer that lower-cases and whose tokens never cross white space.

Each distinct piece of text is encoded once per worker and found again by its
bytes; texts are put together from these with NumPy. Pieces are words
between ASCII white space, cut further where the tokenizer surely cuts too:
between an ASCII letter and ASCII punctuation or digits, and around ASCII
digits, but not before a letter that an apostrophe precedes (contractions) nor
next to bytes of other characters, which may combine. A-Z is lower-cased first
where no such character follows. A block in which the text of a special token
stands is taken by whole words as they are. So the ids equal those of encoding
the whole text.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa

from finlake.llm.kernels import LOWER, distinct_spans, slices, text_bytes, words

OTHER, LETTER, DIGIT, PUNCTUATION = range(4)
KIND = np.full(256, PUNCTUATION, np.uint8)
KIND[128:] = OTHER
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[48:58] = DIGIT
#: Bytes that may follow a lower-cased letter: ASCII, or the lead byte of Latin-1 letters.
PLAIN = np.zeros(256, bool)
PLAIN[:128] = PLAIN[0xC3] = True


def pieces(data: np.ndarray, bounds: np.ndarray, specials: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, row) of the pieces to encode."""
    start, end, row = words(data, bounds)
    lowered = LOWER[data]
    raw = lowered.tobytes()
    if not len(data) or any(s in raw for s in specials):
        return data, start, end, row
    follows = np.append(PLAIN[data[1:]], True)
    data = np.where(follows, lowered, data)
    kind = KIND[data]
    before, after = kind[:-1], kind[1:]
    cut = (before != OTHER) & (after != OTHER) & ((before != after) | (before == DIGIT)) & ~((data[:-1] == 0x27) & (after == LETTER))
    first = np.zeros(len(data) + 1, bool)
    first[1:-1] = cut
    last = first.copy()  # a piece ends where the next begins
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    first[:-1] &= inside
    first[start] = True
    last[:-1] &= inside
    last[start] = False
    starts = np.flatnonzero(first)
    ends = np.sort(np.concatenate((np.flatnonzero(last), end)))
    return data, starts, ends, np.searchsorted(bounds, starts, "right") - 1


class WordEncoder:
    """``path``: a tokenizers JSON file. ``most``: pieces kept before the memory starts anew."""

    def __init__(self, path: str, most: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.specials = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.reset()

    def reset(self) -> None:
        self.place: dict[bytes, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1 << 12, np.int64)
        self.known = 0

    def learn(self, texts: list[bytes]) -> None:
        made = self.tokenizer.encode([t.decode() for t in texts], is_pretokenized=True, add_special_tokens=False)
        # Each id with the number of the text it comes from.
        found, count = np.array(made.ids, np.uint32), np.bincount(np.array(made.word_ids, np.int64), minlength=len(texts))
        ends = self.bounds[self.known] + np.cumsum(count)
        while ends[-1] > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while self.known + len(texts) + 1 > len(self.bounds):
            self.bounds = np.concatenate((self.bounds, np.zeros_like(self.bounds)))
        self.pool[self.bounds[self.known] : ends[-1]] = found
        self.bounds[self.known + 1 : self.known + 1 + len(texts)] = ends
        self.place.update(zip(texts, range(self.known, self.known + len(texts))))
        self.known += len(texts)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of all rows; null and empty texts have no ids."""
        data, bounds = text_bytes(column)
        made = [self._encode(part, at) for part, at in slices(data, bounds)]
        count = sum(n for _, n in made)
        return np.concatenate([ids for ids, _ in made]), np.concatenate(([0], np.cumsum(count)))

    def _encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each row)."""
        data, start, end, row = pieces(data, bounds, self.specials)
        if self.known > self.most:
            self.reset()
        first, back = distinct_spans(data, start, end)
        raw = data.tobytes()
        keys = [raw[s:e] for s, e in zip(start[first].tolist(), end[first].tolist())]
        place = np.fromiter(map(self.place.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = np.arange(self.known, self.known + len(new))
            self.learn([keys[i] for i in new.tolist()])
        place = place[back]
        begin, count = self.bounds[place], self.bounds[place + 1] - self.bounds[place]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat((begin - (ends - count)).astype(np.int32), count)
        at += np.arange(total, dtype=np.int32)
        ids = self.pool.take(at)
        return ids, np.bincount(row, weights=count, minlength=len(bounds) - 1).astype(np.int64)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
