"""Token ids of whole texts, word by word, for a tokenizer with lower case, white space dropped and word ends.

Texts of ASCII and Latin-1 letters are cut into the tokenizer's pre-tokens on their bytes, in numpy; each distinct
pre-token is encoded once per worker and looked up afterwards.  Any other text (other scripts, combining marks, the
strings of special tokens) goes whole through the tokenizers library.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from pageforge.llm.common import SpanHasher, byte_view

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3

_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[48:58] = DIGIT
_CLASS[65:91] = LETTER
_CLASS[97:123] = LETTER
_CLASS[128:] = LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters (lead byte 0xC3; its 0x97 is the multiplication sign)."""
    low = _LOWER[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    up = after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    low[up] += 32
    return low


def plain_rows(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows that hold nothing but ASCII and lead byte 0xC3, and no "<|"."""
    odd = (data >= 0xC0) & (data != 0xC3)
    if len(data) > 1:
        odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(odd, out=total[1:])
    return total[off[1:]] == total[off[:-1]]


def pretokens(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters, single digits, runs of other marks, and English contractions."""
    n = len(low)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = _CLASS[low]
    sign = np.flatnonzero((low[:-1] == 0xC3) & ((low[1:] == 0x97) | (low[1:] == 0xB7)))
    cls[sign] = OTHER
    cls[sign + 1] = OTHER
    edge = np.ones(n + 1, bool)
    edge[1:n] = (cls[1:] != cls[:-1]) | (cls[1:] == DIGIT)
    edge[off] = True
    starts = np.flatnonzero(edge[:-1] & (cls != SPACE))
    ends = np.flatnonzero(edge[1:] & (cls != SPACE)) + 1
    if len(starts) < 2:
        return starts, ends
    first = np.zeros(n + 1, bool)
    first[off] = True
    q = np.flatnonzero((low[starts[:-1]] == 0x27) & (ends[:-1] - starts[:-1] == 1) & (starts[1:] == ends[:-1]) & (cls[starts[1:]] == LETTER) & ~first[starts[1:]])
    if len(q):
        s, e = starts[q + 1], ends[q + 1]
        a, b = low[s], np.where(e - s > 1, low[np.minimum(s + 1, n - 1)], 0)
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        k = np.where(one, 1, np.where(two, 2, 0))
        ends[q] += k
        starts[q + 1] += k
        keep = starts < ends
        starts, ends = starts[keep], ends[keep]
    return starts, ends


class KeyTable:
    """Open addressing over numpy arrays: 64-bit key to row number, looked up for whole arrays at once."""

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.size = bits, 0
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        mask, at = np.int64((1 << self.bits) - 1), (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.rows[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(todo):
            step = (at[todo] + 1) & mask
            at[todo] = step
            out[todo] = self.rows[step]
            todo = todo[(out[todo] >= 0) & (self.keys[step] != keys[todo])]
        return out

    def add(self, keys: np.ndarray, first: int) -> None:
        """Distinct keys that it doesn't have yet; they get rows from `first` on."""
        if (self.size + len(keys)) * 2 > 1 << self.bits:
            held, rows = self.keys[self.rows >= 0], self.rows[self.rows >= 0]
            while (self.size + len(keys)) * 2 > 1 << self.bits:
                self.bits += 1
            self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
            self._put(held, rows)
        self._put(keys, np.arange(first, first + len(keys), dtype=np.int32))
        self.size += len(keys)

    def _put(self, keys: np.ndarray, rows: np.ndarray) -> None:
        mask, at = np.int64((1 << self.bits) - 1), (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.rows[at[todo]] < 0]
            _, pick = np.unique(at[free], return_index=True)
            won = free[pick]
            self.keys[at[won]], self.rows[at[won]] = keys[won], rows[won]
            todo = todo[self.rows[at[todo]] != rows[todo]]
            at[todo] = (at[todo] + 1) & mask


class WordCodes:
    """The ids of texts; `encode_words` gets distinct pre-tokens, `encode_texts` gets whole unusual texts."""

    def __init__(self, encode_words: Callable, encode_texts: Callable, most: int = 1_000_000) -> None:
        self.encode_words, self.encode_texts, self.most = encode_words, encode_texts, most
        self.hash = SpanHasher()
        self.clear()

    def clear(self) -> None:
        self.table, self.flat, self.used, self.n = KeyTable(), np.zeros(1 << 16, np.uint16), 0, 0
        self.start, self.length = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def _learn(self, low: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if self.n > self.most or self.used > 8 * self.most:  # about 50 MB; results do not depend on what is held
            self.clear()
        new, at = np.unique(keys, return_index=True)
        if self.n:
            gone = self.table.find(new) < 0
            new, at = new[gone], at[gone]
        if not len(new):
            return
        raw = low.tobytes()
        ids = self.encode_words([raw[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist())])
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for row in ids for x in row), np.uint32, int(length.sum()))
        if len(flat) and self.flat.dtype == np.uint16 and int(flat.max()) >> 16:
            self.flat = self.flat.astype(np.uint32)
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat) // 2, len(flat)), self.flat.dtype)])
        while self.n + len(new) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[self.n : self.n + len(new)] = self.used + np.cumsum(length) - length
        self.length[self.n : self.n + len(new)] = length
        self.table.add(new, self.n)
        self.used, self.n = self.used + len(flat), self.n + len(new)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows one after the other, and each row's offsets in them."""
        data, off = byte_view(texts)
        plain = plain_rows(data, off)
        low = fold(data)
        starts, ends = pretokens(low, off)
        row = np.searchsorted(off, starts, side="right") - 1
        if not plain.all():
            keep = plain[row]
            starts, ends, row = starts[keep], ends[keep], row[keep]
        keys = self.hash(low, starts, ends)
        at = self.table.find(keys)
        if (at < 0).any():
            miss = np.flatnonzero(at < 0)
            self._learn(low, keys[miss], starts[miss], ends[miss])
            at = self.table.find(keys)
            if (at < 0).any():  # cleared meanwhile
                miss = np.flatnonzero(at < 0)
                self._learn(low, keys[miss], starts[miss], ends[miss])
                at = self.table.find(keys)
        length = self.length[at].astype(np.int64)
        end = np.cumsum(length)
        total = int(end[-1]) if len(end) else 0
        ids = self.flat[np.repeat(self.start[at] - (end - length), length) + np.arange(total)].astype(np.uint32)
        words = np.searchsorted(row, np.arange(len(plain) + 1))
        bounds = np.concatenate([[0], end])[words]
        if plain.all():
            return ids, bounds
        parts, size = [], np.diff(bounds)
        odd = np.flatnonzero(~plain)
        others = dict(zip(odd.tolist(), self.encode_texts([texts[i].as_py() for i in odd.tolist()])))
        for i in range(len(plain)):
            parts.append(np.asarray(others[i], np.uint32) if i in others else ids[bounds[i] : bounds[i + 1]])
            size[i] = len(parts[-1])
        return np.concatenate(parts) if parts else ids, np.concatenate([[0], np.cumsum(size)])


_held: dict = {}


def forget() -> None:
    """Empties the worker's tables: stages that need memory for other things call it."""
    for codes in _held.values():
        codes.clear()


def library_codes(path: str) -> WordCodes:
    """The ids that the tokenizers library gives; one per worker, kept between tasks."""
    if path not in _held:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()

        def run(texts: list[str]) -> list[list[int]]:
            return [x.ids for x in own.encode_batch_fast(texts, add_special_tokens=False)]

        _held[path] = WordCodes(run, run)
    return _held[path]
