"""Personal data by patterns and a linear-chain conditional random field (operator 1).

Patterns give the base spans.  The field reads word shapes (letters, digit runs by length, single marks), is trained
on the small labelled table below, and is decoded by Viterbi in numpy over many sequences at once.  It adds spans that
the patterns miss (telephone numbers without a plus sign, addresses with "[at]", spaced numbers) and a kind that they
do not know (secrets: keys and tokens); added spans that touch a base span go, base spans always stay.

A sequence is a stretch of words around a digit or an at sign: elsewhere every word's shape is plain, and a plain
word is never part of a span.  Null and empty texts have no spans.  Repeated rows give repeated rows, an empty table an
empty one; ties between labels go to the first label in the order of `LABELS`.  A text is read whole, whatever its
length: a row that is longer than a slice is a slice of its own.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageforge.llm.common import byte_view, pick, slices, table

#: The kinds that the patterns find; the field finds secrets (keys, tokens) besides.
KINDS = ("email", "ip", "card", "phone")
EVERY = (*KINDS, "secret")
LABELS = ("O", *(f"{p}-{k}" for k in EVERY for p in "BI"))

#: The labelled table: {kind|text} marks a span, all other words are outside.
LABELLED = (
    "call me at {phone|(415) 555-0132} after noon", "my number is {phone|415-555-0199}, thanks", "tel. {phone|0171 555 0142} or write",
    "phone: {phone|555-0173-220}", "fax {phone|(030) 5550 1234} und post", "ring {phone|020 7946 0958} today", "Tel {phone|01 99 00 12 34}.",
    "contact {phone|+1 (286) 555-5136} heednt oner", "appelez le {phone|+33 1 99 00 48 12} demain", "{phone|(212) 555-0187}", "number {phone|212.555.0143} is mine",
    "mobile {phone|07700 900123}, office {phone|(020) 7946 0011}", "(see {phone|(555) 010-9988})", "llame al {phone|91 555 01 77} hoy", "call {phone|1-800-555-0155} now",
    "write to {email|anna.b@mail.example.com} now", "mail {email|joe [at] example.org} please", "{email|k.lee (at) example.net}", "is {email|that.92@mail2.example.com}### that",
    "send {email|max_m [at] post.example.de} a note", "contact {email|info@example.org}, or call", "{email|ops+x@a-b.example.io} wrote", "from {email|mary (at) example.co.uk} today",
    "server {ip|192.168.10.4} is down", "host {ip|10.0.0.17}, port 80", "from {ip|203.0.113.9} to {ip|198.51.100.23}", "ping {ip|127.0.0.1}.", "login from {ip|172.16.254.1} failed",
    "card {card|4111 1111 1111 1111} expires", "pay with {card|5500-0000-0000-0004} now", "{card|4785380592391139} was used", "no. {card|3400 0000 0000 0090 12} ok", "visa {card|4012888888881881}, thanks",
    "on 12 March 2021 we met", "the year 1998 was good", "in 2020-04-15 at 10:30", "at 09:45:12 on 3/4/2019", "costs $ 1,299.00 each", "EUR 45.50 per unit", "version 3.11.4 of it",
    "page 12 of 340", "chapter 4, section 2.3.1", "ISBN 978-3-16-148410-0 printed", "sha 6df57b16f87eabefefcab67b433efd90636bb6bd ok", "commit 9e107d9d372bb6826bd81d3542a419d6 of it",
    "token = \"{secret|1eb9c654e721b4f812088970e66a63ac}\"", "the token = \"{secret|e7fbfec6a80404dc513b99d3fdbf2a6e53400638}\" lay", "api_key = \"{secret|sk4f9a0c2b7d8e1f6a5b3c2d1e}\"", "TOKEN = \"{secret|9233A8ECF7C5B09FE5949719B6B82BC439E9329B}\"!! AND",
    "secret: \"{secret|a8f5f167f44f4964e6c998dee827110c}\" here", "key = '{secret|0cc175b9c0f1b6a831c399e269772661}' set", "set \"{secret|92eb5ffee6ae2fec3ad71c777531578f3e2a}\" now", "token = \"{secret|40d78a45c418324758e099eb7cb89bc0f5fa9f62}\"### La", "x = \"{secret|4a8a08f09d37b73795649038408b5f33d9fc1c80}\".",
    "he said \"the 3 of us\" and", "a \"b2b\" firm", "model \"x200\" is out", "name = \"unit 7\" set", "\"R2D2\" and \"C3PO\" met", "code \"4f2a\" fits", "id = \"12345678\" of", "\"2021-04-05\" is", "key = \"abc123\" ok",
    "order 100234 shipped", "id: 48219", "a 10% rise, then 5%", "between 100 and 200 people", "rated 4.5 / 5 stars", "lines 10-20 and 31-40", "pp. 123-145, vol. 7", "in 1999-2004 they",
    "64 bit, 3.2 GHz and 16 GB", "scored 3-2 at home", "see rfc 2616 and 7230", "room 12b, floor 3", "x = 3 + 4 * 5", "12 345 678 units", "1 2 3 4 5 6 7", "tel aviv in 2003", "phone it in",
    "License, Version 2.0.", "license, version 3.", "CC BY-NC 4.0 applies", "item @ 5 each", "@user said 20 things", "# 17 @ home", "the 3 of 4 (2001) in", "(1998) and (2004)", "no 5, no 6, no 7",
    "20-30-40 plan", "coordinates 48.8566, 2.3522 there", "10.1000/182 is a doi", "arXiv 2101.00001 v2", "born 07.11.1985 in", "am 24.12.2020 um 18.30", "the 2nd and 3rd of 1000", "99 888 777 666 stars", "ref 2021/0045-3",
    "100 200 300 400 500 600", "7 8 9 10 11 12 13", "section 1.2.3.4.5.6 ends", "1-2-3-4-5-6-7-8 go", "2019 2020 2021 2022 2023",
)

#: Word shapes; digit runs by length, letters by case, one shape for each mark that matters.
_MARKS = "@.-()+/:,=\"$%#[]_'"
SHAPES = ("edge", "lower", "Title", "UPPER", "mixed", "other", *(f"d{n}" for n in (1, 2, 3, 4, 5, 7, 10, 13, 17)), "at", *_MARKS)
_SHAPE = {s: i for i, s in enumerate(SHAPES)}
_CLASS = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 mark
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_MARK_SHAPE = np.full(256, _SHAPE["other"], np.int16)
for _m in _MARKS:
    _MARK_SHAPE[ord(_m)] = _SHAPE[_m]
_RUN_SHAPE = np.array([_SHAPE["d1"], *(_SHAPE[f"d{max(k for k in (1, 2, 3, 4, 5, 7, 10, 13, 17) if k <= n)}"] for n in range(1, 21))], np.int16)
#: Words on either side of a digit or an at sign that belong to its sequence.
MARGIN = 4


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, shapes, and whether white space or the text's start comes before: runs of letters or digits, single marks."""
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.int64),) * 4
    cls = _CLASS[data]
    edge = np.ones(n + 1, bool)
    edge[1:n] = (cls[1:] != cls[:-1]) | (cls[1:] == 3)
    edge[off] = True
    starts = np.flatnonzero(edge[:-1] & (cls != 0))
    ends = np.flatnonzero(edge[1:] & (cls != 0)) + 1
    kind, size = cls[starts], ends - starts
    gap = np.ones(len(starts), bool)
    if len(starts):
        gap[1:] = starts[1:] != ends[:-1]
        first = np.zeros(n + 1, bool)
        first[off] = True
        gap |= first[starts]
    upper = np.zeros(n + 1, np.int32)
    np.cumsum((data >= 65) & (data < 91), out=upper[1:])
    caps = upper[ends] - upper[starts]
    one = (data[starts] >= 65) & (data[starts] < 91)
    shape = np.where(caps == 0, _SHAPE["lower"], np.where((caps == 1) & one, _SHAPE["Title"], np.where(caps == size, _SHAPE["UPPER"], _SHAPE["mixed"]))).astype(np.int16)
    shape = np.where(kind == 2, _RUN_SHAPE[np.minimum(size, 20)], np.where(kind == 3, _MARK_SHAPE[data[starts]], shape))
    two = np.flatnonzero((kind == 1) & (size == 2))
    at = two[((data[starts[two]] | 32) == 97) & ((data[starts[two] + 1] | 32) == 116)]
    shape[at] = _SHAPE["at"]
    return starts, ends, shape, gap


#: Each word's features: its shape and its neighbours' shapes, alone, in pairs and with white space.
_N = len(SHAPES)
_SPOTS = (-3, -2, -1, 0, 1, 2, 3)
_SIZES = (*(2 * _N for _ in _SPOTS), _N * _N, _N * _N, _N * _N)
_OFFSETS = np.concatenate([[0], np.cumsum(_SIZES)[:-1]])
N_FEATURES = int(sum(_SIZES))


def features(shape: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """[sequence, place] shapes and gaps to [sequence, place, feature] numbers."""
    padded = np.pad(shape.astype(np.int64), ((0, 0), (3, 3)))
    spaced = np.pad(gap.astype(np.int64), ((0, 0), (3, 3)))
    n = shape.shape[1]
    at = {k: padded[:, 3 + k : 3 + k + n] for k in _SPOTS}
    cols = [2 * at[k] + spaced[:, 3 + k : 3 + k + n] for k in _SPOTS]
    cols += [at[-1] * _N + at[0], at[0] * _N + at[1], at[-2] * _N + at[-1]]
    return np.stack(cols, -1) + _OFFSETS


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class Field:
    """A linear-chain conditional random field: emission[feature, label], step[label, label], start[label]."""

    def __init__(self) -> None:
        y = len(LABELS)
        self.emission, self.step, self.start = np.zeros((N_FEATURES, y)), np.zeros((y, y)), np.zeros(y)
        for i, a in enumerate(LABELS):  # an inside label follows the same kind only
            for j, b in enumerate(LABELS):
                if b[0] == "I" and a[1:] != b[1:]:
                    self.step[i, j] = -1e4
        self.start[[j for j, b in enumerate(LABELS) if b[0] == "I"]] = -1e4

    def scores(self, feats: np.ndarray) -> np.ndarray:
        out = self.emission[feats[:, :, 0]]
        for k in range(1, feats.shape[2]):
            out = out + self.emission[feats[:, :, k]]
        return out

    def train(self, feats: np.ndarray, mask: np.ndarray, gold: np.ndarray, rounds: int = 120, rate: float = 0.35, ridge: float = 0.02) -> None:
        """AdaGrad on the penalized likelihood; expectations by forward and backward sums over all sequences at once."""
        n, t, y = *gold.shape, len(LABELS)
        params = [self.emission, self.step, self.start]
        past = [np.full_like(p, 1e-8) for p in params]
        fixed = [np.zeros_like(self.emission, bool), self.step < -1e3, self.start < -1e3]
        rows = np.arange(n)
        last = mask.sum(1) - 1
        for _ in range(rounds):
            e = self.scores(feats)
            a = np.zeros((n, t, y))
            a[:, 0] = self.start + e[:, 0]
            for k in range(1, t):
                a[:, k] = np.where(mask[:, k, None], _lse(a[:, k - 1, :, None] + self.step, 1) + e[:, k], a[:, k - 1])
            z = _lse(a[:, -1], 1)
            b = np.zeros((n, t, y))
            grads = [np.zeros_like(p) for p in params]
            for k in range(t - 2, -1, -1):
                ahead = self.step + (e[:, k + 1] + b[:, k + 1])[:, None, :]
                b[:, k] = np.where(mask[:, k + 1, None], _lse(ahead, 2), 0)
                joint = np.exp(a[:, k, :, None] + ahead - z[:, None, None]) * mask[:, k + 1, None, None]
                grads[1] -= joint.sum(0)
            p = np.exp(a + b - z[:, None, None]) * mask[:, :, None]
            truth = np.zeros_like(p)
            truth[rows[:, None], np.arange(t), gold] = 1
            gap = truth * mask[:, :, None] - p
            for k in range(feats.shape[2]):
                np.add.at(grads[0], feats[:, :, k], gap)
            np.add.at(grads[1], (gold[:, :-1], gold[:, 1:]), mask[:, 1:].astype(float))
            grads[2] += gap[:, 0].sum(0)
            for q, g, h, f in zip(params, grads, past, fixed):
                g = np.where(f, 0, g - ridge * q)
                h += g * g
                q += np.where(f, 0, rate * g / np.sqrt(h))
        assert (last >= 0).all()

    def decode(self, feats: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The best labels of each sequence, by Viterbi over the whole batch."""
        e = self.scores(feats)
        n, t, y = e.shape
        best, back = self.start + e[:, 0], np.zeros((n, t, y), np.int8)
        same = np.arange(y, dtype=np.int8)
        for k in range(1, t):
            move = best[:, :, None] + self.step
            back[:, k] = np.where(mask[:, k, None], move.argmax(1), same)
            best = np.where(mask[:, k, None], move.max(1) + e[:, k], best)
        out = np.zeros((n, t), np.int64)
        out[:, -1] = best.argmax(1)
        for k in range(t - 1, 0, -1):
            out[:, k - 1] = back[np.arange(n), k, out[:, k]]
        return out


def _parse(row: str) -> tuple[str, list[tuple[int, int, str]]]:
    text, spans = "", []
    for part in re.split(r"(\{[a-z]+\|[^}]*\})", row):
        if part.startswith("{") and "|" in part:
            kind, _, body = part[1:-1].partition("|")
            spans.append((len(text), len(text) + len(body), kind))
            part = body
        text += part
    return text, spans


def train(rows: tuple[str, ...] = LABELLED) -> Field:
    """The field for a small labelled table; the same weights each time."""
    seqs = []
    for row in rows:
        text, spans = _parse(row)
        data = np.frombuffer(text.encode(), np.uint8)
        s, e, shape, gap = words(data, np.array([0, len(data)]))
        gold = np.zeros(len(s), np.int64)
        for a, b, kind in spans:
            own = np.flatnonzero((s >= a) & (e <= b))
            gold[own] = LABELS.index(f"I-{kind}")
            gold[own[0]] = LABELS.index(f"B-{kind}")
        seqs.append((shape, gap, gold))
    t = max(len(x[0]) for x in seqs)
    pad = lambda i: np.stack([np.pad(x[i], (0, t - len(x[i]))) for x in seqs])
    mask = np.stack([np.arange(t) < len(x[0]) for x in seqs])
    field = Field()
    field.train(features(pad(0), pad(1)), mask, pad(2))
    return field


def field_spans(field: Field, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, str]]:
    """(row, start, end, kind) by byte, of every row of a buffer."""
    s, e, shape, gap = words(data, off)
    kind = _CLASS[data[s]]
    hot = np.flatnonzero((kind == 2) | (shape == _SHAPE["@"]) | (shape == _SHAPE["at"]) & (np.roll(shape, 1) >= _SHAPE["("]) & (np.roll(gap, -1) == 0))
    if not len(hot):
        return []
    row = np.searchsorted(off, s, side="right") - 1
    low = np.searchsorted(row, np.arange(len(off)))
    a = np.maximum(hot - MARGIN, low[row[hot]])
    b = np.minimum(hot + MARGIN + 1, low[row[hot] + 1])
    new = np.ones(len(a), bool)  # stretches that touch become one
    new[1:] = (a[1:] > b[:-1]) | (row[hot][1:] != row[hot][:-1])
    begin, end = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
    out = []
    size = end - begin
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):  # sequences of like length together, about 200,000 places at a time
        t = int(size[order[at]])
        stop = at + 1
        while stop < len(order) and size[order[stop]] <= max(16, 1.3 * t) and (stop - at + 1) * size[order[stop]] <= 200_000:
            stop += 1
        part = order[at:stop]
        at = stop
        t = int(size[part].max())
        spot = begin[part][:, None] + np.arange(t)
        mask = np.arange(t) < size[part][:, None]
        spot = np.minimum(spot, len(s) - 1)
        labels = field.decode(features(np.where(mask, shape[spot], 0), np.where(mask, gap[spot], 0)), mask)
        labels[~mask] = 0
        for i in np.flatnonzero(labels.any(1)):
            k = 0
            while k < t:
                if labels[i, k] and LABELS[labels[i, k]][0] == "B":
                    z = k + 1
                    while z < t and labels[i, z] == labels[i, k] + 1:
                        z += 1
                    out.append((int(row[spot[i, k]]), int(s[spot[i, k]]), int(e[spot[i, z - 1]]), LABELS[labels[i, k]][2:]))
                    k = z
                else:
                    k += 1
    return out


_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if d > "4" else 2 * int(d)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans by the patterns, by kind and start.  From an at sign the local part is read backwards: linear on any text."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() < 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def sound(kind: str, text: str) -> bool:
    """What a span of the field must hold to be added."""
    digits = sum("0" <= c <= "9" for c in text)
    if kind == "phone":
        return 7 <= digits <= 15
    if kind == "secret":
        return len(text) >= 20 and 4 <= digits < len(text)
    if kind == "card":
        return 16 <= digits <= 19 and luhn("".join(c for c in text if "0" <= c <= "9"))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return "." in text and re.search(r"@|\b[aA][tT]\b", text) is not None


SCHEMA = "doc_id long, base array<struct<kind:string,start:long,end:long>>, added array<struct<kind:string,start:long,end:long>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _whole(text: str, a: int, b: int) -> tuple[int, int]:
    while a and text[a - 1].isalnum():
        a -= 1
    while b < len(text) and text[b].isalnum():
        b += 1
    return a, b


def _apart(added: list, base: list) -> list:
    """The added spans that touch none of the base: by start, and the furthest end of all that start before."""
    base = sorted((s, e) for _, s, e in base)
    starts, far, most = [s for s, _ in base], [], -1
    for _, e in base:
        most = max(most, e)
        far.append(most)
    return [x for x in added if (k := bisect_left(starts, x[2])) == 0 or far[k - 1] <= x[1]]


def find(text_column: pa.Array, field: Field) -> tuple[list[list], list[list]]:
    """For each row the base spans and the field's own, as (kind, start, end) in code points."""
    data, off = byte_view(text_column)
    n = len(off) - 1
    base: list[list] = [[] for _ in range(n)]
    added: list[list] = [[] for _ in range(n)]
    marks = np.flatnonzero((data >= 48) & (data < 58) | (data == 64))
    texts: dict[int, str] = {}
    for i in np.unique(np.searchsorted(off, marks, side="right") - 1).tolist():
        texts[i] = text_column[i].as_py()
        base[i] = base_spans(texts[i])
    chars: dict[int, np.ndarray] = {}
    for i, s, e, kind in field_spans(field, data, off):
        if i not in texts:
            texts[i] = text_column[i].as_py()
        if i not in chars:
            chars[i] = np.concatenate([[0], np.cumsum((data[off[i] : off[i + 1]] & 0xC0) != 0x80)])
        a, b = int(chars[i][s - off[i]]), int(chars[i][e - off[i]])
        if kind == "secret":  # whole words
            a, b = _whole(texts[i], a, b)
            if added[i] and added[i][-1] == (kind, a, b):
                continue
        if sound(kind, texts[i][a:b]):
            added[i].append((kind, a, b))
    for i in range(n):
        if added[i] and base[i]:
            added[i] = _apart(added[i], base[i])
        added[i].sort(key=lambda x: (EVERY.index(x[0]), x[1]))
    return base, added


def spans(df: DataFrame, field: Field | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and added: all spans of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(field or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                both = find(part.column("text"), shared.value)
                cols = [pa.array([[dict(zip(("kind", "start", "end"), x)) for x in row] for row in rows], _SPAN) for rows in both]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], ["doc_id", "base", "added"])

    return pick(df, doc_id=doc_id, text=text).mapInArrow(run, SCHEMA)


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; spans that overlap are replaced together."""
    out, last = [], 0
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        if s >= last:
            out += [text[last:s], f"<{kind}>"]
        last = max(last, e)
    return "".join(out) + text[last:]


def mask(df: DataFrame, field: Field | None = None, text: str = "text") -> DataFrame:
    """The same rows and columns with personal data masked in `text`."""
    shared = df.sparkSession.sparkContext.broadcast(field or train())
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                base, added = find(part.column(text), shared.value)
                if any(base) or any(added):
                    own = part.column(text).to_pylist()
                    for i in range(part.num_rows):
                        if base[i] or added[i]:
                            own[i] = masked(own[i], base[i] + added[i])
                    part = pa.RecordBatch.from_arrays([pa.array(own, pa.string()) if k == place else c for k, c in enumerate(part.columns)], part.schema.names)
                yield part

    return df.mapInArrow(run, df.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of base spans, and all spans, from the rows of `spans`."""
    written = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    place = F.array(*[F.lit(k) for k in EVERY])
    ranked = F.transform(F.concat("base", "added"), lambda x: F.struct(F.array_position(place, x["kind"]).alias("nth"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return found.select(
        "doc_id",
        *[F.size(F.filter("base", _is(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(ranked)).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        F.size(F.concat("base", "added")).cast("long").alias("n_spans"),
    )


def _is(kind: str):
    return lambda x: x["kind"] == kind


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spans(table(spark, sf_dir, "documents")))
