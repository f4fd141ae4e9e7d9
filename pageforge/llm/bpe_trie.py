"""BPE encoding and decoding by prefix-sharing trie traversal (operator 10).

Distinct words form a trie.  A depth-first walk keeps, for each node, the last token of the encoding of the path to
it; the encoding of a path is that of the path without its last token, and then that token, so each shared prefix is
worked out once.  The last token of a path is the one suffix token that is compatible with the last token before it:
no merge crosses the border between the two.

Nulls and empty texts have no tokens: n_tokens 0, the digests of nothing.  Repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pageforge.llm.common import pick, slices, table
from pageforge.llm.wordcodes import WordCodes

END = "</w>"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class TrieBpe:
    """Encodes sets of distinct pre-tokens; `ids` are those of the vocabulary file."""

    def __init__(self, model: dict) -> None:
        self.vocab: dict[str, int] = model["vocab"]
        self.names = byte_names()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {}
        made = {}
        for r, (a, b) in enumerate(merges):
            self.rank[self.vocab[a], self.vocab[b]] = r
            made[self.vocab[a + b]] = (r, self.vocab[a], self.vocab[b])
        self.longest = max(len(t.removesuffix(END)) for t in self.vocab)
        self.right, self.left = {}, {}
        for side, part in ((self.right, 2), (self.left, 1)):
            for t in self.vocab.values():
                chain, at = [], t
                until = float("inf")  # the rank at which this part goes into a larger one
                while True:
                    chain.append((at, until))
                    if at not in made:
                        break
                    until, at = made[at][0], made[at][part]
                side[t] = tuple(reversed(chain))
        self.pairs: dict[int, bool] = {}  # by first id * size of the vocabulary + second id
        self.size = max(self.vocab.values()) + 1

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b, side by side, stay as they are: of the parts that meet at the border at any time, none merge."""
        known = self.pairs.get(a * self.size + b)
        if known is not None:
            return known
        x, y, i, j, good = self.right[a], self.left[b], 0, 0, True
        while True:
            (p, p_until), (q, q_until) = x[i], y[j]
            r = self.rank.get((p, q))
            if r is not None and r < p_until and r <= q_until:
                good = False
                break
            if p_until <= q_until:
                i += 1
            else:
                j += 1
            if i == len(x) or j == len(y):
                break
        if len(self.pairs) > 500_000:  # about 50 MB
            self.pairs.clear()
        self.pairs[a * self.size + b] = good
        return good

    def __call__(self, words: list[str]) -> list[list[int]]:
        """Each word's ids.  Sorted words are the trie in depth-first order: what a word shares with the one before is kept."""
        out: list[list[int]] = [[] for _ in words]
        names, vocab, longest, ok = self.names, self.vocab, self.longest, self.compatible
        spelled = ["".join([names[b] for b in w.encode()]) for w in words]
        last: list[int] = [-1]  # the last token of the prefix of each length
        size: list[int] = [0]
        before = ""
        for k in sorted(range(len(words)), key=spelled.__getitem__):
            w = spelled[k]
            n = len(w)
            shared = 0
            for x, y in zip(before, w):
                if x != y:
                    break
                shared += 1
            shared = min(shared, len(last) - 1)
            del last[shared + 1 :], size[shared + 1 :]
            for end in range(shared + 1, n):
                for start in range(max(0, end - longest), end):
                    t = vocab.get(w[start:end])
                    if t is not None and (start == 0 or ok(last[start], t)):
                        last.append(t)
                        size.append(end - start)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            row = out[k]
            if n:
                for start in range(max(0, n - longest), n):
                    t = vocab.get(w[start:] + END)
                    if t is not None and (start == 0 or ok(last[start], t)):
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                row.append(t)
                at = start
                while at:
                    row.append(last[at])
                    at -= size[at]
                row.reverse()
            before = w
        return out


_held: dict = {}


def trie_codes(path: str) -> tuple[WordCodes, list[bytes]]:
    """The encoder of a vocabulary file and its tokens' spellings by id; one per worker."""
    if path not in _held:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        file = json.load(open(path, encoding="utf-8"))
        own, trie = Tokenizer.from_file(path), TrieBpe(file["model"])
        own.no_truncation()
        own.no_padding()
        special = {x["content"]: x["id"] for x in file["added_tokens"]}

        def odd(texts: list[str]) -> list[list[int]]:
            """The library's normalizer and pre-tokenizer cut unusual texts; the words still go through the trie."""
            back = {c: b for b, c in enumerate(trie.names)}
            rows, words = [], {}
            for text in texts:
                row, rest = [], text
                while rest:
                    hits = [(rest.find(s), s) for s in special if s in rest]
                    at, mark = min(hits) if hits else (len(rest), "")
                    norm = own.normalizer.normalize_str(rest[:at])
                    for w, _ in own.pre_tokenizer.pre_tokenize_str(norm):
                        row.append(words.setdefault(bytes(back[c] for c in w).decode(errors="strict"), len(words)))
                    row += [(special[mark],)] if mark else []
                    rest = rest[at + len(mark) :]
                rows.append(row)
            coded = trie(list(words))
            return [[i for x in row for i in (x if isinstance(x, tuple) else coded[x])] for row in rows]

        names = {i: t for t, i in trie.vocab.items()} | {i: t for t, i in special.items()}
        spelled = [names.get(i, "").encode() for i in range(max(names) + 1)]
        _held[path] = WordCodes(trie, odd), spelled
    return _held[path]


def encode_rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids): the ids themselves, for use outside the digest query."""
    codes, _ = trie_codes(path)
    for batch in batches:
        for part in slices(batch, "text"):
            ids, off = codes(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])


def _joined(spelled: list[bytes], ids: np.ndarray) -> bytes:
    return b" ".join([spelled[i] for i in ids.tolist()])


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    codes, spelled = trie_codes(path)
    for batch in batches:
        for part in slices(batch, "text"):
            ids, off = codes(part.column("text"))
            ids = ids.astype("<u4")
            spans = list(zip(off[:-1].tolist(), off[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(off)),
                    pa.array([hashlib.sha256(ids[a:b].data).hexdigest() for a, b in spans]),
                    pa.array([hashlib.sha256(_joined(spelled, ids[a:b])).hexdigest() for a, b in spans]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def encode(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every row's whole text."""
    return pick(df, doc_id=doc_id, text=text).mapInArrow(partial(encode_rows, path=path), "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text: the tokens' spellings with a space between, as a vocabulary without a decoder reads."""

    def run(batches):
        _, spelled = trie_codes(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([_joined(spelled, np.asarray(x or [], np.int64)).decode() for x in b.column("ids").to_pylist()])], ["doc_id", "text"])

    return pick(df, doc_id=doc_id, ids=ids).mapInArrow(run, "doc_id long, text string")


def digests(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return pick(df, doc_id=doc_id, text=text).mapInArrow(partial(_digests, path=path), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return digests(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))
