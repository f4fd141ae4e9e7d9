"""Whitening, token counts and the fill-in-the-middle transformation against plain Python."""

import hashlib
import random
import re
from decimal import Decimal

import numpy as np
import pytest
from public_tokenizers import path
from sentencepiece import SentencePieceProcessor

from pageforge.llm import fillmiddle, tokencounts, whitening

PIECES = path("piece_bpe_32k.model")
RNG = random.Random(11)
LETTERS = "ab  \t\n\r\x0b\x0c ▁　éß日本🙂<P>S;1 2"
TEXTS = [
    None, "", " ", "   ", "\n", "\n\n a", "a\n b", "one two  three", "  lead and trail  ", "a▁b ▁ c", "<s> </s> <unk> <0x0A>", "tab\tand\r\n;\r\n", "12345 3.14", "日本語のテキスト 🙂🙂", "a\x00b",
    "x" * 30_000, "word " * 20_000, " " * 9_000, "one two  three",
] + ["".join(RNG.choices(LETTERS, k=RNG.randint(1, 60))) for _ in range(200)]


def docs(spark, texts, ids=None):
    """Columns that clash with the operators' own names."""
    rows = [(i if ids is None else ids[i], t, 7, "k", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, row long, word string, n long")


# -- token counts


def test_counts_equal_the_library(spark):
    own = SentencePieceProcessor(model_file=PIECES)
    want = [(i, len((t or "").encode()), n := len(own.encode(t or "")), n > 50) for i, t in enumerate(TEXTS)]
    for common in (tokencounts.COMMON, 1):  # all joined in place, and all by the shuffle
        got = sorted(map(tuple, tokencounts.count(docs(spark, TEXTS), PIECES, limit=50, common=common).collect()))
        assert got == want


def test_counts_of_rows_with_equal_and_without_ids(spark):
    texts = ["some words here", "some words here", None, "other"]
    got = sorted((str(r["doc_id"]), r["n_bytes"]) for r in tokencounts.count(docs(spark, texts, ids=[3, 3, None, None]), PIECES, common=8).collect())
    assert got == [("3", 15), ("3", 15), ("None", 0), ("None", 5)]
    assert tokencounts.count(docs(spark, ["x"]).where("false"), PIECES).count() == 0


def test_vocabulary_counts_each_pretoken_once(spark):
    words = {r["word"]: (r["times"], r["pieces"]) for r in tokencounts.vocabulary(docs(spark, ["a b a", "b\nb", None, ""] * 50), PIECES).collect()}
    own = SentencePieceProcessor(model_file=PIECES)
    assert tokencounts.pretokens("a1b, é.x\r\n ()") == {" a": 1, "1": 1, "b": 1, ",": 1, " é.": 1, "x": 1, "\r": 1, "\n": 1, " ()": 1}
    assert words == {" a": (100, len(own.encode("a"))), " b": (100, len(own.encode("b"))), "\n": (50, 1), "b": (50, 1)}


def test_held_words_are_passed_on(spark, monkeypatch):
    monkeypatch.setattr(tokencounts, "HELD", 3)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a b c d e", "a b", None])], ["text"])
    total = {}
    for out in tokencounts._occurring(iter([batch])):
        for w, n in zip(out.column("word").to_pylist(), out.column("times").to_pylist()):
            total[w] = total.get(w, 0) + n
    assert total == {" a": 2, " b": 2, " c": 1, " d": 1, " e": 1}


# -- fill in the middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_cut(text, doc_id):
    text = text or ""
    h = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < 80
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_transformation_equals_a_plain_one_and_comes_back(spark):
    done = fillmiddle.transform(docs(spark, TEXTS))
    got = {r["doc_id"]: tuple(r)[1:] for r in done.collect()}
    assert got == {i: plain_cut(t, i) for i, t in enumerate(TEXTS)}
    assert {g[1] for g in got.values()} == {"plain", "spm", "psm"}
    assert {r["doc_id"]: r["text"] for r in fillmiddle.restore(done).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert fillmiddle.transform(docs(spark, ["x"]).where("false")).count() == 0
    assert fillmiddle.transform(docs(spark, ["a b"] * 3, ids=[None, 4, 4])).count() == 3


def test_every_text_cut():
    every = fillmiddle.Rates(cut=100)
    for i, t in enumerate(TEXTS):
        c = fillmiddle.transformed(t or "", i, every)
        assert fillmiddle.restored(c.output, c.form).decode() == (t or "")
        assert c.form == "plain" or len(c.output.decode()) == len(t) + 9


def test_places_of_bits():
    rng = random.Random(3)
    for width in (1, 2, 3, 63, 64, 65, 1000):
        bits = rng.getrandbits(width) | 1
        want = [k for k in range(width) if bits >> k & 1]
        assert [fillmiddle.place(bits, k + 1, width) for k in range(bits.bit_count())] == want


# -- whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 5) for i, v in rows], "vec_id long, embedding array<float>, x string, component long")


def expected(x, most=16):
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    cov = c.T @ c / n
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1][:most], axes[:, ::-1][:, :most]
    return n, ((n * x - s) ** 2).sum(1), (n * x - s) / n @ axes / np.sqrt(e), e / np.trace(cov)


def test_whitening_equals_a_plain_one(spark):
    rng = np.random.default_rng(4)
    mixed = rng.standard_normal((300, 20)) @ rng.standard_normal((20, 20))
    mixed[::3] = mixed[0]  # a third of all rows are one vector
    few = rng.standard_normal((40, 3))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(mixed)] + [(1000 + i, v.astype(np.float32).tolist()) for i, v in enumerate(few)]
    odd = [(2000, None), (2001, [None] * 20), (2002, [float("nan")] * 3), (2003, [float("inf")] * 3), (2004, []), (2005, [3e38] * 3)]
    table = vectors(spark, rows + odd).repartition(7)
    models = whitening.fit(table)
    got = {}
    for r in whitening.whiten(table, models).collect():
        got.setdefault(r["vec_id"], []).append(r)
    assert sorted(got) == sorted(i for i, _ in rows)
    for first, m in ((0, mixed), (1000, few)):
        x = np.floor(64 * m.astype(np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
        n, deviation, whitened, explained = expected(x)
        for i in range(len(m)):
            own = sorted(got[first + i], key=lambda r: r["component"])
            assert [r["component"] for r in own] == list(range(1, min(16, m.shape[1]) + 1))
            assert {(r["n"], r["deviation"]) for r in own} == {(n, Decimal(int(deviation[i])))}
            assert np.allclose(np.abs([r["whitened"] for r in own]), np.abs(whitened[i]), rtol=0, atol=1e-9)
            assert np.allclose([r["explained"] for r in own], explained, rtol=1e-9) and max(r["identity_error"] for r in own) < 1e-9
        for k in range(min(16, m.shape[1])):  # one sign for all rows
            sign = np.sign([got[first + i][0]["whitened"] * whitened[i, got[first + i][0]["component"] - 1] for i in range(len(m))])
            assert k or abs(sign.sum()) == len(m)


def test_moments_merge_exactly():
    rng = np.random.default_rng(2)
    x = rng.integers(-200, 200, (90, 5)) + 10**12
    parts = [whitening.Moments.of(x[a:b]) for a, b in ((0, 1), (1, 40), (40, 90))]
    m = parts[0].merged(parts[1].merged(parts[2]))
    c = x - x.sum(0) / 90
    assert m.n == 90 and m.sums.tolist() == x.sum(0).tolist() and np.allclose(m.scatter, c.T @ c, rtol=1e-6)
    y = x - 10**12
    c = y - y.mean(0)
    assert np.allclose(m.scatter, c.T @ c, rtol=1e-12)


def test_large_components_stay_exact():
    x = np.array([[2**60, 5], [-(2**60), 9], [3, 2**59]], np.int64)
    model = whitening.Model.of(whitening.Moments.of(x))
    s = [sum(int(v) for v in x[:, k]) for k in (0, 1)]
    assert model.sums == s and model.deviation(x) == [sum((3 * int(v) - s[k]) ** 2 for k, v in enumerate(row)) for row in x]


@pytest.mark.parametrize("rows,live", [([], 0), ([(1, [1.0, 2.0])], 0), ([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 4.0])], 1)])
def test_vectors_without_variance(spark, rows, live):
    table = vectors(spark, rows)
    models = whitening.fit(table)
    out = whitening.whiten(table, models).collect()
    assert len(out) == 2 * len(rows) and sum(r["whitened"] is not None for r in out) == live * len(rows)
    assert all((r["identity_error"] is None) == (live == 0) for r in out)
