"""Operators over whole tables, against brute force and exact round trips."""

import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from pageforge.llm import chunkstore, collisions, ngramjoin, nndescent, packing
from pageforge.llm.common import shared_dir
from pyspark.sql import functions as F

VOCABULARY = path("word_bpe_49k.json")
TEXTS = [None, "", "one two", "one two", "The same passage, over and over. " * 300, "The same passage, over and over. " * 300 + "End", "x " * 9000, "Ω mega"]


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, 5, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, sig long, node string")


def encoded(texts, end):
    return [e.ids + [end] for e in Tokenizer.from_file(VOCABULARY).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_store_round_trip(spark):
    where = shared_dir(spark)
    chunkstore.write(docs(spark, TEXTS), VOCABULARY, where)
    want, start = encoded(TEXTS, 2), 0
    got = sorted(chunkstore.read(spark, where).collect(), key=lambda r: r["doc_id"])
    for r, ids in zip(got, want):
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["verified"]) == (start, len(ids), crc(ids), True)
        start += len(ids)
    assert {r["doc_id"]: r["ids"] for r in chunkstore.restore(spark, where).collect()} == dict(enumerate(want))
    stored = chunkstore._kind(spark, where, "c").agg(F.sum("n")).first()[0]
    assert stored < 0.6 * start  # chunks that texts share are stored once


def test_store_keeps_rows_with_one_id(spark):
    where = chunkstore.write(docs(spark, ["a b", "a b", "c", None], ids=[7, 7, 7, 1]), VOCABULARY, shared_dir(spark))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in chunkstore.read(spark, where).collect())
    assert [g[1] for g in got] == [1, 7, 7, 7] and got[-1][0] + got[-1][2] == 1 + 3 + 3 + 2


def test_ids_that_do_not_fit_are_an_error():
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words of a text"])], ["doc_id", "text"])
    with pytest.raises(ValueError, match="does not fit"):
        list(chunkstore._rows(iter([batch]), VOCABULARY, 2, 1))


def check_packing(rows, want, capacity):
    places = {}
    for r in rows:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and crc(ids) == r["ids_crc32"] and r["start"] == capacity * r["piece"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spots in places.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= capacity
    assert sum(r["length"] for r in rows) == sum(map(len, want))
    return len(places)


def test_packing(spark):
    rng = random.Random(1)
    texts = TEXTS + ["word " * min(900, int(rng.lognormvariate(4, 1.2)) + 1) for _ in range(150)]
    want = encoded(texts, 1)
    rows = packing.pack(packing.pieces(docs(spark, texts), VOCABULARY, capacity=512), 512).collect()
    assert check_packing(rows, want, 512) <= -(-sum(map(len, want)) // 512) + 2


def test_configurations_take_everything_once():
    rng = random.Random(2)
    for _ in range(30):
        histogram = Counter(min(64, int(rng.expovariate(0.06)) + 1) for _ in range(rng.randint(0, 400)))
        plan = packing.configurations(dict(histogram), 64)
        taken = Counter()
        for filling, times in plan:
            assert sum(n * k for n, k in filling.items()) <= 64 and times > 0
            for n, k in filling.items():
                taken[n] += k * times
        assert taken == histogram


def test_configurations_are_near_the_optimum_and_the_bound_holds():
    def least(items, capacity):
        """Fewest sequences of a few pieces: by all ways to put each piece, largest first."""
        best, rooms = [len(items)], []

        def go(k):
            if len(rooms) >= best[0]:
                return
            if k == len(items):
                best[0] = len(rooms)
                return
            for i in range(len(rooms)):
                if rooms[i] >= items[k] and rooms[i] not in rooms[:i]:
                    rooms[i] -= items[k]
                    go(k + 1)
                    rooms[i] += items[k]
            rooms.append(capacity - items[k])
            go(k + 1)
            rooms.pop()

        go(0)
        return best[0]

    rng = random.Random(8)
    for _ in range(60):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        facts: dict = {}
        made = sum(times for _, times in packing.configurations(dict(Counter(items)), 20, facts=facts))
        best = least(items, 20)
        full = sum(n == 20 for n in items)
        assert best <= made <= best + 1 and facts["bound"] <= best - full + 1e-9
    histogram = Counter(min(4095, int(rng.lognormvariate(6, 1.3)) + 1) for _ in range(20000))
    facts = {}
    made = sum(times for _, times in packing.configurations(dict(histogram), facts=facts))
    assert facts["bound"] <= facts["fractional"] <= 1.01 * facts["bound"] and made <= facts["bound"] + 5 and facts["rounded"] > 0.5 * made
    best = packing.knapsack(np.array([0, 0, 3.0, 0, 5.0, 0, 0, 0]))
    assert best.tolist() == [0, 0, 3, 3, 6, 6, 9, 9]


@pytest.mark.parametrize(
    "histogram,most",
    [
        ({1366: 900, 2731: 300, 700: 500}, 750),  # two of 1366 with one of 700: fuller sequences would be more
        ({2100: 10, 500: 1}, 10),
        (dict(Counter(random.Random(1).randint(1500, 2500) for _ in range(4000))), 2000),
    ],
)
def test_the_program_is_solved_where_volume_does_not_bind(monkeypatch, histogram, most):
    facts: dict = {}
    made = sum(times for _, times in packing.configurations(dict(histogram), facts=facts))
    volume = sum(n * k for n, k in histogram.items()) / packing.CAPACITY
    assert volume < facts["bound"] - 1 and facts["bound"] <= facts["fractional"] <= made + 1e-6 and made <= most
    assert facts["fractional"] <= 1.01 * facts["bound"]
    covered = Counter()
    for filling, x in packing.solve(histogram, packing.CAPACITY)[0].items():
        assert sum(filling) <= packing.CAPACITY
        for n in filling:
            covered[n] += x
    assert all(abs(covered[n] - k) < 1e-6 for n, k in histogram.items())
    if most == 750:  # what completes fillings alone does not find it
        monkeypatch.setattr(packing, "solve", lambda *_: ({}, 0.0))
        assert sum(times for _, times in packing.configurations(dict(histogram))) > 780


def brute_groups(rows):
    sets = []
    for _, text in rows:
        words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return {(i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)}


@pytest.mark.parametrize("large", [64, 5])
def test_ngram_join(spark, monkeypatch, large):
    monkeypatch.setattr(ngramjoin, "FREQUENT", 3)
    monkeypatch.setattr(ngramjoin, "OVER_MEAN", 0)
    monkeypatch.setattr(ngramjoin, "LARGE", large)
    monkeypatch.setattr(ngramjoin, "ROWS", 16)
    rng = random.Random(large)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choices(words, k=n) for n in (3, 6, 8, 12, 20, 40, 80, 120) for _ in range(4)]
    passage = " ".join(rng.choices(words, k=30))
    texts = [None, "", " \t", "A b", "a B", "a b c d e"]
    for _ in range(250):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
        texts.append(" ".join(rng.choices(words, k=rng.randint(0, 9))) + " " + passage)
    rows = list(enumerate(texts))
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngramjoin.groups(docs(spark, texts)).collect()}
    assert got == brute_groups(rows)


def test_ngram_join_of_sets_one_rare_token_short(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "FREQUENT", 3)
    monkeypatch.setattr(ngramjoin, "OVER_MEAN", 0)
    words = iter(range(1000))
    some = lambda n: " ".join(f"w{next(words)}" for _ in range(n))
    # 119 and 120 shingles: 96 frequent ones and 11 rare ones in common, each with spare(n) rare ones in all.
    passage, tail = some(100), some(11)
    texts = [f"{passage} {tail} {some(12)}", f"{passage} {tail} {some(13)}", f"{passage} {some(200)}", f"{passage} {some(200)}"]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngramjoin.groups(docs(spark, texts)).collect()}
    assert got == brute_groups(list(enumerate(texts))) and (1, 120, 0) in got


def test_ngram_join_frees_disk(spark, monkeypatch, tmp_path):
    """Nothing shuffled and no signature stays on disk once it is used; blocks of a crowd meet by turns, all of them."""
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in store.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    monkeypatch.setattr(ngramjoin, "FREQUENT", 3)
    monkeypatch.setattr(ngramjoin, "OVER_MEAN", 0)
    monkeypatch.setattr(ngramjoin, "LARGE", 5)
    monkeypatch.setattr(ngramjoin, "ROWS", 8)
    monkeypatch.setattr(ngramjoin, "AT_ONCE", 1)
    passage = " ".join(f"p{i}" for i in range(60))
    rng = random.Random(3)
    texts = [f"{passage} {' '.join(rng.choices(['x', 'y', 'z', 'u', 'v'], k=rng.randint(5, 40)))}" for _ in range(150)]
    where, before, left = f"file://{tmp_path}/shared", shuffled(), set()
    turns, write = [], ngramjoin.cut

    def cut(df, to, name):
        turns.extend([name] * name.startswith("crowd-links"))
        return write(df, to, name)

    monkeypatch.setattr(ngramjoin, "cut", cut)
    out = ngramjoin.groups(docs(spark, texts), where=where)
    for _ in range(100):  # they are removed in the background
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left and not (tmp_path / "shared/facts").exists() and len(turns) > 1
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()} == brute_groups(list(enumerate(texts)))


def test_rare_tokens_stay_rare_in_large_tables():
    """A token that passes for rare has few holders whatever the input: 64 would make a crowd of them."""
    cells = ngramjoin.CELLS
    rng = np.random.default_rng(5)
    for tokens in (10**8, 1_400_000_000, 2_000_000_000):
        others = rng.poisson(tokens / cells, 100_000)
        least = ngramjoin.least_of(tokens)
        assert (others + ngramjoin.LARGE >= least).mean() > 0.98 and (others >= least).mean() < 0.02


def test_counts_of_cells_are_packed():
    for most in (2, 255, 65535):
        counts = np.random.default_rng(most).integers(0, most + 1, ngramjoin.BLOCK).astype(np.uint16)
        assert (ngramjoin._unpacked(ngramjoin._packed(counts)) == counts).all()


def test_ngram_join_of_rows_without_ids(spark):
    some = " ".join(f"w{k}" for k in range(40))
    texts = [some, some + " end", some + " more", "other words"]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (8, texts[3])]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngramjoin.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("7", 37, "7"), ("8", 1, "8"), ("None", 36, "7"), ("None", 37, "7")]


def test_one_of_each(spark):
    same = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    table = docs(spark, [same, same, same + " end", "other words", None, None, same], ids=[3, 5, 9, 4, 6, None, 3])
    assert sorted((str(r["doc_id"]), r["sig"]) for r in ngramjoin.one_of_each(table).collect()) == [("3", 5), ("4", 5), ("6", 5), ("None", 5)]


def test_one_of_each_tells_rows_with_one_id_apart(spark):
    some = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcd"]
    texts = [some[0], some[1], some[1] + " end", some[2], some[0], some[3], some[3], "", "", some[2]]
    table = docs(spark, texts, ids=[3, 3, 3, 3, 1, 5, 5, 7, 7, 2])
    out = sorted((r["doc_id"], r["text"]) for r in ngramjoin.one_of_each(table).collect())
    assert [i for i, _ in out] == [1, 2, 3, 5, 7]
    assert dict(out)[1] == some[0] and dict(out)[3] in texts[1:3] and dict(out)[5] == some[3]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, dim string, v long")


def test_near_duplicate_vectors(spark):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((40, 24))
    rows, x = [], []
    for i in range(400):
        c = int(rng.integers(0, 40)) if i % 3 else 0  # a third of all rows are copies of one vector
        x.append((centers[c] + rng.standard_normal(24) * rng.choice([0, 0.1, 0.3])).astype(np.float32))
        rows.append((i, x[-1].tolist(), c % 3, "z", 0))
    bad = [(900, None, 1, "z", 0), (901, [0.0] * 24, 1, "z", 0), (902, [float("nan")] + [1.0] * 23, 1, "z", 0), (903, [None] + [1.0] * 23, 1, "z", 0), (904, x[0].tolist(), None, "z", 0), (905, [1.0, 2.0], 1, "z", 0), (None, x[0].tolist(), 0, "z", 0)]
    out = {r["vec_id"]: r for r in nndescent.near_duplicates(vectors(spark, rows + bad)).collect()}
    m = np.array(x, np.float64)
    m /= np.sqrt((m**2).sum(1))[:, None]
    label = np.array([r[2] for r in rows])
    near = (m @ m.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    found = np.array([out[i]["n_links"] for i in range(400)])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.9 * near.sum()
    for b in bad:
        assert out[b[0]]["n_links"] == 0 and out[b[0]]["component_id"] == b[0] and out[b[0]]["kept"]


def test_tight_groups_that_link(spark):
    rng = np.random.default_rng(9)
    base = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    turn = np.arccos(0.95)
    # Two groups of 40 with 0.95 across and a third with 0.8: every list of 16 is full of the own group.
    centers = [base[0], np.cos(turn) * base[0] + np.sin(turn) * base[1], 0.8 * base[0] + 0.6 * base[2]]
    x = np.array([c + 0.002 * rng.standard_normal(24) for c in centers for _ in range(40)], np.float32)
    out = {r["vec_id"]: r for r in nndescent.near_duplicates(vectors(spark, [(i, x[i].tolist(), 0, "z", 0) for i in range(120)])).collect()}
    m = x / np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None]
    near = m @ m.T >= 0.93
    np.fill_diagonal(near, False)
    assert near[:40, 40:80].all() and not near[:80, 80:].any()
    assert [out[i]["n_links"] for i in range(120)] == near.sum(1).tolist()
    assert [out[i]["component_id"] for i in range(120)] == [0] * 80 + [80] * 40


@pytest.mark.parametrize("most,least", [(50_000, 5_000), (300, 400)])
def test_nearest_neighbours(spark, monkeypatch, most, least):
    monkeypatch.setattr(collisions, "MOST", most)
    monkeypatch.setattr(collisions, "LEAST", least)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 32)).astype(np.float32)
    x[7] = x[8]
    rows = [(i, x[i].tolist(), 0, "z", 0) for i in range(3000)] + [(5000, None, 0, "z", 0), (5100, [0.0] * 32, 0, "z", 0), (5200, [1.0], 0, "z", 0)]
    out = collisions.search(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect()
    got = {}
    for r in out:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 3000, 100))
    assert collisions.recall(vectors(spark, rows), spark.createDataFrame(out), [0, 100, 200]) >= 0.9
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        true = np.lexsort((np.arange(3000), d))[:10]
        hits += len({v for _, v, _ in found} & set(true.tolist()))
        assert [k for k, _, _ in sorted(found)] == list(range(1, 11))
        assert all(abs(s - d[v]) < 1e-9 for _, v, s in found)
    assert hits >= 0.9 * 10 * len(got)


def test_neighbours_of_one_hot_vector_and_of_few(spark, monkeypatch):
    monkeypatch.setattr(collisions, "MOST", 40)
    monkeypatch.setattr(collisions, "LEAST", 50)
    rng = np.random.default_rng(16)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[::3] = x[0]  # a third of all rows are one vector
    rows = [(i, x[i].tolist(), 0, "z", 0) for i in range(300)] + [(400, [1.0, 2.0], 0, "z", 0), (401, [1.0, 3.0], 0, "z", 0), (500, [1.0] * 5, 0, "z", 0)]
    got = {}
    for r in collisions.search(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got[400]) == [(1, 401, 1.0)] and 500 not in got
    assert [v for _, v, _ in sorted(got[0])] == list(range(3, 31, 3)) and {s for _, _, s in got[0]} == {0.0}
    d = np.sqrt(((x.astype(float) - x[100].astype(float)) ** 2).sum(1))
    d[100] = np.inf
    assert len({v for _, v, _ in got[100]} & set(np.lexsort((np.arange(300), d))[:10].tolist())) >= 8


def test_empty_tables(spark):
    none, empty = docs(spark, ["x"]).where("false"), vectors(spark, [(1, [1.0], 1, "z", 0)]).where("false")
    assert ngramjoin.groups(none).count() == 0
    assert packing.pack(packing.pieces(none, VOCABULARY)).count() == 0
    assert chunkstore.read(spark, chunkstore.write(none, VOCABULARY, shared_dir(spark))).count() == 0
    assert collisions.search(empty, F.col("vec_id") % 100 == 0).count() == 0
    assert nndescent.near_duplicates(empty).count() == 0
