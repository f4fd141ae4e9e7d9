"""Exact Jaccard join on word shingles with token-combination prefixes (operator 5).

Two sets with 100 * intersection >= 80 * union differ in few tokens, so they share something within short prefixes of
a common order.  Tokens are ordered by frequency grade, then hash.  A rare token is a signature by itself; frequent
tokens are in small groups by hash, and a signature is a pair of one group.  A prefix is extended until losing as many
tokens as similar sets may differ in leaves a signature: a rare token counts one, a group of k frequent tokens k - 1.

Grades come from counts of all tokens of all documents in an array of cells of fixed size, so they can be broadcast
whatever the input; tokens that share a cell share a grade, which changes cost, never results.

Two sets whose signatures are all single tokens and that share c of them overlap in at most c tokens and what lies
behind the prefix of one of them; pairs for which that is too little, or whose sizes are too far apart, are no
candidates.

Signatures give candidates in three steps.  First each holder is compared with the smallest and the largest holder of
the signature, then with a few others; links found make provisional components.  Then signatures whose holders are in
several components give the pairs across components, all of them: signatures with many holders in blocks, where each
two holders meet once whatever they share, the others by a join.  Pairs within a component need no comparison: one row per document with its component
is the result.  Documents with equal sets are one node from the start.

Nodes and shingles are 64-bit hashes: for n distinct sets the odds that any two sets share a node are about n**2 / 2**65.

Null texts and texts without words have the empty set and link with nothing; with fewer than five words the whole
sequence is the one shingle.  Repeated rows are documents of their own with equal sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageforge.llm.common import SpanHasher, byte_view, cut, drop, freeing, pick, shared_dir, shuffle_parts, signed, slices, splitmix, table
from pageforge.llm.components import components
from pageforge.llm.wordcodes import forget

WORDS = 5
#: A token is frequent when its cell has at least this many documents' tokens, and is over the mean of a cell by this many
#: times the mean's root, as what other tokens add to a cell strays by about that; grade g: 2**(g-1) times as many.
FREQUENT, OVER_MEAN, GRADES = 8, 3, 20
#: Holders with which, by turns of the signature, all others are compared in the second step.
CENTERS = 8
#: Holders from which on a signature is large; rows and tokens of a block in which the holders of large ones are compared.
LARGE, ROWS, TOKENS = 64, 256, 1 << 19
#: Tokens of such blocks, all their copies counted, that are shuffled at once, each block once at least; and tokens of the
#: sets whose signatures are counted at once, in so many turns at most.
AT_ONCE, TURNS = 1 << 27, 8
#: Cells of the grade array and bits of the candidate filters: fixed sizes for broadcasts.
CELLS, BLOCK, FILTER_BITS = 1 << 24, 1 << 14, 1 << 25
#: Bits of the filter of signatures: so many for each, up to a fixed size.  A full filter lets all signatures through to the shuffle.
BITS_EACH, MOST_BITS = 8, 1 << 27

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MIX = np.random.default_rng(7).integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_hash = SpanHasher()


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Each row's sorted distinct shingles as 64-bit hashes."""
    data, off = byte_view(texts)
    rows = len(off) - 1
    if not len(data):
        return [np.zeros(0, np.uint64)] * rows
    low = _LOWER[data]
    word = ~_SPACE[low]
    edge = np.ones(len(low) + 1, bool)
    edge[1:-1] = word[1:] != word[:-1]
    edge[off] = True
    starts = np.flatnonzero(edge[:-1] & word)
    ends = np.flatnonzero(edge[1:] & word) + 1
    h = _hash(low, starts, ends)
    first = np.searchsorted(starts, off)
    n = len(h)
    whole = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for j in range(WORDS):
        whole += h[j : n - WORDS + 1 + j] * _MIX[j] if n >= WORDS else 0
    whole = splitmix(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            own = np.sort(whole[a : b - WORDS + 1])
            keep = np.ones(len(own), bool)
            keep[1:] = own[1:] != own[:-1]
            out.append(own[keep])
        elif b > a:
            out.append(splitmix((h[a:b] * _MIX[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(tokens: np.ndarray) -> int:
    """The name of a set."""
    mixed = splitmix(tokens * np.uint64(0xA24BAED4963EE407) + np.uint64(0x9FB21C651E98DF25))
    parts = np.array([mixed.sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed) if len(mixed) else 0, len(mixed)], np.uint64)
    return int(signed(splitmix((splitmix(parts) * _MIX[:3]).sum(dtype=np.uint64, keepdims=True)))[0])


def spare(n: int) -> int:
    """Tokens of a set of n that a similar set may lack."""
    return n - -(-4 * n // 5)


def _cell(tokens: np.ndarray, cells: int) -> np.ndarray:
    return (splitmix(tokens + np.uint64(0x632BE59BD9B4E019)) & np.uint64(cells - 1)).astype(np.int64)


def band_of(n: int) -> int:
    """Sizes in bands that are a twentieth wide."""
    return int(np.log(n) / np.log(1.05) + 1e-9)


def band_least(band: int) -> int:
    """A size that no set of the band is below."""
    return int(np.exp(band * np.log(1.05)) - 1e-6)


def spare_for(n: int, other: int) -> int:
    """Tokens of a set of n that a similar set of at least `other` tokens may lack."""
    return n - -(-4 * (n + max(other, -(-4 * n // 5))) // 9)


def signatures(tokens: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, bool]:
    """The signatures of a set, and whether they are single tokens only, enough of them; sets of up to three tokens have none, as only equal sets are similar to them.

    Where rare tokens are too few, pairs of frequent tokens follow, apart for each band of sizes that a similar set may
    have: the nearer the sizes, the fewer tokens may differ.  Two sets use the same groups and bands for each other.
    """
    n = len(tokens)
    if n < 4:
        return np.zeros(0, np.uint64), False
    need = spare(n) + 1
    grade = grades[_cell(tokens, len(grades))]
    rare = tokens[grade == 0]
    if len(rare) >= need:
        return rare[:need], True
    often = tokens[np.argsort(grade, kind="stable")[len(rare) :]]
    out, own_band = [rare], band_of(n)
    for band in range(band_of(-(-4 * n // 5)), band_of(5 * n // 4) + 1):
        more = spare_for(n, band_least(band)) + 1 - len(rare)
        if more <= 0:
            continue
        low_band, high_band = min(band, own_band), max(band, own_band)
        bits = max(0, int(band_least(low_band)).bit_length() - 3)  # groups: a quarter of the smaller size at most
        group = often >> np.uint64(64 - bits) if bits else np.zeros(len(often), np.uint64)
        _, first = np.unique(group, return_index=True)
        gain = np.ones(len(often), np.int64)
        gain[first] = 0
        stop = int(np.searchsorted(np.cumsum(gain), more)) + 1
        own, part = often[:stop], group[:stop]
        rank = np.argsort(part, kind="stable")
        own, part = own[rank], part[rank]
        size = np.diff(np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))) if len(part) else np.zeros(0, np.int64)
        place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
        left = np.repeat(size, size) - place - 1  # partners that come later in the group
        a = np.repeat(np.arange(len(own)), left)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(left) - left, left)
        low, high = np.minimum(own[a], own[b]), np.maximum(own[a], own[b])
        key = np.array([low_band * 4096 + high_band + 1], np.uint64) * _MIX[2]
        out.append(splitmix(low * _MIX[0] + high * _MIX[1] + key))
    return np.concatenate(out), False


class Filter:
    """A set of 64-bit keys as bits of a fixed number; it may hold too much, never too little."""

    def __init__(self, keys: DataFrame, name: str, bits: int = FILTER_BITS) -> None:
        """From a column of longs, nulls aside.  The bits of 2**15 cells at a time are made in tasks and reach the driver packed."""
        span = min(bits, 1 << 15)

        def packed(batches):
            for b in batches:
                rows = b.column("cells")
                at, cells = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False).astype(np.int64)
                made = []
                for k in range(b.num_rows):
                    held = np.zeros(span, bool)
                    held[cells[at[k] : at[k + 1]]] = True
                    made.append(np.packbits(held).tobytes())  # eight cells a byte: workers hold several filters
                yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(made, pa.binary())], ["block", "bits"])

        cells = keys.where(F.col(name).isNotNull()).select(F.pmod(F.col(name), F.lit(bits)).cast("int").alias("c"))
        cells = cells.groupBy(F.floor(F.col("c") / span).cast("int").alias("block")).agg(F.collect_set((F.col("c") % span).cast("short")).alias("cells"))
        self.bits = np.zeros(bits // 8, np.uint8)
        for row in cells.mapInArrow(packed, "block int, bits binary").collect():
            self.bits[row["block"] * span // 8 :][: span // 8] = np.frombuffer(row["bits"], np.uint8)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys.astype(np.int64, copy=False) & (8 * len(self.bits) - 1)
        return (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


#: Nodes that a task remembers: a table of fixed size, in which a node takes the place of an older one.
REMEMBERED = 1 << 18


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[int], list[bool]]]:
    """Slices with each row's set, its node, and whether this task meets the node for the first time (or again after a while)."""
    forget()
    table, used = np.zeros(REMEMBERED, np.int64), np.zeros(REMEMBERED, bool)
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(part.column("text"))
            nodes = np.array([node_of(s) for s in sets], np.int64)
            at = nodes & (REMEMBERED - 1)
            new = ~(used[at] & (table[at] == nodes)) & np.array([len(s) > 0 for s in sets])
            first = np.zeros(len(nodes), bool)
            first[np.unique(nodes, return_index=True)[1]] = True
            new &= first
            table[at[new]], used[at[new]] = nodes[new], True
            yield part, sets, nodes.tolist(), new.tolist()


def _lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), pa.array(signed(flat)))


def _packed(counts: np.ndarray) -> bytes:
    """Counts of a block; most are small and few differ, so they are shuffled in a fraction of their bytes."""
    return zlib.compress((counts.astype(np.uint8) if counts.max() < 256 else counts).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    return np.frombuffer(raw, np.uint8 if len(raw) == BLOCK else np.uint16)


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens by cell of a task's documents, as blocks of cells; several rows for a block where counts would overflow."""
    count = np.zeros(CELLS, np.uint16)
    held = 0

    def rows():
        blocks = count.reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(1))
        for at in range(0, len(some), 64):
            own = some[at : at + 64]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([_packed(blocks[i]) for i in own], pa.binary())], ["block", "counts"])

    for _, sets, _, new in _sets(batches):
        tokens = [s for s, n in zip(sets, new) if n]
        if tokens:
            cells, times = np.unique(_cell(np.concatenate(tokens), CELLS), return_counts=True)
            count[cells] += times.astype(np.uint16)
            held += len(tokens)
        if held > 60_000:
            yield from rows()
            count[:], held = 0, 0
    yield from rows()


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for block, counts in zip(b.column("block").to_pylist(), b.column("counts").to_pylist()):
            sums[block] = sums.get(block, 0) + _unpacked(counts).astype(np.uint32)
    for block, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([int(total.sum())])], ["block", "counts", "all"])


def least_of(tokens: int, cells: int = CELLS) -> float:
    """Tokens of a cell from which on they are frequent, of so many in all.

    A multiple of the mean would grow with the input, and with it the holders of what passes for a rare token.
    """
    mean = tokens / cells
    return max(FREQUENT, mean + OVER_MEAN * mean**0.5)


def _grades(docs: DataFrame, where: str) -> np.ndarray:
    """The grade of each cell."""
    parts = docs.select("text").mapInArrow(_cell_counts, "block int, counts binary")
    sums = parts.repartition(shuffle_parts(docs.sparkSession), "block").mapInArrow(_block_sums, "block int, counts binary, all long")
    sums = cut(sums, where, "cells")
    least = least_of(sums.agg(F.sum("all")).first()[0] or 0)

    def graded(batches):
        for b in batches:
            rows = []
            for counts in b.column("counts").to_pylist():
                n = np.frombuffer(counts, np.uint32)
                rows.append(np.where(n >= least, np.minimum(GRADES, 1 + np.log2(np.maximum(n / least, 1)).astype(int)), 0).astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(rows, pa.binary())], ["block", "grades"])

    out = np.zeros(CELLS, np.int8)
    for row in sums.mapInArrow(graded, "block int, grades binary").collect():  # CELLS bytes in all
        out[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["grades"], np.int8)
    drop(docs.sparkSession, where, "cells")
    return out


def _intersections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        left, right = ([np.frombuffer(x, np.uint64) for x in b.column(c).to_pylist()] for c in ("left", "right"))
        good = np.zeros(b.num_rows, bool)
        for i, (x, y) in enumerate(zip(left, right)):
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            same = int((both[1:] == both[:-1]).sum())
            good[i] = 100 * same >= 80 * (len(x) + len(y) - same)
        keep = pa.array(good)
        yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])


def _held_sets(docs: DataFrame, owned: DataFrame, where: str, name: str) -> DataFrame:
    """(node, tokens) of at least the given nodes (node, owner).

    Of the documents with one set only the owner is looked at, and what the filter mistakes for one; rows without an id
    always are.
    """
    sc = docs.sparkSession.sparkContext
    wanted, ids = sc.broadcast(Filter(owned, "node")), sc.broadcast(Filter(owned, "owner"))

    def looked_at(batches):
        for b in batches:
            own = b.column("doc_id")
            hit = ids.value.holds(own.fill_null(0).to_numpy()) | own.is_null().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(hit))

    def sets(batches):
        for _, rows, nodes, new in _sets(looked_at(batches)):
            fresh = np.flatnonzero(new)
            hit = fresh[wanted.value.holds(np.array(nodes, np.int64)[fresh])].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in hit], pa.int64()), pa.array([rows[i].tobytes() for i in hit], pa.binary())], ["node", "tokens"])

    held = docs.select("doc_id", "text").mapInArrow(sets, "node long, tokens binary").groupBy("node").agg(F.first("tokens").alias("tokens"))
    return cut(held, where, name)


def _verified(docs: DataFrame, pairs: DataFrame, where: str, name: str) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar, of pairs with their owners (a, b, oa, ob)."""
    if pairs.isEmpty():
        return pairs.select("a", "b")
    owned = pairs.select(F.col("a").alias("node"), F.col("oa").alias("owner")).union(pairs.select("b", "ob"))
    held = _held_sets(docs, owned, where, f"{name}-sets")
    out = pairs.join(held.select(F.col("node").alias("a"), F.col("tokens").alias("left")), "a")
    out = out.join(held.select(F.col("node").alias("b"), F.col("tokens").alias("right")), "b")
    out = cut(out.select("a", "b", "left", "right").mapInArrow(_intersections, "a long, b long"), where, name)
    drop(docs.sparkSession, where, f"{name}-sets")
    return out


def _block_links(group: pa.Table) -> pa.Table:
    """Similar pairs of two blocks that are in different components, by products of 0/1 matrices."""
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    node, part, block = (group.column(c).to_numpy() for c in ("node", "part", "block"))
    sets = [np.frombuffer(x, np.uint64) for x in group.column("tokens").to_pylist()]
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[inverse] > 1  # what one set alone holds is in no intersection
    place = np.cumsum(count > 1) - 1
    row, column = row[keep], place[inverse[keep]]
    same = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int((count > 1).sum()), 8192):
        own = (column >= first) & (column < first + 8192)
        m = np.zeros((len(sets), 8192), np.float32)
        m[row[own], column[own] - first] = 1
        same += m @ m.T
    good = 100 * same >= 80 * (size[:, None] + size - same)
    good &= (part[:, None] != part) & ((block == i)[:, None] & (block == j))
    a, b = np.nonzero(good)
    low, high = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
    return pa.table({"a": low, "b": high}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _large(docs: DataFrame, sizes: DataFrame, held: DataFrame, where: str) -> DataFrame:
    """Links across components among the holders of large signatures.

    Large signatures have much the same holders (variants of one text), so those that share holders are put together
    and their holders compared once, block by block, however many signatures they share.
    """
    if held.isEmpty():
        return held.select(F.col("node").alias("a"), F.col("part").alias("b"))
    first = F.min("sig").over(Window.partitionBy("node"))  # a node's signatures go with its first one
    own = cut(held.select("sig", "node", "n", "part", first.alias("first")), where, "own")
    alike = components(own.select(F.col("sig").alias("a"), F.col("first").alias("b")).where("a <> b").distinct(), where, "crowds")
    crowd = own.select("node", "n", "part", "first").distinct().join(alike.withColumnRenamed("node", "first"), "first", "left")
    crowd = cut(crowd.select("node", "n", "part", F.coalesce("component", "first").alias("crowd")), where, "crowd")
    sets = _held_sets(docs, sizes.join(crowd.select("node"), "node", "left_semi").select("node", "owner"), where, "crowd-sets")
    blocks = F.ceil(F.greatest(F.count("*") / ROWS, F.sum("n") / TOKENS)).cast("int")
    counts = cut(crowd.groupBy("crowd").agg(blocks.alias("blocks"), F.sum("n").alias("tokens")), where, "crowd-sizes")
    rows = crowd.join(counts.drop("tokens"), "crowd")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(sets, "node")
    # Each block meets all, by turns that are the sums of two blocks' numbers, so that a turn shuffles few copies of a set.
    most, tokens = counts.agg(F.max("blocks"), F.sum("tokens")).first()
    copies, out = max(1, AT_ONCE // tokens), None
    for turn in range(0, most, copies):
        sums = F.sequence(F.lit(turn), F.least(F.lit(turn + copies), "blocks") - 1)
        other = F.explode(F.transform(sums, lambda s: F.pmod(s - F.col("block"), F.col("blocks")))).alias("other")
        met = rows.where(F.col("blocks") > turn).select("crowd", "node", "part", "tokens", "block", other)
        met = met.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        links = cut(met.groupBy("crowd", "i", "j").applyInArrow(_block_links, "a long, b long"), where, f"crowd-links/{turn}")
        out = links if out is None else out.union(links)
    drop(docs.sparkSession, where, "own", "crowds", "crowd", "crowd-sets", "crowd-sizes")
    return out


def unordered(pairs: DataFrame) -> DataFrame:
    """Each pair once, the smaller node first, with the owners."""
    ends = [F.struct(F.col(x).alias("node"), F.col(f"o{x}").alias("owner")) for x in "ab"]
    low, high = F.least(*ends), F.greatest(*ends)
    return pairs.select(low["node"].alias("a"), high["node"].alias("b"), low["owner"].alias("oa"), high["owner"].alias("ob")).distinct()


def parted(held: DataFrame, parts: DataFrame, where: str, name: str) -> DataFrame:
    """Holders (sig, node, n) with their component, of the signatures whose holders are in several."""
    held = held.join(parts, "node", "left").select("sig", "node", "n", F.coalesce("component", "node").alias("part"))
    across = held.groupBy("sig").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("sig")
    return cut(held.join(cut(across, where, f"{name}-sigs"), "sig"), where, name)


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", where: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return named_groups(df, doc_id, text, where).select("doc_id", "n_shingles", "component_id")


def named_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", where: str | None = None) -> DataFrame:
    """The groups with each row's node, and part: the smallest node of its component."""
    with freeing(df.sparkSession):
        return _named_groups(pick(df, doc_id=doc_id, text=text), where or shared_dir(df.sparkSession))


def _named_groups(docs: DataFrame, where: str) -> DataFrame:
    spark = docs.sparkSession
    grades = spark.sparkContext.broadcast(_grades(docs, where))

    def index(batches):
        for part, sets, nodes, new in _sets(batches):
            both = [signatures(s, grades.value) if n else (s[:0], False) for s, n in zip(sets, new)]
            rows, single = [r for r, _ in both], [x for _, x in both]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(single), _lists(rows)],
                ["doc_id", "node", "n", "single", "sigs"],
            )

    facts = cut(docs.mapInArrow(index, "doc_id long, node long, n long, single boolean, sigs array<long>"), where, "facts")
    sizes = facts.where("n > 3 and size(sigs) > 0").groupBy("node", "n", "single").agg(F.min("doc_id").alias("owner"))
    sizes = cut(sizes, where, "sizes")

    def likely(pairs: DataFrame) -> DataFrame:
        """Of (a, b, shared signatures) those whose sets may be similar, with their owners (a, b, oa, ob)."""
        for c in ("a", "b"):
            pairs = pairs.join(sizes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("single").alias(f"s{c}"), F.col("owner").alias(f"o{c}")), c)
        near = "5 * na >= 4 * nb and 5 * nb >= 4 * na"
        enough = "not (sa and sb) or c + ceil(4 * greatest(na, nb) / 5) - 1 >= ceil(4 * (na + nb) / 9)"
        return pairs.where(f"{near} and ({enough})").select("a", "b", "oa", "ob")

    # Signatures that several nodes hold; most are held by one and go no further than these counts.  They come by turns, as
    # counting all at once shuffles, and spills, the most of all steps.
    every = facts.select("node", F.explode("sigs").alias("sig"))
    ends = F.min("node").alias("least"), F.max("node").alias("most")
    turns, shared = min(TURNS, 1 + (facts.agg(F.sum("n")).first()[0] or 0) // AT_ONCE), None
    for turn in range(turns):
        some = every.where(F.pmod("sig", F.lit(turns)) == turn).groupBy("sig").agg(*ends).where("least <> most")
        some = cut(some, where, f"shared/{turn}")
        shared = some if shared is None else shared.union(some)
    bits = min(MOST_BITS, max(FILTER_BITS, 1 << (BITS_EACH * shared.count()).bit_length()))
    several = spark.sparkContext.broadcast(Filter(shared, "sig", bits))

    def holders(batches):
        for b in batches:
            sigs = b.column("sigs")
            flat = sigs.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), np.diff(sigs.offsets.to_numpy()))
            hit = np.flatnonzero(several.value.holds(flat))
            at = pa.array(row[hit])
            yield pa.RecordBatch.from_arrays([pa.array(flat[hit]), b.column("node").take(at), b.column("n").take(at)], ["sig", "node", "n"])

    held = facts.where(F.size("sigs") > 0).select("node", "n", "sigs").mapInArrow(holders, "sig long, node long, n long")
    held = cut(held.distinct().join(shared, "sig"), where, "held")
    facts = cut(facts.select("doc_id", "node", "n"), where, "rows")  # the signatures are not needed any more
    drop(spark, where, "shared", "facts")

    # First every holder with the smallest and the largest one; then, for what is still apart, with a few others.
    ends = held.select("node", F.explode(F.array("least", "most")).alias("a")).where("node <> a")
    stars = ends.groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("c"))
    stars = cut(unordered(likely(stars)), where, "stars")
    parts = components(_verified(docs, stars, where, "links"), where, "parts")
    apart = parted(held.select("sig", "node", "n"), parts, where, "apart1")
    drop(spark, where, "links", "held", "apart1-sigs")

    def joined(parts: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """Components after further links: those known so far are stars already and stand for all links before."""
        return parts if links.isEmpty() else components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links), where, name)

    center = F.min_by(F.struct("node", "part"), F.xxhash64("node", F.pmod("sig", F.lit(CENTERS)))).alias("center")
    chosen = cut(apart.groupBy("sig").agg(center).select("sig", F.col("center.node").alias("a"), F.col("center.part").alias("pa")), where, "centers")
    tried = apart.join(chosen, "sig").where("part <> pa").groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("c"))
    tried = cut(unordered(likely(tried)).join(stars, ["a", "b"], "left_anti"), where, "tried")
    parts = joined(parts, _verified(docs, tried, where, "links2"), "parts2")
    tried = stars.union(tried)

    # Signatures across provisional components: every pair of holders in different ones.
    held = parted(apart.select("sig", "node", "n"), parts, where, "apart2")
    sizes2 = cut(held.groupBy("sig").count(), where, "holders")
    drop(spark, where, "links2", "apart1", "apart2-sigs", "centers")
    large = _large(docs, sizes, held.join(sizes2.where(F.col("count") > LARGE), "sig"), where)
    held = held.join(sizes2.where(F.col("count") <= LARGE), "sig").drop("count")
    main = held.groupBy("sig", "part").count().groupBy("sig").agg(F.max_by("part", F.struct("count", "part")).alias("main"))
    held = held.join(cut(main, where, "main"), "sig")
    # A pair across components has one outside the largest one; if both are outside, it comes up twice, and once counts.
    few = held.where("part <> main").select("sig", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("part").alias("px"))
    pairs = held.join(few, "sig").where("part <> px and (part = main or node < x) and 5 * n >= 4 * nx and 5 * nx >= 4 * n")
    pairs = pairs.groupBy(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")).agg(F.count("*").alias("c"))
    pairs = cut(likely(pairs).join(tried, ["a", "b"], "left_anti"), where, "pairs")
    more = _verified(docs, pairs, where, "more")
    parts = joined(parts, more.union(large), "nodes")
    drop(spark, where, "sizes", "stars", "tried", "apart2", "holders", "main", "pairs", "more", "crowd-links")

    out = facts.select("doc_id", "node", "n").join(parts, "node", "left").select("doc_id", "node", "n", F.coalesce("component", "node").alias("part"))
    first = cut(out.where("n > 0").groupBy("part").agg(F.min("doc_id").alias("component_id")), where, "smallest")
    out = out.join(first, "part", "left")
    return out.select("doc_id", "node", "part", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, that stay when of each group only the document with the smallest id does.

    Most rows pass by a filter of fixed size; only ids that go, ids that occur twice and what the filter mistakes for
    them are joined.  Rows with one id are told apart by their sets: of those in one group, one stays, the first by set,
    text and the other columns; those in other groups are other documents.  Rows without an id cannot be told apart; they
    stay.  Documents without words (null or empty texts) are in no group and stay, one for each id.  Columns may have any
    names: they travel as one struct.  An empty table gives an empty one.
    """
    spark = df.sparkSession
    where = shared_dir(spark)
    found = cut(named_groups(df, doc_id, text, where), where, "groups").where(F.col("doc_id").isNotNull())
    drop(spark, where, "rows", "parts", "parts2", "nodes", "smallest")
    stays = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    fate = cut(found.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.min(stays).alias("every_stays")).where("n_rows > 1 or not every_stays"), where, "fate")
    unsure = spark.sparkContext.broadcast(Filter(fate, "doc_id"))
    rows = df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))

    def marked(batches, wanted):
        for b in batches:
            ids = b.column("id")
            hit = unsure.value.holds(ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(hit == wanted))

    sure = rows.mapInArrow(lambda batches: marked(batches, False), rows.schema).select("row.*")

    def noded(batches):
        for b in marked(batches, True):
            for part in slices(b, "text"):
                nodes = [node_of(s) for s in shingle_sets(part.column("text"))]
                yield part.append_column("node", pa.array(nodes, pa.int64()))

    rest = rows.mapInArrow(noded, T.StructType([*rows.schema.fields, T.StructField("node", T.LongType())]))
    unclear = found.join(fate.select("doc_id"), "doc_id", "left_semi")
    goes = cut(unclear.select(F.col("doc_id").alias("id"), "node", "part", stays.alias("stays")).distinct(), where, "goes")
    rest = rest.join(goes, ["id", "node"], "left")
    single = rest.where("part is null").select("row.*")
    order = Window.partitionBy("id", "part").orderBy("node", "text", F.to_json("row"))
    twice = rest.where("stays").withColumn("nth", F.row_number().over(order)).where("nth = 1").select("row.*")
    return sure.unionByName(single).unionByName(twice)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
