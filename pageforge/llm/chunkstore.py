"""Content-addressed store of token ids (operator 2).

A rolling hash over the last ids of a stream decides where chunks end, so equal passages give equal chunks wherever
they stand.  A chunk's name is the digest of its bytes.  The store is one Parquet folder with three kinds of rows:

    kind=c  key (chunk digest), payload (little-endian ids of `width` bytes)        each chunk once
    kind=r  key (Merkle root), seq, ref (chunk digest)                               each distinct recipe once
    kind=d  key (Merkle root), doc_id, n (ids), seq (chunks), copies                 the documents

and a manifest, ascending by doc_id, with each document's place in the stream of all ids.  Reading recomputes each
chunk's digest from its bytes and each root from its recipe.

Null and empty texts are documents of one id, the end id.  Rows with equal doc_id are documents of their own, ordered
by root; a null doc_id comes first.  Ids that do not fit `width` bytes are an error.  An empty table gives empty files.
Long texts are cut into chunks like others; only one text's recipe meets in one task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageforge.llm.common import pick, shared_dir, shuffle_parts, slices, splitmix, table
from pageforge.llm.wordcodes import library_codes

END_ID = 2
#: Ids in the rolling window; a chunk ends where the window's hash has MASK's bits clear: 256 ids on average.
WINDOW, MASK, LEAST, MOST = 16, 255, 32, 2048
_BASE = 0xD1342543DE82EF95


def ends_of_chunks(ids: np.ndarray, off: np.ndarray) -> list[list[int]]:
    """For each stream the ends of its chunks, relative to its start."""
    n = len(ids)
    power, inverse = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(b))])) for b in (_BASE, pow(_BASE, -1, 2**64)))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(splitmix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * power[:n], out=sums[1:])
    at = np.arange(WINDOW, n + 1)
    here = at[splitmix((sums[at] - sums[at - WINDOW]) * inverse[at - WINDOW]) & np.uint64(MASK) == 0] if n >= WINDOW else at[:0]
    low, high = np.searchsorted(here, off[:-1] + WINDOW), np.searchsorted(here, off[1:])
    out = []
    for a, b, i, j in zip(off[:-1].tolist(), off[1:].tolist(), low.tolist(), high.tolist()):
        row, last = [], a
        for e in (*here[i:j].tolist(), b):
            while e - last > MOST:
                last += MOST
                row.append(last - a)
            if e - last >= LEAST or e == b and e > last:
                row.append(e - a)
                last = e
        out.append(row)
    return out


def merkle(digests: list[bytes]) -> bytes:
    """The root over chunk digests in order; leaves and inner nodes are marked apart, an odd node moves up."""
    level = [hashlib.blake2b(b"\0" + d, digest_size=16).digest() for d in digests]
    while len(level) > 1:
        up = [hashlib.blake2b(b"\1" + a + b, digest_size=16).digest() for a, b in zip(level[::2], level[1::2])]
        level = up + level[len(up) * 2 :]
    return level[0] if level else hashlib.blake2b(b"", digest_size=16).digest()


STORE = "kind string, key binary, doc_id long, seq int, n long, copies long, ref binary, payload binary"


def _rows(batches: Iterator[pa.RecordBatch], path: str, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    codes = library_codes(path)
    seen: set[bytes] = set()
    for batch in batches:
        for part in slices(batch, "text"):
            ids, off = codes(part.column("text"))
            size = np.diff(off) + 1
            flat = np.full(int(size.sum()), end_id, np.int64)
            flat[np.arange(len(ids)) + np.repeat(np.arange(len(size)), size - 1)] = ids
            off = np.concatenate([[0], np.cumsum(size)])
            if len(flat) and int(flat.max()) >> 8 * width:
                raise ValueError(f"id {int(flat.max())} does not fit {width} bytes")
            raw = flat.astype(f"<u{width}").tobytes()
            cols: list[list] = [[] for _ in range(8)]

            def put(*row):
                for c, x in zip(cols, row):
                    c.append(x)

            for doc, a, n, ends in zip(part.column("doc_id").to_pylist(), off.tolist(), size.tolist(), ends_of_chunks(flat, off)):
                names, last = [], 0
                for e in ends:
                    body = raw[(a + last) * width : (a + e) * width]
                    name = hashlib.blake2b(body, digest_size=16).digest()
                    names.append(name)
                    if name not in seen:
                        seen.add(name)
                        put("c", name, None, 0, e - last, 1, None, body)
                    last = e
                root = merkle(names)
                put("d", root, doc, len(names), n, 1, None, None)
                if root not in seen:
                    seen.add(root)
                    for k, name in enumerate(names):
                        put("r", root, None, k, 0, 1, name, None)
            if len(seen) > 400_000:  # bounded memory; what comes again is dropped when the store is written
                seen.clear()
            kinds = (pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], STORE.replace(" string", "").replace(" binary", "").replace(" long", "").replace(" int", "").split(", "))


def write(df: DataFrame, path: str, where: str, end_id: int = END_ID, width: int = 2, doc_id: str = "doc_id", text: str = "text") -> str:
    """Encodes the rows and writes store and manifest under `where`.  `width`: bytes for an id; 2 holds ids below 65536."""
    spark = df.sparkSession
    rows = pick(df, doc_id=doc_id, text=text).mapInArrow(partial(_rows, path=path, end_id=end_id, width=width), STORE)
    first = [F.first(c).alias(c) for c in ("n", "ref", "payload")]
    rows = rows.groupBy("kind", "key", "doc_id", "seq").agg(*first, F.sum("copies").alias("copies"))
    rows.write.partitionBy("kind").option("compression", "zstd").parquet(f"{where}/store")
    documents = _kind(spark, where, "d").select("doc_id", "key", "n", F.col("seq").alias("chunks"), "copies")
    documents = documents.repartitionByRange(shuffle_parts(spark), "doc_id", "key").sortWithinPartitions("doc_id", "key")
    documents = documents.withColumn("part", F.spark_partition_id()).mapInArrow(_running, "doc_id long, key binary, n long, chunks int, copies long, part int, before long")
    documents.write.option("compression", "zstd").parquet(f"{where}/manifest")
    return where


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for b in batches:
        ends = total + np.cumsum(b.column("n").to_numpy() * b.column("copies").to_numpy())
        before = np.concatenate([[total], ends[:-1]]) if len(ends) else ends
        total = int(ends[-1]) if len(ends) else total
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before.astype(np.int64))], [*b.schema.names, "before"])


def _kind(spark: SparkSession, where: str, kind: str) -> DataFrame:
    return spark.read.schema(STORE).parquet(f"{where}/store").where(F.col("kind") == kind)


def _facts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """What the stored bytes of each chunk say: ids, crc, and whether its name is their digest."""
    for b in batches:
        keys, bodies = b.column("key").to_pylist(), b.column("payload").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.binary()),
                pa.array([len(x) // width for x in bodies], pa.int64()),
                pa.array([zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4").data) for x in bodies], pa.int64()),
                pa.array([hashlib.blake2b(x, digest_size=16).digest() == k for k, x in zip(keys, bodies)], pa.bool_()),
            ],
            ["ref", "n", "crc", "good"],
        )


def _shift_tables() -> np.ndarray:
    """Tables that move a crc past 2**k zero bytes: [k, byte of the crc, its value]."""
    poly = 0xEDB88320
    rows = []
    for bit in range(32):  # one zero bit, then squared thrice for a byte
        x = 1 << bit
        rows.append(x >> 1 ^ (poly if x & 1 else 0))

    def times(m: list[int], x: int) -> int:
        out, k = 0, 0
        while x:
            if x & 1:
                out ^= m[k]
            x, k = x >> 1, k + 1
        return out

    for _ in range(3):
        rows = [times(rows, x) for x in rows]
    out = np.zeros((42, 4, 256), np.uint64)
    for k in range(42):
        for part in range(4):
            for v in range(256):
                out[k, part, v] = times(rows, v << 8 * part)
        rows = [times(rows, x) for x in rows]
    return out


_tables: list[np.ndarray] = []


def crc_of_parts(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Each crc moved past the bytes that come after its part; xor gives the crc of the whole."""
    if not _tables:
        _tables.append(_shift_tables())
    crc = crc.astype(np.uint64)
    for k in range(int(after.max(initial=0)).bit_length()):
        on = np.flatnonzero(after >> k & 1)
        x, t = crc[on], _tables[0][k]
        crc[on] = t[0, (x & np.uint64(255)).astype(int)] ^ t[1, (x >> np.uint64(8) & np.uint64(255)).astype(int)] ^ t[2, (x >> np.uint64(16) & np.uint64(255)).astype(int)] ^ t[3, (x >> np.uint64(24)).astype(int)]
    return crc


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each recipe: the ids, their crc, and whether chunks and root are what the names say."""
    for b in batches:
        parts = b.column("parts")
        flat, off = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
        off = off - off[0]
        seq, n, crc = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("seq", "n", "crc"))
        names, good = flat.field("ref").to_pylist(), flat.field("good").to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        order = np.lexsort((seq, row))
        n, crc = n[order], crc[order]
        ends = np.cumsum(n)
        upto = ends[off[1:] - 1]
        whole = np.bitwise_xor.reduceat(crc_of_parts(crc, 4 * (upto[row] - ends)), off[:-1]) if len(order) else crc
        good = np.logical_and.reduceat(good[order], off[:-1]) if len(order) else good
        total = np.add.reduceat(n, off[:-1]) if len(order) else n
        roots = [merkle([names[k] for k in order[a:z].tolist()]) for a, z in zip(off[:-1].tolist(), off[1:].tolist())]
        good = [bool(g) and r == k for g, r, k in zip(good.tolist(), roots, b.column("key").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(total.astype(np.int64)), pa.array(whole.astype(np.int64)), pa.array(good, pa.bool_())], ["key", "n_read", "ids_crc32", "verified"])


def read(spark: SparkSession, where: str, width: int = 2) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32, n_chunks, merkle_root, verified."""
    facts = _kind(spark, where, "c").select("key", "payload").mapInArrow(partial(_facts, width=width), "ref binary, n long, crc long, good boolean")
    recipes = _kind(spark, where, "r").select("key", "seq", "ref").join(facts, "ref")
    recipes = recipes.groupBy("key").agg(F.collect_list(F.struct("seq", "n", "crc", "ref", "good")).alias("parts"))
    recipes = recipes.mapInArrow(_whole, "key binary, n_read long, ids_crc32 long, verified boolean")
    manifest = spark.read.parquet(f"{where}/manifest")
    sums = manifest.groupBy("part").agg(F.sum(F.col("n") * F.col("copies")).alias("ids")).collect()  # one row per file part
    starts, total = {}, 0
    for r in sorted(sums, key=lambda r: r["part"]):
        starts[r["part"]], total = total, total + r["ids"]
    parts = spark.createDataFrame(sorted(starts.items()), "part int, base long")
    out = manifest.join(F.broadcast(parts), "part").join(recipes, "key")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return out.select(
        "doc_id",
        (F.col("base") + F.col("before") + F.col("copy") * F.col("n")).alias("start"),
        F.col("n_read").alias("n_tokens"),
        "ids_crc32",
        F.col("chunks").cast("long").alias("n_chunks"),
        F.lower(F.hex("key")).alias("merkle_root"),
        (F.col("verified") & (F.col("n") == F.col("n_read"))).alias("verified"),
    )


def restore(spark: SparkSession, where: str, width: int = 2) -> DataFrame:
    """doc_id and ids (array<int>) of every document, put together from its chunks."""

    def join(batches):
        for b in batches:
            rows = [np.frombuffer(b"".join(p["payload"] for p in sorted(parts, key=lambda p: p["seq"])), f"<u{width}").astype(np.int32) for parts in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(rows, pa.list_(pa.int32()))], ["key", "ids"])

    chunks = _kind(spark, where, "c").select(F.col("key").alias("ref"), "payload")
    recipes = _kind(spark, where, "r").select("key", "seq", "ref").join(chunks, "ref")
    recipes = recipes.groupBy("key").agg(F.collect_list(F.struct("seq", "payload")).alias("parts")).mapInArrow(join, "key binary, ids array<int>")
    out = spark.read.parquet(f"{where}/manifest").join(recipes, "key")
    return out.select("doc_id", "ids", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc_id", "ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return read(spark, write(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"), shared_dir(spark)))
