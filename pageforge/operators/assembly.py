"""Sessions' pages as PDF files, made in parts that know their places.

A file is never put together in one task.  Pages become compressed objects where they lie.  How many objects and bytes
stand before each page are running sums over its session, first within ranges of pages, then over the ranges, so a
session that holds a third of all pages is spread like any other.  Object numbers, the tree of pages, byte offsets and
the cross-reference stream follow from these sums by column arithmetic; compressed pages are shuffled once, to meet
their numbers.  The result is a table of parts (session_id, at, data): ordered by `at` they are the file, whatever its
size.

Layout of a file: header, the objects of the pages in order, the tree of pages from its leaves up, the root, the
cross-reference stream.  Object 1 is the root, 2 the top of the tree; pages' objects begin at 3.

Rows of sessions: session_id, id, order, deleted, passthrough, pdf (of pages that pass through), raster.  Deleted
pages, pages without pixels, files that cannot be read and sessions without pages are left out; `faults` lists the
files.  Pages of a session with one order are told apart by id, and (session_id, order, id) is to be unique.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageforge.config import SETTINGS, Settings
from pageforge.kernels import pdf
from pageforge.operators.documents import streams
from pageforge.session import cut, shared_dir, shuffle_parts

# What a file begins with, the parts of an object, the width of an entry of the cross-reference stream.
HEADER, BEGIN, END = "%PDF-1.5\n", " 0 obj\n", "\nendobj\n"
ENTRY = 9
#: Pages or nodes below a node of the tree, and its levels: enough for FAN ** LEVELS pages.
FAN, LEVELS = 256, 6
KEY = ["session_id", "order", "id"]
UNREADABLE = (ValueError, KeyError, IndexError, TypeError, AttributeError, RecursionError, zlib.error)


def ranged(rows: DataFrame, by: list[str], where: str, name: str) -> DataFrame:
    """The rows in ranges of the columns `by`, written, with the range's number as part."""
    ranges = rows.repartitionByRange(shuffle_parts(rows.sparkSession), *by).withColumn("part", F.spark_partition_id())
    return cut(ranges, where, name)


def running(rows: DataFrame, group: str, order: list[str], sums: list[str]) -> DataFrame:
    """Adds <c>_before, what the rows of the group before this one sum up to, and <c>_total for each column in `sums`.

    Rows come from `ranged` by group and order: windows hold the rows of one range, or one row for each range.
    """
    each = rows.groupBy(group, "part").agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(group, "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_past") for c in sums], *[F.sum(c).over(Window.partitionBy(group)).alias(f"{c}_total") for c in sums])
    within = Window.partitionBy(group, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums}).join(each, [group, "part"])
    return out.withColumns({f"{c}_before": F.col(f"{c}_before") + F.col(f"{c}_past") for c in sums}).drop(*[f"{c}_past" for c in sums])


@dataclass(frozen=True)
class Tree:
    """The numbers of the tree's nodes, as columns of a session's pages and objects."""

    pages: Column
    objects: Column
    fan: int

    def width(self, level: int) -> Column:
        """Nodes of a level; level 0 are the pages."""
        size = self.fan**level
        return F.floor((self.pages + (size - 1)) / size)

    def first(self, level: int) -> Column:
        return reduce(lambda s, k: s + self.width(k), range(1, level), self.objects + 3)

    def number(self, level: int, nth: Column) -> Column:
        return F.when(self.width(level) == 1, F.lit(2)).otherwise(self.first(level) + nth).cast("long")

    def count(self) -> Column:
        """All objects of the file but the cross-reference stream."""
        below = reduce(lambda s, k: s + F.when(self.width(k) > 1, self.width(k)).otherwise(0), range(1, LEVELS + 1), self.objects + 2)
        return below.cast("long")


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def points(pixels: Column, dpi: int) -> Column:
    """A length in points with four digits, rounded half up, without floating point."""
    q = F.floor((pixels.cast("long") * 1_440_000 + dpi) / (2 * dpi)).cast("long")
    return text(F.floor(q / 10_000), ".", F.lpad((q % 10_000).cast("string"), 4, "0"))


def page_text(number: Column, parent: Column, height: Column, width: Column, dpi: int) -> tuple[Column, Column, Column]:
    """The objects of an image page: the page, what it draws, and what stands before the image."""
    w, h = points(width, dpi), points(height, dpi)
    page = text(number, BEGIN, "<< /Type /Page /Parent ", parent, " 0 R /MediaBox [0 0 ", w, " ", h, "] /Contents ", number + 1, " 0 R /Resources << /XObject << /I ", number + 2, " 0 R >> >> >>", END)
    draw = text("q ", w, " 0 0 ", h, " 0 0 cm /I Do Q")
    return page, text(number + 1, BEGIN, "<< /Length ", F.length(draw), " >>\nstream\n", draw, "\nendstream", END), text(number + 2, BEGIN)


def entry(at: Column) -> Column:
    """The entry of an object in the cross-reference stream, in hexadecimal digits."""
    return F.concat(F.lit("01"), F.lpad(F.hex(at), 16, "0"))


def _extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many pages and objects a file brings along."""
    for b in batches:
        found = []
        for data in b.column("body").to_pylist():
            try:
                file = pdf.File(data)
                objects, kids = pdf.copied([(file, page, 0) for page in file.pages], 1, lambda _: 2)
                found.append((len(kids), len(objects), None))
            except UNREADABLE as fault:
                found.append((0, 0, str(fault) or type(fault).__name__))
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))], [*b.schema.names, "pages", "objects", "fault"])


def _copies(batches: Iterator[pa.RecordBatch], fan: int) -> Iterator[pa.RecordBatch]:
    """The objects of files that pass through, under the numbers that they get in the session's file."""
    for b in batches:
        data, sizes, kids = [], [], []
        for r in b.to_pylist():
            file = pdf.File(r["body"])
            above = (lambda k, r=r: 2) if r["pages_total"] <= fan else (lambda k, r=r: 3 + r["objects_total"] + (r["pages_before"] + k) // fan)
            objects, numbers = pdf.copied([(file, page, 0) for page in file.pages], 3 + r["objects_before"], above)
            data.append(b"".join(objects))
            sizes.append(list(map(len, objects)))
            kids.append(numbers)
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in KEY), pa.array(data, pa.binary()), pa.array(sizes, longs), pa.array(kids, longs)], [*KEY, "data", "sizes", "kids"])


@dataclass
class Files:
    """All sessions' files: parts (session_id, at, data), objects (session_id, number, at, length), sessions
    (session_id, pages, objects, size), faults (session_id, order, id, fault)."""

    parts: DataFrame
    objects: DataFrame
    sessions: DataFrame
    faults: DataFrame


def assembled(pages: DataFrame, encoding: str | None = None, s: Settings = SETTINGS, fan: int = FAN, where: str | None = None) -> Files:
    spark, dpi = pages.sparkSession, s.output.dpi
    where = where or shared_dir(spark)
    live = pages.where(~F.col("deleted"))
    images = streams(live.where(~F.col("passthrough")).select(*KEY, "raster"), encoding, s).where("image is not null")
    images = images.select(*KEY, F.lit(False).alias("born"), "height", "width", F.col("image").alias("body"), F.lit(1).cast("long").alias("pages"), F.lit(3).cast("long").alias("objects"), F.lit(None).cast("string").alias("fault"))
    born = live.where(F.col("passthrough") & F.col("pdf").isNotNull()).select(*KEY, F.lit(True).alias("born"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("int").alias("width"), F.col("pdf").alias("body"))
    born = born.mapInArrow(_extents, images.schema)
    bodies = cut(images.unionByName(born), where, "bodies")

    # Numbers: of pages and objects before each row.
    narrow = bodies.where("pages > 0").select(*KEY, "born", "height", "width", F.octet_length("body").cast("long").alias("body_size"), "pages", "objects")
    rows = running(ranged(narrow, KEY, where, "ranges"), "session_id", ["order", "id"], ["pages", "objects"])
    needs = [*KEY, "pages_before", "pages_total", "objects_before", "objects_total"]
    copies = rows.where("born").select(*needs).join(bodies.where("born").select(*KEY, "body"), KEY)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    key_types = ", ".join(f"`{k}` {kinds[k]}" for k in KEY)
    copies = cut(copies.mapInArrow(lambda b: _copies(b, fan), f"{key_types}, data binary, sizes array<long>, kids array<long>"), where, "copies")

    tree = Tree(F.col("pages_total"), F.col("objects_total"), fan)
    number = F.col("objects_before") + 3
    page, draw, head = page_text(number, tree.number(1, F.floor(F.col("pages_before") / fan)), F.col("height"), F.col("width"), dpi)
    image_size = F.octet_length(head).cast("long") + F.col("body_size") + len(END)
    drawn = rows.where("not born").withColumns({"text": F.concat(page, draw, head), "sizes": F.array(F.octet_length(page).cast("long"), F.octet_length(draw).cast("long"), image_size), "kids": F.array(number)})
    taken = rows.where("born").join(copies.drop("data"), KEY).withColumn("text", F.lit(None).cast("string"))
    rows = drawn.unionByName(taken).withColumn("size", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))
    rows = running(cut(rows.drop("body_size", "height", "width"), where, "sized"), "session_id", ["order", "id"], ["size"])
    rows = cut(rows.withColumn("at", F.col("size_before") + len(HEADER)), where, "rows")

    # The tree: leaves from the pages, every further level from the first node below.
    leaf = rows.select("session_id", "pages_total", "objects_total", "size_total", "pages_before", F.posexplode("kids").alias("k", "kid")).withColumn("rank", F.col("pages_before") + F.col("k"))
    leaf = leaf.groupBy("session_id", F.floor(F.col("rank") / fan).alias("nth")).agg(*[F.first(c).alias(c) for c in ("pages_total", "objects_total", "size_total")], F.array_sort(F.collect_list(F.struct("rank", "kid"))).alias("kids"))
    leaf = cut(leaf.withColumn("kids", F.col("kids.kid")), where, "leaves")
    nodes = [leaf.withColumn("level", F.lit(1))]
    for level in range(2, LEVELS + 1):
        own = leaf.where((F.col("nth") % fan ** (level - 1) == 0) & (tree.width(level - 1) > 1)).withColumn("nth", F.floor(F.col("nth") / fan ** (level - 1)))
        least = tree.first(level - 1) + F.col("nth") * fan
        nodes.append(own.withColumns({"kids": F.sequence(least, least + F.least(F.lit(fan), tree.width(level - 1) - F.col("nth") * fan) - 1), "level": F.lit(level)}))
    nodes = reduce(DataFrame.unionByName, nodes)
    by_level = lambda f: reduce(lambda c, k: c.when(F.col("level") == k, f(k)), range(2, LEVELS + 1), F.when(F.col("level") == 1, f(1)))
    above = by_level(lambda k: F.when(tree.width(k) > 1, text("/Parent ", tree.number(k + 1, F.floor(F.col("nth") / fan)), " 0 R ")).otherwise(""))
    count = by_level(lambda k: F.least(F.lit(fan**k), F.col("pages_total") - F.col("nth") * fan**k))
    kids = F.array_join(F.transform("kids", lambda k: text(k, " 0 R")), " ")
    nodes = nodes.withColumns({"number": by_level(lambda k: tree.number(k, F.col("nth")))})
    nodes = nodes.withColumn("text", text(F.col("number"), BEGIN, "<< /Type /Pages ", above, "/Kids [", kids, "] /Count ", count, " >>", END))
    nodes = nodes.select("session_id", "level", "nth", "number", "text", "pages_total", "objects_total", "size_total", F.octet_length("text").cast("long").alias("length"))
    nodes = running(ranged(nodes, ["session_id", "level", "nth"], where, "nodes"), "session_id", ["level", "nth"], ["length"])
    nodes = nodes.withColumn("at", F.col("length_before") + F.col("size_total") + len(HEADER))

    # What a session has once: the root, and the cross-reference stream that knows all places by arithmetic.
    root = "1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>" + END
    last = nodes.where("number = 2").select("session_id", "pages_total", "objects_total", F.col("at").alias("top_at"), (F.col("size_total") + F.col("length_total") + len(HEADER)).alias("root_at"))
    last = last.withColumns({"count": tree.count(), "x_at": F.col("root_at") + len(root)})
    begin = text(F.col("count") + 1, BEGIN, "<< /Type /XRef /Size ", F.col("count") + 2, f" /W [1 {ENTRY - 1} 0] /Root 1 0 R /Length ", (F.col("count") + 2) * ENTRY, " >>\nstream\n")
    last = last.withColumn("begin", begin).withColumn("entries_at", F.col("x_at") + F.length("begin"))
    tail = text("\nendstream", END, "startxref\n", F.col("x_at"), "\n%%EOF\n")
    last = cut(last.withColumns({"tail": tail, "tail_at": F.col("entries_at") + (F.col("count") + 1) * ENTRY}), where, "sessions")

    ranges = lambda df: df.join(df.select("session_id", "part").distinct().join(last.select("session_id", "entries_at"), "session_id"), ["session_id", "part"])
    offsets = F.transform(F.sequence(F.lit(0), F.size("sizes") - 1), lambda k: F.col("at") + F.aggregate(F.slice("sizes", 1, k), F.lit(0).cast("long"), lambda a, x: a + x))
    rows = rows.withColumn("offsets", offsets)
    binary = lambda c: F.encode(c, "utf-8")
    made = [
        last.select("session_id", F.lit(0).cast("long").alias("at"), binary(F.lit(HEADER)).alias("data")),
        rows.where("not born").join(bodies.where("not born").select(*KEY, "body"), KEY).select("session_id", "at", F.concat(binary(F.col("text")), "body", binary(F.lit(END))).alias("data")),
        rows.where("born").join(copies.select(*KEY, "data"), KEY).select("session_id", "at", "data"),
        nodes.select("session_id", "at", binary(F.col("text")).alias("data")),
        last.select("session_id", F.col("root_at").alias("at"), F.concat(binary(F.concat(F.lit(root), "begin")), F.unhex(F.concat(F.lit("00" * ENTRY), entry(F.col("root_at")), entry(F.col("top_at"))))).alias("data")),
        ranges(rows).select("session_id", (F.col("entries_at") + (F.col("objects_before") + 3) * ENTRY).alias("at"), F.unhex(F.array_join(F.transform("offsets", entry), "")).alias("data")),
        ranges(nodes.where("number > 2")).select("session_id", (F.col("entries_at") + F.col("number") * ENTRY).alias("at"), F.unhex(entry(F.col("at"))).alias("data")),
        last.select("session_id", F.col("tail_at").alias("at"), F.concat(F.unhex(entry(F.col("x_at"))), binary(F.col("tail"))).alias("data")),
    ]
    each = rows.select("session_id", "objects_before", F.posexplode(F.arrays_zip("offsets", "sizes")).alias("k", "o"))
    objects = [
        each.select("session_id", (F.col("objects_before") + F.col("k") + 3).alias("number"), F.col("o.offsets").alias("at"), F.col("o.sizes").alias("length")),
        nodes.select("session_id", "number", "at", "length"),
        last.select("session_id", F.lit(1).cast("long").alias("number"), F.col("root_at").alias("at"), F.lit(len(root)).cast("long").alias("length")),
        last.select("session_id", (F.col("count") + 1).alias("number"), F.col("x_at").alias("at"), (F.col("tail_at") + ENTRY + len("\nendstream" + END) - F.col("x_at")).alias("length")),
    ]
    return Files(
        reduce(DataFrame.unionByName, made),
        reduce(DataFrame.unionByName, objects),
        last.select("session_id", F.col("pages_total").alias("pages"), (F.col("count") + 1).alias("objects"), (F.col("tail_at") + ENTRY + F.length("tail")).alias("size")),
        bodies.where("fault is not null").select(*KEY, "fault"),
    )


def stream_to(parts: DataFrame, session_id, out: BinaryIO) -> int:
    """Writes one session's file to an open one, part by part in order; returns its size."""
    size = 0
    for r in parts.where(F.col("session_id") == F.lit(session_id)).orderBy("at").select("data").toLocalIterator():
        size += out.write(bytes(r["data"]))
    return size


def export(pages: DataFrame, encoding: str | None = None, s: Settings = SETTINGS) -> DataFrame:
    """session_id, pages, pdf: files as values, for sessions whose file fits a row; of others take `assembled`'s parts."""

    @F.pandas_udf("binary")
    def one(parts: pd.Series) -> pd.Series:
        return parts.map(lambda rows: b"".join(bytes(r["data"]) for r in rows))

    files = assembled(pages, encoding, s)
    whole = files.parts.groupBy("session_id").agg(one(F.array_sort(F.collect_list(F.struct("at", "data")))).alias("pdf"))
    return files.sessions.select("session_id", "pages").join(whole, "session_id")
