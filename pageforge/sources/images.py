"""Uploads and rasters from files."""

from __future__ import annotations

import struct
import time
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageforge.config import SETTINGS, Settings
from pageforge.kernels.encode import jpeg
from pageforge.operators.documents import split_pdfs
from pageforge.operators.rasters import RASTER, packed, per_page
from pageforge.operators.uploads import kind_of


def uploads(spark: SparkSession, folder: str, mime: Column | None = None, s: Settings = SETTINGS) -> DataFrame:
    """Files of a folder as uploads: id (a digest of the path), name, mime, length, content.

    Files that are too long are named, but their bytes are not read: the filter on length reaches the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    fit = files.where(F.col("length") <= s.upload.max_bytes)
    long = files.where(F.col("length") > s.upload.max_bytes).withColumn("content", F.lit(None).cast("binary"))
    rows = fit.select("path", "length", "content").unionByName(long.select("path", "length", "content"))
    return rows.select(F.sha2("path", 256).alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"), (mime if mime is not None else F.lit(None).cast("string")).alias("mime"), "length", "content")


def rasters(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded PNG and JPEG files as page_id and packed BGR raster, turned upright; what cannot be decoded is dropped.

    Spark's image source decodes in the JVM and leaves metadata behind, with it the turn that cameras note; the turn is
    read from the files' headers, and rasters that have one are turned.
    """
    files = spark.read.format("image").option("dropInvalid", "true").load(folder)
    i, one_form = F.col("image"), lambda path: F.regexp_replace(path, "^file:/+", "file:/")  # both sources write local paths in their own way
    pages = files.select(one_form(i["origin"]).alias("path"), F.struct(i["height"].alias("height"), i["width"].alias("width"), i["nChannels"].alias("nChannels"), i["mode"].alias("mode"), i["data"].alias("data")).alias("raster"))
    heads = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    turns = heads.select(one_form("path").alias("path"), orientation_of("content").alias("turn")).where("turn > 1")
    pages = pages.join(turns, "path", "left")
    upright = pages.where("turn is null").select("path", "raster")
    turned = per_page(pages.where("turn is not null"), lambda page, row: {"raster": packed(UPRIGHT[row["turn"]](page))}, RASTER, ("turn",)).select("path", "raster")
    return upright.unionByName(turned).select(F.sha2("path", 256).alias("page_id"), "raster")


def load(spark: SparkSession, folder: str, s: Settings = SETTINGS) -> DataFrame:
    """The pages of all images and PDFs of a folder: id (of the file), page, item_type, raster, pdf, error."""
    pictures = rasters(spark, folder).select(F.col("page_id").alias("id"), F.lit(0).alias("page"), F.lit("image").alias("item_type"), "raster", F.lit(None).cast("binary").alias("pdf"), F.lit(None).cast("string").alias("error"))
    files = uploads(spark, folder, s=s).where(kind_of(F.col("content"), F.col("mime"), s) == "pdf").select("id", "content")
    return pictures.unionByName(split_pdfs(files, s=s).select("id", "page", "item_type", "raster", "pdf", "error"))


#: What makes a page upright, by the camera's note.
UPRIGHT = {
    2: lambda p: p[:, ::-1],
    3: lambda p: p[::-1, ::-1],
    4: lambda p: p[::-1],
    5: lambda p: p.swapaxes(0, 1),
    6: lambda p: p.swapaxes(0, 1)[:, ::-1],
    7: lambda p: p.swapaxes(0, 1)[::-1, ::-1],
    8: lambda p: p.swapaxes(0, 1)[::-1],
}


def _segments(content: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, start, end) of a JPEG file's segments up to the pixels."""
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF:
        marker = content[at + 1]
        if marker == 0xFF:  # fill
            at += 1
            continue
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:  # without a body
            at += 2
            continue
        end = at + 2 + int.from_bytes(content[at + 2 : at + 4], "big")
        yield marker, at + 4, end
        if marker == 0xDA:
            return
        at = end


def _boxes(content: bytes, at: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the boxes of an ISO media file."""
    while at + 8 <= stop:
        size, kind, body = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8], at + 8
        if size == 1 and at + 16 <= stop:
            size, body = int.from_bytes(content[at + 8 : at + 16], "big"), at + 16
        end = stop if size == 0 else at + size
        if end < body or end > stop:
            return
        yield kind, body, end
        at = end


def _largest_image(content: bytes) -> tuple[int, int] | None:
    """Width and height from the boxes of image properties: the largest, as thumbnails and tiles have boxes too."""
    found = []
    for meta, a, b in _boxes(content, 0, len(content)):
        if meta == b"meta":
            for kind, c, d in _boxes(content, a + 4, b):
                if kind == b"iprp":
                    for kind, e, f in _boxes(content, c, d):
                        if kind == b"ipco":
                            found += [struct.unpack(">II", content[g + 4 : g + 12]) for kind, g, h in _boxes(content, e, f) if kind == b"ispe" and h - g >= 12]
    return max(found, key=lambda s: s[0] * s[1]) if found else None


def size_of(content: bytes | None) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, JPEG or HEIF file, wherever in the file it stands."""
    if content is None:
        return None
    if content[:8] == b"\x89PNG\r\n\x1a\n" and content[12:16] == b"IHDR" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    if content[:3] == b"\xff\xd8\xff":
        for marker, start, _ in _segments(content):
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and start + 5 <= len(content):
                return int.from_bytes(content[start + 3 : start + 5], "big"), int.from_bytes(content[start + 1 : start + 3], "big")
    if content[4:8] == b"ftyp":
        return _largest_image(content)
    return None


def turn_of(content: bytes | None) -> int:
    """The camera's note of how a JPEG is turned, 1 to 8; 1 (upright) where there is none or it is none of these."""
    if content is None or content[:3] != b"\xff\xd8\xff":
        return 1
    for marker, start, end in _segments(content):
        body = content[start:end]
        if marker == 0xE1 and body[:6] == b"Exif\0\0" and body[6:8] in (b"II", b"MM"):
            order = "little" if body[6:8] == b"II" else "big"
            number = lambda at, n: int.from_bytes(body[6 + at : 6 + at + n], order)
            first = number(4, 4)
            for k in range(number(first, 2)):
                entry = first + 2 + 12 * k
                if number(entry, 2) == 0x0112:
                    turn = number(entry + 8, 2)
                    return turn if 1 <= turn <= 8 else 1
    return 1


def orientation_of(content: str) -> Column:
    @F.pandas_udf("int")
    def read(files: pd.Series) -> pd.Series:
        return files.map(turn_of).astype("int32")

    return read(F.col(content))


def header_sizes(rows: DataFrame, content: str = "content") -> DataFrame:
    """Adds width and height, from headers alone, of what starts as an image; null where there is none.

    Headers may stand anywhere behind other segments, so whole files go to the reader, but no others than images.
    """

    @F.pandas_udf("struct<width:int,height:int>")
    def read(files: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([size_of(f) or (None, None) for f in files], columns=["width", "height"]).astype("Int32")

    is_image = F.coalesce(kind_of(F.col(content), F.lit(None).cast("string")) == "image", F.lit(False))
    sized = rows.withColumn("__size", read(F.when(is_image, F.col(content))))
    return sized.withColumns({"width": F.col("__size.width"), "height": F.col("__size.height")}).drop("__size")


def png(height: int, width: int, bgr: bytes) -> bytes:
    """A PNG file of packed BGR pixels."""
    rows = bytearray()
    for y in range(height):
        line = bgr[3 * width * y : 3 * width * (y + 1)]
        swapped = bytearray(line)
        swapped[0::3], swapped[2::3] = line[2::3], line[0::3]
        rows += b"\0" + swapped
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(rows))) + chunk(b"IEND", b"")


def encoded(pages: DataFrame, encoding: str | None = None, s: Settings = SETTINGS) -> DataFrame:
    """Adds file to rasters: PNG if asked for, else JPEG."""
    kind, quality = encoding or s.output.encoding, s.output.quality
    run = lambda page, _: {"file": png(page.shape[0], page.shape[1], page.tobytes()) if kind == "png" else jpeg(page, quality)}
    return per_page(pages, run, "file binary")


BUCKETS = ("originals", "processed", "pdfs")


def put(rows: DataFrame, root: str, bucket: str) -> DataFrame:
    """Adds key and data to a bucket of a blob store; returns key and ref.

    Of rows with one key the last put counts; rows of other keys stay.  The store only grows: a put is one append, and
    `compact` drops what was replaced.
    """
    if bucket not in BUCKETS:
        raise ValueError(f"unknown bucket {bucket}")
    rows.select("key", "data", F.lit(time.time_ns()).alias("version")).write.mode("append").parquet(f"{root}/bucket={bucket}")
    return rows.select("key", F.concat(F.lit(f"{bucket}/"), F.col("key")).alias("ref"))


def get(spark: SparkSession, root: str, refs: DataFrame) -> DataFrame:
    """ref and data of the references; only the buckets that they name are read, and only their keys are compared."""
    named = refs.select("ref", F.split("ref", "/", 2)[0].alias("bucket"), F.split("ref", "/", 2)[1].alias("key")).distinct()
    held = spark.read.schema("key string, data binary, version long, bucket string").parquet(root)
    return held.join(named, ["bucket", "key"]).groupBy("ref").agg(F.max_by("data", "version").alias("data"))


def compact(spark: SparkSession, root: str, to: str) -> None:
    """Writes the store anew under another root, each key's last data only."""
    held = spark.read.schema("key string, data binary, version long, bucket string").parquet(root)
    last = held.groupBy("bucket", "key").agg(F.max("version").alias("version"))
    held.join(last, ["bucket", "key", "version"]).dropDuplicates(["bucket", "key"]).write.partitionBy("bucket").parquet(to)
