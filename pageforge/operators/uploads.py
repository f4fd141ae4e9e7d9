"""Uploads: what is accepted, as what, and which pages pass through."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageforge.config import SETTINGS, Settings
from pageforge.functions import python_strip

# Signatures of the accepted formats.
PDF = b"%PDF-"
JPEG = b"\xff\xd8\xff"
PNG = b"\x89PNG\r\n\x1a\n"
HEIF = (b"ftypheic", b"ftypheix", b"ftypmif1", b"ftypheim", b"ftyphevc")
END_OF_PDF = b"%%EOF"


def kind_of(content: Column, mime: Column, s: Settings = SETTINGS) -> Column:
    """image, pdf or null: by the first bytes, else by a declared type that is allowed."""
    starts = lambda mark: F.substring(content, 1, len(mark)) == F.lit(mark)
    brand = reduce(or_, [F.substring(content, 5, 8) == F.lit(mark) for mark in HEIF])
    magic = F.when(starts(PDF), "pdf").when(starts(JPEG) | starts(PNG) | brand, "image")
    declared = F.when(mime == "application/pdf", "pdf").when(mime.isin(*s.upload.mimes), "image")
    return F.coalesce(magic, declared)


def has_pdf_end(content: Column) -> Column:
    return F.coalesce(F.position(F.lit(END_OF_PDF), content) > 0, F.lit(False))


def validate(uploads: DataFrame, s: Settings = SETTINGS, width: str | None = None, height: str | None = None) -> DataFrame:
    """Adds kind and reject_reason (null when accepted); the first check that fails names the reason.

    Reads length before content, so that a scan can skip the bytes of files that are empty or too long.  Image sizes
    are judged where the columns `width` and `height`, from `sources.images.header_sizes`, are given.
    """
    length = F.col("length")
    kind = F.when((length > 0) & (length <= s.upload.max_bytes), kind_of(F.col("content"), F.col("mime"), s))
    out = uploads.withColumn("kind", kind)
    reason = F.when(length == 0, "empty file").when(length > s.upload.max_bytes, "file too large").when(F.col("kind").isNull(), "unsupported file type")
    reason = reason.when((F.col("kind") == "pdf") & ~has_pdf_end(F.col("content")), "malformed PDF")
    if width and height:
        image = F.col("kind") == "image"
        reason = reason.when(image & (F.col(width).isNull() | F.col(height).isNull()), "unreadable image")
        reason = reason.when(image & (F.col(width).cast("long") * F.col(height) > s.upload.max_pixels), "image exceeds pixel limit")
    return out.withColumn("reject_reason", reason)


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reject_reason").isNull())


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reject_reason").isNotNull())


def is_born_digital(text: Column, s: Settings = SETTINGS) -> Column:
    """Whether a PDF page has enough text to pass through as it is."""
    return F.coalesce(F.char_length(python_strip(text)) >= s.ingest.born_digital_chars, F.lit(False))


def numbered(pages: DataFrame) -> DataFrame:
    """A running `order` over all pages of all files of a session, from upload and page numbers."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("session_id").orderBy("upload", "page"))
    return pages.withColumn("order", (place - 1).cast("int"))
