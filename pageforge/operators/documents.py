"""PDF files in and out: pages of uploads, sessions' pages as one file."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pageforge.config import SETTINGS, Settings
from pageforge.kernels import pdf
from pageforge.kernels.encode import jpeg
from pageforge.operators.rasters import RASTER, packed, per_page
from pageforge.operators.uploads import is_born_digital


def page_stream(page: np.ndarray, encoding: str, quality: int, gray: bool = False) -> bytes:
    """The image object of a page, without metadata: its dictionary and its pixels, as JPEG, lossless (png) or as they are (raw)."""
    space, name = ("DeviceGray" if gray and encoding != "jpeg" else "DeviceRGB"), {"png": "/FlateDecode", "raw": ""}.get(encoding, "/DCTDecode")
    pixels = page[..., 0] if space == "DeviceGray" else page[..., ::-1]
    data = jpeg(page, quality) if name == "/DCTDecode" else zlib.compress(pixels.tobytes()) if name else pixels.tobytes()
    head = f"<< /Type /XObject /Subtype /Image /Width {page.shape[1]} /Height {page.shape[0]} /ColorSpace /{space} /BitsPerComponent 8 {f'/Filter {name} ' if name else ''}/Length {len(data)} >>"
    return head.encode() + b"\nstream\n" + data + b"\nendstream"


def write_pdf(pages: list[tuple[int, int, bytes]], dpi: int) -> bytes:
    """A PDF of (height, width, image object), each page as large as its pixels at the given resolution."""
    out, places = bytearray(b"%PDF-1.4\n"), []

    def put(body: bytes) -> int:
        places.append(len(out))
        out.extend(b"%d 0 obj\n" % len(places) + body + b"\nendobj\n")
        return len(places)

    put(b"<< /Type /Catalog /Pages 2 0 R >>")
    kids = b" ".join(b"%d 0 R" % (3 + 3 * i) for i in range(len(pages)))
    put(b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, len(pages)))
    for height, width, image in pages:
        n = len(places) + 1
        w, h = (b"%.4f" % (72 * x / dpi) for x in (width, height))
        put(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %s %s] /Contents %d 0 R /Resources << /XObject << /I %d 0 R >> >> >>" % (w, h, n + 1, n + 2))
        draw = b"q %s 0 0 %s 0 0 cm /I Do Q" % (w, h)
        put(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(draw), draw))
        put(image)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(places) + 1, start))


def streams(pages: DataFrame, encoding: str | None = None, s: Settings = SETTINGS) -> DataFrame:
    """Adds height, width and image (the PDF object) to rasters; pages without pixels get nulls."""
    kind, quality = encoding or s.output.encoding, s.output.quality
    run = lambda page, row: {"height": page.shape[0], "width": page.shape[1], "image": page_stream(page, kind, quality, row["raster"]["nChannels"] == 1)}
    return per_page(pages, run, "height int, width int, image binary")


def image_pdfs(pages: DataFrame, encoding: str | None = None, s: Settings = SETTINGS) -> DataFrame:
    """Adds pdf: each page as a file of its own."""
    dpi, kind, quality = s.output.dpi, encoding or s.output.encoding, s.output.quality
    return per_page(pages, lambda page, _: {"pdf": write_pdf([(*page.shape[:2], page_stream(page, kind, quality))], dpi)}, "pdf binary")


def split_pdfs(uploads: DataFrame, content: str = "content", s: Settings = SETTINGS) -> DataFrame:
    """One row for each page of PDF uploads: all other columns, page (from 0), item_type, pdf, raster, error.

    Pages with enough text are born digital: item_type pdf_page, the page as a file of its own.  The others are images:
    a raster where the page is one lossless picture; other scans need a rasterizer, which is not here, so they come with
    the page's file and an error.  Files that cannot be read, or have more pages than the limit, give one row with an
    error.
    """
    kept = [f for f in uploads.schema.fields if f.name != content]
    new = T._parse_datatype_string(f"page int, text string, pdf binary, {RASTER}, error string")
    arrow, most = to_arrow_schema(new), s.upload.max_pages

    def items(data: bytes | None) -> list[dict]:
        try:
            file = pdf.File(data or b"")
            if len(file.pages) > most:
                raise ValueError(f"PDF has more than {most} pages")
            out = []
            for k, page in enumerate(file.pages):
                text, image = file.text(page), file.image(page)
                out.append({"page": k, "text": text, "pdf": pdf.joined([(file, page, 0)]), "raster": None if image is None else packed(image)})
            return out
        except (ValueError, KeyError, IndexError, TypeError, AttributeError, zlib.error) as fault:
            return [{"error": f"unreadable PDF: {fault}" if not isinstance(fault, ValueError) else str(fault)}]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                rows = items(b.column(content)[i].as_py())
                at = pa.array([i] * len(rows))
                yield pa.RecordBatch.from_arrays([b.column(f.name).take(at) for f in kept] + [pa.array([r.get(n) for r in rows], arrow.field(n).type) for n in new.fieldNames()], [f.name for f in kept] + new.fieldNames())

    found = uploads.mapInArrow(run, T.StructType([*kept, *new.fields]))
    born = is_born_digital(F.col("text"), s)
    kind = F.when(F.col("error").isNull(), F.when(born, "pdf_page").otherwise("image"))
    found = found.withColumns({"item_type": kind, "error": F.when(F.col("error").isNull() & ~born & F.col("raster").isNull(), "page needs a rasterizer").otherwise(F.col("error"))})
    return found.withColumn("raster", F.when(F.col("item_type") == "image", F.col("raster"))).drop("text")


def turned_pdfs(pages: DataFrame, degrees: Column) -> DataFrame:
    """The files in column pdf with every page turned clockwise by multiples of 90 degrees, bytes of the pages unchanged."""

    @F.pandas_udf("binary")
    def turn(files: pd.Series, by: pd.Series) -> pd.Series:
        def one(data, angle):
            file = pdf.File(data)
            return pdf.joined([(file, page, int(angle)) for page in file.pages])

        return pd.Series([None if f is None else one(f, a) for f, a in zip(files, by)])

    return pages.withColumn("pdf", turn(F.col("pdf"), degrees))
