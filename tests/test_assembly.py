"""Sessions' files in parts: every place is right, pages come in order, nothing large meets in one task."""

import io
import re

import numpy as np
from pyspark.sql import functions as F
from test_pages import text_pdf

from pageforge.kernels import pdf
from pageforge.operators import assembly, pages
from pageforge.session import shared_dir

ROWS = "session_id long, id string, `order` int, deleted boolean, passthrough boolean, pdf binary, raster struct<height:int,width:int,nChannels:int,mode:int,data:binary>"


def table(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def tiny(k, gray=False):
    page = np.full((2, 3, 3), k % 256, np.uint8)
    page[0, 0] = (k // 256 % 256, 7, 9)
    return {"height": 2, "width": 3, "nChannels": 1, "mode": 0, "data": bytes([k % 256] * 6)} if gray else pages.packed(page)


def checked_file(body):
    """The file's pages, after a look at every place that it states."""
    start = int(re.search(rb"startxref\n(\d+)\n%%EOF\n$", body)[1])
    head = re.match(rb"(\d+) 0 obj\n<< /Type /XRef /Size (\d+) /W \[1 8 0\] /Root 1 0 R /Length (\d+) >>\nstream\n", body[start:])
    own, size, length = map(int, head.groups())
    entries = body[start + head.end() : start + head.end() + length]
    assert size == own + 1 and length == 9 * size and body[start + head.end() + length :].startswith(b"\nendstream\nendobj\n") and entries[:9] == bytes(9)
    for k in range(1, size):
        assert entries[9 * k] == 1
        at = int.from_bytes(entries[9 * k + 1 : 9 * k + 9], "big")
        assert body[at:].startswith(b"%d 0 obj\n" % k)
    assert {int(m) for m in re.findall(rb"(?m)^(\d+) 0 obj$", body)} == set(range(1, size))
    file = pdf.File(body)

    def below(ref):  # /Count and /Parent of every node
        node = file.get(ref)
        if "/Kids" not in node:
            return 1
        assert all(file.get(k)["/Parent"] == ref for k in node["/Kids"])
        n = sum(map(below, node["/Kids"]))
        assert node["/Count"] == n
        return n

    assert below(pdf.Ref(2)) == len(file.pages)
    return file


def collected(files, session):
    out = io.BytesIO()
    size = assembly.stream_to(files.parts, session, out)
    stated = files.sessions.where(F.col("session_id") == session).first()
    body = out.getvalue()
    assert size == stated["size"] == len(body)
    file = checked_file(body)
    assert stated["pages"] == len(file.pages)
    for r in files.objects.where(F.col("session_id") == session).collect():
        own = body[r["at"] : r["at"] + r["length"]]
        assert own.startswith(b"%d 0 obj\n" % r["number"]) and own.endswith(b"\nendobj\n")
    return file


def test_images_and_files_in_order(spark):
    born = text_pdf("Kept as it is")
    two = pdf.joined([(f := pdf.File(born), f.pages[0], 0), (f, f.pages[0], 90)])
    rows = [
        (1, "b", 1, False, True, born, None),
        (1, "a", 2, False, False, None, tiny(300)),
        (1, "a2", 2, False, False, None, tiny(301, gray=True)),
        (1, "c", 0, False, False, None, tiny(302)),
        (1, "d", 3, True, True, born, None),
        (1, "e", 4, False, True, two, None),
        (1, "f", 5, False, True, b"%PDF-1.4 nothing", None),
        (1, "g", 6, False, False, None, None),
        (1, "h", 7, None, False, None, tiny(303)),
        (2, "x", 0, True, False, None, tiny(304)),
        (3, "y", 0, False, True, born, None),
        (4, "z", 0, False, False, None, {"height": 0, "width": 3, "nChannels": 3, "mode": 16, "data": b""}),
    ]
    for fan in (2, 256):
        files = assembly.assembled(table(spark, rows), "png", fan=fan)
        assert {r["session_id"] for r in files.sessions.collect()} == {1, 3}
        file = collected(files, 1)
        shown = [file.text(p)[:7] or file.image(p)[1, 1].tolist() for p in file.pages]
        assert shown == [[302 % 256] * 3, "Kept as", [300 % 256] * 3, [301 % 256] * 3, "Kept as", "Kept as"]
        assert [p.get("/Rotate") for p in file.pages][-2:] == [90, 180] and b"Helvetica" in b"".join(map(pdf.written, file.objects.values()))
        assert len(collected(files, 3).pages) == 1
        assert [tuple(r)[:3] for r in files.faults.collect()] == [(1, 5, "f")]
    whole = {r["session_id"]: (r["pages"], bytes(r["pdf"])) for r in assembly.export(table(spark, rows), "png").collect()}
    assert set(whole) == {1, 3} and whole[1][0] == 6 and len(checked_file(whole[1][1]).pages) == 6


def test_sizes_in_points_and_encodings(spark):
    rows = [(1, str(k), k, False, False, None, pages.packed(np.full((16 + k, 200, 3), 90, np.uint8))) for k in range(3)]
    for encoding, mark in (("jpeg", "/DCTDecode"), ("png", "/FlateDecode"), ("raw", None)):
        file = collected(assembly.assembled(table(spark, rows), encoding), 1)
        images = [x for x in file.objects.values() if isinstance(x, pdf.Stream) and x.head.get("/Subtype") == "/Image"]
        assert len(images) == 3 and {x.head.get("/Filter") for x in images} == {mark}
    assert [p["/MediaBox"] for p in file.pages] == [[0, 0, 72, 5.76], [0, 0, 72, 6.12], [0, 0, 72, 6.48]]


def test_a_long_session_is_spread(spark):
    """4,000 pages of one session among others: ranges are even, and the file is right over a deep tree."""
    n = 4000
    rows = spark.range(n + 300).select(
        F.when(F.col("id") < n, 7).otherwise(F.col("id")).alias("session_id"),
        F.col("id").cast("string").alias("id"),
        (n - F.col("id")).cast("int").alias("order"),
        F.lit(False).alias("deleted"),
        F.lit(False).alias("passthrough"),
        F.lit(None).cast("binary").alias("pdf"),
        F.struct(F.lit(1).alias("height"), F.lit(2).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), F.unhex(F.lpad(F.hex(F.col("id")), 4, "0")).alias("data")).alias("raster"),
    )
    where = shared_dir(spark)
    files = assembly.assembled(rows, "raw", fan=5, where=where)
    file = collected(files, 7)
    assert [file.image(p)[0, :, 0].tobytes() for p in file.pages] == [(n - 1 - k).to_bytes(2, "big") for k in range(n)]
    for name in ("ranges", "nodes"):
        sizes = [r["count"] for r in spark.read.parquet(f"{where}/{name}").groupBy("part").count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / len(sizes)
    assert files.sessions.count() == 301


def test_no_pages(spark):
    files = assembly.assembled(table(spark, [(1, "a", 0, True, False, None, tiny(1))]))
    assert files.parts.count() == files.sessions.count() == files.faults.count() == 0
