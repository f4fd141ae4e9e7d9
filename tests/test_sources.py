"""Files in and out, and the stream of uploads."""

import datetime
import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from pageforge.operators import assembly
from pageforge.operators.uploads import validate
from pageforge.session import BATCH
from pageforge.sources import fixtures, images
from pageforge.streaming import uploads as stream

DATA = bytes((3 * i * i + i) % 256 for i in range(5 * 4 * 3))


def test_png_round_trip_and_header(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(images.png(5, 4, DATA))
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n junk")
    got = images.rasters(spark, str(tmp_path)).collect()
    assert [bytes(r["raster"]["data"]) for r in got] == [DATA]
    again = images.encoded(images.rasters(spark, str(tmp_path)), "png").first()["file"]
    assert bytes(again) == images.png(5, 4, DATA)
    sized = images.header_sizes(images.uploads(spark, str(tmp_path)))
    judged = {r["name"]: (r["width"], r["height"], r["reject_reason"]) for r in validate(sized, width="width", height="height").collect()}
    assert judged == {"a.png": (4, 5, None), "b.png": (None, None, "unreadable image")}


def test_pdf_of_a_session(spark):
    raster = (5, 4, 3, 16, DATA)
    rows = [(1, "b", 1, False, raster), (1, "a", 0, False, raster), (1, "c", 2, True, raster), (2, "d", 0, True, raster)]
    pages = spark.createDataFrame(rows, "session_id long, id string, `order` int, deleted boolean, raster struct<height:int,width:int,nChannels:int,mode:int,data:binary>")
    pages = pages.selectExpr("*", "false as passthrough", "cast(null as binary) as pdf")
    (one,) = assembly.export(pages).collect()
    pdf = bytes(one["pdf"])
    assert one["pages"] == 2 and pdf.startswith(b"%PDF-") and pdf.endswith(b"%%EOF\n") and b"/Count 2" in pdf and b"Exif" not in pdf


def test_blobs(spark, tmp_path):
    rows = lambda *pairs: spark.createDataFrame(pairs, "key string, data binary")
    refs = images.put(rows(("k/1.png", b"x"), ("k/2.png", b"y")), str(tmp_path), "originals")
    more = images.put(rows(("k/2.png", b"z"), ("k/3.png", b"w")), str(tmp_path), "originals").union(refs)
    images.put(rows(("k/2.png", b"other bucket")), str(tmp_path), "pdfs")
    want = {"originals/k/1.png": b"x", "originals/k/2.png": b"z", "originals/k/3.png": b"w"}
    assert {r["ref"]: bytes(r["data"]) for r in images.get(spark, str(tmp_path), more).collect()} == want
    images.compact(spark, str(tmp_path), str(tmp_path / "new"))
    assert spark.read.parquet(str(tmp_path / "new")).count() == 4
    assert {r["ref"]: bytes(r["data"]) for r in images.get(spark, str(tmp_path / "new"), more).collect()} == want
    with pytest.raises(ValueError):
        images.put(rows(("a", b"")), str(tmp_path), "elsewhere")


def box(kind, body):
    return struct.pack(">I", len(body) + 8) + kind + body


def test_sizes_stand_anywhere_in_a_file(spark):
    size = lambda w, h: box(b"ispe", struct.pack(">III", 0, w, h))
    heic = box(b"ftyp", b"heic\0\0\0\0") + box(b"meta", b"\0\0\0\0" + box(b"hdlr", b"x" * 20) + box(b"iprp", box(b"ipco", size(512, 512) + box(b"hvcC", b"y") + size(4032, 3024))))
    segment = b"\xff\xe1" + struct.pack(">H", 65535) + b"x" * 65533
    jpeg = b"\xff\xd8" + segment * 3 + b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, 16, 32, 3) + b"\0" * 9
    huge = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 8000, 7501) + b"\x08\x02\0\0\0"
    fits = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 8000, 7500) + b"\x08\x02\0\0\0"
    files = [("heic", heic), ("jpeg", jpeg), ("cut", jpeg[:70000]), ("huge", huge), ("fits", fits), ("pdf", b"%PDF-1 %%EOF"), ("broken box", heic[:40])]
    sized = images.header_sizes(spark.createDataFrame([(n, None, c, len(c)) for n, c in files], "name string, mime string, content binary, length int"))
    got = {r["name"]: (r["width"], r["height"], r["reject_reason"]) for r in validate(sized, width="width", height="height").collect()}
    assert got == {
        "heic": (4032, 3024, None), "jpeg": (32, 16, None), "cut": (None, None, "unreadable image"), "huge": (8000, 7501, "image exceeds pixel limit"),
        "fits": (8000, 7500, None), "pdf": (None, None, None), "broken box": (None, None, "unreadable image"),
    }


def test_stream_of_uploads(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 12, 30)
    rows = [("s", "a", None, b"\xff\xd8\xff", at), ("s", "b", None, b"", at), ("s", "c", "application/pdf", b"%PDF-1 %%EOF", at)]
    spark.createDataFrame(rows, stream.SCHEMA).write.parquet(str(tmp_path / "in"))
    arriving = stream.arriving(spark, str(tmp_path / "in"))
    stream.store(arriving, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r["name"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "c"]
    counted = stream.per_hour(arriving).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination()
    assert [(r["accepted"], r["rejected"]) for r in spark.table("hours").collect()] == [(2, 1)]


def test_painted_batches_are_bounded():
    """Many vectors in a batch make batches of pages of a bounded size, each page once and in order."""
    b = pa.RecordBatch.from_arrays([pa.array(range(900)), pa.array([1] * 900, pa.int64()), pa.array([[0.1] * 64] * 900)], ["page_id", "label", "e"])
    out = list(fixtures._paint(iter([b, b.slice(0, 0)]), lambda i, label, e: np.zeros((64, 64, 3))))
    assert [i for o in out for i in o.column("page_id").to_pylist()] == list(range(900))
    assert len(out) > 2 and max(o.get_total_buffer_size() for o in out) < 1.1 * fixtures.HELD


def test_painting_holds_one_batch_of_pages():
    """What painting holds at most does not grow with the vectors that come at once."""
    n = 4000
    b = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([1] * n, pa.int64()), pa.array([[0.1] * 64] * n)], ["page_id", "label", "e"])
    floor, arrow, seen = pa.total_allocated_bytes(), 0, 0
    tracemalloc.start()
    for out in fixtures._paint(iter([b]), lambda i, label, e: np.zeros((64, 64, 3))):
        arrow, seen = max(arrow, pa.total_allocated_bytes() - floor), seen + out.num_rows
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n and held < 2 * fixtures.HELD and arrow < 3 * fixtures.HELD


def test_painted_pages_reach_stages_in_bounded_batches(spark, tmp_path):
    """More pages in a task than a batch may hold come to the next stage in several batches, each page once."""
    n = 16000
    spark.range(n).selectExpr("id as vec_id", "cast(id % 10 as int) as label", "transform(sequence(1, 64), i -> cast(i as float) / 64) as embedding").write.parquet(str(tmp_path / "embeddings.parquet"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"size": [b.nbytes], "pages": [b.num_rows]})

    painted = fixtures.rasters64(spark, str(tmp_path))
    tasks = painted.rdd.getNumPartitions()
    seen = painted.mapInArrow(run, "size long, pages long").collect()
    assert sum(r["pages"] for r in seen) == n and n * 64 * 64 * 3 / tasks > 1.2 * BATCH[1]
    assert max(r["size"] for r in seen) < 1.1 * BATCH[1]
