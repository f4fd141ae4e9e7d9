"""Stored snapshots and batches written again, against whole folds and plain tables."""

import datetime
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_pages import rasters

from pageforge.kernels import color, filters
from pageforge.operators import catalog, integral, rasters as packed_rasters, snapshots
from pageforge.streaming import tables

LOG = "page_id long, at timestamp, seq long, op string, degrees int, mode string, `on` boolean, corners array<array<double>>, batch int"
STATE = ["page_id", "corners", "mode", "demoire", "deleted", "n_exports", "n_edits", "rotation"]


def history(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        at = datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rng.randrange(40))  # many at one time
        op = rng.choice(["recrop", "rotate", "rotate", "rotate", "mode", "demoire", "export", "delete"] if rng.random() < 0.9 else ["rotate"])
        rows.append((rng.randrange(12), at, seq, op, 90 * rng.randrange(-2, 6), rng.choice(["color", "gray", "bw"]), rng.random() < 0.5, [[rng.random(), 0.0]] * 4, rng.randrange(5)))
    return rows


def sorted_rows(frame):
    return sorted(map(repr, frame.select(*STATE).collect()))


def test_any_split_merges_to_the_whole_fold(spark):
    log = spark.createDataFrame(history(1), LOG)
    want = sorted_rows(catalog.page_state(log))
    assert sorted_rows(snapshots.state(snapshots.folded(log))) == want
    parts = [snapshots.folded(log.where(F.col("batch") == k)) for k in range(5)]
    for order in itertools.islice(itertools.permutations(range(5)), 0, None, 47):  # batches hold edits of all times
        held = parts[order[0]]
        for k in order[1:]:
            held = snapshots.merged(held, parts[k])
        assert sorted_rows(snapshots.state(held)) == want


def test_stored_snapshots_advance(spark, tmp_path):
    log, where, states = spark.createDataFrame(history(2), LOG), str(tmp_path / "log"), str(tmp_path / "states")
    for k in range(5):
        tables.write_batch(log.where(F.col("batch") == k).drop("batch"), k, where)
        after = snapshots.advance(spark, states, tables.read(spark, where))
        assert sorted_rows(snapshots.state(after)) == sorted_rows(catalog.page_state(log.where(F.col("batch") <= k)))
    whole = tables.read(spark, where)
    new = snapshots.since(spark, states, whole)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan and "(batch" in plan and new.count() == 0
    assert len(new.inputFiles()) <= len(whole.inputFiles())
    last = snapshots.advance(spark, states, whole)  # nothing new
    assert sorted_rows(snapshots.state(last)) == sorted_rows(catalog.page_state(log)) and snapshots._versions(spark, states) == [0, 1, 2, 3, 4]
    # a version without its last marker does not count, and is made again
    (tmp_path / "states" / "4" / "turns" / "_SUCCESS").unlink()
    assert snapshots._versions(spark, states) == [0, 1, 2, 3]
    assert sorted_rows(snapshots.state(snapshots.advance(spark, states, whole))) == sorted_rows(catalog.page_state(log))
    assert snapshots.stored(spark, str(tmp_path / "none")) is None


def test_only_new_batches_are_read(spark, tmp_path):
    log, where, states = spark.createDataFrame(history(3), LOG), str(tmp_path / "log"), str(tmp_path / "states")
    for k in range(3):
        tables.write_batch(log.where(F.col("batch") == k).drop("batch"), k, where)
    snapshots.advance(spark, states, tables.read(spark, where))
    for f in (tmp_path / "log").glob("batch=[012]/*.parquet"):
        f.write_bytes(b"not a table")  # reading it would fail
    tables.write_batch(log.where(F.col("batch") == 3).drop("batch"), 3, where)
    after = snapshots.advance(spark, states, tables.read(spark, where, LOG.removesuffix(", batch int")))
    assert sorted_rows(snapshots.state(after)) == sorted_rows(catalog.page_state(log.where(F.col("batch") <= 3)))


def test_a_batch_that_is_repeated_changes_nothing(spark, tmp_path):
    where = str(tmp_path / "table")
    rows = lambda *r: spark.createDataFrame(r, "id long, v string")
    tables.write_batch(rows((1, "a"), (2, "b")), 0, where)
    tables.write_batch(rows((2, "c"), (3, None)), 1, where)
    before = sorted(map(str, tables.read(spark, where).collect()))
    for _ in range(2):
        tables.write_batch(rows((1, "a"), (2, "b")), 0, where)
    assert sorted(map(str, tables.read(spark, where).collect())) == before and len(before) == 4
    assert {(r["id"], r["v"]) for r in tables.upserted(tables.read(spark, where), ["id"]).collect()} == {(1, "a"), (2, "c"), (3, None)}
    tables.write_batch(rows((9, "x")).where("false"), 1, where)  # an earlier attempt's rows go
    assert tables.read(spark, where).count() == 2
    with pytest.raises(ValueError, match="batch"):
        tables.write_batch(rows((1, "a")).withColumn("batch", F.lit(1)), 0, where)


def test_a_stream_that_starts_again_writes_nothing_twice(spark, tmp_path):
    source, where = tmp_path / "in", str(tmp_path / "table")
    one = lambda k: spark.createDataFrame([(k, "x")], "id long, v string").coalesce(1).write.mode("append").parquet(str(source))
    stream = lambda: spark.readStream.schema("id long, v string").option("maxFilesPerTrigger", 1).parquet(str(source))
    one(1)
    one(2)
    tables.store(stream(), where, str(tmp_path / "c")).awaitTermination()
    assert sorted((r["id"], r["batch"]) for r in tables.read(spark, where).collect()) in ([(1, 0), (2, 1)], [(1, 1), (2, 0)])
    commits = sorted((tmp_path / "c" / "commits").glob("[0-9]*"))
    commits[-1].unlink()  # the driver died after the write, before it was noted
    (tmp_path / "c" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    one(3)
    tables.store(stream(), where, str(tmp_path / "c")).awaitTermination()
    assert sorted(r["id"] for r in tables.read(spark, where).collect()) == [1, 2, 3]


@pytest.mark.parametrize("shape,window", [((30, 41), 25), ((6, 9), 25), ((1, 7), 5), ((12, 12), 3)])
def test_running_sums_give_the_kernel_s_black_and_white(spark, shape, window):
    page = np.repeat(np.random.default_rng(window).integers(0, 256, shape + (1,)), 3, 2).astype(np.uint8)
    lines = packed_rasters.gray_lines(packed_rasters.scan_lines(rasters(spark, [page, page[::-1]])))
    got = np.zeros((2, *shape), int)
    for r in integral.black_white(lines, window).collect():
        got[r["page_id"], r["y"], r["x"]] = r["white"]
    wide = np.pad(page[..., 0].astype(float), window // 2, "reflect") if min(shape) > 1 else np.pad(np.pad(page[..., 0].astype(float), ((0, 0), (window // 2,) * 2), "reflect"), (((window // 2,) * 2), (0, 0)), "edge")
    spans = np.lib.stride_tricks.sliding_window_view(wide, (window, window))
    mean, deviation = spans.mean((2, 3)), spans.std((2, 3))
    limit = mean * (1 + 0.2 * (deviation / 127.5 - 1))
    sure = abs(limit - page[..., 0]) > 1e-6
    assert ((page[..., 0] > limit) == got[0])[sure].all() and (got[0] == got[1][::-1])[sure].all()
    if window == 25 and min(shape) > 12:
        assert ((page[..., 0] > filters.sauvola(color.gray(page))) == got[0])[sure].all()
