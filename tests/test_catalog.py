"""Operators that look pages up by id and session: odd keys, and what the plan deals out."""

import re
from contextlib import contextmanager

from pyspark.sql import functions as F

from pageforge.operators import catalog

NEVER = "spark.sql.autoBroadcastJoinThreshold"


@contextmanager
def tables_too_large_to_broadcast(spark):
    held = spark.conf.get(NEVER)
    spark.conf.set(NEVER, -1)
    try:
        yield
    finally:
        spark.conf.set(NEVER, held)


def dealt(df):
    """The columns of each exchange of the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sorted(re.sub(r"#\d+L?", "", c) for c in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_reorder_keeps_odd_pages(spark):
    """Null keys, an id in two sessions, a page that comes twice, several lists of a session, lists of others' pages or of none."""
    pages = spark.createDataFrame([("a", 1, 7, "x"), ("a", 2, 8, "y"), ("b", 1, 9, "z"), ("b", 1, 5, "z"), (None, 1, 3, "n"), ("c", None, 4, "n"), ("d", 3, None, "o")], "id string, session_id long, order int, name string")
    wanted = spark.createDataFrame([(1, ["b", "a", "b", None]), (1, ["a"]), (2, ["b"]), (None, ["c"]), (3, []), (3, None), (4, ["d"])], "session_id long, page_ids array<string>")
    want = [(1, "a", 1, "x"), (2, "a", 8, "y"), (1, "b", 2, "z"), (1, "b", 2, "z"), (1, None, 3, "n"), (None, "c", 4, "n"), (3, "d", None, "o")]
    got = catalog.reorder(pages, wanted)
    assert got.columns == ["session_id", "id", "order", "name"]
    assert rows(got) == sorted(want, key=repr)  # by broadcast
    with tables_too_large_to_broadcast(spark):
        assert rows(got.select("*")) == sorted(want, key=repr)


def test_reorder_leaves_pages_where_they_lie(spark):
    """Pages that lie by id are not dealt out again; only the places of lists, which lie by session, come to them."""
    pages = spark.createDataFrame([("a", 1, 0), ("b", 1, 1)], "id string, session_id long, order int").dropDuplicates(["id"])
    wanted = spark.createDataFrame([(1, "a"), (1, "b")], "session_id long, id string").groupBy("session_id").agg(F.sort_array(F.collect_list("id"), asc=False).alias("page_ids"))
    with tables_too_large_to_broadcast(spark):
        got = catalog.reorder(pages, wanted)
        assert len(dealt(got)) == 3 and "session_id, id" not in dealt(got)
        assert rows(got) == [(1, "a", 1), (1, "b", 0)]


def test_check_edits_of_odd_rows(spark):
    """Null keys and arguments, an id in two sessions, a page that comes twice, edits that come twice, pages that are gone."""
    pages = spark.createDataFrame([("a", 1, False, False), ("a", 2, True, False), ("b", 1, False, False), ("b", 1, True, False), ("c", 1, False, True), ("d", 1, None, False), ("e", 1, False, None), (None, 1, False, False), ("f", None, False, False)], "id string, session_id long, passthrough boolean, deleted boolean")
    gone, through, four, turn, mode = "page not found", "page passes through", "four corners needed", "degrees must be a multiple of 90", "unknown mode"
    square = [[0.0, 0.0]] * 4
    edits = [
        (("a", 1, "recrop", None, None, square), [None]), (("a", 1, "recrop", 45, "sepia", square[1:]), [four]), (("a", 1, "recrop", 90, None, None), [four]),
        (("a", 2, "recrop", None, None, square), [through]), (("a", 2, "rotate", 90, None, None), [None]), (("a", 3, "rotate", 90, None, None), [gone]),
        (("b", 1, "mode", None, "bw", None), [None, through]), (("b", 1, "mode", None, "sepia", None), [mode, through]), (("a", 1, "mode", None, None, None), [mode]),
        (("a", 1, "rotate", -180, None, None), [None]), (("a", 1, "rotate", 45, None, None), [turn]), (("a", 1, "rotate", 45, None, None), [turn]), (("a", 1, "rotate", None, None, None), [turn]),
        (("a", 1, None, 45, "sepia", None), [None]), (("a", 2, None, 45, "sepia", None), [None]), (("a", 2, "demoire", None, None, None), [through]), (("a", 1, "export", 1, "x", None), [None]),
        (("c", 1, "rotate", 90, None, None), [gone]), (("d", 1, "rotate", 45, None, None), [gone]), (("e", 1, "rotate", 90, None, None), [gone]), ((None, 1, "rotate", 90, None, None), [gone]), (("f", None, "rotate", 90, None, None), [gone]), (("x", 1, "recrop", 90, None, None), [gone]),
    ]
    log = spark.createDataFrame([(*e[1:2], e[0], *e[2:]) for e, _ in edits], "session_id long, page_id string, op string, degrees int, mode string, corners array<array<double>>")
    want = sorted([(*e, error) for e, errors in edits for error in errors], key=repr)
    got = catalog.check_edits(log, pages)
    assert got.columns == ["page_id", "session_id", "op", "degrees", "mode", "corners", "passthrough", "error"]
    assert rows(got.drop("passthrough")) == want  # by broadcast
    with tables_too_large_to_broadcast(spark):
        assert rows(got.drop("passthrough")) == want


def test_check_edits_leaves_rows_where_they_lie(spark):
    """Edits and pages that lie by page are not dealt out again, and the join does not carry what only an edit's own errors need."""
    pages = spark.createDataFrame([("a", 1, False, False)], "id string, session_id long, passthrough boolean, deleted boolean").dropDuplicates(["id"])
    log = spark.createDataFrame([("a", 1, "rotate", 45, None, None)], "page_id string, session_id long, op string, degrees int, mode string, corners array<array<double>>").dropDuplicates(["page_id"])
    with tables_too_large_to_broadcast(spark):
        got = catalog.check_edits(log, pages).select("op", "error")
        assert len(dealt(got)) == 2
        join = got._jdf.queryExecution().optimizedPlan()
        while join.nodeName() != "Join":
            join = join.children().head()
        assert not {"degrees", "mode", "corners"} & {*join.children().head().schema().fieldNames()}
        assert rows(got) == [("rotate", "degrees must be a multiple of 90")]


def test_page_images_of_odd_rows(spark):
    """Null keys and references, an id in two sessions, a page that comes twice, pages that are gone, rows asked for twice."""
    pages = spark.createDataFrame([("a", 1, "o1", "p1", False), ("a", 2, "o2", None, False), ("b", 1, "o3", "p3", False), ("b", 1, "o4", "p4", False), ("c", 1, "o5", "p5", True), ("d", 1, "o6", "p6", None), (None, 1, "o7", "p7", False), ("e", None, "o8", "p8", False)], "id string, session_id long, original_ref string, processed_ref string, deleted boolean")
    asked = spark.createDataFrame([("a", 1, True, 1), ("a", 1, True, 1), ("a", 2, False, 2), ("a", 3, True, 3), ("b", 1, False, 4), ("b", 1, None, 5), ("c", 1, True, 6), ("d", 1, True, 7), (None, 1, True, 8), ("e", None, True, 9), ("x", 1, True, 10)], "id string, session_id long, original boolean, n long")
    want = [(1, "a", True, 1, "o1"), (1, "a", True, 1, "o1"), (2, "a", False, 2, None), (1, "b", False, 4, "p3"), (1, "b", False, 4, "p4"), (1, "b", None, 5, "p3"), (1, "b", None, 5, "p4")]
    got = catalog.page_images(pages, asked)
    assert got.columns == ["session_id", "id", "original", "n", "ref"]
    assert rows(got) == sorted(want, key=repr)  # by broadcast
    with tables_too_large_to_broadcast(spark):
        assert rows(got.select("*")) == sorted(want, key=repr)


def test_page_images_leaves_rows_where_they_lie(spark):
    """What is asked for and pages that lie by id are not dealt out again."""
    pages = spark.createDataFrame([("a", 1, "o", "p", False)], "id string, session_id long, original_ref string, processed_ref string, deleted boolean").dropDuplicates(["id"])
    asked = spark.createDataFrame([("a", 1, True), ("b", 1, True)], "id string, session_id long, original boolean").dropDuplicates(["id"])
    with tables_too_large_to_broadcast(spark):
        got = catalog.page_images(pages, asked)
        assert len(dealt(got)) == 2
        assert rows(got) == [(1, "a", True, "o")]
