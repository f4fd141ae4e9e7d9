"""The page catalogue: sessions, pages, edits, exports.

Edits are an append-only log that is folded to the state of each page; nothing is changed in place.
"""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from pageforge.config import SETTINGS, Settings

MODES = ("color", "gray", "bw")


def page_state(log: DataFrame) -> DataFrame:
    """page_id, corners, rotation, mode, demoire, deleted, n_exports, n_edits from edits (page_id, at, seq, op, degrees, mode, on, corners).

    recrop sets the corners and turns the page back to 0; rotate adds its degrees; mode and demoire keep the last
    value; delete is final.  Edits that `check_edits` finds fault with must be gone.  Two aggregates, the second over the
    turns alone: a page's history never has to fit one task's memory.
    """
    key = F.struct("at", "seq")
    of = lambda op, c: F.max_by(F.when(F.col("op") == op, F.col(c)), F.when(F.col("op") == op, key))
    folded = log.groupBy("page_id").agg(
        F.max(F.when(F.col("op") == "recrop", key)).alias("cropped"),
        of("recrop", "corners").alias("corners"),
        F.coalesce(of("mode", "mode"), F.lit("color")).alias("mode"),
        of("demoire", "on").alias("demoire"),
        F.bool_or(F.col("op") == "delete").alias("deleted"),
        F.count_if(F.col("op") == "export").alias("n_exports"),
        F.count("*").alias("n_edits"),
    )
    turns = log.where("op = 'rotate'").select("page_id", key.alias("key"), "degrees").join(folded.select("page_id", "cropped"), "page_id")
    turns = turns.where(F.col("cropped").isNull() | (F.col("key") > F.col("cropped"))).groupBy("page_id").agg(F.sum("degrees").alias("degrees"))
    out = folded.drop("cropped").join(turns, "page_id", "left")
    return out.withColumn("rotation", F.pmod(F.coalesce("degrees", F.lit(0)), F.lit(360)).cast("int")).drop("degrees")


def _by_page(rows: DataFrame, held: DataFrame, on: list[str], how: str) -> DataFrame:
    """rows.join(held, on, how), where `on` names a page's id and its session_id.

    An id is one page's, so rows meet by it alone, and the session is checked on what was found: rows that already lie by
    id stay where they are.  isin keeps the check from being a join key: for two keys, Spark deals both sides out anew.
    Should sessions share an id, results are the same, but each of its rows is compared with all others of that id.
    """
    (page,) = set(on) - {"session_id"}
    held = held.withColumnsRenamed({page: "held_page", "session_id": "held_session"})
    same = (F.col(page) == F.col("held_page")) & F.col("session_id").isin(F.col("held_session"))
    found = rows.join(held, same, how).drop("held_page", "held_session")
    return found.select(*on, *[c for c in found.columns if c not in on])


def check_edits(log: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds error to edits (session_id, page_id, op, degrees, mode, corners): why it cannot be applied, else null."""
    own = F.when((F.col("op") == "recrop") & (F.coalesce(F.size("corners"), F.lit(0)) != 4), "four corners needed")
    own = own.when((F.col("op") == "rotate") & (F.coalesce(F.col("degrees") % 90, F.lit(1)) != 0), "degrees must be a multiple of 90")
    own = own.when((F.col("op") == "mode") & ~F.coalesce(F.col("mode").isin(*MODES), F.lit(False)), "unknown mode")
    known = pages.where(~F.col("deleted")).select(F.col("id").alias("page_id"), "session_id", "passthrough")
    out = _by_page(log.withColumn("own_error", own), known, ["page_id", "session_id"], "left")  # before the join, which then need not carry its columns
    error = F.when(F.col("passthrough").isNull(), "page not found")
    error = error.when(F.col("passthrough") & F.col("op").isin("recrop", "mode", "demoire"), "page passes through")
    return out.withColumn("error", error.otherwise(F.col("own_error"))).drop("own_error")


def to_recompute(before: DataFrame, after: DataFrame, by: tuple[str, ...] = ("corners", "rotation", "mode", "demoire")) -> DataFrame:
    """The pages whose folded state changed; only their pixels are computed again."""
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("page_id", *by)]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return after.alias("a").join(before.alias("b"), condition, "left_anti")


def ordered_pages(pages: DataFrame) -> DataFrame:
    """Live pages in order, with place, their number in the session from 1 on; ties by id."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("order", "id"))
    return pages.where(~F.col("deleted")).withColumn("place", place).orderBy("session_id", "place")


def reorder(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """New orders from (session_id, page_ids): the place in the list; pages that it lacks keep theirs; of doubles the last counts."""
    place = wanted.select("session_id", F.posexplode("page_ids").alias("pos", "id")).groupBy("session_id", "id").agg(F.max("pos").alias("pos"))
    return _by_page(pages, place, ["session_id", "id"], "left").withColumn("order", F.coalesce("pos", "order").cast("int")).drop("pos")


def page_view(pages: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """What a client sees of a page."""
    url = F.concat(F.lit("/api/scans/"), F.col("session_id").cast("string"), F.lit("/pages/"), F.col("id"), F.lit("/preview"))
    return pages.withColumns({"low_confidence": F.col("confidence") < s.output.low_confidence, "preview": url})


def scans(sessions: DataFrame, pages: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Each session with its live pages in order; sessions without pages stay."""
    seen = page_view(pages.where(~F.col("deleted")), s)
    item = F.struct("order", "id", "confidence", "low_confidence", "passthrough", "preview")
    nested = seen.groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias("pages"))
    return sessions.join(nested, "session_id", "left").withColumn("pages", F.coalesce("pages", F.array().cast(nested.schema["pages"].dataType)))


def page_images(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (session_id, id, original) with ref, the reference of the image; pages that are not live or not of that session are not found."""
    live = pages.where(~F.col("deleted")).select("session_id", "id", "original_ref", "processed_ref")
    return _by_page(asked, live, ["session_id", "id"], "inner").withColumn("ref", F.when(F.col("original"), F.col("original_ref")).otherwise(F.col("processed_ref"))).drop("original_ref", "processed_ref")


def export_metrics(pages: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """session_id, pages, mean_confidence, low_pages of sessions with live pages; the others cannot be exported.

    Confidence in hundredths is added up as integers, so the mean does not depend on the order of rows.
    """
    live = pages.where(~F.col("deleted"))
    mean = F.sum("confidence_pct") / (F.lit(100.0) * F.count("*"))
    low = F.count_if(F.col("confidence_pct") < round(100 * s.output.low_confidence))
    return live.groupBy("session_id").agg(F.count("*").alias("pages"), F.bround(mean, 3).alias("mean_confidence"), low.alias("low_pages"))


def latest_pdf(pdfs: DataFrame) -> DataFrame:
    """Each session's last PDF: session_id, ref, created_at; ties by id."""
    return pdfs.groupBy("session_id").agg(F.max_by(F.struct("ref", "created_at"), F.struct("created_at", "id")).alias("p")).select("session_id", "p.*")


def create_pages(session: DataFrame, results: DataFrame, passthrough: DataFrame) -> DataFrame:
    """Rows of the page table from processed pages and from pages that pass through."""
    born = passthrough.select(
        "id", "session_id", "order", F.lit(None).cast("string").alias("processed_ref"), F.lit(True).alias("passthrough"), F.lit(1.0).alias("confidence"),
        F.array(F.lit("born_digital")).alias("gate_flags"), F.array(F.lit("passthrough")).alias("ops"),
    )
    made = results.select("id", "session_id", "order", "processed_ref", F.lit(False).alias("passthrough"), "confidence", F.col("flags").alias("gate_flags"), F.array(F.lit("auto")).alias("ops"))
    rows = made.unionByName(born).withColumns({"rotation": F.lit(0), "mode": F.lit("color"), "demoire": F.lit(None).cast("boolean"), "deleted": F.lit(False)})
    return rows.join(session.select("session_id"), "session_id", "left_semi")


def orphans(pages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Pages of sessions that do not exist; empty in a sound catalogue."""
    return pages.join(sessions.select("session_id"), "session_id", "left_anti")


def handoff(exports: DataFrame, pages: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """What another system gets of exported sessions (session_id, ref): the file's reference and its metrics."""
    return exports.select("session_id", "ref").join(export_metrics(pages, s).drop("low_pages"), "session_id")


def low_confidence_count(pages: DataFrame, by: list[str], s: Settings = SETTINGS) -> DataFrame:
    """Live pages, and those below the threshold, by some columns."""
    low = F.count_if(F.col("confidence_pct") < round(100 * s.output.low_confidence))
    return pages.where(~F.col("deleted")).groupBy(*by).agg(low.alias("low"), F.count("*").alias("pages"))


def audit(actor: Column, action: str, target: Column, detail: Column) -> list[Column]:
    """Columns of an audit event."""
    return [F.sha2(F.concat_ws("|", actor, F.lit(action), target), 256).alias("id"), actor.alias("actor"), F.lit(action).alias("action"), target.alias("target"), detail.alias("detail"), F.current_timestamp().alias("timestamp")]


EVENTS = "id string, actor string, action string, target string, detail map<string,string>, timestamp timestamp"
_log = logging.getLogger(__name__)


def counted(rows: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The rows, and what the metrics amount to when they are written: counts come from the same pass over the data."""
    seen = Observation()
    return rows.observe(seen, *[c.alias(n) for n, c in metrics.items()]), seen


def record(spark: SparkSession, folder: str, actor: str, action: str, target: str, detail: Observation | dict) -> bool:
    """Appends an event to the table of events, with metrics of a finished write (`counted`) or other details.

    A failure is logged and otherwise ignored: it never reaches the caller, who gets False.
    """
    try:
        found = detail.get if isinstance(detail, Observation) else detail
        event = (uuid.uuid4().hex, actor, action, target, {k: str(v) for k, v in found.items()})
        row = spark.createDataFrame([event], EVENTS.rpartition(",")[0]).withColumn("timestamp", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(folder)
        return True
    except Exception as fault:
        _log.warning("event %s of %s is not recorded: %s", action, target, fault)
        return False


def events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(folder)
