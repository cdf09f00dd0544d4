"""Overlapping observations fused into slices: one foreground window at a time, with the contexts that belong to it."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.intervals import elementary, overlapping
from chronoloom.schema import STREAM

# Parts of application names by family.
BROWSERS = ["edge", "chrome", "firefox", "brave", "opera", "safari"]
EDITORS = ["code", "codium", "pycharm", "idea", "sublime", "zed"]
CONTEXT = ["evidence_id", "kind", "title", "project", "file", "url_host", "url_path", "language"]


def numbered(records: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """Adds evidence_id, numbered by (start, bucket, event) in each key; ids of more than four digits sort as text, as ids do everywhere."""
    w = Window.partitionBy(*keys).orderBy("start_us", "bucket_id", "event_id", "end_us")
    return records.withColumn("evidence_id", F.format_string("evidence-%04d", F.row_number().over(w)))


def app_in(app: str, family: list[str]) -> Column:
    return F.coalesce(F.lower(app).rlike("|".join(family)), F.lit(False))


def fused_pieces(observations: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """One row per elementary piece that anything covers: focused, app, title, contexts, evidence_ids, windows (how many cover it).

    The foreground is the covering window of the least evidence_id, as text. Its contexts are the browser records of a browser and the editor
    records of an editor; a piece without a window has all covering contexts and is not focused. One overlap join and one aggregation.
    """
    pieces = overlapping(elementary(observations, keys), observations, keys)
    is_window = F.col("kind") == "current-window"
    found = pieces.groupBy(*keys, "start_us", "end_us").agg(
        F.min(F.when(is_window, F.struct("evidence_id", "app", "title"))).alias("_w"),
        F.count(F.when(is_window, 1)).alias("windows"),
        F.array_sort(F.collect_list(F.when(~is_window, F.struct(*CONTEXT)))).alias("_c"),
    )
    browser, editor = app_in("_w.app", BROWSERS), app_in("_w.app", EDITORS)
    mine = F.filter("_c", lambda c: ((c["kind"] == "browser") & browser) | ((c["kind"] == "editor") & editor))
    found = found.withColumn("focused", F.col("_w").isNotNull()).withColumn("contexts", F.when(F.col("focused"), mine).otherwise(F.col("_c")))
    ids = F.transform("contexts", lambda c: c["evidence_id"])
    ids = F.when(F.col("focused"), F.array_sort(F.array_distinct(F.concat(F.array("_w.evidence_id"), ids)))).otherwise(ids)
    return found.select(*keys, "start_us", "end_us", "focused", F.col("_w.app").alias("app"), F.col("_w.title").alias("title"), "contexts", ids.alias("evidence_ids"), "windows")


def window_conflicts(pieces: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """How many elementary pieces of each key have more than one covering window, before pieces are merged."""
    return pieces.where("windows > 1").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def conflicts_and_changes(rows: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """One row: conflicts, the sum of window_conflicts(fused_pieces(rows)), and changes, their sum. Rows have positive durations.

    How many windows cover a piece is a running sum over the distinct end points of its key, so that no pieces or texts are made.
    """
    window = (F.col("kind") == "current-window").cast("int")
    ends = F.array(*[F.struct(F.col(at).alias("at"), step.alias("step"), changes.alias("changes")) for at, step, changes in (("start_us", window, F.col("changes").cast("long")), ("end_us", -window, F.lit(None).cast("long")))])
    points = rows.select(*keys, F.explode(ends).alias("p")).groupBy(*keys, F.col("p.at").alias("at")).agg(F.sum("p.step").alias("step"), F.sum("p.changes").alias("changes"))
    points = points.withColumn("windows", F.sum("step").over(Window.partitionBy(*keys).orderBy("at")))
    placed = [F.col(k).isNotNull() for k in keys]  # pieces are joined by their keys
    return points.agg(F.count_if(functools.reduce(Column.__and__, placed, F.col("windows") > 1)).alias("conflicts"), F.sum("changes").alias("changes"))


def merged_slices(pieces: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """Touching pieces that are alike in focus, app, title and contexts, as one slice with the union of their evidence."""
    w = Window.partitionBy(*keys).orderBy("start_us")
    same = F.struct("focused", "app", "title", "contexts")
    rows = pieces.withColumn("_v", same).withColumn("_new", F.when((F.lag("end_us").over(w) == F.col("start_us")) & F.lag("_v").over(w).eqNullSafe(F.col("_v")), 0).otherwise(1))
    rows = rows.withColumn("_no", F.sum("_new").over(w))
    out = rows.groupBy(*keys, "_no").agg(
        F.min("start_us").alias("start_us"),
        F.max("end_us").alias("end_us"),
        F.min_by("_v", "start_us").alias("_v"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids"),
    )
    return out.select(*keys, "start_us", "end_us", "_v.focused", "_v.app", "_v.title", "_v.contexts", "evidence_ids")


def fused_slices(observations: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    return merged_slices(fused_pieces(observations, keys), keys)
