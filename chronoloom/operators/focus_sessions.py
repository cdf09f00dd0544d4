"""Slices grouped into sessions by what they are about: content keys, bridges, generic screens, outcome signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.schema import STREAM

# Titles that say nothing about the work, and those of them that stand alone.
GENERIC_TITLES = ["chatgpt", "powershell", "new tab", "inbox", "slack", "outlook", "new repository", "success page", "installation options"]
ALONE = ["chatgpt", "powershell", "new tab", "inbox", "slack", "outlook"]
SUCCESS = ["success page", "checkout success"]
SESSION_GAP_US, BRIDGE_US = 300_000_000, 20_000_000


def text(c: Column) -> Column:
    """Null for empty."""
    return F.nullif(c, F.lit(""))


def basename(path: Column) -> Column:
    """Last part of a path of either system: backslashes and drives part it too if it has a backslash or colon."""
    windows = path.rlike(r"[\\:]")
    trimmed = F.when(windows, F.regexp_replace(path, r"[\\/]+$", "")).otherwise(F.regexp_replace(path, r"/+$", ""))
    return F.when(windows, F.regexp_extract(trimmed, r"([^\\/:]*)$", 1)).otherwise(F.substring_index(trimmed, "/", -1))


def specific_key(contexts: str = "contexts", title: str = "title") -> Column:
    """What a slice is about: project, path or file of its first context that has one, else its title unless that is generic; lower case."""
    keys = F.transform(contexts, lambda c: F.lower(F.coalesce(text(c["project"]), text(c["url_path"]), text(c["file"]))))
    own = F.lower(text(F.col(title)))
    return F.coalesce(F.try_element_at(F.filter(keys, lambda k: k.isNotNull()), F.lit(1)), F.when(~own.isin(GENERIC_TITLES), own))


def slice_label(contexts: str = "contexts") -> Column:
    """The first context's project name, path or title, in this order by context, else title, app or a fixed text."""
    labels = F.transform(contexts, lambda c: F.when(text(c["project"]).isNotNull(), basename(c["project"])).when(text(c["url_path"]).isNotNull(), F.btrim(c["url_path"], F.lit("/"))).otherwise(text(c["title"])))
    return F.coalesce(F.try_element_at(F.filter(labels, lambda k: k.isNotNull()), F.lit(1)), text(F.col("title")), text(F.col("app")), F.lit("Unknown activity"))


def generic_name() -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text(F.col("title")), text(F.col("app")), F.lit(""))), r"\.exe$", "")


def session_numbers(slices: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """Adds pos, key, label and session_no. A window over a device-day; shared by all its columns, so sorted once."""
    w = Window.partitionBy(*keys).orderBy("start_us", "end_us")
    rows = slices.withColumns({"_key": specific_key(), "_label": slice_label(), "_name": generic_name(), "_pos": F.row_number().over(w)})
    was = lambda c: F.lag(c).over(w)
    rows = rows.withColumn("_bridge", F.coalesce((F.col("end_us") - F.col("start_us") < BRIDGE_US) & (was("_key") == F.lead("_key").over(w)), F.lit(False)))
    known, before = text(F.col("_key")), text(was("_key"))
    new = (
        F.when(F.col("_pos") == 1, True)
        .when(F.col("_bridge") | F.coalesce(was("_bridge"), F.lit(False)), False)
        .when(F.col("start_us") - was("end_us") > SESSION_GAP_US, True)
        .when(known.isNotNull() & before.isNotNull(), known != before)
        .when(was("_name").isin(ALONE) | F.col("_name").isin(ALONE), True)
        .when(F.col("_key").isNull() & was("_key").isNull(), F.col("_name") != was("_name"))
        .otherwise(False)
    )
    rows = rows.withColumn("_new", new.cast("int"))
    return rows.withColumn("session_no", F.sum("_new").over(w))


def sessions(slices: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """Sessions with id, times, active and focused seconds (null without focus), label, nested slices, evidence and outcome signals."""
    rows = session_numbers(slices, keys)
    us = F.col("end_us") - F.col("start_us")
    item = F.struct(F.col("_pos").alias("pos"), "start_us", "end_us", "focused", "app", "title", "contexts", "evidence_ids")
    out = rows.groupBy(*keys, "session_no").agg(
        F.min("start_us").alias("start_us"),
        F.max("end_us").alias("end_us"),
        F.sum(us).alias("_active"),
        F.sum(F.when(F.col("focused"), us)).alias("_focused"),
        F.min_by("_label", F.struct(text(F.col("_key")).isNull(), "_pos")).alias("label"),
        F.array_sort(F.collect_list(item)).alias("slices"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids"),
    )
    out = out.withColumn("outcome_signals", outcome_signals())
    return out.select(
        *keys,
        F.format_string("session-%03d", "session_no").alias("session_id"),
        "session_no",
        "start_us",
        "end_us",
        (F.col("_active") / 1e6).alias("active_seconds"),
        (F.col("_focused") / 1e6).alias("focused_seconds"),
        "label",
        "slices",
        "evidence_ids",
        "outcome_signals",
    )


def outcome_signals(slices: str = "slices", evidence: str = "evidence_ids") -> Column:
    """Signals of a session in their fixed order: a named repository after a new one, a success page, an installer."""
    titles = F.transform(slices, lambda s: F.lower(F.coalesce(s["title"], F.lit(""))))
    paths = lambda s: F.filter(s["contexts"], lambda c: text(c["url_path"]).isNotNull())
    at = F.array_position(titles, "new repository").cast("int")
    n = F.size(slices)
    later = F.try_element_at(F.filter(F.slice(slices, F.least(at + 1, n), n), lambda s: F.size(paths(s)) > 0), F.lit(1))
    path = F.btrim(F.element_at(paths(later), 1)["url_path"], F.lit("/"))
    pair = F.array_sort(F.array_distinct(F.concat(F.element_at(slices, F.greatest(at, F.lit(1)))["evidence_ids"], later["evidence_ids"])))
    signal = lambda code, label, ids: F.struct(F.lit(code).alias("code"), label.alias("label"), ids.alias("evidence_ids"))
    found = F.array(
        F.when((at > 0) & (at < n) & later.isNotNull(), signal("named-repository-appeared", F.concat(F.lit("Named repository appeared: "), path), pair)),
        F.when(F.exists(titles, lambda t: t.isin(SUCCESS)), signal("checkout-success", F.lit("A checkout success state appeared"), F.col(evidence))),
        F.when(F.exists(slices, lambda s: F.lower(F.coalesce(s["app"], F.lit(""))).contains("installer")), signal("installer-started", F.lit("An installer was started"), F.col(evidence))),
    )
    return F.filter(found, lambda s: s.isNotNull())


def focused_totals(slices: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """Focused seconds of each key, null where nothing was focused."""
    return slices.groupBy(*keys).agg((F.sum(F.when(F.col("focused"), F.col("end_us") - F.col("start_us"))) / 1e6).alias("focused_seconds"))
