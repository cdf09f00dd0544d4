"""Outputs of a device-day: canonical JSON and Markdown, as columns, and files written whole or not at all."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.functions.formatting import clock_text, code_text, duration_text, iso_text, joined, last_part, markdown_text
from chronoloom.operators.records import diagnostic_messages
from chronoloom.schema import STREAM

PREFIX = "chronoloom"
# Names of sources, and throughout this module the headings, labels and default phrases of Markdown and the field names of JSON.
SOURCE_NAMES = {"current-window": "Current window", "editor": "Editor", "browser": "Browser"}


def stable_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n"


def _without_nulls(value: object, at: str = "") -> object:
    """Contexts lose their null fields; everything else keeps explicit nulls."""
    if isinstance(value, dict):
        return {k: _without_nulls(v, k) for k, v in value.items() if not (at == "contexts" and v is None)}
    return [_without_nulls(v, at) for v in value] if isinstance(value, list) else value


@F.pandas_udf(T.StringType())
def canonical_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([None if x is None else stable_json(_without_nulls(json.loads(x))) for x in batch], dtype=object)


def _json(body: Column) -> Column:
    return canonical_json(F.to_json(body, {"ignoreNullFields": "false"}))


#: Items whose texts a Python worker holds at a time.
ITEMS = 500


@F.arrow_udf(T.StringType())
def item_json(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """canonical_json of an item, as it stands in a list of a document. A text of JSON has no line feeds, so each one is the layout's."""
    for batch in batches:
        for at in range(0, len(batch), ITEMS):
            yield pa.array([None if x is None else stable_json(_without_nulls(json.loads(x)))[:-1].replace("\n", "\n    ") for x in batch[at : at + ITEMS].to_pylist()], pa.string())


def _json_items(df: DataFrame, keys: list[str], item: Column, ident: str, name: str) -> DataFrame:
    """_listed() of the items' texts. Python gets an item at a time, since a busy day is a document of many MB."""
    rows = df.select(*keys, "start_us", ident, "focused_seconds", F.to_json(item, {"ignoreNullFields": "false"}).alias("_j"))
    return _listed(rows.withColumn("_j", item_json("_j")), keys, F.col("_j"), ident, name)


def _seconds_json(us: Column) -> Column:
    """Whole microseconds as JSON's number of seconds, the shortest text of the double (exact below 10^15)."""
    plain = F.regexp_replace((us.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(26,6)").cast("string"), r"(\.\d+?)0+$", "$1")
    tiny = F.concat(F.regexp_replace(F.format_string("%d.%d", F.floor(us / 10), us % 10), r"^0\.|\.0$", ""), F.when(us < 10, "e-06").otherwise("e-05"))
    return F.when(us.isNull(), F.lit("null")).when((us > 0) & (us < 100), tiny).otherwise(plain)


def _context(c: Column) -> Column:
    return F.struct(c["kind"].alias("kind"), c["evidence_id"].alias("evidence_id"), c["title"].alias("title"), c["project"].alias("project"), c["file"].alias("file"), c["url_host"].alias("host"), c["url_path"].alias("path"), c["language"].alias("language"))


def _slice(s: Column) -> Column:
    return F.struct(
        iso_text(s["start_us"]).alias("start"),
        iso_text(s["end_us"]).alias("end"),
        s["focused"].alias("focused"),
        ((s["end_us"] - s["start_us"]) / 1e6).alias("duration_seconds"),
        s["app"].alias("application"),
        s["title"].alias("title"),
        F.transform(s["contexts"], _context).alias("contexts"),
        s["evidence_ids"].alias("evidence_ids"),
    )


def session_item(details: bool) -> Column:
    fields = [F.col("session_id").alias("id"), iso_text(F.col("start_us")).alias("start"), iso_text(F.col("end_us")).alias("end"), F.col("active_seconds"), F.col("focused_seconds"), F.col("label"), F.col("outcome_signals")]
    return F.struct(*fields, *([F.col("evidence_ids"), F.transform("slices", _slice).alias("slices")] if details else []))


def episode_item(details: bool) -> Column:
    signals = F.transform("outcome_signals", lambda s: F.struct(s["code"].alias("code"), s["label"].alias("label")))
    fields = [F.col("episode_id").alias("id"), iso_text(F.col("start_us")).alias("start"), iso_text(F.col("end_us")).alias("end"), F.col("active_seconds"), F.col("focused_seconds"), F.col("label"), F.col("anchors"), F.col("applications"), F.col("activity_labels"), F.size("session_ids").alias("transition_count"), signals.alias("outcome_signals")]
    return F.struct(*fields, *([F.col("session_ids"), F.col("evidence_ids")] if details else []))


def _listed(df: DataFrame, keys: list[str], item: Column, ident: str, name: str) -> DataFrame:
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_us", ident, item.alias("i")))).alias("_l"), F.sum(F.rint(F.col("focused_seconds") * 1e6).cast("long")).alias("_f"))
    return rows.select(*keys, F.transform("_l", lambda x: x["i"]).alias(name), (F.col("_f") / 1e6).alias("focused_seconds"))


def bundle_json(items: DataFrame, what: str, zone: str = "UTC", details: bool = False, keys: list[str] = STREAM, sessions: DataFrame | None = None) -> DataFrame:
    """keys, json: one canonical document a day of `what` ('session' or 'episode'), sorted by start and id; with `sessions` also those, in full."""
    item = session_item(details) if what == "session" else episode_item(details)
    out, lists = _json_items(items, keys, item, f"{what}_id", f"{what}s"), [f"{what}s"]
    if sessions is not None:
        out = out.join(_json_items(sessions, keys, session_item(True), "session_id", "sessions").drop("focused_seconds"), keys, "left")
        lists.append("sessions")
    # Put together without Python, through which whole documents would pass: fixed texts, a date, a number, and the lists.
    text = lambda value: F.lit(json.dumps(value, ensure_ascii=False))
    fields = {"schema": text(f"{PREFIX}.{what}-bundle.v1"), "date": F.concat(F.lit('"'), F.col("day").cast("date").cast("string"), F.lit('"')), "timezone": text(zone), "timezone_status": text("inferred_at_query"), "focused_seconds": _seconds_json(F.rint(F.col("focused_seconds") * 1e6).cast("long"))}
    parts = {k: [F.coalesce(v, F.lit("null"))] for k, v in fields.items()}
    for x in lists:  # in one concatenation, so that a large text is copied once
        there = F.col(x).isNotNull()
        parts[x] = [F.when(there, "[\n    ").otherwise("null"), F.coalesce(F.array_join(x, ",\n    "), F.lit("")), F.when(there, "\n  ]").otherwise("")]
    lines = [p for i, (k, own) in enumerate(sorted(parts.items())) for p in (F.lit(("," if i else "{") + f'\n  "{k}": '), *own)]
    return out.select(*keys, F.concat(*lines, F.lit("\n}\n")).alias("json"))


def _times(zone: Column) -> Column:
    return F.concat(clock_text(F.col("start_us"), zone), F.lit("–"), clock_text(F.col("end_us"), zone))


def _head(zone: str, what: str) -> list[Column]:
    focused = F.when(F.col("focused_seconds").isNotNull(), duration_text(F.col("focused_seconds"))).otherwise("Unavailable")
    return [F.concat(F.lit("# Activity — "), F.col("day").cast("string")), F.lit(""), F.concat(F.lit("Timezone: "), code_text(F.lit(zone)), F.lit(" (inferred at query time)")), F.concat(F.lit("Focused activity: "), focused), F.lit(f"Summary: Deterministic activity {what}"), F.lit(""), F.lit(f"## Activity {what}"), F.lit("")]


def _lines(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "\n")


def context_label(c: Column) -> Column:
    return F.coalesce(joined(c["project"], c["file"], c["url_host"], c["url_path"], c["title"], c["language"]), c["kind"])


def _session_lines(zone: Column, details: bool, raw: bool) -> Column:
    codes = lambda ids: F.array_join(F.transform(ids, code_text), ", ")
    parts = [F.concat(F.lit("- "), _times(zone), F.lit(" — "), code_text(F.col("label")), F.lit(" ("), duration_text(F.col("active_seconds")), F.lit(")"))]
    parts.append(F.nullif(F.array_join(F.transform("outcome_signals", lambda s: F.concat(F.lit("  - Observed signal: "), markdown_text(s["label"]))), "\n"), F.lit("")))
    names = F.create_map(*[F.lit(x) for kv in SOURCE_NAMES.items() for x in kv])
    if details:
        contexts = F.array_sort(F.array_distinct(F.flatten(F.transform("slices", lambda s: F.transform(s["contexts"], lambda c: F.struct(c["kind"].alias("k"), context_label(c).alias("l")))))))
        parts += [
            F.when(F.size("evidence_ids") > 0, F.concat(F.lit("  - Evidence: "), codes("evidence_ids"))),
            F.nullif(F.array_join(F.transform(contexts, lambda c: F.concat(F.lit("  - "), names[c["k"]], F.lit(": "), c["l"])), "\n"), F.lit("")),
            F.concat(F.lit("  - Foreground duration: "), F.coalesce(duration_text(F.col("focused_seconds")), F.lit("unavailable"))),
        ]
    if raw:
        label = lambda s: F.coalesce(F.nullif(s["title"], F.lit("")), F.nullif(s["app"], F.lit("")), F.lit("Context evidence"))
        line = lambda s: F.concat(F.lit("  - "), clock_text(s["start_us"], zone), F.lit("–"), clock_text(s["end_us"], zone), F.lit(" — "), code_text(label(s)), F.lit(" ("), duration_text((s["end_us"] - s["start_us"]) / 1e6), F.when(s["focused"], F.lit(", focused)")).otherwise(", evidence only)"))
        parts.append(F.array_join(F.transform("slices", line), "\n"))
    return _lines(*parts)


def _episode_lines(zone: Column, details: bool) -> Column:
    codes = lambda ids: F.array_join(F.transform(ids, code_text), ", ")
    counted = lambda c: F.array_join(F.transform(c, lambda x: F.concat(markdown_text(x["value"]), F.lit(" ×"), x["count"].cast("string"))), ", ")
    parts = [
        F.concat(F.lit("- "), _times(zone), F.lit(" — "), code_text(F.col("label")), F.lit(" ("), duration_text(F.col("active_seconds")), F.lit(")")),
        F.when(F.size("anchors") > 0, F.concat(F.lit("  - Anchors: "), F.array_join(F.transform("anchors", lambda a: F.concat(a["kind"], F.lit(": "), markdown_text(a["value"]))), "; "))),
        F.when(F.size("applications") > 0, F.concat(F.lit("  - Tools: "), counted("applications"))),
        F.concat(F.lit("  - Activity transitions: "), F.size("session_ids").cast("string")),
        F.nullif(F.array_join(F.transform("outcome_signals", lambda s: F.concat(F.lit("  - Observed signal: "), markdown_text(s["label"]))), "\n"), F.lit("")),
    ]
    if details:
        parts += [
            F.concat(F.lit("  - Episode ID: "), code_text(F.col("episode_id"))),
            F.concat(F.lit("  - Source sessions: "), codes("session_ids")),
            F.when(F.size("activity_labels") > 0, F.concat(F.lit("  - Activity labels: "), counted("activity_labels"))),
            F.when(F.size("evidence_ids") > 0, F.concat(F.lit("  - Evidence: "), codes("evidence_ids"))),
            F.concat(F.lit("  - Foreground duration: "), F.coalesce(duration_text(F.col("focused_seconds")), F.lit("unavailable"))),
        ]
    return _lines(*parts)


def bundle_markdown(items: DataFrame, what: str, zone: str = "UTC", details: bool = False, raw: bool = False, keys: list[str] = STREAM) -> DataFrame:
    """keys, markdown: one document a day of `what` ('session' or 'episode')."""
    z = F.lit(zone)
    lines = _session_lines(z, details, raw) if what == "session" else _episode_lines(z, details)
    out = _listed(items, keys, F.struct(lines.alias("t")), f"{what}_id", "_items")
    body = F.array_join(F.transform("_items", lambda x: x["t"]), "\n")
    return out.select(*keys, F.concat(_lines(*_head(zone, f"{what}s"), body), F.lit("\n")).alias("markdown"))


def _with_activity(workstreams: DataFrame, episodes: DataFrame, item: Column, keys: list[str]) -> DataFrame:
    """Workstreams with their episodes' items in the order given and their seconds."""
    rows = episodes.select(*keys, "episode_id", "start_us", F.rint(F.col("active_seconds") * 1e6).cast("long").alias("_us"), item.alias("_i"))
    given = workstreams.select(*keys, "workstream", F.posexplode("episode_ids").alias("_at", "episode_id")).join(rows, [*keys, "episode_id"])
    made = given.groupBy(*keys, "workstream").agg(F.array_sort(F.collect_list(F.struct("_at", "start_us", "episode_id", "_i"))).alias("_a"), (F.sum("_us") / 1e6).alias("active_seconds"))
    return workstreams.join(made, [*keys, "workstream"], "left")


def digest_json(workstreams: DataFrame, unassigned: DataFrame, episodes: DataFrame, summary: dict[str, str | int | None], zone: str = "UTC", details: bool = False, keys: list[str] = STREAM) -> DataFrame:
    """keys, json: a day's workstreams with their seconds and activity, what is unassigned, and where the summary comes from."""
    item = episode_item(details)
    rows = _with_activity(workstreams, episodes, item, keys)
    one = F.struct("workstream", F.struct("label", "confidence", F.coalesce("active_seconds", F.lit(0.0)).alias("active_seconds"), "episode_ids", "topics", "outcomes", F.transform("_a", lambda a: a["_i"]).alias("activity")).alias("w"))
    days = episodes.groupBy(*keys).agg((F.sum(F.rint(F.col("focused_seconds") * 1e6).cast("long")) / 1e6).alias("focused_seconds"))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("_w"))
    rest = episodes.select(*keys, "episode_id", "start_us", item.alias("_i")).join(unassigned, [*keys, "episode_id"], "left_semi")
    rest = rest.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_us", "episode_id", "_i"))).alias("_r"))
    out = days.join(listed, keys, "left").join(rest, keys, "left")
    source = F.struct(*[F.lit(v).alias(k) for k, v in summary.items()])
    body = F.struct(F.lit(f"{PREFIX}.digest-report.v1").alias("schema"), F.col("day").cast("string").alias("date"), F.lit(zone).alias("timezone"), F.lit("inferred_at_query").alias("timezone_status"), "focused_seconds", source.alias("summary"), F.transform("_w", lambda x: x["w"]).alias("workstreams"), F.transform("_r", lambda x: x["_i"]).alias("unassigned_activity"))
    return out.select(*keys, _json(body).alias("json"))


def digest_markdown(workstreams: DataFrame, unassigned: DataFrame, episodes: DataFrame, provider: str, model: str, zone: str = "UTC", details: bool = False, keys: list[str] = STREAM) -> DataFrame:
    """keys, markdown: a table of a day's workstreams, outcomes and topics; with details also the activity behind them and what is unassigned."""
    z = F.lit(zone)
    line = F.concat(F.lit("- "), _times(z), F.lit(" — "), code_text(F.col("label")), F.lit(" ("), duration_text(F.col("active_seconds")), F.lit(")\n  - Episode ID: "), code_text(F.col("episode_id")))
    item = F.concat(line, F.lit("\n  - Activity transitions: "), F.size("session_ids").cast("string"))
    rows = _with_activity(workstreams, episodes, item, keys)
    shown = F.filter("outcomes", lambda o: o["strength"] != "none")
    outcome = F.array_join(F.transform(shown, lambda o: F.concat(F.when(o["strength"] == "likely", "Likely: ").otherwise(""), markdown_text(o["text"]))), "<br>")
    topic = F.array_join(F.transform("topics", lambda t: markdown_text(t["text"])), "<br>")
    cells = F.concat(F.lit("| **"), markdown_text(F.col("label")), F.lit("** | "), F.coalesce(F.nullif(outcome, F.lit("")), F.lit("No completion should be claimed from this trace alone.")), F.lit(" | "), F.coalesce(F.nullif(topic, F.lit("")), F.lit("No specific topics identified.")), F.lit(" |"))
    support = F.concat(F.lit("### "), markdown_text(F.col("label")), F.lit("\n\nPrimary allocation · "), F.initcap("confidence"), F.lit(" confidence · "), duration_text(F.coalesce("active_seconds", F.lit(0.0))), F.lit("\n\n"), F.coalesce(F.array_join(F.transform(F.array_sort(F.transform("_a", lambda a: F.struct(a["start_us"], a["episode_id"], a["_i"]))), lambda a: a["_i"]), "\n"), F.lit("")))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("workstream", cells.alias("c"), support.alias("s")))).alias("_w"))
    rest = episodes.select(*keys, "episode_id", "start_us", line.alias("_i")).join(unassigned, [*keys, "episode_id"], "left_semi")
    rest = rest.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_us", "episode_id", "_i"))).alias("_r"))
    days = episodes.groupBy(*keys).agg((F.sum(F.rint(F.col("focused_seconds") * 1e6).cast("long")) / 1e6).alias("focused_seconds"))
    out = days.join(listed, keys, "left").join(rest, keys, "left")
    focused = F.when(F.col("focused_seconds").isNotNull(), duration_text(F.col("focused_seconds"))).otherwise("Unavailable")
    parts = [F.concat(F.lit("# Activity — "), F.col("day").cast("string")), F.lit(""), F.concat(F.lit("Timezone: "), code_text(z), F.lit(" (inferred at query time)")), F.concat(F.lit("Focused activity: "), focused), F.concat(F.lit("Summary: workstreams by a model ("), code_text(F.lit(provider)), F.lit(" / "), code_text(F.lit(model)), F.lit(")")), F.lit(""), F.lit("## Workstreams"), F.lit(""), F.lit("| Workstream | Outcomes | Topics |\n| --- | --- | --- |"), F.coalesce(F.array_join(F.transform("_w", lambda w: w["c"]), "\n"), F.lit("| _No coherent workstreams identified._ | — | — |"))]
    if details:
        parts += [F.lit("\n## Supporting activity\n"), F.array_join(F.transform("_w", lambda w: w["s"]), "\n\n"), F.lit("\n## Unassigned activity\n"), F.coalesce(F.array_join(F.transform("_r", lambda r: r["_i"]), "\n"), F.lit("None."))]
    return out.select(*keys, F.concat(_lines(*parts), F.lit("\n")).alias("markdown"))


def report_markdown(records: DataFrame, heads: DataFrame, apps: DataFrame, zone: str = "UTC", keys: list[str] = STREAM) -> DataFrame:
    """keys, markdown: overview, timeline and applications of each day's records."""
    z, kind = F.lit(zone), F.col("kind")
    label = F.when(kind == "current-window", joined(F.col("app"), F.col("title"))).when(kind == "browser", joined(F.col("url_host"), F.col("title"))).otherwise(joined(last_part(F.col("project")), last_part(F.col("file")), F.col("language")))
    names = F.create_map(*[F.lit(x) for kv in SOURCE_NAMES.items() for x in kv])
    line = F.concat(F.lit("- "), _times(z), F.lit(" ("), duration_text((F.col("end_us") - F.col("start_us")) / 1e6), F.lit(") — "), F.coalesce(label, names[kind]))
    timeline = records.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_us", "bucket_id", "event_id", line.alias("t")))).alias("_t"))
    used = apps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("- "), markdown_text(F.col("app")), F.lit(" — "), duration_text(F.col("seconds"))).alias("t")))).alias("_a"))
    out = timeline.join(heads, keys).join(used, keys, "left")
    sources = F.array_join(F.transform(F.split("sources", ","), lambda s: names[s]), ", ")
    active = F.coalesce(duration_text(F.col("active_seconds")), F.lit("Unavailable"))
    parts = [F.concat(F.lit("# Activity summary — "), F.col("day").cast("string")), F.lit(""), F.concat(F.lit("Timezone: "), code_text(z)), F.lit(""), F.lit("## Overview"), F.lit(""), F.concat(F.lit("- Active matched time: "), active), F.concat(F.lit("- Timeline entries: "), F.col("entries").cast("string")), F.concat(F.lit("- Sources: "), sources), F.lit(""), F.lit("## Timeline"), F.lit(""), F.array_join(F.transform("_t", lambda x: x["t"]), "\n")]
    parts.append(F.when(F.size("_a") > 0, F.concat(F.lit("\n## Applications\n\n"), F.array_join(F.transform("_a", lambda x: x["t"]), "\n"))))
    return out.select(*keys, F.concat(_lines(*parts), F.lit("\n")).alias("markdown"))


def diagnostics_text(counts: DataFrame) -> str:
    """The messages of a bounded table of diagnostic counts (one row a code), in their order."""
    return "".join(f"- {m[0].upper()}{m[1:]}.\n" for (m,) in diagnostic_messages(counts).orderBy("rank").select("message").collect())


def diagnostics_json(counts: DataFrame, day: str, zone: str) -> str:
    """The same as a document."""
    rows = diagnostic_messages(counts).orderBy("rank").select("code", "n", "message").collect()
    return stable_json({"schema": f"{PREFIX}.diagnostics.v1", "date": day, "timezone": zone, "diagnostics": [{"code": r.code, "count": r.n, "message": r.message} for r in rows]})


def write_whole(path: str | Path, text: str) -> None:
    """Writes UTF-8 with line feeds to a neighbour file and puts it in place, so that readers see the old or the new text, never a part."""
    path = Path(path)
    fd, name = tempfile.mkstemp(dir=path.parent, prefix=path.name, suffix=".part")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="\n") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
