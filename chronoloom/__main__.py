"""python -m chronoloom FOLDER --host HOST --day DAY: a day's sessions, episodes, report, diagnostics or summary, from tables in a folder or from a server."""

from __future__ import annotations

import argparse
import datetime
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom import sinks
from chronoloom.operators import intervals, records, reports
from chronoloom.plans import collect, digest, requests
from chronoloom.schema import KIND_OF_TYPE
from chronoloom.sources import watchers
from chronoloom.sources.watchers import WatcherSourceError, read_table
from chronoloom.spark_tools import ship


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronoloom", description=__doc__)
    p.add_argument("folder", nargs="?", help="folder of activity_records and watch_buckets, or with --raw-events of raw_events and watch_buckets")
    p.add_argument("--server", help="address of a watcher server in place of a folder")
    p.add_argument("--host", required=True)
    p.add_argument("--day", required=True, type=datetime.date.fromisoformat)
    p.add_argument("--what", choices=["sessions", "episodes", "report", "diagnostics", "summary"], default="episodes")
    p.add_argument("--format", choices=["markdown", "json"], default="markdown")
    p.add_argument("--zone", default="UTC")
    p.add_argument("--raw-events", action="store_true")
    p.add_argument("--details", action="store_true")
    p.add_argument("--raw", action="store_true")
    p.add_argument("--model", help="for a summary: MODULE:FUNCTION, a function that answers a request")
    p.add_argument("--failure-output", help="for a summary: where the record of a failure goes")
    p.add_argument("--shared", help="folder that all executors share, for intermediate tables")
    p.add_argument("--output")
    return p


def check_modes(p: argparse.ArgumentParser, args: argparse.Namespace) -> None:
    """Ends with a message, exit code 2, where options don't go together."""
    wrong = [
        (bool(args.folder) == bool(args.server), "give either a folder or a server"),
        (args.what == "report" and args.format == "json", "a report is Markdown only"),
        (args.what in ("report", "diagnostics") and (args.details or args.raw), "details and raw are of sessions, episodes and summaries"),
        ((args.what == "summary") != bool(args.model), "a summary needs a model, and nothing else does"),
        (bool(args.failure_output) and args.what != "summary", "only a summary has a record of failure"),
        (args.what == "summary" and args.raw, "a summary has no raw form"),
    ]
    for is_wrong, message in wrong:
        if is_wrong:
            p.error(message)


def day_of(spark: SparkSession, args: argparse.Namespace) -> collect.Days:
    """The asked day of the asked host; raises WatcherSourceError if the input can't be read."""
    windows = records.day_windows(spark.createDataFrame([(args.host, args.day, args.zone)], "hostname string, day date, timezone_name string"))
    mine = (F.col("hostname") == args.host) & (F.col("day") == F.lit(args.day))
    if args.server or args.raw_events:
        if args.server:
            start, end = (datetime.datetime.fromtimestamp(us / 1e6, datetime.timezone.utc).isoformat() for us in windows.select("start_us", "end_us").first())
            raw, buckets = watchers.buckets_and_events(watchers.read_server(spark, args.server, list(KIND_OF_TYPE), start, end))
        else:
            raw, buckets = read_table(spark, args.folder, "raw_events"), read_table(spark, args.folder, "watch_buckets")
        zones = windows.select("hostname", F.col("day").alias("local_day"), "timezone_name")
        mine_only = buckets.where(F.col("hostname") == args.host)
        return collect.collected_raw(raw.join(mine_only.select("bucket_id"), "bucket_id", "left_semi"), mine_only, windows, zones)
    # Days beside the asked one take what lies outside of its window.
    beside = [(args.host, args.day + datetime.timedelta(n), args.zone) for n in (-1, 0, 1)]
    windows = records.day_windows(spark.createDataFrame(beside, "hostname string, day date, timezone_name string"))
    buckets = read_table(spark, args.folder, "watch_buckets").where(F.col("hostname") == args.host)
    found = records.day_records(read_table(spark, args.folder, "activity_records"), buckets, windows).where(mine)
    return collect.collected(found, buckets=buckets if "bucket_type" in buckets.columns else None)


def summary(spark: SparkSession, args: argparse.Namespace, day: collect.Days) -> tuple[DataFrame | None, dict | None]:
    """(document of the digest, None), or (None, failure)."""
    module, _, name = args.model.partition(":")
    ask = getattr(importlib.import_module(module), name)
    episodes = day.episodes()
    plan = requests.request_plan(episodes).orderBy("chunk").collect()  # one day's bounded requests
    tell = lambda label, seconds: print(f"chronoloom: {label}, {seconds:.1f} s", file=sys.stderr)
    asked = [{"episode_ids": list(r.episode_ids), "payload": r.payload} for r in plan]
    made = digest.summarised_or_not(asked, ask, ask, args.model, name, tell)
    if made.digest is None:
        return None, made.failure
    streams, rest = digest.digest_rows(spark, made.digest, args.host, args.day)
    if args.format == "json":
        source = {"provider": args.model, "model": name, "requests": made.exchanges} | made.tokens
        return sinks.digest_json(streams, rest, episodes, source, args.zone, args.details), None
    return sinks.digest_markdown(streams, rest, episodes, args.model, name, args.zone, args.details), None


def document(args: argparse.Namespace, day: collect.Days) -> DataFrame:
    if args.what == "report":
        return sinks.report_markdown(intervals.merged_adjacent(day.active), reports.report_heads(day.active), reports.app_totals(day.active), args.zone)
    items, what = (day.sessions, "session") if args.what == "sessions" else (day.episodes(), "episode")
    if args.format == "json":
        return sinks.bundle_json(items, what, args.zone, args.details, sessions=day.sessions if args.raw and what == "episode" else None)
    return sinks.bundle_markdown(items, what, args.zone, args.details, args.raw)


def emit(args: argparse.Namespace, text: str) -> None:
    if args.output:
        sinks.write_whole(args.output, text)
        print("Done!", file=sys.stderr)
    else:
        print(text, end="")


def main(argv: list[str] | None = None) -> int:
    """0: written; 1: the input can't be read or holds nothing of that day; 2: the summary failed, and the day's episodes are written in its place."""
    p = parser()
    args = p.parse_args(argv)
    check_modes(p, args)
    builder = SparkSession.builder.appName("chronoloom").config("spark.sql.session.timeZone", "UTC")
    spark = ship((builder.config("spark.checkpoint.dir", args.shared) if args.shared else builder).getOrCreate())
    try:
        day = day_of(spark, args)
        if args.what == "diagnostics":
            counts = day.diagnostics.select("code", "n")
            emit(args, sinks.diagnostics_json(counts, str(args.day), args.zone) if args.format == "json" else sinks.diagnostics_text(counts))
            return 0
        code, out, failure = 0, None, None
        if day.sessions.limit(1).count():
            if args.what == "summary":
                out, failure = summary(spark, args, day)
                code, args.what = (2, "episodes") if failure else (0, args.what)
            rows = (document(args, day) if out is None else out).collect()  # one document
    except WatcherSourceError as e:
        print(f"chronoloom: {e}", file=sys.stderr)
        return 1
    if not day.sessions.limit(1).count() or not rows:
        print("chronoloom: no activity of that host and day", file=sys.stderr)
        return 1
    if failure:
        print(f"chronoloom: {digest.failure_text(failure)}", file=sys.stderr)
        if args.failure_output:
            sinks.write_whole(args.failure_output, sinks.stable_json(failure))
    emit(args, rows[0][-1])
    return code


if __name__ == "__main__":
    sys.exit(main())
