"""Sessions of activity separated by inactivity (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.chunks import HOUR_US, local_runs, stitched
from chronoloom.spark_tools import end_or_start, latest_records, micros, small_join


def activity_sessions(rows: DataFrame, key: str, gap_us: int = 300_000_000, chunk_us: int = 12 * HOUR_US) -> DataFrame:
    """Sessions of each `key`: columns key, session_id, start_us, end_us, duration_us, n_events.

    `rows` has `key`, `s`, `e` in microseconds; other columns are ignored, whatever their names.
    A row starts a new session if it starts more than `gap_us` after the latest end so far; touching the limit exactly does not.
    Method: each (key, time chunk) builds its local sessions, then adjacent partial sessions are merged where the gap at their
    border is within the limit. A busy key is spread over its chunks; only one summary per (key, chunk) meets in a task.

    Rows without a start are left out; an end that is null or before the start counts as the start; a null key is a key of its own;
    equal rows and ties count as separate events of one session; an empty table gives an empty result.
    """
    rows = rows.select(F.col(key), "s", F.greatest("s", F.coalesce("e", "s")).alias("e")).where(F.col("s").isNotNull())
    parts = stitched(local_runs(rows, [key], gap_us, chunk_us, [F.count(F.lit(1)).alias("_n")]), [key], gap_us)
    out = parts.groupBy(key, "_run").agg(F.max("_e").alias("end_us"), F.sum("_n").alias("n_events"))
    return out.select(
        key,
        F.concat_ws("@", F.col(key), F.col("_run").cast("string")).alias("session_id"),
        F.col("_run").alias("start_us"),
        "end_us",
        (F.col("end_us") - F.col("_run")).alias("duration_us"),
        "n_events",
    )


def host_sessions(activity: DataFrame, buckets: DataFrame, gap_us: int = 300_000_000) -> DataFrame:
    """Sessions of each host over all its buckets from counted records of kinds other than afk (a missing kind is other than afk).

    Records of a bucket that is not in `buckets` have no host and are left out; an empty host name is a host name.
    """
    records = latest_records(activity, ["bucket_id", "kind", "start_ts", "end_ts"]).where(~F.col("kind").eqNullSafe("afk"))
    rows = records.select("bucket_id", micros("start_ts").alias("s"), end_or_start().alias("e"))
    hosts = buckets.where("bucket_id is not null").groupBy("bucket_id").agg(F.min("hostname").alias("hostname"))
    return activity_sessions(small_join(rows, hosts, ["bucket_id"], "inner").where("hostname is not null"), "hostname", gap_us)
