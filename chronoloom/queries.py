"""Queries of the core: name -> callable(spark, sf_dir), and the SQL that gives the same rows."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom import sinks
from chronoloom.functions import formatting, text_safety
from chronoloom.functions.timezones import DESKTOP_ZONES
from chronoloom.operators import episodes as ep
from chronoloom.operators import focus_sessions as fs
from chronoloom.operators import fusion, intervals, records, reports
from chronoloom.operators.activity_sessions import host_sessions
from chronoloom.operators.interval_sets import bucket_periods
from chronoloom.operators.timestamps import event_instants
from chronoloom.oracle_parts import sql
from chronoloom.plans import collect, digest, requests
from chronoloom.sources import watchers
from chronoloom.schema import TEXTS
from chronoloom.spark_tools import shared_folder, written
from chronoloom.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "app_totals"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if there is any."""

    def add(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)  # dates as text, which every client compares alike
            return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})

        QUERIES[f.__name__] = run
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


P3 = """
SELECT hostname, min(s) AS start_us, max(e) AS end_us FROM (
  SELECT *, sum(CASE WHEN top IS NULL OR s > top + 300000000 THEN 1 ELSE 0 END) OVER (PARTITION BY hostname ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM (
    SELECT *, max(e) OVER (PARTITION BY hostname ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (
      SELECT b.hostname, epoch_us(a.start_ts) AS s, greatest(epoch_us(a.start_ts), coalesce(epoch_us(a.end_ts), epoch_us(a.start_ts))) AS e
      FROM counted a JOIN watch_buckets b USING (bucket_id) WHERE a.kind <> 'afk'))) GROUP BY hostname, n"""
P4 = """, p AS (
  SELECT bucket_id, min(s) AS s, max(e) AS e FROM (
    SELECT *, sum(CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END) OVER (PARTITION BY bucket_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM (
      SELECT *, max(e) OVER (PARTITION BY bucket_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
      FROM (SELECT bucket_id, epoch_us(start_ts) AS s, epoch_us(end_ts) AS e FROM counted WHERE end_ts > start_ts))) GROUP BY bucket_id, n
), q AS (SELECT *, lag(e) OVER (PARTITION BY bucket_id ORDER BY s) AS was FROM p)
SELECT bucket_id, 'period' AS piece, s AS start_us, e AS end_us FROM p
UNION ALL
SELECT bucket_id, 'gap', was, s FROM q WHERE s - was <= 21600000000"""


@query()
def p1_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_found with the component that was chosen, its posterior, whether it is ambiguous, and what the clocks did."""
    return event_instants(table(spark, sf_dir, "raw_events"), table(spark, sf_dir, "watch_buckets"), table(spark, sf_dir, "day_windows"))


@query()
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_instants(spark, sf_dir).select("event_id", "instant_us")


@query(sql(P3, "counted"))
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_sessions(table(spark, sf_dir, "activity_records"), table(spark, sf_dir, "watch_buckets")).select("hostname", "start_us", "end_us")


@query(sql(P4, "counted"))
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_periods(table(spark, sf_dir, "activity_records"))


# The pipeline of the data model: buckets and events to records, active records, observations, slices, sessions, episodes.


def _records(spark: SparkSession, sf_dir: str, texts: list[str] = TEXTS) -> DataFrame:
    return records.day_records(table(spark, sf_dir, "activity_records"), table(spark, sf_dir, "watch_buckets"), _host_windows(spark, sf_dir), texts)


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.active_records(_records(spark, sf_dir))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Read by the pieces and by what lies over them.
    return fusion.fused_pieces(written(text_safety.observations(_active(spark, sf_dir)), "observations"))


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.merged_slices(_pieces(spark, sf_dir))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fs.sessions(_slices(spark, sf_dir))


# SQL has no compatibility forms and no look-behind, so it can't make texts safe. The queries raw_... run the same operators on records as they are,
# and their SQL holds the operators; what goes out of the pipeline is made of safe texts.


def _raw_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fused_pieces(written(fusion.numbered(_active(spark, sf_dir)), "observations"))


def _raw_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.merged_slices(_raw_pieces(spark, sf_dir))


def _raw_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fs.sessions(_raw_slices(spark, sf_dir))


KIND_SQL = "CASE bucket_type WHEN 'currentwindow' THEN 'current-window' WHEN 'afkstatus' THEN 'afk' WHEN 'app.editor.activity' THEN 'editor' WHEN 'web.tab.current' THEN 'browser' END"


@query(f"SELECT bucket_id, coalesce(client, '') AS client, coalesce(hostname, '') AS hostname, {KIND_SQL} AS kind FROM watch_buckets WHERE {KIND_SQL} IS NOT NULL")
def supported_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.supported_buckets(table(spark, sf_dir, "watch_buckets")).select("bucket_id", "client", "hostname", "kind")


@query(f"SELECT coalesce(bucket_type, '') AS bucket_type, count(*) AS n FROM watch_buckets WHERE {KIND_SQL} IS NULL GROUP BY 1")
def unsupported_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.unsupported_buckets(table(spark, sf_dir, "watch_buckets"))


DESKTOP_SQL = ", ".join("('{}', '{}')".format(k.lower(), z) for k, z in DESKTOP_ZONES.items())


@query(f"""
WITH named AS (SELECT lower(name) AS k, min(name) AS zone FROM pg_timezone_names() GROUP BY 1 UNION ALL SELECT * FROM (VALUES {DESKTOP_SQL}, ('z', 'UTC')) v(k, zone) WHERE k <> 'utc'),
days AS (SELECT DISTINCT local_day AS day, timezone_name, lower(trim(timezone_name)) AS k FROM day_windows WHERE trim(timezone_name) <> '' AND local_day IS NOT NULL),
zoned AS (SELECT d.*, n.zone, CASE WHEN regexp_matches(d.k, '^[+-][0-9]{{2}}:[0-9]{{2}}$') THEN (CASE WHEN d.k[1] = '-' THEN -1 ELSE 1 END) * (CAST(d.k[2:3] AS BIGINT) * 60 + CAST(d.k[5:6] AS BIGINT)) * 60000000 END AS east
          FROM days d LEFT JOIN named n ON n.k = d.k)
SELECT CAST(day AS VARCHAR) AS day, timezone_name, s AS start_us, e AS end_us, (e - s) / 1e6 AS duration_seconds FROM (
  SELECT day, timezone_name, coalesce(epoch_us(timezone(zone, CAST(day AS TIMESTAMP))), epoch_us(CAST(day AS TIMESTAMP)) - east) AS s,
         coalesce(epoch_us(timezone(zone, CAST(day + 1 AS TIMESTAMP))), epoch_us(CAST(day + 1 AS TIMESTAMP)) - east) AS e FROM zoned)""")
def day_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "day_windows").where("trim(timezone_name) <> '' and local_day is not null").select(F.col("local_day").alias("day"), "timezone_name").distinct()
    return records.day_windows(days)


WINDOWS_SQL = "(SELECT hostname, local_day AS day, min(epoch_us(window_start)) AS start_us, max(epoch_us(window_end)) AS end_us FROM day_windows WHERE window_start IS NOT NULL GROUP BY 1, 2)"
ISO_SQL = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?"
RAW_SQL = f"""
WITH copies AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, CASE WHEN event_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY bucket_id, event_id ORDER BY received_at DESC NULLS LAST, ts_text DESC NULLS LAST, duration_seconds DESC NULLS LAST, data_json DESC NULLS LAST) END AS rn FROM raw_events) WHERE rn = 1
), raw AS (
  SELECT r.*, row_number() OVER () AS id, b.hostname, {KIND_SQL} AS kind, coalesce(regexp_matches(trim(ts_text), '{ISO_SQL}([Zz]|[+-]\\d{{2}}:\\d{{2}})$'), false) AS zoned, coalesce(regexp_matches(trim(ts_text), '{ISO_SQL}$'), false) AS naive
  FROM copies r LEFT JOIN watch_buckets b USING (bucket_id)
), timed AS MATERIALIZED (
  SELECT *, CASE WHEN zoned THEN epoch_us(try_cast(upper(replace(trim(ts_text), ' ', 'T')) AS TIMESTAMPTZ)) END AS s,
         CASE WHEN zoned THEN epoch_us(try_cast(upper(replace(trim(ts_text), ' ', 'T')) AS TIMESTAMPTZ)) + CAST(round_even(duration_seconds * 1e6, 0) AS BIGINT) END AS e
  FROM raw WHERE kind IS NOT NULL
), met AS (
  SELECT t.*, w.day, greatest(t.s, w.start_us) AS cs, least(t.e, w.end_us) AS ce
  FROM timed t JOIN {WINDOWS_SQL} w ON w.hostname = t.hostname AND t.s < w.end_us AND t.e > w.start_us WHERE t.e > t.s
)""".replace("\\\\", "\\")


def _host_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "day_windows").where("window_start is not null").groupBy("hostname", F.col("local_day").alias("day"))
    return w.agg(F.min(F.unix_micros("window_start")).alias("start_us"), F.max(F.unix_micros("window_end")).alias("end_us"))


def _normalised(spark: SparkSession, sf_dir: str, any_layout: bool = True) -> tuple[DataFrame, DataFrame]:
    zones = table(spark, sf_dir, "day_windows") if any_layout else None
    return records.normalised(table(spark, sf_dir, "raw_events"), table(spark, sf_dir, "watch_buckets"), _host_windows(spark, sf_dir), zones)


def _field_sql(key: str) -> str:
    return f"CASE WHEN json_valid(data_json) AND json_type(data_json, '$.{key}') = 'VARCHAR' THEN nullif(data_json ->> '$.{key}', '') END"


NORMALISED = ["hostname", "day", "event_id", "bucket_id", "kind", "start_us", "end_us", "app", "title", "status"]


@query()
def normalize_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalised(spark, sf_dir)[0].select(*NORMALISED)


@query()
def normalize_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every raw row; the numbers add up to the table."""
    return _normalised(spark, sf_dir)[1]


@query(RAW_SQL + f"""
SELECT hostname, CAST(day AS VARCHAR) AS day, event_id, bucket_id, kind, cs AS start_us, ce AS end_us, {_field_sql("app")} AS app, {_field_sql("title")} AS title, {_field_sql("status")} AS status
FROM met""")
def normalize_iso_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """normalize_records of ISO texts only, which SQL can read."""
    return _normalised(spark, sf_dir, any_layout=False)[0].select(*NORMALISED)


@query(RAW_SQL + """
SELECT fate, n FROM (
  SELECT CASE WHEN naive THEN 'naive-timestamp' WHEN s IS NULL THEN 'unreadable-timestamp' WHEN id IN (SELECT id FROM met) THEN 'kept' ELSE 'non-positive-event' END AS fate, count(*) AS n FROM timed GROUP BY 1
  UNION ALL SELECT 'unsupported-bucket', count(*) FROM raw WHERE kind IS NULL
  UNION ALL SELECT 'repeated-event', (SELECT count(*) FROM raw_events) - (SELECT count(*) FROM copies)) WHERE n > 0""")
def normalize_iso_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """normalize_diagnostics of ISO texts only; other layouts count as unreadable."""
    return _normalised(spark, sf_dir, any_layout=False)[1]


@query(sql("SELECT hostname, day, event_id, bucket_id, kind, start_us, end_us FROM records", "records"))
def day_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, []).select("hostname", "day", "event_id", "bucket_id", "kind", "start_us", "end_us")


@query(sql("SELECT * FROM away", "away"))
def afk_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.away_intervals(_records(spark, sf_dir, ["status"]))


@query(sql("SELECT hostname, day, event_id, bucket_id, kind, start_us, end_us, app, title, project FROM active", "active"))
def remove_afk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _active(spark, sf_dir).select("hostname", "day", "event_id", "bucket_id", "kind", "start_us", "end_us", "app", "title", "project")


@query(sql("SELECT * FROM merged", "merged"))
def merge_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merged_adjacent(_active(spark, sf_dir)).select("hostname", "day", "event_id", "bucket_id", "kind", "app", "title", "start_us", "end_us")


@query(sql("SELECT hostname, day, start_us, end_us FROM pieces", "pieces"))
def elementary_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.elementary(intervals.active_records(_records(spark, sf_dir, ["status"])))


@query(sql("SELECT * EXCLUDE (us) FROM allocated", "allocated"))
def window_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.allocated_windows(_active(spark, sf_dir))


@query(sql("SELECT * EXCLUDE (us), row_number() OVER (PARTITION BY hostname, day ORDER BY us DESC, lower(app), app) AS place FROM apps", "apps"))
def app_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.app_totals(_active(spark, sf_dir))


@query(sql("""
SELECT a.hostname, a.day, count(*) AS entries, concat_ws(',', CASE WHEN bool_or(kind = 'current-window') THEN 'current-window' END, CASE WHEN bool_or(kind = 'editor') THEN 'editor' END, CASE WHEN bool_or(kind = 'browser') THEN 'browser' END) AS sources,
       any_value(t.us) / 1e6 AS active_seconds
FROM active a LEFT JOIN (SELECT hostname, day, sum(us) AS us FROM apps GROUP BY ALL) t ON t.hostname = a.hostname AND t.day = a.day GROUP BY a.hostname, a.day""", "apps", "active"))
def report_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_heads(_active(spark, sf_dir))


@query(sql("SELECT hostname, day, event_id, start_us FROM records WHERE contains(lower(concat_ws(chr(1), project, app, title, file, url_host, bucket_id)), 'harbor')", "records"))
def filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.project_filter(_records(spark, sf_dir), "Harbor").select("hostname", "day", "event_id", "start_us")


@query(sql("SELECT hostname, day, evidence_id, event_id, start_us FROM observed", "observed"))
def evidence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.numbered(_active(spark, sf_dir)).select("hostname", "day", "evidence_id", "event_id", "start_us")


def _piece_rows(pieces: DataFrame) -> DataFrame:
    ids = F.array_join(F.transform("contexts", lambda c: c["evidence_id"]), ",")
    return pieces.withColumn("contexts", ids).drop("evidence_ids")


def _session_rows(found: DataFrame) -> DataFrame:
    kept = ["hostname", "day", "session_no", "start_us", "end_us", "active_seconds", "focused_seconds", "label"]
    return found.select(*kept, F.size("slices").alias("slices"), F.array_join("evidence_ids", ",").alias("evidence"))


def _signal_rows(found: DataFrame) -> DataFrame:
    return found.select("hostname", "day", "session_no", F.explode("outcome_signals").alias("s")).select("hostname", "day", "session_no", "s.code", "s.label")


def _anchor_rows(found: DataFrame) -> DataFrame:
    return ep.with_anchors(found).select("hostname", "day", "session_no", F.explode("anchors").alias("a")).select("hostname", "day", "session_no", "a.kind", "a.value")


@query()
def fused_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _piece_rows(_pieces(spark, sf_dir))


@query()
def fused_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _piece_rows(_slices(spark, sf_dir))


@query()
def window_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.window_conflicts(_pieces(spark, sf_dir))


@query()
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session_rows(_sessions(spark, sf_dir))


@query()
def session_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signal_rows(_sessions(spark, sf_dir))


@query()
def session_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anchor_rows(_sessions(spark, sf_dir))


@query()
def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.checked_episodes(_sessions(spark, sf_dir))


@query(sql("SELECT hostname, day, start_us, end_us, windows, focused, app, title, contexts FROM fused", "fused"))
def raw_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _piece_rows(_raw_pieces(spark, sf_dir))


@query(sql("SELECT hostname, day, count(*) AS n FROM covered WHERE windows > 1 GROUP BY ALL", "covered"))
def raw_window_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.window_conflicts(_raw_pieces(spark, sf_dir))


@query(sql("SELECT hostname, day, start_us, end_us, focused, app, title, contexts FROM slices", "slices"))
def raw_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _piece_rows(_raw_slices(spark, sf_dir))


@query(sql("SELECT hostname, day, pos, key, name, label, session_no FROM numbered", "numbered"))
def session_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fs.session_numbers(_raw_slices(spark, sf_dir)).select("hostname", "day", F.col("_pos").alias("pos"), F.col("_key").alias("key"), F.col("_name").alias("name"), F.col("_label").alias("label"), "session_no")


@query(sql("SELECT * EXCLUDE (us) FROM sessions", "sessions"))
def raw_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session_rows(_raw_sessions(spark, sf_dir))


@query(sql("SELECT hostname, day, sum(end_us - start_us) FILTER (WHERE focused) / 1e6 AS focused_seconds FROM slices GROUP BY hostname, day", "slices"))
def focused_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fs.focused_totals(_raw_slices(spark, sf_dir))


@query(sql("""
SELECT hostname, day, session_no, 'installer-started' AS code, 'An installer was started' AS label FROM numbered GROUP BY ALL HAVING bool_or(contains(lower(coalesce(app, '')), 'installer'))
UNION ALL SELECT hostname, day, session_no, 'checkout-success', 'A checkout success state appeared' FROM numbered GROUP BY ALL HAVING bool_or(lower(title) IN ('success page', 'checkout success'))
UNION ALL SELECT n.hostname, n.day, n.session_no, 'named-repository-appeared', 'Named repository appeared: ' || trim(min_by(n.context_path, n.pos), '/')
  FROM numbered n JOIN fresh f ON f.hostname = n.hostname AND f.day = n.day AND f.session_no = n.session_no AND n.pos > f.begun WHERE n.context_path IS NOT NULL GROUP BY ALL""", "fresh"))
def raw_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signal_rows(_raw_sessions(spark, sf_dir))


@query(sql("""
SELECT hostname, day, session_no, ['repository', 'project', 'file', 'title', 'domain'][rank + 1] AS kind, first(value ORDER BY pos, ix, rank) AS value FROM anchored GROUP BY hostname, day, session_no, rank, lower(value)""", "anchored"))
def raw_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anchor_rows(_raw_sessions(spark, sf_dir))


def _raw_days(spark: SparkSession, sf_dir: str) -> collect.Days:
    windows = table(spark, sf_dir, "day_windows")
    return collect.collected_raw(table(spark, sf_dir, "raw_events"), table(spark, sf_dir, "watch_buckets"), _host_windows(spark, sf_dir), windows)


@query()
def collected_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of raw events, by the whole way."""
    return _raw_days(spark, sf_dir).episodes()


@query()
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the whole way from raw events left out or changed, by code, in the order of output."""
    return _raw_days(spark, sf_dir).diagnostics


# Text functions, paths, plans and digests.

URL_SQL = "(SELECT DISTINCT data_json ->> '$.url' AS url FROM raw_events WHERE json_valid(data_json) AND json_type(data_json, '$.url') = 'VARCHAR')"


@query(f"SELECT url, nullif(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:@]*)(?::[0-9]*)?(?:[/?#]|$)', 1)), '') AS host, nullif(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '') AS path FROM {URL_SQL} WHERE url <> ''")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "raw_events").select(records.strict_text(F.try_parse_json("data_json"), "url").alias("url")).where("url is not null").distinct()
    host, path = records.url_parts(F.col("url"))
    return urls.select("url", host.alias("host"), path.alias("path"))


@query("""
SELECT url_host, url_path, CASE
    WHEN starts_with(h, 'login.') OR starts_with(h, 'auth.') OR starts_with(h, 'accounts.') OR regexp_matches(lower(url_path), 'oauth|authorize|callback|signin|challenge|recover|reset') OR len(p) < 2 THEN NULL
    WHEN h = 'github.com' THEN '/' || p[1] || '/' || p[2]
    WHEN contains(h, 'gitlab') THEN '/' || array_to_string(CASE WHEN len(p) >= 5 AND p[3] = '-' AND p[4] IN ('merge_requests', 'jobs') THEN p[1:5] ELSE p[1:2] END, '/') END AS kept
FROM (SELECT DISTINCT url_host, url_path, lower(url_host) AS h, list_filter(string_split(url_path, '/'), lambda x: x <> '') AS p FROM activity_records WHERE url_host <> '' AND url_path <> '')""")
def safe_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "activity_records").where("url_host <> '' and url_path <> ''").select("url_host", "url_path").distinct()
    return paths.withColumn("kept", text_safety.safe_path(F.col("url_host"), F.col("url_path")))


@query("""
SELECT event_id, epoch_us(ingested_at) AS ingested_us, CASE WHEN s > 0 AND s < 60 THEN '<1m' WHEN h > 0 AND m % 60 > 0 THEN h || 'h ' || (m % 60) || 'm' WHEN h > 0 THEN h || 'h' ELSE (m % 60) || 'm' END AS took,
       strftime(timezone('UTC', start_ts), '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(start_ts) % 1000000 > 0 THEN '.' || lpad(CAST(epoch_us(start_ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00' AS began,
       strftime(timezone('America/St_Johns', start_ts), '%H:%M') AS clock
FROM (SELECT *, m // 60 AS h FROM (SELECT *, greatest(0, CAST(floor((s + 30) / 60) AS BIGINT)) AS m FROM (SELECT *, (epoch_us(end_ts) - epoch_us(start_ts)) / 1e6 AS s FROM activity_records WHERE end_ts IS NOT NULL)))""")
def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "activity_records").where("end_ts is not null")
    us = F.unix_micros("start_ts")
    return rows.select("event_id", F.unix_micros("ingested_at").alias("ingested_us"), formatting.duration_text((F.unix_micros("end_ts") - us) / 1e6).alias("took"), formatting.iso_text(us).alias("began"), formatting.clock_text(us, F.lit("America/St_Johns")).alias("clock"))


@query(r"""
SELECT file, regexp_replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\', '\\'), '([`*_{}\[\]#+|])', '\\\1', 'g') AS escaped, fence || pad || line || pad || fence AS code,
       list_last(string_split(list_last(string_split(file, '/')), '\')) AS name
FROM (SELECT *, repeat('`', coalesce(list_max(list_transform(regexp_extract_all(line, '`+'), lambda x: len(x))), 0) + 1) AS fence, CASE WHEN starts_with(line, '`') OR ends_with(line, '`') THEN ' ' ELSE '' END AS pad
      FROM (SELECT DISTINCT file, trim(regexp_replace(file, '[\s\x{85}\x{a0}\p{Z}]+', ' ', 'g')) AS line FROM (SELECT file FROM activity_records UNION ALL SELECT '`' || file || ' ``x' FROM activity_records) WHERE file IS NOT NULL))""")
def markdown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "activity_records").where("file is not null").select(F.explode(F.array("file", F.concat(F.lit("`"), "file", F.lit(" ``x")))).alias("file")).distinct()
    f = F.col("file")
    return files.select("file", formatting.markdown_text(f).alias("escaped"), formatting.code_text(f).alias("code"), formatting.last_part(f).alias("name"))


@query()
def safe_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_safety.observations(_active(spark, sf_dir))


@query()
def sendable_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "activity_records").select("app", "title").distinct()
    return titles.withColumn("sent", text_safety.sendable_title(F.col("app"), F.col("title")))


@query("""
WITH RECURSIVE d AS (
  SELECT thread_id, doc_id, n_chars, row_number() OVER (PARTITION BY thread_id ORDER BY doc_id) AS no FROM documents WHERE n_chars IS NOT NULL AND thread_id IS NOT NULL
), f AS (
  SELECT thread_id, doc_id, no, 1 AS chunk, 10 + n_chars AS held FROM d WHERE no = 1
  UNION ALL
  SELECT d.thread_id, d.doc_id, d.no, CASE WHEN f.held + 2 + d.n_chars > 2000 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.held + 2 + d.n_chars > 2000 THEN 10 + d.n_chars ELSE f.held + 2 + d.n_chars END
  FROM f JOIN d ON d.thread_id = f.thread_id AND d.no = f.no + 1
) SELECT thread_id, doc_id, chunk FROM f""")
def summary_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").where("n_chars is not null and thread_id is not null").select("thread_id", "doc_id", "n_chars")
    return requests.chunked(items, ["thread_id"], ["doc_id"], "n_chars", 2000, base=10, joint=2).select("thread_id", "doc_id", "chunk")


@query()
def summary_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.request_plan(ep.checked_episodes(_sessions(spark, sf_dir)), target=20_000)


@query()
def plan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.plan_totals(summary_plan(spark, sf_dir))


def _as_episodes(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions in the place of episodes, and workstreams that each take every third of them."""
    items = made.select("hostname", "day", F.col("session_id").alias("episode_id"), "session_no", "start_us", "end_us", "active_seconds")
    streams = items.groupBy("hostname", "day", (F.col("session_no") % 3).alias("workstream")).agg(F.collect_list("episode_id").alias("episode_ids"))
    return items, streams


@query(sql("SELECT hostname, day, session_no % 3 AS workstream, sum(us) / 1e6 AS active_seconds, count(*) AS episodes, min(start_us) AS start_us, max(end_us) AS end_us FROM sessions GROUP BY ALL", "sessions"))
def digest_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, streams = _as_episodes(_raw_sessions(spark, sf_dir))
    return digest.checked_roll_up(streams, items)


@query(sql("SELECT hostname, day, format('session-{:03d}', session_no) AS episode_id FROM sessions WHERE session_no % 3 = 2", "sessions"))
def digest_unassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, streams = _as_episodes(_raw_sessions(spark, sf_dir))
    return digest.unassigned(streams.where("workstream <> 2"), items)


@query(sql("SELECT hostname, day, format('session-{:03d}', session_no) AS episode_id, CASE WHEN session_no % 3 = 2 THEN 0 ELSE 2 END AS times FROM sessions WHERE session_no % 3 = 2 OR session_no = 1", "sessions"))
def final_allocation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, streams = _as_episodes(_raw_sessions(spark, sf_dir))
    return digest.misallocated(streams.where("workstream <> 2"), items.where("session_no = 1"), items)


@query(sql("""
SELECT hostname, day, row_number() OVER (PARTITION BY hostname, day ORDER BY first) AS place, label, confidence, episode_ids, topics FROM (
  SELECT hostname, day, min(w) AS first, CASE WHEN joint THEN 'both' ELSE 'provisional-001-002' END AS label, CASE WHEN joint THEN 'high' ELSE 'low' END AS confidence,
         string_agg(id, ',' ORDER BY w DESC, id) AS episode_ids, CASE WHEN joint THEN 'topic 0' ELSE 'topic 1' END AS topics
  FROM (SELECT hostname, day, session_no % 3 AS w, session_no % 3 <> 1 AS joint, format('session-{:03d}', session_no) AS id FROM sessions) GROUP BY hostname, day, joint)""", "sessions"))
def digest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, streams = _as_episodes(_raw_sessions(spark, sf_dir))
    name = F.format_string("provisional-001-%03d", F.col("workstream") + 1)
    topic = F.array(F.concat(F.lit("topic "), (F.col("workstream") % 2).cast("string")))
    provisional = streams.select("hostname", "day", F.col("workstream").alias("place"), name.alias("provisional_id"), name.alias("label"), F.lit("low").alias("confidence"), F.array_sort("episode_ids").alias("episode_ids"), topic.alias("topics"), topic.alias("outcomes"))
    groups = items.select("hostname", "day").distinct().select("*", F.lit(0).alias("group_no"), F.lit("both").alias("label"), F.lit("high").alias("confidence"), F.array(F.lit("provisional-001-003"), F.lit("provisional-001-001")).alias("provisional_ids"))
    made = digest.merged(provisional, groups)
    return made.select("hostname", "day", "place", "label", "confidence", F.array_join("episode_ids", ",").alias("episode_ids"), F.array_join("topics", ",").alias("topics"))


@query()
def session_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.bundle_json(_sessions(spark, sf_dir), "session", details=True)


@query()
def session_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.bundle_markdown(_sessions(spark, sf_dir), "session", details=True, raw=True)


@query()
def episode_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.bundle_json(ep.episodes(_sessions(spark, sf_dir)), "episode", details=True)


@query()
def episode_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.bundle_markdown(ep.episodes(_sessions(spark, sf_dir)), "episode", details=True)


@query()
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = written(_active(spark, sf_dir), "active")  # read by timeline, heads and totals
    return sinks.report_markdown(intervals.merged_adjacent(active), reports.report_heads(active), reports.app_totals(active))


EVENT_KIND = "CASE event_type WHEN 'view' THEN 'current-window' WHEN 'click' THEN 'browser' WHEN 'purchase' THEN 'editor' WHEN 'error' THEN 'afk' END"


@query(f"""
WITH e AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, event_type || '-' || (user_id % 3) AS bucket_id, {EVENT_KIND} AS kind, CAST(props ->> '$.k' AS INTEGER) AS k,
         epoch_us(ts) AS s, epoch_us(ts) + CAST(round_even(((value - 5) * 10) * 1e6, 0) AS BIGINT) AS e FROM events
), x AS (
  SELECT e.*, d.d FROM e, LATERAL (SELECT unnest(range(s // 86400000000, e.e // 86400000000 + 1)) AS d) d WHERE kind IS NOT NULL AND k % 50 <> 0 AND e.e > s
)
SELECT CAST(DATE '1970-01-01' + CAST(d AS INTEGER) AS VARCHAR) AS day, event_id, bucket_id, kind, greatest(s, d * 86400000000) AS start_us, least(e, (d + 1) * 86400000000) AS end_us, ['msedge.exe', 'Code.exe', 'slack.exe', 'setup-installer.exe', 'explorer.exe'][k % 5 + 1] AS app
FROM x WHERE least(e, (d + 1) * 86400000000) > greatest(s, d * 86400000000)""")
def events_as_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, buckets = watchers.events_as_raw(table(spark, sf_dir, "events"))
    days = table(spark, sf_dir, "events").agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    days = days.select(F.explode(F.sequence(F.date_sub("a", 1), F.date_add("b", 2))).alias("day")).withColumn("timezone_name", F.lit("UTC"))
    windows = records.day_windows(days).withColumn("hostname", F.lit("events"))
    return records.normalised(raw, buckets, windows)[0].select("day", "event_id", "bucket_id", "kind", "start_us", "end_us", "app")


@query()
def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming operator over the table as a stream of files, until all of it is read."""
    path, name = f"{sf_dir.rstrip('/')}/activity_records.parque[t]", uuid.uuid4().hex  # a pattern may be a file or a folder
    held = spark.read.parquet(path)
    out = f"{shared_folder(spark)}/live-{name}"
    live.closing_row(held.where("not kind <=> 'afk'")).write.parquet(f"{out}-closing")
    rows = spark.readStream.schema(held.schema).parquet(path).where("not kind <=> 'afk'").unionByName(spark.readStream.schema(held.schema).parquet(f"{out}-closing"))
    live.live_sessions(rows, "bucket_id", ident="event_id").writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("bucket_id string, start_us bigint, end_us bigint, n_events bigint").parquet(out)


def _digest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Episodes, workstreams that take two of three of them, and the rest."""
    items = written(ep.episodes(_sessions(spark, sf_dir)), "episodes")
    no = F.regexp_extract("episode_id", r"(\d+)$", 1).cast("int") % 3
    none = F.array().cast("array<struct<text:string,evidence:array<string>>>")
    some = F.array().cast("array<struct<text:string,strength:string,evidence:array<string>>>")
    streams = items.where(no < 2).groupBy("hostname", "day", no.alias("workstream")).agg(F.array_sort(F.collect_list("episode_id")).alias("episode_ids"))
    streams = streams.select("*", F.concat(F.lit("stream "), F.col("workstream").cast("string")).alias("label"), F.lit("low").alias("confidence"), none.alias("topics"), some.alias("outcomes"))
    return items, streams, digest.unassigned(streams, items)


@query()
def digest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, streams, rest = _digest(spark, sf_dir)
    return sinks.digest_json(streams, rest, items, {"provider": "none", "model": "every-third"})


@query()
def digest_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, streams, rest = _digest(spark, sf_dir)
    return sinks.digest_markdown(streams, rest, items, "none", "every-third", details=True)
