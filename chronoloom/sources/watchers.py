"""Readers of watcher data: tables of buckets and events, and a data source over JSON exports, one partition a bucket."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from pathlib import Path
from urllib.parse import quote, urlencode, urlsplit
from urllib.request import urlopen

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

DEFAULT_PORT = 5600


class WatcherSourceError(RuntimeError):
    """A source could not be read; the message names the step and nothing of the content."""


@dataclass(frozen=True)
class Endpoint:
    protocol: str
    host: str
    port: int


def endpoint(url: str) -> Endpoint:
    """Server address of a URL: http or https, a host, no user, path, query or fragment. Errors never repeat the input."""
    try:
        u = urlsplit(url)
        fine = u.scheme in ("http", "https") and u.hostname and u.username is None and u.password is None and u.path in ("", "/") and not u.query and not u.fragment
        port = u.port
    except ValueError:
        fine, port = False, None
    if not fine:
        raise ValueError("not a server address")
    return Endpoint(u.scheme, u.hostname, port or DEFAULT_PORT)


def read_table(spark: SparkSession, folder: str, name: str, kind: str = "parquet") -> DataFrame:
    try:
        return spark.read.format(kind).load(f"{folder.rstrip('/')}/{name}.{kind}")
    except Exception as e:
        raise WatcherSourceError(f"{name} could not be read") from e


def events_between(events: DataFrame, start: str, end: str, longest_seconds: float | None = None) -> DataFrame:
    """Events that may overlap [start, end), by their own `received_at`-independent start column `ts`; the first bound is pushed to the scan
    as ts >= start - longest if the longest duration is known."""
    lo = F.lit(start).cast("timestamp")
    out = events.where(F.col("ts") < F.lit(end).cast("timestamp"))
    if longest_seconds is not None:
        out = out.where(F.col("ts") >= lo - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(longest_seconds))))
    return out


SCHEMA = "bucket_id string, bucket_type string, client string, hostname string, event_id string, ts_text string, duration_seconds double, data_json string"


def _in_range(event: dict, start: datetime | None, end: datetime | None) -> bool:
    """Whether an event may meet [start, end); one whose own time can't be read is kept, to be counted later."""
    try:
        began = datetime.fromisoformat(event["timestamp"])
        ended = began + timedelta(seconds=float(event.get("duration") or 0))
    except (KeyError, TypeError, ValueError, OverflowError):
        return True
    if began.tzinfo is None:
        return True
    return (end is None or began < end) and (start is None or ended >= start)


def _rows(bucket: dict, events: list[dict], start: datetime | None, end: datetime | None) -> Iterator[tuple]:
    head = tuple(str(bucket.get(k) or "") for k in ("id", "type", "client", "hostname"))
    for e in events:
        if _in_range(e, start, end):
            d = e.get("duration")
            yield (*head, str(e.get("id")), e.get("timestamp"), None if d is None else float(d), json.dumps(e.get("data"), ensure_ascii=False))


class _Options:
    """Options that sources share: types (comma separated), start and end (ISO texts with a zone)."""

    def __init__(self, options: dict):
        self.types = set(filter(None, options.get("types", "").split(",")))
        self.start, self.end = (datetime.fromisoformat(options[k]) if options.get(k) else None for k in ("start", "end"))


class ExportSource(DataSource):
    """Format 'watcher_export': a folder of JSON files, one bucket each: {id, type, client, hostname, events: [{id, timestamp, duration, data}]}.

    Files are read by Spark's own file source where one bucket is one line; this source is for whole exports that the driver and all workers can reach.
    """

    @classmethod
    def name(cls) -> str:
        return "watcher_export"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _ExportReader(self.options)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _ExportReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.asked = Path(options["path"]), _Options(options)
        if not self.folder.is_dir():
            raise WatcherSourceError("the export folder could not be read")

    def partitions(self) -> list[InputPartition]:
        return [_File(str(p)) for p in sorted(self.folder.glob("*.json"))]

    def read(self, partition: _File) -> Iterator[tuple]:
        try:
            b = json.loads(Path(partition.path).read_text(encoding="utf-8"))
        except (OSError, ValueError) as e:
            raise WatcherSourceError("an export file could not be read") from e
        if not self.asked.types or str(b.get("type") or "") in self.asked.types:
            yield from _rows(b, b.get("events", []), self.asked.start, self.asked.end)


def read_exports(spark: SparkSession, folder: str, types: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    spark.dataSource.register(ExportSource)
    return _asked(spark.read.format("watcher_export").option("path", folder), types, start, end).load()


def _asked(reader: DataFrameReader, types: list[str] | None, start: str | None, end: str | None) -> DataFrameReader:
    for k, v in (("types", ",".join(types or [])), ("start", start), ("end", end)):
        reader = reader.option(k, v) if v else reader
    return reader


class WatcherClient:
    """A watcher server over HTTP: its handshake, its buckets in order of id, and the events of a bucket in a range. Errors hold nothing of an answer."""

    def __init__(self, server: Endpoint, timeout: float = 30.0):
        host = f"[{server.host}]" if ":" in server.host else server.host
        self.base, self.timeout = f"{server.protocol}://{host}:{server.port}/api/0", timeout

    @classmethod
    def from_url(cls, url: str, timeout: float = 30.0) -> WatcherClient:
        return cls(endpoint(url), timeout)

    def _get(self, path: str, step: str) -> object:
        try:
            with urlopen(f"{self.base}/{path}", timeout=self.timeout) as answer:  # noqa: S310  http and https only, by endpoint()
                return json.load(answer)
        except (OSError, ValueError) as e:
            raise WatcherSourceError(f"{step} could not be read from the server") from e

    def info(self) -> dict:
        """{'version': text, 'testing': boolean}."""
        found = self._get("info", "its description")
        if not isinstance(found, dict) or not isinstance(found.get("version"), str):
            raise WatcherSourceError("the server gave no version")
        return {"version": found["version"], "testing": bool(found.get("testing"))}

    def buckets(self) -> list[dict]:
        found = self._get("buckets/", "the list of buckets")
        if not isinstance(found, dict):
            raise WatcherSourceError("the list of buckets could not be read from the server")
        return [{k: str((b or {}).get(k) or "") for k in ("type", "client", "hostname")} | {"id": i} for i, b in sorted(found.items())]

    def events(self, bucket_id: str, start: str | None = None, end: str | None = None) -> list[dict]:
        """Events of a bucket that meet [start, end), ISO texts with a zone; the server is asked for just these."""
        query = urlencode({k: v for k, v in (("start", start), ("end", end), ("limit", "-1")) if v})
        found = self._get(f"buckets/{quote(bucket_id, safe='')}/events?{query}", "the events of a bucket")
        if not isinstance(found, list) or not all(isinstance(e, dict) for e in found):
            raise WatcherSourceError("the events of a bucket could not be read from the server")
        return found


class ServerSource(DataSource):
    """Format 'watcher_server': the buckets of a watcher server, one partition each, with options url, types, start and end, which go to the server."""

    @classmethod
    def name(cls) -> str:
        return "watcher_server"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _ServerReader(self.options)


class _Bucket(InputPartition):
    def __init__(self, bucket: dict):
        self.bucket = bucket


class _ServerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.client, self.asked, self.range = WatcherClient.from_url(options["url"]), _Options(options), (options.get("start"), options.get("end"))

    def partitions(self) -> list[InputPartition]:
        return [_Bucket(b) for b in self.client.buckets() if not self.asked.types or b["type"] in self.asked.types]

    def read(self, partition: _Bucket) -> Iterator[tuple]:
        yield from _rows(partition.bucket, self.client.events(partition.bucket["id"], *self.range), self.asked.start, self.asked.end)


def read_server(spark: SparkSession, url: str, types: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Buckets and events of a server as one table, a bucket a task; the range is pushed to the server. Raises WatcherSourceError if it can't be reached."""
    WatcherClient.from_url(url).info()
    spark.dataSource.register(ServerSource)
    return _asked(spark.read.format("watcher_server").option("url", url), types, start, end).load()


def buckets_and_events(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw events, buckets) of a table that a source gave."""
    head = ["bucket_id", "bucket_type", "client", "hostname"]
    return rows.select("event_id", "bucket_id", "ts_text", "duration_seconds", "data_json"), rows.groupBy("bucket_id").agg(*[F.min(c).alias(c) for c in head[1:]])


def events_as_raw(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw events, buckets) made of a table of user events (event_id, ts, user_id, event_type, value, props), by a fixed rule."""
    k = F.get_json_object("props", "$.k").cast("int")
    types = {"view": "currentwindow", "click": "web.tab.current", "purchase": "app.editor.activity", "error": "afkstatus"}
    bucket = F.concat_ws("-", "event_type", (F.col("user_id") % 3).cast("string"))
    apps = F.array(*map(F.lit, ["msedge.exe", "Code.exe", "slack.exe", "setup-installer.exe", "explorer.exe"]))
    data = F.to_json(F.struct(F.element_at(apps, k % 5 + 1).alias("app"), F.concat(F.lit("proj-"), (k % 4).cast("string")).alias("project"), F.when(k % 2 == 1, "afk").otherwise("not-afk").alias("status")))
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(k % 50 == 0, "").otherwise("+00:00"))
    raw = events.select(F.col("event_id").cast("string").alias("event_id"), bucket.alias("bucket_id"), text.alias("ts_text"), ((F.col("value") - 5) * 10).alias("duration_seconds"), data.alias("data_json"))
    buckets = events.select(bucket.alias("bucket_id"), F.create_map(*[F.lit(x) for kv in types.items() for x in kv])[F.col("event_type")].alias("bucket_type"), F.lit("events").alias("client"), F.lit("events").alias("hostname")).distinct()
    return raw, buckets
