import datetime as dt
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chronoloom.__main__ import main, parser
from chronoloom.operators import focus_sessions, fusion
from chronoloom.operators.activity_sessions import activity_sessions
from chronoloom.sources import watchers
from chronoloom.streaming import live


def test_endpoints():
    assert watchers.endpoint("http://127.0.0.1") == watchers.Endpoint("http", "127.0.0.1", 5600)
    assert watchers.endpoint("https://h:81/").port == 81
    for bad in ("ftp://h", "http://", "http://u:secret@h", "http://h/x", "http://h?q", "http://h:99999", "h"):
        with pytest.raises(ValueError) as e:
            watchers.endpoint(bad)
        assert bad not in str(e.value)


def test_exports(spark, tmp_path):
    for i, kind in enumerate(["currentwindow", "other"]):
        events = [{"id": 5, "timestamp": "2025-10-13T10:00:00Z", "duration": 3, "data": {"app": "ä"}}, {"id": "x", "timestamp": None, "duration": None, "data": None}]
        (tmp_path / f"{i}.json").write_text(json.dumps({"id": f"b{i}", "type": kind, "hostname": "h", "events": events}), encoding="utf-8")
    got = watchers.read_exports(spark, str(tmp_path)).orderBy("bucket_id", "event_id").collect()
    assert [(r.bucket_id, r.client, r.event_id, r.duration_seconds) for r in got] == [("b0", "", "5", 3.0), ("b0", "", "x", None), ("b1", "", "5", 3.0), ("b1", "", "x", None)]
    assert json.loads(got[0].data_json) == {"app": "ä"}
    assert watchers.read_exports(spark, str(tmp_path), ["currentwindow"]).count() == 2
    with pytest.raises(watchers.WatcherSourceError):
        watchers.read_table(spark, str(tmp_path), "missing")


def test_time_range_reaches_the_scan(spark, tmp_path):
    spark.range(10).select(F.timestamp_seconds("id").alias("ts")).write.parquet(str(tmp_path / "e"))
    found = watchers.events_between(spark.read.parquet(str(tmp_path / "e")), "1970-01-01 00:00:05", "1970-01-01 00:00:08", 2)
    assert found.count() == 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def times(spark, rows):
    return spark.createDataFrame(rows, "host string, a double, z double").select("host", F.timestamp_micros((F.col("a") * 1e6).cast("long")).alias("start_ts"), F.timestamp_micros((F.col("z") * 1e6).cast("long")).alias("end_ts"))


def test_live_sessions(spark, tmp_path):
    rows = [("a", 0.0, 10.0), ("a", 310.0, 311.0), ("a", 620.0, 5000.0), ("a", 5100.0, None), ("b", 0.0, None), ("b", 300.000001, 301.0), ("c", 1e6, 1e6)]
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    df = times(spark, rows)
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    live.live_sessions(stream, "host").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    batch = activity_sessions(df.select("host", F.unix_micros("start_ts").alias("s"), F.unix_micros("end_ts").alias("e")), "host")
    assert got == sorted(map(tuple, batch.where("host <> 'c'").select("host", "start_us", "end_us", "n_events").collect()))


def test_live_sessions_of_the_last_hour_come_out(spark, tmp_path):
    folder = str(tmp_path)
    rows = [("a", 0.0, 10.0), ("a", 310.0, 311.0), ("b", 0.0, None), ("c", 1e6, 1e6), ("d", 1e6 - 600, 1e6 + 9000), ("d", 1e6 - 1000, 1e6 - 950)]
    rows = [(h, a + 1e5, None if z is None else z + 1e5) for h, a, z in rows]  # a stream's first watermark is 0
    df = times(spark, rows).withColumns({"kind": F.lit(None).cast("string"), "event_id": F.concat_ws("@", "host", F.unix_micros("start_ts").cast("string"))}).withColumnRenamed("host", "bucket_id")
    df = df.union(df.limit(3))
    df.write.parquet(f"{folder}/activity_records.parquet")
    batch = activity_sessions(df.dropDuplicates(["event_id"]).select("bucket_id", F.unix_micros("start_ts").alias("s"), F.unix_micros("end_ts").alias("e")), "bucket_id")
    got = sorted(map(tuple, entry.queries()["live_sessions"](spark, folder).collect()))
    assert len(got) == 5 and got == sorted(map(tuple, batch.select("bucket_id", "start_us", "end_us", "n_events").collect()))


def test_days_are_made_anew(spark, tmp_path):
    schema = "hostname string, day date, bucket_id string, event_id string, kind string, start_us bigint, end_us bigint, app string, title string, project string, file string, url_host string, url_path string, language string"
    row = lambda i, s, e: ("h", dt.date(1970, 1, 1), "b", str(i), "current-window", s, e, "x", "one", *[None] * 5)
    src = tmp_path / "src"
    compute = lambda df: focus_sessions.sessions(fusion.fused_slices(fusion.numbered(df))).select("hostname", "day", "session_id", "start_us", "end_us")
    for rows in ([row(1, 0, 10)], [row(2, 10, 20), row(2, 10, 20)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        live.live_days(stream, str(tmp_path / "store"), str(tmp_path / "out"), compute, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.session_id, r.start_us, r.end_us) for r in got] == [("session-001", 0, 20)]


def test_command_line(spark, tmp_path):
    with pytest.raises(SystemExit):
        parser().parse_args(["x", "--host", "h", "--day", "nonsense"])
    assert main([str(tmp_path), "--host", "h", "--day", "2025-10-13"]) == 1
    folder = "/root/testdata/sf0.001"
    host, day = spark.read.parquet(f"{folder}/activity_records.parquet").join(spark.read.parquet(f"{folder}/watch_buckets.parquet"), "bucket_id").where("kind = 'current-window' and end_ts > start_ts").select("hostname", F.to_date("start_ts")).first()
    for what in ("episodes", "report"):
        out = tmp_path / f"{what}.md"
        assert main([folder, "--host", host, "--day", str(day), "--what", what, "--output", str(out)]) == 0
        assert out.read_text(encoding="utf-8").startswith("# Activity")


class _Watcher(BaseHTTPRequestHandler):
    answers: dict = {}
    asked: list = []

    def do_GET(self):  # noqa: N802
        self.asked.append(self.path)
        body = self.answers.get(self.path.partition("?")[0])
        self.send_response(200 if body is not None else 404)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    event = lambda i, at, n, **data: {"id": i, "timestamp": f"2025-10-13T{at}:00+00:00", "duration": n, "data": data}
    _Watcher.asked = []
    _Watcher.answers = {
        "/api/0/info": {"version": "v1", "testing": True},
        "/api/0/buckets/": {"w/1": {"type": "currentwindow", "client": "c", "hostname": "h"}, "a": {"type": "afkstatus", "client": None, "hostname": "h"}, "z": {"type": "odd", "hostname": "h"}},
        "/api/0/buckets/w%2F1/events": [event(1, "09:00", 600, app="Code.exe", title="mail a.b@x.org"), event(2, "09:05", 600, app="slack.exe", title="b"), event(3, "10:00", 0, app="x"), event(9, "23:00", 60, app="late")],
        "/api/0/buckets/a/events": [event(4, "09:10", 60, status="afk"), event(5, "09:20", 60, status="not-afk")],
    }
    http = HTTPServer(("127.0.0.1", 0), _Watcher)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def test_server(spark, server):
    client = watchers.WatcherClient.from_url(server)
    assert client.info() == {"version": "v1", "testing": True} and [b["id"] for b in client.buckets()] == ["a", "w/1", "z"]
    rows = watchers.read_server(spark, server, ["currentwindow", "afkstatus"], "2025-10-13T00:00:00+00:00", "2025-10-13T12:00:00+00:00")
    assert sorted(r.event_id for r in rows.collect()) == ["1", "2", "3", "4", "5"]
    assert any("start=2025-10-13T00%3A00%3A00%2B00%3A00" in p for p in _Watcher.asked) and not any("/z/" in p for p in _Watcher.asked)
    for answers in ({}, {"/api/0/info": []}):
        _Watcher.answers = answers
        with pytest.raises(watchers.WatcherSourceError):
            client.info()
    with pytest.raises(watchers.WatcherSourceError):
        client.events("w/1")


def broken(request):
    raise OSError("a secret")


def test_command_line_of_a_server(spark, server, tmp_path, capsys):
    base = ["--server", server, "--host", "h", "--day", "2025-10-13"]
    assert main([*base, "--what", "diagnostics", "--format", "json"]) == 0
    told = {d["code"]: d["count"] for d in json.loads(capsys.readouterr().out)["diagnostics"]}
    assert told["non-positive-event"] == 1 and told["window-conflict"] >= 1 and told["sanitized-field"] >= 1
    out, bad = tmp_path / "x.md", tmp_path / "failure.json"
    assert main([*base, "--what", "summary", "--model", "tests.test_sources_and_streams:broken", "--output", str(out), "--failure-output", str(bad)]) == 2
    assert out.read_text(encoding="utf-8").startswith("# Activity") and "secret" not in bad.read_text(encoding="utf-8") and json.loads(bad.read_text(encoding="utf-8"))["validation"]["field"] == "provider"
    assert "Done!" in capsys.readouterr().err
    assert main(["--server", "http://127.0.0.1:9", "--host", "h", "--day", "2025-10-13"]) == 1
    for wrong in ([], ["x", "--server", server], ["x", "--what", "report", "--format", "json"], ["x", "--what", "summary"], ["x", "--model", "m:f"], ["x", "--what", "report", "--raw"]):
        with pytest.raises(SystemExit) as e:
            main([*wrong, "--host", "h", "--day", "2025-10-13"])
        assert e.value.code == 2


def private_tables(spark, folder):
    """A browser on a page of a private address and an editor on a file with its folders, of one host; its zone is UTC."""
    at = lambda m: dt.datetime(2025, 10, 13, 9, m)
    rows = [("1", "w", "current-window", at(0), at(5), "msedge.exe", "mail a.b@x.org", *[None] * 6), ("2", "b", "browser", at(0), at(5), None, "token=abcdefghijklmnop", None, None, "Shop.example", "/private/orders", None, None), ("3", "w", "current-window", at(5), at(10), "Code.exe", "x", *[None] * 6), ("4", "e", "editor", at(5), at(10), None, None, "/home/ann/secret-project", "/home/ann/notes.txt", None, None, "Python", None)]
    schema = "event_id string, bucket_id string, kind string, start_ts timestamp, end_ts timestamp, app string, title string, project string, file string, url_host string, url_path string, code_language string, status string"
    spark.createDataFrame(rows, schema).withColumn("ingested_at", F.col("end_ts")).write.parquet(f"{folder}/activity_records.parquet")
    spark.createDataFrame([("w", "h"), ("b", "h"), ("e", "h")], "bucket_id string, hostname string").write.parquet(f"{folder}/watch_buckets.parquet")
    days = spark.createDataFrame([("h", dt.date(2025, 10, 13), "UTC", dt.datetime(2025, 10, 13), dt.datetime(2025, 10, 14))], "hostname string, local_day date, timezone_name string, window_start timestamp, window_end timestamp")
    days.write.parquet(f"{folder}/day_windows.parquet")


def test_what_goes_out_is_made_of_safe_texts(spark, tmp_path):
    folder = str(tmp_path)
    private_tables(spark, folder)
    found = {n: json.dumps([r.asDict(True) for r in entry.queries()[n](spark, folder).collect()], default=str) for n in ("session_json", "episode_markdown", "fused_slices", "summary_plan")}
    assert main([folder, "--host", "h", "--day", "2025-10-13", "--format", "json", "--details", "--raw", "--output", str(tmp_path / "x")]) == 0
    found["command line"] = (tmp_path / "x").read_text(encoding="utf-8")
    for name, text in found.items():
        assert text != "[]" and not [x for x in ("a.b@x.org", "abcdefghijklmnop", "/private", "/home") if x in text], name
    assert "redacted-email" in found["session_json"] and "notes.txt" in found["session_json"]


def test_registries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 45


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_queries_give_what_their_sql_gives(spark, name):
    import verify

    ok, note = verify.compare(spark, "/root/testdata/sf0.001", name, verify.connect("/root/testdata/sf0.001"))
    assert ok, note
