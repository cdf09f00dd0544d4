"""Interval algebra, fusion, sessions and episodes against plain loops on random device-days."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from chronoloom import queries, sinks
from chronoloom.functions import text_safety
from chronoloom.operators import episodes as ep
from chronoloom.operators import focus_sessions as fs
from chronoloom.operators import fusion, intervals, records, reports
from chronoloom.plans import collect
from chronoloom.schema import RECORD, TEXTS
from chronoloom.spark_tools import BROADCAST_BYTES, is_small

DAY = dt.date(2025, 10, 13)
SCHEMA = "hostname string, day date, event_id string, bucket_id string, kind string, start_us bigint, end_us bigint, " + ", ".join(f"{c} string" for c in TEXTS)


def record(event_id, kind, s, e, bucket=None, **texts):
    return ("h", DAY, str(event_id), bucket or kind, kind, s * 1_000_000, e * 1_000_000, *[texts.get(c) for c in TEXTS])


def day(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def random_day(seed, n=60):
    r = random.Random(seed)
    out = []
    for i in range(n):
        kind = r.choice(["current-window"] * 4 + ["browser", "editor", "afk"])
        s = r.randrange(0, 3000)
        out.append(record(i, kind, s, s + r.randrange(1, 120), bucket=f"{kind}-{r.randrange(2)}", app=r.choice(["msedge.exe", "Code.exe", None, "slack.exe"]) if kind == "current-window" else None, title=r.choice(["a", "b", None, "inbox"]), project=r.choice([None, "p"]) if kind == "editor" else None, url_path=r.choice([None, "/x"]) if kind == "browser" else None, status=r.choice(["afk", "not-afk"]) if kind == "afk" else None))
    return out


def covered(rows, t):
    return [x for x in rows if x[5] <= t < x[6]]


@pytest.mark.parametrize("seed", range(3))
def test_away_time_is_taken_out(spark, seed):
    rows = random_day(seed)
    got = intervals.active_records(day(spark, rows)).collect()
    away = [x for x in rows if x[4] == "afk" and x[14] == "afk"]
    for t in range(0, 3200 * 1_000_000, 1_000_000):
        want = sorted(x[2] for x in covered(rows, t) if x[4] != "afk") if not covered(away, t) else []
        assert sorted(x.event_id for x in got if x.start_us <= t < x.end_us) == want
    assert all(x.start_us < x.end_us for x in got)


@pytest.mark.parametrize("seed", range(3))
def test_fusion_at_every_second(spark, seed):
    rows = [x for x in random_day(seed) if x[4] != "afk"]
    obs = fusion.numbered(day(spark, rows))
    ids = {x.event_id: x for x in obs.collect()}
    slices = fusion.fused_slices(obs).orderBy("start_us").collect()
    for t in range(0, 3200 * 1_000_000, 1_000_000):
        here = [ids[x[2]] for x in covered(rows, t)]
        now = [x for x in slices if x.start_us <= t < x.end_us]
        assert len(now) == bool(here)
        if here:
            windows = sorted(x.evidence_id for x in here if x.kind == "current-window")
            assert now[0].focused == bool(windows)
            w = next((x for x in here if windows and x.evidence_id == windows[0]), None)
            assert now[0].app == (w.app if w else None)
            fits = {"msedge.exe": "browser", "Code.exe": "editor"}
            assert [c.evidence_id for c in now[0].contexts] == sorted(x.evidence_id for x in here if x.kind != "current-window" and (w is None or fits.get(w.app) == x.kind))
    for a, b in zip(slices, slices[1:]):
        assert a.end_us < b.start_us or (a.focused, a.app, a.title, a.contexts) != (b.focused, b.app, b.title, b.contexts)


def test_allocation_adds_up(spark):
    rows = [record(1, "current-window", 0, 10, app="A"), record(2, "current-window", 5, 20, app="B"), record(2, "current-window", 5, 20, app="B"), record(3, "browser", 0, 99)]
    got = {x.app: (x.seconds, x.place) for x in reports.app_totals(day(spark, rows)).collect()}
    assert got == {"A": (10.0, 1), "B": (10.0, 2)}
    head = reports.report_heads(day(spark, rows)).collect()[0]
    assert (head.entries, head.sources, head.active_seconds) == (4, "current-window,browser", 20.0)


def test_merging_adjacent_records(spark):
    rows = [record(1, "browser", 0, 100, title="t"), record(2, "browser", 10, 20, title="t"), record(3, "browser", 160, 170, title="t"), record(4, "browser", 231, 240, title="t"), record(5, "browser", 241, 250)]
    got = intervals.merged_adjacent(day(spark, rows)).orderBy("start_us").collect()
    assert [(x.event_id, x.start_us // 10**6, x.end_us // 10**6) for x in got] == [("1", 0, 170), ("4", 231, 240), ("5", 241, 250)]


def test_project_filter(spark):
    rows = [record(1, "editor", 0, 1, project="Alpha"), record(2, "editor", 0, 1, file="x/ALPHA.py"), record(3, "editor", 0, 1, title="beta")]
    assert {x.event_id for x in intervals.project_filter(day(spark, rows), "alpha").collect()} == {"1", "2"}
    assert intervals.project_filter(day(spark, rows), None).count() == 3
    assert intervals.project_filter(day(spark, rows), "").count() == 3


def slices(spark, items):
    schema = "hostname string, day date, start_us bigint, end_us bigint, focused boolean, app string, title string, contexts array<struct<evidence_id:string,kind:string,title:string,project:string,file:string,url_host:string,url_path:string,language:string>>, evidence_ids array<string>"
    return spark.createDataFrame([("h", DAY, s * 10**6, e * 10**6, True, app, title, [("c", "browser", None, None, None, "host", path, None)] if path else [], [f"e{i}"]) for i, (s, e, app, title, path) in enumerate(items)], schema)


def numbers(spark, items):
    return [r.session_no for r in fs.session_numbers(slices(spark, items)).orderBy("start_us").collect()]


def test_session_rules(spark):
    assert numbers(spark, [(0, 60, "a", "one", None), (60, 70, "a", "two", None), (70, 90, "a", "one", None)]) == [1, 1, 1]  # a short stop between
    assert numbers(spark, [(0, 60, "a", "one", None), (60, 80, "a", "two", None), (80, 90, "a", "one", None)]) == [1, 2, 3]
    assert numbers(spark, [(0, 60, "a", "one", None), (360, 400, "a", "one", None), (701, 702, "a", "one", None)]) == [1, 1, 2]
    assert numbers(spark, [(0, 60, "a", "one", None), (60, 90, "a", "Inbox", None), (90, 120, "a", "Inbox", None)]) == [1, 2, 3]  # stands alone
    assert numbers(spark, [(0, 60, "x.exe", None, None), (60, 90, "X", None, None), (90, 120, "y", None, None)]) == [1, 1, 2]


def test_outcome_signals(spark):
    made = fs.sessions(slices(spark, [(0, 30, "setup-installer.exe", "New repository", None), (40, 70, "a", "Success page", "/team/one/")])).collect()
    found = [(s.code, s.label, s.evidence_ids) for m in made for s in m.outcome_signals]
    assert ("named-repository-appeared", "Named repository appeared: team/one", ["e0", "e1"]) in found
    assert {"checkout-success", "installer-started"} <= {c for c, *_ in found}


def groups_by_definition(starts, ends, anchors):
    """The rules in their plainest form, by sets that are searched whole."""
    groups, strong = [], [i for i, a in enumerate(anchors) if a]
    for k, i in enumerate(strong):
        j = strong[k - 1] if k else None
        if j is not None and anchors[i] & anchors[j] and starts[i] - ends[j] <= ep.BRIDGE_US:
            groups[-1] |= set(range(j, i + 1))
        else:
            groups.append({i})
    rest = [i for i in range(len(starts)) if not any(i in g for g in groups)]
    lonely = []
    for i in rest:
        near = [g for g in groups if 0 <= starts[i] - ends[max(g)] <= ep.SIDE_US or 0 <= starts[min(g)] - ends[i] <= ep.SIDE_US]
        near[0].add(i) if len(near) == 1 else lonely.append(i)
    for i in lonely:
        if groups and max(groups[-1]) == i - 1 and (i - 1) in lonely and starts[i] - ends[i - 1] <= ep.BRIDGE_US:
            groups[-1].add(i)
        else:
            groups.append({i})
    groups.sort(key=lambda g: (starts[min(g)], min(g)))
    return [next(n for n, g in enumerate(groups) if i in g) for i in range(len(starts))]


def test_episode_groups():
    r = random.Random(7)
    for _ in range(3000):
        t, starts, ends, anchors = 0, [], [], []
        for _ in range(r.randrange(1, 12)):
            t += r.choice([0, 60, 120, 121, 200, 300, 301]) * 1_000_000
            starts.append(t)
            t += r.randrange(1, 100) * 1_000_000
            ends.append(t)
            anchors.append(frozenset(r.sample("abc", r.choice([0, 0, 1, 2]))))
        assert ep.grouped(starts, ends, anchors) == groups_by_definition(starts, ends, anchors)


def test_a_long_day_is_compacted(spark):
    """437 short sessions, every 11th with an anchor: few episodes, no session or second lost."""
    items = [(i * 45, i * 45 + 30, "a", f"repository {(i // 11) % 5}" if i % 11 == 0 else ("slack" if i % 2 else "outlook"), f"/team/repo{(i // 110) % 5}" if i % 11 == 0 else None) for i in range(437)]
    made = fs.sessions(slices(spark, items))
    found = ep.checked_episodes(made).collect()
    assert made.count() == 437
    assert len(found) <= 80 and len(found) / 437 <= 0.3
    assert sum(len(e.session_ids) for e in found) == 437
    assert sum(e.active_seconds for e in found) == 437 * 30


def test_outputs(spark):
    made = fs.sessions(slices(spark, [(0, 600, "a|b", None, None), (600, 640, "a|b", "One `two`", "/team/x")]))
    doc = json.loads(sinks.bundle_json(made, "session", details=True).collect()[0].json)
    assert doc["sessions"][0]["active_seconds"] == 640.0 and doc["sessions"][0]["start"] == "1970-01-01T00:00:00+00:00"
    assert "title" not in doc["sessions"][0]["slices"][1]["contexts"][0] and doc["sessions"][0]["slices"][1]["contexts"][0]["path"] == "/team/x"
    assert doc["sessions"][0]["focused_seconds"] == 640.0
    made_episodes = ep.episodes(made)
    text = sinks.bundle_markdown(made_episodes, "episode", details=True).collect()[0].markdown
    assert "- 00:00–00:11 — " in text or "- 00:00–00:10 — " in text and "  - Tools: a\\|b ×2" in text and text.endswith("\n")
    assert json.loads(sinks.bundle_json(made_episodes, "episode", sessions=made).collect()[0].json)["sessions"]


def test_documents_are_made_of_items(spark):
    """Python makes the items of a document and its frame, never a whole day; the text is that of the whole in canonical form."""
    made = fs.sessions(slices(spark, [(i * 700, i * 700 + 60, "a", f'"sessions": "@"\\n{i} é\n\x01', "/team/x" if i % 2 else None) for i in range(12)]))
    both = [(sinks.bundle_json(made, "session", details=True), ["sessions"]), (sinks.bundle_json(ep.episodes(made), "episode", sessions=made), ["episodes", "sessions"])]
    for documents, lists in both:
        (text,) = [r.json for r in documents.collect()]
        assert text == sinks.stable_json(json.loads(text)) and all(json.loads(text)[x] for x in lists)
        evaluated = [line for line in documents._jdf.queryExecution().optimizedPlan().toString().splitlines() if "ArrowEvalPython" in line]
        assert evaluated and all("item_json(" in line and "canonical_json(" not in line for line in evaluated)
    numbers = [0, 1, 9, 10, 12, 99, 100, 101, 999, 1000, 123_456, 10**6, 640 * 10**6, 86_399_999_999, 10**13, 123_456_789_012_345, *(random.Random(3).randrange(10 ** k) for k in range(1, 16) for _ in range(20))]
    texts = spark.createDataFrame([(n,) for n in numbers], "n bigint").select("n", sinks._seconds_json(F.col("n")).alias("t")).collect()
    assert all(r.t == json.dumps(r.n / 1e6) for r in texts)


def test_atomic_write(tmp_path):
    target = tmp_path / "x.md"
    sinks.write_whole(target, "a\nä")
    sinks.write_whole(target, "b\n")
    assert target.read_bytes() == b"b\n" and list(tmp_path.iterdir()) == [target]


def test_urls_and_strict_texts(spark):
    cases = {"https://User:pw@Host.Example:80/a/b?q#f": ("host.example", "/a/b"), "a.com/x": (None, "a.com/x"), "https://h": ("h", None), "https://[::1]/p": ("::1", "/p"), "https://h/a b|c": ("h", "/a b|c"), "https://a_b.example/p": ("a_b.example", "/p"), "": (None, None), "https://[bad/p": (None, None), None: (None, None)}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    host, path = records.url_parts(F.col("u"))
    assert {r.u: (r.h, r.p) for r in df.select("u", host.alias("h"), path.alias("p")).collect()} == cases
    docs = spark.createDataFrame([('{"app": "x"}',), ('{"app": 5}',), ('{"app": ""}',), ('{"app": null}',), ('{"ap',), (None,)], "d string")
    assert [r[0] for r in docs.select(records.strict_text(F.try_parse_json("d"), "app")).collect()] == ["x", None, None, None, None, None]


def test_normalised_and_diagnostics(spark):
    raw = spark.createDataFrame([("1", "w", "2025-10-13T23:59:00+00:00", 120.0, '{"app": "x", "url": "https://H/p?q"}'), ("2", "w", "2025-10-13T10:00:00", 5.0, "{}"), ("3", "w", "2025-10-13T10:00:00Z", 0.0, "{}"), ("4", "odd", "2025-10-13T10:00:00Z", 5.0, "{}"), ("5", "w", "2025-10-13T10:00:00.0000005Z", None, None)], "event_id string, bucket_id string, ts_text string, duration_seconds double, data_json string")
    buckets = spark.createDataFrame([("w", "currentwindow", None, "h"), ("odd", "other", "c", "h"), ("n", None, "c", "h")], "bucket_id string, bucket_type string, client string, hostname string")
    days = spark.createDataFrame([(DAY, "UTC"), (DAY + dt.timedelta(1), "UTC")], "day date, timezone_name string")
    got, fates = records.normalised(raw, buckets, records.day_windows(days).withColumn("hostname", F.lit("h")))
    rows = sorted((r.day.day, r.event_id, (r.end_us - r.start_us) // 10**6, r.app, r.url_host, r.url_path) for r in got.collect())
    assert rows == [(13, "1", 60, "x", "h", "/p"), (14, "1", 60, "x", "h", "/p")]
    assert {r.fate: r.n for r in fates.collect()} == {"kept": 1, "naive-timestamp": 1, "non-positive-event": 1, "unreadable-timestamp": 1, "unsupported-bucket": 1}
    counts = fates.where("fate in ('naive-timestamp', 'non-positive-event')").withColumnRenamed("fate", "code")
    assert got.columns == ["hostname", "day", *RECORD]
    told = records.diagnostic_messages(counts).orderBy("rank").collect()
    assert [m.message for m in told] == ["ignored 1 non-positive event", "ignored 1 event with a naive timestamp"]
    assert {r.bucket_type: r.n for r in records.unsupported_buckets(buckets).collect()} == {"other": 1, "": 1}


def test_diagnostics_make_no_tables_of_records(spark, monkeypatch):
    """They are those of observations and pieces, made beforehand or not, and none of those tables is written for them alone."""
    names = []
    monkeypatch.setattr(collect, "written", lambda df, what: (names.append(what), df.cache())[1])
    for seed in (1, 2):
        rows = random_day(seed) + [record("x", "editor", 5, 50, title="mail ada@example.com"), record("y", "current-window", 7, 20), record("z", "current-window", 9, 30)]
        rows += [(None, *r[1:]) for r in rows[-3:]]  # no pieces are made of records without a host
        found = day(spark, rows)
        days = collect.collected(found)
        told = {r.code: r.n for r in days.diagnostics.collect()}
        assert not {"active", "observations", "pieces", "sessions"} & set(names)
        later = collect.collected(found)
        assert later.sessions.count() and {r.code: r.n for r in later.diagnostics.collect()} == told
        assert names.count("observations") == 1
        names.clear()
        seen = later.observations
        conflicts = fusion.window_conflicts(fusion.fused_pieces(seen)).agg(F.sum("n")).first()[0]
        assert told == {"sanitized-field": seen.agg(F.sum("changes")).first()[0], "window-conflict": conflicts} and conflicts > 1
    assert collect.collected(day(spark, rows).limit(0)).diagnostics.count() == 0


def test_episodes_of_days_make_no_table_twice(spark, monkeypatch):
    """Episodes need no table of active records, and the sessions are written once; they are those of the steps one by one."""
    names = []
    for module in (collect, ep):
        monkeypatch.setattr(module, "written", lambda df, what: (names.append(what), df.cache())[1])
    found = day(spark, random_day(3) + [record("x", "editor", 5, 50, title="mail ada@example.com")])
    got = sorted(map(repr, collect.collected(found).episodes().collect()))
    assert not {"active", "found"} & set(names) and len(names) == 5
    safe = text_safety.observations(intervals.active_records(found))
    assert got and got == sorted(map(repr, ep.episodes(fs.sessions(fusion.fused_slices(safe))).collect()))


def test_small_files_of_many_rows_are_not_broadcast(spark, tmp_path):
    """Keys that are alike take little room in files; what counts is their number and room in memory."""
    keys = [F.concat(F.lit(a), "id", F.lit(b)).alias(c) for a, b, c in (("aw-watcher-window_desk-", ".office.test", "bucket_id"), ("desk-", ".office.test", "hostname"), ("current-", "-window", "kind"))]
    spark.range(160_000, numPartitions=2).select(*keys).write.option("compression", "zstd").parquet(f"{tmp_path}/many")
    many = spark.read.parquet(f"{tmp_path}/many")
    bound = int(str(many._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert bound <= BROADCAST_BYTES and not is_small(many)
    assert is_small(many.limit(100_000)) and is_small(spark.range(120_000).selectExpr("cast(id as int) as x").coalesce(1)) and is_small(many.limit(0))


def test_every_raw_row_has_one_fate(spark):
    """Kept and counted rows add up to the input, whatever the rows hold; a row of two windows is kept once."""
    r = random.Random(3)
    texts = ["2025-10-13T23:59:00Z", "2025-10-13 10:00", "1760349600", "?", None, "2025-10-20T00:00:00Z"]
    rows = [(r.choice([None, *"abcdefgh"]), r.choice(["w", "odd", "unknown", None]), r.choice(texts), r.choice([None, 0.0, -1.0, 120.0, 1e300, float("nan")]), "{}", dt.datetime(2025, 10, 13, r.randrange(24))) for _ in range(300)]
    raw = spark.createDataFrame(rows, "event_id string, bucket_id string, ts_text string, duration_seconds double, data_json string, received_at timestamp")
    buckets = spark.createDataFrame([("w", "currentwindow", None, "h"), ("odd", "other", "c", "h")], "bucket_id string, bucket_type string, client string, hostname string")
    days = spark.createDataFrame([(DAY, "UTC"), (DAY + dt.timedelta(1), "UTC")], "day date, timezone_name string")
    zones = spark.createDataFrame([("h", DAY, "UTC")], "hostname string, local_day date, timezone_name string")
    for z in (None, zones):
        got, fates = records.normalised(raw, buckets, records.day_windows(days).withColumn("hostname", F.lit("h")), z)
        assert sum(f.n for f in fates.collect()) == len(rows)
        assert got.where("end_us <= start_us").count() == 0
    empty, fates = records.normalised(raw.limit(0), buckets, records.day_windows(days.limit(0)).withColumn("hostname", F.lit("h")), zones)
    assert empty.count() == 0 and fates.count() == 0


def test_days_of_23_and_25_hours(spark):
    days = spark.createDataFrame([("2026-03-08", "America/Los_Angeles"), ("2026-11-01", "America/Los_Angeles"), ("2024-09-08", "America/Santiago")], "day string, timezone_name string").withColumn("day", F.col("day").cast("date"))
    assert [r.duration_seconds for r in records.day_windows(days).orderBy("day").collect()] == [82_800.0, 82_800.0, 90_000.0]


def test_windows_of_zones_in_any_vocabulary(spark, tmp_path):
    names = {"US/Eastern": 4, "CET": -2, " europe/berlin ": -2, "W. Europe Standard Time": -2, "Europe/Berlin": -2, "Japan": -9, "+05:45": -5.75, "UTC-3": 3, "nowhere": None, None: 0}
    rows = [("h", DAY, n) for n in names] * 2
    spark.createDataFrame(rows, "hostname string, local_day date, timezone_name string").write.parquet(str(tmp_path / "day_windows.parquet"))
    midnight = int(dt.datetime(2025, 10, 13, tzinfo=dt.UTC).timestamp())
    got = sorted((r.timezone_name, r.start_us, r.duration_seconds) for r in queries.QUERIES["day_windows"](spark, str(tmp_path)).collect())
    assert got == sorted((n, None if h is None else int((midnight + h * 3600) * 10**6), None if h is None else 86_400.0) for n, h in names.items() if n)


def test_texts_of_any_layout_are_normalised(spark):
    zoned = ["2025-10-13T10:00:00Z", "1760349600", "Mon, 13 Oct 2025 12:00:00 +0200", "20251013T100000Z", "2025-10-13T10:00:00.000000000Z", "2025-10-13T12:00:00+02", "2025-10-13T12:00:00+02:00[Europe/Berlin]", "10/13/2025 3:30:00 PM IST"]
    other = ["2025-10-13T10:00:00", "10/13/2025 10:00:00 AM", "Oct 13, 2025 10:00", "n/a", None]
    raw = spark.createDataFrame([(str(i), "w", t, 5.0, "{}") for i, t in enumerate(zoned + other)], "event_id string, bucket_id string, ts_text string, duration_seconds double, data_json string")
    buckets = spark.createDataFrame([("w", "currentwindow", "c", "h")], "bucket_id string, bucket_type string, client string, hostname string")
    zones = spark.createDataFrame([("h", DAY, "Asia/Kolkata")], "hostname string, local_day date, timezone_name string")
    windows = spark.createDataFrame([("h", DAY, 1_760_293_800_000_000, 1_760_380_200_000_000)], "hostname string, day date, start_us bigint, end_us bigint")
    got, fates = records.normalised(raw, buckets, windows, zones)
    assert {r.event_id: r.start_us for r in got.collect()} == {str(i): 1_760_349_600_000_000 for i in range(len(zoned))}
    assert {r.fate: r.n for r in fates.collect()} == {"kept": len(zoned), "naive-timestamp": 3, "unreadable-timestamp": 2}
    counts = fates.where("fate <> 'kept'").withColumnRenamed("fate", "code")
    assert [m.message for m in records.diagnostic_messages(counts).orderBy("rank").collect()] == ["ignored 3 event with a naive timestamps", "ignored 2 event with an unreadable timestamps"]


def test_records_of_local_days(spark):
    """A day at +09:00 from 15:00 UTC of the day before; after its window, and for a host without any, days are UTC."""
    at = lambda d, h: dt.datetime(2025, 10, d, h)
    rows = [("1", "w", "afk", at(12, 14), at(12, 16)), ("2", "w", "afk", at(13, 14), at(14, 1)), ("3", "v", "afk", at(13, 23), at(14, 1))]
    df = spark.createDataFrame(rows, "event_id string, bucket_id string, kind string, start_ts timestamp, end_ts timestamp").withColumn("ingested_at", F.col("end_ts"))
    buckets = spark.createDataFrame([("w", "h"), ("v", "other")], "bucket_id string, hostname string")
    windows = records.day_windows(spark.createDataFrame([("h", DAY, "Asia/Tokyo")], "hostname string, day date, timezone_name string"))
    zero = int(dt.datetime(2025, 10, 13, tzinfo=dt.UTC).timestamp())
    got = sorted((r.event_id, r.day.day, *((x / 1e6 - zero) / 3600 for x in (r.start_us, r.end_us))) for r in records.day_records(df, buckets, windows, []).collect())
    assert got == [("1", 12, -10, -9), ("1", 13, -9, -8), ("2", 13, 14, 15), ("2", 13, 15, 24), ("2", 14, 24, 25), ("3", 13, 23, 24), ("3", 14, 24, 25)]
