import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import timestamps
from chronoloom.operators.timestamps import EITHER_ORDER, MONTH_FIRST_SLASHES, event_instants, normalise_timestamps


def us(*a, micro=0):
    return int(dt.datetime(*a, tzinfo=dt.UTC).timestamp()) * 1_000_000 + micro


CASES = {
    "2025-10-13T16:24:26,326Z": us(2025, 10, 13, 16, 24, 26, micro=326_000),
    "2025-10-13t16:24:26.1234569+05": us(2025, 10, 13, 11, 24, 26, micro=123_456),
    "  2025-10-13 16:24:26 -0230 ": us(2025, 10, 13, 18, 54, 26),
    "2025-10-06T10:28:21.278−05:00": us(2025, 10, 6, 15, 28, 21, micro=278_000),
    "20251013T162426+0545": us(2025, 10, 13, 10, 39, 26),
    "Mon, 13 Oct 2025 16:24:26 GMT": us(2025, 10, 13, 16, 24, 26),
    "Oct 13, 2025, 4:24:26 pm": us(2025, 10, 13, 14, 24, 26),
    "10/13/2025 12:05:09 AM": us(2025, 10, 12, 22, 5, 9),
    "13.10.2025 16:24": us(2025, 10, 13, 14, 24),
    "2025/10/13 16:24:26 CET": us(2025, 10, 13, 15, 24, 26),
    "2025-10-13 16:24:26 Asia/Kathmandu": us(2025, 10, 13, 10, 39, 26),
    "2025-10-13T16:24:26+02:00[America/New_York]": us(2025, 10, 13, 14, 24, 26),
    "1760372666": us(2025, 10, 13, 16, 24, 26),
    "1760372666.25": us(2025, 10, 13, 16, 24, 26, micro=250_000),
    "1760372666123": us(2025, 10, 13, 16, 24, 26, micro=123_000),
    "1760372666123456": us(2025, 10, 13, 16, 24, 26, micro=123_456),
    "1760372666123456789": us(2025, 10, 13, 16, 24, 26, micro=123_456),
    "2025-10-26 02:30:00": us(2025, 10, 26, 0, 30),  # twice: the earlier
    "2025-03-30 02:30:00": us(2025, 3, 30, 1, 30),  # skipped: moves on by an hour
    "2025-02-30T10:00:00Z": None,
    "25:61": None,
    "2025-10-13T25:00:00Z": None,
    "13/10/2025 10:00:00": None,  # month first
    "n/a": None,
    "": None,
    None: None,
    "2025-10-14 10:00:00": None,  # no window of that day
    "2025-10-15 10:00:00": None,  # a window without a zone
    "2025-10-21 10:00:00": us(2025, 10, 21, 10),
}


@pytest.fixture(scope="module")
def windows(spark):
    days = [("h", d, z) for d, z in (("2025-10-13", "W. Europe Standard Time"), ("2025-10-13", "europe/berlin "), ("2025-10-26", "CET"), ("2025-03-30", "Europe/Berlin"), ("2025-10-15", None), ("2025-10-20", "+05:30"), ("2025-10-21", " Z"))]
    return spark.createDataFrame(days, "hostname string, local_day string, timezone_name string").withColumn("local_day", F.col("local_day").cast("date"))


def test_layouts(spark, windows):
    rows = [(i, t, "h") for i, t in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, ts_text string, hostname string").withColumn("status", F.lit("clash"))
    got = {r.ts_text: r.instant_us if r.status != "noise" else None for r in normalise_timestamps(df.drop("status"), "ts_text", "hostname", windows, MONTH_FIRST_SLASHES).collect()}
    assert got == CASES


def test_status(spark, windows):
    df = spark.createDataFrame([("2025-10-14 10:00", "h"), ("no", "h"), ("1760372666", "h"), ("2025-10-20 10:00:00", "h")], "ts_text string, hostname string")
    got = {r.ts_text: r.status for r in normalise_timestamps(df, "ts_text", "hostname", windows).collect()}
    assert got == {"2025-10-14 10:00": "no_zone", "no": "invalid", "1760372666": "resolved", "2025-10-20 10:00:00": "resolved"}


def test_changes_of_the_clocks(spark, windows):
    """A repeated local time is ambiguous, the earlier instant comes out; a skipped one moves on and is sure."""
    df = spark.createDataFrame([("2025-10-26 02:30:00", "h"), ("2025-03-30 02:30:00", "h"), ("2025-10-26 04:30:00", "h"), ("2025-10-26 02:30:00 +01:00", "h")], "ts_text string, hostname string")
    got = {r.ts_text[:16] + r.ts_text[19:]: (r.instant_us, r.status, r.dst) for r in normalise_timestamps(df, "ts_text", "hostname", windows).collect()}
    assert got["2025-10-26 02:30"] == (us(2025, 10, 26, 0, 30), "ambiguous", "repeated")
    assert got["2025-03-30 02:30"] == (us(2025, 3, 30, 1, 30), "resolved", "skipped")
    assert got["2025-10-26 04:30"] == (us(2025, 10, 26, 3, 30), "resolved", None)
    assert got["2025-10-26 02:30 +01:00"] == (us(2025, 10, 26, 1, 30), "resolved", None)


def test_posteriors_choose_the_unit(spark, windows):
    """Every unit of a number is a reading; what was received when, and the source's other numbers, tell which."""
    rows = [("1760372666", "a", "2025-10-13 16:25:00"), ("1760372666123", "a", "2025-10-13 16:25:00"), ("1760372666123", "a", None), ("999999999", "b", "2001-09-09 02:00:00"), ("99999999900", "b", "1973-03-04 00:00:00")]
    df = spark.createDataFrame(rows, "ts_text string, hostname string, received string").withColumn("at", F.col("received").cast("timestamp"))
    got = sorted((len(r.ts_text), r.component, r.status) for r in normalise_timestamps(df, "ts_text", "hostname", windows, near=F.col("at")).collect())
    assert got == [(9, "epoch_s", "resolved"), (10, "epoch_s", "resolved"), (11, "epoch_ms", "resolved"), (13, "epoch_ms", "resolved"), (13, "epoch_ms", "resolved")]


def test_a_source_may_outweigh_a_convention(spark, windows):
    texts = [(f"{d}/02/2025 10:00:00 +00:00", "h") for d in range(13, 29)] * 20 + [("03/04/2025 10:00:00 +00:00", "h"), ("13/10/2025 10:00:00 +00:00", "other")]
    out = normalise_timestamps(spark.createDataFrame(texts, "ts_text string, hostname string"), "ts_text", "hostname", windows, {"slash_mdy": 50.0, "slash_dmy": 0.05})
    assert out.where("ts_text like '03%'").first().component == "slash_dmy"
    strict = normalise_timestamps(spark.createDataFrame(texts[-1:], "ts_text string, hostname string"), "ts_text", "hostname", windows, MONTH_FIRST_SLASHES)
    assert strict.first().status == "noise"


def test_the_mixture_of_a_source_chooses_the_order(spark, windows):
    """Days above 12 show which order a source writes; readings of its other dates follow, and a source that shows nothing stays ambiguous."""
    texts = [(f"{d}/02/2025 10:00:00 +00:00", "day") for d in range(13, 29)] + [("03/04/2025 10:00:00 +00:00", "day")]
    texts += [(f"02/{d}/2025 10:00:00 +00:00", "month") for d in range(13, 29)] + [("03/04/2025 10:00:00 +00:00", "month"), ("03/04/2025 10:00:00 +00:00", "none"), ("05/05/2025 10:00:00 +00:00", "none")]
    df = spark.createDataFrame(texts, "ts_text string, hostname string")
    out = normalise_timestamps(df, "ts_text", "hostname", windows, EITHER_ORDER)
    got = {(r.hostname, r.ts_text[:5]): (r.instant_us, r.status) for r in out.where("ts_text like '0%'").collect()}
    assert got["day", "03/04"] == (us(2025, 4, 3, 10), "resolved")
    assert got["month", "03/04"] == (us(2025, 3, 4, 10), "resolved")
    assert got["none", "03/04"][1] == "ambiguous"
    assert got["none", "05/05"] == (us(2025, 5, 5, 10), "resolved")


def test_abbreviations_follow_the_host(spark):
    """IST and CST mean several offsets; the host's zone decides, and where a day has no window, the host's other days."""
    w = spark.createDataFrame([("in", "2025-10-13", "Asia/Kolkata"), ("il", "2025-10-13", "Asia/Jerusalem")], "hostname string, local_day string, timezone_name string").withColumn("local_day", F.col("local_day").cast("date"))
    rows = [("2025-10-13 12:00:00 IST", h) for h in ("in", "il") for _ in range(30)] + [("2025-10-14 12:00:00 IST", h) for h in ("in", "il")]
    out = normalise_timestamps(spark.createDataFrame(rows, "ts_text string, hostname string"), "ts_text", "hostname", w)
    got = {(r.hostname, r.ts_text[8:10]): r.instant_us for r in out.collect()}
    assert got == {("in", "13"): us(2025, 10, 13, 6, 30), ("in", "14"): us(2025, 10, 14, 6, 30), ("il", "13"): us(2025, 10, 13, 10), ("il", "14"): us(2025, 10, 14, 10)}


def test_events_once_and_empty(spark, windows):
    buckets = spark.createDataFrame([("b", "h")], "bucket_id string, hostname string")
    schema = "event_id string, bucket_id string, ts_text string, received_at timestamp, instant_us string"
    now = dt.datetime(2025, 10, 13)
    rows = [("1", "b", "1760372666", now, "x"), ("1", "b", "2025-10-13T16:24:26Z", now, "x"), ("2", "b", "?", now, "x"), ("3", "other", "2025-10-13 10:00", now, "x"), ("4", "other", "2025-10-13 10:00Z", now, "x"), (None, "b", "1760372666", now, "x")]
    got = event_instants(spark.createDataFrame(rows, schema), buckets, windows).select("event_id", "instant_us").collect()
    assert sorted(map(tuple, got)) == [("1", us(2025, 10, 13, 16, 24, 26)), ("4", us(2025, 10, 13, 10))]
    assert event_instants(spark.createDataFrame([], schema), buckets, windows).count() == 0


def test_choices_meet_by_number(spark, monkeypatch):
    """What is broadcast has no texts of kinds; where numbers don't tell kinds apart, the texts are joined."""
    flat = spark.createDataFrame([(i, f"h{i % 3}", [None, "", "ymd=0", "epoch_s=0;epoch_ms=-20"][i % 4]) for i in range(24)], "i int, _source string, kind string")
    fitted = spark.createDataFrame([(f"h{i}", k, i, k[:5], 1.0, 0.0) for i in range(3) for k in ("ymd=0", "epoch_s=0;epoch_ms=-20")], "_source string, kind string, best int, component string, posterior double, noise double")
    want = sorted(map(repr, flat.join(fitted, ["_source", "kind"], "left").select("i", "_source", "kind", "best", "component").collect()))
    joined = timestamps.with_choices(flat, fitted)
    broadcast = [line for line in joined._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastExchange" in line]
    assert broadcast and all("string" not in line for line in broadcast)
    assert sorted(map(repr, joined.select("i", "_source", "kind", "best", "component").collect())) == want
    monkeypatch.setattr(timestamps, "choice_key", lambda: F.lit(1))
    assert sorted(map(repr, timestamps.with_choices(flat, fitted).select("i", "_source", "kind", "best", "component").collect())) == want
