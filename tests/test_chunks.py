"""Sessions, periods and gaps over small chunks against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators.activity_sessions import activity_sessions, host_sessions
from chronoloom.operators.interval_sets import bucket_periods, merge_runs, periods_and_gaps

SCHEMA = "key string, s bigint, e bigint, start_us string, _chunk int"


def rows(seed: int, n: int = 400) -> list[tuple]:
    r = random.Random(seed)
    out = []
    for _ in range(n):
        key = r.choice(["hot"] * 6 + ["a", None])
        s = r.randrange(0, 20_000)
        out.append((key, None if r.random() < 0.03 else s, r.choice([None, s, s - 5, s + r.randrange(1, 30), s + r.choice([40, 900, 3000])]), "clash", 1))
    return out + out[:20]


def sessions_by_loop(data: list[tuple], gap: int) -> list[tuple]:
    out = []
    for key in {d[0] for d in data}:
        mine = sorted((s, s if e is None or e < s else e) for k, s, e, *_ in data if k == key and s is not None)
        for s, e in mine:
            if out and out[-1][0] == key and s <= out[-1][2] + gap:
                out[-1] = (key, out[-1][1], max(out[-1][2], e), out[-1][3] + 1)
            else:
                out.append((key, s, e, 1))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [50, 700, 10**9])
@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_don_t_depend_on_chunks(spark, seed, chunk):
    data = rows(seed)
    got = activity_sessions(spark.createDataFrame(data, SCHEMA), "key", 10, chunk).select("key", "start_us", "end_us", "n_events").collect()
    assert sorted(map(tuple, got), key=repr) == sessions_by_loop(data, 10)


def test_lists_merge_linearly():
    """Partial lists of random intervals, in any split, give the union of all."""
    r = random.Random(5)
    for _ in range(200):
        groups = [[(s, s + r.randrange(1, 20)) for s in (r.randrange(200) for _ in range(r.randrange(1, 15)))] for _ in range(r.randrange(1, 4))]
        flat = [(g, s, e) for g, x in enumerate(groups) for s, e in x]
        got = merge_runs(*[np.array(c) for c in zip(*flat)], np.zeros(len(flat), dtype=bool))
        want = [(g, s, e) for g, x in enumerate(groups) for _, s, e, _ in sessions_by_loop([(g, s, e) for s, e in x], 0)]
        assert list(zip(*[c.tolist() for c in got[:3]])) == sorted(want)


@pytest.mark.parametrize(("chunk", "fan"), [(50, 2), (50, 64), (700, 3), (10**9, 64)])
def test_periods_and_gaps(spark, chunk, fan):
    data = rows(3)
    want = []
    for key in {d[0] for d in data}:
        mine = sessions_by_loop([d for d in data if d[0] == key and d[1] is not None and d[2] is not None and d[2] > d[1]], 0)
        want += [(key, "period", s, e) for _, s, e, _ in mine] + [(key, "gap", a[2], b[1]) for a, b in zip(sorted(mine, key=lambda m: m[1]), sorted(mine, key=lambda m: m[1])[1:]) if b[1] - a[2] <= 60]
    got = periods_and_gaps(spark.createDataFrame(data, SCHEMA), "key", 60, chunk, fan).select("key", "piece", "start_us", "end_us").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_limits_are_inclusive(spark):
    data = [("k", 0, 10), ("k", 20, 30), ("k", 41, 42)]
    got = activity_sessions(spark.createDataFrame(data, "key string, s bigint, e bigint"), "key", 10).select("start_us", "end_us").collect()
    assert sorted(map(tuple, got)) == [(0, 30), (41, 42)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert activity_sessions(none, "key").count() == 0
    assert periods_and_gaps(none, "key").count() == 0


def activity(spark, data):
    cols = "event_id string, bucket_id string, kind string, s double, e double, ingested double, app string"
    df = spark.createDataFrame(data, cols)
    return df.select("event_id", "bucket_id", "kind", "app", *[F.timestamp_micros((F.col(a) * 1e6).cast("long")).alias(b) for a, b in (("s", "start_ts"), ("e", "end_ts"), ("ingested", "ingested_at"))])


def test_restated_events_count_once(spark):
    df = activity(spark, [("1", "b", "editor", 0.0, 10.0, 1.0, None), ("1", "b", "editor", 0.0, 500.0, 2.0, None), ("1", "b", "editor", 0.0, 500.0, 2.0, None), ("2", "b", "afk", 10_000.0, 10_001.0, 1.0, None), ("3", "b", None, 700.0, None, 1.0, None), (None, "b", "browser", 5_000.0, 5_001.0, 1.0, None), (None, "b", "browser", 5_002.0, 5_003.0, 1.0, None), ("9", "unknown", "browser", 0.0, 1.0, 1.0, None)])
    buckets = spark.createDataFrame([("b", "h"), (None, "x")], "bucket_id string, hostname string")
    got = host_sessions(df, buckets).select("hostname", "start_us", "end_us", "n_events").collect()
    assert sorted(map(tuple, got)) == [("h", 0, 700_000_000, 2), ("h", 5_000_000_000, 5_003_000_000, 2)]
    periods = bucket_periods(df.where("event_id = '1'")).collect()
    assert [tuple(p) for p in periods] == [("b", "period", 0, 500_000_000)]
