import itertools
import random

import pytest
from pyspark.sql import functions as F

from chronoloom.llm import event_runs as module
from chronoloom.llm.event_runs import activity_runs, content, content_key, dissimilarity, event_runs, optimal_segments, stable_text

SAME = [
    ("(12) Release notes - App", "Release notes - App"),
    ("65% - build one - App", "build one [12%] - App"),
    ("02:10:32 - Meeting 11:19 Brindal - App", "Meeting 11:19 Brindal - 30:18 - App", "Meeting 11:19 Brindal - App [05:32]"),
    ("* a.docx - App", "a.docx [unsaved] - App", "a.docx - saved 14:46 - App", "a.docx (edited 7 min ago) - App", "•a.docx - App", "A.DOCX - APP"),
    ("#chan - 9 new messages - App", "#chan (21 unread) - App", "[3] #chan - App", "! #chan - App", "#chan​ -  App"),
    ("Page and 14 more pages - App", "Page - App"),
    ("⠋ ssh x - App", "ssh х - App"),
]
OTHER = ["Release 13.1 - App", "Release 13.2 - App", "Invoice 20041", "Invoice 20042", "(702) 555-0126 - Voicemail", "(415) 555-0126 - Voicemail", "(01632) 960444", "(01632) 960445", "plan v6", "plan v7", "11 tips", "12 tips", "Meeting 11:19 x", "Meeting 11:20 x", "Re: a", "a", "", "Chat with A", "Chat with B", "Log 2025-08-10 15:17", "Log 2025-08-10 15:18", "build 10.0.1", "build 10.0.2", "a.rs - one", "a.rs - two"]


def test_marks_that_change():
    for group in SAME:
        assert len({stable_text(t) for t in group}) == 1, group
    assert len({stable_text(t) for t in OTHER}) == len(OTHER)
    assert stable_text("(5)") == "(5)" and stable_text(None) is None
    assert len({content_key(a, t) for a, t in itertools.product([None, "", "x"], repeat=2)}) == 9


def cost(n, starts, d, penalty):
    return penalty * (len(starts) - 1) + sum(d(j, max(s for s in starts if s <= j)) for j in range(n) if j not in starts)


@pytest.mark.parametrize("seed", range(40))
def test_segments_are_optimal(seed):
    """Against all segmentations, for dissimilarities between neighbours, some of them infinite."""
    r = random.Random(seed)
    n, penalty = r.randrange(1, 11), r.choice([0.3, 1.0, 2.5])
    between = [r.choice([0, 0, 0.2, 0.7, 1.5, None]) for _ in range(n)]
    got = optimal_segments(n, lambda j, i, s: between[j], penalty)
    inf = float("inf")
    d = lambda j, s: inf if between[j] is None else between[j]
    best = min(cost(n, [0, *c], d, penalty) for k in range(n) for c in itertools.combinations(range(1, n), k))
    assert got[0] == 0 and abs(cost(n, got, d, penalty) - best) < 1e-9


def loop(rows, gap):
    out = []
    rows = sorted((r for r in rows if r[2] is not None), key=lambda r: (str(r[1]), r[2], r[0]))
    for i, b, s, e, k in rows:
        e = s if e is None or e < s else e
        if out and out[-1][0] == (b, k) and s <= out[-1][4] + gap:
            out[-1][2], out[-1][4], out[-1][5] = i, max(out[-1][4], e), out[-1][5] + 1
        else:
            out.append([(b, k), i, i, s, e, 1])
    return sorted((b, i, j, s, e, e - s, n) for (b, _), i, j, s, e, n in out if True)


@pytest.mark.parametrize("chunk", [40, 300, 10**9])
@pytest.mark.parametrize("seed", range(3))
def test_runs_dont_depend_on_chunks(spark, seed, chunk):
    r = random.Random(seed)
    starts = r.sample(range(4000), 500)
    rows = [(f"{i:04}", r.choice(["hot"] * 5 + ["b"]), s, r.choice([None, s - 1, s + 3, s + r.randrange(60), s + 700]), r.choice([1] * (seed * 4 + 1) + [2, 3])) for i, s in enumerate(starts)]
    df = spark.createDataFrame(rows, "event_id string, bucket_id string, s bigint, e bigint, key bigint").withColumn("n_events", F.lit("clash")).withColumn("extra", F.lit(None).cast("array<bigint>"))
    assert sorted(map(tuple, event_runs(df, 10, chunk_us=chunk).collect())) == loop(rows, 10)


def test_activity(spark):
    rows = [("1", "b", "browser", 0, 10, "A.exe", "(1) x"), ("2", "b", "browser", 60, 61, "a.EXE", "(2) x"), ("3", "b", "afk", 61, 62, None, None), ("4", "b", "browser", 200, None, None, None), ("5", "b", "browser", 260, 261, None, None), ("6", "b", "browser", 262, 263, "", None), (None, "b", "browser", 9000, None, "q", "q")]
    df = spark.createDataFrame(rows, "event_id string, bucket_id string, kind string, a int, z int, app string, title string")
    df = df.withColumns({"start_ts": F.timestamp_seconds("a"), "end_ts": F.timestamp_seconds("z"), "ingested_at": F.timestamp_seconds("a")})
    got = activity_runs(df.union(df)).where("n_events > 1").select("bucket_id", "first_event_id", "last_event_id", "n_events").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("b", "1", "2", 2), ("b", "4", "5", 2), ("b", None, None, 2)], key=str)
    assert activity_runs(df.limit(0)).count() == 0


def near_loop(rows, gap, penalty):
    """Boundaries where a greedy walk over neighbours must make them, since costs lie between neighbours."""
    out, was = [], None
    for i, b, s, e, k, x in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        top = out[-1][4] if out and out[-1][0] == (b, k) else None
        if top is not None and s <= top + gap and dissimilarity(was, x) <= penalty:
            out[-1][2], out[-1][4], out[-1][5] = i, max(top, e), out[-1][5] + 1
        else:
            out.append([(b, k), i, i, s, max(top or e, e), 1])
        was = x
    return sorted((b, i, j, n) for (b, _), i, j, s, e, n in out)


@pytest.mark.parametrize("chunk", [30, 200, 10**9])
def test_decorations_and_the_penalty(spark, chunk):
    r = random.Random(chunk)
    rows = [(f"{i:04}", r.choice("ab"), s, s + r.choice([0, 3, 40, 200]), r.choice([1, 1, 1, 1, 2]), r.choice([None, None, [1], [1, 2], [3]])) for i, s in enumerate(r.sample(range(3000), 400))]
    df = spark.createDataFrame(rows, "event_id string, bucket_id string, s bigint, e bigint, key bigint, extra array<bigint>")
    for penalty in (1.0, 0.5, 2.0):
        got = event_runs(df, 10, penalty, chunk_us=chunk).select("bucket_id", "first_event_id", "last_event_id", "n_events").collect()
        assert sorted(map(tuple, got)) == near_loop(rows, 10, penalty)


def test_marks_that_are_not_listed():
    """A decoration that comes or goes is cheaper than a boundary, one in place of another, a document's name or a number isn't."""
    whole = lambda t: content("x", t)
    d = lambda a, b: dissimilarity(whole(a)[1], whole(b)[1]) if whole(a)[0] == whole(b)[0] else float("inf")
    for other in ("report (recovered) - App", "[not responding] report - App", "▲ report - App", "report {private browsing} - App", "(3) report (recovered) - App"):
        assert 0 < d("report - App", other) <= 1 < d("report (recovering) - App", "report (recovered) - App")
    for other in ("report (copy) - App", "report (2) - App", "report two - App", "(draft) report - App", "Re: report - App"):
        assert d("report - App", other) > 1


@pytest.mark.parametrize("hold", [2, 7, 50])
def test_rows_are_let_go(hold, monkeypatch):
    r = random.Random(hold)
    for _ in range(200):
        n = r.randrange(1, 40)
        s = sorted(r.sample(range(300), n))
        key = [r.choice([1, 1, 1, 2]) for _ in range(n)]
        rows = [s, [x + r.choice([0, 2, 40]) for x in s], key, [r.choice([None, [1], [2]]) for _ in s], [str(i) for i in range(n)]]
        whole, parts, at = [], [], 0
        monkeypatch.setattr(module, "HOLD_ITEMS", 10**9)
        chunk = module._Chunk(("b", 0), 5, 1.0)
        chunk.more(rows, [])
        chunk.end(whole)
        monkeypatch.setattr(module, "HOLD_ITEMS", hold)
        chunk = module._Chunk(("b", 0), 5, 1.0)
        while at < n:
            step = r.randrange(1, 6)
            chunk.more([c[at : at + step] for c in rows], parts)
            at += step
        chunk.end(parts)
        assert parts == whole
