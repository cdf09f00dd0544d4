import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from chronoloom import sinks
from chronoloom.functions import formatting as fm
from chronoloom.functions import text_safety as ts
from chronoloom.plans import digest, requests

DAY = dt.date(2025, 10, 13)


def column(spark, values, make, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(make(F.col("v"))).collect()]


def test_safe_texts():
    assert ts.safe_text("Mail a.b@x.org now") == ("Mail [redacted-email] now", 1)
    assert ts.safe_text("see https://u:p@Host.example:80/a?b=c end") == ("see host.example end", 1)
    assert ts.safe_text("token=abcdefghijklmnop") == ("[redacted-secret]", 1)
    assert ts.safe_text('token = "abcdefghijklmnop"') == ('token = "abcdefghijklmnop"', 0)
    assert ts.safe_text("Main.py") == ("main.py", 1)
    assert ts.safe_text("Page and 3 more pages - Work - Microsoft Edge") == ("Page", 1)
    assert ts.safe_text("Ｆｕｌｌ \n x") == ("Full x", 0)
    assert ts.safe_text("y" * 900) == ("y" * 500, 0)
    assert ts.safe_text("") == ts.safe_text(None) == (None, 0)
    assert ts.safe_file("/home/dev/notes.txt") == ("notes.txt", 1)
    assert ts.safe_file("C:\\work\\plan") == ("plan", 1)
    assert ts.safe_file("a.b@x.org/notes") == ("notes", 2)
    assert ts.sendable_text("/a/b", name_only=True) == "b" and ts.sendable_text(None, name_only=True) is None
    assert [ts.last_name(p) for p in ("a/b/", "a/./.", "C:x", "C:\\", "a\\b/c", "..", "xy:z", "/")] == ["b", "a", "x", "", "c", "..", "xy:z", ""]
    assert ts.safe_text("at [::1]:80/x and [bad:]/y and user:pw@HOST.org") == ("at ::1 and [redacted-url] and host.org", 1)


def test_payloads():
    ts.check_payload({"a": ["fine", 1, None, {"b": True}]})
    for bad in ({"a": ["x@y.org"]}, {"x@y.org": 1}, ["bearer abc"]):
        with pytest.raises(ts.UnsafePayloadError) as e:
            ts.check_payload(bad)
        assert "y.org" not in str(e.value)


def test_titles_to_send(spark):
    df = spark.createDataFrame([(None, None), (None, ""), ("x", "Ann (DM) - Team - Slack"), ("ms-teams.exe", "Call"), ("olk", "Inbox - Outlook"), ("thunderbird", "Calendar"), ("x", "Gmail: hello"), ("x", "mail a@b.org")], "a string, t string")
    got = [r[0] for r in df.select(ts.sendable_title(F.col("a"), F.col("t"))).collect()]
    assert got == [None, None, "Direct message - Slack", "Meeting - Microsoft Teams", "Inbox - Outlook", "Calendar - Mail", "Email - Gmail", "mail [redacted-email]"]


def test_safe_paths(spark):
    cases = {("github.com", "/a/b/c"): "/a/b", ("github.com", "/a"): None, ("gitlab.x", "/g/p/-/merge_requests/7/diffs"): "/g/p/-/merge_requests/7", ("gitlab.x", "/g/p/-/tree"): "/g/p", ("x.org", "/a/b"): None, ("login.gitlab.x", "/a/b"): None, ("gitlab.x", "/a/oauth/b"): None, (None, "/a/b"): None, ("github.com", None): None}
    df = spark.createDataFrame(list(cases), "h string, p string")
    assert [r[0] for r in df.select(ts.safe_path(F.col("h"), F.col("p"))).collect()] == list(cases.values())


def test_observations_count_changes(spark):
    row = [("h", DAY, "e", "b", "editor", 0, 1, "App", "x@y.org", "/home/p", "a/Main.py", "HOST", "/a/b", "Python", None)]
    df = spark.createDataFrame(row, "hostname string, day date, event_id string, bucket_id string, kind string, start_us bigint, end_us bigint, app string, title string, project string, file string, url_host string, url_path string, language string, status string")
    got = ts.observations(df).collect()[0]
    assert (got.evidence_id, got.title, got.project, got.file, got.url_host, got.url_path) == ("evidence-0001", "[redacted-email]", "p", "main.py", "host", None)
    assert got.changes == 1 + 1 + 2


def test_formats(spark):
    assert column(spark, [0.0, 0.4, 59.9, 60.0, 89.0, 90.0, 3600.0, 3700.0, 7260.0, -5.0], fm.duration_text, "v double") == ["0m", "<1m", "<1m", "1m", "1m", "2m", "1h", "1h 2m", "2h 1m", "0m"]
    assert column(spark, [0, 1, 1_760_372_666_000_000, -1], fm.iso_text, "v bigint") == ["1970-01-01T00:00:00+00:00", "1970-01-01T00:00:00.000001+00:00", "2025-10-13T16:24:26+00:00", "1969-12-31T23:59:59.999999+00:00"]
    assert column(spark, [1_760_372_666_000_000], lambda v: fm.clock_text(v, F.lit("Asia/Kathmandu")), "v bigint") == ["22:09"]
    assert column(spark, ["a|b\n<c>&", "\\x_y"], fm.markdown_text) == ["a\\|b &lt;c&gt;&amp;", "\\\\x\\_y"]
    assert column(spark, ["plain", "a `b` c", "``x", None], fm.code_text) == ["`plain`", "``a `b` c``", "``` ``x ```", None]
    assert column(spark, ["a/b\\c", "c", None], fm.last_part) == ["c", "c", None]


def chunks_by_loop(sizes, target, base, joint):
    out, no, held = [], 0, None
    for x in sizes:
        if held is None or held + joint + x > target:
            no, held = no + 1, base + x
        else:
            held += joint + x
        out.append(no)
    return out


def test_chunks(spark):
    sizes = [(f"k{k}", i, (i * 37 + k * 11) % 50) for k in range(4) for i in range(60)]
    df = spark.createDataFrame(sizes, "k string, i int, size bigint")
    got = {(r.k, r.i): r.chunk for r in requests.chunked(df, ["k"], ["i"], "size", 100, 7, 2).collect()}
    for k in range(4):
        mine = [s for s in sizes if s[0] == f"k{k}"]
        assert [got[s[:2]] for s in mine] == chunks_by_loop([s[2] for s in mine], 100, 7, 2)


def episodes(spark, n):
    e = ["id"]
    schema = "hostname string, day date, episode_id string, start_us bigint, end_us bigint, active_seconds double, focused_seconds double, label string, session_ids array<string>, anchors array<struct<kind:string,value:string>>, applications array<struct<value:string,count:int>>, activity_labels array<struct<value:string,count:int>>, outcome_signals array<struct<code:string,label:string,evidence_ids:array<string>>>, evidence_ids array<string>"
    rows = [("h", DAY, f"episode-{i:03}", i * 10**6, i * 10**6 + 5, 5.0, None, "a@b.org" if i == 1 else "L" * 300, e, [("title", "T"), ("title", "T"), ("file", "f")], [], [], [], e) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, schema)


def test_requests_are_bounded(spark):
    made = requests.request_plan(episodes(spark, 12), target=2_000, ceiling=2_100).orderBy("chunk").collect()
    assert len(made) > 1 and all(len(r.payload) == r.character_count <= 2_000 for r in made)
    assert [i for r in made for i in r.episode_ids] == [f"episode-{i:03}" for i in range(1, 13)]
    first = json.loads(made[0].payload)[0]
    assert first["label"] == "[redacted-email]" and first["anchors"] == [{"kind": "title", "value": "T"}, {"kind": "file", "value": "f"}]
    assert made[0].data_categories == ["anchor"]
    with pytest.raises(requests.RequestTooLargeError):
        requests.request_plan(episodes(spark, 2), target=100, ceiling=200)
    totals = requests.plan_totals(spark.createDataFrame([("h", DAY, 1, ["a"], 5), ("h", DAY, 2, ["b", "c"], 6)], "hostname string, day date, chunk int, episode_ids array<string>, character_count bigint")).collect()[0]
    assert (totals.requests, totals.episodes, totals.characters, totals.planned) == (2, 3, 11, 3)


def answer(**changes):
    stream = {"label": "L", "confidence": "high", "episode_ids": ["e1"], "topics": [{"text": "t", "evidence": ["e2"]}], "outcomes": [{"text": "o", "strength": "none", "evidence": ["e1"]}]}
    return {"schema": "chronoloom.digest.v1", "workstreams": [stream | changes], "unassigned_episode_ids": ["e2"]}


def test_digest_checks():
    good = digest.checked_digest(answer(label="mail a@b.org"), {"e1", "e2"})
    assert good["workstreams"][0]["outcomes"] == [] and good["workstreams"][0]["label"] == "mail [redacted-email]"
    bad = {
        "invalid-shape": answer() | {"more": 1},
        "invalid-schema": answer() | {"schema": "x"},
        "empty-ids": answer(episode_ids=[]),
        "unknown-ids": answer(episode_ids=["e9"]),
        "duplicate-ids": answer(episode_ids=["e1", "e1"]),
        "invalid-enum": answer(confidence="sure"),
        "invalid-text": answer(label="x" * 121),
        "empty-evidence": answer(topics=[{"text": "t", "evidence": []}]),
        "invalid-episode-allocation": answer(episode_ids=["e1", "e2"]),
    }
    for code, payload in bad.items():
        with pytest.raises(digest.DigestError) as e:
            digest.checked_digest(payload, {"e1", "e2"})
        assert e.value.code == code
    group = {"label": "g", "confidence": "low", "provisional_ids": ["p1"]}
    assert digest.checked_merge({"schema": "chronoloom.merge.v1", "groups": [group]}, {"p1", "p2"})
    with pytest.raises(digest.DigestError):
        digest.checked_merge({"schema": "chronoloom.merge.v1", "groups": [group, group]}, {"p1"})


def test_digest_tables(spark):
    schema = "hostname string, day date, place int, provisional_id string, label string, confidence string, episode_ids array<string>, topics array<string>, outcomes array<string>"
    rows = [("h", DAY, i, f"p{i}", f"l{i}", "low", [f"e{i}"], ["t", f"t{i}"], ["o"]) for i in range(4)]
    groups = spark.createDataFrame([("h", DAY, 0, "both", "high", ["p3", "p1"])], "hostname string, day date, group_no int, label string, confidence string, provisional_ids array<string>")
    got = digest.merged(spark.createDataFrame(rows, schema), groups).orderBy("place").collect()
    assert [(r.label, r.confidence, r.episode_ids, r.topics, r.outcomes) for r in got] == [("l0", "low", ["e0"], ["t", "t0"], ["o"]), ("both", "high", ["e3", "e1"], ["t", "t3", "t1"], ["o"]), ("l2", "low", ["e2"], ["t", "t2"], ["o"])]
    items = episodes(spark, 3)
    streams = spark.createDataFrame([("h", DAY, 1, ["episode-001", "episode-002"])], "hostname string, day date, workstream int, episode_ids array<string>")
    assert digest.rolled_up(streams, items).collect()[0].active_seconds == 10.0
    rest = digest.unassigned(streams, items)
    assert [r.episode_id for r in rest.collect()] == ["episode-003"]
    assert digest.misallocated(streams, rest, items).count() == 0
    assert {(r.episode_id, r.times) for r in digest.misallocated(streams, items.where("episode_id = 'episode-001'"), items).collect()} == {("episode-001", 2), ("episode-003", 0)}


def test_unknown_episodes_are_an_error(spark):
    streams = spark.createDataFrame([("h", DAY, 0, ["episode-001", "episode-009"])], "hostname string, day date, workstream int, episode_ids array<string>")
    with pytest.raises(digest.DigestError, match="unknown-ids"):
        digest.checked_roll_up(streams, episodes(spark, 3))
    assert ts.holds_secret("token=abcdefghijklmnop") and not ts.holds_secret("a token")


def test_a_day_is_summarised(spark):
    """Two requests, one answered wrongly at first, merged into one workstream."""
    asked = []

    def ask(request):
        asked.append(request)
        ids = request["episode_ids"]
        wrong = ids[0] == "episode-002" and "repair_instruction" not in request
        stream = {"label": f"a|b {ids[0]}", "confidence": "low", "episode_ids": ids[:1], "topics": [{"text": "t", "evidence": ids[:1]}], "outcomes": [{"text": "o", "strength": "likely", "evidence": ids[:1]}]}
        return {"schema": "chronoloom.digest.v1", "workstreams": [stream], "unassigned_episode_ids": ids if wrong else ids[1:]}

    def merge(offer):
        ids = [w["id"] for w in offer["provisional_workstreams"]]
        return {"schema": "chronoloom.merge.v1", "groups": [{"label": "both", "confidence": "high", "provisional_ids": ids[::-1]}]}

    plan = [{"episode_ids": ["episode-001"], "payload": "[]"}, {"episode_ids": ["episode-002", "episode-003"], "payload": "[]"}]
    made, exchanges = digest.summarised(plan, ask, merge)
    assert exchanges == 4 and len(asked) == 3
    assert [w["episode_ids"] for w in made["workstreams"]] == [["episode-002", "episode-001"]] and made["unassigned_episode_ids"] == ["episode-003"]
    streams, rest = digest.digest_rows(spark, made, "h", DAY)
    doc = json.loads(sinks.digest_json(streams, rest, episodes(spark, 3), {"provider": "p", "model": "m", "input_tokens": None}).collect()[0].json)
    assert doc["workstreams"][0]["active_seconds"] == 10.0 and [a["id"] for a in doc["workstreams"][0]["activity"]] == ["episode-002", "episode-001"]
    assert [a["id"] for a in doc["unassigned_activity"]] == ["episode-003"] and doc["summary"] == {"provider": "p", "model": "m", "input_tokens": None}
    text = sinks.digest_markdown(streams, rest, episodes(spark, 3), "p", "m", details=True).collect()[0].markdown
    assert "| **both** | Likely: o<br>Likely: o | t<br>t |" in text, text
    assert "Primary allocation · High confidence · <1m" in text and text.rstrip().endswith("`episode-003`")
    with pytest.raises(digest.DigestError):
        digest.summarised(plan, lambda r: answer(), merge)


def test_a_failed_summary_is_an_outcome():
    """Tokens are summed while every answer tells them, JSON texts are read, and a failure holds codes only."""
    plan = [{"episode_ids": ["episode-001"], "payload": "[]"}, {"episode_ids": ["episode-002"], "payload": "[]"}]
    told = []

    def ask(request):
        assert request["prompt"] and request["schema"]["properties"]
        body = {"schema": "chronoloom.digest.v1", "workstreams": [], "unassigned_episode_ids": request["episode_ids"]}
        return json.dumps(body), {"input_tokens": 5, "output_tokens": None if request["episode_ids"] == ["episode-002"] else 2}

    made = digest.summarised_or_not(plan, ask, None, "p", "m", lambda label, seconds: told.append(label))
    assert made.failure is None and made.digest["unassigned_episode_ids"] == ["episode-001", "episode-002"]
    assert made.exchanges == 2 and made.tokens == {"input_tokens": 10, "output_tokens": None} and told == ["part 1 of 2", "part 2 of 2"]

    def fails(request):
        raise OSError("what was sent")

    for ask_badly, code in ((fails, "provider-failed"), (lambda r: "no JSON", "invalid-shape"), (lambda r: [1], "invalid-shape")):
        made = digest.summarised_or_not(plan, ask_badly, None, "p", "m")
        assert made.digest is None and made.failure["validation"]["code"] == code and "sent" not in json.dumps(made.failure)
        assert code in digest.failure_text(made.failure)
    assert digest.parsed_response({"a": 1}) == {"a": 1}


def test_requests_are_canonical(spark):
    rows = [('{"b": {"z": null, "a": "ä"}, "a": null}',), (None,)]
    got = spark.createDataFrame(rows, "x string").select(requests.compact_json("x")).collect()
    assert [r[0] for r in got] == ['{"b": {"a": "ä", "z": null}}', None]
    plan = requests.request_plan(episodes(spark, 2))
    one = requests.single_request(plan).collect()
    assert len(one) == 1 and one[0].character_count == len(one[0].payload) == len(json.dumps(json.loads(one[0].payload), ensure_ascii=False, sort_keys=True))
    with pytest.raises(requests.RequestTooLargeError):
        requests.single_request(requests.request_plan(episodes(spark, 12), target=2_000, ceiling=2_500))


def test_forms_and_failures():
    schema = digest.form_schema(digest.DIGEST_FORM, ["e1"])
    assert schema["properties"]["workstreams"]["items"]["properties"]["episode_ids"] == {"type": "array", "items": {"type": "string", "enum": ["e1"]}, "maxItems": 1, "minItems": 1}
    assert digest.form_schema(digest.DIGEST_FORM, [])["properties"]["unassigned_episode_ids"]["maxItems"] == 0
    shape = digest.response_shape(answer(episode_ids=["e1", "e1", "secret text"]), {"e1", "e2"})
    assert shape["workstream_count"] == 1 and shape["known_allocated_ids"] == ["e1"] and shape["unknown_id_count"] == 1 and shape["duplicate_id_count"] == 1 + 0
    kept = digest.failure_record(digest.DigestError("invalid-text", "workstreams[0].label"), "prov ider", "m-1", shape, "r:1")
    assert kept["provider"] == "[redacted-provider]" and kept["model"] == "m-1" and kept["request_id"] == "r:1" and "secret" not in json.dumps(kept)
