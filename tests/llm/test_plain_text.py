import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoloom.llm.plain_text import not_plain, plain_text, with_plain_text

CASES = {
    None: None,
    "": "",
    "plain - text": "plain - text",
    "Ｃａｆé": "Café",
    "Café": "Café",
    "ﬁle Kelvin Ⅷ ⅰⅿage": "file Kelvin VIII image",
    "a b c　d": "a b c d",
    "well‑known‐thing": "well-known-thing",
    "In​vi­si﻿ble͏ ‎end": "Invisible end",
    "Рostbote": "Postbote",
    "Отчёт о работе": "Отчёт о работе",
    "Oтчёт о работе": "Отчёт о работе",
    "Ζedmаrk": "Zedmark",
    "sѕһ bench": "ssh bench",
    "planificaсіо\u0301n": "planificación",
    "Περίληψη": "Περίληψη",
    "週間計画の確認 メモ": "週間計画の確認 メモ",
    "Tシャツ": "Tシャツ",
    "team 👩‍💻 standup": "team 👩‍💻 standup",
    "جلسه‌ها": "جلسه‌ها",
    "abc‌def": "abcdef",
    "क्‍ष": "क्‍ष",
    "x² ™ ½ …": "x² ™ ½ …",
    "ｱｲ": "アイ",
    "plan В, с": "plan B, c",  # words wholly of look-alikes, in a Latin text
}


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert plain_text(text) == CASES[text]


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=40))
def test_again_changes_nothing(text):
    once = plain_text(text)
    assert plain_text(once) == once


def test_very_long_text():
    assert plain_text("аb" * 200_000) == "ab" * 200_000


def test_columns(spark):
    df = spark.createDataFrame([(t, "keep") for t in CASES] * 2, "title string, plain string")
    got = with_plain_text(df, "title", "to").collect()
    assert [r["to"] for r in got] == [CASES[r.title] for r in got] and all(r.plain == "keep" for r in got)
    assert with_plain_text(df.limit(0), "title", "to").count() == 0


def test_found(spark):
    rows = [("1", 1, "Café", "x.exe", "t"), ("2", 1, "Café", None, "t"), ("3", 1, None, "Ｔａｂ", "t"), ("3", 1, None, "Ｔａｂ", "t"), ("4", 1, "one script: В", "Отчёт", "t"), (None, 1, "Ｔ", "Ｔ", "t")]
    df = spark.createDataFrame(rows, "event_id string, n int, title string, app string, field string")
    df = df.withColumns({c: F.timestamp_seconds("n") for c in ("start_ts", "end_ts", "ingested_at")})
    assert sorted(map(tuple, not_plain(df).collect())) == [("2", "title"), ("3", "app")]
    assert not_plain(df.limit(0)).count() == 0
