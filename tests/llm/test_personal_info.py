import pytest
from pyspark.sql import functions as F

from chronoloom.llm import personal_info as pi

PEOPLE = [("Zoëlia", "Dunwillow"), ("Dorvik", "Prellinger"), ("Orsolin", "Søndrick"), ("Bexil", "Müllvack"), (None, "Nobody"), ("", "Empty")]
FOUND = {
    "Mail to a.b+c@mail.example.org: x": "Mail to [EMAIL]: x",
    "a_b AT mail DOT example DOT org - account": "[EMAIL] - account",
    "x [at] example [dot] com and y (at) example.com": "[EMAIL] and [EMAIL]",
    "sprellinger @ example.org - x": "[EMAIL] - x",
    "/users/a.b%40example.com/edit": "/users/[EMAIL]/edit",
    "export_a@example.org.csv": "[EMAIL].csv",
    "Call +44 20 7946 0504, (702) 555-0126 or 07700 900349": "Call [PHONE], [PHONE] or [PHONE]",
    "+1 415 555 0141 (9 unread), +44 (0)20 7946 0504 (44 %)": "[PHONE] (9 unread), [PHONE] (44 %)",
    "/tel:01-99-00-93-21": "/tel:[PHONE]",
    "70  WILLOWMERE\u3000STREET,  KELMOUTH": "[ADDRESS],  KELMOUTH",
    "Prellinger,  Dorvik (DM)": "[NAME] (DM)",
    "ID  card #M07X73T542": "ID  card #[ID_NUMBER]",
    "tel 1-415-555-0111 x31 / pipeline": "tel [PHONE] / pipeline",
    "030/23125-655; 0049 30 23125894; 01 99 00 40 46": "[PHONE]; [PHONE]; [PHONE]",
    "/call/%2B61%202%205550%200343": "/call/[PHONE]",
    "SSN 666-64-915͏8 | QQ 12 34 56 C": "SSN [ID_NUMBER] | [ID_NUMBER]",
    "Tax ID: 99 861 260 483 - x": "Tax ID: [ID_NUMBER] - x",
    "Form for C39521068 (Reisepass)": "Form for [ID_NUMBER] (Reisepass)",
    "id-card_M74X33T204.pdf": "id-card_[ID_NUMBER].pdf",
    "Flat 3, 29 Millbarrow Street, Brindal": "Flat 3, [ADDRESS], Brindal",
    "Directions to 192 Thistledown Close Apt 12B - Map": "Directions to [ADDRESS] - Map",
    "Lindenstraße 44b, 19926 Ostrel; Hasselweg_42": "[ADDRESS], 19926 Ostrel; [ADDRESS]",
    "43 rue des Quinceburys, Tornquay": "[ADDRESS], Tornquay",
    "/maps/place/201+Hazelpond+Close,+Mirefeld": "/maps/place/[ADDRESS],+Mirefeld",
    "1:1 DUNWILLOW, Zoelia / plan": "1:1 [NAME] / plan",
    "D. Prellinger's plan, dorvik_prellinger": "[NAME]'s plan, [NAME]",
    "offer_Z_Dunwillow.pdf": "offer_[NAME].pdf",
    "Orsolin Soendrick and Søndrick O": "[NAME] and [NAME]",
    "/profile/Dunwillow%2C%20Zo%C3%ABlia/x": "/profile/[NAME]/x",
    "Ｄｏｒｖｉｋ Рrellinger (DM)": "[NAME] (DM)",
}
CLEAN = ["", "logo@2x.png v1", "@lantern/config@6.5.5 install", "Part 247-94-482 stock", "ISBN 978-0-00-821770-6", "Order no. 3595456054", "Build 10.0.18609.3136", "Server 192.0.2.191 health", "Log 2025-08-10 15:17", "11 Street photography tips", "Hazelpond Lane sitemap list", "(7) Stonewell Lane list", "Road 42 playlist", "street_forecast_12.csv", "/lane/timesheet/12", "Prellinger Logistics payroll", "Prellinger_brand.svg", "Dorvik summary", "Dorvik Dunwillow", "Viewing at noon", "M74X33T204", "C39521068", "@x mentioned you", "02:10:32 - 1:1", "04.10.2025 15:17", "0.10.1"]


@pytest.fixture(scope="module")
def finder():
    return pi.Finder(PEOPLE)


@pytest.mark.parametrize("text", FOUND)
def test_replaced(finder, text):
    assert finder.redacted(text) == FOUND[text]


@pytest.mark.parametrize("text", CLEAN)
def test_left_alone(finder, text):
    assert finder.redacted(text) == text


def test_very_long_text(finder):
    filler = "nothing to see here, no. 12 " * 20_000
    assert finder.redacted(filler + "a@example.org " + filler) == filler + "[EMAIL] " + filler


def test_names_in_mails_do_not_count(finder):
    assert [k for *_, k in finder.spans("dorvik.prellinger@example.org")] == ["email"]


def people(spark):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PEOPLE)], "person_id bigint, given_name string, family_name string")


@pytest.mark.parametrize("block", [1, 2, 1000])
def test_columns_and_blocks_of_people(spark, monkeypatch, block):
    monkeypatch.setattr(pi, "PEOPLE_BLOCK", block)
    df = spark.createDataFrame([(t, "a@b.example", None) for t in [*FOUND, *CLEAN]], "title string, email string, url_path string")
    got = pi.redact_columns(df, ["title", "url_path"], people(spark)).collect()
    assert [r.title for r in got] == [*FOUND.values(), *CLEAN] and all(r.email == "a@b.example" and r.url_path is None for r in got)


def test_found(spark):
    rows = [("1", "a@example.org", None, "Lease 46 Copperbeech Avenue.docx"), ("1", "a@example.org", None, "Lease 46 Copperbeech Avenue.docx"), ("2", None, "", "x"), (None, "a@example.org", None, None)]
    df = spark.createDataFrame(rows, "event_id string, title string, url_path string, file string")
    df = df.withColumns({c: F.timestamp_seconds(F.lit(1)) for c in ("start_ts", "end_ts", "ingested_at")})
    assert sorted(map(tuple, pi.personal_info(df, people(spark)).collect())) == [("1", "file", "address"), ("1", "title", "email")]
    assert pi.personal_info(df.limit(0), people(spark).limit(0)).count() == 0
