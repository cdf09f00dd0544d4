"""Zone names of several vocabularies and the abbreviations that zones use, as small tables built from the tz database."""

from __future__ import annotations

import functools
import re
import zoneinfo
from collections import defaultdict
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the desktop vocabulary and the tz database zone of each.
DESKTOP_ZONES = {
    "AUS Central Standard Time": "Australia/Darwin",
    "AUS Eastern Standard Time": "Australia/Sydney",
    "Afghanistan Standard Time": "Asia/Kabul",
    "Alaskan Standard Time": "America/Anchorage",
    "Arab Standard Time": "Asia/Riyadh",
    "Arabian Standard Time": "Asia/Dubai",
    "Arabic Standard Time": "Asia/Baghdad",
    "Argentina Standard Time": "America/Argentina/Buenos_Aires",
    "Atlantic Standard Time": "America/Halifax",
    "Azerbaijan Standard Time": "Asia/Baku",
    "Azores Standard Time": "Atlantic/Azores",
    "Bangladesh Standard Time": "Asia/Dhaka",
    "Belarus Standard Time": "Europe/Minsk",
    "Canada Central Standard Time": "America/Regina",
    "Cape Verde Standard Time": "Atlantic/Cape_Verde",
    "Caucasus Standard Time": "Asia/Yerevan",
    "Cen. Australia Standard Time": "Australia/Adelaide",
    "Central America Standard Time": "America/Guatemala",
    "Central Asia Standard Time": "Asia/Almaty",
    "Central Europe Standard Time": "Europe/Budapest",
    "Central European Standard Time": "Europe/Warsaw",
    "Central Pacific Standard Time": "Pacific/Guadalcanal",
    "Central Standard Time": "America/Chicago",
    "Central Standard Time (Mexico)": "America/Mexico_City",
    "Chatham Islands Standard Time": "Pacific/Chatham",
    "China Standard Time": "Asia/Shanghai",
    "E. Africa Standard Time": "Africa/Nairobi",
    "E. Australia Standard Time": "Australia/Brisbane",
    "E. Europe Standard Time": "Europe/Chisinau",
    "E. South America Standard Time": "America/Sao_Paulo",
    "Eastern Standard Time": "America/New_York",
    "Egypt Standard Time": "Africa/Cairo",
    "FLE Standard Time": "Europe/Kiev",
    "Fiji Standard Time": "Pacific/Fiji",
    "GMT Standard Time": "Europe/London",
    "GTB Standard Time": "Europe/Bucharest",
    "Georgian Standard Time": "Asia/Tbilisi",
    "Greenland Standard Time": "America/Godthab",
    "Greenwich Standard Time": "Atlantic/Reykjavik",
    "Hawaiian Standard Time": "Pacific/Honolulu",
    "India Standard Time": "Asia/Kolkata",
    "Iran Standard Time": "Asia/Tehran",
    "Israel Standard Time": "Asia/Jerusalem",
    "Jordan Standard Time": "Asia/Amman",
    "Korea Standard Time": "Asia/Seoul",
    "Line Islands Standard Time": "Pacific/Kiritimati",
    "Lord Howe Standard Time": "Australia/Lord_Howe",
    "Mauritius Standard Time": "Indian/Mauritius",
    "Middle East Standard Time": "Asia/Beirut",
    "Montevideo Standard Time": "America/Montevideo",
    "Morocco Standard Time": "Africa/Casablanca",
    "Mountain Standard Time": "America/Denver",
    "Myanmar Standard Time": "Asia/Yangon",
    "N. Central Asia Standard Time": "Asia/Novosibirsk",
    "Namibia Standard Time": "Africa/Windhoek",
    "Nepal Standard Time": "Asia/Kathmandu",
    "New Zealand Standard Time": "Pacific/Auckland",
    "Newfoundland Standard Time": "America/St_Johns",
    "North Asia East Standard Time": "Asia/Irkutsk",
    "North Asia Standard Time": "Asia/Krasnoyarsk",
    "Pacific SA Standard Time": "America/Santiago",
    "Pacific Standard Time": "America/Los_Angeles",
    "Pacific Standard Time (Mexico)": "America/Tijuana",
    "Pakistan Standard Time": "Asia/Karachi",
    "Romance Standard Time": "Europe/Paris",
    "Russian Standard Time": "Europe/Moscow",
    "SA Eastern Standard Time": "America/Cayenne",
    "SA Pacific Standard Time": "America/Bogota",
    "SA Western Standard Time": "America/La_Paz",
    "SE Asia Standard Time": "Asia/Bangkok",
    "Samoa Standard Time": "Pacific/Apia",
    "Singapore Standard Time": "Asia/Singapore",
    "South Africa Standard Time": "Africa/Johannesburg",
    "Sri Lanka Standard Time": "Asia/Colombo",
    "Taipei Standard Time": "Asia/Taipei",
    "Tasmania Standard Time": "Australia/Hobart",
    "Tokyo Standard Time": "Asia/Tokyo",
    "Tonga Standard Time": "Pacific/Tongatapu",
    "Turkey Standard Time": "Europe/Istanbul",
    "US Eastern Standard Time": "America/Indianapolis",
    "US Mountain Standard Time": "America/Phoenix",
    "UTC": "UTC",
    "Venezuela Standard Time": "America/Caracas",
    "Vladivostok Standard Time": "Asia/Vladivostok",
    "W. Australia Standard Time": "Australia/Perth",
    "W. Central Africa Standard Time": "Africa/Lagos",
    "W. Europe Standard Time": "Europe/Berlin",
    "West Asia Standard Time": "Asia/Tashkent",
    "West Pacific Standard Time": "Pacific/Port_Moresby",
    "Yakutsk Standard Time": "Asia/Yakutsk",
}

#: Years whose rules give a zone's abbreviations.
YEARS = range(2005, 2031)


@functools.cache
def _abbreviations(zone: str) -> tuple[tuple[str, int], ...]:
    """Abbreviation and offset in seconds pairs that a zone uses."""
    rules, seen = zoneinfo.ZoneInfo(zone), {}
    for year in YEARS:
        for month in range(1, 13):
            at = datetime(year, month, 15, tzinfo=timezone.utc).astimezone(rules)
            name = at.tzname() or ""
            if name.isalpha():
                seen[name.upper()] = int(at.utcoffset().total_seconds())  # the latest use counts
    return tuple(sorted(seen.items()))


@functools.cache
def abbreviation_uses(zone: str) -> dict[str, int]:
    return dict(_abbreviations(zone))


def zone_names(spark: SparkSession) -> dict[str, str]:
    """Zone of every name of both vocabularies, in lower case."""
    known = set(spark._jvm.java.time.ZoneId.getAvailableZoneIds()) & zoneinfo.available_timezones()
    return {z.lower(): z for z in known} | {k.lower(): z for k, z in DESKTOP_ZONES.items() if z in known} | {"z": "UTC", "ut": "UTC"}


def zone_table(spark: SparkSession) -> DataFrame:
    """zone_key (lower case name), zone_id: every name of both vocabularies, some 700 rows whatever the data."""
    return spark.createDataFrame(sorted(zone_names(spark).items()), "zone_key string, zone_id string")


@functools.cache
def abbreviation_meanings() -> dict[str, list[int]]:
    """Every offset that a zone of the tz database gives an abbreviation, the most usual first."""
    votes: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for zone in zoneinfo.available_timezones():
        for name, offset in _abbreviations(zone):
            votes[name][offset] += 1
    out = {k: sorted(v, key=lambda o: (-v[o], o)) for k, v in votes.items()}
    return out | {"UTC": [0], "GMT": [0], "Z": [0], "UT": [0]}


def zone_key(name: str | Column) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return F.lower(F.trim(c))


OFFSET = r"^(?:UTC|GMT|utc|gmt)?\s*([+-])(\d{1,2}):?(\d{2})?(?::?\d{2})?$"


_OFFSET = re.compile(OFFSET)


def offset_of(text: str) -> int | None:
    """offset_seconds of one text."""
    m = _OFFSET.match(text)
    if not m or int(m[2]) > 18 or int(m[3] or 0) > 59:
        return None
    return (-1 if m[1] == "-" else 1) * (int(m[2]) * 3600 + int(m[3] or 0) * 60)


def offset_seconds(text: Column) -> Column:
    """Seconds east of UTC of an offset in digits; null for other texts and for offsets beyond 18 hours."""
    h = F.regexp_extract(text, OFFSET, 2).try_cast("int")
    m = F.coalesce(F.regexp_extract(text, OFFSET, 3).try_cast("int"), F.lit(0))
    sign = F.when(F.regexp_extract(text, OFFSET, 1) == "-", -1).otherwise(1)
    return F.when(text.rlike(OFFSET) & (h <= 18) & (m < 60), sign * (h * 3600 + m * 60))
