"""Small text functions for outputs, as expressions: durations, clock times, ISO instants, Markdown escapes, code spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_text(seconds: Column) -> Column:
    """'<1m' under a minute, else whole minutes rounded half up as '3m', '2h', '2h 5m'; '0m' for nothing."""
    minutes = F.greatest(F.floor((seconds + 30) / 60), F.lit(0))
    h, m = F.floor(minutes / 60), minutes % 60
    hours, mins = F.concat(h.cast("string"), F.lit("h")), F.concat(m.cast("string"), F.lit("m"))
    return F.when((seconds > 0) & (seconds < 60), "<1m").when((h > 0) & (m > 0), F.concat(hours, F.lit(" "), mins)).when(h > 0, hours).otherwise(mins)


def clock_text(us: Column, zone: Column) -> Column:
    """Local HH:MM of an instant, whatever the session's zone."""
    return F.date_format(F.to_timestamp_ntz(F.date_format(F.from_utc_timestamp(F.timestamp_micros(us), zone), "yyyy-MM-dd HH:mm:ss")), "HH:mm")


def iso_text(us: Column) -> Column:
    """ISO 8601 in UTC with +00:00; microseconds only if there are any."""
    days, rest = F.floor(us / 86_400_000_000), F.pmod(us, F.lit(86_400_000_000))
    s, fraction = F.floor(rest / 1_000_000), rest % 1_000_000
    clock = F.format_string("T%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    return F.concat(F.date_from_unix_date(days.cast("int")).cast("string"), clock, F.when(fraction > 0, F.format_string(".%06d", fraction)).otherwise(""), F.lit("+00:00"))


def one_line(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def markdown_text(value: Column) -> Column:
    """A text on one line with HTML and Markdown signs escaped."""
    out = one_line(value)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    out = F.replace(out, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(out, r"([`*_{}\[\]#+|])", r"\\$1")


def code_text(value: Column) -> Column:
    """A code span whose fence is longer than any run of backticks inside."""
    line = one_line(value)
    runs = F.transform(F.regexp_extract_all(line, F.lit(r"(`+)"), F.lit(1)), F.length)
    fence = F.repeat(F.lit("`"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    pad = F.when(line.startswith("`") | line.endswith("`"), " ").otherwise("")
    return F.concat(fence, pad, line, pad, fence)


def last_part(path: Column) -> Column:
    return F.substring_index(F.substring_index(path, "/", -1), "\\", -1)


def joined(*values: Column) -> Column:
    """The values that are not empty, escaped, with dashes between; null if there is none."""
    kept = [F.when(F.nullif(v, F.lit("")).isNotNull(), markdown_text(v)) for v in values]
    return F.nullif(F.concat_ws(" — ", *kept), F.lit(""))
