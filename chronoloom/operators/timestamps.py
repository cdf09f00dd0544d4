"""Timestamps of mixed layouts, precisions and zones to one instant (problem 1)."""

from __future__ import annotations

import datetime
import functools
import math
import re
import zoneinfo

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.functions.timezones import abbreviation_meanings, abbreviation_uses, offset_of, offset_seconds, zone_key, zone_names, zone_table
from chronoloom.spark_tools import is_small, micros, small_join, written

#: Prior of each component as a number of texts, EVEN where none is named.
MONTH_FIRST_SLASHES = {"slash_mdy": 50.0, "slash_dmy": 0.05, "dot_dmy": 50.0, "dot_mdy": 0.05}
EITHER_ORDER: dict[str, float] = {}
EVEN = 0.5
#: Weight of noise, texts that only look like a reading, beside components with a prior of their own.
NOISE = 0.02
#: Layouts that month-first slashes and day-first dots don't have.
AGAINST_CONVENTION = ("slash_dmy", "dot_mdy")

DAY_US = 86_400_000_000
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
MONTH = {name: i for i, full in enumerate(MONTHS, 1) for name in (full, full[:3])} | {"sept": 9}
EPOCH_UNITS = {"epoch_s": 0, "epoch_ms": 3, "epoch_us": 6, "epoch_ns": 9}
#: Instants that a number may stand for, years 1 to 9999.
LEAST_US, MOST_US = -62_135_596_800_000_000, 253_402_300_799_999_999

_SIGNS = str.maketrans("\u2212\u2012\u2013\xa0\u202f\u2009\u3000", "---    ", "\u200b\u200e\u200f\ufeff")
_NUMBER = re.compile(r"(\d{9,20})(?:\.(\d*))?$")
_COMPACT = re.compile(r"(\d{4})(\d{2})(\d{2})[Tt ]?(\d{2})(\d{2})(\d{2})?(?=\D|$)")
_YEAR_LAST = re.compile(r"([A-Za-z]{3,9},?) ([A-Za-z]{3,9}) +(\d{1,2}) (\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?)( [A-Za-z]{1,5})? (\d{4})$")
_CLOCK = re.compile(r"(.*?[0-9A-Za-z]),?(?:[Tt]|\s+|\s+at\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*((?:[AaPp]\.?[Mm]\.?(?![A-Za-z]))?)\s*(\S.*)?$")
_YMD = re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$")
_XY = re.compile(r"(\d{1,2})([/.-])(\d{1,2})\2(\d{4})$")
_D_MON_Y = re.compile(r"(?:[A-Za-z]{3,9}\.?,?\s+)?(\d{1,2})(?:st|nd|rd|th)?[\s-]+([A-Za-z]{3,9})\.?,?[\s-]+(\d{4})$")
_MON_D_Y = re.compile(r"(?:[A-Za-z]{3,9}\.?,?\s+)?([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})$")
_ABBREVIATION = re.compile(r"[A-Za-z]{2,5}$")
_EPOCH = datetime.date(1970, 1, 1).toordinal()


def _midnight(year: str, month: str | int, day: str) -> int | None:
    try:
        return (datetime.date(int(year), int(month), int(day)).toordinal() - _EPOCH) * DAY_US
    except ValueError:
        return None


def _dates(text: str) -> list[tuple[str, int]]:
    """(layout, microseconds of its midnight) of every way to read a date."""
    if m := _YMD.match(text):
        found = [("ymd", _midnight(m[1], m[3], m[4]))]
    elif m := _XY.match(text):
        kind = "slash" if m[2] == "/" else "dot"
        found = [(f"{kind}_mdy", _midnight(m[4], m[1], m[3])), (f"{kind}_dmy", _midnight(m[4], m[3], m[1]))][:: 1 if kind == "slash" else -1]  # the first names equal ones
    elif m := _D_MON_Y.match(text):
        found = [("day_month", _midnight(m[3], MONTH.get(m[2].lower(), 0), m[1]))]
    elif m := _MON_D_Y.match(text):
        found = [("month_day", _midnight(m[3], MONTH.get(m[1].lower(), 0), m[2]))]
    else:
        found = []
    return [(name, us) for name, us in found if us is not None]


def readings(text: str | None) -> tuple[list[tuple[str, int]], str, str]:
    """((layout, local microseconds) of every valid reading, zone part before any bracket, last zone name) of a text.

    A number has one reading a unit, each of the instant itself.
    """
    if not text:
        return [], "", ""
    t = " ".join(text.translate(_SIGNS).split())
    if m := _NUMBER.match(t):
        digits, fraction = m[1], m[2] or ""
        out = []
        for name, places in EPOCH_UNITS.items():
            # Digits are moved, not multiplied, so nothing is rounded.
            us = int(digits + fraction[: 6 - places].ljust(6 - places, "0")) if places < 6 else int(digits[: len(digits) - (places - 6)] or 0)
            if LEAST_US <= us <= MOST_US:
                out.append((name, us))
        return out, "", ""
    t = _COMPACT.sub(lambda m: f"{m[1]}-{m[2]}-{m[3]}T{m[4]}:{m[5]}" + (f":{m[6]}" if m[6] else ""), t, count=1) if _COMPACT.match(t) else t
    if m := _YEAR_LAST.match(t):
        t = f"{m[1]} {m[3]} {m[2]} {m[6]} {m[4]}{m[5] or ''}"
    m = _CLOCK.match(t)
    if not m:
        return [], "", ""
    hour, minute, second, half = int(m[2]), int(m[3]), int(m[4] or 0), m[6][:1].lower()
    if half:
        hour = hour % 12 + (12 if half == "p" else 0) if 1 <= hour <= 12 else 99
    if hour > 23 or minute > 59 or second > 59:
        return [], "", ""
    clock = (hour * 3600 + minute * 60 + second) * 1_000_000 + int((m[5] or "")[:6].ljust(6, "0"))
    zone = (m[7] or "").strip()
    before, bracket, after = zone.partition("[")
    first, last = before.strip(), after.removesuffix("]").strip() if bracket else zone
    return [(name, us + clock) for name, us in _dates(m[1])], first, last


_READING = pa.struct([("component", pa.string()), ("local_us", pa.int64())])
_PARSED = T.StructType([
    T.StructField("readings", T.ArrayType(T.StructType([T.StructField("component", T.StringType()), T.StructField("local_us", T.LongType())]))),
    T.StructField("zoned", T.BooleanType()),
    T.StructField("offset", T.IntegerType()),
    T.StructField("written", T.StringType()),
    T.StructField("abbreviation", T.StringType()),
])


def _parser(names: dict[str, str]):
    """An Arrow function from texts to their readings; `names` has the zone of every zone name in lower case."""

    def zone_of(first: str, last: str) -> tuple[int | None, str | None, str | None]:
        offset = 0 if first.upper() in ("Z", "UTC", "GMT", "UT") else offset_of(first)
        return offset, names.get(last.strip().lower()) if "/" in last else None, last.upper() if _ABBREVIATION.match(last) else None

    def run(texts: pa.Array) -> pa.Array:
        known: dict[tuple[str, str], tuple] = {("", ""): (None, None, None)}
        ends, layouts, local, zones = [0], [], [], []
        for text in texts.to_pylist():
            found, first, last = readings(text)
            for layout, us in found:
                layouts.append(layout)
                local.append(us)
            ends.append(len(local))
            if (first, last) not in known:
                known[first, last] = zone_of(first, last)
            zones.append((first != "" or last != "", *known[first, last]))
        pairs = pa.StructArray.from_arrays([pa.array(layouts, pa.string()), pa.array(local, pa.int64())], fields=list(_READING))
        zoned, offsets, written_zones, abbreviations = zip(*zones) if zones else ([], [], [], [])
        columns = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs), pa.array(zoned, pa.bool_()), pa.array(offsets, pa.int32()), pa.array(written_zones, pa.string()), pa.array(abbreviations, pa.string())]
        return pa.StructArray.from_arrays(columns, names=[f.name for f in _PARSED])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _PARSED)


def parsed_texts(df: DataFrame, text: str) -> DataFrame:
    """Adds `_p`: every valid reading of `text` by layout (component, local_us), whether a zone is written, and which. One Arrow pass over the texts."""
    return df.withColumn("_p", _parser(zone_names(df.sparkSession))(F.col(text)))


#: Likelihood, as a power of two, of an offset that an abbreviation has elsewhere but not in the host's zone.
ELSEWHERE = -10


@functools.lru_cache(maxsize=200_000)
def _offsets(zone: str, local_seconds: int) -> tuple[int, int]:
    """Seconds east of UTC before and after any change at a local time; they differ where it is skipped or occurs twice."""
    at = datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=local_seconds)
    rules = zoneinfo.ZoneInfo(zone)
    return tuple(int(at.replace(tzinfo=rules, fold=f).utcoffset().total_seconds()) for f in (0, 1))


def in_zone(local_us: int, zone: str) -> list[tuple[int, str | None]]:
    """(instant, 'repeated' or 'skipped' or None) of a local time: two instants where it occurs twice, moved on by the jump where it is skipped."""
    hour_us = 900_000_000  # offsets change at whole quarters of an hour
    try:
        first, second = _offsets(zone, local_us // hour_us * 900)
    except (OverflowError, ValueError):
        return []
    if first == second:
        return [(local_us - first * 1_000_000, None)]
    if first > second:
        return [(local_us - first * 1_000_000, "repeated"), (local_us - second * 1_000_000, "repeated")]
    return [(local_us - first * 1_000_000, "skipped")]


def plausibility(us: int, near: int | None) -> int:
    """Likelihood of an instant as a power of two, 0 the most: by its distance before `near`, the time at which the text was received, if that is known."""
    if near is None:
        return 0 if 315_532_800_000_000 <= us <= 4_102_444_800_000_000 else -20
    days = (near - us) / DAY_US
    return max(-20, -6 + math.floor(-math.log2(1 + (days / 30) ** 2))) if days < -1 else max(-20, math.floor(-math.log2(1 + (days / 30) ** 2)))


_CANDIDATES = T.StructType([T.StructField("kind", T.StringType()), T.StructField("us", T.ArrayType(T.LongType())), T.StructField("dst", T.StringType())])


@F.arrow_udf(_CANDIDATES)
def candidates(parsed: pa.Array, near: pa.Array, zone0: pa.Array, fixed0: pa.Array, zone1: pa.Array, fixed1: pa.Array) -> pa.Array:
    """The instants that a text may mean, its kind, which names the layout, offset of an abbreviation and likelihood class of each, and what the clocks did.

    kind is null for texts without a reading, and empty for those without a zone to be read by.
    """
    everywhere = abbreviation_meanings()
    lists, zoned, offsets, written_zones, abbreviations = parsed.flatten()
    ends = lists.offsets.to_numpy()
    layouts, local = (c.to_pylist() for c in lists.flatten().flatten())
    ends = (ends - ends[0]).tolist()
    zoned, offsets, written_zones, abbreviations, near = (c.to_pylist() for c in (zoned, offsets, written_zones, abbreviations, near))
    sides = [(zone0.to_pylist(), fixed0.to_pylist()), (zone1.to_pylist(), fixed1.to_pylist())]
    kinds, out_us, out_ends, clocks = [], [], [0], []
    for i, at in enumerate(near):
        found: list[tuple[str, int]] = []
        moved = None
        first, last = ends[i], ends[i + 1]
        for j in range(first, last):
            name, us = layouts[j], local[j]
            zones, fixes = sides[j > first]
            if name.startswith("epoch"):
                found.append((name, us))
            elif offsets[i] is not None:
                found.append((name, us - offsets[i] * 1_000_000))
            elif (zone := written_zones[i] or (None if zoned[i] else zones[i])) is not None:
                for instant, dst in in_zone(us, zone):
                    found.append((name, instant))
                    moved = moved or dst
            elif not zoned[i]:
                if fixes[i] is not None:
                    found.append((name, us - fixes[i] * 1_000_000))
            elif (short := abbreviations[i]) is not None:
                here = abbreviation_uses(zones[i]).get(short) if zones[i] else None
                for o in {here, *everywhere.get(short, [])} - {None}:
                    found.append((f"{name},{short}@{o}" + ("" if here is None or o == here else "!"), us - o * 1_000_000))
        seen, parts = set(), []
        for name, us in found:  # equal instants are one candidate
            if us not in seen:
                seen.add(us)
                out_us.append(us)
                parts.append(f"{name.rstrip('!')}={plausibility(us, at) + (ELSEWHERE if name.endswith('!') else 0)}")
        out_ends.append(len(out_us))
        kinds.append(";".join(parts) if last > first and (parts or not zoned[i]) else None)
        clocks.append(moved)
    return pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.ListArray.from_arrays(pa.array(out_ends, pa.int32()), pa.array(out_us, pa.int64())), pa.array(clocks, pa.string())], names=["kind", "us", "dst"])


def parts_of(kind: str) -> list[tuple[str, str | None, int]]:
    """(layout, offset of an abbreviation or None, likelihood class) of each candidate of a kind of text."""
    out = []
    for part in kind.split(";"):
        name, _, k = part.rpartition("=")
        layout, _, short = name.partition(",")
        out.append((layout, short or None, int(k)))
    return out


def family(component: str) -> str:
    """What a component stands against: the layouts of one shape, the units of a number, the offsets of an abbreviation."""
    return component.partition("@")[0] if "@" in component else component.partition("_")[0]


def noise_of(parts: list[tuple[str, str | None, int]], priors: dict[str, float]) -> float:
    return NOISE * 2.0 ** max(k for _, _, k in parts) if parts[0][0] in priors else 0.0


def fitted_weights(signatures: list[tuple[list[tuple[str, str | None, int]], int]], priors: dict[str, float], rounds: int = 25) -> dict[str, float]:
    """Weights of a source's mixtures, one a family, by expectation-maximisation over (signature, number of texts).

    A signature is the (layout, offset of an abbreviation or None, likelihood class) triples of a kind of text. A text contributes to each of its
    valid readings in proportion to weights times likelihood, and to noise (E); weights are the shares of their family in what they got and
    their prior (M). Noise keeps its weight, so that it doesn't grow with what it could explain as well.
    """
    seen = {x for s, _ in signatures for c, a, _ in s for x in (c, a) if x}
    names = sorted(seen | {c for c in priors if family(c) in set(map(family, seen))})
    prior = {c: priors.get(c, EVEN) for c in names}

    def shares(got: dict[str, float]) -> dict[str, float]:
        whole: dict[str, float] = {}
        for c in names:
            whole[family(c)] = whole.get(family(c), 0.0) + got[c] + prior[c]
        return {c: (got[c] + prior[c]) / whole[family(c)] for c in names}

    weight = shares(dict.fromkeys(names, 0.0))
    for _ in range(rounds):
        got = dict.fromkeys(names, 0.0)
        for parts, n in signatures:
            like = [weight[c] * (weight[a] if a else 1.0) * 2.0**k for c, a, k in parts]
            total = sum(like) + noise_of(parts, priors)
            for (c, a, _), x in zip(parts, like):
                got[c] += n * x / total
                if a:
                    got[a] += n * x / total
        weight = shares(got)
    return weight


_CHOICES = T.ArrayType(T.StructType([T.StructField(n, x) for n, x in (("kind", T.StringType()), ("best", T.IntegerType()), ("component", T.StringType()), ("posterior", T.DoubleType()), ("noise", T.DoubleType()))]))


def chosen(kinds: list[tuple[str, int]], priors: dict[str, float]) -> list[tuple[str, int, str, float, float]]:
    """(kind, number of the best candidate, its component, its posterior, the posterior of noise) of each kind of text of one source."""
    parts = [parts_of(kind) for kind, _ in kinds]
    weight = fitted_weights([(p, n) for p, (_, n) in zip(parts, kinds)], priors)
    out = []
    for p, (kind, _) in zip(parts, kinds):
        like = [weight[c] * (weight[a] if a else 1.0) * 2.0**k for c, a, k in p]
        noise = noise_of(p, priors)
        best, total = max(range(len(p)), key=lambda i: (like[i], -i)), sum(like) + noise
        c, a, _ = p[best]
        out.append((kind, best, f"{c}:{a}" if a else c, like[best] / total, noise / total))
    return out


def choices(counts: DataFrame, source: str, priors: dict[str, float]) -> DataFrame:
    """source, kind, best, component, posterior, noise of each kind of text of each source, by the mixtures fitted to it.

    `counts` has source, kind and n, one row a kind of text; kinds are bounded by layouts and likelihood classes, not by texts.
    """

    def fit(rows: pa.Array) -> pa.Array:
        out = [[dict(zip(_CHOICES.elementType.names, x)) for x in chosen([(k["kind"], k["n"]) for k in row], priors)] for row in rows.to_pylist()]
        return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("best", pa.int32()), ("component", pa.string()), ("posterior", pa.float64()), ("noise", pa.float64())])))

    fit.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    rows = counts.groupBy(source).agg(F.collect_list(F.struct("kind", "n")).alias("_kinds"))
    return rows.select(source, F.explode(F.arrow_udf(fit, _CHOICES)("_kinds")).alias("x")).select(source, "x.*")


def choice_key() -> Column:
    """A number for the kind of text of a source, null for texts without a choice."""
    return F.when(F.col("kind") != "", F.xxhash64("_source", "kind"))


def with_choices(flat: DataFrame, fitted: DataFrame) -> DataFrame:
    """Adds best, component, posterior, noise of its source and kind to every row.

    Every source's kinds are long texts, which files hold once and a broadcast again and again, so they meet by number. `fitted` has all kinds that
    `flat` has, so numbers that tell those apart are as good as the texts; if ever two are alike, the texts are joined.
    """
    numbered = fitted.withColumn("_key", choice_key())
    if numbered.groupBy("_key").count().where("count > 1").limit(1).count():
        return small_join(flat, fitted, ["_source", "kind"])
    return small_join(flat.withColumn("_key", choice_key()), numbered.drop("_source", "kind"), ["_key"]).drop("_key")


def host_zones(windows: DataFrame, source: str) -> DataFrame:
    """_source, _day, _zone, _fixed: zone, or offset in seconds, of each source's day."""
    zones = zone_table(windows.sparkSession)
    w = windows.select(F.col(source).cast("string").alias("_source"), F.col("local_day").alias("_day"), zone_key("timezone_name").alias("zone_key")).where("zone_key is not null and _day is not null")
    w = w.distinct().join(F.broadcast(zones), "zone_key", "left").withColumn("_fixed", offset_seconds(F.col("zone_key")))  # some 700 names, whatever the data
    w = w.where("zone_id is not null or _fixed is not null").groupBy("_source", "_day")
    w = w.agg(F.min(F.struct(F.coalesce("zone_id", F.lit("")).alias("z"), "_fixed")).alias("_w"))
    return w.select("_source", "_day", F.nullif(F.col("_w.z"), F.lit("")).alias("_zone"), F.col("_w._fixed").alias("_fixed"))


def normalise_timestamps(df: DataFrame, text: str, source: str, windows: DataFrame, priors: dict[str, float] | None = None, certain: float = 0.9, near: Column | None = None) -> DataFrame:
    """Adds instant_us, component, posterior, status and dst to every row of `df`.

    `source` names the column whose value has a mixture of its own (a host); `windows` has source, local_day and timezone_name, by which
    texts without a zone are read; `near` is a timestamp by which the text was written, if there is one. status is 'resolved', 'ambiguous' (the
    best reading has a posterior under `certain`; instant_us is the best one, the earlier of equals), 'noise' (more likely no reading at all),
    'no_zone' (a valid local time, but no window with a zone name for that day) or 'invalid' (no valid reading; also null and empty texts).
    dst is 'repeated' for a local time that occurs twice, which is therefore ambiguous, and 'skipped' for one that was moved on by the jump.

    Method: expectation-maximisation over format mixtures per source. A text's readings are its layouts, the order of day and month, the unit of
    a number, and the offsets that an abbreviation has in the host's zone or anywhere; each contributes by its component's weight in the source
    and the likelihood of its instant. Kinds of text (readings and likelihood classes) are counted, so that a busy source is one small group,
    weights are fitted per source, and posteriors choose. Conventions are priors, which a source's own texts may outweigh.
    """
    priors = EITHER_ORDER if priors is None else priors
    keep = df.columns
    # Rows without a source are a source of their own, with no windows.
    rows = df.select(F.struct("*").alias("_row"), F.coalesce(F.col(source).cast("string"), F.lit("\u0001")).alias("_source"), F.col(text).alias("_text"), (micros(near) if near is not None else F.lit(None).cast("long")).alias("_near"))
    parsed = parsed_texts(rows, "_text").drop("_text")
    w = host_zones(windows, source)
    # A text has at most two readings with a local time (month or day first), each with the zone of its own day.
    narrow = is_small(w)
    for i in (0, 1):
        local = F.get(F.col("_p.readings"), F.lit(i))
        parsed = parsed.withColumn(f"_day{i}", F.when(~local["component"].startswith("epoch"), F.date_from_unix_date(F.floor(local["local_us"] / DAY_US).cast("int"))))
        day = w.withColumnsRenamed({"_day": f"_day{i}", "_zone": f"_zone{i}", "_fixed": f"_fixed{i}"})
        parsed = parsed.join(F.broadcast(day) if narrow else day, ["_source", f"_day{i}"], "left")
    flat = parsed.select("_row", "_source", candidates("_p", "_near", *[f"{c}{i}" for i in (0, 1) for c in ("_zone", "_fixed")]).alias("_c"))
    flat = written(flat.select("_row", "_source", F.col("_c.kind").alias("kind"), F.col("_c.us").alias("_us"), F.col("_c.dst").alias("dst")), "readings")  # read twice: for the counts, and for the choice
    counts = flat.where("kind <> ''").groupBy("_source", "kind").agg(F.count(F.lit(1)).alias("n"))
    flat = with_choices(flat, written(choices(counts, "_source", priors), "choices"))
    us = F.get("_us", F.col("best"))
    sure = F.when(F.col("posterior") >= certain, "resolved").when(F.col("noise") > 0.5, "noise").otherwise("ambiguous")
    status = F.when(us.isNotNull(), sure).when(F.col("kind").isNotNull(), "no_zone").otherwise("invalid")
    return flat.select(*[F.col("_row")[c].alias(c) for c in keep], us.alias("instant_us"), F.col("component"), F.col("posterior"), status.alias("status"), F.col("dst"))


def event_instants(raw_events: DataFrame, buckets: DataFrame, windows: DataFrame) -> DataFrame:
    """event_id, instant_us, component, posterior, status, dst of every raw event whose text names a point in time, once per event_id: of several texts the surest, then the latest received.

    Dates with slashes are month first, with dots day first, by prior and by a check of what the posteriors chose. Events without an id are left
    out; an event of an unknown bucket has no host, so that only texts with a zone or number are cases.
    """
    hosts = buckets.where("bucket_id is not null").groupBy("bucket_id").agg(F.min("hostname").alias("hostname"))
    rows = small_join(raw_events.select("event_id", "bucket_id", "ts_text", "received_at").where("event_id is not null"), hosts, ["bucket_id"])
    found = normalise_timestamps(rows, "ts_text", "hostname", windows, MONTH_FIRST_SLASHES, near=F.col("received_at"))
    found = found.where(F.col("instant_us").isNotNull() & (F.col("status") != "noise") & ~F.substring_index("component", ":", 1).isin(*AGAINST_CONVENTION))
    best = F.max(F.struct("posterior", "received_at", "instant_us", "component", "status", "dst")).alias("x")
    return found.groupBy("event_id").agg(best).select("event_id", "x.instant_us", "x.component", "x.posterior", "x.status", "x.dst")
