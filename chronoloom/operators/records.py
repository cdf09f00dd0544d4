"""Raw events and buckets to records: kinds, zoned instants, clipping to day windows, strict text fields, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.timezones import offset_seconds, zone_key, zone_table
from chronoloom.operators.intervals import coalesced
from chronoloom.operators.timestamps import AGAINST_CONVENTION, MONTH_FIRST_SLASHES, normalise_timestamps, parsed_texts
from chronoloom.schema import DAY_US, DIAGNOSTICS, KIND_OF_TYPE, RECORD, TEXTS
from chronoloom.spark_tools import latest_records, latest_rows, micros, small_join, written

#: An ISO text with a zone; with zone tables timed_events reads any layout by operators.timestamps.
ZONED = r"(?i)^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"
NAIVE = r"(?i)^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?$"
URL_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]*)(?::\d*)?(?:[/?#]|$)"
URL_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def bucket_kind(bucket_type: str = "bucket_type") -> Column:
    """The kind of a bucket type, null for types that are not supported."""
    return F.create_map(*[F.lit(x) for kv in KIND_OF_TYPE.items() for x in kv])[F.col(bucket_type)]


def supported_buckets(buckets: DataFrame) -> DataFrame:
    """Buckets of supported types with their kind, empty strings for missing attributes."""
    plain = [F.coalesce(c, F.lit("")).alias(c) for c in ("bucket_type", "client", "hostname")]
    return buckets.select("bucket_id", *plain).withColumn("kind", bucket_kind()).where("kind is not null")


def unsupported_buckets(buckets: DataFrame) -> DataFrame:
    """bucket_type, n: how many buckets of each type were passed over."""
    return buckets.where(bucket_kind().isNull()).groupBy(F.coalesce("bucket_type", F.lit("")).alias("bucket_type")).agg(F.count(F.lit(1)).alias("n"))


def strict_text(variant: str | Column, key: str) -> Column:
    """A field of a parsed document if it is a non-empty string; numbers and others are null, not their text."""
    v = F.col(variant) if isinstance(variant, str) else variant
    raw = F.try_variant_get(v, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(raw) == "STRING", F.nullif(F.try_variant_get(v, f"$.{key}", "string"), F.lit("")))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(lower-case host, path) of a URL; query and fragment are dropped, and parts that are missing are null.

    A text without a scheme has no host but keeps its path. Pure expressions, so rows stay in the JVM.
    """
    host = F.nullif(F.lower(F.regexp_replace(F.regexp_extract(url, URL_HOST, 1), r"[\[\]]", "")), F.lit(""))
    path = F.nullif(F.regexp_extract(url, URL_PATH, 1), F.lit(""))
    bad = url.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*[\[\]]") & ~url.rlike(URL_HOST)
    return F.when(~bad, host), F.when(~bad, path)


def day_windows(days: DataFrame) -> DataFrame:
    """Adds start_us, end_us and duration_seconds of each (day, timezone_name): local midnight to the next, by the zone's rules of that day.

    Zone names may be of either vocabulary, in any case and padded, or offsets in digits; a name that is neither has nulls.
    """
    zones = zone_table(days.sparkSession).select(F.col("zone_key").alias("_key"), F.col("zone_id").alias("_zone"))
    out = days.withColumn("_key", zone_key("timezone_name")).join(F.broadcast(zones), "_key", "left")  # some 700 names, whatever the data
    midnight = lambda d: F.unix_date(d).cast("long") * DAY_US
    at = lambda d: F.when(F.col("_zone").isNotNull(), micros(F.to_utc_timestamp(F.timestamp_micros(midnight(d)), F.col("_zone")))).otherwise(midnight(d) - offset_seconds(F.col("_key")).cast("long") * 1_000_000)
    out = out.withColumns({"start_us": at(F.col("day")), "end_us": at(F.date_add("day", 1))}).drop("_key", "_zone")
    return out.withColumn("duration_seconds", (F.col("end_us") - F.col("start_us")) / 1e6)


def in_windows(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Pairs of rows (hostname, _s, _e) and the windows of their host that they meet, as day, _ws, _we.

    Windows are found by the days that a row meets, so that the join is an equality; a row that never ends meets no more days than there are.
    """
    first, last = windows.agg(F.min(F.unix_date("day")), F.max(F.unix_date("day"))).first()
    w = windows.where("start_us < end_us").select(F.col("hostname").alias("_host"), "day", F.col("start_us").alias("_ws"), F.col("end_us").alias("_we"))
    first, last = (1, 0) if first is None else (first, last)
    lo, hi = F.greatest(F.floor(F.col("_s") / DAY_US) - 1, F.lit(first)), F.least(F.floor(F.col("_e") / DAY_US) + 1, F.lit(last))
    days = F.when(lo <= hi, F.sequence(lo, hi))
    spread = rows.withColumn("_d", F.explode(F.transform(days, lambda d: F.date_from_unix_date(d.cast("int")))))
    return spread.join(w, (F.col("hostname") == F.col("_host")) & (F.col("_d") == F.col("day"))).where("_s < _we and _e > _ws").drop("_d", "_host")


#: What becomes of a raw row, besides the codes of diagnostics: kept in at least one window, or an earlier copy of an event.
KEPT, REPEATED = "kept", "repeated-event"


def timed_events(raw_events: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Adds `_s`, the instant of each text that has one, and `_naive`, of texts that name a time but no zone.

    With `zones` (hostname, local_day, timezone_name; it tells what an abbreviation means on a host, and gives no zone to naive texts) texts may
    have any layout; without, only ISO texts are read, and those of other layouts are left without an instant.
    """
    if zones is None:
        text = F.trim("ts_text")
        start = F.when(text.rlike(ZONED), micros(F.upper(text).try_cast("timestamp")))
        return raw_events.withColumns({"_s": start, "_naive": F.coalesce(text.rlike(NAIVE), F.lit(False))})
    parsed = parsed_texts(raw_events, "ts_text")
    naive = ~F.col("_p.zoned") & (F.size("_p.readings") > 0) & ~F.get(F.col("_p.readings"), F.lit(0))["component"].startswith("epoch")
    rows = parsed.withColumn("_naive", naive).drop("_p")
    near = F.col("received_at") if "received_at" in rows.columns else None
    timed = normalise_timestamps(rows, "ts_text", "hostname", zones, MONTH_FIRST_SLASHES, near=near)
    right = ~F.substring_index("component", ":", 1).isin(*AGAINST_CONVENTION) & (F.col("status") != "noise")
    return timed.select(*rows.columns, F.when(~F.col("_naive") & right, F.col("instant_us")).alias("_s"))


def normalised(raw_events: DataFrame, buckets: DataFrame, windows: DataFrame, zones: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, fates) of raw events against the windows (hostname, day, start_us, end_us) of their hosts.

    fates (fate, n) says what became of every row, so that they add up to the input: 'kept' in at least one window; 'repeated-event', an
    earlier copy by received_at of an event of the same bucket and id; 'unsupported-bucket', of a bucket that is not supported or not known; 'naive-timestamp';
    'unreadable-timestamp'; and 'non-positive-event', nothing of which is left after clipping, in a window or outside of all.
    """
    cols = raw_events.columns
    if "received_at" in cols:
        copies = latest_rows(raw_events.withColumn("_id", F.when(F.col("event_id").isNotNull(), F.struct("bucket_id", "event_id"))), "_id", "received_at", ["ts_text", "duration_seconds", "data_json"]).select(*cols)
    else:
        copies = raw_events
    kinds = supported_buckets(buckets).select("bucket_id", "hostname", "kind")
    joined = written(small_join(copies, kinds, ["bucket_id"]), "events")  # read twice: for the records, and to count
    rows = joined.where("kind is not null").withColumn("_row", F.monotonically_increasing_id())
    rows = timed_events(rows, zones).withColumn("_e", F.try_add("_s", F.rint(F.col("duration_seconds") * 1e6).try_cast("long")))
    rows = written(rows, "timed")
    met = in_windows(rows.where("_e > _s"), windows)
    host, path = url_parts(F.col("_url"))
    kept = met.withColumns({"start_us": F.greatest("_s", "_ws"), "end_us": F.least("_e", "_we"), "_v": F.try_parse_json("data_json")}).withColumn("_url", strict_text("_v", "url"))
    kept = kept.select("hostname", "day", "event_id", "bucket_id", "kind", "start_us", "end_us", *[(host if c == "url_host" else path if c == "url_path" else strict_text("_v", c)).alias(c) for c in TEXTS])
    found = rows.join(met.select("_row").distinct().withColumn("_in", F.lit(True)), "_row", "left")
    fate = F.when(F.col("_naive"), "naive-timestamp").when(F.col("_s").isNull(), "unreadable-timestamp").when(F.col("_in"), KEPT).otherwise("non-positive-event")
    n = F.count(F.lit(1))
    named = lambda df, name, count: df.agg(count.alias("n")).select(F.lit(name).alias("fate"), "n")
    rest = named(raw_events, REPEATED, n).unionByName(named(joined, REPEATED, -n)).unionByName(named(joined, "unsupported-bucket", F.count_if(F.col("kind").isNull())))
    rest = rest.groupBy("fate").agg(F.sum("n").alias("n")).where("n > 0")
    fates = found.groupBy(fate.alias("fate")).agg(n.alias("n")).unionByName(rest)
    return kept.select("hostname", "day", *RECORD), fates


def diagnostic_rank(code: str = "code") -> Column:
    return F.array_position(F.array(*map(F.lit, DIAGNOSTICS)), F.col(code))


def diagnostic_messages(counts: DataFrame) -> DataFrame:
    """Adds rank and message ('ignored 3 ...s') to code, n."""
    words = F.create_map(*[F.lit(x) for kv in DIAGNOSTICS.items() for x in kv])[F.col("code")]
    plural = F.when(F.col("n") == 1, "").otherwise("s")
    return counts.where("n > 0").select("code", "n", diagnostic_rank().alias("rank"), F.concat(F.lit("ignored "), F.col("n").cast("string"), F.lit(" "), words, plural).alias("message"))


def day_records(activity: DataFrame, buckets: DataFrame, windows: DataFrame | None = None, texts: list[str] = TEXTS) -> DataFrame:
    """Counted records by host and local day: a record is clipped to each window (hostname, day, start_us, end_us) of its host that it meets.

    What lies in no window of its host counts to its UTC day, so that nothing is lost where windows are missing or leave gaps; without windows
    all days are UTC days. Only the text columns asked for are read. Empty texts are null; records without a positive duration, start, or
    known bucket are left out.
    """
    rows = _counted(activity, buckets, texts)
    if windows is None:
        return _by_utc_day(rows, texts)
    rows = rows.withColumn("_d", F.explode(F.sequence(F.floor(F.col("_s") / DAY_US), F.floor((F.col("_e") - 1) / DAY_US))))
    rows = small_join(rows, _windows_of_utc_days(windows), ["hostname", "_d"])
    begin, end = F.col("_d") * DAY_US, (F.col("_d") + 1) * DAY_US
    lo, hi = F.greatest("_s", begin), F.least("_e", end)
    # A piece in a window belongs to the UTC day that it starts in, so that it comes out once; what lies in no window is cut at UTC midnights.
    piece = lambda day, s, e: F.struct(day.alias("day"), s.alias("start_us"), e.alias("end_us"))
    inside = F.filter(F.transform("_windows", lambda w: piece(w["day"], F.greatest(F.col("_s"), w["s"]), F.least(F.col("_e"), w["e"]))), lambda p: (p["start_us"] < p["end_us"]) & p["start_us"].between(begin, end - 1))
    starts = F.concat(F.array(lo), F.transform("_whole", lambda w: F.greatest(w["e"], lo)))
    stops = F.concat(F.transform("_whole", lambda w: F.least(w["s"], hi)), F.array(hi))
    bare = F.zip_with(starts, stops, lambda s, e: piece(F.date_from_unix_date(F.col("_d").cast("int")), s, e))
    bare = F.filter(F.coalesce(bare, F.array(piece(F.date_from_unix_date(F.col("_d").cast("int")), lo, hi))), lambda p: p["start_us"] < p["end_us"])
    none = F.array().cast("array<struct<day:date,start_us:bigint,end_us:bigint>>")
    out = rows.withColumn("_p", F.explode(F.concat(F.coalesce(inside, none), bare)))
    return out.select("hostname", "_p.day", "event_id", "bucket_id", "kind", "_p.start_us", "_p.end_us", *_plain(texts))


def _windows_of_utc_days(windows: DataFrame) -> DataFrame:
    """hostname, _d (a UTC day by number) and the windows that meet it: `_windows` (s, e, day), and `_whole` (s, e), their union; a few a day."""
    windows = windows.where("start_us < end_us")
    over = F.explode(F.sequence(F.floor(F.col("start_us") / DAY_US), F.floor((F.col("end_us") - 1) / DAY_US))).alias("_d")
    span = F.struct(F.col("start_us").alias("s"), F.col("end_us").alias("e"))
    own = windows.select("hostname", over, F.struct("start_us", "end_us", "day").alias("w"), F.lit(None).cast("struct<s:bigint,e:bigint>").alias("u"))
    whole = coalesced(windows, ["hostname"]).select("hostname", over, F.lit(None).cast(own.schema["w"].dataType).alias("w"), span.alias("u"))
    out = own.unionByName(whole).groupBy("hostname", "_d").agg(F.array_sort(F.collect_list("w")).alias("_windows"), F.array_sort(F.collect_list("u")).alias("_whole"))
    named = F.transform("_windows", lambda w: F.struct(w["start_us"].alias("s"), w["end_us"].alias("e"), w["day"].alias("day")))
    return out.withColumn("_windows", named)


def _plain(texts: list[str]) -> list[Column]:
    return [F.nullif(F.col(c), F.lit("")).alias(c) for c in texts]


def _counted(activity: DataFrame, buckets: DataFrame, texts: list[str]) -> DataFrame:
    cols = ["event_id", "bucket_id", "kind", "start_ts", "end_ts", *["code_language" if c == "language" else c for c in texts]]
    hosts = buckets.where("bucket_id is not null").groupBy("bucket_id").agg(F.min("hostname").alias("hostname"))
    rows = small_join(latest_records(activity, cols), hosts, ["bucket_id"], "inner").where("end_ts > start_ts")
    return rows.withColumnRenamed("code_language", "language").withColumns({"_s": micros("start_ts"), "_e": micros("end_ts")})


def _by_utc_day(rows: DataFrame, texts: list[str]) -> DataFrame:
    rows = rows.withColumn("_d", F.explode(F.sequence(F.floor(F.col("_s") / DAY_US), F.floor((F.col("_e") - 1) / DAY_US))))
    return rows.select(
        "hostname",
        F.date_from_unix_date(F.col("_d").cast("int")).alias("day"),
        "event_id",
        "bucket_id",
        "kind",
        F.greatest("_s", F.col("_d") * DAY_US).alias("start_us"),
        F.least("_e", (F.col("_d") + 1) * DAY_US).alias("end_us"),
        *_plain(texts),
    )
