"""Interval algebra over records of a stream (by default one device-day): union, complement, subtraction, elementary pieces, merging, allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.schema import CONTENT, STREAM

FIRST, LAST = -(2**62), 2**62
#: Width of the time bins by which overlaps are joined.
BIN_US = 900_000_000


def coalesced(df: DataFrame, keys: list[str], start: str = "start_us", end: str = "end_us") -> DataFrame:
    """Union of the intervals of each key: keys, start_us, end_us. Touching intervals merge."""
    rows = df.select(*keys, F.col(start).alias("start_us"), F.col(end).alias("end_us"))
    w = Window.partitionBy(*keys).orderBy("start_us", "end_us")
    top = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", (top.isNull() | (F.col("start_us") > top)).cast("int"))
    rows = rows.withColumn("_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_no").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("_no")


def away_intervals(records: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """Union of the away-from-keyboard intervals of each key, over all its buckets."""
    return coalesced(records.where((F.col("kind") == "afk") & (F.lower("status") == "afk")), keys)


def subtracted(rows: DataFrame, away: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """`rows` without what lies in `away` (disjoint per key): each row comes out as its remaining fragments, or not at all.

    The complement of a key's away intervals is one small array, so that this is an equality join and a filter of that array per row.
    """
    holes = away.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_us", "end_us"))).alias("_away"))
    out = rows.join(holes, keys, "left")
    none = F.array().cast("array<struct<start_us:bigint,end_us:bigint>>")
    gone = F.coalesce("_away", none)
    near = F.filter(gone, lambda a: (a["start_us"] < F.col("end_us")) & (a["end_us"] > F.col("start_us")))
    edges = F.zip_with(
        F.concat(F.array(F.col("start_us")), F.transform(near, lambda a: a["end_us"])),
        F.concat(F.transform(near, lambda a: a["start_us"]), F.array(F.col("end_us"))),
        lambda a, b: F.struct(a.alias("s"), b.alias("e")),
    )
    out = out.withColumn("_piece", F.explode(F.filter(edges, lambda x: x["s"] < x["e"])))
    return out.withColumns({"start_us": F.col("_piece.s"), "end_us": F.col("_piece.e")}).drop("_away", "_piece")


def active_records(records: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """Records other than afk, less the time away."""
    return subtracted(records.where("kind <> 'afk'"), away_intervals(records, keys), keys)


def elementary(rows: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """The pieces between all distinct end points of each key: keys, start_us, end_us; pieces that nothing covers are among them."""
    points = rows.select(*keys, F.explode(F.array("start_us", "end_us")).alias("start_us")).distinct()
    w = Window.partitionBy(*keys).orderBy("start_us")
    return points.withColumn("end_us", F.lead("start_us").over(w)).where("end_us is not null")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str] = STREAM, bin_us: int = BIN_US) -> DataFrame:
    """Pairs of rows of equal keys whose half-open intervals overlap. Right's interval comes out as r_start_us, r_end_us.

    Both sides are dealt into time bins, so that the join is an equality on (keys, bin) and a crowded key is many small groups; a pair that
    meets in several bins counts in the one in which the later of its starts lies.
    """
    bins = lambda s, e: F.sequence(F.floor(s / bin_us), F.floor((e - 1) / bin_us))
    a = left.withColumn("_bin", F.explode(bins(F.col("start_us"), F.col("end_us"))))
    b = right.withColumnsRenamed({"start_us": "r_start_us", "end_us": "r_end_us"})
    b = b.withColumn("_bin", F.explode(bins(F.col("r_start_us"), F.col("r_end_us"))))
    pairs = a.join(b, [*keys, "_bin"])
    return pairs.where((F.col("r_start_us") < F.col("end_us")) & (F.col("r_end_us") > F.col("start_us")) & (F.floor(F.greatest("start_us", "r_start_us") / bin_us) == F.col("_bin"))).drop("_bin")


def merged_adjacent(records: DataFrame, keys: list[str] = STREAM, max_gap_us: int = 60_000_000) -> DataFrame:
    """Consecutive records of a bucket with equal content and at most `max_gap_us` between the latest end so far and the next start, as one.

    The first record's event_id stays. Nulls are equal to nulls.
    """
    by = [*keys, "bucket_id"]
    w = Window.partitionBy(*by).orderBy("start_us", "event_id", "end_us")
    rows = records.withColumn("_content", F.struct(*CONTENT))
    rows = rows.withColumn("_change", F.when(F.lag("start_us").over(w).isNull() | ~F.col("_content").eqNullSafe(F.lag("_content").over(w)), 1).otherwise(0))
    rows = rows.withColumn("_same", F.sum("_change").over(w))
    within = Window.partitionBy(*by, "_same").orderBy("start_us", "event_id", "end_us")
    top = F.max("end_us").over(within.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", (top.isNull() | (F.col("start_us") - top > max_gap_us)).cast("int"))
    rows = rows.withColumn("_no", F.sum("_new").over(within))
    first = F.min_by(F.struct("event_id", *CONTENT), F.struct("start_us", "event_id", "end_us"))
    out = rows.groupBy(*by, "_same", "_no").agg(first.alias("_f"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    return out.select(*keys, F.col("_f.event_id").alias("event_id"), "bucket_id", F.col("_f.kind").alias("kind"), "start_us", "end_us", *[F.col(f"_f.{c}").alias(c) for c in CONTENT if c != "kind"])


def allocated_windows(records: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """Each instant of foreground time given to one window record, the least (bucket_id, event_id) that covers it; seconds by record value."""
    windows = records.where("kind = 'current-window'")
    pieces = elementary(windows, keys)
    covered = overlapping(pieces, windows, keys)
    value = F.struct("bucket_id", "event_id", "r_start_us", "r_end_us", *CONTENT)
    won = covered.groupBy(*keys, "start_us", "end_us").agg(F.min(F.struct("bucket_id", "event_id", F.xxhash64(value).alias("h"), value.alias("v"))).alias("w"))
    out = won.groupBy(*keys, F.col("w.v").alias("v")).agg(F.sum(F.col("end_us") - F.col("start_us")).alias("_us"))
    return out.select(*keys, "v.bucket_id", "v.event_id", "v.app", "v.title", F.col("v.r_start_us").alias("start_us"), F.col("v.r_end_us").alias("end_us"), (F.col("_us") / 1e6).alias("seconds"))


def project_filter(records: DataFrame, project: str | None) -> DataFrame:
    """Records in which project, app, title, file, host or bucket contains `project`, whatever the case. None keeps all."""
    if project is None:
        return records
    needle = F.lower(F.lit(project))
    fields: list[Column] = [F.nullif(F.col(c), F.lit("")) for c in ("project", "app", "title", "file", "url_host", "bucket_id")]
    return records.where(F.exists(F.array(*fields), lambda x: F.coalesce(F.lower(x).contains(needle), F.lit(False))))
