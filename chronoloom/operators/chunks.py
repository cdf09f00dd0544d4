"""Time chunks: how one busy key is spread over many tasks and put together again exactly.

A key (bucket, host, ...) may hold a third of all rows, so no window or group is ever made over a bare key of rows.
Rows are cut into chunks of fixed width by their start; runs are built inside each chunk; what crosses a chunk border is
settled from one summary row per (key, chunk): its last run's start and its latest end. The number of summaries of a key
is bounded by the time it spans, not by its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def local_runs(rows: DataFrame, keys: list[str], gap_us: int, chunk_us: int, extra: list[Column] | None = None) -> DataFrame:
    """Runs inside each (key, chunk): columns keys, _chunk, _s, _e and `extra` aggregates.

    `rows` has keys, `s` and `e` (microseconds). A row starts a new run if it starts more than `gap_us` after the latest end so far in its chunk.
    """
    w = Window.partitionBy(*keys, "_chunk").orderBy("s", "e")
    rows = rows.withColumn("_chunk", F.floor(F.col("s") / chunk_us).cast("long"))
    rows = rows.withColumn("_top", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.col("_top").isNull() | (F.col("s") > F.col("_top") + gap_us)
    rows = rows.withColumn("_no", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_chunk", "_no").agg(F.min("s").alias("_s"), F.max("e").alias("_e"), *(extra or [])).drop("_no")


def stitched(runs: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """Adds to each local run `_before` (latest end of all earlier runs of its key, null for the first) and `_run` (start of the whole run that it belongs to)."""
    w = Window.partitionBy(*keys, "_chunk").orderBy("_s", "_e")
    by = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    ends = runs.groupBy(*keys, "_chunk").agg(F.max("_e").alias("_top"), F.max("_s").alias("_last"))
    ends = ends.withColumn("_cin", F.max("_top").over(earlier))
    opens = F.when(F.col("_cin").isNull() | (F.col("_last") > F.col("_cin") + gap_us), F.col("_last"))
    ends = ends.withColumn("_opens", opens).withColumn("_rin", F.last("_opens", ignorenulls=True).over(earlier))
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_kc"), "_cin", "_rin")
    same = F.col("_chunk") == F.col("_kc")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = runs.join(ends, same, "left")
    here = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("_before", F.greatest(here, F.col("_cin")))
    new = F.col("_before").isNull() | (F.col("_s") > F.col("_before") + gap_us)
    mine = F.last(F.when(new, F.col("_s")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("_run", F.coalesce(mine, F.col("_rin"))).drop("_kc", "_cin", "_rin", *[f"_k{i}" for i in range(len(keys))])


def stitched_alike(runs: DataFrame, keys: list[str], content: str, gap_us: int, follows: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """`stitched` for runs of equal `content`: a run also ends where the content changes. Adds `_run`.

    `runs` also has `_first`, true for the runs of the chunk's first stretch of equal content, and `_last`, true for those of its last one.
    A chunk of one content that goes on with the content before it passes the state (open run, latest end) through; any other chunk sets it anew.
    With `follows`, runs also have `_cut`, true where a run can't follow the one of the same content before it even without a pause, and `_xa` and `_xz`, with what it began
    and ended; follows(_xz, _xa) tells whether two events of one content may be in one run. The latest end counts over a whole stretch.
    """
    if follows is None:
        none = F.lit(None).cast("int")
        runs, follows = runs.withColumns({"_cut": F.lit(False), "_xa": none, "_xz": none}), lambda a, b: F.lit(True)
    by = Window.partitionBy(*keys).orderBy("_chunk")
    ends = runs.groupBy(*keys, "_chunk").agg(
        F.min_by(content, "_s").alias("_from"),
        F.max_by(content, "_s").alias("_to"),
        F.min_by("_xa", "_s").alias("_xa"),
        F.max_by("_xz", "_s").alias("_xz"),
        (F.min("_first") & F.min("_last")).alias("_one"),
        F.min("_s").alias("_first_s"),
        F.max("_s").alias("_last_s"),
        F.max(F.when(F.col("_cut"), F.col("_s"))).alias("_cut_s"),
        F.max(F.when(F.col("_last"), F.col("_e"))).alias("_last_e"),
    )
    ends = ends.withColumn("_was", F.lag("_to").over(by)).withColumn("_same", F.coalesce(F.col("_from") == F.col("_was"), F.lit(False)))
    ends = ends.withColumn("_border", F.col("_same") & ~follows(F.lag("_xz").over(by), F.col("_xa"))).withColumn("_through", F.col("_one") & F.col("_same"))
    ends = ends.withColumn("_set", F.sum((~F.col("_through")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(*keys, "_set").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_top", F.max("_last_e").over(within)).withColumn("_cin", F.lag("_top").over(by))
    opens = F.when(~F.col("_through") | (F.col("_last_s") > F.col("_cin") + gap_us), F.col("_last_s")).otherwise(F.greatest("_cut_s", F.when(F.col("_border"), F.col("_first_s"))))
    ends = ends.withColumn("_opens", opens).withColumn("_open", F.last("_opens", ignorenulls=True).over(within)).withColumn("_rin", F.lag("_open").over(by))
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_kc"), "_was", "_cin", "_rin", F.when(F.col("_border"), F.col("_first_s")).alias("_bs"))
    same = F.col("_chunk") == F.col("_kc")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = runs.join(ends, same, "left")
    w = Window.partitionBy(*keys, "_chunk").orderBy("_s", "_e")
    before = F.greatest(F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_cin"))
    goes_on = F.col("_first") & ~F.col("_cut") & (F.col(content) == F.col("_was")) & (F.col("_s") <= before + gap_us) & ~F.col("_s").eqNullSafe(F.col("_bs"))
    out = out.withColumn("_new", ~F.coalesce(goes_on, F.lit(False)))
    mine = F.last(F.when(F.col("_new"), F.col("_s")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("_run", F.coalesce(mine, F.col("_rin"))).drop("_kc", "_was", "_cin", "_rin", "_bs", "_new", *[f"_k{i}" for i in range(len(keys))])
