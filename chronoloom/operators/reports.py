"""Aggregates of records: time by application, sources, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.intervals import allocated_windows
from chronoloom.schema import STREAM

SOURCES = ["current-window", "editor", "browser"]


def app_totals(records: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """Foreground seconds by application without double counting, and each one's place by seconds, then name."""
    totals = allocated_windows(records, keys).groupBy(*keys, F.coalesce("app", F.lit("Unknown application")).alias("app")).agg(F.sum(F.rint(F.col("seconds") * 1e6).cast("long")).alias("_us"))
    ranked = totals.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("_us")).alias("n"), F.lower("app").alias("f"), "app"))).alias("a"))
    out = ranked.select(*keys, F.posexplode("a").alias("place", "x"))
    return out.select(*keys, F.col("x.app").alias("app"), (-F.col("x.n") / 1e6).alias("seconds"), (F.col("place") + 1).alias("place"))


def report_heads(records: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """entries, sources in their fixed order and active seconds (null without any allocated window) of each key."""
    order = F.array(*map(F.lit, SOURCES))
    heads = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"), F.collect_set("kind").alias("_kinds"))
    totals = app_totals(records, keys).groupBy(*keys).agg((F.sum(F.rint(F.col("seconds") * 1e6).cast("long")) / 1e6).alias("active_seconds"))
    return heads.join(totals, keys, "left").select(*keys, "entries", F.array_join(F.array_intersect(order, "_kinds"), ",").alias("sources"), "active_seconds")
