"""Streaming forms: sessions by inactivity with a watermark, and device-days recomputed as their rows arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronoloom.schema import STREAM


def live_sessions(rows: DataFrame, key: str, gap_seconds: int = 300, late: str = "1 hour", ident: str | None = None) -> DataFrame:
    """Sessions of a stream with `key`, start_ts, end_ts: key, start_us, end_us, n_events; emitted when the watermark passes their end.

    Each row's window lasts from its start to its end plus the gap, and windows that meet are one session, so that long rows bridge as in the
    batch operator. State holds one row per open session. A row that starts just at the limit joins. With `ident`, copies of a row that come within
    `late` count once. Rows that come more than `late` after later ones have no session left to join; late_rows tells how many.
    """
    end = F.greatest("start_ts", F.coalesce("end_ts", "start_ts"))
    seconds = (F.unix_micros(end) - F.unix_micros("start_ts")) / 1e6 + gap_seconds
    window = F.session_window("start_ts", F.make_interval(secs=seconds.cast("decimal(18,6)")))
    timed = rows.where("start_ts is not null").withWatermark("start_ts", late)
    if ident:
        timed = timed.dropDuplicatesWithinWatermark([ident])
    out = timed.groupBy(F.col(key), window).agg(F.max(end).alias("_end"), F.count(F.lit(1)).alias("n_events"))
    return out.select(key, F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("_end").alias("end_us"), "n_events")


def closing_row(rows: DataFrame, gap_seconds: int = 300, late_seconds: int = 3600) -> DataFrame:
    """One row of the columns of bounded `rows` that moves the watermark past the end of all their sessions; none without rows.

    Read with the rows, it makes live_sessions emit every session; its own, of no key, stays open and doesn't come out.
    """
    end = F.greatest("start_ts", F.coalesce("end_ts", "start_ts"))
    last = rows.agg(F.max(F.unix_micros(end)).alias("_last")).where("_last is not null")
    at = F.timestamp_micros(F.col("_last") + (gap_seconds + late_seconds + 1) * 1_000_000)
    return last.select(*[(at if f.name == "start_ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's recent batches left out since they came too late."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def live_days(records: DataFrame, store: str, out: str, compute: Callable[[DataFrame], DataFrame], checkpoint: str, keys: list[str] = STREAM, version: str | None = None) -> StreamingQuery:
    """Keeps `out` (parquet, partitioned by keys) up to date with compute(all records of a key) for every key that a micro-batch touches.

    Sessions of a day depend on the rows before and after, so a late row means that its whole key is made anew. The store is partitioned by
    keys and batch: only days from the first to the last that a batch touches are listed, and of those only touched keys are joined. A repeated
    batch overwrites itself. Of several copies of an event the one with the greatest `version` counts, else any.
    """

    def update(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = batch.withColumn("_batch", F.lit(number)).persist()
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys, "_batch").parquet(store)
        touched = kept.select(*keys).distinct()
        first, last = touched.agg(F.min(keys[-1]), F.max(keys[-1])).first()
        if first is not None:
            rows = spark.read.schema(kept.schema).parquet(store).where(F.col(keys[-1]).between(first, last)).drop("_batch").join(touched, keys, "left_semi")
            whole = F.struct(*keys, "bucket_id", "event_id", "start_us").alias("_id")
            newest = F.max_by(F.struct(*rows.columns), F.col(version) if version else F.struct("start_us", "end_us"))
            compute(rows.groupBy(whole).agg(newest.alias("_r")).select("_r.*")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(out)
        kept.unpersist()

    return records.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
