"""Small helpers shared by the operators: size-checked joins, deduplication, written tables."""

from __future__ import annotations

import atexit
import functools
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a dimension table is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


#: Bytes up to which the planner's bound on a table's size is enough to broadcast it; files of keys that are alike may hold over a hundred times as much in memory.
UNCOUNTED_BYTES = 50_000


#: Where the planner's bound is at most the first, more rows are broadcast as long as they take at most the second in memory.
BROADCAST_BYTES, BROADCAST_MEMORY = 4_000_000, 16_000_000


def row_bytes(df: DataFrame) -> int:
    """Bytes of a row in memory, roughly; texts and nested values as 40."""
    return 16 + sum(8 + 40 * (f.dataType.simpleString().startswith(("string", "binary", "array", "map", "struct"))) for f in df.schema)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table may be broadcast: by the planner's bound, which is made of the sizes of the files it reads, if that is tiny, or else by a count that stops early."""
    bound = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if bound <= UNCOUNTED_BYTES:
        return True
    most = max(max_rows, BROADCAST_MEMORY // row_bytes(df) if bound <= BROADCAST_BYTES else 0)
    return df.select(df.columns[0]).limit(most + 1).count() <= most


def small_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join on `on`, broadcasting `right` only if it is_small. Beyond that the join is left to the planner (sort-merge with adaptive skew handling)."""
    return left.join(F.broadcast(right) if is_small(right, max_rows) else right, on, how)


def latest_rows(df: DataFrame, id_col: str, version_col: str, ties: list[str]) -> DataFrame:
    """The row with the greatest `version_col` for each `id_col`; equal versions are settled by `ties`, so that only equal rows are alike.

    An aggregation, so that copies meet before the shuffle: an id may hold a third of all rows. Rows without an id are all kept, since
    nothing says that two of them are the same record.
    """
    rows = df.withColumn("_own", F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()))
    newest = F.max_by(F.struct(*df.columns), F.struct(version_col, *ties))
    return rows.groupBy(id_col, "_own").agg(newest.alias("_row")).select("_row.*")


def latest_records(activity: DataFrame, columns: list[str]) -> DataFrame:
    """Counted rows of an activity table: per event_id the one with the latest ingested_at, with `columns` only."""
    need = list(dict.fromkeys(["event_id", *columns, "start_ts", "end_ts", "ingested_at"]))
    return latest_rows(activity.select(*need), "event_id", "ingested_at", ["start_ts", "end_ts"]).select(*columns)


def micros(c: str | Column) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def end_or_start(start: str = "start_ts", end: str = "end_ts") -> Column:
    """End in microseconds; an end that is null or before its start is its start."""
    return F.greatest(micros(start), F.coalesce(micros(end), micros(start)))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local one, but only if all executors are in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` as a table written to the shared folder: cuts the lineage, is computed once, survives lost executors. Deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


@functools.cache
def _package_zip() -> str:
    root = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="chronoloom-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    atexit.register(Path(name).unlink, missing_ok=True)
    return name


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Makes the package importable in the session's Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        spark.sparkContext.addPyFile(_package_zip())
        _shipped.add(app)
    return spark
