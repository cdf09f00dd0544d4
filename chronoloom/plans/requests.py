"""Bounded requests: ordered items cut greedily into chunks of bounded size."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.functions.formatting import iso_text
from chronoloom.functions.text_safety import sendable_text_of, sendable_title
from chronoloom.schema import STREAM
from chronoloom.spark_tools import written

TARGET, CEILING = 80_000, 100_000
CATEGORIES = ["anchor", "application", "activity-label", "outcome-signal"]


class RequestTooLargeError(RuntimeError):
    """An item alone doesn't fit into a request."""


def _greedy(keys: int, size: int, target: int, base: int, joint: int):
    """Arrow batches in order of key and item to the same rows with their chunk numbers; carries three numbers from row to row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, no, n, held = None, 1, 0, base
        for batch in batches:
            chunks = []
            for *mine, weight in zip(*(batch.column(i).to_pylist() for i in (*range(keys), size))):
                if mine != key:
                    key, no, n, held = mine, 1, 0, base
                more = (weight or 0) + (joint if n else 0)
                if n and held + more > target:
                    no, n, held, more = no + 1, 0, base, weight or 0
                n, held = n + 1, held + more
                chunks.append(no)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunks, pa.int32())], names=[*batch.schema.names, "chunk"])

    return run


def chunked(items: DataFrame, keys: list[str], order: list[str], size: str, target: int, base: int = 0, joint: int = 0) -> DataFrame:
    """Adds chunk (from 1) to the items of each key: a chunk is closed when the next item would take it over `target`.

    A chunk of n items has the size base + sum of sizes + joint * (n - 1). A key's items pass by in order, sorted outside of memory, so that a key
    may hold any number of them; a null size counts as 0, and a null key is a key of its own.
    """
    rest = [c for c in items.columns if c not in keys]
    rows = items.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*rows.schema.fields, T.StructField("chunk", T.IntegerType())])
    return rows.mapInArrow(_greedy(len(keys), rows.columns.index(size), target, base, joint), schema)


def _distinct(items: Column) -> Column:
    """Distinct items in their first order, without those that have no value."""
    return F.array_distinct(F.filter(items, lambda x: x["value"].isNotNull()))


@F.arrow_udf(T.StringType())
def compact_json(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Canonical JSON of objects on one line: keys sorted at every level, null members of the object itself left out."""
    for batch in batches:
        found = (None if x is None else json.loads(x) for x in batch.to_pylist())
        yield pa.array([None if x is None else json.dumps({k: v for k, v in x.items() if v is not None}, ensure_ascii=False, sort_keys=True) for x in found], pa.string())


def minimised(episodes: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """Episodes reduced to what a request may hold: safe labels, anchors, counts and signals, the JSON text of each and its length.

    Distinct texts are made safe once each: values are exploded, reduced and gathered again by position.
    """
    def reduced(column: str, title: bool) -> DataFrame:
        flat = episodes.select(*keys, "episode_id", F.posexplode(column).alias("pos", "x"))
        raw = F.col("x.value") if column != "outcome_signals" else F.col("x.label")
        is_title = F.col("x.kind") == "title" if column == "anchors" else F.lit(title)
        value = F.when(is_title, sendable_title(F.lit(None).cast("string"), raw)).otherwise(sendable_text_of(raw))
        flat = flat.withColumn("v", value)
        rest = {"anchors": [F.col("x.kind").alias("kind")], "applications": [F.col("x.count").alias("count")], "activity_labels": [F.col("x.count").alias("count")], "outcome_signals": [F.col("x.code").alias("code")]}[column]
        item = F.struct("pos", F.struct(*rest, F.col("v").alias("value")).alias("i"))
        return flat.groupBy(*keys, "episode_id").agg(_distinct(F.transform(F.array_sort(F.collect_list(item)), lambda p: p["i"])).alias(f"_{column}"))

    out = episodes.select(*keys, "episode_id", "start_us", "end_us", "active_seconds", "focused_seconds", "label", F.size("session_ids").alias("transition_count"))
    for column, title in (("anchors", False), ("applications", False), ("activity_labels", True), ("outcome_signals", False)):
        out = out.join(reduced(column, title), [*keys, "episode_id"], "left")
    body = F.struct(
        F.col("episode_id").alias("id"),
        iso_text(F.col("start_us")).alias("start"),
        iso_text(F.col("end_us")).alias("end"),
        "active_seconds",
        "focused_seconds",
        sendable_title(F.lit(None).cast("string"), F.col("label")).alias("label"),
        *[F.col(f"_{c}").alias(c) for c in ("anchors", "applications", "activity_labels", "outcome_signals")],
        "transition_count",
    )
    flags = zip(CATEGORIES, ("anchors", "applications", "activity_labels", "outcome_signals"))
    present = F.filter(F.array(*[F.when(F.coalesce(F.size(f"_{c}"), F.lit(0)) > 0, F.lit(name)) for name, c in flags]), lambda x: x.isNotNull())
    out = out.withColumn("payload", compact_json(F.to_json(body, {"ignoreNullFields": "false"}))).withColumn("data_categories", present)
    return out.select(*keys, "episode_id", "start_us", "payload", F.length("payload").cast("long").alias("size"), "data_categories")


def request_plan(episodes: DataFrame, keys: list[str] = STREAM, target: int = TARGET, ceiling: int = CEILING) -> DataFrame:
    """keys, chunk, episode_ids, payload, character_count, data_categories: the requests of each day, bounded by `ceiling`.

    Raises RequestTooLargeError if any request would be over it.
    """
    # Both are read several times; written once, so that the day's pipeline isn't run for each of them.
    items = chunked(minimised(written(episodes, "episodes"), keys), keys, ["start_us", "episode_id"], "size", target, base=2, joint=2)
    order = F.array_sort(F.collect_list(F.struct("start_us", "episode_id", "payload", "data_categories")))
    plan = items.groupBy(*keys, "chunk").agg(order.alias("i"))
    payload = F.concat(F.lit("["), F.array_join(F.transform("i", lambda x: x["payload"]), ", "), F.lit("]"))
    named = F.array_intersect(F.array(*map(F.lit, CATEGORIES)), F.array_distinct(F.flatten(F.transform("i", lambda x: x["data_categories"]))))
    plan = plan.select(*keys, "chunk", F.transform("i", lambda x: x["episode_id"]).alias("episode_ids"), payload.alias("payload"), F.length(payload).cast("long").alias("character_count"), named.alias("data_categories"))
    plan = written(plan, "requests")
    if plan.where(F.col("character_count") > ceiling).limit(1).count():
        raise RequestTooLargeError("a request exceeds its ceiling")
    return plan


def single_request(plan: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """The request of each day that needs only one; raises RequestTooLargeError if a day needs more."""
    if plan.where("chunk > 1").limit(1).count():
        raise RequestTooLargeError("a day needs more than one request")
    return plan.where("chunk = 1").select(*keys, "episode_ids", "payload", "character_count", "data_categories")


def plan_totals(plan: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """Requests, episodes and characters of each day; planned requests count a merge if there is more than one."""
    return plan.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), F.sum(F.size("episode_ids")).alias("episodes"), F.sum("character_count").alias("characters")).withColumn("planned", F.col("requests") + (F.col("requests") > 1).cast("long"))
