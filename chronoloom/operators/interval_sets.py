"""Continuous periods and gaps of overlapping intervals (problem 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.operators.chunks import HOUR_US
from chronoloom.spark_tools import latest_records, micros, written

#: Rows that a task holds before it gives out its partial lists.
PARTIAL_ROWS = 100_000
#: A list of the aggregate: sorted disjoint intervals; `on` tells that what lies between an interval and the one before it is given out already.
LIST = "array<struct<s:bigint,e:bigint,on:boolean>>"
_LIST = T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType()), T.StructField("on", T.BooleanType())]))
_ITEM = pa.struct([("s", pa.int64()), ("e", pa.int64()), ("on", pa.bool_())])


def merge_runs(group: np.ndarray, s: np.ndarray, e: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merges the sorted lists of each group, which lie one behind the other, into one sorted disjoint list a group.

    Groups are numbered in ascending order. The sort is stable and finds the runs that are sorted already, so that it merges them; one pass of
    running ends then joins what overlaps or touches. A joined interval is `on` if its first part is.
    """
    n = len(s)
    if not n:
        return group, s, e, on
    low = np.minimum.reduceat(s, np.flatnonzero(np.r_[True, group[1:] != group[:-1]]))
    index = np.cumsum(np.r_[0, group[1:] != group[:-1]])
    away = s - low[index]
    bits = int(away.max()).bit_length()
    order = np.argsort((index << bits) | away, kind="stable") if int(index[-1]).bit_length() + bits < 63 else np.lexsort((s, index))
    s, e, on, index, group = s[order], e[order], on[order], index[order], group[order]
    ends = np.sort(e)
    place = np.searchsorted(ends, e)  # ends by rank, so that the running maximum starts anew in each group
    top = ends[np.maximum.accumulate(index * n + place) - index * n]
    fresh = np.r_[True, (index[1:] != index[:-1]) | (s[1:] > top[:-1])]
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:], n] - 1
    return group[first], s[first], top[last], on[first]


def _lists(group: np.ndarray, s: np.ndarray, e: np.ndarray, on: np.ndarray, groups: int) -> pa.ListArray:
    offsets = np.searchsorted(group, np.arange(groups + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(s), pa.array(e), pa.array(on)], fields=list(_ITEM)))


@F.arrow_udf(_LIST)
def merged_list(lists: pa.Array) -> pa.Array:
    """Linear merge of partial lists that are written one behind the other."""
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    s, e, on = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    return _lists(*merge_runs(np.repeat(np.arange(len(lists)), size), s, e, on), len(lists))


def _partial(leaf_us: int):
    """Arrow batches of key, s, e to partial lists: key, node, items. Rows of a node that a task holds at a time meet before the shuffle."""

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        keys = t.column(0).combine_chunks()
        code = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        s, e = (t.column(i).to_numpy() for i in (1, 2))
        node = s // leaf_us
        order = np.lexsort((s, node, code))
        code, node, s, e = code[order], node[order], s[order], e[order]
        fresh = np.r_[True, (code[1:] != code[:-1]) | (node[1:] != node[:-1])]
        at = np.flatnonzero(fresh)
        lists = _lists(*merge_runs(np.cumsum(fresh) - 1, s, e, np.zeros(len(s), dtype=bool)), len(at))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(order[at])), pa.array(node[at]), lists], names=["_key", "_node", "items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= PARTIAL_ROWS:
                yield made(held)
                held, rows = [], 0
        if rows:
            yield made(held)

    return run


def _combined(parts: DataFrame, by: list[str]) -> DataFrame:
    """One list for each `by` from the lists `items` of its parts."""
    return parts.groupBy(*by).agg(F.flatten(F.array_sort(F.collect_list("items"))).alias("items")).withColumn("items", merged_list("items"))


def _settled(lists: DataFrame, top: bool) -> DataFrame:
    """Adds to complete lists what is final and, unless this is the top, leaves in `items` the first and last interval, the only ones that other lists can reach.

    `periods` are the intervals between those two, or all at the top; `gaps` are the spaces between neighbours that weren't given out before.
    """
    n = F.size("items")
    pairs = F.zip_with("items", F.slice("items", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a["e"].alias("s"), b["s"].alias("e"), b["on"].alias("on")))
    gaps = F.transform(F.filter(pairs, lambda g: g["e"].isNotNull() & ~g["on"]), lambda g: F.struct(g["s"].alias("s"), g["e"].alias("e")))
    bare = lambda x: F.transform(x, lambda i: F.struct(i["s"].alias("s"), i["e"].alias("e")))
    inner = F.col("items") if top else F.slice("items", 2, F.greatest(n - 2, F.lit(0)))
    out = lists.withColumns({"periods": bare(inner), "gaps": gaps})
    if top:
        return out
    last = F.element_at("items", -1)
    edges = F.when(n > 1, F.array(F.element_at("items", 1), F.struct(last["s"].alias("s"), last["e"].alias("e"), F.lit(True).alias("on")))).otherwise(F.col("items"))
    return out.withColumn("items", edges)


def _named(intervals: str, piece: str) -> Column:
    return F.transform(intervals, lambda x: F.struct(F.lit(piece).alias("piece"), x["s"].alias("start_us"), x["e"].alias("end_us")))


def periods_and_gaps(rows: DataFrame, key: str, max_gap_us: int | None = None, leaf_us: int = 6 * HOUR_US, fan: int = 64) -> DataFrame:
    """Merged periods and the gaps between them: columns key, piece ('period' or 'gap'), start_us, end_us.

    `rows` has `key`, `s`, `e` in microseconds; other columns are ignored. Touching intervals merge; gaps longer than `max_gap_us` are not listed.
    Method: a mergeable aggregate whose state is a sorted list of disjoint intervals. Tasks build partial lists of each (key, leaf of time) from
    the rows that they hold; after the shuffle a leaf's partial lists are combined by a linear merge. An interval that reaches beyond its leaf is
    met in the later leaves by the latest end of the leaves before them. Lists then go up a reduction tree, `fan` leaves to a node, the nodes of
    a key to one: at each node the lists of its children are merged linearly, and what no other list can reach any more is given out together
    with the complement, so that a list holds two intervals of each child however many rows the key has.
    A leaf's list is bounded by its disjoint intervals; a busy key is many leaves in many tasks.

    Rows without a key keep a null key; rows without an end after their start are left out; equal rows merge; an empty table gives an empty result.
    """
    rows = rows.select(F.col(key).alias("_key"), F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e")).where("s is not null and e > s")
    kind = rows.schema["_key"].dataType.simpleString()
    parts = rows.mapInArrow(_partial(leaf_us), f"_key {kind}, _node long, items {LIST}")
    lists = written(_combined(parts, ["_key", "_node"]), "lists")  # read twice: for the ends, and for the lists
    earlier = Window.partitionBy("_key").orderBy("_node").rowsBetween(Window.unboundedPreceding, -1)
    # One row a leaf; only those that something reaches into are joined back.
    reach = lists.select("_key", "_node", F.element_at("items", -1)["e"].alias("_end")).withColumn("_reach", F.max("_end").over(earlier))
    reach = reach.where(F.col("_reach") > F.col("_node") * leaf_us).select(F.col("_key").alias("_k"), F.col("_node").alias("_n"), "_reach")
    lists = lists.join(reach, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_node") == F.col("_n")), "left")
    begin = F.col("_node") * leaf_us
    cover = F.struct(begin.alias("s"), F.col("_reach").alias("e"), F.lit(False).alias("on"))
    lists = lists.select("_key", "_node", F.when(F.col("_reach").isNotNull(), F.concat(F.array(cover), "items")).otherwise(F.col("items")).alias("items"))
    levels = [written(_settled(lists.withColumn("items", merged_list("items")), top=False), "level")]
    for _ in range(2):
        up = levels[-1].select("_key", F.floor(F.col("_node") / fan).cast("long").alias("_node"), "items")
        levels.append(written(_settled(_combined(up, ["_key", "_node"]), top=False), "level"))
    levels.append(_settled(_combined(levels[-1].select("_key", "items"), ["_key"]), top=True))
    out = None
    for level in levels:
        named = [_named(c, piece) for c, piece in (("periods", "period"), ("gaps", "gap"))]
        found = level.select(F.col("_key").alias(key), F.explode(F.concat(*named)).alias("p")).select(key, "p.*")
        out = found if out is None else out.unionByName(found)
    if max_gap_us is not None:
        out = out.where((F.col("piece") == "period") | (F.col("end_us") - F.col("start_us") <= max_gap_us))
    return out


def bucket_periods(activity: DataFrame, max_gap_us: int = 6 * HOUR_US) -> DataFrame:
    """Periods and gaps of every bucket, of any kind, from counted records."""
    records = latest_records(activity, ["bucket_id", "start_ts", "end_ts"])
    return periods_and_gaps(records.select("bucket_id", micros("start_ts").alias("s"), micros("end_ts").alias("e")), "bucket_id", max_gap_us)
