"""Runs of near-identical consecutive events (problem 2)."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.llm.plain_text import Memo, plain_text
from chronoloom.operators.chunks import HOUR_US, stitched_alike
from chronoloom.spark_tools import end_or_start, latest_rows, micros, written

#: Marks that change by themselves while the same thing stays on screen, in folded text. A counter in brackets before a phone number is an area code.
LEADING_MARKS = regex.compile(
    r"""^\s*(?:
      \((?!0)\d{1,3}\+?\)\s*+(?!\d{3}[-. ]\d{4}(?!\d))   # (12)
    | \[\d{1,3}\+?\]\s*                                 # [3]
    | \(?\d{1,3}\s?%\)?\s*(?:[-–—|:]\s*|(?=\s))         # 65% -
    | \d{1,2}:\d{2}(?::\d{2})?\s+[-–—|]\s+              # 02:10:32 -
    | \d+\s(?:new|unread)\s\w+\s+[-–—|]\s+              # 5 new messages -
    | [*•●○◌◐◑◒◓◔◕▶►⏵⏸⏹🔊🔇🔴✱✳✻✽·!⠀-⣿️]+\s*
    )""",
    regex.X,
)
END = r"(?=\s+[-–—|]\s|\s*[\[(]|\s*$)"
INNER_MARKS = regex.compile(
    rf"""\s*(?:
      [\[(]\s*\d{{1,3}}\s?%\s*[\])]                                             # [43%] (65 %)
    | [\[(]\s*\d{{1,2}}:\d{{2}}(?::\d{{2}})?\s*[\])]                            # [31:36]
    | [\[(]\s*(?:unsaved|modified|edited|changed|saved|autosaved|read-only)\s*[\])]
    | [\[(]\s*(?:last\s)?(?:edited|saved|modified|updated|changed|synced)\s[^\[\]()]{{1,40}}[\])]
    | [\[(]\s*\d+\+?\s(?:unread|new|notifications?|messages?|mails?|emails?|items?)(?:\s\w+)?\s*[\])]
    | \s[-–—|]\s+\d{{1,2}}:\d{{2}}(?::\d{{2}})?{END}
    | \s[-–—|]\s+\d{{1,3}}\s?%{END}
    | \s[-–—|]\s+(?:auto)?saved(?:\sat)?\s\d{{1,2}}:\d{{2}}(?::\d{{2}})?{END}
    | \s[-–—|]\s+\d+\+?\s(?:new|unread)(?:\s\w+)?{END}
    | \sand\s\d+\smore\s(?:pages?|tabs?|windows?){END}
    | \s?[*•●](?=\s+[-–—|]\s|\s*$)
    )""",
    regex.X,
)
SPACE = regex.compile(r"\s+")


#: Decorations at the edge of a title that may come and go, whatever they say: words in brackets without digits, and signs.
WORDS_IN_BRACKETS = r"[\[({<]\s*(?!(?:copy|kopie|copie|draft|entwurf|final|old|new|backup|archive)\b)\p{L}+(?:\s\p{L}+){0,2}\s*[\])}>]"
DECORATIONS = regex.compile(rf"^\s*(?:{WORDS_IN_BRACKETS}|[\p{{So}}\p{{Sk}}»«›‹†‡]+)\s+|\s+(?:{WORDS_IN_BRACKETS}|[\p{{So}}\p{{Sk}}»«›‹†‡]+)(?=\s+[-–—|]\s|\s*$)")
_MAY_DECORATE = regex.compile(r"[\[({<\p{So}\p{Sk}»«›‹†‡]")
#: Dissimilarity of a decoration that one of two titles has and the other hasn't, against a penalty of 1 for a boundary.
DECORATION_COST = 0.6


def shown(text: str | None) -> tuple[str | None, tuple[str, ...]]:
    """(what a title or app shows, its decorations): plain form, folded case, single spaces, no counters, clocks, progress and unsaved marks.

    Numbers, versions, pages and names are kept. Null stays null; a text of marks only keeps them, so that it differs from an empty one.
    """
    if text is None:
        return None, ()
    folded = SPACE.sub(" ", (plain_text(text) or "").casefold()).strip()
    now, before = folded, None
    while now != before:
        before = now
        now = INNER_MARKS.sub("", LEADING_MARKS.sub("", now)).strip()
    now = now or folded
    if not _MAY_DECORATE.search(now) or not (found := {m.strip() for m in DECORATIONS.findall(now)}):
        return now, ()
    bare = DECORATIONS.sub("", now).strip()
    return (bare, tuple(sorted(found))) if bare else (now, ())


shown_app = functools.lru_cache(maxsize=10_000)(shown)


def stable_text(text: str | None) -> str | None:
    return shown(text)[0]


def content(app: str | None, title: str | None) -> tuple[int, list[int] | None]:
    """64 bits of what an event shows, and of each of its title's decorations; a missing part is the same only as a missing part."""
    parts = shown_app(app), shown(title)
    key = "\x02".join("\x00" if x is None else "\x01" + x for x, _ in parts)
    digest = lambda x: xxhash.xxh3_64_intdigest(x) - (1 << 63)
    return digest(key), [digest(d) for d in parts[1][1]] or None


def content_key(app: str | None, title: str | None) -> int:
    return content(app, title)[0]


_CONTENT = T.StructType([T.StructField("key", T.LongType()), T.StructField("extra", T.ArrayType(T.LongType()))])


@F.arrow_udf(_CONTENT)
def content_udf(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    memo = Memo(lambda x: content(*x))
    for apps, titles in batches:
        found = [memo[x] for x in zip(apps.to_pylist(), titles.to_pylist())]
        yield pa.StructArray.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([d for _, d in found], pa.list_(pa.int64()))], names=["key", "extra"])


def dissimilarity(a: list[int] | None, b: list[int] | None) -> float:
    """Of two events that show the same, by their decorations."""
    return 0.0 if a == b else DECORATION_COST * len(set(a or ()) ^ set(b or ()))


def optimal_segments(n: int, step: Callable[[int, int, int], float | None], penalty: float = 1.0, state: Callable[[int, int | None], int] | None = None, nested: bool = False) -> list[int]:
    """Starts of the segments of events 0..n-1 with the least sum of within-run dissimilarity plus `penalty` per boundary.

    step(j, start_state) tells the dissimilarity that event j adds to a run, or None if it can't belong to it; `state` folds an event into
    what a run must remember (its latest end). Pruned dynamic programming: a start is dropped once its cost without a further boundary
    reaches the best cost with one, since costs only grow and a fresh start never costs more; of equal costs the earliest start wins, so
    that ties give the longest runs. `nested` tells that whatever fits a run fits one that began earlier at no more cost; then a later
    start that costs no less is dropped at once, and the work is linear.
    """
    best, back = [0.0] + [0.0] * n, [0] * (n + 1)
    live: list[list] = []  # start, cost of the run so far added to best[start], state
    for j in range(n):
        kept = []
        for cand in live:
            d = step(j, cand[0], cand[2])
            if d is not None:
                cand[1] += d
                cand[2] = state(j, cand[2]) if state else 0
                kept.append(cand)
        kept.append([j, best[j] + (penalty if j else 0.0), state(j, None) if state else 0])
        top = min(kept, key=lambda c: c[1])
        best[j + 1], back[j + 1] = top[1], top[0]
        live = [c for c in kept if c is top or c[1] < top[1] + penalty]
        if nested:
            live = [c for c in live if c[0] <= top[0] or c[1] < top[1]]
    out, j = [], n
    while j > 0:
        out.append(back[j])
        j = back[j]
    return out[::-1]


PIECES = "bucket_id string, _chunk long, _key long, _s long, _e long, _n long, _from string, _till string, _xa array<bigint>, _xz array<bigint>, _cut boolean, _first boolean, _last boolean"


#: Items of a chunk held before those up to the last change of content are solved and let go.
HOLD_ITEMS = 20_000


class _Chunk:
    """The runs of one (bucket, chunk) as its rows come in, in order.

    Rows that are alike in all follow each other in one item, since no boundary between them can pay; so content that doesn't change is one item.
    Content that changes splits the optimum, so only items since the last change must be held; runs of the last stretch of equal content wait
    until it is known whether it is the chunk's last.
    """

    def __init__(self, name: tuple, gap_us: int, penalty: float):
        self.name, self.gap, self.penalty = name, gap_us, penalty
        self.items: list[list] = []  # start, latest end, key, decorations, rows, first id, last id
        self.changed, self.waiting, self.change, self.key = False, [], 0, None

    def solved(self, upto: int, out: list) -> None:
        items, self.items, self.change = self.items[:upto], self.items[upto:], 0
        tops: list[int] = []  # latest end in the stretch so far
        for j, x in enumerate(items):
            tops.append(max(tops[-1], x[1]) if j and x[2] == items[j - 1][2] else x[1])

        def step(j: int, start: int, state: int) -> float | None:
            a, b = items[j - 1], items[j]
            return dissimilarity(a[3], b[3]) if a[2] == b[2] and b[0] <= tops[j - 1] + self.gap else None

        starts = optimal_segments(len(items), step, self.penalty, nested=True)
        for a, b in zip(starts, [*starts[1:], len(items)]):
            part, key = items[a:b], items[a][2]
            fresh = not a or items[a - 1][2] != key
            if fresh and self.key is not None:
                self.changed = True
                out += [(*p, False) for p in self.waiting]
                self.waiting = []
            self.key = key
            cut = not fresh and (part[0][0] <= tops[a - 1] + self.gap or dissimilarity(items[a - 1][3], part[0][3]) > self.penalty)
            self.waiting.append((*self.name, key, part[0][0], max(x[1] for x in part), sum(x[4] for x in part), part[0][5], part[-1][6], part[0][3], part[-1][3], cut, not self.changed))

    def more(self, cols: list[list], out: list) -> None:
        items = self.items
        for s, e, key, extra, ident in zip(*cols):
            if items and (last := items[-1])[2] == key and s <= last[1] + self.gap and last[3] == extra:
                last[1], last[4], last[6] = max(last[1], e), last[4] + 1, ident
                continue
            if items and items[-1][2] != key:
                self.change = len(items)
            items.append([s, e, key, extra, 1, ident, ident])
        if len(items) >= HOLD_ITEMS and self.change:
            self.solved(self.change, out)

    def end(self, out: list) -> None:
        self.solved(len(self.items), out)
        out += [(*p, True) for p in self.waiting]


def _segmenter(gap_us: int, penalty: float):
    """Arrow batches sorted by bucket, chunk, start, id to one row per local run; a chunk may span batches."""
    schema = pa.schema([("bucket_id", pa.string()), ("_chunk", pa.int64()), ("_key", pa.int64()), ("_s", pa.int64()), ("_e", pa.int64()), ("_n", pa.int64()), ("_from", pa.string()), ("_till", pa.string()), ("_xa", pa.list_(pa.int64())), ("_xz", pa.list_(pa.int64())), ("_cut", pa.bool_()), ("_first", pa.bool_()), ("_last", pa.bool_())])

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, out = None, []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            n, lo = batch.num_rows, 0
            while lo < n:
                name, hi = (cols[0][lo], cols[1][lo]), lo + 1
                while hi < n and cols[1][hi] == name[1] and cols[0][hi] == name[0]:
                    hi += 1
                if chunk is None or chunk.name != name:
                    if chunk:
                        chunk.end(out)
                    chunk = _Chunk(name, gap_us, penalty)
                chunk.more([c[lo:hi] for c in cols[2:]], out)
                lo = hi
            if len(out) >= 20_000:
                yield table(out)
                out = []
        if chunk:
            chunk.end(out)
        if out:
            yield table(out)

    return run


def event_runs(rows: DataFrame, gap_us: int = 60_000_000, penalty: float = 1.0, chunk_us: int = 6 * HOUR_US) -> DataFrame:
    """Runs of consecutive events that show the same: bucket_id, first_event_id, last_event_id, start_us, end_us, duration_us, n_events.

    `rows` has event_id, bucket_id, s, e (microseconds), key (what is shown) and extra (its decorations, or null); other columns are ignored.
    Order is by s, then event_id. Neighbours of different keys, or further apart than `gap_us` after the latest end in the run so far, are
    infinitely dissimilar (the latest end counts over the whole stretch of a key); those of one key are as dissimilar as their decorations, so that one that comes or goes is less than `penalty`, and
    one in place of another is more.
    Method: optimal segmentation by pruned dynamic programming, per bucket and time chunk, of least dissimilarity between neighbours in a run
    plus `penalty` per boundary. As costs lie between neighbours, chunks are solved apart, and the runs at chunk borders joined from one summary
    row per chunk. Every run is given, also of one event.

    Rows without a start are left out; a null bucket is a bucket of its own; an end that is null or before its start is its start;
    repeated rows are events of the same run; an empty table gives an empty result.
    """
    rows = rows.where("s is not null").select("bucket_id", F.floor(F.col("s") / chunk_us).cast("long").alias("_chunk"), "s", F.greatest("s", F.coalesce("e", "s")).alias("e"), "key", "extra", "event_id")
    rows = rows.repartition("bucket_id", "_chunk").sortWithinPartitions("bucket_id", "_chunk", "s", "event_id")
    # Two plans read the local runs; writing them, a fraction of the rows, keeps Python from running twice.
    local = written(rows.mapInArrow(_segmenter(gap_us, penalty), PIECES), "runs")
    none = F.array().cast("array<bigint>")

    def follows(a: Column, b: Column) -> Column:
        a, b = F.coalesce(a, none), F.coalesce(b, none)
        return DECORATION_COST * (F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))) <= penalty

    runs = stitched_alike(local, ["bucket_id"], "_key", gap_us, follows)
    out = runs.groupBy("bucket_id", "_run").agg(F.min_by("_from", "_s").alias("first_event_id"), F.max_by("_till", "_s").alias("last_event_id"), F.max("_e").alias("end_us"), F.sum("_n").alias("n_events"))
    return out.select("bucket_id", "first_event_id", "last_event_id", F.col("_run").alias("start_us"), "end_us", (F.col("end_us") - F.col("_run")).alias("duration_us"), "n_events")


def activity_runs(activity: DataFrame, kinds: tuple[str, ...] = ("current-window", "browser"), gap_us: int = 60_000_000) -> DataFrame:
    """Runs of the counted records of `kinds`; records show the same if app and title are alike but for what changes by itself.

    Keys are made before records are deduplicated and cut into chunks, so that shuffles carry 8 bytes in place of texts.
    """
    rows = activity.where(F.col("kind").isin(*kinds)).select("event_id", "bucket_id", "start_ts", "end_ts", "ingested_at", content_udf("app", "title").alias("_c")).select("*", "_c.key", "_c.extra").drop("_c")
    rows = latest_rows(rows, "event_id", "ingested_at", ["start_ts", "end_ts"])
    return event_runs(rows.select("event_id", "bucket_id", micros("start_ts").alias("s"), end_or_start().alias("e"), "key", "extra"), gap_us)
