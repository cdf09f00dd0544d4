"""Texts made safe to keep or to send: addresses, mails and secrets replaced, paths reduced to names.

What needs NFKC or a replacement computed from the match runs in one Arrow UDF; everything else is built-in expressions.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.operators.fusion import numbered
from chronoloom.schema import STREAM

# What counts as an e-mail address, a secret, a web address, and a browser's tail of other pages.
EMAIL = re.compile(r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b")
OTHER_PAGES = re.compile(r"\s+and \d+ more pages(?:\s+-.*?)?\s+-\s+Microsoft.? Edge$", re.I)
SECRET = re.compile(
    r"(?i)(bearer\s+[A-Za-z0-9._~-]+|\b(?:api[_-]?key|access[_-]?(?:key|token)|code[_-]?challenge|session[_-]?state|password[_-]?reset|token|secret|key|code|state)\s*[=:]\s*[A-Za-z0-9._~-]{12,})"
)
WEB_ADDRESS = re.compile(
    r"(?i)(?<![\w@])(?:https?://)?(?:[^\s/@]+:[^\s/@]+@)?(?:localhost|\[[0-9a-f:]+\]|(?:\d{1,3}\.){3}\d{1,3}|(?:[a-z0-9-]+\.)+[a-z]{2,})(?::\d{1,5})?(?:/[^\s]*)?"
)
SIGN_IN_HOSTS = ["login.", "auth.", "accounts."]
SIGN_IN_PATHS = ["oauth", "authorize", "callback", "signin", "challenge", "recover", "reset"]
TEXT_CAP, HOST_CAP = 500, 253


def _only_host(address: re.Match) -> str:
    """The lower-case host of an address: what is left between scheme, user and port, path."""
    server = address[0].rpartition("://")[2].partition("/")[0].rpartition("@")[2]
    if not server.startswith("["):
        return server.partition(":")[0].casefold()
    inside = server[1:].partition("]")[0].casefold()
    try:
        return str(inside) if ipaddress.ip_address(inside) else ""
    except ValueError:
        return "[redacted-url]"


#: What is replaced in a line, in this order; the browser's tail goes from captured texts only.
RULES = ((WEB_ADDRESS, _only_host), (EMAIL, "[redacted-email]"), (OTHER_PAGES, ""), (SECRET, "[redacted-secret]"))


def one_line(value: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", value).split())


def replaced(line: str, tail: bool) -> str:
    for pattern, by in RULES:
        if tail or pattern is not OTHER_PAGES:
            line = pattern.sub(by, line)
    return line


def safe_generated(value: str) -> str:
    """A generated text on one line, without addresses and secrets."""
    return replaced(one_line(value), tail=False)


def last_name(path: str) -> str:
    """Last part of a path; backslashes part it too, and a drive is no part of it, if it has a backslash or colon."""
    windows = "\\" in path or ":" in path
    names = [n for n in (path.replace("\\", "/") if windows else path).split("/") if n not in ("", ".")]
    last = names[-1] if names else ""
    return last[2:] if windows and len(names) == 1 and last[1:2] == ":" and last[:1].isalpha() else last


class SafeText(NamedTuple):
    """A captured text made safe, null if nothing is left, and in how many steps more than its form changed."""

    text: str | None
    changes: int


def safe_text(value: str | None, name_only: bool = False) -> SafeText:
    """A captured text, or with name_only the name in a captured path."""
    line = one_line(value or "")
    steps = [line, replaced(line, tail=True)]
    cut = steps[-1][:TEXT_CAP]
    if name_only and cut:
        steps += [cut, last_name(cut)]
        cut = steps[-1]
    return SafeText(cut or None, sum(a != b for a, b in zip(steps[::2], steps[1::2])))


def safe_file(value: str | None) -> SafeText:
    return safe_text(value, name_only=True)


def sendable_text(value: str | None, name_only: bool = False) -> str | None:
    """A text, or the name in a path, that may leave the machine."""
    out = safe_generated(last_name(value or "") if name_only else value or "")
    return out[:TEXT_CAP] or None


def holds_secret(value: str) -> bool:
    """Whether a text holds anything that would be replaced."""
    return safe_generated(value) != value


class UnsafePayloadError(RuntimeError):
    """Something in a payload would still be replaced; the message holds none of it."""

    def __init__(self) -> None:
        super().__init__("unsafe payload")


def check_payload(payload: object) -> None:
    """Raises UnsafePayloadError if any text of a nested payload, keys too, isn't safe."""
    todo = [payload]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            if holds_secret(item):
                raise UnsafePayloadError
        elif isinstance(item, dict):
            todo += [*item.keys(), *item.values()]
        elif isinstance(item, (list, tuple)):
            todo += item


def _remembered(fn: Callable, size: int = 50_000) -> Callable:
    known: dict = {}

    def get(value):
        if value not in known:
            if len(known) >= size:
                known.clear()
            known[value] = fn(value)
        return known[value]

    return get


#: Captured fields that are made safe, and whether only the name in them may stay.
FIELDS = {"app": False, "title": False, "language": False, "project": True, "file": True}
_SAFE = T.StructType([*[T.StructField(f, T.StringType()) for f in FIELDS], T.StructField("changes", T.IntegerType())])


@F.arrow_udf(_SAFE)
def safe_fields(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """All captured fields of a record made safe in one pass, and in how many steps they changed."""
    texts, names = _remembered(safe_text), _remembered(safe_file)
    for batch in batches:
        changes = np.zeros(len(batch[0]), dtype=np.int32)
        columns = []
        for column, name_only in zip(batch, FIELDS.values()):
            get = names if name_only else texts
            distinct = column.dictionary_encode()  # each text of a batch once
            made = [get(v) for v in distinct.dictionary.to_pylist()]
            at = distinct.indices
            columns.append(pa.array([m.text for m in made], pa.string()).take(at))
            changes += np.array([*(m.changes for m in made), 0], dtype=np.int32)[at.fill_null(len(made)).to_numpy(zero_copy_only=False)]
        yield pa.StructArray.from_arrays([*columns, pa.array(changes)], names=[f.name for f in _SAFE])


def _text_udf(fn: Callable):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        get = _remembered(fn)
        for batch in batches:
            yield pd.Series([get(v) if isinstance(v, str) else None for v in batch], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.StringType())


def generated_text_of(c: str) -> Column:
    return _text_udf(safe_generated)(F.col(c))


def sendable_text_of(c: Column) -> Column:
    return _text_udf(sendable_text)(c)


def safe_path(host: Column, path: Column) -> Column:
    """What of a URL's path may be kept: two parts on code hosts, five for their merge requests and jobs, nothing of sign-in pages."""
    low, parts = F.lower(host), F.filter(F.split(path, "/"), lambda p: p != "")
    signing = F.coalesce(low.rlike("^(" + "|".join(h.replace(".", "\\.") for h in SIGN_IN_HOSTS) + ")"), F.lit(False)) | F.lower(path).rlike("|".join(SIGN_IN_PATHS))
    item = (F.size(parts) >= 5) & (F.get(parts, F.lit(2)) == "-") & F.get(parts, F.lit(3)).isin("merge_requests", "jobs")
    keep = F.when(low == "github.com", 2).when(low.contains("gitlab"), F.when(item, 5).otherwise(2))
    return F.when(~signing & keep.isNotNull() & (F.size(parts) >= 2), F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), keep), "/")))


#: What a title is reduced to: where to look (application, title, or both in lower case), for what, and the text; ? stands for the kind of mail.
# The patterns and the texts.
TITLE_RULES = (
    ("title", r"(?i)^[^\n]*?\(DM\)(?:(?!teams)[^\n])*slack[^\n]*$", "Direct message - Slack"),
    ("title", r"(?i)^[^\n]*?\(DM\)[^\n]*teams[^\n]*$", "Direct message - Teams"),
    ("app", "teams", "Meeting - Microsoft Teams"),
    ("title", "(?i)microsoft teams", "Meeting - Microsoft Teams"),
    ("both", "outlook", "? - Outlook"),
    ("both", "gmail", "? - Gmail"),
    ("app", "mail|thunderbird", "? - Mail"),
)
MAIL_KINDS = (("inbox", "Inbox"), ("calendar", "Calendar"), ("", "Email"))


def sendable_title(app: Column, title: Column) -> Column:
    """A title reduced for sending: the first rule that fits gives its text, others are made safe; null for null and empty titles."""
    low = F.lower(F.coalesce(app, F.lit("")))
    places = {"app": low, "title": title, "both": F.concat(low, F.lit(" "), F.lower(title))}
    kind = F.coalesce(*[F.when(F.lower(title).contains(word), F.lit(name)) for word, name in MAIL_KINDS])
    ruled = [F.when(places[where].rlike(pattern), F.replace(F.lit(to), F.lit("?"), kind)) for where, pattern, to in TITLE_RULES]
    return F.when(title != "", F.coalesce(*ruled, sendable_text_of(title)))


def observations(records: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """Records as observations: numbered evidence in place of event and bucket ids, safe texts, file names, reduced paths, and `changes`,
    how many of its fields held something private (a path that is safe but longer than its name counts once more)."""
    rows = numbered(records, keys).withColumn("_safe", safe_fields(*FIELDS))
    host = F.substring(F.lower("url_host"), 1, HOST_CAP)
    texts = [F.col(f"_safe.{c}").alias(c) for c in ("app", "title", "project", "file", "language")]
    return rows.select(*keys, "evidence_id", "kind", "start_us", "end_us", *texts, host.alias("url_host"), safe_path(host, F.col("url_path")).alias("url_path"), F.col("_safe.changes").alias("changes"))


def changed_fields(records: DataFrame) -> DataFrame:
    """Records without their texts, with `changes` as observations have it."""
    rows = records.withColumn("changes", safe_fields(*FIELDS)["changes"])
    return rows.drop("event_id", "bucket_id", "status", "url_host", "url_path", *FIELDS)
