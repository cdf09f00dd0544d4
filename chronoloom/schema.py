"""Column layouts and constants of the interval data model. Instants are epoch microseconds, half-open intervals [start_us, end_us)."""

from __future__ import annotations

DAY_US = 86_400_000_000
SECOND_US = 1_000_000

# Watcher types and the kind of record each gives.
KIND_OF_TYPE = {
    "currentwindow": "current-window",
    "afkstatus": "afk",
    "app.editor.activity": "editor",
    "web.tab.current": "browser",
}

CONTENT = ["kind", "app", "title", "project", "file", "url_host", "url_path", "language", "status"]
TEXTS = ["app", "title", "project", "file", "url_host", "url_path", "language", "status"]
RECORD = ["event_id", "bucket_id", "kind", "start_us", "end_us", *TEXTS]

#: What a stream of records is partitioned by; a device-day is the unit that fits in one task.
STREAM = ["hostname", "day"]

# Diagnostic codes in their order of output, and their messages.
DIAGNOSTICS = {
    "non-positive-event": "non-positive event",
    "naive-timestamp": "event with a naive timestamp",
    "unsupported-bucket": "unsupported bucket",
    "window-conflict": "conflicting foreground interval",
    "sanitized-field": "captured field containing private data",
    "unreadable-timestamp": "event with an unreadable timestamp",
}
