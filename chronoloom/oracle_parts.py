"""Named parts of the comparison SQL, put together with what each needs before it."""

from __future__ import annotations

DAY = 86_400_000_000
FAR = 4_611_686_018_427_387_904

GENERIC = r"""(regexp_replace(lower({v}), '\.exe$', '') IN ('chatgpt', 'powershell', 'new tab', 'inbox', 'slack', 'outlook', 'explorer', 'unknown', 'unknown activity') OR regexp_matches({v}, '(?i)(\(DM\).*Slack|\b(?:Inbox|Calendar).*Outlook|\bMicrosoft Teams$)'))"""

PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "counted": ((), """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ingested_at DESC, start_ts DESC, end_ts DESC) AS rn FROM activity_records) WHERE rn = 1"""),
    "windows": ((), """
  SELECT hostname, local_day, min(epoch_us(window_start)) AS ws, max(epoch_us(window_end)) AS we FROM day_windows WHERE window_start IS NOT NULL GROUP BY ALL HAVING min(epoch_us(window_start)) < max(epoch_us(window_end))"""),
    "whole": (("windows",), """
  SELECT hostname, min(ws) AS ws, max(we) AS we FROM (
    SELECT *, sum(CASE WHEN top IS NULL OR ws > top THEN 1 ELSE 0 END) OVER (PARTITION BY hostname ORDER BY ws, we ROWS UNBOUNDED PRECEDING) AS no FROM (
      SELECT *, max(we) OVER (PARTITION BY hostname ORDER BY ws, we ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM windows)) GROUP BY hostname, no"""),
    "breaks": (("whole",), f"""
  SELECT hostname, coalesce(lag(we) OVER (PARTITION BY hostname ORDER BY ws), -{FAR}) AS gs, ws AS ge FROM whole
  UNION ALL SELECT hostname, max(we), {FAR} FROM whole GROUP BY hostname"""),
    "opened": (("counted",), """
  SELECT b.hostname, c.event_id, c.bucket_id, c.kind, epoch_us(start_ts) AS s, epoch_us(end_ts) AS e, nullif(app, '') AS app, nullif(title, '') AS title, nullif(project, '') AS project, nullif(file, '') AS file,
         nullif(url_host, '') AS url_host, nullif(url_path, '') AS url_path, nullif(code_language, '') AS language, nullif(status, '') AS status
  FROM counted c JOIN watch_buckets b USING (bucket_id) WHERE end_ts > start_ts"""),
    "records": (("opened", "windows", "breaks"), f"""
  SELECT o.* EXCLUDE (s, e), CAST(w.local_day AS VARCHAR) AS day, greatest(o.s, w.ws) AS start_us, least(o.e, w.we) AS end_us FROM opened o JOIN windows w ON w.hostname = o.hostname AND o.s < w.we AND o.e > w.ws
  UNION ALL BY NAME
  SELECT x.* EXCLUDE (s, e, d), CAST(DATE '1970-01-01' + CAST(d AS INTEGER) AS VARCHAR) AS day, greatest(s, d * {DAY}) AS start_us, least(e, (d + 1) * {DAY}) AS end_us FROM (
    SELECT p.*, d.d FROM (SELECT * FROM (SELECT o.* REPLACE (greatest(o.s, coalesce(b.gs, o.s)) AS s, least(o.e, coalesce(b.ge, o.e)) AS e) FROM opened o LEFT JOIN breaks b ON b.hostname = o.hostname) WHERE s < e) p,
      LATERAL (SELECT unnest(range(p.s // {DAY}, (p.e - 1) // {DAY} + 1)) AS d) d) x"""),
    "away": (("records",), """
  SELECT hostname, day, min(start_us) AS start_us, max(end_us) AS end_us FROM (
    SELECT *, sum(CASE WHEN top IS NULL OR start_us > top THEN 1 ELSE 0 END) OVER (PARTITION BY hostname, day ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS no FROM (
      SELECT *, max(end_us) OVER (PARTITION BY hostname, day ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
      FROM records WHERE kind = 'afk' AND lower(status) = 'afk')) GROUP BY hostname, day, no"""),
    "holes": (("away",), f"""
  SELECT hostname, day, coalesce(lag(end_us) OVER (PARTITION BY hostname, day ORDER BY start_us), -{FAR}) AS gs, start_us AS ge FROM away
  UNION ALL SELECT hostname, day, max(end_us), {FAR} FROM away GROUP BY hostname, day"""),
    "active": (("records", "holes"), f"""
  SELECT * FROM (
    SELECT r.* REPLACE (greatest(r.start_us, coalesce(h.gs, -{FAR})) AS start_us, least(r.end_us, coalesce(h.ge, {FAR})) AS end_us)
    FROM records r LEFT JOIN holes h ON r.hostname = h.hostname AND r.day = h.day WHERE r.kind <> 'afk') WHERE start_us < end_us"""),
    "merged": (("active",), """
  SELECT hostname, day, min_by(event_id, (start_us, event_id, end_us)) AS event_id, bucket_id, any_value(kind) AS kind, any_value(app) AS app, any_value(title) AS title, min(start_us) AS start_us, max(end_us) AS end_us FROM (
    SELECT *, sum(CASE WHEN top IS NULL OR start_us - top > 60000000 THEN 1 ELSE 0 END) OVER (PARTITION BY hostname, day, bucket_id, same ORDER BY start_us, event_id, end_us ROWS UNBOUNDED PRECEDING) AS no FROM (
      SELECT *, max(end_us) OVER (PARTITION BY hostname, day, bucket_id, same ORDER BY start_us, event_id, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (
        SELECT *, sum(change) OVER (PARTITION BY hostname, day, bucket_id ORDER BY start_us, event_id, end_us ROWS UNBOUNDED PRECEDING) AS same FROM (
          SELECT *, CASE WHEN lag(start_us) OVER w IS NULL OR lag(content) OVER w <> content THEN 1 ELSE 0 END AS change
          FROM (SELECT *, concat_ws(chr(1), kind, coalesce(app, chr(2)), coalesce(title, chr(2)), coalesce(project, chr(2)), coalesce(file, chr(2)), coalesce(url_host, chr(2)), coalesce(url_path, chr(2)), coalesce(language, chr(2)), coalesce(status, chr(2))) AS content FROM active)
          WINDOW w AS (PARTITION BY hostname, day, bucket_id ORDER BY start_us, event_id, end_us))))) GROUP BY hostname, day, bucket_id, same, no"""),
    "wpieces": (("active",), """
  SELECT * FROM (SELECT hostname, day, p AS start_us, lead(p) OVER (PARTITION BY hostname, day ORDER BY p) AS end_us
  FROM (SELECT DISTINCT hostname, day, unnest([start_us, end_us]) AS p FROM active WHERE kind = 'current-window')) WHERE end_us IS NOT NULL"""),
    "allocated": (("wpieces", "active"), """
  SELECT hostname, day, bucket_id, event_id, ws AS start_us, we AS end_us, any_value(app) AS app, any_value(title) AS title, sum(e - s) AS us, sum(e - s) / 1e6 AS seconds FROM (
    SELECT p.hostname, p.day, p.start_us AS s, p.end_us AS e, a.bucket_id, a.event_id, a.start_us AS ws, a.end_us AS we, a.app, a.title,
           row_number() OVER (PARTITION BY p.hostname, p.day, p.start_us ORDER BY a.bucket_id, a.event_id) AS rn
    FROM wpieces p JOIN active a ON a.hostname = p.hostname AND a.day = p.day AND a.kind = 'current-window' AND a.start_us < p.end_us AND a.end_us > p.start_us)
  WHERE rn = 1 GROUP BY hostname, day, bucket_id, event_id, ws, we"""),
    "apps": (("allocated",), """
  SELECT hostname, day, coalesce(app, 'Unknown application') AS app, sum(us) AS us, sum(us) / 1e6 AS seconds FROM allocated GROUP BY ALL"""),
    "observed": (("active",), """
  SELECT *, format('evidence-{:04d}', row_number() OVER (PARTITION BY hostname, day ORDER BY start_us, bucket_id, event_id, end_us)) AS evidence_id FROM active"""),
    "pieces": (("observed",), """
  SELECT * FROM (SELECT hostname, day, p AS start_us, lead(p) OVER (PARTITION BY hostname, day ORDER BY p) AS end_us
  FROM (SELECT DISTINCT hostname, day, unnest([start_us, end_us]) AS p FROM observed)) WHERE end_us IS NOT NULL"""),
    "covered": (("pieces", "observed"), """
  SELECT p.hostname, p.day, p.start_us, p.end_us, count(*) FILTER (WHERE o.kind = 'current-window') AS windows,
         min(o.evidence_id) FILTER (WHERE o.kind = 'current-window') AS win
  FROM pieces p JOIN observed o ON o.hostname = p.hostname AND o.day = p.day AND o.start_us < p.end_us AND o.end_us > p.start_us
  GROUP BY p.hostname, p.day, p.start_us, p.end_us"""),
    "fused": (("covered", "observed"), """
  SELECT c.hostname, c.day, c.start_us, c.end_us, c.windows, c.win IS NOT NULL AS focused, any_value(w.app) AS app, any_value(w.title) AS title,
         coalesce(string_agg(o.evidence_id, ',' ORDER BY o.evidence_id), '') AS contexts, any_value(w.evidence_id) AS win,
         first(lower(coalesce(o.project, o.url_path, o.file)) ORDER BY o.evidence_id) FILTER (WHERE coalesce(o.project, o.url_path, o.file) IS NOT NULL) AS context_key,
         first(o.url_path ORDER BY o.evidence_id) FILTER (WHERE o.url_path IS NOT NULL) AS context_path,
         first(CASE WHEN o.project IS NOT NULL THEN CASE WHEN regexp_matches(o.project, '[\\\\:]') THEN regexp_extract(regexp_replace(o.project, '[\\\\/]+$', ''), '([^\\\\/:]*)$', 1) ELSE list_last(string_split(regexp_replace(o.project, '/+$', ''), '/')) END WHEN o.url_path IS NOT NULL THEN trim(o.url_path, '/') ELSE o.title END ORDER BY o.evidence_id) FILTER (WHERE coalesce(o.project, o.url_path, o.title) IS NOT NULL) AS context_label
  FROM covered c
  LEFT JOIN observed w ON w.hostname = c.hostname AND w.day = c.day AND w.evidence_id = c.win
  LEFT JOIN observed o ON o.hostname = c.hostname AND o.day = c.day AND o.kind <> 'current-window' AND o.start_us < c.end_us AND o.end_us > c.start_us
    AND (c.win IS NULL OR (o.kind = 'browser' AND regexp_matches(lower(coalesce(w.app, '')), 'edge|chrome|firefox|brave|opera|safari'))
         OR (o.kind = 'editor' AND regexp_matches(lower(coalesce(w.app, '')), 'code|codium|pycharm|idea|sublime|zed')))
  GROUP BY c.hostname, c.day, c.start_us, c.end_us, c.windows, c.win"""),
    "slices": (("fused",), """
  SELECT hostname, day, min(start_us) AS start_us, max(end_us) AS end_us, any_value(focused) AS focused, any_value(app) AS app, any_value(title) AS title, any_value(contexts) AS contexts, any_value(context_key) AS context_key, any_value(context_path) AS context_path, any_value(context_label) AS context_label,
         flatten(list(list_filter(list_append(string_split(contexts, ','), win), lambda x: x <> ''))) AS evidence FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY hostname, day ORDER BY start_us ROWS UNBOUNDED PRECEDING) AS no FROM (
      SELECT *, CASE WHEN lag(end_us) OVER w = start_us AND lag(focused) OVER w = focused AND lag(app) OVER w IS NOT DISTINCT FROM app
                      AND lag(title) OVER w IS NOT DISTINCT FROM title AND lag(contexts) OVER w = contexts THEN 0 ELSE 1 END AS fresh
      FROM fused WINDOW w AS (PARTITION BY hostname, day ORDER BY start_us))) GROUP BY hostname, day, no"""),
    "keyed": (("slices",), """
  SELECT *, coalesce(context_key, CASE WHEN lower(title) NOT IN ('chatgpt', 'powershell', 'new tab', 'inbox', 'slack', 'outlook', 'new repository', 'success page', 'installation options') THEN lower(title) END) AS key,
         coalesce(context_label, title, app, 'Unknown activity') AS label, regexp_replace(lower(coalesce(title, app, '')), '\\.exe$', '') AS name, row_number() OVER (PARTITION BY hostname, day ORDER BY start_us, end_us) AS pos FROM slices"""),
    "bridged": (("keyed",), """
  SELECT *, coalesce(end_us - start_us < 20000000 AND lag(key) OVER w = lead(key) OVER w, false) AS bridge FROM keyed WINDOW w AS (PARTITION BY hostname, day ORDER BY pos)"""),
    "numbered": (("bridged",), """
  SELECT *, CAST(sum(fresh) OVER (PARTITION BY hostname, day ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM (
    SELECT *, CASE WHEN pos = 1 THEN 1 WHEN bridge OR lag(bridge) OVER w THEN 0 WHEN start_us - lag(end_us) OVER w > 300000000 THEN 1
      WHEN key IS NOT NULL AND lag(key) OVER w IS NOT NULL THEN CASE WHEN key <> lag(key) OVER w THEN 1 ELSE 0 END
      WHEN lag(name) OVER w IN ('chatgpt', 'powershell', 'new tab', 'inbox', 'slack', 'outlook') OR name IN ('chatgpt', 'powershell', 'new tab', 'inbox', 'slack', 'outlook') THEN 1
      WHEN key IS NULL AND lag(key) OVER w IS NULL AND name <> lag(name) OVER w THEN 1 ELSE 0 END AS fresh
    FROM bridged WINDOW w AS (PARTITION BY hostname, day ORDER BY pos))"""),
    "sessions": (("numbered",), """
  SELECT hostname, day, session_no, min(start_us) AS start_us, max(end_us) AS end_us, sum(end_us - start_us) AS us, sum(end_us - start_us) / 1e6 AS active_seconds,
         sum(end_us - start_us) FILTER (WHERE focused) / 1e6 AS focused_seconds, count(*) AS slices,
         min_by(label, (key IS NULL, pos)) AS label, array_to_string(list_sort(list_distinct(flatten(list(evidence)))), ',') AS evidence FROM numbered GROUP BY hostname, day, session_no"""),
    "fresh": (("numbered",), """
  SELECT hostname, day, session_no, min(pos) FILTER (WHERE lower(title) = 'new repository') AS begun FROM numbered GROUP BY ALL"""),
    "cited": (("numbered", "observed"), """
  SELECT n.hostname, n.day, n.session_no, n.pos, i.i AS ix, o.* EXCLUDE (hostname, day) FROM numbered n, LATERAL (SELECT unnest(range(1, len(string_split(n.contexts, ',')) + 1)) AS i) i
  JOIN observed o ON o.hostname = n.hostname AND o.day = n.day AND o.evidence_id = string_split(n.contexts, ',')[i.i]"""),
    "named": (("cited", "numbered"), f"""
  SELECT hostname, day, session_no, pos, ix, 0 AS rank, url_path AS v FROM cited
  UNION ALL SELECT hostname, day, session_no, pos, ix, 1, project FROM cited
  UNION ALL SELECT hostname, day, session_no, pos, ix, 2, file FROM cited
  UNION ALL SELECT hostname, day, session_no, pos, ix, 3, title FROM cited WHERE NOT {GENERIC.format(v="title")}
  UNION ALL SELECT hostname, day, session_no, pos, ix, 4, url_host FROM cited WHERE url_path IS NULL
  UNION ALL SELECT hostname, day, session_no, pos, {FAR}, 3, title FROM numbered WHERE NOT {GENERIC.format(v="title")}"""),
    "anchored": (("named", "sessions"), f"""
  SELECT hostname, day, session_no, rank, trim(regexp_replace(v, '\\s+', ' ', 'g'), ' ') AS value, pos, ix FROM named WHERE v <> ''
  UNION ALL SELECT hostname, day, session_no, 3, trim(regexp_replace(label, '\\s+', ' ', 'g'), ' '), 0, 0 FROM sessions s
  WHERE label <> '' AND NOT {GENERIC.format(v="label")} AND NOT EXISTS (SELECT 1 FROM named n WHERE n.hostname = s.hostname AND n.day = s.day AND n.session_no = s.session_no AND v <> '')"""),
}


def sql(final: str, *needs: str) -> str:
    """The SELECT `final` with the parts that it needs."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in PARTS[name][0]:
            visit(other)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n][1]})" for n in order) + "\n" + final
