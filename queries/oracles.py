"""The SQL each query is checked against, in plain DuckDB SQL over the same tables.

The statements restate the rules from scratch: they share no text with the Spark side
other than the fixed values both need.
"""

from __future__ import annotations

from queries.inputs import TACTICS, TARGETS, TECHNIQUES
from timeloom.functions.indicators import FILE_EXTENSIONS
from timeloom.schema import DEFAULT_NAMESPACES as NS
from timeloom.schema import TIMESTAMP_DESCS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _quoted(values) -> str:
    """A Python list as text, inside a quoted SQL string."""
    return str(list(values)).replace("'", "''")


def _target(index: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {_text(t)}" for i, t in enumerate(TARGETS))
    return f"CASE {index} {cases} END"


def _json(value: str) -> str:
    return (
        "'\"' || replace(replace(coalesce(" + value + ", ''), '\\', '\\\\'), '\"', '\\\"') || '\"'"
    )


def _identity(**fields: str) -> str:
    members = " || ',' || ".join(
        f"'\"{name}\":' || {_json(fields[name])}" for name in sorted(fields)
    )
    return f"sha256('[\"{NS.event}\",{{' || {members} || '}}]')"


def _iso(ts: str) -> str:
    return f"(replace(CAST({ts} AS VARCHAR), ' ', 'T') || 'Z')"


LEVEL = """CASE WHEN value >= 80 THEN 'crit' WHEN value >= 40 THEN 'High' WHEN value >= 20 THEN 'med'
 WHEN value >= 10 THEN 'low' WHEN value >= 5 THEN ' Info ' ELSE 'none' END"""
SEVERITY = """CASE lower(trim(level)) WHEN 'crit' THEN 'critical' WHEN 'high' THEN 'high'
 WHEN 'med' THEN 'medium' WHEN 'low' THEN 'low' WHEN 'info' THEN 'informational' END"""
RANK = """coalesce(list_position(['informational','low','medium','high','critical'], severity), 0) - 1"""

# Canonical events of the event table.
TIMELINE = f"""
rows AS (
  SELECT event_id AS row_id, ts, user_id, event_type, value, props,
    'HOST-' || (user_id % 3) AS host,
    CASE event_type WHEN 'view' THEN NULL WHEN 'error' THEN 'NT AUTHORITY\\SYSTEM'
      ELSE 'CORP\\svc' || (user_id % 5) END AS principal,
    CASE event_type WHEN 'click' THEN 'process_create' WHEN 'purchase' THEN 'service_install'
      WHEN 'signup' THEN 'account_create' WHEN 'error' THEN 'process_access'
      WHEN 'view' THEN 'file_read' END AS action,
    {_target("user_id % 4")} AS object,
    'seen 10.' || (user_id % 7) || '.' || (user_id % 11) || '.9 via host' || (user_id % 13)
      || '.example.com' AS message,
    {LEVEL} AS level, {_iso("ts")} AS datetime
  FROM events),
named AS (
  SELECT *, {_identity(action="action", datetime="datetime", host="host", object="object",
                       principal="principal", source_artifact="'events'",
                       source_tool="'generic_csv'", timestamp_desc="'logged'")} AS id
  FROM rows),
timeline AS (
  SELECT id AS event_id, arg_min(ts, row_id) AS ts, arg_min(host, row_id) AS host,
    first(principal ORDER BY row_id) AS principal, arg_min(action, row_id) AS action,
    arg_min(object, row_id) AS object, arg_min(message, row_id) AS message,
    arg_min(level, row_id) AS level, arg_min(props, row_id) AS props,
    arg_min(datetime, row_id) AS datetime, min(row_id) AS row_id, count(*) AS copies
  FROM named GROUP BY id)
"""

RULES = """CASE
  WHEN action = 'process_create' AND lower(object) LIKE '%\\powershell.exe' THEN 'T1059.001'
  WHEN action = 'process_create' AND lower(object) LIKE '%\\7z.exe' THEN 'T1560.001'
  WHEN action = 'process_access' AND lower(object) LIKE '%\\lsass.exe' THEN 'T1003.001'
  WHEN action = 'service_install' THEN 'T1543.003'
  WHEN action = 'account_create' THEN 'T1136' END"""
TAGGED = f"""{TIMELINE}, tagged AS (SELECT *, {RULES} AS technique, {SEVERITY} AS severity FROM timeline)"""

# Episodes: gaps first, then handoffs inside each gap-free run.
EPISODES = f"""{TIMELINE},
acting AS (
  SELECT *, CASE WHEN principal IS NULL OR principal = 'NT AUTHORITY\\SYSTEM' THEN NULL
    ELSE lower(split_part(principal, '\\', -1)) END AS account,
    coalesce(ts - lag(ts) OVER (PARTITION BY host ORDER BY ts, event_id)
      > INTERVAL 600 SECOND, false) AS gap
  FROM timeline),
gapped AS (
  SELECT *, sum(gap::INT) OVER (PARTITION BY host ORDER BY ts, event_id) AS run FROM acting),
handed AS (
  SELECT *, last_value(account IGNORE NULLS) OVER (PARTITION BY host, run ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS actor FROM gapped),
parted AS (
  SELECT *, sum((account IS NOT NULL AND actor IS NOT NULL AND account <> actor)::INT)
    OVER (PARTITION BY host, run ORDER BY ts, event_id) AS part FROM handed),
episodes AS (
  SELECT host, run, part,
    'EP-' || left(sha256('{NS.episode}' || chr(10) || count(*) || chr(10)
      || sum(('0x' || substr(event_id, 1, 15))::UBIGINT) || chr(10)
      || sum(('0x' || substr(event_id, 16, 15))::UBIGINT) || chr(10)
      || sum(('0x' || substr(event_id, 31, 15))::UBIGINT) || chr(10)
      || sum(('0x' || substr(event_id, 46, 15))::UBIGINT)), 12) AS episode_id,
    min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS event_count,
    coalesce(first(principal ORDER BY ts, event_id) FILTER (WHERE account IS NOT NULL),
      first(principal ORDER BY ts, event_id) FILTER (WHERE principal IS NOT NULL)) AS principal
  FROM parted GROUP BY host, run, part),
members AS (
  SELECT p.event_id, e.episode_id FROM parted p JOIN episodes e
    ON p.host = e.host AND p.run = e.run AND p.part = e.part)
"""


# --- detection rows -------------------------------------------------------------------

_USER = "('svc' || (user_id % 5))"
_PATH = _target("user_id % 4")
_WINDOWS = f"""
  SELECT event_id AS row_id, ts - INTERVAL 2 HOUR AS ts, user_id, event_type, value,
    'HOST-' || (user_id % 3) AS host,
    CASE event_type WHEN 'click' THEN 'process_create' WHEN 'purchase' THEN 'service_install'
      WHEN 'signup' THEN 'account_create' WHEN 'error' THEN 'process_access'
      ELSE 'other' END AS action,
    CASE event_type WHEN 'click' THEN {_PATH} WHEN 'purchase' THEN 'Svc' || (user_id % 9)
      WHEN 'signup' THEN {_USER} WHEN 'error' THEN {_PATH} END AS object,
    CASE event_type WHEN 'click' THEN 'CORP\\' || {_USER}
      WHEN 'error' THEN 'CORP\\' || {_USER} END AS principal,
    (CASE event_type WHEN 'view' THEN 0.5 ELSE 1.0 END)::DOUBLE AS confidence,
    {LEVEL} AS level
  FROM events"""
WINDOWS = f"""
plain AS ({_WINDOWS}),
windows AS (
  SELECT *, {_iso("ts")} AS datetime,
    {_identity(action="action", datetime=_iso("ts"), host="host", object="object",
               principal="principal", source_artifact="'Detections.evtx'",
               source_tool="'hayabusa'", timestamp_desc="'logged'")} AS id,
    CASE WHEN event_type = 'view' THEN NULL ELSE 'First rule ' || (user_id % 6) END AS title,
    'Second rule ' || (user_id % 4) AS second_title,
    CASE event_type WHEN 'click' THEN ['t1059.001', 'T1070.001', 'G0016']
      WHEN 'error' THEN ['T1043', 'T9999', 'T1070.001', 'T1685.005'] ELSE [] END AS tags,
    ['T1136', 'T1059.001', 'T' || (1000 + user_id % 3)] AS second_tags
  FROM plain)
"""
_DETECTION_MAPPING = f"""WITH {WINDOWS}
SELECT CAST(row_id AS VARCHAR) AS record, id AS event_id, datetime,
  'UTC+02:00' AS source_timezone, 'logged' AS timestamp_desc, host, principal, action, object,
  'Detections.evtx' AS source_artifact,
  coalesce(title, 'Application event x9 on ' || host) AS message, confidence
FROM windows"""

# Records of the two passes, numbered in reading order, and what survives merging.
DEDUP = f"""{WINDOWS},
passes AS (
  SELECT id, 0 AS input, row_id, title, tags FROM windows
  UNION ALL SELECT id, 1, row_id, second_title, second_tags FROM windows),
kept AS (
  SELECT id, count(*) AS records,
    first('log-' || (input + 1) || '#' || row_id ORDER BY input, row_id) AS first_ref,
    first(title ORDER BY input, row_id) FILTER (WHERE title IS NOT NULL) AS rule_title
  FROM passes GROUP BY id),
tag_firsts AS (
  SELECT id, tag, min((input, row_id, pos)) AS seen_at FROM (
    SELECT id, input, row_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM passes)
  GROUP BY id, tag),
tag_lists AS (SELECT id, string_agg(tag, '|' ORDER BY seen_at) AS tags FROM tag_firsts GROUP BY id),
title_firsts AS (
  SELECT id, title, min((input, row_id)) AS seen_at FROM passes WHERE title IS NOT NULL GROUP BY id, title),
title_lists AS (
  SELECT t.id, string_agg(t.title, '|' ORDER BY t.seen_at) AS titles
  FROM title_firsts t JOIN kept k ON k.id = t.id WHERE t.title <> k.rule_title GROUP BY t.id)
"""

_CATALOG = "catalog(technique_id, name, display, deprecated, revoked_by) AS (VALUES " + ", ".join(
    "({}, {}, {}, {}, {})".format(
        _text(tid),
        _text(name),
        _text(
            next((n + ": " for t, n, *_ in TECHNIQUES if "." in tid and t == tid.split(".")[0]), "")
            + name
        ),
        str(deprecated).lower(),
        _text(revoked) if revoked else "NULL",
    )
    for tid, name, _, deprecated, revoked in TECHNIQUES
) + ")"
_PLACES = "places(technique_id, shortname) AS (VALUES " + ", ".join(
    f"({_text(tid)}, {_text(tactic)})" for tid, _, tactics, _, _ in TECHNIQUES for tactic in tactics
) + ")"
_TACTICS = "tactics(position, tactic_id, shortname, tactic) AS (VALUES " + ", ".join(
    f"({i}, {_text(a)}, {_text(b)}, {_text(c)})" for i, (a, b, c) in enumerate(TACTICS)
) + ")"

# Techniques per event over detections (native tags) and timeline (rules).
ALL_TAGGED = f"""{TAGGED}, {WINDOWS},
unique_windows AS (SELECT id, first(tags ORDER BY row_id) AS tags FROM windows GROUP BY id),
native AS (
  SELECT id AS event_id, CASE WHEN list_contains(tags, 'G0016') THEN ['T1059.001', 'T1685.005']
    WHEN len(tags) > 0 THEN ['T1043', 'T9999', 'T1685.005'] ELSE [] END AS techniques
  FROM unique_windows),
every AS (
  SELECT event_id, unnest(techniques) AS technique_id, generate_subscripts(techniques, 1) AS pos
    FROM native
  UNION ALL SELECT event_id, technique, 1 FROM tagged WHERE technique IS NOT NULL),
{_CATALOG}, {_PLACES}, {_TACTICS},
counted AS (SELECT technique_id, count(*) AS count FROM every GROUP BY technique_id)
"""


# --- indicators -----------------------------------------------------------------------

_SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STOP = _SPACE + "\"''<>|\u00a6,;+"
_QUOTED = r'"((?:[A-Za-z]:\\|\\\\)[^"<>|\r\n]+)"'
_DRIVE = rf"[A-Za-z]:\\[^{_STOP}]+"
_UNC = rf"\\\\[^{_STOP}]+"
_HASH = r"\b(?:[0-9a-fA-F]{64}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})\b"
_IP = r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b"
_NAME = r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,63}\b"
_WHOLE = "^(?:[A-Za-z]:\\\\|\\\\\\\\)[^:/+,;\u00a6''\"<>|?\\n\\r\\t]*$"
_TRIM = rf"^[{_SPACE}]+|[{_SPACE}]+$"
_EXTENSIONS = ", ".join(_text(name) for name in FILE_EXTENSIONS)


def _indicators(source: str) -> str:
    """CTEs from ``source(key, text)`` to ``hits(key, kind, value)``."""
    return rf"""
trimmed AS (SELECT key, regexp_replace(text, '{_TRIM}', '', 'g') AS t FROM ({source})),
whole AS (SELECT key, t FROM trimmed WHERE regexp_matches(t, '{_WHOLE}')),
w0 AS (SELECT key, t FROM trimmed WHERE NOT regexp_matches(t, '{_WHOLE}')),
w1 AS (SELECT key, t, regexp_replace(t, '{_QUOTED}', ' ', 'g') AS n FROM w0),
w2 AS (SELECT key, n AS t, regexp_replace(n, '{_DRIVE}', ' ', 'g') AS n FROM w1),
w3 AS (SELECT key, n AS t, regexp_replace(n, '{_UNC}', ' ', 'g') AS n FROM w2),
w4 AS (SELECT key, t, regexp_replace(t, '{_HASH}', ' ', 'g') AS n FROM (
  SELECT key, regexp_replace(n, '[^\x00-\x7f\P{{L}}]|[^\x00-\x7f\P{{N}}]|[^\x00-\x7f\P{{M}}]', '_', 'g') AS t
  FROM w3)),
w5 AS (SELECT key, n AS t, regexp_replace(n, '{_IP}', ' ', 'g') AS n FROM w4),
w6 AS (SELECT key, unnest(string_split_regex(n, '[^a-zA-Z0-9_.-]')) AS t FROM w5),
hits AS (
  SELECT key, 'path' AS kind, t AS value FROM whole
  UNION ALL SELECT key, 'path', unnest(regexp_extract_all(t, '{_QUOTED}', 1)) FROM w1
  UNION ALL SELECT key, 'path', unnest(regexp_extract_all(t, '{_DRIVE}')) FROM w2
  UNION ALL SELECT key, 'path', unnest(regexp_extract_all(t, '{_UNC}')) FROM w3
  UNION ALL SELECT key, 'hash', lower(unnest(regexp_extract_all(t, '{_HASH}'))) FROM w4
  UNION ALL SELECT key, 'ip', v FROM (
    SELECT key, unnest(regexp_extract_all(t, '{_IP}')) AS v FROM w5)
    WHERE NOT regexp_matches(v, '^(?:127\.\d+\.\d+\.\d+|0\.0\.0\.0)$')
  UNION ALL SELECT key, 'domain', lower(v) FROM (
    SELECT key, unnest(regexp_extract_all(t, '{_NAME}')) AS v FROM w6
    WHERE contains(t, '.') AND length(t) <= 253)
    WHERE lower(split_part(v, '.', -1)) NOT IN ({_EXTENSIONS})),
keyed AS (
  SELECT *, CASE WHEN kind = 'path' THEN coalesce(nullif(lower(rtrim(value, '\')), ''), value)
    ELSE value END AS ioc_key FROM hits),
refs AS (
  SELECT DISTINCT key, kind, value, ioc_key, 'ioc-' || left(sha256('{NS.indicator}' || chr(10)
    || kind || chr(10) || ioc_key), 12) AS ioc_id FROM keyed),
iocs AS (
  SELECT ioc_id, kind AS ioc_type, min(value) AS value, count(DISTINCT key) AS event_count
  FROM refs GROUP BY ioc_id, kind, ioc_key)
"""


_DEFANGED = """CASE WHEN ioc_type IN ('ip', 'domain') THEN replace(value, '.', '[.]') ELSE value END"""
_INDEX = f"SELECT ioc_id, ioc_type, value, {_DEFANGED} AS defanged, event_count FROM iocs"
_DOCUMENTS = "SELECT doc_id AS key, text FROM documents"
_PAGES = "SELECT page_id AS key, url || ' ' || html AS text FROM pages"
_EVENT_TEXTS = """SELECT event_id AS key, object AS text FROM timeline
  UNION ALL SELECT event_id, message FROM timeline UNION ALL SELECT event_id, level FROM timeline
  UNION ALL SELECT event_id, props FROM timeline"""


# --- sentences ------------------------------------------------------------------------

_STATEMENT = """CASE action
  WHEN 'process_create' THEN coalesce(principal || ' started ' || object, object || ' started')
  WHEN 'service_install' THEN coalesce(principal || ' installed service ' || object,
    'Service ' || object || ' was installed')
  WHEN 'account_create' THEN coalesce(principal || ' created account ' || object,
    'Account ' || object || ' was created')
  WHEN 'process_access' THEN coalesce(principal || ' accessed process ' || object,
    'A process accessed ' || object)
  WHEN 'file_read' THEN coalesce(principal || ' accessed ' || object, object || ' was accessed')
  WHEN 'logon' THEN coalesce(principal || ' logged on', 'An account logged on')
    || ' from ' || object
  WHEN 'log_clear' THEN coalesce(principal || ' cleared the ' || object || ' event log',
    'The ' || object || ' event log was cleared')
  WHEN 'other' THEN coalesce(principal || ': ', '') || message
  WHEN 'made_up' THEN coalesce(principal, 'An actor') || ' performed made up on ' || object
  END || '.'"""

# --- claims ---------------------------------------------------------------------------

_HEX = "('0x' || substr(event_id, {start}, 4))::INT"
CLAIMS = f"""{TIMELINE},
claims AS (SELECT *, {_HEX.format(start=9)} % 9 AS v, left(event_id, 12) AS short FROM timeline),
judged AS (
  SELECT *, CASE
    WHEN v = 1 THEN 'malformed_citation' WHEN v = 2 THEN 'no_citations'
    WHEN v = 4 THEN 'no_assertions' WHEN v = 3 AND reverse(event_id) <> event_id THEN 'missing_id'
    WHEN v = 5 THEN 'time_mismatch' WHEN v = 6 THEN 'principal_mismatch'
    WHEN v = 7 THEN 'action_mismatch' WHEN v = 8 THEN 'object_mismatch' END AS reason
  FROM claims),
verdicts AS (
  SELECT *, reason IS NULL AS ok, CASE reason
    WHEN 'malformed_citation' THEN 'claim carries malformed citations: ''EVT-1'''
    WHEN 'no_citations' THEN 'claim carries no event-id citation'
    WHEN 'no_assertions' THEN
      'claim asserts none of the checkable facts (datetime, principal, action, object)'
    WHEN 'missing_id' THEN 'cited event ids do not exist in the store: ''' || reverse(event_id) || ''''
    WHEN 'time_mismatch' THEN 'asserted time ''' || {_iso("ts + INTERVAL 2 SECOND")}
      || ''' differs from the cited event''s time by more than the tolerance (0:00:01) (event '
      || short || ')'
    WHEN 'principal_mismatch' THEN
      'asserted principal ''CORP\\nobody'' does not match the principal of event ' || short
    WHEN 'action_mismatch' THEN
      'asserted action ''logoff'' does not match the action of event ' || short
    WHEN 'object_mismatch' THEN 'asserted object ''' || object
      || 'x'' does not match the object of event ' || short
    ELSE '' END AS detail
  FROM judged)
"""

DRAFTS = f"""{TIMELINE},
turns AS (SELECT *, {_HEX.format(start=3)} % 4 AS t FROM timeline),
accepted AS (
  SELECT event_id, datetime, action, CASE t WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS round_index,
    CASE t WHEN 0 THEN 'right at once' WHEN 1 THEN 'fixed' WHEN 2 THEN 'fixed late'
      ELSE 'unrelated' END AS text
  FROM turns),
audit AS (
  SELECT event_id, 0 AS round_index, 0 AS kind, 'first try' AS claim_text, false AS dropped, '' AS note
    FROM turns WHERE t > 0
  UNION ALL SELECT event_id, 1, 0, 'still wrong', false, '' FROM turns WHERE t = 2
  UNION ALL SELECT event_id, 2, 1, 'first try', true,
    '; model returned no revision for this claim' FROM turns WHERE t = 3)
"""


# --- benchmark ------------------------------------------------------------------------

_ALWAYS = (
    ("short_handle_citation", False), ("record_number_citation", False), ("no_citation", False),
    ("no_assertion", False), ("time_just_outside_tolerance", False), ("time_hours_off", False),
    ("action_swap", False), ("true_claim_with_malformed_citation", False), ("exact", True),
    ("re_cased", True), ("whitespace_padded", True), ("offset_notation_same_instant", True),
    ("subsecond_within_tolerance", True), ("subset_of_fields", True), ("upper_case_id", True),
)
_FLIPPED = "CASE WHEN left(event_id, 1) <> '0' THEN '0' ELSE '1' END || substr(event_id, 2)"
_DANGLING = "left(event_id, 63) || CASE WHEN right(event_id, 1) <> '0' THEN '0' ELSE '1' END"
BENCHMARK = f"""{TIMELINE},
who AS (SELECT *, lower(coalesce(principal, '')) AS p, lower(object) AS o FROM timeline),
pairs AS (SELECT DISTINCT action, p FROM who),
classes AS (
  {" UNION ALL ".join(
      f"SELECT '{k}' AS kind, {str(a).lower()} AS expect_accept, count(*) AS total FROM who"
      for k, a in _ALWAYS)}
  UNION ALL SELECT 'nonexistent_id', false, count(*) FROM who
    WHERE {_FLIPPED} NOT IN (SELECT event_id FROM who)
  UNION ALL SELECT 'true_claim_with_dangling_citation', false, count(*) FROM who
    WHERE {_DANGLING} NOT IN (SELECT event_id FROM who)
  UNION ALL SELECT 'principal_swap', false, count(*) FROM who
    WHERE p IN (SELECT p FROM who) AND (SELECT count(DISTINCT p) FROM who WHERE p <> '') >= 1
  UNION ALL SELECT 'object_swap', false, count(*) FROM who
  UNION ALL SELECT 'confusable_object', false, count(*) FROM who
    WHERE regexp_matches(object, '[aeocp]')
  UNION ALL SELECT 'stitched_across_events', false, count(*) FROM who w
    WHERE principal IS NOT NULL AND EXISTS (
      SELECT 1 FROM pairs q WHERE q.action <> w.action AND q.p <> w.p)
  UNION ALL SELECT 'extra_context_citation', true, count(*) FROM who
    WHERE (SELECT count(*) FROM who) > 1)
"""

ORACLES: dict[str, str] = {
    "episodes_gap_handoff": f"""WITH {EPISODES}
SELECT episode_id, host, principal, {_iso("first_ts")} AS start, {_iso("last_ts")} AS "end",
  event_count FROM episodes""",
    "episode_members": f"WITH {EPISODES} SELECT event_id, episode_id FROM members",
    "event_identity": f"""WITH {TIMELINE}
SELECT event_id, datetime, 'assumed_utc' AS source_timezone, host, principal, action, object, message
FROM timeline""",
    "timestamp_norm": r"""
WITH parts AS (SELECT event_id, ts, date_trunc('second', ts) AS s FROM events),
shapes AS (
  SELECT event_id, 0 AS shape, ts AS t, 'UTC' AS zone, NULL AS reason FROM parts
  UNION ALL SELECT event_id, 1, date_trunc('millisecond', ts) + INTERVAL 4 HOUR, 'UTC-04:00', NULL
    FROM parts
  UNION ALL SELECT event_id, 2, s, 'assumed_utc', NULL FROM parts
  UNION ALL SELECT event_id, 3, s - INTERVAL 330 MINUTE, 'UTC+05:30', NULL FROM parts
  UNION ALL SELECT event_id, 4, s, 'assumed_utc', NULL FROM parts
  UNION ALL SELECT event_id, 5, date_trunc('day', ts), 'assumed_utc', NULL FROM parts
  UNION ALL SELECT event_id, 6, NULL, NULL, 'timestamp ''' || strftime(ts, '%H:%M:%S')
    || ''' does not carry a complete date; refusing to fill the missing parts' FROM parts
  UNION ALL SELECT event_id, 7, NULL, NULL, 'cannot parse timestamp ''99/99/9999 '
    || strftime(ts, '%H:%M:%S') || '''' FROM parts)
SELECT event_id, shape, replace(CAST(CAST(t AS TIMESTAMP) AS VARCHAR), ' ', 'T') || 'Z' AS datetime,
  zone AS source_timezone, reason FROM shapes""",
    "dedup_merge": f"""WITH {DEDUP}
SELECT k.id AS event_id, k.records, k.first_ref, k.rule_title, coalesce(t.tags, '') AS tags,
  coalesce(o.titles, '') AS other_titles
FROM kept k LEFT JOIN tag_lists t ON t.id = k.id LEFT JOIN title_lists o ON o.id = k.id""",
    "duplicate_counts": f"""WITH {WINDOWS}
SELECT 2 * count(*) - count(DISTINCT id) AS duplicates FROM windows""",
    "winevent_mapping": _DETECTION_MAPPING,
    "detection_csv_scan": _DETECTION_MAPPING,
    "detection_jsonl_scan": _DETECTION_MAPPING,
    "detection_json_stream_scan": _DETECTION_MAPPING,
    "mixed_folder_scan": _DETECTION_MAPPING,
    "problem_rows": f"""WITH numbered AS (SELECT event_id, event_id % 12 AS kind,
  'could not build a canonical event: ' AS lead FROM events WHERE event_id % 12 > 0)
SELECT event_id AS row, CASE WHEN kind IN (5, 11) THEN 'toolbox' ELSE 'generic_csv' END AS source_tool,
  CASE WHEN kind IN (1, 9) THEN lead || 'timestamp_raw must be a non-empty string'
    WHEN kind IN (2, 10) THEN lead || 'message must be a non-empty string'
    WHEN kind = 3 THEN lead || 'source_artifact must be a non-empty string'
    WHEN kind = 4 THEN lead || 'timestamp_desc must be one of {_quoted(TIMESTAMP_DESCS)}, got ''guessed'''
    WHEN kind IN (5, 11) THEN 'no mapper registered for source_tool ''toolbox'''
    WHEN kind = 6 THEN lead || 'action must be a snake_case verb like process_create, got ''Not a verb'''
    WHEN kind = 7 THEN lead || 'confidence must be between 0 and 1'
    ELSE lead || 'raw_ref must name a file and a record' END AS reason
FROM numbered""",
    "catalog_bundle": """SELECT 'T' || c_custkey AS technique_id,
  CASE WHEN c_custkey % 50 = 0 THEN c_custkey % 100 = 0 ELSE last.key IS NULL END AS deprecated,
  CASE WHEN c_custkey % 50 <> 0 THEN 'T' || last.key END AS revoked_by
FROM customer LEFT JOIN (SELECT c_custkey AS key FROM customer WHERE c_custkey % 50 = 0) last
  ON last.key = c_custkey - c_custkey % 50 + 50""",
    "kv_parse": """SELECT c_custkey, 'again:' || c_custkey AS name, 'C:\\x\\' || c_mktsegment AS path,
  2 AS pairs FROM customer""",
    "multi_value": """SELECT c_custkey,
  CASE WHEN c_nationkey % 2 = 0 THEN 'a' || c_custkey || '|b' || c_mktsegment
    ELSE 'x' || c_custkey || '|y' END AS cells, 2 AS n FROM customer""",
    "action_labels": r"""SELECT p_partkey,
  trim(regexp_replace(lower(p_type || ' / ' || p_name), '[^a-z0-9]+', '_', 'g'), '_') AS verb,
  'other' AS numeric_verb FROM part""",
    "tag_rules": f"WITH {TAGGED} SELECT event_id, coalesce(technique, '') AS techniques FROM tagged",
    "tag_native_resolution": f"""WITH {WINDOWS},
one AS (SELECT id, first(tags ORDER BY row_id) AS tags FROM windows GROUP BY id)
SELECT id AS event_id, CASE
  WHEN list_contains(tags, 'G0016') THEN 'T1059.001:rule_tag:-|T1685.005:rule_tag:T1070.001'
  WHEN len(tags) > 0 THEN 'T1043:rule_tag:-|T9999:rule_tag:-|T1685.005:rule_tag:T1070.001'
  ELSE '' END AS techniques FROM one""",
    "technique_counts": f"WITH {ALL_TAGGED} SELECT technique_id, count FROM counted",
    "technique_matrix": f"""WITH {ALL_TAGGED}
SELECT t.position, t.tactic_id, t.tactic, c.technique_id, k.display AS name, c.count
FROM counted c JOIN catalog k ON k.technique_id = c.technique_id
  AND NOT k.deprecated AND k.revoked_by IS NULL
JOIN places p ON p.technique_id = c.technique_id JOIN tactics t ON t.shortname = p.shortname""",
    "technique_layer": f"""WITH {ALL_TAGGED}
SELECT c.technique_id, k.display AS name, c.count AS score, max(c.count) OVER () AS highest
FROM counted c JOIN catalog k ON k.technique_id = c.technique_id
  AND NOT k.deprecated AND k.revoked_by IS NULL""",
    "unmapped_techniques": f"""WITH {ALL_TAGGED}
SELECT c.technique_id, CASE WHEN k.technique_id IS NULL THEN 'unknown' ELSE 'deprecated' END AS status,
  c.count FROM counted c LEFT JOIN catalog k ON k.technique_id = c.technique_id
WHERE k.technique_id IS NULL OR k.deprecated OR k.revoked_by IS NOT NULL""",
    "technique_references": f"""WITH {ALL_TAGGED}
SELECT e.event_id, string_agg(e.technique_id || ':'
  || coalesce(k.display, 'not in the technique catalog') || ':'
  || CASE WHEN k.technique_id IS NULL THEN 'unknown' WHEN k.deprecated THEN 'deprecated'
     ELSE 'active' END, '|' ORDER BY e.pos) AS techniques
FROM every e LEFT JOIN catalog k ON k.technique_id = e.technique_id GROUP BY e.event_id""",
    "indicators_documents": f"WITH {_indicators(_DOCUMENTS)} {_INDEX}",
    "indicators_pages": f"WITH {_indicators(_PAGES)} {_INDEX}",
    "indicator_references": f"""WITH {_indicators(_DOCUMENTS)}
SELECT DISTINCT ioc_id, key AS doc_id FROM refs""",
    "indicator_refs": f"""WITH {TIMELINE}, {_indicators(_EVENT_TEXTS)}
SELECT t.event_id, coalesce(string_agg(DISTINCT r.ioc_id, '|' ORDER BY r.ioc_id), '') AS refs
FROM timeline t LEFT JOIN refs r ON r.key = t.event_id GROUP BY t.event_id""",
    "indicators_events": f"WITH {TIMELINE}, {_indicators(_EVENT_TEXTS)} {_INDEX}",
    "severity_norm": f"""WITH {TAGGED}
SELECT event_id, severity, CAST({RANK} AS INT) AS severity_rank FROM tagged""",
    "view_budget": f"""WITH {TAGGED}
SELECT event_id, datetime, host, principal, action, object, message,
  coalesce(technique, '') AS techniques, severity
FROM tagged ORDER BY technique IS NULL, {RANK} DESC, ts, event_id LIMIT 300""",
    "phrase_events": f"""WITH {TIMELINE},
spread AS (SELECT event_id, principal, object, message,
  unnest([action, 'logon', 'log_clear', 'other', 'made_up']) AS action FROM timeline)
SELECT event_id, action, {_STATEMENT} AS statement FROM spread""",
    "redact_views": f"""WITH {TIMELINE},
cut AS (SELECT *, CASE WHEN user_key THEN object ELSE '[redacted]' END AS shown FROM (
  SELECT *, object NOT LIKE '_:%' AS user_key FROM timeline))
SELECT event_id, '[redacted]' AS host, CASE WHEN principal IS NOT NULL THEN '[redacted]' END AS principal,
  shown AS object,
  'seen [redacted] via [redacted] by ' || CASE WHEN principal IS NULL THEN '?'
    ELSE '[redacted]' END AS message
FROM cut""",
    "claim_verdicts": f"""WITH {CLAIMS}
SELECT event_id AS claim_id, ok, CASE WHEN ok THEN event_id END AS backing_event_id, reason, detail
FROM verdicts""",
    "claim_statements": f"""WITH {CLAIMS}
SELECT event_id AS claim_id, ok, CASE WHEN ok THEN {_STATEMENT} END AS statement FROM verdicts""",
    "claim_totals": f"""WITH {CLAIMS}
SELECT count(*) AS claims, count(*) FILTER (WHERE ok) AS accepted,
  count(*) FILTER (WHERE NOT ok) AS rejected FROM verdicts""",
    "narrative_accepted": f"""WITH {DRAFTS}
SELECT event_id AS case_id, round_index, text, 'at ' || datetime || ', action ' || action
  || ' [event ' || left(event_id, 12) || ']' AS statement, event_id AS backing_event_id
FROM accepted""",
    "narrative_audit": f"""WITH {DRAFTS}
SELECT event_id AS case_id, round_index, kind, claim_text, 'action_mismatch' AS reason, dropped,
  'asserted action ''logoff'' does not match the action of event ' || left(event_id, 12) || note
  AS detail FROM audit""",
    "narrative_rounds": f"""WITH {DRAFTS}
SELECT event_id AS case_id, CASE t WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS rounds_used
FROM turns""",
    "benchmark_classes": f"""WITH {BENCHMARK}
SELECT kind, expect_accept, total, total AS correct, 0::BIGINT AS unexpected_reasons FROM classes
WHERE total > 0""",
    "benchmark_summary": f"""WITH {BENCHMARK}
SELECT sum(total) FILTER (WHERE NOT expect_accept)::BIGINT AS fabrications,
  sum(total) FILTER (WHERE NOT expect_accept)::BIGINT AS fabrications_rejected,
  0.0::DOUBLE AS false_accept_rate,
  sum(total) FILTER (WHERE expect_accept)::BIGINT AS grounded,
  sum(total) FILTER (WHERE expect_accept)::BIGINT AS grounded_accepted,
  0.0::DOUBLE AS false_reject_rate, 0::BIGINT AS unexpected_reasons, true AS passed FROM classes""",
    "citation_accuracy": f"""WITH {TIMELINE}
SELECT 1.0::DOUBLE AS citation_accuracy, count(*) AS accurate_claims, count(*) AS emitted_claims
FROM timeline""",
    "technique_scores": f"""WITH {TAGGED},
rules AS (SELECT DISTINCT host, CAST(row_id AS VARCHAR) AS record, technique FROM tagged
  WHERE technique IS NOT NULL),
predicted AS (SELECT 'table_only' AS scope, * FROM rules
  UNION ALL SELECT 'end_to_end', * FROM rules
  UNION ALL SELECT 'end_to_end', host, CAST(row_id AS VARCHAR), 'T1005' FROM tagged
    WHERE action = 'account_create'),
labels AS (SELECT 'HOST-' || (user_id % 3) AS host, CAST(event_id AS VARCHAR) AS record,
  CASE event_type WHEN 'signup' THEN 'T1136' WHEN 'purchase' THEN 'T1543.003' ELSE 'T1005' END
  AS technique FROM events WHERE event_type IN ('signup', 'purchase', 'view')),
expected AS (SELECT scope, labels.* FROM labels, (VALUES ('table_only'), ('end_to_end')) s(scope)),
judged AS (SELECT coalesce(p.scope, e.scope) AS scope, p.scope IS NOT NULL AS said, e.scope IS NOT NULL AS so
  FROM predicted p FULL JOIN expected e ON p.scope = e.scope AND p.host = e.host
    AND p.record = e.record AND p.technique = e.technique)
SELECT scope, count(*) FILTER (said AND so) / count(*) FILTER (said) AS precision,
  count(*) FILTER (said AND so) / count(*) FILTER (so) AS recall,
  count(*) FILTER (said AND so) AS true_positives, count(*) FILTER (said AND NOT so) AS false_positives,
  count(*) FILTER (so AND NOT said) AS false_negatives
FROM judged GROUP BY scope""",
    "score_sets": f"""WITH {TAGGED},
predicted AS (SELECT DISTINCT host, CAST(row_id AS VARCHAR) AS record, technique FROM tagged
  WHERE technique IS NOT NULL),
expected AS (SELECT 'HOST-' || (user_id % 3) AS host, CAST(event_id AS VARCHAR) AS record,
  CASE event_type WHEN 'signup' THEN 'T1136' WHEN 'purchase' THEN 'T1543.003' ELSE 'T1005' END
  AS technique FROM events WHERE event_type IN ('signup', 'purchase', 'view')),
counts AS (SELECT
  (SELECT count(*) FROM (SELECT * FROM predicted INTERSECT SELECT * FROM expected)) AS tp,
  (SELECT count(*) FROM (SELECT * FROM predicted EXCEPT SELECT * FROM expected)) AS fp,
  (SELECT count(*) FROM (SELECT * FROM expected EXCEPT SELECT * FROM predicted)) AS fn)
SELECT tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, tp AS true_positives,
  fp AS false_positives, fn AS false_negatives,
  (SELECT string_agg(host || ' ' || record || ' ' || technique, ';' ORDER BY host, record, technique)
   FROM (SELECT * FROM predicted EXCEPT SELECT * FROM expected ORDER BY ALL LIMIT 5))
  AS false_positive_examples FROM counts""",
    "analyze_mixed": f"""WITH {WINDOWS}, {TIMELINE},
counts AS (SELECT (SELECT count(*) FROM events) AS n,
  (SELECT count(*) FROM events WHERE event_id % 7 = 0) AS problems,
  (SELECT count(DISTINCT id) FROM windows)
    + (SELECT count(DISTINCT id) FROM named WHERE row_id % 7 <> 0) AS events)
SELECT input, source, file, n AS records, events, problems, 3 * n - problems - events AS duplicates
FROM counts, (VALUES (0, 'hayabusa', 'timeline.jsonl'), (1, 'generic_csv', 'export'),
  (2, 'hayabusa', 'timeline.jsonl')) given(input, source, file)""",
    "stats": f"""WITH {EPISODES}, {_indicators(_EVENT_TEXTS)},
tagged AS (SELECT *, {RULES} AS technique FROM timeline), {_CATALOG}, {_PLACES}
SELECT (SELECT count(*) FROM timeline) AS events,
  (SELECT count(*) FROM events) - (SELECT count(*) FROM timeline) AS duplicates, 0::BIGINT AS problems,
  (SELECT count(DISTINCT host) FROM timeline) AS hosts,
  (SELECT count(DISTINCT technique) FROM tagged WHERE technique IN (
    SELECT technique_id FROM catalog WHERE NOT deprecated AND revoked_by IS NULL)) AS techniques,
  (SELECT count(*) FROM episodes) AS episodes, (SELECT count(*) FROM iocs) AS iocs,
  0::BIGINT AS narrative_entries, 0::BIGINT AS rejected_claims""",
    "findings": f"""WITH {EPISODES},
tagged AS (SELECT *, {RULES} AS technique, {SEVERITY} AS severity FROM timeline)
SELECT t.event_id AS backing_event_id, datetime, host, {_STATEMENT} AS statement,
  message AS detection, severity, coalesce(technique, '') AS techniques, episode_id
FROM tagged t JOIN members m ON m.event_id = t.event_id
WHERE technique IS NOT NULL OR severity IN ('high', 'critical')""",
    "notable_capped": f"""WITH {TAGGED},
flagged AS (SELECT *, technique IS NOT NULL OR coalesce(severity IN ('high', 'critical'), false)
  AS notable FROM tagged),
capped AS (SELECT *, (SELECT count(*) FROM tagged) > 2000 AS capped FROM flagged)
SELECT event_id, severity, notable, capped FROM capped WHERE notable OR NOT capped
ORDER BY ts, event_id LIMIT 2000""",
    "episode_techniques": f"""WITH {EPISODES},
tagged AS (SELECT *, {RULES} AS technique FROM timeline),
firsts AS (SELECT m.episode_id, t.technique, min((t.ts, t.event_id)) AS seen_at
  FROM tagged t JOIN members m ON m.event_id = t.event_id WHERE technique IS NOT NULL GROUP BY ALL),
listed AS (SELECT episode_id, string_agg(technique, '|' ORDER BY seen_at) AS techniques
  FROM firsts GROUP BY episode_id)
SELECT e.episode_id, e.event_count, coalesce(l.techniques, '') AS techniques
FROM episodes e LEFT JOIN listed l ON l.episode_id = e.episode_id""",
    "events_annotated": f"""WITH {EPISODES}, {_indicators(_EVENT_TEXTS)},
tagged AS (SELECT *, {RULES} AS technique, {SEVERITY} AS severity FROM timeline),
shown AS (SELECT DISTINCT r.key, i.ioc_id, i.ioc_type, i.value, {_DEFANGED.replace("value", "i.value")}
  AS defanged FROM refs r JOIN iocs i ON i.ioc_id = r.ioc_id),
listed AS (SELECT key, string_agg(ioc_type || ':' || defanged, '|' ORDER BY
  list_position(['ip', 'domain', 'hash', 'path'], ioc_type), value) AS iocs FROM shown GROUP BY key)
SELECT t.event_id, m.episode_id, t.severity,
  technique IS NOT NULL OR coalesce(severity IN ('high', 'critical'), false) AS notable,
  l.iocs, 'episode:' || m.episode_id AS tags
FROM tagged t JOIN members m ON m.event_id = t.event_id LEFT JOIN listed l ON l.key = t.event_id""",
    "saved_events_reload": f"""WITH {TAGGED}
SELECT event_id, datetime, message, coalesce(technique, '') AS techniques, level FROM tagged""",
}

# --- the other record layouts ---------------------------------------------------------

_HOSTNAME = "('h' || (user_id % 13) || '.example.org')"


def _log_mapping(tool: str, artifact: str, message: str, label: str, offset_label: str = "UTC") -> str:
    """Log rows whose channel and id pick the rule."""
    rows = f"""rows AS (SELECT event_id AS row_id, date_trunc('second', ts) AS ts, event_type,
  'HOST-' || (user_id % 3) AS host,
  CASE event_type WHEN 'click' THEN 'process_create' WHEN 'purchase' THEN 'network_connect'
    WHEN 'signup' THEN 'scheduled_task_create' WHEN 'error' THEN 'other'
    ELSE 'service_control' END AS action,
  CASE event_type WHEN 'click' THEN {_PATH} WHEN 'purchase' THEN {_HOSTNAME} || ':443' END AS object,
  CASE event_type WHEN 'click' THEN 'CORP\\' || {_USER} WHEN 'purchase' THEN 'CORP\\' || {_USER}
    WHEN 'signup' THEN {_USER} END AS principal,
  (CASE event_type WHEN 'error' THEN 0.5 ELSE 1.0 END)::DOUBLE AS confidence,
  CASE event_type WHEN 'click' THEN 'security' WHEN 'purchase' THEN 'x-SYSMON-y'
    WHEN 'signup' THEN 'Microsoft-Windows-TaskScheduler/Operational'
    WHEN 'error' THEN 'Application' ELSE '' END AS channel,
  CASE event_type WHEN 'click' THEN '4688' WHEN 'purchase' THEN '3' WHEN 'signup' THEN '106'
    WHEN 'error' THEN '4688' ELSE '7036' END AS number FROM events)"""
    identity = _identity(
        action="action", datetime=_iso("ts"), host="host", object="object", principal="principal",
        source_artifact=artifact, source_tool=f"'{tool}'", timestamp_desc="'logged'",
    )
    return f"""WITH {rows} SELECT CAST(row_id AS VARCHAR) AS record, {identity} AS event_id,
  {_iso("ts")} AS datetime, '{offset_label}' AS source_timezone, 'logged' AS timestamp_desc, host,
  principal, action, object, {artifact} AS source_artifact, {message} AS message, confidence
FROM rows"""


_LOG_MESSAGE = """CASE WHEN event_type = 'error' THEN 'from the log'
  ELSE coalesce(nullif(channel, ''), 'Windows') || ' event ' || number || ' on ' || host END"""
_CHANNEL_FILE = "coalesce(nullif(replace(channel, '/', '%4'), '') || '.evtx', 'log.evtx')"
_PROVIDER_MESSAGE = """CASE WHEN event_type = 'click' THEN 'Provider'
  ELSE coalesce(nullif(channel, ''), 'Windows') END || ' event ' || number || ' on ' || host"""

ORACLES["log_row_mapping"] = _log_mapping("velociraptor", "'log.evtx'", _LOG_MESSAGE, "log")
ORACLES["log_jsonl_scan"] = _log_mapping("velociraptor", _CHANNEL_FILE, _LOG_MESSAGE, "log")
ORACLES["extracted_log_mapping"] = _log_mapping("dissect", "'log.evtx'", _PROVIDER_MESSAGE, "log")
ORACLES["detection_document_mapping"] = f"""
WITH mapped AS ({_log_mapping(
    "chainsaw", "'log.evtx'",
    "CASE WHEN event_type <> 'view' THEN 'Rule' ELSE 'Chainsaw detection on Windows event 7036 on ' || host END",
    "hunt")})
SELECT event_id, first(message ORDER BY CAST(record AS BIGINT)) AS message, action, principal, object,
  'T1059.001' AS techniques FROM mapped GROUP BY event_id, action, principal, object"""

_SUPER_FILE = f"""CASE event_type WHEN 'click' THEN 'C:/Windows/System32/winevt/Logs/Security.evtx'
  WHEN 'error' THEN '/var/log/app.log' WHEN 'view' THEN NULL ELSE {_PATH} END"""
ORACLES["supertimeline_mapping"] = f"""
WITH base AS (SELECT event_id AS row_id, event_type, user_id,
  CASE WHEN user_id % 2 = 0 THEN 'America/New_York' ELSE 'assumed_utc' END AS zone,
  date_trunc('second', ts) + CASE WHEN user_id % 2 = 0 THEN INTERVAL 5 HOUR
    ELSE INTERVAL 0 HOUR END AS ts, 'HOST-' || (user_id % 3) AS host,
  CASE event_type WHEN 'click' THEN 'process_create' WHEN 'purchase' THEN 'file_create'
    WHEN 'signup' THEN 'registry_set' ELSE 'other' END AS action,
  CASE event_type WHEN 'purchase' THEN 'created' WHEN 'signup' THEN 'modified'
    WHEN 'view' THEN 'other' ELSE 'logged' END AS described,
  CASE WHEN event_type <> 'click' THEN {_SUPER_FILE} END AS object,
  CASE WHEN event_type <> 'view' THEN 'jdoe' END AS principal,
  CASE event_type WHEN 'click' THEN 'long text' WHEN 'signup' THEN 'short text'
    WHEN 'purchase' THEN 'FILE Creation Time' WHEN 'error' THEN 'FILE Event Logged'
    ELSE 'FILE Unheard Of' END AS message FROM events)
SELECT CAST(row_id AS VARCHAR) AS record, {_identity(
    action="action", datetime=_iso("ts"), host="host", object="object", principal="principal",
    source_artifact="'FILE log'", source_tool="'plaso'", timestamp_desc="described")} AS event_id,
  {_iso("ts")} AS datetime, zone AS source_timezone, described AS timestamp_desc, host, principal,
  action, object, 'FILE log' AS source_artifact, message, 1.0::DOUBLE AS confidence FROM base"""


def _file_mapping(tool: str, rows: str) -> str:
    """File times: ``rows(record, ts, described, object)``."""
    verb = """CASE described WHEN 'created' THEN 'file_create' WHEN 'modified' THEN 'file_write'
  WHEN 'accessed' THEN 'file_read' ELSE 'file_metadata_change' END"""
    identity = _identity(
        action=verb, datetime=_iso("ts"), host="NULL", object="object", principal="NULL",
        source_artifact="'$MFT'", source_tool=f"'{tool}'", timestamp_desc="described",
    )
    return f"""WITH rows AS ({rows})
SELECT record, {identity} AS event_id, {_iso("ts")} AS datetime, 'UTC' AS source_timezone,
  described AS timestamp_desc, CAST(NULL AS VARCHAR) AS host, CAST(NULL AS VARCHAR) AS principal,
  {verb} AS action, object, '$MFT' AS source_artifact,
  'MFT standard information ' || described || ' timestamp for ' || object AS message,
  1.0::DOUBLE AS confidence FROM rows"""


ORACLES["file_table_mapping"] = _file_mapping(
    "eztools",
    """SELECT 'entry:' || o_orderkey || ' seq:1 ' || described AS record, ts, described,
  '.\\data\\order' || o_custkey || '.dat' AS object FROM (
    SELECT *, o_orderdate AS ts, 'created' AS described FROM orders
    UNION ALL SELECT *, o_orderdate, 'modified' FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT *, date_trunc('day', o_orderdate) + INTERVAL '23:59:59.123456', 'other'
      FROM orders)""",
)
ORACLES["file_facts_mapping"] = _file_mapping(
    "dissect",
    """SELECT CASE WHEN o_orderstatus <> 'P' THEN 'segment:' || o_orderkey || ' seq:7 '
    ELSE 'path:data/' || o_orderkey || ' ' END || described AS record, ts, described,
  'data/' || o_orderkey AS object FROM (
    SELECT *, o_orderdate AS ts, 'created' AS described FROM orders
    UNION ALL SELECT *, o_orderdate, 'accessed' FROM orders WHERE o_orderstatus = 'O')""",
)

_VERB = "trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_')"
ORACLES["column_map"] = f"""
WITH rows AS (SELECT o_orderkey, c_name, c_mktsegment, o_orderstatus,
  (date_trunc('day', o_orderdate) AT TIME ZONE 'Europe/Paris') AT TIME ZONE 'UTC' AS ts,
  CASE WHEN regexp_matches({_VERB}, '^[a-z][a-z0-9_]*$') THEN {_VERB} ELSE 'unlabelled' END AS verb
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT CAST(o_orderkey AS VARCHAR) AS record, {_identity(
    action="verb", datetime=_iso("ts"), host="c_mktsegment", object="o_orderstatus",
    principal="c_name", source_artifact="'orders'", source_tool="'generic_csv'",
    timestamp_desc="'other'")} AS event_id, {_iso("ts")} AS datetime,
  'Europe/Paris' AS source_timezone, 'other' AS timestamp_desc, c_mktsegment AS host,
  c_name AS principal, verb AS action, o_orderstatus AS object, 'orders' AS source_artifact,
  verb || ' ' || o_orderstatus AS message, 1.0::DOUBLE AS confidence FROM rows"""
ORACLES["delimited_scan"] = f"""WITH {TIMELINE}
SELECT CAST(row_id AS VARCHAR) AS record, id AS event_id, datetime,
  'assumed_utc' AS source_timezone, 'logged' AS timestamp_desc, host, principal, action, object,
  'events' AS source_artifact, message, 1.0::DOUBLE AS confidence FROM named"""

ORACLES["quoted_delimited_scan"] = ORACLES["delimited_scan"]
ORACLES["detection_document_scan"] = ORACLES["detection_document_mapping"]
ORACLES["supertimeline_scan"] = f"SELECT * EXCLUDE (record) FROM ({ORACLES['supertimeline_mapping']})"

# Shapes 2, 10, 11 and 17 have an offset; 13 tells hours, 14 and 19 minutes, 21 no date.
ORACLES["timestamp_free_forms"] = f"""
WITH shaped AS (SELECT event_id, CAST(unnest(range(22)) AS INT) AS shape, ts FROM events),
cut AS (SELECT event_id, shape, CASE WHEN shape = 13 THEN date_trunc('hour', ts)
    WHEN shape IN (14, 19) THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS ts,
  CASE shape WHEN 2 THEN 5 WHEN 10 THEN 2 WHEN 11 THEN -3 WHEN 17 THEN -5 ELSE 0 END AS hours FROM shaped)
SELECT event_id, shape, CASE WHEN shape < 21 THEN {_iso("(ts + to_hours(hours))")} END AS datetime,
  CASE shape WHEN 2 THEN 'UTC-05:00' WHEN 10 THEN 'UTC-02:00' WHEN 11 THEN 'UTC+03:00' WHEN 17 THEN 'UTC+05:00'
    WHEN 21 THEN NULL ELSE 'assumed_utc' END AS source_timezone
FROM cut"""

# DRAFTS and EPISODES both begin with the timeline; EPISODES comes first, without it DRAFTS goes on.
_TOLD = f"""{EPISODES}, {DRAFTS.replace(TIMELINE, '', 1).lstrip().removeprefix(',')},
tagged AS (SELECT *, {RULES} AS technique, {SEVERITY} AS severity FROM timeline)"""
ORACLES["narrative_report"] = f"""WITH {_TOLD}
SELECT a.event_id AS case_id, a.event_id AS backing_event_id, a.round_index, t.datetime, t.host,
  {_STATEMENT} AS statement, t.message AS detection, t.severity, coalesce(technique, '') AS techniques,
  'datetime|action' AS verified, 0 AS context, episode_id
FROM (SELECT event_id, round_index FROM accepted) a JOIN tagged t ON t.event_id = a.event_id JOIN members m ON m.event_id = t.event_id"""
ORACLES["notable_cited"] = f"""WITH {_TOLD}
SELECT t.event_id, severity, technique IS NOT NULL OR coalesce(severity IN ('high', 'critical'), false)
  OR t.event_id IN (SELECT event_id FROM accepted) AS notable FROM tagged t"""
ORACLES["written_report"] = f"""WITH {_TOLD}
SELECT 'events' AS name, count(*) AS rows FROM timeline UNION ALL SELECT 'episode_events', count(*) FROM members
UNION ALL SELECT 'provenance', count(*) FROM timeline UNION ALL SELECT 'episodes', count(*) FROM episodes
UNION ALL SELECT 'narrative', count(DISTINCT event_id) FROM accepted UNION ALL SELECT 'audit', count(*) FROM audit
UNION ALL SELECT 'problems', 0 UNION ALL SELECT 'findings', count(*) FROM tagged
  WHERE technique IS NOT NULL OR severity IN ('high', 'critical')"""
