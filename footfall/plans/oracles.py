"""The registered queries as ANSI SQL over the test tables, for checking results.

Written from the definitions in DuckDB's own terms: whole history, keyed lookups of the
first step, counts of distinct visits; nothing is pruned or split.
"""

from __future__ import annotations

from footfall.plans.queries import (
    ADHOC,
    AFTER,
    AS_OF,
    HALF,
    LONG_SESSION,
    MONTH,
    NO_TIME,
    PAGE,
    SEARCH,
    WEEK,
)
from footfall.schema import HITS

# The adapter of footfall.sources.events.
BASE = """
base AS (
  SELECT *,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created,
    event_type IN ('view', 'error') AS on_page,
    event_type = 'click' AND event_id % 4 = 0 AS on_home
  FROM events
),
hits AS (
  SELECT
    sha256(concat_ws('|', event_id, user_id, event_type, props)) AS row_digest, row_digest[:16] AS hit_key,
    user_id || '-' || strftime(ts, '%Y%m%d') AS session,
    CASE WHEN on_page THEN '/p/' || (event_id % 12) WHEN on_home THEN '/' ELSE 'tap: ' || event_type END AS path,
    CASE WHEN on_page THEN '/p/' || (event_id % 12) WHEN on_home THEN '/' ELSE '' END AS title,
    CASE WHEN on_page OR on_home THEN 0 ELSE 1 END AS is_event,
    ['Otter 9', 'Heron 3.1', 'Lynx 2.9', ''][user_id % 4 + 1] AS browser,
    ['Pine 4', 'Cedar 12', 'Maple'][user_id % 3 + 1] AS system,
    CASE WHEN user_id % 5 = 0 THEN 1 + user_id % 3 WHEN event_id % 97 = 0 THEN 2 ELSE 0 END::BIGINT AS bot,
    ['', 'search.example', 'forum.example', 'mail.example', '', 'wiki.example', 'spring flyer'][(event_id + user_id) % 7 + 1] AS referrer,
    ['o', 'h', 'g', 'h', 'o', 'h', 'c'][(event_id + user_id) % 7 + 1] AS referrer_scheme,
    '2400,1350,2' AS screen_size,
    ['', 'PT', 'JP', 'BR', 'KE', 'CA'][user_id % 6 + 1] AS country,
    CASE WHEN (event_id * 7 + user_id) % 5 < 3 THEN 1 ELSE 0 END AS first_visit,
    created AS created_at,
    'site-' || (user_id % 3) AS site,
    props AS agent, event_id
  FROM base
)"""

# One visit per site and session; its entry fields belong to the first flagged step.
MOMENT = "created_at || ' ' || hit_key"


def _entry(field: str) -> str:
    return f"arg_min({field}, {MOMENT}) FILTER (first_visit = 1)"


SESSIONS = f"""
sessions AS (
  SELECT site, session, min(created_at) AS first_seen, max(created_at) AS last_seen,
    sum(1 - is_event)::BIGINT AS page_count, sum(is_event)::BIGINT AS event_count, max(bot) AS bot,
    {_entry("path")} AS entry_path, {_entry("referrer")} AS referrer,
    {_entry("referrer_scheme")} AS referrer_scheme, {_entry("country")} AS country,
    {_entry("browser")} AS browser, {_entry("system")} AS system,
    CASE count(*) WHEN 1 THEN NULL ELSE
      date_diff('second', min(created_at)::TIMESTAMP, max(created_at)::TIMESTAMP) END AS duration_seconds
  FROM hits GROUP BY site, session
)"""

# The log and state of syncs, one call per site and day.
SYNCS = """
sync_log AS (
  SELECT site, strftime(created_at::TIMESTAMP, '%Y%m%d')::BIGINT AS seq, max(event_id) AS last_hit_id,
    max(created_at) AS synced_at, count(*) AS rows
  FROM (SELECT event_id, 'site-' || (user_id % 3) AS site, created AS created_at FROM base)
  GROUP BY 1, 2
),
sync_state AS (
  SELECT site, max(last_hit_id) AS last_hit_id,
    (SELECT l.synced_at FROM sync_log l WHERE l.site = s.site ORDER BY l.seq DESC LIMIT 1) AS last_synced_at,
    sum(rows)::BIGINT AS synced_rows,
    CASE WHEN max(last_hit_id) > 0 THEN max(last_hit_id) END AS cursor
  FROM sync_log s GROUP BY site
)"""

# Export rows: cells in file order, keyed by their content.
EXPORT = """
export AS (
  SELECT *, row_digest[:16] AS hit_key FROM (SELECT * EXCLUDE (hit_key, row_digest), sha256(
      path || chr(0) || title || chr(0) || is_event || chr(0) || agent || chr(0) || browser || chr(0) ||
      system || chr(0) || session || chr(0) || bot || chr(0) || referrer || chr(0) || referrer_scheme ||
      chr(0) || screen_size || chr(0) || country || chr(0) || first_visit || chr(0) || created_at || chr(0)
    ) AS row_digest FROM hits)
)"""

WITH_HITS = f"WITH {BASE}"
WITH_VISITS = f"WITH {BASE}, {SESSIONS}"
WITH_SYNCS = f"WITH {BASE}, {SYNCS}"
WITH_EXPORT = f"WITH {BASE}, {EXPORT}"

RECENT = """site, session, first_seen, last_seen, page_count, event_count, bot, entry_path, referrer,
  country, browser, system, duration_seconds"""
DIRECT = "coalesce(nullif(referrer, ''), 'direct')"
COUNTRY = "coalesce(nullif(country, ''), '??')"

HIT_COLUMNS = ", ".join(name for name in HITS.fieldNames() if name not in ("site", "ts", "event_date"))
STORED_HITS = f"""{HIT_COLUMNS}, epoch(created_at::TIMESTAMP)::BIGINT AS ts, created_at[:10] AS event_date"""


def _on_row(query: str) -> str:
    fields = ("entry_path", "referrer", "country", "browser")
    return "coalesce(" + " OR ".join(f"contains(lower({f}), lower('{query}'))" for f in fields) + ", false)"


def _found(query: str, bots: bool) -> str:
    row = _on_row(query)
    return f"""
  SELECT s.*, CASE WHEN {row} THEN '' ELSE step END AS match_reason
  FROM sessions s LEFT JOIN (
    SELECT site, session, arg_min(path, {MOMENT}) AS step FROM hits
    WHERE contains(lower(path), lower('{query}')) GROUP BY 1, 2) inside USING (site, session)
  WHERE {"true" if bots else "bot = 0"} AND ({row} OR step IS NOT NULL)"""


def _search(query: str, bots: bool, limit: int | None = None) -> str:
    cut = "" if limit is None else f"ORDER BY first_seen DESC, session, site LIMIT {limit}"
    return f"{WITH_VISITS} SELECT {RECENT}, match_reason FROM ({_found(query, bots)}) {cut}"


def _headline(since: str) -> str:
    return f"""
  SELECT count(DISTINCT (site, session)) FILTER (bot = 0) AS visitors,
    count_if(bot = 0 AND is_event = 0)::BIGINT AS pageviews, count_if(bot = 0 AND is_event = 1)::BIGINT AS events,
    count(DISTINCT (site, session)) FILTER (bot > 0) AS bots, any_value(begun.n) AS single_page
  FROM (SELECT count_if(bot = 0 AND page_count = 1 AND first_seen >= '{since}')::BIGINT AS n FROM sessions) begun
  LEFT JOIN (SELECT site, session, bot, is_event FROM hits WHERE created_at >= '{since}') recent ON true"""


PAGES = f"""
  SELECT path AS label, count(*) AS n FROM hits
  WHERE bot = 0 AND is_event = 0 AND created_at >= '{WEEK}'
  GROUP BY 1 ORDER BY n DESC, label LIMIT 8"""


def _top_visits(label: str, limit: int) -> str:
    return f"""
  SELECT {label} AS label, count(*) AS n FROM sessions
  WHERE bot = 0 AND first_seen >= '{WEEK}'
  GROUP BY 1 ORDER BY n DESC, label LIMIT {limit}"""


def _daily(start: str) -> str:
    return f"""
  SELECT day::DATE::VARCHAR AS day, coalesce(c.n, 0) AS n
  FROM (SELECT unnest(generate_series({start}, DATE '{AS_OF[:10]}', INTERVAL 1 DAY)) AS day) d
  LEFT JOIN (
    SELECT created_at[:10]::DATE AS counted, count(*) AS n FROM hits
    WHERE bot = 0 AND is_event = 0 GROUP BY 1
  ) c ON c.counted = d.day"""


DAILY_WEEK = _daily(f"DATE '{WEEK[:10]}'")
DAILY_ALL = _daily("(SELECT min(created_at)[:10]::DATE FROM hits WHERE bot = 0)")

HOURS = "SELECT created_at[12:13]::INTEGER AS hour, count(*) AS n FROM hits WHERE bot = 0 GROUP BY 1"

AGE = f"(epoch(TIMESTAMP '{AS_OF[:19]}') - epoch({{0}}::TIMESTAMP))::BIGINT"


def _age(column: str) -> str:
    age = AGE.format(column)
    return f"""CASE WHEN {age} < 60 THEN 'moments' WHEN {age} < 3600 THEN ({age} // 60) || 'm'
      WHEN {age} < 86400 THEN ({age} // 3600) || 'h' WHEN {age} IS NOT NULL THEN ({age} // 86400) || 'd' END"""


LABELS = f"""
  SELECT site, session,
    first_seen[6:10] || ' ' || first_seen[12:16] AS list_when,
    CASE WHEN first_seen[:10] = '{AS_OF[:10]}' THEN strftime(first_seen::TIMESTAMP, '%H:%M')
      WHEN {AGE.format("first_seen")} < 604800 THEN strftime(first_seen::TIMESTAMP, '%a %H:%M')
      ELSE strftime(first_seen::TIMESTAMP, '%d %b %H:%M') END AS stream_when,
    {_age("last_seen")} AS age,
    CASE WHEN duration_seconds IS NULL THEN '—'
      WHEN duration_seconds < 60 THEN duration_seconds || 's'
      WHEN duration_seconds < 3600 THEN
        (duration_seconds // 60) || 'm' || lpad((duration_seconds % 60)::VARCHAR, 2, '0') || 's'
      ELSE (duration_seconds // 3600) || 'h' || lpad((duration_seconds % 3600 // 60)::VARCHAR, 2, '0') || 'm'
    END AS duration,
    CASE WHEN referrer IS NULL THEN '?' WHEN trim(referrer) = '' THEN 'direct' ELSE referrer END AS source,
    {DIRECT} AS referrer, {COUNTRY} AS country,
    CASE WHEN instr(browser, ' ') > 1 THEN split_part(browser, ' ', 1) ELSE browser END AS browser
  FROM sessions WHERE bot = 0"""

ROLLUP = f"""
rollup AS (
  SELECT 'site-' || r_regionkey AS site, r_regionkey = 4 AS is_demo,
    (SELECT count(*) FROM sessions s WHERE s.bot = 0 AND s.site = 'site-' || r_regionkey) AS visits,
    (SELECT count(*) FROM hits h WHERE h.site = 'site-' || r_regionkey AND h.bot = 0) AS human_hits,
    (SELECT count(*) FROM sessions s WHERE s.bot > 0 AND s.site = 'site-' || r_regionkey) AS bot_visits,
    y.last_synced_at, coalesce(y.synced_rows, 0) AS synced_rows,
    CASE WHEN r_regionkey = 4 THEN 'demo data'
      ELSE coalesce({_age("y.last_synced_at")} || ' ago', 'never synced') END AS last_synced
  FROM region LEFT JOIN sync_state y ON y.site = 'site-' || r_regionkey
)"""
WITH_ROLLUP = f"WITH {BASE}, {SESSIONS}, {SYNCS}, {ROLLUP}"


def _report_section(name: str, rows: str, order: str) -> str:
    return f"SELECT '{name}' AS section, row_number() OVER (ORDER BY {order})::INTEGER AS position, label, n FROM ({rows})"


REPORT = " UNION ALL ".join(
    [
        f"""SELECT 'headline', position, label, n FROM ({_headline(WEEK)}) q, LATERAL (VALUES
      (1, 'visitors', q.visitors), (2, 'pageviews', q.pageviews), (3, 'events', q.events),
      (4, 'bots', q.bots), (5, 'single_page', q.single_page)) v(position, label, n)""",
        _report_section("referrers", _top_visits(DIRECT, 8), "n DESC, label"),
        _report_section("countries", _top_visits(COUNTRY, 6), "n DESC, label"),
        _report_section("pages", PAGES, "n DESC, label"),
        _report_section("daily", f"SELECT day AS label, n FROM ({DAILY_WEEK})", "label"),
    ]
)


def _batches() -> str:
    whole, half = "(SELECT count(*) FROM hits)", f"(SELECT count(*) FROM hits WHERE created_at < '{HALF}')"
    keys = "(SELECT count(DISTINCT (site, row_digest)) FROM hits)"
    half_keys = f"(SELECT count(DISTINCT (site, row_digest)) FROM hits WHERE created_at < '{HALF}')"
    return f"""
  SELECT batch::INTEGER AS batch, fetched, new, status, {keys} AS stored FROM (VALUES
    (1, {half}, {half_keys}, 'synced'),
    (2, {half}, 0::BIGINT, 'already stored'),
    (3, {whole}, {keys} - {half_keys}, 'synced'),
    (4, {whole}, 0::BIGINT, 'already stored')) v(batch, fetched, new, status)"""


ORACLES: dict[str, str] = {
    "visits": f"{WITH_VISITS} SELECT * FROM sessions",
    "visit_list": f"""{WITH_VISITS}
  SELECT first_seen[6:10] || ' ' || first_seen[12:16] AS "when", country, browser, {DIRECT} AS referrer,
    page_count AS pages, coalesce(duration_seconds || 's', '-') AS duration, coalesce(entry_path, '?') AS entry
  FROM sessions WHERE bot = 0 ORDER BY first_seen DESC, session, site LIMIT 25""",
    "recent_visits": f"""{WITH_VISITS} SELECT {RECENT}, '' AS match_reason
  FROM sessions WHERE bot = 0 ORDER BY first_seen DESC, session, site LIMIT 500""",
    "recent_visits_with_bots": f"""{WITH_VISITS} SELECT {RECENT}, '' AS match_reason
  FROM sessions ORDER BY first_seen DESC, session, site LIMIT 500""",
    "visit_search": _search(SEARCH, bots=False),
    "visit_search_with_bots": _search(SEARCH, bots=True),
    "visit_search_newest": _search("FORUM", bots=False, limit=500),
    "visit_search_reasons": f"""{WITH_VISITS}
  SELECT match_reason, count(*) AS n FROM ({_found("tap", bots=True)}) GROUP BY 1""",
    "hidden_bot_matches": f"""WITH {BASE.replace("hits AS (", "plain AS (")},
hits AS (SELECT * REPLACE (CASE WHEN bot > 0 THEN '/crawl' || path ELSE path END AS path) FROM plain), {SESSIONS}
  SELECT visible, CASE WHEN visible = 0 THEN least(everyone, 500) ELSE 0 END::BIGINT AS hidden FROM (
    SELECT count(*) FILTER (WHERE bot = 0) AS visible, count(*) AS everyone
    FROM ({_found("/crawl", bots=True)}))""",
    "journeys": f"""{WITH_HITS} SELECT site, session, created_at, hit_key, path, title, is_event,
    row_number() OVER (PARTITION BY site, session ORDER BY created_at, hit_key) AS position FROM hits""",
    "journeys_in_pieces": f"""{WITH_HITS}, long AS (SELECT * REPLACE ({LONG_SESSION} AS session, {NO_TIME} AS created_at) FROM hits)
  SELECT site, session, created_at, hit_key, path, title, is_event, row_number() OVER (
    PARTITION BY site, session ORDER BY created_at NULLS FIRST, hit_key) AS position FROM long""",
    "totals": f"""{WITH_VISITS} SELECT
    (SELECT count(*) FROM sessions WHERE bot = 0) AS human_visits,
    (SELECT count(*) FROM hits WHERE bot = 0) AS human_hits,
    (SELECT count(*) FROM sessions WHERE bot > 0) AS bot_visits""",
    "overview_headline": f"{WITH_VISITS} {_headline(WEEK)}",
    "overview_headline_28_days": f"{WITH_VISITS} {_headline(MONTH)}",
    "overview_headline_all": f"{WITH_VISITS} {_headline('0000-01-01T00:00:00Z')}",
    "top_pages": f"{WITH_HITS} {PAGES}",
    "top_referrers": f"{WITH_VISITS} {_top_visits(DIRECT, 8)}",
    "top_countries": f"{WITH_VISITS} {_top_visits(COUNTRY, 6)}",
    "daily_series": f"{WITH_HITS} {DAILY_WEEK}",
    "daily_series_all": f"{WITH_HITS} {DAILY_ALL}",
    "daily_levels": f"""{WITH_HITS}, daily AS ({DAILY_ALL})
  SELECT day, n, CASE WHEN n > 0 THEN n * 7 // (SELECT max(n) FROM daily) END AS level FROM daily""",
    "series_summary": f"""{WITH_HITS}, daily AS ({DAILY_ALL})
  SELECT max(n) AS peak, count(*) FILTER (WHERE n > 0) AS days_with_data, count(*) AS days_total,
    count(*) FILTER (WHERE n > 0) < 5 AS too_few_days,
    CASE WHEN count(*) = 0 THEN 'no data' WHEN max(n) = 0 THEN 'no pageviews' ELSE 'ok' END AS state
  FROM daily""",
    "overview_report": f"{WITH_VISITS} SELECT section, position, label, n FROM ({REPORT}) r(section, position, label, n)",
    "avg_duration": f"""{WITH_VISITS} SELECT avg(duration_seconds) AS avg_seconds,
    count(duration_seconds) AS measured_visits, count(*) AS human_visits FROM sessions WHERE bot = 0""",
    "traffic_shares": f"""{WITH_VISITS} SELECT count(*) AS visits,
    count(*) FILTER (WHERE bot = 0) AS human_visits, count(*) FILTER (WHERE bot > 0) AS bot_visits,
    count(*) FILTER (WHERE bot < 0) AS unclassified_visits,
    count(*) FILTER (WHERE bot = 0 AND page_count = 1) AS single_page_visits,
    count(*) FILTER (WHERE page_count >= 4) AS deep_visits,
    (SELECT count(*) FROM hits WHERE is_event = 1) AS events FROM sessions""",
    "hour_histogram": f"{WITH_HITS} {HOURS}",
    "day_and_night": f"""{WITH_HITS} SELECT
    coalesce(sum(n) FILTER (WHERE hour BETWEEN 1 AND 5), 0)::BIGINT AS night,
    coalesce(sum(n) FILTER (WHERE hour BETWEEN 10 AND 16), 0)::BIGINT AS day FROM ({HOURS})""",
    "deep_entry_counts": f"""{WITH_VISITS} SELECT entry_path, count(*) AS n FROM sessions
  WHERE bot = 0 AND page_count >= 3 GROUP BY 1""",
    "top_paths_any": f"""{WITH_HITS} SELECT path AS label, count(*) AS n FROM hits WHERE bot = 0
  GROUP BY 1 ORDER BY n DESC, label LIMIT 10""",
    "reached_from": f"""{WITH_VISITS} SELECT coalesce(nullif(s.referrer, ''), 'direct') AS referrer, count(*) AS n
  FROM sessions s JOIN hits h ON h.site = s.site AND h.session = s.session AND h.path = '{PAGE}' WHERE s.bot = 0 GROUP BY 1""",
    "visit_labels": f"{WITH_VISITS} {LABELS}",
    "source_labels": f"""{WITH_VISITS} SELECT CASE WHEN referrer IS NULL THEN '?' WHEN referrer = '' THEN 'direct'
    ELSE referrer END AS label, count(*) AS n FROM sessions WHERE bot = 0 GROUP BY 1""",
    "overlong_visits": f"""{WITH_VISITS} SELECT site, session, duration_seconds FROM sessions
  WHERE duration_seconds > 3600 ORDER BY duration_seconds DESC, session, site LIMIT 5""",
    "key_audit": f"""{WITH_HITS} SELECT count(*) AS hits, count(DISTINCT (site, hit_key)) AS keys,
    count(*) FILTER (WHERE hit_key = '') AS empty_keys,
    (SELECT count(*) FROM (SELECT site, hit_key FROM hits GROUP BY ALL HAVING count(*) > 1)) AS repeated_keys FROM hits""",
    "site_rollup": f"{WITH_ROLLUP} SELECT * FROM rollup",
    "stalest_site": f"""{WITH_ROLLUP} SELECT site, last_synced_at, last_synced FROM rollup WHERE NOT is_demo
  ORDER BY last_synced_at NULLS FIRST, site LIMIT 1""",
    "stalest_synced_site": f"""{WITH_ROLLUP} SELECT site, last_synced_at, last_synced FROM rollup
  WHERE NOT is_demo AND last_synced_at IS NOT NULL ORDER BY last_synced_at, site LIMIT 1""",
    "sync_state_fold": f"{WITH_SYNCS} SELECT * FROM sync_state",
    "adhoc_sql": f"""{WITH_VISITS} SELECT country, visits, pages::BIGINT AS pages, longest FROM ({ADHOC})""",
    "export_json": f"""{WITH_VISITS} SELECT to_json({{
    'session': session, 'entry_path': entry_path, 'page_count': page_count,
    'duration_seconds': duration_seconds}})::VARCHAR AS json FROM sessions""",
    "export_json_array": f"""{WITH_VISITS} SELECT CASE row_number() OVER (ORDER BY session, site) WHEN 1 THEN '[' ELSE ',' END
    || to_json({{'session': session, 'entry_path': entry_path, 'page_count': page_count,
    'duration_seconds': duration_seconds}})::VARCHAR AS line FROM sessions UNION ALL SELECT ']'""",
    "read_export": f"{WITH_EXPORT} SELECT {STORED_HITS}, '' AS site FROM export",
    "hit_keys": f"{WITH_EXPORT} SELECT hit_key, count(*) AS n FROM export GROUP BY 1",
    "key_drift": f"""{WITH_EXPORT} SELECT count(DISTINCT hit_key) AS keys, count(*) AS first_rows,
    count(*) AS second_rows, 0::BIGINT AS drifted_keys FROM export""",
    "insert_new_hits": f"{WITH_HITS} {_batches()}",
    "replaced_hits": f"""{WITH_HITS} SELECT created_at[:10] AS event_date, count(DISTINCT (site, row_digest)) AS n
  FROM hits WHERE created_at >= '{HALF}' GROUP BY 1""",
    "stream_ingest": f"{WITH_EXPORT} SELECT DISTINCT {STORED_HITS}, 'site-0' AS site FROM export",
    "stream_sync_state": f"""{WITH_EXPORT} SELECT 'site-0' AS site, 0::BIGINT AS last_hit_id,
    '{AS_OF}' AS last_synced_at, count(DISTINCT row_digest) AS synced_rows, NULL::BIGINT AS cursor FROM export""",
    "sync_state_mixed": f"""{WITH_EXPORT} SELECT 'site-0' AS site, 9::BIGINT AS last_hit_id,
    '{AFTER}' AS last_synced_at, count(DISTINCT row_digest) AS synced_rows, 9::BIGINT AS cursor, 3::BIGINT AS calls
  FROM export""",
    "read_odd_export": f"""{WITH_HITS}, odd AS (
    SELECT path, session, created_at, bot, event_id % 4 AS kind, CASE event_id % 4 WHEN 1 THEN ''
      WHEN 0 THEN 'say "' || event_id || '"' || chr(10) || 'twice, or more' ELSE 'plain' END AS title FROM hits)
  SELECT sha256(path || chr(0) || session || chr(0) || created_at || chr(0)
      || CASE kind WHEN 1 THEN '' ELSE title || chr(0) || bot || chr(0) END
      || CASE kind WHEN 2 THEN 'x,y' || chr(0) || chr(0) ELSE '' END)[:16] AS hit_key,
    path, session, created_at, title, CASE kind WHEN 1 THEN 0 ELSE bot END AS bot FROM odd""",
    "two_sites": f"""{WITH_VISITS} SELECT t.site, session, page_count, event_count, 0::BIGINT AS repeated_keys
  FROM sessions, (VALUES ('one'), ('two')) t(site)""",
}

# Kept tables answer as the hits themselves do.
ORACLES |= {
    "kept_visits": ORACLES["visits"],
    "kept_headline": ORACLES["overview_headline"],
    "kept_visit_list": ORACLES["visit_list"],
}
