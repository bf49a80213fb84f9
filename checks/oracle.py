"""SQL counterparts of the registered queries, for DuckDB on the same tables.

They state the result from the raw tables and share no code with the operators;
only the tables of fixed values (labels, patterns) are read from the library.
"""

from __future__ import annotations

from checks import fixtures as fx
from weblode.functions import user_agent as ua
from weblode.operators.layout import DEFAULT_PATTERN

ORACLES: dict[str, str] = {}

T = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def ts(column: str) -> str:
    return T.format(column)


# --- shared relations --------------------------------------------------------

ROWS = f"rows_ AS ({fx.ACCESS_ROWS})"
LOG_TUI = """log AS (SELECT event_id, ts, CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofweek(ts) AS INTEGER) AS day_of_week,
  ip_address, method, path, http_version, status, response_size, referrer, user_agent
  FROM rows_ WHERE NOT is_malformed)"""
LOG = LOG_TUI.replace(" response_size,", " nullif(response_size, 0) AS response_size,")
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
WEEK = f"ts >= {AS_OF} - INTERVAL 7 DAYS"
MONTH = f"ts >= {AS_OF} - INTERVAL 1 MONTH"
TUI_WEEK = f"ts > {AS_OF} - INTERVAL 168 HOURS"


def over_log(body: str, *relations: str, tui: bool = False) -> str:
    return f"WITH {', '.join([ROWS, LOG_TUI if tui else LOG, *relations])} {body}"


def any_mark(column: str, marks: list[str]) -> str:
    tests = []
    for mark in marks:
        if mark.startswith("Windows NT ") and "." in mark:
            tests.append(f"{column} LIKE '%{mark.replace('.', '_')}%'")
        else:
            tests.append(f"contains({column}, '{mark}')")
    return "(" + " OR ".join(tests) + ")"


def labels(column: str, rules, otherwise: str) -> str:
    whens = " ".join(f"WHEN {any_mark(column, marks)} THEN '{label}'" for label, marks in rules)
    return f"CASE {whens} ELSE {otherwise} END"


def tui_bot(column: str) -> str:
    return any_mark(column, ua.TUI_BOT_MARKS)


def web_bot(column: str) -> str:
    return f"regexp_matches({column}, '(?i){'|'.join(ua.WEB_BOT_MARKS)}')"


def tui_client(c: str) -> str:
    tool = labels(c, ua.TUI_TOOLS, "'Other'")
    return (
        f"CASE WHEN {c} = '' THEN 'Unknown' WHEN starts_with({c}, 'Mozilla/') "
        f"THEN {labels(c, ua.TUI_BROWSERS, tool)} ELSE {tool} END"
    )


def tui_os(c: str) -> str:
    version = f"regexp_extract({c}, 'Windows NT (.*)', 1)"
    nt = " ".join(f"WHEN starts_with({version}, '{p}') THEN '{label}'" for label, p in ua.TUI_WINDOWS_NT)
    rest = labels(c, ua.TUI_SYSTEMS, f"CASE WHEN {tui_bot(c)} THEN 'Bot' ELSE 'Other' END")
    return (
        f"CASE WHEN {c} = '' THEN 'Unknown' WHEN contains({c}, 'Windows NT ') "
        f"THEN CASE {nt} ELSE 'Windows' END ELSE {rest} END"
    )


def tui_device(c: str) -> str:
    rest = labels(c, ua.TUI_DEVICES, f"CASE WHEN {tui_bot(c)} THEN 'Bot' ELSE 'Other' END")
    return (
        f"CASE WHEN {c} = '' THEN 'Unknown' WHEN contains({c}, 'iPhone') THEN 'iPhone' "
        f"WHEN contains({c}, 'iPad') THEN 'iPad' WHEN contains({c}, 'Android') THEN "
        f"CASE WHEN contains({c}, 'Mobile') THEN 'Android Phone' ELSE 'Android Tablet' END ELSE {rest} END"
    )


LABEL_SQL = {
    "client": {"web": labels("user_agent", ua.WEB_CLIENTS, "'Other'"), "tui": tui_client("user_agent")},
    "os": {"web": labels("user_agent", ua.WEB_SYSTEMS, "'Other'"), "tui": tui_os("user_agent")},
    "device": {"web": labels("user_agent", ua.WEB_DEVICES, "'Other'"), "tui": tui_device("user_agent")},
}


# --- parsing -----------------------------------------------------------------


def lines(line: str, time: str) -> str:
    return f"{ROWS}, lines_ AS (SELECT event_id, {line.format(time=time)} AS value FROM rows_)"


ACCESS_LINES = lines(fx.ACCESS_LINE, "strftime(ts, '%d/%b/%Y:%H:%M:%S')")
TIMED_LINES = lines(fx.TIMED_LINE, "strftime(ts, '%Y-%m-%dT%H:%M:%S')")


def parsed(profile: str) -> str:
    group = lambda n: f"regexp_extract(value, '{DEFAULT_PATTERN}', {n})"
    zero = (lambda x: f"nullif({x}, 0)") if profile == "web" else (lambda x: x)
    bot = web_bot("user_agent") if profile == "web" else tui_bot("user_agent")
    return f"""WITH {ACCESS_LINES}, parsed AS (SELECT event_id, {group(1)} AS ip_address,
      CAST(strptime(replace({group(2)}, ' +0000', ''), '%d/%b/%Y:%H:%M:%S') AS TIMESTAMP) AS t,
      {group(3)} AS method, {group(4)} AS path, {group(5)} AS http_version,
      {zero(f"CAST({group(6)} AS INTEGER)")} AS status, {zero(f"CAST({group(7)} AS BIGINT)")} AS response_size,
      {group(8)} AS referrer, {group(9)} AS user_agent
      FROM lines_ WHERE regexp_matches(value, '{DEFAULT_PATTERN}'))
    SELECT event_id, ip_address, {ts("t")} AS ts, CAST(hour(t) AS INTEGER) AS hour,
      CAST(dayofweek(t) AS INTEGER) AS day_of_week, method, path, http_version, status, response_size,
      referrer, user_agent, {LABEL_SQL["client"][profile]} AS client, {LABEL_SQL["os"][profile]} AS os,
      {LABEL_SQL["device"][profile]} AS device, {bot} AS is_bot FROM parsed"""


ORACLES["parse_access"] = parsed("web")
ORACLES["parse_access_tui"] = parsed("tui")

TIMED_PATTERN = (
    r'^(\S+) - \S+ \[(\S+)\] "(\S+) (\S+) (\S+)" (\d{3}) (\d+) rt=[\d.]+ ref="([^"]*)" ua="([^"]*)"'
)
ORACLES["parse_custom_format"] = f"""WITH {TIMED_LINES}, parsed AS (
  SELECT event_id, regexp_extract(value, '{TIMED_PATTERN}',
    ['ip', 'time', 'method', 'path', 'protocol', 'status', 'bytes', 'referrer', 'agent']) AS f
  FROM lines_ WHERE regexp_matches(value, '{TIMED_PATTERN}'))
SELECT event_id, f.ip AS ip_address, {ts("strptime(replace(f.time, '+00:00', ''), '%Y-%m-%dT%H:%M:%S')")} AS ts,
  f.method AS method, f.path AS path, f.protocol AS http_version, CAST(f.status AS INTEGER) AS status,
  nullif(CAST(f.bytes AS BIGINT), 0) AS response_size, f.referrer AS referrer, f.agent AS user_agent,
  CAST(hour(strptime(replace(f.time, '+00:00', ''), '%Y-%m-%dT%H:%M:%S')) AS INTEGER) AS hour FROM parsed"""

ORACLES["malformed_lines"] = (
    f"WITH {ACCESS_LINES} SELECT event_id, value FROM lines_ WHERE NOT regexp_matches(value, '{DEFAULT_PATTERN}')"
)
ORACLES["malformed_count"] = "SELECT count(*) AS n FROM events WHERE event_id % 97 = 0"

ERROR_LINES = (
    f"errors_ AS ({fx.ERROR_ROWS}), lines_ AS (SELECT *, "
    + fx.ERROR_LINE.format(time="strftime(ts, '%Y/%m/%d %H:%M:%S')")
    + " AS value FROM errors_)"
)
# Stated from the fields the lines were made of.
ERROR_FIELDS = f"""event_id, {ts("ts")} AS ts, level, CAST(pid AS INTEGER) AS pid, CAST(tid AS STRING) AS tid,
  CASE WHEN cid_text = '' THEN '0' ELSE CAST(event_id AS STRING) END AS cid, concat(body, tail_text) AS message"""


def error_optional(name: str, pattern: str) -> str:
    return f"nullif(regexp_extract(value, '{pattern}', 1), '') AS {name}"


ERROR_LOG = f"""errors_log AS (SELECT {ERROR_FIELDS}, {error_optional("client_address", "client: ([^,]+)")},
  {error_optional("server_address", "server: ([^ ]+)")}, {error_optional("request", 'request: "([^"]+)"')},
  {error_optional("referrer", 'referrer: "([^"]+)"')}, {error_optional("host", 'host: "([^"]+)"')}, ts AS t
  FROM lines_)"""
ORACLES["parse_errors"] = f"WITH {ERROR_LINES}, {ERROR_LOG} SELECT * EXCLUDE (t) FROM errors_log"
ORACLES["parse_errors_tui"] = f"WITH {ERROR_LINES} SELECT {ERROR_FIELDS} FROM lines_"

ORACLES["error_search"] = f"""WITH {ERROR_LINES}, {ERROR_LOG} SELECT event_id, level, message FROM errors_log
WHERE t >= {AS_OF} - INTERVAL 7 DAYS AND level IN ('error', 'crit')
  AND contains(lower(concat_ws(' ', level, message, coalesce(client_address, ''), coalesce(server_address, ''),
    coalesce(request, ''), coalesce(referrer, ''), coalesce(host, ''))), 'lost the peer')"""
ORACLES["error_severity"] = f"""WITH errors_ AS ({fx.ERROR_ROWS}) SELECT level, count(*) AS n,
  CASE WHEN level IN ('error', 'crit') THEN 'error' WHEN level = 'warn' THEN 'warn' ELSE 'info' END AS band
FROM errors_ GROUP BY level"""
ORACLES["error_sorted"] = (
    f"WITH {ERROR_LINES}, {ERROR_LOG} SELECT event_id, client_address, level FROM errors_log ORDER BY client_address NULLS FIRST"
)

# --- labels --------------------------------------------------------------------

# The expected labels of the fixture's agents, stated one by one (web, tui), known by a mark in the agent.
EXPECTED_LABELS = {
    "Edg/": {"client": ("Chrome", "Edge"), "os": ("Windows 10/11", "Windows 10/11"), "device": ("Windows", "Windows PC")},
    "Firefox/": {"client": ("Firefox", "Firefox"), "os": ("Windows 10/11", "Windows 10/11"), "device": ("Windows", "Windows PC")},
    "Pixel": {"client": ("Chrome", "Chrome"), "os": ("Android", "Android"), "device": ("Android", "Android Phone")},
    "Chrome/": {"client": ("Chrome", "Chrome"), "os": ("Windows 10/11", "Windows 10/11"), "device": ("Windows", "Windows PC")},
    "iPhone": {"client": ("Safari", "Safari"), "os": ("iOS", "iOS"), "device": ("iPhone", "iPhone")},
    "Macintosh": {"client": ("Safari", "Safari"), "os": ("MacOS", "macOS"), "device": ("Mac", "Mac")},
    "curl": {"client": ("Curl", "Curl"), "os": ("Other", "Other"), "device": ("Other", "Other")},
    "python-requests": {"client": ("Python requests", "Python requests"), "os": ("Other", "Other"), "device": ("Other", "Other")},
    "Googlebot": {"client": ("Other", "Other"), "os": ("Search Bot", "Bot"), "device": ("Other", "Bot")},
}
for _dimension in LABEL_SQL:
    for _i, _profile in enumerate(("web", "tui")):
        _cases = " ".join(f"WHEN contains(user_agent, '{mark}') THEN '{known[_dimension][_i]}'" for mark, known in EXPECTED_LABELS.items())
        _empty = ("Other", "Unknown")[_i]
        ORACLES[f"ua_{_dimension}_{_profile}"] = over_log(
            f"SELECT CASE {_cases} WHEN user_agent = '' THEN '{_empty}' END AS {_dimension}, count(*) AS n FROM log GROUP BY 1"
        )
_texts = lambda row: ", ".join("'Other'" if text is None else f"'{text}'" for text in row)
_stated = ", ".join(f"({i}, {_texts(row)})" for i, row in enumerate(fx.AGENTS))
ORACLES["agent_labels"] = f"""WITH stated(place, user_agent, client_web, os_web, device_web, client_tui, os_tui, device_tui) AS (VALUES {_stated})
  SELECT user_agent, count(*) AS n, client_web, os_web, device_web, client_tui, os_tui, device_tui
  FROM events JOIN stated ON place = event_id % {len(fx.AGENTS)} GROUP BY ALL"""
ORACLES["agent_counts"] = over_log(
    " UNION ALL ".join(
        f"SELECT '{name}' AS dimension, {sql['web']} AS label, count(*) AS n FROM log GROUP BY 2"
        for name, sql in LABEL_SQL.items()
    )
)
ORACLES["bots"] = (
    f"WITH {ROWS} SELECT user_agent, {web_bot('user_agent')} AS bot_web, {tui_bot('user_agent')} AS bot_tui, "
    "count(*) AS n FROM rows_ GROUP BY user_agent"
)


def by_path(version: str) -> str:
    return f"WITH {ROWS} SELECT path, {version} AS version, count(*) AS n FROM rows_ GROUP BY path"


def v_text(expression: str) -> str:
    return f"CASE WHEN {expression} = '' THEN '' ELSE 'v' || {expression} END"


def tui_version(path: str) -> str:
    whole = " ".join(f"WHEN contains({path}, '/v{n}/') THEN 'v{n}'" for n in range(1, 6))
    api = v_text(f"regexp_extract({path}, '/api/v([0-9.]*)', 1)")
    plain = v_text(f"regexp_extract({path}, '/v([0-9.]*)', 1)")
    return f"CASE {whole} WHEN contains({path}, '/api/v') THEN {api} ELSE {plain} END"


WEB_VERSION = "nullif(regexp_extract(path, '/(v[0-9]+)/', 1), '')"
ORACLES["api_version_web"] = by_path(WEB_VERSION)
ORACLES["api_version_tui"] = by_path(tui_version("path"))
FAST_TEXT = """CASE WHEN contains(path, '/api/v') THEN regexp_extract(path, '/api/v([^/]*)', 1)
  WHEN contains(path, '/version/') THEN regexp_extract(path, '/version/([^/]*)', 1)
  ELSE regexp_extract(path, '/v([^/]*)', 1) END"""
ORACLES["api_version_fast"] = by_path(
    f"CASE WHEN regexp_matches({FAST_TEXT}, '^[0-9]') THEN 'v' || {FAST_TEXT} ELSE '' END"
)
_known = " ".join(
    f"WHEN contains(path, '/{v}/') THEN '{v}'"
    for v in ["v1", "v2", "v3", "v4", "v5", "v1.0", "v1.1", "v2.0", "v2.1", "v3.0"]
)
_general = " ".join(
    f"WHEN regexp_matches(path, '{p}') THEN 'v' || regexp_extract(path, '{p}', 1)"
    for p in [
        r"/api/v(\d+(?:\.\d+)?)/", r"/v(\d+(?:\.\d+)?)/", r"/version/(\d+(?:\.\d+)?)/", r"/api/(\d+(?:\.\d+)?)/",
    ]
)
ORACLES["api_version_candidate"] = by_path(f"CASE {_known} {_general} ELSE '' END")
URL_PATH = "regexp_extract(regexp_replace(url, '^[^:]*://', ''), '(?s)(/.*)$', 1)"
ORACLES["version_from_url"] = f"""WITH u AS (SELECT page_id, {URL_PATH} AS path,
  {URL_PATH.replace("url", "url || '/api/v' || CAST(page_id % 12 AS STRING) || '/x'")} AS api FROM pages)
SELECT page_id, path, {tui_version("path")} AS version, {tui_version("api")} AS api_version FROM u"""

ORACLES["status_class"] = over_log(
    """SELECT CASE WHEN status < 300 THEN '2xx' WHEN status < 400 THEN '3xx' WHEN status < 500 THEN '4xx'
      ELSE '5xx' END AS status_class, count(*) AS n,
  count(*) FILTER (WHERE status // 100 = 2) AS success, count(*) FILTER (WHERE status // 100 = 3) AS redirect,
  count(*) FILTER (WHERE status // 100 = 4) AS client_error, count(*) FILTER (WHERE status // 100 = 5) AS server_error,
  count(*) FILTER (WHERE status // 100 IN (4, 5)) AS error FROM log GROUP BY 1"""
)
ORACLES["user_requests"] = over_log(
    "SELECT ip_address || '::' || user_agent AS user_id, count(*) AS n FROM log GROUP BY 1"
)

UNITS = ["Bytes", "KB", "MB", "GB", "TB"]


def byte_case(amount: str, render) -> str:
    whens = " ".join(
        f"WHEN {amount} >= {1024**i} THEN {render(f'(CAST({amount} AS DOUBLE) / {1024**i})', UNITS[i])}"
        for i in range(4, 0, -1)
    )
    return f"CASE {whens} ELSE {render(f'CAST({amount} AS DOUBLE)', 'Bytes')} END"


_rounded = byte_case("b", lambda x, unit: f"CAST(CAST(floor({x} + 0.5) AS BIGINT) AS STRING) || ' {unit}'")
_decimals = byte_case(
    "b", lambda x, unit: rf"regexp_replace(printf('%.2f', round({x}, 2)), '\.?0+$', '') || ' {unit}'"
)
_short = byte_case("b", lambda x, unit: f"printf('%.1f', {x}) || ' {unit}'")
ORACLES["byte_labels"] = over_log(
    f"""SELECT size, {_rounded} AS rounded, {_decimals} AS decimals,
  CASE WHEN b < 1024 THEN CAST(b AS STRING) || ' B' ELSE {_short} END AS short, n FROM sized""",
    """sized AS (SELECT response_size AS size, response_size * 997 AS b, count(*) AS n FROM log
      WHERE response_size IS NOT NULL GROUP BY 1)""",
)
ORACLES["count_labels"] = """WITH c AS (SELECT event_id, event_id * 2477 AS n FROM events),
parts AS (SELECT event_id, n, n // 31536000 AS y, n % 31536000 // 86400 AS d, n % 86400 // 3600 AS h,
  n % 3600 // 60 AS m, n % 60 AS s FROM c)
SELECT event_id, CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1000000) WHEN n >= 1000 THEN printf('%.1fK', n / 1000)
  ELSE CAST(n AS STRING) END AS count_text,
  CASE WHEN n = 0 THEN '0s' ELSE concat_ws(' ', CASE WHEN y > 0 THEN concat(y, 'y') END, CASE WHEN d > 0 THEN concat(d, 'd') END,
    CASE WHEN h > 0 THEN concat(h, 'h') END, CASE WHEN m > 0 THEN concat(m, 'm') END,
    CASE WHEN s > 0 THEN concat(s, 's') END) END AS uptime_text FROM parts"""
ORACLES["bands"] = """WITH r AS (SELECT event_id, value AS u, value / CAST(330 AS DOUBLE) AS rate FROM events)
SELECT event_id, CAST(CASE WHEN rate = 0 THEN 1 ELSE ceil(rate * 10) END AS INTEGER) AS rate_level,
  CASE WHEN rate > CAST(0.7 AS DOUBLE) THEN 'good' WHEN rate < CAST(0.25 AS DOUBLE) THEN 'bad' ELSE 'fair' END AS rate_web,
  CASE WHEN rate >= 0.9::DOUBLE THEN '>=0.9' WHEN rate >= 0.8::DOUBLE THEN '>=0.8' WHEN rate >= 0.7::DOUBLE THEN '>=0.7'
    WHEN rate >= 0.6::DOUBLE THEN '>=0.6' WHEN rate >= 0.5::DOUBLE THEN '>=0.5' WHEN rate >= 0.4::DOUBLE THEN '>=0.4'
    ELSE '<0.4' END AS rate_tui,
  CASE WHEN u < 50 THEN 'low' WHEN u < 80 THEN 'medium' ELSE 'high' END AS cpu_web,
  CASE WHEN u < 60 THEN 'low' WHEN u < 90 THEN 'medium' ELSE 'high' END AS memory_web,
  CASE WHEN u < 50 THEN 'low' WHEN u < 80 THEN 'medium' ELSE 'high' END AS storage_web,
  CASE WHEN u <= 30 THEN '<=30' WHEN u <= 40 THEN '<=40' WHEN u <= 50 THEN '<=50' WHEN u <= 60 THEN '<=60'
    WHEN u <= 70 THEN '<=70' WHEN u <= 80 THEN '<=80' ELSE '>80' END AS cpu_tui FROM r"""

# --- filters ---------------------------------------------------------------------

FILTERED = f"SELECT event_id, {ts('ts')} AS ts, path, method, status FROM log WHERE "
NOT_EXCLUDED = "split_part(path, '?', 1) NOT IN ('/search', '/static/css/app.css')"
FILTERS = {
    "filter_period_web": WEEK,
    "filter_period_month": MONTH,
    "filter_period_tui": TUI_WEEK,
    "filter_path_method": "path = '/api/v1/users' AND method = 'POST'",
    "filter_status": "status = 404",
    "filter_status_ranges": "status BETWEEN 300 AND 399 OR status BETWEEN 500 AND 599",
    "filter_ignore_404": "status IS DISTINCT FROM 404",
    "filter_exclude_bots": f"NOT {web_bot('user_agent')}",
    "filter_referrer": "referrer = '-'",
    "filter_version": f"{WEB_VERSION} = 'v1'",
    "filter_version_tui": f"({tui_version('path')}) = 'v1.1'",
    "filter_device": f"({LABEL_SQL['client']['web']}) = 'Chrome' AND contains(user_agent, 'Android')",
    "filter_hour_weekday": "hour = 9 AND day_of_week = 1",
    "excluded_endpoints": NOT_EXCLUDED,
    "filter_conjunction": f"""{MONTH} AND method = 'GET' AND (status BETWEEN 200 AND 299 OR status BETWEEN 400 AND 499)
      AND {WEB_VERSION} = 'v1' AND day_of_week = 3 AND status <> 404 AND NOT {web_bot("user_agent")} AND path <> '/docs'""",
}
for _name, _where in FILTERS.items():
    ORACLES[_name] = over_log(FILTERED + _where)
ORACLES["excluded_endpoint_table"] = over_log(
    """SELECT event_id, path FROM log WHERE path NOT IN
      (SELECT path FROM log WHERE status = 503 AND path LIKE '%/api/%')"""
)
ORACLES["filter_endpoint"] = over_log(
    "SELECT event_id FROM log WHERE path = '/docs' AND method = 'GET' AND status = 200"
)
ORACLES["filter_lookup"] = over_log(
    "SELECT event_id FROM log WHERE contains(user_agent, 'Android') AND contains(user_agent, 'Mobile')"
)

# Location straight from the third octet: network i is 10.0.i.0/24 for the 25 nations.
LOCATED = """placed AS (SELECT log.*, n.n_name AS country FROM log
  LEFT JOIN nation n ON n.n_nationkey = CAST(split_part(ip_address, '.', 3) AS INTEGER))"""
ORACLES["filter_location"] = over_log(
    f"SELECT event_id, ip_address FROM placed WHERE country = 'NATION_3' AND {WEEK}", LOCATED
)

# --- counts -----------------------------------------------------------------------

ORACLES["endpoint_counts"] = over_log(
    "SELECT split_part(path, '?', 1) AS path, method, status, count(*) AS n FROM log GROUP BY 1, 2, 3"
)
TOP_ENDPOINTS = "SELECT path, method, status, count(*) AS n FROM log GROUP BY ALL ORDER BY n DESC, path, method, status LIMIT 50"
ORACLES["top_endpoints"] = over_log(TOP_ENDPOINTS)
ORACLES["top_endpoints_week"] = over_log(TOP_ENDPOINTS.replace("FROM log", f"FROM log WHERE {WEEK}"))
ORACLES["endpoints_tui"] = over_log("SELECT path, method, status, count(*) AS n FROM log GROUP BY ALL")
ORACLES["top_referrers_web"] = over_log(
    """SELECT referrer, count(*) AS n FROM log WHERE referrer NOT IN ('', '-') GROUP BY 1
    ORDER BY n DESC, referrer LIMIT 50"""
)
ORACLES["top_referrers_tui"] = over_log(
    """SELECT referrer, method, status, count(*) AS n FROM log WHERE referrer NOT IN ('', '-') GROUP BY ALL
    ORDER BY n DESC, referrer, method, status LIMIT 16"""
)
ORACLES["version_counts"] = over_log(
    f"SELECT {WEB_VERSION} AS version, count(*) AS n FROM log WHERE {WEB_VERSION} IS NOT NULL GROUP BY 1"
)
ORACLES["version_counts_tui"] = over_log(
    f"SELECT {tui_version('path')} AS version, count(*) AS n FROM log WHERE ({tui_version('path')}) <> '' GROUP BY 1"
)
ORACLES["top_clients"] = over_log(
    f"SELECT {LABEL_SQL['client']['web']} AS client, count(*) AS n FROM log GROUP BY 1 ORDER BY n DESC, client LIMIT 10"
)


def dense(slots: int, key: str, expression: str, extra: str = "") -> str:
    return over_log(
        f"""SELECT CAST(s.k AS INTEGER) AS {key}, CAST(coalesce(c.n, 0) AS BIGINT) AS n{extra}
        FROM (SELECT unnest(range({slots})) AS k) s LEFT JOIN
        (SELECT {expression} AS k, count(*) AS n FROM log GROUP BY 1) c ON c.k = s.k"""
    )


ORACLES["weekday_counts"] = dense(7, "day_of_week", "day_of_week", ", CAST((s.k + 6) % 7 AS INTEGER) AS position")
ORACLES["hour_counts"] = dense(24, "hour", "hour", ", CAST((s.k + 12) % 24 AS INTEGER) AS position")
for _minutes, _name in ((15, "15m"), (180, "3h")):
    ORACLES[f"time_of_day_{_name}"] = over_log(
        f"""SELECT CAST(s.k * {_minutes} AS INTEGER) AS slot, CAST(coalesce(c.n, 0) AS BIGINT) AS n
        FROM (SELECT unnest(range({1440 // _minutes})) AS k) s LEFT JOIN
        (SELECT (hour(ts) * 60 + minute(ts)) // {_minutes} AS k, count(*) AS n FROM log GROUP BY 1) c ON c.k = s.k"""
    )
ORACLES["share_of_max"] = over_log(f"SELECT *, n / max(n) OVER () AS share FROM ({TOP_ENDPOINTS})")
ORACLES["same_method"] = over_log(
    f"""SELECT 'all' AS list, count(DISTINCT method) = 1 AS one_method FROM ({TOP_ENDPOINTS})
    UNION ALL SELECT 'GET', count(DISTINCT method) = 1 FROM ({TOP_ENDPOINTS.replace("FROM log", "FROM log WHERE method = 'GET'")})"""
)
_plain_dimensions = {
    "referrer": ("referrer", "referrer NOT IN ('', '-')"),
    "version": (WEB_VERSION, f"{WEB_VERSION} IS NOT NULL"),
    "user_agent": ("user_agent", "true"),
    "ip_address": ("ip_address", "true"),
    "hour": ("CAST(hour AS STRING)", "true"),
    "day_of_week": ("CAST(day_of_week AS STRING)", "true"),
}


def dimension(name: str, key: str, where: str, source: str = "log") -> str:
    return f"""SELECT '{name}' AS dimension, {key} AS key, CAST(NULL AS STRING) AS method,
      CAST(NULL AS INTEGER) AS status, count(*) AS n FROM {source} WHERE {where} GROUP BY 2"""


ENDPOINT_DIMENSION = "SELECT 'endpoint' AS dimension, path AS key, method, status, count(*) AS n FROM log GROUP BY 2, 3, 4"
ORACLES["dimension_counts"] = over_log(
    " UNION ALL ".join([ENDPOINT_DIMENSION, *[dimension(n, k, w) for n, (k, w) in _plain_dimensions.items()]])
)
ORACLES["newest_rows"] = over_log(
    f"SELECT event_id, {ts('ts')} AS ts FROM (SELECT * FROM log ORDER BY log.ts DESC, event_id LIMIT 500) newest"
)
_report = {
    **{k: v for k, v in _plain_dimensions.items() if k not in ("user_agent", "ip_address")},
    **{name: (sql["web"], "true") for name, sql in LABEL_SQL.items()},
    "location": ("country", "country IS NOT NULL"),
    "unknown_ip": ("ip_address", "country IS NULL"),
}
ORACLES["report_counts"] = over_log(
    " UNION ALL ".join(
        [
            ENDPOINT_DIMENSION.replace("FROM log", f"FROM placed WHERE {WEEK}"),
            *[dimension(n, k, f"{w} AND {WEEK}", "placed") for n, (k, w) in _report.items()],
        ]
    ),
    LOCATED,
)

# --- locations ----------------------------------------------------------------------

ORACLES["geo_range_join"] = f"""WITH {ROWS}, networks AS ({fx.NETWORKS}),
ips AS (SELECT DISTINCT ip_address FROM rows_),
numbered AS (SELECT ip_address, list_reduce(list_transform(string_split(ip_address, '.'), lambda o: CAST(o AS BIGINT)),
  lambda a, b: a * 256 + b) AS number FROM ips)
SELECT ip_address, coalesce(country, '') AS country, '' AS city, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon
FROM numbered LEFT JOIN networks ON number BETWEEN network_lo AND network_hi"""
ORACLES["distinct_addresses"] = over_log("SELECT DISTINCT ip_address FROM log")
ORACLES["log_with_country"] = over_log(
    "SELECT event_id, ip_address, coalesce(country, '') AS country FROM placed", LOCATED
)
ORACLES["location_counts"] = over_log(
    """SELECT country, n, locations FROM (SELECT country, count(*) AS n, count(*) OVER () AS locations FROM placed
    WHERE country IS NOT NULL GROUP BY country) ORDER BY n DESC, country LIMIT 12""",
    LOCATED,
)
ORACLES["unknown_ips"] = over_log("SELECT DISTINCT ip_address FROM placed WHERE country IS NULL", LOCATED)
ORACLES["country_names"] = over_log(
    """SELECT country, country || ', ' || r_name AS name, upper(country[1:2]) AS code,
      translate(upper(country[1:2]), 'AN', '🇦🇳') AS flag, count(*) AS n
    FROM placed JOIN nation ON n_name = country JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""",
    LOCATED,
)
ORACLES["live_points"] = over_log(
    f"""SELECT {ts("ts")} AS ts, CAST(length(country) AS DOUBLE) AS lat, CAST(length(ip_address) AS DOUBLE) AS lon,
      status FROM placed WHERE country IS NOT NULL AND placed.ts >= {AS_OF} - INTERVAL 24 HOURS""",
    LOCATED,
)

# --- totals ---------------------------------------------------------------------------


def totals(where: str, low: int, hours: str) -> str:
    return f"""SELECT *, success_count / success_total AS success_rate, total_requests / total_hours AS requests_per_hour,
      total_users / total_hours AS users_per_hour
    FROM (SELECT count(*) AS total_requests, count(DISTINCT (ip_address, user_agent)) AS total_users,
      count(*) FILTER (WHERE status BETWEEN {low} AND 399) AS success_count, count(status) AS success_total,
      {ts("min(log.ts)")} AS min_ts, {ts("max(log.ts)")} AS max_ts, CAST({hours} AS DOUBLE) AS total_hours
      FROM log WHERE {where})"""


SPAN_HOURS = "greatest((epoch(max(log.ts)) - epoch(min(log.ts))) / 3600, 1)"
ORACLES["totals_and_rates"] = over_log(
    f"""SELECT t.*, l.* FROM ({totals("true", 200, SPAN_HOURS)}) t,
    (SELECT strftime(min(log.ts), '%-m/%-d/%Y') AS first_label, strftime(max(log.ts), '%-m/%-d/%Y') AS last_label FROM log) l"""
)
ORACLES["totals_week"] = over_log(totals(WEEK, 200, SPAN_HOURS))
ORACLES["totals_tui"] = over_log(totals(TUI_WEEK, 100, "168"), tui=True)
for _profile, _low in (("web", 200), ("tui", 100)):
    ORACLES[f"success_rate_{_profile}"] = over_log(
        f"""SELECT count(*) FILTER (WHERE status BETWEEN {_low} AND 399) AS success_count, count(*) AS success_total,
        count(*) FILTER (WHERE status BETWEEN {_low} AND 399) / count(*) AS success_rate FROM log"""
    )
ORACLES["success_percent"] = over_log(
    """SELECT count(*) AS total_requests, count(*) FILTER (WHERE status BETWEEN 200 AND 399) AS successful_requests,
    count(*) FILTER (WHERE status BETWEEN 200 AND 399) / count(*) * 100 AS success_rate FROM log"""
)
ORACLES["unique_addresses"] = over_log(
    "SELECT count(DISTINCT ip_address) AS unique_addresses, count(*) AS total_requests FROM log"
)
ORACLES["size_stats"] = over_log(
    "SELECT min(response_size) AS size_min, avg(response_size) AS size_avg, max(response_size) AS size_max FROM log"
)
_bin_label = byte_case("low", lambda x, unit: f"CAST(CAST(floor({x} + 0.5) AS BIGINT) AS STRING) || ' {unit}'")
ORACLES["size_histogram"] = over_log(
    f"""SELECT CAST(bin AS INTEGER) AS bin, {_bin_label} AS label, n FROM labelled""",
    "sorted AS (SELECT response_size AS v, row_number() OVER (ORDER BY response_size) - 1 AS k, count(*) OVER () AS n FROM log WHERE response_size IS NOT NULL)",
    """bounds AS (SELECT min(v) FILTER (WHERE k = CAST(floor(n * 0.1) AS BIGINT)) AS lo,
      min(v) FILTER (WHERE k = CAST(floor(n * 0.95) AS BIGINT)) AS hi FROM sorted)""",
    """binned AS (SELECT CASE WHEN hi - lo <= 500 THEN v - lo WHEN v >= hi THEN 499
      ELSE least(CAST(floor((v - lo) / ((hi - lo) / CAST(500 AS DOUBLE))) AS BIGINT), 499) END AS bin
      FROM sorted, bounds WHERE v BETWEEN lo AND hi)""",
    """labelled AS (SELECT s.bin, CASE WHEN hi - lo <= 500 THEN lo + s.bin ELSE lo + s.bin * ((hi - lo) / CAST(500 AS DOUBLE)) END AS low,
      (SELECT count(*) FROM binned b WHERE b.bin = s.bin) AS n
      FROM bounds, (SELECT unnest(range(501)) AS bin) s WHERE s.bin <= CASE WHEN hi - lo <= 500 THEN hi - lo ELSE 499 END)""",
)

# --- series ----------------------------------------------------------------------------


def bucket(column: str, seconds: str) -> str:
    return f"epoch_us({column}) // 1000000 // {seconds} * {seconds}"


def figures(seconds: str, low: int = 200, where: str = "true") -> str:
    return f"""SELECT {bucket("ts", seconds)} AS b, count(*) AS requests, count(DISTINCT (ip_address, user_agent)) AS users,
      count(*) FILTER (WHERE status BETWEEN {low} AND 399) AS success, count(status) AS total FROM log WHERE {where} GROUP BY 1"""


def series(seconds: str, start: str, end: str, low: int, where: str, none: str) -> list[str]:
    return [
        f"f AS ({figures(seconds, low, where)})",
        f"""slots AS (SELECT unnest(range({bucket(start, seconds)}, {bucket(end, seconds)} + 1, {seconds})) AS b
          FROM (SELECT min(log.ts) AS lo, max(log.ts) AS hi FROM log WHERE {where}))""",
        f"""filled AS (SELECT slots.b, coalesce(requests, 0) AS requests, coalesce(users, 0) AS users,
          coalesce(success, 0) AS success, coalesce(total, 0) AS total,
          CASE WHEN total > 0 THEN success / total ELSE {none} END AS rate FROM slots LEFT JOIN f ON f.b = slots.b)""",
    ]


SERIES = f"""SELECT {ts("make_timestamp(b * 1000000)")} AS bucket, requests, users, success, total, rate,
  requests - users AS other_requests FROM """
NULL = "CAST(NULL AS DOUBLE)"
ORACLES["activity_buckets"] = over_log(
    SERIES + "filled", *series("3600", f"{AS_OF} - INTERVAL 7 DAYS", AS_OF, 200, WEEK, NULL)
)
ORACLES["activity_all_time"] = over_log(SERIES + "filled", *series("86400", "lo", "hi", 200, "true", NULL))
ORACLES["activity_success"] = over_log(
    f"""SELECT {ts("make_timestamp(b * 1000000)")} AS bucket, success, total, rate,
      CAST(CASE WHEN rate = 0 THEN 1 ELSE ceil(rate * 10) END AS INTEGER) AS level FROM filled""",
    *series("21600", f"{AS_OF} - INTERVAL 1 MONTH", AS_OF, 200, MONTH, NULL),
)
# 30 days: 1440 half hours would fit 1500 buckets, 2880 quarter hours would not.
ADAPTIVE = series("1800", "lo", "hi", 100, "true", "CAST(-1 AS DOUBLE)")
ORACLES["adaptive_buckets"] = over_log(SERIES + "filled", *ADAPTIVE, tui=True)
ORACLES["trend_buckets"] = over_log(
    SERIES + f"(SELECT *, success / total AS rate FROM f)", f"f AS ({figures('86400')})"
)
CHUNK = "CAST((row_number() OVER (ORDER BY b) - 1) // CAST(ceil(count(*) OVER () / 6) AS BIGINT) AS INTEGER) AS chunk"
ORACLES["trend_consolidated"] = over_log(
    f"""SELECT chunk, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(users) AS BIGINT) AS users
    FROM (SELECT *, {CHUNK} FROM f) GROUP BY chunk""",
    f"f AS ({figures('86400')})",
)
ORACLES["trend_rates_consolidated"] = over_log(
    f"""SELECT chunk, CAST(sum(success) AS BIGINT) AS success, CAST(sum(total) AS BIGINT) AS total,
    sum(success) / sum(total) AS rate FROM (SELECT *, {CHUNK} FROM f WHERE total > 0) GROUP BY chunk""",
    f"f AS ({figures('86400')})",
)
ENDS = "ends AS (SELECT epoch_us(min(log.ts)) * 1000 AS lo, epoch_us(max(log.ts)) * 1000 AS hi FROM log)"
BINS = "bins AS (SELECT CAST(unnest(range(50)) AS INTEGER) AS bin)"
PLACED_IN_BIN = """inbin AS (SELECT CAST(least((epoch_us(ts) * 1000 - lo) // greatest((hi - lo) // 50, 1), 49) AS INTEGER) AS bin,
  ip_address, user_agent FROM log, ends)"""
for _name, _figure in (("requests", "count(ip_address)"), ("users", "count(DISTINCT (ip_address, user_agent)) FILTER (WHERE ip_address IS NOT NULL)")):
    ORACLES[f"bins50_{_name}"] = over_log(
        f"SELECT bins.bin, {_figure} AS {_name} FROM bins LEFT JOIN inbin USING (bin) GROUP BY 1",
        ENDS, BINS, PLACED_IN_BIN,
    )
ORACLES["bins50_success"] = over_log(
    """SELECT bins.bin, count(s.bin) FILTER (WHERE ok) AS success, count(s.bin) AS total,
      CASE WHEN count(s.bin) > 0 THEN count(s.bin) FILTER (WHERE ok) / count(s.bin) ELSE 0 END AS rate
    FROM bins LEFT JOIN s USING (bin) GROUP BY 1""",
    """grid AS (SELECT epoch_us(min(log.ts)) // 300000000 * 300000000000 AS lo,
      epoch_us(max(log.ts)) // 300000000 * 300000000000 AS hi FROM log)""",
    BINS,
    """s AS (SELECT CAST((epoch_us(ts) * 1000 - lo) // ((hi - lo) // 50) AS INTEGER) AS bin,
      status BETWEEN 100 AND 399 AS ok FROM log, grid)""",
)
ORACLES["downsample"] = over_log(
    """SELECT CAST(c AS INTEGER) AS "column", max(requests) AS requests,
      CASE WHEN max(requests) > 0 THEN arg_max(users, requests * 1000000 - j) ELSE 0 END AS users,
      coalesce(avg(rate) FILTER (WHERE rate >= 0), -1) AS rate
    FROM (SELECT unnest(range(80)) AS c) JOIN points
      ON j >= c * n // 80 AND j < greatest((c + 1) * n // 80, c * n // 80 + 1) GROUP BY c""",
    *ADAPTIVE,
    "points AS (SELECT *, row_number() OVER (ORDER BY b) - 1 AS j, count(*) OVER () AS n FROM filled)",
    tui=True,
)
ORACLES["initial_period_web"] = over_log(
    f"""SELECT CASE WHEN m >= {AS_OF} - INTERVAL 24 HOURS THEN '24 hours' WHEN m >= {AS_OF} - INTERVAL 7 DAYS THEN 'week'
      WHEN m >= {AS_OF} - INTERVAL 1 MONTH THEN 'month' WHEN m >= {AS_OF} - INTERVAL 6 MONTHS THEN '6 months'
      ELSE 'all time' END AS period FROM (SELECT max(log.ts) AS m FROM log)"""
)
ORACLES["initial_period_tui"] = over_log(
    f"""SELECT CASE WHEN m > {AS_OF} - INTERVAL 24 HOURS THEN '24 hours' WHEN m > {AS_OF} - INTERVAL 168 HOURS THEN '1 week'
      WHEN m > {AS_OF} - INTERVAL 720 HOURS THEN '30 days' WHEN m > {AS_OF} - INTERVAL 4320 HOURS THEN '6 months'
      ELSE 'all time' END AS period FROM (SELECT min(log.ts) AS m FROM log)"""
)

# --- export, hosts, streams ----------------------------------------------------------------


def cell(expression: str) -> str:
    return f"CASE WHEN regexp_matches({expression}, '^[=+@-]') THEN '''' || {expression} ELSE {expression} END"


ORACLES["csv_rows"] = over_log(
    f"""SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') AS timestamp, path, method, CAST(status AS STRING) AS status,
    ip_address AS "ipAddress", user_agent AS "userAgent", coalesce(CAST(response_size AS STRING), '') AS "responseSize",
    http_version AS "httpVersion", {cell("referrer")} AS referrer FROM log WHERE {MONTH}"""
)
for _name, _keep, _cpu in (
    ("host_history", 100, "(0.0::DOUBLE + least(value, 100) + CAST(user_id % 100 AS DOUBLE)) / 2"),
    ("host_history_web", 900, "least(value, CAST(100 AS DOUBLE))"),
):
    ORACLES[_name] = f"""WITH s AS (SELECT CAST(user_id % 4 AS STRING) AS host, ts AS t, {_cpu} AS cpu_percent,
      (event_id % 1000) / 1000 * 100 AS memory_percent, (user_id % 500) / 500 * 100 AS disk_percent FROM events)
    SELECT host, {ts("t")} AS ts, cpu_percent, memory_percent, disk_percent, CAST(age_rank AS INTEGER) AS age_rank
    FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY t DESC) AS age_rank FROM s) WHERE age_rank <= {_keep}"""
ORACLES["stream_activity"] = over_log(
    f"""SELECT {ts("make_timestamp(b * 1000000)")} AS bucket, requests, users, success, total, success / total AS rate FROM f""",
    f"f AS ({figures('3600')})",
)
ORACLES["stream_closed_windows"] = over_log(
    f"""SELECT {ts("make_timestamp(b * 1000000)")} AS bucket, requests, users FROM f
    WHERE make_timestamp((b + 3600) * 1000000) <= (SELECT max(log.ts) - INTERVAL 10 MINUTES FROM log)""",
    f"f AS ({figures('3600')})",
)
ORACLES["stream_located"] = over_log(
    f"""SELECT {ts("log.ts")} AS ts, CAST(split_part(ip_address, '.', 3) AS DOUBLE) AS lat,
      CAST(split_part(ip_address, '.', 4) AS DOUBLE) AS lon, status
    FROM log JOIN first USING (ip_address) WHERE log.ts <= first.t + INTERVAL 1 HOUR""",
    "first AS (SELECT ip_address, min(log.ts) AS t FROM log GROUP BY 1)",
)
ORACLES["stream_tail"] = ORACLES["stream_activity"].replace("// 3600 * 3600", "// 86400 * 86400")
ORACLES["geo_nested"] = f"""WITH addresses AS ({fx.NESTED_ADDRESSES}) SELECT ip_address,
  CASE family WHEN 'four' THEN coalesce(n_name, 'EIGHT') WHEN 'six' THEN coalesce(n_name, 'DOC') WHEN 'out' THEN 'ALL' ELSE '' END AS country
  FROM addresses LEFT JOIN nation ON n_nationkey = part"""
ORACLES["stream_errors"] = f"WITH errors_ AS ({fx.ERROR_ROWS}) SELECT level, count(*) AS n FROM errors_ GROUP BY 1"
ORACLES["stream_rotated"] = """SELECT CASE event_id % 3 WHEN 1 THEN 'access.log.1' ELSE 'access.log.2.gz' END AS kind, count(*) AS n
  FROM events WHERE event_id % 3 > 0 GROUP BY 1"""
ORACLES["stream_hosts"] = "SELECT CAST(user_id % 4 AS STRING) AS host, count(*) AS n FROM events GROUP BY 1"
ORACLES["stream_counts"] = over_log("SELECT path, method, status, count(*) AS n FROM log GROUP BY ALL")
ORACLES["stream_table"] = over_log("SELECT CAST(CAST(ts AS DATE) AS STRING) AS log_date, count(*) AS n FROM log GROUP BY 1")

for _part, _same in (
    ("totals", "totals_week"), ("activity", "activity_buckets"), ("trend", "trend_consolidated"), ("sizes", "size_histogram"), ("tui_bins", "bins50_requests"),
):
    ORACLES[f"report_{_part}"] = ORACLES[_same]
ORACLES["lookup_with_duplicates"] = ORACLES["log_with_country"]
ORACLES["sorted_by_time"] = over_log(f"SELECT event_id, {ts('ts')} AS ts FROM log ORDER BY log.ts")

# --- files ---------------------------------------------------------------------------

ORACLES["files_by_size"] = f"{fx.FILE_CATALOG} ORDER BY size DESC, name"
_log = "(extension = '.log' OR regexp_matches(name, '\\.log\\.[0-9]+$'))"
_packed = f"(NOT {_log} AND extension IN ('.gz', '.zip', '.tar'))"
ORACLES["file_summary"] = f"""WITH catalog AS ({fx.FILE_CATALOG})
  SELECT CAST(sum(size) AS BIGINT) AS total_size, CAST(coalesce(sum(size) FILTER {_log}, 0) AS BIGINT) AS log_files_size,
    CAST(coalesce(sum(size) FILTER {_packed}, 0) AS BIGINT) AS compressed_files_size, count(*) AS total_files,
    count(*) FILTER {_log} AS log_files_count, count(*) FILTER {_packed} AS compressed_files_count FROM catalog"""
_access = "CASE event_id % 3 WHEN 0 THEN 'access.log' WHEN 1 THEN 'access.log.1' ELSE 'access.log.2.gz' END"
ORACLES["log_files_read"] = (
    f"""WITH {ACCESS_LINES}, access_ AS (SELECT {_access} AS kind, value FROM lines_),
  errors_ AS ({fx.ERROR_ROWS}), error_ AS (SELECT 'error.log' AS kind, """
    + fx.ERROR_LINE.format(time="strftime(ts, '%Y/%m/%d %H:%M:%S')")
    + """ AS value FROM errors_)
  SELECT kind, count(*) AS n, CAST(sum(length(value)) AS BIGINT) AS chars
  FROM (SELECT * FROM access_ UNION ALL SELECT * FROM error_) both_ GROUP BY kind"""
)


# --- late rows, restarts, rotation, rollups -----------------------------------------

_passed = "(SELECT max(log.ts) - INTERVAL 10 MINUTES FROM log WHERE event_id % 10 < {})"
ORACLES["stream_late"] = over_log(
    f"""SELECT {ts("make_timestamp(b * 1000000)")} AS bucket, requests, users, success, total, success / total AS rate FROM f
    WHERE make_timestamp((b + 3600) * 1000000) <= {_passed.format(10)}""",
    f"f AS ({figures('3600')})",
)
_hour = "date_trunc('hour', log.ts)"
ORACLES["stream_late_rows"] = over_log(
    f"""SELECT event_id, {ts(_hour)} AS bucket FROM log
    WHERE event_id % 10 >= 7 AND {_hour} + INTERVAL 1 HOUR <= CASE event_id % 10
      WHEN 7 THEN {_passed.format(7)} WHEN 8 THEN {_passed.format(8)} ELSE {_passed.format(9)} END"""
)
ORACLES["stream_restarted"] = ORACLES["stream_counts"]
ORACLES["stream_pending"] = over_log(
    f"""SELECT {ts("log.ts")} AS ts, CAST(split_part(ip_address, '.', 3) AS DOUBLE) AS lat, CAST(split_part(ip_address, '.', 4) AS DOUBLE) AS lon, status
    FROM log WHERE CAST(split_part(ip_address, '.', 3) AS INTEGER) < 29 OR CAST(split_part(ip_address, '.', 3) AS INTEGER) % 2 = 0"""
)
ORACLES["stream_rotation"] = over_log("SELECT CAST(CAST(ts AS DATE) AS STRING) AS log_date, status, count(*) AS n FROM log GROUP BY 1, 2")
_cells = f"SELECT '{{}}' AS source, {ts(_hour)} AS bucket, method, path, status, count(*) AS n FROM log WHERE {WEEK} AND method = 'GET' AND {{}} GROUP BY ALL"
ORACLES["rollup_filters"] = over_log(
    _cells.format("cells", "status BETWEEN 200 AND 299 AND path LIKE '%/v1/%'") + " UNION ALL " + _cells.format("rows", "referrer = '-'")
)
ORACLES["rollup_users"] = over_log(
    f"SELECT {ts("date_trunc('day', log.ts)")} AS bucket, count(*) AS requests, count(DISTINCT (ip_address, user_agent)) AS users, true AS close FROM log GROUP BY 1"
)
ORACLES["rollup_sizes"] = over_log(
    "SELECT CAST(unnest([0.1, 0.25, 0.5, 0.75, 0.95]) AS DOUBLE) AS share, true AS close FROM (SELECT 1 FROM log LIMIT 1) one"
)


# --- named files, catalogs, layouts without fields --------------------------------

_error_lines = f"errors_ AS ({fx.ERROR_ROWS}), error_ AS (SELECT event_id, " + fx.ERROR_LINE.format(time="strftime(ts, '%Y/%m/%d %H:%M:%S')") + " AS value FROM errors_)"
_named = f"""WITH {ACCESS_LINES}, {_error_lines}, named AS (
  SELECT 'access' AS kind, event_id % 3 AS part, value FROM lines_ UNION ALL SELECT 'error' AS kind, event_id % 3 AS part, value FROM error_)"""
ORACLES["log_file_read"] = f"WITH {ACCESS_LINES} SELECT value, 'access-1.log' AS source_file FROM lines_ WHERE event_id % 3 = 1"
ORACLES["named_files_read"] = f"""{_named} SELECT kind, concat(kind, '-', part, '.log') AS source_file, count(*) AS n, CAST(sum(length(value)) AS BIGINT) AS chars
  FROM named WHERE (kind = 'error') = (part = 1) GROUP BY kind, part"""
ORACLES["log_catalog"] = f"""{_named}, sized AS (SELECT concat(kind, '-', part, '.log') AS name, CAST(sum(length(value) + 1) AS BIGINT) AS size FROM named GROUP BY kind, part)
  SELECT name, size, '.log' AS extension FROM sized UNION ALL SELECT 'all', CAST(sum(size) AS BIGINT), '' FROM sized"""
ORACLES["parse_fallback_format"] = over_log(f"SELECT event_id, ip_address, {ts('ts')} AS ts, method, path, status, referrer FROM log")
ORACLES["parse_without_address"] = over_log(
    "SELECT 'web' AS profile, count(*) AS n, count(*) AS nameless FROM log UNION ALL SELECT 'tui', CAST(0 AS BIGINT), CAST(0 AS BIGINT)"
)
_limited = "least(value, CAST(100 AS DOUBLE))"
ORACLES["host_samples_read"] = f"""WITH disks AS (
    SELECT 0 AS disk_number, 'tmp' AS filesystem, 10 AS size, '/tmp' AS mounted_on UNION ALL SELECT 1, 'root', 500, '/')
  SELECT CAST(user_id % 4 AS STRING) AS host, event_id AS uptime, {ts("ts")} AS timestamp, 'm' AS model, 2 AS cores, CAST(2.5 AS DOUBLE) AS speed, {_limited} AS usage,
    {_limited} AS core_0, CAST(user_id % 100 AS DOUBLE) AS core_1, 1000 - event_id % 1000 AS free, 1000 - event_id % 1000 AS available, event_id % 1000 AS used,
    CAST(1000 AS BIGINT) AS total, CAST(disk_number AS INTEGER) AS disk_number, filesystem, CAST(size AS BIGINT) AS size,
    CASE disk_number WHEN 0 THEN CAST(1 AS BIGINT) ELSE user_id % 500 END AS disk_used, mounted_on FROM events, disks"""
ORACLES["networks_read"] = over_log(
    """SELECT ip_address, coalesce(n_name, '') AS country, CASE source WHEN 'city' THEN coalesce(lower(n_name), '') ELSE '' END AS city,
      CASE WHEN source = 'city' AND n_name IS NOT NULL THEN CAST(1.5 AS DOUBLE) END AS lat, CASE WHEN source = 'city' AND n_name IS NOT NULL THEN CAST(-2.5 AS DOUBLE) END AS lon, source
    FROM (SELECT DISTINCT ip_address FROM log) a LEFT JOIN nation ON n_nationkey = CAST(split_part(ip_address, '.', 3) AS INTEGER), (SELECT unnest(['city', 'country']) AS source) s"""
)
ORACLES["report_trend_rates"] = ORACLES["trend_rates_consolidated"]
ORACLES["report_success_bins"] = ORACLES["bins50_success"]
for _part in ("counts", "totals", "activity", "trend", "trend_rates", "sizes"):
    ORACLES[f"report_{_part}_staged"] = ORACLES[f"report_{_part}"]
ORACLES["stream_backfill"] = ORACLES["stream_table"]


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
