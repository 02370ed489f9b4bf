"""Check queries in plain SQL for DuckDB, one per registered query.

Written from the rules, row by row and without the shortcuts of the Spark side: texts
are tested one by one, near events are found by a plain join, bursts by recursion.
"""

import re

from logsieve import rules
from workload import templates as W

FAMILIES = [
    ("sqli", rules.SQLI), ("xss", rules.XSS), ("traversal", rules.TRAVERSAL),
    ("cmdi", rules.CMDI), ("ua", rules.AUTOMATION_UA),
]
SIGNATURES = [(f, n, p, pts) for f, sigs in FAMILIES for n, p, pts in sigs]
PATTERN = {(f, n): p for f, n, p, _ in SIGNATURES}
SCRIPT = PATTERN["xss", "script_tag"]
JS = PATTERN["xss", "javascript_uri"]
COMMENT = PATTERN["sqli", "sql_comment"]
QUOTE_END = PATTERN["sqli", "quote_termination"]


_CLASS = re.compile(r"(\[\^\\s[^\]]*\])")


def s(v) -> str:
    if v is None:
        return "NULL"
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def rx(x: str, pattern: str) -> str:
    # RE2's white space lacks U+000B and U+001C to U+001F
    more = r"\x0b\x1c-\x1f"
    wide = pattern.replace(r"[^\s", r"[^\s" + more)
    wide = "".join(part if k % 2 else part.replace(r"\s", rf"[\s{more}]") for k, part in enumerate(_CLASS.split(wide)))
    return f"regexp_matches({x}, {s('(?i)' + wide)})"


def dec(x: str) -> str:
    return f"url_decode(replace({x}, '+', ' '))"


def norm(x: str) -> str:
    return f"trim({dec(f'coalesce({x}, {s(chr(39)*0)})')})"


def has_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {s(w)})" for w in words) + ")"


def any_of(lst: str, test) -> str:
    return f"(len(list_filter({lst}, lambda s_: {test('s_')})) > 0)"


def uniq(lst: str) -> str:
    return f"list_filter({lst}, lambda x_, i_: x_ <> '' AND list_position({lst}, x_) = i_)"


def compact(items) -> str:
    return "list_filter([" + ", ".join(items) + "], lambda x_: x_ IS NOT NULL)"


def label(cond: str, text: str) -> str:
    return f"CASE WHEN {cond} THEN {text if text.startswith('(') else s(text)} END"


def joined(lst: str) -> str:
    return f"coalesce(array_to_string(list_sort(list_distinct({lst})), ','), '')"


def flag(x: str) -> str:
    return f"CASE WHEN {x} THEN 1 ELSE 0 END"


def strip_ent(x: str) -> str:
    return f"regexp_replace({x}, {s('(?i)' + rules.HTML_ENTITY)}, '', 'g')"


def unescape(x: str) -> str:
    ents = f"list_distinct(regexp_extract_all({x}, {s('(?i)' + rules.HTML_ENTITY)}))"
    code = (
        "CASE WHEN lower(e_[3:3]) = 'x' THEN ('0x' || e_[4:-2])::INT ELSE (e_[3:-2])::INT END"
    )
    return f"list_reduce({ents}, lambda a_, e_: replace(a_, e_, chr({code})), {x})"


def family(uri: str) -> str:
    n = f"lower({norm(uri)})"
    path = f"CASE WHEN contains({uri}, '?') THEN split_part({n}, '?', 1) ELSE {n} END"
    parts = f"list_filter(string_split({path}, '/'), lambda g_: g_ <> '')[1:3]"
    one = "CASE WHEN regexp_full_match(g_, '[0-9a-f]{6,}|[0-9]+') THEN '{id}' ELSE g_ END"
    return f"'/' || array_to_string(list_transform({parts}, lambda g_: {one}), '/')"


def ratio_at_least(q: str, pct: int) -> str:
    special = f"len(regexp_replace({q}, '[^''\"`;=#()/*,<>%-]', '', 'g'))"
    return f"(len({q}) > 0 AND {special} * 100 >= len({q}) * {pct})"


def under(p: str, prefixes) -> str:
    return "(" + " OR ".join(f"{p} = {s(x)} OR starts_with({p}, {s(x + '/')})" for x in prefixes) + ")"


def segs(p: str) -> str:
    return f"list_filter(string_split({p}, '/'), lambda g_: g_ <> '')"


def hidden(p: str) -> str:
    return f"(len(list_filter({segs(p)}, lambda g_: starts_with(g_, '.') AND g_ <> '.well-known')) > 0)"


def sensitive(p: str) -> str:
    inside = ", ".join(s(x) for x in rules.BURST_PATH_SEGMENT)
    suffix = " OR ".join(f"ends_with({p}, {s(x)})" for x in rules.BURST_PATH_SUFFIX)
    return (
        f"({hidden(p)} OR {under(p, rules.BURST_PATH_PREFIX)} OR {suffix} OR "
        f"len(list_filter({segs(p)}, lambda g_: g_ IN ({inside}))) > 0)"
    )


def probe_hints(p: str) -> str:
    return compact(
        [
            label(f"{p} <> ''", "dir_probe:burst"),
            label(f"{p} <> '' AND {sensitive(p)}", "dir_probe:sensitive_path"),
            label(f"{p} IN ('/config.php', '/admin/config.php')", "dir_probe:sensitive_config_path"),
            label(f"{p} = '/config.php'", "file_probe:config_php"),
            label(f"{p} = '/admin/config.php'", "file_probe:admin_config_php"),
            label(under(p, rules.BURST_ADMIN_PREFIX), "dir_probe:admin_path"),
        ]
    )


def burst_probe(p: str, q: str) -> str:
    return f"({p} <> '' AND {p} <> '/' AND ({sensitive(p)} OR {has_any(q, rules.DIR_PROBE_FILE)}))"


def local(ts: str, fmt: str, tail: str) -> str:
    return f"strftime({ts} + INTERVAL 9 HOUR, {s(fmt)}) || {s(tail)}"


# --------------------------------------------------------------- the request log

_ATT = ", ".join(
    "(" + ", ".join([str(i)] + [s(v) for v in row]) + ")" for i, row in enumerate(W.ATTACKS)
)
_PRB = ", ".join(f"({i}, {s(p)})" for i, p in enumerate(W.PROBES))

LOG = f"""
att(i, a_method, a_target, a_uri, a_query, a_status, a_reqct, a_respct, a_bytes, a_agent) AS (VALUES {_ATT}),
prb(i, p_path) AS (VALUES {_PRB}),
ev0 AS (SELECT event_id AS ev, user_id, value, event_id % (SELECT count(*) FROM pages) AS pk FROM events),
ev1 AS (
  SELECT ev0.*, att.*, prb.p_path, (ev // 64) % 4 AS phase,
    regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS page_path,
    regexp_extract(url, '([?][^#]*)', 1) AS page_query
  FROM ev0 JOIN pages ON page_id = pk JOIN att ON att.i = ev % {len(W.ATTACKS)}
  JOIN prb ON prb.i = ev % {len(W.PROBES)}),
ev2 AS (
  SELECT *, CASE phase WHEN 1 THEN a_target WHEN 3 THEN p_path ELSE page_path END AS path,
    CASE phase WHEN 1 THEN a_query WHEN 3 THEN '' ELSE page_query END AS qs,
    CASE WHEN phase = 1 THEN a_method ELSE 'GET' END AS method,
    CASE WHEN phase = 1 AND a_agent = 'browser' THEN {s(W.BROWSER)}
         WHEN phase = 1 AND a_agent IS NOT NULL THEN a_agent
         WHEN ev % 4 = 2 THEN 'curl/8.5.0'
         WHEN ev % 4 = 3 AND phase = 1 THEN 'sqlmap/1.8' ELSE {s(W.BROWSER)} END AS user_agent,
    CASE WHEN ev % 13 = 0 THEN 404 WHEN ev % 17 = 0 THEN 500 WHEN phase = 1 THEN a_status ELSE 200 END AS status_code,
    CASE WHEN phase = 3 AND ev % 4 = 0 THEN 75002 WHEN phase = 1 AND a_bytes IS NOT NULL THEN a_bytes
         ELSE floor(value * 100)::BIGINT END AS response_body_bytes,
    CASE WHEN ev % 3 <> 0 THEN 'http://shop.example/' END AS referer
  FROM ev1),
log AS (
  SELECT ev + 1 AS id, make_timestamp(({W.START_MS} + ev * 2000) * 1000) AS log_time,
    CASE WHEN ev % 7 = 0 THEN NULL WHEN ev % 53 = 2 THEN '-' WHEN ev % 59 = 3 THEN 'null' WHEN ev % 97 = 5 THEN 'rqhot'
      WHEN ev % 50 = 11 THEN 'rqs' || (ev // 2000) ELSE 'rq' || ev END AS request_id,
    CASE WHEN ev % 11 = 0 THEN 'el' || ev END AS error_link_id,
    '10.1.' || ((ev // 6400) % 250) || '.' || (user_id % 6 + 1) AS src_ip, method,
    method || ' ' || path || qs || ' HTTP/1.1' AS raw_request,
    CASE WHEN phase = 1 AND a_uri IS NOT NULL THEN a_uri ELSE path END AS uri, path AS target_path,
    qs AS query_string, status_code, response_body_bytes,
    floor(value * 10000)::BIGINT AS duration_us, floor(value * 6000)::BIGINT AS ttfb_us,
    CASE WHEN phase = 1 THEN a_reqct END AS req_content_type,
    coalesce(CASE WHEN phase = 1 THEN a_respct END, 'text/html') AS resp_content_type,
    referer, user_agent
  FROM ev2),
log2 AS (
  SELECT *, src_ip || ' - - [' || strftime(log_time + INTERVAL 9 HOUR, '%d/%b/%Y:%H:%M:%S') || ' +0900] "'
    || raw_request || '" ' || status_code || ' ' || response_body_bytes || ' "' || coalesce(referer, '-')
    || '" "' || user_agent || '" "shop.example" main' AS raw_log FROM log)"""


def canon(sources: str) -> str:
    """Canonical rows of the named sources in order."""
    parts = []
    for pos, name in enumerate(sources.split(",")):
        if name == "error":
            text = norm("'[core] AH00128: File does not exist: /srv/www' || uri")
            parts.append(
                f"SELECT 'error' AS source_table, {pos} AS pos, id, log_time, src_ip, '-' AS method, "
                "'' AS uri, '' AS query_raw, '' AS query, '' AS raw_request, '' AS request_text, "
                "0 AS status_code, 0 AS response_body_bytes, 0 AS duration_us, 0 AS ttfb_us, "
                "'' AS req_content_type, '' AS resp_content_type, '' AS user_agent, '' AS referer, "
                f"coalesce(request_id, '') AS request_id, coalesce(error_link_id, '') AS error_link_id, "
                f"{text} AS log_text, '' AS target FROM log2 WHERE (id - 1) % 9 = 0"
            )
            continue
        sec = name == "security"
        target = "regexp_extract(raw_request, '^[^ ]+ (.*) HTTP/[^ ]*$', 1)"

        def only(x: str, other: str) -> str:
            return x if sec else other

        parts.append(
            f"SELECT {s(name)}, {pos}, id, log_time, src_ip, method, {norm('uri')}, query_string, "
            f"{norm('query_string')}, raw_request, {norm('raw_request')}, status_code, "
            f"response_body_bytes, {only('duration_us', '0')}, {only('ttfb_us', '0')}, "
            + only("coalesce(req_content_type, '')", "''") + ", "
            + only("resp_content_type", "''") + f", {norm('user_agent')}, {norm('referer')}, "
            + only("coalesce(request_id, '')", "''") + ", "
            + only("coalesce(error_link_id, '')", "''")
            + f", {norm('raw_log')}, {target} FROM log2"
            + only("", " WHERE (id - 1) % 5 = 0")
        )
    first = "source_table, pos, id, log_time, src_ip, method, uri, query_raw, query, raw_request, request_text, status_code, response_body_bytes, duration_us, ttfb_us, req_content_type, resp_content_type, user_agent, referer, request_id, error_link_id, log_text, target"
    return f"req({first}) AS (" + " UNION ALL ".join(parts) + ")"


def texts() -> str:
    ent = rules.HTML_ENTITY
    def forms(k: str) -> str:
        own = f"list_filter([{k}0, trim({k}1), trim({k}2)], lambda x_: x_ IS NOT NULL)"
        got = f"list_transform(list_filter({own}, lambda y_: {rx('y_', ent)}), lambda y_: trim({unescape('y_')}))"
        return f"list_filter({got}, lambda z_, i_: z_ <> '' AND NOT list_contains({own}, z_) AND list_position({got}, z_) = i_)"
    return f"""
t0 AS (SELECT *, nullif(query_raw, '') AS q0, nullif(target, '') AS t0 FROM req),
t1 AS (SELECT *, nullif({dec('q0')}, q0) AS q1, nullif({dec('t0')}, t0) AS t1 FROM t0),
t2 AS (SELECT *, nullif({dec('q1')}, q1) AS q2, nullif({dec('t1')}, t1) AS t2 FROM t1),
t3 AS (SELECT *, {forms('q')} AS qe, {forms('t')} AS te,
  list_filter([raw_request, request_text, {norm('uri')}, query_raw, query, target, log_text], lambda x_: x_ IS NOT NULL) AS b0 FROM t2),
t4 AS (SELECT *, list_filter([trim(q1), trim(q2)] || qe || [trim(t1), trim(t2)] || te, lambda x_: x_ IS NOT NULL) AS e0 FROM t3),
t5 AS (SELECT *, array_to_string({uniq('b0')}, ' ') AS base_text, array_to_string({uniq('e0')}, ' ') AS extra FROM t4),
tx AS (SELECT *, CASE WHEN extra IN ('', base_text) THEN base_text WHEN base_text = '' THEN extra ELSE base_text || ' ' || extra END AS combined,
  list_filter([q0, t0], lambda x_: x_ IS NOT NULL) AS d0,
  list_filter([trim(q1), trim(t1)], lambda x_: x_ IS NOT NULL) AS d1,
  list_filter([trim(q2), trim(t2)], lambda x_: x_ IS NOT NULL) AS d2 FROM t5),
ty AS (SELECT *, [combined] || d0 || d1 || d2 || qe || te AS samples FROM tx)"""


def sig(fam: str, name: str, x: str, strip=True) -> str:
    if name == "sql_comment" and strip:
        x = strip_ent(x)
    return rx(x, PATTERN[fam, name])


def attack(x: str, fams=("sqli", "xss", "traversal", "cmdi"), strip=True) -> str:
    return "(" + " OR ".join(sig(f, n, x, strip) for f, n, _, _ in SIGNATURES if f in fams) + ")"


_HEAVY = has_any("lower(uri)", rules.QUERY_HEAVY_URI)
_LOGIN = has_any("lower(uri)", rules.LOGIN_URI)
_BROWSER = has_any("lower(user_agent)", rules.BROWSER_UA)
_JSON = "(starts_with(lower({0}), 'application/json') OR ends_with(lower({0}), '+json'))"
_STATIC = "(" + " OR ".join(
    [f"ends_with(lower(uri), {s(x)})" for x in rules.STATIC_SUFFIX]
    + [f"starts_with(lower(uri), {s(x)})" for x in rules.STATIC_PREFIX]
) + ")"
_JOINED = "lower(concat_ws(' ', uri, request_text, query))"
EARLY = f"""CASE WHEN source_table IN ('access', 'security') AND starts_with(lower(uri), '/socket.io/') AND status_code = 200
  AND error_link_id = '' AND NOT {attack(_JOINED, strip=False)}
  AND (contains({_JOINED}, 'transport=polling') OR contains({_JOINED}, 'eio=')) AND {_BROWSER} THEN 'socketio_polling'
  WHEN source_table = 'access' AND {_STATIC} AND status_code = 200 THEN 'static_asset' END"""
_PATH_OF = f"split_part({norm('target')}, '?', 1)"
_EFF = f"coalesce(nullif({_PATH_OF}, ''), {norm('uri')})"
_LEARN_SQL = has_any(f"lower({norm('query')})", rules.LEARNING_SQL_TERMS)


def learn_xss(x: str) -> str:
    low = f"lower({norm(x)})"
    terms = [t.replace(" ", r"\s+") for t in rules.LEARNING_XSS_TERMS if t.isascii()]
    other = [t for t in rules.LEARNING_XSS_TERMS if not t.isascii()]
    worded = f"regexp_matches({low}, {s(r'(^|[^0-9A-Za-z_./-])(' + '|'.join(terms) + r')($|[^0-9A-Za-z_./-])')})"
    return f"(({worded} OR {has_any(low, other)}) AND {has_any(low, rules.LEARNING_XSS_KEYWORDS)})"


def join2(a: str, b: str) -> str:
    return f"CASE WHEN {b} IN ('', {a}) THEN {a} WHEN {a} = '' THEN {b} ELSE {a} || ' ' || {b} END"


def mixed(x: str) -> str:
    tags = f"regexp_extract_all({x}, '(?i)<\\s*([a-z]+)\\b', 1)"
    return f"(len(list_filter({tags}, lambda g_: lower(g_) = 'script' AND g_ NOT IN ('script', 'SCRIPT'))) > 0)"


_C2 = f"[combined, {norm('combined')}]"
SQL_STRUCTURE = {
    "quote_termination": any_of(_C2, lambda x: rx(x, QUOTE_END)),
    "sql_comment": any_of(_C2, lambda x: rx(strip_ent(x), COMMENT)),
    "xclose": any_of(_C2, lambda x: rx(x, rules.XCLOSE)),
    "boolean_condition": any_of(_C2, lambda x: rx(x, rules.BOOLEAN_CONDITION)),
    "union_column_list": any_of(_C2, lambda x: rx(x, rules.UNION_COLUMN_LIST)),
    "schema_access": any_of(_C2, lambda x: rx(x, rules.SCHEMA_ACCESS)),
    "from_users": any_of(_C2, lambda x: rx(x, rules.FROM_USERS)),
}
XSS_STRUCTURE = {
    "script_tag": any_of("samples", lambda x: rx(x, SCRIPT)),
    "mixed_case_script_tag": any_of("samples", mixed),
    "event_handler_assignment": any_of("samples", lambda x: rx(x, rules.EVENT_HANDLER_ASSIGNMENT)),
    "javascript_protocol": any_of("samples", lambda x: rx(x, JS)),
    "browser_data_access": any_of("samples", lambda x: rx(x, rules.BROWSER_DATA_ACCESS)),
    "external_navigation": any_of("samples", lambda x: rx(x, rules.EXTERNAL_NAVIGATION)),
    "quote_breakout": any_of("samples", lambda x: rx(x, rules.QUOTE_BREAKOUT)),
    "html_entity_decoded_script": any_of("(qe || te)", lambda x: rx(x, SCRIPT)),
}
_HANDLERS = (
    "list_transform(list_distinct(flatten(list_transform([query] || samples, lambda x_: "
    f"regexp_extract_all(lower(x_), {s('(?i)' + rules.EVENT_HANDLER_ASSIGNMENT)}, 1)))), "
    "lambda n_: 'xss:event_handler:' || n_)"
)
_REACH = f"{XSS_STRUCTURE['browser_data_access']} AND ({XSS_STRUCTURE['external_navigation']} OR {any_of('samples', lambda x: rx(x, rules.EXTERNAL_URL))})"
XSS_HINTS = "(" + compact(
    [
        label(XSS_STRUCTURE["script_tag"], "xss:script_tag"),
        label(XSS_STRUCTURE["mixed_case_script_tag"], "xss:mixed_case_script_tag"),
        label(XSS_STRUCTURE["event_handler_assignment"], "xss:event_handler"),
        label(XSS_STRUCTURE["javascript_protocol"], "xss:javascript_protocol"),
        label(XSS_STRUCTURE["browser_data_access"], "xss:browser_data_access"),
        label(any_of("samples", lambda x: rx(x, r"document\.cookie")), "xss:document_cookie"),
        label(XSS_STRUCTURE["external_navigation"], "xss:external_navigation"),
        label(
            f"{XSS_STRUCTURE['html_entity_decoded_script']} AND ({rx('query_raw', rules.HTML_ENTITY)} OR {rx('target', rules.HTML_ENTITY)})",
            "xss:html_entity_encoded",
        ),
        label(XSS_STRUCTURE["html_entity_decoded_script"], "xss:html_entity_decoded_script"),
        label(_REACH, "xss:external_exfil_intent"),
    ]
) + f" || {_HANDLERS})"
_FD = {n: any_of("samples", lambda x, p=p: rx(x, p)) for n, p, _ in rules.FILE_DISCLOSURE}
_FD_CTX = "(fd_php_filter_wrapper OR fd_base64_source_filter OR fd_resource_parameter)"


def hits() -> str:
    scan = "CASE WHEN early IS NULL THEN combined END"
    cols = []
    for f, n, p, _ in SIGNATURES:
        x = "user_agent" if f == "ua" else "combined" if f == "traversal" else "scan"
        cols.append(f"coalesce({sig(f, n, x)}, false) AS h_{f}_{n}")
    def count(f):
        return " + ".join(f"h_{g}_{n}::INT" for g, n, _, _ in SIGNATURES if g == f)
    fd = ", ".join(f"{v} AS fd_{n}" for n, v in _FD.items())
    return f"""
h0 AS (SELECT *, {EARLY} AS early FROM ty),
h1 AS (SELECT *, {scan} AS scan, {_BROWSER} AS browser, {_LOGIN} AS login, {_HEAVY} AS heavy, lower({_EFF}) AS probe_path,
  {_PATH_OF} AS target_only,
  list_sort(list_distinct(list_filter({PARAMS}, lambda n_: len(list_filter({PARAMS}, lambda m_: m_ = n_)) >= 2))) AS hpp FROM h0),
h2 AS (SELECT *, {', '.join(cols)}, {fd},
  {any_of('d0', attack)} AS at0, {any_of('d1', attack)} AS at1, {any_of('d2', attack)} AS at2,
  {any_of('d1', lambda x: attack(x, ('sqli',)))} AS sq1, {any_of('d2', lambda x: attack(x, ('sqli',)))} AS sq2 FROM h1),
hx AS (SELECT *, {', '.join(f'{count(f)} AS {f}_hits' for f, _ in FAMILIES)} FROM h2)"""


PARAMS = (
    "list_filter(list_transform(list_filter(string_split(regexp_replace(query, '^[?]', ''), '&'), lambda x_: x_ <> ''), "
    f"lambda x_: {norm(norm(chr(115) + 'plit_part(x_, ' + s('=') + ', 1)'))}), lambda x_: x_ <> '')"
)

ENC_HINTS = compact(
    [
        label("(at1 OR at2) AND NOT at0", "encoding:url_encoded_payload"),
        label("at2", "encoding:double_decoded_payload"),
        label("at2", "encoding:decoded_depth_2"),
        label("sq2", "encoding:double_decoded_sqli"),
        label("len(qe || te) > 0", "encoding:html_entity_payload"),
        label("len(qe || te) > 0", "encoding:html_entity_decoded"),
        label(any_of("(qe || te)", lambda x: attack(x, ("xss",))), "encoding:html_entity_decoded_xss"),
    ]
)
FD_HINTS = compact(
    [
        label("fd_php_filter_wrapper", "file_disclosure:php_filter_wrapper"),
        label("fd_base64_source_filter", "file_disclosure:base64_source_intent"),
        label("fd_resource_parameter", "file_disclosure:resource_parameter"),
        label(f"{_FD_CTX} AND fd_admin_config_php", "file_disclosure:sensitive_resource:admin_config_php"),
        label(f"{_FD_CTX} AND fd_config_php AND NOT fd_admin_config_php", "file_disclosure:sensitive_resource:config_php"),
        label(f"{_FD_CTX} AND fd_index_php", "file_disclosure:sensitive_resource:index_php"),
        label(any_of("d2", lambda x: rx(x, rules.PHP_FILTER)), "encoding:double_decoded_php_wrapper"),
    ]
)
_PTS = {n: p for n, _, p in rules.FILE_DISCLOSURE}
FD_POINTS = (
    f"(CASE WHEN fd_php_filter_wrapper THEN {_PTS['php_filter_wrapper']} ELSE 0 END"
    f" + CASE WHEN fd_base64_source_filter THEN {_PTS['base64_source_filter']} ELSE 0 END"
    f" + CASE WHEN fd_resource_parameter THEN {_PTS['resource_parameter']} ELSE 0 END"
    f" + CASE WHEN {_FD_CTX} AND fd_admin_config_php THEN {_PTS['admin_config_php']} WHEN {_FD_CTX} AND fd_config_php THEN {_PTS['config_php']} ELSE 0 END"
    f" + CASE WHEN {_FD_CTX} AND fd_index_php THEN {_PTS['index_php']} ELSE 0 END)"
)
_SET = "({})".format(", ".join(str(x) for x in rules.ERROR_STATUSES))
_WORDS = rx(
    f"concat_ws(' ', {norm('user_agent')}, {norm('request_text')}, {norm('log_text')}, {norm('query')})",
    rules.AUTH_ATTACK_WORDS,
)
_BODY = "lower(req_content_type) IN (" + ", ".join(s(x) for x in rules.AUTH_BODY_TYPES) + ")"
TERMS = [
    ("len(query) >= 40", 1, "long_query(+1)"),
    ("len(query) >= 80", 1, "very_long_query(+1)"),
    (ratio_at_least("query", 15), 1, "special_char_ratio_high(+1)"),
    (ratio_at_least("query", 30), 1, "special_char_ratio_very_high(+1)"),
    (f"status_code IN {_SET}", 2, "('error_status:' || status_code || '(+2)')"),
    ("error_link_id <> ''", 2, "error_linked(+2)"),
    ("duration_us >= 2000000", 3, "high_duration(+3)"),
    ("duration_us >= 5000000", 2, "very_high_duration(+2)"),
    ("ttfb_us >= 2000000", 2, "high_ttfb(+2)"),
    ("login", 1, "login_endpoint(+1)"),
    (f"heavy AND query <> '' AND {rx('query', rules.QUERY_ATTACK_TOKENS)}", 2, "query_endpoint_with_attack_tokens(+2)"),
    (f"{_BODY} AND login", 1, "auth_payload_content_type(+1)"),
    ("referer = '' AND NOT browser AND status_code >= 400", 1, "no_referer_non_browser_error(+1)"),
    ("login_ok AND words", 2, "login_success_json_response(+2)"),
    ("login_ok AND words", 1, "possible_auth_bypass_success(+1)"),
    ("login_ok AND referer = '' AND NOT browser AND (words OR ua_hits > 0)", 1, "no_referer_non_browser_login(+1)"),
    ("source_table = 'error'", 2, "error_table_context(+2)"),
    ("len(hpp) > 0", 1, "hpp:duplicate_param_names(+1)"),
]


def scored() -> str:
    sig_pts = " + ".join(f"CASE WHEN h_{f}_{n} THEN {p} ELSE 0 END" for f, n, _, p in SIGNATURES)
    terms = " + ".join(f"CASE WHEN {cnd} THEN {p} ELSE 0 END" for cnd, p, _ in TERMS)
    ss = ", ".join(f"(edu_sql AND {v}) AS ss_{n}" for n, v in SQL_STRUCTURE.items())
    xs = ", ".join(f"(edu_xss AND {v}) AS xs_{n}" for n, v in XSS_STRUCTURE.items())
    strong_sql = " OR ".join(f"ss_{n}" for n in SQL_STRUCTURE if n != "from_users")
    strong_xss = " OR ".join(f"xs_{n}" for n in XSS_STRUCTURE if n != "script_tag")
    ctn = "lower(resp_content_type)"
    hidden_ = hidden("probe_path")
    clean = "(sqli_hits + xss_hits + cmdi_hits = 0)"
    fallback = f"(html_fallback AND traversal_hits = 1 AND {clean} AND error_link_id = '')"
    return f"""
s0 AS (SELECT *, (sqli_hits > 0 AND {_LEARN_SQL}) AS edu_sql, (xss_hits > 0 AND {learn_xss(join2('query', 'target'))}) AS edu_xss,
  (traversal_hits > 0 AND target_only <> '' AND {norm('uri')} <> '' AND target_only <> {norm('uri')}) AS path_norm,
  (traversal_hits > 0 AND status_code = 200 AND starts_with({ctn}, 'text/html') AND response_body_bytes >= 10000) AS html_fallback,
  (login AND method = 'POST' AND status_code = 200 AND {_JSON.format('req_content_type')} AND {_JSON.format('resp_content_type')} AND response_body_bytes >= 300) AS login_ok,
  {_WORDS} AS words FROM hx),
s1 AS (SELECT *, {ss}, {xs}, (traversal_hits > 0 AND NOT html_fallback AND status_code = 200 AND (starts_with({ctn}, 'text/plain') OR contains({ctn}, 'octet-stream'))) AS file_like FROM s0),
s2 AS (SELECT *, ({strong_sql}) AS strong_sql, ({strong_xss}) AS strong_xss, {sig_pts} + {FD_POINTS} + {terms} AS raw_score FROM s1),
s3 AS (SELECT *, CASE WHEN edu_sql AND NOT strong_sql THEN greatest(0, raw_score - CASE WHEN ss_from_users THEN 2 ELSE 4 END) ELSE raw_score END AS score1 FROM s2),
s4 AS (SELECT *, CASE WHEN edu_xss AND NOT strong_xss THEN greatest(0, score1 - 4) ELSE score1 END AS score FROM s3),
s5 AS (SELECT *,
  CASE WHEN early IS NOT NULL OR {fallback} THEN NULL
    WHEN edu_sql AND NOT strong_sql THEN CASE WHEN score >= 4 THEN 'possible_false_positive_sql_keyword_search' END
    WHEN edu_xss AND NOT strong_xss THEN CASE WHEN score >= 4 THEN 'possible_false_positive_xss_keyword_search' END
    WHEN xss_hits > 0 AND score >= 7 THEN 'xss' WHEN sqli_hits > 0 AND score >= 7 THEN 'sqli'
    WHEN traversal_hits > 0 AND score >= 6 THEN 'path_traversal' WHEN cmdi_hits > 0 AND score >= 6 THEN 'command_injection'
    WHEN fd_php_filter_wrapper AND score >= 6 THEN 'suspicious_file_disclosure'
    WHEN login_ok AND score >= 4 THEN 'suspicious_auth_success'
    WHEN score >= 4 AND NOT (probe_path IN ('/config.php', '/admin/config.php') AND NOT fd_php_filter_wrapper) THEN 'suspicious' END AS verdict,
  CASE WHEN early IS NOT NULL THEN early WHEN {fallback} THEN 'benign_fallback_html'
    WHEN method IN ('GET', 'HEAD', 'OPTIONS') AND {clean} AND NOT heavy AND len(query) < 20 AND probe_path NOT IN ('', '/')
      AND ({hidden_} OR {has_any('probe_path', rules.DIR_PROBE_PATH)} OR {has_any('probe_path', rules.DIR_PROBE_FILE)}
        OR (traversal_hits = 1 AND (status_code IN (401, 403, 404, 405) OR path_norm OR html_fallback)))
      AND (status_code IN (301, 302, 401, 403, 404, 405) OR html_fallback OR (status_code = 200 AND NOT browser AND referer = ''))
      THEN 'low_signal_dir_probe'
    WHEN {clean} AND traversal_hits = 0 AND error_link_id = '' AND method IN ('GET', 'HEAD') AND status_code IN (200, 204, 304, 404)
      AND browser AND query <> '' AND (heavy OR status_code IN (200, 304) OR referer <> '') THEN 'benign_normal_search'
    WHEN error_link_id = '' AND NOT (heavy AND browser AND {clean} AND traversal_hits = 0)
      AND (CASE WHEN NOT {clean} THEN 2 WHEN traversal_hits > 0 THEN 1 ELSE 0 END + (len(query) >= 20)::INT
        + {ratio_at_least('query', 15)}::INT + (len(hpp) > 0)::INT + (NOT browser)::INT
        + (referer = '' AND status_code >= 400)::INT + (method NOT IN ('GET', 'POST', 'HEAD', 'OPTIONS'))::INT) >= 2 THEN 'low_signal_fuzzing'
    WHEN browser THEN 'benign_normal_search' ELSE 'low_signal_fuzzing' END AS noise,
  CASE WHEN len(hpp) = 0 THEN '' WHEN sqli_hits > 0 AND xss_hits > 0 THEN 'multiple' WHEN sqli_hits > 0 THEN 'sqli' WHEN xss_hits > 0 THEN 'xss' ELSE '' END AS embedded
  FROM s4),
judged AS (SELECT *, {REASONS} AS reasons FROM s5),
cand AS (SELECT * REPLACE (CASE WHEN uri = '' THEN '-' ELSE uri END AS uri) FROM judged WHERE verdict IS NOT NULL),
left_out AS (SELECT * FROM judged WHERE verdict IS NULL)"""


REASONS = (
    compact([label(f"h_{f}_{n}", f"{f}:{n}(+{p})") for f, n, _, p in SIGNATURES])
    + f" || {ENC_HINTS} || {FD_HINTS} || {XSS_HINTS} || "
    + compact(
        [label(cnd, text) for cnd, _, text in TERMS]
        + [
            label("len(hpp) > 0", "('hpp:param_names=' || array_to_string(hpp, ','))"),
            label("edu_sql", "context:educational_sql_search"),
            label("edu_sql OR edu_xss", "context:natural_language_query"),
            label("edu_sql AND NOT ss_quote_termination", "no_quote_termination"),
            label("edu_sql AND NOT ss_sql_comment", "no_sql_comment"),
            label("edu_sql AND NOT ss_boolean_condition", "no_boolean_condition"),
            label("edu_sql AND NOT strong_sql", "fp_hint:sql_keyword_without_attack_structure"),
            label("edu_xss", "context:educational_xss_search"),
            label("edu_xss AND NOT xs_event_handler_assignment", "no_event_handler_assignment"),
            label("edu_xss AND NOT xs_javascript_protocol", "no_javascript_protocol"),
            label("edu_xss AND NOT xs_browser_data_access", "no_browser_data_access"),
            label("edu_xss AND NOT strong_xss", "fp_hint:xss_keyword_without_attack_structure"),
            label("embedded <> ''", "('hpp:embedded_attack=' || embedded)"),
            label("path_norm", "traversal:raw_request_uri_diff"),
            label("html_fallback", "traversal:html_fallback_like_response"),
            label("file_like", "traversal:file_like_response_type"),
        ]
    )
)


# ------------------------------------------------------------------ final queries

ALL = "security,access,error"
MS = "epoch_ms(log_time) AS log_time_ms"


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts) + "\n"


def log_q(tail: str) -> str:
    return with_(LOG) + tail


def req_q(tail: str, sources: str = "security") -> str:
    return with_(LOG, canon(sources)) + tail


def tx_q(tail: str, sources: str = ALL) -> str:
    return with_(LOG, canon(sources), texts()) + tail


def hx_q(tail: str, sources: str = ALL) -> str:
    return with_(LOG, canon(sources), texts(), hits()) + tail


def judged_q(tail: str, *more: str) -> str:
    return with_(LOG, canon(ALL), texts(), hits(), scored(), *more) + tail


def ident(x: str) -> str:
    n = norm(x)
    empties = ", ".join(s(v) for v in rules.EMPTY_IDENTIFIERS)
    return f"CASE WHEN {n} IN ({empties}) THEN '' ELSE {n} END"


_SECOND = local("log_time", "%Y-%m-%dT%H:%M:%S", "+0900")
_PARTS = ", ".join(
    [norm(x) for x in ("src_ip", "method", "uri", "query", "request_text")]
    + ["status_code", "verdict", _SECOND]
)
KEYED = f"""
keyed AS (SELECT *, CASE WHEN {ident('request_id')} <> '' THEN 'rid:' || {ident('request_id')}
  WHEN {ident('error_link_id')} <> '' THEN 'eid:' || {ident('error_link_id')}
  ELSE 'fp:' || left(sha1(concat_ws('||', {_PARTS})), 16) END AS ikey,
  CASE source_table WHEN 'security' THEN 3 WHEN 'access' THEN 2 ELSE 1 END AS prio FROM cand),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ikey ORDER BY prio DESC, ({ident('request_id')} <> '') DESC,
  ({ident('error_link_id')} <> '') DESC, score DESC, duration_us DESC, ttfb_us DESC, log_time DESC, pos, id) AS rn FROM keyed),
grp AS (SELECT ikey, count(*) AS merged, max(score) AS best_score, min(id) AS first_id, max(id) AS last_id,
  list(DISTINCT source_table) AS srcs, list_distinct(flatten(list(reasons))) AS all_reasons,
  list_sort(list(DISTINCT id)) AS ids, min((pos, log_time, id)) AS arrival,
  max(CASE WHEN {ident('error_link_id')} <> '' THEN {ident('error_link_id')} END) AS any_eid FROM keyed GROUP BY ikey),
inc AS (SELECT r.* EXCLUDE (score, reasons, error_link_id), g.best_score AS score, g.all_reasons AS reasons, g.merged,
  g.first_id, g.last_id, g.srcs, g.ids, g.arrival,
  CASE WHEN {ident('r.error_link_id')} <> '' THEN r.error_link_id ELSE coalesce(g.any_eid, r.error_link_id) END AS error_link_id
  FROM ranked r JOIN grp g USING (ikey) WHERE rn = 1),
idx AS (SELECT *, row_number() OVER (ORDER BY score DESC, log_time DESC, arrival) - 1 AS ci FROM inc)"""

_MAP = " ".join(f"WHEN {s(k)} THEN {s(v)}" for k, v in rules.PLACEHOLDER_VERDICTS.items())
_ENUM = " ".join(f"WHEN {s(k)} THEN {s(v)}" for k, v in rules.ENUM_VERDICTS.items())
_SEV = "CASE WHEN score >= 10 THEN 'high' WHEN score >= 7 THEN 'medium' WHEN score >= 4 THEN 'low' ELSE 'info' END"
_ASSETS = ", ".join(s(a) for a in W.KNOWN_ASSETS)
_SEVRANK = "CASE sev WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END"
_TPRIO = "CASE source_table WHEN 'security' THEN 3 WHEN 'error' THEN 2 WHEN 'access' THEN 1 ELSE 0 END"
_LSEC = local("log_time", "%Y-%m-%dT%H:%M:%S", "+09:00")
TRIAGE = f"""
res AS (SELECT *, CASE verdict {_MAP} ELSE 'inconclusive' END AS v, {_SEV} AS sev, {_TPRIO} AS tprio,
  CASE WHEN trim(request_id) NOT IN ('', '-') THEN 'request_id:' || trim(request_id)
    ELSE 'fallback:' || src_ip || '|' || method || '|' || uri || '|' || status_code || '|' || {_LSEC} END AS dkey FROM idx),
res2 AS (SELECT *, {_SEVRANK} AS sevrank FROM res),
res3 AS (SELECT *, row_number() OVER (PARTITION BY dkey ORDER BY tprio DESC, sevrank DESC, score DESC, log_time DESC, ci) AS drn,
  count(*) OVER (PARTITION BY dkey) AS dups, min(ci) OVER (PARTITION BY dkey) AS first_ci,
  list(source_table) OVER (PARTITION BY dkey) AS dsrcs FROM res2),
ded AS (SELECT *, dkey || '|table:' || source_table || '|log_id:' || id || '|candidate:' || ci AS ref,
  src_ip IN ({_ASSETS}) AS known,
  row_number() OVER (ORDER BY sevrank DESC, score DESC, tprio DESC, log_time DESC, first_ci) AS rk FROM res3 WHERE drn = 1)"""


def inc_q(tail: str, *more: str) -> str:
    return judged_q(tail, KEYED, *more)


def tri_q(tail: str, *more: str) -> str:
    return judged_q(tail, KEYED, TRIAGE, *more)


NOISE = """
ngrp AS (SELECT noise, src_ip, uri, method, status_code, user_agent, count(*) AS n, min(log_time) AS t0, max(log_time) AS t1
  FROM left_out GROUP BY ALL),
through AS (SELECT l.* FROM left_out l JOIN ngrp g ON l.noise = g.noise AND l.src_ip = g.src_ip AND l.uri = g.uri
  AND l.method = g.method AND l.status_code = g.status_code AND l.user_agent = g.user_agent WHERE g.n < 3)"""
_NOTE = " ".join(f"WHEN {s(k)} THEN {s(v)}" for k, v in rules.NOISE_NOTES.items())

_WIDE = "|".join(
    f"(?:{p})" for p in (
        rules.QUOTE_BREAKOUT, rules.TAG_INJECTION, rules.EVENT_HANDLER_ASSIGNMENT, JS,
        PATTERN["xss", "alert_call"], rules.BROWSER_DATA_ACCESS,
    )
)
_DECODED = "|".join(f"(?:{p})" for p in (SCRIPT, rules.EVENT_HANDLER_ASSIGNMENT, JS))


def review() -> str:
    """Left-out rows that passed through, looked at without their raw log."""
    bare = texts()
    for name in ("t0", "t1", "t2", "t3", "t4", "t5", "tx", "ty"):
        bare = bare.replace(f"{name} AS (SELECT", f"r{name} AS (SELECT").replace(f"FROM {name})", f"FROM r{name})")
    cols = (
        "source_table, pos, id, log_time, src_ip, method, uri, query_raw, query, raw_request, "
        f"{norm('raw_request')} AS request_text, status_code, response_body_bytes, user_agent, "
        "'' AS log_text, target"
    )
    bare = bare.replace("FROM req)", "FROM rreq)")
    seen = any_of("([query] || samples)", lambda x: f"({rx(x, _WIDE)} OR {rx(unescape(x), _DECODED)})")
    return f"""
rreq AS (SELECT {cols} FROM through),
{bare.strip()},
review AS (SELECT * FROM rty WHERE {learn_xss("array_to_string(" + uniq("[query, target, combined]") + ", ' ')")} AND NOT {seen})"""


_DIFF = (
    "CASE WHEN l.response_body_bytes <= 0 OR i.response_body_bytes <= 0 "
    "THEN abs(l.response_body_bytes - i.response_body_bytes) >= 256 "
    "ELSE abs(l.response_body_bytes - i.response_body_bytes) >= "
    "greatest(256, floor(greatest(l.response_body_bytes, i.response_body_bytes) * 0.3::DOUBLE)) END"
)
_QUOTES = f"({rx('query_raw', rules.REPEATED_QUOTE)} OR {ratio_at_least(norm('query_raw'), 15)})"
_ENCODED = has_any("lower({})", rules.ENCODED_MARKERS)
_SQLKEY = has_any(f"lower({norm('query')})", rules.SUPPORTING_SQL_KEYWORDS)
_TKEY = (
    f"{norm('src_ip')} || '|' || ({family('uri')}) || '|' || strftime(make_timestamp(((epoch_ms(log_time) // 120000) * 120000) * 1000) "
    "+ INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00'"
)
SUPPORT = f"""
strong AS (SELECT * , {norm('uri')} AS nuri, {family('uri')} AS fam FROM inc WHERE verdict = 'sqli' AND score >= 7),
lo AS (SELECT *, {norm('uri')} AS nuri, {family('uri')} AS fam FROM left_out WHERE query <> ''),
near AS (SELECT l.source_table, l.id, count(*) AS n, bool_or(i.status_code <> l.status_code) AS sd, bool_or({_DIFF}) AS zd,
  bool_or(i.nuri = l.nuri) AS su
  FROM lo l JOIN strong i ON i.src_ip = l.src_ip AND (i.nuri = l.nuri OR i.fam = l.fam)
  AND abs(epoch_ms(i.log_time) - epoch_ms(l.log_time)) <= 120000 GROUP BY ALL),
sup0 AS (SELECT l.*, near.n, {compact([
    label(_SQLKEY, "supporting:sql_keyword_fragment"),
    label(_QUOTES, "supporting:special_chars_or_quote_repetition"),
    label(f"{_ENCODED.replace('{}', 'query_raw')} OR {_ENCODED.replace('{}', 'target')}", "supporting:encoded_payload_trace"),
    label("near.sd", "supporting:status_delta_from_nearby_candidate"),
    label("near.zd", "supporting:response_size_delta_from_nearby_candidate"),
    label("near.su", "supporting:same_uri_nearby_high_signal_sqli"),
])} AS hints FROM lo l JOIN near ON near.source_table = l.source_table AND near.id = l.id),
sup1 AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN request_id <> '' THEN request_id ELSE source_table || ':' || id || ':' || target END
  ORDER BY pos, log_time, id) AS once FROM sup0 WHERE len(hints) > 0),
sup AS (SELECT *, {_TKEY} AS tkey FROM sup1 WHERE once = 1)"""

_PPATH = f"lower({norm(f'lower({_EFF})')})"
BURSTS = f"""
pr AS (SELECT src_ip AS ip, epoch_ms(log_time) AS ms, pos, id, path, status_code AS st, split_part(lower(resp_content_type), ';', 1) AS ct,
  response_body_bytes AS bytes FROM (SELECT *, {_PPATH} AS path, lower({norm('query')}) AS ql FROM req)
  WHERE method IN ('GET', 'HEAD', 'OPTIONS') AND {burst_probe('path', 'ql')}),
pt AS (SELECT DISTINCT ip, ms FROM pr),
starts(ip, st0) AS (SELECT ip, min(ms) FROM pt GROUP BY ip
  UNION ALL SELECT a.ip, min(p.ms) FROM starts a JOIN pt p ON p.ip = a.ip AND p.ms > a.st0 + 120000 GROUP BY a.ip),
bk AS (SELECT p.*, max(a.st0) AS b FROM pr p JOIN starts a ON a.ip = p.ip AND a.st0 <= p.ms GROUP BY ALL),
bsum AS (SELECT ip, b, count(*) AS n, count(DISTINCT path) AS np, max(ms) AS e FROM bk GROUP BY ip, b HAVING count(*) >= 3 AND count(DISTINCT path) >= 3),
bpath AS (SELECT ip, b, path, min((ms, pos, id)) AS f FROM bk GROUP BY ALL),
bpaths AS (SELECT ip, b, array_to_string(list(path ORDER BY f)[1:10], ',') AS paths, list_distinct(flatten(list({probe_hints('path')}))) AS hints FROM bpath GROUP BY ip, b),
bst AS (SELECT ip, b, string_agg(st || '=' || c, ',' ORDER BY c DESC, st::VARCHAR) AS sts FROM (SELECT ip, b, st, count(*) AS c FROM bk GROUP BY ALL) GROUP BY ip, b),
bct AS (SELECT ip, b, string_agg(ct || '=' || c, ',' ORDER BY c DESC, ct) AS cts FROM (SELECT ip, b, CASE WHEN ct = '' THEN '-' ELSE ct END AS ct, count(*) AS c FROM bk GROUP BY ALL) GROUP BY ip, b),
bsz AS (SELECT *, row_number() OVER (PARTITION BY ip, b ORDER BY c DESC, f) AS rn, sum(c) OVER (PARTITION BY ip, b) AS html FROM
  (SELECT ip, b, bytes, count(*) AS c, min((ms, pos, id)) AS f FROM bk WHERE st = 200 AND ct = 'text/html' AND bytes > 0 GROUP BY ip, b, bytes)),
bursts AS (SELECT s.ip AS src_ip, s.b AS start_ms, s.e AS end_ms, s.n AS request_count, s.np AS distinct_path_count, paths AS sample_paths,
  sts AS status_counts, cts AS content_type_counts, CASE WHEN z.c >= 2 AND z.c * 2 >= z.html THEN z.bytes END AS dominant_response_body_bytes,
  CASE WHEN z.c >= 2 AND z.c * 2 >= z.html THEN z.c END AS dominant_count,
  {joined("hints || CASE WHEN z.c >= 2 AND z.c * 2 >= z.html THEN ['dir_probe:repeated_fallback_like_html'] ELSE [] END")} AS reason_hints
  FROM bsum s JOIN bpaths USING (ip, b) JOIN bst USING (ip, b) JOIN bct USING (ip, b) LEFT JOIN bsz z ON z.ip = s.ip AND z.b = s.b AND z.rn = 1)"""

_RT = f"trim(concat_ws(' ', {norm('raw_request')}, uri, query))"
_RSET = "({})".format(", ".join(str(x) for x in rules.IP_RISK_STATUSES))
_RTERMS = [
    ("len(query) >= 40", 1, "long_query(+1)"), ("len(query) >= 80", 1, "very_long_query(+1)"),
    (ratio_at_least("query", 15), 1, "special_char_ratio_high(+1)"),
    (ratio_at_least("query", 30), 1, "special_char_ratio_very_high(+1)"),
    (f"status_code IN {_RSET}", 2, "('error_status:' || status_code || '(+2)')"),
    ("duration_us >= 2000000", 3, "high_duration(+3)"),
    ("duration_us >= 5000000", 2, "very_high_duration(+2)"), ("ttfb_us >= 2000000", 2, "high_ttfb(+2)"),
    (_LOGIN, 1, "login_endpoint(+1)"),
    (f"({_HEAVY} AND query <> '' AND {rx('query', rules.QUERY_ATTACK_TOKENS)})", 2, "query_endpoint_with_attack_tokens(+2)"),
    (f"({_BODY} AND {_LOGIN})", 1, "auth_payload_content_type(+1)"),
]
_RSIG = [(f, n, p) for f, n, _, p in SIGNATURES if f in ("sqli", "xss")]
RISK = f"""
k0 AS (SELECT *, {', '.join(f"{sig(f, n, _RT, strip=False)} AS h_{f}_{n}" for f, n, _ in _RSIG)} FROM req),
k1 AS (SELECT *, {' + '.join(f'CASE WHEN h_{f}_{n} THEN {p} ELSE 0 END' for f, n, p in _RSIG)} + {' + '.join(f'CASE WHEN {c_} THEN {p} ELSE 0 END' for c_, p, _ in _RTERMS)} AS score,
  array_to_string({compact([label(f'h_{f}_{n}', f'{f}:{n}(+{p})') for f, n, p in _RSIG] + [label(c_, t) for c_, _, t in _RTERMS])}, ';') AS reasons,
  ({' OR '.join(f'h_{f}_{n}' for f, n, _ in _RSIG if f == 'sqli')}) AS sq, ({' OR '.join(f'h_{f}_{n}' for f, n, _ in _RSIG if f == 'xss')}) AS xs FROM k0),
risk AS (SELECT *, CASE WHEN xs AND score >= 7 THEN 'xss' WHEN sq AND score >= 7 THEN 'sqli' WHEN score >= 4 THEN 'suspicious' ELSE 'benign' END AS verdict FROM k1),
ipr AS (SELECT src_ip, count(*) AS total_requests, count_if(verdict = 'benign') AS benign_count, count_if(verdict = 'suspicious') AS suspicious_count,
  count_if(verdict = 'sqli') AS sqli_count, count_if(verdict = 'xss') AS xss_count, sum(score)::BIGINT AS total_score, max(score) AS max_score,
  coalesce(array_to_string(list_filter(list(reasons ORDER BY log_time DESC, id), lambda x_: x_ <> '')[1:3], ' | '), '') AS sample_reasons FROM risk GROUP BY src_ip),
ips AS (SELECT *, CASE WHEN sqli_count >= 3 OR xss_count >= 3 OR total_score >= 20 THEN 'high_risk'
  WHEN sqli_count >= 1 OR xss_count >= 1 OR suspicious_count >= 3 OR total_score >= 10 THEN 'medium_risk'
  WHEN suspicious_count >= 1 THEN 'low_risk' ELSE 'benign' END AS final_verdict FROM ipr)"""


def half_even(top: str, bottom: str) -> str:
    q, r = f"(({top}) // ({bottom}))", f"(({top}) % ({bottom}))"
    return f"({q} + CASE WHEN 2 * {r} > {bottom} OR (2 * {r} = {bottom} AND {q} % 2 = 1) THEN 1 ELSE 0 END)::BIGINT"


def all_queries() -> dict[str, str]:
    ev = "(id - 1)"
    bad = f"{ev} % 50 = 7"
    kst = local("log_time", "%Y-%m-%dT%H:%M:%S", "")
    q = {}
    # sources
    acc = (
        f"SELECT {MS}, src_ip AS client_ip, method, raw_request, target_path AS uri, query_string, 'HTTP/1.1' AS protocol, "
        "status_code, response_body_bytes, referer, user_agent, 'shop.example' AS host, 'main' AS vhost, raw_log "
        f"FROM log2 WHERE NOT ({bad})"
    )
    q["ingest_access"] = q["stream_ingest"] = log_q(acc)
    nul = ", ".join(
        f"NULL AS {n}" for n in (
            "peer_ip", "in_bytes", "out_bytes", "total_bytes", "keepalive_count", "connection_status",
            "req_content_length", "host", "x_forwarded_for", "matched_rule", "resp_html_norm_fingerprint",
            "resp_html_fingerprint_version", "resp_html_baseline_name", "resp_html_baseline_confidence",
            "resp_html_features_json",
        )
    )
    sec_time = f"CASE WHEN {ev} % 40 <> 9 THEN epoch_ms(log_time) END AS log_time_ms"
    shown = f"CASE WHEN {ev} % 40 = 9 THEN 'bad' ELSE {kst} || '.000+0900' END"
    line = (
        f"""'log_time="' || {shown} || '" method=DUMMY request_id=' || coalesce(request_id, '-') || ' error_link_id=' || coalesce(error_link_id, '-')
        || ' vhost=main src_ip=' || src_ip || ' method=' || method || ' raw_request="' || raw_request || '" uri="' || uri || '" query_string="' || query_string
        || '" protocol=HTTP/1.1 status_code=' || status_code || ' response_body_bytes=' || response_body_bytes || ' duration_us=' || duration_us
        || ' ttfb_us=' || ttfb_us || ' keepalive_count=x1 req_content_type=' || coalesce(req_content_type, '-') || ' resp_content_type="' || resp_content_type
        || '" referer="' || coalesce(referer, '-') || '" user_agent="' || user_agent || '" resp_html_baseline_match="TRUE" note="say \\"hi\\" twice"'"""
    )
    q["ingest_security"] = log_q(
        f"SELECT {sec_time}, nullif(request_id, '-') AS request_id, error_link_id, 'main' AS vhost, src_ip, method, raw_request, uri, query_string, 'HTTP/1.1' AS protocol, "
        f"status_code, response_body_bytes, duration_us, ttfb_us, req_content_type, resp_content_type, referer, user_agent, {nul}, "
        f"'unknown' AS attack_label, 0.0::DOUBLE AS risk_score, 0 AS is_suspicious, 1 AS resp_html_baseline_match, md5({line}) AS raw_log_md5 "
        f"FROM log2 WHERE NOT ({bad})"
    )
    q["stream_flush"] = q["stream_replay"] = log_q(
        f"SELECT 'security' AS source, {sec_time}, nullif(request_id, '-') AS request_id, src_ip FROM log2 WHERE NOT ({bad}) "
        f"UNION ALL SELECT 'access', {MS}, NULL, src_ip FROM log2 WHERE NOT ({bad}) "
        f"UNION ALL SELECT 'error', {MS}, nullif(request_id, '-'), src_ip FROM log2 WHERE NOT ({bad})"
    )
    q["ingest_error"] = log_q(
        f"SELECT {MS}, error_link_id, nullif(request_id, '-') AS request_id, 'core' AS module_name, 'error' AS log_level, src_ip, src_ip AS peer_ip, "
        f"'File does not exist: ' || uri AS message FROM log2 WHERE NOT ({bad})"
    )
    q["ingest_rejects"] = log_q(
        f"SELECT 'access' AS source, src_ip || ' - - [x] \"' || raw_request AS raw_log FROM log2 WHERE {bad} "
        f"UNION ALL SELECT 'security', 'nothing to see ' || id FROM log2 WHERE {bad} "
        "UNION ALL SELECT 'error', '[yesterday] [error_link_id:' || coalesce(error_link_id, '-') || '] [request_id:' || coalesce(request_id, '-') "
        "|| '] [module_name:core] [log_level:error] [src_ip:' || src_ip || ' peer_ip:' || src_ip || '] message=File does not exist: ' || uri "
        f"FROM log2 WHERE {bad}"
    )
    day = "log_time >= TIMESTAMP '2026-04-01 15:00:00' AND log_time < TIMESTAMP '{}'"
    q["scan_range"] = log_q(
        f"SELECT id, {MS}, src_ip, uri, status_code FROM log2 WHERE {day.format('2026-04-02 12:00:00')}"
    )
    q["stored_log_range"] = q["scan_range"]
    q["scan_local_day"] = log_q(f"SELECT id, {MS}, src_ip FROM log2 WHERE {day.format('2026-04-02 15:00:00')}")
    q["scan_recent"] = log_q(
        f"SELECT id, {MS}, src_ip, method, raw_request, uri, query_string, status_code, duration_us, ttfb_us, req_content_type "
        "FROM log2 WHERE log_time >= TIMESTAMP '2026-04-02 12:00:00' - INTERVAL 24 HOUR"
    )
    order = "error,security,access"
    q["scan_sources"] = req_q(f"SELECT source_table, pos AS source_position, id, src_ip, {MS} FROM req", order)
    q["export_local_time"] = log_q(f"SELECT id, {kst} || '.000+09:00' AS log_time FROM log2")
    q["export_counts"] = log_q(
        f"SELECT 'security' AS \"table\", count(*) AS count FROM log2 UNION ALL SELECT 'access', count_if({ev} % 5 = 0) FROM log2 "
        f"UNION ALL SELECT 'error', count_if({ev} % 9 = 0) FROM log2 "
        f"UNION ALL SELECT 'total', count(*) + count_if({ev} % 5 = 0) + count_if({ev} % 9 = 0) FROM log2"
    )
    q["write_artifacts"] = inc_q(
        "SELECT 'candidates' AS artifact, ikey AS item, score AS value FROM inc UNION ALL "
        "SELECT 'noise', concat_ws('|', noise, src_ip, uri, method, status_code, user_agent), n FROM ngrp WHERE n >= 3 "
        "UNION ALL SELECT 'filtered', concat_ws('|', source_table, id, noise), status_code FROM through", NOISE
    )
    # fields
    q["canon_fields"] = req_q(
        "SELECT source_table, id, src_ip, method, uri, query, request_text, status_code, response_body_bytes, duration_us, ttfb_us, "
        f"req_content_type, resp_content_type, user_agent, referer, request_id, error_link_id, {MS} FROM req", ALL
    )
    q["read_export_json"] = q["canon_fields"]
    page = r"regexp_replace(html, '%[89A-Fa-f][0-9A-Fa-f]', '', 'g')"
    q["url_decode_tolerant"] = f"SELECT page_id, md5({norm(page)}) AS decoded_md5 FROM pages"
    rows = " UNION ALL ".join(
        f"SELECT source_table, id, {s(name)} AS field, {d} AS depth, {k}{d} AS text FROM ty WHERE {k}{d} IS NOT NULL"
        for name, k in (("query_string", "q"), ("raw_request_target", "t")) for d in range(3)
    )
    q["decode_variants"] = tx_q(rows, "security")
    ent = " UNION ALL ".join(
        f"SELECT source_table, id, {s(name)} AS field, f_ AS text, min(d_) AS source_depth FROM (SELECT *, unnest({k}e) AS f_, "
        f"unnest(list_transform({k}e, lambda e_: list_min(list_filter([0, 1, 2], lambda d_: trim({unescape(f'coalesce([{k}0, {k}1, {k}2][d_ + 1], {s(str())})')}) = e_)))) AS d_ "
        f"FROM ty) GROUP BY ALL"
        for name, k in (("query_string", "q"), ("raw_request_target", "t"))
    )
    q["entity_variants"] = tx_q(ent, "security")
    q["analysis_text"] = tx_q("SELECT source_table, id, md5(base_text) AS base_md5, md5(combined) AS md5 FROM ty")
    q["request_target"] = req_q("SELECT id, target FROM req")
    q["effective_path"] = req_q(f"SELECT source_table, id, {_EFF} AS path FROM req", ALL)
    q["endpoint_family"] = req_q(f"SELECT source_table, id, {family('uri')} AS family FROM req", ALL)
    q["content_type_bucket"] = req_q("SELECT id, trim(split_part(lower(resp_content_type), ';', 1)) AS bucket FROM req")
    q["hpp_params"] = hx_q("SELECT id, array_to_string(hpp, ',') AS names FROM hx", "security")
    special = "len(regexp_replace(query, '[^''\"`;=#()/*,<>%-]', '', 'g'))"
    q["special_ratio"] = req_q(
        f"SELECT id, {special} AS special, len(query) AS length, {flag(ratio_at_least('query', 15))} AS high, "
        f"{flag(ratio_at_least('query', 30))} AS very_high FROM req"
    )
    q["ua_class"] = req_q(f"SELECT id, {flag(_BROWSER)} AS browser FROM req")
    q["uri_class"] = req_q(
        f"SELECT id, {flag(_LOGIN)} AS login, {flag(_HEAVY)} AS query_heavy, {flag(_STATIC)} AS static FROM req"
    )
    q["json_content_type"] = req_q(
        f"SELECT id, {flag(_JSON.format('req_content_type'))} AS request_json, {flag(_JSON.format('resp_content_type'))} AS response_json FROM req"
    )
    q["flexible_time"] = req_q(f"SELECT source_table, id, {MS} FROM req", ALL)
    q["temporal_key"] = req_q(f"SELECT source_table, id, {_TKEY} AS k FROM req", ALL)
    q["second_bucket"] = req_q(f"SELECT id, {_SECOND} AS second FROM req")
    raws = "[" + ", ".join(s(v) for v in ["-", "none", "NULL", "n/a", " na ", "", "a%2Bb", "null"]) + "]"
    q["identifier_norm"] = (
        f"SELECT event_id, {ident(f'coalesce({raws}[event_id % 9 + 1], event_type)')} AS ident FROM events"
    )
    flat = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
    q["shorten_text"] = "SELECT doc_id, " + ", ".join(
        f"CASE WHEN len({flat}) <= {n} THEN {flat} ELSE rtrim(left({flat}, {n - 3})) || '...' END AS short_{n}" for n in (160, 180, 280)
    ) + " FROM documents"
    q["probe_path_hints"] = req_q(
        f"SELECT source_table, id, {joined(probe_hints('path'))} AS hints, {flag(burst_probe('path', 'ql'))} AS burst_probe "
        f"FROM (SELECT *, {_PPATH} AS path, lower({norm('query')}) AS ql FROM req)", ALL
    )
    q["encoded_marker"] = req_q(f"SELECT id, {flag(_ENCODED.replace('{}', 'query_raw'))} AS marker FROM req")
    q["repeated_quote"] = req_q(f"SELECT id, {flag(_QUOTES)} AS quotes FROM req")
    q["sql_keyword"] = req_q(f"SELECT id, {flag(_SQLKEY)} AS keyword FROM req")
    q["mixed_case_script"] = tx_q(f"SELECT id, {flag(mixed('combined'))} AS mixed FROM ty", "security")
    q["attack_intent_words"] = req_q(f"SELECT id, {flag(_WORDS)} AS intent FROM req")
    # rules
    plain_hits = hx_q("SELECT 1").rsplit("SELECT 1", 1)[0].replace(
        "CASE WHEN early IS NULL THEN combined END AS scan", "combined AS scan"
    )
    q["signature_hits"] = plain_hits + " UNION ALL ".join(
        f"SELECT source_table, id, {s(f)} AS family, {s(n)} AS signature, {p} AS points FROM hx WHERE h_{f}_{n}" for f, n, _, p in SIGNATURES
    )
    q["signature_counts"] = plain_hits + "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT {s(f)} AS family, {s(n)} AS signature, count_if(h_{f}_{n}) AS hits, count_if(h_{f}_{n}) * {p} AS points FROM hx" for f, n, _, p in SIGNATURES
    ) + ") WHERE hits > 0"
    q["decoded_attack_hints"] = hx_q(
        f"SELECT source_table, id, at0::INT AS attack_d0, at1::INT AS attack_d1, at2::INT AS attack_d2, sq1::INT AS sqli_d1, "
        f"sq2::INT AS sqli_d2, {joined(ENC_HINTS)} AS hints FROM hx"
    )
    q["file_disclosure_hints"] = hx_q(f"SELECT source_table, id, {FD_POINTS} AS points, {joined(FD_HINTS)} AS hints FROM hx")
    q["xss_context_hints"] = tx_q(f"SELECT source_table, id, {joined(XSS_HINTS)} AS hints FROM ty")
    q["sqli_structure"] = tx_q("SELECT source_table, id, " + ", ".join(f"{flag(v)} AS {n}" for n, v in SQL_STRUCTURE.items()) + " FROM ty")
    q["xss_structure"] = tx_q("SELECT source_table, id, " + ", ".join(f"{flag(v)} AS {n}" for n, v in XSS_STRUCTURE.items()) + " FROM ty")
    q["educational_context"] = req_q(
        f"SELECT source_table, id, {flag(_LEARN_SQL)} AS learning_sql, {flag(learn_xss(join2('query', 'target')))} AS learning_xss FROM req", ALL
    )
    q["risk_score"] = judged_q(f"SELECT source_table, id, score, {joined('reasons')} AS reasons FROM judged WHERE early IS NULL")
    q["verdict_cascade"] = judged_q("SELECT source_table, id, coalesce(verdict, '') AS verdict FROM judged")
    q["noise_category"] = judged_q("SELECT source_table, id, noise AS noise_category FROM left_out")
    q["early_noise"] = judged_q("SELECT source_table, id, early AS category FROM judged WHERE early IS NOT NULL")
    flags = f"{flag('path_norm')} AS path_normalized, {flag('html_fallback')} AS html_fallback"
    hpp = f"{flag('len(hpp) > 0')} AS hpp_detected, array_to_string(hpp, ',') AS hpp_param_names"
    q["candidates"] = judged_q(
        f"SELECT source_table, id, src_ip, method, uri, query, status_code, score, verdict AS verdict_hint, embedded AS embedded_attack_hint, "
        f"{flags}, {hpp}, {joined('reasons')} AS reason_hints, request_id FROM cand"
    )
    hint_path = f"lower({norm('probe_path')})"
    q["filtered_rows"] = judged_q(
        f"SELECT source_table, id, noise AS noise_category, {MS}, src_ip, method, uri, query, status_code, request_id, error_link_id, "
        f"response_body_bytes, resp_content_type, target, {flags}, {hpp}, {joined(probe_hints('hp'))} AS reason_hints "
        f"FROM (SELECT *, {hint_path} AS hp FROM left_out)"
    )
    q["fallback_flags"] = judged_q(f"SELECT source_table, id, {flags}, {flag('file_like')} AS file_like FROM judged")
    q["fp_review"] = judged_q(
        f"SELECT 'educational_xss_keyword_search' AS review_reason, source_table, id, {MS}, src_ip, uri, query, status_code FROM review", NOISE, review()
    )
    q["high_signal_sqli"] = judged_q("SELECT source_table, id, score, src_ip FROM cand WHERE verdict = 'sqli' AND score >= 7")
    risk_with = with_(LOG, canon("security"), RISK)
    q["request_risk"] = risk_with + (
        f"SELECT id AS log_id, {MS}, src_ip, method, CASE WHEN uri = '' THEN '-' ELSE uri END AS uri, query, status_code, score, verdict, reasons, request_text AS raw_request FROM risk"
    )
    # aggregates
    q["noise_rollup"] = judged_q(
        f"SELECT noise AS noise_category, src_ip, uri, method, status_code, user_agent, n AS count, epoch_ms(t0) AS start_ms, epoch_ms(t1) AS end_ms, "
        f"CASE noise {_NOTE} ELSE {s(rules.NOISE_NOTE_DEFAULT)} END AS note FROM ngrp WHERE n >= 3", NOISE
    )
    q["noise_passed_through"] = judged_q("SELECT source_table, id, noise AS noise_category FROM through", NOISE)
    q["noise_breakdown"] = judged_q(
        "SELECT noise AS category, count(*) AS count FROM left_out GROUP BY noise"
    )
    q["incidents"] = inc_q(
        f"SELECT ikey AS incident_group_key, source_table, id, src_ip, method, uri, query, status_code, score, verdict AS verdict_hint, merged AS merged_row_count, "
        f"first_id AS first_log_id, last_id AS last_log_id, {joined('srcs')} AS merged_source_tables, {joined('reasons')} AS reason_hints, request_id, error_link_id, {MS} FROM inc"
    )
    q["incident_members"] = inc_q("SELECT ikey AS incident_group_key, source_table, id FROM keyed")
    dash = lambda x: f"CASE WHEN {ident(x)} = '' THEN '-' ELSE {ident(x)} END AS {x}"
    q["incident_groups"] = inc_q(
        f"SELECT ikey AS incident_group_key, merged AS merged_row_count, src_ip, method, uri, status_code, verdict AS verdict_hint, {dash('request_id')}, "
        f"{dash('error_link_id')}, {joined('srcs')} AS source_tables, {MS} FROM inc"
    )
    counts = [
        ("selected_source_rows", "judged", "count(*)"), ("total_exported_rows", "judged", "count(*)"),
        ("filtered_out_rows", "left_out", "count(*)"), ("candidate_rows_before_dedup", "cand", "count(*)"),
        ("candidate_rows", "inc", "count(*)"), ("distinct_incident_candidates", "inc", "count(*)"),
        ("candidate_duplicate_rows_removed", "inc", "(SELECT count(*) FROM cand) - count(*)"),
        ("filtered_out_non_aggregated_rows", "through", "count(*)"), ("noise_group_count", "ngrp", "count_if(n >= 3)"),
        ("supporting_events", "sup", "count(*)"), ("false_positive_review_candidates", "review", "count(*)"),
        ("probing_sequence_summaries", "bursts", "count(*)"),
    ]
    q["stage_counts"] = inc_q(
        " UNION ALL ".join(f"SELECT {s(n)} AS counter, {v} AS value FROM {t}" for n, t, v in counts), NOISE, review(), SUPPORT, BURSTS
    )
    q["ip_risk"] = risk_with + (
        f"SELECT src_ip, total_requests, benign_count, suspicious_count, sqli_count, xss_count, total_score, max_score, final_verdict, sample_reasons, "
        f"{half_even('total_score * 100', 'total_requests')} AS average_hundredths FROM ips"
    )
    ded_cols = (
        f"dkey AS dedup_key, ref AS incident_ref, dups AS duplicate_count, {joined('dsrcs')} AS source_tables, 'manual_review' AS recommended_actions, "
        f"{flag('known')} AS known_asset, src_ip, uri, score, v AS verdict, sev AS severity, 'low' AS confidence, ci AS candidate_index"
    )
    q["triage_dedup"] = tri_q(f"SELECT {ded_cols} FROM ded")
    top = """
fact AS (SELECT src_ip, 'verdict' AS fact, v AS value, rk FROM ded UNION ALL SELECT src_ip, 'uri', uri, rk FROM ded UNION ALL SELECT src_ip, 'action', 'manual_review', rk FROM ded),
fcount AS (SELECT src_ip, fact, value, count(*) AS n, min(rk) AS f FROM fact GROUP BY ALL),
top3 AS (SELECT *, row_number() OVER (PARTITION BY src_ip, fact ORDER BY n DESC, f) AS place FROM fcount QUALIFY place <= 3),
byip AS (SELECT src_ip, count(*) AS incident_count, max(sevrank) AS sr, max(sev ORDER BY sevrank) AS x_, bool_or(known) AS known FROM ded GROUP BY src_ip),
rawip AS (SELECT src_ip, count(*) AS raw FROM res GROUP BY src_ip)"""
    top = top.replace("max(sev ORDER BY sevrank) AS x_, ", "arg_max(sev, sevrank) AS msev, ")
    tops = ", ".join(
        f"(SELECT coalesce(string_agg(value, ',' ORDER BY place), '') FROM top3 t WHERE t.src_ip = b.src_ip AND fact = {s(f)}) AS {n}"
        for f, n in (("verdict", "top_verdicts"), ("uri", "top_uris"), ("action", "top_actions"))
    )
    q["triage_by_ip"] = tri_q(
        f"SELECT b.src_ip, incident_count, raw AS raw_row_count, msev AS max_severity, 'low' AS max_confidence, {tops}, {flag('known')} AS known_asset "
        "FROM byip b JOIN rawip r ON r.src_ip = b.src_ip", top
    )
    q["triage_distributions"] = tri_q(
        " UNION ALL ".join(
            f"SELECT {s(d)} AS distribution, {x} AS value, count(*) AS count FROM ded GROUP BY ALL"
            for d, x in (("verdicts", "v"), ("severities", "sev"), ("source_tables", "source_table"))
        ) + " UNION ALL SELECT 'recommended_actions', 'manual_review', count(*) FROM ded"
    )
    share = "shr AS (SELECT noise AS category, count(*) AS count, (sum(count(*)) OVER ())::BIGINT AS total FROM left_out GROUP BY noise)"
    share_cols = f"SELECT category, count, total, {half_even('count * 1000', 'total')} AS share FROM shr"
    q["noise_share"] = judged_q(share_cols, share)
    q["recon_share"] = judged_q(share_cols + " WHERE category IN ('low_signal_fuzzing', 'low_signal_dir_probe')", share)
    q["known_asset_matches"] = tri_q("SELECT src_ip, count(*) AS incident_count FROM ded WHERE known GROUP BY src_ip")
    # joins
    q["supporting_events"] = inc_q(
        f"SELECT source_table, id, {MS}, src_ip, method, uri, query, status_code, response_body_bytes, request_id, {joined('hints')} AS reason_hints, "
        "tkey AS temporal_context_key, n AS nearby_candidate_count FROM sup", SUPPORT
    )
    q["incident_evidence"] = tri_q(
        "SELECT dkey AS dedup_key, 1 AS found_by, md5(log_text) AS log_md5, user_agent AS evidence_agent, len(reasons) AS hints FROM ded"
    )
    q["known_assets"] = req_q(f"SELECT id, src_ip, {flag(f'src_ip IN ({_ASSETS})')} AS known_asset FROM req")
    q["notable_lookup"] = tri_q(
        "SELECT CASE WHEN ci % 4 = 0 THEN ref || '?' ELSE ref END AS incident_ref, request_id, "
        + ", ".join(f"CASE WHEN ci % 4 <> 0 THEN {n} END AS {n}" for n in ("uri", "status_code", "score")) + " FROM ded"
    )
    q["error_correlation"] = req_q(
        f"SELECT request_id, a.n AS request_count, a.lo AS first_log_id, a.hi AS last_log_id, b.n AS error_count, b.lo AS first_error_id, b.hi AS last_error_id, "
        f"b.links AS error_link_count FROM (SELECT {ident('request_id')} AS request_id, count(*) AS n, min(id) AS lo, max(id) AS hi FROM req "
        f"WHERE source_table = 'security' GROUP BY 1) a JOIN (SELECT {ident('request_id')} AS request_id, count(*) AS n, min(id) AS lo, max(id) AS hi, "
        f"count(DISTINCT nullif({ident('error_link_id')}, '')) AS links FROM req WHERE source_table = 'error' GROUP BY 1) b USING (request_id) WHERE request_id <> ''",
        "security,error",
    )
    # windows and top-k
    q["incident_representative"] = inc_q(f"SELECT ikey AS incident_group_key, source_table, id, duration_us, {MS} FROM inc")
    q["probing_bursts"] = with_(LOG, canon(ALL), BURSTS) + "SELECT * FROM bursts"
    q["incident_rank"] = tri_q("SELECT rk AS rank, ref AS incident_ref, sev AS severity, score FROM ded")
    q["triage_representative"] = tri_q(f"SELECT dkey AS dedup_key, source_table, id AS log_id, score, {MS} FROM ded")
    q["top3_per_ip"] = tri_q("SELECT src_ip, fact, place, value, n FROM top3", top)
    q["top_candidates"] = inc_q(f"SELECT ikey AS incident_group_key, score, {MS}, ci AS candidate_index FROM idx WHERE ci < 50")
    q["top_noise"] = judged_q(
        "SELECT noise AS noise_category, src_ip, uri, method, status_code, user_agent, n AS count FROM ngrp WHERE n >= 3 "
        "ORDER BY n DESC, noise DESC, src_ip DESC, uri, method, status_code, user_agent LIMIT 8", NOISE
    )

    def short(x: str, n: int) -> str:
        f = rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
        return f"CASE WHEN len({f}) <= {n} THEN {f} ELSE rtrim(left({f}, {n - 3})) || '...' END"

    q["top_incidents"] = tri_q(
        f"SELECT rk AS rank, ref AS incident_ref, v AS verdict, sev AS severity, score, src_ip, uri, dups AS duplicate_count, {short('user_agent', 160)} AS user_agent, "
        f"{short('request_text', 180)} AS raw_request, {short('log_text', 280)} AS raw_log_excerpt, {joined('reasons')} AS reason_hints, {flag('known')} AS known_asset FROM ded WHERE rk <= 12"
    )
    q["top_ips"] = tri_q(
        "SELECT b.src_ip, incident_count, raw AS raw_row_count, msev AS max_severity FROM byip b JOIN rawip r ON r.src_ip = b.src_ip "
        "ORDER BY sr DESC, incident_count DESC, b.src_ip LIMIT 8", top
    )
    q["top_risky_ips"] = risk_with + (
        "SELECT src_ip, total_score, sqli_count, xss_count, max_score, final_verdict FROM ips ORDER BY total_score DESC, sqli_count DESC, xss_count DESC, max_score DESC, src_ip LIMIT 20"
    )
    q["top_risky_requests"] = risk_with + "SELECT id AS log_id, src_ip, score, verdict FROM risk ORDER BY score DESC, log_time DESC, id LIMIT 10"
    q["context_caps"] = inc_q(
        "(SELECT 'burst' AS kind, src_ip || '|' || start_ms AS item FROM bursts ORDER BY request_count DESC, distinct_path_count DESC, start_ms DESC, src_ip LIMIT 10) "
        "UNION ALL (SELECT 'supporting', source_table || '|' || id FROM sup ORDER BY n DESC, log_time DESC, pos, id LIMIT 20) "
        "UNION ALL (SELECT 'review', source_table || '|' || id FROM review ORDER BY pos, log_time, id LIMIT 20) "
        "UNION ALL (SELECT 'error', ci::VARCHAR FROM idx WHERE ci % 9 IN (4, 7, 8) ORDER BY ci LIMIT 5)", NOISE, review(), SUPPORT, BURSTS
    )
    q["distinct_paths"] = with_(LOG, canon(ALL), BURSTS) + (
        "SELECT ip AS src_ip, b AS start_ms, row_number() OVER (PARTITION BY ip, b ORDER BY f) AS place, path FROM bpath SEMI JOIN bsum USING (ip, b)"
    )
    # model tables
    q["triage_requests"] = inc_q(
        "SELECT ci AS candidate_index, '2026-04-01 15:00:00' AS window_start, '2026-04-02 15:00:00' AS window_end_exclusive, ikey AS incident_group_key, source_table, "
        "id AS log_id, src_ip, uri, query AS query_string, score, verdict AS verdict_hint, merged AS merged_row_count, "
        "first_id AS first_log_id, last_id AS last_log_id, least(8, len(reasons)) AS hints, md5(left(trim(log_text), 1200)) AS excerpt_md5, md5(request_text) AS request_md5, "
        "user_agent, request_id, error_link_id FROM idx"
    )
    q["rule_triage"] = tri_q(
        "SELECT ci AS candidate_index, ikey AS incident_group_key, score, verdict AS verdict_hint, v AS verdict, sev AS severity, 'low' AS confidence, "
        "least(8, len(reasons)) AS evidence, 'manual_review' AS recommended_actions FROM res"
    )
    q["validate_responses"] = tri_q(
        "SELECT ci AS candidate_index, array_to_string(list_filter([CASE WHEN len(reasons) = 0 THEN 'evidence_fields' END, CASE WHEN ci % 9 = 6 THEN 'severity' END], lambda x: x IS NOT NULL), ',') AS violations, "
        "CASE WHEN ci % 9 = 6 OR len(reasons) = 0 THEN 0 ELSE 1 END AS valid FROM res WHERE ci % 9 IN (0, 1, 2, 3, 5, 6)"
    )
    answered = tri_q(
        "SELECT dkey AS dedup_key, ref AS incident_ref, dups AS duplicate_count, src_ip, uri, score, v AS verdict, sev AS severity, 'low' AS confidence, "
        "'review_raw_log' AS recommended_actions, ci AS candidate_index FROM ded"
    )
    placed = f"CASE verdict {_MAP} ELSE 'inconclusive' END AS v"
    q["answered_triage"] = answered.replace(placed, f"CASE verdict {_ENUM} ELSE 'inconclusive' END AS v").replace(
        "AS dkey FROM idx)", "AS dkey FROM idx WHERE ci % 9 IN (0, 1, 2, 3, 5) AND len(reasons) > 0)"
    )
    q["triage_request_ids"] = tri_q("SELECT DISTINCT dkey AS dedup_key, CASE WHEN trim(request_id) = '' THEN '-' ELSE trim(request_id) END AS request_id FROM res")
    q["error_members"] = req_q(
        f"SELECT {ident('request_id')} AS request_id, source_table, id, {ident('error_link_id')} AS error_link_id, "
        f"md5(CASE WHEN source_table = 'error' THEN log_text ELSE '' END) AS log_md5 FROM req WHERE {ident('request_id')} <> '' AND {ident('request_id')} IN "
        f"(SELECT {ident('request_id')} FROM req WHERE source_table = 'security') AND {ident('request_id')} IN (SELECT {ident('request_id')} FROM req WHERE source_table = 'error')",
        "security,error",
    )
    q["parse_responses"] = tri_q(
        f"SELECT ci AS candidate_index, CASE WHEN ci % 9 IN (2, 5) THEN 'outer_object' ELSE 'direct' END AS strategy, CASE verdict {_ENUM} ELSE 'inconclusive' END AS verdict, "
        "CASE WHEN ci % 9 = 6 THEN 'extreme' ELSE sev END AS severity, 'low' AS confidence, 1 AS false_positive_possible, 'saw \"}\" in ' || uri AS reasoning_summary, "
        "least(8, len(reasons)) AS evidence, 'review_raw_log' AS recommended_actions FROM res WHERE ci % 9 IN (0, 1, 2, 3, 5, 6)"
    )
    kind = "CASE WHEN ci % 9 = 8 THEN {} WHEN ci % 18 = 7 THEN {} ELSE {} END"
    plain = (
        f"to_json({{'verdict': CASE verdict {_ENUM} ELSE 'inconclusive' END, 'severity': sev, 'confidence': 'low', 'false_positive_possible': true, "
        "'reasoning_summary': 'saw \"}\" in ' || uri, 'evidence_fields': list_sort(reasons)[1:8], 'recommended_actions': ['review_raw_log']})"
    )
    excerpt = f"left(CASE WHEN ci % 9 = 8 THEN '' WHEN ci % 18 = 7 THEN '[1, 2]' WHEN ci % 9 = 7 THEN 'no object at all' ELSE left({plain}::VARCHAR, len({plain}::VARCHAR) - 5) END, 1500)"
    q["triage_errors"] = tri_q(
        "SELECT ci AS candidate_index, request_id, 'rules' AS model, 'resp-' || ci AS response_id, "
        + kind.format("'empty_output'", "'unexpected_error'", "'json_decode_error'") + " AS error_type, "
        + kind.format("'no output text'", "'JSON root is not an object'", "'no JSON object found'") + " AS error_message, "
        f"len({excerpt}) AS excerpt_length, left({excerpt}, 10) AS excerpt_start FROM res WHERE ci % 9 IN (4, 7, 8)"
    )
    def part(name: str, sql: str) -> str:
        return f"SELECT {s(name)} AS section, * FROM ({sql})"

    def shown(*fields: str) -> str:
        return "concat_ws('|', " + ", ".join(f"coalesce(({f})::VARCHAR, '')" for f in fields) + ") AS item"

    dist = q["triage_distributions"].split("SELECT 'verdicts'", 1)[1]
    errors = "ci % 9 IN (4, 7, 8)"
    number = [
        "(SELECT count(*) FROM judged)", "(SELECT count(*) FROM inc)", "(SELECT count(*) FROM ded)", "(SELECT count(*) FROM left_out)", "(SELECT count(*) FROM through)",
        "(SELECT count_if(n >= 3) FROM ngrp)", "(SELECT count(*) FROM sup)", "(SELECT count(*) FROM review)", "(SELECT count(*) FROM bursts)", "(SELECT count(*) FROM res)",
        f"(SELECT count(*) FROM res WHERE {errors})",
    ]
    q["report_input"] = tri_q(
        " UNION ALL ".join([
            part("analysis_context", "SELECT 'Asia/Seoul||" "|routine|rules' AS item"),
            part("pipeline_counts", f"SELECT {shown(*number)}"),
            part("distributions", f"SELECT {shown('distribution', 'value', 'count')} FROM (SELECT 'verdicts'{dist})"),
            part("filtered_out_breakdown", f"SELECT {shown('noise', 'count(*)')} FROM left_out GROUP BY noise"),
            part("top_incidents", f"SELECT {shown('rk', 'ref', 'v', 'sev', 'score')} FROM ded WHERE rk <= 12"),
            part(
                "top_src_ips",
                f"SELECT {shown('src_ip', 'incident_count', 'raw', 'msev')} FROM (SELECT b.*, r.raw FROM byip b JOIN rawip r ON r.src_ip = b.src_ip "
                "ORDER BY sr DESC, incident_count DESC, b.src_ip LIMIT 8)",
            ),
            part(
                "top_noise_groups",
                f"SELECT {shown('noise', 'src_ip', 'uri', 'n')} FROM (SELECT * FROM ngrp WHERE n >= 3 ORDER BY n DESC, noise DESC, src_ip DESC, uri, method, status_code, user_agent LIMIT 8)",
            ),
            part("top_filtered_categories", f"SELECT {shown('category', 'count')} FROM shr"),
            part("top_out_of_candidate_recon", f"SELECT {shown('category', 'count')} FROM shr WHERE category IN ('low_signal_fuzzing', 'low_signal_dir_probe')"),
            part(
                "probing_sequence_summaries",
                f"SELECT {shown('src_ip', 'request_count', 'distinct_path_count', s(rules.BURST_NOTE))} FROM "
                "(SELECT * FROM bursts ORDER BY request_count DESC, distinct_path_count DESC, start_ms DESC, src_ip LIMIT 10)",
            ),
            part("supporting_events", f"SELECT {shown('source_table', 'id', 'n')} FROM (SELECT * FROM sup ORDER BY n DESC, log_time DESC, pos, id LIMIT 20)"),
            part("false_positive_review_candidates", f"SELECT {shown('source_table', 'id')} FROM (SELECT * FROM review ORDER BY pos, log_time, id LIMIT 20)"),
            part("matched_known_assets", f"SELECT {shown('src_ip', 'count(*)')} FROM ded WHERE known GROUP BY src_ip"),
            part("asset_context", f"SELECT {shown(s(','.join(W.KNOWN_ASSETS)), 'count_if(known)')} FROM ded"),
            part("stage1_errors_excerpt", f"SELECT {shown('ci', kind.format(s('empty_output'), s('unexpected_error'), s('json_decode_error')))} FROM (SELECT ci FROM res WHERE {errors} ORDER BY ci LIMIT 5)"),
        ]),
        NOISE, review(), SUPPORT, BURSTS, top, share,
    )
    # streams
    q["stream_candidates"] = judged_q(f"SELECT source_table, id, score, verdict AS verdict_hint, {joined('reasons')} AS reason_hints FROM cand")
    q["stream_noise_windows"] = judged_q(
        "SELECT (epoch_ms(log_time) // 120000) * 120000 AS window_start_ms, noise AS noise_category, count(*) AS count FROM left_out GROUP BY ALL"
    )
    q["stream_bursts"] = q["probing_bursts"]
    return q
