"""Risk score, verdict and noise category of every request.

What follows from the texts of the request line alone is found once for each distinct line
(``with_line_facts``) and joined; the rest is one chain of projections, closed by a stage border.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve import rules
from logsieve.functions import paths as P
from logsieve.functions import text as T
from logsieve.functions.stage import hold
from logsieve.operators import context as C
from logsieve.operators import signatures as S
from logsieve.operators import texts as X
from logsieve.sources.store import materialize

c = F.col


def early_noise(is_static: Column | None = None) -> Column:
    """Session polling and static files that leave before any scoring.

    ``is_static``: whether the uri is a static file's, where that is known already.
    """
    if is_static is None:
        is_static = P.is_static_uri(c("uri"))
    joined = F.lower(F.concat_ws(" ", c("uri"), c("request_text"), c("query")))
    polling = (
        c("source_table").isin("access", "security")
        & F.lower("uri").startswith("/socket.io/")
        & (c("status_code") == 200)
        & (c("error_link_id") == "")
        & (joined.contains("transport=polling") | joined.contains("eio="))
        & P.is_browser(c("user_agent"))
    )
    attack = F.when(polling, S.any_attack_as_logged(joined))
    static = (
        (c("source_table") == "access") & is_static & (c("status_code") == 200)
    )
    return (
        F.when(polling & ~F.coalesce(attack, F.lit(True)), F.lit("socketio_polling"))
        .when(static, F.lit("static_asset"))
    )


#: The texts of a request line. A log repeats them, unlike the logged line with its time.
LINE = ["raw_request", "request_text", "uri", "query_raw", "query", "target"]


def line_facts(df: DataFrame) -> DataFrame:
    """Everything that follows from ``LINE`` alone."""
    df = X.with_text_parts(X.with_entity_forms(X.with_decode_depths(df)))
    df = C.with_depth_facts(df).drop("q_entities", "t_entities")
    q = c("query")
    df = df.withColumns(
        {
            "probe_path": F.lower(P.effective_path(c("uri"), c("target"))),
            "target_path": P.path_of(c("target")),
            "is_static": P.is_static_uri(c("uri")),
            "is_login": P.is_login_uri(c("uri")),
            "is_query_heavy": P.is_query_heavy_uri(c("uri")),
            "hpp_param_names": P.repeated_params(q),
            "special_15": T.special_ratio_at_least(q, 15),
            "special_30": T.special_ratio_at_least(q, 30),
            "worded_sql": C.learning_sql(q),
            "worded_xss": C.learning_xss(C.learning_texts()),
            "query_xss": C.query_xss_hints(),
        }
    )
    path = c("probe_path")
    return df.withColumns(
        {
            "hpp_detected": F.size("hpp_param_names") > 0,
            "query_tokens": c("is_query_heavy") & (q != "") & T.matches(q, rules.QUERY_ATTACK_TOKENS),
            "probed_path": P.has_hidden_segment(path)
            | T.contains_any(path, rules.DIR_PROBE_PATH)
            | T.contains_any(path, rules.DIR_PROBE_FILE),
        }
    )


def with_line_facts(df: DataFrame) -> DataFrame:
    """Adds ``line_facts``, found once for each distinct line. A stream has no distinct lines and finds them row by row.

    The distinct lines are written, so Spark knows their size: it broadcasts few, and for many it sorts both sides
    and splits the rows of a frequent line among tasks. They are dealt out by number: a line costs much time for its
    bytes, and Spark would put few bytes into one task.
    """
    if df.isStreaming:
        return line_facts(df)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    facts = line_facts(df.select(*LINE).distinct().repartition(tasks))
    found = [n for n in facts.columns if n not in LINE]
    line = F.struct(*LINE).alias("line")
    stored = materialize(facts.select(line, *found), "line-facts")
    return df.select("*", line).join(stored, "line", "left").drop("line")


def with_analysis(df: DataFrame) -> DataFrame:
    """Texts, signature hits and context flags."""
    df = with_line_facts(df).withColumn("stored_uri", c("uri_text"))
    df = df.withColumns({"early_noise": early_noise(c("is_static")), "is_browser": P.is_browser(c("user_agent"))})
    df = X.with_combined_text(df)
    df = df.withColumn("scan_text", F.when(c("early_noise").isNull(), c("combined")))
    df = df.withColumn("combined_low", S.ascii_lower(c("combined")))
    df = df.withColumn("scan_text_low", F.when(c("early_noise").isNull(), c("combined_low")))
    df = S.with_hits(df, ("sqli", "xss", "cmdi"), "scan_text")
    df = S.with_hits(df, ("traversal", "ua"), "combined")
    df = df.withColumns({f"{fam}_hits": S.hit_count(fam) for fam in S.FAMILIES})
    return C.with_file_disclosure(C.with_encoding_flags(df))


def with_fallback_flags(df: DataFrame) -> DataFrame:
    """For traversal hits: was the path rewritten, does the answer look like a fallback page?"""
    some = c("traversal_hits") > 0
    kind = F.lower("resp_content_type")
    stored = c("stored_uri")
    ok = c("status_code") == 200
    fallback = some & ok & kind.startswith("text/html") & (c("response_body_bytes") >= 10000)
    return df.withColumns(
        {
            "path_normalized": some
            & (c("target_path") != "") & (stored != "") & (c("target_path") != stored),
            "html_fallback": fallback,
            "file_like": some & ~fallback & ok
            & (kind.startswith("text/plain") | kind.contains("octet-stream")),
        }
    )


def with_wording(df: DataFrame) -> DataFrame:
    """Learning-search wording and the structures that would contradict it."""
    edu_sql = (c("sqli_hits") > 0) & c("worded_sql")
    edu_xss = (c("xss_hits") > 0) & c("worded_xss")
    df = df.withColumns({"edu_sql": edu_sql, "edu_xss": edu_xss})
    sql = C.sqli_structure(C.structure_forms(c("combined")))
    xss = C.xss_structure(c("entity_script"))

    def gated(flag: str, cond: Column) -> Column:
        return F.when(c(flag), cond).otherwise(False)

    df = df.withColumns(
        {f"ss_{n}": gated("edu_sql", v) for n, v in sql.items()}
        | {f"xs_{n}": gated("edu_xss", v) for n, v in xss.items()}
    )
    return df.withColumns(
        {
            "strong_sql": T.any_of(c(f"ss_{n}") for n in sql if n != "from_users"),
            "strong_xss": T.any_of(c(f"xs_{n}") for n in xss if n != "script_tag"),
        }
    )


def with_login_flags(df: DataFrame) -> DataFrame:
    success = (
        c("is_login") & (c("method") == "POST") & (c("status_code") == 200)
        & P.is_json_type(c("req_content_type")) & P.is_json_type(c("resp_content_type"))
        & (c("response_body_bytes") >= 300)
    )
    df = df.withColumn("login_success", success)
    words = C.has_attack_words(c("user_agent"), c("request_text"), c("log_text"), c("query"))
    return df.withColumn("attack_words", F.when(c("login_success"), words).otherwise(False))


def score_terms() -> list[tuple[Column, int, Column]]:
    """(condition, points, reason) of every additive term after the signatures."""
    q = c("query")
    headless = (c("referer") == "") & ~c("is_browser")
    bypass = c("login_success") & c("attack_words")

    def term(cond: Column, points: int, label: str):
        return cond, points, F.lit(f"{label}(+{points})")

    status = F.concat(F.lit("error_status:"), c("status_code"), F.lit("(+2)"))
    body = F.lower("req_content_type").isin(rules.AUTH_BODY_TYPES)
    return [
        term(F.length(q) >= 40, 1, "long_query"),
        term(F.length(q) >= 80, 1, "very_long_query"),
        term(c("special_15"), 1, "special_char_ratio_high"),
        term(c("special_30"), 1, "special_char_ratio_very_high"),
        (c("status_code").isin(rules.ERROR_STATUSES), 2, status),
        term(c("error_link_id") != "", 2, "error_linked"),
        term(c("duration_us") >= 2_000_000, 3, "high_duration"),
        term(c("duration_us") >= 5_000_000, 2, "very_high_duration"),
        term(c("ttfb_us") >= 2_000_000, 2, "high_ttfb"),
        term(c("is_login"), 1, "login_endpoint"),
        term(c("query_tokens"), 2, "query_endpoint_with_attack_tokens"),
        term(body & c("is_login"), 1, "auth_payload_content_type"),
        term(headless & (c("status_code") >= 400), 1, "no_referer_non_browser_error"),
        term(bypass, 2, "login_success_json_response"),
        term(bypass, 1, "possible_auth_bypass_success"),
        term(
            c("login_success") & headless & (c("attack_words") | (c("ua_hits") > 0)),
            1, "no_referer_non_browser_login",
        ),
        term(c("source_table") == "error", 2, "error_table_context"),
    ]


def with_score(df: DataFrame) -> DataFrame:
    points = sum((S.hit_points(fam) for fam in S.FAMILIES), F.lit(0)) + c("fd_points")
    points = points + F.when(c("hpp_detected"), 1).otherwise(0)
    for cond, worth, _ in score_terms():
        points = points + F.when(cond, F.lit(worth)).otherwise(0)
    df = df.withColumn("score", points)
    sql_off = F.when(
        c("edu_sql") & ~c("strong_sql"), F.when(c("ss_from_users"), 2).otherwise(4)
    )
    df = df.withColumn(
        "score",
        F.when(sql_off.isNotNull(), F.greatest(F.lit(0), c("score") - sql_off)).otherwise(
            c("score")
        ),
    )
    xss_off = c("edu_xss") & ~c("strong_xss")
    return df.withColumn(
        "score",
        F.when(xss_off, F.greatest(F.lit(0), c("score") - 4)).otherwise(c("score")),
    )


def noise_category() -> Column:
    """Category of a request that does not become a candidate."""
    q, status = c("query"), c("status_code")
    no_attack = (c("sqli_hits") + c("xss_hits") + c("cmdi_hits")) == 0
    one_traversal = c("traversal_hits") == 1
    clean = no_attack & (c("traversal_hits") == 0)
    linked = c("error_link_id") != ""

    fallback = c("html_fallback") & one_traversal & no_attack & ~linked

    low_traversal = one_traversal & (
        status.isin(401, 403, 404, 405) | c("path_normalized") | c("html_fallback")
    )
    path = c("probe_path")
    looks_probed = c("probed_path") | low_traversal
    probe = (
        c("method").isin("GET", "HEAD", "OPTIONS")
        & no_attack & ~c("is_query_heavy") & (F.length(q) < 20)
        & (path != "") & (path != "/")
        & looks_probed
        & (
            status.isin(301, 302, 401, 403, 404, 405)
            | c("html_fallback")
            | ((status == 200) & ~c("is_browser") & (c("referer") == ""))
        )
    )
    search = (
        clean & ~linked & c("method").isin("GET", "HEAD")
        & status.isin(200, 204, 304, 404) & c("is_browser") & (q != "")
        & (c("is_query_heavy") | status.isin(200, 304) | (c("referer") != ""))
    )

    def one(cond: Column) -> Column:
        return cond.cast("int")

    signals = (
        F.when(~no_attack, 2).when(c("traversal_hits") > 0, 1).otherwise(0)
        + one(F.length(q) >= 20)
        + one(c("special_15"))
        + one(c("hpp_detected"))
        + one(~c("is_browser"))
        + one((c("referer") == "") & (status >= 400))
        + one(~c("method").isin("GET", "POST", "HEAD", "OPTIONS"))
    )
    fuzzing = ~linked & ~(c("is_query_heavy") & c("is_browser") & clean) & (signals >= 2)
    return (
        F.when(fallback, F.lit("benign_fallback_html"))
        .when(probe, F.lit("low_signal_dir_probe"))
        .when(search, F.lit("benign_normal_search"))
        .when(fuzzing, F.lit("low_signal_fuzzing"))
        .when(c("is_browser"), F.lit("benign_normal_search"))
        .otherwise(F.lit("low_signal_fuzzing"))
    )


def verdict(min_score: int) -> Column:
    """Ordered decision list; NULL means the request is not a candidate."""
    score = c("score")
    enough = score >= min_score
    seven, six = score >= max(min_score, 7), score >= max(min_score, 6)
    fallback = (
        c("html_fallback") & (c("traversal_hits") == 1)
        & ((c("sqli_hits") + c("xss_hits") + c("cmdi_hits")) == 0)
        & (c("error_link_id") == "")
    )
    nothing = F.lit(None).cast("string")
    config = c("probe_path").isin("/config.php", "/admin/config.php") & ~c("fd_wrapper")
    return (
        F.when(c("early_noise").isNotNull() | fallback, nothing)
        .when(
            c("edu_sql") & ~c("strong_sql"),
            F.when(enough, F.lit("possible_false_positive_sql_keyword_search")),
        )
        .when(
            c("edu_xss") & ~c("strong_xss"),
            F.when(enough, F.lit("possible_false_positive_xss_keyword_search")),
        )
        .when((c("xss_hits") > 0) & seven, F.lit("xss"))
        .when((c("sqli_hits") > 0) & seven, F.lit("sqli"))
        .when((c("traversal_hits") > 0) & six, F.lit("path_traversal"))
        .when((c("cmdi_hits") > 0) & six, F.lit("command_injection"))
        .when(c("fd_wrapper") & six, F.lit("suspicious_file_disclosure"))
        .when(c("login_success") & enough, F.lit("suspicious_auth_success"))
        .when(enough & ~config, F.lit("suspicious"))
    )


def embedded_attack() -> Column:
    sql, xss = c("sqli_hits") > 0, c("xss_hits") > 0
    return (
        F.when(~c("hpp_detected"), F.lit(""))
        .when(sql & xss, F.lit("multiple"))
        .when(sql, F.lit("sqli"))
        .when(xss, F.lit("xss"))
        .otherwise(F.lit(""))
    )


def reason_hints() -> Column:
    """Ordered, distinct reasons of a request."""
    none = F.array().cast("array<string>")

    def labels(*pairs) -> list[Column]:
        return [F.when(cond, text if isinstance(text, Column) else F.lit(text))
                for cond, text in pairs]

    xss_worth = T.contains_any(c("combined_low"), C.XSS_NEEDS) | c("combined_low").isNull()
    embedded = embedded_attack()
    parts = F.concat(
        F.array(*S.hit_labels(S.FAMILIES), *C.encoding_hints(), *C.file_disclosure_hints()),
        F.when(xss_worth, C.xss_context_hints(c("combined_low"), known=True)).otherwise(none),
        F.array(
            *labels(
                (c("hpp_detected"), "hpp:duplicate_param_names(+1)"),
                (
                    c("hpp_detected"),
                    F.concat(F.lit("hpp:param_names="), F.array_join("hpp_param_names", ",")),
                ),
                *[(cond, reason) for cond, _, reason in score_terms()],
                (c("edu_sql"), "context:educational_sql_search"),
                (c("edu_sql"), "context:natural_language_query"),
                (c("edu_sql") & ~c("ss_quote_termination"), "no_quote_termination"),
                (c("edu_sql") & ~c("ss_sql_comment"), "no_sql_comment"),
                (c("edu_sql") & ~c("ss_boolean_condition"), "no_boolean_condition"),
                (
                    c("edu_sql") & ~c("strong_sql"),
                    "fp_hint:sql_keyword_without_attack_structure",
                ),
                (c("edu_xss"), "context:educational_xss_search"),
                (c("edu_xss"), "context:natural_language_query"),
                (
                    c("edu_xss") & ~c("xs_event_handler_assignment"),
                    "no_event_handler_assignment",
                ),
                (c("edu_xss") & ~c("xs_javascript_protocol"), "no_javascript_protocol"),
                (c("edu_xss") & ~c("xs_browser_data_access"), "no_browser_data_access"),
                (
                    c("edu_xss") & ~c("strong_xss"),
                    "fp_hint:xss_keyword_without_attack_structure",
                ),
                (embedded != "", F.concat(F.lit("hpp:embedded_attack="), embedded)),
                (c("path_normalized"), "traversal:raw_request_uri_diff"),
                (c("html_fallback"), "traversal:html_fallback_like_response"),
                (c("file_like"), "traversal:file_like_response_type"),
            )
        ),
    )
    return F.array_except(parts, F.array(F.lit(None).cast("string")))


def judge(requests: DataFrame, min_score: int = rules.MIN_SCORE) -> DataFrame:
    """Canonical requests with ``score``, ``verdict_hint`` and ``noise_category``.

    Exactly one of verdict and category is set.
    """
    df = with_login_flags(with_wording(with_fallback_flags(with_analysis(requests))))
    df = hold(
        with_score(df),
        {
            "verdict_hint": verdict(min_score),
            "noise_if_filtered": F.coalesce(c("early_noise"), noise_category()),
        },
    )
    return df.withColumn(
        "noise_category", F.when(c("verdict_hint").isNull(), c("noise_if_filtered"))
    ).drop("noise_if_filtered")


CANDIDATE_COLUMNS = [
    "source_table", "source_position", "id", "log_time", "src_ip", "method", "uri", "query",
    "status_code", "score", "verdict_hint", "reason_hints", "request_id", "error_link_id",
    "request_text", "user_agent", "referer", "duration_us", "ttfb_us", "log_text",
    "response_body_bytes", "resp_content_type", "target", "path_normalized", "html_fallback",
    "hpp_detected", "hpp_param_names", "embedded_attack_hint",
]


def candidates(judged: DataFrame) -> DataFrame:
    """Requests worth a closer look, with their reasons."""
    found = judged.where("verdict_hint is not null")
    return hold(
        found,
        {
            "reason_hints": reason_hints(),
            "embedded_attack_hint": embedded_attack(),
            "uri": T.first_text(c("uri"), F.lit("-")),
        },
    ).select(*CANDIDATE_COLUMNS)


FILTERED_COLUMNS = [
    "source_table", "source_position", "id", "noise_category", "log_time", "src_ip", "method",
    "uri", "query_raw", "query", "status_code", "request_id", "error_link_id",
    "response_body_bytes", "duration_us", "ttfb_us", "resp_content_type", "user_agent",
    "raw_request", "target", "path_normalized", "html_fallback", "hpp_detected",
    "hpp_param_names", "probe_path",
]


def filtered(judged: DataFrame) -> DataFrame:
    """Requests left out, each with its noise category."""
    return judged.where("verdict_hint is null").select(*FILTERED_COLUMNS)


def filtered_rows(left_out: DataFrame) -> DataFrame:
    """Output form of left-out rows, with path hints."""
    held = left_out.withColumn("hint_path", F.lower(T.norm(c("probe_path"))))
    return held.withColumn("reason_hints", P.probe_hints(c("hint_path"))).drop("hint_path")


def high_signal_sqli(rows: DataFrame, min_score: int = rules.MIN_SCORE) -> DataFrame:
    return rows.where((c("verdict_hint") == "sqli") & (c("score") >= max(min_score, 7)))
