"""Apache access, security and error log lines to typed rows.

Each parser takes a frame with a column ``value`` (one line per row, batch or stream)
and returns good rows; the matching ``*_rejects`` returns the lines that do not parse.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from logsieve import rules
from logsieve.functions import text as T
from logsieve.functions.stage import where_once

c = F.col
ACCESS_TIME = "dd/MMM/yyyy:HH:mm:ss Z"
ERROR_TIMES = ["yyyy-MM-dd HH:mm:ss", "MMM dd HH:mm:ss yyyy"]  # fraction taken off first


def _line() -> Column:
    return F.regexp_replace("value", r"\n+\z", "")


def unquoted(text: Column) -> Column:
    """Trimmed text without one pair of enclosing quotes."""
    t = T.trim_all(text)
    quoted = (F.length(t) >= 2) & t.startswith('"') & t.endswith('"')
    return F.when(quoted, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)


def dash_null(text: Column) -> Column:
    return F.nullif(unquoted(text), F.lit("-"))


def int_or_null(text: Column) -> Column:
    t = T.trim_all(unquoted(text))
    return F.when(t.rlike(r"^[+-]?\d+(?:_\d+)*\z"), F.replace(t, F.lit("_"), F.lit(""))).try_cast(
        "bigint"
    )


def tri_state(text: Column) -> Column:
    t = F.lower(T.trim_all(unquoted(text)))
    return (
        F.when(t.isin("1", "true", "yes"), 1).when(t.isin("0", "false", "no"), 0).cast("tinyint")
    )


def _millis(ts: Column) -> Column:
    return F.date_trunc("millisecond", ts)


# ------------------------------------------------------------------ access


def _access(lines: DataFrame) -> DataFrame:
    line = lines.withColumn("raw_log", _line())
    groups = [F.regexp_extract("raw_log", rules.ACCESS_LINE, i) for i in range(1, 10)]
    names = ["client_ip", "time", "request", "status", "bytes", "referer", "ua", "host", "vhost"]
    return line.withColumn("parsed", c("raw_log").rlike(rules.ACCESS_LINE)).withColumns(
        {f"p_{n}": g for n, g in zip(names, groups)}
    )


def parse_access(lines: DataFrame) -> DataFrame:
    df = _access(lines).where("parsed").withColumn("raw_request", dash_null(c("p_request")))
    df = df.withColumn("parts", F.split("raw_request", " ", 3))
    n = F.when(c("raw_request") != "", F.size("parts"))
    full = F.get("parts", F.lit(1))
    has_query = full.contains("?")
    path = F.substring_index(full, "?", 1)
    stamp = F.regexp_replace("p_time", r"\s+", " ")
    return df.select(
        _millis(F.try_to_timestamp(stamp, F.lit(ACCESS_TIME))).alias("log_time"),
        dash_null(c("p_client_ip")).alias("client_ip"),
        F.when(n >= 2, F.get("parts", F.lit(0))).alias("method"),
        "raw_request",
        F.when((n == 3) & has_query, path).when(n >= 2, full).alias("uri"),
        F.when((n == 3) & has_query, F.substring(full, F.length(path) + 1, F.length(full)))
        .when(n == 3, F.lit("")).alias("query_string"),
        F.when(n == 3, F.get("parts", F.lit(2))).alias("protocol"),
        int_or_null(c("p_status")).alias("status_code"),
        int_or_null(c("p_bytes")).alias("response_body_bytes"),
        dash_null(c("p_referer")).alias("referer"),
        dash_null(c("p_ua")).alias("user_agent"),
        dash_null(c("p_host")).alias("host"),
        dash_null(c("p_vhost")).alias("vhost"),
        "raw_log",
    )


def access_rejects(lines: DataFrame) -> DataFrame:
    return _access(lines).where("not parsed").select("raw_log")


# ---------------------------------------------------------------- security


def _security(lines: DataFrame) -> DataFrame:
    """Adds ``names`` and ``vals``, the keys and values of the line, last one first.

    Looking a name up in the reversed list finds its last value, as wanted.
    """
    line = lines.withColumn("raw_log", _line())

    def found(group: int) -> Column:
        return F.reverse(
            F.regexp_extract_all("raw_log", F.lit("(?U)" + rules.KEY_VALUE), F.lit(group))
        )

    return line.withColumns({"names": found(1), "vals": found(2)})


def _value(name: str) -> Column:
    at = F.array_position("names", name)
    return F.get("vals", (F.nullif(at, F.lit(0)) - 1).cast("int"))


def iso_time(text: Column) -> Column:
    """ISO time with seconds and a zone offset, as the log format writes it."""
    t = unquoted(text)
    shape = r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,6})?(?:Z|[+-]\d\d:?\d\d)\z"
    zoned = F.regexp_replace(t, r"([+-]\d\d)(\d\d)\z", "$1:$2")
    return F.when(t.rlike(shape), zoned).try_cast("timestamp")


def parse_security(lines: DataFrame) -> DataFrame:
    fields = [*rules.SECURITY_TEXT_FIELDS, *rules.SECURITY_INT_FIELDS]
    extra = ["log_time", "resp_html_baseline_match"]
    df = where_once(_security(lines), F.size("names") > 0)
    df = df.select("raw_log", *[_value(n).alias(f"v_{n}") for n in [*fields, *extra]])
    df = df.select("raw_log", *[T.trim_all(c(f"v_{n}")).alias(f"v_{n}") for n in [*fields, *extra]])
    text = {n: dash_null(c(f"v_{n}")) for n in rules.SECURITY_TEXT_FIELDS}
    numbers = {n: int_or_null(c(f"v_{n}")) for n in rules.SECURITY_INT_FIELDS}
    both = text | numbers
    order = [
        "request_id", "error_link_id", "vhost", "src_ip", "peer_ip", "method", "raw_request",
        "uri", "query_string", "protocol", "status_code", "response_body_bytes", "in_bytes",
        "out_bytes", "total_bytes", "duration_us", "ttfb_us", "keepalive_count",
        "connection_status", "req_content_type", "req_content_length", "resp_content_type",
        "referer", "user_agent", "host", "x_forwarded_for",
    ]
    html = [
        "resp_html_norm_fingerprint", "resp_html_fingerprint_version", "resp_html_baseline_name",
    ]
    return df.select(
        _millis(iso_time(c("v_log_time"))).alias("log_time"),
        *[both[n].alias(n) for n in order],
        F.lit("unknown").alias("attack_label"),
        F.lit(0.0).alias("risk_score"),
        F.lit(None).cast("string").alias("matched_rule"),
        F.lit(False).alias("is_suspicious"),
        *[both[n].alias(n) for n in html],
        tri_state(c("v_resp_html_baseline_match")).alias("resp_html_baseline_match"),
        *[
            both[n].alias(n)
            for n in ("resp_html_baseline_confidence", "resp_html_features_json")
        ],
        "raw_log",
    )


def security_rejects(lines: DataFrame) -> DataFrame:
    return where_once(_security(lines), F.size("names") == 0).select("raw_log")


# ------------------------------------------------------------------- error


def error_time(text: Column) -> Column:
    t = T.trim_all(text)
    no_weekday = F.regexp_replace(t, r"^[A-Za-z]{3}\s+(?=[A-Za-z]{3}\s)", "")
    flat = F.regexp_replace(no_weekday, r"\s+", " ")
    padded = F.regexp_replace(flat, r"^([A-Za-z]{3}) (\d) ", "$1 0$2 ")
    digits = F.length(F.regexp_extract(padded, r"\.(\d{1,6})", 1))
    full = F.regexp_replace(padded, r"\.(\d{1,6})", "")
    micros = F.rpad(F.regexp_extract(padded, r"\.(\d{1,6})", 1), 6, "0").cast("int")
    whole = F.coalesce(
        *[
            F.try_to_timestamp(full, F.lit(f)) for f in ERROR_TIMES
        ]
    )
    return F.when(
        digits > 0, F.timestamp_micros(F.unix_micros(whole) + micros)
    ).otherwise(whole)


def _error(lines: DataFrame) -> DataFrame:
    line = lines.withColumn("raw_log", _line())
    names = [
        "time", "error_link_id", "request_id", "module_name", "log_level", "src_ip", "peer_ip",
        "message",
    ]
    df = line.withColumns(
        {f"p_{n}": F.regexp_extract("raw_log", rules.ERROR_LINE, i + 1)
         for i, n in enumerate(names)}
    )
    time = _millis(error_time(c("p_time")))
    return df.withColumn("log_time", F.when(c("raw_log").rlike(rules.ERROR_LINE), time))


def parse_error(lines: DataFrame) -> DataFrame:
    names = [
        "error_link_id", "request_id", "module_name", "log_level", "src_ip", "peer_ip", "message",
    ]
    return where_once(_error(lines), c("log_time").isNotNull()).select(
        "log_time", *[dash_null(c(f"p_{n}")).alias(n) for n in names], "raw_log"
    )


def error_rejects(lines: DataFrame) -> DataFrame:
    return where_once(_error(lines), c("log_time").isNull()).select("raw_log")


PARSERS = {"access": parse_access, "security": parse_security, "error": parse_error}
REJECTS = {"access": access_rejects, "security": security_rejects, "error": error_rejects}
LINE_SCHEMA = ST.StructType([ST.StructField("value", ST.StringType())])
