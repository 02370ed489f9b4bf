"""The derived log written back as log lines, some of them broken on purpose."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def _ev() -> Column:
    return c("id") - 1


def _broken() -> Column:
    return _ev() % 50 == 7


def _bad_time() -> Column:
    return _ev() % 40 == 9


def _kst(fmt: str) -> Column:
    return F.date_format(F.from_utc_timestamp("log_time", "Asia/Seoul"), fmt)


def access_lines(log: DataFrame) -> DataFrame:
    return log.select(
        F.when(_broken(), F.concat(c("src_ip"), F.lit(' - - [x] "'), c("raw_request")))
        .otherwise(c("raw_log")).alias("value")
    )


def security_lines(log: DataFrame) -> DataFrame:
    def pair(name: str, value: Column, quote: bool = False) -> Column:
        shown = F.coalesce(value.cast("string"), F.lit("-"))
        if quote:
            shown = F.concat(F.lit('"'), F.replace(shown, F.lit('"'), F.lit('\\"')), F.lit('"'))
        return F.concat(F.lit(f"{name}="), shown)

    time = F.when(_bad_time(), F.lit("bad")).otherwise(
        F.concat(_kst("yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+0900"))
    )
    line = F.concat_ws(
        " ",
        pair("log_time", time, True), F.lit("method=DUMMY"),
        pair("request_id", c("request_id")), pair("error_link_id", c("error_link_id")),
        F.lit("vhost=main"), pair("src_ip", c("src_ip")), pair("method", c("method")),
        pair("raw_request", c("raw_request"), True), pair("uri", c("uri"), True),
        pair("query_string", c("query_string"), True), F.lit("protocol=HTTP/1.1"),
        pair("status_code", c("status_code")),
        pair("response_body_bytes", c("response_body_bytes")),
        pair("duration_us", c("duration_us")), pair("ttfb_us", c("ttfb_us")),
        F.lit("keepalive_count=x1"), pair("req_content_type", c("req_content_type")),
        pair("resp_content_type", c("resp_content_type"), True),
        pair("referer", c("referer"), True), pair("user_agent", c("user_agent"), True),
        F.lit('resp_html_baseline_match="TRUE" note="say \\"hi\\" twice"'),
    )
    return log.select(
        F.when(_broken(), F.concat(F.lit("nothing to see "), c("id"))).otherwise(line).alias("value")
    )


def error_lines(log: DataFrame) -> DataFrame:
    def fmt(pattern: str) -> Column:
        return F.date_format("log_time", pattern)

    time = (
        F.when(_broken(), F.lit("yesterday"))
        .when(_ev() % 4 == 0, fmt("yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(_ev() % 4 == 1, fmt("yyyy-MM-dd HH:mm:ss"))
        .when(_ev() % 4 == 2, fmt("EEE MMM dd HH:mm:ss.SSSSSS yyyy"))
        .otherwise(fmt("EEE MMM dd HH:mm:ss yyyy"))
    )
    dash = F.lit("-")
    return log.select(
        F.concat(
            F.lit("["), time, F.lit("] [error_link_id:"), F.coalesce("error_link_id", dash),
            F.lit("] [request_id:"), F.coalesce("request_id", dash),
            F.lit("] [module_name:core] [log_level:error] [src_ip:"), c("src_ip"),
            F.lit(" peer_ip:"), c("src_ip"), F.lit("] message=File does not exist: "), c("uri"),
        ).alias("value")
    )
