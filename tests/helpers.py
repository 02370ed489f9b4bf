"""Small hand-made request tables."""

from datetime import datetime, timedelta

from pyspark.sql import types as ST

from logsieve.operators import canon

T0 = datetime(2026, 4, 1, 15)
BROWSER = "Mozilla/5.0 (X11)"
FIELDS = [
    ("id", ST.LongType()), ("log_time", ST.TimestampType()), ("src_ip", ST.StringType()),
    ("method", ST.StringType()), ("uri", ST.StringType()), ("query_string", ST.StringType()),
    ("raw_request", ST.StringType()), ("status_code", ST.LongType()),
    ("response_body_bytes", ST.LongType()), ("duration_us", ST.LongType()),
    ("ttfb_us", ST.LongType()), ("req_content_type", ST.StringType()),
    ("resp_content_type", ST.StringType()), ("user_agent", ST.StringType()),
    ("referer", ST.StringType()), ("request_id", ST.StringType()),
    ("error_link_id", ST.StringType()), ("raw_log", ST.StringType()),
]
SCHEMA = ST.StructType([ST.StructField(n, t) for n, t in FIELDS])


def row(i, target, at=0.0, **other):
    path, _, query = target.partition("?")
    method = other.get("method", "GET")
    base = {
        "id": i, "log_time": T0 + timedelta(seconds=at), "src_ip": "10.0.0.1", "method": method,
        "uri": path, "query_string": "?" + query if query else "",
        "raw_request": f"{method} {target} HTTP/1.1", "status_code": 200,
        "response_body_bytes": 100, "duration_us": 10, "ttfb_us": 5, "req_content_type": None,
        "resp_content_type": "application/json", "user_agent": "curl/8.5.0", "referer": None,
        "request_id": None, "error_link_id": None, "raw_log": None,
    } | other
    return tuple(base[n] for n, _ in FIELDS)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def requests(spark, rows, source="security"):
    return canon.select_sources({source: table(spark, rows)}, source)
