"""Line parsing, time ranges and model answers."""

import json
from datetime import datetime, timezone
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from logsieve.functions import text as T
from logsieve.operators import responses
from logsieve.sources import logs, tables
from workload import request_log


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_access_lines(spark):
    head = "1.2.3.4 - - [01/Apr/2026:10:00:00 +0900] "
    df = lines(
        spark,
        head + '"GET /x?y=1?z HTTP/1.1" 200 - "-" "ua" "h" v',
        head + '"GET /plain" 404 12 "r" "ua" "h" v',
        head + '"-" 400 0 "-" "-" "-" -',
        head + '"GET /x HTTP/1.1 200',
    )
    got = {r.raw_request: r for r in logs.parse_access(df).collect()}
    first = got["GET /x?y=1?z HTTP/1.1"]
    assert (first.uri, first.query_string, first.response_body_bytes) == ("/x", "?y=1?z", None)
    assert first.log_time == datetime(2026, 4, 1, 1)
    two = got["GET /plain"]
    assert (two.method, two.uri, two.query_string, two.protocol) == ("GET", "/plain", None, None)
    assert got[None].method is None and got[None].vhost is None
    assert logs.access_rejects(df).count() == 1


def test_security_lines(spark):
    df = lines(
        spark,
        r'log_time="2026-04-01T10:00:00.123+0900" src_ip=1.1.1.1 raw_request="GET /a?b=\"c\" '
        r'HTTP/1.1" status_code=x status_code=200 request_id=- resp_html_baseline_match=yes',
        'log_time="bad" src_ip=2.2.2.2',
        "nothing here",
        'log_time="2026-04-01T10:00:00+09:00" src_ip=3.3.3.3 user_agent="' + "a" * 50_000 + '"',
    )
    got = {r.src_ip: r for r in logs.parse_security(df).collect()}
    one = got["1.1.1.1"]
    assert one.log_time == datetime(2026, 4, 1, 1, 0, 0, 123000)
    assert one.raw_request == r"GET /a?b=\"c\" HTTP/1.1"
    assert (one.status_code, one.request_id, one.resp_html_baseline_match) == (200, None, 1)
    assert got["2.2.2.2"].log_time is None
    assert len(got["3.3.3.3"].user_agent) == 50_000
    assert logs.security_rejects(df).count() == 1


def test_error_lines(spark):
    tail = " [error_link_id:e1] [request_id:-] [module_name:core] [log_level:error] " \
           "[src_ip:1.1.1.1 peer_ip:2.2.2.2] message=boom"
    times = [
        "2026-04-01 10:00:00.123456", "2026-04-01 10:00:00", "Wed Apr 01 10:00:00.5 2026",
        "Wed Apr 01 10:00:00 2026", "yesterday",
    ]
    df = lines(spark, *[f"[{t}]{tail}" for t in times])
    got = sorted(r.log_time.microsecond for r in logs.parse_error(df).collect())
    assert got == [0, 0, 123000, 500000]
    assert logs.error_rejects(df).count() == 1


def test_decode_is_tolerant(spark):
    from urllib.parse import unquote_plus

    values = ["a+b%20c", "100% x", "100%25 + 5% %zz %E3%81 %ff", " %09x ", "%", "%%41", ""]
    df = lines(spark, *values).select("value", T.norm(F.col("value")).alias("got"))
    assert all(r.got == unquote_plus(r.value).strip() for r in df.collect())


def test_flexible_time(spark):
    values = [
        "2026-04-02T00:00:00.000+09:00", "2026-04-02T00:00:00.000 09:00", "2026-04-01 15:00:00",
        "2026-04-01", "2026", "", "x",
    ]
    got = lines(spark, *values).select(
        "value", T.flexible_time(F.col("value")).alias("t")).collect()
    by = {r.value: r.t for r in got}
    assert by[values[0]] == by[values[1]] == by[values[2]] == datetime(2026, 4, 1, 15)
    assert by["2026-04-01"] == datetime(2026, 4, 1)
    assert by["2026"] is None and by[""] is None and by["x"] is None


def test_local_range():
    start, end = tables.local_range(date="2026-04-02")
    assert start == datetime(2026, 4, 1, 15, tzinfo=timezone.utc)
    assert (end - start).total_seconds() == 86_400
    for bad in ({}, {"date": "2026-04-02", "today": True}, {"start": "2026-04-02"},
                {"start": "2026-04-02", "end": "2026-04-02"}):
        with pytest.raises(ValueError):
            tables.local_range(**bad)


def test_model_answers(spark):
    good = {
        "verdict": "suspicious_sqli", "severity": "high", "confidence": "low",
        "false_positive_possible": False, "reasoning_summary": 'a "}" b',
        "evidence_fields": ["x"], "recommended_actions": ["watch"],
    }
    text = json.dumps(good)
    odd = json.dumps(good | {"severity": "extreme", "recommended_actions": []})
    cases = [
        text, f"```json\n{text}\n```", f"I think {text} ok", text[:-4], f"[{text}]", odd, "", "no",
    ]
    df = spark.createDataFrame(list(enumerate(cases)), "candidate_index long, output_text string")
    parsed = {r.candidate_index: r for r in responses.validate_responses(
        responses.parse_responses(df)).collect()}
    assert {i: r.strategy for i, r in parsed.items()} == {
        0: "direct", 1: "direct", 2: "outer_object", 4: "outer_object", 5: "direct"}
    assert parsed[2].reasoning_summary == 'a "}" b' and parsed[2].valid
    assert parsed[5].violations == ["severity", "recommended_actions_size"]
    errors = {r.candidate_index: r.error_type for r in responses.triage_errors(df).collect()}
    assert errors == {3: "json_decode_error", 6: "empty_output", 7: "json_decode_error"}


def test_files_of_the_log_have_many_row_groups(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(request_log, "ROW_GROUP", 16 << 10, raising=False)
    monkeypatch.setattr(request_log, "_written", {})
    log = request_log.base_log(spark, sf_dir)
    groups = [pq.ParquetFile(f).num_row_groups for f in Path(log._scratch).glob("part-*.parquet")]
    assert groups and min(groups) > 1
    assert log.count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()
