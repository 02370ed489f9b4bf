"""Whole runs: time window, counters, stored tables, triage and reports."""

import io
import os
from contextlib import redirect_stdout
from datetime import timedelta

from helpers import T0, row, table
from pyspark.sql import functions as F

from logsieve.operators import canon, nearby, responses, triage
from logsieve.plans.run import TriageRun
from logsieve.sources import store

ATTACK = "/s?q=1' union select 1,2,3--"


def attacks(spark, n, **other):
    return table(spark, [row(i, ATTACK, i, request_id=f"r{i}", **other) for i in range(1, n + 1)])


def test_counters_tell_exported_from_selected(spark):
    run = TriageRun({"security": attacks(spark, 5), "access": table(spark, [row(9, "/x")])}, "security")
    got = {r.counter: r.value for r in run.counts.collect()}
    assert (got["total_exported_rows"], got["selected_source_rows"]) == (6, 5)
    assert got["candidate_rows_before_dedup"] + got["filtered_out_rows"] == 5


def test_time_window_reaches_the_scan(spark, tmp_path):
    attacks(spark, 30).write.parquet(f"{tmp_path}/log")
    stored = spark.read.parquet(f"{tmp_path}/log")
    run = TriageRun({"security": stored}, "security", start=T0 + timedelta(seconds=10), end=T0 + timedelta(seconds=20))
    assert [r.id for r in run.requests.orderBy("id").collect()] == list(range(10, 20))
    shown = io.StringIO()
    with redirect_stdout(shown):
        run.requests.explain("formatted")
    pushed = [line for line in shown.getvalue().splitlines() if "PushedFilters" in line]
    assert pushed and "GreaterThanOrEqual(log_time" in pushed[0] and "LessThan(log_time" in pushed[0]
    text = stored.withColumn("log_time", F.date_format("log_time", "yyyy-MM-dd HH:mm:ss"))
    late = canon.within(text, start=T0 + timedelta(seconds=25))
    assert late.count() == 6
    created = stored.withColumn("created_at", F.col("log_time")).withColumn("log_time", F.lit(None).cast("timestamp"))
    assert canon.within(created, end=T0 + timedelta(seconds=5)).count() == 4


def test_no_time_is_near_nothing(spark):
    """A row just before 1970 is not taken for a row without a time."""
    ms = spark.sql("select timestamp_millis(-1) as t union all select null").select(nearby._millis(F.col("t")).alias("ms"))
    assert len({r.ms for r in ms.collect()}) == 2


def test_a_run_leaves_nothing_behind(spark):
    run = TriageRun({"security": attacks(spark, 4)}, "security")
    run.deduped.count()
    base = store.shared_dir(spark).removeprefix("file:")
    assert os.listdir(base)
    kept = dict(store._base)
    store.close(spark)
    assert not os.path.exists(base) and kept
    assert store.shared_dir(spark) != base


def test_same_request_id_is_one_result(spark):
    run = TriageRun({"security": attacks(spark, 3), "access": attacks(spark, 3)}, "security,access")
    assert run.incidents.count() == 3 and run.deduped.count() == 3
    by_ip = triage.triage_by_ip(run.deduped, run.results).collect()
    assert [r.incident_count for r in by_ip] == [3]


def answers(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "candidate_index long, output_text string")


GOOD = '{"verdict": "suspicious_sqli", "severity": "high", "confidence": "high", "false_positive_possible": false, "reasoning_summary": "x", "evidence_fields": ["uri"], "recommended_actions": ["watch"]}'


def test_answers_are_searched_once(spark):
    texts = [GOOD, f"```json\n{GOOD}\n```", f"So: {GOOD} done", f"[{GOOD}]", GOOD[:-3], "", None, "[1, 2]", "words", '"text"', "```\n```"]
    df = answers(spark, *texts)
    got = {r.candidate_index: r.strategy for r in responses.parse_responses(df).collect()}
    assert got == {0: "direct", 1: "direct", 2: "outer_object", 3: "outer_object"}
    bad = {r.candidate_index: r.error_type for r in responses.triage_errors(df).collect()}
    assert bad == {
        4: "json_decode_error", 5: "empty_output", 6: "empty_output", 7: "unexpected_error", 8: "json_decode_error",
        9: "unexpected_error", 10: "empty_output",
    }
    shown = io.StringIO()
    with redirect_stdout(shown):
        responses.parse_responses(df).explain()
    plan = shown.getvalue()
    assert plan.count("ArrowEvalPython") == 1
    below = plan[plan.index("ArrowEvalPython"):]
    assert "Filter" in below  # only texts that are no object as a whole get there


def test_values_of_another_kind_are_no_answers(spark):
    odd = '{"verdict": 5, "severity": null, "false_positive_possible": "true", "evidence_fields": "uri", "recommended_actions": [1, "watch"]}'
    for text in (odd, f"see {odd}"):
        (r,) = responses.parse_responses(answers(spark, text)).collect()
        assert (r.verdict, r.severity, r.false_positive_possible, r.evidence_fields) == (None, None, None, None)
        assert r.recommended_actions == ["1", "watch"]


def test_triage_on_answers(spark):
    run = TriageRun({"security": attacks(spark, 3)}, "security")
    bad = GOOD.replace('"high", "confidence"', '"extreme", "confidence"')
    judged = run.with_answers(answers(spark, GOOD, bad, "no answer"))
    assert [(r.verdict, r.severity) for r in judged.deduped.collect()] == [("suspicious_sqli", "high")]
    assert judged.incidents is run.incidents and run.deduped.count() == 3
    assert (judged.rows("deduped"), run.rows("deduped")) == (1, 3)
    ids = {(r.dedup_key, r.request_id) for r in triage.merged_request_ids(run.results).collect()}
    assert ids == {(f"request_id:r{i}", f"r{i}") for i in (1, 2, 3)}


def test_counters_come_from_the_writes(spark):
    run = TriageRun({"security": attacks(spark, 5)}, "security")
    first = {r.counter: r.value for r in run.counts.collect()}
    store.release(run.supporting, run.review, run.noise_groups)  # nothing is read to count it
    assert {r.counter: r.value for r in run.counts.collect()} == first
    assert run.rows("incidents") == first["candidate_rows"] == 5


def test_valid_answers_become_results(spark):
    run = TriageRun({"security": attacks(spark, 2)}, "security")
    bad = GOOD.replace('"high", "confidence"', '"extreme", "confidence"')
    checked = responses.validate_responses(responses.parse_responses(answers(spark, GOOD, bad)))
    got = {r.candidate_index: (r.valid, r.violations) for r in checked.collect()}
    assert got == {0: (True, []), 1: (False, ["severity"])}
    rows = responses.classified(checked.where("valid"), run.incidents).collect()
    assert [(r.candidate_index, r.severity, r.false_positive_possible) for r in rows] == [(0, "high", False)]


def test_answers_never_meet_incidents_in_the_driver(spark):
    """Spark underrates the size of typed answers, so that it would broadcast millions of them."""
    incidents = spark.createDataFrame([(0, 10), (1, 11), (1, 11), (3, 13), (None, 14)], "candidate_index long, id long")
    parsed = responses.parse_responses(store.materialize(answers(spark, GOOD, f"So: {GOOD} done", GOOD), "answers"))
    joined = responses.classified(parsed, incidents)
    shown = io.StringIO()
    with redirect_stdout(shown):
        joined.explain()
    assert "SortMergeJoin" in shown.getvalue() and "Broadcast" not in shown.getvalue()
    rows = joined.select("candidate_index", "log_id", "severity").collect()
    assert sorted(tuple(r) for r in rows) == [(0, 10, "high"), (1, 11, "high"), (1, 11, "high")]
