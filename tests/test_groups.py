"""Grouping, time windows and bursts against brute force on small tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import requests, row, table
from pyspark.sql import functions as F

from logsieve import rules
from logsieve.functions.numbers import rounded_ratio
from logsieve.operators import bursts, chains, incidents, nearby, noise, score
from logsieve.sources import store

PROBES = [
    "/admin/", "/admin/index.php", "/config.php", "/admin/config.php", "/backup.zip",
    "/backup.sql", "/phpmyadmin", "/vendor/", "/storage/",
]


def test_burst_of_nine_paths_counts_seven(spark):
    got = bursts.probing_bursts(
        requests(spark, [row(i + 1, p, i) for i, p in enumerate(PROBES)])
    ).collect()
    assert [(r.request_count, r.distinct_path_count) for r in got] == [(7, 7)]
    assert got[0].sample_paths == [p.lower() for p in PROBES[:7]]


def brute_bursts(rows):
    out, by_ip = [], {}
    for ip, at, path in rows:
        by_ip.setdefault(ip, []).append((at, path))
    for ip, items in by_ip.items():
        bucket = []
        for item in [*sorted(items), (float("inf"), "")]:
            if bucket and item[0] - bucket[0][0] > 120:
                if len(bucket) >= 3 and len({p for _, p in bucket}) >= 3:
                    out.append((ip, bucket[0][0], bucket[-1][0], len(bucket)))
                bucket = []
            bucket.append(item)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_bursts_match_a_plain_loop(spark, seed):
    rnd = random.Random(seed)
    at, raw = 0.0, []
    for _ in range(400):
        at += rnd.choice([0.0, 0.5, 7, 40, 60, 120, 121, 300])
        raw.append((f"ip{rnd.choice([1, 1, 1, 2])}", at, rnd.choice(PROBES[:7])))
    rows = [row(i, p, t, src_ip=ip) for i, (ip, t, p) in enumerate(raw, 1)]
    start = F.unix_millis("start") / 1000
    got = bursts.probing_bursts(requests(spark, rows)).select(
        "src_ip", start.alias("s"), (F.unix_millis("end") / 1000).alias("e"), "request_count"
    ).collect()
    zone = min(r.s for r in got) - min(b[1] for b in brute_bursts(raw))
    assert sorted((r.src_ip, r.s - zone, r.e - zone, r.request_count) for r in got) == (
        brute_bursts(raw)
    )


def chain(times, gap):
    out = []
    for t in sorted(set(times)):
        if not out or t > out[-1] + gap:
            out.append(t)
    return out


def test_walk_carries_over_batches():
    def frame(ms, reach=None):
        return pa.RecordBatch.from_pydict({"src_ip": ["a"] * len(ms), "chunk": [0] * len(ms), "ms": pa.array(ms, pa.int64()), "reach": pa.array([reach] * len(ms), pa.int64())})

    def walked(*frames):
        return [m for b in chains.walk(iter(frames), 120_000) for m in b.column("start_ms").to_pylist()]

    rest = [frame([0, 60_000]), frame([120_000, 120_001]), frame([130_000, 240_002])]
    assert walked(*rest) == [0, 120_001, 240_002]  # 240 002 is 120 001 ms after the second start
    assert walked(frame([None], 60_000), *rest) == [120_000, 240_002]  # entered with a start at -60 000


@pytest.mark.parametrize("seed", range(6))
def test_composed_steps_equal_the_chain(seed):
    rnd, gap = random.Random(seed), 50
    times, at = [], 0
    for _ in range(300):
        at += rnd.choice([1, 1, 2, 3, 30, 51, 200])
        times.append(at)
    cuts = sorted(rnd.sample(range(1, 300), 6))
    parts = [np.array(times[a:z]) for a, z in zip([0, *cuts], [*cuts, 300], strict=True)]
    held = chains.chunk_steps(parts[0], gap)
    for p in parts[1:]:
        held = chains.compose(held, chains.chunk_steps(p, gap), gap)
    for reach in range(-10, times[0] + gap):
        entered = [t for t in times if t > reach]
        want = chain(entered, gap)[-1] + gap if entered else reach
        assert chains.apply(*held, np.array([reach]))[0] == want


def test_busy_address_is_walked_in_chunks(spark):
    """One probe each millisecond over many chunks, sparse addresses beside it, three levels of composition."""
    gap, rnd = 40, random.Random(3)
    raw = [("busy", t) for t in range(5000, 9000)] + [("other", t) for t in rnd.sample(range(10_000), 700)] + [("one", 7)]
    points = spark.createDataFrame(raw, "src_ip string, ms long").withColumn("block", F.floor(F.col("ms") / gap)).repartition(7)
    got = sorted((r.src_ip, r.start_ms) for r in chains.starts(points, gap, chunk=100, fan=3).collect())
    want = [(ip, t) for ip in {r[0] for r in raw} for t in chain([t for i, t in raw if i == ip], gap)]
    assert got == sorted(want)
    sizes = chains.starts(points, gap, chunk=10_000).count()
    assert sizes == len(want)


def test_places_in_groups_of_many_ranges(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), i, f"x{i}") for i in range(500)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o long, place_of string")
    got = sorted((r.o, r.place) for r in chains.place_within(df, ["g"], [F.col("o")], rows=40).collect())
    seen, want = {}, []
    for g, o, _ in sorted(rows, key=lambda r: r[1]):
        seen[g] = seen.get(g, 0) + 1
        want.append((o, seen[g]))
    assert got == want


def test_all_paths_of_a_burst_are_in_order(spark):
    rows = requests(spark, [row(i + 1, p, i) for i, p in enumerate([*PROBES, *PROBES[:3]])])
    got = sorted((r.place, r.path) for r in bursts.burst_paths(rows).collect())
    assert got == [(i, p.lower()) for i, p in enumerate(PROBES[:7], 1)]
    assert [p for _, p in got] == bursts.probing_bursts(rows).collect()[0].sample_paths
    assert bursts.burst_paths(requests(spark, [row(1, PROBES[0])])).collect() == []


def split(spark, rows):
    """Left-out rows and incidents, written."""
    judged = score.judge(requests(spark, rows))
    left = store.materialize(score.filtered(judged), "left")
    found = store.materialize(score.candidates(judged), "found")
    return left, store.materialize(incidents.incidents(found), "incidents")


def _attack(i, at, **other):
    return row(i, "/search?q=%27%20or%201=1--", at, **other)


def test_supporting_window_edges_and_unknown_time(spark):
    rows = [
        _attack(1, 500),
        row(2, "/search?q=from", 380), row(3, "/search?q=from", 379.999),
        row(4, "/search?q=from", 620), row(5, "/search?q=from", 620.001),
        row(6, "/search?q=from", log_time=None), row(7, "/other?q=from", 500),
        row(8, "/search?q=from", 500, src_ip="10.0.0.2"),
    ]
    left, inc = split(spark, rows)
    got = nearby.supporting_events(left, inc).collect()
    assert sorted(r.id for r in got) == [2, 4, 6]
    assert {r.nearby_candidate_count for r in got} == {1}


def test_supporting_counts_match_all_pairs(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(1, 301):
        at = round(rnd.uniform(0, 900), 3)
        extra = {"status_code": rnd.choice([200, 302]), "response_body_bytes": rnd.choice(
            [0, 100, 300, 900, 5000])}
        uri = rnd.choice(["/search", "/search/a", "/search/a%253Fb"])
        make = rnd.random() < 0.3
        rows.append(row(i, uri + ("?q=%27%20or%201=1--" if make else "?q=from"), at, **extra))
    left, inc = split(spark, rows)
    got = {r.id: r for r in nearby.supporting_events(left, inc).collect()}
    strong = score.high_signal_sqli(inc).select(
        "uri", "log_time", "status_code", "response_body_bytes"
    ).collect()
    from urllib.parse import unquote_plus as dec

    def fam(uri):
        n = dec(uri).lower()
        return (n.split("?")[0] if "?" in uri else n).split("/")[:4]

    def differs(a, b):
        gap = abs(a - b)
        return gap >= (256 if a <= 0 or b <= 0 else max(256, int(max(a, b) * 0.3)))

    for r in left.collect():
        near = [
            s for s in strong
            if (dec(s.uri) == dec(r.uri) or fam(s.uri) == fam(r.uri))
            and abs((s.log_time - r.log_time).total_seconds()) <= 120
        ]
        assert (r.id in got) == bool(near)
        if near:
            hints = got[r.id].reason_hints
            assert got[r.id].nearby_candidate_count == len(near)
            assert ("supporting:status_delta_from_nearby_candidate" in hints) == any(
                s.status_code != r.status_code for s in near)
            assert ("supporting:response_size_delta_from_nearby_candidate" in hints) == any(
                differs(r.response_body_bytes, s.response_body_bytes) for s in near)
            assert ("supporting:same_uri_nearby_high_signal_sqli" in hints) == any(
                dec(s.uri) == dec(r.uri) for s in near)


def test_noise_groups_of_two_and_three(spark):
    rows = [row(i, "/x?q=apple", i) for i in (1, 2, 3)] + [row(i, "/y?q=apple", i) for i in (4, 5)]
    left = score.filtered(score.judge(requests(spark, rows)))
    assert [(g.uri, g["count"]) for g in noise.noise_groups(left).collect()] == [("/x", 3)]
    assert sorted(r.id for r in noise.passed_through(left).collect()) == [4, 5]


def test_passed_through_limits_before_the_shuffle(spark, sf_dir):
    rows = [row(i, "/x?q=apple", i) for i in range(10)]
    left = store.materialize(score.filtered(score.judge(requests(spark, rows))), "left")
    plan = noise.passed_through(left)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_incident_merge_and_tie(spark):
    rows = [_attack(1, 0, request_id="r1"), _attack(2, 0, request_id="r1"),
            _attack(3, 5, request_id="-"), _attack(4, 5, request_id="-")]
    got = {r.incident_group_key[:4]: r for r in incidents.incidents(
        score.candidates(score.judge(requests(spark, rows)))).collect()}
    assert got["rid:"].merged_row_count == 2 and got["rid:"].id == 1
    assert got["fp:" + [k for k in got if k.startswith("fp")][0][3]].merged_row_count == 2


def test_hot_incident_keeps_all_members(spark):
    rows = [_attack(i, i, request_id="same") for i in range(1, 60)]
    found = store.materialize(score.candidates(score.judge(requests(spark, rows))), "c")
    inc, members = incidents.incidents(found), incidents.incident_members(found)
    assert members.count() == 59
    assert inc.first().merged_row_count == 59
    assert (inc.first().first_log_id, inc.first().last_log_id) == (1, 59)


def test_errors_of_a_request_make_no_pairs(spark):
    from logsieve.operators import canon

    made = [row(i, "/x", request_id=rid) for i, rid in enumerate(["hot"] * 50 + ["-", "-", "null", None, "n/a", "one"])]
    both = [canon.canon(table(spark, made), "security"), canon.canon(table(spark, made[:51] + made[-1:]), "error")]
    got = {r.request_id: r for r in incidents.error_correlation(*both).collect()}
    assert set(got) == {"hot", "one"}
    assert (got["hot"].request_count, got["hot"].error_count, got["hot"].first_log_id, got["hot"].last_error_id) == (50, 50, 0, 49)
    assert incidents.correlation_members(*both).count() == 102


def test_ranks_are_dense(spark):
    from logsieve.operators import triage

    inc = incidents.with_candidate_index(incidents.incidents(score.candidates(score.judge(requests(
        spark, [_attack(i, i, duration_us=i * 100_000, request_id=f"r{i}") for i in range(1, 40)])))))
    deduped = triage.triage_dedup(triage.rule_triage(inc))
    got = triage.ranked(deduped).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 40))
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)


def test_candidate_index_is_dense(spark):
    rows = [_attack(i, i, duration_us=i * 100_000) for i in range(1, 80)]
    inc = incidents.with_candidate_index(
        incidents.incidents(score.candidates(score.judge(requests(spark, rows)))))
    got = sorted((r.candidate_index, r.score) for r in inc.collect())
    assert [i for i, _ in got] == list(range(79))
    assert [s for _, s in got] == sorted((s for _, s in got), reverse=True)


def test_rounded_ratio(spark):
    df = spark.createDataFrame([(1, 8), (3, 8), (2, 3), (0, 5), (-1, 8)], "a long, b long")
    got = [r[0] for r in df.select(rounded_ratio(F.col("a"), F.col("b"), 2)).collect()]
    assert got == [0.12, 0.38, 0.67, 0.0, -0.12]


def test_unknown_source_is_an_error(spark):
    from logsieve.operators import canon

    with pytest.raises(ValueError):
        canon.select_sources({"security": table(spark, [])}, "security,nope")
    assert rules.SOURCES[0] == "security"


def test_incidents_are_merged_once(spark):
    """The sort behind the index reads a written table, so each incident is made once."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(key):
        made.add(1)
        return key

    rows = spark.range(40).select(
        counted(F.col("id").cast("string")).alias("incident_group_key"), (F.col("id") % 7).alias("score"),
        F.timestamp_millis(F.col("id")).alias("log_time"), F.col("id").alias("first_arrival"),
    )
    got = incidents.with_candidate_index(rows).orderBy("candidate_index").collect()
    assert [(r.score, r.first_arrival) for r in got] == sorted(((i % 7, i) for i in range(40)), reverse=True)
    assert made.value == 40
