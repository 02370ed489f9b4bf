"""Export documents and results as parts with a manifest."""

import glob
import os

import pytest
from helpers import row, table

from logsieve.sources import tables


def log(spark, n):
    return table(spark, [row(i, f"/p{i}?a='{i}\"", i, request_id=f"r{i}" if i % 2 else None, raw_log="tab\tline\nend") for i in range(1, n + 1)]).repartition(3)


def shape(df):
    return ", ".join(f"`{f.name}` {'string' if f.name == 'log_time' else f.dataType.simpleString()}" for f in df.schema)


def test_all_columns_come_back(spark, tmp_path):
    src = {"security": log(spark, 20), "error": log(spark, 0)}
    tables.write_export(src, f"{tmp_path}/x", {"database": "d"})
    back = tables.read_export(spark, f"{tmp_path}/x", {n: shape(df) for n, df in src.items()})
    assert sorted(back["security"].collect()) == sorted(tables.export_rows(src["security"]).collect())
    assert back["error"].count() == 0
    assert tables.read_header(spark, f"{tmp_path}/x") == {"meta": {"database": "d", "total_count": 20}, "counts": {"security": 20, "error": 0}}


def test_damaged_parts_are_named(spark, tmp_path):
    path = f"{tmp_path}/x"
    tables.write_export({"security": log(spark, 20), "access": log(spark, 5)}, path)
    shapes = {n: shape(log(spark, 1)) for n in ("security", "access")}
    first, second, third = sorted(glob.glob(f"{path}/security/part-*"))
    text = open(first).read()
    with open(first, "w") as f:
        f.write(text.replace("/p", "/q", 1))
    os.remove(second)
    os.remove(f"{path}/security/.{os.path.basename(first)}.crc")
    with pytest.raises(tables.DamagedParts) as e:
        tables.read_export(spark, path, shapes)
    assert e.value.parts == [f"security/{os.path.basename(x)}" for x in (first, second)] and third not in e.value.parts
    assert tables.read_export(spark, path, {"access": shapes["access"]})["access"].count() == 5


def test_results_are_verified(spark, tmp_path):
    path = f"{tmp_path}/x"
    tables.write_artifacts({"candidates": log(spark, 9)}, path)
    assert sorted(tables.read_artifacts(spark, path, ["candidates"])["candidates"].collect()) == sorted(log(spark, 9).collect())
    log(spark, 2).write.mode("append").parquet(f"{path}/candidates")
    with pytest.raises(tables.DamagedParts):
        tables.read_artifacts(spark, path, ["candidates"])


def files_read(df):
    """Files that the scan of a plan has opened."""
    df.collect()
    return sum(leaf.metrics().apply("numFiles").value() for leaf in leaves(df._jdf.queryExecution().executedPlan()))


def leaves(plan):
    found = plan.collectLeaves()
    return [found.apply(i) for i in range(found.size())]


def test_a_range_reads_few_files(spark, tmp_path):
    hour = 3600
    src = table(spark, [row(i, "/p", i * hour, request_id="x") for i in range(24 * 10)] + [row(999, "/none", log_time=None)])
    tables.write_log(src, f"{tmp_path}/log", files=20)
    start, end = tables.local_range(date="2026-04-04")
    got = tables.read_log(spark, f"{tmp_path}/log", start, end)
    want = tables.scan_range(src, start, end)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect()) and want.count() == 24
    every = tables.read_log(spark, f"{tmp_path}/log")
    assert every.count() == 241 and every.columns == src.columns
    assert files_read(every) >= 20 and files_read(tables.read_log(spark, f"{tmp_path}/log", start, end)) <= 6
    plan = tables.read_log(spark, f"{tmp_path}/log", start, end)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters: [IsNotNull(log_time), GreaterThanOrEqual(log_time" in plan
