"""Times the headline queries and prints one JSON line.

``outcome`` reads, scores and writes the whole log once; the queries after it start from
that written table, as a run does. The others start from the raw tables. Each is warm:
one unmeasured round, then the median of ``BENCH_ROUNDS`` measured ones (default one).
"""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from workload import queries as Q

FROM_RAW = ["ip_risk", "risk_score", "candidates", "probing_bursts", "ingest_security"]
FROM_OUTCOME = [
    "incidents", "noise_rollup", "noise_passed_through", "supporting_events", "triage_by_ip",
    "stage_counts", "report_input",
]


def session(cores: int) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(work) -> float:
    t0 = time.perf_counter()
    work()
    return time.perf_counter() - t0


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(int(os.environ.get("BENCH_CPUS", "8")))
    rounds = int(os.environ.get("BENCH_ROUNDS", "1"))
    seconds: dict[str, list[float]] = {}

    def record(name, work, measured):
        took = timed(work)
        if measured:
            seconds.setdefault(name, []).append(took)

    for i in range(rounds + 1):
        Q._runs.clear()
        run = Q.run_of(spark, sf_dir)
        record("outcome", lambda: run.outcome, i > 0)
        for name in FROM_OUTCOME + FROM_RAW:
            record(name, lambda n=name: drain(Q.QUERIES[n](spark, sf_dir)), i > 0)
    median = {n: round(statistics.median(v), 3) for n, v in seconds.items()}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(median.values()), 3),
                "unit": "sec",
                "queries": median,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
