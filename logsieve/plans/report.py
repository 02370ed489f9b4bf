"""The report input: one JSON record with the ranked and summarised results of a run."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve import rules
from logsieve.operators import noise, triage
from logsieve.plans.run import TriageRun
from logsieve.sources import store
from logsieve.sources.tables import local_iso

c = F.col

CAPS = {
    "top_incidents": 12, "top_src_ips": 8, "top_noise_groups": 8, "probing_bursts": 10,
    "supporting_events": 20, "false_positive_review": 20, "errors": 5,
}


def top_noise(groups: DataFrame, limit: int = CAPS["top_noise_groups"]) -> DataFrame:
    """Largest noise groups; ties by category and address, both descending."""
    return groups.orderBy(
        c("count").desc(), c("noise_category").desc(), c("src_ip").desc(), "uri", "method",
        "status_code", "user_agent",
    ).limit(limit)


def top_bursts(bursts: DataFrame, limit: int = CAPS["probing_bursts"]) -> DataFrame:
    return bursts.orderBy(
        c("request_count").desc(), c("distinct_path_count").desc(), c("start").desc(), "src_ip"
    ).limit(limit)


def top_supporting(events: DataFrame, limit: int = CAPS["supporting_events"]) -> DataFrame:
    return events.orderBy(
        c("nearby_candidate_count").desc(), c("log_time").desc(), "source_position", "id"
    ).limit(limit)


def first_reviews(review: DataFrame, limit: int = CAPS["false_positive_review"]) -> DataFrame:
    return review.orderBy("source_position", "log_time", "id").limit(limit)


def first_errors(errors: DataFrame, limit: int = CAPS["errors"]) -> DataFrame:
    return errors.orderBy("candidate_index").limit(limit)


def _section(name: str, df: DataFrame, *order: Column) -> DataFrame:
    """Rows of a capped table as JSON texts under a section name."""
    times = [f.name for f in df.schema if f.dataType.typeName() == "timestamp"]
    shown = df.withColumns({t: local_iso(c(t)) for t in times})
    row = F.to_json(F.struct(*shown.columns))
    key = F.struct(*order) if order else F.struct(row)
    return shown.select(F.lit(name).alias("section"), F.to_json(key).alias("k"), row.alias("row"))


def _fields(spark, name: str, values: dict) -> DataFrame:
    """A section of one row."""
    return _section(name, spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]))


def report_counts(run: TriageRun, errors: DataFrame | None) -> dict[str, int]:
    """The report's own counters, from those of the run."""
    of = {r["counter"]: r["value"] for r in run.counts.collect()}
    results = run.results.count() if run.answers is not None else of["candidate_rows"]
    run.deduped  # noqa: B018  written and counted
    return {
        "total_exported_rows": of["total_exported_rows"],
        "candidate_rows": of["candidate_rows"],
        "distinct_incident_count": run.rows("deduped"),
        "filtered_out_rows": of["filtered_out_rows"],
        "filtered_out_non_aggregated_rows": of["filtered_out_non_aggregated_rows"],
        "noise_group_count": of["noise_group_count"],
        "supporting_event_count": of["supporting_events"],
        "false_positive_review_candidate_count": of["false_positive_review_candidates"],
        "probing_sequence_summary_count": of["probing_sequence_summaries"],
        "stage1_success_count": results,
        "stage1_error_count": errors.count() if errors is not None else 0,
    }


def report_input(run: TriageRun, errors: DataFrame | None = None, meta: dict[str, str] | None = None) -> DataFrame:
    """One row with a column ``report``.

    ``meta``: what is known about the analysis (mode, model, times of export and preparation). Every section is capped
    or holds one row per category, so the last grouping collects a few hundred short texts at most.
    """
    spark = run.outcome.sparkSession
    by_ip = triage.triage_by_ip(run.deduped, run.results, run.known_assets)
    breakdown = store.materialize(noise.noise_breakdown(run.left_out), "noise-breakdown")
    matched = store.materialize(triage.known_asset_matches(run.deduped), "matched-assets")
    counts = report_counts(run, errors)
    context = {"query_timezone": rules.LOCAL_ZONE, "window_start": str(run.start or ""), "window_end_exclusive": str(run.end or "")}
    sections = [
        _fields(spark, "analysis_context", context | (meta or {})),
        _fields(spark, "pipeline_counts", counts),
        _section("distributions", triage.distributions(run.deduped)),
        _section("filtered_out_breakdown", breakdown),
        _section(
            "top_incidents",
            triage.top_incidents(run.deduped, run.incidents, CAPS["top_incidents"]),
            F.lpad(c("rank").cast("string"), 4, "0"),
        ),
        _section("top_src_ips", triage.top_ips(by_ip, CAPS["top_src_ips"])),
        _section("top_noise_groups", top_noise(run.noise_groups)),
        _section("top_filtered_categories", noise.category_shares(breakdown)),
        _section("top_out_of_candidate_recon", noise.recon_shares(breakdown)),
        _section("probing_sequence_summaries", top_bursts(run.bursts)),
        _section("supporting_events", top_supporting(run.supporting)),
        _section("false_positive_review_candidates", first_reviews(run.review)),
        _section("matched_known_assets", matched),
        _section(
            "asset_context",
            matched.agg(F.coalesce(F.sum("incident_count"), F.lit(0)).alias("matched_known_asset_incident_count")).withColumn(
                "known_asset_ips", F.lit(",".join(run.known_assets))
            ),
        ),
    ]
    if errors is not None:
        sections.append(_section("stage1_errors_excerpt", first_errors(errors)))
    rows = sections[0]
    for s in sections[1:]:
        rows = rows.unionByName(s)
    lists = rows.groupBy("section").agg(
        F.array_sort(F.collect_list(F.struct("k", "row"))).getField("row").alias("items")
    )
    body = F.concat(
        F.lit('"'), c("section"), F.lit('":['), F.array_join("items", ","), F.lit("]")
    )
    return lists.agg(
        F.concat(
            F.lit("{"), F.array_join(F.array_sort(F.collect_list(body)), ","), F.lit("}")
        ).alias("report")
    )
