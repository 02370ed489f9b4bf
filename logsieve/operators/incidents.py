"""Candidates merged to incidents.

An incident may absorb a large part of all candidates (one request id repeated by a
broken proxy, say). So the incident row only holds values that combine before the
shuffle; the rows behind it stay in the long table ``incident_members``.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsieve import rules
from logsieve.functions import text as T
from logsieve.sources.store import materialize, release

c = F.col


def local_second(ts: Column) -> Column:
    text = F.date_format(
        F.from_utc_timestamp(ts, rules.LOCAL_ZONE), "yyyy-MM-dd'T'HH:mm:ss"
    )
    return F.coalesce(
        F.concat(text, F.lit(rules.LOCAL_OFFSET.replace(":", ""))), F.lit("unknown-time")
    )


def incident_key() -> Column:
    """Request id, else error link id, else a fingerprint of eight fields."""
    rid, eid = T.identifier(c("request_id")), T.identifier(c("error_link_id"))
    parts = [T.norm(c(n)) for n in ("src_ip", "method", "uri", "query", "request_text")]
    parts += [c("status_code").cast("string"), c("verdict_hint"), local_second(c("log_time"))]
    print_ = F.left(F.sha1(F.concat_ws("||", *parts)), F.lit(16))
    return (
        F.when(rid != "", F.concat(F.lit("rid:"), rid))
        .when(eid != "", F.concat(F.lit("eid:"), eid))
        .otherwise(F.concat(F.lit("fp:"), print_))
    )


def with_incident_key(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("incident_group_key", incident_key())


def priority(source: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, rank in ranks.items():
        out = F.when(source == name, rank).otherwise(out)
    return out


def preference() -> Column:
    """Ordering whose maximum is the representative row; ties go to the first row."""
    return F.struct(
        priority(c("source_table"), rules.SOURCE_PRIORITY),
        (T.identifier(c("request_id")) != "").cast("int"),
        (T.identifier(c("error_link_id")) != "").cast("int"),
        c("score"), c("duration_us"), c("ttfb_us"), c("log_time"),
        -c("source_position"), -c("id"),
    )


REPRESENTATIVE = [
    "source_table", "source_position", "id", "log_time", "src_ip", "method", "uri", "query",
    "status_code", "verdict_hint", "request_id", "error_link_id", "request_text", "user_agent",
    "referer", "duration_us", "ttfb_us", "log_text", "response_body_bytes",
    "resp_content_type", "target", "path_normalized", "html_fallback", "hpp_detected",
    "hpp_param_names", "embedded_attack_hint",
]


def representatives(candidates: DataFrame) -> DataFrame:
    """One row per incident: best row, best score, counts."""
    arrival = F.struct("source_position", "log_time", "id")
    eid = T.identifier(c("error_link_id"))
    grouped = (
        with_incident_key(candidates)
        .groupBy("incident_group_key")
        .agg(
            F.max_by(F.struct(*REPRESENTATIVE), preference()).alias("best"),
            F.max("score").alias("score"),
            F.count("*").alias("merged_row_count"),
            F.min(arrival).alias("first_arrival"),
            F.min_by(eid, F.when(eid != "", arrival)).alias("any_error_link"),
            F.min("id").alias("first_log_id"),
            F.max("id").alias("last_log_id"),
            *[F.max(c("source_table") == s).alias(f"from_{s}") for s in rules.SOURCES],
        )
    )
    tables = F.array_except(
        F.array(*[F.when(c(f"from_{s}"), F.lit(s)) for s in rules.SOURCES]),
        F.array(F.lit(None).cast("string")),
    )
    kept = T.identifier(c("best.error_link_id"))
    return grouped.select(
        "incident_group_key", "score", "merged_row_count", "first_log_id", "last_log_id",
        "first_arrival", tables.alias("merged_source_tables"),
        *[c(f"best.{n}").alias(n) for n in REPRESENTATIVE if n != "error_link_id"],
        F.when(kept != "", c("best.error_link_id"))
        .otherwise(F.coalesce("any_error_link", c("best.error_link_id")))
        .alias("error_link_id"),
    )


def incident_hints(candidates: DataFrame) -> DataFrame:
    """Distinct hints of each incident in first-seen order, made distinct before collecting."""
    each = with_incident_key(candidates).select(
        "incident_group_key", "source_position", "log_time", "id",
        F.posexplode("reason_hints").alias("pos", "hint"),
    )
    first = each.groupBy("incident_group_key", "hint").agg(
        F.min(F.struct("source_position", "log_time", "id", "pos")).alias("first_seen")
    )
    return first.groupBy("incident_group_key").agg(
        F.array_sort(F.collect_list(F.struct("first_seen", "hint"))).getField("hint").alias(
            "reason_hints"
        )
    )


def incidents(candidates: DataFrame) -> DataFrame:
    """Deduplicated candidates. Both sides of the join are grouped by the incident key."""
    none = F.array().cast("array<string>")
    return (
        representatives(candidates)
        .join(incident_hints(candidates), "incident_group_key", "left")
        .withColumn("reason_hints", F.coalesce("reason_hints", none))
    )


def incident_members(candidates: DataFrame) -> DataFrame:
    """Every (incident, log id) pair."""
    return with_incident_key(candidates).select("incident_group_key", "source_table", "id")


def top_candidates(incidents: DataFrame, limit: int | None = None) -> DataFrame:
    """Best score first, newest first; ties in order of arrival."""
    out = incidents.orderBy(c("score").desc(), c("log_time").desc(), "first_arrival")
    return out.limit(limit) if limit else out


def with_place(df: DataFrame, name: str) -> DataFrame:
    """Adds each row's place in the order of the sorted table df, from 0.

    The distributed sort is written with its partition number and row number; only the
    row counts per partition are added up, so no task sees all rows.
    """
    low_bits = (1 << 33) - 1
    placed = materialize(
        df.withColumn("part", F.spark_partition_id())
        .withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit(low_bits))),
        "ranked",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("part")
        .agg(F.count("*").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    return placed.join(offsets, "part").withColumn(name, c("offset") + c("row")).drop(
        "part", "row", "offset"
    )


def with_candidate_index(incidents: DataFrame) -> DataFrame:
    """Adds the place of each incident in ``top_candidates`` order, from 0.

    The incidents are written first: a distributed sort reads its input twice, once for the ranges, and would merge
    all candidates twice.
    """
    merged = materialize(incidents, "merged")
    out = with_place(top_candidates(merged), "candidate_index")
    release(merged)
    return out


def incident_groups(incidents: DataFrame) -> DataFrame:
    """Short summary of each incident."""
    def shown(n: str) -> Column:
        return T.first_text(T.identifier(c(n)), F.lit("-")).alias(n)

    return incidents.select(
        "incident_group_key", "merged_row_count",
        c("merged_source_tables").alias("source_tables"), "src_ip", "method", "uri",
        "status_code", "verdict_hint", shown("request_id"), shown("error_link_id"), "log_time",
    )


def _per_request_id(rows: DataFrame, prefix: str, *more: Column) -> DataFrame:
    name = "log" if prefix == "request" else prefix
    return (
        rows.withColumn("request_id", T.identifier(c("request_id")))
        .where(c("request_id") != "")
        .groupBy("request_id")
        .agg(
            F.count("*").alias(f"{prefix}_count"), F.min("id").alias(f"first_{name}_id"),
            F.max("id").alias(f"last_{name}_id"), *more,
        )
    )


def error_correlation(requests: DataFrame, errors: DataFrame) -> DataFrame:
    """Request ids that both requests and errors carry, with counts and bounds of either side.

    Each side is one row per id before the join, so a repeated id makes no pairs; the
    rows behind it are those of ``correlation_members``.
    """
    links = F.count_distinct(F.nullif(T.identifier(c("error_link_id")), F.lit("")))
    return _per_request_id(requests, "request").join(
        _per_request_id(errors, "error", links.alias("error_link_count")), "request_id"
    )


def correlation_members(requests: DataFrame, errors: DataFrame) -> DataFrame:
    """request_id, source_table, id, error_link_id, log_text of every row behind ``error_correlation``.

    ``log_text`` is the error's own text, and null for requests.
    """
    shared = error_correlation(requests, errors).select("request_id")
    link = T.identifier(c("error_link_id")).alias("error_link_id")
    own = requests.select("request_id", "source_table", "id", link, F.lit(None).cast("string").alias("log_text"))
    both = own.unionByName(errors.select("request_id", "source_table", "id", link, "log_text"))
    return both.withColumn("request_id", T.identifier(c("request_id"))).join(shared, "request_id")
