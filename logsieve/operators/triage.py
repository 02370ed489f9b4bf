"""Classified incidents: verdicts without a model, deduplication, ranking, summaries."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsieve import rules
from logsieve.functions import text as T
from logsieve.operators.incidents import priority, with_place

c = F.col


def _mapped(value: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(
        *[F.when(value == k, F.lit(v)) for k, v in table.items()], F.lit(default)
    )


def rule_triage(incidents: DataFrame, mode: str = "faithful") -> DataFrame:
    """Verdicts from the rule hints alone. ``incidents`` carry ``candidate_index``.

    ``faithful`` keeps the inherited placeholder table, whose values are outside the
    accepted enums; ``canonical`` uses accepted values only.
    """
    if mode not in ("faithful", "canonical"):
        raise ValueError(f"unknown mode: {mode}")
    faithful = mode == "faithful"
    table = rules.PLACEHOLDER_VERDICTS if faithful else rules.ENUM_VERDICTS
    hint = F.lower(T.trim_all(c("verdict_hint")))
    severity = (
        F.when(c("score") >= 10, F.lit("high"))
        .when(c("score") >= 7, F.lit("medium"))
        .when(c("score") >= 4, F.lit("low"))
        .otherwise(F.lit("info"))
    )
    return incidents.withColumns(
        {
            "log_id": c("id"),
            "verdict": _mapped(hint, table, "inconclusive"),
            "severity": severity,
            "confidence": F.lit("low"),
            "false_positive_possible": F.lit(True),
            "reasoning_summary": F.lit(rules.PLACEHOLDER_SUMMARY),
            "evidence_fields": F.slice("reason_hints", 1, 8),
            "recommended_actions": F.array(
                F.lit("manual_review" if faithful else "review_raw_log")
            ),
        }
    ).drop("id")


def known_assets_from(text: str) -> list[str]:
    """Comma-separated addresses to a sorted distinct list."""
    return sorted({p.strip() for p in text.split(",") if p.strip()})


def flag_known_assets(df: DataFrame, assets) -> DataFrame:
    """Adds ``known_asset``. ``assets`` is a short list, or a table with a column ``ip``.

    A table is joined on equality; Spark broadcasts it only below its size threshold.
    """
    if isinstance(assets, DataFrame):
        listed = assets.select(c("ip").alias("src_ip")).distinct().withColumn(
            "listed", F.lit(True)
        )
        return df.join(listed, "src_ip", "left").withColumn(
            "known_asset", F.coalesce("listed", F.lit(False))
        ).drop("listed")
    return df.withColumn("known_asset", c("src_ip").isin(list(assets)))


def _or_dash(name: str) -> Column:
    return T.first_text(T.raw_text(c(name)), F.lit("-"))


def dedup_key() -> Column:
    rid = T.raw_text(c("request_id"))
    second = F.date_format(
        F.from_utc_timestamp(c("log_time"), rules.LOCAL_ZONE), "yyyy-MM-dd'T'HH:mm:ss"
    )
    second = F.coalesce(F.concat(second, F.lit(rules.LOCAL_OFFSET)), F.lit("-"))
    fallback = F.concat(
        F.lit("fallback:"),
        F.concat_ws(
            "|", _or_dash("src_ip"), _or_dash("method"), _or_dash("uri"),
            F.coalesce("status_code", F.lit(0)), second,
        ),
    )
    return F.when((rid != "") & (rid != "-"), F.concat(F.lit("request_id:"), rid)).otherwise(
        fallback
    )


def _ranks() -> tuple[Column, Column, Column]:
    return (
        priority(c("severity"), rules.SEVERITY_RANK),
        priority(c("confidence"), rules.CONFIDENCE_RANK),
        priority(c("source_table"), rules.TRIAGE_SOURCE_PRIORITY),
    )


REPRESENTATIVE = [
    "candidate_index", "incident_group_key", "request_id", "error_link_id", "source_table",
    "log_id", "src_ip", "method", "uri", "query", "log_time", "status_code", "score",
    "verdict_hint", "reason_hints", "response_body_bytes", "resp_content_type", "target",
    "path_normalized", "html_fallback", "hpp_detected", "hpp_param_names",
    "embedded_attack_hint", "verdict", "severity", "confidence", "reasoning_summary",
    "evidence_fields",
]


def triage_dedup(results: DataFrame, known_assets=()) -> DataFrame:
    """Classified rows merged by request id, else by address, request and second."""
    severity, confidence, table = _ranks()
    keyed = results.withColumn("dedup_key", dedup_key())
    best = F.struct(
        table, severity, confidence, "score", "log_time", (-c("candidate_index")).alias("first")
    )
    merged = keyed.groupBy("dedup_key").agg(
        F.max_by(F.struct(*REPRESENTATIVE), best).alias("best"),
        F.count("*").alias("duplicate_count"),
        F.min("candidate_index").alias("first_index"),
        F.array_sort(F.collect_set(_or_dash("source_table"))).alias("source_tables"),
    )
    actions = (
        keyed.select(
            "dedup_key", "candidate_index",
            F.posexplode("recommended_actions").alias("pos", "action"),
        )
        .where(T.raw_text(c("action")) != "")
        .groupBy("dedup_key", T.raw_text(c("action")).alias("action"))
        .agg(F.min(F.struct("candidate_index", "pos")).alias("first_seen"))
        .groupBy("dedup_key")
        .agg(
            F.array_sort(F.collect_list(F.struct("first_seen", "action")))
            .getField("action").alias("recommended_actions")
        )
    )
    none = F.array().cast("array<string>")
    out = merged.join(actions, "dedup_key", "left").select(
        "dedup_key", "duplicate_count", "first_index", "source_tables",
        F.coalesce("recommended_actions", none).alias("recommended_actions"), "best.*",
    )
    ref = F.concat(
        c("dedup_key"), F.lit("|table:"), _or_dash("source_table"), F.lit("|log_id:"),
        _or_dash("log_id"), F.lit("|candidate:"), _or_dash("candidate_index"),
    )
    return flag_known_assets(out.withColumn("incident_ref", ref), known_assets)


def merged_request_ids(results: DataFrame) -> DataFrame:
    """dedup_key, request_id of all rows behind each deduplicated incident, each pair once; no id is ``-``."""
    keyed = results.withColumn("dedup_key", dedup_key())
    return keyed.select("dedup_key", _or_dash("request_id").alias("request_id")).distinct()


def rank_order() -> list[Column]:
    severity, confidence, table = _ranks()
    return [
        severity.desc(), confidence.desc(), c("score").desc(), table.desc(),
        c("log_time").desc(), c("first_index").asc(),
    ]


def ranked(deduped: DataFrame) -> DataFrame:
    """All incidents with their rank, from 1."""
    return with_place(deduped.orderBy(*rank_order()), "_place").withColumn(
        "rank", c("_place") + 1
    ).drop("_place")


def top_incidents(deduped: DataFrame, incidents: DataFrame, limit: int = 12) -> DataFrame:
    """The highest ranked incidents with the evidence behind them."""
    top = deduped.orderBy(*rank_order()).limit(limit)
    # At most ``limit`` rows from here on.
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order())))
    joined = attach_evidence(ranked, incidents)
    hints = F.coalesce(c("evidence.reason_hints"), c("reason_hints"))
    return joined.withColumns(
        {
            "reason_hints": hints,
            "user_agent": T.shorten(c("evidence.user_agent"), 160),
            "raw_request": T.shorten(c("evidence.request_text"), 180),
            "raw_log_excerpt": T.shorten(c("evidence.log_text"), 280),
            "request_id": _or_dash("request_id"),
        }
    ).drop("evidence")


def attach_evidence(results: DataFrame, incidents: DataFrame) -> DataFrame:
    """Adds ``evidence``: the incident found by key, else request id, else source and log id.

    The three lookups are stacked into one equality join of keys.
    """
    def keys(log_id: str) -> Column:
        def entry(place: int, kind: str, value: Column) -> Column:
            return F.struct(
                F.lit(place).alias("place"), F.concat(F.lit(kind), value).alias("lookup")
            )

        def given(name: str) -> Column:
            return F.nullif(T.raw_text(c(name)), F.lit(""))

        log = F.nullif(given(log_id), F.lit("-"))
        return F.array(
            entry(1, "key:", given("incident_group_key")),
            entry(2, "rid:", given("request_id")),
            entry(3, "log:", F.concat(given("source_table"), F.lit(":"), log)),
        )

    asked = results.select("dedup_key", F.inline(keys("log_id"))).where("lookup is not null")
    order = F.struct((-c("score")).alias("s"), (-F.unix_millis("log_time")).alias("t"), "first_arrival")
    # only keys that are asked for, and no texts, are grouped; the texts of what was found are fetched at the end
    narrow = incidents.select("incident_group_key", order.alias("order"), F.inline(keys("id"))).drop("place")
    lookup = (
        narrow.join(asked.select("lookup").distinct(), "lookup", "left_semi")
        .groupBy("lookup")
        .agg(F.min_by("incident_group_key", "order").alias("found_key"))
    )
    found = (
        asked.join(lookup, "lookup")
        .groupBy("dedup_key")
        .agg(F.min_by("found_key", "place").alias("found_key"), F.min("place").alias("found_by"))
    )
    texts = incidents.select(
        c("incident_group_key").alias("found_key"),
        F.struct("reason_hints", "user_agent", "request_text", "log_text").alias("evidence"),
    )
    return results.join(found, "dedup_key", "left").join(texts, "found_key", "left").drop("found_key")


def _facts() -> Column:
    def entry(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("fact"), value.alias("value"))

    return F.concat(
        F.array(
            entry("verdict", T.first_text(c("verdict"), F.lit("inconclusive"))),
            entry("uri", _or_dash("uri")),
        ),
        F.transform("recommended_actions", lambda a: entry("action", a)),
    )


def top3_per_ip(deduped: DataFrame) -> DataFrame:
    """Most frequent verdicts, uris and actions per address; ties by first seen."""
    severity, confidence, table = _ranks()
    seen = F.struct(
        severity.alias("sv"), confidence.alias("cf"), "score", table.alias("tb"), "log_time",
        (-c("first_index")).alias("first"),
    )
    counts = (
        deduped.select(_or_dash("src_ip").alias("src_ip"), seen.alias("seen"), F.inline(_facts()))
        .groupBy("src_ip", "fact", "value")
        .agg(F.count("*").alias("n"), F.max("seen").alias("seen"))
    )
    order = Window.partitionBy("src_ip", "fact").orderBy(c("n").desc(), c("seen").desc())
    return counts.withColumn("place", F.row_number().over(order)).where("place <= 3").select(
        "src_ip", "fact", "place", "value", "n"
    )


def triage_by_ip(deduped: DataFrame, results: DataFrame, known_assets=()) -> DataFrame:
    """Incidents per address with the worst severity and confidence and the top values."""
    ip = _or_dash("src_ip").alias("src_ip")

    def label(rank: str, ranks: dict[str, int], least: str) -> Column:
        named = [F.when(c(rank) == r, F.lit(n)) for n, r in ranks.items()]
        return F.coalesce(*named, F.lit(least))

    severity, confidence, _ = _ranks()
    totals = deduped.groupBy(ip).agg(
        F.count("*").alias("incident_count"),
        F.max(severity).alias("severity_rank"),
        F.max(confidence).alias("confidence_rank"),
    )
    raw = results.groupBy(ip).agg(F.count("*").alias("raw_row_count"))
    top = top3_per_ip(deduped).groupBy("src_ip").agg(
        *[
            F.array_sort(
                F.collect_list(F.when(c("fact") == f, F.struct("place", "value")))
            ).getField("value").alias(name)
            for f, name in (
                ("verdict", "top_verdicts"), ("uri", "top_uris"), ("action", "top_actions")
            )
        ]
    )
    out = totals.join(raw, "src_ip", "left").join(top, "src_ip", "left").withColumns(
        {
            "max_severity": label("severity_rank", rules.SEVERITY_RANK, "info"),
            "max_confidence": label("confidence_rank", rules.CONFIDENCE_RANK, "low"),
        }
    )
    return flag_known_assets(out, known_assets)


def top_ips(by_ip: DataFrame, limit: int = 8) -> DataFrame:
    return by_ip.orderBy(
        c("severity_rank").desc(), c("confidence_rank").desc(), c("incident_count").desc(),
        "src_ip",
    ).limit(limit)


def distributions(deduped: DataFrame) -> DataFrame:
    """Counts by verdict, severity, source table and action in one grouping."""
    def entry(kind: str, value: Column) -> Column:
        shown = T.first_text(T.raw_text(value), F.lit("unknown"))
        return F.struct(F.lit(kind).alias("distribution"), shown.alias("value"))

    entries = F.concat(
        F.array(
            entry("verdicts", c("verdict")),
            entry("severities", c("severity")),
            entry("source_tables", c("source_table")),
        ),
        F.transform("recommended_actions", lambda a: entry("recommended_actions", a)),
    )
    return deduped.select(F.inline(entries)).groupBy("distribution", "value").agg(
        F.count("*").alias("count")
    )


def known_asset_matches(deduped: DataFrame) -> DataFrame:
    """Known assets among the incident addresses, with their incident counts."""
    return deduped.where("known_asset").groupBy("src_ip").agg(
        F.count("*").alias("incident_count")
    )


def notable_lookup(items: DataFrame, top: DataFrame) -> DataFrame:
    """Report items with the incident they refer to; unknown references stay."""
    facts = top.select(
        "incident_ref", "uri", "method", "status_code", "score", "log_time",
        "duplicate_count", "source_tables", "known_asset", "reasoning_summary",
    )
    return items.join(facts, "incident_ref", "left")
