"""Bursts of directory probing.

A burst opens at a probe and takes every probe of the same address up to 120 s after
its own start. Starts are more than 120 s apart, so a 120 s block holds at most one.
The steps are: reduce probes to distinct milliseconds per address; find the starts
(``chains``, in parallel over chunks of a busy address); give every probe its start by an
equality join on the block; count.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsieve import rules
from logsieve.functions import paths as P
from logsieve.functions import text as T
from logsieve.functions.stage import hold, where_once
from logsieve.operators import chains
from logsieve.sources.store import materialize

c = F.col
GAP = rules.WINDOW_MS


def probes(requests: DataFrame) -> DataFrame:
    """Requests that look like a probing step, reduced to what a burst needs."""
    path = F.lower(T.norm(F.lower(P.effective_path(c("uri"), c("target")))))
    rows = hold(requests, {"path": path, "query_low": F.lower(T.norm(c("query")))})
    timed = c("method").isin("GET", "HEAD", "OPTIONS") & c("log_time").isNotNull()
    rows = where_once(rows, timed & P.is_burst_probe(c("path"), c("query_low")))
    return rows.select(
        "src_ip", "source_position", "id",
        F.unix_millis("log_time").alias("ms"),
        F.floor(F.unix_millis("log_time") / GAP).alias("block"),
        "path",
        "status_code",
        P.content_type_bucket(c("resp_content_type")).alias("content_type"),
        "response_body_bytes",
    )


def assign_starts(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Adds ``start_ms``: the start in the row's own block, else the one in the block before."""
    block = F.floor(c("start_ms") / GAP)
    reach = starts.select(
        "src_ip",
        F.inline(
            F.array(
                F.struct(block.alias("block"), c("start_ms").alias("own"),
                         F.lit(None).cast("bigint").alias("earlier")),
                F.struct((block + 1).alias("block"), F.lit(None).cast("bigint").alias("own"),
                         c("start_ms").alias("earlier")),
            )
        ),
    ).groupBy("src_ip", "block").agg(F.max("own").alias("own"), F.max("earlier").alias("earlier"))
    picked = F.when(c("ms") >= c("own"), c("own")).otherwise(c("earlier"))
    return rows.join(reach, ["src_ip", "block"]).withColumn("start_ms", picked).drop(
        "own", "earlier"
    )


def probing_bursts(requests: DataFrame) -> DataFrame:
    """One row per burst of at least three probes on at least three paths."""
    rows = materialize(probes(requests), "probes")  # narrow, few, and read three times
    return summaries(with_starts(rows))


def with_starts(rows: DataFrame) -> DataFrame:
    """Probes with the start of their burst, ``start_ms``."""
    points = rows.select("src_ip", "block", "ms").distinct()
    return assign_starts(rows, chains.starts(points, GAP))


def summaries(assigned: DataFrame) -> DataFrame:
    """One row per burst of at least three probes on at least three paths."""
    html = (
        (c("status_code") == 200) & (c("content_type") == "text/html")
        & (c("response_body_bytes") > 0)
    )

    def fact(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("fact"), value.cast("string").alias("value"))

    key = ["src_ip", "start_ms"]
    facts = assigned.select(
        *key, "ms", F.struct("ms", "source_position", "id").alias("arrival"),
        F.inline(
            F.array(
                fact("path", c("path")),
                fact("status", c("status_code")),
                fact("content_type", T.first_text(c("content_type"), F.lit("-"))),
                fact("html_size", F.when(html, c("response_body_bytes"))),
            )
        ),
    ).where("value is not null")
    values = facts.groupBy(*key, "fact", "value").agg(
        F.count("*").alias("n"), F.min("arrival").alias("first_seen"), F.max("ms").alias("last_ms")
    )
    is_path, is_size = c("fact") == "path", c("fact") == "html_size"
    flags = P.probe_hint_flags(c("value"))
    rank = F.struct(c("n"), -c("first_seen.ms"), -c("first_seen.source_position"),
                    -c("first_seen.id"))

    def histogram(name: str) -> Column:
        entry = F.struct((-c("n")).alias("minus_n"), c("value").alias("value"))
        return F.array_sort(F.collect_list(F.when(c("fact") == name, entry)))

    summary = values.groupBy(*key).agg(
        F.sum(F.when(is_path, c("n"))).alias("request_count"),
        F.sum(is_path.cast("bigint")).alias("distinct_path_count"),
        F.max("last_ms").alias("end_ms"),
        histogram("status").alias("status_counts"),
        histogram("content_type").alias("content_type_counts"),
        F.sum(F.when(is_size, c("n")).otherwise(0)).alias("html_rows"),
        F.max_by(F.when(is_size, c("value")), F.when(is_size, rank)).alias("top_size"),
        F.max(F.when(is_size, c("n"))).alias("top_size_rows"),
        *[
            F.min(F.when(is_path & flag, c("first_seen"))).alias(f"hint_{i}")
            for i, flag in enumerate(flags)
        ],
    ).where(
        (c("request_count") >= rules.BURST_MIN_REQUESTS)
        & (c("distinct_path_count") >= rules.BURST_MIN_PATHS)
    )
    # Spark keeps the first few of each burst in every task before rows travel
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("first_seen"))
    first_paths = (
        values.where(is_path)
        .withColumn("nth", nth)
        .where(c("nth") <= rules.BURST_SAMPLE_PATHS)
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("nth", "value"))).getField("value").alias(
            "sample_paths"))
    )
    repeated = (c("top_size_rows") >= 2) & (c("top_size_rows") * 2 >= c("html_rows"))
    ordered = F.array_sort(
        F.array(
            *[
                F.struct(
                    c(f"hint_{i}").isNull().alias("missing"),
                    c(f"hint_{i}").alias("first_seen"),
                    F.lit(i).alias("place"),
                    F.when(c(f"hint_{i}").isNotNull(), F.lit(h)).alias("hint"),
                )
                for i, h in enumerate(P.PROBE_HINTS)
            ]
        )
    ).getField("hint")
    hints = F.array_except(
        F.concat(
            ordered,
            F.array(F.when(repeated, F.lit("dir_probe:repeated_fallback_like_html"))),
        ),
        F.array(F.lit(None).cast("string")),
    )
    return summary.join(first_paths, key).select(
        F.lit("low_signal_dir_probe_burst").alias("category"),
        F.lit("context_only").alias("policy"),
        "src_ip",
        F.timestamp_millis("start_ms").alias("start"),
        F.timestamp_millis("end_ms").alias("end"),
        F.lit(GAP // 1000).alias("window_sec"),
        "request_count", "distinct_path_count", "sample_paths",
        F.transform(
            "status_counts", lambda x: F.struct(x["value"].alias("key"), (-x["minus_n"]).alias("count"))
        ).alias("status_counts"),
        F.transform(
            "content_type_counts",
            lambda x: F.struct(x["value"].alias("key"), (-x["minus_n"]).alias("count")),
        ).alias("content_type_counts"),
        F.when(repeated, c("top_size").cast("bigint")).alias("dominant_response_body_bytes"),
        F.when(repeated, c("top_size_rows")).alias("dominant_count"),
        hints.alias("reason_hints"),
        F.lit(rules.BURST_NOTE).alias("interpretation_hint"),
    )


def burst_paths(requests: DataFrame) -> DataFrame:
    """src_ip, start_ms, place, path: every distinct path of each burst, by first arrival."""
    assigned = with_starts(materialize(probes(requests), "probes"))
    key = ["src_ip", "start_ms"]
    first = assigned.groupBy(*key, "path").agg(
        F.count("*").alias("n"), F.min(F.struct("ms", "source_position", "id")).alias("arrival")
    )
    first = materialize(first, "burst-paths")
    kept = first.groupBy(*key).agg(F.sum("n").alias("n"), F.count("*").alias("paths")).where(
        (c("n") >= rules.BURST_MIN_REQUESTS) & (c("paths") >= rules.BURST_MIN_PATHS)
    )
    wanted = first.drop("n").join(kept.select(*key), key, "left_semi")
    return chains.place_within(wanted, key, [c("arrival")]).select(*key, "place", "path")
