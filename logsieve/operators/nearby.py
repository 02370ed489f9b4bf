"""Left-out requests close in time to a strong SQL-injection incident.

"Any incident within 120 s" is answered from running minima, maxima and counts, not
from pairs. Incidents and requests are first reduced to distinct milliseconds per
(address, endpoint), then cut into 120 s buckets: the window around a time covers its
own bucket, a tail of the bucket before and a head of the one after. A bucket holds at
most 120 000 distinct times, whatever the traffic, so no group grows with the data.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsieve import rules
from logsieve.functions import paths as P
from logsieve.functions import text as T
from logsieve.operators import context as C
from logsieve.operators.score import high_signal_sqli

c = F.col
KEY = ["src_ip", "kind", "key"]
UNKNOWN = -(1 << 60)  # stands for "no time", before any timestamp
MINIMA = ["min_status", "min_size", "min_positive"]
MAXIMA = ["max_status", "max_size", "max_positive"]


def endpoint_keys(uri: Column) -> Column:
    """Keys under which two requests count as the same endpoint.

    ``x`` marks requests that share both uri and family, so they are not counted twice;
    it matters only for a uri that still holds a question mark after decoding.
    """
    stored, family = T.norm(uri), P.endpoint_family(uri)
    def entry(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    odd = F.when(stored.contains("?"), F.concat_ws("\x00", stored, family))
    return F.array(entry("family", family), entry("uri", stored), entry("x", odd))


def _millis(ts: Column) -> Column:
    return F.coalesce(F.unix_millis(ts), F.lit(UNKNOWN).cast("bigint"))


def _combine(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[F.min(m).alias(m) for m in MINIMA],
        *[F.max(m).alias(m) for m in MAXIMA],
    )


def _reference_points(strong: DataFrame) -> DataFrame:
    """Incidents reduced to one row per endpoint key and millisecond."""
    size = c("response_body_bytes")
    rows = strong.select(
        T.norm(c("src_ip")).alias("src_ip"),
        _millis(c("log_time")).alias("ms"),
        F.lit(1).cast("bigint").alias("n"),
        c("status_code").alias("min_status"), c("status_code").alias("max_status"),
        size.alias("min_size"), size.alias("max_size"),
        F.when(size > 0, size).alias("min_positive"),
        F.when(size > 0, size).alias("max_positive"),
        F.inline(endpoint_keys(c("uri"))),
    ).where("key is not null")
    return _combine(rows, [*KEY, "ms"])


def _within_window(points: DataFrame, reference: DataFrame) -> DataFrame:
    """For each timed point: measures of the timed references at most 120 s away."""
    width = rules.WINDOW_MS
    bucket = F.floor(c("ms") / width)
    measures = ["n", *MINIMA, *MAXIMA]

    def role(name: str, shift: int) -> Column:
        return F.struct(
            F.lit(name).alias("role"),
            (bucket + shift).alias("bucket"),
            (c("ms") + shift * width).alias("at"),
        )

    placed = reference.where(c("ms") != UNKNOWN).select(
        *KEY, *measures,
        F.inline(F.array(role("same", 0), role("before", 1), role("after", -1))),
    )
    asked = points.where(c("ms") != UNKNOWN).select(
        *KEY, *[F.lit(None).cast("bigint").alias(m) for m in measures],
        F.lit("ask").alias("role"), bucket.alias("bucket"), c("ms").alias("at"),
    )
    cell = Window.partitionBy(*KEY, "bucket")
    head = cell.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tail = cell.orderBy(c("at").desc()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )

    def over(name: str, agg, role_name: str, window) -> Column:
        return agg(F.when(c("role") == role_name, c(name))).over(window)

    cols = {}
    for names, agg in ((["n"], F.sum), (MINIMA, F.min), (MAXIMA, F.max)):
        for m in names:
            cols[f"{m}_same"] = over(m, agg, "same", cell)
            cols[f"{m}_after"] = over(m, agg, "after", head)
            cols[f"{m}_before"] = over(m, agg, "before", tail)
    parts = ("same", "after", "before")
    both = placed.unionByName(asked).withColumns(cols).where(c("role") == "ask")
    zero = F.lit(0).cast("bigint")
    total = sum((F.coalesce(c(f"n_{p}"), zero) for p in parts), zero)
    return both.select(
        *KEY, c("at").alias("ms"), total.alias("n"),
        *[F.least(*[c(f"{m}_{p}") for p in parts]).alias(m) for m in MINIMA],
        *[F.greatest(*[c(f"{m}_{p}") for p in parts]).alias(m) for m in MAXIMA],
    ).where("n > 0")


def nearby_measures(points: DataFrame, reference: DataFrame) -> DataFrame:
    """Measures per point; a time unknown on either side counts as near."""
    timed = _within_window(points, reference)
    untimed = _combine(reference.where(c("ms") == UNKNOWN), KEY)
    everything = _combine(reference, KEY)
    parts = timed.unionByName(
        points.where(c("ms") != UNKNOWN).join(untimed, KEY)
    ).unionByName(points.where(c("ms") == UNKNOWN).join(everything, KEY))
    return _combine(parts, [*KEY, "ms"])


def size_differs(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    share = F.floor(F.greatest(a, b).cast("double") * 0.3)
    near_zero = (a <= 0) | (b <= 0)
    return F.when(near_zero, gap >= 256).otherwise(gap >= F.greatest(F.lit(256), share))


def local_bucket(ts: Column) -> Column:
    start = F.timestamp_seconds(F.floor(F.unix_seconds(ts) / 120) * 120)
    text = F.date_format(
        F.from_utc_timestamp(start, rules.LOCAL_ZONE), "yyyy-MM-dd'T'HH:mm:ss"
    )
    return F.coalesce(F.concat(text, F.lit(rules.LOCAL_OFFSET)), F.lit("unknown-time"))


def temporal_key(src_ip: Column, uri: Column, ts: Column) -> Column:
    return F.concat_ws("|", T.norm(src_ip), P.endpoint_family(uri), local_bucket(ts))


def supporting_events(
    left_out: DataFrame, incidents: DataFrame, min_score: int = rules.MIN_SCORE
) -> DataFrame:
    """Left-out requests with a query that give context to a nearby incident."""
    strong = high_signal_sqli(incidents, min_score)
    reference = _reference_points(strong)
    addresses = reference.select("src_ip").distinct()
    rows = left_out.where(c("query") != "").join(addresses, "src_ip", "left_semi")
    row_id = ["source_position", "id"]
    keys = rows.select(
        *row_id, "src_ip", _millis(c("log_time")).alias("ms"),
        F.inline(endpoint_keys(c("uri"))),
    ).where("key is not null")
    measures = nearby_measures(keys.select(*KEY, "ms").distinct(), reference)
    near = (
        keys.join(measures, [*KEY, "ms"])
        .groupBy(*row_id)
        .agg(
            F.sum(F.when(c("kind") == "family", c("n")).otherwise(0)).alias("n_family"),
            F.sum(F.when(c("kind") == "uri", c("n")).otherwise(0)).alias("n_uri"),
            F.sum(F.when(c("kind") == "x", c("n")).otherwise(0)).alias("n_both"),
            *[F.min(m).alias(m) for m in MINIMA],
            *[F.max(m).alias(m) for m in MAXIMA],
        )
    )
    size, status = c("response_body_bytes"), c("status_code")
    odd = T.norm(c("uri")).contains("?")
    count = F.when(odd, c("n_family") + c("n_uri") - c("n_both")).otherwise(c("n_family"))
    hints = [
        (C.has_sql_keyword(c("query")), "supporting:sql_keyword_fragment"),
        (
            C.has_quote_noise(c("query_raw")),
            "supporting:special_chars_or_quote_repetition",
        ),
        (
            C.has_encoded_marker(c("query_raw")) | C.has_encoded_marker(c("target")),
            "supporting:encoded_payload_trace",
        ),
        (
            (c("min_status") != status) | (c("max_status") != status),
            "supporting:status_delta_from_nearby_candidate",
        ),
        (
            T.any_of(
                F.coalesce(size_differs(size, c(m)), F.lit(False))
                for m in ("min_size", "max_size", "min_positive", "max_positive")
            ),
            "supporting:response_size_delta_from_nearby_candidate",
        ),
        (c("n_uri") > 0, "supporting:same_uri_nearby_high_signal_sqli"),
    ]
    out = rows.join(near, row_id).withColumns(
        {
            "nearby_candidate_count": count,
            "reason_hints": P.compact([F.when(k, F.lit(h)) for k, h in hints]),
        }
    ).where(F.size("reason_hints") > 0)
    once = F.when(c("request_id") != "", c("request_id")).otherwise(
        F.concat_ws(
            ":", c("source_table"), c("id"), F.coalesce(c("log_time").cast("string"), F.lit("")),
            c("target"),
        )
    )
    order = Window.partitionBy("once").orderBy("source_position", "log_time", "id")
    return (
        out.withColumn("once", once)
        .withColumn("nth", F.row_number().over(order))
        .where("nth = 1")
        .select(
            F.lit("nearby_high_signal_sqli_context").alias("supporting_reason"),
            F.lit("temporal_context").alias("supporting_role"),
            "source_table", "source_position", "id", "log_time", "src_ip", "method", "uri",
            "query", "status_code", "response_body_bytes", "duration_us", "ttfb_us",
            "resp_content_type", "user_agent", "raw_request", "target", "request_id",
            "reason_hints",
            temporal_key(c("src_ip"), c("uri"), c("log_time")).alias("temporal_context_key"),
            "nearby_candidate_count",
        )
    )
