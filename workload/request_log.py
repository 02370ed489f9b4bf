"""The request log, derived in Spark from ``events`` and ``pages``.

All three source tables come from one row-wise projection, so their size grows
with ``events``. ``pages`` is joined on an equality; Spark decides by its size
whether to broadcast it.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.sources.store import materialize
from workload import templates as W


def _pick(position, values, kind="string"):
    literals = F.array(*[F.lit(v).cast(kind) for v in values])
    return F.get(literals, position.cast("int"))


def spread(df: DataFrame) -> DataFrame:
    """At least one task per core. Does nothing once the input has that many splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_written: dict = {}

#: Bytes of a row group of the log. Small ones let Spark cut files into even tasks, however large the files are.
ROW_GROUP = 4 << 20


def base_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived log as a stored table, written once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        _written[key] = materialize(
            derive_log(spark, sf_dir), "request-log", **{"parquet.block.size": str(ROW_GROUP)}
        )
    return _written[key]


def derive_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    n_pages = pages.count()  # read from the file footers
    e = events.select("event_id", "user_id", "value").withColumn(
        "page_key", F.col("event_id") % n_pages
    )
    joined = spread(e).join(pages, F.col("page_key") == F.col("page_id"))
    ev = F.col("event_id")
    t = ev % len(W.ATTACKS)
    cols = list(zip(*W.ATTACKS))
    url = F.col("url")
    rows = joined.select(
        "event_id",
        "user_id",
        "value",
        (F.floor(ev / 64) % 4).alias("phase"),
        F.regexp_extract(url, r"^https?://[^/]+(/[^?#]*)", 1).alias("page_path"),
        F.regexp_extract(url, r"(\?[^#]*)", 1).alias("page_query"),
        *[
            _pick(t, cols[i], kind).alias(f"a_{name}")
            for i, (name, kind) in enumerate(
                [
                    ("method", "string"), ("target", "string"), ("uri", "string"),
                    ("query", "string"), ("status", "bigint"), ("reqct", "string"),
                    ("respct", "string"), ("bytes", "bigint"), ("agent", "string"),
                ]
            )
        ],
        _pick(ev % len(W.PROBES), W.PROBES).alias("probe_path"),
    )
    attack, probing = F.col("phase") == 1, F.col("phase") == 3
    fallback = probing & (ev % 4 == 0)
    by_event = (
        F.when(ev % 4 == 2, F.lit("curl/8.5.0"))
        .when((ev % 4 == 3) & attack, F.lit("sqlmap/1.8"))
        .otherwise(F.lit(W.BROWSER))
    )
    agent = (
        F.when(attack & (F.col("a_agent") == "browser"), F.lit(W.BROWSER))
        .when(attack & F.col("a_agent").isNotNull(), F.col("a_agent"))
        .otherwise(by_event)
    )
    path = (
        F.when(attack, F.col("a_target")).when(probing, F.col("probe_path"))
        .otherwise(F.col("page_path"))
    )
    query = (
        F.when(attack, F.col("a_query")).when(probing, F.lit(""))
        .otherwise(F.col("page_query"))
    )
    method = F.when(attack, F.col("a_method")).otherwise(F.lit("GET"))
    shaped = rows.select(
        (ev + 1).alias("id"),
        F.timestamp_millis(F.lit(W.START_MS) + ev * 2000).alias("log_time"),
        F.when(ev % 7 == 0, F.lit(None).cast("string"))
        .when(ev % 53 == 2, F.lit("-")).when(ev % 59 == 3, F.lit("null"))
        .when(ev % 97 == 5, F.lit("rqhot"))
        .when(ev % 50 == 11, F.concat(F.lit("rqs"), F.floor(ev / 2000)))
        .otherwise(F.concat(F.lit("rq"), ev)).alias("request_id"),
        F.when(ev % 11 == 0, F.concat(F.lit("el"), ev)).alias("error_link_id"),
        F.concat(
            F.lit("10.1."), F.floor(ev / 6400) % 250, F.lit("."), F.col("user_id") % 6 + 1
        ).alias("src_ip"),
        method.alias("method"),
        F.concat(method, F.lit(" "), path, query, F.lit(" HTTP/1.1")).alias("raw_request"),
        F.when(attack & F.col("a_uri").isNotNull(), F.col("a_uri")).otherwise(path).alias("uri"),
        query.alias("query_string"),
        F.lit("HTTP/1.1").alias("protocol"),
        F.when(ev % 13 == 0, 404).when(ev % 17 == 0, 500)
        .when(attack, F.col("a_status")).otherwise(200).cast("bigint").alias("status_code"),
        F.when(fallback, 75002).when(attack & F.col("a_bytes").isNotNull(), F.col("a_bytes"))
        .otherwise(F.floor(F.col("value") * 100)).cast("bigint").alias("response_body_bytes"),
        F.floor(F.col("value") * 10000).cast("bigint").alias("duration_us"),
        F.floor(F.col("value") * 6000).cast("bigint").alias("ttfb_us"),
        F.when(attack, F.col("a_reqct")).alias("req_content_type"),
        F.coalesce(F.when(attack, F.col("a_respct")), F.lit("text/html")).alias(
            "resp_content_type"
        ),
        F.when(ev % 3 != 0, F.lit("http://shop.example/")).alias("referer"),
        agent.alias("user_agent"),
        F.lit("shop.example").alias("host"),
    )
    stamp = F.date_format(
        F.from_utc_timestamp("log_time", "Asia/Seoul"), "dd/MMM/yyyy:HH:mm:ss"
    )
    return shaped.withColumn(
        "raw_log",
        F.concat(
            F.col("src_ip"), F.lit(" - - ["), stamp, F.lit(' +0900] "'), F.col("raw_request"),
            F.lit('" '), F.col("status_code"), F.lit(" "), F.col("response_body_bytes"),
            F.lit(' "'), F.coalesce("referer", F.lit("-")), F.lit('" "'), F.col("user_agent"),
            F.lit('" "shop.example" main'),
        ),
    )


def source_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """security: all rows; access: every 5th; error: every 9th, sharing the request id."""
    log = base_log(spark, sf_dir)
    ev = F.col("id") - 1
    access = log.where(ev % 5 == 0).select(
        "id", "log_time", F.col("src_ip").alias("client_ip"), "method", "raw_request", "uri",
        "query_string", "protocol", "status_code", "response_body_bytes", "referer",
        "user_agent", "host", F.lit("main").alias("vhost"), "raw_log",
    )
    error = log.where(ev % 9 == 0).select(
        "id", "log_time", "error_link_id", "request_id", F.lit("core").alias("module_name"),
        F.lit("error").alias("log_level"), "src_ip", F.col("src_ip").alias("peer_ip"),
        F.concat(F.lit("AH00128: File does not exist: /srv/www"), F.col("uri")).alias("message"),
        F.concat(F.lit("[core] AH00128: File does not exist: /srv/www"), F.col("uri")).alias(
            "raw_log"
        ),
    )
    return {"security": log, "access": access, "error": error}
