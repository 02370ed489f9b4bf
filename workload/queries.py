"""The registered queries: every operator over the whole derived log.

Texts and numbers only in the results: timestamps as epoch milliseconds, arrays sorted
and joined, so that any engine can compare them.
"""

from collections.abc import Callable
from datetime import timedelta

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions import paths as P
from logsieve.functions import text as T
from logsieve.functions.stage import hold
from logsieve.operators import (
    bursts, canon, context, incidents, iprisk, nearby, noise, responses, score, signatures,
    texts, triage,
)
from logsieve.plans import report
from logsieve.plans.run import TriageRun
from logsieve.sources import logs, store, tables
from logsieve.streaming import bursts as stream_bursts_module
from logsieve.streaming import ingest
from workload import lines as L
from workload import request_log as R
from workload import templates as W

c = F.col
ALL = "security,access,error"
ROW = ["source_table", "id"]
DAY_START, DAY_END = "2026-04-01 15:00:00", "2026-04-02 15:00:00"
AS_OF = "2026-04-02 12:00:00"
_runs: dict = {}


def run_of(spark: SparkSession, sf_dir: str, sources: str = ALL) -> TriageRun:
    """One run per session and data folder, so its written tables are shared by queries."""
    key = (spark.sparkContext.applicationId, sf_dir, sources)
    if key not in _runs:
        _runs[key] = TriageRun(
            R.source_tables(spark, sf_dir), sources, known_assets=W.KNOWN_ASSETS
        )
    return _runs[key]


def requests(spark: SparkSession, sf_dir: str, sources: str = "security") -> DataFrame:
    return canon.select_sources(R.source_tables(spark, sf_dir), sources)


def ms(name: str, alias: str | None = None) -> Column:
    return F.unix_millis(c(name)).alias(alias or f"{name}_ms")


def joined(name, alias: str | None = None) -> Column:
    col = c(name) if isinstance(name, str) else name
    return F.array_join(F.array_sort(col.cast("array<string>")), ",").alias(
        alias or (name if isinstance(name, str) else "joined")
    )


def yes(name) -> Column:
    """Boolean as 0/1."""
    col = c(name) if isinstance(name, str) else name
    out = F.coalesce(col, F.lit(False)).cast("int")
    return out.alias(name) if isinstance(name, str) else out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ------------------------------------------------------------- 2.1 sources


@query
def ingest_access(spark, d):
    parsed = logs.parse_access(L.access_lines(R.base_log(spark, d)))
    return parsed.select(ms("log_time"), *[n for n in parsed.columns if n != "log_time"])


@query
def ingest_security(spark, d):
    parsed = logs.parse_security(L.security_lines(R.base_log(spark, d)))
    return parsed.select(
        ms("log_time"),
        *[n for n in parsed.columns if n not in ("log_time", "raw_log", "is_suspicious")],
        yes("is_suspicious"), F.md5("raw_log").alias("raw_log_md5"),
    )


@query
def ingest_error(spark, d):
    parsed = logs.parse_error(L.error_lines(R.base_log(spark, d)))
    return parsed.select(
        ms("log_time"), *[n for n in parsed.columns if n not in ("log_time", "raw_log")]
    )


@query
def ingest_rejects(spark, d):
    log = R.base_log(spark, d)
    makers = {"access": L.access_lines, "security": L.security_lines, "error": L.error_lines}
    out = None
    for name, make in makers.items():
        part = logs.REJECTS[name](make(log)).select(F.lit(name).alias("source"), "raw_log")
        out = part if out is None else out.unionByName(part)
    return out


def _line_folder(spark, d, name="access") -> str:
    make = {"access": L.access_lines, "security": L.security_lines}[name]
    path = store.scratch_path(spark, f"lines-{name}")
    make(R.base_log(spark, d)).write.text(path)
    return path


@query
def stream_ingest(spark, d):
    """The lines of files that may grow, followed by offset until all of them are read."""
    sink, folder = store.scratch_path(spark, "ingested"), _line_folder(spark, d)
    rows = ingest.stream_ingest(spark, "access", f"{folder}/part-*", growing=True, flushSeconds=0, sliceBytes=1 << 20)
    q = ingest.start(rows, ingest.batch_writer(sink), store.scratch_path(spark, "cp"), once=False, every="0 seconds")
    q.processAllAvailable()
    q.stop()
    got = ingest.read_sink(spark, sink)
    return got.select(ms("log_time"), *[n for n in got.columns if n != "log_time"])


def _kind_folder(spark, d) -> str:
    """Lines of the three logs, each in its own folder."""
    path, log = store.scratch_path(spark, "lines"), R.base_log(spark, d)
    for name, make in (("security", L.security_lines), ("access", L.access_lines), ("error", L.error_lines)):
        make(log).write.text(f"{path}/kind={name}")
    return path


def _flushed(spark, base: str) -> DataFrame:
    """source, log_time, request_id and address of the rows of all three tables."""
    out = None
    for name, ip in (("security", "src_ip"), ("access", "client_ip"), ("error", "src_ip")):
        rows = ingest.read_sink(spark, base, name)
        rid = c("request_id") if name != "access" else F.lit(None).cast("string")
        part = rows.select(F.lit(name).alias("source"), ms("log_time"), rid.alias("request_id"), c(ip).alias("src_ip"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def stream_flush(spark, d):
    """Three kinds in one stream of micro-batches; each batch writes its three tables."""
    base = store.scratch_path(spark, "flushed")
    lines = ingest.stream_kinds(spark, _kind_folder(spark, d), 6)
    ingest.start(lines, ingest.tables_writer(base), store.scratch_path(spark, "cp")).awaitTermination()
    return _flushed(spark, base)


@query
def stream_replay(spark, d):
    """The second batch fails between two of its tables; the restart neither loses nor doubles."""
    base, cp = store.scratch_path(spark, "replayed"), store.scratch_path(spark, "cp")
    folder, write = _kind_folder(spark, d), ingest.tables_writer(base)

    def failing(batch, batch_id):
        if batch_id == 1:
            first = list(logs.PARSERS)[0]
            rows = logs.PARSERS[first](batch.where(c("kind") == first).select("value"))
            rows.write.mode("overwrite").parquet(f"{base}/{first}/batch_id={batch_id}")
            raise RuntimeError("sink lost between two tables")
        write(batch, batch_id)

    try:
        ingest.start(ingest.stream_kinds(spark, folder, 6), failing, cp).awaitTermination()
        raise AssertionError("the stream had no second batch")
    except StreamingQueryException as e:
        if "sink lost between two tables" not in str(e):
            raise
    ingest.start(ingest.stream_kinds(spark, folder, 6), write, cp).awaitTermination()
    return _flushed(spark, base)


def _utc(text: str) -> Column:
    return F.lit(text).cast("timestamp")


@query
def scan_range(spark, d):
    out = tables.scan_range(R.base_log(spark, d), _utc(DAY_START), _utc(AS_OF))
    return out.select("id", ms("log_time"), "src_ip", "uri", "status_code")


@query
def stored_log_range(spark, d):
    """The same range from a log stored by local day."""
    path = store.scratch_path(spark, "log-by-day")
    tables.write_log(R.base_log(spark, d), path)
    out = tables.read_log(spark, path, DAY_START, AS_OF)
    return out.select("id", ms("log_time"), "src_ip", "uri", "status_code")


@query
def scan_local_day(spark, d):
    start, end = tables.local_range(date="2026-04-02")
    out = tables.scan_range(R.base_log(spark, d), start, end)
    return out.select("id", ms("log_time"), "src_ip")


@query
def scan_recent(spark, d):
    out = tables.scan_recent(R.base_log(spark, d), AS_OF)
    return out.select(
        ms("log_time"), *[n for n in out.columns if n != "log_time"]
    )


@query
def scan_sources(spark, d):
    out = requests(spark, d, "error,security,access")
    return out.select("source_table", "source_position", "id", "src_ip", ms("log_time"))


@query
def export_local_time(spark, d):
    return tables.export_rows(R.base_log(spark, d).select("id", "log_time"))


@query
def export_counts(spark, d):
    return tables.export_counts(R.source_tables(spark, d))


@query
def read_export_json(spark, d):
    """All columns of the three tables, written with a manifest, verified and read back."""
    path = store.scratch_path(spark, "export")
    src = R.source_tables(spark, d)
    tables.write_export(src, path, {"table_option": ALL})
    shapes = {n: ", ".join(f"`{f.name}` {'string' if f.name == 'log_time' else f.dataType.simpleString()}" for f in df.schema) for n, df in src.items()}
    back = tables.read_export(spark, path, shapes)
    return _canon_view(canon.select_sources(back, ALL))


@query
def write_artifacts(spark, d):
    """The rows of the results that were written and read back."""
    run = run_of(spark, d)
    path = store.scratch_path(spark, "artifacts")
    frames = {"candidates": run.incidents, "noise": run.noise_groups, "filtered": run.passed_through}
    tables.write_artifacts(frames, path)
    back = tables.read_artifacts(spark, path, list(frames))
    item = {
        "candidates": ("incident_group_key", "score"),
        "noise": (F.concat_ws("|", "noise_category", "src_ip", "uri", "method", "status_code", "user_agent"), "count"),
        "filtered": (F.concat_ws("|", "source_table", "id", "noise_category"), "status_code"),
    }
    out = None
    for n, (key, value) in item.items():
        part = back[n].select(F.lit(n).alias("artifact"), (c(key) if isinstance(key, str) else key).alias("item"), c(value).cast("bigint").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


# --------------------------------------------------- 2.2 fields and functions


@query
def canon_fields(spark, d):
    return _canon_view(requests(spark, d, ALL))


def _canon_view(r: DataFrame) -> DataFrame:
    return r.select(
        *ROW, "src_ip", "method", "uri", "query", "request_text", "status_code",
        "response_body_bytes", "duration_us", "ttfb_us", "req_content_type",
        "resp_content_type", "user_agent", "referer", "request_id", "error_link_id",
        ms("log_time"),
    )


@query
def url_decode_tolerant(spark, d):
    """All page texts, as they come, with their stray percent signs."""
    pages = spark.read.parquet(f"{d}/pages.parquet")
    # escapes that are not UTF-8 are left to the tests: the check's engine refuses them
    text = F.regexp_replace("html", r"%[89A-Fa-f][0-9A-Fa-f]", "")
    return pages.select("page_id", F.md5(T.norm(text)).alias("decoded_md5"))


@query
def decode_variants(spark, d):
    return texts.variant_rows(texts.with_decode_depths(requests(spark, d)))


@query
def entity_variants(spark, d):
    return texts.entity_rows(texts.with_decode_depths(requests(spark, d)))


@query
def analysis_text(spark, d):
    r = texts.with_texts(requests(spark, d, ALL))
    return r.select(*ROW, F.md5("base_text").alias("base_md5"), F.md5("combined").alias("md5"))


@query
def request_target(spark, d):
    return requests(spark, d).select("id", "target")


@query
def effective_path(spark, d):
    return requests(spark, d, ALL).select(
        *ROW, P.effective_path(c("uri"), c("target")).alias("path")
    )


@query
def endpoint_family(spark, d):
    return requests(spark, d, ALL).select(*ROW, P.endpoint_family(c("uri")).alias("family"))


@query
def content_type_bucket(spark, d):
    return requests(spark, d).select(
        "id", P.content_type_bucket(c("resp_content_type")).alias("bucket")
    )


@query
def hpp_params(spark, d):
    return requests(spark, d).select("id", joined(P.repeated_params(c("query")), "names"))


@query
def special_ratio(spark, d):
    q = c("query")
    return requests(spark, d).select(
        "id", T.special_count(q).alias("special"), F.length(q).alias("length"),
        yes(T.special_ratio_at_least(q, 15)).alias("high"),
        yes(T.special_ratio_at_least(q, 30)).alias("very_high"),
    )


@query
def ua_class(spark, d):
    return requests(spark, d).select("id", yes(P.is_browser(c("user_agent"))).alias("browser"))


@query
def uri_class(spark, d):
    u = c("uri")
    return requests(spark, d).select(
        "id", yes(P.is_login_uri(u)).alias("login"),
        yes(P.is_query_heavy_uri(u)).alias("query_heavy"), yes(P.is_static_uri(u)).alias("static"),
    )


@query
def json_content_type(spark, d):
    return requests(spark, d).select(
        "id", yes(P.is_json_type(c("req_content_type"))).alias("request_json"),
        yes(P.is_json_type(c("resp_content_type"))).alias("response_json"),
    )


@query
def flexible_time(spark, d):
    """Local ISO text whose plus sign is lost in decoding, read back."""
    text = tables.local_iso(c("log_time"))
    return requests(spark, d, ALL).select(
        *ROW, F.unix_millis(T.flexible_time(text)).alias("log_time_ms")
    )


@query
def temporal_key(spark, d):
    return requests(spark, d, ALL).select(
        *ROW, nearby.temporal_key(c("src_ip"), c("uri"), c("log_time")).alias("k")
    )


@query
def second_bucket(spark, d):
    return requests(spark, d).select("id", incidents.local_second(c("log_time")).alias("second"))


@query
def identifier_norm(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    raw = F.get(
        F.array(*[F.lit(v) for v in ["-", "none", "NULL", "n/a", " na ", "", "a%2Bb", "null"]]),
        (c("event_id") % 9).cast("int"),
    )
    return e.select("event_id", T.identifier(F.coalesce(raw, c("event_type"))).alias("ident"))


@query
def shorten_text(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(
        "doc_id", *[T.shorten(c("text"), n).alias(f"short_{n}") for n in (160, 180, 280)]
    )


@query
def probe_path_hints(spark, d):
    path = F.lower(T.norm(F.lower(P.effective_path(c("uri"), c("target")))))
    r = hold(requests(spark, d, ALL), {"path": path, "query_low": F.lower(T.norm(c("query")))})
    return r.select(
        *ROW, joined(P.probe_hints(c("path")), "hints"),
        yes(P.is_burst_probe(c("path"), c("query_low"))).alias("burst_probe"),
    )


@query
def encoded_marker(spark, d):
    return requests(spark, d).select(
        "id", yes(context.has_encoded_marker(c("query_raw"))).alias("marker")
    )


@query
def repeated_quote(spark, d):
    return requests(spark, d).select(
        "id", yes(context.has_quote_noise(c("query_raw"))).alias("quotes")
    )


@query
def sql_keyword(spark, d):
    return requests(spark, d).select(
        "id", yes(context.has_sql_keyword(c("query"))).alias("keyword")
    )


@query
def mixed_case_script(spark, d):
    return texts.with_texts(requests(spark, d)).select(
        "id", yes(T.matches(c("combined"), context.MIXED_CASE_SCRIPT)).alias("mixed")
    )


@query
def attack_intent_words(spark, d):
    words = context.has_attack_words(c("user_agent"), c("request_text"), c("log_text"), c("query"))
    return requests(spark, d).select("id", yes(words).alias("intent"))


# ------------------------------------------------------ 2.3 rules and filters


def _hits(spark, d):
    return signatures.with_hits(texts.with_texts(requests(spark, d, ALL)))


@query
def signature_hits(spark, d):
    return signatures.hit_rows(_hits(spark, d))


@query
def signature_counts(spark, d):
    return signatures.hit_totals(_hits(spark, d))


@query
def decoded_attack_hints(spark, d):
    r = score.with_analysis(requests(spark, d, ALL))
    return r.select(
        *ROW,
        *[yes(n) for n in ("attack_d0", "attack_d1", "attack_d2", "sqli_d1", "sqli_d2")],
        joined(P.compact(context.encoding_hints()), "hints"),
    )


@query
def file_disclosure_hints(spark, d):
    r = score.with_analysis(requests(spark, d, ALL))
    return r.select(
        *ROW, c("fd_points").alias("points"),
        joined(P.compact(context.file_disclosure_hints()), "hints"),
    )


@query
def xss_context_hints(spark, d):
    r = texts.with_texts(requests(spark, d, ALL))
    return r.select(*ROW, joined(context.xss_context_hints(), "hints"))


@query
def sqli_structure(spark, d):
    r = texts.with_texts(requests(spark, d, ALL))
    r = hold(r, {"forms": context.structure_forms(c("combined"))})
    flags = context.sqli_structure(c("forms"))
    return r.select(*ROW, *[yes(v).alias(n) for n, v in flags.items()])


@query
def xss_structure(spark, d):
    r = texts.with_texts(requests(spark, d, ALL))
    flags = context.xss_structure()
    return r.select(*ROW, *[yes(v).alias(n) for n, v in flags.items()])


@query
def educational_context(spark, d):
    return requests(spark, d, ALL).select(
        *ROW, yes(context.learning_sql(c("query"))).alias("learning_sql"),
        yes(context.learning_xss(context.learning_texts())).alias("learning_xss"),
    )


@query
def risk_score(spark, d):
    judged = score.judge(requests(spark, d, ALL))
    kept = ~F.coalesce("noise_category", F.lit("")).isin("socketio_polling", "static_asset")
    return judged.where(kept).select(
        *ROW, "score", joined(score.reason_hints(), "reasons")
    )


@query
def verdict_cascade(spark, d):
    judged = score.judge(requests(spark, d, ALL))
    return judged.select(*ROW, F.coalesce("verdict_hint", F.lit("")).alias("verdict"))


@query
def noise_category(spark, d):
    judged = score.judge(requests(spark, d, ALL))
    return judged.where("noise_category is not null").select(*ROW, "noise_category")


@query
def early_noise(spark, d):
    r = hold(requests(spark, d, ALL), {"category": score.early_noise()})
    return r.where("category is not null").select(*ROW, "category")


@query
def candidates(spark, d):
    found = score.candidates(score.judge(requests(spark, d, ALL)))
    return found.select(
        *ROW, "src_ip", "method", "uri", "query", "status_code", "score", "verdict_hint",
        "embedded_attack_hint", yes("path_normalized"), yes("html_fallback"),
        yes("hpp_detected"), joined("hpp_param_names"), joined("reason_hints"), "request_id",
    )


@query
def filtered_rows(spark, d):
    left = score.filtered_rows(score.filtered(score.judge(requests(spark, d, ALL))))
    return left.select(
        *ROW, "noise_category", ms("log_time"), "src_ip", "method", "uri", "query",
        "status_code", "request_id", "error_link_id", "response_body_bytes",
        "resp_content_type", "target", yes("path_normalized"), yes("html_fallback"),
        yes("hpp_detected"), joined("hpp_param_names"), joined("reason_hints"),
    )


@query
def fallback_flags(spark, d):
    r = score.with_fallback_flags(score.with_analysis(requests(spark, d, ALL)))
    return r.select(*ROW, yes("path_normalized"), yes("html_fallback"), yes("file_like"))


@query
def fp_review(spark, d):
    r = run_of(spark, d).review
    return r.select("review_reason", *ROW, ms("log_time"), "src_ip", "uri", "query", "status_code")


@query
def high_signal_sqli(spark, d):
    found = score.high_signal_sqli(run_of(spark, d).candidates)
    return found.select(*ROW, "score", "src_ip")


@query
def request_risk(spark, d):
    risk = iprisk.request_risk(requests(spark, d))
    return risk.select(
        "log_id", ms("log_time"), "src_ip", "method", "uri", "query", "status_code", "score",
        "verdict", "reasons", "raw_request",
    )


# ------------------------------------------------------------ 2.4 aggregates


@query
def noise_rollup(spark, d):
    g = run_of(spark, d).noise_groups
    return g.select(*noise.GROUP, "count", ms("start"), ms("end"), "note")


@query
def noise_passed_through(spark, d):
    return run_of(spark, d).passed_through.select(*ROW, "noise_category")


@query
def noise_breakdown(spark, d):
    return noise.noise_breakdown(score.filtered(score.judge(requests(spark, d, ALL))))


def _incident_view(df):
    return df.select(
        "incident_group_key", "source_table", "id", "src_ip", "method", "uri", "query",
        "status_code", "score", "verdict_hint", "merged_row_count", "first_log_id",
        "last_log_id", joined("merged_source_tables"), joined("reason_hints"), "request_id",
        "error_link_id", ms("log_time"),
    )


@query
def incidents_(spark, d):
    return _incident_view(run_of(spark, d).incidents)


QUERIES["incidents"] = QUERIES.pop("incidents_")


@query
def incident_members(spark, d):
    return run_of(spark, d).members


@query
def incident_groups(spark, d):
    g = incidents.incident_groups(run_of(spark, d).incidents)
    return g.select(
        *[n for n in g.columns if n not in ("source_tables", "log_time")],
        joined("source_tables"), ms("log_time"),
    )


@query
def stage_counts(spark, d):
    return run_of(spark, d).counts


@query
def ip_risk(spark, d):
    out = iprisk.ip_risk(iprisk.request_risk(requests(spark, d)))
    return out.withColumn(
        "average_hundredths", F.round(c("average_score") * 100).cast("bigint")
    ).drop("average_score")


def _dedup_view(df):
    return df.select(
        "dedup_key", "incident_ref", "duplicate_count", joined("source_tables"),
        joined("recommended_actions"), yes("known_asset"), "src_ip", "uri", "score", "verdict",
        "severity", "confidence", "candidate_index",
    )


@query
def triage_dedup(spark, d):
    return _dedup_view(run_of(spark, d).deduped)


@query
def triage_by_ip(spark, d):
    run = run_of(spark, d)
    out = triage.triage_by_ip(run.deduped, run.results, W.KNOWN_ASSETS)
    return out.select(
        "src_ip", "incident_count", "raw_row_count", "max_severity", "max_confidence",
        *[F.array_join(n, ",").alias(n) for n in ("top_verdicts", "top_uris", "top_actions")],
        yes("known_asset"),
    )


@query
def triage_distributions(spark, d):
    return triage.distributions(run_of(spark, d).deduped)


def _shares(df):
    return df.select(
        "category", "count", "total", F.round(c("share_pct") * 10).cast("bigint").alias("share")
    )


@query
def noise_share(spark, d):
    return _shares(noise.category_shares(noise.noise_breakdown(run_of(spark, d).left_out)))


@query
def recon_share(spark, d):
    return _shares(noise.recon_shares(noise.noise_breakdown(run_of(spark, d).left_out)))


@query
def known_asset_matches(spark, d):
    return triage.known_asset_matches(run_of(spark, d).deduped)


# ----------------------------------------------------------------- 2.5 joins


@query
def supporting_events(spark, d):
    s = run_of(spark, d).supporting
    return s.select(
        *ROW, ms("log_time"), "src_ip", "method", "uri", "query", "status_code",
        "response_body_bytes", "request_id", joined("reason_hints"), "temporal_context_key",
        "nearby_candidate_count",
    )


@query
def incident_evidence(spark, d):
    run = run_of(spark, d)
    e = triage.attach_evidence(run.deduped, run.incidents)
    return e.select(
        "dedup_key", "found_by", F.md5("evidence.log_text").alias("log_md5"),
        c("evidence.user_agent").alias("evidence_agent"),
        F.size("evidence.reason_hints").alias("hints"),
    )


@query
def known_assets(spark, d):
    assets = spark.createDataFrame([(a,) for a in W.KNOWN_ASSETS], "ip string")
    out = triage.flag_known_assets(requests(spark, d), assets)
    return out.select("id", "src_ip", yes("known_asset"))


@query
def notable_lookup(spark, d):
    """Every incident reference, a quarter of them spoilt, looked up again."""
    run = run_of(spark, d)
    spoilt = c("candidate_index") % 4 == 0
    items = run.deduped.select(
        F.when(spoilt, F.concat(c("incident_ref"), F.lit("?"))).otherwise(c("incident_ref"))
        .alias("incident_ref"),
        "request_id",
    )
    out = triage.notable_lookup(items, run.deduped)
    return out.select("incident_ref", "request_id", "uri", "status_code", "score")


@query
def error_correlation(spark, d):
    src = R.source_tables(spark, d)
    out = incidents.error_correlation(
        canon.canon(src["security"], "security"), canon.canon(src["error"], "error")
    )
    return out.select(
        "request_id", "request_count", "first_log_id", "last_log_id", "error_count",
        "first_error_id", "last_error_id", "error_link_count",
    )


# --------------------------------------------------------------- 2.6 windows


@query
def incident_representative(spark, d):
    reps = incidents.representatives(run_of(spark, d).candidates)
    return reps.select("incident_group_key", "source_table", "id", "duration_us", ms("log_time"))


def _burst_view(df):
    def hist(name):
        return F.array_join(
            F.transform(name, lambda x: F.concat_ws("=", x["key"], x["count"])), ","
        ).alias(name)

    return df.select(
        "src_ip", ms("start"), ms("end"), "request_count", "distinct_path_count",
        F.array_join("sample_paths", ",").alias("sample_paths"), hist("status_counts"),
        hist("content_type_counts"), "dominant_response_body_bytes", "dominant_count",
        joined("reason_hints"),
    )


@query
def probing_bursts(spark, d):
    return _burst_view(bursts.probing_bursts(requests(spark, d, ALL)))


@query
def incident_rank(spark, d):
    return triage.ranked(run_of(spark, d).deduped).select(
        "rank", "incident_ref", "severity", "score"
    )


@query
def triage_representative(spark, d):
    return run_of(spark, d).deduped.select(
        "dedup_key", "source_table", "log_id", "score", ms("log_time")
    )


@query
def top3_per_ip(spark, d):
    return triage.top3_per_ip(run_of(spark, d).deduped)


# ----------------------------------------------------------------- 2.7 top-k


@query
def top_candidates(spark, d):
    top = incidents.top_candidates(run_of(spark, d).incidents, 50)
    return top.select("incident_group_key", "score", ms("log_time"), "candidate_index")


@query
def top_noise(spark, d):
    top = report.top_noise(run_of(spark, d).noise_groups)
    return top.select(*noise.GROUP, "count")


@query
def top_incidents(spark, d):
    run = run_of(spark, d)
    top = triage.top_incidents(run.deduped, run.incidents)
    return top.select(
        "rank", "incident_ref", "verdict", "severity", "score", "src_ip", "uri",
        "duplicate_count", "user_agent", "raw_request", "raw_log_excerpt",
        joined("reason_hints"), yes("known_asset"),
    )


@query
def top_ips(spark, d):
    run = run_of(spark, d)
    top = triage.top_ips(triage.triage_by_ip(run.deduped, run.results, W.KNOWN_ASSETS))
    return top.select("src_ip", "incident_count", "raw_row_count", "max_severity")


@query
def top_risky_ips(spark, d):
    top = iprisk.top_risky_ips(iprisk.ip_risk(iprisk.request_risk(requests(spark, d))))
    return top.select("src_ip", "total_score", "sqli_count", "xss_count", "max_score",
                      "final_verdict")


@query
def top_risky_requests(spark, d):
    top = iprisk.top_risky_requests(iprisk.request_risk(requests(spark, d)))
    return top.select("log_id", "src_ip", "score", "verdict")


@query
def context_caps(spark, d):
    run = run_of(spark, d)
    parts = [
        report.top_bursts(run.bursts).select(
            F.lit("burst").alias("kind"), F.concat_ws("|", "src_ip", F.unix_millis("start"))
            .alias("item")
        ),
        report.top_supporting(run.supporting).select(
            F.lit("supporting").alias("kind"), F.concat_ws("|", "source_table", "id").alias("item")
        ),
        report.first_reviews(run.review).select(
            F.lit("review").alias("kind"), F.concat_ws("|", "source_table", "id").alias("item")
        ),
        report.first_errors(responses.triage_errors(_answers(run))).select(
            F.lit("error").alias("kind"), c("candidate_index").cast("string").alias("item")
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def distinct_paths(spark, d):
    """All paths of each burst in order, not only the first ten."""
    return bursts.burst_paths(requests(spark, d, ALL))


# ------------------------------------------------------------ 2.9 model tables


@query
def triage_requests(spark, d):
    run = run_of(spark, d)
    out = responses.triage_requests(run.incidents, DAY_START, DAY_END)
    f = "candidate."
    return out.select(
        "candidate_index", "window_start", "window_end_exclusive",
        *[c(f + n).alias(n) for n in (
            "incident_group_key", "source_table", "log_id", "src_ip", "uri", "query_string",
            "score", "verdict_hint", "merged_row_count", "first_log_id", "last_log_id", "user_agent", "request_id", "error_link_id",
        )],
        F.size(f + "reason_hints").alias("hints"),
        F.md5(f + "raw_log_excerpt").alias("excerpt_md5"), F.md5(f + "raw_request").alias("request_md5"),
    )


def _answers(run: TriageRun) -> DataFrame:
    """A model answer for every incident; the shape of the text varies with the index."""
    r = triage.rule_triage(run.incidents, "canonical")
    plain = F.to_json(
        F.struct(
            "verdict", "severity", "confidence", "false_positive_possible",
            F.concat(F.lit('saw "}" in '), c("uri")).alias("reasoning_summary"),
            F.slice(F.array_sort("reason_hints"), 1, 8).alias("evidence_fields"),
            "recommended_actions",
        )
    )
    i = c("candidate_index") % 9
    body = (
        F.when(i == 0, plain)
        .when(i == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .when(i == 2, F.concat(F.lit("Here is my answer: "), plain, F.lit(" Done.")))
        .when(i == 3, F.concat(F.lit("  \n"), plain))
        .when(i == 4, F.substring(plain, F.lit(1), F.length(plain) - 5))
        .when(i == 5, F.concat(F.lit("["), plain, F.lit("]")))
        .when(i == 6, F.regexp_replace(plain, '"severity":"[a-z]+"', '"severity":"extreme"'))
        .when(c("candidate_index") % 18 == 7, F.lit("[1, 2]"))
        .when(i == 7, F.lit("no object at all"))
        .otherwise(F.lit(""))
    )
    return r.select(
        "candidate_index", "request_id", F.lit("rules").alias("model"),
        F.concat(F.lit("resp-"), c("candidate_index")).alias("response_id"),
        body.alias("output_text"),
    )


@query
def parse_responses(spark, d):
    out = responses.parse_responses(_answers(run_of(spark, d)))
    return out.select(
        "candidate_index", "strategy", "verdict", "severity", "confidence",
        yes("false_positive_possible"), "reasoning_summary",
        F.size("evidence_fields").alias("evidence"), joined("recommended_actions"),
    )


@query
def validate_responses(spark, d):
    """The answers that could be read, judged."""
    checked = responses.validate_responses(responses.parse_responses(_answers(run_of(spark, d))))
    return checked.select("candidate_index", joined("violations"), yes("valid"))


@query
def answered_triage(spark, d):
    """Deduplicated incidents of a run whose verdicts are a model's valid answers."""
    run = run_of(spark, d)
    return run.with_answers(_answers(run)).deduped.select(
        "dedup_key", "incident_ref", "duplicate_count", "src_ip", "uri", "score", "verdict", "severity", "confidence",
        joined("recommended_actions"), "candidate_index",
    )


@query
def triage_request_ids(spark, d):
    return triage.merged_request_ids(run_of(spark, d).results)


@query
def error_members(spark, d):
    src = R.source_tables(spark, d)
    rows = [canon.select_sources(src, n) for n in ("security", "error")]
    out = incidents.correlation_members(*rows)
    return out.select("request_id", "source_table", "id", "error_link_id", F.md5(F.coalesce("log_text", F.lit(""))).alias("log_md5"))


@query
def triage_errors(spark, d):
    out = responses.triage_errors(_answers(run_of(spark, d)))
    excerpt = c("raw_response_excerpt")
    return out.withColumns(
        {"excerpt_length": F.length(excerpt), "excerpt_start": F.left(excerpt, F.lit(10))}
    ).drop("raw_response_excerpt")


@query
def rule_triage(spark, d):
    r = run_of(spark, d).results
    return r.select(
        "candidate_index", "incident_group_key", "score", "verdict_hint", "verdict", "severity",
        "confidence", F.size("evidence_fields").alias("evidence"), joined("recommended_actions"),
    )


#: What is shown of each row of a section of the report.
REPORT = {
    "analysis_context": ("query_timezone", "window_start", "window_end_exclusive", "mode", "selected_model"),
    "distributions": ("distribution", "value", "count"),
    "filtered_out_breakdown": ("category", "count"),
    "top_incidents": ("rank", "incident_ref", "verdict", "severity", "score"),
    "top_src_ips": ("src_ip", "incident_count", "raw_row_count", "max_severity"),
    "top_noise_groups": ("noise_category", "src_ip", "uri", "count"),
    "top_filtered_categories": ("category", "count"),
    "top_out_of_candidate_recon": ("category", "count"),
    "probing_sequence_summaries": ("src_ip", "request_count", "distinct_path_count", "interpretation_hint"),
    "supporting_events": ("source_table", "id", "nearby_candidate_count"),
    "false_positive_review_candidates": ("source_table", "id"),
    "matched_known_assets": ("src_ip", "incident_count"),
    "asset_context": ("known_asset_ips", "matched_known_asset_incident_count"),
    "stage1_errors_excerpt": ("candidate_index", "error_type"),
}
REPORT_COUNTS = (
    "total_exported_rows", "candidate_rows", "distinct_incident_count", "filtered_out_rows", "filtered_out_non_aggregated_rows", "noise_group_count",
    "supporting_event_count", "false_positive_review_candidate_count", "probing_sequence_summary_count", "stage1_success_count", "stage1_error_count",
)


@query
def report_input(spark, d):
    """The report's rows, read back from its JSON text."""
    run = run_of(spark, d)
    made = report.report_input(run, responses.triage_errors(_answers(run)), {"mode": "routine", "selected_model": "rules"})
    items = made.select(F.explode(F.from_json("report", "map<string, array<string>>")).alias("section", "rows"))
    items = items.select("section", F.posexplode("rows").alias("place", "row"))
    shown = F.lit(None).cast("string")
    for name, fields in {**REPORT, "pipeline_counts": REPORT_COUNTS}.items():
        text = F.concat_ws("|", *[F.coalesce(F.get_json_object("row", f"$.{f}"), F.lit("")) for f in fields])
        shown = F.when(c("section") == name, text).otherwise(shown)
    return items.select("section", shown.alias("item"))


# -------------------------------------------------------------- 2.10 streams


FILES = 8


def _request_folder(spark, d):
    """Canonical requests as a stream source: files written in time order, each later one
    holding later requests, and at the end one much later probe that closes every window.

    Each span has FILES files, so that a micro-batch can take one span; rows without a time come first.
    """
    path = store.scratch_path(spark, "requests")
    rows = requests(spark, d, ALL)
    first, last = rows.agg(F.min("log_time"), F.max("log_time")).first()
    cuts = [first + (last - first) * i / 4 for i in range(4)] + [None]
    for start, end in zip(cuts, cuts[1:]):
        part = rows.where((c("log_time") >= F.lit(start)) | (F.lit(start == first) & c("log_time").isNull()))
        if end is not None:
            part = part.where((c("log_time") < F.lit(end)) | c("log_time").isNull())
        part.repartition(FILES).write.mode("append").parquet(path)
    closing = rows.where(c("log_time") == F.lit(last)).limit(1).withColumns(
        {
            "log_time": F.lit(last + (last - first) + timedelta(days=1)),
            "src_ip": F.lit("closing"), "uri": F.lit("/admin"), "method": F.lit("GET"),
            "target": F.lit("/admin"), "raw_request": F.lit("GET /admin HTTP/1.1"),
        }
    )
    closing.write.mode("append").parquet(path)
    late = f"{int((last - first).total_seconds() / 4) + 1} seconds"
    return rows.schema, path, late


def _stream(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(path)


def _drain(spark, df, name, keep=None):
    sink = store.scratch_path(spark, name)
    q = (
        df.writeStream.format("parquet").option("path", sink)
        .option("checkpointLocation", store.scratch_path(spark, "cp"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(sink)


@query
def stream_candidates(spark, d):
    schema, path, late = _request_folder(spark, d)
    found = score.candidates(score.judge(_stream(spark, schema, path)))
    got = _drain(spark, found, "stream-candidates").where("src_ip != 'closing'")
    return got.select(*ROW, "score", "verdict_hint", joined("reason_hints"))


@query
def stream_noise_windows(spark, d):
    """Counted on the stream itself, with a watermark; the closing row ends all windows."""
    schema, path, late = _request_folder(spark, d)
    left = score.filtered(score.judge(ingest.watermarked(_stream(spark, schema, path), late)))
    got = _drain(spark, ingest.noise_windows(left), "stream-windows")
    return got.select(ms("window_start"), "noise_category", "count")


@query
def stream_bursts(spark, d):
    """Whole bursts from micro-batches, ten minutes of lateness; the closing row ends all of them."""
    schema, path, _ = _request_folder(spark, d)
    base = store.scratch_path(spark, "stream-bursts")
    found = stream_bursts_module.tracker(base, "10 minutes")
    ingest.start(_stream(spark, schema, path), found, store.scratch_path(spark, "cp")).awaitTermination()
    return _burst_view(stream_bursts_module.read_bursts(spark, base))
