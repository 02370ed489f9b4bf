"""Canonical request rows from the three source tables.

Every later operator works on the columns produced here, whatever the names in
the source were. Texts are URL-decoded once; ``raw_request``, ``query_raw`` and
``log_raw`` keep the logged form.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve import rules
from logsieve.functions import paths as P
from logsieve.functions import text as T
from logsieve.functions.stage import hold


def _present(df: DataFrame, names) -> list[Column]:
    found = [F.col(n) for n in names if n in df.columns]
    return found or [F.lit(None)]


def _text(df: DataFrame, *names: str) -> Column:
    return T.first_text(*[T.norm_stored(c) for c in _present(df, names)])


def _raw(df: DataFrame, name: str) -> Column:
    return T.raw_text(_present(df, [name])[0])


def _int(df: DataFrame, *names: str) -> Column:
    return T.first_int(*_present(df, names))


def _first_raw(df: DataFrame, *names: str) -> Column:
    """First source value that is not empty as logged, then decoded."""
    raw = [F.nullif(c.cast("string"), F.lit("")) for c in _present(df, names)]
    return T.norm(F.coalesce(*raw, F.lit("")))


def _time(df: DataFrame) -> Column:
    found = []
    for name in ("log_time", "created_at"):
        if name in df.columns:
            kind = df.schema[name].dataType.typeName()
            found.append(T.flexible_time(F.col(name)) if kind == "string" else F.col(name))
    return F.date_trunc("millisecond", F.coalesce(*found)) if found else F.lit(None).cast(
        "timestamp"
    )


def canon(df: DataFrame, source: str, position: int = 0) -> DataFrame:
    """One source table to canonical rows. ``position`` is its place in the run."""
    if source not in rules.SOURCES:
        raise ValueError(f"unknown source table: {source}")
    return df.select(
        F.lit(source).alias("source_table"),
        F.lit(position).alias("source_position"),
        _present(df, ["id"])[0].try_cast("bigint").alias("id"),
        _time(df).alias("log_time"),
        T.first_text(_text(df, "src_ip", "client_ip"), F.lit("-")).alias("src_ip"),
        T.first_text(_text(df, "method"), F.lit("-")).alias("method"),
        _text(df, "uri", "request_uri").alias("uri"),
        _raw(df, "query_string").alias("query_raw"),
        _text(df, "query_string").alias("query"),
        _raw(df, "raw_request").alias("raw_request"),
        _text(df, "raw_request").alias("request_text"),
        _int(df, "status_code", "status", "response_status").alias("status_code"),
        _int(df, "response_body_bytes", "body_bytes", "bytes").alias("response_body_bytes"),
        _int(df, "duration_us").alias("duration_us"),
        _int(df, "ttfb_us").alias("ttfb_us"),
        _text(df, "req_content_type").alias("req_content_type"),
        _first_raw(df, "resp_content_type", "response_content_type", "content_type").alias(
            "resp_content_type"
        ),
        _text(df, "user_agent", "ua", "request_user_agent").alias("user_agent"),
        _text(df, "referer", "request_referer").alias("referer"),
        _text(df, "request_id").alias("request_id"),
        _text(df, "error_link_id").alias("error_link_id"),
        _text(df, "raw_log").alias("log_text"),
    )


def within(df: DataFrame, start=None, end=None) -> DataFrame:
    """Stored rows with ``start <= time < end``; the bounds reach the scan of typed columns.

    The time of a row is ``log_time``, else ``created_at``; rows without one are outside.
    """
    if start is None and end is None:
        return df

    def inside(time: Column) -> Column:
        low = F.lit(True) if start is None else time >= F.lit(start).cast("timestamp")
        high = F.lit(True) if end is None else time < F.lit(end).cast("timestamp")
        return low & high

    names = [n for n in ("log_time", "created_at") if n in df.columns]
    if any(df.schema[n].dataType.typeName() == "string" for n in names) or not names:
        return df.where(inside(_time(df)))
    out = inside(F.col(names[0]))
    if len(names) == 2:
        out = out | (F.col(names[0]).isNull() & inside(F.col(names[1])))
    return df.where(out)


def source_names(wanted="security") -> list[str]:
    """The wanted tables in the caller's order, without duplicates."""
    names = wanted.split(",") if isinstance(wanted, str) else list(wanted)
    names = list(dict.fromkeys(n.strip().lower() for n in names if n.strip()))
    unknown = [n for n in names if n not in rules.SOURCES]
    if unknown:
        raise ValueError(f"unknown source table: {unknown[0]}")
    if not names:
        raise ValueError("at least one source table is needed")
    return names


def select_sources(tables: dict[str, DataFrame], wanted="security") -> DataFrame:
    """Canonical rows of the wanted tables, in the caller's order, without duplicates."""
    names = source_names(wanted)
    out = None
    for position, name in enumerate(names):
        part = canon(tables[name], name, position)
        out = part if out is None else out.unionByName(part)
    # The border keeps later projections from being copied into every part of the union.
    return hold(out, {"target": P.request_target(F.col("raw_request"))})
