"""Roll-up of left-out requests."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsieve import rules
from logsieve.functions import text as T
from logsieve.functions.numbers import rounded_ratio
from logsieve.functions.stage import where_once
from logsieve.operators import context as C
from logsieve.operators import texts as X

GROUP = ["noise_category", "src_ip", "uri", "method", "status_code", "user_agent"]
ORDER = ["source_position", "log_time", "id"]


def note(category: Column) -> Column:
    known = [F.when(category == k, F.lit(v)) for k, v in rules.NOISE_NOTES.items()]
    return F.coalesce(*known, F.lit(rules.NOISE_NOTE_DEFAULT))


def noise_groups(left_out: DataFrame, min_repeat: int = rules.MIN_REPEAT) -> DataFrame:
    """Repeated noise as one row per group. Counts are combined before the shuffle."""
    return (
        left_out.groupBy(*GROUP)
        .agg(
            F.count("*").alias("count"),
            F.min("log_time").alias("start"),
            F.max("log_time").alias("end"),
        )
        .where(F.col("count") >= min_repeat)
        .withColumn("note", note(F.col("noise_category")))
    )


def passed_through(left_out: DataFrame, min_repeat: int = rules.MIN_REPEAT) -> DataFrame:
    """Rows of groups too small to roll up.

    Only the first ``min_repeat`` rows of a group are needed to know its fate, so each
    task drops the rest before the shuffle, however large a group is.
    """
    nth = F.row_number().over(Window.partitionBy(*GROUP).orderBy(*ORDER))
    first = left_out.withColumn("nth", nth).where(F.col("nth") <= min_repeat)
    seen = F.max("nth").over(Window.partitionBy(*GROUP))
    return first.withColumn("seen", seen).where(F.col("seen") < min_repeat).drop("nth", "seen")


def noise_breakdown(left_out: DataFrame) -> DataFrame:
    category = F.coalesce("noise_category", F.lit("unclassified"))
    return left_out.groupBy(category.alias("category")).agg(F.count("*").alias("count"))


def category_shares(breakdown: DataFrame) -> DataFrame:
    """Share of each category in all left-out rows, in per cent with one decimal.

    The breakdown has one row per category (a handful), so one window partition is fine.
    """
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return breakdown.withColumn("total", total).withColumn(
        "share_pct", rounded_ratio(F.col("count") * 100, F.col("total"), 1)
    )


def recon_shares(breakdown: DataFrame) -> DataFrame:
    """The reconnaissance categories, still as a share of everything left out."""
    return category_shares(breakdown).where(F.col("category").isin(rules.RECON_CATEGORIES))


def false_positive_review(passthrough: DataFrame) -> DataFrame:
    """Left-out learning searches about XSS that carry no attack structure."""
    df = passthrough.withColumns(
        {"request_text": T.norm(F.col("raw_request")), "log_text": F.lit("")}
    )
    df = X.with_texts(df)
    none = F.array().cast("array<string>")
    samples = F.concat(
        F.array("combined", "query", "q0", "q1", "q2", "t0", "t1", "t2"),
        F.coalesce("q_entities", none),
        F.coalesce("t_entities", none),
    )
    df = df.withColumn(
        "forms", T.unescape_html(F.when(T.has_entity(F.col("combined")), samples))
    )
    decoded = F.array_join("forms", "\n\x00\n")
    wording = T.join_distinct(F.array("query", "target", "combined"))
    quiet = C.learning_xss(wording) & ~C.any_xss_structure(F.col("combined"), decoded)
    return where_once(df, quiet).select(
        F.lit("educational_xss_keyword_search").alias("review_reason"),
        "source_table", "source_position", "id", "log_time", "src_ip", "uri", "query",
        "user_agent", "status_code", "response_body_bytes",
    )
