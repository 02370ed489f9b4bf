"""Direct risk of source addresses: a simpler scorer, no decoding depths or context."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsieve import rules
from logsieve.functions import paths as P
from logsieve.functions import text as T
from logsieve.functions.numbers import rounded_ratio
from logsieve.functions.stage import hold
from logsieve.operators import signatures as S

c = F.col


def request_risk(
    requests: DataFrame, suspicious: int = 4, sqli: int = 7, xss: int = 7
) -> DataFrame:
    """Score and verdict per request, from canonical rows."""
    text = T.trim_all(
        F.concat_ws(" ", T.norm(c("raw_request")), c("uri"), c("query"))
    )
    df = requests.withColumn("risk_text", text)
    df = df.withColumn("risk_low", S.ascii_lower(c("risk_text")))
    df = df.withColumns(
        {
            S.hit_column(fam, n): S.hit(fam, n, c("risk_text"), c("risk_low"), False)
            for fam in ("sqli", "xss")
            for n, _, _ in S.FAMILIES[fam]
        }
    )
    q = c("query")
    login = P.is_login_uri(c("uri"))
    tokens = (
        P.is_query_heavy_uri(c("uri")) & (q != "") & T.matches(q, rules.QUERY_ATTACK_TOKENS)
    )
    body = F.lower("req_content_type").isin(rules.AUTH_BODY_TYPES)
    terms = [
        (F.length(q) >= 40, 1, "long_query"),
        (F.length(q) >= 80, 1, "very_long_query"),
        (T.special_ratio_at_least(q, 15), 1, "special_char_ratio_high"),
        (T.special_ratio_at_least(q, 30), 1, "special_char_ratio_very_high"),
        (c("status_code").isin(rules.IP_RISK_STATUSES), 2, None),
        (c("duration_us") >= 2_000_000, 3, "high_duration"),
        (c("duration_us") >= 5_000_000, 2, "very_high_duration"),
        (c("ttfb_us") >= 2_000_000, 2, "high_ttfb"),
        (login, 1, "login_endpoint"),
        (tokens, 2, "query_endpoint_with_attack_tokens"),
        (body & login, 1, "auth_payload_content_type"),
    ]
    score = S.hit_points("sqli") + S.hit_points("xss")
    labels = S.hit_labels(("sqli", "xss"))
    for cond, points, label in terms:
        score = score + F.when(cond, F.lit(points)).otherwise(0)
        shown = (
            F.lit(f"{label}(+{points})")
            if label
            else F.concat(F.lit("error_status:"), c("status_code"), F.lit("(+2)"))
        )
        labels.append(F.when(cond, shown))
    df = df.withColumns(
        {
            "score": score,
            "reasons": F.concat_ws(";", *labels),
            "sqli_hits": S.hit_count("sqli"),
            "xss_hits": S.hit_count("xss"),
        }
    )
    verdict = (
        F.when((c("xss_hits") > 0) & (c("score") >= xss), F.lit("xss"))
        .when((c("sqli_hits") > 0) & (c("score") >= sqli), F.lit("sqli"))
        .when(c("score") >= suspicious, F.lit("suspicious"))
        .otherwise(F.lit("benign"))
    )
    named = df.select(
        c("id").alias("log_id"), "log_time", "src_ip", "method",
        T.first_text(c("uri"), F.lit("-")).alias("uri"), "query", "status_code", "score",
        verdict.alias("verdict"), "reasons", c("request_text").alias("raw_request"),
    )
    return hold(named, {n: c(n) for n in ("score", "verdict", "reasons")})


def ip_risk(results: DataFrame) -> DataFrame:
    """Totals, verdict counts and tier per address.

    Totals combine before the shuffle. Sample reasons need three rows per address, which
    each task picks before it sends anything.
    """
    def count_of(verdict: str):
        return F.count_if(c("verdict") == verdict)

    totals = results.groupBy("src_ip").agg(
        F.count("*").alias("total_requests"),
        *[count_of(v).alias(f"{v}_count") for v in ("benign", "suspicious", "sqli", "xss")],
        F.sum("score").alias("total_score"),
        F.max("score").alias("max_score"),
    )
    order = Window.partitionBy("src_ip").orderBy(c("log_time").desc(), "log_id")
    samples = (
        results.where("reasons != ''")
        .select("src_ip", "log_time", "log_id", "reasons")
        .withColumn("nth", F.row_number().over(order))
        .where("nth <= 3")
        .groupBy("src_ip")
        .agg(
            F.array_join(
                F.array_sort(F.collect_list(F.struct("nth", "reasons"))).getField("reasons"),
                " | ",
            ).alias("sample_reasons")
        )
    )
    high = (c("sqli_count") >= 3) | (c("xss_count") >= 3) | (c("total_score") >= 20)
    medium = (
        (c("sqli_count") >= 1) | (c("xss_count") >= 1) | (c("suspicious_count") >= 3)
        | (c("total_score") >= 10)
    )
    tier = (
        F.when(high, F.lit("high_risk"))
        .when(medium, F.lit("medium_risk"))
        .when(c("suspicious_count") >= 1, F.lit("low_risk"))
        .otherwise(F.lit("benign"))
    )
    return totals.join(samples, "src_ip", "left").withColumns(
        {
            "average_score": rounded_ratio(c("total_score"), c("total_requests"), 2),
            "final_verdict": tier,
            "sample_reasons": F.coalesce("sample_reasons", F.lit("")),
        }
    )


def top_risky_ips(summary: DataFrame, limit: int = 20) -> DataFrame:
    return summary.orderBy(
        *[c(n).desc() for n in ("total_score", "sqli_count", "xss_count", "max_score")], "src_ip"
    ).limit(limit)


def top_risky_requests(results: DataFrame, limit: int = 10) -> DataFrame:
    return results.orderBy(c("score").desc(), c("log_time").desc(), "log_id").limit(limit)
