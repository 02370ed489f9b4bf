"""Exchange with a classifier model as tables: requests out, answers in."""

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from logsieve import rules
from logsieve.functions import text as T
from logsieve.functions.stage import hold

c = F.col

ANSWER = {
    "verdict": "string", "severity": "string", "confidence": "string", "false_positive_possible": "boolean",
    "reasoning_summary": "string", "evidence_fields": "array<string>", "recommended_actions": "array<string>",
}
FOUND = ST.StructType(
    [ST.StructField("strategy", ST.StringType()), ST.StructField("json_text", ST.StringType())]
)
ERROR_EXCERPT = 1500
LOG_EXCERPT = 1200


def triage_requests(
    incidents: DataFrame, start: str = "", end_exclusive: str = "", max_hints: int = 8
) -> DataFrame:
    """One request record per incident; the ids of its rows are in ``incident_members``."""
    names = [
        "source_table", "incident_group_key", "merged_row_count", "merged_source_tables",
        "first_log_id", "last_log_id", "log_id", "log_time", "src_ip", "method", "uri", "query_string",
        "status_code", "score", "verdict_hint", "reason_hints", "request_id", "error_link_id",
        "raw_request", "user_agent", "referer", "duration_us", "ttfb_us",
        "response_body_bytes", "resp_content_type", "raw_request_target",
        "path_normalized_from_raw_request", "likely_html_fallback_response", "hpp_detected",
        "hpp_param_names", "embedded_attack_hint", "raw_log_excerpt",
    ]
    own = {
        "log_id": c("id"),
        "query_string": c("query"),
        "reason_hints": F.slice("reason_hints", 1, max_hints),
        "raw_request": c("request_text"),
        "raw_request_target": c("target"),
        "path_normalized_from_raw_request": c("path_normalized"),
        "likely_html_fallback_response": c("html_fallback"),
        "raw_log_excerpt": F.left(T.raw_text(c("log_text")), F.lit(LOG_EXCERPT)),
    }
    fields = [own.get(n, c(n) if n not in own else None).alias(n) for n in names]
    return incidents.select(
        "candidate_index",
        F.lit(start).alias("window_start"),
        F.lit(end_exclusive).alias("window_end_exclusive"),
        F.struct(*fields).alias("candidate"),
    )


# A fenced block: its first line, the content, and the closing line if there is one.
FENCE = r"(?s)\A```[^\n]*(?:\n(.*?))??(?:\n[ \t]*```[ \t]*)?\z"
#: What is wrong with an answer that gives no object, by ``strategy``.
ERRORS = {
    "empty": ("empty_output", "no output text"),
    "other_root": ("unexpected_error", "JSON root is not an object"),
    "none": ("json_decode_error", "no JSON object found"),
}


def _object_in(body: str) -> tuple[str, str]:
    """(strategy, JSON object text): the whole text, or the object at its first brace."""
    read = json.JSONDecoder().raw_decode
    whole = None
    for at in dict.fromkeys((0, max(body.find("{"), 0))):
        try:
            value, end = read(body, at)
        except ValueError:
            continue
        if isinstance(value, dict):
            return ("direct" if (at, end) == (0, len(body)) else "outer_object"), body[at:end]
        whole = whole or end == len(body)
    return ("other_root" if whole else "none"), ""


@F.pandas_udf(FOUND)
def find_object(texts: pd.Series) -> pd.DataFrame:
    found = [_object_in(t) if t else ("empty", "") for t in texts]
    return pd.DataFrame(found, columns=["strategy", "json_text"])


def _typed(answer: Column) -> list[Column]:
    """The answer's fields; a value of another kind than its field's is NULL (a number is no text, a text no truth)."""
    out = []
    for name, kind in ANSWER.items():
        value = F.try_variant_get(answer, f"$.{name}", kind)
        shape = F.schema_of_variant(F.try_variant_get(answer, f"$.{name}", "variant"))
        fits = shape.startswith("ARRAY") if kind.startswith("array") else shape == kind.upper()
        out.append(F.when(fits, value).alias(name))
    return out


def read_answers(answers: DataFrame) -> DataFrame:
    """Adds ``strategy`` (direct, outer_object or a key of ``ERRORS``) and the typed answer fields.

    Texts that are a JSON object as a whole are read by built-in expressions. Only the others, prose around an
    object or no object at all, reach the one Python step, which looks for the object.
    """
    body = T.trim_all(F.regexp_replace(T.raw_text(c("output_text")), FENCE, "$1"))
    texts = hold(answers, {"_body": body})
    read = hold(texts, {"_whole": F.try_parse_json("_body")})
    is_object = F.coalesce(F.schema_of_variant("_whole").startswith("OBJECT"), F.lit(False))
    direct = read.where(is_object).select(*answers.columns, F.lit("direct").alias("strategy"), *_typed(c("_whole")))
    rest = hold(read.where(~is_object).drop("_whole"), {"found": find_object(c("_body"))})
    rest = rest.withColumn("_part", F.try_parse_json(F.nullif(c("found.json_text"), F.lit(""))))
    return direct.unionByName(rest.select(*answers.columns, c("found.strategy").alias("strategy"), *_typed(c("_part"))))


def parse_responses(answers: DataFrame) -> DataFrame:
    """Answers that contain a JSON object."""
    return read_answers(answers).where(~c("strategy").isin(list(ERRORS)))


def triage_errors(answers: DataFrame) -> DataFrame:
    """Answers that do not, with a typed reason and an excerpt; absent columns of the record are NULL."""
    def named(name: str) -> Column:
        return (c(name) if name in answers.columns else F.lit(None).cast("string")).alias(name)

    def of_kind(place: int) -> Column:
        return F.element_at(
            F.create_map(*[F.lit(v) for k, x in ERRORS.items() for v in (k, x[place])]),
            c("strategy"),
        )

    bad = read_answers(answers).where(c("strategy").isin(list(ERRORS)))
    return bad.select(
        "candidate_index", named("request_id"), named("model"), of_kind(0).alias("error_type"),
        of_kind(1).alias("error_message"), named("response_id"),
        F.left(F.coalesce("output_text", F.lit("")), F.lit(ERROR_EXCERPT)).alias(
            "raw_response_excerpt"
        ),
    )


def _outside(name: str, values) -> Column:
    return ~F.coalesce(c(name).isin(list(values)), F.lit(False))


def violations() -> Column:
    """Names of the constraints an answer breaks."""
    evidence = F.coalesce(F.size("evidence_fields"), F.lit(-1))
    actions = F.coalesce(F.size("recommended_actions"), F.lit(-1))
    allowed = F.array(*[F.lit(a) for a in rules.ACTIONS])
    unknown = F.size(F.array_except("recommended_actions", allowed)) > 0
    checks = [
        ("verdict", _outside("verdict", rules.VERDICTS)),
        ("severity", _outside("severity", rules.SEVERITIES)),
        ("confidence", _outside("confidence", rules.CONFIDENCES)),
        ("false_positive_possible", c("false_positive_possible").isNull()),
        ("reasoning_summary", F.coalesce(F.length("reasoning_summary"), F.lit(0)) < 1),
        ("evidence_fields", ~evidence.between(1, rules.MAX_EVIDENCE)),
        ("recommended_actions_size", ~actions.between(1, rules.MAX_ACTIONS)),
        ("recommended_actions_value", F.coalesce(unknown, F.lit(False))),
    ]
    return F.array_except(
        F.array(*[F.when(bad, F.lit(n)) for n, bad in checks]),
        F.array(F.lit(None).cast("string")),
    )


def validate_responses(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("violations", violations()).withColumn(
        "valid", F.size("violations") == 0
    )


def classified(parsed: DataFrame, incidents: DataFrame) -> DataFrame:
    """Parsed answers joined to their incidents: the rows triage works on.

    Spark takes typed answers for a small part of their size and would broadcast all of them; both sides are sorted.
    """
    answer = [
        "candidate_index", "verdict", "severity", "confidence", "false_positive_possible",
        "reasoning_summary", "evidence_fields", "recommended_actions",
    ]
    return incidents.withColumnRenamed("id", "log_id").join(
        parsed.select(*answer).hint("merge"), "candidate_index"
    )
