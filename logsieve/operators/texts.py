"""The texts a request is judged by: decode depths, entity forms, combined text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions import text as T
from logsieve.functions.stage import hold

DEPTHS = ["q0", "q1", "q2", "t0", "t1", "t2"]
HEAD = ["raw_request", "request_text", "uri_text", "query_raw", "query", "target"]


def with_decode_depths(df: DataFrame) -> DataFrame:
    """Adds q0..q2 for the query and t0..t2 for the request target."""
    q0 = F.nullif(F.col("query_raw"), F.lit(""))
    t0 = F.nullif(F.col("target"), F.lit(""))
    df = df.withColumns({"q0": q0, "t0": t0})
    for depth in ("1", "2"):
        prev = str(int(depth) - 1)
        df = df.withColumns(
            {
                f"{kind}{depth}": F.nullif(
                    T.url_decode_stored(F.col(kind + prev)), F.col(kind + prev)
                )
                for kind in ("q", "t")
            }
        )
    return df


def with_entity_forms(df: DataFrame) -> DataFrame:
    """Adds ``q_entities`` and ``t_entities``: decoded forms not seen among the depths."""
    trimmed = {d: T.trim_all(F.col(d)) for d in DEPTHS}
    gated = [F.when(T.has_entity(c), c) for c in trimmed.values()]
    some = T.any_of(F.coalesce(F.col(d).contains("&#"), F.lit(False)) for d in DEPTHS)
    df = df.withColumn("entity_forms", T.unescape_html(F.when(some, F.array(*gated))))
    out = {}
    for kind, first in (("q", 0), ("t", 3)):
        own = [trimmed[f"{kind}{i}"] for i in range(3)]
        forms = [T.trim_all(F.get("entity_forms", F.lit(first + i))) for i in range(3)]
        seen = F.array(*own, F.lit(""), F.lit(None).cast("string"))
        out[f"{kind}_entities"] = F.when(
            F.col("entity_forms").isNotNull(), F.array_except(F.array(*forms), seen)
        )
    return df.withColumns(out).drop("entity_forms")


def with_text_parts(df: DataFrame) -> DataFrame:
    """Adds ``head_text`` and ``extra_text``: what stands before and after ``log_text`` in the combined text."""
    none = F.array().cast("array<string>")
    df = df.withColumn("uri_text", T.norm_stored(F.col("uri")))
    head = T.join_distinct(F.array(*[F.col(n) for n in HEAD]))
    extra = T.join_distinct(
        F.concat(
            F.array(T.trim_all(F.col("q1")), T.trim_all(F.col("q2"))),
            F.coalesce("q_entities", none),
            F.array(T.trim_all(F.col("t1")), T.trim_all(F.col("t2"))),
            F.coalesce("t_entities", none),
        )
    )
    return df.withColumns({"head_text": head, "extra_text": extra})


def _joined(first: Column, second: Column, known: Column) -> Column:
    """Both texts with a space between; a second text that is known already adds nothing."""
    return F.when(known, first).when(first == "", second).otherwise(F.concat(first, F.lit(" "), second))


def with_combined_text(df: DataFrame) -> DataFrame:
    """Adds ``base_text`` and ``combined``: distinct forms of the request in one text."""
    log = F.coalesce("log_text", F.lit(""))
    known = F.coalesce(log.isin("", *[F.col(n) for n in HEAD]), F.lit(False))
    df = df.withColumn("base_text", _joined(F.col("head_text"), log, known))
    extra = F.col("extra_text")
    return df.withColumn(
        "combined", _joined(F.col("base_text"), extra, extra.isin("", F.col("base_text")))
    ).drop("head_text", "extra_text", "uri_text")


def with_texts(df: DataFrame) -> DataFrame:
    return with_combined_text(with_text_parts(with_entity_forms(with_decode_depths(df))))


def depth_texts(*depths: int) -> list[Column]:
    return [F.col(f"{kind}{d}") for d in depths for kind in ("q", "t")]


def entity_texts() -> Column:
    """All entity-decoded forms as one text, NULL if there are none."""
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce("q_entities", none), F.coalesce("t_entities", none))
    return F.when(F.size(both) > 0, F.array_join(both, "\n\x00\n"))


def variant_rows(df: DataFrame) -> DataFrame:
    """Long form: one row per (request, field, depth) text."""
    parts = [
        F.struct(F.lit(k).alias("field"), F.lit(d).alias("depth"), F.col(f"{p}{d}").alias("text"))
        for k, p in (("query_string", "q"), ("raw_request_target", "t"))
        for d in range(3)
    ]
    return df.select("source_table", "id", F.inline(F.array(*parts))).where("text is not null")


def entity_rows(df: DataFrame) -> DataFrame:
    """Long form of the entity-decoded forms with the depth they came from."""
    def with_entities(kind: str) -> DataFrame:
        own = F.array(*[T.trim_all(F.col(f"{kind}{i}")) for i in range(3)])
        field = {"q": "query_string", "t": "raw_request_target"}[kind]
        rows = df.select("source_table", "id", F.lit(field).alias("field"), own.alias("own"))
        asked = F.transform("own", lambda t: F.when(T.has_entity(t), t))
        some = F.coalesce(F.array_join("own", " ").contains("&#"), F.lit(False))
        rows = hold(rows, {"forms": T.unescape_html(F.when(some, asked))})
        each = rows.select("*", F.posexplode("forms").alias("source_depth", "form"))
        text = T.trim_all(F.col("form"))
        earlier = F.transform(
            F.slice("forms", F.lit(1), F.col("source_depth")), lambda t: T.trim_all(t)
        )
        fresh = ~F.coalesce(F.array_contains(F.concat("own", earlier), text), F.lit(False))
        return each.where(fresh & (text != "")).select(
            "source_table", "id", "field", "source_depth", text.alias("text")
        )

    return with_entities("q").unionByName(with_entities("t"))
