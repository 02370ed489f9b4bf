"""Signature hits: one boolean column per signature, evaluated once per request."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve import rules
from logsieve.functions import text as T

FAMILIES = {
    "sqli": rules.SQLI,
    "xss": rules.XSS,
    "traversal": rules.TRAVERSAL,
    "cmdi": rules.CMDI,
    "ua": rules.AUTOMATION_UA,
}
ATTACK_FAMILIES = ["sqli", "xss", "traversal", "cmdi"]


def hit_column(family: str, name: str) -> str:
    return f"hit_{family}_{name}"


# Substrings without which a signature cannot match: every group needs one of its
# members. They only save work; the signature itself still decides.
NEEDS = {
    "union_select": [["union"], ["select"]],
    "or_true": [["or"], ["="]],
    "and_true": [["and"], ["="]],
    "sql_comment": [["--", "#", "/*"]],
    "sleep_func": [["sleep"]],
    "benchmark_func": [["benchmark"]],
    "waitfor_delay": [["waitfor"], ["delay"]],
    "information_schema": [["information_schema"]],
    "select_from": [["select"], ["from"]],
    "drop_table": [["drop"], ["table"]],
    "insert_into": [["insert"], ["into"]],
    "update_set": [["update"], ["set"]],
    "delete_from": [["delete"], ["from"]],
    "quote_termination": [["'", "%27"]],
    "script_tag": [["<"], ["script"]],
    "img_onerror": [["<"], ["onerror"]],
    "svg_onload": [["<"], ["onload"]],
    "javascript_uri": [["javascript"]],
    "event_handler": [["on"], ["="]],
    "alert_call": [["alert"]],
    "document_cookie": [["document.cookie"]],
    "dotdot_slash": [["..", "%2e%2e", "%252e%252e"]],
    "etc_passwd": [["/etc/passwd", "win.ini"]],
    "pipe_exec": [["|"]],
    "semicolon_exec": [[";"]],
    "subshell": [["$(", "`"]],
}


def ascii_lower(text: Column) -> Column:
    """Lower-case form of a pure ASCII text, else NULL."""
    return F.when(T.ascii_only(text), F.lower(text))


def _worth(name: str, low: Column) -> Column:
    cond = F.lit(True)
    for group in NEEDS.get(name, []):
        cond = cond & T.contains_any(low, group)
    return cond


def hit(
    family: str, name: str, text: Column, low: Column, skip_entities: bool = True
) -> Column:
    """Does the signature match? ``low`` is ``ascii_lower(text)``.

    ASCII texts are matched in lower case, the cheap way; others with full Unicode rules.
    """
    pattern = {n: p for n, p, _ in FAMILIES[family]}[name]
    plain, wide = low, text
    if name == "sql_comment" and skip_entities:
        plain, wide = T.without_entities(low), T.without_entities(text)
    fast = F.when(_worth(name, low), plain.rlike("(?d)" + T.widen(pattern))).otherwise(False)
    slow = T.matches(wide, pattern)
    return F.coalesce(F.when(low.isNotNull(), fast).otherwise(slow), F.lit(False))


def may_attack(low: Column) -> Column:
    """Can any attack signature match the text whose ``ascii_lower`` is ``low``?"""
    worth = T.any_of(_worth(n, low) for fam in ATTACK_FAMILIES for n, _, _ in FAMILIES[fam])
    return low.isNull() | worth


def with_hits(df: DataFrame, families=tuple(FAMILIES), text="combined") -> DataFrame:
    low_names = {"ua": "ua_low"}
    needed = {}
    for fam in families:
        source = "user_agent" if fam == "ua" else text
        low = low_names.get(fam, f"{text}_low")
        if low not in df.columns:
            needed[low] = ascii_lower(F.col(source))
    df = df.withColumns(needed)
    return df.withColumns(
        {
            hit_column(fam, name): hit(
                fam, name,
                F.col("user_agent" if fam == "ua" else text),
                F.col(low_names.get(fam, f"{text}_low")),
            )
            for fam in families
            for name, _, _ in FAMILIES[fam]
        }
    )


def hit_count(family: str) -> Column:
    cols = [F.col(hit_column(family, n)).cast("int") for n, _, _ in FAMILIES[family]]
    return sum(cols[1:], cols[0])


def hit_points(family: str) -> Column:
    cols = [
        F.when(F.col(hit_column(family, n)), F.lit(p)).otherwise(0)
        for n, _, p in FAMILIES[family]
    ]
    return sum(cols[1:], cols[0])


def hit_labels(families) -> list[Column]:
    """Reason texts such as ``sqli:union_select(+5)``, NULL where there is no hit."""
    return [
        F.when(F.col(hit_column(fam, n)), F.lit(f"{fam}:{n}(+{p})"))
        for fam in families
        for n, _, p in FAMILIES[fam]
    ]


def _either(signatures) -> str:
    return "|".join(f"(?:{p})" for n, p, _ in signatures if n != "sql_comment")


_ANY_SQLI = _either(rules.SQLI)
_ANY_ATTACK = _either(rules.SQLI + rules.XSS + rules.TRAVERSAL + rules.CMDI)
_COMMENT = {n: p for n, p, _ in rules.SQLI}["sql_comment"]


def _comment(text: Column) -> Column:
    return T.matches_lowered(T.without_entities(text), _COMMENT)


def any_sqli(text: Column) -> Column:
    return _comment(text) | T.matches_lowered(text, _ANY_SQLI)


def any_attack(text: Column) -> Column:
    return _comment(text) | T.matches_lowered(text, _ANY_ATTACK)


def any_attack_as_logged(text: Column) -> Column:
    """Like ``any_attack`` but entities count towards the comment signature."""
    return T.matches_lowered(text, _COMMENT) | T.matches_lowered(text, _ANY_ATTACK)


def any_xss(text: Column) -> Column:
    return T.matches(text, _either(rules.XSS))


def hit_rows(df: DataFrame) -> DataFrame:
    """Long form of the hits: one row per (request, family, signature)."""
    entries = [
        F.struct(
            F.lit(fam).alias("family"),
            F.lit(n).alias("signature"),
            F.when(F.col(hit_column(fam, n)), F.lit(p)).alias("points"),
        )
        for fam, sigs in FAMILIES.items()
        for n, _, p in sigs
    ]
    return df.select("source_table", "id", F.inline(F.array(*entries))).where(
        "points is not null"
    )


def hit_totals(df: DataFrame) -> DataFrame:
    """Hits and points per family and signature over all requests.

    Counts the boolean columns in one pass; nothing is exploded or shuffled per hit.
    """
    sums = [
        F.sum(F.col(hit_column(fam, n)).cast("long")).alias(hit_column(fam, n))
        for fam, sigs in FAMILIES.items()
        for n, _, _ in sigs
    ]
    entries = [
        F.struct(
            F.lit(fam).alias("family"),
            F.lit(n).alias("signature"),
            F.col(hit_column(fam, n)).alias("hits"),
            (F.col(hit_column(fam, n)) * p).alias("points"),
        )
        for fam, sigs in FAMILIES.items()
        for n, _, p in sigs
    ]
    return df.agg(*sums).select(F.inline(F.array(*entries))).where("hits > 0")
