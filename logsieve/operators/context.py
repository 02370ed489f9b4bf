"""Context around the signatures: encodings, structures, wording, file disclosure."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve import rules
from logsieve.functions import text as T
from logsieve.operators import signatures as S
from logsieve.operators import texts as X

_FILE = {n: p for n, p, _ in rules.FILE_DISCLOSURE}
_FILE_POINTS = {n: p for n, _, p in rules.FILE_DISCLOSURE}
_SIG = {n: p for group in (rules.SQLI, rules.XSS) for n, p, _ in group}
SCRIPT_TAG = _SIG["script_tag"]
JAVASCRIPT = _SIG["javascript_uri"]
MIXED_CASE_SCRIPT = r"<\s*(?!(?-i:script|SCRIPT)\b)script\b"


def _attack_in_combined() -> Column:
    """Any attack hit in the whole text. Without one no single depth can have one."""
    return T.any_of(
        F.col(S.hit_column(fam, n)) for fam in S.ATTACK_FAMILIES for n, _, _ in S.FAMILIES[fam]
    )


def with_depth_facts(df: DataFrame) -> DataFrame:
    """What the decode depths and entity forms hold, whatever else was logged. Needs ``with_text_parts``."""
    df = df.withColumn("depth_low", S.ascii_lower(F.concat_ws(" ", "head_text", "extra_text")))
    low = F.col("depth_low")

    def at(worth: Column, test, *depths: int) -> Column:
        found = T.any_of(c.isNotNull() & test(c) for c in X.depth_texts(*depths))
        return F.when(worth, F.coalesce(found, F.lit(False))).otherwise(False)

    def trimmed(test):
        return lambda c: test(T.trim_all(c))

    def php(c: Column) -> Column:
        return T.matches(c, rules.PHP_FILTER)

    df = df.withColumn("depth_attack", S.may_attack(low))
    attack, wrapped = F.col("depth_attack"), low.isNull() | low.contains("php")
    resource = low.isNull() | low.contains("resource")
    entity = X.entity_texts()
    return df.withColumns(
        {f"attack_at_{d}": at(attack, trimmed(S.any_attack), d) for d in range(3)}
        | {f"sqli_at_{d}": at(attack, trimmed(S.any_sqli), d) for d in (1, 2)}
        | {
            "resource_at": at(resource, trimmed(lambda c: c.rlike(T.rx(r"^resource\s*="))), 0, 1, 2),
            "php_at_1": at(wrapped, php, 1),
            "php_at_2": at(wrapped, php, 2),
            "entity_text": entity,
            "entity_xss": F.coalesce(S.any_xss(entity), F.lit(False)),
            "entity_script": F.coalesce(T.matches(entity, SCRIPT_TAG), F.lit(False)),
            "logged_entity": T.has_entity(F.col("query_raw")) | T.has_entity(F.col("target")),
        }
    ).drop("depth_low", "depth_attack")


def with_encoding_flags(df: DataFrame) -> DataFrame:
    """Where in the decode depths do attack signatures appear? Needs ``with_depth_facts``.

    Depth 2 counts as "depth >= 1" as well, so a bonus for SQL injection seen only at
    depth 2 can never apply and carries no points.
    """
    gate = _attack_in_combined()

    def at(name: str) -> Column:
        return F.when(gate, F.col(name)).otherwise(False)

    df = df.withColumns(
        {f"attack_d{d}": at(f"attack_at_{d}") for d in range(3)}
        | {f"sqli_d{d}": at(f"sqli_at_{d}") for d in (1, 2)}
    )
    return df.withColumns(
        {
            "enc_url": (F.col("attack_d1") | F.col("attack_d2")) & ~F.col("attack_d0"),
            "enc_double": F.col("attack_d2"),
            "enc_double_sqli": F.col("sqli_d2"),
            "enc_entity": F.col("entity_text").isNotNull(),
            "enc_entity_xss": F.col("entity_xss"),
        }
    )


def encoding_hints() -> list[Column]:
    names = [
        ("enc_url", "encoding:url_encoded_payload"),
        ("enc_double", "encoding:double_decoded_payload"),
        ("enc_double", "encoding:decoded_depth_2"),
        ("enc_double_sqli", "encoding:double_decoded_sqli"),
        ("enc_entity", "encoding:html_entity_payload"),
        ("enc_entity", "encoding:html_entity_decoded"),
        ("enc_entity_xss", "encoding:html_entity_decoded_xss"),
    ]
    return [F.when(F.col(flag), F.lit(hint)) for flag, hint in names]


def with_file_disclosure(df: DataFrame) -> DataFrame:
    """File-disclosure flags and points over all samples."""
    sample = F.col("combined")
    low = F.col("combined_low")
    worth = T.contains_any(low, ["php", "convert.base64", "resource"]) | low.isNull()

    def found(name: str) -> Column:
        return F.when(worth, T.matches_lowered(sample, _FILE[name], low)).otherwise(False)

    df = df.withColumns(
        {
            "fd_wrapper": found("php_filter_wrapper"),
            "fd_base64": found("base64_source_filter"),
            "fd_resource": found("resource_parameter") | F.when(worth, F.col("resource_at")).otherwise(False),
            "fd_admin_config": found("admin_config_php"),
            "fd_config": found("config_php"),
            "fd_index": found("index_php"),
        }
    )
    context = F.col("fd_wrapper") | F.col("fd_base64") | F.col("fd_resource")
    df = df.withColumns(
        {
            "fd_admin_config": context & F.col("fd_admin_config"),
            "fd_config": context & F.col("fd_config") & ~F.col("fd_admin_config"),
            "fd_index": context & F.col("fd_index"),
        }
    )

    def wrapper_at(*depths: int) -> Column:
        return F.when(
            F.col("fd_wrapper"), T.any_of(F.col(f"php_at_{d}") for d in depths)
        ).otherwise(False)

    points = [
        ("fd_wrapper", "php_filter_wrapper"), ("fd_base64", "base64_source_filter"),
        ("fd_resource", "resource_parameter"), ("fd_admin_config", "admin_config_php"),
        ("fd_config", "config_php"), ("fd_index", "index_php"),
    ]
    total = sum(
        [F.when(F.col(c), F.lit(_FILE_POINTS[n])).otherwise(0) for c, n in points], F.lit(0)
    )
    return df.withColumns(
        {
            "fd_points": total,
            "fd_decoded": F.when(
                F.col("fd_wrapper"),
                ~T.matches(F.col("combined"), rules.PHP_FILTER) & wrapper_at(1, 2),
            ).otherwise(False),
            "fd_double": wrapper_at(2),
        }
    )


def file_disclosure_hints() -> list[Column]:
    names = [
        ("fd_wrapper", "file_disclosure:php_filter_wrapper"),
        ("fd_base64", "file_disclosure:base64_source_intent"),
        ("fd_resource", "file_disclosure:resource_parameter"),
        ("fd_admin_config", "file_disclosure:sensitive_resource:admin_config_php"),
        ("fd_config", "file_disclosure:sensitive_resource:config_php"),
        ("fd_index", "file_disclosure:sensitive_resource:index_php"),
        ("fd_decoded", "encoding:url_decoded_php_wrapper"),
        ("fd_double", "encoding:double_decoded_php_wrapper"),
    ]
    return [F.when(F.col(flag), F.lit(hint)) for flag, hint in names]


def _xss_hints_of(sample: Column, low: Column | None = None) -> Column:
    def found(pattern: str) -> Column:
        return T.matches_lowered(sample, pattern, low)

    handler, script = found(rules.EVENT_HANDLER_ASSIGNMENT), found(SCRIPT_TAG)
    names = F.array_sort(
        F.array_distinct(
            F.regexp_extract_all(
                F.lower(sample), F.lit(T.rx(rules.EVENT_HANDLER_ASSIGNMENT)), F.lit(1)
            )
        )
    )
    label = "xss:event_handler:"
    named = F.split(F.concat(F.lit(label), F.array_join(names, "\x01" + label)), "\x01")
    none = F.array().cast("array<string>")
    return F.concat(
        F.array(
            F.when(script, F.lit("xss:script_tag")),
            F.when(script & T.matches(sample, MIXED_CASE_SCRIPT), F.lit("xss:mixed_case_script_tag")),
            F.when(handler, F.lit("xss:event_handler")),
        ),
        F.when(handler, named).otherwise(none),
        F.array(
            F.when(found(JAVASCRIPT), F.lit("xss:javascript_protocol")),
            F.when(found(rules.BROWSER_DATA_ACCESS), F.lit("xss:browser_data_access")),
            F.when(found(r"document\.cookie"), F.lit("xss:document_cookie")),
            F.when(found(rules.EXTERNAL_NAVIGATION), F.lit("xss:external_navigation")),
        ),
    )


#: Substrings without which a text gives no XSS hint.
XSS_NEEDS = ["script", "on", "document.cookie", "storage", "location", "fetch", "new", "sendbeacon"]


def query_xss_hints() -> Column:
    """The hints of the decoded query."""
    low = S.ascii_lower(F.col("query"))
    worth = low.isNull() | T.contains_any(low, XSS_NEEDS)
    return F.when(worth, _xss_hints_of(F.col("query"))).otherwise(F.array().cast("array<string>"))


def xss_context_hints(low: Column | None = None, known: bool = False) -> Column:
    """Ordered XSS hints. The decoded query speaks first, then the whole text, whose ``low`` is ``ascii_lower``.

    ``known``: the query's hints and the entity flags are columns already.
    """
    sample = F.col("combined")
    if known:
        of_query, entity_script, logged_entity = F.col("query_xss"), F.col("entity_script"), F.col("logged_entity")
    else:
        of_query = _xss_hints_of(F.col("query"))
        entity_script = F.coalesce(T.matches(X.entity_texts(), SCRIPT_TAG), F.lit(False))
        logged_entity = T.has_entity(F.col("query_raw")) | T.has_entity(F.col("target"))
    reach = T.matches_lowered(sample, rules.BROWSER_DATA_ACCESS, low) & (
        T.matches_lowered(sample, rules.EXTERNAL_NAVIGATION, low) | T.matches_lowered(sample, rules.EXTERNAL_URL, low)
    )
    all_hints = F.concat(
        of_query,
        _xss_hints_of(sample, low),
        F.array(
            F.when(entity_script & logged_entity, F.lit("xss:html_entity_encoded")),
            F.when(entity_script, F.lit("xss:html_entity_decoded_script")),
            F.when(reach, F.lit("xss:external_exfil_intent")),
        ),
    )
    return F.array_except(all_hints, F.array(F.lit(None).cast("string")))


SQLI_STRUCTURE = [
    "quote_termination", "sql_comment", "xclose", "boolean_condition", "union_column_list",
    "schema_access", "from_users",
]


#: As in ``signatures.NEEDS``: without a member of each group the structure cannot be there.
STRUCTURE_NEEDS = {
    "quote_termination": S.NEEDS["quote_termination"],
    "sql_comment": S.NEEDS["sql_comment"],
    "xclose": [["x"], ["'"], [")"]],
    "boolean_condition": [["or", "and"], ["="]],
    "union_column_list": S.NEEDS["union_select"],
    "schema_access": [["information_schema", "sqlite_master", "mysql.user"]],
    "from_users": [["from"], ["users"]],
}


def structure_forms(text: Column) -> Column:
    """The text and its further decoded form, if that differs, each with its lower case if it is ASCII."""
    forms = F.array_distinct(F.array(text, T.norm(text)))
    return F.transform(forms, lambda f: F.struct(f.alias("text"), S.ascii_lower(f).alias("low")))


def sqli_structure(forms: Column) -> dict[str, Column]:
    """Structural parts of an injection, in any of ``structure_forms``.

    ASCII texts are matched in lower case, the cheap way, and only where the parts of a structure are there at all.
    """
    patterns = {
        "quote_termination": _SIG["quote_termination"],
        "sql_comment": _SIG["sql_comment"],
        "xclose": rules.XCLOSE,
        "boolean_condition": rules.BOOLEAN_CONDITION,
        "union_column_list": rules.UNION_COLUMN_LIST,
        "schema_access": rules.SCHEMA_ACCESS,
        "from_users": rules.FROM_USERS,
    }

    def found(form: Column, name: str) -> Column:
        wide, low = form.getField("text"), form.getField("low")
        plain = low
        if name == "sql_comment":
            plain, wide = T.without_entities(low), T.without_entities(wide)
        worth = F.lit(True)
        for group in STRUCTURE_NEEDS[name]:
            worth = worth & T.contains_any(low, group)
        fast = F.when(worth, plain.rlike("(?d)" + T.widen(patterns[name]))).otherwise(False)
        return F.coalesce(F.when(low.isNotNull(), fast).otherwise(T.matches(wide, patterns[name])), F.lit(False))

    def in_form(name: str):
        return lambda form: found(form, name)

    return {n: F.exists(forms, in_form(n)) for n in SQLI_STRUCTURE}


XSS_STRUCTURE = [
    "script_tag", "mixed_case_script_tag", "event_handler_assignment", "javascript_protocol",
    "browser_data_access", "external_navigation", "quote_breakout",
    "html_entity_decoded_script",
]


def xss_structure(entity_script: Column | None = None) -> dict[str, Column]:
    """``entity_script``: whether an entity form holds a script tag, if that is known already."""
    sample = F.col("combined")
    patterns = {
        "script_tag": SCRIPT_TAG,
        "mixed_case_script_tag": MIXED_CASE_SCRIPT,
        "event_handler_assignment": rules.EVENT_HANDLER_ASSIGNMENT,
        "javascript_protocol": JAVASCRIPT,
        "browser_data_access": rules.BROWSER_DATA_ACCESS,
        "external_navigation": rules.EXTERNAL_NAVIGATION,
        "quote_breakout": rules.QUOTE_BREAKOUT,
    }
    out = {n: T.matches(sample, p) for n, p in patterns.items()}
    if entity_script is None:
        entity_script = F.coalesce(T.matches(X.entity_texts(), SCRIPT_TAG), F.lit(False))
    out["html_entity_decoded_script"] = entity_script
    return out


def any_xss_structure(sample: Column, entity_forms: Column) -> Column:
    """The wider test used before a search is offered for review."""
    direct = "|".join(
        f"(?:{p})"
        for p in (
            rules.QUOTE_BREAKOUT, rules.TAG_INJECTION, rules.EVENT_HANDLER_ASSIGNMENT,
            JAVASCRIPT, _SIG["alert_call"], rules.BROWSER_DATA_ACCESS,
        )
    )
    decoded = "|".join(
        f"(?:{p})" for p in (SCRIPT_TAG, rules.EVENT_HANDLER_ASSIGNMENT, JAVASCRIPT)
    )
    return T.matches(sample, direct) | F.coalesce(
        T.matches(entity_forms, decoded), F.lit(False)
    )


def learning_sql(text: Column) -> Column:
    """Does the text read like a search for SQL learning material?"""
    return T.contains_any(F.lower(T.norm(text)), rules.LEARNING_SQL_TERMS)


def learning_xss(text: Column) -> Column:
    low = F.lower(T.norm(text))
    latin = [t.replace(" ", r"\s+") for t in rules.LEARNING_XSS_TERMS if t.isascii()]
    other = [t for t in rules.LEARNING_XSS_TERMS if not t.isascii()]
    worded = T.matches(low, r"(?<![\w./-])(?:" + "|".join(latin) + r")(?![\w./-])")
    return T.contains_any(low, rules.LEARNING_XSS_KEYWORDS) & (worded | T.contains_any(low, other))


def learning_texts() -> Column:
    """Text the XSS wording test looks at: decoded query and logged target."""
    return T.join_distinct(F.array(F.col("query"), F.col("target")))


def has_attack_words(*texts: Column) -> Column:
    parts = [F.nullif(T.norm(t), F.lit("")) for t in texts]
    return T.matches(F.concat_ws(" ", *parts), rules.AUTH_ATTACK_WORDS)


def has_sql_keyword(text: Column) -> Column:
    return T.contains_any(F.lower(T.norm(text)), rules.SUPPORTING_SQL_KEYWORDS)


def has_encoded_marker(text: Column) -> Column:
    return T.contains_any(F.lower(text), rules.ENCODED_MARKERS)


def has_quote_noise(text: Column) -> Column:
    """Repeated quotes, or 15 % special characters once decoded."""
    return T.matches(text, rules.REPEATED_QUOTE) | T.special_ratio_at_least(T.norm(text), 15)
