"""The payload catalogue: expected verdict or noise category, and key reasons."""

import pytest
from helpers import BROWSER, requests, row
from pyspark.sql import functions as F

from logsieve.operators import score
from logsieve.sources import store

CASES = {
    1: ("/rest/products/search?q='union%20select%201,2,3,4,5,6,7,8,9--'", {}, "sqli"),
    2: ("/", {}, "low_signal_fuzzing"),
    3: ("/etc/passwd", {"status_code": 404}, "path_traversal"),
    4: (
        "/public/../etc/passwd",
        {"uri": "/etc/passwd", "resp_content_type": "text/html", "response_body_bytes": 10000},
        "suspicious",  # two traversal hits: not a fallback page
    ),
    5: (
        "/etc/passwd", {"resp_content_type": "text/html", "response_body_bytes": 75002},
        "benign_fallback_html",
    ),
    6: ("/rest/products/search?q=123;whoami", {}, "command_injection"),
    7: ("/search?id=123&id=456'%20OR%20'1'='1", {}, "sqli"),
    8: ("/search?q=<img src=x onerror=alert(1)>", {}, "xss"),
    9: ("/search?q=<svg onload=alert(1)>", {}, "xss"),
    10: ("/search?q=javascript:alert(1)", {}, "xss"),
    11: ("/public/images/%2e%2e/%2e%2e/etc/passwd", {}, "path_traversal"),
    12: ("/rest/products/search?q=apple", {}, "low_signal_fuzzing"),
    13: ("/rest/products/search?q=apple", {"user_agent": BROWSER}, "benign_normal_search"),
    14: ("/config.php", {"response_body_bytes": 0}, "low_signal_dir_probe"),
    15: (
        "/index.php?route=php%3A%2F%2Ffilter%2Fconvert.base64-encode%2Fresource%3Dindex.php", {},
        "suspicious_file_disclosure",
    ),
    16: ("/index.php?route=product%2Fsearch&search=x%27%29%29+OR+1%3D1+--", {}, "sqli"),
    17: (
        "/index.php?search=%26%23x3C%3Bscript%26%23x3E%3Balert(1)%26%23x3C%3B%2Fscript"
        "%26%23x3E%3B", {}, "xss",
    ),
    18: (
        "/search?q=how%20to%20prevent%20xss%20cookie", {"user_agent": BROWSER},
        "benign_normal_search",
    ),
    19: ("/search?q=%2527%2520or%25201%253D1--", {}, "sqli"),
    20: (
        "/socket.io/?EIO=4&transport=polling", {"user_agent": BROWSER}, "socketio_polling",
    ),
    21: (
        "/rest/user/login",
        {
            "method": "POST", "req_content_type": "application/json", "response_body_bytes": 300,
            "user_agent": "auth-bypass-poc",
        },
        "suspicious_auth_success",
    ),
    22: (
        "/rest/user/login",
        {
            "method": "POST", "req_content_type": "application/json", "response_body_bytes": 299,
            "user_agent": "auth-bypass-poc",
        },
        "low_signal_fuzzing",
    ),
}


@pytest.fixture(scope="module")
def judged(spark):
    rows = [row(i, t, **o) for i, (t, o, _) in CASES.items()]
    found = score.judge(requests(spark, rows))
    kept = {r.id: r for r in score.candidates(found).collect()}
    left = {r.id: r for r in score.filtered(found).collect()}
    return kept, left


def test_every_row_is_candidate_or_noise(judged):
    kept, left = judged
    assert sorted([*kept, *left]) == sorted(CASES)


@pytest.mark.parametrize("case", [i for i in CASES if i != 4])
def test_catalogue(judged, case):
    kept, left = judged
    outcome = kept[case].verdict_hint if case in kept else left[case].noise_category
    assert outcome == CASES[case][2]


def test_scores_and_order_of_reasons(judged):
    kept, _ = judged
    assert kept[6].score == 6
    assert kept[1].reason_hints[:3] == [
        "sqli:union_select(+5)", "sqli:sql_comment(+2)", "sqli:quote_termination(+4)",
    ]
    assert kept[7].embedded_attack_hint == "sqli" and kept[7].hpp_param_names == ["id"]
    assert "encoding:double_decoded_sqli" in kept[19].reason_hints
    assert "encoding:html_entity_decoded_xss" in kept[17].reason_hints
    assert not any("sql_comment" in h for h in kept[17].reason_hints)


def test_boundaries(spark):
    q = {39: "a" * 38, 40: "a" * 39, 79: "a" * 78, 80: "a" * 79}  # plus the question mark
    rows = [row(n, "/x?" + text, user_agent=BROWSER) for n, text in q.items()]
    rows += [
        row(1, "/x", duration_us=1_999_999), row(2, "/x", duration_us=2_000_000),
        row(3, "/x?" + "-" * 3 + "a" * 16), row(4, "/x?" + "-" * 3 + "a" * 17),
    ]
    got = {r.id: r.score for r in score.judge(requests(spark, rows)).collect()}
    assert [got[n] for n in (39, 40, 79, 80)] == [0, 1, 1, 2]
    assert got[2] - got[1] == 3
    assert got[3] - got[4] == 1  # 3/20 reaches .15, 3/21 does not


def test_non_ascii_text_and_long_query(spark):
    rows = [
        row(1, "/search?q=%ED%95%9C or 1=1 %EC%98%88", user_agent=BROWSER),
        row(2, "/search?q=" + "a" * 6000 + "%27%20or%201=1--", user_agent=BROWSER),
    ]
    got = {r.id: r for r in score.candidates(score.judge(requests(spark, rows))).collect()}
    assert "sqli:or_true(+4)" in got[1].reason_hints
    assert "sqli:or_true(+4)" in got[2].reason_hints


def test_static_asset_only_in_access(spark):
    rows = [row(1, "/assets/app.js", user_agent=BROWSER)]
    access = score.judge(requests(spark, rows, "access")).first()
    security = score.judge(requests(spark, rows)).first()
    assert access.noise_category == "static_asset"
    assert security.noise_category == "benign_normal_search"


def test_early_noise_needs_no_other_facts_than_canonical_rows(spark):
    rows = [
        row(1, "/assets/app.js", user_agent=BROWSER), row(2, "/assets/app.js", status_code=404),
        row(3, "/socket.io/?EIO=4&transport=polling", user_agent=BROWSER, error_link_id=""),
        row(4, "/socket.io/?EIO=4&transport=polling&x=' or 1=1--", user_agent=BROWSER, error_link_id=""), row(5, "/"),
    ]
    for source, static in (("access", "static_asset"), ("security", None)):
        plain = requests(spark, rows, source)
        want = {1: static, 2: None, 3: "socketio_polling", 4: None, 5: None}
        assert {r.id: r.category for r in plain.select("id", score.early_noise().alias("category")).collect()} == want
        judged = score.judge(plain).select("id", "early_noise").collect()  # with what is known of the line
        assert {r.id: r.early_noise for r in judged} == want


def _one_text_of(pattern):
    """A text that the alternatives of a fixed pattern match, one for each top-level part."""
    return {
        "dotdot_slash": ["../", "..\\\\", "%2e%2e%2f", "%2e%2e/", "..%2f", "%252e%252e%252f"],
        "etc_passwd": ["/etc/passwd", "win.ini"],
        "union_select": ["union select", "union\x1cselect"],
        "or_true": ["' or 1=1", "%27 or a=b", "or\x1d'1'='1'"],
        "and_true": ["and 1=1"],
        "sql_comment": ["--", "#", "/*"],
        "sleep_func": ["sleep(", "sleep ("],
        "benchmark_func": ["benchmark("],
        "waitfor_delay": ["waitfor delay"],
        "information_schema": ["information_schema"],
        "select_from": ["select a from b"],
        "drop_table": ["drop table"],
        "insert_into": ["insert into"],
        "update_set": ["update a set b"],
        "delete_from": ["delete\x1ffrom"],
        "quote_termination": ["' or", "%27 union", "';", "'--"],
        "script_tag": ["<script", "<\x1escript"],
        "img_onerror": ["<img src=x onerror="],
        "svg_onload": ["<svg onload="],
        "javascript_uri": ["javascript:"],
        "event_handler": ["onclick="],
        "alert_call": ["alert("],
        "document_cookie": ["document.cookie"],
        "pipe_exec": ["|whoami", "| id"],
        "semicolon_exec": [";cat", "; curl"],
        "subshell": ["$(id)", "`id`"],
    }[pattern]


def test_prefilters_let_every_alternative_through(spark):
    """The cheap substring tests never hide a match of the plain pattern."""
    from logsieve.functions import text as T
    from logsieve.operators import signatures as S

    for family, found in S.FAMILIES.items():
        for name, pattern, _ in found:
            if name not in S.NEEDS:
                continue
            df = spark.createDataFrame([(t,) for t in _one_text_of(name)], "x string")
            x = F.col("x")
            for r in df.select("x", S.hit(family, name, x, S.ascii_lower(x)).alias("hit"), T.matches(x, pattern).alias("plain")).collect():
                assert r.plain and r.hit, (name, r.x)


def test_white_space_of_patterns_is_wide():
    from logsieve.functions import text as T

    assert T.widen(r"a\s+[^\s>]\\s") == r"a[\s\x1c-\x1f]+[^\s\x1c-\x1f>]\\s"


def test_payload_behind_a_long_prefix_is_found(spark):
    from logsieve.operators import score

    deep = "?q=" + "a" * 6000 + "%2527%2520union%2520select%25201"
    got = score.judge(requests(spark, [row(1, "/search" + deep)])).select("hit_sqli_union_select", "q2").first()
    assert got.q2.endswith("union select 1") and got.hit_sqli_union_select


def test_sql_structures_are_those_of_the_plain_patterns(spark):
    """Whatever the case, the alphabet and the further decoded form; a plain text is searched for one form only."""
    from logsieve import rules
    from logsieve.functions import text as T
    from logsieve.operators import context as C
    from logsieve.operators import signatures as S

    sqli = {n: p for n, p, _ in rules.SQLI}
    patterns = {
        "quote_termination": sqli["quote_termination"], "xclose": rules.XCLOSE, "boolean_condition": rules.BOOLEAN_CONDITION,
        "union_column_list": rules.UNION_COLUMN_LIST, "schema_access": rules.SCHEMA_ACCESS, "from_users": rules.FROM_USERS,
    }
    seen = [
        "a' OR '1'='1", "x%27))+UNION+SELECT+a,b", "é UNİON select union SELECT 1, 2 from Users", "1 and 2=2", "&#39; only",
        "&#39; --", "/* c", "sqlite_master", "%2527%2520or%25201=1", "plain", "", "mysql.USER", "X ' ) )", "oſ from uſers",
    ]
    df = spark.createDataFrame([(t,) for t in seen], "x string").withColumn("forms", C.structure_forms(F.col("x")))
    forms = [F.col("x"), T.norm(F.col("x"))]
    plain = {n: T.any_of(T.matches(f, p) for f in forms) for n, p in patterns.items()}
    plain["sql_comment"] = T.any_of(T.matches(T.without_entities(f), S._COMMENT) for f in forms)
    got = C.sqli_structure(F.col("forms"))
    hits = dict.fromkeys(got, 0)
    shown = [v.alias(f"got_{n}") for n, v in got.items()] + [v.alias(f"plain_{n}") for n, v in plain.items()]
    for r in df.select("x", F.size("forms").alias("n"), *shown).collect():
        for n in got:
            assert r[f"got_{n}"] == r[f"plain_{n}"], (n, r.x)
            hits[n] += r[f"got_{n}"]
        assert r.n == (2 if "%" in r.x or "+" in r.x else 1), r.x
    assert all(hits.values()), hits


def test_texts_with_nothing_to_decode_are_left_alone(spark):
    from logsieve.functions import text as T

    seen = ["plain", " a ", "a+b", "%41", "100% sure", "%zz+%20", "é", "é+%C3%A9", "", "%", "+", None]
    rows = spark.createDataFrame([(t.encode() if t is not None else None,) for t in seen] + [(b"bad \xff byte",), (b"\xff%41",)], "b binary")
    df = rows.select(F.col("b").cast("string").alias("x"))
    for r in df.select("x", T.norm_stored(F.col("x")).alias("got"), T.norm(F.col("x")).alias("want")).collect():
        assert r.got == r.want, r.x


def test_lower_case_search_finds_what_the_unicode_search_finds(spark):
    from logsieve import rules
    from logsieve.functions import text as T
    from logsieve.operators import signatures

    texts = [
        "x=1' OR 1=1 --", "<ScRiPt>alert(1)</sCrIpT>", "a\nb ONerror\x1c= y", "LOCALSTORAGE", "new\x1fImage().src",
        "ſcript <ſcript", "<SCRİPT", "select x FROM t", "é document.cookie", "PHP%3A%2F%2FFILTER", "", None, "plain",
        "navigator.sendBEACON (", "SELECT a\nfrom b", "&#x3c;#", "café UNION SELECT",
    ]
    patterns = [
        p for group in (rules.SQLI, rules.XSS, rules.TRAVERSAL, rules.CMDI, rules.FILE_DISCLOSURE) for _, p, _ in group
    ] + [
        rules.EVENT_HANDLER_ASSIGNMENT, rules.BROWSER_DATA_ACCESS, rules.EXTERNAL_NAVIGATION, rules.EXTERNAL_URL,
        signatures._ANY_ATTACK, signatures._ANY_SQLI,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", signatures.ascii_lower(F.col("t")))
    forms = [
        F.array(*[find(F.col("t"), p) for p in patterns])
        for find in (T.matches, T.matches_lowered, lambda c, p: T.matches_lowered(c, p, F.col("low")))
    ]
    for text, wide, plain, stored in df.select("t", *forms).collect():
        assert wide == plain == stored, text


def test_lines_are_judged_once(spark, monkeypatch):
    """Repeated request lines are one row of the line facts, and each row is judged as if alone."""
    lines = ["/search?q=1%27%20or%20%271%27%3D%271", "/static/a.css", "/%61dmin/?x=%26%2360%3Bscript%26%2362%3B"]
    rows = [row(i, lines[i % 3], status_code=404 if i % 2 else 200) for i in range(1, 31)]
    written = []

    def seen(df, name, **options):
        out = store.materialize(df, name, **options)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(score, "materialize", seen)
    shown = ["id", "score", "verdict_hint", "noise_category", "probe_path", "combined", "enc_entity", "hpp_names"]
    got = score.judge(requests(spark, rows)).withColumn("hpp_names", F.array_join("hpp_param_names", ","))
    assert written == [("line-facts", 3)]
    monkeypatch.setattr(score, "with_line_facts", score.line_facts)
    alone = score.judge(requests(spark, rows)).withColumn("hpp_names", F.array_join("hpp_param_names", ","))
    assert sorted(map(str, got.select(*shown).collect())) == sorted(map(str, alone.select(*shown).collect()))
