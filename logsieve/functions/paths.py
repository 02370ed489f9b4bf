"""Request target, path and URI class columns."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from logsieve import rules
from logsieve.functions import text as T


def _alternatives(words) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def request_target(raw_request: Column) -> Column:
    """What stands between the first space and the last `` HTTP/`` of a request line."""
    raw = T.raw_text(raw_request)
    space = F.locate(" ", raw)
    marker = F.locate("/PTTH ", F.reverse(raw))
    end = F.when(marker == 0, F.length(raw) + 1).otherwise(F.length(raw) - marker - 4)
    size = F.greatest(end - space - 1, F.lit(0))
    return F.when(space == 0, F.lit("")).otherwise(
        T.trim_all(F.substring(raw, space + 1, size))
    )


def path_of(target: Column) -> Column:
    return F.substring_index(T.norm(target), "?", 1)


def effective_path(uri: Column, target: Column) -> Column:
    return T.first_text(path_of(target), T.norm(uri))


def endpoint_family(uri: Column) -> Column:
    """First three path segments, with numbers and long hex ids replaced by ``{id}``."""
    decoded = T.norm(uri)
    path = F.lower(
        F.when(uri.contains("?"), F.substring_index(decoded, "?", 1)).otherwise(decoded)
    )
    parts = F.slice(F.array_remove(F.split(path, "/"), ""), 1, 3)
    joined = F.concat(F.lit("/"), F.array_join(parts, "/"))
    return F.regexp_replace(joined, r"/(?:[0-9a-f]{6,}|(?U:\d+))(?=/|\z)", "/{id}")


def content_type_bucket(content_type: Column) -> Column:
    return T.trim_all(F.substring_index(F.lower(T.norm(content_type)), ";", 1))


def is_browser(user_agent: Column) -> Column:
    return T.contains_any(F.lower(user_agent), rules.BROWSER_UA)


def is_login_uri(uri: Column) -> Column:
    return T.contains_any(F.lower(uri), rules.LOGIN_URI)


def is_query_heavy_uri(uri: Column) -> Column:
    return T.contains_any(F.lower(uri), rules.QUERY_HEAVY_URI)


def is_static_uri(uri: Column) -> Column:
    low = F.lower(uri)
    return T.any_of(
        [low.endswith(s) for s in rules.STATIC_SUFFIX]
        + [low.startswith(p) for p in rules.STATIC_PREFIX]
    )


def is_json_type(content_type: Column) -> Column:
    low = F.lower(content_type)
    return low.startswith("application/json") | low.endswith("+json")


def has_hidden_segment(path: Column) -> Column:
    return path.rlike(r"(?:^|/)\.(?!well-known(?:/|\z))")


def _under(path: Column, prefixes) -> Column:
    return path.rlike("^" + _alternatives(prefixes) + r"(?:/|\z)")


def is_sensitive_path(path: Column) -> Column:
    """Hidden, administrative, backup or configuration path (lower-case input)."""
    return (
        has_hidden_segment(path)
        | _under(path, rules.BURST_PATH_PREFIX)
        | path.rlike(_alternatives(rules.BURST_PATH_SUFFIX) + r"\z")
        | path.rlike("(?:^|/)" + _alternatives(rules.BURST_PATH_SEGMENT) + r"(?:/|\z)")
    )


PROBE_HINTS = [
    "dir_probe:burst",
    "dir_probe:sensitive_path",
    "dir_probe:sensitive_config_path",
    "file_probe:config_php",
    "file_probe:admin_config_php",
    "dir_probe:admin_path",
]


def probe_hint_flags(path: Column) -> list[Column]:
    """One condition per entry of ``PROBE_HINTS``; takes the decoded lower-case path."""
    p = path
    given = p != ""
    return [
        given,
        given & is_sensitive_path(p),
        p.isin("/config.php", "/admin/config.php"),
        p == "/config.php",
        p == "/admin/config.php",
        _under(p, rules.BURST_ADMIN_PREFIX),
    ]


def probe_hints(path: Column) -> Column:
    return compact(
        [F.when(flag, F.lit(h)) for flag, h in zip(probe_hint_flags(path), PROBE_HINTS)]
    )


def compact(items: list[Column]) -> Column:
    """Array of the non-NULL items, first occurrence each, order kept."""
    return F.array_except(F.array(*items), F.array(F.lit(None).cast("string")))


def is_burst_probe(path: Column, query: Column) -> Column:
    """Does the request look like one step of directory probing?

    Takes the decoded lower-case path and query.
    """
    return (
        (path != "") & (path != "/")
        & (is_sensitive_path(path) | T.contains_any(query, rules.DIR_PROBE_FILE))
    )


def repeated_params(query: Column) -> Column:
    """Sorted names of query parameters that occur more than once."""
    raw = T.trim_all(query)
    raw = F.when(raw.startswith("?"), F.substring(raw, 2, 1_000_000_000)).otherwise(raw)
    pairs = F.filter(F.split(raw, "&"), lambda x: x != "")
    names = F.filter(
        F.transform(
            pairs,
            lambda x: T.trim_all(T.url_decode(T.url_decode(F.substring_index(x, "=", 1)))),
        ),
        lambda n: n != "",
    )
    sorted_names = F.array_sort(names)
    repeats = F.array_distinct(
        F.filter(
            sorted_names,
            lambda n, i: (i > 0) & (F.get(sorted_names, i - 1) == n),
        )
    )
    empty = F.array().cast("array<string>")
    return F.when(raw.contains("&"), repeats).otherwise(empty)
