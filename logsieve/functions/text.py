"""Text columns: trimming, tolerant URL decoding, pattern helpers.

All of these are built-in expressions that stay inside generated code, except
``unescape_html`` which needs the full HTML entity table.
"""

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from logsieve import rules


def widen(pattern: str) -> str:
    """White space in the fixed patterns includes U+001C to U+001F, which Java's class lacks."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        token = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        inside = token == "[" or inside and token != "]"
        if token == r"\s":
            token = r"\s\x1c-\x1f" if inside else r"[\s\x1c-\x1f]"
        out.append(token)
        i += len(pattern[i : i + 2]) if pattern[i] == "\\" else 1
    return "".join(out)


def rx(pattern: str) -> str:
    """Case-insensitive, Unicode classes, and ``.`` stops only at newline."""
    return "(?idU)" + widen(pattern)


def matches(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(rx(pattern)), F.lit(False))


def matches_lowered(c: Column, pattern: str, low: Column | None = None) -> Column:
    """``matches`` for long texts: ASCII ones are searched in lower case, without the slow Unicode rules.

    ``low``: a column that holds the lower case of ASCII texts. Patterns that tell cases apart need ``matches``.
    """
    plain = "(?d)" + widen(pattern.lower())
    if low is not None:
        fast = F.when(low.isNotNull(), low.rlike(plain))
    else:
        fast = F.when(ascii_only(c), F.lower(c).rlike(plain))
    return F.coalesce(fast.otherwise(c.rlike(rx(pattern))), F.lit(False))


def any_of(conditions) -> Column:
    out = F.lit(False)
    for cond in conditions:
        out = out | cond
    return out


def contains_any(c: Column, words) -> Column:
    return any_of(c.contains(w) for w in words)


def trim_all(c: Column) -> Column:
    return F.btrim(c, F.lit(rules.WHITESPACE))


def raw_text(c: Column) -> Column:
    """Trimmed text, empty for NULL."""
    return trim_all(F.coalesce(c.cast("string"), F.lit("")))


def url_decode(c: Column) -> Column:
    """One round of form decoding; a percent sign without two hex digits stays.

    Names its input once: decodes are nested, and every further mention would multiply.
    """
    return F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def norm(c: Column) -> Column:
    """Decoded and trimmed text, empty for NULL."""
    return trim_all(url_decode(F.coalesce(c.cast("string"), F.lit(""))))


def url_decode_stored(c: Column) -> Column:
    """``url_decode`` of a stored column: most texts have nothing to decode and skip it.

    Names its input several times, so it is not for nested expressions. Bytes that are no UTF-8 go the same way as ever.
    """
    stray = F.when(c.contains("%"), F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")).otherwise(c)
    plain = ~c.contains("%") & ~c.contains("+") & F.is_valid_utf8(c)
    return F.when(plain, c).otherwise(F.url_decode(stray))


def norm_stored(c: Column) -> Column:
    """``norm`` of a stored column."""
    return trim_all(url_decode_stored(F.coalesce(c.cast("string"), F.lit(""))))


def first_text(*cols: Column) -> Column:
    """First non-empty value, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def first_int(*cols: Column) -> Column:
    """First value that is neither NULL nor 0, else 0."""
    return F.coalesce(
        *[F.nullif(c.try_cast("bigint"), F.lit(0).cast("bigint")) for c in cols],
        F.lit(0).cast("bigint"),
    )


def join_distinct(parts: Column) -> Column:
    """Distinct non-empty members of a text array in first-seen order, joined by a space."""
    return F.array_join(
        F.array_except(parts, F.array(F.lit(""), F.lit(None).cast("string"))), " "
    )


@F.pandas_udf(ST.ArrayType(ST.StringType()))
def unescape_html(texts: pd.Series) -> pd.Series:
    """HTML-unescape each member; NULL where the member has no numeric entity."""
    return texts.map(
        lambda items: None
        if items is None
        else [None if t is None else html.unescape(t) for t in items]
    )


def has_entity(c: Column) -> Column:
    return c.contains("&#") & matches(c, rules.HTML_ENTITY)


def without_entities(c: Column) -> Column:
    return F.when(
        c.contains("&#"), F.regexp_replace(c, rx(rules.HTML_ENTITY), "")
    ).otherwise(c)


def ascii_only(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def special_count(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, rules.SPECIAL_CHARS, ""))


def special_ratio_at_least(c: Column, percent: int) -> Column:
    """special characters / length >= percent / 100, in whole numbers."""
    return (F.length(c) > 0) & (special_count(c) * 100 >= F.length(c) * percent)


def shorten(c: Column, limit: int) -> Column:
    """Collapse white space, then cut to ``limit`` characters with an ellipsis."""
    flat = trim_all(F.regexp_replace(raw_text(c), r"(?U)[\s\x1c-\x1f]+", " "))
    cut = F.concat(F.rtrim(F.left(flat, F.lit(limit - 3))), F.lit("..."))
    return F.when(F.length(flat) <= limit, flat).otherwise(cut)


def identifier(c: Column) -> Column:
    text = norm(c)
    return F.when(text.isin(rules.EMPTY_IDENTIFIERS), F.lit("")).otherwise(text)


def flexible_time(text: Column) -> Column:
    """ISO text to a timestamp; also accepts an offset whose plus sign was decoded away."""
    raw = norm(text)
    colons = F.length(raw) - F.length(F.replace(raw, F.lit(":"), F.lit("")))
    lost_plus = raw.rlike(r" (?:09|00):00\z") | (
        (colons >= 3) & ~raw.contains("+") & raw.rlike(r" .{5}\z")
    )
    fixed = F.when(
        lost_plus & (colons >= 2) & raw.rlike(r"^\d{4}-\d\d-\d\d.\d\d:\d\d.* \d\d:\d\d\z"),
        F.regexp_replace(raw, r" (\d\d:\d\d)\z", "+$1"),
    ).otherwise(raw)
    iso = (
        r"^(\d{4}-\d\d-\d\d)(?:.(\d\d:\d\d(?::\d\d(?:\.\d{1,6})?)?)"
        r"(Z|[+-]\d\d:?\d\d)?)?\z"
    )
    day, clock = F.regexp_extract(fixed, iso, 1), F.regexp_extract(fixed, iso, 2)
    zone = F.regexp_replace(F.regexp_extract(fixed, iso, 3), r"^([+-]\d\d)(\d\d)\z", "$1:$2")
    full_clock = F.when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock)
    shown = F.when(clock == "", day).otherwise(F.concat(day, F.lit(" "), full_clock, zone))
    return F.when(day != "", shown.try_cast("timestamp"))
