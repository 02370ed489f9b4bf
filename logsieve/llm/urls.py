"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

A rule is ``host/path``: it fits its host and all subdomains if the URL's path starts with the
rule's; the longest rule that fits wins. URLs that rules judge are the labelled ones: the trees
learn from them and judge the others.

Null URLs and those without ``://`` have an empty host and path and are judged by the trees.
If no URL is labelled, the verdict is ``default``; if only one verdict occurs among the labels,
it is given to all. Repeated rows get the same verdict. An empty table gives an empty result.
"""

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.sources import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The trees learn from so many labelled URLs at most, chosen by hash.
MAX_LABELLED = 20_000
LEXICAL = [
    "url_len", "host_len", "path_len", "depth", "labels", "digit_ratio", "upper_ratio", "symbol_ratio",
    "host_digit_ratio", "host_vowel_ratio", "entropy", "host_entropy", "params", "query_len", "fragment_len",
    "hyphens", "secure", "dot_in_path",
]
SUFFIX = ["tld_count", "domain_count", "segment_count", "tail_count"]


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct rule, verdict of the longest rule that fits, or null. ``rules``: ("host/path", verdict)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _ratio(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.greatest(F.length(text), F.lit(1))
    chars = F.array_distinct(F.split(text, ""))
    share = F.transform(chars, lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n)
    parts = F.filter(share, lambda p: p > 0)
    return F.coalesce(-F.aggregate(parts, F.lit(0.0), lambda a, p: a + p * F.log2(p)), F.lit(0.0))


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the lexical features and the suffix keys to url, host, path."""
    url, h, p = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    parts = F.split(h, r"\.")
    values = {
        "url_len": F.length(url), "host_len": F.length(h), "path_len": F.length(p),
        "depth": F.regexp_count(p, F.lit("/[^/]")), "labels": F.size(parts),
        "digit_ratio": _ratio(url, "[0-9]"), "upper_ratio": _ratio(url, "[A-Z]"), "symbol_ratio": _ratio(url, "[^A-Za-z0-9]"),
        "host_digit_ratio": _ratio(h, "[0-9]"), "host_vowel_ratio": _ratio(h, "[aeiou]"),
        "entropy": entropy(url), "host_entropy": entropy(h),
        "params": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1), "query_len": F.length(query),
        "fragment_len": F.length(F.regexp_extract(url, "(?s)#(.*)", 1)), "hyphens": F.regexp_count(url, F.lit("-")),
        "secure": url.startswith("https:"), "dot_in_path": F.regexp_count(p, F.lit(r"\.")),
    }
    keys = {
        "tld": F.element_at(parts, -1), "domain": F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "."),
        "segment": F.regexp_extract(p, "^/([^/]*)", 1), "tail": F.regexp_extract(p, r"(\.[^./]*|/)$", 1),
    }
    return urls.withColumns({k: v.cast("double") for k, v in values.items()} | keys)


def with_suffix_counts(pages: DataFrame) -> DataFrame:
    """How common each host suffix, first path segment and path ending is among all URLs, on a log scale."""
    keys = [s.removesuffix("_count") for s in SUFFIX]
    long = pages.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in keys])))
    counts = store.materialize(long.groupBy("kind", "value").count(), "suffixes")
    for k in keys:
        own = counts.where(F.col("kind") == k).select(F.col("value").alias(k), F.log1p("count").alias(f"{k}_count"))
        pages = pages.join(own, k, "left")
    return pages.drop(*keys)


def fit(features: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = 20, depth: int = 4, seed: int = 0):
    """Trees that tell block (1) from allow (0); ``features`` has label and the feature columns."""
    labelled = features.where(F.col("label").isNotNull())
    bounded = labelled.orderBy(F.xxhash64("url", F.lit(seed)), "url").limit(max_labelled).select("x", "label")
    bounded = store.materialize(bounded, "url-training")
    trees = GBTClassifier(
        featuresCol="x", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=seed,
        predictionCol="_p", maxMemoryInMB=64,
    )
    return trees.setRawPredictionCol("_raw").setProbabilityCol("_prob").fit(bounded)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], default: str = "allow", **options) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the trees' leaning to block, 0 to 1; null under a rule) of pages (page_id, url)."""
    url = F.col("url")
    light = pages.select("page_id", "url", host(url).alias("host"), path(url).alias("path"))
    light = light.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    label = F.when(F.col("_r.verdict") == "block", 1.0).when(F.col("_r").isNotNull(), 0.0)
    parts = with_suffix_counts(lexical(light.withColumn("label", label)))
    assembled = VectorAssembler(inputCols=LEXICAL + SUFFIX, outputCol="x").transform(parts)
    features = store.materialize(assembled.select("page_id", "url", "host", "path", "_r", "label", "x"), "url-features")
    seen = {r["label"] for r in features.select("label").distinct().collect()} - {None}
    out = ["page_id", "host", "path", F.col("_r.rule").alias("rule")]
    if len(seen) < 2:
        other = default if not seen else "block" if 1.0 in seen else "allow"
        return features.select(*out, F.coalesce("_r.verdict", F.lit(other)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    model = fit(features, **options)
    ruled = features.where(F.col("_r").isNotNull()).select(
        *out, F.col("_r.verdict").alias("verdict"), F.lit(None).cast("double").alias("score")
    )
    rest = model.transform(features.where(F.col("_r").isNull()))
    verdict = F.when(F.col("_p") == 1.0, "block").otherwise("allow")
    p = F.element_at(vector_to_array("_prob"), 2)
    return ruled.unionByName(rest.select(*out, verdict.alias("verdict"), p.alias("score")))
