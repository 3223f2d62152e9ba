"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

Everything is DataFrame expressions and MLlib's DataFrame API. The URLs on which a rule
decides are the labelled URLs; the trees learn from about FIT_URLS of them what blocked
and allowed URLs look like and judge the URLs that no rule fits.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regdelta.llm.common import cut, hash_edge, table

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: About so many labelled URLs are fitted, drawn by the hash of the URL.
FIT_URLS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["length", "host_length", "labels", "depth", "digit_ratio", "entropy", "parameters", "query_length", "host_rate", "host_share", "file_rate", "file_share"]


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text)
    signs = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(signs, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return F.when(n > 0, bits).otherwise(0.0)


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features of url, host and path that need no statistics, and the two suffixes that do."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    n = F.greatest(F.length(url), F.lit(1))
    return df.select(
        "*",
        F.length(url).cast("double").alias("length"),
        F.length("host").cast("double").alias("host_length"),
        _count(F.col("host"), ".").cast("double").alias("labels"),
        _count(F.col("path"), "/").cast("double").alias("depth"),
        ((F.length(url) - F.length(F.regexp_replace(url, "[0-9]", ""))) / n).alias("digit_ratio"),
        _entropy(url).alias("entropy"),
        F.when(query == "", 0.0).otherwise(_count(query, "&") + 1.0).alias("parameters"),
        F.length(query).cast("double").alias("query_length"),
        F.regexp_extract("host", r"([^.]*)$", 1).alias("host_suffix"),
        F.regexp_extract("path", r"(\.[^./]*)$", 1).alias("file_suffix"),
    )


def _suffix_statistics(fit: DataFrame, suffix: str, name: str, rows: int) -> DataFrame:
    """Smoothed share of blocked URLs, and share of all, of each suffix among the fitted URLs: no more rows than those."""
    return fit.groupBy(suffix).agg(
        ((F.sum("label") + 1.0) / (F.count("*") + 2.0)).alias(f"{name}_rate"), (F.count("*") / F.lit(float(rows))).alias(f"{name}_share")
    )


def _with_statistics(df: DataFrame, by_host: DataFrame, by_file: DataFrame) -> DataFrame:
    # both tables have fewer rows than FIT_URLS
    out = df.join(F.broadcast(by_host), "host_suffix", "left").join(F.broadcast(by_file), "file_suffix", "left")
    return out.na.fill({"host_rate": 0.5, "file_rate": 0.5, "host_share": 0.0, "file_share": 0.0})


def judge_urls(
    pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", fit_urls: int = FIT_URLS, rounds: int = 20, depth: int = 4
) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score: one row per input row.

    A rule fits its host and that host's subdomains where the path starts with the rule's
    path; the longest one decides and block_score is null. Where none fits, the trees
    do: block_score is their probability and decides at 0.5. Null and URLs without
    `://` have empty host and path, fit no rule with a host, and are judged by the
    trees. If the rules label no URL, or all alike, there is nothing to learn: the
    verdict is then that one label, or allow. Repeated rows and null ids are judged like
    any other row; an empty input gives an empty result; other columns are not read.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    base = base.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), ruled.alias("ruled"))

    # a URL is learned from once, however many pages have it
    labelled = base.where("ruled is not null")
    edge = hash_edge(labelled.agg(F.approx_count_distinct("url")).first()[0], fit_urls)
    fit = lexical(labelled.where(F.xxhash64("url") <= F.lit(edge)).dropDuplicates(["url"])).withColumn("label", (F.col("ruled") == "block").cast("double"))
    fit = cut(fit.drop("path"), "url-fit")
    got = fit.agg(F.count("*").alias("n"), F.sum("label").alias("blocked")).first()
    if not got["n"] or got["blocked"] in (0, got["n"]):
        alone = "block" if got["n"] and got["blocked"] else "allow"
        return base.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(alone)).alias("verdict"), F.lit(None).cast("double").alias("block_score"))

    by_host = cut(_suffix_statistics(fit, "host_suffix", "host", got["n"]), "url-host")
    by_file = cut(_suffix_statistics(fit, "file_suffix", "file", got["n"]), "url-file")
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=7).fit(
        assemble.transform(_with_statistics(fit, by_host, by_file)).select("features", "label").coalesce(4)
    )
    scored = trees.transform(assemble.transform(_with_statistics(lexical(base), by_host, by_file)))
    score = F.when(F.col("rule").isNull(), vector_to_array("probability")[1])
    judged = F.coalesce("ruled", F.when(score >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", judged.alias("verdict"), score.alias("block_score"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
