"""URL filter: rules first, boosted trees over lexical features for the rest. DataFrame functions only.

A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the rule's; the longest
fitting rule decides. The trees learn from labelled urls (by default those that rules decide): length, depth, digit share,
character entropy, parameters, and statistics of the host's suffix and domain and of the path's first part: how many urls and
hosts of the whole table have them. Those come from the urls alone, so no label reaches a feature. Training takes at most MAX_LABELLED urls (the first
by hash); all are scored.

Defined cases: a url that is null or has no "://" has an empty host and path, and no rule; with labels of one class only the
verdict is that class, with none it is allow; repeated rows get equal verdicts; an empty table gives an empty result; columns
beside the key and the url are not read. At most MAX_RULES rules travel with the plan, more are an error.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from stepweave.llm.hot import with_group
from stepweave.llm.sampling import bounded_sample
from stepweave.session import cut

MAX_LABELLED, MAX_RULES = 20_000, 1_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
FEATURES = ("length", "host_length", "depth", "labels", "digits", "hyphens", "entropy", "params", "query_length", "fragment", "suffix_urls", "suffix_hosts", "domain_urls", "domain_hosts", "part_urls", "part_hosts")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # longer ones take precedence
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def _entropy(text: Column) -> Column:
    chars = F.split(text, "")
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars))
    return F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path, ...) with its lexical features, the host's suffix and domain, and the path's first part."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return urls.withColumns({
        "length": F.length(url).cast("double"),
        "host_length": F.length("host").cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda p: p != "")).cast("double"),
        "labels": F.size(F.split("host", r"\.")).cast("double"),
        "digits": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)),
        "hyphens": F.length(F.regexp_replace("host", "[^-]", "")).cast("double"),
        "entropy": _entropy(F.col("host")),
        "params": F.size(F.filter(F.split(query, "&"), lambda p: p != "")).cast("double"),
        "query_length": F.length(query).cast("double"),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "suffix": F.element_at(F.split("host", r"\."), -1),
        "part": F.regexp_extract("path", "^/([^/]*)", 1),
        "domain": F.concat_ws(".", F.slice(F.split("host", r"\."), F.greatest(F.size(F.split("host", r"\.")) - 1, F.lit(1)), F.lit(2))),
    })


def with_statistics(rows: DataFrame, urls: DataFrame) -> DataFrame:
    """``rows`` (suffix, domain, part, ...) with the logarithms of how many of ``urls`` and of their hosts have them."""
    for key in ("suffix", "domain", "part"):
        found = urls.groupBy(key).agg(F.count("*").alias("n"), F.log1p(F.count("*")).alias(f"{key}_urls"), F.log1p(F.approx_count_distinct("host")).alias(f"{key}_hosts"))
        rows = with_group(rows, found, [key], "n").drop("n").na.fill(0.0, [f"{key}_urls", f"{key}_hosts"])
    return rows


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url", labelled: DataFrame | None = None) -> DataFrame:
    """(key, host, path, rule, verdict, score), a row for each row; score is the trees' probability of block.

    ``labelled``: (url, y) with y 1 for block; without it, the urls that rules decide.
    """
    parts = lambda df, u: df.withColumn("host", host_of(F.col(u))).withColumn("path", path_of(F.col(u)))
    plain = lexical(parts(pages.select(F.col(key).alias("key"), F.col(url).alias("url")), "url")).withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        known = plain.filter("hit IS NOT NULL").withColumn("y", (F.col("hit.verdict") == "block").cast("double"))
    else:
        known = lexical(parts(labelled.select("url", F.col("y").cast("double").alias("y")), "url")).filter("y IS NOT NULL")
    seen = known.agg(F.coalesce(F.avg("y"), F.lit(0.0)).alias("mean")).first()
    if seen["mean"] in (0.0, 1.0):
        scored = plain.withColumn("score", F.lit(float(seen["mean"])))
    else:
        gather = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
        sample = cut(bounded_sample(known, ["url"], MAX_LABELLED).select("y", "suffix", "domain", "part", *(f for f in FEATURES if not f.startswith(("suffix_", "domain_", "part_")))))
        sample = cut(with_statistics(sample, plain))  # every boosting step reads it again
        model = GBTClassifier(labelCol="y", featuresCol="features", maxIter=20, maxDepth=3, stepSize=0.2, seed=11).fit(gather.transform(sample).select("features", "y"))
        scored = model.transform(gather.transform(with_statistics(plain, plain))).withColumn("score", vector_to_array("probability")[1])
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(F.col("key").alias(key), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", method).alias("verdict"), "score")
