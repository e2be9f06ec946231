"""URL filters: host and path rules, and gradient-boosted trees on lexical features where no rule fits."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslake.llm.common import ascii_lower
from presslake.session import staged


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


RULES = [
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
]
#: Labelled addresses used to fit at most for each verdict, those with the smallest hash.
SAMPLE = 10_000
ROUNDS, DEPTH, SEED = 20, 4, 7

FEATURES = ["url_length", "host_length", "path_length", "path_depth", "host_labels", "digit_share", "entropy", "parameters", "hyphens", "secure",
            "suffix_log_count", "suffix_paths", "segment_log_count"]


def address(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty for null and where there is no `://`."""
    whole = F.coalesce(url, F.lit(""))
    at = F.locate("://", whole)
    rest = F.when(at > 0, F.substring(whole, at + 3, F.greatest(F.length(whole) - at - 2, F.lit(0)))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules: list[UrlRule] = RULES) -> Column:
    """The longest rule that fits, as struct (rule, verdict), or null. A rule fits its host, all subdomains, and paths that start with its own."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _entropy(text: Column) -> Column:
    """Bits per character, from counts of the distinct characters."""
    n = F.length(text)
    letters = F.array_distinct(F.split(text, ""))
    counts = F.transform(F.filter(letters, lambda c: c != ""), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(counts, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(F.lit(0.0))


def lexical(pages: DataFrame) -> DataFrame:
    """`pages` ids with host, path, rule and the features of FEATURES, each from the address alone or from counts over all rows.

    Suffix statistics are the rows of a host suffix (last label) and its distinct first path segments, and the rows of the
    first path segment under the suffix.
    """
    host, path = address(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("segment", F.regexp_extract("path", r"(?s)\A/([^/]*)", 1))
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    rows = rows.select(
        "*", F.length(url).cast("double").alias("url_length"), F.length("host").cast("double").alias("host_length"), F.length("path").cast("double").alias("path_length"),
        F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double").alias("path_depth"),
        F.size(F.split("host", r"\.")).cast("double").alias("host_labels"),
        (F.length(F.regexp_replace(url, "[^0-9]+", "")) / n).alias("digit_share"), _entropy(url).alias("entropy"),
        F.size(F.filter(F.split(F.regexp_extract(url, r"(?s)\A[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")).cast("double").alias("parameters"),
        (F.length(url) - F.length(F.replace(url, F.lit("-"), F.lit("")))).cast("double").alias("hyphens"),
        url.startswith("https://").cast("double").alias("secure"))
    rows = staged(rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"))))
    pairs = rows.groupBy("suffix", "segment").agg(F.count(F.lit(1)).alias("n"))
    by_suffix = pairs.groupBy("suffix").agg(F.log1p(F.sum("n")).alias("suffix_log_count"), F.log1p(F.count(F.lit(1))).alias("suffix_paths"))
    # A suffix may hold most rows: counts are summed before the shuffle, and the look-up is by (suffix, segment).
    counts = staged(pairs.join(by_suffix, "suffix").select("suffix", "segment", F.log1p("n").alias("segment_log_count"), "suffix_log_count", "suffix_paths"))
    return rows.join(counts, ["suffix", "segment"])


def _sampled(labelled: DataFrame, sample: int) -> DataFrame:
    """At most `sample` rows of each verdict, those with the smallest hash of the address; equal addresses count once."""
    keyed = labelled.dropDuplicates(["url"]).withColumn("_key", F.xxhash64("url"))
    parts = [keyed.where(F.col("label") == value).orderBy("_key", "url").limit(sample) for value in (0.0, 1.0)]
    return parts[0].unionAll(parts[1]).drop("_key")


def train(labelled: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, depth: int = DEPTH, seed: int = SEED) -> PipelineModel | float:
    """Boosted trees on FEATURES for `label` (1 is block), fitted on at most `sample` addresses of each label.

    With labels of one kind only, that label stands for the model; without any, it is 0 (allow).
    """
    rows = staged(_sampled(labelled, sample).select("label", *FEATURES).repartition(1))
    kinds = [r["label"] for r in rows.select("label").distinct().collect()]
    if len(kinds) < 2:
        return kinds[0] if kinds else 0.0
    from pyspark.ml import Pipeline

    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, seed=seed, stepSize=0.3)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), trees]).fit(rows)


def judge(pages: DataFrame, rules: list[UrlRule] = RULES, labels: DataFrame | None = None, **settings) -> DataFrame:
    """Per row: page_id, host, path, rule (or null), verdict, block_probability.

    The verdict is that of the longest fitting rule; other addresses get that of the trees, which learn from the addresses that a
    rule labels, or from `labels` (url, verdict) if given. Null and malformed addresses have empty host and path, fit
    no rule and go to the trees. Repeated rows are judged alike. Empty input gives an empty result. Only page_id
    and url are read.
    """
    rows = lexical(pages)
    if rules is not RULES:
        rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    if labels is None:
        labelled = rows.where("_rule is not null").withColumn("label", (F.col("_rule.verdict") == "block").cast("double"))
    else:
        told = labels.where("url is not null").groupBy("url").agg(F.max((F.col("verdict") == "block").cast("double")).alias("label"))
        labelled = rows.join(told, "url")
    model = train(labelled, **settings)
    if isinstance(model, float):
        scored = rows.withColumn("block_probability", F.lit(model))
    else:
        scored = model.transform(rows).withColumn("block_probability", vector_to_array("probability")[1])
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("block_probability") > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "block_probability")
