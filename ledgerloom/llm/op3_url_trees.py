"""URL filter: allow and block rules, and gradient-boosted trees on lexical features for the rest.

Rules name a host and a path; the longest that fits decides. The urls that a rule decides are the
labelled ones: from a bounded sample of them (`SAMPLE_ROWS` by url hash) boosted trees learn length,
depth, digit ratio, character entropy, parameter counts and statistics of the host's suffix (how
frequent it is among all urls, and how often it was blocked among the labelled). Everything is DataFrame
expressions and Spark's own tree learner.

Cases: a null url or one without `://` has empty host and path, fits no rule and is judged by the
trees; without labelled urls the verdict is allow, with one kind only it is that kind; a score of
exactly 0.5 blocks; of rules that fit, the longest wins, and no two of one length fit one url; repeated
rows get equal verdicts; a very long url is one string like others; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import LOWER, UPPER, cut_lineage, table

#: (rule, verdict); a rule is host, then path from the first slash.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SAMPLE_ROWS = 20_000
TREES, DEPTH = 20, 4
#: Blocked and allowed labels added to each suffix's own.
PRIOR_LABELS = 20.0
FEATURES = (
    "url_length", "host_length", "path_length", "labels", "depth", "digit_ratio", "entropy", "n_params",
    "query_length", "n_dashes", "has_fragment", "suffix_log_count", "suffix_block_rate",
)


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    cut = F.instr(F.col(url), "://")
    rest = F.when(cut > 0, F.substring(F.col(url), cut + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits columns host and path, else null."""
    choices = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, path = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        choices.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*choices)


def entropy(c: Column) -> Column:
    """Bits per character; each distinct character is counted by taking it out."""
    n = F.length(c)
    share = lambda x: (n - F.length(F.replace(c, x, F.lit("")))) / n
    parts = F.transform(F.array_distinct(F.split(c, "")), lambda x: F.when(share(x) > 0, -share(x) * F.log2(share(x))).otherwise(F.lit(0.0)))
    return F.when(n > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)).otherwise(F.lit(0.0))


def lexical(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    host, path = host_and_path()
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    base = pages.select("page_id", "url").withColumns({"host": host, "path": path}).withColumn("fit", longest_rule(rules))
    return base.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruled"), F.xxhash64("url").alias("h"),
        F.substring_index("host", ".", -1).alias("suffix"),
        F.length(url).cast("double").alias("url_length"), F.length("host").cast("double").alias("host_length"), F.length("path").cast("double").alias("path_length"),
        F.size(F.split("host", r"\.")).cast("double").alias("labels"),
        F.regexp_count("path", F.lit("/[^/]")).cast("double").alias("depth"),
        (F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1))).alias("digit_ratio"),
        entropy(url).alias("entropy"),
        F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).cast("double").alias("n_params"),
        F.length(query).cast("double").alias("query_length"), F.regexp_count(url, F.lit("[-_]")).cast("double").alias("n_dashes"),
        F.contains(url, F.lit("#")).cast("double").alias("has_fragment"),
    )


def with_suffixes(rows: DataFrame, suffixes: DataFrame) -> DataFrame:
    joined = rows.join(suffixes, "suffix", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("suffix_log_count", "suffix_block_rate")})


def fit_trees(rows: DataFrame, suffixes: DataFrame, sample: int = SAMPLE_ROWS) -> GBTClassificationModel | str:
    """The trees, or the one verdict that the labelled urls have."""
    labelled = rows.filter("ruled is not null").orderBy("h", "page_id").limit(sample)
    train = cut_lineage(with_suffixes(labelled, suffixes).withColumn("label", (F.col("ruled") == "block").cast("double")).select("label", "h", *FEATURES))
    kinds = sorted(r.label for r in train.select("label").distinct().collect())
    if len(kinds) < 2:
        return "block" if kinds == [1.0] else "allow"
    learner = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7)
    # one partition per few thousand rows; the sample is bounded
    return learner.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(train.repartition(4, "h")))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, sample: int = SAMPLE_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score): the score is the trees' chance of block."""
    rows = lexical(pages, rules)
    suffixes = cut_lineage(
        rows.groupBy("suffix")
        .agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"))
        .select("suffix", F.log1p("n").alias("suffix_log_count"), ((F.col("blocked") + PRIOR_LABELS / 2) / (F.col("labelled") + PRIOR_LABELS)).alias("suffix_block_rate"))
    )
    model = fit_trees(rows, suffixes, sample)
    rows = with_suffixes(rows, suffixes)
    if isinstance(model, str):
        scored = rows.withColumn("block_score", F.lit(1.0 if model == "block" else 0.0))
    else:
        judged = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
        scored = judged.withColumn("block_score", vector_to_array("probability")[1])
    verdict = F.coalesce("ruled", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")


def op3_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
