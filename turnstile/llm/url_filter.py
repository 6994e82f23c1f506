"""URL filter: host and path rules, and gradient-boosted trees on lexical features for what no rule decides.

A rule fits its host and all subdomains if the URL's path starts with the rule's path; the longest wins. The
trees see lengths, path depth, ratios of digits and punctuation, character entropy, numbers of parameters
and host labels, and statistics of the host's suffix over all URLs (how common it is, and how much of what is
labelled under it is blocked). They are fitted with pyspark.ml on at most `SAMPLE` labelled URLs, those with
the least hash; everything else covers all rows.

Nulls: a NULL URL, or one without "://", has an empty host and path and fits no rule; the trees judge it like
any other. Labels of one class only make that class the verdict of all URLs without a rule, no labels
"allow". Repeated rows get equal answers. Columns of the input named like a result are replaced.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.llm import common as C

#: (action, host, path)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
SAMPLE, TREES, DEPTH = 20_000, 12, 4
#: Labels that a suffix without any is taken to have.
PRIOR = 20.0
FEATURES = """url_length host_length path_length depth labels longest_label digit_ratio host_digit_ratio entropy
host_entropy n_params query_length hyphens fragment https suffix_share suffix_blocked""".split()


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def with_rules(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule (its host and path) and rule_verdict, NULL where no rule fits."""
    host, path = host_and_path(url_col)
    pages = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _entropy(text: str) -> Column:
    """Bits per character."""
    return F.expr(
        f"-aggregate(transform(array_distinct(filter(split({text}, ''), c -> c <> '')), c -> (char_length({text}) - char_length(replace({text}, c, ''))) / char_length({text})), 0D, (a, p) -> a + p * log2(p))"
    )


def features(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """pages (with host, path and label, 1 for block, 0 for allow or NULL) with the columns FEATURES."""
    length = lambda c: F.char_length(c).cast("double")
    digits = lambda c: F.coalesce(1 - F.char_length(F.regexp_replace(c, "[0-9]+", "")) / F.nullif(F.char_length(c), F.lit(0)), F.lit(0.0))
    query = F.regexp_extract("_u", r"^[^?#]*\?([^#]*)", 1)
    p = pages.withColumn("_u", F.coalesce(F.col(url_col), F.lit(""))).withColumn("_q", query)
    p = p.withColumn("_suffix", F.substring_index("host", ".", -1))
    p = p.withColumns(
        {
            "url_length": length("_u"),
            "host_length": length("host"),
            "path_length": length("path"),
            "depth": F.size(F.expr("filter(split(path, '/'), s -> s <> '')")).cast("double"),
            "labels": F.size(F.split("host", r"\.")).cast("double"),
            "longest_label": F.expr("cast(array_max(transform(split(host, '[.]'), s -> char_length(s))) AS double)"),
            "digit_ratio": digits("_u"),
            "host_digit_ratio": digits("host"),
            "entropy": _entropy("_u"),
            "host_entropy": _entropy("host"),
            "n_params": F.size(F.expr("filter(split(_q, '&'), s -> s <> '')")).cast("double"),
            "query_length": length("_q"),
            "hyphens": length("host") - length(F.replace("host", F.lit("-"), F.lit(""))),
            "fragment": F.col("_u").contains("#").cast("double"),
            "https": F.lower("_u").startswith("https:").cast("double"),
        }
    )
    suffixes = p.groupBy("_suffix").agg(F.count("*").alias("_all"), F.count("label").alias("_labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("_blocked"))
    total = suffixes.agg(F.sum("_all").alias("_rows"), (F.coalesce(F.sum("_blocked"), F.lit(0)) / F.nullif(F.sum("_labelled"), F.lit(0))).alias("_rate"))
    suffixes = suffixes.join(F.broadcast(total), F.lit(True)).select(  # one row
        "_suffix",
        (F.col("_all") / F.col("_rows")).alias("suffix_share"),
        F.coalesce((F.col("_blocked") + PRIOR * F.col("_rate")) / (F.col("_labelled") + PRIOR), F.lit(0.5)).alias("suffix_blocked"),
    )
    return p.join(suffixes, "_suffix").drop("_u", "_q", "_suffix")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", label_col: str | None = None) -> DataFrame:
    """(id_col, host, path, rule, verdict, blocked_score) of every row. Labelled URLs are those that a rule
    decides and, of the others, those with a label in label_col (1 for block, 0 for allow, else NULL)."""
    label = F.col(label_col).cast("int") if label_col else F.lit(None).cast("int")
    p = with_rules(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), label.alias("_given")), rules, "_url")
    p = p.withColumn("label", F.when(F.col("rule_verdict") == "block", 1).when(F.col("rule_verdict") == "allow", 0).otherwise(F.col("_given")))
    p = C.store(features(p, "_url").select("_id", "_url", "host", "path", "rule", "rule_verdict", "label", *FEATURES), "url_features")
    sample = p.where("label is not null").orderBy(F.xxhash64("_url"), "_url").limit(SAMPLE)
    sample = C.store(sample.select("label", *FEATURES), "labelled")
    classes = sorted(r.label for r in sample.select("label").distinct().collect())
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    if len(classes) == 2:
        trees = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=6, checkpointInterval=-1)
        model = trees.setPredictionCol("_class").setProbabilityCol("_p").setRawPredictionCol("_raw").fit(assembler.transform(sample))
        p = model.transform(assembler.transform(p)).withColumn("blocked_score", vector_to_array("_p")[1])
    else:
        p = p.withColumn("blocked_score", F.lit(float(classes[0]) if classes else 0.0))
    verdict = F.coalesce("rule_verdict", F.when(F.col("blocked_score") >= 0.5, "block").otherwise("allow"))
    return p.select(F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "blocked_score")
