"""URL filter: host/path rules, and gradient-boosted trees for the rest.

URLs on which a rule fits are labelled by it; they train boosted trees on
lexical features (lengths, depth, digit ratio, entropy, parameter counts and
block rates of host suffixes), which judge the URLs that no rule fits.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end.  A rule fits its
host and all subdomains if the path starts with the rule's; the longest wins.

Defined cases: a null URL or one without ``://`` has an empty host and path and
is judged by the trees; a very long URL is judged whole; repeated rows are judged alike; among rules of one length the longer host
wins, then the larger text; a probability of exactly one half blocks; if the rules label no
URL, or all alike, there is nothing to learn: the rest gets that one verdict,
or ``allow``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: The trees are fitted on at most so many distinct labelled URLs (those with the smallest hash), weighted by their rows.
MAX_TRAIN = 20_000
FEATURES = ("f_length", "f_host_length", "f_path_length", "f_labels", "f_depth", "f_digits", "f_hyphens",
            "f_params", "f_query_length", "f_fragment", "f_extension", "f_secure", "f_entropy",
            "f_suffix1", "f_suffix2")


def split_url(urls: DataFrame) -> DataFrame:
    """Adds ``host`` and ``path``."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.col("url").substr(at + 3, F.length("url"))).otherwise("")
    host = F.regexp_extract("rest", r"^[^/?#]*", 0)
    path = F.regexp_extract(F.col("rest").substr(F.length("raw_host") + 1, F.length("rest")), r"^[^?#]*", 0)
    return (urls.withColumn("rest", F.coalesce(rest, F.lit(""))).withColumn("raw_host", host)
            .withColumn("path", path).withColumn("host", F.translate("raw_host", UPPER, UPPER.lower()))
            .drop("rest", "raw_host"))


def rule_for(rules) -> Column:
    """The fitting rule that wins: struct ``rule, verdict`` (null if none fits).  The list is a literal of the plan."""
    fits = [F.when(((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p),
                   F.struct(F.lit(len(h + p)).alias("size"), F.lit(len(h)).alias("host_size"),
                            F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.array_max(F.array_compact(F.array(*fits)))


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features that need the URL alone, and the host suffixes."""
    url, query = F.coalesce("url", F.lit("")), F.regexp_extract(F.coalesce("url", F.lit("")), r"\?([^#]*)", 1)

    def count(text, chars):
        return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")

    chars = F.split(url, "")
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    entropy = F.aggregate(
        F.transform(F.array_distinct("chars"), lambda c: F.size(F.filter("chars", lambda x: x == c)) / n),
        F.lit(0.0), lambda s, p: s - p * F.log2(p))
    labels = F.split("host", r"\.")
    return (urls.withColumn("chars", F.filter(chars, lambda c: c != ""))
            .withColumn("f_length", F.length(url).cast("double"))
            .withColumn("f_host_length", F.length("host").cast("double"))
            .withColumn("f_path_length", F.length("path").cast("double"))
            .withColumn("f_labels", F.size(labels).cast("double"))
            .withColumn("f_depth", count("path", "/"))
            .withColumn("f_digits", count(url, "0123456789") / n)
            .withColumn("f_hyphens", count("host", "-"))
            .withColumn("f_params", F.when(query != "", count(query, "&") + 1).otherwise(0.0))
            .withColumn("f_query_length", F.length(query).cast("double"))
            .withColumn("f_fragment", F.instr(url, "#").cast("boolean").cast("double"))
            .withColumn("f_extension", F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"))
            .withColumn("f_secure", url.startswith("https://").cast("double"))
            .withColumn("f_entropy", entropy)
            .withColumn("s1", F.substring_index("host", ".", -1))
            .withColumn("s2", F.substring_index("host", ".", -2))
            .drop("chars"))


def _with_rates(urls: DataFrame, labelled: DataFrame) -> DataFrame:
    """Block rates of the last one and two host labels, over all labelled URLs, smoothed to one half."""
    for k in ("1", "2"):
        rates = (labelled.groupBy(F.col(f"s{k}").alias(f"of{k}"))
                 .agg(((F.sum("label") + 0.5) / (F.count("*") + 1.0)).alias(f"f_suffix{k}")))
        urls = urls.join(rates, F.col(f"s{k}") == F.col(f"of{k}"), "left").drop(f"of{k}") \
                   .withColumn(f"f_suffix{k}", F.coalesce(f"f_suffix{k}", F.lit(0.5)))
    return urls


def judge(urls: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
          max_train: int = MAX_TRAIN, trees: int = 20, depth: int = 4, seed: int = 7) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_probability`` (null where a rule decides)."""
    rows = split_url(urls.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")))
    won = rule_for(rules)
    rows = lexical(rows.withColumn("won", won)).withColumn("rule", F.col("won.rule"))
    rows = rows.withColumn("label", F.when(F.col("won.verdict") == "block", 1.0)
                           .when(F.col("won.verdict") == "allow", 0.0)).drop("won")
    labelled = rows.where(F.col("label").isNotNull())
    ready = _with_rates(rows, labelled)
    # label and features follow from the URL, so any row stands for its copies
    sample = (ready.where(F.col("label").isNotNull()).groupBy("url")
              .agg(F.count("*").cast("double").alias("weight"), *[F.first(c).alias(c) for c in ("label", *FEATURES)])
              .orderBy(F.xxhash64("url"), "url").limit(max_train))
    classes = sorted(r[0] for r in labelled.select("label").distinct().collect())
    if len(classes) < 2:
        block = F.lit(float(classes[0]) if classes else 0.0)
    else:
        fold = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        model = GBTClassifier(labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, seed=seed).fit(fold.transform(sample))
        ready = model.transform(fold.transform(ready))
        block = vector_to_array("probability")[1]
    verdict = F.when(F.coalesce("label", F.col("p")) >= 0.5, "block").otherwise("allow")
    return (ready.withColumn("p", F.when(F.col("label").isNull(), block))
            .select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("p").alias("block_probability")))
