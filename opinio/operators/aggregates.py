"""Chart aggregates (AGG1-AGG19) over the enriched review table.

All are group-bys with map-side partial aggregation, so a hot key (one
company or model holding a third of all reviews) reduces to one row per
task before the shuffle.  Global results that need a window "over all
rows" are computed on the already-aggregated (small) result, never on the
review rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinio import resources as R
from opinio.schemas import FEATURE_COLUMNS

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns selected by dtype, in schema order (the select-by-dtype step)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def count_by(df: DataFrame, *cols: str, name: str = "count") -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(name))


def rating_histogram(df: DataFrame) -> DataFrame:                      # AGG1
    return count_by(df, "Review_Rating")


def reviews_per_model(df: DataFrame) -> DataFrame:                     # AGG2
    return count_by(df, "Company", "Short_Model_Name", name="Review_Count")


def reviews_pivot(df: DataFrame, companies: list[str]) -> DataFrame:    # AGG3
    """Rows model, one column per company (null where the pair is absent).
    The company list is passed, which saves a distinct-values job and
    fixes the output schema."""
    return (df.groupBy("Short_Model_Name").pivot("Company", companies)
            .agg(F.count(F.lit(1))))


def model_global_ratings(df: DataFrame) -> DataFrame:                  # AGG4, AGG19
    return (df.groupBy("Model")
            .agg(F.max("Overall_product_rating_count").cast("long").alias("Amazon_Global_ratings"))
            .withColumn("Short_Model", F.substring("Model", 1, R.SHORT_MODEL_CHARS))
            .orderBy(F.desc("Amazon_Global_ratings"), F.asc("Model")))


def feature_means_by_company(df: DataFrame) -> DataFrame:              # AGG5
    return df.groupBy("Company").agg(*[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in FEATURE_COLUMNS])


def helpful_mean_by_model(df: DataFrame) -> DataFrame:                 # AGG6
    return df.groupBy("Model").agg(F.round(F.avg("Review_helpful_rating"), 6).alias("avg_helpful"))


def emoticons_by_model(df: DataFrame, text: str = "text_en") -> DataFrame:   # AGG7
    from opinio.functions.text import emoticon_run_count
    return (df.groupBy("Model").agg(F.sum(emoticon_run_count(text)).cast("long").alias("Emoticon_Count"))
            .withColumn("Short_Model", F.substring("Model", 1, 20)))


def rating_by_company(df: DataFrame) -> DataFrame:                     # AGG8
    return count_by(df, "Company", "Review_Rating").orderBy(F.asc("Company"), F.desc("Review_Rating"))


def class_company_polarity(df: DataFrame) -> DataFrame:                # AGG9-11 in one pass
    """Counts at three granularities: by class, by company and class, by polarity.  One pass over the reviews: grouping sets expand a row
    to three and are counted together, with partial counts before the shuffle.  ``level`` names the granularity; columns that
    are not part of it are null."""
    sets = [["classification"], ["Company", "classification"], ["Polarity"]]
    cols = ["Company", "classification", "Polarity"]
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(
        F.grouping_id(*cols).alias("_without"), F.count(F.lit(1)).alias("count"))
    level = F.create_map(*[F.lit(x) for pair in ((5, "class"), (1, "company and class"), (6, "polarity")) for x in pair])
    return out.select(level[F.col("_without").cast("int")].alias("level"), *cols, "count")


def class_totals(df: DataFrame) -> DataFrame:                          # AGG9
    return df.agg(F.count_if(F.col("classification") == R.PRODUCT_LABEL).alias("product_reviews"),
                  F.count_if(F.col("classification") == R.SERVICE_LABEL).alias("service_reviews"))


def class_by_company(df: DataFrame) -> DataFrame:                      # AGG10
    return count_by(df, "Company", "classification")


def polarity_share(df: DataFrame) -> DataFrame:                        # AGG11
    counts = count_by(df, "Polarity")
    # the window runs over the (at most 3) label rows, not over reviews
    return (counts.withColumn("pct", F.round(F.lit(100.0) * F.col("count") / F.sum("count").over(Window.partitionBy()), 6))
            .orderBy(F.desc("count")))


def equal_width_histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:   # AGG12
    """``bins`` equal-width bins between min and max, last bin closed; empty
    bins reported with 0.

    One pass over ``df``: equal values are counted first (partial counts before
    the shuffle); their bounds are a scalar subquery over the same counts."""
    values = (df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull())
              .groupBy("x").agg(F.count(F.lit(1)).alias("n")))
    bounds = values.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("b")).scalar()
    placed = values.withColumn("b", bounds)
    width = F.col("b.hi") - F.col("b.lo")
    at = F.when(width == 0, 0).otherwise(
        F.least(F.floor(F.try_divide(F.col("x") - F.col("b.lo"), width) * bins), F.lit(bins - 1))).cast("int")
    counted = placed.select(at.alias("bin"), "n").groupBy("bin").agg(F.sum("n").alias("count"))
    all_bins = (df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("b", bounds)
                .withColumn("lo", F.coalesce("b.lo", F.lit(0.0))).withColumn("hi", F.coalesce("b.hi", F.lit(0.0))))

    def edge(k):
        return F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * k / bins, 6)

    return (all_bins.join(counted, "bin", "left")
            .select("bin", edge(F.col("bin")).alias("lower"), edge(F.col("bin") + 1).alias("upper"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def score_by_rating(df: DataFrame) -> DataFrame:                       # AGG13
    return df.groupBy("Review_Rating").agg(F.round(F.avg("Sentiment_Score"), 6).alias("avg_sentiment"))


def polarity_share_by_model(df: DataFrame) -> DataFrame:               # AGG14
    labels = sorted(R.POLARITY_ORDER)
    p = df.groupBy("Short_Model_Name").pivot("Polarity", labels).agg(F.count(F.lit(1))).na.fill(0, labels)
    total = sum((F.col(c) for c in labels[1:]), F.col(labels[0]))
    return p.select("Short_Model_Name", *[F.round(F.col(c) / total, 6).alias(c) for c in labels])


def polarity_by_class(df: DataFrame, by_model: bool = False) -> DataFrame:  # AGG15, AGG16
    """Counts in the fixed order Positive / Neutral / Negative for each
    class (and model), with zero rows for absent combinations: the 6
    (class, polarity) cells are conditional counts of one aggregate, then
    turned into rows."""
    keys = ["Model"] if by_model else []
    cells = [(c, p, i) for c in (R.PRODUCT_LABEL, R.SERVICE_LABEL) for i, p in enumerate(R.POLARITY_ORDER)]
    wide = df.groupBy(*keys).agg(*[
        F.count_if((F.col("classification") == c) & (F.col("Polarity") == p)).alias(f"_{k}")
        for k, (c, p, _) in enumerate(cells)])
    return wide.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(c).alias("classification"), F.lit(p).alias("Polarity"), F.lit(i).alias("polarity_rank"),
                 F.col(f"_{k}").alias("count")) for k, (c, p, i) in enumerate(cells)])))


def service_share_by_model(df: DataFrame) -> DataFrame:                # AGG17
    return (df.groupBy("Model")
            .agg(F.count(F.lit(1)).alias("total_reviews"),
                 F.count_if(F.col("classification") == R.SERVICE_LABEL).alias("service_reviews"))
            .withColumn("product_reviews", F.col("total_reviews") - F.col("service_reviews")))


def correlation_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:   # AGG18
    """Pearson correlation of every pair of numeric columns, long form
    (col_a, col_b, r), in one aggregation pass.  A constant column gives
    null (no division by zero)."""
    cols = cols or numeric_columns(df)
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    aggs = []
    for a, b in itertools.combinations_with_replacement(cols, 2):
        aggs.append(F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)).alias(f"{a}|{b}"))
    row = d.agg(*aggs)
    pairs = []
    for a, b in itertools.combinations_with_replacement(cols, 2):
        pairs.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"`{a}|{b}`").alias("r")))
        if a != b:
            pairs.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), F.col(f"`{a}|{b}`").alias("r")))
    return row.select(F.inline(F.array(*pairs))).withColumn("r", F.round("r", 6))
