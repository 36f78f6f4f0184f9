"""Profiling (PRF1-PRF5): null counts, row counts, deterministic sample,
numeric and text summaries.  Summaries are aggregations with map-side partial
aggregation (exact quantiles need further rounds); the output is long form
(one row per column).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.operators.quantiles import long_values, quantiles_from_long


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:   # PRF1
    cols = cols or df.columns
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in cols])))


def sample_rows(df: DataFrame, n: int = 50, seed: int | None = None, key=None) -> DataFrame:   # PRF3
    """Exactly ``n`` rows.  With ``seed`` a random choice (``rand(seed)``);
    otherwise deterministic by the hash ``key`` (default: md5 of the text).
    Either way it is a top-n, so each task keeps only n rows."""
    order = F.rand(seed) if seed is not None else (key if key is not None else F.md5("Title_and_Reviews"))
    return df.orderBy(order).limit(n)


def describe_numeric(df: DataFrame, cols: list[str]) -> DataFrame:            # PRF4
    """count, mean, sample std, min, 25/50/75 % (interpolated, exact), max.
    The plan behind ``df`` runs once: its values go to a narrow long table
    (checkpointed) that both the summary and the quantile rounds read."""
    spark = df.sparkSession
    vals = long_values(df, cols)
    q = quantiles_from_long(vals, cols, [0.25, 0.5, 0.75])
    qdf = spark.createDataFrame([(c, q[f"{c}|q0.25"], q[f"{c}|q0.5"], q[f"{c}|q0.75"]) for c in cols],
                                "c string, q25 double, q50 double, q75 double")
    basic = vals.groupBy("c").agg(F.count(F.lit(1)).alias("count"), F.avg("x").alias("mean"),
                                  F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    names = spark.createDataFrame([(c,) for c in cols], "c string")   # columns with no values still listed
    return (names.join(basic, "c", "left").join(F.broadcast(qdf), "c", "left")
            .select(F.col("c").alias("column_name"), F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                    F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min",
                    F.round("q25", 6).alias("q25"), F.round("q50", 6).alias("q50"),
                    F.round("q75", 6).alias("q75"), "max"))


def describe_text(df: DataFrame, cols: list[str]) -> DataFrame:               # PRF5
    """count, distinct, most frequent value (ties: smallest) and its count.

    One pass: every (column, value) is counted together, with partial counts
    before the shuffle.  A column without values has count 0 and no top."""
    values = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in cols])))
    # a null value keeps its column in the result but counts nothing
    counts = values.groupBy("column_name", "v").agg(F.count("v").alias("freq"))
    return (counts.groupBy("column_name")
            .agg(F.sum("freq").alias("count"), F.count("v").alias("unique"),
                 F.min_by("v", F.when(F.col("v").isNotNull(), F.struct(-F.col("freq"), F.col("v")))).alias("top"),
                 F.when(F.count("v") > 0, F.max("freq")).alias("freq")))
