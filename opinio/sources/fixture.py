"""Raw review rows derived from the ``documents`` table (FIXTURES.md section 2).

The adapter plants nulls, unparseable numbers and exact duplicate rows so
that every cleaning rule has work to do.  It is one narrow scan of
``documents``; the planted copies are produced by ``explode`` instead of a
second scan plus ``union``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.schemas import RAW_COLUMNS
from opinio.sources.tables import table


def _s(c: Column) -> Column:
    return c.cast("string")


def reviews_raw_from_documents(docs: DataFrame, keep_doc_id: bool = False) -> DataFrame:
    sn = F.substring("source", F.lit(4), F.length("source")).cast("int")
    n = F.col("n_chars")
    votes = (F.when(n % 7 == 0, F.lit("0"))
             .when(n % 7 == 1, F.lit("One person found this helpful"))
             .when(n % 53 == 2, F.lit("1,204 people found this helpful"))
             .otherwise(F.concat(_s(2 + n % 50), F.lit(" people found this helpful"))))
    base = docs.select(
        "doc_id",
        F.concat(F.lit("Model "), F.col("source"), F.lit(" (Fixture Blue, 8GB RAM, 128GB)")).alias("Model"),
        F.concat(F.lit("Company"), _s(sn % 5)).alias("Company"),
        F.concat(_s(3 + sn % 2), F.lit("."), _s(sn % 10), F.lit(" out of 5")).alias("Overall_product_rating"),
        F.concat(_s(1 + sn), F.lit(","), F.lpad(_s((sn * 37) % 1000), 3, "0"),
                 F.lit(" global ratings")).alias("Overall_product_rating_count"),
        F.when(n % 97 == 0, F.lit(None).cast("string"))
         .otherwise(F.substring("text", 1, 24)).alias("Review_title"),
        F.when(n % 211 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("user"), _s(n % 100))).alias("Reviewer_name"),
        F.concat(_s(1 + n % 5), F.lit(".0 out of 5 stars")).alias("Review_Rating"),
        F.when(n % 37 == 0, F.lit(None).cast("string")).otherwise(F.col("text")).alias("Review"),
        votes.alias("Review_helpful_rating"),
    )
    # rows with doc_id % 50 = 0 appear twice (the adapter's planted copies)
    copies = F.when(F.col("doc_id") % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    out = base.withColumn("_copy", F.explode(copies)).drop("_copy")
    cols = (["doc_id"] if keep_doc_id else []) + RAW_COLUMNS
    return out.select(*cols)


def reviews_raw(spark: SparkSession, sf_dir: str, keep_doc_id: bool = False) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    return reviews_raw_from_documents(docs, keep_doc_id)
