"""Cleaning across appended runs: batches of raw rows, each row kept once over all batches.

Layout below one folder of shared storage: ``rows/batch=<n>`` holds what batch n added to the cleaned table (each text once),
``seen/batch=<n>`` the keys of these rows.  A batch is cleaned, loses the rows whose key an earlier batch holds (left anti join on
the keys, the only part of earlier batches that is read), and replaces its own two folders.  So a batch that runs
again, after a failure or by hand, leaves the same files and adds nothing; batches run in the order of their numbers.
The union of the batches is the cleaned table of all raw rows together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from opinio.operators.clean import clean_reviews, title_and_review
from opinio.schemas import REVIEWS_RAW_SCHEMA

_KEYS = "review_key binary, batch long"
_DERIVED = ("text_raw", "Title_and_Reviews")                  # made again from the other columns when the table is read


def seen_keys(spark: SparkSession, folder: str, before: int) -> DataFrame:
    """Keys of the batches with smaller numbers."""
    keys = spark.read.schema(_KEYS).parquet(f"{folder}/seen")
    return keys.where(F.col("batch") < before).select("review_key")


def append_batch(raw: DataFrame, folder: str, batch: int, clean=clean_reviews) -> None:
    """Clean the raw rows of batch number ``batch`` and add those that no earlier batch holds."""
    spark, folder = raw.sparkSession, folder.rstrip("/")
    # an empty start, so that there is a folder to read from
    spark.createDataFrame([], "review_key binary").write.mode("overwrite").parquet(f"{folder}/seen/batch=-1")
    rows = clean(raw)
    # the rows are dealt by their key already; only the seen keys are turned, so that the rows are not dealt again
    seen = seen_keys(spark, folder, batch).select(F.lower(F.hex("review_key")).alias("review_key"))
    fresh = rows.join(seen, "review_key", "left_anti").select(*rows.columns).drop(*_DERIVED)
    fresh = fresh.withColumn("text_en", F.when(F.col("text_en") != title_and_review(), F.col("text_en")))   # null: not translated
    fresh.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")
    added = spark.read.schema(fresh.schema).parquet(f"{folder}/rows/batch={batch}")
    added.select(F.unhex("review_key").alias("review_key")).write.mode("overwrite").parquet(f"{folder}/seen/batch={batch}")


def cleaned_table(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The cleaned rows of all batches, with the columns of ``schema``.  A text is stored once: the texts made from title and
    review, and a translation equal to them, are made again here."""
    held = T.StructType([f for f in schema.fields if f.name not in _DERIVED])
    df = spark.read.schema(held).parquet(f"{folder.rstrip('/')}/rows").drop("batch")
    df = df.withColumn("text_raw", title_and_review())
    df = df.withColumn("text_en", F.coalesce("text_en", "text_raw")).withColumn("Title_and_Reviews", F.col("text_en"))
    return df.select(*schema.names)


def ingest_cleaned(spark: SparkSession, source_dir: str, folder: str, checkpoint_dir: str, fmt: str = "csv") -> StreamingQuery:
    """The same as a stream: new raw files become batches as they arrive.  A batch that is replayed after a failure has the same
    number and the same files, so nothing is added twice."""
    reader = spark.readStream.schema(REVIEWS_RAW_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", False).option("multiLine", True).option("escape", '"')
    return (reader.format(fmt).load(source_dir).writeStream.foreachBatch(lambda df, n: append_batch(df, folder, n))
            .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
