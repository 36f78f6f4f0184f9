"""Incremental ingestion of raw review files (the append-per-run sinks,
SNK1, as a Structured Streaming job).

New raw files dropped into ``source_dir`` are appended, as they arrive, to
a Parquet table; the analysis jobs read that table and de-duplicate at
analysis time exactly as over the append-only CSV.  The checkpoint
location must be on shared storage so a restarted driver resumes where it
stopped (exactly-once file sink).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from opinio.schemas import REVIEWS_RAW_SCHEMA


def ingest_raw_reviews(spark: SparkSession, source_dir: str, table_dir: str, checkpoint_dir: str,
                       fmt: str = "csv", available_now: bool = True):
    reader = spark.readStream.schema(REVIEWS_RAW_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", False).option("multiLine", True).option("escape", '"')
    stream = reader.format(fmt).load(source_dir).withColumn("ingest_file", F.input_file_name())
    writer = (stream.writeStream.format("parquet").option("path", table_dir)
              .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
