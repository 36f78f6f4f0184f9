"""File sources: the crawl config CSV (SRC1) and raw review CSV files
with encoding detection (SRC2)."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.schemas import CONFIG_SCHEMA, REVIEWS_RAW_SCHEMA


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: config table with a header line, quoted fields that contain
    commas, CRLF line ends; columns addressed by name, not position."""
    return (spark.read.schema(CONFIG_SCHEMA).option("header", True).option("quote", '"')
            .option("escape", '"').csv(path))


def detect_encodings(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """SRC2, per file: 'UTF-8' when every line of the file is valid UTF-8, else
    'ISO-8859-1' (which decodes any byte, so later candidates are never
    needed).  One distributed pass; one row per file comes back."""
    rows = (spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file"))
            .agg(F.bool_and(F.is_valid_utf8("value")).alias("ok")).collect())
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault("UTF-8" if r["ok"] else "ISO-8859-1", []).append(unquote(r["file"]))
    return out


def read_reviews_csv(spark: SparkSession, path: str, header: bool = True, encoding: str | None = None) -> DataFrame:
    """Raw review rows (all text), each file in its own encoding unless one is
    given; a byte order mark is skipped.  ``multiLine`` because review bodies
    hold newlines inside quotes; such files are read one task per file, so
    large exports should be written as many files."""
    def read(paths, enc: str) -> DataFrame:
        return (spark.read.schema(REVIEWS_RAW_SCHEMA).option("header", header).option("multiLine", True)
                .option("quote", '"').option("escape", '"').option("encoding", enc).csv(paths))
    if encoding:
        return read(path, encoding)
    out = None
    for enc, files in sorted(detect_encodings(spark, path).items()):
        part = read(files, enc)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else read(path, "UTF-8")
