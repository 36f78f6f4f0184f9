"""Sinks (SNK1-SNK3): append raw or cleaned rows as headerless CSV, and
full exports as Parquet (partitioned by company) or CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinio.session import scratch_folder


def _csv_safe(df: DataFrame) -> DataFrame:
    """CSV cannot hold arrays: lists are written in their text form."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(f.name).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


#: Values are written as they are: by default the CSV writer strips white space at both ends.
_EXACT = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


#: UTF-8 with a byte order mark, as spreadsheet programs expect it.
BYTE_ORDER_MARK = "\ufeff"


def append_csv(df: DataFrame, path: str, header: bool = False, mark: bool = False) -> None:
    """SNK1/SNK2: append, no header line (each run adds files).  With ``mark`` every file starts with a
    byte order mark (and has no header): the lines are made by the same CSV rules and written as text."""
    safe = _csv_safe(df)
    if not mark:
        safe.write.mode("append").option("header", header).options(**_EXACT).csv(path)
        return
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in _EXACT.items()}
    line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in safe.columns]), options)
    # a task writes one file; its first row has the number 0 in its partition
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    safe.select(F.concat(F.when(first, F.lit(BYTE_ORDER_MARK)).otherwise(F.lit("")), line).alias("value")).write.mode("append").text(path)


def export_csv(df: DataFrame, path: str) -> None:
    """SNK3: full overwrite export with a header."""
    _csv_safe(df).write.mode("overwrite").option("header", True).options(**_EXACT).csv(path)


def export_parquet(df: DataFrame, path: str, partition_by: str | None = "Company") -> None:
    """SNK3 (primary): Parquet, partitioned so later reads prune by company."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def written(df: DataFrame, what: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows, written once below the shared folder and read back (with ``schema``, if the reader is to see other types)."""
    spark = df.sparkSession
    path = scratch_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)
