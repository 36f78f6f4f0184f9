"""Driver tables (one parquet file or folder per table under ``sf_dir``) and small tables given as literals."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]

#: A literal of more rows is no small table any more: it becomes a table of unknown size, which is never broadcast.
MAX_LITERAL_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; callers select the columns they need so that the
    scan's ReadSchema stays pruned."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table that is part of the plan, the same in every session: one JSON literal, folded into an
    array when the plan is made.  The planner knows that it is small, so joins with it need no exchange.
    (A table made from pandas has NaN for None unless Arrow is switched on, and one made from a list has
    no known size.)  ``schema`` is a DDL string; a missing value is null."""
    rows = [tuple(r) for r in rows]
    if len(rows) > MAX_LITERAL_ROWS:
        return spark.createDataFrame(rows, schema)
    names = [c.split()[0] for c in schema.split(",")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))
