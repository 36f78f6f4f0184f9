"""Helpers shared by the operators: input shape, Arrow columns, shared folder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.session import cut_lineage, scratch_folder

__all__ = ["cut_lineage", "narrow", "row_type", "slices", "texts", "strings", "sha256_hex", "shared_folder", "written", "crc_fold"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool | list[str] = False,
           once: bool = False, **more: str) -> DataFrame:
    """``(doc_id, text, ...)`` and nothing else: a null text becomes empty, other
    columns of the input never reach an operator.  With ``carry`` the whole
    input row, or the columns that it lists, goes along as the struct ``row``, where no name can clash.
    A text that is carried, too, is held twice, unless ``once``: then it is only in the ``row`` (``inside``)."""
    along = docs.columns if carry is True else carry or []
    text = [] if once and carry is True else [F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    return docs.select(F.col(id_col).alias("doc_id"), *text,
                       *[F.col(c).alias(n) for n, c in more.items()],
                       *([F.struct(*[F.col(f"`{c}`") for c in along]).alias("row")] if carry else []))


def row_type(source: DataFrame) -> str:
    """``, row struct<...>`` for a schema string, if the input row is carried."""
    return f", row {source.schema['row'].dataType.simpleString()}" if "row" in source.columns else ""


def text_column(batch: pa.RecordBatch, column: str = "text", inside: bool = False) -> pa.Array:
    return batch.column(batch.schema.get_field_index("row")).field(column) if inside \
        else batch.column(batch.schema.get_field_index(column))


def texts(batch: pa.RecordBatch, column: str = "text", inside: bool = False) -> list[bytes]:
    """The column as UTF-8 bytes, one object per row (null: empty)."""
    col = text_column(batch, column, inside)
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [x or b"" for x in col.cast(kind).to_pylist()]


def slices(batch: pa.RecordBatch, column: str = "text", inside: bool = False, rows: int = 500,
           size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``rows`` rows and about ``size`` bytes of text: what Python objects a part needs does
    not depend on how the rows were batched.  (A longer text is a part by itself.)"""
    lengths = pc.fill_null(pc.binary_length(text_column(batch, column, inside)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for k, n in enumerate(lengths.tolist()):
        if k > start and (k - start >= rows or held + n > size):
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def strings(batch: pa.RecordBatch, column: str = "text", inside: bool = False) -> list[str]:
    return [x or "" for x in text_column(batch, column, inside).to_pylist()]


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below ``spark.checkpoint.dir`` (shared by all executors), removed when the driver ends."""
    return scratch_folder(spark, what)


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows, written to the shared folder and read back: the planner knows their size."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5 (a null id falls in fold 1)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5, F.lit(1))
