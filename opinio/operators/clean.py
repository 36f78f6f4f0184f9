"""Review cleaning (CLN1-CLN4, CLN12): text concat, null drop, numeric
parsing, language routing and de-duplication.

The analysed pipeline de-duplicates twice and drops nulls twice, with
row-wise steps (parse, translate) in between.  Because every step between
them is a deterministic row-wise map or filter, ``distinct`` commutes with
them; one de-duplication after the row-wise steps leaves exactly the same
set of rows and costs one shuffle instead of two.

Row identity is the SHA-256 of the length-prefixed cleaned columns
(``review_key``).  De-duplicating on that key lets the partial aggregate
collapse copies inside each map task before the shuffle (a group of copies
holding a third of all rows then costs one row per task), and leaves the
table hash-partitioned by ``review_key``, which later per-review
aggregations (sentiment) reuse without another exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio import resources as R
from opinio.functions.parse import parsed_numbers
from opinio.schemas import NUMERIC_RAW_COLUMNS, RAW_COLUMNS


def title_and_review(title: str = "Review_title", review: str = "Review") -> Column:
    """``str(title) + " " + review``: a null title prints as 'nan', a null
    review makes the whole text null."""
    return F.concat(F.coalesce(F.col(title), F.lit(R.MISSING_TITLE_TEXT)), F.lit(" "), F.col(review))


def row_key(cols: list[str]) -> Column:
    """Collision-safe row identity: SHA-256 over length-prefixed values."""
    parts = []
    for c in cols:
        v = F.col(c).cast("string")
        parts += [F.coalesce(F.length(v).cast("string"), F.lit("-1")), F.lit(":"),
                  F.coalesce(v, F.lit(""))]
    return F.sha2(F.concat(*parts), 256)


def with_text(raw: DataFrame) -> DataFrame:
    return raw.withColumn("text_raw", title_and_review())


def clean_reviews(raw: DataFrame, translate=None, strip_commas_in_votes: bool = False) -> DataFrame:
    """raw (9 text columns) -> cleaned reviews.

    Output: the 9 columns (4 of them parsed to double), ``text_raw``,
    ``text_en`` (translated when ``translate`` is given, else ``text_raw``),
    ``Title_and_Reviews`` (= ``text_en``) and ``review_key``.

    ``translate`` is an optional function DataFrame -> DataFrame that adds
    ``text_en`` (see ``opinio.operators.language``).
    """
    df = with_text(raw.select(*RAW_COLUMNS)).dropna(how="any")
    df = df.withColumns(parsed_numbers(strip_commas_in_votes)).dropna(how="any", subset=NUMERIC_RAW_COLUMNS)
    if translate is None:
        # the texts are functions of (Review_title, Review): they add nothing to identity, and are made again after the
        # shuffle rather than sent through it
        df = df.select(*RAW_COLUMNS, row_key(RAW_COLUMNS).alias("review_key")).dropDuplicates(["review_key"])
        df = with_text(df).select(*RAW_COLUMNS, "text_raw", F.col("text_raw").alias("text_en"), "review_key")
    else:
        df = translate(df).dropna(how="any", subset=["text_en"])
        df = df.withColumn("review_key", row_key(RAW_COLUMNS + ["text_en"])).dropDuplicates(["review_key"])
    return df.withColumn("Title_and_Reviews", F.col("text_en"))


def stage_counts(raw: DataFrame) -> DataFrame:
    """PRF2 across the cleaning stages: raw rows, distinct rows, distinct
    rows without nulls, those whose numbers also parse, and the final clean
    count (after the second de-duplication).

    One lazy plan: only the row keys, two flags and the copies are shuffled."""
    df = with_text(raw.select(*RAW_COLUMNS))
    nums = parsed_numbers()
    complete = F.col("text_raw").isNotNull()
    for c in RAW_COLUMNS:
        complete = complete & F.col(c).isNotNull()
    parsed = complete
    for c in NUMERIC_RAW_COLUMNS:
        parsed = parsed & nums[c].isNotNull()
    df = df.select(row_key(RAW_COLUMNS).alias("_k"), complete.alias("_complete"), parsed.alias("_parsed"),
                   *[nums.get(c, F.col(c)).alias(c) for c in RAW_COLUMNS])
    df = df.select("_k", "_complete", "_parsed", F.when(F.col("_parsed"), row_key(RAW_COLUMNS)).alias("_clean"))
    d = df.groupBy("_k", "_complete", "_parsed", "_clean").agg(F.count(F.lit(1)).alias("_copies"))
    return d.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("raw_rows"), F.count(F.lit(1)).alias("distinct_rows"),
                 F.count_if("_complete").alias("complete_rows"), F.count_if("_parsed").alias("parsed_rows"),
                 F.count_distinct("_clean").alias("clean_rows"))
