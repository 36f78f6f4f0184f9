"""n-gram counts and rankings (NGR1-NGR9).

Counting is the classic distributed word count: ``explode`` the n-grams of
each review, then ``groupBy(ngram).count()``.  For single words the partial aggregate
combines map-side, so frequent ones (Zipf head) cross the shuffle once
per task.  Longer n-grams hardly repeat in a task; they are dealt to a number
of partitions that grows with the input, so that a task's share does not.  Top-n is ``orderBy(...).limit(n)`` (per-task top-n, then a merge
of n x tasks rows).  Per-group top-k uses a ``row_number`` filter, which
Spark plans as a partial window-group limit before the shuffle, so a hot
group sends at most k rows per task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinio.functions.text import ngrams, without_words, word_tokens
from opinio.session import input_bytes

#: a partition of n-grams per 4 MB of stored input
PARTS_PER_MB = 1 / 4


def ngram_column(text: Column, n: int, stop_words: list[str]) -> Column:
    """Tokens (lower case, >= 2 word chars), stop words removed *before*
    forming n-grams (so n-grams bridge removed words)."""
    return ngrams(without_words(word_tokens(text), [w.lower() for w in stop_words]), n)


def counting_parts(df: DataFrame) -> int:
    """Partitions for counts whose keys grow with the input: ``PARTS_PER_MB`` of its files, a session's shuffle partitions at least."""
    mb = math.ceil(input_bytes(df) / 1e6)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(mb * PARTS_PER_MB))


def ngram_counts(df: DataFrame, text: str, n: int, stop_words: list[str],
                 group_cols: list[str] | tuple = ()) -> DataFrame:
    # Tokens are computed in their own projection: the n-gram lambda then
    # reads the token array instead of re-tokenising the text per n-gram.
    toks = df.select(*group_cols, without_words(word_tokens(F.col(text)),
                                                [w.lower() for w in stop_words]).alias("_tok"))
    grams = toks.select(*group_cols, F.explode(ngrams(F.col("_tok"), n)).alias("ngram"))
    if n > 1:
        # distinct n-grams grow with the input, and so does what a task holds of a fixed number of partitions
        grams = grams.repartition(counting_parts(df), *group_cols, "ngram")
    return grams.groupBy(*group_cols, "ngram").agg(F.count(F.lit(1)).alias("count"))


def top_ngrams(df: DataFrame, text: str, n: int, stop_words: list[str], top: int | None = None) -> DataFrame:
    """``top_n_ngram``: corpus totals, most frequent first; ties by n-gram;
    ``top=None`` returns all."""
    counts = ngram_counts(df, text, n, stop_words)
    ordered = counts.orderBy(F.desc("count"), F.asc("ngram"))
    return ordered.limit(top) if top is not None else ordered


def top_ngrams_per_group(df: DataFrame, text: str, n: int, stop_words: list[str], k: int,
                         group_cols: list[str]) -> DataFrame:
    counts = ngram_counts(df, text, n, stop_words, group_cols)
    w = Window.partitionBy(*group_cols).orderBy(F.desc("count"), F.asc("ngram"))
    return (counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))


def word_frequencies(df: DataFrame, text: str, stop_words: list[str], top: int = 200,
                     group_cols: list[str] | tuple = ()) -> DataFrame:
    """Word-cloud input: word counts, the top ``top`` words (per group),
    weight relative to the most frequent word.  The text is never joined
    into one string; only the ranked top words are windowed."""
    counts = ngram_counts(df, text, 1, stop_words, list(group_cols)).withColumnRenamed("ngram", "word")
    if group_cols:
        w = Window.partitionBy(*group_cols).orderBy(F.desc("count"), F.asc("word"))
        ranked = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
        mx = F.max("count").over(Window.partitionBy(*group_cols))
    else:
        ranked = counts.orderBy(F.desc("count"), F.asc("word")).limit(top)
        ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), F.asc("word"))))
        mx = F.max("count").over(Window.partitionBy())   # over <= top rows only
    return ranked.withColumn("weight", F.round(F.col("count") / mx, 6))


def approx_top_words(df: DataFrame, text: str, stop_words: list[str], k: int = 20) -> DataFrame:
    """NGR9: approximate heavy hitters for very large vocabularies
    (sketch per task, merged; memory bounded by the sketch size)."""
    words = df.select(F.explode(ngram_column(F.col(text), 1, stop_words)).alias("word"))
    return words.agg(F.expr(f"approx_top_k(word, {int(k)})").alias("top")).select(F.inline("top"))


def heavy_word_bound(total: Column, tracked: int) -> Column:
    """Every word that occurs more often than this is found.  A sketch that tracks up to m items keeps 2^j counters, at least m / 0.75;
    its counts are too small by at most 3.5 / 2^j of all words, and it reports what is certainly above that error."""
    counters = 1 << math.ceil(math.log2(tracked / 0.75))
    return F.ceil(total * F.lit(2 * 3.5 / counters)).cast("long")


def heavy_words(df: DataFrame, text: str, stop_words: list[str], tracked: int = 10_000) -> DataFrame:
    """NGR9 with a bound: ``word, count, bound`` of all words that occur more than ``bound`` times, counts exact.

    First pass: mergeable sketches of bounded size name the candidates (at most ``tracked``); second pass: the candidates are
    counted exactly.  Words below the bound are left out, none above it is missed."""
    words = df.select(F.explode(ngram_column(F.col(text), 1, stop_words)).alias("word"))
    candidates = (words.agg(F.expr(f"approx_top_k(word, {int(tracked)}, {int(tracked)})").alias("top"))
                  .select(F.inline("top")).select(F.col("item").alias("word")))
    total = words.agg(F.count(F.lit(1))).scalar()
    counted = (words.join(F.broadcast(candidates), "word", "left_semi")   # at most ``tracked`` rows
               .groupBy("word").agg(F.count(F.lit(1)).alias("count")))
    return counted.withColumn("bound", heavy_word_bound(total, tracked)).where(F.col("count") > F.col("bound"))
