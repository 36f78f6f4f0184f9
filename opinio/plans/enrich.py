"""End-to-end review enrichment: raw rows -> cleaned -> features ->
sentiment -> short name, lower-cased text, classification.

Each stage is a function of a DataFrame, so a query pulls in only the
stages it needs (a text-feature chart never runs the sentiment joins).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio import resources as R
from opinio.functions import text as TX
from opinio.functions.classify import classify
from opinio.operators.clean import clean_reviews
from opinio.operators.sentiment import fixture_word_info, score_sentiment
from opinio.sources.fixture import reviews_raw

KEYWORD_SETS = {
    "reference": (R.PRODUCT_KEYWORDS, R.SERVICE_KEYWORDS),
    "fixture": (R.FIXTURE_PRODUCT_KEYWORDS, R.FIXTURE_SERVICE_KEYWORDS),
}


def add_features(df: DataFrame, text: str = "text_en") -> DataFrame:
    """FEA1-4 on the (translated, original-case) text."""
    chars, words = TX.char_count(text), TX.word_count(text)
    return df.withColumns({
        "char_count": chars.cast("long"),
        "word_count": words.cast("long"),
        "word_density": TX.word_density(chars, words),
        "punctuation_count": TX.punctuation_count(text).cast("long"),
    })


def add_labels(df: DataFrame, keywords: str = "fixture") -> DataFrame:
    """FEA5-6 and CLS1-2: short model name, lower-cased text, classification."""
    prod, svc = KEYWORD_SETS[keywords]
    return (df.withColumn("Short_Model_Name", TX.short_model_name("Model"))
              .withColumn("text_lower", F.lower("text_en"))
              .withColumn("classification", classify(F.col("text_lower"), prod, svc)))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_reviews(reviews_raw(spark, sf_dir))


def enriched(spark: SparkSession, sf_dir: str, *, sentiment: bool = True, labels: bool = True,
             keywords: str = "fixture", word_info=None) -> DataFrame:
    # With sentiment, two branches read the cleaned table: the narrow token
    # branch (review_key, text_en) and the reviews it joins back to.  Both
    # leave the de-duplication exchange hash-partitioned by review_key, so
    # the per-review sum and the join back add no exchange of their own.
    df = add_features(cleaned(spark, sf_dir))
    if sentiment:
        df = score_sentiment(df, word_info if word_info is not None else fixture_word_info(spark))
    if labels:
        df = add_labels(df, keywords)
    return df


def final_table(enriched_df: DataFrame, dictionary: DataFrame | None, stop_words: list[str],
                topic_stop_words: list[str]) -> DataFrame:
    """The table the pipeline writes out: the enriched reviews with the
    topic-cleaned text in place of ``Title_and_Reviews`` and the topic
    tokens as ``processed_text``."""
    from opinio.operators.textclean import clean_chain
    from opinio.operators.topics import topic_tokens
    df = clean_chain(enriched_df, "review_key", "text_lower", stop_words, dictionary)
    return (df.withColumn("Title_and_Reviews", F.col("text_topic"))
              .withColumn("processed_text", topic_tokens(F.col("text_topic"), topic_stop_words)))


def write_outputs(final_df: DataFrame, parquet_path: str, csv_path: str | None = None) -> None:
    """SNK2/SNK3: Parquet partitioned by company (overwrite) and, optionally,
    the headerless CSV append of the cleaned rows."""
    from opinio.sources.sinks import append_csv, export_parquet
    export_parquet(final_df, parquet_path, "Company")
    if csv_path:
        append_csv(final_df, csv_path)
