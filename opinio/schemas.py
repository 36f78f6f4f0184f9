"""Fixed schemas (FIXTURES.md section 1)."""

from pyspark.sql import types as T

CONFIG_SCHEMA = T.StructType([
    T.StructField("SI_No", T.StringType()),
    T.StructField("Company", T.StringType()),
    T.StructField("Model", T.StringType()),
    T.StructField("Amazon_Url", T.StringType()),
])

RAW_COLUMNS = [
    "Model", "Company", "Overall_product_rating", "Overall_product_rating_count",
    "Review_title", "Reviewer_name", "Review_Rating", "Review", "Review_helpful_rating",
]

REVIEWS_RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

NUMERIC_RAW_COLUMNS = [
    "Overall_product_rating", "Overall_product_rating_count", "Review_Rating",
    "Review_helpful_rating",
]

FEATURE_COLUMNS = ["char_count", "word_count", "word_density", "punctuation_count"]

PAGES_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])
