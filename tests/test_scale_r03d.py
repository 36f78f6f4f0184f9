"""Sentiment and classification do their work once (plans), with the same rows."""
from pyspark.sql import functions as F

from opinio import resources as R
from opinio.functions.classify import classify
from opinio.operators.sentiment import explode_tokens, fixture_word_info, score_sentiment
from opinio.plans.catalog import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_token_rows_have_their_neighbours(spark):
    df = spark.createDataFrame([("a", "one two  three four"), ("b", ""), ("c", None), ("d", "x")], "k string, t string")
    rows = explode_tokens(df, "k", "t")
    got = sorted((r.key, r.i, r.w, r.p1, r.p2, r.p3, r.n1) for r in rows.collect())
    assert got == [("a", 0, "one", None, None, None, "two"), ("a", 1, "two", "one", None, None, "three"),
                   ("a", 2, "three", "two", "one", None, "four"), ("a", 3, "four", "three", "two", "one", None),
                   ("d", 0, "x", None, None, None, None)]
    plan = plan_of(rows)
    assert "struct" not in plan and plan.count("split(") == 1          # no array of structs, every text is split once


def test_a_filter_on_label_and_score_makes_the_text_once(spark):
    df = spark.createDataFrame([("a", "Was! on? ram delivery"), ("b", None), ("c", "delivery with that, was!!")], "k string, t string")
    plan = plan_of(df.withColumn("x", F.lower("t")).withColumn("label", classify("x", R.FIXTURE_PRODUCT_KEYWORDS, R.FIXTURE_SERVICE_KEYWORDS))
                   .where(F.col("label") == R.SERVICE_LABEL).select("k"))
    condition = next(line for line in plan.split("\n") if "Filter" in line)
    assert condition.count("lower(") <= 3
    scored = score_sentiment(df, fixture_word_info(spark), key="k", text="t")
    plan = plan_of(scored.where("Polarity = 'Negative'").select("k"))
    condition = next(line for line in plan.split("\n") if "Filter" in line and "replace(" in line)
    assert condition.count("replace(") <= 8               # four for each side of the label


def test_filtered_reviews_are_scored_after_the_class_is_known(spark, tmp_path):
    docs = [(k, "delivery was late on monday" if k % 2 else "the ram is fast", "web1", 101 + k) for k in range(8)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    plan = plan_of(QUERIES["cln13_filtered_reviews"](spark, str(tmp_path)))
    tokens = plan[plan.index("Generate posexplode"):]
    assert f"= {R.SERVICE_LABEL}" in tokens
