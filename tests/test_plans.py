"""Plan-shape checks for the scale claims in the README, and a skewed
fixture (one model with a third of the rows, one review copied many times)."""
from pyspark.sql import functions as F

from opinio.operators.clean import clean_reviews
from opinio.operators.sentiment import fixture_word_info, score_sentiment
from opinio.plans.catalog import QUERIES
from opinio.plans.enrich import add_features, cleaned
from opinio.schemas import REVIEWS_RAW_SCHEMA

SF = "/root/testdata/sf0.001"


def plan(df):
    df.write.format("noop").mode("overwrite").save()          # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(p):
    return p.count("Exchange hashpartitioning") + p.count("Exchange rangepartitioning") + \
        p.count("Exchange SinglePartition")


def test_cleaning_is_one_shuffle_and_scan_is_pruned(spark):
    p = plan(cleaned(spark, SF))
    assert shuffles(p) == 1
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string,n_chars:bigint>" in p


def test_sentiment_adds_no_token_shuffle(spark):
    df = score_sentiment(add_features(cleaned(spark, SF)), fixture_word_info(spark))
    p = plan(df.select("review_key", "Sentiment_Score"))
    # the two de-duplication exchanges (reviews and narrow token branch) and nothing else
    assert shuffles(p) == 2
    assert "BroadcastHashJoin" in p


def test_top_k_per_group_limits_before_shuffle(spark):
    p = plan(QUERIES["ngr06_top10_trigrams_per_model_class"](spark, SF))
    lines = p.split("\n")
    partial = [i for i, l in enumerate(lines) if "WindowGroupLimit" in l and "Partial" in l]
    final_exchange = [i for i, l in enumerate(lines) if "Exchange hashpartitioning(Model" in l and "ngram" not in l]
    assert partial and final_exchange and final_exchange[0] < partial[0]   # the partial limit runs below the shuffle


def test_skewed_fixture(spark):
    base = ("Hot Model (Blue, 8GB RAM, 128GB Storage) xx", "Acme", "4.5 out of 5", "12 global ratings",
            "t", "u", "5.0 out of 5 stars", "same text was good", "0")
    rows = [base] * 300                                      # one review copied 300 times
    rows += [(base[0], "Acme", "4.5 out of 5", "12 global ratings", "t", f"u{i}", "4.0 out of 5 stars",
              f"review {i} with text", "0") for i in range(150)]            # the hot model
    rows += [(f"Model {i}", "Other", "3.0 out of 5", "7 global ratings", "t", "v", "3.0 out of 5 stars",
              f"other {i}", "0") for i in range(150)]
    df = clean_reviews(spark.createDataFrame(rows, REVIEWS_RAW_SCHEMA))
    by_model = {r["Model"]: r["n"] for r in df.groupBy("Model").agg(F.count("*").alias("n")).collect()}
    assert by_model[base[0]] == 151 and len(by_model) == 151


def test_grouping_sets_are_one_pass(spark):
    """Three granularities by one Expand, with as many scans as the reviews with sentiment need by themselves."""
    from opinio.plans.enrich import enriched
    p, alone = plan(QUERIES["agg09b_class_company_polarity"](spark, SF)), plan(enriched(spark, SF).select("classification", "Polarity", "Company"))
    final = p.split("Initial Plan")[0]
    assert final.count("Expand") == 1 and final.count("FileScan") == alone.split("Initial Plan")[0].count("FileScan")
    assert "partial_count" in final


def test_heavy_words_are_counted_twice_not_collected(spark):
    p = plan(QUERIES["ngr09b_heavy_words"](spark, SF))
    assert "approx_top_k" in p and "LeftSemi" in p
