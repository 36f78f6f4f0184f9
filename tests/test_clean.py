"""Cleaning traps: null title/review, duplicates, unparseable numbers."""
from pyspark.sql import functions as F

from opinio.operators.clean import clean_reviews, stage_counts
from opinio.schemas import REVIEWS_RAW_SCHEMA


def raw(spark, rows):
    return spark.createDataFrame(rows, REVIEWS_RAW_SCHEMA)


BASE = ("Phone A (Blue, 8GB RAM, 128GB Storage) - extra long name", "Acme", "4.5 out of 5",
        "1,234 global ratings", "Great", "ann", "5.0 out of 5 stars", "Nice phone", "0")


def with_(**kw):
    names = [f.name for f in REVIEWS_RAW_SCHEMA.fields]
    r = list(BASE)
    for k, v in kw.items():
        r[names.index(k)] = v
    return tuple(r)


def test_parse_and_text(spark):
    df = clean_reviews(raw(spark, [BASE])).collect()
    assert len(df) == 1
    r = df[0]
    assert r["Overall_product_rating"] == 4.5
    assert r["Overall_product_rating_count"] == 1234.0
    assert r["Review_Rating"] == 5.0
    assert r["Review_helpful_rating"] == 0.0
    assert r["Title_and_Reviews"] == "Great Nice phone"


def test_null_title_is_dropped_null_review_is_dropped(spark):
    assert clean_reviews(raw(spark, [with_(Review_title=None)])).count() == 0
    assert clean_reviews(raw(spark, [with_(Review=None)])).count() == 0


def test_votes(spark):
    rows = [with_(Review_helpful_rating="One person found this helpful", Reviewer_name="a"),
            with_(Review_helpful_rating="12 people found this helpful", Reviewer_name="b"),
            with_(Review_helpful_rating="1,204 people found this helpful", Reviewer_name="c")]
    got = {r["Reviewer_name"]: r["Review_helpful_rating"] for r in clean_reviews(raw(spark, rows)).collect()}
    assert got == {"a": 1.0, "b": 12.0}          # the comma form does not parse: row lost


def test_singular_rating_count_is_lost(spark):
    assert clean_reviews(raw(spark, [with_(Overall_product_rating_count="1 global rating")])).count() == 0


def test_duplicates_and_merge_after_parse(spark):
    rows = [BASE, BASE, with_(Review_helpful_rating=" 0 ")]
    # exact copies collapse; " 0 " parses to the same number, so the cleaned rows are equal too
    assert clean_reviews(raw(spark, rows)).count() == 1


def test_stage_counts(spark):
    rows = [BASE, BASE, with_(Review=None), with_(Review_Rating="five")]
    r = stage_counts(raw(spark, rows)).collect()[0]
    assert (r["raw_rows"], r["distinct_rows"], r["complete_rows"], r["parsed_rows"], r["clean_rows"]) == (4, 3, 2, 1, 1)


def test_numbers_guarded(spark):
    for bad in ["1d", "NaN", "4.5.1", ""]:
        assert clean_reviews(raw(spark, [with_(Overall_product_rating=bad)])).count() == 0


def test_same_text_by_three_reviewers_is_three_documents(spark):
    """The document key of the topic queries covers the whole row."""
    from pyspark.sql import functions as F

    from opinio.operators import topics as TP
    from opinio.operators.clean import clean_reviews
    from opinio.plans.catalog import _doc_key
    from opinio.schemas import REVIEWS_RAW_SCHEMA
    rows = [("Phone X", "Acme", "4.5 out of 5", "12 global ratings", "Good", name, "5.0 out of 5 stars", "Nice phone nice", "0")
            for name in ("ann", "bob", "cat", "cat")]
    df = clean_reviews(spark.createDataFrame(rows, REVIEWS_RAW_SCHEMA))
    docs = df.select(_doc_key().alias("doc"), F.split(F.lower("Title_and_Reviews"), " ").alias("tokens"))
    bow = TP.bag_of_words(docs, "doc", "tokens")
    assert bow.select("doc").distinct().count() == 3
    nice = [r for r in TP.dictionary_table(bow).collect() if r["token"] == "nice"][0]
    assert (nice["doc_freq"], nice["coll_freq"]) == (3, 6)
