"""What keeps disk and memory of a task in step with the input (plans), with the same rows."""
from pyspark.sql import functions as F

from opinio import resources as R
from opinio.operators import incremental as I
from opinio.operators import lookup as L
from opinio.operators import ngrams as N
from opinio.operators import textclean as TC
from opinio.operators import topics as TP
from opinio.operators.clean import clean_reviews
from opinio.operators.sentiment import strip_edges
from opinio.schemas import REVIEWS_RAW_SCHEMA


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def both_ways(monkeypatch, module, make):
    """Rows by the look-up in the row and by the join of a table that is too large for it."""
    small = sorted(map(tuple, make().collect()), key=str)
    monkeypatch.setattr(module, "word_lookup", lambda *a, **k: None)
    return small, sorted(map(tuple, make().collect()), key=str)


def test_dictionary_words_are_kept_in_the_row(spark, monkeypatch):
    df = spark.createDataFrame([("a", "the Cat  zz the dog"), ("b", ""), ("c", None), ("d", "zz yy")], "k string, t string")
    words = spark.createDataFrame([("THE",), ("cat",), (None,), ("cat",)], "word string")
    for case in (False, True):
        with monkeypatch.context() as m:
            small, joined = both_ways(m, TC, lambda: TC.keep_dictionary_words(df, "k", "t", words, case_sensitive=case))
        assert small == joined
    p = plan_of(TC.keep_dictionary_words(df, "k", "t", words))
    assert "Generate" not in p and "Exchange" not in p


def test_words_are_corrected_in_the_row(spark, monkeypatch):
    df = spark.createDataFrame([("a", "helo Wrld  fine helo"), ("b", None), ("c", "qqqqqqqq")], "k string, t string")
    words = spark.createDataFrame([("hello", 3), ("world", 1), ("fine", 2)], "word string, freq long")
    small, joined = both_ways(monkeypatch, TC, lambda: TC.correct_words(df, "k", "t", words))
    assert small == joined and ("a", "hello world fine hello") in small


def test_lemmas_are_taken_in_the_row(spark, monkeypatch):
    docs = spark.createDataFrame([("a", ["cars", "go", "cars", "les"]), ("b", []), ("c", None)], "k string, t array<string>")
    lemmas = spark.createDataFrame([("cars", "car"), ("cars", "caz"), ("les", None)], "form string, lemma string")
    small, joined = both_ways(monkeypatch, TP, lambda: TP.lemmatize(docs, "k", "t", lemmas))
    assert small == joined and ("a", ["car", "go", "car", "les"]) in small


def test_a_large_table_is_not_looked_up(spark):
    table = spark.range(50).select(F.col("id").cast("string").alias("w"))
    assert L.word_lookup(table, "w", "w", most=49) is None
    found = L.word_lookup(table, "w", "w", most=50)
    got = spark.createDataFrame([("7",), ("50",), (None,)], "x string").select(found(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in got] == ["7", None, None]


def test_texts_go_once_through_the_deduplication(spark):
    raw = spark.createDataFrame([], REVIEWS_RAW_SCHEMA)
    df = clean_reviews(raw).select("text_raw", "text_en", "Title_and_Reviews")
    agg = [l for l in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in l]
    assert len(agg) == 1 and "first(text" not in agg[0] and agg[0].count("first(") == 2


def test_ngrams_are_dealt_by_the_size_of_the_input(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(2000).select(F.concat_ws(" ", F.lit("aa bb"), F.md5(F.col("id").cast("string"))).alias("t")).write.parquet(path)
    df = spark.read.parquet(path)
    monkeypatch.setattr(N, "PARTS_PER_MB", 37)
    assert N.counting_parts(df) == 37                         # one begun MB
    counts = N.ngram_counts(df, "t", 3, [])
    assert "REPARTITION_BY_NUM" in plan_of(counts) and ", 37)" in plan_of(counts)
    assert counts.agg(F.sum("count")).first()[0] == 2000
    assert "REPARTITION_BY_NUM" not in plan_of(N.ngram_counts(df, "t", 1, []))


def test_appended_rows_are_stored_once_and_dealt_once(spark, tmp_path):
    folder = str(tmp_path / "table")
    rows = [("M", "C", "4.5 out of 5", "12 global ratings", "t", "u", "5.0 out of 5 stars", f"text {i}", "0") for i in range(6)]
    raw = spark.createDataFrame(rows, REVIEWS_RAW_SCHEMA)

    def backwards(df):
        return clean_reviews(df, translate=lambda d: d.withColumn("text_en", F.when(
            F.col("Review") == "text 1", F.reverse("text_raw")).otherwise(F.col("text_raw"))))
    I.append_batch(raw, folder, 0, clean=backwards)
    stored = spark.read.parquet(f"{folder}/rows")
    assert "text_raw" not in stored.columns and "Title_and_Reviews" not in stored.columns
    assert stored.where(F.col("text_en").isNotNull()).count() == 1
    whole = backwards(raw)
    got = I.cleaned_table(spark, folder, whole.schema)
    assert got.columns == whole.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def test_likelihood_is_inferred_once(spark):
    docs = spark.createDataFrame([(str(i), [f"w{(i * j) % 7}" for j in range(6)]) for i in range(12)], "doc string, tokens array<string>")
    _, vec = TP.vectorize(docs)
    model = TP.fit_lda(vec, 2, 3)
    both = [float(model.logPerplexity(vec)), float(model.logLikelihood(vec))]
    model_seen = type("Seen", (), {"logLikelihood": lambda self, v: both[1]})()
    row = TP.perplexity(model_seen, vec).collect()[0]
    assert abs(row["log_perplexity"] - both[0]) < 1e-9 and row["per_word_bound"] == -row["log_perplexity"]


def test_edges_are_the_published_ones(spark):
    edge = r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$"
    assert sorted(R.PUNCTUATION) == sorted(c for c in map(chr, range(33, 127)) if not c.isalnum())
    words = ["...Hey!!!", ":)", "(a-b)", "!!!", "", "don't", "\"café\"?", "¿que?", ":-))", "--ok--\U0001f600!"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    old = F.regexp_replace("w", edge, "")
    assert df.where(strip_edges(F.col("w")) != F.when(F.length(old) <= 2, F.col("w")).otherwise(old)).count() == 0
