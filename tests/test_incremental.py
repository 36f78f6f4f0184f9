import shutil

from pyspark.sql import functions as F

from opinio.operators import incremental as I
from opinio.operators.clean import clean_reviews
from opinio.schemas import RAW_COLUMNS, REVIEWS_RAW_SCHEMA


def raw_rows(spark, ids):
    rows = [("M", "C", "4.5 out of 5", "12 global ratings", f"t{i % 7}", "u", "5.0 out of 5 stars" if i % 5 else "no number", f"text {i}",
             "0") for i in ids]
    return spark.createDataFrame(rows, REVIEWS_RAW_SCHEMA)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*RAW_COLUMNS).collect())


def test_batches_equal_one_batch_and_replays_add_nothing(spark, tmp_path):
    batches = [range(20), range(10, 40), [], list(range(40)) * 2, range(35, 50)]
    whole = clean_reviews(raw_rows(spark, [i for b in batches for i in b]))
    folder = str(tmp_path / "table")
    for n, ids in enumerate(batches):
        I.append_batch(raw_rows(spark, ids), folder, n)
    table = I.cleaned_table(spark, folder, whole.schema)
    assert rows_of(table) == rows_of(whole)
    for n in (1, 3, 4, 0):                                    # any batch again
        I.append_batch(raw_rows(spark, batches[n]), folder, n)
        spark.catalog.refreshByPath(folder)
        assert rows_of(I.cleaned_table(spark, folder, whole.schema)) == rows_of(whole)


def test_a_batch_that_failed_between_its_writes_is_made_good(spark, tmp_path):
    folder = str(tmp_path / "table")
    I.append_batch(raw_rows(spark, range(10)), folder, 0)
    I.append_batch(raw_rows(spark, range(5, 20)), folder, 1)
    shutil.rmtree(f"{folder}/seen/batch=1")                   # rows were written, keys were not
    I.append_batch(raw_rows(spark, range(5, 20)), folder, 1)
    I.append_batch(raw_rows(spark, range(30)), folder, 2)
    whole = clean_reviews(raw_rows(spark, range(30)))
    assert rows_of(I.cleaned_table(spark, folder, whole.schema)) == rows_of(whole)


def test_only_keys_of_earlier_batches_are_read(spark, tmp_path):
    folder = str(tmp_path / "table")
    for n in range(2):
        I.append_batch(raw_rows(spark, range(10 * n, 10 * n + 15)), folder, n)
    plan = I.seen_keys(spark, folder, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "batch" in plan and "ReadSchema: struct<review_key:binary>" in plan
    assert I.seen_keys(spark, folder, 1).count() == 12        # 15 rows, 3 without a number


def test_stream(spark, tmp_path):
    source, folder, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    whole = clean_reviews(raw_rows(spark, range(25)))
    for ids in (range(15), range(10, 25)):
        raw_rows(spark, ids).write.mode("append").parquet(source)
        I.ingest_cleaned(spark, source, folder, check, fmt="parquet").awaitTermination()
    assert rows_of(I.cleaned_table(spark, folder, whole.schema)) == rows_of(whole)
    assert I.cleaned_table(spark, folder, whole.schema).agg(F.count_distinct("review_key")).first()[0] == whole.count()
