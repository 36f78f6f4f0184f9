"""Phrases are read in the row, with the rows that the join gives."""
import random

from pyspark.sql import functions as F

from opinio.operators import phrases as PH


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_phrases_are_merged_in_the_row_as_by_the_join(spark, monkeypatch):
    rnd = random.Random(11)
    marks = ["", "", ".", ",", "("]
    texts = ["  ".join(rnd.choice(["a", "B", "cé", "d", "日"]) + rnd.choice(marks) for _ in range(rnd.randrange(60))) for _ in range(80)]
    texts += [None, "", " ", "a", "a B", "zz", "a b cé a b cé d"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").repartition(3)
    some = {" ".join(rnd.choice(["a", "b", "cé", "d", "日"]) for _ in range(rnd.choice([1, 2, 2, 3, 4]))) for _ in range(12)}
    lexicon = spark.createDataFrame([(p, None if k % 4 == 0 else p[::-1]) for k, p in enumerate(sorted(some))] + [("A  b", "AB")],
                                    "phrase string, into string")
    monkeypatch.setattr(PH, "ROWS_AT_ONCE", 7)
    monkeypatch.setattr(PH, "WORDS_AT_ONCE", 90)
    make = lambda: PH.translate_with_lexicon(df, "k", "t", lexicon)
    plan = plan_of(make().select("k", "translated"))
    assert "Generate" not in plan and "Join" not in plan and "Exchange hashpartitioning" not in plan
    in_row = dict(map(tuple, make().select("k", "translated").collect()))
    monkeypatch.setattr(PH, "row_merger", lambda *a, **k: None)
    assert "Join" in plan_of(make())
    assert in_row == dict(map(tuple, make().select("k", "translated").collect())) and len(in_row) == len(texts)


def test_a_large_phrase_table_is_joined(spark):
    table = spark.range(30).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("phrase"))
    assert PH.row_merger(table, most=29) is None and PH.row_merger(table, most=30) is not None
