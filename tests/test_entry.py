import __spark_entry__ as E


def test_contract(spark):
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and set(df.columns) == {"Company", "avg_char_count", "avg_word_count",
                                                 "avg_word_density", "avg_punctuation_count"}


def test_fixture_expected_values(spark):
    """Values recorded for the sf0.01 fixture (FIXTURES.md section 4)."""
    q = E.queries()
    sf = "/root/testdata/sf0.01"
    r = q["prf02_stage_counts"](spark, sf).collect()[0]
    assert (r["raw_rows"], r["distinct_rows"], r["complete_rows"], r["clean_rows"]) == (1020, 998, 961, 957)
    r = q["src10_field_counts"](spark, sf).collect()[0]
    assert (r["pages"], r["title_chars"], r["links"], r["list_items"], r["empty_articles"]) == (250, 12819, 1413, 1413, 0)
    h = [r["count"] for r in q["agg12b_char_count_histogram"](spark, sf).orderBy("bin").collect()]
    assert h == [767, 128, 32, 17, 4, 3, 4, 1, 0, 1]
    import hashlib
    rows = q["txt08b_documents_chain_fixture_order"](spark, sf).orderBy("doc_id").collect()
    assert sum(len(r["text"]) for r in rows) == 2167139
    assert hashlib.md5("|".join(r["text"] for r in rows).encode()).hexdigest() == "f7d823bed96621da41ab333fd934911c"
