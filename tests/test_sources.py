import os
import tempfile

from pyspark.sql import functions as F

from opinio.sources import pages as PG
from opinio.sources.files import detect_encodings, read_config, read_reviews_csv
from opinio.sources.sinks import append_csv
from opinio.schemas import REVIEWS_RAW_SCHEMA


def page(pid, url, paras, nxt=False, foreign=0):
    body = "".join(f"<p>{p}" for p in paras)
    extra = '<div id="customer_review_foreign"></div>' * foreign
    link = '<a href="/x?page=2">Next page</a>' if nxt else ""
    return (pid, url, f"<html><head><title>T{pid}</title></head><body>{extra}<nav><ul><li><a href=\"/a\">a</a></li>"
                      f"</ul></nav><article><h1>H{pid}</h1>{body}</article>{link}</body></html>")


def test_blocks_paging_and_counts(spark):
    rows = [page(1, "https://shop.example.com/p/1?page=1", ["good one", "3 people found this helpful"], nxt=True),
            page(2, "https://shop.example.com/p/1?page=2", ["last page review"]),
            page(3, "https://shop.example.com/p/1?page=3", ["beyond the end"]),
            page(4, "https://other.example.com/q/9", ["x"], foreign=2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    b = PG.review_blocks(df).orderBy("page_id", "block_no").collect()
    assert [r["Review"] for r in b] == ["good one", "3 people found this helpful", "last page review", "beyond the end", "x"]
    assert [r["Review_helpful_rating"] for r in b][:2] == ["0", "3 people found this helpful"]
    assert b[0]["Model"] == "H1" and b[-1]["Model"] == "T4"       # layout dispatch
    kept = sorted(r["page_id"] for r in PG.pages_until_last(df).collect())
    assert kept == [1, 2, 4]
    per = {r["product_key"]: (r["reviews"], r["cumulative_reviews"]) for r in PG.collected_per_product(df).collect()}
    assert per == {"shop.example.com/p/1": (3, 3), "other.example.com/q/9": (1, 4)}


def test_zip_shortest(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["1", "2"])], "x array<string>, y array<string>")
    z = df.select(F.inline(PG.zip_shortest(F.col("x"), F.col("y")))).collect()
    assert [tuple(r) for r in z] == [("a", "1"), ("b", "2")]


def test_config_csv(spark):
    d = tempfile.mkdtemp(prefix="opinio-test-")
    p = os.path.join(d, "config.csv")
    with open(p, "wb") as f:
        f.write(b'SI_No,Company,Model,Amazon_Url\r\nData_1,Acme,"Phone (Blue, 8GB)",https://x/product-reviews/B01\r\n')
    r = read_config(spark, p).collect()
    assert len(r) == 1 and r[0]["Model"] == "Phone (Blue, 8GB)" and r[0]["Amazon_Url"] == "https://x/product-reviews/B01"


def test_review_csv_encoding_and_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="opinio-test-")
    p = os.path.join(d, "reviews.csv")
    line = 'M,C,4.5 out of 5,"1,234 global ratings",Título,ann,5.0 out of 5 stars,"multi\nline ""q""",0\n'
    header = ",".join(f.name for f in REVIEWS_RAW_SCHEMA.fields) + "\n"
    with open(p, "wb") as f:
        f.write((header + line).encode("latin-1"))
    assert list(detect_encodings(spark, p)) == ["ISO-8859-1"]
    r = read_reviews_csv(spark, p).collect()
    assert r[0]["Review_title"] == "Título" and r[0]["Review"] == 'multi\nline "q"'
    out = os.path.join(d, "out")
    df = spark.createDataFrame(r, REVIEWS_RAW_SCHEMA)
    append_csv(df, out)
    append_csv(df, out)
    back = read_reviews_csv(spark, out, header=False, encoding="UTF-8")
    assert back.count() == 2 and back.collect()[0]["Review"] == 'multi\nline "q"'


def test_each_file_in_its_own_encoding(spark):
    d = tempfile.mkdtemp(prefix="opinio test é-")
    line = 'M,C,4.5 out of 5,1 global ratings, Título ,%s,5.0 out of 5 stars,r,0\n'
    for name, enc in (("a.csv", "latin-1"), ("b.csv", "utf-8"), ("c.csv", "utf-8-sig")):
        with open(os.path.join(d, name), "wb") as f:
            f.write((line % name).encode(enc))
    got = {r["Reviewer_name"]: (r["Model"], r["Review_title"]) for r in read_reviews_csv(spark, d, header=False).collect()}
    assert got == {n: ("M", " Título ") for n in ("a.csv", "b.csv", "c.csv")}


def test_final_outputs_round_trip(spark):
    from opinio import resources as R
    from opinio.plans.enrich import enriched, final_table, write_outputs
    d = tempfile.mkdtemp(prefix="opinio-test-")
    df = final_table(enriched(spark, "/root/testdata/sf0.001"), None,
                     R.FIXTURE_CHAIN_STOP_WORDS + R.TOPIC_EXTRA_STOP_WORDS, R.FIXTURE_STOP_WORDS)
    write_outputs(df, os.path.join(d, "pq"), os.path.join(d, "csv"))
    n = df.count()
    back = spark.read.parquet(os.path.join(d, "pq"))
    assert back.count() == n and "processed_text" in back.columns
    assert back.select("Company").distinct().count() == df.select("Company").distinct().count()
    assert spark.read.csv(os.path.join(d, "csv"), multiLine=True, escape='"').count() == n


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    """Every file starts with the mark, and it is no part of the first value read back."""
    import glob
    from opinio.sources.files import read_reviews_csv
    from opinio.sources.sinks import append_csv
    from opinio.schemas import RAW_COLUMNS, REVIEWS_RAW_SCHEMA
    rows = [("é,\"x\"", " padded ", "a\nb", "", None, "u", "v", "w", str(i)) for i in range(6)]
    df = spark.createDataFrame(rows, REVIEWS_RAW_SCHEMA).repartition(3)
    for _ in range(2):
        append_csv(df, str(tmp_path / "out"), mark=True)
    files = glob.glob(str(tmp_path / "out" / "part-*"))
    assert len(files) == 6 and all(open(f, "rb").read().startswith(b"\xef\xbb\xbf") for f in files)
    assert sum(open(f, "rb").read().count(b"\xef\xbb\xbf") for f in files) == 6
    plain = tmp_path / "plain"
    append_csv(df, str(plain))
    got, want = (sorted((tuple(r[c] for c in RAW_COLUMNS) for r in read_reviews_csv(spark, str(x), header=False).collect()), key=str)
                 for x in (tmp_path / "out", plain))
    assert got == sorted(want * 2, key=str)
