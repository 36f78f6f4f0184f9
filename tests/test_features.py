from pyspark.sql import functions as F

from opinio.functions import text as TX
from opinio.functions.classify import classify


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("v")).collect()[0]["v"]


def test_counts(spark):
    s = "Héllo,\tworld!!  😀 ok\n"
    assert one(spark, TX.char_count, s) == len(s)
    assert one(spark, TX.word_count, s) == len(s.split())
    assert one(spark, TX.punctuation_count, s) == sum(ch in TX.R.PUNCTUATION for ch in s)
    assert one(spark, TX.emoticon_run_count, "a 😀😀 b 😀") == 2


def test_short_name(spark):
    m = "Apple iPhone 14 Pro Max (128 GB) - Deep Purple"
    assert one(spark, lambda c: TX.short_model_name(c), m) == m[:30]


def _py_classify(text, prod, svc):
    t = text.lower()
    p = sum(1 for k in prod if k.lower() in t)
    s = sum(1 for k in svc if k.lower() in t)
    words = len(t.split())
    if p > s:
        return "Product Review"
    if s > p:
        return "Service Review"
    if words < 15 and any(k in t for k in svc):
        return "Service Review"
    if words >= 15 and sum(1 for k in svc if k in t) >= 2:
        return "Service Review"
    return "Product Review"


def test_classifier_matches_plain_python(spark):
    from opinio import resources as R
    texts = ["shipping was slow", "great camera and battery", "the box arrived damaged",
             "camera " + "x " * 20 + "box delivery", "camera box",
             "program running", " ".join(["w"] * 14) + " delivery", " ".join(["w"] * 15) + " delivery",
             " ".join(["w"] * 15) + " delivery box camera ram", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["c"] for r in df.select(classify(F.lower("t")).alias("c")).collect()]
    want = [_py_classify(t.lower(), R.PRODUCT_KEYWORDS, R.SERVICE_KEYWORDS) for t in texts]
    assert got == want
    assert got[0] == "Service Review"   # "Shipping" counts case-folded


def test_white_space_of_every_script(spark):
    from pyspark.sql import functions as F

    from opinio.functions import text as TX
    from opinio.functions.parse import to_number, strip_ws
    text = "a\u00a0b\u2003c d\u3000"
    r = spark.createDataFrame([(text, "\u00a04.5\u2009")], "t string, n string").select(
        TX.word_count("t").alias("n"), TX.split_words("t").alias("w"), to_number(strip_ws("n")).alias("x")).first()
    assert (r["n"], r["w"], r["x"]) == (len(text.split()), text.split(), 4.5)
