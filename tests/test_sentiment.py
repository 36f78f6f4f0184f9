"""Sentiment: the Spark plan against a plain-Python implementation of the
same rules, on hand-made sentences that hit every rule."""
import math
import string

from pyspark.sql import functions as F

from opinio import resources as R
from opinio.operators.sentiment import polarity_label, score_sentiment, word_info

LEX = {"good": 1.9, "bad": -2.5, "great": 3.1, "no": -1.2, "kind": 2.4, "love": 3.2, "hate": -2.7}
BOOST = {"very": R.BOOST_INCR, "extremely": R.BOOST_INCR, "barely": R.BOOST_DECR}
NEG = {"not", "never", "without", "isn't"}


def is_upper(w):
    return w.isupper()


def py_score(text):
    words = []
    for w in text.split():
        s = w.strip(string.punctuation)
        words.append(w if len(s) <= 2 else s)
    low = [w.lower() for w in words]
    ups = sum(1 for w in words if is_upper(w))
    capdiff = 0 < ups < len(words)
    sent = []
    for i, w in enumerate(words):
        lw = low[i]
        if lw in BOOST or (lw == "kind" and i + 1 < len(words) and low[i + 1] == "of") or lw not in LEX:
            sent.append(0.0)
            continue
        v = LEX[lw]
        if lw == "no" and i + 1 < len(words) and low[i + 1] in LEX:
            v = 0.0
        if (i > 0 and low[i - 1] == "no") or (i > 1 and low[i - 2] == "no") or \
                (i > 2 and low[i - 3] == "no" and low[i - 1] in ("or", "nor")):
            v = LEX[lw] * R.NEGATION_SCALAR
        if is_upper(w) and capdiff:
            v = v + R.CAPS_INCR if v > 0 else v - R.CAPS_INCR
        for k in range(3):
            if i > k and low[i - (k + 1)] not in LEX:
                p = words[i - (k + 1)]
                sc = 0.0
                if p.lower() in BOOST:
                    sc = BOOST[p.lower()] * (-1 if v < 0 else 1)
                    if is_upper(p) and capdiff:
                        sc += R.CAPS_INCR if v > 0 else -R.CAPS_INCR
                sc *= R.PRECEDING_DAMPING[k]
                v += sc
                neg = lambda x: x in NEG or "n't" in x
                if k == 0 and neg(low[i - 1]):
                    v *= R.NEGATION_SCALAR
                elif k == 1:
                    if low[i - 2] == "never" and low[i - 1] in ("so", "this"):
                        v *= 1.25
                    elif low[i - 2] == "without" and low[i - 1] == "doubt":
                        pass
                    elif neg(low[i - 2]):
                        v *= R.NEGATION_SCALAR
                elif k == 2:
                    if (low[i - 3] == "never" and low[i - 2] in ("so", "this")) or low[i - 1] in ("so", "this"):
                        v *= 1.25
                    elif low[i - 3] == "without" and (low[i - 2] == "doubt" or low[i - 1] == "doubt"):
                        pass
                    elif neg(low[i - 3]):
                        v *= R.NEGATION_SCALAR
        if i > 0 and low[i - 1] == "least" and low[i - 1] not in LEX and not (i > 1 and low[i - 2] in ("at", "very")):
            v *= R.NEGATION_SCALAR
        sent.append(v)
    if "but" in low:
        bi = low.index("but")
        sent = [s * 0.5 if j < bi else (s * 1.5 if j > bi else s) for j, s in enumerate(sent)]
    if not sent:
        return 0.0
    s = sum(sent)
    ep = min(text.count("!"), 4) * R.EXCLAMATION_STEP
    q = text.count("?")
    qa = (R.QUESTION_CAP if q > 3 else q * R.QUESTION_STEP) if q > 1 else 0.0
    if s > 0:
        s += ep + qa
    elif s < 0:
        s -= ep + qa
    c = s / math.sqrt(s * s + R.NORMALIZE_ALPHA)
    return round(max(-1.0, min(1.0, c)), 4)


TEXTS = [
    "good", "This is GOOD but the screen is bad!!", "not good", "very good", "VERY good phone",
    "never so good", "without doubt bad", "at least good", "least good", "the kind of phone",
    "no good", "no problem, great", "bad bad bad???", "barely good", "I isn't love it", "",
    "extremely bad, not great at all!!!!!", "hate it, but love the camera", ":) good :-)",
    "great. Good? GOOD!", "it is not very good", "no or great", "this is so good",
]


def test_matches_plain_python(spark):
    info = word_info(spark, LEX.items(), BOOST.items(), NEG)
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "k string, t string")
    got = {r["k"]: r["Sentiment_Score"] for r in score_sentiment(df, info, key="k", text="t").collect()}
    for i, t in enumerate(TEXTS):
        assert abs(got[str(i)] - py_score(t)) < 1e-9, (t, got[str(i)], py_score(t))


def test_labels_at_thresholds(spark):
    df = spark.createDataFrame([(0.05,), (-0.05,), (0.0499,), (-0.0499,)], "s double")
    assert [r[0] for r in df.select(polarity_label("s")).collect()] == ["Positive", "Negative", "Neutral", "Neutral"]


def test_lexicon_file_with_published_lists(spark, tmp_path):
    from opinio.operators.sentiment import default_word_info, read_lexicon
    p = tmp_path / "lexicon.txt"
    p.write_text("good\t1.9\t0.9\t[2, 2]\nbad\t-2.5\t0.8\t[-2, -3]\n", encoding="utf-8")
    info = default_word_info(spark, read_lexicon(spark, str(p)))
    texts = ["good", "very good", "not good", "barely good", "bad"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "k string, t string")
    s = {r["k"]: r["Sentiment_Score"] for r in score_sentiment(df, info, key="k", text="t").collect()}
    assert s["1"] > s["0"] > s["3"] > 0 > s["2"]
    assert s["4"] < 0


def test_large_word_table_falls_back_to_shuffle_joins(spark):
    info = word_info(spark, LEX.items(), BOOST.items(), NEG)
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "k string, t string")
    small = {r["k"]: r["Sentiment_Score"] for r in score_sentiment(df, info, key="k", text="t").collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = score_sentiment(df, info, key="k", text="t")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
        big = {r["k"]: r["Sentiment_Score"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
    assert big == small
