import random

from pyspark.sql import functions as F

from opinio import resources as R
from opinio.operators.phrases import merge_phrases, phrase_matches, translate_with_lexicon
from opinio.operators.sentiment import default_word_info, phrases_of, score_sentiment


def brute(words, phrases):
    out, i = [], 0
    while i < len(words):
        n = max((len(p) for p in phrases if tuple(words[i:i + len(p)]) == p), default=0)
        if n:
            out.append((i, n))
        i += n or 1
    return out


def test_longest_match_equals_brute_force(spark):
    rnd = random.Random(7)
    words = [[rnd.choice("abc") for _ in range(rnd.randrange(40))] for _ in range(60)] + [["a"] * 3000]
    phrases = {tuple(rnd.choice("abc") for _ in range(rnd.choice([1, 2, 2, 3, 5]))) for _ in range(9)} | {("a", "a")}
    df = spark.createDataFrame(list(enumerate(words)), "k long, w array<string>").repartition(3)
    table = spark.createDataFrame([(" ".join(p),) for p in phrases] + [("A  a",)], "phrase string")
    got = {r.k: [(m.pos, m.n) for m in r.matches] for r in phrase_matches(df, "k", "w", table).collect()}
    for k, w in enumerate(words):
        assert got.get(k, []) == brute(w, phrases)
    merged = {r.k: r.w for r in merge_phrases(df, "k", "w", F.col("w"), table).collect()}
    for k, w in enumerate(words):
        at = dict(brute(w, phrases))
        inside = {p + i for p, n in at.items() for i in range(1, n)}
        assert merged[k] == [" ".join(w[i:i + at.get(i, 1)]) for i in range(len(w)) if i not in inside]


def test_overlap_case_and_edges(spark):
    table = spark.createDataFrame([("new york", "NY"), ("york city", "YC"), ("new york city", "NYC"), ("cat", "gato")], "phrase string, into string")
    texts = ["New York, City!", "the york city cat.", "NEW YORK citadel", "", None, "new new york city york"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r.k: r.translated for r in translate_with_lexicon(df, "k", "t", table).collect()}
    assert got == {0: "NYC", 1: "the YC gato", 2: "NY citadel", 3: "", 4: None, 5: "new NYC york"}


def test_empty_table(spark):
    df = spark.createDataFrame([(1, ["a", "b"])], "k long, w array<string>")
    table = spark.createDataFrame([], "phrase string")
    assert phrase_matches(df, "k", "w", table).count() == 0
    assert merge_phrases(df, "k", "w", F.col("w"), table).first().w == ["a", "b"]


def score(spark, texts, info, phrases=True):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "k string, t string")
    rows = score_sentiment(df, info, key="k", text="t", phrases=phrases_of(info) if phrases else None).collect()
    return [r["Sentiment_Score"] for r in sorted(rows, key=lambda r: int(r.k))]


def test_phrase_boosters_and_idioms(spark):
    """Boosters of two words damp, idioms have their own valence; published values."""
    info = default_word_info(spark, [("good", 1.9), ("death", -2.9), ("die", -2.9), ("right", 0.5)])
    assert {r.phrase for r in phrases_of(info).collect()} >= {"kind of", "sort of", "just enough", "to die for", "kiss of death"}
    plain, kind, case, idiom, deadly, negated, edge = score(
        spark, ["it is good", "it is kind of good", "it is KIND OF good", "a cake to die for", "the kiss of death", "not to die for", "to die, for!"], info)

    def compound(s):
        return round(s / (s * s + 15) ** 0.5, 4)
    assert (plain, kind, idiom) == (compound(1.9), compound(1.9 - 0.293), compound(3.0))
    assert case == compound(1.9 - 0.293 + 0.733)              # as for single words: capitals add, whatever the sign of the booster
    assert deadly == compound(-1.5) and negated == compound(3.0 * R.NEGATION_SCALAR) and edge == compound(3.292)
    without = score(spark, ["it is kind of good", "a cake to die for"], info, phrases=False)
    assert without[0] == plain and without[1] < 0             # single words cannot see them
