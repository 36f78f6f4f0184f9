from pyspark.sql import functions as F

from opinio.operators import ngrams as N


def test_ngram_totals_and_guard(spark):
    texts = ["one", "a b c d", "alpha beta gamma delta epsilon", "the of alpha the beta", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    stop = ["the", "of"]
    for n in (1, 2, 3):
        total = N.ngram_counts(df, "t", n, stop).agg(F.sum("count")).collect()[0][0] or 0
        import re
        sizes = [len([w for w in re.findall(r"\w{2,}", t.lower()) if w not in stop]) for t in texts]
        assert total == sum(max(0, s - n + 1) for s in sizes)
    # stop words removed before forming n-grams: the bigram bridges them
    top = N.top_ngrams(df, "t", 2, stop).collect()
    assert ("alpha beta", 2) in [(r["ngram"], r["count"]) for r in top]


def test_top_per_group(spark):
    df = spark.createDataFrame([("g1", "aa bb aa bb cc"), ("g2", "dd ee")], "g string, t string")
    out = N.top_ngrams_per_group(df, "t", 1, [], 1, ["g"]).collect()
    assert sorted((r["g"], r["ngram"], r["count"]) for r in out) == [("g1", "aa", 2), ("g2", "dd", 1)]


def test_word_frequencies_weight(spark):
    df = spark.createDataFrame([("aa aa aa bb",), ("bb cc",)], "t string")
    out = {r["word"]: r["weight"] for r in N.word_frequencies(df, "t", [], 2).collect()}
    assert out == {"aa": 1.0, "bb": round(2 / 3, 6)}


def test_heavy_words_above_the_bound_are_all_found(spark):
    """A long tail against a small sketch: whatever exceeds the bound is there, with its exact count."""
    import random
    from collections import Counter
    rnd = random.Random(3)
    words = [f"tail{rnd.randrange(4000)}" for _ in range(20_000)]
    for k in range(1, 30):
        words += [f"head{k}"] * (3000 // k)
    rnd.shuffle(words)
    df = spark.createDataFrame([(" ".join(words[i:i + 50]),) for i in range(0, len(words), 50)], "t string").repartition(6)
    count = Counter(words)
    bound = -(-len(words) * 7 // 256)                         # 192 tracked items: 256 counters
    got = {r.word: (r["count"], r.bound) for r in N.heavy_words(df, "t", [], tracked=192).collect()}
    assert got == {w: (n, bound) for w, n in count.items() if n > bound} and 2 < len(got) < 29
    assert N.heavy_words(df.where("1 = 0"), "t", []).count() == 0
