import math

import numpy as np
from pyspark.sql import functions as F

from opinio.operators import topics as TP


def test_tokens(spark):
    df = spark.createDataFrame([("Café naïve_x _under a bb 42abc ccccccccccccccccc the",)], "t string")
    got = df.select(TP.topic_tokens(F.col("t"), ["the"]).alias("v")).collect()[0]["v"]
    assert got == ["cafe", "naive_x", "bb", "abc"]


def test_accents_of_every_script_and_word_files(spark, tmp_path):
    df = spark.createDataFrame([("Tiếng Việt e\u0301te\u0301 Ωμέγα йод",)], "t string")
    assert df.select(TP.topic_tokens(F.col("t"), []).alias("v")).first()["v"] == ["tieng", "viet", "ete", "ωμεγα", "иод"]
    (tmp_path / "stop.txt").write_text("The\n# comment\n\nthe\nof\n", encoding="utf-8")
    assert TP.read_word_list(spark, str(tmp_path / "stop.txt")) == ["of", "the"]
    (tmp_path / "lemmas.tsv").write_text("cats\tcat\nmice\tmouse\n", encoding="utf-8")
    docs = spark.createDataFrame([("1", ["mice", "eat", "cats"]), ("2", [])], "k string, tokens array<string>")
    got = {r["k"]: r["tokens"] for r in TP.lemmatize(docs, "k", "tokens", TP.read_lemmas(spark, str(tmp_path / "lemmas.tsv"))).collect()}
    assert got == {"1": ["mouse", "eat", "cat"], "2": []}


def test_dense_index(spark):
    df = spark.createDataFrame([(w,) for w in ["d", "b", "a", "c", "e", "f"]], "w string")
    got = {r["w"]: r["i"] for r in TP.dense_index(df, "w", "i", 3).collect()}
    assert got == {w: i for i, w in enumerate(sorted(got))}


def _py_cv(texts, topics, window=110):
    eps = 1e-12
    words = sorted({w for t in topics for w in t})
    windows = []
    for t in texts:
        if not any(w in words for w in t):
            continue
        if len(t) < window:
            windows.append(set(t))
        else:
            windows += [set(t[s:s + window]) for s in range(len(t) - window + 1)]
    n = len(windows)
    cnt = {w: sum(w in win for win in windows) for w in words}
    co = lambda a, b: cnt[a] if a == b else sum((a in win) and (b in win) for win in windows)
    out = []
    for top in topics:
        npmi = {(a, b): math.log((co(a, b) / n + eps) / ((cnt[a] / n) * (cnt[b] / n))) / -math.log(co(a, b) / n + eps)
                for a in top for b in top}
        star = np.array([sum(npmi[(a, b)] for a in top) for b in top])
        sims = []
        for a in top:
            v = np.array([npmi[(a, b)] for b in top])
            sims.append(float(v @ star / (np.linalg.norm(v) * np.linalg.norm(star))))
        out.append(sum(sims) / len(sims))
    return out


def test_coherence_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vocab = ["a%d" % i for i in range(12)]
    texts = [list(rng.choice(vocab, size=int(rng.integers(3, 30)))) for _ in range(25)] + [["zz", "yy"]]
    topics = [["a0", "a1", "a2"], ["a3", "a4", "a5", "a6"]]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc string, tokens array<string>")
    terms = spark.createDataFrame([(k, w) for k, t in enumerate(topics) for w in t], "topic int, term string")
    got = {r["topic"]: r["coherence"] for r in TP.coherence_cv(docs, "doc", "tokens", terms, window=10).collect()}
    want = _py_cv(texts, topics, window=10)
    for k in range(2):
        assert abs(got[k] - want[k]) < 1e-9


def test_lda_two_topics(spark):
    docs = spark.createDataFrame(
        [(str(i), (["apple", "banana", "cherry"] if i % 2 else ["engine", "wheel", "brake"]) * 5) for i in range(20)],
        "doc string, tokens array<string>")
    terms, vec = TP.vectorize(docs)
    model = TP.fit_lda(vec, 2, 20, 1)
    top = TP.topic_terms(model, terms, 3).collect()
    assert sorted((r.topic, r["rank"]) for r in top) == [(k, n) for k in (0, 1) for n in range(3)]
    # all weights equal the model's topic matrix, term by term
    weights = {(r.topic, r.term): r.weight for r in TP.topic_weights(model, terms).collect()}
    matrix = model.topicsMatrix().toArray()
    matrix = matrix / matrix.sum(axis=0)
    ids = {r.token: r.token_id for r in terms.collect()}
    assert len(weights) == 12 and all(abs(w - matrix[ids[t], k]) < 1e-12 for (k, t), w in weights.items())
    assert all(abs(r.weight - weights[r.topic, r.term]) < 1e-12 for r in top)
    assert TP.perplexity(model, vec).collect()[0]["log_perplexity"] > 0
    uni = TP.unigram_topic(docs, "tokens", 2).collect()
    assert len(uni) == 2 and all(r["topic"] == 0 for r in uni)


def test_lemmatize_keeps_order(spark):
    docs = spark.createDataFrame([("1", ["cats", "ran", "cats"]), ("2", [])], "doc string, tokens array<string>")
    lem = spark.createDataFrame([("cats", "cat"), ("ran", "run")], "form string, lemma string")
    got = {r["doc"]: r["tokens"] for r in TP.lemmatize(docs, "doc", "tokens", lem).collect()}
    assert got == {"1": ["cat", "run", "cat"], "2": []}


def test_topic_overview_against_numpy(spark):
    rng = np.random.default_rng(9)
    terms = ["t%d" % i for i in range(6)]
    phi = rng.random((2, 6)); phi /= phi.sum(axis=1, keepdims=True)
    theta = rng.random((5, 2)); theta /= theta.sum(axis=1, keepdims=True)
    lens = rng.integers(1, 50, 5)
    freq = rng.integers(1, 30, 6)
    th = spark.createDataFrame([(str(d), [float(x) for x in theta[d]]) for d in range(5)], "doc string, theta array<double>")
    dl = spark.createDataFrame([(str(d), int(lens[d])) for d in range(5)], "doc string, n long")
    ph = spark.createDataFrame([(k, terms[j], float(phi[k, j])) for k in range(2) for j in range(6)],
                               "topic int, term string, weight double")
    tf = spark.createDataFrame([(terms[j], int(freq[j])) for j in range(6)], "term string, freq long")
    prev, rel, js = TP.topic_overview(th, dl, "doc", ph, tf, lam=0.6, top=3)
    mass = (theta * lens[:, None]).sum(axis=0)
    got = {r["topic"]: r["prevalence"] for r in prev.collect()}
    for k in range(2):
        assert abs(got[k] - mass[k] / mass.sum()) < 1e-12
    pw = freq / freq.sum()
    relv = 0.6 * np.log(phi) + 0.4 * np.log(phi / pw)
    for k in range(2):
        want = [terms[j] for j in np.argsort(-relv[k], kind="stable")[:3]]
        assert [r["term"] for r in rel.where(F.col("topic") == k).orderBy("rank").collect()] == want
    m = (phi[0] + phi[1]) / 2
    want_js = 0.5 * (phi[0] * np.log(phi[0] / m)).sum() + 0.5 * (phi[1] * np.log(phi[1] / m)).sum()
    assert abs(js.collect()[0]["js_divergence"] - want_js) < 1e-12


def test_coherence_of_a_word_that_no_document_holds(spark):
    docs = spark.createDataFrame([("1", ["a", "b"]), ("2", ["a"])], "doc string, tokens array<string>")
    terms = spark.createDataFrame([(0, "a"), (0, "b"), (0, "absent"), (1, "nowhere")], "topic int, term string")
    got = {r["topic"]: r["coherence"] for r in TP.coherence_cv(docs, "doc", "tokens", terms, window=2).collect()}
    assert got[1] == 0.0 and -1 <= got[0] <= 1


def test_documents_without_tokens_have_even_topics(spark):
    docs = spark.createDataFrame([("1", ["a", "b"]), ("2", []), ("3", ["a", "c"])], "doc string, tokens array<string>")
    _, vec = TP.vectorize(docs)
    got = {r["doc"]: r["theta"] for r in TP.doc_topics(TP.fit_lda(vec, 2, 2), vec, "doc").collect()}
    assert len(got) == 3 and got["2"] == [0.5, 0.5] and all(abs(sum(t) - 1) < 1e-6 for t in got.values())


def test_vectors_are_the_counts(spark):
    texts = {"1": ["b", "a", "b"], "2": [], "3": ["c", "a"], "4": ["é"] * 4}
    docs = spark.createDataFrame(list(texts.items()), "doc string, tokens array<string>")
    terms, vec = TP.vectorize(docs)
    ids = {r.token: (r.token_id, r.doc_freq, r.coll_freq) for r in terms.collect()}
    assert ids == {"a": (0, 2, 2), "b": (1, 1, 2), "c": (2, 1, 1), "é": (3, 1, 4)}
    got = {r.doc: r.features for r in vec.collect()}
    for doc, tokens in texts.items():
        assert got[doc].size == 4
        assert dict(zip(got[doc].indices.tolist(), got[doc].values.tolist())) == {ids[t][0]: tokens.count(t) for t in tokens}
    empty, none = TP.vectorize(docs.where("1 = 0"))
    assert empty.count() == 0 and none.count() == 0


def test_no_vocabulary_on_the_driver_or_broadcast(spark, monkeypatch):
    """The vocabulary is joined by a shuffle once it is not small, and only its size is ever fetched."""
    from pyspark.sql.classic.dataframe import DataFrame
    fetched = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: fetched.append(out := collect(self)) or out)
    docs = spark.createDataFrame([(str(i), [f"w{i}", f"w{i + 1}", "x"]) for i in range(500)], "doc string, tokens array<string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        terms, vec = TP.vectorize(docs)
        model = TP.fit_lda(vec, 2, 2, 1)
        plan = TP.topic_weights(model, terms)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan
        assert terms.count() == 502
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
    assert all(len(rows) <= 1 for rows in fetched)


def test_rule_lemmas(spark):
    words = ["cat", "bus", "box", "quiz", "church", "dish", "woman", "city", "cats", "class", "houses", "house", "as", "geese", "goose"]
    forms = ["cats", "buses", "boxes", "churches", "dishes", "women", "cities", "class", "houses", "unknowns", "as", "s", "geese", "cat", "men"]
    lemmas = TP.rule_lemmas(spark.createDataFrame([(f,) for f in forms + forms[:3]], "form string"),
                            spark.createDataFrame([(w,) for w in words + ["a"]], "word string"),
                            spark.createDataFrame([("geese", "goose"), ("cats", "feline")], "form string, lemma string"))
    got = {r.form: r.lemma for r in lemmas.collect()}
    # the first rule whose result is a word; irregular forms before rules; unknown words and known stems stay
    assert got == {"cats": "feline", "buses": "bus", "boxes": "box", "churches": "church", "dishes": "dish", "women": "woman",
                   "cities": "city", "houses": "house", "as": "a", "geese": "goose"}
    plain = TP.rule_lemmas(spark.createDataFrame([("cats",), ("geese",)], "form string"), spark.createDataFrame([("cat",)], "word string"))
    assert [tuple(r) for r in plain.collect()] == [("cats", "cat")]
