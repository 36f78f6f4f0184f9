"""Findings of round 4: the fit and the coherence at size."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.clustering import LDA
from pyspark.sql import functions as F

from opinio.operators import lookup as L
from opinio.operators import online_lda as OL
from opinio.operators import textclean as TC
from opinio.operators import topics as TP
from opinio.operators import windows as W


def _docs(spark, n=60, seed=3):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(40)])
    rows = [(f"d{i:03d}", [str(w) for w in words[rng.integers(0, 20, int(rng.integers(0, 60))) + 20 * (i % 2)]]) for i in range(n)]
    return spark.createDataFrame(rows, "doc string, tokens array<string>")


@pytest.mark.parametrize("k, passes", [(2, 1), (3, 12)])
def test_fit_is_spark_mls(spark, k, passes):
    """The fit does not run through Spark ML's optimiser any more, and gives its model."""
    terms, vec = TP.vectorize(_docs(spark))
    lda = LDA(k=k, maxIter=passes, seed=42, optimizer="online", subsamplingRate=1.0)
    want, got = lda.fit(vec.select("features")), TP.fit_lda(vec, k, passes, 42)
    assert np.allclose(got.topicsMatrix().toArray(), want.topicsMatrix().toArray(), rtol=1e-5)
    assert np.allclose(got.estimatedDocConcentration().toArray(), want.estimatedDocConcentration().toArray(), rtol=1e-6)
    assert got.vocabSize() == want.vocabSize() and abs(got.logLikelihood(vec) / want.logLikelihood(vec) - 1) < 1e-6
    theta = [[r.theta for r in TP.doc_topics(m, vec, "doc").orderBy("doc").collect()] for m in (got, want)]
    assert np.allclose(*theta, atol=1e-5)


def test_fit_does_not_use_the_rows_of_spark_ml(spark, monkeypatch):
    _, vec = TP.vectorize(_docs(spark, 10))
    monkeypatch.setattr(LDA, "fit", lambda *a: pytest.fail("one document after the other"))
    assert TP.fit_lda(vec, 2, 1, 1).vocabSize() > 0


def test_documents_side_by_side_are_inferred_as_alone():
    rng = np.random.default_rng(4)
    length = rng.integers(1, 30, 50)
    begin = np.cumsum(length) - length
    terms = np.concatenate([rng.choice(100, n, replace=False) for n in length]).astype(np.int32)
    counts = rng.integers(1, 5, len(terms)).astype(float)
    beta, alpha, start = rng.random((3, 100)), np.array([.2, .5, .3]), OL.gamma_draws(1 << 40, 3)
    blocks, OL.BLOCK = OL.BLOCK, 400                          # several blocks, whose rests meet
    try:
        gamma, theta = OL.infer(terms, counts, begin, length, beta, alpha, start)
    finally:
        OL.BLOCK = blocks
    for d in range(len(length)):
        own = slice(begin[d], begin[d] + length[d])
        g, b = start.copy(), beta[:, terms[own]]
        t, change = np.exp(OL.expectation(g[:, None])[:, 0]), 1.0
        while change > 1e-3:
            new = t * (b @ (counts[own] / (t @ b + 1e-100))) + alpha
            change, g, t = np.abs(new - g).sum() / 3, new, np.exp(OL.expectation(new[:, None])[:, 0])
        assert np.allclose(gamma[:, d], g) and np.allclose(theta[:, d], t)


def _brute(docs, words, window):
    """Windows per word, per pair and in all; rows of one key lie over each other."""
    single, pair, total = {w: 0 for w in words}, {}, 0
    for rows in docs.values():
        held = [[set(r[s:s + window]) & set(words) for s in range(max(len(r) - window + 1, 1))] for r in rows]
        if any(set(r) & set(words) for r in rows):
            total += sum(map(len, held))
        for s in range(max(map(len, held))):
            seen = sorted(set().union(*(h[s] for h in held if s < len(h))))
            for i, a in enumerate(seen):
                single[a] += 1
                for b in seen[i + 1:]:
                    pair[a, b] = pair.get((a, b), 0) + 1
    return single, pair, total


def test_window_counts_of_repeated_keys_and_long_rows(spark):
    rng = np.random.default_rng(8)
    docs = {f"k{i}": [[f"v{x}" for x in rng.integers(0, 9, int(n))] for n in rng.integers(0, 40, 1 + (i % 3 == 0))] for i in range(30)}
    table = spark.createDataFrame([(k, r) for k, rs in docs.items() for r in rs], "doc string, tokens array<string>")
    words = ["v0", "v1", "v2", "v3"]
    got = {(r.wi, r.wj): r.n for r in W.window_counts(table, "doc", "tokens", [words], 7).collect()}
    single, pair, total = _brute(docs, words, 7)
    assert got == {(w, None): n for w, n in single.items() if n} | pair | {(None, None): total}


def test_starts_are_counted_in_slices_and_keys_over_batches(monkeypatch):
    rng = np.random.default_rng(9)
    docs = {f"k{i}": [[f"v{x}" for x in rng.integers(0, 6, int(n))] for n in rng.integers(1, 30, 1 + i % 4)] for i in range(12)}
    words = ["v0", "v1", "v2"]
    rows = []
    for key, some in docs.items():
        for r in some:
            at = [i for i, w in enumerate(r) if w in words]
            rows.append((key, len(r), np.array([words.index(r[i]) for i in at], "<i4").tobytes(), np.array(at, "<i4").tobytes()))
    schema = pa.schema([("key", pa.string()), ("n", pa.int64()), ("word", pa.binary()), ("place", pa.binary())])
    single, pair, total = _brute(docs, words, 5)
    for batch in (1, 2, 5, len(rows)):
        monkeypatch.setattr(W, "SLICE", 20 * batch)
        counts = W._Counts(3, [np.arange(3)], 5)
        batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[x:x + batch]), schema)], schema=schema)
                   for x in range(0, len(rows), batch)]
        for t, begin in W._groups(iter(batches)):
            counts.add(t, begin, True)
        assert dict(zip(words, counts.single.tolist())) == single and counts.windows == total
        assert {(words[i], words[j]): counts.pairs[0][i, j] for i in range(3) for j in range(i + 1, 3)} == pair


def test_coherence_shuffles_places_only(spark):
    docs = _docs(spark)
    topics = spark.createDataFrame([(0, "w1"), (0, "w2"), (1, "w30")], "topic int, term string")
    plan = W.window_counts(docs, "doc", "tokens", [["w1", "w2"], ["w30"]], 5)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(key") == 1
    got = TP.coherence_cv(docs, "doc", "tokens", topics, window=5)
    assert got.count() == 2 and got.where(F.col("coherence").isNull()).count() == 0


def test_words_are_corrected_in_the_row_by_a_sent_table(spark, monkeypatch):
    """Corrections beyond a literal do not take the texts apart; row, sent table and join give the same."""
    df = spark.createDataFrame([("a", "helo Wrld  fine helo"), ("b", None), ("c", "qqqqqqqq"), ("d", "")], "k string, t string")
    words = spark.createDataFrame([("hello", 3), ("world", 1), ("fine", 2)], "word string, freq long")

    def rows():
        out = TC.correct_words(df, "k", "t", words)
        return sorted(map(tuple, out.collect()), key=str), out._jdf.queryExecution().executedPlan().toString()
    literal, _ = rows()
    monkeypatch.setattr(TC, "word_lookup", lambda *a, **k: None)
    sent, plan = rows()
    assert "ArrowEvalPython" in plan and "Exchange" not in plan and "Generate" not in plan
    monkeypatch.setattr(TC, "word_replacer", lambda *a, **k: None)
    joined, _ = rows()
    assert literal == sent == joined and ("a", "hello world fine hello") in sent


def test_lists_are_replaced_in_parts(spark, monkeypatch):
    rows = [["a", "b", None], None, [], ["c", "a"], ["b"] * 5]
    tokens = pa.array(rows, pa.list_(pa.string()))
    for n in (1, 3, 100):
        monkeypatch.setattr(L, "WORDS_AT_ONCE", n)
        got = L.replaced(tokens, tokens, pa.array(["a", "c"]), pa.array(["A", "x"]))
        assert got.to_pylist() == [["A", "b", None], None, [], ["x", "A"], ["b"] * 5]
        assert L.replaced(tokens.slice(3), tokens.slice(3), pa.array(["a"]), pa.array(["A"])).to_pylist() == [["c", "A"], ["b"] * 5]
    table = spark.createDataFrame([("a", "A"), ("c", "x")], "k string, v string")
    assert L.word_replacer(table, "k", "v", most=1) is None and L.word_replacer(table, "k", "v", most=2) is not None


def test_chain_filters_the_words_it_has(spark, monkeypatch):
    texts = ["The CAT, sat\ton zz the  mat!", "", None, "zz yy 12", "the", " @x http://a.b Mat"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    words = spark.createDataFrame([("Cat",), ("mat",), ("on",), (None,), ("cat",)], "word string")

    def rows():
        return sorted(map(tuple, TC.clean_chain(df, "k", "t", ["the"], words, order=order).collect()))
    for order in ("reference", "urls_first"):
        with monkeypatch.context() as m:
            fused = rows()
            plan = TC.clean_chain(df, "k", "t", ["the"], words, order=order)._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("split(") == 1 and "Generate" not in plan
            lookup = TC.word_lookup
            m.setattr(TC, "word_lookup", lambda *a, known=False, **k: None if known else lookup(*a, **k))
            in_row = rows()
            m.setattr(TC, "word_lookup", lambda *a, **k: None)
            assert fused == in_row == rows()
        assert [r[2] for r in fused][:3] == ["CAT on mat", "", ""]
