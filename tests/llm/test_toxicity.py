import numpy as np

from opinio.llm import toxicity
from opinio.sources.tables import table

from .conftest import by_id


def brute_marginals(odds, trans):
    """Sum over all label paths."""
    n, num, total = len(odds), np.zeros(len(odds)), 0.0
    for path in np.ndindex(*[2] * n):
        w = np.prod([odds[i] if path[i] else 1.0 for i in range(n)])
        for i in range(n - 1):
            w *= trans[path[i], path[i + 1]]
        total += w
        num += w * np.array(path)
    return num / total


def test_marginals_equal_path_sums():
    rnd = np.random.default_rng(0)
    sizes = np.array([1, 5, 3, 7])
    odds, trans = np.exp(rnd.normal(size=sizes.sum())), np.exp(rnd.normal(size=(2, 2)))
    got, _, _ = toxicity.forward_backward(odds, sizes, trans)
    at = np.concatenate(([0], np.cumsum(sizes)))
    for a, b in zip(at, at[1:]):
        assert np.allclose(got[a:b], brute_marginals(odds[a:b], trans))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fit(docs, labels)
    held_out = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").join(labels.select("doc_id"), "doc_id", "semi")
    out = toxicity.score_texts(held_out, model).join(labels, "doc_id")
    rows = [(r.score, r.toxic) for r in out.collect()]
    toxic, clean = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert auc > 0.9
    assert sum((s >= 0.5) == bool(y) for s, y in rows) / len(rows) > 0.97
    assert all(0 <= s <= 1 for s, _ in rows)


def test_spans_are_code_points(spark):
    model = toxicity.ToxicityModel({"=vile": 20.0}, -10.0, np.ones((2, 2)), np.array([-3.0, 2.0, 4.0, 0.0]))
    df = spark.createDataFrame([(1, "é ok\nVile vile, fine vile")], "doc_id long, text string")
    r = toxicity.score_texts(df, model).first()
    assert [(s.start, s.end) for s in r.spans] == [(5, 14), (21, 25)] and r.score > 0.5


def test_edge_cases(spark, nasty, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None), (2, 0)], "doc_id long, toxic int")
    for used in (labels, labels.where("1 = 0")):
        model = toxicity.fit(nasty, used)
        got = toxicity.score_texts(nasty, model, carry=True).collect()
        assert len(got) == nasty.count() and all(0 <= r.score <= 1 for r in got)
        assert toxicity.score_texts(empty, model).count() == 0
    assert {r.doc_id for r in got if r.row.text is None} == {3, None}
    assert len(by_id(toxicity.score_texts(nasty, model))[1]) == 2
