import random

import pytest

from opinio.llm import decontaminate

from .conftest import by_id


def words(t):
    return decontaminate.words_of((t or "").encode())


def brute(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(window, len(x))
        for j in range(len(x) - n + 1 if x else 0):
            for i in range(len(w) - n + 1):
                if w[i:i + n] == x[j:j + n]:
                    hit.update(range(i, i + n))
                    found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("max_words", [1 << 21, 30])
def test_equals_brute_force(spark, monkeypatch, max_words):
    if max_words == 30:
        monkeypatch.setattr(decontaminate, "CHUNK_WORDS", 11)  # items in several chunks and shards
    rnd = random.Random(max_words)
    def draw(n):
        return " ".join(rnd.choice("ab") for _ in range(n))
    items = [(str(i), draw(rnd.choice([0, 1, 2, 4, 6, 12, 30]) if i else 7)) for i in range(9)]
    texts = [draw(rnd.randrange(60)) + rnd.choice(["", ". B,A", " é zz "]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(df, bench, window=5, max_words=max_words).collect()}
    for i, t in enumerate(texts):
        n, hit, found = brute(t, items, 5)
        r = got[i]
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, found)
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


def test_spans_and_removal(spark):
    bench = spark.createDataFrame([(1, "one two three four"), (2, "x")], "item_id long, text string")
    df = spark.createDataFrame([(1, "É, ONE two; three-four! end X.")], "doc_id long, text string")
    found = decontaminate.contamination(df, bench, window=3, with_text=True)
    r = decontaminate.remove_spans(found, max_span_words=2).first()
    assert [(s.start, s.end) for s in r.char_spans] == [(3, 22), (28, 29)]
    assert r["items"] == ["1", "2"] and r.clean_text == "É, ! end X."


def test_edge_cases(spark, nasty, empty):
    bench = spark.createDataFrame([(1, "three four five six seven"), (1, "three four five six seven"), (None, "w1 w2 w3"),
                                   (3, None), (4, "")], "item_id long, text string")
    got = by_id(decontaminate.contamination(nasty, bench, window=4, carry=True))
    assert sum(map(len, got.values())) == nasty.count()
    assert got[1][0]["items"] == ["1"] and got[1][0].contaminated and len(got[1]) == 2
    assert got[6][0]["items"] == [""] and got[3][0].n_words == 0 and not got[3][0].contaminated
    assert not any(r.contaminated for r in decontaminate.contamination(nasty, bench.where("1 = 0")).collect())
    assert decontaminate.contamination(empty, bench).count() == 0
