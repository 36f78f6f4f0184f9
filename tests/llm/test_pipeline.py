from collections import Counter

import sentencepiece

import corpus_pipeline as P
from opinio.llm import toxicity
from opinio.llm.registry import SENTENCEPIECE, tokenizer_path
from opinio.sources.tables import table

from .test_decontaminate import brute as contamination
from .test_jaccard import brute as near
from .test_line_dedup import brute as lines

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_equal_brute_force(spark):
    """Each stage on its own input: the model's verdicts are the operator's, all else is brute force."""
    docs = table(spark, SF, "documents")
    kept = P.drop_toxic(spark, docs, SF).cache()
    assert kept.columns == COLUMNS
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    ids = {r.doc_id for r in docs.collect() if model.score(model.marginals([toxicity.sequences(r.text)], {})[0]) < 0.5}
    assert {r.doc_id for r in kept.collect()} == ids and len(ids) > 150
    deduped = P.drop_common_lines(spark, kept, SF).cache()
    expected = lines([(r.doc_id, r.text) for r in kept.collect()], 40, 5)
    assert deduped.columns == COLUMNS
    assert {r.doc_id: r.text for r in deduped.collect()} == {i: x[0][2] for i, x in expected.items()}
    assert all(r.n_chars == len(r.text) for r in deduped.collect())
    rows = deduped.orderBy("doc_id").collect()
    alone = P.drop_near_duplicates(spark, deduped, SF).cache()
    stays = {r.doc_id for i, (r, (_, c)) in enumerate(zip(rows, near([r.text for r in rows]))) if c == i}
    assert alone.columns == COLUMNS and {r.doc_id for r in alone.collect()} == stays
    clean = P.drop_contaminated(spark, alone, SF).cache()
    items = [(str(r.item_id), r.text) for r in table(spark, SF, "benchmark").collect()]
    expected = set()
    for r in alone.collect():
        n, hit, _ = contamination(r.text, items, 13)
        if not (hit and 20 * hit >= n):
            expected.add(r.doc_id)
    assert clean.columns == COLUMNS and {r.doc_id for r in clean.collect()} == expected
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(SENTENCEPIECE))
    out = P.tokenise(spark, clean, SF).collect()
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert all(r.ids == library.encode(texts[r.doc_id]) and r.decoded == texts[r.doc_id] for r in out)
    assert sorted(r.doc_id for r in P.run(spark, SF).collect()) == sorted(expected)


def test_edge_cases(spark, nasty, empty):
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0
        out = stage(spark, nasty, SF)
        assert out.columns == nasty.columns or stage is P.tokenise
        assert out.count() > 0
    stays = Counter(r.doc_id for r in P.drop_near_duplicates(spark, nasty, SF).collect())
    # rows 1, 1, 2, 9 are one group; rows without an id stay
    assert stays == {1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, None: 2}
    unchanged = {(r.doc_id, r.text, r.row, r.th) for r in P.drop_common_lines(spark, nasty, SF).collect()}
    assert unchanged == {(r.doc_id, r.text, r.row, r.th) for r in nasty.collect()}


def test_unlike_texts_with_one_id_both_stay(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    rows = [(1, one), (1, two), (2, one + " more"), (3, two + " more"), (1, one), (None, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in P.drop_near_duplicates(spark, docs, SF).collect())
    assert got == {(1, one): 1, (1, two): 1, (None, two): 1}
