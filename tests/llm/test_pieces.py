import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from opinio.llm import spm, token_counts
from opinio.llm.pieces import PieceModel
from opinio.llm.registry import SENTENCEPIECE, tokenizer_path

from .conftest import by_id

PARTS = ["the", "th", "e", "t", "h", " ", "  ", "\n", "in", "g", "ing", "a", "aa", "é", "ü", "日", "\U0001F600", "\x00", "\t",
         ".", "...", "==", "====", "1", "23", "ion", "er", "re", "▁", "ab", "st", "str"]


def texts(n, seed=2):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(40))) for _ in range(n)] + ["", " " * 100, "a" * 2000]


@pytest.fixture(scope="module", params=["bpe", "unigram"])
def model_file(request, tmp_path_factory):
    path = tokenizer_path(SENTENCEPIECE)
    if request.param == "bpe":
        return path
    proto = pb.ModelProto()                                   # the same pieces as a unigram model, with many ties
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for i, p in enumerate(proto.pieces):
        if p.type == pb.ModelProto.SentencePiece.NORMAL:
            p.score = -(4 + (i - 259) // 64 / 64)
    out = tmp_path_factory.mktemp("model") / "unigram.model"
    out.write_bytes(proto.SerializeToString())
    return str(out)


def test_ids_and_counts_equal_the_library(model_file):
    library = sentencepiece.SentencePieceProcessor(model_file=model_file)
    model = PieceModel(model_file)
    rows = texts(3000)
    expected = library.encode(rows)
    ids, n = spm.Encoder(model).encode(rows)
    ends = np.concatenate(([0], np.cumsum(n)))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == expected
    counter = token_counts.Counter(model)
    assert [counter.count(t)[0] for t in rows] == [len(x) for x in expected]
    assert [spm.decode(np.array(x, dtype=np.int64), model) for x in expected] == [t.replace("▁", " ") for t in rows]


def test_registered_forms(nasty, empty):
    path = tokenizer_path(SENTENCEPIECE)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    out = spm.encode_texts(nasty, path, with_text=True, carry=True).collect()
    assert len(out) == nasty.count()
    for r in out:
        text = r.row.text or ""
        assert r.ids == library.encode(text) and r.text == text.replace("▁", " ")
    counts = by_id(token_counts.count_tokens(nasty, path))
    for r in out:
        assert all(c.n_tokens == len(library.encode(r.row.text or "")) for c in counts[r.doc_id]) or r.doc_id is None
    back = by_id(spm.decode_ids(spm.encode_texts(nasty, path), path))
    assert back[8][0].text == "a" and back[3][0].text == ""
    assert spm.encode_texts(empty, path).count() == 0 and token_counts.count_tokens(empty, path).count() == 0


def test_memory_starts_anew(monkeypatch):
    model = PieceModel(tokenizer_path(SENTENCEPIECE))
    monkeypatch.setattr(spm, "MAX_UNITS", 5)
    encoder, rows = spm.Encoder(model), texts(50)
    for t in rows:
        ids, _ = encoder.encode([t])
        again, _ = spm.Encoder(model).encode([t])
        assert ids.tolist() == again.tolist()
