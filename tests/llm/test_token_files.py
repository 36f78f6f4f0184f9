import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from opinio.llm import token_files
from opinio.llm.common import shared_folder
from opinio.llm.registry import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_unit_encoding_equals_the_library(library):
    rnd = random.Random(3)
    parts = ["the", "'s", "'ll", "t", "h", " ", "  ", "\n", "\n\n", "in", "é", "日", "\U0001F600", "\x00", "\t", "\r", ".", "==", "23",
             "\u00a0", "\u3000", "\x1c", "\x85", "\u200b", "<|endoftext|>", "ab ", "'S"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(3000)] + ["", " ", "a" * 3000]
    with open(PATH, encoding="utf-8") as f:
        encoder = token_files.UnitEncoder(f.read())
    got = [x.tolist() for x in encoder.encode(texts)]
    assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_special_token_strings_equal_the_plain_library_call():
    rnd = random.Random(4)
    parts = ["<|endoftext|>", "<|endoftext|>", "<|endoftext", "|>", "the", "'s", " ", "  ", "\n", "\n\n", "\t", "é", ".", "23", "\u00a0"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(20))) for _ in range(3000)] + ["a <|endoftext|> b"]
    with open(PATH, encoding="utf-8") as f:
        encoder = token_files.UnitEncoder(f.read(), added=True)
    got = [x.tolist() for x in encoder.encode(texts)]
    assert got[-1] == [64, 220, 50256, 275]
    assert got == [x.ids for x in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_grammar_round_trip_and_random_access():
    rnd = np.random.default_rng(1)
    docs = [np.concatenate([rnd.integers(1, 6, rnd.integers(0, 400)), [0]]).astype(np.uint32) for _ in range(50)]
    tokens = np.concatenate(docs)
    batch = token_files._shard_row(0, 0, list(range(50)), docs, 10).to_pylist()[0]
    assert len(batch["symbols"]) < 4 * len(tokens) / 2        # it does compress
    shard = token_files.Shard(batch, 10)
    for k in (0, 7, 49):
        assert (shard.document(k) == docs[k]).all()
    assert (shard.expand(shard.symbols) == tokens).all()
    for a, b in ((0, 1), (5, 300), (len(tokens) - 3, len(tokens))):
        assert (shard.tokens(a, b) == tokens[a:b]).all()


def test_grammar_replaces_until_no_frequent_pair_is_left():
    rnd = np.random.default_rng(2)
    passage = rnd.integers(1, 50_000, 300)
    docs = [np.concatenate([rnd.integers(1, 50_000, rnd.integers(0, 9)), passage, [0]]).astype(np.uint32) for _ in range(400)]
    docs += [np.array([7] * 5000 + [0], np.uint32), np.array([0], np.uint32)]
    tokens = np.concatenate(docs)
    row = token_files._shard_row(0, 0, list(range(len(docs))), docs, 50_257).to_pylist()[0]
    shard = token_files.Shard(row, 50_257)
    assert shard.lengths.max() > 256                          # two rounds end at 4
    assert len(shard.symbols) * 15 < len(tokens)
    last = np.zeros(len(shard.symbols), bool)
    last[np.concatenate((shard.places[1:] - 1, [-1]))] = True
    pairs = (shard.symbols[:-1].astype(np.uint64) << np.uint64(32)) | shard.symbols[1:]
    assert np.unique(pairs[~last[:-1]], return_counts=True)[1].max() < token_files.LEAST_COUNT
    assert (shard.expand(shard.symbols) == tokens).all()
    for k in (0, 399, 400, 401):
        assert (shard.document(k) == docs[k]).all()
    assert (shard.tokens(1000, 90_000) == tokens[1000:90_000]).all()


@pytest.mark.parametrize("size", [token_files.SHARD_TOKENS, 50])
def test_files_round_trip(spark, nasty, library, size):
    folder = shared_folder(spark, "files")
    base = token_files.write_token_files(nasty, folder, PATH, shard_tokens=size)
    got = token_files.read_documents(spark, folder, base).orderBy("start").collect()
    rows = nasty.collect()
    assert len(got) == len(rows)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    expected = sorted([library.encode(r.text or "", add_special_tokens=False).ids + [0] for r in rows])
    assert sorted(r.ids for r in got) == expected


def test_files_hold_the_ids_of_special_tokens(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x\n<|endoftext|>\ny", "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = shared_folder(spark, "files")
    base = token_files.write_token_files(docs, folder, PATH)
    got = [r.ids for r in token_files.read_documents(spark, folder, base).orderBy("start").collect()]
    plain = Tokenizer.from_file(PATH)
    assert got == [plain.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_empty_table(spark, empty):
    folder = shared_folder(spark, "files")
    base = token_files.write_token_files(empty, folder, PATH)
    assert token_files.read_documents(spark, folder, base).count() == 0


def test_places_of_pairs_that_share_a_bin():
    """Pairs are found by their bins; only keys of bins that several pairs share are searched for."""
    rnd = np.random.default_rng(6)
    pairs = np.unique(rnd.integers(0, 1 << 60, 300).astype(np.uint64))
    key = rnd.permutation(np.concatenate([np.repeat(pairs, 3), rnd.integers(0, 1 << 60, 500).astype(np.uint64)]))
    for bits in (18, 4):                                      # hardly any and almost only shared bins
        place = token_files._places(pairs, key, token_files._bins(key, bits), bits)
        there = np.isin(key, pairs)
        assert (pairs[place[there]] == key[there]).all() and (pairs[place[~there]] != key[~there]).all()
