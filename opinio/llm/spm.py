"""SentencePiece encoding and decoding by a batched Viterbi search.

The distinct units (words with their leading spaces) of a batch are grouped by
length; all words of a length advance together, one character per step.  The
hash of every substring that ends there probes the sorted piece keys, the
candidates are scored, and a vectorised maximum stores the back pointers.  For
a unigram model the score is the sum of piece scores; for a BPE model it is 0
for an allowed transition and minus infinity otherwise (see ``pieces``), so
that the best path is the library's encoding.

Defined cases: a null or empty text has no ids; every input row gives one row;
repeated rows are encoded alike; very long texts and words are encoded whole; an empty table gives an empty
result; other columns are ignored.  ``decode`` turns ids back into the text; a literal
U+2581 comes back as a space, as in the library.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, row_type, slices, strings
from .pieces import SPACE, PieceModel, _spread

_P = np.uint64(0x100000001B3)
_BITS = 20
#: units remembered by a Python worker; beyond it the memory starts anew
MAX_UNITS = 1_000_000
#: characters of one Viterbi block
BLOCK = 1 << 21


class PieceIndex:
    """Sorted 64-bit keys of the pieces, by polynomial hash and length."""

    def __init__(self, model: PieceModel):
        keep = [(p, i) for p, i in model.ids.items() if model.usable[i]]
        hashes = []
        for p, _ in keep:
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in p:
                    h = h * _P + np.uint64(ord(c) + 1)
            hashes.append(h)
        keys = np.array(hashes, dtype=np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ids = np.array([i for _, i in keep], dtype=np.int32)[order] if keep else np.empty(0, np.int32)
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("piece keys collide; choose another multiplier")
        lengths = np.array([len(p) for p, _ in keep], dtype=np.int32)[order] if keep else np.empty(0, np.int32)
        self.lengths = lengths
        self.bits = np.zeros(1 << _BITS, dtype=bool)
        self.bits[_spread(self.keys, _BITS)] = True

    def probe(self, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, ids) of the hashes that are pieces of this length."""
        maybe = np.flatnonzero(self.bits[_spread(h, _BITS)])
        if not len(maybe) or not len(self.keys):
            return maybe[:0], self.ids[:0]
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        found = (self.keys[at] == h[maybe]) & (self.lengths[at] == length)
        return maybe[found], self.ids[at[found]]


def viterbi(words: np.ndarray, model: PieceModel, index: PieceIndex) -> tuple[np.ndarray, np.ndarray]:
    """Back pointers of equal-length words (rows of code points): the last piece of
    every prefix, and its length."""
    n, size = words.shape
    hashes = np.zeros((size + 1, n), dtype=np.uint64)
    token = np.full((size + 1, n), model.unk, dtype=np.int32)
    length = np.ones((size + 1, n), dtype=np.int32)
    best = np.zeros((size + 1, n), dtype=np.float32)
    power = np.cumprod(np.concatenate(([1], np.full(model.max_len, _P))).astype(np.uint64), dtype=np.uint64)
    for e in range(1, size + 1):
        hashes[e] = hashes[e - 1] * _P + (words[:, e - 1].astype(np.uint64) + np.uint64(1))
        score = np.full(n, -np.inf, dtype=np.float32)
        if model.bpe:
            score[:] = -1                                     # a lone unknown character, if nothing else fits
            open_ = np.arange(n)                              # only one piece can end here: the first that fits
            for k in range(min(e, model.max_len), 0, -1):
                if not len(open_):
                    break
                at, ids = index.probe(hashes[e, open_] - hashes[e - k, open_] * power[k], k)
                if not len(at):
                    continue
                rows = open_[at]
                fits = np.ones(len(rows), dtype=bool) if e == k else model.joins(token[e - k, rows], ids)
                rows, ids = rows[fits], ids[fits]
                token[e, rows], length[e, rows], score[rows] = ids, k, 0
                open_ = np.setdiff1d(open_, rows, assume_unique=True)
        else:
            single = np.zeros(n, dtype=bool)
            for k in range(min(e, model.max_len), 0, -1):     # longest first: ties keep the earliest start
                rows, ids = index.probe(hashes[e] - hashes[e - k] * power[k], k)
                if k == 1:
                    single[rows] = True
                value = best[e - k, rows] + model.scores[ids]
                better = value > score[rows]
                rows, ids, value = rows[better], ids[better], value[better]
                token[e, rows], length[e, rows], score[rows] = ids, k, value
            value = best[e - 1] + model.scores[model.unk]
            better = ~single & (value > score)
            token[e, better], length[e, better], score[better] = model.unk, 1, value[better]
        best[e] = score
    return token, length


def _backtrack(words: np.ndarray, token: np.ndarray, length: np.ndarray, model: PieceModel):
    """(row, id) pairs in text order; an unknown character becomes its bytes."""
    n, size = words.shape
    end = np.full(n, size)
    live = np.arange(n)
    rows, ids, ends = [], [], []
    while len(live):
        e = end[live]
        rows.append(live)
        ids.append(token[e, live])
        ends.append(e)
        end[live] = e - length[e, live]
        live = live[end[live] > 0]
    row, tok, at = (np.concatenate(x) for x in (rows, ids, ends))
    order = np.lexsort((at, row))
    row, tok, at = row[order], tok[order], at[order]
    unknown = np.flatnonzero(tok == model.unk)
    if len(unknown):
        raw = [chr(words[row[u], at[u] - 1]).encode("utf-8", "replace") for u in unknown]
        reps = np.ones(len(tok), dtype=np.int64)
        reps[unknown] = [len(r) for r in raw]
        first = np.cumsum(reps) - reps
        row, tok = np.repeat(row, reps), np.repeat(tok, reps)
        for u, r in zip(unknown, raw):
            tok[first[u]:first[u] + len(r)] = model.byte_ids[list(r)]
    return row, tok


class Encoder:
    """Encodes units, remembering them: ``ids[start[u]:start[u] + count[u]]`` of unit number u."""

    def __init__(self, model: PieceModel, index: PieceIndex | None = None):
        self.model, self.index = model, index or PieceIndex(model)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.empty(0, np.int32)
        self.count = np.empty(0, np.int64)

    def _encode_new(self, units: list[str]) -> None:
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        order = np.argsort(lengths, kind="stable")
        counts = np.zeros(len(units), dtype=np.int64)
        unit_of, id_of = [], []
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for same in np.split(order, cuts):
            size = int(lengths[same[0]])
            step = max(1, BLOCK // (size + 1))
            for k in range(0, len(same), step):
                part = same[k:k + step]
                text = "".join([units[u] for u in part]).replace(" ", SPACE)
                words = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(part), size)
                row, tok = _backtrack(words, *viterbi(words, self.model, self.index), self.model)
                counts[part] = np.bincount(row, minlength=len(part))
                unit_of.append(part[row])
                id_of.append(tok)
        unit, tok = np.concatenate(unit_of), np.concatenate(id_of)
        order = np.argsort(unit, kind="stable")
        self.ids = np.concatenate([self.ids, tok[order].astype(np.int32)])
        self.count = np.concatenate([self.count, counts])

    def encode(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and the number of ids of each text."""
        if len(self.number) > MAX_UNITS:
            self._forget()
        known, codes, sizes = self.number, [], []
        for t in rows:
            u = self.model.units(t)
            codes += [known.setdefault(x, len(known)) for x in u]
            sizes.append(len(u))
        if len(known) > len(self.count):
            new = list(known)[len(self.count):]
            self._encode_new(new)
        code = np.array(codes, dtype=np.int64)
        start = np.cumsum(self.count) - self.count
        count = self.count[code] if len(code) else np.empty(0, np.int64)
        before = np.cumsum(count) - count
        ids = self.ids[np.arange(int(count.sum())) + np.repeat(start[code] - before, count)] if len(code) \
            else np.empty(0, np.int32)
        ends = np.concatenate(([0], np.cumsum(count)))
        at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        return ids, np.diff(ends[at])


def _encoder(model: PieceModel) -> Encoder:
    """One encoder per Python worker (the broadcast model is one object there), so that the units of one
    task are known to the next."""
    if not hasattr(model, "encoder"):
        model.encoder = Encoder(model)
    return model.encoder


def decode(ids: np.ndarray, model: PieceModel) -> str:
    raw = b"".join([model.decoded[i] for i in ids.tolist()])
    text = raw.decode("utf-8", "replace")
    return text[1:] if model.dummy_prefix and text.startswith(" ") else text


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 with_text: bool = False, carry: bool | list[str] = False) -> DataFrame:
    """``doc_id, ids`` (and the decoded ``text``, and the input row, if carried), one row per input row."""
    source = narrow(docs, id_col, text_col, carry)
    kind = source.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(PieceModel(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for b in (part for whole in batches for part in slices(whole, rows=1000)):
            ids, n = encoder.encode(strings(b))
            ends = np.concatenate(([0], np.cumsum(n)))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            out = [b.column(0), lists]
            if with_text:
                out.append(pa.array([decode(ids[x:y], shared.value) for x, y in zip(ends[:-1], ends[1:])], pa.string()))
            names = ["doc_id", "ids", "text"][:len(out)] + ["row"] * bool(carry)
            yield pa.RecordBatch.from_arrays([*out, *b.columns[2:]], names=names)

    return source.mapInArrow(run, f"doc_id {kind}, ids array<int>" + (", text string" if with_text else "")
                             + row_type(source))


def decode_ids(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from ids (null: empty)."""
    source = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    kind = source.schema["doc_id"].dataType.simpleString()
    shared = encoded.sparkSession.sparkContext.broadcast(PieceModel(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [decode(np.array(x, dtype=np.int64), shared.value) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return source.mapInArrow(run, f"doc_id {kind}, text string")
