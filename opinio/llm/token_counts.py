"""Token counts without tokens: a Viterbi pass that carries only score and count.

An Aho-Corasick automaton over the vocabulary enumerates all pieces that occur
in a unit (a word with its leading spaces); dynamic programming over the end
positions carries the best score and the number of pieces.  The tie rules are
the tokenizer's own: for a unigram model the longer piece wins among equal
float32 scores; for a BPE model exactly one piece can end at a position, the
one that stays apart from its predecessor (see ``pieces``).  Counts equal the
length of the library's encoding.

Defined cases: a null or empty text has no tokens; an unknown character counts
its UTF-8 bytes; every input row gives one row, repeated rows alike; very long texts and words are counted
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import narrow, strings
from .pieces import _NEVER, SPACE, PieceModel

#: units and neighbour pairs remembered by a Python worker; beyond it the memory starts anew
MAX_UNITS = 1_000_000
MAX_PAIRS = 4_000_000


class Counter:
    def __init__(self, model: PieceModel):
        self.model = model
        self.matches = ahocorasick.Automaton()
        for p, i in model.ids.items():
            if model.usable[i]:
                self.matches.add_word(p.replace(SPACE, " "), (len(p), i))
        if model.ids:
            self.matches.make_automaton()
        self.known: dict[str, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        if model.bpe:
            self.rank = dict(zip(model.pair_keys.tolist(), model.pair_rank.tolist()))
            self.right = [list(zip(*x)) for x in model.right.transpose(1, 0, 2).tolist()]
            self.left = [list(zip(*x)) for x in model.left.transpose(1, 0, 2).tolist()]

    def _apart(self, a: int, b: int) -> bool:
        """Whether pieces a, b stay two pieces when encoded together (remembered)."""
        key = a * (self.model.size + 1) + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._stay(self.right[a], self.left[b])
        return known

    def _stay(self, right, left) -> bool:
        i = j = 0
        now = -1
        while True:
            u, u_end, u_rank = right[i]
            v, v_end, v_rank = left[j]
            rank = self.rank.get(u * (self.model.size + 1) + v)
            first = u_end <= v_end
            if rank is not None:
                if first and rank < (u_end if u_end > now else u_rank):
                    return False
                if not first and rank <= (v_end if v_end > now else v_rank):
                    return False
            if u_end == v_end == _NEVER:
                return True
            now = u_end if first else v_end
            if first:
                i += 1
            else:
                j += 1

    def unit(self, text: str) -> tuple[int, int]:
        """(pieces, of them byte pieces) of one unit."""
        size, unk = len(text), self.model.unk
        by_end: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
        if len(self.matches):
            for end, match in self.matches.iter(text):        # longest first at each end
                by_end[end + 1].append(match)
        return self._bpe(text, by_end, unk) if self.model.bpe else self._unigram(text, by_end, unk)

    def _bpe(self, text, by_end, unk):
        last, count, raw = [unk] * (len(text) + 1), [0] * (len(text) + 1), [0] * (len(text) + 1)
        apart = self._apart
        for e in range(1, len(text) + 1):
            for k, i in by_end[e]:
                s = e - k
                if s == 0 or apart(last[s], i):
                    last[e], count[e], raw[e] = i, count[s] + 1, raw[s]
                    break
            else:
                n = len(text[e - 1].encode("utf-8", "replace"))
                count[e], raw[e] = count[e - 1] + n, raw[e - 1] + n
        return count[-1], raw[-1]

    def _unigram(self, text, by_end, unk):
        scores, low = self.model.scores, np.float32(-np.inf)
        best = [np.float32(0)] * (len(text) + 1)
        count, raw = [0] * (len(text) + 1), [0] * (len(text) + 1)
        for e in range(1, len(text) + 1):
            top, single = low, False
            for k, i in by_end[e]:
                single = single or k == 1
                value = best[e - k] + scores[i]
                if value > top:
                    top, count[e], raw[e] = value, count[e - k] + 1, raw[e - k]
            if not single and (value := best[e - 1] + scores[unk]) > top:
                n = len(text[e - 1].encode("utf-8", "replace"))
                top, count[e], raw[e] = value, count[e - 1] + n, raw[e - 1] + n
            best[e] = top
        return count[-1], raw[-1]

    def count(self, text: str) -> tuple[int, int]:
        known, n, raw = self.known, 0, 0
        for u in self.model.units(text):
            c = known.get(u)
            if c is None:
                if len(known) > MAX_UNITS:
                    known.clear()
                c = known[u] = self.unit(u)
            n += c[0]
            raw += c[1]
        return n, raw


def _counter(model: PieceModel) -> Counter:
    """One counter per Python worker (the broadcast model is one object there)."""
    if not hasattr(model, "counter"):
        model.counter = Counter(model)
    return model.counter


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_byte_tokens``, one row per input row."""
    source = narrow(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(PieceModel(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for b in batches:
            rows = [counter.count(t) for t in strings(b)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1))],
                names=["doc_id", "n_tokens", "n_byte_tokens"])

    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_byte_tokens long")
