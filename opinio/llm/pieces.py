"""Vocabulary of a SentencePiece model file, as tables for tasks.

The model is read once on the driver and broadcast (its size is the
vocabulary's).  Two kinds of model are supported:

* unigram: a segmentation's score is the sum of its piece scores; of equal
  scores the longer last piece wins (the library compares with ``>`` from the
  earliest start on); a character without a piece costs the least score less 10;
* BPE: the library merges the best-scored neighbours first, leftmost of equals.
  Its result is the only segmentation in which every piece is its own encoding
  and no two neighbours would have been merged across their border.  So a
  best path can be found left to right, with a transition that is either
  allowed or not.  ``joins`` tells which: from each piece's own merge history
  it knows the token at the piece's edge at any time, and looks for a moment
  at which the two edge tokens would have merged.

Text is taken as the library takes it for models without normalisation rules: a dummy space in
front, spaces written as U+2581, unknown characters as byte pieces.  A literal U+2581 in a text is a
space to the library; it decodes as one.
"""

from __future__ import annotations

import re

import numpy as np

SPACE = "▁"
_NEVER = np.iinfo(np.int32).max


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("models with normalisation rules are not supported")
        if not proto.trainer_spec.byte_fallback:
            raise ValueError("models without byte pieces are not supported")
        self.dummy_prefix = bool(norm.add_dummy_prefix)
        self.bpe = proto.trainer_spec.model_type == pb.TrainerSpec.BPE
        kinds = pb.ModelProto.SentencePiece
        self.pieces = [p.piece for p in proto.pieces]
        self.size = len(self.pieces)
        self.unk = self.size                                  # code of a character without a piece
        self.byte_ids = np.zeros(256, dtype=np.int32)
        self.ids: dict[str, int] = {}
        self.scores = np.zeros(self.size + 1, dtype=np.float32)
        self.decoded: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            self.decoded.append(p.piece.replace(SPACE, " ").encode() if p.type == kinds.NORMAL else b"")
            if p.type == kinds.NORMAL:
                self.ids[p.piece] = i
                self.scores[i] = p.score
            elif p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value] = i
                self.decoded[i] = bytes([value])
            elif p.type == kinds.USER_DEFINED:
                raise ValueError("models with user-defined pieces are not supported")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("models with pieces across words are not supported")
        normal = [i for i in self.ids.values()]
        self.scores[self.unk] = min((self.scores[i] for i in normal), default=np.float32(0)) - np.float32(10)
        self.max_len = max(map(len, self.ids), default=1)
        #: line ends that no piece holds may cut the text
        self.cut_lines = not any("\n" in p for p in self.ids)
        self.rank = np.full(self.size + 1, _NEVER, dtype=np.int32)
        for k, i in enumerate(sorted(normal, key=lambda i: (-self.scores[i], i))):
            self.rank[i] = k
        self.usable = np.ones(self.size + 1, dtype=bool)      # pieces that are their own encoding
        if self.bpe:
            self._histories()

    # -- BPE ---------------------------------------------------------------
    def _merges(self, piece: str):
        """Merge the piece's characters as the library does.  Gives the parts left
        and the events ``(rank, left edge token, right edge token)`` in order."""
        ids, rank = self.ids, self.rank
        parts = list(piece)
        edge = lambda x: ids.get(x, self.unk)                 # noqa: E731
        events = []
        while len(parts) > 1:
            best, at = _NEVER, -1
            for i in range(len(parts) - 1):
                t = ids.get(parts[i] + parts[i + 1])
                if t is not None and rank[t] < best:
                    best, at = rank[t], i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            events.append((int(best), edge(parts[0]), edge(parts[-1])))
        return parts, events

    def _histories(self) -> None:
        """Tokens at both edges of each piece over its merge history.

        Time is the largest rank so far: merges of two neighbouring pieces
        interleave by it.  Per token: until when it stands at the edge, and the
        rank of the merge that ends it."""
        left, right = {}, {}
        for piece, i in self.ids.items():
            parts, events = self._merges(piece)
            if len(parts) > 1:
                self.usable[i] = False
                continue
            for side, out, first in ((1, left, piece[0]), (2, right, piece[-1])):
                token, time, hist = self.ids.get(first, self.unk), -1, []
                for e in events:
                    time = max(time, e[0])
                    if e[side] != token:
                        hist.append((token, time, e[0]))
                        token = e[side]
                out[i] = [*hist, (token, _NEVER, _NEVER)]
        out_unk = [(self.unk, _NEVER, _NEVER)]
        depth = max(len(h) for h in [*left.values(), *right.values(), out_unk])
        self.left = self._table(left, depth)
        self.right = self._table(right, depth)
        pairs = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a * (self.size + 1) + b] = int(self.rank[i])
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int32)
        self.pair_bits = np.zeros(1 << 22, dtype=bool)
        self.pair_bits[_spread(self.pair_keys, 22)] = True

    def _table(self, hist: dict, depth: int) -> np.ndarray:
        out = np.full((3, self.size + 1, depth), _NEVER, dtype=np.int32)
        out[0] = self.unk
        for i, h in hist.items():
            out[:, i, :len(h)] = np.array(h).T
        return out

    def _rank_of_pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * (self.size + 1) + b
        out = np.full(len(key), _NEVER, dtype=np.int32)
        maybe = np.flatnonzero(self.pair_bits[_spread(key, 22)])
        if len(maybe) and len(self.pair_keys):
            at = np.minimum(np.searchsorted(self.pair_keys, key[maybe]), len(self.pair_keys) - 1)
            found = self.pair_keys[at] == key[maybe]
            out[maybe[found]] = self.pair_rank[at[found]]
        return out

    def joins(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces ``a[k] b[k]`` stay two pieces when encoded together."""
        ok = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        i = np.zeros(len(a), dtype=np.int64)
        j = np.zeros(len(a), dtype=np.int64)
        since = np.full(len(a), -1, dtype=np.int32)
        right, left = self.right, self.left
        while len(live):
            x, y, p, q = a[live], b[live], i[live], j[live]
            u, u_end, u_rank = right[0, x, p], right[1, x, p], right[2, x, p]
            v, v_end, v_rank = left[0, y, q], left[1, y, q], left[2, y, q]
            r = self._rank_of_pair(u, v)
            now = since[live]
            first = u_end <= v_end                            # equal ranks: the left merge goes first
            bound = np.where(first, np.where(u_end > now, u_end, u_rank), np.where(v_end > now, v_end, v_rank))
            merged = (r != _NEVER) & np.where(first, r < bound, r <= bound)
            ok[live[merged]] = False
            on = ~merged & ((u_end != _NEVER) | (v_end != _NEVER))
            since[live] = np.where(first, u_end, v_end)
            i[live[on & first]] += 1
            j[live[on & ~first]] += 1
            live = live[on]
        return ok

    # -- text --------------------------------------------------------------
    def units(self, text: str) -> list[str]:
        """Parts of the text whose encodings do not depend on each other; joined they are the
        library's normalised text (spaces stand for U+2581)."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if self.dummy_prefix:
            text = " " + text
        if not self.cut_lines or "\n" not in text:
            return _words(text)
        out = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append("\n")
            out += _words(line)
        return out


_RUN = re.compile(r" +[^ ]*|^[^ ]+")


def _words(line: str) -> list[str]:
    """Cut before every run of spaces."""
    return _RUN.findall(line)


def _spread(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
