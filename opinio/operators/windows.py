"""Counts of boolean sliding windows over token lists: in how many windows a word occurs, and two words together.

1. A task keeps, per document, only the places of the wanted words, found in its token list by Arrow.  These narrow rows are all
   that is shuffled: rows of one key are one document.
2. A word at place ``p`` lies in the windows that start from ``p - window + 1`` to ``p``.  The starts of all documents of a batch are
   laid out one after the other; running sums of the begins and ends of these ranges tell, per start, which words its window
   holds, and a matrix product per topic counts the pairs.  It takes a bounded slice of starts at a time, and every count is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: numbers (starts x words) of a slice
SLICE = 1 << 22


def _narrow(docs: DataFrame, key: str, tokens: str, words: list[str]) -> DataFrame:
    """``key, n, word, place``: length of the token list, and the wanted words in it by number and place (int32)."""
    wanted = pa.array(words, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.asarray(pc.fill_null(b.column(1).value_lengths(), 0).to_numpy(zero_copy_only=False), np.int64)
            found = pc.fill_null(pc.index_in(b.column(1).flatten(), wanted), -1).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(found >= 0)
            end = np.cumsum(n)
            cut = np.searchsorted(at, end)
            place = (at - np.repeat(end - n, np.diff(np.concatenate(([0], cut))))).astype("<i4")
            word = found[at].astype("<i4")
            spans = list(zip(np.concatenate(([0], cut[:-1])).tolist(), cut.tolist()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), *(pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for x in (word, place))],
                names=["key", "n", "word", "place"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, tokens).mapInArrow(run, f"key {kind}, n long, word binary, place binary")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in the order of their keys, and where a key begins; all rows of a key come together."""
    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b])
        keys = table.column("key").to_pylist()
        begin = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
        if held and held[-1].column("key")[-1].as_py() != keys[0]:
            begin = [0, *begin[1:]]
            yield (whole := pa.concat_tables(held)), np.array([0])
            held = []
        if len(begin) == 1:
            held.append(table)
            continue
        before = sum(t.num_rows for t in held)
        whole = pa.concat_tables([*held, table.slice(0, begin[-1])])
        yield whole, np.array([0, *(before + x for x in begin[1:-1])])
        held = [table.slice(begin[-1])]
    if held:
        yield pa.concat_tables(held), np.array([0])


class _Counts:
    """Sums of one task: per word, per pair of words of a topic, and of all windows."""

    def __init__(self, words: int, topics: list[np.ndarray], window: int):
        self.words, self.topics, self.window, self.windows = words, topics, window, 0
        self.single = np.zeros(words, np.int64)
        self.pairs = [np.zeros((len(t), len(t)), np.int64) for t in topics]

    def add(self, rows: pa.Table, begin: np.ndarray, named: bool) -> None:
        n = rows.column("n").to_numpy()
        starts = np.maximum(n - self.window + 1, 1)
        bytes_of = rows.column("word").to_pylist()
        held = np.array([len(x) // 4 for x in bytes_of], np.int64)
        word = np.frombuffer(b"".join(bytes_of), "<i4")
        place = np.frombuffer(b"".join(rows.column("place").to_pylist()), "<i4").astype(np.int64)
        sizes = np.diff(np.concatenate((begin, [len(n)])))
        span = np.maximum.reduceat(starts, begin)             # rows of one key lie over each other
        if named:
            self.windows += int(starts[np.repeat(np.add.reduceat(held, begin) > 0, sizes)].sum())
        offset = np.repeat(np.repeat(np.cumsum(span) - span, sizes), held)
        last = np.repeat(starts - 1, held)
        low = offset + np.minimum(np.maximum(place - self.window + 1, 0), last)
        high = offset + np.minimum(place, last) + 1
        at, step = np.concatenate((low, high)), np.repeat(np.array([1, -1], np.int32), len(word))
        order = np.argsort(at, kind="stable")
        at, step, of = at[order], step[order], np.concatenate((word, word))[order]
        size, carry = max(1, SLICE // max(self.words, 1)), np.zeros(self.words, np.int32)
        until = int(span.sum()) + 1                           # the last ranges end after the last start
        for x in range(0, until, size):
            i, j = np.searchsorted(at, (x, x + size))
            depth = np.zeros((min(size, until - x), self.words), np.int32)
            np.add.at(depth, (at[i:j] - x, of[i:j]), step[i:j])
            depth[0] += carry
            np.cumsum(depth, axis=0, out=depth)
            carry = depth[-1].copy()
            inside = depth > 0
            self.single += np.count_nonzero(inside, axis=0)
            for t, pairs in zip(self.topics, self.pairs if named else []):
                both = inside[:, t].astype(np.float32)        # sums of at most 2^22 ones are exact
                pairs += (both.T @ both).astype(np.int64)


def window_counts(docs: DataFrame, key: str, tokens: str, topics: list[list[str]], window: int) -> DataFrame:
    """``wi, wj, n``: windows that hold ``wi`` (``wj`` null), that hold both words of a topic (``wi < wj``), and all windows of
    documents that hold any of the words (both null).  Rows without a key are one document that counts for single words only."""
    words = sorted({w for t in topics for w in t})
    number = {w: i for i, w in enumerate(words)}
    members = [np.array([number[w] for w in sorted(set(t))], np.int64) for t in topics]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(len(words), members, window)
        for rows, begin in _groups(batches):
            nameless = rows.column("key").null_count
            if nameless:                                      # they come first, as one key
                counts.add(rows.slice(0, nameless), np.array([0]), False)
                rows, begin = rows.slice(nameless), begin[1:] - nameless
            if rows.num_rows:
                counts.add(rows, begin, True)
        out = {(words[i], None): int(n) for i, n in enumerate(counts.single)} | {(None, None): counts.windows}
        for t, pairs in zip(members, counts.pairs):
            out |= {(words[t[i]], words[t[j]]): int(pairs[i, j]) for i in range(len(t)) for j in range(i + 1, len(t))}
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.string()),
                                          pa.array(list(out.values()), pa.int64())], names=["wi", "wj", "n"])

    narrow = _narrow(docs, key, tokens, words)
    return (narrow.repartition("key").sortWithinPartitions("key").mapInArrow(run, "wi string, wj string, n long")
            .groupBy("wi", "wj").agg(F.sum("n").alias("n")).where("n > 0"))
