"""Token id files with Re-Pair grammar compression and random access.

Documents are range-partitioned and sorted by id; each task encodes its texts
with the byte-level BPE tokenizer, appends an end id to each, and fills shards
of about ``SHARD_TOKENS`` ids.  A shard is compressed by Re-Pair: in each round
the most frequent neighbour pairs are replaced by new symbols (nonterminals),
leftmost first, never across the end of a document, until no pair is left that
occurs ``LEAST_COUNT`` times.  A shard stores its rules,
their expansion lengths, the symbol sequence and, per document, the id, the
number of ids and the place of its first symbol, so that any document (or any
range of ids) is decoded without the rest.

File format: a Parquet dataset written by Spark (so on any file system that
Spark writes, and safe against lost or repeated tasks), one row per shard; the
binary columns are little-endian arrays: ``doc_ids`` int64 (with ``doc_null``
uint8), ``counts``, ``places``, ``rules`` (left, right), ``lengths``, ``symbols``
uint32.  Shards are in ascending document order by ``(part, shard)``.

Defined cases: a null or empty text is the end id alone; repeated rows are
written each, in the order of their texts' hashes; null ids come first; a document longer than
a shard has a shard of its own; an empty table gives no shards; other columns
are ignored.  A special token's string inside a text becomes its id, as in the library's plain call.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import narrow, strings

END = 0
SHARD_TOKENS = 1 << 20
RULES_PER_ROUND = 4096
LEAST_COUNT = 8
#: units remembered by a Python worker; beyond it the memory starts anew
MAX_UNITS = 1_000_000

# White space as the tokenizer's pattern sees it.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The tokenizer's pattern always cuts where these units meet: a word keeps one leading space, a run of
#: Latin letters ends before common punctuation (not before an apostrophe, which may be a contraction),
#: and of a longer run of white space the last character stands apart from the rest.
_UNIT = re.compile(rf" ?[A-Za-zÀ-ÖØ-öø-ɏ]+(?=[.,;:!?|&$%*#()<>/{_WS}-]|$)| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


class _Numbers(dict):
    """Numbers in the order in which units are first asked for; a known one is looked up without Python code."""

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        return n


class UnitEncoder:
    """Ids of texts by the tokenizers library, which sees every distinct unit once.

    With ``added`` the strings of added tokens are cut out first and become their ids (the
    library's plain call), else they are ordinary text (its ``encode_special_tokens``)."""

    def __init__(self, tokenizer_json: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = not added
        tokens = self.tokenizer.get_added_tokens_decoder().values() if added else ()
        if any(t.lstrip or t.rstrip or t.single_word for t in tokens):
            raise ValueError("added tokens that depend on their neighbours are not supported")
        # the longest of several that start at one place, as in the library
        strings = sorted((re.escape(t.content) for t in tokens), key=len, reverse=True)
        self.added = re.compile(f"({'|'.join(strings)})") if strings else None
        self.line = self._ids("\n")[0] if len(self._ids("\n")) == 1 else -1
        self._forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _units(self, text: str) -> list[str]:
        if self.added is None or not self.added.search(text):
            return _UNIT.findall(text)
        out = []
        for k, piece in enumerate(self.added.split(text)):
            out += [piece] if k % 2 else _UNIT.findall(piece)
        return out

    def _forget(self) -> None:
        self.number = _Numbers()
        self.ids = np.empty(0, np.uint32)
        self.start = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)

    def _encode_new(self, units: list[str]) -> None:
        """Words go to the library many at a time, one a line; units of white space alone."""
        start, count = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        parts, size, alone = [], len(self.ids), []
        words = []
        for i, u in enumerate(units):
            (words if self.line >= 0 and not u[-1].isspace() else alone).append(i)
        for k in range(0, len(words), 4000):
            some = words[k:k + 4000]
            ids = np.array(self._ids("\n".join([units[i] for i in some])), dtype=np.uint32)
            cut = np.flatnonzero(ids == self.line)
            if len(cut) != len(some) - 1:
                alone += some
                continue
            edges = np.concatenate(([-1], cut, [len(ids)]))
            n = np.diff(edges) - 1
            count[some] = n
            start[some] = size + np.cumsum(n) - n
            parts.append(np.delete(ids, cut))
            size += len(parts[-1])
        for i in alone:
            parts.append(np.array(self._ids(units[i]), dtype=np.uint32))
            start[i], count[i] = size, len(parts[-1])
            size += len(parts[-1])
        self.ids = np.concatenate([self.ids, *parts])
        self.start = np.concatenate([self.start, start])
        self.count = np.concatenate([self.count, count])

    def encode(self, rows: list[str]) -> list[np.ndarray]:
        if len(self.number) > MAX_UNITS:
            self._forget()
        known = self.number
        units = [self._units(t) for t in rows]
        sizes = np.array([len(u) for u in units], dtype=np.int64)
        code = np.fromiter(map(known.__getitem__, chain.from_iterable(units)), np.int64, int(sizes.sum()))
        if len(known) > len(self.count):
            self._encode_new(list(islice(known, len(self.count), None)))
        count = self.count[code]
        before = np.cumsum(count) - count
        ids = self.ids[np.arange(int(count.sum())) + np.repeat(self.start[code] - before, count)]
        ends = np.concatenate(([0], np.cumsum(count)))[np.concatenate(([0], np.cumsum(sizes)))]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]


_ENCODERS: dict[str, UnitEncoder] = {}


def _encoder(tokenizer_json: str) -> UnitEncoder:
    """One encoder per Python worker, so that the units of one task are known to the next."""
    if tokenizer_json not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tokenizer_json] = UnitEncoder(tokenizer_json, added=True)
    return _ENCODERS[tokenizer_json]


def _bins(key: np.ndarray, bits: int = 18) -> np.ndarray:
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _places(pairs: np.ndarray, key: np.ndarray, bins: np.ndarray, bits: int = 18) -> np.ndarray:
    """Where each key stands in the sorted ``pairs``; of a key that is not there, some place.  A bin that one pair
    has to itself gives the place at once, only keys of shared bins are searched for."""
    own = _bins(pairs, bits)
    table = np.zeros(1 << bits, dtype=np.int32)
    table[own] = np.arange(len(pairs), dtype=np.int32)
    shared = np.bincount(own, minlength=1 << bits) > 1
    place = table[bins]
    search = np.flatnonzero(shared[bins])
    place[search] = np.minimum(np.searchsorted(pairs, key[search]), len(pairs) - 1)
    return place


def repair(ids: np.ndarray, ends: np.ndarray, base: int, per_round: int = RULES_PER_ROUND,
           least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: ``(symbols, ends, rules)``.  ``ends`` marks the last symbol of each
    document; rule k is symbol ``base + k`` and its two parts are older symbols.

    Rounds of ``per_round`` pairs go on until no pair occurs ``least`` times.  A pair of
    older symbols never becomes more frequent, so once it is rarer than that, only
    places beside a new symbol are counted again (``live``: all places of a pair are, or none)."""
    symbols, ends, rules, n_rules = ids.astype(np.uint32), ends.copy(), [np.empty(0, np.uint64)], 0
    live = np.flatnonzero(~ends[:-1])
    while len(live):
        key = (symbols[live].astype(np.uint64) << np.uint64(32)) | symbols[live + 1]
        bins = _bins(key)
        counts = np.bincount(bins, minlength=1 << 18)
        # candidates by hashed counts (never below the true count), then exact counts
        some = (counts >= least)[bins]
        live, key, bins = live[some], key[some], bins[some]
        full = counts[counts >= least]                       # only these can raise the floor
        floor = least if len(full) < 4 * per_round else int(np.partition(full, -4 * per_round)[-4 * per_round])
        maybe = (counts >= floor)[bins]
        pairs, n = np.unique(key[maybe], return_counts=True)
        if floor > least and not (n >= least).any():         # the fullest bins hold rare pairs only
            floor, maybe = least, np.ones(len(key), dtype=bool)
            pairs, n = np.unique(key, return_counts=True)
        pairs, n = pairs[n >= least], n[n >= least]
        if not len(pairs):
            break
        # counted and rare: not looked at again
        place = _places(pairs, key, bins)
        known = pairs[place] == key
        live, place, known = live[known | ~maybe], place[known | ~maybe], known[known | ~maybe]
        chosen = np.zeros(len(pairs), dtype=bool)
        chosen[np.argsort(-n, kind="stable")[:per_round]] = True
        hit = known & chosen[place]
        at, place, rest = live[hit], place[hit], live[~hit]
        # of pairs that overlap in a run, every second one is taken, from the left
        new_run = np.concatenate(([True], np.diff(at) > 1))
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - run_start) % 2 == 0
        at, place = at[take], place[take]
        used = np.bincount(place, minlength=len(pairs)) > 0
        symbols[at] = (base + n_rules + np.cumsum(used) - 1).astype(np.uint32)[place]
        rules.append(pairs[used])
        n_rules += len(rules[-1])
        ends[at] = ends[at + 1]
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        look = np.zeros(len(symbols), dtype=bool)
        look[rest] = True
        look[at] = True
        symbols, ends, look = symbols[keep], ends[keep], look[keep]
        new = at - np.arange(len(at))                        # places of the new symbols after the cut
        look[new[new > 0] - 1] = True
        look[ends] = False
        live = np.flatnonzero(look[:-1])
    made = np.concatenate(rules)
    return symbols, ends, np.stack([made >> np.uint64(32), made & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((1 if a < base else out[a - base]) + (1 if b < base else out[b - base]))
    return np.array(out, dtype=np.uint32)


class Shard:
    """One stored shard; decodes any document or range of ids."""

    def __init__(self, row: dict, base: int):
        of = lambda name, kind: np.frombuffer(row[name], dtype=kind)
        self.base = base
        self.doc_ids, self.doc_null = of("doc_ids", "<i8"), of("doc_null", "u1")
        self.counts, self.places = of("counts", "<u4"), of("places", "<u4").astype(np.int64)
        self.symbols, self.lengths = of("symbols", "<u4"), of("lengths", "<u4").astype(np.int64)
        rules = of("rules", "<u4").reshape(-1, 2)
        self.size = np.concatenate([np.ones(base, dtype=np.int64), self.lengths])
        self.start = np.concatenate([np.arange(base), base + np.cumsum(self.lengths) - self.lengths])
        self.flat = np.concatenate([np.arange(base, dtype=np.uint32), np.empty(int(self.lengths.sum()), np.uint32)])
        depth: list[int] = []
        for a, b in rules.tolist():
            depth.append(1 + max(0 if a < base else depth[a - base], 0 if b < base else depth[b - base]))
        level = np.array(depth, dtype=np.int64)
        for d in range(1, max(depth, default=0) + 1):        # parts are expanded before the rules that use them
            of_level = np.flatnonzero(level == d)
            size = self.lengths[of_level]
            before = np.cumsum(size) - size
            to = np.arange(int(size.sum())) + np.repeat(self.start[base + of_level] - before, size)
            self.flat[to] = self.expand(rules[of_level].ravel())

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.size[symbols]
        before = np.cumsum(size) - size
        return self.flat[np.arange(int(size.sum())) + np.repeat(self.start[symbols] - before, size)]

    def document(self, k: int) -> np.ndarray:
        stop = self.places[k + 1] if k + 1 < len(self.places) else len(self.symbols)
        return self.expand(self.symbols[self.places[k]:stop])

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard, by the expansion lengths alone."""
        ends = np.cumsum(self.size[self.symbols])
        a, b = np.searchsorted(ends, (start, stop - 1), side="right")
        first = int(ends[a] - self.size[self.symbols[a]])
        return self.expand(self.symbols[a:b + 1])[start - first:stop - first]


_SCHEMA = ("part long, shard long, n_docs long, n_tokens long, doc_ids binary, doc_null binary, counts binary, "
           "places binary, rules binary, lengths binary, symbols binary")
_ARROW = pa.schema([*[(n, pa.int64()) for n in ("part", "shard", "n_docs", "n_tokens")],
                    *[(n, pa.binary()) for n in ("doc_ids", "doc_null", "counts", "places", "rules", "lengths", "symbols")]])


def _shard_row(part: int, shard: int, ids: list, docs: list[np.ndarray], base: int) -> pa.RecordBatch:
    counts = np.array([len(d) for d in docs], dtype=np.int64)
    tokens = np.concatenate(docs)
    ends = np.zeros(len(tokens), dtype=bool)
    ends[np.cumsum(counts) - 1] = True
    symbols, ends, rules = repair(tokens, ends, base)
    places = np.concatenate(([0], np.flatnonzero(ends)[:-1] + 1))
    values = [part, shard, len(docs), len(tokens), np.array([i or 0 for i in ids], "<i8").tobytes(),
              np.array([i is None for i in ids], "u1").tobytes(), counts.astype("<u4").tobytes(),
              places.astype("<u4").tobytes(), rules.astype("<u4").tobytes(),
              expansion_lengths(rules, base).astype("<u4").tobytes(), symbols.astype("<u4").tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _ARROW)], schema=_ARROW)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                      end: int = END, shard_tokens: int = SHARD_TOKENS) -> int:
    """Write the files; gives the size of the tokenizer's vocabulary (the first nonterminal)."""
    from tokenizers import Tokenizer
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    base = Tokenizer.from_str(text).get_vocab_size()
    shared = docs.sparkSession.sparkContext.broadcast(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard = _encoder(shared.value), TaskContext.get().partitionId(), 0
        ids, tokens, size = [], [], 0
        stop = np.array([end], dtype=np.uint32)
        for b in batches:
            rows, keys = strings(b), b.column(0).to_pylist()
            for k in range(0, len(rows), 500):
                for key, t in zip(keys[k:k + 500], encoder.encode(rows[k:k + 500])):
                    if ids and size + len(t) + 1 > shard_tokens:
                        yield _shard_row(part, shard, ids, tokens, base)
                        ids, tokens, size, shard = [], [], 0, shard + 1
                    ids.append(key)
                    tokens.append(np.concatenate([t, stop]))
                    size += len(t) + 1
        if ids:
            yield _shard_row(part, shard, ids, tokens, base)

    (narrow(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                                           F.xxhash64("text").alias("h"))
     .repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
     .mapInArrow(run, _SCHEMA).write.option("compression", "zstd").parquet(folder))
    return base


def read_documents(spark: SparkSession, folder: str, base: int, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of every stored document, decoded from the files."""
    stored = spark.read.schema(_SCHEMA).parquet(folder)
    # two levels, so that no task orders all shards: within a part, then over the parts
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    within = Window.partitionBy("part").orderBy("shard")
    starts = (stored.select("part", "shard", (F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("shard_start"))
              .join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("before")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                s = Shard(row, base)
                counts = s.counts.astype(np.int64)
                tokens, n = s.expand(s.symbols).astype("<u4"), len(counts)
                docs = np.split(tokens, np.cumsum(counts)[:-1])
                out = [pa.array([row["part"]] * n, pa.int64()), pa.array([row["shard"]] * n, pa.int64()),
                       pa.array(s.doc_ids, pa.int64(), mask=s.doc_null.astype(bool)),
                       pa.array(np.cumsum(counts) - counts), pa.array(counts),
                       pa.array([zlib.crc32(d) for d in docs], pa.int64())]
                if with_ids:
                    ends = np.concatenate(([0], np.cumsum(counts)))
                    out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32", "ids"][:len(out)])

    rows = stored.mapInArrow(run, "part long, shard long, doc_id long, at long, n_tokens long, ids_crc32 long"
                             + (", ids array<int>" if with_ids else ""))
    return (rows.join(starts, ["part", "shard"])
            .select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32",
                    *(["ids"] if with_ids else [])))
