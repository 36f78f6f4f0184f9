"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items go into one suffix automaton.  Each
document is streamed through it word by word; the automaton state gives the
longest suffix read so far that occurs in some item.  Once that length
reaches the window size, the last ``window`` words are a window of an item,
and the state says which items hold it.

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A window is
``window`` consecutive words of one item; an item with fewer words (but not
none) is one window by itself.  A document word inside any occurrence of a
window is hit.

Defined cases: a null or empty text has no words, no hits and is not
contaminated; items without words never match; a null item id counts as the
empty string; repeated items count once by id; repeated documents give one
row each; a very long text is streamed whole; an empty table gives an empty result; an empty benchmark leaves every document clean; other columns of
both tables are ignored.

Size: the automaton is built on the driver and broadcast, so it is bounded: about 600 bytes a word in each
process, 80 MB at the limit.  Items are cut into overlapping chunks of at most ``CHUNK_WORDS`` words (the
overlap is ``window - 1``, so no window is lost) and dealt into shards of
about ``max_words`` words.  Each shard is one automaton and one pass over the
documents; hits of earlier shards are carried along.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, narrow, row_type, slices, texts

WINDOW = 13
CHUNK_WORDS = 1 << 16
MAX_WORDS = 1 << 17

#: Bytes outside words become spaces, A-Z become a-z.  Bytes from 0x80 on belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
              for b in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = [(item, [self.vocab.setdefault(w, len(self.vocab)) for w in words])
                 for item, words in items if words]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        #: for a state that can stand for ``window`` words: the state of exactly the last ``window`` words
        self.window_state = [-1] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[v]
            if self.length[up] >= window:
                self.window_state[v] = self.window_state[up]
            elif self.length[v] >= window:
                self.window_state[v] = v
        self.items: dict[int, set[str]] = {}                 # window state -> items
        self.short: dict[int, list[tuple[int, str]]] = {}    # state -> whole short items that end here
        for item, seq in coded:
            v = 0
            for i, c in enumerate(seq):
                v = self.next[v][c]
                if i + 1 >= window:
                    self.items.setdefault(self.window_state[v], set()).add(item)
            if len(seq) < window:
                self.short.setdefault(v, []).append((len(seq), item))
        self.least = min([window, *(len(s) for _, s in coded)])
        if self.short:  # a short item also ends wherever a longer string ends with it
            for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
                if up := self.short.get(self.link[v]):
                    self.short[v] = [*self.short.get(v, []), *up]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:                                   # the string is there already
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(link)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        link[q] = new
        return new

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word spans ``[start, end)`` (disjoint, ascending) and the items."""
        get, n = self.vocab.get, len(words)
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int32, count=n)
        # a word of no item ends every match: only stretches long enough for a window are streamed
        cut = np.concatenate(([-1], np.flatnonzero(ids < 0), [n]))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for k in np.flatnonzero(np.diff(cut) > self.least):
            self._stream(ids[cut[k] + 1:cut[k + 1]].tolist(), int(cut[k]) + 1, spans, items)
        return spans, items

    def _stream(self, ids: list[int], at: int, spans: list, items: set) -> None:
        nxt, link, length, window = self.next, self.link, self.length, self.window
        v = l = 0
        for i, c in enumerate(ids, at + 1):
            while v and c not in nxt[v]:
                v = link[v]
                l = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                l += 1
            size = 0
            if l >= window:
                size = window
                items |= self.items[self.window_state[v]]
            for n, item in self.short.get(v, ()):
                if n <= l:
                    size = max(size, n)
                    items.add(item)
            if size:
                start = i - size
                while spans and spans[-1][1] >= start:       # grow the last span
                    start = min(start, spans.pop()[0])
                spans.append((start, i))


def _shards(benchmark: DataFrame, id_col: str, text_col: str, window: int, max_words: int):
    """The items in bounded shards, one list of (item, words) at a time."""
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for item, t in zip(ids, texts(b)):
                w = words_of(t)
                step = CHUNK_WORDS - window + 1
                for s in range(0, max(1, len(w) - window + 1), step):
                    if w:
                        part = w[s:s + CHUNK_WORDS]
                        out.append((item, s, b" ".join(part).decode("utf-8", "surrogateescape"), len(part)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4,
                                                (pa.string(), pa.int64(), pa.string(), pa.int64()))],
                names=["item", "at", "words", "n"])

    cut = cut_lineage(benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
                      .mapInArrow(chunks, "item string, at long, words string, n long"))
    total = cut.agg(F.sum("n")).first()[0] or 0
    n = max(1, math.ceil(total / max_words))
    for k in range(n):
        rows = cut.where(F.pmod(F.xxhash64("item", "at"), F.lit(n)) == k).collect()
        items = [(r.item, r.words.encode("utf-8").split()) for r in sorted(rows, key=lambda r: (r.item, r.at, r.words))]
        yield k == 0, k == n - 1, items


def _char_spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as code point spans of the text."""
    at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    return [(len(text[:at[a][0]].decode()), len(text[:at[b - 1][1]].decode())) for a, b in spans]


_SCHEMA = ("text string, n_words long, word_spans array<struct<start:long,end:long>>, "
           "char_spans array<struct<start:long,end:long>>, items array<string>")
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merge(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  one_in: int = 20, max_words: int = MAX_WORDS, with_text: bool = False,
                  carry: bool | list[str] = False) -> DataFrame:
    """One row per document: ``doc_id, n_words, word_spans, char_spans, items,
    n_hit, n_items, contaminated`` (at least one word in ``one_in`` is hit), and
    ``text`` or the input row (``carry``) if asked for.  Ids keep their type."""
    spark = docs.sparkSession
    found = narrow(docs, id_col, text_col, carry, once=True)
    where = {"column": text_col, "inside": True} if carry is True else {}   # a carried text goes along once
    row = ["row"] if carry else []
    schema = f"doc_id {found.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}{row_type(found)}"
    shards = _shards(benchmark, item_col, item_text_col, window, max_words)
    for first, last, items in shards:
        shared = spark.sparkContext.broadcast(SuffixAutomaton(items, window))
        if not first:                                        # a further pass: keep what was found
            found = cut_lineage(found)
        found = found.mapInArrow(_pass(shared, first, with_text or not last, where), schema)
    n_hit = F.coalesce(F.aggregate("word_spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]), F.lit(0))
    text = F.coalesce(F.col("row").getField(text_col), F.lit("")).alias("text") if where else F.col("text")
    found = found.select("doc_id", *([text] if with_text else []), "n_words", "word_spans", "char_spans", "items",
                         n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), *row)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) &
                            (F.col("n_hit") * one_in >= F.col("n_words")))


def _pass(shared, first: bool, keep_text: bool, where: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for b in (part for whole in batches for part in slices(whole, **where)):
            rows = texts(b, **where)
            of = lambda name: b.column(b.schema.get_field_index(name))
            row = [of("row")] if "row" in b.schema.names else []
            n_words, spans, chars, items = [], [], [], []
            for i, t in enumerate(rows):
                words = words_of(t)
                s, it = automaton.match(words)
                if not first:
                    s = _merge([*s, *((x["start"], x["end"]) for x in of("word_spans")[i].as_py())])
                    it = it | set(of("items")[i].as_py())
                n_words.append(len(words))
                spans.append([{"start": x, "end": y} for x, y in s])
                chars.append([{"start": x, "end": y} for x, y in _char_spans(t, s)] if s else [])
                items.append(sorted(it))
            text = of("text").cast(pa.string()) if keep_text and not where else pa.nulls(b.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), text, pa.array(n_words, pa.int64()), pa.array(spans, _SPAN), pa.array(chars, _SPAN),
                 pa.array(items, pa.list_(pa.string())), *row],
                names=["doc_id", "text", "n_words", "word_spans", "char_spans", "items", *["row"] * len(row)])
    return run


def remove_spans(found: DataFrame, max_span_words: int) -> DataFrame:
    """``clean_text``: the text without every hit span of at least
    ``max_span_words`` words (needs ``with_text``; spans are in code points)."""
    spans = F.transform(F.filter(F.arrays_zip("word_spans", "char_spans"),
                                 lambda z: z["word_spans"]["end"] - z["word_spans"]["start"] >= max_span_words),
                        lambda z: z["char_spans"])
    n = F.length("text").cast("long")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("cut", lambda s: s["end"]))
    ends = F.concat(F.transform("cut", lambda s: s["start"]), F.array(n))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")))
    return found.withColumn("cut", spans).withColumn("clean_text", F.array_join(pieces, "")).drop("cut")
