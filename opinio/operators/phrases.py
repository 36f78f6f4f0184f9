"""Longest-match phrases in token arrays: phrase boosters and idioms of the sentiment lexicon (SEN1), and the
word and phrase lexicon form of translation (CLN11).

A phrase table ``phrases(phrase[, into])`` has lower-case phrases of one or more words.  Reading a text from left to
right, the longest phrase that starts at a word is taken and its words are used up; where none starts, the word stays.

Plan: a phrase table of at most ``MAX_LITERAL_ROWS`` rows is sent to the tasks as a trie over its words, and the word arrays are
read there a batch at a time (``PhraseTrie``, by Arrow and numpy): no word becomes a row, nothing is shuffled, and the work is linear in the
words.  With a larger table every word is laid out with the words that may still belong to a phrase (as many as the longest phrase has) and meets the
table of first words, which keeps the few places where a phrase can start and how many words the phrases there have; those
word groups meet the phrase table.  Both are equi-joins, broadcast only if the planner knows the table to be small.  The hits
of one text are put in order and overlaps resolved in its row (a fold over the hits), and the text is rebuilt by
slices between the matches, so the work is linear in words and hits.  Nothing reaches the driver but the bounded table, or the length of
the longest phrase.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.sources.tables import MAX_LITERAL_ROWS

#: rows and words that a task holds as arrays at once
ROWS_AT_ONCE, WORDS_AT_ONCE = 1000, 1 << 20

MATCH = "array<struct<pos:int,n:int,into:string>>"


def phrase_table(phrases: DataFrame) -> DataFrame:
    """``phrase, first, n, into``: lower case, one blank between words, one row per phrase (ties: smallest ``into``)."""
    words = F.filter(F.split(F.lower("phrase"), r"(?U)\s+"), lambda w: w != "")
    into = F.col("into") if "into" in phrases.columns else F.lit(None).cast("string")
    return (phrases.select(words.alias("words"), into.alias("into")).where(F.size("words") > 0)
            .select(F.array_join("words", " ").alias("phrase"), F.col("words")[0].alias("first"), F.size("words").alias("n"), "into")
            .groupBy("phrase", "first", "n").agg(F.min("into").alias("into")))


def phrase_matches(df: DataFrame, key: str, words: str, phrases: DataFrame, max_words: int | None = None) -> DataFrame:
    """``key, matches`` of the rows with a match: non-overlapping ``(pos, n, into)`` in order.  ``words`` is the array
    to match (lower case); ``key`` is unique per row.  ``max_words``: words of the longest phrase, if the caller knows it."""
    table = phrase_table(phrases)
    if max_words is None:
        max_words = table.agg(F.max("n")).first()[0] or 1
    heads = table.groupBy("first").agg(F.collect_set("n").alias("lengths"))
    ahead = F.transform(words, lambda _, i: F.slice(F.col(words), i + 1, max_words))
    at = df.select(F.col(key).alias("_key"), F.posexplode(ahead).alias("pos", "ahead"))
    held = at.join(heads, F.element_at("ahead", 1) == F.col("first"))
    groups = held.select("_key", "pos", F.explode(F.transform(
        F.filter("lengths", lambda n: n <= F.size("ahead")),
        lambda n: F.struct(n.alias("n"), F.array_join(F.slice("ahead", F.lit(1), n), " ").alias("text")))).alias("group"))
    hits = (groups.select("_key", "pos", "group.n", "group.text")
            .join(table.select("phrase", "into"), F.col("text") == F.col("phrase")))
    # longest first at every place
    listed = hits.groupBy("_key").agg(F.array_sort(F.collect_list(
        F.struct("pos", (-F.col("n")).alias("less"), "into"))).alias("hits"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast(MATCH).alias("taken"))
    kept = F.aggregate("hits", start, lambda acc, h: F.when(h["pos"] >= acc["end"], F.struct(
        (h["pos"] - h["less"]).alias("end"),
        F.concat(acc["taken"], F.array(F.struct(h["pos"].alias("pos"), (-h["less"]).alias("n"), h["into"].alias("into")))).alias("taken")))
        .otherwise(acc), lambda acc: acc["taken"])
    return listed.select(F.col("_key").alias(key), kept.alias("matches"))


def rebuilt(tokens: Column, matches: Column) -> Column:
    """The tokens with each match as one token: its ``into``, or its words with blanks between."""
    m = F.coalesce(matches, F.array().cast(MATCH))

    def piece(j: Column) -> Column:
        before, here = F.get(m, j - 1), F.get(m, j)
        start = F.coalesce(before["pos"] + before["n"], F.lit(0))
        plain = F.slice(tokens, start + 1, F.coalesce(here["pos"], F.size(tokens)) - start)
        one = F.coalesce(here["into"], F.array_join(F.slice(tokens, here["pos"] + 1, here["n"]), " "))
        return F.concat(plain, F.when(here.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>")))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(m)), piece))


class PhraseTrie:
    """Phrases as a trie over word numbers.  Node 0 is the root; an edge is ``node * words + word``."""

    def __init__(self, rows: list[tuple[str, str | None]]):
        number: dict[str, int] = {}
        nodes: dict[tuple[int, int], int] = {}
        ends = {}
        for k, (phrase, _) in enumerate(rows):
            node = 0
            for w in phrase.split(" "):
                node = nodes.setdefault((node, number.setdefault(w, len(number))), len(nodes) + 1)
            ends[node] = k
        self.words = pa.array(list(number), pa.string())
        self.into = pa.array([into for _, into in rows], pa.string())
        edges = sorted((a * len(number) + w, b) for (a, w), b in nodes.items())
        self.edge = np.array([e for e, _ in edges], dtype=np.int64)
        self.child = np.array([c for _, c in edges], dtype=np.int64)
        self.phrase = np.full(len(nodes) + 1, -1, dtype=np.int64)
        self.phrase[list(ends)] = list(ends.values())

    def _step(self, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The nodes below ``node`` by ``word``; -1 where there is none."""
        edge = node * len(self.words) + word
        at = np.minimum(np.searchsorted(self.edge, edge), len(self.edge) - 1)
        return np.where((word >= 0) & (self.edge[at] == edge), self.child[at], -1)

    def matches(self, words: pa.Array, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(pos, n, phrase)`` of the phrases taken, in order; ``left`` words of its row begin at each word."""
        number = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        best, length = np.full(len(number), -1, dtype=np.int64), np.zeros(len(number), dtype=np.int64)
        at, depth = np.flatnonzero(number >= 0), 0
        node = np.zeros(len(at), dtype=np.int64)
        while len(at):
            node = self._step(node, number[at + depth])
            at, node, depth = at[node >= 0], node[node >= 0], depth + 1
            ends = self.phrase[node] >= 0
            best[at[ends]], length[at[ends]] = self.phrase[node[ends]], depth
            more = left[at] > depth
            at, node = at[more], node[more]
        pos = np.flatnonzero(best >= 0)
        # only a phrase of several words takes words away from later ones
        several = pos[length[pos] > 1]
        covered, end, taken = np.zeros(len(number), dtype=bool), 0, []
        for p, n in zip(several.tolist(), length[several].tolist()):
            if p >= end:
                taken.append(p)
                end = p + n
        taken = np.array(taken, dtype=np.int64)
        for d in range(1, int(length[taken].max(initial=0))):
            covered[taken[length[taken] > d] + d] = True
        pos = pos[~covered[pos]]
        return pos, length[pos], best[pos]

    def merged(self, tokens: pa.Array, words: pa.Array) -> pa.Array:
        """The token lists with each match as one token: its ``into``, or its tokens with blanks between."""
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, row_end = tokens.flatten(), np.cumsum(sizes)
        left = np.repeat(row_end, sizes) - np.arange(len(flat))
        pos, n, phrase = self.matches(words.flatten(), left)
        one = self.into.take(pa.array(phrase))
        whole = pc.fill_null(one, flat.take(pa.array(pos)))
        parts, source, at = [flat, whole], np.arange(len(flat)), len(flat)
        source[pos] = at + np.arange(len(pos))
        at += len(pos)
        keep = np.ones(len(flat), dtype=bool)
        for k in np.unique(n[n > 1]).tolist():
            of_length = n == k
            for d in range(1, k):
                keep[pos[of_length] + d] = False
            own = pos[of_length & pc.is_null(one).to_numpy(zero_copy_only=False)]
            parts.append(pc.binary_join_element_wise(*[flat.take(pa.array(own + d)) for d in range(k)], " "))
            source[own] = at + np.arange(len(own))
            at += len(own)
        out = pa.concat_arrays(parts).take(pa.array(source[keep]))
        kept = np.concatenate(([0], np.cumsum(keep)))[np.concatenate(([0], row_end))]
        return pa.ListArray.from_arrays(pa.array(kept, pa.int32()), out, mask=pc.is_null(tokens))


def row_merger(phrases: DataFrame, most: int | None = None):
    """(tokens, words) -> the tokens with phrases merged, as a function of the row; None if the phrase table has more
    than ``most`` rows.  At most ``most`` + 1 rows are read."""
    most = MAX_LITERAL_ROWS if most is None else most
    rows = [(r["phrase"], r["into"]) for r in phrase_table(phrases).select("phrase", "into").limit(most + 1).collect()]
    if len(rows) > most:
        return None
    if not rows:
        return lambda tokens, words: tokens
    shared = phrases.sparkSession.sparkContext.broadcast(sorted(rows))
    tries: list[PhraseTrie] = []

    @F.arrow_udf("array<string>")
    def merge(tokens: pa.Array, words: pa.Array) -> pa.Array:
        if not tries:
            tries.append(PhraseTrie(shared.value))
        ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
        out, start = [], 0
        while start < len(tokens):
            before = ends[start - 1] if start else 0
            stop = min(start + ROWS_AT_ONCE, max(start + 1, int(np.searchsorted(ends, before + WORDS_AT_ONCE, side="right"))))
            out.append(tries[0].merged(tokens.slice(start, stop - start), words.slice(start, stop - start)))
            start = stop
        return pa.concat_arrays(out) if out else tokens.slice(0, 0)
    return merge


def merge_phrases(df: DataFrame, key: str, tokens: str, words: Column, phrases: DataFrame, max_words: int | None = None) -> DataFrame:
    """``df`` with the phrases of ``tokens`` merged into single tokens; ``words`` is what is matched (as long as ``tokens``)."""
    merge = row_merger(phrases)
    if merge is not None:
        return df.withColumn(tokens, merge(F.col(tokens), words))
    found = phrase_matches(df.select(key, words.alias("_words")), key, "_words", phrases, max_words)
    out = df.join(found, key, "left")
    return out.withColumn(tokens, rebuilt(F.col(tokens), F.col("matches"))).drop("matches")


def translate_with_lexicon(df: DataFrame, key: str, text: str, lexicon: DataFrame, out: str = "translated") -> DataFrame:
    """CLN11, lexicon form: the longest phrases and words that ``lexicon(phrase, into)`` knows are replaced from left to right, other
    words stay as they are; words are separated by one blank.  Matching ignores case and punctuation at the edges of a word."""
    from opinio.functions.text import split_words
    from opinio.operators.sentiment import strip_edges
    with_tokens = df.withColumn("_tokens", split_words(F.col(text)))
    words = F.transform("_tokens", lambda w: F.lower(strip_edges(w)))
    merged = merge_phrases(with_tokens, key, "_tokens", words, lexicon)
    return merged.withColumn(out, F.array_join("_tokens", " ")).drop("_tokens")
