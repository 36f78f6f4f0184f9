"""Words of an array looked up inside the row.

A table of at most ``MAX_LITERAL_ROWS`` words is dealt into slots by hash and becomes one literal of the plan, like the other small
word tables: a word is compared with the few entries of its slot, so texts need not be taken apart into rows, joined,
sorted by their key and rebuilt.  A table of at most ``MAX_SENT_ROWS`` words is sent to the tasks once, which look up the
words of many rows at a time (``word_replacer``).  A larger table is neither; callers join it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.sources.tables import MAX_LITERAL_ROWS

#: a few dozen MB of words; words replaced at once
MAX_SENT_ROWS, WORDS_AT_ONCE = 1 << 20, 1 << 20


def word_lookup(table: DataFrame, word: str, value: str, most: int | None = None, known: bool = False) -> Callable[[Column], Column] | None:
    """Word -> its ``value`` (a string; null if the table does not have the word), or None if the table, one row per word, has
    more than ``most`` rows.  At most ``most`` + 1 rows are read.  With ``known`` the function tells if the table has the word."""
    most = MAX_LITERAL_ROWS if most is None else most
    size = 1 << max(most, 1).bit_length()                     # fixed before the table is known: its rows are read once

    def slot(w: Column) -> Column:
        return F.pmod(F.xxhash64(w), F.lit(size)).cast("int")

    rows = (table.select(F.col(word).alias("k"), F.col(value).alias("v")).where(F.col("k").isNotNull())
            .select(slot(F.col("k")).alias("s"), "k", "v").limit(most + 1).collect())
    if len(rows) > most:
        return None
    slots: list[list[dict]] = [[] for _ in range(size)]
    for r in rows:
        slots[r["s"]].append({"k": r["k"], "v": r["v"]})
    held = F.from_json(F.lit(json.dumps(slots)), "array<array<struct<k:string,v:string>>>")
    if known:                                                 # stops at the word, and makes no array
        return lambda w: F.exists(F.get(held, slot(w)), lambda e: e["k"] == w)
    return lambda w: F.get(F.filter(F.get(held, slot(w)), lambda e: e["k"] == w), F.lit(0))["v"]


def replaced(tokens: pa.Array, words: pa.Array, known: pa.Array, into: pa.Array) -> pa.Array:
    """The token lists, a token whose word (in ``words``, as long) is ``known`` being replaced by its value (null: kept)."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, start = [], 0
    while start < len(tokens):                                # parts bound what is held besides the batch
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + WORDS_AT_ONCE, side="right")))
        some = tokens.slice(start, stop - start)
        found = into.take(pc.index_in(words.slice(start, stop - start).flatten(), known))
        kept = np.concatenate(([0], ends[start:stop] - before))
        out.append(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pc.coalesce(found, some.flatten()), mask=pc.is_null(some)))
        start = stop
    return pa.concat_arrays(out) if out else tokens


def word_replacer(table: DataFrame, word: str, value: str, most: int | None = None) -> Callable[[Column, Column], Column] | None:
    """(tokens, their words) -> the tokens with known words replaced, or None if the table, one row per word, has more than
    ``most`` rows.  At most ``most`` + 1 rows are read."""
    most = MAX_SENT_ROWS if most is None else most
    rows = table.select(F.col(word).alias("k"), F.col(value).alias("v")).where(F.col("k").isNotNull()).limit(most + 1).toArrow()
    if rows.num_rows > most:
        return None
    sent = table.sparkSession.sparkContext.broadcast([rows.column(c).combine_chunks() for c in ("k", "v")])

    @F.arrow_udf("array<string>")
    def replace(tokens: pa.Array, words: pa.Array) -> pa.Array:
        return replaced(tokens, words, *sent.value)
    return replace
