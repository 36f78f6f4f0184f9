"""Quality rules with host verdicts.

Each document is measured in one pass (word, symbol, line and repetition
counts).  Rule failures are then aggregated by host; the failure rates are
shrunk towards an empirical beta prior fitted to all hosts, so that a host
with a few unlucky documents is not condemned; a host whose shrunk rate of
some rule exceeds the limit is rejected, and the verdict is joined back to
its documents.

Words are ``[^\\x20\\x09-\\x0D]+``.  Defined cases: a null or empty text has no
words and fails; a very long text is measured whole; a null host is a host of its own; repeated rows count each;
a host whose rate equals the limit is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, narrow, texts

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    size = len(ids)
    pair = code[:-1] * size + code[1:]
    if size > 1 << 20:                                       # keep the triple's key below 2^63
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * size + code[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    first = np.zeros(n, dtype=bool)                          # windows found twice or more, by first word
    first[order[1:][same]] = True
    first[order[:-1][same]] = True
    inside = first.copy()
    inside[1:] |= first[:-1]
    inside[2:] |= first[:-2]
    return int(np.count_nonzero(inside))


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()                                     # bytes: splits at exactly these six characters
    chars = len(text.translate(None, _SPACE).decode("utf-8"))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeat_words(words)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``doc_id, host`` and the counts of every document."""
    source = narrow(docs, id_col, text_col, host=host_col)
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([measure(t) for t in texts(b)], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c) for c in rows.T)],
                                             names=["doc_id", "host", *COUNTS])

    return source.mapInArrow(run, f"doc_id {kinds['doc_id']}, host {kinds['host']}, "
                             + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: name -> failure of one document; the limits are parameters of the rules
RULES = {
    "few_words": lambda: F.col("n_words") < 50,
    "repetition": lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
    "symbols": lambda: 2 * F.col("n_symbols") > F.col("n_words"),
    "dup_lines": lambda: 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
}


def host_rates(docs: DataFrame, rules=RULES) -> DataFrame:
    """``host, n_docs`` and the shrunk failure rate of each rule (``rate_<rule>``).

    Prior of a rule: a beta distribution with the mean and the (document-weighted)
    variance of the hosts' rates; without variance every host gets the mean."""
    hosts = docs.groupBy("host").agg(F.count("*").alias("n_docs"),
                                     *[F.sum(fail().cast("long")).alias(f"fail_{r}") for r, fail in rules.items()])
    moments = hosts.agg(F.struct(*[
        F.struct((F.sum(f"fail_{r}") / F.sum("n_docs")).alias("m"),
                 (F.sum(F.col(f"fail_{r}") * F.col(f"fail_{r}") / F.col("n_docs")) / F.sum("n_docs")).alias("m2")).alias(r)
        for r in rules]).alias("prior")).scalar()
    out = hosts.withColumn("prior", moments)

    def shrunk(r: str) -> Column:
        m = F.col(f"prior.{r}.m")
        v = F.col(f"prior.{r}.m2") - m * m                   # sum n (f/n - m)^2 / sum n
        strength = F.greatest(m * (1 - m) / v - 1, F.lit(1.0))
        return F.when(v > 1e-12, (F.col(f"fail_{r}") + m * strength) / (F.col("n_docs") + strength)).otherwise(m)

    return out.select("host", "n_docs", *[shrunk(r).alias(f"rate_{r}") for r in rules])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          max_rate: float = 0.5, rules=RULES) -> DataFrame:
    """Counts of every document, ``base_failed``, ``host_rejected`` and ``kept``."""
    rows = cut_lineage(measured(docs, id_col, text_col, host_col))   # read twice: rates, then verdicts
    rates = host_rates(rows, rules)
    bad = F.greatest(F.lit(0.0), *[F.col(f"rate_{r}") for r in rules]) > max_rate
    verdicts = rates.select(F.col("host").alias("of_host"), bad.alias("host_rejected"))
    joined = rows.join(verdicts, F.col("host").eqNullSafe(F.col("of_host")), "left").drop("of_host")
    joined = joined.withColumn("base_failed", base_failed())
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))
