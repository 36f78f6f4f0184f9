"""Toxicity with a linear-chain conditional random field over words.

Fitting, on a bounded sample of labelled documents (folds 1 to 4 of the id's
crc32 modulo 5; fold 0 is held out):

1. token labels: a word form (the word, its prefixes, its character 5-grams)
   that is found significantly more often in toxic than in clean documents
   labels its tokens in toxic documents as toxic, all other tokens as clean;
2. a two-label chain (toxic, clean) is fitted to these tokens by gradient
   ascent on the conditional likelihood; expectations come from
   forward-backward;
3. a logistic calibrator, fitted on fold 4 alone (the chain saw folds 1 to 3),
   turns a document's summed and largest marginals into its score.

Scoring runs forward-backward over every line of every text and aggregates the
marginals to the score and to the offending spans (code points, end exclusive).

Only the text is an input of a score.  Defined cases: a null or empty text has
no tokens and gets the calibrator's value for zero marginals; repeated rows are
scored alike; a null id is not held out; without usable labels every document
gets the smoothed share of toxic labels; of several equal texts with one label one is sampled, of equal texts with both labels
one each; an empty table gives an empty result; other columns are ignored.  A very long text is scored whole; lines are
cut into sequences of at most ``SEQUENCE`` tokens.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, cut_lineage, narrow, row_type, slices, strings

SEQUENCE = 128
#: bounds of the fitting sample: documents of at most so many code points, so many of each kind
MAX_CHARS = 20_000
MAX_TOXIC, MAX_CLEAN, MAX_CALIBRATION = 800, 1600, 1600
MAX_WORDS_KEPT = 1_000_000
_WORD = re.compile(r"\w+")


def forms(word: str) -> list[str]:
    """Features of a word."""
    w = word.lower()
    edged = f"^{w}$"
    out = {f"={w}", *(f"<{w[:k]}" for k in (3, 4, 5, 6) if len(w) > k)}
    out.update(edged[i:i + 5] for i in range(len(edged) - 4))
    return sorted(out)


def sequences(text: str) -> list[list[str]]:
    out = []
    for line in text.split("\n"):
        words = _WORD.findall(line)
        out += [words[k:k + SEQUENCE] for k in range(0, len(words), SEQUENCE)]
    return out


def forward_backward(odds: np.ndarray, sizes: np.ndarray, trans: np.ndarray):
    """Marginals of the toxic label for sequences laid end to end.

    ``odds``: exp of the emission difference toxic - clean per token.  With two
    labels the forward and backward messages are ratios.  Gives the marginals,
    and both messages (for the pair expectations)."""
    n = len(odds)
    fwd, bwd = np.empty(n), np.empty(n)
    a00, a01, a10, a11 = trans.ravel()
    start = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    start, size = start[order], sizes[order]
    fewer = -size
    longest = int(size[0]) if len(size) else 0
    for t in range(longest):
        live = int(np.searchsorted(fewer, -t, side="left"))
        at = start[:live] + t
        if t == 0:
            fwd[at] = odds[at]
        else:
            r = fwd[at - 1]
            fwd[at] = odds[at] * (a01 + r * a11) / (a00 + r * a10)
    for t in range(longest):                                  # t tokens after this one
        live = int(np.searchsorted(fewer, -t, side="left"))
        at = start[:live] + size[:live] - 1 - t
        if t == 0:
            bwd[at] = 1.0
        else:
            x = odds[at + 1] * bwd[at + 1]
            bwd[at] = (a10 + a11 * x) / (a00 + a01 * x)
    both = fwd * bwd
    return both / (1 + both), fwd, bwd


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    calibrator: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in forms(word))

    def marginals(self, docs: list[list[list[str]]], known: dict[str, float]):
        """Per document the marginals of its tokens, in order."""
        if len(known) > MAX_WORDS_KEPT:
            known.clear()
        values, sizes, per_doc = [], [], []
        for seqs in docs:
            n = 0
            for words in seqs:
                for w in words:
                    e = known.get(w)
                    if e is None:
                        e = known[w] = math.exp(max(-30.0, min(30.0, self.emission(w))))
                    values.append(e)
                sizes.append(len(words))
                n += len(words)
            per_doc.append(n)
        p, _, _ = forward_backward(np.array(values), np.array(sizes, dtype=np.int64), self.trans)
        return np.split(p, np.cumsum(per_doc)[:-1]) if per_doc else []

    def score(self, p: np.ndarray) -> float:
        z = float(summary(p) @ self.calibrator)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def summary(p: np.ndarray) -> np.ndarray:
    """What the calibrator sees of a document: nothing but marginals and their number."""
    if not len(p):
        return np.array([1.0, 0.0, 0.0, 0.0])
    total = float(p.sum())
    return np.array([1.0, math.log1p(total), float(p.max()), math.log1p(100 * total / len(p))])


class _Sample:
    """Labelled documents as arrays: word numbers, sequence sizes, and the forms of every word."""

    def __init__(self, docs: list[tuple[str, int]]):
        numbers: dict[str, int] = {}
        tokens, sizes, per_doc = [], [], []
        for text, _ in docs:
            seqs = sequences(text)
            tokens.append(np.array([numbers.setdefault(w, len(numbers)) for s in seqs for w in s], dtype=np.int32))
            sizes.append(np.array([len(s) for s in seqs], dtype=np.int32))
            per_doc.append(len(tokens[-1]))
        self.n_words, self.tokens = len(numbers), np.concatenate([np.empty(0, np.int32), *tokens])
        self.sizes = np.concatenate([np.empty(0, np.int32), *sizes]).astype(np.int64)
        self.per_doc, self.labels = np.array(per_doc, dtype=np.int64), np.array([y for _, y in docs], dtype=np.int64)
        self.forms: dict[str, int] = {}
        counts, flat = np.zeros(self.n_words, dtype=np.int64), []
        for i, w in enumerate(numbers):
            own = [self.forms.setdefault(f, len(self.forms)) for f in forms(w)]
            counts[i] = len(own)
            flat.append(np.array(own, dtype=np.int32))
        self.flat = np.concatenate([np.empty(0, np.int32), *flat])
        self.of_word = np.repeat(np.arange(self.n_words, dtype=np.int32), counts)
        self.first = np.cumsum(counts) - counts
        self.counts = counts

    def toxic_forms(self) -> np.ndarray:
        """Forms that are significantly more frequent (by documents) in toxic than in clean documents."""
        n = np.zeros((2, len(self.forms)))
        at = np.concatenate(([0], np.cumsum(self.per_doc)))
        for y, a, b in zip(self.labels, at, at[1:]):
            words = np.unique(self.tokens[a:b])
            c = self.counts[words]
            own = self.flat[np.arange(int(c.sum())) + np.repeat(self.first[words] - (np.cumsum(c) - c), c)]
            n[y, np.unique(own)] += 1
        total = np.bincount(self.labels, minlength=2)
        odds = np.log((n[1] + 0.5) / (total[1] + 1)) - np.log((n[0] + 0.5) / (total[0] + 1))
        return (n[1] >= 6) & (odds - 2 * np.sqrt(1 / (n[1] + 0.5) + 1 / (n[0] + 0.5)) > math.log(2.5))


def fit_chain(docs: list[tuple[str, int]], steps: int = 60, rate: float = 0.5, l2: float = 1e-4) -> ToxicityModel:
    """Steps 1 and 2: token labels, then the chain's weights."""
    sample = _Sample(docs)
    marked = sample.toxic_forms()
    if not marked.any():
        return ToxicityModel()
    token, sizes, n_words = sample.tokens, sample.sizes, sample.n_words
    used = (np.bincount(sample.flat, minlength=len(marked)) >= 2) | marked
    here = used[sample.flat]
    of_word, flat = sample.of_word[here], (np.cumsum(used) - 1)[sample.flat[here]]
    n_forms = int(used.sum())
    toxic_word = np.bincount(sample.of_word[marked[sample.flat]], minlength=n_words) > 0
    label = np.repeat(sample.labels, sample.per_doc)
    y = (toxic_word[token] & (label == 1)).astype(float)
    last = np.zeros(len(token), dtype=bool)
    last[np.cumsum(sizes) - 1] = True
    pair = np.flatnonzero(~last)                              # tokens that have a successor
    seen = np.array([[np.sum((1 - y[pair]) * (1 - y[pair + 1])), np.sum((1 - y[pair]) * y[pair + 1])],
                     [np.sum(y[pair] * (1 - y[pair + 1])), np.sum(y[pair] * y[pair + 1])]])
    w, bias, trans = np.zeros(n_forms), -5.0, np.zeros((2, 2))
    g2w, g2b, g2t = np.full(n_forms, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    for _ in range(steps):                                    # AdaGrad on the log likelihood
        emission = bias + np.bincount(of_word, weights=w[flat], minlength=n_words)
        odds = np.exp(np.clip(emission, -30, 30))[token]
        a = np.exp(trans)
        p, fwd, bwd = forward_backward(odds, sizes, a)
        residual = y - p
        by_word = np.bincount(token, weights=residual, minlength=n_words)
        gw = np.bincount(flat, weights=by_word[of_word], minlength=n_forms) - l2 * len(token) * w
        x, r = odds[pair + 1] * bwd[pair + 1], fwd[pair]
        whole = a[0, 0] + a[0, 1] * x + a[1, 0] * r + a[1, 1] * r * x
        expected = np.array([[np.sum(a[0, 0] / whole), np.sum(a[0, 1] * x / whole)],
                             [np.sum(a[1, 0] * r / whole), np.sum(a[1, 1] * r * x / whole)]])
        gt, gb = seen - expected, residual.sum()
        g2w += gw ** 2
        g2b += gb ** 2
        g2t += gt ** 2
        w += rate * gw / np.sqrt(g2w)
        bias += rate * gb / math.sqrt(g2b)
        trans += rate * gt / np.sqrt(g2t)
    weights = {f: float(w[i]) for f, i in zip((f for f, k in zip(sample.forms, used) if k), range(n_forms)) if abs(w[i]) > 1e-6}
    return ToxicityModel(weights, float(bias), np.exp(trans))


def calibrate(model: ToxicityModel, docs: list[tuple[str, int]], rounds: int = 25, l2: float = 0.1) -> None:
    """Step 3: logistic regression by Newton steps."""
    y = np.array([label for _, label in docs], dtype=float)
    prior = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    model.calibrator = np.array([prior, 0.0, 0.0, 0.0])
    if not model.weights or y.min(initial=1) == y.max(initial=0):
        return
    known: dict[str, float] = {}
    x = np.array([summary(model.marginals([sequences(t)], known)[0]) for t, _ in docs])
    c = model.calibrator.copy()
    shrink = np.array([0.0, l2, l2, l2])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink) + 1e-6 * np.eye(4)
        c += np.clip(np.linalg.solve(hess, x.T @ (y - p) - shrink * c), -3, 3)
    model.calibrator = c


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_id_col: str = "doc_id", label_col: str = "toxic") -> ToxicityModel:
    known = labels.select(F.col(label_id_col).alias("of"), F.col(label_col).cast("int").alias("toxic")) \
        .where(F.col("toxic").isin(0, 1)).groupBy("of").agg(F.max("toxic").alias("toxic"))
    source = narrow(docs, id_col, text_col)
    # chosen by hashes alone, so that only the sample's texts leave their files; one of several equal texts
    keys = source.select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n"))
    rows = cut_lineage(keys.where(F.col("n") <= MAX_CHARS).join(known, F.col("doc_id") == F.col("of"))
                       .withColumn("fold", crc_fold()).where(F.col("fold") != 0)
                       .groupBy("h", "toxic").agg(F.min(F.struct("doc_id", "fold")).alias("one"))
                       .select("h", "toxic", "one.doc_id", "one.fold"))

    chain, toxic = F.col("fold") != 4, F.col("toxic") == 1
    parts = {"toxic": (chain & toxic, MAX_TOXIC), "clean": (chain & ~toxic, MAX_CLEAN), "calibration": (~chain, MAX_CALIBRATION)}
    chosen = None
    for name, (where, n) in parts.items():
        some = rows.where(where).orderBy("h", "toxic", "doc_id").limit(n).select(
            F.col("doc_id").alias("of"), F.col("h").alias("of_h"), "toxic", F.lit(name).alias("part"))
        chosen = some if chosen is None else chosen.unionByName(some)
    got = (source.withColumn("h", F.xxhash64("text"))                        # as many rows as the limits allow, at most
           .join(F.broadcast(chosen), (F.col("doc_id") == F.col("of")) & (F.col("h") == F.col("of_h")))
           .select("part", "h", "toxic", "doc_id", "text").distinct().collect())

    def sample(part: str):
        return [(r.text, r.toxic) for r in sorted((r for r in got if r.part == part), key=lambda r: (r.h, r.toxic))]

    model = fit_chain(sample("toxic") + sample("clean"))
    calibrate(model, sample("calibration"))
    return model


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _spans(text: str, p: np.ndarray, least: float) -> list[dict]:
    out, k = [], 0
    for line in re.finditer(r"[^\n]+", text):
        previous = -2
        for m in _WORD.finditer(line.group()):
            if p[k] >= least:
                a, b = m.start() + line.start(), m.end() + line.start()
                if previous == k - 1:
                    out[-1]["end"] = b
                else:
                    out.append({"start": a, "end": b})
                previous = k
            k += 1
    return out


def score_texts(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text",
                least: float = 0.5, carry: bool | list[str] = False) -> DataFrame:
    """``doc_id, score, spans`` (and the input row, if carried): one row per input row."""
    source = narrow(docs, id_col, text_col, carry, once=True)
    kind = source.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    where = {"column": text_col, "inside": True} if carry is True else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for b in (part for whole in batches for part in slices(whole, **where)):
            rows = strings(b, **where)
            marginals = shared.value.marginals([sequences(t) for t in rows], known)
            spans = [_spans(t, p, least) if len(p) and p.max() >= least else [] for t, p in zip(rows, marginals)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([shared.value.score(p) for p in marginals], pa.float64()), pa.array(spans, _SPAN),
                 *([b.column(b.schema.get_field_index("row"))] if carry else [])],
                names=["doc_id", "score", "spans", *(["row"] if carry else [])])

    return source.mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<start:long,end:long>>{row_type(source)}")
