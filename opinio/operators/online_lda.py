"""Online LDA over full passes: Spark ML's algorithm, with the documents of a task inferred together in numpy.

Spark ML infers one sampled document after the other, a copy drawn ``c`` times ``c`` times over, with a few small matrix calls
each.  Here a task infers its distinct sampled documents side by side, each until its own topics stay, and weights it by ``c``.
Samples, initial values, updates and the stopping rule are Spark's, number by number, so the model is the same up to about a part in 10^7 (Spark's digamma is off by 3e-9).

A pass sends topics x terms numbers to the tasks and back, added up in slices on the way.  The result is Spark ML's model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import LDA, LocalLDAModel
from pyspark.mllib.common import _py2java
from pyspark.mllib.linalg import DenseMatrix, DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAMMA_SHAPE = 100.0
#: numbers of a block of documents, of a slice of the sums
BLOCK, SLICE = 1 << 17, 1 << 19


class JavaRandom:
    """java.util.Random, as far as needed: the seeds of samples and initial values."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def _next(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        high = self.state >> 16
        return high - (1 << 32) if high >> 31 else high

    def next_long(self) -> int:
        return _signed((self._next() << 32) + self._next())


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def gamma_draws(seed: int, n: int, shape: float = GAMMA_SHAPE) -> np.ndarray:
    """``n`` draws from Gamma(shape, 1 / shape) of a Mersenne Twister with that 64-bit seed (Marsaglia and Tsang's method)."""
    bits = np.random.RandomState(np.array([(seed >> 32) & 0xFFFFFFFF, seed & 0xFFFFFFFF], np.uint32))
    pool, at, spare = np.empty(0), 0, None
    d = shape - 1.0 / 3.0
    c = 1.0 / math.sqrt(9.0 * d)
    out = np.empty(n)

    def uniform() -> float:
        nonlocal pool, at
        if at == len(pool):
            raw = bits.randint(0, 1 << 32, size=2 * min(max(8, 4 * n), 65536), dtype=np.uint32).astype(np.int64).reshape(-1, 2)
            pool, at = (((raw[:, 0] >> 6) << 26) | (raw[:, 1] >> 6)) * 2.0 ** -52, 0
        at += 1
        return float(pool[at - 1])

    def gaussian() -> float:
        nonlocal spare
        if spare is not None:
            x, spare = spare, None
            return x
        angle, r = 2 * math.pi * uniform(), math.sqrt(-2 * math.log(uniform()))
        spare = r * math.sin(angle)
        return r * math.cos(angle)

    for i in range(n):
        while True:
            x = gaussian()
            v = 1.0 + c * x
            while v <= 0:
                x = gaussian()
                v = 1.0 + c * x
            v, x2, u = v * v * v, x * x, uniform()
            if u < 1.0 - 0.0331 * (x2 * x2) or math.log(u) < 0.5 * x2 + d * (1.0 - v + math.log(v)):
                out[i] = (1.0 / shape) * d * v
                break
    return out


def digamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: moved up by eight, then the asymptotic series."""
    y = x * (x + 7)
    z = x + 8
    i = 1 / z
    q = i * i
    series = q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q * (1 / 240 - q * (1 / 132 - q * (691 / 32760))))))
    return np.log(z) - 0.5 * i - series - (2 * x + 7) * (1 / y + 1 / (y + 6) + 1 / (y + 10) + 1 / (y + 12))


def trigamma(x: np.ndarray) -> np.ndarray:
    x, add = np.asarray(x, float), 0.0
    for _ in range(12):
        add = add + 1 / (x * x)
        x = x + 1
    q = 1 / (x * x)
    return add + 1 / x + q / 2 + q / x * (1 / 6 - q * (1 / 30 - q * (1 / 42 - q / 30)))


def expectation(alpha: np.ndarray) -> np.ndarray:
    """E[log p] of Dirichlet distributions along the first axis."""
    of = digamma(np.concatenate((alpha, alpha.sum(axis=0, keepdims=True))))
    return of[:-1] - of[-1:]


def exp_expectation(alpha: np.ndarray) -> np.ndarray:
    """exp(E[log p]), without a logarithm: exp(digamma(x + 1/2)) is nearly x (asymptotic series); smaller numbers are moved up by eight."""
    x = np.concatenate((alpha, alpha.sum(axis=0, keepdims=True)))
    y = x * (x + 7)
    z = x + 7.5
    q = 1 / (z * z)
    # the sum of 1 / x to 1 / (x + 7), over one denominator: pairs of factors are y, y + 6, y + 10 and y + 12
    a, b = y * (y + 6), (y + 10) * (y + 12)
    moved = (x + 3.5) * ((y + 3) * b + (y + 11) * a) / (a * b)
    of = np.exp(-4 * moved) * (z * (1 + q * (1 / 24 - q * (37 / 5760 - q * (10313 / 2903040 - q * (5509121 / 1393459200))))))
    return of[:-1] / of[-1:]


def infer(terms: np.ndarray, counts: np.ndarray, begin: np.ndarray, length: np.ndarray, exp_beta: np.ndarray, alpha: np.ndarray,
          start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Topics of documents, whose entries lie in ``terms`` and ``counts`` from ``begin`` on, ``length`` (one or more) of each.

    Gives gamma and exp(E[log theta]) (topics x documents).  Most documents end early: the rest of a block is put off and meets
    the rest of other blocks, so that blocks stay full."""
    k, docs = len(alpha), len(length)
    gamma = np.repeat(start[:, None], docs, axis=1)
    theta = np.repeat(exp_expectation(start[:, None]), docs, axis=1)
    left = np.arange(docs)
    while len(left):
        blocks = [left[b] for b in _blocks(length[left], k)]
        left = np.concatenate([_settle(b, terms, counts, begin[b], length[b], exp_beta, alpha[:, None], gamma, theta,
                                       len(b) // 4 if len(blocks) > 1 else 0) for b in blocks])
    return gamma, theta


def _settle(docs, terms, counts, begin, length, exp_beta, alpha, gamma_of, theta_of, few: int) -> np.ndarray:
    """Goes on with a block of documents until at most ``few`` are left, which are returned."""
    k = len(alpha)
    slot = np.arange(int(length.max()))[:, None]
    place = np.where(slot < length, begin + slot, 0)
    # topics x slots x documents, documents next to each other in memory; empty slots count 0
    beta, n = np.take(exp_beta, terms[place], axis=1), np.where(slot < length, counts[place], 0.0)
    gamma, theta = np.take(gamma_of, docs, axis=1), np.take(theta_of, docs, axis=1)
    still, norm = np.ones(len(docs), dtype=bool), np.empty(n.shape)
    while True:
        np.einsum("kmd,kd->md", beta, theta, out=norm)
        np.add(norm, 1e-100, out=norm)
        np.divide(n, norm, out=norm)
        new = theta * np.einsum("kmd,md->kd", beta, norm) + alpha
        goes_on = np.abs(new - gamma).sum(axis=0) / k > 1e-3
        gamma, theta = new, exp_expectation(new)
        ended = np.flatnonzero(still & ~goes_on)
        if not len(ended):
            continue
        gamma_of[:, docs[ended]], theta_of[:, docs[ended]] = gamma[:, ended], theta[:, ended]
        still &= goes_on
        at = np.flatnonzero(still)
        if len(at) <= few:
            gamma_of[:, docs[at]], theta_of[:, docs[at]] = gamma[:, at], theta[:, at]
            return docs[at]
        if 4 * len(at) <= 3 * len(still):                     # what has ended is left out
            beta, n, gamma, theta = np.take(beta, at, axis=2), *(np.take(x, at, axis=1) for x in (n, gamma, theta))
            docs, still, norm = docs[at], still[at], np.empty(n.shape)


def _blocks(lengths: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Documents of like lengths, at most ``BLOCK`` numbers of topics x slots each (at least one document)."""
    order = np.argsort(lengths, kind="stable")
    at = len(order)
    while at:
        size = max(1, BLOCK // (k * int(lengths[order[at - 1]])))
        yield order[max(0, at - size):at]
        at = max(0, at - size)


def _pass(docs: DataFrame, exp_beta: np.ndarray, alpha: np.ndarray, sample_seed: int, seed: int):
    """One pass over a sample: (topics x terms sums, summed E[log theta], sampled documents with terms), or None for an empty sample."""
    sc, (k, vocabulary) = docs.sparkSession.sparkContext, exp_beta.shape
    shared = sc.broadcast((exp_beta, alpha))
    slices = -(-(k + 1 + k * vocabulary) // SLICE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta, alpha = shared.value
        start = gamma_draws(_signed(seed + TaskContext.get().partitionId()), k)
        total, log_theta, full, rows = np.zeros((k, vocabulary)), np.zeros(k), 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            doc = b.column(0).to_numpy()
            first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))      # drawn copies follow each other
            times = np.diff(np.concatenate((first, [len(doc)])))
            rows += len(doc)
            length = b.column(1).value_lengths().to_numpy()
            begin = (np.cumsum(length) - length)[first]
            length = length[first]
            terms, counts = b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()
            nonzero = np.concatenate(([0], np.cumsum(counts != 0)))
            some = np.flatnonzero(nonzero[begin + length] > nonzero[begin])
            full += int(times[some].sum())
            if not len(some):
                continue
            begin, length, times = begin[some], length[some], times[some]
            gamma, theta = infer(terms, counts, begin, length, beta, alpha, start)
            log_theta += expectation(gamma) @ times
            entry = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            ids, norm = terms[entry], 1e-100
            for t in range(k):
                norm = norm + beta[t][ids] * np.repeat(theta[t], length)
            ratio = counts[entry] / norm * np.repeat(times, length)
            for t in range(k):
                total[t] += np.bincount(ids, weights=ratio * np.repeat(theta[t], length), minlength=vocabulary)
        if rows:
            flat = np.concatenate((log_theta, [float(full)], total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array(
                [flat[x * SLICE:(x + 1) * SLICE].tobytes() for x in range(slices)], pa.binary())], names=["slice", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(x.as_buffer())
                total[s] = total[s] + x if s in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())],
                                             names=["slice", "sums"])

    kind = "slice int, sums binary"
    rows = (docs.sample(withReplacement=True, fraction=1.0, seed=sample_seed).mapInArrow(run, kind)
            .repartition(slices, "slice").mapInArrow(add, kind).collect())
    shared.destroy()
    if not rows:
        return None
    flat = np.concatenate([np.frombuffer(r["sums"]) for r in sorted(rows, key=lambda r: r["slice"])])
    return flat[k + 1:].reshape(k, vocabulary), flat[:k], flat[k]


def _next_alpha(alpha: np.ndarray, log_theta: np.ndarray, docs: float, weight: float) -> np.ndarray:
    """A Newton step of the documents' prior, if it stays positive."""
    gradient = docs * (log_theta - expectation(alpha))
    c, q = docs * trigamma(alpha.sum()), -docs * trigamma(alpha)
    b = (gradient / q).sum() / (1 / c + (1 / q).sum())
    new = alpha - weight * (gradient - b) / q
    return new if (new > 0).all() else alpha


def _model(lda: LDA, vec: DataFrame, topics: np.ndarray, alpha: np.ndarray, eta: float) -> LocalLDAModel:
    spark = vec.sparkSession
    sc, jvm = spark.sparkContext, spark._jvm
    k, vocabulary = topics.shape
    old = jvm.org.apache.spark.mllib.clustering.LocalLDAModel(
        _py2java(sc, DenseMatrix(vocabulary, k, topics.ravel())), _py2java(sc, DenseVector(alpha)), eta, GAMMA_SHAPE)
    new = jvm.org.apache.spark.ml.clustering.LocalLDAModel(lda.uid, vocabulary, old, spark._jsparkSession)
    lda._transfer_params_to_java()
    lda._java_obj.copyValues(new, jvm.org.apache.spark.ml.param.ParamMap())
    return lda._copyValues(LocalLDAModel(new))


def fit(vec: DataFrame, lda: LDA) -> LocalLDAModel:
    """The model that ``lda`` (online, every pass over a sample as large as the corpus) fits to the vectors of ``vec``."""
    features = F.unwrap_udt(lda.getFeaturesCol())
    dense = F.sequence(F.lit(0), features["size"] - 1)
    docs = vec.select(F.monotonically_increasing_id().alias("doc"), F.coalesce(features["indices"], dense).alias("terms"),
                      features["values"].alias("counts"), features["size"].alias("size")).persist()
    try:
        vocabulary = docs.select(F.coalesce("size", F.size("counts"))).first()[0]
        entries = docs.drop("size")
        k, tau, kappa = lda.getK(), lda.getLearningOffset(), lda.getLearningDecay()
        alpha, eta = np.full(k, 1.0 / k), 1.0 / k
        random = JavaRandom(lda.getSeed())
        topics, iteration = gamma_draws(random.next_long(), k * vocabulary).reshape(k, vocabulary), 0
        for _ in range(lda.getMaxIter()):
            sample_seed = random.next_long()
            ahead = JavaRandom(0)
            ahead.state = random.state                        # an empty sample takes no second seed
            seed = ahead.next_long()
            exp_beta = np.ascontiguousarray(np.exp(expectation(topics.T).T))
            found = _pass(entries, exp_beta, alpha, sample_seed, seed)
            if found is None:
                continue
            random, iteration = ahead, iteration + 1
            sums, log_theta, full = found
            if not full:
                continue
            weight = (tau + iteration) ** -kappa
            topics = (1 - weight) * topics + weight * (sums * exp_beta + eta)
            log_theta = log_theta / full
            alpha = _next_alpha(alpha, log_theta, full, weight) if lda.getOptimizeDocConcentration() else alpha
    finally:
        docs.unpersist()
    return _model(lda, vec, topics, alpha, eta)
