"""Exact, interpolated quantiles without gathering values in one task.

``percentile`` merges every distinct value of a column into one task (the
final aggregate of a global aggregation); at scale a double column has
about as many distinct values as rows.  Instead we select the k-th
smallest value by bucket refinement:

1. one pass: count, min and max per column;
2. each round is one job for all (column, rank) targets together: values
   inside each target's current interval are put in ``BUCKETS`` equal-width
   buckets and counted (with the min and max value of each bucket); only
   targets x buckets rows reach the driver;
3. the bucket that holds the target rank becomes the next interval (its
   actual min..max), until that bucket holds a single value.

Each round shrinks an interval by about ``BUCKETS``; integer-valued columns
finish in one or two rounds, doubles in a handful.  Quantile p then
interpolates between ranks floor(h) and floor(h)+1 with h = (n-1)p, as
pandas/numpy (linear) and SQL ``quantile_cont`` do.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.session import cut_lineage

BUCKETS = 1024


def _long_values(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in cols]))
    ).where(F.col("x").isNotNull() & ~F.isnan("x"))


def kth_smallest(vals: DataFrame, cols: list[str], ranks: dict[str, list[int]],
                 stats: dict[str, tuple[int, float, float]]) -> dict[tuple[str, int], float]:
    """0-based rank -> value, for each column's requested ranks; ``vals`` is
    the long (c, x) table."""
    spark = vals.sparkSession
    # target: (c, rank) -> [lo, hi, below] ; below = number of values < lo
    state = {}
    done: dict[tuple[str, int], float] = {}
    for c in cols:
        n, mn, mx = stats[c]
        for r in ranks.get(c, []):
            if mn == mx:
                done[(c, r)] = mn
            else:
                state[(c, r)] = [mn, mx, 0]
    while state:                # a round always parts the smallest from the largest value, so this ends
        tgt = spark.createDataFrame(
            [(c, r, lo, hi) for (c, r), (lo, hi, _b) in state.items()],
            "c string, r long, lo double, hi double")
        half = F.col("hi") / 2 - F.col("lo") / 2              # halves: the full width may overflow
        share = (F.col("x") / 2 - F.col("lo") / 2) / F.greatest(half, F.lit(5e-324))
        bucket = (F.when(F.col("x") == F.col("hi"), BUCKETS - 1).when(F.col("x") == F.col("lo"), 0)
                  .otherwise(F.least(F.greatest(F.floor(share * BUCKETS), F.lit(0)), F.lit(BUCKETS - 1))).cast("int"))
        hist = (vals.join(F.broadcast(tgt), "c")
                .where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
                .groupBy("c", "r", bucket.alias("b"))
                .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("bmin"), F.max("x").alias("bmax"))
                .collect())
        per: dict[tuple[str, int], list] = {}
        for row in hist:
            per.setdefault((row["c"], row["r"]), []).append((row["b"], row["n"], row["bmin"], row["bmax"]))
        for key, buckets in per.items():
            lo, hi, below = state[key]
            want = key[1] - below
            acc = 0
            for b, n, bmin, bmax in sorted(buckets):
                if acc + n > want:
                    if bmin == bmax:
                        done[key] = bmin
                        del state[key]
                    else:
                        state[key] = [bmin, bmax, below + acc]
                    break
                acc += n
    return done


def long_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """The narrow (column, value) table, written once to the shared
    checkpoint folder: the refinement rounds and the summary stats read it
    instead of re-running the plan that produced ``df``."""
    return cut_lineage(_long_values(df, cols))


def quantiles_from_long(vals: DataFrame, cols: list[str], probs: list[float]) -> dict[str, float | None]:
    """``{col}|q{p}`` -> value from the long table.  Infinite values are counted, and only the finite
    ones are searched; between two different values of which one is infinite, the quantile is the upper one."""
    inf = F.lit(float("inf"))
    finite = (F.col("x") != inf) & (F.col("x") != -inf)
    got = {r["c"]: r for r in
           vals.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") == -inf).alias("low"),
                                 F.count_if(finite).alias("mid"), F.min(F.when(finite, F.col("x"))).alias("mn"),
                                 F.max(F.when(finite, F.col("x"))).alias("mx")).collect()}
    vals = vals.where(finite)
    stats = {c: (got[c]["n"], got[c]["mn"], got[c]["mx"]) if c in got else (0, None, None) for c in cols}
    ranks: dict[str, list[int]] = {}
    for c in cols:
        n = stats[c][0]
        if not n:
            continue
        rs = set()
        for p in probs:
            h = (n - 1) * p
            rs.add(int(math.floor(h)))
            rs.add(min(int(math.floor(h)) + 1, n - 1))
        ranks[c] = sorted(rs)
    kth: dict[tuple[str, int], float] = {}
    search: dict[str, list[int]] = {}
    for c, rs in ranks.items():
        low, mid = got[c]["low"], got[c]["mid"]
        for r in rs:
            if r < low:
                kth[(c, r)] = float("-inf")
            elif r >= low + mid:
                kth[(c, r)] = float("inf")
            else:
                search.setdefault(c, []).append(r - low)
    for (c, r), v in kth_smallest(vals, list(search), search, stats).items():
        kth[(c, r + got[c]["low"])] = v
    out: dict[str, float | None] = {}
    for c in cols:
        n = stats[c][0]
        for p in probs:
            if not n:
                out[f"{c}|q{p}"] = None
                continue
            h = (n - 1) * p
            lo_i = int(math.floor(h))
            hi_i = min(lo_i + 1, n - 1)
            v_lo, v_hi = kth[(c, lo_i)], kth[(c, hi_i)]
            if v_lo == v_hi or h == lo_i:
                out[f"{c}|q{p}"] = float(v_lo)
            elif math.isinf(v_lo) or math.isinf(v_hi):
                out[f"{c}|q{p}"] = float(v_hi)
            else:
                out[f"{c}|q{p}"] = float(v_lo * (1 - (h - lo_i)) + v_hi * (h - lo_i)) if math.isinf(v_hi - v_lo) \
                    else float(v_lo + (v_hi - v_lo) * (h - lo_i))
    return out


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """One-row DataFrame with a column ``{col}|q{p}`` per column and prob."""
    out = quantiles_from_long(long_values(df, cols), cols, probs)
    names = list(out)
    return df.sparkSession.createDataFrame([tuple(out[k] for k in names)],
                                           ", ".join(f"`{k}` double" for k in names))
