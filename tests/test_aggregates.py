import numpy as np
from pyspark.sql import functions as F

from opinio.operators import aggregates as A
from opinio.operators.quantiles import exact_quantiles


def test_histogram_properties(spark):
    vals = [float(x) for x in np.random.default_rng(1).normal(size=200)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    h = A.equal_width_histogram(df, "x", 10).orderBy("bin").collect()
    assert len(h) == 10 and sum(r["count"] for r in h) == 200
    want, _ = np.histogram(vals, bins=10)
    assert [r["count"] for r in h] == list(want)
    same = spark.createDataFrame([(1.0,)] * 5, "x double")
    assert [r["count"] for r in A.equal_width_histogram(same, "x", 10).orderBy("bin").collect()] == [5] + [0] * 9


def test_correlation_matrix(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=50)
    b = a * 2 + rng.normal(size=50)
    df = spark.createDataFrame([(float(x), float(y), 3.0) for x, y in zip(a, b)], "a double, b double, c double")
    m = {(r["col_a"], r["col_b"]): r["r"] for r in A.correlation_matrix(df).collect()}
    assert m[("a", "a")] == 1.0 and m[("a", "b")] == m[("b", "a")]
    assert abs(m[("a", "b")] - round(float(np.corrcoef(a, b)[0, 1]), 6)) < 1e-6
    assert m[("a", "c")] is None        # constant column: no division by zero


def test_polarity_grid_has_zero_rows(spark):
    df = spark.createDataFrame([("Product Review", "Positive")], "classification string, Polarity string")
    out = A.polarity_by_class(df).collect()
    assert len(out) == 6 and sum(r["count"] for r in out) == 1


def test_shares_sum_to_one(spark):
    df = spark.createDataFrame([("m1", "Positive"), ("m1", "Negative"), ("m2", "Neutral")],
                               "Short_Model_Name string, Polarity string")
    for r in A.polarity_share_by_model(df).collect():
        assert abs(r["Negative"] + r["Neutral"] + r["Positive"] - 1.0) < 1e-6


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = list(rng.normal(size=300)) + [5.0] * 200 + list(rng.integers(0, 7, 100).astype(float))
    df = spark.createDataFrame([(float(v), float(i % 11)) for i, v in enumerate(x)], "x double, y double")
    q = exact_quantiles(df, ["x", "y"], [0.25, 0.5, 0.75]).collect()[0]
    for c, arr in (("x", np.array(x)), ("y", np.array([float(i % 11) for i in range(len(x))]))):
        for p in (0.25, 0.5, 0.75):
            assert abs(q[f"{c}|q{p}"] - float(np.quantile(arr, p))) < 1e-9


def test_describe_text_and_random_sample(spark):
    from opinio.operators.profile import describe_text, sample_rows
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("c",), ("c",)], "x string")
    r = describe_text(df, ["x"]).collect()[0]
    assert (r["count"], r["unique"], r["top"], r["freq"]) == (5, 3, "b", 2)     # tie b/c: smallest
    big = spark.range(1000)
    assert sample_rows(big, 50, seed=7).count() == 50
    assert sample_rows(big, 50, seed=7).collect() == sample_rows(big, 50, seed=7).collect()


def test_quantiles_with_infinite_and_extreme_values(spark):
    from opinio.operators.quantiles import exact_quantiles
    inf = float("inf")
    cases = {"inf": [1.0, 2.0, inf, -inf, 3.0], "wide": [-1.7e308, 1.7e308, 0.0, 5.0], "tiny": [5e-324, 0.0, 1e-323],
             "all": [inf, inf], "near": [1.0, 1.0000000000000002, 1.0]}
    for name, values in cases.items():
        r = exact_quantiles(spark.createDataFrame([(v,) for v in values], "x double"), ["x"], [0.0, 0.5, 1.0]).first()
        s = sorted(values)
        mid = s[len(s) // 2] if len(s) % 2 else (s[len(s) // 2 - 1] + s[len(s) // 2]) / 2
        assert [r["x|q0.0"], r["x|q0.5"], r["x|q1.0"]] == [s[0], mid, s[-1]], name
