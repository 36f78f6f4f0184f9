import pytest

LONG = " ".join(f"w{i % 977}" for i in range(40_000))


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and
    extra columns whose names the operators use themselves."""
    text = "One two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text), (1, text), (2, text), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (None, text),
            (None, None), (7, "é\u00a0ü ▁ x\x00y"), (8, "a"), (9, "ONE two three four five six seven eight nine ten eleven TWELVE")]
    data = [(i, t, None if k % 3 else "en", None if k % 2 else f"s{k}", None if t is None else len(t),
             "r", k, None, 1.5, "n") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(
        data, "doc_id long, text string, lang string, source string, n_chars long, "
              "row string, th int, host string, score double, node string").repartition(3)


@pytest.fixture(scope="session")
def empty(nasty):
    return nasty.where("1 = 0")


def by_id(df):
    """doc_id -> list of rows."""
    out = {}
    for r in df.collect():
        out.setdefault(r[0], []).append(r)
    return out
