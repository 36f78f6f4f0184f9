import hashlib
import random
import zlib
from collections import defaultdict

from opinio.llm import merkle
from opinio.llm.registry import QUERIES

from .conftest import by_id


def h(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8")).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode('utf-8'))}:{v}" for v in row))


def lowered(text):
    return text if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def climb(level, k, arity):
    """(hash that remains, siblings met) of the k-th node's way up."""
    met, path = [], []
    while len(level) > 1:
        run = k // arity
        group = level[run * arity:(run + 1) * arity]
        met += [x for i, x in enumerate(group) if i != k % arity]
        path.append((group, k % arity))
        level = [h(*level[i:i + arity]) for i in range(0, len(level), arity)]
        k = run
    return level[0], met, path


def brute(rows, arity=16):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted result rows."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode("utf-8")))
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [[leaf(r) for r in groups[s]] for s in names]
    subroots = [climb(t, 0, arity)[0] for t in trees]
    out = []
    for g, s in enumerate(names):
        for k, r in enumerate(groups[s]):
            sub, met, path = climb(trees[g], k, arity)
            root, more, up = climb(subroots, g, arity)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            x = leaf((*r[:4], lowered(r[4]))) if bad else trees[g][k]
            for group, i in path + up:
                x = h(*group[:i], x, *group[i + 1:])
            out.append((r[0], trees[g][k], sub, root, "".join(met + more), x, x == root))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_equals_brute_force(spark):
    rnd = random.Random(3)
    words = ["Upper", "lower", "é", "\n", "x" * 50]
    for arity, n, sources in ((2, 37, ["a", "b", "é", None]), (3, 60, ["hot"] * 5 + ["b", "Z"]), (16, 700, ["hot"] * 9 + [f"s{i}" for i in range(20)])):
        rows = [(i, rnd.choice(sources), rnd.choice(["en", None]), rnd.choice([None, 5, 123]), rnd.choice([None, "", " ".join(rnd.choices(words, k=4))]))
                for i in range(n)]
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        assert got(merkle.manifest(df, arity=arity)) == brute(rows, arity)


def test_tampering_shows(spark):
    rows = [(i, "a", "en", 3, "ABC") for i in range(100)]
    out = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in out if not r.verified} == {i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0}
    rows = [(i, "a", "en", 3, "abc") for i in range(100)]                     # lower-casing changes nothing
    assert all(r.verified for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect())


def test_small_trees(spark):
    for rows in ([(1, "a", "en", 1, "x")], [(1, "a", "en", 1, "x"), (2, None, None, None, None)], [(5, "a", "en", 1, "X")] * 3):
        assert got(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_edge_cases(nasty, empty):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in nasty.collect()]
    assert got(merkle.manifest(nasty)) == brute(rows)
    assert merkle.manifest(empty).count() == 0
    assert sum(map(len, by_id(merkle.manifest(nasty)).values())) == len(rows)


def test_limit_is_put_back(spark, nasty):
    key = merkle._ROW_LIMIT
    before = spark.conf.get(key, None)
    merkle.manifest(nasty)
    assert spark.conf.get(key, None) == before
    spark.conf.set(key, "77")
    try:
        merkle.manifest(nasty)
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.unset(key)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*merkle.FIELDS).collect()]
    assert got(QUERIES["op12_merkle"](spark, sf)) == sorted(((*r[:4], h(r[4]), *r[5:]) for r in brute(rows)), key=str)
