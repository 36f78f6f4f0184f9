import random
from collections import defaultdict

from pyspark.sql import functions as F

from opinio.llm import line_dedup
from opinio.llm.common import shared_folder

from .conftest import by_id


def key(line):
    line = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)


def brute(rows, min_chars, min_docs):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = defaultdict(list)
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs
                or i == max(h for h in holders[key(x)] if h is not None)]
        out[i].append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return {i: sorted(x) for i, x in out.items()}


def test_equals_brute_force(spark):
    rnd = random.Random(4)
    lines = ["Common line number %d, é long enough" % k for k in range(6)] + ["short", "", "  padded COMMON line é\t", " "]
    rows = [(rnd.choice([None, *range(30)]), "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(8)))) for _ in range(80)]
    rows += [(31, None), (32, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for batches in (1, 4, 7):
        got = defaultdict(list)
        for r in line_dedup.dedup_lines(df, min_chars=15, min_docs=4, batches=batches).collect():
            got[r.doc_id].append((r.n_lines, r.n_dropped, r.text))
        assert {i: sorted(x) for i, x in got.items()} == brute(rows, 15, 4)


def test_runs_are_levelled(spark):
    """Batches of keys; totals are exact whatever the levels look like."""
    runs = line_dedup.LineRuns(spark, shared_folder(spark, "runs"), buckets=4, fanout=2)
    rnd, expected = random.Random(1), defaultdict(set)
    for batch in range(5):
        rows = [(rnd.randrange(20), 7, batch * 100 + rnd.randrange(50)) for _ in range(60)]
        for h, _, d in rows:
            expected[h].add(d)
        runs.add(spark.createDataFrame(rows, "h1 long, h2 long, doc_id long"))
        assert all(len(level) < 2 for level in runs.levels)
        homes = [r.h1 for level in runs.levels for run in level for r in run.rows.select("h1").collect()]
        assert len(homes) == len(set(homes))                  # a key is new in one run only
    got = {r.h1: (r.n_docs, r["last"]) for r in runs.totals().collect()}
    assert got == {h: (len(d), max(d)) for h, d in expected.items()}


def test_edge_cases(nasty, empty):
    got = by_id(line_dedup.dedup_lines(nasty, min_docs=2, carry=True))
    assert got[3][0].text == "" and got[3][0].n_lines == 1 and got[4][0].n_dropped == 0
    assert got[5][0].n_lines == 2
    assert [r.n_dropped for r in got[1]] == [1, 1] and got[2][0].n_dropped == 1 and got[9][0].n_dropped == 0
    assert sorted((r.n_dropped, r.text) for r in got[None])[1] == (1, "")
    assert sum(map(len, got.values())) == nasty.count()
    assert line_dedup.dedup_lines(empty).count() == 0


def test_only_dataframe_functions(nasty):
    plan = line_dedup.dedup_lines(nasty)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_many_lines_in_one_document(spark):
    text = "\n".join(f"a line that is long enough to take part {k % 3000}" for k in range(20_000))
    df = spark.createDataFrame([(k, text) for k in range(5)], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df).select("doc_id", "n_lines", "n_dropped").collect()}
    assert got == {**{k: (20_000, 20_000) for k in range(4)}, 4: (20_000, 0)}
    assert df.select(F.length("text")).first()[0] == len(text)


def test_runs_are_merged_as_they_are(spark):
    """No exchange and no sort above the scans of the runs, before and after a compaction."""
    runs = line_dedup.LineRuns(spark, shared_folder(spark, "runs"), buckets=4, fanout=2)
    for batch in range(3):
        runs.add(spark.range(2000).selectExpr("id % 700 AS h1", f"id % 7 + {batch} AS h2", "id AS doc_id"))
    assert len(runs.levels) == 2 and runs.levels[0] and runs.levels[1]
    with line_dedup.files_in_order(spark):
        plan = runs.unseen(runs.levels[0][0], runs.levels[1])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Sort " not in plan.replace("SortMergeJoin", "") and "Exchange" not in plan


def test_a_batch_is_written_once(spark):
    """Four batches and three merges are seven runs, fresh and known keys together, and the totals are exact."""
    folder = shared_folder(spark, "runs")
    runs, expected = line_dedup.LineRuns(spark, folder, buckets=3, fanout=2), defaultdict(list)
    for batch in range(4):
        rows = [((7 * k + batch) % (30 + batch), k % 2, 100 * batch + k % 9) for k in range(90)]
        for a, b, d in rows:
            expected[a, b].append(d)
        runs.add(spark.createDataFrame(rows, "h1 long, h2 long, doc_id long"))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    assert len(names) == 7 and [len(level) for level in runs.levels] == [0, 0, 1]
    assert {(r.h1, r.h2): (r.n_docs, r["last"]) for r in runs.totals().collect()} == {
        k: (len(set(d)), max(d)) for k, d in expected.items()}
    assert runs.levels[2][0].rows.count() == len(expected)
