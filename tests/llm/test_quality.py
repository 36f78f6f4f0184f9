import random
import re
from collections import Counter

from opinio.llm import quality

from .conftest import by_id

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(inside))


def test_counts_equal_brute_force():
    rnd = random.Random(3)
    parts = ["a", "b", "é", " ", " ", "\n", "\u00a0", "#", "|", "\x0b", "日本", "\x1c"]
    for _ in range(2000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randrange(40)))
        assert quality.measure(t.encode()) == brute(t)


def test_host_rates_shrink(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(f"big{h}", good if k % 10 else "x") for h in range(5) for k in range(100)]
    rows += [("tiny", "x"), ("tiny", "x"), ("bad", good)] + [("bad", "x")] * 200
    df = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    measured = quality.measured(df)
    rates = {r.host: r.rate_few_words for r in quality.host_rates(measured).collect()}
    n = {h: sum(x == h for x, _ in rows) for h in rates}
    f = {h: sum(x == h and t == "x" for x, t in rows) for h in rates}
    m = sum(f.values()) / sum(n.values())
    v = sum(f[h] ** 2 / n[h] for h in n) / sum(n.values()) - m * m
    s = max(m * (1 - m) / v - 1, 1.0)
    assert all(abs(rates[h] - (f[h] + m * s) / (n[h] + s)) < 1e-9 for h in n)
    assert rates["tiny"] < f["tiny"] / n["tiny"]
    got = quality.judge(df).collect()
    assert not any(r.kept for r in got if r.host == "bad")    # its one good document goes with the host
    assert all(r.kept for r in got if r.host.startswith("big") and r.n_words == 60)


def test_edge_cases(nasty, empty):
    got = by_id(quality.judge(nasty))
    assert sum(map(len, got.values())) == nasty.count()
    assert got[3][0].n_words == 0 and got[3][0].base_failed and not got[3][0].kept
    assert got[5][0].n_lines == 0 and got[6][0].n_words == 40_000
    assert len(got[1]) == 2 and len(got[None]) == 2
    assert quality.judge(empty).count() == 0
