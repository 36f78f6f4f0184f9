import random
import re

from opinio.llm import secrets

BASE = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 20), ("hex", re.compile(r"[0-9a-f]+"), 24)]
MORE = [("pem", re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"), 1), ("forge", re.compile(r"gh[pousr]_[A-Za-z0-9]+"), 40),
        ("chat", re.compile(r"xox[abprs]-[A-Za-z0-9-]+"), 15), ("maps", re.compile(r"AIza[A-Za-z0-9_-]+"), 39),
        ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), 40)]
KINDS = [r.kind for r in secrets.RULES]


def brute(text):
    out = []
    for kind, regex, least in BASE + MORE:
        for m in regex.finditer(text):
            if len(m.group(2) if kind == "assign" else m.group()) >= least:
                out.append((m.start(), m.end(), KINDS.index(kind)))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_scan_equals_regex_engine():
    rnd = random.Random(5)
    parts = ["password", "PassWd", "secret", "token", "api_key", "ApiKey", "=", ":", " ", '"', "'", "abc", "é", "\n", ",",
             "AKIA", "AKIAAKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", ".", "-", "x", "eyJabc", "ghp_",
             "xoxb-", "AIza", "-----BEGIN RSA ", "PRIVATE KEY-----", "Z" * 30]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(50))) for _ in range(3000)]
    assert secrets.scan([t.encode() for t in texts]) == [brute(t) for t in texts]


def test_failed_assign_uses_up_its_text():
    assert secrets.scan([b"secret=token:abcdefgh"]) == [[]]
    assert secrets.scan([b"secret=short, token:abcdefgh"]) == [[(14, 28, 0)]]


def test_edge_cases(nasty, empty):
    assert nasty.count() == secrets.find_secrets(nasty).count()
    assert all(r.spans == [] for r in secrets.find_secrets(nasty).collect())
    assert secrets.find_secrets(empty).count() == 0


def test_offsets_are_code_points(spark):
    df = spark.createDataFrame([(1, "éé password = hunter22 日 AKIA" + "B" * 16)], "doc_id long, text string")
    spans = secrets.find_secrets(df).first().spans
    assert [(s.kind, s.start, s.end) for s in spans] == [("assign", 3, 22), ("access", 25, 45)]


def test_long_text():
    text = "x " * 200_000 + "token=abcdef " + "y" * 100_000
    assert secrets.scan([text.encode(), b""]) == [[(400_000, 400_012, 0)], []]
