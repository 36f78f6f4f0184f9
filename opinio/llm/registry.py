"""Registered queries of the training-data operators and their DuckDB SQL.

Each query applies one operator to its whole table; digest columns that a
contract asks for are derived here from the operator's real output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.sources.tables import table

from . import (cover_tree, decontaminate, jaccard, line_dedup, lookup_clusters, merkle, quality, secrets, spm, token_counts, token_files,
               toxicity, url_filter)
from .common import crc_fold, shared_folder


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select("doc_id", *[count(k) for k in secrets.BASE_KINDS],
                        F.sha2(written(base), 256).alias("base_sha256"), written("spans").alias("spans"))


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on the driver (tasks get the vocabulary by broadcast)."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


SENTENCEPIECE = "piece_bpe_32k.model"


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the digest of the text decoded from them
    (a literal U+2581 comes back as a space)."""
    docs = table(spark, sf_dir, "documents")
    out = spm.encode_texts(docs, tokenizer_path(SENTENCEPIECE), with_text=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      F.sha2("text", 256).alias("decoded_sha256"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + k - 1), ' ') AS shingle FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.other = e.x)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(SENTENCEPIECE))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
ln AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos FROM d),
k AS (SELECT r, doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM ln),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND (k.doc_id IS NULL OR k.doc_id <> c.last) AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, model).select(
        "doc_id", (crc_fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "spans")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM w WHERE len(w) > 2)),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q
        FROM (SELECT r, p, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM g) WHERE k > 1) GROUP BY r),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.doc_id, d.source, CAST(len(w.w) AS BIGINT) AS n_words,
      CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(coalesce(ln.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(ln.n_dup, 0) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN w ON w.r = d.r LEFT JOIN ln ON ln.r = d.r LEFT JOIN rep ON rep.r = d.r),
f AS (SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, 2 * n_symbols > n_words AS f3,
      100 * n_dup_lines > 50 * n_lines AS f4 FROM m),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, unnest([1, 2, 3, 4]) AS rule,
      unnest([count(*) FILTER (f1), count(*) FILTER (f2), count(*) FILTER (f3), count(*) FILTER (f4)]) AS x FROM f GROUP BY source),
pr AS (SELECT rule, sum(x) / sum(n) AS m, sum(x * x / n) / sum(n) - (sum(x) / sum(n)) * (sum(x) / sum(n)) AS v FROM h GROUP BY rule),
rt AS (SELECT source, max(CASE WHEN v > 1e-12 THEN (x + m * greatest(m * (1 - m) / v - 1, 1.0)) / (n + greatest(m * (1 - m) / v - 1, 1.0))
       ELSE m END) AS rate FROM h JOIN pr USING (rule) GROUP BY source)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
       NOT (f1 OR f2) AND rate <= 0.5 AS kept
FROM f JOIN rt ON f.source IS NOT DISTINCT FROM rt.source
"""


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the files below the shared folder and returns what is read back from them."""
    folder = shared_folder(spark, "token-files")
    base = token_files.write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"))
    return token_files.read_documents(spark, folder, base, with_ids=False)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_probability")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict by coverage, and the text without its long spans: those of at least a whole window."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), with_text=True)
    cut = decontaminate.remove_spans(found, decontaminate.WINDOW)
    return cut.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      "contaminated", F.sha2("clean_text", 256).alias("clean_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, list_slice(w, p, p + n - 1) AS win
       FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM bl)),
sizes AS (SELECT DISTINCT n FROM bl),
dw AS (SELECT doc_id, n, p, list_slice(w, p, p + n - 1) AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, dw.n, p, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
        FROM (SELECT doc_id, unnest(range(p, p + n)) AS pos FROM (SELECT DISTINCT doc_id, n, p FROM m)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id),
hp AS (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS pos FROM m),
runs AS (SELECT doc_id, min(pos) AS a, max(pos) AS z FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM hp)
         GROUP BY doc_id, g HAVING count(*) >= 13),
pc AS (SELECT doc_id, unnest(ps) AS piece, unnest(range(len(ps))) AS pno FROM (SELECT doc_id, regexp_extract_all(text,
       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ps FROM documents
       WHERE doc_id IN (SELECT doc_id FROM runs))),
pw AS (SELECT *, regexp_matches(piece, '^[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]') AS word FROM pc),
pn AS (SELECT *, sum(word::INT) OVER (PARTITION BY doc_id ORDER BY pno) AS w FROM pw),
cut AS (SELECT pn.doc_id, sha256(coalesce(string_agg(piece, '' ORDER BY pno) FILTER (a IS NULL), '')) AS clean FROM pn
        LEFT JOIN runs ON pn.doc_id = runs.doc_id AND w >= a AND (w < z OR (word AND w = z)) GROUP BY pn.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated, coalesce(clean, sha256(coalesce(x.text, ''))) AS clean_sha256
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id LEFT JOIN cut ON cut.doc_id = d.doc_id
JOIN documents x ON x.doc_id = d.doc_id
"""

def op11_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT *, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS norm FROM e
       WHERE len(x) > 0 AND len(list_filter(x, lambda y: y IS NOT NULL AND isfinite(y))) = len(x)),
u AS MATERIALIZED (SELECT r, vec_id, list_transform(x, lambda y: y / norm) AS x FROM ok WHERE norm > 0),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.r <> b.r AND len(a.x) = len(b.x)
      AND list_dot_product(a.x, b.x) >= 0.95),
c(r, other) AS (SELECT r, r FROM e UNION SELECT c.r, l.b FROM c JOIN l ON c.other = l.a),
m AS (SELECT c.r, min(e.vec_id) AS component_id FROM c JOIN e ON c.other = e.r GROUP BY c.r),
n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, component_id, e.vec_id IS NOT DISTINCT FROM component_id AS kept
FROM e JOIN m ON e.r = m.r LEFT JOIN n ON e.r = n.r
"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    proven = merkle.manifest(table(spark, sf_dir, "documents"))
    return proven.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def _op12_sql(levels: int = 6, top_levels: int = 4) -> str:
    """Unrolled for groups of up to 16 ** levels rows and 16 ** top_levels groups."""
    def field(c):
        return f"coalesce(concat(strlen(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)), '-')"

    def leaf(text):
        return "sha256(concat(" + ", ".join([*(field(c) for c in merkle.FIELDS[:-1]), field(text)]) + "))"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # crc32 by its table: DuckDB has no such function
    table_sql = ("SELECT list(x ORDER BY b) AS t FROM (SELECT b, list_reduce(range(0, 9), lambda c, i: CASE WHEN i = 0 THEN c WHEN c % 2 = 1 "
                 "THEN xor(c // 2, 3988292384) ELSE c // 2 END, CAST(b AS BIGINT)) AS x FROM range(256) r(b))")
    parts = [f"""crc_table AS ({table_sql}),
ids AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL),
sums AS (SELECT doc_id, xor(list_reduce(list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, i, 1)) AS BIGINT)),
   lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295), 4294967295) AS crc FROM ids, crc_table),
d AS (SELECT documents.*, coalesce(crc % 5 = 0, false) AS bad FROM documents LEFT JOIN sums ON documents.doc_id = sums.doc_id),
lf AS (SELECT coalesce('s' || source, 'n') AS tree, doc_id, {leaf('text')} AS leaf,
   CASE WHEN bad THEN {leaf(lower)} ELSE {leaf('text')} END AS claimed FROM d),
n0 AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
   count(*) OVER (PARTITION BY tree) AS n, leaf AS hash FROM lf),
c0 AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
   doc_id, leaf, claimed AS folded, '' AS proof FROM lf)"""]

    def level(k, nodes, climbs, last):
        return f""",
r{k} AS (SELECT tree, pos // 16 AS run, n, list(hash ORDER BY pos) AS hs FROM {nodes} GROUP BY tree, pos // 16, n),
n{k + 1} AS (SELECT tree, run AS pos, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS hash FROM r{k}),
c{k + 1} AS (SELECT c.tree, pos // 16 AS pos, doc_id, leaf{last},
   CASE WHEN n = 1 THEN folded ELSE sha256(concat(array_to_string(hs[1:pos % 16], ''), folded, array_to_string(hs[pos % 16 + 2:], ''))) END AS folded,
   CASE WHEN n = 1 THEN proof ELSE concat(proof, array_to_string(hs[1:pos % 16], ''), array_to_string(hs[pos % 16 + 2:], '')) END AS proof
   FROM {climbs} c JOIN r{k} ON c.tree = r{k}.tree AND c.pos // 16 = run)"""

    for k in range(levels):
        parts.append(level(k, f"n{k}", f"c{k}", ""))
    parts.append(f""",
top AS (SELECT 't' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, hash, tree AS of_tree FROM n{levels}),
climb_top AS (SELECT top.tree, top.pos, doc_id, leaf, top.hash AS subroot, folded, proof FROM c{levels} c JOIN top ON c.tree = of_tree)""")
    for k in range(levels, levels + top_levels):
        parts.append(level(k, "top" if k == levels else f"n{k}", "climb_top" if k == levels else f"c{k}", ", subroot"))
    end = levels + top_levels
    return "WITH " + "".join(parts) + f"""
SELECT doc_id, leaf, subroot, n{end}.hash AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = n{end}.hash AS verified
FROM c{end}, n{end}"""


OP12_SQL = _op12_sql()


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup_clusters.cluster(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                        F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def _op13_sql(k: int = lookup_clusters.K, rounds: int = lookup_clusters.ROUNDS) -> str:
    near = """SELECT r, vec_id, v, arg_min(c, (dist, c)) AS cluster, min(dist) AS distance FROM (SELECT r, vec_id, v, c,
  list_sum(list_transform(v, lambda x, i: (x - cv[i]) * (x - cv[i]))) AS dist FROM kept, @C@) GROUP BY r, vec_id, v"""
    parts = [f"""WITH e AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
kept AS (SELECT r, vec_id, list_transform(x, lambda y: CAST(floor(64 * y) AS BIGINT)) AS v FROM e
  WHERE len(x) = 64 AND len(list_filter(x, lambda y: y IS NOT NULL AND isfinite(y))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256(concat('1:', vec_id)), v) - 1 AS c, v AS cv FROM kept WHERE vec_id IS NOT NULL
  ORDER BY sha256(concat('1:', vec_id)), v LIMIT {k})"""]
    for i in range(rounds):
        parts.append(f"""
a{i} AS MATERIALIZED ({near.replace('@C@', f'c{i}')}),
m{i} AS (SELECT cluster, d, sum(v[d]) AS s, count(*) AS n FROM (SELECT cluster, v, unnest(range(1, 65)) AS d FROM a{i}) GROUP BY cluster, d),
w{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY d) AS mv FROM m{i} GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(mv, cv) AS cv FROM c{i} LEFT JOIN w{i} ON c = cluster)""")
    return ",".join(parts) + f""",
f AS MATERIALIZED ({near.replace('@C@', f'c{rounds}')})
SELECT vec_id, CAST(cluster AS INT) AS cluster, CAST(distance AS BIGINT) AS distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(cv, ',')) AS centroid_sha256 FROM f JOIN c{rounds} ON c = cluster"""


OP13_SQL = _op13_sql()

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_token_counts": op7_token_counts,
    "op8_token_files": op8_token_files,
    "op9_url_filter": op9_url_filter,
    "op10_decontamination": op10_decontamination,
    "op11_cover_tree": op11_cover_tree,
    "op12_merkle": op12_merkle,
    "op13_centroids": op13_centroids,
}
SQL = {
    "op3_line_dedup": OP3_SQL,
    "op5_quality": OP5_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op10_decontamination": OP10_SQL,
    "op11_cover_tree": OP11_SQL,
    "op12_merkle": OP12_SQL,
    "op13_centroids": OP13_SQL,
}
