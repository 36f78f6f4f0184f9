"""DuckDB SQL building blocks for the correctness oracle.

Each block is a CTE chain that recomputes, independently of Spark, the same
relation as the matching Spark stage: the fixture adapter, cleaning, text
features, lexicon sentiment and classification.  The constants come from
``opinio.resources`` so both engines read the same fixed values.
"""

from __future__ import annotations

from opinio import resources as R
from opinio.functions.parse import NUMBER_RE
from opinio.functions.text import PUNCT_CLASS
from opinio.operators.sentiment import NEVER_SO_SCALAR, UPPER_WORD


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lit_list(xs) -> str:
    return "[" + ", ".join(lit(x) for x in xs) + "]"


def unicode_space(sql: str) -> str:
    """White space of every script in the splitting patterns (the SQL engine's own class is ASCII)."""
    return (sql.replace("'\\s+'", "'[\\t-\\r \\x{85}\\p{Z}]+'").replace("'\\S+'", "'[^\\t-\\r \\x{85}\\p{Z}]+'"))


PUNCT = lit(R.PUNCTUATION)

ADAPTER = """
d AS (SELECT doc_id, text, source, n_chars, CAST(substr(source,4) AS INT) AS sn FROM documents),
base AS (
 SELECT doc_id, concat('Model ', source, ' (Fixture Blue, 8GB RAM, 128GB)') AS Model,
  concat('Company', CAST(sn % 5 AS VARCHAR)) AS Company,
  concat(CAST(3 + sn % 2 AS VARCHAR), '.', CAST(sn % 10 AS VARCHAR), ' out of 5') AS Overall_product_rating,
  concat(CAST(1 + sn AS VARCHAR), ',', lpad(CAST((sn * 37) % 1000 AS VARCHAR), 3, '0'), ' global ratings') AS Overall_product_rating_count,
  CASE WHEN n_chars % 97 = 0 THEN NULL ELSE substr(text, 1, 24) END AS Review_title,
  CASE WHEN n_chars % 211 = 0 THEN NULL ELSE concat('user', CAST(n_chars % 100 AS VARCHAR)) END AS Reviewer_name,
  concat(CAST(1 + n_chars % 5 AS VARCHAR), '.0 out of 5 stars') AS Review_Rating,
  CASE WHEN n_chars % 37 = 0 THEN NULL ELSE text END AS Review,
  CASE WHEN n_chars % 7 = 0 THEN '0' WHEN n_chars % 7 = 1 THEN 'One person found this helpful'
       WHEN n_chars % 53 = 2 THEN '1,204 people found this helpful'
       ELSE concat(CAST(2 + n_chars % 50 AS VARCHAR), ' people found this helpful') END AS Review_helpful_rating
 FROM d),
raw_ids AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE doc_id % 50 = 0),
raw AS (SELECT Model, Company, Overall_product_rating, Overall_product_rating_count, Review_title,
               Reviewer_name, Review_Rating, Review, Review_helpful_rating FROM raw_ids)"""


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\t-\\r \\x{{85}}\\p{{Z}}]+|[\\t-\\r \\x{{85}}\\p{{Z}}]+$', '', 'g')"


def _num(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {lit(NUMBER_RE)}) THEN TRY_CAST({x} AS DOUBLE) END"


CLEAN = f"""
withtext AS (SELECT *, concat(coalesce(Review_title, 'nan'), ' ', Review) AS text_raw FROM raw),
complete AS (SELECT * FROM withtext WHERE Model IS NOT NULL AND Company IS NOT NULL
  AND Overall_product_rating IS NOT NULL AND Overall_product_rating_count IS NOT NULL
  AND Review_title IS NOT NULL AND Reviewer_name IS NOT NULL AND Review_Rating IS NOT NULL
  AND Review IS NOT NULL AND Review_helpful_rating IS NOT NULL AND text_raw IS NOT NULL),
trimmed AS (SELECT Model, Company,
  {_strip("replace(Overall_product_rating, ' out of 5', '')")} AS r1,
  {_strip("replace(" + _strip("replace(Overall_product_rating_count, ' global ratings', '')") + ", ',', '')")} AS r2,
  {_strip("replace(Review_Rating, ' out of 5 stars', '')")} AS r3,
  {_strip("replace(Review_helpful_rating, ' people found this helpful', '')")} AS r4a,
  Review_title, Reviewer_name, Review, text_raw FROM complete),
parsed AS (SELECT Model, Company, {_num("r1")} AS Overall_product_rating,
  {_num("r2")} AS Overall_product_rating_count, {_num("r3")} AS Review_Rating,
  {_num("CASE WHEN r4a = 'One person found this helpful' THEN '1' ELSE r4a END")} AS Review_helpful_rating,
  Review_title, Reviewer_name, Review, text_raw FROM trimmed),
clean AS (SELECT DISTINCT Model, Company, Overall_product_rating, Overall_product_rating_count,
  Review_title, Reviewer_name, Review_Rating, Review, Review_helpful_rating, text_raw,
  text_raw AS text_en, text_raw AS Title_and_Reviews
  FROM parsed WHERE Overall_product_rating IS NOT NULL AND NOT isnan(Overall_product_rating)
  AND Overall_product_rating_count IS NOT NULL AND NOT isnan(Overall_product_rating_count)
  AND Review_Rating IS NOT NULL AND NOT isnan(Review_Rating)
  AND Review_helpful_rating IS NOT NULL AND NOT isnan(Review_helpful_rating)),
keyed AS (SELECT *, md5(concat_ws('|', Model, Company, CAST(Overall_product_rating AS VARCHAR),
  CAST(Overall_product_rating_count AS VARCHAR), Review_title, Reviewer_name, CAST(Review_Rating AS VARCHAR),
  Review, CAST(Review_helpful_rating AS VARCHAR))) AS review_key FROM clean)"""

FEATURES = """
feat AS (SELECT *, CAST(length(text_en) AS BIGINT) AS char_count,
  CAST(len(regexp_extract_all(text_en, '\\S+')) AS BIGINT) AS word_count,
  CAST(length(text_en) - length(translate(text_en, """ + PUNCT + """, '')) AS BIGINT) AS punctuation_count
  FROM keyed),
features AS (SELECT *, CAST(char_count AS DOUBLE) / (CAST(word_count AS DOUBLE) + 1.0) AS word_density FROM feat)"""


def _values_table(rows) -> str:
    vals = []
    for tok, val, boost, neg in rows:
        v = "NULL" if val is None else repr(float(val))
        b = "NULL" if boost is None else repr(float(boost))
        vals.append(f"({lit(tok)}, CAST({v} AS DOUBLE), CAST({b} AS DOUBLE), {'true' if neg else 'false'})")
    return "SELECT * FROM (VALUES " + ", ".join(vals) + ") AS v(token, valence, boost, neg)"


def fixture_info_rows(phrases: bool = False):
    rows = {}
    for tok, val in R.FIXTURE_LEXICON + (R.FIXTURE_IDIOMS if phrases else []):
        rows.setdefault(tok.lower(), [None, None, False])[0] = float(val)
    for tok, b in R.FIXTURE_BOOSTERS + (R.FIXTURE_PHRASE_BOOSTERS if phrases else []):
        rows.setdefault(tok.lower(), [None, None, False])[1] = float(b)
    for tok in R.FIXTURE_NEGATIONS:
        rows.setdefault(tok.lower(), [None, None, False])[2] = True
    return [(k, *v) for k, v in sorted(rows.items())]


def stripped(w: str) -> str:
    """A lower-cased word without punctuation at its edges (unless too little would remain)."""
    edge = lit(f"^{PUNCT_CLASS}+|{PUNCT_CLASS}+$")
    return (f"lower(CASE WHEN length(regexp_replace({w}, {edge}, '', 'g')) <= 2 THEN {w} "
            f"ELSE regexp_replace({w}, {edge}, '', 'g') END)")


def merged_tokens(src: str, phrases: str) -> str:
    """CTEs from ``src(key, i, w)`` (1-based places) and ``phrases(phrase)`` to ``s_merged(key, i, w, hit)``: the longest phrase
    that starts at a word, from left to right, is one row; ``hit`` is the phrase that matched, else null."""
    return f"""
ph AS (SELECT phrase, string_split(phrase, ' ')[1] AS w1, len(string_split(phrase, ' ')) AS n FROM {phrases}),
ph_tok AS (SELECT key, list(w ORDER BY i) AS t, list(lower(w) ORDER BY i) AS lt FROM {src} GROUP BY key),
ph_hit AS (SELECT q.key, q.i AS p, x.n, x.phrase FROM {src} q JOIN ph x ON lower(q.w) = x.w1 JOIN ph_tok t ON q.key = t.key
  WHERE array_to_string(t.lt[q.i:q.i + x.n - 1], ' ') = x.phrase AND q.i + x.n - 1 <= len(t.lt)),
ph_list AS (SELECT key, list(struct_pack(s := p, e := p + n, m := [struct_pack(p := p, n := n, phrase := phrase)]) ORDER BY p, n DESC) AS h
  FROM ph_hit GROUP BY key),
ph_match AS (SELECT key, unnest(list_reduce(h, lambda a, x: CASE WHEN x.s >= a.e
  THEN struct_pack(s := a.s, e := x.e, m := list_concat(a.m, x.m)) ELSE a END).m) AS m FROM ph_list),
ph_rows AS (SELECT k.key, k.i, k.w, m.m AS m FROM {src} k LEFT JOIN ph_match m ON k.key = m.key AND k.i >= m.m.p AND k.i < m.m.p + m.m.n),
s_merged AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY min(i)) AS i, string_agg(w, ' ' ORDER BY i) AS w, any_value(m.phrase) AS hit
  FROM ph_rows GROUP BY key, coalesce(m.p, i)),"""


def sentiment(src: str = "features", out: str = "scored", phrases: bool = False) -> str:
    """Lexicon sentiment by SQL: tokens unnested with their neighbours,
    joined to the word table, rules applied step by step, summed per review."""
    edge = lit(f"^{PUNCT_CLASS}+|{PUNCT_CLASS}+$")
    up = lit(UPPER_WORD)
    info = _values_table(fixture_info_rows(phrases))
    n = R.NEGATION_SCALAR
    c = R.CAPS_INCR

    def isup(x):
        return f"coalesce(regexp_matches({x}, {up}), false)"

    def neg(k):
        return f"(coalesce({k}_neg, false) OR coalesce(contains(l{k}, 'n''t'), false))"

    def scalar(k, v, damp):
        return (f"(CASE WHEN {k}_boost IS NOT NULL THEN ({k}_boost * (CASE WHEN {v} < 0 THEN -1.0 ELSE 1.0 END)"
                f" + CASE WHEN {isup(k)} AND capdiff THEN (CASE WHEN {v} > 0 THEN {c} ELSE {-c} END) ELSE 0.0 END)"
                f" ELSE 0.0 END) * {damp}")

    steps = []
    steps.append(f"""
s_info AS ({info}),
s_split AS (SELECT review_key AS key, list_filter(string_split_regex(text_en, '\\s+'), lambda w: w <> '') AS t0 FROM {src}),
s_w0 AS (SELECT key, unnest(t0) AS w0, unnest(generate_series(1, len(t0))) AS i FROM s_split),
@W@
s_up AS (SELECT key, sum(CASE WHEN {isup('w')} THEN 1 ELSE 0 END) AS n_up, count(*) AS n_tok FROM s_caps GROUP BY key),
s_but AS (SELECT key, coalesce(min(CASE WHEN lower(w) = 'but' THEN i END), 0) AS but_pos FROM s_w GROUP BY key),
s_flag AS (SELECT s_up.*, but_pos FROM s_up JOIN s_but ON s_up.key = s_but.key),
s_rows AS (SELECT s_w.key, (n_up > 0 AND n_up < n_tok) AS capdiff, but_pos, i, w,
   lag(w, 1) OVER win AS p1, lag(w, 2) OVER win AS p2, lag(w, 3) OVER win AS p3, lead(w, 1) OVER win AS n1
   FROM s_w JOIN s_flag ON s_w.key = s_flag.key
   WINDOW win AS (PARTITION BY s_w.key ORDER BY i)),
s_low AS (SELECT *, lower(w) AS lw, lower(p1) AS lp1, lower(p2) AS lp2, lower(p3) AS lp3, lower(n1) AS ln1 FROM s_rows),
s_hit AS (SELECT s_low.*, h.valence FROM s_low JOIN (SELECT token, valence FROM s_info
   WHERE valence IS NOT NULL AND boost IS NULL) h ON s_low.lw = h.token
   WHERE NOT (lw = 'kind' AND coalesce(ln1 = 'of', false))),
s_j AS (SELECT s_hit.*, a.valence AS p1_val, a.boost AS p1_boost, a.neg AS p1_neg,
   b.valence AS p2_val, b.boost AS p2_boost, b.neg AS p2_neg,
   c.valence AS p3_val, c.boost AS p3_boost, c.neg AS p3_neg, e.valence AS n1_val
   FROM s_hit LEFT JOIN s_info a ON lp1 = a.token LEFT JOIN s_info b ON lp2 = b.token
   LEFT JOIN s_info c ON lp3 = c.token LEFT JOIN s_info e ON ln1 = e.token),
s_v0 AS (SELECT *, CASE WHEN coalesce(lp1 = 'no', false) OR coalesce(lp2 = 'no', false)
     OR coalesce(lp3 = 'no' AND lp1 IN ('or', 'nor'), false) THEN valence * {n}
   WHEN lw = 'no' AND n1_val IS NOT NULL THEN 0.0 ELSE valence END AS v0 FROM s_j),
s_v1 AS MATERIALIZED (SELECT *, CASE WHEN {isup('w')} AND capdiff THEN (CASE WHEN v0 > 0 THEN v0 + {c} ELSE v0 - {c} END)
   ELSE v0 END AS v1 FROM s_v0),""")
    stripped = (f"(SELECT key, i, CASE WHEN length(regexp_replace(w0, {edge}, '', 'g')) <= 2 THEN w0 "
                f"ELSE regexp_replace(w0, {edge}, '', 'g') END AS w FROM s_w0),")
    if phrases:
        words = (f"s_w00 AS {stripped} s_phrases AS (SELECT token AS phrase FROM s_info WHERE contains(token, ' ')),"
                 + merged_tokens("s_w00", "s_phrases") + "\ns_w AS (SELECT key, i, w FROM s_merged),"
                 # capitals are judged on the words of the text, not on the merged tokens
                 "\ns_caps AS (SELECT * FROM s_w00),")
    else:
        words = f"s_w AS {stripped}\ns_caps AS (SELECT * FROM s_w),"
    steps[0] = steps[0].replace("@W@", words)
    # three preceding positions
    prev = "v1"
    for idx, (k, damp) in enumerate(zip(("p1", "p2", "p3"), R.PRECEDING_DAMPING)):
        a = f"v{idx + 2}a"
        b = f"v{idx + 2}"
        if k == "p1":
            nv = f"CASE WHEN {neg('p1')} THEN {a} * {n} ELSE {a} END"
        elif k == "p2":
            nv = (f"CASE WHEN lp2 = 'never' AND lp1 IN ('so', 'this') THEN {a} * {NEVER_SO_SCALAR} "
                  f"WHEN lp2 = 'without' AND lp1 = 'doubt' THEN {a} "
                  f"WHEN {neg('p2')} THEN {a} * {n} ELSE {a} END")
        else:
            nv = (f"CASE WHEN coalesce(lp3 = 'never' AND lp2 IN ('so', 'this'), false) OR lp1 IN ('so', 'this') "
                  f"THEN {a} * {NEVER_SO_SCALAR} "
                  f"WHEN lp3 = 'without' AND (lp2 = 'doubt' OR lp1 = 'doubt') THEN {a} "
                  f"WHEN {neg('p3')} THEN {a} * {n} ELSE {a} END")
        steps.append(f"""
s_{a} AS MATERIALIZED (SELECT *, {prev} + {scalar(k, prev, damp)} AS {a} FROM {'s_' + prev}),
s_{b} AS MATERIALIZED (SELECT *, CASE WHEN {k} IS NOT NULL AND {k}_val IS NULL THEN ({nv}) ELSE {prev} END AS {b} FROM s_{a}),""")
        prev = b
    steps.append(f"""
s_least AS (SELECT *, CASE WHEN coalesce(lp1 = 'least' AND p1_val IS NULL
     AND (lp2 IS NULL OR NOT coalesce(lp2 IN ('at', 'very'), false)), false) THEN {prev} * {n} ELSE {prev} END AS vl
   FROM s_{prev}),
s_sum AS MATERIALIZED (SELECT key, sum(vl * CASE WHEN but_pos > 0 AND i < but_pos THEN 0.5
     WHEN but_pos > 0 AND i > but_pos THEN 1.5 ELSE 1.0 END) AS sum_s FROM s_least GROUP BY key),
s_emph AS (SELECT {src}.*, coalesce(s_sum.sum_s, 0.0) AS s0,
   least(length(text_en) - length(replace(text_en, '!', '')), {R.EXCLAMATION_MAX}) * {R.EXCLAMATION_STEP}
   + CASE WHEN length(text_en) - length(replace(text_en, '?', '')) > 3 THEN {R.QUESTION_CAP}
          WHEN length(text_en) - length(replace(text_en, '?', '')) > 1
          THEN (length(text_en) - length(replace(text_en, '?', ''))) * {R.QUESTION_STEP} ELSE 0.0 END AS emph
   FROM {src} LEFT JOIN s_sum ON {src}.review_key = s_sum.key),
s_cmp AS (SELECT *, CASE WHEN s0 > 0 THEN s0 + emph WHEN s0 < 0 THEN s0 - emph ELSE s0 END AS s1 FROM s_emph),
{out} AS (SELECT * EXCLUDE (s0, emph, s1, cmp),
   CASE WHEN cmp >= {R.POSITIVE_AT} THEN 'Positive' WHEN cmp <= {R.NEGATIVE_AT} THEN 'Negative' ELSE 'Neutral' END AS Polarity,
   cmp AS Sentiment_Score
   FROM (SELECT *, round(greatest(-1.0, least(1.0, s1 / sqrt(s1 * s1 + {R.NORMALIZE_ALPHA}))), 4) AS cmp FROM s_cmp))""")
    return "".join(steps)


def keyword_hits(text: str, keywords, fold_case: bool) -> str:
    parts = [f"(CASE WHEN contains({'lower(' + text + ')' if fold_case else text}, "
             f"{lit(k.lower() if fold_case else k)}) THEN 1 ELSE 0 END)" for k in keywords]
    return "(" + " + ".join(parts) + ")" if parts else "0"


def labels(src: str, out: str = "labelled", keywords: str = "fixture") -> str:
    prod, svc = ((R.FIXTURE_PRODUCT_KEYWORDS, R.FIXTURE_SERVICE_KEYWORDS) if keywords == "fixture"
                 else (R.PRODUCT_KEYWORDS, R.SERVICE_KEYWORDS))
    return f"""
lab0 AS (SELECT *, substr(Model, 1, {R.SHORT_MODEL_CHARS}) AS Short_Model_Name, lower(text_en) AS text_lower FROM {src}),
lab1 AS (SELECT *, {keyword_hits('text_lower', prod, True)} AS k_prod, {keyword_hits('text_lower', svc, True)} AS k_svc,
   {keyword_hits('text_lower', svc, False)} AS k_svc_raw, len(regexp_extract_all(text_lower, '\\S+')) AS k_words FROM lab0),
{out} AS (SELECT * EXCLUDE (k_prod, k_svc, k_svc_raw, k_words),
   CASE WHEN k_prod > k_svc THEN {lit(R.PRODUCT_LABEL)} WHEN k_svc > k_prod THEN {lit(R.SERVICE_LABEL)}
        WHEN k_words < {R.SHORT_REVIEW_WORDS} AND k_svc_raw > 0 THEN {lit(R.SERVICE_LABEL)}
        WHEN k_words >= {R.SHORT_REVIEW_WORDS} AND k_svc_raw >= 2 THEN {lit(R.SERVICE_LABEL)}
        ELSE {lit(R.PRODUCT_LABEL)} END AS classification FROM lab1)"""


def with_ctes(*blocks: str) -> str:
    return "WITH " + ",".join(b.strip().rstrip(",") for b in blocks)


def enriched_ctes(sentiment_on: bool = True, keywords: str = "fixture") -> str:
    """CTE chain ending in a relation named ``enriched``."""
    blocks = [ADAPTER, CLEAN, FEATURES]
    src = "features"
    if sentiment_on:
        blocks.append(sentiment("features", "scored"))
        src = "scored"
    blocks.append(labels(src, "enriched", keywords))
    return with_ctes(*blocks)


def clean_ctes() -> str:
    return with_ctes(ADAPTER, CLEAN, FEATURES)
