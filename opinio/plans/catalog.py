"""Registered queries: one Spark callable (spark, sf_dir) -> DataFrame per
operator of the inventory, and where SQL can express it, the DuckDB SQL
that computes the same relation from the same parquet tables.

Names follow the inventory IDs.  Computed columns carry the same alias in
both engines; doubles are rounded to 6 places in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinio import resources as R
from opinio.functions.classify import keyword_hits
from opinio.operators import aggregates as A
from opinio.operators import ngrams as N
from opinio.operators import profile as P
from opinio.operators.clean import stage_counts
from opinio.operators.sentiment import fixture_phrase_info, fixture_word_info, phrases_of, score_sentiment
from opinio.plans import oracle as O
from opinio.plans.enrich import add_features, cleaned, enriched
from opinio.schemas import FEATURE_COLUMNS, NUMERIC_RAW_COLUMNS, RAW_COLUMNS
from opinio.session import cut_lineage, scratch_folder
from opinio.sources.files import read_reviews_csv
from opinio.sources.fixture import reviews_raw
from opinio.sources.sinks import append_csv, export_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = O.unicode_space(sql)
        return fn
    return deco


ENR = O.enriched_ctes()                 # cleaning + features + sentiment + labels
ENR_NOSENT = O.with_ctes(O.ADAPTER, O.CLEAN, O.FEATURES, O.labels("features", "enriched"))
CLN = O.clean_ctes()
STOP = R.FIXTURE_STOP_WORDS
COMPANIES = [f"Company{i}" for i in range(5)]   # the fixture's company values (pivot columns)


def _e(spark, sf, sentiment=True, keywords="fixture"):
    return enriched(spark, sf, sentiment=sentiment, keywords=keywords)


# ---------------------------------------------------------------- cleaning
@register("cln01_clean_reviews", CLN + """
SELECT Model, Company, Overall_product_rating, Overall_product_rating_count, Review_title, Reviewer_name,
       Review_Rating, Review, Review_helpful_rating, Title_and_Reviews FROM keyed""")
def cln01(spark, sf):
    return cleaned(spark, sf).select(*RAW_COLUMNS, "Title_and_Reviews")


def _null_sql(rel, cols):
    return " UNION ALL ".join(
        f"SELECT {O.lit(c)} AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_count FROM {rel}"
        for c in cols)


@register("prf01_null_counts_raw", O.with_ctes(O.ADAPTER) + "\n" + _null_sql("raw", RAW_COLUMNS))
def prf01(spark, sf):
    return P.null_counts(reviews_raw(spark, sf), RAW_COLUMNS)


def _parse_ok_sql():
    r1 = O._strip("replace(Overall_product_rating, ' out of 5', '')")
    r2 = O._strip("replace(" + O._strip("replace(Overall_product_rating_count, ' global ratings', '')") + ", ',', '')")
    r3 = O._strip("replace(Review_Rating, ' out of 5 stars', '')")
    r4 = O._strip("replace(Review_helpful_rating, ' people found this helpful', '')")
    r4 = f"CASE WHEN {r4} = 'One person found this helpful' THEN '1' ELSE {r4} END"
    return " AND ".join(f"({O._num(x)}) IS NOT NULL" for x in (r1, r2, r3, r4))


_STAGE_SQL = O.with_ctes(O.ADAPTER, O.CLEAN) + f""",
dist AS (SELECT DISTINCT * FROM withtext),
dcomp AS (SELECT * FROM dist WHERE Model IS NOT NULL AND Company IS NOT NULL
  AND Overall_product_rating IS NOT NULL AND Overall_product_rating_count IS NOT NULL
  AND Review_title IS NOT NULL AND Reviewer_name IS NOT NULL AND Review_Rating IS NOT NULL
  AND Review IS NOT NULL AND Review_helpful_rating IS NOT NULL AND text_raw IS NOT NULL)
SELECT (SELECT count(*) FROM raw) AS raw_rows, (SELECT count(*) FROM dist) AS distinct_rows,
       (SELECT count(*) FROM dcomp) AS complete_rows,
       (SELECT count(*) FROM dcomp WHERE {_parse_ok_sql()}) AS parsed_rows,
       (SELECT count(*) FROM clean) AS clean_rows"""


@register("prf02_stage_counts", _STAGE_SQL)
def prf02(spark, sf):
    return stage_counts(reviews_raw(spark, sf))


@register("prf03_sample50", CLN + """
SELECT Model, Reviewer_name, Review_Rating, Title_and_Reviews FROM keyed
ORDER BY md5(concat(Model, '|', Title_and_Reviews)) LIMIT 50""")
def prf03(spark, sf):
    df = cleaned(spark, sf)
    return P.sample_rows(df, 50, key=F.md5(F.concat("Model", F.lit("|"), "Title_and_Reviews"))).select(
        "Model", "Reviewer_name", "Review_Rating", "Title_and_Reviews")


_DESC_COLS = NUMERIC_RAW_COLUMNS + FEATURE_COLUMNS


def _describe_sql(rel, cols):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT {O.lit(c)} AS column_name, count({x}) AS count, round(avg({x}), 6) AS mean, "
            f"round(stddev_samp({x}), 6) AS std, min({x}) AS min, round(quantile_cont({x}, 0.25), 6) AS q25, "
            f"round(quantile_cont({x}, 0.5), 6) AS q50, round(quantile_cont({x}, 0.75), 6) AS q75, max({x}) AS max "
            f"FROM {rel}")
    return " UNION ALL ".join(parts)


@register("prf04_describe_numeric", CLN + "\n" + _describe_sql("features", _DESC_COLS))
def prf04(spark, sf):
    return P.describe_numeric(add_features(cleaned(spark, sf)), _DESC_COLS)


_TEXT_DESC = RAW_COLUMNS                                  # all nine are text before parsing


def _describe_text_sql(rel, cols):
    parts = []
    for c in cols:
        parts.append(
            f"SELECT {O.lit(c)} AS column_name, CAST(sum(freq) AS BIGINT) AS count, count(*) AS unique, "
            f"arg_min(v, (-freq, v)) AS top, max(freq) AS freq FROM "
            f"(SELECT {c} AS v, count(*) AS freq FROM {rel} WHERE {c} IS NOT NULL GROUP BY {c})")
    return " UNION ALL ".join(parts)


@register("prf05_describe_text", O.with_ctes(O.ADAPTER) + "\n" + _describe_text_sql("raw", _TEXT_DESC))
def prf05(spark, sf):
    return P.describe_text(reviews_raw(spark, sf), _TEXT_DESC)


_RAW_NUMBERS = O.CLEAN.replace(O.CLEAN[O.CLEAN.index("FROM withtext WHERE Model"):O.CLEAN.index("text_raw IS NOT NULL),")],
                                "FROM withtext WHERE true OR ")


@register("prf04b_describe_before_cleaning", O.with_ctes(O.ADAPTER, _RAW_NUMBERS) + "\n" + _describe_sql("parsed", NUMERIC_RAW_COLUMNS))
def prf04b(spark, sf):
    """PRF4 before cleaning: the numbers that the raw text holds, copies and incomplete rows included."""
    from opinio.functions.parse import parsed_numbers
    return P.describe_numeric(reviews_raw(spark, sf).withColumns(parsed_numbers()), NUMERIC_RAW_COLUMNS)


# ---------------------------------------------------------------- features
@register("fea01_text_features", CLN + """
SELECT Model, Reviewer_name, Review_Rating, char_count, word_count, round(word_density, 6) AS word_density,
       punctuation_count, substr(Model, 1, 30) AS Short_Model_Name FROM features""")
def fea01(spark, sf):
    df = add_features(cleaned(spark, sf))
    return df.select("Model", "Reviewer_name", "Review_Rating", "char_count", "word_count",
                     F.round("word_density", 6).alias("word_density"), "punctuation_count",
                     F.substring("Model", 1, R.SHORT_MODEL_CHARS).alias("Short_Model_Name"))


# ---------------------------------------------------------------- sentiment
@register("sen01_sentiment_scores", ENR + """
SELECT Model, Reviewer_name, Review_Rating, Sentiment_Score, Polarity FROM enriched""")
def sen01(spark, sf):
    return _e(spark, sf).select("Model", "Reviewer_name", "Review_Rating", "Sentiment_Score", "Polarity")


@register("sen03_phrase_sentiment", O.with_ctes(O.ADAPTER, O.CLEAN, O.FEATURES, O.sentiment("features", "scored", phrases=True)) + """
SELECT Model, Reviewer_name, Review_Rating, Sentiment_Score, Polarity FROM scored""")
def sen03(spark, sf):
    """SEN1 with phrases: boosters and idioms of several words, the longest match first."""
    info = fixture_phrase_info(spark)
    df = score_sentiment(cleaned(spark, sf), info, phrases=phrases_of(info))
    return df.select("Model", "Reviewer_name", "Review_Rating", "Sentiment_Score", "Polarity")


# ---------------------------------------------------------------- classifier
@register("cls01_keyword_classification", ENR_NOSENT + f"""
SELECT Model, Reviewer_name, {O.keyword_hits('text_lower', R.FIXTURE_PRODUCT_KEYWORDS, True)} AS product_hits,
  {O.keyword_hits('text_lower', R.FIXTURE_SERVICE_KEYWORDS, True)} AS service_hits,
  {O.keyword_hits('text_lower', R.FIXTURE_SERVICE_KEYWORDS, False)} AS service_hits_as_written,
  classification FROM enriched""")
def cls01(spark, sf):
    df = _e(spark, sf, sentiment=False)
    t = F.col("text_lower")
    return df.select("Model", "Reviewer_name",
                     keyword_hits(t, R.FIXTURE_PRODUCT_KEYWORDS).alias("product_hits"),
                     keyword_hits(t, R.FIXTURE_SERVICE_KEYWORDS).alias("service_hits"),
                     keyword_hits(t, R.FIXTURE_SERVICE_KEYWORDS, fold_case=False).alias("service_hits_as_written"),
                     "classification")


@register("cls02_reference_keywords_totals",
          O.with_ctes(O.ADAPTER, O.CLEAN, O.FEATURES, O.labels("features", "enriched", "reference")) + f"""
SELECT count(*) FILTER (WHERE classification = {O.lit(R.PRODUCT_LABEL)}) AS product_reviews,
       count(*) FILTER (WHERE classification = {O.lit(R.SERVICE_LABEL)}) AS service_reviews FROM enriched""")
def cls02(spark, sf):
    return A.class_totals(_e(spark, sf, sentiment=False, keywords="reference"))


# ---------------------------------------------------------------- aggregates
@register("agg01_rating_histogram", ENR_NOSENT + """
SELECT Review_Rating, count(*) AS count FROM enriched GROUP BY Review_Rating""")
def agg01(spark, sf):
    return A.rating_histogram(_e(spark, sf, sentiment=False))


@register("agg02_reviews_per_model", ENR_NOSENT + """
SELECT Company, Short_Model_Name, count(*) AS Review_Count FROM enriched GROUP BY Company, Short_Model_Name""")
def agg02(spark, sf):
    return A.reviews_per_model(_e(spark, sf, sentiment=False))


@register("agg03_model_company_pivot", ENR_NOSENT + "\nSELECT Short_Model_Name, " + ", ".join(
    f"CASE WHEN count(*) FILTER (WHERE Company = {O.lit(c)}) = 0 THEN NULL "
    f"ELSE count(*) FILTER (WHERE Company = {O.lit(c)}) END AS {c}" for c in COMPANIES)
    + " FROM enriched GROUP BY Short_Model_Name")
def agg03(spark, sf):
    return A.reviews_pivot(_e(spark, sf, sentiment=False), COMPANIES)


@register("agg04_model_global_ratings", CLN + """
SELECT Model, CAST(max(Overall_product_rating_count) AS BIGINT) AS Amazon_Global_ratings,
       substr(Model, 1, 30) AS Short_Model FROM keyed GROUP BY Model""")
def agg04(spark, sf):
    return A.model_global_ratings(cleaned(spark, sf))


@register("agg05_text_features_by_company", CLN + """
SELECT Company, round(avg(char_count), 6) AS avg_char_count, round(avg(word_count), 6) AS avg_word_count,
       round(avg(word_density), 6) AS avg_word_density, round(avg(punctuation_count), 6) AS avg_punctuation_count
FROM features GROUP BY Company""")
def agg05(spark, sf):
    return A.feature_means_by_company(add_features(cleaned(spark, sf)))


@register("agg06_helpful_by_model", CLN + """
SELECT Model, round(avg(Review_helpful_rating), 6) AS avg_helpful FROM keyed GROUP BY Model""")
def agg06(spark, sf):
    return A.helpful_mean_by_model(cleaned(spark, sf))




@register("agg07_emoticons_by_model", CLN + """
SELECT Model, CAST(sum(len(regexp_extract_all(text_en, '[""" + "".join(
    f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in R.EMOTICON_RANGES) + """]+'))) AS BIGINT) AS Emoticon_Count,
       substr(Model, 1, 20) AS Short_Model FROM keyed GROUP BY Model""")
def agg07(spark, sf):
    return A.emoticons_by_model(cleaned(spark, sf))


@register("agg08_rating_by_company", ENR_NOSENT + """
SELECT Company, Review_Rating, count(*) AS count FROM enriched GROUP BY Company, Review_Rating""")
def agg08(spark, sf):
    return A.rating_by_company(_e(spark, sf, sentiment=False))


@register("agg09_class_totals", ENR_NOSENT + f"""
SELECT count(*) FILTER (WHERE classification = {O.lit(R.PRODUCT_LABEL)}) AS product_reviews,
       count(*) FILTER (WHERE classification = {O.lit(R.SERVICE_LABEL)}) AS service_reviews FROM enriched""")
def agg09(spark, sf):
    return A.class_totals(_e(spark, sf, sentiment=False))


@register("agg10_class_by_company", ENR_NOSENT + """
SELECT Company, classification, count(*) AS count FROM enriched GROUP BY Company, classification""")
def agg10(spark, sf):
    return A.class_by_company(_e(spark, sf, sentiment=False))


@register("agg11_polarity_share", ENR + """
SELECT Polarity, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct
FROM enriched GROUP BY Polarity""")
def agg11(spark, sf):
    return A.polarity_share(_e(spark, sf))


def _hist_sql(rel, col, bins=10):
    return f"""
, hb AS (SELECT min(CAST({col} AS DOUBLE)) AS lo, max(CAST({col} AS DOUBLE)) AS hi FROM {rel}),
hc AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((CAST({col} AS DOUBLE) - lo) / (hi - lo) * {bins}), {bins - 1}) END AS INT) AS bin,
       count(*) AS count FROM {rel}, hb WHERE {col} IS NOT NULL GROUP BY 1)
SELECT CAST(g.bin AS INT) AS bin,
  round(CASE WHEN hi = lo THEN lo ELSE lo + (hi - lo) * g.bin / {bins} END, 6) AS lower,
  round(CASE WHEN hi = lo THEN lo ELSE lo + (hi - lo) * (g.bin + 1) / {bins} END, 6) AS upper,
  CAST(coalesce(hc.count, 0) AS BIGINT) AS count
FROM (SELECT range AS bin FROM range({bins})) g CROSS JOIN hb LEFT JOIN hc ON g.bin = hc.bin"""


@register("agg12_sentiment_histogram", ENR + _hist_sql("enriched", "Sentiment_Score"))
def agg12(spark, sf):
    return A.equal_width_histogram(_e(spark, sf), "Sentiment_Score", 10)


@register("agg12b_char_count_histogram", CLN + _hist_sql("features", "char_count"))
def agg12b(spark, sf):
    return A.equal_width_histogram(add_features(cleaned(spark, sf)), "char_count", 10)


@register("agg13_sentiment_by_rating", ENR + """
SELECT Review_Rating, round(avg(Sentiment_Score), 6) AS avg_sentiment FROM enriched GROUP BY Review_Rating""")
def agg13(spark, sf):
    return A.score_by_rating(_e(spark, sf))


@register("agg14_polarity_share_by_model", ENR + """
SELECT Short_Model_Name,
  round(count(*) FILTER (WHERE Polarity = 'Negative') / count(*), 6) AS Negative,
  round(count(*) FILTER (WHERE Polarity = 'Neutral') / count(*), 6) AS Neutral,
  round(count(*) FILTER (WHERE Polarity = 'Positive') / count(*), 6) AS Positive
FROM enriched GROUP BY Short_Model_Name""")
def agg14(spark, sf):
    return A.polarity_share_by_model(_e(spark, sf))


_POL_GRID = ("(SELECT * FROM (VALUES " + ", ".join(f"({O.lit(p)}, {i})" for i, p in enumerate(R.POLARITY_ORDER))
             + ") AS l(Polarity, polarity_rank)) l CROSS JOIN (SELECT * FROM (VALUES "
             + f"({O.lit(R.PRODUCT_LABEL)}), ({O.lit(R.SERVICE_LABEL)})) AS c(classification)) c")


@register("agg15_polarity_by_class", ENR + f"""
SELECT g.classification, g.Polarity, CAST(g.polarity_rank AS INT) AS polarity_rank, CAST(coalesce(n.count, 0) AS BIGINT) AS count
FROM (SELECT * FROM {_POL_GRID}) g
LEFT JOIN (SELECT classification, Polarity, count(*) AS count FROM enriched GROUP BY ALL) n
  ON g.classification = n.classification AND g.Polarity = n.Polarity""")
def agg15(spark, sf):
    return A.polarity_by_class(_e(spark, sf))


@register("agg16_polarity_by_model_class", ENR + f"""
SELECT m.Model, g.classification, g.Polarity, CAST(g.polarity_rank AS INT) AS polarity_rank,
       CAST(coalesce(n.count, 0) AS BIGINT) AS count
FROM (SELECT DISTINCT Model FROM enriched) m CROSS JOIN (SELECT * FROM {_POL_GRID}) g
LEFT JOIN (SELECT Model, classification, Polarity, count(*) AS count FROM enriched GROUP BY ALL) n
  ON m.Model = n.Model AND g.classification = n.classification AND g.Polarity = n.Polarity""")
def agg16(spark, sf):
    return A.polarity_by_class(_e(spark, sf), by_model=True)


@register("agg17_service_share_by_model", ENR_NOSENT + f"""
SELECT Model, count(*) AS total_reviews, count(*) FILTER (WHERE classification = {O.lit(R.SERVICE_LABEL)}) AS service_reviews,
       count(*) - count(*) FILTER (WHERE classification = {O.lit(R.SERVICE_LABEL)}) AS product_reviews
FROM enriched GROUP BY Model""")
def agg17(spark, sf):
    return A.service_share_by_model(_e(spark, sf, sentiment=False))


_CORR_COLS = NUMERIC_RAW_COLUMNS + FEATURE_COLUMNS + ["Sentiment_Score"]


def _corr_sql(rel, cols):
    parts = []
    for a in cols:
        for b in cols:
            parts.append(f"SELECT {O.lit(a)} AS col_a, {O.lit(b)} AS col_b, "
                         f"round(CASE WHEN stddev_samp(CAST({a} AS DOUBLE)) = 0 OR stddev_samp(CAST({b} AS DOUBLE)) = 0 "
                         f"THEN NULL ELSE corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) END, 6) AS r FROM {rel}")
    return " UNION ALL ".join(parts)


@register("agg18_correlation_matrix", ENR + "\n" + _corr_sql("enriched", _CORR_COLS))
def agg18(spark, sf):
    return A.correlation_matrix(_e(spark, sf), _CORR_COLS)


@register("agg18b_correlation_by_dtype", SQL["agg18_correlation_matrix"])
def agg18b(spark, sf):
    """CLN14: all columns of a numeric type, found from the schema."""
    df = _e(spark, sf)
    return A.correlation_matrix(df, A.numeric_columns(df))


@register("agg09b_class_company_polarity", ENR + """
SELECT 'class' AS level, CAST(NULL AS VARCHAR) AS Company, classification, CAST(NULL AS VARCHAR) AS Polarity, count(*) AS count
FROM enriched GROUP BY classification
UNION ALL SELECT 'company and class', Company, classification, NULL, count(*) FROM enriched GROUP BY Company, classification
UNION ALL SELECT 'polarity', NULL, NULL, Polarity, count(*) FROM enriched GROUP BY Polarity""")
def agg09b(spark, sf):
    """AGG9, AGG10 and AGG11's counts by one set of grouping sets."""
    return A.class_company_polarity(_e(spark, sf))


# ---------------------------------------------------------------- n-grams
def _ngram_sql(rel, n, text="text_lower", group_cols=()):
    stop = O.lit_list(STOP)
    g = "".join(f"{c}, " for c in group_cols)
    toks = (f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), "
            f"lambda x: NOT list_contains({stop}, x))")
    if n == 1:
        return f"SELECT {g}unnest(t) AS ngram FROM (SELECT {g}{toks} AS t FROM {rel})"
    return (f"SELECT {g}unnest(list_transform(generate_series(1, len(t) - {n - 1}), "
            f"lambda i: array_to_string(t[i:i + {n - 1}], ' '))) AS ngram "
            f"FROM (SELECT {g}{toks} AS t FROM {rel}) WHERE len(t) >= {n}")


def _top_sql(n, top):
    lim = f" LIMIT {top}" if top else ""
    return (ENR_NOSENT + f", grams AS ({_ngram_sql('enriched', n)})\n"
            f"SELECT ngram, count(*) AS count FROM grams GROUP BY ngram ORDER BY count DESC, ngram{lim}")


def _top_query(n, top):
    def q(spark, sf):
        return N.top_ngrams(_e(spark, sf, sentiment=False), "text_lower", n, STOP, top)
    return q


for _name, _n, _top in [("ngr04_top10_unigrams", 1, 10), ("ngr04_top20_bigrams", 2, 20),
                        ("ngr04_top20_trigrams", 3, 20), ("ngr05_all_unigram_counts", 1, None)]:
    register(_name, _top_sql(_n, _top))(_top_query(_n, _top))


@register("ngr06_top10_trigrams_per_model_class", ENR_NOSENT + f"""
, grams AS ({_ngram_sql('enriched', 3, group_cols=('Model', 'classification'))}),
c AS (SELECT Model, classification, ngram, count(*) AS count FROM grams GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY Model, classification ORDER BY count DESC, ngram) AS INT) AS rank FROM c)
WHERE rank <= 10""")
def ngr06(spark, sf):
    return N.top_ngrams_per_group(_e(spark, sf, sentiment=False), "text_lower", 3, STOP, 10,
                                  ["Model", "classification"])


@register("ngr07_word_frequencies", ENR_NOSENT + f"""
, grams AS ({_ngram_sql('enriched', 1)}),
c AS (SELECT ngram AS word, count(*) AS count FROM grams GROUP BY ALL ORDER BY count DESC, word LIMIT 200)
SELECT word, count, CAST(row_number() OVER (ORDER BY count DESC, word) AS INT) AS rank,
       round(count / max(count) OVER (), 6) AS weight FROM c""")
def ngr07(spark, sf):
    return N.word_frequencies(_e(spark, sf, sentiment=False), "text_lower", STOP, 200)


@register("ngr08_word_frequencies_by_polarity", ENR + f"""
, grams AS ({_ngram_sql('enriched', 1, group_cols=('Polarity',))}),
c AS (SELECT Polarity, ngram AS word, count(*) AS count FROM grams GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY Polarity ORDER BY count DESC, word) AS INT) AS rank FROM c)
SELECT Polarity, word, count, rank, round(count / max(count) OVER (PARTITION BY Polarity), 6) AS weight
FROM r WHERE rank <= 200""")
def ngr08(spark, sf):
    df = _e(spark, sf).where(F.col("Polarity").isin("Positive", "Negative"))
    return N.word_frequencies(df, "text_lower", STOP, 200, group_cols=["Polarity"])


SQL["ngr08_word_frequencies_by_polarity"] = SQL["ngr08_word_frequencies_by_polarity"].replace(
    "FROM r WHERE rank <= 200", "FROM r WHERE rank <= 200 AND Polarity IN ('Positive', 'Negative')")


# ---------------------------------------------------------------- topic text cleaning
from opinio.functions import text as TX  # noqa: E402
from opinio.operators import textclean as TC  # noqa: E402
from opinio.operators import topics as TP  # noqa: E402
from opinio.sources import markup as MK  # noqa: E402
from opinio.sources import pages as PG  # noqa: E402
from opinio.sources.tables import table  # noqa: E402

CHAIN_STOP = R.FIXTURE_CHAIN_STOP_WORDS + R.TOPIC_EXTRA_STOP_WORDS


def _digits():
    return TX.digit_chars()


def _chain_sql(x, stop, dictionary_rel=None, order="reference"):
    """SQL form of TXT1-5 (+6) + 7 on expression ``x``; returns the final
    expression and extra CTE text (for the dictionary step)."""
    p = f"translate({x}, {O.PUNCT}, '')"
    m = lambda e: f"regexp_replace({e}, {O.lit(R.MENTION_PATTERN)}, '', 'g')"
    u = lambda e: f"regexp_replace({e}, {O.lit(R.URL_PATTERN)}, '', 'g')"
    if order == "urls_first":
        y = f"translate({m(u(x))}, {O.PUNCT}, '')"
    else:
        y = u(m(p))
    y = f"translate({y}, {O.lit(_digits())}, '')"
    y = (f"array_to_string(list_filter(string_split_regex({y}, '\\s+'), "
         f"lambda w: w <> '' AND NOT list_contains({O.lit_list([s.lower() for s in stop])}, lower(w))), ' ')")
    return y


def _collapse_sql(y):
    return f"array_to_string(list_filter(string_split_regex({y}, '\\s+'), lambda w: w <> ''), ' ')"


_DICT_CTE = """
dict AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM benchmark),
chain0 AS (SELECT review_key, @CHAIN@ AS t0 FROM @SRC@),
chain_w AS (SELECT review_key, unnest(list_filter(string_split_regex(t0, '\\s+'), lambda w: w <> '')) AS w,
   unnest(generate_series(1, len(list_filter(string_split_regex(t0, '\\s+'), lambda w: w <> '')))) AS pos FROM chain0),
chain_k AS (SELECT review_key, string_agg(CASE WHEN d.word IS NULL THEN '' ELSE w END, ' ' ORDER BY pos) AS t1
   FROM chain_w LEFT JOIN dict d ON lower(chain_w.w) = d.word GROUP BY review_key),
chained AS (SELECT @SRC@.*, """ + _collapse_sql("coalesce(chain_k.t1, '')") + """ AS text_topic
   FROM @SRC@ LEFT JOIN chain_k ON @SRC@.review_key = chain_k.review_key)"""


def _chained_ctes(src="enriched"):
    return ENR_NOSENT + "," + _DICT_CTE.replace("@CHAIN@", _chain_sql("text_lower", CHAIN_STOP)).replace("@SRC@", src)


def _benchmark_dictionary(spark, sf):
    return TC.dictionary_from_text(table(spark, sf, "benchmark").select("text"))


def _chained(spark, sf):
    df = _e(spark, sf, sentiment=False)
    return TC.clean_chain(df, "review_key", "text_lower", CHAIN_STOP, _benchmark_dictionary(spark, sf))


@register("txt08_topic_text_chain", _chained_ctes() + """
SELECT Model, Reviewer_name, text_topic FROM chained""")
def txt08(spark, sf):
    return _chained(spark, sf).select("Model", "Reviewer_name", "text_topic")


_FIXTURE_CHAIN_SQL = (
    "array_to_string(list_filter(string_split_regex("
    + _collapse_sql(f"translate(translate(text, {O.PUNCT}, ''), {O.lit(TX.digit_chars())}, '')")
    + f", '\\s+'), lambda w: w <> '' AND NOT list_contains({O.lit_list(R.FIXTURE_CHAIN_STOP_WORDS)}, lower(w))), ' ')")


@register("txt08b_documents_chain_fixture_order", f"SELECT doc_id, {_FIXTURE_CHAIN_SQL} AS text FROM documents")
def txt08b(spark, sf):
    """FIXTURES check: TXT1 -> TXT4 -> TXT7 -> TXT5 over ``documents``."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    x = TX.collapse_spaces(TX.remove_numbers(TX.remove_punctuation(F.col("text"))))
    return d.select("doc_id", TX.remove_stop_words(x, R.FIXTURE_CHAIN_STOP_WORDS).alias("text"))


@register("txt08c_urls_first_order", ENR_NOSENT + f"""
SELECT Model, Reviewer_name, {_collapse_sql(_chain_sql('text_lower', CHAIN_STOP, order='urls_first'))} AS text_topic
FROM enriched""")
def txt08c(spark, sf):
    df = _e(spark, sf, sentiment=False)
    return TC.clean_chain(df, "review_key", "text_lower", CHAIN_STOP, None, order="urls_first").select(
        "Model", "Reviewer_name", "text_topic")


# ---------------------------------------------------------------- topic tokens and tables
_FOLD = R.accent_fold_table()


def _tokens_sql(x):
    return (f"list_filter(regexp_extract_all(translate(lower({x}), {O.lit(_FOLD[0])}, {O.lit(_FOLD[1])}), "
            f"{O.lit(TP.ALPHA_TOKEN)}), lambda t: length(t) >= {R.TOKEN_MIN_LEN} AND length(t) <= {R.TOKEN_MAX_LEN} "
            f"AND NOT starts_with(t, '_') AND NOT list_contains({O.lit_list(STOP)}, t))")


# One document per review: the key covers the whole row, so that reviews with the same text stay apart.
def _amount(c):
    return F.col(c).try_cast("decimal(24,6)").cast("string")


def _doc_key():
    return F.md5(F.concat_ws("\x1f", "Model", "Company", _amount("Overall_product_rating"),
                             _amount("Overall_product_rating_count"), "Review_title", "Reviewer_name",
                             _amount("Review_Rating"), "Review", _amount("Review_helpful_rating")))


_DOC_KEY_SQL = "md5(concat_ws(chr(31), Model, Company, " + ", ".join(
    f"CAST(CAST({c} AS DECIMAL(24,6)) AS VARCHAR)" if c.endswith(("rating", "count", "Rating")) else c
    for c in ("Overall_product_rating", "Overall_product_rating_count", "Review_title", "Reviewer_name",
              "Review_Rating", "Review", "Review_helpful_rating")) + "))"


def _docs(spark, sf):
    """Topic corpus: one row per review (key, tokens)."""
    df = _chained(spark, sf)
    return df.select(_doc_key().alias("doc"),
                     TP.topic_tokens(F.col("text_topic"), STOP).alias("tokens"))


_DOCS_SQL = _chained_ctes() + f""",
docs AS (SELECT {_DOC_KEY_SQL} AS doc, {_tokens_sql('text_topic')} AS tokens FROM chained)"""


@register("top01_topic_tokens", _DOCS_SQL + "\nSELECT doc, array_to_string(tokens, ' ') AS tokens FROM docs")
def top01(spark, sf):
    return _docs(spark, sf).select("doc", F.array_join("tokens", " ").alias("tokens"))


@register("top01b_lemmatised_tokens", _DOCS_SQL + """,
lem AS (SELECT DISTINCT t AS form, rtrim(t, 's') AS lemma FROM (SELECT unnest(tokens) AS t FROM docs)
        WHERE ends_with(t, 's') AND length(rtrim(t, 's')) > 1),
ex AS (SELECT doc, unnest(tokens) AS t, unnest(range(len(tokens))) AS p FROM docs),
re AS (SELECT doc, string_agg(coalesce(lemma, t), ' ' ORDER BY p) AS tokens FROM ex LEFT JOIN lem ON t = form GROUP BY doc)
SELECT docs.doc, coalesce(re.tokens, '') AS tokens FROM docs LEFT JOIN re ON docs.doc = re.doc""")
def top01b(spark, sf):
    """The lemma step, with a (form, lemma) table derived from the corpus: final s dropped."""
    docs = _corpus(spark, sf)
    base = F.rtrim(F.col("form"), F.lit("s"))
    lemmas = (docs.select(F.explode("tokens").alias("form")).where(F.col("form").endswith("s")).distinct()
              .select("form", base.alias("lemma")).where(F.length("lemma") > 1))
    return TP.lemmatize(docs, "doc", "tokens", lemmas).select("doc", F.array_join("tokens", " ").alias("tokens"))


_RULES_SQL = " UNION ALL ".join(
    f"SELECT form, {k} AS k, substr(form, 1, length(form) - {len(end)}) || '{to}' AS lemma FROM fm "
    f"WHERE ends_with(form, '{end}') AND length(form) > {len(end)}" for k, (end, to) in enumerate(TP.NOUN_ENDINGS))


@register("top01c_rule_lemmas", _DOCS_SQL + f""",
fm AS (SELECT DISTINCT unnest(tokens) AS form FROM docs),
exc AS (SELECT form, reverse(form) AS lemma FROM fm WHERE form IN ('les', 'des', 'las')),
ru AS (SELECT form, arg_min(lemma, k) AS lemma FROM ({_RULES_SQL}) WHERE lemma IN (SELECT form FROM fm) GROUP BY form),
lem AS (SELECT fm.form, coalesce(exc.lemma, ru.lemma) AS lemma FROM fm LEFT JOIN exc ON fm.form = exc.form LEFT JOIN ru ON fm.form = ru.form),
ex AS (SELECT doc, unnest(tokens) AS t, unnest(range(len(tokens))) AS p FROM docs),
re AS (SELECT doc, string_agg(coalesce(lemma, t), ' ' ORDER BY p) AS tokens FROM ex LEFT JOIN lem ON t = form GROUP BY doc)
SELECT docs.doc, coalesce(re.tokens, '') AS tokens FROM docs LEFT JOIN re ON docs.doc = re.doc""")
def top01c(spark, sf):
    """The lemma step by detachment rules with a dictionary (the corpus' own words) and irregular forms."""
    docs = _corpus(spark, sf)
    forms = docs.select(F.explode("tokens").alias("form")).distinct()
    irregular = forms.where(F.col("form").isin("les", "des", "las")).select("form", F.reverse("form").alias("lemma"))
    lemmas = TP.rule_lemmas(forms, forms.select(F.col("form").alias("word")), irregular)
    return TP.lemmatize(docs, "doc", "tokens", lemmas).select("doc", F.array_join("tokens", " ").alias("tokens"))


@register("top03_bag_of_words", _DOCS_SQL + """
SELECT doc, token, count(*) AS count FROM (SELECT doc, unnest(tokens) AS token FROM docs) GROUP BY doc, token""")
def top03(spark, sf):
    return TP.bag_of_words(_docs(spark, sf), "doc", "tokens")


@register("top02_dictionary", _DOCS_SQL + """,
bow AS (SELECT doc, token, count(*) AS count FROM (SELECT doc, unnest(tokens) AS token FROM docs) GROUP BY doc, token)
SELECT token, count(*) AS doc_freq, CAST(sum(count) AS BIGINT) AS coll_freq, row_number() OVER (ORDER BY token) - 1 AS token_id
FROM bow GROUP BY token""")
def top02(spark, sf):
    return TP.dictionary_table(TP.bag_of_words(_docs(spark, sf), "doc", "tokens"))


# ---------------------------------------------------------------- LDA (rows-only checks)
def _corpus(spark, sf):
    """The topic corpus (doc, tokens), written once per query to the shared checkpoint folder: the model
    fits, coherence and overview read it many times."""
    return cut_lineage(_docs(spark, sf))


def _lda(docs, k=R.LDA_TOPICS, iters=R.LDA_PASSES, seed=42):
    """(term table, vectors, fitted model) of a corpus."""
    terms, vec = TP.vectorize(docs)
    return terms, vec, TP.fit_lda(vec, k, iters, seed)


@register("top05_lda_topic_terms")
def top05(spark, sf):
    terms, vec, model = _lda(_corpus(spark, sf))
    return TP.topic_terms(model, terms, 10)


@register("top06_doc_topics")
def top06(spark, sf):
    terms, vec, model = _lda(_corpus(spark, sf))
    return TP.doc_topics(model, vec, "doc").select("doc", "dominant_topic",
                                                  F.transform("theta", lambda x: F.round(x, 6)).alias("theta"))


@register("top07_perplexity")
def top07(spark, sf):
    terms, vec, model = _lda(_corpus(spark, sf))
    return TP.perplexity(model, vec)


@register("top08_coherence_cv")
def top08(spark, sf):
    docs = _corpus(spark, sf)
    terms, vec, model = _lda(docs)
    top = TP.topic_terms(model, terms, 20).select("topic", "term")
    return TP.coherence_cv(docs, "doc", "tokens", top).select("topic", F.round("coherence", 6).alias("coherence"))


@register("top09_topic_count_sweep")
def top09(spark, sf):
    """One pass over the corpus per topic count: twenty minibatches of a twentieth."""
    docs = _corpus(spark, sf)
    terms, vec = TP.vectorize(docs)
    out = None
    for k in R.LDA_SWEEP:
        if k == 1:
            top = TP.unigram_topic(docs, "tokens", 20)
        else:
            top = TP.topic_terms(TP.fit_lda(vec, k, 20, R.LDA_SWEEP_SEED, subsampling=0.05), terms, 20)
        c = TP.coherence_summary(TP.coherence_cv(docs, "doc", "tokens", top.select("topic", "term"))).select(
            F.lit(k).alias("num_topics"), F.round("coherence", 6).alias("coherence"))
        out = c if out is None else out.unionByName(c)
    return out


def _overview(spark, sf):
    """(prevalence, relevance, distances) of a fitted model."""
    docs = _corpus(spark, sf)
    terms, vec, model = _lda(docs)
    theta = TP.doc_topics(model, vec, "doc")
    lens = docs.select("doc", F.size("tokens").alias("n"))
    tf = terms.select(F.col("token").alias("term"), F.col("coll_freq").alias("freq"))
    return TP.topic_overview(theta, lens, "doc", TP.topic_weights(model, terms), tf)


@register("top10_topic_prevalence")
def top10(spark, sf):
    return _overview(spark, sf)[0].select("topic", F.round("prevalence", 6).alias("prevalence"))


@register("top10b_topic_relevance_terms")
def top10b(spark, sf):
    return _overview(spark, sf)[1].select("topic", "rank", "term", F.round("relevance", 6).alias("relevance"))


@register("top10c_topic_distances")
def top10c(spark, sf):
    return _overview(spark, sf)[2].select("ta", "tb", F.round("js_divergence", 6).alias("js_divergence"))


# ---------------------------------------------------------------- stored pages
def _pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", "html")


_PK = (f"concat(regexp_extract(url, {O.lit(PG.PRODUCT_KEY_RE)}, 1), "
       f"regexp_replace(regexp_extract(url, {O.lit(PG.PRODUCT_KEY_RE)}, 2), '/$', ''))")
_PAGE_NO = "coalesce(TRY_CAST(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS INT), 1)"
# SQL by the rule, on strings alone: paragraphs start at <p>, end at </p> or the next <p>.
_PARAS = ("list_transform(string_split(string_split(string_split(html, '<article>')[2], '</article>')[1], '<p>')[2:], "
          "lambda p: string_split(p, '</p>')[1])")


def _text_sql(x):
    x = f"regexp_replace(replace({x}, '<br>', chr(10)), '<[^>]*>', '', 'g')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("middot", "·"), ("copy", "©"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13))"


@register("src03_review_blocks", f"""
WITH pf AS (SELECT page_id, {_PK} AS product_key, {_PAGE_NO} AS page_no,
   regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS Company,
   string_split(string_split(html, '<h1>')[2], '</h1>')[1] AS Model, {_PARAS} AS paras FROM pages),
b AS (SELECT page_id, product_key, page_no, Company, Model, unnest(paras) AS block,
      unnest(generate_series(0, len(paras) - 1)) AS block_no FROM pf)
SELECT page_id, product_key, page_no, Company, Model, CAST(block_no AS INT) AS block_no, {_text_sql('block')} AS Review,
   CASE WHEN contains(block, ' found this helpful') THEN regexp_extract(block, {O.lit(PG.VOTES_RE)}, 0) ELSE '0' END
     AS Review_helpful_rating FROM b""")
def src03(spark, sf):
    return PG.review_blocks(_pages(spark, sf))


@register("src04_markup_blocks", f"""
WITH pf AS (SELECT page_id, string_split(string_split(html, '<h1>')[2], '</h1>')[1] AS m,
   string_split(string_split(html, '<title>')[2], '</title>')[1] AS t, {_PARAS} AS paras FROM pages),
b AS (SELECT page_id, m, t, unnest(paras) AS block, unnest(generate_series(0, len(paras) - 1)) AS block_no FROM pf)
SELECT page_id, CAST(block_no AS INT) AS block_no, {_text_sql('m')} AS Model, {_text_sql('t')} AS page_title, {_text_sql('block')} AS Review FROM b""")
def src04(spark, sf):
    """SRC3-5 by the element stack: the paragraphs of stored articles, page fields repeated."""
    out = MK.extract(_pages(spark, sf), {"article": MK.ARTICLE}, ["Model", "page_title", "Review"])
    return out.select("page_id", "block_no", "Model", "page_title", "Review")


_SHOWN = ["Overall_product_rating", "Overall_product_rating_count", "Review_title", "Reviewer_name", "Review_Rating", "Review", "Review_helpful_rating"]
_SHOWN_SQL = ("shown AS (SELECT Model, Company, " + ", ".join(f"trim({c}, ' ' || chr(9) || chr(10) || chr(13)) AS {c}" for c in _SHOWN) + " FROM raw)")


def _review_pages(spark, sf):
    """Review pages in both layouts, written from the raw reviews: ten documents or so of one product a page."""
    from opinio.sources.review_pages import review_pages
    raw = reviews_raw(spark, sf, keep_doc_id=True)
    return review_pages(raw.withColumn("ten", F.floor(F.col("doc_id") / 200)), ["ten"])


@register("src05_review_page_fields", O.with_ctes(O.ADAPTER, _SHOWN_SQL) + "\nSELECT " + ", ".join(RAW_COLUMNS) + " FROM shown")
def src05(spark, sf):
    """SRC3-6: every field of every review, read back from review pages in two layouts."""
    return MK.raw_reviews(_review_pages(spark, sf), RAW_COLUMNS).select(*RAW_COLUMNS)


@register("src05b_cleaned_from_pages", O.with_ctes(O.ADAPTER, _SHOWN_SQL, O.CLEAN.replace("FROM raw)", "FROM shown)")) + """
SELECT Model, Company, Overall_product_rating, Overall_product_rating_count, Review_title, Reviewer_name,
       Review_Rating, Review, Review_helpful_rating, Title_and_Reviews FROM keyed""")
def src05b(spark, sf):
    """Pages to cleaned reviews."""
    from opinio.operators.clean import clean_reviews
    raw = MK.raw_reviews(_review_pages(spark, sf), RAW_COLUMNS).select(*RAW_COLUMNS)
    return clean_reviews(raw).select(*RAW_COLUMNS, "Title_and_Reviews")


# Nothing of an article is lost: its characters outside tags, less the headline, are the blocks' characters.
@register("src03b_article_characters", """
SELECT CAST(sum(length(regexp_replace(string_split(string_split(html, '</h1>')[2], '</article>')[1], '<[^>]*>|[ \\t\\r\\n]+|&[a-z]+;', '', 'g')))
            AS BIGINT) AS characters FROM pages""")
def src03b(spark, sf):
    blocks = PG.page_fields(_pages(spark, sf)).select(F.explode(PG.paragraphs(F.col("articles"))).alias("b"))
    text = F.regexp_replace("b", r"<[^>]*>|[ \t\r\n]+|&[a-z]+;", "")
    return blocks.agg(F.sum(F.length(text)).cast("long").alias("characters"))


@register("src07_pages_until_last", f"""
WITH pf AS (SELECT page_id, {_PK} AS product_key, {_PAGE_NO} AS page_no, contains(html, 'Next page') AS has_next FROM pages),
last AS (SELECT product_key, min(page_no) AS last_page FROM pf WHERE NOT has_next GROUP BY product_key)
SELECT page_id, pf.product_key, page_no, has_next FROM pf LEFT JOIN last ON pf.product_key = last.product_key
WHERE last_page IS NULL OR page_no <= last_page""")
def src07(spark, sf):
    return PG.pages_until_last(_pages(spark, sf)).select("page_id", "product_key", "page_no", "has_next")


@register("src08_reviews_per_product", f"""
WITH pf AS (SELECT page_id, {_PK} AS product_key, {_PAGE_NO} AS page_no, contains(html, 'Next page') AS has_next,
   len({_PARAS}) AS n_blocks FROM pages),
last AS (SELECT product_key, min(page_no) AS last_page FROM pf WHERE NOT has_next GROUP BY product_key),
kept AS (SELECT pf.* FROM pf LEFT JOIN last ON pf.product_key = last.product_key
         WHERE last_page IS NULL OR page_no <= last_page),
per AS (SELECT product_key, sum(n_blocks) AS reviews, min(page_id) AS first_page FROM kept GROUP BY product_key)
SELECT product_key, CAST(reviews AS BIGINT) AS reviews, first_page,
  CAST(sum(reviews) OVER (ORDER BY first_page, product_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
    AS cumulative_reviews FROM per""")
def src08(spark, sf):
    return PG.collected_per_product(_pages(spark, sf))


@register("src09_links_zip_shortest", f"""
WITH z AS (SELECT page_id, regexp_extract_all(html, {O.lit(PG.LINK_TEXT_RE)}, 1) AS a,
                  regexp_extract_all(html, {O.lit(PG.LINK_HREF_RE)}, 1) AS b FROM pages),
c AS (SELECT page_id, a[1:least(len(a), len(b))] AS a, b[1:least(len(a), len(b))] AS b FROM z)
SELECT page_id, unnest(a) AS link_text, unnest(b) AS href FROM c""")
def src09(spark, sf):
    return PG.page_links(_pages(spark, sf))


@register("src10_field_counts", f"""
SELECT count(*) AS pages, CAST(sum(length(regexp_extract(html, {O.lit(PG.TITLE_RE)}, 1))) AS BIGINT) AS title_chars,
  CAST(sum(len(regexp_extract_all(html, {O.lit(PG.LINK_HREF_RE)}, 1))) AS BIGINT) AS links,
  CAST(sum(len(regexp_extract_all(html, {O.lit(PG.LIST_ITEM_RE)}))) AS BIGINT) AS list_items,
  CAST(sum(len({_PARAS})) AS BIGINT) AS paragraphs,
  count(*) FILTER (WHERE length(trim(string_split(string_split(html, '<article>')[2], '</article>')[1])) = 0) AS empty_articles FROM pages""")
def src10(spark, sf):
    return PG.field_counts(_pages(spark, sf))


# ---------------------------------------------------------------- row ids and language
@register("cln04_dense_review_id", CLN + f"""
SELECT {_DOC_KEY_SQL} AS doc, Model, Reviewer_name, Review_Rating,
       row_number() OVER (ORDER BY {_DOC_KEY_SQL}) - 1 AS review_id FROM keyed""")
def cln04(spark, sf):
    """A dense id on every review row."""
    df = cleaned(spark, sf).select(_doc_key().alias("doc"), "Model", "Reviewer_name", "Review_Rating")
    return TP.dense_index(df, "doc", "review_id")


@register("cln10_language_id")
def cln10(spark, sf):
    """Language of each cleaned review by a Naive Bayes model trained on the
    labelled ``documents`` table; English text keeps its text, other text
    would be routed to translation."""
    from opinio.operators.language import identify_language, train_language_model
    docs = table(spark, sf, "documents").select("text", "lang", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).alias("fold"))
    model = train_language_model(docs.where("fold <> 0"), held_out=docs.where("fold = 0"))
    df = identify_language(cleaned(spark, sf), model, text="text_raw", out="lang", probability="probability")
    return df.select("Model", "Reviewer_name", "lang", (F.col("lang") == "en").alias("is_english"),
                     F.round("probability", 6).alias("probability"))


@register("cln13_filtered_reviews", ENR + """
SELECT Model, Reviewer_name, Sentiment_Score FROM enriched
WHERE classification = 'Service Review' AND Polarity = 'Negative'""")
def cln13(spark, sf):
    """Sentiment is scored after the filter on the classification, which does not depend on it: Spark cannot move the
    filter into the token branch of the join by itself."""
    df = _e(spark, sf, sentiment=False).where(F.col("classification") == R.SERVICE_LABEL)
    return score_sentiment(df, fixture_word_info(spark)).where(F.col("Polarity") == "Negative").select(
        "Model", "Reviewer_name", "Sentiment_Score")


# ---------------------------------------------------------------- more profiling / options
_CLEAN_COLS = RAW_COLUMNS + ["Title_and_Reviews"]


@register("prf01b_null_counts_clean", CLN + "\n" + _null_sql("keyed", _CLEAN_COLS))
def prf01b(spark, sf):
    return P.null_counts(cleaned(spark, sf), _CLEAN_COLS)


@register("ngr09_approx_top_words")
def ngr09(spark, sf):
    """Approximate heavy hitters (sketch) for very large vocabularies."""
    return N.approx_top_words(_e(spark, sf, sentiment=False), "text_lower", STOP, 20)


@register("ngr09b_heavy_words", ENR_NOSENT + f"""
, grams AS ({_ngram_sql('enriched', 1)}),
b AS (SELECT CAST(ceil(count(*) * (2 * 3.5 / 16384)) AS BIGINT) AS bound FROM grams)
SELECT ngram AS word, count(*) AS count, any_value(bound) AS bound FROM grams, b GROUP BY ngram HAVING count(*) > any_value(bound)""")
def ngr09b(spark, sf):
    """NGR9 with a bound: every word above it, counted exactly in a second pass."""
    return N.heavy_words(_e(spark, sf, sentiment=False), "text_lower", STOP)


# DuckDB's levenshtein counts bytes (a two-byte letter costs 2), Spark's
# counts characters, so this query has no SQL oracle; tests/test_textclean.py
# checks it against a brute-force edit distance.
@register("txt06b_spelling_suggestions")
def txt06b(spark, sf):
    df = _e(spark, sf, sentiment=False)
    chained = TC.clean_chain(df, "review_key", "text_lower", CHAIN_STOP, None)
    words = chained.select(F.explode(TX.split_words(F.col("text_topic"))).alias("word"))
    return TC.best_suggestions(words, _benchmark_dictionary(spark, sf), 2)


# Words of ASCII letters only, whose distance both engines count alike.
_ASCII_WORD = "^[a-z]+$"


@register("txt06c_corrected_text", ENR_NOSENT + f""",
fd AS (SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM benchmark)
       WHERE regexp_matches(word, '{_ASCII_WORD}') GROUP BY word),
ch AS (SELECT review_key, {_chain_sql('text_lower', CHAIN_STOP)} AS t0 FROM enriched),
cw AS (SELECT review_key, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM (SELECT review_key,
       list_filter(string_split_regex(t0, '\\s+'), lambda w: w <> '') AS ws FROM ch)),
un AS (SELECT DISTINCT lower(w) AS u FROM cw WHERE regexp_matches(lower(w), '{_ASCII_WORD}') AND lower(w) NOT IN (SELECT word FROM fd)),
sg AS (SELECT u, arg_min(word, (levenshtein(u, word), -freq, word)) AS best FROM un JOIN fd
       ON abs(length(u) - length(word)) <= 2 AND levenshtein(u, word) <= 2 GROUP BY u),
cf AS (SELECT review_key, string_agg(coalesce(best, w), ' ' ORDER BY pos) AS text_topic FROM cw LEFT JOIN sg ON lower(w) = u GROUP BY review_key)
SELECT Model, Reviewer_name, coalesce(text_topic, '') AS text_topic FROM enriched LEFT JOIN cf ON enriched.review_key = cf.review_key""")
def txt06c(spark, sf):
    """TXT6b in the chain: words of ASCII letters that the dictionary does not know become its best suggestion."""
    dictionary = TC.dictionary_with_frequency(table(spark, sf, "benchmark").select("text")).where(F.col("word").rlike(_ASCII_WORD))
    df = TC.clean_chain(_e(spark, sf, sentiment=False), "review_key", "text_lower", CHAIN_STOP, dictionary,
                        spelling="correct", pattern=_ASCII_WORD)
    return df.select("Model", "Reviewer_name", "text_topic")


# c_v coherence for topics fixed by the data (top 40 tokens, topic = rank mod 4),
# so both engines score the same topics.
_FIXED_TOPIC_WORDS = 40


def _fixed_topics(docs):
    tf = docs.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("c"))
    top = tf.orderBy(F.desc("c"), F.asc("term")).limit(_FIXED_TOPIC_WORDS)
    ranked = top.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("c"), F.asc("term"))) - 1)  # 40 rows
    return ranked.select((F.col("rk") % R.LDA_TOPICS).cast("int").alias("topic"), "term")


@register("top08b_coherence_fixed_topics", _DOCS_SQL + f""",
tf AS (SELECT term, count(*) AS c FROM (SELECT unnest(tokens) AS term FROM docs) GROUP BY term),
topw AS (SELECT term, row_number() OVER (ORDER BY c DESC, term) - 1 AS rk FROM tf ORDER BY c DESC, term LIMIT {_FIXED_TOPIC_WORDS}),
topics AS (SELECT CAST(rk % {R.LDA_TOPICS} AS INT) AS topic, term FROM topw),
words AS (SELECT DISTINCT term AS w FROM topics),
cd AS (SELECT doc, tokens, len(tokens) AS L FROM docs),
pos AS (SELECT doc, L, w, p FROM (SELECT doc, L, unnest(tokens) AS w, unnest(generate_series(0, L - 1)) AS p FROM cd)
        JOIN words USING (w)),
iv AS (SELECT doc, w, p, CASE WHEN L < 110 THEN 0 ELSE greatest(p - 109, 0) END AS lo,
              CASE WHEN L < 110 THEN 0 ELSE least(p, L - 110) END AS hi FROM pos),
iv2 AS (SELECT *, max(hi) OVER (PARTITION BY doc, w ORDER BY lo, hi, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_hi FROM iv),
iv3 AS (SELECT *, sum(CASE WHEN prev_hi IS NULL OR lo > prev_hi + 1 THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc, w ORDER BY lo, hi, p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM iv2),
runs AS (SELECT doc, w, run, min(lo) AS lo, max(hi) AS hi FROM iv3 GROUP BY ALL),
single AS (SELECT w, sum(hi - lo + 1) AS cnt FROM runs GROUP BY w),
nwin AS (SELECT sum(greatest(L - 110 + 1, 1)) AS N FROM cd WHERE doc IN (SELECT doc FROM pos)),
pair AS (SELECT a.w AS wi, b.w AS wj, sum(greatest(least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1, 0)) AS co
         FROM runs a JOIN runs b ON a.doc = b.doc AND a.w < b.w GROUP BY ALL),
tp AS (SELECT t1.topic, t1.term AS wi, t2.term AS wj FROM topics t1 JOIN topics t2 ON t1.topic = t2.topic),
tp2 AS (SELECT tp.topic, tp.wi, tp.wj, coalesce(si.cnt, 0) AS ci, coalesce(sj.cnt, 0) AS cj,
          CASE WHEN tp.wi = tp.wj THEN coalesce(si.cnt, 0) ELSE coalesce(pr.co, 0) END AS co, N
        FROM tp LEFT JOIN single si ON si.w = tp.wi LEFT JOIN single sj ON sj.w = tp.wj
        LEFT JOIN pair pr ON pr.wi = least(tp.wi, tp.wj) AND pr.wj = greatest(tp.wi, tp.wj) CROSS JOIN nwin),
np AS (SELECT topic, wi, wj, ln((co / N + 1e-12) / ((ci / N) * (cj / N))) / (-ln(co / N + 1e-12)) AS npmi FROM tp2),
star AS (SELECT topic, wj, sum(npmi) AS s FROM np GROUP BY ALL),
cosv AS (SELECT np.topic, wi, sum(npmi * s) / (sqrt(sum(npmi * npmi)) * sqrt(sum(s * s))) AS cos
         FROM np JOIN star ON np.topic = star.topic AND np.wj = star.wj GROUP BY ALL)
SELECT topic, round(avg(cos), 6) AS coherence FROM cosv GROUP BY topic""")
def top08b(spark, sf):
    docs = _corpus(spark, sf)
    per_topic = TP.coherence_cv(docs, "doc", "tokens", _fixed_topics(docs))
    return per_topic.select("topic", F.round("coherence", 6).alias("coherence"))


# ---------------------------------------------------------------- sources and sinks: written and read back
@register("src02_csv_round_trip", O.with_ctes(O.ADAPTER) + "\nSELECT " + ", ".join(RAW_COLUMNS) + " FROM raw")
def src02(spark, sf):
    """SNK1 then SRC2: the raw reviews as headerless CSV files (with a byte order mark) below the shared folder, read back with
    the encoding found per file."""
    path = scratch_folder(spark, "reviews-csv")
    append_csv(reviews_raw(spark, sf).select(*RAW_COLUMNS), path, mark=True)
    return read_reviews_csv(spark, path, header=False)


@register("cln02b_appended_batches", SQL["cln01_clean_reviews"])
def cln02b(spark, sf):
    """Cleaning across appended runs: three batches that repeat rows of one another, the second run twice."""
    from opinio.operators import incremental as I
    folder = scratch_folder(spark, "appended")
    raw = reviews_raw(spark, sf, keep_doc_id=True)
    third = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    for batch, rows in enumerate((raw.where(third < 2), raw.where(third > 0), raw)):
        for _ in range(1 + (batch == 1)):
            I.append_batch(rows.select(*RAW_COLUMNS), folder, batch)
    return I.cleaned_table(spark, folder, cleaned(spark, sf).schema).select(*RAW_COLUMNS, "Title_and_Reviews")


@register("snk03_parquet_round_trip", SQL["cln01_clean_reviews"])
def snk03(spark, sf):
    """SNK3: the cleaned reviews as Parquet partitioned by company, read back."""
    path = scratch_folder(spark, "reviews-parquet")
    df = cleaned(spark, sf).select(*RAW_COLUMNS, "Title_and_Reviews")
    export_parquet(df, path, "Company")
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


# ---------------------------------------------------------------- language: held-out check and routing
@register("cln10b_language_held_out")
def cln10b(spark, sf):
    """CLN10 measured: trained on four fifths of the labelled documents (by crc32 of the id), counted on the rest."""
    from opinio.operators.language import identify_language, train_language_model
    docs = table(spark, sf, "documents").select("text", F.col("lang").alias("label"),
                                                (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).alias("fold"))
    model = train_language_model(docs.where("fold <> 0").select("text", F.col("label").alias("lang")))
    out = identify_language(docs.where("fold = 0"), model, text="text", out="lang")
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("documents"),
                                    F.count_if(F.col("lang") == F.col("label")).alias("correct"))


@register("cln10c_language_reliability")
def cln10c(spark, sf):
    """Calibrated probabilities measured: fitted on three fifths, calibrated on one, counted on the last, by tenths of the probability."""
    from opinio.operators.language import identify_language, route_by_confidence, train_language_model
    docs = table(spark, sf, "documents").select("text", "lang", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).alias("fold"))
    model = train_language_model(docs.where("fold > 1").select("text", "lang"), held_out=docs.where("fold = 1").select("text", "lang"))
    out = identify_language(docs.where("fold = 0").withColumnRenamed("lang", "label"), model, "text", "lang", "probability")
    routed = route_by_confidence(F.col("lang"), F.col("probability"))
    return (out.groupBy(F.least(F.floor(F.col("probability") * 10), F.lit(9)).cast("int").alias("tenth"))
            .agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("probability"), 6).alias("mean_probability"),
                 F.round(F.avg((F.col("lang") == F.col("label")).cast("double")), 6).alias("accuracy"),
                 F.count_if(routed == "unsure").alias("unsure")))


_ROUTED_SQL = O.with_ctes(O.ADAPTER, O.CLEAN) + """,
labels AS (SELECT text, min(lang) AS lang FROM documents GROUP BY text),
memory AS (SELECT DISTINCT concat(substr(text, 1, 24), ' ', text) AS src, reverse(text) AS tr FROM documents
           WHERE lang <> 'en' AND n_chars % 2 = 0)
SELECT Model, Reviewer_name, Review_Rating, labels.lang, tr IS NOT NULL AND labels.lang <> 'en' AS translated,
       md5(CASE WHEN labels.lang = 'en' OR tr IS NULL THEN text_raw ELSE tr END) AS text_en_md5
FROM keyed JOIN labels ON keyed.Review = labels.text LEFT JOIN memory ON keyed.text_raw = memory.src"""


@register("cln12_translated_reviews", _ROUTED_SQL)
def cln12(spark, sf):
    """CLN11-12 in the cleaning step: English reviews keep their text, others take their entry of the
    translation memory, if it has one.  Labels and memory are derived from the given documents."""
    from opinio.operators.clean import clean_reviews
    from opinio.operators.language import translate_with_memory
    docs = table(spark, sf, "documents").select("text", "lang", "n_chars")
    labels = docs.groupBy("text").agg(F.min("lang").alias("lang"))
    memory = (docs.where((F.col("lang") != "en") & (F.col("n_chars") % 2 == 0))
              .select(F.concat(F.substring("text", 1, 24), F.lit(" "), "text").alias("text"), F.reverse("text").alias("translated")))

    def route(df):
        return translate_with_memory(df.join(labels, df["Review"] == labels["text"]).drop("text"), memory)

    df = clean_reviews(reviews_raw(spark, sf), translate=route)
    return df.select("Model", "Reviewer_name", "Review_Rating", "lang",
                     (F.col("text_en") != F.col("text_raw")).alias("translated"), F.md5("text_en").alias("text_en_md5"))


# Lexicon: the words and word pairs of the benchmark items that occur in at least two items; into the same reversed.
_LEXICON_WORDS = "list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')"
_LEXICON_SQL = O.with_ctes(O.ADAPTER, O.CLEAN) + f""",
bt AS (SELECT item_id, list_transform({_LEXICON_WORDS}, lambda w: {O.stripped('w')}) AS t FROM benchmark),
bp AS (SELECT item_id, unnest(t) AS phrase FROM bt UNION ALL
       SELECT item_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM bt),
lex AS (SELECT phrase, reverse(phrase) AS into_ FROM bp WHERE NOT contains(phrase, '  ') AND trim(phrase) = phrase AND phrase <> ''
        GROUP BY phrase HAVING count(DISTINCT item_id) >= 2),
src AS (SELECT review_key AS key, list_filter(string_split_regex(text_raw, '\\s+'), lambda w: w <> '') AS t FROM keyed),
tok AS (SELECT key, unnest(t) AS raw, unnest(range(1, len(t) + 1)) AS i FROM src),
low AS (SELECT key, i, {O.stripped('raw')} AS w FROM tok),""" + O.merged_tokens("low", "(SELECT phrase FROM lex)") + """
old AS (SELECT key, i, raw, row_number() OVER (PARTITION BY key ORDER BY i) AS k FROM tok),
span AS (SELECT key, i, hit, sum(CASE WHEN hit IS NULL THEN 1 ELSE len(string_split(hit, ' ')) END)
         OVER (PARTITION BY key ORDER BY i) AS last FROM s_merged),
fin AS (SELECT span.key, string_agg(CASE WHEN hit IS NULL THEN raw ELSE into_ END, ' ' ORDER BY span.i) AS translated
        FROM span JOIN old ON span.key = old.key AND last = old.k LEFT JOIN lex ON hit = lex.phrase GROUP BY span.key)
SELECT Model, Reviewer_name, Review_Rating, md5(coalesce(translated, '')) AS translated_md5
FROM keyed LEFT JOIN fin ON keyed.review_key = fin.key"""


@register("cln11_lexicon_translation", _LEXICON_SQL)
def cln11(spark, sf):
    """CLN11, lexicon form: words and phrases replaced from left to right, the longest first; the lexicon is derived from `benchmark`."""
    from opinio.operators.phrases import translate_with_lexicon
    from opinio.operators.sentiment import strip_edges
    words = F.transform(TX.split_words(F.lower("text")), strip_edges)
    items = table(spark, sf, "benchmark").select("item_id", words.alias("t"))
    pairs = F.when(F.size("t") > 1, F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.concat_ws(
        " ", F.element_at("t", i), F.element_at("t", i + 1)))).otherwise(F.array().cast("array<string>"))
    lexicon = (items.select("item_id", F.explode(F.concat("t", pairs)).alias("phrase"))
               .where(~F.col("phrase").contains("  ") & (F.trim("phrase") == F.col("phrase")) & (F.col("phrase") != ""))
               .groupBy("phrase").agg(F.count_distinct("item_id").alias("n")).where(F.col("n") >= 2)
               .select("phrase", F.reverse("phrase").alias("into")))
    df = translate_with_lexicon(cleaned(spark, sf), "review_key", "text_raw", lexicon)
    return df.select("Model", "Reviewer_name", "Review_Rating", F.md5("translated").alias("translated_md5"))


# ---------------------------------------------------------------- topic tables given fixed topics, and invariants
_OVERVIEW_SQL = _DOCS_SQL + f""",
tf AS (SELECT term, count(*) AS freq FROM (SELECT unnest(tokens) AS term FROM docs) GROUP BY term),
topw AS (SELECT term, freq, row_number() OVER (ORDER BY freq DESC, term) - 1 AS rk FROM tf ORDER BY freq DESC, term LIMIT {_FIXED_TOPIC_WORDS}),
w AS (SELECT CAST(t AS INT) AS topic, term, freq * (1 + (rk + t) % 4) AS x FROM topw, range({R.LDA_TOPICS}) AS r(t)),
phi AS (SELECT topic, term, CAST(x AS DOUBLE) / sum(x) OVER (PARTITION BY topic) AS weight FROM w),
dn AS (SELECT doc, len(tokens) AS n FROM docs),
theta AS (SELECT doc, n, CAST(t AS INT) AS topic, CAST(1 + (n + t) % 4 AS DOUBLE) / 10 AS p FROM dn, range({R.LDA_TOPICS}) AS r(t))"""


def _fixed_overview(spark, sf):
    """TOP10 on topics fixed by the data, the same in both engines."""
    docs = _corpus(spark, sf)
    tf = docs.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    top = tf.orderBy(F.desc("freq"), F.asc("term")).limit(_FIXED_TOPIC_WORDS)
    top = top.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("freq"), F.asc("term"))) - 1)       # 40 rows
    w = top.select(F.explode(F.array(*[F.lit(t) for t in range(R.LDA_TOPICS)])).alias("topic"), "term", "freq", "rk") \
        .withColumn("x", F.col("freq") * (1 + (F.col("rk") + F.col("topic")) % 4))
    phi = w.select("topic", "term", (F.col("x") / F.sum("x").over(Window.partitionBy("topic"))).alias("weight"))
    lens = docs.select("doc", F.size("tokens").alias("n"))
    theta = lens.select("doc", F.array(*[(1 + (F.col("n") + t) % 4).cast("double") / 10 for t in range(R.LDA_TOPICS)]).alias("theta"))
    return TP.topic_overview(theta, lens, "doc", phi, tf)


@register("top10d_prevalence_fixed_topics", _OVERVIEW_SQL + """
SELECT topic, round(sum(p * n) / sum(sum(p * n)) OVER (), 6) AS prevalence FROM theta GROUP BY topic""")
def top10d(spark, sf):
    return _fixed_overview(spark, sf)[0].select("topic", F.round("prevalence", 6).alias("prevalence"))


@register("top10e_relevance_fixed_topics", _OVERVIEW_SQL + """,
pw AS (SELECT term, CAST(freq AS DOUBLE) / sum(freq) OVER () AS pw FROM tf),
rel AS (SELECT topic, term, 0.6 * ln(weight) + 0.4 * ln(weight / pw) AS relevance FROM phi JOIN pw USING (term))
SELECT topic, term, round(relevance, 6) AS relevance FROM rel
QUALIFY row_number() OVER (PARTITION BY topic ORDER BY relevance DESC, term) <= 30""")
def top10e(spark, sf):
    return _fixed_overview(spark, sf)[1].select("topic", "term", F.round("relevance", 6).alias("relevance"))


@register("top10f_distances_fixed_topics", _OVERVIEW_SQL + """
SELECT a.topic AS ta, b.topic AS tb,
  round(0.5 * sum(a.weight * ln(a.weight / ((a.weight + b.weight) / 2)))
        + 0.5 * sum(b.weight * ln(b.weight / ((a.weight + b.weight) / 2))), 6) AS js_divergence
FROM phi a JOIN phi b ON a.term = b.term AND a.topic < b.topic GROUP BY a.topic, b.topic""")
def top10f(spark, sf):
    return _fixed_overview(spark, sf)[2].select("ta", "tb", F.round("js_divergence", 6).alias("js_divergence"))


@register("top04_lda_invariants", _DOCS_SQL + f"""
SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(DISTINCT t) FROM (SELECT unnest(tokens) AS t FROM docs)) AS terms,
       CAST({R.LDA_TOPICS} AS BIGINT) AS topics, CAST((SELECT count(*) FROM docs) AS DOUBLE) AS theta_total,
       true AS perplexity_is_minus_bound""")
def top04(spark, sf):
    """What must hold of any fit: every document has a distribution, every token is a term."""
    terms, vec, model = _lda(_corpus(spark, sf))
    theta = TP.doc_topics(model, vec, "doc").select(F.aggregate("theta", F.lit(0.0), lambda s, x: s + x).alias("s"),
                                                    F.size("theta").alias("k"))
    p = TP.perplexity(model, vec).select(((F.col("log_perplexity") + F.col("per_word_bound") == 0)
                                          & (F.col("log_perplexity") > 0)).alias("perplexity_is_minus_bound"))
    out = theta.agg(F.count(F.lit(1)).alias("documents"), F.max("k").cast("long").alias("topics"),
                    F.round(F.sum("s"), 6).alias("theta_total"))
    return out.withColumn("terms", terms.agg(F.count(F.lit(1))).scalar()).withColumn("perplexity_is_minus_bound", p.scalar())
