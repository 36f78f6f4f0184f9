"""Lexicon sentiment (SEN1) and polarity labels (SEN2).

Rules (published rule set of Hutto & Gilbert, 2014):

* tokens: whitespace split; edge punctuation stripped unless two or fewer
  characters would remain (keeps emoticons);
* valence of a token = lexicon(lower(token)); booster words and "kind"
  before "of" carry no valence; an ALL-CAPS token in a text that is not
  wholly caps adds +-0.733;
* "no" as negation: a lexicon "no" before another lexicon word scores 0,
  and a word after "no" (1 or 2 back, or 3 back via "or"/"nor") takes
  -0.74 x its lexicon valence;
* each of the 3 preceding tokens that is not itself in the lexicon: a
  booster adds +-0.293 (sign follows the running valence; a caps booster
  adds +-0.733 more), damped x1, x0.95, x0.9 by distance; then a negation
  at that position multiplies by -0.74 ("never so/this" x1.25, "without
  doubt" unchanged); "least" before the word negates unless "at least" /
  "very least";
* "but": valences before the first "but" x0.5, after it x1.5;
* sum; punctuation emphasis (0.292 per "!" up to 4; for 2-3 "?" 0.18 each,
  more 0.96) added away from zero; compound = s / sqrt(s^2 + 15), clamped
  to [-1, 1] and rounded to 4 places.
* phrases (boosters such as "kind of", idioms): the longest phrase that starts at a word becomes one token before
  all rules, so it takes part like a word of the lexicon (see ``opinio.operators.phrases``).
Not kept: emoji descriptions.

Execution plan
--------------
Per-review work stays in the row until tokens must meet the lexicon:
``posexplode`` turns a *narrow* projection (key + token array) into rows, and
the 3 preceding and the following neighbour are read from the array.  The fixed-size word tables are broadcast, so the
joins keep the review partitioning; the per-review sum therefore needs no
exchange when the input is already hash-partitioned by the key (which the
cleaning step leaves it), and the join back is co-partitioned.  Token rows
are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinio import resources as R
from opinio.functions.text import split_words
from opinio.operators.phrases import merge_phrases
from opinio.sources.tables import literal_table

UPPER_WORD = r"^[^\p{Ll}\p{Lt}]*\p{Lu}[^\p{Ll}\p{Lt}]*$"
NEVER_SO_SCALAR = 1.25


def polarity_label(score) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return (F.when(s >= R.POSITIVE_AT, F.lit("Positive"))
            .when(s <= R.NEGATIVE_AT, F.lit("Negative"))
            .otherwise(F.lit("Neutral")))


def _is_upper(w: Column) -> Column:
    return w.rlike(UPPER_WORD)


def word_info(spark: SparkSession, lexicon, boosters, negations) -> DataFrame:
    """(token, valence, boost, neg), one row per lower-cased token, from
    lexicon(token, valence), boosters(token, delta) and negations(token).

    Python lists are merged on the driver into one small local table.
    DataFrames (a full lexicon file) are merged with a grouped union, one
    shuffle of the word tables, never of the reviews."""
    if not any(isinstance(x, DataFrame) for x in (lexicon, boosters, negations)):
        rows: dict[str, list] = {}
        for tok, val in lexicon:
            rows.setdefault(tok.lower(), [None, None, False])
            if rows[tok.lower()][0] is None:
                rows[tok.lower()][0] = float(val)
        for tok, delta in boosters:
            rows.setdefault(tok.lower(), [None, None, False])
            if rows[tok.lower()][1] is None:
                rows[tok.lower()][1] = float(delta)
        for tok in negations:
            rows.setdefault(tok.lower(), [None, None, False])[2] = True
        return literal_table(spark, [(k, *v) for k, v in sorted(rows.items())],
                             "token string, valence double, boost double, neg boolean")

    def as_df(x, schema):
        return x if isinstance(x, DataFrame) else literal_table(spark, list(x), schema)
    lex = as_df(lexicon, "token string, valence double").select(
        F.lower("token").alias("token"), F.col("valence").cast("double").alias("valence"),
        F.lit(None).cast("double").alias("boost"), F.lit(False).alias("neg"))
    bst = as_df(boosters, "token string, delta double").select(
        F.lower("token").alias("token"), F.lit(None).cast("double").alias("valence"),
        F.col("delta").cast("double").alias("boost"), F.lit(False).alias("neg"))
    neg = as_df([(w,) for w in negations] if not isinstance(negations, DataFrame) else negations,
                "token string").select(F.lower("token").alias("token"), F.lit(None).cast("double").alias("valence"),
                                       F.lit(None).cast("double").alias("boost"), F.lit(True).alias("neg"))
    return (lex.unionByName(bst).unionByName(neg).groupBy("token")
            .agg(F.first("valence", ignorenulls=True).alias("valence"),
                 F.first("boost", ignorenulls=True).alias("boost"),
                 F.max("neg").alias("neg")))


def _scalar(p: Column, p_boost: Column, v: Column, capdiff: Column) -> Column:
    """Booster contribution of a preceding word given the running valence."""
    base = p_boost * F.when(v < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    caps = F.when(_is_upper(p) & capdiff,
                  F.when(v > 0, F.lit(R.CAPS_INCR)).otherwise(F.lit(-R.CAPS_INCR))).otherwise(F.lit(0.0))
    return F.when(p_boost.isNotNull(), base + caps).otherwise(F.lit(0.0))


def strip_edges(w: Column) -> Column:
    """Edge punctuation off, unless two or fewer characters would remain."""
    core = F.btrim(w, F.lit(R.PUNCTUATION))
    return F.when(F.length(core) <= 2, w).otherwise(core)


def token_valences(tokens_df: DataFrame, info: DataFrame, include_nt: bool = True) -> DataFrame:
    """Raw token rows (key, capdiff, i, w, p1, p2, p3, n1) -> (key, v) for
    every token that carries valence, after all neighbour rules.

    Edge punctuation is stripped by row expressions (whole-stage codegen):
    first on the token itself, and on its neighbours only for the few rows
    that hit the lexicon.  The first "but" of each review is a window min
    over its hit rows, which stays inside the partition (input partitioned
    by key)."""
    def side(k):
        return info.select(F.col("token").alias(f"{k}_tok"),
                           F.col("valence").alias(f"{k}_val"),
                           F.col("boost").alias(f"{k}_boost"),
                           F.col("neg").alias(f"{k}_neg"))

    # tokens that score, plus "but" (its first position scales the others)
    scoring = (info.where(F.col("valence").isNotNull() & F.col("boost").isNull())
               .select(F.col("token").alias("lw"), "valence"))
    # a second row for "but", should it score itself, only marks its place: rows without valence go below
    but_row = literal_table(info.sparkSession, [("but", None)], "lw string, valence double")
    hits_info = scoring.unionByName(but_row)
    t = tokens_df.withColumn("w", strip_edges(F.col("w"))).withColumn("lw", F.lower("w"))
    t = t.join(hits_info, "lw", "inner")
    # per review over its few hit rows only; rows are already partitioned by key
    t = t.withColumn("but_pos", F.coalesce(
        F.min(F.when(F.col("lw") == "but", F.col("i") + 1)).over(Window.partitionBy("key")), F.lit(0)))
    t = t.where(F.col("valence").isNotNull())
    for k in ("p1", "p2", "p3", "n1"):
        t = t.withColumn(k, strip_edges(F.col(k))).withColumn(f"l{k}", F.lower(k))
    # "kind of" carries no valence
    t = t.where(~((F.col("lw") == "kind") & F.coalesce(F.col("ln1") == "of", F.lit(False))))
    for k in ("p1", "p2", "p3", "n1"):
        t = t.join(side(k), F.col(f"l{k}") == F.col(f"{k}_tok"), "left")

    def in_lex(k):
        return F.col(f"{k}_val").isNotNull()

    def neg(k):
        n = F.coalesce(F.col(f"{k}_neg"), F.lit(False))
        if include_nt:
            n = n | F.coalesce(F.col(f"l{k}").contains("n't"), F.lit(False))
        return n

    # The running valence is materialised after each rule (one column per
    # step) so that no rule re-inlines the whole expression of the previous.
    lex = F.col("valence")
    lp1, lp2, lp3 = F.col("lp1"), F.col("lp2"), F.col("lp3")
    capdiff = F.col("capdiff")
    v = F.col("_v")
    no_before = (F.coalesce(lp1 == "no", F.lit(False)) | F.coalesce(lp2 == "no", F.lit(False))
                 | F.coalesce((lp3 == "no") & lp1.isin("or", "nor"), F.lit(False)))
    t = t.withColumn("_v", F.when(no_before, lex * R.NEGATION_SCALAR)
                     .when((F.col("lw") == "no") & in_lex("n1"), F.lit(0.0)).otherwise(lex))
    t = t.withColumn("_v", F.when(_is_upper(F.col("w")) & capdiff,
                                  F.when(v > 0, v + R.CAPS_INCR).otherwise(v - R.CAPS_INCR)).otherwise(v))
    for k, damp in zip(("p1", "p2", "p3"), R.PRECEDING_DAMPING):
        applies = F.col(k).isNotNull() & ~in_lex(k)
        t = t.withColumn("_v1", v + _scalar(F.col(k), F.col(f"{k}_boost"), v, capdiff) * F.lit(damp))
        v1 = F.col("_v1")
        if k == "p1":
            nv = F.when(neg("p1"), v1 * R.NEGATION_SCALAR).otherwise(v1)
        elif k == "p2":
            nv = (F.when((lp2 == "never") & lp1.isin("so", "this"), v1 * NEVER_SO_SCALAR)
                  .when((lp2 == "without") & (lp1 == "doubt"), v1)
                  .when(neg("p2"), v1 * R.NEGATION_SCALAR).otherwise(v1))
        else:
            nv = (F.when(F.coalesce((lp3 == "never") & lp2.isin("so", "this"), F.lit(False))
                         | lp1.isin("so", "this"), v1 * NEVER_SO_SCALAR)
                  .when((lp3 == "without") & ((lp2 == "doubt") | (lp1 == "doubt")), v1)
                  .when(neg("p3"), v1 * R.NEGATION_SCALAR).otherwise(v1))
        t = t.withColumn("_v", F.when(applies, nv).otherwise(v)).drop("_v1")
    least = ((lp1 == "least") & ~in_lex("p1")
             & (lp2.isNull() | ~F.coalesce(lp2.isin("at", "very"), F.lit(False))))
    t = t.withColumn("_v", F.when(F.coalesce(least, F.lit(False)), v * R.NEGATION_SCALAR).otherwise(v))
    pos1 = F.col("i") + 1
    but = (F.when((F.col("but_pos") > 0) & (pos1 < F.col("but_pos")), F.lit(0.5))
           .when((F.col("but_pos") > 0) & (pos1 > F.col("but_pos")), F.lit(1.5))
           .otherwise(F.lit(1.0)))
    return t.select("key", (v * but).alias("v"))


# A whitespace token that is upper case (has an upper-case letter and no
# lower/title-case letter), and one that is not.  Edge punctuation has no
# case, so testing raw tokens equals testing stripped tokens.
_UPPER_TOKEN = r"(?:^|\s)[^\s\p{Ll}\p{Lt}]*\p{Lu}[^\s\p{Ll}\p{Lt}]*(?=\s|$)"
_NON_UPPER_TOKEN = r"(?:^|\s)(?:[^\s\p{Lu}]+|[^\s]*[\p{Ll}\p{Lt}][^\s]*)(?=\s|$)"


def caps_differential(text: Column) -> Column:
    """Some but not all tokens are ALL CAPS (two whole-text regex tests)."""
    return F.coalesce(text.rlike(_UPPER_TOKEN) & text.rlike(_NON_UPPER_TOKEN), F.lit(False))


def phrases_of(info: DataFrame) -> DataFrame:
    """The entries of a word table that have several words."""
    return info.where(F.col("token").rlike(r"\S\s+\S")).select(F.col("token").alias("phrase"))


def explode_tokens(df: DataFrame, key: str, text: str, phrases: DataFrame | None = None) -> DataFrame:
    """Narrow raw token rows with neighbours: key, capdiff, i, w, p1, p2, p3, n1.  With ``phrases(phrase)`` the tokens
    are stripped first, and the longest phrases are one token each."""
    narrow = df.select(F.col(key).alias("key"), split_words(F.col(text)).alias("_t"),
                       caps_differential(F.col(text)).alias("capdiff"))
    if phrases is not None:
        narrow = narrow.withColumn("_t", F.transform("_t", strip_edges))
        narrow = merge_phrases(narrow, "key", "_t", F.transform("_t", F.lower), phrases)
    # the neighbours are read from the array only for tokens that pass the join which follows, in one generated stage;
    # (the outer form adds no filter that would split every text once more)
    rows = narrow.select("key", "capdiff", "_t", F.posexplode_outer("_t").alias("i", "w")).where(F.col("w").isNotNull())
    i = F.col("i")
    return rows.select("key", "capdiff", "i", "w", F.get("_t", i - 1).alias("p1"), F.get("_t", i - 2).alias("p2"),
                       F.get("_t", i - 3).alias("p3"), F.get("_t", i + 1).alias("n1"))


def punctuation_emphasis(text: Column) -> Column:
    ep = F.least(F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))), F.lit(R.EXCLAMATION_MAX))
    qm = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    qm_amp = F.when(qm > 3, F.lit(R.QUESTION_CAP)).when(qm > 1, qm * R.QUESTION_STEP).otherwise(F.lit(0.0))
    return ep * R.EXCLAMATION_STEP + qm_amp


def compound(sum_s: Column, emphasis: Column) -> Column:
    s = F.coalesce(sum_s, F.lit(0.0))
    s = F.when(s > 0, s + emphasis).when(s < 0, s - emphasis).otherwise(s)
    c = s / F.sqrt(s * s + F.lit(R.NORMALIZE_ALPHA))
    return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)), 4)


def score_sentiment(df: DataFrame, info: DataFrame, key: str = "review_key", text: str = "text_en",
                    score_col: str = "Sentiment_Score", label_col: str = "Polarity",
                    include_nt: bool = True, phrases: DataFrame | None = None) -> DataFrame:
    """Add ``Sentiment_Score`` and ``Polarity``; ``key`` must be unique per row.

    The planner broadcasts the word table if its size in bytes (exact for
    literal lists, the file size for a lexicon file) is under Spark's
    broadcast threshold; otherwise the token joins are shuffle joins.  Entries of several words
    only match if ``phrases`` names them (``phrases_of(info)``): it costs a second pass over the words."""
    sums = (token_valences(explode_tokens(df, key, text, phrases), info, include_nt)
            .groupBy("key").agg(F.sum("v").alias("_sum_s")))
    out = df.join(sums.withColumnRenamed("key", key), key, "left")
    # bound once: in a filter on the score or label, Spark would count the marks of the text again wherever they are used
    given = F.array(F.struct(F.col("_sum_s").alias("s"), punctuation_emphasis(F.col(text)).alias("marks")))
    out = out.withColumn(score_col, F.transform(given, lambda x: compound(x["s"], x["marks"]))[0]).drop("_sum_s")
    return out.withColumn(label_col, polarity_label(F.col(score_col)))


def fixture_word_info(spark: SparkSession) -> DataFrame:
    return word_info(spark, R.FIXTURE_LEXICON, R.FIXTURE_BOOSTERS, R.FIXTURE_NEGATIONS)


def fixture_phrase_info(spark: SparkSession) -> DataFrame:
    return word_info(spark, R.FIXTURE_LEXICON + R.FIXTURE_IDIOMS, R.FIXTURE_BOOSTERS + R.FIXTURE_PHRASE_BOOSTERS, R.FIXTURE_NEGATIONS)


def default_word_info(spark: SparkSession, lexicon, idioms=tuple(R.IDIOMS.items())) -> DataFrame:
    """Published booster, negation and idiom lists with a caller-given lexicon
    (a DataFrame read from the lexicon file, or pairs)."""
    boosters = [(w, R.BOOST_INCR) for w in R.BOOSTERS_UP] + [(w, R.BOOST_DECR) for w in R.BOOSTERS_DOWN]
    if isinstance(lexicon, DataFrame):
        own = literal_table(spark, list(idioms), "token string, valence double")
        lexicon = own.unionByName(lexicon.join(own.select("token"), "token", "left_anti"))
    else:
        lexicon = [*idioms, *lexicon]                         # the first of equal tokens counts
    return word_info(spark, lexicon, boosters, R.NEGATIONS)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated lexicon file: token, mean valence, (std, raw ratings)."""
    schema = T.StructType([T.StructField("token", T.StringType()), T.StructField("valence", T.DoubleType()),
                           T.StructField("std", T.DoubleType()), T.StructField("raw", T.StringType())])
    return (spark.read.schema(schema).option("sep", "\t").option("quote", "\u0000").csv(path)
            .select("token", "valence"))
