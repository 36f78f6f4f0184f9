"""Topic modelling (TOP1-TOP10).

* TOP1 tokens: lower case, accents folded, alphabetic runs (no digits),
  length 2..15, not starting with '_', stop words out, optional lemma table.
* TOP2/TOP3 table forms: bag of words (doc, token, count) and the
  dictionary (token, doc_freq, coll_freq, token_id) -- plain group-bys.
* TOP4-7: sparse count vectors over dense term ids (every token, no cap), made by joins,
  + online ``LDA``; the vectors are written to the shared folder before the iterative fit.
* TOP8 coherence c_v and TOP10 overview tables: DataFrame jobs over the
  topic-word table (K x N rows).
"""

from __future__ import annotations

import math

from pyspark.ml.clustering import LDA
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinio import resources as R
from opinio.functions.text import without_words
from opinio.operators import online_lda
from opinio.operators.lookup import word_lookup
from opinio.operators.windows import window_counts
from opinio.session import cut_lineage

_FOLD_SRC, _FOLD_DST = R.accent_fold_table()
ALPHA_TOKEN = r"[\p{L}\p{Nl}\p{No}_]+"


MAX_WORDS = 20_000


def fold_accents(c: Column) -> Column:
    return F.translate(c, _FOLD_SRC, _FOLD_DST)


def topic_tokens(text: Column, stop_words: list[str], min_len: int = R.TOKEN_MIN_LEN,
                 max_len: int = R.TOKEN_MAX_LEN) -> Column:
    toks = F.regexp_extract_all(fold_accents(F.lower(text)), F.lit(ALPHA_TOKEN), 0)
    toks = F.filter(toks, lambda t: (F.length(t) >= min_len) & (F.length(t) <= max_len) & ~t.startswith("_"))
    return without_words(toks, [w.lower() for w in stop_words])


def read_word_list(spark: SparkSession, path: str) -> list[str]:
    """Stop words from a text file, one per line, lower-cased, without comments
    (``#``), blanks and repeats.  The list becomes literals of the plan, so it
    must be a word list: more than ``MAX_WORDS`` lines are refused."""
    rows = spark.read.text(path).limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} words; use a dictionary join instead")
    words = (r["value"].strip().lower() for r in rows)
    return sorted({w for w in words if w and not w.startswith("#")})


def read_lemmas(spark: SparkSession, path: str) -> DataFrame:
    """(form, lemma) from a tab-separated file."""
    return spark.read.schema("form string, lemma string").option("sep", "\t").option("quote", "\u0000").csv(path)


def lemmatize(df: DataFrame, key: str, tokens: str, lemmas: DataFrame) -> DataFrame:
    """Replace each token by its lemma from ``lemmas(form, lemma)``, order
    kept: in the row if the table is small, else explode with position, broadcast-checked join, rebuild."""
    lem = lemmas.groupBy("form").agg(F.min("lemma").alias("lemma"))
    lemma = word_lookup(lem, "form", "lemma")
    if lemma is not None:
        replaced = F.transform(tokens, lambda t: F.coalesce(lemma(t), t))
        return df.withColumn(tokens, F.coalesce(replaced, F.array().cast("array<string>")))
    ex = df.select(F.col(key).alias("_k"), F.posexplode(tokens).alias("pos", "form"))
    rebuilt = (ex.join(lem, "form", "left")
               .select("_k", "pos", F.coalesce("lemma", "form").alias("t"))
               .groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))),
                                              lambda s: s["t"]).alias("_lem")))
    out = df.join(rebuilt, df[key] == rebuilt["_k"], "left")
    return out.withColumn(tokens, F.coalesce("_lem", F.array().cast("array<string>"))).drop("_k", "_lem")


# FIXED VALUES: endings of English noun plurals and what stands in their place (published detachment rules), tried in this order.
NOUN_ENDINGS = [("s", ""), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")]


def rule_lemmas(forms: DataFrame, dictionary: DataFrame, exceptions: DataFrame | None = None, endings=NOUN_ENDINGS) -> DataFrame:
    """(form, lemma) of the distinct ``forms(form)`` that have one: an irregular form by ``exceptions(form, lemma)``, else the first rule
    whose result is a word of ``dictionary(word)``.  A form that the dictionary knows and no rule shortens stays itself, so does
    an unknown one; only changed forms are returned.  Rules are laid out as rows and joined, not tried in a loop."""
    f = forms.select("form").distinct()
    tries = F.array(*[F.when(F.col("form").endswith(end) & (F.length("form") > len(end)), F.struct(
        F.lit(k).alias("k"), F.concat(F.col("form").substr(F.lit(1), F.length("form") - len(end)), F.lit(to)).alias("lemma")))
        for k, (end, to) in enumerate(endings)])
    known = dictionary.select(F.col("word").alias("lemma")).distinct()
    ruled = (f.select("form", F.inline(F.filter(tries, lambda t: t.isNotNull()))).join(known, "lemma")
             .groupBy("form").agg(F.min_by("lemma", "k").alias("by_rule")))
    out = f.join(ruled, "form", "left")
    if exceptions is None:
        out = out.withColumn("lemma", F.col("by_rule"))
    else:
        irregular = exceptions.groupBy("form").agg(F.min("lemma").alias("irregular"))
        out = out.join(irregular, "form", "left").withColumn("lemma", F.coalesce("irregular", "by_rule"))
    return out.where(F.col("lemma").isNotNull() & (F.col("lemma") != F.col("form"))).select("form", "lemma")


def bag_of_words(docs: DataFrame, key: str, tokens: str) -> DataFrame:          # TOP3
    return (docs.select(key, F.explode(tokens).alias("token"))
            .groupBy(key, "token").agg(F.count(F.lit(1)).alias("count")))


def dense_index(df: DataFrame, order_col: str, name: str, partitions: int | None = None) -> DataFrame:
    """0-based dense row number in ``order_col`` order, computed without a
    single-partition window: checkpoint the input, range-partition and sort,
    checkpoint (fixes partition contents), count rows per partition
    (<= partitions rows), prefix-sum those counts and add each row's offset
    in its partition."""
    # the range partitioner samples its input in a job of its own: read a
    # written copy instead of running the producing plan twice
    df = cut_lineage(df)
    n = partitions or max(1, df.rdd.getNumPartitions())   # keep the input's parallelism
    s = (df.repartitionByRange(n, order_col).sortWithinPartitions(order_col)
         .withColumn("_pid", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id()))
    s = cut_lineage(s)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_m0"))
    offsets = counts.withColumn("_off", F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))   # <= n rows
    return (s.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.coalesce("_off", F.lit(0)) + F.col("_mono") - F.col("_m0"))
            .drop("_pid", "_mono", "_n", "_m0", "_off"))


def dictionary_table(bow: DataFrame) -> DataFrame:                               # TOP2
    d = bow.groupBy("token").agg(F.count(F.lit(1)).alias("doc_freq"), F.sum("count").alias("coll_freq"))
    return dense_index(d, "token", "token_id")


# ---------------------------------------------------------------- LDA
def vectorize(docs: DataFrame, tokens: str = "tokens", key: str = "doc"):
    """(terms, vectorised docs): every token has a dense id (``terms``: token, doc_freq, coll_freq, token_id), and a document's
    counts are a sparse vector over these ids, made by a join and an aggregation.  No vocabulary is on the driver or
    broadcast; one number, its size, is read.

    The vectors are written in the parts a sparse vector has (kind, size, indices, values) and read as vectors; the fit reads
    them many times."""
    from opinio.sources.sinks import written
    bow = cut_lineage(bag_of_words(docs, key, tokens))
    terms = written(dictionary_table(bow), "topic-terms")     # of known size: a small table is not shuffled against the bag
    size = max(terms.agg(F.count(F.lit(1))).first()[0], 1)
    held = (bow.join(terms.select("token", "token_id"), "token")
            .groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("token_id").cast("int").alias("i"),
                                                                    F.col("count").cast("double").alias("x")))).alias("counts")))
    none = F.array().cast("array<struct<i:int,x:double>>")                # documents without tokens stay (empty vector)
    parts = docs.select(key, tokens).join(held, key, "left").withColumn("counts", F.coalesce("counts", none))
    vectors = parts.select(key, tokens, F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), F.transform("counts", lambda c: c["i"]).alias("indices"),
        F.transform("counts", lambda c: c["x"]).alias("values")).alias("features"))
    schema = T.StructType([*docs.select(key, tokens).schema.fields, T.StructField("features", VectorUDT())])
    return terms, written(vectors, "topic-vectors", schema)


def fit_lda(vec: DataFrame, k: int = R.LDA_TOPICS, max_iter: int = R.LDA_PASSES, seed: int = 42,
            subsampling: float = 1.0):
    """Online LDA: ``max_iter`` minibatches, each a ``subsampling`` share of the documents."""
    lda = LDA(k=k, maxIter=max_iter, seed=seed, optimizer="online", subsamplingRate=subsampling,
              featuresCol="features", topicDistributionCol="topicDistribution")
    if subsampling == 1.0:
        return online_lda.fit(vec, lda)
    held = vec.select("features").persist()                   # each minibatch is a pass; what is lost is read again
    try:
        return lda.fit(held)
    finally:
        held.unpersist()


def topic_terms(model, terms: DataFrame, n: int = 10) -> DataFrame:              # TOP5
    """(topic, rank, term, weight) of the n heaviest terms of each topic."""
    top = model.describeTopics(n).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t"))
    return (top.join(terms, F.col("t.termIndices") == F.col("token_id"))
            .select("topic", "rank", F.col("token").alias("term"), F.col("t.termWeights").alias("weight")))


def topic_weights(model, terms: DataFrame) -> DataFrame:
    """(topic, term, weight) of all terms, weights of a topic adding up to one: the model's description of its topics,
    taken apart on the executors and joined to the term table."""
    return topic_terms(model, terms, model.vocabSize()).select("topic", "term", "weight")


def doc_topics(model, vec: DataFrame, key: str) -> DataFrame:                     # TOP6
    arr = vector_to_array("topicDistribution")
    even = F.transform(arr, lambda x: F.lit(1.0) / F.size(arr))   # a document without tokens: the prior's mean
    total = F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    return (model.transform(vec).select(key, F.when(total > 0, arr).otherwise(even).alias("theta"))
            .withColumn("dominant_topic", (F.array_position("theta", F.array_max("theta")) - 1).cast("int")))


def perplexity(model, vec: DataFrame) -> DataFrame:                              # TOP7
    spark = vec.sparkSession
    ll = float(model.logLikelihood(vec))                      # one pass of inference gives all three
    words = vec.select(F.sum(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda s, x: s + x))).first()[0]
    lp = -ll / words if words else float("nan")
    return spark.createDataFrame([(lp, -lp, ll)], "log_perplexity double, per_word_bound double, log_likelihood double")


def unigram_topic(docs: DataFrame, tokens: str, n: int = 20) -> DataFrame:
    """K=1: the single topic is the corpus unigram distribution (Spark's LDA
    refuses k=1)."""
    counts = docs.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c")).first()[0] or 1
    top = counts.orderBy(F.desc("c"), F.asc("term")).limit(n)
    return top.select(F.lit(0).alias("topic"),
                      (F.row_number().over(Window.orderBy(F.desc("c"), F.asc("term"))) - 1).alias("rank"),
                      "term", (F.col("c") / F.lit(float(total))).alias("weight"))


# ---------------------------------------------------------------- coherence c_v
def coherence_cv(docs: DataFrame, key: str, tokens: str, topics: DataFrame, window: int = 110) -> DataFrame:
    """c_v coherence (boolean sliding window of ``window`` tokens, NPMI
    context vectors, cosine against the topic's summed vector, mean).

    ``topics(topic, term)`` holds the top words of each topic (K x N rows, read on the driver).  How many windows hold a
    word, and both words of a same-topic pair, is counted by ``windows.window_counts``: only the places of topic words
    are shuffled.  Documents without any topic word add no windows.
    """
    topics = cut_lineage(topics)
    words: dict = {}
    for r in topics.select("topic", "term").collect():
        words.setdefault(r["topic"], []).extend([] if r["term"] is None else [r["term"]])
    counts = cut_lineage(window_counts(docs, key, tokens, list(words.values()), window))
    n_windows = F.coalesce(counts.where("wi IS NULL").agg(F.sum("n").cast("double")).scalar(), F.lit(0.0))
    single = counts.where("wi IS NOT NULL AND wj IS NULL").select(F.col("wi").alias("w"), F.col("n").alias("cnt"))
    pair = counts.where("wj IS NOT NULL").select("wi", "wj", F.col("n").alias("co"))
    eps = 1e-12
    # NPMI for every ordered pair of topic words of the same topic
    tp = topics.select("topic", F.col("term").alias("wi")).join(
        topics.select("topic", F.col("term").alias("wj")), "topic")
    tp = (tp.join(single.select(F.col("w").alias("wi"), F.col("cnt").alias("ci")), "wi", "left")
          .join(single.select(F.col("w").alias("wj"), F.col("cnt").alias("cj")), "wj", "left")
          .join(pair.select(F.col("wi").alias("_a"), F.col("wj").alias("_b"), "co"),
                (F.least("wi", "wj") == F.col("_a")) & (F.greatest("wi", "wj") == F.col("_b")), "left")
          .withColumn("N", n_windows))
    ci, cj = F.coalesce("ci", F.lit(0)), F.coalesce("cj", F.lit(0))
    co = F.when(F.col("wi") == F.col("wj"), ci).otherwise(F.coalesce("co", F.lit(0)))
    # a word that no document holds has no windows: its scores are defined as 0
    pij = F.coalesce(F.try_divide(co, F.col("N")), F.lit(0.0))
    joint = F.try_divide(ci, F.col("N")) * F.try_divide(cj, F.col("N"))
    npmi = F.try_divide(F.log(F.try_divide(pij + eps, joint)), -F.log(pij + eps))
    tp = tp.withColumn("npmi", F.coalesce(npmi, F.lit(0.0)))
    # context vectors: v_i[j] = npmi(i, j); v*[j] = sum_i npmi(i, j)
    star = tp.groupBy("topic", "wj").agg(F.sum("npmi").alias("s"))
    vec = tp.join(star, ["topic", "wj"])
    cos = (vec.groupBy("topic", "wi")
           .agg(F.coalesce(F.try_divide(
               F.sum(F.col("npmi") * F.col("s")),
               F.sqrt(F.sum(F.col("npmi") * F.col("npmi"))) * F.sqrt(F.sum(F.col("s") * F.col("s")))),
               F.lit(0.0)).alias("cos")))
    per_topic = cos.groupBy("topic").agg(F.avg("cos").alias("coherence"))
    return per_topic


def coherence_summary(per_topic: DataFrame) -> DataFrame:
    return per_topic.agg(F.avg("coherence").alias("coherence"))


# ---------------------------------------------------------------- overview (TOP10)
def topic_overview(theta: DataFrame, doc_len: DataFrame, key: str, phi: DataFrame, term_freq: DataFrame,
                   lam: float = 0.6, top: int = 30):
    """Tables behind an interactive topic view.

    ``theta(key, theta array)``, ``doc_len(key, n)``, ``phi(topic, term,
    weight)`` (normalised topic-term weights), ``term_freq(term, freq)``.
    Returns (prevalence, relevance top terms, inter-topic distances)."""
    t = theta.join(doc_len, key).select(F.posexplode("theta").alias("topic", "p"), "n")
    prevalence = (t.groupBy("topic").agg(F.sum(F.col("p") * F.col("n")).alias("mass"))
                  .withColumn("prevalence", F.col("mass") / F.sum("mass").over(Window.partitionBy())))
    total = term_freq.agg(F.sum("freq").cast("double")).scalar()
    pw = term_freq.select("term", (F.col("freq") / total).alias("pw"))
    rel = (phi.join(pw, "term")
           .withColumn("relevance", lam * F.log("weight") + (1 - lam) * F.log(F.col("weight") / F.col("pw"))))
    rel = rel.withColumn("rank", F.row_number().over(
        Window.partitionBy("topic").orderBy(F.desc("relevance"), F.asc("term")))).where(F.col("rank") <= top)
    a = phi.select(F.col("topic").alias("ta"), "term", F.col("weight").alias("pa"))
    b = phi.select(F.col("topic").alias("tb"), "term", F.col("weight").alias("pb"))
    m = a.join(b, "term").where(F.col("ta") < F.col("tb"))
    mid = (F.col("pa") + F.col("pb")) / 2
    js = (m.groupBy("ta", "tb")
          .agg((0.5 * F.sum(F.col("pa") * F.log(F.col("pa") / mid)) +
                0.5 * F.sum(F.col("pb") * F.log(F.col("pb") / mid))).alias("js_divergence")))
    return prevalence.select("topic", "prevalence"), rel, js
