"""Topic-model text cleaning: the dictionary step (TXT6, TXT6b) and the
whole chain (TXT8).

TXT6 keeps a word only if the spelling dictionary knows it; unknown words
become empty strings (so ``a xx b`` -> ``a  b`` until spaces are
collapsed).  A dictionary of bounded size is looked up in the row
(``operators.lookup``); a larger one is a join, not a literal: words are exploded with their position on a narrow (key, pos, word)
projection, left-joined to the dictionary (broadcast only when its size is
checked), and rebuilt in order per document.  When the input is
hash-partitioned by the key (the cleaned reviews are), the regrouping and
the join back add no exchange; each group is one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinio.functions import text as TX
from opinio.operators.lookup import word_lookup, word_replacer
from opinio.sources.sinks import written


def dictionary_from_text(df: DataFrame, text: str = "text") -> DataFrame:
    """A word list derived from a text column: distinct lower-case letter runs."""
    words = df.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), 0)).alias("word"))
    return words.distinct()


def keep_dictionary_words(df: DataFrame, key: str, text: str, dictionary: DataFrame,
                          out: str | None = None, case_sensitive: bool = False) -> DataFrame:
    """TXT6: every whitespace word not in ``dictionary(word)`` becomes ''."""
    out = out or text
    d = dictionary.select((F.col("word") if case_sensitive else F.lower("word")).alias("_dw")).distinct()
    known = word_lookup(d, "_dw", "_dw")
    if known is not None:
        kept = F.transform(TX.split_words(F.col(text)), lambda w: F.when(
            known(w if case_sensitive else F.lower(w)).isNotNull(), w).otherwise(F.lit("")))
        return df.withColumn(out, F.coalesce(F.array_join(kept, " "), F.lit("")))
    words = df.select(F.col(key).alias("_k"), F.posexplode(TX.split_words(F.col(text))).alias("pos", "w"))
    d = d.withColumn("_ok", F.lit(True))                      # AQE broadcasts it if its measured size allows
    probe = F.col("w") if case_sensitive else F.lower("w")
    kept = (words.join(d, probe == F.col("_dw"), "left")
            .select("_k", "pos", F.when(F.col("_ok"), F.col("w")).otherwise(F.lit("")).alias("w")))
    rebuilt = (kept.groupBy("_k")
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))),
                                             lambda s: s["w"]), " ").alias("_rebuilt")))
    res = df.join(rebuilt, df[key] == rebuilt["_k"], "left")
    return res.withColumn(out, F.coalesce(F.col("_rebuilt"), F.lit(""))).drop("_k", "_rebuilt")


def _deletions(w: Column, k: int) -> Column:
    """The word and every string obtained from it by up to ``k`` deletions."""
    def one(x):
        return F.array_union(F.array(x), F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))),
                                                     lambda i: F.concat(F.substring(x, F.lit(1), i - 1),
                                                                        F.substring(x, i + 1, F.length(x)))))
    arr = F.array(w)
    for _ in range(k):
        arr = F.array_distinct(F.flatten(F.transform(arr, one)))
    return arr


def dictionary_with_frequency(df: DataFrame, text: str = "text") -> DataFrame:
    """``word, freq``: the lower-case letter runs of a text column and how often they occur."""
    words = df.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), 0)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def best_suggestions(words: DataFrame, dictionary: DataFrame, max_distance: int = 2) -> DataFrame:
    """TXT6b (option): for each distinct unknown word the closest dictionary
    word by edit distance <= ``max_distance`` (ties: more frequent, then
    smaller).  Exact candidate generation by deletion neighbourhoods: two
    words within distance k share a string reachable by <= k deletions
    from each, so an equi-join on those strings finds every candidate
    without an all-pairs product; ``levenshtein`` then verifies.  A word more than
    ``max_distance`` longer than the longest dictionary word has no candidate, so long junk
    is never expanded.  ``words(word)``; ``dictionary(word[, freq])``."""
    u, best = _unknown_and_best(words, dictionary, max_distance)
    return u.join(best, "word", "left")                       # no candidate: a null suggestion


def _unknown_and_best(words: DataFrame, dictionary: DataFrame, max_distance: int) -> tuple[DataFrame, DataFrame]:
    """``word``: the distinct unknown words; ``word, suggestion``: those that have one."""
    d = (dictionary.select(F.lower("word").alias("cand"),
                           (F.col("freq") if "freq" in dictionary.columns else F.lit(0)).alias("freq"))
         .groupBy("cand").agg(F.max("freq").alias("freq")))
    u = (words.select(F.lower("word").alias("word")).distinct()
         .join(d.select(F.col("cand").alias("word")), "word", "left_anti"))
    longest = d.agg(F.max(F.length("cand"))).scalar()
    uv = (u.where(F.length("word") <= longest + max_distance)
          .select("word", F.explode(_deletions(F.col("word"), max_distance)).alias("v")))
    dv = d.select("cand", "freq", F.explode(_deletions(F.col("cand"), max_distance)).alias("v"))
    pairs = (uv.join(dv, "v").select("word", "cand", "freq").distinct()
             .withColumn("dist", F.levenshtein("word", "cand", max_distance))
             .where(F.col("dist") >= 0))
    return u, pairs.groupBy("word").agg(F.min_by("cand", F.struct("dist", -F.col("freq"), "cand")).alias("suggestion"))


def correct_words(df: DataFrame, key: str, text: str, dictionary: DataFrame, max_distance: int = 2,
                  out: str | None = None, pattern: str | None = None) -> DataFrame:
    """TXT6b in a text: every word that the dictionary does not know becomes its best suggestion, in place; known
    words, words without a suggestion and words that do not match ``pattern`` (if given) stay as they are.

    Only distinct unknown words are looked up, once: the corrections are written.  They meet the words in the row, or by an
    equi-join if they are too many for that."""
    asked = df.select(F.explode(TX.split_words(F.col(text))).alias("w")).select(F.lower("w").alias("word"))
    if pattern:
        asked = asked.where(F.col("word").rlike(pattern))
    into = written(_unknown_and_best(asked, dictionary, max_distance)[1].where(F.col("suggestion").isNotNull()), "corrections")
    better = word_lookup(into, "word", "suggestion")
    replace = word_replacer(into, "word", "suggestion") if better is None else None
    if better is not None or replace is not None:
        split = TX.split_words(F.col(text))
        fixed = (replace(split, F.transform(split, lambda w: F.lower(w))) if better is None
                 else F.transform(split, lambda w: F.coalesce(better(F.lower(w)), w)))
        return df.withColumn(out or text, F.coalesce(F.array_join(fixed, " "), F.lit("")))
    words = df.select(F.col(key).alias("_k"), F.posexplode(TX.split_words(F.col(text))).alias("pos", "w"))
    fixed = (words.join(into, F.lower("w") == F.col("word"), "left")
             .select("_k", "pos", F.coalesce("suggestion", "w").alias("w")))
    rebuilt = (fixed.groupBy("_k")
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda s: s["w"]), " ")
                    .alias("_rebuilt")))
    res = df.join(rebuilt, df[key] == rebuilt["_k"], "left")
    return res.withColumn(out or text, F.coalesce("_rebuilt", F.lit(""))).drop("_k", "_rebuilt")


def clean_chain(df: DataFrame, key: str, text: str, stop_words: list[str], dictionary: DataFrame | None = None,
                order: str = "reference", out: str = "text_topic", spelling: str = "drop", pattern: str | None = None) -> DataFrame:
    """TXT8 in the reference order: punctuation, mentions, URLs, numbers,
    stop words, dictionary words, whitespace.  ``spelling``: ``drop`` deletes words that the
    dictionary does not know (TXT6), ``correct`` replaces them (TXT6b)."""
    if dictionary is not None and spelling != "correct":
        known = word_lookup(dictionary.select(F.lower("word").alias("_dw")).distinct(), "_dw", "_dw", known=True)
        if known is not None:                                 # the words of the steps are filtered, not joined and split again
            kept = F.filter(TX.clean_words(F.col(text), stop_words, order), lambda w: known(F.lower(w)))
            return df.withColumn(out, F.coalesce(F.array_join(kept, " "), F.lit("")))
    df = df.withColumn(out, TX.clean_steps(F.col(text), stop_words, order))
    if dictionary is not None:
        df = (correct_words(df, key, out, dictionary, pattern=pattern) if spelling == "correct"
              else keep_dictionary_words(df, key, out, dictionary))
    return df.withColumn(out, TX.collapse_spaces(F.col(out)))
