"""Language identification (CLN10) and translation routing (CLN11-12).

Language id is a Spark ML job: character trigrams of the whole text,
hashed (``HashingTF``, fixed feature size), classified by multinomial
``NaiveBayes`` trained on labelled text (``documents(text, lang)``); its
probabilities are calibrated by a temperature fitted on held-out text.
Translation is a lookup in a translation memory ``(text, translated)`` joined
on the text itself; English text never enters the join, and text without an
entry passes through.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import NaiveBayes, NaiveBayesModel
from pyspark.ml.feature import HashingTF, IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def char_trigrams(text: Column) -> Column:
    """Overlapping character trigrams of the lower-cased text, found in one
    linear regex pass: a zero-width look-ahead captures each 3-character
    window.  Texts shorter than 3 characters give themselves."""
    x = F.lower(text)
    grams = F.regexp_extract_all(x, F.lit(r"(?s)(?=(.{3}))"), 1)
    return F.when(F.length(x) >= 3, grams).otherwise(F.array(x))


class LanguageModel(NamedTuple):
    features: HashingTF
    bayes: NaiveBayesModel
    labels: list[str]
    temperature: float = 1.0


def train_language_model(labelled: DataFrame, text: str = "text", label: str = "lang",
                         features: int = 1 << 16, smoothing: float = 1.0, held_out: DataFrame | None = None) -> LanguageModel:
    """Naive Bayes on trigrams; with ``held_out`` (same columns) its probabilities are calibrated there."""
    data = labelled.select(char_trigrams(F.col(text)).alias("grams"), F.col(label).alias("lang"))
    idx = StringIndexer(inputCol="lang", outputCol="label", handleInvalid="skip").fit(data)
    tf = HashingTF(inputCol="grams", outputCol="features", numFeatures=features)
    nb = NaiveBayes(modelType="multinomial", smoothing=smoothing).fit(tf.transform(idx.transform(data)))
    model = LanguageModel(tf, nb, list(idx.labels))
    return model if held_out is None else model._replace(temperature=fit_temperature(model, held_out, text, label))


def _scored(df: DataFrame, model: LanguageModel, text: str) -> DataFrame:
    """``_raw``: log likelihoods of the labels, the largest shifted to 0."""
    grams = df.withColumn("grams", char_trigrams(F.coalesce(F.col(text), F.lit(""))))
    raw = vector_to_array("rawPrediction")
    out = model.bayes.transform(model.features.transform(grams)).withColumn("_raw", raw)
    shifted = F.transform("_raw", lambda x: x - F.array_max("_raw"))
    return out.withColumn("_raw", shifted).drop("grams", "features", "rawPrediction", "probability")


def _log_total(temperature: float) -> Column:
    return F.log(F.aggregate("_raw", F.lit(0.0), lambda s, x: s + F.exp(x / temperature)))


def fit_temperature(model: LanguageModel, held_out: DataFrame, text: str = "text", label: str = "lang") -> float:
    """Naive Bayes multiplies trigrams as if they were independent, so its probabilities of long texts are all but 1.  Dividing the log
    likelihoods by one temperature keeps the order of the labels; the one with the best likelihood on texts the model has not
    seen is taken from a fixed geometric grid, in one aggregation."""
    grid = [round(1.25 ** k, 6) for k in range(48)]
    known = _scored(held_out, model, text).withColumn("_at", F.array_position(F.lit(model.labels), F.col(label)))
    own = F.element_at("_raw", F.col("_at").cast("int"))
    loss = (known.where(F.col("_at") > 0)
            .agg(*[F.avg(_log_total(t) - own / t).alias(f"t{k}") for k, t in enumerate(grid)]).first())
    return min((x, t) for x, t in zip(loss, grid))[1] if loss[0] is not None else 1.0


def identify_language(df: DataFrame, model: LanguageModel, text: str = "text_raw", out: str = "lang",
                      probability: str | None = None) -> DataFrame:
    """Adds the label, and its calibrated probability if a column is named for it.  A null text counts as empty."""
    scored = _scored(df, model, text)
    scored = IndexToString(inputCol="prediction", outputCol=out, labels=model.labels).transform(scored)
    if probability:
        scored = scored.withColumn(probability, F.exp(-_log_total(model.temperature)))
    return scored.drop("_raw", "prediction")


def route_by_confidence(lang: Column, probability: Column, least: float = 0.9) -> Column:
    """The label that decides about translation: a text that is not surely English counts as foreign, so that it is
    looked up rather than passed."""
    return F.when((lang == "en") & (probability < least), F.lit("unsure")).otherwise(lang)


def translate_with_memory(df: DataFrame, memory: DataFrame, text: str = "text_raw", lang: str = "lang",
                          out: str = "text_en") -> DataFrame:
    """CLN11-12: English text stays; other text is replaced by its entry in
    ``memory(text, translated)`` when there is one (several: the smallest).

    The memory grows with the corpus, so this is a shuffle join on the SHA-256
    of the text, tested on the text itself; English rows stay out of it."""
    key = F.sha2(F.col(text), 256)
    mem = (memory.where(F.col("text").isNotNull() & F.col("translated").isNotNull())
           .groupBy(F.sha2("text", 256).alias("_mh"), F.col("text").alias("_mt")).agg(F.min("translated").alias("_tr")))
    english = df.where(F.coalesce(F.col(lang) == "en", F.lit(False)))
    other = df.where(~F.coalesce(F.col(lang) == "en", F.lit(False))).withColumn("_h", key)
    found = (other.join(mem, (F.col("_h") == F.col("_mh")) & (F.col(text) == F.col("_mt")), "left")
             .withColumn(out, F.coalesce("_tr", F.col(text))).drop("_h", "_mh", "_mt", "_tr"))
    return english.withColumn(out, F.col(text)).unionByName(found)
