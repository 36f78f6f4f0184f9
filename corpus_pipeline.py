"""A corpus pipeline over ``documents``: toxicity, line de-duplication, near-duplicate
removal, benchmark decontamination, tokenisation.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame, which is written as Parquet and read again as the next stage's ``docs``.  All stages but
the last return the columns of their input.  A stage that judges documents by themselves sends each row through Python
once, the text inside the row; near-duplicate removal writes the keys (id, text hash) of the rows that go and anti-joins them.

Defined cases, for every stage: an empty input gives an empty result; a null text counts as empty
and stays null if the stage keeps the row unchanged; extra columns, whatever their names, are
carried along; repeated rows are judged alike (near-duplicate removal keeps one of them).  Rows
without an id are never removed as near duplicates, since the row that stays could not be named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.llm import decontaminate, jaccard, line_dedup, spm, toxicity
from opinio.llm.common import cut_lineage, shared_folder, written
from opinio.llm.registry import SENTENCEPIECE, tokenizer_path
from opinio.sources.tables import table

#: Not expressible in SQL (a trained model); tested against a brute-force version.
ORACLE_SQL = None


def _row(docs: DataFrame):
    """The carried row's columns."""
    return [F.col("row").getField(c).alias(c) for c in docs.columns]


def _hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _matched(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows (anti: without those) whose (id, text hash) is in ``keys(of_doc, of_hash)``."""
    return docs.join(keys, docs["doc_id"].eqNullSafe(keys["of_doc"]) & (_hash() == keys["of_hash"]), how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents with a toxicity score of at least one half go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, model, carry=True).where(F.col("score") < 0.5).select(*_row(docs))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: long lines found in five or more documents stay only in the largest id that has
    them; ``n_chars`` follows the text."""
    empty = "text is null"
    others = [c for c in docs.columns if c != "text"]         # the text itself goes along once
    kept = line_dedup.dedup_lines(docs.withColumn(empty, F.col("text").isNull()), carry=[*others, empty])
    cut, of = F.col("n_dropped") > 0, F.col("row").getField
    changed = {"text": F.when(cut | ~of(empty), F.col("text")),
               "n_chars": F.when(cut, F.length("text").cast("long")).otherwise(of("n_chars"))}
    return kept.select(*[changed[c].alias(c) if c in changed else of(c).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of every group of linked documents the one with the smallest id stays.
    Groups are told apart by their label, since unlike texts may have the same smallest id."""
    found = jaccard.near_duplicates(docs, with_label=True)
    found = found.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    keys = cut_lineage(found.groupBy("label", "component_id", "doc_id", "text_hash").agg(F.count("*").alias("copies")))
    stays = (keys.where(F.col("doc_id") == F.col("component_id")).groupBy("label")
             .agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).select(F.col("label").alias("of_label"), "one"))
    keys = keys.join(stays, F.col("label").eqNullSafe(F.col("of_label")))
    one = F.struct("doc_id", "text_hash") == F.col("one")
    named = [F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_hash")]
    gone = written(keys.where(~one | (F.col("copies") > 1)).select(*named), "near-gone")
    again = written(keys.where(one & (F.col("copies") > 1)).select(*named), "near-again")
    # of a row that is repeated, one comes back
    key = F.struct(F.col("doc_id"), _hash())
    back = _matched(docs, again, "left_semi").withColumn("_key of row", key).dropDuplicates(["_key of row"]).drop("_key of row")
    return _matched(docs, gone, "left_anti").unionByName(back)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents with at least one word in twenty inside a benchmark window go."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return found.where(~F.col("contaminated")).select(*_row(docs))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: ids of every text, and the text decoded from them."""
    out = spm.encode_texts(docs, tokenizer_path(SENTENCEPIECE), with_text=True, carry=["lang", "source"])
    return out.select("doc_id", F.col("row").getField("lang").alias("lang"), F.col("row").getField("source").alias("source"),
                      F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("text").alias("decoded"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written to the shared folder."""
    folder = shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
