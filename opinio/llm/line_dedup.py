"""Line de-duplication over levelled sorted runs of line hashes.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z
lower-cased.  Only keys of at least ``min_chars`` code points take part.  Keys
found in at least ``min_docs`` documents lose all their lines except in the
largest document id that holds them.

``LineRuns`` keeps what is known of the keys as runs: tables bucketed and
sorted by the 128-bit key hash, on shared storage.  A batch of documents is
aggregated to one row per key, merge-joined with the runs, which marks the keys
that no run holds as ``fresh``, and written once as a new run of the lowest level.
Whenever a level holds ``fanout`` runs, they are merged into one run of
the next level, so a key is looked up in a logarithmic number of runs.  Runs
and batches have the same buckets, so these joins need no exchange of the runs.

DataFrame functions only: no Python code runs on the executors.

Defined cases: a null or empty text is one empty line; repeated rows of one
document id are one document (each row is returned); a null document id is one
document, smaller than all others; a very long text, with however many lines, is split in its row; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, cut_lineage, narrow, shared_folder

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
_STRIP = " \t\n\x0b\x0c\r"
_KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(_STRIP)), UPPER, UPPER.lower())


#: Lets the reader of a bucketed table rely on the order of its files, if there is one file per bucket.
_FILE_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def files_in_order(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_FILE_ORDER, None)
    spark.conf.set(_FILE_ORDER, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FILE_ORDER)
        else:
            spark.conf.set(_FILE_ORDER, before)


class Run(NamedTuple):
    rows: DataFrame                                          # the fresh keys; bucketed and sorted, one file per bucket
    path: str


class LineRuns:
    """The runs: ``h1, h2, n_docs, last`` (documents holding the key, largest id), ``fresh`` (no earlier run holds it)."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int, fanout: int = 2):
        self.spark, self.folder, self.buckets, self.fanout = spark, folder, buckets, fanout
        self.levels: list[list[Run]] = [[]]                  # a key is fresh in one run only

    def _run(self, rows: DataFrame) -> Run:
        """Write a sorted run of rows that are dealt by key; the table entry only carries the bucketing to the reader."""
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        with files_in_order(self.spark):
            (rows.write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY)
             .option("path", path).format("parquet").saveAsTable(name))
        run = self.spark.table(name)
        run.schema                                           # resolve before the entry goes; files stay
        self.spark.sql(f"DROP TABLE {name}")
        return Run(run.where("fresh"), path)

    def _all(self, runs: list[Run]) -> DataFrame:
        """Several runs as one table.  Read as plain files: a union of bucketed tables claims to be
        distributed by key (Spark 4.1), and an aggregate over it would not bring a key's rows together."""
        return self.spark.read.schema(runs[0].rows.schema).parquet(*[r.path for r in runs])

    def add(self, keys: DataFrame) -> None:
        """Add a batch: ``h1, h2, doc_id`` rows of documents that no earlier batch held."""
        one_each = keys.select(*_KEY, "doc_id").distinct()     # spreads a hot line over its documents
        counted = one_each.groupBy(*_KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last"))
        known = [r for level in self.levels for r in level]
        self.levels[0].append(self._run(self._marked(self._by_bucket(counted), known)))
        self._compact()

    def _by_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, *_KEY)

    @staticmethod
    def _marked(rows: DataFrame, known: list[Run]) -> DataFrame:
        """The rows of a batch, ``fresh`` if their key is in none of the runs."""
        fresh = F.lit(True)
        for k, run in enumerate(known):
            of = run.rows.select(F.col("h1").alias(f"a{k}"), F.col("h2").alias(f"b{k}")).hint("merge")
            rows = rows.join(of, (F.col("h1") == F.col(f"a{k}")) & (F.col("h2") == F.col(f"b{k}")), "left")
            fresh = fresh & F.col(f"a{k}").isNull()
        return rows.select(*_KEY, "n_docs", "last", fresh.alias("fresh"))

    @classmethod
    def unseen(cls, batch: Run, known: list[Run]) -> DataFrame:
        """The rows of a run whose key is in none of the others."""
        return cls._marked(batch.rows, known).where("fresh")

    def _compact(self) -> None:
        k = 0
        while k < len(self.levels):
            if len(self.levels[k]) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                merged = _total(self._by_bucket(self._all(self.levels[k])), F.max("fresh").alias("fresh"))
                self.levels[k + 1].append(self._run(merged))
                self.levels[k] = []
            k += 1

    def totals(self) -> DataFrame:
        """One row per key over all batches."""
        return _total(self._all([r for level in self.levels for r in level]))


def _total(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.groupBy(*_KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last").alias("last"), *more)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS, batches: int = BATCHES, carry: bool | list[str] = False) -> DataFrame:
    """``doc_id, text`` (kept lines), ``n_lines, n_dropped`` (and the input row, if carried): one row per input row.

    ``batches`` deals the documents by id into that many batches, which together are all of them."""
    spark = docs.sparkSession
    rows = narrow(docs, id_col, text_col, carry).withColumn("th", F.xxhash64("text"))

    def keys(of: DataFrame, *more: str) -> DataFrame:
        # the keys are made in the array, once a line; made after the split, every use of a key would make it again
        keyed = F.transform(F.split("text", "\n"), line_key)
        return (of.select("doc_id", *more, F.posexplode(keyed).alias("pos", "key")).where(F.length("key") >= min_chars)
                .select("doc_id", *more, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(40), F.col("key")).alias("h2")))

    source = narrow(docs, id_col, text_col)
    runs = LineRuns(spark, shared_folder(spark, "line-runs"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    for k in range(batches):
        runs.add(keys(source.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k)).select(*_KEY, "doc_id"))
    # written, so that the join below exchanges both sides and can split the lines of a hot key
    common = cut_lineage(runs.totals().where(F.col("n_docs") >= min_docs).select(*_KEY, "last"))
    lines = keys(source.withColumn("th", F.xxhash64("text")), "th")

    # (doc_id, th) names a row; of rows that repeat, both lose the same lines
    gone = (lines.join(common, _KEY).where(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("last")))
            .groupBy(F.col("doc_id").alias("of_doc"), F.col("th").alias("of_th"))
            .agg(F.array_sort(F.collect_set("pos")).alias("gone")))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("th") == F.col("of_th")), "left")
    none = F.array().cast("array<int>")
    row = ["row"] if carry else []
    return joined.select("doc_id", *row, F.struct(F.split("text", "\n").alias("lines"),
                                            F.coalesce("gone", none).alias("gone")).alias("x")) \
        .select("doc_id", _kept(F.col("x")).alias("text"), F.size("x.lines").cast("long").alias("n_lines"),
                F.size("x.gone").cast("long").alias("n_dropped"), *row)


def _kept(x: Column) -> Column:
    """The lines between the dropped positions, joined; linear in the lines.  The outer ``transform``
    binds the split text once for the inner lambdas."""
    def cut(y: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(y["gone"], lambda p: p + 1))
        ends = F.concat(y["gone"], F.array(F.size(y["lines"])))
        pieces = F.zip_with(starts, ends, lambda a, b: F.slice(y["lines"], a + 1, b - a))
        return F.array_join(F.flatten(pieces), "\n")
    return F.element_at(F.transform(F.array(x), cut), 1)
