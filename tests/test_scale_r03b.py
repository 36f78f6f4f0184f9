"""Findings of round 3 on size: what a query costs follows the input, not the number of partitions."""

import pytest
from pyspark.sql import functions as F


@pytest.fixture
def many_partitions(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_merkle_levels_do_not_add_up_partitions(many_partitions):
    """op12_merkle: the node rows of all levels are read by few tasks, however many wrote them."""
    from opinio.llm.merkle import _levels
    nodes = many_partitions.range(700).select(F.lit("t").alias("tree"), F.col("id").alias("pos"), F.lit(700).cast("long").alias("n"),
                                              F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    roots, links = _levels(nodes, 700, 4, 0)
    assert roots.count() == 1 and links.count() == 700 + 175 + 44 + 11 + 3
    assert links.rdd.getNumPartitions() < 5 * 32


def test_lda_terms_are_not_shuffled_against_the_bag(spark):
    """top04 to top10c: the term table is written, so the planner knows that a small one need not be shuffled."""
    from opinio.operators import topics as TP
    docs = spark.createDataFrame([(f"d{i}", ["wort", f"w{i % 7}", "wort"]) for i in range(60)], "doc string, tokens array<string>")
    terms, vec = TP.vectorize(docs)
    assert terms.inputFiles() and terms.count() == 8
    assert "BroadcastHashJoin" in terms.join(docs.select(TP.F.explode("tokens").alias("token")), "token")._jdf.queryExecution().executedPlan().toString()
    assert {r.features.numNonzeros() for r in vec.collect()} == {2}


def test_shingle_buckets_grow_with_the_shingles(spark):
    """F1, op6_jaccard_join: prefixes need buckets that tell rare shingles from frequent ones at every size."""
    import numpy as np
    from opinio.llm import jaccard as J
    at_6_gb = 150_000_000                                     # eligible shingles: 12,886,732 on 0.51 GB
    assert at_6_gb / 2 ** J.bucket_bits(at_6_gb) < 10 and J.bucket_bits(10 ** 12) == J.MOST_BITS
    docs = spark.createDataFrame([(f"a{i} b{i} c{i} d{i} e{i} f{i}",) for i in range(2000)], "text string")
    few, many = (J._frequencies(docs, 5, total) for total in (4000, 1 << 26))
    assert len(many) == 16 * len(few) and few.sum() == many.sum() == 4000
    frequent = spark.range(70_000).select(F.lit("one").alias("text"))
    assert J._frequencies(frequent, 5, 70_000).max() == np.iinfo(np.uint16).max     # held there, not started anew
    shingles = np.sort(np.array([1 << 60, (1 << 60) + (1 << 41), 3 << 60, 5 << 60], dtype=np.uint64))
    freq = np.zeros(1 << 24, np.uint16)
    freq[(shingles >> np.uint64(40)).astype(np.int64)] = [900, 1, 900, 900]         # the second shares 20 bits with the first
    assert J.prefix(shingles, freq, 100).tolist() == [int(shingles[1])]
