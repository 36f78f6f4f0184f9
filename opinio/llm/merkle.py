"""Merkle manifest of a dataset, and proofs that are checked by a recursive climb.

``H`` is the lowercase hex SHA-256 of its inputs, concatenated; digests go in as hex text.  A row is a
leaf: H of its fields, ``-`` for a null and else the UTF-8 byte count, ``:`` and the value.  Each group
(``group_col``) is a tree: leaves in id order; while several nodes remain, every ``arity`` consecutive
ones become their H (the last run may be shorter, even one).  What remains is the group's subroot; the
subroots in group order (null first, then UTF-8 bytewise) are the leaves of the top tree, its remains the root.

Building goes level by level: one grouped aggregation each, ``arity`` rows a group, and every level is
written as node rows linked to their parent, with the hashes of their siblings to the left and right.
A leaf's place in its group comes from a range-partitioned sort and offsets by partition, so that the
largest group is never in one task.

Proofs: a recursive query starts from the lowest runs (up to ``arity`` leaves that share all that is above
them) and joins the node rows once a level.  It appends the siblings met and folds each leaf's hash, for
``tampered`` leaves that of the tampered row, with the siblings as they were built.  A climb that ends in
another hash than the root exposes the row.  A run's row holds at most ``arity`` digests and
``arity - 1`` siblings a level, however large the table is.  (Spark limits the rows of a recursive query to a
million by default; the limit is lifted while this one runs and put back.)

Defined cases: nulls in any field are leaves like others; a null group is a group of its own; rows with a null id
come first and are never tampered with; rows of one id follow each other in leaf order; repeated rows
are leaves each; an empty text has byte count 0; long texts are hashed whole, inside one row;
an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, written

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def field(value: Column) -> Column:
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def tampered(id_col: str = "doc_id") -> Column:
    """One row in five, by the checksum of its decimal id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def leaves(docs: DataFrame, fields=FIELDS, id_col: str = "doc_id", group_col: str = "source",
           text_col: str = "text") -> DataFrame:
    """``tree, doc_id, leaf, claimed``: the row's leaf, and the leaf of the row as it is shown to the check."""
    lowered = F.translate(F.col(f"`{text_col}`"), UPPER, UPPER.lower())
    shown = [F.when(tampered(id_col), lowered).otherwise(F.col(f"`{c}`")) if c == text_col else F.col(f"`{c}`") for c in fields]
    group = F.col(f"`{group_col}`").cast("string")
    return docs.select(F.coalesce(F.concat(F.lit("s"), group), F.lit("n")).alias("tree"), F.col(f"`{id_col}`").alias("doc_id"),
                       leaf_hash([F.col(f"`{c}`") for c in fields]).alias("leaf"), leaf_hash(shown).alias("claimed"))


def _kept(rows: DataFrame) -> DataFrame:
    """The rows, written and read back: small files are read many to a task, and the planner knows what is small.  (A
    checkpoint keeps a partition for each that was written, and a union of levels the partitions of all.)"""
    return written(rows, "merkle")


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """``pos``: the 0-based place of each row in its ``tree``, in the order ``by``; ``n``: the tree's rows.
    Rows are dealt by ranges of (tree, by) and written, which fixes the partitions; what has to be summed up in one
    place is one row per tree and partition that holds some of it."""
    dealt = _kept(_kept(rows).repartitionByRange("tree", *by).sortWithinPartitions("tree", *by)
                        .withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()))
    held = dealt.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    before = Window.partitionBy("tree").orderBy("part")
    held = held.select("tree", "part", "first", (F.sum("rows").over(before) - F.col("rows")).alias("before"),
                       F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    return (dealt.join(held, ["tree", "part"]).withColumn("pos", F.col("before") + F.col("place") - F.col("first"))
            .drop("part", "place", "first", "before"))


def _runs(nodes: DataFrame, arity: int, *more: str) -> DataFrame:
    """One row per run of consecutive nodes: ``tree, run, n`` and the sorted ``items``."""
    return (nodes.groupBy("tree", "n", F.floor(F.col("pos") / arity).alias("run"))
            .agg(F.array_sort(F.collect_list(F.struct("pos", *more))).alias("items")))


def _others(hashes: Column, k: Column) -> Column:
    """All but the k-th (0-based), joined."""
    return F.array_join(F.filter(hashes, lambda _, i: i != k), "")


def _replaced(hashes: Column, k: Column, by: Column) -> Column:
    return F.sha2(F.array_join(F.transform(hashes, lambda h, i: F.when(i == k, by).otherwise(h)), ""), 256)


def _levels(nodes: DataFrame, most: int, arity: int, first: int) -> tuple[DataFrame, DataFrame | None]:
    """From ``tree, pos, n, hash`` of the nodes of level ``first``: the remaining node of every tree (``tree, level,
    hash``) and the linked node rows (``tree, level, pos, up_level, up_pos, left, right``) of all nodes with siblings above
    or beside them."""
    roots, links, level = None, None, first
    while True:
        done = nodes.where("n = 1").select("tree", F.lit(level).alias("level"), "hash")
        roots = done if roots is None else roots.unionByName(done)
        if most <= 1:
            return roots, links
        runs = _kept(_runs(nodes.where("n > 1"), arity, "hash")
                           .select("tree", "n", "run", F.transform("items", lambda x: x["hash"]).alias("hashes")))
        parted = runs.select("tree", "run", F.explode(F.transform("hashes", lambda _, i: F.struct(
            i.alias("k"), F.array_join(F.slice("hashes", 1, i), "").alias("left"),
            F.array_join(F.slice("hashes", i + 2, arity), "").alias("right")))).alias("x"))
        rows = parted.select("tree", F.lit(level).alias("level"), (F.col("run") * arity + F.col("x.k")).alias("pos"),
                             F.lit(level + 1).alias("up_level"), F.col("run").alias("up_pos"), "x.left", "x.right")
        links = rows if links is None else links.unionByName(rows)
        nodes = runs.select("tree", F.col("run").alias("pos"), F.ceil(F.col("n") / arity).alias("n"),
                            F.sha2(F.array_join("hashes", ""), 256).alias("hash"))
        most, level = -(-most // arity), level + 1


_CLIMB = """
WITH RECURSIVE climb(tree, run, at_tree, at_level, at_pos, folded, above) AS (
  SELECT tree, run, tree, level, at_pos, folded, CAST('' AS BINARY) FROM {bottom}
  UNION ALL
  SELECT c.tree, c.run, n.up_tree, n.up_level, n.up_pos,
         CASE WHEN n.joins THEN c.folded ELSE transform(c.folded, h -> sha2(concat(n.left, h, n.right), 256)) END,
         concat(c.above, unhex(concat(n.left, n.right)))
  FROM climb c JOIN {nodes} n ON c.at_tree = n.tree AND c.at_level = n.level AND c.at_pos = n.pos)
SELECT climb.tree, climb.run, folded, above FROM climb JOIN {top} t ON at_tree = t.tree AND at_level = t.level AND at_pos = t.pos
"""


@contextmanager
def _without_row_limit(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_ROW_LIMIT, None)
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_ROW_LIMIT)
        else:
            spark.conf.set(_ROW_LIMIT, before)


def manifest(docs: DataFrame, fields=FIELDS, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text",
             arity: int = ARITY) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, leaf, subroot, root, proof`` (all siblings in order, as one text),
    ``folded_root, verified``."""
    spark = docs.sparkSession
    rows = ranked(leaves(docs, fields, id_col, group_col, text_col), ["doc_id", "leaf"])
    bottom = _kept(_runs(rows, arity, "doc_id", "leaf", "claimed"))
    most = bottom.agg(F.max("n")).first()[0] or 0
    hashes = F.transform("items", lambda x: x["leaf"])
    first = bottom.select("tree", F.when(F.col("n") > 1, F.col("run")).otherwise(F.lit(0)).alias("pos"),
                          F.ceil(F.col("n") / arity).alias("n"),
                          F.when(F.col("n") > 1, F.sha2(F.array_join(hashes, ""), 256)).otherwise(hashes[0]).alias("hash"))
    roots, links = _levels(first, -(-most // arity), arity, 1)
    subroots = _kept(roots.select(F.col("tree").alias("of_tree"), "level", F.col("hash").alias("subroot")))
    top = _kept(ranked(subroots.select(F.lit("t").alias("tree"), "of_tree", "level", F.col("subroot").alias("hash")),
                       ["of_tree"]))
    above, top_links = _levels(top.select("tree", "pos", "n", "hash"), top.count(), arity, 0)
    above = _kept(above)

    # every node below the root, linked to its parent; a subroot continues as a leaf of the top tree
    nodes = top.select(F.col("of_tree").alias("tree"), "level", F.lit(0).cast("long").alias("pos"), F.lit("t").alias("up_tree"),
                       F.lit(0).alias("up_level"), F.col("pos").alias("up_pos"), F.lit("").alias("left"), F.lit("").alias("right"))
    nodes = nodes.withColumn("joins", F.lit(True))           # the step into the top tree hashes nothing
    for more in (links, top_links):
        if more is not None:
            nodes = nodes.unionByName(more.withColumn("up_tree", F.col("tree")).withColumn("joins", F.lit(False)))
    starts = bottom.select("tree", "run", F.lit(1).alias("level"), F.col("run").alias("at_pos"),
                           F.transform("items", lambda x, i: F.when(F.col("n") > 1, _replaced(hashes, i, x["claimed"]))
                                       .otherwise(x["claimed"])).alias("folded"))
    with _without_row_limit(spark):
        climbed = _kept(spark.sql(_CLIMB, bottom=starts, nodes=_kept(nodes),
                                        top=above.select("tree", "level", F.lit(0).cast("long").alias("pos"))))

    each = (bottom.join(climbed, ["tree", "run"]).join(subroots.select(F.col("of_tree").alias("tree"), "subroot"), "tree")
            .select("subroot", "above", hashes.alias("hashes"),
                    F.posexplode(F.arrays_zip("items", "folded")).alias("k", "x")))
    root = above.select("hash").scalar()
    return (each.withColumn("root", root)
            .select(F.col("x.items.doc_id").alias("doc_id"), F.col("x.items.leaf").alias("leaf"), "subroot", "root",
                    F.concat(_others(F.col("hashes"), F.col("k")), F.lower(F.hex("above"))).alias("proof"),
                    F.col("x.folded").alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
