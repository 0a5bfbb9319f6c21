"""Equal subtrees in any number of trees of any size, by Merkle hashes over a table of nodes.

A node is a row (tree_id, at, depth, type); ``at`` orders a tree's nodes as a reader meets them, and depth grows by one at
most from a node to the next. A tree may have several roots. A node's hash is made of its normal type and the hashes of its
children in their order, so two nodes have one hash if their subtrees have one normal form, as ``functions.shapes`` defines
it: names and literals by kind, without what stands below them. Hashes go up one level a round, deepest first, with one
aggregation each; no tree is held as a whole, and long lists of siblings are hashed in blocks of ``BLOCK`` first.

Rounds are as many as the deepest tree has levels. An empty table gives no rows; a null type counts as ``unknown``; equal
rows of a node are one node each and must not occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.shapes import TOKENS
from ..shared import saved

BLOCK = 1024


def with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with the ``parent``'s place: the last node before them that is one level higher; null for roots.

    Each node stands once on its own level and once, as a possible parent, on the next; so a window's partition is one
    level of one tree.
    """
    each = nodes.withColumn("_as", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_level", F.col("depth") + F.col("_as"))
    last = F.last(F.when(F.col("_as") == 1, F.col("at")), ignorenulls=True).over(Window.partitionBy("tree_id", "_level").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return each.withColumn("parent", last).filter("_as = 0").drop("_as", "_level")


def _joined(order: str, value: str) -> Column:
    """The values of a group in their order, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), "")


def _below(level: DataFrame) -> DataFrame:
    """(tree_id, parent, below, inside): one hash for all children of a node, and how many nodes they hold."""
    place = F.row_number().over(Window.partitionBy("tree_id", "parent").orderBy("at")) - 1
    blocks = level.withColumn("_i", place).withColumn("_block", F.floor(F.col("_i") / BLOCK))
    blocks = blocks.groupBy("tree_id", "parent", "_block").agg(F.sha2(_joined("_i", "hash"), 256).alias("_hash"), F.sum("nodes").alias("_nodes"))
    return blocks.groupBy("tree_id", "parent").agg(F.sha2(_joined("_block", "_hash"), 256).alias("below"), F.sum("_nodes").alias("inside"))


def hashed(nodes: DataFrame) -> DataFrame:
    """(tree_id, at, depth, type, parent, hash, nodes) of every node; ``nodes`` counts those of its subtree."""
    known = with_parents(nodes.select("tree_id", "at", "depth", F.coalesce("type", F.lit("unknown")).alias("type")))
    known = saved(known.sortWithinPartitions("depth"))  # a round's filter then skips the pages of other levels
    deepest = known.agg(F.max("depth")).first()[0]
    token = F.try_element_at(F.create_map(*[F.lit(x) for pair in TOKENS.items() for x in pair]), F.col("type"))
    out, under = [], None
    for depth in range(deepest if deepest is not None else 0, -1, -1):
        level = known.filter(F.col("depth") == depth)
        if under is None:
            level = level.withColumn("below", F.lit(None).cast("string")).withColumn("inside", F.lit(0).cast("long"))
        else:
            level = level.join(_below(under).withColumnRenamed("parent", "at"), ["tree_id", "at"], "left")
        form = F.when(token.isNotNull(), token).otherwise(F.concat_ws("\0", "type", "below"))
        level = level.select("tree_id", "at", "depth", "type", "parent", F.sha2(form, 256).alias("hash"), (F.coalesce("inside", F.lit(0)) + 1).cast("long").alias("nodes"))
        under = saved(level)
        out.append(under)
    whole = out[0]
    for level in out[1:]:
        whole = whole.unionByName(level)
    return whole


def classes(found: DataFrame, least: int = 1) -> DataFrame:
    """(hash, nodes, occurrences, trees, first_tree, first_at) of every form of at least ``least`` nodes.

    Nodes are counted as in the first occurrence: what stands below a name may differ. A form in many trees is counted
    tree by tree first.
    """
    big = found.filter(F.col("nodes") >= least)
    each = big.groupBy("hash", "tree_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "nodes")).alias("first"))
    all_ = each.groupBy("hash").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("trees"), F.min(F.struct("tree_id", F.col("first.at").alias("at"), F.col("first.nodes").alias("nodes"))).alias("first"))
    return all_.select("hash", F.col("first.nodes").alias("nodes"), "occurrences", "trees", F.col("first.tree_id").alias("first_tree"), F.col("first.at").alias("first_at"))


def largest(found: DataFrame, least: int = 2) -> DataFrame:
    """Nodes whose form occurs more than once, while their parent's does not: where repeated parts begin."""
    repeated = classes(found, least).filter("occurrences > 1").select("hash", "occurrences")
    nodes = found.filter(F.col("nodes") >= least).join(repeated, "hash")
    above = nodes.select("tree_id", F.col("at").alias("parent"))
    return nodes.join(above, ["tree_id", "parent"], "left_anti").select("tree_id", "at", "hash", "nodes", "occurrences")
