"""Density trees (a rollup over the cell hierarchy), clusters of equal weight, shards, and hulls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbis.functions import cellid as C
from orbis.functions import types
from orbis.operators import kernels as K
from orbis.operators.joins import levels_of, with_ancestors


def density_tree(points: DataFrame, max_level: int, weight: str | None = None) -> DataFrame:
    """cell_id, weight of every cell down to a level that holds weight: one map-side combined sum at the finest level, then sums of sums."""
    w = F.col(weight) if weight else F.lit(1)
    finest = points.groupBy(C.parent(F.col("cell_id"), max_level).alias("cell_id")).agg(F.sum(w).cast("long").alias("weight"))
    rolled = with_ancestors(finest, list(range(max_level + 1)), name="_a").groupBy("_a").agg(F.sum("weight").cast("long").alias("weight"))
    return rolled.withColumnRenamed("_a", "cell_id").filter("weight > 0").select("cell_id", "weight")


def feature_density(coverings: DataFrame, feature: str, max_level: int, weight: str | None = None) -> DataFrame:
    """cell_id, weight of every cell down to a level: the weight (1 by default) of each feature once in every cell that its covering meets.

    Cells of a covering that are coarser than the level count in all their descendants there.
    """
    coarse = C.level(F.col("cell_id")) < max_level
    own = [feature, *([weight] if weight else [])]
    finest = F.when(coarse, C.children_at(F.col("cell_id"), max_level)).otherwise(F.array(C.parent(F.col("cell_id"), max_level)))
    cells = coverings.select(*own, F.explode(finest).alias("cell_id")).distinct()
    met = with_ancestors(cells, list(range(max_level + 1)), name="_a").select(*own, "_a").distinct()
    w = F.col(weight) if weight else F.lit(1)
    return met.groupBy("_a").agg(F.sum(w).cast("long").alias("weight")).withColumnRenamed("_a", "cell_id").filter("weight > 0")


def tree_sum(*trees: DataFrame) -> DataFrame:
    out = trees[0]
    for t in trees[1:]:
        out = out.unionByName(t)
    return out.groupBy("cell_id").agg(F.sum("weight").cast("long").alias("weight"))


def tree_intersection(tree: DataFrame, cells: DataFrame) -> DataFrame:
    """The tree's cells that overlap a cell union."""
    inside = with_ancestors(tree, levels_of(cells), name="_k").join(cells.select(F.col("cell_id").alias("_c")), F.col("_k") == F.col("_c"), "left_semi").select("cell_id", "weight")
    above = cells.select(F.explode(C.ancestors(F.col("cell_id"))).alias("cell_id")).distinct()
    return inside.union(tree.join(above, "cell_id", "left_semi")).distinct()


def tree_normalize(tree: DataFrame) -> DataFrame:
    """Weights scaled down from the faces, so that children add up to their parent (as doubles)."""
    parent = F.when(~C.is_face(F.col("cell_id")), C.parent(F.col("cell_id"), C.level(F.col("cell_id")) - 1))
    sums = tree.withColumn("p", parent).filter("p is not null").groupBy("p").agg(F.sum("weight").alias("children"))
    ratio = tree.join(sums, tree["cell_id"] == sums["p"]).select(F.col("cell_id").alias("anc"), (F.col("weight") / F.col("children")).alias("r"))
    own = with_ancestors(tree, list(range(C.MAX_LEVEL + 1)), name="anc", proper=True)
    factors = own.join(ratio, "anc").groupBy("cell_id").agg(F.product("r").alias("f"))
    return tree.join(factors, "cell_id", "left").select("cell_id", (F.col("weight") * F.coalesce("f", F.lit(1.0))).alias("weight"))


def tree_leaves(tree: DataFrame) -> DataFrame:
    parents = tree.filter(~C.is_face(F.col("cell_id"))).select(C.parent(F.col("cell_id"), C.level(F.col("cell_id")) - 1).alias("cell_id")).distinct()
    return tree.join(parents, "cell_id", "left_anti")


def tree_partition(tree: DataFrame, max_weight: int) -> DataFrame:
    """The coarsest cells whose weight is at most a limit, or leaves above it."""
    parent = F.when(~C.is_face(F.col("cell_id")), C.parent(F.col("cell_id"), C.level(F.col("cell_id")) - 1))
    up = tree.select(F.col("cell_id").alias("_p"), F.col("weight").alias("_w"))
    joined = tree.withColumn("_p", parent).join(up, "_p", "left")
    leaves = tree_leaves(tree).select(F.col("cell_id").alias("_l"))
    heavy_above = F.col("_w").isNull() | (F.col("_w") > max_weight)
    found = joined.join(leaves, F.col("cell_id") == F.col("_l"), "left").filter(heavy_above & ((F.col("weight") <= max_weight) | F.col("_l").isNotNull()))
    return found.select("cell_id", "weight")


def tree_dilate(tree: DataFrame, radians: float, max_level_diff: int = 1) -> DataFrame:
    """Leaves spread to the neighbours at a level that hold a disc of that radius; a cell gets the largest weight that reaches it."""
    level = C.max_level_for("min_width", radians)
    leaves = tree_leaves(tree)
    raised = leaves.select(F.when(C.level(F.col("cell_id")) > level, C.parent(F.col("cell_id"), level)).otherwise(F.col("cell_id")).alias("cell_id"), "weight")
    spread = raised.withColumn("at", F.least(C.level(F.col("cell_id")), F.lit(level)))
    near = spread.select(F.explode(F.array_union(F.array("cell_id"), C.all_neighbors(F.col("cell_id"), F.col("at")))).alias("cell_id"), "weight")
    return near.groupBy("cell_id").agg(F.max("weight").alias("weight"))


def clusters(tree: DataFrame, weight: int) -> DataFrame:
    """cluster, begin_key, end_key, weight: stretches of the curve of about equal weight, by a running sum over the tree's leaves.

    Sums are taken in two steps, over stretches of the curve and then within each, so no window holds all leaves.
    """
    leaves = tree_leaves(tree).select(C.key(C.range_min(F.col("cell_id"))).alias("b"), C.key(C.range_max(F.col("cell_id"))).alias("e"), "weight").withColumn("part", F.shiftright("b", 48))
    sums = leaves.groupBy("part").agg(F.sum("weight").alias("w"))
    before = sums.select("part", F.coalesce(F.sum("w").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # 24 576 parts at most
    run = F.sum("weight").over(Window.partitionBy("part").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    placed = leaves.withColumn("run", F.coalesce(run, F.lit(0))).join(before, "part").withColumn("mid", F.col("start") + F.col("run") + F.col("weight") / 2)
    return placed.groupBy(F.floor(F.col("mid") / weight).cast("long").alias("cluster")).agg(F.min("b").alias("begin_key"), F.max("e").alias("end_key"), F.sum("weight").cast("long").alias("weight"))


def best_shard(shards: DataFrame, regions: DataFrame, region: str = "region") -> DataFrame:
    """region, shard: the shard (cell_id, shard) that shares most leaves with each region (region, cell_id), ties to the smaller number."""
    from orbis.operators.joins import overlap_join

    pairs = overlap_join(shards.select(F.col("cell_id").alias("a_cell"), "shard"), regions.select(F.col("cell_id").alias("b_cell"), region))
    leaves = F.least(C.lsb(F.col("a_cell")), C.lsb(F.col("b_cell"))).cast("decimal(38,0)")
    summed = pairs.groupBy(region, "shard").agg(F.sum(leaves).alias("n"))
    return summed.groupBy(region).agg(F.max_by("shard", F.struct("n", -F.col("shard"))).alias("shard"))


def convex_hull(points: DataFrame) -> DataFrame:
    """One row: the hull of all points p (within a hemisphere), from the hulls of each partition."""

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = np.zeros((0, 3))
        for b in batches:
            kept = K.hull(np.concatenate([kept, b[["x", "y", "z"]].to_numpy(float)]))
        yield pd.DataFrame(kept, columns=list("xyz"))

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        h = K.hull(rows[["x", "y", "z"]].to_numpy(float))
        return pd.DataFrame({"hull": [[dict(zip("xyz", map(float, p))) for p in h]]})

    parts = points.select("p.x", "p.y", "p.z").mapInPandas(some, "x double, y double, z double")
    return parts.withColumn("one", F.lit(True)).groupBy("one").applyInPandas(whole, types.struct(hull=types.POINTS))
