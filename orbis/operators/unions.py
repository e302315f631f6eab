"""Set operations on cell unions, one row a cell: equi-joins and grouped counts by key, no UDFs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbis.functions import cellid as C
from orbis.operators.joins import levels_of, semi_join, with_ancestors
from orbis.session import materialize


def disjoint(cells: DataFrame) -> DataFrame:
    """Distinct cells without those inside another one."""
    own = cells.select("cell_id").distinct()
    inner = with_ancestors(own, levels_of(own), name="_k", proper=True)
    held = inner.join(own.select(F.col("cell_id").alias("_o")), F.col("_k") == F.col("_o"), "left_semi").select("cell_id").distinct()
    return own.join(held, "cell_id", "left_anti")


def normalize(cells: DataFrame) -> DataFrame:
    """The smallest set of cells with the same leaves: nested ones go, four siblings give their parent, level by level upwards."""
    now = materialize(disjoint(cells).withColumn("level", C.level(F.col("cell_id"))), "cells")
    for level in range(max([r[0] for r in now.select("level").distinct().collect()], default=0), 0, -1):
        full = now.filter(F.col("level") == level).groupBy(C.parent(F.col("cell_id"), level - 1).alias("p")).agg(F.count("*").alias("n")).filter("n = 4").select("p")
        if full.isEmpty():
            continue
        rest = now.join(full, C.parent(F.col("cell_id"), level - 1).eqNullSafe(F.col("p")) & (F.col("level") == level), "left_anti")
        now = materialize(rest.unionByName(full.select(F.col("p").alias("cell_id"), F.lit(level - 1).alias("level"))), "cells")
    return now.select("cell_id")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return normalize(a.select("cell_id").union(b.select("cell_id")))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of each overlapping pair the finer cell."""
    x, y = disjoint(a), disjoint(b)
    left, right = x.withColumnRenamed("cell_id", "a_cell"), y.withColumnRenamed("cell_id", "b_cell")
    in_b = with_ancestors(left, levels_of(y), "a_cell", "_k").join(right, F.col("_k") == F.col("b_cell"), "left_semi").select(F.col("a_cell").alias("cell_id"))
    in_a = with_ancestors(right, levels_of(x), "b_cell", "_k").join(left, F.col("_k") == F.col("a_cell"), "left_semi").select(F.col("b_cell").alias("cell_id"))
    return normalize(in_b.union(in_a))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of a without b: cells that hold some of b are split down to b's levels."""
    x, y = disjoint(a), disjoint(b)
    clear = semi_join(x.withColumnRenamed("cell_id", "a_cell"), y.withColumnRenamed("cell_id", "b_cell"), anti=True)
    kept = clear.select(F.col("a_cell").alias("cell_id"))
    # Of a cell with parts of b inside: the siblings along the way down to each part, unless they hold parts themselves.
    inner = with_ancestors(y.withColumnRenamed("cell_id", "b_cell"), levels_of(x), "b_cell", "_k", proper=True).join(x, F.col("_k") == F.col("cell_id")).select("b_cell", F.col("cell_id").alias("top"))
    steps = inner.select("b_cell", F.explode(F.sequence(C.level(F.col("top")), C.level(F.col("b_cell")) - 1)).alias("l"))
    opened = steps.select(C.parent(F.col("b_cell"), F.col("l")).alias("c")).distinct()
    pieces = opened.select(F.explode(C.children(F.col("c"))).alias("cell_id"))
    rest = pieces.join(opened.select(F.col("c").alias("cell_id")), "cell_id", "left_anti").join(y, "cell_id", "left_anti")
    return normalize(kept.union(rest))


def contains_cell(cells: DataFrame, probes: DataFrame, probe: str = "probe") -> DataFrame:
    """Probes inside one cell of a normalised union."""
    keyed = with_ancestors(probes, levels_of(cells), probe, "_k")
    return keyed.join(cells.select(F.col("cell_id").alias("_c")), F.col("_k") == F.col("_c"), "left_semi").drop("_k").distinct()


def denormalize(cells: DataFrame, min_level: int, level_mod: int = 1) -> DataFrame:
    """Cells split until their level is at least min_level and a whole number of steps above it."""
    def goal(l: int) -> int:
        m = max(l, min_level)
        return min(C.MAX_LEVEL, m + (-(m - min_level)) % level_mod)

    level = C.level(F.col("cell_id"))
    split = F.coalesce(*[F.when(level == l, C.children_at(F.col("cell_id"), goal(l))) for l in range(C.MAX_LEVEL + 1)])
    return cells.select(F.explode(split).alias("cell_id"))


def leaves_covered(cells: DataFrame) -> DataFrame:
    """One row: how many leaves a normalised union has, as decimal(38)."""
    return cells.agg(F.sum(C.lsb(F.col("cell_id")).cast("decimal(38,0)")).alias("leaves"))


def average_area(cells: DataFrame) -> DataFrame:
    return cells.agg(F.sum(C.metric("avg_area", C.level(F.col("cell_id")))).alias("area"))


def expand(cells: DataFrame, level: int) -> DataFrame:
    """The union and all neighbours at a level of its cells, each cell first raised to that level if finer."""
    raised = cells.select(F.when(C.level(F.col("cell_id")) > level, C.parent(F.col("cell_id"), level)).otherwise(F.col("cell_id")).alias("cell_id")).distinct()
    at = denormalize(raised, level)
    return normalize(at.select(F.explode(F.array_union(F.array("cell_id"), C.all_neighbors(F.col("cell_id"), level))).alias("cell_id")))
