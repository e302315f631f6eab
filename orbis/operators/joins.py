"""Joins of cell-keyed tables: equi-joins on ancestors, which Catalyst sorts, hashes or broadcasts as it sees fit."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbis.functions import cellid as C
from orbis.functions import cells as G
from orbis.functions import points as P
from orbis.session import materialize


def levels_of(cells: DataFrame, cell: str = "cell_id") -> list[int]:
    """The distinct levels in a table, 31 at most."""
    return sorted(r[0] for r in cells.select(C.level(F.col(cell)).alias("l")).filter("l is not null").distinct().collect())


def with_ancestors(cells: DataFrame, levels: list[int], cell: str = "cell_id", name: str = "anc", proper: bool = False) -> DataFrame:
    """One row for each ancestor at one of the levels, the cell itself included unless proper."""
    found = C.ancestors(F.col(cell), levels)
    if proper:
        found = F.array_remove(found, F.col(cell))
    return cells.withColumn(name, F.explode(found))


def overlap_join(a: DataFrame, b: DataFrame, left: str = "a_cell", right: str = "b_cell") -> DataFrame:
    """All pairs of rows whose cells overlap: one is the other's ancestor or equal. Columns of both; names must differ.

    The finer cell's ancestors are exploded at the levels that the other side has, and compared by
    equality; pairs in which b is the coarser one come from the second half, without the equal ones.
    """
    down = a.join(with_ancestors(b, levels_of(a, left), right, "_k"), F.col(left) == F.col("_k")).drop("_k")
    up = with_ancestors(a, levels_of(b, right), left, "_k", proper=True).join(b, F.col(right) == F.col("_k")).drop("_k")
    return down.unionByName(up)


#: Pairs of one cell beyond which its rows are dealt out in parts.
MOST_PAIRS = 20_000_000


def merged(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a and b joined on a key by merging, in order of a's rows; the rows of a of a key with many pairs are dealt out, those of b come to all parts."""
    n = F.ceil(F.least("_na", F.col("_na") * F.col("_nb") / MOST_PAIRS)).cast("int").alias("_n")
    count = lambda df, name: df.groupBy(key).agg(F.count("*").cast("double").alias(name))
    large = materialize(count(a, "_na").join(count(b, "_nb"), key).select(key, n).filter("_n > 1"), "large-cells")
    part = F.coalesce(F.pmod(F.xxhash64(*[c for c in a.columns if c != key]), F.col("_n")), F.lit(0)).cast("int")
    dealt = a.join(F.broadcast(large), key, "left").withColumn("_s", part).drop("_n")
    every = b.join(F.broadcast(large), key, "left").withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
    return dealt.hint("merge").join(every, [key, "_s"]).drop(key, "_s")


def overlap_pairs(a: DataFrame, b: DataFrame, left: str = "a_cell", right: str = "b_cell") -> DataFrame:
    """overlap_join() for results much larger than the tables: pairs of a cell follow each other, so they are stored in few bytes.

    Both halves are merge joins on the cell: the same rows of b stand beside each row of a, and columnar files hold runs
    and repeats. A broadcast would leave pairs in the order of the streamed table, with other rows of b beside each row.
    """
    down = merged(a.withColumn("_k", F.col(left)), with_ancestors(b, levels_of(a, left), right, "_k"), "_k")
    up = merged(with_ancestors(a, levels_of(b, right), left, "_k", proper=True), b.withColumn("_k", F.col(right)), "_k")
    return down.unionByName(up)


def semi_join(a: DataFrame, b: DataFrame, left: str = "a_cell", right: str = "b_cell", anti: bool = False) -> DataFrame:
    """Rows of a whose cell overlaps some cell of b (or none, if anti): two semi-joins on keys, no pairs."""
    below = b.select(F.explode(C.ancestors(F.col(right), levels_of(a, left))).alias("_k")).distinct()
    above = b.select(F.col(right).alias("_k")).distinct()
    # Each distinct cell of a is judged once.
    own = a.select(F.col(left).alias("_c")).distinct()
    finer = own.select("_c", F.explode(C.ancestors(F.col("_c"), levels_of(b, right))).alias("_a")).join(above, F.col("_a") == F.col("_k"), "left_semi").select("_c")
    coarser = own.join(below, F.col("_c") == F.col("_k"), "left_semi")
    hit = finer.union(coarser).distinct()
    return a.join(hit, F.col(left) == F.col("_c"), "left_anti" if anti else "left_semi")


def label_lookup(index: DataFrame, targets: DataFrame, cell: str = "cell_id", label: str = "label", target: str = "target") -> DataFrame:
    """Distinct labels of the index cells that overlap each target cell: (target, labels), sorted."""
    pairs = overlap_join(index.select(F.col(cell).alias("_i"), label), targets.select(F.col(target)), "_i", target)
    return pairs.groupBy(target).agg(F.sort_array(F.collect_set(label)).alias("labels"))


def expanded(cells: DataFrame, cell: str, level: int, name: str = "near") -> DataFrame:
    """One row for each cell's ancestor at a level and that one's neighbours."""
    own = C.parent(F.col(cell), level)
    return cells.withColumn(name, F.explode(F.array_union(F.array(own), C.all_neighbors(own, level))))


def zones_join(points: DataFrame, zones: DataFrame, cell: str = "cell_id", covering: str = "covering") -> DataFrame:
    """Candidate pairs of points (leaf cells) and zones (coverings, arrays of cells): each at most once, as coverings are disjoint."""
    parts = zones.withColumn("_c", F.explode(covering))
    keyed = with_ancestors(points, levels_of(parts, "_c"), cell, "_k")
    return keyed.join(parts, F.col("_k") == F.col("_c")).drop("_k", "_c")


def cells_within(a: DataFrame, b: DataFrame, radians: float, left: str = "a_cell", right: str = "b_cell") -> DataFrame:
    """All pairs of rows whose cells are at most an angle apart, with their squared chord l2; names of columns must differ.

    Each cell of a is entered at itself or its ancestor at a level whose neighbourhood holds a disc of that radius about
    each of its points, and at that one's neighbours, nine keys at most: a cell of b within the angle overlaps
    one of them. Above the width of a face all six faces are the keys.
    """
    near = C.metric_value("min_width", 0) >= radians
    level = C.max_level_for("min_width", radians) if near else 0
    own = C.parent(F.col(left), F.least(C.level(F.col(left)), F.lit(level)))
    if near:
        keys = F.array_union(F.array(own), C.all_neighbors(own, C.level(own)))
    else:
        keys = F.array(*[C.from_face_pos_level(F.lit(f), F.lit(0).cast("long"), 0) for f in range(6)])
    keyed = materialize(a.withColumn("_near", F.explode(keys)), "near-cells")
    limit = 4 * math.sin(min(radians, math.pi) / 2) ** 2
    # Bounding caps of the distinct cells rule out most candidates before the sides are measured.
    capped = lambda df, cell, name: materialize(df.select(cell).distinct().withColumn(name, G.cap_bound(F.col(cell))), "caps")
    keyed, others = keyed.join(capped(a, left, "_x"), left), b.join(capped(b, right, "_y"), right)
    pairs = overlap_join(keyed, others, "_near", right)
    turn = lambda l2: 2 * F.asin(F.least(F.lit(1.0), 0.5 * F.sqrt(l2)))
    apart = turn(P.chord(F.col("_x.axis"), F.col("_y.axis"))) - turn(F.col("_x.l2")) - turn(F.col("_y.l2"))
    pairs = pairs.filter(apart <= radians + 1e-7).drop("_near", "_x", "_y").select(*a.columns, *b.columns).distinct()
    return pairs.withColumn("l2", G.distance_to_cell(F.col(left), F.col(right))).filter(F.col("l2") <= limit)
