"""Polylines, loops and polygons as arrays of points: measures as Column expressions, refine kernels in Arrow UDFs.

A loop's interior is on its left. A shape is struct<dimension, chains>: dimension 0 has one chain of
points, 1 a chain for each polyline, 2 a chain for each loop (shells counter-clockwise, holes clockwise).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from orbis.functions import arrow as W
from orbis.functions import points as P
from orbis.functions import types
from orbis.functions.points import let
from orbis.operators import areas as A
from orbis.operators import kernels as K


def edges(chain: Column, closed: bool = False) -> Column:
    """Array of struct<a,b>."""
    n = F.size(chain)
    count = n if closed else n - 1
    at = F.when(count >= 1, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda k: F.struct(F.get(chain, k).alias("a"), F.get(chain, (k + 1) % n).alias("b")))


def _total(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + value(e))


def _total_point(items: Column, value) -> Column:
    zero = P.point(0, 0, 0)
    return F.aggregate(items, zero, lambda acc, e: P.add(acc, value(e)))


def polyline_length(chain: Column) -> Column:
    return _total(edges(chain), lambda e: P.angle_between(e["a"], e["b"]))


def loop_length(chain: Column) -> Column:
    return _total(edges(chain, closed=True), lambda e: P.angle_between(e["a"], e["b"]))


def polyline_centroid(chain: Column) -> Column:
    return _total_point(edges(chain), lambda e: P.edge_centroid(e["a"], e["b"]))


def loop_signed_area(chain: Column) -> Column:
    """Sum of signed triangles about the first vertex, for loops smaller than a hemisphere."""

    def total(first: Column) -> Column:
        return _total(edges(chain, closed=True), lambda e: F.when((e["a"] == first) | (e["b"] == first), 0.0).otherwise(P.signed_area(first, e["a"], e["b"])))

    return let(F.get(chain, F.lit(0)), total)


def loop_area(chain: Column) -> Column:
    """Area on the loop's left, in [0, 4 pi]."""
    return let(loop_signed_area(chain), lambda a: F.when(a < 0, a + 4 * np.pi).otherwise(a))


def loop_turning(chain: Column) -> Column:
    """Sum of turn angles: 2 pi minus the area."""
    n = F.size(chain)
    at = F.sequence(F.lit(0), n - 1)
    return _total(at, lambda k: P.turn_angle(F.get(chain, k), F.get(chain, (k + 1) % n), F.get(chain, (k + 2) % n)))


def loop_centroid(chain: Column) -> Column:
    """Centroid times area."""
    first = F.get(chain, F.lit(0))
    each = lambda e: F.when((e["a"] == first) | (e["b"] == first), P.point(0, 0, 0)).otherwise(P.scale(P.triangle_centroid(first, e["a"], e["b"]), P.simple_sign(first, e["a"], e["b"])))
    return _total_point(edges(chain, closed=True), each)


def polyline_interpolate(chain: Column, fraction) -> Column:
    """The point at a fraction of the length; the ends beyond them."""
    sums = F.aggregate(edges(chain), F.struct(F.lit(0.0).alias("at"), F.array().cast("array<double>").alias("ends")), lambda acc, e: let(acc["at"] + P.angle_between(e["a"], e["b"]), lambda t: F.struct(t.alias("at"), F.array_append(acc["ends"], t).alias("ends"))))

    def find(s: Column) -> Column:
        goal = s["at"] * P.lit(fraction)
        k = F.size(F.filter(s["ends"], lambda t: t < goal))
        before = F.when(k > 0, F.get(s["ends"], k - 1)).otherwise(0.0)
        inner = P.point_on_line(F.get(chain, k), F.get(chain, k + 1), goal - before)
        return F.when(goal <= 0, F.get(chain, F.lit(0))).when(goal >= s["at"], F.element_at(chain, -1)).otherwise(inner)

    return let(sums, find)


def reversed_chain(chain: Column) -> Column:
    return F.reverse(chain)


def sub_chain(chain: Column, start, length) -> Column:
    return F.slice(chain, start, length)


def rect_of(chain: Column) -> Column:
    """Lat/lng bound of vertices, for chains that stay off the 180th meridian."""
    lats = F.transform(chain, P.latitude)
    lngs = F.transform(chain, P.longitude)
    from orbis.functions import bounds as B

    return B.rect(F.array_min(lats), F.array_max(lats), F.array_min(lngs), F.array_max(lngs))


# --- Arrow kernels ------------------------------------------------------------------------------


def _chain(points) -> np.ndarray:
    return np.array([[p["x"], p["y"], p["z"]] for p in points], float).reshape(-1, 3)


def _loops(loops) -> list[np.ndarray]:
    return [_chain(l) for l in loops]


def _points(chain: np.ndarray) -> list[dict]:
    return [dict(zip("xyz", map(float, p))) for p in chain]


@F.pandas_udf(types.T.BooleanType())
def polygon_contains(loops: pd.Series, p: pd.DataFrame) -> pd.Series:
    """Whether a polygon (array of loops) holds a point, semi-open: of polygons that share a vertex one at most holds it."""
    out = [l is not None and K.polygon_contains(_loops(l), np.array([[x, y, z]]))[0] for l, x, y, z in zip(loops, p["x"], p["y"], p["z"])]
    return pd.Series(out)


@F.pandas_udf(types.I)
def robust_sign(a: pd.DataFrame, b: pd.DataFrame, c: pd.DataFrame) -> pd.Series:
    """Orientation: exact, and by symbolic perturbation never 0 for distinct points."""
    return pd.Series(K.sign(a.to_numpy(float), b.to_numpy(float), c.to_numpy(float)))


@F.pandas_udf(types.I)
def robust_crossing(a: pd.DataFrame, b: pd.DataFrame, c: pd.DataFrame, d: pd.DataFrame) -> pd.Series:
    return pd.Series(K.crossing(*(x.to_numpy(float) for x in (a, b, c, d))))


@F.pandas_udf(types.POINT)
def intersection(a: pd.DataFrame, b: pd.DataFrame, c: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(K.intersection(*(x.to_numpy(float) for x in (a, b, c, d))), columns=list("xyz"))


@F.pandas_udf(types.D)
def edge_pair_distance_l2(a: pd.DataFrame, b: pd.DataFrame, c: pd.DataFrame, d: pd.DataFrame) -> pd.Series:
    return pd.Series(K.edge_pair_l2(*(x.to_numpy(float) for x in (a, b, c, d))))


@F.arrow_udf(types.POINTS)
def simplify(chain: pa.Array, tolerance: pa.Array) -> pa.Array:
    """Vertices of a subsequence within an angular tolerance of the polyline."""
    return W.points_of([None if c is None else c[K.subsample(c, t)] for c, t in zip(W.chains(chain), tolerance.to_pylist())])


@F.pandas_udf(types.T.ArrayType(types.T.StringType()))
def problems(loops: pd.Series) -> pd.Series:
    """What makes the loops of a polygon invalid; an empty array for a valid one."""
    return pd.Series([K.problems(_loops(l)) for l in loops])


def _boolean(kind: str):
    @F.pandas_udf(types.LOOPS)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[_points(l) for l in K.overlay(_loops(x), _loops(y), kind)] for x, y in zip(a, b)])

    return run


polygon_union, polygon_intersection, polygon_difference, polygon_symmetric_difference = (_boolean(k) for k in ("union", "intersection", "difference", "symmetric"))


@F.pandas_udf(types.LOOPS)
def polygons_union(polygons: pd.Series) -> pd.Series:
    """Union of an array of polygons."""
    return pd.Series([[_points(l) for l in A.union_all([_loops(p) for p in ps])] for ps in polygons])


def buffer(chains: Column, radius, dimension: int, segments: int = 16, flat: bool = False) -> Column:
    """Polygon within an angle of points (dimension 0), polylines (1) or loops (2); see areas.buffered()."""

    @F.pandas_udf(types.LOOPS)
    def run(c: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([[_points(l) for l in A.buffered(_loops(x), float(y), dimension, segments, flat)] for x, y in zip(c, r)])

    return run(chains, P.lit(radius))


def _related(kind: str):
    @F.pandas_udf(types.T.BooleanType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([A.relation(_loops(x), _loops(y), kind) for x, y in zip(a, b)])

    return run


polygon_contains_polygon, polygon_intersects, polygon_equals = (_related(k) for k in ("contains", "intersects", "equals"))


def _parts(inside: bool):
    @F.arrow_udf(types.LOOPS)
    def run(chain: pa.Array, loops: pa.Array) -> pa.Array:
        return W.shapes_of([None if x is None or y is None else A.polyline_parts(x, y, inside) for x, y in zip(W.chains(chain), W.shapes(loops))])

    return run


polyline_inside, polyline_outside = _parts(True), _parts(False)


@F.pandas_udf(types.LOOPS)
def link_edges(edges: pd.Series) -> pd.Series:
    """Polylines of an array of directed edges (struct a, b)."""
    keys = [[tuple(tuple(e[n][k] for k in "xyz") for n in "ab") for e in es] for es in edges]
    return pd.Series([[_points(c) for c in A.linked(e)] for e in keys])


def _snapped(move, at: int, closed: bool):
    @F.arrow_udf(types.POINTS)
    def run(chain: pa.Array) -> pa.Array:
        return W.points_of([None if c is None else move(c, at, closed) for c in W.chains(chain)])

    return run


def snap_to_cells(chain: Column, level: int, closed: bool = False) -> Column:
    """A chain with its vertices at cell centres, without repeats; no vertex moves by more than areas.cell_snap_radius()."""
    return _snapped(A.snapped_to_cells, level, closed)(chain)


def snap_to_degrees(chain: Column, exponent: int, closed: bool = False) -> Column:
    """A chain with its vertices at so many decimal digits of degrees, without repeats."""
    return _snapped(A.snapped_to_degrees, exponent, closed)(chain)


def polygon_complement(loops: Column) -> Column:
    """Everything else: the loops the other way round. An empty polygon, having no edges, stays empty."""
    return F.transform(loops, F.reverse)
