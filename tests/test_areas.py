"""Buffers, relations, parts of polylines, snapping and chains of edges against sampling and plain rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbis.functions import points as P
from orbis.functions import shapes as H
from orbis.operators import areas as A
from orbis.operators import kernels as K
from orbis.operators import search as S


def at(lat, lng):
    a, b = np.radians(lat), np.radians(lng)
    return np.stack(np.broadcast_arrays(np.cos(b) * np.cos(a), np.sin(b) * np.cos(a), np.sin(a)), -1)


def samples(n, seed, center, spread):
    rng = np.random.default_rng(seed)
    return at(center[0] + rng.uniform(-spread, spread, n), center[1] + rng.uniform(-spread, spread, n))


def distance(p, chain, closed=False):
    ends = np.roll(chain, -1, 0) if closed else chain[1:]
    starts = chain if closed else chain[:-1]
    return 2 * np.arcsin(np.sqrt(np.min([K.point_edge_l2(p, a, b) for a, b in zip(starts, ends)], 0)) / 2)


LINE = at(np.array([10.0, 11.0, 10.5, 12.0]), np.array([20.0, 21.0, 22.0, 21.5]))
SQUARE = at(np.array([10.0, 10.0, 13.0, 13.0]), np.array([20.0, 23.0, 23.0, 20.0]))


def test_buffer_of_points():
    loops = A.buffered([at(np.array([10.0, 10.2]), np.array([20.0, 20.2]))], 0.02, 0, 24)
    p = samples(600, 1, (10, 20), 3)
    d = np.min([2 * np.arcsin(np.sqrt(K.l2(p, c)) / 2) for c in at(np.array([10.0, 10.2]), np.array([20.0, 20.2]))], 0)
    held = K.polygon_contains(loops, p)
    assert held[d < 0.02 * 0.98].all() and not held[d > 0.02].any() and len(loops) == 1


def test_buffer_of_a_polyline():
    p, r = samples(800, 2, (11, 21), 2.5), 0.008
    d = distance(p, LINE)
    held = K.polygon_contains(A.buffered([LINE], r, 1, 24), p)
    assert held[d < 0.97 * r].all() and not held[d > 1.001 * r].any() and held.sum() > 20
    flat = K.polygon_contains(A.buffered([LINE], r, 1, 24, flat=True), p)
    assert not (flat & ~held & (d > 1.001 * r)).any()
    beyond = at(np.array([9.8]), np.array([19.8]))
    assert K.polygon_contains(A.buffered([LINE], r, 1, 24), beyond)[0] and not K.polygon_contains(A.buffered([LINE], r, 1, 24, flat=True), beyond)[0]


@pytest.mark.parametrize("r", [0.01, -0.01])
def test_buffer_of_a_polygon(r):
    p = samples(800, 3, (11.5, 21.5), 3)
    inside, d = K.polygon_contains([SQUARE], p), distance(p, SQUARE, True)
    held = K.polygon_contains(A.buffered([SQUARE], r, 2, 24), p)
    signed = np.where(inside, -d, d)
    assert held[signed < r - 0.0004].all() and not held[signed > r + 0.0004].any()


def test_buffer_edge_cases():
    assert A.buffered([LINE], -0.1, 1) == [] and A.buffered([], 0.1, 0) == [] and A.buffered([], 0.1, 1) == []
    assert A.buffered([SQUARE], 0.0, 2)[0] is SQUARE
    assert len(A.buffered([LINE[:1]], 0.01, 1)) == 1 and len(A.buffered([np.array([LINE[0], LINE[0]])], 0.01, 1)) == 1
    assert A.buffered([SQUARE], -0.2, 2) == []


def test_relations():
    inner = at(np.array([11.0, 11.0, 12.0, 12.0]), np.array([21.0, 22.0, 22.0, 21.0]))
    apart = at(np.array([30.0, 30.0, 31.0, 31.0]), np.array([21.0, 22.0, 22.0, 21.0]))
    over = at(np.array([12.0, 12.0, 14.0, 14.0]), np.array([21.0, 22.0, 22.0, 21.0]))
    assert A.relation([SQUARE], [inner], "contains") and not A.relation([inner], [SQUARE], "contains") and not A.relation([SQUARE], [over], "contains")
    assert A.relation([SQUARE], [over], "intersects") and A.relation([SQUARE], [inner], "intersects") and not A.relation([SQUARE], [apart], "intersects")
    assert A.relation([SQUARE], [np.roll(SQUARE, 1, 0)], "equals") and not A.relation([SQUARE], [inner], "equals")


def test_polyline_parts():
    chain = at(np.array([9.0, 11.0, 11.5, 14.0, 12.0]), np.array([21.0, 21.0, 22.0, 22.0, 21.5]))
    inside, outside = A.polyline_parts(chain, [SQUARE], True), A.polyline_parts(chain, [SQUARE], False)
    assert len(inside) == 2 and len(outside) == 2
    length = lambda cs: sum(2 * np.arcsin(np.sqrt(K.l2(c[:-1], c[1:])) / 2).sum() for c in cs)
    assert length(inside) + length(outside) == pytest.approx(length([chain]), abs=1e-12)
    assert A.polyline_parts(chain, [], True) == [] and len(A.polyline_parts(chain, [], False)) == 1


def test_linked():
    a, b, c, d = (tuple(p) for p in LINE)
    assert [len(x) for x in A.linked([(b, c), (a, b), (c, d)])] == [4]
    loop = A.linked([(a, b), (b, c), (c, a)])
    assert len(loop) == 1 and (loop[0][0] == loop[0][-1]).all()
    assert sum(len(x) - 1 for x in A.linked([(a, b), (c, b), (b, d), (a, b)])) == 4 and A.linked([]) == []


def test_snapping():
    rng = np.random.default_rng(5)
    chain = rng.normal(size=(200, 3))
    chain /= np.linalg.norm(chain, axis=1, keepdims=True)
    for moved, most in ((A.snapped_to_cells(chain, 10), A.cell_snap_radius(10)), (A.snapped_to_degrees(chain, 2), A.degree_snap_radius(2))):
        assert len(moved) == 200 and 0 < (2 * np.arcsin(np.sqrt(K.l2(chain, moved)) / 2)).max() <= most * (1 + 1e-9)
    again = A.snapped_to_cells(A.snapped_to_cells(chain, 10), 10)
    assert np.allclose(again, A.snapped_to_cells(chain, 10))
    close = at(np.array([1.0, 1.0000001, 5.0, 1.0]), np.array([1.0, 1.0000001, 5.0, 1.0]))
    assert len(A.snapped_to_cells(close, 8)) == 3 and len(A.snapped_to_cells(close, 8, closed=True)) == 2 and len(A.snapped_to_cells(close[:0], 8)) == 0


def test_columns(spark):
    def chain(c):
        return F.array(*[P.point_degrees(F.lit(float(math.degrees(math.asin(p[2])))), F.lit(float(math.degrees(math.atan2(p[1], p[0]))))) for p in c])

    df = spark.range(1).select(chain(LINE).alias("l"), F.array(chain(SQUARE)).alias("s")).withColumn("e", H.edges(F.col("l")))
    r = df.select(
        F.size(H.buffer(F.array("l"), 0.01, 1)).alias("b"), F.size(H.polyline_inside("l", "s")).alias("i"), F.size(H.link_edges("e")[0]).alias("n"), H.polygon_contains_polygon("s", "s").alias("c"), H.polygon_intersects("s", "s").alias("x"),
        F.size(H.snap_to_cells(F.col("l"), 5)).alias("k"), F.size(H.snap_to_degrees(F.col("l"), 1)).alias("d"), F.size(H.polygons_union(F.array("s", "s"))).alias("u"), H.polygon_contains(H.polygon_complement(F.col("s")), P.point_degrees(F.lit(-40), F.lit(3))).alias("o"),
    ).first()
    assert r["b"] == 1 and r["i"] == 1 and r["n"] == 4 and r["c"] and r["x"] and 1 <= r["k"] <= 4 and r["d"] == 4 and r["u"] == 1 and r["o"]
    assert S.l2_of(0.1) > 0
