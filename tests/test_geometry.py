import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbis.functions import bounds as B
from orbis.functions import cellid as C
from orbis.functions import points as P
from orbis.functions import shapes as H
from orbis.operators import density as D
from orbis.operators import joins as J
from orbis.operators import kernels as K
from orbis.operators import regions as R
from orbis.operators import search as S
from orbis.operators import unions as U
from orbis.sources import text as X

# Two covers of a park and their overlapping pairs.
A = "89c2589 89c258a1 89c258a3 89c258bc 89c258c1 89c258ec 89c258f4".split()
BB = "89c2589 89c258a03 89c258a1c 89c258a3 89c258bd 89c258be1".split()
PAIRS = {("89c2589", "89c2589"), ("89c258a1", "89c258a03"), ("89c258a1", "89c258a1c"), ("89c258a3", "89c258a3"), ("89c258bc", "89c258bd"), ("89c258bc", "89c258be1")}


def cells(spark, tokens, name):
    return spark.createDataFrame([(t,) for t in tokens], "t string").select(C.from_token(F.col("t")).alias(name))


def value(spark, *columns):
    r = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()
    return tuple(r)


def points(spark, n, seed, name):
    rng = np.random.default_rng(seed)
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(-80, 80, n), rng.uniform(-180, 180, n)))]
    df = spark.createDataFrame(rows, f"{name} long, la double, lo double")
    xyz = np.array([[math.cos(math.radians(b)) * math.cos(math.radians(a)), math.sin(math.radians(b)) * math.cos(math.radians(a)), math.sin(math.radians(a))] for _, a, b in rows])
    return S.with_cells(df.select(name, P.point_degrees(F.col("la"), F.col("lo")).alias("p"))), xyz


def test_overlap_joins(spark):
    a, b = cells(spark, A, "a_cell"), cells(spark, BB, "b_cell")
    got = {tuple(r) for r in J.overlap_join(a, b).select(C.to_token(F.col("a_cell")), C.to_token(F.col("b_cell"))).collect()}
    assert got == PAIRS
    assert {r[0] for r in J.semi_join(a, b).select(C.to_token(F.col("a_cell"))).collect()} == {x for x, _ in PAIRS}
    assert {r[0] for r in J.semi_join(a, b, anti=True).select(C.to_token(F.col("a_cell"))).collect()} == set(A) - {x for x, _ in PAIRS}


def test_join_plan_has_no_cartesian_product(spark):
    a, b = cells(spark, A, "a_cell"), cells(spark, BB, "b_cell")
    plan = J.overlap_join(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_unions(spark):
    x, y = cells(spark, A, "cell_id"), cells(spark, BB, "cell_id")

    def leaves(df):
        return {r[0] for r in U.denormalize(df, 16).select("cell_id").collect()}

    lx, ly = leaves(x), leaves(y)
    assert leaves(U.union(x, y)) == lx | ly and leaves(U.intersection(x, y)) == lx & ly and leaves(U.difference(x, y)) == lx - ly
    kids = x.limit(1).select(F.explode(C.children(F.col("cell_id"))).alias("cell_id"))
    assert U.normalize(kids).first()[0] == x.first()[0] and U.normalize(kids).count() == 1
    assert U.leaves_covered(kids).first()[0] == 4 ** (30 - 12)


def test_nearest_and_furthest(spark):
    q, qx = points(spark, 40, 1, "q")
    p, px = points(spark, 500, 2, "id")
    l2 = np.minimum(4, ((qx[:, None] - px[None]) ** 2).sum(-1))
    for df, order in ((S.nearest(q, p, 4, "q", "id"), l2), (S.furthest(q, p, 4, "q", "id"), -l2)):
        got = {(r["q"], r["rank"]): r["id"] for r in df.collect()}
        assert got == {(k, n + 1): int(i) for k, row in enumerate(np.argsort(order, 1)[:, :4]) for n, i in enumerate(row)}
    near = {(r[0], r[1]) for r in S.pairs_within(q, p, 0.1, "q", "id").select("q", "id").collect()}
    assert near == {(int(a), int(b)) for a, b in zip(*np.nonzero(l2 < 4 * math.sin(0.05) ** 2))}


def test_limits_are_exclusive(spark):
    a, _ = points(spark, 1, 3, "q")
    b = a.withColumnRenamed("q", "id")
    assert S.pairs_within(a, b, 0.0, "q", "id").count() == 0 and S.pairs_within(a, b, 0.0, "q", "id", inclusive=True).count() == 1


def test_terms_find_what_coverings_share(spark):
    p, px = points(spark, 400, 5, "id")
    stored = p.select("id", R.index_terms(F.array(C.parent(F.col("cell_id"), 10)), min_level=4, max_level=10, level_mod=2, points_only=True).alias("terms"))
    caps = spark.createDataFrame([(k, k * 0.2 - 1, k * 0.5 - 2) for k in range(8)], "cap long, lat double, lng double")
    asked = caps.select("cap", R.query_terms(R.cap_covering(F.col("lat"), F.col("lng"), F.lit(0.04), min_level=4, max_level=10, level_mod=2), min_level=4, max_level=10, level_mod=2, points_only=True).alias("terms"))
    got = {tuple(r) for r in R.term_join(stored, asked, "id", "cap").collect()}
    for k in range(8):
        lat, lng = k * 0.2 - 1, k * 0.5 - 2
        axis = np.array([math.cos(lng) * math.cos(lat), math.sin(lng) * math.cos(lat), math.sin(lat)])
        assert {(int(i), k) for i in np.flatnonzero(((px - axis) ** 2).sum(1) <= 0.04)} <= got


def test_region_terms_both_ways(spark):
    rows = spark.createDataFrame([(k, 0.1 * k, 0.1) for k in range(6)], "id long, lat double, lng double")
    cover = lambda l2: R.cap_covering(F.col("lat"), F.col("lng"), F.lit(l2), min_level=2, max_level=12, max_cells=6)
    a = rows.select("id", R.index_terms(cover(0.002), min_level=2, max_level=12).alias("terms"))
    b = rows.select(F.col("id").alias("q"), R.query_terms(cover(0.002), min_level=2, max_level=12).alias("terms"))
    got = {tuple(r) for r in R.term_join(a, b, "id", "q").collect()}
    assert {(k, k) for k in range(6)} <= got and (0, 5) not in got


def test_density(spark):
    p, _ = points(spark, 600, 7, "id")
    tree = D.density_tree(p, 5).cache()
    by = {r[0]: r[1] for r in tree.collect()}
    assert sum(w for c, w in by.items() if c & (1 << 60) - 1 == 0) == 600
    part = D.tree_partition(tree, 30).collect()
    assert sum(r["weight"] for r in part) == 600 and all(r["weight"] <= 30 for r in part)
    groups = D.clusters(tree, 100).orderBy("cluster").collect()
    assert sum(r["weight"] for r in groups) == 600 and all(a["end_key"] < b["begin_key"] for a, b in zip(groups, groups[1:])) and all(r["weight"] <= 160 for r in groups)
    double = {r[0]: r[1] for r in D.tree_sum(tree, tree).collect()}
    assert double == {c: 2 * w for c, w in by.items()}
    scaled = {r[0]: r[1] for r in D.tree_normalize(tree).collect()}
    assert scaled == pytest.approx(by)


def test_best_shard(spark):
    def at(f, p, l):
        return C.from_face_pos_level(F.lit(f), F.lit(p).cast("long"), l)

    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(s).alias("shard"), at(*c).alias("cell_id")) for s, c in ((0, (0, 0, 10)), (1, (1, 1, 9)), (1, (3, 0, 8)), (2, (5, 0, 10)))])).alias("r")).select("r.*")
    region = spark.range(1).select(F.lit("x").alias("region"), F.explode(F.array(at(0, 0, 10), at(3, 0, 9), at(3, 1, 9))).alias("cell_id"))
    assert [tuple(r) for r in D.best_shard(rows, region).collect()] == [("x", 1)]


def test_earth_and_bearings(spark):
    ll = P.latlng_degrees
    r = value(spark, P.haversine(ll(80, 27), ll(55, -153)), *[F.degrees(P.initial_bearing(ll(*p), ll(*q))) for p, q in (((0, 50), (0, 100)), ((0, 100), (0, 0)), ((16, 28), (81, 28)))])
    assert r == pytest.approx((math.pi / 4, 90, -90, 0), abs=1e-12)


def test_chords(spark):
    h, q = P.chord_from_radians(F.lit(math.pi / 2)), P.chord_from_radians(F.lit(math.pi / 3))
    r = value(spark, h, P.chord_radians(q), P.chord_add(h, h), P.chord_radians(P.chord_sub(h, q)), P.chord_successor(F.lit(-1.0)), P.chord_successor(F.lit(4.0)), P.chord_sin(h), P.chord_cos(q), P.chord_tan(q))
    assert r[:4] == pytest.approx((2, math.pi / 3, 4, math.pi / 6)) and r[4:6] == (0, math.inf) and r[6:] == pytest.approx((1, 0.5, math.sqrt(3)))


def test_circular_intervals(spark):
    i = B.interval
    quad = [i(0, math.pi / 2), i(math.pi / 2, math.pi), i(-math.pi, -math.pi / 2), i(-math.pi / 2, 0)]
    r = value(spark, B.s1_union(quad[0], quad[1])["hi"], B.s1_length(B.s1_union(quad[1], i(-math.pi, -math.pi / 2))), B.s1_contains(i(3, -3), F.lit(math.pi)), B.s1_is_empty(B.s1_intersection(quad[0], i(2, 3))), B.s1_length(B.s1_complement(quad[0])), B.s1_intersects(i(3, -3), i(-3.1, 0)), B.s1_is_full(B.s1_expanded(i(0, 3), 2.0)), B.s1_center(i(3, -3)))
    assert r[0] == pytest.approx(math.pi) and r[1] == pytest.approx(math.pi) and r[2] and r[3] and r[4] == pytest.approx(1.5 * math.pi) and r[5] and r[6] and abs(r[7]) == pytest.approx(math.pi)


def test_rects_and_caps(spark):
    r = B.rect_degrees(-10, 10, 170, -170)
    k = B.cap_from_angle(P.point(1, 0, 0), 0.5)
    v = value(spark, B.rect_contains(r, P.latlng_degrees(0, 180)), B.rect_contains(r, P.latlng_degrees(0, 0)), B.rect_area(B.rect_full()), B.rect_is_empty(B.rect_intersection(r, B.rect_degrees(20, 30, 0, 10))), B.cap_contains(B.rect_cap_bound(r), P.point_degrees(10, 170)), B.cap_area(B.cap_full()), B.cap_contains_cap(k, B.cap_from_angle(P.point(1, 0, 0), 0.4)), B.cap_angle(B.cap_union(k, B.cap_from_angle(P.point(0, 1, 0), 0.5))), B.cap_is_empty(B.cap_complement(B.cap_full())))
    assert v[0] and not v[1] and v[2] == pytest.approx(4 * math.pi) and v[3] and v[4] and v[5] == pytest.approx(4 * math.pi) and v[6] and v[7] == pytest.approx(math.pi / 4 + 0.5) and v[8]


def test_text(spark):
    df = spark.createDataFrame([("10:20, -30:45.5",), ("x:1",), ("",)], "t string")
    rows = df.select(X.format_points(X.parse_points(F.col("t"))), X.parse_point(F.col("t"))).collect()
    assert rows[0][0] == "10:20, -30:45.5" and rows[1][0] == "" and [r[1] for r in rows] == [None] * 3
    shapes = spark.createDataFrame([("0:0 # 0:1, 0:2 # 0:5, 0:7, 2:6",)], "t string").select(X.parse_index(F.col("t"))).first()[0]
    assert [(s["dimension"], [len(c) for c in s["chains"]]) for s in shapes] == [(0, [1]), (1, [2]), (2, [3])]
    cells_ = spark.createDataFrame([("3/012",), ("5/",), ("6/1",)], "t string").select(X.parse_cell(F.col("t")).alias("c")).select(X.format_cell(F.col("c"))).collect()
    assert [r[0] for r in cells_] == ["3/012", "5/", None]


def test_measures_and_overlays(spark):
    df = spark.createDataFrame([("0:0, 0:90, 90:0",)], "t string").select(X.parse_loop(F.col("t")).alias("l"))
    r = df.select(H.loop_area(F.col("l")), H.loop_length(F.col("l")), H.loop_area(F.reverse("l")), H.loop_turning(F.col("l"))).first()
    assert tuple(r) == pytest.approx((math.pi / 2, 1.5 * math.pi, 3.5 * math.pi, 1.5 * math.pi))
    two = spark.createDataFrame([("0:0, 0:10, 10:10, 10:0", "5:5, 5:15, 15:15, 15:5")], "a string, b string").select(X.parse_polygon(F.col("a")).alias("a"), X.parse_polygon(F.col("b")).alias("b"))
    out = two.select(H.polygon_intersection("a", "b").alias("i"), H.problems("a").alias("bad"), H.polygon_contains("a", P.point_degrees(5, 5)).alias("in")).first()
    assert len(out["i"]) == 1 and len(out["i"][0]) == 4 and out["bad"] == [] and out["in"]


def test_hull(spark):
    p, px = points(spark, 300, 9, "id")
    near = p.filter(P.chord(F.col("p"), P.point(1, 0, 0)) < 1)
    hull = D.convex_hull(near).first()["hull"]
    rows = [[r["p"][k] for k in "xyz"] for r in near.collect()]
    from orbis.operators import kernels as K

    assert len(hull) == len(K.hull(np.array(rows)))


def half_turn():
    """Two points half a turn apart by their difference, the first with the larger longitude."""
    return P.latlng(F.lit(0.2), F.lit(math.pi / 2)), P.latlng(F.lit(0.1), F.lit(-math.pi / 2))


def test_rectangle_of_points_half_a_turn_apart(spark):
    """Both arcs are as short, so the one that isn't inverted is taken, whatever the order of the points."""
    x, y = half_turn()
    for r in (B.rect_from_points(x, y), B.rect_from_points(y, x)):
        assert value(spark, r["lng_lo"], r["lng_hi"]) == (-math.pi / 2, math.pi / 2)


def test_interval_of_longitudes_half_a_turn_apart(spark):
    x, y = half_turn()
    for s in (B.s1_pair(x["lng"], y["lng"]), B.s1_pair(y["lng"], x["lng"])):
        assert value(spark, B.s1_length(s), B.s1_contains(s, 0.0), B.s1_contains(s, 3.0)) == (math.pi, True, False)


def test_crossings_within_tracks_take_no_cells(spark):
    """Edges of a track meet by one join on the track: no keys along them, and no pair in two places."""
    rng = np.random.default_rng(3)
    ends = rng.normal(0, 0.3, (60, 2, 3)) + [1, 0, 0]
    ends /= np.linalg.norm(ends, axis=2, keepdims=True)
    ends[7, 0] = ends[4, 1]  # same track
    rows = [(k, k % 3, *[tuple(map(float, p)) for p in e]) for k, e in enumerate(ends)]
    point = "struct<x:double,y:double,z:double>"
    edges = spark.createDataFrame(rows, f"edge long, track long, a {point}, b {point}")
    left, right = (edges.withColumnRenamed("edge", n) for n in ("e", "f"))
    found = S.crossing_edges(left, right, 9, "e", "f", by="track", touching=True, ordered=True)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    cross = lambda e, f: bool(K.crossing(*ends[e], *ends[f]) == 1)
    wanted = [(e, f, (e, f) == (4, 7)) for e in range(60) for f in range(e + 1, 60) if e % 3 == f % 3 and (cross(e, f) or (e, f) == (4, 7))]
    assert sorted(map(tuple, found.collect())) == wanted
    inside = S.crossing_edges(left, right, 9, "e", "f", by="track", ordered=True)
    assert sorted(map(tuple, inside.collect())) == [(e, f) for e, f, shared in wanted if not shared]
    assert inside.count() < S.crossing_edges(left, right, 5, "e", "f", ordered=True).count()


def test_far_queries_measure_few_points(spark):
    """Queries far from all points, one of them at the pole, where many are about as far: cells rule out the rest."""
    q, qx = points(spark, 40, 5, "q")
    p, px = points(spark, 3000, 6, "id")
    p, q, keep = p.filter("p.z > 0"), q.filter("p.z < -0.2"), px[:, 2] > 0
    pairs = S._downwards(q, p, 3, "q", "id", 5)
    assert pairs.count() < q.count() * keep.sum() / 5
    wanted = {(i, n + 1, int(j)) for i in np.flatnonzero(qx[:, 2] < -0.2).tolist() for n, j in enumerate(sorted(np.flatnonzero(keep), key=lambda j: ((qx[i] - px[j]) ** 2).sum())[:3])}
    assert {(r["q"], r["rank"], r["id"]) for r in S.nearest(q, p, 3, "q", "id").collect()} == wanted
    assert S.nearest(q, p.filter("id < 0"), 3, "q", "id").count() == 0
    few = p.filter(F.col("id").isin([int(j) for j in np.flatnonzero(keep)[:2]]))
    assert S.nearest(q, few, 3, "q", "id").count() == 2 * q.count()


def test_nearest_with_a_limit_grows_to_it(spark, monkeypatch):
    """Queries with k points close by don't meet all points within the limit."""
    q, qx = points(spark, 30, 5, "q")
    p, px = points(spark, 3000, 6, "id")
    asked, within = [], S.pairs_within
    monkeypatch.setattr(S, "pairs_within", lambda left, *x, **y: asked.append(left.count()) or within(left, *x, **y))
    got = {(r["q"], r["rank"], r["id"]) for r in S.nearest(q, p, 2, "q", "id", max_radians=0.5).collect()}
    l2 = ((qx[:, None] - px) ** 2).sum(2)
    assert got == {(i, n + 1, int(j)) for i in range(30) for n, j in enumerate(np.argsort(l2[i])[:2]) if l2[i, j] < S.l2_of(0.5)}
    assert sum(asked) < 15


def test_term_join_of_points_needs_no_distinct(spark):
    """Each pair once, with the columns of both sides, and no aggregation of pairs."""
    p, _ = points(spark, 400, 6, "id")
    options = {"min_level": 2, "max_level": 8, "level_mod": 2}
    stored = p.select("id", "p", R.index_terms(F.array(C.parent(F.col("cell_id"), 8)), points_only=True, **options).alias("terms"))
    caps = p.filter("id < 20").select(F.col("id").alias("cap"), R.cap_covering(P.latitude(F.col("p")), P.longitude(F.col("p")), F.lit(0.3), max_cells=12, **options).alias("c"))
    asked = caps.select("cap", R.query_terms(F.col("c"), points_only=True, **options).alias("terms"))
    found = R.term_join_points(stored, asked)
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    rows = [(r["id"], r["cap"]) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {tuple(r) for r in R.term_join(stored, asked, "id", "cap").collect()}
