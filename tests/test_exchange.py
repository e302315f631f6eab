"""Binary forms, clipping, projected chains and nearest edges against plain computations."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbis.functions import cellid as C
from orbis.functions import clipping as L
from orbis.functions import points as P
from orbis.operators import kernels as K
from orbis.operators import search as S
from orbis.sources import codecs as Z


def value(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def test_integers_roundtrip_and_layout():
    for values in ([], [0], [1, 255], [256], [0, 2**64 - 1], list(range(70000, 70100))):
        data = Z.put_integers(np.array(values, np.uint64))
        r = Z.Reader(data)
        assert Z.get_integers(r).tolist() == values and r.at == len(data)
    assert Z.put_integers(np.array([1, 2, 300], np.uint64)) == bytes([3 * 8 | 1, 1, 0, 2, 0, 44, 1])
    assert [Z.varint(n) for n in (0, 127, 128, 300)] == [b"\0", b"\x7f", b"\x80\x01", b"\xac\x02"]
    assert Z.Reader(Z.varint(2**64 - 1)).varint() == 2**64 - 1


@pytest.mark.parametrize("level", [0, 1, 12, 28, 29, 30])
def test_cells_roundtrip(level):
    rng = np.random.default_rng(level)
    v = rng.normal(size=(40, 3))
    leaves = C.from_xyz(*v.T)
    for cells in (C.parent_np(leaves, level), C.parent_np(leaves[:1], level), np.concatenate([C.parent_np(leaves[:5], level), C.parent_np(leaves[5:9], max(0, level - 3))]), leaves[:0]):
        r = Z.Reader(Z.put_cells(cells))
        assert Z.get_cells(r).tolist() == cells.tolist()
        r.done()
        r = Z.Reader(Z.put_union(cells))
        assert Z.get_union(r).tolist() == cells.tolist()


def test_near_cells_are_short():
    first = int(C.parent_np(C.from_xyz(np.array([0.3]), np.array([0.4]), np.array([0.5])), 20)[0])
    step = 1 << (60 - 40 + 1)
    cells = np.array([first + k * step for k in range(100)], np.int64)
    assert len(Z.put_cells(cells)) < 100 + 16


def test_codec_columns(spark):
    rows = spark.createDataFrame([(1, [5, -9, 7]), (2, []), (3, None)], "k int, c array<bigint>")
    got = {r["k"]: r for r in rows.select("k", Z.decode_cells(Z.encode_cells("c")).alias("cells"), Z.decode_union(Z.encode_union("c")).alias("union"), Z.encode_union("c").alias("raw")).collect()}
    assert got[1]["cells"] == got[1]["union"] == [5, -9, 7] and got[2]["union"] == [] and got[3]["cells"] is None
    assert bytes(got[1]["raw"]) == struct.pack("<bqqqq", 1, 3, 5, -9, 7)
    chain = F.array(P.point_degrees(F.lit(1), F.lit(2)), P.point_degrees(F.lit(3), F.lit(4)))
    back = spark.range(1).select(chain.alias("c")).select("c", Z.decode_points(Z.encode_points("c")).alias("p"), Z.decode_polyline(Z.encode_polyline("c")).alias("l"), F.length(Z.encode_points("c")).alias("n")).first()
    assert back["p"] == back["l"] == back["c"] and back["n"] == 49
    bad = spark.createDataFrame([(b"\x02",), (b"",), (b"\x01\x05\0\0\0",), (b"\x01\0\0\0\0\0",)], "b binary")
    assert [r[0] for r in bad.select(Z.decode_polyline("b")).collect()] == [None] * 4
    assert [r[0] for r in bad.select(Z.decode_cells("b")).collect()] == [None] * 4
    rect = F.struct(F.lit(0.1).alias("lat_lo"), F.lit(0.2).alias("lat_hi"), F.lit(-1.0).alias("lng_lo"), F.lit(1.0).alias("lng_hi"))
    one = spark.range(1).select(rect.alias("r"), F.struct(P.point(1, 0, 0).alias("axis"), F.lit(0.5).alias("l2")).alias("c"))
    r = one.select(Z.encode_rect("r").alias("e"), Z.decode_rect(Z.encode_rect("r")).alias("d"), Z.decode_cap(Z.encode_cap(F.col("c"))).alias("c")).first()
    assert bytes(r["e"]) == struct.pack("<bdddd", 1, 0.1, 0.2, -1.0, 1.0) and tuple(r["d"]) == (0.1, 0.2, -1.0, 1.0)
    assert tuple(r["c"]["axis"]) == (1.0, 0.0, 0.0) and r["c"]["l2"] == 0.5


def test_zigzag_and_interleave(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(-(2**63), 2**63 - 1, 50), rng.integers(0, 2**32, 50), rng.integers(0, 2**32, 50))] + [(0, 0, 0), (-1, 2**32 - 1, 2**32 - 1), (1, 1, 0)]
    x, e, o = (F.col(k) for k in "xeo")
    for r in spark.createDataFrame(rows, "x long, e long, o long").select("*", Z.zigzag(x).alias("z"), Z.unzigzag(Z.zigzag(x)).alias("back"), Z.interleave(e, o).alias("i")).select("*", Z.deinterleave(F.col("i"), 0).alias("e2"), Z.deinterleave(F.col("i"), 1).alias("o2")).collect():
        assert r["back"] == r["x"] and r["z"] % 2**64 == (2 * r["x"] if r["x"] >= 0 else -2 * r["x"] - 1)
        assert (r["e2"], r["o2"]) == (r["e"], r["o"])
        assert r["i"] % 2**64 == sum(((r["e"] >> k & 1) | (r["o"] >> k & 1) << 1) << 2 * k for k in range(32))


def test_planar_clip(spark):
    rng = np.random.default_rng(4)
    rows = [tuple(map(float, v)) for v in rng.uniform(-3, 3, (200, 4))] + [(0.0, 0.0, 0.0, 0.0), (2.0, 2.0, 2.0, 2.0), (-2.0, 0.5, 2.0, 0.5), (1.0, -2.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "x0 double, y0 double, x1 double, y1 double")
    for r in df.withColumn("c", L.clip_planar(*(F.col(k) for k in ("x0", "y0", "x1", "y1")), -1.0, 1.0, -1.0, 1.0)).collect():
        t = np.linspace(0, 1, 4001)[:, None]
        along = np.array([r["x0"], r["y0"]]) + t * np.array([r["x1"] - r["x0"], r["y1"] - r["y0"]])
        inside = along[(np.abs(along) <= 1).all(1)]
        if len(inside):
            assert np.allclose([r["c"]["x0"], r["c"]["y0"]], inside[0], atol=4e-3) and np.allclose([r["c"]["x1"], r["c"]["y1"]], inside[-1], atol=4e-3)
        elif r["c"] is not None:
            assert math.hypot(r["c"]["x0"] - r["c"]["x1"], r["c"]["y0"] - r["c"]["y1"]) < 4e-3


def test_face_segments_cover_the_edge(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 2, 3))
    v /= np.linalg.norm(v, axis=2, keepdims=True)
    df = spark.createDataFrame([(k, *map(float, e.ravel())) for k, e in enumerate(v)], "k int, ax double, ay double, az double, bx double, by double, bz double")
    a, b = (P.point(F.col(f"{n}x"), F.col(f"{n}y"), F.col(f"{n}z")) for n in "ab")
    for r in df.select("k", L.face_segments(a, b).alias("s")).collect():
        total, faces = 0.0, set()
        for face, s in r["s"]:
            ends = [np.array(C.face_uv_to_xyz(np.array([face]), np.array([s[f"x{i}"]]), np.array([s[f"y{i}"]]))).ravel() for i in (0, 1)]
            ends = [e / np.linalg.norm(e) for e in ends]
            total += 2 * math.asin(np.linalg.norm(ends[0] - ends[1]) / 2)
            faces.add(face)
            assert max(abs(x) for x in s) <= 1 + 1e-9
        assert total == pytest.approx(2 * math.asin(np.linalg.norm(v[r["k"], 0] - v[r["k"], 1]) / 2), abs=1e-9)
        assert {int(np.ravel(C.xyz_to_face(*e.reshape(3, 1)))[0]) for e in v[r["k"]]} <= faces


@pytest.mark.parametrize("projection", ["plate_carree", "mercator"])
def test_tessellation(spark, projection):
    project, unproject = L.tessellator(projection)
    chain = [(10.0, 170.0), (60.0, -150.0), (-20.0, -100.0)]
    points = F.array(*[P.point_degrees(F.lit(a), F.lit(b)) for a, b in chain])
    r = spark.range(1).select(points.alias("c")).select("c", project("c", F.lit(1e-3)).alias("q")).withColumn("back", unproject("q", F.lit(1e-3))).first()
    xs = [p["x"] for p in r["q"]]
    assert len(xs) > 10 and max(abs(x - y) for x, y in zip(xs, xs[1:])) < 90 and xs[-1] == pytest.approx(260)
    ends = np.array([list(p) for p in r["c"]])
    edges = list(zip(ends, ends[1:]))
    mercator = projection == "mercator"
    for p, q in zip(r["q"], r["q"][1:]):
        for t in (0.1, 0.5, 0.8):
            at = L._sphere(np.array(p) + t * (np.array(q) - np.array(p)), mercator, 180.0)
            assert min(float(K.point_edge_l2(at[None], a, b)[0]) for a, b in edges) <= (1.3e-3) ** 2
    assert len(r["back"]) >= len(r["q"]) and np.allclose(list(r["back"][-1]), ends[-1])


def test_nearest_edges_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    la, lo = rng.uniform(30, 32, 120), rng.uniform(5, 7, 120)
    ends = [(k, float(la[k]), float(lo[k]), float(la[k] + rng.normal() * 0.2), float(lo[k] + rng.normal() * 0.2)) for k in range(60)]
    edges = spark.createDataFrame(ends, "edge int, la double, lo double, lb double, ob double").select("edge", P.point_degrees(F.col("la"), F.col("lo")).alias("a"), P.point_degrees(F.col("lb"), F.col("ob")).alias("b"))
    pts = S.with_cells(spark.createDataFrame([(k, float(la[k]), float(lo[k])) for k in range(60, 120)], "pt int, la double, lo double").select("pt", P.point_degrees(F.col("la"), F.col("lo")).alias("p")))
    e = {r["edge"]: (np.array(list(r["a"])), np.array(list(r["b"]))) for r in edges.collect()}
    want = {}
    for r in pts.collect():
        near = sorted((float(K.point_edge_l2(np.array([list(r["p"])]), *e[k])[0]), k) for k in e)
        want[r["pt"]] = [k for d, k in near if d < S.l2_of(0.01)][:4]
    got: dict = {k: [] for k in want}
    for r in sorted(S.nearest_edges(pts, edges, 4, "pt", "edge", max_radians=0.01, start_radians=0.0025).collect(), key=lambda r: (r["pt"], r["rank"])):
        got[r["pt"]].append(r["edge"])
    assert got == want


def test_points_of_edges_and_furthest_edges(spark):
    rng = np.random.default_rng(7)
    ends = [(k, float(a), float(b), float(a + c), float(b + d)) for k, (a, b, c, d) in enumerate(zip(rng.uniform(30, 31, 20), rng.uniform(5, 6, 20), *rng.normal(size=(2, 20)) * 0.1))]
    edges = spark.createDataFrame(ends, "edge int, la double, lo double, lb double, ob double").select("edge", P.point_degrees(F.col("la"), F.col("lo")).alias("a"), P.point_degrees(F.col("lb"), F.col("ob")).alias("b"))
    near = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(30, 31, 50), rng.uniform(5, 6, 50)))], "pt int, la double, lo double")
    pts = S.with_cells(near.select("pt", P.point_degrees(F.col("la"), F.col("lo")).alias("p")))
    xyz = {r["pt"]: np.array([list(r["p"])]) for r in pts.collect()}
    e = {r["edge"]: (np.array(list(r["a"])), np.array(list(r["b"]))) for r in edges.collect()}
    got: dict = {k: [] for k in e}
    for r in S.nearest_points_to_edges(edges, pts, 3, "edge", "pt", max_radians=0.005).orderBy("edge", "rank").collect():
        got[r["edge"]].append(r["pt"])
    assert got == {k: [p for d, p in sorted((float(K.point_edge_l2(xyz[p], *e[k])[0]), p) for p in xyz) if d < S.l2_of(0.005)][:3] for k in e}
    anti = pts.withColumn("p", P.neg(F.col("p")))
    far: dict = {k: [] for k in xyz}
    for r in S.furthest_edges(anti, edges, 2, "pt", "edge", min_radians=math.pi - 0.005).orderBy("pt", "rank").collect():
        far[r["pt"]].append(r["edge"])
        assert 3.99 < r["l2"] <= 4
    assert far == {p: [k for d, k in sorted((float(K.point_edge_l2(xyz[p], *e[k])[0]), k) for k in e) if d < S.l2_of(0.005)][:2] for p in xyz}
    with pytest.raises(ValueError):
        S.edges_within(pts, edges, 1.0, "pt", "edge")


def test_feature_density(spark):
    from orbis.operators import density as D

    leaf = int(C.from_xyz(np.array([0.6]), np.array([0.5]), np.array([0.4]))[0])
    at = lambda level: int(C.parent_np(np.array([leaf]), level)[0])
    rows = [(1, at(2), 3), (1, at(6), 3), (2, at(6), 5), (2, at(7), 5)]
    got = {r["cell_id"]: r["weight"] for r in D.feature_density(spark.createDataFrame(rows, "f int, cell_id long, w long"), "f", 4, "w").collect()}
    assert got[at(4)] == got[at(3)] == got[at(2)] == got[at(0)] == 8 and len(got) == 16 + 4 + 3
    assert sorted(got.values()) == [3] * 18 + [8] * 5


@pytest.mark.parametrize("radius", [0.003, 0.03])
def test_tiles_in_parts_equal_brute_force(spark, monkeypatch, radius):
    """Small tiles dealt out in parts: every pair once, and with k no more than k of each point leave a part."""
    from orbis.operators import tiles

    for name, value in (("POINTS_A_TILE", 5), ("MOST_POINTS", 7), ("MOST_EDGES", 9), ("BLOCK", 64)):
        monkeypatch.setattr(tiles, name, value)
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    p = unit(rng.normal(0, 0.02, (150, 3)) + [0.7, 0.7, 0.1])  # about an edge of the cube
    p[:30] = p[0]
    ends = unit(p[rng.integers(0, 150, 40)][:, None] + rng.normal(0, 0.05, (40, 2, 3)) * [[[0], [1]]])
    ends[0, 1] = ends[0, 0]  # no length
    ends[1] = unit(np.array([[1, -0.9, 0.1], [-0.9, 1, 0.1]]))  # far over other faces
    point = "struct<x:double,y:double,z:double>"
    xyz = lambda v: tuple(map(float, v))
    pts = S.with_cells(spark.createDataFrame([(k, xyz(x)) for k, x in enumerate(p)], f"pt long, p {point}"))
    edges = spark.createDataFrame([(k, xyz(a), xyz(b)) for k, (a, b) in enumerate(ends)], f"edge long, a {point}, b {point}")
    d = np.stack([K.point_edge_l2(p, a, b) for a, b in ends], 1)
    wanted = {(i, j) for i, j in zip(*map(lambda x: x.tolist(), np.nonzero(d < S.l2_of(radius))))}
    found = [(r["pt"], r["edge"]) for r in S.edges_within(pts, edges, radius, "pt", "edge").collect()]
    assert len(found) == len(set(found)) and set(found) == wanted
    near = {(r["pt"], r["rank"]): r["edge"] for r in S.nearest_edges(pts, edges, 2, "pt", "edge", max_radians=radius).collect()}
    assert near == {(i, n + 1): j for i in range(150) for n, j in enumerate(sorted((j for j in range(40) if (i, j) in wanted), key=lambda j: (d[i, j], j))[:2])}
    near = {(r["edge"], r["rank"]): r["pt"] for r in S.nearest_points_to_edges(edges, pts, 3, "edge", "pt", max_radians=radius).collect()}
    assert near == {(j, n + 1): i for j in range(40) for n, i in enumerate(sorted((i for i in range(150) if (i, j) in wanted), key=lambda i: (d[i, j], i))[:3])}


def test_chains_between_arrow_and_numpy():
    """Nulls, empty chains and slices survive; a chain is a view of its batch, not an object for each point."""
    import pyarrow as pa

    from orbis.functions import arrow as W

    point = pa.struct([(k, pa.float64()) for k in "xyz"])
    p = lambda *xs: [{"x": float(x), "y": x + 0.5, "z": -float(x)} for x in xs]
    lists = [p(1, 2), None, [], p(3), p(4, 5, 6)]
    column = pa.array(lists, pa.list_(point))
    for part, want in ((column, lists), (column.slice(2), lists[2:]), (column.slice(1, 3), lists[1:4]), (column.slice(5), [])):
        rows = W.chains(part)
        assert [None if r is None else [dict(zip("xyz", x)) for x in r.tolist()] for r in rows] == want
        assert W.points_of(rows).cast(pa.list_(point)).to_pylist() == want
    rows = W.chains(column)
    assert rows[0].base is rows[4].base and rows[0].base.shape == (6, 3)
    nested = pa.array([[p(1), []], None, [], [p(2, 3)]], pa.list_(pa.list_(point)))
    for part in (nested, nested.slice(1), nested.slice(3)):
        assert W.shapes_of(W.shapes(part)).to_pylist() == part.to_pylist()


def test_polygon_kernels_judge_points_and_edges_together(monkeypatch):
    """One call for a whole polyline, not one an edge; blocks give the same."""
    from orbis.operators import areas as A

    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    chain = unit(rng.normal(0, 0.3, (80, 3)) + [1, 0, 0])
    t = np.linspace(0, 2 * math.pi, 7)[:-1]
    loops = [unit(np.stack([np.ones(6), 0.2 * np.cos(t), 0.2 * np.sin(t)], 1))]
    chain[5], chain[9] = loops[0][2], unit(loops[0][0] + loops[0][1])
    calls, crossing = [], K.crossing
    monkeypatch.setattr(K, "crossing", lambda *x: calls.append(1) or crossing(*x))
    whole = [A.polyline_parts(chain, loops, inside) for inside in (True, False)]
    assert len(calls) <= 6
    monkeypatch.setattr(K, "PAIRS", 1)
    for inside, parts in zip((True, False), whole):
        again = A.polyline_parts(chain, loops, inside)
        assert len(again) == len(parts) > 3 and all(np.array_equal(x, y) for x, y in zip(again, parts))


def test_tessellation_judges_probes_in_plain_floats(monkeypatch):
    """As kernels.point_edge_l2() does, without a call of it for each piece."""
    rng = np.random.default_rng(10)
    cases = []
    for _ in range(300):
        p0, p1 = (x / np.linalg.norm(x) for x in rng.normal(size=(2, 3)) * [[1, 1, 0.3]])
        mercator = bool(rng.integers(2))
        q0, q1 = L._plane(p0, mercator, 180.0), L._plane(p1, mercator, 180.0)
        probes = np.array([L._sphere(q0 + t * (q1 - q0), mercator, 180.0) for t in L.PROBES])
        limit = float(np.median(K.point_edge_l2(probes, p0, p1))) * rng.uniform(0.5, 3)
        cases.append((p0, p1, q0, q1, limit, mercator, bool((K.point_edge_l2(probes, p0, p1) <= limit).all())))
    monkeypatch.setattr(K, "point_edge_l2", None)
    found = [L._fits(*c[:-1], 180.0) for c in cases]
    assert found == [c[-1] for c in cases] and 20 < sum(found) < 280


@pytest.mark.parametrize("clustered", [False, True])
def test_hausdorff_in_parts_of_tiles_equals_brute_force(spark, monkeypatch, clustered):
    """Small tiles dealt out in parts, points of b doubled; clustered, most points of a have nothing within a tile's reach."""
    from orbis.operators import search, tiles

    for name, value in (("POINTS_A_TILE", 8), ("MOST_NEAR", 16), ("TRIES", 2)):
        monkeypatch.setattr(tiles, name, value)
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    p, q = unit(rng.normal(size=(300, 3))), rng.normal(size=(200, 3))
    q = unit(np.array([1.0, 2, 3]) + 0.05 * q if clustered else q)
    q = np.concatenate([q, q[:50]])
    table = lambda v, name: search.with_cells(spark.createDataFrame([(i, tuple(map(float, x))) for i, x in enumerate(v)], f"{name} long, p struct<x:double,y:double,z:double>"))
    a, b = table(p, "i"), table(q, "j")
    l2 = ((p[:, None] - q[None]) ** 2).sum(2)
    assert search.directed_hausdorff(a, b, "i", "j").first()[0] == pytest.approx(l2.min(1).max(), abs=1e-14)
    assert search.directed_hausdorff(b, a, "j", "i").first()[0] == pytest.approx(l2.min(0).max(), abs=1e-14)


def test_hausdorff_of_dense_points_ranks_no_pairs(spark, monkeypatch):
    """Points with another within a tile's reach are settled there: no disc is joined, and one row leaves a tile."""
    from orbis.operators import search, tiles

    rows = spark.range(4000).selectExpr("id i", "40 + id * 7919 % 10007 / 10007.0D lat", "-74 + id * 104729 % 10009 / 10009.0D lng")
    points = search.with_cells(rows.select("i", P.point_degrees(F.col("lat"), F.col("lng")).alias("p")))
    monkeypatch.setattr(search, "nearest", None)
    others = points.withColumnRenamed("i", "j")
    assert search.directed_hausdorff(points, others, "i", "j").first()[0] == 0
    level = tiles.near_level(points)
    assert level > 4
    assert tiles.nearest_distances(points, others, "i", level).count() == points.select(C.parent(F.col("cell_id"), level)).distinct().count()


def test_hausdorff_without_points(spark):
    from orbis.operators import search

    some = search.with_cells(spark.createDataFrame([(1, (1.0, 0.0, 0.0)), (2, None)], "i long, p struct<x:double,y:double,z:double>"))
    others = some.withColumnRenamed("i", "j")
    assert search.directed_hausdorff(some, others.limit(0), "i", "j").first()[0] is None
    assert search.directed_hausdorff(some.limit(0), others, "i", "j").first()[0] is None
    assert search.directed_hausdorff(some, others, "i", "j").first()[0] == 0
