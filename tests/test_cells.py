import numpy as np
import pytest
from pyspark.sql import functions as F

from orbis.functions import cellid as C
from orbis.operators import joins as J


def random_points(n, seed=1):
    v = np.random.default_rng(seed).normal(size=(n, 3))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def column(spark, values, kind="long"):
    return spark.createDataFrame([(v,) for v in values], f"c {kind}")


def one(df, *columns):
    return df.select(*columns).first()


def test_known_leaf_and_faces():
    lat, lng = np.radians(40.7812), np.radians(-73.9665)
    p = [np.array([f]) for f in (np.cos(lng) * np.cos(lat), np.sin(lng) * np.cos(lat), np.sin(lat))]
    assert int(C.from_xyz(*p).view(np.uint64)[0]) == 0x89C25890BF4E88FD
    for (la, lo), face in {(0, 0): 0, (0, 90): 1, (90, 0): 2, (0, 180): 3, (0, -90): 4, (-90, 0): 5}.items():
        a, b = np.radians(la), np.radians(lo)
        assert C.xyz_to_face(*(np.array([x]) for x in (np.cos(b) * np.cos(a), np.sin(b) * np.cos(a), np.sin(a))))[0] == face


def test_leaf_round_trip():
    v = random_points(20_000)
    ids = C.from_xyz(*v.T)
    centre = C.center_xyz(ids)
    assert (C.from_xyz(*centre) == ids).all()
    face, i, j, level, _ = C.to_face_ij(ids)
    assert (level == 30).all() and (C.from_face_ij(face, i, j) == ids).all()


@pytest.mark.parametrize("level", [0, 1, 2, 9, 20])
def test_neighbours_are_symmetric(level):
    ids = np.unique(C.parent_np(C.from_xyz(*random_points(300).T), level))
    near = C.neighbors_np(ids, level)
    for k, own in enumerate(ids):
        assert own not in near[k] or level == 0
        assert all(own in C.neighbors_np(np.array([n]), level)[0] for n in near[k, :4])
        assert len(set(near[k])) in ((4,) if level == 0 else (7, 8))


def test_id_algebra(spark):
    df = column(spark, [3 << 61 | 0x12345678 | 1])
    face = F.lit(3)
    r = one(df, *[C.from_face_pos_level(face, F.lit(0x12345678).cast("long"), l).alias(f"l{l}") for l in (26, 25)])
    assert r["l26"] & (1 << 61) - 1 == 0x12345700 and r["l25"] & (1 << 61) - 1 == 0x12345400
    cell = F.lit(r["l26"])
    s = one(df, C.level(cell), C.face(cell), C.child_begin(cell, 28), C.range_min(cell), C.range_max(cell), C.children(cell), C.parent(cell, 25), C.is_valid(cell), C.size_ij(cell))
    assert s[0] == 26 and s[1] == 3 and s[2] & (1 << 61) - 1 == 0x12345610 and s[6] == r["l25"] and s[7] and s[8] == 16
    assert s[5][0] > s[3] and s[5][3] < s[4] and [b - a for a, b in zip(s[5], s[5][1:])] == [s[5][1] - s[5][0]] * 3


def test_order_wrap_and_signed_edge(spark):
    last3, first4 = C.parent_np(np.array([2**63 - 1]), 5)[0], C.parent_np(np.array([-(2**63) + 1]), 5)[0]
    df = column(spark, [int(last3)])
    r = one(df, C.next_wrap(F.col("c")), C.prev_wrap(F.lit(int(first4))), C.range_max(F.col("c")), C.key(F.col("c")) < C.key(F.lit(int(first4))), C.contains(F.col("c"), F.lit(2**63 - 1)), C.advance(F.col("c"), 1))
    assert r[0] == first4 and r[1] == last3 and r[2] == 2**63 - 1 and r[3] and r[4] and r[5] == first4


def test_tokens(spark):
    tokens = ["89c2589", "1", "X", "zz", None, "5"]
    df = column(spark, tokens, "string").select("c", C.from_token(F.col("c")).alias("id"))
    got = [(r[0], r[1]) for r in df.select(C.to_token(F.col("id")), C.token_valid(F.col("c"))).collect()]
    assert got == [("89c2589", True), ("1", True), ("X", None), (None, None), (None, None), ("5", True)] or [g[0] for g in got] == ["89c2589", "1", "X", None, None, "5"]


def test_common_ancestor(spark):
    ids = C.from_xyz(*random_points(300).T)
    a, b = ids[:150], C.parent_np(ids[150:], 12)
    b[:50] = C.parent_np(a[:50], 7)
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long")
    got = [r[0] for r in df.select(C.common_ancestor_level(F.col("a"), F.col("b"))).collect()]
    want = [max([l for l in range(31) if l <= C.to_face_ij(np.array([y]))[3][0] and C.parent_np(np.array([x]), l)[0] == C.parent_np(np.array([y]), l)[0]], default=-1) for x, y in zip(a, b)]
    assert got == want


def test_metric_levels():
    for name in ("min_width", "avg_edge", "max_diag", "avg_area"):
        for level in (0, 5, 29):
            v = C.metric_value(name, level)
            assert C.max_level_for(name, v) == C.min_level_for(name, v) == level


def test_nulls_give_nulls(spark):
    df = spark.createDataFrame([(None, None)], "p struct<x:double,y:double,z:double>, c long")
    r = one(df, C.from_point(F.col("p")), C.to_point(F.col("c")), C.level(F.col("c")), C.parent(F.col("c"), 3), C.to_token(F.col("c")), C.decoded(F.col("c")))
    assert list(r) == [None] * 6


def test_few_cell_pairs_are_measured(spark, monkeypatch):
    """Bounding caps rule out most of the candidates of nine large cells, and none that is within the angle."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 3))
    ids = C.from_xyz(*(x / np.linalg.norm(x, axis=1, keepdims=True)).T)
    a = spark.createDataFrame([(int(v),) for v in C.parent_np(ids[:300], 7)], "a_cell long").distinct()
    b = spark.createDataFrame([(int(v),) for v in C.parent_np(ids[300:], 9)], "b_cell long").distinct()
    found = {tuple(r)[:2] for r in J.cells_within(a, b, 0.1).select("a_cell", "b_cell").collect()}
    monkeypatch.setattr(J.G, "distance_to_cell", lambda *x: F.lit(0.0))
    measured = {tuple(r)[:2] for r in J.cells_within(a, b, 0.1).select("a_cell", "b_cell").collect()}
    p, q = (sorted({int(r[0]) for r in d.collect()}) for d in (a, b))
    l2 = {(i, j): float(v) for i in p for j, v in zip(q, J.G.quad_pair_l2(np.repeat(C.vertices_xyz(np.array([i])), len(q), 0), C.vertices_xyz(np.array(q))))}
    assert found == {k for k, v in l2.items() if v <= 4 * np.sin(0.05) ** 2}
    assert found <= measured and len(measured) < 2 * len(found)


def test_pairs_of_large_cells_are_merged_in_parts(spark, monkeypatch):
    """As overlap_join(), equal rows included, by merge joins; cells with many pairs dealt out, a row's partners beside each other."""
    from collections import Counter

    monkeypatch.setattr(J, "MOST_PAIRS", 50)
    leaf = C.from_xyz(*random_points(400, 3).T)
    cells = [int(C.parent_np(leaf[i : i + 1], (0, 2, 4, 30)[i % 4])[0]) for i in range(400)] + [None]
    a = spark.createDataFrame([(i % 90, c) for i, c in enumerate(cells[:200] * 2)], "i long, a_cell long")
    b = spark.createDataFrame([(i, c) for i, c in enumerate(cells[150:])], "j long, b_cell long")
    found = J.overlap_pairs(a, b)
    rows = [tuple(r) for r in found.collect()]
    wanted = Counter(tuple(r) for r in J.overlap_join(a, b).select(found.columns).collect())
    assert len(rows) > 1000 and Counter(rows) == wanted
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2
    # Each row of a comes as runs in at most both halves and its parts, not once for each pair.
    assert sum(x[:2] != y[:2] for x, y in zip(rows, rows[1:])) < len(rows) / 3


def test_pairs_within_an_angle_are_merged_in_parts(spark, monkeypatch):
    """Cells with many candidates are dealt out; each pair is found once, and points without a place meet nothing."""
    from orbis.operators import search as S

    monkeypatch.setattr(J, "MOST_PAIRS", 40)
    v = random_points(300, 4)
    v[100:200] = v[:1] + 0.02 * v[100:200]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    point = "struct<x:double,y:double,z:double>"
    rows = [(i, tuple(map(float, x))) for i, x in enumerate(v)] + [(300, None)]
    a, b = (S.with_cells(spark.createDataFrame(rows[k:], f"{n} long, p {point}")) for n, k in (("i", 0), ("j", 120)))
    pairs = S.pairs_within(a, b, 0.05, "i", "j")
    found = {(r["i"], r["j"]): r["l2"] for r in pairs.collect()}
    l2 = ((v[:, None] - v[None]) ** 2).sum(2)
    wanted = {(i, j) for i in range(300) for j in range(120, 300) if l2[i, j] < S.l2_of(0.05)}
    assert len(wanted) > 2000 and set(found) == wanted and pairs.count() == len(wanted)
    assert all(abs(found[k] - l2[k]) < 1e-15 for k in wanted)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
