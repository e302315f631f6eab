"""Every query of the geometry library with, where SQL can express it, its DuckDB equivalent."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbis.functions import bounds as B
from orbis.functions import cellid as C
from orbis.functions import cells as G
from orbis.functions import clipping as L
from orbis.functions import points as P
from orbis.functions import shapes as H
from orbis.operators import density as D
from orbis.operators import joins as J
from orbis.operators import regions as R
from orbis.operators import search as S
from orbis.operators import unions as U
from orbis.plans import sql as Q
from orbis.session import materialize
from orbis.sources import codecs as Z
from orbis.sources import tables as T
from orbis.sources import text as X

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bind_columns()
            return f(spark, sf_dir)

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rd(c: Column, digits: int = 7) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """A few rows whose kernels take long, dealt to all cores."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, key)


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three points for each event: lat/lngs al, bl, cl and points a, b, c."""
    k = F.col("event_id").cast("long")
    rows = T.read(spark, sf_dir, "events").select(k.alias("id"), *[P.latlng_degrees(*T.degrees_of(e)).alias(n) for n, e in (("al", k), ("bl", k * 31 + 17), ("cl", k * 57 + 101))])
    return rows.select("*", *[P.to_point(F.col(f"{n}l")).alias(n) for n in "abc"])


a: Column
b: Column
c: Column
al: Column
bl: Column
cl: Column
cell: Column


def bind_columns() -> None:
    """Columns can only be named once there is a session, so the names above are bound by the first query."""
    if "cell" not in globals():
        globals().update({n: F.col(n) for n in ("a", "b", "c", "al", "bl", "cl")} | {"cell": F.col("cell_id")})


TR = f"WITH {Q.triple()}"
va, vb, vc = Q.vec("a"), Q.vec("b"), Q.vec("c")
PI = math.pi


# --- Scalars: points, angles, Earth ---------------------------------------------------------------


@query(f"{TR} SELECT id, {Q.r('ax')} AS x, {Q.r('ay')} AS y, {Q.r('az')} AS z FROM t")
def pt_from_latlng(spark, sf):
    return triples(spark, sf).select("id", *[rd(a[k]).alias(k) for k in "xyz"])


@query(f"{TR} SELECT id, {Q.r('degrees(atan2(az, sqrt(ax * ax + ay * ay)))')} AS lat, {Q.r('degrees(atan2(ay, ax))')} AS lng FROM t")
def latlng_from_pt(spark, sf):
    ll = P.to_latlng(a)
    return triples(spark, sf).select("id", rd(F.degrees(ll["lat"])).alias("lat"), rd(F.degrees(ll["lng"])).alias("lng"))


@query(f"{TR} SELECT id, {Q.r('greatest(-pi() / 2, least(pi() / 2, 2 * a_lat))')} AS lat, {Q.r('3 * a_lng - round_even(3 * a_lng / (2 * pi()), 0) * 2 * pi()')} AS lng, (abs(2 * a_lat) <= pi() / 2 AND abs(3 * a_lng) <= pi()) AS valid FROM t")
def latlng_normalize(spark, sf):
    x = P.latlng(al["lat"] * 2, al["lng"] * 3)
    n = P.latlng_normalized(x)
    return triples(spark, sf).select("id", rd(n["lat"]).alias("lat"), rd(n["lng"]).alias("lng"), P.latlng_valid(x).alias("valid"))


@query(f"{TR} SELECT id, floor(degrees(a_lat) * 1e5 + 0.5)::INT AS lat5, floor(degrees(a_lng) * 1e6 + 0.5)::INT AS lng6, {Q.r('radians(floor(degrees(a_lat) * 1e7 + 0.5) * 1e-7)', 9)} AS lat FROM t")
def e7_roundtrip(spark, sf):
    back = P.latlng_e(P.to_e(al["lat"], 7), P.to_e(al["lng"], 7), 7)
    return triples(spark, sf).select("id", P.to_e(al["lat"], 5).alias("lat5"), P.to_e(al["lng"], 6).alias("lng6"), rd(back["lat"], 9).alias("lat"))


_hav = "2 * asin(sqrt(least(1.0, pow(sin((b_lat - a_lat) / 2), 2) + pow(sin((b_lng - a_lng) / 2), 2) * cos(a_lat) * cos(b_lat))))"


@query(f"{TR} SELECT id, {Q.r(f'{_hav} * 6371.010', 5)} AS km, {Q.r(Q.angle(va, vb) + ' * 6371010', 2)} AS m FROM t")
def haversine_km(spark, sf):
    return triples(spark, sf).select("id", rd(P.haversine(al, bl) * (P.EARTH_RADIUS_M / 1000), 5).alias("km"), rd(P.meters(P.angle_between(a, b)), 2).alias("m"))


@query(f"{TR} SELECT id, {Q.r('degrees(atan2(sin(b_lng - a_lng) * cos(b_lat), cos(a_lat) * sin(b_lat) - sin(a_lat) * cos(b_lat) * cos(b_lng - a_lng)))', 6)} AS bearing FROM t")
def bearing(spark, sf):
    return triples(spark, sf).select("id", rd(F.degrees(P.initial_bearing(al, bl)), 6).alias("bearing"))


@query(f"{TR}, u AS (SELECT *, {Q.l2(va, vb)} AS l FROM t) SELECT id, {Q.r('l')} AS l2, {Q.r('2 * asin(0.5 * sqrt(l))')} AS radians, {Q.r('sqrt(l * (1 - 0.25 * l))')} AS sin, {Q.r('1 - 0.5 * l')} AS cos FROM u")
def chord_l2(spark, sf):
    rows = triples(spark, sf).select("id", P.chord(a, b).alias("l"))
    l = F.col("l")
    return rows.select("id", rd(l).alias("l2"), rd(P.chord_radians(l)).alias("radians"), rd(P.chord_sin(l)).alias("sin"), rd(P.chord_cos(l)).alias("cos"))


_add = "CASE WHEN p + q >= 4 THEN 4.0 ELSE least(4.0, p * (1 - 0.25 * q) + q * (1 - 0.25 * p) + 2 * sqrt(p * (1 - 0.25 * q) * q * (1 - 0.25 * p))) END"
_sub = "CASE WHEN p <= q THEN 0.0 ELSE pow(sqrt(p * (1 - 0.25 * q)) - sqrt(q * (1 - 0.25 * p)), 2) END"


@query(f"{TR}, u AS (SELECT *, {Q.l2(va, vb)} AS p, {Q.l2(vb, vc)} AS q FROM t) SELECT id, {Q.r(_add, 6)} AS plus, {Q.r(_sub, 6)} AS minus FROM u")
def chord_add(spark, sf):
    rows = triples(spark, sf).select("id", P.chord(a, b).alias("p"), P.chord(b, c).alias("q"))
    return rows.select("id", rd(P.chord_add(F.col("p"), F.col("q")), 6).alias("plus"), rd(P.chord_sub(F.col("p"), F.col("q")), 6).alias("minus"))


@query(f"{TR} SELECT id, {Q.r(Q.angle(va, vb))} AS angle, {Q.r(Q.dot(va, vb))} AS dot, {Q.r(Q.cross(va, vb)[0])} AS cx, {Q.r(Q.cross(va, vb)[2])} AS cz, {Q.r(Q.dot(va, Q.cross(vb, vc)))} AS triple FROM t")
def cross_dot(spark, sf):
    x = P.cross(a, b)
    return triples(spark, sf).select("id", rd(P.angle_between(a, b)).alias("angle"), rd(P.dot(a, b)).alias("dot"), rd(x["x"]).alias("cx"), rd(x["z"]).alias("cz"), rd(P.triple(a, b, c)).alias("triple"))


@query(f"{TR} SELECT id, {Q.r('a_lng * 180 / pi()', 6)} AS x, {Q.r('0.5 * ln((1 + sin(a_lat)) / (1 - sin(a_lat))) * 180 / pi()', 5)} AS y, {Q.r('a_lat * 180 / pi()', 6)} AS plate_y FROM t")
def mercator(spark, sf):
    m = P.mercator(al)
    return triples(spark, sf).select("id", rd(m["x"], 6).alias("x"), rd(m["y"], 5).alias("y"), rd(P.plate_carree(al)["y"], 6).alias("plate_y"))


def _rot_sql() -> str:
    k = Q.cross(vb, va)
    return ", ".join(f"{Q.r(f'{va[i]} * cos(0.7) + {k[i]} * sin(0.7) + {vb[i]} * {Q.dot(vb, va)} * (1 - cos(0.7))')} AS {'xyz'[i]}" for i in range(3))


@query(f"{TR} SELECT id, {_rot_sql()} FROM t")
def rotate_point(spark, sf):
    p = P.rotate(a, b, 0.7)
    return triples(spark, sf).select("id", *[rd(p[k]).alias(k) for k in "xyz"])


# --- Intervals, rectangles, caps ------------------------------------------------------------------


@query(
    f"""{TR}, u AS (SELECT id, least(a_lat, b_lat) AS l, greatest(a_lat, b_lat) AS h, c_lat AS x, a_lng, b_lng, c_lng FROM t)
    SELECT id, {Q.r('h - l')} AS length, (x BETWEEN l AND h) AS has, {Q.r('greatest(l, least(h, x))')} AS clamped, {Q.r('CASE WHEN abs(b_lng - a_lng) <= pi() THEN abs(b_lng - a_lng) ELSE 2 * pi() - abs(b_lng - a_lng) END')} AS s1_length,
    CASE WHEN abs(b_lng - a_lng) <= pi() THEN c_lng BETWEEN least(a_lng, b_lng) AND greatest(a_lng, b_lng) ELSE c_lng >= greatest(a_lng, b_lng) OR c_lng <= least(a_lng, b_lng) END AS s1_has FROM u"""
)
def interval_ops(spark, sf):
    i, s = B.r1_pair(al["lat"], bl["lat"]), B.s1_pair(al["lng"], bl["lng"])
    return triples(spark, sf).select("id", rd(B.r1_length(i)).alias("length"), B.r1_contains(i, cl["lat"]).alias("has"), rd(B.r1_clamp(i, cl["lat"])).alias("clamped"), rd(B.s1_length(s)).alias("s1_length"), B.s1_contains(s, cl["lng"]).alias("s1_has"))


_span = "(CASE WHEN abs(b_lng - a_lng) <= pi() THEN abs(b_lng - a_lng) ELSE 2 * pi() - abs(b_lng - a_lng) END)"


@query(f"{TR} SELECT id, {Q.r('least(a_lat, b_lat)')} AS lat_lo, {Q.r('greatest(a_lat, b_lat)')} AS lat_hi, {Q.r(f'{_span} * (sin(greatest(a_lat, b_lat)) - sin(least(a_lat, b_lat)))')} AS area, {Q.r('CASE WHEN abs(b_lng - a_lng) <= pi() THEN least(a_lng, b_lng) ELSE greatest(a_lng, b_lng) END')} AS lng_lo FROM t")
def rect_from_points(spark, sf):
    r = B.rect_from_points(al, bl)
    return triples(spark, sf).select("id", rd(r["lat_lo"]).alias("lat_lo"), rd(r["lat_hi"]).alias("lat_hi"), rd(B.rect_area(r)).alias("area"), rd(r["lng_lo"]).alias("lng_lo"))


_RECTS = "rc AS (SELECT r_regionkey::BIGINT AS rect, radians(-60.0::DOUBLE + 20 * r_regionkey) AS la, radians(-45.0::DOUBLE + 20 * r_regionkey) AS lb, radians(-150.0::DOUBLE + 60 * r_regionkey) AS oa, radians(-100.0::DOUBLE + 60 * r_regionkey) AS ob FROM region)"


@query(f"WITH {Q.EV}, {_RECTS} SELECT rect, id FROM ev, rc WHERE lat BETWEEN la AND lb AND lng BETWEEN oa AND ob")
def rect_contains(spark, sf):
    """Points in rectangles: candidates by the rectangles' coverings, then the exact test."""
    zones = spread(T.rects(spark, sf), "rect").withColumn("covering", R.rect_covering(F.col("r"), max_cells=16, max_level=12))
    pairs = J.zones_join(S.with_cells(T.event_points(spark, sf)), materialize(zones, "rects"))
    return pairs.filter(B.rect_contains(F.col("r"), F.col("ll"))).select("rect", "id")


@query(f"WITH {Q.LOCAL} SELECT user_id, {Q.r('min(lat)')} AS lat_lo, {Q.r('max(lat)')} AS lat_hi, {Q.r('min(lng)')} AS lng_lo, {Q.r('max(lng)')} AS lng_hi FROM lo GROUP BY user_id")
def rect_union_agg(spark, sf):
    r = B.rect_bound(F.col("ll.lat"), F.col("ll.lng"))
    rows = T.local_points(spark, sf).groupBy("user_id").agg(r.alias("r"))
    return rows.select("user_id", *[rd(F.col(f"r.{k}")).alias(k) for k in ("lat_lo", "lat_hi", "lng_lo", "lng_hi")])


@query(f"WITH {_RECTS} SELECT rect, {Q.r('(ob - oa) * (sin(lb) - sin(la))')} AS area, {Q.r('(la + lb) / 2')} AS lat, {Q.r('(oa + ob) / 2')} AS lng FROM rc")
def rect_area(spark, sf):
    r = F.col("r")
    return T.rects(spark, sf).select("rect", rd(B.rect_area(r)).alias("area"), rd(B.rect_center(r)["lat"]).alias("lat"), rd(B.rect_center(r)["lng"]).alias("lng"))


@query(f"{TR} SELECT id, ({Q.l2(va, vb)} <= 1.5) AS has, {Q.r('2 * pi() * 0.75')} AS area, {Q.r('2 * asin(0.5 * sqrt(1.5))')} AS angle, ({Q.angle(va, vb)} <= 2 * asin(0.5 * sqrt(1.5)) + 2 * asin(0.5 * sqrt(0.1))) AS meets FROM t")
def cap_contains(spark, sf):
    k = B.cap(a, 1.5)
    return triples(spark, sf).select("id", B.cap_contains(k, b).alias("has"), rd(B.cap_area(k)).alias("area"), rd(B.cap_angle(k)).alias("angle"), B.cap_intersects(k, B.cap(b, 0.1)).alias("meets"))


# --- Triangles and edges --------------------------------------------------------------------------

_girard = f"greatest(0.0, {Q.angle(Q.cross(va, vb), Q.cross(va, vc))} - {Q.angle(Q.cross(va, vb), Q.cross(vb, vc))} + {Q.angle(Q.cross(vb, vc), Q.cross(va, vc))})"
# Area by the half perimeter, another formula than the Column's.
_tri = f"""u AS (SELECT *, {Q.angle(vb, vc)} AS sa, {Q.angle(vc, va)} AS sb, {Q.angle(va, vb)} AS sc, {_girard} AS gi FROM t), w AS (SELECT *, 0.5 * (sa + sb + sc) AS s FROM u),
    ar AS (SELECT *, 4 * atan(sqrt(greatest(0.0, tan(0.5 * s) * tan(0.5 * (s - sa)) * tan(0.5 * (s - sb)) * tan(0.5 * (s - sc))))) AS area FROM w)"""


@query(f"{TR}, {_tri} SELECT id, {Q.r('area', 5)} AS area, {Q.r('gi', 5)} AS girard, sign({Q.dot(vc, Q.cross(va, vb))})::INT AS orientation FROM ar")
def tri_area(spark, sf):
    return triples(spark, sf).select("id", rd(P.triangle_area(a, b, c), 5).alias("area"), rd(P.girard_area(a, b, c), 5).alias("girard"), P.simple_sign(a, b, c).alias("orientation"))


_n = Q.cross(va, vb)
_inside = f"({Q.dot(Q.cross(_n, va), vc)} > 0 AND {Q.dot(Q.cross(vb, _n), vc)} > 0)"
_edge = f"""u AS (SELECT *, least({Q.l2(vc, va)}, {Q.l2(vc, vb)}) AS ends, {_inside} AS inner_, {Q.dot(vc, _n)} / {Q.norm(_n)} AS s FROM t),
    dd AS (SELECT *, CASE WHEN inner_ THEN least(ends, s * s + pow(1 - sqrt(greatest(0.0, 1 - s * s)), 2)) ELSE ends END AS l2 FROM u)"""


@query(f"{TR}, {_edge} SELECT id, {Q.r('l2')} AS l2, inner_ AS interior FROM dd")
def edge_point_distance(spark, sf):
    return triples(spark, sf).select("id", rd(P.edge_distance_l2(c, a, b)).alias("l2"), P.edge_interior_closest(c, a, b).alias("interior"))


@query(f"{TR} SELECT id, {Q.r(Q.angle(Q.cross(va, vb), Q.cross(vc, vb)))} AS vertex, {Q.r(Q.angle(Q.cross(va, vb), Q.cross(vb, vc)))} AS turn FROM t")
def vertex_angles(spark, sf):
    return triples(spark, sf).select("id", rd(P.vertex_angle(a, b, c)).alias("vertex"), rd(F.abs(P.turn_angle(a, b, c))).alias("turn"))


# --- Cells ----------------------------------------------------------------------------------------

L20 = f"WITH RECURSIVE {Q.EV}, {Q.cells('ev', 20)}"


def event_cells(spark: SparkSession, sf: str, level: int | None = None) -> DataFrame:
    rows = S.with_cells(T.event_points(spark, sf))
    return rows if level is None else rows.withColumn("cell_id", C.parent(F.col("cell_id"), level))


@query(f"WITH RECURSIVE {Q.EV}, {Q.cells('ev', 10)} SELECT cell_id, count(*)::BIGINT AS n FROM cells GROUP BY cell_id")
def events_by_cell(spark, sf):
    return event_cells(spark, sf, 10).groupBy("cell_id").agg(F.count("*").alias("n"))


@query(f"{L20} SELECT id, cell_id FROM cells")
def cell_leaf(spark, sf):
    return event_cells(spark, sf, 20).select("id", "cell_id")


@query(f"{L20} SELECT id, {Q.parent('cell_id', 12)} AS p12, {Q.parent('cell_id', 3)} AS p3, {Q.parent('cell_id', 0)} AS p0 FROM cells")
def cell_parent_level(spark, sf):
    return event_cells(spark, sf, 20).select("id", C.parent(cell, 12).alias("p12"), C.parent(cell, 3).alias("p3"), C.parent(cell, 0).alias("p0"))


@query(f"{L20} SELECT id, ({Q.rmin('cell_id')} - 9223372036854775808)::BIGINT AS lo, ({Q.rmax('cell_id')} - 9223372036854775808)::BIGINT AS hi FROM cells")
def cell_range(spark, sf):
    return event_cells(spark, sf, 20).select("id", C.key(C.range_min(cell)).alias("lo"), C.key(C.range_max(cell)).alias("hi"))


@query(f"{L20}, p AS (SELECT id, {Q.parent('cell_id', 7)} AS c7, cell_id FROM cells) SELECT id, {Q.level('c7')} AS level, ({Q.unsigned('c7')} // 2305843009213693952)::INT AS face, (({Q.unsigned('cell_id')} // {1 << (61 - 16)}) % 4)::INT AS child8 FROM p")
def cell_level(spark, sf):
    rows = event_cells(spark, sf, 20).withColumn("c7", C.parent(cell, 7))
    return rows.select("id", C.level(F.col("c7")).alias("level"), C.face(F.col("c7")).alias("face"), C.child_position(cell, 8).alias("child8"))


@query(f"{L20} SELECT id, rtrim(lower(printf('%016x', ({Q.unsigned('cell_id')})::UBIGINT)), '0') AS token, cell_id AS back FROM cells")
def cell_token(spark, sf):
    return event_cells(spark, sf, 20).withColumn("token", C.to_token(cell)).select("id", "token", C.from_token(F.col("token")).alias("back"))


def _signed(u: str) -> str:
    return f"(CASE WHEN {u} >= 9223372036854775808 THEN {u} - 18446744073709551616 ELSE {u} END)::BIGINT"


@query(f"{L20} SELECT id, k::INT AS k, {_signed(f'({Q.unsigned("cell_id")} + ({Q.lsb("cell_id")} // 4) * (2 * k - 3))')} AS child FROM cells, range(4) AS x(k)")
def cell_children(spark, sf):
    return event_cells(spark, sf, 20).select("id", F.posexplode(C.children(cell)).alias("k", "child"))


@query(f"{L20}, p AS (SELECT DISTINCT {Q.parent('cell_id', 4)} AS q FROM cells) SELECT q, count(*)::BIGINT AS n FROM p, cells WHERE {Q.unsigned('cell_id')} BETWEEN {Q.rmin('q')} AND {Q.rmax('q')} GROUP BY q")
def cell_contains_pairs(spark, sf):
    cells = event_cells(spark, sf, 20)
    some = cells.select(C.parent(cell, 4).alias("q")).distinct()
    return J.with_ancestors(cells, [4], name="k").join(some, F.col("k") == F.col("q")).groupBy("q").agg(F.count("*").alias("n"))


_place = f"({Q.unsigned('cell_id')} // {1 << (61 - 40)})"


@query(f"{L20} SELECT id, ({_place})::BIGINT AS place, {_signed(f'((({_place} + id * 977) % {6 << 40}) * {1 << 21} + {1 << 20})')} AS wrapped FROM cells")
def cell_advance(spark, sf):
    return event_cells(spark, sf, 20).select("id", C.distance_from_begin(cell).alias("place"), C.advance_wrap(cell, F.col("id") * 977).alias("wrapped"))


_anc = " ".join(f"WHEN {Q.parent('cell_id', l)} = {Q.parent('other', l)} THEN {l}" for l in range(20, -1, -1))


@query(f"{L20}, p AS (SELECT a.id, a.cell_id, b.cell_id AS other FROM cells a JOIN cells b ON b.id = a.id + 1) SELECT id, (CASE {_anc} ELSE -1 END)::INT AS level FROM p")
def cell_common_ancestor(spark, sf):
    rows = event_cells(spark, sf, 20).select("id", "cell_id")
    other = rows.select((F.col("id") - 1).alias("id"), cell.alias("other"))
    return rows.join(other, "id").select("id", C.common_ancestor_level(cell, F.col("other")).alias("level"))


@query(f"{L20} SELECT 12 AS level, {Q.r('count(DISTINCT ' + Q.parent('cell_id', 12) + f') * 4 * pi() / 6 * pow(4.0, -12)', 9)} AS area FROM cells")
def cell_avg_area(spark, sf):
    cells = event_cells(spark, sf, 12).select("cell_id").distinct()
    return U.average_area(cells).select(F.lit(12).alias("level"), rd(F.col("area"), 9).alias("area"))


@query()
def cell_edge_neighbors(spark, sf):
    return event_cells(spark, sf, 12).select("id", F.posexplode(C.edge_neighbors(cell)).alias("k", "neighbor"))


_mid = [Q.uv_of(f"(((({c} >> 10) << 10) + 512) / 1073741824::DOUBLE)") for c in "ij"]


@query(f"{L20}, m AS (SELECT id, f, {_mid[0]} AS u, {_mid[1]} AS v FROM cells_w WHERE k = 29), n AS (SELECT id, {', '.join(f'{e} AS {c}' for e, c in zip(Q.on_face('u', 'v'), 'xyz'))} FROM m) SELECT id, {Q.r('degrees(atan2(z, sqrt(x * x + y * y)))')} AS lat, {Q.r('degrees(atan2(y, x))')} AS lng FROM n")
def cell_center(spark, sf):
    rows = event_cells(spark, sf, 20).withColumn("ll", P.to_latlng(C.to_point(cell)))
    return rows.select("id", rd(F.degrees("ll.lat")).alias("lat"), rd(F.degrees("ll.lng")).alias("lng"))


_low = {c: f"(({c} >> 18) << 18)" for c in "ij"}
_high = Q.uv_of(f"(({_low['j']} + 262144) / 1073741824::DOUBLE)")


@query(f"WITH RECURSIVE {Q.EV}, {Q.cells('ev', 12)} SELECT id, f::INT AS face, {_low['i']}::INT AS i, {_low['j']}::INT AS j, 12 AS level, o AS orientation, {Q.r(Q.uv_of('(' + _low['i'] + ' / 1073741824::DOUBLE)'), 9)} AS u_lo, {Q.r(_high, 9)} AS v_hi FROM cells_w WHERE k = 17")
def cell_bounds(spark, sf):
    rows = event_cells(spark, sf, 12).withColumn("d", C.decoded(cell))
    return rows.select("id", "d.face", "d.i", "d.j", "d.level", "d.orientation", rd(F.col("d.u_lo"), 9).alias("u_lo"), rd(F.col("d.v_hi"), 9).alias("v_hi"))


# --- Joins ----------------------------------------------------------------------------------------

_TWO = f"""WITH RECURSIVE {Q.EV}, {Q.cells('ev', 9, 'ca')}, {Q.CUST}, {Q.cells('cu', 9, 'cb')},
    x AS (SELECT id, CASE WHEN id % 3 = 0 THEN {Q.parent('cell_id', 6)} ELSE cell_id END AS a_cell FROM ca), y AS (SELECT id AS cust, CASE WHEN id % 2 = 0 THEN {Q.parent('cell_id', 5)} ELSE cell_id END AS b_cell FROM cb)"""
_meets = f"({Q.rmin('a_cell')} <= {Q.rmax('b_cell')} AND {Q.rmin('b_cell')} <= {Q.rmax('a_cell')})"


def two_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    x = event_cells(spark, sf, 9).select("id", F.when(F.col("id") % 3 == 0, C.parent(cell, 6)).otherwise(cell).alias("a_cell"))
    y = S.with_cells(T.customer_points(spark, sf)).select("cust", F.when(F.col("cust") % 2 == 0, C.parent(cell, 5)).otherwise(C.parent(cell, 9)).alias("b_cell"))
    return materialize(x, "left"), materialize(y, "right")


@query(f"{_TWO} SELECT id, cust, a_cell, b_cell FROM x, y WHERE {_meets}")
def join_exact(spark, sf):
    x, y = two_sides(spark, sf)
    return J.overlap_pairs(x, y).select("id", "cust", "a_cell", "b_cell")


@query(f"{_TWO} SELECT id, a_cell FROM x WHERE EXISTS (SELECT 1 FROM y WHERE {_meets})")
def join_semi(spark, sf):
    return J.semi_join(*two_sides(spark, sf))


@query(f"{_TWO} SELECT id, a_cell FROM x WHERE NOT EXISTS (SELECT 1 FROM y WHERE {_meets})")
def join_anti(spark, sf):
    return J.semi_join(*two_sides(spark, sf), anti=True)


@query(f"{_TWO}, g AS (SELECT DISTINCT b_cell FROM y) SELECT b_cell AS target, count(DISTINCT id % 10)::BIGINT AS n, min(id % 10)::BIGINT AS first FROM x, g WHERE {_meets} GROUP BY b_cell")
def cellindex_labels(spark, sf):
    x, y = two_sides(spark, sf)
    found = J.label_lookup(x.select(F.col("a_cell").alias("cell_id"), (F.col("id") % 10).alias("label")), y.select(F.col("b_cell").alias("target")).distinct())
    return found.select("target", F.size("labels").cast("long").alias("n"), F.get("labels", F.lit(0)).alias("first"))


# --- Cell unions ----------------------------------------------------------------------------------


def _expand_sql(name: str, source: str, column: str) -> str:
    """Leaves at level 9 of cells of levels 5 to 9, as positions."""
    return f"{name} AS (SELECT DISTINCT g AS pos FROM (SELECT unnest(range(({Q.rmin(column)} // {1 << 43})::BIGINT, ({Q.rmax(column)} // {1 << 43})::BIGINT + 1)) AS g FROM (SELECT DISTINCT {column} FROM {source})))"


_UNI = f"{_TWO}, {_expand_sql('pa', 'x', 'a_cell')}, {_expand_sql('pb', 'y', 'b_cell')}"


def at_nine(cells: DataFrame) -> DataFrame:
    """How many level-9 cells a union covers, and a check sum of their places."""
    nine = U.denormalize(cells, 9).select(C.distance_from_begin(F.col("cell_id")).alias("pos"))
    return nine.agg(F.count("*").alias("n"), F.count_distinct("pos").alias("n_distinct"), F.sum("pos").alias("total"))


_count = "SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS n_distinct, sum(pos)::BIGINT AS total FROM"


def sides_as_unions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    x, y = two_sides(spark, sf)
    return x.select(F.col("a_cell").alias("cell_id")), y.select(F.col("b_cell").alias("cell_id"))


@query(f"{_UNI} {_count} pa")
def union_normalize(spark, sf):
    return at_nine(U.normalize(sides_as_unions(spark, sf)[0]))


@query(f"{_UNI} {_count} (SELECT pos FROM pa UNION SELECT pos FROM pb)")
def union_or(spark, sf):
    return at_nine(U.union(*sides_as_unions(spark, sf)))


@query(f"{_UNI} {_count} (SELECT pos FROM pa INTERSECT SELECT pos FROM pb)")
def union_and(spark, sf):
    return at_nine(U.intersection(*sides_as_unions(spark, sf)))


@query(f"{_UNI} {_count} (SELECT pos FROM pa EXCEPT SELECT pos FROM pb)")
def union_except(spark, sf):
    return at_nine(U.difference(*sides_as_unions(spark, sf)))


@query()
def union_expand(spark, sf):
    return at_nine(U.expand(U.normalize(sides_as_unions(spark, sf)[1]), 7))


# --- Terms ----------------------------------------------------------------------------------------


def points_terms(spark: SparkSession, sf: str) -> DataFrame:
    return event_cells(spark, sf).select("id", "p", R.index_terms(F.array(C.parent(cell, 10)), min_level=4, max_level=10, level_mod=2, points_only=True).alias("terms"))


@query(f"WITH RECURSIVE {Q.EV}, {Q.cells('ev', 10)} SELECT id, 'ANCESTOR' AS type, c AS term FROM (SELECT id, unnest([cell_id, {Q.parent('cell_id', 8)}, {Q.parent('cell_id', 6)}, {Q.parent('cell_id', 4)}]) AS c FROM cells)")
def terms_index(spark, sf):
    return points_terms(spark, sf).select("id", F.explode("terms").alias("t")).select("id", "t.type", F.col("t.cell_id").alias("term"))


_R2 = 4 * math.sin(0.04 / 2) ** 2


def _within(limit: float, other: str = "su") -> str:
    return f"WITH {Q.EV}, {Q.SUPP} SELECT su.id AS supp, ev.id AS id FROM ev, su WHERE {Q.l2(('ev.x', 'ev.y', 'ev.z'), ('su.x', 'su.y', 'su.z'))} < {limit!r}"


@query(_within(_R2))
def terms_join(spark, sf):
    """Points in caps: terms of the points, terms of the caps' coverings, then the exact test."""
    caps = spread(T.supplier_points(spark, sf), "supp").withColumn("covering", R.cap_covering(F.col("ll.lat"), F.col("ll.lng"), F.lit(_R2), min_level=4, max_level=10, level_mod=2, max_cells=16))
    asked = materialize(caps, "caps").select("supp", F.col("p").alias("q"), R.query_terms(F.col("covering"), min_level=4, max_level=10, level_mod=2, points_only=True).alias("terms"))
    both = R.term_join_points(points_terms(spark, sf), asked)
    return both.filter(P.chord(F.col("p"), F.col("q")) < _R2).select("supp", "id")


# --- Distance searches ----------------------------------------------------------------------------

_PAIR = Q.l2(("cu.x", "cu.y", "cu.z"), ("ev.x", "ev.y", "ev.z"))


def _knn(condition: str = "", order: str = "l2") -> str:
    return f"""WITH {Q.EV}, {Q.CUST}, d AS (SELECT cu.id AS cust, ev.id AS id, {_PAIR} AS l2 FROM cu, ev {condition}), k AS (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY {order}, id) AS rank FROM d)
    SELECT cust, rank::INT AS rank, id, {Q.r('l2', 9)} AS l2 FROM k WHERE rank <= 3"""


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return S.with_cells(T.customer_points(spark, sf)).select("cust", "p", "cell_id"), event_cells(spark, sf).select("id", "p", "cell_id")


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("cust", "rank", "id", rd(F.col("l2"), 9).alias("l2"))


@query(_knn())
def knn_points(spark, sf):
    return _ranked(S.nearest(*_sides(spark, sf), 3, "cust", "id"))


@query(_knn("WHERE ev.z > 0"))
def knn_filtered(spark, sf):
    """The filter, here the northern hemisphere, comes before the ranking."""
    q, e = _sides(spark, sf)
    return _ranked(S.nearest(q, e.filter("p.z > 0"), 3, "cust", "id"))


@query(_knn(f"WHERE {_PAIR} < {4 * math.sin(0.01) ** 2!r}"))
def knn_within(spark, sf):
    return _ranked(S.nearest(*_sides(spark, sf), 3, "cust", "id", max_radians=0.02))


@query(_knn(order="l2 DESC"))
def furthest_points(spark, sf):
    return _ranked(S.furthest(*_sides(spark, sf), 3, "cust", "id"))


@query(f"WITH {Q.EV}, {Q.CUST} SELECT cu.id AS cust, {Q.r(f'min({_PAIR})', 9)} AS l2 FROM cu, ev GROUP BY cu.id")
def closest_dist_min(spark, sf):
    return S.nearest(*_sides(spark, sf), 1, "cust", "id").select("cust", rd(F.col("l2"), 9).alias("l2"))


@query(f"WITH {Q.EV}, {Q.CUST} SELECT cu.id AS cust FROM cu WHERE EXISTS (SELECT 1 FROM ev WHERE {_PAIR} < {4 * math.sin(0.005) ** 2!r})")
def within_exists(spark, sf):
    return S.within_exists(*_sides(spark, sf), 0.01, "cust", "id")


@query(f"WITH {Q.EV}, {Q.CUST} SELECT cu.id AS cust, ev.id AS id, {Q.r(_PAIR, 9)} AS l2 FROM cu, ev WHERE {_PAIR} < {4 * math.sin(0.01) ** 2!r}")
def join_within_distance(spark, sf):
    return S.pairs_within(*_sides(spark, sf), 0.02, "cust", "id").select("cust", "id", rd(F.col("l2"), 9).alias("l2"))


@query(f"WITH {Q.EV}, {Q.CUST}, m AS (SELECT cu.id, min({_PAIR}) AS l2 FROM cu, ev GROUP BY cu.id) SELECT {Q.r('max(l2)', 9)} AS l2 FROM m")
def hausdorff_directed(spark, sf):
    return S.directed_hausdorff(*_sides(spark, sf), "cust", "id").select(rd(F.col("l2"), 9).alias("l2"))


_both = f"WITH {Q.EV}, {Q.CUST}, d AS (SELECT cu.id AS c, ev.id AS e, {_PAIR} AS l2 FROM cu, ev), m AS (SELECT min(l2) AS l2 FROM d GROUP BY c UNION ALL SELECT min(l2) FROM d GROUP BY e)"


@query(f"{_both} SELECT {Q.r('max(l2)', 9)} AS l2 FROM m")
def hausdorff(spark, sf):
    q, e = _sides(spark, sf)
    both = S.directed_hausdorff(q, e, "cust", "id").union(S.directed_hausdorff(e, q, "id", "cust"))
    return both.agg(rd(F.max("l2"), 9).alias("l2"))


# --- Polylines, polygons --------------------------------------------------------------------------

_prev = ("px", "py", "pz")
_seg = f"WITH {Q.LOCAL}, s AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM lo WINDOW w AS (PARTITION BY user_id ORDER BY ts, id))"


@query(f"{_seg} SELECT user_id, {Q.r(f'sum({Q.angle(_prev, ("x", "y", "z"))}) * 6371.010', 4)} AS km, count(*)::BIGINT AS n FROM s GROUP BY user_id")
def polyline_length(spark, sf):
    rows = T.tracks(spark, sf)
    return rows.select("user_id", rd(H.polyline_length(F.col("chain")) * (P.EARTH_RADIUS_M / 1000), 4).alias("km"), F.size("chain").cast("long").alias("n"))


_len = Q.norm(Q.sub(_prev, ("x", "y", "z")))
_sum = f"sqrt(pow(px + x, 2) + pow(py + y, 2) + pow(pz + z, 2))"


@query(f"{_seg} SELECT user_id, " + ", ".join(Q.r(f"sum((p{k} + {k}) * {_len} / {_sum})", 8) + f" AS {k}" for k in "xyz") + " FROM s WHERE px IS NOT NULL GROUP BY user_id")
def polyline_centroid(spark, sf):
    rows = T.tracks(spark, sf).withColumn("m", H.polyline_centroid(F.col("chain")))
    return rows.filter(F.size("chain") > 1).select("user_id", *[rd(F.col(f"m.{k}"), 8).alias(k) for k in "xyz"])


_ZONE = f"z AS (SELECT n_nationkey::BIGINT AS zone, {Q.r('8 * 2 * atan(tan(0.5 * r8) * tan(0.5 * r8) * sin(pi() / 4) / (1 + tan(0.5 * r8) * tan(0.5 * r8) * cos(pi() / 4)))', 9)} AS area FROM (SELECT *, 500000.0 / 6371010.0 AS r8 FROM nation))"


@query(f"WITH {_ZONE} SELECT zone, area FROM z")
def loop_area(spark, sf):
    return T.zones(spark, sf).select("zone", rd(H.loop_area(F.get("loops", F.lit(0))), 9).alias("area"))


@query()
def polygon_contains_join(spark, sf):
    """Points in polygons: coverings as filter, exact crossing parity as refinement."""
    zones = materialize(spread(T.zones(spark, sf), "zone").withColumn("covering", R.polygon_covering(F.col("loops"), max_cells=12, max_level=10)), "zones")
    pairs = J.zones_join(event_cells(spark, sf).select("id", "p", "cell_id"), zones)
    return pairs.filter(H.polygon_contains(F.col("loops"), F.col("p"))).select("zone", "id")


@query()
def covering_caps(spark, sf):
    caps = spread(T.supplier_points(spark, sf), "supp").withColumn("covering", R.cap_covering(F.col("ll.lat"), F.col("ll.lng"), F.lit(0.01), max_cells=8))
    return materialize(caps, "caps").select("supp", F.size("covering").alias("n"), F.transform("covering", lambda x: C.to_token(x)).alias("tokens"))


@query()
def polygon_set_ops(spark, sf):
    """Areas of overlays of each zone with a moved copy: union + intersection = sum of both."""
    x = spread(T.zones(spark, sf), "zone")
    moved = P.let(P.ortho(F.col("center")), lambda axis: F.transform("loops", lambda l: F.transform(l, lambda p: P.rotate(p, axis, 0.04))))
    rows = materialize(x.select("zone", F.col("loops").alias("a"), moved.alias("b")), "pairs")
    total = lambda loops: F.aggregate(loops, F.lit(0.0), lambda s, l: s + H.loop_signed_area(l))
    done = materialize(rows.select("zone", "a", "b", H.polygon_union("a", "b").alias("u"), H.polygon_intersection("a", "b").alias("i"), H.polygon_difference("a", "b").alias("d")), "overlays")
    return done.select("zone", *[rd(total(F.col(k)), 9).alias(k) for k in "abuid"])


@query()
def polyline_simplify(spark, sf):
    rows = materialize(T.tracks(spark, sf), "tracks").select("user_id", "chain", H.simplify(F.col("chain"), F.lit(0.002)).alias("s"))
    return rows.select("user_id", F.size("chain").alias("n"), F.size("s").alias("kept"))


_dir = Q.cross(Q.cross(_prev, ("x", "y", "z")), _prev)
_half = tuple(f"({p} * cos(goal - before) + {d} / {Q.norm(_dir)} * sin(goal - before))" for p, d in zip(_prev, _dir))


@query(f"""{_seg}, l AS (SELECT *, {Q.angle(_prev, ('x', 'y', 'z'))} AS len FROM s WHERE px IS NOT NULL),
    m AS (SELECT *, sum(len) OVER (PARTITION BY user_id ORDER BY ts, id) AS after, 0.5 * sum(len) OVER (PARTITION BY user_id) AS goal FROM l), h AS (SELECT *, after - len AS before FROM m),
    p AS (SELECT user_id, {_half[0]} AS hx, {_half[1]} AS hy, {_half[2]} AS hz FROM h WHERE before < goal AND goal <= after)
    SELECT user_id, {Q.r('degrees(atan2(hz, sqrt(hx * hx + hy * hy)))')} AS lat, {Q.r('degrees(atan2(hy, hx))')} AS lng FROM p""")
def polyline_interpolate(spark, sf):
    rows = T.tracks(spark, sf).withColumn("m", P.to_latlng(H.polyline_interpolate(F.col("chain"), 0.5)))
    return rows.select("user_id", rd(F.degrees("m.lat")).alias("lat"), rd(F.degrees("m.lng")).alias("lng"))


_EDGES = f"{_seg}, e AS (SELECT id AS edge, user_id, px AS ax, py AS ay, pz AS az, x AS bx, y AS by, z AS bz FROM s WHERE px IS NOT NULL)"


def track_edges(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    rows = T.local_points(spark, sf)
    before = F.lag("p").over(Window.partitionBy("user_id").orderBy("ts", "id"))
    return rows.select(F.col("id").alias("edge"), "user_id", before.alias("a"), F.col("p").alias("b")).filter("a is not null")


_cc = tuple(f"lo.{k}" for k in "xyz")
_en = Q.cross(("e.ax", "e.ay", "e.az"), ("e.bx", "e.by", "e.bz"))
_ea, _eb = ("e.ax", "e.ay", "e.az"), ("e.bx", "e.by", "e.bz")
_EL = f"CASE WHEN {Q.dot(_en, _en)} > 0 AND {Q.dot(Q.cross(_en, _ea), _cc)} > 0 AND {Q.dot(Q.cross(_eb, _en), _cc)} > 0 THEN least({Q.l2(_cc, _ea)}, {Q.l2(_cc, _eb)}, pow({Q.dot(_cc, _en)} / {Q.norm(_en)}, 2) + pow(1 - sqrt(greatest(0.0, 1 - pow({Q.dot(_cc, _en)} / {Q.norm(_en)}, 2))), 2)) ELSE least({Q.l2(_cc, _ea)}, {Q.l2(_cc, _eb)}) END"


@query(f"{_EDGES}, d AS (SELECT lo.id AS id, e.edge AS edge, {_EL} AS l2 FROM lo, e) SELECT id, edge FROM d WHERE l2 < {4 * math.sin(0.00005) ** 2!r}")
def edges_within_distance(spark, sf):
    pts, edges = S.with_cells(T.local_points(spark, sf)), materialize(track_edges(spark, sf), "edges")
    return S.edges_within(pts, edges, 0.0001, "id", "edge").select("id", "edge")


def _sgn(p, q, r) -> str:
    return f"sign({Q.dot(r, Q.cross(p, q))})"


_fa, _fb = ("f.ax", "f.ay", "f.az"), ("f.bx", "f.by", "f.bz")


@query(f"{_EDGES} SELECT e.edge AS left_edge, f.edge AS right_edge FROM e, e AS f WHERE e.user_id = f.user_id AND e.edge < f.edge AND {_sgn(_ea, _fa, _eb)} <> 0 AND {_sgn(_ea, _fa, _eb)} = {_sgn(_fa, _eb, _fb)} AND {_sgn(_fa, _eb, _fb)} = {_sgn(_eb, _fb, _ea)} AND {_sgn(_eb, _fb, _ea)} = {_sgn(_fb, _ea, _fa)}")
def edge_crossings(spark, sf):
    """All pairs of edges of a track that cross inside."""
    edges = materialize(track_edges(spark, sf), "edges")
    left, right = (edges.withColumnRenamed("edge", n) for n in ("left_edge", "right_edge"))
    return S.crossing_edges(left, right, 9, "left_edge", "right_edge", by="user_id", ordered=True)


_shared = " OR ".join(f"({' AND '.join(f'{p} = {q}' for p, q in zip(x, y))})" for x in (_ea, _eb) for y in (_fa, _fb))
_crosses = f"({_sgn(_ea, _fa, _eb)} <> 0 AND {_sgn(_ea, _fa, _eb)} = {_sgn(_fa, _eb, _fb)} AND {_sgn(_fa, _eb, _fb)} = {_sgn(_eb, _fb, _ea)} AND {_sgn(_eb, _fb, _ea)} = {_sgn(_fb, _ea, _fa)})"


@query(f"{_EDGES} SELECT e.edge AS left_edge, f.edge AS right_edge, ({_shared}) AS shared FROM e, e AS f WHERE e.user_id = f.user_id AND e.edge < f.edge AND ({_shared} OR {_crosses})")
def edge_crossings_all(spark, sf):
    """All pairs of edges of a track that cross inside or share a vertex."""
    edges = materialize(track_edges(spark, sf), "edges")
    left, right = (edges.withColumnRenamed("edge", n) for n in ("left_edge", "right_edge"))
    return S.crossing_edges(left, right, 9, "left_edge", "right_edge", by="user_id", touching=True, ordered=True)


# --- Distances of cells and rectangles --------------------------------------------------------------

_CELL3 = f"WITH RECURSIVE {Q.triple()}, ta AS (SELECT id, \"ax\" AS x, \"ay\" AS y, \"az\" AS z FROM t), {Q.cells('ta', 3)}, {Q.corners('cells', 3, 'co')}"
_opposite = tuple(f"(-{x})" for x in vb)


@query(f"{_CELL3} SELECT id, {Q.r(Q.cell_point_l2('co', vb), 9)} AS l2, {Q.r('4 - ' + Q.cell_point_l2('co', _opposite), 9)} AS far, {Q.cell_point_l2('co', vb)} = 0 AS has FROM co JOIN t USING (id)")
def cell_point_distance(spark, sf):
    """From each point's cell, a large one, to another point: nearest and furthest."""
    rows = materialize(triples(spark, sf).select("id", C.parent(C.from_point(a), 3).alias("cell_id"), F.col("b")), "cells")
    return rows.select("id", rd(G.distance_to_point(cell, b), 9).alias("l2"), rd(G.max_distance_to_point(cell, b), 9).alias("far"), G.contains_point(cell, b).alias("has"))


_edge_near = "least(" + ", ".join([Q.cell_point_l2("co", vb), Q.cell_point_l2("co", vc)] + [Q.edge_l2(Q.corner("co", k), vb, vc) for k in range(4)]) + ")"
_cuts = " OR ".join(f"(sign({Q.dot(vb, Q.cross(x, y))}) <> sign({Q.dot(vc, Q.cross(x, y))}) AND sign({Q.dot(x, Q.cross(vb, vc))}) <> sign({Q.dot(y, Q.cross(vb, vc))}) AND sign({Q.dot(vb, Q.cross(x, y))}) = sign({Q.dot(y, Q.cross(vb, vc))}))" for x, y in [(Q.corner("co", k), Q.corner("co", (k + 1) % 4)) for k in range(4)])


@query(f"{_CELL3} SELECT id, {Q.r(f'CASE WHEN {_cuts} THEN 0.0 ELSE {_edge_near} END', 9)} AS l2 FROM co JOIN t USING (id)")
def cell_edge_distance(spark, sf):
    """From each point's cell to an edge elsewhere."""
    rows = materialize(triples(spark, sf).select("id", C.parent(C.from_point(a), 3).alias("cell_id"), "b", "c"), "cells")
    return rows.select("id", rd(G.distance_to_edge(cell, F.col("b"), F.col("c")), 9).alias("l2"))


@query(f"{_CELL3} SELECT id, {Q.r('greatest(' + ', '.join(Q.l2(Q.corner('co', k), Q.corner('co', (k + 2) % 4)) for k in range(2)) + ')', 9)} AS diagonal, true AS holds FROM co")
def cell_cap_bound(spark, sf):
    """The cap of each cell holds its corners, and is no wider than its diagonal."""
    rows = materialize(triples(spark, sf).select("id", C.parent(C.from_point(a), 3).alias("cell_id")), "cells")
    v = materialize(rows.select("id", C.vertices(cell).alias("v"), G.cap_bound(cell).alias("cap")), "caps")
    diagonal = F.greatest(*[P.chord(F.col("v")[k], F.col("v")[k + 2]) for k in (0, 1)])
    inside = F.forall("v", lambda q: P.chord(F.col("cap.axis"), q) <= F.col("cap.l2"))
    return v.select("id", rd(diagonal, 9).alias("diagonal"), (inside & (F.col("cap.l2") <= diagonal)).alias("holds"))


_pairs32 = ", ".join([Q.edge_l2(Q.corner("p", k), Q.corner("q", m), Q.corner("q", (m + 1) % 4)) for k in range(4) for m in range(4)] + [Q.edge_l2(Q.corner("q", k), Q.corner("p", m), Q.corner("p", (m + 1) % 4)) for k in range(4) for m in range(4)])
_cells_sql = f"WITH RECURSIVE {Q.SUPP}, {Q.CUST}, {Q.cells('su', 7, 'sc')}, {Q.corners('sc', 7, 'p')}, {Q.cells('cu', 9, 'cc')}, {Q.corners('cc', 9, 'q')}"
_TEN = 4 * math.sin(0.05) ** 2


@query(f"{_cells_sql}, d AS (SELECT p.id AS supp, q.id AS cust, p.cell_id AS a_cell, q.cell_id AS b_cell, CASE WHEN {Q.rmin('p.cell_id')} <= {Q.rmax('q.cell_id')} AND {Q.rmin('q.cell_id')} <= {Q.rmax('p.cell_id')} THEN 0.0 ELSE least({_pairs32}) END AS l2 FROM p, q) SELECT supp, cust, a_cell, b_cell, {Q.r('l2', 9)} AS l2 FROM d WHERE l2 <= {_TEN!r}")
def join_cells_within(spark, sf):
    """Cells of suppliers and, finer, of customers at most 0.1 radians apart."""
    x = S.with_cells(T.supplier_points(spark, sf)).select("supp", C.parent(cell, 7).alias("a_cell"))
    y = S.with_cells(T.customer_points(spark, sf)).select("cust", C.parent(cell, 9).alias("b_cell"))
    found = J.cells_within(materialize(x, "left"), materialize(y, "right"), 0.1)
    return found.select("supp", "cust", "a_cell", "b_cell", rd(F.col("l2"), 9).alias("l2"))


_R = "rc AS (SELECT r_regionkey::BIGINT AS rect, radians(-60 + 20 * r_regionkey) AS la, radians(-45 + 20 * r_regionkey) AS lb, radians(-150 + 60 * r_regionkey) AS ga, radians(-100 + 60 * r_regionkey) AS gb FROM region)"
_at = lambda t, la, ln: (f"(cos({t}.{ln}) * cos({t}.{la}))", f"(sin({t}.{ln}) * cos({t}.{la}))", f"sin({t}.{la})")
_side = lambda t, ln: (_at(t, "la", ln), _at(t, "lb", ln))
_from_l2 = lambda e: f"2 * asin(least(1.0, 0.5 * sqrt({e})))"
_rect_pt = "least(" + ", ".join(Q.edge_l2(("ev.x", "ev.y", "ev.z"), *_side("rc", g)) for g in ("ga", "gb")) + ")"


@query(f"WITH {Q.EV}, {_R} SELECT id, rect, {Q.r(f'CASE WHEN lng BETWEEN ga AND gb THEN greatest(la - lat, lat - lb, 0.0) ELSE {_from_l2(_rect_pt)} END')} AS radians FROM ev, rc")
def rect_point_distance(spark, sf):
    """From rectangles to points; the SQL measures to the sides as edges in space."""
    rows = T.event_points(spark, sf).select("id", "ll").crossJoin(F.broadcast(T.rects(spark, sf)))  # five rectangles
    return rows.select("id", "rect", rd(B.rect_distance_to(F.col("r"), F.col("ll"))).alias("radians"))


_rect_pairs = "least(" + ", ".join(Q.edge_l2(_at(s, la, g), *_side(t, h)) for s, t in (("p", "q"), ("q", "p")) for la in ("la", "lb") for g in ("ga", "gb") for h in ("ga", "gb")) + ")"


@query(f"WITH {_R} SELECT p.rect AS rect, q.rect AS other, {Q.r(f'CASE WHEN p.ga <= q.gb AND q.ga <= p.gb THEN greatest(p.la - q.lb, q.la - p.lb, 0.0) ELSE {_from_l2(_rect_pairs)} END')} AS radians, p.rect = q.rect AS same FROM rc AS p, rc AS q")
def rect_distance(spark, sf):
    x, y = T.rects(spark, sf), T.rects(spark, sf).select(F.col("rect").alias("other"), F.col("r").alias("s"))
    return x.crossJoin(F.broadcast(y)).select("rect", "other", rd(B.rect_distance(F.col("r"), F.col("s"))).alias("radians"), B.rect_approx_equals(F.col("r"), F.col("s")).alias("same"))


# --- Density, clusters, hull ----------------------------------------------------------------------

_TREE = f"WITH RECURSIVE {Q.EV}, {Q.cells('ev', 6)}, tree AS (SELECT c AS cell_id, count(*)::BIGINT AS weight FROM (SELECT unnest([cell_id, " + ", ".join(Q.parent("cell_id", l) for l in range(6)) + "]) AS c FROM cells) GROUP BY c)"


@query(f"{_TREE} SELECT cell_id, weight FROM tree")
def density_tree(spark, sf):
    return D.density_tree(event_cells(spark, sf), 6)


@query(f"{_TREE} SELECT cell_id, (2 * weight)::BIGINT AS weight FROM tree")
def density_sum(spark, sf):
    tree = materialize(D.density_tree(event_cells(spark, sf), 6), "tree")
    return D.tree_sum(tree, tree)


_PARENT = "CASE " + " ".join(f"WHEN {Q.level('cell_id')} = {l} THEN {Q.parent('cell_id', l - 1)}" for l in range(1, 7)) + " END"


@query(f"{_TREE}, p AS (SELECT *, {_PARENT} AS par, {Q.level('cell_id')} AS lv FROM tree) SELECT p.cell_id, p.weight FROM p LEFT JOIN tree u ON u.cell_id = p.par WHERE (u.weight IS NULL OR u.weight > 40) AND (p.weight <= 40 OR p.lv = 6)")
def density_partition(spark, sf):
    return D.tree_partition(materialize(D.density_tree(event_cells(spark, sf), 6), "tree"), 40)


@query()
def density_features(spark, sf):
    """How many zones' coverings meet each cell."""
    zones = materialize(spread(T.zones(spark, sf), "zone").withColumn("covering", R.polygon_covering(F.col("loops"), max_cells=12, max_level=10)), "zones")
    return D.feature_density(zones.select("zone", F.explode("covering").alias("cell_id")), "zone", 7)


@query()
def density_dilate(spark, sf):
    return D.tree_dilate(materialize(D.density_tree(event_cells(spark, sf), 6), "tree"), 0.03)


@query()
def density_clusters(spark, sf):
    return D.clusters(materialize(D.density_tree(event_cells(spark, sf), 8), "tree"), 500)


@query()
def region_shards(spark, sf):
    tree = materialize(D.density_tree(event_cells(spark, sf), 4), "tree")
    shards = D.tree_leaves(tree).select("cell_id", (C.face(F.col("cell_id"))).alias("shard"))
    zones = materialize(spread(T.zones(spark, sf), "zone").withColumn("covering", R.polygon_covering(F.col("loops"), max_cells=12, max_level=10)), "zones")
    return D.best_shard(shards, zones.select(F.col("zone").alias("region"), F.explode("covering").alias("cell_id")))


@query()
def convex_hull(spark, sf):
    return D.convex_hull(T.local_points(spark, sf)).select(F.posexplode("hull").alias("k", "p")).select("k", rd(F.degrees(P.latitude(F.col("p"))), 6).alias("lat"), rd(F.degrees(P.longitude(F.col("p"))), 6).alias("lng"))


# --- Text -----------------------------------------------------------------------------------------


@query(f"WITH {Q.EV} SELECT id, {Q.r('x')} AS x, {Q.r('y')} AS y, {Q.r('z')} AS z, false AS odd FROM ev")
def text_points(spark, sf):
    rows = T.event_points(spark, sf).withColumn("t", F.concat(F.col("lat_deg").cast("string"), F.lit(":"), F.col("lng_deg").cast("string")))
    parsed = rows.withColumn("q", X.parse_point(F.col("t")))
    return parsed.select("id", *[rd(F.col(f"q.{k}")).alias(k) for k in "xyz"], F.col("q").isNull().alias("odd"))


@query()
def text_index(spark, sf):
    """The shapes of a text index and their edges."""
    rows = spark.createDataFrame([("0:0 # 0:1, 0:2 # 0:5, 0:7, 2:6",)], "t string").select(F.posexplode(X.parse_index(F.col("t"))).alias("shape_id", "s"))
    chains = rows.select("shape_id", "s.dimension", F.posexplode("s.chains").alias("chain_id", "chain"))
    edges = chains.withColumn("e", F.when(F.col("dimension") == 0, F.transform("chain", lambda p: F.struct(p.alias("a"), p.alias("b")))).when(F.col("dimension") == 1, H.edges(F.col("chain"))).otherwise(H.edges(F.col("chain"), closed=True)))
    return edges.select("shape_id", "dimension", "chain_id", F.posexplode("e").alias("edge_id", "edge")).select("shape_id", "dimension", "chain_id", "edge_id", X.format_point(F.col("edge.a")).alias("a"), X.format_point(F.col("edge.b")).alias("b"))


# --- Clipping, projected chains ---------------------------------------------------------------------

_clip_box = {"x": ("a_lng", "b_lng", 1.0), "y": ("a_lat", "b_lat", 0.5)}
_clip_sides = [(f"({p} + {m})", f"({q} + {m})") for p, q, m in _clip_box.values()] + [(f"({m} - {p})", f"({m} - {q})") for p, q, m in _clip_box.values()]
_clip_lo = "greatest(0.0, " + ", ".join(f"CASE WHEN {f} < 0 THEN CASE WHEN {g} < 0 THEN 2.0 ELSE {f} / ({f} - {g}) END ELSE 0.0 END" for f, g in _clip_sides) + ")"
_clip_hi = "least(1.0, " + ", ".join(f"CASE WHEN {g} < 0 THEN CASE WHEN {f} < 0 THEN -1.0 ELSE {f} / ({f} - {g}) END ELSE 1.0 END" for f, g in _clip_sides) + ")"


@query(f"{TR}, u AS (SELECT *, {_clip_lo} AS lo, {_clip_hi} AS hi FROM t) SELECT id, {Q.r('a_lng + lo * (b_lng - a_lng)')} AS x0, {Q.r('a_lat + lo * (b_lat - a_lat)')} AS y0, {Q.r('a_lng + hi * (b_lng - a_lng)')} AS x1, {Q.r('a_lat + hi * (b_lat - a_lat)')} AS y1 FROM u WHERE lo <= hi")
def clip_rect(spark, sf):
    """The parts of planar edges (longitude, latitude) inside a rectangle."""
    cut = L.clip_planar(al["lng"], al["lat"], bl["lng"], bl["lat"], -1.0, 1.0, -0.5, 0.5)
    rows = triples(spark, sf).select("id", F.explode(F.array(cut)).alias("s")).filter("s is not null")
    return rows.select("id", *[rd(F.col(f"s.{k}")).alias(k) for k in ("x0", "y0", "x1", "y1")])


@query()
def edge_faces(spark, sf):
    """The parts of edges on the faces of the cube."""
    rows = triples(spark, sf).select("id", F.explode(L.face_segments(a, b)).alias("f"))
    return rows.select("id", "f.face", *[rd(F.col(f"f.s.{k}")).alias(k) for k in ("x0", "y0", "x1", "y1")])


@query()
def edge_tessellate(spark, sf):
    """Planar chains of geodesic edges in both projections, and back."""
    out = None
    for name in ("plate_carree", "mercator"):
        project, unproject = L.tessellator(name)
        rows = materialize(triples(spark, sf).select("id", project(F.array(a, b), F.lit(0.01)).alias("q")), "planar")
        part = rows.select("id", F.lit(name).alias("projection"), F.size("q").alias("n_planar"), F.size(unproject("q", F.lit(0.01))).alias("n_back"))
        out = part if out is None else out.unionByName(part)
    return out


# --- Nearest edges, constructions -------------------------------------------------------------------


@query(f"{_EDGES}, d AS (SELECT lo.id AS id, e.edge AS edge, {_EL} AS l2 FROM lo, e), k AS (SELECT id, edge, l2, row_number() OVER (PARTITION BY id ORDER BY l2, edge) AS rank FROM d WHERE l2 < {4 * math.sin(0.00005) ** 2!r}) SELECT id, edge, {Q.r('l2', 12)} AS l2 FROM k WHERE rank <= 3")
def knn_edges(spark, sf):
    """The three nearest edges of each point below a distance; those that end in it are at 0, but for rounding, so ranks are left out."""
    pts, edges = S.with_cells(T.local_points(spark, sf)), materialize(track_edges(spark, sf), "edges")
    return S.nearest_edges(pts, edges, 3, "id", "edge", max_radians=0.0001, start_radians=0.00005).select("id", "edge", rd(F.col("l2"), 12).alias("l2"))


@query(f"{_EDGES}, d AS (SELECT lo.id AS id, e.edge AS edge, {_EL} AS l2 FROM lo, e), k AS (SELECT id, edge, l2, row_number() OVER (PARTITION BY edge ORDER BY l2, id) AS rank FROM d WHERE l2 < {4 * math.sin(0.00005) ** 2!r}) SELECT edge, id, {Q.r('l2', 12)} AS l2 FROM k WHERE rank <= 5")
def edge_near_points(spark, sf):
    """The five nearest points of each edge below a distance; its own ends are among them."""
    pts, edges = S.with_cells(T.local_points(spark, sf)), materialize(track_edges(spark, sf), "edges")
    return S.nearest_points_to_edges(edges, pts, 5, "edge", "id", max_radians=0.0001).select("edge", "id", rd(F.col("l2"), 12).alias("l2"))


@query(f"{_EDGES}, d AS (SELECT lo.id AS id, e.edge AS edge, {_EL} AS l2 FROM lo, e), k AS (SELECT id, edge, l2, row_number() OVER (PARTITION BY id ORDER BY l2, edge) AS rank FROM d WHERE l2 < {4 * math.sin(0.00005) ** 2!r}) SELECT id, edge, {Q.r('4 - l2', 12)} AS l2 FROM k WHERE rank <= 3")
def furthest_edges(spark, sf):
    """The three furthest edges from each point's antipode."""
    pts, edges = T.local_points(spark, sf).withColumn("p", P.neg(F.col("p"))), materialize(track_edges(spark, sf), "edges")
    return S.furthest_edges(pts, edges, 3, "id", "edge", min_radians=math.pi - 0.0001).select("id", "edge", rd(F.col("l2"), 12).alias("l2"))


@query()
def buffer_zones(spark, sf):
    """Areas of zones, of the zones grown and shrunk by 100 km, and of discs of 100 km around their centres."""
    x = spread(T.zones(spark, sf), "zone")
    r = 100000.0 / P.EARTH_RADIUS_M
    done = materialize(x.select("zone", "loops", H.buffer(F.col("loops"), r, 2).alias("grown"), H.buffer(F.col("loops"), -r, 2).alias("shrunk"), H.buffer(F.array(F.array("center")), r, 0).alias("disc")), "buffers")
    total = lambda loops: F.aggregate(loops, F.lit(0.0), lambda s, l: s + H.loop_signed_area(l))
    return done.select("zone", *[rd(P.square_km(total(F.col(k))), 3).alias(k) for k in ("loops", "grown", "shrunk", "disc")])


@query()
def polygon_relations(spark, sf):
    """Zones against themselves moved a little, shrunk and moved far away."""
    x = spread(T.zones(spark, sf), "zone")
    moved = lambda by: P.let(P.ortho(F.col("center")), lambda axis: F.transform("loops", lambda l: F.transform(l, lambda p: P.rotate(p, axis, by))))
    rows = materialize(x.select("zone", "loops", moved(0.04).alias("near"), moved(0.5).alias("far"), H.buffer(F.col("loops"), -0.01, 2).alias("small")), "relations")
    return rows.select("zone", H.polygon_contains_polygon("loops", "small").alias("holds_small"), H.polygon_contains_polygon("loops", "near").alias("holds_near"), H.polygon_intersects("loops", "near").alias("meets_near"), H.polygon_intersects("loops", "far").alias("meets_far"), H.polygon_equals("loops", "loops").alias("same"))


@query()
def polyline_in_polygon(spark, sf):
    """Lengths of tracks inside and outside a quadrilateral."""
    corners = [(40.25, -73.75), (40.25, -73.25), (40.75, -73.25), (40.75, -73.75)]
    quad = F.array(F.array(*[P.point_degrees(F.lit(x), F.lit(y)) for x, y in corners]))
    rows = materialize(T.tracks(spark, sf), "tracks").withColumn("quad", quad)
    cut = materialize(rows.select("user_id", "chain", H.polyline_inside("chain", "quad").alias("inside"), H.polyline_outside("chain", "quad").alias("outside")), "parts")
    km = lambda chains: rd(F.aggregate(chains, F.lit(0.0), lambda s, c: s + H.polyline_length(c)) * (P.EARTH_RADIUS_M / 1000), 4)
    return cut.select("user_id", F.size("inside").alias("n_inside"), km(F.col("inside")).alias("inside_km"), km(F.col("outside")).alias("outside_km"), km(F.array("chain")).alias("all_km"))


@query()
def snap_tracks(spark, sf):
    """Vertices left after snapping tracks to cells and to degrees."""
    rows = materialize(T.tracks(spark, sf), "tracks")
    return rows.select("user_id", F.size("chain").alias("n"), *[F.size(H.snap_to_cells(F.col("chain"), k)).alias(f"cells_{k}") for k in (6, 12)], *[F.size(H.snap_to_degrees(F.col("chain"), k)).alias(f"degrees_{k}") for k in (0, 2)])


# --- Binary forms -------------------------------------------------------------------------------------


@query(f"{L20} SELECT id, cell_id AS compact, cell_id AS plain FROM cells")
def codec_cells(spark, sf):
    """Cells of each level-4 cell, encoded and decoded in both forms."""
    rows = event_cells(spark, sf, 20).withColumn("home", C.parent(cell, 4))
    lists = materialize(rows.groupBy("home").agg(F.sort_array(F.collect_list(F.struct("cell_id", "id"))).alias("c")), "homes")
    back = lists.select(F.transform("c", lambda x: x["id"]).alias("ids"), *[d(e(F.transform("c", lambda x: x["cell_id"]))).alias(n) for n, e, d in (("compact", Z.encode_cells, Z.decode_cells), ("plain", Z.encode_union, Z.decode_union))])
    return back.select(F.explode(F.arrays_zip("ids", "compact", "plain")).alias("r")).select(F.col("r.ids").alias("id"), "r.compact", "r.plain")


@query("SELECT event_id::BIGINT AS id, (CASE WHEN event_id % 2 = 0 THEN 2 * event_id ELSE 2 * event_id - 1 END)::BIGINT AS zigzag, (" + " + ".join(f"(((event_id >> {k}) & 1)::BIGINT << {2 * k}) + ((((event_id * 31) >> {k}) & 1)::BIGINT << {2 * k + 1})" for k in range(30)) + ")::BIGINT AS mixed FROM events")
def codec_bits(spark, sf):
    """Codes of numbers of both signs, and two numbers with their bits in turn."""
    k = F.col("id")
    rows = T.read(spark, sf, "events").select(F.col("event_id").cast("long").alias("id"))
    signed = F.when(k % 2 == 0, k).otherwise(-k)
    return rows.select("id", Z.zigzag(signed).alias("zigzag"), Z.interleave(k, k * 31).alias("mixed"))


@query()
def codec_tracks(spark, sf):
    """Tracks as bytes and back, in both forms of chains."""
    rows = materialize(T.tracks(spark, sf), "tracks")
    coded = materialize(rows.select("user_id", "chain", Z.encode_points("chain").alias("p"), Z.encode_polyline("chain").alias("l")), "coded")
    return coded.select("user_id", F.length("p").alias("points_bytes"), F.length("l").alias("line_bytes"), (Z.decode_points("p") == F.col("chain")).alias("points_same"), (Z.decode_polyline("l") == F.col("chain")).alias("line_same"))
