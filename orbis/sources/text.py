"""Text format of geometry: points ``lat:lng`` in degrees, lists separated by commas, loops by semicolons, parts of an index by #."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orbis.functions import bounds as B
from orbis.functions import cellid as C
from orbis.functions import points as P


def parse_latlng(t: Column) -> Column:
    """Null for what isn't two numbers."""
    parts = F.split(F.trim(t), ":")
    lat, lng = (F.get(parts, k).try_cast("double") for k in (0, 1))
    return F.when((F.size(parts) == 2) & lat.isNotNull() & lng.isNotNull(), P.latlng_degrees(lat, lng))


def parse_point(t: Column) -> Column:
    ll = parse_latlng(t)
    return F.when(ll.isNotNull(), P.to_point(ll))


def _items(t: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(t, separator), lambda x: F.trim(x)), lambda x: x != "")


def parse_points(t: Column) -> Column:
    return F.transform(_items(t, ","), lambda x: parse_point(x))


def parse_latlngs(t: Column) -> Column:
    return F.transform(_items(t, ","), lambda x: parse_latlng(x))


def parse_edges(t: Column) -> Column:
    def edge(x: Column) -> Column:
        ends = parse_points(x)
        return F.struct(F.get(ends, F.lit(0)).alias("a"), F.get(ends, F.lit(1)).alias("b"))

    return F.transform(_items(t, ";"), lambda x: edge(x))


def parse_rect(t: Column) -> Column:
    """The bound of the listed points, by repeated extension."""
    return F.aggregate(parse_latlngs(t), B.rect_empty(), lambda r, ll: B.rect_add(r, ll))


def parse_cell(t: Column) -> Column:
    """Debug form ``face/digits``."""
    face, digits = F.substring_index(t, "/", 1).try_cast("int"), F.substring_index(t, "/", -1)
    n = F.length(digits)
    path = F.when(n > 0, F.conv(digits, 4, 10).cast("long")).otherwise(F.lit(0).cast("long"))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), (2 * (30 - n)).cast("int"))
    whole = F.shiftleft(face.cast("long"), 61).bitwiseOR(F.call_function("shiftleft", path, (2 * (30 - n) + 1).cast("int"))).bitwiseOR(low)
    return F.when(t.rlike("^[0-5]/[0-3]{0,30}$"), whole)


def parse_cells(t: Column) -> Column:
    return F.transform(_items(t, ","), lambda x: parse_cell(x))


def parse_loop(t: Column) -> Column:
    """``empty`` and ``full`` give loops of one vertex: the north and the south pole."""
    return F.when(F.trim(t) == "empty", F.array(P.point(0, 0, 1))).when(F.trim(t) == "full", F.array(P.point(0, 0, -1))).otherwise(parse_points(t))


def parse_polyline(t: Column) -> Column:
    return parse_points(t)


def parse_polygon(t: Column) -> Column:
    return F.transform(_items(t, ";"), lambda x: parse_loop(x))


def parse_index(t: Column) -> Column:
    """Array of shapes (dimension, chains) of ``points # polylines # polygons``; shapes of one part are separated by |."""
    parts = F.split(t, "#")
    part = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(""))
    shape = lambda d, chains: F.struct(F.lit(d).alias("dimension"), chains.alias("chains"))
    points = F.transform(_items(part(0), r"\|"), lambda x: parse_point(x))
    zero = F.when(F.size(points) > 0, F.array(shape(0, F.array(points)))).otherwise(F.array().cast("array<struct<dimension:int,chains:array<array<struct<x:double,y:double,z:double>>>>>"))
    lines = F.transform(_items(part(1), r"\|"), lambda x: shape(1, F.array(parse_polyline(x))))
    areas = F.transform(_items(part(2), r"\|"), lambda x: shape(2, parse_polygon(x)))
    return F.concat(zero, lines, areas)


def snap_point(p: Column, level: int) -> Column:
    return C.to_point(C.parent(C.from_point(p), level))


def _number(x: Column) -> Column:
    """Up to 15 significant digits, without a fraction of zeros."""
    return F.regexp_replace(F.round(x, 12).cast("string"), r"\.0$", "")


def format_latlng(ll: Column) -> Column:
    return F.concat(_number(F.degrees(ll["lat"])), F.lit(":"), _number(F.degrees(ll["lng"])))


def format_point(p: Column) -> Column:
    return format_latlng(P.to_latlng(p))


def format_points(chain: Column) -> Column:
    return F.array_join(F.transform(chain, format_point), ", ")


def format_polygon(loops: Column) -> Column:
    return F.array_join(F.transform(loops, format_points), "; ")


def format_rect(r: Column) -> Column:
    return F.concat(format_latlng(B.rect_vertex(r, 0)), F.lit(", "), format_latlng(B.rect_vertex(r, 2)))


def format_cell(c: Column) -> Column:
    n = C.level(c)
    path = F.call_function("shiftrightunsigned", C.pos(c), (2 * (30 - n) + 1).cast("int"))
    digits = F.when(n == 0, "").otherwise(F.call_function("lpad", F.conv(path.cast("string"), 10, 4), n, F.lit("0")))
    return F.concat(C.face(c).cast("string"), F.lit("/"), digits)
