"""Pieces of DuckDB SQL for the equivalents of queries."""

from __future__ import annotations


def deg(key: str) -> tuple[str, str]:
    return f"((({key}) * 7919) % 179801) / 1000.0::DOUBLE - 89.9::DOUBLE", f"((({key}) * 104729) % 359801) / 1000.0::DOUBLE - 179.9::DOUBLE"


def pts(name: str, table: str, key: str, extra: str = "") -> str:
    """CTE name(id, lat_deg, lng_deg, lat, lng, x, y, z)."""
    la, lo = deg(key)
    return f"{name} AS (SELECT *, cos(lng) * cos(lat) AS x, sin(lng) * cos(lat) AS y, sin(lat) AS z FROM (SELECT *, radians(lat_deg) AS lat, radians(lng_deg) AS lng FROM (SELECT ({key})::BIGINT AS id, {la} AS lat_deg, {lo} AS lng_deg{extra} FROM {table})))"


EV = pts("ev", "events", "event_id")
CUST = pts("cu", "customer", "c_custkey")
SUPP = pts("su", "supplier", "s_suppkey * 31 + 7")
LOCAL = "lo AS (SELECT *, cos(lng) * cos(lat) AS x, sin(lng) * cos(lat) AS y, sin(lat) AS z FROM (SELECT *, radians(lat_deg) AS lat, radians(lng_deg) AS lng FROM (SELECT event_id::BIGINT AS id, user_id::BIGINT AS user_id, ts, 40 + ((event_id * 7919) % 10007) / 10007.0::DOUBLE AS lat_deg, -74 + ((event_id * 104729) % 10009) / 10009.0::DOUBLE AS lng_deg FROM events)))"


def triple() -> str:
    """CTE t: three points a, b, c for each event."""
    parts = [("a", "event_id"), ("b", "event_id * 31 + 17"), ("c", "event_id * 57 + 101")]
    inner = ", ".join(f"{deg(k)[0]} AS {n}_latd, {deg(k)[1]} AS {n}_lngd" for n, k in parts)
    rad = ", ".join(f"radians({n}_latd) AS {n}_lat, radians({n}_lngd) AS {n}_lng" for n, _ in parts)
    xyz = ", ".join(f"cos({n}_lng) * cos({n}_lat) AS \"{n}x\", sin({n}_lng) * cos({n}_lat) AS \"{n}y\", sin({n}_lat) AS \"{n}z\"" for n, _ in parts)
    return f"t AS (SELECT *, {xyz} FROM (SELECT *, {rad} FROM (SELECT event_id::BIGINT AS id, {inner} FROM events)))"


V = tuple[str, str, str]


def vec(n: str) -> V:
    return f'"{n}x"', f'"{n}y"', f'"{n}z"'


def dot(a: V, b: V) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b)) + ")"


def cross(a: V, b: V) -> V:
    return f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"


def norm(a: V) -> str:
    return f"sqrt{dot(a, a)}"


def angle(a: V, b: V) -> str:
    return f"atan2({norm(cross(a, b))}, {dot(a, b)})"


def sub(a: V, b: V) -> V:
    return tuple(f"({x} - {y})" for x, y in zip(a, b))  # type: ignore[return-value]


def l2(a: V, b: V) -> str:
    d = sub(a, b)
    return f"least(4.0, {dot(d, d)})"


def r(expr: str, digits: int = 7) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def cells(source: str, level: int, out: str = "cells", keep: str = "") -> str:
    """CTEs up to ``out`` (id, cell_id BIGINT): the cells at a level of points (id, x, y, z) by a walk along the curve. Needs WITH RECURSIVE."""
    p = out
    low, shift = 1 << (60 - 2 * level), 61 - 2 * level
    return f"""{p}_f AS (SELECT *, CASE WHEN abs(x) > abs(y) THEN CASE WHEN abs(x) > abs(z) THEN CASE WHEN x < 0 THEN 3 ELSE 0 END ELSE CASE WHEN z < 0 THEN 5 ELSE 2 END END
      ELSE CASE WHEN abs(y) > abs(z) THEN CASE WHEN y < 0 THEN 4 ELSE 1 END ELSE CASE WHEN z < 0 THEN 5 ELSE 2 END END END AS f FROM {source}),
    {p}_u AS (SELECT *, CASE f WHEN 0 THEN y / x WHEN 1 THEN -x / y WHEN 2 THEN -x / z WHEN 3 THEN z / x WHEN 4 THEN z / y ELSE -y / z END AS u,
      CASE f WHEN 0 THEN z / x WHEN 1 THEN z / y WHEN 2 THEN -y / z WHEN 3 THEN y / x WHEN 4 THEN -x / y ELSE -x / z END AS v FROM {p}_f),
    {p}_s AS (SELECT *, CASE WHEN u >= 0 THEN 0.5 * sqrt(1 + 3 * u) ELSE 1 - 0.5 * sqrt(1 - 3 * u) END AS s, CASE WHEN v >= 0 THEN 0.5 * sqrt(1 + 3 * v) ELSE 1 - 0.5 * sqrt(1 - 3 * v) END AS t FROM {p}_u),
    {p}_w AS (SELECT id{keep}, f, greatest(0, least(1073741823, floor(s * 1073741824)))::BIGINT AS i, greatest(0, least(1073741823, floor(t * 1073741824)))::BIGINT AS j, 29 AS k, (f % 2)::INT AS o, 0::HUGEINT AS pos FROM {p}_s
      UNION ALL SELECT id{keep}, f, i, j, k - 1, xor(o, ([1, 0, 0, 3])[q + 1])::INT, pos * 4 + q FROM (SELECT *, ([0, 1, 3, 2, 0, 3, 1, 2, 2, 3, 1, 0, 2, 1, 3, 0])[(o * 4 + ((i >> k) & 1) * 2 + ((j >> k) & 1) + 1)::INT] AS q FROM {p}_w WHERE k >= {30 - level})),
    {p} AS (SELECT id{keep}, CASE WHEN f >= 4 THEN (f::HUGEINT * 2305843009213693952 + pos * {1 << shift} + {low} - 18446744073709551616)::BIGINT ELSE (f::HUGEINT * 2305843009213693952 + pos * {1 << shift} + {low})::BIGINT END AS cell_id FROM {p}_w WHERE k = {29 - level})"""


def unsigned(c: str) -> str:
    return f"(CASE WHEN {c} < 0 THEN {c}::HUGEINT + 18446744073709551616 ELSE {c}::HUGEINT END)"


def lsb(c: str) -> str:
    return f"({c} & (-{c}))"


def level(c: str) -> str:
    return f"(30 - (bit_count(({lsb(c)} - 1)::BIGINT) / 2)::INT)"


def parent(c: str, at: int) -> str:
    """By arithmetic on the unsigned value, signed again."""
    size = 1 << (61 - 2 * at)
    u = f"(({unsigned(c)} // {size}) * {size} + {size >> 1})"
    return f"(CASE WHEN {u} >= 9223372036854775808 THEN {u} - 18446744073709551616 ELSE {u} END)::BIGINT"


def rmin(c: str) -> str:
    return f"({unsigned(c)} - {lsb(c)} + 1)"


def rmax(c: str) -> str:
    return f"({unsigned(c)} + {lsb(c)} - 1)"


def edge_l2(x: V, a: V, b: V) -> str:
    """Squared chord from x to the edge from a to b."""
    n = cross(a, b)
    ends = f"least({l2(x, a)}, {l2(x, b)})"
    height = f"({dot(x, n)} / {norm(n)})"
    return f"CASE WHEN {dot(n, n)} > 0 AND {dot(cross(n, a), x)} > 0 AND {dot(cross(b, n), x)} > 0 THEN least({ends}, pow({height}, 2) + pow(1 - sqrt(greatest(0.0, 1 - pow({height}, 2))), 2)) ELSE {ends} END"


def uv_of(st: str) -> str:
    return f"CASE WHEN {st} >= 0.5 THEN (4 * {st} * {st} - 1) / 3 ELSE (1 - 4 * (1 - {st}) * (1 - {st})) / 3 END"


def on_face(u: str, v: str) -> V:
    """x, y, z of (u, v) on the face f, not normalised."""
    by_face = lambda *es: "CASE f " + " ".join(f"WHEN {k} THEN {e}" for k, e in enumerate(es[:5])) + f" ELSE {es[5]} END"
    return by_face("1", f"-{u}", f"-{u}", "-1", v, v), by_face(u, "1", f"-{v}", f"-{v}", "-1", u), by_face(v, v, "1", f"-{u}", f"-{u}", "-1")


def corners(source: str, level: int, out: str, keep: str = "") -> str:
    """CTE ``out`` (id, cell_id, c0x .. c3z): the corners of the cells of ``cells(..., out=source)``, counter-clockwise."""
    s = 30 - level
    at = {f"{n}{k}": uv_of(f"((({c} >> {s}) + {k}) << {s})::DOUBLE / 1073741824") for n, c in (("u", "i"), ("v", "j")) for k in (0, 1)}
    raw, unit = [], []
    for k, (u, v) in enumerate((("u0", "v0"), ("u1", "v0"), ("u1", "v1"), ("u0", "v1"))):
        raw += [f"{e} AS r{k}{c}" for e, c in zip(on_face(u, v), "xyz")]
        unit += [f"r{k}{c} / sqrt(r{k}x * r{k}x + r{k}y * r{k}y + r{k}z * r{k}z) AS c{k}{c}" for c in "xyz"]
    ends = ", ".join(f"{e} AS {n}" for n, e in at.items())
    return f"{out}_e AS (SELECT id, f, {ends} FROM {source}_w WHERE k = 29), {out}_r AS (SELECT id, {', '.join(raw)} FROM {out}_e), {out} AS (SELECT r.id, cell_id, {', '.join(unit)} FROM {out}_r AS r JOIN {source} USING (id))"


def corner(table: str, k: int) -> V:
    return f"{table}.c{k}x", f"{table}.c{k}y", f"{table}.c{k}z"


def cell_point_l2(table: str, x: V) -> str:
    four = [(corner(table, k), corner(table, (k + 1) % 4)) for k in range(4)]
    inside = " AND ".join(f"{dot(x, cross(a, b))} >= 0" for a, b in four)
    return f"CASE WHEN {inside} THEN 0.0 ELSE least({', '.join(edge_l2(x, a, b) for a, b in four)}) END"
