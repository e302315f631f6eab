"""Edges cut by faces, cells and rectangles, and edge chains of planar projections.

An edge's chord is a straight line, and the sides of a rectangle on a cube face are planes through
the centre of the sphere. So along the chord each side is a linear function of one parameter, and cutting is
the same intersection of half lines in the plane and on the sphere, in built-in functions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from orbis.functions import points as P
from orbis.functions import types
from orbis.operators import kernels as K


def _stretch(sides: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """The parameters between which all functions, given by their values at 0 and 1, are at least 0."""
    lo, hi = [F.lit(0.0)], [F.lit(1.0)]
    for at0, at1 in sides:
        cut = at0 / F.nullif(at0 - at1, F.lit(0.0))
        lo.append(F.when(at0 < 0, F.when(at1 < 0, 2.0).otherwise(cut)).otherwise(0.0))
        hi.append(F.when(at1 < 0, F.when(at0 < 0, -1.0).otherwise(cut)).otherwise(1.0))
    return F.greatest(*lo), F.least(*hi)


def _segment(lo: Column, hi: Column, at) -> Column:
    """Struct of both ends, at(t) giving a place's coordinates; null if nothing is left."""

    def ends(t: Column) -> Column:
        return P.let(F.struct(*[c.alias(n) for n, c in zip("pq", at(t["lo"]))]), lambda a: P.let(F.struct(*[c.alias(n) for n, c in zip("pq", at(t["hi"]))]), lambda b: F.struct(a["p"].alias("x0"), a["q"].alias("y0"), b["p"].alias("x1"), b["q"].alias("y1"))))

    return P.let(F.struct(lo.alias("lo"), hi.alias("hi")), lambda t: F.when(t["lo"] <= t["hi"], ends(t)))


def clip_planar(x0: Column, y0: Column, x1: Column, y1: Column, x_lo, x_hi, y_lo, y_hi) -> Column:
    """The part of a planar edge inside a closed rectangle: struct x0, y0, x1, y1, or null."""
    x_lo, x_hi, y_lo, y_hi = (P.lit(v) for v in (x_lo, x_hi, y_lo, y_hi))
    lo, hi = _stretch([(x0 - x_lo, x1 - x_lo), (x_hi - x0, x_hi - x1), (y0 - y_lo, y1 - y_lo), (y_hi - y0, y_hi - y1)])
    return _segment(lo, hi, lambda t: (x0 + t * (x1 - x0), y0 + t * (y1 - y0)))


def on_face(p: Column, face: Column) -> Column:
    """Struct u, v, w: a vector in the axes of a cube face, w along its normal."""
    x, y, z = (p[k] for k in "xyz")
    axes = [(y, z, x), (-x, z, y), (-x, -y, z), (-z, -y, -x), (-z, x, -y), (y, x, -z)]

    def pick(k: int) -> Column:
        out = F.when(face == 0, axes[0][k])
        for f in range(1, 6):
            out = out.when(face == f, axes[f][k])
        return out

    return F.struct(*[pick(k).alias(n) for k, n in enumerate("uvw")])


def clip_on_face(a: Column, b: Column, face, u_lo=-1.0, u_hi=1.0, v_lo=-1.0, v_hi=1.0) -> Column:
    """The part of edge a, b inside a rectangle of a cube face, as (u, v) of both ends: struct x0, y0, x1, y1, or null.

    The whole face by default; wider limits give a padded one, and bounds_uv of a cell give that cell.
    """
    face = P.lit(face)
    u_lo, u_hi, v_lo, v_hi = (P.lit(v) for v in (u_lo, u_hi, v_lo, v_hi))

    def cut(e: Column) -> Column:
        p, q = e["p"], e["q"]

        def side(f) -> tuple[Column, Column]:
            return f(p), f(q)

        lo, hi = _stretch([side(f) for f in (lambda c: c["u"] - u_lo * c["w"], lambda c: u_hi * c["w"] - c["u"], lambda c: c["v"] - v_lo * c["w"], lambda c: v_hi * c["w"] - c["v"])])

        def at(t: Column) -> tuple[Column, Column]:
            w = F.nullif(p["w"] + t * (q["w"] - p["w"]), F.lit(0.0))
            return (p["u"] + t * (q["u"] - p["u"])) / w, (p["v"] + t * (q["v"] - p["v"])) / w

        return _segment(lo, hi, at)

    return P.let(F.struct(on_face(a, face).alias("p"), on_face(b, face).alias("q")), cut)


def face_segments(a: Column, b: Column) -> Column:
    """Array of struct face, s (as clip_on_face): the parts of an edge on the faces that it passes, in the order of faces."""
    each = F.transform(F.array(*[F.lit(f) for f in range(6)]), lambda f: F.struct(f.alias("face"), clip_on_face(a, b, f).alias("s")))
    return F.filter(each, lambda x: x["s"].isNotNull())


# --- Projected chains ------------------------------------------------------------------------------

PLANAR = types.T.ArrayType(types.struct(x=types.D, y=types.D))


def _plane(p: np.ndarray, mercator: bool, half: float) -> np.ndarray:
    k = half / math.pi
    y = np.arctanh(np.clip(p[2], -1, 1)) if mercator else math.atan2(p[2], math.hypot(p[0], p[1]))
    return np.array([k * math.atan2(p[1], p[0]), k * y])


def _sphere(q: np.ndarray, mercator: bool, half: float) -> np.ndarray:
    k = math.pi / half
    lng, lat = q[0] * k, math.asin(math.tanh(q[1] * k)) if mercator else q[1] * k
    return np.array([math.cos(lng) * math.cos(lat), math.sin(lng) * math.cos(lat), math.sin(lat)])


def _near(q: np.ndarray, base: np.ndarray, half: float) -> np.ndarray:
    """q moved by whole turns to within half a turn of base."""
    return np.array([q[0] - 2 * half * round((q[0] - base[0]) / (2 * half)), q[1]])


PROBES = (0.25, 0.5, 0.75)


def _cross(a: tuple, b: tuple) -> tuple:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _dot(a: tuple, b: tuple) -> float:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _fits(p0: np.ndarray, p1: np.ndarray, q0: np.ndarray, q1: np.ndarray, limit: float, mercator: bool, half: float) -> bool:
    """Whether the planar edge q0, q1 stays near the geodesic edge p0, p1: kernels.point_edge_l2() in plain floats, as arrays of three cost more than they hold."""
    a, b, (u0, v0), (u1, v1) = p0.tolist(), p1.tolist(), q0.tolist(), q1.tolist()
    n = _cross(a, b)
    n2, first, last, k = _dot(n, n), _cross(n, a), _cross(b, n), math.pi / half
    for t in PROBES:
        lng, y = (u0 + t * (u1 - u0)) * k, (v0 + t * (v1 - v0)) * k
        lat = math.asin(math.tanh(y)) if mercator else y
        x = math.cos(lng) * math.cos(lat), math.sin(lng) * math.cos(lat), math.sin(lat)
        near = min(4.0, *((x[0] - e[0]) ** 2 + (x[1] - e[1]) ** 2 + (x[2] - e[2]) ** 2 for e in (a, b)))
        if n2 > 0 and _dot(first, x) > 0 and _dot(last, x) > 0:
            s = _dot(x, n) / math.sqrt(n2)
            near = min(near, s * s + (1 - math.sqrt(max(0.0, 1 - s * s))) ** 2)
        if not near <= limit:
            return False
    return True


def _refined(p0, q0, p1, q1, limit: float, mercator: bool, half: float, geodesic: bool) -> list[tuple]:
    """(p, q) of the ends of pieces that fit, the first end left out; pieces are halved on the sphere or in the plane."""
    out, todo = [], [(p0, q0, p1, q1, 0)]
    while todo:
        a, qa, b, qb, depth = todo.pop()
        if depth >= 30 or _fits(a, b, qa, qb, limit, mercator, half):
            out.append((b, qb))
            continue
        if geodesic:
            m = a + b
            m = m / np.linalg.norm(m)
            qm = _near(_plane(m, mercator, half), qa, half)
            qb = _near(qb, qm, half)
        else:
            qm = (qa + qb) / 2
            m = _sphere(qm, mercator, half)
        todo += [(m, qm, b, qb, depth + 1), (a, qa, m, qm, depth + 1)]
    return out


def tessellator(projection: str = "plate_carree", half: float = 180.0):
    """project(chain, tolerance) and unproject(planar chain, tolerance), Arrow functions of columns.

    project gives a planar chain that stays within an angle of the geodesic edges of a chain; it doesn't
    jump at the 180th meridian, so x may leave [-half, half]. unproject gives points whose geodesic edges
    stay within an angle of the planar edges.
    """
    if projection not in ("plate_carree", "mercator"):
        raise ValueError(projection)
    mercator = projection == "mercator"

    @F.pandas_udf(PLANAR)
    def project(chain: pd.Series, tolerance: pd.Series) -> pd.Series:
        rows = []
        for c, t in zip(chain, tolerance):
            points = [np.array([p["x"], p["y"], p["z"]]) for p in c]
            flat = [_plane(points[0], mercator, half)] if points else []
            for p, q in zip(points, points[1:]):
                end = _near(_plane(q, mercator, half), flat[-1], half)
                flat += [x for _, x in _refined(p, flat[-1], q, end, 4 * math.sin(t / 2) ** 2, mercator, half, True)]
            rows.append([{"x": float(x), "y": float(y)} for x, y in flat])
        return pd.Series(rows)

    @F.pandas_udf(types.POINTS)
    def unproject(chain: pd.Series, tolerance: pd.Series) -> pd.Series:
        rows = []
        for c, t in zip(chain, tolerance):
            flat = [np.array([p["x"], p["y"]]) for p in c]
            points = [_sphere(flat[0], mercator, half)] if len(flat) else []
            for p, q in zip(flat, flat[1:]):
                points += [x for x, _ in _refined(points[-1], p, _sphere(q, mercator, half), q, 4 * math.sin(t / 2) ** 2, mercator, half, False)]
            rows.append([dict(zip("xyz", map(float, x))) for x in points])
        return pd.Series(rows)

    return project, unproject
