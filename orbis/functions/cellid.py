"""The 64-bit cell key: 3 face bits, a Hilbert position of 60 bits and a marker bit; bit algebra as Columns.

Keys are BIGINT in two's complement. Their order is unsigned: sort and compare by key(), never by
the id itself. Building a key from a point and finding a cell's centre walk 30 levels of the curve,
which is one Arrow kernel each; all else is native. Null in, null out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from orbis.functions import types

MAX_LEVEL = 30
#: Position by (orientation, ij), ij by (orientation, position), and the change of orientation by position.
IJ_TO_POS = np.array([[0, 1, 3, 2], [0, 3, 1, 2], [2, 3, 1, 0], [2, 1, 3, 0]])
POS_TO_IJ = np.array([[0, 1, 3, 2], [0, 2, 3, 1], [3, 2, 0, 1], [3, 1, 0, 2]])
POS_TO_ORIENTATION = np.array([1, 0, 0, 3])
#: The derivative of each metric of the quadratic projection, and its dimension.
METRICS = {
    "min_area": (2, 8 * math.sqrt(2) / 9), "max_area": (2, 2.635799256963161491), "avg_area": (2, 4 * math.pi / 6),
    "min_angle_span": (1, 4 / 3), "max_angle_span": (1, 1.704897179199218452), "avg_angle_span": (1, math.pi / 2),
    "min_width": (1, 2 * math.sqrt(2) / 3), "max_width": (1, 1.704897179199218452), "avg_width": (1, 1.434523672886099389),
    "min_edge": (1, 2 * math.sqrt(2) / 3), "max_edge": (1, 1.704897179199218452), "avg_edge": (1, 1.459213746386106062),
    "min_diag": (1, 8 * math.sqrt(2) / 9), "max_diag": (1, 2.438654594434021032), "avg_diag": (1, 2.060422738998471683),
}
MAX_EDGE_ASPECT, MAX_DIAG_ASPECT = 1.442615274452682920, math.sqrt(3)


# --- Kernels (NumPy) ----------------------------------------------------------------------------


def st_to_uv(s):
    return np.where(s >= 0.5, (4 * s * s - 1) / 3, (1 - 4 * (1 - s) * (1 - s)) / 3)


def uv_to_st(u):
    return np.where(u >= 0, 0.5 * np.sqrt(1 + 3 * np.abs(u)), 1 - 0.5 * np.sqrt(1 + 3 * np.abs(u)))


def st_to_ij(s):
    return np.clip(np.floor(s * (1 << 30)), 0, (1 << 30) - 1).astype(np.int64)


def xyz_to_face(x, y, z):
    ax, ay, az = np.abs(x), np.abs(y), np.abs(z)
    axis = np.where(ax > ay, np.where(ax > az, 0, 2), np.where(ay > az, 1, 2))
    value = np.choose(axis, [x, y, z])
    return axis + 3 * (value < 0)


def face_xyz_to_uv(face, x, y, z):
    """(u, v) on a face whose plane the vector meets."""
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.choose(face, [y / x, -x / y, -x / z, z / x, z / y, -y / z])
        v = np.choose(face, [z / x, z / y, -y / z, y / x, -x / y, -x / z])
    return u, v


def face_uv_to_xyz(face, u, v):
    one = np.ones_like(u)
    x = np.choose(face, [one, -u, -u, -one, v, v])
    y = np.choose(face, [u, one, -v, -v, -one, u])
    z = np.choose(face, [v, v, one, -u, -u, -one])
    return x, y, z


def from_face_ij(face, i, j):
    """Leaf ids as int64."""
    face = np.asarray(face, np.int64)
    orientation, pos = face & 1, np.zeros(np.shape(i), np.uint64)
    for k in range(MAX_LEVEL - 1, -1, -1):
        p = IJ_TO_POS[orientation, ((i >> k) & 1) * 2 + ((j >> k) & 1)]
        pos = pos << np.uint64(2) | p.astype(np.uint64)
        orientation = orientation ^ POS_TO_ORIENTATION[p]
    return (face.astype(np.uint64) << np.uint64(61) | pos << np.uint64(1) | np.uint64(1)).astype(np.int64)


def to_face_ij(ids):
    """face, i, j of the lower corner leaf and level of each id."""
    u = np.asarray(ids, np.int64).view(np.uint64)
    low = u & (~u + np.uint64(1))
    level = MAX_LEVEL - (np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 2)
    face = (u >> np.uint64(61)).astype(np.int64)
    orientation, i, j = face & 1, np.zeros(u.shape, np.int64), np.zeros(u.shape, np.int64)
    for k in range(MAX_LEVEL - 1, -1, -1):
        p = (u >> np.uint64(2 * k + 1) & np.uint64(3)).astype(np.int64)
        used = MAX_LEVEL - k <= level
        ij = np.where(used, POS_TO_IJ[orientation, p], 0)
        i, j = i << 1 | ij >> 1, j << 1 | ij & 1
        orientation = np.where(used, orientation ^ POS_TO_ORIENTATION[p], orientation)
    return face, i, j, level, orientation


def from_xyz(x, y, z):
    face = xyz_to_face(x, y, z)
    u, v = face_xyz_to_uv(face, x, y, z)
    return from_face_ij(face, st_to_ij(uv_to_st(u)), st_to_ij(uv_to_st(v)))


def parent_np(ids, level):
    u = np.asarray(ids, np.int64).view(np.uint64)
    low = np.uint64(1) << (2 * (MAX_LEVEL - np.asarray(level))).astype(np.uint64)
    return ((u & (~low + np.uint64(1))) | low).view(np.int64)


def bounds_uv(ids):
    """face and (u_lo, u_hi, v_lo, v_hi)."""
    face, i, j, level, _ = to_face_ij(ids)
    size = np.int64(1) << (MAX_LEVEL - level)
    st = [k / (1 << 30) for k in (i, i + size, j, j + size)]
    return face, *(st_to_uv(s) for s in st)


def center_xyz(ids):
    face, i, j, level, _ = to_face_ij(ids)
    half = (np.int64(1) << (MAX_LEVEL - level)) / 2
    x, y, z = face_uv_to_xyz(face, st_to_uv((i + half) / (1 << 30)), st_to_uv((j + half) / (1 << 30)))
    n = np.sqrt(x * x + y * y + z * z)
    return x / n, y / n, z / n


def vertices_xyz(ids):
    """(n, 4, 3): corners in counter-clockwise order from the lower left one."""
    face, u0, u1, v0, v1 = bounds_uv(ids)
    out = [np.stack(face_uv_to_xyz(face, u, v), -1) for u, v in ((u0, v0), (u1, v0), (u1, v1), (u0, v1))]
    out = np.stack(out, 1)
    return out / np.linalg.norm(out, axis=2, keepdims=True)


def neighbors_np(ids, level, corners: bool = True):
    """(n, 8 or 4): the ids at ``level`` around each cell, edge neighbours first (down, right, up, left).

    Steps beyond a face are wrapped through space. At a cube corner a diagonal step meets a cell that is
    there already.
    """
    face, i, j, _, _ = to_face_ij(parent_np(ids, level))
    size = 1 << (MAX_LEVEL - level)
    steps = [(0, -1), (1, 0), (0, 1), (-1, 0)] + [(-1, -1), (1, -1), (1, 1), (-1, 1)] * corners
    return np.stack([parent_np(_wrapped(face, i + a * size, j + b * size), level) for a, b in steps], -1)


def _wrapped(face, i, j):
    """Leaf ids of (i, j) that may be up to one cell outside the face."""
    top = (1 << 30) - 1
    inside = (i >= 0) & (j >= 0) & (i <= top) & (j <= top)
    own = from_face_ij(face, np.clip(i, 0, top), np.clip(j, 0, top))
    # Outside: extend the face's plane linearly by one leaf and see on which face that point lies.
    ic, jc = np.clip(i, -1, top + 1), np.clip(j, -1, top + 1)
    limit = 1 + 2.0**-52
    u = np.clip((2 * (ic - (1 << 29)) + 1) / (1 << 30), -limit, limit)
    v = np.clip((2 * (jc - (1 << 29)) + 1) / (1 << 30), -limit, limit)
    x, y, z = face_uv_to_xyz(face, u, v)
    f = xyz_to_face(x, y, z)
    a, b = face_xyz_to_uv(f, x, y, z)
    out = from_face_ij(f, st_to_ij(0.5 * (a + 1)), st_to_ij(0.5 * (b + 1)))
    return np.where(inside, own, out)


# --- Columns ------------------------------------------------------------------------------------


@F.pandas_udf(types.L)
def _leaf(p: pd.DataFrame) -> pd.Series:
    x, y, z = (p[c].to_numpy(float) for c in "xyz")
    bad = ~np.isfinite(x + y + z)
    out = pd.Series(from_xyz(np.where(bad, 1, x), np.where(bad, 0, y), np.where(bad, 0, z)), dtype="Int64")
    out[bad] = pd.NA
    return out


@F.pandas_udf(types.POINT)
def _center(c: pd.Series) -> pd.DataFrame:
    none = c.isna().to_numpy()
    out = pd.DataFrame(dict(zip("xyz", center_xyz(c.fillna(1).to_numpy(np.int64)))))
    out[none] = np.nan
    return out


@F.pandas_udf(types.CELL)
def _decode(c: pd.Series) -> pd.DataFrame:
    ids = c.fillna(1).to_numpy(np.int64)
    face, i, j, level, orientation = to_face_ij(ids)
    _, u0, u1, v0, v1 = bounds_uv(ids)
    return pd.DataFrame({"face": face, "i": i, "j": j, "level": level, "orientation": orientation, "u_lo": u0, "u_hi": u1, "v_lo": v0, "v_hi": v1})


@F.pandas_udf(types.POINTS)
def _vertices(c: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip("xyz", map(float, p))) for p in v] for v in vertices_xyz(c.fillna(1).to_numpy(np.int64))])


@F.pandas_udf(types.CELLS)
def _neighbors(c: pd.Series, level: pd.Series) -> pd.Series:
    out = np.zeros((len(c), 8), np.int64)
    for l in level.unique():
        own = (level == l).to_numpy()
        out[own] = neighbors_np(c.to_numpy(np.int64)[own], int(l))
    return pd.Series(list(out))


def from_point(p: Column) -> Column:
    return _leaf(p)


def to_point(c: Column) -> Column:
    return F.when(c.isNotNull(), _center(c))


def decoded(c: Column) -> Column:
    """face, i, j (lower corner), level, orientation and bounds in (u, v)."""
    return F.when(c.isNotNull(), _decode(c))


def vertices(c: Column) -> Column:
    return F.when(c.isNotNull(), _vertices(c))


def all_neighbors(c: Column, at: Column | int) -> Column:
    """Edge and corner neighbours at a level not finer than the cell's, each once."""
    n = F.array_distinct(_neighbors(c, F.lit(at) if isinstance(at, int) else at))
    return F.array_remove(n, parent(c, at))


def edge_neighbors(c: Column) -> Column:
    return F.slice(_neighbors(c, level(c)), 1, 4)


def key(c: Column) -> Column:
    """An order-preserving BIGINT: the id with its sign bit flipped."""
    return c.bitwiseXOR(F.lit(-(1 << 63)))


def lsb(c: Column) -> Column:
    return c.bitwiseAND(-c)


def lsb_at(at: Column | int) -> Column:
    return F.lit(1 << 2 * (MAX_LEVEL - at)).cast("long") if isinstance(at, int) else F.call_function("shiftleft", F.lit(1).cast("long"), (2 * (MAX_LEVEL - at)).cast("int"))


def level(c: Column) -> Column:
    return (MAX_LEVEL - F.bit_count(lsb(c) - 1) / 2).cast("int")


def face(c: Column) -> Column:
    return F.shiftrightunsigned(c, 61).cast("int")


def pos(c: Column) -> Column:
    return c.bitwiseAND(F.lit((1 << 61) - 1))


def is_valid(c: Column) -> Column:
    return (c != 0) & (face(c) < 6) & (lsb(c).bitwiseAND(F.lit(0x1555555555555555)) != 0)


def is_leaf(c: Column) -> Column:
    return c.bitwiseAND(F.lit(1)) != 0


def is_face(c: Column) -> Column:
    return c.bitwiseAND(F.lit((1 << 60) - 1)) == 0


def from_face_pos_level(f: Column, p: Column, at: int) -> Column:
    c = F.shiftleft(f.cast("long"), 61).bitwiseOR(p.bitwiseOR(F.lit(1).cast("long")))
    return parent(c, at)


def parent(c: Column, at: Column | int) -> Column:
    low = lsb_at(at)
    return c.bitwiseAND(-low).bitwiseOR(low)


def ancestors(c: Column, levels: list[int] | None = None) -> Column:
    """Array of the ancestors at the given levels that aren't finer than the cell, itself included."""
    if levels is None:
        levels = list(range(MAX_LEVEL + 1))
    return F.filter(F.array(*[F.when(level(c) >= l, parent(c, l)) for l in levels]), lambda x: x.isNotNull())


def range_min(c: Column) -> Column:
    return c - (lsb(c) - 1)


def range_max(c: Column) -> Column:
    return c + (lsb(c) - 1)


def contains(a: Column, b: Column) -> Column:
    return (key(b) >= key(range_min(a))) & (key(b) <= key(range_max(a)))


def intersects(a: Column, b: Column) -> Column:
    return contains(a, b) | contains(b, a)


def child(c: Column, k: Column | int) -> Column:
    step = F.shiftright(lsb(c), 2)
    return c + step * (2 * (F.lit(k) if isinstance(k, int) else k) - 3)


def children(c: Column) -> Column:
    return F.when(~is_leaf(c), F.array(*[child(c, k) for k in range(4)]))


def child_begin(c: Column, at: int) -> Column:
    return range_min(c) + (lsb_at(at) - 1)


def children_at(c: Column, at: int) -> Column:
    """All descendants at a level; 4 to the power of the difference."""
    n = F.shiftright(lsb(c), 2 * (MAX_LEVEL - at)) - 1
    return F.transform(F.sequence(F.lit(0).cast("long"), n), lambda k: child_begin(c, at) + k * F.lit(1 << (2 * (MAX_LEVEL - at) + 1)))


def child_position(c: Column, at: int) -> Column:
    return F.shiftrightunsigned(c, 2 * (MAX_LEVEL - at) + 1).bitwiseAND(F.lit(3)).cast("int")


def distance_from_begin(c: Column) -> Column:
    """Place among the cells of the same level along the whole curve."""
    return F.call_function("shiftrightunsigned", c, (2 * (MAX_LEVEL - level(c)) + 1).cast("int"))


def _at_place(c: Column, n: Column) -> Column:
    return F.call_function("shiftleft", n, (2 * (MAX_LEVEL - level(c)) + 1).cast("int")).bitwiseOR(lsb(c))


def _cells(c: Column) -> Column:
    return F.lit(6).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), (2 * level(c)).cast("int"))


def advance(c: Column, steps: Column | int) -> Column:
    """So many cells on along the curve; clamped to the first cell and to the end, which is beyond the last one."""
    n = F.least(F.greatest(distance_from_begin(c) + steps, F.lit(0).cast("long")), _cells(c))
    return _at_place(c, n)


def advance_wrap(c: Column, steps: Column | int) -> Column:
    return _at_place(c, F.pmod(distance_from_begin(c) + steps, _cells(c)))


def next_cell(c: Column) -> Column:
    return _at_place(c, distance_from_begin(c) + 1)


def prev_wrap(c: Column) -> Column:
    return advance_wrap(c, -1)


def next_wrap(c: Column) -> Column:
    return advance_wrap(c, 1)


def begin(at: int) -> Column:
    return lsb_at(at)


def common_ancestor_level(a: Column, b: Column) -> Column:
    """Level of the smallest cell that holds both, -1 on different faces."""
    x = F.greatest(key(a.bitwiseXOR(b)), key(lsb(a)), key(lsb(b)))
    bits = F.length(F.ltrim(F.bin(key(x)), F.lit("0"))) - 1
    return F.greatest(F.lit(-1), F.shiftright(60 - bits, 1)).cast("int")


def to_token(c: Column) -> Column:
    return F.when(c == 0, "X").otherwise(F.rtrim(F.lower(F.lpad(F.hex(c), 16, "0")), F.lit("0")))


def from_token(t: Column) -> Column:
    """Null for what isn't a token."""
    return F.when(t.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(F.rpad(t, 16, "0"), 16, -10).cast("long")).when(t == "X", F.lit(0).cast("long"))


def token_valid(t: Column) -> Column:
    return t.rlike("^[0-9a-fA-F]{1,16}$") & is_valid(from_token(t))


def size_ij(c: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), (MAX_LEVEL - level(c)).cast("int"))


def metric(name: str, at: Column | int) -> Column:
    dim, deriv = METRICS[name]
    return F.lit(deriv) * F.pow(F.lit(2.0), -dim * (F.lit(at) if isinstance(at, int) else at))


def metric_value(name: str, at: int) -> float:
    dim, deriv = METRICS[name]
    return deriv * 2.0 ** (-dim * at)


def max_level_for(name: str, value: float) -> int:
    """The finest level at which the metric is at least ``value``."""
    return max([l for l in range(MAX_LEVEL + 1) if metric_value(name, l) >= value], default=0)


def min_level_for(name: str, value: float) -> int:
    """The coarsest level at which the metric is at most ``value``."""
    return min([l for l in range(MAX_LEVEL + 1) if metric_value(name, l) <= value], default=MAX_LEVEL)


def closest_level(name: str, value: float) -> int:
    dim = METRICS[name][0]
    return min_level_for(name, (math.sqrt(2) if dim == 1 else 2) * value)
