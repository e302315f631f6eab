"""Constructive kernels: buffers, parts of polylines in polygons, snapping, chains of edges. For the shapes of one row each."""

from __future__ import annotations

import math

import numpy as np

from orbis.functions import cellid as C
from orbis.operators import kernels as K

Loops = list[np.ndarray]


def union_all(polygons: list[Loops]) -> Loops:
    """Union of many polygons, in pairs, so that an edge takes part in log n overlays."""
    while len(polygons) > 1:
        paired = [K.overlay(*polygons[k : k + 2], "union") for k in range(0, len(polygons) - 1, 2)]
        polygons = paired + polygons[len(paired) * 2 :]
    return polygons[0] if polygons else []


# --- Buffers ----------------------------------------------------------------------------------------


def _arc(center: np.ndarray, first: np.ndarray, radius: float, turn: float, steps: int) -> np.ndarray:
    """steps + 1 points at a distance from center, from direction ``first`` counter-clockwise by an angle."""
    side = np.cross(center, first)
    t = turn * np.arange(steps + 1)[:, None] / steps
    return math.cos(radius) * center + math.sin(radius) * (np.cos(t) * first + np.sin(t) * side)


def disc(center: np.ndarray, radius: float, segments: int) -> Loops:
    """A regular polygon with its vertices at a distance."""
    return [_arc(center, K.reference_direction(center), radius, 2 * math.pi, segments)[:-1]]


def capsule(a: np.ndarray, b: np.ndarray, radius: float, segments: int, flat: bool = False) -> Loops:
    """What lies within a distance of edge a, b; with ``flat`` ends only what lies beside it."""
    n = np.cross(a, b)
    if not n.any():
        return [] if flat else disc(a, radius, segments)
    left = n / np.linalg.norm(n)
    ends = [1, 1] if flat else [max(2, segments // 2)] * 2
    back, front = _arc(a, left, radius, math.pi, ends[0]), _arc(b, -left, radius, math.pi, ends[1])
    return [np.concatenate([back, front])]


def buffered(chains: Loops, radius: float, dimension: int, segments: int = 16, flat: bool = False) -> Loops:
    """Points, polylines or loops grown by an angle, or loops shrunk by a negative one.

    Arcs are polygons with ``segments`` edges a turn and vertices at the distance, so the result lies inside
    the true buffer and reaches at least cos(pi / segments) of it. Only polylines have flat ends.
    """
    if dimension < 2 and radius < 0:
        return []
    if radius == 0:
        return chains if dimension == 2 else []
    r = abs(radius)
    if dimension == 0:
        return union_all([disc(p, r, segments) for c in chains for p in np.unique(c, axis=0)])
    parts = []
    for c in chains:
        ends = zip(c, np.roll(c, -1, 0)) if dimension == 2 else zip(c[:-1], c[1:])
        whole = [capsule(a, b, r, segments) for a, b in ends]
        if flat and dimension == 1 and len(c) > 1:
            whole = [capsule(a, b, r, segments, True) for a, b in zip(c[:-1], c[1:])] + [disc(p, r, segments) for p in c[1:-1]]
        elif dimension == 1 and len(c) == 1 and not flat:
            whole = [disc(c[0], r, segments)]
        parts += whole
    edge = union_all([p for p in parts if p])
    if dimension == 1:
        return edge
    return K.overlay(chains, edge, "union" if radius > 0 else "difference")


# --- Relations and parts ------------------------------------------------------------------------------


def relation(a: Loops, b: Loops, kind: str) -> bool:
    """Whether polygon a contains, intersects or equals polygon b, by what is left of their overlay."""
    if kind == "intersects":
        return bool(K.overlay(a, b, "intersection"))
    if kind == "contains":
        return not K.overlay(b, a, "difference")
    if kind == "equals":
        return not K.overlay(a, b, "symmetric")
    raise ValueError(kind)


def linked(edges: list[tuple]) -> Loops:
    """Directed edges as polylines, each edge once: they start where more edges leave than arrive, then closed ones anywhere."""
    out: dict[tuple, list] = {}
    surplus: dict[tuple, int] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        surplus[a] = surplus.get(a, 0) + 1
        surplus[b] = surplus.get(b, 0) - 1

    def walk(at: tuple) -> np.ndarray:
        path = [at]
        while out.get(at):
            at = out[at].pop(0)
            path.append(at)
        return np.array(path)

    chains = [walk(a) for a in sorted(surplus) for _ in range(surplus[a])]
    for a in sorted(out):
        while out[a]:
            chains.append(walk(a))
    return chains


def polyline_parts(chain: np.ndarray, loops: Loops, inside: bool) -> Loops:
    """The parts of a polyline inside a polygon, or outside it. Edges that touch are judged by their middle."""
    pieces = K._split(chain[:-1], chain[1:], *K.polygon_edges(loops))
    if not pieces:
        return []
    middle = np.array(pieces).sum(1)
    held = K.polygon_contains(loops, middle / np.linalg.norm(middle, axis=1, keepdims=True))
    # Pieces follow each other along the chain, so neighbours that stay are joined.
    out: list[list] = []
    last = None
    for k in np.flatnonzero(held == inside):
        if last is not None and k == last + 1 and out[-1][-1] == pieces[k][0]:
            out[-1].append(pieces[k][1])
        else:
            out.append(list(pieces[k]))
        last = k
    return [np.array(c) for c in out]


# --- Snapping -------------------------------------------------------------------------------------------


def without_repeats(chain: np.ndarray, closed: bool) -> np.ndarray:
    """A chain without vertices equal to the one before."""
    if not len(chain):
        return chain
    keep = np.concatenate([[True], (chain[1:] != chain[:-1]).any(1)])
    chain = chain[keep]
    while closed and len(chain) > 1 and (chain[0] == chain[-1]).all():
        chain = chain[:-1]
    return chain


def snapped_to_cells(chain: np.ndarray, level: int, closed: bool = False) -> np.ndarray:
    """Vertices moved to the centres of their cells at a level."""
    ids = C.parent_np(C.from_xyz(*chain.T), level) if len(chain) else np.zeros(0, np.int64)
    return without_repeats(np.stack(C.center_xyz(ids), 1), closed)


def snapped_to_degrees(chain: np.ndarray, exponent: int, closed: bool = False) -> np.ndarray:
    """Vertices moved to latitudes and longitudes with so many decimal digits of degrees."""
    lat = np.radians(np.round(np.degrees(np.arctan2(chain[:, 2], np.hypot(chain[:, 0], chain[:, 1]))), exponent))
    lng = np.radians(np.round(np.degrees(np.arctan2(chain[:, 1], chain[:, 0])), exponent))
    return without_repeats(np.stack([np.cos(lng) * np.cos(lat), np.sin(lng) * np.cos(lat), np.sin(lat)], 1), closed)


def cell_snap_radius(level: int) -> float:
    """The farthest that snapped_to_cells() moves a vertex: half of a cell's longest diagonal."""
    return C.metric_value("max_diag", level) / 2


def degree_snap_radius(exponent: int) -> float:
    """The farthest that snapped_to_degrees() moves a vertex: half the diagonal of a square of one step."""
    return math.radians(10.0**-exponent) * math.sqrt(0.5)
