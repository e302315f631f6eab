"""Chains between Arrow arrays and NumPy without a Python object for each point.

pandas turns every point of a chain into a dict of floats, some twenty times its size, for a whole batch at once.
Here a chain is a view of its batch's coordinates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

POINT = pa.struct([(k, pa.float64()) for k in "xyz"])


def chains(column: pa.Array) -> list[np.ndarray | None]:
    """(n, 3) views of an array of arrays of points; None for nulls."""
    if not len(column):
        return []
    ends = np.asarray(column.offsets)
    flat = column.values.slice(ends[0], ends[-1] - ends[0])
    xyz = np.empty((len(flat), 3))
    for k in range(3):
        xyz[:, k] = flat.field(k).to_numpy(zero_copy_only=False)
    at = ends - ends[0]
    out: list = [xyz[i:j] for i, j in zip(at, at[1:])]
    if column.null_count:
        for k in np.flatnonzero(~np.asarray(column.is_valid())):
            out[k] = None
    return out


def shapes(column: pa.Array) -> list[list[np.ndarray] | None]:
    """The same for arrays of chains."""
    if not len(column):
        return []
    ends = np.asarray(column.offsets)
    inner = chains(column.values.slice(ends[0], ends[-1] - ends[0]))
    at = ends - ends[0]
    return [inner[i:j] if ok else None for i, j, ok in zip(at, at[1:], np.asarray(column.is_valid()))]


def _lists(sizes: list[int | None], values: pa.Array) -> pa.Array:
    ends = np.r_[0, np.cumsum([n or 0 for n in sizes], dtype=np.int64)].astype(np.int32)
    missing = pa.array([n is None for n in sizes] or [], pa.bool_()) if None in sizes else None
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=missing)


def points_of(rows: list[np.ndarray | None]) -> pa.Array:
    """chains() turned back."""
    good = [r for r in rows if r is not None and len(r)]
    flat = np.concatenate(good) if good else np.zeros((0, 3))
    struct = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=list(POINT))
    return _lists([None if r is None else len(r) for r in rows], struct)


def shapes_of(rows: list[list[np.ndarray] | None]) -> pa.Array:
    return _lists([None if r is None else len(r) for r in rows], points_of([c for r in rows if r is not None for c in r]))
