"""Binary forms of geometry, for exchange with other programs; inside Spark the columns themselves are the storage.

Everything is little-endian. Layouts (fixed values):

    varint          7 bits a byte, low ones first, the high bit set on all but the last byte
    integers        varint(n * width | (bytes a value - 1)), then n values of that many bytes
    cells           shift and base (see CellBlock), then integers of width 8: (cell - base) >> shift
    cell union      byte 1, int64 count, int64 cells
    points          varint(n * 8 | 0), then x, y, z of each
    polyline        byte 1, int32 count, then x, y, z of each vertex
    rectangle       byte 1, lat lo, lat hi, lng lo, lng hi
    cap             x, y, z of the axis, squared chord

Encoders take nulls to null. Decoders take malformed bytes to null.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from orbis.functions import arrow as W
from orbis.functions import types
from orbis.functions.types import T

LOSSLESS = 1
MOST_SHIFT = 56


# --- Integers -----------------------------------------------------------------------------------


def zigzag(c: Column) -> Column:
    """Signed longs to codes that are small for small magnitudes: 0, -1, 1, -2 to 0, 1, 2, 3."""
    return F.shiftleft(c, 1).bitwiseXOR(F.shiftright(c, 63))


def unzigzag(c: Column) -> Column:
    return F.shiftrightunsigned(c, 1).bitwiseXOR(-c.bitwiseAND(F.lit(1).cast("long")))


def _moved(c: Column, steps: list[tuple[int, int]], spread: bool) -> Column:
    for shift, mask in steps:
        other = F.shiftleft(c, shift) if spread else F.shiftrightunsigned(c, shift)
        c = c.bitwiseOR(other).bitwiseAND(F.lit(mask).cast("long"))
    return c


#: Masks with runs of 16, 8, 4, 2 and 1 low bits in every 32, 16, 8, 4 and 2.
_RUNS = [sum(((1 << w) - 1) << k for k in range(0, 64, 2 * w)) for w in (16, 8, 4, 2, 1)]
_RUNS = [m - (1 << 64) if m >> 63 else m for m in _RUNS]


def interleave(even: Column, odd: Column) -> Column:
    """Bits of two numbers below 2^32, taken in turn: even's at places 0, 2, ..."""

    def spread(c: Column) -> Column:
        return _moved(c.cast("long"), list(zip((16, 8, 4, 2, 1), _RUNS)), True)

    return spread(even).bitwiseOR(F.shiftleft(spread(odd), 1))


def deinterleave(c: Column, at: int) -> Column:
    """The number in the even (0) or odd (1) places."""
    own = F.shiftrightunsigned(c, at).bitwiseAND(F.lit(_RUNS[4]).cast("long"))
    return _moved(own, list(zip((1, 2, 4, 8, 16), [*reversed(_RUNS[:4]), (1 << 32) - 1])), False)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        part = self.data[self.at : self.at + n]
        if n < 0 or len(part) < n:
            raise ValueError("too short")
        self.at += n
        return part

    def unpack(self, form: str) -> tuple:
        return struct.unpack(form, self.take(struct.calcsize(form)))

    def varint(self) -> int:
        value = 0
        for k in range(10):
            byte = self.take(1)[0]
            value |= (byte & 0x7F) << 7 * k
            if byte < 0x80:
                return value
        raise ValueError("varint too long")

    def done(self) -> None:
        if self.at != len(self.data):
            raise ValueError("bytes left over")


def put_integers(values: np.ndarray, width: int = 8) -> bytes:
    """Unsigned values below 2^(8 width)."""
    values = np.ascontiguousarray(values, "<u8")
    size = max(1, (int(values.max()).bit_length() + 7) // 8 if len(values) else 1)
    if size > width:
        raise ValueError(f"a value needs more than {width} bytes")
    return varint(len(values) * width | size - 1) + values.view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def get_integers(r: Reader, width: int = 8) -> np.ndarray:
    head = r.varint()
    n, size = head // width, head % width + 1
    wide = np.zeros((n, 8), np.uint8) if n * size <= len(r.data) else r.take(n * size)
    wide[:, :size] = np.frombuffer(r.take(n * size), np.uint8).reshape(n, size)
    return wide.reshape(-1).view("<u8")


# --- Cells ----------------------------------------------------------------------------------------


def _forms(low: int, high: int, ored: int, anded: int, n: int) -> Iterator[tuple[int, int, int, int]]:
    """Bytes, shift, base bytes and base of every form the format allows for n cells with these least and greatest ids and bits."""
    for shift in range(MOST_SHIFT + 2):
        mark = 1 << shift - 1 if shift % 2 else 0
        below = (1 << shift) - 1
        if ored & below != mark or mark & ~anded:
            continue  # a bit that the shift would lose, or no common marker
        for count in range(8):
            base = (low >> 64 - 8 * count << 64 - 8 * count) + mark
            if base <= low and base & below == mark:
                width = max(1, ((high - base >> shift).bit_length() + 7) // 8)
                yield (shift > 3 and shift % 2) + count + n * width, shift, count, base


def put_cells(cells: np.ndarray) -> bytes:
    """Cells in any order, in the shortest form; those of a small region take few bytes each.

    The first byte has the number of base bytes (3 bits) and the shift's code (5 bits): half the
    shift if that is even, 29 and 30 for shifts 1 and 3, else 31, with half the shift in the next byte.
    An odd shift says that all cells are of one level, and stands for the marker bit below it.
    """
    ids = np.asarray(cells, np.int64).view(np.uint64)
    shift = count = base = 0
    if len(ids):
        _, shift, count, base = min(_forms(int(ids.min()), int(ids.max()), int(np.bitwise_or.reduce(ids)), int(np.bitwise_and.reduce(ids)), len(ids)))
    half = shift // 2
    code = half if shift % 2 == 0 else min(31, half + 29)
    head = bytes([code << 3 | count]) + (bytes([half]) if code == 31 else b"")
    return head + base.to_bytes(8, "big")[:count][::-1] + put_integers(ids - np.uint64(base) >> np.uint64(shift))


def get_cells(r: Reader) -> np.ndarray:
    first = r.take(1)[0]
    code, count = first >> 3, first & 7
    shift = 2 * code if code < 29 else 2 * (code - 29) + 1 if code < 31 else 2 * r.take(1)[0] + 1
    if shift > MOST_SHIFT + 1:
        raise ValueError("shift too large")
    base = int.from_bytes(r.take(count), "little") << 64 - 8 * max(1, count) if count else 0
    base += 1 << shift - 1 if shift % 2 else 0
    return ((get_integers(r) << np.uint64(shift)) + np.uint64(base)).view(np.int64)


def put_union(cells: np.ndarray) -> bytes:
    ids = np.asarray(cells, "<i8")
    return struct.pack("<bq", LOSSLESS, len(ids)) + ids.tobytes()


def versioned(r: Reader) -> None:
    if r.take(1)[0] != LOSSLESS:
        raise ValueError("unknown version")


def get_union(r: Reader) -> np.ndarray:
    versioned(r)
    (n,) = r.unpack("<q")
    return np.frombuffer(r.take(8 * n), "<i8")


# --- Points, polylines, rectangles, caps -----------------------------------------------------------


def put_points(points: np.ndarray) -> bytes:
    return varint(len(points) << 3) + points.astype("<f8").tobytes()


def get_points(r: Reader) -> np.ndarray:
    head = r.varint()
    if head & 7:
        raise ValueError("unknown format of points")
    return np.frombuffer(r.take((head >> 3) * 24), "<f8").reshape(-1, 3)


def put_polyline(points: np.ndarray) -> bytes:
    return struct.pack("<bi", LOSSLESS, len(points)) + points.astype("<f8").tobytes()


def get_polyline(r: Reader) -> np.ndarray:
    versioned(r)
    (n,) = r.unpack("<i")
    return np.frombuffer(r.take(n * 24), "<f8").reshape(-1, 3)


# --- Columns ----------------------------------------------------------------------------------------


def _column(f: Callable, kind: T.DataType, decode: bool) -> Callable[[Column], Column]:
    def one(x):
        if x is None:
            return None
        if not decode:
            return f(x)
        try:
            r = Reader(bytes(x))
            out = f(r)
            r.done()
            return out
        except ValueError:
            return None

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in values], dtype=object)

    return run


encode_integers, decode_integers = _column(put_integers, T.BinaryType(), False), _column(lambda r: get_integers(r).view(np.int64), types.CELLS, True)
encode_cells, decode_cells = _column(put_cells, T.BinaryType(), False), _column(get_cells, types.CELLS, True)
encode_union, decode_union = _column(put_union, T.BinaryType(), False), _column(get_union, types.CELLS, True)
def _chain_column(put: Callable, get: Callable) -> tuple[Callable, Callable]:
    """As _column(), for chains: they go between Arrow and bytes without an object for each point."""

    def read(x: bytes | None) -> np.ndarray | None:
        if x is None:
            return None
        try:
            r = Reader(x)
            out = get(r)
            r.done()
            return out
        except ValueError:
            return None

    @F.arrow_udf(T.BinaryType())
    def encode(values: pa.Array) -> pa.Array:
        return pa.array([None if c is None else put(c) for c in W.chains(values)], pa.binary())

    @F.arrow_udf(types.POINTS)
    def decode(values: pa.Array) -> pa.Array:
        return W.points_of([read(x.as_py()) for x in values])

    return encode, decode


encode_points, decode_points = _chain_column(put_points, get_points)
encode_polyline, decode_polyline = _chain_column(put_polyline, get_polyline)


def _doubles(version: bool, *fields: str) -> tuple[Callable, Callable]:
    @F.pandas_udf(T.BinaryType())
    def encode(rows: pd.DataFrame) -> pd.Series:
        head = bytes([LOSSLESS] * version)
        values = np.ascontiguousarray(rows[list(fields)].to_numpy(), "<f8")
        return pd.Series([head + v.tobytes() for v in values], dtype=object)

    @F.pandas_udf(types.struct(**{k: types.D for k in fields}))
    def decode(rows: pd.Series) -> pd.DataFrame:
        size = version + 8 * len(fields)
        good = [x is not None and len(x) == size and (not version or x[0] == LOSSLESS) for x in rows]
        out = [struct.unpack_from(f"<{len(fields)}d", x, version) if g else (None,) * len(fields) for x, g in zip(rows, good)]
        return pd.DataFrame(out, columns=list(fields))

    return encode, decode


encode_rect, decode_rect = _doubles(True, "lat_lo", "lat_hi", "lng_lo", "lng_hi")
_encode_cap, _decode_cap = _doubles(False, "x", "y", "z", "l2")


def encode_cap(c: Column) -> Column:
    return _encode_cap(F.struct(*[c["axis"][k].alias(k) for k in "xyz"], c["l2"].alias("l2")))


def decode_cap(c: Column) -> Column:
    d = _decode_cap(c)
    return F.struct(F.struct(*[d[k].alias(k) for k in "xyz"]).alias("axis"), d["l2"].alias("l2"))
