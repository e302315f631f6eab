"""Spark types of the geometry columns."""

from pyspark.sql import types as T


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


D, L, I = T.DoubleType(), T.LongType(), T.IntegerType()
POINT = struct(x=D, y=D, z=D)
LATLNG = struct(lat=D, lng=D)
POINTS = T.ArrayType(POINT)
CELLS = T.ArrayType(L)
LOOPS = T.ArrayType(POINTS)
SHAPE = struct(dimension=I, chains=LOOPS)
CELL = struct(face=I, i=I, j=I, level=I, orientation=I, u_lo=D, u_hi=D, v_lo=D, v_hi=D)
