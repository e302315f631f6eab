"""Geometry tables derived from the star-schema tables, which have no coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbis.functions import bounds as B
from orbis.functions import points as P


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def degrees_of(key: Column) -> tuple[Column, Column]:
    """A spread-out lat/lng in degrees for each integer."""
    return (key * 7919 % 179801) / F.lit(1000.0) - 89.9, (key * 104729 % 359801) / F.lit(1000.0) - 179.9


def global_points(table: DataFrame, key: Column, name: str = "id") -> DataFrame:
    lat, lng = degrees_of(key)
    rows = table.select(key.alias(name), lat.alias("lat_deg"), lng.alias("lng_deg"))
    return rows.withColumn("ll", P.latlng_degrees(F.col("lat_deg"), F.col("lng_deg"))).withColumn("p", P.to_point(F.col("ll")))


def event_points(spark: SparkSession, sf_dir: str, name: str = "id") -> DataFrame:
    return global_points(read(spark, sf_dir, "events").select("event_id"), F.col("event_id").cast("long"), name)


def customer_points(spark: SparkSession, sf_dir: str, name: str = "cust") -> DataFrame:
    return global_points(read(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey").cast("long"), name)


def supplier_points(spark: SparkSession, sf_dir: str, name: str = "supp") -> DataFrame:
    return global_points(read(spark, sf_dir, "supplier").select("s_suppkey"), F.col("s_suppkey").cast("long") * 31 + 7, name)


def local_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in a window of one degree by one degree."""
    e = read(spark, sf_dir, "events")
    k = F.col("event_id").cast("long")
    rows = e.select(k.alias("id"), F.col("user_id").cast("long").alias("user_id"), "ts", (40 + (k * 7919 % 10007) / F.lit(10007.0)).alias("lat_deg"), (-74 + (k * 104729 % 10009) / F.lit(10009.0)).alias("lng_deg"))
    return rows.withColumn("ll", P.latlng_degrees(F.col("lat_deg"), F.col("lng_deg"))).withColumn("p", P.to_point(F.col("ll")))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, chain: each user's events in the order of time."""
    rows = local_points(spark, sf_dir)
    return rows.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "id", "p"))), lambda x: x["p"]).alias("chain"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zone, center, loops: a regular octagon with a radius of 500 km for each nation."""
    k = F.col("n_nationkey").cast("long")
    center = P.point_degrees(k * 37 % 121 - 60, k * 53 % 331 - 165)
    rows = read(spark, sf_dir, "nation").select(k.alias("zone"), center.alias("center"))
    r = 500000.0 / P.EARTH_RADIUS_M

    def corners(x: Column, y: Column) -> Column:
        turns = [math.pi / 4 * i for i in range(8)]
        return F.array(*[P.point_on_ray(F.col("center"), P.add(P.scale(x, math.cos(t)), P.scale(y, math.sin(t))), r) for t in turns])

    y_axis = P.ortho(F.col("center"))
    loop = P.let(y_axis, lambda y: P.let(P.cross(y, F.col("center")), lambda x: corners(x, y)))
    return rows.withColumn("loops", F.array(loop))


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey").cast("long")
    return read(spark, sf_dir, "region").select(k.alias("rect"), B.rect_degrees(-60 + 20 * k, -45 + 20 * k, -150 + 60 * k, -100 + 60 * k).alias("r"))
