"""Distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; the argument is clamped because rounding can pass 1."""
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), 2)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def fill_distance(df: DataFrame, group: str, distance: str, lat1: str, lon1: str, lat2: str, lon2: str) -> DataFrame:
    """Distances from coordinates, only in groups that have no distance at all."""
    known = df.groupBy(group).agg(F.count(distance).alias("_known")).withColumnRenamed(group, "_group")
    made = haversine_km(F.col(lat1), F.col(lon1), F.col(lat2), F.col(lon2))
    joined = df.join(known, F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn(distance, F.when(F.col("_known") == 0, made).otherwise(F.col(distance))).select(*df.columns)
