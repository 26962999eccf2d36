"""GeoJSON features, accuracy circles, history and audit tables."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import METERS_PER_DEGREE
from ..functions.scalar import col


def point_feature(lat, lon, properties: Column) -> Column:
    """GeoJSON point feature text ([lon, lat] order)."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(col(lon), col(lat)).alias("coordinates")).alias("geometry"),
        properties.alias("properties")))


def heat_features(heat: DataFrame) -> DataFrame:
    return heat.select(point_feature("lat", "lon", F.struct(F.col("p_good").alias("intensity"))).alias("value"))


def place_features(places: DataFrame) -> DataFrame:
    return places.select(point_feature("lat", "lon", F.struct("id")).alias("value"))


def circle_ring(lat, lon, radius_m, steps: int = 48) -> Column:
    """Closed ring of [lng, lat] around a point."""
    scale = F.greatest(F.cos(F.radians(col(lat))), F.lit(0.1))

    def corner(i: Column) -> Column:
        a = i / float(steps) * (2 * math.pi)
        return F.array(col(lon) + F.cos(a) * col(radius_m) / (METERS_PER_DEGREE * scale),
                       col(lat) + F.sin(a) * col(radius_m) / METERS_PER_DEGREE)

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), corner)


def circle_feature(lat, lon, radius_m, steps: int = 48) -> Column:
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(circle_ring(lat, lon, radius_m, steps)).alias("coordinates")).alias("geometry"),
        F.struct(col(radius_m).alias("accuracyMeters")).alias("properties")))


def write_features(features: DataFrame, path: str) -> None:
    """One feature per line."""
    features.select("value").write.mode("overwrite").text(path)


def write_history(history: DataFrame, path: str, limit: int = 240) -> None:
    from ..operators.places import retain_newest
    retain_newest(history, limit).write.mode("overwrite").parquet(path)


def append_audit(audit: DataFrame, path: str) -> None:
    audit.withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(path)
