"""Stateless stream steps: fixes, orientation readings, latest fix."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import normalize_heading
from ..functions.scalar import is_finite
from ..operators.predicates import accuracy_radius, reliable_reading

FIX_SCHEMA = ("device_id BIGINT, ts TIMESTAMP, lat DOUBLE, lon DOUBLE, accuracy DOUBLE, gps_heading DOUBLE, speed DOUBLE")
READING_SCHEMA = ("device_id BIGINT, ts TIMESTAMP, type STRING, absolute BOOLEAN, alpha DOUBLE, compass_heading DOUBLE, compass_accuracy DOUBLE")


def normalize_fixes(fixes: DataFrame) -> DataFrame:
    """Drop fixes without coordinates; accuracy floor; circle only when tight."""
    r = accuracy_radius("accuracy")
    return fixes.where(is_finite("lat") & is_finite("lon")).withColumns({
        "accuracy_m": r, "shows_circle": r <= 45.0,
        "gps_heading": normalize_heading("gps_heading"),
        "speed": F.when(is_finite("speed"), F.greatest(F.lit(0.0), F.col("speed")))})


def latest_fix(fixes: DataFrame) -> DataFrame:
    """Newest fix per device (update mode on a stream)."""
    row = F.struct("ts", "lat", "lon", "accuracy_m")
    return fixes.groupBy("device_id").agg(F.max(row).alias("_r")).select("device_id", "_r.*")


def orientation_readings(events: DataFrame, max_accuracy_deg: float = 30.0, allow_relative: bool = False) -> DataFrame:
    """Heading, source and reliability of raw orientation events."""
    c = F.col
    compass = normalize_heading("compass_heading")
    acc = F.when(is_finite("compass_accuracy") & (c("compass_accuracy") >= 0), c("compass_accuracy"))
    alpha = normalize_heading("alpha")
    absolute = (c("type") == "deviceorientationabsolute") | F.coalesce(c("absolute"), F.lit(False))
    absolute = F.coalesce(absolute, F.lit(False))
    by_alpha = normalize_heading(360.0 - alpha)
    relative = F.lit(bool(allow_relative)) & ~absolute & alpha.isNotNull()
    ok_compass = acc.isNull() | (acc <= max_accuracy_deg)
    return events.withColumns({
        "raw_heading": F.when(compass.isNotNull(), compass).when(absolute | relative, by_alpha),
        "heading": F.when(compass.isNotNull(), F.when(ok_compass, compass)).when(absolute | relative, by_alpha),
        "heading_source": F.when(compass.isNotNull(), "webkit-compass").when(absolute & alpha.isNotNull(), "absolute-alpha")
        .when(relative, "alpha-fallback"),
        "heading_accuracy": F.when(compass.isNotNull() | ~(absolute | relative), acc),
        "reliable": F.when(compass.isNotNull(), ok_compass).otherwise(absolute & alpha.isNotNull())})


def accepted_readings(readings: DataFrame, max_accuracy_deg: float = 30.0) -> DataFrame:
    return readings.where(reliable_reading("heading", "heading_accuracy", F.col("reliable"), max_accuracy_deg))


def sensor_age(now_ts, sensor_ts, max_age_s: float = 2.2) -> tuple[Column, Column]:
    """(age in seconds, fresh) of the newest reading at an instant."""
    age = F.col(now_ts).cast("timestamp").cast("double") - F.col(sensor_ts).cast("timestamp").cast("double")
    return F.greatest(F.lit(0.0), age), F.coalesce(age <= max_age_s, F.lit(False))
