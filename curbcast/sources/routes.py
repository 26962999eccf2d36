"""Route and geocode payloads."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import is_finite

_STEP = ("STRUCT<name: STRING, distance: DOUBLE, driving_side: STRING, geometry: STRUCT<coordinates: ARRAY<ARRAY<DOUBLE>>>, "
         "maneuver: STRUCT<type: STRING, modifier: STRING, instruction: STRING, exit: INT, bearing_before: DOUBLE, bearing_after: DOUBLE>, "
         "intersections: ARRAY<STRUCT<lanes: ARRAY<STRING>, entry: ARRAY<BOOLEAN>>>>")
ROUTE_TYPE = ("STRUCT<routes: ARRAY<STRUCT<distance: DOUBLE, duration: DOUBLE, geometry: STRUCT<coordinates: ARRAY<ARRAY<DOUBLE>>>, "
              f"legs: ARRAY<STRUCT<steps: ARRAY<{_STEP}>>>>>>")
FEATURE_TYPE = ("STRUCT<center: ARRAY<DOUBLE>, geometry: STRUCT<coordinates: ARRAY<DOUBLE>>, place_name: STRING, text: STRING, "
                "properties: STRUCT<label: STRING>>")


def parse_routes(payloads: DataFrame, payload: str = "payload", carry: tuple[str, ...] = ()) -> DataFrame:
    """First route of each payload with the steps of all legs in order; payloads
    without geometry are dropped, missing numbers read 0."""
    r = payloads.select(*carry, F.try_element_at(F.from_json(payload, ROUTE_TYPE)["routes"], F.lit(1)).alias("r"))
    r = r.where(F.size("r.geometry.coordinates") > 0)
    steps = F.flatten(F.transform("r.legs", lambda l: F.coalesce(l["steps"], F.array())))
    flat = F.transform(steps, lambda s: F.struct(
        s["name"].alias("name"), s["distance"].alias("distance"), s["driving_side"].alias("driving_side"),
        s["geometry"]["coordinates"].alias("coordinates"), s["maneuver"].alias("maneuver"), s["intersections"].alias("intersections")))
    return r.select(*carry, F.col("r.geometry.coordinates").alias("coordinates"),
                    F.coalesce("r.distance", F.lit(0.0)).alias("distance_m"), F.coalesce("r.duration", F.lit(0.0)).alias("duration_s"),
                    flat.alias("steps"))


def _named(display: Column) -> tuple[Column, Column, Column]:
    text = F.trim(F.coalesce(display, F.lit("")))
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    title = F.coalesce(F.try_element_at(parts, F.lit(1)), F.when(text != "", text), F.lit("Search result"))
    rest = F.array_join(F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts))), ", ")
    return title, F.when(rest != "", rest).otherwise("Mapped location"), F.when(text != "", text).otherwise(title)


def feature_matches(payloads: DataFrame, payload: str = "payload", carry: tuple[str, ...] = ()) -> DataFrame:
    """Geocode matches of the feature-collection shape."""
    m = payloads.select(*carry, F.posexplode(F.from_json(payload, f"STRUCT<features: ARRAY<{FEATURE_TYPE}>>")["features"]).alias("match_ix", "m"))
    xy = F.coalesce(F.col("m.center"), F.col("m.geometry.coordinates"))
    title, subtitle, label = _named(F.coalesce("m.place_name", "m.properties.label", "m.text"))
    out = m.select(*carry, "match_ix", F.get(xy, F.lit(1)).alias("lat"), F.get(xy, F.lit(0)).alias("lng"),
                   title.alias("title"), subtitle.alias("subtitle"), label.alias("label"))
    return out.where(is_finite("lat") & is_finite("lng"))


def row_matches(payloads: DataFrame, payload: str = "payload", carry: tuple[str, ...] = ()) -> DataFrame:
    """Geocode matches of the plain-row shape (coordinates are text)."""
    t = "ARRAY<STRUCT<lat: STRING, lon: STRING, display_name: STRING>>"
    m = payloads.select(*carry, F.posexplode(F.from_json(payload, t)).alias("match_ix", "m"))
    title, subtitle, label = _named(F.col("m.display_name"))
    out = m.select(*carry, "match_ix", F.col("m.lat").try_cast("double").alias("lat"), F.col("m.lon").try_cast("double").alias("lng"),
                   title.alias("title"), subtitle.alias("subtitle"), label.alias("label"))
    return out.where(is_finite("lat") & is_finite("lng"))


def with_fallback(primary: DataFrame, secondary: DataFrame, key: str = "query_id") -> DataFrame:
    """Secondary matches only for queries the primary source did not answer."""
    answered = primary.select(key).distinct()
    return primary.unionByName(secondary.join(answered, key, "left_anti"))
