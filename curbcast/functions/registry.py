"""Scalar geometry as SQL functions with SQL bodies (visible to Catalyst)."""
from __future__ import annotations

from pyspark.sql import SparkSession

_BODIES = {
    "cc_haversine_m": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE",
        "2 * 6371000D * atan2(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2))"
        " * pow(sin(radians(lon2 - lon1) / 2), 2)), sqrt(greatest(0D, 1 - (pow(sin(radians(lat2 - lat1) / 2), 2)"
        " + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))))"),
    "cc_bearing_deg": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE",
        "CASE WHEN lat1 = lat2 AND lon1 = lon2 THEN NULL ELSE pmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)),"
        " cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))), 360D) END"),
    "cc_heading": ("h DOUBLE", "DOUBLE",
        "CASE WHEN h IS NULL OR isnan(h) OR abs(h) = double('Infinity') THEN NULL ELSE pmod(h, 360D) END"),
    "cc_heading_delta": ("a DOUBLE, b DOUBLE", "DOUBLE", "abs(pmod(pmod(a, 360D) - pmod(b, 360D) + 540D, 360D) - 180D)"),
    "cc_turn_delta": ("before DOUBLE, after DOUBLE", "DOUBLE",
        "CASE WHEN before IS NULL OR after IS NULL THEN 0D ELSE (after - before + 540D) % 360D - 180D END"),
    "cc_interpolate_heading": ("prev DOUBLE, nxt DOUBLE, blend DOUBLE", "DOUBLE",
        "CASE WHEN nxt IS NULL THEN pmod(prev, 360D) WHEN prev IS NULL THEN pmod(nxt, 360D) ELSE"
        " pmod(pmod(prev, 360D) + (pmod(pmod(nxt, 360D) - pmod(prev, 360D) + 540D, 360D) - 180D) * greatest(0D, least(1D, blend)), 360D) END"),
    "cc_blend_factor": ("elapsed_ms DOUBLE, tau_ms DOUBLE, min_blend DOUBLE", "DOUBLE",
        "least(1D, greatest(min_blend, 1D - exp(-elapsed_ms / tau_ms)))"),
    "cc_octant": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "STRING",
        "element_at(array('north','northeast','east','southeast','south','southwest','west','northwest'),"
        " CAST(floor(pmod(degrees(atan2((lon2 - lon1) * cos(radians((lat1 + lat2) / 2)), lat2 - lat1)) + 360D, 360D) / 45 + 0.5D) % 8 AS INT) + 1)"),
    "cc_low_pass_heading": ("prev DOUBLE, nxt DOUBLE, factor DOUBLE, dead_zone DOUBLE", "DOUBLE",
        "CASE WHEN nxt IS NULL THEN pmod(prev, 360D) WHEN prev IS NULL THEN pmod(nxt, 360D)"
        " WHEN abs(pmod(pmod(nxt, 360D) - pmod(prev, 360D) + 540D, 360D) - 180D) < dead_zone THEN pmod(prev, 360D) ELSE"
        " pmod(pmod(prev, 360D) + (pmod(pmod(nxt, 360D) - pmod(prev, 360D) + 540D, 360D) - 180D) * greatest(0D, least(1D, factor)), 360D) END"),
    "cc_order_quantile_index": ("q DOUBLE, n BIGINT", "BIGINT",
        "CASE WHEN n <= 0 THEN NULL ELSE greatest(0L, least(n - 1, CAST(floor(q * (n - 1)) AS BIGINT))) END"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions and return their names."""
    for name, (args, returns, body) in _BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    return sorted(_BODIES)
