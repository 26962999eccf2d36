"""Geometry Columns: distances, bearings, headings, planar vectors, cells."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalar import clamp, clamp01_zero, col, is_finite, round_half_up

# Fixed values.
EARTH_RADIUS_M = 6371000.0
METERS_PER_DEGREE = 111320.0
UNREACHABLE = 1e12
SECTORS = ["north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest"]


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    s_lat = F.sin((F.radians(col(lat2) - col(lat1))) / 2.0)
    s_lon = F.sin((F.radians(col(lon2) - col(lon1))) / 2.0)
    h = s_lat * s_lat + F.cos(p1) * F.cos(p2) * s_lon * s_lon
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1.0 - h)))


def haversine_or_unreachable(lat1, lon1, lat2, lon2) -> Column:
    """Distance used by dispatch: missing coordinates give the unreachable cost."""
    top = F.lit(UNREACHABLE)
    return F.least(top, F.coalesce(F.nanvl(haversine_m(lat1, lon1, lat2, lon2), top), top))


def trig_columns(lat="lat", lon="lon", prefix="") -> list[Column]:
    """Per-row radians and cosine, computed once before a pair join."""
    return [F.radians(col(lat)).alias(f"{prefix}rlat"), F.radians(col(lon)).alias(f"{prefix}rlon"),
            F.cos(F.radians(col(lat))).alias(f"{prefix}clat")]


def pair_distance_m(a: str, b: str) -> Column:
    """Distance of two sides that both carry :func:`trig_columns`.

    ``a`` and ``b`` are the column prefixes.  Only two sines, one square root
    and one arc sine are left to compute per pair.
    """
    s_lat = F.sin((F.col(f"{b}rlat") - F.col(f"{a}rlat")) * 0.5)
    s_lon = F.sin((F.col(f"{b}rlon") - F.col(f"{a}rlon")) * 0.5)
    h = s_lat * s_lat + F.col(f"{a}clat") * F.col(f"{b}clat") * s_lon * s_lon
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def normalize_heading(h) -> Column:
    """Degrees folded to [0, 360); null when missing or not finite."""
    d = col(h).cast("double")
    return F.when(is_finite(d), F.pmod(d, F.lit(360.0)))


def _full_turn(y: Column, x: Column) -> Column:
    """Direction of (y, x) in [0, 360).  The turn is added to every angle, as the SQL
    texts do it, so that the last bit and with it the rounding agree."""
    return (F.degrees(F.atan2(y, x)) % 360.0 + 360.0) % 360.0


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in [0, 360); null for missing or coincident points."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dl = F.radians(col(lon2) - col(lon1))
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    degenerate = (F.abs(x) < 1e-12) & (F.abs(y) < 1e-12)
    ok = is_finite(lat1) & is_finite(lon1) & is_finite(lat2) & is_finite(lon2)
    return F.when(ok & ~degenerate, _full_turn(y, x))


def course_deg(lat1, lon1, lat2, lon2, min_distance_m: float = 1.5) -> Column:
    """Bearing of a movement; null when it is shorter than the jitter limit."""
    far = haversine_m(lat1, lon1, lat2, lon2) >= F.lit(float(min_distance_m))
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dl = F.radians(col(lon2) - col(lon1))
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.when(far, _full_turn(y, x))


def heading_delta(a, b) -> Column:
    """Absolute circular difference in [0, 180]; null when either is missing."""
    return F.abs(F.pmod(normalize_heading(a) - normalize_heading(b) + 540.0, F.lit(360.0)) - 180.0)


def turn_delta(before, after) -> Column:
    """Signed turn in [-180, 180); 0 when a bearing is missing."""
    d = (col(after).cast("double") - col(before).cast("double") + 540.0)
    return F.when(is_finite(before) & is_finite(after), d % 360.0 - 180.0).otherwise(F.lit(0.0))


def interpolate_heading(prev, nxt, blend) -> Column:
    """Move from prev to nxt along the shorter arc by ``blend`` in [0, 1]."""
    p, n = normalize_heading(prev), normalize_heading(nxt)
    arc = F.pmod(n - p + 540.0, F.lit(360.0)) - 180.0
    return F.when(n.isNull(), p).when(p.isNull(), n).otherwise(
        normalize_heading(p + arc * clamp01_zero(blend)))


def blend_factor(elapsed_ms, time_constant_ms: float = 96.0, min_blend: float = 0.0) -> Column:
    e = col(elapsed_ms).cast("double")
    tc = F.lit(float(time_constant_ms))
    e = F.when(is_finite(e) & (e >= 0), e).otherwise(tc)
    return clamp01_zero(F.greatest(clamp01_zero(F.lit(float(min_blend))), 1.0 - F.exp(-e / tc)))


def low_pass_heading(prev, nxt, factor: float = 0.68, dead_zone: float = 1.05,
                     min_rotation: float = 0.45) -> Column:
    """One dead-zone low-pass step of a heading."""
    p, n = normalize_heading(prev), normalize_heading(nxt)
    quiet = heading_delta(n, p) < F.lit(float(max(dead_zone, min_rotation)))
    return (F.when(n.isNull(), p).when(p.isNull(), n).when(quiet, p)
            .otherwise(interpolate_heading(p, n, F.lit(float(factor)))))


def planar_vector(lat1, lon1, lat2, lon2) -> tuple[Column, Column]:
    """(east, north) offset in metres on a local plane."""
    mid = F.radians((col(lat1) + col(lat2)) / 2.0)
    return ((col(lon2) - col(lon1)) * METERS_PER_DEGREE * F.cos(mid),
            (col(lat2) - col(lat1)) * METERS_PER_DEGREE)


def relative_side(s_lat, s_lon, e_lat, e_lon, p_lat, p_lon) -> Column:
    """Side of a point seen from an approach segment s -> e."""
    vx, vy = planar_vector(s_lat, s_lon, e_lat, e_lon)
    px, py = planar_vector(e_lat, e_lon, p_lat, p_lon)
    dist = F.sqrt(px * px + py * py)
    cross = vx * py - vy * px
    along = vx * px + vy * py
    return (F.when(dist.isNull(), F.lit(None).cast("string"))
            .when(dist < 12, "center")
            .when(F.abs(cross) < F.greatest(F.lit(14.0), dist * 0.18),
                  F.when(along >= 0, "ahead").otherwise("behind"))
            .when(cross > 0, "left").otherwise("right"))


def octant_label(lat1, lon1, lat2, lon2) -> Column:
    """Compass octant of the planar direction from point 1 to point 2."""
    dy = col(lat2) - col(lat1)
    dx = (col(lon2) - col(lon1)) * F.cos(F.radians((col(lat1) + col(lat2)) / 2.0))
    ang = F.pmod(F.degrees(F.atan2(dx, dy)) + 360.0, F.lit(360.0))
    ix = (round_half_up(ang / 45.0) % 8).cast("int") + 1
    return F.element_at(F.array(*[F.lit(s) for s in SECTORS]), ix)


def degree_steps(step_m, mid_lat, cos_floor: float) -> tuple[Column, Column]:
    """(dlat, dlon) of a step in metres; ``cos_floor`` guards the poles."""
    cos_m = F.cos(F.radians(col(mid_lat)))
    if cos_floor < 1e-3:  # grid rule: the floor applies to metres per degree
        per_lon = F.greatest(F.lit(cos_floor), cos_m * METERS_PER_DEGREE)
    else:
        per_lon = F.lit(METERS_PER_DEGREE) * F.greatest(F.lit(cos_floor), cos_m)
    return col(step_m) / METERS_PER_DEGREE, col(step_m) / per_lon


def rounded_coordinate(x, digits: int) -> Column:
    """Coordinate rounded half-up to a cell of 10^-digits degrees."""
    s = float(10 ** digits)
    return round_half_up(col(x) * s) / F.lit(s)


def clamp_latitude(x) -> Column:
    return F.when(is_finite(x), clamp(col(x).try_cast("double"), -90.0, 90.0))


def clamp_longitude(x) -> Column:
    return F.when(is_finite(x), clamp(col(x).try_cast("double"), -180.0, 180.0))
