"""Range, ring and nearest joins on a metre cell grid.

A bare distance predicate would be a nested loop over everything.  Here both
sides get a cell of at least the search radius, the anchor side is repeated to
its 3 x 3 cells, and the distance test is a residual of an equi join.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import METERS_PER_DEGREE, haversine_m, octant_label
from ..functions.scalar import col, round_half_up
from .rank import top_per_group


def _cells(lat, lon, size_m, band) -> tuple[Column, Column]:
    """Row and column of a point; columns use the narrowest parallel that a
    one-degree latitude band plus the radius reaches, so a cell is never
    narrower than ``size_m``."""
    row = F.floor(col(lat) * METERS_PER_DEGREE / size_m)
    return row, F.floor(col(lon) / _reach(size_m, band))


def _reach(size_m, band) -> Column:
    """Degrees of longitude of a cell."""
    edge = F.least(F.lit(89.9), F.greatest(F.abs(band), F.abs(band + 1.0)) + size_m / 110000.0)
    return size_m / (METERS_PER_DEGREE * F.cos(F.radians(edge)))


def cell_pairs(anchors: DataFrame, places: DataFrame, radius_m: float | None = None,
               radius_col: str | None = None, keys: tuple[str, ...] = ("view_id",)) -> DataFrame:
    """All (anchor, place) pairs within a radius, with exact ``distance_m``.

    Anchors carry ``lat, lon``; place coordinates come back as ``p_lat, p_lon``.
    With ``radius_col`` every place has its own radius; cells are as wide as the
    largest of the key.  Places near the 180th meridian also stand a turn away,
    so that pairs across it meet.  The cell is 0.5 % wider than the radius: the
    metre-per-degree constant of the cells and the sphere of the distance differ
    by 0.11 %.
    """
    size = (F.col("_size_r") if radius_col else F.lit(float(radius_m))) * 1.005 + 1.0
    reserved = {"lat", "lon"}
    p = places.select(*[c for c in places.columns if c not in reserved],
                      F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    if radius_col:
        sizes = places.groupBy(*keys).agg(F.max(radius_col).alias("_size_r"))
        a, p = anchors.join(sizes, list(keys)), p.join(sizes, list(keys))
    else:
        a = anchors
    # A place near a band edge is reachable from both bands: it is repeated per
    # band it may be seen from, anchors stay in their own band.
    p = p.withColumn("_band", F.explode(F.array_distinct(F.array(
        F.floor(F.col("p_lat") - size / 110000.0), F.floor(F.col("p_lat")), F.floor(F.col("p_lat") + size / 110000.0)))))
    turn = F.when(F.abs("p_lon") > 180.0 - _reach(size, F.col("_band")), F.array(F.col("p_lon"), F.col("p_lon") - 360.0 * F.signum("p_lon")))
    p = p.withColumn("_lon", F.explode(F.coalesce(turn, F.array("p_lon"))))
    pr, pc = _cells("p_lat", "_lon", size, F.col("_band"))
    p = p.withColumn("_cy", pr).withColumn("_cx", pc).drop("_lon", "_size_r")
    a = a.withColumn("_band", F.floor("lat"))
    ar, ac = _cells("lat", "lon", size, F.col("_band"))
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    a = (a.withColumn("_cy0", ar).withColumn("_cx0", ac)
         .withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps))
         .withColumn("_cy", F.col("_cy0") + F.col("_dy")).withColumn("_cx", F.col("_cx0") + F.col("_dx"))
         .drop("_cy0", "_cx0", "_dy", "_dx", "_size_r"))
    d = haversine_m("lat", "lon", "p_lat", "p_lon")
    out = a.join(p, [*keys, "_band", "_cy", "_cx"]).withColumn("distance_m", d)
    limit = F.col(radius_col) if radius_col else F.lit(float(radius_m))
    return out.where(F.col("distance_m") <= limit + 0.5).drop("_band", "_cy", "_cx", "_r")


def _one_per_location(places: DataFrame, order: list[Column], keep: int = 1) -> DataFrame:
    """Places that share a location compete only by rank: keep the best ones."""
    return top_per_group(places, ["view_id", "lat", "lon"], order, keep, "_loc").drop("_loc")


def _anchor(anchors: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    return anchors.select("view_id", "point_id", "lat", "lon", *extra)


def nearest_parking(anchors: DataFrame, ranked: DataFrame, max_m: float = 480.0) -> DataFrame:
    """Nearest scored lot within range (whole metres), rank order on ties."""
    lots = _one_per_location(ranked, [F.asc("place_rank")]).select(
        "view_id", F.col("id").alias("lot_id"), "lat", "lon", "place_rank", F.col("name").alias("lot_name"))
    pairs = cell_pairs(_anchor(anchors), lots, max_m).withColumn("distance_m", round_half_up("distance_m"))
    best = pairs.where(F.col("distance_m") <= max_m).groupBy("view_id", "point_id").agg(
        F.min(F.struct("distance_m", "place_rank", "lot_id", "lot_name", "p_lat", "p_lon")).alias("b"))
    return best.select("view_id", "point_id", "b.lot_id", "b.lot_name", "b.distance_m",
                       F.col("b.p_lat").alias("lot_lat"), F.col("b.p_lon").alias("lot_lon"))


def best_parking(anchors: DataFrame, scored: DataFrame, max_m: float = 550.0) -> DataFrame:
    """Best-scoring lot within range; distance, then input order, on ties."""
    lots = _one_per_location(scored, [F.desc("p_good"), F.asc("ingest_ix")]).select(
        "view_id", F.col("id").alias("lot_id"), "lat", "lon", "p_good", "ingest_ix")
    pairs = cell_pairs(_anchor(anchors), lots, max_m).withColumn("distance_m", round_half_up("distance_m"))
    best = pairs.where(F.col("distance_m") <= max_m).groupBy("view_id", "point_id").agg(
        F.min(F.struct((-F.col("p_good")).alias("neg"), "distance_m", "ingest_ix", "lot_id")).alias("b"))
    return best.select("view_id", "point_id", "b.lot_id", "b.distance_m", (-F.col("b.neg")).alias("lot_p_good"))


def parking_suitability(p_good, crowding, width, distance_m) -> Column:
    from ..functions.scalar import clamp01_zero
    width = F.coalesce(col(width), F.lit(0.18))
    return clamp01_zero(0.46 * clamp01_zero(p_good) + 0.22 * (1.0 - clamp01_zero(crowding))
                        + 0.18 * (1.0 - clamp01_zero(width / 0.35)) + 0.14 * (1.0 - clamp01_zero(col(distance_m) / 804.0)))


def parking_in_ring(anchors: DataFrame, scored: DataFrame, min_m: float = 322.0, max_m: float = 804.0,
                    limit: int = 3) -> DataFrame:
    """Best lots in a distance ring by suitability, then score gain.

    ``anchors`` carry their own ``p_good``; ``scored`` carries p_good,
    signals, stability_width.
    """
    base = parking_suitability("p_good", F.col("signals.D"), "stability_width", F.lit(0.0))
    lots = _one_per_location(scored, [F.desc(base), F.desc("p_good"), F.asc("ingest_ix")], limit).select(
        "view_id", F.col("id").alias("lot_id"), F.col("name").alias("lot_name"), "lat", "lon",
        F.col("p_good").alias("lot_p_good"), F.col("signals.D").alias("lot_d"),
        F.col("stability_width").alias("lot_width"), "ingest_ix")
    pairs = cell_pairs(anchors.select("view_id", "point_id", "lat", "lon", F.col("p_good").alias("here_p_good")), lots, max_m)
    pairs = pairs.withColumn("distance_m", round_half_up("distance_m")).where(F.col("distance_m").between(min_m, max_m))
    pairs = pairs.withColumns({
        "suitability": parking_suitability("lot_p_good", "lot_d", "lot_width", "distance_m"),
        "probability_delta": F.col("lot_p_good") - F.col("here_p_good"),
        "direction": octant_label("lat", "lon", "p_lat", "p_lon")})
    best = top_per_group(pairs, ["view_id", "point_id"],
                         [F.desc("suitability"), F.desc("probability_delta"), F.asc("ingest_ix")], limit)
    return best.select("view_id", "point_id", "rank", "lot_id", "lot_name", "distance_m", "suitability",
                       "probability_delta", "direction", F.col("p_lat").alias("lot_lat"), F.col("p_lon").alias("lot_lon"))


def first_merchant_at(destinations: DataFrame, merchants: DataFrame, max_m: float = 40.0) -> DataFrame:
    """Destination -> first merchant in input order within range (not nearest)."""
    m = _one_per_location(merchants, [F.asc("ingest_ix")]).select(
        "view_id", F.col("id").alias("merchant_id"), "lat", "lon", "ingest_ix")
    pairs = cell_pairs(_anchor(destinations), m, max_m).where(F.col("distance_m") <= max_m)
    return pairs.groupBy("view_id", "point_id").agg(F.min_by("merchant_id", "ingest_ix").alias("merchant_id"))
