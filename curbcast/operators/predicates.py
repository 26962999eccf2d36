"""View boxes, freshness, eligibility and reading filters as Columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import METERS_PER_DEGREE, haversine_m
from ..functions.scalar import col, is_finite

MAX_DIAGONAL_M = 12000.0


def in_box(lat, lon, south="south", west="west", north="north", east="east") -> Column:
    """Inclusive box test; rows without finite coordinates fail."""
    return is_finite(lat) & is_finite(lon) & col(lat).between(col(south), col(north)) & col(lon).between(col(west), col(east))


def boxes_intersect(a: str, b: str) -> Column:
    """Boxes with column prefixes a and b share a point (touching counts)."""
    c = F.col
    return ~((c(f"{b}west") > c(f"{a}east")) | (c(f"{b}east") < c(f"{a}west"))
             | (c(f"{b}south") > c(f"{a}north")) | (c(f"{b}north") < c(f"{a}south")))


def box_contains(a: str, b: str) -> Column:
    """Box b lies inside box a."""
    c = F.col
    return ((c(f"{b}south") >= c(f"{a}south")) & (c(f"{b}west") >= c(f"{a}west"))
            & (c(f"{b}north") <= c(f"{a}north")) & (c(f"{b}east") <= c(f"{a}east")))


def data_freshness(loaded: str, current: str) -> Column:
    """'stale', 'extends' or 'ok' for a loaded and a current box."""
    return (F.when(~boxes_intersect(loaded, current), "stale")
            .when(~box_contains(loaded, current), "extends").otherwise("ok"))


def clamp_views(views: DataFrame, max_diagonal_m: float = MAX_DIAGONAL_M) -> DataFrame:
    """Replace boxes with too long a diagonal by a square around the centre."""
    lat, lon = (F.col("south") + F.col("north")) / 2.0, (F.col("west") + F.col("east")) / 2.0
    wide = haversine_m("south", "west", "north", "east") > max_diagonal_m
    half = max_diagonal_m / 4.0
    dlat = F.lit(half / METERS_PER_DEGREE)
    dlon = half / (METERS_PER_DEGREE * F.greatest(F.cos(F.radians(lat)), F.lit(0.1)))
    return views.select(
        *[c for c in views.columns if c not in ("south", "west", "north", "east")],
        F.when(wide, lat - dlat).otherwise(F.col("south")).alias("south"),
        F.when(wide, lon - dlon).otherwise(F.col("west")).alias("west"),
        F.when(wide, lat + dlat).otherwise(F.col("north")).alias("north"),
        F.when(wide, lon + dlon).otherwise(F.col("east")).alias("east"), wide.alias("clamped"))


def in_views(places: DataFrame, views: DataFrame) -> DataFrame:
    """Places inside the box of their view (the view id is already known)."""
    box = views.select("view_id", "south", "west", "north", "east")
    return places.join(box, "view_id").where(in_box("lat", "lon")).drop("south", "west", "north", "east")


def place_in_views(places: DataFrame, views: DataFrame) -> DataFrame:
    """Every (view, place) with the place inside the view's box, by position alone.

    A place may lie in several boxes.  A box is put on the grid whose cells are
    as wide as the power of two above its longer side, so it covers at most four
    cells; places take a cell on each grid that is in use (a few).  The box test
    is the residual of that equi join.  A box whose west is east of its east
    crosses the 180th meridian and is taken as two.  Rows without finite
    coordinates lie in no box.  ``places`` must not carry ``view_id``.
    """
    box = views.select("view_id", "south", "west", "north", "east")
    halves = F.when(F.col("west") > F.col("east"), F.array(F.struct(F.col("west").alias("w"), F.lit(180.0).alias("e")), F.struct(F.lit(-180.0).alias("w"), F.col("east").alias("e")))).otherwise(
        F.array(F.struct(F.col("west").alias("w"), F.col("east").alias("e"))))
    box = box.withColumn("_h", F.explode(halves)).select("view_id", "south", "north", F.col("_h.w").alias("west"), F.col("_h.e").alias("east"))
    side = F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west"), F.lit(1e-6))
    box = box.withColumn("_level", F.ceil(F.log2(side)).cast("int"))
    levels = [r["_level"] for r in box.select("_level").where("_level is not null").distinct().collect()]     # at most thirty

    def cell(x: str, level: Column) -> Column:
        return F.floor(F.col(x) / F.pow(F.lit(2.0), level)).cast("bigint")

    box = box.withColumn("_cy", F.explode(F.sequence(cell("south", F.col("_level")), cell("north", F.col("_level")))))
    box = box.withColumn("_cx", F.explode(F.sequence(cell("west", F.col("_level")), cell("east", F.col("_level")))))
    p = places.where(is_finite("lat") & is_finite("lon")).withColumn("_level", F.explode(F.array(*[F.lit(n) for n in sorted(levels)]).cast("array<int>")))
    p = p.withColumn("_cy", cell("lat", F.col("_level"))).withColumn("_cx", cell("lon", F.col("_level")))
    return p.join(box, ["_level", "_cy", "_cx"]).where(in_box("lat", "lon")).drop("_level", "_cy", "_cx", "south", "west", "north", "east")


def driver_assignable(capacity="capacity", lat="lat", lon="lon") -> Column:
    return (col(capacity) >= 1) & is_finite(lat) & is_finite(lon)


def order_assignable() -> Column:
    return (is_finite("pickup_lat") & is_finite("pickup_lon") & is_finite("dropoff_lat") & is_finite("dropoff_lon"))


def reliable_reading(heading, accuracy, reliable, max_accuracy_deg: float = 30.0) -> Column:
    a = col(accuracy)
    return col(heading).isNotNull() & col(reliable) & (a.isNull() | (a <= max_accuracy_deg))


def accuracy_radius(accuracy) -> Column:
    """Metres, never below 12."""
    a = F.nanvl(F.coalesce(col(accuracy).cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.greatest(a, F.lit(12.0))


def shows_accuracy_circle(accuracy) -> Column:
    return accuracy_radius(accuracy) <= 45.0


def cells_of(views: DataFrame, degrees: float) -> list[tuple[int, int]]:
    """The layout cells that the boxes of the views touch; never more than the globe has."""
    box = views.where(is_finite("south") & is_finite("north") & is_finite("west") & is_finite("east"))
    crossing = F.col("west") > F.col("east")
    spans = F.when(crossing, F.array(F.struct(F.col("west").alias("w"), F.lit(180.0).alias("e")), F.struct(F.lit(-180.0).alias("w"), F.col("east").alias("e")))).otherwise(
        F.array(F.struct(F.col("west").alias("w"), F.col("east").alias("e"))))
    at = lambda c: F.floor(c / degrees).cast("int")
    rows = box.select("south", "north", F.explode(spans).alias("s")).select(
        F.explode(F.sequence(at(F.col("south")), at(F.col("north")))).alias("y"), "s").select("y", F.explode(F.sequence(at(F.col("s.w")), at(F.col("s.e")))).alias("x"))
    return sorted((r["y"], r["x"]) for r in rows.distinct().collect())
