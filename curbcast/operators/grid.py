"""Grid nodes over view bounds."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import degree_steps


def _axis(start: Column, end: Column, step: Column) -> Column:
    """start, start+step, ... <= end, by repeated addition.

    Repeated addition decides whether the last row or column exists, so it is
    kept as an array fold instead of a multiplication.
    """
    n = (F.floor((end - start) / step) + 2).cast("int")
    more = F.sequence(F.lit(1), F.greatest(F.lit(1), n))
    full = F.aggregate(more, F.array(start), lambda acc, _i: F.concat(acc, F.array(F.element_at(acc, -1) + step)))
    return F.filter(full, lambda x: x <= end)


def grid_nodes(views: DataFrame, step="grid_step") -> DataFrame:
    """One row per node: view_id, point_id ('row:col'), lat, lon.

    ``views``: view_id, south, west, north, east and the step in metres.  The
    node count is bounded by the view clamp and the smallest step, and the
    explode is narrow (no shuffle).  With a plain explode Spark would test first
    that no axis is empty, and that test sinks to the rows the views are made
    from: the axes would be folded once a place instead of once a view.
    """
    dlat, dlon = degree_steps(step, (F.col("south") + F.col("north")) / 2.0, 1e-6)
    axes = views.select("view_id", _axis(F.col("south"), F.col("north"), dlat).alias("_lats"),
                        _axis(F.col("west"), F.col("east"), dlon).alias("_lons"))
    rows = axes.select("view_id", "_lons", F.posexplode_outer("_lats").alias("grid_row", "lat"))
    cells = rows.select("view_id", "grid_row", "lat", F.posexplode_outer("_lons").alias("grid_col", "lon"))
    return cells.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("view_id", F.concat_ws(":", "grid_row", "grid_col").alias("point_id"), "lat", "lon")
