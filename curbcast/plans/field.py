"""The main job: load views, calibrate, score the grid, rank parking, pick spots."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..checkpoints import stage
from ..operators.coverage import select_spots
from ..operators.features import demand_nodes
from ..operators.grid import grid_nodes
from ..operators.hours import filter_open
from ..operators.kernel import kernel_features, weighted_places
from ..operators.predicates import clamp_views, in_views
from ..operators.rank import rank_parking
from ..operators.score import add_effective_intensity, score_points
from ..operators.stats import lambda_reference, view_stats


@dataclass
class Field:
    """A scored field; every member is a DataFrame."""
    views: DataFrame
    merchants: DataFrame
    parking: DataFrame
    residential: DataFrame
    calibration: DataFrame
    grid_features: DataFrame

    @property
    def heat(self) -> DataFrame:
        """Every grid node, scored."""
        return score_points(self.grid_features, self.views, self.calibration)


def grid_field(views: DataFrame, merchants: DataFrame, parking: DataFrame, residential: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(calibration, grid features): lambda_ref per view and the kernel sums.

    The kernel sums are computed once and serve both the calibration and the
    scoring pass; they are staged because the selection of lambda_ref reads
    them three times.
    """
    places = stage(weighted_places(merchants, parking, residential, views, grid=True), "places")
    feats = stage(kernel_features(grid_nodes(views), places), "grid-features")
    ref = stage(lambda_reference(add_effective_intensity(feats, views, calibration=True)), "lambda-ref")
    return ref, feats


def load_field(views: DataFrame, merchants: DataFrame, parking: DataFrame, residential: DataFrame) -> Field:
    """Clamp the views, keep what lies inside them and is open, and score."""
    v, m, p, r = load_inputs(views, merchants, parking, residential)
    ref, feats = grid_field(v, m, p, r)
    return Field(v, m, p, r, ref, feats)


def load_inputs(views: DataFrame, merchants: DataFrame, parking: DataFrame, residential: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(views, open merchants, parking, residential) of the clamped views."""
    v = stage(clamp_views(views), "views")
    m = stage(filter_open(in_views(merchants, v), v.select("view_id", "osm_day", "minute")), "open-merchants")
    return v, m, stage(in_views(parking, v), "parking"), stage(in_views(residential, v), "residential")


def score_places(points: DataFrame, field_views: DataFrame, merchants: DataFrame, parking: DataFrame,
                 residential: DataFrame | None, calibration: DataFrame | None, explain: bool = True) -> DataFrame:
    """Point queries: the full score at given points with stored calibration."""
    places = stage(weighted_places(merchants, parking, residential, field_views), "places")
    return score_points(kernel_features(points, places), field_views, calibration, explain)


def score_parking(f: Field, explain: bool = True) -> DataFrame:
    """Every lot of every view, scored against the view's calibration."""
    pts = f.parking.select("view_id", F.col("id").alias("point_id"), "lat", "lon")
    s = score_places(pts, f.views, f.merchants, f.parking, f.residential, f.calibration, explain)
    return s.withColumnRenamed("point_id", "id").join(f.parking.select("view_id", "id", "ingest_ix", "name"), ["view_id", "id"])


def pick_spots(f: Field, scored_parking: DataFrame, k: int = 3) -> DataFrame:
    """K spots per view by demand coverage."""
    cand = scored_parking.join(f.views.select("view_id", F.greatest(F.lit(300.0), F.col("tau")).alias("coverage_tau")), "view_id")
    return select_spots(cand, demand_nodes(f.merchants, f.residential, f.views), k)


__all__ = ["Field", "grid_field", "load_field", "score_places", "score_parking", "pick_spots", "rank_parking", "view_stats"]
