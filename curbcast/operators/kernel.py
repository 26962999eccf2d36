"""Kernel-weighted spatial join: distance-decayed sums per query point.

All place kinds go through one join.  Places that share a location and class
are combined first (their weights add), so copies cost nothing after the first
aggregate, and per-place trigonometry, weight and ticket index are computed
once, not once per pair.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import pair_distance_m, trig_columns
from ..functions.scalar import col, round_half_up
from .blocks import BLOCK_ROWS, block_join
from .features import (MERCHANT_CLASSES, amenity_class, merchant_weight, residential_weight, ticket_index)

FAR = 1e9
# Class codes of pre-aggregated places: 0-3 named merchants, 4 other merchants.
OTHER, PARKING, RESIDENTIAL = 4, 5, 6


def kernel_widths(params: DataFrame) -> DataFrame:
    """Per view: decay lengths of the scorer and of the calibration pass.

    The two passes clamp the competition and residential lengths differently,
    so both variants are kept; they coincide for usual settings.
    """
    tau = F.col("tau")
    scaled = round_half_up(tau * 0.8).cast("double")
    given_c = _optional(params, "competition_tau")
    given_r = _optional(params, "residential_tau")
    default_r = F.greatest(F.lit(400.0), tau * 1.6)
    return params.select(
        "view_id", "hour", "dow",
        F.greatest(F.lit(1.0), tau).alias("tau_m"),
        F.greatest(F.lit(100.0), F.coalesce(given_c, F.greatest(F.lit(250.0), F.least(F.lit(1200.0), scaled)))).alias("tau_p_point"),
        F.greatest(F.lit(100.0), F.coalesce(given_c, scaled)).alias("tau_p_grid"),
        F.greatest(F.lit(250.0), F.coalesce(given_c, scaled)).alias("tau_p_cal"),
        F.greatest(F.lit(250.0), F.coalesce(given_r, default_r)).alias("tau_r"),
        F.greatest(F.lit(1.0), F.coalesce(given_r, default_r)).alias("tau_r_cal"))


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")


def weighted_places(merchants: DataFrame, parking: DataFrame, residential: DataFrame | None,
                    params: DataFrame, grid: bool = False) -> DataFrame:
    """Union of all place kinds, weighted, combined per location and class.

    Result: view_id, cls, t (ticket), sw (sum of weights), sw2 (sum of squared
    weights), n (places), tau and tau_cal (decay lengths of the class), trig
    columns with prefix ``p_``.
    """
    widths = kernel_widths(params)
    p_tau = "tau_p_grid" if grid else "tau_p_point"
    cls = F.lit(OTHER)
    for i, name in enumerate(MERCHANT_CLASSES):
        cls = F.when(amenity_class("amenity") == name, F.lit(i)).otherwise(cls)
    zero = F.lit(0.0)
    parts = merchants.select("view_id", "lat", "lon", cls.alias("cls"), "amenity",
                             ticket_index("amenity", "cuisine", "name").alias("t"),
                             *[F.lit(None).cast("string").alias(c) for c in ("building", "landuse", "place_weight")])
    parts = parts.unionByName(parking.select(
        "view_id", "lat", "lon", F.lit(PARKING).alias("cls"), F.lit(None).cast("string").alias("amenity"), zero.alias("t"),
        *[F.lit(None).cast("string").alias(c) for c in ("building", "landuse", "place_weight")]))
    if residential is not None:
        parts = parts.unionByName(residential.select(
            "view_id", "lat", "lon", F.lit(RESIDENTIAL).alias("cls"), F.lit(None).cast("string").alias("amenity"),
            zero.alias("t"), "building", "landuse", "place_weight"))
    # Collapse to distinct tag combinations per location before the view's hour is known.
    tags = ["view_id", "lat", "lon", "cls", "t", "amenity", "building", "landuse", "place_weight"]
    counted = parts.groupBy(*tags).agg(F.count(F.lit(1)).alias("n"))
    w = (F.when(F.col("cls") <= OTHER, merchant_weight("amenity", "hour"))
         .when(F.col("cls") == RESIDENTIAL, residential_weight("building", "landuse", "place_weight", "hour", "dow"))
         .otherwise(F.lit(1.0)))
    tau = (F.when(F.col("cls") <= OTHER, F.col("tau_m")).when(F.col("cls") == PARKING, F.col(p_tau))
           .otherwise(F.col("tau_r")))
    tau_cal = (F.when(F.col("cls") <= OTHER, F.col("tau_m")).when(F.col("cls") == PARKING, F.col("tau_p_cal"))
               .otherwise(F.col("tau_r_cal")))
    return (counted.join(widths, "view_id")
            .select("view_id", "lat", "lon", "cls", "t", "n", w.alias("w"), tau.alias("tau"), tau_cal.alias("tau_cal"))
            .select("view_id", "lat", "lon", "cls", "t", (F.col("n") * F.col("w")).alias("sw"),
                    (F.col("n") * F.col("w") * F.col("w")).alias("sw2"), "n", "tau", "tau_cal",
                    *trig_columns(prefix="p_")))


def kernel_sums(d: Column) -> list[Column]:
    """Aggregates of one point over joined places; ``d`` is the pair distance."""
    cls, k = F.col("cls"), F.col("_k")
    merchant = cls <= OTHER
    c = F.when(merchant, F.col("sw") * k)
    out = [
        F.sum(c).alias("merchant_sum"),
        F.sum(F.when(merchant, F.col("sw") * k * d)).alias("_cd"),
        F.sum(F.when(merchant, F.col("sw") * k * F.col("t"))).alias("_ct"),
        F.sum(F.when(merchant, F.col("sw2") * k * k)).alias("_cc"),
        F.min(F.when(merchant, d)).alias("_near"),
        F.sum(F.when(merchant & (d <= F.col("tau") * 1.25), F.col("n"))).alias("_n_near"),
        F.sum(F.when(cls == PARKING, F.col("n") * k)).alias("parking_sum"),
        F.sum(F.when(cls == PARKING, F.col("n") * F.col("_k_cal"))).alias("parking_sum_cal"),
        F.sum(F.when(cls == RESIDENTIAL, F.col("sw") * k)).alias("residential_sum"),
        F.sum(F.when(cls == RESIDENTIAL, F.col("sw") * F.col("_k_cal"))).alias("residential_sum_cal"),
    ]
    out += [F.sum(F.when(cls == i, F.col("sw") * k)).alias(f"by_{name}")
            for i, name in enumerate([*MERCHANT_CLASSES, "other"])]
    return out


def _finish() -> list[Column]:
    total = F.coalesce(F.col("merchant_sum"), F.lit(0.0))
    some = total > 0
    zero = F.lit(0.0)
    cols = [
        total.alias("merchant_intensity"),
        F.when(some, F.col("_cd") / total).otherwise(F.lit(FAR)).alias("expected_dist"),
        F.when(some, F.col("_ct") / total).otherwise(zero).alias("ticket_mean"),
        F.when(some & (F.col("_cc") > 0), total * total / F.col("_cc")).otherwise(zero).alias("effective_merchants"),
        F.coalesce(F.least(F.lit(FAR), F.col("_near")), F.lit(FAR)).alias("nearest_dist"),
        F.coalesce(F.col("_n_near"), F.lit(0)).cast("bigint").alias("nearby_merchants"),
    ]
    for c in ("parking_sum", "parking_sum_cal", "residential_sum", "residential_sum_cal",
              *[f"by_{n}" for n in [*MERCHANT_CLASSES, "other"]]):
        cols.append(F.coalesce(F.col(c), zero).alias(c))
    return cols


def kernel_features(points: DataFrame, places: DataFrame, carry: tuple[str, ...] = (),
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per point with all kernel aggregates.

    ``points``: view_id, point_id, lat, lon (+ ``carry`` columns that depend on
    the point).  ``places``: result of :func:`weighted_places`.  Points without
    any place survive with empty-set values.
    """
    pts = points.select("view_id", "point_id", "lat", "lon", *carry, *trig_columns(prefix="q_"))
    src = places.drop("lat", "lon")
    pairs = block_join(pts, src, ["view_id"], ["point_id"], ["cls", "p_rlat", "p_rlon", "t"],
                       how="left", block_rows=block_rows)
    d = F.col("_d")
    pairs = (pairs.withColumn("_d", pair_distance_m("q_", "p_"))
             .withColumn("_k", F.exp(-d / F.col("tau")))
             .withColumn("_k_cal", F.when(F.col("tau_cal") == F.col("tau"), F.col("_k"))
                         .otherwise(F.exp(-d / F.col("tau_cal")))))
    keys = ["view_id", "point_id", "lat", "lon", *carry]
    return pairs.groupBy(*keys).agg(*kernel_sums(d)).select(*keys, *_finish())


def point_intensity(points: DataFrame, merchants: DataFrame, params: DataFrame) -> DataFrame:
    """Merchant kernel sum only (the score of a point against restaurants)."""
    none = merchants.select("view_id", "lat", "lon").limit(0)
    places = weighted_places(merchants, none, None, params)
    return kernel_features(points, places).select("view_id", "point_id", "merchant_intensity")


def radius_kernel_sum(points: DataFrame, places: DataFrame, cutoff_taus: float = 36.0) -> DataFrame:
    """Merchant kernel sum for areas much larger than a view.

    The kernel is cut at ``cutoff_taus`` decay lengths; the part left out is at
    most ``sum(w) * exp(-cutoff_taus)``.  At the default it is below the double
    resolution of the sum, so the result is the whole sum.  The join is an equi
    join on a metre cell as wide as the cutoff: each place meets only the 3 x 3
    cells around it.  Places must carry lat, lon, w and tau.
    """
    from .nearby import cell_pairs
    p = places.select("view_id", "lat", "lon", "w", "tau")
    radius = F.col("tau") * F.lit(float(cutoff_taus))
    pairs = cell_pairs(points, p.withColumn("_r", radius), radius_col="_r")
    c = F.col("w") * F.exp(-F.col("distance_m") / F.col("tau"))
    found = pairs.groupBy("view_id", "point_id").agg(F.sum(c).alias("merchant_intensity"))
    return (points.join(found, ["view_id", "point_id"], "left")
            .select("view_id", "point_id", F.coalesce("merchant_intensity", F.lit(0.0)).alias("merchant_intensity")))
