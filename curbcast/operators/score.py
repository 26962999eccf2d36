"""Scoring: kernel features and view parameters to probabilities and signals."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import clamp01, col, round_half_up, softplus
from .features import demand_profile, is_late, is_weekend, time_bucket
from .learned import resolve_model, with_learned

HORIZON_MIN = 10.0


def arrival_probability(lam, ref, rain_multiplier, soft: Column | bool, beta) -> Column:
    """Chance of any order within the horizon for an effective intensity."""
    base = math.log(2.0) / HORIZON_MIN
    rain = F.greatest(F.lit(0.0), F.coalesce(col(rain_multiplier), F.lit(1.0)))
    safe_ref = F.greatest(F.lit(1e-9), col(ref))
    plain = 1.0 - F.exp(-rain * base * (col(lam) / safe_ref) * HORIZON_MIN)
    bias = math.log(math.exp(base) - 1.0)
    b = F.greatest(F.lit(0.0), F.coalesce(col(beta), F.lit(2.0)))
    rate = rain * softplus(F.lit(bias) + b * F.log(F.greatest(F.lit(1e-9), col(lam)) / safe_ref))
    soft_p = 1.0 - F.exp(-rate * HORIZON_MIN)
    if isinstance(soft, bool):
        return clamp01(soft_p if soft else plain)
    return clamp01(F.when(soft, soft_p).otherwise(plain))


def stability_band(p, support) -> tuple[Column, Column]:
    """Mean +/- 1.28 sd of a Beta with the given effective support."""
    n = F.greatest(F.lit(2.0), F.coalesce(col(support), F.lit(0.0)) * 2.5)
    a, b = 1.0 + clamp01(p) * n, 1.0 + (1.0 - clamp01(p)) * n
    t = a + b
    sd = F.sqrt(F.greatest(F.lit(0.0), a * b / (t * t * (t + 1.0))))
    return clamp01(a / t - 1.28 * sd), clamp01(a / t + 1.28 * sd)


def scoring_params(params: DataFrame) -> DataFrame:
    """View parameters with defaults, demand multipliers and time bucket."""
    have = set(params.columns)

    def opt(name: str, default, kind: str = "double") -> Column:
        return F.coalesce(F.col(name).cast(kind), F.lit(default)) if name in have else F.lit(default)

    m, r = demand_profile("hour", "dow")
    rain = F.greatest(F.lit(0.0), F.least(F.lit(0.25), opt("rain_boost", 0.0)))
    model = resolve_model(F.col("prediction_model") if "prediction_model" in have else F.lit(""),
                          opt("use_ml", False, "boolean"))
    return params.select(
        "view_id", F.col("hour").alias("hour"), F.col("dow").alias("dow"),
        F.greatest(F.lit(0.0), opt("competition_strength", 0.0)).alias("comp"),
        F.greatest(F.lit(0.0), opt("residential_weight", 0.35)).alias("res_weighting"),
        rain.alias("rain_boost"), clamp01(opt("tip_emphasis", 0.55)).alias("tip_w"),
        model.alias("prediction_model"), opt("use_ml", False, "boolean").alias("use_ml"),
        opt("ml_beta", 2.0).alias("ml_beta"), m.alias("profile_m"), r.alias("profile_r"),
        time_bucket("hour").alias("bucket"))


def demand_columns(parking: str = "parking_sum", residential: str = "residential_sum") -> dict[str, Column]:
    """Demand blend and effective intensity (needs :func:`scoring_params`)."""
    md = (1.0 + F.col("rain_boost")) * F.col("profile_m") * F.col("merchant_intensity")
    rd = (1.0 + F.col("rain_boost") * 1.35) * F.col("res_weighting") * F.col("profile_r") * F.col(residential)
    return {"merchant_demand": md, "residential_demand": rd,
            "lambda_eff": (md + rd) / (1.0 + F.col("comp") * F.col(parking))}


def add_effective_intensity(features: DataFrame, params: DataFrame, calibration: bool = False) -> DataFrame:
    """Join the view parameters and add the demand blend.

    ``calibration=True`` uses the calibration-pass kernel sums and names the
    result ``lambda_cal`` only.
    """
    p = scoring_params(params)
    df = features if "comp" in features.columns else features.join(p, "view_id")
    if calibration:
        return df.withColumn("lambda_cal", demand_columns("parking_sum_cal", "residential_sum_cal")["lambda_eff"])
    return df.withColumns(demand_columns())


def score_points(features: DataFrame, params: DataFrame, stats: DataFrame | None = None,
                 explain: bool = True) -> DataFrame:
    """Full scorer.

    ``features`` comes from ``kernel_features``; ``stats`` gives ``lambda_ref``
    per view (missing views, or no stats, calibrate on the point itself).  All
    of it is one chain of projections after at most two joins on ``view_id``.
    """
    df = add_effective_intensity(features, params)
    if stats is not None:
        df = df.join(stats.select("view_id", "lambda_ref"), "view_id", "left")
    elif "lambda_ref" not in df.columns:
        df = df.withColumn("lambda_ref", F.lit(None).cast("double"))
    c = F.col
    df = df.withColumn("lambda_ref", F.greatest(F.lit(1e-9), F.coalesce(c("lambda_ref"), c("lambda_eff"))))
    total = c("merchant_demand") + c("residential_demand")
    df = df.withColumns({
        "merchant_share": F.coalesce(F.try_divide(c("merchant_demand"), total), F.lit(0.0)),
        "residential_share": F.coalesce(F.try_divide(c("residential_demand"), total), F.lit(0.0)),
        "sig_r": F.exp(-c("expected_dist") / 900.0),
        "support_score": clamp01((c("effective_merchants") - 1.0) / 7.0),
        "sig_i": clamp01((c("ticket_mean") - 0.5) / 0.8),
        "sig_m": clamp01(c("merchant_intensity") / (2.0 * c("lambda_ref"))),
        "sig_d": c("comp") * c("parking_sum") / (1.0 + c("comp") * c("parking_sum")),
        "tip_proxy": clamp01(clamp01((c("ticket_mean") - 0.75) / 0.45) * F.when(is_late("hour"), 0.85).otherwise(1.0)),
        "soft": c("prediction_model") == "softplus",
    })
    df = df.withColumn("rain_multiplier", 1.0 + c("rain_boost") * (1.1 + 0.35 * c("residential_share")))

    def arrive(factor: float) -> Column:
        return arrival_probability(c("lambda_eff") * factor, "lambda_ref", "rain_multiplier", c("soft"), "ml_beta")

    df = df.withColumns({
        "baseline_p_any": arrive(1.0), "_low": arrive(0.7), "_high": arrive(1.3),
        "baseline_quality": clamp01((1.0 - c("tip_w")) * c("sig_r") + c("tip_w") * c("tip_proxy")),
    })
    df = with_learned(df, sig_i="sig_i", sig_m="sig_m", sig_r="sig_r", sig_d="sig_d", support="support_score",
                      residential_share="residential_share", horizon_min=F.lit(HORIZON_MIN), bucket_name=c("bucket.name"),
                      weekend=is_weekend("dow"), baseline_p_any="baseline_p_any", baseline_quality="baseline_quality")
    glm = c("prediction_model") == "glm"
    df = df.withColumns({
        "p_any": F.when(glm, c("learned_p_any")).otherwise(c("baseline_p_any")),
        "quality": F.when(glm, c("learned_quality")).otherwise(c("baseline_quality")),
        "model_confidence": F.when(glm, c("learned_confidence")).otherwise(1.0),
        "model_blend": F.when(glm, c("learned_blend")).otherwise(1.0),
        "_n": F.greatest(F.lit(2.0), c("effective_merchants") * F.when(glm, c("learned_support_scale")).otherwise(1.0) * 2.5),
    })
    df = df.withColumn("_mult", 0.25 + 0.75 * c("quality"))
    df = df.withColumns({"p_good": clamp01(c("p_any") * c("_mult")), "p_any_low": F.least(c("_low"), c("p_any")),
                         "p_any_high": F.greatest(c("_high"), c("p_any"))})
    df = df.withColumns({"_a": 1.0 + c("p_good") * c("_n"), "_b": 1.0 + (1.0 - c("p_good")) * c("_n"), "_t": 2.0 + c("_n")})
    df = df.withColumn("_sd", F.sqrt(F.greatest(F.lit(0.0), c("_a") * c("_b") / (c("_t") * c("_t") * (c("_t") + 1.0)))))
    df = df.withColumns({
        "p_good_low": F.least(clamp01(c("p_any_low") * c("_mult")), c("p_good")),
        "p_good_high": F.greatest(clamp01(c("p_any_high") * c("_mult")), c("p_good")),
        "stability_low": clamp01(c("_a") / c("_t") - 1.28 * c("_sd")),
        "stability_high": clamp01(c("_a") / c("_t") + 1.28 * c("_sd")),
        "composite": clamp01(c("bucket.w_i") * c("sig_i") + c("bucket.w_m") * c("sig_m")
                             + c("bucket.w_r") * c("sig_r") - c("bucket.w_d") * c("sig_d")),
    })
    df = df.withColumns({
        "p_good_mid": c("p_good"), "p_any_mid": c("p_any"), "horizon_min": F.lit(HORIZON_MIN),
        "stability_width": c("stability_high") - c("stability_low"),
        "expected_dist_m": round_half_up("expected_dist"),
        "nearest_merchant_m": round_half_up("nearest_dist"),
        "relative_intensity": c("lambda_eff") / c("lambda_ref"),
        "rain_lift_percent": c("rain_boost") * 100.0,
        "residential_intensity": c("residential_sum"), "competition_intensity": c("parking_sum"),
        "model_family": F.when(c("prediction_model") == "glm", "monotone-calibrated-dual-logit")
        .when(c("soft"), "softplus-rate-proxy").otherwise("legacy-rate-proxy"),
        "model_version": F.when(c("prediction_model") == "glm", "20260401-monotone-dual-glm"),
        "time_bucket_name": c("bucket.name"), "time_bucket_label": c("bucket.label"),
        "signals": F.struct(c("sig_i").alias("I"), c("sig_m").alias("M"), c("sig_r").alias("R"), c("sig_d").alias("D")),
        "advisory": F.when((c("composite") >= 0.5) & (c("effective_merchants") >= 3), "hold").otherwise("rotate"),
    })
    if explain:
        df = df.withColumn("explain", explain_struct())
    drop = ["comp", "res_weighting", "tip_w", "profile_m", "profile_r", "bucket", "soft", "sig_i", "sig_m", "sig_r", "sig_d",
            "rain_multiplier", "parking_sum", "residential_sum", "parking_sum_cal", "residential_sum_cal",
            "_low", "_high", "_n", "_mult", "_a", "_b", "_t", "_sd"]
    return df.drop(*drop, *[x for x in df.columns if x.startswith("learned_")])


def explain_struct() -> Column:
    """Four sentences that explain a score."""
    def whole(x) -> Column:
        return round_half_up(x).cast("string")

    def share(name: str, what: str) -> Column:
        return F.concat(whole(clamp01(name) * 100.0), F.lit(f"% of this 10-minute probability comes from {what}."))

    pct = round_half_up(F.greatest(F.lit(0.0), F.col("relative_intensity")) * 100.0)
    level = F.when(pct >= 125, "well above").when(pct >= 95, "near").otherwise("below")
    rain = F.greatest(F.lit(0).cast("bigint"), round_half_up("rain_lift_percent"))
    return F.struct(
        share("merchant_share", "nearby merchants").alias("merchant_share"),
        share("residential_share", "surrounding homes and apartments").alias("residential_share"),
        F.concat(F.lit("This spot is running "), level, F.lit(" the map's reference intensity at about "),
                 pct.cast("string"), F.lit("% of baseline.")).alias("relative_intensity"),
        F.when(rain > 0, F.concat(F.lit("Rain is adding about "), rain.cast("string"),
                                  F.lit("% lift to modeled demand right now.")))
        .otherwise("Rain lift is off right now.").alias("rain_lift_percent"))
