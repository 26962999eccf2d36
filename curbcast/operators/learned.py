"""Learned scorer: feature columns, dual-logit prediction, training, metrics."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import clamp01_zero, col, positive_or, safe_probability, sigmoid

# Weights of the shipped model.
ARRIVAL_WEIGHTS = {
    "intercept": -2.1, "merchant_signal": 2.65, "proximity_signal": 1.45, "competition_signal": -1.85,
    "support_score": 1.15, "residential_share": 0.75, "horizon_log": 0.95, "demand_x_proximity": 1.35,
    "demand_x_support": 0.8, "competition_x_demand": -0.9, "lunch": 0.15, "dinner": 0.32,
    "late_dinner": 0.12, "late_night": -0.18, "post_midnight": -0.28, "weekend": 0.08, "weekend_dinner": 0.14,
}
QUALITY_WEIGHTS = {
    "intercept": -0.95, "income_signal": 2.4, "proximity_signal": 0.9, "competition_signal": -0.35,
    "support_score": 0.45, "residential_share": -0.15, "late_night": -0.55, "dinner": 0.12,
    "weekend": 0.06, "income_x_proximity": 1.15,
}
ARRIVAL_CALIBRATOR = (1.04, -0.96, 0.02)
QUALITY_CALIBRATOR = (1.02, -0.98, -0.01)
LN2 = 0.6931471805599453


def resolve_model(name, use_ml) -> Column:
    n = F.lower(F.trim(F.coalesce(col(name).cast("string"), F.lit(""))))
    return F.when(n.isin("glm", "legacy", "softplus"), n).otherwise(
        F.when(F.coalesce(col(use_ml), F.lit(False)), "softplus").otherwise("legacy"))


def feature_columns(sig_i, sig_m, sig_r, sig_d, support, residential_share, horizon_min,
                    bucket_name, weekend) -> tuple[dict[str, Column], dict[str, Column]]:
    """(16 arrival features, 9 quality features) as named Columns."""
    m, r, d, i = (clamp01_zero(x) for x in (sig_m, sig_r, sig_d, sig_i))
    s, res = clamp01_zero(support), clamp01_zero(residential_share)
    horizon = F.log1p(F.greatest(F.lit(1.0), positive_or(horizon_min, 10.0)) / 10.0)
    flag = {b: F.when(col(bucket_name) == b, 1.0).otherwise(0.0)
            for b in ("lunch", "dinner", "late_dinner", "late_night", "post_midnight")}
    w = F.when(F.coalesce(col(weekend), F.lit(False)), 1.0).otherwise(0.0)
    arrival = {"merchant_signal": m, "proximity_signal": r, "competition_signal": d, "support_score": s,
               "residential_share": res, "horizon_log": horizon, "demand_x_proximity": m * r,
               "demand_x_support": m * s, "competition_x_demand": m * d, **flag, "weekend": w,
               "weekend_dinner": w * flag["dinner"]}
    quality = {"income_signal": i, "proximity_signal": r, "competition_signal": d, "support_score": s,
               "residential_share": res, "late_night": flag["late_night"] + flag["post_midnight"],
               "dinner": flag["dinner"] + flag["late_dinner"], "weekend": w, "income_x_proximity": i * r}
    return arrival, quality


def linear(weights: Mapping[str, float], features: Mapping[str, Column]) -> Column:
    """Intercept plus the weighted features the weight table knows."""
    out = F.lit(float(weights.get("intercept", 0.0)))
    for name, f in features.items():
        if weights.get(name):
            out = out + F.lit(float(weights[name])) * f
    return out


def with_learned(df: DataFrame, sig_i, sig_m, sig_r, sig_d, support, residential_share, horizon_min,
                 bucket_name, weekend, baseline_p_any, baseline_quality, prefix: str = "learned_") -> DataFrame:
    """Learned prediction, shrunk towards the baseline, as ``learned_*`` columns.

    Written as short projection levels: every shared term is a column of the
    level below, so no expression is repeated.
    """
    fa, fq = feature_columns(sig_i, sig_m, sig_r, sig_d, support, residential_share, horizon_min,
                             bucket_name, weekend)
    n = lambda x: prefix + x
    c = lambda x: F.col(prefix + x)
    df = df.withColumns({n("z_a"): linear(ARRIVAL_WEIGHTS, fa), n("z_q"): linear(QUALITY_WEIGHTS, fq),
                         n("support_mass"): clamp01_zero(0.55 * clamp01_zero(support) + 0.45 * clamp01_zero(sig_m))})
    df = df.withColumns({n("raw_p_any"): sigmoid(c("z_a")), n("raw_quality"): sigmoid(c("z_q"))})
    df = df.withColumns({n("s_a"): safe_probability(c("raw_p_any")), n("s_q"): safe_probability(c("raw_quality"))})

    def calibrated(x: str, k: tuple[float, float, float]) -> Column:
        return sigmoid(k[0] * F.log(c(x)) + k[1] * F.log(1.0 - c(x)) + k[2])

    df = df.withColumns({n("calibrated_p_any"): calibrated("s_a", ARRIVAL_CALIBRATOR),
                         n("calibrated_quality"): calibrated("s_q", QUALITY_CALIBRATOR)})
    df = df.withColumns({n("e_a"): safe_probability(c("calibrated_p_any")), n("e_q"): safe_probability(c("calibrated_quality"))})

    def entropy(x: str) -> Column:
        return -c(x) * F.log(c(x)) - (1.0 - c(x)) * F.log(1.0 - c(x))

    df = df.withColumn(n("confidence"), clamp01_zero(1.0 - (entropy("e_a") + entropy("e_q")) / 2.0 / LN2))
    df = df.withColumn(n("blend"), clamp01_zero(0.04 + 0.35 * c("support_mass") + 0.18 * c("confidence")))

    def shrunk(base, cal: str) -> Column:
        return clamp01_zero((1.0 - c("blend")) * clamp01_zero(F.coalesce(col(base), c(cal))) + c("blend") * c(cal))

    df = df.withColumns({
        n("p_any"): shrunk(baseline_p_any, "calibrated_p_any"), n("quality"): shrunk(baseline_quality, "calibrated_quality"),
        n("support_scale"): F.greatest(F.lit(0.4), 0.7 + 0.55 * (0.5 * c("confidence") + 0.5 * c("support_mass")))})
    return df.drop(*[n(x) for x in ("z_a", "z_q", "s_a", "s_q", "e_a", "e_q")])


# --- training -------------------------------------------------------------

def _prepared_samples(samples: DataFrame, keys: Sequence[str], label: str, weight: str | None) -> DataFrame:
    w = F.greatest(F.lit(0.0), positive_or(weight, 1.0)) if weight else F.lit(1.0)
    x = [F.nanvl(F.coalesce(F.col(k).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(k) for k in keys]
    return samples.select(*x, clamp01_zero(label).alias("_y"), w.alias("_w"))


def train_logistic(samples: DataFrame, feature_keys: Sequence[str], label: str = "label",
                   weight: str | None = None, iterations: int = 400, learning_rate: float = 0.2,
                   l2: float = 0.02, positive: Sequence[str] = (), negative: Sequence[str] = (),
                   initial: Mapping[str, float] | None = None) -> tuple[dict[str, float], float]:
    """Full-batch projected gradient with L2 on the non-intercept weights.

    Each step is one map-side combined aggregate over the cached samples that
    returns ``len(keys) + 1`` numbers.  Returns (weights, average loss).
    """
    keys = list(feature_keys)
    init = dict(initial or {})
    weights = {k: float(init.get(k, 0.0)) for k in ["intercept", *keys]}
    rows = _prepared_samples(samples, keys, label, weight).persist()
    try:
        n = rows.count()
        if not n:
            return weights, 0.0

        def error() -> Column:
            z = linear(weights, {k: F.col(k) for k in keys})
            return (sigmoid(z) - F.col("_y")) * F.col("_w")

        for _ in range(iterations):
            g = rows.select(error().alias("_e"), *keys).agg(
                F.sum("_e").alias("intercept"), *[F.sum(F.col("_e") * F.col(k)).alias(k) for k in keys]).first()
            step = {"intercept": weights["intercept"] - learning_rate * g["intercept"] / n}
            for k in keys:
                v = weights[k] - learning_rate * (g[k] / n + 2 * l2 * weights[k])
                step[k] = max(0.0, v) if k in positive else min(0.0, v) if k in negative else v
            weights = step
        p = safe_probability(sigmoid(linear(weights, {k: F.col(k) for k in keys})))
        loss = -(F.col("_y") * F.log(p) + (1.0 - F.col("_y")) * F.log(1.0 - p)) * F.col("_w")
        return weights, rows.agg(F.sum(loss)).first()[0] / n
    finally:
        rows.unpersist()


def fit_beta_calibrator(samples: DataFrame, probability: str = "raw_probability", label: str = "label",
                        weight: str | None = None, iterations: int = 250, learning_rate: float = 0.15,
                        l2: float = 0.005) -> dict[str, float]:
    """Beta calibration: a logistic fit on (ln p, ln(1 - p))."""
    p = safe_probability(probability)
    rows = samples.withColumns({"log_positive": F.log(p), "log_negative": F.log(1.0 - p)})
    w, loss = train_logistic(rows, ["log_positive", "log_negative"], label, weight, iterations, learning_rate, l2)
    return {"alpha": w["log_positive"], "beta": w["log_negative"], "bias": w["intercept"], "average_loss": loss}


# --- metrics --------------------------------------------------------------

def calibration_error(df: DataFrame, probability="probability", label="label", bins: int = 10,
                      by: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error over equal-width bins (last bin closed)."""
    p = clamp01_zero(probability)
    binned = (df.select(*by, p.alias("_p"), clamp01_zero(label).alias("_y"))
              .groupBy(*by, F.least(F.floor(F.col("_p") * float(bins)), F.lit(bins - 1)).alias("_b"))
              .agg(F.count(F.lit(1)).alias("_n"), F.sum("_p").alias("_sp"), F.sum("_y").alias("_sy")))
    return binned.groupBy(*by).agg(
        F.coalesce(F.sum(F.abs(F.col("_sp") - F.col("_sy"))) / F.sum("_n"), F.lit(0.0)).alias("ece"))


def brier_score(df: DataFrame, probability="probability", label="label", by: Sequence[str] = ()) -> DataFrame:
    e = clamp01_zero(probability) - clamp01_zero(label)
    return df.groupBy(*by).agg(F.coalesce(F.avg(e * e), F.lit(0.0)).alias("brier"))


def log_loss(df: DataFrame, probability="probability", label="label", weight=None, by: Sequence[str] = ()) -> DataFrame:
    """Weighted log loss divided by the row count."""
    p, y = safe_probability(probability), clamp01_zero(label)
    w = F.greatest(F.lit(0.0), positive_or(weight, 1.0)) if weight is not None else F.lit(1.0)
    loss = -(y * F.log(p) + (1.0 - y) * F.log(1.0 - p)) * w
    return df.groupBy(*by).agg(F.coalesce(F.sum(loss) / F.count(F.lit(1)), F.lit(0.0)).alias("log_loss"))
