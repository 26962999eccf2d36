"""Registered queries: kernels, calibration, scoring, ranking, selection, places."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import audit, coverage, kernel, nearby, places, predicates, rank, stats
from ..operators.features import demand_nodes
from ..operators.grid import grid_nodes
from ..operators.score import add_effective_intensity
from ..operators.hours import filter_open
from ..checkpoints import stage
from .field import Field, grid_field, load_inputs, pick_spots, score_parking, score_places
from .oracle import c01, demand, dist, octant, r, rc, rint, score
from .registry import big, query, r6
from .tables import Tables


def field(t: Tables) -> Field:
    if "_field" not in t.__dict__:
        v, m, p, h = field_inputs(t)
        ref, feats = grid_field(v, m, p, h)
        t.__dict__["_field"] = Field(v, m, p, h, ref, feats)
    return t.__dict__["_field"]


def heat(t: Tables) -> DataFrame:
    return once(t, "_heat", lambda: field(t).heat)


def scored_merchants(t: Tables) -> DataFrame:
    return once(t, "_scored_merchants", lambda: _score_merchants(t))


def _score_merchants(t: Tables) -> DataFrame:
    f = field(t)
    pts = f.merchants.select("view_id", F.col("id").alias("point_id"), "lat", "lon")
    s = score_places(pts, f.views, f.merchants, f.parking, f.residential, f.calibration)
    return s.join(f.merchants.select("view_id", F.col("id").alias("point_id"), "ingest_ix", "name", "delivery", "takeaway", "drive_through"), ["view_id", "point_id"])


def once(t: Tables, name: str, make) -> DataFrame:
    """Shared intermediate of one data folder, staged on first use."""
    if name not in t.__dict__:
        t.__dict__[name] = stage(make(), name.strip("_"))
    return t.__dict__[name]


def lots(t: Tables) -> DataFrame:
    return once(t, "_lots", lambda: score_parking(field(t)))


def lot_features(t: Tables) -> DataFrame:
    def make() -> DataFrame:
        v, m, p, h = field_inputs(t)
        return kernel.kernel_features(p.select("view_id", F.col("id").alias("point_id"), "lat", "lon"),
                                      stage(kernel.weighted_places(m, p, h, v), "places"))
    return once(t, "_lot_features", make)


def _kernel_query(name: str, spark_cols, sql_cols: str) -> None:
    query(name, f"SELECT view_id, point_id, {sql_cols} FROM parking_features")(
        lambda t: lot_features(t).select("view_id", "point_id", *spark_cols()))


_kernel_query("join_1_merchant_kernel", lambda: [r6("merchant_intensity")], rc("merchant_intensity"))
_kernel_query("join_2_parking_kernel", lambda: [r6("parking_sum")], rc("parking_sum"))
_kernel_query("join_3_residential_kernel", lambda: [r6("residential_sum")], rc("residential_sum"))
_kernel_query("agg_1_kernel_sums", lambda: [r6("merchant_intensity"), r6("parking_sum"), r6("residential_sum")],
              f"{rc('merchant_intensity')}, {rc('parking_sum')}, {rc('residential_sum')}")
_kernel_query("agg_2_weighted_means", lambda: [r6("expected_dist", digits=4), r6("ticket_mean")], f"{rc('expected_dist', d=4)}, {rc('ticket_mean')}")
_kernel_query("agg_3_effective_count", lambda: [r6("effective_merchants")], rc("effective_merchants"))
_kernel_query("agg_4_nearest_distance", lambda: [r6("nearest_dist", digits=4)], rc("nearest_dist", d=4))
_kernel_query("agg_5_nearby_count", lambda: [big("nearby_merchants")], "CAST(nearby_merchants AS BIGINT) AS nearby_merchants")
_kernel_query("agg_6_intensity_by_class", lambda: [r6(f"by_{a}") for a in ("restaurant", "fast_food", "cafe", "food_court")],
              ", ".join(rc(f"by_{a}") for a in ("restaurant", "fast_food", "cafe", "food_court")))


@query("agg_7_point_intensity", f"SELECT view_id, point_id, {rc('merchant_intensity')} FROM all_lots",
       {"lot_points": "SELECT view_id, id AS point_id, lat, lon FROM parking_v",
        "all_lots": "SELECT q.view_id, q.point_id, sum(x.w * exp(-" + dist("q.lat", "q.lon", "x.lat", "x.lon") + " / 1200)) AS merchant_intensity FROM lot_points q JOIN mw x ON x.view_id = q.view_id GROUP BY ALL",
        "mw": "SELECT m.view_id, m.lat, m.lon, (CASE amenity WHEN 'fast_food' THEN 1.3e0 * CASE WHEN hour >= 22 OR hour <= 4 THEN 1.25e0 ELSE 1e0 END WHEN 'cafe' THEN 8e-1 * CASE WHEN hour >= 22 OR hour <= 4 THEN 6e-1 ELSE 1e0 END WHEN 'food_court' THEN 1.15e0 ELSE CASE WHEN hour >= 22 OR hour <= 4 THEN 8.5e-1 ELSE 1e0 END END) AS w FROM merchants_v m JOIN views_v v ON v.view_id = m.view_id"})
def _(t: Tables) -> DataFrame:
    pts = t.parking.select("view_id", F.col("id").alias("point_id"), "lat", "lon")
    return kernel.point_intensity(pts, t.merchants, t.views).select("view_id", "point_id", r6("merchant_intensity"))


@query("join_1c_radius_kernel", f"""SELECT q.view_id, q.id AS point_id, {rc('coalesce(sum(x.w * exp(-' + dist('q.lat', 'q.lon', 'x.lat', 'x.lon') + ' / 120e0)), 0)', 'merchant_intensity')}
FROM parking_v q LEFT JOIN (SELECT m.view_id, m.lat, m.lon, 1e0 AS w FROM merchants_v m) x ON x.view_id = q.view_id GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    pts = t.parking.select("view_id", F.col("id").alias("point_id"), "lat", "lon")
    src = t.merchants.select("view_id", "lat", "lon", F.lit(1.0).alias("w"), F.lit(120.0).alias("tau"))
    return kernel.radius_kernel_sum(pts, src).select("view_id", "point_id", r6("merchant_intensity"))


# --- grid and calibration -------------------------------------------------

@query("grd_1_grid_nodes", f"SELECT view_id, point_id, {rc('lat', d=9)}, {rc('lon', d=9)} FROM grid_points")
def _(t: Tables) -> DataFrame:
    return grid_nodes(t.clamped_views).select("view_id", "point_id", r6("lat", digits=9), r6("lon", digits=9))


@query("grd_2_grid_intensity", f"SELECT view_id, point_id, {rc('lambda_eff')} FROM grid_demand")
def _(t: Tables) -> DataFrame:
    f = field_inputs(t)
    feats = kernel.kernel_features(grid_nodes(f[0]), stage(kernel.weighted_places(*f[1:], f[0], grid=True), "places"))
    return add_effective_intensity(feats, f[0], calibration=True).select("view_id", "point_id", r6("lambda_cal", "lambda_eff"))


def field_inputs(t: Tables):
    if "_inputs" not in t.__dict__:
        t.__dict__["_inputs"] = load_inputs(t.views, t.merchants, t.parking, t.residential)
    return t.__dict__["_inputs"]


@query("grd_3_probability_heat", f"SELECT view_id, point_id, {rc('lat', d=9)}, {rc('lon', d=9)}, {rc('p_good')}, {rc('p_good_low')}, {rc('p_good_high')}, {rc('composite')} FROM grid_scores")
def _(t: Tables) -> DataFrame:
    return heat(t).select("view_id", "point_id", r6("lat", digits=9), r6("lon", digits=9), r6("p_good"), r6("p_good_low"), r6("p_good_high"), r6("composite"))


@query("agg_8_order_quantile", "SELECT amenity, " + ", ".join(
    f"{rc('(list_sort(list(p_retailprice)))[CAST(floor(' + repr(q) + 'e0 * (count(*) - 1)) AS BIGINT) + 1]', n)}" for n, q in (("q50", .5), ("q70", .7), ("q90", .9)))
    + " FROM (SELECT p_type AS amenity, p_retailprice FROM part) x GROUP BY amenity")
def _(t: Tables) -> DataFrame:
    src = t.part.select(F.col("p_type").alias("amenity"), "p_retailprice")
    return stats.order_quantiles(src, ["amenity"], "p_retailprice", {"q50": 0.5, "q70": 0.7, "q90": 0.9}).select(
        "amenity", r6("q50"), r6("q70"), r6("q90"))


@query("agg_9_lambda_reference", f"SELECT view_id, {rc('lambda_ref')} FROM lambda_refs")
def _(t: Tables) -> DataFrame:
    return field(t).calibration.select("view_id", r6("lambda_ref"))


_STAT_COLS = list(stats.VIEW_STATS.items())


@query("agg_10_view_stats", "SELECT view_id, count(*) AS sample_count, " + ", ".join(
    rc(f"(list_sort(list({c})))[CAST(floor({q}e0 * (count(*) - 1)) AS BIGINT) + 1]", n) for n, (c, q) in _STAT_COLS) + " FROM grid_scores GROUP BY view_id")
def _(t: Tables) -> DataFrame:
    return stats.view_stats(heat(t)).select("view_id", big("sample_count"), *[r6(n) for n, _ in _STAT_COLS])


@query("agg_24_mean_heat", f"SELECT view_id, {rc('avg(p_good)', 'mean_heat')} FROM grid_scores GROUP BY view_id")
def _(t: Tables) -> DataFrame:
    return heat(t).groupBy("view_id").agg(F.avg("p_good").alias("m")).select("view_id", r6("m", "mean_heat"))


# --- scorer ----------------------------------------------------------------

def _score_query(name: str, spark_cols, sql_cols: str) -> None:
    query(name, f"SELECT view_id, id, {sql_cols} FROM parking_scores")(lambda t: lots(t).select("view_id", "id", *spark_cols()))


_score_query("prj_8_demand_blend", lambda: [r6("merchant_demand"), r6("residential_demand"), r6("lambda_eff")],
             f"{rc('md', 'merchant_demand')}, {rc('rd', 'residential_demand')}, {rc('lambda_eff')}")
_score_query("prj_9_arrival_probability", lambda: ["prediction_model", r6("baseline_p_any"), r6("p_any")],
             f"model AS prediction_model, {rc('base_a', 'baseline_p_any')}, {rc('p_any')}")
_score_query("prj_10_quality", lambda: [r6("baseline_quality"), r6("quality"), r6("tip_proxy")], f"{rc('base_q', 'baseline_quality')}, {rc('quality')}, {rc('tip_proxy')}")
_score_query("prj_11_signals", lambda: [r6("signals.I", "sig_i"), r6("signals.M", "sig_m"), r6("signals.R", "sig_r"), r6("signals.D", "sig_d"), r6("composite")],
             f"{rc('sig_i')}, {rc('sig_m')}, {rc('sig_r')}, {rc('sig_d')}, {rc('composite')}")
_score_query("prj_12_p_good_band", lambda: [r6("p_good"), r6("p_good_low"), r6("p_good_high"), r6("p_any_low"), r6("p_any_high")],
             f"{rc('p_good')}, {rc('p_good_low')}, {rc('p_good_high')}, {rc('p_any_low')}, {rc('p_any_high')}")
_score_query("prj_13_stability_band", lambda: [r6("stability_low"), r6("stability_high"), r6("stability_width")],
             f"{rc('stability_low')}, {rc('stability_high')}, {rc('stability_width')}")
_score_query("prj_14_derived_outputs", lambda: [r6("merchant_share"), r6("residential_share"), r6("relative_intensity"), r6("rain_lift_percent"), r6("support_score"), big("expected_dist_m"), big("nearest_merchant_m")],
             f"{rc('mer_share', 'merchant_share')}, {rc('res_share', 'residential_share')}, {rc('lambda_eff / lambda_ref', 'relative_intensity')}, {rc('rain * 100', 'rain_lift_percent')}, {rc('sup', 'support_score')}, {rint('expected_dist')} AS expected_dist_m, {rint('nearest_dist')} AS nearest_merchant_m")
_score_query("prj_15_advisory", lambda: ["advisory"], "advisory")
_score_query("prj_16_explain", lambda: ["explain.merchant_share", "explain.residential_share", "explain.relative_intensity", "explain.rain_lift_percent"],
             f"CAST({rint(c01('mer_share') + ' * 100')} AS VARCHAR) || '% of this 10-minute probability comes from nearby merchants.' AS merchant_share, CAST({rint(c01('res_share') + ' * 100')} AS VARCHAR) || '% of this 10-minute probability comes from surrounding homes and apartments.' AS residential_share, "
             f"'This spot is running ' || CASE WHEN {rint('lambda_eff / lambda_ref * 100')} >= 125 THEN 'well above' WHEN {rint('lambda_eff / lambda_ref * 100')} >= 95 THEN 'near' ELSE 'below' END || ' the map''s reference intensity at about ' || CAST({rint('lambda_eff / lambda_ref * 100')} AS VARCHAR) || '% of baseline.' AS relative_intensity, "
             f"CASE WHEN {rint('rain * 100')} > 0 THEN 'Rain is adding about ' || CAST({rint('rain * 100')} AS VARCHAR) || '% lift to modeled demand right now.' ELSE 'Rain lift is off right now.' END AS rain_lift_percent")
_score_query("prj_17_full_score", lambda: [r6("p_good"), r6("p_any"), r6("quality"), r6("lambda_eff"), r6("lambda_ref"), r6("composite"), "advisory", big("nearby_merchants"), r6("effective_merchants"), "prediction_model", "time_bucket_name", r6("model_blend"), r6("model_confidence")],
             f"{rc('p_good')}, {rc('p_any')}, {rc('quality')}, {rc('lambda_eff')}, {rc('lambda_ref')}, {rc('composite')}, advisory, CAST(nearby_merchants AS BIGINT) AS nearby_merchants, {rc('effective_merchants')}, model AS prediction_model, bname AS time_bucket_name, "
             f"CASE WHEN model = 'glm' THEN {r('blend')} ELSE 1e0 END AS model_blend, CASE WHEN model = 'glm' THEN {r('conf')} ELSE 1e0 END AS model_confidence")


# Whole labels; the texts are fixed values.
_N = "CAST(CAST(floor(effective_merchants + 5e-1) AS BIGINT) AS VARCHAR)"
_PCT = lambda x: f"{rint(f'({x}) * 100')} || '%'"


@query("prj_21_score_labels", f"""SELECT view_id, id, CASE WHEN p_good >= 7.5e-1 THEN 'Excellent area — strong local demand support' WHEN p_good >= 5.8e-1 THEN 'Good area — solid nearby demand' WHEN p_good >= 4.2e-1 THEN 'Decent area — moderate demand support'
  WHEN p_good >= 2.5e-1 THEN 'Thin area — demand support is limited' ELSE 'Weak area — very little nearby demand support' END AS signal_label,
 '~' || {rint('expected_dist')} || 'm ' || CASE WHEN floor(expected_dist + 5e-1) <= 250 THEN 'to nearest merchant — very quick pickup' WHEN floor(expected_dist + 5e-1) <= 500 THEN 'avg pickup — short drive' WHEN floor(expected_dist + 5e-1) <= 900 THEN 'avg pickup — moderate drive' ELSE 'avg pickup — longer drive' END AS pickup_label,
 CASE WHEN mer_share >= 6.8e-1 THEN 'Merchant-led' WHEN res_share >= 4.2e-1 THEN 'Residential cushion' ELSE 'Balanced mix' END AS demand_mix,
 CASE WHEN mer_share >= 6.8e-1 THEN {_PCT('mer_share')} || ' of the field is coming from nearby restaurants right now.' WHEN res_share >= 4.2e-1 THEN {_PCT('res_share')} || ' of the field is home-driven, which usually smooths out spikes.'
  ELSE {_PCT('mer_share')} || ' merchant pull and ' || {_PCT('res_share')} || ' residential support are both contributing.' END AS demand_mix_detail,
 CASE WHEN sig_d >= 7e-1 THEN 'Heavy' WHEN sig_d >= 4.5e-1 THEN 'Moderate' ELSE 'Light' END AS crowding_label,
 CASE WHEN floor(effective_merchants + 5e-1) >= 6 AND stability_width <= 1.6e-1 THEN 'deep' WHEN floor(effective_merchants + 5e-1) >= 3 THEN 'enough' ELSE 'thin' END AS support_depth,
 CASE WHEN floor(effective_merchants + 5e-1) < 1.5 OR stability_width > 3.4e-1 THEN 'Shaky — only ~' || {_N} || ' merchant(s) contributing, score could swing a lot' WHEN floor(effective_merchants + 5e-1) < 3 OR stability_width > 2.4e-1 THEN 'Somewhat reliable — ~' || {_N} || ' merchants, but still limited'
  WHEN floor(effective_merchants + 5e-1) < 6 OR stability_width > 1.6e-1 THEN 'Fairly stable — ~' || {_N} || ' merchants backing this score' ELSE 'Very stable — ~' || {_N} || ' merchants, score is well-supported' END AS stability_label,
 CASE WHEN floor(effective_merchants + 5e-1) < 2 OR p_good_high - p_good_low >= 2.8e-1 THEN 'Wide range — limited support behind this estimate (about ' || {_N} || ' effective merchants).' WHEN floor(effective_merchants + 5e-1) < 4 OR p_good_high - p_good_low >= 1.8e-1 THEN 'Moderate range — the estimate has some support, but conditions can still move it.'
  ELSE 'Tighter range — the visible merchant field is giving a steadier estimate.' END AS band_label,
 {rint('p_good_low * 100')} || '% - ' || {rint('p_good_high * 100')} || '%' AS range_text FROM parking_scores""")
def _(t: Tables) -> DataFrame:
    return places.add_score_labels(lots(t)).select("view_id", "id", "signal_label", "pickup_label", "demand_mix", "demand_mix_detail", "crowding_label", "support_depth", "stability_label", "band_label", "range_text")


@query("prj_22_competition_pressure", f"SELECT view_id, id, {rc('p', 'pressure')}, CASE WHEN p >= 7.2e-1 THEN 'High' WHEN p >= 4.2e-1 THEN 'Moderate' ELSE 'Low' END AS label FROM (SELECT *, {c01('6.8e-1 * ' + c01('sig_d') + ' + 3.2e-1 * ' + c01('nearby_merchants / 8e0'))} AS p FROM parking_scores) x")
def _(t: Tables) -> DataFrame:
    df = lots(t).withColumn("p", places.competition_pressure(F.col("signals.D"), "nearby_merchants"))
    return df.select("view_id", "id", r6("p", "pressure"), places.pressure_label("p").alias("label"))


_SUIT = c01("4.6e-1 * {p} + 2.2e-1 * (1 - {d}) + 1.8e-1 * (1 - " + c01("{w} / 3.5e-1") + ") + 1.4e-1 * (1 - " + c01("{m} / 804e0") + ")")


@query("prj_23_parking_suitability", f"SELECT view_id, id, {rc(_SUIT.format(p='p_good', d='sig_d', w='stability_width', m='nearest_dist'), 'suitability')} FROM parking_scores")
def _(t: Tables) -> DataFrame:
    return lots(t).select("view_id", "id", r6(nearby.parking_suitability("p_good", F.col("signals.D"), "stability_width", "nearest_dist"), "suitability"))


# --- ranking ----------------------------------------------------------------

_RANKED = "SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY p_good DESC, ingest_ix) AS rank FROM parking_scores"


@query("srt_1_rank_parking", f"SELECT view_id, rank, id, {rc('p_good')} FROM ranked WHERE rank <= 12", {"ranked": _RANKED})
def _(t: Tables) -> DataFrame:
    return rank.rank_parking(lots(t)).select("view_id", big("rank"), "id", r6("p_good"))


@query("win_7_global_rank", f"SELECT id, view_id, {rc('p_good')} FROM parking_scores ORDER BY p_good DESC, ingest_ix LIMIT 12")
def _(t: Tables) -> DataFrame:
    return rank.rank_parking_overall(lots(t)).select("id", "view_id", r6("p_good"))


@query("srt_2_selection_order", "SELECT view_id, id, row_number() OVER (PARTITION BY view_id ORDER BY utility DESC, p_good DESC, ingest_ix) AS cand_rank FROM candidates")
def _(t: Tables) -> DataFrame:
    return rank.selection_order(lots(t)).select("view_id", "id", big("cand_rank"))


@query("win_3_top_merchants", f"""SELECT view_id, point_id, rank, id, {r('s')} AS score, {rint('d')} AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY view_id, point_id ORDER BY s DESC, ingest_ix) AS rank FROM
 (SELECT *, w * exp(-d / tau) AS s FROM (SELECT q.view_id, q.point_id, m.id, m.ingest_ix, v.tau, {dist('q.lat', 'q.lon', 'm.lat', 'm.lon')} AS d, CASE amenity WHEN 'fast_food' THEN 1.3e0 * CASE WHEN hour >= 22 OR hour <= 4 THEN 1.25e0 ELSE 1e0 END WHEN 'cafe' THEN 8e-1 * CASE WHEN hour >= 22 OR hour <= 4 THEN 6e-1 ELSE 1e0 END
 WHEN 'food_court' THEN 1.15e0 ELSE CASE WHEN hour >= 22 OR hour <= 4 THEN 8.5e-1 ELSE 1e0 END END AS w FROM parking_points q JOIN open_merchants m ON m.view_id = q.view_id JOIN clamped v ON v.view_id = q.view_id) a) b) c WHERE rank <= 6""")
def _(t: Tables) -> DataFrame:
    v, m, p, _h = field_inputs(t)
    pts = p.select("view_id", F.col("id").alias("point_id"), "lat", "lon")
    return rank.top_merchants(pts, m, v).select("view_id", "point_id", big("rank"), "id", r6("score"), big("distance_m"))


_PCT = "SELECT p.view_id, p.id, p.p_good, (SELECT count(*) FROM grid_scores g WHERE g.view_id = p.view_id AND g.p_good <= p.p_good) AS u, (SELECT count(*) FROM grid_scores g WHERE g.view_id = p.view_id) AS n FROM parking_scores p"


@query("win_4_percentile_in_view", f"SELECT view_id, id, {rint('1e2 * u / n')} AS percentile FROM pct", {"pct": _PCT})
def _(t: Tables) -> DataFrame:
    f = field(t)
    return stats.percentile_in_sample(lots(t).select("view_id", "id", "p_good"), heat(t).select("view_id", "p_good"),
                                      "view_id", "p_good", "p_good").select("view_id", "id", big("percentile"))


@query("win_4_self_percentile", f"SELECT p_partkey, {rint('1e2 * cume_dist() OVER (PARTITION BY p_type ORDER BY p_retailprice)')} AS percentile FROM part")
def _(t: Tables) -> DataFrame:
    df = stats.upper_rank(t.part.select("p_partkey", "p_type", "p_retailprice"), ["p_type"], "p_retailprice")
    return df.select("p_partkey", stats.percentile_of("upper_rank", "group_rows").alias("percentile"))


@query("prj_26_percentile_text", f"""SELECT view_id, id, CASE WHEN p >= 90 THEN 'Top ' || (100 - p) || '% — one of the best spots on the map' WHEN p >= 70 THEN 'Better than ' || p || '% of spots — above average' WHEN p >= 40 THEN 'Middle of the pack — ' || p || '% ranked lower' ELSE 'Bottom half — only ' || p || '% of spots score lower' END AS rank_text,
 CASE WHEN p >= 90 THEN 'Top ' || greatest(1, 100 - p) || '%' WHEN p >= 70 THEN 'Above avg' WHEN p >= 40 THEN 'Mid pack' ELSE 'Lower tier' END AS compact FROM (SELECT *, {rint('1e2 * u / n')} AS p FROM pct) x""", {"pct": _PCT})
def _(t: Tables) -> DataFrame:
    f = field(t)
    df = stats.percentile_in_sample(lots(t).select("view_id", "id", "p_good"), heat(t).select("view_id", "p_good"), "view_id", "p_good", "p_good")
    return df.select("view_id", "id", rank.percentile_text("percentile").alias("rank_text"), rank.compact_rank("percentile").alias("compact"))


# --- selection ----------------------------------------------------------------

@query("set_2_demand_nodes", f"SELECT view_id, id, source_type, {rc('weight')} FROM demand_nodes_s WHERE weight > 0")
def _(t: Tables) -> DataFrame:
    v, m, _p, h = field_inputs(t)
    return demand_nodes(m, h, v).select("view_id", "id", "source_type", r6("weight"))


@query("flt_7_positive_nodes", "SELECT view_id, source_type, count(*) AS n FROM demand_nodes_s WHERE weight > 0 GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    v, m, _p, h = field_inputs(t)
    return demand_nodes(m, h, v).groupBy("view_id", "source_type").agg(F.count(F.lit(1)).alias("n"))


@query("cov_1_selection_utility", f"SELECT view_id, id, {rc('utility')} FROM candidates")
def _(t: Tables) -> DataFrame:
    return lots(t).select("view_id", "id", r6(coverage.selection_utility("p_good", "stability_low"), "utility"))


@query("cov_2_coverage_objective", f"SELECT view_id, {rc('sum(b)', 'coverage')} FROM (SELECT view_id, node, source_type, max(cov) AS b FROM cover WHERE id IN (SELECT id FROM ranked WHERE rank <= 3) GROUP BY ALL) x GROUP BY view_id", {"ranked": _RANKED})
def _(t: Tables) -> DataFrame:
    f = field(t)
    top = rank.rank_parking(lots(t), 3).join(f.views.select("view_id", F.greatest(F.lit(300.0), F.col("tau")).alias("coverage_tau")), "view_id")
    return coverage.coverage_objective(top, demand_nodes(f.merchants, f.residential, f.views)).select("view_id", r6("coverage"))


query("agg_11_best_coverage_sum", f"SELECT view_id, {rc('sum(b)', 'coverage')} FROM (SELECT view_id, node, source_type, max(cov) AS b FROM cover GROUP BY ALL) x GROUP BY view_id")(
    lambda t: _coverage_of_all(t))


def _coverage_of_all(t: Tables) -> DataFrame:
    """Objective of selecting every lot: a pair aggregate, not an array."""
    from ..functions.geo import pair_distance_m, trig_columns
    from ..operators.blocks import block_join
    f = field(t)
    c = lots(t).join(f.views.select("view_id", F.greatest(F.lit(300.0), F.col("tau")).alias("ct")), "view_id").select(
        "view_id", F.col("id").alias("lot"), "ct", coverage.selection_utility("p_good", "stability_low").alias("u"), *trig_columns(prefix="c_"))
    n = demand_nodes(f.merchants, f.residential, f.views).select("view_id", "id", "source_type", "weight", *trig_columns(prefix="n_"))
    pairs = block_join(n, c, ["view_id"], ["id"], ["lot"])
    best = pairs.groupBy("view_id", "id", "source_type").agg(F.max(F.col("weight") * F.col("u") * F.exp(-pair_distance_m("n_", "c_") / F.col("ct"))).alias("b"))
    return best.groupBy("view_id").agg(F.sum("b").alias("c")).select("view_id", r6("c", "coverage"))


@query("join_4_coverage_matrix", f"SELECT view_id, id, {rc('sum(cov)', 'solo_coverage')}, {rc('max(cov)', 'best_coverage')}, count(*) AS nodes FROM cover GROUP BY view_id, id")
def _(t: Tables) -> DataFrame:
    from ..functions.geo import pair_distance_m, trig_columns
    from ..operators.blocks import block_join
    f = field(t)
    c = lots(t).join(f.views.select("view_id", F.greatest(F.lit(300.0), F.col("tau")).alias("ct")), "view_id").select(
        "view_id", "id", "ct", coverage.selection_utility("p_good", "stability_low").alias("u"), *trig_columns(prefix="c_")).where(F.col("u") > 0)
    n = demand_nodes(f.merchants, f.residential, f.views).select("view_id", F.col("id").alias("node"), "weight", *trig_columns(prefix="n_"))
    cov = F.col("weight") * F.col("u") * F.exp(-pair_distance_m("c_", "n_") / F.col("ct"))
    return block_join(c, n, ["view_id"], ["id"], ["node"]).groupBy("view_id", "id").agg(
        F.sum(cov).alias("s"), F.max(cov).alias("m"), F.count(F.lit(1)).alias("nodes")).select(
        "view_id", "id", r6("s", "solo_coverage"), r6("m", "best_coverage"), "nodes")


@query("cov_3_greedy_spots", f"SELECT view_id, CAST(pick AS BIGINT) AS pick, id, {rc('utility', 'selection_utility')}, {rc('gain', 'marginal_gain')} FROM picks")
def _(t: Tables) -> DataFrame:
    f = field(t)
    return pick_spots(f, lots(t), 3).select("view_id", big("pick"), "id", r6("selection_utility"), r6("marginal_gain"))


@query("cov_4_shortcuts", "SELECT view_id, id, row_number() OVER (PARTITION BY view_id ORDER BY utility DESC, p_good DESC, ingest_ix) AS pick FROM candidates WHERE true QUALIFY pick <= 4")
def _(t: Tables) -> DataFrame:
    """Without demand nodes the K best candidates are taken as they stand."""
    f = field(t)
    cand = lots(t).join(f.views.select("view_id", "coverage_tau"), "view_id")
    none = demand_nodes(f.merchants, f.residential, f.views).where(F.col("weight") < 0)
    return coverage.select_spots(cand, none, 4).select("view_id", "id", big("pick"))


@query("set_4_fill_up", "SELECT view_id, id, row_number() OVER (PARTITION BY view_id ORDER BY utility DESC, p_good DESC, ingest_ix) AS pick FROM candidates")
def _(t: Tables) -> DataFrame:
    """K above the candidate count: every candidate, in candidate order."""
    f = field(t)
    cand = lots(t).join(f.views.select("view_id", "coverage_tau"), "view_id")
    nodes = demand_nodes(f.merchants, f.residential, f.views)
    return coverage.select_spots(cand, nodes, 25).select("view_id", "id", big("pick"))


@query("agg_14_selection_utility", f"SELECT view_id, {rc('sum(p_good)', 'utility_sum')} FROM picks GROUP BY view_id")
def _(t: Tables) -> DataFrame:
    f = field(t)
    return audit.selection_utility_sum(pick_spots(f, lots(t), 3)).select("view_id", r6("utility_sum"))


# --- audit ------------------------------------------------------------------

_GLM = {"glm_views": "SELECT * REPLACE ('glm' AS prediction_model) FROM clamped", "legacy_views": "SELECT * REPLACE ('legacy' AS prediction_model) FROM clamped",
        "glm_demand": demand("parking_features", "glm_views"), "legacy_demand": demand("parking_features", "legacy_views"),
        "glm_scores": score("glm_demand", "lambda_refs"), "legacy_scores": score("legacy_demand", "lambda_refs"),
        "glm_ranked": "SELECT s.view_id, p.id, s.p_good, s.l_any, s.l_quality, s.raw_a, s.raw_q, s.cal_a, s.cal_q, s.conf, s.blend, s.mass, s.sup_scale, row_number() OVER (PARTITION BY s.view_id ORDER BY s.p_good DESC, p.ingest_ix) AS rank FROM glm_scores s JOIN boxed_parking p ON p.view_id = s.view_id AND p.id = s.point_id",
        "legacy_ranked": "SELECT s.view_id, p.id, s.p_good, row_number() OVER (PARTITION BY s.view_id ORDER BY s.p_good DESC, p.ingest_ix) AS rank FROM legacy_scores s JOIN boxed_parking p ON p.view_id = s.view_id AND p.id = s.point_id"}


def both_models(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Legacy and learned scores of all lots from one kernel aggregate."""
    from ..operators.score import score_points
    f = field(t)
    pts = f.parking.select("view_id", F.col("id").alias("point_id"), "lat", "lon")
    feats = stage(kernel.kernel_features(pts, stage(kernel.weighted_places(f.merchants, f.parking, f.residential, f.views), "places")), "features")
    info = f.parking.select("view_id", F.col("id").alias("point_id"), "ingest_ix")

    def one(model: str) -> DataFrame:
        s = score_points(feats, f.views.withColumn("prediction_model", F.lit(model)), f.calibration)
        return s.join(info, ["view_id", "point_id"]).withColumnRenamed("point_id", "id")

    return one("legacy"), one("glm")


_AUDIT_SQL = f"""SELECT l.view_id, string_agg(l.id, ',' ORDER BY l.rank) FILTER (l.rank <= 5) AS active_top_ids, string_agg(g.id, ',' ORDER BY l.rank) FILTER (l.rank <= 5) AS shadow_top_ids,
 {rc('sum(abs(l.p_good - g.p_good)) / count(*)', 'mean_abs_top_delta')} FROM legacy_ranked l JOIN glm_ranked g ON g.view_id = l.view_id AND g.rank = l.rank WHERE l.rank <= 10 GROUP BY l.view_id"""


def _audit(t: Tables) -> DataFrame:
    a = audit.shadow_audit(*both_models(t))
    return a.select("view_id", F.array_join("active_top_ids", ",").alias("active_top_ids"), F.array_join("shadow_top_ids", ",").alias("shadow_top_ids"), r6("mean_abs_top_delta"))


query("agg_13_shadow_audit", _AUDIT_SQL, _GLM)(_audit)
query("ml_7_shadow_comparison", _AUDIT_SQL, _GLM)(_audit)


@query("join_17_rank_to_rank", f"SELECT l.view_id, l.rank, l.id AS active_id, g.id AS shadow_id, {rc('abs(l.p_good - g.p_good)', 'delta')} FROM legacy_ranked l JOIN glm_ranked g ON g.view_id = l.view_id AND g.rank = l.rank WHERE l.rank <= 10", _GLM)
def _(t: Tables) -> DataFrame:
    legacy, glm = both_models(t)
    a, g = rank.rank_parking(legacy, 10), rank.rank_parking(glm, 10)
    return a.select("view_id", "rank", F.col("id").alias("active_id"), F.col("p_good").alias("a")).join(
        g.select("view_id", "rank", F.col("id").alias("shadow_id"), F.col("p_good").alias("g")), ["view_id", "rank"]).select(
        "view_id", big("rank"), "active_id", "shadow_id", r6(F.abs(F.col("a") - F.col("g")), "delta"))


@query("ml_2_learned_score", f"SELECT view_id, id, {rc('p_good')}, {rc('l_any', 'p_any')}, {rc('l_quality', 'quality')}, {rc('conf', 'model_confidence')}, {rc('blend', 'model_blend')} FROM glm_ranked", _GLM)
def _(t: Tables) -> DataFrame:
    return both_models(t)[1].select("view_id", "id", r6("p_good"), r6("p_any"), r6("quality"), r6("model_confidence"), r6("model_blend"))


@query("agg_23_load_summary", f"""SELECT v.view_id, (SELECT count(*) FROM open_merchants m WHERE m.view_id = v.view_id) AS merchants_count, (SELECT count(*) FROM boxed_parking m WHERE m.view_id = v.view_id) AS parking_count,
 (SELECT count(*) FROM boxed_homes m WHERE m.view_id = v.view_id) AS residential_count, b.id AS best_id, {rint('b.p_good_low * 100')} || '% - ' || {rint('b.p_good_high * 100')} || '%' AS best_range,
 {rint('s.ml * 100')} || '% - ' || {rint('s.mh * 100')} || '%' AS typical_range, {rint('s.tl * 100')} || '% - ' || {rint('s.th * 100')} || '%' AS hot_range
FROM clamped v LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) b ON b.view_id = v.view_id LEFT JOIN (SELECT view_id, """ + ", ".join(
    f"(list_sort(list({c})))[CAST(floor({q}e0 * (count(*) - 1)) AS BIGINT) + 1] AS {n}" for n, c, q in (("ml", "p_good_low", .5), ("mh", "p_good_high", .5), ("tl", "p_good_low", .9), ("th", "p_good_high", .9)))
    + " FROM grid_scores GROUP BY view_id) s ON s.view_id = v.view_id", {"ranked": _RANKED})
def _(t: Tables) -> DataFrame:
    f = field(t)
    counts = audit.load_counts(f.merchants, f.parking, f.residential, f.residential.where(F.col("place_weight").isNotNull()))
    return audit.load_summary(counts, lots(t), stats.view_stats(heat(t))).select(
        "view_id", "merchants_count", "parking_count", "residential_count", "best_id", "best_range", "typical_range", "hot_range")


# --- nearby ------------------------------------------------------------------

_NEAR = f"SELECT m.view_id, m.point_id, p.id AS lot_id, p.name AS lot_name, p.lat AS lot_lat, p.lon AS lot_lon, p.p_good AS lot_p, p.sig_d AS lot_d, p.stability_width AS lot_w, p.ingest_ix, p.rank, m.p_good AS here_p, m.lat, m.lon, {rint(dist('m.lat', 'm.lon', 'p.lat', 'p.lon'))} AS distance_m FROM merchant_scores m JOIN ranked p ON p.view_id = m.view_id"
_NEAR_STEPS = {"ranked": _RANKED, "near_lots": _NEAR,
               "nearest": "SELECT * FROM near_lots WHERE distance_m <= 480 QUALIFY row_number() OVER (PARTITION BY view_id, point_id ORDER BY distance_m, rank) = 1"}


def _ranked_lots(t: Tables) -> DataFrame:
    s = lots(t)
    return rank.top_per_group(s, ["view_id"], [F.desc("p_good"), F.asc("ingest_ix")], 2_147_483_647, "place_rank")


@query("join_7_nearest_parking", "SELECT view_id, point_id, lot_id, distance_m FROM nearest", _NEAR_STEPS)
def _(t: Tables) -> DataFrame:
    f = field(t)
    pts = f.merchants.select("view_id", F.col("id").alias("point_id"), "lat", "lon")
    return nearby.nearest_parking(pts, _ranked_lots(t)).select("view_id", "point_id", "lot_id", big("distance_m"))


@query("win_1_top1_per_anchor", "SELECT view_id, point_id, lot_id FROM near_lots WHERE distance_m <= 480 QUALIFY row_number() OVER (PARTITION BY view_id, point_id ORDER BY distance_m, rank) = 1", _NEAR_STEPS)
def _(t: Tables) -> DataFrame:
    f = field(t)
    pts = f.merchants.select("view_id", F.col("id").alias("point_id"), "lat", "lon")
    pl = _ranked_lots(t).select("view_id", F.col("id").alias("lot_id"), "lat", "lon", "place_rank")
    pairs = nearby.cell_pairs(pts, pl, 480.0).withColumn("distance_m", F.floor(F.col("distance_m") + 0.5)).where(F.col("distance_m") <= 480)
    return rank.top_per_group(pairs, ["view_id", "point_id"], [F.asc("distance_m"), F.asc("place_rank")], 1).select("view_id", "point_id", "lot_id")


@query("join_9_best_parking", f"SELECT view_id, point_id, lot_id, distance_m, {rc('lot_p', 'lot_p_good')} FROM near_lots WHERE distance_m <= 550 QUALIFY row_number() OVER (PARTITION BY view_id, point_id ORDER BY lot_p DESC, distance_m, ingest_ix) = 1", _NEAR_STEPS)
def _(t: Tables) -> DataFrame:
    f = field(t)
    pts = f.merchants.select("view_id", F.col("id").alias("point_id"), "lat", "lon")
    return nearby.best_parking(pts, lots(t)).select("view_id", "point_id", "lot_id", big("distance_m"), r6("lot_p_good"))


def _ring_sql(lo: int, hi: int, k: int, raw: bool = False) -> str:
    suit = _SUIT.format(p="lot_p", d="lot_d", w="lot_w", m="distance_m")
    return f"""SELECT view_id, point_id, rank, lot_id, distance_m, {'suit AS suitability, delta AS probability_delta' if raw else rc('suit', 'suitability') + ', ' + rc('delta', 'probability_delta')}, direction FROM (SELECT *, row_number() OVER (PARTITION BY view_id, point_id ORDER BY suit DESC, delta DESC, ingest_ix) AS rank FROM
 (SELECT view_id, point_id, lot_id, distance_m, ingest_ix, {suit} AS suit, lot_p - here_p AS delta, {octant('lat', 'lon', 'lot_lat', 'lot_lon')} AS direction FROM near_lots WHERE distance_m BETWEEN {lo} AND {hi}) x) y WHERE rank <= {k}"""


def _ring(lo: float, hi: float, k: int):
    return lambda t: nearby.parking_in_ring(scored_merchants(t), lots(t), lo, hi, k).select(
        "view_id", "point_id", big("rank"), "lot_id", big("distance_m"), r6("suitability"), r6("probability_delta"), "direction")


query("join_10_staging_ring", _ring_sql(322, 804, 3), _NEAR_STEPS)(_ring(322.0, 804.0, 3))
query("join_10_short_move_ring", _ring_sql(90, 321, 3), _NEAR_STEPS)(_ring(90.0, 321.0, 3))
query("win_2_topk_per_anchor", _ring_sql(90, 804, 2), _NEAR_STEPS)(_ring(90.0, 804.0, 2))

_FRICTION = f"""SELECT m.view_id, m.point_id, m.p_good, m.p_good_low, m.p_good_high, m.sig_d, m.nearby_merchants, n.distance_m AS near_m, n.lot_id AS near_lot_id, n.lot_lat AS near_lat, n.lot_lon AS near_lon, {c01("4.6e-1 * " + c01("(floor(m.expected_dist + 5e-1) - 120) / 700") + " + 3.2e-1 * m.sig_d + 2.2e-1 * CASE WHEN n.distance_m IS NULL THEN 1e0 ELSE " + c01("n.distance_m / 360e0")
 + " END - CASE WHEN m.drive_through = 'yes' THEN 1.8e-1 ELSE 0e0 END - CASE WHEN m.takeaway IN ('yes', 'only') THEN 1.2e-1 ELSE 0e0 END - CASE WHEN m.delivery IN ('yes', 'only') THEN 8e-2 ELSE 0e0 END")} AS friction FROM merchant_scores m LEFT JOIN nearest n ON n.view_id = m.view_id AND n.point_id = m.point_id"""


@query("prj_24_pickup_friction", f"SELECT view_id, point_id, {rc('friction')}, CASE WHEN friction >= 7.2e-1 THEN 'High friction' WHEN friction >= 5e-1 THEN 'Sticky' WHEN friction >= 2.8e-1 THEN 'Manageable' ELSE 'Easy' END AS friction_label, {rint('friction * 100')} || '/100' AS friction_value FROM fr", {**_NEAR_STEPS, "fr": _FRICTION})
def _(t: Tables) -> DataFrame:
    s = scored_merchants(t)
    near = nearby.nearest_parking(s.select("view_id", "point_id", "lat", "lon"), _ranked_lots(t))
    return places.pickup_friction(s, near).select("view_id", "point_id", r6("friction"), "friction_label", "friction_value")


@query("join_11_first_merchant_at", f"SELECT q.view_id, q.point_id, arg_min(m.id, m.ingest_ix) AS merchant_id FROM routes_v q JOIN merchants_v m ON m.view_id = q.view_id AND {dist('q.lat', 'q.lon', 'm.lat', 'm.lon')} <= 40 GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return nearby.first_merchant_at(t.routes, t.merchants)


@query("grd_4_point_query", f"SELECT view_id, point_id, {rc('p_good')}, {rc('p_good_low')}, {rc('p_good_high')} FROM merchant_scores")
def _(t: Tables) -> DataFrame:
    return scored_merchants(t).select("view_id", "point_id", r6("p_good"), r6("p_good_low"), r6("p_good_high"))


@query("grd_5_place_state", f"""SELECT s.view_id, s.point_id, coalesce(nullif(s.name, ''), 'Food place') AS title, {rc('s.p_good')}, top.ids AS likely_ids FROM merchant_scores s JOIN
 (SELECT view_id, point_id, string_agg(id, ',' ORDER BY rank) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY view_id, point_id ORDER BY w * exp(-d / tau) DESC, ingest_ix) AS rank FROM
 (SELECT q.view_id, q.point_id, m.id, m.ingest_ix, v.tau, {dist('q.lat', 'q.lon', 'm.lat', 'm.lon')} AS d, CASE amenity WHEN 'fast_food' THEN 1.3e0 * CASE WHEN hour >= 22 OR hour <= 4 THEN 1.25e0 ELSE 1e0 END WHEN 'cafe' THEN 8e-1 * CASE WHEN hour >= 22 OR hour <= 4 THEN 6e-1 ELSE 1e0 END
 WHEN 'food_court' THEN 1.15e0 ELSE CASE WHEN hour >= 22 OR hour <= 4 THEN 8.5e-1 ELSE 1e0 END END AS w FROM merchant_points q JOIN open_merchants m ON m.view_id = q.view_id JOIN clamped v ON v.view_id = q.view_id) a) b WHERE rank <= 12 GROUP BY ALL) top ON top.view_id = s.view_id AND top.point_id = s.point_id""")
def _(t: Tables) -> DataFrame:
    f = field(t)
    pts = f.merchants.select("view_id", F.col("id").alias("point_id"), "lat", "lon")
    top = rank.top_merchants(pts, f.merchants, f.views, 12).groupBy("view_id", "point_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("likely"))
    attrs = places.place_attributes(f.merchants).withColumnRenamed("id", "point_id")
    s = scored_merchants(t).join(attrs, ["view_id", "point_id"]).join(top, ["view_id", "point_id"])
    return s.select("view_id", "point_id", "title", r6("p_good"), F.array_join(F.transform("likely", lambda x: x["id"]), ",").alias("likely_ids"))


@query("prj_28_place_comparison", f"""SELECT view_id, point_id, b_id AS b_point_id, CASE WHEN abs(mins) >= 2 THEN 'drive' WHEN pts < 4 AND abs(gap) >= 120 THEN 'pickup' WHEN pts < 4 THEN 'tie' ELSE 'score' END AS decided_by, p_good >= b_p AS current_leads,
 CASE WHEN abs(mins) >= 2 THEN CASE WHEN mins < 0 THEN title ELSE b_title END || ' is about ' || CAST(abs(mins) AS VARCHAR) || ' min faster to drive than ' || CASE WHEN mins < 0 THEN b_title ELSE title END || ' from your current position.'
  WHEN pts < 4 AND abs(gap) >= 120 THEN title || ' and ' || b_title || ' are close on raw score. ' || CASE WHEN gap > 0 THEN title ELSE b_title END || ' has the quicker pickup field right now.'
  WHEN pts < 4 THEN title || ' and ' || b_title || ' are close on raw field score. Use pickup speed and route convenience to break the tie.'
  ELSE CASE WHEN p_good > b_p THEN title ELSE b_title END || ' projects about ' || CAST(pts AS VARCHAR) || ' points stronger than ' || CASE WHEN p_good > b_p THEN b_title ELSE title END || ' on the current 10-minute field.' END AS summary FROM
 (SELECT m.view_id, m.point_id, m.p_good, b.point_id AS b_id, b.p_good AS b_p, coalesce(m.name, 'Food place') AS title, coalesce(b.name, 'Food place') AS b_title, {rint('(m.ds - b.ds) / 60')} AS mins, {rint('abs(m.p_good - b.p_good) * 100')} AS pts, floor(b.expected_dist + 5e-1) - floor(m.expected_dist + 5e-1) AS gap FROM ds m JOIN (SELECT * FROM ds QUALIFY row_number() OVER (PARTITION BY view_id ORDER BY ingest_ix) = 1) b ON b.view_id = m.view_id WHERE m.point_id <> b.point_id) x""",
       {"ds": "SELECT *, CASE WHEN ingest_ix % 2 = 0 THEN 3e2 + (ingest_ix % 9) * 5e1 END AS ds FROM merchant_scores"})
def _(t: Tables) -> DataFrame:
    s = scored_merchants(t).withColumn("title", F.coalesce("name", F.lit("Food place"))).withColumn(
        "drive_seconds", F.when(F.col("ingest_ix") % 2 == 0, 300.0 + (F.col("ingest_ix") % 9) * 50.0))
    base = s.groupBy("view_id").agg(F.min_by(F.struct("point_id", "title", "p_good", "expected_dist_m", "drive_seconds"), "ingest_ix").alias("b")).select("view_id", "b.*")
    return places.compare_places(s, base).select("view_id", "point_id", "b_point_id", "decided_by", "current_leads", "summary")
