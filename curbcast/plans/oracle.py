"""Plain-SQL restatements used to check results in another engine.

``compose(body)`` puts the named steps a query mentions in front of it.
"""
from __future__ import annotations

from ..operators.features import HIGH_TICKET, LOW_TICKET, MID_TICKET
from ..operators.learned import (ARRIVAL_CALIBRATOR, ARRIVAL_WEIGHTS, QUALITY_CALIBRATOR, QUALITY_WEIGHTS)
from .tables import TABLES, depends_on


def r(x: str, d: int = 6) -> str:
    return f"(floor(({x}) * 1e{d} + 5e-1) / 1e{d})"


def rc(x: str, name: str | None = None, d: int = 6) -> str:
    return f"{r(x, d)} AS {name or x.split('.')[-1]}"


def dist(a: str, b: str, c: str, d: str) -> str:
    return (f"(2 * 6371000e0 * asin(least(1e0, sqrt(pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c}))"
            f" * pow(sin(radians(({d}) - ({b})) / 2), 2)))))")


def rint(x: str) -> str:
    return f"CAST(floor(({x}) + 5e-1) AS BIGINT)"


def c01(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"


def sig(x: str) -> str:
    return f"(1e0 / (1e0 + exp(-({x}))))"


def pmod(x: str, m: str = "360") -> str:
    return f"((({x}) % {m} + {m}) % {m})"


def heading(a: str, b: str, c: str, d: str) -> str:
    """Bearing of the move (a, b) -> (c, d)."""
    y = f"sin(radians(({d}) - ({b}))) * cos(radians({c}))"
    x = f"cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians(({d}) - ({b})))"
    return pmod(f"degrees(atan2({y}, {x}))")


def octant(a: str, b: str, c: str, d: str) -> str:
    ang = pmod(f"degrees(atan2((({d}) - ({b})) * cos(radians((({a}) + ({c})) / 2)), ({c}) - ({a}))) + 360")
    return (f"(['north','northeast','east','southeast','south','southwest','west','northwest'])"
            f"[CAST(floor({ang} / 45 + 5e-1) AS BIGINT) % 8 + 1]")


def merchant_weight(amenity: str = "amenity", hour: str = "hour") -> str:
    late = f"({hour} >= 22 OR {hour} <= 4)"
    return (f"(CASE {amenity} WHEN 'fast_food' THEN 1.3e0 * CASE WHEN {late} THEN 1.25e0 ELSE 1e0 END WHEN 'cafe' THEN 8e-1 * CASE WHEN {late} THEN 6e-1 ELSE 1e0 END"
            f" WHEN 'food_court' THEN 1.15e0 WHEN 'restaurant' THEN CASE WHEN {late} THEN 8.5e-1 ELSE 1e0 END ELSE 1e0 END)")


def home_weight() -> str:
    we = "(dow = 0 OR dow = 6)"
    return (f"((CASE WHEN try_cast(place_weight AS DOUBLE) > 0 THEN try_cast(place_weight AS DOUBLE) WHEN building = 'apartments' THEN 1.4e0 WHEN building = 'dormitory' THEN 1.3e0"
            f" WHEN building = 'residential' THEN 1e0 WHEN building IN ('terrace', 'semidetached_house') THEN 8.5e-1 WHEN building IN ('house', 'detached') THEN 6.5e-1 WHEN landuse = 'residential' THEN 9e-1 ELSE 7.5e-1 END)"
            f" * (CASE WHEN hour >= 17 AND hour < 22 THEN CASE WHEN {we} THEN 1.18e0 ELSE 1.1e0 END WHEN hour >= 11 AND hour < 14 THEN CASE WHEN {we} THEN 9.5e-1 ELSE 8.5e-1 END"
            f" WHEN hour >= 22 OR hour < 5 THEN CASE WHEN {we} THEN 1.05e0 ELSE 9.2e-1 END ELSE 1e0 END))")


def ticket() -> str:
    def tier(words):
        names = " OR ".join(f"contains(lower(coalesce(name, '')), '{w.replace('_', ' ')}')" for w in words)
        listed = ", ".join(f"'{w}'" for w in words)
        return f"(len(list_filter([trim(x) FOR x IN string_split(lower(coalesce(cuisine, '')), ';')], lambda y: y IN ({listed}))) > 0 OR {names})"
    return (f"greatest(5e-1, least(1.3e0, CASE amenity WHEN 'restaurant' THEN 1e0 WHEN 'food_court' THEN 9.5e-1 WHEN 'cafe' THEN 8.5e-1 WHEN 'fast_food' THEN 7.5e-1 ELSE 9e-1 END"
            f" + CASE WHEN {tier(HIGH_TICKET)} THEN 1.8e-1 WHEN {tier(MID_TICKET)} THEN 6e-2 WHEN {tier(LOW_TICKET)} THEN -8e-2 ELSE 0e0 END))")


def profile(which: str) -> str:
    we = "(dow = 0 OR dow = 6)"
    if which == "m":
        return (f"(CASE WHEN hour < 6 THEN 7.2e-1 WHEN hour < 11 THEN 7.5e-1 WHEN hour < 14 THEN CASE WHEN {we} THEN 1.05e0 ELSE 1.15e0 END WHEN hour < 17 THEN 8.2e-1"
                f" WHEN hour < 20 THEN CASE WHEN {we} THEN 1.22e0 ELSE 1.15e0 END WHEN hour < 22 THEN CASE WHEN {we} THEN 1.08e0 ELSE 9.8e-1 END ELSE 8.2e-1 END)")
    return (f"(CASE WHEN hour < 6 THEN CASE WHEN {we} THEN 9.5e-1 ELSE 8.8e-1 END WHEN hour < 11 THEN CASE WHEN {we} THEN 8.5e-1 ELSE 8e-1 END WHEN hour < 14 THEN CASE WHEN {we} THEN 8e-1 ELSE 7.2e-1 END"
            f" WHEN hour < 17 THEN CASE WHEN {we} THEN 9e-1 ELSE 7.8e-1 END WHEN hour < 20 THEN CASE WHEN {we} THEN 1.22e0 ELSE 1.08e0 END WHEN hour < 22 THEN CASE WHEN {we} THEN 1.15e0 ELSE 1.02e0 END"
            f" ELSE CASE WHEN {we} THEN 1.05e0 ELSE 9.5e-1 END END)")


def bucket(h: str = "hour") -> str:
    return (f"(CASE WHEN {h} < 6 THEN {{'n': 'post_midnight', 'l': 'Post-midnight', 'i': 1.5e-1, 'm': 1.5e-1, 'r': 5e-1, 'd': 2e-1}} WHEN {h} < 11 THEN {{'n': 'morning', 'l': 'Morning', 'i': 2e-1, 'm': 4e-1, 'r': 3e-1, 'd': 1e-1}}"
            f" WHEN {h} < 14 THEN {{'n': 'lunch', 'l': 'Lunch rush', 'i': 2.5e-1, 'm': 3.5e-1, 'r': 2.5e-1, 'd': 1.5e-1}} WHEN {h} < 17 THEN {{'n': 'afternoon', 'l': 'Afternoon', 'i': 2.5e-1, 'm': 3e-1, 'r': 2.5e-1, 'd': 2e-1}}"
            f" WHEN {h} < 20 THEN {{'n': 'dinner', 'l': 'Dinner rush', 'i': 3e-1, 'm': 3e-1, 'r': 2e-1, 'd': 2e-1}} WHEN {h} < 22 THEN {{'n': 'late_dinner', 'l': 'Late dinner', 'i': 3e-1, 'm': 2.5e-1, 'r': 2.5e-1, 'd': 2e-1}}"
            f" ELSE {{'n': 'late_night', 'l': 'Late night', 'i': 2e-1, 'm': 2e-1, 'r': 4e-1, 'd': 2e-1}} END)")


def kernel(points: str, merchants: str, parking: str, homes: str, views: str, grid: bool = False) -> str:
    """Kernel aggregates of ``points`` (view_id, point_id, lat, lon)."""
    ptau = "greatest(1e2, floor(tau * 8e-1 + 5e-1))" if grid else "greatest(1e2, greatest(2.5e2, least(1.2e3, floor(tau * 8e-1 + 5e-1))))"
    d = dist("q.lat", "q.lon", "s.lat", "s.lon")
    by = ", ".join(f"coalesce(sum(CASE WHEN amenity = '{a}' THEN w * k END), 0) AS by_{a}" for a in ("restaurant", "fast_food", "cafe", "food_court"))
    return f"""SELECT q.view_id, q.point_id, q.lat, q.lon, coalesce(m.total, 0) AS merchant_intensity, coalesce(m.cd / m.total, 1e9) AS expected_dist,
  coalesce(m.ct / m.total, 0) AS ticket_mean, coalesce(m.total * m.total / m.cc, 0) AS effective_merchants, coalesce(m.near, 1e9) AS nearest_dist, coalesce(m.n_near, 0) AS nearby_merchants,
  coalesce(by_restaurant, 0) AS by_restaurant, coalesce(by_fast_food, 0) AS by_fast_food, coalesce(by_cafe, 0) AS by_cafe, coalesce(by_food_court, 0) AS by_food_court,
  coalesce(p.ps, 0) AS parking_sum, coalesce(h.rs, 0) AS residential_sum FROM {points} q
LEFT JOIN (SELECT view_id, point_id, sum(w * k) AS total, sum(w * k * d) AS cd, sum(w * k * t) AS ct, sum(w * k * w * k) AS cc, min(d) AS near, count(*) FILTER (d <= tau * 1.25e0) AS n_near, {by}
  FROM (SELECT *, exp(-d / tau) AS k FROM (SELECT q.view_id, q.point_id, {d} AS d, {merchant_weight('s.amenity', 'v.hour')} AS w, s.t, s.amenity, v.tau
    FROM {points} q JOIN (SELECT *, {ticket()} AS t FROM {merchants}) s ON s.view_id = q.view_id JOIN {views} v ON v.view_id = q.view_id) x) y GROUP BY ALL) m ON m.view_id = q.view_id AND m.point_id = q.point_id
LEFT JOIN (SELECT q.view_id, q.point_id, sum(exp(-{d} / {ptau})) AS ps FROM {points} q JOIN {parking} s ON s.view_id = q.view_id JOIN {views} v ON v.view_id = q.view_id GROUP BY ALL) p ON p.view_id = q.view_id AND p.point_id = q.point_id
LEFT JOIN (SELECT q.view_id, q.point_id, sum(s.w * exp(-{d} / greatest(4e2, tau * 1.6e0))) AS rs FROM {points} q JOIN (SELECT h.*, {home_weight()} AS w FROM {homes} h JOIN {views} v ON v.view_id = h.view_id) s ON s.view_id = q.view_id JOIN {views} v ON v.view_id = q.view_id GROUP BY ALL) h ON h.view_id = q.view_id AND h.point_id = q.point_id"""


def demand(features: str, views: str) -> str:
    return f"""SELECT *, (md + rd) / (1 + comp * parking_sum) AS lambda_eff FROM (SELECT f.*, v.hour, v.dow, v.tip_emphasis, v.ml_beta, v.competition_strength AS comp, v.prediction_model AS model, least(2.5e-1, greatest(0e0, v.rain_boost)) AS rain,
  (1 + v.rain_boost) * {profile('m')} * merchant_intensity AS md, (1 + v.rain_boost * 1.35e0) * v.residential_weight * {profile('r')} * residential_sum AS rd FROM {features} f JOIN {views} v ON v.view_id = f.view_id) x"""


def arrival(lam: str) -> str:
    ratio = f"({lam}) / lambda_ref"
    lin = f"(ln(exp(ln(2e0) / 10) - 1) + ml_beta * ln(greatest(1e-9, {lam}) / lambda_ref))"
    return (f"{c01(f'CASE WHEN model = {chr(39)}softplus{chr(39)} THEN 1 - exp(-(rain_mult * ln(1 + exp({lin}))) * 10) ELSE 1 - exp(-rain_mult * (ln(2e0) / 10) * ({ratio}) * 10) END')}")


def learned_sql(src: str) -> str:
    """Adds cal_a, cal_q, conf, mass, blend, l_any, l_quality, raw_a, raw_q to rows with sig_*, sup,
    res_share, horizon, bname, weekend, base_a, base_q."""
    feats = {"merchant_signal": "sig_m", "proximity_signal": "sig_r", "competition_signal": "sig_d", "income_signal": "sig_i",
             "support_score": "sup", "residential_share": "res_share", "horizon_log": "ln(1 + greatest(1e0, horizon) / 10)",
             "demand_x_proximity": "sig_m * sig_r", "demand_x_support": "sig_m * sup", "competition_x_demand": "sig_m * sig_d",
             "income_x_proximity": "sig_i * sig_r", "weekend": "weekend"}
    flag = {b: f"(CASE WHEN bname = '{b}' THEN 1e0 ELSE 0e0 END)" for b in ("lunch", "dinner", "late_dinner", "late_night", "post_midnight")}

    def score(w, quality=False):
        out = [repr(w["intercept"])]
        for k, x in w.items():
            if k == "intercept":
                continue
            if k in flag:
                f = flag[k]
                if quality and k == "late_night":
                    f = f"({flag['late_night']} + {flag['post_midnight']})"
                if quality and k == "dinner":
                    f = f"({flag['dinner']} + {flag['late_dinner']})"
            elif k == "weekend_dinner":
                f = f"weekend * {flag['dinner']}"
            else:
                f = feats[k]
            out.append(f"({x!r}) * ({f})")
        return " + ".join(out)

    def cal(p, c):
        q = f"greatest(1e-6, least(1 - 1e-6, {p}))"
        return sig(f"({c[0]!r}) * ln({q}) + ({c[1]!r}) * ln(1 - {q}) + ({c[2]!r})")

    def ent(p):
        q = f"greatest(1e-6, least(1 - 1e-6, {p}))"
        return f"(-{q} * ln({q}) - (1 - {q}) * ln(1 - {q}))"

    return f"""SELECT *, {c01('(1 - blend) * base_a + blend * cal_a')} AS l_any, {c01('(1 - blend) * base_q + blend * cal_q')} AS l_quality, greatest(4e-1, 7e-1 + 5.5e-1 * (5e-1 * conf + 5e-1 * mass)) AS sup_scale
FROM (SELECT *, {c01('4e-2 + 3.5e-1 * mass + 1.8e-1 * conf')} AS blend FROM (SELECT *, {c01(f"1 - ({ent('cal_a')} + {ent('cal_q')}) / 2 / ln(2e0)")} AS conf, {c01('5.5e-1 * sup + 4.5e-1 * sig_m')} AS mass
FROM (SELECT *, {cal('raw_a', ARRIVAL_CALIBRATOR)} AS cal_a, {cal('raw_q', QUALITY_CALIBRATOR)} AS cal_q FROM (SELECT *, {sig(score(ARRIVAL_WEIGHTS))} AS raw_a, {sig(score(QUALITY_WEIGHTS, True))} AS raw_q FROM {src}) l1) l2) l3) l4"""


def score(demand_rows: str, ref: str) -> str:
    """Full score of demand rows; ``ref`` has view_id, lambda_ref."""
    base = f"""SELECT *, {arrival('lambda_eff')} AS base_a, {c01('(1 - tip_emphasis) * sig_r + tip_emphasis * tip_proxy')} AS base_q FROM
 (SELECT *, {c01('merchant_intensity / (2 * lambda_ref)')} AS sig_m, 1 + rain * (1.1e0 + 3.5e-1 * res_share) AS rain_mult, CASE WHEN hour >= 22 OR hour <= 4 THEN {c01('tip * 8.5e-1')} ELSE tip END AS tip_proxy FROM
 (SELECT d.*, greatest(1e-9, coalesce(z.lambda_ref, d.lambda_eff)) AS lambda_ref, CASE WHEN md + rd > 0 THEN md / (md + rd) ELSE 0 END AS mer_share, CASE WHEN md + rd > 0 THEN rd / (md + rd) ELSE 0 END AS res_share, exp(-expected_dist / 900) AS sig_r,
  {c01('(effective_merchants - 1) / 7')} AS sup, {c01('(ticket_mean - 5e-1) / 8e-1')} AS sig_i, {c01('(ticket_mean - 7.5e-1) / 4.5e-1')} AS tip, CASE WHEN comp > 0 THEN comp * parking_sum / (1 + comp * parking_sum) ELSE 0 END AS sig_d,
  CASE WHEN dow = 0 OR dow = 6 THEN 1e0 ELSE 0e0 END AS weekend, 1e1 AS horizon, {bucket()} AS b, {bucket()}.n AS bname FROM {demand_rows} d LEFT JOIN {ref} z ON z.view_id = d.view_id) a) c"""
    n = "greatest(2e0, support * 2.5e0)"
    return f"""SELECT *, stability_high - stability_low AS stability_width, CASE WHEN composite >= 5e-1 AND effective_merchants >= 3 THEN 'hold' ELSE 'rotate' END AS advisory FROM
 (SELECT *, least({c01('p_any_low * mult')}, p_good) AS p_good_low, greatest({c01('p_any_high * mult')}, p_good) AS p_good_high, {c01('be_a / (be_a + be_b) - 1.28e0 * be_sd')} AS stability_low, {c01('be_a / (be_a + be_b) + 1.28e0 * be_sd')} AS stability_high,
  {c01('b.i * sig_i + b.m * sig_m + b.r * sig_r - b.d * sig_d')} AS composite FROM (SELECT *, sqrt(greatest(0e0, be_a * be_b / ((be_a + be_b) * (be_a + be_b) * (be_a + be_b + 1)))) AS be_sd FROM
 (SELECT *, 1 + p_good * {n} AS be_a, 1 + (1 - p_good) * {n} AS be_b, least({arrival('lambda_eff * 7e-1')}, p_any) AS p_any_low, greatest({arrival('lambda_eff * 1.3e0')}, p_any) AS p_any_high FROM
 (SELECT *, {c01('p_any * mult')} AS p_good FROM (SELECT *, 2.5e-1 + 7.5e-1 * quality AS mult FROM (SELECT *, CASE WHEN model = 'glm' THEN l_any ELSE base_a END AS p_any, CASE WHEN model = 'glm' THEN l_quality ELSE base_q END AS quality,
  effective_merchants * CASE WHEN model = 'glm' THEN sup_scale ELSE 1 END AS support FROM ({learned_sql('(' + base + ') s0')}) s1) s2) s3) s4) s5) s6) s7"""


def quantile(q: float, x: str) -> str:
    return f"(list_sort(list({x})))[CAST(floor({q!r}e0 * (count(*) - 1)) AS BIGINT) + 1]"


STEPS: dict[str, str] = {
    "clamped": f"""SELECT v.* EXCLUDE (south, north, west, east), CASE WHEN big THEN cy - 3e3 / 111320e0 ELSE south END AS south, CASE WHEN big THEN cy + 3e3 / 111320e0 ELSE north END AS north,
  CASE WHEN big THEN cx - 3e3 / (111320e0 * greatest(cos(radians(cy)), 1e-1)) ELSE west END AS west, CASE WHEN big THEN cx + 3e3 / (111320e0 * greatest(cos(radians(cy)), 1e-1)) ELSE east END AS east
FROM (SELECT *, (south + north) / 2 AS cy, (west + east) / 2 AS cx, {dist('south', 'west', 'north', 'east')} > 12000 AS big FROM views_v) v""",
    "boxed_merchants": "SELECT m.* FROM merchants_v m JOIN clamped v ON v.view_id = m.view_id WHERE m.lat BETWEEN v.south AND v.north AND m.lon BETWEEN v.west AND v.east",
    "boxed_parking": "SELECT m.* FROM parking_v m JOIN clamped v ON v.view_id = m.view_id WHERE m.lat BETWEEN v.south AND v.north AND m.lon BETWEEN v.west AND v.east",
    "boxed_homes": "SELECT m.* FROM residential_v m JOIN clamped v ON v.view_id = m.view_id WHERE m.lat BETWEEN v.south AND v.north AND m.lon BETWEEN v.west AND v.east",
    # The seven readable texts of the fixture, spelled out by hand: (day set, from, to) rows.
    "hours_known": """SELECT * FROM (VALUES
  ('Mo-Su 10:00-22:00', 0, 600, 1320), ('Mo-Su 10:00-22:00', 1, 600, 1320), ('Mo-Su 10:00-22:00', 2, 600, 1320), ('Mo-Su 10:00-22:00', 3, 600, 1320), ('Mo-Su 10:00-22:00', 4, 600, 1320), ('Mo-Su 10:00-22:00', 5, 600, 1320), ('Mo-Su 10:00-22:00', 6, 600, 1320),
  ('Mo-Su 18:00-02:00', 0, 1080, 1440), ('Mo-Su 18:00-02:00', 1, 1080, 1440), ('Mo-Su 18:00-02:00', 2, 1080, 1440), ('Mo-Su 18:00-02:00', 3, 1080, 1440), ('Mo-Su 18:00-02:00', 4, 1080, 1440), ('Mo-Su 18:00-02:00', 5, 1080, 1440), ('Mo-Su 18:00-02:00', 6, 1080, 1440),
  ('Mo-Su 18:00-02:00', 0, 0, 120), ('Mo-Su 18:00-02:00', 1, 0, 120), ('Mo-Su 18:00-02:00', 2, 0, 120), ('Mo-Su 18:00-02:00', 3, 0, 120), ('Mo-Su 18:00-02:00', 4, 0, 120), ('Mo-Su 18:00-02:00', 5, 0, 120), ('Mo-Su 18:00-02:00', 6, 0, 120),
  ('Mo-Fr 09:00-17:00; Sa off', 0, 540, 1020), ('Mo-Fr 09:00-17:00; Sa off', 1, 540, 1020), ('Mo-Fr 09:00-17:00; Sa off', 2, 540, 1020), ('Mo-Fr 09:00-17:00; Sa off', 3, 540, 1020), ('Mo-Fr 09:00-17:00; Sa off', 4, 540, 1020),
  ('Fr-Mo 11:00-14:00,17:00-22:00; We 08:00-08:00', 4, 660, 840), ('Fr-Mo 11:00-14:00,17:00-22:00; We 08:00-08:00', 4, 1020, 1320), ('Fr-Mo 11:00-14:00,17:00-22:00; We 08:00-08:00', 5, 660, 840), ('Fr-Mo 11:00-14:00,17:00-22:00; We 08:00-08:00', 5, 1020, 1320),
  ('Fr-Mo 11:00-14:00,17:00-22:00; We 08:00-08:00', 6, 660, 840), ('Fr-Mo 11:00-14:00,17:00-22:00; We 08:00-08:00', 6, 1020, 1320), ('Fr-Mo 11:00-14:00,17:00-22:00; We 08:00-08:00', 0, 660, 840), ('Fr-Mo 11:00-14:00,17:00-22:00; We 08:00-08:00', 0, 1020, 1320),
  ('Fr-Mo 11:00-14:00,17:00-22:00; We 08:00-08:00', 2, 0, 1440),
  ('Sa,Su 06:00-24:00; Mo closed; Tu-Th 20:00-04:00', 1, 1200, 1440), ('Sa,Su 06:00-24:00; Mo closed; Tu-Th 20:00-04:00', 2, 1200, 1440), ('Sa,Su 06:00-24:00; Mo closed; Tu-Th 20:00-04:00', 3, 1200, 1440),
  ('Sa,Su 06:00-24:00; Mo closed; Tu-Th 20:00-04:00', 2, 0, 240), ('Sa,Su 06:00-24:00; Mo closed; Tu-Th 20:00-04:00', 3, 0, 240), ('Sa,Su 06:00-24:00; Mo closed; Tu-Th 20:00-04:00', 4, 0, 240)) t(text, osm_day, a, b)""",
    "merchant_open": """SELECT m.view_id, m.id, v.osm_day, v.minute, coalesce(bool_or(v.minute >= h.a AND v.minute < h.b), true) AS is_open FROM merchants_v m JOIN views_v v ON v.view_id = m.view_id
  LEFT JOIN hours_known h ON h.text = m.opening_hours AND h.osm_day = v.osm_day GROUP BY ALL""",
    "open_merchants": "SELECT m.* FROM boxed_merchants m JOIN merchant_open o ON o.view_id = m.view_id AND o.id = m.id WHERE o.is_open",
    "parking_points": "SELECT view_id, id AS point_id, lat, lon FROM boxed_parking",
    "merchant_points": "SELECT view_id, id AS point_id, lat, lon FROM open_merchants",
    "parking_features": kernel("parking_points", "open_merchants", "boxed_parking", "boxed_homes", "clamped"),
    "merchant_features": kernel("merchant_points", "open_merchants", "boxed_parking", "boxed_homes", "clamped"),
    "grid_rows": "SELECT view_id, 0 AS i, south AS lat, north, grid_step / 111320e0 AS step FROM clamped UNION ALL SELECT view_id, i + 1, lat + step, north, step FROM grid_rows WHERE lat + step <= north",
    "grid_cols": "SELECT view_id, 0 AS j, west AS lon, east, grid_step / greatest(1e-6, cos(radians((south + north) / 2)) * 111320e0) AS step FROM clamped UNION ALL SELECT view_id, j + 1, lon + step, east, step FROM grid_cols WHERE lon + step <= east",
    "grid_points": "SELECT r.view_id, r.i || ':' || c.j AS point_id, r.lat, c.lon FROM grid_rows r JOIN grid_cols c ON c.view_id = r.view_id",
    "grid_features": kernel("grid_points", "open_merchants", "boxed_parking", "boxed_homes", "clamped", grid=True),
    "grid_demand": demand("grid_features", "clamped"),
    "lambda_refs": f"SELECT view_id, greatest(1e-9, {quantile(0.7, 'lambda_eff')}) AS lambda_ref FROM grid_demand GROUP BY view_id",
    "grid_scores": score("grid_demand", "lambda_refs"),
    "parking_demand": demand("parking_features", "clamped"),
    "parking_scores": "SELECT s.*, p.ingest_ix, p.name, s.point_id AS id FROM (" + score("parking_demand", "lambda_refs") + ") s JOIN boxed_parking p ON p.view_id = s.view_id AND p.id = s.point_id",
    "merchant_demand": demand("merchant_features", "clamped"),
    "merchant_scores": "SELECT s.*, p.ingest_ix, p.name, p.delivery, p.takeaway, p.drive_through, s.point_id AS id FROM (" + score("merchant_demand", "lambda_refs") + ") s JOIN open_merchants p ON p.view_id = s.view_id AND p.id = s.point_id",
    "demand_nodes_s": f"""SELECT m.view_id, m.id, m.lat, m.lon, {profile('m')} * {merchant_weight()} AS weight, 'merchant' AS source_type FROM open_merchants m JOIN clamped v ON v.view_id = m.view_id
  UNION ALL SELECT h.view_id, h.id, h.lat, h.lon, residential_weight * {profile('r')} * {home_weight()}, 'residential' FROM boxed_homes h JOIN clamped v ON v.view_id = h.view_id""",
    "candidates": f"SELECT *, {c01('6.5e-1 * p_good + 3.5e-1 * stability_low')} AS utility FROM parking_scores",
    "cover": f"SELECT c.view_id, c.id, c.p_good, c.utility, c.ingest_ix, n.id AS node, n.source_type, n.weight * c.utility * exp(-{dist('c.lat', 'c.lon', 'n.lat', 'n.lon')} / greatest(3e2, v.tau)) AS cov FROM candidates c JOIN demand_nodes_s n ON n.view_id = c.view_id JOIN clamped v ON v.view_id = c.view_id WHERE n.weight > 0 AND c.utility > 0",
    "pick1": "SELECT * FROM (SELECT view_id, id, p_good, utility, sum(cov) AS gain, row_number() OVER (PARTITION BY view_id ORDER BY sum(cov) DESC, p_good DESC, utility DESC, ingest_ix) AS rn FROM cover GROUP BY view_id, id, p_good, utility, ingest_ix) t WHERE rn = 1",
    "cur1": "SELECT c.view_id, c.node, c.source_type, c.cov AS cur FROM cover c JOIN pick1 p ON p.view_id = c.view_id AND p.id = c.id",
    "pick2": "SELECT * FROM (SELECT c.view_id, c.id, c.p_good, c.utility, sum(greatest(0e0, c.cov - u.cur)) AS gain, row_number() OVER (PARTITION BY c.view_id ORDER BY sum(greatest(0e0, c.cov - u.cur)) DESC, c.p_good DESC, c.utility DESC, c.ingest_ix) AS rn FROM cover c JOIN cur1 u ON u.view_id = c.view_id AND u.node = c.node AND u.source_type = c.source_type JOIN pick1 p ON p.view_id = c.view_id AND p.id <> c.id GROUP BY c.view_id, c.id, c.p_good, c.utility, c.ingest_ix) t WHERE rn = 1",
    "cur2": "SELECT c.view_id, c.node, c.source_type, greatest(u.cur, c.cov) AS cur FROM cover c JOIN pick2 p ON p.view_id = c.view_id AND p.id = c.id JOIN cur1 u ON u.view_id = c.view_id AND u.node = c.node AND u.source_type = c.source_type",
    "pick3": "SELECT * FROM (SELECT c.view_id, c.id, c.p_good, c.utility, sum(greatest(0e0, c.cov - u.cur)) AS gain, row_number() OVER (PARTITION BY c.view_id ORDER BY sum(greatest(0e0, c.cov - u.cur)) DESC, c.p_good DESC, c.utility DESC, c.ingest_ix) AS rn FROM cover c JOIN cur2 u ON u.view_id = c.view_id AND u.node = c.node AND u.source_type = c.source_type JOIN pick1 p ON p.view_id = c.view_id AND p.id <> c.id JOIN pick2 s ON s.view_id = c.view_id AND s.id <> c.id GROUP BY c.view_id, c.id, c.p_good, c.utility, c.ingest_ix) t WHERE rn = 1",
    "picks": "SELECT view_id, id, 1 AS pick, utility, gain, p_good FROM pick1 UNION ALL SELECT view_id, id, 2, utility, gain, p_good FROM pick2 UNION ALL SELECT view_id, id, 3, utility, gain, p_good FROM pick3",
}
RECURSIVE = ("grid_rows", "grid_cols", "dispatch_dp", "batch_walk")


def compose(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with every step and derived table it depends on."""
    steps = {**{k: v for k, v in TABLES.items()}, **STEPS, **(extra or {})}
    order: list[str] = []

    def visit(text: str, me: str | None) -> None:
        for name in depends_on(text, steps):
            if name != me and name not in order:
                visit(steps[name], name)
                order.append(name)

    visit(body, None)
    if not order:
        return body
    kind = "WITH RECURSIVE " if any(n in RECURSIVE for n in order) else "WITH "
    mat = ("_features", "_scores", "_demand", "cover", "cur1", "cur2", "pick1", "pick2", "pick3", "open_merchants", "lambda_refs", "grid_points")
    return kind + ",\n".join(f"{n} AS {'MATERIALIZED ' if n.endswith(mat) else ''}({steps[n]})" for n in order) + "\n" + body
