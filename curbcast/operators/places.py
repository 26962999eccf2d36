"""Place attributes, labels, comparison, friction and familiarity.

The sentences and limits of the labels are fixed values.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import clamp01_zero, col, round_half_up
from ..functions.text import (absolute_url, host_label, is_yes_tag, out_of_100_text, percent_text, range_text,
                              relative_time_text, tag_label)


def _whole(x) -> Column:
    return round_half_up(x).cast("string")


def signal_label(p) -> Column:
    p = col(p)
    return (F.when(p >= 0.75, "Excellent area — strong local demand support")
            .when(p >= 0.58, "Good area — solid nearby demand")
            .when(p >= 0.42, "Decent area — moderate demand support")
            .when(p >= 0.25, "Thin area — demand support is limited")
            .otherwise("Weak area — very little nearby demand support"))


def pickup_label(distance_m) -> Column:
    d = col(distance_m)
    s = F.concat(F.lit("~"), d.cast("string"), F.lit("m "))
    return (F.when(d <= 250, F.concat(s, F.lit("to nearest merchant — very quick pickup")))
            .when(d <= 500, F.concat(s, F.lit("avg pickup — short drive")))
            .when(d <= 900, F.concat(s, F.lit("avg pickup — moderate drive")))
            .otherwise(F.concat(s, F.lit("avg pickup — longer drive"))))


def stability_label(effective, width) -> Column:
    n = round_half_up(F.coalesce(col(effective), F.lit(0.0)))
    w = F.coalesce(col(width), F.lit(1.0))
    s = n.cast("string")
    return (F.when((n < 1.5) | (w > 0.34), F.concat(F.lit("Shaky — only ~"), s, F.lit(" merchant(s) contributing, score could swing a lot")))
            .when((n < 3) | (w > 0.24), F.concat(F.lit("Somewhat reliable — ~"), s, F.lit(" merchants, but still limited")))
            .when((n < 6) | (w > 0.16), F.concat(F.lit("Fairly stable — ~"), s, F.lit(" merchants backing this score")))
            .otherwise(F.concat(F.lit("Very stable — ~"), s, F.lit(" merchants, score is well-supported"))))


def probability_band_label(effective, low, high) -> Column:
    n = round_half_up(F.coalesce(col(effective), F.lit(0.0)))
    w = F.greatest(F.lit(0.0), clamp01_zero(high) - clamp01_zero(low))
    return (F.when((n < 2) | (w >= 0.28), F.concat(F.lit("Wide range — limited support behind this estimate (about "),
                                                   n.cast("string"), F.lit(" effective merchants).")))
            .when((n < 4) | (w >= 0.18), "Moderate range — the estimate has some support, but conditions can still move it.")
            .otherwise("Tighter range — the visible merchant field is giving a steadier estimate."))


def demand_mix_label(merchant_share, residential_share) -> Column:
    return (F.when(clamp01_zero(merchant_share) >= 0.68, "Merchant-led")
            .when(clamp01_zero(residential_share) >= 0.42, "Residential cushion").otherwise("Balanced mix"))


def demand_mix_detail(merchant_share, residential_share) -> Column:
    m, r = clamp01_zero(merchant_share), clamp01_zero(residential_share)
    return (F.when(m >= 0.68, F.concat(percent_text(m), F.lit(" of the field is coming from nearby restaurants right now.")))
            .when(r >= 0.42, F.concat(percent_text(r), F.lit(" of the field is home-driven, which usually smooths out spikes.")))
            .otherwise(F.concat(percent_text(m), F.lit(" merchant pull and "), percent_text(r),
                                F.lit(" residential support are both contributing."))))


def crowding_label(d) -> Column:
    d = clamp01_zero(d)
    return F.when(d >= 0.7, "Heavy").when(d >= 0.45, "Moderate").otherwise("Light")


def support_depth_label(effective, width) -> Column:
    n = round_half_up(F.coalesce(col(effective), F.lit(0.0)))
    return (F.when((n >= 6) & (F.coalesce(col(width), F.lit(1.0)) <= 0.16), "deep").when(n >= 3, "enough").otherwise("thin"))


def advisory_label(advisory) -> Column:
    return F.when(col(advisory) == "hold", "✅ Hold — worth waiting here").otherwise("↻ Rotate — try a different spot")


def add_score_labels(scored: DataFrame) -> DataFrame:
    """All band labels of a score, in one projection."""
    c = F.col
    return scored.withColumns({
        "signal_label": signal_label(clamp01_zero("p_good")), "pickup_label": pickup_label("expected_dist_m"),
        "stability_label": stability_label("effective_merchants", "stability_width"),
        "band_label": probability_band_label("effective_merchants", "p_good_low", "p_good_high"),
        "demand_mix": demand_mix_label("merchant_share", "residential_share"),
        "demand_mix_detail": demand_mix_detail("merchant_share", "residential_share"),
        "crowding_label": crowding_label(c("signals.D")),
        "support_depth": support_depth_label("effective_merchants", "stability_width"),
        "advisory_label": advisory_label("advisory"), "range_text": range_text("p_good_low", "p_good_high")})


def competition_pressure(crowding, nearby) -> Column:
    return clamp01_zero(0.68 * clamp01_zero(crowding) + 0.32 * clamp01_zero(col(nearby) / 8.0))


def pressure_label(p) -> Column:
    return F.when(col(p) >= 0.72, "High").when(col(p) >= 0.42, "Moderate").otherwise("Low")


def pressure_detail(p) -> Column:
    label = pressure_label(p)
    return (F.when(label == "High", "This field is crowded enough that waiting discipline matters more than raw merchant count.")
            .when(label == "Moderate", "Competition is present, but the spot is still carrying enough support to be usable.")
            .otherwise("Competition pressure is relatively calm here right now."))


def pickup_friction(scored: DataFrame, nearest: DataFrame) -> DataFrame:
    """Friction of a pickup at each scored place.

    ``nearest`` is the nearest scored lot per point; service tags
    (drive_through, takeaway, delivery) are optional columns.
    """
    n = nearest.select("view_id", "point_id", F.col("lot_id").alias("near_lot_id"), F.col("lot_lat").alias("near_lat"),
                       F.col("lot_lon").alias("near_lon"), F.col("distance_m").alias("near_m"))
    df = scored.join(n, ["view_id", "point_id"], "left")

    def tag(name: str, values: tuple[str, ...], ease: float) -> Column:
        if name not in scored.columns:
            return F.lit(0.0)
        return F.when(F.coalesce(F.col(name).isin(*values), F.lit(False)), ease).otherwise(0.0)

    ease = tag("drive_through", ("yes",), 0.18) + tag("takeaway", ("yes", "only"), 0.12) + tag("delivery", ("yes", "only"), 0.08)
    f = clamp01_zero(0.46 * clamp01_zero((F.col("expected_dist_m") - 120) / 700.0) + 0.32 * clamp01_zero(F.col("signals.D"))
                     + 0.22 * F.when(F.col("near_m").isNotNull(), clamp01_zero(F.col("near_m") / 360.0)).otherwise(1.0) - ease)
    df = df.withColumn("friction", f)
    text = F.when(F.col("near_m").isNotNull(), F.concat(F.col("near_m").cast("string"), F.lit(" m to the nearest visible parking option.")))\
        .otherwise("No visible parking option is currently loaded around this place.")
    return df.withColumns({
        "friction_label": F.when(f >= 0.72, "High friction").when(f >= 0.5, "Sticky").when(f >= 0.28, "Manageable").otherwise("Easy"),
        "friction_value": out_of_100_text(f),
        "friction_detail": F.concat(text, F.lit(" "), pickup_label("expected_dist_m"))})


def place_attributes(places: DataFrame) -> DataFrame:
    """Display attributes from promoted tag columns (all optional but id)."""
    have = set(places.columns)

    def c(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    def given(x: Column) -> Column:
        return F.when(x != "", x)

    cuisines = F.slice(F.filter(F.transform(F.split(F.coalesce(c("cuisine"), F.lit("")), "[;,]"),
                                            lambda x: tag_label(F.trim(x))), lambda x: x != ""), 1, 4)
    services = F.array_compact(F.array(
        F.when(is_yes_tag(c("delivery")), "Delivery"), F.when(is_yes_tag(c("takeaway")), "Takeout"),
        F.when(is_yes_tag(c("outdoor_seating")), "Outdoor seating"), F.when(is_yes_tag(c("drive_through")), "Drive-thru")))
    street = F.concat_ws(" ", given(c("addr_housenumber")), given(c("addr_street")))
    locality = F.concat_ws(" ", F.coalesce(given(c("addr_city")), given(c("addr_suburb"))), given(c("addr_state")), given(c("addr_postcode")))
    website = absolute_url(F.coalesce(given(c("website")), given(c("contact_website"))))
    hours = F.trim(F.coalesce(c("opening_hours"), F.lit("")))
    phone = F.trim(F.coalesce(given(c("phone")), given(c("contact_phone")), F.lit("")))
    amenity = tag_label(F.coalesce(given(c("amenity")), F.lit("food place")))
    return places.select(
        "view_id", "id", F.coalesce(given(c("name")), given(c("brand")), F.lit("Food place")).alias("title"),
        amenity.alias("amenity_label"), cuisines.alias("cuisine_labels"), services.alias("service_labels"),
        F.concat_ws(" · ", amenity, F.try_element_at(cuisines, F.lit(1))).alias("subtitle"),
        website.alias("website_url"), host_label(website).alias("website_label"),
        F.when(phone != "", phone).alias("phone_number"),
        given(F.concat_ws(", ", given(F.trim(street)), given(F.trim(locality)))).alias("address"),
        F.when(hours != "", F.replace(hours, F.lit(";"), F.lit(" · "))).alias("opening_hours_text"))


def compare_places(places: DataFrame, baselines: DataFrame, key: str = "view_id") -> DataFrame:
    """Each place against the baseline place of its group.

    Both carry title, p_good, expected_dist_m and drive_seconds (null = no
    route).  Drive time decides from 2 minutes, then score from 4 points, then
    pickup distance from 120 m.
    """
    b = baselines.select(key, *[F.col(c).alias(f"b_{c}") for c in ("point_id", "title", "p_good", "expected_dist_m", "drive_seconds")])
    j = places.join(b, key).where(F.col("point_id") != F.col("b_point_id"))
    c = F.col
    mins = round_half_up((c("drive_seconds") - c("b_drive_seconds")) / 60.0)
    delta = clamp01_zero("p_good") - clamp01_zero("b_p_good")
    pts = round_half_up(F.abs(delta) * 100.0)
    gap = F.coalesce(c("b_expected_dist_m"), F.lit(0)) - F.coalesce(c("expected_dist_m"), F.lit(0))
    cur, base = c("title"), c("b_title")
    scored = c("p_good").isNotNull() & c("b_p_good").isNotNull()
    by_drive = F.coalesce(F.abs(mins) >= 2, F.lit(False))

    def pick(first_is_current: Column) -> tuple[Column, Column]:
        return F.when(first_is_current, cur).otherwise(base), F.when(first_is_current, base).otherwise(cur)

    df, ds = pick(mins < 0)
    wf, wl = pick(delta > 0)
    pf, _ = pick(gap > 0)
    text = (F.when(~scored, F.concat(cur, F.lit(" and "), base, F.lit(" are saved for comparison. Refresh the current view to unlock the full score read.")))
            .when(by_drive, F.concat(df, F.lit(" is about "), F.abs(mins).cast("string"), F.lit(" min faster to drive than "), ds, F.lit(" from your current position.")))
            .when((pts < 4) & (F.abs(gap) >= 120), F.concat(cur, F.lit(" and "), base, F.lit(" are close on raw score. "), pf, F.lit(" has the quicker pickup field right now.")))
            .when(pts < 4, F.concat(cur, F.lit(" and "), base, F.lit(" are close on raw field score. Use pickup speed and route convenience to break the tie.")))
            .otherwise(F.concat(wf, F.lit(" projects about "), pts.cast("string"), F.lit(" points stronger than "), wl, F.lit(" on the current 10-minute field."))))
    decided = (F.when(~scored, "unscored").when(by_drive, "drive").when((pts < 4) & (F.abs(gap) >= 120), "pickup")
               .when(pts < 4, "tie").otherwise("score"))
    return j.select(key, "point_id", "b_point_id", decided.alias("decided_by"), text.alias("summary"),
                    (clamp01_zero("p_good") >= clamp01_zero("b_p_good")).alias("current_leads"))


# --- history ----------------------------------------------------------------

def place_history(events: DataFrame) -> DataFrame:
    """Roll up open and route events per user and place.

    A route event counts a route without an open, and moves the last-opened
    time.  One map-side combined aggregate.
    """
    opened, routed = F.col("kind") == "open", F.col("kind") == "route"
    latest = F.struct("ts", "event_id")
    has = set(events.columns)
    extra = [F.max_by(c, latest).alias(c) for c in ("title", "subtitle", "place_kind") if c in has]
    return events.where(F.col("place_id").isNotNull()).groupBy("user_id", "place_id").agg(
        F.count_if(opened).alias("open_count"), F.count_if(routed).alias("route_count"),
        F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_opened_at"),
        F.max(F.when(routed, F.col("ts"))).alias("last_route_at"), *extra)


def retain_newest(history: DataFrame, limit: int = 240) -> DataFrame:
    """Newest entries per user (ties by place)."""
    from .rank import top_per_group
    return top_per_group(history, ["user_id"], [F.desc("last_opened_at"), F.asc("place_id")], limit).drop("rank")


def familiarity_label(open_count, route_count) -> Column:
    o, r = col(open_count), col(route_count)
    return (F.when((r >= 6) | (o >= 14), "Highly familiar").when((r >= 2) | (o >= 5), "Familiar").otherwise("Fresh read"))


def add_familiarity(history: DataFrame, now) -> DataFrame:
    now = F.lit(now).cast("timestamp") if not isinstance(now, Column) else now
    return history.withColumns({
        "familiarity": familiarity_label("open_count", "route_count"),
        "opened_text": relative_time_text("last_opened_at", now), "routed_text": relative_time_text("last_route_at", now)})
