"""Route analytics over nested route rows, with higher-order functions.

A route row: route_id, coordinates ARRAY<ARRAY<DOUBLE>> (lng, lat), distance_m,
duration_s, steps ARRAY<STRUCT<name, distance, driving_side, coordinates,
maneuver STRUCT<type, modifier, instruction, exit, bearing_before,
bearing_after>, intersections ARRAY<STRUCT<lanes, entry>>>>.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import bearing_deg, normalize_heading, octant_label, relative_side, turn_delta
from ..functions.scalar import clamp01_zero, col, round_half_up
from ..functions.text import (distance_delta_text, distance_text, duration_delta_text, out_of_100_text,
                              points_delta_text, range_text)
from .places import signal_label

ARRIVAL_ENTER_M, ARRIVAL_EXIT_M = 260.0, 420.0
REROUTE_SECONDS, REROUTE_METERS = 18.0, 60.0


def _lower(x: Column) -> Column:
    return F.lower(F.coalesce(x, F.lit("")))


def primary_step(steps="steps") -> Column:
    """First step longer than 15 m, else the first step."""
    s = col(steps)
    return F.coalesce(F.try_element_at(F.filter(s, lambda x: x["distance"] > 15), F.lit(1)), F.try_element_at(s, F.lit(1)))


def arrival_step(steps="steps") -> Column:
    """Last 'arrive' step, else the last step."""
    s = col(steps)
    arrive = F.filter(s, lambda x: _lower(x["maneuver"]["type"]) == "arrive")
    return F.coalesce(F.try_element_at(arrive, F.lit(-1)), F.try_element_at(s, F.lit(-1)))


def final_turn_step(steps="steps") -> Column:
    """Last step that is not 'arrive', else the first step."""
    s = col(steps)
    turns = F.filter(s, lambda x: _lower(x["maneuver"]["type"]) != "arrive")
    return F.coalesce(F.try_element_at(turns, F.lit(-1)), F.try_element_at(s, F.lit(1)))


def approach_segment(coordinates="coordinates") -> Column:
    """Struct(start_lat, start_lng, end_lat, end_lng): last distinct point to the end."""
    c = col(coordinates)
    end = F.try_element_at(c, F.lit(-1))
    start = F.try_element_at(F.filter(c, lambda p: (p[0] != end[0]) | (p[1] != end[1])), F.lit(-1))
    return F.when(start.isNotNull(), F.struct(start[1].alias("start_lat"), start[0].alias("start_lng"),
                                              end[1].alias("end_lat"), end[0].alias("end_lng")))


def _segment_bearings(c: Column) -> Column:
    """Bearings of consecutive segments, degenerate ones dropped."""
    n = F.size(c)
    pairs = F.zip_with(F.slice(c, 1, F.greatest(F.lit(0), n - 1)), F.slice(c, 2, F.greatest(F.lit(0), n - 1)),
                       lambda a, b: bearing_deg(a[1], a[0], b[1], b[0]))
    return F.when(n >= 2, F.filter(pairs, lambda x: x.isNotNull()))


def polyline_bearing(coordinates="coordinates", from_end: bool = False) -> Column:
    return F.try_element_at(_segment_bearings(col(coordinates)), F.lit(-1 if from_end else 1))


def step_bearing(step: Column) -> Column:
    return F.coalesce(normalize_heading(step["maneuver"]["bearing_after"]),
                      normalize_heading(step["maneuver"]["bearing_before"]), polyline_bearing(step["coordinates"]))


def route_bearing(arrival: bool, steps="steps", coordinates="coordinates") -> Column:
    """Bearing of a route for following it, or for its arrival."""
    if not arrival:
        return F.coalesce(step_bearing(primary_step(steps)), polyline_bearing(coordinates))
    seg = approach_segment(coordinates)
    return F.coalesce(step_bearing(F.coalesce(final_turn_step(steps), arrival_step(steps))),
                      bearing_deg(seg["start_lat"], seg["start_lng"], seg["end_lat"], seg["end_lng"]),
                      polyline_bearing(coordinates, from_end=True))


def route_bounds(coordinates="coordinates") -> Column:
    c = col(coordinates)
    lng, lat = F.transform(c, lambda p: p[0]), F.transform(c, lambda p: p[1])
    return F.when(F.size(c) > 0, F.struct(F.array_min(lng).alias("west"), F.array_min(lat).alias("south"),
                                          F.array_max(lng).alias("east"), F.array_max(lat).alias("north")))


def step_instruction(step: Column) -> Column:
    m = step["maneuver"]
    kind = F.replace(F.lower(F.coalesce(F.when(m["type"] != "", m["type"]), F.lit("continue"))), F.lit("_"), F.lit(" "))
    mod = F.replace(F.coalesce(m["modifier"], F.lit("")), F.lit("_"), F.lit(" "))
    name = F.coalesce(step["name"], F.lit(""))
    road = F.when(name != "", F.concat(F.lit(" on "), name)).otherwise("")

    def mod_or(word: str) -> Column:
        return F.when(mod != "", mod).otherwise(word)

    def text(*parts) -> Column:
        return F.trim(F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))

    side = F.when(mod != "", F.concat(mod, F.lit(" "))).otherwise("")
    return (F.when(step.isNull(), F.lit(None).cast("string"))
            .when(F.coalesce(m["instruction"], F.lit("")) != "", m["instruction"])
            .when(kind == "depart", text("Head ", mod_or("out"), road))
            .when(kind == "arrive", "Arrive at your destination")
            .when(kind == "turn", text("Turn ", mod, road))
            .when(kind == "merge", text("Merge", road))
            .when(kind == "on ramp", text("Take the ", side, "on-ramp", road))
            .when(kind == "off ramp", text("Take the ", side, "exit", road))
            .when(kind == "fork", text("Keep ", mod_or("ahead"), road))
            .when(kind.isin("roundabout", "rotary") & (F.coalesce(m["exit"], F.lit(0)) != 0),
                  text("Take exit ", m["exit"].cast("string"), " at the roundabout", road))
            .when(kind.isin("roundabout", "rotary"), text("Enter the roundabout", road))
            .when(kind.isin("exit roundabout", "exit rotary"), text("Exit the roundabout", road))
            .when(kind == "end of road", text("At the end of the road, turn ", mod, road))
            .when((kind == "new name") & (name != ""), F.concat(F.lit("Continue as "), name))
            .when(kind == "new name", "Continue ahead")
            .otherwise(text("Continue ", mod_or("ahead"), road)))


def turn_complexity(step: Column) -> Column:
    """Struct(score, label, detail) of a maneuver; null without a step."""
    m = step["maneuver"]
    kind = F.replace(F.lower(F.coalesce(F.when(m["type"] != "", m["type"]), F.lit("continue"))), F.lit("_"), F.lit(" "))
    inter = F.try_element_at(step["intersections"], F.lit(1))
    lanes = F.greatest(F.lit(0), F.coalesce(F.size(inter["lanes"]), F.lit(0)))
    entries = F.greatest(F.lit(0), F.coalesce(F.size(F.filter(inter["entry"], lambda e: F.coalesce(e, F.lit(False)))), F.lit(0)))
    base = (F.when(kind.isin("roundabout", "rotary", "exit roundabout", "exit rotary"), 0.84)
            .when(kind.isin("fork", "merge", "on ramp", "off ramp"), 0.72)
            .when(kind == "end of road", 0.63).when(kind == "turn", 0.48).otherwise(0.34))
    angle = clamp01_zero(F.abs(turn_delta(m["bearing_before"], m["bearing_after"])) / 135.0)
    score = clamp01_zero(0.42 * base + 0.28 * angle + 0.16 * clamp01_zero((lanes - 1) / 4.0)
                         + 0.14 * clamp01_zero((entries - 1) / 4.0))
    label = F.when(score >= 0.76, "Complex").when(score >= 0.56, "Busy").when(score >= 0.34, "Moderate").otherwise("Clean")
    parts = F.array_compact(F.array(
        F.when(lanes > 0, F.concat(lanes.cast("string"), F.when(lanes == 1, " lane").otherwise(" lanes"))),
        F.when(entries > 1, F.concat(entries.cast("string"), F.lit(" legal branches")))))
    detail = F.when(F.size(parts) > 0, F.array_join(parts, " · ")).otherwise(step_instruction(step))
    return F.when(step.isNotNull(), F.struct(score.alias("score"), label.alias("label"), detail.alias("detail")))


def arrival_side(modifier) -> Column:
    m = F.replace(F.lower(F.coalesce(col(modifier), F.lit(""))), F.lit("_"), F.lit(" "))
    return F.when(F.contains(m, F.lit("left")), "left").when(F.contains(m, F.lit("right")), "right").otherwise("center")


def side_phrase(side) -> Column:
    s = col(side)
    return (F.when(s == "left", "to the left").when(s == "right", "to the right").when(s == "ahead", "straight ahead")
            .when(s == "behind", "behind the finish").otherwise("near the curb"))


def add_route_steps(routes: DataFrame) -> DataFrame:
    """Primary, arrival and final-turn steps, approach segment (unless given), instruction."""
    df = routes.withColumns({"primary_step": primary_step(), "arrival_step": arrival_step(), "final_turn_step": final_turn_step()})
    if "approach" not in routes.columns:
        df = df.withColumn("approach", approach_segment())
    c = F.col
    return df.withColumns({
        "instruction": step_instruction(c("primary_step")),
        "final_turn": turn_complexity(F.coalesce(c("final_turn_step"), c("arrival_step")))})


def approach_profile(routes: DataFrame) -> DataFrame:
    """Arrival side, legal curb side and curbside confidence.

    Needs :func:`add_route_steps` and the optional context columns friction,
    near_lot_id, near_lat, near_lon, near_m, stage_lat, stage_lon, stage_delta,
    micro_lat, micro_lon (null = not available).
    """
    c = F.col
    a = c("approach")
    first = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))
    side = arrival_side(c("arrival_step.maneuver.modifier"))
    legal = F.when(F.lower(F.coalesce(F.when(c("arrival_step.driving_side") != "", c("arrival_step.driving_side")),
                                      F.when(c("final_turn_step.driving_side") != "", c("final_turn_step.driving_side")),
                                      F.lit("right"))) == "left", "left").otherwise("right")

    def seen(lat: str, lon: str) -> Column:
        return F.when(a.isNotNull() & c(lat).isNotNull(), relative_side(
            a["start_lat"], a["start_lng"], a["end_lat"], a["end_lng"], c(lat), c(lon)))

    df = routes.withColumns({
        "approach_direction": F.when(a.isNotNull(), octant_label(a["start_lat"], a["start_lng"], a["end_lat"], a["end_lng"])).otherwise("unknown"),
        "arrival_side": side, "legal_curb_side": legal, "curb_parking_side": seen("near_lat", "near_lon"),
        "staging_side": seen("stage_lat", "stage_lon"), "micro_side": seen("micro_lat", "micro_lon")})
    off = c("arrival_side") != "center"

    def vote(name: str, plus: float, minus: float) -> Column:
        return F.when(c(name).isNotNull() & off, F.when(c(name) == c("arrival_side"), plus).otherwise(minus)).otherwise(0.0)

    conf = (F.when(off, 0.64).otherwise(0.46)
            + F.when(c("arrival_side") == c("legal_curb_side"), 0.14).when(off, -0.14).otherwise(0.0)
            + vote("curb_parking_side", 0.12, -0.08) + vote("staging_side", 0.06, -0.04) + vote("micro_side", 0.04, -0.03)
            - F.when(c("final_turn").isNotNull(), clamp01_zero((c("final_turn.score") - 0.3) / 0.7) * 0.12).otherwise(0.0)
            - F.coalesce(c("friction"), F.lit(0.0)) * 0.08)
    df = df.withColumn("curbside_confidence", clamp01_zero(conf))
    label = (F.when(~off, F.when(c("curbside_confidence") >= 0.62, "Straight-in arrival").otherwise("Curbside uncertain"))
             .when((c("arrival_side") == c("legal_curb_side")) & (c("curbside_confidence") >= 0.72),
                   F.concat(F.lit("Likely "), c("arrival_side"), F.lit("-side curb")))
             .when(c("arrival_side") != c("legal_curb_side"), F.concat(first(c("arrival_side")), F.lit("-side finish")))
             .otherwise(F.concat(first(c("arrival_side")), F.lit("-side possible"))))
    ctx = F.array_compact(F.array(
        F.when(c("near_lat").isNotNull() & c("near_m").isNotNull(), F.concat(
            c("near_m").cast("string"), F.lit(" m visible parking sits "), side_phrase("curb_parking_side"))),
        F.when(c("stage_lat").isNotNull(), F.concat(F.lit("best staging sits "), side_phrase("staging_side"), F.lit(" and "), points_delta_text("stage_delta")))
        .when(c("micro_lat").isNotNull(), F.concat(F.lit("short move support sits "), side_phrase("micro_side")))))
    tail = F.when(F.size(ctx) > 0, F.concat(F.lit(" "), F.array_join(ctx, ". "), F.lit("."))).otherwise("")
    detail = F.when(~off, F.concat(F.lit("OSRM does not expose a firm last-segment curbside here, so the visible parking field decides."), tail))\
        .otherwise(F.concat(F.lit("OSRM places the finish on the "), c("arrival_side"), F.lit(" while legal curb flow is "), c("legal_curb_side"), F.lit("."), tail))
    return df.withColumns({"curbside_label": label, "curbside_detail": detail})


def arrival_readiness(profile: DataFrame) -> DataFrame:
    """Overall readiness, its headline and its four items.

    Needs :func:`approach_profile` and dest_p_good, dest_p_low, dest_p_high,
    friction_label, friction_value, stage_delta/stage_m/stage_direction,
    micro_suitability/micro_m/micro_direction.
    """
    c = F.col
    field = F.when(c("dest_p_good").isNotNull(), clamp01_zero("dest_p_good")).otherwise(0.34)
    ease = F.when(c("friction").isNotNull(), 1.0 - clamp01_zero("friction")).otherwise(0.4)
    curb = clamp01_zero("curbside_confidence")
    stage = (F.when(c("stage_delta").isNotNull(), clamp01_zero(0.52 + c("stage_delta") * 2.6))
             .when(c("micro_suitability").isNotNull(), clamp01_zero(0.36 + c("micro_suitability") * 0.48)).otherwise(0.26))
    df = profile.withColumns({"field_score": field, "pickup_ease": ease, "curb_score": curb, "stage_score": stage})
    overall = clamp01_zero(0.34 * c("field_score") + 0.24 * c("pickup_ease") + 0.24 * c("curb_score") + 0.18 * c("stage_score"))
    final = F.coalesce(c("distance_m"), F.lit(0.0)) <= ARRIVAL_EXIT_M
    df = df.withColumns({"readiness": overall, "is_final_approach": final})

    def item(label: str, value: Column, detail: Column, score: str) -> Column:
        return F.struct(F.lit(label).alias("label"), value.alias("value"), detail.alias("detail"), c(score).alias("score"))

    near = lambda m, d: F.concat(c(m).cast("string"), F.lit(" m "), c(d))
    scored = c("dest_p_good").isNotNull()
    items = F.array(
        item("Field", F.when(scored, signal_label("dest_p_good")).otherwise("Route only"),
             F.when(scored, range_text("dest_p_low", "dest_p_high")).otherwise("Refresh the field to unlock arrival scoring."), "field_score"),
        item("Friction", F.coalesce(c("friction_label"), F.lit("Route only")), F.coalesce(c("friction_value"), F.lit("Needs field refresh")), "pickup_ease"),
        item("Curb", c("curbside_label"), F.concat(out_of_100_text("curbside_confidence"), F.lit(" confidence")), "curb_score"),
        item("Stage", F.when(c("stage_delta").isNotNull(), points_delta_text("stage_delta"))
             .when(c("micro_suitability").isNotNull(), out_of_100_text("micro_suitability")).otherwise("No edge"),
             F.when(c("stage_delta").isNotNull(), near("stage_m", "stage_direction"))
             .when(c("micro_suitability").isNotNull(), near("micro_m", "micro_direction")).otherwise("No visible nearby lift"), "stage_score"))
    return df.withColumns({
        "readiness_headline": F.when(overall >= 0.74, "Arrival locked").when(overall >= 0.56, "Arrival building").otherwise("Arrival watch"),
        "readiness_detail": F.when(final, "Final approach is live. Curbside and staging come first.")
        .otherwise(F.concat(F.lit("Arrival camera will tighten automatically inside "), distance_text(F.lit(ARRIVAL_ENTER_M)), F.lit("."))),
        "readiness_items": items})


def known_destinations(destinations: DataFrame, nearest: DataFrame, staging: DataFrame, micro: DataFrame) -> DataFrame:
    """One row per scored destination with all that a route to it needs: friction
    and pressure, nearest lot, best staging lot, best short-move lot.

    All are keyed by (view_id, point_id).
    """
    from .places import competition_pressure
    keys = ["view_id", "point_id"]
    c = F.col
    dest = destinations.select(*keys, c("p_good").alias("dest_p_good"), c("p_good_low").alias("dest_p_low"),
                               c("p_good_high").alias("dest_p_high"), "friction", "friction_label", "friction_value",
                               competition_pressure(c("signals.D"), "nearby_merchants").alias("pressure"))
    near = nearest.select(*keys, c("lot_id").alias("near_lot_id"), c("lot_lat").alias("near_lat"), c("lot_lon").alias("near_lon"),
                          c("distance_m").alias("near_m"))
    stage = staging.select(*keys, c("lot_id").alias("stage_lot_id"), c("lot_name").alias("stage_name"), c("lot_lat").alias("stage_lat"),
                           c("lot_lon").alias("stage_lon"), c("probability_delta").alias("stage_delta"),
                           c("distance_m").alias("stage_m"), c("direction").alias("stage_direction"))
    short = micro.select(*keys, c("lot_lat").alias("micro_lat"), c("lot_lon").alias("micro_lon"), c("suitability").alias("micro_suitability"),
                         c("distance_m").alias("micro_m"), c("direction").alias("micro_direction"))
    df = dest
    for side in (near, stage, short):
        df = df.join(side, keys, "full")
    return df


def snapshot_of(routes: DataFrame) -> DataFrame:
    """Everything said about routes that already carry what is known about their destination."""
    from .places import pressure_detail, pressure_label
    c = F.col
    df = arrival_readiness(approach_profile(add_route_steps(routes)))
    return df.withColumns({
        "pressure_label": F.when(c("pressure").isNotNull(), pressure_label("pressure")),
        "arrival_summary": F.when(c("dest_p_good").isNotNull(), F.concat(
            c("readiness_headline"), F.lit(". "), c("curbside_label"), F.lit(". "), pressure_detail("pressure")))
        .otherwise("Route is active. Load or refresh the current field to unlock arrival scoring for this destination.")})


def navigation_snapshot(routes: DataFrame, destinations: DataFrame, nearest: DataFrame, staging: DataFrame,
                        micro: DataFrame) -> DataFrame:
    """Route rows with everything known about their destination.

    ``routes`` carry view_id and point_id of their destination.  The four sides
    are put together first, because there are fewer destinations than routes.
    """
    known = known_destinations(destinations, nearest, staging, micro)
    return snapshot_of(routes.join(known, ["view_id", "point_id"], "left"))


def reroute_delta(snapshots: DataFrame, trip: str = "trip_id", ts: str = "ts", tie: str = "route_id") -> DataFrame:
    """Change of each route against the previous one of its trip.

    Needs distance_m, duration_s, curbside_label, final_turn, stage_lot_id,
    stage_name and friction_label.  Rows without a noteworthy change have a
    null headline.
    """
    from .asof import previous_row
    cols = ["distance_m", "duration_s", "curbside_label", "turn_label", "stage_lot_id", "friction_label"]
    df = previous_row(snapshots.withColumn("turn_label", F.col("final_turn.label")), trip, ts, tie, cols)
    c = F.col
    have = c("prev_duration_s").isNotNull()
    dt = F.coalesce(c("duration_s"), F.lit(0.0)) - F.coalesce(c("prev_duration_s"), F.lit(0.0))
    dm = F.coalesce(c("distance_m"), F.lit(0.0)) - F.coalesce(c("prev_distance_m"), F.lit(0.0))

    def moved(name: str) -> Column:
        return (c(name) != "") & (c(f"prev_{name}") != "") & (c(name) != c(f"prev_{name}"))

    parts = F.array_compact(F.array(
        F.when(F.abs(dt) >= REROUTE_SECONDS, duration_delta_text(dt)),
        F.when(F.abs(dm) >= REROUTE_METERS, distance_delta_text(dm)),
        F.when(moved("curbside_label"), F.concat(F.lit("curbside shifts to "), F.lower("curbside_label"))),
        F.when(moved("turn_label"), F.concat(F.lit("final turn is now "), F.lower("turn_label"))),
        F.when(c("stage_lot_id").isNotNull() & ~c("stage_lot_id").eqNullSafe(c("prev_stage_lot_id")),
               F.concat(F.lit("best staging shifts to "), F.coalesce("stage_name", F.lit("Visible parking")))),
        F.when(moved("friction_label"), F.concat(F.lit("pickup friction moves to "), F.lower("friction_label")))))
    changed = have & (F.size(parts) > 0)
    head = (F.when(dt <= -REROUTE_SECONDS, "Reroute improves arrival").when(dt >= REROUTE_SECONDS, "Reroute slows arrival")
            .when(~c("curbside_label").eqNullSafe(c("prev_curbside_label")), "Reroute changes curbside")
            .otherwise("Reroute changes arrival setup"))
    return df.withColumns({
        "delta_headline": F.when(changed, head), "delta_detail": F.when(changed, F.array_join(parts, " · ")),
        "delta_tone": F.when(changed, F.when(dt > 0, "watch").otherwise("good"))})


def resolve_destinations(routes: DataFrame, merchants: DataFrame, fresh_scores: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """What a route leads to: given state, else the merchant at the point, else
    a bare spot; a fresh score wins over a given one.

    ``routes``: view_id, point_id, lat, lon, title.  ``fresh_scores``: view_id,
    point_id, p_good.  ``given``: point_id, given_kind, given_title, given_p_good.
    """
    from .nearby import first_merchant_at
    from .places import place_attributes
    keys = ["view_id", "point_id"]
    at = first_merchant_at(routes, merchants)
    names = place_attributes(merchants).select("view_id", F.col("id").alias("merchant_id"), F.col("title").alias("merchant_title"))
    df = routes.join(at, keys, "left").join(names, ["view_id", "merchant_id"], "left")
    df = df.join(fresh_scores.select(*keys, F.col("p_good").alias("fresh_p_good")), keys, "left")
    if given is not None:
        df = df.join(given.select(*keys, "given_kind", "given_title", "given_p_good"), keys, "left")
    else:
        df = df.withColumns({"given_kind": F.lit(None).cast("string"), "given_title": F.lit(None).cast("string"),
                             "given_p_good": F.lit(None).cast("double")})
    c = F.col
    return df.withColumns({
        "destination_kind": F.coalesce(c("given_kind"), F.when(c("merchant_id").isNotNull(), "restaurant").otherwise("spot")),
        "destination_title": F.coalesce(F.when(c("title") != "", c("title")), c("given_title"), c("merchant_title"), F.lit("Selected spot")),
        "destination_p_good": F.coalesce(c("fresh_p_good"), c("given_p_good"))})
