"""Small per-row state steps, run over sorted batches or over a stream.

A step takes (state tuple or None, row) and returns (new state, output tuple).
``fold_sorted`` runs it in batch: rows are partitioned by key, sorted by time
and walked batch by batch, so memory holds one state, never a key's rows.
``fold_stream`` runs the same step in a state processor.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..operators.blocks import spread

R = 6371000.0
Step = Callable[[tuple | None, tuple], tuple[tuple | None, tuple]]


def _none(x):
    return None if x is None or x != x else x


def _dist(a_lat, a_lon, b_lat, b_lon) -> float:
    s1 = math.sin(math.radians(b_lat - a_lat) / 2)
    s2 = math.sin(math.radians(b_lon - a_lon) / 2)
    h = s1 * s1 + math.cos(math.radians(a_lat)) * math.cos(math.radians(b_lat)) * s2 * s2
    return 2 * R * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


def _toward(prev, nxt, blend):
    if prev is None:
        return nxt % 360.0
    arc = (nxt - prev + 540.0) % 360.0 - 180.0
    return (prev + arc * min(1.0, max(0.0, blend))) % 360.0


def reroute_step(min_m: float = 30.0, min_s: float = 4.0) -> Step:
    """Accept a fix that moved far enough, long enough after the last accepted
    one.  Row: (t, lat, lon); output: (accepted,)."""
    def step(state, row):
        t, lat, lon = row
        if state is None or (_dist(state[1], state[2], lat, lon) >= min_m and t - state[0] >= min_s):
            return (t, lat, lon), (True,)
        return state, (False,)
    return step


def change_step(min_deg: float = 0.12, min_m: float = 0.25, min_mps: float = 0.05) -> Step:
    """Emit a row that differs enough from the last emitted one; a heading from
    the sensor is always emitted.
    Row: (heading, lat, lon, speed[, source]); output: (emitted,)."""
    def step(state, row):
        h, lat, lon, v = (_none(x) for x in row[:4])
        v = max(0.0, v) if v is not None else 0.0
        if h is None:
            return None, (False,)
        if state is not None and row[4:] != ("sensor",):
            turn = abs((h - state[0] + 540.0) % 360.0 - 180.0)
            if turn < min_deg and _dist(lat, lon, state[1], state[2]) < min_m and abs(v - state[3]) < min_mps:
                return state, (False,)
        return (h % 360.0, lat, lon, v), (True,)
    return step


def heading_step(max_sensor_age_s: float = 2.2, tau_ms: float = 300.0) -> Step:
    """Stored heading driven by fixes.

    Row: (t, gps_heading, course, sensor_age_s); output: (stored_heading,
    source).  A fresh sensor leaves the stored heading alone; no heading at all
    clears it; otherwise it blends towards the fix by elapsed time.
    """
    def step(state, row):
        t, gps, course, age = (_none(x) for x in row)
        stored, source, last = state if state is not None else (None, None, None)
        if age is not None and age <= max_sensor_age_s:
            return state, (stored, source)
        target = gps if gps is not None else course
        if target is None:
            return (None, None, last), (None, None)
        elapsed = tau_ms if last is None else max(0.0, (t - last) * 1000.0)
        stored = _toward(stored, target % 360.0, 1.0 - math.exp(-elapsed / tau_ms))
        source = "gps" if gps is not None else "course"
        return (stored, source, t), (stored, source)
    return step


def smoothing_step(sensor_factor: float = 0.68, gps_tau_ms: float = 140.0, bearing_tau_ms: float = 240.0,
                   sensor_tau_ms: float = 96.0) -> Step:
    """Circular smoothing of the effective heading.

    Row: (t, heading, source); output: (smoothed,).  Sensor headings move by a
    factor that grows with the turn, the others by elapsed time.
    """
    def step(state, row):
        t, target, source = (_none(x) for x in row)
        prev, last = state if state is not None else (None, None)
        if target is None:
            return (None, last), (None,)
        target %= 360.0
        tau = sensor_tau_ms if source == "sensor" else gps_tau_ms if source in ("gps", "course") else bearing_tau_ms
        elapsed = tau if last is None else max(0.0, (t - last) * 1000.0)
        prev = target if prev is None else prev
        if source == "sensor":
            turn = abs((target - prev + 540.0) % 360.0 - 180.0)
            blend = min(0.82, sensor_factor + min(0.12, turn / 360.0))
        else:
            blend = 1.0 - math.exp(-elapsed / tau)
        out = _toward(prev, target, blend)
        return (out, t), (out,)
    return step


def arrival_step(enter_m: float = 260.0, exit_m: float = 420.0) -> Step:
    """Arrival mode with hysteresis.  Row: (remaining_m,); output: (mode,)."""
    def step(state, row):
        d = _none(row[0]) or 0.0
        mode = state[0] if state is not None else "driver"
        if mode == "driver" and d <= enter_m:
            mode = "arrival"
        elif mode == "arrival" and d >= exit_m:
            mode = "driver"
        return (mode,), (mode,)
    return step


# Modes that a route never leaves by itself.
MANUAL_MODES = ("overview", "free", "browse")


def mode_step(enter_m: float = 260.0, exit_m: float = 420.0) -> Step:
    """Camera mode of a route with its automatic flag.

    Row: (remaining_m, chosen); output: (mode, auto).  A chosen mode is set by
    hand.  Then the route may enter arrival by itself, and leave it again only
    if it entered by itself; without a route, and in overview, free and browse,
    nothing changes.
    """
    def step(state, row):
        remaining, chosen = _none(row[0]), row[1]
        mode, auto = state if state is not None else ("driver", False)
        if chosen is not None:
            mode, auto = chosen, False
        if remaining is not None and mode not in MANUAL_MODES:
            if mode == "driver" and remaining <= enter_m:
                mode, auto = "arrival", True
            elif mode == "arrival" and auto and remaining >= exit_m:
                mode, auto = "driver", True
        return (mode, auto), (mode, auto)
    return step


def repeat_step() -> Step:
    """Say an instruction only when it differs from the last one said.
    Row: (text,); output: (said,)."""
    def step(state, row):
        if row[0] is None:
            return state, (False,)
        return (row[0],), (state is None or state[0] != row[0],)
    return step


def _bearing(a_lat, a_lon, b_lat, b_lon) -> float:
    a, b, turn = math.radians(a_lat), math.radians(b_lat), math.radians(b_lon - a_lon)
    y, x = math.sin(turn) * math.cos(b), math.cos(a) * math.sin(b) - math.sin(a) * math.cos(b) * math.cos(turn)
    return math.degrees(math.atan2(y, x)) % 360.0


# Outputs of ``navigation_step``, and what it reads from a row.
NAVIGATION = ("course DOUBLE, moved_m DOUBLE, effective_heading DOUBLE, effective_source STRING, stored_heading DOUBLE, stored_source STRING, "
              "smoothed DOUBLE, accepted BOOLEAN, emitted BOOLEAN, mode STRING, carried_speed DOUBLE, said BOOLEAN")
NAVIGATION_ROW = ("is_fix", "t", "lat", "lon", "gps_heading", "speed", "remaining_m", "instruction", "sensor_heading", "map_bearing")


def navigation_step(max_sensor_age_s: float = 2.2, tau_ms: float = 300.0, gps_tau_ms: float = 140.0, least_move_m: float = 1.5, reroute: tuple[float, float] = (30.0, 4.0),
                    change: tuple[float, float, float] = (0.12, 0.25, 0.05)) -> Step:
    """Everything a device's live state needs, in one walk over its fixes and
    accepted sensor readings.

    A reading only updates the newest sensor heading and has no output.  A fix
    yields course and distance from the fix before it, the fused heading (fresh
    sensor, else the fix's own, else the map's bearing), the stored and smoothed
    headings, both gates, the arrival mode, the last known speed and whether its
    instruction is said.
    """
    steps = (heading_step(max_sensor_age_s, tau_ms), smoothing_step(gps_tau_ms=gps_tau_ms), reroute_step(*reroute), change_step(*change), arrival_step(), repeat_step())

    def step(state, row):
        is_fix, t, lat, lon, gps, speed, remaining, text, sensor, bearing = (_none(x) for x in row)
        seen, before, spoken_speed, *parts = state if state is not None else (None, None, None, *[None] * len(steps))
        if not is_fix:
            return ((t, sensor), before, spoken_speed, *parts), None
        age = t - seen[0] if seen is not None else None
        fresh = age is not None and age <= max_sensor_age_s
        gps = gps % 360.0 if gps is not None else None
        moved = _dist(*before, lat, lon) if before is not None else None
        course = _bearing(*before, lat, lon) if before is not None and moved >= least_move_m else None
        speed = max(0.0, speed) if speed is not None else None
        inputs = ((t, gps, course if gps is None else None, age), (t, seen[1] if fresh else gps, "sensor" if fresh else "gps"), (t, lat, lon), (gps, lat, lon, speed), (remaining,), (text,))
        parts, outs = zip(*(one(part, given) for one, part, given in zip(steps, parts, inputs)))
        spoken_speed = speed if speed is not None else spoken_speed
        fused = (seen[1], "sensor") if fresh else (gps, "gps") if gps is not None else (bearing % 360.0, "bearing") if bearing is not None else (None, None)
        (stored, source), (smoothed,), (accepted,), (emitted,), (mode,), (said,) = outs
        return (seen, (lat, lon), spoken_speed, *parts), (course, moved, *fused, stored, source, smoothed, accepted, emitted, mode, spoken_speed, said)
    return step


def _out_schema(df: DataFrame, outputs: str) -> StructType:
    return StructType([*df.schema.fields, *[StructField(f.name, f.dataType, True) for f in _parse_datatype_string(outputs).fields]])


def fold_sorted(df: DataFrame, key: str, order: Sequence[str], inputs: Sequence[str], outputs: str, step_factory: Callable[[], Step]) -> DataFrame:
    """Append the outputs of a step walked in order over each key.

    ``inputs`` are numeric or string columns of ``df`` (times as epoch
    seconds); ``outputs`` is a DDL list of the new columns.
    """
    schema = _out_schema(df, outputs)
    names = [f.name for f in _parse_datatype_string(outputs).fields]
    cols = list(inputs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step, current, state = step_factory(), object(), None
        for pdf in batches:
            rows = []
            for k, row in zip(pdf[key], pdf[cols].itertuples(index=False, name=None)):
                if k != current:
                    current, state = k, None
                state, out = step(state, row)
                rows.append(out)
            extra = pd.DataFrame(rows, columns=names, index=pdf.index, dtype=object)
            yield pd.concat([pdf, extra], axis=1)

    return spread(df, key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
