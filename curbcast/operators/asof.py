"""As-of joins and carry-forwards that do not need one task per key.

A key's rows are cut into time buckets.  Windows run inside (key, bucket); what
a bucket needs from earlier ones is a tiny per-bucket summary.  A device with a
third of all rows is therefore spread over as many tasks as it has buckets.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

DAY = 86400


def _bucket(ts: str, seconds: float) -> Column:
    return F.floor(F.col(ts).cast("timestamp").cast("double") / float(seconds)).cast("bigint")


def asof_latest(left: DataFrame, right: DataFrame, key: str, ts: str, payload: Sequence[str],
                tolerance_s: float, right_ts: str = "matched_ts") -> DataFrame:
    """Latest right row at or before each left row, no older than the tolerance.

    Both sides are unioned; a right row is placed in its bucket of one
    tolerance width and the next one, so every answer is inside one
    (key, bucket) window.  Of right rows with one key and time the one with the
    greatest payload, field by field, is taken.
    """
    sec = F.col(ts).cast("timestamp").cast("double")
    pay = F.struct(F.col(ts).alias(right_ts), *[F.col(c) for c in payload])
    r = right.select(key, ts, pay.alias("_pay"))
    first = _bucket(ts, tolerance_s)
    r = r.select(key, ts, "_pay", F.explode(F.array(first, first + 1)).alias("_b"), F.lit(0).alias("_side"))
    kept = [c for c in left.columns if c not in (key, ts)]
    l = left.select(key, ts, F.struct(*kept).alias("_row"), _bucket(ts, tolerance_s).alias("_b"), F.lit(1).alias("_side"))
    u = l.unionByName(r, allowMissingColumns=True)
    w = (Window.partitionBy(key, "_b").orderBy(F.asc(ts), F.asc("_side"), F.asc("_pay"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    m = u.withColumn("_m", F.last("_pay", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    age = sec - F.col(f"_m.{right_ts}").cast("timestamp").cast("double")
    fresh = age <= F.lit(float(tolerance_s))
    return m.select(key, ts, *[F.col(f"_row.{c}").alias(c) for c in kept],
                    *[F.when(fresh, F.col(f"_m.{c}")).alias(c) for c in [right_ts, *payload]])


def _with_tails(rows: DataFrame, tails: DataFrame, key: str) -> DataFrame:
    """Join a bucket's summary to its rows; rows of a null key or time have one too."""
    t = tails.select(F.col(key).alias("_key"), F.col("_b").alias("_bucket"), "_tail")
    return rows.join(t, rows[key].eqNullSafe(t["_key"]) & rows["_b"].eqNullSafe(t["_bucket"])).drop("_key", "_bucket")


def previous_row(df: DataFrame, key: str, ts: str, tie: str, cols: Sequence[str], bucket_s: float = DAY) -> DataFrame:
    """Adds ``prev_<col>`` from the preceding row of the key (by ts, tie)."""
    b = df.withColumn("_b", _bucket(ts, bucket_s))
    pay = F.struct(*[F.col(c) for c in cols])
    w = Window.partitionBy(key, "_b").orderBy(F.asc(ts), F.asc(tie))
    inner = b.withColumn("_p", F.lag(pay).over(w)).withColumn("_rn", F.row_number().over(w))
    tails = b.groupBy(key, "_b").agg(F.max_by(pay, F.struct(ts, tie)).alias("_tail"))
    tails = tails.withColumn("_tail", F.lag("_tail").over(Window.partitionBy(key).orderBy("_b")))
    out = _with_tails(inner, tails, key)
    p = F.when(F.col("_rn") == 1, F.col("_tail")).otherwise(F.col("_p"))
    return out.withColumn("_prev", p).select(*df.columns, *[F.col(f"_prev.{c}").alias(f"prev_{c}") for c in cols])


def carry_forward(df: DataFrame, key: str, ts: str, tie: str, value: str, out: str, bucket_s: float = DAY) -> DataFrame:
    """Last non-null ``value`` up to and including each row."""
    b = df.withColumn("_b", _bucket(ts, bucket_s))
    w = (Window.partitionBy(key, "_b").orderBy(F.asc(ts), F.asc(tie))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = b.withColumn("_in", F.last(value, ignorenulls=True).over(w))
    tails = b.groupBy(key, "_b").agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(ts, tie))).alias("_tail"))
    wb = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.withColumn("_tail", F.last("_tail", ignorenulls=True).over(wb))
    return _with_tails(inner, tails, key).withColumn(out, F.coalesce("_in", "_tail")).select(*df.columns, out)


def weather_for(rows: DataFrame, weather: DataFrame, max_age_s: float = 600.0) -> DataFrame:
    """Weather of a 0.01-degree cell, no older than the cache lifetime."""
    from ..functions.geo import rounded_coordinate
    cell = F.concat_ws(",", rounded_coordinate("lat", 2).cast("string"), rounded_coordinate("lon", 2).cast("string"))
    l = rows.withColumn("weather_cell", cell)
    r = weather.withColumn("weather_cell", cell).select("weather_cell", "ts", "precipitation_mm", "weather_label", "rain_boost")
    return asof_latest(l, r, "weather_cell", "ts", ["precipitation_mm", "weather_label", "rain_boost"], max_age_s, "weather_ts")


def fuse_headings(fixes: DataFrame, readings: DataFrame, max_age_s: float = 2.2) -> DataFrame:
    """Effective heading per fix: fresh sensor, else stored, else map bearing.

    ``fixes``: device_id, ts, stored_heading, stored_source, map_bearing.
    ``readings``: device_id, ts, sensor_heading (accepted readings only).
    """
    from ..functions.geo import normalize_heading
    j = asof_latest(fixes, readings, "device_id", "ts", ["sensor_heading"], max_age_s, "sensor_at")
    sensor, stored, bearing = (normalize_heading(c) for c in ("sensor_heading", "stored_heading", "map_bearing"))
    usable = stored.isNotNull() & ~F.col("stored_source").eqNullSafe("sensor")
    return j.withColumns({
        "effective_heading": F.coalesce(sensor, F.when(usable, stored), bearing),
        "heading_source": F.when(sensor.isNotNull(), "sensor")
        .when(usable, F.coalesce("stored_source", F.lit("stored"))).when(bearing.isNotNull(), "bearing"),
        "sensor_age_s": F.col("ts").cast("timestamp").cast("double") - F.col("sensor_at").cast("timestamp").cast("double"),
    })
