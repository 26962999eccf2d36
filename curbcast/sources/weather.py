"""Weather payloads to a flat signal, and its rain lift."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import col

MAX_RAIN_LIFT = 0.25
PAYLOAD_TYPE = ("STRUCT<latitude: DOUBLE, longitude: DOUBLE, current: STRUCT<time: STRING, precipitation: DOUBLE, "
                "rain: DOUBLE, showers: DOUBLE, weather_code: DOUBLE>>")


def _mm(x) -> Column:
    return F.greatest(F.lit(0.0), F.nanvl(F.coalesce(col(x).cast("double"), F.lit(0.0)), F.lit(0.0)))


def rain_lift(mm) -> Column:
    """0.25 * (1 - exp(-mm / 2.5)), within [0, 0.25]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(MAX_RAIN_LIFT), MAX_RAIN_LIFT * (1.0 - F.exp(-_mm(mm) / 2.5))))


def weather_label(code) -> Column:
    """WMO code bands."""
    c = col(code)
    return (F.when(c.isNull(), "conditions unavailable").when(c == 0, "clear").when(c.between(1, 3), "cloudy")
            .when(c.between(51, 57), "drizzle").when(c.between(61, 67), "rain").when(c.between(71, 77), "snow")
            .when(c.between(80, 82), "showers").when(c.between(85, 86), "snow showers")
            .when(c >= 95, "thunderstorm").otherwise("mixed precipitation"))


def weather_signal(payloads: DataFrame, payload: str = "payload", carry: tuple[str, ...] = ()) -> DataFrame:
    w = payloads.select(*carry, F.from_json(payload, PAYLOAD_TYPE).alias("w")).where(F.col("w.current").isNotNull())
    c = "w.current."
    return w.select(*carry, F.col("w.latitude").alias("lat"), F.col("w.longitude").alias("lon"), F.col(c + "time").alias("time"),
                    _mm(F.col(c + "precipitation")).alias("precipitation_mm"), _mm(F.col(c + "rain")).alias("rain_mm"),
                    _mm(F.col(c + "showers")).alias("showers_mm"), F.col(c + "weather_code").cast("int").alias("weather_code"),
                    weather_label(F.col(c + "weather_code")).alias("weather_label"),
                    rain_lift(F.col(c + "precipitation")).alias("rain_boost"))
