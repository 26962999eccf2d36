"""Opening hours as an interval table and an interval join.

Each text is parsed once into rows by SQL string and array functions.  A place
is open unless some readable rule concerns the instant's day and none of them
covers the minute; closed rules never override an open one.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Weekday codes, Monday first.
DAYS = ["Mo", "Tu", "We", "Th", "Fr", "Sa", "Su"]
RANGE_PATTERN = "^([01]?\\d|2[0-3]):([0-5]\\d)-([01]?\\d|2[0-3]):([0-5]\\d)$"


def _day_index(token: Column) -> Column:
    return F.array_position(F.array(*[F.lit(d) for d in DAYS]), token).cast("int") - 1


def _token_days(token: Column) -> Column:
    """Days of 'Mo' or 'Fr-Mo' as an array; null when not understood."""
    parts = F.transform(F.split(token, "-"), lambda x: F.trim(x))
    start, end = _day_index(F.element_at(parts, 1)), _day_index(F.try_element_at(parts, F.lit(2)))
    single = ~F.contains(token, F.lit("-"))
    span = F.pmod(end - start, F.lit(7))
    seq = F.transform(F.sequence(F.lit(0), F.coalesce(F.when(span >= 0, span), F.lit(0))),
                      lambda i: F.pmod(start + i, F.lit(7)))
    return (F.when(single & (start >= 0), F.array(start))
            .when(~single & (start >= 0) & (end >= 0), seq))


def _clock_ranges(text: Column) -> Column:
    """Minute ranges of '10:00-14:00,18:00-02:00'; null if any part is odd."""
    tokens = F.transform(F.split(text, ","), lambda x: F.trim(x))

    def minutes(t: Column, g: int) -> Column:
        return (F.regexp_extract(t, RANGE_PATTERN, g).try_cast("int") * 60
                + F.regexp_extract(t, RANGE_PATTERN, g + 1).try_cast("int"))

    ok = F.forall(tokens, lambda t: t.rlike(RANGE_PATTERN))
    ranges = F.transform(tokens, lambda t: F.struct(minutes(t, 1).alias("start_min"), minutes(t, 3).alias("end_min")))
    return F.when(ok, ranges)


def hour_rules(places: DataFrame, text: str = "opening_hours", keys: tuple[str, ...] = ("view_id", "id")) -> DataFrame:
    """Readable rules: keys, rule_ix, days, ranges (null ranges = closed rule).

    Texts are parsed once per distinct text; the rows of places that share a
    text are joined back.
    """
    t = F.trim(F.col(text))
    distinct = places.select(t.alias("_text")).where(F.col("_text").isNotNull() & (F.col("_text") != "")
                                                     & (F.col("_text") != "24/7")).distinct()
    rules = distinct.select("_text", F.posexplode(F.split("_text", ";")).alias("rule_ix", "_r"))
    rules = rules.withColumn("_r", F.trim("_r")).where(F.col("_r") != "")
    has_digit = F.col("_r").rlike("\\d")
    day_part = F.trim(F.when(has_digit, F.regexp_extract("_r", "^([^\\d]*)", 1)).otherwise(F.col("_r")))
    time_part = F.trim(F.when(has_digit, F.regexp_extract("_r", "^[^\\d]*(.*)$", 1)).otherwise(F.lit("")))
    rules = rules.select("_text", "rule_ix", day_part.alias("_d"), time_part.alias("_t"),
                         F.col("_r").rlike("(?i)\\b(off|closed)\\b").alias("_off"))
    tokens = F.filter(F.transform(F.split("_d", ","), lambda x: F.trim(x)), lambda x: x != "")
    sets = F.transform(tokens, _token_days)
    readable = F.forall(sets, lambda s: s.isNotNull())
    # A day part such as 'Sa off' is not a plain day list, so its rule is void.
    days = F.when(F.col("_d") == "", F.sequence(F.lit(0), F.lit(6))).when(
        readable, F.array_distinct(F.flatten(sets)))
    rules = rules.select("_text", "rule_ix", days.alias("days"), _clock_ranges(F.col("_t")).alias("ranges"),
                         (F.col("_off") & (F.col("_t") == "")).alias("closed"))
    rules = rules.where(F.col("days").isNotNull() & (F.col("closed") | F.col("ranges").isNotNull()))
    return places.select(*keys, t.alias("_text")).join(rules, "_text").drop("_text")


def hour_intervals(rules: DataFrame, keys: tuple[str, ...] = ("view_id", "id")) -> DataFrame:
    """Interval table: one row per (rule, weekday it concerns, minute range).

    ``start_min = end_min = null`` marks a day the rule concerns without any
    open minute of that range.  Overnight ranges give a second row on the next
    day.
    """
    base = rules.select(*keys, "rule_ix", "closed", F.explode("days").alias("osm_day"),
                        F.when(F.col("closed"), F.array(F.struct(F.lit(None).cast("int").alias("start_min"),
                                                                 F.lit(None).cast("int").alias("end_min"))))
                        .otherwise(F.col("ranges")).alias("_rs"))
    rows = base.select(*keys, "rule_ix", "closed", "osm_day", F.explode("_rs").alias("_x"))
    s, e = F.col("_x.start_min"), F.col("_x.end_min")
    day = F.col("osm_day")
    null = F.lit(None).cast("int")

    def piece(d: Column, a: Column, b: Column) -> Column:
        return F.struct(d.cast("int").alias("osm_day"), a.cast("int").alias("start_min"), b.cast("int").alias("end_min"))

    pieces = (F.when(s.isNull(), F.array(piece(day, null, null)))
              .when(s == e, F.array(piece(day, F.lit(0), F.lit(1440))))
              .when(s < e, F.array(piece(day, s, e)))
              .otherwise(F.array(piece(day, s, F.lit(1440)), piece(F.pmod(day + 1, F.lit(7)), F.lit(0), e))))
    return rows.select(*keys, "rule_ix", "closed", F.explode(pieces).alias("_p")).select(
        *keys, "rule_ix", "closed", "_p.osm_day", "_p.start_min", "_p.end_min")


def local_clock(instant, tz=None) -> tuple[Column, Column]:
    """(weekday Monday=0, minute of day) of an instant in its local zone."""
    t = F.col(instant) if isinstance(instant, str) else instant
    if tz is not None:
        t = F.from_utc_timestamp(t, F.col(tz) if isinstance(tz, str) else tz)
    return F.weekday(t), F.hour(t) * 60 + F.minute(t)


def open_at(places: DataFrame, instants: DataFrame, text: str = "opening_hours") -> DataFrame:
    """``places`` x the instants of their view, with ``is_open``.

    ``instants``: view_id, osm_day, minute.  The verdict is made once for each
    (text, day, minute), from the intervals of the distinct texts, and joins
    back by left join, so places without a concerned rule stay and are open.
    """
    inst = instants.select("view_id", F.col("osm_day").cast("int").alias("osm_day"), F.col("minute").cast("int").alias("minute"))
    texts = places.select(F.trim(F.col(text)).alias("_text_key")).where("_text_key is not null").distinct()
    iv = hour_intervals(hour_rules(texts.withColumn("_hours", F.col("_text_key")), "_hours", ("_text_key",)), ("_text_key",))
    hits = iv.join(inst.select("osm_day", "minute").distinct(), "osm_day")
    verdict = hits.groupBy("_text_key", "osm_day", "minute").agg(
        F.max((F.col("minute") >= F.col("start_min")) & (F.col("minute") < F.col("end_min"))).alias("_covers"))
    asked = places.withColumn("_text_key", F.trim(F.col(text))).join(inst, "view_id")
    joined = asked.join(verdict.withColumn("_relevant", F.lit(True)), ["_text_key", "osm_day", "minute"], "left")
    return joined.withColumn("is_open", F.when(F.col("_relevant").isNull(), F.lit(True)).otherwise(
        F.coalesce("_covers", F.lit(False)))).drop("_relevant", "_covers", "_text_key")


def filter_open(places: DataFrame, instants: DataFrame, text: str = "opening_hours") -> DataFrame:
    """Places that are open at the instant of their view."""
    return open_at(places, instants, text).where("is_open").drop("is_open", "osm_day", "minute")
