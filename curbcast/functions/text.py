"""Text Columns: distances, durations, percents, labels, URLs."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalar import clamp01_zero, col, round_half_up


def _int_text(x) -> Column:
    return col(x).cast("bigint").cast("string")


def distance_text(meters) -> Column:
    """Miles from one mile up (no decimal from ten miles up), else metres."""
    m = F.greatest(F.lit(0.0), F.nanvl(F.coalesce(col(meters).cast("double"), F.lit(0.0)), F.lit(0.0)))
    mi = m / 1609.344
    return (F.when(m >= 16093, F.concat(F.format_string("%.0f", mi), F.lit(" mi")))
            .when(m >= 1609.344, F.concat(F.format_string("%.1f", mi), F.lit(" mi")))
            .otherwise(F.concat(_int_text(round_half_up(m)), F.lit(" m"))))


def duration_text(seconds) -> Column:
    s = F.nanvl(F.coalesce(col(seconds).cast("double"), F.lit(0.0)), F.lit(0.0))
    total = F.greatest(F.lit(1).cast("bigint"), round_half_up(s / 60.0))
    hours, minutes = F.floor(total / 60.0), total % 60
    return (F.when(hours <= 0, F.concat(_int_text(total), F.lit(" min")))
            .when(minutes == 0, F.concat(_int_text(hours), F.lit(" hr")))
            .otherwise(F.concat(_int_text(hours), F.lit(" hr "), _int_text(minutes), F.lit(" min"))))


def compact_duration_text(seconds) -> Column:
    s = F.abs(round_half_up(F.coalesce(col(seconds).cast("double"), F.lit(0.0))))
    return F.when(s < 90, F.concat(_int_text(s), F.lit(" sec"))).otherwise(duration_text(s))


def duration_delta_text(seconds) -> Column:
    d = round_half_up(F.coalesce(col(seconds).cast("double"), F.lit(0.0)))
    return (F.when(d == 0, F.lit("ETA unchanged"))
            .otherwise(F.concat(compact_duration_text(d), F.lit(" "),
                                F.when(d < 0, "faster").otherwise("slower"))))


def distance_delta_text(meters) -> Column:
    d = round_half_up(F.coalesce(col(meters).cast("double"), F.lit(0.0)))
    return (F.when(d == 0, F.lit("distance unchanged"))
            .otherwise(F.concat(distance_text(F.abs(d)), F.lit(" "),
                                F.when(d < 0, "shorter").otherwise("longer"))))


def percent_text(x) -> Column:
    return F.concat(_int_text(round_half_up(clamp01_zero(x) * 100.0)), F.lit("%"))


def range_text(low, high) -> Column:
    return F.concat(percent_text(low), F.lit(" - "), percent_text(high))


def points_delta_text(delta) -> Column:
    """Score difference in points against the current place."""
    d = col(delta)
    pts = round_half_up(F.abs(d) * 100.0)
    return (F.when(d.isNull() | F.isnan(d), "score delta unavailable")
            .when(pts == 0, "field is effectively tied")
            .otherwise(F.concat(F.when(d > 0, "+").otherwise("-"), _int_text(pts),
                                F.lit(" pts versus here"))))


def out_of_100_text(x) -> Column:
    return F.concat(_int_text(round_half_up(col(x) * 100.0)), F.lit("/100"))


def tag_label(value) -> Column:
    """'fast_food' -> 'Fast Food'; the tail of each word keeps its case."""
    words = F.filter(F.split(F.replace(F.trim(F.coalesce(col(value), F.lit(""))), F.lit("_"), F.lit(" ")), " "),
                     lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(
        F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def absolute_url(url) -> Column:
    """Trimmed URL with a scheme; null when blank."""
    raw = F.trim(F.coalesce(col(url), F.lit("")))
    return (F.when(raw == "", F.lit(None).cast("string"))
            .when(raw.rlike("(?i)^https?://"), raw)
            .otherwise(F.concat(F.lit("https://"), F.regexp_replace(raw, "^/+", ""))))


def host_label(url) -> Column:
    """Host of a URL without a leading ``www.``; text that does not parse keeps
    its tail after the scheme."""
    u = col(url)
    host = F.try_parse_url(u, F.lit("HOST"))
    return F.when(u.isNull() | (u == ""), F.lit(None).cast("string")).otherwise(
        F.coalesce(F.regexp_replace(F.lower(host), "^www\\.", ""),
                   F.regexp_replace(u, "(?i)^https?://", "")))


def is_yes_tag(value) -> Column:
    return F.coalesce(F.lower(F.trim(col(value))).isin("yes", "only", "designated", "true"), F.lit(False))


def relative_time_text(then_ts, now_ts) -> Column:
    """'5 min ago' style text; missing times read 'Not yet'."""
    s = F.greatest(F.lit(0.0), col(now_ts).cast("timestamp").cast("double")
                   - col(then_ts).cast("timestamp").cast("double"))

    def unit(seconds: float, name: str) -> Column:
        n = F.greatest(F.lit(1).cast("bigint"), round_half_up(s / seconds))
        return F.concat(_int_text(n), F.lit(f" {name} ago"))

    return (F.when(col(then_ts).isNull(), "Not yet").when(s < 3600, unit(60.0, "min"))
            .when(s < 86400, unit(3600.0, "hr")).otherwise(unit(86400.0, "day")))
