"""Per-place feature Columns and the time-of-day dimension rules."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import col

# Cuisine keywords by ticket tier.
HIGH_TICKET = ["sushi", "steak_house", "steak", "seafood", "korean", "thai", "indian", "japanese",
               "mediterranean", "persian", "vietnamese", "ramen"]
MID_TICKET = ["mexican", "pizza", "burger", "bbq", "chicken", "chinese", "italian"]
LOW_TICKET = ["coffee_shop", "ice_cream", "donut", "sandwich", "bagel", "dessert"]
# The four named merchant classes.
MERCHANT_CLASSES = ["restaurant", "fast_food", "cafe", "food_court"]
# Base weight by building type.
BUILDING_WEIGHT = {"apartments": 1.4, "dormitory": 1.3, "residential": 1.0, "terrace": 0.85,
                   "semidetached_house": 0.85, "house": 0.65, "detached": 0.65}
# Fixed values: (name, label, first hour, last hour exclusive, wI, wM, wR, wD).
TIME_BUCKETS = [
    ("post_midnight", "Post-midnight", 0, 6, 0.15, 0.15, 0.50, 0.20),
    ("morning", "Morning", 6, 11, 0.20, 0.40, 0.30, 0.10),
    ("lunch", "Lunch rush", 11, 14, 0.25, 0.35, 0.25, 0.15),
    ("afternoon", "Afternoon", 14, 17, 0.25, 0.30, 0.25, 0.20),
    ("dinner", "Dinner rush", 17, 20, 0.30, 0.30, 0.20, 0.20),
    ("late_dinner", "Late dinner", 20, 22, 0.30, 0.25, 0.25, 0.20),
    ("late_night", "Late night", 22, 24, 0.20, 0.20, 0.40, 0.20),
]
# Fixed values: (last hour exclusive, merchant weekday, merchant weekend,
# residential weekday, residential weekend), by ascending hour.
DEMAND_BANDS = [
    (6, 0.72, 0.72, 0.88, 0.95), (11, 0.75, 0.75, 0.80, 0.85), (14, 1.15, 1.05, 0.72, 0.80),
    (17, 0.82, 0.82, 0.78, 0.90), (20, 1.15, 1.22, 1.08, 1.22), (22, 0.98, 1.08, 1.02, 1.15),
    (99, 0.82, 0.82, 0.95, 1.05),
]


def is_weekend(dow) -> Column:
    """Sunday is 0, Saturday is 6."""
    return col(dow).isin(0, 6)


def is_late(hour) -> Column:
    return (col(hour) >= 22) | (col(hour) <= 4)


def merchant_weight(amenity, hour) -> Column:
    a = F.lower(F.coalesce(col(amenity), F.lit("")))
    late = is_late(hour)
    return (F.when(a == "fast_food", F.when(late, F.lit(1.3) * 1.25).otherwise(1.3))
            .when(a == "cafe", F.when(late, F.lit(0.8) * 0.6).otherwise(0.8))
            .when(a == "food_court", F.lit(1.15))
            .when((a == "restaurant") & late, F.lit(0.85))
            .otherwise(F.lit(1.0)))


def residential_weight(building, landuse, explicit_weight, hour, dow) -> Column:
    """Explicit positive weight, else the building table, times a time factor."""
    h, weekend = col(hour), is_weekend(dow)
    given = col(explicit_weight).try_cast("double")
    usable = given.isNotNull() & ~F.isnan(given) & (given > 0) & (given < float("inf"))
    b = F.lower(F.coalesce(col(building), F.lit("")))
    table = F.when(b == "apartments", F.lit(BUILDING_WEIGHT["apartments"]))
    for name, w in list(BUILDING_WEIGHT.items())[1:]:
        table = table.when(b == name, F.lit(w))
    table = table.when(F.lower(F.coalesce(col(landuse), F.lit(""))) == "residential", F.lit(0.9)).otherwise(F.lit(0.75))
    factor = (F.when((h >= 17) & (h < 22), F.when(weekend, 1.18).otherwise(1.1))
              .when((h >= 11) & (h < 14), F.when(weekend, 0.95).otherwise(0.85))
              .when((h >= 22) | (h < 5), F.when(weekend, 1.05).otherwise(0.92)).otherwise(1.0))
    return F.when(usable, given).otherwise(table) * factor


def demand_profile(hour, dow) -> tuple[Column, Column]:
    """(merchant, residential) demand multipliers of an hour and weekday."""
    h, weekend = col(hour), is_weekend(dow)
    m, r = F.lit(None).cast("double"), F.lit(None).cast("double")
    for end, mw, me, rw, re in reversed(DEMAND_BANDS):
        m = F.when(h < end, F.when(weekend, me).otherwise(mw)).otherwise(m)
        r = F.when(h < end, F.when(weekend, re).otherwise(rw)).otherwise(r)
    return m, r


def time_bucket(hour) -> Column:
    """Struct(name, label, w_i, w_m, w_r, w_d) of an hour wrapped into a day."""
    h = F.pmod(col(hour), F.lit(24))
    out = None
    for name, label, _start, end, wi, wm, wr, wd in reversed(TIME_BUCKETS):
        s = F.struct(F.lit(name).alias("name"), F.lit(label).alias("label"), F.lit(wi).alias("w_i"),
                     F.lit(wm).alias("w_m"), F.lit(wr).alias("w_r"), F.lit(wd).alias("w_d"))
        out = s if out is None else F.when(h < end, s).otherwise(out)
    return out


def cuisine_list(cuisine) -> Column:
    c = F.lower(F.coalesce(col(cuisine), F.lit("")))
    return F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")


def ticket_index(amenity, cuisine, name) -> Column:
    """Ticket-size proxy in [0.5, 1.3]: amenity base plus the first matching tier."""
    a = F.lower(F.coalesce(col(amenity), F.lit("")))
    n = F.lower(F.coalesce(col(name), F.lit("")))
    cuisines = cuisine_list(cuisine)

    def tier(words: list[str]) -> Column:
        pattern = "|".join(w.replace("_", " ") for w in words)
        return F.arrays_overlap(cuisines, F.array(*[F.lit(w) for w in words])) | n.rlike(pattern)

    base = (F.when(a == "restaurant", 1.0).when(a == "food_court", 0.95).when(a == "cafe", 0.85)
            .when(a == "fast_food", 0.75).otherwise(0.9))
    shift = (F.when(tier(HIGH_TICKET), 0.18).when(tier(MID_TICKET), 0.06)
             .when(tier(LOW_TICKET), -0.08).otherwise(0.0))
    return F.greatest(F.lit(0.5), F.least(F.lit(1.3), base + shift))


def amenity_class(amenity) -> Column:
    a = F.lower(F.coalesce(col(amenity), F.lit("")))
    return F.when(a.isin(*MERCHANT_CLASSES), a).otherwise(F.lit("other"))


def demand_nodes(merchants: DataFrame, residential: DataFrame, params: DataFrame) -> DataFrame:
    """Coverage demand nodes: scaled merchant and residential weights, > 0 only.

    One ``unionByName`` of two narrow projections; ``params`` holds one row per
    view (hour, dow, residential_weight).
    """
    p = params.select("view_id", "hour", "dow", "residential_weight")
    m_scale, r_scale = demand_profile("hour", "dow")
    m = merchants.join(p, "view_id").select(
        "view_id", "id", "lat", "lon",
        (F.greatest(F.lit(0.0), m_scale) * merchant_weight("amenity", "hour")).alias("weight"),
        F.lit("merchant").alias("source_type"))
    scale = F.greatest(F.lit(0.0), F.coalesce(F.col("residential_weight"), F.lit(0.35))) * F.greatest(F.lit(0.0), r_scale)
    r = residential.join(p, "view_id").select(
        "view_id", "id", "lat", "lon",
        (scale * residential_weight("building", "landuse", "place_weight", "hour", "dow")).alias("weight"),
        F.lit("residential").alias("source_type"))
    return m.unionByName(r).where(F.col("weight") > 0)
