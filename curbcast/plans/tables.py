"""Derived tables: courier-shaped views over the star-schema test tables.

The texts run unchanged on Spark SQL and on DuckDB; only the base table names
differ.  Coordinates come from keys by integer arithmetic.  A view holds 500
merchants, 25 lots and 375 homes and the number of views grows with the data,
as it would with the area covered.  A market holds the drivers and one month of
orders of a customer block, so markets grow in number too.
"""
from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
        "pages", "benchmark", "labels", "conversations")


def view_of(key: str, per_view: int) -> str:
    return f"CAST(floor({key} / {per_view}e0) AS BIGINT)"


def lat(key: str, view: str) -> str:
    return f"(3.406e1 + (({view}) % 100) / 1e1 + CAST((({key}) * 7919) % 9973 AS DOUBLE) / 9.973e3 * 9e-2)"


def lon(key: str, view: str) -> str:
    return (f"(-1.1764e2 + (CAST(floor(({view}) / 1e2) AS BIGINT) % 600) / 1e1"
            f" + CAST((({key}) * 6007) % 9967 AS DOUBLE) / 9.967e3 * 9e-2)")


def _place(key: str, view: str, shift: int = 0) -> str:
    k = f"{key} + {shift}" if shift else key
    return f"{lat(k, view)} AS lat, {lon(k, view)} AS lon"


_PV, _SV, _CV = view_of("p_partkey", 500), view_of("s_suppkey", 25), view_of("c_custkey", 375)
_OV = view_of("o_custkey", 375)
_MONTH = "((extract(year FROM o_orderdate) - 1995) * 12 + extract(month FROM o_orderdate) - 1)"

TABLES: dict[str, str] = {
    "merchants_v": f"""SELECT {_PV} AS view_id, 'node/' || CAST(p_partkey AS VARCHAR(20)) AS id, p_partkey AS ingest_ix, {_place('p_partkey', _PV)},
  CASE p_size % 4 WHEN 0 THEN 'restaurant' WHEN 1 THEN 'fast_food' WHEN 2 THEN 'cafe' ELSE 'food_court' END AS amenity,
  CASE p_type WHEN 'ECONOMY' THEN 'burger' WHEN 'SMALL' THEN 'coffee_shop' WHEN 'MEDIUM' THEN 'thai;sushi' WHEN 'PROMO' THEN 'pizza' WHEN 'LARGE' THEN 'steak_house' END AS cuisine,
  CASE WHEN p_partkey % 11 = 0 THEN 'Corner Steak House' WHEN p_partkey % 13 = 0 THEN 'Ice Cream Bar' ELSE p_name END AS name,
  CASE p_partkey % 8 WHEN 1 THEN '24/7' WHEN 2 THEN 'Mo-Su 10:00-22:00' WHEN 3 THEN 'Mo-Su 18:00-02:00' WHEN 4 THEN 'Mo-Fr 09:00-17:00; Sa off' WHEN 5 THEN 'by appointment' WHEN 6 THEN 'Fr-Mo 11:00-14:00,17:00-22:00; We 08:00-08:00' WHEN 7 THEN 'Sa,Su 06:00-24:00; Mo closed; Tu-Th 20:00-04:00' END AS opening_hours,
  CASE WHEN p_partkey % 3 = 0 THEN 'yes' END AS delivery, CASE WHEN p_partkey % 5 = 0 THEN 'only' WHEN p_partkey % 5 = 1 THEN 'no' END AS takeaway, CASE WHEN p_partkey % 4 = 0 THEN 'yes' END AS drive_through,
  CASE p_partkey % 4 WHEN 0 THEN 'www.shop' || CAST(p_partkey AS VARCHAR(20)) || '.example/menu' WHEN 1 THEN 'https://www.eat' || CAST(p_partkey AS VARCHAR(20)) || '.example' END AS website,
  CASE WHEN p_partkey % 2 = 0 THEN ' 555-' || CAST(p_partkey AS VARCHAR(20)) END AS phone, CAST(p_size AS VARCHAR(20)) AS addr_housenumber, p_brand AS addr_street,
  CASE WHEN p_partkey % 3 <> 1 THEN 'Town' || CAST(p_size % 7 AS VARCHAR(20)) END AS addr_city
FROM part""",
    "parking_v": f"""SELECT {_SV} AS view_id, 'way/' || CAST(s_suppkey AS VARCHAR(20)) AS id, s_suppkey AS ingest_ix, {_place('s_suppkey', _SV, 31)},
  CASE WHEN s_suppkey % 6 <> 0 THEN s_name END AS name FROM supplier""",
    "residential_v": f"""SELECT {_CV} AS view_id, 'way/h' || CAST(c_custkey AS VARCHAR(20)) AS id, c_custkey AS ingest_ix, {_place('c_custkey', _CV, 77)},
  CASE c_mktsegment WHEN 'BUILDING' THEN 'apartments' WHEN 'HOUSEHOLD' THEN 'house' WHEN 'FURNITURE' THEN 'terrace' WHEN 'AUTOMOBILE' THEN 'dormitory' END AS building,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'residential' END AS landuse, CASE WHEN c_custkey % 10 = 0 THEN '1.467' WHEN c_custkey % 10 = 1 THEN 'n/a' END AS place_weight FROM customer""",
    "views_v": f"""SELECT view_id, 3.406e1 + (view_id % 100) / 1e1 AS south, 3.415e1 + (view_id % 100) / 1e1 AS north,
  -1.1764e2 + (CAST(floor(view_id / 1e2) AS BIGINT) % 600) / 1e1 AS west, -1.1755e2 + (CAST(floor(view_id / 1e2) AS BIGINT) % 600) / 1e1 AS east,
  CAST(CASE view_id % 4 WHEN 0 THEN 12 WHEN 1 THEN 18 WHEN 2 THEN 22 ELSE 2 END AS INT) AS hour, CAST(CASE view_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 6 ELSE 0 END AS INT) AS dow,
  CAST(CASE view_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 5 ELSE 6 END AS INT) AS osm_day, CAST(CASE view_id % 4 WHEN 0 THEN 750 WHEN 1 THEN 1110 WHEN 2 THEN 1325 ELSE 95 END AS INT) AS minute,
  1.2e3 AS tau, 3.5e-1 AS competition_strength, 3.5e-1 AS residential_weight, (view_id % 2) * 2e-1 AS rain_boost, 5.5e-1 AS tip_emphasis,
  CASE view_id % 3 WHEN 0 THEN 'legacy' WHEN 1 THEN 'softplus' ELSE 'glm' END AS prediction_model, false AS use_ml, 2e0 AS ml_beta, 3.5e2 AS grid_step, 1.2e3 AS coverage_tau
FROM (SELECT DISTINCT {_PV} AS view_id FROM part) d""",
    "drivers_v": f"""SELECT {view_of('s_suppkey', 4)} * 1000 + m.month_ix AS market_id, 'd' || CAST(s_suppkey AS VARCHAR(20)) AS id, s_suppkey AS ingest_ix, {_place('s_suppkey', '0')},
  CAST((s_suppkey * 31) % 360 AS DOUBLE) AS heading_deg, CAST(s_suppkey % 20 AS DOUBLE) AS speed_mps,
  CASE s_suppkey % 5 WHEN 0 THEN 'parked' WHEN 1 THEN 'SLOW' WHEN 2 THEN 'driving_away' WHEN 3 THEN 'high_speed' ELSE 'unknown' END AS motion_state,
  CAST(s_suppkey % 7 AS DOUBLE) AS available_at_min, CASE WHEN s_suppkey % 9 = 8 THEN 0 ELSE 1 + s_suppkey % 2 END AS capacity
FROM supplier JOIN (SELECT DISTINCT {view_of('o_custkey', 60)} AS block, CAST({_MONTH} AS BIGINT) AS month_ix FROM orders) m ON m.block = {view_of('s_suppkey', 4)}""",
    "orders_v": f"""SELECT {view_of('o_custkey', 60)} * 1000 + CAST({_MONTH} AS BIGINT) AS market_id, 'o' || CAST(o_orderkey AS VARCHAR(20)) AS id, o_orderkey AS ingest_ix,
  {lat('o_custkey', '0')} AS pickup_lat, {lon('o_custkey', '0')} AS pickup_lon, CASE WHEN o_orderkey % 50 = 49 THEN NULL ELSE {lat('o_orderkey + 13', '0')} END AS dropoff_lat, {lon('o_orderkey + 13', '0')} AS dropoff_lon,
  CAST(o_orderkey % 20 AS DOUBLE) AS prep_time_min, (o_orderkey % 10) / 1e1 AS parking_friction, CAST(o_orderkey % 5 AS DOUBLE) AS customer_wait_min, CAST(o_orderkey % 3 AS DOUBLE) AS created_at_min FROM orders""",
    "fixes_v": f"""SELECT event_id, user_id AS device_id, ts, {_place('event_id', '0')}, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST((event_id * 37) % 720 - 90 AS DOUBLE) END AS gps_heading,
  CASE WHEN event_id % 4 = 1 THEN NULL ELSE value / 5e1 - 1e-1 END AS speed, CAST(5 + event_id % 60 AS DOUBLE) AS accuracy, CAST((event_id * 91) % 700 AS DOUBLE) AS remaining_m,
  CASE event_id % 5 WHEN 0 THEN 'Turn left' WHEN 1 THEN 'Turn left' WHEN 2 THEN 'Keep right' WHEN 3 THEN NULL ELSE 'Arrive at your destination' END AS instruction
FROM events WHERE event_type NOT IN ('click', 'view')""",
    "readings_v": """SELECT event_id, user_id AS device_id, ts, CASE WHEN event_id % 4 < 2 THEN CAST((event_id * 53) % 360 AS DOUBLE) END AS compass_heading,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 45 AS DOUBLE) END AS compass_accuracy, CASE WHEN event_id % 4 = 2 THEN 'deviceorientationabsolute' ELSE 'deviceorientation' END AS type,
  false AS absolute, CAST((event_id * 71) % 360 AS DOUBLE) AS alpha FROM events WHERE event_type IN ('click', 'view')""",
    "history_v": """SELECT event_id, user_id, event_id % 50 AS place_id, CASE WHEN event_type = 'purchase' THEN 'route' ELSE 'open' END AS kind, ts,
  'Place ' || CAST(event_id % 50 AS VARCHAR(20)) || ' v' || CAST(event_id AS VARCHAR(20)) AS title FROM events""",
    "predictions_v": """SELECT d.doc_id, (d.n_chars % 1000) / 1e3 AS probability, CAST(l.quality AS DOUBLE) AS label, CAST(1 + d.doc_id % 3 AS DOUBLE) AS weight, d.lang, d.source FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "weather_v": f"""SELECT event_id, ts, {_place('event_id % 400', '0')}, value / 1e2 AS precipitation, CAST(event_id % 100 AS INT) AS weather_code FROM events WHERE event_type = 'error'""",
    "routes_v": f"""SELECT o_orderkey AS route_id, o_custkey AS trip_id, o_orderdate AS ts, {_OV} AS view_id, 'r' || CAST(o_orderkey AS VARCHAR(20)) AS point_id,
  {lat('o_custkey', _OV)} AS from_lat, {lon('o_custkey', _OV)} AS from_lon, {lat('o_orderkey + 13', _OV)} AS lat, {lon('o_orderkey + 13', _OV)} AS lon,
  CAST((o_orderkey * 37) % 5000 AS DOUBLE) AS distance_m, CAST((o_orderkey * 91) % 1800 AS DOUBLE) AS duration_s, o_orderkey % 40 + 0e0 AS first_m, o_orderkey % 90 + 0e0 AS second_m,
  CASE o_orderkey % 9 WHEN 0 THEN 'turn' WHEN 1 THEN 'merge' WHEN 2 THEN 'on ramp' WHEN 3 THEN 'roundabout' WHEN 4 THEN 'end of road' WHEN 5 THEN 'fork' WHEN 6 THEN 'new name' WHEN 7 THEN 'off_ramp' ELSE 'continue' END AS turn_type,
  CASE o_orderkey % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'slight right' WHEN 2 THEN 'straight' END AS turn_modifier,
  CASE o_orderkey % 5 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'straight' WHEN 3 THEN 'sharp right' END AS arrive_modifier,
  CAST(o_orderkey % 6 AS INT) AS lanes, CAST(o_orderkey % 5 AS INT) AS entries, CAST((o_orderkey * 17) % 360 AS DOUBLE) AS bearing_before,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST((o_orderkey * 29) % 360 AS DOUBLE) END AS bearing_after, CAST(o_orderkey % 4 AS INT) AS exit_no,
  CASE WHEN o_orderkey % 7 = 0 THEN 'left' ELSE 'right' END AS driving_side, CASE WHEN o_orderkey % 6 <> 5 THEN o_orderpriority END AS road, (o_orderkey % 8 = 0) AS same_end FROM orders""",
}


def depends_on(text: str, names) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", text))
    return [n for n in names if n in words]


class Tables:
    """Lazy DataFrames of the base and derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def derived(self, name: str) -> DataFrame:
        text = TABLES[name].replace("VARCHAR(20)", "STRING")
        for b in depends_on(text, BASE):
            text = re.sub(rf"\b(FROM|JOIN)\s+{b}\b", rf"\1 parquet.`{self.sf_dir}/{b}.parquet`", text)
        return self.spark.sql(text)

    @cached_property
    def orders_derived(self) -> DataFrame:
        return self.derived("orders_v")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name + "_v" in TABLES:
            df = self.derived(name + "_v")
        elif name in BASE:
            df = self.base(name)
        else:
            raise AttributeError(name)
        self.__dict__[name] = df
        return df

    @cached_property
    def clamped_views(self) -> DataFrame:
        from ..operators.predicates import clamp_views
        return clamp_views(self.views)

    @cached_property
    def local_fixes(self) -> DataFrame:
        return self.fixes.withColumn("ts", F.col("ts").cast("timestamp"))
