"""Registered queries: landed payload sources, scans, unions, audit sink."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..checkpoints import stage_path
from ..operators import predicates
from ..operators.hours import local_clock
from ..operators.stats import upper_rank
from ..sources import places as src
from ..sources import routes as rsrc
from ..sources import sinks, weather
from .oracle import r, rc
from .queries_features import _WMO
from .queries_field import _AUDIT_SQL, _GLM, _audit
from .registry import big, query, r6
from .tables import Tables


def _tags(**kv: Column) -> Column:
    """Tag map without missing values."""
    pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in kv]), F.array(*kv.values()))
    return F.map_filter(pairs, lambda _k, v: v.isNotNull())


def _all_places(t: Tables) -> DataFrame:
    """Merchants, lots and homes as one tagged place table."""
    c = F.col
    m = t.merchants.select("view_id", "id", "lat", "lon", _tags(amenity=c("amenity"), cuisine=c("cuisine"), name=c("name"), opening_hours=c("opening_hours")).alias("tags"))
    p = t.parking.select("view_id", "id", "lat", "lon", F.when(c("ingest_ix") % 3 == 0, _tags(parking=F.lit("surface"), amenity=F.when(c("ingest_ix") % 2 == 0, "parking")))
                         .otherwise(_tags(amenity=F.lit("parking"))).alias("tags"))
    h = t.residential.select("view_id", "id", "lat", "lon", _tags(building=c("building"), landuse=c("landuse"), anchor_weight=c("place_weight")).alias("tags"))
    return m.unionByName(p).unionByName(h)


def _in_boxes(t: Tables, df: DataFrame) -> DataFrame:
    return predicates.in_views(df, t.clamped_views)


@query("src_1_merchant_scan", "SELECT view_id, id, amenity FROM boxed_merchants")
def _(t: Tables) -> DataFrame:
    p = src.promote_tags(_all_places(t))
    return _in_boxes(t, p.where(src.is_merchant())).select("view_id", "id", "amenity")


@query("src_2_parking_scan", "SELECT view_id, id FROM boxed_parking")
def _(t: Tables) -> DataFrame:
    return _in_boxes(t, _all_places(t).where(src.is_parking())).select("view_id", "id")


@query("src_3_residential_scan", "SELECT view_id, id, place_weight FROM boxed_homes WHERE building IS NOT NULL OR landuse = 'residential'")
def _(t: Tables) -> DataFrame:
    p = src.promote_tags(_all_places(t))
    return _in_boxes(t, p.where(src.is_residential())).select("view_id", "id", "place_weight")


@query("src_4_element_flattening", f"""SELECT view_id, 'node/' || ingest_ix AS id, {rc('lat')}, {rc('lon')}, amenity FROM merchants_v UNION ALL
 SELECT view_id, 'way/' || ingest_ix, {r('lat + 1e-3')}, {r('lon')}, NULL FROM merchants_v WHERE ingest_ix % 4 <> 0""")
def _(t: Tables) -> DataFrame:
    """Each merchant lands as a document with a node, a way and a relation."""
    c = F.col
    null = F.lit(None).cast("double")

    def element(kind: str, lat: Column, lon: Column, center: Column, tags: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), c("ingest_ix").alias("id"), lat.alias("lat"), lon.alias("lon"), center.alias("center"), tags.alias("tags"))

    none = F.lit(None).cast("struct<lat:double,lon:double>")
    no_tags = F.lit(None).cast("map<string,string>")
    center = F.when(c("ingest_ix") % 4 != 0, F.struct((c("lat") + 1e-3).alias("lat"), c("lon").alias("lon")))
    docs = t.merchants.select("view_id", F.to_json(F.struct(F.array(
        element("node", c("lat"), c("lon"), none, _tags(amenity=c("amenity"))), element("way", null, null, center, no_tags),
        element("relation", null, null, center, no_tags)).alias("elements"))).alias("payload"))
    out = src.promote_tags(src.flatten_elements(docs, carry=("view_id",)))
    return out.select("view_id", "id", r6("lat"), r6("lon"), "amenity")


def _census_docs(t: Tables) -> DataFrame:
    c = F.col
    anchor = F.struct(F.concat(F.lit("census-tract/"), c("ingest_ix").cast("string")).alias("id"), c("lat"), c("lon"), _tags(source=F.lit("census"), anchor_weight=c("place_weight")).alias("tags"))
    v = t.views.select("view_id", *[F.col(x).alias(f"v_{x}") for x in ("south", "west", "north", "east")])
    declared = F.when(c("view_id") % 2 == 0, F.struct((c("v_south") + 0.02).alias("south"), c("v_west").alias("west"), c("v_north").alias("north"), c("v_east").alias("east")))
    return t.residential.join(v, "view_id").select("view_id", F.to_json(F.struct(F.struct(F.lit("demo tracts").alias("dataset")).alias("source"), declared.alias("bounds"), F.array(anchor).alias("anchors"))).alias("payload"))


@query("src_5_census_anchors", "SELECT h.view_id, 'census-tract/' || h.ingest_ix AS id, h.place_weight AS weight FROM boxed_homes h")
def _(t: Tables) -> DataFrame:
    a = src.census_anchors(_census_docs(t), carry=("view_id",))
    got = src.census_in_views(a, t.clamped_views, src.dataset_bounds(a, ("view_id",)))
    return got.select("view_id", "id", F.col("tags")["anchor_weight"].alias("weight"))


_BOUNDS = f"SELECT h.view_id, {rc('CASE WHEN h.view_id % 2 = 0 THEN min(v.south) + 2e-2 ELSE min(h.lat) END', 'south')}, {rc('CASE WHEN h.view_id % 2 = 0 THEN min(v.west) ELSE min(h.lon) END', 'west')}, {rc('CASE WHEN h.view_id % 2 = 0 THEN max(v.north) ELSE max(h.lat) END', 'north')}, {rc('CASE WHEN h.view_id % 2 = 0 THEN max(v.east) ELSE max(h.lon) END', 'east')} FROM residential_v h JOIN views_v v ON v.view_id = h.view_id GROUP BY h.view_id"


def _bounds(t: Tables) -> DataFrame:
    b = src.dataset_bounds(src.census_anchors(_census_docs(t), carry=("view_id",)), ("view_id",))
    return b.select("view_id", *[r6(c) for c in ("south", "west", "north", "east")])


query("src_6_dataset_bounds", _BOUNDS)(_bounds)
query("agg_12_dataset_bounds", _BOUNDS)(_bounds)


@query("src_7_weather_signal", f"SELECT event_id, {rc('precipitation', 'precipitation_mm')}, CASE WHEN event_id % 3 = 0 THEN 0e0 ELSE {r('precipitation / 2')} END AS rain_mm, 0e0 AS showers_mm, weather_code, {_WMO} AS weather_label, {rc('least(2.5e-1, greatest(0e0, 2.5e-1 * (1 - exp(-precipitation / 2.5e0))))', 'rain_boost')} FROM weather_v")
def _(t: Tables) -> DataFrame:
    c = F.col
    cur = F.struct(c("ts").cast("string").alias("time"), c("precipitation"), F.when(c("event_id") % 3 != 0, c("precipitation") / 2).alias("rain"), F.lit(-1.0).alias("showers"), c("weather_code"))
    docs = t.weather.select("event_id", F.to_json(F.struct(c("lat").alias("latitude"), c("lon").alias("longitude"), cur.alias("current"))).alias("payload"))
    w = weather.weather_signal(docs, carry=("event_id",))
    return w.select("event_id", r6("precipitation_mm"), r6("rain_mm"), "showers_mm", "weather_code", "weather_label", r6("rain_boost"))


@query("src_8_route_payloads", "SELECT route_id, distance_m, coalesce(CASE WHEN route_id % 3 <> 0 THEN duration_s END, 0) AS duration_s, 3 AS step_count, 2 AS point_count, turn_type AS second_type FROM routes_v WHERE route_id % 10 <> 9")
def _(t: Tables) -> DataFrame:
    c = F.col

    def step(kind: Column) -> Column:
        return F.struct(c("road").alias("name"), F.struct(kind.alias("type")).alias("maneuver"))

    legs = F.array(F.struct(F.array(step(F.lit("depart")), step(c("turn_type"))).alias("steps")), F.struct(F.array(step(F.lit("arrive"))).alias("steps")))
    line = F.when(c("route_id") % 10 != 9, F.array(F.array("from_lon", "from_lat"), F.array("lon", "lat")))
    one = F.struct(c("distance_m").alias("distance"), F.when(c("route_id") % 3 != 0, c("duration_s")).alias("duration"), F.struct(line.alias("coordinates")).alias("geometry"), legs.alias("legs"))
    docs = t.routes.select("route_id", F.to_json(F.struct(F.array(one, one).alias("routes"))).alias("payload"))
    p = rsrc.parse_routes(docs, carry=("route_id",))
    return p.select("route_id", "distance_m", "duration_s", big(F.size("steps"), "step_count"), big(F.size("coordinates"), "point_count"), c("steps")[1]["maneuver"]["type"].alias("second_type"))


def _queries(t: Tables) -> DataFrame:
    """Customers as geocode queries: name, segment and nation make the place text."""
    n = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return t.base("customer").join(n, "c_nationkey").select(F.col("c_custkey").alias("query_id"), F.concat_ws(", ", "c_name", "c_mktsegment", "n_name").alias("place"), "c_name", "c_acctbal")


def _feature_docs(t: Tables) -> DataFrame:
    c = F.col
    xy = F.when(c("query_id") % 3 != 0, F.array(c("c_acctbal") / 100, c("c_acctbal") / 200))
    one = F.struct(F.when(c("query_id") % 2 == 0, xy).alias("center"), F.struct(xy.alias("coordinates")).alias("geometry"), c("place").alias("place_name"))
    return _queries(t).select("query_id", F.to_json(F.struct(F.array(one).alias("features"))).alias("payload"))


def _row_docs(t: Tables) -> DataFrame:
    c = F.col
    one = F.struct((c("c_acctbal") / 50).cast("string").alias("lat"), F.when(c("query_id") % 5 != 0, (c("c_acctbal") / 40).cast("string")).alias("lon"), c("c_name").alias("display_name"))
    return _queries(t).select("query_id", F.to_json(F.array(one)).alias("payload"))


_Q = {"qs": "SELECT c_custkey AS query_id, c_name, c_mktsegment, n_name, c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey",
      "prim": f"SELECT query_id, {r('c_acctbal / 200')} AS lat, {r('c_acctbal / 100')} AS lng, c_name AS title, c_mktsegment || ', ' || n_name AS subtitle FROM qs WHERE query_id % 3 <> 0",
      "sec": f"SELECT query_id, {r('c_acctbal / 50')} AS lat, {r('c_acctbal / 40')} AS lng, c_name AS title, 'Mapped location' AS subtitle FROM qs WHERE query_id % 5 <> 0"}


def _pick(df: DataFrame) -> DataFrame:
    return df.select("query_id", r6("lat"), r6("lng"), "title", "subtitle")


@query("src_9_geocode_features", "SELECT * FROM prim", _Q)
def _(t: Tables) -> DataFrame:
    return _pick(rsrc.feature_matches(_feature_docs(t), carry=("query_id",)))


@query("src_9_geocode_rows", "SELECT * FROM sec", _Q)
def _(t: Tables) -> DataFrame:
    return _pick(rsrc.row_matches(_row_docs(t), carry=("query_id",)))


@query("src_10_fallback", "SELECT * FROM prim UNION ALL SELECT s.* FROM sec s ANTI JOIN prim p ON p.query_id = s.query_id", _Q)
def _(t: Tables) -> DataFrame:
    a, b = rsrc.feature_matches(_feature_docs(t), carry=("query_id",)), rsrc.row_matches(_row_docs(t), carry=("query_id",))
    return _pick(rsrc.with_fallback(a, b))


@query("set_1_anchor_union", "SELECT view_id, id FROM residential_v UNION ALL SELECT view_id, 'census-tract/' || ingest_ix FROM residential_v")
def _(t: Tables) -> DataFrame:
    c = src.census_anchors(_census_docs(t), carry=("view_id",)).select("view_id", "id", "lat", "lon")
    return src.union_anchors(t.residential, c).select("view_id", "id")


@query("snk_4_audit_table", _AUDIT_SQL, _GLM)
def _(t: Tables) -> DataFrame:
    path = stage_path(t.spark, "audit")
    sinks.append_audit(_audit(t), path)
    return t.spark.read.parquet(path).drop("recorded_at")


@query("join_16_id_lookup", "SELECT m.view_id, m.id, p.p_name FROM merchants_v m JOIN part p ON p.p_partkey = m.ingest_ix")
def _(t: Tables) -> DataFrame:
    return t.merchants.select("view_id", "id", F.col("ingest_ix").alias("p_partkey")).join(t.part.select("p_partkey", "p_name"), "p_partkey").select("view_id", "id", "p_name")


@query("srt_5_sorted_samples", "SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) AS place FROM part")
def _(t: Tables) -> DataFrame:
    """Place of every part in its type's sample sorted by price, without sorting a type in one task."""
    ranked = upper_rank(t.part.select("p_type", "p_partkey", "p_retailprice"), ["p_type"], "p_retailprice")
    equal = Window.partitionBy("p_type", "p_retailprice")
    place = F.col("upper_rank") - F.count("*").over(equal) + F.row_number().over(equal.orderBy("p_partkey"))
    return ranked.select("p_type", "p_partkey", place.alias("place"))


_WIDE = "SELECT view_id, south - 4e-2 AS south, north + 4e-2 AS north, west - 4e-2 AS west, east + 4e-2 AS east FROM views_v"


@query("src_1_places_by_position", "SELECT v.view_id, m.id FROM merchants_v m JOIN wide v ON m.lat BETWEEN v.south AND v.north AND m.lon BETWEEN v.west AND v.east", {"wide": _WIDE})
def _(t: Tables) -> DataFrame:
    """Merchants in overlapping boxes; no view id is given."""
    wide = t.views.select("view_id", *[(F.col(c) + F.lit(d)).alias(c) for c, d in (("south", -0.04), ("north", 0.04), ("west", -0.04), ("east", 0.04))])
    return predicates.place_in_views(t.merchants.drop("view_id"), wide).select("view_id", "id")


def _laid_out(t: Tables) -> str:
    """All places, without any view id, laid out by cell."""
    if "_laid_out" not in t.__dict__:
        path = stage_path(t.spark, "places")
        src.lay_out(_all_places(t).drop("view_id"), path)
        t.__dict__["_laid_out"] = path
    return t.__dict__["_laid_out"]


def _wide_views(t: Tables) -> DataFrame:
    return t.views.select("view_id", *[(F.col(c) + F.lit(d)).alias(c) for c, d in (("south", -0.04), ("north", 0.04), ("west", -0.04), ("east", 0.04))])


_BY_PLACE = "SELECT v.view_id, m.id FROM {} m JOIN wide v ON m.lat BETWEEN v.south AND v.north AND m.lon BETWEEN v.west AND v.east"


@query("src_2_parking_by_position", _BY_PLACE.format("parking_v"), {"wide": _WIDE})
def _(t: Tables) -> DataFrame:
    return src.read_in_views(t.spark, _laid_out(t), _wide_views(t), src.is_parking()).select("view_id", "id")


@query("src_3_homes_by_position", _BY_PLACE.format("residential_v") + " WHERE m.building IS NOT NULL OR m.landuse = 'residential'", {"wide": _WIDE})
def _(t: Tables) -> DataFrame:
    home = src.is_residential(F.col("tags")["building"], F.col("tags")["landuse"])
    return src.read_in_views(t.spark, _laid_out(t), _wide_views(t), home).select("view_id", "id")


@query("flt_5_local_clock", """SELECT event_id, (dayofweek(local) + 6) % 7 AS weekday, hour(local) * 60 + minute(local) AS minute FROM (SELECT event_id, CAST(ts AS TIMESTAMP) + CASE event_id % 4 WHEN 0 THEN INTERVAL 0 MINUTE WHEN 1 THEN INTERVAL 330 MINUTE
 WHEN 2 THEN INTERVAL 540 MINUTE ELSE INTERVAL (-420) MINUTE END AS local FROM events) x""")
def _(t: Tables) -> DataFrame:
    """Weekday and minute of day of every event in its own zone (zones without summer time)."""
    zones = F.array(*[F.lit(z) for z in ("UTC", "Asia/Kolkata", "Asia/Tokyo", "America/Phoenix")])
    e = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), zones[(F.col("event_id") % 4).cast("int")].alias("zone"))
    day, minute = local_clock("ts", "zone")
    return e.select("event_id", big(day, "weekday"), big(minute, "minute"))
