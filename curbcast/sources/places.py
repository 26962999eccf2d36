"""Place sources: map extracts, scans by kind, census anchors."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalar import is_finite
from ..operators.features import BUILDING_WEIGHT, MERCHANT_CLASSES
from ..operators.predicates import boxes_intersect, in_box

ELEMENT_TYPE = ("STRUCT<elements: ARRAY<STRUCT<type: STRING, id: BIGINT, lat: DOUBLE, lon: DOUBLE, "
                "center: STRUCT<lat: DOUBLE, lon: DOUBLE>, tags: MAP<STRING, STRING>>>>")
CENSUS_TYPE = ("STRUCT<generatedAt: STRING, source: STRUCT<dataset: STRING>, "
               "bounds: STRUCT<south: DOUBLE, west: DOUBLE, north: DOUBLE, east: DOUBLE>, "
               "anchors: ARRAY<STRUCT<id: STRING, lat: DOUBLE, lon: DOUBLE, tags: MAP<STRING, STRING>>>>")
# Tag keys of the input data and the columns they become.
PROMOTED = {"amenity": "amenity", "cuisine": "cuisine", "name": "name", "brand": "brand", "opening_hours": "opening_hours",
            "building": "building", "landuse": "landuse"}


def flatten_elements(payloads: DataFrame, payload: str = "payload", carry: tuple[str, ...] = ()) -> DataFrame:
    """Map extract documents to places: nodes keep their position, ways use
    their centre, everything else is dropped; ids get a type prefix."""
    e = payloads.select(*carry, F.explode(F.from_json(payload, ELEMENT_TYPE)["elements"]).alias("e"))
    way = F.col("e.type") == "way"
    lat = F.when(way, F.col("e.center.lat")).otherwise(F.col("e.lat"))
    lon = F.when(way, F.col("e.center.lon")).otherwise(F.col("e.lon"))
    return e.where(F.col("e.type").isin("node", "way")).select(
        *carry, F.concat_ws("/", "e.type", F.col("e.id").cast("string")).alias("id"), lat.alias("lat"), lon.alias("lon"),
        F.coalesce("e.tags", F.create_map().cast("map<string,string>")).alias("tags")).where(
        F.col("lat").isNotNull() & (way_or_lon()))


def way_or_lon() -> Column:
    """A node needs both coordinates; a way needs its centre latitude."""
    return F.col("lon").isNotNull() | F.startswith(F.col("id"), F.lit("way/"))


def promote_tags(places: DataFrame, names: dict[str, str] | None = None, weight_tag: str = "anchor_weight") -> DataFrame:
    """Well-known tags as columns; ``weight_tag`` is the input file's key of an anchor's own weight."""
    return places.select("*", *[F.col("tags")[tag].alias(name) for tag, name in ((names or PROMOTED) | {weight_tag: "place_weight"}).items()])


def is_merchant(amenity: Column | str = "amenity") -> Column:
    c = F.col(amenity) if isinstance(amenity, str) else amenity
    return c.isin(*MERCHANT_CLASSES)


def is_parking(tags: str = "tags") -> Column:
    """One OR predicate, so a place that matches twice is listed once."""
    return F.coalesce(F.col(tags)["amenity"] == "parking", F.lit(False)) | F.map_contains_key(tags, "parking")


def is_residential(building: Column | str = "building", landuse: Column | str = "landuse") -> Column:
    b = F.col(building) if isinstance(building, str) else building
    l = F.col(landuse) if isinstance(landuse, str) else landuse
    return F.coalesce(b.isin(*BUILDING_WEIGHT), F.lit(False)) | F.coalesce(l == "residential", F.lit(False))


def scan_places(places: DataFrame, predicate: Column, south: float, west: float, north: float, east: float) -> DataFrame:
    """Places of a kind inside a box; both conditions push down to Parquet."""
    box = F.col("lat").between(south, north) & F.col("lon").between(west, east)
    return places.where(box & predicate)


def census_anchors(payloads: DataFrame, payload: str = "payload", carry: tuple[str, ...] = ()) -> DataFrame:
    """Anchors of landed census documents, with the document's bounds."""
    d = payloads.select(*carry, F.from_json(payload, CENSUS_TYPE).alias("d"))
    a = d.select(*carry, F.col("d.bounds").alias("declared"), F.col("d.source.dataset").alias("dataset"), F.explode("d.anchors").alias("a"))
    return a.select(*carry, "dataset", "declared", F.col("a.id").alias("id"), F.col("a.lat").alias("lat"),
                    F.col("a.lon").alias("lon"), F.col("a.tags").alias("tags"))


def dataset_bounds(anchors: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Declared bounds, else the extent of the finite anchors, else null."""
    ok_lat, ok_lon = is_finite("lat"), is_finite("lon")
    agg = anchors.groupBy(*keys).agg(
        F.first("declared", ignorenulls=True).alias("_d"),
        F.min(F.when(ok_lat, F.col("lat"))).alias("_s"), F.max(F.when(ok_lat, F.col("lat"))).alias("_n"),
        F.min(F.when(ok_lon, F.col("lon"))).alias("_w"), F.max(F.when(ok_lon, F.col("lon"))).alias("_e"))
    usable = F.col("_s").isNotNull() & F.col("_w").isNotNull()

    def pick(name: str, extent: str) -> Column:
        return F.when(F.col("_d").isNotNull(), F.col(f"_d.{name}")).when(usable, F.col(extent)).alias(name)

    return agg.select(*keys, pick("south", "_s"), pick("west", "_w"), pick("north", "_n"), pick("east", "_e"))


def census_in_views(anchors: DataFrame, views: DataFrame, bounds: DataFrame) -> DataFrame:
    """Anchors inside each view; views disjoint from the data set give none."""
    b = bounds.select("view_id", *[F.col(c).alias(f"d_{c}") for c in ("south", "west", "north", "east")])
    v = views.select("view_id", *[F.col(c).alias(f"v_{c}") for c in ("south", "west", "north", "east")])
    live = v.join(b, "view_id", "left").where(F.col("d_south").isNull() | boxes_intersect("d_", "v_"))
    j = anchors.join(live, "view_id")
    return j.where(in_box("lat", "lon", "v_south", "v_west", "v_north", "v_east")).drop(
        *[f"{p}_{c}" for p in "dv" for c in ("south", "west", "north", "east")])


def union_anchors(map_anchors: DataFrame, census: DataFrame) -> DataFrame:
    """Map and census anchors together (a bag, copies kept)."""
    return map_anchors.unionByName(census, allowMissingColumns=True)


CELL_DEGREES = 5.0          # at most 2 700 cells on the globe


def lay_out(places: DataFrame, path: str, degrees: float = CELL_DEGREES) -> None:
    """Write places by grid cell, so that a reader of some views opens their cells only."""
    at = lambda name: F.floor(F.col(name) / degrees).cast("int")
    laid = places.where(is_finite("lat") & is_finite("lon")).withColumns({"cell_y": at("lat"), "cell_x": at("lon")})
    laid.repartition("cell_y", "cell_x").write.partitionBy("cell_y", "cell_x").parquet(path)


def read_in_views(spark: SparkSession, path: str, views: DataFrame, predicate: Column, degrees: float = CELL_DEGREES) -> DataFrame:
    """(view_id, place) of a kind in the boxes of views, from a table that ``lay_out`` wrote.

    The cells of all boxes are a partition filter; the kind and the hull of the
    boxes reach the scan, and the boxes themselves are met by position.
    """
    from ..operators.predicates import cells_of, place_in_views
    cells = cells_of(views, degrees)
    hull = views.agg(F.min("south"), F.max("north")).first()
    rows: dict[int, list[int]] = {}
    for y, x in cells:
        rows.setdefault(y, []).append(x)
    wanted = F.lit(False)
    for y, xs in rows.items():
        wanted = wanted | ((F.col("cell_y") == y) & F.col("cell_x").isin(xs))
    found = spark.read.parquet(path).where(wanted & predicate)
    if hull[0] is not None:
        found = found.where(F.col("lat").between(hull[0], hull[1]))
    return place_in_views(found.drop("cell_y", "cell_x"), views)


__all__ = ["flatten_elements", "promote_tags", "is_merchant", "is_parking", "is_residential",
           "scan_places", "census_anchors", "dataset_bounds", "census_in_views", "union_anchors", "lay_out", "read_in_views"]
