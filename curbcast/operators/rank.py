"""Rankings: parking per view, top merchants per point, stable orders."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geo import pair_distance_m, trig_columns
from ..functions.scalar import col, round_half_up
from .blocks import block_join
from .features import merchant_weight


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int,
                  rank: str = "rank") -> DataFrame:
    """First ``limit`` rows per group in a total order.

    The rank filter lets Spark cut each task's rows to ``limit`` per group
    before the shuffle, so a hot group stays small.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= limit)


def rank_parking(scored: DataFrame, limit: int = 12) -> DataFrame:
    """Best parking per view by chance of a good order, input order on ties."""
    return top_per_group(scored, ["view_id"], [F.desc("p_good"), F.asc("ingest_ix")], limit)


def rank_parking_overall(scored: DataFrame, limit: int = 12) -> DataFrame:
    """Best parking over everything: a take-ordered, never a full sort."""
    return scored.orderBy(F.desc("p_good"), F.asc("ingest_ix")).limit(limit)


def top_merchants(points: DataFrame, merchants: DataFrame, params: DataFrame, limit: int = 6) -> DataFrame:
    """Most likely pickup merchants per point: weight times kernel, top k.

    Only the k best per point leave a task.  Merchants that share a location
    and weight score the same for every point, so only the first ``limit`` of
    them in input order can be chosen: the others are cut before the join.
    """
    p = params.select("view_id", "hour", "tau")
    m = merchants.join(p, "view_id").select(
        "view_id", "id", "ingest_ix", merchant_weight("amenity", "hour").alias("w"),
        F.greatest(F.lit(1.0), F.col("tau")).alias("tau"), *trig_columns(prefix="m_"))
    m = top_per_group(m, ["view_id", "m_rlat", "m_rlon", "w"], [F.asc("ingest_ix")], limit, "_same").drop("_same")
    pts = points.select("view_id", "point_id", *trig_columns(prefix="q_"))
    pairs = block_join(pts, m, ["view_id"], ["point_id"], ["id"])
    d = pair_distance_m("q_", "m_")
    scored = pairs.select("view_id", "point_id", "id", "ingest_ix", d.alias("_d"),
                          (F.col("w") * F.exp(-d / F.col("tau"))).alias("score"))
    best = top_per_group(scored, ["view_id", "point_id"], [F.desc("score"), F.asc("ingest_ix")], limit)
    return best.select("view_id", "point_id", "rank", "id", "score", round_half_up("_d").alias("distance_m"))


def describe_merchants(top: DataFrame, merchants: DataFrame) -> DataFrame:
    """Names and classes of chosen merchants (missing names are '(unnamed)')."""
    brand = F.col("brand") if "brand" in merchants.columns else F.lit(None).cast("string")
    info = merchants.select("view_id", "id", F.coalesce("name", brand, F.lit("(unnamed)")).alias("name"),
                            F.coalesce("amenity", F.lit("food")).alias("amenity"), "lat", "lon")
    return top.join(info, ["view_id", "id"])


def stable_order(df: DataFrame, keys: Sequence[str], id_col: str, ingest: str, out: str = "position") -> DataFrame:
    """Position of each row by (id, input order) inside its group."""
    w = Window.partitionBy(*keys).orderBy(F.asc(id_col), F.asc(ingest))
    return df.withColumn(out, F.row_number().over(w))


def selection_order(scored: DataFrame, limit: int | None = None) -> DataFrame:
    """Candidates by selection utility, then p_good, then input order."""
    from .coverage import selection_utility
    w = Window.partitionBy("view_id").orderBy(F.desc("utility"), F.desc("p_good"), F.asc("ingest_ix"))
    out = scored.withColumn("utility", selection_utility("p_good", "stability_low")).withColumn(
        "cand_rank", F.row_number().over(w))
    return out if limit is None else out.where(F.col("cand_rank") <= limit)


def percentile_text(p) -> Column:
    p = col(p)
    s = p.cast("string")
    return (F.when(p.isNull(), "Rank unavailable — load data first")
            .when(p >= 90, F.concat(F.lit("Top "), (100 - p).cast("string"), F.lit("% — one of the best spots on the map")))
            .when(p >= 70, F.concat(F.lit("Better than "), s, F.lit("% of spots — above average")))
            .when(p >= 40, F.concat(F.lit("Middle of the pack — "), s, F.lit("% ranked lower")))
            .otherwise(F.concat(F.lit("Bottom half — only "), s, F.lit("% of spots score lower"))))


def compact_rank(p) -> Column:
    p = col(p)
    return (F.when(p.isNull(), "Unranked")
            .when(p >= 90, F.concat(F.lit("Top "), F.greatest(F.lit(1).cast("bigint"), 100 - p).cast("string"), F.lit("%")))
            .when(p >= 70, "Above avg").when(p >= 40, "Mid pack").otherwise("Lower tier"))
