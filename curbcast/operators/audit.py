"""Model audit and load summary tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .rank import top_per_group


def shadow_audit(active: DataFrame, shadow: DataFrame) -> DataFrame:
    """Per view: top-5 ids of both rankings and the mean |difference| of the
    probabilities at equal rank over the first ten."""
    order = [F.desc("p_good"), F.asc("ingest_ix")]

    def head(df: DataFrame, tag: str) -> DataFrame:
        return top_per_group(df.select("view_id", "id", "p_good", "ingest_ix"), ["view_id"], order, 10).select(
            "view_id", "rank", F.col("id").alias(f"{tag}_id"), F.col("p_good").alias(f"{tag}_p"))

    j = head(active, "a").join(head(shadow, "s"), ["view_id", "rank"], "full")

    def top5(tag: str):
        pairs = F.collect_list(F.when((F.col("rank") <= 5) & F.col(f"{tag}_id").isNotNull(),
                                      F.struct("rank", F.col(f"{tag}_id").alias("id"))))
        return F.transform(F.array_sort(pairs), lambda x: x["id"])

    both = F.col("a_id").isNotNull() & F.col("s_id").isNotNull()
    delta = F.when(F.col("a_id").isNotNull(), F.abs(F.col("a_p") - F.coalesce("s_p", F.lit(0.0))))
    return j.groupBy("view_id").agg(
        top5("a").alias("active_top_ids"), top5("s").alias("shadow_top_ids"),
        (F.coalesce(F.sum(delta), F.lit(0.0)) / F.greatest(F.lit(1), F.count_if(both))).alias("mean_abs_top_delta"))


def selection_utility_sum(selected: DataFrame) -> DataFrame:
    return selected.groupBy("view_id").agg(F.coalesce(F.sum(F.coalesce("p_good", F.lit(0.0))), F.lit(0.0)).alias("utility_sum"))


def load_counts(merchants: DataFrame, parking: DataFrame, residential: DataFrame, census: DataFrame) -> DataFrame:
    """Places loaded per view and kind, in one aggregate over a union."""
    parts = None
    for name, df in (("merchants", merchants), ("parking", parking), ("residential", residential), ("census", census)):
        one = df.select("view_id", F.lit(name).alias("kind"))
        parts = one if parts is None else parts.unionByName(one)
    kinds = ["merchants", "parking", "residential", "census"]
    return parts.groupBy("view_id").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in kinds])


def load_summary(counts: DataFrame, scored_parking: DataFrame, stats: DataFrame) -> DataFrame:
    """Load counts with the best spot and the typical and hot ranges."""
    from ..functions.text import range_text
    best = top_per_group(scored_parking, ["view_id"], [F.desc("p_good"), F.asc("ingest_ix")], 1).select(
        "view_id", F.col("id").alias("best_id"), range_text("p_good_low", "p_good_high").alias("best_range"))
    s = stats.select("view_id", range_text("median_p_low", "median_p_high").alias("typical_range"),
                     range_text("top_decile_p_low", "top_decile_p_high").alias("hot_range"))
    return counts.join(best, "view_id", "left").join(s, "view_id", "left")
