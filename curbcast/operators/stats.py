"""Order-statistic quantiles, percentiles and per-view statistics.

The reference quantile is ``sorted[floor(q * (n - 1))]``.  It is found by
selection, not by sorting a group in one task: a count and range per group, a
histogram of 4096 monotone buckets, then an exact pick inside the one bucket
that holds the wanted rank.  Sorting is limited to histogram rows and to the
distinct values of one bucket, so a group of any size is spread over the
cluster.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import col, round_half_up

BUCKETS = 4096


def _bucket(value: Column, low: Column, high: Column) -> Column:
    # Subtraction, division and scaling are correctly rounded, hence monotone.
    span = high - low
    b = F.floor((value - low) / span * float(BUCKETS))
    return F.when(span > 0, F.least(b, F.lit(BUCKETS - 1))).otherwise(F.lit(0).cast("bigint"))


def order_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Mapping[str, float]) -> DataFrame:
    """Exact ``sorted[floor(q*(n-1))]`` per group for every named q.

    ``df`` is read three times; persist it when it is costly to compute.
    """
    keys = list(keys)
    src = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    shape = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    binned = src.join(shape, keys).select(*keys, "_v", "_n", _bucket(F.col("_v"), F.col("_lo"), F.col("_hi")).alias("_b"))
    hist = binned.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    wanted = F.array(*[F.struct(F.lit(name).alias("q"), F.lit(float(q)).alias("f")) for name, q in qs.items()])
    ranks = hist.select(*keys, "_b", "_c", "_before", "_n", F.explode(wanted).alias("_w")).select(
        *keys, "_b", F.col("_w.q").alias("_q"), "_before", "_c",
        F.greatest(F.lit(0).cast("bigint"), F.least(F.col("_n") - 1, F.floor(F.col("_w.f") * (F.col("_n") - 1)))).alias("_rank"))
    picks = ranks.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c")))
    # One row per distinct value of a picked bucket, then a running count.
    inside = binned.join(picks.drop("_c"), [*keys, "_b"]).groupBy(*keys, "_q", "_rank", "_before", "_v").agg(
        F.count(F.lit(1)).alias("_m"))
    wv = Window.partitionBy(*keys, "_q").orderBy("_v")
    inside = inside.withColumn("_upto", F.col("_before") + F.sum("_m").over(wv))
    hit = inside.where(F.col("_upto") > F.col("_rank"))
    return (hit.groupBy(*keys).agg(*[F.min(F.when(F.col("_q") == n, F.col("_v"))).alias(n) for n in qs]))


def order_quantiles_many(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Quantiles of several value columns in one selection.

    ``wanted`` maps output name -> (value column, q).
    """
    keys = list(keys)
    cols = sorted({v for v, _ in wanted.values()})
    qs = sorted({q for _, q in wanted.values()})
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v")) for c in cols])).alias("_x")).select(
        *keys, F.col("_x.m").alias("_metric"), F.col("_x.v").alias("_value"))
    names = {q: f"q_{i}" for i, q in enumerate(qs)}
    got = order_quantiles(long, [*keys, "_metric"], "_value", {n: q for q, n in names.items()})
    return got.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_metric") == c, F.col(names[q]))).alias(out) for out, (c, q) in wanted.items()])


def lambda_reference(nodes: DataFrame, value: str = "lambda_cal", q: float = 0.7) -> DataFrame:
    """Per view: the reference intensity that maps to a 50 % arrival chance."""
    got = order_quantiles(nodes, ["view_id"], value, {"_ref": q})
    return got.select("view_id", F.greatest(F.lit(1e-9), F.col("_ref")).alias("lambda_ref"))


VIEW_STATS = {
    "median_score": ("p_good", 0.5), "top_decile_score": ("p_good", 0.9),
    "median_p_low": ("p_good_low", 0.5), "median_p_mid": ("p_good", 0.5), "median_p_high": ("p_good_high", 0.5),
    "top_decile_p_low": ("p_good_low", 0.9), "top_decile_p_mid": ("p_good", 0.9),
    "top_decile_p_high": ("p_good_high", 0.9),
    "median_composite": ("composite", 0.5), "top_decile_composite": ("composite", 0.9),
}


def view_stats(scored: DataFrame) -> DataFrame:
    """Medians, top deciles and sample count of a scored grid, per view."""
    q = order_quantiles_many(scored, ["view_id"], VIEW_STATS)
    n = scored.groupBy("view_id").agg(F.count(F.lit(1)).alias("sample_count"), F.first("lambda_ref").alias("lambda_ref"))
    return n.join(q, "view_id")


def upper_rank(df: DataFrame, keys: Sequence[str], value: str, out: str = "upper_rank", total: str = "group_rows") -> DataFrame:
    """Number of group rows with a value <= own value, without a group sort.

    Rows are counted per distinct value and bucket first; only histogram rows
    and the distinct values of one bucket are ordered.  A null key is a group;
    a null value has a null rank.
    """
    keys = list(keys)
    v = F.col(value)

    def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
        """Equi join in which nulls of the keys are equal."""
        r = right.select(*[F.col(c).alias(f"_k_{c}") for c in on], *[c for c in right.columns if c not in on])
        same = [left[c].eqNullSafe(r[f"_k_{c}"]) for c in on]
        return left.join(r, reduce(lambda a, b: a & b, same), how).drop(*[f"_k_{c}" for c in on])

    shape = df.groupBy(*keys).agg(F.count(value).alias(total), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    binned = joined(df, shape, keys).withColumn("_b", _bucket(v, F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    per_value = binned.where(v.isNotNull()).groupBy(*keys, "_b", value).agg(F.count(F.lit(1)).alias("_c"))
    hist = per_value.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select(*keys, "_b", F.coalesce(F.sum("_bc").over(w), F.lit(0)).alias("_before"))
    wv = Window.partitionBy(*keys, "_b").orderBy(value)
    ranked = joined(per_value, hist, [*keys, "_b"]).select(
        *keys, value, (F.col("_before") + F.sum("_c").over(wv)).alias(out))
    return joined(binned.drop("_b"), ranked, [*keys, value], "left")


def percentile_of(rank, total) -> Column:
    """round(100 * rank / n), null for an empty sample."""
    return F.when(col(total) > 0, round_half_up(100.0 * col(rank) / col(total)))


def percentile_in_sample(values: DataFrame, sample: DataFrame, key: str, value: str, sample_value: str) -> DataFrame:
    """Percentile of each row's value in the sorted sample of its group.

    Both sides go into one ranking: the sample rows at or below a value are its
    upper bound.
    """
    u = (values.select(key, F.col(value).alias("_v"), F.lit(0).alias("_s"))
         .unionByName(sample.select(key, F.col(sample_value).alias("_v"), F.lit(1).alias("_s"))))
    dist = u.groupBy(key, "_v").agg(F.sum("_s").alias("_c"))
    shape = dist.groupBy(key).agg(F.sum("_c").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    d = dist.join(shape, key).withColumn("_b", _bucket(F.col("_v"), F.col("_lo"), F.col("_hi")))
    hist = d.groupBy(key, "_b").agg(F.sum("_c").alias("_bc"))
    w = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select(key, "_b", F.coalesce(F.sum("_bc").over(w), F.lit(0)).alias("_before"))
    wv = Window.partitionBy(key, "_b").orderBy("_v")
    r = d.join(hist, [key, "_b"]).select(key, F.col("_v").alias(value), "_n",
                                         (F.col("_before") + F.sum("_c").over(wv)).alias("_rank"))
    return values.join(r, [key, value], "left").withColumn(
        "percentile", percentile_of("_rank", "_n")).drop("_rank", "_n")
