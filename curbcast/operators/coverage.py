"""Coverage-aware selection: utility, objective and greedy choice of K spots."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..checkpoints import stage
from ..functions.geo import haversine_m, pair_distance_m, trig_columns
from ..functions.scalar import clamp01_zero, col
from .blocks import block_join


def selection_utility(p_good, stability_low) -> Column:
    mean = clamp01_zero(p_good)
    low = clamp01_zero(F.coalesce(col(stability_low), mean))
    return clamp01_zero(0.65 * mean + 0.35 * low)


def _tau(tau) -> Column:
    return F.greatest(F.lit(100.0), F.coalesce(col(tau), F.lit(700.0)))


def coverage_objective(selected: DataFrame, nodes: DataFrame, tau="coverage_tau") -> DataFrame:
    """Per view: sum over demand nodes of the best weighted coverage.

    A selection holds at most K rows per view, so it travels as one small array
    per view to the nodes: no pair rows, and one aggregate per view.
    """
    picks = selected.withColumn("_u", selection_utility("p_good", "stability_low")).where(F.col("_u") > 0)
    picks = picks.groupBy("view_id").agg(
        F.collect_list(F.struct("lat", "lon", F.col("_u").alias("u"))).alias("_picks"),
        F.first(_tau(tau)).alias("_tau"))
    w = F.greatest(F.lit(0.0), F.coalesce("weight", F.lit(0.0)))
    best = _best_coverage(F.col("_picks"), F.col("_tau"))
    covered = nodes.join(picks, "view_id").select("view_id", (w * best).alias("_c"))
    views = nodes.select("view_id").unionByName(selected.select("view_id")).distinct()
    total = covered.groupBy("view_id").agg(F.sum("_c").alias("coverage"))
    return views.join(total, "view_id", "left").select("view_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def _best_coverage(picks: Column, tau: Column) -> Column:
    """max over picks of u * exp(-d / tau) at the row's (lat, lon)."""
    each = F.transform(picks, lambda s: s["u"] * F.exp(-haversine_m("lat", "lon", s["lat"], s["lon"]) / tau))
    return F.coalesce(F.array_max(each), F.lit(0.0))


def select_spots(candidates: DataFrame, nodes: DataFrame, k: int = 5, tau="coverage_tau",
                 max_candidates: int | None = None) -> DataFrame:
    """Greedy facility location for all views at once.

    ``candidates``: view_id, id, lat, lon, p_good, stability_low, ingest_ix and
    the tau column.  Each of the K rounds is one join on the view plus one
    aggregate: the spots chosen so far travel as a small array per view, so the
    current coverage of a node is an expression and no pair table is kept.
    Ties go to the higher p_good, then to the candidate order.
    """
    k = max(1, int(k))
    w = Window.partitionBy("view_id").orderBy(F.desc("utility"), F.desc("p_good"), F.asc("ingest_ix"))
    cand = candidates.select("view_id", "id", "lat", "lon", "p_good", "stability_low", "ingest_ix",
                             _tau(tau).alias("_ctau"))
    cand = cand.withColumn("utility", selection_utility("p_good", "stability_low"))
    if max_candidates is not None:
        cand = cand.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(k, max_candidates)).drop("_r")
    cand = stage(cand, "candidates")
    shape = cand.groupBy("view_id").agg(F.count(F.lit(1)).alias("_cands"))
    has_nodes = nodes.where(F.col("weight") > 0).select("view_id").distinct().withColumn("_nodes", F.lit(True))
    all_nodes = nodes.select("view_id").distinct().withColumn("_any", F.lit(True))
    flags = shape.join(has_nodes, "view_id", "left").join(all_nodes, "view_id", "left")
    pool = (cand.join(flags.where((F.col("_cands") > k) & F.col("_any")).select("view_id"), "view_id")
            .where(F.col("utility") > 0)
            .select("view_id", "id", "lat", "lon", "p_good", "utility", "ingest_ix", "_ctau", *trig_columns(prefix="c_")))
    # Nodes at one location add up: coverage is linear in the weight.
    spots = (nodes.where(F.col("weight") > 0).groupBy("view_id", "lat", "lon").agg(F.sum("weight").alias("weight"))
             .select("*", *trig_columns(prefix="n_")))
    pool, spots = stage(pool, "pool"), stage(spots, "nodes")
    chosen = None
    rounds = k if pool.limit(1).count() else 0
    for round_no in range(1, rounds + 1):
        left = pool
        here = spots.select("view_id", "lat", "lon", "weight", "n_rlat", "n_rlon", "n_clat")
        if chosen is not None:
            left = pool.join(chosen.select("view_id", "id"), ["view_id", "id"], "left_anti")
            picks = chosen.groupBy("view_id").agg(
                F.collect_list(F.struct("lat", "lon", F.col("utility").alias("u"))).alias("_picks"),
                F.first("_ctau").alias("_t"))
            here = (here.join(picks, "view_id")
                    .withColumn("_cur", F.col("weight") * _best_coverage(F.col("_picks"), F.col("_t"))).drop("_picks", "_t"))
        else:
            here = here.withColumn("_cur", F.lit(0.0))
        pairs = block_join(left.drop("lat", "lon"), here.drop("lat", "lon"), ["view_id"], ["id"], ["n_rlat", "n_rlon"], "left")
        cover = F.col("weight") * F.col("utility") * F.exp(-pair_distance_m("c_", "n_") / F.col("_ctau"))
        gains = pairs.groupBy("view_id", "id", "p_good", "utility", "ingest_ix", "_ctau").agg(
            F.coalesce(F.sum(F.greatest(F.lit(0.0), cover - F.col("_cur"))), F.lit(0.0)).alias("gain"))
        best = gains.groupBy("view_id").agg(F.max(F.struct(
            "gain", "p_good", "utility", (-F.col("ingest_ix")).alias("neg_ix"), "id", "_ctau")).alias("b"))
        picked = best.select("view_id", "b.id", "b.p_good", "b.utility", "b.gain", "b._ctau",
                             F.lit(round_no).alias("pick")).join(pool.select("view_id", "id", "lat", "lon"), ["view_id", "id"])
        picked = picked.select("view_id", "id", "lat", "lon", "p_good", "utility", "gain", "_ctau", "pick")
        picked = stage(picked, "pick")
        chosen = picked if chosen is None else chosen.unionByName(picked)
    if chosen is None:
        chosen = pool.select("view_id", "id", "lat", "lon", "p_good", "utility", F.lit(0.0).alias("gain"), "_ctau",
                             F.lit(0).alias("pick")).where("false")
    # Views with at most K candidates or without nodes, and unfilled places.
    rest = (cand.join(flags.select("view_id", "_cands"), "view_id")
            .join(chosen.select("view_id", "id"), ["view_id", "id"], "left_anti")
            .withColumn("_order", F.row_number().over(w)).where(F.col("_order") <= k))
    got = chosen.groupBy("view_id").agg(F.count(F.lit(1)).alias("_got"))
    rest = rest.join(got, "view_id", "left").withColumn("pick", (F.coalesce("_got", F.lit(0)) + F.col("_order")).cast("int"))
    null = F.lit(None).cast("double")
    filled = rest.where(F.col("pick") <= k).select("view_id", "id", "lat", "lon", "p_good", "pick",
                                                   null.alias("selection_utility"), null.alias("marginal_gain"))
    greedy = chosen.select("view_id", "id", "lat", "lon", "p_good", "pick",
                           F.col("utility").alias("selection_utility"), F.col("gain").alias("marginal_gain"))
    return greedy.unionByName(filled)
