"""Driver-order dispatch: costs, optional matching and batching per market.

Normalised inputs, pair costs, best singles, savings, batches and the final
report are DataFrames.  The matching minimises whole micro-minutes, with ties
decided by ids, so a market has one result: one whose cells fit a task is matched
by a numpy step over sorted rows, together with the markets of its shape, a larger one by an auction with a falling
step whose bidders are spread over tasks in Spark rounds, and both agree.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..checkpoints import stage
from ..functions.geo import UNREACHABLE, clamp_latitude, clamp_longitude, haversine_or_unreachable
from ..functions.scalar import clamp, finite_or
from .blocks import block_join, computed, spread
from .predicates import driver_assignable, order_assignable

EPS = 1e-9
MICRO = 1_000_000           # costs are matched in whole micro-minutes
TIE = 4093                  # a prime: range of the last tie weight
# Cost multiplier by motion state.
MOTION = {"parked": 0.85, "slow": 1.0, "driving_away": 1.25, "high_speed": 1.4}
TASK_CELLS = 250_000         # cells of a market that one task matches or bids for
STEP_CELLS = 100_000         # cells of small markets that are matched together


@dataclass(frozen=True)
class DispatchParams:
    alpha: float = 1.0
    beta: float = 1.0
    gamma: float = 1.0
    delta: float = 1.0
    savings_weight: float = 0.5
    mean_city_speed_mps: float = 8.0
    pickup_buffer_min: float = 2.0
    late_penalty_weight: float = 1.0
    early_penalty_weight: float = 0.7
    batching_enabled: bool = True

    def clean(self) -> "DispatchParams":
        def nn(x: float, d: float) -> float:
            return max(0.0, float(x)) if x is not None and np.isfinite(float(x)) else d
        base = DispatchParams()
        return DispatchParams(
            nn(self.alpha, base.alpha), nn(self.beta, base.beta), nn(self.gamma, base.gamma), nn(self.delta, base.delta),
            nn(self.savings_weight, base.savings_weight), max(0.1, nn(self.mean_city_speed_mps, base.mean_city_speed_mps)),
            nn(self.pickup_buffer_min, base.pickup_buffer_min), nn(self.late_penalty_weight, base.late_penalty_weight),
            nn(self.early_penalty_weight, base.early_penalty_weight), bool(self.batching_enabled))


def cost(x: Column) -> Column:
    """Costs live in [0, 1e12]; anything missing or not a number is the top."""
    top = F.lit(UNREACHABLE)
    return F.greatest(F.lit(0.0), F.least(top, F.coalesce(F.nanvl(x, top), top)))


def _id(name: str, prefix: str) -> Column:
    s = F.trim(F.col(name).cast("string"))
    return F.when(s.isNull() | (s == ""), F.concat(F.lit(prefix + "_"), (F.col("ingest_ix") + 1).cast("string"))).otherwise(s)


def normalize_drivers(drivers: DataFrame) -> DataFrame:
    """Defaults, clamps and generated ids; ``ingest_ix`` is the input position."""
    motion = F.lower(F.trim(F.coalesce("motion_state", F.lit(""))))
    motion = F.when(motion.isin(*MOTION), motion).otherwise("slow")
    mult = F.lit(1.0)
    for name, m in MOTION.items():
        mult = F.when(motion == name, F.lit(m)).otherwise(mult)
    d = drivers.select(
        "market_id", _id("id", "driver").alias("driver_id"), "ingest_ix", clamp_latitude("lat").alias("lat"),
        clamp_longitude("lon").alias("lon"), finite_or("heading_deg", 0.0).alias("heading_deg"),
        F.greatest(F.lit(0.0), finite_or("speed_mps", 0.0)).alias("speed_mps"), motion.alias("motion_state"),
        mult.alias("motion_multiplier"), finite_or("available_at_min", 0.0).alias("available_at_min"),
        F.greatest(F.lit(0).cast("bigint"), F.floor(finite_or("capacity", 1.0))).alias("capacity"))
    return d.withColumn("assignable", driver_assignable())


def normalize_orders(orders: DataFrame) -> DataFrame:
    o = orders.select(
        "market_id", _id("id", "order").alias("order_id"), "ingest_ix",
        clamp_latitude("pickup_lat").alias("pickup_lat"), clamp_longitude("pickup_lon").alias("pickup_lon"),
        clamp_latitude("dropoff_lat").alias("dropoff_lat"), clamp_longitude("dropoff_lon").alias("dropoff_lon"),
        F.greatest(F.lit(0.0), finite_or("prep_time_min", 0.0)).alias("prep_time_min"),
        clamp(finite_or("parking_friction", 0.0), 0.0, 1.0).alias("parking_friction"),
        F.greatest(F.lit(0.0), finite_or("customer_wait_min", 0.0)).alias("customer_wait_min"),
        finite_or("created_at_min", 0.0).alias("created_at_min"))
    return o.withColumn("assignable", order_assignable())


def _minutes(distance: Column, p: DispatchParams) -> Column:
    return cost(distance / p.mean_city_speed_mps / 60.0)


def order_legs(orders: DataFrame, p: DispatchParams) -> DataFrame:
    """Orders with their delivery minutes (once per order, not per pair)."""
    return orders.withColumn("delivery_minutes", _minutes(
        haversine_or_unreachable("pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon"), p))


def _driver_side(drivers: DataFrame) -> DataFrame:
    return drivers.where("assignable").select("market_id", "driver_id", "lat", "lon", "motion_multiplier",
                                              "available_at_min", "capacity", F.col("ingest_ix").alias("driver_ix"))


def _order_side(orders: DataFrame, p: DispatchParams) -> DataFrame:
    return order_legs(orders.where("assignable"), p).drop("assignable").withColumnRenamed("ingest_ix", "order_ix")


def _priced(pairs: DataFrame, p: DispatchParams) -> DataFrame:
    """Rows with the columns of both sides, and the components and total of their cost."""
    travel = _minutes(haversine_or_unreachable("lat", "lon", "pickup_lat", "pickup_lon"), p)
    pairs = computed(pairs, {"pickup_minutes": cost(F.greatest(travel, F.col("available_at_min") - F.col("created_at_min")))})
    arrive, ready = F.greatest(F.lit(0.0), F.col("pickup_minutes")), F.col("prep_time_min")
    prep = cost(p.early_penalty_weight * F.greatest(F.lit(0.0), ready - arrive)
                + p.late_penalty_weight * F.greatest(F.lit(0.0), arrive - ready) * (1.0 / (1.0 + p.pickup_buffer_min)))
    pairs = computed(pairs, {"prep_penalty": prep})
    base = cost(p.alpha * F.col("pickup_minutes") + p.beta * F.col("delivery_minutes")
                + p.gamma * F.col("parking_friction") + p.delta * F.col("customer_wait_min"))
    total = cost(cost(base * F.col("motion_multiplier")) + F.col("prep_penalty"))
    return computed(pairs, {"total_cost": total}).withColumnRenamed("customer_wait_min", "customer_wait_minutes")


def pair_costs(drivers: DataFrame, orders: DataFrame, params: DispatchParams | None = None) -> DataFrame:
    """Cost of every assignable driver-order pair of a market, with components."""
    p = (params or DispatchParams()).clean()
    pairs = block_join(_driver_side(drivers), _order_side(orders, p), ["market_id"], ["driver_id"], ["order_id"], block_rows=4096)
    return _priced(pairs, p).select("market_id", "driver_id", "order_id", "driver_ix", "order_ix", "capacity",
                                    "pickup_minutes", "delivery_minutes", "parking_friction", "customer_wait_minutes",
                                    "motion_multiplier", "prep_penalty", "total_cost")


def matched_costs(drivers: DataFrame, orders: DataFrame, matched: DataFrame, params: DispatchParams | None = None) -> DataFrame:
    """Both sides' columns, cost components and total of given (market_id, driver_id, order_id) rows:
    these few rows meet their sides again, so no pair has to be kept for it."""
    p = (params or DispatchParams()).clean()
    rows = matched.join(_driver_side(drivers), ["market_id", "driver_id"]).join(_order_side(orders, p), ["market_id", "order_id"])
    return _priced(rows, p)


def best_single_costs(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("market_id", "order_id").agg(
        F.min(F.when(F.col("total_cost") < UNREACHABLE, F.col("total_cost"))).alias("best_single"))


def unmatched_cost(pairs: DataFrame) -> DataFrame:
    """Per market: cost of leaving a driver or an order without partner."""
    top = F.coalesce(F.max(F.when(F.col("total_cost") < UNREACHABLE, F.col("total_cost"))), F.lit(0.0))
    return pairs.groupBy("market_id").agg(top.alias("_top")).select(
        "market_id", F.least(F.lit(UNREACHABLE / 4), F.greatest(
            F.lit(1e6), F.col("_top") + 1000.0, F.col("_top") * 10.0 + 1000.0)).alias("dummy_cost"))


def single_cost_report(drivers: DataFrame, orders: DataFrame, params: DispatchParams | None = None) -> DataFrame:
    """One row per driver and order of a market: its own cost, null if either
    side cannot be assigned."""
    costs = pair_costs(drivers, orders, params).select("market_id", "driver_id", "order_id", "total_cost")
    every = block_join(drivers.select("market_id", "driver_id"), orders.select("market_id", "order_id"),
                       ["market_id"], ["driver_id"], ["order_id"], block_rows=4096)
    out = every.join(costs, ["market_id", "driver_id", "order_id"], "left")
    kept = F.when(F.col("total_cost") < UNREACHABLE / 4, F.col("total_cost"))
    return out.select("market_id", "driver_id", "order_id", kept.alias("total_cost"), kept.isNotNull().alias("matched"))


# --- savings ----------------------------------------------------------------

def displacement(orders: DataFrame) -> DataFrame:
    """Orders with their pickup-to-dropoff displacement in metres (``vx``, ``vy``) and its length
    ``vm``: once per order, not per pair."""
    c = F.col
    x = haversine_or_unreachable(c("pickup_lat"), c("pickup_lon"), c("pickup_lat"), c("dropoff_lon"))
    y = haversine_or_unreachable(c("pickup_lat"), c("pickup_lon"), c("dropoff_lat"), c("pickup_lon"))
    v = computed(orders, {"vx": x * F.when(c("dropoff_lon") >= c("pickup_lon"), 1.0).otherwise(-1.0),
                          "vy": y * F.when(c("dropoff_lat") >= c("pickup_lat"), 1.0).otherwise(-1.0)})
    return v.withColumn("vm", F.sqrt(c("vx") * c("vx") + c("vy") * c("vy")))


def direction_similarity(a: str, b: str) -> Column:
    """(cos + 1) / 2 between the displacements of two orders (column prefixes a, b);
    0 for a standing order."""
    c = F.col
    ok = (c(f"{a}vm") > EPS) & (c(f"{b}vm") > EPS)
    cosine = clamp(F.when(ok, (c(f"{a}vx") * c(f"{b}vx") + c(f"{a}vy") * c(f"{b}vy")) / (c(f"{a}vm") * c(f"{b}vm"))).otherwise(F.lit(-1.0)), -1.0, 1.0)
    return F.when(ok, (cosine + 1.0) / 2.0).otherwise(0.0)


def with_savings(pairs: DataFrame, a: str, b: str, p: DispatchParams) -> DataFrame:
    """``direction_score`` and ``savings``: minutes saved when one driver carries both orders (prefixes a, b)."""
    c = F.col
    gap = lambda x: _minutes(haversine_or_unreachable(c(f"{a}{x}_lat"), c(f"{a}{x}_lon"), c(f"{b}{x}_lat"), c(f"{b}{x}_lon")), p)
    pairs = computed(pairs, {"_gap_p": gap("pickup"), "_gap_d": gap("dropoff"), "direction_score": direction_similarity(a, b)})
    da, db = c(f"{a}delivery_minutes"), c(f"{b}delivery_minutes")
    sim, shorter = c("direction_score"), F.least(da, db)
    overlap = clamp(1.0 - c("_gap_d") / F.greatest(da + db, F.lit(EPS)), 0.0, 1.0)
    return computed(pairs, {"savings": cost(F.exp(-c("_gap_p") / 4.0) * 2.0 + sim * 0.5 * shorter + overlap * sim * 0.75 * shorter)})


ROUTE = ["pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon", "delivery_minutes", "vx", "vy", "vm"]


def order_savings(orders: DataFrame, seeds: DataFrame | None = None, params: DispatchParams | None = None) -> DataFrame:
    """Savings of each seed order with every other order of its market.

    ``seeds``: market_id, order_id (at most one per matched driver); without
    them every assignable order is one.
    """
    p = (params or DispatchParams()).clean()
    o = displacement(order_legs(orders.where("assignable"), p))
    prefixed = lambda df, t: df.select("market_id", *[F.col(c).alias(f"{t}{c}") for c in (*ROUTE, "order_id")])
    a = o if seeds is None else o.join(seeds.select("market_id", "order_id").distinct(), ["market_id", "order_id"])
    pairs = block_join(prefixed(a, "a_"), prefixed(o, "b_"), ["market_id"], ["a_order_id"], ["b_order_id"], block_rows=4096)
    pairs = with_savings(pairs.where(F.col("a_order_id") != F.col("b_order_id")), "a_", "b_", p)
    return pairs.select("market_id", F.col("a_order_id").alias("order_id"), F.col("b_order_id").alias("other_order_id"), "direction_score", "savings")


# --- matching ---------------------------------------------------------------

def _exact(weights: np.ndarray, top: int) -> np.ndarray:
    """64-bit integers where sums of a few weights fit them, Python's otherwise."""
    return weights.astype(np.int64) if top < 1 << 60 else weights.astype(object)


def _weights(micro: np.ndarray, driver: np.ndarray, order: np.ndarray, drivers: int, orders: int) -> tuple[np.ndarray, int]:
    """Integer weights whose least sum is the least cost; then drivers and orders
    with small ranks are matched first, and who gets whom goes by a number mixed
    from both ranks.  Also the largest weight."""
    pairs = min(drivers, orders)
    size, mixed = drivers + orders + 1, TIE * pairs + 1
    unit = pairs * ((drivers * size + orders) * mixed + mixed) + 1
    top = (int(micro.max(initial=0)) + 1) * unit
    kind = np.int64 if top < 1 << 60 else object
    driver, order = driver.astype(kind), order.astype(kind)
    return micro.astype(kind) * unit + (driver * size + order) * mixed + (driver * 7919 + order * 104_729 + driver * order * 31) % TIE, top


def _shortest_path_matchings(c: np.ndarray, top: int) -> np.ndarray:
    """Column of each row in the minimum matching of every integer matrix of a
    stack, rows <= columns (successive shortest augmenting paths, taken in all
    matrices at once)."""
    many, n, m = c.shape
    far = 8 * top + 8
    c = _exact(c, 2 * far)
    u, v = np.zeros((many, n), c.dtype), np.zeros((many, m), c.dtype)
    row_of = np.full((many, m), -1)
    for i in range(n):
        dist, prev, done = np.full((many, m), far, c.dtype), np.full((many, m), -1), np.zeros((many, m), bool)
        row, col, base = np.full(many, i), np.full(many, -1), np.zeros(many, c.dtype)
        on = np.arange(many)
        while on.size:
            step = (base[on] - u[on, row[on]])[:, None] + c[on, row[on]] - v[on]
            better = ~done[on] & (step < dist[on])
            reach = np.where(better, step, dist[on])
            dist[on], prev[on] = reach, np.where(better, col[on, None], prev[on])
            near = np.argmin(np.where(done[on], far, reach), axis=1)
            col[on], base[on], row[on] = near, reach[np.arange(on.size), near], row_of[on, near]
            done[on, near] = True
            on = on[row[on] >= 0]
        slack = np.where(done, base[:, None] - dist, 0)
        v -= slack
        done[np.arange(many), col] = False
        at, j = np.nonzero(done)
        u[at, row_of[at, j]] += slack[at, j]
        u[:, i] += base
        on = np.arange(many)
        while on.size:
            back = prev[on, col[on]]
            row_of[on, col[on]] = np.where(back >= 0, row_of[on, back], i)
            col[on] = back
            on = on[back >= 0]
    out = np.full((many, n), -1)
    at, j = np.nonzero(row_of >= 0)
    out[at, row_of[at, j]] = j
    return out


NO_PAIR = int(UNREACHABLE) * MICRO


def _match_grids(grids: np.ndarray) -> np.ndarray:
    """(grid, driver, order) places of the matches of grids of one shape."""
    _, nd, no = grids.shape
    d, o = np.arange(nd)[:, None], np.arange(no)[None, :]
    found = []
    # Grids whose sums fit 64 bits are not held up by one whose sums do not.
    high = grids.max(axis=(1, 2))
    unit = _weights(np.zeros(1, int), d, o, nd, no)[1]
    wide = (high + 1.0) * unit >= 2.0 ** 55
    for some in (np.flatnonzero(~wide), np.flatnonzero(wide)):
        if some.size:
            weights, top = _weights(grids[some], d, o, nd, no)
            if nd <= no:
                i, j = np.broadcast_to(np.arange(nd), (some.size, nd)), _shortest_path_matchings(weights, top)
            else:
                i, j = _shortest_path_matchings(weights.transpose(0, 2, 1), top), np.broadcast_to(np.arange(no), (some.size, no))
            found.append(np.stack([np.repeat(some, i.shape[1]), i.ravel(), j.ravel()]))
    at, i, j = np.concatenate(found, axis=1)
    met = grids[at, i, j] < NO_PAIR
    return np.stack([at[met], i[met], j[met]])


def _places(market: np.ndarray, side: np.ndarray, markets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of one side within their market, and per market how many there are and
    where its first one stands among all of them, whose values come last."""
    keys, at = np.unique(market * (int(side.max()) + 1) + side, return_inverse=True)
    size = np.bincount(keys // (int(side.max()) + 1), minlength=markets)
    first = np.cumsum(size) - size
    return at - first[market], size, first, keys % (int(side.max()) + 1)


def _ranked(ids: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Ranks of ids by their bytes, and the ids by rank."""
    found = ids.combine_chunks().dictionary_encode()
    by_rank = pc.sort_indices(found.dictionary).to_numpy()
    rank = np.empty(by_rank.size, np.int64)
    rank[by_rank] = np.arange(by_rank.size)
    return rank[found.indices.to_numpy()], found.dictionary.take(pa.array(by_rank))


def _match_table(cells: pa.Table, market: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """Matches of whole markets, all of one shape together; ``market`` numbers the rows' markets."""
    (d, drivers), (o, orders) = _ranked(cells["driver_id"]), _ranked(cells["order_id"])
    (di, nd, d_first, d_of), (oi, no, o_first, o_of) = _places(market, d, starts.size), _places(market, o, starts.size)
    micro = cells["micro"].to_numpy()
    shape = nd * (int(no.max()) + 1) + no
    by_shape = np.argsort(shape, kind="stable")
    place = np.empty(starts.size, np.int64)
    rows_by_shape = np.argsort(shape[market], kind="stable")
    shapes, first = np.unique(shape[by_shape], return_index=True)
    row_first = np.searchsorted(shape[market][rows_by_shape], shapes)
    found = []
    for k in range(shapes.size):
        some = by_shape[first[k]:first[k + 1] if k + 1 < shapes.size else None]
        rows = rows_by_shape[row_first[k]:row_first[k + 1] if k + 1 < shapes.size else None]
        place[some] = np.arange(some.size)
        grids = np.full((some.size, nd[some[0]], no[some[0]]), NO_PAIR)
        grids[place[market[rows]], di[rows], oi[rows]] = micro[rows]
        at, i, j = _match_grids(grids)
        found.append(np.stack([some[at], d_of[d_first[some[at]] + i], o_of[o_first[some[at]] + j]]))
    at, i, j = np.concatenate(found, axis=1)
    ids = cells["market_id"].combine_chunks().take(pa.array(starts[at]))
    return pa.RecordBatch.from_arrays([ids, drivers.take(pa.array(i)), orders.take(pa.array(j))], names=["market_id", "driver_id", "order_id"])


def _match_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Match rows sorted by market, as many markets at a time as ``STEP_CELLS`` rows
    hold; the market that is still being read is kept (its size is within the pair limit)."""
    held, rows = [], 0

    def solve(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, rows
        cells = pa.Table.from_batches(held)
        ids = cells["market_id"].combine_chunks().dictionary_encode().indices.to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
        end = cells.num_rows if last else int(starts[-1])
        if end:
            market = np.repeat(np.arange(starts.size), np.diff(np.append(starts, cells.num_rows)))[:end]
            yield _match_table(cells.slice(0, end), market, starts if last else starts[:-1])
        held = cells.slice(end).to_batches()
        rows = cells.num_rows - end

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= STEP_CELLS:
            yield from solve(False)
    if rows:
        yield from solve(True)


def match_orders(pairs: DataFrame, task_cells: int = TASK_CELLS) -> DataFrame:
    """Minimum-cost matching per market (unmatched only when sides differ in
    size or a pair is missing): market_id, driver_id, order_id.

    ``task_cells`` decides where a market is matched, never the result.
    """
    market_type = dict(pairs.dtypes)["market_id"]
    keyed = pairs.where(F.col("total_cost") < UNREACHABLE).select(
        "market_id", "driver_id", "order_id", F.floor(F.col("total_cost") * MICRO + 0.5).cast("long").alias("micro"))
    sizes = keyed.groupBy("market_id").agg(F.count(F.lit(1)).alias("_cells"))
    big = sizes.where(F.col("_cells") > task_cells).select("market_id")
    some_big = big.limit(1).count() > 0
    small = keyed.join(sizes.where(F.col("_cells") <= task_cells).select("market_id"), "market_id") if some_big else keyed
    out = spread(small, "market_id").sortWithinPartitions("market_id").mapInArrow(
        _match_sorted, f"market_id {market_type}, driver_id string, order_id string")
    if not some_big:
        return out
    return out.unionByName(auction_matching(keyed.join(big, "market_id"), task_cells))


FREE, STAYS_OUT, ELSEWHERE = -2, -1, -3     # owners of an item: none, a place left empty, a bidder of another block


def _bid(benefit: np.ndarray, price: np.ndarray, held: np.ndarray, free: list[int], places: int, step: int) -> None:
    """Bids of one block, one after another, until nobody in it is free.

    ``held`` and ``price`` are changed in place.  ``places`` are items that must
    stay without bidder; they go to the cheapest items, together, so that at the
    end no empty item is dearer than the cheapest one by more than the step.
    """
    low = -int(abs(benefit).max(initial=0)) - int(abs(price).max(initial=0)) - 1
    while free or places:
        while free:
            i = free.pop()
            net = benefit[i] - price
            j = int(np.argmax(net))
            best, net[j] = net[j], low * 4
            price[j] += (best - net.max() if net.size > 1 else 0) + step
            before, held[j] = held[j], i
            if before >= 0:
                free.append(int(before))
            elif before == STAYS_OUT:
                places += 1
        if places:
            open_items = np.flatnonzero(held != STAYS_OUT)
            ranked = open_items[np.argsort(price[open_items], kind="stable")]
            level = price[ranked[places]] + step
            taken = ranked[:places]
            free = [int(i) for i in held[taken] if i >= 0]
            held[taken] = STAYS_OUT
            out = held == STAYS_OUT
            price[out] = np.maximum(price[out], level)
            places = 0


def _block_bids(phase: int):
    def run(key, cells: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if items.empty or cells.empty:
            return pd.DataFrame({"market_id": [], "item": [], "price": np.array([], object), "owner": []})
        items = items.sort_values("item")
        first = items.iloc[0]
        bidders, goods, flip = int(first["bidders"]), int(first["items"]), bool(first["flip"])
        drivers, orders = (goods, bidders) if flip else (bidders, goods)
        names, row = np.unique(cells["bidder"].to_numpy(), return_inverse=True)
        micro = np.full((names.size, goods), NO_PAIR)
        micro[row, cells["item"].to_numpy()] = cells["micro"].to_numpy()
        who, what = names[:, None], np.arange(goods)[None, :]
        weights, _ = _weights(micro, what if flip else who, who if flip else what, drivers, orders)
        # Every market's steps fall from a fifth of its range to one; benefits are
        # scaled so that with the last step the matching is the best one.
        _, top = _weights(np.array([int(first["top"])]), np.zeros(1, int), np.zeros(1, int), drivers, orders)
        reach = top * (goods + 1)
        benefit = -_exact(weights.astype(object) * (goods + 1), 8 * reach * goods)
        price = _exact(np.array([int(p) for p in items["price"]], object), 8 * reach * goods)
        owner = items["owner"].to_numpy()
        at = np.searchsorted(names, owner)
        local = (owner >= 0) & (at < names.size) & (names[np.minimum(at, names.size - 1)] == owner)
        held = np.where(local, at, np.where(owner >= 0, ELSEWHERE, owner)).astype(int)
        free = sorted(set(range(names.size)) - set(held[local].tolist()))
        places = goods - bidders - int((owner == STAYS_OUT).sum()) if key[1] == 0 else 0
        before = price.copy()
        _bid(benefit, price, held, free, places, max(1, reach // 5 ** (phase + 1)))
        moved = np.flatnonzero(price != before)
        who = np.where(held[moved] >= 0, names[np.maximum(held[moved], 0)], held[moved])
        return pd.DataFrame({"market_id": first["market_id"], "item": moved, "price": np.array([str(p) for p in price[moved]], object), "owner": who})
    return run


def auction_matching(pairs: DataFrame, block_cells: int = TASK_CELLS) -> DataFrame:
    """Auction with a falling step, all markets together, as Spark rounds.

    ``pairs``: market_id, driver_id, order_id, micro.  The shorter side bids.  A
    round hands every block of bidders its cells and all prices of its market;
    the block's free bidders bid until each holds an item, and an item goes to
    the highest bid over all blocks.  Bids against prices that have risen
    meanwhile are only too low, so late news costs a round, not the result.
    When nobody is free the step falls and everybody bids anew; with the last
    step of one, on weights scaled by the number of items, the matching is the
    minimum.  Prices and owners are written tables; the driver sees one flag.
    """
    number = lambda side: F.row_number().over(Window.partitionBy("market_id").orderBy(side)) - 1
    d = pairs.select("market_id", "driver_id").distinct().withColumn("driver", number("driver_id"))
    o = pairs.select("market_id", "order_id").distinct().withColumn("order", number("order_id"))
    market = (d.groupBy("market_id").agg(F.count(F.lit(1)).alias("nd")).join(o.groupBy("market_id").agg(F.count(F.lit(1)).alias("no")), "market_id")
              .join(pairs.groupBy("market_id").agg(F.max("micro").alias("high"), F.count(F.lit(1)).alias("cells")), "market_id"))
    market = market.select("market_id", (F.col("nd") > F.col("no")).alias("flip"), F.least("nd", "no").alias("bidders"), F.greatest("nd", "no").alias("items"),
                           F.when(F.col("cells") < F.col("nd") * F.col("no"), F.lit(NO_PAIR)).otherwise(F.col("high")).alias("top"))
    market = stage(market.withColumn("rows", F.greatest(F.lit(1), F.floor(F.lit(block_cells) / F.col("items"))).cast("long")), "markets")
    either = lambda a, b: F.when(F.col("flip"), F.col(a)).otherwise(F.col(b))
    cells = pairs.join(d, ["market_id", "driver_id"]).join(o, ["market_id", "order_id"]).join(market, "market_id").select(
        "market_id", F.floor(either("order", "driver") / F.col("rows")).cast("long").alias("block"), either("order", "driver").cast("long").alias("bidder"),
        either("driver", "order").cast("long").alias("item"), "micro", "driver_id", "order_id")
    cells = stage(cells, "cells")
    blocks = stage(cells.select("market_id", "block").distinct(), "blocks")
    state = market.select("market_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("items") - 1)).alias("item"))
    state = stage(state.select("market_id", "item", F.lit(0).cast("decimal(38,0)").alias("price"), F.lit(FREE).cast("long").alias("owner")), "prices")
    # Steps until the range of the scaled weights of every market has fallen to one.
    reach = market.agg(F.max((F.col("top").cast("double") + 1) * F.pow(F.col("bidders") + F.col("items") + 1.0, F.lit(5)) * TIE)).first()[0]
    phases = int(np.ceil(np.log(reach) / np.log(5))) + 1
    schema = f"market_id {dict(pairs.dtypes)['market_id']}, item long, price string, owner long"
    for phase in range(phases):
        state = state.withColumn("owner", F.lit(FREE).cast("long"))
        while True:
            open_markets = state.where(F.col("owner") == FREE).select("market_id").distinct()
            offered = state.join(open_markets, "market_id").join(market.drop("rows"), "market_id").join(blocks, "market_id")
            bids = cells.join(open_markets, "market_id").select("market_id", "block", "bidder", "item", "micro").groupBy("market_id", "block").cogroup(
                offered.withColumn("price", F.col("price").cast("string")).groupBy("market_id", "block")).applyInPandas(_block_bids(phase), schema)
            won = bids.groupBy("market_id", "item").agg(F.max(F.struct(F.col("price").cast("decimal(38,0)").alias("price"), "owner")).alias("won"))
            state = stage(state.join(won, ["market_id", "item"], "left").select(
                "market_id", "item", F.coalesce("won.price", "price").alias("price"), F.coalesce("won.owner", "owner").alias("owner")), "prices")
            if not state.where(F.col("owner") == FREE).limit(1).count():
                break
    met = state.where(F.col("owner") >= 0).select("market_id", "item", F.col("owner").alias("bidder"))
    return cells.join(met, ["market_id", "item", "bidder"]).select("market_id", "driver_id", "order_id")


# --- batching ---------------------------------------------------------------

def batch_candidates(singles: DataFrame, orders: DataFrame, best: DataFrame, params: DispatchParams | None = None) -> DataFrame:
    """(seed, second order) pairs that beat serving both orders singly.

    ``singles`` are the :func:`matched_costs`, ``best`` the :func:`best_single_costs`.
    Seeds (a matched driver with room for two) meet the orders of their market and
    are priced there.  The test does not depend on who holds the second order, so
    all of it is relational; the order of taking is left to :func:`take_batches`.
    """
    p = (params or DispatchParams()).clean()
    seeds = displacement(singles.where((F.col("capacity") >= 2) & (F.col("total_cost") < UNREACHABLE)))
    seeds = seeds.select("market_id", "driver_id", "lat", "lon", "motion_multiplier", "available_at_min", "order_id", *[F.col(c).alias(f"a_{c}") for c in ROUTE])
    owner = singles.select("market_id", "order_id", F.col("driver_id").alias("owner_id"))
    others = (displacement(_order_side(orders, p)).join(best.where("best_single is not null"), ["market_id", "order_id"])
              .join(owner, ["market_id", "order_id"], "left").withColumnsRenamed({"order_id": "other_order_id", "order_ix": "other_ix"}))
    seeds, others = stage(seeds, "seeds"), stage(others, "others")
    cand = block_join(seeds, others, ["market_id"], ["driver_id"], ["other_order_id"], block_rows=4096)
    cand = _priced(cand.where(F.col("order_id") != F.col("other_order_id")), p).withColumnRenamed("total_cost", "other_cost")
    cand = with_savings(cand.where(F.col("other_cost") < UNREACHABLE), "a_", "", p)
    return cand.where(F.col("other_cost") - p.savings_weight * F.col("savings") < F.col("best_single") - EPS).select(
        "market_id", "driver_id", "order_id", "other_order_id", "other_ix", "owner_id", "savings", "other_cost")


def take_batches(candidates: DataFrame) -> DataFrame:
    """Who takes which second order: seeds decide in driver order within a
    market, and each takes its first candidate that is still to be had.

    A seed decides once no earlier undecided seed of its market touches an order
    that it touches (its own or a candidate's), so all seeds without such a
    conflict decide in one round, of every market together.  An order is gone
    once taken; its owner may lose it only while the owner has taken none; a
    driver whose order was taken takes none.
    """
    seed = F.struct("driver_id", "order_id")
    left = stage(candidates.select("market_id", "driver_id", "order_id", "other_order_id", "other_ix", "owner_id", "savings", "other_cost"), "candidates")
    schema = left.schema
    taken: DataFrame | None = None
    while left.limit(1).count():
        candidate = F.struct("other_order_id", "other_ix", "owner_id", "savings", "other_cost")
        touches = F.array(F.struct(F.col("order_id").alias("touched"), F.when(F.lit(False), candidate).alias("candidate")),
                          F.struct(F.col("other_order_id").alias("touched"), candidate.alias("candidate")))
        each = left.select("market_id", seed.alias("seed"), F.explode(touches).alias("t")).select("market_id", "seed", "t.*")
        first = F.min("seed").over(Window.partitionBy("market_id", "touched")) == F.col("seed")
        chosen = each.withColumn("first", first).groupBy("market_id", "seed").agg(F.min("first").alias("ready"), F.min("candidate").alias("pick")).where("ready")
        chosen = stage(chosen.select("market_id", "seed.*", "pick.*"), "taken")
        taken = chosen if taken is None else taken.unionByName(chosen)
        lost = chosen.where(F.col("owner_id").isNotNull()).select("market_id", F.col("owner_id").alias("driver_id"))
        # What is left of a seed's candidates may all be had, so every seed that decides takes one.
        gone = chosen.select("market_id", "driver_id").unionByName(lost).distinct()
        left = left.join(gone, ["market_id", "driver_id"], "left_anti").join(chosen.select("market_id", "other_order_id"), ["market_id", "other_order_id"], "left_anti")
        left = stage(left.join(chosen.select("market_id", F.col("driver_id").alias("owner_id")), ["market_id", "owner_id"], "left_anti").select(*schema.names), "candidates")
    return left if taken is None else taken.select(*schema.names)


def assign_orders(drivers: DataFrame, orders: DataFrame, params: DispatchParams | None = None,
                  task_cells: int = TASK_CELLS) -> dict[str, DataFrame]:
    """Whole dispatch.  Returns assignments, unassigned_drivers,
    unassigned_orders and diagnostics DataFrames.

    Who carries what is decided here, once, and kept as keys; only who reads the
    assignments prices them.
    """
    p = (params or DispatchParams()).clean()
    d, o = normalize_drivers(drivers), normalize_orders(orders)
    d, o = stage(d, "drivers"), stage(o, "orders")
    cells = stage(pair_costs(d, o, p).select("market_id", "driver_id", "order_id", "total_cost"), "cells")
    base = stage(matched_costs(d, o, stage(match_orders(cells, task_cells), "matched"), p), "singles")
    parts = ["pickup_minutes", "delivery_minutes", "parking_friction", "customer_wait_minutes", "prep_penalty"]
    if p.batching_enabled:
        taken = stage(take_batches(batch_candidates(base, o, best_single_costs(cells), p)), "batches")
    else:
        taken = base.select("market_id", "driver_id", "order_id", F.lit(None).cast("string").alias("other_order_id"),
                            F.lit(None).cast("string").alias("owner_id"), F.lit(None).cast("double").alias("savings")).where("false")
    lost = taken.where(F.col("owner_id").isNotNull()).select("market_id", F.col("owner_id").alias("driver_id"))
    ids = F.when(F.col("other_order_id").isNotNull(), F.array("order_id", "other_order_id")).otherwise(F.array("order_id"))
    decided = base.select("market_id", "driver_id", "order_id").join(lost, ["market_id", "driver_id"], "left_anti")
    decided = decided.join(taken.select("market_id", "driver_id", "other_order_id"), ["market_id", "driver_id"], "left")
    # The report reads them four times.
    decided = stage(decided.select("market_id", "driver_id", ids.alias("order_ids")), "decided")
    used = decided.select("market_id", F.explode("order_ids").alias("order_id"))
    free_d = d.select("market_id", "driver_id").join(decided.select("market_id", "driver_id"), ["market_id", "driver_id"], "left_anti")
    free_o = o.select("market_id", "order_id").join(used, ["market_id", "order_id"], "left_anti")
    second = matched_costs(d, o, taken.select("market_id", "driver_id", F.col("other_order_id").alias("order_id"), "savings"), p)
    pick = second.select("market_id", "driver_id", F.col("order_id").alias("other_order_id"), "savings",
                         F.col("total_cost").alias("other_cost"), *[F.col(c).alias(f"other_{c}") for c in parts])
    kept = base.select("market_id", "driver_id", "order_id", "total_cost", "motion_multiplier", *parts).join(lost, ["market_id", "driver_id"], "left_anti").join(pick, ["market_id", "driver_id"], "left")
    zero = F.lit(0.0)
    total = cost(F.col("total_cost") + F.coalesce("other_cost", zero) - p.savings_weight * F.coalesce("savings", zero))
    comp = F.struct(*[cost(F.col(c) + F.coalesce(f"other_{c}", zero)).alias(c) for c in parts],
                    F.col("motion_multiplier"), F.coalesce("savings", zero).alias("shared_route_savings"))
    assignments = kept.select("market_id", "driver_id", ids.alias("order_ids"), total.alias("total_cost"), comp.alias("components"))
    return {"assignments": assignments, "unassigned_drivers": free_d, "unassigned_orders": free_o,
            "diagnostics": dispatch_diagnostics(d, o, decided, p)}


def dispatch_diagnostics(drivers: DataFrame, orders: DataFrame, assignments: DataFrame, params: DispatchParams) -> DataFrame:
    nd = drivers.groupBy("market_id").agg(F.count(F.lit(1)).alias("driver_count"))
    no = orders.groupBy("market_id").agg(F.count(F.lit(1)).alias("order_count"))
    na = assignments.groupBy("market_id").agg(F.sum(F.size("order_ids")).alias("matched_count"),
                                              F.count_if(F.size("order_ids") > 1).alias("batched_count"))
    z = F.lit(0).cast("bigint")
    return nd.join(no, "market_id", "full").join(na, "market_id", "left").select(
        "market_id", F.coalesce("driver_count", z).alias("driver_count"), F.coalesce("order_count", z).alias("order_count"),
        F.coalesce("matched_count", z).alias("matched_count"), F.coalesce("batched_count", z).alias("batched_count"),
        F.lit(bool(params.batching_enabled)).alias("batching_enabled"))
