"""Invariants and fixed examples of the scorer, hours, learned model and folds."""
import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbcast.functions import geo
from curbcast.operators import asof, coverage, dispatch, kernel, learned, nearby, predicates, stats
from curbcast.operators.blocks import block_join
from curbcast.operators.hours import local_clock, open_at
from curbcast.operators.score import score_points
from curbcast.operators.grid import grid_nodes
from curbcast.sources import places as place_sources, sinks
from curbcast.streaming import folds

MERCHANTS = [(34.1060, -117.5930, "restaurant", "sushi", "Sushi Place"), (34.1070, -117.5920, "fast_food", "burger", "Burger Joint"),
             (34.1055, -117.5940, "cafe", None, "Morning Cafe"), (34.1080, -117.5910, "restaurant", "italian", "Italian Bistro"),
             (34.1045, -117.5950, "fast_food", "chicken", "Chicken Stop")]
LOTS = [(34.1062, -117.5932), (34.1075, -117.5915)]


def dist(a, b, c, d):
    s1, s2 = math.sin(math.radians(c - a) / 2), math.sin(math.radians(d - b) / 2)
    h = s1 * s1 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * s2 * s2
    return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def tables(spark, model="legacy", rain=0.0, hour=14):
    m = spark.createDataFrame([(1, i, f"node/{i}", *r) for i, r in enumerate(MERCHANTS)],
                              "view_id int, ingest_ix int, id string, lat double, lon double, amenity string, cuisine string, name string")
    p = spark.createDataFrame([(1, *r) for r in LOTS], "view_id int, lat double, lon double")
    v = spark.createDataFrame([(1, hour, 3, 1200.0, 0.35, rain, 0.55, model, False, 2.0)],
                              "view_id int, hour int, dow int, tau double, competition_strength double, rain_boost double, tip_emphasis double, prediction_model string, use_ml boolean, ml_beta double")
    return m, p, v


def score(spark, points, model="legacy", rain=0.0, hour=14, ref=1.0):
    m, p, v = tables(spark, model, rain, hour)
    pts = spark.createDataFrame([(1, f"p{i}", *x) for i, x in enumerate(points)], "view_id int, point_id string, lat double, lon double")
    places = kernel.weighted_places(m, p, None, v)
    st = spark.createDataFrame([(1, ref)], "view_id int, lambda_ref double")
    rows = score_points(kernel.kernel_features(pts, places), v, st).collect()
    return [r for r in sorted(rows, key=lambda r: r["point_id"])]


NEAR, FAR = (34.1064, -117.5931), (34.2, -117.7)


@pytest.mark.parametrize("model", ["legacy", "softplus", "glm"])
def test_scores_are_ordered_and_bounded(spark, model):
    near, far = score(spark, [NEAR, FAR], model)
    assert near["p_good"] > far["p_good"] and near["expected_dist_m"] < far["expected_dist_m"]
    for r in (near, far):
        assert 0 <= r["p_good_low"] <= r["p_good"] <= r["p_good_high"] <= 1
        assert r["p_good"] <= r["p_any"] <= 1 and r["horizon_min"] == 10
        assert all(0 <= x <= 1 for x in r["signals"])
        assert r["advisory"] in ("hold", "rotate")


def test_kernel_sum_matches_plain_loop(spark):
    near = score(spark, [NEAR])[0]
    w = {"restaurant": 1.0, "fast_food": 1.3, "cafe": 0.8}
    want = sum(w[a] * math.exp(-dist(*NEAR, la, lo) / 1200) for la, lo, a, _, _ in MERCHANTS)
    assert near["merchant_intensity"] == pytest.approx(want, rel=1e-12)


def test_learned_stays_close_to_legacy(spark):
    a, b = score(spark, [NEAR, FAR]), score(spark, [NEAR, FAR], "glm")
    assert abs(a[0]["p_good"] - b[0]["p_good"]) <= 0.12 and abs(a[1]["p_good"] - b[1]["p_good"]) <= 0.08


def test_rain_lifts_scores(spark):
    assert score(spark, [NEAR], rain=0.2)[0]["p_good"] > score(spark, [NEAR])[0]["p_good"]


def test_empty_view_keeps_points(spark):
    m, p, v = tables(spark)
    pts = spark.createDataFrame([(2, "x", 34.0, -117.0)], "view_id int, point_id string, lat double, lon double")
    r = kernel.kernel_features(pts, kernel.weighted_places(m, p, None, v)).first()
    assert (r["merchant_intensity"], r["expected_dist"], r["nearest_dist"], r["nearby_merchants"]) == (0.0, 1e9, 1e9, 0)


def test_block_join_is_exact_when_keys_are_split(spark, monkeypatch):
    from curbcast.operators import blocks
    monkeypatch.setattr(blocks, "BROADCAST_ROWS", 0)
    a = spark.range(57).select(F.lit(1).alias("k"), F.col("id").alias("x"))
    b = spark.range(43).select(F.lit(1).alias("k"), F.col("id").alias("y"))
    j = block_join(a, b, ["k"], ["x"], ["y"], block_rows=10)
    assert j.count() == 57 * 43 and j.distinct().count() == 57 * 43
    lone = block_join(a.unionByName(spark.range(3).select(F.lit(9).alias("k"), F.col("id").alias("x"))), b, ["k"], ["x"], ["y"], "left", 10)
    assert lone.where("y is null").select("k", "x").distinct().count() == 3


@pytest.mark.parametrize("q", [0.0, 0.3, 0.5, 0.7, 0.9, 1.0])
def test_order_quantile_is_an_element(spark, q):
    rnd = random.Random(3)
    vals = [rnd.choice([rnd.random() * 1e4, 1.0, 2.0, 1e-12]) for _ in range(997)]
    df = spark.createDataFrame([(1, v) for v in vals] + [(2, 7.0)] * 40, "g int, v double")
    got = {r["g"]: r["x"] for r in stats.order_quantiles(df, ["g"], "v", {"x": q}).collect()}
    assert got == {1: sorted(vals)[math.floor(q * 996)], 2: 7.0}


@pytest.mark.parametrize("text,day,minute,want", [
    ("Mo-Su 10:00-22:00", 2, 720, True), ("Mo-Su 10:00-22:00", 2, 1380, False), ("Mo-Su 18:00-02:00", 2, 1410, True),
    ("Mo-Su 18:00-02:00", 2, 90, True), ("Mo-Su 18:00-02:00", 2, 180, False), ("Mo-Fr 09:00-17:00", 6, 600, True),
    ("24/7", 0, 0, True), ("", 0, 0, True), (None, 0, 0, True), ("by appointment", 0, 0, True), ("Mo-Su 10:00-24:00", 1, 30, True),
    ("Sa off; Sa 10:00-12:00", 5, 660, True), ("Fr-Mo 23:00-01:00", 1, 30, True), ("Fr-Mo 23:00-01:00", 1, 90, False), ("Tu 08:00-08:00", 1, 5, True)])
def test_opening_hours(spark, text, day, minute, want):
    p = spark.createDataFrame([(1, "a", text)], "view_id int, id string, opening_hours string")
    i = spark.createDataFrame([(1, day, minute)], "view_id int, osm_day int, minute int")
    assert open_at(p, i).first()["is_open"] is want


def test_grid_axis_by_repeated_addition(spark):
    v = spark.createDataFrame([(1, 34.104, 34.109, -117.596, -117.590, 500.0)], "view_id int, south double, north double, west double, east double, grid_step double")
    got = sorted({r["lat"] for r in grid_nodes(v).collect()})
    want, x = [], 34.104
    while x <= 34.109:
        want.append(x)
        x += 500.0 / 111320
    assert got == want


def test_greedy_selection_against_brute_force(spark):
    lots = [(1, "w1", 34.100, -117.600, 0.80, 0.7, 0), (1, "w2", 34.1002, -117.6002, 0.79, 0.7, 1),
            (1, "e1", 34.100, -117.570, 0.60, 0.5, 2), (1, "e2", 34.1003, -117.5702, 0.58, 0.5, 3)]
    nodes = [(1, "n1", 34.1001, -117.6001, 2.0), (1, "n2", 34.1001, -117.5701, 2.0), (1, "n3", 34.1, -117.585, 0.5)]
    c = spark.createDataFrame(lots, "view_id int, id string, lat double, lon double, p_good double, stability_low double, ingest_ix int").withColumn("coverage_tau", F.lit(650.0))
    n = spark.createDataFrame(nodes, "view_id int, id string, lat double, lon double, weight double")
    picked = {r["id"] for r in coverage.select_spots(c, n, 2).collect()}

    def value(ids):
        return sum(max(w * (0.65 * p + 0.35 * s) * math.exp(-dist(la, lo, a, b) / 650) for _, i, la, lo, p, s, _ in lots if i in ids) for _, _, a, b, w in nodes)

    best = max(value(x) for x in itertools.combinations([x[1] for x in lots], 2))
    assert len(picked) == 2 and value(picked) >= 0.63 * best and value(picked) > value({"w1", "w2"})
    got = coverage.coverage_objective(c.where(F.col("id").isin(*picked)), n).first()["coverage"]
    assert got == pytest.approx(value(picked), rel=1e-12)
    dead = c.withColumns({"p_good": F.when(F.col("id") == "w1", 0.8).otherwise(0.0), "stability_low": F.lit(0.0)})
    assert [r["id"] for r in coverage.select_spots(dead, n, 3).orderBy("pick").collect()] == ["w1", "w2", "e1"]


def _market(spark, seed, nd, no):
    rnd = random.Random(seed)
    d = [(seed, f"d{i}", i, 34.1 + rnd.random() / 20, -117.6 + rnd.random() / 20, rnd.choice(["parked", "slow", "high_speed"]), rnd.random() * 9, 2) for i in range(nd)]
    o = [(seed, f"o{i}", i, *(34.1 + rnd.random() / 20 if j % 2 == 0 else -117.6 + rnd.random() / 20 for j in range(4)), rnd.random() * 20, rnd.random(), 1.0, 0.0) for i in range(no)]
    return (spark.createDataFrame(d, "market_id int, id string, ingest_ix int, lat double, lon double, motion_state string, available_at_min double, capacity int").withColumns(
        {"heading_deg": F.lit(0.0), "speed_mps": F.lit(1.0)}),
            spark.createDataFrame(o, "market_id int, id string, ingest_ix int, pickup_lat double, pickup_lon double, dropoff_lat double, dropoff_lon double, prep_time_min double, parking_friction double, customer_wait_min double, created_at_min double"))


@pytest.mark.parametrize("nd,no", [(3, 5), (5, 3), (4, 4)])
def test_matching_is_minimal(spark, nd, no):
    d, o = _market(spark, nd * 10 + no, nd, no)
    pairs = dispatch.pair_costs(dispatch.normalize_drivers(d), dispatch.normalize_orders(o)).cache()
    cost = {(r["driver_id"], r["order_id"]): r["total_cost"] for r in pairs.collect()}
    ds, os_ = sorted({k[0] for k in cost}), sorted({k[1] for k in cost})
    small, large, flip = (ds, os_, False) if nd <= no else (os_, ds, True)
    best = min(sum(cost[(b, a) if flip else (a, b)] for a, b in zip(small, perm)) for perm in itertools.permutations(large, len(small)))
    m = dispatch.match_orders(pairs).collect()
    assert len(m) == len(small) and len({r["driver_id"] for r in m}) == len({r["order_id"] for r in m}) == len(small)
    assert sum(cost[(r["driver_id"], r["order_id"])] for r in m) == pytest.approx(best, abs=1e-5)


def _pairs_of(spark, costs):
    rows = [(k, f"d{i:03d}", f"o{j:03d}", float(c)) for k, m in enumerate(costs) for i, row in enumerate(m) for j, c in enumerate(row) if c is not None]
    return spark.createDataFrame(rows, "market_id bigint, driver_id string, order_id string, total_cost double")


def test_matching_is_the_same_in_one_task_and_in_rounds(spark):
    rnd = random.Random(8)
    costs = [[[rnd.choice([0.0, 1.0, 2.5]) for _ in range(no)] for _ in range(nd)] for nd, no in ((1, 1), (3, 3), (2, 5), (5, 2), (4, 4), (6, 7))]    # ties
    costs += [[[rnd.random() * 100 for _ in range(14)] for _ in range(9)], [[9.0, None, 3.0], [None, None, 2.0], [5.0, 1.0, 4.0]]]
    pairs = _pairs_of(spark, costs).cache()
    whole = {tuple(r) for r in dispatch.match_orders(pairs).collect()}
    assert {tuple(r) for r in dispatch.match_orders(pairs, task_cells=20).collect()} == whole
    assert len(whole) == 1 + 3 + 2 + 2 + 4 + 6 + 9 + 3
    assert {(0, "d000", "o000"), (7, "d000", "o000"), (7, "d001", "o002"), (7, "d002", "o001")} <= whole


def test_large_market_finishes_in_rounds(spark):
    rng = np.random.default_rng(4)
    grid = rng.random((300, 300)) * 60
    pairs = _pairs_of(spark, [grid.tolist()]).cache()
    total = lambda rows: sum(grid[int(r["driver_id"][1:]), int(r["order_id"][1:])] for r in rows)
    alone, rounds = (dispatch.match_orders(pairs, task_cells=n).collect() for n in (90_000, 89_999))
    assert {tuple(r) for r in alone} == {tuple(r) for r in rounds} and len(alone) == 300
    assert total(alone) <= min(sum(grid[i, (i + k) % 300] for i in range(300)) for k in range(300))


def test_batches_equal_a_walk_in_driver_order(spark):
    rnd = random.Random(6)
    rows = []
    for market in range(40):
        drivers = [f"d{i}" for i in range(rnd.randint(1, 9))]
        orders = [f"o{i}" for i in range(len(drivers) + rnd.randint(0, 4))]
        owner = dict(zip(rnd.sample(orders, len(drivers)), drivers))
        own = {d: o for o, d in owner.items()}
        for d in drivers:
            rows += [(market, d, own[d], o, i, owner.get(o), rnd.random(), rnd.random()) for i, o in enumerate(orders) if o != own[d] and rnd.random() < 0.5]
    got = dispatch.take_batches(spark.createDataFrame(rows, "market_id bigint, driver_id string, order_id string, other_order_id string, other_ix bigint, owner_id string, savings double, other_cost double"))
    taken, busy, gone, want = set(), set(), set(), []
    for m, d, o, other, ix, owner, s, c in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3], r[4])):
        if (m, d) in gone or (m, d) in busy or (m, other) in taken or (m, owner) in busy:
            continue
        taken.add((m, other))
        busy.add((m, d))
        gone.add((m, owner))
        want.append((m, d, o, other, ix, owner, s, c))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect()) and len(want) > 60
    assert dispatch.take_batches(got.limit(0)).count() == 0


def test_dispatch_accounts_for_every_row(spark):
    d, o = _market(spark, 7, 4, 9)
    out = dispatch.assign_orders(d, o)
    a = out["assignments"].collect()
    used = [x for r in a for x in r["order_ids"]]
    assert len(used) == len(set(used))
    assert len(used) + out["unassigned_orders"].count() == 9 and len(a) + out["unassigned_drivers"].count() == 4
    diag = out["diagnostics"].first()
    assert diag["matched_count"] == len(used) and diag["batched_count"] == sum(len(r["order_ids"]) > 1 for r in a)
    single = dispatch.assign_orders(d, o, dispatch.DispatchParams(batching_enabled=False))["assignments"].collect()
    assert all(len(r["order_ids"]) == 1 for r in single) and len(single) == 4


def test_training_matches_plain_loop(spark):
    rnd = random.Random(5)
    rows = [(rnd.random(), rnd.random(), float(rnd.random() < 0.5), rnd.choice([0.0, 1.0, 2.0])) for _ in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, label double, weight double")
    got, loss = learned.train_logistic(df, ["a", "b"], weight="weight", iterations=12, negative=["b"])
    w = [0.0, 0.0, 0.0]
    for _ in range(12):
        g = [0.0, 0.0, 0.0]
        for a, b, y, k in rows:
            e = (1 / (1 + math.exp(-(w[0] + w[1] * a + w[2] * b))) - y) * (k or 1)
            g = [g[0] + e, g[1] + e * a, g[2] + e * b]
        w = [w[0] - 0.2 * g[0] / 60, w[1] - 0.2 * (g[1] / 60 + 0.04 * w[1]), min(0.0, w[2] - 0.2 * (g[2] / 60 + 0.04 * w[2]))]
    assert [got["intercept"], got["a"], got["b"]] == pytest.approx(w, rel=1e-9) and loss > 0


def test_heading_examples(spark):
    one = spark.range(1)

    def val(c):
        return one.select(c.alias("x")).first()["x"]

    assert val(geo.heading_delta(F.lit(10.0), F.lit(350.0))) == 20
    assert val(geo.interpolate_heading(F.lit(350.0), F.lit(10.0), F.lit(0.5))) == 0
    assert val(geo.low_pass_heading(F.lit(45.0), F.lit(46.0))) == 45
    assert val(geo.low_pass_heading(F.lit(0.0), F.lit(90.0))) == pytest.approx(61.2)
    assert val(geo.normalize_heading(F.lit(-10.0))) == 350 and val(geo.normalize_heading(F.lit(float("nan")))) is None
    assert val(geo.course_deg(F.lit(34.0), F.lit(-117.6), F.lit(34.0), F.lit(-117.5))) == pytest.approx(90, abs=2)
    assert val(geo.course_deg(F.lit(34.0), F.lit(-117.6), F.lit(34.0), F.lit(-117.6000005))) is None


def test_reroute_gate_compares_with_last_accepted(spark):
    rows = [(1, float(t), 34.0 + m / 111320, -117.0) for t, m in [(0, 0), (3, 40), (5, 20), (6, 50), (8, 70), (11, 75), (12, 85)]]
    df = spark.createDataFrame(rows, "k int, t double, lat double, lon double")
    got = folds.fold_sorted(df, "k", ["t"], ["t", "lat", "lon"], "ok BOOLEAN", folds.reroute_step).orderBy("t").collect()
    assert [r["ok"] for r in got] == [True, False, False, True, False, False, True]


def test_nearest_parking_across_cells(spark):
    rnd = random.Random(11)
    a = [(1, f"a{i}", 34.99 + rnd.random() / 50, -117.6 + rnd.random() / 50) for i in range(60)]
    p = [(1, f"l{i}", 34.99 + rnd.random() / 50, -117.6 + rnd.random() / 50, f"L{i}", i) for i in range(60)]
    got = {r["point_id"]: r["lot_id"] for r in nearby.nearest_parking(
        spark.createDataFrame(a, "view_id int, point_id string, lat double, lon double"),
        spark.createDataFrame(p, "view_id int, id string, lat double, lon double, name string, place_rank int")).collect()}
    want = {}
    for _, n, la, lo in a:
        c = sorted((math.floor(dist(la, lo, x[2], x[3]) + 0.5), x[5], x[1]) for x in p)
        if c[0][0] <= 480:
            want[n] = c[0][2]
    assert got == want


def test_pairs_across_the_meridian_and_with_mixed_radii(spark):
    rnd = random.Random(12)
    a = [(1, f"a{i}", rnd.uniform(-66, 66), rnd.choice([179.99, -179.99]) + rnd.uniform(-0.0099, 0.0099)) for i in range(80)]
    p = [(1, f"p{i}", x[2] + rnd.uniform(-0.002, 0.002), (x[3] + rnd.uniform(-0.012, 0.012) + 180) % 360 - 180, rnd.choice([5.0, 300.0, 900.0])) for i, x in enumerate(a)]
    anchors = spark.createDataFrame(a, "view_id int, point_id string, lat double, lon double")
    places = spark.createDataFrame(p, "view_id int, id string, lat double, lon double, r double")
    want = {(x[1], y[1]) for x in a for y in p if dist(x[2], x[3], y[2], y[3]) <= y[4] + 0.5}
    got = [(r["point_id"], r["id"]) for r in nearby.cell_pairs(anchors, places, radius_col="r").collect()]
    assert set(got) == want and len(got) == len(want) and any(abs(x[3] - y[3]) > 300 for x in a for y in p if (x[1], y[1]) in want)
    want = {(x[1], y[1]) for x in a for y in p if dist(x[2], x[3], y[2], y[3]) <= 900.5}
    assert {(r["point_id"], r["id"]) for r in nearby.cell_pairs(anchors, places, 900.0).collect()} == want


def test_places_in_boxes_by_position(spark):
    rnd = random.Random(13)
    p = [(f"p{i}", rnd.uniform(-80, 80), rnd.uniform(-180, 180)) for i in range(300)] + [("n", None, 1.0), ("c", 0.0, 0.0), ("m", 10.0, 180.0)]
    v = []
    for i in range(40):
        h, s, w = 10 ** rnd.uniform(-2, 1.8), rnd.uniform(-80, 60), rnd.uniform(-180, 180)
        v.append((i, s, w, s + h, (w + h + 180) % 360 - 180))
    v += [(100, 0.0, 0.0, 0.0, 0.0), (101, -90.0, -180.0, 90.0, 180.0), (102, -1.0, 170.0, 20.0, -170.0)]
    def inside(b, y, x):
        return y is not None and b[1] <= y <= b[3] and (b[2] <= x <= b[4] if b[2] <= b[4] else x >= b[2] or x <= b[4])
    got = [(r["view_id"], r["id"]) for r in predicates.place_in_views(spark.createDataFrame(p, "id string, lat double, lon double"),
                                                                   spark.createDataFrame(v, "view_id int, south double, west double, north double, east double")).collect()]
    want = {(b[0], q[0]) for b in v for q in p if inside(b, q[1], q[2])}
    assert set(got) == want and len(got) == len(want)


def test_box_and_kind_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("a", 1.0, 2.0, "cafe")], "id string, lat double, lon double, amenity string").write.parquet(str(tmp_path / "p"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    df = place_sources.scan_places(spark.read.parquet(str(tmp_path / "p")), place_sources.is_merchant(), 0.0, 0.0, 5.0, 5.0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(lat,0.0)" in pushed and "LessThanOrEqual(lon,5.0)" in pushed and "In(amenity" in pushed and df.count() == 1


def test_asof_keeps_null_keys_and_orders_ties(spark):
    rows = [(None, 1.0, 1, 5), (1, 2.0, 2, None), (1, None, 3, 7), (1, 3.0, 4, 8), (None, 2.0, 5, None)]
    df = spark.createDataFrame(rows, "k int, t double, id int, v int").withColumn("ts", F.col("t").cast("timestamp"))
    assert {r["id"]: r["c"] for r in asof.carry_forward(df, "k", "ts", "id", "v", "c").collect()}[5] == 5
    prev = {r["id"]: r["prev_v"] for r in asof.previous_row(df, "k", "ts", "id", ["v"]).collect()}
    assert len(prev) == 5 and prev[5] == 5 and prev[1] is None
    right = spark.createDataFrame([(1, 1.0, n) for n in (3, 9, 4)], "k int, t double, x int").withColumn("ts", F.col("t").cast("timestamp"))
    assert asof.asof_latest(df.where("id = 2").drop("t"), right, "k", "ts", ["x"], 10.0).first()["x"] == 9
    ranks = {(r["k"], r["v"]): (r["upper_rank"], r["group_rows"]) for r in stats.upper_rank(df, ["k"], "v").collect()}
    assert ranks == {(None, 5): (1, 1), (None, None): (None, 1), (1, None): (None, 2), (1, 7): (1, 2), (1, 8): (2, 2)}


def test_feature_files_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, 2.5, 0.25), ("b", -3.0, 4.0, 0.5)], "id string, lat double, lon double, p_good double")
    for name, features, key in (("heat", sinks.heat_features(df), "intensity"), ("places", sinks.place_features(df), "id"),
                                ("circles", df.select(sinks.circle_feature("lat", "lon", F.lit(20.0)).alias("value")), "accuracyMeters")):
        sinks.write_features(features, str(tmp_path / name))
        got = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / name)).collect()]
        assert len(got) == 2 and all(g["type"] == "Feature" and key in g["properties"] for g in got)
        if name == "circles":
            assert all(len(g["geometry"]["coordinates"][0]) == 49 for g in got)
        else:
            assert sorted(g["geometry"]["coordinates"] for g in got) == [[2.5, 1.5], [4.0, -3.0]]


def test_views_open_only_their_cells(spark, tmp_path):
    rnd = random.Random(21)
    rows = [(f"p{i}", rnd.uniform(-80, 80), rnd.uniform(-180, 180), i % 2) for i in range(800)] + [("e", 10.0, 179.9, 1), ("w", 10.0, -179.9, 1), ("n", None, 3.0, 1)]
    place_sources.lay_out(spark.createDataFrame(rows, "id string, lat double, lon double, kind int"), str(tmp_path / "cells"))
    views = [(1, 30.0, 41.0, -20.0, 12.0), (2, -12.0, 1.0, 100.0, 101.0), (3, 5.0, 15.0, 178.0, -178.0)]
    got = place_sources.read_in_views(spark, str(tmp_path / "cells"), spark.createDataFrame(views, "view_id int, south double, north double, west double, east double"), F.col("kind") == 1)
    inside = lambda w, e, x: w <= x <= e if w <= e else x >= w or x <= e
    want = {(v, i) for v, s, n, w, e in views for i, la, lo, k in rows if la is not None and k == 1 and s <= la <= n and inside(w, e, lo)}
    assert {(r["view_id"], r["id"]) for r in got.collect()} == want and (3, "e") in want and (3, "w") in want
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):].split("]")[0]
    assert "cell_y" in filters and "cell_x" in filters
    assert len(predicates.cells_of(spark.createDataFrame(views, "view_id int, south double, north double, west double, east double"), 5.0)) < 40


def test_local_clock_of_an_instant_and_a_zone(spark):
    from datetime import datetime
    from zoneinfo import ZoneInfo
    rows = [("2024-03-10 09:59:00", "America/Los_Angeles"), ("2024-03-10 10:01:00", "America/Los_Angeles"), ("2024-12-31 23:30:00", "Asia/Kolkata"), ("2024-01-01 00:10:00", "UTC")]
    day, minute = local_clock("t", "z")
    got = spark.createDataFrame(rows, "s string, z string").withColumn("t", F.col("s").cast("timestamp")).select("s", "z", day.alias("d"), minute.alias("m")).collect()
    for r in got:
        local = datetime.fromisoformat(r["s"]).replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(r["z"]))
        assert (r["d"], r["m"]) == (local.weekday(), local.hour * 60 + local.minute)


def test_grid_axes_are_folded_once_a_view(spark):
    """The fold of an axis stays above the step that makes views from places; a view without extent has no nodes."""
    from curbcast.operators.grid import grid_nodes
    places = spark.range(2000).selectExpr("id % 3 AS view_id").distinct()
    views = places.selectExpr("view_id", "34.1 AS south", "CASE WHEN view_id = 2 THEN 34.0 ELSE 34.11 END AS north", "-117.6 AS west", "-117.59 AS east", "350.0 AS grid_step").selectExpr(
        "view_id", "south + view_id / 10e0 AS south", "CASE WHEN view_id = 2 THEN 30e0 ELSE north + view_id / 10e0 END AS north", "CAST(west AS DOUBLE) AS west", "CAST(east AS DOUBLE) AS east", "grid_step")
    nodes = grid_nodes(views)
    plan = nodes._jdf.queryExecution().optimizedPlan().toString().split("\n")
    made = next(i for i, line in enumerate(plan) if "Aggregate [" in line)
    assert not any("lambdafunction" in line for line in plan[made:])
    assert {r.view_id: r["count"] for r in nodes.groupBy("view_id").count().collect()}.keys() == {0, 1}


def test_route_texts_are_not_written_between_stages(spark, tmp_path, monkeypatch):
    """Route queries write what is known about destinations, not whole routes with all their texts."""
    from pathlib import Path
    from curbcast import checkpoints
    from curbcast.plans import queries_moves, registry
    from curbcast.plans.tables import Tables
    registry.load()
    monkeypatch.setattr(checkpoints, "stage_root", lambda _: str(tmp_path))
    rows = queries_moves._snapshot(Tables(spark, "/root/testdata/sf0.001")).select("route_id", "curbside_label").collect()
    written = [spark.read.parquet(str(p)).columns for p in Path(tmp_path, "curbcast").iterdir()]
    assert len(rows) == len({r.route_id for r in rows}) > 0
    assert written and not any("route_id" in columns for columns in written)
