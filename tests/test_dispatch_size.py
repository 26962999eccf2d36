"""What a dispatch writes and computes for each pair of a market."""
import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from curbcast.operators import dispatch
from curbcast.operators.blocks import computed
from curbcast.plans import queries_moves
from curbcast.plans.registry import queries

SMALL = "/root/testdata/sf0.001"


def _staged(monkeypatch, module):
    written, real = {}, module.stage

    def stage(df, name="t"):
        out = real(df, name)
        written.setdefault(name, []).append(out)
        return out
    monkeypatch.setattr(module, "stage", stage)
    return written


def test_pairs_of_a_dispatch_are_kept_as_keys_and_cost(spark, monkeypatch):
    t = queries_moves.Tables(spark, SMALL)
    pairs = dispatch.pair_costs(dispatch.normalize_drivers(t.drivers), dispatch.normalize_orders(t.orders_derived)).count()
    written = _staged(monkeypatch, dispatch)
    out = dispatch.assign_orders(t.drivers, t.orders_derived)
    assert out["assignments"].count() > 0
    whole = [df.columns for name in written for df in written[name] if df.count() >= pairs]
    assert whole == [["market_id", "driver_id", "order_id", "total_cost"]]


def test_costs_of_matches_are_those_of_their_pairs(spark):
    t = queries_moves.Tables(spark, SMALL)
    d, o = dispatch.normalize_drivers(t.drivers), dispatch.normalize_orders(t.orders_derived)
    pairs = dispatch.pair_costs(d, o).cache()
    some = pairs.where(F.xxhash64("driver_id", "order_id") % 3 == 0)
    again = dispatch.matched_costs(d, o, some.select("market_id", "driver_id", "order_id")).select(*pairs.columns)
    assert sorted(map(str, again.collect())) == sorted(map(str, some.collect())) and some.count() > 10


def test_savings_of_every_two_orders_are_not_kept_nor_joined_with_their_seeds(spark, monkeypatch):
    import curbcast.plans.queries_field as queries_field
    written = _staged(monkeypatch, queries_field)
    df = queries()["dsp_7_route_savings"](spark, SMALL)
    assert df.count() > 0 and "savings" not in written
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_a_computed_column_is_computed_once(spark):
    df = computed(spark.range(4).withColumn("x", F.rand(1)), {"y": F.atan2("x", F.lit(3.0))})
    df = df.withColumn("z", F.col("y") * F.col("y") + F.col("y")).where(F.col("z") > F.col("y"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("ATAN2") == 1


def _brute_force(cells):
    """The matching of one market by trying all of them: weights as in ``_weights``, missing cells dearest."""
    drivers, orders = sorted({d for d, _ in cells}), sorted({o for _, o in cells})
    micro = np.array([[cells.get((d, o), dispatch.NO_PAIR) for o in orders] for d in drivers], object)
    weights, _ = dispatch._weights(micro, np.arange(len(drivers))[:, None], np.arange(len(orders))[None, :], len(drivers), len(orders))
    flip = len(drivers) > len(orders)
    w = weights.T if flip else weights
    best = min(itertools.permutations(range(w.shape[1]), w.shape[0]), key=lambda js: sum(int(w[i, j]) for i, j in enumerate(js)))
    pairs = [(j, i) if flip else (i, j) for i, j in enumerate(best)]
    return {(drivers[i], orders[j]) for i, j in pairs if (drivers[i], orders[j]) in cells}


def test_markets_of_one_shape_are_matched_together(monkeypatch):
    rnd, markets = random.Random(5), {}
    for m in range(300):
        # Every third market lacks cells, every fifth has costs whose weights pass 64 bits.
        top = 10 ** 17 if m % 5 == 0 else 10 ** 8
        cells = {(f"d{d}", f"o{o}"): rnd.randrange(top) for d in range(1 + m % 4) for o in range(1 + m % 5) if m % 3 or rnd.random() < 0.7}
        if cells:
            markets[m] = cells
    table = pa.table({"market_id": [m for m, cells in markets.items() for _ in cells], "driver_id": [d for cells in markets.values() for d, _ in cells],
                      "order_id": [o for cells in markets.values() for _, o in cells], "micro": [c for cells in markets.values() for c in cells.values()]})
    calls, real = [], dispatch._shortest_path_matchings
    monkeypatch.setattr(dispatch, "_shortest_path_matchings", lambda c, top: calls.append(len(c)) or real(c, top))
    found = pa.Table.from_batches(list(dispatch._match_sorted(iter(table.to_batches(max_chunksize=97))))).to_pylist()
    got = {m: {(r["driver_id"], r["order_id"]) for r in found if r["market_id"] == m} for m in markets}
    assert got == {m: _brute_force(cells) for m, cells in markets.items()}
    assert sum(calls) == len(markets) and len(calls) <= 2 * 20
    # Cut anywhere, the result is the same.
    monkeypatch.setattr(dispatch, "STEP_CELLS", 50)
    again = pa.Table.from_batches(list(dispatch._match_sorted(iter(table.to_batches(max_chunksize=7))))).to_pylist()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_what_is_unassigned_prices_nothing(spark, monkeypatch):
    t = queries_moves.Tables(spark, SMALL)
    written = _staged(monkeypatch, dispatch)
    out = dispatch.assign_orders(t.drivers, t.orders_derived)
    assert out["unassigned_drivers"].count() > 0 and out["unassigned_orders"].count() > 0
    assert "assignments" not in written and [df.columns for df in written["decided"]] == [["market_id", "driver_id", "order_ids"]]
    for name in ("unassigned_drivers", "unassigned_orders", "diagnostics"):
        assert "ATAN2" not in out[name]._jdf.queryExecution().optimizedPlan().toString()
