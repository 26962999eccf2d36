"""Folds as streams: order across Arrow chunks, late rows, lifetimes, expiry."""
import random
import time
from datetime import datetime, timedelta, timezone

import pytest

from curbcast.streaming import folds, jobs

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "id int, k string, ts timestamp, t double, lat double, lon double"


def fixes(n, seed=1, keys=2):
    rnd = random.Random(seed)
    rows, y = [], 0.0
    for i in range(n):
        y += rnd.uniform(0, 60) / 111320
        t = i * rnd.choice([2.0])
        rows.append((i, f"k{i % keys}", T0 + timedelta(seconds=t), t, 34.0 + y, -117.0))
    return rows


def run(spark, tmp_path, batches, **options):
    src = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    out = jobs.fold_stream(stream, "k", ["ts", "id"], ["t", "lat", "lon"], "ok BOOLEAN", "t DOUBLE, lat DOUBLE, lon DOUBLE", folds.reroute_step, **options)
    sink = out.writeStream.format("memory").queryName("fold_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c"))
    if "ttl_ms" in options:           # a lifetime keeps the query alive for its timers
        q = sink.start()
        end = time.time() + 90
        while not spark.table("fold_out").count() and time.time() < end:
            time.sleep(1)
        q.stop()
    else:
        q = sink.trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    return {r["id"]: r["ok"] for r in spark.table("fold_out").collect()}


def batch(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["id"]: r["ok"] for r in folds.fold_sorted(df, "k", ["ts", "id"], ["t", "lat", "lon"], "ok BOOLEAN", folds.reroute_step).collect()}


@pytest.fixture
def small_chunks(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_order_across_chunks(spark, tmp_path, small_chunks):
    rows = fixes(60)
    parts = [rows[:30], rows[30:]]
    for p in parts:
        random.Random(2).shuffle(p)
    assert run(spark, tmp_path, parts) == batch(spark, rows)


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path, small_chunks):
    rows = fixes(20, keys=1)
    late = [(100, "k0", T0 - timedelta(hours=30), -108000.0, 34.0, -117.0)]
    far = [(200, "k9", T0 + timedelta(hours=2), 7200.0, 34.0, -117.0)]
    got = run(spark, tmp_path, [rows, far, late], watermark="1 minute")
    assert 100 not in got and {i: got[i] for i in range(20)} == batch(spark, rows)


def test_expired_state_starts_anew(spark, tmp_path, small_chunks):
    first, again = fixes(1, keys=1), [(50, "k0", T0 + timedelta(hours=3), 10800.0, 34.0, -117.0)]
    other = [(60, "k9", T0 + timedelta(hours=2), 7200.0, 34.0, -117.0)]
    assert run(spark, tmp_path, [first, other, other[:0] or [(61, "k9", T0 + timedelta(hours=2, seconds=5), 7205.0, 34.0, -117.0)], again], watermark="1 minute", expire_ms=60_000)[50] is True


def test_state_that_does_not_expire_remembers(spark, tmp_path, small_chunks):
    first, again = fixes(1, keys=1), [(50, "k0", T0 + timedelta(hours=3), 10800.0, 34.0, -117.0)]
    assert run(spark, tmp_path, [first, again], watermark="1 minute")[50] is False


def test_lifetime_runs(spark, tmp_path):
    rows = fixes(10)
    assert run(spark, tmp_path, [rows], ttl_ms=3_600_000) == batch(spark, rows)
    with pytest.raises(ValueError):
        jobs.fold_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "k", ["ts"], ["t"], "ok BOOLEAN", "t DOUBLE", folds.reroute_step, ttl_ms=1, expire_ms=1)


def test_many_keys_are_dealt_to_parts(spark, tmp_path, small_chunks):
    """A call into Python takes a part of the keys; one call a key takes milliseconds each."""
    rows = fixes(3600, keys=1500)
    assert run(spark, tmp_path, [rows[:2000][::-1], rows[2000:][::-1]]) == batch(spark, rows)
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    out = jobs.fold_stream(stream, "k", ["ts", "id"], ["t", "lat", "lon"], "ok BOOLEAN", "t DOUBLE, lat DOUBLE, lon DOUBLE", folds.reroute_step)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "_part" in plan and "TransformWithState" not in plan


# --- ordered folds, stale readings and the history table

def land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run_slices(spark, tmp_path, slices, schema, job, name):
    """Each slice is a run of the same query: a micro-batch of its own."""
    src = str(tmp_path / "in")
    for rows in slices:
        land(spark, src, rows, schema)
        df = job(spark.readStream.schema(schema).parquet(src))
        q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    return spark.read.schema(df.schema).parquet(str(tmp_path / "out"))


def test_order_across_micro_batches(spark, tmp_path, small_chunks):
    """Rows that land a micro-batch too late are still walked in their place."""
    rows = fixes(60)
    slices = [[r for r in rows if (r[0] + 7 * (r[0] % 3)) // 25 == k] for k in range(4)]
    assert all(max(a[0] for a in x) > min(b[0] for b in y) for x, y in zip(slices, slices[1:]) if x and y)
    for s in slices:
        random.Random(2).shuffle(s)
    beats = [[(-1, "beat", T0 + timedelta(hours=h), 0.0, 34.0, -117.0)] for h in (5, 9)]
    out = run_slices(spark, tmp_path, [s for s in slices if s] + beats, SCHEMA, lambda s: jobs.ordered_fold(
        s, "k", ["ts", "id"], ["t", "lat", "lon"], "ok BOOLEAN", folds.reroute_step, "2 minutes", 10.0), "ordered")
    assert {r["id"]: r["ok"] for r in out.where("id >= 0").collect()} == batch(spark, rows)


def test_ordered_state_expires(spark, tmp_path):
    rows = [(0, "k0", T0, 0.0, 34.0, -117.0), (1, "k0", T0 + timedelta(seconds=30), 30.0, 34.0, -117.0), (2, "k0", T0 + timedelta(minutes=30), 1800.0, 34.0, -117.0)]
    beats = [[(-1, "beat", T0 + timedelta(hours=h), 0.0, 34.0, -117.0)] for h in (5, 9)]
    out = run_slices(spark, tmp_path, [rows, *beats], SCHEMA, lambda s: jobs.ordered_fold(
        s, "k", ["ts", "id"], ["t", "lat", "lon"], "ok BOOLEAN", folds.reroute_step, "1 minute", 10.0, expire_s=60.0), "expiry")
    assert {r["id"]: r["ok"] for r in out.where("id >= 0").collect()} == {0: True, 1: False, 2: True}


def test_a_timer_tells_stale_readings(spark, tmp_path):
    at = lambda ms: T0 + timedelta(milliseconds=ms)
    first = [("a", at(0)), ("a", at(2000)), ("a", at(9000)), ("b", at(500))]
    late = [("a", at(10_500)), ("a", at(3000)), ("other", at(60_000))]
    out = run_slices(spark, tmp_path, [first, late, [("other", at(3_600_000))], [("other", at(7_200_000))]], "device_id string, ts timestamp",
                     lambda s: jobs.stale_readings(s, limit_s=2.2, delay="10 seconds", bucket_s=5.0), "stale")
    got = sorted((r.device_id, round((r.last_at.timestamp() - T0.timestamp()) * 1000)) for r in out.collect() if r.device_id != "other")
    assert got == [("a", 3000), ("a", 10_500), ("b", 500)]


def test_history_rewrites_changed_parts_only(spark, tmp_path):
    from curbcast.operators.places import place_history, retain_newest
    schema = "event_id bigint, user_id bigint, place_id bigint, kind string, ts timestamp, title string"
    rnd = random.Random(3)
    rows = [(i, rnd.randrange(30), rnd.randrange(6), rnd.choice(["open", "route"]), T0 + timedelta(minutes=i), f"t{i}") for i in range(300)]
    target = str(tmp_path / "table")
    for n, part in enumerate((rows[:200], rows[200:])):
        jobs.merge_history(spark.createDataFrame(part, schema), n, target, 240, 8)
    again = spark.createDataFrame(rows[200:], schema)
    jobs.merge_history(again, 1, target, 240, 8)                    # a batch that is run again changes nothing
    cols = ["user_id", "place_id", "open_count", "route_count", "first_seen_at", "last_opened_at", "last_route_at", "title"]
    want = place_history(spark.createDataFrame(rows, schema)).select(cols)
    assert sorted(map(str, spark.read.parquet(target).select(cols).collect())) == sorted(map(str, want.collect()))
    one = [(900, 3, 1, "open", T0 + timedelta(days=2), "new")]
    before = {r.part for r in spark.read.parquet(target).where("batch = 1").select("part").distinct().collect()}
    jobs.merge_history(spark.createDataFrame(one, schema), 2, target, 2, 8)
    table = spark.read.parquet(target)
    assert table.where("batch = 2").select("part").distinct().count() == 1 and table.where("batch < 2").count() > 0 and before
    mine = table.where("user_id = 3").collect()
    assert len(mine) == 2 and max(r.last_opened_at for r in mine) == max(r.last_opened_at for r in table.collect())


def test_many_devices_share_a_part(spark, tmp_path, monkeypatch):
    """State entries and calls into Python are counted by parts, not by devices; each device keeps its own order and state."""
    monkeypatch.setattr(jobs, "PARTS", 4)
    rows = fixes(120, keys=40)
    mixed = rows[:]
    random.Random(5).shuffle(mixed)
    schema, src = SCHEMA, str(tmp_path / "in")
    beats = [[(-1, "beat", T0 + timedelta(hours=h), 0.0, 34.0, -117.0)] for h in (5, 9)]
    counts = []
    for part in (mixed[:60], mixed[60:], *beats):
        land(spark, src, part, schema)
        out = jobs.ordered_fold(spark.readStream.schema(schema).parquet(src), "k", ["ts", "id"], ["t", "lat", "lon"], "ok BOOLEAN", folds.reroute_step, "10 minutes", 10.0)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        counts += [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
    got = {r["id"]: r["ok"] for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).where("id >= 0").collect()}
    assert got == batch(spark, rows) and 0 < max(counts) <= 4


def test_state_tasks_follow_the_cores(spark, tmp_path):
    """Neither tasks without rows nor micro-batches without rows open state stores."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        rows, progress = fixes(60), []
        beats = [[(-1, "beat", T0 + timedelta(hours=h), 0.0, 34.0, -117.0)] for h in (5, 9)]
        for part in (rows, *beats):
            land(spark, str(tmp_path / "in"), part, SCHEMA)
            out = jobs.ordered_fold(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "k", ["ts", "id"], ["t", "lat", "lon"], "ok BOOLEAN", folds.reroute_step, "10 minutes", 10.0)
            progress += jobs.run_available(out, str(tmp_path / "out"), str(tmp_path / "c"), empty_batches=False).recentProgress
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = {r["id"]: r["ok"] for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).where("id >= 0").collect()}
    stores = [o["numStateStoreInstances"] for p in progress for o in p["stateOperators"] if p["numInputRows"]]
    assert got == batch(spark, rows) and len(stores) == 3 and max(stores) <= 2 * spark.sparkContext.defaultParallelism
