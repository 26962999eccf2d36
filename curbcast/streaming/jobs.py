"""Structured Streaming jobs built from the same steps as the batch folds."""
from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType, _parse_datatype_string

from ..checkpoints import stage
from .folds import Step

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FoldProcessor(StatefulProcessor):
    """Runs one step per key over its rows in event-time order.

    All rows of a key in a micro-batch are sorted together, however Arrow cuts
    them; the source's rate limit bounds them.  State is one small row.  It
    ends ``expire_ms`` of event time after the key's newest row, or with a
    processing-time lifetime ``ttl_ms``.
    """

    def __init__(self, key: str, order: Sequence[str], inputs: Sequence[str], out_names: Sequence[str], state_ddl: str,
                 step_factory: Callable[[], Step], ts: str = "ts", ttl_ms: int | None = None, expire_ms: int | None = None):
        self.key, self.order, self.inputs, self.ts = key, list(order), list(inputs), ts
        self.out_names, self.state_ddl, self.step_factory, self.ttl_ms, self.expire_ms = list(out_names), state_ddl, step_factory, ttl_ms, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.step, self.handle = self.step_factory(), handle
        self.state = handle.getValueState("fold", self.state_ddl, self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else None
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        outs = []
        for row in pdf[self.inputs].itertuples(index=False, name=None):
            state, out = self.step(state, row)
            outs.append(out)
        yield pd.concat([pdf, pd.DataFrame(outs, columns=self.out_names, index=pdf.index, dtype=object)], axis=1)
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
        if self.expire_ms is not None:
            ends = int(pdf[self.ts].max().timestamp() * 1000) + self.expire_ms
            for timer in list(self.handle.listTimers()):
                ends = max(ends, timer)
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ends)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def fold_stream(df: DataFrame, key: str, order: Sequence[str], inputs: Sequence[str], outputs: str, state_ddl: str,
                step_factory: Callable[[], Step], watermark: str | None = "10 minutes", ts: str = "ts",
                ttl_ms: int | None = None, expire_ms: int | None = None) -> DataFrame:
    """Streaming form of ``fold_sorted``; state needs the RocksDB provider.

    With a watermark, rows older than it are dropped and ``expire_ms`` may end
    quiet keys.  ``ttl_ms`` is a lifetime in processing time, which event time
    excludes: with it there is no watermark.  Without either, keys are dealt to
    parts (:class:`DealtFold`) and Python is called once a part, not once a key.
    """
    if ttl_ms is not None and expire_ms is not None:
        raise ValueError("state ends either by event time or by a lifetime")
    if expire_ms is not None and watermark is None:
        raise ValueError("expiry by event time needs a watermark")
    out = _parse_datatype_string(outputs)
    schema = StructType([*df.schema.fields, *[StructField(f.name, f.dataType, True) for f in out.fields]])
    late = watermark is not None and ttl_ms is None
    src = df.withWatermark(ts, watermark) if late else df
    if ttl_ms is None and expire_ms is None:
        return _ordered(src, key, DealtFold(key, order, inputs, df.columns, [f.name for f in out.fields], step_factory), schema,
                        GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout)
    return src.groupBy(key).transformWithStateInPandas(
        statefulProcessor=FoldProcessor(key, order, inputs, [f.name for f in out.fields], state_ddl, step_factory, ts, ttl_ms, expire_ms),
        outputStructType=schema, outputMode="Append", timeMode="EventTime" if late else "ProcessingTime" if ttl_ms is not None else "None")


# Devices share this many state entries, so that Python is called once a part, not once a device, of a micro-batch.
PARTS = 512


class DealtFold:
    """Runs one step per key over its rows of a micro-batch in order, for all keys of a part.

    Keys are dealt to parts by hash and a part is one state entry, as in
    :class:`OrderedRows`.  A part's rows of a micro-batch are sorted together; the
    source's rate limit bounds them.
    """

    def __init__(self, key: str, order: Sequence[str], inputs: Sequence[str], columns: Sequence[str], out_names: Sequence[str], step_factory: Callable[[], Step]):
        self.key, self.order, self.inputs = key, list(order), list(inputs)
        self.columns, self.out_names, self.step_factory = list(columns), list(out_names), step_factory

    def __call__(self, part: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = [] if state.hasTimedOut else [chunk for chunk in chunks if len(chunk)]
        if not rows:
            return
        held = pickle.loads(state.get[0]) if state.exists else {}
        pdf, step, outs = pd.concat(rows, ignore_index=True)[self.columns].sort_values(self.order, kind="stable"), self.step_factory(), []
        for key, row in zip(pdf[self.key].tolist(), pdf[self.inputs].itertuples(index=False, name=None)):
            key = key if key == key else None
            kept, out = step(held.get(key), row)
            outs.append(out)
            if kept is None:
                held.pop(key, None)
            else:
                held[key] = kept
        if held:
            state.update((pickle.dumps(held, protocol=5),))
        elif state.exists:
            state.remove()
        yield pd.concat([pdf, pd.DataFrame(outs, columns=self.out_names, index=pdf.index, dtype=object)], axis=1)


class OrderedRows:
    """Rows of every key in event-time order across micro-batches.

    Rows wait in state until the watermark passes the end of their time bucket;
    then nothing older can come, and a key's rows are sorted and walked.  Keys are
    dealt to parts by hash and a part is one state entry, which reaches Python in
    the same Arrow batches as the rows: a call costs far more than a row.  State
    holds what came within the watermark's delay and a bucket, plus a micro-batch;
    the source's rate limit bounds the latter.  Times are whole micro-seconds.
    """

    def __init__(self, key: str, inputs: Sequence[str], outputs: Sequence[str], bucket_ms: int):
        self.columns, self.outputs, self.bucket_ms = [key, *inputs], list(outputs), bucket_ms

    def at(self, row: tuple) -> int:
        raise NotImplementedError

    def order(self, row: tuple) -> Any:
        raise NotImplementedError

    def walk(self, key: Any, rows: list[tuple], held: Any) -> tuple[list[tuple], Any]:
        """Outputs of rows that are due, in order, and what the key keeps."""
        raise NotImplementedError

    def rest(self, key: Any, held: Any, waiting: list[tuple], now: int) -> tuple[list[tuple], Any, int | None]:
        """Outputs without further rows, what is kept, and when (ms) to look again."""
        return [], held, None

    def __call__(self, part: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys = pickle.loads(state.get[0]) if state.exists else {}
        if not state.hasTimedOut:
            for chunk in chunks:
                for key, *row in zip(*(chunk[c].tolist() for c in self.columns)):
                    keys.setdefault(key if key == key else None, ([], None))[0].append(tuple(row))
        now = state.getCurrentWatermarkMs()
        ended = now // self.bucket_ms * self.bucket_ms * 1000
        outs, timers = [], []
        for key, (waiting, held) in list(keys.items()):
            due = sorted((row for row in waiting if self.at(row) < ended), key=self.order)
            if due:
                waiting = [row for row in waiting if self.at(row) >= ended]
                found, held = self.walk(key, due, held)
                outs += found
            found, held, again = self.rest(key, held, waiting, now)
            outs += found
            if waiting:
                timers.append((min(map(self.at, waiting)) // (self.bucket_ms * 1000) + 1) * self.bucket_ms)
            if again is not None:
                timers.append(again)
            if waiting or held is not None:
                keys[key] = (waiting, held)
            else:
                del keys[key]
        if keys:
            state.update((pickle.dumps(keys, protocol=5),))
            if timers:
                state.setTimeoutTimestamp(max(now + 1, min(timers)))
        elif state.exists:
            state.remove()
        if outs:
            yield pd.DataFrame(outs, columns=self.outputs, dtype=object)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append", empty_batches: bool = True) -> StreamingQuery:
    """Run a stateful stream over all that has landed and write its rows.

    Every micro-batch opens and commits each task's state store, however few rows
    it gets, so a stream runs with two state tasks a core and not with one a
    shuffle partition; a checkpoint keeps the number it began with.  Without
    ``empty_batches`` timers wait for the next micro-batch that has rows.
    """
    spark = df.sparkSession
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.shuffle.partitions": str(tasks),
              "spark.sql.streaming.noDataMicroBatches.enabled": str(empty_batches).lower()}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        # A query keeps the settings it starts with.
        q = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode(mode).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    q.awaitTermination()
    return q


def _sortable(value: Any) -> tuple:
    """Nulls last, as pandas sorts."""
    return (True, 0) if value is None or value != value else (False, value)


class OrderedFold(OrderedRows):
    """A step over a key's rows in order; rows without output are dropped.

    ``expire_ms`` of event time after its newest row a key's state ends.
    """

    def __init__(self, key: str, columns: Sequence[str], order: Sequence[str], inputs: Sequence[str], outputs: Sequence[str], at: str, step_factory: Callable[[], Step], bucket_ms: int, expire_ms: int | None):
        super().__init__(key, columns, outputs, bucket_ms)
        ix = list(columns).index
        self.at_ix, self.order_ix, self.input_ix = ix(at), [ix(c) for c in order], [ix(c) for c in inputs]
        self.step_factory, self.expire_us = step_factory, None if expire_ms is None else expire_ms * 1000

    def at(self, row: tuple) -> int:
        return row[self.at_ix]

    def order(self, row: tuple) -> list:
        return [_sortable(row[i]) for i in self.order_ix]

    def walk(self, key: Any, rows: list[tuple], held: Any) -> tuple[list[tuple], Any]:
        step, (newest, state), outs = self.step_factory(), held or (None, None), []
        for row in rows:
            if self.expire_us is not None and newest is not None and self.at(row) - newest > self.expire_us:
                state = None
            state, out = step(state, tuple(row[i] for i in self.input_ix))
            newest = self.at(row)
            if out is not None:
                outs.append((key, *row, *out))
        return outs, (newest, state)

    def rest(self, key: Any, held: Any, waiting: list[tuple], now: int) -> tuple[list[tuple], Any, int | None]:
        if self.expire_us is None or held is None or waiting:
            return [], held, None
        ends = (held[0] + self.expire_us) // 1000 + 1
        return ([], None, None) if now > ends else ([], held, ends)


def _ordered(df: DataFrame, key: str, job: OrderedRows | DealtFold, outputs: StructType, timeout: str = GroupStateTimeout.EventTimeTimeout) -> DataFrame:
    return df.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(PARTS))).groupBy("_part").applyInPandasWithState(job, outputs, "packed BINARY", "append", timeout)


def ordered_fold(df: DataFrame, key: str, order: Sequence[str], inputs: Sequence[str], outputs: str, step_factory: Callable[[], Step], delay: str = "10 minutes",
                 bucket_s: float = 60.0, ts: str = "ts", expire_s: float | None = None) -> DataFrame:
    """Streaming form of ``fold_sorted`` that keeps order however rows arrive.

    Rows at most ``delay`` late are put in their place; later ones are dropped.  A
    row comes out once the watermark has passed the end of its time bucket, so
    the latency is the delay and a bucket.
    """
    out, at = _parse_datatype_string(outputs), f"{ts}_us"
    given = StructType([StructField(at, LongType(), True) if f.name == ts else f for f in df.schema.fields if f.name != key])
    schema = StructType([df.schema[key], *given.fields, *[StructField(f.name, f.dataType, True) for f in out.fields]])
    of = lambda names: [at if c == ts else c for c in names]
    fold = OrderedFold(key, given.names, of(order), of(inputs), schema.names, at, step_factory, int(bucket_s * 1000), None if expire_s is None else int(expire_s * 1000))
    found = _ordered(df.withWatermark(ts, delay).withColumn(at, F.unix_micros(ts)), key, fold, schema)
    return found.select(*[F.timestamp_micros(at).alias(ts) if c == ts else c for c in [*df.columns, *out.names]])


class StaleReadings(OrderedRows):
    """A row for every reading that no other follows in time; rows are (micro-seconds,)."""

    def __init__(self, key: str, limit_ms: int, bucket_ms: int):
        super().__init__(key, ["at"], [key, "last_ms"], bucket_ms)
        self.limit_ms = limit_ms

    def at(self, row: tuple) -> int:
        return row[0]

    order = at

    def walk(self, key: Any, rows: list[tuple], held: Any) -> tuple[list[tuple], Any]:
        (last, told), outs = held or (None, True), []
        for (us,) in rows:
            if not told and us // 1000 - last > self.limit_ms:
                outs.append((key, last))
            last, told = us // 1000, False
        return outs, (last, told)

    def rest(self, key: Any, held: Any, waiting: list[tuple], now: int) -> tuple[list[tuple], Any, int | None]:
        last, told = held or (None, True)
        if told:
            return [], held, None
        # The newest reading is stale unless one that still waits came in time.
        if waiting and min(waiting)[0] // 1000 - last <= self.limit_ms:
            return [], held, None
        return ([(key, last)], (last, True), None) if now > last + self.limit_ms else ([], held, last + self.limit_ms + 1)


def stale_readings(readings: DataFrame, key: str = "device_id", ts: str = "ts", limit_s: float = 2.2, delay: str = "10 seconds", bucket_s: float = 10.0) -> DataFrame:
    """(key, last_at, stale_at): one row when a key's newest reading turns stale,
    set off by a timer, so it needs no further row of that key."""
    limit_ms = int(limit_s * 1000)
    rows = readings.select(key, ts).withWatermark(ts, delay).withColumn("at", F.unix_micros(ts))
    found = _ordered(rows, key, StaleReadings(key, limit_ms, int(bucket_s * 1000)), StructType([readings.schema[key], StructField("last_ms", LongType(), True)]))
    return found.select(key, F.timestamp_millis("last_ms").alias("last_at"), F.timestamp_millis(F.col("last_ms") + limit_ms).alias("stale_at"))


# --- history -----------------------------------------------------------------

HISTORY_PARTS = 64


def merge_history(batch: DataFrame, batch_id: int, target: str, limit: int, parts: int = HISTORY_PARTS) -> None:
    """Add a micro-batch of raw events to the history table.

    The table is laid out by a hash of the user and only the parts with a user of
    this batch are read and written again.  Every row carries the batch that
    wrote its part, so a batch that is run again leaves finished parts alone.
    """
    from ..operators.places import place_history, retain_newest
    spark = batch.sparkSession
    part = F.pmod(F.xxhash64("user_id"), F.lit(parts)).cast("int")
    new = stage(place_history(batch).withColumn("part", part), "history")
    changed = [r.part for r in new.select("part").distinct().collect()]      # at most ``parts``
    if not changed:
        return
    old = read_history(spark, target, new)
    if old is not None:
        old = stage(old.where(F.col("part").isin(changed)), "history")
        done = [r.part for r in old.where(F.col("batch") >= batch_id).select("part").distinct().collect()]
        new, old = new.where(~F.col("part").isin(done)), old.where(~F.col("part").isin(done)).drop("batch")
        new = new.unionByName(old, allowMissingColumns=True)
    merged = combine_history(new)
    kept = stage(retain_newest(merged, limit).withColumns({"batch": F.lit(batch_id).cast("long"), "part": part}), "history")
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(target)


def combine_history(entries: DataFrame) -> DataFrame:
    """Entries of one (user, place) added up."""
    keep = {"open_count": F.sum("open_count"), "route_count": F.sum("route_count"), "first_seen_at": F.min("first_seen_at"), "last_opened_at": F.max("last_opened_at"), "last_route_at": F.max("last_route_at")}
    rest = [c for c in entries.columns if c not in (*keep, "user_id", "place_id", "part")]
    newest = [F.max_by(c, "last_opened_at").alias(c) for c in rest]
    return entries.groupBy("user_id", "place_id").agg(*[c.alias(name) for name, c in keep.items()], *newest)


def read_history(spark, target: str, like: DataFrame) -> DataFrame | None:
    """The history table, or nothing before its first batch."""
    try:
        return spark.read.schema(StructType([*like.drop("part").schema.fields, *_parse_datatype_string("batch LONG, part INT").fields])).parquet(target)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def write_history_stream(events: DataFrame, target: str, checkpoint: str, limit: int = 240, available_now: bool = True) -> StreamingQuery:
    """Keep the newest entries per user in a table; the stream itself holds no state."""
    w = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, batch_id: merge_history(batch, batch_id, target, limit))
    return (w.trigger(availableNow=True) if available_now else w).start()
