"""What the operators share: column choice, staging, seeded sampling, components."""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..checkpoints import stage

U64 = np.uint64
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; the rest cannot clash."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def crc_part(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def share_of(col: Column, rate: float) -> Column:
    """True for about ``rate`` of the distinct values of ``col``, the same ones every time."""
    return F.pmod(F.xxhash64(col), F.lit(1_000_000)) < int(round(rate * 1_000_000))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of uint64 values."""
    x = (x ^ (x >> U64(30))) * MIX_A
    x = (x ^ (x >> U64(27))) * MIX_B
    return x ^ (x >> U64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """One uint64 per white-space separated, lower-cased word of the whole text."""
    if not text:
        return np.empty(0, U64)
    raw = np.frombuffer(" ".join(text.lower().split()).encode("utf-8", "surrogatepass") + b" ", np.uint8)
    ends = np.flatnonzero(raw == 32)
    if ends.size == 1 and ends[0] == 0:
        return np.empty(0, U64)
    # A word's hash is the wrapped sum of mixed (position in word, byte) values.
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(raw.size) - np.repeat(starts, ends - starts + 1)
    values = _PLACE[np.minimum(place, _PLACE.shape[0] - 1), raw]
    if place.max(initial=0) >= _PLACE.shape[0]:
        far = place >= _PLACE.shape[0]
        values[far] = mix64(place[far].astype(U64) * U64(256) + raw[far].astype(U64) + U64(1) * MIX_B)
    return mix64(np.add.reduceat(values, starts))


_PLACE = mix64(np.arange(64 * 256, dtype=U64) + MIX_A).reshape(64, 256)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words; a shorter, non-empty text is one run."""
    if words.size == 0:
        return words
    if words.size < n:
        words = np.concatenate((words, np.zeros(n - words.size, U64)))
    out = np.zeros(words.size - n + 1, U64)
    for k in range(n):
        out = out * U64(0x9E3779B97F4A7C15) + words[k:words.size - n + 1 + k]
    return mix64(out)


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges (a, b).

    Alternating large-star and small-star rounds; every round is a grouped
    minimum and a join, so a hub with very many edges is combined before it is
    shuffled.  Rounds are written tables; the driver sees one count a round.
    """
    arcs = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "arcs")
    while True:
        both = arcs.unionByName(arcs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: every larger neighbour of a node points to the node's minimum.
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.where("a <> b").distinct(), "arcs")
        # Small star: a node and its smaller neighbours point to their minimum.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        nxt = stage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "arcs")
        # Done when every node has one arc and no target has an arc of its own.
        tails = nxt.groupBy("a").agg(F.count("*").alias("arcs"))
        heads = nxt.select(F.col("b").alias("a")).distinct().withColumn("head", F.lit(True))
        if not tails.join(heads, "a", "left").where("arcs > 1 or head").limit(1).count():
            return nxt.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
        arcs = nxt


def union_find(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest reachable index for each of ``n`` indexes, by repeated minimum and jumping."""
    root = np.arange(n)
    while left.size:
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        keep = root[left] != root[right]
        left, right = left[keep], right[keep]
    return root


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


Frames = Iterator[pd.DataFrame]
Batches = Iterator[pa.RecordBatch]


def small_batches(batches: Batches, rows: int = 256) -> Batches:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list], dict]], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, *schema): ``make()`` gives a worker's function from a list of texts to columns.

    Texts are whole and may be null; ids pass through unread, so any type,
    null and repeat is kept.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    fields = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)

    def run(batches: Batches) -> Batches:
        work = make()
        for batch in small_batches(batches):
            out = work(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[f.name], f.type) for f in arrow]], names=["doc_id", *arrow.names])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *fields]))


def keep_rows(docs: DataFrame, make: Callable[[], Callable[[list], list]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text ``make()``'s function answers with true; every column stays."""
    def run(batches: Batches) -> Batches:
        work = make()
        for batch in small_batches(batches):
            kept = batch.filter(pa.array(work(batch.column(batch.schema.get_field_index(text_col)).to_pylist()), pa.bool_()))
            if kept.num_rows:
                yield kept
    return docs.mapInArrow(run, docs.schema)


def map_text_column(docs: DataFrame, make: Callable[[], Callable[[list], list]], text_col: str = "text") -> DataFrame:
    """``docs`` with its text column replaced; every row and every other column stays."""
    def run(batches: Batches) -> Batches:
        work = make()
        for batch in small_batches(batches):
            k = batch.schema.get_field_index(text_col)
            yield batch.set_column(k, text_col, pa.array(work(batch.column(k).to_pylist()), pa.string()))
    return docs.mapInArrow(run, docs.schema)


def runs(batches: Batches) -> Iterator[pa.Table]:
    """Tables of rows with one value of the first column, from a stream sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def block_pairs(rows: DataFrame, keys: list[str], split_on: str, most: int) -> DataFrame:
    """Rows dealt to (key, block, block) units of at most about ``2 * most`` rows.

    Every two rows of a key meet in one unit: a key with more than ``most`` rows
    is split by a hash of ``split_on`` into blocks, and a row goes to each pair of
    blocks with its own.  Adds ``unit`` (the hash of key and blocks, sorted within
    partitions), ``own`` (the row's block), ``low`` and ``high`` (the unit's blocks).
    """
    hot = rows.groupBy(*keys).agg(F.count("*").alias("size")).where(F.col("size") > most)
    split = rows.join(hot, keys, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("size") / most), F.lit(1)).cast("int"))
    split = split.withColumn("own", F.pmod(F.xxhash64(split_on), F.col("blocks")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("size", "blocks", "other")
    split = split.withColumn("unit", F.xxhash64(*keys, "low", "high"))
    return split.repartition("unit").sortWithinPartitions("unit")
