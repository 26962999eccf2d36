"""Near duplicates among vectors: sign hashing, exact cosine, connected components.

Every distinct vector is hashed by the signs of random hyperplanes in several
tables.  The number of bits follows the number of vectors, and the number of
tables follows from the bits, so that a pair at the threshold is missed with
probability ``miss`` and closer pairs less.  Vectors of one label that share a
code meet in units of bounded size, where the cosine of every pair is computed
in double precision by matrix products.  A pair counts in the first table in
which its codes agree, so links are counted once and never become rows; a unit
passes on only counts and a spanning forest of its links.

Defined results: a vector that is null, zero or holds a null or non-finite
component, or whose label or id is null, links with nothing and is its own
component; equal vectors are linked and counted, but hashed once; vectors of
different length never link.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..checkpoints import stage
from .common import Batches, block_pairs, components, pick, runs, union_find

THRESHOLD = 0.98
MISS = 1e-4              # probability to miss a pair at the threshold
UNIT_ROWS = 2048
BUCKET_ROWS = 256        # aimed at when the number of bits is chosen
SEED = 20


def plan_tables(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for ``n`` vectors."""
    bits = min(28, max(6, math.ceil(math.log2(max(1, n) / BUCKET_ROWS))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def sign_codes(vectors: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """One code per vector and table; the hyperplanes depend on seed and dimension only."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((tables * bits, vectors.shape[1]))
    signs = (vectors @ planes.T >= 0).reshape(len(vectors), tables, bits)
    return (signs.astype(np.int64) << np.arange(bits)).sum(2).astype(np.int32)


def _coded(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """(label, rep, copies, unit vector, codes) of distinct vectors."""
    def code(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column(3)
            lengths = cells.value_lengths().to_numpy()
            offsets = np.concatenate(([0], np.cumsum(lengths)))
            flat = cells.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            units, codes = [None] * batch.num_rows, [None] * batch.num_rows
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                x = flat[offsets[at][:, None] + np.arange(d)]
                x = x / np.abs(x).max(1, keepdims=True)          # no overflow in the norm
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                for i, u, c in zip(at, x, sign_codes(x, bits, tables)):
                    units[i], codes[i] = u.tobytes(), c.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(lengths, pa.int32()), pa.array(units, pa.binary()),
                                              pa.array(codes, pa.binary())], names=["label", "rep", "copies", "dim", "vector", "codes"])
    return vectors.select("label", "rep", "copies", "vector").mapInArrow(code, "label string, rep bigint, copies bigint, dim int, vector binary, codes binary")


def _linked(units: DataFrame, tables: int, threshold: float) -> DataFrame:
    """(a, b, n): link counts (b null) and spanning links (n null) of every unit."""
    def link(batches: Batches) -> Batches:
        for group in runs(batches):
            size = group.num_rows
            label = group.column("label").to_numpy()
            dims, own = group.column("dim").to_numpy(), group.column("own").to_numpy()
            low, high, number = (group.column(c).to_numpy() for c in ("low", "high", "table"))
            rep, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
            # Hashes of keys may collide, so a unit is taken apart by what they stand for.
            codes = np.frombuffer(b"".join(group.column("codes").to_pylist()), np.int32).reshape(size, tables)
            vectors = group.column("vector").to_pylist()
            for t, d in {(int(t), int(d)) for t, d in zip(number, dims)}:
                at = np.flatnonzero((number == t) & (dims == d))
                x = np.frombuffer(b"".join(vectors[i] for i in at), np.float64).reshape(at.size, d)
                cosine = x @ x.T
                i, j = np.nonzero(np.triu(cosine >= threshold, 1))
                i, j = at[i], at[j]
                same = codes[i] == codes[j]
                ok = same[:, t] & (same.argmax(1) == t) & (label[i] == label[j]) & ((low[i] == high[i]) | (own[i] != own[j])) & (low[i] == low[j]) & (high[i] == high[j])
                i, j = i[ok], j[ok]
                if not i.size:
                    continue
                count = np.bincount(i, copies[j], size) + np.bincount(j, copies[i], size)
                root = union_find(size, i, j)
                met = np.flatnonzero(count)
                tree = np.flatnonzero(root != np.arange(size))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((rep[met], rep[tree]))),
                                                  pa.array([None] * met.size + rep[root[tree]].tolist(), pa.int64()),
                                                  pa.array(count[met].astype(np.int64).tolist() + [None] * tree.size, pa.int64())], names=["a", "b", "n"])
    return units.mapInArrow(link, "a bigint, b bigint, n bigint")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    all_rows = pick(rows, vec_id=id_col, vector=vector_col, label=label_col)
    fit = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
           & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0))
    all_rows = all_rows.withColumn("fit", F.coalesce(fit, F.lit(False))).withColumn("label", F.col("label").cast("string"))
    valid = all_rows.where("fit").drop("fit")
    distinct = stage(valid.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    bits, tables = plan_tables(distinct.count(), threshold, miss)
    coded = stage(_coded(distinct, bits, tables), "codes")
    number = F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("table")
    coded = coded.select("*", number).withColumn("code", F.substring("codes", F.col("table") * 4 + 1, F.lit(4)))
    units = block_pairs(coded, ["label", "dim", "table", "code"], "rep", UNIT_ROWS).select("unit", "label", "dim", "table", "own", "low", "high", "rep", "copies", "codes", "vector")
    links = stage(_linked(units, tables, threshold), "links")
    counts = links.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked"))
    groups = components(links.where("b is not null").select("a", "b"), rows.sparkSession).withColumnRenamed("node", "rep")
    members = valid.join(distinct, ["label", "vector"]).join(counts, "rep", "left").join(groups, "rep", "left")
    found = members.select("vec_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = all_rows.where("not fit").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
