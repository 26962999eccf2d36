"""Near-duplicate join on word n-grams: MinHash LSH forest and exact Jaccard.

Every document becomes a set of hashed word n-grams; documents with equal sets
are one row from then on.  A forest of sorted prefix tries holds the MinHash
signatures: a tree's label is ``DEPTH`` signature bytes, and rows that share the
shortest useful prefix meet in one unit, sorted by label.  A unit starts with
the rows that share whole labels and shortens the prefix step by step; rows
that deeper levels have joined are not compared again, and shortening ends at
the depth at which all trees together reach the target recall.  A sketch of one
bit a hash drops unlike pairs early.

The candidate components that result hold every pair found.  Each component's
documents then meet once more, in units of bounded size, with their full n-gram
sets, and all pairs of a unit are verified by exact set intersection (a product
of incidence matrices).  Pairs never become rows: units pass on link counts and
a spanning forest, from which classes follow as connected components.

Defined results: null, empty and blank texts and rows without an id link with
nothing; a text shorter than ``n`` words is one n-gram of all its words; rows
with one id are all returned, and the text of one of them is compared.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..checkpoints import stage
from .common import U64, Batches, block_pairs, components, mix64, pick, runs, shingles, small_batches, union_find, word_hashes

WORDS, SIMILARITY = 5, 0.8
TREES, DEPTH = 16, 8
RECALL = 0.9995
SKETCH_LEAST = 0.3       # gap below the similarity at which a sketch rejects; more than five deviations
UNIT_ROWS, SET_ROWS = 2048, 512
_COLUMNS = 4096          # columns of an incidence matrix worked on at a time
_SEED = np.random.default_rng(7)
_XOR = _SEED.integers(0, 1 << 32, TREES * DEPTH, np.uint32)
_MULTIPLY = _SEED.integers(0, 1 << 32, TREES * DEPTH, np.uint32) | np.uint32(1)


def shortest_prefix(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Longest prefix at which a pair at the threshold meets in some tree with the target recall."""
    return max([d for d in range(1, DEPTH + 1) if 1 - (1 - similarity ** d) ** TREES >= recall], default=1)


def gram_set(text: str | None, n: int = WORDS) -> np.ndarray:
    return np.unique(shingles(word_hashes(text), n))


def signature(grams: np.ndarray) -> np.ndarray:
    """One byte for each of ``TREES * DEPTH`` hash functions."""
    low = (grams >> U64(16)).astype(np.uint32)
    best = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for at in range(0, low.size, 1024):
        np.minimum(best, ((low[at:at + 1024, None] ^ _XOR) * _MULTIPLY).min(0), out=best)
    return ((best * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def _signed(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, text_key, grams, key, labels, sketch); key is null for a text without words."""
    def sign(batches: Batches) -> Batches:
        for batch in small_batches(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                grams = gram_set(text, n)
                if not grams.size:
                    rows.append((0, None, None, None))
                    continue
                key = np.array([grams.sum(), np.bitwise_xor.reduce(mix64(grams))], U64).tobytes()
                labels = signature(grams)
                rows.append((grams.size, key, labels.tobytes(), np.packbits(labels & 1).tobytes()))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
                                             names=["doc_id", "text_key", "grams", "key", "labels", "sketch"])
    keyed = docs.select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("text_key"))
    return keyed.mapInArrow(sign, "doc_id bigint, text_key string, grams int, key binary, labels binary, sketch binary")


def _candidates(units: DataFrame, shortest: int, least: float) -> DataFrame:
    """(a, b): a spanning forest of each unit's pairs that the sketches do not reject."""
    agree = TREES * DEPTH * (1 + least) / 2

    def climb(batches: Batches) -> Batches:
        for group in runs(batches):
            size = group.num_rows
            if size < 2:
                continue
            rep = group.column("rep").to_numpy()
            labels = np.frombuffer(b"".join(group.column("label").to_pylist()), np.uint8).reshape(size, DEPTH)
            sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint64).reshape(size, -1)
            order = np.lexsort(labels.T[::-1])
            rep, labels, sketch = rep[order], labels[order], sketch[order]
            # Longest common prefix of neighbours in the sorted trie.
            same = np.cumprod(labels[1:] == labels[:-1], axis=1).sum(1)
            root, left, right = np.arange(size), np.empty(0, int), np.empty(0, int)
            for depth in range(DEPTH, shortest - 1, -1):
                edges = np.concatenate(([0], np.flatnonzero(same < depth) + 1, [size]))
                new = []
                for a, b in zip(edges[:-1], edges[1:]):
                    if b - a > 1 and (root[a:b] != root[a]).any():
                        matched = TREES * DEPTH - np.bitwise_count(sketch[a:b, None] ^ sketch[None, a:b]).sum(2, dtype=np.int16)
                        new.append(np.argwhere(np.triu(matched >= agree, 1)) + a)
                if new:
                    pairs = np.concatenate(new)
                    left, right = np.concatenate((left, pairs[:, 0])), np.concatenate((right, pairs[:, 1]))
                    root = union_find(size, left, right)
                    left, right = np.arange(size), root
            tree = np.flatnonzero(root != np.arange(size))
            if tree.size:
                yield pa.RecordBatch.from_arrays([pa.array(rep[tree]), pa.array(rep[root[tree]])], names=["a", "b"])
    return units.mapInArrow(climb, "a bigint, b bigint")


def _grams_of(docs: DataFrame, n: int) -> DataFrame:
    """Replace the text by the packed n-gram set."""
    def pack(batches: Batches) -> Batches:
        for batch in small_batches(batches):
            sets = [gram_set(t, n).tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sets, pa.binary())], names=["component", "rep", "copies", "set"])
    return docs.select("component", "rep", "copies", "text").mapInArrow(pack, "component bigint, rep bigint, copies bigint, set binary")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    size = len(sets)
    owner = np.repeat(np.arange(size), [s.size for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((size, size), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = int(column[-1]) + 1 if column.size else 0
    for at in range(0, width, _COLUMNS):
        a, b = np.searchsorted(column, (at, at + _COLUMNS))
        block = np.zeros((size, min(_COLUMNS, width - at)), np.float32)
        block[owner[a:b], column[a:b] - at] = 1
        out += block @ block.T
    return out.astype(np.int64)


def _verified(units: DataFrame, similarity: float) -> DataFrame:
    """(a, b, n): link counts (b null) and spanning links (n null) of each unit, by exact Jaccard."""
    def verify(batches: Batches) -> Batches:
        for group in runs(batches):
            _, once = np.unique(group.column("rep").to_numpy(), return_index=True)
            group, size = group.take(once), once.size
            if size < 2:
                continue
            component, rep, copies = (group.column(c).to_numpy() for c in ("component", "rep", "copies"))
            own, low, high = (group.column(c).to_numpy() for c in ("own", "low", "high"))
            sets = [np.frombuffer(s, U64) for s in group.column("set").to_pylist()]
            shared = intersections(sets)
            length = np.array([s.size for s in sets])
            i, j = np.nonzero(np.triu(shared >= similarity * (length[:, None] + length[None] - shared) - 1e-9, 1))
            ok = (component[i] == component[j]) & (low[i] == low[j]) & (high[i] == high[j]) & ((low[i] == high[i]) | (own[i] != own[j]))
            i, j = i[ok], j[ok]
            if not i.size:
                continue
            count = np.bincount(i, copies[j], size) + np.bincount(j, copies[i], size)
            root = union_find(size, i, j)
            met, tree = np.flatnonzero(count), np.flatnonzero(root != np.arange(size))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((rep[met], rep[tree]))), pa.array([None] * met.size + rep[root[tree]].tolist(), pa.int64()),
                                              pa.array(count[met].astype(np.int64).tolist() + [None] * tree.size, pa.int64())], names=["a", "b", "n"])
    return units.mapInArrow(verify, "a bigint, b bigint, n bigint")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, n: int = WORDS, recall: float = RECALL, id_col: str = "doc_id",
                    text_col: str = "text", with_text_key: bool = False) -> DataFrame:
    """(doc_id, class_id, n_links, kept[, text_key]): the smallest id of the class, other documents linked directly, and whether
    the row is its class's one; ``text_key`` tells rows of one id apart by their text."""
    spark, rows = docs.sparkSession, pick(docs, doc_id=id_col, text=text_col)
    signed = stage(_signed(rows, n), "signed")
    usable = signed.where("key is not null and doc_id is not null")
    reps = stage(usable.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("labels").alias("labels"), F.first("sketch").alias("sketch")), "reps")
    shortest = shortest_prefix(similarity, recall)
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    forest = (reps.select("rep", "labels", "sketch", tree).withColumn("label", F.substring("labels", F.col("tree") * DEPTH + 1, F.lit(DEPTH)))
              .withColumn("prefix", F.xxhash64("tree", F.substring("label", 1, shortest))).select("prefix", "rep", "label", "sketch"))
    units = block_pairs(forest, ["prefix"], "rep", UNIT_ROWS).select("unit", "rep", "label", "sketch")
    groups = components(_candidates(units, shortest, similarity - SKETCH_LEAST), spark)
    groups = groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct())
    chosen = groups.withColumnRenamed("node", "rep").join(reps.select("rep", "copies"), "rep")
    # Rows that repeat a representative's id add nothing: a unit keeps one of them.
    texts = rows.where("text is not null").join(chosen.withColumnRenamed("rep", "doc_id").hint("shuffle_hash"), "doc_id").withColumnRenamed("doc_id", "rep")
    sets = stage(_grams_of(texts, n), "sets")
    units = block_pairs(sets, ["component"], "rep", SET_ROWS).select("unit", "component", "own", "low", "high", "rep", "copies", "set")
    links = stage(_verified(units, similarity), "links")
    counts = links.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked"))
    classes = components(links.where("b is not null").select("a", "b"), spark).withColumnRenamed("node", "rep")
    known = reps.select("key", "rep", "copies").join(counts, "rep", "left").join(classes, "rep", "left")
    named = ["text_key"] if with_text_key else []
    found = usable.select("doc_id", "key", *named).join(known, "key")
    found = found.select("doc_id", *named, F.coalesce("component", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    alone = signed.where("key is null or doc_id is null").select("doc_id", *named, F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    found = found.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
    return found.select("doc_id", "class_id", "n_links", "kept", *named)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class."""
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, with_text_key=True).where("not kept").select(F.col("doc_id").alias("gone_id"), "text_key").distinct()
    same = (F.col(id_col) == F.col("gone_id")) & (F.md5(F.col(text_col).cast("binary")) == gone["text_key"])
    return docs.join(gone.hint("shuffle_hash"), same, "left_anti").select(*docs.columns)
