"""Removal of byte strings of ``WINDOW`` bytes that start anywhere else too.

Texts are cut at content-defined anchors: every window of ``WINDOW`` bytes
selects one anchor gram, and equal windows select equal grams at the same
offset.  Anchors are counted by gram and by segment (all bytes of the windows
that select the anchor):

* a gram met once cannot lie in a repeated window;
* a segment met twice or more is repeated as a whole, and its rows are only
  counted, map-side first;
* different segments with one gram meet in units of bounded size.  There every
  row is cut into stretches over which its set of like rows stays the same, the
  stretches become symbols ordered by their bytes, and a suffix array of the
  rows, built by linear grouping, shows by its common prefixes which stretches
  another row holds too.  Symbols are equal only if their bytes are.

The covered ranges of a text are merged and removed.  Texts travel twice (for
the bytes of the third kind, and for the removal), anchors as short rows.
Window hashes only propose; a text is removed where bytes are equal, except
that whole segments are held equal by two independent 64-bit hashes.

Defined results: null and empty texts have 0 bytes and nothing to remove;
equal texts are equal strings "elsewhere" for each other, rows that repeat an
id included.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..checkpoints import stage
from .anchors import Prefix, anchors
from .common import U64, Batches, block_pairs, mix64, pick, runs, small_batches
from .suffix_array import common_prefixes, suffix_array

WINDOW, GRAM = 400, 160
UNIT_ROWS = 512


def _anchored(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, place, first, last, gram, segment) of every anchor of every text."""
    def cut(batches: Batches) -> Batches:
        for batch in small_batches(batches):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [anchors(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8), window, gram) for t in texts]
            sizes = [f["place"].size for f in found]
            columns = {k: np.concatenate([f[k] for f in found]) for k in ("place", "first", "last", "gram", "segment")}
            key = pa.array(keys, pa.binary()).take(pa.array(np.repeat(np.arange(len(keys)), sizes)))
            yield pa.RecordBatch.from_arrays([key, *[pa.array(columns[k].astype(np.int32)) for k in ("place", "first", "last")],
                                              *[pa.array(columns[k].view(np.int64)) for k in ("gram", "segment")]],
                                             names=["key", "place", "first", "last", "gram", "segment"])
    return texts.mapInArrow(cut, "key binary, place int, first int, last int, gram bigint, segment bigint")


def _segments(wanted: DataFrame, window: int) -> DataFrame:
    """(gram, segment, first, bytes) of the wanted anchors of each text; ``first`` counts from the gram."""
    def cut(batches: Batches) -> Batches:
        for batch in small_batches(batches):
            rows = []
            for text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(p["gram"], p["segment"], p["first"] - p["place"], raw[p["first"]:p["last"] + window]) for p in places]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                                             names=["gram", "segment", "first", "bytes"])
    return wanted.select("text", "places").mapInArrow(cut, "gram bigint, segment bigint, first int, bytes binary")


def stretches(rows: list[tuple[int, bytes]], window: int) -> list[list[tuple[int, int]]]:
    """For each row (first offset, bytes) the ranges over which its set of like rows stays the same.

    Two rows are alike at an offset if the windows that start there are equal.
    A range covers whole windows; windows that no other row has are left out.
    """
    prefix = Prefix(np.frombuffer(b"".join(b for _, b in rows), np.uint8))
    begin = np.cumsum([0, *[len(b) for _, b in rows]])[:-1]
    count = np.array([max(0, len(b) - window + 1) for _, b in rows])
    owner = np.repeat(np.arange(len(rows)), count)
    at = np.arange(owner.size) - np.repeat(np.cumsum(count) - count, count)
    start = begin[owner] + at
    offset = at + np.array([f for f, _ in rows], np.int64)[owner]
    _, kind, size = np.unique(prefix.of(start, start + window) ^ mix64(offset.astype(np.int64).view(U64)), return_inverse=True, return_counts=True)
    # A kind's set of rows as the sum of scrambled row numbers.
    order = np.argsort(kind, kind="stable")
    sums = np.add.reduceat(mix64(owner[order].astype(U64) + U64(1)), np.cumsum(size) - size) if owner.size else np.empty(0, U64)
    members = np.where(size > 1, sums, U64(0))[kind]
    out: list[list[tuple[int, int]]] = [[] for _ in rows]
    change = np.flatnonzero((np.diff(members) != 0) | (np.diff(owner) != 0)) + 1
    for a, b in zip([0, *change.tolist()], [*change.tolist(), owner.size]):
        if a < b and members[a]:
            out[owner[a]].append((int(at[a]), int(at[b - 1]) + window))
    return out


def repeated_ranges(rows: list[tuple[int, bytes]], window: int) -> list[list[tuple[int, int]]]:
    """For each row the ranges whose bytes another row holds at the same offset from the gram."""
    parts = stretches(rows, window)
    cells = [(first + a, raw[a:b]) for (first, raw), own in zip(rows, parts) for a, b in own]
    number = {c: k for k, c in enumerate(sorted(set(cells)))}
    text, spot, gap = [], [], -1
    position = 0
    for r, own in enumerate(parts):
        for a, b in own:
            text.append(number[cells[position]])
            spot.append((r, a, b))
            position += 1
        text.append(gap)                   # a different end for every row
        spot.append(None)
        gap -= 1
    order = suffix_array(text)
    shared = common_prefixes(text, order) + [0]
    found: list[list[tuple[int, int]]] = [[] for _ in rows]
    for k, i in enumerate(order):
        if spot[i] is not None and (shared[k] or shared[k + 1]):
            r, a, b = spot[i]
            found[r].append((a, b))
    return found


def _compared(units: DataFrame, window: int) -> DataFrame:
    """(gram, segment, from, to): repeated ranges of segments, counted from the segment's first byte."""
    def compare(batches: Batches) -> Batches:
        for group in runs(batches):
            names = list(zip(group.column("gram").to_pylist(), group.column("segment").to_pylist()))
            once = list({n: i for i, n in enumerate(names)}.values())
            by_gram: dict[int, list[int]] = {}
            for i in once:
                by_gram.setdefault(names[i][0], []).append(i)
            firsts, raws = group.column("first").to_pylist(), group.column("bytes").to_pylist()
            rows = []
            for members in by_gram.values():
                if len(members) > 1:
                    for i, ranges in zip(members, repeated_ranges([(firsts[i], raws[i]) for i in members], window)):
                        rows += [(*names[i], a, b) for a, b in ranges]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                                                 names=["gram", "segment", "from", "to"])
    return units.mapInArrow(compare, "gram bigint, segment bigint, from int, to int")


def covered_ranges(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, ranges): repeated byte ranges of every text that has some; ``texts`` has key, id and text."""
    found = stage(_anchored(texts.select("key", "text").where("text is not null"), window, gram), "anchors")
    # Written tables, so that a join can split a gram that very many rows hold.
    again = stage(found.groupBy("gram").agg(F.count("*").alias("met")).where("met > 1").select("gram"), "grams")
    found = stage(found.join(again, "gram"), "repeated")
    kinds = stage(found.groupBy("gram", "segment").agg(F.count("*").alias("met"), F.min(F.struct("key", "place", "first", "last")).alias("one")), "kinds")
    mixed = stage(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1").select("gram"), "mixed")
    # One row of each different segment, with its bytes from one row of the text.
    ones = kinds.join(mixed, "gram").select(F.col("one.key").alias("key"), F.struct("gram", "segment", "one.place", "one.first", "one.last").alias("place"))
    ones = ones.groupBy("key").agg(F.collect_list("place").alias("places"))
    source = texts.groupBy("key").agg(F.min("id").alias("id"))
    wanted = texts.join(ones.join(source, "key").hint("shuffle_hash"), ["key", "id"])
    segments = stage(_segments(wanted, window), "segments")
    compared = _compared(block_pairs(segments, ["gram"], "segment", UNIT_ROWS).select("unit", "gram", "segment", "first", "bytes"), window)
    whole = kinds.where("met > 1").select("gram", "segment", F.lit(None).cast("int").alias("from"), F.lit(None).cast("int").alias("to"))
    marks = stage(whole.unionByName(compared), "marks")
    ranges = found.join(marks, ["gram", "segment"]).select("key", F.struct((F.col("first") + F.coalesce("from", F.lit(0))).alias("a"),
                                                                          F.coalesce(F.col("first") + F.col("to"), F.col("last") + window).alias("b")).alias("range"))
    return ranges.groupBy("key").agg(F.collect_set("range").alias("ranges"))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every document; ``kept`` is the remaining bytes."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    texts = rows.select(F.unhex(F.md5("text")).alias("key"), F.xxhash64("doc_id").alias("id"), "doc_id", "text")
    ranges = covered_ranges(texts, window, gram)
    joined = texts.select("key", "doc_id", "text").join(ranges.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "ranges")

    def cut(batches: Batches) -> Batches:
        for batch in small_batches(batches):
            out: dict = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                spans = merged([(r["a"], r["b"]) for r in found or []])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                for column, value in zip(out.values(), (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept)):
                    column.append(value)
            arrays = [batch.column(0), *[pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")], pa.array(out["kept_sha256"], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_kept:
                arrays, names = [*arrays, pa.array(out["kept"], pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
    return joined.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_kept else ""))
