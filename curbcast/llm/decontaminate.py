"""Benchmark decontamination: n-gram seeds without loss, then Smith-Waterman alignment.

Seeds are word pairs of the test items, next to each other or with one word
between.  In an alignment of score 2 * least * n or more (n words in the item),
least * n - 1 or more of the steps from one matched word to the next hold at most
one edit: each other step holds two or more, and the edits cost less than the
matches bring.  Such a step is a seed in both texts, and all of them lie within
(3 - 2 * least) * n words of the text.  So a stretch of a text is aligned with
an item exactly if it holds that many places of the item's seeds (``need``), and
no copy that reaches ``least`` is passed over, however common its words are.
Rarity only saves work: seeds of an item that most items hold are common as long
as they stand at fewer than ``need`` of its places in all, so that a copy always
holds one of the others.

The local alignment of words scores matches 2, mismatches and gaps -1; divided
by twice the item's length it is 1 for a whole copy and falls with every edit.

The items are read in blocks of at most about ``BLOCK_WORDS`` words, and every
block is held against all documents, so what is broadcast never grows with the
data.  Defined results: null and empty texts hold nothing; an item of one or two
words is found where all its words stand; in scripts without spaces every letter
is a word; equal items are all reported; rows that repeat an id and text are one
result; cleaning goes by the text, so a null or repeated id changes nothing.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import U64, Batches, mix64, pick, small_batches, word_hashes

FILTER_BITS = 20
LEAST_SCORE = 0.4
BLOCK_WORDS = 200_000
MATCH, MISS, GAP = 2, 1, 1
_NOT_WORD = re.compile(r"[\W_]+")
# Scripts written without spaces: Thai, Lao, Tibetan, Burmese, Khmer, kana and Han; a letter is a word there.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def words_of(text: str | None) -> np.ndarray:
    if text and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \g<0> ", text)
    return word_hashes(_NOT_WORD.sub(" ", text.lower()) if text else None)


def pairs(words: np.ndarray, alone: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the word pairs at distances one and two, and of every word ``alone``."""
    found = [mix64(words[:-d] * U64(0x9E3779B97F4A7C15) + words[d:]) for d in (1, 2)]
    if alone:
        found.append(mix64(words + U64(1)))
    return np.concatenate([np.arange(g.size) for g in found]), np.concatenate(found)


class Seeds:
    """Sorted seed hashes with the items that hold them, and the items' words."""

    def __init__(self, items: list[tuple], least: float = LEAST_SCORE):
        self.ids, self.words = [i for i, _ in items], [words_of(t) for _, t in items]
        self.length = np.array([w.size for w in self.words], int)
        self.need = np.maximum(1, np.ceil(least * self.length - 1e-9).astype(int) - 1)
        self.reach = np.ceil((3 - 2 * least) * self.length).astype(int) + 2
        # The seed of an item of one word is that word.
        self.alone = bool((self.length == 1).any())
        grams = [np.unique(pairs(w, w.size == 1)[1], return_counts=True) for w in self.words]
        owner = np.repeat(np.arange(len(grams)), [g.size for g, _ in grams])
        flat = np.concatenate([g for g, _ in grams]) if grams else np.empty(0, U64)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        times = np.concatenate([t for _, t in grams])[order] if grams else np.empty(0, int)
        self.keys, self.begin = np.unique(flat[order], return_index=True)
        self.size = np.diff(np.append(self.begin, flat.size))
        # From the seed that most items hold downwards, seeds are common while their places stay below `need`.
        down = np.lexsort((-np.repeat(self.size, self.size), self.owner))
        places = np.cumsum(times[down])
        before = np.append(0, places)[np.searchsorted(self.owner[down], self.owner[down])]
        self.rare = np.zeros(flat.size, bool)
        self.rare[down] = places - before >= self.need[self.owner[down]]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.keys >> U64(64 - FILTER_BITS)).astype(np.int64)] = True

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, seed numbers) of the seeds in a text."""
        if not words.size or not self.keys.size:
            return np.empty(0, int), np.empty(0, int)
        places, grams = pairs(words, self.alone)
        some = np.flatnonzero(self.filter[(grams >> U64(64 - FILTER_BITS)).astype(np.int64)])
        places, grams = places[some], grams[some]
        at = np.minimum(np.searchsorted(self.keys, grams), self.keys.size - 1)
        met = self.keys[at] == grams
        return places[met], at[met]

    def stretches(self, words: np.ndarray, places: np.ndarray, seeds: np.ndarray) -> list[tuple]:
        """(item, start, end, seeds) where enough seeds of one item lie together."""
        times = self.size[seeds]
        posting = np.repeat(self.begin[seeds] - np.cumsum(times) + times, times) + np.arange(times.sum())
        item, which = self.owner[posting], np.repeat(np.arange(places.size), times)
        count = np.bincount(item, minlength=len(self.ids))
        able = (count >= self.need) & (np.bincount(item[self.rare[posting]], minlength=len(self.ids)) > 0)
        some = able[item]
        item, which = item[some], which[some]
        if not item.size:
            return []
        place, seed = places[which], seeds[which]
        order = np.lexsort((place, item))
        item, place, seed = item[order], place[order], seed[order]
        new = np.append(True, (np.diff(item) != 0) | (np.diff(place) != 0))
        at = np.flatnonzero(new)                            # the first of every item and place
        last = np.arange(at.size) + self.need[item[at]] - 1
        full = np.flatnonzero(last < at.size)
        end = at[last[full]]
        full_at, reach = at[full], self.reach[item[at[full]]]
        good = (item[end] == item[full_at]) & (place[end] - place[full_at] <= reach)
        full_at, end, reach = full_at[good], end[good], reach[good]
        if not full_at.size:
            return []
        cuts = np.flatnonzero((np.diff(item[full_at]) != 0) | (place[full_at[1:]] - place[end[:-1]] > 2 * reach[1:])) + 1
        out = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), full_at.size]):
            far = int(reach[a])
            first, final = int(full_at[a]), int(end[b - 1])
            out.append((int(item[first]), max(0, int(place[first]) - far), min(words.size, int(place[final]) + far + 1), int(np.unique(seed[first:final + 1]).size)))
        return out


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(score, item end, text end) of the best local alignment; ends exclusive, the first of equals."""
    ramp = np.arange(text.size + 1) * GAP
    row, best = np.zeros(text.size + 1, np.int64), (0, 0, 0)
    for i, word in enumerate(item.tolist()):
        step = np.zeros_like(row)
        step[1:] = np.maximum(row[:-1] + np.where(text == U64(word), MATCH, -MISS), row[1:] - GAP)
        np.maximum(step, 0, out=step)
        row = np.maximum.accumulate(step + ramp) - ramp
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j)
    return best


def aligned(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """(score from 0 to 1, start, end) in words of ``text``."""
    score, i, j = align(item, text)
    _, _, back = align(item[:i][::-1], text[:j][::-1])
    return score / (MATCH * max(1, item.size)), j - back, j


def _found(docs: DataFrame, shared) -> DataFrame:
    """Stretches (doc_id, item, start, words, seeds)."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("item int, start int, words binary, seeds int")])
    arrow = to_arrow_schema(schema)

    def find(batches: Batches) -> Batches:
        seeds = shared.value
        for batch in small_batches(batches):
            rows = []
            ids = batch.column(0)
            for k, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text)
                places, numbers = seeds.hits(words)
                if not places.size:
                    continue
                for item, start, end, own in seeds.stretches(words, places, numbers):
                    rows.append((k, item, start, words[start:end].tobytes(), own))
            if rows:
                at, *columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *[pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:])]], names=arrow.names)
    return docs.mapInArrow(find, schema)


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, score, start, end, seeds): the best alignment of every document and test item that reaches ``least``; word offsets."""
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_col, text=text_col)
    tests = pick(items, item_id=item_col, text=item_text_col).where("text is not null").withColumn("size", F.length("text") / 4 + 1)
    blocks = max(1, int((tests.agg(F.sum("size")).first()[0] or 0) // block_words) + 1)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("item_id", tests.schema["item_id"].dataType), *T.StructType.fromDDL("score double, start bigint, end bigint, seeds int")])
    arrow = to_arrow_schema(schema)
    out = spark.createDataFrame([], schema)
    for block in range(blocks):
        held = sorted(((r.item_id, r.text) for r in tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()), key=lambda r: (r[0] is None, r))
        seeds = Seeds([r for r in held if words_of(r[1]).size], least)
        shared = spark.sparkContext.broadcast(seeds)       # a block, of bounded size
        found = _found(rows, shared)

        def score(batches: Batches) -> Batches:
            seeds = shared.value
            for batch in small_batches(batches):
                rows = []
                for k, (item, start, words, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("item", "start", "words", "seeds")))):
                    value, a, b = aligned(seeds.words[item], np.frombuffer(words, U64))
                    if value >= least:
                        rows.append((k, seeds.ids[item], value, start + a, start + b, own))
                if rows:
                    at, *columns = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *[pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:])]], names=arrow.names)
        out = out.unionByName(found.repartition(F.xxhash64("doc_id", "item", "start")).mapInArrow(score, schema))
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("start")).alias("start"), "end", "seeds")).alias("best"))
    return best.select("doc_id", "item_id", "best.score", (-F.col("best.start")).alias("start"), "best.end", "best.seeds")


def clean(docs: DataFrame, items: DataFrame, least: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a test item."""
    keyed = docs.select(F.md5(F.col(text_col).cast("binary")).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    held = contaminated(keyed, items, least, "id", "text").select("doc_id").distinct().hint("shuffle_hash")
    return docs.join(held, F.md5(F.col(text_col).cast("binary")) == held["doc_id"], "left_anti").select(*docs.columns)
