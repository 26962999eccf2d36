"""Token-id files: a concatenated id array with Elias-Fano document boundaries.

A file set is a Parquet table of blocks.  A block holds the ids of whole,
consecutive documents as one little-endian array (two bytes an id where the
vocabulary allows it), their ends and their document ids as Elias-Fano
sequences, and its start among the ids of its part.  Ends need about
``2 + log2(mean length)`` bits a document; sampled positions of the high bits
answer ``select`` without a table of 64-bit offsets.  The starts of parts are
running sums over one row a part.

Written by Spark, so a lost or repeated task leaves no half file.  Defined
results: a null or empty text is the end id alone; rows with one id are kept
all, ordered by text; null ids come first.
"""
from __future__ import annotations

import json
import os
import re
from bisect import bisect_left
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Batches, Frames, crc32, pick, small_batches

BLOCK_IDS = 1 << 20          # ids of a block, unless one document has more
CACHE_UNITS = 1_200_000       # remembered units of a worker; a full memory starts anew
SAMPLE = 64                  # documents between two sampled positions of the high bits


# --- Elias-Fano ------------------------------------------------------------------------

class EliasFano:
    """A non-decreasing sequence of integers from 0 in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.int64)
        n = values.size
        if n == 0:
            return cls(0, 0, b"", b"", b"")
        low_bits = max(0, int((int(values[-1]) + 1) // n).bit_length() - 1)
        low = values & ((1 << low_bits) - 1)
        bits = ((low[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8) if low_bits else np.empty((n, 0), np.uint8)
        ones = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(),
                   ones[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sampled position."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = at >> 3, at & 7
        word = int(self.high[byte]) >> skip << skip
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        low, start = 0, i * self.low_bits
        for k in range(self.low_bits):
            low |= (int(self.low[(start + k) >> 3]) >> ((start + k) & 7) & 1) << k
        return (place - i) << self.low_bits | low

    def to_array(self) -> np.ndarray:
        if self.n == 0:
            return np.empty(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        value = (ones - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[:self.n * self.low_bits].reshape(self.n, self.low_bits)
            value |= bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return value

    def cells(self, prefix: str) -> dict:
        return {f"{prefix}_n": self.n, f"{prefix}_bits": self.low_bits, f"{prefix}_low": self.low.tobytes(),
                f"{prefix}_high": self.high.tobytes(), f"{prefix}_samples": self.samples.tobytes()}

    @classmethod
    def from_cells(cls, row, prefix: str) -> "EliasFano":
        return cls(*(getattr(row, f"{prefix}_{k}") for k in ("n", "bits", "low", "high", "samples")))


_EF = "{0}_n bigint, {0}_bits int, {0}_low binary, {0}_high binary, {0}_samples binary"
BLOCKS = ("part int, block int, start_in_part bigint, n_ids bigint, width int, null_ids bigint, first_id bigint, ids binary, "
          + _EF.format("ends") + ", " + _EF.format("docs"))


# --- encoding --------------------------------------------------------------------------

@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


_BEYOND_LATIN = re.compile("[^\x00-ɏ]")
# Letters and then punctuation: always two pre-tokens, as long as no apostrophe is near
# and no letter ends in a mark when lower-cased, as only U+0130 does.
_WORD_THEN_MARKS = re.compile(r"([^\W\d_İ]+)([!-&(-/:-@\[-`{-~]+)\Z")


class UnitEncoder:
    """Whole texts to id bytes, through the library's encoding of space-separated units.

    This vocabulary's pre-tokens never hold white space and never look across
    it, so the ids of a text are those of its units in a row; a unit met before
    is not encoded again.  Latin texts without a special token's mark are
    lower-cased first, as the vocabulary's own normaliser does.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known = _tokenizer(path), {"": b""}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model.get("end_of_word_suffix")
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)       # ids that end a word
        self.ends[[i for token, i in model["vocab"].items() if suffix and token.endswith(suffix)]] = True

    def _encode_words(self, words: list[str]) -> None:
        """Words of letters alone, many in one text; their ids part where a word ends."""
        parts = [words[i:i + 200] for i in range(0, len(words), 200)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(self.ends[np.minimum(ids, self.ends.size - 1)]) + 1
            if cuts.size == len(part):
                raw, cuts = ids.tobytes(), (4 * cuts).tolist()
                self.known.update(zip(part, (raw[a:b] for a, b in zip([0, *cuts], cuts))))
            else:                      # lower-casing has put marks between letters
                self._encode_each(part)

    def _encode_each(self, units: list[str]) -> None:
        for unit, e in zip(units, self.tokenizer.encode_batch_fast(units, add_special_tokens=False)):
            self.known[unit] = array("I", e.ids).tobytes()

    def plain(self, text: str | None) -> str:
        """The text with single spaces for line ends, lower-cased where that is safe."""
        if not text:
            return ""
        if "<|" not in text and not _BEYOND_LATIN.search(text):
            text = text.lower()
        return text.replace("\n", " ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        # Arrow cuts and numbers the units; Python sees each different one once.
        rows = pc.split_pattern(pa.array([self.plain(t) for t in texts], pa.large_string()), " ")
        flat = rows.flatten().dictionary_encode()
        wanted = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = set(wanted).difference(self.known)
        if len(self.known) + len(new) > CACHE_UNITS:
            self.known, new = {"": b""}, set(wanted).difference([""])
        pairs, whole = [], set()
        for unit in new:
            if m := _WORD_THEN_MARKS.match(unit):
                pairs.append((unit, m[1], m[2]))
                whole.update(m.groups())
            else:
                whole.add(unit)
        whole.difference_update(self.known)
        words = [u for u in whole if u.isalpha()]
        self._encode_words(words)
        self._encode_each(list(whole.difference(words)))
        for unit, word, marks in pairs:
            self.known[unit] = self.known[word] + self.known[marks]
        raws = list(map(self.known.__getitem__, wanted))
        ids, size = np.frombuffer(b"".join(raws), "<u4"), np.fromiter(map(len, raws), np.int64, len(raws)) // 4
        number = flat.indices.to_numpy()
        times, first = size[number], (np.cumsum(size) - size)[number]
        ends = np.concatenate(([0], np.cumsum(times)))
        ids = ids[np.repeat(first - ends[:-1], times) + np.arange(ends[-1])]
        cuts = ends[rows.offsets.to_numpy() - rows.offsets[0].as_py()]
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


@lru_cache(maxsize=2)
def unit_encoder(path: str) -> UnitEncoder:
    return UnitEncoder(path)


def _block(part: int, block: int, start: int, ids: list, raws: list[bytes], width: int) -> dict:
    flat = np.frombuffer(b"".join(raws), "<u4")
    ends = np.cumsum([len(r) // 4 for r in raws])
    known = np.array([i for i in ids if i is not None], np.int64)
    first = int(known[0]) if known.size else 0
    return {"part": part, "block": block, "start_in_part": start, "n_ids": int(flat.size), "width": width, "null_ids": len(ids) - known.size,
            "first_id": first, "ids": flat.astype(f"<u{width}").tobytes(), **EliasFano.of(ends).cells("ends"), **EliasFano.of(known - first).cells("docs")}


def bytes_an_id(vocabulary: str, end_id: int) -> int:
    """The width that holds every id of the vocabulary and the end id."""
    return 2 if max([end_id, *_tokenizer(vocabulary).get_vocab().values()]) < 1 << 16 else 4


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, width: int | None = None, block_ids: int = BLOCK_IDS,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents and write them in ascending id order.

    One range shuffle of the texts; blocks are cut as a sorted partition
    streams by, so memory is a batch and a block.
    """
    width = width or bytes_an_id(vocabulary, end_id)

    def blocks(batches: Batches) -> Batches:
        from pyspark import TaskContext
        part, encoder, end = TaskContext.get().partitionId(), unit_encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        ids, raws, held, block, start = [], [], 0, 0, 0
        for batch in small_batches(batches, 1024):
            for key, raw in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                ids.append(key)
                raws.append(raw + end)
                held += len(raw) // 4 + 1
                if held >= block_ids:
                    yield pa.RecordBatch.from_pylist([_block(part, block, start, ids, raws, width)], schema)
                    ids, raws, held, block, start = [], [], 0, block + 1, start + held
        if ids:
            yield pa.RecordBatch.from_pylist([_block(part, block, start, ids, raws, width)], schema)

    schema = to_arrow_schema(T.StructType.fromDDL(BLOCKS))
    rows = pick(docs, id=id_col, text=text_col)
    (rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
         .mapInArrow(blocks, BLOCKS).write.parquet(path))


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document of a file set."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    # One row a part: a short running sum.
    bases = parts.select("part", (F.sum("part_ids").over(Window.orderBy("part")) - F.col("part_ids")).alias("base"))

    def documents(frames: Frames) -> Frames:
        for frame in frames:
            for row in frame.itertuples(index=False):
                ids = np.frombuffer(row.ids, f"<u{row.width}").astype("<u4")
                ends = EliasFano.from_cells(row, "ends").to_array()
                begins = np.concatenate(([0], ends[:-1]))
                keys = [None] * int(row.null_ids) + (EliasFano.from_cells(row, "docs").to_array() + row.first_id).tolist()
                raw = memoryview(ids.tobytes())
                out = {"doc_id": pd.array(keys, "Int64"), "start": begins + row.base + row.start_in_part, "n_tokens": ends - begins,
                       "ids_crc32": [crc32(raw[4 * b:4 * e]) for b, e in zip(begins.tolist(), ends.tolist())]}
                if with_ids:
                    out["ids"] = [ids[b:e].tolist() for b, e in zip(begins.tolist(), ends.tolist())]
                yield pd.DataFrame(out)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    # As many rows as the write had tasks, which the session's settings bound.
    return blocks.join(F.broadcast(bases), "part").mapInPandas(documents, schema)


def look_up(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    """(doc_id, ids) of the documents with the ids of a short list, without unpacking a block.

    A block's ids ascend, so ``select`` on its two sequences finds a document by
    bisection and then the two ends between which its ids lie.
    """
    wanted = sorted(set(wanted))

    def find(frames: Frames) -> Frames:
        for frame in frames:
            for row in frame.itertuples(index=False):
                docs, ends = EliasFano.from_cells(row, "docs"), EliasFano.from_cells(row, "ends")
                at = bisect_left(wanted, row.first_id)
                out: dict[str, list] = {"doc_id": [], "ids": []}
                while docs.n and at < len(wanted) and wanted[at] <= row.first_id + docs.select(docs.n - 1):
                    k = bisect_left(range(docs.n), wanted[at] - row.first_id, key=docs.select)
                    while k < docs.n and docs.select(k) == wanted[at] - row.first_id:
                        place = int(row.null_ids) + k
                        begin = ends.select(place - 1) if place else 0
                        out["doc_id"].append(wanted[at])
                        out["ids"].append(np.frombuffer(row.ids, f"<u{row.width}")[begin:ends.select(place)].astype(np.int64).tolist())
                        k += 1
                    at += 1
                if out["doc_id"]:
                    yield pd.DataFrame(out)

    return spark.read.schema(BLOCKS).parquet(path).mapInPandas(find, "doc_id bigint, ids array<bigint>")
