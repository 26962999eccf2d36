"""Byte-level BPE with a minimal acyclic transducer as lexicon.

The frequent space-delimited units of all documents are counted by Spark,
encoded once by exact merging and compiled into a minimal acyclic automaton:
equal suffixes share states, and the number of words passed on the way to a
final state is the word's index into the id outputs.  The arrays form one file
that every executor maps into memory.  Units outside it are merged exactly, so
results never depend on what the lexicon holds.

Defined results: a null or empty text has no ids and decodes to an empty text;
a text longer than a batch is one row like any other; rows with equal ids are
all kept; decoding replaces bytes that are not UTF-8 as the library does.
"""
from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from ..checkpoints import stage
from .common import map_texts, pick

LEXICON_UNITS = 60_000      # most frequent units compiled into the automaton
CACHE_UNITS = 450_000       # remembered units of a worker; a full memory starts anew
_NO_MERGE = 1 << 30
LONGEST_GRID = 200          # bytes of a pre-token merged in a grid
LONGEST_UNIT = 64           # bytes of a lexicon unit

# Fixed pattern of the vocabulary's pre-tokeniser.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same over letters and digits up to U+024F, which one character class can list.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_BEYOND = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")
# White space as Unicode lists it, which is what the library's pattern means.
_ANY = regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s+", r"\p{White_Space}+").replace(r"(?!\S)", r"(?!\P{White_Space})"))


def byte_characters() -> dict[int, str]:
    """The vocabulary writes printable bytes as themselves and the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Vocabulary:
    """Ids, bytes and merge ranks of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_characters().items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = spec["model"]["vocab"]
        self.bytes_of = [b""] * (max(max(ids.values()), *self.special.values(), 0) + 1)
        for token, i in ids.items():
            if token not in self.special:
                self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.first = [ids[c] for _, c in sorted(byte_characters().items())]
        self.merges: dict[tuple[int, int], int] = {}      # pair of ids: rank
        self.merged: list[int] = []                       # by rank: the new id
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a], ids[b]] = rank
            self.merged.append(ids[a + b])
        self._arrays()
        self.text_of = [str(i) for i in range(len(self.bytes_of))]

    def _arrays(self) -> None:
        """Merge ranks by pair for numpy: of two bytes directly, of two ids by binary search."""
        pairs = np.array(list(self.merges), np.int64).reshape(-1, 2)
        keys, ranks = pairs[:, 0] << 32 | pairs[:, 1], np.array(list(self.merges.values()), np.int32)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], ranks[order]
        self.first_ids, self.merged_ids = np.array(self.first, np.int32), np.array(self.merged, np.int32)
        both = np.array(self.first, np.int64)
        self.byte_ranks = self.ranks(np.repeat(both, 256), np.tile(both, 256)).reshape(256, 256)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pair_keys, key), max(0, self.pair_keys.size - 1))
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NO_MERGE).astype(np.int32) if self.pair_keys.size else np.full(key.size, _NO_MERGE, np.int32)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Exact BPE of many pre-tokens together: ids of each as packed 32-bit integers.

        In every round each word merges its lowest-ranked, leftmost pair; words
        of like length share a grid.  Very long ones are merged one by one.
        """
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for at in range(0, len(order), 2048):
            part = order[at:at + 2048]
            while part and len(words[part[-1]]) > LONGEST_GRID:
                i = part.pop()
                out[i] = np.array(self._merge_long([self.first[b] for b in words[i]]), np.int32).tobytes()
            if part:
                for i, raw in zip(part, self._merge_grid([words[i] for i in part])):
                    out[i] = raw
        return out

    def _merge_grid(self, words: list[bytes]) -> list[bytes]:
        n, width = len(words), max(1, len(words[-1]))
        size = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        inside = np.arange(width) < size[:, None]
        ids = np.where(inside, self.first_ids[raw], -1)
        # One more column, so that a shift always has something to read.
        ids = np.concatenate((ids, np.full((n, 1), -1, ids.dtype)), 1)
        rank = np.full((n, width + 1), _NO_MERGE, np.int32)
        if width > 1:
            rank[:, :width - 1] = np.where(inside[:, 1:], self.byte_ranks[raw[:, :-1], raw[:, 1:]], _NO_MERGE)
        live, columns, done = np.arange(n), np.arange(width + 1), [b""] * n
        while live.size:
            at = rank.argmin(1)
            row = np.arange(live.size)
            low = rank[row, at]
            ready = low == _NO_MERGE
            if ready.any():
                for i, r, k in zip(live[ready].tolist(), ids[ready].astype(np.int32), size[live[ready]].tolist()):
                    done[i] = r[:k].tobytes()
                keep = ~ready
                live, ids, rank, at, low = live[keep], ids[keep], rank[keep], at[keep], low[keep]
                row = np.arange(live.size)
                if not live.size:
                    break
            # The merged pair becomes its first place; what follows moves up by one.
            place = np.minimum(columns + (columns > at[:, None]), width)
            ids = np.take_along_axis(ids, place, 1)
            ids[row, at] = self.merged_ids[low]
            rank = np.take_along_axis(rank, np.minimum(columns + (columns >= at[:, None]), width), 1)
            size[live] -= 1
            for left in (at - 1, at):
                ok = (left >= 0) & (left + 1 < size[live])
                rank[row[ok], left[ok]] = self.ranks(ids[row[ok], left[ok]], ids[row[ok], left[ok] + 1])
                end = (left >= 0) & ~ok
                rank[row[end], left[end]] = _NO_MERGE
        return done

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same over a linked list and a heap, for runs of any length."""
        import heapq
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(f, i, ids[i], ids[i + 1]) for i in range(n - 1) if (f := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            new = self.merged[rank]
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (f := get((new, ids[after[i]]))) is not None:
                    heapq.heappush(heap, (f, i, new, ids[after[i]]))
            if before[i] >= 0 and (f := get((ids[before[i]], new))) is not None:
                heapq.heappush(heap, (f, before[i], ids[before[i]], new))
        return [x for x in ids if x >= 0]



def words_of(unit: str) -> list[str]:
    """The pre-tokens of a unit."""
    return _LATIN.findall(unit) if not _BEYOND.search(unit) else _ANY.findall(unit)


def units(text: str) -> list[str]:
    """Cut a text where a single space is followed by something that is not white space.

    A pre-token takes such a space as its first character, and the white space
    before it ends there, so units are encoded independently.
    """
    pieces = text.split(" ")
    out = [pieces[0]]
    for p in pieces[1:]:
        if p and not p[0].isspace():
            out.append(" " + p)
        else:
            out[-1] += " " + p
    return out


# --- the automaton ---------------------------------------------------------------------

def compile_lexicon(words: list[bytes], outputs: list[list[int]]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of ``words`` with an id list for each."""
    order = sorted(range(len(words)), key=words.__getitem__)
    register: dict = {}
    path: list[list] = [[False, {}]]           # states of the last word: [final, {byte: state}]
    states: list[tuple[bool, tuple]] = []      # frozen states

    def freeze(node) -> int:
        key = (node[0], tuple(node[1].items()))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    def close(depth: int, word: bytes) -> None:
        while len(path) > depth + 1:
            node = path.pop()
            path[-1][1][word[len(path) - 1]] = freeze(node)

    last = b""
    for k in order:
        word = words[k]
        common = len(os.path.commonprefix([word, last]))
        close(common, last)
        for b in word[common:]:
            path[-1][1][b] = -1
            path.append([False, {}])
        path[-1][0] = True
        last = word
    close(0, last)
    root = freeze(path[0])
    # A state is frozen after the states it leads to, so counts come in one pass.
    count = [0] * len(states)
    keys, targets, before = [], [], []
    for s, (final, edges) in enumerate(states):
        passed = int(final)
        for b, t in edges:                      # bytes come in sorted order
            keys.append(s << 8 | b)
            targets.append(t)
            before.append(passed)
            passed += count[t]
        count[s] = passed
    ids = [outputs[k] for k in order]
    return {"root": np.array([root], np.int32), "final": np.array([f for f, _ in states], np.uint8), "keys": np.array(keys, np.int32),
            "targets": np.array(targets, np.int32), "before": np.array(before, np.int32),
            "offsets": np.cumsum([0, *map(len, ids)]).astype(np.int32), "ids": np.array([i for x in ids for i in x], np.int32)}


def save_lexicon(arrays: dict[str, np.ndarray], path: str) -> None:
    """One file: a line with names, types, sizes and places, then the arrays."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = [a.dtype.str, int(a.size), at]
        at += -(-a.nbytes // 8) * 8
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 8) + b"\n"
    with open(path, "wb") as f:
        f.write(line)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))


class Lexicon:
    """The automaton over a memory-mapped file."""

    def __init__(self, path: str):
        mapped = np.memmap(path, np.uint8, "r")
        start = int(np.flatnonzero(mapped[:4096] == 10)[0]) + 1
        for name, (kind, size, at) in json.loads(mapped[:start].tobytes()).items():
            setattr(self, name, np.frombuffer(mapped, kind, size, start + at))

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """Index of each word, -1 where the automaton does not accept it; all words walk together."""
        out = np.full(len(words), -1, np.int64)
        live = np.array([i for i, w in enumerate(words) if 0 < len(w) <= LONGEST_UNIT], np.int64)
        if not live.size or not self.keys.size:
            return out
        grid = np.array([words[i] for i in live], f"S{LONGEST_UNIT}").view(np.uint8).reshape(live.size, LONGEST_UNIT)
        lengths = np.array([len(words[i]) for i in live])
        state, index = np.full(live.size, self.root[0], np.int64), np.zeros(live.size, np.int64)
        row = np.arange(live.size)
        for k in range(LONGEST_UNIT):
            done = lengths[row] == k
            accepted = row[done & (self.final[state[row]] == 1)]
            out[live[accepted]] = index[accepted]
            row = row[~done]
            if not row.size:
                break
            key = state[row] << 8 | grid[row, k]
            at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
            hit = self.keys[at] == key
            row, at = row[hit], at[hit]
            index[row] += self.before[at]
            state[row] = self.targets[at]
        else:
            accepted = row[self.final[state[row]] == 1]
            out[live[accepted]] = index[accepted]
        return out


class Codec:
    """Texts to ids and back, for one worker.  Ids of a unit are kept as packed 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.known: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}
        marks = sorted(map(re.escape, vocabulary.special), key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(marks) + ")") if marks else None

    def merge_units(self, wanted: list[str]) -> list[bytes]:
        """Ids of units by exact merging."""
        cut = [words_of(u) for u in wanted]
        new = list({w for words in cut for w in words}.difference(self.words))
        if len(self.words) + len(new) > CACHE_UNITS:
            self.words = {}
            new = list({w for words in cut for w in words})
        self.words.update(zip(new, self.vocabulary.merge_many([w.encode("utf-8", "replace") for w in new])))
        return [b"".join(map(self.words.__getitem__, words)) for words in cut]

    def _learn(self, new: list[str]) -> None:
        rest = new
        if self.lexicon:
            found = self.lexicon.look_up([u.encode("utf-8", "replace") for u in new]).tolist()
            ids, offsets = self.lexicon.ids, self.lexicon.offsets
            self.known.update((u, ids[offsets[at]:offsets[at + 1]].tobytes()) for u, at in zip(new, found) if at >= 0)
            rest = [u for u, at in zip(new, found) if at < 0]
        self.known.update(zip(rest, self.merge_units(rest)))

    def encode_packed(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as packed 32-bit integers."""
        rows, out = [], []
        for text in texts:
            special = self.marks and text and any(m in text for m in self.vocabulary.special)
            rows.append([units(s) if i % 2 == 0 else np.array([self.vocabulary.special[s]], np.int32).tobytes() for i, s in enumerate(self.marks.split(text))]
                        if special else [units(text or "")])
        wanted: set[str] = set()
        for row in rows:
            for part in row:
                if not isinstance(part, bytes):
                    wanted.update(part)
        new = list(wanted.difference(self.known))
        if len(self.known) + len(new) > CACHE_UNITS:
            self.known, new = {"": b""}, list(wanted)
        if new:
            self._learn(new)
        get = self.known.__getitem__
        for row in rows:
            out.append(b"".join(part if isinstance(part, bytes) else b"".join(map(get, part)) for part in row))
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [np.frombuffer(raw, np.int32).tolist() for raw in self.encode_packed(texts)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def _codec(vocabulary: str, lexicon_file: str | None) -> Codec:
    return Codec(_vocabulary(vocabulary), Lexicon(SparkFiles.get(lexicon_file)) if lexicon_file else None)


# --- Spark -----------------------------------------------------------------------------

def frequent_units(docs: DataFrame, most: int = LEXICON_UNITS, text_col: str = "text") -> DataFrame:
    """(unit, n): at most ``most`` of the most frequent space-delimited units of all texts.

    Counts fall into fine logarithmic classes; the highest classes that fit are
    taken whole, so the driver and no task ever sees more than that.
    """
    unit = F.explode(F.split(F.concat(F.lit(" "), F.col("text")), " ", -1)).alias("unit")
    counts = pick(docs, text=text_col).where("text is not null").select(unit).where("unit <> ''").groupBy("unit").agg(F.count("*").alias("n"))
    counts = stage(counts.where("n > 1").withColumn("class", F.floor(F.log2("n") * 64).cast("int")), "units")
    left, least = most, 1 << 30
    for r in counts.groupBy("class").count().orderBy(F.desc("class")).collect():
        if r["count"] > left:
            break
        left, least = left - r["count"], r["class"]
    return counts.where(F.col("class") >= least).select("unit", "n")


def build_lexicon(docs: DataFrame, vocabulary: str, most: int = LEXICON_UNITS, text_col: str = "text") -> str:
    """Compile the lexicon and hand its file to every executor; returns the file's name."""
    spark = docs.sparkSession
    words = sorted(" " + r.unit for r in frequent_units(docs, most, text_col).collect())
    vocab = _vocabulary(vocabulary)
    kept = [w for w in words if len(w.encode("utf-8", "replace")) <= LONGEST_UNIT and not w[1].isspace()]
    arrays = compile_lexicon([w.encode("utf-8", "replace") for w in kept], [np.frombuffer(raw, np.int32).tolist() for raw in Codec(vocab).merge_units(kept)])
    # The driver's own file; Spark's file server brings it to every executor's working folder.
    path = os.path.join(tempfile.mkdtemp(), f"lexicon-{uuid.uuid4().hex}.bin")
    save_lexicon(arrays, path)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def encode(docs: DataFrame, vocabulary: str, lexicon_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids of every whole text."""
    return map_texts(docs, lambda: lambda texts: {"ids": _codec(vocabulary, lexicon_file).encode(texts)}, "ids array<int>", id_col, text_col)


def encode_checked(docs: DataFrame, vocabulary: str, lexicon_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids of every whole text, and whether decoding them gives the text (null: empty) again."""
    def work(texts: list) -> dict:
        codec = _codec(vocabulary, lexicon_file)
        ids = codec.encode(texts)
        return {"n_tokens": [len(x) for x in ids], "ids": ids, "decoded": [codec.decode(x) == (t or "") for x, t in zip(ids, texts)]}
    return map_texts(docs, lambda: work, "n_tokens bigint, ids array<int>, decoded boolean", id_col, text_col)


def decode(ids: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): texts of id lists; null for a null list."""
    def work(rows: list) -> dict:
        codec = _codec(vocabulary, None)
        return {"text": [None if x is None else codec.decode(x) for x in rows]}
    return map_texts(ids, lambda: work, "text string", id_col, ids_col)


def digests(docs: DataFrame, vocabulary: str, lexicon_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text in one pass and keep the digests of both."""
    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()

    def work(texts: list) -> dict:
        codec = _codec(vocabulary, lexicon_file)
        ids, name = codec.encode(texts), codec.vocabulary.text_of.__getitem__
        return {"n_tokens": [len(x) for x in ids], "ids_sha256": [sha(",".join(map(name, x))) for x in ids], "decoded_sha256": [sha(codec.decode(x)) for x in ids]}
    return map_texts(docs, lambda: work, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", id_col, text_col)
