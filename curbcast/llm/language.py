"""Language ID by interpolated Kneser-Ney character models in sorted hash arrays.

Characters are lower-cased letters; everything between letters is one space.
For every language the counts of the highest order are raw and those of lower
orders count distinct left extensions.  All languages share one table an order:
sorted 64-bit hashes of the n-grams beside a row of log probabilities, already
interpolated, so a seen n-gram needs one binary search for all languages and an
unseen one goes on with its context's back-off row and the next lower order.

A text gets the language of lowest cross-entropy per symbol.  On a held part
of the training sample the confidence is fitted (softmax of the differences)
and the rejection bound is set: it lies ``SLACK`` of the way from the largest cross-entropy of any
calibration text of that language to that of evenly drawn symbols, and is wider
for short texts.

Fitting uses about ``SAMPLE_DOCS`` labelled texts a language, chosen by a hash
of the id; scoring reads every whole text.  Defined results: null texts and
texts without a letter are ``und`` with score 0 and rejected; without labelled
texts everything is ``und``; equal entropies go to the first name in order.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import MIX_A, U64, Batches, crc_part, keep_rows, map_texts, mix64, pick, share_of, small_batches

ORDER = 4
SAMPLE_DOCS = 1500
PIECE = 1 << 18             # symbols worked on at a time; long texts pass in pieces
SLACK, SHORT_SLACK = 0.75, 4.0
UNDEFINED = "und"
_PAD = 1
_LETTER = np.array([chr(c).isalpha() for c in range(65536)])


def symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased text, every run without letters as one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    low = points < 65536
    letter = np.zeros(points.size, bool)
    letter[low] = _LETTER[points[low]]
    if not low.all():
        letter[~low] = [chr(c).isalpha() for c in points[~low]]
    points = np.where(letter, points, 32)
    keep = letter.copy()
    if points.size:
        keep[1:] |= letter[:-1]
    return points[keep]


def gram_hashes(points: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` symbols that end at each place from ``order - 1`` on."""
    n = points.size - order + 1
    out = np.full(max(n, 0), U64(order), U64)
    for k in range(order if n > 0 else 0):
        out = out * MIX_A + points[k:k + n].astype(U64)
    return mix64(out)


def _rows_hash(grams: np.ndarray) -> np.ndarray:
    out = np.full(grams.shape[0], U64(grams.shape[1]), U64)
    for k in range(grams.shape[1]):
        out = out * MIX_A + grams[:, k].astype(U64)
    return mix64(out)


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): n-grams of the texts, counted in each batch and then summed."""
    def count(batches: Batches) -> Batches:
        for batch in small_batches(batches):
            held: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, []).append(np.concatenate((np.full(order - 1, _PAD), symbols(text))))
            for lang, parts in held.items():
                points = np.concatenate(parts)
                ends = np.cumsum([p.size for p in parts])[:-1]
                hashes = gram_hashes(points, order)
                inside = np.ones(hashes.size, bool)
                for k in range(1, order):      # n-grams that begin in one text and end in the next
                    cross = ends - k
                    inside[cross[(cross >= 0) & (cross < hashes.size)]] = False
                places = np.flatnonzero(inside)
                _, first, n = np.unique(hashes[places], return_index=True, return_counts=True)
                starts = places[first]
                grams = ["".join(map(chr, points[s:s + order])) for s in starts]
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(grams), "gram": grams, "n": pa.array(n, pa.int64())})
    return docs.select("lang", "text").mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class _Table:
    """Sorted keys beside rows of values; a miss answers -1."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.rows = keys[order], rows[order]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if not self.keys.size:
            return np.full(hashes.size, -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), self.keys.size - 1)
        return np.where(self.keys[at] == hashes, at, -1)


class LanguageModels:
    """Kneser-Ney models of all languages over shared tables."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        """``counts``: for each language the n-grams as rows of symbols, and their counts."""
        self.languages, self.order = sorted(counts), order
        self.heat, self.bounds = 1.0, {}
        alphabet = len({int(c) for g, _ in counts.values() for c in np.unique(g)}) + 1
        self.floor = -math.log(alphabet) if counts else 0.0
        levels = [{} for _ in range(order + 1)]
        for name, (grams, n) in counts.items():
            for k in range(order, 0, -1):
                levels[k][name] = (grams, n.astype(np.float64))
                _, first, n = np.unique(_rows_hash(grams[:, 1:]), return_index=True, return_counts=True)
                grams = grams[first, 1:]
        self.tables: list[_Table | None] = [None]
        self.contexts: list[_Table | None] = [None]
        width = len(self.languages)
        for k in range(1, order + 1):
            every = {name: _rows_hash(g) for name, (g, _) in levels[k].items()}
            keys, first = np.unique(np.concatenate(list(every.values())), return_index=True) if every else (np.empty(0, U64), np.empty(0, int))
            all_grams = np.concatenate([levels[k][name][0] for name in every])[first] if every else np.empty((0, k), int)
            context_of = _rows_hash(all_grams[:, :-1])
            context_keys, context_row = np.unique(context_of, return_inverse=True)
            if k == 1:
                lower = np.full((keys.size, width), self.floor)
            else:
                below = self.tables[k - 1]
                lower = below.rows[below.find(_rows_hash(all_grams[:, 1:]))]
            backoff, values = np.zeros((context_keys.size, width)), np.zeros((keys.size, width))
            for j, name in enumerate(self.languages):
                grams, n = levels[k][name]
                own_context = np.searchsorted(context_keys, _rows_hash(grams[:, :-1]))
                total = np.bincount(own_context, n, context_keys.size)
                kinds = np.bincount(own_context, minlength=context_keys.size)
                once, twice = (n == 1).sum(), (n == 2).sum()
                discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
                seen = total > 0
                backoff[seen, j] = np.log(discount * kinds[seen] / total[seen])
                values[:, j] = backoff[context_row, j] + lower[:, j]
                at = np.searchsorted(keys, every[name])
                values[at, j] = np.log(np.maximum(n - discount, 0) / total[own_context] + np.exp(values[at, j]))
            self.tables.append(_Table(keys, values.astype(np.float32)))
            self.contexts.append(_Table(context_keys, backoff.astype(np.float32)))

    def _score(self, points: np.ndarray) -> np.ndarray:
        """Log probabilities of the symbols from place ``order - 1`` on."""
        n = points.size - self.order + 1
        out = np.zeros((n, len(self.languages)), np.float32)
        rest = np.arange(n)
        for k in range(self.order, 0, -1):
            hashes = gram_hashes(points[self.order - k:], k)[rest]
            at = self.tables[k].find(hashes)
            hit = at >= 0
            out[rest[hit]] += self.tables[k].rows[at[hit]]
            rest = rest[~hit]
            if not rest.size:
                return out
            context = gram_hashes(points[self.order - k:points.size - 1], k - 1)[rest] if k > 1 else np.full(rest.size, mix64(np.zeros(1, U64))[0])
            at = self.contexts[k].find(context)
            out[rest[at >= 0]] += self.contexts[k].rows[at[at >= 0]]
        out[rest] += np.float32(self.floor)
        return out

    def entropies(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol of each text and language, and the numbers of symbols."""
        total, size = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        pad = np.full(self.order - 1, _PAD)
        held, owner, room = [], [], 0

        def flush() -> None:
            nonlocal held, owner, room
            if held:
                lengths = np.array([p.size for p in held])
                scores = self._score(np.concatenate(held))
                # Every piece starts with its context, which is not scored again.
                begins = np.cumsum(lengths) - lengths
                padded = np.concatenate((scores, np.zeros((1, scores.shape[1]), np.float32)))
                cuts = np.stack((begins, begins + lengths - self.order + 1), 1).ravel()
                sums = np.add.reduceat(padded, cuts, dtype=np.float64)[::2]
                np.add.at(total, owner, sums)
            held, owner, room = [], [], 0

        for i, text in enumerate(texts):
            points = symbols(text) if text else np.empty(0, np.int64)
            if not (points != 32).any():
                continue
            size[i] = points.size
            points = np.concatenate((pad, points))
            for at in range(0, points.size - self.order + 1, PIECE):
                piece = points[at:at + PIECE + self.order - 1]
                held.append(piece)
                owner.append(i)
                room += piece.size
                if room >= PIECE:
                    flush()
        flush()
        return -total / np.maximum(size, 1)[:, None], size

    def predict(self, texts: list) -> dict:
        entropy, size = self.entropies(texts)
        out: dict = {"lang_pred": [], "score": [], "rejected": [], "entropy": []}
        for row, n in zip(entropy, size.tolist()):
            if not n or not self.languages:
                values = (UNDEFINED, 0.0, True, None)
            else:
                best = int(np.argmin(row))
                name = self.languages[best]
                weight = np.exp(-self.heat * math.sqrt(n) * (row - row[best]))
                values = (name, float(1 / weight.sum()), bool(row[best] > self.bounds.get(name, math.inf) + SHORT_SLACK / math.sqrt(n)), float(row[best]))
            for column, value in zip(out.values(), values):
                column.append(value)
        return out

    def calibrate(self, entropy: np.ndarray, size: np.ndarray, truth: list[str]) -> None:
        """Fit the confidence and set the rejection bounds."""
        kept = [i for i, (n, t) in enumerate(zip(size, truth)) if n and t in self.languages]
        if not kept:
            return
        entropy, size, right = entropy[kept], size[kept], np.array([self.languages.index(truth[i]) for i in kept])
        gap = (entropy - entropy.min(1, keepdims=True)) * np.sqrt(size)[:, None]

        def loss(heat: float) -> float:
            logits = -heat * gap
            return float(np.mean(np.log(np.exp(logits).sum(1)) - logits[np.arange(len(right)), right]))
        self.heat = min(np.geomspace(0.05, 20, 40), key=loss)
        best = entropy.argmin(1)
        for j, name in enumerate(self.languages):
            own = entropy[(best == j) & (right == j), j]
            if own.size:
                self.bounds[name] = float(own.max()) + SLACK * max(0.5, -self.floor - float(own.max()))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", held_out: int = 2, parts: int = 4) -> LanguageModels:
    """Models from labelled texts whose crc32 part is not held out."""
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(F.coalesce(crc_part("doc_id", parts) != held_out, F.lit(True)))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    chosen = F.lit(False)
    for lang, n in sorted(sizes.items()):
        chosen = chosen | ((F.col("lang") == lang) & share_of(F.col("doc_id"), min(1.0, sample_docs / n)))
    sample = rows.where(chosen)
    checks = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0
    found: dict[str, tuple[list, list]] = {}
    for r in gram_counts(sample.where(~checks), order).toLocalIterator():
        grams, n = found.setdefault(r.lang, ([], []))
        grams.append(r.gram)
        n.append(r.n)
    counts = {}
    for lang, (grams, n) in found.items():
        points = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(grams), order).astype(np.int64)
        counts[lang] = (points, np.array(n))
    models = LanguageModels(counts, order)
    shared = docs.sparkSession.sparkContext.broadcast(models)      # bounded by the sample

    def entropies(texts: list) -> dict:
        entropy, size = shared.value.entropies(texts)
        return {"entropy": entropy.tolist(), "size": size.tolist()}
    held = map_texts(sample.where(checks).select(F.struct("lang").alias("doc_id"), "text"), lambda: entropies, "entropy array<double>, size bigint").collect()
    if held and models.languages:
        models.calibrate(np.array([r.entropy for r in held]), np.array([r["size"] for r in held]), [r.doc_id.lang for r in held])
    return models


def predict(docs: DataFrame, models: LanguageModels, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected, entropy) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    return map_texts(docs, lambda: shared.value.predict, "lang_pred string, score double, rejected boolean, entropy double", id_col, text_col)


def keep_known(docs: DataFrame, models: LanguageModels, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the models reject."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    return keep_rows(docs, lambda: lambda texts: [not r for r in shared.value.predict(texts)["rejected"]], text_col)
