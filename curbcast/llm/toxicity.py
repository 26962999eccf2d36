"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five small transducers read the token classes of a clause: insult, threat,
target, negation and reported speech.  Their composition is one table of
states; reading a clause ends in a state whose output is the clause's pattern
(an aimed insult, a denied one, a quoted threat, ...) beside the heaviest
insult met.  A document's features are the weights and counts of its matched
clauses, and a logistic weight for each pattern is learned from labels.

The insult lexicon is learned too: words and word beginnings whose presence
separates toxic from other texts in the training sample (log-likelihood ratio)
and which stand in many different surroundings, so that the words of one much
copied toxic text do not count.  Training uses at most about ``SAMPLE_TOXIC``
and ``SAMPLE_OTHER`` labelled documents, chosen by a hash of the id; scoring
reads every whole text, and texts without a lexicon entry cost one search.

Defined results: null and empty texts get the score of a text without matches;
without labels the seed words and default weights are used.
"""
from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Batches, crc_part, map_texts, pick, share_of, small_batches

SAMPLE_TOXIC, SAMPLE_OTHER = 3000, 6000
LEXICON_ENTRIES = 2000       # most separating words and beginnings kept
LEAST_RATIO = 20.0           # log-likelihood ratio of an entry
LEAST_ODDS = 3.0             # log odds ratio of an entry
LEAST_SURROUNDINGS = 4       # different neighbours an entry must have in toxic texts
LEAST_WORDS = 3              # different words a beginning must have there
BEGINNINGS = range(3, 8)     # lengths of word beginnings tried

# Fixed seed words, in four languages.
INSULTS = "idiot moron imbecile stupid worthless pathetic scum loser trash crétin abruti connard dummkopf arschloch idiota imbécil".split()
THREATS = "kill hurt destroy beat stab shoot murder tuer frapper détruire töten schlagen umbringen matar golpear destruir".split()
TARGETS = "you your yours he she they them him her this these vous tu toi ton votre il elle ils du dich dir euch ihr sie er usted tú ustedes él ella ellos".split()
NEGATIONS = "not no never nor neither without isn aren wasn don doesn didn pas jamais non nicht kein keine nie niemals nunca ni jamás".split()
REPORTS = "said says say wrote writes claimed called quoted reported dit écrit selon sagte schrieb laut dijo escribió según".split()

CLASSES = ("insult", "threat", "target", "negation", "report", "other")
PATTERNS = ("insult", "insult_aimed", "insult_denied", "insult_reported", "threat", "threat_aimed", "threat_denied", "threat_reported")
_CLAUSE_END = re.compile(r"[.!?;:\n]")
_NOT_LETTER = re.compile(r"[\W\d_]")


# --- transducers -----------------------------------------------------------------------

@dataclass(frozen=True)
class Transducer:
    """States are numbers from 0; a class without an arc keeps the state.  ``final`` names the output of a state."""
    arcs: dict
    final: dict

    def step(self, state: int, kind: str) -> int:
        return self.arcs.get((state, kind), state)


def flag(kind: str, name: str) -> Transducer:
    """Seen or not seen."""
    return Transducer({(0, kind): 1}, {1: name})


def before(kind: str, hits: tuple[str, ...], reach: int, name: str) -> Transducer:
    """``kind``, at most ``reach`` tokens ahead of one of ``hits``."""
    arcs, done = {}, reach + 1
    for state in range(done):
        arcs[state, kind] = 1
        for other in CLASSES:
            if other != kind and state:
                arcs[state, other] = done if other in hits else (state + 1 if state < reach else 0)
    return Transducer(arcs, {done: name})


def compose(parts: dict[str, Transducer]) -> tuple[np.ndarray, list[frozenset]]:
    """One table [state, class] of the reachable joint states, and the outputs of each state."""
    names, start = list(parts), tuple(0 for _ in parts)
    number, table, outputs, todo = {start: 0}, [], [], [start]
    for state in todo:
        row = []
        for kind in CLASSES:
            after = tuple(parts[n].step(s, kind) for n, s in zip(names, state))
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
        table.append(row)
        outputs.append(frozenset(parts[n].final[s] for n, s in zip(names, state) if s in parts[n].final))
    return np.array(table), outputs


def grammar() -> tuple[list[list[int]], list[tuple[int, ...]]]:
    """The composed table, and for each state the numbers of its patterns."""
    hits = ("insult", "threat")
    table, outputs = compose({"insult": flag("insult", "insult"), "threat": flag("threat", "threat"), "target": flag("target", "aimed"),
                              "negation": before("negation", hits, 3, "denied"), "report": before("report", hits, 12, "reported")})
    patterns = []
    for found in outputs:
        own = []
        for what in ("insult", "threat"):
            if what in found:
                how = "denied" if "denied" in found else "reported" if "reported" in found else "aimed" if "aimed" in found else ""
                own.append(PATTERNS.index(f"{what}_{how}" if how else what))
        patterns.append(tuple(own))
    return table.tolist(), patterns


# --- lexicon and scoring -----------------------------------------------------------------

@dataclass
class ToxicModel:
    """Lexicon weights, pattern weights, and the search automaton of a worker."""
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray | None = None

    def __post_init__(self):
        self._ready = False

    def __getstate__(self):
        return self.words, self.stems, self.weights

    def __setstate__(self, state):
        self.words, self.stems, self.weights = state
        self._ready = False

    def _prepare(self) -> None:
        self.table, self.patterns = grammar()
        self.kind = {w: k for k, ws in ((2, TARGETS), (3, NEGATIONS), (4, REPORTS)) for w in ws}
        self.lengths = sorted({len(s) for s in self.stems})
        self.search = ahocorasick.Automaton()
        for w in {*self.words, *THREATS}:
            self.search.add_word(f" {w} ", 1)
        for s in self.stems:
            self.search.add_word(f" {s}", 1)
        if len(self.search):
            self.search.make_automaton()
        self._ready = True

    def insult(self, word: str) -> float:
        """Weight of a word as an insult, 0 if it is none."""
        return max([self.words.get(word, 0.0), *(self.stems.get(word[:k], 0.0) for k in self.lengths if len(word) >= k)])

    def features(self, text: str | None) -> np.ndarray:
        """For each pattern log(1 + clauses); then the heaviest insult and the log of their sum."""
        if not self._ready:
            self._prepare()
        out = np.zeros(len(PATTERNS) + 2)
        if not text or not len(self.search):
            return out
        lower = text.lower()
        plain = f" {_NOT_LETTER.sub(' ', lower)} "
        done, heavy, total = -1, 0.0, 0.0
        for end, _ in self.search.iter(plain):
            at = min(end - 1, len(lower) - 1)
            if at < done:
                continue
            start = at
            while start > 0 and lower[start - 1] not in ".!?;:\n":
                start -= 1
            stop = _CLAUSE_END.search(lower, max(at - 1, start))
            done = stop.end() if stop else len(lower)
            state, best = 0, 0.0
            for word in plain[start + 1:done + 1].split():
                weight = self.insult(word)
                if weight > 0:
                    kind, best = 0, max(best, weight)
                    total += weight
                else:
                    kind = 1 if word in _THREATS else self.kind.get(word, 5)
                state = self.table[state][kind]
            heavy = max(heavy, best)
            for p in self.patterns[state]:
                out[p] += 1
        out[:-2] = np.log1p(out[:-2])
        out[-2:] = heavy, math.log1p(total)
        return out

    def scores(self, texts: list) -> list[float]:
        x = np.array([self.features(t) for t in texts]).reshape(len(texts), len(PATTERNS) + 2)
        weights = self.weights if self.weights is not None else DEFAULT_WEIGHTS
        return (1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))).tolist()


_THREATS = frozenset(THREATS)
DEFAULT_WEIGHTS = np.array([-2.0, 4.0, 5.0, -1.0, 1.0, 3.0, 5.0, -1.0, 1.0, 0.1, 0.1])


def _tokens(text: str) -> list[str]:
    return _NOT_LETTER.sub(" ", text.lower()).split()


def _entries(words) -> set[str]:
    """Whole words as `=word`, beginnings as they are."""
    out = set()
    for w in words:
        out.add("=" + w)
        out.update(w[:k] for k in BEGINNINGS if k < len(w))
    return out


def _presence(sample: DataFrame) -> DataFrame:
    """(entry, n1, n0): texts of each class that hold an entry, counted in each batch and then summed."""
    def count(batches: Batches) -> Batches:
        for batch in small_batches(batches):
            held: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for e in _entries(set(_tokens(text))):
                    held.setdefault(e, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_pydict({"entry": list(held), "n0": [v[0] for v in held.values()], "n1": [v[1] for v in held.values()]})
    return sample.mapInArrow(count, "entry string, n0 bigint, n1 bigint").groupBy("entry").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _surroundings(sample: DataFrame, entries: frozenset) -> DataFrame:
    """(entry, around, words): different neighbours of an entry in toxic texts, and different words of a beginning."""
    def find(batches: Batches) -> Batches:
        for batch in small_batches(batches):
            held = set()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = ["", *_tokens(text), ""] if toxic else []
                for k in range(1, len(words) - 1):
                    for e in ("=" + words[k], *(words[k][:n] for n in BEGINNINGS if n < len(words[k]))):
                        if e in entries:
                            held.add((e, words[k - 1] + " " + words[k + 1], words[k]))
            rows = sorted(held)
            yield pa.RecordBatch.from_pydict({"entry": pa.array([r[0] for r in rows], pa.string()), "pair": pa.array([r[1] for r in rows], pa.string()),
                                                "word": pa.array([r[2] for r in rows], pa.string())})
    return sample.mapInArrow(find, "entry string, pair string, word string").groupBy("entry").agg(F.countDistinct("pair").alias("around"), F.countDistinct("word").alias("words"))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 3e-4, rounds: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept comes first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) / weight.sum() + ridge * np.r_[0, w[1:]]
        bend = (x * (weight * p * (1 - p) / weight.sum())[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend + 1e-6 * np.eye(len(w)), slope)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: int = 0, parts: int = 5,
        sample_toxic: int = SAMPLE_TOXIC, sample_other: int = SAMPLE_OTHER) -> ToxicModel:
    marks = pick(labels, doc_id=id_col, toxic=label_col).where(F.col("toxic").isin(0, 1)).where(crc_part("doc_id", parts) != held_out).distinct()
    sizes = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    rate = {t: min(1.0, most / max(1, sizes.get(t, 0))) for t, most in ((1, sample_toxic), (0, sample_other))}
    # About sample_toxic + sample_other rows of two numbers, by construction.
    marks = F.broadcast(marks.where(F.when(F.col("toxic") == 1, share_of(F.col("doc_id"), rate[1])).otherwise(share_of(F.col("doc_id"), rate[0]))))
    sample = pick(docs, doc_id=id_col, text=text_col).where("text is not null").join(marks, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")).persist()
    try:
        n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
        n1, n0 = n.get(1, 0), n.get(0, 0)
        model = ToxicModel({w: 3.0 for w in INSULTS})
        if not n1 or not n0:
            return model
        # Log-likelihood ratio of presence against the label, and log odds.
        both, rest = F.col("n1") + F.col("n0"), F.lit(n1 + n0)
        def part(k, expected):
            return F.when(k > 0, 2 * k * F.log(k / expected)).otherwise(0.0)
        ratio = (part(F.col("n1"), both * n1 / rest) + part(F.col("n0"), both * n0 / rest) + part(n1 - F.col("n1"), (rest - both) * n1 / rest) + part(n0 - F.col("n0"), (rest - both) * n0 / rest))
        odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
        found = _presence(sample).select("entry", ratio.alias("ratio"), odds.alias("odds")).where((F.col("ratio") >= LEAST_RATIO) & (F.col("odds") >= LEAST_ODDS))
        found = {r.entry: r.odds for r in found.orderBy(F.desc("ratio"), "entry").limit(LEXICON_ENTRIES).collect()}
        met = {r.entry: r.around >= LEAST_SURROUNDINGS and (r.entry[0] == "=" or r.words >= LEAST_WORDS) for r in _surroundings(sample, frozenset(found)).collect()} if found else {}
        kept = {e: w for e, w in found.items() if met.get(e)}
        model = ToxicModel({w: 3.0 for w in INSULTS} | {e[1:]: w for e, w in kept.items() if e[0] == "="}, {e: w for e, w in kept.items() if e[0] != "="})
        shared = docs.sparkSession.sparkContext.broadcast(model)
        rows = map_texts(sample.select(F.col("toxic").alias("doc_id"), "text"), lambda: lambda texts: {"x": [shared.value.features(t).tolist() for t in texts]}, "x array<double>").collect()
        y = np.array([r.doc_id for r in rows], float)
        model.weights = _logistic(np.array([r.x for r in rows]), y, np.ones(len(y)))
        return model
    finally:
        sample.unpersist()


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)       # bounded by the lexicon
    return map_texts(docs, lambda: lambda texts: {"score": shared.value.scores(texts)}, "score double", id_col, text_col)
