"""Secret scan: fixed patterns, and guess cost of values in credential context.

Three base patterns are matched leftmost and without overlap, each for itself.
The method adds values that follow a credential word (``pwd``, ``passphrase``,
``client_secret``, ``authorization: bearer`` and others) in a form the base
patterns miss, and whole values of which a base span holds only a part (base
spans stay as they are).  A value ends at white space or a closing character,
and in quotes at the closing quote.  It counts when guessing it would be dear: the least
cost, over all cuts into known words, dates, repeats, keyboard walks and
brute-force spans, is found by dynamic programming in log10 guesses.

Known words are a fixed list of passwords and the most frequent words of the
corpus itself, in whatever languages it is written, ranked by their counts over
all texts.  What stands in a credential context is left out of the counts, so a
secret never teaches itself, however many copies hold it.

Offsets are code points, ends exclusive.  Defined results: a null or empty
text has no spans; rows with equal ids are all kept; texts and values of any
length are taken whole, in time linear in their length.
"""
from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..checkpoints import stage
from .common import map_text_column, map_texts, pick

KINDS = ("assign", "access", "hex", "guess")      # order of kinds at one start
LEAST_GUESSES = 9.0                               # log10 guesses from which a value is a secret
CORPUS_WORDS = 50_000                             # most frequent words of the corpus that the cost model knows
SHORTEST_WORD, LONGEST_WORD = 3, 24
LONGEST_BLOCK = 64                                # characters of a block that is repeated

# Fixed patterns of the base kinds.  Letters of `assign` are ASCII letters in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Credential words of the added kind, and what may stand between word and value.
CONTEXT_WORDS = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key",
                 "private_key", "credential", "credentials", "authorization", "bearer")
CONTEXT = re.compile(r"(?<![A-Za-z])(?:" + "|".join(sorted(map(re.escape, CONTEXT_WORDS), key=len, reverse=True)) + r")(?![A-Za-z])"
                     r"(?:[\"']?[\x20\t]*(?:=>|:=|[:=])[\x20\t]*|[\x20\t]+is[\x20\t]+|[\"']?[\x20\t]*:[\x20\t]*bearer[\x20\t]+)(?:[\"'`](?=[^\s]{6})|[\"'`]?(?=[^\s\"'`<>,;]{6}))", re.I | re.A)
OPEN_VALUE = re.compile(r"[^\s\"'`<>,;]+")          # a value without quotes, or whose quote is never closed
QUOTED_VALUE = {q: re.compile(rf"[^\s{q}]+(?={q})") for q in "\"'`"}

# Fixed word list of the cost model, most common first.
WORDS = ("password letmein admin welcome login monkey dragon master shadow sunshine princess football baseball iloveyou superman batman trustno1 "
         "hello freedom whatever secret summer winter spring autumn love test guest root user qwerty abc pass word the and you that was for are with "
         "his they this have from one had not but what all were when your can said there use each which she how their will other about out many then "
         "them these some her would make like him into time has look two more write see number way could people my than first water been call who "
         "oil its now find long down day did get come made may part company house home server data example sample changeme default public private key "
         "token access none null true false").split()
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4@31!05$7", "aaeiiosst")


def word_ranks(corpus: list[str] = ()) -> dict[str, float]:
    """log10 guesses of each known word; ``corpus`` lists words, most frequent first."""
    ranks = {w: math.log10(k + 2) for k, w in reversed(list(enumerate(corpus)))}
    for k, w in reversed(list(enumerate(WORDS))):
        ranks[w] = min(math.log10(k + 2), ranks.get(w, math.inf))
    return ranks


def corpus_words(docs: DataFrame, most: int = CORPUS_WORDS, text_col: str = "text") -> list[str]:
    """At most ``most`` of the most frequent words of all texts, most frequent first.

    Counts fall into fine logarithmic classes and the highest that fit are taken
    whole, so what reaches the driver is bounded by ``most``.
    """
    names = "|".join(sorted(map(re.escape, CONTEXT_WORDS), key=len, reverse=True))
    bare = F.regexp_replace("text", rf"(?i)(?:{names})[\"']?\s*(?:=>|:=|[:=]|\sis\s)\s*(?:bearer\s)?\S+", " ")
    word = F.explode(F.split(F.lower(bare), r"[^\p{L}]+")).alias("word")
    counts = pick(docs, text=text_col).where("text is not null").select(word).where(F.char_length("word").between(SHORTEST_WORD, LONGEST_WORD))
    counts = counts.groupBy("word").agg(F.count("*").alias("n")).where("n >= 5").withColumn("class", F.floor(F.log2("n") * 64).cast("int"))
    counts = stage(counts, "words")
    left, least = most, 1 << 30
    for r in counts.groupBy("class").count().orderBy(F.desc("class")).collect():     # a row a class: at most a few thousand
        if r["count"] > left:
            break
        left, least = left - r["count"], r["class"]
    return [r.word for r in counts.where(F.col("class") >= least).orderBy(F.desc("n"), "word").collect()]


@lru_cache(maxsize=1)
def _neighbours() -> dict[str, str]:
    """Keys next to each key: in its row, and in the rows above and below."""
    near: dict[str, set] = {}
    for r, row in enumerate(KEY_ROWS):
        for c, key in enumerate(row):
            around = [row[c + d] for d in (-1, 1) if 0 <= c + d < len(row)]
            around += [KEY_ROWS[r + s][c + d] for s in (-1, 1) for d in (-1, 0, 1) if 0 <= r + s < len(KEY_ROWS) and 0 <= c + d < len(KEY_ROWS[r + s])]
            near[key] = set(around)
    return {k: "".join(sorted(v)) for k, v in near.items()}


_DATE = re.compile(r"(?:(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)?\d\d)\Z")


def _ahead(same: np.ndarray) -> list[int]:
    """For every place, how many truths stand in a row from it on."""
    stops = np.where(same, same.size, np.arange(same.size))
    return (np.minimum.accumulate(stops[::-1])[::-1] - np.arange(same.size)).tolist()


def _runs(value: str) -> tuple[list[int], list[int], list[tuple[int, list[int]]]]:
    """From every place: length of the keyboard walk, of the run up or down the code points, and repeats by block size."""
    n, near, lower = len(value), _neighbours(), value.lower()
    walk = np.array([lower[k + 1] in near.get(lower[k], "") for k in range(min(n, len(lower)) - 1)] + [False] * (n - min(n, len(lower)) + 1), bool)
    code = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<i4").astype(np.int64)
    step = np.diff(code)
    series = [0] * n
    for way in (1, -1):
        series = [max(a, b) for a, b in zip(series, [*_ahead(step == way), 0])]
    repeats = []
    for size in range(1, min(LONGEST_BLOCK, n // 2) + 1):
        same = code[:-size] == code[size:]
        if same.any() and max(found := _ahead(same)) >= size:
            repeats.append((size, found + [0] * size))
    return [k + 1 for k in _ahead(walk)], [k + 1 for k in series], repeats


def _charset(text: str) -> int:
    size = 0
    for test, count in ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10)):
        size += count * any(map(test, text))
    return size + 33 * any(not c.isalnum() for c in text) or 100


def guess_cost(value: str, ranks: dict[str, float]) -> float:
    """Least log10 guesses over all cuts of ``value``; more segments cost their order too.

    A walk or repeat is offered to its end and to the places a longest word before
    it: ending it earlier never pays, since a longer one costs less than what
    would follow, unless a word begins inside it.
    """
    n = len(value)
    if not n:
        return 0.0
    lower = value.lower() if len(value.lower()) == n else value
    plain = lower.translate(LEET)
    single = math.log10(max(10, _charset(value)))
    walks, series, repeats = _runs(value)
    blocks: dict[str, float] = {}
    # By place: least cost of what comes before it, ending in a brute-force span or not.
    known, brute = [0.0] + [math.inf] * n, [math.inf] * (n + 1)

    def offer(i: int, j: int, cost: float, so_far: float) -> None:
        if so_far + cost + 0.3 < known[j]:
            known[j] = so_far + cost + 0.3

    for i in range(n):
        so_far = min(known[i], brute[i])
        brute[i + 1] = min(brute[i] + single, known[i] + single + 0.3)
        for j in range(i + SHORTEST_WORD, min(n, i + LONGEST_WORD) + 1):
            for form, extra in ((lower, 0.0), (plain, 0.5)):
                if (rank := ranks.get(form[i:j])) is not None:
                    offer(i, j, rank + extra + (0.3 if value[i:j] != lower[i:j] else 0.0), so_far)
        if value[i].isdigit():
            for j in range(i + 4, min(n, i + 10) + 1):
                if _DATE.match(value[i:j]):
                    offer(i, j, math.log10(365 * 120) if j - i > 6 else math.log10(120 * 12) if j - i > 4 else math.log10(120), so_far)
        for length, cost in ((walks[i], lambda k: math.log10(47) + k * math.log10(2.3)), (series[i], lambda k: math.log10(26 * 2 * k))):
            for k in range(max(3, length - LONGEST_WORD), length + 1):
                offer(i, i + k, cost(k), so_far)
        for size, same in repeats:
            if same[i] >= size:
                times = 1 + same[i] // size
                block = value[i:i + size]
                unit = blocks.get(block) or blocks.setdefault(block, guess_cost(block, ranks))
                for k in range(max(2, times - LONGEST_WORD // size - 1), times + 1):
                    offer(i, i + k * size, unit + math.log10(k), so_far)
    return min(known[n], brute[n])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _value_end(text: str, start: int) -> int:
    """Where the value that begins at ``start`` ends: at its closing quote, else before closing punctuation."""
    if start and (quoted := QUOTED_VALUE.get(text[start - 1])) and (m := quoted.match(text, start)):
        return m.end()
    end = m.end() if (m := OPEN_VALUE.match(text, start)) else start
    while end > start and text[end - 1] in ".)]}!?":
        end -= 1
    return end


def guess_spans(text: str, base: list[tuple[int, int, int]], ranks: dict[str, float]) -> list[tuple[int, int, int]]:
    """Values in credential context that are dear to guess and that no base span holds whole."""
    lower = text.lower()
    if not any(w in lower for w in CONTEXT_WORDS):
        return []
    # The fixed pattern also finds words inside longer names; its values are followed to their ends too.
    starts = {m.end() for m in CONTEXT.finditer(text)} | {ASSIGN.match(text, a).start(2) for a, kind, _ in base if kind == 0}
    found, end = [], 0
    for start in sorted(starts):
        if start < end:                    # inside the value before it
            continue
        end = _value_end(text, start)
        if end - start >= 6 and not any(a <= start and end <= b for a, _, b in base) and guess_cost(text[start:end], ranks) >= LEAST_GUESSES:
            found.append((start, 3, end))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _known(docs: DataFrame, text_col: str):
    """The known words of a corpus for all workers; their number is bounded."""
    return docs.sparkSession.sparkContext.broadcast(word_ranks(corpus_words(docs, text_col=text_col)))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess) for every document."""
    shared = _known(docs, text_col)

    def scan(texts: list) -> dict:
        out: dict = {name: [] for name in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess")}
        for text in texts:
            base = base_spans(text or "")
            added = guess_spans(text or "", base, shared.value)
            row = (*[sum(k == kind for _, k, _ in base) for kind in range(3)], hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + added)), len(added))
            for column, value in zip(out.values(), row):
                column.append(value)
        return out
    return map_texts(docs, lambda: scan, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_guess bigint", id_col, text_col)


def mask(text: str, ranks: dict[str, float], mark: str = "[secret]") -> str:
    """The text with every found span replaced; overlapping spans are one."""
    base = base_spans(text)
    out, at = [], 0
    end = -1
    for a, _, b in sorted(base + guess_spans(text, base, ranks)):
        if a < end:
            end = max(end, b)
            at = end
            continue
        out += [text[at:a], mark]
        at = end = b
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with secrets replaced in the text; every row and every other column stays."""
    shared = _known(docs, text_col)
    return map_text_column(docs, lambda: lambda texts: [None if t is None else mask(t, shared.value, mark) for t in texts], text_col)
