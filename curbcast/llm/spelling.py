"""Spelling variants of corpus words: reduced alphabets find words one edit apart.

Letters are hashed to a few symbols.  Two words one edit apart have reduced words
at most one edit apart, so the full one-edit neighbourhood of every distinct reduced
word (itself, deletions, replacements, insertions over the few symbols) is joined
with the reduced vocabulary, and the words behind two reduced words that met are
verified on their letters.  A reduced word with many words behind it would make that
last step grow with their square: its words are reduced anew to a finer alphabet,
each with its own neighbourhood, against the whole vocabulary, so no pair is lost.

Every step is DataFrame code: words are combined before they are shuffled, pairs are
counted map-side, and the roots follow by pointer doubling, since a form has at least
twice the count of its word.

Defined results: a null text has no words; a null id reads as empty in the hash that
picks damaged runs; runs and lengths are in code points; only A to Z are lower-cased;
repeated rows count again; a word without near words has n_near 0, no form and is
its own root; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..checkpoints import stage
from ..operators.blocks import spread
from .common import pick

LEAST_LENGTH, LEAST_COUNT = 5, 3
SYMBOLS = 8             # symbols of the reduced alphabet
FINE_SYMBOLS = 48       # of the finer one, for reduced words with many words
MOST_WORDS = 64         # words behind a reduced word

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of all whole texts, after damage, with at least the least length and count."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[a-z{chr(0xC0)}-{chr(0xFF)}]+"), F.lit(0))
    each = rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(runs).alias("run"))
    each = each.select("run", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    counted = each.select(F.when(F.col("h") % 97 == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= LEAST_LENGTH)
    return counted.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _symbol(k: int) -> str:
    return chr(ord("0") + k)


def reduced(word: Column | str, symbols: int) -> Column:
    """The word with every letter hashed to one of a few symbols."""
    hashed = "".join(_symbol((ord(c) * 2654435761 >> 13) % symbols) for c in LETTERS)
    return F.translate(word, LETTERS, hashed)


def neighbourhood(word: str, symbols: int) -> Column:
    """Every string at most one edit from a reduced word, each once."""
    r, size = F.col(word), F.char_length(word)
    signs = F.array(*[F.lit(_symbol(k)) for k in range(symbols)])

    def edits(first: int, skip: int, put: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(first), size), lambda i: F.transform(
            put, lambda c: F.concat(r.substr(F.lit(1), i - skip), c, r.substr(i + 1, size)))))

    # At place i the letter is replaced or dropped (put ""); after i letters one is inserted.
    return F.array_distinct(F.concat(F.array(r), edits(1, 1, F.concat(signs, F.array(F.lit("")))), edits(0, 0, signs)))


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words exactly one edit apart, once."""
    keyed = stage(vocabulary.withColumn("r", reduced("word", SYMBOLS)), "words")
    sizes = stage(keyed.groupBy("r").agg(F.count("*").alias("size")), "reduced")
    cool = sizes.where(F.col("size") <= MOST_WORDS).select("r")
    # Two reduced words would meet from both; the lesser one's neighbourhood is enough.
    met = spread(cool, "r").select("r", F.explode(neighbourhood("r", SYMBOLS)).alias("s")).where("s >= r").join(cool.select(F.col("r").alias("s")), "s")
    left = keyed.select("r", "word", "n")
    right = keyed.select(F.col("r").alias("s"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    one_edit = F.levenshtein("word", "near", 1) == 1
    plain = met.join(left, "r").join(right, "s").where(one_edit)
    ways = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    plain = plain.select(F.explode(F.when(F.col("r") == F.col("s"), F.slice(ways, 1, 1)).otherwise(ways)).alias("pair")).select("pair.*")
    # Words behind a hot reduced word, against all words, over the finer alphabet; both directions.
    hot = keyed.join(sizes.where(F.col("size") > MOST_WORDS).select("r"), "r").select("word", "n", reduced("word", FINE_SYMBOLS).alias("f"))
    fine = hot.select("word", "n", F.explode(neighbourhood("f", FINE_SYMBOLS)).alias("f"))
    every = keyed.join(sizes, "r").select(F.col("word").alias("near"), F.col("n").alias("near_n"), reduced("word", FINE_SYMBOLS).alias("f"), (F.col("size") > MOST_WORDS).alias("hot"))
    found = fine.join(every, "f").where(one_edit)
    back = found.where("not hot").select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return plain.unionByName(found.select("word", "n", "near", "near_n")).unionByName(back)


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the last of the forms that follow one another from a word, for every word that has a form."""
    ends = stage(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = stage(ends.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not ends.where("moved").limit(1).count():
            return ends.select("word", "root")
        ends = ends.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the texts."""
    vocabulary = stage(words(docs, id_col, text_col), "vocabulary")
    pairs = near_pairs(vocabulary)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    known = vocabulary.join(best, "word", "left")
    chosen = -F.col("best.less") >= 2 * F.col("n")
    known = stage(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best.near")).alias("form"),
                               F.when(chosen, -F.col("best.less")).alias("form_n")), "variants")
    ends = roots(known.where("form is not null").select("word", "form"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
