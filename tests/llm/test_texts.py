"""Operators on single texts: token files, secrets, language, BPE, toxicity."""
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curbcast.llm import bpe, language, secrets, token_file, toxicity
from curbcast.llm import queries as Q

from .conftest import DATA

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_strings(n):
    random.seed(4)
    parts = list(" \n\tab'sS1é<|endoftext|>.!?　漢\x1cİΣ́") + ["<|endoftext|>", "'ll", "IT", "Straße ", "the ", "  "]
    return ["".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(n)]


# --- token files

def expected_files(rows):
    tok, start, out = library(WORD), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc, start, ids.size, zlib.crc32(ids.tobytes())))
        start += ids.size
    return out


@pytest.mark.parametrize("block_ids", [7, 1 << 20])
def test_token_files(spark, docs, odd, tmp_path, block_ids):
    for k, table in enumerate((docs, odd)):
        path = str(tmp_path / f"{k}-{block_ids}")
        token_file.write_token_files(table, path, WORD, 2, block_ids=block_ids)
        got = [tuple(r) for r in token_file.read_token_files(spark, path).collect()]
        assert sorted(got, key=str) == sorted(expected_files([(r.doc_id, r.text) for r in table.collect()]), key=str)


def test_token_files_empty(spark, none, tmp_path):
    token_file.write_token_files(none, str(tmp_path / "e"), WORD, 2)
    assert token_file.read_token_files(spark, str(tmp_path / "e"), with_ids=True).count() == 0


def test_units_equal_library():
    texts, tok = odd_strings(1500), library(WORD)
    got = token_file.UnitEncoder(WORD).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_elias_fano():
    rng = np.random.default_rng(1)
    for values in ([], [0], [5], [0, 0, 0], np.cumsum(rng.integers(0, 5, 1000)), np.sort(rng.integers(0, 1 << 40, 777))):
        ef = token_file.EliasFano.of(np.array(values, np.int64))
        assert ef.to_array().tolist() == list(values)
        assert [ef.select(i) for i in range(len(values))] == list(values)
    sizes = rng.integers(1, 2000, 100_000)
    ef = token_file.EliasFano.of(np.cumsum(sizes))
    assert 8 * (len(ef.low) + len(ef.high) + 4 * len(ef.samples)) < 14 * len(sizes)


# --- secrets

def brute_spans(text):
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_secrets_equal_brute_force(spark, docs, odd):
    for table in (docs, odd):
        texts = {(r.doc_id, sha(secrets.joined(brute_spans(r.text or "")))) for r in table.collect()}
        rows = secrets.find_secrets(table).collect()
        assert {(r.doc_id, r.base_sha256) for r in rows} == texts and len(rows) == table.count()
    random.seed(5)
    parts = ["password", "PassWD", "api_key", "apikey", "ſecret", "toKen", "=", ":", " ", "'", '"', "abcdef12", "0123456789abcdef" * 2, "AKIA", "ABCD1234", "x", "é", "\n"]
    for _ in range(3000):
        text = "".join(random.choice(parts) for _ in range(12))
        assert secrets.base_spans(text) == brute_spans(text)


RANKS = secrets.word_ranks()


def test_guess_cost():
    cost = lambda v: secrets.guess_cost(v, RANKS)
    assert cost("password") < cost("P@ssw0rd") < cost("qwertyuiop") < cost("x9$Kq2!vLp")
    assert cost("aaaaaaaaaaaa") < 4 and cost("2024-01-31") < 6 and cost("") == 0
    assert cost("k7Qz" * 40) > 0 and cost("z" * 100_000) > 0
    # Repeats and words of any length stay cheap, and the bound holds at every length.
    assert cost("a" * 64) < cost("a" * 200) < 5 and cost("password" * 8) < cost("password" * 20) < 5
    assert cost("qwertyuiopasdfg" + "letmein") < cost("x9$Kq2!vLpZ0rT") < cost("x9$Kq2!vLpZ0rT" * 2)
    # Never dearer than brute force over the whole value.
    for v in ("hunter2", "correcthorse", "a1b2c3", "Zx81", "Zx8-" * 30, "q0" * 90):
        assert cost(v) <= len(v) * np.log10(secrets._charset(v)) + 0.31
    spans = secrets.guess_spans(t := "pwd is x9$Kq2!vLpZ; pwd is password1", [], RANKS)
    assert [t[a:b] for a, _, b in spans] == ["x9$Kq2!vLpZ"]


def test_guess_cost_equals_all_cuts():
    """The linear form against every span at every cut."""
    random.seed(12)
    parts = ["password", "qwerty", "asdf", "1234", "aaaa", "xyzxyz", "Zk", "9", "2021", "dragon", "!", "abcde"]

    def slow(v):
        n = len(v)
        walks, series, repeats = secrets._runs(v)
        known, brute = [0.0] + [np.inf] * n, [np.inf] * (n + 1)
        single = np.log10(max(10, secrets._charset(v)))
        for j in range(1, n + 1):
            brute[j] = min(brute[j - 1] + single, known[j - 1] + single + 0.3)
            for i in range(j):
                span, k, costs = v[i:j], j - i, []
                for form, extra in ((span.lower(), 0.0), (span.lower().translate(secrets.LEET), 0.5)):
                    if form in RANKS and k >= 3:
                        costs.append(RANKS[form] + extra + (0.3 if span != span.lower() else 0))
                if 4 <= k <= 10 and secrets._DATE.match(span):
                    costs.append(np.log10(365 * 120) if k > 6 else np.log10(120 * 12) if k > 4 else np.log10(120))
                near = secrets._neighbours()
                if k >= 3 and all(b in near.get(a, "") for a, b in zip(span.lower(), span.lower()[1:])):
                    costs.append(np.log10(47) + k * np.log10(2.3))
                if k >= 3 and any(all(ord(b) - ord(a) == d for a, b in zip(span, span[1:])) for d in (1, -1)):
                    costs.append(np.log10(52 * k))
                costs += [secrets.guess_cost(span[:z], RANKS) + np.log10(k // z) for z in range(1, min(secrets.LONGEST_BLOCK, k // 2) + 1) if k % z == 0 and span == span[:z] * (k // z)]
                for c in costs:
                    known[j] = min(known[j], min(known[i], brute[i]) + c + 0.3)
        return min(known[n], brute[n])

    for _ in range(60):
        v = "".join(random.choice(parts) for _ in range(random.randint(1, 6)))
        assert secrets.guess_cost(v, RANKS) == pytest.approx(slow(v), abs=1e-9), v


def test_prose_is_left_alone(spark):
    """Words of the corpus are no secrets, in any language; what stands as a value does not teach the model."""
    prose = ["The token is broken again.", "my password is required here", "Das token is vertraulich, sagt der Bericht.", "The secret is happiness and patience."]
    filler = "broken required vertraulich sagt bericht happiness patience again here " * 6
    leaked = [(100 + k, "password: zqxvwkjhgf!a token is zqxvwkjhgfb") for k in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(prose)] + [(50, filler)] + leaked, "doc_id bigint, text string")
    words = secrets.corpus_words(docs)
    assert {"broken", "vertraulich", "happiness"} <= set(words) and not any(w.startswith("zqx") for w in words)
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(docs).collect()}
    assert [masked[i] for i in range(4)] == prose and masked[50] == filler
    assert all("zqxv" not in masked[d] for d, _ in leaked)
    assert secrets.corpus_words(docs.limit(0)) == []


def test_mask(odd):
    rows = {r.doc_id: r for r in secrets.mask_secrets(odd).collect()}
    assert rows[11].text == "[secret] and pwd is [secret]" and rows[3].text is None and rows[11].key == "?" and secrets.mask("no", RANKS) == "no"
    assert secrets.mask_secrets(odd).count() == odd.count()


def test_values_are_found_whole():
    for value in ("Tr0ub4dor&3horse!", "Zx81kQ2v$9Lp", "hunter2hunter2#%x", "abcdefgh1,Zq;9<x", "pa55-w0rd.Zk@example*7"):
        for before, after in (('password = "', '"'), ("dbpassword='", "' x"), ("api_key: `", "`, next")):
            text = before + value + after
            base = secrets.base_spans(text)
            assert base == brute_spans(text) and [text[a:b] for a, _, b in secrets.guess_spans(text, base, RANKS)] == [value]
            assert secrets.mask(text, RANKS).endswith("[secret]" + after) and value[8:] not in secrets.mask(text, RANKS)
    assert secrets.mask("token=Zx81kQ2v$9Lp, and more", RANKS) == "[secret], and more"
    held = 'token: "abcdefgh12345"'                        # a base span holds it whole
    assert secrets.guess_spans(held, secrets.base_spans(held), RANKS) == []
    assert len(secrets.guess_spans("token=" * 50_000 + "!", [], RANKS)) == 1


# --- language

@pytest.fixture(scope="module")
def models(spark):
    return language.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_language_held_out(spark, models):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 40")
    rows = language.predict(docs, models).join(docs.select("doc_id", "lang"), "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98 and not any(r.rejected for r in rows)


def test_language_probabilities_sum_to_one(models):
    """Every context's distribution over the alphabet, by the back-off chain."""
    symbols = [chr(c) for c in range(97, 123)]
    letters = sorted({int(c) for s in symbols for c in language.symbols(s)} | {32, 1})
    for context in ("xyz", " th", "der"):
        points = [np.array([ord(c) for c in context] + [x]) for x in letters]
        total = np.exp(np.array([models._score(p)[0] for p in points])).sum(0)
        assert (total < 1.001).all()


def test_language_odd(spark, odd, none, models):
    rows = language.predict(odd, models).collect()
    assert len(rows) == odd.count()
    undefined = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert {3, 4, 5, 8} <= undefined and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0 and r.rejected for r in rows if r.lang_pred == "und")
    empty = language.fit(none)
    assert {r.lang_pred for r in language.predict(odd, empty).collect()} == {"und"} and language.predict(none, models).count() == 0
    whole, parts = models.entropies(["abc def " * 90_000])[0], models.entropies(["abc def " * 9])[0]
    assert abs(whole - parts).max() < 0.2
    kept = language.keep_known(odd, models)
    assert kept.columns == odd.columns and not {3, 4, 5, 8} & {r.doc_id for r in kept.collect()}


# --- BPE

@pytest.fixture(scope="module")
def lexicon(docs):
    return bpe.build_lexicon(docs, BYTE, most=3000)


def test_bpe_equals_library(docs, odd, lexicon):
    tok = library(BYTE)
    for table in (docs, odd):
        rows = bpe.digests(table, BYTE, lexicon).collect()
        want = []
        for r in table.collect():
            ids = tok.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
        assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_bpe_strings(lexicon):
    from pyspark import SparkFiles
    codec, tok = bpe.Codec(bpe.Vocabulary(BYTE), bpe.Lexicon(SparkFiles.get(lexicon))), library(BYTE)
    texts = odd_strings(1500) + ["ab" * 3000, "x" * 5000, " " * 700]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert codec.encode(texts) == want
    assert [codec.decode(i) for i in want] == [tok.decode(i, skip_special_tokens=False) for i in want]
    cut = [i[:k] for i in want for k in (1, len(i) // 2)]
    assert [codec.decode(i) for i in cut] == [tok.decode(i, skip_special_tokens=False) for i in cut]


def test_bpe_frames(odd, none, lexicon):
    ids = bpe.encode(odd, BYTE, lexicon)
    back = {r.doc_id: r.text for r in bpe.decode(ids, BYTE).collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in odd.where("doc_id is not null").collect())
    assert bpe.digests(none, BYTE, bpe.build_lexicon(none, BYTE)).count() == 0


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = sorted({"".join(p) for p in __import__("itertools").product("abc", repeat=4)})
    arrays = bpe.compile_lexicon([w.encode() for w in words], [[i] for i in range(len(words))])
    assert arrays["final"].size == 5                      # one state for each length
    bpe.save_lexicon(arrays, str(tmp_path / "x"))
    found = bpe.Lexicon(str(tmp_path / "x")).look_up([w.encode() for w in words] + [b"", b"abca" * 20, b"abd", b"abcab"])
    assert found.tolist() == list(range(len(words))) + [-1] * 4


def test_frequent_units(docs):
    from collections import Counter
    want = Counter(u for r in docs.collect() for u in r.text.split(" ") if u)
    got = {r.unit: r.n for r in bpe.frequent_units(docs, 500).collect()}
    assert 0 < len(got) <= 500 and all(want[u] == n for u, n in got.items())
    assert min(got.values()) >= max(n for u, n in want.items() if u not in got) or len(got) > 400


# --- toxicity

@pytest.fixture(scope="module")
def toxic(spark):
    at = "/root/testdata/sf0.1"
    return toxicity.fit(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"))


def test_toxicity_held_out(spark, toxic):
    at = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{at}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    docs = spark.read.parquet(f"{at}/documents.parquet").join(labels, "doc_id")
    rows = toxicity.score(docs, toxic).join(labels, "doc_id").collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean(np.array(bad) >= 0.5) > 0.9 and np.mean(np.array(good) >= 0.5) < 0.01


def test_grammar():
    model = toxicity.ToxicModel({w: 3.0 for w in toxicity.INSULTS})
    name = lambda text: {toxicity.PATTERNS[i] for i in np.flatnonzero(model.features(text)[:-2])}
    assert name("You are an idiot.") == {"insult_aimed"} and name("What an idiot") == {"insult"}
    assert name("He is not an idiot") == {"insult_denied"} and name("She said he was a moron") == {"insult_reported"}
    assert name("I will kill you") == {"threat_aimed"} and name("nothing here. at all") == set() and name("idiotic") == set()
    assert name("Not today. What an idiot") == {"insult"} and name("idiot") == {"insult"}
    assert len(toxicity.grammar()[0]) <= 2 * 2 * 2 * 5 * 14      # at most the product of the parts


def test_toxicity_odd(spark, odd, none, toxic):
    rows = toxicity.score(odd, toxic).collect()
    assert len(rows) == odd.count() and all(0 <= r.score < 0.5 for r in rows)
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    plain = toxicity.fit(odd, labels)
    assert toxicity.score(none, plain).count() == 0
    many = spark.createDataFrame([(1, 1, "?"), (2, None, "?"), (None, 1, "?"), (1, 1, "?")], "doc_id bigint, toxic int, text string")
    assert 0 <= toxicity.fit(odd, many).scores(["you idiot"])[0] <= 1


def test_queries_return_their_columns(spark):
    want = {"op5_language_id": {"doc_id", "held_out", "lang_pred", "score"}, "op9_toxicity": {"doc_id", "held_out", "score", "predicted"}}
    for name, columns in want.items():
        assert columns <= set(Q.queries()[name](spark, DATA).columns)


def test_token_files_fit_any_vocabulary(spark, docs, odd, tmp_path):
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    assert token_file.bytes_an_id(vocabulary, 2) == 2 and token_file.bytes_an_id(vocabulary, 70_000) == 4
    for name, table, end in (("a", docs, 2), ("b", odd, 70_000)):
        path = str(tmp_path / name)
        token_file.write_token_files(table, path, vocabulary, end, block_ids=500)
        rows = token_file.read_token_files(spark, path, with_ids=True).collect()
        assert all(r.ids[-1] == end for r in rows) and len(rows) == table.count()
        some = [r.doc_id for r in rows if r.doc_id is not None][::3]
        want = sorted((r.doc_id, list(r.ids)) for r in rows if r.doc_id in set(some))
        got = sorted((r.doc_id, list(r.ids)) for r in token_file.look_up(spark, path, [*some, -5, 10**9]).collect())
        assert got == want
