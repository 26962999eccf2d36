"""Conversation repair, spelling variants and relational BPE, against brute force and the tokenizer's own library."""
import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from compare import compare, duck

from curbcast.llm import queries as Q
from curbcast.llm import relational_bpe, repair, spelling

from .conftest import CLASH, DATA

NONE = hashlib.sha256(b"").hexdigest()


def clashing(spark, rows, schema):
    """A table with further columns whose names the operators use inside."""
    have = {f.split()[0] for f in schema.split(",")}
    extra = [c for c in (*CLASH, "r", "near", "hit", "digest", "head", "salt", "word", "state") if c not in have]
    return spark.createDataFrame([r + ("?",) * len(extra) for r in rows], schema + "".join(f", {c} string" for c in dict.fromkeys(extra)))


# --- conversations

def damaged(rows):
    """Rows (conv, turn, role, text) after damage, in order, by the rules as stated."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        got = out.setdefault(conv, [])
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        got.extend([(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return {c: sorted(r, key=order) for c, r in out.items()}


def every_repair(rows):
    """(cost, letters, repaired rows) of the best of all edit sequences with at most two insertions in a row."""
    seen, faults = set(), []
    for row in rows:
        end = row[1].rstrip(" \t\n\x0b\x0c\r")
        faults.append("b" if not end else "d" if row in seen else "t" if end[-1] not in ".!?" else "")
        seen.add(row)
    best = [None]

    def legal(roles):
        return re.fullmatch("(s?(ua)*(u)?)|s", roles) is not None

    def go(i, cost, letters, roles, out, inserted):
        if best[0] and cost > best[0][0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            if best[0] is None or (cost, letters) < best[0][:2]:
                best[0] = (cost, letters, out)
        if inserted < 2:
            for name in ("user", "assistant"):
                if legal(roles + name[0]):
                    go(i, cost + 2, letters + "I", roles + name[0], out + [f"{name}:"], inserted + 1)
        if i == len(rows):
            return
        role, text = rows[i]
        go(i + 1, cost + 3, letters + "D", roles, out, 0)
        if faults[i] not in ("b", "d"):
            late = faults[i] == "t"
            if role[:1] in ("s", "u", "a") and legal(roles + role[:1]):
                go(i + 1, cost + late, letters + "K", roles + role[0], out + [f"{role}:{text}"], 0)
            for name in ("user", "assistant"):
                if legal(roles + name[0]):
                    go(i + 1, cost + 2 + late, letters + "R", roles + name[0], out + [f"{name}:{text}"], 0)
    go(0, 0, "", "", [], 0)
    cost, letters, out = best[0]
    pairs = zip([r[0][:1] for r in rows], [r[0][:1] for r in rows[1:]])
    return (faults.count("b"), faults.count("d"), faults.count("t"), sum(a + b not in ("su", "ua", "au") for a, b in pairs), cost, letters,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_repair_is_the_best_of_all_edits(spark):
    rng = random.Random(3)
    rows = []
    for conv in [*range(120), None]:
        turns = [None if rng.random() < 0.1 else t for t in range(rng.randint(1, 6)) if rng.random() < 0.9]
        rows += [(conv, t, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "sage"]), rng.choice(["a.", "b! ", "c", "", "d?\n", "é.", None, " \t"])) for t in turns]
    rows += rows[:20]
    want = {c: every_repair([r[1:] for r in got]) for c, got in damaged(rows).items()}
    got = repair.repair(clashing(spark, rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want[r.conv_id], r


def test_long_conversation_in_blocks_equals_the_whole(spark):
    rng = random.Random(5)
    rows = [(7, t // 2 if t % 50 else None, rng.choice(["user", "assistant", "system"]), rng.choice(["one.", "two", f"{t}.", f"{t}", ""])) for t in range(4000)]
    rows += [(8, 1, "user", "hello.")] + [(9, t, "user" if t % 2 == 0 else "assistant", "x" * 30_000 + f"{t}.") for t in range(300)]
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    for conv, after in damaged(rows).items():
        assert got[conv] == repair.repair_one(*map(list, zip(*after)) if after else ([], [], [])), conv
    assert len(got) == 3


def test_weights_of_blocks_multiply():
    rng = random.Random(9)
    for _ in range(100):
        rows = "".join(rng.choice("suax") + rng.choice("bdt---") for _ in range(rng.randint(0, 9)))
        cut = rng.randint(0, len(rows) // 2)
        a, b, whole = ([w for s in repair.STATES for w in repair.solve(part, s)] for part in (rows[:2 * cut], rows[2 * cut:], rows))
        assert repair.multiply(a, 3 * cut, b, 3 * (len(rows) // 2 - cut)) == whole


def test_conversations_without_rows(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert repair.repair(empty).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row, = repair.repair(spark.createDataFrame([(gone, 0, "user", "a.")], empty.schema)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", NONE)


@pytest.mark.parametrize("name", ["op11_repair", "op12_spelling"])
def test_query_equals_sql(spark, name):
    assert compare(Q.queries()[name](spark, DATA), duck("0.001"), Q.oracles()[name]) is None


# --- spelling

def every_variant(docs):
    counts = Counter()
    for doc, text in docs:
        low = (text or "").translate({ord(c): c.lower() for c in spelling.UPPER})
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    by_word = {w: [v for v in n if v != w and near(w, v)] for w in n}
    form = {}
    for w, vs in by_word.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, form[w], root(w), n[w], len(by_word[w]), n.get(form[w])) for w in n}


def test_variants_equal_brute_force(spark):
    rng = random.Random(11)
    symbol = lambda c: (ord(c) * 2654435761 >> 13) % spelling.SYMBOLS
    same = [c for c in spelling.LETTERS if symbol(c) == symbol("a")][:4]
    crowd = list({"".join(rng.choice(same) for _ in range(6)) for _ in range(400)})      # one reduced word behind all
    assert len(crowd) > 2 * spelling.MOST_WORDS
    base = ["straße", "colour", "color", "colours", "ÉCOLE", "école", "ecole", "aaaaa", "aaaaaa", "aaaaaaa", "Mañana", "manana", "x", "", "abcde", "abcdé", "abcd"]
    base += ["".join(rng.choice("abé") for _ in range(rng.randint(4, 7))) for _ in range(60)]
    docs = [(i, " ".join(rng.choice(base) + rng.choice([" ", "-", "1", "·"]) for _ in range(80))) for i in range(40)]
    docs += [(100 + k, " ".join(w for w in crowd for _ in range(rng.randint(1, 6)))) for k in range(2)]
    docs += [(None, "colour colour colour " * 9), (3, None), (4, ""), (5, "école " * 2000), (5, "école " * 2000)]
    got = spelling.variants(clashing(spark, docs, "doc_id bigint, text string").repartition(4)).collect()
    want = every_variant(docs)
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_no_words(spark, none):
    assert spelling.variants(none).count() == 0


# --- relational BPE

@pytest.fixture(scope="module")
def ranks():
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=relational_bpe.read_ranks(ranks), special_tokens={})


def wanted(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def test_relational_bpe_equals_the_library(spark, odd, ranks, library):
    rng = random.Random(2)
    texts = ["a" * 5001, "ab" * 2000 + "a", "é" * 777, "".join(rng.choice("abcdefgh") for _ in range(900)), "<|endoftext|> x", "\x1c\x85  \n\n  z", "日本語の文章です。", "it's we'll  DON'T 12345678901234567890 ...!!!",
             "́‍👩‍👩‍👧‍👦", "\r\n\t  a", *("".join(rng.choice("aeinstLR 0.é\n") for _ in range(200)) for _ in range(60)), *("".join(rng.choice("aeinst") for _ in range(90)) for _ in range(60))]
    docs = odd.select("doc_id", "text", "own", "ids", "n").unionByName(spark.createDataFrame([(i, t, "?", "?", "?") for i, t in enumerate(texts)], "doc_id bigint, text string, own string, ids string, n string"))
    rows = Counter((r.doc_id, *wanted(library, r.text)) for r in docs.select("doc_id", "text").collect())
    got = relational_bpe.digests(docs, ranks)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == rows


def test_relational_bpe_round_trip(spark, docs, ranks, library, none):
    some = docs.select("doc_id", "text")
    ids = relational_bpe.encode(some, ranks)
    text = {r.doc_id: r.text for r in some.collect()}
    assert all(r.ids == library.encode_ordinary(text[r.doc_id]) for r in ids.collect())
    assert all(bytes(r.bytes).decode() == text[r.doc_id] for r in relational_bpe.decode(ids, ranks).collect())
    assert relational_bpe.digests(none, ranks).count() == 0


def test_merges_hold_every_cut():
    pairs, ids = relational_bpe.merge_table({b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"bc": 4, b"abc": 5})
    assert sorted(zip(pairs.tolist(), ids.tolist())) == [(0 << 16 | 1, 3), (0 << 16 | 4, 5), (1 << 16 | 2, 4), (3 << 16 | 2, 5)]
