"""Operators on groups of rows, against brute force."""
import hashlib
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pytest

from curbcast.llm import decontaminate, license_texts, licenses, ngram_join, suffix_array, suffix_dedup, vectors
from curbcast.llm import queries as Q
from curbcast.llm.common import components

from .conftest import DATA


def roots(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(80)]
    want = roots({x for l in links for x in l}, links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint"), spark).collect()}
    assert all(want[n] == c for n, c in got.items()) and all(n in got or want[n] == n for n in want)
    assert components(spark.createDataFrame([], "a bigint, b bigint"), spark).count() == 0


# --- repeated and null ids

def test_rows_of_one_id_stay_apart(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(3, base, "x"), (5, base, "y"), (5, "a text that nothing else is like at all", "z"), (None, base, "n"), (7, None, "t"), (5, base, "again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tag string")
    assert sorted(r.tag for r in ngram_join.one_of_each(docs).collect()) == ["n", "t", "x", "z"]
    items = spark.createDataFrame([(1, base)], "item_id bigint, text string")
    assert sorted(r.tag for r in decontaminate.clean(docs, items).collect()) == ["t", "z"]


def test_short_items_and_unspaced_scripts(spark):
    items = spark.createDataFrame([(1, "abracadabra"), (2, "今天天气很好我们去公园"), (3, "open sesame"), (4, None), (5, "")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "hello there abracadabra world"), (2, "他说：今天天气很好，我们去公园。然后回家"), (3, "say open sesame twice"), (4, "nothing of it"), (5, "昨天下雨"), (6, None), (7, "abracadabras")], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} == {(1, 1), (2, 2), (3, 3)}
    assert {r.doc_id for r in decontaminate.clean(docs, items).collect()} == {4, 5, 6, 7}


# --- n-gram join

def brute_classes(rows, n=5, least=0.8):
    sets = {}
    for d, t in rows:
        w = (t or "").lower().split()
        sets[d] = frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    holds = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holds[g].append(d)
    both = Counter((a, b) for l in holds.values() for i, a in enumerate(l) for b in l[:i])
    links = [(a, b) for (a, b), c in both.items() if c >= least * (len(sets[a]) + len(sets[b]) - c) - 1e-9]
    number = Counter(x for l in links for x in l)
    return {d: (r, number[d]) for d, r in roots(sets, links).items()}


def test_ngram_join(spark, docs):
    words = [f"w{i}" for i in range(400)]
    copies = [(10_000 + k, " ".join(words[:k % 40] + [f"z{k}"] + words[k % 40:])) for k in range(120)]        # many near copies
    rows = [(r.doc_id, r.text) for r in docs.collect()] + copies + [(20_000 + k, " ".join(words)) for k in range(30)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_classes(rows)


def test_ngram_join_small_units(spark, docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "SET_ROWS", 5)
    monkeypatch.setattr(ngram_join, "UNIT_ROWS", 5)
    words = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join(words[:k] + [f"z{k}"] + words[k:])) for k in range(60)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_classes(rows)


def test_ngram_join_odd(odd, none):
    rows = ngram_join.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    found = {r.doc_id: r for r in rows}
    assert found[2].class_id == 1 and not found[2].kept and found[7].class_id == 6 and found[3].n_links == 0 and found[3].kept
    assert ngram_join.near_duplicates(none).count() == 0
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6, None, 8, 9, 10, 11, 12}
    assert 1 - (1 - 0.8 ** ngram_join.shortest_prefix()) ** ngram_join.TREES >= ngram_join.RECALL


# --- decontamination

def edited(text, every):
    words = text.split()
    return " ".join("qqq" if i % every == every - 1 else w for i, w in enumerate(words))


def test_decontamination(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()][:20]
    filler = " ".join(f"fill{i}er" for i in range(300))
    rows = [(100 + i, f"{filler} {t} {filler}") for i, t in items] + [(200 + i, f"{filler} {edited(t, 6)} {filler}") for i, t in items if len(t.split()) > 20]
    rows += [(1, filler), (2, ""), (3, None)] + [(300 + k, f"{items[0][1]} copy{k}") for k in range(200)]
    docs, tests = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for block_words in (decontaminate.BLOCK_WORDS, 100):
        got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, tests, block_words=block_words).collect()}
        assert all((100 + i, i) in got and got[100 + i, i].score == 1 for i, _ in items)
        assert all((d, d - 200) in got for d, _ in rows if 200 <= d < 300) and all((300 + k, items[0][0]) in got for k in range(200))
        assert not {d for d, _ in got} & {1, 2, 3}
        hit = got[100 + items[0][0], items[0][0]]
        assert hit.start == 300 and hit.end - hit.start == len(decontaminate.words_of(items[0][1]))
    clean = decontaminate.clean(docs, tests)
    assert {r.doc_id for r in clean.collect()} == {1, 2, 3}


def test_decontamination_equals_alignment_of_everything(spark):
    """Every copy whose alignment reaches the score is found, also where its seeds are few, common or gapped."""
    rng, items = np.random.default_rng(8), [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()][:16]
    filler, rows = " ".join(f"fill{i}er" for i in range(60)), []
    for i, text in items:
        words = text.split()
        for share in (0.2, 0.25, 0.3, 0.35):
            rows += [" ".join(w if rng.random() >= share else f"new{rng.integers(1e9)}" for w in words) for _ in range(4)]
        rows += [" ".join(words[:len(words) // 2]), " ".join(f"{w} gap{k}" for k, w in enumerate(words)), " ".join(w for k, w in enumerate(words) if k % 2 == 0)]
        rows += [" ".join(w for k, w in enumerate(words) if k % 3), " ".join(words[::-1])]
    rows += [rows[2]] * 50 + ["a b a b x a b", "a b c a b d a b"]
    items += [(900, "a b a b a b a b"), (901, "x y z"), (902, "same same same same same same")]
    rows += ["same same same", "x q y z"]
    table = [(d, f"{filler} {t} {filler}") for d, t in enumerate(rows)]
    docs, tests = spark.createDataFrame(table, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    held = [(i, decontaminate.words_of(t)) for i, t in items]
    want = {(d, i): s for d, t in table for i, w in held if (s := decontaminate.align(w, decontaminate.words_of(t))[0] / (2 * w.size)) >= decontaminate.LEAST_SCORE}
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, tests).collect()}
    assert got == want and len(want) > 200
    assert {r.doc_id for r in decontaminate.clean(docs, tests).collect()} == {d for d, _ in table} - {d for d, _ in want}


def test_alignment_equals_plain_dynamic_programming():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(0, 12)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 15)).astype(np.uint64)
        grid = np.zeros((a.size + 1, b.size + 1), int)
        for i in range(1, a.size + 1):
            for j in range(1, b.size + 1):
                grid[i, j] = max(0, grid[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), grid[i - 1, j] - 1, grid[i, j - 1] - 1)
        assert decontaminate.align(a, b)[0] == grid.max()


def test_decontamination_odd(spark, odd, none):
    items = spark.createDataFrame([(1, None, "?"), (2, "", "?"), (3, "a", "?"), (4, "alpha beta gamma delta epsilon zeta", "?"), (4, "alpha beta gamma delta epsilon zeta", "?")], "item_id bigint, text string, doc_id string")
    rows = decontaminate.contaminated(odd, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 4), (2, 4), (None, 4), (9, 3)} and all(r.score == 1 for r in rows)
    assert decontaminate.contaminated(none, items).count() == 0 and decontaminate.contaminated(odd, items.limit(0)).count() == 0


# --- vectors

def test_vectors_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0, None], 1),
            (9, [1.0, 0.0], None), (10, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (11, [1.0, 0.05], 1), (12, [0.0, 1.0], 1), (13, [], 1)]
    table = spark.createDataFrame([r + ("?",) for r in rows], "vec_id bigint, embedding array<float>, label int, rep string")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(table).collect() if r.vec_id is not None)
    assert got == [(1, 3, 1), (2, 3, 1), (2, 3, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 0, 10), (11, 3, 1), (12, 0, 12), (13, 0, 13)]
    assert vectors.near_duplicates(table.limit(0)).count() == 0


def test_vectors_small_units(spark, monkeypatch):
    monkeypatch.setattr(vectors, "UNIT_ROWS", 8)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((6, 16))
    x = np.concatenate([base[i] + 0.12 * rng.standard_normal((40, 16)) for i in range(6)]).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    links = [(i, j) for i in range(len(x)) for j in range(i) if i % 2 == j % 2 and u[i] @ u[j] >= 0.98]
    number, root = Counter(k for l in links for k in l), roots(range(len(x)), links)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(table).collect()}
    assert got == {i: (number[i], root[i]) for i in range(len(x))}


@pytest.mark.parametrize("name", sorted(Q.oracles()))
def test_query_equals_oracle(spark, name):
    from compare import compare, duck
    assert compare(Q.queries()[name](spark, DATA), duck("0.001"), Q.oracles()[name]) is None


# --- suffix arrays

def test_suffix_array():
    rng = np.random.default_rng(5)
    for _ in range(2000):
        text = rng.integers(-3, rng.integers(-2, 4), rng.integers(0, 25)).tolist()
        order = suffix_array.suffix_array(text)
        assert order == sorted(range(len(text)), key=lambda i: text[i:])
        shared = suffix_array.common_prefixes(text, order)
        for k in range(1, len(order)):
            a, b = text[order[k - 1]:], text[order[k]:]
            assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def brute_removal(rows, window):
    met = Counter(t[i:i + window] for _, t in rows for i in range(len(t) - window + 1))
    out = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if met[t[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        spans = len([s for s in bytes(gone).split(b"\0") if s])
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("unit_rows", [512, 4])
def test_suffix_dedup(spark, docs, odd, monkeypatch, unit_rows):
    monkeypatch.setattr(suffix_dedup, "UNIT_ROWS", unit_rows)
    rng = np.random.default_rng(6)
    passage = "".join(rng.choice(list("abcdefgh é"), 700))
    rows = [(k, "".join(rng.choice(list("xyz "), int(rng.integers(0, 80)))) + passage[:int(rng.integers(300, 700))] + "q" * (k % 3) + passage[-int(rng.integers(300, 700)):]) for k in range(40)]
    rows += [(100, "ab" * 900), (101, "ab" * 300), (102, passage * 3), (103, None)]
    for table, window, gram in ((spark.createDataFrame(rows, "doc_id bigint, text string"), 400, 160), (docs.limit(60), 400, 160), (odd, 50, 20)):
        got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(table, window, gram).collect()), key=str)
        assert got == brute_removal([(r.doc_id, (r.text or "").encode()) for r in table.collect()], window)
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0


# --- licences

def test_licenses(spark):
    rows = [("a/LICENSE", "Released under the MIT License.\nmore"), ("a/b/x.py", "plain text"), ("a/b/c/y.py", "Some words.\nLicensed under CC BY-NC 4.0."), ("d/z.py", "nothing"),
            ("a/b/c/d/w.py", None), ("top.txt", ""), (None, "x"), ("e/1", "Licensed under the Apache License, Version 2.0."), ("e/2", "Released under the MIT License"),
            ("e/3", "Licensed under the Apache License, Version 2.0."), ("e/f/g", "licensed words about copyright of nothing in particular today"), ("a/b/x.py", "plain text"),
            ("e/long", "word " * 50_000)]
    table = spark.createDataFrame([r + ("?", "?") for r in rows], "path string, text string, license string, unit string")
    got = {r.path: (r.license, r.own, r.from_dir) for r in licenses.scan(table).collect()}
    assert got == {"a/LICENSE": ("MIT", True, None), "a/b/x.py": ("MIT", False, "a"), "a/b/c/y.py": ("CC-BY-NC-4.0", True, None), "d/z.py": (None, False, None),
                   "a/b/c/d/w.py": ("MIT", False, "a"), "top.txt": (None, False, None), "": (None, False, None), "e/1": ("Apache-2.0", True, None), "e/2": ("MIT", True, None),
                   "e/3": ("Apache-2.0", True, None), "e/f/g": ("Apache-2.0", False, "e"), "e/long": ("Apache-2.0", False, "e")}
    assert licenses.scan(table.limit(0)).count() == 0
    root = spark.createDataFrame([("LICENSE", "Released under the MIT License"), ("a/b", "x")], "path string, text string")
    assert {r.path: r.license for r in licenses.scan(root).collect()} == {"LICENSE": "MIT", "a/b": "MIT"}


def wrapped(text, mark="", width=76):
    return "\n".join(f"{mark} {line}".strip() for line in textwrap.wrap(text, width))


def test_license_blocks(spark):
    """Whole headers and licences in lines of 80 columns; the deciding words stand in other lines than the trigger."""
    gnu = ("This {t} is free software: you can redistribute it and/or modify it under the terms of the GNU {n} as published by the Free Software Foundation, either version {v} of the License, or "
           "(at your option) any later version.", "This {t} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
           "FITNESS FOR A PARTICULAR PURPOSE.  See the GNU {n} for more details.", "You should have received a copy of the GNU {n} along with this {t}.  If not, see <http://www.gnu.org/licenses/>.")
    names = {"GPL-2.0": ("General Public License", 2), "GPL-3.0": ("General Public License", 3), "LGPL-3.0": ("Lesser General Public License", 3), "AGPL-3.0": ("Affero General Public License", 3)}
    rows = [(f"{k}/{m or 'plain'}/{t}", "\n".join([f"{m} Copyright (C) 2019 Jane Roe".strip(), m] + [p for part in gnu for p in (wrapped(part.format(n=n, v=v, t=t), m), m)]) + "\n\nimport os\nrun(os.environ)\n" * 9, k)
            for k, (n, v) in names.items() for m in ("", "#", "//") for t in ("program", "library")]
    for k in ("BSD-2-Clause", "BSD-3-Clause", "MIT", "Apache-2.0", "ISC"):
        text = license_texts.BLOCKS[k][0].replace("Copyright (c) ", "")
        rows += [(f"{k}/{m or 'plain'}", f"{m} Copyright (c) 2020, The Example Authors\n{m}\n{wrapped(text, m)}\n\ncode here\n", k) for m in ("", "*", "--")]
    rows.append(("GPL-3.0/LICENSE", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <http://fsf.org/>\n"
                 " Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n\n"
                 "  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n", "GPL-3.0"))
    table = spark.createDataFrame([r[:2] for r in rows], "path string, text string")
    got = {r.path: r.license for r in licenses.scan(table).collect()}
    assert got == {p: k for p, _, k in rows}


def test_license_files_speak(spark):
    mit = "\n\n".join(("Copyright (c) 2020 Jane Roe", wrapped(license_texts.BLOCKS["MIT"][0].replace("MIT License Copyright (c) ", ""))))
    bsd = "\n\nBSD text\n\n" + wrapped(license_texts.BLOCKS["BSD-3-Clause"][0])
    prose = "Some plain words of an ordinary text that goes on. " * 20
    rows = [("m/LICENSE", mit), ("m/a/b.py", "x"), ("b/notice-text", bsd), ("b/x.py", "x"), ("c/COPYING.md", f"# Project\n\nReleased under the MIT License.\n{prose}"), ("c/d/e/x.py", "x"),
            ("o/1.txt", f"Released under the MIT License.\n{prose}"), ("o/2.txt", "x"), ("n/licenses.py", f"Released under the MIT License.\n{prose}"), ("n/a/LICENSE", "nothing"), ("n/a/x", "x"),
            ("j/1.txt", "Released under the MIT License.\n" + "\u6f22\u5b57\u4eee\u540d" * 200), ("j/2.txt", "x"),
            ("t/head", "Copyright 2020 The Example Authors\n\nLicensed under the Apache License, Version 2.0."), ("t/u/x.py", "x")]
    got = {r.path: (r.license, r.from_dir) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {p: got[p] for p in ("m/a/b.py", "b/x.py", "c/d/e/x.py", "t/u/x.py")} == {"t/u/x.py": ("Apache-2.0", "t"), "m/a/b.py": ("MIT", "m"), "b/x.py": ("BSD-3-Clause", "b"), "c/d/e/x.py": ("MIT", "c")}
    assert all(got[p] == (None, None) for p in ("o/2.txt", "n/a/x", "n/a/LICENSE", "j/2.txt")) and got["o/1.txt"] == got["j/1.txt"] == ("MIT", None)


def test_license_blocks_far_into_a_text(spark):
    """A header is read as a whole wherever it stands: behind many paragraphs, letters and other notices."""
    prose = "\n\n".join("Nothing in this part says anything of the kind. " * 8 + str(i) for i in range(40))
    header = wrapped(license_texts.BLOCKS["AGPL-3.0"][0])
    rows = [("far.txt", f"{prose}\n\n{header}\n\n{prose}"), ("last.txt", f"All rights reserved.\n\n{prose}\n\n{header}")]
    assert all(t.index(header) > 12_000 for _, t in rows)
    got = {r.path: r.license for r in licenses.blocks(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"far.txt": "AGPL-3.0", "last.txt": "AGPL-3.0"}
