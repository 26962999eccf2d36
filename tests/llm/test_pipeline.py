"""The pipeline against brute-force versions of its stages, and on odd rows."""
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from curbcast.llm import decontaminate, secrets

from .conftest import DATA
from .test_groups import brute_classes


def test_stages(spark, docs):
    rows, now = {r.doc_id: r for r in docs.collect()}, docs
    for name, function in P.STAGES[:-1]:
        now = spark.createDataFrame(function(spark, now, DATA).collect(), docs.schema)
        kept = {r.doc_id: r for r in now.collect()}
        assert now.columns == docs.columns and set(kept) <= set(rows)
        if name == "language":
            assert len(kept) == len(rows)
        elif name == "near_duplicates":
            assert set(kept) == {d for d, (c, _) in brute_classes([(r.doc_id, r.text) for r in rows.values()]).items() if c == d}
        elif name == "decontamination":
            items = [" ".join(decontaminate._NOT_WORD.sub(" ", r.text.lower()).split()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            holds = lambda t: any(f" {i} " in f" {' '.join(decontaminate._NOT_WORD.sub(' ', t.lower()).split())} " for i in items)
            assert not any(holds(r.text) for r in kept.values()) 
            words = [decontaminate.words_of(i) for i in items]
            best = lambda t: max(decontaminate.align(w, decontaminate.words_of(t))[0] / (2 * w.size) for w in words)
            assert all(holds(rows[d].text) or best(rows[d].text) >= decontaminate.LEAST_SCORE for d in set(rows) - set(kept))
        elif name == "secrets":
            ranks = secrets.word_ranks(secrets.corpus_words(spark.createDataFrame(list(rows.values()), docs.schema)))
            assert all(r.text == secrets.mask(rows[d].text, ranks) and r.n_chars == len(r.text) for d, r in kept.items()) and set(kept) == set(rows)
        rows = kept
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    last = P.STAGES[-1][1](spark, now, DATA).collect()
    assert len(last) == len(rows) and all(r.decoded and list(r.ids) == tok.encode(rows[r.doc_id].text, add_special_tokens=False).ids for r in last)


def test_run_and_odd_rows(spark, odd):
    assert P.run(spark, DATA).count() > 100
    now = odd
    for _, function in P.STAGES[:-1]:
        now = function(spark, now, DATA)
        assert now.columns == odd.columns
    assert P.STAGES[-1][1](spark, now, DATA).count() > 0
    for _, function in P.STAGES:
        assert function(spark, odd.limit(0), DATA).count() == 0
