"""Byte-level BPE as relational steps: DuckDB recursion inside every Spark partition.

A worker keeps the vocabulary as two tables, ``vocabulary`` (id and bytes) and
``merges`` (two neighbouring ids, and the id of their concatenation, which is also
its rank).  The words of a batch are split off by the vocabulary's pattern; those
not met before become token-position rows, which a recursive query contracts:
every round joins each word's neighbours with ``merges`` and contracts the word's
leftmost pair of least rank, until no word has a pair left.  Ids are joined by an
ordered aggregation; decoding joins them with ``vocabulary`` and aggregates the
bytes in order.

The merges hold every way to cut a token into two tokens, not only the one its
training took, and a word that is itself a token is that token, as in the tiktoken
library.  A long word contracts all places of its least rank in one round where no
token that can arise forms a pair of a lower rank, which is what contracting them
one by one from the left gives.

Defined results: a null or empty text has no ids and decodes to nothing; texts are
whole; repeated ids stay rows of their own; other columns are not read.
"""
from __future__ import annotations

import base64
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .bpe import words_of
from .common import Batches, map_texts, pick, small_batches

BATCH_CHARS = 4 << 20       # texts of a DuckDB query; a longer text is one query
KNOWN_WORDS = 600_000       # remembered words of a worker
MERGE_WORDS = 12_000        # words of a recursive query
LONG_WORD = 64              # bytes above which a word goes the way of long words
LONG_WORDS_A_QUERY = 500
MEMORY = "300MB"

# A token row points to the next one of its word (-1: none).  One round joins
# neighbours with the merges, takes each word's leftmost pair of least rank (``key``
# orders pairs by the new id, then by place) and contracts it; words without a pair
# are done.
SHORT_WORDS = """
WITH RECURSIVE t(word, slot, id, next, done) AS (
  SELECT word, slot, id, next, false FROM start
  UNION ALL (
  WITH pairs AS MATERIALIZED (
    SELECT a.word, m.id * 4294967296 + (a.slot & 4294967295) AS key, a.slot, a.next, b.next AS after
    FROM t a JOIN t b ON b.slot = a.next JOIN merges m ON m.pair = a.id * 65536 + b.id WHERE NOT a.done AND NOT b.done),
  low AS (SELECT word, min(key) AS key FROM pairs GROUP BY word),
  best AS (SELECT p.word, p.key // 4294967296 AS id, p.slot, p.next AS gone, p.after FROM pairs p SEMI JOIN low USING (word, key))
  SELECT t.word, t.slot, CASE WHEN t.slot = b.slot THEN b.id ELSE t.id END, CASE WHEN t.slot = b.slot THEN b.after ELSE t.next END, b.word IS NULL
  FROM t LEFT JOIN best b ON b.word = t.word WHERE NOT t.done AND t.slot IS DISTINCT FROM b.gone))
SELECT word, slot, id FROM t WHERE done
"""

# The same for long words, whose rounds are many: only the newest state of a token
# row is kept.  Where the new token is calm (no pair with it has a lower rank), all
# places of a word's least rank are contracted, every second one in a run of
# overlapping places, as going from the left would; otherwise the leftmost alone.
LONG_WORDS = """
WITH RECURSIVE t(slot, word, id, next) USING KEY (slot) AS (
  SELECT slot, word, id, next FROM start
  UNION (
  WITH live AS MATERIALIZED (SELECT r.slot, r.word, r.id, r.next FROM recurring.t r SEMI JOIN t USING (word) WHERE r.id >= 0),
  pairs AS MATERIALIZED (
    SELECT a.word, m.id AS new, m.calm, a.slot, a.next, b.next AS after FROM live a JOIN live b ON b.slot = a.next JOIN merges m ON m.pair = a.id * 65536 + b.id),
  low AS (SELECT word, min(new) AS new FROM pairs GROUP BY word),
  least AS (
    SELECT p.*, lag(p.next) OVER (PARTITION BY word ORDER BY slot) IS DISTINCT FROM slot AS head, row_number() OVER (PARTITION BY word ORDER BY slot) AS place
    FROM pairs p SEMI JOIN low USING (word, new)),
  runs AS (SELECT *, place - max(CASE WHEN head THEN place END) OVER (PARTITION BY word ORDER BY slot) AS later FROM least),
  best AS MATERIALIZED (SELECT * FROM runs WHERE later % 2 = 0 AND (calm OR place = 1))
  SELECT slot, word, new, after FROM best UNION ALL SELECT next, word, -1, -1 FROM best))
SELECT word, slot, id FROM t WHERE id >= 0
"""


def merge_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of ids as one number, id of their concatenation) for every cut of every token into two tokens."""
    pairs, ids = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs.append(left << 16 | right)
                ids.append(rank)
    return np.array(pairs, np.int64), np.array(ids, np.int64)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Engine:
    """A worker's DuckDB tables of one vocabulary."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs, ids = merge_table(ranks)
        self.put("cuts", pair=pairs, id=ids)
        self.run("""CREATE TABLE merges AS
          WITH low AS (SELECT token, min(id) AS low FROM (SELECT pair >> 16 AS token, id FROM cuts UNION ALL SELECT pair & 65535, id FROM cuts) GROUP BY token)
          SELECT pair, id, coalesce(low > id, true) AS calm FROM cuts LEFT JOIN low ON token = id""")
        self.put("vocabulary", id=np.array(list(ranks.values()), np.int64), bytes=pa.array(list(ranks), pa.binary()))
        self.run("CREATE TABLE known (word VARCHAR, n BIGINT, ids VARCHAR, decoded VARCHAR)")

    def run(self, sql: str) -> list[tuple]:
        return self.con.execute(sql).fetchall()

    def put(self, name: str, **columns) -> None:
        rows = pa.table(columns)
        self.con.register("rows_in", rows)
        self.run(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM rows_in")
        self.con.unregister("rows_in")

    def learn(self, words: pa.Array) -> None:
        """Encode the words that are not known yet; a full memory keeps only words of this batch."""
        self.put("met", word=words)
        new = f"SELECT word, strlen(word) > {LONG_WORD} AS long FROM met ANTI JOIN known USING (word)"
        fresh = self.con.sql(new).to_arrow_table()
        if fresh.num_rows and self.run("SELECT count(*) FROM known")[0][0] + fresh.num_rows > KNOWN_WORDS:
            self.run("CREATE OR REPLACE TABLE known AS SELECT * FROM known SEMI JOIN met USING (word)")
        for long, most, sql in ((False, MERGE_WORDS, SHORT_WORDS), (True, LONG_WORDS_A_QUERY, LONG_WORDS)):
            part = fresh.filter(pc.equal(fresh.column("long"), long)).column("word")
            for at in range(0, len(part), most):
                self._encode(part.slice(at, most).combine_chunks(), sql)

    def _encode(self, words: pa.Array, sql: str) -> None:
        raw = [w.encode() for w in words.to_pylist()]
        sizes = np.array([len(w) for w in raw])
        word = np.repeat(np.arange(sizes.size), sizes)
        pos = np.arange(word.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        slot = word << 32 | pos
        self.put("fresh", word=np.arange(sizes.size), text=words, bytes=pa.array(raw, pa.binary()))
        self.put("cut", word=word, slot=slot, id=self.first[np.frombuffer(b"".join(raw), np.uint8)], next=np.where(pos + 1 < sizes[word], slot + 1, -1))
        # A word that is a token is not cut.
        self.run("""CREATE OR REPLACE TABLE start AS
          WITH whole AS MATERIALIZED (SELECT f.word, v.id FROM fresh f JOIN vocabulary v USING (bytes))
          SELECT word, word << 32 AS slot, id, -1::BIGINT AS next FROM whole UNION ALL SELECT word, slot, id, next FROM cut ANTI JOIN whole USING (word)""")
        self.run(f"CREATE OR REPLACE TABLE tokens AS {sql}")
        self.run("""INSERT INTO known
          SELECT f.text, t.n, t.ids, decode(t.bytes) FROM fresh f JOIN (
            SELECT word, count(*) AS n, string_agg(id::VARCHAR, ' ' ORDER BY slot) AS ids, unhex(string_agg(hex(bytes), '' ORDER BY slot)) AS bytes
            FROM tokens JOIN vocabulary USING (id) GROUP BY word) t USING (word)""")

    def digests(self, texts: list[str | None]) -> pa.Table:
        """n_tokens, ids_sha256 and decoded_sha256 of each text, in order."""
        cut = [words_of(t) if t else [] for t in texts]
        coded = pa.array([w for words in cut for w in words], pa.string()).dictionary_encode()
        self.learn(coded.dictionary)
        sizes = np.array([len(words) for words in cut], np.int64)
        places = pa.table({"doc": np.repeat(np.arange(len(texts)), sizes), "pos": np.arange(int(sizes.sum())), "code": coded.indices})
        names = pa.table({"code": np.arange(len(coded.dictionary)), "word": coded.dictionary})
        docs = pa.table({"doc": np.arange(len(texts))})
        for name, rows in (("places", places), ("names", names), ("docs", docs)):
            self.con.register(name, rows)
        return self.con.sql("""
          WITH words AS MATERIALIZED (SELECT code, n, ids, decoded FROM names JOIN known USING (word)),
          whole AS (SELECT doc, sum(n)::BIGINT AS n, string_agg(ids, ' ' ORDER BY pos) AS ids, string_agg(decoded, '' ORDER BY pos) AS decoded FROM places JOIN words USING (code) GROUP BY doc)
          SELECT coalesce(n, 0) AS n_tokens, sha256(coalesce(ids, '')) AS ids_sha256, sha256(coalesce(decoded, '')) AS decoded_sha256
          FROM docs LEFT JOIN whole USING (doc) ORDER BY doc""").to_arrow_table()


@lru_cache(maxsize=1)
def _engine(path: str) -> Engine:
    return Engine(path)


def digests(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids of every whole text and of the bytes they decode to."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    fields = T.StructType.fromDDL("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    arrow = to_arrow_schema(fields)

    def run(batches: Batches) -> Batches:
        engine = _engine(ranks)
        ids: list[pa.Array] = []
        texts: list[str | None] = []

        def flush() -> pa.RecordBatch:
            found = engine.digests(texts)
            out = [pa.concat_arrays(ids), *[found.column(f.name).combine_chunks().cast(f.type) for f in arrow]]
            ids.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays(out, names=["doc_id", *arrow.names])

        chars = 0
        for batch in small_batches(batches):
            ids.append(batch.column(0))
            texts.extend(batch.column(1).to_pylist())
            chars += pc.sum(pc.binary_length(batch.column(1)), min_count=0).as_py()
            if chars >= BATCH_CHARS:
                yield flush()
                chars = 0
        if ids:
            yield flush()

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *fields]))


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids of every whole text."""
    def work(texts: list) -> dict:
        engine = _engine(ranks)
        cut = [words_of(t) if t else [] for t in texts]
        engine.learn(pa.array(list({w for words in cut for w in words}), pa.string()))
        ids = dict(engine.run("SELECT word, ids FROM known SEMI JOIN met USING (word)"))
        return {"ids": [[int(i) for w in words for i in ids[w].split()] for words in cut]}
    return map_texts(docs, lambda: work, "ids array<int>", id_col, text_col)


def decode(ids: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes): the bytes of id lists, by the same ordered aggregation; null for a null list."""
    def work(rows: list) -> dict:
        engine = _engine(ranks)
        sizes = np.array([len(x or ()) for x in rows], np.int64)
        engine.put("given", row=np.repeat(np.arange(len(rows)), sizes), pos=np.arange(int(sizes.sum())), id=np.array([i for x in rows for i in x or ()], np.int64))
        found = dict(engine.run("SELECT row, unhex(string_agg(hex(bytes), '' ORDER BY pos)) FROM given JOIN vocabulary USING (id) GROUP BY row"))
        return {"bytes": [None if x is None else found.get(k, b"") for k, x in enumerate(rows)]}
    return map_texts(ids, lambda: work, "bytes binary", id_col, ids_col)
