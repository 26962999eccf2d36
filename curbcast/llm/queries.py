"""Registered queries of the operators: thin calls with production parameters."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..checkpoints import stage_path
from . import bpe, decontaminate, language, licenses, ngram_join, relational_bpe, repair, secrets, spelling, suffix_dedup, token_file, toxicity, vectors
from .common import crc_part, table

END_ID = 2


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "token-file")
    token_file.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_file.read_token_files(spark, path)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(docs))
    return found.select("doc_id", F.coalesce(crc_part("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vocabulary = table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digests(docs, vocabulary, bpe.build_lexicon(docs, vocabulary))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).withColumn("has_repeats", (F.col("n_removed") > 0).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(crc_part("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
                                              (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.node AS vec_id, coalesce(n.n, 0) AS n_links, c.root AS component_id, c.node = c.root AS kept FROM c LEFT JOIN n ON n.a = c.node
"""


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id.txt``."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    found = licenses.scan(docs.select(path.alias("path"), "text"))
    return found.select(F.regexp_extract("path", "([^/]*)[.]txt$", 1).cast("bigint").alias("doc_id"), "path", "license", "cosine", "own", "from_dir")


def op10_sql() -> str:
    weights, idf, other = licenses.template_weights()
    text = lambda rows: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows)
    return f"""
WITH template(template, license, word, weight) AS (VALUES {text(weights)}),
frequency(word, idf) AS (VALUES {text(sorted(idf.items()))}),
files AS (SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS dir, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id || '.txt' AS path, text FROM documents),
lines AS (SELECT path, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM files WHERE regexp_matches(text, '{licenses.TRIGGER}')),
numbered AS (SELECT path, unnest(parts) AS line, unnest(range(len(parts))) AS unit FROM lines),
units AS (SELECT * FROM numbered WHERE regexp_matches(line, '{licenses.TRIGGER}')),
words AS (SELECT path, unit, word, count(*) AS n FROM (SELECT path, unit, unnest(regexp_extract_all(lower(line), '{licenses.WORD}')) AS word FROM units) GROUP BY ALL),
valued AS (SELECT path, unit, word, n * CAST(coalesce(idf, {other!r}) AS DOUBLE) AS value FROM words LEFT JOIN frequency USING (word)),
lengths AS (SELECT path, unit, sqrt(sum(value * value)) AS length FROM valued GROUP BY ALL),
met AS (SELECT path, unit, template, license, sum(value * CAST(weight AS DOUBLE)) AS dot FROM valued JOIN template USING (word) GROUP BY ALL),
scored AS (SELECT path, unit, license, max(round(dot / length, 6)) AS cosine FROM met JOIN lengths USING (path, unit) WHERE round(dot / length, 6) >= {licenses.LEAST_COSINE} GROUP BY ALL),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY path, unit ORDER BY cosine DESC, license) = 1),
own AS (SELECT path, license, cosine FROM best QUALIFY row_number() OVER (PARTITION BY path ORDER BY cosine DESC, unit, license) = 1),
noted AS (SELECT path, sum(length(regexp_replace(line, '[^\\p{{L}}\\p{{N}}]', '', 'g'))) AS letters FROM units GROUP BY path),
heads AS (SELECT f.dir, o.license, count(*) AS n FROM own o JOIN files f USING (path) JOIN noted USING (path) WHERE noted.letters / length(regexp_replace(f.text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= {licenses.LEAST_SHARE} GROUP BY ALL),
speaking AS (SELECT dir, license FROM heads QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, license) = 1)
SELECT f.doc_id, f.path, coalesce(o.license, s.license) AS license, o.cosine, o.license IS NOT NULL AS own, CASE WHEN o.license IS NULL THEN s.dir END AS from_dir
FROM files f LEFT JOIN own o USING (path) LEFT JOIN speaking s ON s.dir = f.dir
"""


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_relational_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


# crc32 of a text over its UTF-8 bytes, by the table of the reflected polynomial.
CRC_SQL = """
crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256))::BIGINT AS i)))"""


def crc_sql(text: str) -> str:
    """SQL of the crc32 of a VARCHAR expression, with ``crc_table`` in scope."""
    data = f"list_transform(range(0, strlen({text})), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {data}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


OP11_SQL = f"""
WITH RECURSIVE {CRC_SQL},
hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS hit FROM conversations, crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM hit, unnest(CASE WHEN hit = 0 THEN []::INT[] WHEN hit = 3 THEN [1, 2] ELSE [1] END)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
trimmed AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS time FROM numbered),
faulty AS (SELECT *, CASE WHEN core = '' THEN 'b' WHEN time > 1 THEN 'd' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault, left(role, 1) AS initial FROM trimmed),
moves(q, inserted, q2) AS (VALUES ('', '', ''), ('s', '', 's'), ('u', '', 'u'), ('a', '', 'a'), ('', 'I', 'u'), ('s', 'I', 'u'), ('u', 'I', 'a'), ('a', 'I', 'u'), ('', 'II', 'a'), ('s', 'II', 'a'), ('u', 'II', 'u'), ('a', 'II', 'a')),
kept(q, initial) AS (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
edits AS (
  SELECT m.q, m.inserted || 'D' AS letters, 2 * len(m.inserted) + 3 AS cost, m.q2 AS after, NULL::VARCHAR AS initial FROM moves m UNION ALL
  SELECT m.q, m.inserted || 'R', 2 * len(m.inserted) + 2, CASE m.q2 WHEN 'u' THEN 'a' ELSE 'u' END, NULL::VARCHAR FROM moves m UNION ALL
  SELECT m.q, m.inserted || 'K', 2 * len(m.inserted), k.initial, k.initial FROM moves m JOIN kept k ON k.q = m.q2),
ways(conv_id, i, q, way) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '', '0000000' FROM conversations UNION ALL
  SELECT w.conv_id, f.i, e.after, min(printf('%07d', left(w.way, 7)::INT + e.cost + CASE WHEN f.fault = 't' AND right(e.letters, 1) <> 'D' THEN 1 ELSE 0 END) || substr(w.way, 8) || e.letters)
  FROM ways w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN edits e ON e.q = w.q AND (e.initial IS NULL OR e.initial = f.initial)
  WHERE f.fault NOT IN ('b', 'd') OR right(e.letters, 1) = 'D' GROUP BY w.conv_id, f.i, e.after),
counts AS (SELECT conv_id, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated FROM faulty GROUP BY conv_id),
pairs AS (SELECT conv_id, initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM faulty),
illegal AS (SELECT conv_id, count(*) AS illegal FROM pairs WHERE pair NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
best AS (SELECT w.conv_id, min(printf('%07d', left(w.way, 7)::INT + 2 * len(m.inserted)) || substr(w.way, 8) || m.inserted) AS way
  FROM ways w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id JOIN moves m ON m.q = w.q WHERE w.i = coalesce(c.n, 0) AND m.q2 IN ('', 'a') GROUP BY w.conv_id),
letters AS (SELECT conv_id, unnest(range(8, len(way) + 1)) AS spot, way FROM best),
placed AS (SELECT conv_id, spot, substr(way, spot, 1) AS letter, count(*) FILTER (substr(way, spot, 1) <> 'I') OVER (PARTITION BY conv_id ORDER BY spot) AS i FROM letters),
output AS (SELECT p.conv_id, p.spot, p.letter, f.role, f.text, row_number() OVER (PARTITION BY p.conv_id ORDER BY p.spot) AS place
  FROM placed p LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i WHERE p.letter <> 'D'),
lead_role AS (SELECT conv_id, max(CASE WHEN place = 1 AND letter = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) AS s FROM output GROUP BY conv_id),
repaired AS (SELECT o.conv_id, string_agg(CASE WHEN letter = 'K' THEN role ELSE CASE WHEN (place - s) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY spot) AS whole
  FROM output o JOIN lead_role l ON l.conv_id IS NOT DISTINCT FROM o.conv_id GROUP BY o.conv_id)
SELECT b.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(i.illegal, 0) AS illegal,
  left(b.way, 7)::BIGINT AS cost, substr(b.way, 8) AS audit, sha256(coalesce(r.whole, '')) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN illegal i ON i.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM b.conv_id
"""


OP12_SQL = f"""
WITH RECURSIVE {CRC_SQL},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
hashed AS (SELECT run, times, {crc_sql("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM (SELECT doc_id, run, count(*) AS times FROM runs GROUP BY ALL), crc_table),
damaged AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM damaged WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {spelling.LEAST_COUNT}),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
masks AS (SELECT word, i, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS mask FROM places),
shorter AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM places),
dropped AS (SELECT s.word, w.word AS near FROM shorter s JOIN words w ON w.word = s.less),
pairs AS (SELECT a.word, b.word AS near FROM masks a JOIN masks b ON a.mask = b.mask AND a.word <> b.word UNION ALL SELECT word, near FROM dropped UNION ALL SELECT near, word FROM dropped),
ranked AS (SELECT p.word, p.near, m.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY m.n DESC, p.near) AS place FROM pairs p JOIN words m ON m.word = p.near),
forms AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 2 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 2 * w.n THEN r.near_n END AS form_n FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
follow(word, spot) AS (SELECT word, word FROM words UNION ALL SELECT f.word, n.form FROM follow f JOIN forms n ON n.word = f.spot WHERE n.form IS NOT NULL),
ends AS (SELECT f.word, f.spot AS root FROM follow f JOIN forms n ON n.word = f.spot WHERE n.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e USING (word)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn) and not name.endswith("_sql")}


def oracles() -> dict[str, str]:
    return {"op6_vector_duplicates": OP6_SQL, "op10_license_scan": op10_sql(), "op11_repair": OP11_SQL, "op12_spelling": OP12_SQL}
