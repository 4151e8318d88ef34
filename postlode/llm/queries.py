"""The operators of this package as queries over whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, fingerprints, licenses, line_dedup, masked_lm, mixing, near_dedup, neighbours, pii, quality, resampling, spelling, warc

TOKENIZER = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf, "documents"))


def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf, "labels")))


def op3_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op4_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


def op5_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.report(table(spark, sf, "documents"))


def op6_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.search(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.report(table(spark, sf, "documents"))


def op9_masked_lm(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return masked_lm.score_documents(docs, masked_lm.fit_masked_lm(docs))


def op10_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return pii.report(docs, pii.fit_pii(docs))


def op11_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.draw(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op12_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf, "documents"))


def op13_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = line_dedup.deduplicate(table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_fingerprints, op2_quality, op3_byte_bpe, op4_licenses, op5_near_dedup, op6_warc, op7_neighbours, op8_mixing, op9_masked_lm, op10_pii, op11_resampling, op12_spelling, op13_line_dedup, pipeline)
    return {f.__name__: f for f in own}


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' ')) END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)
"""

OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS lead FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, 1 + 5 * CAST(floor(i / 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM d
"""


def _crc32(text: str) -> str:
    """SQL of the unsigned crc32 of a string's UTF-8 bytes, with the table built by its rule."""
    hexed = f"hex(encode({text}))"
    of_bytes = f"list_transform(range(0, len({hexed}) // 2), lambda j: CAST('0x' || substr({hexed}, CAST(2 * j + 1 AS INT), 2) AS BIGINT))"
    table_ = ", ".join(map(str, resampling._CRC.tolist()))
    return f"xor(list_reduce({of_bytes}, lambda c, b: xor(c >> 8, list_extract(CAST([{table_}] AS BIGINT[]), CAST((xor(c, b) & 255) + 1 AS INT))), 4294967295::BIGINT), 4294967295::BIGINT)"


OP11_SQL = rf"""
WITH texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark),
words AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
counted AS (SELECT side, id, f, count(*) AS n FROM features GROUP BY ALL),
buckets AS (SELECT f, {_crc32('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted)),
placed AS (SELECT side, id, bucket, n FROM counted JOIN buckets USING (f)),
held AS (SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM placed GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (coalesce(sum(s) OVER (), 0) + 10000) AS DOUBLE)
  / CAST((coalesce(s, 0) + 1) * (coalesce(sum(t) OVER (), 0) + 10000) AS DOUBLE))) AS gain FROM held),
weights AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (SELECT id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS fit,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (id) WHERE side = 'd'),
ordered AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY fit) AS total FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND r <= 25 * total // 100 THEN r END AS rank FROM ordered
"""

OP12_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32("doc_id || ':' || run")} AS h FROM counted),
slipped AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, i, substr(word, 1, CAST(i - 1 AS INT)) || substr(word, CAST(i + 1 AS INT)) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, v.word FROM cuts c JOIN v ON c.rest = v.word
  UNION SELECT v.word, c.word FROM cuts c JOIN v ON c.rest = v.word),
best AS (SELECT near.word, count(*) AS n_near, first(o.word ORDER BY o.n DESC, o.word) AS form, max(o.n) AS form_n FROM near JOIN v o ON o.word = near.other GROUP BY near.word),
forms AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS last FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.last WHERE forms.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, walk.last AS root FROM forms f JOIN walk USING (word) JOIN forms e ON e.word = walk.last WHERE e.form IS NULL
"""

OP13_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, list_extract(l, i) AS line,
    trim(translate(list_extract(l, i), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
held AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT doc_id, i, line, coalesce(doc_id > first, false) AS dropped FROM lines LEFT JOIN held USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_near_dedup": OP5_SQL, "op6_warc": OP6_SQL, "op11_resampling": OP11_SQL, "op12_spelling": OP12_SQL, "op13_line_dedup": OP13_SQL}
