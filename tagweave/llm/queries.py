"""The queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprints, langid, media, mixing, packing, passages, simhash, substrings, urls
from .common import table


#: (host, path's start, verdict)
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(table(spark, sf_dir, "documents"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.grouped(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~held))
    return langid.identify(docs.select("doc_id", "text", held.alias("held_out")), model, keep_text=False).select("doc_id", "held_out", "lang_pred", "score")


def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_duplicates(table(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_records(chat.gather(rows.unionByName(extra))))


def url_sql() -> str:
    """The rules, the two models order by order, and the verdicts."""
    fit = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(URL_RULES, key=lambda r: -len(r[0] + r[1])))
    said = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in URL_RULES)
    steps, last = [], "w"
    for k in range(1, urls.ORDER + 1):
        steps.append(f"n{k} AS (SELECT substr(gram, {urls.ORDER + 1 - k}) AS tail, sum(a) AS a, sum(b) AS b FROM c GROUP BY tail)")
        steps.append(f"x{k} AS (SELECT substr(tail, 1, {k - 1}) AS context, sum(a) AS na, count(*) FILTER (a > 0) AS ta, sum(b) AS nb, count(*) FILTER (b > 0) AS tb FROM n{k} GROUP BY context)")
        one = lambda m: f"CASE WHEN coalesce(n{m}, 0) > 0 THEN (coalesce({m}, 0) + t{m} * p{m}) / (n{m} + t{m}) ELSE p{m} END"
        steps.append(f"p{k} AS (SELECT gram, {one('a')} AS pa, {one('b')} AS pb FROM {last} LEFT JOIN n{k} ON tail = substr(gram, {urls.ORDER + 1 - k}) LEFT JOIN x{k} ON context = substr(gram, {urls.ORDER + 1 - k}, {k - 1}))")
        last = f"p{k}"
    held = ", ".join(f"'{x}'" for x in urls.HELD)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (SELECT *, CASE {fit} END AS rule, host || path AS text FROM h),
v AS (SELECT *, CASE rule {said} END AS said FROM r),
t AS (SELECT text, any_value(said) AS said, count(*) AS n, md5(text)[1] IN ({held}) AS held FROM v GROUP BY text),
g AS (SELECT text, said, n, held, substr(repeat(chr(2), {urls.ORDER - 1}) || text || chr(3), i::INT, {urls.ORDER}) AS gram FROM (SELECT *, unnest(range(1, length(text) + 2)) AS i FROM t)),
c AS (SELECT gram, sum(CASE WHEN said = 'allow' THEN n ELSE 0 END) AS a, sum(CASE WHEN said = 'block' THEN n ELSE 0 END) AS b FROM g WHERE said IS NOT NULL AND NOT held GROUP BY gram),
w AS (SELECT DISTINCT gram, {1.0 / urls.ALPHABET}::DOUBLE AS pa, {1.0 / urls.ALPHABET}::DOUBLE AS pb FROM g WHERE said IS NULL OR held),
{", ".join(steps)},
s AS (SELECT text, any_value(said) AS said, avg(ln(pa) - ln(pb)) AS score FROM g JOIN {last} USING (gram) WHERE said IS NULL OR held GROUP BY text),
m AS (SELECT avg(score) FILTER (said = 'allow') AS a, stddev_pop(score) FILTER (said = 'allow') AS da, avg(score) FILTER (said = 'block') AS b, stddev_pop(score) FILTER (said = 'block') AS db FROM s),
e AS (SELECT CASE WHEN a IS NULL OR b IS NULL THEN 0 WHEN da + db > 0 THEN (a * db + b * da) / (da + db) ELSE (a + b) / 2 END AS edge FROM m)
SELECT page_id, host, path, rule, coalesce(v.said, CASE WHEN score >= (SELECT edge FROM e) THEN 'allow' ELSE 'block' END) AS verdict
FROM v LEFT JOIN s ON v.text = s.text"""


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_url_filters": op4_url_filters,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_language_id": op7_language_id,
    "op8_passage_dedup": op8_passage_dedup,
    "op9_media_columns": op9_media_columns,
    "op10_chat_formatting": op10_chat_formatting,
}

ORACLE_SQL = {
    "op4_url_filters": url_sql(),
    "op6_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat('mix:', coalesce(doc_id::VARCHAR, 'null'))) AS k
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s0),
s2 AS (
  SELECT *, source_size::DOUBLE / w AS ratio, sum(source_size) OVER () AS total, sum(w) OVER () AS weights FROM s1),
s3 AS (
  SELECT *,
    coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sizes_before,
    coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights_before
  FROM s2),
s4 AS (SELECT *, (total::DOUBLE * 1.5::DOUBLE - sizes_before::DOUBLE * 2.0::DOUBLE) / (weights - weights_before)::DOUBLE AS level FROM s3),
lv AS (SELECT level AS water FROM s4 WHERE level <= ratio * 2.0::DOUBLE ORDER BY ratio, source NULLS LAST LIMIT 1),
s5 AS (
  SELECT source, source_size,
    least(source_size::DOUBLE * 2.0::DOUBLE, coalesce((SELECT water FROM lv) * w, source_size::DOUBLE * 2.0::DOUBLE)) AS target
  FROM s4),
s6 AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM s5),
s7 AS (SELECT *, CASE WHEN source_size > 0 THEN round(target - whole * source_size) ELSE 0 END::BIGINT AS extra FROM s6),
r AS (
  SELECT d.doc_id, d.size, s7.source_size, s7.target, s7.whole, s7.extra,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, extra - before)))::BIGINT AS taken FROM r
""",
    "op10_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(text, '[\\<>\[\]]', 'xx', 'g')) +
    CASE role WHEN 'user' THEN 22 WHEN 'assistant' THEN 20 WHEN 'system' THEN 20
      ELSE 24 + length(regexp_replace(role, '[\\<>\[\]]', 'xx', 'g')) END AS n
  FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars, 'rows' AS layout
FROM e GROUP BY conv_id
""",
}
