"""The thin queries op1..op13: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import warc
from scoreloom.llm.common import scratch
from scoreloom.llm.decontaminate import leaks
from scoreloom.llm.embedding_dedup import near_duplicates
from scoreloom.llm.fingerprints import fingerprints
from scoreloom.llm.infill import fill_in_middle, restore
from scoreloom.llm.jaccard_join import jaccard_components
from scoreloom.llm.licences import document_paths, licence_scan
from scoreloom.llm.mixing import SHARE, domain_of, mix, target_weights
from scoreloom.llm.quality import quality
from scoreloom.llm.token_counts import token_counts
from scoreloom.llm.tool_calls import TOOLS, from_conversations, tool_calls
from scoreloom.llm.toxicity import toxicity
from scoreloom.llm.whitening import whiten


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), k=4, t=85)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(read(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"
    )


OP6_SQL = """
WITH base AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), firsts AS (
  SELECT html, min(page_id) AS first FROM base WHERE n >= 100 GROUP BY html
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(base.html) AS payload_digest,
       CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to,
       CAST(NULL AS VARCHAR) AS problem
FROM base LEFT JOIN firsts ON base.html = firsts.html AND n >= 100
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mix(docs, domain_of(), SHARE, target_weights(spark)).select("doc_id", "domain", "lang", "source", "epoch", "tokens", "leaf_budget")


def _share_sql(nodes: str, parent: str) -> str:
    """SQL that shares the purse of each parent among its children, as the operator does."""
    return f"""
      SELECT *, CASE WHEN is_full THEN capacity
                     WHEN left_w > 0 THEN least(capacity, greatest(0.0, purse - spent) * weight / left_w) ELSE 0.0 END AS budget
      FROM (
        SELECT *, coalesce(sum(CASE WHEN is_full THEN capacity END) OVER (PARTITION BY {parent}), 0.0) AS spent,
               coalesce(sum(CASE WHEN NOT is_full THEN weight END) OVER (PARTITION BY {parent}), 0.0) AS left_w
        FROM (
          SELECT *, weight > 0 AND below + CASE WHEN above > 1e-12 THEN ratio * above ELSE 0.0 END <= purse + 1e-6 AS is_full
          FROM (
            SELECT *, sum(capacity) OVER w AS below, sum(weight) OVER (PARTITION BY {parent}) - sum(weight) OVER w AS above
            FROM (SELECT *, capacity / weight AS ratio FROM ({nodes}))
            WINDOW w AS (PARTITION BY {parent} ORDER BY ratio, capacity, name ROWS UNBOUNDED PRECEDING))))"""


_LANG_CASE = "CASE lang WHEN 'en' THEN 0.45 WHEN 'de' THEN 0.2 WHEN 'fr' THEN 0.2 WHEN 'es' THEN 0.15 ELSE 1.0 END"
_DOMAIN_CASE = "CASE domain WHEN 'web' THEN 0.5 WHEN 'books' THEN 0.3 WHEN 'code' THEN 0.15 ELSE 0.05 END"
_L1 = f"SELECT domain, domain AS name, sum(tokens) * 2.0 AS capacity, CAST({_DOMAIN_CASE} AS DOUBLE) AS weight, (SELECT total FROM purse) AS purse, 1 AS root FROM leaves GROUP BY domain"
_L2 = f"SELECT n.*, d.budget AS purse FROM (SELECT domain, lang, lang AS name, sum(tokens) * 2.0 AS capacity, CAST({_LANG_CASE} AS DOUBLE) AS weight FROM leaves GROUP BY domain, lang) n JOIN d ON n.domain = d.domain"
_L3 = "SELECT n.*, l.budget AS purse FROM (SELECT domain, lang, source, source AS name, tokens * 2.0 AS capacity, CAST(1.0 AS DOUBLE) AS weight FROM leaves) n JOIN l ON n.domain = l.domain AND n.lang = l.lang"
OP7_SQL = f"""
WITH base AS (
  SELECT doc_id, text, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS BIGINT) AS tokens,
         TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), '') AS BIGINT) AS no
  FROM documents
), rows AS (
  SELECT *, CASE WHEN no IS NULL THEN 'other' WHEN no % 3 = 0 THEN 'web' WHEN no % 3 = 1 THEN 'books' ELSE 'code' END AS domain FROM base
), leaves AS (
  SELECT domain, lang, source, CAST(sum(tokens) AS DOUBLE) AS tokens FROM rows GROUP BY domain, lang, source
), purse AS (
  SELECT 0.8 * sum(tokens) AS total FROM leaves
), d AS ({_share_sql(_L1, "root")}
), l AS ({_share_sql(_L2, "domain")}
), s AS ({_share_sql(_L3, "domain, lang")}
), turns AS (
  SELECT r.*, e.epoch, CAST('0x' || substr(md5('7:' || e.epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS o
  FROM rows r CROSS JOIN (SELECT unnest([1, 2]) AS epoch) e
), run AS (
  SELECT t.*, CAST(floor(s.budget + 1e-6) AS BIGINT) AS leaf_budget,
         sum(t.tokens) OVER (PARTITION BY t.domain, t.lang, t.source ORDER BY t.epoch, t.o, t.doc_id, t.text ROWS UNBOUNDED PRECEDING) AS running
  FROM turns t JOIN s ON t.domain = s.domain AND t.lang = s.lang AND t.source = s.source
)
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, tokens, leaf_budget FROM run WHERE running <= leaf_budget
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, uses = from_conversations(read(spark, sf_dir, "conversations"))
    tools = spark.createDataFrame(TOOLS, "name string, arg string, type string, required boolean")
    return tool_calls(calls, results, tools, uses).withColumn("problems", F.array_join("problems", "; "))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licence_scan(document_paths(read(spark, sf_dir, "documents")))
    return found.withColumn("own", F.array_join("own", "; "))


OP9_SQL = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, text, 't' || turn AS call_id, CASE WHEN length(coalesce(text, '')) > 250 THEN 'explain' ELSE 'ask' END AS name
  FROM conversations WHERE role = 'user'
), results AS (
  SELECT conv_id, 't' || (turn - 1) AS call_id, min(turn) AS result_turn, arg_min(text, turn) AS content, count(*) AS n_results
  FROM conversations WHERE role = 'assistant' GROUP BY ALL
), placed AS (
  SELECT c.conv_id, c.turn, CAST(0 AS BIGINT) AS depth FROM calls c
  WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL
  SELECT c.conv_id, c.turn, p.depth + 1 FROM calls c JOIN placed p ON p.conv_id = c.conv_id AND p.turn = c.turn - 2
)
SELECT c.conv_id, c.call_id, c.turn, c.name,
       CASE WHEN r.n_results IS NULL THEN 'unanswered' WHEN r.result_turn < c.turn THEN 'early' ELSE 'linked' END AS status,
       r.result_turn, CAST(coalesce(r.n_results, 0) AS BIGINT) AS n_results, p.depth,
       CASE WHEN c.name = 'explain' AND c.turn < 2 THEN 'missing: after' ELSE '' END AS problems,
       '{"arguments":{' || CASE WHEN c.turn >= 2 THEN '"after":"t' || (c.turn - 2) || '",' ELSE '' END
         || '"chars":' || length(c.text) || ',"query":' || CAST(to_json(c.text) AS VARCHAR) || ',"turn":' || c.turn
         || '},"id":"' || c.call_id || '","name":"' || c.name || '","result":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || '}' AS json
FROM calls c JOIN placed p ON p.conv_id = c.conv_id AND p.turn = c.turn
LEFT JOIN results r ON r.conv_id = c.conv_id AND r.call_id = c.call_id
"""


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = restore(fill_in_middle(read(spark, sf_dir, "documents")))
    digest = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


OP13_SQL = """
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM base
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:n], '') AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_warc": op6_warc,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_tool_calls": op9_tool_calls,
    "op10_licences": op10_licences,
    "op11_whitening": op11_whitening,
    "op12_fingerprints": op12_fingerprints,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES: dict[str, str] = {"op6_warc": OP6_SQL, "op7_mixing": OP7_SQL, "op9_tool_calls": OP9_SQL, "op13_fill_in_middle": OP13_SQL}
