"""The queries ``opN_<name>`` over the driver's tables, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simgraph.llm import bpe, chat, decontam, mlm, repeats, resample, ring, rules, simhash, urls

#: The rules that op10 judges by: action, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
SHARDS = 40
#: Rows that op3 draws, as a part of those that are good by the labels.
KEPT_SHARE = 0.95


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, item_id, share, n_items of every document."""
    return decontam.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_suffix_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op2: what is left of each text without its repeated 200-byte strings."""
    found = repeats.remove_repeats(_table(spark, sf_dir, "documents"), 200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_grams, log_weight, score, kept of every document; the target is label quality = 1.

    KEPT_SHARE of as many rows as are good by the labels are drawn, so noise decides among those near the end.
    """
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), share=KEPT_SHARE)


def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, part, speaker, n_messages, rendered and masks (start:end, joined by ;)."""
    found = chat.perspectives(_table(spark, sf_dir, "conversations"))
    return found.withColumn("masks", F.array_join(F.transform("masks", lambda m: F.concat(m.start, F.lit(":"), m.end)), ";"))


def op5_ngram_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op5; quality is the calibrated probability of label quality = 1."""
    docs = _table(spark, sf_dir, "documents")
    rows = rules.labelled_sample(docs, _table(spark, sf_dir, "labels"), "quality", rules.LABELLED)
    return rules.judge(docs, rules.fit([r[1] for r in rows], [r[2] for r in rows]))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op5 without its model, which SQL can express."""
    docs = _table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.fit([], [])).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op6_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op6 under the law ``rows``: shards' counts are at most one apart."""
    found = ring.bounded_ring(_table(spark, sf_dir, "documents"), SHARDS)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op7: digests of the ids and of the bytes that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    back = bpe.decode(ids, path)
    return back.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op8: doc_id, fingerprint (16 hex digits), component_id."""
    found = simhash.near_groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob and net_log_prob of every document under a model of all of them."""
    docs = _table(spark, sf_dir, "documents")
    return mlm.score(docs, mlm.train(docs))


def op10_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op10: page_id, host, path, rule, verdict. Pages that no rule lists are allowed."""
    return urls.url_verdicts(_table(spark, sf_dir, "pages"), URL_RULES)


QUERIES = {
    "op1_template_windows": op1_template_windows,
    "op2_suffix_cover": op2_suffix_cover,
    "op3_importance_resampling": op3_importance_resampling,
    "op4_perspectives": op4_perspectives,
    "op5_ngram_rules": op5_ngram_rules,
    "op6_bounded_ring": op6_bounded_ring,
    "op7_segment_tree_bpe": op7_segment_tree_bpe,
    "op8_simhash_bk": op8_simhash_bk,
    "op9_pseudo_likelihood": op9_pseudo_likelihood,
    "op10_bloom_cascade": op10_bloom_cascade,
    "quality_base_counts": quality_base_counts,
}

_URL_PARTS = """
parts AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM parts),
urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM split)"""

_STRIP = r"'^[.!?\n][^\p{L}\p{N}]*'"
_TEMPLATE = f"""list_transform(raw, lambda x, i: CASE
  WHEN x[1] BETWEEN '0' AND '9' THEN '0'
  WHEN x[1] IN ('.', '!', '?', chr(10)) THEN CASE WHEN regexp_replace(lower(x), {_STRIP}, '')[1] BETWEEN '0' AND '9' THEN '0' ELSE regexp_replace(lower(x), {_STRIP}, '') END
  WHEN i > 1 AND raw[i - 1][-1] BETWEEN '0' AND '9' AND lower(x) IN ({", ".join(f"'{u}'" for u in decontam.UNITS)}) THEN 'U'
  WHEN i > 1 AND x[1] <> lower(x[1]) AND x[2] <> upper(x[2]) THEN 'N'
  ELSE lower(x) END)"""


def _bare_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), {_STRIP}, ''), '[.,]+$', '')"


def _windows_sql(name: str, key: str, table: str) -> str:
    token = decontam.TOKEN.replace("'", "''")
    return f"""
{name}_raw AS (SELECT {key} AS k, regexp_extract_all(text, '{token}') AS raw FROM {table} WHERE text IS NOT NULL),
{name}_t AS (SELECT k, raw, {_TEMPLATE} AS t FROM {name}_raw),
{name}_w AS (
  SELECT k, raw, t, i, array_to_string(t[i:i + 4], ' ') AS w FROM (SELECT *, unnest(range(1, len(t) - 3)) AS i FROM {name}_t WHERE len(t) >= 5)
  UNION ALL SELECT k, raw, t, 1, 'short: ' || array_to_string(t, ' ') FROM {name}_t WHERE len(t) BETWEEN 1 AND 4)"""


ORACLES: dict[str, str] = {
    "op1_template_windows": f"""
WITH {_windows_sql("d", "doc_id", "documents")},{_windows_sql("b", "item_id", "benchmark")},
need AS (SELECT k AS item, count(*) AS need FROM b_w GROUP BY k),
hits AS (SELECT d.k, b.k AS item, b.i AS q, d.i - b.i AS diag, d.raw AS draw, b.raw AS braw, b.t AS bt FROM d_w d JOIN b_w b USING (w)),
slots AS (
  SELECT k, item, diag, q, CASE WHEN bt[q + j] IN ('0', 'N', 'U') THEN {_bare_sql("braw[q + j]")} END AS v,
         CASE WHEN bt[q + j] IN ('0', 'N', 'U') THEN {_bare_sql("draw[q + diag + j]")} END AS w
  FROM hits, range(0, 5) AS r(j)),
lines AS (
  SELECT k, item, diag, list(DISTINCT q) AS qs FROM slots GROUP BY k, item, diag
  HAVING count(DISTINCT v) = count(DISTINCT v || chr(1) || w)),
found AS (SELECT k, item, count(DISTINCT q) AS n FROM (SELECT k, item, unnest(qs) AS q FROM lines) GROUP BY k, item),
kept AS (
  SELECT k, item, n / need::DOUBLE AS share, count(*) OVER (PARTITION BY k) AS n_items,
         row_number() OVER (PARTITION BY k ORDER BY n / need::DOUBLE DESC, item) AS best
  FROM found JOIN need USING (item) WHERE n >= {decontam.SHARE}::DOUBLE * need)
SELECT doc_id, k IS NOT NULL AS contaminated, item AS item_id, share, coalesce(n_items, 0)::BIGINT AS n_items
FROM documents LEFT JOIN kept ON k = doc_id AND best = 1""",
    "op4_perspectives": f"""
WITH m AS (
  SELECT conv_id, coalesce(turn, 0) AS turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role,
         replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) // {chat.PART} AS part FROM m),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM m WHERE role <> 'system'),
parts AS (
  SELECT s.conv_id, n.part, s.speaker, n.turn, n.role, n.text, n.role = s.speaker AS own,
         CASE WHEN n.role = 'system' THEN '<|system|>' WHEN n.role = s.speaker THEN '<|assistant|>'
              ELSE '<|user name=' || n.role || '|>' END || chr(10) AS head
  FROM speakers s JOIN n ON n.conv_id = s.conv_id),
placed AS (
  SELECT *, sum(length(head) + length(text) + 1) OVER (PARTITION BY conv_id, part, speaker ORDER BY turn, role, text
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS last
  FROM parts)
SELECT conv_id, part, speaker, count(*) AS n_messages,
       string_agg(head || text || chr(10), '' ORDER BY turn, role, text) AS rendered,
       coalesce(string_agg(CAST(last - length(text) AS BIGINT) || ':' || CAST(last AS BIGINT), ';' ORDER BY turn, role, text)
                FILTER (WHERE own), '') AS masks
FROM placed GROUP BY conv_id, part, speaker""",
    "quality_base_counts": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
runs AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 8) AS r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
       len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
       len(ws) < 20 OR 100 * coalesce(covered.n, 0) > 30 * len(ws) AS base_failed
FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)""",
    "op10_bloom_cascade": f"""
WITH {_URL_PARTS},
rules(action, h, p) AS (VALUES {", ".join(map(str, URL_RULES))}),
fits AS (
  SELECT u.page_id, u.host, u.path, h || p AS rule, action,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(h || p) DESC) AS k
  FROM urls u JOIN rules ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON f.page_id = u.page_id AND f.k = 1""",
}
