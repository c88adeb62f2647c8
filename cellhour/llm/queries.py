"""One query for each operator, over the whole of its table, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, decontaminate, hard_negatives, packing, periodic_runs, pii, prob_minhash, quality, substring_dedup,
               suffix_dedup, topk, toxicity, warc)

VOCABULARY = "word_bpe_49k.json"
CAPTURED = "2024-01-01T00:00:00Z"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "n_shingles", "n_found")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.classes(table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.formatted(chat.in_layouts(chat.by_conversation(rows))))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages"), CAPTURED))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return done.select("doc_id", "held_out", "score", "predicted", F.col("neighbours.doc_id").alias("evidence"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return done.select("doc_id", "held_out", "score", "predicted")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *[pii.count_of(kind).alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(pii.listed(pii.base_spans()), 256).alias("base_sha256"), pii.listed("found").alias("spans"))


def made_periodic(docs: DataFrame) -> DataFrame:
    """In one document of ten, by a checksum of doc_id, the words from some place on repeat with one period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.greatest(F.size("words"), F.lit(1)).cast("long")
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p")))
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.size("words").cast("long") - 1),
                        lambda i: F.get("words", source(i).cast("int")))
    return (docs.withColumn("words", F.when(F.pmod(h, F.lit(10)) == 0, words)).withColumns({"a": a, "p": p})
            .withColumn("text", F.when(F.size("words") > 0, F.array_join(again, " ")).otherwise(F.col("text")))
            .drop("words", "a", "p"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = made_periodic(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.find(docs).withColumn("best", periodic_runs.strongest())
    said = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]),
                                                  F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(said, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, "vec_id % 100 = 0")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_decontamination, op2_suffix_array_dedup, op3_exact_topk, op4_substring_dedup, op5_minhash_near_dedup,
        op6_chat_formatting, op7_warc_derivatives, op8_packing, op9_toxicity, op10_quality, op11_pii, op12_periodic_runs,
        op13_hard_negatives)}

SQL: dict[str, str] = {}

SQL["op1_decontamination"] = r"""
WITH shingled AS (
  SELECT 'd' AS kind, doc_id AS id, text, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL UNION ALL
  SELECT 'i', item_id, text, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark
  WHERE item_id IS NOT NULL),
s AS (SELECT DISTINCT kind, id, text, unnest(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' '))) AS s
  FROM shingled WHERE len(w) >= 5),
n AS (SELECT id AS item_id, text AS item, count(*) AS n_shingles FROM s WHERE kind = 'i' GROUP BY 1, 2),
f AS (SELECT d.id AS doc_id, d.text AS body, i.id AS item_id, i.text AS item, count(*) AS n_found FROM s d JOIN s i ON d.s = i.s
  WHERE d.kind = 'd' AND i.kind = 'i' GROUP BY 1, 2, 3, 4)
SELECT doc_id, item_id, n_shingles, n_found FROM f JOIN n USING (item_id, item) WHERE n_found >= n_shingles * 0.8 - 1e-9
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_found / n_shingles DESC, n_shingles DESC) = 1
"""

SQL["op3_exact_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS "rank",
  vec_id, score FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""

SQL["op13_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS "rank"
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, "rank", negative_id, positive_score, negative_score FROM n WHERE "rank" <= 5
"""

_CONTROL = ["<|", "</s>", "<s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
_EXTRA = " + ".join(["(length({c}) - length(replace({c}, '\\', '')))"] + [
    f"(length({{c}}) - length(replace({{c}}, '{m}', ''))) // {len(m)}" for m in _CONTROL])
SQL["op6_chat_formatting"] = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT *, length(role) + length(text) + {len(chat.TURN) + len(chat.END) + 1}
  + {_EXTRA.format(c='role')} + {_EXTRA.format(c='text')} AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id
"""


_ENTITY_SQL = "&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
_NAMES_SQL = ("['" + "', '".join(f"&{n};" for n in warc.NAMED) + "']", "['" + "', '".join(
    " " if v == "\u00a0" else v.replace("'", "''") for v in warc.NAMED.values()) + "']")


def _sign_sql(e: str) -> str:
    """What an entity stands for; itself if nothing."""
    code = f"""CASE WHEN {e}[3] IN ('x', 'X') THEN CAST('0x' || {e}[4:-2] AS BIGINT) ELSE CAST({e}[3:-2] AS BIGINT) END"""
    return (f"CASE WHEN {e}[2] <> '#' THEN coalesce({_NAMES_SQL[1]}[list_position({_NAMES_SQL[0]}, {e})], {e}) "
            f"WHEN {code} = 160 THEN ' ' WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 "
            f"THEN chr(CAST({code} AS INT)) ELSE {e} END")


def _plain_sql(html: str) -> str:
    """Comments, scripts and styles first, then line breaks, tags, entities and white space."""
    html = (f"regexp_replace({html}, '(?is)<!--.*?(?:-->|\\z)|<script\\b.*?(?:</script\\s*>|\\z)|<style\\b.*?(?:</style\\s*>|\\z)', ' ', 'g')")
    html = f"regexp_replace({html}, '(?i)<(?:br|/p|/h[1-6]|/li|/div|/article|/tr|/title)\\b[^>]*>', chr(10), 'g')"
    html = f"regexp_replace({html}, '(?s)<[^>]*>', ' ', 'g')"
    parts = f"list_zip(string_split_regex({html}, '{_ENTITY_SQL}'), regexp_extract_all({html}, '{_ENTITY_SQL}'))"
    html = f"array_to_string(list_transform({parts}, lambda t: coalesce(t[1], '') || coalesce({_sign_sql('t[2]')}, '')), '')"
    html = f"regexp_replace(regexp_replace({html}, '[ \\t\\r]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g')"
    return f"regexp_replace({html}, '^[ \\n]+|[ \\n]+$', '', 'g')"


_URL_SQL = """array_to_string(list_transform(string_split(coalesce(url, ''), ''),
  lambda c: CASE WHEN c <> '' AND (ord(c) < 32 OR ord(c) = 127) THEN printf('%%%02X', ord(c)) ELSE c END), '')"""


def _id_sql(*parts: str) -> str:
    h = f"sha256({' || chr(10) || '.join(parts)})"
    return (f"('<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-a' || "
            f"substr({h}, 18, 3) || '-' || substr({h}, 21, 12) || '>')")


SQL["op7_warc_derivatives"] = f"""
WITH p AS (SELECT page_id, {_URL_SQL} AS url, coalesce(html, '') AS body FROM pages),
r AS (SELECT *, {_id_sql("'response'", 'CAST(page_id AS VARCHAR)', 'url', 'sha256(body)')} AS record_id,
  'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
  || 'Content-Length: ' || strlen(body) || chr(13) || chr(10) AS headers, 'sha256:' || sha256(body) AS payload FROM p),
m AS (SELECT page_id, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
  'sourceDigest: ' || payload || chr(13) || chr(10) || 'sourceLength: ' || strlen(body) || chr(13) || chr(10) || headers AS block,
  record_id, url, headers, payload FROM r UNION ALL
  SELECT page_id, 'conversion', 'text/plain', {_plain_sql('body')}, record_id, url, headers, payload FROM r)
SELECT page_id, warc_type, {_id_sql('warc_type', 'record_id', 'sha256(block)')} AS warc_record_id,
  record_id AS warc_refers_to, url AS target_uri, '{CAPTURED}' AS "date", content_type, headers AS source_headers, payload AS source_digest,
  'sha256:' || sha256(block) AS block_digest, strlen(block) AS content_length, block FROM m
"""
