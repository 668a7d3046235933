"""The registered queries of this subpackage, each over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import license_scan, toxicity
from tessera.llm.bpe import encode_decode
from tessera.llm.common import read
from tessera.llm.decontamination import find_items
from tessera.llm.html_text import extract
from tessera.llm.lm_scoring import backoff_scores
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.nearest import nearest
from tessera.llm.substring_dedup import remove_repeats
from tessera.llm.token_counts import token_counts


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backoff_scores(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("score", 4).alias("score"))


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT r, p, w[p] AS c, CASE WHEN p > 1 THEN w[p - 1] END AS b, CASE WHEN p > 2 THEN w[p - 2] END AS a, len(w) AS own FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
k AS (SELECT r, p, (SELECT sum(len(w)) FROM d) - own AS n,
             count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY r, c) AS c1,
             count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY r, b, c) AS c2,
             count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY r, a, b, c) AS c3 FROM t),
b AS (SELECT *, lag(c1) OVER (PARTITION BY r ORDER BY p) AS b1, lag(c2) OVER (PARTITION BY r ORDER BY p) AS b2 FROM k),
s1 AS (SELECT *, CASE WHEN c1 > 0 THEN ln(c1 / n) ELSE -ln(n + 1) END AS s FROM b),
s2 AS (SELECT * REPLACE (CASE WHEN p < 2 THEN s WHEN c2 > 0 THEN ln(c2 / b1) ELSE ln(0.4) + s END AS s) FROM s1),
s3 AS (SELECT r, sum(CASE WHEN p < 3 THEN s WHEN c3 > 0 THEN ln(c3 / b2) ELSE ln(0.4) + s END) AS score FROM s2 GROUP BY r)
SELECT d.doc_id, len(w) AS n_words, round(coalesce(score, 0), 4) AS score FROM d LEFT JOIN s3 USING (r)
"""


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "is_first")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_runs", "containment")


OP3_SQL = r"""
WITH t AS (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
w AS (SELECT k, id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM t),
r AS (SELECT DISTINCT k, id, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT k, id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS p FROM w)),
n AS (SELECT id, count(*) AS n_runs FROM r WHERE k = 'b' GROUP BY id),
m AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM r d JOIN r b USING (s) WHERE d.k = 'd' AND b.k = 'b' GROUP BY d.id, b.id)
SELECT doc_id, item_id, n_shared, n_runs, n_shared / n_runs AS containment FROM m JOIN n ON item_id = n.id WHERE n_shared >= 0.8 * n_runs
"""


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "digest", "license", F.array_join("notices", ",").alias("notices"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    out = toxicity.score(docs.select("doc_id", "text", "lang"), model).withColumn("threshold", toxicity.threshold(model, F.col("lang")))
    predicted = (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), predicted, (F.col("toxicity") >= F.col("threshold")).alias("toxic_by_lang"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13),
k AS (SELECT doc_id, p, array_to_string(w[p:p+12], ' ') AS t FROM g),
m AS (SELECT t, min(doc_id) AS least FROM k GROUP BY t),
r AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM k JOIN m USING (t) WHERE least < doc_id),
c AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(gone, j)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_near_dedup": op2_near_dedup,
        "op3_decontamination": op3_decontamination,
        "op4_nearest": op4_nearest,
        "op5_license_scan": op5_license_scan,
        "op6_toxicity": op6_toxicity,
        "op7_bpe": op7_bpe,
        "op8_html_text": op8_html_text,
        "op9_token_counts": op9_token_counts,
        "op10_substring_dedup": op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_lm_scoring": OP1_SQL, "op3_decontamination": OP3_SQL, "op5_license_scan": license_scan.oracle(), "op10_substring_dedup": OP10_SQL}
