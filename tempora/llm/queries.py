"""Queries of this subpackage: every operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempora.llm import bpe, embedding_dedup, fingerprints, langid, licenses, line_dedup, packing, simhash, token_counts, toxicity
from tempora.llm.storage import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe, op2_line_dedup, op3_simhash, op4_packing, op5_token_counts, op6_toxicity, op7_embedding_dedup, op8_fingerprints,
        op9_licenses, op10_language_id,
    )
}

ORACLES = {
    "op2_line_dedup": """
WITH l AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line
  FROM documents),
u AS (SELECT lower(line) AS ll, min(struct_pack(d := doc_id, p := pos)) AS f FROM l WHERE trim(line) <> '' GROUP BY 1),
s AS (
  SELECT ll, f.d AS doc_id, f.p AS pos, row_number() OVER (ORDER BY f.d, f.p) AS lid,
         list_distinct(list_filter(string_split(ll, ' '), lambda x: x <> '')) AS words
  FROM u),
t AS (SELECT lid, len(words) AS n, unnest(words) AS w FROM s),
c AS (SELECT w, count(*) AS c FROM t GROUP BY w),
r AS (SELECT lid, n, w, row_number() OVER (PARTITION BY lid ORDER BY c, w) AS i FROM t JOIN c USING (w)),
p AS (SELECT * FROM r WHERE i <= n - ceil(0.8 * n - 1e-9) + 1),
q AS (
  SELECT DISTINCT a.lid AS a, b.lid AS b FROM p a JOIN p b ON a.w = b.w AND b.lid < a.lid
  WHERE least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
v AS (
  SELECT DISTINCT q.a AS lid FROM q JOIN s x ON x.lid = q.a JOIN s y ON y.lid = q.b
  WHERE len(list_intersect(x.words, y.words))
        >= 0.8 * (len(x.words) + len(y.words) - len(list_intersect(x.words, y.words))) - 1e-9),
k AS (SELECT doc_id, pos FROM s WHERE lid NOT IN (SELECT lid FROM v)),
g AS (
  SELECT l.doc_id, count(*) AS n, string_agg(CAST(l.pos AS VARCHAR), ',' ORDER BY l.pos) AS removed
  FROM l LEFT JOIN k ON k.doc_id = l.doc_id AND k.pos = l.pos WHERE trim(line) <> '' AND k.pos IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, coalesce(g.removed, '') AS removed_lines
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id""",
    "op7_embedding_dedup": """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b
  ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT x.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.component_id, x.vec_id = m.component_id AS kept
FROM embeddings x JOIN m ON m.a = x.vec_id LEFT JOIN n ON n.a = x.vec_id""",
}
