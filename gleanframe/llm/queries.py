"""The queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.llm import copies, mixing, nearcopies, neighbours, residue, split, terms, tokenize, topn
from gleanframe.llm.common import canonical_fields, canonical_text
from gleanframe.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split.split_oversized(table(spark, sf_dir, "corpus").where("doc_id IS NOT NULL"), table(spark, sf_dir, "snippet_config"), with_text=False)
    return split.oversized_cuts(pieces)


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "corpus").select("doc_id", "text").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    return split.split_oversized(items, table(spark, sf_dir, "snippet_config"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = nearcopies.near_copies(table(spark, sf_dir, "corpus"), "doc_id", "text", 3, 0.5)
    return pairs.select(F.col("key_a").alias("doc_id_a"), F.col("key_b").alias("doc_id_b"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_per_group(table(spark, sf_dir, "run"), "query_id", "doc_id", "score", 10).select("query_id", "doc_id", "pos")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with the smallest key of its group and the number of copies."""
    corpus = copies.copy_groups(copies.canonical_hashes(table(spark, sf_dir, "corpus"), "doc_id", "text", canonical_text))
    manifest = copies.copy_groups(copies.canonical_hashes(table(spark, sf_dir, "manifest_records"), "record_id", "body", canonical_fields))
    return corpus.select(F.lit("corpus").alias("rel"), "*").unionByName(manifest.select(F.lit("manifest_records").alias("rel"), "*"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_groups(spark, sf_dir).where("key != keep_key").select("rel", "keep_key", F.col("key").alias("copy_key"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which at least one is among the other's five most similar."""
    near = neighbours.most_similar(table(spark, sf_dir, "emb_cache"), "content_hash", "vec", 5, 128, min_cosine=0.8)
    return near.select(F.least("key_a", "key_b").alias("hash_a"), F.greatest("key_a", "key_b").alias("hash_b")).distinct()


def _p7_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "corpus").select("doc_id", "text").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    counts = terms.term_counts(items, "doc_id", "text")
    asked = terms.keyword_terms(table(spark, sf_dir, "query_analysis"))
    stats = terms.collection_stats(counts)
    return terms.term_scores(counts, None, stats), terms.term_scores(counts, asked, stats)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare terms that a record leans on; the score itself is in ``p7_scores``."""
    own, asked = _p7_scores(spark, sf_dir)
    rare = F.col("term").rlike(r"^\p{L}") & (F.col("df") >= 1) & (F.col("df") <= 5)
    found = own.where(rare & (F.col("tf") >= 4)).unionByName(asked.where(rare))
    return found.select(F.col("key").alias("record_id"), "term")


def p7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of every item and query with its score."""
    own, asked = _p7_scores(spark, sf_dir)
    both = own.select(F.lit("corpus").alias("rel"), "*").unionByName(asked.select(F.lit("query_analysis").alias("rel"), "*"))
    return both.withColumnRenamed("key", "record_id").withColumn("llr", F.round("llr", 4) + F.lit(0.0))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_texts(table(spark, sf_dir, "documents"))


def p8_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts back from their ids: what was encoded, nothing more or less."""
    return tokenize.decode_ids(p8_ids(spark, sf_dir))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.template_residue(table(spark, sf_dir, "documents")).select("doc_id")


def p10_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.message_templates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_pieces": p1_pieces,
        "p2_found": p2_found,
        "p3_found": p3_found,
        "p5_found": p5_found,
        "p5_groups": p5_groups,
        "p6_found": p6_found,
        "p7_found": p7_found,
        "p7_scores": p7_scores,
        "p8_ids": p8_ids,
        "p8_text": p8_text,
        "p9_mix": p9_mix,
        "p9_shares": p9_shares,
        "p10_found": p10_found,
        "p10_templates": p10_templates,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_SQL,
        "p3_found": P3_SQL,
        "p6_found": P6_SQL,
        "p7_found": P7_SQL,
        "p7_scores": P7_SCORES_SQL,
        "p8_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }


P1_SQL = r"""
WITH items AS (SELECT DISTINCT doc_id, text FROM corpus WHERE doc_id IS NOT NULL),
lines AS (
  SELECT doc_id, length(text) AS n, list_max(list_transform(regexp_split_to_array(text, '\r\n|\n|\r'), lambda x: length(x))) AS widest
  FROM items WHERE text IS NOT NULL)
SELECT config_id, doc_id, CASE WHEN widest > max_chars THEN 'inside_line' ELSE 'line_end' END AS cut
FROM lines, (SELECT DISTINCT config_id, max_chars FROM snippet_config WHERE max_chars > 0) c
WHERE n > max_chars
"""

P3_SQL = """
WITH best AS (
  SELECT query_id, doc_id, max(score) AS score FROM run
  WHERE query_id IS NOT NULL AND doc_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
  GROUP BY query_id, doc_id),
ranked AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS pos FROM best)
SELECT query_id, doc_id, CAST(pos AS BIGINT) AS pos FROM ranked WHERE pos <= 10
"""

P7_SQL = r"""
WITH items AS (SELECT DISTINCT doc_id, text FROM corpus WHERE doc_id IS NOT NULL AND text IS NOT NULL),
occ AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}]+'))) AS term FROM items),
tf AS (SELECT doc_id, term, count(*) AS tf FROM occ GROUP BY ALL),
stats AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
rare AS (SELECT term FROM stats WHERE df <= 5 AND regexp_matches(term, '^\p{L}')),
kw AS (SELECT DISTINCT query_id, lower(unnest(regexp_extract_all(k, '[\p{L}\p{N}]+'))) AS term
       FROM (SELECT query_id, unnest(keywords) AS k FROM query_analysis WHERE query_id IS NOT NULL) WHERE k IS NOT NULL)
SELECT doc_id AS record_id, term FROM tf JOIN rare USING (term) WHERE tf >= 4
UNION ALL
SELECT query_id AS record_id, term FROM kw JOIN rare USING (term)
"""

P6_SQL = """
WITH v AS (
  SELECT content_hash AS h, min(CAST(vec AS DOUBLE[])) AS v FROM emb_cache
  WHERE content_hash IS NOT NULL AND len(vec) = 128 AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0
  GROUP BY content_hash),
u AS (SELECT h, v, sqrt(list_dot_product(v, v)) AS n FROM v),
s AS (SELECT a.h AS x, b.h AS y, least(list_dot_product(a.v, b.v) / (a.n * b.n), 1.0) AS c FROM u a JOIN u b ON a.h <> b.h),
near AS (SELECT x, y, c FROM s QUALIFY row_number() OVER (PARTITION BY x ORDER BY c DESC, y) <= 5)
SELECT DISTINCT least(x, y) AS hash_a, greatest(x, y) AS hash_b FROM near WHERE c >= 0.8
"""

_LLR = "CASE WHEN k11 * (k21 + k22) >= k21 * (k11 + k12) THEN 1 ELSE -1 END * greatest(2 * (" + " ".join(
    f"{sign} CASE WHEN {x} > 0 THEN ({x}) * ln({x}) ELSE 0 END"
    for sign, x in (("+", "k11"), ("+", "k12"), ("+", "k21"), ("+", "k22"), ("-", "k11 + k12"), ("-", "k21 + k22"), ("-", "k11 + k21"), ("-", "k12 + k22"), ("+", "k11 + k12 + k21 + k22"))
) + "), 0)"
P7_SCORES_SQL = rf"""
WITH items AS (SELECT doc_id, min(text) AS text FROM corpus WHERE doc_id IS NOT NULL GROUP BY doc_id),
occ AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'))) AS term FROM items),
tf AS (SELECT doc_id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY doc_id) AS n_words FROM occ GROUP BY doc_id, term),
stats AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
total AS (SELECT coalesce(sum(cf), 0) AS every FROM stats),
lists AS (SELECT DISTINCT query_id, keywords FROM query_analysis WHERE query_id IS NOT NULL),
kw AS (SELECT query_id, lower(unnest(regexp_extract_all(k, '[\p{{L}}\p{{N}}]+'))) AS term FROM (SELECT query_id, unnest(keywords) AS k FROM lists) WHERE k IS NOT NULL),
kt AS (SELECT query_id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY query_id) AS n_words FROM kw GROUP BY query_id, term),
cells AS (
  SELECT 'corpus' AS rel, doc_id AS record_id, term, tf, df, cf, tf::DOUBLE AS k11, (n_words - tf)::DOUBLE AS k12, (cf - tf)::DOUBLE AS k21, (every - n_words - (cf - tf))::DOUBLE AS k22
  FROM tf JOIN stats USING (term), total
  UNION ALL
  SELECT 'query_analysis', query_id, term, tf, coalesce(df, 0), coalesce(cf, 0), tf::DOUBLE, (n_words - tf)::DOUBLE, coalesce(cf, 0)::DOUBLE, (every - coalesce(cf, 0))::DOUBLE
  FROM kt LEFT JOIN stats USING (term), total)
SELECT rel, record_id, term, CAST(tf AS BIGINT) AS tf, CAST(df AS BIGINT) AS df, CAST(cf AS BIGINT) AS cf, round({_LLR}, 4) + 0.0 AS llr FROM cells
"""
