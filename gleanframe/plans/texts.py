"""Queries on the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.config import QueryConfig
from gleanframe.functions import code, text
from gleanframe.plans import sqltext as q
from gleanframe.retriever import analyze_queries, sketch_queries
from gleanframe.session import table
from gleanframe.sources.tables import distinct_items


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_items(table(spark, sf_dir, "corpus"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_items(table(spark, sf_dir, "queries"), "query_id")


def analysed(spark: SparkSession, sf_dir: str, config: QueryConfig | None = None) -> DataFrame:
    return analyze_queries(asked(spark, sf_dir), config or QueryConfig())


def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "corpus").select("doc_id", "doc_pos", text.clean_snippet("text").alias("cleaned"))


def normalize_query(spark, sf_dir):
    return table(spark, sf_dir, "queries").select("query_id", text.normalize_query("text").alias("normalized"))


def tokenize_counts(spark, sf_dir):
    toks = table(spark, sf_dir, "corpus").select("doc_id", text.tokenize("text").alias("t"))
    return toks.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


def token_vocabulary(spark, sf_dir):
    toks = table(spark, sf_dir, "corpus").select(F.explode(text.tokenize("text")).alias("token"))
    return toks.groupBy("token").agg(F.count("*").alias("n"))


def identifier_subwords(spark, sf_dir):
    toks = table(spark, sf_dir, "corpus").select(F.explode(text.tokenize("text")).alias("token")).where(F.col("token").contains("_"))
    parts = toks.select(F.explode(F.split("token", "_+")).alias("part")).where("part != ''")
    return parts.groupBy("part").agg(F.count("*").alias("n"))


def char_trigrams(spark, sf_dir):
    toks = table(spark, sf_dir, "queries").select(F.explode(text.tokenize("text")).alias("token"))
    return toks.select(F.explode(text.trigrams(F.col("token"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def keywords(spark, sf_dir):
    return analysed(spark, sf_dir).select("query_id", F.array_join("keywords", "|").alias("keywords"), F.array_join("identifiers", "|").alias("identifiers"))


def classify_query(spark, sf_dir):
    return analysed(spark, sf_dir).select("query_id", "query_type", text.is_behavioral(F.col("query_type")).alias("behavioral"))


def hyde_weight(spark, sf_dir):
    return analysed(spark, sf_dir).select("query_id", F.round(text.hyde_weight(F.col("query_type"), 0.5), 6).alias("weight"))


def front_load(spark, sf_dir):
    return analysed(spark, sf_dir, QueryConfig(front_load_keywords=True)).select("query_id", "prepared")


def sketch_template(spark, sf_dir):
    return sketch_queries(analysed(spark, sf_dir)).select("query_id", "sketch")


def sketch_cached(spark, sf_dir):
    found = analysed(spark, sf_dir)
    cache = found.where("query_type = 'lookup'").select(F.col("normalized").alias("key"), F.concat(F.lit("pass  # "), "normalized").alias("sketch"))
    return sketch_queries(found, cache).select("query_id", "sketch")


def chunk_lines(spark, sf_dir):
    rows = items(spark, sf_dir).select("doc_id", F.posexplode(text.chunk_lines(text.clean_snippet("text"), 1200, 80)).alias("chunk_no", "chunk"))
    return rows.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "chunk")


def benchmark_titles(spark, sf_dir):
    body = text.with_title(F.col("path"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(body.cast("binary")).alias("body_md5"), F.length(body).cast("bigint").alias("body_chars"))


def ast_normal_form(spark, sf_dir):
    return code.build_views(items(spark, sf_dir), ["doc_id"]).select("doc_id", "ast")


def token_normal_form(spark, sf_dir):
    return code.build_views(items(spark, sf_dir), ["doc_id"], language="other").select("doc_id", F.col("ast").alias("form"))


def identifier_bag(spark, sf_dir):
    return code.build_views(items(spark, sf_dir), ["doc_id"]).select("doc_id", "identifiers")


QUERIES = {
    f.__name__: f
    for f in (
        clean_text, normalize_query, tokenize_counts, token_vocabulary, identifier_subwords, char_trigrams, keywords, classify_query, hyde_weight,
        front_load, sketch_template, sketch_cached, chunk_lines, benchmark_titles, ast_normal_form, token_normal_form, identifier_bag,
    )
}

_ANALYSED = f"WITH {q.ASKED}, {q.keywords_cte('asked')}"
_WEIGHT = "CASE query_type WHEN 'lookup' THEN 0.5 * 0.5 WHEN 'behavioral' THEN least(1.0, 0.5 * 1.15) WHEN 'general' THEN least(1.0, 0.5 * 1.15) ELSE 0.5 END"
_BODY = f"CASE WHEN {q.strip("coalesce(path, '')")} <> '' THEN {q.strip("coalesce(path, '')")} || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END"

SQL = {
    "clean_text": f"SELECT doc_id, doc_pos, {q.cleaned('text')} AS cleaned FROM corpus",
    "normalize_query": f"SELECT query_id, {q.normalized('text')} AS normalized FROM queries",
    "tokenize_counts": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {q.tokens('text')} AS t FROM corpus)",
    "token_vocabulary": f"SELECT token, count(*) AS n FROM (SELECT unnest({q.tokens('text')}) AS token FROM corpus) GROUP BY token",
    "identifier_subwords": f"""
SELECT part, count(*) AS n FROM (
  SELECT unnest(string_split(token, '_')) AS part FROM (SELECT unnest({q.tokens("text")}) AS token FROM corpus) WHERE contains(token, '_'))
WHERE part <> '' GROUP BY part""",
    "char_trigrams": f"""
SELECT gram, count(*) AS n FROM (
  SELECT unnest(list_transform(range(1, length(token) + 1), lambda i: substr('#' || token || '#', i, 3))) AS gram
  FROM (SELECT unnest({q.tokens("text")}) AS token FROM queries) WHERE length(token) >= 3)
GROUP BY gram""",
    "keywords": f"{_ANALYSED} SELECT query_id, array_to_string(keywords, '|') AS keywords, array_to_string(list_filter(keywords, lambda k: regexp_full_match(k, '{q.IDENT}')), '|') AS identifiers FROM analysed",
    "classify_query": f"{_ANALYSED} SELECT query_id, query_type, query_type IN ('behavioral', 'general') AS behavioral FROM analysed",
    "hyde_weight": f"{_ANALYSED} SELECT query_id, CAST(round({_WEIGHT}, 6) AS DOUBLE) AS weight FROM analysed",
    "front_load": f"""
{_ANALYSED}, picked AS (
  SELECT *, list_slice(list_filter(keywords, lambda k: NOT (starts_with(lower(normalized), lower(k) || ' ') OR starts_with(lower(normalized), lower(k) || ','))), 1, 6) AS p FROM analysed)
SELECT query_id, CASE WHEN len(p) = 0 THEN normalized ELSE array_to_string(p, ', ') || '. ' || normalized END AS prepared FROM picked""",
    "sketch_template": f"{_ANALYSED} SELECT query_id, {q.sketch()} AS sketch FROM analysed",
    "sketch_cached": f"""
{_ANALYSED}, cache AS (SELECT DISTINCT normalized AS key FROM analysed WHERE query_type = 'lookup')
SELECT query_id, CASE WHEN {q.strip("raw")} IN (SELECT key FROM cache) THEN 'pass  # ' || {q.strip("raw")}
                      WHEN normalized IN (SELECT key FROM cache) THEN 'pass  # ' || normalized ELSE {q.sketch()} END AS sketch FROM analysed""",
    "benchmark_titles": f"SELECT doc_id, md5({_BODY}) AS body_md5, CAST(length({_BODY}) AS BIGINT) AS body_chars FROM documents",
}
