"""Queries on vectors, BM25, fusion and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanframe.functions import vectors
from gleanframe.functions.vectors import HashingBackend
from gleanframe.operators import dense, fusion, metrics
from gleanframe.operators.bm25 import Bm25Index, term_rows, term_stats
from gleanframe.plans import sqltext as q
from gleanframe.plans.texts import asked, items
from gleanframe.retriever import Encoder
from gleanframe.session import cut, table

#: The encoder of the checked queries; SQL has no BLAKE2b, so they hash with MD5.
BACKEND = HashingBackend(1024, hash_name="md5")


def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.doubles("embedding").alias("vec"), "label")


def feature_hash_vector(spark, sf_dir):
    vecs = BACKEND.embed(asked(spark, sf_dir), ["query_id"], "text")
    return vecs.select("query_id", F.posexplode("vec").alias("idx", "w")).where("w != 0").select("query_id", F.col("idx").cast("bigint").alias("idx"), F.round("w", 6).alias("w"))


def l2_norms(spark, sf_dir):
    return _embeddings(spark, sf_dir).select("vec_id", F.round(vectors.norm(F.col("vec")), 6).alias("norm"), F.round(vectors.norm(vectors.l2_normalize(F.col("vec"))), 6).alias("unit"))


def _near(spark, sf_dir, k=10):
    unit = _embeddings(spark, sf_dir).select("vec_id", "label", vectors.l2_normalize(F.col("vec")).alias("vec"))
    some = unit.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    return dense.top_k(unit.select("vec_id", "vec"), some, k, doc_id="vec_id", skip_same=True)


def cosine_topk(spark, sf_dir):
    return _near(spark, sf_dir)


def knn_label_vote(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    votes = _near(spark, sf_dir).join(labels, "vec_id").groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("votes").desc(), "label"))
    return votes.withColumn("r", first).where("r = 1").select("query_id", "label", "votes")


def hyde_blend(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    pairs = rows.join(rows.select((F.col("vec_id") + 1).alias("vec_id"), F.col("vec").alias("other")), "vec_id")
    made = pairs.select("vec_id", "vec", vectors.blend(F.col("vec"), F.col("other"), 0.575).alias("blend"))
    return made.select("vec_id", F.round(vectors.dot(F.col("vec"), F.col("blend")), 6).alias("dot"))


def _spread(rows, key):
    return rows.select(key, F.posexplode("vec").alias("i", "x")).select(key, F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


def maxpool_chunks(spark, sf_dir):
    return _spread(vectors.max_pool(_embeddings(spark, sf_dir).select("label", "vec"), ["label"]), "label")


def weighted_view_sum(spark, sf_dir):
    rows = _embeddings(spark, sf_dir).withColumn("w", F.lit(1.0) / (1 + F.col("vec_id") % 3))
    return _spread(vectors.weighted_sum(rows.select("label", "w", "vec"), ["label"], "w"), "label")


def hash_cosine_topk(spark, sf_dir):
    docs = BACKEND.embed(items(spark, sf_dir), ["doc_id"], "text")
    return dense.top_k(docs, cut(BACKEND.embed(asked(spark, sf_dir), ["query_id"], "text")), 10)


def bm25_stats(spark, sf_dir):
    return term_stats(items(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, sf_dir):
    return Bm25Index(items(spark, sf_dir)).top_k(asked(spark, sf_dir), 10)


def _fused(spark, sf_dir, fuse, more=lambda rows: {}):
    # texts are written and not their vectors, which take several times their room; each pass makes them
    rows = cut(term_rows(fusion.with_index(items(spark, sf_dir).select("doc_id", "doc_pos", "text")), ["doc_id", "idx", "text"]))
    docs = BACKEND.embed(rows, ["doc_id", "idx", "terms", "tfs", "dl"], "text")
    index = Bm25Index(rows)
    queries = asked(spark, sf_dir)
    both = BACKEND.embed(queries, ["query_id"], "text").join(index.weights(queries), "query_id")
    return fuse(docs, cut(both), index.mean_length, 10, **more(rows))


def rrf_topk(spark, sf_dir):
    return _fused(spark, sf_dir, fusion.rrf_top_k, lambda rows: {"rows": rows.drop("text")})


def linear_fusion_topk(spark, sf_dir):
    return _fused(spark, sf_dir, fusion.linear_top_k)


def multiview_topk(spark, sf_dir):
    """Multi-view documents against sketched queries."""
    encoder = Encoder({"name": "views", "backend": {"kind": "hashing"}, "snippet": {"multiview_enabled": True}, "query": {"hyde_enabled": True}}, BACKEND)
    return dense.top_k(encoder.encode_documents(items(spark, sf_dir), ["doc_id"]), cut(encoder.encode_queries(asked(spark, sf_dir))), 10)


def chunked_topk(spark, sf_dir):
    """Documents cut into windows and pooled."""
    encoder = Encoder({"name": "windows", "backend": {"kind": "hashing"}, "snippet": {"max_chars": 1200, "chunk_overlap": 80}}, BACKEND)
    return dense.top_k(encoder.encode_documents(items(spark, sf_dir), ["doc_id"]), cut(encoder.encode_queries(asked(spark, sf_dir))), 10)


def metrics_per_query(spark, sf_dir):
    found = metrics.metrics_per_query(table(spark, sf_dir, "qrels"), table(spark, sf_dir, "run"))
    return found.select("query_id", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


def metrics_at_k(spark, sf_dir):
    found = metrics.evaluate_retrieval(table(spark, sf_dir, "qrels"), table(spark, sf_dir, "run"))
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.round(c, 6).alias("value")) for c in found.columns])
    return found.select(F.explode(pairs).alias("x")).select("x.metric", "x.value")


def search_hits(spark, sf_dir):
    """The first three hits of each query with their texts' lengths."""
    first = metrics.ranked_run(table(spark, sf_dir, "run"), 3)
    return first.join(items(spark, sf_dir).select("doc_id", "text"), "doc_id", "left").select("query_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"), F.length("text").cast("bigint").alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (
        feature_hash_vector, l2_norms, cosine_topk, knn_label_vote, hyde_blend, maxpool_chunks, weighted_view_sum, hash_cosine_topk, bm25_stats, bm25_topk,
        rrf_topk, linear_fusion_topk, multiview_topk, chunked_topk, metrics_per_query, metrics_at_k, search_hits,
    )
}

_EMB = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_UNIT = f"{_EMB}, u AS (SELECT vec_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM e)"
_NEAR = f"""
WITH {_UNIT},
s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.v, b.v), 6) + 0.0 AS score FROM u a JOIN u b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS pos FROM s QUALIFY pos <= 10)"""
_COMPONENTS = f"WITH {_EMB}, c AS (SELECT vec_id, label, unnest(range(0, len(v))) AS i, unnest(v) AS x FROM e)"

_DENSE_ALL = f"""
WITH {q.ITEMS}, {q.ASKED}, {q.sparse_vectors("dv", "items", "doc_id")}, {q.sparse_vectors("qv", "asked", "query_id")},
met AS (SELECT query_id, doc_id, sum(qv.w * dv.w) AS s FROM qv JOIN dv USING (idx) GROUP BY ALL)"""

_GRID = f"""
WITH {q.bm25_cte()}, {q.sparse_vectors("dv", "items", "doc_id")}, {q.sparse_vectors("qv", "asked", "query_id")},
met AS (SELECT query_id, doc_id, sum(qv.w * dv.w) AS s FROM qv JOIN dv USING (idx) GROUP BY ALL),
grid AS (
  SELECT a.query_id, i.doc_id, i.doc_pos, round(coalesce(m.s, 0), 9) + 0.0 AS d, round(coalesce(b.bm25, 0), 9) + 0.0 AS b
  FROM asked a CROSS JOIN items i LEFT JOIN met m ON m.query_id = a.query_id AND m.doc_id = i.doc_id LEFT JOIN scored b ON b.query_id = a.query_id AND b.doc_id = i.doc_id)"""


def _metrics_sql() -> str:
    aggs, outs = [], []
    for k in metrics.K_VALUES:
        aggs += [
            f"sum(CASE WHEN rank <= {k} THEN relevance / log2(rank + 1) END) AS dcg_{k}",
            f"min(CASE WHEN rank <= {k} AND relevance > 0 THEN rank END) AS first_{k}",
            f"sum(CASE WHEN rank <= {k} AND relevance > 0 THEN 1 ELSE 0 END) AS hits_{k}",
            f"sum(CASE WHEN rank <= {k} AND relevance > 0 THEN nth / rank END) AS ap_{k}",
        ]
        outs += [
            f"coalesce(CASE WHEN ideal_{k} > 0 THEN dcg_{k} / ideal_{k} END, 0) AS ndcg_at_{k}",
            f"coalesce(1.0::DOUBLE / first_{k}, 0) AS mrr_at_{k}",
            f"coalesce(hits_{k}::DOUBLE / {k}, 0) AS precision_at_{k}",
            f"coalesce(hits_{k}::DOUBLE / relevant, 0) AS recall_at_{k}",
            f"coalesce(ap_{k}::DOUBLE / least(relevant, {k}), 0) AS map_at_{k}",
        ]
    ideals = ", ".join(f"sum(CASE WHEN rank <= {k} THEN relevance / log2(rank + 1) END) AS ideal_{k}" for k in metrics.K_VALUES)
    return f"""
WITH gold AS (
  SELECT query_id, doc_id, max(relevance) AS relevance FROM qrels
  WHERE query_id IS NOT NULL AND doc_id IS NOT NULL AND relevance IS NOT NULL AND NOT isnan(relevance) GROUP BY ALL),
best AS (SELECT query_id, doc_id, max(score) AS score FROM run WHERE query_id IS NOT NULL AND doc_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM best QUALIFY rank <= 10),
hits AS (SELECT r.query_id, rank, relevance, sum((relevance > 0)::INT) OVER (PARTITION BY r.query_id ORDER BY rank) AS nth FROM ranked r JOIN gold g ON g.query_id = r.query_id AND g.doc_id = r.doc_id),
ideal AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS rank FROM gold),
wanted AS (SELECT query_id, sum((relevance > 0)::INT) AS relevant, {ideals} FROM ideal GROUP BY query_id HAVING relevant > 0),
got AS (SELECT query_id, {", ".join(aggs)} FROM hits GROUP BY query_id),
each AS (SELECT w.query_id, {", ".join(outs)} FROM wanted w LEFT JOIN got USING (query_id))"""


_METRICS = [f"{n}_at_{k}" for k in metrics.K_VALUES for n in metrics.NAMES]

SQL = {
    "feature_hash_vector": f"WITH {q.ASKED}, {q.sparse_vectors('qv', 'asked', 'query_id')} SELECT query_id, idx, round(w, 6) AS w FROM qv WHERE w <> 0",
    "l2_norms": f"WITH {_UNIT} SELECT e.vec_id, round(sqrt(list_dot_product(e.v, e.v)), 6) AS norm, round(sqrt(list_dot_product(u.v, u.v)), 6) AS unit FROM e JOIN u USING (vec_id)",
    "cosine_topk": f"{_NEAR} SELECT query_id, vec_id, score, pos FROM near",
    "knn_label_vote": f"""
{_NEAR}, votes AS (SELECT query_id, label, count(*) AS votes FROM near JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) GROUP BY ALL)
SELECT query_id, label, votes FROM votes QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) = 1""",
    "hyde_blend": f"""
WITH {_EMB}, p AS (SELECT a.vec_id, a.v, b.v AS o FROM e a JOIN e b ON b.vec_id + 1 = a.vec_id),
m AS (SELECT vec_id, v, list_transform(range(1, len(v) + 1), lambda i: (1 - 0.575::DOUBLE) * v[i] + 0.575::DOUBLE * o[i]) AS b FROM p)
SELECT vec_id, round(list_dot_product(v, b) / greatest(sqrt(list_dot_product(b, b)), 1e-12), 6) AS dot FROM m""",
    "maxpool_chunks": f"""
{_COMPONENTS}, m AS (SELECT label, i, max(x) AS x FROM c GROUP BY ALL), n AS (SELECT label, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM m GROUP BY label)
SELECT label, i, round(x / n, 6) AS x FROM m JOIN n USING (label)""",
    "weighted_view_sum": f"""
{_COMPONENTS}, m AS (SELECT label, i, sum(x * (1.0::DOUBLE / (1 + vec_id % 3))) AS x FROM c GROUP BY ALL), n AS (SELECT label, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM m GROUP BY label)
SELECT label, i, round(x / n, 6) AS x FROM m JOIN n USING (label)""",
    "hash_cosine_topk": f"""
{_DENSE_ALL}, g AS (SELECT a.query_id, i.doc_id, round(coalesce(s, 0), 6) + 0.0 AS score FROM asked a CROSS JOIN items i LEFT JOIN met m ON m.query_id = a.query_id AND m.doc_id = i.doc_id)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS pos FROM g QUALIFY pos <= 10""",
    "bm25_stats": f"WITH {q.bm25_cte()} SELECT term, df, round(idf, 6) AS idf FROM stats",
    "bm25_topk": f"""
WITH {q.bm25_cte()}, r AS (
  SELECT a.query_id, i.doc_id, round(coalesce(b.bm25, 0), 6) + 0.0 AS bm25
  FROM asked a CROSS JOIN items i LEFT JOIN scored b ON b.query_id = a.query_id AND b.doc_id = i.doc_id)
SELECT query_id, doc_id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS pos FROM r QUALIFY pos <= 10""",
    "rrf_topk": f"""
{_GRID}, ranks AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, doc_pos, doc_id) AS rd, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, doc_pos, doc_id) AS rs FROM grid),
f AS (SELECT query_id, doc_id, round(1.0::DOUBLE / (60 + rd) + 0.5::DOUBLE / (60 + rs), 9) AS score FROM ranks)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS pos FROM f QUALIFY pos <= 10""",
    "linear_fusion_topk": f"""
{_GRID}, lim AS (SELECT query_id, min(d) AS dl, max(d) AS dh, min(b) AS bl, max(b) AS bh FROM grid GROUP BY query_id),
f AS (
  SELECT query_id, doc_id, round(1.0::DOUBLE * CASE WHEN dh - dl < 1e-12 THEN 0 ELSE (d - dl) / (dh - dl) END + 0.5::DOUBLE * CASE WHEN bh - bl < 1e-12 THEN 0 ELSE (b - bl) / (bh - bl) END, 6) + 0.0 AS score
  FROM grid JOIN lim USING (query_id))
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS pos FROM f QUALIFY pos <= 10""",
    "metrics_per_query": f"{_metrics_sql()} SELECT query_id, {', '.join(f'round({m}, 6) AS {m}' for m in _METRICS)} FROM each",
    "metrics_at_k": f"{_metrics_sql()} {' UNION ALL '.join(f"SELECT '{m}' AS metric, round(coalesce(avg({m}), 0), 6) AS value FROM each" for m in _METRICS)}",
    "search_hits": f"""
WITH {q.ITEMS},
best AS (SELECT query_id, doc_id, max(score) AS score FROM run WHERE query_id IS NOT NULL AND doc_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM best QUALIFY rank <= 3)
SELECT query_id, r.doc_id, score, rank, CAST(length(text) AS BIGINT) AS chars FROM ranked r LEFT JOIN items i ON i.doc_id = r.doc_id""",
}
