"""Queries on versions: changes, rebuilds, stable core and delta."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanframe.functions.vectors import dot
from gleanframe.operators import dense, evolution, versions
from gleanframe.operators.snapshots import current_rows, delivered_versions, snapshot_changes
from gleanframe.plans import sqltext as q
from gleanframe.plans.ranking import BACKEND
from gleanframe.plans.texts import asked, items
from gleanframe.session import cut, shared_dir, table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "snapshots"), table(spark, sf_dir, "index_versions"))


def content_dedupe(spark, sf_dir):
    return versions.dedupe_contents(table(spark, sf_dir, "documents"), "doc_id")


def version_rebuild(spark, sf_dir):
    found = versions.rebuild_counts(current_rows(table(spark, sf_dir, "snapshots")), table(spark, sf_dir, "index_versions"))
    return found.withColumn("hit_rate", F.round("hit_rate", 6))


def cache_hit_rate(spark, sf_dir):
    """Of each index as a whole: encoded contents against documents of all versions."""
    each = versions.rebuild_counts(current_rows(table(spark, sf_dir, "snapshots")), table(spark, sf_dir, "index_versions"))
    whole = each.groupBy("index_name").agg(F.sum("documents").alias("documents"), F.sum("encoded_count").alias("encoded"))
    return whole.select("index_name", "documents", "encoded", F.round(1 - F.col("encoded") / F.col("documents"), 6).alias("hit_rate"))


def _held_texts(spark, sf_dir) -> DataFrame:
    """``index_name, version, doc_id, text``: the delivery that holds, of versions with a time."""
    rows = table(spark, sf_dir, "snapshots").where("index_name IS NOT NULL AND version IS NOT NULL AND doc_id IS NOT NULL")
    body = F.coalesce("text", F.lit(""))
    held = rows.groupBy("index_name", "version", "doc_id").agg(F.max(F.struct("loaded_at", F.md5(body.cast("binary")).alias("h"), body.alias("text"))).getField("text").alias("text"))
    return held


def _numbered(spark, sf_dir) -> DataFrame:
    held = _held_texts(spark, sf_dir)
    timed = table(spark, sf_dir, "index_versions").where("taken_at IS NOT NULL").groupBy("index_name", "version").agg(F.min("taken_at").alias("taken_at"))
    have = timed.join(held.select("index_name", "version").distinct(), ["index_name", "version"])
    return held.join(have.withColumn("no", F.row_number().over(Window.partitionBy("index_name").orderBy("taken_at", "version")).cast("bigint")), ["index_name", "version"])


def version_search(spark, sf_dir):
    """Every query against the newest delivered version of every index: the five best
    documents of each index and query."""
    rows = _numbered(spark, sf_dir)
    newest = rows.groupBy("index_name").agg(F.max("no").alias("no"))
    docs = BACKEND.embed(rows.join(newest, ["index_name", "no"]).select("index_name", "doc_id", "text"), ["index_name", "doc_id"], "text")
    return dense.top_k_within(docs, cut(BACKEND.embed(asked(spark, sf_dir), ["query_id"], "text")), 5)


def _groups(spark, sf_dir) -> DataFrame:
    rows = _numbered(spark, sf_dir)
    return rows.select(F.concat_ws("/", "index_name", "doc_id").alias("group_id"), F.col("no").alias("version_no"), "text")


def stable_core_delta(spark, sf_dir):
    return evolution.stable_core_and_delta(_groups(spark, sf_dir))


def delta_line_counts(spark, sf_dir):
    parts = evolution.line_parts(_groups(spark, sf_dir))
    return parts.groupBy("group_id", "version_no").agg(F.count_if("is_core").alias("core_lines"), F.count_if(~F.col("is_core")).alias("delta_lines"))


def evolved_vectors(spark, sf_dir):
    """How far the lines of its own move each version's vector."""
    groups = cut(_groups(spark, sf_dir))
    moved = evolution.evolved_vectors(groups, BACKEND.embed, 0.5).withColumnRenamed("vec", "moved")
    base = BACKEND.embed(groups, ["group_id", "version_no"], "text")
    return base.join(moved, ["group_id", "version_no"]).select("group_id", "version_no", F.round(dot(F.col("vec"), F.col("moved")), 6).alias("cosine"))


def ablation_table(spark, sf_dir):
    """The usual sweep over the whole corpus with its judgments."""
    from gleanframe.config import sweep
    from gleanframe.operators import ablation

    corpus = cut(items(spark, sf_dir).select("doc_id", "doc_pos", "text"))
    measure = ablation.measured(corpus, cut(asked(spark, sf_dir)), table(spark, sf_dir, "qrels"), 10)
    return ablation.ablation_table(spark, sweep(), measure).drop("no", "telemetry")


def stream_versions(spark, sf_dir):
    """An index fed by a stream of the documents: what each micro-batch encoded."""
    from gleanframe.streaming.incremental import stream_versions as start

    work = f"{shared_dir(spark)}/stream-{Path(tempfile.mktemp()).name}"
    table(spark, sf_dir, "corpus").select("doc_id", "text").write.parquet(f"{work}/in")
    index = versions.VersionedIndex(spark, f"{work}/index", BACKEND.embed, BACKEND.dim)
    feed = spark.readStream.schema("doc_id string, text string").option("maxFilesPerTrigger", 4).parquet(f"{work}/in")
    query = start(feed, index, f"{work}/state")
    query.awaitTermination()
    rows = [(v, index.sizes[v], index.encoded_counts[v], index.cache_hit_rate(v)) for v in index.sizes]
    return spark.createDataFrame(rows, "version string, documents bigint, encoded bigint, hit_rate double")


QUERIES = {
    f.__name__: f
    for f in (p4_found, content_dedupe, version_rebuild, cache_hit_rate, version_search, stable_core_delta, delta_line_counts, evolved_vectors, ablation_table, stream_versions)
}

_HELD = """
held AS (
  SELECT index_name, version, doc_id, text FROM (
    SELECT index_name, version, doc_id, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY index_name, version, doc_id ORDER BY loaded_at DESC NULLS LAST, md5(coalesce(text, '')) DESC) AS r
    FROM snapshots WHERE index_name IS NOT NULL AND version IS NOT NULL AND doc_id IS NOT NULL) WHERE r = 1),
timed AS (
  SELECT index_name, version, min(taken_at) AS taken_at FROM index_versions
  WHERE index_name IS NOT NULL AND version IS NOT NULL AND taken_at IS NOT NULL GROUP BY ALL),
ord AS (
  SELECT index_name, version, lag(version) OVER w AS before, row_number() OVER w AS no
  FROM timed SEMI JOIN held USING (index_name, version) WINDOW w AS (PARTITION BY index_name ORDER BY taken_at, version))"""
_REBUILD = f"""
WITH {_HELD},
rows AS (SELECT o.index_name, o.version, o.no, md5(h.text) AS h FROM held h JOIN ord o USING (index_name, version)),
first AS (SELECT index_name, h, min(no) AS no FROM rows GROUP BY ALL),
fresh AS (SELECT index_name, no, count(*) AS encoded_count FROM first GROUP BY ALL),
sizes AS (SELECT index_name, version, no, count(*) AS documents FROM rows GROUP BY ALL),
each AS (SELECT s.index_name, s.version, s.documents, coalesce(f.encoded_count, 0) AS encoded_count FROM sizes s LEFT JOIN fresh f USING (index_name, no))"""
_GROUPS = "grp AS (SELECT concat_ws('/', o.index_name, h.doc_id) AS group_id, o.no AS version_no, h.text FROM held h JOIN ord o USING (index_name, version))"
_PARTS = f"""
WITH {_HELD}, {_GROUPS},
ls AS (SELECT group_id, version_no, string_split({q.cleaned("text")}, chr(10)) AS l FROM grp),
lines AS (SELECT * FROM (SELECT group_id, version_no, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM ls) WHERE {q.normalized("line")} <> ''),
keyed AS (SELECT *, {q.normalized("line")} AS key FROM lines),
many AS (SELECT group_id, count(DISTINCT version_no) AS n FROM grp GROUP BY group_id),
spread AS (SELECT group_id, key, count(DISTINCT version_no) AS m FROM keyed GROUP BY ALL),
parts AS (
  SELECT k.group_id, k.version_no, k.pos, k.line, s.m = m.n AS is_core FROM keyed k JOIN spread s USING (group_id, key) JOIN many m USING (group_id)
  QUALIFY s.m <> m.n OR row_number() OVER (PARTITION BY k.group_id, k.version_no, k.key ORDER BY k.pos) = 1),
made AS (
  SELECT g.group_id, g.version_no, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (is_core), '') AS core, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT is_core), '') AS delta
  FROM (SELECT DISTINCT group_id, version_no FROM grp) g LEFT JOIN parts p USING (group_id, version_no) GROUP BY ALL)"""

SQL = {
    "content_dedupe": "SELECT md5(coalesce(text, '')) AS content_hash, min(doc_id) AS keep, count(*) AS copies FROM documents GROUP BY 1",
    "version_rebuild": f"{_REBUILD} SELECT index_name, version, documents, encoded_count, round(1 - encoded_count::DOUBLE / documents, 6) AS hit_rate FROM each",
    "cache_hit_rate": f"{_REBUILD} SELECT index_name, CAST(sum(documents) AS BIGINT) AS documents, CAST(sum(encoded_count) AS BIGINT) AS encoded, round(1 - sum(encoded_count)::DOUBLE / sum(documents), 6) AS hit_rate FROM each GROUP BY index_name",
    "version_search": f"""
WITH {_HELD}, {q.ASKED},
newest AS (SELECT index_name, max(no) AS no FROM ord GROUP BY index_name),
last AS (SELECT h.index_name, h.doc_id, h.text FROM held h JOIN ord o USING (index_name, version) JOIN newest n ON n.index_name = o.index_name AND n.no = o.no),
{q.sparse_vectors("dv", "last", "index_name, doc_id")}, {q.sparse_vectors("qv", "asked", "query_id")},
met AS (SELECT index_name, query_id, doc_id, sum(qv.w * dv.w) AS s FROM qv JOIN dv USING (idx) GROUP BY ALL),
g AS (
  SELECT i.index_name, a.query_id, i.doc_id, round(coalesce(s, 0), 6) + 0.0 AS score
  FROM asked a CROSS JOIN last i LEFT JOIN met m ON m.query_id = a.query_id AND m.index_name = i.index_name AND m.doc_id = i.doc_id)
SELECT index_name, query_id, doc_id, score, row_number() OVER (PARTITION BY index_name, query_id ORDER BY score DESC, doc_id) AS pos FROM g QUALIFY pos <= 5""",
    "stable_core_delta": f"{_PARTS} SELECT group_id, version_no, core, delta FROM made",
    "delta_line_counts": f"{_PARTS} SELECT group_id, version_no, count(*) FILTER (is_core) AS core_lines, count(*) FILTER (NOT is_core) AS delta_lines FROM parts GROUP BY ALL",
    "evolved_vectors": f"""
{_PARTS}, own AS (SELECT group_id, version_no, delta FROM made WHERE delta <> ''),
{q.sparse_vectors("bv", "grp", "group_id, version_no")}, {q.sparse_vectors("ov", "own", "group_id, version_no", "delta")},
x AS (
  SELECT coalesce(b.group_id, o.group_id) AS group_id, coalesce(b.version_no, o.version_no) AS version_no, coalesce(b.w, 0) AS w, coalesce(b.w, 0) + 0.5::DOUBLE * coalesce(o.w, 0) AS m
  FROM bv b FULL JOIN ov o ON b.group_id = o.group_id AND b.version_no = o.version_no AND b.idx = o.idx),
c AS (SELECT group_id, version_no, sum(w * m) / greatest(sqrt(sum(m * m)), 1e-12) AS c FROM x GROUP BY ALL)
SELECT g.group_id, g.version_no, round(coalesce(c, 0), 6) AS cosine FROM (SELECT DISTINCT group_id, version_no FROM grp) g LEFT JOIN c USING (group_id, version_no)""",
    "p4_found": """
WITH cur AS (
  SELECT index_name, version, doc_id, text FROM (
    SELECT index_name, version, doc_id, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY index_name, version, doc_id ORDER BY loaded_at DESC NULLS LAST, md5(coalesce(text, '')) DESC) AS r
    FROM snapshots WHERE index_name IS NOT NULL AND version IS NOT NULL AND doc_id IS NOT NULL) WHERE r = 1),
timed AS (
  SELECT index_name, version, min(taken_at) AS taken_at FROM index_versions
  WHERE index_name IS NOT NULL AND version IS NOT NULL AND taken_at IS NOT NULL GROUP BY ALL),
ord AS (
  SELECT index_name, version, lag(version) OVER w AS before
  FROM timed SEMI JOIN cur USING (index_name, version) WINDOW w AS (PARTITION BY index_name ORDER BY taken_at, version)),
new AS (SELECT o.index_name, o.version, c.doc_id, c.text FROM ord o JOIN cur c USING (index_name, version) WHERE o.before IS NOT NULL),
old AS (SELECT o.index_name, o.version, c.doc_id, c.text FROM ord o JOIN cur c ON c.index_name = o.index_name AND c.version = o.before)
SELECT coalesce(n.index_name, o.index_name) AS index_name, coalesce(n.version, o.version) AS version, coalesce(n.doc_id, o.doc_id) AS doc_id,
       CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM new n FULL JOIN old o ON n.index_name = o.index_name AND n.version = o.version AND n.doc_id = o.doc_id
WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR n.text <> o.text
""",
}
