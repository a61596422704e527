"""A versioned, content-addressed index: only contents not seen before are encoded."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanframe.operators import dense
from gleanframe.operators.snapshots import delivered_versions


def content_hash(text) -> F.Column:
    """32 hex digits of the content; null equals empty."""
    return F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary"))


def dedupe_contents(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``content_hash, keep, copies`` of each distinct content: its smallest key and how
    many rows have it."""
    return rows.groupBy(content_hash(text).alias("content_hash")).agg(F.min(key).alias("keep"), F.count("*").alias("copies"))


def rebuild_counts(current: DataFrame, versions: DataFrame) -> DataFrame:
    """``index_name, version, documents, encoded_count, hit_rate`` of each delivered
    version, in the order they were taken: how many contents no earlier version of the
    index had, and which share of the documents came from the cache. ``current`` has
    ``index_name, version, doc_id, digest`` (see ``snapshots.current_rows``)."""
    order = Window.partitionBy("index_name").orderBy("taken_at", "version")
    timed = delivered_versions(current, versions).select("index_name", "version").join(
        versions.where("taken_at IS NOT NULL").groupBy("index_name", "version").agg(F.min("taken_at").alias("taken_at")), ["index_name", "version"]
    ).withColumn("no", F.row_number().over(order))
    rows = current.join(timed.select("index_name", "version", "no"), ["index_name", "version"])
    first = rows.groupBy("index_name", "digest").agg(F.min("no").alias("no"))
    fresh = first.groupBy("index_name", "no").agg(F.count("*").alias("encoded_count"))
    sizes = rows.groupBy("index_name", "version", "no").agg(F.count("*").alias("documents"))
    met = sizes.join(fresh, ["index_name", "no"], "left").withColumn("encoded_count", F.coalesce("encoded_count", F.lit(0)))
    return met.select("index_name", "version", "documents", "encoded_count", (1 - F.col("encoded_count") / F.col("documents")).alias("hit_rate"))


class VersionedIndex:
    """Snapshots and an embedding cache as two Parquet tables in one folder.

    ``embed(df, keys, text) -> df`` makes the vectors, as a backend's ``embed`` does.
    A version is a partition of the snapshot table, replaced when added again; the
    cache is only appended to. Both live where all executors can reach them.
    """

    def __init__(self, spark: SparkSession, path: str, embed, dim: int):
        self.spark, self.path, self.embed, self.dim = spark, path.rstrip("/"), embed, dim
        self.rebuild_seconds: dict[str, float] = {}
        self.encoded_counts: dict[str, int] = {}
        self.sizes: dict[str, int] = {}

    def _read(self, name: str, schema: str) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return self.spark.createDataFrame([], schema)

    @property
    def cache(self) -> DataFrame:
        return self._read("emb_cache", "content_hash string, vec array<float>")

    @property
    def snapshots(self) -> DataFrame:
        return self._read("snapshots", "doc_id string, content_hash string, text string, version string")

    def add_version(self, version: str, corpus: DataFrame) -> float:
        """Adds or replaces a version given as ``doc_id, text``; seconds it took. A document
        that comes several times counts once, with the text of the greater hash. Contents
        are compared by hash: those in the cache are left out by an anti join, and each
        new one is encoded once however often the version has it."""
        began = time.perf_counter()
        given = corpus.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("content_hash", content_hash("text"))
        rows = given.groupBy("doc_id").agg(F.max(F.struct("content_hash", "text")).alias("x")).select("doc_id", "x.text", "x.content_hash")
        fresh = rows.select("content_hash", "text").dropDuplicates(["content_hash"]).join(self.cache.select("content_hash"), "content_hash", "left_anti")
        new = self.embed(fresh, ["content_hash"], "text").select("content_hash", F.col("vec").cast("array<float>").alias("vec"))
        before = self.cache.count()
        new.write.mode("append").parquet(f"{self.path}/emb_cache")
        self.encoded_counts[version] = self.cache.count() - before
        (
            rows.withColumn("version", F.lit(version))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(f"{self.path}/snapshots")
        )
        self.sizes[version] = self.snapshots.where(F.col("version") == version).count()
        self.rebuild_seconds[version] = time.perf_counter() - began
        return self.rebuild_seconds[version]

    def matrix_for(self, version: str) -> DataFrame:
        """``doc_id, vec`` of a version."""
        if version not in self.sizes:
            raise KeyError(f"unknown version {version!r}")
        rows = self.snapshots.where(F.col("version") == version).select("doc_id", "content_hash")
        return rows.join(self.cache, "content_hash").select("doc_id", F.col("vec").cast("array<double>").alias("vec"))

    def search(self, version: str, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """The best documents of a version for ``query_id, vec``; only its partition is read."""
        return dense.top_k(self.matrix_for(version), queries, top_k)

    def cache_hit_rate(self, version: str) -> float:
        total = self.sizes.get(version, 0)
        return 1 - self.encoded_counts.get(version, 0) / total if total else 0.0

    def save(self, path: str) -> None:
        """Copies the tables and the manifest to a folder."""
        self.cache.write.mode("overwrite").parquet(f"{path}/emb_cache")
        self.snapshots.write.mode("overwrite").partitionBy("version").parquet(f"{path}/snapshots")
        manifest = {"dim": self.dim, "rebuild_seconds": self.rebuild_seconds, "encoded_counts": self.encoded_counts, "sizes": self.sizes}
        Path(path).mkdir(parents=True, exist_ok=True)
        (Path(path) / "manifest.json").write_text(json.dumps(manifest, indent=2), encoding="utf-8")

    def load(self, path: str) -> VersionedIndex:
        """Goes on from a saved folder."""
        self.path = path.rstrip("/")
        manifest = json.loads((Path(path) / "manifest.json").read_text(encoding="utf-8"))
        self.dim = manifest["dim"]
        self.rebuild_seconds, self.encoded_counts, self.sizes = manifest.get("rebuild_seconds", {}), manifest.get("encoded_counts", {}), manifest.get("sizes", {})
        return self
