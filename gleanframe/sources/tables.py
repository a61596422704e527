"""Reading and writing corpora, judgments, sketch caches and result files."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.functions.text import with_title
from gleanframe.session import shuffle_width


def corpus_from(spark: SparkSession, corpus: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """``doc_id, doc_pos, text`` of a mapping or a list, whose ids are its positions."""
    items = corpus.items() if isinstance(corpus, Mapping) else ((str(i), t) for i, t in enumerate(corpus))
    return spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate(items)], "doc_id string, doc_pos bigint, text string")


def queries_from(spark: SparkSession, queries: Mapping[str, str]) -> DataFrame:
    return spark.createDataFrame(list(queries.items()), "query_id string, text string")


def qrels_from(spark: SparkSession, qrels: Mapping[str, Mapping[str, float]]) -> DataFrame:
    return spark.createDataFrame([(q, d, float(r)) for q, own in qrels.items() for d, r in own.items()], "query_id string, doc_id string, relevance double")


def run_from(spark: SparkSession, run: Mapping[str, Mapping[str, float]]) -> DataFrame:
    return spark.createDataFrame([(q, d, float(s)) for q, own in run.items() for d, s in own.items()], "query_id string, doc_id string, score double")


def distinct_items(corpus: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per id; a redelivered row is the same item. Null ids are no items.

    The one shuffle it takes is asked for by number, so that it also spreads the
    encoding that mostly follows over all cores, however small the texts are.
    """
    rows = corpus.where(F.col(key).isNotNull())
    return rows.repartition(shuffle_width(corpus.sparkSession), key).dropDuplicates([key])


def benchmark_texts(batch: DataFrame) -> DataFrame:
    """A batch with ``text`` or ``query`` and perhaps ``title``: the text to encode."""
    body = F.col("text") if "text" in batch.columns else F.col("query")
    title = F.col("title") if "title" in batch.columns else F.lit(None).cast("string")
    return batch.withColumn("body", with_title(title, body))


def read_sketch_cache(spark: SparkSession, path: str | None) -> DataFrame:
    """``key, sketch`` of a JSON object; a missing file is an empty cache."""
    empty = spark.createDataFrame([], "key string, sketch string")
    if not path or not Path(path).exists():
        return empty
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "sketch"))


def extract_scores(result: Mapping[str, Any], split: str = "test") -> dict[str, float]:
    """The numbers of a benchmark result: of the split asked for or else the first, of
    its first subset."""
    scores = result.get("scores") or {}
    rows = scores.get(split) or next((v for v in scores.values() if v), None) or []
    first = rows[0] if isinstance(rows, list) and rows else rows if isinstance(rows, Mapping) else {}
    return {k: float(v) for k, v in first.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}


def write_result_files(outcome: Mapping[str, Any], config, output_path: str, write_debug_sidecar: bool = True) -> list[str]:
    """The result as it is, and beside it ``<stem>.debug.json`` with config and scores."""
    path = Path(output_path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(outcome["result"], indent=2, ensure_ascii=False), encoding="utf-8")
    made = [str(path)]
    if write_debug_sidecar:
        aside = path.with_name(path.stem + ".debug.json")
        aside.write_text(json.dumps({"config": config.to_dict(), "signature": config.describe(), "scores": outcome.get("scores", {})}, indent=2), encoding="utf-8")
        made.append(str(aside))
    return made
