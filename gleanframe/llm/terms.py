"""How characteristic a term is of a record: the log-likelihood ratio test."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.llm.common import words
from gleanframe.session import cut

#: The terms with the most documents travel by broadcast; so many, whatever the data.
HOT_TERMS = 4096


def term_counts(records: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, tf, n_words``: how often each term occurs in each record, counted
    per row, without a shuffle. ``n_words`` is the number of words of the record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            terms: list[str] = []
            tfs: list[int] = []
            sizes: list[int] = []
            for row, t in enumerate(batch.column(1).to_pylist()):
                found = words(t)
                counts = Counter(found)
                terms.extend(counts.keys())
                tfs.extend(counts.values())
                rows.extend([row] * len(counts))
                sizes.extend([len(found)] * len(counts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.string()), pa.array(tfs, pa.int64()), pa.array(sizes, pa.int64())],
                names=["key", "term", "tf", "n_words"],
            )

    kind = records.schema[key].dataType.simpleString()
    return records.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"key {kind}, term string, tf bigint, n_words bigint")


def log_likelihood(k11: Column, k12: Column, k21: Column, k22: Column) -> Column:
    """Signed G2 of a two-by-two table: positive where the first row has more than
    its share of the first column, negative where it has less."""

    def xlogx(c: Column) -> Column:
        return F.when(c > 0, c * F.ln(c)).otherwise(F.lit(0.0))

    k11, k12, k21, k22 = (c.cast("double") for c in (k11, k12, k21, k22))
    g2 = 2 * (
        xlogx(k11) + xlogx(k12) + xlogx(k21) + xlogx(k22) - xlogx(k11 + k12) - xlogx(k21 + k22) - xlogx(k11 + k21) - xlogx(k12 + k22) + xlogx(k11 + k12 + k21 + k22)
    )
    return F.when(k11 * (k21 + k22) >= k21 * (k11 + k12), F.greatest(g2, F.lit(0.0))).otherwise(-F.greatest(g2, F.lit(0.0)))


def collection_stats(counts: DataFrame) -> DataFrame:
    """``term, df, cf`` of a collection, written once: the scores of its own records
    and of any others read it from there, and no text is split again for it."""
    return cut(counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")))


def term_scores(counts: DataFrame, records: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """``key, term, tf, df, cf, llr`` for the terms of ``records`` (``key, term, tf,
    n_words``), or without them of the collection's own records, against the collection
    whose counts are ``counts`` (same columns).

    ``df`` is the number of the collection's records that have the term, ``cf`` how
    often it occurs in all of them; both are 0 for a term the collection lacks.
    ``llr`` compares the term's count in the record with its count in the rest of
    the collection (for a record of the collection, without the record itself; for
    other ``records``, against the whole collection).

    Statistics (``stats``, if they are there already) combine on the map side. The ``HOT_TERMS`` most frequent terms, which
    hold most occurrences, meet their records by broadcast; the others by a shuffle
    join on the term, where none of them can be hot any more.
    """
    own = records is None
    records = counts if own else records
    stats = collection_stats(counts) if stats is None else stats
    n = stats.agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("all_words"))
    hot = stats.orderBy(F.col("df").desc(), F.col("term")).limit(HOT_TERMS)
    near = F.broadcast(hot.select("term", F.col("df").alias("hot_df"), F.col("cf").alias("hot_cf")))
    met = records.join(near, "term", "left")
    done = met.where("hot_df IS NOT NULL").select("key", "term", "tf", "n_words", F.col("hot_df").alias("df"), F.col("hot_cf").alias("cf"))
    rest = met.where("hot_df IS NULL").select("key", "term", "tf", "n_words").join(stats, "term", "left").select("key", "term", "tf", "n_words", F.coalesce("df", F.lit(0)).alias("df"), F.coalesce("cf", F.lit(0)).alias("cf"))
    every = done.unionByName(rest).join(F.broadcast(n))
    other_term = F.col("cf") - F.col("tf") if own else F.col("cf")
    other_all = F.col("all_words") - F.col("n_words") if own else F.col("all_words")
    llr = log_likelihood(F.col("tf"), F.col("n_words") - F.col("tf"), other_term, other_all - other_term)
    return every.select("key", "term", "tf", "df", "cf", llr.alias("llr"))


def keyword_terms(analysis: DataFrame, key: str = "query_id", keywords: str = "keywords") -> DataFrame:
    """``key, term, tf, n_words`` of the keywords of each query. Repeated rows of one
    query are one; a null list, a null keyword and a blank one add nothing."""
    kinds = F.array_join(F.filter(F.col(keywords), lambda k: k.isNotNull()), "\n")
    rows = analysis.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.coalesce(kinds, F.lit("")).alias("t")).distinct()
    each = term_counts(rows, "k", "t").groupBy("key", "term").agg(F.sum("tf").alias("tf"))
    return each.select("key", "term", "tf", F.sum("tf").over(Window.partitionBy("key")).alias("n_words"))
