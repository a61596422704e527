"""The top N items of every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(
    hits: DataFrame,
    group: str,
    item: str,
    score: str,
    n: int = 10,
    subgroups: int = 32,
) -> DataFrame:
    """``group, item, score, pos``: the ``n`` best items of each group, ``pos`` from 1.

    An item counts once per group, with its highest score; the higher score comes
    first, then the item that is smaller by bytes. Rows with a null group or item or
    a null or NaN score are no hits; infinite scores rank as numbers do. ``-0.0``
    equals ``0.0``. Other columns are ignored, an empty table gives no rows.

    Two stages: an item's hash puts it into one of ``subgroups`` parts of its group,
    so all rows of one item meet in the same part; each part keeps its ``n`` best,
    and at most ``n * subgroups`` survivors of a group are ranked again. The first
    shuffle goes by (group, part, item) after a map-side maximum, so no key of it is
    hot; before each later one every task cuts its rows to the ``n`` best of a part
    or group, so a group of any size sends a bounded number of rows per task.
    """
    rows = hits.where(
        F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score))
    ).select(
        F.col(group).alias("g"),
        F.col(item).alias("i"),
        (F.col(score) + F.lit(0.0)).alias("s"),
        F.pmod(F.xxhash64(F.col(item)), F.lit(subgroups)).cast("int").alias("part"),
    )
    best = rows.groupBy("g", "part", "i").agg(F.max("s").alias("s"))
    first = Window.partitionBy("g", "part").orderBy(F.col("s").desc(), F.col("i"))
    kept = best.withColumn("r", F.row_number().over(first)).where(F.col("r") <= n)
    last = Window.partitionBy("g").orderBy(F.col("s").desc(), F.col("i"))
    return (
        kept.withColumn("pos", F.row_number().over(last).cast("bigint"))
        .where(F.col("pos") <= n)
        .select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "pos")
    )
