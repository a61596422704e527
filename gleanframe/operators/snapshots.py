"""What changed between the full snapshots of a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def current_rows(snapshots: DataFrame) -> DataFrame:
    """One row per (index_name, version, doc_id): the delivery with the latest
    ``loaded_at`` holds; among equally late ones the greater digest, so file order
    never matters. A null ``loaded_at`` is earlier than any other. A null text
    equals the empty one. Rows with a null key are dropped: they name no document.

    The text leaves as a 16-byte digest, so no later shuffle moves texts.
    """
    digest = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    keyed = snapshots.where("index_name IS NOT NULL AND version IS NOT NULL AND doc_id IS NOT NULL").select(
        "index_name", "version", "doc_id", F.struct(F.col("loaded_at"), digest.alias("digest")).alias("row")
    )
    return keyed.groupBy("index_name", "version", "doc_id").agg(F.max("row").getField("digest").alias("digest"))


def delivered_versions(current: DataFrame, versions: DataFrame) -> DataFrame:
    """The versions that have rows, each with the one before it by ``taken_at``
    (ties by name). A version named twice counts at its earliest time; one without
    a known time has no place in the order and is left out."""
    timed = (
        versions.where("index_name IS NOT NULL AND version IS NOT NULL AND taken_at IS NOT NULL")
        .groupBy("index_name", "version")
        .agg(F.min("taken_at").alias("taken_at"))
    )
    have = current.select("index_name", "version").distinct()
    order = Window.partitionBy("index_name").orderBy("taken_at", "version")
    return timed.join(have, ["index_name", "version"]).select(
        "index_name",
        "version",
        F.lag("version").over(order).alias("before"),
        F.lead("version").over(order).alias("after"),
    )


def snapshot_changes(snapshots: DataFrame, versions: DataFrame) -> DataFrame:
    """``index_name, version, doc_id, change`` for each delivered version but the
    first of its index: ``added``, ``removed`` or ``changed`` against the delivered
    version before it.

    EXCEPT ALL in both directions takes away the rows that are the same on both
    sides, and only the residues meet in the full join that labels them. Both sides
    are keyed by the later version of the pair, so every pair of every index is
    handled in one pass. Empty tables give no rows; extra columns are ignored.
    """
    current = current_rows(snapshots)
    order = delivered_versions(current, versions)
    rows = current.join(order, ["index_name", "version"])
    new = rows.where("before IS NOT NULL").select("index_name", "version", "doc_id", "digest")
    old = rows.where("after IS NOT NULL").select("index_name", F.col("after").alias("version"), "doc_id", "digest")
    key = ["index_name", "version", "doc_id"]
    came = new.exceptAll(old).select(*key, F.lit(True).alias("came"))
    went = old.exceptAll(new).select(*key, F.lit(True).alias("went"))
    return came.join(went, key, "full").select(
        *key,
        F.when(F.col("went").isNull(), "added").when(F.col("came").isNull(), "removed").otherwise("changed").alias("change"),
    )
