"""What all versions of a text share, and what each has of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.functions.text import clean_snippet, normalize_query
from gleanframe.functions.vectors import add_scaled


def white_space_key(line: Column) -> Column:
    """Lines that differ only in white space are one."""
    return normalize_query(line)


def version_lines(groups: DataFrame) -> DataFrame:
    """``group_id, version_no, pos, line`` of the lines that aren't blank, after cleaning."""
    lines = groups.select("group_id", "version_no", F.posexplode(F.split(clean_snippet("text"), "\n", -1)).alias("pos", "line"))
    return lines.where(normalize_query("line") != "")


def line_parts(groups: DataFrame, key_fn: Callable[[Column], Column] = white_space_key) -> DataFrame:
    """``group_id, version_no, pos, line, key, is_core``: a line is core if its key occurs
    in every version of its group. Of core lines with one key in a version only the
    first is kept; delta lines are all kept."""
    lines = version_lines(groups).withColumn("key", key_fn(F.col("line")))
    many = groups.groupBy("group_id").agg(F.countDistinct("version_no").alias("n"))
    spread = lines.groupBy("group_id", "key").agg(F.countDistinct("version_no").alias("m"))
    core = spread.join(many, "group_id").select("group_id", "key", (F.col("m") == F.col("n")).alias("is_core"))
    met = lines.join(core, ["group_id", "key"])
    nth = F.row_number().over(Window.partitionBy("group_id", "version_no", "key").orderBy("pos"))
    return met.withColumn("nth", nth).where(~F.col("is_core") | (F.col("nth") == 1)).drop("nth")


def stable_core_and_delta(groups: DataFrame, key_fn: Callable[[Column], Column] = white_space_key) -> DataFrame:
    """``group_id, version_no, core, delta`` of every version: its core and its own lines,
    each in their order, joined by line ends."""
    parts = line_parts(groups, key_fn)

    def joined(which: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("pos", "line")))), lambda x: x["line"]), "\n")

    made = parts.groupBy("group_id", "version_no").agg(joined(F.col("is_core")).alias("core"), joined(~F.col("is_core")).alias("delta"))
    every = groups.select("group_id", "version_no").distinct().join(made, ["group_id", "version_no"], "left")
    return every.select("group_id", "version_no", F.coalesce("core", F.lit("")).alias("core"), F.coalesce("delta", F.lit("")).alias("delta"))


def evolved_vectors(groups: DataFrame, embed, delta_weight: float = 1.0, key_fn: Callable[[Column], Column] = white_space_key) -> DataFrame:
    """``group_id, version_no, vec``: the vector of the whole text plus ``delta_weight``
    times that of its own lines, made length one. A version without lines of its own,
    or a weight of 0, keeps the vector of the text. Only deltas with text are encoded."""
    keys = ["group_id", "version_no"]
    base = embed(groups, keys, "text")
    if delta_weight == 0:
        return base
    own = embed(stable_core_and_delta(groups, key_fn).where("delta != ''"), keys, "delta").withColumnRenamed("vec", "own")
    met = base.join(own, keys, "left")
    return met.select(*keys, F.when(F.col("own").isNull(), F.col("vec")).otherwise(add_scaled(F.col("vec"), F.col("own"), delta_weight)).alias("vec"))
