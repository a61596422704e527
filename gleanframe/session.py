"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; only where it is
    unset (tests, a laptop) a local one is made and set."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not there:
        if sc.getCheckpointDir() is None and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        there = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="gleanframe-")
        spark.conf.set("spark.checkpoint.dir", there)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(there)
    return there


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and go on from what was written, so a lost
    executor costs a re-read and not the work before it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once per context, unless they share the
    driver's PYTHONPATH and it names the package's folder."""
    root = Path(__file__).resolve().parents[1]
    sc = spark.sparkContext
    if str(root) not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and not getattr(sc, "_gleanframe_shipped", False):
        target = Path(tempfile.mkdtemp(prefix="gleanframe-")) / "gleanframe.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in (root / "gleanframe").rglob("*.py"):
                z.write(p, p.relative_to(root))
        sc.addPyFile(str(target))
        sc._gleanframe_shipped = True
    return spark


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def local_session(cpus: int = 8, app: str = "gleanframe") -> SparkSession:
    """A local session for tests and the bench."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def blank(col: str):
    """Text with null read as empty, as every text operator takes it."""
    return F.coalesce(F.col(col), F.lit(""))
