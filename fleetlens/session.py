"""Session settings shared by the library: lineage cuts and size checks."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# A group with more rows than this is split over several tasks by
# fleetlens.operators.ordered; smaller ones use a plain window.
HOT_ROWS_CONF = "spark.fleetlens.hotRows"
HOT_ROWS = 1_000_000


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is used only when the setting is absent *and* the
    session runs in local mode; on a cluster a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return sc.getCheckpointDir() or _own_folder()


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="fleetlens-checkpoint-")


@functools.cache
def _archive() -> str:
    """This package as a zip file."""
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="fleetlens-package-"), "fleetlens.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in sorted(os.walk(here)):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.relpath(full, os.path.dirname(here)))
    return path


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application: functions sent to them refer to it by name."""
    sc = spark.sparkContext
    if not any(f.endswith("/fleetlens.zip") for f in sc.listFiles):
        sc.addPyFile(_archive())


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to reliable storage and continue from the copy."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table under ``spark.checkpoint.dir`` and continue from the copy.

    Unlike a checkpoint it is computed once, and the optimiser knows its size."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/fleetlens-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Buckets:
    """A table under ``spark.checkpoint.dir`` filed by the hash of one column; rows may be added to it.

    Windows and groupings by that column, and joins on it, then need no shuffle. ``read`` gives the rows added so far, or
    later ones too, and stays valid after ``close``, which takes the name out of the catalog and leaves the files."""

    def __init__(self, df: DataFrame, by: str, label: str):
        self.spark, self.by, self.n = df.sparkSession, by, shuffle_partitions(df.sparkSession)
        self.name = f"fleetlens_{label}_{uuid.uuid4().hex}"
        self.path = f"{checkpoint_dir(self.spark).rstrip('/')}/{self.name}"
        self.add(df)

    def add(self, df: DataFrame) -> None:
        (df.repartition(self.n, self.by).write.format("parquet").mode("append").bucketBy(self.n, self.by)
         .option("path", self.path).saveAsTable(self.name))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def join_where_they_lie(spark: SparkSession) -> None:
    """Until the next ``tune``, rows that lie by one key are not shuffled for a join on it and others."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def tune(spark: SparkSession) -> None:
    """Runtime settings the operators count on, and this package for Python workers."""
    ship_package(spark)
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a skewed join even where the aggregation after it then needs a shuffle.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # As Spark has it, whatever ``join_where_they_lie`` set for an earlier query.
        "spark.sql.requireAllClusterKeysForCoPartition": "true",
        # Merge the sessions of a key in each task before they are shuffled.
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    }.items():
        spark.conf.set(k, v)
