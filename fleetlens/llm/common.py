"""Helpers shared by the corpus operators."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import checkpoint_dir

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: Words between ASCII blanks.
BLANK_WORD = r"[^\x20\x09-\x0D]+"

#: Largest side, in rows, that is sent whole to every executor. Every caller's rows are short (ids and
#: fingerprints); a side with more rows is shuffled instead.
BROADCAST_ROWS = 200_000


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder's path under ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/fleetlens-{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once under ``spark.checkpoint.dir`` and go on from the copy.

    The copy outlives lost executors and ends the lineage; it goes with the folder.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have at most ``limit`` rows, else as it is.

    ``df`` should be a written table, as its rows are counted here.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as make it differ from every column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` standing for ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)
