"""Readers and writers: event logs, result tables, snapshots, probe reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens import schemas

PROVENANCE = ("REAL", "MIXED", "SIMULATED")
LABEL, NOTE = "provenance", "provenance_note"


def read_event_log(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(schemas.EVENT_LOG).option("header", True).csv(path)


def stream_event_log(spark: SparkSession, path, max_files: int = 64) -> DataFrame:
    """The event log as a stream; ``max_files`` bounds what one trigger holds."""
    return (spark.readStream.schema(schemas.EVENT_LOG).option("header", True)
            .option("maxFilesPerTrigger", max_files).csv(path))


def write_event_log(df: DataFrame, path: str) -> None:
    """CSV in the log's column order; durations carry 3 decimals, the factor 4."""
    out = df.select(
        "t_ms", "event", "task_id", "worker_id", "unit_count",
        F.format_string("%.3f", "duration_ms").alias("duration_ms"),
        F.format_string("%.3f", "predicted_ms").alias("predicted_ms"),
        F.format_string("%.4f", "correction").alias("correction"),
        "speculative")
    out.write.option("header", True).csv(path)


def read_result_table(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """CSV below a block of ``#`` lines. The label in the block, if any, is
    attached to each row of its file (join on the file name, one row per file)."""
    rows = (spark.read.schema(schema).option("header", True).option("comment", "#").csv(path)
            .withColumn("source_file", F.col("_metadata.file_path")))
    head = (spark.read.text(path)
            .where(F.col("value").startswith("#"))
            .select(F.col("_metadata.file_path").alias("f"),
                    F.regexp_extract("value", r"PROVENANCE: *([A-Z]+)", 1).alias("label"),
                    F.regexp_extract("value", r"rev=(\S+)", 1).alias("rev"))
            .groupBy("f").agg(F.max(F.nullif("label", F.lit(""))).alias(LABEL),
                              F.max(F.nullif("rev", F.lit(""))).alias("rev")))
    return rows.join(head, rows["source_file"] == head["f"], "left").drop("f")


def _check_label(label) -> str:
    if label not in PROVENANCE:
        raise ValueError(f"provenance must be one of {', '.join(PROVENANCE)}, not {label!r}")
    return label


def write_with_provenance(df: DataFrame, path: str, label: str = "SIMULATED", note: str | None = None) -> None:
    """Parquet whose rows carry where the numbers come from."""
    _check_label(label)
    (df.withColumn(LABEL, F.lit(label)).withColumn(NOTE, F.lit(note).cast("string"))
     .write.parquet(path))


def write_result_table(df: DataFrame, path: str, name: str, label: str = "SIMULATED", note: str | None = None,
                       rev: str = "unknown") -> None:
    """CSV whose every file opens with the ``#`` block naming the table, the
    revision and the label; :func:`read_result_table` reads it back."""
    _check_label(label)
    head = [f"# {name}", f"# rev={rev}", f"# PROVENANCE: {label}", *([f"# {note}"] if note else []), ",".join(df.columns)]

    def with_head(batches):
        opened = False
        for pdf in batches:
            if len(pdf):
                yield pdf if opened else pd.DataFrame({"value": [*head, *pdf["value"]]})
                opened = True
        if not opened:  # an empty table keeps its label
            yield pd.DataFrame({"value": head})
    lines = df.select(F.to_csv(F.struct(*df.columns)).alias("value"))
    lines.mapInPandas(with_head, "value string").write.text(path)


def require_provenance(df: DataFrame) -> DataFrame:
    """Refuse a table without a valid label on each row."""
    if LABEL not in df.columns:
        raise ValueError("table has no provenance label")
    bad = df.where(F.col(LABEL).isNull() | ~F.col(LABEL).isin(*PROVENANCE)).limit(1)
    if bad.count():
        raise ValueError("table has rows without a valid provenance label")
    return df


def read_snapshots(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(schemas.SNAPSHOT).json(path)


def explode_fleet(snap: DataFrame) -> DataFrame:
    return snap.select("timestamp_ms", F.inline("fleet"))


def explode_states(snap: DataFrame) -> DataFrame:
    pairs = F.arrays_zip(F.col("state_names").alias("state"), F.col("tasks_by_state").alias("count"))
    return snap.select("timestamp_ms", F.inline(pairs))


def parse_probe_reports(reports: DataFrame) -> DataFrame:
    """(report, text) -> one row per 32-bit word: report, kernel, pos, bits.

    A report is one section per kernel, ``kernel=NAME key=value ...`` followed
    by lines of hex; eight digits are one little-endian word.
    """
    found = F.split(F.concat(F.lit("\n"), "text"), r"\nkernel=")
    sections = reports.select("report", F.explode(F.slice(found, F.lit(2), F.size(found))).alias("s"))
    parts = sections.select(
        "report",
        F.regexp_extract("s", r"^(\S+)", 1).alias("kernel"),
        F.regexp_extract("s", r"^[^\n]*fnv1a=(\S+)", 1).alias("fingerprint"),
        F.regexp_extract("s", r"^[^\n]*match=(\S+)", 1).alias("self_check"),
        F.array_join(F.regexp_extract_all("s", F.lit(r"(?m)^([0-9a-f]+)\r?$"), 1), "").alias("hex"))
    words = parts.select("report", "kernel", "fingerprint", "self_check",
                         F.posexplode_outer(F.regexp_extract_all("hex", F.lit("([0-9a-f]{8})"), 1)).alias("pos", "w"))
    big_endian = F.concat(*[F.substring("w", i, 2) for i in (7, 5, 3, 1)])
    return words.select("report", "kernel", "fingerprint", "self_check", F.col("pos").cast("long").alias("pos"),
                        F.conv(big_endian, 16, 10).cast("long").alias("bits"))


def read_probe_reports(spark: SparkSession, paths) -> DataFrame:
    raw = spark.read.text(paths, wholetext=True)
    return parse_probe_reports(raw.select(F.col("_metadata.file_name").alias("report"), F.col("value").alias("text")))


# The kernels' comparison class, tolerances and cost per unit.
KERNELS = [
    ("brute_search_v1", "exact", 0.0, 0.0, 32, "u32", False, 0, 80, 400000),
    ("pathtrace_tile_v1", "statistical", 0.0, 0.0, 65536, "f32", True, 32768, 20480000, 7143),
    ("calibrate_v1", "tolerant", 1e-5, 1e-6, 4, "f32", False, 0, 2, 0),
]
KERNEL_SCHEMA = ("kernel_id string, determinism string, rel_eps double, abs_eps double, output_bytes long, "
                 "output_dtype string, accumulates boolean, min_iterations long, flop_per_unit long, "
                 "r5_min_units long")


def kernel_dim(spark: SparkSession) -> DataFrame:
    """Three fixed rows; safe to broadcast."""
    return spark.createDataFrame(KERNELS, KERNEL_SCHEMA)


def with_kernel(df: DataFrame, kernel_col: str = "kernel_id") -> DataFrame:
    dim = kernel_dim(df.sparkSession).withColumnRenamed("kernel_id", kernel_col)
    return df.join(F.broadcast(dim), kernel_col, "left")
