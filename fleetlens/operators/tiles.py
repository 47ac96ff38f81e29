"""Image tiles: accumulation, coverage, mosaic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.exprs import is_finite, tile_at, tone_map


@dataclass(frozen=True)
class Grid:
    image_w: int
    image_h: int
    tile_w: int = 64
    tile_h: int = 64

    @property
    def tile_count(self) -> int:
        if not self.tile_w or not self.tile_h:
            return 0
        return -(-self.image_w // self.tile_w) * -(-self.image_h // self.tile_h)

    def tiles(self, spark: SparkSession) -> DataFrame:
        """(tile, x, y, w, h) of every tile, missing ones included."""
        t = spark.range(self.tile_count).withColumnRenamed("id", "tile")
        at = tile_at(F.col("tile"), self.image_w, self.image_h, self.tile_w, self.tile_h)
        return t.withColumn("at", at).select("tile", "at.*")


def accumulate(samples: DataFrame) -> DataFrame:
    """Disjoint sample ranges of a pixel add up."""
    return samples.groupBy("tile", "pixel").agg(*[F.sum(c).alias(c) for c in ("r", "g", "b", "samples")])


def newest_uploads(uploads: DataFrame, grid: Grid) -> DataFrame:
    """(tile, upload, samples, x, y, w, h): the latest upload of the right size
    per tile. An upload replaces the one before it; one of a wrong size is
    dropped. The count comes from the first pixel."""
    spark = uploads.sparkSession
    n0 = F.when(F.col("pixel") == 0, F.col("samples"))
    sized = uploads.groupBy("tile", "upload").agg(
        F.count(F.lit(1)).alias("pixels"), F.max(n0).alias("n0"))
    ok = sized.join(grid.tiles(spark), "tile").where(F.col("pixels") == F.col("w") * F.col("h"))
    good = F.when(is_finite(F.col("n0")) & (F.col("n0") > 0), F.col("n0").cast("double")).otherwise(F.lit(0.0))
    return ok.groupBy("tile").agg(F.max_by(F.struct("upload", good.alias("samples"), "x", "y", "w", "h"), "upload")
                                  .alias("u")).select("tile", "u.*")


def tile_samples(uploads: DataFrame, grid: Grid) -> DataFrame:
    """Min over all tiles (missing ones are 0), max over present ones, tiles
    with data, and the least sampled tile (lowest index on ties)."""
    have = newest_uploads(uploads, grid).select("tile", "samples")
    all_ = grid.tiles(uploads.sparkSession).select("tile").join(have, "tile", "left")
    s = F.coalesce("samples", F.lit(0.0))
    return all_.agg(
        F.coalesce(F.min(s), F.lit(0.0)).alias("min_samples"), F.coalesce(F.max(s), F.lit(0.0)).alias("max_samples"),
        F.count_if(F.col("samples").isNotNull()).alias("tiles_with_data"), F.count(F.lit(1)).alias("tiles"),
        F.coalesce(F.min_by("tile", F.struct(s, F.col("tile"))), F.lit(0)).alias("least_sampled"))


def mosaic(uploads: DataFrame, grid: Grid, exposure: float = 1.0) -> DataFrame:
    """(x, y, red, green, blue, alpha) of the whole image; pixels of tiles
    without samples are opaque black."""
    spark = uploads.sparkSession
    newest = newest_uploads(uploads, grid).where("samples > 0").withColumnRenamed("samples", "n")
    px = uploads.select("tile", "upload", "pixel", "r", "g", "b").join(newest, ["tile", "upload"])
    shown = {}
    for c, name in (("r", "red"), ("g", "green"), ("b", "blue")):
        v = F.when(is_finite(F.col(c)), F.col(c)).otherwise(F.lit(0.0)).cast("double")
        shown[name] = tone_map(v * (F.lit(1.0) / F.col("n")), exposure)
    lit = px.select((F.col("x") + F.col("pixel") % F.col("w")).alias("x"),
                    (F.col("y") + F.floor(F.col("pixel") / F.col("w"))).alias("y"),
                    *[v.alias(n) for n, v in shown.items()])
    size = grid.image_w * grid.image_h
    canvas = spark.range(size).select((F.col("id") % grid.image_w).alias("x"),
                                      F.floor(F.col("id") / grid.image_w).alias("y"))
    black = F.lit(0).cast("long")
    return canvas.join(lit, ["x", "y"], "left").select(
        "x", "y", *[F.coalesce(n, black).alias(n) for n in shown], F.lit(255).cast("long").alias("alpha"))
