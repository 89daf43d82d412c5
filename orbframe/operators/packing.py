"""Packing both eyes into one frame, unpacking, and area-weighted resizing."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbframe import FRAME
from orbframe.functions import media


def stack_eyes(eyes: DataFrame, h: int) -> DataFrame:
    """Left eye over right eye. ``eyes`` has one row per pixel and ``eye``."""
    y = F.when(F.col("eye") == "left", F.col("y")).otherwise(F.col("y") + h)
    return eyes.withColumn("y", y).drop("eye")


def side_by_side(eyes: DataFrame, w: int, yaw: float = 0.0) -> DataFrame:
    """The 180-degree field around ``yaw`` of each eye, left then right.

    A column range that may wrap round the seam: no resampling.
    """
    x0, half = media.half_field(F.lit(w), F.lit(yaw))
    x = F.pmod(F.col("x") - x0, F.lit(w))
    return (
        eyes.withColumn("x", x.cast("int")).filter(F.col("x") < half)
        .withColumn("x", F.when(F.col("eye") == "left", F.col("x")).otherwise(F.col("x") + half).cast("int"))
        .drop("eye")
    )


def unpack_stacked(df: DataFrame, h: int) -> DataFrame:
    """Stacked frame of height ``2h`` back to eyes."""
    return df.withColumn("eye", F.when(F.col("y") < h, "left").otherwise("right")).withColumn(
        "y", F.when(F.col("y") < h, F.col("y")).otherwise(F.col("y") - h)
    )


def unpack_side_by_side(df: DataFrame, half: int) -> DataFrame:
    """Side-by-side frame back to eyes of width ``half``."""
    return df.withColumn("eye", F.when(F.col("x") < half, "left").otherwise("right")).withColumn(
        "x", F.when(F.col("x") < half, F.col("x")).otherwise(F.col("x") - half)
    )


def area_resize(df: DataFrame, w: int, h: int, ow: int, oh: int, values: list[str], keys: list[str] = FRAME) -> DataFrame:
    """Shrink by pixel area: each source pixel is shared among the output
    cells it overlaps, in proportion. Sums combine before the shuffle."""

    def shares(axis, n, m):
        s = n / m
        cells = F.sequence(F.floor(F.col(axis) / s), F.least(F.ceil((F.col(axis) + 1) / s) - 1, F.lit(m - 1)))
        part = lambda j: F.least(F.col(axis) + 1.0, (j + 1) * s) - F.greatest(F.col(axis).cast("double"), j * s)
        return F.transform(cells, lambda j: F.struct(j.cast("int").alias("j"), part(j).alias("p")))

    return (
        df.withColumn("_x", F.explode(shares("x", w, ow))).withColumn("_y", F.explode(shares("y", h, oh)))
        .groupBy(*keys, F.col("_y.j").alias("y"), F.col("_x.j").alias("x"))
        .agg(*[(F.sum(F.col(v) * F.col("_x.p") * F.col("_y.p")) / F.sum(F.col("_x.p") * F.col("_y.p"))).alias(v) for v in values])
    )
