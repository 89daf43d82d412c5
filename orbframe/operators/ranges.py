"""Normalisation ranges and the two-level ordered scan behind them."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbframe import FRAME
from orbframe.operators import selection

# Percentiles of the robust range, sample stride, range smoothing.
LOW, HIGH, STRIDE, ALPHA = 0.01, 0.99, 16, 0.05
#: Longest segment of an ordered scan.
SEGMENT = 1 << 20


def strided(df: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Every ``stride``-th row and column; a plain filter that reaches the scan."""
    return df.filter((F.col("y") % stride == 0) & (F.col("x") % stride == 0))


def robust_range(
    df: DataFrame, keys: list[str] = FRAME, value: str = "d", approx: int | None = None
) -> DataFrame:
    """1st and 99th percentile per group, interpolated; ``approx`` takes an accuracy.

    Exact ones are selected by rank (``selection``). Frames are selected from where their
    pixels lie; other groups may be of any size and are spread over buckets of values.
    """
    if approx:
        pair = df.groupBy(*keys).agg(F.percentile_approx(value, F.array(F.lit(LOW), F.lit(HIGH)), approx).alias("q"))
    else:
        pair = selection.quantiles(df.repartition(*keys) if keys == FRAME else df, keys, value, [LOW, HIGH])
    return pair.select(*keys, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def frame_range(df: DataFrame, stride: int = 1, keys: list[str] = FRAME) -> DataFrame:
    """Full-frame percentiles, as stills and previews use them."""
    return robust_range(df if stride == 1 else strided(df, stride), keys)


def unit(d: Column, lo: Column, hi: Column) -> Column:
    """Scale into [0, 1] by a given range; an empty range gets a width of 1e-6."""
    top = F.when(hi <= lo, lo + 1e-6).otherwise(hi)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (d - lo) / (top - lo)))


def attach(df: DataFrame, per_group: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join one row per group onto pixels.

    The groups are the build side and the pixels stream past: size estimates
    do not see how many pixels an array explodes into, and a plan that builds
    on the pixels would be ruinous. Pixels are shuffled by their group, which
    the operators that follow need anyway.
    """
    return df.repartition(*keys).join(per_group.hint("shuffle_hash"), keys, how)


def normalise(df: DataFrame, ranges: DataFrame, keys: list[str] = FRAME, value: str = "d") -> DataFrame:
    """Scale each group by its range."""
    return attach(df, ranges, keys).withColumn(value, unit(F.col(value), F.col("lo"), F.col("hi"))).drop("lo", "hi")


def ranked(df: DataFrame, key: list[str], order: list[str], bucket: Column, name: str = "k") -> DataFrame:
    """Row number within ``key`` by ``order``, computed bucket by bucket.

    ``bucket`` must grow with ``order``. Only counts per bucket meet in one
    window, so a key holding a third of all rows still ranks in parallel.
    """
    cut = df.withColumn("_b", bucket)
    local = cut.withColumn(name, F.row_number().over(Window.partitionBy(*key, "_b").orderBy(*order)) - 1)
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy(*key, "_b").agg(F.count(F.lit(1)).alias("_n")).select(
        *key, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    return local.join(base, [*key, "_b"]).withColumn(name, F.col(name) + F.col("_base")).drop("_b", "_base")


def running_total(df: DataFrame, key: list[str], order: list[str], bucket: Column, value: str, name: str) -> DataFrame:
    """Running sum within ``key`` by ``order`` with the same two levels."""
    cut = df.withColumn("_b", bucket)
    inside = Window.partitionBy(*key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy(*key, "_b").agg(F.sum(value).alias("_s")).select(
        *key, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base")
    )
    return (
        cut.withColumn(name, F.sum(value).over(inside))
        .join(base, [*key, "_b"])
        .withColumn(name, F.col(name) + F.col("_base"))
        .drop("_b", "_base")
    )


def smoothed(df: DataFrame, key: list[str], values: list[str], alpha: float = ALPHA, rank: str = "k") -> DataFrame:
    """Exponential average along ``rank`` (0, 1, 2, ..) within ``key``.

    The recurrence is linear, so it splits exactly: each segment of ranks sums
    its own weighted values, a state is carried from segment to segment, and
    is added back with its decay. Segments are as long as their weights stay
    small numbers; by then a state has decayed by 10^-12, and after a few
    dozen segments it is below what a double can hold, so the carry needs only
    those. No task holds more than one segment, or a few rows per segment.
    """
    keep = 1.0 - alpha
    rate = -math.log(max(keep, 1e-12)) or 1e-9
    length = max(1, min(SEGMENT, int(27.0 / rate)))
    reach = math.ceil(745.0 / (length * rate))
    cut = df.withColumns({"_s": F.floor(F.col(rank) / length), "_p": F.col(rank) % length})
    inside = Window.partitionBy(*key, "_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    grown = lambda v: F.col(v) * F.pow(F.lit(keep), -F.col("_p")) * alpha
    part = cut.withColumns({f"_{v}": F.sum(grown(v)).over(inside) for v in values})

    fade = keep**length
    before = Window.partitionBy(*key).orderBy("_s").rowsBetween(-reach, -1)
    ends = cut.groupBy(*key, "_s").agg(
        *[(F.sum(grown(v)) * keep ** (length - 1)).alias(f"w_{v}") for v in values],
        *[F.min_by(v, "_p").alias(f"f_{v}") for v in values],
    )
    # The very first value counts as the state before the first segment.
    own = lambda v: F.col(f"w_{v}") + F.when(F.col("_s") == 0, fade * F.col(f"f_{v}")).otherwise(F.lit(0.0))
    fold = lambda v: F.aggregate(F.collect_list(own(v)).over(before), F.lit(0.0), lambda acc, w: acc * fade + w)
    carried = ends.select(
        *key, "_s", *[F.when(F.col("_s") == 0, F.col(f"f_{v}")).otherwise(fold(v)).alias(f"i_{v}") for v in values]
    )
    decay = F.pow(F.lit(keep), F.col("_p"))
    return (
        part.join(carried, [*key, "_s"])
        .withColumns({v: decay * (keep * F.col(f"i_{v}") + F.col(f"_{v}")) for v in values})
        .select(*df.columns)
    )


def moving_range(ranges: DataFrame, alpha: float = ALPHA, clip: str = "clip", order: str = "f") -> DataFrame:
    """Slow-moving range per clip: the first frame sets it, later ones pull it."""
    bucket = F.floor(F.col(order) / 512)
    k = ranked(ranges, [clip], [order], bucket)
    return smoothed(k, [clip], ["lo", "hi"], alpha).drop("k")


def moving_normalise(df: DataFrame, stride: int = STRIDE, alpha: float = ALPHA) -> DataFrame:
    """Video path: strided sample, per-frame range, moving range, scale."""
    return normalise(df, moving_range(frame_range(df, stride), alpha))
