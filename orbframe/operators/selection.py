"""Exact quantiles by distributed selection, and mergeable sketches of ranges.

``quantiles`` gives what ``F.percentile`` gives, without one map of all values per group.
Equal values are counted before the shuffle. A fixed, monotone function puts doubles into
buckets (1024 for each power of two), whose counts say in which bucket each wanted rank
lies; the values of those buckets alone are sorted. A group of any size is spread over
its buckets, and nothing has to fit into memory.

``sketched`` keeps a quantile sketch per frame as a row. Sketches of any frames merge, so
ranges of chunks and clips need no pixel to move.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets between a power of two and the next.
FINE = 1024
#: Size parameter of sketches; a sketch is a few KB whatever it has seen.
K = 800
#: Rank error that quantiles of such sketches stay within: about four times what 99 % of them have.
ERROR = 0.0133


def coarse(v: Column) -> Column:
    """A long that doesn't fall where ``v`` rises: exponent and ten bits of the mantissa. NaN comes last."""
    size = F.abs(v)
    guess = F.floor(F.log2(size))
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    # the logarithm may be rounded over a power of two; powers of two are exact
    exponent = guess + F.when(size >= power(guess + 1), 1).when(size < power(guess), -1).otherwise(0)
    place = (exponent + 1075) * FINE + F.floor((size / power(exponent) - 1.0) * FINE)
    last = F.lit(2**40)
    return F.when(F.isnan(v), last).when(size == float("inf"), F.signum(v).cast("long") * (last - 1)).when(v == 0, F.lit(0).cast("long")).otherwise(F.signum(v).cast("long") * place)


def quantiles(df: DataFrame, keys: list[str], value: str, points: list[float], name: str = "q") -> DataFrame:
    """``keys`` and an array of the interpolated quantiles at ``points``; null for a group without values.

    Rows with a null in ``keys`` belong to no group.
    """
    v = F.col(value).cast("double")
    counted = df.groupBy(*keys, coarse(v).alias("_b"), v.alias("_v")).agg(F.count(v).alias("_n"))
    held = counted.groupBy(*keys, "_b").agg(F.sum("_n").alias("_m"))
    so_far = Window.partitionBy(*keys).orderBy(F.col("_b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumns({"_upto": F.sum("_m").over(so_far), "_all": F.sum("_m").over(Window.partitionBy(*keys))})
    at = lambda p: F.lit(float(p)) * (F.col("_all") - 1)
    ranks = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), f(at(p)).cast("long").alias("rank"), at(p).alias("at")) for i, p in enumerate(points) for side, f in ((0, F.floor), (1, F.ceil))))
    here = F.filter(ranks, lambda r: (r["rank"] >= F.col("_upto") - F.col("_m")) & (r["rank"] < F.col("_upto")))
    wanted = held.select(*keys, "_b", (F.col("_upto") - F.col("_m")).alias("_base"), here.alias("_ranks")).where(F.size("_ranks") > 0)
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = counted.where("_b is not null").join(wanted, [*keys, "_b"]).withColumn("_to", F.col("_base") + F.sum("_n").over(inside))
    found = near.select(*keys, "_v", F.explode(F.filter("_ranks", lambda r: (r["rank"] >= F.col("_to") - F.col("_n")) & (r["rank"] < F.col("_to")))).alias("_r"))
    found = found.select(*keys, "_v", "_r.i", "_r.side", "_r.rank", "_r.at")
    bare = held.where("_b is null").select(*keys, *(F.lit(None).cast(t).alias(c) for c, t in (("_v", "double"), ("i", "int"), ("side", "int"), ("rank", "long"), ("at", "double"))))
    ends = found.unionByName(bare).groupBy(*keys).agg(*(
        F.max(F.when((F.col("i") == i) & (F.col("side") == side), F.struct("_v", "rank", "at"))).alias(f"_{i}_{side}") for i in range(len(points)) for side in (0, 1)))

    def between(i):
        low, high = F.col(f"_{i}_0"), F.col(f"_{i}_1")
        mixed = (high["rank"] - low["at"]) * low["_v"] + (low["at"] - low["rank"]) * high["_v"]
        return F.when((low["rank"] == high["rank"]) | (low["_v"] == high["_v"]), low["_v"]).otherwise(mixed)

    return ends.select(*keys, F.array(*(between(i) for i in range(len(points)))).alias(name))


def sketched(df: DataFrame, keys: list[str], value: str = "d", k: int = K) -> DataFrame:
    """``keys, sketch``: one row a group, made by partial sketches where the values lie."""
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of finer groups as one for each of ``keys``."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def ranges_of(sketches: DataFrame, points: list[float]) -> DataFrame:
    """``lo`` and ``hi`` (the quantiles at two ``points``) in place of ``sketch``."""
    low, high = (F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for p in points)
    return sketches.withColumns({"lo": low, "hi": high}).drop("sketch")


def ranks(df: DataFrame, per_frame: DataFrame, keys: list[str], value: str = "d") -> DataFrame:
    """The share of a group's values that are at most ``lo`` and at most ``hi``, exactly.

    ``per_frame`` has a frame's ``clip, f``, its group's ``keys`` and ``lo, hi``; values
    are counted frame by frame, so they meet their range where the frame lies.
    """
    frame = ["clip", "f"]
    at_most = lambda end: F.sum((F.col(value) <= F.col(end)).cast("long")).alias(f"_{end}")
    counted = df.select(*frame, value).repartition(*frame).join(per_frame.hint("shuffle_hash"), frame).groupBy(*frame, *[k for k in keys if k not in frame], "lo", "hi").agg(at_most("lo"), at_most("hi"), F.count(value).alias("_n"))
    total = counted.groupBy(*keys, "lo", "hi").agg(F.sum("_n").alias("n"), *(F.sum(f"_{e}").alias(f"_{e}") for e in ("lo", "hi")))
    return total.select(*keys, "lo", "hi", "n", (F.col("_lo") / F.col("n")).alias("rank_lo"), (F.col("_hi") / F.col("n")).alias("rank_hi"))
