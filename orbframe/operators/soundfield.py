"""Ambisonic rotation and its checks. Channels are ACN-ordered arrays ``ch``."""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def yaw_terms(order: int, yaw: float) -> list[tuple[int, int, float]]:
    """Non-zero entries ``(out, in, gain)`` of the mixing matrix, 16x16 at most.

    Channels with m = 0 stay; each (+m, -m) pair turns by m times the yaw.
    """
    if not 1 <= order <= 3:
        raise ValueError(f"ambisonic order {order} is not 1, 2 or 3")
    terms = []
    for n in range((order + 1) ** 2):
        degree = math.isqrt(n)
        m = n - degree * degree - degree
        angle = math.radians(yaw) * m
        terms.append((n, n, math.cos(angle)))
        if m:
            terms.append((n, n - 2 * m, -math.sin(angle)))
    return terms


def yaw_matrix(spark: SparkSession, order: int, yaw: float) -> DataFrame:
    """The mixing matrix as rows ``(out_ch, in_ch, g)``, zeros included."""
    n = (order + 1) ** 2
    gains = {(o, i): g for o, i, g in yaw_terms(order, yaw)}
    rows = [(o, i, float(gains.get((o, i), 0.0))) for o in range(n) for i in range(n)]
    return spark.createDataFrame(rows, "out_ch int, in_ch int, g double")


def rotate(df: DataFrame, order: int, yaw: float, ch: str = "ch") -> DataFrame:
    """Turn the field; each output channel mixes at most two inputs, so the
    mix is an array expression and samples never leave their row."""
    mix: dict[int, Column] = {}
    for o, i, g in yaw_terms(order, yaw):
        part = F.col(ch)[i] * g
        mix[o] = mix[o] + part if o in mix else part
    return df.withColumn(ch, F.array(*[mix[o] for o in sorted(mix)]))


def bearing(df: DataFrame, keys: list[str], degree: int = 1, ch: str = "ch") -> DataFrame:
    """Azimuth a degree's channel pair gives against the omni channel."""
    base = degree * degree + degree
    dot = lambda k: F.sum(F.col(ch)[k] * F.col(ch)[0])
    return df.groupBy(*keys).agg(F.degrees(F.atan2(dot(base - 1), dot(base + 1))).alias("bearing"))


def wrap_degrees(deg: Column) -> Column:
    return F.pmod(deg + 180.0, F.lit(360.0)) - 180.0


def energy(df: DataFrame, keys: list[str], ch: str = "ch") -> DataFrame:
    """Root of the total energy over all channels."""
    total = F.aggregate(ch, F.lit(0.0), lambda a, v: a + v * v)
    return df.groupBy(*keys).agg(F.sqrt(F.sum(total)).alias("loudness"))


def loudness_kept(before: DataFrame, after: DataFrame, keys: list[str], tolerance: float = 1e-4) -> DataFrame:
    """Loudness of both and whether they agree within a relative tolerance."""
    a = energy(before, keys).withColumnRenamed("loudness", "before")
    b = energy(after, keys).withColumnRenamed("loudness", "after")
    return a.join(b, keys).withColumn("kept", F.abs(F.col("after") - F.col("before")) <= tolerance * F.abs(F.col("before")))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product of two ``(out_ch, in_ch, g)`` relations."""
    left = a.select(F.col("out_ch"), F.col("in_ch").alias("k"), F.col("g").alias("ga"))
    right = b.select(F.col("out_ch").alias("k"), F.col("in_ch"), F.col("g").alias("gb"))
    return left.join(right, "k").groupBy("out_ch", "in_ch").agg(F.sum(F.col("ga") * F.col("gb")).alias("g"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("in_ch").alias("out_ch"), F.col("out_ch").alias("in_ch"), "g")


def off_identity(m: DataFrame) -> DataFrame:
    """Largest departure of a matrix from the identity."""
    return m.agg(F.max(F.abs(F.col("g") - (F.col("out_ch") == F.col("in_ch")).cast("double"))).alias("worst"))


def channel_map(df: DataFrame, keys: list[str], channels: int, sent: str = "sent", got: str = "got") -> DataFrame:
    """Which input channel each output channel carries, by correlation.

    Each output channel is a row beside the array of inputs, so one aggregate
    with a correlation per input reads the samples once and combines early.
    """
    each = df.select(*keys, F.col(sent).alias("_s"), F.posexplode(got).alias("out_ch", "_g"))
    per = each.groupBy(*keys, "out_ch").agg(F.array(*[F.abs(F.corr("_g", F.col("_s")[i])) for i in range(channels)]).alias("c"))
    ranked = F.transform("c", lambda c, i: F.struct(F.coalesce(c, F.lit(-1.0)).alias("c"), (-i).alias("i")))
    return per.select(*keys, "out_ch", (-F.array_max(ranked)["i"]).alias("in_ch"))
