"""Frames, pixels, blocks and bilinear taps."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbframe import FRAME
from orbframe.functions import sphere

#: Largest geometry table handed to every task. Its row count is known from
#: the image sizes when the plan is built, so the bound is exact.
BROADCAST_ROWS = 500_000


def by_frame(df: DataFrame) -> DataFrame:
    """One shuffle that serves every later join, window and group of a frame."""
    return df.repartition(*FRAME)


def pin(df: DataFrame, cols: dict) -> DataFrame:
    """Add columns that later steps use many times.

    A one-row ``inline`` is a boundary the optimiser does not merge across, so
    an expression is evaluated once and not copied into every use.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def image_grid(spark: SparkSession, w: int, h: int) -> DataFrame:
    """Every (y, x) of a ``w`` x ``h`` image."""
    i = F.col("id")
    return spark.range(w * h).select(
        (i / w).cast("int").alias("y"), (i % w).cast("int").alias("x")
    )


def face_grid(spark: SparkSession, size: int, reach: float = 1.0) -> DataFrame:
    """Every pixel of six faces with its local coordinates and direction."""
    i = F.col("id")
    side = (
        spark.range(size * size)
        .select((i / size).cast("int").alias("y"), (i % size).cast("int").alias("x"))
        .withColumn("axes", F.explode(sphere.face_axes_literal()))
        .withColumn("a", ((F.col("x") + 0.5) / size * 2.0 - 1.0) * reach)
        .withColumn("b", ((F.col("y") + 0.5) / size * 2.0 - 1.0) * reach)
    )
    dx, dy, dz = sphere.face_dir(F.col("a"), F.col("b"))
    return pin(side, {"dx": dx, "dy": dy, "dz": dz}).select(
        F.col("axes.face").alias("face"), "y", "x", "a", "b", "dx", "dy", "dz"
    )


def rays(df: DataFrame, w: int, h: int) -> DataFrame:
    """Add the unit direction of every panorama pixel."""
    dx, dy, dz = sphere.ray(F.col("x"), F.col("y"), w, h)
    return pin(df, {"dx": dx, "dy": dy, "dz": dz})


def tap_coords(u, v, w: int, h: int, wrap_x: bool = True, pole: str = "clamp") -> dict:
    """Top-left tap and fractions of a sampling position, by border rule.

    ``pole`` is ``clamp``, ``wrap``, ``zero`` (a guard row/column of zeros at
    -1) or ``open`` (the source reaches past its edge); the horizontal axis
    wraps or follows ``pole``.
    """

    def axis(t, n, rule):
        if rule == "clamp":
            t = F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), t))
        base = F.floor(t)
        first = F.pmod(base, F.lit(n)) if rule == "wrap" else base
        return first.cast("int"), t - base

    x0, fx = axis(u, w, "wrap" if wrap_x else pole)
    y0, fy = axis(v, h, pole)
    return {"x0": x0, "y0": y0, "fx": fx, "fy": fy}


def quads(
    df: DataFrame,
    values: list[str],
    keys: list[str],
    wrap_x: bool = True,
    pole: str = "clamp",
) -> DataFrame:
    """Pack each pixel with its right, lower and lower-right neighbour.

    A bilinear gather is then one equi-join and an expression, instead of a
    four-fold explode, a join and a regrouping.
    """
    packed = F.struct(*[F.col(v) for v in values])
    if pole == "zero":
        blank = F.struct(*[F.lit(0).cast(df.schema[v].dataType).alias(v) for v in values])
        for axis in ("y", "x"):
            guard = F.when(F.col(axis) == 0, F.array(F.lit(-1), F.lit(0))).otherwise(F.array(F.col(axis)))
            df = df.withColumn("_at", F.explode(guard)).withColumns(
                {v: F.when(F.col("_at") < 0, F.lit(0)).otherwise(F.col(v)).cast(df.schema[v].dataType) for v in values}
            ).withColumn(axis, F.col("_at").cast("int")).drop("_at")
    down = Window.partitionBy(*keys, "x").orderBy("y")
    right = Window.partitionBy(*keys, "y").orderBy("x")

    def neighbour(col, w, rule):
        edge = {"clamp": col, "wrap": F.first(col).over(w)}.get(rule)
        return F.coalesce(F.lead(col).over(w), blank if edge is None else edge)

    tall = df.select(*keys, "y", "x", packed.alias("q00")).withColumn(
        "q10", neighbour(F.col("q00"), down, pole)
    )
    pair = F.struct("q00", "q10")
    rule = "wrap" if wrap_x else pole
    if rule == "zero":
        blank = F.struct(blank.alias("q00"), blank.alias("q10"))
    return tall.withColumn("_r", neighbour(pair, right, rule)).select(
        *keys, F.col("y").alias("y0"), F.col("x").alias("x0"), "q00", "q10",
        F.col("_r.q00").alias("q01"), F.col("_r.q10").alias("q11"),
    )


def mix(value: str):
    """Bilinear value of a packed pixel at fractions ``fx``, ``fy``."""
    fx, fy = F.col("fx"), F.col("fy")
    q = lambda n: F.col(f"{n}.{value}")
    return (q("q00") * (1 - fx) + q("q01") * fx) * (1 - fy) + (q("q10") * (1 - fx) + q("q11") * fx) * fy


def nearest(value: str):
    """Nearest value of a packed pixel; ties go to the even coordinate."""
    fx, fy = F.col("fx"), F.col("fy")
    odd = lambda c: F.pmod(F.col(c), F.lit(2)) == 1
    right = (fx > 0.5) | ((fx == 0.5) & odd("x0"))
    low = (fy > 0.5) | ((fy == 0.5) & odd("y0"))
    q = lambda n: F.col(f"{n}.{value}")
    return F.when(low, F.when(right, q("q11")).otherwise(q("q10"))).otherwise(
        F.when(right, q("q01")).otherwise(q("q00"))
    )


def shared_map(gmap: DataFrame, rows: int) -> DataFrame:
    """Broadcast a frame-invariant map whose size is proven small; otherwise
    leave it to Catalyst, which shuffles both sides on the tap position."""
    return F.broadcast(gmap) if rows <= BROADCAST_ROWS else gmap


def gather(
    df: DataFrame,
    gmap: DataFrame,
    values: list[str],
    map_rows: int,
    source_face: bool = False,
    wrap_x: bool = True,
    pole: str = "clamp",
    method: str = "bilinear",
) -> DataFrame:
    """Sample frames through a frame-invariant map.

    ``gmap`` has ``y0, x0, fy, fx`` (and ``sface`` when the source is faces)
    plus any output columns, which are kept.
    """
    keys = FRAME + (["face"] if source_face else [])
    src = quads(by_frame(df), values, keys, wrap_x, pole)
    on = ["y0", "x0"]
    if source_face:
        src = src.withColumnRenamed("face", "sface")
        on = ["sface"] + on
    pick = mix if method == "bilinear" else nearest
    out = [c for c in gmap.columns if c not in ("y0", "x0", "fy", "fx", "sface")]
    return src.join(shared_map(gmap, map_rows), on).select(
        *FRAME, *out, *[pick(v).alias(v) for v in values]
    )


def sample_points(df: DataFrame, points: DataFrame, value: str, rows: int) -> DataFrame:
    """Bilinear values at few points per frame, by face.

    Unlike ``gather`` this does not touch the pixels nobody asks for: the
    points' four taps meet the pixels in a (normally broadcast) join, and only
    the hits are summed. ``points``: sface, y0, x0, fy, fx and output columns.
    """
    out = [c for c in points.columns if c not in ("sface", "y0", "x0", "fy", "fx")]
    tap = lambda dy, dx: F.struct(
        (F.col("y0") + dy).alias("y"), (F.col("x0") + dx).alias("x"),
        ((F.col("fy") if dy else 1 - F.col("fy")) * (F.col("fx") if dx else 1 - F.col("fx"))).alias("w"),
    )
    # A tap beyond the last row or column has no weight, as taps are clamped.
    taps = points.withColumn("t", F.explode(F.array(tap(0, 0), tap(0, 1), tap(1, 0), tap(1, 1)))).filter("t.w > 0")
    flat = taps.select(*out, F.col("sface").alias("face"), "t.*")
    return (
        df.join(shared_map(flat, 4 * rows), ["face", "y", "x"])
        .groupBy(*FRAME, *out).agg(F.sum(F.col(value) * F.col("w")).alias(value))
    )


# --- block form ----------------------------------------------------------


@F.pandas_udf(T.BinaryType())
def _to_bytes(levels: pd.Series) -> pd.Series:
    return levels.map(lambda a: np.asarray(a, dtype=np.uint8).tobytes())


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _from_bytes(data: pd.Series) -> pd.Series:
    return data.map(lambda b: np.frombuffer(b, dtype=np.uint8).astype(np.int32))


def pack_blocks(df: DataFrame, tile: int, keys: list[str] = FRAME) -> DataFrame:
    """Pixel rows to one binary row per tile: ``blocks(.., ty, tx, h, w, data)``."""
    rows = df.withColumns(
        {"ty": (F.col("y") / tile).cast("int"), "tx": (F.col("x") / tile).cast("int")}
    )
    flat = F.flatten(F.transform(F.array_sort("px"), lambda p: F.array(p.r, p.g, p.b)))
    return (
        rows.groupBy(*keys, "ty", "tx")
        .agg(
            F.collect_list(F.struct("y", "x", "r", "g", "b")).alias("px"),
            (F.max("y") - F.min("y") + 1).alias("h"),
            (F.max("x") - F.min("x") + 1).alias("w"),
        )
        .select(*keys, "ty", "tx", "h", "w", _to_bytes(flat).alias("data"))
    )


def explode_blocks(blocks: DataFrame, tile: int, keys: list[str] = FRAME) -> DataFrame:
    """Binary tiles back to pixel rows."""
    v, w = F.col("v"), F.col("w")
    pixel = lambda i: F.struct(
        (F.col("ty") * tile + (i / w).cast("int")).alias("y"),
        (F.col("tx") * tile + i % w).alias("x"),
        *[F.get(v, i * 3 + k).alias(c) for k, c in enumerate("rgb")],
    )
    cells = F.sequence(F.lit(0), F.col("h") * w - 1)
    return blocks.withColumn("v", _from_bytes("data")).select(
        *keys, F.inline(F.transform(cells, pixel))
    )
