"""Hole filling: directional continuation, residual rings and pyramid fill."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbframe import FRAME
from orbframe.operators import grid, ranges, warp

# Fixed value: radius by which a hole mask grows before it is filled.
DILATE = 2


def dilate(df: DataFrame, k: int = DILATE, mask: str = "hole", out: str = "hole_d", keys: list[str] = FRAME) -> DataFrame:
    """Mask grown by ``k`` pixels each way; nothing wraps."""
    return warp.morph(df, mask, out, k, F.max, keys)


def directional(df: DataFrame, w: int, sign: float, mask: str = "hole_d", keys: list[str] = FRAME) -> DataFrame:
    """Continue the background into each hole by mirroring it at the hole's edge.

    Works on scanlines: a row of pixels is one array (its length is the image
    width), so the mirrored source is an array lookup and no pixel is joined
    to another. Rows without a hole pass through untouched. Adds ``done``.
    """
    row = Window.partitionBy(*keys, "y")
    so_far = lambda o: row.orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    good = F.when(~F.col(mask), F.col("x"))
    edges = df.withColumn("_l", F.last(good, True).over(so_far(F.col("x")))).withColumn(
        "_r", F.last(good, True).over(so_far(F.col("x").desc()))
    )
    others = [c for c in df.columns if c not in keys + ["y", "x", mask]]
    fields = ["x", mask, "_l", "_r", *others]
    rows = edges.groupBy(*keys, "y").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("px"))
    first, second = ("_r", "_l") if sign > 0 else ("_l", "_r")

    def paint(p):
        bound = F.coalesce(p[first], p[second])
        mirrored = F.get(F.col("px"), F.pmod(bound * 2 - p["x"], F.lit(w)))
        at_edge = F.get(F.col("px"), bound)
        source = F.when(mirrored[mask], at_edge).otherwise(mirrored)
        take = p[mask] & bound.isNotNull()
        return F.struct(
            p["x"].alias("x"), p[mask].alias(mask), take.alias("done"),
            *[(F.when(take, source[c]).otherwise(p[c]) if c in ("r", "g", "b") else p[c]).alias(c) for c in others],
        )

    keep = lambda p: F.struct(
        p["x"].alias("x"), p[mask].alias(mask), F.lit(False).alias("done"), *[p[c].alias(c) for c in others]
    )
    px = F.when(F.exists("px", lambda p: p[mask]), F.transform("px", paint)).otherwise(F.transform("px", keep))
    return rows.select(*keys, "y", F.inline(px)).select(*keys, "y", "x", *others, mask, "done")


def _radii(k: int) -> list[int]:
    return [k, 2 * k + 2, 4 * k + 4, 8 * k + 8]


def _rings(df: DataFrame, k: int, hole: str, grown: str | None) -> DataFrame:
    """Adds the hole mask grown by each radius, ``_m0`` to ``_m3``."""
    for i, r in enumerate(_radii(k)):
        df = df.withColumn("_m0", F.col(grown)) if grown and i == 0 else dilate(df, r, hole, f"_m{i}")
    return df


def search_mask(df: DataFrame, split: DataFrame, out: str, k: int = DILATE, hole: str = "hole", grown: str | None = None) -> DataFrame:
    """The grown mask up to the ring that gave a frame its threshold (``split``), and the threshold.

    A fill is made over this mask: where the ring had to be widened, so is what may not be read.
    """
    ringed = ranges.attach(_rings(df, k, hole, grown), split, FRAME, "left")
    pick = F.col("_m0")
    for i, r in list(enumerate(_radii(k)))[1:]:
        pick = F.when(F.col("radius") == r, F.col(f"_m{i}")).otherwise(pick)
    return ringed.withColumn(out, pick).drop("radius", *[f"_m{i}" for i in range(4)])


def ring_threshold(df: DataFrame, k: int = DILATE, hole: str = "hole", depth: str = "d", grown: str | None = None) -> DataFrame:
    """Near/far split per frame: half way between the extremes of the ring.

    The ring is the grown mask minus the holes. A ring without contrast is
    widened to the first of three larger radii that shows some. ``grown``
    names a mask to use instead of growing the holes by ``k``.
    """
    radii = _radii(k)
    df = _rings(df, k, hole, grown)
    aggs = []
    for i in range(len(radii)):
        ring = F.when(F.col(f"_m{i}") & ~F.col(hole), F.col(depth))
        aggs += [F.min(ring).alias(f"lo{i}"), F.max(ring).alias(f"hi{i}")]
    stats = df.groupBy(*FRAME).agg(*aggs)
    pick = lambda i: F.struct(F.lit(radii[i]).alias("radius"), (0.5 * (F.col(f"lo{i}") + F.col(f"hi{i}"))).alias("threshold"))
    choice = F.when(F.col("hi0") - F.col("lo0") >= 1e-6, pick(0))
    for i in (1, 2, 3):
        choice = choice.when(F.col(f"hi{i}") - F.col(f"lo{i}") > 1e-6, pick(i))
    choice = choice.when(F.col("lo0").isNotNull(), pick(0))
    return stats.select(*FRAME, choice.alias("c")).select(*FRAME, "c.radius", "c.threshold")


def pyramid(df: DataFrame, levels: int, mask: str = "hole", values: tuple = ("r", "g", "b")) -> DataFrame:
    """Fill masked pixels from the finest block mean that has a valid pixel.

    Pixels are summed into 2x2 cells once; all coarser levels are sums of
    those cells, made in one aggregate. Only masked pixels look means up.
    """
    px = grid.by_frame(df)
    cells = (
        px.filter(~F.col(mask)).groupBy(*FRAME, F.shiftright("y", 1).alias("cy"), F.shiftright("x", 1).alias("cx"))
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(v).cast("double")).alias(v) for v in values])
    )
    level = F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("k")
    means = (
        cells.select("*", level).groupBy(*FRAME, "k", F.expr("shiftright(cy, k - 1)").alias("by"), F.expr("shiftright(cx, k - 1)").alias("bx"))
        .agg(*[(F.sum(v) / F.sum("n")).alias(v) for v in values])
    )
    wanted = px.filter(mask).select(*FRAME, "y", "x", level).withColumns(
        {"by": F.expr("shiftright(y, k)"), "bx": F.expr("shiftright(x, k)")}
    )
    found = wanted.join(means.hint("merge"), [*FRAME, "k", "by", "bx"]).groupBy(*FRAME, "y", "x").agg(
        F.min_by(F.struct(*values), "k").alias("_fill")
    )
    out = {v: F.when(F.col(mask), F.coalesce(f"_fill.{v}", v)).otherwise(F.col(v)) for v in values}
    return px.join(found.hint("merge"), [*FRAME, "y", "x"], "left").withColumns(out).select(*df.columns)


def composite(df: DataFrame, keep: str, filled: str = "filled", values: tuple = ("r", "g", "b")) -> DataFrame:
    """Take the filled colours (struct ``filled``) only where ``keep`` says so."""
    return df.withColumns(
        {v: F.when(F.col(keep), F.coalesce(f"{filled}.{v}", v)).otherwise(F.col(v)) for v in values}
    ).drop(filled)
