"""Quality metrics over frames and renders."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbframe import FRAME
from orbframe.functions import sphere
from orbframe.operators import grid, selection, warp

# Jump sizes, edge strength, fingerprint tolerance.
JUMP, POP, EDGE, TOLERANCE = 8, 32, 0.05, 0.30


def temporal_spread(df: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """Mean and 99th percentile of each pixel's spread over the frames."""
    spread = sum((F.stddev_pop(v) for v in values[1:]), F.stddev_pop(values[0])) / len(values)
    per = df.groupBy(*keys, "y", "x").agg(spread.alias("sd"))
    high = selection.quantiles(per, keys, "sd", [0.99]).select(*keys, F.col("q")[0].alias("p99_sd"))
    return per.groupBy(*keys).agg(F.avg("sd").alias("mean_sd")).join(high, keys)


def response(a: DataFrame, b: DataFrame, roi: DataFrame | None = None, keys: list[str] = FRAME) -> DataFrame:
    """How far a render moves under a perturbation: mean change and shares of
    jumps, over pixels valid in both (and inside ``roi``)."""
    at = [*keys, "y", "x"]
    left = a.filter(~F.col("hole")).select(*at, *[F.col(c).alias(f"a_{c}") for c in "rgb"])
    right = b.filter(~F.col("hole")).select(*at, *[F.col(c).alias(f"b_{c}") for c in "rgb"])
    if roi is not None:
        left = left.join(roi, at, "left_semi")
    diff = (F.abs(F.col("a_r") - F.col("b_r")) + F.abs(F.col("a_g") - F.col("b_g")) + F.abs(F.col("a_b") - F.col("b_b"))) / 3.0
    share = lambda n: F.avg((F.col("diff") > n).cast("double"))
    return left.join(right, at).withColumn("diff", diff).groupBy(*keys).agg(
        F.avg("diff").alias("mean_change"), share(JUMP).alias("jump_share"), share(POP).alias("pop_share")
    )


def depth_edges(df: DataFrame, w: int, h: int, value: str = "d", threshold: float = EDGE) -> DataFrame:
    """Adds ``edge``: 3x3 gradient above a threshold, grown by one pixel.

    Borders mirror without repeating the edge pixel.
    """
    def pair(col, axis, n):
        across = "x" if axis == "y" else "y"
        lane = Window.partitionBy(*FRAME, across).orderBy(axis)
        prev, nxt = F.lag(col).over(lane), F.lead(col).over(lane)
        return F.coalesce(prev, nxt), F.coalesce(nxt, prev)

    l, r = pair(F.col(value), "x", w)
    t = df.withColumns({"_dx": r - l, "_sx": l + 2.0 * F.col(value) + r})
    up_dx, dn_dx = pair(F.col("_dx"), "y", h)
    up_sx, dn_sx = pair(F.col("_sx"), "y", h)
    gx, gy = up_dx + 2.0 * F.col("_dx") + dn_dx, dn_sx - up_sx
    g = t.withColumns({"_gx": gx, "_gy": gy}).withColumn("_e", F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy")) > threshold)
    return warp.morph(g, "_e", "edge", 1, F.max).drop("_dx", "_sx", "_gx", "_gy", "_e")


def seam_step(df: DataFrame, w: int, h: int, one: str = "+Z", other: str = "-Y") -> DataFrame:
    """Median depth step across a seam over the range of the lower half."""
    col = Window.partitionBy(*FRAME, "x").orderBy("y")
    own = grid.pin(grid.rays(df, w, h), {"face": sphere.owner(F.col("dx"), F.col("dy"), F.col("dz"))["face"]})
    step = own.withColumns({"pd": F.lag("d").over(col), "pf": F.lag("face").over(col)})
    across = ((F.col("pf") == one) & (F.col("face") == other)) | ((F.col("pf") == other) & (F.col("face") == one))
    low = F.when(F.col("y") >= h // 2, F.col("d"))
    spread = selection.quantiles(df.select(*FRAME, low.alias("low")).repartition(*FRAME), FRAME, "low", [0.01, 0.99], "p")
    # a seam is as long as a few scanlines
    middle = step.groupBy(*FRAME).agg(F.median(F.when(across, F.abs(F.col("d") - F.col("pd")))).alias("step"))
    return middle.join(spread, FRAME).select(*FRAME, (F.col("step") / (F.col("p")[1] - F.col("p")[0])).alias("seam_step"))


def fingerprint(df: DataFrame, h: int, w: int, rows: int, cols: int, values: list[str], keys: list[str] = FRAME) -> DataFrame:
    """Block means on a ``rows`` x ``cols`` grid; incomplete blocks are cut."""
    bh, bw = h // rows, w // cols
    whole = df.filter((F.col("y") < bh * rows) & (F.col("x") < bw * cols))
    return whole.groupBy(*keys, (F.col("y") / bh).cast("int").alias("gy"), (F.col("x") / bw).cast("int").alias("gx")).agg(
        *[F.avg(v).alias(v) for v in values]
    )


def compare_fingerprints(got: DataFrame, want: DataFrame, value: str, depth: bool = False, keys: list[str] = FRAME, tolerance: float = TOLERANCE) -> DataFrame:
    """Largest and mean difference, where it is, and whether it is tolerable.

    Depth is relative, so each side is first scaled by its own range to 255.
    """
    def side(df, name):
        v = F.col(value)
        if depth:
            group = Window.partitionBy(*keys)
            v = v / F.greatest(F.max(v).over(group) - F.min(v).over(group), F.lit(1e-6)) * 255.0
        return df.select(*keys, "gy", "gx", v.alias(name))

    both = side(got, "a").join(side(want, "b"), [*keys, "gy", "gx"]).withColumn("diff", F.abs(F.col("a") - F.col("b")))
    return both.groupBy(*keys).agg(
        F.max("diff").alias("worst"), F.avg("diff").alias("mean"),
        F.max_by(F.struct("gy", "gx"), F.struct(F.col("diff"), -F.col("gy"), -F.col("gx"))).alias("cell"),
    ).select(*keys, "worst", "mean", "cell.gy", "cell.gx", (F.col("worst") <= tolerance).alias("same"))


def hole_share(df: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    """Share of hole pixels per group."""
    return df.groupBy(*keys).agg(F.avg(F.col("hole").cast("double")).alias("hole_share"), F.sum(F.col("hole").cast("int")).alias("hole_pixels"))


def hole_share_cube(df: DataFrame) -> DataFrame:
    """Hole share per clip, per eye, both and overall."""
    return df.cube("clip", "eye").agg(F.avg(F.col("hole").cast("double")).alias("hole_share"))


def ray_shift(df: DataFrame, w: int, h: int, strength: float, dist: str = "dist") -> DataFrame:
    """Horizontal and vertical shift, in pixels, the warp gives each ray."""
    turn = 2.0 * math.pi
    px, pz = warp.eye_offset(F.col(dist), F.col("dx"), F.col("dz"), -strength * warp.BASELINE)
    u, v, _ = sphere.uv_of_point(px, F.col(dist) * F.col("dy"), pz, w, h)
    across = F.pmod((u - F.col("x")) / w * turn + math.pi, F.lit(turn)) - math.pi
    # Latitude falls as rows grow, so a downward move is a negative shift.
    return grid.rays(df, w, h).withColumns({"shift_x": across * w / turn, "shift_y": F.col("y") - v})


def rmse(got: DataFrame, truth: DataFrame, values: list[str], keys: list[str] = FRAME) -> DataFrame:
    """Root mean square difference to a truth frame over all channels."""
    at = [*keys, "y", "x"]
    t = truth.select(*at, *[F.col(v).alias(f"t_{v}") for v in values])
    sq = sum(((F.col(v) - F.col(f"t_{v}")) * (F.col(v) - F.col(f"t_{v}")) for v in values), F.lit(0.0))
    return got.join(t, at).groupBy(*keys).agg(F.sqrt(F.avg(sq / len(values))).alias("rmse"))


def eye_difference(eyes: DataFrame, h: int, low: float = 0.35, high: float = 0.65) -> DataFrame:
    """Mean difference between the eyes in a band away from the poles."""
    band = eyes.filter((F.col("y") >= int(h * low)) & (F.col("y") < int(h * high)))
    side = lambda e, p: band.filter(F.col("eye") == e).select(*FRAME, "y", "x", *[F.col(c).alias(p + c) for c in "rgb"])
    diff = sum((F.abs(F.col("l" + c) - F.col("r" + c)) for c in "gb"), F.abs(F.col("lr") - F.col("rr"))) / 3.0
    return side("left", "l").join(side("right", "r"), [*FRAME, "y", "x"]).groupBy(*FRAME).agg(F.avg(diff).alias("eye_difference"))


def stage_times(df: DataFrame, frames: str = "frame", warm_up: int = 1) -> DataFrame:
    """Seconds per stage, per frame and as a share, the warm-up left out."""
    timed = df.filter(F.col(frames) >= warm_up)
    n = timed.agg(F.greatest(F.countDistinct(frames), F.lit(1)).alias("n"))
    total = F.sum("seconds").over(Window.partitionBy())
    per = timed.groupBy("stage").agg(F.sum("seconds").alias("seconds"))
    return per.select(
        "stage", "seconds", (F.col("seconds") / n.scalar()).alias("per_frame"), (F.col("seconds") / total).alias("share")
    ).orderBy(F.desc("seconds"))


def face_disagreement(pairs: DataFrame, depth: DataFrame) -> DataFrame:
    """RMS gap over the shared bands relative to the depth range of the frame."""
    span = depth.groupBy(*FRAME).agg((F.max("d") - F.min("d")).alias("span"))
    gap = F.col("di") - F.col("dj")
    return pairs.groupBy(*FRAME).agg(F.sqrt(F.avg(gap * gap)).alias("rms")).join(span, FRAME).select(
        *FRAME, (F.col("rms") / F.col("span")).alias("disagreement")
    )


def lipschitz(changes: DataFrame, level: str = "sigma") -> DataFrame:
    """Largest and mean change per noise level, and how it grows with the level."""
    per = changes.groupBy(level).agg(F.max("change").alias("peak"), F.avg("change").alias("mean"))
    by = Window.partitionBy().orderBy(level)
    return per.select(level, "peak", "mean", (F.col("peak") / F.col(level)).alias("gain"), (F.col("mean") / F.lag("mean").over(by)).alias("growth"))


def weight_sums(gmap: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Pixels whose blend weights do not add up to one."""
    return gmap.groupBy("y", "x").agg(F.sum("wt").alias("total"), F.count(F.lit(1)).alias("n")).filter(F.abs(F.col("total") - 1.0) > tolerance)
