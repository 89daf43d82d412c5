"""View synthesis: z-buffer aggregate, crack closing and colour gather."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbframe import FRAME
from orbframe.functions import sphere
from orbframe.operators import grid

# Floor added to inverse depth, eye separation at strength 1,
# visibility ratio, crack margin, edge threshold and kernel radius.
MIN_INVERSE, BASELINE, VISIBLE, CRACK = 0.05, 0.03, 0.9, 0.05
EDGE_THRESHOLD, EDGE_RADIUS = 0.05, 2


def distance(dn: Column) -> Column:
    """Normalised inverse depth to distance."""
    return 1.0 / (dn + MIN_INVERSE)


def eye_offset(dist: Column, dx: Column, dz: Column, baseline: float) -> tuple[Column, Column]:
    """Shift a point sideways of its own viewing ray; tapers to nothing at the poles."""
    return dist * dx + baseline * dz, dist * dz - baseline * dx


def footprint(df: DataFrame, w: int, h: int, strength: float, dist: str = "dist") -> DataFrame:
    """Up to four target cells per pixel, plus the pixel's own cell with NULL.

    The extra row makes the later minimum cover the whole grid, so holes are
    the NULL groups and need no anti-join. Longitude wraps; rows outside the
    image are dropped.
    """
    px, pz = eye_offset(F.col(dist), F.col("dx"), F.col("dz"), -strength * BASELINE)
    u, v, norm = sphere.uv_of_point(px, F.col(dist) * F.col("dy"), pz, w, h)
    cell = lambda y, x, z: F.struct(y.cast("int").alias("ty"), x.cast("int").alias("tx"), z.alias("z"))
    hit = lambda dy, dx: cell(
        F.least(F.greatest(F.floor("v"), F.lit(-1)), F.lit(h - 1)) + dy,
        F.pmod(F.floor("u") + dx, F.lit(w)),
        F.col("norm"),
    )
    own = cell(F.col("y"), F.col("x"), F.lit(None).cast("double"))
    cells = F.array(own, hit(0, 0), hit(0, 1), hit(1, 0), hit(1, 1))
    return (
        grid.pin(grid.rays(df, w, h), {"u": u, "v": v, "norm": norm})
        .select(*FRAME, F.explode(cells).alias("c"))
        .select(*FRAME, "c.*")
        .filter((F.col("ty") >= 0) & (F.col("ty") < h))
    )


def zbuffer(df: DataFrame, w: int, h: int, strength: float, dist: str = "dist") -> DataFrame:
    """Nearest distance per target cell; NULL where nothing lands.

    Input already partitioned by frame keeps the exploded rows inside their
    task: the minimum is taken there without another shuffle.
    """
    return (
        footprint(df, w, h, strength, dist)
        .groupBy(*FRAME, "ty", "tx")
        .agg(F.min("z").alias("dist"))
        .withColumnsRenamed({"ty": "y", "tx": "x"})
    )


def box_window(axis: str, k: int, keys: list[str] = FRAME):
    """Row frame of radius ``k`` along one axis; clipped at the image edge."""
    across = "x" if axis == "y" else "y"
    return Window.partitionBy(*keys, across).orderBy(axis).rowsBetween(-k, k)


def morph(df: DataFrame, value: str, out: str, k: int, op=F.min, keys: list[str] = FRAME) -> DataFrame:
    """Rectangular min or max filter as two one-dimensional windows."""
    return (
        df.withColumn(out, op(value).over(box_window("x", k, keys)))
        .withColumn(out, op(out).over(box_window("y", k, keys)))
    )


def close_cracks(z: DataFrame) -> DataFrame:
    """Pull distances that stand 5% above their 3x3 minimum down to it."""
    near = morph(z, "dist", "_m", 1)
    crack = (F.col("dist") - F.col("_m")) > CRACK * F.col("_m")
    return near.withColumn("dist", F.when(crack, F.col("_m")).otherwise(F.col("dist"))).drop("_m")


def holes(z: DataFrame) -> DataFrame:
    """Cells without a distance."""
    return z.filter(F.col("dist").isNull()).drop("dist")


def soften_edges(df: DataFrame, k: int = EDGE_RADIUS, threshold: float = EDGE_THRESHOLD, value: str = "d") -> DataFrame:
    """Blend the near side of depth edges towards the local background.

    Built only from min/max filters and bounded products, so a small change
    of depth moves the result by a small amount. Thin structures are exempt.
    """
    both = df.withColumns({
        "_lo": F.min(value).over(box_window("x", k)), "_hi": F.max(value).over(box_window("x", k)),
    }).withColumns({
        "_lo": F.min("_lo").over(box_window("y", k)), "_hi": F.max("_hi").over(box_window("y", k)),
    })
    opened = morph(both, "_lo", "_open", k, F.max)
    span = F.col("_hi") - F.col("_lo")
    clip01 = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    near = (F.col(value) - F.col("_lo")) / F.greatest(span, F.lit(1e-6))
    wide = clip01((span - threshold) / threshold)
    thin = clip01((F.col(value) - F.col("_open")) / threshold)
    moved = F.col(value) + wide * near * (1.0 - thin) * (F.col("_lo") - F.col(value))
    return opened.withColumn(value, moved).drop("_lo", "_hi", "_open")


def critical_slope(w: int, strength: float) -> float:
    """Depth gradient at which the warp stops being one-to-one."""
    return 2.0 * math.pi / (abs(strength * BASELINE) * w)


def clamp_gradient(df: DataFrame, slope_x: float, slope_y: float | None = None, value: str = "d") -> DataFrame:
    """Limit the depth gradient by lowering peaks: running minima both ways."""

    def along(df, axis, slope):
        across = "x" if axis == "y" else "y"
        lane = Window.partitionBy(*FRAME, across)
        so_far = lambda o: lane.orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
        ramp = F.col(axis) * slope
        fwd = F.min(F.col(value) - ramp).over(so_far(F.col(axis))) + ramp
        back = F.min(F.col(value) + ramp).over(so_far(F.col(axis).desc())) - ramp
        return df.withColumn(value, fwd).withColumn(value, back)

    df = along(df, "x", slope_x)
    return df if slope_y is None else along(df, "y", slope_y)


def condition(df: DataFrame, w: int, strength: float, soften: int = EDGE_RADIUS, gradient_limit: float = 0.0) -> DataFrame:
    """Soften edges, then clamp; the clamp comes last as softening sharpens."""
    df = grid.by_frame(df)
    if soften > 0:
        df = soften_edges(df, soften)
    if gradient_limit > 0.0 and strength != 0.0:
        s = gradient_limit * critical_slope(w, strength)
        df = clamp_gradient(df, s, 2.0 * s)
    return df


def back_project(z: DataFrame, w: int, h: int, strength: float, pole: str = "clamp") -> DataFrame:
    """Where each resolved cell lies in the source eye: taps and distance."""
    dist = F.coalesce("dist", F.lit(1.0))
    px, pz = eye_offset(dist, F.col("dx"), F.col("dz"), strength * BASELINE)
    u, v, norm = sphere.uv_of_point(px, dist * F.col("dy"), pz, w, h)
    placed = grid.pin(grid.rays(z, w, h), {"u": u, "v": v, "need": norm})
    return placed.withColumns(grid.tap_coords(F.col("u"), F.col("v"), w, h, True, pole)).select(
        *FRAME, "y", "x", "dist", "need", "y0", "x0", "fy", "fx"
    )


def synthesise(df: DataFrame, w: int, h: int, strength: float, pole: str = "clamp", carry: list[str] = []) -> DataFrame:
    """The other eye before filling: ``(.., y, x, r, g, b, hole)``.

    ``df`` holds one row per pixel with colours and conditioned depth ``d`` in
    [0, 1]. A cell is a hole when nothing lands on it, or when the source eye
    sees something clearly nearer along the ray back. Columns in ``carry`` are
    constant within a frame and come along.
    """
    if strength == 0.0:
        return df.select(*FRAME, "y", "x", "r", "g", "b", F.lit(False).alias("hole"), *carry)
    px = grid.by_frame(df.select(*FRAME, "y", "x", "r", "g", "b", "d", *carry))
    z = close_cracks(zbuffer(px.withColumn("dist", distance(F.col("d"))), w, h, strength))
    src = grid.quads(px, ["r", "g", "b", "d", *carry], FRAME, True, pole)
    seen = back_project(z, w, h, strength, pole).join(src, [*FRAME, "y0", "x0"])
    hidden = distance(grid.nearest("d")) < VISIBLE * F.col("need")
    hole = F.col("dist").isNull() | hidden
    colours = {c: F.when(F.col("hole"), F.lit(0.0)).otherwise(grid.mix(c)) for c in "rgb"}
    return seen.withColumn("hole", hole).withColumns(colours).select(
        *FRAME, "y", "x", "r", "g", "b", "hole", *[F.col(f"q00.{c}").alias(c) for c in carry]
    )


def stereo_pair(df: DataFrame, w: int, h: int, strength: float, split: bool, soften: int = 0, gradient_limit: float = 0.0) -> DataFrame:
    """Both eyes as one relation with an ``eye`` column.

    Without ``split`` the left eye is the untouched source; with it each eye
    is moved half way, in opposite directions.
    """
    if split:
        parts = [("left", -0.5 * strength), ("right", 0.5 * strength)]
    else:
        parts = [("left", 0.0), ("right", strength)]
    eyes = []
    for eye, s in parts:
        ready = df if s == 0.0 else condition(df, w, s, soften, gradient_limit)
        eyes.append(synthesise(ready, w, h, s).withColumn("eye", F.lit(eye)))
    return eyes[0].unionByName(eyes[1])


def nearest_splat(df: DataFrame, w: int, h: int, strength: float) -> DataFrame:
    """The earlier method: each pixel's colour goes to one rounded cell.

    The eye moves along a fixed axis; the nearest pixel wins and of equally
    near ones the later. Cells nobody reaches are holes with zero colour.
    """
    b = strength * BASELINE
    lam = distance(F.col("d"))
    u, v, norm = sphere.uv_of_point(lam * F.col("dx") - b, lam * F.col("dy"), lam * F.col("dz"), w, h)
    place = lambda t, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.bround(t).cast("int")))
    src = F.col("y") * w + F.col("x")
    cell = lambda y, x, z: F.struct(y.alias("ty"), x.alias("tx"), z.alias("z"))
    own = cell(F.col("y"), F.col("x"), F.lit(None).cast("double"))
    return (
        grid.pin(grid.rays(grid.by_frame(df), w, h), {"u": u, "v": v, "norm": norm, "src": src})
        .withColumn("c", F.explode(F.array(own, cell(place(F.col("v"), h), place(F.col("u"), w), F.col("norm")))))
        .groupBy(*FRAME, F.col("c.ty").alias("y"), F.col("c.tx").alias("x"))
        .agg(F.min_by(F.struct("r", "g", "b"), F.when(F.col("c.z").isNotNull(), F.struct("c.z", -F.col("src")))).alias("p"),
             F.min("c.z").alias("z"))
        .select(*FRAME, "y", "x", *[F.coalesce(f"p.{c}", F.lit(0)).alias(c) for c in "rgb"], F.col("z").isNull().alias("hole"))
    )
