"""View synthesis and depth conditioning."""

from pyspark.sql import functions as F

from orbframe import FRAME
from orbframe.operators import faces, fill, grid, quality, ranges, warp
from orbframe.plans import sqltext as q
from orbframe.plans.lenses import PANO, RAYS, STRONG, W, H, pano, ray_points
from orbframe.plans.registry import query, r6, rounded

NORM = f"WITH {PANO},{q.normalised()}"


def normalised(spark, sf):
    """Panoramas with depth scaled by each frame's own range."""
    px = pano(spark, sf)
    return ranges.normalise(px, ranges.frame_range(px))


def zdense(spark, sf, strength=STRONG):
    px = grid.by_frame(normalised(spark, sf).select(*FRAME, "y", "x", "d"))
    return warp.zbuffer(px.withColumn("dist", warp.distance(F.col("d"))), W, H, strength)


@query("normalised_depth", f"{NORM} SELECT clip, f, y, x, round(d, 6) + 0.0 AS d FROM norm")
def normalised_depth(spark, sf):
    return rounded(normalised(spark, sf).select(*FRAME, "y", "x", "d"), "d")


@query("zbuffer", f"{NORM}, {q.zbuffer('norm', STRONG, W, H)} SELECT clip, f, y, x, round(dist, 6) + 0.0 AS dist FROM zbuf")
def zbuffer(spark, sf):
    return rounded(zdense(spark, sf).filter(F.col("dist").isNotNull()), "dist")


@query("zbuffer_rays", f"WITH {RAYS}, {q.zbuffer('rays', 1.0, 256, 128, dist_col='dist')} SELECT clip, f, y, x, round(dist, 6) + 0.0 AS dist FROM zbuf")
def zbuffer_rays(spark, sf):
    """Many rays per cell and few frames: minima combine before the shuffle."""
    return rounded(warp.zbuffer(ray_points(spark, sf), 256, 128, 1.0).filter(F.col("dist").isNotNull()), "dist")


@query("crack_close", f"""{NORM}, {q.zbuffer('norm', STRONG, W, H)}, {q.cracks('zbuf', 'norm')}
SELECT clip, f, y, x, round(dist, 6) + 0.0 AS dist FROM closed""")
def crack_close(spark, sf):
    return rounded(warp.close_cracks(zdense(spark, sf)), "dist")


@query("hole_pixels", f"""{NORM}, {q.zbuffer('norm', STRONG, W, H)}
SELECT clip, f, y, x FROM norm ANTI JOIN zbuf USING (clip, f, y, x)""")
def hole_pixels(spark, sf):
    return warp.holes(zdense(spark, sf))


@query("hole_share", f"""{NORM}, {q.zbuffer('norm', STRONG, W, H)}, {q.cracks('zbuf', 'norm')}
SELECT clip, f, round(avg(CASE WHEN dist IS NULL THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS hole_share,
       CAST(sum(CASE WHEN dist IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS hole_pixels
FROM closed GROUP BY clip, f""")
def hole_share(spark, sf):
    z = zdense(spark, sf)
    return rounded(quality.hole_share(z.withColumn("hole", F.col("dist").isNull())), "hole_share")


@query("mask_runs", f"""{NORM}, {q.zbuffer('norm', STRONG, W, H)},
holes AS (SELECT clip, f, y, x FROM norm ANTI JOIN zbuf USING (clip, f, y, x)),
marked AS (SELECT *, x - row_number() OVER (PARTITION BY clip, f, y ORDER BY x) AS g FROM holes)
SELECT clip, f, y, min(x) AS x0, max(x) AS x1 FROM marked GROUP BY clip, f, y, g""")
def mask_runs(spark, sf):
    return faces.mask_runs(zdense(spark, sf).withColumn("hole", F.col("dist").isNull()))


EYE = f"{NORM}, {q.eye('norm', STRONG, W, H)}"


@query("synthesised_eye", f"{EYE} SELECT clip, f, y, x, round(r, 4) + 0.0 AS r, round(g, 4) + 0.0 AS g, round(b, 4) + 0.0 AS b, hole FROM eye")
def synthesised_eye(spark, sf):
    return rounded(warp.synthesise(normalised(spark, sf), W, H, STRONG), "r", "g", "b", places=4)


def filled_eye(px, strength=STRONG):
    eye = warp.synthesise(px, W, H, strength)
    return fill.directional(fill.dilate(eye), W, 1.0 if strength >= 0 else -1.0)


FILLED = f"{EYE}, {q.morph('eye', 'hole', 'hole_d', 2, 'max', 'grown')}, {q.directional('grown', W, 1.0)}"


@query("right_eye", f"""{FILLED}
SELECT clip, f, y, x, round(r, 4) + 0.0 AS r, round(g, 4) + 0.0 AS g, round(b, 4) + 0.0 AS b, hole, hole_d, done FROM filled""")
def right_eye(spark, sf):
    """Range, scale, z-buffer, crack closing, gather, occlusion, fill."""
    return rounded(filled_eye(normalised(spark, sf)).select(*FRAME, "y", "x", "r", "g", "b", "hole", "hole_d", "done"), "r", "g", "b", places=4)


HALF = STRONG / 2


@query("split_eyes", f"""{NORM}, {q.eye('norm', -HALF, W, H, 'le')}, {q.eye('norm', HALF, W, H, 're')},
both_eyes AS (SELECT 'left' AS eye, * FROM le UNION ALL SELECT 'right', * FROM re)
SELECT eye, clip, f, y, x, hole, round(r, 4) + 0.0 AS r, round(g, 4) + 0.0 AS g, round(b, 4) + 0.0 AS b FROM both_eyes""")
def split_eyes(spark, sf):
    return rounded(warp.stereo_pair(normalised(spark, sf), W, H, STRONG, True), "r", "g", "b", places=4)


SPLAT_U, SPLAT_V = q.uv("px", "py / norm", "pz", W, H)


@query("nearest_splat", f"""{NORM}, {q.ray('norm', W, H)},
moved AS (SELECT *, {q.dist()} * dx - {STRONG * 0.03} AS px, {q.dist()} * dy AS py, {q.dist()} * dz AS pz FROM rayed),
normed AS (SELECT *, sqrt(px*px + py*py + pz*pz) AS norm FROM moved),
placed AS (SELECT clip, f, r, g, b, norm, y * {W} + x AS src,
  CAST(greatest(0, least({W - 1}, round_even({SPLAT_U}, 0))) AS INT) AS tx,
  CAST(greatest(0, least({H - 1}, round_even({SPLAT_V}, 0))) AS INT) AS ty FROM normed),
won AS (SELECT *, row_number() OVER (PARTITION BY clip, f, ty, tx ORDER BY norm, src DESC) AS rn FROM placed)
SELECT n.clip, n.f, n.y, n.x, coalesce(w.r, 0) AS r, coalesce(w.g, 0) AS g, coalesce(w.b, 0) AS b, w.norm IS NULL AS hole
FROM norm n LEFT JOIN won w ON w.rn = 1 AND w.clip = n.clip AND w.f = n.f AND w.ty = n.y AND w.tx = n.x""")
def nearest_splat(spark, sf):
    return warp.nearest_splat(normalised(spark, sf), W, H, STRONG)


SOFT = f"""
{q.morph('norm', 'd', 'lo', 2, 'min', 'sl')}, {q.morph('sl', 'd', 'hi', 2, 'max', 'sh')}, {q.morph('sh', 'lo', 'op', 2, 'max', 'so')},
soft AS (SELECT * EXCLUDE (lo, hi, op) REPLACE (
  d + greatest(0.0, least(1.0, (hi - lo - 0.05) / 0.05)) * ((d - lo) / greatest(hi - lo, 1e-6))
    * (1.0 - greatest(0.0, least(1.0, (d - op) / 0.05))) * (lo - d) AS d) FROM so)"""


@query("soften_edges", f"{NORM}, {SOFT} SELECT clip, f, y, x, round(d, 6) + 0.0 AS d FROM soft")
def soften_edges(spark, sf):
    return rounded(warp.soften_edges(grid.by_frame(normalised(spark, sf).select(*FRAME, "y", "x", "d"))), "d")


def _clamp_sql(src, axis, s, name):
    across = "x" if axis == "y" else "y"
    over = lambda o: f"OVER (PARTITION BY clip, f, {across} ORDER BY {axis} {o} ROWS UNBOUNDED PRECEDING)"
    return f"""
{name}_f AS (SELECT * REPLACE (min(d - {axis} * {s}) {over('')} + {axis} * {s} AS d) FROM {src}),
{name} AS (SELECT * REPLACE (min(d + {axis} * {s}) {over('DESC')} - {axis} * {s} AS d) FROM {name}_f)"""


SLOPE = repr(warp.critical_slope(W, STRONG))
SLOPE2 = repr(2 * warp.critical_slope(W, STRONG))


@query("gradient_clamp", f"""{NORM}, {_clamp_sql('norm', 'x', SLOPE, 'cx')}, {_clamp_sql('cx', 'y', SLOPE2, 'cy')}
SELECT clip, f, y, x, round(d, 6) + 0.0 AS d FROM cy""")
def gradient_clamp(spark, sf):
    s = warp.critical_slope(W, STRONG)
    px = grid.by_frame(normalised(spark, sf).select(*FRAME, "y", "x", "d"))
    return rounded(warp.clamp_gradient(px, s, 2 * s), "d")


@query("conditioned_holes", f"""{NORM}, {SOFT}, {_clamp_sql('soft', 'x', SLOPE, 'cx')}, {_clamp_sql('cx', 'y', SLOPE2, 'cy')},
{q.zbuffer('cy', STRONG, W, H)}
SELECT clip, f, CAST(sum(CASE WHEN dist IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS hole_pixels
FROM cy LEFT JOIN zbuf USING (clip, f, y, x) GROUP BY clip, f""")
def conditioned_holes(spark, sf):
    """Holes left once edges are softened and the gradient is clamped."""
    px = warp.condition(normalised(spark, sf).select(*FRAME, "y", "x", "d"), W, STRONG, 2, 1.0)
    z = warp.zbuffer(px.withColumn("dist", warp.distance(F.col("d"))), W, H, STRONG)
    return z.groupBy(*FRAME).agg(F.sum(F.col("dist").isNull().cast("int")).alias("hole_pixels"))


@query("depth_edges", f"""{NORM},
gh AS (SELECT *, coalesce(lag(d) OVER r, lead(d) OVER r) AS l, coalesce(lead(d) OVER r, lag(d) OVER r) AS rr
       FROM norm WINDOW r AS (PARTITION BY clip, f, y ORDER BY x)),
gd AS (SELECT *, rr - l AS ddx, l + 2.0 * d + rr AS ssx FROM gh),
gv AS (SELECT *, coalesce(lag(ddx) OVER c, lead(ddx) OVER c) + 2.0 * ddx + coalesce(lead(ddx) OVER c, lag(ddx) OVER c) AS gx,
       coalesce(lead(ssx) OVER c, lag(ssx) OVER c) - coalesce(lag(ssx) OVER c, lead(ssx) OVER c) AS gy
       FROM gd WINDOW c AS (PARTITION BY clip, f, x ORDER BY y)),
ge AS (SELECT *, sqrt(gx*gx + gy*gy) > 2.0 AS e FROM gv),
{q.morph('ge', 'e', 'edge', 1, 'max', 'gm')}
SELECT clip, f, y, x, edge FROM gm""")
def depth_edges(spark, sf):
    """Threshold 2.0: these panoramas are noise, 0.05 would mark every pixel."""
    px = grid.by_frame(normalised(spark, sf).select(*FRAME, "y", "x", "d"))
    return quality.depth_edges(px, W, H, threshold=2.0).select(*FRAME, "y", "x", "edge")


RS_U, RS_V = q.uv("px", "py / norm", "pz", W, H)


@query("ray_shift", f"""{NORM}, {q.ray('norm', W, H)},
mv AS (SELECT clip, f, y, x, {q.dist()} * dx - 0.03 * dz AS px, {q.dist()} * dy AS py, {q.dist()} * dz + 0.03 * dx AS pz FROM rayed),
mn AS (SELECT *, sqrt(px*px + py*py + pz*pz) AS norm FROM mv),
mu AS (SELECT *, ({RS_U} - x) / {W} * 2.0 * pi() + pi() AS t, y - {RS_V} AS sv FROM mn)
SELECT clip, f, y, x, round((t - 2.0 * pi() * floor(t / (2.0 * pi())) - pi()) * {W} / (2.0 * pi()), 6) + 0.0 AS shift_x,
       round(sv, 6) + 0.0 AS shift_y FROM mu""")
def ray_shift(spark, sf):
    px = normalised(spark, sf).withColumn("dist", warp.distance(F.col("d"))).select(*FRAME, "y", "x", "dist")
    return rounded(quality.ray_shift(px, W, H, 1.0).select(*FRAME, "y", "x", "shift_x", "shift_y"), "shift_x", "shift_y")
