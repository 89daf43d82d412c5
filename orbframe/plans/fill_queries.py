"""Filling, components, packing, metrics on renders."""

from pyspark.sql import functions as F

from orbframe import FRAME
from orbframe.operators import components, fill, grid, packing, quality, warp
from orbframe.plans import sqltext as q
from orbframe.plans.lenses import PANO, STRONG, W, H, pano
from orbframe.plans.registry import query, r6, rounded
from orbframe.session import scratch_path
from orbframe.sources import rawframes, rawsink
from orbframe.plans.warp_queries import EYE, FILLED, NORM, SOFT, filled_eye, normalised

R4 = lambda *names: ", ".join(f"round({n}, 4) + 0.0 AS {n}" for n in names)
MASK = "masked AS (SELECT clip, f, y, x, d, r, g, b, (r * 3 + g * 5 + y * x) % 7 < 2 AS hole FROM norm)"
HOLE = "(r * 3 + g * 5 + y * x) % 7 < 2"


def masked(spark, sf):
    return normalised(spark, sf).withColumn("hole", F.expr(HOLE))


@query("directional_fill", f"""{NORM}, {MASK}, src AS (SELECT *, hole AS hole_d FROM masked), {q.directional('src', W, -1.0)}
SELECT clip, f, y, x, r, g, b, done FROM filled""")
def directional_fill(spark, sf):
    px = grid.by_frame(masked(spark, sf).withColumn("hole_d", F.col("hole")).drop("d"))
    return fill.directional(px, W, -1.0).select(*FRAME, "y", "x", "r", "g", "b", "done")


def _pyr(levels):
    means = ", ".join(
        f"p{k} AS (SELECT clip, f, y >> {k} AS py, x >> {k} AS px, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM masked WHERE NOT hole GROUP BY ALL)"
        for k in range(1, levels + 1))
    joins = " ".join(f"LEFT JOIN p{k} ON p{k}.clip = m.clip AND p{k}.f = m.f AND p{k}.py = m.y >> {k} AND p{k}.px = m.x >> {k}" for k in range(1, levels + 1))
    pick = lambda c: f"round(CASE WHEN m.hole THEN coalesce({', '.join(f'p{k}.{c}' for k in range(1, levels + 1))}) ELSE m.{c} END, 4) + 0.0 AS {c}"
    return f"{means} SELECT m.clip, m.f, m.y, m.x, {pick('r')}, {pick('g')}, {pick('b')} FROM masked m {joins}"


@query("pyramid_fill", f"{NORM}, {MASK}, {_pyr(4)}")
def pyramid_fill(spark, sf):
    px = grid.by_frame(masked(spark, sf).select(*FRAME, "y", "x", "r", "g", "b", "hole"))
    return rounded(fill.pyramid(px, 4).drop("hole"), "r", "g", "b", places=4)


@query("ring_threshold", f"""{NORM}, {MASK}, {q.morph('masked', 'hole', 'm0', 2, 'max', 'g0')},
st AS (SELECT clip, f, min(d) FILTER (m0 AND NOT hole) AS lo, max(d) FILTER (m0 AND NOT hole) AS hi FROM g0 GROUP BY clip, f)
SELECT clip, f, 2 AS radius, round(0.5 * (lo + hi), 6) + 0.0 AS threshold FROM st""")
def ring_threshold(spark, sf):
    px = grid.by_frame(masked(spark, sf).select(*FRAME, "y", "x", "d", "hole"))
    return rounded(fill.ring_threshold(px), "threshold")


COMP = f"""
cells AS (SELECT clip, f, y, x FROM masked WHERE hole),
reach AS (
  SELECT clip, f, y, x, y * 1000000 + x AS label FROM cells
  UNION
  SELECT c.clip, c.f, c.y, c.x, r.label FROM reach r JOIN cells c ON c.clip = r.clip AND c.f = r.f
    AND c.y BETWEEN r.y - 1 AND r.y + 1 AND c.x BETWEEN r.x - 1 AND r.x + 1),
labelled AS (SELECT clip, f, y, x, min(label) AS label FROM reach GROUP BY clip, f, y, x)"""
# Sparse enough that the recursive SQL stays small.
SPARSE = "masked AS (SELECT clip, f, y, x, d, r, g, b, (r * 7 + g * 11 + y * x * 3) % 13 < 2 AS hole FROM norm)"
SPARSE_HOLE = "(r * 7 + g * 11 + y * x * 3) % 13 < 2"
RNORM = NORM.replace("WITH", "WITH RECURSIVE", 1)


def sparse(spark, sf):
    return normalised(spark, sf).withColumn("hole", F.expr(SPARSE_HOLE))


@query("components", f"{RNORM}, {SPARSE}, {COMP} SELECT clip, f, y, x, label FROM labelled")
def hole_components(spark, sf):
    return components.label_pixels(components.components(sparse(spark, sf)))


@query("component_boxes", f"""{RNORM}, {SPARSE}, {COMP}
SELECT clip, f, label, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS area FROM labelled GROUP BY clip, f, label""")
def component_boxes(spark, sf):
    return components.component_boxes(components.components(sparse(spark, sf)))


@query("hole_boxes")
def hole_boxes(spark, sf):
    """Crops of z-buffer holes with a margin of one pixel, merged until disjoint."""
    eye = warp.synthesise(normalised(spark, sf), W, H, 10.0)
    return components.hole_boxes(components.component_boxes(components.components(eye)), W, H, margin=1)


@query("touching_components", f"""{RNORM}, {SPARSE},
seeds AS (SELECT clip, f, y, x FROM masked WHERE (y * 64 + x + f) % 97 = 0),
{COMP},
touched AS (SELECT DISTINCT l.clip, l.f, l.label FROM labelled l JOIN seeds s ON s.clip = l.clip AND s.f = l.f
  AND abs(s.y - l.y) <= 6 AND abs(s.x - l.x) <= 6)
SELECT clip, f, y, x FROM labelled SEMI JOIN touched USING (clip, f, label)""")
def touching_components(spark, sf):
    px = sparse(spark, sf).withColumnRenamed("hole", "near").withColumn("hole", (F.col("y") * 64 + F.col("x") + F.col("f")) % 97 == 0)
    return components.touching_components(px)


@query("learned_fill", f"""{RNORM}, {SPARSE}, {COMP},
bx AS (SELECT clip, f, label, min(x) - 2 AS x0, max(x) + 2 AS x1, min(y) - 2 AS y0, max(y) + 2 AS y1 FROM labelled GROUP BY clip, f, label),
mean AS (SELECT b.clip, b.f, b.label, avg(r) AS r, avg(g) AS g, avg(b.b) AS b FROM (
    SELECT bx.clip, bx.f, bx.label, m.r, m.g, m.b FROM bx JOIN masked m ON m.clip = bx.clip AND m.f = bx.f AND m.x BETWEEN x0 AND x1 AND m.y BETWEEN y0 AND y1 WHERE NOT m.hole) b GROUP BY ALL)
SELECT m.clip, m.f, m.y, m.x, m.hole, {", ".join(f"round(CASE WHEN m.hole THEN coalesce(n.{c}, m.{c}) ELSE m.{c} END, 4) + 0.0 AS {c}" for c in "rgb")}
FROM masked m LEFT JOIN labelled l USING (clip, f, y, x) LEFT JOIN mean n ON n.clip = l.clip AND n.f = l.f AND n.label = l.label""")
def learned_fill(spark, sf):
    """Component crops filled by a stand-in model: the mean of what is valid."""

    def make_model():
        def model(img, mask):
            return img * 0 + img[~mask].mean(axis=0) if (~mask).any() else img
        return model

    px = sparse(spark, sf).drop("d")
    return rounded(components.learned_fill(px, W, H, make_model, pad=2), "r", "g", "b", places=4)


# --- packing -------------------------------------------------------------

EYES = "eyes AS (SELECT 'left' AS eye, clip, f, y, x, r, g, b FROM pano UNION ALL SELECT 'right', clip, f, y, x, 255 - r, 255 - g, 255 - b FROM pano)"


def eyes(spark, sf):
    """The frame and its negative stand for the two eyes; no second scan."""
    side = lambda e, v: F.struct(F.lit(e).alias("eye"), *[v(F.col(c)).alias(c) for c in "rgb"])
    pair = F.array(side("left", lambda c: c), side("right", lambda c: 255 - c))
    return pano(spark, sf).select(*FRAME, "y", "x", F.explode(pair).alias("p")).select(*FRAME, "y", "x", "p.*")


@query("stack_eyes", f"WITH {PANO}, {EYES} SELECT clip, f, CASE WHEN eye = 'left' THEN y ELSE y + {H} END AS y, x, r, g, b FROM eyes")
def stack_eyes(spark, sf):
    return packing.stack_eyes(eyes(spark, sf), H)


@query("half_field", f"""WITH {PANO}, {EYES},
turned AS (SELECT *, (x - {(48 - 16) % 64} + 128) % 64 AS nx FROM eyes)
SELECT clip, f, y, CAST(CASE WHEN eye = 'left' THEN nx ELSE nx + 32 END AS INT) AS x, r, g, b FROM turned WHERE nx < 32""")
def half_field(spark, sf):
    """The 180 degrees round yaw 90, both eyes abreast."""
    return packing.side_by_side(eyes(spark, sf), W, 90.0)


@query("unpack_eyes", f"WITH {PANO}, {EYES} SELECT * FROM eyes")
def unpack_eyes(spark, sf):
    return packing.unpack_stacked(packing.stack_eyes(eyes(spark, sf), H), H)


def _area_axis(axis, n, m):
    s = f"({n}.0 / {m}.0)"
    return f"""{axis}s AS (SELECT CAST(i AS INT) AS {axis}, CAST(j AS INT) AS o{axis}, least(i + 1.0, (j + 1) * {s}) - greatest(i * 1.0, j * {s}) AS w{axis}
      FROM range({n}) a(i), range({m}) b(j) WHERE least(i + 1.0, (j + 1) * {s}) - greatest(i * 1.0, j * {s}) > 1e-9)"""


@query("area_resize", f"""WITH {PANO}, {_area_axis('x', W, 40)}, {_area_axis('y', H, 20)}
SELECT clip, f, oy AS y, ox AS x, {', '.join(f'round(sum({c} * wx * wy) / sum(wx * wy), 4) + 0.0 AS {c}' for c in 'rgbd')}
FROM pano JOIN xs USING (x) JOIN ys USING (y) GROUP BY clip, f, oy, ox""")
def area_resize(spark, sf):
    return rounded(packing.area_resize(pano(spark, sf), W, H, 40, 20, ["r", "g", "b", "d"]), "r", "g", "b", "d", places=4)


@query("block_roundtrip", f"WITH {PANO} SELECT clip, f, y, x, r, g, b FROM pano")
def block_roundtrip(spark, sf):
    """Pixels to binary tiles and back."""
    px = pano(spark, sf).select(*FRAME, "y", "x", "r", "g", "b")
    return grid.explode_blocks(grid.pack_blocks(px, 16), 16)


@query("raw_sink", f"WITH {PANO} SELECT clip, f, y, x, r, g, b FROM pano")
def raw_sink(spark, sf):
    """All panoramas written as raw frames by the data source's writer, and read back."""
    folder = scratch_path(spark, "raw")
    rawsink.write_raw(pano(spark, sf).select(*FRAME, "y", "x", "r", "g", "b"), folder, W, H)
    return rawframes.frame_pixels(rawsink.read_written(spark, folder, W, H), W)


@query("zero_strength", f"WITH {PANO} SELECT clip, f, y, x, r, g, b, false AS hole FROM pano")
def zero_strength(spark, sf):
    """Without strength an eye is the picture itself, and has no holes."""
    return warp.synthesise(pano(spark, sf), W, H, 0.0)


# --- metrics -------------------------------------------------------------


@query("fingerprint", f"""WITH {PANO}
SELECT clip, f, CAST(y // 4 AS INT) AS gy, CAST(x // 4 AS INT) AS gx, {', '.join(f'round(avg({c}), 6) + 0.0 AS {c}' for c in 'rgbd')} FROM pano GROUP BY ALL""")
def fingerprint(spark, sf):
    return rounded(quality.fingerprint(pano(spark, sf), H, W, 8, 16, ["r", "g", "b", "d"]), "r", "g", "b", "d")


@query("fingerprint_compare", f"""{NORM}, {SOFT},
ga AS (SELECT clip, f, y // 4 AS gy, x // 4 AS gx, avg(d) AS v FROM norm GROUP BY ALL),
gb AS (SELECT clip, f, y // 4 AS gy, x // 4 AS gx, avg(d) AS v FROM soft GROUP BY ALL),
sa AS (SELECT clip, f, gy, gx, v / greatest(max(v) OVER w - min(v) OVER w, 1e-6) * 255.0 AS v FROM ga WINDOW w AS (PARTITION BY clip, f)),
sb AS (SELECT clip, f, gy, gx, v / greatest(max(v) OVER w - min(v) OVER w, 1e-6) * 255.0 AS v FROM gb WINDOW w AS (PARTITION BY clip, f)),
j AS (SELECT clip, f, gy, gx, abs(sa.v - sb.v) AS diff FROM sa JOIN sb USING (clip, f, gy, gx)),
best AS (SELECT *, row_number() OVER (PARTITION BY clip, f ORDER BY diff DESC, gy, gx) AS rn FROM j)
SELECT clip, f, round(max(diff), 4) + 0.0 AS worst, round(avg(diff), 4) + 0.0 AS mean, CAST(max(gy) FILTER (rn = 1) AS INT) AS gy,
  CAST(max(gx) FILTER (rn = 1) AS INT) AS gx, max(diff) <= 0.30 AS same FROM best GROUP BY clip, f""")
def fingerprint_compare(spark, sf):
    px = grid.by_frame(normalised(spark, sf).select(*FRAME, "y", "x", "d"))
    print_of = lambda df: quality.fingerprint(df, H, W, 8, 16, ["d"])
    return rounded(quality.compare_fingerprints(print_of(px), print_of(warp.soften_edges(px)), "d", depth=True), "worst", "mean", places=4)


@query("conditioning", f"""{EYE}, pert AS (SELECT * REPLACE (least(1.0, d + 0.02 * ((x * 7 + y * 3) % 5) / 5.0) AS d) FROM norm),
{q.eye('pert', STRONG, W, H, 'eye2')},
j AS (SELECT clip, f, (abs(a.r - c.r) + abs(a.g - c.g) + abs(a.b - c.b)) / 3.0 AS diff FROM eye a JOIN eye2 c USING (clip, f, y, x) WHERE NOT a.hole AND NOT c.hole)
SELECT clip, f, round(avg(diff), 4) + 0.0 AS mean_change, round(avg(CASE WHEN diff > 8 THEN 1.0 ELSE 0.0 END), 4) + 0.0 AS jump_share,
  round(avg(CASE WHEN diff > 32 THEN 1.0 ELSE 0.0 END), 4) + 0.0 AS pop_share FROM j GROUP BY clip, f""")
def conditioning(spark, sf):
    """Change of a render when its depth is disturbed."""
    px = normalised(spark, sf)
    moved = px.withColumn("d", F.least(F.lit(1.0), F.col("d") + 0.02 * ((F.col("x") * 7 + F.col("y") * 3) % 5) / 5.0))
    out = quality.response(warp.synthesise(px, W, H, STRONG), warp.synthesise(moved, W, H, STRONG))
    return rounded(out, "mean_change", "jump_share", "pop_share", places=4)


@query("rmse", f"""WITH {PANO}, {_area_axis('x', W, 32)}, {_area_axis('y', H, 16)},
small AS (SELECT clip, f, oy, ox, {', '.join(f'sum({c} * wx * wy) / sum(wx * wy) AS {c}' for c in 'rgb')} FROM pano JOIN xs USING (x) JOIN ys USING (y) GROUP BY clip, f, oy, ox)
SELECT p.clip, p.f, round(sqrt(avg(((p.r - s.r)**2 + (p.g - s.g)**2 + (p.b - s.b)**2) / 3)), 4) + 0.0 AS rmse
FROM pano p JOIN small s ON s.clip = p.clip AND s.f = p.f AND s.oy = p.y // 2 AND s.ox = p.x // 2 GROUP BY p.clip, p.f""")
def rmse(spark, sf):
    """Error of a frame shrunk to half size and repeated back up."""
    px = pano(spark, sf)
    small = packing.area_resize(px, W, H, W // 2, H // 2, ["r", "g", "b"])
    twice = F.array(F.lit(0), F.lit(1))
    back = small.withColumn("j", F.explode(twice)).withColumn("i", F.explode(twice)).withColumns(
        {"y": F.col("y") * 2 + F.col("j"), "x": F.col("x") * 2 + F.col("i")})
    return rounded(quality.rmse(back, px, ["r", "g", "b"]), "rmse", places=4)


@query("eye_difference", f"""{FILLED}
SELECT n.clip, n.f, round(avg((abs(n.r - e.r) + abs(n.g - e.g) + abs(n.b - e.b)) / 3.0), 4) + 0.0 AS eye_difference
FROM norm n JOIN filled e USING (clip, f, y, x) WHERE n.y >= {int(H * .35)} AND n.y < {int(H * .65)} GROUP BY n.clip, n.f""")
def eye_difference(spark, sf):
    px = normalised(spark, sf)
    colours = lambda df, e: df.select(*FRAME, "y", "x", *[F.col(c).cast("double").alias(c) for c in "rgb"], F.lit(e).alias("eye"))
    return rounded(quality.eye_difference(colours(px, "left").unionByName(colours(filled_eye(px), "right")), H), "eye_difference", places=4)


@query("hole_share_cube", f"""{NORM}, {q.zbuffer('norm', STRONG, W, H, 'zr')}, {q.zbuffer('norm', -STRONG, W, H, 'zl')},
m AS (SELECT n.clip, 'right' AS eye, z.dist IS NULL AS hole FROM norm n LEFT JOIN zr z USING (clip, f, y, x)
  UNION ALL SELECT n.clip, 'left', z.dist IS NULL FROM norm n LEFT JOIN zl z USING (clip, f, y, x))
SELECT clip, eye, round(avg(CASE WHEN hole THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS hole_share FROM m GROUP BY CUBE (clip, eye)""")
def hole_share_cube(spark, sf):
    px = grid.by_frame(normalised(spark, sf).select(*FRAME, "y", "x", "d")).withColumn("dist", warp.distance(F.col("d")))
    side = lambda s, e: warp.zbuffer(px, W, H, s).select("clip", F.lit(e).alias("eye"), F.col("dist").isNull().alias("hole"))
    return rounded(quality.hole_share_cube(side(STRONG, "right").unionByName(side(-STRONG, "left"))), "hole_share")


def _soft_of(src, p):
    return SOFT.replace("norm", src).replace("soft", f"{p}soft").replace("sl AS", f"{p}sl AS").replace("sl_x", f"{p}sl_x").replace("FROM sl", f"FROM {p}sl") \
        .replace("sh AS", f"{p}sh AS").replace("sh_x", f"{p}sh_x").replace("FROM sh", f"FROM {p}sh").replace("so AS", f"{p}so AS").replace("so_x", f"{p}so_x").replace("FROM so)", f"FROM {p}so)")


LEVELS = (0.0005, 0.002, 0.008)
NOISE = "((x * 13 + y * 7 + f * 3) % 11 - 5) / 5.0"


@query("lipschitz", f"""{NORM}, {SOFT}, {', '.join(f"n{i} AS (SELECT * REPLACE (d + {s} * {NOISE} AS d) FROM norm), {_soft_of(f'n{i}', f'k{i}')}" for i, s in enumerate(LEVELS))},
ch AS ({' UNION ALL '.join(f"SELECT CAST({s} AS DOUBLE) AS sigma, abs(a.d - c.d) AS change FROM soft a JOIN k{i}soft c USING (clip, f, y, x)" for i, s in enumerate(LEVELS))}),
per AS (SELECT sigma, max(change) AS peak, avg(change) AS mean FROM ch GROUP BY sigma)
SELECT sigma, round(peak, 6) + 0.0 AS peak, round(mean, 6) + 0.0 AS mean, round(peak / sigma, 4) + 0.0 AS gain,
  round(mean / lag(mean) OVER (ORDER BY sigma), 4) + 0.0 AS growth FROM per""")
def lipschitz(spark, sf):
    """Response of edge softening to three noise levels."""
    px = grid.by_frame(normalised(spark, sf).select(*FRAME, "y", "x", "d"))
    noise = ((F.col("x") * 13 + F.col("y") * 7 + F.col("f") * 3) % 11 - 5) / 5.0
    base = warp.soften_edges(px).withColumnRenamed("d", "d0")
    parts = None
    for s in LEVELS:
        soft = warp.soften_edges(px.withColumn("d", F.col("d") + s * noise)).join(base, [*FRAME, "y", "x"])
        part = soft.select(F.lit(s).alias("sigma"), F.abs(F.col("d") - F.col("d0")).alias("change"))
        parts = part if parts is None else parts.unionByName(part)
    return rounded(rounded(quality.lipschitz(parts), "peak", "mean"), "gain", "growth", places=4)


@query("stage_times", """WITH t AS (SELECT event_type AS stage, CAST(month(ts) * 100 + day(ts) AS INT) - 101 AS frame, value AS seconds FROM events),
k AS (SELECT * FROM t WHERE frame >= 1), per AS (SELECT stage, sum(seconds) AS seconds FROM k GROUP BY stage)
SELECT stage, round(seconds, 4) + 0.0 AS seconds, round(seconds / (SELECT greatest(count(DISTINCT frame), 1) FROM k), 6) + 0.0 AS per_frame,
  round(seconds / sum(seconds) OVER (), 6) + 0.0 AS share FROM per""")
def stage_times(spark, sf):
    """Event types as stages and days as frames."""
    from orbframe.plans.lenses import table
    ev = table(spark, sf, "events").select(
        F.col("event_type").alias("stage"), (F.month("ts") * 100 + F.dayofmonth("ts") - 101).alias("frame"), F.col("value").alias("seconds"))
    return rounded(rounded(quality.stage_times(ev), "per_frame", "share"), "seconds", places=4)
