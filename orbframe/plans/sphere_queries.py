"""Directions, faces, resampling."""

from pyspark.sql import functions as F

from orbframe import FRAME
from orbframe.functions import sphere
from orbframe.operators import faces, grid, quality
from orbframe.plans import sqltext as q
from orbframe.plans.lenses import PANO, W, H, pano
from orbframe.plans.registry import query, r6, rounded

SIZE, WIDE, REACH = 16, 32, 1.15
OWN = q.owner()
COORD = lambda t, n, reach=1.0: f"(({t} / {reach} + 1.0) * 0.5 * {n} - 0.5)"
R4 = lambda *names: ", ".join(f"round({n}, 4) + 0.0 AS {n}" for n in names)


@query("directions", f"""WITH {PANO}, {q.ray('pano', W, H)},
pt AS (SELECT *, sqrt(dx*d*dx*d + dy*d*dy*d + dz*d*dz*d) AS norm FROM rayed)
SELECT clip, f, y, x, round(dx, 6) + 0.0 AS dx, round(dy, 6) + 0.0 AS dy, round(dz, 6) + 0.0 AS dz, {OWN['face']} AS face,
  round({OWN['a']}, 6) + 0.0 AS a, round({OWN['b']}, 6) + 0.0 AS b, CAST(x AS DOUBLE) AS u, CAST(y AS DOUBLE) AS v, round(norm, 6) + 0.0 AS norm
FROM pt""")
def directions(spark, sf):
    """Pixel to ray, ray to face, and the point at depth d back to its pixel."""
    px = grid.rays(pano(spark, sf).select(*FRAME, "y", "x", "d"), W, H)
    own = grid.pin(px, {"own": sphere.owner(F.col("dx"), F.col("dy"), F.col("dz"))})
    u, v, norm = sphere.uv_of_point(F.col("dx") * F.col("d"), F.col("dy") * F.col("d"), F.col("dz") * F.col("d"), W, H)
    out = own.withColumns({"u": u, "v": v, "norm": norm}).select(*FRAME, "y", "x", "dx", "dy", "dz", "own.*", "u", "v", "norm")
    return rounded(out, "dx", "dy", "dz", "a", "b", "u", "v", "norm")


@query("face_census", f"""WITH {PANO}, {q.ray('pano', W, H)}
SELECT clip, f, {OWN['face']} AS face, count(*) AS pixels, round(avg(d), 6) + 0.0 AS mean_d FROM rayed GROUP BY ALL""")
def face_census(spark, sf):
    px = grid.rays(pano(spark, sf).select(*FRAME, "y", "x", "d"), W, H)
    own = grid.pin(px, {"face": sphere.owner(F.col("dx"), F.col("dy"), F.col("dz"))["face"]})
    return own.groupBy(*FRAME, "face").agg(F.count(F.lit(1)).alias("pixels"), r6(F.avg("d")).alias("mean_d"))


PU, PV = q.uv("dx", "dy", "dz", W, H)


def to_faces(size: int, reach: float, values: list[str], name: str) -> str:
    return f"""
{q.face_px(size, reach, name + '_px')},
{name}_uv AS (SELECT face, y, x, {PU} AS u, {PV} AS v FROM {name}_px),
{q.bilinear('pano', name + '_uv', [], values, ['face', 'y', 'x'], W, H, True, name)}"""


CUBE = f"WITH {PANO}, {q.AXES}, {to_faces(SIZE, 1.0, ['r', 'g', 'b', 'd'], 'cube')}"


def cube(spark, sf):
    return faces.panorama_to_faces(pano(spark, sf), W, H, SIZE, ["r", "g", "b", "d"])


@query("cubemap_sample", f"{CUBE} SELECT clip, f, face, y, x, {R4('r', 'g', 'b', 'd')} FROM cube")
def cubemap_sample(spark, sf):
    return rounded(cube(spark, sf), "r", "g", "b", "d", places=4)


IDX = "(list_position(['+X','-X','+Y','-Y','+Z','-Z'], {0}) - 1)"
SHEET = f"""
sheet AS (SELECT clip, f, CAST(y + {IDX.format('face')} // 3 * {SIZE} AS INT) AS y, CAST(x + {IDX.format('face')} % 3 * {SIZE} AS INT) AS x, r, g, b FROM cube),
out_px AS (SELECT CAST(j AS INT) AS y, CAST(i AS INT) AS x FROM range({H}) a(j), range({W}) b(i)),
{q.ray('out_px', W, H, 'out_ray')},
sheet_uv AS (SELECT y, x, {COORD(OWN['a'], SIZE)} + {IDX.format(OWN['face'])} % 3 * {SIZE} AS u,
  {COORD(OWN['b'], SIZE)} + {IDX.format(OWN['face'])} // 3 * {SIZE} AS v FROM out_ray),
{q.bilinear('sheet', 'sheet_uv', [], ['r', 'g', 'b'], ['y', 'x'], 3 * SIZE, 2 * SIZE, False, 'trip', zero=True)}"""


@query("cubemap_roundtrip", f"{CUBE}, {SHEET} SELECT clip, f, y, x, {R4('r', 'g', 'b')} FROM trip")
def cubemap_roundtrip(spark, sf):
    """Panorama to faces and back through the colour sheet."""
    return rounded(faces.round_trip(pano(spark, sf), W, H, SIZE, ["r", "g", "b"]), "r", "g", "b", places=4)


OUT_OWN = f"""
out_px AS (SELECT CAST(j AS INT) AS y, CAST(i AS INT) AS x FROM range({H}) a(j), range({W}) b(i)),
{q.ray('out_px', W, H, 'out_ray')},
out_uv AS (SELECT y, x, {OWN['face']} AS sface, {COORD(OWN['a'], SIZE)} AS u, {COORD(OWN['b'], SIZE)} AS v FROM out_ray)"""


@query("cubemap_nearest", f"""{CUBE}, {OUT_OWN}
SELECT c.clip, c.f, o.y, o.x, {', '.join(f'round(c.{n}, 4) + 0.0 AS {n}' for n in 'rgbd')}
FROM out_uv o JOIN cube c ON c.face = o.sface AND c.y = CAST(greatest(0, least({SIZE - 1}, round_even(o.v, 0))) AS INT)
  AND c.x = CAST(greatest(0, least({SIZE - 1}, round_even(o.u, 0))) AS INT)""")
def cubemap_nearest(spark, sf):
    return rounded(faces.faces_to_panorama(cube(spark, sf), SIZE, W, H, ["r", "g", "b", "d"], "nearest"), "r", "g", "b", "d", places=4)


def PADDED_OF(src):
    return f"""
{q.face_px(SIZE + 4, (SIZE + 4) / SIZE, 'wide_px')},
ring AS (SELECT face, y - 2 AS y, x - 2 AS x, {OWN['face']} AS sface, {COORD(OWN['a'], SIZE)} AS u, {COORD(OWN['b'], SIZE)} AS v FROM wide_px
  WHERE y < 2 OR x < 2 OR y >= {SIZE + 2} OR x >= {SIZE + 2}),
{q.bilinear(src, 'ring', [], ['d'], ['face', 'y', 'x'], SIZE, SIZE, False, 'rim', face=True)},
padded AS (SELECT clip, f, face, y, x, d FROM {src} UNION ALL SELECT clip, f, face, y, x, d FROM rim)"""


PADDED = PADDED_OF("cube")


@query("padded_faces", f"{CUBE}, {PADDED} SELECT clip, f, face, y, x, {R4('d')} FROM padded")
def padded_faces(spark, sf):
    return rounded(faces.pad_faces(cube(spark, sf), SIZE, 2, ["d"]), "d", places=4)


@query("depth_panorama", f"""{CUBE}, {PADDED}, {OUT_OWN},
{q.bilinear('padded', 'out_uv', [], ['d'], ['y', 'x'], SIZE, SIZE, False, 'dpano', face=True, zero=True)}
SELECT clip, f, y, x, {R4('d')} FROM dpano""")
def depth_panorama(spark, sf):
    """Depth faces to a panorama; edges read the padded neighbour."""
    return rounded(faces.faces_to_panorama(cube(spark, sf), SIZE, W, H, ["d"]), "d", places=4)


WIDENED = f"WITH {PANO}, {q.AXES}, {to_faces(WIDE, REACH, ['r', 'g', 'b', 'd'], 'wide')}"


def widened(spark, sf, values=("r", "g", "b", "d")):
    return faces.panorama_to_faces(pano(spark, sf), W, H, WIDE, list(values), sphere.FACE_OVERLAP)


@query("overlapping_faces", f"{WIDENED} SELECT clip, f, face, y, x, {R4('r', 'g', 'b', 'd')} FROM wide")
def overlapping_faces(spark, sf):
    return rounded(widened(spark, sf), "r", "g", "b", "d", places=4)


@query("widened_from_faces", f"""{CUBE}, {q.face_px(SIZE, REACH, 'wp')},
wuv AS (SELECT face, y, x, {OWN['face']} AS sface, {COORD(OWN['a'], SIZE)} AS u, {COORD(OWN['b'], SIZE)} AS v FROM wp),
{q.bilinear('cube', 'wuv', [], ['r', 'g', 'b', 'd'], ['face', 'y', 'x'], SIZE, SIZE, False, 'wfc', face=True)}
SELECT clip, f, face, y, x, {R4('r', 'g', 'b', 'd')} FROM wfc""")
def widened_from_faces(spark, sf):
    return rounded(faces.widen_faces(cube(spark, sf), SIZE, ["r", "g", "b", "d"]), "r", "g", "b", "d", places=4)


SLOT = "(list_position(['+X','-X','+Y','-Y','+Z','-Z'], face) - 1)"


@query("packed_faces", f"{CUBE} SELECT clip, f, face, y - 1 AS y, x - 1 AS x, {R4('r', 'g', 'b')} FROM cube WHERE y BETWEEN 1 AND {SIZE - 2} AND x BETWEEN 1 AND {SIZE - 2}")
def packed_faces(spark, sf):
    """Faces laid out 3x2 and taken apart again, one pixel of padding cropped."""
    slot = F.array_position(F.array(*[F.lit(n) for row in faces.LAYOUT_3X2 for n in row]), F.col("face")).cast("int") - 1
    sheet = cube(spark, sf).withColumn("s", slot).select(
        *FRAME, (F.col("y") + (F.col("s") / 3).cast("int") * SIZE).alias("y"), (F.col("x") + F.col("s") % 3 * SIZE).alias("x"), "r", "g", "b")
    return rounded(faces.packed_faces(sheet, 3 * SIZE, 2 * SIZE, 1), "r", "g", "b", places=4)


FADE = lambda t: f"(0.5 + 0.5 * cos(pi() * greatest(0.0, least(1.0, (abs({t}) - 0.85) / 0.3))))"
BLEND = f"""
out_px AS (SELECT CAST(j AS INT) AS y, CAST(i AS INT) AS x FROM range({H}) a(j), range({W}) b(i)),
{q.ray('out_px', W, H, 'out_ray')},
dots AS (SELECT y, x, face AS sface, dx*ox + dy*oy + dz*oz AS t, dx*rx + dy*ry + dz*rz AS p, dx*ex + dy*ey + dz*ez AS s FROM out_ray, axes),
seen AS (SELECT y, x, sface, p / t AS a, s / t AS b FROM dots WHERE t > 1e-6 AND abs(p / t) <= {REACH} AND abs(s / t) <= {REACH}),
weighed AS (SELECT *, {FADE('a')} * {FADE('b')} AS w0 FROM seen),
blend_map AS (SELECT y, x, sface, {COORD('a', WIDE, REACH)} AS u, {COORD('b', WIDE, REACH)} AS v,
  w0 / greatest(sum(w0) OVER (PARTITION BY y, x), 1e-6) AS wt FROM weighed)"""


@query("overlap_plan_sums", f"""WITH {PANO}, {q.AXES}, {BLEND}
SELECT p.clip, p.f, m.sface, round(sum(wt), 6) + 0.0 AS weight, round(sum(wt * d), 6) + 0.0 AS weighed_d, count(*) AS pixels
FROM pano p JOIN blend_map m USING (y, x) GROUP BY ALL""")
def overlap_plan_sums(spark, sf):
    """How much of every frame each widened face contributes."""
    gmap = faces.blend_map(spark, W, H, WIDE).select("y", "x", "sface", "wt")
    px = pano(spark, sf).select(*FRAME, "y", "x", "d").join(grid.shared_map(gmap, 6 * W * H), ["y", "x"])
    return px.groupBy(*FRAME, "sface").agg(
        r6(F.sum("wt")).alias("weight"), r6(F.sum(F.col("wt") * F.col("d"))).alias("weighed_d"), F.count(F.lit(1)).alias("pixels"))


@query("blend_weights", f"""WITH {PANO}, {q.AXES}, {BLEND}, t AS (SELECT y, x, sum(wt) AS total, count(*) AS n FROM blend_map GROUP BY y, x)
SELECT p.clip, p.f, p.y, p.x, round(total, 6) + 0.0 AS total, n, abs(total - 1.0) <= 1e-5 AS whole FROM pano p JOIN t USING (y, x)""")
def blend_weights(spark, sf):
    """The weights that each pixel of every frame is blended with add up to one."""
    gmap = faces.blend_map(spark, W, H, WIDE)
    per = gmap.groupBy("y", "x").agg(F.sum("wt").alias("total"), F.count(F.lit(1)).alias("n"))
    off = quality.weight_sums(gmap).select("y", "x", F.lit(False).alias("whole"))
    checked = per.join(off, ["y", "x"], "left").withColumn("whole", F.coalesce("whole", F.lit(True)))
    px = pano(spark, sf).select(*FRAME, "y", "x").join(grid.shared_map(checked, W * H), ["y", "x"])
    return rounded(px.select(*FRAME, "y", "x", "total", "n", "whole"), "total")


@query("overlap_blend", f"""{WIDENED}, {BLEND},
{q.bilinear('wide', 'blend_map', [], ['d'], ['y', 'x', 'sface', 'wt'], WIDE, WIDE, False, 'tap', face=True)}
SELECT clip, f, y, x, round(sum(d * wt), 4) + 0.0 AS d FROM tap GROUP BY clip, f, y, x""")
def overlap_blend(spark, sf):
    return rounded(faces.blend_faces(widened(spark, sf, ["d"]), WIDE, W, H), "d", places=4)
