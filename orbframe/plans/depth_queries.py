"""Depth models, tiles, smoothing, alignment."""

import numpy as np
from pyspark.sql import functions as F

from orbframe import FRAME
from orbframe.functions import sphere
from orbframe.operators import align, depth, faces, grid, packing, quality
from orbframe.plans import sqltext as q
from orbframe.plans.lenses import PANO, H, W, pano
from orbframe.plans.registry import query, r6, rounded
from orbframe.plans.sphere_queries import BLEND, COORD, CUBE, OUT_OWN, OWN, PADDED_OF, REACH, SIZE, WIDE, WIDENED, cube, to_faces, widened
from orbframe.plans.time_queries import WIDE_CHUNK

FACE = [*FRAME, "face"]
LUMA = """
luma AS (SELECT clip, f, face, y, x, (r + g + b) / 3.0 / 255.0 AS v FROM wide),
span AS (SELECT clip, f, face, min(v) AS lo, max(v) AS hi FROM luma GROUP BY clip, f, face),
dep AS (SELECT clip, f, face, y, x, pow((v - lo) / greatest(hi - lo, 1e-6), 1.4) + 0.05 AS d FROM luma JOIN span USING (clip, f, face))"""
DEPTH = f"{WIDENED}, {LUMA}"


def face_depth(spark, sf):
    return depth.luma_model(widened(spark, sf, ["r", "g", "b"]), FACE)


@query("luma_depth", f"{DEPTH} SELECT clip, f, face, y, x, round(d, 5) + 0.0 AS d FROM dep")
def luma_depth(spark, sf):
    return rounded(face_depth(spark, sf), "d", places=5)


def luma_network():
    """The stand-in model on image batches, for the model interface."""

    def run(images):
        v = images.mean(axis=-1)
        lo, hi = v.min(axis=(1, 2), keepdims=True), v.max(axis=(1, 2), keepdims=True)
        return ((v - lo) / np.maximum(hi - lo, 1e-6)) ** 1.4 + 0.05

    return run


PANO_LUMA = """
luma AS (SELECT clip, f, y, x, (r + g + b) / 3.0 / 255.0 AS v FROM pano),
span AS (SELECT clip, f, min(v) AS lo, max(v) AS hi FROM luma GROUP BY clip, f),
dep AS (SELECT clip, f, y, x, pow((v - lo) / greatest(hi - lo, 1e-6), 1.4) + 0.05 AS d FROM luma JOIN span USING (clip, f))"""


@query("model_depth", f"WITH {PANO}, {PANO_LUMA} SELECT clip, f, y, x, round(d, 4) + 0.0 AS d FROM dep")
def model_depth(spark, sf):
    """The stand-in model through the batched model interface."""
    return rounded(depth.model_depth(pano(spark, sf), FRAME, W, H, luma_network), "d", places=4)


@query("temporal_depth", f"""WITH {PANO}, {WIDE_CHUNK},
luma AS (SELECT clip, chunk, f, y, x, (r + g + b) / 3.0 / 255.0 AS v FROM wide),
mean AS (SELECT clip, chunk, y, x, avg(v) AS m FROM luma GROUP BY ALL)
SELECT clip, CAST(chunk AS INT) AS chunk, '+Z' AS face, f, y, x, round(greatest(0.0, 0.5 * v + 0.5 * m - 0.3), 4) + 0.0 AS d FROM luma JOIN mean USING (clip, chunk, y, x)""")
def temporal_depth(spark, sf):
    """A model that sees a whole chunk: half its own frame, half the mean."""

    def make_model():
        return lambda stack: 0.5 * stack.mean(-1) + 0.5 * stack.mean(-1).mean(0, keepdims=True) - 0.3

    px = pano(spark, sf).withColumns({"chunk": F.floor(F.col("f") / 5).cast("int"), "face": F.lit("+Z")})
    return rounded(depth.temporal_depth(px, W, H, make_model), "d", places=4)


def _area(n, m, axis):
    s = f"({n}.0 / {m}.0)"
    return f"""{axis}s AS (SELECT CAST(i AS INT) AS {axis}, CAST(j AS INT) AS o{axis}, least(i + 1.0, (j + 1) * {s}) - greatest(i * 1.0, j * {s}) AS w{axis}
      FROM range({n}) a(i), range({m}) b(j) WHERE least(i + 1.0, (j + 1) * {s}) - greatest(i * 1.0, j * {s}) > 1e-9)"""


@query("preprocess", f"""WITH {PANO}, {_area(W, 28, 'x')}, {_area(H, 14, 'y')}
SELECT clip, f, oy AS y, ox AS x, {', '.join(f'round((sum({c} * wx * wy) / sum(wx * wy) / 255.0 - {m}) / {s}, 4) + 0.0 AS {c}' for c, m, s in zip('rgb', depth.IMAGE_MEAN, depth.IMAGE_STD))}
FROM pano JOIN xs USING (x) JOIN ys USING (y) GROUP BY clip, f, oy, ox""")
def preprocess(spark, sf):
    return rounded(depth.preprocess(pano(spark, sf), FRAME, W, H, 28, 14), "r", "g", "b", places=4)


def _cubic(axis, n, m):
    """CTE of taps ``i`` and weights for each new place along an axis."""
    a = depth.CUBIC
    near = lambda x: f"((({a} + 2.0) * {x} - ({a} + 3.0)) * {x} * {x} + 1.0)"
    far = lambda x: f"((({x} - 5.0) * {x} + 8.0) * {x} * {a} - 4.0 * {a})"
    return f"""{axis}c AS (SELECT CAST(j AS INT) AS o{axis}, (j + 0.5) * ({n}.0 / {m}) - 0.5 AS p FROM range({m}) a(j)),
{axis}w AS (SELECT o{axis}, k, CAST(greatest(0, least({n - 1}, floor(p) + k)) AS INT) AS {axis},
  CASE k WHEN -1 THEN {far('(p - floor(p) + 1.0)')} WHEN 0 THEN {near('(p - floor(p))')} WHEN 1 THEN {near('(1.0 - (p - floor(p)))')}
    ELSE {far('(2.0 - (p - floor(p)))')} END AS w{axis} FROM {axis}c, (VALUES (-1), (0), (1), (2)) t(k))"""


@query("preprocess_enlarged", f"""WITH {PANO}, {_cubic('x', W, 98)}, {_cubic('y', H, 56)}
SELECT clip, f, oy AS y, ox AS x, {', '.join(f'round((sum({c} * wx * wy) / 255.0 - {m}) / {s}, 4) + 0.0 AS {c}' for c, m, s in zip('rgb', depth.IMAGE_MEAN, depth.IMAGE_STD))}
FROM pano JOIN xw USING (x) JOIN yw USING (y) GROUP BY clip, f, oy, ox""")
def preprocess_enlarged(spark, sf):
    """Images smaller than the model's input, enlarged by cubic taps."""
    return rounded(depth.preprocess(pano(spark, sf), FRAME, W, H, 98, 56), "r", "g", "b", places=4)


@query("depth_resize", f"""WITH {PANO}, {PANO_LUMA},
small AS (SELECT clip, f, y, x, d FROM dep),
grid_uv AS (SELECT CAST(j AS INT) AS y, CAST(i AS INT) AS x, (i + 0.5) * ({W}.0 / 96) - 0.5 AS u, (j + 0.5) * ({H}.0 / 48) - 0.5 AS v FROM range(48) a(j), range(96) b(i)),
{q.bilinear('small', 'grid_uv', [], ['d'], ['y', 'x'], W, H, False, 'big')}
SELECT clip, f, y, x, round(d, 5) + 0.0 AS d FROM big""")
def depth_resize(spark, sf):
    """Model output brought back to a larger input size."""
    return rounded(depth.resize_bilinear(depth.luma_model(pano(spark, sf), FRAME), FRAME, W, H, 96, 48, ["d"]), "d", places=5)


# --- tiles on the widened faces -----------------------------------------

SPANS = depth.tile_spans(WIDE, 2)
PAD = int(WIDE // 2 * 0.125)
RAMP = lambda c, s, e: (
    f"(CASE WHEN {e} < {WIDE} AND {e} - 1 - {c} < {PAD} THEN 0.5 - 0.5 * cos(pi() * ({e} - 1 - {c}) / {PAD}) "
    f"WHEN {s} > 0 AND {c} - {s} < {PAD} THEN 0.5 - 0.5 * cos(pi() * ({c} - {s}) / {PAD}) ELSE 1.0 END)"
)


TILED = f"""{WIDENED}, {LUMA}, sp(t, s, e) AS (VALUES {', '.join(str(s) for s in SPANS)}),
tp AS (SELECT w.*, (w.r + w.g + w.b) / 3.0 / 255.0 AS v, a.t AS ty, b.t AS tx, {RAMP('y', 'a.s', 'a.e')} * {RAMP('x', 'b.s', 'b.e')} AS wt
  FROM wide w JOIN sp a ON w.y >= a.s AND w.y < a.e JOIN sp b ON w.x >= b.s AND w.x < b.e),
ts AS (SELECT clip, f, face, ty, tx, min(v) AS lo, max(v) AS hi FROM tp GROUP BY ALL),
td AS (SELECT tp.*, pow((v - lo) / greatest(hi - lo, 1e-6), 1.4) + 0.05 AS td FROM tp JOIN ts USING (clip, f, face, ty, tx)),
tr AS (SELECT td.*, dep.d AS ref FROM td JOIN dep USING (clip, f, face, y, x)),
tf AS (SELECT clip, f, face, ty, tx, greatest(0.25, least(4.0, sum(td * ref) / sum(td * td))) AS s FROM tr GROUP BY ALL)"""


@query("tile_merge", f"""{TILED}
SELECT clip, f, face, y, x, round(sum(td * s * wt) / greatest(sum(wt), 1e-6), 5) + 0.0 AS d FROM tr JOIN tf USING (clip, f, face, ty, tx) GROUP BY clip, f, face, y, x""")
def tile_merge(spark, sf):
    """Depth per overlapping tile, scaled to the whole face and feathered."""
    return rounded(depth.tiled_depth(widened(spark, sf, ["r", "g", "b"]), FACE, WIDE, 2, depth.luma_model), "d", places=5)


R = 2


def _box_sql(src, cols, name):
    """Mirrored box mean by joining every pixel with its neighbours."""
    avg = ", ".join(f"avg(s.{c}) AS {c}" for c in cols)
    fold = lambda t, n: f"(CASE WHEN {t} < 0 THEN -1 - ({t}) WHEN {t} >= {n} THEN 2 * {n} - 1 - ({t}) ELSE {t} END)"
    return f"""{name} AS (SELECT p.clip, p.f, p.y, p.x, {avg} FROM pano p, range(-{R}, {R + 1}) o(dy), range(-{R}, {R + 1}) w(dx)
      JOIN {src} s ON s.clip = p.clip AND s.f = p.f AND s.y = {fold('p.y + dy', H)} AND s.x = {fold('p.x + dx', W)} GROUP BY p.clip, p.f, p.y, p.x)"""


GF = f"""
g0 AS (SELECT clip, f, y, x, r / 255.0 AS r, g / 255.0 AS g, b / 255.0 AS b, d FROM pano),
g1 AS (SELECT *, r*r AS rr, r*g AS rg, r*b AS rb, g*g AS gg, g*b AS gb, b*b AS bb, r*d AS rp, g*d AS gp, b*d AS bp FROM g0),
{_box_sql('g1', ['r', 'g', 'b', 'd', 'rr', 'rg', 'rb', 'gg', 'gb', 'bb', 'rp', 'gp', 'bp'], 'g2')},
g3 AS (SELECT clip, f, y, x, r, g, b, d, rr - r*r + 0.001 AS rr, rg - r*g AS rg, rb - r*b AS rb, gg - g*g + 0.001 AS gg, gb - g*b AS gb, bb - b*b + 0.001 AS bb,
  rp - r*d AS rp, gp - g*d AS gp, bp - b*d AS bp FROM g2),
g4 AS (SELECT *, rr*(gg*bb - gb*gb) - rg*(rg*bb - rb*gb) + rb*(rg*gb - rb*gg) AS det FROM g3),
g5 AS (SELECT *, (rp*(gg*bb - gb*gb) - rg*(gp*bb - gb*bp) + rb*(gp*gb - gg*bp)) / det AS ar,
  (rr*(gp*bb - gb*bp) - rp*(rg*bb - gb*rb) + rb*(rg*bp - gp*rb)) / det AS ag,
  (rr*(gg*bp - gp*gb) - rg*(rg*bp - gp*rb) + rp*(rg*gb - gg*rb)) / det AS ab FROM g4),
g6 AS (SELECT clip, f, y, x, ar, ag, ab, d - (ar*r + ag*g + ab*b) AS c0 FROM g5),
{_box_sql('g6', ['ar', 'ag', 'ab', 'c0'], 'g7')},
g8 AS (SELECT g7.clip, g7.f, g7.y, g7.x, ar*r + ag*g + ab*b + c0 AS d FROM g7 JOIN g0 USING (clip, f, y, x))"""


@query("guided_filter", f"""WITH {PANO}, {GF}, lim AS (SELECT clip, f, min(d) AS lo, max(d) AS hi FROM pano GROUP BY clip, f)
SELECT g8.clip, g8.f, y, x, round(greatest(lo, least(hi, d)), 5) + 0.0 AS d FROM g8 JOIN lim USING (clip, f)""")
def guided_filter(spark, sf):
    """Depth smoothed along colour edges, radius 2, clipped to its old range."""
    px = grid.by_frame(pano(spark, sf).withColumns({c: F.col(c) / 255.0 for c in "rgb"}))
    return rounded(depth.smooth_depth(px, W, H, R), "d", places=5)


# --- alignment -----------------------------------------------------------

def BAND_OF(src, stride=1):
    return f"""
{q.face_px(WIDE, REACH, 'bp')},
bo AS (SELECT face AS i, y, x, {OWN['face']} AS sface, {COORD(OWN['a'], WIDE, REACH)} AS u, {COORD(OWN['b'], WIDE, REACH)} AS v FROM bp),
bc AS (SELECT * FROM bo WHERE sface <> i AND y % {stride} = 0 AND x % {stride} = 0 QUALIFY count(*) OVER (PARTITION BY i, sface) >= 16),
{q.bilinear(src, 'bc', [], ['d'], ['i', 'y', 'x', 'sface'], WIDE, WIDE, False, 'bj', face=True)},
bd AS (SELECT j.clip, j.f, j.i, j.sface AS j, s.d AS di, j.d AS dj FROM bj j JOIN {src} s ON s.clip = j.clip AND s.f = j.f AND s.face = j.i AND s.y = j.y AND s.x = j.x),
band AS (SELECT * FROM bd WHERE di > 1e-6 AND dj > 1e-6 QUALIFY count(*) OVER (PARTITION BY clip, f, i, j) >= 16)"""


BAND = BAND_OF("dep")


def band(spark, sf):
    d = face_depth(spark, sf)
    return align.band_pairs(d, WIDE), d


@query("band_pair_medians", f"""{DEPTH}, {BAND}
SELECT clip, f, i, j, round(ln(median(dj)) - ln(median(di)), 5) + 0.0 AS log_ratio, count(*) AS n FROM band GROUP BY clip, f, i, j""")
def band_pair_medians(spark, sf):
    return rounded(align.log_ratios(band(spark, sf)[0]), "log_ratio", places=5)


@query("band_pairs_strided", f"""{DEPTH}, {BAND_OF('dep', 2)}
SELECT clip, f, i, j, round(ln(median(dj)) - ln(median(di)), 5) + 0.0 AS log_ratio, count(*) AS n FROM band GROUP BY clip, f, i, j""")
def band_pairs_strided(spark, sf):
    """Faces larger than twice the samples wanted: every second row and column."""
    d = face_depth(spark, sf)
    return rounded(align.log_ratios(align.band_pairs(d, WIDE, samples=WIDE // 2)), "log_ratio", places=5)


@query("face_disagreement", f"""{DEPTH}, {BAND}, r AS (SELECT clip, f, max(d) - min(d) AS span FROM dep GROUP BY clip, f)
SELECT clip, f, round(sqrt(avg((di - dj) ** 2)) / max(span), 5) + 0.0 AS disagreement FROM band JOIN r USING (clip, f) GROUP BY clip, f""")
def face_disagreement(spark, sf):
    return rounded(quality.face_disagreement(*band(spark, sf)), "disagreement", places=5)


@query("seam_residual", f"""{DEPTH}, {BAND}, par(face, s, t) AS (VALUES {', '.join(f"('{n}', {1.0 + 0.1 * k}::DOUBLE, {0.02 * k}::DOUBLE)" for k, n in enumerate(sphere.FACES))})
SELECT clip, f, round(sqrt(avg((a.s * di + a.t - b.s * dj - b.t) ** 2)), 5) + 0.0 AS residual FROM band JOIN par a ON a.face = i JOIN par b ON b.face = j GROUP BY clip, f""")
def seam_residual(spark, sf):
    """Disagreement under given parameters (scale and shift grow with the face)."""
    pairs, d = band(spark, sf)
    k = F.array_position(F.array(*[F.lit(n) for n in sphere.FACES]), F.col("face")) - 1
    params = d.select(*FACE).distinct().withColumns({"s": 1.0 + 0.1 * k, "t": 0.02 * k})
    return rounded(align.seam_residual(pairs, params), "residual", places=5)


def EDGES_OF(src):
    return f"""ed(e, on_a, sg) AS (VALUES (0, true, 1.0::DOUBLE), (1, true, -1.0), (2, false, 1.0), (3, false, -1.0)),
er AS (SELECT axes.*, e, k, sg, on_a, (k + 0.5) / 64 * 2.0 - 1.0 AS t FROM axes, ed, range(64) q(k)),
ea AS (SELECT *, CASE WHEN on_a THEN sg ELSE t END AS ia, CASE WHEN on_a THEN t ELSE sg END AS ib,
  CASE WHEN on_a THEN sg * 1.02 ELSE t END AS oa, CASE WHEN on_a THEN t ELSE sg * 1.02 END AS ob FROM er),
ev AS (SELECT face AS i, e, k, ia, ib, ox + oa*rx + ob*ex AS px, oy + oa*ry + ob*ey AS py, oz + oa*rz + ob*ez AS pz FROM ea),
en AS (SELECT i, e, k, ia, ib, px / sqrt(px*px+py*py+pz*pz) AS dx, py / sqrt(px*px+py*py+pz*pz) AS dy, pz / sqrt(px*px+py*py+pz*pz) AS dz FROM ev),
eo AS (SELECT *, {OWN['face']} AS j, {OWN['a']} AS ja, {OWN['b']} AS jb FROM en),
em AS (SELECT i, e, mode(j) AS main FROM eo WHERE j <> i GROUP BY i, e HAVING count(*) >= 3),
ec AS (SELECT eo.* FROM eo JOIN em USING (i, e) WHERE j = main),
e1 AS (SELECT i, j, e, k, i AS sface, {COORD('ia', SIZE)} AS u, {COORD('ib', SIZE)} AS v FROM ec),
e2 AS (SELECT i, j, e, k, j AS sface, {COORD('ja', SIZE)} AS u, {COORD('jb', SIZE)} AS v FROM ec),
{q.bilinear(src, 'e1', [], ['d'], ['i', 'j', 'e', 'k'], SIZE, SIZE, False, 'h1', face=True)},
{q.bilinear(src, 'e2', [], ['d'], ['i', 'j', 'e', 'k'], SIZE, SIZE, False, 'h2', face=True)},
pr AS (SELECT h1.clip, h1.f, h1.i, h1.j, h1.d AS di, h2.d AS dj FROM h1 JOIN h2 USING (clip, f, i, j, e, k) WHERE h1.d > 1e-6 AND h2.d > 1e-6)"""


@query("edge_pair_medians", f"""WITH {PANO}, {q.AXES}, {to_faces(SIZE, 1.0, ['r', 'g', 'b', 'd'], 'cube')},
{EDGES_OF('cube')}
SELECT clip, f, i, j, round(ln(median(dj)) - ln(median(di)), 5) + 0.0 AS log_ratio, count(*) AS n FROM pr GROUP BY clip, f, i, j HAVING count(*) >= 3""")
def edge_pair_medians(spark, sf):
    return rounded(align.log_ratios(align.edge_pairs(cube(spark, sf), SIZE)), "log_ratio", places=5)


OTHER = "(CASE WHEN {0}.face[1] = '+' THEN '-' ELSE '+' END || {0}.face[2])"
_CLIP = lambda v, a, b: f"greatest({a}, least({b}, {v}))"


def _solve_sql(edges: str, name: str) -> str:
    """Least squares on differences over all 24 directed pairs of neighbours, sum zero.

    With P swapping opposite faces the normal matrix is 10 + 2 P there, of which (10 - 2 P) / 96 is the inverse.
    """
    return f"""
{name}_v AS MATERIALIZED (SELECT clip, f, face, sum(r) AS v FROM (SELECT clip, f, i AS face, r FROM {edges} UNION ALL SELECT clip, f, j, -r FROM {edges}) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT a.clip, a.f, a.face, (10.0 * a.v - 2.0 * b.v) / 96.0 AS x FROM {name}_v a JOIN {name}_v b ON b.clip = a.clip AND b.f = a.f AND b.face = {OTHER.format('a')})"""


def fit_sql(pairs: str, dep: str, size: int, stride: int = align.MEDIAN_STRIDE) -> str:
    """CTE ``par(clip, f, face, s, t)``: four rounds of shifts and scales, and the better of that and scales alone."""
    some = f" WHERE (y * {size} + x) % {stride} = 0" if stride > 1 else ""
    ends = lambda s, t="": f"JOIN {s} si ON si.clip = p.clip AND si.f = p.f AND si.face = p.i JOIN {s} sj ON sj.clip = p.clip AND sj.f = p.f AND sj.face = p.j" + (
        f" JOIN {t} ti ON ti.clip = p.clip AND ti.f = p.f AND ti.face = p.i JOIN {t} tj ON tj.clip = p.clip AND tj.f = p.f AND tj.face = p.j" if t else "")

    def shifts(s, name):
        return f"""
{name}_e AS MATERIALIZED (SELECT p.clip, p.f, p.i, p.j, sj.s * mj - si.s * mi AS r FROM fit_m p {ends(s)}), {_solve_sql(name + '_e', name + '_x')},
{name} AS MATERIALIZED (SELECT clip, f, face, {_CLIP('x', '-0.5 * med', '0.5 * med')} AS t FROM {name}_x JOIN fit_med USING (clip, f))"""

    def gains(s, x, name):
        return f"{name} AS MATERIALIZED (SELECT clip, f, face, {_CLIP(f's * exp(x - avg(x) OVER (PARTITION BY clip, f))', 0.25, 4.0)} AS s FROM {x} JOIN {s} USING (clip, f, face))"

    parts = [f"""
fit_p AS MATERIALIZED (SELECT * FROM {pairs}),
fit_m AS MATERIALIZED (SELECT clip, f, i, j, median(di) AS mi, median(dj) AS mj FROM fit_p GROUP BY ALL),
fit_med AS MATERIALIZED (SELECT clip, f, median(d) AS med FROM {dep}{some} GROUP BY ALL),
fit_one AS MATERIALIZED (SELECT DISTINCT clip, f, i AS face, 1.0::DOUBLE AS s FROM fit_p),
fit_r AS MATERIALIZED (SELECT clip, f, i, j, ln(mj) - ln(mi) AS r FROM fit_m), {_solve_sql('fit_r', 'fit_x')}, {gains('fit_one', 'fit_x', 'fit_s0')}"""]
    for k in range(align.ROUNDS):
        parts.append(f"""{shifts(f'fit_s{k}', f'fit_t{k}')},
fit_v{k} AS MATERIALIZED (SELECT p.clip, p.f, p.i, p.j, ln(median(sj.s * dj + tj.t)) - ln(median(si.s * di + ti.t)) AS r FROM fit_p p {ends(f'fit_s{k}', f'fit_t{k}')}
  WHERE si.s * di + ti.t > 1e-6 AND sj.s * dj + tj.t > 1e-6 GROUP BY ALL HAVING count(*) >= 3), {_solve_sql(f'fit_v{k}', f'fit_g{k}')}, {gains(f'fit_s{k}', f'fit_g{k}', f'fit_s{k + 1}')}""")
    last = f"fit_s{align.ROUNDS}"
    gap = lambda s, t: f"SELECT p.clip, p.f, sum((si.s * di + ti.t - sj.s * dj - tj.t) ** 2) AS gap FROM fit_p p {ends(s, t)} GROUP BY ALL"
    parts.append(f"""{shifts(last, 'fit_t')},
fit_none AS MATERIALIZED (SELECT clip, f, face, 0.0::DOUBLE AS t FROM fit_one),
fit_a AS MATERIALIZED ({gap(last, 'fit_t')}), fit_b AS MATERIALIZED ({gap('fit_s0', 'fit_none')}),
par AS MATERIALIZED (SELECT clip, f, face, CASE WHEN med > 0 AND a.gap <= b.gap THEN l.s ELSE z.s END AS s, CASE WHEN med > 0 AND a.gap <= b.gap THEN t ELSE 0.0 END AS t
  FROM {last} l JOIN fit_s0 z USING (clip, f, face) JOIN fit_t USING (clip, f, face) JOIN fit_a a USING (clip, f) JOIN fit_b b USING (clip, f) JOIN fit_med USING (clip, f))""")
    return ",".join(parts)


def moved_sql(dep: str, name: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT d.clip, d.f, d.face, d.y, d.x, greatest(0.0, s * d.d + t) AS d FROM {dep} d JOIN par USING (clip, f, face))"


@query("face_affine", f"{DEPTH}, {BAND}, {fit_sql('band', 'dep', WIDE, stride=1)} SELECT clip, f, face, round(s, 5) + 0.0 AS s, round(t, 5) + 0.0 AS t FROM par")
def face_affine(spark, sf):
    """Fitted scale and shift per face."""
    pairs, d = band(spark, sf)
    return rounded(align.fit(pairs, d, WIDE), "s", "t", places=5)


def _faded(dep: str) -> str:
    return f"""{moved_sql(dep, 'moved')}, {BLEND},
{q.bilinear('moved', 'blend_map', [], ['d'], ['y', 'x', 'sface', 'wt'], WIDE, WIDE, False, 'tap', face=True)}
SELECT clip, f, y, x, round(sum(d * wt), 4) + 0.0 AS d FROM tap GROUP BY clip, f, y, x"""


@query("frame_depth", f"{DEPTH}, {BAND}, {fit_sql('band', 'dep', WIDE)}, {_faded('dep')}")
def frame_depth(spark, sf):
    """Faces, model, alignment and cross-fade of every frame."""
    return rounded(depth.frame_depth(pano(spark, sf), W, H, WIDE, lambda px: depth.luma_model(px, FACE)), "d", places=4)


@query("frame_depth_tiled", f"""{TILED}, tiled AS MATERIALIZED (SELECT clip, f, face, y, x, sum(td * s * wt) / greatest(sum(wt), 1e-6) AS d FROM tr JOIN tf USING (clip, f, face, ty, tx) GROUP BY ALL),
{BAND_OF('tiled')}, {fit_sql('band', 'tiled', WIDE)}, {_faded('tiled')}""")
def frame_depth_tiled(spark, sf):
    return rounded(depth.frame_depth(
        pano(spark, sf), W, H, WIDE, lambda px: depth.tiled_depth(px, FACE, WIDE, 2, depth.luma_model)), "d", places=4)


@query("frame_depth_exact", f"""{CUBE},
luma AS (SELECT clip, f, face, y, x, (r + g + b) / 3.0 / 255.0 AS v FROM cube), span AS (SELECT clip, f, face, min(v) AS lo, max(v) AS hi FROM luma GROUP BY ALL),
dcube AS MATERIALIZED (SELECT clip, f, face, y, x, pow((v - lo) / greatest(hi - lo, 1e-6), 1.4) + 0.05 AS d FROM luma JOIN span USING (clip, f, face)),
{EDGES_OF('dcube')}, exact_pairs AS MATERIALIZED (SELECT * FROM pr QUALIFY count(*) OVER (PARTITION BY clip, f, i, j) >= 3),
{fit_sql('exact_pairs', 'dcube', SIZE)}, {moved_sql('dcube', 'moved')}, {PADDED_OF('moved')}, {OUT_OWN},
{q.bilinear('padded', 'out_uv', [], ['d'], ['y', 'x'], SIZE, SIZE, False, 'dpano', face=True, zero=True)}
SELECT clip, f, y, x, round(d, 4) + 0.0 AS d FROM dpano""")
def frame_depth_exact(spark, sf):
    """The same with exact faces, edge alignment and padded assembly."""
    return rounded(depth.frame_depth(pano(spark, sf), W, H, SIZE, lambda px: depth.luma_model(px, FACE), overlap=0.0), "d", places=4)


@query("seam_step", f"""WITH {PANO}, {q.ray('pano', W, H)}, o AS (SELECT clip, f, y, x, d, {OWN['face']} AS face FROM rayed),
s AS (SELECT *, lag(d) OVER c AS pd, lag(face) OVER c AS pf FROM o WINDOW c AS (PARTITION BY clip, f, x ORDER BY y))
SELECT clip, f, round(median(abs(d - pd)) FILTER ((pf = '+Z' AND face = '-Y') OR (pf = '-Y' AND face = '+Z'))
  / (quantile_cont(d, 0.99) FILTER (y >= {H // 2}) - quantile_cont(d, 0.01) FILTER (y >= {H // 2})), 5) + 0.0 AS seam_step FROM s GROUP BY clip, f""")
def seam_step(spark, sf):
    return rounded(quality.seam_step(pano(spark, sf).select(*FRAME, "y", "x", "d"), W, H), "seam_step", places=5)
