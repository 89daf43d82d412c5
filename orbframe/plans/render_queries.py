"""Rendering paths end to end."""

from pyspark.sql import functions as F

from orbframe import FRAME
from orbframe.operators import ranges, temporal
from orbframe.plans import render
from orbframe.plans import sqltext as q
from orbframe.plans.lenses import PANO, STRONG, W, H, pano
from orbframe.plans.registry import query, rounded
from orbframe.plans.time_queries import EMA, blended_sql, chunks_sql
from orbframe.plans.warp_queries import NORM, normalised

OUT = "SELECT clip, f, y, x, round(r, 3) + 0.0 AS r, round(g, 3) + 0.0 AS g, round(b, 3) + 0.0 AS b, hole, done FROM res"
TAU = 0.3


def shown(df):
    return rounded(df.select(*FRAME, "y", "x", "r", "g", "b", "hole", "done"), "r", "g", "b", places=3)


@query("frame_path", q.once(f"""WITH RECURSIVE {PANO}, {EMA},
scaled AS (SELECT p.clip, p.f, p.y, p.x, r, g, b, greatest(0.0, least(1.0, (d - lo) / (CASE WHEN hi <= lo THEN 1e-6 ELSE hi - lo END))) AS d FROM pano p JOIN ema USING (clip, f)),
st AS (
  SELECT clip, f, y, x, r, g, b, d FROM scaled WHERE f = 0
  UNION ALL
  SELECT p.clip, p.f, p.y, p.x, p.r, p.g, p.b, p.d + 0.9 * greatest(0.0, least(1.0, (2.0 * {TAU} - abs(p.d - s.d)) / {TAU})) * (s.d - p.d)
  FROM st s JOIN scaled p ON p.clip = s.clip AND p.y = s.y AND p.x = s.x AND p.f = s.f + 1),
{q.eye('st', STRONG, W, H)}, {q.morph('eye', 'hole', 'hole_d', 2, 'max', 'grown')}, {q.directional('grown', W, 1.0)}, {q.residual('filled', 'st', W, H)} {OUT}"""))
def frame_path(spark, sf):
    return shown(render.frame_path(pano(spark, sf), W, H, STRONG, 4, TAU))


SIZE, LAP, LOCK, SPREAD = 5, 2, 0.2, 70.0


@query("chunk_path", q.once(f"""WITH RECURSIVE {PANO}, {chunks_sql(SIZE, LAP)}, {blended_sql(LAP)}, {q.normalised('blended', 4, 'cn', 'clip, chunk')},
trk AS (SELECT clip, chunk, y, x, count(*) AS n, stddev_pop(d) AS sd, median(d) AS med FROM cn GROUP BY ALL),
ready AS (SELECT c.clip, c.f, c.chunk, c.y, c.x, p.r, p.g, p.b,
  CASE WHEN n < 3 THEN c.d ELSE c.d + greatest(0.0, least(1.0, (2.0 * {LOCK} - sd) / {LOCK})) * (med - c.d) END AS d
  FROM cn c JOIN trk USING (clip, chunk, y, x) JOIN pano p ON p.clip = c.clip AND p.f = c.f AND p.y = c.y AND p.x = c.x),
{q.eye('ready', STRONG, W, H)},
ch AS (SELECT DISTINCT clip, f, chunk FROM ready),
ev AS (SELECT eye.*, chunk FROM eye JOIN ch USING (clip, f)),
tf AS (SELECT clip, chunk, y, x, count(*) FILTER (NOT hole) AS n, median(r) FILTER (NOT hole) AS mr, median(g) FILTER (NOT hole) AS mg, median(b) FILTER (NOT hole) AS mb,
  (stddev_pop(r) FILTER (NOT hole) + stddev_pop(g) FILTER (NOT hole) + stddev_pop(b) FILTER (NOT hole)) / 3.0 AS sd FROM ev GROUP BY ALL),
tj AS (SELECT ev.*, mr, mg, mb, hole AND (n = 1 OR (n >= 2 AND sd <= {SPREAD})) AS take FROM ev JOIN tf USING (clip, chunk, y, x)),
td AS (SELECT clip, f, y, x, hole AND NOT take AS hole, CASE WHEN take THEN floor(mr) ELSE r END AS r, CASE WHEN take THEN floor(mg) ELSE g END AS g,
  CASE WHEN take THEN floor(mb) ELSE b END AS b FROM tj),
{q.morph('td', 'hole', 'hole_d', 2, 'max', 'grown')}, {q.directional('grown', W, 1.0)}, {q.residual('filled', 'ready', W, H)} {OUT}"""))
def chunk_path(spark, sf):
    px = pano(spark, sf)
    est = temporal.chunk_windows(px, temporal.clip_lengths(px), SIZE, LAP).withColumn("d", F.col("d") * (1.0 + 0.01 * F.col("chunk")))
    return shown(render.chunk_path(est, W, H, STRONG, LAP, 4, LOCK, SPREAD))


HOLE = "(y % 16 BETWEEN 10 AND 11) OR (r + x) % 23 = 0"


@query("residual_fill", q.once(f"""{NORM.replace('WITH', 'WITH RECURSIVE', 1)},
eye AS (SELECT clip, f, y, x, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b, {HOLE} AS hole FROM norm),
{q.morph('eye', 'hole', 'hole_d', 2, 'max', 'grown')}, {q.directional('grown', W, 1.0)}, {q.residual('filled', 'norm', W, H)}
SELECT clip, f, y, x, round(r, 3) + 0.0 AS r, round(g, 3) + 0.0 AS g, round(b, 3) + 0.0 AS b, hole, done FROM res"""))
def residual_fill(spark, sf):
    """Every eighth pair of rows is a hole all along, which no row can fill."""
    px = normalised(spark, sf)
    eye = px.withColumns({"hole": F.expr(HOLE), **{c: F.col(c).cast("double") for c in "rgb"}}).drop("d")
    return shown(render.fill_holes(eye, px, W, H, STRONG))


@query("preview", q.once(f"""WITH RECURSIVE {PANO}, one AS (SELECT * FROM pano WHERE f = 3), {q.normalised('one')}, {q.eye('norm', STRONG, W, H)},
{q.morph('eye', 'hole', 'hole_d', 2, 'max', 'grown')}, {q.directional('grown', W, 1.0)}, {q.residual('filled', 'norm', W, H)} {OUT}"""))
def preview(spark, sf):
    """The fourth frame of every clip, by its own range."""
    return shown(render.preview(pano(spark, sf), 3, W, H, STRONG))
