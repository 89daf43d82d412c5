"""Ranges, chunks and temporal operators."""

from pyspark.sql import functions as F

from orbframe import FRAME
from orbframe.operators import grid, order, quality, ranges, selection, temporal
from orbframe.plans import sqltext as q
from orbframe.plans.lenses import PANO, CLIP, H, W, pano, tracks
from orbframe.plans.registry import query, r6, rounded

SIZE, LAP = 4, 2
STEP = SIZE - LAP


@query("frame_range", f"WITH {PANO} SELECT clip, f, round(quantile_cont(d, 0.01), 6) + 0.0 AS lo, round(quantile_cont(d, 0.99), 6) + 0.0 AS hi FROM pano GROUP BY clip, f")
def frame_range(spark, sf):
    return rounded(ranges.frame_range(pano(spark, sf)), "lo", "hi")


@query("strided_range", f"WITH {PANO} SELECT clip, f, round(quantile_cont(d, 0.01), 6) + 0.0 AS lo, round(quantile_cont(d, 0.99), 6) + 0.0 AS hi FROM pano WHERE y % 4 = 0 AND x % 4 = 0 GROUP BY clip, f")
def strided_range(spark, sf):
    """Range from a strided sample, which is what video rendering uses."""
    return rounded(ranges.frame_range(pano(spark, sf), 4), "lo", "hi")


EMA = f"""
per AS (SELECT clip, f, quantile_cont(d, 0.01) AS lo, quantile_cont(d, 0.99) AS hi FROM pano WHERE y % 4 = 0 AND x % 4 = 0 GROUP BY clip, f),
ema AS (
  SELECT clip, f, lo, hi FROM per WHERE f = 0
  UNION ALL
  SELECT p.clip, p.f, e.lo + 0.05 * (p.lo - e.lo), e.hi + 0.05 * (p.hi - e.hi) FROM ema e JOIN per p ON p.clip = e.clip AND p.f = e.f + 1)"""


@query("ema_range", f"WITH RECURSIVE {PANO}, {EMA} SELECT clip, f, round(lo, 6) + 0.0 AS lo, round(hi, 6) + 0.0 AS hi FROM ema")
def ema_range(spark, sf):
    return rounded(ranges.moving_range(ranges.frame_range(pano(spark, sf), 4)), "lo", "hi")


@query("moving_normalise", f"""WITH RECURSIVE {PANO}, {EMA}
SELECT p.clip, p.f, p.y, p.x, round(greatest(0.0, least(1.0, (d - lo) / (CASE WHEN hi <= lo THEN 1e-6 ELSE hi - lo END))), 6) + 0.0 AS d
FROM pano p JOIN ema USING (clip, f)""")
def moving_normalise(spark, sf):
    return rounded(ranges.moving_normalise(pano(spark, sf), 4).select(*FRAME, "y", "x", "d"), "d")


@query("ema_tracks", """WITH RECURSIVE
t AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
ema AS (
  SELECT user_id, event_id, k, value AS v FROM t WHERE k = 0
  UNION ALL
  SELECT t.user_id, t.event_id, t.k, e.v + 0.05 * (t.value - e.v) FROM ema e JOIN t ON t.user_id = e.user_id AND t.k = e.k + 1)
SELECT user_id, event_id, k, round(v + 0.000000013, 6) + 0.0 AS value FROM ema""")
def ema_tracks(spark, sf):
    """Smoothed event values per user; a hot user is ranked bucket by bucket and
    smoothed segment by segment."""
    ev = order.indexed(tracks(spark, sf), ["user_id", "ts", "event_id"])
    k = ranges.ranked(ev, ["user_id"], ["ts", "event_id"], order.bucket())
    # Values have two decimals, so averages fall on rounding ties; a small
    # offset on both sides keeps the comparison off them.
    out = ranges.smoothed(k, ["user_id"], ["value"]).withColumn("value", F.col("value") + 0.000000013)
    return rounded(out, "value").select("user_id", "event_id", "k", "value")


TAU = 0.3


@query("stabiliser", f"""WITH RECURSIVE {PANO},
st AS (
  SELECT clip, f, y, x, d FROM pano WHERE f = 0
  UNION ALL
  SELECT p.clip, p.f, p.y, p.x, p.d + 0.9 * greatest(0.0, least(1.0, (2.0 * {TAU} - abs(p.d - s.d)) / {TAU})) * (s.d - p.d)
  FROM st s JOIN pano p ON p.clip = s.clip AND p.y = s.y AND p.x = s.x AND p.f = s.f + 1)
SELECT clip, f, y, x, round(d, 6) + 0.0 AS d FROM st""")
def stabiliser(spark, sf):
    """A wide band (0.3): neighbouring frames of these panoramas differ a lot."""
    return rounded(temporal.stabilise(pano(spark, sf).select(*FRAME, "y", "x", "d"), TAU), "d")


def chunks_sql(size: int, lap: int) -> str:
    step = size - lap
    return f"""
lengths AS (SELECT clip, count(DISTINCT f) AS n FROM pano GROUP BY clip),
plan AS (SELECT clip, n, CASE WHEN n >= {size} THEN (n - {size}) // {step} + 1 ELSE 0 END AS nfull FROM lengths),
ids AS (SELECT clip, n, nfull, unnest(range(0, nfull + CASE WHEN n > nfull * {step} THEN 1 ELSE 0 END)) AS chunk FROM plan),
spans AS (SELECT clip, nfull, chunk, chunk * {step} AS a, least(n, chunk * {step} + {size}) AS z FROM ids),
windows AS (
  SELECT clip, CAST(unnest(range(a, z)) AS INT) AS f, CAST(chunk AS INT) AS chunk, a, CAST(z - a AS INT) AS len, nfull FROM spans),
member AS (SELECT clip, f, chunk, CAST(f - a AS INT) AS pos, len, chunk >= nfull OR f - a < {step} AS emit FROM windows)"""


CHUNKS = chunks_sql(SIZE, LAP)


def members(spark, sf):
    px = pano(spark, sf)
    return temporal.chunk_windows(px, temporal.clip_lengths(px), SIZE, LAP)


@query("chunk_windows", f"WITH {PANO}, {CHUNKS} SELECT m.*, round(avg(d), 6) + 0.0 AS mean_d FROM member m JOIN pano USING (clip, f) GROUP BY ALL")
def chunk_windows(spark, sf):
    return members(spark, sf).groupBy("clip", "f", "chunk", "pos", "len", "emit").agg(r6(F.avg("d")).alias("mean_d"))


# A chunk's own estimate of a frame differs a little from its neighbour's.
ESTIMATE = f"est AS (SELECT m.*, y, x, d * (1.0 + 0.01 * chunk) AS d FROM member m JOIN pano USING (clip, f))"
def blended_sql(lap: int) -> str:
    return f"""{ESTIMATE},
late AS (SELECT * FROM est WHERE emit),
blended AS (
  SELECT l.clip, l.f, l.chunk, l.y, l.x,
         CASE WHEN e.d IS NULL OR l.pos >= {lap} THEN l.d
              ELSE (1.0 - (l.pos + 1) / {lap + 1}.0) * e.d + (l.pos + 1) / {lap + 1}.0 * l.d END AS d
  FROM late l LEFT JOIN est e ON e.clip = l.clip AND e.f = l.f AND e.y = l.y AND e.x = l.x AND e.chunk = l.chunk - 1)"""


BLENDED = blended_sql(LAP)


def blended(spark, sf):
    est = members(spark, sf).withColumn("d", F.col("d") * (1.0 + 0.01 * F.col("chunk")))
    return temporal.blend_overlap(est.select("clip", "chunk", "pos", "f", "y", "x", "d"), LAP)


@query("chunk_blend", f"WITH {PANO}, {CHUNKS}, {BLENDED} SELECT clip, f, chunk, y, x, round(d, 6) + 0.0 AS d FROM blended")
def chunk_blend(spark, sf):
    return rounded(blended(spark, sf), "d")


@query("chunk_range", f"""WITH {PANO}, {CHUNKS}, {BLENDED}
SELECT clip, chunk, round(quantile_cont(d, 0.01), 6) + 0.0 AS lo, round(quantile_cont(d, 0.99), 6) + 0.0 AS hi
FROM blended WHERE y % 4 = 0 AND x % 4 = 0 GROUP BY clip, chunk""")
def chunk_range(spark, sf):
    return rounded(temporal.chunk_range(blended(spark, sf), 4), "lo", "hi")


@query("chunk_normalise", f"""WITH {PANO}, {CHUNKS}, {BLENDED}, {q.normalised('blended', 4, 'cn', 'clip, chunk')}
SELECT clip, f, chunk, y, x, round(d, 6) + 0.0 AS d FROM cn""")
def chunk_normalise(spark, sf):
    return rounded(temporal.chunk_normalise(blended(spark, sf), 4), "d")


@query("sketched_range", f"""WITH {PANO}, {CHUNKS}, {BLENDED}
SELECT clip, chunk, count(*) AS n, true AS lo_within, true AS hi_within FROM blended GROUP BY clip, chunk""")
def sketched_range(spark, sf):
    """A chunk's range from its frames' sketches, and whether their true ranks are as near as promised."""
    px = blended(spark, sf)
    frames = selection.sketched(px, [*FRAME, "chunk"])
    per_chunk = selection.ranges_of(selection.merged(frames, ["clip", "chunk"]), [ranges.LOW, ranges.HIGH])
    of_frame = frames.select(*FRAME, "chunk").join(per_chunk, ["clip", "chunk"])
    true = selection.ranks(px, of_frame, ["clip", "chunk"])
    within = lambda end, p: (F.abs(F.col(f"rank_{end}") - p) <= selection.ERROR).alias(f"{end}_within")
    return true.select("clip", "chunk", "n", within("lo", ranges.LOW), within("hi", ranges.HIGH))


LOCK = 0.2
WIDE_CHUNK = f"wide AS (SELECT clip, f, f // 5 AS chunk, y, x, d, r, g, b FROM pano)"


@query("median_lock", f"""WITH {PANO}, {WIDE_CHUNK},
st AS (SELECT clip, chunk, y, x, count(*) AS n, stddev_pop(d) AS sd, median(d) AS med FROM wide GROUP BY ALL)
SELECT w.clip, w.f, w.chunk, w.y, w.x, round(CASE WHEN n < 3 THEN d ELSE
  d + greatest(0.0, least(1.0, (2.0 * {LOCK} - sd) / {LOCK})) * (med - d) END, 6) + 0.0 AS d
FROM wide w JOIN st USING (clip, chunk, y, x)""")
def median_lock(spark, sf):
    """Chunks of five frames, lock band 0.2."""
    px = pano(spark, sf).withColumn("chunk", F.floor(F.col("f") / 5).cast("int"))
    return rounded(temporal.median_lock(px, LOCK).select("clip", "f", "chunk", "y", "x", "d"), "d")


HOLED = "holed AS (SELECT *, (f * 7 + y * 3 + x) % 5 = 0 AS hole FROM wide)"


@query("temporal_fill", f"""WITH {PANO}, {WIDE_CHUNK}, {HOLED},
st AS (SELECT clip, chunk, y, x, count(*) FILTER (NOT hole) AS n, median(r) FILTER (NOT hole) AS mr, median(g) FILTER (NOT hole) AS mg,
  median(b) FILTER (NOT hole) AS mb, (stddev_pop(r) FILTER (NOT hole) + stddev_pop(g) FILTER (NOT hole) + stddev_pop(b) FILTER (NOT hole)) / 3.0 AS sd
  FROM holed GROUP BY clip, chunk, y, x),
j AS (SELECT h.*, mr, mg, mb, hole AND (n = 1 OR (n >= 2 AND sd <= 70.0)) AS fill FROM holed h JOIN st USING (clip, chunk, y, x))
SELECT clip, f, chunk, y, x, CAST(CASE WHEN fill THEN floor(mr) ELSE r END AS INT) AS r, CAST(CASE WHEN fill THEN floor(mg) ELSE g END AS INT) AS g,
  CAST(CASE WHEN fill THEN floor(mb) ELSE b END AS INT) AS b, hole AND NOT fill AS hole FROM j""")
def temporal_fill(spark, sf):
    """Every fifth pixel is a hole; spread limit 70 as colours vary strongly."""
    hole = (F.col("f") * 7 + F.col("y") * 3 + F.col("x")) % 5 == 0
    px = pano(spark, sf).withColumns({"chunk": F.floor(F.col("f") / 5).cast("int"), "hole": hole}).drop("d")
    return temporal.temporal_fill(px, 70.0).select("clip", "f", "chunk", "y", "x", "r", "g", "b", "hole")


@query("temporal_std", f"""WITH {PANO},
per AS (SELECT clip, y, x, (stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3 AS sd FROM pano GROUP BY ALL)
SELECT clip, round(avg(sd), 6) + 0.0 AS mean_sd, round(quantile_cont(sd, 0.99), 6) + 0.0 AS p99_sd FROM per GROUP BY clip""")
def temporal_std(spark, sf):
    return rounded(quality.temporal_spread(pano(spark, sf), ["r", "g", "b"], ["clip"]), "mean_sd", "p99_sd")
