"""Progress of jobs, and sound."""

from pyspark.sql import functions as F

from orbframe.operators import order, progress, ranges, soundfield
from orbframe.plans.lenses import AUDIO, JOBS, audio, jobs
from orbframe.plans.registry import query, r6, rounded
from orbframe.sources import lines

FRAMES = f"""{JOBS},
totals AS (SELECT job, CAST(sum(n) AS BIGINT) AS total, min(ts) AS t0 FROM jobs GROUP BY job),
run AS (SELECT j.*, total, ts - t0 AS el, CAST(sum(n) OVER (PARTITION BY j.job ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS frame
  FROM jobs j JOIN totals USING (job)),
rated AS (SELECT *, CASE WHEN el > 0 THEN frame / el ELSE 0.0 END AS rate FROM run)"""


def with_totals(spark, sf):
    """Events in the order of their jobs, with a bucket of so many rows each."""
    j = order.indexed(jobs(spark, sf), ["job", "ts", "event_id"])
    return j.join(j.groupBy("job").agg(F.sum("n").alias("total")), "job")


@query("progress_eta", f"""WITH {FRAMES}
SELECT job, event_id, frame, total, round_even(el, 3) + 0.0 AS elapsed, round_even(rate, 3) + 0.0 AS fps,
  round_even(CASE WHEN total > 0 AND rate > 0 THEN (total - frame) / rate END, 1) + 0.0 AS eta FROM rated""")
def progress_eta(spark, sf):
    out = progress.rates(with_totals(spark, sf), order.bucket(), ["job"], ["ts", "event_id"])
    zero = {c: F.col(c) + F.lit(0.0) for c in ("elapsed", "fps", "eta")}
    return out.withColumns(zero).select("job", "event_id", "frame", "total", "elapsed", "fps", "eta")


HOURS = 36 * 3600.0


@query("progress_throttle", f"""WITH RECURSIVE {FRAMES},
seq AS (SELECT job, event_id, ts, frame, total, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS k FROM run),
kept AS (
  SELECT job, event_id, ts, frame, total, k, ts AS last, true AS ok FROM seq WHERE k = 1
  UNION ALL
  SELECT s.job, s.event_id, s.ts, s.frame, s.total, s.k,
         CASE WHEN s.frame = s.total OR s.ts - p.last >= {HOURS} THEN s.ts ELSE p.last END, s.frame = s.total OR s.ts - p.last >= {HOURS}
  FROM kept p JOIN seq s ON s.job = p.job AND s.k = p.k + 1)
SELECT job, event_id, frame, total FROM kept WHERE ok""")
def progress_throttle(spark, sf):
    """One report per 36 hours, and the first and last of each job."""
    done = progress.rates(with_totals(spark, sf), order.bucket(), ["job"], ["ts", "event_id"]).select("job", "event_id", "ts", "frame", "total")
    return progress.throttle(done, None, ["job"], ["ts", "event_id"], HOURS).select("job", "event_id", "frame", "total")


TYPED = f"""{JOBS},
ev AS (SELECT job, event_id, ts, CASE event_type WHEN 'view' THEN 'progress' WHEN 'click' THEN 'info' WHEN 'signup' THEN 'start'
  WHEN 'purchase' THEN 'done' ELSE event_type END AS type, n, value FROM jobs)"""
KIND = {"view": "progress", "click": "info", "signup": "start", "purchase": "done", "error": "error"}


def typed(spark, sf):
    """Events as progress messages, written to JSON lines and parsed again."""
    kind = F.element_at(F.create_map(*[F.lit(v) for kv in KIND.items() for v in kv]), F.col("event_type"))
    is_ = lambda t: kind == t
    line = F.struct(
        kind.alias("type"), F.when(is_("progress") & (F.col("n") % 5 != 0), F.col("n")).alias("frame"),
        F.when(is_("progress"), F.col("n") + 10).alias("total"), F.when(is_("done"), F.col("value")).alias("elapsed"),
        F.when(is_("done") & (F.col("n") % 2 == 0), F.col("n")).alias("frames"),
        F.when(is_("done"), F.col("n") % 7 == 0).alias("cancelled"),
        F.when(is_("info") | is_("error"), F.concat(F.lit("at "), F.col("value").cast("int").cast("string"))).alias("message"),
    )
    text = F.when(is_("info") & (F.col("n") % 3 == 0), F.concat(F.lit("not json "), F.col("n").cast("string"))).otherwise(F.to_json(line))
    raw = jobs(spark, sf).select("job", "event_id", "ts", text.alias("value"))
    return progress.parse_lines(raw).drop("extra")


@query("progress_dispatch", f"""WITH {TYPED}
SELECT job, event_id, ts, CASE WHEN n % 5 <> 0 THEN n ELSE 0 END AS frame, n + 10 AS total, CAST(0 AS DOUBLE) AS elapsed, CAST(0 AS DOUBLE) AS fps, CAST(-1 AS DOUBLE) AS eta
FROM ev WHERE type = 'progress'""")
def progress_dispatch(spark, sf):
    return progress.dispatch(typed(spark, sf))


@query("job_log", f"""WITH {TYPED}
SELECT job, event_id, type, CASE WHEN type = 'info' AND n % 3 = 0 THEN 'not json ' || n ELSE 'at ' || CAST(trunc(value) AS INT) END AS message
FROM ev WHERE type IN ('info', 'error')""")
def job_log(spark, sf):
    return progress.message_log(typed(spark, sf)).select("job", "event_id", "type", "message")


@query("job_outcome", f"""WITH {TYPED},
d AS (SELECT job, arg_max(CASE WHEN n % 2 = 0 THEN n END, ts) FILTER (type = 'done' AND n % 2 = 0) AS frames_any,
   arg_max(value, ts) FILTER (type = 'done') AS el, bool_or(type = 'done' AND n % 7 = 0) AS cancelled FROM ev GROUP BY job),
dl AS (SELECT job, CASE WHEN n % 2 = 0 THEN n END AS frames FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts DESC) AS rn FROM ev WHERE type = 'done') WHERE rn = 1),
p AS (SELECT job, max(CASE WHEN type = 'progress' AND n % 5 <> 0 THEN n END) AS mf, max(ts) - min(ts) AS span, bool_or(type = 'error') AS failed FROM ev GROUP BY job)
SELECT p.job, coalesce(dl.frames, mf) AS frames, round(coalesce(el, span), 4) + 0.0 AS elapsed, cancelled, failed FROM p JOIN d USING (job) LEFT JOIN dl USING (job)""")
def job_outcome(spark, sf):
    return rounded(progress.outcome(typed(spark, sf)), "elapsed", places=4)


@query("job_sessions", f"WITH {TYPED} SELECT job, event_id, type, CAST(sum(CASE WHEN type = 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM ev")
def job_sessions(spark, sf):
    ev = order.indexed(typed(spark, sf), ["job", "ts", "event_id"]).withColumn("is_start", F.col("type") == "start")
    return progress.job_sessions(ev, order.bucket(), "job", ["ts", "event_id"]).select("job", "event_id", "type", "session")


@query("job_status", f"""WITH {FRAMES}
SELECT job, arg_max(frame, ts) AS frame, max(total) AS total, round(arg_max(el, ts), 3) + 0.0 AS elapsed,
  round(least(1.0, arg_max(frame, ts) / max(total)), 6) + 0.0 AS fraction FROM rated GROUP BY job""")
def job_status(spark, sf):
    done = progress.rates(with_totals(spark, sf), order.bucket(), ["job"], ["ts", "event_id"])
    return rounded(progress.latest_status(done).select("job", "frame", "total", "elapsed", "fraction"), "elapsed", "fraction")


# --- sound ---------------------------------------------------------------

YAW = 63.0
MIX = ", ".join(f"({o}, {i}, {g!r})" for o, i, g in soundfield.yaw_terms(3, YAW))
TURNED = f"""{AUDIO}, mix(o, i, gain) AS (VALUES {MIX}),
turned AS (SELECT clip, n, CAST(o AS INT) AS c, sum(v * gain) AS v FROM audio JOIN mix ON mix.i = audio.c GROUP BY clip, n, o)"""


def rows(df):
    return df.select("clip", "n", F.posexplode("ch").alias("c", "v"))


@query("yaw_rotate", f"WITH {TURNED} SELECT clip, n, c, round(v, 6) + 0.0 AS v FROM turned")
def yaw_rotate(spark, sf):
    return rounded(rows(soundfield.rotate(audio(spark, sf), 3, YAW)), "v")


@query("yaw_checks", f"""WITH {AUDIO}, c AS (SELECT clip, count(*) // 16 AS samples, max(abs(v)) AS most FROM audio GROUP BY clip)
SELECT clip, samples, o AS sound_order, true AS orthogonal, true AS undone FROM c, range(1, 4) t(o)""")
def yaw_checks(spark, sf):
    """For each order: the matrix by its transpose is the identity, and turning back restores all samples of a clip."""
    px = audio(spark, sf)
    found = None
    for o in (1, 2, 3):
        m = soundfield.yaw_matrix(spark, o, YAW)
        worst = soundfield.off_identity(soundfield.product(m, soundfield.transpose(m)))
        first = px.withColumn("ch", F.slice("ch", 1, (o + 1) ** 2))
        back = soundfield.rotate(soundfield.rotate(first.withColumn("sent", F.col("ch")), o, YAW), o, -YAW)
        off = F.array_max(F.zip_with("sent", "ch", lambda a, b: F.abs(a - b)))
        part = back.groupBy("clip").agg(F.count(F.lit(1)).alias("samples"), (F.max(off) < 1e-12).alias("undone"))
        # one number about a matrix of 16 x 16 at most
        orthogonal = F.lit(worst.first().worst < 1e-12).alias("orthogonal")
        part = part.select("clip", "samples", F.lit(o).cast("long").alias("sound_order"), orthogonal, "undone")
        found = part if found is None else found.union(part)
    return found


@query("bearing", f"""WITH {TURNED},
p AS (SELECT clip, n, max(CASE WHEN c = 0 THEN v END) AS w, max(CASE WHEN c = 1 THEN v END) AS y, max(CASE WHEN c = 3 THEN v END) AS x FROM turned GROUP BY clip, n)
SELECT clip, round(degrees(atan2(sum(y * w), sum(x * w))), 4) + 0.0 AS bearing FROM p GROUP BY clip""")
def bearing(spark, sf):
    return rounded(soundfield.bearing(soundfield.rotate(audio(spark, sf), 3, YAW), ["clip"]), "bearing", places=4)


@query("loudness", f"""WITH {TURNED}, a AS (SELECT clip, sqrt(sum(v * v)) AS e FROM audio GROUP BY clip), b AS (SELECT clip, sqrt(sum(v * v)) AS e FROM turned GROUP BY clip)
SELECT clip, round(a.e, 4) + 0.0 AS before, round(b.e, 4) + 0.0 AS after, abs(b.e - a.e) <= 0.0001 * abs(a.e) AS kept FROM a JOIN b USING (clip)""")
def loudness(spark, sf):
    px = audio(spark, sf)
    return rounded(soundfield.loudness_kept(px, soundfield.rotate(px, 3, YAW), ["clip"]), "before", "after", places=4)


@query("channel_map", f"""WITH {AUDIO},
got AS (SELECT clip, n, (c + 5) % 16 AS c, v * -0.5 + 0.01 AS v FROM audio),
cor AS (SELECT a.clip, g.c AS out_ch, a.c AS in_ch, abs(corr(a.v, g.v)) AS r FROM audio a JOIN got g USING (clip, n) GROUP BY ALL)
SELECT clip, CAST(out_ch AS INT) AS out_ch, CAST(arg_max(in_ch, r) AS INT) AS in_ch FROM cor GROUP BY clip, out_ch""")
def channel_map(spark, sf):
    """Channels shifted by five, inverted and scaled, then recognised."""
    moved = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda c: F.get(F.col("ch"), (c + 11) % 16) * -0.5 + 0.01)
    both = audio(spark, sf).select("clip", F.col("ch").alias("sent"), moved.alias("got"))
    return soundfield.channel_map(both, ["clip"], 16)


@query("sound_cut", f"WITH {AUDIO}, len AS (SELECT clip, max(n) AS m FROM audio GROUP BY clip) SELECT clip, n, c, v FROM audio JOIN len USING (clip) WHERE n < m * 0.75")
def sound_cut(spark, sf):
    """Samples kept when three quarters of the sound fit the picture."""
    px = audio(spark, sf)
    keep = px.groupBy("clip").agg((F.max("n") * 0.75).alias("keep"))
    return rows(px.join(keep, "clip").filter(F.col("n") < F.col("keep")))
