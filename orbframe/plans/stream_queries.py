"""Streams over the given tables; the results equal their batch forms.

Rows come shuffled over several files, one micro-batch each, so the operators have to put
them back into order; a last file moves the watermark past all of them.
"""

from pyspark.sql import functions as F

from orbframe.plans.job_queries import FRAMES, HOURS
from orbframe.plans.lenses import CLIP, H, PANO, jobs_of, pano
from orbframe.plans.registry import query, r6, rounded
from orbframe.plans.time_queries import CHUNKS, EMA, LAP, SIZE, TAU
from orbframe.session import tune
from orbframe.streaming import state


def lines(emb):
    """Vectors as scanlines, without the completion of the last frame."""
    n = F.floor(F.col("vec_id") / H)
    return emb.select(
        F.floor(n / CLIP).cast("string").alias("clip"), (F.col("vec_id") % H).cast("int").alias("y"), (n % CLIP).cast("int").alias("f"),
        F.transform("embedding", lambda v: v.cast("double") + 1.0).alias("line"))


BATCHES = 4


def shuffled(df, part, at: list[str], clock: str):
    """``df`` as a stream of ``BATCHES`` files by the number ``part``, and one with a row at no position (``at``), long after."""
    spark = df.sparkSession
    folder, rows = state.scratch_path(spark, "shuffled"), df.withColumn("_part", part)
    for i in range(BATCHES):
        rows.where(F.col("_part") == i).drop("_part").write.mode("append").parquet(f"{folder}/{i}")
    end = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name not in (*at, clock)]
    last = df.agg(F.max(clock).alias("_end")).select(*end, *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in at if c != clock], (F.col("_end") + F.expr("INTERVAL 9 DAYS")).alias(clock))
    last.select(*df.columns).coalesce(1).write.parquet(f"{folder}/{BATCHES}")
    files = spark.read.schema(df.schema).option("recursiveFileLookup", True).parquet(folder).inputFiles()
    each = -(-len(files) // (BATCHES + 1))
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", each).parquet(folder)


def mixed(*columns):
    """A part for each row that has nothing to do with its order."""
    return F.pmod(F.xxhash64(*columns), F.lit(BATCHES))


def at_second(f="f"):
    return F.timestamp_seconds(F.col(f))


@query("stream_stabiliser", f"""WITH RECURSIVE {PANO},
real AS (SELECT p.* FROM pano p JOIN (SELECT DISTINCT CAST(vec_id // {H * CLIP} AS VARCHAR) AS clip, CAST(vec_id // {H} % {CLIP} AS INT) AS f, CAST(vec_id % {H} AS INT) AS y FROM embeddings) USING (clip, f, y)),
st AS (
  SELECT clip, f, y, x, d FROM real WHERE f = 0
  UNION ALL
  SELECT p.clip, p.f, p.y, p.x, p.d + 0.9 * greatest(0.0, least(1.0, (2.0 * {TAU} - abs(p.d - s.d)) / {TAU})) * (s.d - p.d)
  FROM st s JOIN real p ON p.clip = s.clip AND p.y = s.y AND p.x = s.x AND p.f = s.f + 1)
SELECT clip, f, y, x, round(d, 6) + 0.0 AS d FROM st""")
def stream_stabiliser(spark, sf):
    """Each scanline of a clip waits for the frames before it."""
    rows = lines(tune(spark).read.parquet(f"{sf}/embeddings.parquet")).withColumn("ts", at_second())
    src = shuffled(rows, mixed("clip", "y", "f"), ["f"], "ts")
    out = state.run_available(state.stabilise(src, TAU, patience=3600), "clip string, y int, f int, line array<double>")
    return rounded(out.select("clip", "f", "y", F.posexplode("line").alias("x", "d")), "d")


@query("stream_ema", f"""WITH RECURSIVE per0 AS (SELECT vec_id // {H} AS n, embedding FROM embeddings),
per AS (SELECT CAST(n // {CLIP} AS VARCHAR) AS clip, n % {CLIP} AS f, min(list_min(embedding))::DOUBLE AS lo, max(list_max(embedding))::DOUBLE AS hi FROM per0 GROUP BY ALL),
ema AS (SELECT clip, f, lo, hi FROM per WHERE f = 0 UNION ALL
  SELECT p.clip, p.f, e.lo + 0.05 * (p.lo - e.lo), e.hi + 0.05 * (p.hi - e.hi) FROM ema e JOIN per p ON p.clip = e.clip AND p.f = e.f + 1)
SELECT clip, f, round(lo, 6) + 0.0 AS lo, round(hi, 6) + 0.0 AS hi FROM ema""")
def stream_ema(spark, sf):
    """Extremes per frame are aggregated first; the stream puts them in order and smooths them."""
    per = lines(tune(spark).read.parquet(f"{sf}/embeddings.parquet")).groupBy("clip", "f").agg(
        F.min(F.array_min("line") - 1.0).alias("lo"), F.max(F.array_max("line") - 1.0).alias("hi")).withColumn("f", F.col("f").cast("bigint"))
    src = shuffled(per.withColumn("ts", at_second()), mixed("clip", "f"), ["f"], "ts")
    return rounded(state.run_available(state.moving_range(src, patience=3600), "clip string, f bigint, lo double, hi double"), "lo", "hi")


@query("stream_chunks", f"WITH {PANO}, {CHUNKS} SELECT clip, chunk, f, pos, len, emit FROM member")
def stream_chunks(spark, sf):
    """No clip's length is known; the last chunk leaves when its clip has been quiet for an hour."""
    frames = lines(tune(spark).read.parquet(f"{sf}/embeddings.parquet")).select("clip", "f").distinct()
    frames = frames.withColumns({"n": F.lit(None).cast("bigint"), "ts": at_second()})
    src = shuffled(frames, mixed("clip", "f"), ["f"], "ts")
    return state.run_available(state.chunks(src, SIZE, LAP, patience=3600, idle=3_600_000), state.CHUNK_SCHEMA)


@query("stream_progress", f"""WITH RECURSIVE {FRAMES},
seq AS (SELECT job, event_id, ts, frame, el, rate, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS k FROM rated),
kept AS (
  SELECT *, ts AS last, true AS ok FROM seq WHERE k = 1
  UNION ALL
  SELECT s.*, CASE WHEN s.ts - p.last >= {HOURS} THEN s.ts ELSE p.last END, s.ts - p.last >= {HOURS}
  FROM kept p JOIN seq s ON s.job = p.job AND s.k = p.k + 1)
SELECT job, event_id AS id, frame, round(el, 3) + 0.0 AS elapsed, round(rate, 6) + 0.0 AS fps FROM kept WHERE ok""")
def stream_progress(spark, sf):
    """Reports at least 36 hours apart while the total is not known.

    Files follow in time, but every row may be half a file late; what the watermark has
    passed leaves before the stream ends.
    """
    rows = jobs_of(tune(spark).read.parquet(f"{sf}/events.parquet")).select(
        "job", F.col("event_id").alias("id"), "ts", "n", F.lit(None).cast("bigint").alias("total"),
        F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")).alias("at"))
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    span = max(1.0, (high or 0.0) - (low or 0.0))
    delay = F.pmod(F.xxhash64("job", "id"), F.lit(50)) / 100.0
    part = F.least(F.lit(BATCHES - 1), F.floor((F.col("ts") - F.lit(low or 0.0)) / span * BATCHES + delay)).cast("int")
    src = shuffled(rows, part, ["ts", "id"], "at")
    out = state.run_available(state.progress(src, HOURS, patience=int(span / BATCHES) + 1), state.PROGRESS_SCHEMA).drop("eta")
    return rounded(rounded(out, "elapsed", places=3), "fps")
