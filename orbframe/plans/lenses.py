"""Driver tables read as panoramas, sound, tracks, jobs and catalogues.

Each lens exists twice, as a DataFrame and as SQL text, over whole tables.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbframe.session import tune

W, H, CLIP = 64, 32, 10
#: Strength at which 64-pixel panoramas show holes.
STRONG = 20.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf}/{name}.parquet")


# --- panoramas: 32 vectors of 64 values are one frame, 10 frames one clip.
# The last frame is completed by repeating the last vector.


def pano(spark: SparkSession, sf: str) -> DataFrame:
    """``clip, f, y, x, d, r, g, b``."""
    emb = table(spark, sf, "embeddings")
    last = emb.agg(F.max("vec_id")).scalar()
    y = (F.col("vec_id") % H).cast("int")
    lines = emb.select(
        F.floor(F.col("vec_id") / H).alias("n"), "embedding",
        F.explode(F.sequence(y, F.when(F.col("vec_id") == last, F.lit(H - 1)).otherwise(y))).alias("y"),
    )
    row = F.col("n") * H + F.col("y")
    level = lambda a, b: ((row * a + F.col("x") * b) % 256).cast("int")
    return lines.select("n", "y", F.posexplode("embedding").alias("x", "e")).select(
        F.floor(F.col("n") / CLIP).cast("string").alias("clip"), (F.col("n") % CLIP).cast("int").alias("f"), "y", "x",
        (F.col("e").cast("double") + 1.0).alias("d"),
        level(31, 17).alias("r"), level(13, 29).alias("g"), level(7, 5).alias("b"),
    )


PANO = f"""
vecs AS (
  SELECT vec_id // {H} AS n, embedding, vec_id % {H} AS y0,
         CASE WHEN vec_id = (SELECT max(vec_id) FROM embeddings) THEN {H - 1} ELSE vec_id % {H} END AS y1
  FROM embeddings),
lines AS (SELECT n, embedding, unnest(range(y0, y1 + 1)) AS y FROM vecs),
pano AS (
  SELECT CAST(n // {CLIP} AS VARCHAR) AS clip, CAST(n % {CLIP} AS INT) AS f, CAST(y AS INT) AS y, CAST(i AS INT) AS x,
         CAST(embedding[i + 1] AS DOUBLE) + 1.0 AS d,
         CAST(((n * {H} + y) * 31 + i * 17) % 256 AS INT) AS r,
         CAST(((n * {H} + y) * 13 + i * 29) % 256 AS INT) AS g,
         CAST(((n * {H} + y) * 7 + i * 5) % 256 AS INT) AS b
  FROM lines, range({W}) t(i))"""


# --- rays: line items as points seen from the viewer.


def ray_points(spark: SparkSession, sf: str) -> DataFrame:
    """``clip, f, y, x, dist`` on a 256 x 128 panorama, many rays per pixel."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("clip"), F.year("l_shipdate").alias("f"),
        (F.col("l_suppkey") % 128).cast("int").alias("y"), (F.col("l_partkey") % 256).cast("int").alias("x"),
        (F.col("l_discount") * 10 + 1.0).alias("dist"),
    )


RAYS = """
rays AS (
  SELECT l_returnflag AS clip, CAST(year(l_shipdate) AS INT) AS f, CAST(l_suppkey % 128 AS INT) AS y,
         CAST(l_partkey % 256 AS INT) AS x, l_discount * 10 + 1.0 AS dist
  FROM lineitem)"""


# --- sound: the 64 values of a vector are four third-order samples.


def audio(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings")
    sample = lambda j: F.struct(F.lit(j).alias("j"), F.transform(F.slice("embedding", 16 * j + 1, 16), lambda v: v.cast("double")).alias("ch"))
    four = emb.select("label", "vec_id", F.inline(F.array(*[sample(j) for j in range(4)])))
    return four.select(F.col("label").cast("string").alias("clip"), (F.col("vec_id") * 4 + F.col("j")).alias("n"), "ch")


AUDIO = """
audio AS (
  SELECT CAST(label AS VARCHAR) AS clip, vec_id * 4 + i // 16 AS n, CAST(i % 16 AS INT) AS c, CAST(embedding[i + 1] AS DOUBLE) AS v
  FROM embeddings, range(64) t(i))"""


# --- events as tracks and as jobs.


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "event_id", "ts", "value")


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """A job per user: each event finishes ``props.k`` frames at ``ts`` seconds."""
    return jobs_of(table(spark, sf, "events"))


def jobs_of(ev: DataFrame) -> DataFrame:
    # Calendar parts, so the result does not hang on the session time zone.
    seconds = F.expr(
        "(unix_date(cast(ts AS date)) * 86400000000L + hour(ts) * 3600000000L + minute(ts) * 60000000L"
        " + cast(extract(SECOND FROM ts) * 1000000 AS bigint)) / 1e6"
    )
    return ev.select(
        F.col("user_id").alias("job"), F.col("event_id"), seconds.alias("ts"), F.col("event_type"),
        F.get_json_object("props", "$.k").cast("bigint").alias("n"), F.col("value"),
    )


JOBS = """
jobs AS (
  SELECT user_id AS job, event_id, epoch_us(ts) / 1e6 AS ts, event_type,
         CAST(json_extract(props, '$.k') AS BIGINT) AS n, value
  FROM events)"""
