"""Ranges, chunks, stabiliser, temporal filling; hot keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbframe.operators import progress, ranges, temporal


def test_chunk_sizes_of_ten_frames(spark):
    df = spark.range(10).select(F.lit("a").alias("clip"), F.col("id").cast("int").alias("f"))
    got = temporal.chunk_windows(df, temporal.clip_lengths(df), 4, 2)
    sizes = [r.n for r in got.groupBy("chunk").agg(F.count("*").alias("n")).orderBy("chunk").collect()]
    assert sizes == [4, 4, 4, 4, 2]
    assert sorted(r.f for r in got.filter("emit").collect()) == list(range(10))
    with pytest.raises(ValueError):
        temporal.chunk_windows(df, temporal.clip_lengths(df), 2, 2)


def simulate(n, size, overlap):
    """Chunks as a buffer fills and empties."""
    buf, chunks = [], []
    for f in range(n):
        buf.append(f)
        if len(buf) == size:
            chunks.append(list(buf))
            buf = buf[size - overlap:] if overlap else []
    return chunks + ([buf] if buf else [])


@pytest.mark.parametrize("n", [1, 3, 4, 5, 6, 7, 9, 16])
@pytest.mark.parametrize("size,overlap", [(4, 2), (4, 0), (4, 3), (5, 1)])
def test_chunks_equal_a_buffer(spark, n, size, overlap):
    df = spark.range(n).select(F.lit("a").alias("clip"), F.col("id").cast("int").alias("f"))
    rows = temporal.chunk_windows(df, temporal.clip_lengths(df), size, overlap).collect()
    got = {}
    for r in rows:
        got.setdefault(r.chunk, []).append(r.f)
    assert [sorted(got[c]) for c in sorted(got)] == simulate(n, size, overlap)


def test_blends_chain_when_overlap_exceeds_step(spark):
    n, size, overlap = 9, 4, 3
    value = lambda chunk, f: 10.0 * chunk + f
    df = spark.range(n).select(F.lit("a").alias("clip"), F.col("id").cast("int").alias("f"), F.lit(0).alias("y"), F.lit(0).alias("x"))
    est = temporal.chunk_windows(df, temporal.clip_lengths(df), size, overlap).withColumn("d", F.col("chunk") * 10.0 + F.col("f"))
    got = {r.f: r.d for r in temporal.blend_overlap(est.drop("len", "emit"), overlap).collect()}
    want, tail = {}, []
    chunks = simulate(n, size, overlap)
    for c, frames in enumerate(chunks):
        maps = [value(c, f) for f in frames]
        for i, prev in enumerate(tail):
            w = (i + 1) / (len(tail) + 1)
            maps[i] = (1 - w) * prev + w * maps[i]
        keep = overlap if len(frames) == size else 0
        for f, m in list(zip(frames, maps))[:len(maps) - keep]:
            want[f] = m
        tail = maps[len(maps) - keep:] if keep else []
    assert got == pytest.approx(want)


def test_smoothing_equals_a_loop_for_a_long_hot_clip(spark):
    n = 5000
    rng = np.random.default_rng(23)
    lo, hi = rng.random(n), rng.random(n) + 1
    rows = [("hot", i, float(lo[i]), float(hi[i])) for i in range(n)] + [("cold", 0, 0.5, 2.0)]
    df = spark.createDataFrame(rows, "clip string, f int, lo double, hi double")
    got = ranges.moving_range(df).filter("clip = 'hot'").orderBy("f").toPandas()
    a, want = lo[0], []
    for v in lo:
        a += 0.05 * (v - a)
        want.append(a)
    assert np.allclose(got.lo, want, atol=1e-12) and len(got) == n


@pytest.mark.parametrize("alpha", [0.0005, 0.3, 0.9, 1.0])
def test_smoothing_for_any_weight(spark, alpha):
    v = np.random.default_rng(24).random(3000)
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "clip string, k int, v double")
    got = ranges.smoothed(df, ["clip"], ["v"], alpha).orderBy("k").toPandas().v
    a, want = v[0], []
    for x in v:
        a += alpha * (x - a)
        want.append(a)
    assert np.allclose(got, want, atol=1e-12)


def test_rank_of_a_hot_key_with_gaps(spark):
    df = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("k"), (F.col("id") * 7).alias("t"))
    got = ranges.ranked(df, ["k"], ["t"], F.floor(F.col("t") / 500), "r").toPandas().sort_values(["k", "t"])
    assert all((g.r.to_numpy() == np.arange(len(g))).all() for _, g in got.groupby("k"))


def test_flat_range_is_safe(spark, frames, image):
    px = frames({("a", 0): np.full((4, 8), 3.0)})
    assert (image(ranges.normalise(px, ranges.frame_range(px)))[("a", 0)] == 0).all()


def test_stabiliser_equals_a_loop(spark, frames, image):
    rng = np.random.default_rng(29)
    seq = 0.5 + np.cumsum(rng.normal(0, 0.02, (12, 3, 5)), axis=0)
    px = frames({("a", f): seq[f] for f in range(12)} | {("b", 0): seq[3]})
    got = image(temporal.stabilise(px))
    prev = None
    for f in range(12):
        d = seq[f]
        if prev is not None:
            w = 0.9 * np.clip((0.04 - np.abs(d - prev)) / 0.02, 0, 1)
            d = w * prev + (1 - w) * d
        prev = d
        assert np.allclose(got[("a", f)], d)
    assert np.allclose(got[("b", 0)], seq[3])
    assert temporal.stabilise(px, 0.0) is px


def test_stabiliser_across_small_batches(spark, frames, image):
    seq = np.random.default_rng(31).random((6, 4, 9)) * 0.05
    px = frames({("a", f): seq[f] for f in range(6)})
    whole = image(temporal.stabilise(px))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        small = image(temporal.stabilise(px))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(np.allclose(whole[k], small[k]) for k in whole)


def eye(spark, values, holes):
    rows = [("a", 0, f, 0, 0, v, v, v, h) for f, (v, h) in enumerate(zip(values, holes))]
    return spark.createDataFrame(rows, "clip string, chunk int, f int, y int, x int, r int, g int, b int, hole boolean")


@pytest.mark.parametrize("values,want,hole", [
    ((100, 100, 104, 0), 100, False),   # witnesses agree
    ((0, 200, 100, 0), 0, True),        # they do not
])
def test_temporal_fill_consensus(spark, values, want, hole):
    r = temporal.temporal_fill(eye(spark, values, (False, False, False, True))).filter("f = 3").first()
    assert (r.r, r.hole) == (want, hole)


def test_temporal_fill_single_witness(spark):
    r = temporal.temporal_fill(eye(spark, (77, 0, 0), (False, True, True))).filter("f = 2").first()
    assert (r.r, r.hole) == (77, False)


def test_median_lock_needs_three_frames(spark):
    rows = [("a", c, f, 0, 0, d) for c, f, d in [(0, 0, 0.5), (0, 1, 0.505), (0, 2, 0.51), (1, 3, 0.5), (1, 4, 0.6)]]
    df = spark.createDataFrame(rows, "clip string, chunk int, f int, y int, x int, d double")
    got = {r.f: r.d for r in temporal.median_lock(df).collect()}
    assert got[0] == got[2] == pytest.approx(0.505) and (got[3], got[4]) == (0.5, 0.6)


def test_throttle_equals_a_loop_for_a_hot_job(spark):
    rng = np.random.default_rng(37)
    ts = np.cumsum(rng.exponential(0.04, 3000))
    rows = [("hot", i, float(t), i + 1, 3000) for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "job string, id int, ts double, frame bigint, total bigint")
    got = {r.id for r in progress.throttle(df, F.floor(F.col("ts") / 5), ["job"], ["ts", "id"], 0.1).collect()}
    want, last = set(), None
    for i, t in enumerate(ts):
        if last is None or i == 2999 or t - last >= 0.1:
            want.add(i)
            last = t
    assert got == want
