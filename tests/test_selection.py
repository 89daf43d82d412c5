"""Selection by rank against the engine's own percentiles, sketches against their bound, and the ordered index."""

import re
import subprocess
import sys
import textwrap
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbframe.operators import order, progress, selection


def test_buckets_rise_with_the_values(spark):
    rng = np.random.default_rng(1)
    tiny = [5e-324, 1e-310, 2.2250738585072014e-308, 1.7976931348623157e308]
    near = [x for e in range(-6, 7) for x in (np.nextafter(2.0**e, 0), 2.0**e, np.nextafter(2.0**e, 9e9))]
    v = [*tiny, *near, 0.0, -0.0, float("inf"), *rng.normal(size=300), *np.exp(rng.normal(size=300) * 80)]
    v = sorted({float(x) for x in v} | {-float(x) for x in v})
    got = spark.createDataFrame([(x,) for x in [*v, float("nan")]], "v double").select("v", selection.coarse(F.col("v")).alias("b")).collect()
    b = [r.b for r in sorted(got, key=lambda r: (r.v != r.v, r.v))]
    assert b == sorted(b) and len(set(b)) > 700


@pytest.mark.parametrize("inside", [False, True])
def test_quantiles_are_the_engines(spark, inside):
    rng = np.random.default_rng(2)
    rows = [("a", float(x)) for x in rng.normal(size=2000)] + [("b", float(x)) for x in np.round(rng.normal(size=999), 1)]
    rows += [("c", 1.0)] * 7 + [("d", None), ("d", None), ("e", None), ("e", -3.5), ("f", float("nan")), ("f", 1.0), ("g", 2.0), ("g", 5.0)]
    rows += [("hot", 0.25)] * 3000 + [("hot", float(x)) for x in rng.random(500)] + [(None, 4.0), ("z", -0.0), ("z", 0.0), ("z", -1e-300)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    points = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    want = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, points))).alias("q")).collect() if r.k is not None}
    got = {r.k: r.q for r in selection.quantiles(df.repartition("k") if inside else df, ["k"], "v", points).collect()}
    assert set(got) == set(want)
    for k, q in want.items():
        if q is None:
            assert got[k] == [None] * len(points)
        else:
            np.testing.assert_array_equal(got[k], q)
    assert selection.quantiles(df.where("false"), ["k"], "v", [0.5]).count() == 0


def test_a_frame_of_millions_of_values_in_little_memory():
    """4 million distinct values of one group, with 600 MB for everything."""
    script = """
        import sys; sys.path.insert(0, sys.argv[1])
        from pyspark.sql import SparkSession, functions as F
        from orbframe.operators import selection
        spark = (SparkSession.builder.master("local[4]").config("spark.driver.memory", "600m").config("spark.ui.enabled", "false")
                 .config("spark.sql.shuffle.partitions", "16").getOrCreate())
        n = 4_000_001
        px = spark.range(0, n, 1, 8).select(F.lit("a").alias("clip"), F.lit(0).alias("f"), ((F.col("id") * 48271) % n / n).alias("d"))
        print(selection.quantiles(px, ["clip", "f"], "d", [0.01, 0.5, 0.99]).first().q)
    """
    root = str(Path(__file__).parents[1])
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(script), root], capture_output=True, text=True, timeout=300)
    got = eval(out.stdout.strip().splitlines()[-1])
    assert got == pytest.approx([0.01, 0.5, 0.99], abs=1e-6)


def test_sketches_merge(spark):
    rng = np.random.default_rng(4)
    rows = [("a", f, float(x)) for f in range(6) for x in rng.normal(size=3000) * (f + 1)]
    df = spark.createDataFrame(rows, "clip string, f int, d double").repartition(4)
    frames = selection.sketched(df, ["clip", "f"])
    whole = selection.ranges_of(selection.merged(frames, ["clip"]), [0.01, 0.99])
    per_frame = frames.select("clip", "f").join(whole, "clip")
    r = selection.ranks(df, per_frame, ["clip"]).first()
    assert r.n == 18000 and abs(r.rank_lo - 0.01) <= selection.ERROR and abs(r.rank_hi - 0.99) <= selection.ERROR


def test_pixels_are_not_shuffled_by_chunk(spark):
    """What goes by chunk are partial sketches alone."""
    px = spark.range(100).select(F.lit("a").alias("clip"), (F.col("id") % 5).alias("f"), (F.col("id") % 2).alias("chunk"), F.rand(1).alias("d"))
    merged = selection.merged(selection.sketched(px, ["clip", "f", "chunk"]), ["clip", "chunk"])
    lines = merged._jdf.queryExecution().executedPlan().toString().splitlines()
    at = [i for i, x in enumerate(lines) if "Exchange hashpartitioning(" in x and "chunk#" in x and not re.search(r"\bf#", x)]
    assert len(at) == 1 and "kll_merge_agg" in lines[at[0] + 1]


def test_the_index_is_dense_and_in_order(spark):
    rng = np.random.default_rng(5)
    rows = [("hot" if rng.random() < 0.4 else str(rng.integers(9)), float(rng.random()), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "job string, ts double, id int")
    got = sorted(order.indexed(df, ["job", "ts", "id"]).collect(), key=lambda r: r._at)
    assert [r._at for r in got] == list(range(5000))
    assert [(r.job, r.ts, r.id) for r in got] == sorted(rows)


def loop(rows, interval):
    kept, last = set(), {}
    for job, i, ts, frame, total in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if job not in last or ts - last[job] >= interval or frame == total:
            kept.add((job, i))
            last[job] = ts
    return kept


@pytest.mark.parametrize("size,interval", [(1 << 16, 0.1), (200, 0.1), (150, 40.0), (300, 0.0)])
def test_throttle_over_buckets(spark, size, interval):
    """A job with most of the rows and no pause, small ones, ties, and ends in the middle."""
    rng = np.random.default_rng(size)
    rows = []
    for job, n in (("hot", 900), ("a", 1), ("b", 40), ("c", 333)):
        ts = np.round(np.cumsum(rng.exponential(0.04, n)), 2)
        rows += [(job, i, float(t), i + 1 if i % 211 else 500, n if i % 97 else 500) for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "job string, id int, ts double, frame bigint, total bigint").repartition(3)
    got = [(r.job, r.id) for r in progress.throttle(df, None, ["job"], ["ts", "id"], interval, size).collect()]
    assert len(got) == len(set(got)) and set(got) == loop(rows, interval)
