"""Face alignment against an independent numpy fit, and tiling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbframe.functions.sphere import FACES
from orbframe.operators import align, depth, faces


def known(spark, scale, shift, size=32, overlap=0.15):
    """One smooth scene seen by six widened faces, each with its own scale."""
    from orbframe.operators import grid

    px = grid.face_grid(spark, size, 1.0 + overlap)
    k = F.array_position(F.array(*[F.lit(f) for f in FACES]), F.col("face")).cast("int") - 1
    pick = lambda v: F.get(F.array(*[F.lit(float(x)) for x in v]), k)
    true = 1.6 + 0.5 * F.col("dx") - 0.3 * F.col("dy") + 0.4 * F.col("dz")
    return px.select(F.lit("a").alias("clip"), F.lit(0).alias("f"), "face", "y", "x", ((true - pick(shift)) / pick(scale)).alias("d"))


def fitted(d, size=32):
    pairs = align.band_pairs(d, size).persist()
    params = align.fit(pairs, d, size)
    return pairs, {r.face: (r.s, r.t) for r in params.collect()}, params


def test_a_pure_scale_is_recovered(spark):
    scale = [1.0, 1.2, 0.9, 1.1, 0.8, 1.05]
    pairs, got, _ = fitted(known(spark, scale, [0] * 6))
    s = np.array([got[f][0] for f in FACES])
    assert np.allclose(s / s[0], np.array(scale) / scale[0], rtol=0.02)


def test_fit_reduces_the_residual(spark):
    d = known(spark, [1.0, 1.3, 0.8, 1.1, 0.7, 1.0], [0, 0.2, -0.1, 0.1, 0, -0.2])
    pairs, got, params = fitted(d)
    one = d.select("clip", "f", "face").distinct().withColumns({"s": F.lit(1.0), "t": F.lit(0.0)})
    before = align.seam_residual(pairs, one).first().residual
    after = align.seam_residual(pairs, params).first().residual
    assert after < 0.4 * before
    assert align.apply_fit(d, params).filter("d < 0").count() == 0


def reference_fit(pdf, level):
    """The published recipe, one equation at a time."""
    idx = {f: k for k, f in enumerate(FACES)}
    groups = {(idx[a], idx[b]): g for (a, b), g in pdf.groupby(["i", "j"])}
    keys = sorted(groups)

    def solve(rhs):
        A, b = [], []
        for (i, j), v in rhs.items():
            row = [0.0] * 6
            row[i], row[j] = 1.0, -1.0
            A.append(row)
            b.append(v)
        A.append([1.0] * 6)
        b.append(0.0)
        return np.linalg.lstsq(np.array(A), np.array(b), rcond=None)[0]

    def cost(s, t):
        sq = [((s[i] * g.di + t[i] - s[j] * g.dj - t[j]) ** 2).to_numpy() for (i, j), g in groups.items()]
        return np.sqrt(np.concatenate(sq).mean())

    x = solve({k: np.log(groups[k].dj.median()) - np.log(groups[k].di.median()) for k in keys})
    s0 = np.clip(np.exp(x - x.mean()), 0.25, 4)
    cap = 0.5 * level
    shifts = lambda s: np.clip(solve({(i, j): (s[j] * groups[i, j].dj).median() - (s[i] * groups[i, j].di).median() for i, j in keys}), -cap, cap)
    s = s0.copy()
    for _ in range(4):
        t = shifts(s)
        rhs = {}
        for i, j in keys:
            a, b = s[i] * groups[i, j].di + t[i], s[j] * groups[i, j].dj + t[j]
            ok = (a > 1e-6) & (b > 1e-6)
            if ok.sum() >= 3 and min(a[ok].median(), b[ok].median()) > 1e-6:
                rhs[i, j] = np.log(b[ok].median()) - np.log(a[ok].median())
        if not rhs:
            break
        g = solve(rhs)
        s = np.clip(s * np.exp(g - g.mean()), 0.25, 4)
    t = shifts(s)
    return (s, t) if cost(s, t) <= cost(s0, np.zeros(6)) else (s0, np.zeros(6))


def test_fit_equals_the_recipe(spark):
    d = known(spark, [1.0, 1.3, 0.8, 1.1, 0.7, 1.0], [0, 0.2, -0.1, 0.1, 0, -0.2]).withColumn(
        "d", F.col("d") * (1 + 0.1 * F.sin(F.col("x") * 1.7 + F.col("y"))))
    pairs, got, _ = fitted(d)
    level = align.depth_medians(d, 32).first().med
    s, t = reference_fit(pairs.toPandas(), level)
    for k, f in enumerate(FACES):
        assert got[f] == pytest.approx((s[k], t[k]), abs=1e-9)


def test_median_depth_is_that_of_all_pixels(spark):
    rows = [(c, 0, "+Z", i // 8, i % 8, v) for c, vs in {
        "rare": [9.0 if i % 64 == 0 else 1.0 + i / 64 for i in range(64)], "odd": [3.0, None, 1.0, 2.0], "even": [4.0, 1.0, 2.0, 3.0, None], "none": [None, None]}.items() for i, v in enumerate(vs)]
    d = spark.createDataFrame(rows, "clip string, f int, face string, y int, x int, d double")
    got = {r.clip: r.med for r in align.depth_medians(d, 8).collect()}
    assert got == {"rare": pytest.approx(np.median([v for c, *_, v in rows if c == "rare"])), "odd": 2.0, "even": 2.5, "none": None}
    assert {r.clip: r.med for r in align.depth_medians(d, 8, align.MEDIAN_STRIDE).collect()} == {"rare": 9.0, "odd": 3.0, "even": 4.0, "none": None}


def test_edges_pair_both_directions(spark):
    d = known(spark, [1.0] * 6, [0] * 6, overlap=0.0)
    pairs = align.edge_pairs(d, 32)
    per = pairs.groupBy("i", "j").agg(F.count("*").alias("n"), F.max(F.abs(F.col("di") - F.col("dj"))).alias("gap")).collect()
    assert len(per) == 24 and all(r.n >= 60 for r in per) and max(r.gap for r in per) < 0.1


def test_dark_faces_are_left_alone(spark):
    d = known(spark, [1.0] * 6, [0] * 6).withColumn("d", F.lit(0.0))
    assert align.band_pairs(d, 32).count() == 0


def test_constant_faces_survive_tiling(spark, frames):
    d = frames({("a", 0): np.full((32, 32), 2.0)})
    out = depth.tiled_depth(d, ["clip", "f"], 32, 3, lambda df, keys: df.select(*keys, "y", "x", "d"))
    r = out.agg(F.min("d"), F.max("d"), F.count("*")).first()
    assert r[0] == pytest.approx(2.0) and r[1] == pytest.approx(2.0) and r[2] == 1024


def test_tile_spans_reach_the_edge():
    assert depth.tile_spans(33, 2) == [(0, 0, 18), (1, 14, 33)]


def test_guided_filter_smooths_noise_and_keeps_the_step(spark):
    rng = np.random.default_rng(41)
    n = 24
    step = np.where(np.arange(n) < n // 2, 0.2, 0.8)
    d = np.tile(step, (n, 1)) + rng.normal(0, 0.02, (n, n))
    rows = [("a", 0, y, x, float(step[x]), float(step[x]), float(step[x]), float(d[y, x])) for y in range(n) for x in range(n)]
    df = spark.createDataFrame(rows, "clip string, f int, y int, x int, r double, g double, b double, d double")
    out = depth.smooth_depth(df, n, n, 3).toPandas().pivot(index="y", columns="x", values="d").to_numpy()
    assert out[:, 2:9].std() < 0.6 * d[:, 2:9].std() and out[:, 14].mean() - out[:, 9].mean() > 0.55


def test_overlap_zero_uses_exact_faces(spark, frames):
    px = frames({("a", 0): np.random.default_rng(43).integers(0, 256, (16, 32, 3))}, ("r", "g", "b"))
    out = depth.frame_depth(px, 32, 16, 8, lambda p: depth.luma_model(p, ["clip", "f", "face"]), overlap=0.0)
    assert out.count() == 512
