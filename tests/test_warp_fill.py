"""View synthesis and filling against brute force and known properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbframe import FRAME
from orbframe.operators import components, fill, packing, warp

W, H = 32, 16


def scene(seed=3):
    rng = np.random.default_rng(seed)
    depth = np.full((H, W), 0.1)
    depth[4:12, 10:14] = 0.9
    depth[3:13, 22] = 0.75
    rgb = rng.integers(0, 256, (H, W, 3))
    return np.concatenate([rgb, depth[..., None]], axis=-1)


def pixels(spark, img, clip="a", f=0):
    rows = [(clip, f, y, x, int(p[0]), int(p[1]), int(p[2]), float(p[3])) for (y, x), p in
            ((i, img[i]) for i in np.ndindex(img.shape[:2]))]
    return spark.createDataFrame(rows, "clip string, f int, y int, x int, r int, g int, b int, d double")


def brute_zbuffer(d, strength):
    z = np.full((H, W), np.inf)
    b = -strength * 0.03
    for y in range(H):
        for x in range(W):
            lam = 1 / (d[y, x] + 0.05)
            lon, lat = ((x + 0.5) / W - 0.5) * 2 * math.pi, (0.5 - (y + 0.5) / H) * math.pi
            dx, dy, dz = math.cos(lat) * math.sin(lon), math.sin(lat), math.cos(lat) * math.cos(lon)
            p = (lam * dx + b * dz, lam * dy, lam * dz - b * dx)
            n = math.sqrt(sum(c * c for c in p))
            u = (math.atan2(p[0], p[2]) / math.pi * 0.5 + 0.5) * W - 0.5
            v = (0.5 - math.asin(p[1] / n) / math.pi) * H - 0.5
            for ty in (math.floor(v), math.floor(v) + 1):
                for tx in (math.floor(u), math.floor(u) + 1):
                    if 0 <= ty < H:
                        z[ty, tx % W] = min(z[ty, tx % W], n)
    return z


def test_zbuffer_equals_four_way_splat(spark, image):
    img = scene()
    px = pixels(spark, img).withColumn("dist", warp.distance(F.col("d")))
    got = image(warp.zbuffer(px, W, H, 8.0), ("dist",))[("a", 0)]
    want = brute_zbuffer(img[..., 3], 8.0)
    assert (np.isnan(got) == np.isinf(want)).all()
    assert np.allclose(got[~np.isnan(got)], want[~np.isinf(want)])


def test_zero_strength_is_the_source(spark):
    px = pixels(spark, scene())
    out = warp.synthesise(px, W, H, 0.0)
    assert out.filter("hole").count() == 0
    assert out.select("y", "x", "r", "g", "b").exceptAll(px.select("y", "x", "r", "g", "b")).count() == 0


def test_uniform_depth_moves_every_longitude_alike(spark):
    from orbframe.operators import quality

    px = pixels(spark, np.dstack([np.zeros((H, W, 3)), np.full((H, W), 0.5)])).withColumn("dist", warp.distance(F.col("d")))
    s = quality.ray_shift(px, W, H, 1.0).toPandas()
    assert s.shift_x.std() < 1e-9 and (s.shift_x < 0).all() and s.shift_y.abs().max() < 0.1


def test_gradient_never_exceeds_the_limit_and_only_falls(spark, frames, image):
    d = np.random.default_rng(5).random((8, 12))
    got = image(warp.clamp_gradient(frames({("a", 0): d}), 0.1, 0.2))[("a", 0)]
    assert (got <= d + 1e-12).all()
    assert np.abs(np.diff(got, axis=1)).max() <= 0.1 + 1e-9 and np.abs(np.diff(got, axis=0)).max() <= 0.2 + 1e-9


def test_softening_leaves_flat_and_thin_depth_alone(spark, frames, image):
    d = np.full((11, 21), 0.1)
    d[:, 10] = 0.9
    got = image(warp.soften_edges(frames({("a", 0): d})))[("a", 0)]
    assert np.allclose(got, d)
    d[:, 12:] = 0.9
    d[:, 10] = 0.1
    wide = image(warp.soften_edges(frames({("a", 0): d})))[("a", 0)]
    assert wide[5, 12] < 0.9 and wide[5, 18] == pytest.approx(0.9)


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_directional_fill_equals_a_loop(spark, sign):
    rng = np.random.default_rng(7)
    h, w = 6, 14
    img, hole = rng.integers(0, 256, (h, w, 3)), rng.random((h, w)) < 0.35
    hole[2] = True
    hole[4] = False
    rows = [("a", 0, y, x, *map(int, img[y, x]), bool(hole[y, x])) for y in range(h) for x in range(w)]
    df = spark.createDataFrame(rows, "clip string, f int, y int, x int, r int, g int, b int, hole_d boolean")
    got = {(r.y, r.x): r for r in fill.directional(df, w, sign).collect()}
    for y in range(h):
        ok = np.flatnonzero(~hole[y])
        for x in range(w):
            want, done = img[y, x], False
            if hole[y, x] and ok.size:
                left, right = ok[ok < x], ok[ok > x]
                bound = (right.min() if right.size else left.max()) if sign > 0 else (left.max() if left.size else right.min())
                src = (2 * bound - x) % w
                want, done = img[y, bound if hole[y, src] else src], True
            r = got[(y, x)]
            assert (r.r, r.g, r.b) == tuple(want) and r.done == done


def flood(mask):
    label, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask)):
        if label[start]:
            continue
        n += 1
        todo = [start]
        while todo:
            y, x = todo.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not label[y, x]:
                label[y, x] = n
                todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return label


@pytest.mark.parametrize("density", [0.2, 0.45, 0.7])
def test_components_equal_flood_fill(spark, frames, density):
    mask = np.random.default_rng(11).random((20, 30)) < density
    px = frames({("a", 0): mask}, ("hole",))
    got = components.label_pixels(components.components(px)).toPandas()
    want = flood(mask)
    pairs = {(want[y, x], lab) for y, x, lab in zip(got.y, got.x, got.label)}
    assert len(got) == mask.sum() and len(pairs) == want.max() == got.label.nunique()


def test_a_spiral_is_one_component(spark, frames):
    mask = np.zeros((15, 15), bool)
    y = x = 0
    dy, dx, lo, hi = 0, 1, 0, 14
    for ring in range(0, 7, 2):
        mask[ring, ring:15 - ring] = True
        mask[ring:15 - ring, 14 - ring] = True
        mask[14 - ring, ring:15 - ring] = True
        mask[ring + 2:15 - ring, ring] = True
        if ring + 2 < 8:
            mask[ring + 2, ring:ring + 3] = True
    got = components.components(frames({("a", 0): mask}, ("hole",)))
    assert got.select("label").distinct().count() == flood(mask).max()


def test_boxes_merge_until_disjoint(spark):
    rng = np.random.default_rng(13)
    boxes = [(int(x), int(y), int(x) + 3, int(y) + 3) for x, y in rng.integers(0, 180, (40, 2))]
    rows = [("a", 0, i, *b) for i, b in enumerate(boxes)]
    df = spark.createDataFrame(rows, "clip string, f int, label bigint, x0 int, y0 int, x1 int, y1 int")
    got = sorted((r.x0, r.y0, r.x1, r.y1) for r in components.hole_boxes(df, 200, 200, margin=5).collect())
    want = [(max(0, a - 5), max(0, b - 5), min(200, c + 5), min(200, d + 5)) for a, b, c, d in boxes]
    changed = True
    while changed:
        changed = False
        for i in range(len(want)):
            for j in range(i + 1, len(want)):
                p, q = want[i], want[j]
                if p[0] < q[2] and q[0] < p[2] and p[1] < q[3] and q[1] < p[3]:
                    want[i] = (min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3]))
                    del want[j]
                    changed = True
                    break
            if changed:
                break
    if sum((c - a) * (d - b) for a, b, c, d in want) > 0.5 * 200 * 200:
        want = [(0, 0, 200, 200)]
    assert got == sorted(want)


def test_margins_grow_until_something_is_drawable(spark):
    df = spark.createDataFrame([("a", 0, 0, 50, 50, 51, 51)], "clip string, f int, label bigint, x0 int, y0 int, x1 int, y1 int")
    paint = spark.createDataFrame([("a", 0, y, x) for y in range(45, 56) for x in range(45, 56)], "clip string, f int, y int, x int")
    got = components.hole_boxes(df, 200, 200, paint, margin=2).collect()
    assert [(r.x0, r.y0, r.x1, r.y1) for r in got] == [(42, 42, 59, 59)]


def test_flat_ring_widens(spark):
    d = np.full((40, 40), 0.2)
    d[:, 30:] = 0.8
    hole = np.zeros((40, 40), bool)
    hole[20, 20] = True
    rows = [("a", 0, y, x, float(d[y, x]), bool(hole[y, x])) for y in range(40) for x in range(40)]
    df = spark.createDataFrame(rows, "clip string, f int, y int, x int, d double, hole boolean")
    r = fill.ring_threshold(df).first()
    assert r.radius == 12 and r.threshold == pytest.approx(0.5)


def test_pyramid_takes_the_finest_level(spark):
    rows = [("a", 0, y, x, 10 * (y // 2), 0, 0, (y, x) == (0, 0)) for y in range(4) for x in range(4)]
    df = spark.createDataFrame(rows, "clip string, f int, y int, x int, r int, g int, b int, hole boolean")
    out = fill.pyramid(df, 2)
    assert out.filter("y = 0 and x = 0").first().r == 0.0 and out.count() == 16


def test_learned_fill_changes_only_the_mask(spark):
    rng = np.random.default_rng(17)
    mask = rng.random((12, 16)) < 0.2
    rows = [("a", 0, y, x, 7, 8, 9, bool(mask[y, x])) for y in range(12) for x in range(16)]
    df = spark.createDataFrame(rows, "clip string, f int, y int, x int, r int, g int, b int, hole boolean")
    out = components.learned_fill(df, 16, 12, lambda: (lambda img, m: img * 0 + 99.0), pad=1).toPandas()
    assert len(out) == 192 and (out.loc[out.hole, "r"] == 99).all() and (out.loc[~out.hole, "r"] == 7).all()
    big = components.learned_fill(df, 16, 12, lambda: (lambda img, m: img * 0 + 99.0), pad=1, max_crop=1).toPandas()
    assert (big.r == 7).all()


def test_area_resize_keeps_the_mean(spark, frames, image):
    d = np.random.default_rng(19).random((9, 12))
    out = image(packing.area_resize(frames({("a", 0): d}), 12, 9, 5, 4, ["d"]))[("a", 0)]
    assert out.shape == (4, 5) and out.mean() == pytest.approx(d.mean())


def test_half_field_wraps_and_unpacks(spark, frames):
    px = frames({("a", 0): np.arange(16.0).reshape(2, 8)})
    eyes = px.withColumn("eye", F.explode(F.array(F.lit("left"), F.lit("right"))))
    packed = packing.side_by_side(eyes, 8, 180.0)
    row = [r.d for r in packed.filter("y = 0").orderBy("x").collect()]
    assert row == [6, 7, 0, 1, 6, 7, 0, 1]
    assert packing.unpack_side_by_side(packed, 4).filter("eye = 'right'").count() == 8


def test_fills_join_pixels_without_broadcast(spark, frames):
    """What a fill joins are pixels; written ones look small to the planner."""
    import numpy as np

    from orbframe.operators import components, fill
    from orbframe.session import cut

    img = np.random.default_rng(1).integers(0, 255, (8, 16, 3))
    px = cut(frames({("a", 0): img}, ("r", "g", "b")).selectExpr("*", "(y * 16 + x) % 5 = 0 AS hole"))
    near = px.withColumn("near", ~px.hole)
    for df in (fill.pyramid(px, 4), components.touching_components(near)):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()


def test_partitions_of_pixels_stay_small(spark):
    """A task's memory would grow with the input if partitions met the usual 64 MB."""
    assert spark._jsparkSession.sessionState().conf().getConfString("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "4MB"
