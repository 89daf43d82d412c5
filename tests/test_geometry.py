"""Projection properties and brute-force gathers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbframe import FRAME
from orbframe.functions import sphere
from orbframe.operators import faces, grid


def test_round_trip_of_a_smooth_image_is_close(spark, frames, image):
    w, h = 32, 16
    y, x = np.mgrid[0:h, 0:w]
    img = 2 + np.sin(x / w * 2 * math.pi) * np.cos((y + 0.5) / h * math.pi - math.pi / 2)
    px = frames({("a", 0): img})
    back = image(faces.faces_to_panorama(faces.panorama_to_faces(px, w, h, 16, ["d"]), 16, w, h, ["d"]))[("a", 0)]
    assert np.nanmax(np.abs(back - img)) < 0.1 and not np.isnan(back).any()


def test_a_constant_survives_every_resampling(spark, frames, image):
    px = frames({("a", 0): np.full((16, 32), 0.7)})
    six = faces.panorama_to_faces(px, 32, 16, 8, ["d"])
    wide = faces.widen_faces(six, 8, ["d"])
    blended = image(faces.blend_faces(wide, 8, 32, 16))[("a", 0)]
    assert np.allclose(blended, 0.7) and blended.shape == (16, 32)


def test_blend_weights_add_to_one(spark):
    from orbframe.operators import quality

    assert quality.weight_sums(faces.blend_map(spark, 48, 24, 16)).count() == 0
    assert sphere.face_fov_degrees() == pytest.approx(97.98, abs=0.02)


def test_direction_and_pixel_are_inverse(spark):
    px = grid.rays(grid.image_grid(spark, 40, 20), 40, 20)
    u, v = sphere.uv_of_dir(F.col("dx"), F.col("dy"), F.col("dz"), 40, 20)
    worst = px.select(F.max(F.abs(u - F.col("x"))), F.max(F.abs(v - F.col("y")))).first()
    assert max(worst) < 1e-9


@pytest.mark.parametrize("d,face", [((1, 1, 1), "+X"), ((-1, 1, 1), "-X"), ((0, 1, 1), "+Y"), ((0, -1, 1), "-Y"), ((0, 0, 1), "+Z"), ((0, 0, -1), "-Z")])
def test_ties_between_faces(spark, d, face):
    one = spark.range(1).select(sphere.owner(*[F.lit(float(c)) for c in d])["face"].alias("f"))
    assert one.first().f == face


def brute_sample(img, u, v, wrap_x, pole):
    h, w = img.shape
    x0, y0 = math.floor(u), math.floor(v)

    def at(y, x):
        if wrap_x:
            x %= w
        if pole == "wrap":
            y %= h
        if pole == "zero" and not (0 <= x < w and 0 <= y < h):
            return 0.0
        return img[min(max(y, 0), h - 1), min(max(x, 0), w - 1)]

    fx, fy = u - x0, v - y0
    return (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy


@pytest.mark.parametrize("wrap_x,pole", [(True, "clamp"), (True, "wrap"), (False, "clamp"), (False, "zero")])
def test_gather_borders(spark, frames, wrap_x, pole):
    rng = np.random.default_rng(1)
    img = rng.random((5, 7))
    pts = [(i, rng.uniform(-0.5, 6.49), rng.uniform(-0.5, 4.49)) for i in range(60)]
    at = spark.createDataFrame(pts, "i int, u double, v double")
    gmap = at.withColumns(grid.tap_coords(F.col("u"), F.col("v"), 7, 5, wrap_x, pole)).select("i", "y0", "x0", "fy", "fx")
    got = {r.i: r.d for r in grid.gather(frames({("a", 0): img}), gmap, ["d"], 60, wrap_x=wrap_x, pole=pole).collect()}
    for i, u, v in pts:
        assert got[i] == pytest.approx(brute_sample(img, u, v, wrap_x, pole), abs=1e-12)


def test_packed_frame_is_checked(spark, frames):
    with pytest.raises(ValueError):
        faces.packed_faces(frames({("a", 0): np.zeros((4, 8))}), 8, 4)
    px = frames({("a", 0): np.arange(24.0).reshape(4, 6)})
    up = faces.packed_faces(px, 6, 4).filter("face = '+Y'").orderBy("y", "x").select("d").toPandas().d.tolist()
    assert up == [4, 5, 10, 11]
    with pytest.raises(ValueError):
        faces.packed_faces(px, 6, 4, padding=1)


def test_source_with_faces_keeps_them(spark, frames):
    px = frames({("a", 0): np.full((8, 12), 3.0)})
    pano, six = faces.read_source(px, "cubemap", 12, 8, 0, ["d"])
    assert pano.count() == 16 * 8 and six.count() == 96
    same, none = faces.read_source(px, "equirectangular", 12, 8, 0, ["d"])
    assert same is px and none is None


def test_blocks_keep_every_pixel(spark, frames):
    rng = np.random.default_rng(2)
    px = frames({("a", 0): rng.integers(0, 256, (10, 13, 3))}, ("r", "g", "b"))
    back = grid.explode_blocks(grid.pack_blocks(px, 4), 4)
    assert back.exceptAll(px.select(*back.columns)).count() == 0 and back.count() == 130


def test_large_maps_are_not_broadcast(spark, frames):
    px = frames({("a", 0): np.zeros((4, 8))})
    gmap = faces.panorama_to_face_map(spark, 8, 4, 2)
    plan = lambda rows: grid.gather(px, gmap, ["d"], rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(24) and "strategy=broadcast" not in plan(grid.BROADCAST_ROWS + 1)
