"""Depth models over blocks or pixels, tiling, and edge-aware smoothing."""

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbframe import FRAME
from orbframe.operators import align, faces, grid, packing, ranges
from orbframe.session import cut

# Pixel scaling of the image models, batch size, tile feather.
IMAGE_MEAN, IMAGE_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
MICRO_BATCH, TILE_OVERLAP = 8, 0.125
MAX_TILE_SCALE = 4.0


def luma_model(df: DataFrame, keys: list[str]) -> DataFrame:
    """Deterministic stand-in for a depth model: mean colour, scaled to each
    image's own range, raised to 1.4, plus 0.05."""
    luma = ((F.col("r") + F.col("g") + F.col("b")) / 3.0 / 255.0).alias("d")
    image = Window.partitionBy(*keys)
    px = df.select(*keys, "y", "x", luma).withColumns({"lo": F.min("d").over(image), "hi": F.max("d").over(image)})
    unit = (F.col("d") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6))
    return px.select(*keys, "y", "x", (F.pow(unit, F.lit(1.4)) + 0.05).alias("d"))


def images(df: DataFrame, keys: list[str], w: int, h: int) -> DataFrame:
    """One row per image: its pixels as a flat array, row by row, channels last."""
    px = F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b")))
    flat = lambda p: F.array(*[p[c].cast("float") for c in "rgb"])
    return df.groupBy(*keys).agg(F.flatten(F.transform(px, flat)).alias("image"))


def explode_depth(df: DataFrame, keys: list[str], w: int, column: str = "depth") -> DataFrame:
    """Flat model output back to pixel rows."""
    cells = F.transform(column, lambda d, i: F.struct(
        (i / w).cast("int").alias("y"), (i % w).cast("int").alias("x"), d.cast("double").alias("d")))
    return df.select(*keys, F.inline(cells))


def preprocess(df: DataFrame, keys: list[str], w: int, h: int, tw: int, th: int) -> DataFrame:
    """Model input by column arithmetic: area resize when shrinking, cubic taps
    otherwise, then scale, centre and divide per channel."""
    if tw * th < w * h:
        px = packing.area_resize(df, w, h, tw, th, ["r", "g", "b"], keys)
    else:
        px = resize_cubic(df, keys, w, h, tw, th, ["r", "g", "b"])
    scaled = {c: (F.col(c) / 255.0 - m) / s for c, m, s in zip("rgb", IMAGE_MEAN, IMAGE_STD)}
    return px.withColumns(scaled)


#: Sharpness of the cubic kernel.
CUBIC = -0.75


def cubic_weights(t: Column) -> list[Column]:
    """Weights of the four taps around a place, ``t`` behind the second one."""
    near = lambda x: ((CUBIC + 2.0) * x - (CUBIC + 3.0)) * x * x + 1.0
    far = lambda x: ((x - 5.0) * x + 8.0) * x * CUBIC - 4.0 * CUBIC
    inner = [far(t + 1.0), near(t), near(1.0 - t)]
    return [*inner, 1.0 - inner[0] - inner[1] - inner[2]]


def resize_cubic(df: DataFrame, keys: list[str], w: int, h: int, ow: int, oh: int, values: list[str]) -> DataFrame:
    """Enlarge by cubic taps, first along rows, then along columns; edges repeat.

    Each axis has a fixed list of taps, four for each new place, which a row (a column) of
    pixels looks up in its own array, so a pixel is shuffled once for each axis.
    """

    def along(src, axis, n, on):
        other = "x" if axis == "y" else "y"
        line = F.array_sort(F.collect_list(F.struct(axis, *values)))
        rows = src.groupBy(*keys, other).agg(line.alias("_line"))
        at = (F.col(f"_{axis}") + 0.5) * (n / on) - 0.5
        tap = lambda k: F.get(F.col("_line"), F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(at).cast("int") + k)))
        weights = cubic_weights(at - F.floor(at))
        mixed = [sum(wt * tap(k)[v] for wt, k in zip(weights, (-1, 0, 1, 2))).alias(v) for v in values]
        places = rows.withColumn(f"_{axis}", F.explode(F.sequence(F.lit(0), F.lit(on - 1))))
        return places.select(*keys, other, F.col(f"_{axis}").alias(axis), *mixed)

    return along(along(df, "x", w, ow), "y", h, oh).select(*keys, "y", "x", *values)


def resize_bilinear(df: DataFrame, keys: list[str], w: int, h: int, ow: int, oh: int, values: list[str]) -> DataFrame:
    """Resize by bilinear sampling at pixel centres, clamped at the edges."""
    at = grid.image_grid(df.sparkSession, ow, oh).withColumns({
        "u": (F.col("x") + 0.5) * (w / ow) - 0.5, "v": (F.col("y") + 0.5) * (h / oh) - 0.5,
    })
    gmap = at.withColumns(grid.tap_coords(F.col("u"), F.col("v"), w, h, False)).select("y", "x", "y0", "x0", "fy", "fx")
    src = grid.quads(df, values, keys, wrap_x=False)
    return src.join(grid.shared_map(gmap, ow * oh), ["y0", "x0"]).select(
        *keys, "y", "x", *[grid.mix(v).alias(v) for v in values]
    )


def model_depth(df: DataFrame, keys: list[str], w: int, h: int, make_model: Callable, batch: int = MICRO_BATCH) -> DataFrame:
    """Run a user's image model: ``make_model()`` is called once per worker and
    returns ``f(images[n, h, w, 3] in 0..1) -> depth[n, h, w]``.

    Images of one size form micro-batches; call it per size for mixed shapes.
    """

    def make_predict():
        model = make_model()

        def predict(flat: np.ndarray) -> np.ndarray:
            n = flat.shape[0]
            out = np.asarray(model(flat.reshape(n, h, w, 3).astype(np.float64) / 255.0))
            return np.maximum(out.reshape(n, h * w), 0.0)

        return predict

    udf = predict_batch_udf(
        make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch,
        input_tensor_shapes=[[h * w * 3]],
    )
    return explode_depth(images(df, keys, w, h).withColumn("depth", udf("image")), keys, w)


def temporal_depth(df: DataFrame, w: int, h: int, make_model: Callable) -> DataFrame:
    """Run a temporal model once per chunk and face, frames in order.

    A group is one chunk of one face, a fixed number of frames. Negative
    output becomes zero.
    """
    seq = images(df, ["clip", "chunk", "face", "f"], w, h)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("f")
        stack = np.stack([np.asarray(i, dtype=np.float64) for i in pdf["image"]]).reshape(-1, h, w, 3) / 255.0
        out = np.maximum(np.asarray(make_model()(stack)).reshape(len(pdf), h * w), 0.0)
        return pdf[["clip", "chunk", "face", "f"]].assign(depth=list(out))

    schema = "clip string, chunk int, face string, f int, depth array<double>"
    done = seq.groupBy("clip", "chunk", "face").applyInPandas(run, schema)
    return explode_depth(done, ["clip", "chunk", "face", "f"], w)


def frame_depth(
    df: DataFrame, w: int, h: int, size: int, estimate: Callable[[DataFrame], DataFrame],
    overlap: float = faces.FACE_OVERLAP, own_faces: DataFrame | None = None,
) -> DataFrame:
    """Whole-frame depth: faces, model, alignment, assembly.

    ``estimate`` maps face pixels (.., face, y, x, r, g, b) to depth. Faces
    that came with the source are used directly. Depth is written to the shared
    folder once: the fit and the assembly read it several times, and a model
    must not run again for that or when an executor is lost.
    """
    rgb = ["r", "g", "b"]
    if overlap > 0:
        src = faces.widen_faces(own_faces, size, rgb, overlap) if own_faces is not None else faces.panorama_to_faces(df, w, h, size, rgb, overlap)
        depth = cut(estimate(src))
        fitted = align.apply_fit(depth, align.fit(align.band_pairs(depth, size, overlap), depth, size, align.MEDIAN_STRIDE))
        return faces.blend_faces(fitted, size, w, h, overlap)
    src = own_faces if own_faces is not None else faces.panorama_to_faces(df, w, h, size, rgb)
    depth = cut(estimate(src))
    fitted = align.apply_fit(depth, align.fit(align.edge_pairs(depth, size), depth, size, align.MEDIAN_STRIDE))
    return faces.faces_to_panorama(fitted, size, w, h, ["d"])


# --- tiles ---------------------------------------------------------------


def tile_spans(size: int, split: int, overlap: float = TILE_OVERLAP) -> list[tuple[int, int, int]]:
    """(tile, start, stop) along one axis; tiles overlap, the last reaches the edge."""
    stride = size // split
    pad = int(stride * overlap)
    spans = []
    for i in range(split):
        stop = size if i == split - 1 else min(size, (i + 1) * stride + pad)
        spans.append((i, max(0, i * stride - pad), stop))
    return spans


def tile_pixels(df: DataFrame, size: int, split: int) -> DataFrame:
    """Each pixel once per tile holding it, as ``ty, tx``.

    The spans are a handful of literals, so the range join is a filter on an
    exploded array and nothing is shuffled.
    """
    def axis(c):
        spans = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("t", "s", "e"), span)]) for span in tile_spans(size, split)])
        return F.transform(F.filter(spans, lambda s: (F.col(c) >= s["s"]) & (F.col(c) < s["e"])), lambda s: s["t"])

    return df.withColumn("ty", F.explode(axis("y"))).withColumn("tx", F.explode(axis("x")))


def tile_weight(size: int, split: int):
    """Feather weight of a pixel in its tile: 1 inside, a cosine ramp towards
    each edge that has a neighbouring tile."""
    pad = int((size // split) * TILE_OVERLAP)
    rise = lambda i: 0.5 - 0.5 * F.cos(math.pi * i / pad)

    def ramp(c, t):
        out = F.when(F.lit(False), F.lit(1.0))
        for tile, start, stop in tile_spans(size, split):
            lead, trail = F.col(c) - start, stop - 1 - F.col(c)
            if stop - start > pad > 0:
                if stop < size:
                    out = out.when((F.col(t) == tile) & (trail < pad), rise(trail))
                if start > 0:
                    out = out.when((F.col(t) == tile) & (lead < pad), rise(lead))
        return out.otherwise(F.lit(1.0))

    return ramp("y", "ty") * ramp("x", "tx")


def merge_tiles(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Scale each tile to the coarse reference ``ref`` and feather them together.

    ``tiles`` rows: keys, ty, tx, y, x, d, ref, wt. The fit is a window over a
    tile, so the tiles' depth is computed once.
    """
    tile = Window.partitionBy(*keys, "ty", "tx")
    top = F.sum(F.col("d") * F.col("ref")).over(tile)
    den = F.sum(F.col("d") * F.col("d")).over(tile)
    fit = F.greatest(F.lit(1.0 / MAX_TILE_SCALE), F.least(F.lit(MAX_TILE_SCALE), F.col("top") / F.col("den")))
    scale = F.when(F.col("den") > 1e-12, fit).otherwise(F.lit(1.0))
    return (
        tiles.withColumns({"top": top, "den": den}).withColumn("s", scale).groupBy(*keys, "y", "x")
        .agg((F.sum(F.col("d") * F.col("s") * F.col("wt")) / F.greatest(F.sum("wt"), F.lit(1e-6))).alias("d"))
    )


def tiled_depth(df: DataFrame, keys: list[str], size: int, split: int, estimate: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """Depth estimated per overlapping tile, aligned to a coarse pass, merged."""
    ref = estimate(df, keys).withColumnRenamed("d", "ref")
    per_tile = estimate(tile_pixels(df, size, split), [*keys, "ty", "tx"])
    both = per_tile.join(ref, [*keys, "y", "x"]).withColumn("wt", tile_weight(size, split))
    return merge_tiles(both, keys)


# --- guided filter -------------------------------------------------------


def box_mean(df: DataFrame, values: list[str], radius: int, w: int, h: int, keys: list[str] = FRAME) -> DataFrame:
    """Mean over a square, mirrored at the borders: halo rows, then one sliding
    window per axis."""
    for axis, n in (("x", w), ("y", h)):
        c, across = F.col(axis), "y" if axis == "x" else "x"
        copies = F.array_compact(F.array(
            c, F.when(c < radius, -1 - c), F.when(c >= n - radius, 2 * n - 1 - c),
        ))
        lane = Window.partitionBy(*keys, across).orderBy(axis).rowsBetween(-radius, radius)
        wide = df.withColumn(axis, F.explode(copies))
        df = wide.withColumns({v: F.avg(v).over(lane) for v in values}).filter((F.col(axis) >= 0) & (F.col(axis) < n))
    return df


def guided_filter(df: DataFrame, w: int, h: int, radius: int = 8, eps: float = 1e-3, keys: list[str] = FRAME) -> DataFrame:
    """Smooth ``d`` along the edges of the colour guide ``r, g, b`` in [0, 1].

    A local linear model ``d ~ a . rgb + c`` per window; the 3x3 systems have a
    closed form, so everything between the two box passes is arithmetic. The
    originals ride along in ``i_*`` columns instead of being joined back.
    """
    rgb = ["r", "g", "b"]
    pairs = [(a, b) for i, a in enumerate(rgb) for b in rgb[i:]]
    base = df.select(*keys, "y", "x", "d", *rgb)
    base = base.withColumns({f"i_{c}": F.col(c) for c in rgb})
    base = base.withColumns({a + b: F.col(a) * F.col(b) for a, b in pairs} | {f"{c}p": F.col(c) * F.col("d") for c in rgb})
    m = box_mean(base, [*rgb, "d", *[a + b for a, b in pairs], *[f"{c}p" for c in rgb]], radius, w, h, keys)
    cov = {a + b: F.col(a + b) - F.col(a) * F.col(b) + (eps if a == b else 0.0) for a, b in pairs}
    m = m.withColumns(cov | {f"{c}p": F.col(f"{c}p") - F.col(c) * F.col("d") for c in rgb})
    rr, rg, rb, gg, gb, bb = (F.col(a + b) for a, b in pairs)
    cof = {"c_rr": gg * bb - gb * gb, "c_rg": rb * gb - rg * bb, "c_rb": rg * gb - rb * gg,
           "c_gg": rr * bb - rb * rb, "c_gb": rg * rb - rr * gb, "c_bb": rr * gg - rg * rg}
    m = m.withColumns(cof)
    det = rr * F.col("c_rr") + rg * F.col("c_rg") + rb * F.col("c_rb")
    m = m.withColumn("det", F.when(F.abs(det) < 1e-12, F.lit(1e-12)).otherwise(det))
    inv = {"r": ("c_rr", "c_rg", "c_rb"), "g": ("c_rg", "c_gg", "c_gb"), "b": ("c_rb", "c_gb", "c_bb")}
    m = m.withColumns({
        f"a_{c}": sum((F.col(k) * F.col(f"{o}p") for k, o in zip(row[1:], rgb[1:])), F.col(row[0]) * F.col("rp")) / F.col("det")
        for c, row in inv.items()
    })
    m = m.withColumn("c0", F.col("d") - (F.col("a_r") * F.col("r") + F.col("a_g") * F.col("g") + F.col("a_b") * F.col("b")))
    out = box_mean(m.select(*keys, "y", "x", *[f"i_{c}" for c in rgb], *[f"a_{c}" for c in rgb], "c0"),
                   [*[f"a_{c}" for c in rgb], "c0"], radius, w, h, keys)
    smooth = F.col("a_r") * F.col("i_r") + F.col("a_g") * F.col("i_g") + F.col("a_b") * F.col("i_b") + F.col("c0")
    return out.select(*keys, "y", "x", smooth.alias("d"))


def smooth_depth(df: DataFrame, w: int, h: int, radius: int = 8, eps: float = 1e-3, keys: list[str] = FRAME) -> DataFrame:
    """Guided filter, clipped to the range the image had before."""
    span = df.groupBy(*keys).agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return ranges.attach(guided_filter(df, w, h, radius, eps, keys), span, keys).select(
        *keys, "y", "x", F.greatest("lo", F.least("hi", "d")).alias("d")
    )
