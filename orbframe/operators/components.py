"""Connected components of masks, their boxes, and fill crops."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbframe import FRAME
from orbframe.operators import faces, fill

# Crop margin and growth, padding and size limit of learned fills.
MARGIN, GROW, TRIES, PAD, MAX_CROP = 48, 4, 4, 64, 1024


def _label_frame(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Smallest run number reachable from each run of one frame."""
    pdf = pdf.sort_values(["y", "x0"], ignore_index=True)
    y, x0, x1 = (pdf[c].to_numpy() for c in ("y", "x0", "x1"))
    # Runs sort by row, so the runs of the next row that touch run i are a
    # contiguous slice found by two binary searches.
    width = int(x1.max()) + 3
    start, stop = y * width + x0, y * width + x1
    lo = np.searchsorted(stop, (y + 1) * width + x0 - 1)
    hi = np.searchsorted(start, (y + 1) * width + x1 + 1, side="right")
    count = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(pdf)), count)
    b = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    label = np.arange(len(pdf))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        np.minimum.at(low, label, low)
        low = low[low]
        if (low == label).all():
            break
        label = low
    return pdf.assign(clip=key[0], f=key[1], label=(y * 1_000_000 + x0)[label].astype("int64"))[
        ["clip", "f", "y", "x0", "x1", "label"]
    ]


def components(df: DataFrame, mask: str = "hole") -> DataFrame:
    """8-connected components as labelled runs: ``(frame, y, x0, x1, label)``.

    Runs, not pixels, are labelled; a frame's runs are bounded by its size and
    every frame is labelled on its own. The label is row * 10^6 + column of
    the component's first run.
    """
    schema = "clip string, f int, y int, x0 int, x1 int, label bigint"
    return faces.mask_runs(df, mask).groupBy(*FRAME).applyInPandas(_label_frame, schema)


def component_boxes(labelled: DataFrame) -> DataFrame:
    """Bounding box and area per component; stops are exclusive."""
    return labelled.groupBy(*FRAME, "label").agg(
        F.min("x0").alias("x0"), F.min("y").alias("y0"), (F.max("x1") + 1).alias("x1"), (F.max("y") + 1).alias("y1"),
        F.sum(F.col("x1") - F.col("x0") + 1).alias("area"),
    )


def label_pixels(labelled: DataFrame) -> DataFrame:
    """Labelled runs back to pixels."""
    return labelled.select(*FRAME, "y", F.explode(F.sequence("x0", "x1")).alias("x"), "label")


def touching_components(df: DataFrame, hole: str = "hole", near: str = "near", k: int = fill.DILATE) -> DataFrame:
    """Pixels of near components that touch the widened hole: not to be read
    from when the hole is filled."""
    wide = fill.dilate(df, k + 4, hole, "_wide")
    labelled = label_pixels(components(df, near))
    touched = labelled.join(wide.filter("_wide").hint("merge"), [*FRAME, "y", "x"], "left_semi").select(*FRAME, "label").distinct()
    return labelled.join(touched.hint("merge"), [*FRAME, "label"], "left_semi").select(*FRAME, "y", "x")


def _merge_frame(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Union boxes of one frame until none overlap.

    One sweep from left to right per round: a box only meets those still open
    at its left edge.
    """
    box = [tuple(b) for b in pdf[["x0", "y0", "x1", "y1"]].to_numpy().tolist()]
    while True:
        closed, live = [], []
        for b in sorted(box):
            closed += [k for k in live if k[2] <= b[0]]
            live = [k for k in live if k[2] > b[0]]
            met = [k for k in live if b[0] < k[2] and k[0] < b[2] and b[1] < k[3] and k[1] < b[3]]
            if met:
                live = [k for k in live if k not in met]
                group = [b, *met]
                b = (*(min(k[i] for k in group) for i in (0, 1)), *(max(k[i] for k in group) for i in (2, 3)))
            live.append(b)
        done = closed + live
        if len(done) == len(box):
            return pd.DataFrame(done, columns=["x0", "y0", "x1", "y1"]).assign(clip=key[0], f=key[1])[
                ["clip", "f", "x0", "y0", "x1", "y1"]
            ]
        box = done


def hole_boxes(boxes: DataFrame, w: int, h: int, paint: DataFrame | None = None, margin: int = MARGIN) -> DataFrame:
    """Crops to fill: boxes with a margin, merged until disjoint per frame.

    A margin grows fourfold, up to three times, while its crop is painted all
    over (``paint``: pixels of the paint mask), so every crop has something to
    draw from. When the crops of a frame cover more than half of it, the whole
    frame is one crop.
    """
    def grown(m):
        return {
            "cx0": F.greatest(F.lit(0), F.col("x0") - m), "cy0": F.greatest(F.lit(0), F.col("y0") - m),
            "cx1": F.least(F.lit(w), F.col("x1") + m), "cy1": F.least(F.lit(h), F.col("y1") + m),
        }

    sized = boxes.withColumn("m", F.lit(margin))
    if paint is not None:
        sized = sized.drop("m").join(_drawable_margins(boxes, paint, w, h, margin), [*FRAME, "label"])
    crops = sized.withColumns(grown(F.col("m"))).select(
        *FRAME, *[F.col(f"c{c}").alias(c) for c in ("x0", "y0", "x1", "y1")]
    )
    merged = crops.groupBy(*FRAME).applyInPandas(_merge_frame, "clip string, f int, x0 int, y0 int, x1 int, y1 int")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    whole = F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(w).alias("x1"), F.lit(h).alias("y1"))
    return (
        merged.groupBy(*FRAME).agg(F.sum(area).alias("covered"), F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("b"))
        .select(*FRAME, F.inline(F.when(F.col("covered") > 0.5 * w * h, F.array(whole)).otherwise(F.col("b"))))
    )


def _drawable_margins(boxes: DataFrame, paint: DataFrame, w: int, h: int, margin: int) -> DataFrame:
    """Smallest margin whose crop has an unpainted pixel, per component.

    Painted pixels are counted through per-row prefix sums: a crop looks up two
    entries per row instead of meeting every pixel.
    """
    tries = [margin * GROW**i for i in range(TRIES)]
    rows = paint.select(*FRAME, "y", "x").distinct().groupBy(*FRAME, "y").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    crop = boxes.withColumn("m", F.explode(F.array(*[F.lit(m) for m in tries]))).withColumns({
        "a0": F.greatest(F.lit(0), F.col("x0") - F.col("m")), "b0": F.greatest(F.lit(0), F.col("y0") - F.col("m")),
        "a1": F.least(F.lit(w), F.col("x1") + F.col("m")), "b1": F.least(F.lit(h), F.col("y1") + F.col("m")),
    })
    lines = crop.withColumn("y", F.explode(F.sequence("b0", F.col("b1") - 1)))
    inside = F.size(F.filter("xs", lambda x: (x >= F.col("a0")) & (x < F.col("a1"))))
    painted = (
        lines.join(rows, [*FRAME, "y"], "left")
        .groupBy(*FRAME, "label", "m", "a0", "b0", "a1", "b1").agg(F.sum(F.coalesce(inside, F.lit(0))).alias("painted"))
    )
    free = F.col("painted") < (F.col("a1") - F.col("a0")) * (F.col("b1") - F.col("b0"))
    return painted.groupBy(*FRAME, "label").agg(
        F.coalesce(F.min(F.when(free, F.col("m"))), F.lit(tries[-1])).alias("m")
    )


def learned_fill(df: DataFrame, w: int, h: int, make_model: Callable, mask: str = "hole", pad: int = PAD, max_crop: int = MAX_CROP) -> DataFrame:
    """Fill every mask component with a user's model, one crop per component.

    ``make_model()`` returns ``f(image[h, w, 3], mask[h, w]) -> image``; a crop
    is at most ``max_crop`` on a side. Larger components are filled from the
    block pyramid instead. Only masked pixels change.
    """
    labelled = components(df, mask)
    boxes = component_boxes(labelled).select(
        *FRAME, "label", F.greatest(F.lit(0), F.col("x0") - pad).alias("x0"), F.greatest(F.lit(0), F.col("y0") - pad).alias("y0"),
        F.least(F.lit(w), F.col("x1") + pad).alias("x1"), F.least(F.lit(h), F.col("y1") + pad).alias("y1"),
    ).filter((F.col("x1") - F.col("x0") <= max_crop) & (F.col("y1") - F.col("y0") <= max_crop))
    lines = boxes.withColumn("y", F.explode(F.sequence("y0", F.col("y1") - 1)))
    rows = df.groupBy(*FRAME, "y").agg(F.array_sort(F.collect_list(F.struct("x", "r", "g", "b", F.col(mask).alias("m")))).alias("px"))
    cut = F.slice("px", F.col("x0") + 1, F.col("x1") - F.col("x0"))
    crops = (
        lines.join(rows.hint("merge"), [*FRAME, "y"]).groupBy(*FRAME, "label", "x0", "y0", "x1", "y1")
        .agg(F.array_sort(F.collect_list(F.struct("y", cut.alias("px")))).alias("lines"))
        .withColumn("px", F.flatten(F.transform("lines", lambda l: l["px"])))
        .select(*FRAME, "label", "x0", "y0", (F.col("x1") - F.col("x0")).alias("cw"), (F.col("y1") - F.col("y0")).alias("ch"),
                *[F.col("px")[c].cast("array<double>").alias(c) for c in "rgb"], F.col("px")["m"].alias("m"))
    )

    def run(batches):
        model = make_model()
        for pdf in batches:
            done = []
            for c in pdf.itertuples():
                shape = (c.ch, c.cw)
                img = np.stack([np.asarray(v).reshape(shape) for v in (c.r, c.g, c.b)], axis=-1)
                out = np.asarray(model(img, np.asarray(c.m).reshape(shape)), dtype=float)
                done.append([out[..., k].ravel() for k in range(3)])
            yield pdf[["clip", "f", "label", "x0", "y0", "cw"]].assign(r=[d[0] for d in done], g=[d[1] for d in done], b=[d[2] for d in done])

    filled = crops.mapInPandas(run, "clip string, f int, label bigint, x0 int, y0 int, cw int, r array<double>, g array<double>, b array<double>")
    at = F.transform("r", lambda v, i: F.struct(
        (F.col("y0") + (i / F.col("cw")).cast("int")).alias("y"), (F.col("x0") + i % F.col("cw")).alias("x"),
        F.struct(v.alias("r"), F.get(F.col("g"), i).alias("g"), F.get(F.col("b"), i).alias("b")).alias("filled")))
    px = filled.select(*FRAME, "label", F.inline(at)).join(label_pixels(labelled).hint("merge"), [*FRAME, "label", "y", "x"])
    base = fill.pyramid(df, max(w, h).bit_length(), mask)
    out = {c: F.when(F.col(mask), F.coalesce(f"filled.{c}", c)).otherwise(F.col(c)) for c in "rgb"}
    return base.join(px.drop("label").hint("merge"), [*FRAME, "y", "x"], "left").withColumns(out).drop("filled")
