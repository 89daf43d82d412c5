"""Whole rendering paths composed from the operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbframe import FRAME
from orbframe.operators import components, fill, ranges, temporal, warp
from orbframe.session import cut

AT = [*FRAME, "y", "x"]


def background_fill(eye: DataFrame, w: int, strength: float) -> DataFrame:
    """Grow the holes and continue the background into them."""
    return fill.directional(fill.dilate(eye), w, 1.0 if strength >= 0 else -1.0)


def fill_holes(eye: DataFrame, depth: DataFrame, w: int, h: int, strength: float, mode: str = "simple", make_model=None) -> DataFrame:
    """Directional fill, then what it cannot reach.

    ``depth`` is the normalised depth before softening. A hole in a row without any valid
    pixel is left over; its frame takes the residual path. The mask grows to the ring that
    shows a depth contrast, near components touching the holes join it, and what lies under
    it is painted from the pixels outside: by the block pyramid (``simple``) or, component
    by component, by the user's model (``learned``). Only what was left over takes the
    painted colours. A frame in which only grown pixels are left stays as it is. The
    directional result, and of the frames with leftovers the pixels, are written once
    because several steps read them.
    """
    if mode not in ("simple", "learned"):
        raise ValueError(f"fill mode {mode!r} is not known")
    done = cut(background_fill(eye, w, strength).withColumn("left", F.col("hole_d") & ~F.col("done")))
    frames = done.filter(F.col("left") & F.col("hole")).select(*FRAME).distinct()
    # Sorted joins: written pixels take so few bytes that by its estimates the planner would broadcast them.
    open_frames = cut(done.join(frames.hint("merge"), FRAME, "left_semi").join(depth.select(*AT, "d").hint("merge"), AT).withColumn("hole", F.col("hole") & ~F.col("done")))
    out = [*AT, "r", "g", "b", "hole", "hole_d", "done"]
    if open_frames.isEmpty():
        return done.select(*out)
    split = fill.ring_threshold(open_frames, grown="left")
    near = fill.search_mask(open_frames, split, "mask", grown="left").withColumn("near", F.coalesce(~F.col("hole") & (F.col("d") > F.col("threshold")), F.lit(False)))
    near = cut(near)  # four steps read it
    # Without anything far there is nothing better to read from.
    usable = near.groupBy(*FRAME).agg(F.bool_or(~F.col("hole") & ~F.col("near")).alias("any_far")).filter("any_far")
    blocked = components.touching_components(near.join(usable.hint("merge"), FRAME, "left_semi")).withColumn("blocked", F.lit(True))
    paint = near.join(blocked.hint("merge"), AT, "left").withColumn("paint", F.col("mask") | F.coalesce("blocked", F.lit(False)))
    base = paint.select(*AT, "r", "g", "b", "paint")
    painted = components.learned_fill(base, w, h, make_model, "paint") if mode == "learned" else fill.pyramid(base, max(w, h).bit_length(), "paint")
    merged = done.join(painted.select(*AT, F.struct("r", "g", "b").alias("filled")).hint("merge"), AT, "left")
    return fill.composite(merged, "left").select(*out)


def frame_path(px: DataFrame, w: int, h: int, strength: float, stride: int = ranges.STRIDE, tau: float = temporal.TAU, soften: int = 0, gradient_limit: float = 0.0) -> DataFrame:
    """Frame by frame: moving range, scale, stabilise, condition, synthesise, fill.

    The stabiliser compares frames, so it comes after scaling.
    """
    scaled = ranges.moving_normalise(px.select(*AT, "d", "r", "g", "b"), stride)
    steady = temporal.stabilise(scaled, tau)
    steady = cut(steady)
    eye = warp.synthesise(warp.condition(steady, w, strength, soften, gradient_limit), w, h, strength)
    return fill_holes(eye, steady, w, h, strength)


def chunk_path(estimates: DataFrame, w: int, h: int, strength: float, overlap: int, stride: int = ranges.STRIDE, tau: float = temporal.TAU,
               max_std: float = temporal.MAX_STD, soften: int = 0, gradient_limit: float = 0.0) -> DataFrame:
    """Chunk by chunk: blend, shared range, median lock, synthesise, fill over
    time, then in space.

    ``estimates``: clip, chunk, pos, f, y, x, d, r, g, b. Only delivered frames
    are scaled, so held-back maps blend unscaled. The unfilled eye is written
    once: filling over time reads it three times.
    """
    rgb = ["r", "g", "b"]
    scaled = temporal.chunk_normalise(temporal.blend_overlap(estimates, overlap, carry=rgb), stride)
    locked = cut(temporal.median_lock(scaled, tau, carry=rgb))
    ready = warp.condition(locked, w, strength, soften, gradient_limit)
    eye = cut(warp.synthesise(ready, w, h, strength, carry=["chunk"]))
    return fill_holes(temporal.temporal_fill(eye, max_std).drop("chunk"), locked, w, h, strength)


def preview(px: DataFrame, f: int, w: int, h: int, strength: float) -> DataFrame:
    """One frame by index, scaled by its own full range; a filter in front of
    the same operators, so only that frame is read."""
    one = px.filter(F.col("f") == f)
    ready = cut(ranges.normalise(one, ranges.frame_range(one)))
    return fill_holes(warp.synthesise(ready, w, h, strength), ready, w, h, strength)
