"""Chunk windows, overlap blending, median lock and cross-frame filling."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbframe.operators import ranges

# Stabiliser band and cap, chunk length and overlap, fill spread.
TAU, CAP, CHUNK, OVERLAP, MAX_STD = 0.02, 0.9, 8, 2, 25.0


def clip_lengths(df: DataFrame) -> DataFrame:
    """Frames per clip, counted from distinct frame rows."""
    return df.select("clip", "f").distinct().groupBy("clip").agg(F.count(F.lit(1)).alias("n"))


def chunk_windows(df: DataFrame, lengths: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Assign every row to each chunk its frame takes part in.

    Adds ``chunk``, ``pos`` (place in the chunk), ``len`` (chunk length) and
    ``emit`` (true in the one chunk that delivers the frame). Frames count
    from 0 within a clip; the last chunk holds what is left, including the
    frames held back for it.
    """
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the chunk")
    step = size - overlap
    n, f = F.col("n"), F.col("f")
    full = F.when(n >= size, F.floor((n - size) / step) + 1).otherwise(F.lit(0))
    last = F.when(n - full * step > 0, full).otherwise(full - 1)
    first = F.greatest(F.lit(0), F.floor((f - size) / step) + 1)
    ids = F.sequence(first.cast("int"), F.least(F.floor(f / step), last).cast("int"))
    length = F.least(F.lit(size), n - F.col("chunk") * step)
    pos = f - F.col("chunk") * step
    return (
        df.join(lengths, "clip")
        .withColumns({"_full": full})
        .withColumn("chunk", F.explode(ids))
        .withColumns({"pos": pos.cast("int"), "len": length.cast("int")})
        .withColumn("emit", (F.col("chunk") >= F.col("_full")) | (F.col("pos") < step))
        .drop("n", "_full")
    )


def blend_overlap(df: DataFrame, overlap: int = OVERLAP, value: str = "d", carry: list[str] = []) -> DataFrame:
    """One value per pixel and frame from its estimates in successive chunks.

    Each later chunk takes over by a linear ramp across its first ``overlap``
    frames. The few estimates of a pixel (at most size / step) are folded in
    chunk order, so blends chain when the overlap exceeds the step. Columns in
    ``carry`` are the same in every estimate and come along.
    """
    start = F.struct(F.lit(None).cast("double").alias("v"), F.lit(0).alias("chunk"))

    def take(acc, e):
        wt = (e["pos"] + 1) / F.lit(overlap + 1.0)
        mixed = F.when(acc["v"].isNull() | (e["pos"] >= overlap), e["v"]).otherwise((1.0 - wt) * acc["v"] + wt * e["v"])
        return F.struct(mixed.alias("v"), e["chunk"].alias("chunk"))

    parts = F.array_sort(F.collect_list(F.struct("chunk", "pos", F.col(value).alias("v"))))
    return (
        df.groupBy("clip", "f", "y", "x").agg(F.aggregate(parts, start, take).alias("m"), *[F.any_value(c).alias(c) for c in carry])
        .select("clip", "f", "y", "x", F.col("m.chunk").alias("chunk"), F.col("m.v").alias(value), *carry)
    )


def chunk_range(emitted: DataFrame, stride: int = ranges.STRIDE) -> DataFrame:
    """One shared range for the frames a chunk delivers."""
    return ranges.robust_range(ranges.strided(emitted, stride), ["clip", "chunk"])


def chunk_normalise(emitted: DataFrame, stride: int = ranges.STRIDE) -> DataFrame:
    return ranges.normalise(emitted, chunk_range(emitted, stride), ["clip", "chunk"])


def median_lock(df: DataFrame, tau: float = TAU, carry: list[str] = []) -> DataFrame:
    """Blend pixels that barely vary over a chunk towards their chunk median.

    One shuffle by pixel track within a chunk; the track's few values travel
    in an array next to their median and spread, so nothing is joined back.
    Chunks delivering fewer than three frames stay as they are.
    """
    lock = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (2.0 * tau - F.col("sd")) / tau))
    moved = lambda e: F.struct(
        e["f"].alias("f"),
        F.when(F.col("n") >= 3, e["d"] + lock * (F.col("med") - e["d"])).otherwise(e["d"]).alias("d"),
        *[e[c].alias(c) for c in carry],
    )
    return (
        df.groupBy("clip", "chunk", "y", "x")
        .agg(
            F.collect_list(F.struct("f", "d", *carry)).alias("track"), F.count(F.lit(1)).alias("n"),
            F.stddev_pop("d").alias("sd"), F.median("d").alias("med"),
        )
        .select("clip", "chunk", "y", "x", F.inline(F.transform("track", moved)))
    )


def temporal_fill(df: DataFrame, max_std: float = MAX_STD) -> DataFrame:
    """Fill holes from the same pixel in other frames of the chunk.

    Only pixels that are a hole in some frame are gathered; their medians are
    joined back. One witness is accepted, several only when they agree.
    """
    track = ["clip", "chunk", "y", "x"]
    need = df.filter("hole").select(*track).distinct()
    seen = lambda c: F.when(~F.col("hole"), F.col(c))
    count = F.count(F.when(~F.col("hole"), 1))
    stats = (
        df.join(need, track, "left_semi").groupBy(*track)
        .agg(
            count.alias("n"), *[F.median(seen(c)).alias(f"m_{c}") for c in "rgb"],
            ((F.stddev_pop(seen("r")) + F.stddev_pop(seen("g")) + F.stddev_pop(seen("b"))) / 3.0).alias("sd"),
        )
        .filter((F.col("n") == 1) | ((F.col("n") >= 2) & (F.col("sd") <= max_std)))
        .select(*track, *[F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col(f"m_{c}")))).alias(f"m_{c}") for c in "rgb"])
    )
    fill = F.col("hole") & F.col("m_r").isNotNull()
    return (
        df.join(stats, track, "left").withColumn("_fill", fill)
        .withColumns({c: F.when(F.col("_fill"), F.col(f"m_{c}")).otherwise(F.col(c)).cast(df.schema[c].dataType) for c in "rgb"})
        .withColumn("hole", F.col("hole") & ~F.col("_fill"))
        .select(*df.columns)
    )


def pulled(d, prev, tau: float, cap: float):
    """One stabiliser step on arrays: hold what is still, release what moves."""
    w = cap * np.clip((2.0 * tau - np.abs(d - prev)) / tau, 0.0, 1.0)
    return d + w * (prev - d)


def stabilise(df: DataFrame, tau: float = TAU, cap: float = CAP) -> DataFrame:
    """Causal stabiliser: each pixel leans on its own previous output.

    The step is not linear, so a pixel's frames stay in order. Scanlines are
    spread over the cluster by (clip, y) and read as a sorted stream; only one
    scanline of state is held, however long the clip. Other columns stay.
    """
    if tau <= 0:
        return df
    order = ["clip", "y", "f", "x"]
    rows = df.repartition("clip", "y").sortWithinPartitions(*order)

    def finish(lines, state):
        out = []
        for (clip, y, f), line in lines:
            d, last = line["d"].to_numpy(), state.get((clip, y))
            if last is not None and len(last) == len(d):
                d = pulled(d, last, tau, cap)
            state.clear()
            state[(clip, y)] = d
            out.append(line.assign(d=d))
        return pd.concat(out)

    def run(batches):
        state, rest = {}, None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            head = batch.iloc[-1][["clip", "y", "f"]]
            tail = ((batch[["clip", "y", "f"]] == head).all(axis=1)).to_numpy()
            rest = batch[tail]
            whole = batch[~tail]
            if len(whole):
                yield finish(whole.groupby(["clip", "y", "f"], sort=False), state)
        if rest is not None and len(rest):
            yield finish(rest.groupby(["clip", "y", "f"], sort=False), state)

    return rows.mapInPandas(run, rows.schema)
