"""Frame sink: resize each eye, pack, write as blocks, report counts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbframe import FRAME
from orbframe.operators import grid, packing

FRAME_BUCKET = 256


def packed(eyes: DataFrame, w: int, h: int, mode: str = "360", yaw: float = 0.0, eye_w: int | None = None, eye_h: int | None = None) -> DataFrame:
    """Eyes to packed frames. Resizing comes first, so packing never mixes eyes."""
    if eye_w and (eye_w, eye_h) != (w, h):
        eyes = packing.area_resize(eyes, w, h, eye_w, eye_h, ["r", "g", "b"], [*FRAME, "eye"])
        w, h = eye_w, eye_h
    level = {c: F.greatest(F.lit(0), F.least(F.lit(255), F.bround(c).cast("int"))) for c in "rgb"}
    eyes = eyes.withColumns(level).select(*FRAME, "eye", "y", "x", "r", "g", "b")
    return packing.stack_eyes(eyes, h) if mode == "360" else packing.side_by_side(eyes, w, yaw)


def write_blocks(frames: DataFrame, path: str, tile: int = 256, mode: str = "append") -> None:
    """Packed pixels to parquet blocks, partitioned by clip and frame bucket."""
    blocks = grid.pack_blocks(frames, tile).withColumn("bucket", F.floor(F.col("f") / FRAME_BUCKET))
    blocks.write.mode(mode).partitionBy("clip", "bucket").parquet(path)


def block_stream_writer(path: str, tile: int = 256):
    """``foreachBatch`` function; a batch that is run again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        blocks = grid.pack_blocks(batch, tile)
        blocks.write.mode("overwrite").partitionBy("clip").parquet(f"{path}/batch={batch_id}")

    return write


def frames_written(blocks: DataFrame) -> DataFrame:
    """Frames per clip in a block table: the sink's own count."""
    return blocks.select(*FRAME).distinct().groupBy("clip").agg(F.count(F.lit(1)).alias("frames"))
