"""``rawframes``: decoded rgb24 frames of a fixed size, one record each.

    spark.dataSource.register(RawFrames)
    spark.read.format("rawframes").option("width", 64).option("height", 32).load(path)

The file length gives the frame count; a short record at the end is left out.
Each partition is a range of frames and seeks straight to it. Filters on ``f``
shrink the range before any task starts.
"""

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual,
)

SCHEMA = "clip string, f int, data binary"
FRAMES_PER_TASK = 8


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, with or without a scheme, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class FrameRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class RawFrames(DataSource):
    @classmethod
    def name(cls):
        return "rawframes"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return RawFramesReader(self.options)


class RawFramesReader(DataSourceReader):
    def __init__(self, options):
        self.record = int(options["width"]) * int(options["height"]) * 3
        self.per_task = int(options.get("framesPerTask", FRAMES_PER_TASK))
        fs, root = file_system(options["path"])
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.Directory:
            head, here = options["path"].rstrip("/"), fs.get_file_info(pafs.FileSelector(root))
            self.sizes = {f"{head}/{x.base_name}": x.size for x in here if x.is_file and not x.base_name.startswith((".", "_"))}
        else:
            self.sizes = {options["path"]: info.size}
        self.low, self.high = 0, None

    def _below(self, stop):
        self.high = stop if self.high is None else min(self.high, stop)

    def pushFilters(self, filters):
        for flt in filters:
            if getattr(flt, "attribute", None) != ("f",):
                yield flt
            elif isinstance(flt, EqualTo):
                self.low = max(self.low, flt.value)
                self._below(flt.value + 1)
            elif isinstance(flt, GreaterThanOrEqual):
                self.low = max(self.low, flt.value)
            elif isinstance(flt, GreaterThan):
                self.low = max(self.low, flt.value + 1)
            elif isinstance(flt, LessThan):
                self._below(flt.value)
            elif isinstance(flt, LessThanOrEqual):
                self._below(flt.value + 1)
            else:
                yield flt

    def partitions(self):
        parts = []
        for path in sorted(self.sizes):
            count = self.sizes[path] // self.record
            stop = count if self.high is None else min(count, self.high)
            for a in range(self.low, stop, self.per_task):
                parts.append(FrameRange(path, a, min(stop, a + self.per_task)))
        # Spark needs a partition to plan with; an empty range reads nothing.
        return parts or [FrameRange("", 0, 0)]

    def read(self, part):
        if part.start >= part.stop:
            return
        fs, place = file_system(part.path)
        with fs.open_input_file(place) as raw:
            raw.seek(part.start * self.record)
            for f in range(part.start, part.stop):
                yield part.path, f, raw.read(self.record)


def read_raw(spark: SparkSession, path: str, w: int, h: int) -> DataFrame:
    """Raw frames as one binary row per frame."""
    spark.dataSource.register(RawFrames)
    return spark.read.format("rawframes").option("width", w).option("height", h).load(path)


def frame_pixels(frames: DataFrame, w: int) -> DataFrame:
    """Binary frames to pixel rows, decoded in Arrow batches."""

    def run(batches):
        for batch in batches:
            for clip, f, data in zip(batch["clip"].to_pylist(), batch["f"].to_pylist(), batch["data"].to_pylist()):
                rgb = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
                i = np.arange(len(rgb), dtype=np.int32)
                n = len(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([clip] * n, pa.string()), pa.array(np.full(n, f, np.int32)), pa.array(i // w), pa.array(i % w)]
                    + [pa.array(np.ascontiguousarray(rgb[:, k])) for k in range(3)],
                    names=["clip", "f", "y", "x", "r", "g", "b"],
                )

    return frames.mapInArrow(run, "clip string, f int, y int, x int, r int, g int, b int")


def frame_range(frames: DataFrame, start: int = 0, cap: int | None = None) -> DataFrame:
    """Skip ``start`` frames and keep at most ``cap``; reaches the reader."""
    kept = frames.filter(F.col("f") >= start)
    return kept if cap is None else kept.filter(F.col("f") < start + cap)


def frame_at(frames: DataFrame, f: int) -> DataFrame:
    """One frame by absolute index. Past the end the result has no rows."""
    if f < 0:
        raise ValueError(f"frame {f} does not exist")
    return frames.filter(F.col("f") == f)


def thumbnail_frames(catalogue: DataFrame, at: str = "wanted", fps: str = "fps", count: str = "frame_count") -> DataFrame:
    """Frame a thumbnail of time ``wanted / fps`` shows; frame 0 past the end."""
    shown = F.when((F.col(at) >= 0) & (F.col(at) < F.col(count)), F.col(at)).otherwise(F.lit(0))
    return catalogue.withColumn("shown", F.when(F.col(fps) > 0, shown).otherwise(F.lit(0)))
