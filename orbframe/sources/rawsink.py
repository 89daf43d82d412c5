"""``rawframes`` as a sink: frames of a fixed size written as raw files, or none of them.

    spark.dataSource.register(RawFrameSink)
    frames.write.format("rawframes_sink").option("width", 64).option("height", 32).save(path)

Each task writes the frames of its partition to hidden part files, one for each clip and
run of frames, and hands their names to the driver in one commit message. The commit gives
all files their names at once; an abort takes away what tasks have written. Paths may be
those of any file system that Arrow knows.
"""

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from orbframe.sources.rawframes import file_system

FRAME_SCHEMA = "clip string, f int, data binary"
#: The file that says a set of part files is whole.
MANIFEST = "_frames"


class Part(WriterCommitMessage):
    """What one task has written: rows of name, clip, first frame, frames."""

    def __init__(self, files: list[tuple[str, str, int, int]]):
        self.files = files


class RawFrameSink(DataSource):
    @classmethod
    def name(cls):
        return "rawframes_sink"

    def schema(self):
        return FRAME_SCHEMA

    def writer(self, schema, overwrite):
        return RawFrameWriter(self.options, overwrite)

    def reader(self, schema):
        return RawFrameParts(self.options)


class RawFrameWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.record = int(options["width"]) * int(options["height"]) * 3

    def write(self, iterator):
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        files, out, clip, last = [], None, None, None
        try:
            for batch in iterator:
                for c, f, data in zip(batch["clip"].to_pylist(), batch["f"].to_pylist(), batch["data"].to_pylist()):
                    if len(data) != self.record:
                        raise ValueError(f"frame {f} of {c} has {len(data)} bytes, not {self.record}")
                    if out is None or c != clip or f != last + 1:
                        if out is not None:
                            out.close()
                        files.append([f".part-{uuid.uuid4().hex}.rgb", c, f, 0])
                        out = fs.open_output_stream(f"{root}/{files[-1][0]}")
                    out.write(data)
                    files[-1][3] += 1
                    clip, last = c, f
        except BaseException:
            if out is not None:
                out.close()
            self.abort([Part([tuple(x) for x in files])])
            raise
        if out is not None:
            out.close()
        return Part([tuple(x) for x in files])

    def commit(self, messages):
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        old = [] if self.overwrite else manifest(self.path)
        new = [x for m in messages if m is not None for x in m.files]
        # the manifest is the commit: until it is there, readers see none of the new files
        with fs.open_output_stream(f"{root}/.{MANIFEST}") as out:
            out.write("\n".join(json.dumps(x) for x in [*old, *new]).encode())
        gone = [x[0] for x in manifest(self.path)] if self.overwrite else []
        fs.move(f"{root}/.{MANIFEST}", f"{root}/{MANIFEST}")
        for name in gone:
            fs.delete_file(f"{root}/{name}")

    def abort(self, messages):
        fs, root = file_system(self.path)
        for m in messages:
            for name, *_ in m.files if m is not None else []:
                if fs.get_file_info(f"{root}/{name}").type != pafs.FileType.NotFound:
                    fs.delete_file(f"{root}/{name}")


def manifest(path: str) -> list[tuple]:
    """Name, clip, first frame and frames of the files that have been committed."""
    fs, root = file_system(path.rstrip("/"))
    if fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.NotFound:
        return []
    with fs.open_input_stream(f"{root}/{MANIFEST}") as src:
        return [tuple(json.loads(x)) for x in src.read().decode().split("\n") if x]


class Piece(InputPartition):
    def __init__(self, name: str, clip: str, first: int, frames: int):
        self.name, self.clip, self.first, self.frames = name, clip, first, frames


class RawFrameParts(DataSourceReader):
    """Reads committed files, one task a file."""

    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.record = int(options["width"]) * int(options["height"]) * 3

    def partitions(self):
        return [Piece(*x) for x in manifest(self.path)] or [Piece("", "", 0, 0)]

    def read(self, part):
        if not part.frames:
            return
        fs, root = file_system(self.path)
        with fs.open_input_stream(f"{root}/{part.name}") as src:
            for f in range(part.first, part.first + part.frames):
                yield part.clip, f, src.read(self.record)


def frames_of(pixels: DataFrame, w: int, h: int) -> DataFrame:
    """Pixels to one binary record a frame, in order of clip and frame; a missing pixel is black."""

    def run(key, table):
        img = np.zeros((h, w, 3), np.uint8)
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        for k, c in enumerate("rgb"):
            img[y, x, k] = np.clip(np.round(table[c].to_numpy().astype(float)), 0, 255)
        return pa.table({"clip": [key[0].as_py()], "f": pa.array([key[1].as_py()], pa.int32()), "data": [img.tobytes()]})

    return pixels.select("clip", "f", "y", "x", "r", "g", "b").groupBy("clip", "f").applyInArrow(run, FRAME_SCHEMA)


def write_raw(pixels: DataFrame, path: str, w: int, h: int, mode: str = "append") -> None:
    """Write frames so that a clip's run of frames is one file where it can be."""
    pixels.sparkSession.dataSource.register(RawFrameSink)
    frames = frames_of(pixels, w, h).repartitionByRange("clip", "f").sortWithinPartitions("clip", "f")
    frames.write.format("rawframes_sink").option("width", w).option("height", h).mode(mode).save(path)


def read_written(spark, path: str, w: int, h: int) -> DataFrame:
    spark.dataSource.register(RawFrameSink)
    return spark.read.format("rawframes_sink").option("width", w).option("height", h).load(path)
