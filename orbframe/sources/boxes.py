"""MP4 box inventory and what it says about sphere, stereo and sound.

Spark spreads the files; each is opened by the task that lists it and only
the movie box is read, wherever in the file it lies. A file that is cut short
keeps the boxes before the cut; a ``corrupt`` row says where it is.
"""

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbframe.functions import media
from orbframe.session import cut

SCHEMA = "path string, pos bigint, type string, size bigint, header int, path_in_file array<string>, track bigint, body binary, handler string"
NAMES = [c.split(" ")[0] for c in SCHEMA.split(", ")]
# Boxes with children, bytes before the children of a sample
# entry by handler, and the identifier of version 1 sphere tags.
CONTAINERS = {"moov", "trak", "mdia", "minf", "stbl"}
ENTRY_FIELDS = {"vide": 86, "soun": 36}
SPHERE_UUID = bytes.fromhex("ffcc8263f8554a938814587a02521fdd")
# Small boxes whose content later columns decode.
BODY_BYTES = {"uuid": 16, "hdlr": 12, "SA3D": 12, "st3d": 5, "equi": 20, "stsd": 8}

_HEAD = struct.Struct(">I4s").unpack


class CorruptBox(ValueError):
    pass


def _siblings(read: Callable[[int, int], bytes], start: int, end: int) -> Iterator[tuple[int, str, int, int]]:
    """(position, type, size, header) of boxes side by side; ``read(position, length)`` gives bytes."""
    while start + 8 <= end:
        head = read(start, 16)
        (size, kind), header = _HEAD(head[:8]), 8
        if size == 1 and len(head) == 16:
            size, header = int.from_bytes(head[8:], "big"), 16
        elif size == 0:
            size = end - start
        if size < header or start + size > end:
            raise CorruptBox(f"corrupt box at {start}")
        yield start, kind.decode("latin-1"), size, header
        start += size


def _tree(read, start: int, end: int, above: tuple, track, rows: list) -> None:
    """Depth first over containers; each track also adds its sample entry's
    children, found once the track's handler is known."""
    while start + 8 <= end:  # as _siblings, written out: most boxes come by here
        head = read(start, 16)
        size, name = _HEAD(head[:8])
        header = 8
        if size == 1 and len(head) == 16:
            size, header = int.from_bytes(head[8:], "big"), 16
        elif size == 0:
            size = end - start
        stop = start + size
        if size < header or stop > end:
            raise CorruptBox(f"corrupt box at {start}")
        kind = name.decode("latin-1")
        here = start if kind == "trak" else track
        if kind in CONTAINERS:
            rows.append((start, kind, size, header, above, here, b"", None))
            first = len(rows)
            _tree(read, start + header, stop, (*above, kind), here, rows)
            if kind == "trak":
                rows += _sample_entry(read, rows[first:], here)
        elif kind in BODY_BYTES:
            rows.append((start, kind, size, header, above, here, read(start + header, min(size - header, BODY_BYTES[kind])), None))
        else:
            rows.append((start, kind, size, header, above, here, b"", None))
        start = stop


def _sample_entry(read, boxes: list, track) -> list[tuple]:
    handler = next((b[6][8:12].decode("latin-1") for b in boxes if b[1] == "hdlr"), None)
    table = next((b for b in boxes if b[1] == "stsd"), None)
    skip = ENTRY_FIELDS.get(handler)
    if table is None or skip is None:
        return []
    first = table[0] + table[3] + 8
    if first + 8 > table[0] + table[2]:
        return []
    size, kind = _HEAD(read(first, 8))
    above = (*table[4], "stsd", kind.decode("latin-1"))
    if size < skip:
        return []
    children: list[tuple] = []
    try:
        _nested(read, first + skip, first + size, above, track, handler, children)
    except CorruptBox:
        return []
    return children


def _nested(read, start, end, above, track, handler, rows: list) -> None:
    for pos, kind, size, header in _siblings(read, start, end):
        rows.append((pos, kind, size, header, above, track, read(pos + header, min(size - header, BODY_BYTES.get(kind, 0))), handler))
        if kind in ("sv3d", "proj"):
            _nested(read, pos + header, pos + size, (*above, kind), track, handler, rows)


def _inventory(read, length: int) -> list[tuple]:
    """All boxes of one file. Where boxes end in a ``corrupt`` one, those before it count;
    of a movie box that is broken inside, nothing below it does."""
    rows, at = [], 0
    try:
        for pos, kind, size, header in _siblings(read, 0, length):
            at, above = pos + size, len(rows)
            try:
                _tree(read, pos, at, (), None, rows)
            except (CorruptBox, struct.error):
                rows[above:] = [(pos, kind, size, header, (), None, b"", None), (pos + header, "corrupt", size - header, 0, (kind,), None, b"", None)]
    except (CorruptBox, struct.error):
        rows.append((at, "corrupt", length - at, 0, (), None, b"", None))
    return rows


def _table(paths: pa.Array, found: list[list[tuple]]) -> pa.RecordBatch:
    """The boxes of each file as one batch. The few chains of containers are made once and taken by number."""
    rows = [r for some in found for r in some]
    pos, kind, size, header, above, track, body, handler = zip(*rows) if rows else [()] * 8
    chains: dict[tuple, int] = {}
    at = pa.array([chains.setdefault(a, len(chains)) for a in above], pa.int32())
    file = np.repeat(np.arange(len(found)), [len(some) for some in found])
    return pa.record_batch([
        paths.take(pa.array(file, pa.int32())), pa.array(pos, pa.int64()), pa.array(kind, pa.string()), pa.array(size, pa.int64()), pa.array(header, pa.int32()),
        pa.array([list(c) for c in chains], pa.list_(pa.string())).take(at), pa.array(track, pa.int64()), pa.array(body, pa.binary()), pa.array(handler, pa.string()),
    ], names=NAMES)


def boxes_of_files(files: DataFrame) -> DataFrame:
    """Boxes of files that tasks can open; ``files``: path, length. Only box
    headers and small tag boxes are read."""

    def inventory(path, length):
        if "://" in path and not path.startswith("file:"):
            store, path = fs.FileSystem.from_uri(path)
        else:
            store, path = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
        with store.open_input_file(path) as src:

            def read(at, n):
                src.seek(at)
                return src.read(n)

            return _inventory(read, length)

    def run(batches):
        for b in batches:
            yield _table(b["path"], [inventory(p, n) for p, n in zip(b["path"].to_pylist(), b["length"].to_pylist())])

    return files.select("path", "length").mapInArrow(run, SCHEMA)


def boxes_of_content(files: DataFrame) -> DataFrame:
    """Boxes of byte strings; ``files``: path, content."""

    def inventory(content):
        return _inventory(lambda at, n: content[at:at + n], len(content))

    def run(batches):
        for b in batches:
            yield _table(b["path"], [inventory(c) for c in b["content"].to_pylist()])

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def be_uint(body: Column, start: int, length: int) -> Column:
    """Big-endian number from bytes ``start`` .. of a binary column."""
    return F.conv(F.hex(F.substring(body, start + 1, length)), 16, 10).cast("bigint")


def _is_uuid() -> Column:
    """A version 1 tag: only inside the movie box."""
    return (F.col("type") == "uuid") & (F.col("body") == F.lit(SPHERE_UUID)) & F.get("path_in_file", F.lit(0)).eqNullSafe("moov")


def _is_entry(handler: str, *kinds: str) -> Column:
    """Boxes in the sample entry of a track with this handler."""
    return F.col("type").isin(*kinds) & F.col("handler").eqNullSafe(handler)


def ambisonic(boxes: DataFrame) -> DataFrame:
    """First sound description per file, in the sample entry of a sound track, decoded."""
    b = F.col("body")
    first = boxes.filter(_is_entry("soun", "SA3D") & (F.length("body") >= 12)).groupBy("path").agg(F.min_by("body", "pos").alias("body"))
    return first.select(
        "path", be_uint(b, 0, 1).alias("version"), be_uint(b, 1, 1).alias("ambisonic_type"), be_uint(b, 2, 4).alias("order"),
        be_uint(b, 6, 1).alias("channel_ordering"), be_uint(b, 7, 1).alias("normalization"), be_uint(b, 8, 4).alias("channels"),
    )


def marks(boxes: DataFrame) -> DataFrame:
    """The boxes that ``has_sphere_tags`` and ``media_after_movie`` look at, and the first of every file, written once for both."""
    return cut(boxes.filter(F.col("type").isin("uuid", "st3d", "sv3d", "mdat", "moov") | (F.col("pos") == 0)))


def has_sphere_tags(boxes: DataFrame) -> DataFrame:
    """Per file: tagged in version 1 (uuid box) or 2 (boxes in the sample entry)."""
    v2 = _is_entry("vide", "st3d", "sv3d")
    return boxes.groupBy("path").agg(F.bool_or(_is_uuid()).alias("v1"), F.bool_or(v2).alias("v2")).withColumn("tagged", F.col("v1") | F.col("v2"))


def untagged(files: DataFrame, boxes: DataFrame) -> DataFrame:
    """Files without any sphere tag."""
    return files.join(has_sphere_tags(boxes).filter("tagged"), "path", "left_anti")


def expected_tags(catalogue: DataFrame) -> DataFrame:
    """Tags a finished file should carry: ``(path, tag, value)``.

    ``catalogue``: path, stereo_mode, fov, audio_channels. Version 1 only suits
    full spheres, a sound box only ambiX.
    """
    mode = F.when(F.col("stereo_mode") == "mono", 0).when(F.col("stereo_mode") == "top-bottom", 1).otherwise(2)
    order = media.ambisonic_order(F.col("audio_channels"))
    tag = lambda name, value: F.struct(F.lit(name).alias("tag"), value.cast("bigint").alias("value"))
    tags = F.array_compact(F.array(
        tag("st3d", mode), tag("equi", media.sphere_bounds(F.col("fov"))),
        F.when(F.col("fov") >= 360, tag("uuid", F.lit(1))), F.when(order.isNotNull(), tag("SA3D", order)),
    ))
    return catalogue.select("path", F.inline(tags))


def found_tags(boxes: DataFrame) -> DataFrame:
    b = F.col("body")
    value = (
        F.when(_is_entry("vide", "st3d"), be_uint(b, 4, 1)).when(_is_entry("vide", "equi"), be_uint(b, 12, 4))
        .when(_is_uuid(), F.lit(1)).when(_is_entry("soun", "SA3D"), be_uint(b, 2, 4))
    )
    return boxes.select("path", F.col("type").alias("tag"), value.cast("bigint").alias("value")).filter(F.col("value").isNotNull())


def tag_audit(catalogue: DataFrame, boxes: DataFrame) -> DataFrame:
    """Missing and unexpected tags per file."""
    want, got = expected_tags(catalogue), cut(found_tags(boxes))  # read twice; the files once
    return want.exceptAll(got).withColumn("problem", F.lit("missing")).unionByName(
        got.exceptAll(want).withColumn("problem", F.lit("unexpected"))
    )


def media_after_movie(boxes: DataFrame) -> DataFrame:
    """Whether the media data of a file follows its movie box."""
    at = lambda t: F.min(F.when((F.col("type") == t) & (F.size("path_in_file") == 0), F.col("pos")))
    return boxes.groupBy("path").agg((at("mdat") > at("moov")).alias("mdat_after_moov"))
