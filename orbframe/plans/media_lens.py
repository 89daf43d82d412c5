"""Orders read as media files: every order is one file with its facts.

The same choices, made from the order key, are written in both dialects.
"""

import functools
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbframe.plans.lenses import table

PIX_FMTS = ("yuv420p", "yuvj420p", "yuva420p", "yuv422p10le", "yuv444p", "yuv444p12le", "nv12", "nv16", "gbrp", "rgb24", "gray", "yuv411p",
            None, "something_odd", "gray10le", "p010le", "p016le", "yuv420p9be", "rgb48le", "YUV420P", "gbrp10le", "nv24", "yuv420p10le", "")
LAYOUTS = (None, "2D", "side by side", "top and bottom", None, None)
PROJECTIONS = (None, "equirectangular", "cubemap", "tiled equirectangular", "mesh")
WIDTHS = (7680, 5760, 3840, 2160, 1920, 4096, 1000)
CHANNELS = (None, 1, 2, 4, 6, 9, 16, 25)
CODECS = ("libx265", "hevc_nvenc", "libx264", "h264_qsv", "hevc_amf", "h264_vaapi", "hevc_videotoolbox")
OUT_WIDTHS = (None, 3840, 5760, 1, 1917, 9000)
YAWS = (0.0, 90.0, -200.0, 33.3)
EXTS = (".mp4", ".JPG", ".png", ".heic", ".jpeg", ".mkv", "", ".tiff")
MODES = ("360", "vr180")


def _lit(v):
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)


def _columns(spark_sql: bool) -> dict[str, str]:
    div = (lambda a, b: f"CAST(({a} DIV {b}) AS INT)") if spark_sql else (lambda a, b: f"CAST(({a}) // {b} AS INT)")

    def pick(values, i, kind):
        items = ", ".join(_lit(v) for v in values)
        if spark_sql:
            return f"CAST(element_at(array({items}), CAST({i} AS INT) + 1) AS {kind})"
        return f"CAST(list_extract([{items}], CAST({i} AS INT) + 1) AS {kind})"

    text, real = ("STRING", "DOUBLE") if spark_sql else ("VARCHAR", "DOUBLE")
    k = "o_orderkey"
    w = pick(WIDTHS, f"{k} % 7", "INT")
    proj = pick(PROJECTIONS, f"{div(k, 7)} % 5", text)
    return {
        "k": k,
        "path": f"concat('media/', o_orderpriority, '/', CAST({k} AS {text}), {pick(EXTS, f'{k} % 8', text)})",
        "width": w,
        "height": f"CASE {k} % 5 WHEN 3 THEN {w} WHEN 4 THEN {div(f'{w} * 2', 3)} ELSE {div(w, 2)} END",
        "projection": proj,
        "bound": f"CASE WHEN {proj} = 'tiled equirectangular' THEN {div(f'{w} * CAST({k} % 3 AS INT)', 4)} ELSE CAST({k} % 2 AS INT) END",
        "layout": pick(LAYOUTS, f"{div(k, 35)} % 6", text),
        "padding": f"CAST({k} % 4 AS INT)",
        "pix_fmt": pick(PIX_FMTS, f"({k} * 13) % 24", text),
        "fps": pick((30.0, 25.0, 0.0, 60.0), f"{k} % 4", real),
        "frames": f"CASE WHEN {k} % 11 = 0 THEN NULL ELSE {k} % 5000 END",
        "video_s": f"CASE WHEN {k} % 9 = 0 THEN NULL ELSE CAST({k} % 300 AS DOUBLE) END",
        "audio_s": f"CASE WHEN {k} % 10 = 0 THEN NULL ELSE CAST({k} % 300 + ({k} % 5) * 0.125 AS DOUBLE) END",
        "channels": pick(CHANNELS, f"{div(k, 3)} % 8", "INT"),
        "mode": pick(MODES, f"{k} % 2", text),
        "yaw": pick(YAWS, f"{k} % 4", real),
        "out_w": pick(OUT_WIDTHS, f"{div(k, 2)} % 6", "INT"),
        "codec": pick(CODECS, f"{k} % 7", text),
        "requested": pick(("auto", "equirectangular", "cubemap"), f"{div(k, 11)} % 3", text),
    }


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(*[F.expr(e).alias(n) for n, e in _columns(True).items()])


CATALOGUE = "cat AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _columns(False).items()) + " FROM orders)"


# --- probe documents -----------------------------------------------------


def probe_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The facts as the JSON a media probe prints: one text per file."""
    c = catalogue(spark, sf)
    txt = lambda n: F.col(n).cast("string")
    sphere = F.struct(
        F.lit("Spherical Mapping").alias("side_data_type"), F.col("projection"), txt("padding").alias("padding"),
        txt("bound").alias("bound_left"), txt("bound").alias("bound_right"))
    stereo = F.struct(F.lit("Stereo 3D").alias("side_data_type"), F.col("layout").alias("type"))
    sides = F.concat_ws(",", F.when(F.col("projection").isNotNull(), F.to_json(sphere)), F.when(F.col("layout").isNotNull(), F.to_json(stereo)))
    video = F.to_json(F.struct(
        F.lit("video").alias("codec_type"), F.col("width"), F.col("height"),
        F.element_at(F.array(*[F.lit(r) for r in ("30/1", "25/1", "0/0", "60000/1000")]), (F.col("k") % 4 + 1).cast("int")).alias("avg_frame_rate"),
        F.coalesce(txt("frames"), F.lit("N/A")).alias("nb_frames"), txt("video_s").alias("duration"), F.col("pix_fmt"),
        F.when(F.col("k") % 3 == 0, "bt709").when(F.col("k") % 3 == 1, "unknown").alias("color_space")))
    audio = F.when(F.col("channels").isNotNull(), F.to_json(F.struct(
        F.lit("audio").alias("codec_type"), F.col("channels"), txt("audio_s").alias("duration"))))
    cut = F.substring(video, F.lit(1), F.length(video) - 1)
    text = F.concat(
        F.lit('{"streams":['), F.concat_ws(",", audio, F.concat(cut, F.lit(',"side_data_list":['), sides, F.lit("]}"))),
        F.lit('],"format":{"duration":"'), F.coalesce(txt("video_s"), F.lit("")), F.lit('"}}'))
    return c.select("k", text.alias("json"))


# --- file bytes ----------------------------------------------------------


def _box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind.encode()) + body


@functools.lru_cache(maxsize=1024)
def _moov(k: int, channels: int | None) -> bytes:
    """The movie box; all it takes from a key is its rest by 24."""
    side = round((1.0 - (180.0 if k % 8 == 0 else 360.0) / 360.0) / 2.0 * 2**32)
    v1 = _box("uuid", bytes.fromhex("ffcc8263f8554a938814587a02521fdd"), b"<rdf/>") if k % 3 == 0 else b""
    equi = _box("equi", bytes(12), struct.pack(">II", side, side))
    v2 = _box("st3d", bytes(4), bytes([k % 3])) + _box("sv3d", _box("svhd", bytes(4), b"x\0"), _box("proj", _box("prhd", bytes(16)), equi))
    order = {4: 1, 9: 2, 16: 3}.get(channels)
    sound = _box("SA3D", bytes(2), struct.pack(">IBBI", order, 0, int(k % 6 == 0), channels)) if order else b""

    def track(handler: bytes, entry: bytes, tail: bytes = b"") -> bytes:
        table = _box("stbl", _box("stsd", bytes(4), struct.pack(">I", 1), entry))
        return _box("trak", _box("mdia", _box("hdlr", bytes(8), handler, bytes(12)), _box("minf", table)), tail)

    tracks = track(b"vide", _box("avc1", bytes(78), _box("avcC", bytes(4)), v2 if k % 4 == 0 else b""), v1)
    if channels is not None:
        tracks += track(b"soun", _box("mp4a", bytes(28), sound))
    return _box("moov", _box("mvhd", bytes(20)), tracks)


def _movie(k: int, channels: int | None) -> bytes:
    """A small MP4 file whose tags depend on the key."""
    moov, mdat = _moov(k % 24, channels), _box("mdat", struct.pack(">Q", k))
    whole = _box("ftyp", b"isom", bytes(4)) + (mdat + moov if k % 2 else moov + mdat)
    return whole[:-3] if k % 17 == 0 else whole


def movie_files(spark: SparkSession, sf: str) -> DataFrame:
    """``path, content``: one MP4 per order. Tags version 1 for k % 3 = 0,
    version 2 for k % 4 = 0, sound for ambiX channel counts. The media data
    leads for odd keys; every 17th file is cut short in its last box."""

    def build(batches):
        for b in batches:
            made = [_movie(k, c) for k, c in zip(b["k"].to_pylist(), b["channels"].to_pylist())]
            yield pa.record_batch([b["path"], pa.array(made, pa.binary())], names=["path", "content"])

    facts = catalogue(spark, sf).select("k", "channels", "path")
    return facts.repartition("path").mapInArrow(build, "path string, content binary")


def photo_files(spark: SparkSession, sf: str) -> DataFrame:
    """``path, content``: JPEG marker chains; three quarters carry sphere tags,
    and a decoy of the same text sits behind the start of the scan."""
    k = F.col("k")
    tag = F.concat(F.lit('<x GPano:ProjectionType="equirectangular" GPano:FullPanoWidthPixels="'), F.col("width").cast("string"), F.lit('"/>'))
    be16 = lambda n: F.unhex(F.lpad(F.hex(n.cast("bigint")), 4, "0"))
    seg = lambda marker, body: F.concat(F.unhex(F.lit(marker)), be16(F.length(body) + 2), body)
    xmp = seg("ffe1", F.concat(F.encode(F.lit("http://ns.adobe.com/xap/1.0/"), "US-ASCII"), F.unhex(F.lit("00")), F.encode(tag, "UTF-8")))
    exif = seg("ffe1", F.encode(F.lit("Exif"), "US-ASCII"))
    head = F.concat(F.unhex(F.lit("ffd8")), exif)
    content = F.when(k % 4 == 0, F.concat(head, F.unhex(F.lit("ffda")), xmp)).otherwise(F.concat(head, xmp, F.unhex(F.lit("ffda")), xmp))
    return catalogue(spark, sf).select("path", content.alias("content"))
