"""Media facts from probe documents (JSON text), and the summary back to JSON."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbframe.functions import media
from orbframe.operators import grid

STREAM = (
    "codec_type string, width string, height string, avg_frame_rate string, nb_frames string, duration string, "
    "channels string, pix_fmt string, color_range string, color_space string, color_transfer string, color_primaries string, "
    "side_data_list array<struct<side_data_type:string, projection:string, padding:string, bound_left:string, bound_right:string, type:string>>"
)
DOCUMENT = f"struct<streams: array<struct<{STREAM.replace(' string', ': string').replace('side_data_list array', 'side_data_list: array')}>>, format: struct<duration: string>>"


def parse(docs: DataFrame, column: str = "json") -> DataFrame:
    """Parse once; without the pin the parser would be copied per field."""
    return grid.pin(docs, {"doc": F.from_json(column, DOCUMENT)})


def _rate(text: Column) -> Column:
    """A rational frame rate; 0 when the denominator is 0."""
    num, den = F.split(text, "/")[0].try_cast("double"), F.split(text, "/")[1].try_cast("double")
    return F.when(den == 0, F.lit(0.0)).otherwise(num / F.nullif(den, F.lit(0.0)))


def facts(docs: DataFrame, column: str = "json") -> DataFrame:
    """One catalogue row per document: first video stream, first audio stream,
    declared projection and layout. What a file does not say is NULL."""
    first = lambda kind: F.get(F.filter("doc.streams", lambda s: s["codec_type"] == kind), F.lit(0))
    last = lambda kind: F.element_at(F.filter(F.coalesce("v.side_data_list", F.array()), lambda s: s["side_data_type"] == kind), -1)
    # element_at on an empty array is an error under ANSI rules, so look first.
    guarded = lambda kind: F.when(F.exists(F.coalesce("v.side_data_list", F.array()), lambda s: s["side_data_type"] == kind), last(kind))
    whole = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    tag = lambda c: F.when(F.col(f"v.{c}") != "unknown", F.col(f"v.{c}"))
    rest = [c for c in docs.columns if c != column]
    streams = grid.pin(parse(docs, column), {"v": first("video"), "a": first("audio")})
    s = grid.pin(streams, {"sphere": guarded("Spherical Mapping"), "stereo": guarded("Stereo 3D")})
    return s.select(
        *rest, F.col("v.width").cast("int").alias("width"), F.col("v.height").cast("int").alias("height"),
        _rate(F.col("v.avg_frame_rate")).alias("fps"), F.col("v.nb_frames").try_cast("bigint").alias("frame_count"),
        F.col("doc.format.duration").try_cast("double").alias("duration"), F.col("a").isNotNull().alias("has_audio"),
        F.col("a.channels").try_cast("int").alias("audio_channels"), F.col("v.pix_fmt").alias("pix_fmt"),
        F.col("sphere.projection").alias("projection"), whole(F.col("sphere.padding")).alias("cubemap_padding"),
        whole(F.col("sphere.bound_left")).alias("bound_left"), whole(F.col("sphere.bound_right")).alias("bound_right"),
        F.col("stereo.type").alias("stereo_layout"),
        F.struct(tag("color_range").alias("range"), tag("color_space").alias("space"),
                 tag("color_transfer").alias("transfer"), tag("color_primaries").alias("primaries")).alias("color"),
    )


def stream_durations(docs: DataFrame, column: str = "json") -> DataFrame:
    """Video and audio seconds per document; the last readable stream counts."""
    read = lambda kind: F.element_at(F.concat(F.array(F.lit(None).cast("double")), F.transform(
        F.filter("doc.streams", lambda s: (s["codec_type"] == kind) & s["duration"].try_cast("double").isNotNull()),
        lambda s: s["duration"].try_cast("double"))), -1)
    rest = [c for c in docs.columns if c != column]
    return parse(docs, column).select(*rest, read("video").alias("video"), read("audio").alias("audio"))


def summary(catalogue: DataFrame, key: str, ambix: Column | None = None) -> DataFrame:
    """The facts a front end needs, as one JSON text per file."""
    return catalogue.select(key, F.to_json(F.struct(
        "width", "height", "fps", "frame_count", "duration", "has_audio", "pix_fmt", "audio_channels",
        (F.lit(False) if ambix is None else ambix).alias("declares_ambix"),
        media.chroma(F.col("pix_fmt")).alias("chroma"),
        F.col("color.range").alias("color_range"), F.col("color.space").alias("color_space"),
    ), {"ignoreNullFields": "false"}).alias("json"))
