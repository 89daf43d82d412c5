"""Rules over media facts: column expressions on a catalogue of files."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions, pixel-format tables, projections, sizes, limits.
STILL = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff", ".avif", ".heic", ".heif", ".hif")
WRITABLE_STILL = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff")
JPEG = (".jpg", ".jpeg")
SEMI_PLANAR_CHROMA = {"nv12": "4:2:0", "nv21": "4:2:0", "nv16": "4:2:2", "nv20": "4:2:2", "nv24": "4:4:4", "nv42": "4:4:4"}
SEMI_PLANAR_DEPTH = {"p010": 10, "p012": 12, "p016": 16, "p210": 10, "p216": 16, "p410": 10, "p416": 16}
RGB_FAMILY = ("gbr", "rgb", "bgr", "argb", "abgr", "x2rgb", "x2bgr")
READABLE = ("equirectangular", "cubemap")
WIDTHS = (7680, 5760, 4096, 3840, 2880, 1920)
LUMA_LIMIT = 35_651_584
SAFE_WIDTH = 5760
HARDWARE = ("nvenc", "qsv", "amf", "vaapi", "videotoolbox")
DEFAULT_CHROMA = "4:2:0"
SQUARE_TOLERANCE, FULL_SPHERE = 0.15, 359.0


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]*)$", 1))


def is_still(path: Column) -> Column:
    return extension(path).isin(*STILL)


def is_writable_still(path: Column) -> Column:
    return extension(path).isin(*WRITABLE_STILL)


def is_jpeg(path: Column) -> Column:
    return extension(path).isin(*JPEG)


def frame_total(count: Column, start: Column, cap: Column) -> Column:
    """Frames to render: what is left after ``start``, at most ``cap``; NULLs pass."""
    return F.when(count.isNull(), cap).otherwise(F.least(F.greatest(F.lit(0), count - start), cap))


def _prefix(name: Column, table: dict) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for prefix, value in table.items():
        out = out.when(name.startswith(prefix), F.lit(value))
    return out


def chroma(pix_fmt: Column) -> Column:
    """Chroma layout of a pixel format, NULL when it does not tell."""
    name = F.lower(pix_fmt)
    digits = [F.regexp_extract(name, r"^yuva?j?(\d)(\d)(\d)", i) for i in (1, 2, 3)]
    rgb = F.lit(False)
    for p in RGB_FAMILY:
        rgb = rgb | name.startswith(p)
    return (
        F.when(_prefix(name, SEMI_PLANAR_CHROMA).isNotNull(), _prefix(name, SEMI_PLANAR_CHROMA))
        .when(name.startswith("gray"), F.lit("4:0:0"))
        .when(rgb, F.lit("4:4:4"))
        .when(digits[0] != "", F.concat_ws(":", *digits))
    )


def bit_depth(pix_fmt: Column) -> Column:
    """Bits per component, NULL for packed RGB and anything unknown."""
    name = F.lower(pix_fmt)
    stem = F.regexp_replace(name, "(le|be)$", "")
    width = F.regexp_extract(stem, r"(\d+)$", 1)
    planar = name.startswith("yuv") | name.startswith("gray")
    return (
        F.when(_prefix(name, SEMI_PLANAR_DEPTH).isNotNull(), _prefix(name, SEMI_PLANAR_DEPTH))
        .when(planar & (width != ""), width.try_cast("int"))
        .when(planar & (stem.endswith("p") | (stem == "gray")), F.lit(8))
    )


def horizontal_fov(projection: Column, width: Column, left: Column, right: Column) -> Column:
    total = width + left + right
    return F.when(projection.isNotNull() & (total > 0), 360.0 * width / total)


def is_stereo(layout: Column) -> Column:
    """True only when two views are positively declared."""
    return F.coalesce((layout != "2D") & (layout != ""), F.lit(False))


def admission(width, height, projection, fov, layout, requested) -> Column:
    """``struct(status, reason)``: accept, warn or refuse a source.

    Stereo is refused first and no override helps; a partial sphere, declared
    or guessed from an untagged square shape, yields to an explicit request.
    """
    partial = F.coalesce(fov < FULL_SPHERE, F.lit(False))
    square = projection.isNull() & (F.abs(width / F.greatest(height, F.lit(1)) - 1.0) < SQUARE_TOLERANCE)
    verdict = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))
    return (
        F.when(is_stereo(layout), verdict("refuse", "stereo"))
        .when(~(partial | square), verdict("accept", None))
        .when((requested != "auto") & partial, verdict("warn", "declared_partial"))
        .when(requested != "auto", verdict("warn", "square_shape"))
        .when(partial, verdict("refuse", "declared_partial"))
        .otherwise(verdict("refuse", "square_shape"))
    )


def resolve_projection(declared: Column, requested: Column) -> Column:
    """``struct(projection, status)``: a request wins, silence means
    equirectangular, an unreadable declaration is refused."""
    verdict = lambda p, s: F.struct(p.alias("projection"), F.lit(s).alias("status"))
    return (
        F.when((requested != "auto") & (declared != "") & (declared != requested), verdict(requested, "warn"))
        .when(requested != "auto", verdict(requested, "accept"))
        .when(declared.isNull(), verdict(F.lit("equirectangular"), "accept"))
        .when(declared.isin(*READABLE), verdict(declared, "accept"))
        .otherwise(verdict(F.lit(None).cast("string"), "refuse"))
    )


def source_geometry(width, height, projection, padding) -> Column:
    """``struct(face_size, pano_w, pano_h)`` of a source."""
    tile = F.floor(width / 3) - 2 * padding
    shape = lambda a, b, c: F.struct(a.cast("int").alias("face_size"), b.cast("int").alias("pano_w"), c.cast("int").alias("pano_h"))
    return F.when(projection == "cubemap", shape(tile, tile * 4, tile * 2)).otherwise(
        shape(F.greatest(F.lit(1), F.floor(width / 4)), width, height)
    )


def _even(n: Column) -> Column:
    return F.floor(n / 2) * 2


def eye_size(w, h, out_w) -> Column:
    """``struct(eye_w, eye_h, error)``: optional narrower eye with even sides."""
    scale = out_w / w
    shape = lambda a, b, e: F.struct(a.cast("int").alias("eye_w"), b.cast("int").alias("eye_h"), F.lit(e).cast("string").alias("error"))
    none = F.lit(None)
    return (
        F.when(out_w.isNull() | (out_w == 0) | (out_w == w), shape(w, h, None))
        .when(out_w > w, shape(none, none, "upscale"))
        .when(out_w < 2, shape(none, none, "too_small"))
        .otherwise(shape(_even(F.bround(w * scale)), _even(F.bround(h * scale)), None))
    )


def output_geometry(eye_w, eye_h, mode) -> Column:
    """``struct(out_w, out_h)``: stacked full spheres, or two half fields abreast."""
    shape = lambda a, b: F.struct(a.cast("int").alias("out_w"), b.cast("int").alias("out_h"))
    return F.when(mode == "vr180", shape(_even(F.floor(eye_w / 2)) * 2, eye_h)).when(mode == "360", shape(eye_w, eye_h * 2))


def resolution_choices(w, h, mode) -> Column:
    """Array of offered sizes: the source's own width, then smaller standard ones."""
    widths = F.filter(F.array_distinct(F.concat(F.array(w), F.array(*[F.lit(v) for v in WIDTHS]))), lambda c: c <= w)

    def choice(c):
        eye = eye_size(w, h, c)
        out = output_geometry(eye["eye_w"], eye["eye_h"], mode)
        area = out["out_w"].cast("bigint") * out["out_h"]
        return F.struct(
            c.alias("width"), out["out_w"].alias("out_w"), out["out_h"].alias("out_h"),
            F.bround(area / 1e6, 1).alias("megapixels"), (area <= LUMA_LIMIT).alias("fits"), (c == w).alias("native"),
        )

    return F.transform(widths, choice)


def default_output_width(w, mode, is_photo) -> Column:
    return F.when(is_photo | (mode != "360") | (w <= SAFE_WIDTH), F.lit(0)).otherwise(F.lit(SAFE_WIDTH))


def yaw_allowed(mode, yaw) -> Column:
    return (yaw == 0) | (mode == "vr180")


def half_field(w: Column, yaw: Column) -> tuple[Column, Column]:
    """First column and width of the 180-degree field centred on ``yaw``."""
    half = _even(F.floor(w / 2))
    centre = F.pmod(yaw + 180.0, F.lit(360.0)) / 360.0 * w
    return F.pmod(F.bround(centre - half / 2.0).cast("int"), w), half.cast("int")


def eye_tags(w, h, mode) -> Column:
    """Photo-sphere fields of one eye of a packed still."""
    i = lambda c, n: F.floor(c).cast("int").alias(n)
    tags = lambda cw, ch, fw, left: F.struct(i(cw, "crop_w"), i(ch, "crop_h"), i(fw, "full_w"), i(ch, "full_h"), i(left, "left"), F.lit(0).alias("top"))
    half = F.floor(w / 2)
    return F.when(mode == "vr180", tags(half, h, half * 2, F.floor(half / 2))).otherwise(tags(w, F.floor(h / 2), w, F.lit(0)))


def sphere_bounds(fov: Column) -> Column:
    """Crop at each side as a 0.32 fixed-point share; NULL outside (0, 360]."""
    return F.when((fov > 0) & (fov <= 360), F.bround((1.0 - fov / 360.0) / 2.0 * float(2**32)).cast("bigint"))


def encoder_family(codec: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for suffix in HARDWARE:
        out = out.when(codec.endswith("_" + suffix), F.lit(suffix))
    return out.otherwise(F.lit("sw"))


def supported_chroma(codec: Column) -> Column:
    return F.when(encoder_family(codec) == "sw", F.array(*[F.lit(c) for c in ("4:2:0", "4:2:2", "4:4:4")])).otherwise(F.array(F.lit(DEFAULT_CHROMA)))


def output_chroma(source, codec, follow) -> Column:
    """``struct(chroma, reason)``: follow the source only where it can be encoded."""
    verdict = lambda c, r: F.struct(c.alias("chroma"), F.lit(r).alias("reason"))
    default = F.lit(DEFAULT_CHROMA)
    return (
        F.when(~follow, verdict(default, "default"))
        .when(source.isNull(), verdict(default, "unknown_source"))
        .when(F.array_contains(supported_chroma(codec), source), verdict(source, "matches_source"))
        .otherwise(verdict(default, "not_encodable"))
    )


def deep_source(depth, out_depth) -> Column:
    """Which precision warning a source deserves, NULL for none."""
    return F.when(depth > 8, F.when(out_depth >= 10, F.lit("deep_output_8bit_data")).otherwise(F.lit("reduced_to_8bit")))


def audio_cut(video, audio, fps) -> Column:
    """Seconds of sound to keep when it outlasts the picture, else NULL."""
    return F.when(audio > video + 0.25, video + F.when(fps > 0, 0.5 / fps).otherwise(F.lit(0.02)))


def ambisonic_order(channels: Column) -> Column:
    order = F.bround(F.sqrt(channels)).cast("int") - 1
    return F.when((channels >= 4) & ((order + 1) * (order + 1) == channels) & order.between(1, 3), order)


def channels_for_order(order: Column) -> Column:
    return (order + 1) * (order + 1)


def declares_ambix(sa3d: Column) -> Column:
    """A sound description the yaw rotation can be applied to."""
    ok = (
        (sa3d["ambisonic_type"] == 0) & (sa3d["channel_ordering"] == 0) & (sa3d["normalization"] == 0)
        & sa3d["order"].between(1, 3) & (sa3d["channels"] == channels_for_order(sa3d["order"]))
    )
    return F.coalesce(ok, F.lit(False))


def sound_turn(yaw, has_audio, channels, flagged) -> Column:
    """What to do with the soundfield when the view is turned."""
    order = ambisonic_order(channels)
    return (
        F.when((yaw == 0) | ~has_audio, F.lit("none"))
        .when(~flagged & order.isNotNull(), F.lit("warn_not_flagged"))
        .when(~flagged, F.lit("none"))
        .when(order.isNull(), F.lit("warn_not_ambix"))
        .otherwise(F.lit("rotate"))
    )


def model_size(h, w, target: int, multiple: int) -> Column:
    """``struct(th, tw)``: model input keeping the aspect, sides snapped."""
    sh, sw = F.lit(float(target)) / h, F.lit(float(target)) / w
    s = F.when(F.abs(1 - sw) < F.abs(1 - sh), sw).otherwise(sh)
    snap = lambda v: F.greatest(F.lit(multiple), (F.bround(v / multiple) * multiple).cast("int"))
    return F.struct(snap(s * h).alias("th"), snap(s * w).alias("tw"))
