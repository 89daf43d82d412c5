"""Cube faces: exact, padded, widened, packed; and panoramas from them."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbframe import FRAME
from orbframe.functions import sphere
from orbframe.functions.sphere import FACE_OVERLAP, FACES
from orbframe.operators import grid

# The 3x2 packing, top row right/left/up, bottom down/front/back.
LAYOUT_3X2 = (("+X", "-X", "+Y"), ("-Y", "+Z", "-Z"))


def _taps(df: DataFrame, w: int, h: int, **rule) -> DataFrame:
    return df.withColumns(grid.tap_coords(F.col("u"), F.col("v"), w, h, **rule))


def panorama_to_face_map(spark: SparkSession, w: int, h: int, size: int, overlap: float = 0.0, pole: str = "clamp") -> DataFrame:
    """Where each pixel of six (widened) faces reads a panorama."""
    px = grid.face_grid(spark, size, 1.0 + overlap)
    u, v = sphere.uv_of_dir(F.col("dx"), F.col("dy"), F.col("dz"), w, h)
    return _taps(grid.pin(px, {"u": u, "v": v}), w, h, wrap_x=True, pole=pole).select(
        "face", "y", "x", "y0", "x0", "fy", "fx"
    )


def panorama_to_faces(df: DataFrame, w: int, h: int, size: int, values: list[str], overlap: float = 0.0, pole: str = "clamp") -> DataFrame:
    """Panorama to six faces; ``overlap`` widens them past 90 degrees."""
    gmap = panorama_to_face_map(df.sparkSession, w, h, size, overlap, pole)
    return grid.gather(df, gmap, values, 6 * size * size, wrap_x=True, pole=pole)


def _face_map(px: DataFrame, size: int, reach: float = 1.0, rule: str = "clamp") -> DataFrame:
    """Owning face and taps on it for rows with a direction."""
    own = grid.pin(px, {"own": sphere.owner(F.col("dx"), F.col("dy"), F.col("dz"))})
    at = grid.pin(own, {
        "sface": F.col("own.face"),
        "u": sphere.local_to_pixel(F.col("own.a"), size, reach),
        "v": sphere.local_to_pixel(F.col("own.b"), size, reach),
    })
    return _taps(at, size, size, wrap_x=False, pole=rule)


def pad_faces(df: DataFrame, size: int, pad: int, values: list[str]) -> DataFrame:
    """Surround each face with pixels of its neighbours.

    Padded pixels lie at -pad..-1 and size..size+pad-1; each is sampled from
    the face that owns the direction just past the edge.
    """
    wide = grid.face_grid(df.sparkSession, size + 2 * pad, (size + 2.0 * pad) / size)
    ring = wide.withColumns({"y": F.col("y") - pad, "x": F.col("x") - pad}).filter(
        (F.col("y") < 0) | (F.col("x") < 0) | (F.col("y") >= size) | (F.col("x") >= size)
    )
    gmap = _face_map(ring, size).select("face", "y", "x", "sface", "y0", "x0", "fy", "fx")
    rim = grid.gather(df, gmap, values, 6 * (size + 2 * pad) ** 2, source_face=True, wrap_x=False)
    return df.select(*FRAME, "face", "y", "x", *values).unionByName(rim)


def faces_to_panorama(df: DataFrame, size: int, w: int, h: int, values: list[str], method: str = "bilinear", pad: int = 2) -> DataFrame:
    """Six exact faces to a panorama.

    Bilinear depth reads padded faces so taps near an edge see the adjacent
    face. ``pad=0`` samples colour without padding, clamped at face edges;
    ``nearest`` never needs it.
    """
    pad = 0 if method == "nearest" else pad
    src = pad_faces(df, size, pad, values) if pad else df
    out = grid.rays(grid.image_grid(df.sparkSession, w, h), w, h)
    gmap = _face_map(out, size, rule="clamp" if pad == 0 else "open").select("y", "x", "sface", "y0", "x0", "fy", "fx")
    return grid.gather(src, gmap, values, w * h, source_face=True, wrap_x=False, pole="clamp", method=method)


def colour_atlas_to_panorama(df: DataFrame, size: int, w: int, h: int, values: list[str]) -> DataFrame:
    """Six colour faces to a panorama through one 3x2 sheet.

    Taps at a face edge read whatever lies beside it on the sheet, and zero
    outside the sheet.
    """
    index = F.array_position(F.array(*[F.lit(f) for f in FACES]), F.col("face")).cast("int") - 1
    sheet = df.withColumn("_i", index).select(
        *FRAME, (F.col("y") + (F.col("_i") / 3).cast("int") * size).alias("y"),
        (F.col("x") + F.col("_i") % 3 * size).alias("x"), *values,
    )
    out = grid.rays(grid.image_grid(df.sparkSession, w, h), w, h)
    own = grid.pin(out, {"own": sphere.owner(F.col("dx"), F.col("dy"), F.col("dz"))})
    i = F.array_position(F.array(*[F.lit(f) for f in FACES]), F.col("own.face")).cast("int") - 1
    at = grid.pin(own, {
        "u": sphere.local_to_pixel(F.col("own.a"), size) + i % 3 * size,
        "v": sphere.local_to_pixel(F.col("own.b"), size) + (i / 3).cast("int") * size,
    })
    gmap = _taps(at, 3 * size, 2 * size, wrap_x=False, pole="zero").select("y", "x", "y0", "x0", "fy", "fx")
    return grid.gather(sheet, gmap, values, w * h, wrap_x=False, pole="zero")


def round_trip(df: DataFrame, w: int, h: int, size: int, values: list[str]) -> DataFrame:
    """Panorama to faces and back: the identity check of the geometry."""
    return colour_atlas_to_panorama(panorama_to_faces(df, w, h, size, values), size, w, h, values)


def widen_faces(df: DataFrame, size: int, values: list[str], overlap: float = FACE_OVERLAP) -> DataFrame:
    """Exact faces to widened faces in a single resampling."""
    px = grid.face_grid(df.sparkSession, size, 1.0 + overlap)
    gmap = _face_map(px, size).select("face", "y", "x", "sface", "y0", "x0", "fy", "fx")
    return grid.gather(df, gmap, values, 6 * size * size, source_face=True, wrap_x=False)


def packed_faces(df: DataFrame, w: int, h: int, padding: int = 0) -> DataFrame:
    """Split a 3x2 cube frame into faces, cropping ``padding`` off each tile."""
    if w % 3 or h % 2 or w // 3 != h // 2:
        raise ValueError(f"a 3x2 cube frame needs square tiles, got {w}x{h}")
    tile = w // 3
    if 2 * padding >= tile:
        raise ValueError(f"padding {padding} leaves nothing of a {tile} pixel tile")
    names = F.array(*[F.lit(n) for row in LAYOUT_3X2 for n in row])
    slot = (F.col("y") / tile).cast("int") * 3 + (F.col("x") / tile).cast("int")
    rest = [c for c in df.columns if c not in FRAME + ["y", "x"]]
    ty, tx = F.col("y") % tile, F.col("x") % tile
    inside = lambda t: (t >= padding) & (t < tile - padding)
    return df.filter(inside(ty) & inside(tx)).select(
        *FRAME, F.get(names, slot).alias("face"), (ty - padding).alias("y"), (tx - padding).alias("x"), *rest
    )


def read_source(df: DataFrame, projection: str, w: int, h: int, padding: int, values: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Panorama and, for cube input, its own faces as well."""
    if projection != "cubemap":
        return df, None
    size = w // 3 - 2 * padding
    faces = packed_faces(df, w, h, padding)
    return colour_atlas_to_panorama(faces, size, 4 * size, 2 * size, values), faces


def visible_faces(spark: SparkSession, w: int, h: int, overlap: float = FACE_OVERLAP) -> DataFrame:
    """Every panorama pixel with each widened face that sees it."""
    px = grid.rays(grid.image_grid(spark, w, h), w, h).withColumn("axes", F.explode(sphere.face_axes_literal()))
    seen = grid.pin(px, {"p": sphere.face_view(F.col("dx"), F.col("dy"), F.col("dz"), 1.0 + overlap)})
    return seen.filter("p.seen").select("y", "x", F.col("axes.face").alias("sface"), "p.a", "p.b")


def blend_map(spark: SparkSession, w: int, h: int, size: int, overlap: float = FACE_OVERLAP) -> DataFrame:
    """Taps and normalised weights from widened faces to a panorama."""
    seen = visible_faces(spark, w, h, overlap).withColumn(
        "wt", sphere.overlap_weight(F.col("a"), overlap) * sphere.overlap_weight(F.col("b"), overlap)
    )
    total = F.sum("wt").over(Window.partitionBy("y", "x"))
    at = grid.pin(seen.withColumn("wt", F.col("wt") / F.greatest(total, F.lit(1e-6))), {
        "u": sphere.local_to_pixel(F.col("a"), size, 1.0 + overlap),
        "v": sphere.local_to_pixel(F.col("b"), size, 1.0 + overlap),
    })
    return _taps(at, size, size, wrap_x=False).select("y", "x", "sface", "y0", "x0", "fy", "fx", "wt")


def blend_faces(df: DataFrame, size: int, w: int, h: int, overlap: float = FACE_OVERLAP, value: str = "d") -> DataFrame:
    """Cross-fade six widened depth faces into a panorama."""
    gmap = blend_map(df.sparkSession, w, h, size, overlap)
    taps = grid.gather(df, gmap, [value], 6 * w * h, source_face=True, wrap_x=False)
    return taps.groupBy(*FRAME, "y", "x").agg(F.sum(F.col(value) * F.col("wt")).alias(value))


def mask_runs(df: DataFrame, mask: str = "hole", keys: list[str] = FRAME) -> DataFrame:
    """Contiguous true runs per scanline: ``x0`` to ``x1``, both included."""
    row = Window.partitionBy(*keys, "y").orderBy("x")
    return (
        df.filter(mask).withColumn("_g", F.col("x") - F.row_number().over(row))
        .groupBy(*keys, "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g")
    )
