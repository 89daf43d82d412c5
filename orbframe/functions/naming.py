"""What a file name says about how two eyes are packed."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens for stacked and side-by-side eyes, suffix by output mode.
TOP_BOTTOM = ("tb", "ou", "3dv")
SIDE_BY_SIDE = ("sbs", "lr", "3dh")
SUFFIX = {"360": "_360_TB", "vr180": "_180x180_3dh"}


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def split_extension(path: Column) -> tuple[Column, Column]:
    """Path without extension, and the extension with its dot. Leading dots
    of a name do not start an extension."""
    ext = F.regexp_extract(path, r"^(?:.*/)?\.*[^./][^/]*?(\.[^./]*)$", 1)
    return path.substr(F.lit(1), F.length(path) - F.length(ext)), ext


def tokens(stem: Column) -> Column:
    return F.filter(F.split(F.lower(stem), "[^0-9a-z]+"), lambda t: t != "")


def describes_stereo(path: Column) -> Column:
    stem, _ = split_extension(base_name(path))
    return F.arrays_overlap(tokens(stem), F.array(*[F.lit(t) for t in TOP_BOTTOM + SIDE_BY_SIDE]))


def suggest(path: Column, mode: Column) -> Column:
    """The path a player can read; unchanged when the name already tells."""
    suffix = F.when(F.lit(False), F.lit(None))
    for key, value in SUFFIX.items():
        suffix = suffix.when(mode == key, F.lit(value))
    stem, ext = split_extension(path)
    return F.when(suffix.isNull() | describes_stereo(path), path).otherwise(F.concat(stem, suffix, ext))


def advice(path: Column, mode: Column) -> Column:
    """The better base name, NULL when the name needs no change."""
    better = suggest(path, mode)
    return F.when(better != path, base_name(better))
