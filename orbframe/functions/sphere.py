"""Spherical geometry as column expressions.

Axes: +Z front, +X right, +Y up. A panorama of width ``w`` and height ``h``
has longitude growing to the right from -pi and latitude falling from pi/2;
pixel centres sit at half-integer positions.
"""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six cube faces, in order, each with its outward, right and
# down axis.
FACES = ("+X", "-X", "+Y", "-Y", "+Z", "-Z")
FACE_AXES = {
    "+X": ((1, 0, 0), (0, 0, -1), (0, -1, 0)),
    "-X": ((-1, 0, 0), (0, 0, 1), (0, -1, 0)),
    "+Y": ((0, 1, 0), (1, 0, 0), (0, 0, 1)),
    "-Y": ((0, -1, 0), (1, 0, 0), (0, 0, -1)),
    "+Z": ((0, 0, 1), (1, 0, 0), (0, -1, 0)),
    "-Z": ((0, 0, -1), (-1, 0, 0), (0, -1, 0)),
}
# Fixed value: default reach past a face edge, in tangent units.
FACE_OVERLAP = 0.15


def ray(x, y, w: int, h: int) -> tuple[Column, Column, Column]:
    """Unit direction of a panorama pixel centre."""
    lon = ((x + 0.5) / w - 0.5) * (2.0 * math.pi)
    lat = (0.5 - (y + 0.5) / h) * math.pi
    return F.cos(lat) * F.sin(lon), F.sin(lat), F.cos(lat) * F.cos(lon)


def uv_of_dir(dx, dy, dz, w: int, h: int) -> tuple[Column, Column]:
    """Panorama coordinates of a unit direction."""
    lon = F.atan2(dx, dz)
    lat = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dy)))
    return (lon / math.pi * 0.5 + 0.5) * w - 0.5, (0.5 - lat / math.pi) * h - 0.5


def uv_of_point(px, py, pz, w: int, h: int) -> tuple[Column, Column, Column]:
    """Panorama coordinates and distance of any 3D point; the origin is safe.

    Longitude does not care about the length of the vector, so only the
    latitude is divided by it.
    """
    norm = F.sqrt(px * px + py * py + pz * pz)
    unit_y = py / F.when(norm == 0.0, F.lit(1.0)).otherwise(norm)
    u, v = uv_of_dir(px, unit_y, pz, w, h)
    return u, v, norm


def owner(dx, dy, dz) -> Column:
    """``struct(face, a, b)``: the cube face a direction belongs to and where.

    Ties go to the x axis first and then to y.
    """
    ax, ay, az = F.abs(dx), F.abs(dy), F.abs(dz)

    def hit(face, a, b):
        return F.struct(F.lit(face).alias("face"), a.alias("a"), b.alias("b"))

    on_x = (ax >= ay) & (ax >= az)
    on_y = (ay > ax) & (ay >= az)
    return (
        F.when(on_x & (dx > 0), hit("+X", -dz / ax, -dy / ax))
        .when(on_x, hit("-X", dz / ax, -dy / ax))
        .when(on_y & (dy > 0), hit("+Y", dx / ay, dz / ay))
        .when(on_y, hit("-Y", dx / ay, -dz / ay))
        .when(dz > 0, hit("+Z", dx / az, -dy / az))
        .otherwise(hit("-Z", -dx / az, -dy / az))
    )


def face_axes_literal() -> Column:
    """The face table as an array literal, to be exploded beside any relation."""
    rows = []
    for face in FACES:
        fields = [F.lit(face).alias("face")]
        for axis, values in zip(("o", "r", "d"), FACE_AXES[face]):
            fields += [F.lit(float(v)).alias(f"{axis}{c}") for c, v in zip("xyz", values)]
        rows.append(F.struct(*fields))
    return F.array(*rows)


def face_dir(a, b, axes="axes") -> tuple[Column, Column, Column]:
    """Unit direction of local coordinates ``(a, b)`` on the face in ``axes``."""
    at = lambda name: F.col(f"{axes}.{name}")
    raw = [at(f"o{c}") + a * at(f"r{c}") + b * at(f"d{c}") for c in "xyz"]
    n = F.sqrt(raw[0] * raw[0] + raw[1] * raw[1] + raw[2] * raw[2])
    return raw[0] / n, raw[1] / n, raw[2] / n


def face_view(dx, dy, dz, limit: float, axes="axes") -> Column:
    """``struct(a, b, seen)`` of a direction looked at from one widened face."""
    dot = lambda k: dx * F.col(f"{axes}.{k}x") + dy * F.col(f"{axes}.{k}y") + dz * F.col(f"{axes}.{k}z")
    depth = dot("o")
    front = depth > 1e-6
    safe = F.when(front, depth).otherwise(F.lit(1.0))
    a, b = dot("r") / safe, dot("d") / safe
    return F.struct(
        a.alias("a"),
        b.alias("b"),
        (front & (F.abs(a) <= limit) & (F.abs(b) <= limit)).alias("seen"),
    )


def overlap_weight(t, overlap: float) -> Column:
    """Raised cosine: 1 inside the nominal face, 0 at its outer reach."""
    lo, span = 1.0 - overlap, max(2.0 * overlap, 1e-9)
    ramp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.abs(t) - lo) / span))
    return 0.5 + 0.5 * F.cos(math.pi * ramp)


def face_fov_degrees(overlap: float = FACE_OVERLAP) -> float:
    """Field of view of one widened face."""
    return 2.0 * math.degrees(math.atan(1.0 + overlap))


def local_to_pixel(t, size: int, reach: float = 1.0) -> Column:
    """Local face coordinate in [-reach, reach] to a pixel coordinate."""
    return (t / reach + 1.0) * 0.5 * size - 0.5
