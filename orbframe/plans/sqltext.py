"""Pieces of SQL text the oracles share."""

import re

PI = "pi()"


def ray(rel: str, w: int, h: int, name: str = "rayed") -> str:
    """CTE adding the unit direction of each pixel of ``rel``."""
    lon = f"(((x + 0.5) / {w} - 0.5) * (2.0 * {PI}))"
    lat = f"((0.5 - (y + 0.5) / {h}) * {PI})"
    return (
        f"{name} AS (SELECT *, cos({lat}) * sin({lon}) AS dx, sin({lat}) AS dy, cos({lat}) * cos({lon}) AS dz FROM {rel})"
    )


def uv(x: str, y: str, z: str, w: int, h: int) -> tuple[str, str]:
    return (
        f"((atan2({x}, {z}) / {PI} * 0.5 + 0.5) * {w} - 0.5)",
        f"((0.5 - asin(greatest(-1.0, least(1.0, {y}))) / {PI}) * {h} - 0.5)",
    )


def owner(x: str = "dx", y: str = "dy", z: str = "dz") -> dict[str, str]:
    ax, ay, az = f"abs({x})", f"abs({y})", f"abs({z})"
    onx, ony = f"({ax} >= {ay} AND {ax} >= {az})", f"({ay} > {ax} AND {ay} >= {az})"
    pick = lambda px, nx, py, ny, pz, nz: (
        f"(CASE WHEN {onx} AND {x} > 0 THEN {px} WHEN {onx} THEN {nx} WHEN {ony} AND {y} > 0 THEN {py} "
        f"WHEN {ony} THEN {ny} WHEN {z} > 0 THEN {pz} ELSE {nz} END)"
    )
    return {
        "face": pick("'+X'", "'-X'", "'+Y'", "'-Y'", "'+Z'", "'-Z'"),
        "a": pick(f"-{z}/{ax}", f"{z}/{ax}", f"{x}/{ay}", f"{x}/{ay}", f"{x}/{az}", f"-{x}/{az}"),
        "b": pick(f"-{y}/{ax}", f"-{y}/{ax}", f"{z}/{ay}", f"-{z}/{ay}", f"-{y}/{az}", f"-{y}/{az}"),
    }


AXES = """
axes(face, ox, oy, oz, rx, ry, rz, ex, ey, ez) AS (VALUES
  ('+X', 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, -1.0::DOUBLE, 0.0::DOUBLE, -1.0::DOUBLE, 0.0::DOUBLE),
  ('-X', -1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, -1.0, 0.0),
  ('+Y', 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0),
  ('-Y', 0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, -1.0),
  ('+Z', 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, -1.0, 0.0),
  ('-Z', 0.0, 0.0, -1.0, -1.0, 0.0, 0.0, 0.0, -1.0, 0.0))"""


def face_px(size: int, reach: float = 1.0, name: str = "face_px") -> str:
    """CTEs: every pixel of six faces with its direction; needs AXES."""
    return f"""
{name}_ab AS (
  SELECT face, CAST(j AS INT) AS y, CAST(i AS INT) AS x, ((i + 0.5) / {size} * 2.0 - 1.0) * {reach} AS a,
         ((j + 0.5) / {size} * 2.0 - 1.0) * {reach} AS b, axes.* EXCLUDE (face)
  FROM axes, range({size}) p(j), range({size}) q(i)),
{name}_raw AS (
  SELECT face, y, x, a, b, ox + a * rx + b * ex AS px, oy + a * ry + b * ey AS py, oz + a * rz + b * ez AS pz FROM {name}_ab),
{name} AS (
  SELECT face, y, x, a, b, px / sqrt(px*px + py*py + pz*pz) AS dx, py / sqrt(px*px + py*py + pz*pz) AS dy,
         pz / sqrt(px*px + py*py + pz*pz) AS dz FROM {name}_raw)"""


def bilinear(src: str, at: str, keys: list[str], values: list[str], out: list[str], w: int, h: int, wrap_x: bool, name: str, face: bool = False, zero: bool = False, extra: str = "") -> str:
    """CTEs sampling ``src`` at ``u, v`` of ``at`` by four joined taps.

    Rows of ``at`` without the frame keys are used for every frame. ``face``
    matches ``at.sface`` to ``src.face``; ``zero`` reads nothing outside.
    """
    cx = "u" if wrap_x or zero else f"greatest(0.0, least({w - 1}.0, u))"
    cy = "v" if zero else f"greatest(0.0, least({h - 1}.0, v))"
    taps = f"""
{name}_c AS (SELECT *, {cx} AS cu, {cy} AS cv FROM {at}),
{name}_t AS (
  SELECT {name}_c.* EXCLUDE (cu, cv),
         CAST(floor(cv) AS INT) + oy AS ty0, CAST(floor(cu) AS INT) + ox AS tx0,
         (CASE WHEN oy = 1 THEN cv - floor(cv) ELSE 1 - (cv - floor(cv)) END)
         * (CASE WHEN ox = 1 THEN cu - floor(cu) ELSE 1 - (cu - floor(cu)) END) AS tw
  FROM {name}_c, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(oy, ox))"""
    tx = f"((tx0 % {w}) + {w}) % {w}" if wrap_x else ("tx0" if zero else f"least({w - 1}, tx0)")
    ty = "ty0" if zero else f"least({h - 1}, ty0)"
    match = " AND ".join(
        [f"s.y = {ty}", f"s.x = {tx}"] + (["s.face = t.sface"] if face else []) + [f"s.{k} = t.{k}" for k in keys]
    )
    key = [f"{'t' if keys else 's'}.{k} AS {k}" for k in ("clip", "f")]
    group = ", ".join(str(i + 1) for i in range(2 + len(out)))
    return taps + f""",
{name} AS (
  SELECT {', '.join(key)}, {', '.join(f't.{c} AS {c}' for c in out)}, {', '.join(f'sum(s.{v} * t.tw) AS {v}' for v in values)}{extra}
  FROM {name}_t t JOIN {src} s ON {match} GROUP BY {group})"""


def dist(d: str = "d") -> str:
    return f"(1.0 / ({d} + 0.05))"


def normalised(src: str = "pano", stride: int = 1, name: str = "norm", keys: str = "clip, f") -> str:
    """CTEs scaling ``d`` of each group to its 1..99 percentile range."""
    on = " AND ".join(f"p.{k} = q.{k}" for k in keys.split(", "))
    return f"""
{name}_r AS (SELECT {keys}, quantile_cont(d, 0.01) AS lo, quantile_cont(d, 0.99) AS hi FROM {src}
  WHERE y % {stride} = 0 AND x % {stride} = 0 GROUP BY {keys}),
{name} AS (SELECT p.* REPLACE (greatest(0.0, least(1.0, (p.d - lo) / (CASE WHEN hi <= lo THEN 1e-6 ELSE hi - lo END))) AS d)
  FROM {src} p JOIN {name}_r q ON {on})"""


def zbuffer(src: str, strength: float, w: int, h: int, name: str = "zbuf", dist_col: str | None = None) -> str:
    """CTEs: nearest distance per target cell; ``src`` needs y, x and depth."""
    lam = dist_col or dist()
    b = -strength * 0.03
    u, v = uv("px", "py / norm", "pz", w, h)
    return f"""
{ray(src, w, h, name + "_ray")},
{name}_p AS (SELECT clip, f, {lam} * dx + {b} * dz AS px, {lam} * dy AS py, {lam} * dz - {b} * dx AS pz FROM {name}_ray),
{name}_n AS (SELECT *, sqrt(px*px + py*py + pz*pz) AS norm FROM {name}_p),
{name}_uv AS (SELECT clip, f, norm, CAST(floor({u}) AS INT) AS u0, greatest(-1, least({h - 1}, CAST(floor({v}) AS INT))) AS v0 FROM {name}_n),
{name} AS (
  SELECT clip, f, v0 + oy AS y, (((u0 + ox) % {w}) + {w}) % {w} AS x, min(norm) AS dist
  FROM {name}_uv, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(oy, ox)
  WHERE v0 + oy BETWEEN 0 AND {h - 1} GROUP BY 1, 2, 3, 4)"""


def box(expr: str, axis: str, k: int) -> str:
    across = "x" if axis == "y" else "y"
    return f"{expr} OVER (PARTITION BY clip, f, {across} ORDER BY {axis} ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"


def morph(src: str, col: str, out: str, k: int, op: str, name: str) -> str:
    return f"""
{name}_x AS (SELECT *, {box(f"{op}({col})", "x", k)} AS {out}_x FROM {src}),
{name} AS (SELECT * EXCLUDE ({out}_x), {box(f"{op}({out}_x)", "y", k)} AS {out} FROM {name}_x)"""


def cracks(z: str, grid: str, name: str = "closed") -> str:
    """CTEs: dense z-buffer (NULL for holes) with cracks closed."""
    return f"""
{name}_g AS (SELECT g.clip, g.f, g.y, g.x, z.dist FROM {grid} g LEFT JOIN {z} z USING (clip, f, y, x)),
{morph(name + "_g", "dist", "m", 1, "min", name + "_m")},
{name} AS (SELECT clip, f, y, x, CASE WHEN dist - m > 0.05 * m THEN m ELSE dist END AS dist FROM {name}_m)"""


def eye(src: str, strength: float, w: int, h: int, name: str = "eye") -> str:
    """CTEs: the synthesised eye from ``src`` (r, g, b, d in 0..1)."""
    b = strength * 0.03
    u, v = uv("px", "py / need", "pz", w, h)
    near_x = f"((CAST(round_even(a.u, 0) AS INT) % {w}) + {w}) % {w}"
    near_y = f"CAST(round_even(greatest(0.0, least({h - 1}.0, a.v)), 0) AS INT)"
    return f"""
{zbuffer(src, strength, w, h, name + "_z")},
{cracks(name + "_z", src, name + "_cl")},
{ray(name + "_cl", w, h, name + "_br")},
{name}_bp AS (SELECT clip, f, y, x, dist, coalesce(dist, 1.0) * dx + {b} * dz AS px, coalesce(dist, 1.0) * dy AS py,
  coalesce(dist, 1.0) * dz - {b} * dx AS pz FROM {name}_br),
{name}_bn AS (SELECT *, sqrt(px*px + py*py + pz*pz) AS need FROM {name}_bp),
{name}_at AS (SELECT clip, f, y, x, dist, need, {u} AS u, {v} AS v FROM {name}_bn),
{bilinear(src, name + "_at", ["clip", "f"], ["r", "g", "b"], ["y", "x", "dist", "need", "u", "v"], w, h, True, name + "_smp")},
{name} AS (
  SELECT a.clip, a.f, a.y, a.x, a.dist IS NULL OR {dist("s.d")} < 0.9 * a.need AS hole,
         CASE WHEN a.dist IS NULL OR {dist("s.d")} < 0.9 * a.need THEN 0.0 ELSE a.r END AS r,
         CASE WHEN a.dist IS NULL OR {dist("s.d")} < 0.9 * a.need THEN 0.0 ELSE a.g END AS g,
         CASE WHEN a.dist IS NULL OR {dist("s.d")} < 0.9 * a.need THEN 0.0 ELSE a.b END AS b
  FROM {name}_smp a JOIN {src} s ON s.clip = a.clip AND s.f = a.f AND s.y = {near_y} AND s.x = {near_x})"""


def directional(src: str, w: int, sign: float, name: str = "filled") -> str:
    """CTEs: holes of ``src`` (hole_d) continued from the background side."""
    first, second = ("rx", "lx") if sign > 0 else ("lx", "rx")
    return f"""
{name}_e AS (
  SELECT *, max(CASE WHEN NOT hole_d THEN x END) OVER (PARTITION BY clip, f, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS lx,
         min(CASE WHEN NOT hole_d THEN x END) OVER (PARTITION BY clip, f, y ORDER BY x DESC ROWS UNBOUNDED PRECEDING) AS rx
  FROM {src}),
{name}_b AS (SELECT *, coalesce({first}, {second}) AS bound FROM {name}_e),
{name}_s AS (
  SELECT b.*, CASE WHEN m.hole_d THEN b.bound ELSE m.x END AS sx
  FROM {name}_b b LEFT JOIN {src} m ON m.clip = b.clip AND m.f = b.f AND m.y = b.y
       AND m.x = (((2 * b.bound - b.x) % {w}) + {w}) % {w}),
{name} AS (
  SELECT s.clip, s.f, s.y, s.x, s.hole, s.hole_d, s.hole_d AND s.bound IS NOT NULL AS done,
         CASE WHEN s.hole_d AND s.bound IS NOT NULL THEN q.r ELSE s.r END AS r,
         CASE WHEN s.hole_d AND s.bound IS NOT NULL THEN q.g ELSE s.g END AS g,
         CASE WHEN s.hole_d AND s.bound IS NOT NULL THEN q.b ELSE s.b END AS b
  FROM {name}_s s LEFT JOIN {src} q ON q.clip = s.clip AND q.f = s.f AND q.y = s.y AND q.x = s.sx)"""


def residual(src: str, depth: str, w: int, h: int, name: str = "res") -> str:
    """CTEs: what the directional fill of ``src`` (hole, hole_d, done) has left, painted from the block pyramid.

    Holes grow to the first ring with a depth contrast; near components that touch them
    may not be read from; only leftovers of frames with a true hole left are replaced.
    """
    on = lambda a, b, *more: " AND ".join(f"{a}.{k} = {b}.{k}" for k in ("clip", "f", *more))
    radii = [2, 6, 12, 24]
    grown, last = "", f"{name}_0"
    for i, r in list(enumerate(radii))[1:]:
        grown += f",{morph(last, 'hole', f'm{i}', r, 'bool_or', f'{name}_{i}')}"
        last = f"{name}_{i}"
    grown += f",{morph(last, 'hole', 'touch', 6, 'bool_or', f'{name}_w')}"
    lohi = ", ".join(f"min(d) FILTER (m{i} AND NOT hole) AS lo{i}, max(d) FILTER (m{i} AND NOT hole) AS hi{i}" for i in range(4))
    pick = "CASE WHEN hi0 - lo0 >= 1e-6 THEN 0 " + " ".join(f"WHEN hi{i} - lo{i} > 1e-6 THEN {i}" for i in (1, 2, 3)) + " WHEN lo0 IS NOT NULL THEN 0 END"
    mid = "CASE pick " + " ".join(f"WHEN {i} THEN 0.5 * (lo{i} + hi{i})" for i in range(4)) + " END"
    mask = "CASE pick " + " ".join(f"WHEN {i} THEN m{i}" for i in (1, 2, 3)) + " ELSE m0 END"
    levels = range(1, max(w, h).bit_length() + 1)
    means = ",".join(f"""
{name}_p{k} AS (SELECT clip, f, y >> {k} AS py, x >> {k} AS px, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM {name}_paint WHERE NOT paint GROUP BY ALL)""" for k in levels)
    joins = " ".join(f"LEFT JOIN {name}_p{k} p{k} ON {on('a', f'p{k}')} AND p{k}.py = a.y >> {k} AND p{k}.px = a.x >> {k}" for k in levels)
    value = lambda c: f"coalesce({', '.join(f'p{k}.{c}' for k in levels)}, a.{c}) AS {c}"
    out = lambda c: f"CASE WHEN s.hole_d AND NOT s.done THEN coalesce(v.{c}, s.{c}) ELSE s.{c} END AS {c}"
    return f"""
{name}_f AS (SELECT DISTINCT clip, f FROM {src} WHERE hole AND hole_d AND NOT done),
{name}_0 AS (SELECT s.clip, s.f, s.y, s.x, s.r, s.g, s.b, p.d, s.hole AND NOT s.done AS hole, s.hole_d AND NOT s.done AS m0
  FROM {src} s JOIN {name}_f USING (clip, f) JOIN {depth} p ON {on('s', 'p', 'y', 'x')}){grown},
{name}_s AS (SELECT clip, f, {lohi} FROM {name}_w GROUP BY clip, f),
{name}_t AS (SELECT clip, f, pick, {mid} AS threshold FROM (SELECT *, {pick} AS pick FROM {name}_s)),
{name}_n AS (SELECT w.*, {mask} AS mask, coalesce(NOT hole AND d > threshold, false) AS near FROM {name}_w w JOIN {name}_t USING (clip, f)),
{name}_far AS (SELECT clip, f FROM {name}_n GROUP BY clip, f HAVING bool_or(NOT hole AND NOT near)),
{name}_near AS (SELECT clip, f, y, x, touch FROM {name}_n JOIN {name}_far USING (clip, f) WHERE near),
{name}_b AS (
  SELECT clip, f, y, x FROM {name}_near WHERE touch
  UNION
  SELECT n.clip, n.f, n.y, n.x FROM {name}_b b JOIN {name}_near n ON {on('n', 'b')} AND n.y BETWEEN b.y - 1 AND b.y + 1 AND n.x BETWEEN b.x - 1 AND b.x + 1),
{name}_bd AS (SELECT DISTINCT clip, f, y, x, true AS blocked FROM {name}_b),
{name}_paint AS (SELECT n.*, mask OR coalesce(blocked, false) AS paint FROM {name}_n n LEFT JOIN {name}_bd USING (clip, f, y, x)),{means},
{name}_v AS (SELECT a.clip, a.f, a.y, a.x, {value('r')}, {value('g')}, {value('b')} FROM {name}_paint a {joins} WHERE paint),
{name} AS (SELECT s.* REPLACE ({out('r')}, {out('g')}, {out('b')}) FROM {src} s LEFT JOIN {name}_v v ON {on('s', 'v', 'y', 'x')})"""


def once(sql: str) -> str:
    """``sql`` with every CTE worked out once, however often it is read; recursive ones are anyway."""
    part = re.compile(r"(\b(\w+)(?:\([^()]*\))?) AS \((?=\s*(?:SELECT|VALUES))")
    own = {m[2] for m in part.finditer(sql) if re.search(rf"UNION(?: ALL)?\s+SELECT[^;]*?\b(?:FROM|JOIN) {m[2]}\b", sql[m.end() :].split(" AS (")[0])}
    return part.sub(lambda m: m[0] if m[2] in own else m[0].replace(" AS (", " AS MATERIALIZED ("), sql)
