"""Camera, plane and polygon geometry as Column builders.

A camera is flat columns: ``fx fy cx cy``, the rotation ``r00..r22`` and translation
``tx ty tz`` of camera-from-world, and the centre ``ox oy oz``. Everything stays inside
whole-stage code generation.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = list[Column]
AXES = range(3)


def vec(*names: str) -> Vec:
    return [F.col(n) for n in names]


def dot(a: Vec, b: Vec) -> Column:
    out = a[0] * b[0]
    for p, q in zip(a[1:], b[1:]):
        out = out + p * q
    return out


def cross(a: Vec, b: Vec) -> Vec:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Vec, b: Vec) -> Vec:
    return [p - q for p, q in zip(a, b)]


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(c, F.lit(hi)), F.lit(lo))


def clamp_between(c: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(F.least(c, hi), lo)


def rotation(prefix: str = "r") -> list[Vec]:
    return [[F.col(f"{prefix}{i}{j}") for j in AXES] for i in AXES]


def det3(m: list[Vec]) -> Column:
    return dot(m[0], cross(m[1], m[2]))


def solve3(m: list[Vec], b: Vec) -> Vec:
    """Cramer's rule for a 3x3 system; NULL when singular."""
    d = det3(m)
    safe = F.when(d != 0, d)
    out = []
    for j in AXES:
        replaced = [[b[i] if k == j else m[i][k] for k in AXES] for i in AXES]
        out.append(det3(replaced) / safe)
    return out


def with_extremes(df: DataFrame, m: list[list[str]], low: str, high: str) -> DataFrame:
    """Smallest and largest eigenvalue of a symmetric 3x3 matrix of columns.

    Trigonometric form, one named column per step, so no expression is repeated.
    """
    c = [[F.col(m[i][j]) for j in AXES] for i in AXES]
    df = df.withColumn("_q", (c[0][0] + c[1][1] + c[2][2]) / 3)
    q = F.col("_q")
    off = c[0][1] ** 2 + c[0][2] ** 2 + c[1][2] ** 2
    df = df.withColumn("_p", F.sqrt(((c[0][0] - q) ** 2 + (c[1][1] - q) ** 2 + (c[2][2] - q) ** 2 + 2 * off) / 6))
    shifted = [[c[i][j] - q if i == j else c[i][j] for j in AXES] for i in AXES]
    df = df.withColumn("_phi", F.acos(clamp(det3(shifted) / F.when(F.col("_p") > 0, F.col("_p") ** 3) / 2, -1.0, 1.0)) / 3)
    return (df.withColumn(low, F.coalesce(q + 2 * F.col("_p") * F.cos(F.col("_phi") + 2 * math.pi / 3), q))
            .withColumn(high, F.coalesce(q + 2 * F.col("_p") * F.cos("_phi"), q)).drop("_q", "_p", "_phi"))


def with_smallest_axis(df: DataFrame, m: list[list[str]], out: list[str]) -> DataFrame:
    """Unit eigenvector of the smallest eigenvalue: the longest cross product of two rows of M - low I."""
    df = with_extremes(df, m, "_low", "_high")
    rows = [[F.col(m[i][j]) - F.col("_low") if i == j else F.col(m[i][j]) for j in AXES] for i in AXES]
    for n, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        df = df.withColumns({f"_k{n}{a}": c for a, c in zip(AXES, cross(rows[i], rows[j]))})
    df = df.withColumns({f"_w{n}": dot(vec(*[f"_k{n}{a}" for a in AXES]), vec(*[f"_k{n}{a}" for a in AXES])) for n in AXES})
    w = vec("_w0", "_w1", "_w2")
    first = (w[0] >= w[1]) & (w[0] >= w[2])
    df = df.withColumns({f"_k{a}": F.when(first, F.col(f"_k0{a}")).when(w[1] >= w[2], F.col(f"_k1{a}")).otherwise(F.col(f"_k2{a}")) for a in AXES})
    df = df.withColumn("_size", F.sqrt(F.greatest(*w)))
    df = df.withColumns({o: F.col(f"_k{a}") / F.when(F.col("_size") > 0, F.col("_size")) for a, o in zip(AXES, out)})
    return df.drop("_low", "_high", "_size", *[f"_k{n}{a}" for n in AXES for a in AXES], *[f"_w{n}" for n in AXES], *[f"_k{a}" for a in AXES])


# --- poses -----------------------------------------------------------------

def quaternion_rotation(w: Column, x: Column, y: Column, z: Column) -> list[Vec]:
    """Rotation of an already normalised quaternion."""
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def quaternion_to_pose(q: Vec, tolerance: float) -> tuple[list[Vec], Column, Column]:
    """World-from-camera rotation, the source norm, and whether the norm is acceptable."""
    n = F.sqrt(dot(q, q))
    unit = [c / n for c in q]
    return quaternion_rotation(*unit), n, F.abs(n - 1) <= tolerance


def camera_from_world(r: list[Vec], t: Vec) -> tuple[list[Vec], Vec]:
    """Rigid inverse of a world-from-camera pose."""
    transposed = [[r[j][i] for j in AXES] for i in AXES]
    return transposed, [-dot(row, t) for row in transposed]


def rigid_violation(r: list[Vec]) -> Column:
    """True where a rotation is not orthonormal with determinant one (1e-8)."""
    bad = F.abs(det3(r) - 1) >= 1e-8
    for i in AXES:
        for j in AXES:
            column_dot = sum(r[k][i] * r[k][j] for k in AXES)
            bad = bad | (F.abs(column_dot - (1.0 if i == j else 0.0)) > 1e-8)
    return bad


def pinhole_violation(fx: Column, fy: Column) -> Column:
    return ~((fx > 0) & (fy > 0))


def pose_delta(ta: Vec, ra: list[Vec], tb: Vec, rb: list[Vec]) -> tuple[Column, Column]:
    """Distance in metres and rotation angle in degrees between two poses."""
    trace = sum(ra[k][i] * rb[k][i] for i in AXES for k in AXES)
    return norm(minus(tb, ta)), F.degrees(F.acos(clamp((trace - 1) / 2, -1.0, 1.0)))


# --- pixels ----------------------------------------------------------------

def _camera(prefix: str, of: Column | None) -> Callable[[str], Column]:
    """The fields of a camera: flat columns, or those of a struct such as an element of an array."""
    return lambda c: F.col(f"{prefix}{c}") if of is None else of[c]


def to_camera(xyz: Vec, prefix: str = "", of: Column | None = None) -> Vec:
    at = _camera(prefix, of)
    return [dot([at(f"r{i}{j}") for j in AXES], xyz) + at(f"t{a}") for i, a in enumerate("xyz")]


def project_pixel(xyz: Vec, prefix: str = "", of: Column | None = None) -> tuple[Column, Column, Column]:
    """Pixel and depth; the pixel is NULL where the depth is not usable."""
    o = to_camera(xyz, prefix, of)
    z = F.when(F.abs(o[2]) >= 1e-15, o[2])
    fx, fy, cx, cy = (_camera(prefix, of)(c) for c in ("fx", "fy", "cx", "cy"))
    return fx * o[0] / z + cx, fy * o[1] / z + cy, o[2]


def may_see(center: Vec, radius: float, min_depth: float = 0.0) -> Column:
    """False only where no point within ``radius`` of a world centre falls into the camera's image.

    Signed distances to the four side planes of the view and to the plane of least depth.
    """
    o = to_camera(center)
    reach = -radius * 1.001 - 1e-9
    inside = o[2] - min_depth >= reach
    for axis, f, c, size in ((0, "fx", "cx", "width"), (1, "fy", "cy", "height")):
        f, c, far = F.col(f), F.col(c), F.col(size) - F.col(c)
        inside = inside & ((f * o[axis] + c * o[2]) / F.sqrt(f * f + c * c) >= reach)
        inside = inside & ((far * o[2] - f * o[axis]) / F.sqrt(f * f + far * far) >= reach)
    return inside


def backproject_pixel(x: Column, y: Column, depth: Column, prefix: str = "") -> Vec:
    """World point of a pixel centre at an optical depth."""
    fx, fy, cx, cy = (F.col(f"{prefix}{c}") for c in ("fx", "fy", "cx", "cy"))
    o = [(x + 0.5 - cx) / fx * depth, (y + 0.5 - cy) / fy * depth, depth]
    r = [[F.col(f"{prefix}r{i}{j}") for j in AXES] for i in AXES]
    t = [F.col(f"{prefix}t{a}") for a in "xyz"]
    shifted = minus(o, t)
    return [sum(r[k][i] * shifted[k] for k in AXES) for i in AXES]


def pixel_direction(x: Column, y: Column, prefix: str = "", of: Column | None = None) -> Vec:
    """World direction through an image-edge coordinate, of any length."""
    at = _camera(prefix, of)
    o = [(x - at("cx")) / at("fx"), (y - at("cy")) / at("fy"), F.lit(1.0)]
    return [sum(at(f"r{k}{i}") * o[k] for k in AXES) for i in AXES]


def unit(d: Vec) -> Vec:
    n = norm(d)
    return [c / n for c in d]


def pixel_ray(x: Column, y: Column, prefix: str = "") -> Vec:
    """Unit world direction through an image-edge coordinate."""
    return unit(pixel_direction(x, y, prefix))


def rescale_grid(x: Column, y: Column, display: Vec, native: Vec) -> Vec:
    return [x * native[0] / display[0], y * native[1] / display[1]]


def grid_scale_between(w: Column, h: Column, dw: Column, dh: Column) -> tuple[Column, Column]:
    """RGB-to-depth scale only where the aspect ratios agree exactly."""
    ok = (dw > 0) & (dh > 0) & (w * dh == h * dw)
    return F.when(ok, F.round(w / dw, 6)), F.when(ok, F.round(h / dh, 6))


def sampson_residual(xa: Column, ya: Column, xb: Column, yb: Column,
                     rel_r: list[Vec], rel_t: Vec, ka: Vec, kb: Vec) -> Column:
    """First-order epipolar error of a match under supplied poses and intrinsics.

    ``rel`` maps camera a into camera b; ``ka``/``kb`` are fx, fy, cx, cy.
    """
    x, y, z = rel_t
    skew = [[F.lit(0.0), -z, y], [z, F.lit(0.0), -x], [-y, x, F.lit(0.0)]]
    essential = [[dot(skew[i], [rel_r[k][j] for k in AXES]) for j in AXES] for i in AXES]
    na = [(xa - ka[2]) / ka[0], (ya - ka[3]) / ka[1], F.lit(1.0)]
    nb = [(xb - kb[2]) / kb[0], (yb - kb[3]) / kb[1], F.lit(1.0)]
    la = [dot(essential[i], na) for i in AXES]
    lb = [sum(essential[k][j] * nb[k] for k in AXES) for j in AXES]
    gradient = ((la[0] / kb[0]) ** 2 + (la[1] / kb[1]) ** 2
                + (lb[0] / ka[0]) ** 2 + (lb[1] / ka[1]) ** 2)
    return F.sqrt(dot(nb, la) ** 2 / F.greatest(gradient, F.lit(1e-20)))


# --- planes ----------------------------------------------------------------

def canonical_plane(n: Vec, d: Column) -> tuple[Vec, Column]:
    """Unit normal whose first largest component is positive."""
    size = norm(n)
    a = [c / size for c in n]
    top = F.greatest(*[F.abs(c) for c in a])
    leading = F.when(F.abs(a[0]) == top, a[0]).when(F.abs(a[1]) == top, a[1]).otherwise(a[2])
    sign = F.when(leading < 0, -1.0).otherwise(1.0)
    return [c * sign for c in a], d / size * sign


def plane_basis(n: Vec) -> tuple[Vec, Vec]:
    """Tangent axes from the axis least aligned with the normal (first of ties)."""
    m = [F.abs(c) for c in n]
    least = F.least(*m)
    pick = [m[0] == least, (m[0] != least) & (m[1] == least), (m[0] != least) & (m[1] != least)]
    ref = [F.when(p, 1.0).otherwise(0.0) for p in pick]
    u = cross(n, ref)
    size = norm(u)
    u = [c / size for c in u]
    return u, cross(n, u)


def floor_axes(n: Vec) -> tuple[Vec, Vec]:
    """Floor u is the projected world X, v completes the frame around the upward normal."""
    u = [1 - n[0] * n[0], -n[0] * n[1], -n[0] * n[2]]
    size = norm(u)
    u = [c / F.when(size > 1e-6, size) for c in u]
    return u, cross(n, u)


def with_plane_line(df: DataFrame, start: list[str], direction: list[str]) -> DataFrame:
    """Line shared by a wall plane a, b, c, d and the floor frame; NULL when parallel.

    The first floor component of the direction that is not zero is positive. Each step is a
    named column, so the solve does not repeat the direction's expression.
    """
    n, w = vec("fn_x", "fn_y", "fn_z"), vec("a", "b", "c")
    o, u, v = (vec(*[f"f{k}_{a}" for a in "xyz"]) for k in "ouv")
    raw = ["_d0", "_d1", "_d2"]
    df = df.withColumns(dict(zip(raw, cross(n, w)))).withColumn("_size", norm(vec(*raw)))
    df = df.withColumns({r: F.col(r) / F.when(F.col("_size") >= 1e-6, F.col("_size")) for r in raw})
    df = df.withColumns({"_du": dot(vec(*raw), u), "_dv": dot(vec(*raw), v)})
    df = df.withColumn("_sign", F.when(F.when(F.abs("_du") > 1e-8, F.col("_du")).otherwise(F.col("_dv")) < 0, -1.0).otherwise(1.0))
    df = df.withColumns({d: F.col(r) * F.col("_sign") for d, r in zip(direction, raw)})
    d = vec(*direction)
    df = df.withColumn("_k", dot(d, o)).withColumn("_nf", -F.col("f_d")).withColumn("_nw", -F.col("d"))
    solved = solve3([n, w, d], vec("_nf", "_nw", "_k"))
    return df.withColumns(dict(zip(start, solved))).drop(*raw, "_size", "_du", "_dv", "_sign", "_k", "_nf", "_nw")


def orientation(ny: Column, degrees: float) -> Column:
    up = F.abs(ny)
    return (F.when(up >= math.cos(math.radians(degrees)), "horizontal")
            .when(up <= math.sin(math.radians(degrees)), "vertical").otherwise("oblique"))


def plane_role(orient: Column, camera_height: Column) -> Column:
    """Role hypothesis from orientation and the camera height above the plane."""
    return (F.when(orient == "vertical", "wall_or_furniture")
            .when((orient == "horizontal") & (camera_height >= 0.5), "floor_or_furniture")
            .when((orient == "horizontal") & (camera_height < -0.2), "ceiling_or_other")
            .when((orient == "horizontal") & camera_height.isNotNull(), "furniture_or_other")
            .otherwise("oblique_or_nonarchitectural"))


# --- polygons: array<struct<x,y>> --------------------------------------------

def _rotated(poly: Column) -> Column:
    """The polygon shifted by one corner, so that it pairs each corner with the next."""
    return F.concat(F.slice(poly, F.lit(2), F.size(poly) - 1), F.slice(poly, 1, 1))


def in_convex_polygon(x: Column, y: Column, poly: Column) -> Column:
    """Boundary included, either winding."""
    turns = F.zip_with(poly, _rotated(poly), lambda a, b:
                       (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]))
    return F.forall(turns, lambda c: c >= -1e-9) | F.forall(turns, lambda c: c <= 1e-9)


def in_polygon_even_odd(x: Column, y: Column, poly: Column) -> Column:
    """Ray casting for polygons of any shape."""
    hits = F.zip_with(poly, _rotated(poly), lambda a, b: F.when(
        ((a["y"] > y) != (b["y"] > y))
        & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0))
    return F.aggregate(hits, F.lit(0), lambda s, h: s + h) % 2 == 1


def valid_polygon(poly: Column, width: Column, height: Column, *, corners: bool = False) -> Column:
    """Strictly convex perimeter inside the image.

    Boundary regions have 3 to 16 corners with edges of 2 px or more; ``corners`` is the
    stricter four-corner form with edges of 5 px or more.
    """
    low, high = (4, 4) if corners else (3, 16)
    min_edge, min_turn = (5.0, 1.0) if corners else (2.0, 1e-6)
    nxt = _rotated(poly)
    edges = F.zip_with(poly, nxt, lambda a, b: F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y")))
    turns = F.zip_with(edges, _rotated(edges), lambda a, b: a["x"] * b["y"] - a["y"] * b["x"])

    def inside(p):
        top = (p["x"] < width) & (p["y"] < height) if corners else (p["x"] <= width) & (p["y"] <= height)
        return ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (p["x"] >= 0) & (p["y"] >= 0) & top

    return (F.size(poly).between(low, high) & F.forall(poly, inside)
            & F.forall(edges, lambda e: F.sqrt(e["x"] * e["x"] + e["y"] * e["y"]) >= min_edge)
            & (F.forall(turns, lambda t: t > min_turn) | F.forall(turns, lambda t: t < -min_turn)))


def rectangle_metrics(corners: list[Vec], width: Column, height: Column) -> dict[str, Column]:
    """Edge lengths, relative errors and suggested scales of a measured rectangle."""
    edges = [norm(minus(corners[(i + 1) % 4], corners[i])) for i in range(4)]
    return {
        "width_edge_0_m": edges[0], "width_edge_1_m": edges[2],
        "height_edge_0_m": edges[1], "height_edge_1_m": edges[3],
        "diagonal_0_m": norm(minus(corners[0], corners[2])),
        "diagonal_1_m": norm(minus(corners[1], corners[3])),
        "declared_diagonal_m": F.hypot(width, height),
        "width_error_0": edges[0] / width - 1, "width_error_1": edges[2] / width - 1,
        "height_error_0": edges[1] / height - 1, "height_error_1": edges[3] / height - 1,
        "suggested_width_scale": width / ((edges[0] + edges[2]) / 2),
        "suggested_height_scale": height / ((edges[1] + edges[3]) / 2),
    }
