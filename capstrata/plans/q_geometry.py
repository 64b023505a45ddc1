"""Queries over scalar geometry and grounded reference objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from capstrata.functions import geometry as G
from capstrata.functions.numeric import bottom_offset_interval, rational
from capstrata.operators import grounding as gd
from capstrata.operators.ordered import sequence_over
from capstrata.plans.q_timeseries import r6c
from capstrata.plans.registry import query, r6
from capstrata.policies import GroundingPolicy
from capstrata.session import stage

R = [f"w{i}{j}" for i in range(3) for j in range(3)]
DELTA = " + ".join(f"a.w{k}{i}*b.w{k}{i}" for i in range(3) for k in range(3))


@query("quaternion_pose", sql=f"""
    WITH e AS (SELECT vec_id, embedding[4]::DOUBLE AS w, embedding[5]::DOUBLE AS x, embedding[6]::DOUBLE AS y, embedding[7]::DOUBLE AS z FROM embeddings), n AS (SELECT *, sqrt(w*w+x*x+y*y+z*z) AS n FROM e)
    SELECT vec_id, {r6('n')} AS norm, abs(n - 1) <= 0.0001 AS norm_ok, {r6('1 - 2*((y/n)*(y/n) + (z/n)*(z/n))')} AS r00, {r6('2*((x/n)*(y/n) - (z/n)*(w/n))')} AS r01, {r6('2*((y/n)*(z/n) + (x/n)*(w/n))')} AS r21 FROM n""")
def quaternion_pose(v):
    q = [F.col("embedding")[i].cast("double") for i in (3, 4, 5, 6)]
    rot, n, ok = G.quaternion_to_pose(q, 1e-4)
    return v.table("embeddings").select("vec_id", n.alias("norm"), ok.alias("norm_ok"), rot[0][0].alias("r00"), rot[0][1].alias("r01"), rot[2][1].alias("r21")).select(
        "vec_id", *r6c("norm"), "norm_ok", *r6c("r00", "r01", "r21"))


@query("camera_inverse", "frame_poses", sql=f"""
    SELECT capture_id, rank, {r6('-(w00*px + w10*py + w20*pz)')} AS tx, {r6('-(w01*px + w11*py + w21*pz)')} AS ty, {r6('-(w02*px + w12*py + w22*pz)')} AS tz,
      {r6('w10')} AS r01, {r6('w21')} AS r12, false AS violation FROM frame_poses""")
def camera_inverse(v):
    w = [[F.col(f"w{i}{j}") for j in range(3)] for i in range(3)]
    r, t = G.camera_from_world(w, G.vec("px", "py", "pz"))
    return v.poses.select("capture_id", "rank", *[c.alias(n) for c, n in zip(t, ("tx", "ty", "tz"))], r[0][1].alias("r01"), r[1][2].alias("r12"), G.rigid_violation(w).alias("violation")).select(
        "capture_id", "rank", *r6c("tx", "ty", "tz", "r01", "r12"), "violation")


@query("projected_pixels", "track_points", "track_cameras", "track_obs", sql=f"""
    SELECT o.capture_id, o.point_id, o.rank, o.keypoint_index, {r6('fx * (x + tx) / (z + tz) + cx')} AS u, {r6('fy * (y + ty) / (z + tz) + cy')} AS v, {r6('z + tz')} AS depth FROM track_obs o
    JOIN track_points p ON p.capture_id = o.capture_id AND p.point_id = o.point_id JOIN track_cameras c ON c.capture_id = o.capture_id AND c.rank = o.rank""")
def projected_pixels(v):
    j = v.track_obs.drop("px", "py").join(v.track_points, ["capture_id", "point_id"]).join(v.track_cameras, ["capture_id", "rank"])
    a, b, d = G.project_pixel(G.vec("x", "y", "z"))
    return j.select("capture_id", "point_id", "rank", "keypoint_index", a.alias("u"), b.alias("v"), d.alias("depth")).select(
        "capture_id", "point_id", "rank", "keypoint_index", *r6c("u", "v", "depth"))


@query("backprojected_points", "depth_pixels", "depth_cameras", sql=f"""
    SELECT capture_id, image, y AS py, x AS px, {r6('(x + 0.5 - cx) / fx * z - tx')} AS wx, {r6('(y + 0.5 - cy) / fy * z - ty')} AS wy, {r6('z - tz')} AS wz FROM depth_pixels JOIN depth_cameras USING (capture_id, image)""")
def backprojected_points(v):
    w = G.backproject_pixel(F.col("x"), F.col("y"), F.col("z"))
    j = v.depth_pixels.join(v.depth_cameras, ["capture_id", "image"])
    return j.select("capture_id", "image", F.col("y").alias("py"), F.col("x").alias("px"), *[c.alias(f"w{n}") for c, n in zip(w, "xyz")]).select(
        "capture_id", "image", "py", "px", *r6c("wx", "wy", "wz"))


@query("pose_deltas", "frame_poses", sql=f"""
    SELECT b.capture_id, b.rank, {r6('sqrt((b.px-a.px)*(b.px-a.px)+(b.py-a.py)*(b.py-a.py)+(b.pz-a.pz)*(b.pz-a.pz))')} AS distance_m,
      {r6(f'degrees(acos(greatest(-1.0, least(1.0, ({DELTA} - 1) / 2))))')} AS angle_degrees FROM frame_poses a JOIN frame_poses b ON a.capture_id = b.capture_id AND b.rank = a.rank + 1""")
def pose_deltas(v):
    cols = ["px", "py", "pz", *R]
    seq = sequence_over(v.poses.select("capture_id", "rank", *cols), ["capture_id"], ["rank"], lag={f"_{c}": c for c in cols})
    rot = lambda p: [[F.col(f"{p}w{i}{j}") for j in range(3)] for i in range(3)]
    d, a = G.pose_delta(G.vec("_px", "_py", "_pz"), rot("_"), G.vec("px", "py", "pz"), rot(""))
    return seq.where("rank > 0").select("capture_id", "rank", d.alias("distance_m"), a.alias("angle_degrees")).select("capture_id", "rank", *r6c("distance_m", "angle_degrees"))


@query("canonical_planes", "planes", sql=f"""
    WITH p AS (SELECT capture_id, plane_index, -2 * a AS a, -2 * b AS b, -2 * c AS c, -2 * d AS d FROM planes), n AS (SELECT *, sqrt(a*a+b*b+c*c) AS n, greatest(abs(a), abs(b), abs(c)) AS t FROM p),
      s AS (SELECT *, CASE WHEN (CASE WHEN abs(a) = t THEN a WHEN abs(b) = t THEN b ELSE c END) < 0 THEN -1.0 ELSE 1.0 END AS s FROM n)
    SELECT capture_id, plane_index, {r6('a / n * s')} AS a, {r6('b / n * s')} AS b, {r6('c / n * s')} AS c, {r6('d / n * s')} AS d FROM s""")
def canonical_planes(v):
    p = v.planes.select("capture_id", "plane_index", *[(-2 * F.col(c)).alias(c) for c in "abcd"])
    n, d = G.canonical_plane(G.vec("a", "b", "c"), F.col("d"))
    return p.select("capture_id", "plane_index", n[0].alias("a"), n[1].alias("b"), n[2].alias("c"), d.alias("d")).select("capture_id", "plane_index", *r6c("a", "b", "c", "d"))


POLY = """SELECT p_partkey AS id, [{'x': x0, 'y': y0}, {'x': x0 + w, 'y': y0 + k}, {'x': x0 + w + k, 'y': y0 + h}, {'x': x0, 'y': y0 + h}] AS poly, x0, y0, w, h, k FROM
    (SELECT p_partkey, CAST(p_partkey % 90 AS DOUBLE) AS x0, CAST(p_partkey % 70 AS DOUBLE) AS y0, CAST(p_size % 13 AS DOUBLE) AS w, CAST(p_size % 11 AS DOUBLE) AS h, CAST(p_partkey % 4 AS DOUBLE) AS k FROM part)"""


def polygons(v):
    d = lambda c: c.cast("double")
    p = v.table("part").select(F.col("p_partkey").alias("id"), d(F.col("p_partkey") % 90).alias("x0"), d(F.col("p_partkey") % 70).alias("y0"),
                               d(F.col("p_size") % 13).alias("w"), d(F.col("p_size") % 11).alias("h"), d(F.col("p_partkey") % 4).alias("k"))
    x, y, w, h, k = G.vec("x0", "y0", "w", "h", "k")
    at = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return p.withColumn("polygon", F.array(at(x, y), at(x + w, y + k), at(x + w + k, y + h), at(x, y + h)))


_E = [("w", "k"), ("k", "h - k"), ("-(w + k)", "0"), ("0", "-h")]
_CROSS = [f"(({a[0]})*({b[1]}) - ({a[1]})*({b[0]}))" for a, b in zip(_E, _E[1:] + _E[:1])]
_LEN = [f"sqrt(({a})*({a}) + ({b})*({b}))" for a, b in _E]
_CORNERS = [("x0", "y0"), ("x0 + w", "y0 + k"), ("x0 + w + k", "y0 + h"), ("x0", "y0 + h")]


@query("polygon_validity", sql=f"""
    SELECT id, {' AND '.join(f'{x} BETWEEN 0 AND 100 AND {y} BETWEEN 0 AND 75' for x, y in _CORNERS)} AND least({', '.join(_LEN)}) >= 2 AND (least({', '.join(_CROSS)}) > 1e-6 OR greatest({', '.join(_CROSS)}) < -1e-6) AS region_ok,
      {' AND '.join(f'{x} >= 0 AND {x} < 100 AND {y} >= 0 AND {y} < 75' for x, y in _CORNERS)} AND least({', '.join(_LEN)}) >= 5 AND (least({', '.join(_CROSS)}) > 1 OR greatest({', '.join(_CROSS)}) < -1) AS corners_ok FROM ({POLY})""")
def polygon_validity(v):
    w, h = F.lit(100.0), F.lit(75.0)
    return polygons(v).select("id", G.valid_polygon(F.col("polygon"), w, h).alias("region_ok"), G.valid_polygon(F.col("polygon"), w, h, corners=True).alias("corners_ok"))


_TURN = [f"(({e[0]}) * (gy - ({c[1]})) - ({e[1]}) * (gx - ({c[0]})))" for e, c in zip(_E, _CORNERS)]


@query("points_in_polygon", sql=f"""
    SELECT id, least({', '.join(_TURN)}) >= -1e-9 OR greatest({', '.join(_TURN)}) <= 1e-9 AS inside FROM (SELECT *, x0 + (id % 9) / CAST(2 AS DOUBLE) AS gx, y0 + (id % 7) / CAST(2 AS DOUBLE) AS gy FROM ({POLY}))""")
def points_in_polygon(v):
    p = polygons(v).withColumn("gx", F.col("x0") + (F.col("id") % 9) / 2).withColumn("gy", F.col("y0") + (F.col("id") % 7) / 2)
    return p.select("id", G.in_convex_polygon(F.col("gx"), F.col("gy"), F.col("polygon")).alias("inside"))


@query("grid_rescale", sql=f"""
    SELECT p_partkey AS id, {r6('CAST(p_partkey % 320 AS DOUBLE) * (640 + p_size) / 320')} AS x, {r6('CAST(p_partkey % 240 AS DOUBLE) * (480 + p_size) / 240')} AS y,
      CASE WHEN (640 + p_size) * 30 = (480 + p_size) * 40 THEN round((640 + p_size) / CAST(40 AS DOUBLE), 6) END AS scale_x, CASE WHEN p_partkey % 8 <> 0 THEN p_size / CAST(p_partkey % 8 AS DOUBLE) END AS focal FROM part""")
def grid_rescale(v):
    k, s = F.col("p_partkey"), F.col("p_size")
    x, y = G.rescale_grid((k % 320).cast("double"), (k % 240).cast("double"), [F.lit(320), F.lit(240)], [640 + s, 480 + s])
    sx, _ = G.grid_scale_between(640 + s, 480 + s, F.lit(40), F.lit(30))
    return v.table("part").select(k.alias("id"), x.alias("x"), y.alias("y"), sx.alias("scale_x"), rational(s, k % 8).alias("focal")).select("id", *r6c("x", "y"), "scale_x", "focal")


# --- grounding ----------------------------------------------------------------
# One object per customer: a rectangle at depth 3, seen from every order's position.

POLICY = GroundingPolicy(max_reprojection_pixels=2.5)
MARKS = """SELECT o_custkey AS capture_id, o_custkey AS object_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, o_orderkey AS k,
    ((o_orderkey * 7) % 41 - 20) * CAST(0.05 AS DOUBLE) AS ox, ((o_orderkey * 3) % 11 - 5) * CAST(0.05 AS DOUBLE) AS oy FROM orders"""
CORNERS = f"""SELECT capture_id, object_id, rank, c AS corner, 500 * (qx - ox) / 3 + 320 + ((k * (c + 1)) % 9 - 4) * CAST(0.25 AS DOUBLE) AS px, 500 * (qy - oy) / 3 + 240 + ((k * (c + 2)) % 7 - 3) * CAST(0.25 AS DOUBLE) AS py, ox, oy FROM
    (SELECT *, CASE WHEN c IN (1, 2) THEN 0.3 ELSE 0.0 END::DOUBLE AS qx, CASE WHEN c IN (2, 3) THEN 0.2 ELSE 0.0 END::DOUBLE AS qy FROM ({MARKS}), range(4) r(c))"""


def marks(v):
    k = F.col("o_orderkey")
    m = sequence_over(v.table("orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], rank="_r")
    return stage(m.select(F.col("o_custkey").alias("capture_id"), F.col("o_custkey").alias("object_id"), (F.col("_r") + 1).alias("rank"), k.alias("k"),
                          (((k * 7) % 41 - 20) * 0.05).alias("ox"), (((k * 3) % 11 - 5) * 0.05).alias("oy")))


def marked(v):
    m = marks(v)
    c, k = F.col("corner"), F.col("k")
    corners = m.withColumn("corner", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))))
    qx, qy = F.when(c.isin(1, 2), 0.3).otherwise(0.0), F.when(c.isin(2, 3), 0.2).otherwise(0.0)
    corners = corners.select("capture_id", "object_id", "rank", "corner", (500 * (qx - F.col("ox")) / 3 + 320 + ((k * (c + 1)) % 9 - 4) * 0.25).alias("px"),
                             (500 * (qy - F.col("oy")) / 3 + 240 + ((k * (c + 2)) % 7 - 3) * 0.25).alias("py"))
    lit = lambda x, n: F.lit(x).alias(n)
    cams = m.select("capture_id", "rank", lit(500.0, "fx"), lit(500.0, "fy"), lit(320.0, "cx"), lit(240.0, "cy"), *[lit(1.0 if i == j else 0.0, f"r{i}{j}") for i in range(3) for j in range(3)],
                    (-F.col("ox")).alias("tx"), (-F.col("oy")).alias("ty"), lit(0.0, "tz"), "ox", "oy", lit(0.0, "oz"))
    return corners, cams


def _solve(source, keys, shift="0"):
    ks = ", ".join(keys)
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    return f"""WITH d AS MATERIALIZED (SELECT *, (px - 320 - {shift}) / 500 AS x0, (py - 240 - {shift}) / 500 AS y0, sqrt(((px - 320 - {shift}) / 500)^2 + ((py - 240 - {shift}) / 500)^2 + 1) AS n FROM ({source})),
      r AS MATERIALIZED (SELECT *, x0/n AS rx, y0/n AS ry, 1/n AS rz FROM d),
      s AS (SELECT {ks}, corner, count(DISTINCT rank) AS views, sum(1 - rx*rx) AS a, sum(-rx*ry) AS b, sum(-rx*rz) AS c, sum(1 - ry*ry) AS e, sum(-ry*rz) AS f, sum(1 - rz*rz) AS g,
        sum(ox - rx*(rx*ox + ry*oy)) AS p, sum(oy - ry*(rx*ox + ry*oy)) AS q, sum(-rz*(rx*ox + ry*oy)) AS t FROM r GROUP BY {ks}, corner),
      w AS (SELECT {', '.join('a.' + k for k in keys)}, a.corner, degrees(acos(greatest(-1.0, least(1.0, min(abs(a.rx*b.rx + a.ry*b.ry + a.rz*b.rz)))))) AS angle FROM r a JOIN r b ON {on} AND a.corner = b.corner AND a.rank < b.rank GROUP BY ALL),
      x AS (SELECT s.*, coalesce(angle, 0) AS angle, a*(e*g - f*f) - b*(b*g - f*c) + c*(b*f - e*c) AS det FROM s LEFT JOIN w USING ({ks}, corner))
    SELECT {ks}, corner, views, angle, CASE WHEN views < 3 THEN 'INSUFFICIENT_OBSERVATIONS' WHEN angle < 1.5 THEN 'INSUFFICIENT_PARALLAX' ELSE 'SOLVED' END AS corner_status,
      (p*(e*g - f*f) - b*(q*g - f*t) + c*(q*f - e*t)) / nullif(det, 0) AS x, (a*(q*g - f*t) - p*(b*g - f*c) + c*(b*t - q*c)) / nullif(det, 0) AS y, (a*(e*t - q*f) - b*(b*t - q*c) + p*(b*f - e*c)) / nullif(det, 0) AS z FROM x"""


SOLVED = _solve(CORNERS, ["capture_id", "object_id"])
ERRORS = f"""SELECT c.capture_id, c.object_id, c.rank, c.corner, sqrt((500*(x - ox)/z + 320 - px)^2 + (500*(y - oy)/z + 240 - py)^2) AS error_px, z AS depth FROM ({CORNERS}) c JOIN ({SOLVED}) s
    ON s.capture_id = c.capture_id AND s.object_id = c.object_id AND s.corner = c.corner WHERE corner_status = 'SOLVED'"""
STATES = f"""SELECT capture_id, object_id, views, angle, worst, CASE WHEN few THEN 'INSUFFICIENT_OBSERVATIONS' WHEN flat THEN 'INSUFFICIENT_PARALLAX' WHEN near > 0 AND worst <= 2.5 THEN 'TRIANGULATED' ELSE 'DISAGREEMENT_REVIEW_REQUIRED' END AS state FROM
    (SELECT capture_id, object_id, min(views) AS views, min(angle) AS angle, bool_or(corner_status = 'INSUFFICIENT_OBSERVATIONS') AS few, bool_or(corner_status = 'INSUFFICIENT_PARALLAX') AS flat FROM ({SOLVED}) GROUP BY ALL)
    LEFT JOIN (SELECT capture_id, object_id, max(error_px) AS worst, min(depth) AS near FROM ({ERRORS}) GROUP BY ALL) USING (capture_id, object_id)"""


def solved(v):
    corners, cams = marked(v)
    rays = stage(gd.corner_rays(corners, cams))
    s = stage(gd.triangulate(rays, policy=POLICY))
    return corners, cams, rays, s, gd.corner_errors(rays, s, cams)


@query("ray_triangulation", sql=f"""SELECT capture_id, object_id, corner, views, {r6('angle')} AS max_ray_angle_degrees, corner_status, {r6("CASE WHEN corner_status = 'SOLVED' THEN x END")} AS x,
    {r6("CASE WHEN corner_status = 'SOLVED' THEN y END")} AS y, {r6("CASE WHEN corner_status = 'SOLVED' THEN z END")} AS z FROM ({SOLVED})""")
def ray_triangulation(v):
    s = gd.triangulate(gd.corner_rays(*marked(v)), policy=POLICY)
    ok = F.col("corner_status") == "SOLVED"
    return s.select("capture_id", "object_id", "corner", "views", "max_ray_angle_degrees", "corner_status", *[F.when(ok, F.col(c)).alias(c) for c in "xyz"]).select(
        "capture_id", "object_id", "corner", "views", *r6c("max_ray_angle_degrees"), "corner_status", *r6c("x", "y", "z"))


@query("object_states", sql=f"SELECT capture_id, object_id, views, {r6('angle')} AS min_corner_angle_degrees, {r6('worst')} AS reprojection_max_px, state FROM ({STATES})")
def object_states(v):
    _, _, _, s, e = solved(v)
    return gd.object_state(s, e, policy=POLICY).select("capture_id", "object_id", "views", *r6c("min_corner_angle_degrees", "reprojection_max_px"), "state")


@query("residual_breakdown", sql=f"""
    SELECT capture_id, object_id, rank AS worst_rank, corner AS worst_corner, {r6('error_px')} AS worst_px, {', '.join(f'{r6(f"m{i}")} AS rms_corner_{i}' for i in range(4))} FROM
      (SELECT *, row_number() OVER (PARTITION BY capture_id, object_id ORDER BY error_px DESC, rank, corner) AS pos FROM ({ERRORS})) JOIN
      (SELECT capture_id, object_id, {', '.join(f'sqrt(avg(error_px*error_px) FILTER (corner = {i})) AS m{i}' for i in range(4))} FROM ({ERRORS}) GROUP BY ALL) USING (capture_id, object_id) WHERE pos = 1""")
def residual_breakdown(v):
    out = gd.residual_breakdown(stage(solved(v)[4]))
    return out.select("capture_id", "object_id", "worst_rank", "worst_corner", *r6c("worst_px", *[f"rms_corner_{i}" for i in range(4)]))


RECT = f"""SELECT capture_id, object_id, sqrt((x1-x0)^2+(y1-y0)^2+(z1-z0)^2) AS e0, sqrt((x2-x1)^2+(y2-y1)^2+(z2-z1)^2) AS e1, sqrt((x3-x2)^2+(y3-y2)^2+(z3-z2)^2) AS e2, sqrt((x0-x3)^2+(y0-y3)^2+(z0-z3)^2) AS e3,
      sqrt((x0-x2)^2+(y0-y2)^2+(z0-z2)^2) AS d0, (x0+x1+x2+x3)/4 AS mx, (y0+y1+y2+y3)/4 AS my, (z0+z1+z2+z3)/4 AS mz FROM
    (SELECT capture_id, object_id, {', '.join(f'max({c}) FILTER (corner = {i}) AS {c}{i}' for i in range(4) for c in 'xyz')} FROM ({SOLVED}) WHERE corner_status = 'SOLVED' GROUP BY ALL HAVING count(*) = 4)"""


def references(corners):
    return corners.select("capture_id", "object_id").distinct().select("capture_id", "object_id", F.lit(0.3).alias("width_m"), F.lit(0.2).alias("height_m"))


@query("rectangle_metrics", sql=f"""SELECT capture_id, object_id, {r6('e0')} AS width_edge_0_m, {r6('e1')} AS height_edge_0_m, {r6('d0')} AS diagonal_0_m, {r6('e0 / 0.3 - 1')} AS width_error_0, {r6('e3 / 0.2 - 1')} AS height_error_1,
    {r6('0.3 / ((e0 + e2) / 2)')} AS suggested_width_scale, {r6('mx')} AS center_x, {r6('mz')} AS center_z FROM ({RECT})""")
def rectangle_metrics(v):
    corners, _, _, s, _ = solved(v)
    return gd.object_rectangles(s, references(corners)).select("capture_id", "object_id", *r6c(
        "width_edge_0_m", "height_edge_0_m", "diagonal_0_m", "width_error_0", "height_error_1", "suggested_width_scale", "center_x", "center_z"))


def pose_views(v):
    m = marks(v)
    k = F.col("k")
    return m.select("capture_id", "object_id", "rank", (k % 50 != 0).alias("usable"), (k % 23 == 0).alias("ambiguous"), (F.lit(0.15) + (k % 5) * 0.006).alias("cx"), F.lit(0.1).alias("cy"),
                    F.lit(3.0).alias("cz"), F.lit(0.0).alias("nx"), ((k % 3) * 0.1).alias("ny"), F.sqrt(1 - ((k % 3) * 0.1) ** 2).alias("nz"))


@query("reference_state", sql=f"""
    WITH p AS (SELECT *, k % 50 <> 0 AS usable, k % 23 = 0 AS ambiguous, 0.15 + (k % 5) * CAST(0.006 AS DOUBLE) AS cx, (k % 3) * CAST(0.1 AS DOUBLE) AS ny FROM ({MARKS})),
      n AS (SELECT capture_id, object_id, count(*) AS marked, count(*) FILTER (usable) AS u, count(*) FILTER (ambiguous) AS am, max(cx) FILTER (usable) - min(cx) FILTER (usable) AS spread FROM p GROUP BY ALL),
      t AS (SELECT a.capture_id, a.object_id, degrees(acos(greatest(0.0, least(1.0, min(abs(a.ny*b.ny + sqrt(1-a.ny*a.ny)*sqrt(1-b.ny*b.ny))))))) AS turn FROM p a JOIN p b ON a.capture_id = b.capture_id AND a.rank < b.rank AND a.usable AND b.usable GROUP BY ALL),
      j AS (SELECT s.capture_id, s.object_id, state, greatest(abs(e0/0.3 - 1), abs(e2/0.3 - 1), abs(e1/0.2 - 1), abs(e3/0.2 - 1)) AS size_error, marked, u, am, coalesce(spread, 0) AS spread, coalesce(turn, 0) AS turn
            FROM ({STATES}) s LEFT JOIN ({RECT}) r USING (capture_id, object_id) LEFT JOIN n USING (capture_id, object_id) LEFT JOIN t USING (capture_id, object_id))
    SELECT capture_id, object_id, {r6('size_error')} AS size_error, u AS usable_views, am AS ambiguous_views, {r6('spread')} AS center_spread_m, {r6('turn')} AS normal_spread_degrees,
      CASE WHEN state <> 'TRIANGULATED' THEN state WHEN size_error > 0.05 OR u <> marked OR spread > 0.03 OR turn > 15 THEN 'DISAGREEMENT_REVIEW_REQUIRED' WHEN am > 0 THEN 'AMBIGUOUS_OBJECT_POSE' ELSE 'CONSISTENT_LOCAL_REFERENCE' END AS state FROM j""")
def reference_state(v):
    corners, _, _, s, e = solved(v)
    out = gd.reference_state(gd.object_state(s, e, policy=POLICY), gd.object_rectangles(s, references(corners)), stage(pose_views(v)), POLICY)
    return out.select("capture_id", "object_id", *r6c("size_error"), "usable_views", "ambiguous_views", *r6c("center_spread_m", "normal_spread_degrees"), "state")


HELD = f"""SELECT c.*, h.rank AS held_out_rank FROM ({CORNERS}) c JOIN ({MARKS}) h ON h.capture_id = c.capture_id WHERE c.rank <> h.rank AND c.capture_id IN (SELECT capture_id FROM ({MARKS}) GROUP BY ALL HAVING count(*) > 3)"""


@query("leave_one_out", sql=f"""
    WITH s AS MATERIALIZED ({_solve(HELD, ['capture_id', 'object_id', 'held_out_rank'])}),
      t AS (SELECT capture_id, object_id, held_out_rank, bool_and(corner_status = 'SOLVED') AS ok FROM s GROUP BY ALL),
      e AS (SELECT s.capture_id, s.object_id, held_out_rank, max(sqrt((500*(x - ox)/z + 320 - px)^2 + (500*(y - oy)/z + 240 - py)^2)) AS worst, min(z) AS near FROM s JOIN ({CORNERS}) c ON c.capture_id = s.capture_id AND c.corner = s.corner AND c.rank = held_out_rank GROUP BY ALL)
    SELECT capture_id, object_id, held_out_rank, CASE WHEN ok THEN 'TRIANGULATED' ELSE 'INSUFFICIENT' END AS training_state, {r6('CASE WHEN ok THEN worst END')} AS held_out_max_px, CASE WHEN ok THEN near > 0 END AS held_out_positive_depth
    FROM t LEFT JOIN e USING (capture_id, object_id, held_out_rank)""")
def leave_one_out(v):
    out = gd.leave_one_out(*marked(v), POLICY)
    return out.select("capture_id", "object_id", "held_out_rank", "training_state", *r6c("held_out_max_px"), "held_out_positive_depth")


def _shift_sql(s):
    sv = _solve(CORNERS, ["capture_id", "object_id"], f"({s})")
    return f"""SELECT capture_id, object_id, CAST({s} AS DOUBLE) AS shift, views, worst, few, flat, near FROM
      (WITH z AS MATERIALIZED ({sv}) SELECT * FROM (SELECT capture_id, object_id, min(views) AS views, bool_or(corner_status = 'INSUFFICIENT_OBSERVATIONS') AS few, bool_or(corner_status = 'INSUFFICIENT_PARALLAX') AS flat FROM z GROUP BY ALL)
       LEFT JOIN (SELECT z.capture_id, z.object_id, max(sqrt((500*(x - ox)/z.z + 320 + {s} - px)^2 + (500*(y - oy)/z.z + 240 + {s} - py)^2)) AS worst, min(z.z) AS near FROM z JOIN ({CORNERS}) c ON c.capture_id = z.capture_id AND c.corner = z.corner
         WHERE corner_status = 'SOLVED' GROUP BY ALL) USING (capture_id, object_id))"""


@query("pixel_shift_check", sql=f"""SELECT capture_id, object_id, shift, views, {r6('worst')} AS reprojection_max_px, CASE WHEN few THEN 'INSUFFICIENT_OBSERVATIONS' WHEN flat THEN 'INSUFFICIENT_PARALLAX'
    WHEN near > 0 AND worst <= 2.5 THEN 'TRIANGULATED' ELSE 'DISAGREEMENT_REVIEW_REQUIRED' END AS state FROM ({_shift_sql('-0.5')} UNION ALL {_shift_sql('0.5')})""")
def pixel_shift_check(v):
    return gd.pixel_shift_check(*marked(v), POLICY).select("capture_id", "object_id", "shift", "views", *r6c("reprojection_max_px"), "state")


@query("sensitivity_range")
def sensitivity_range(v):
    corners, cams = marked(v)
    return gd.sensitivity_range(corners, cams, references(corners), GroundingPolicy(sensitivity_trials=8, max_reprojection_pixels=8.0))


THICK = "SELECT s_suppkey AS id, s_nationkey - 12 AS ny, s_acctbal / 10000 AS off, CAST(0.0 AS DOUBLE) AS lo, (1 + s_suppkey % 9) / CAST(100 AS DOUBLE) AS hi, s_suppkey % 2 = 0 AS li, s_suppkey % 3 = 0 AS ui FROM supplier"


@query("thickness_interval", sql=f"""SELECT id, {r6('CASE WHEN ny < 0 THEN off - ny*lo WHEN ny = 0 THEN off ELSE off - ny*hi END')} AS lower_m, {r6('CASE WHEN ny < 0 THEN off - ny*hi WHEN ny = 0 THEN off ELSE off - ny*lo END')} AS upper_m,
    CASE WHEN ny < 0 THEN li WHEN ny = 0 THEN true ELSE ui END AS lower_inclusive, CASE WHEN ny < 0 THEN ui WHEN ny = 0 THEN true ELSE li END AS upper_inclusive FROM ({THICK})""")
def thickness_interval(v):
    k = F.col("s_suppkey")
    i = bottom_offset_interval(F.col("s_acctbal") / 10000, F.col("s_nationkey") - 12, F.lit(0.0), (1 + k % 9) / 100, k % 2 == 0, k % 3 == 0)
    return v.table("supplier").select(k.alias("id"), i.alias("i")).select("id", "i.*").select("id", *r6c("lower_m", "upper_m"), "lower_inclusive", "upper_inclusive")


@query("plane_comparison", sql=f"""
    WITH p AS (SELECT c_custkey AS capture_id, CAST(c_nationkey % 3 AS BIGINT) AS plane_index, c_acctbal / 10000 AS d FROM customer)
    SELECT r.capture_id, r.object_id, plane_index, {r6('my + d')} AS signed_distance_m, {r6('my + d - 0.01')} AS bottom_lower_m FROM ({RECT}) r JOIN p ON p.capture_id = r.capture_id""")
def plane_comparison(v):
    corners, _, _, s, _ = solved(v)
    rect = gd.object_rectangles(s, references(corners))
    planes = v.table("customer").select(F.col("c_custkey").alias("capture_id"), (F.col("c_nationkey") % 3).cast("bigint").alias("plane_index"), F.lit("horizontal").alias("orientation"),
                                        F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), F.lit(0.0).alias("c"), (F.col("c_acctbal") / 10000).alias("d"))
    thick = rect.select("capture_id", "object_id", F.lit(0.0).alias("lower_m"), F.lit(0.01).alias("upper_m"), F.lit(True).alias("lower_inclusive"), F.lit(False).alias("upper_inclusive"))
    out = gd.plane_comparison(rect, planes, thick)
    return out.select("capture_id", "object_id", "plane_index", "signed_distance_m", F.col("bottom.lower_m").alias("bottom_lower_m")).select(
        "capture_id", "object_id", "plane_index", *r6c("signed_distance_m", "bottom_lower_m"))
