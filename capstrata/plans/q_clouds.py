"""Queries over clouds, planes, boundaries and rooms."""

from __future__ import annotations

from pyspark.sql import functions as F

from capstrata.operators import boundaries as bd
from capstrata.operators import integrity as ig
from capstrata.operators import room as rm
from capstrata.operators import surfaces as sf
from capstrata.operators.graph import cell_components
from capstrata.plans.q_timeseries import r6c
from capstrata.plans.registry import query, r6
from capstrata.policies import BoundaryPolicy, CeilingPolicy, PlanPolicy, RoomPolicy, SurfacePolicy
from capstrata.session import stage

SURFACE = SurfacePolicy(min_view_samples=5)
BOUNDARY = BoundaryPolicy(min_points_per_view=3)
WALL_DISTANCE = 0.035


@query("voxel_average", "cloud", sql=f"""
    SELECT capture_id, CAST(floor(x / 0.25) AS BIGINT) AS vx, CAST(floor(y / 0.25) AS BIGINT) AS vy, CAST(floor(z / 0.25) AS BIGINT) AS vz,
      {r6('avg(x)')} AS x, {r6('avg(y)')} AS y, {r6('avg(z)')} AS z, CAST(round_even(avg(r), 0) AS BIGINT) AS r,
      CAST(round_even(avg(g), 0) AS BIGINT) AS g, CAST(round_even(avg(b), 0) AS BIGINT) AS b, count(*) AS n FROM cloud GROUP BY 1, 2, 3, 4""")
def voxel_average(v):
    out = sf.voxel_average(v.cloud, 0.25)
    return out.select("capture_id", "vx", "vy", "vz", *r6c("x", "y", "z"), "r", "g", "b", "n")


LABELS = """SELECT capture_id, rank, x, y, z, CASE WHEN best.e <= 0.035 THEN best.p ELSE -1 END AS plane_index, best.e AS residual FROM
    (SELECT c.capture_id, c.rank, c.x, c.y, c.z,
       list_min(list_transform(ps, lambda q: {'e': abs(q.a * c.x + q.b * c.y + q.c * c.z + q.d), 'p': q.i})) AS best
     FROM cloud c LEFT JOIN (SELECT capture_id, list({'i': plane_index, 'a': a, 'b': b, 'c': c, 'd': d}) AS ps FROM planes GROUP BY ALL) USING (capture_id))"""


def labels(v):
    return stage(sf.plane_labels(v.cloud, v.planes, WALL_DISTANCE).select("capture_id", "rank", "x", "y", "z", "plane_index", "residual"))


@query("plane_labels", "cloud", "planes", sql=f"""
    SELECT capture_id, plane_index, count(*) AS points, {r6('max(residual)')} AS worst, {r6('min(residual)')} AS best FROM ({LABELS}) GROUP BY ALL""")
def plane_labels(v):
    out = sf.plane_labels(v.cloud, v.planes, WALL_DISTANCE).groupBy("capture_id", "plane_index").agg(
        F.count("*").alias("points"), F.max("residual").alias("worst"), F.min("residual").alias("best"))
    return out.select("capture_id", "plane_index", "points", *r6c("worst", "best"))


VIEWS = f"""SELECT capture_id, rank, plane_index, count(*) AS samples, count(*) / CAST(any_value(n) AS DOUBLE) AS fraction,
      quantile_cont(residual, 0.5) AS residual_median_m, quantile_cont(residual, 0.9) AS residual_p90_m
    FROM (SELECT *, count(*) OVER (PARTITION BY capture_id, rank) AS n FROM ({LABELS})) WHERE plane_index >= 0 GROUP BY capture_id, rank, plane_index"""


@query("plane_view_samples", "cloud", "planes", sql=f"""SELECT capture_id, rank, plane_index, samples, {r6('fraction')} AS fraction,
    {r6('residual_median_m')} AS residual_median_m, {r6('residual_p90_m')} AS residual_p90_m FROM ({VIEWS})""")
def plane_view_samples(v):
    return sf.plane_view_samples(labels(v)).select("capture_id", "rank", "plane_index", "samples", *r6c("fraction", "residual_median_m", "residual_p90_m"))


@query("view_assignment", "cloud", "planes", sql=f"""
    SELECT capture_id, rank, count(*) AS accepted_samples, count(*) FILTER (plane_index < 0) AS unassigned_samples FROM ({LABELS}) GROUP BY ALL""")
def view_assignment(v):
    return sf.view_assignment(sf.plane_labels(v.cloud, v.planes, WALL_DISTANCE))


# tangent axes follow from the axis least aligned with the normal, first of ties
BASIS = """SELECT capture_id, plane_index, ux/n AS ux, uy/n AS uy, uz/n AS uz, b*(uz/n) - c*(uy/n) AS vx, c*(ux/n) - a*(uz/n) AS vy, a*(uy/n) - b*(ux/n) AS vz FROM
    (SELECT *, sqrt(ux*ux + uy*uy + uz*uz) AS n FROM (SELECT capture_id, plane_index, a, b, c, b*e2 - c*e1 AS ux, c*e0 - a*e2 AS uy, a*e1 - b*e0 AS uz FROM
      (SELECT *, CASE WHEN abs(a) = m THEN 1.0 ELSE 0.0 END AS e0, CASE WHEN abs(a) <> m AND abs(b) = m THEN 1.0 ELSE 0.0 END AS e1,
         CASE WHEN abs(a) <> m AND abs(b) <> m THEN 1.0 ELSE 0.0 END AS e2 FROM (SELECT *, least(abs(a), abs(b), abs(c)) AS m FROM planes))))"""
TANGENT = f"""SELECT l.*, x*ux + y*uy + z*uz AS pu, x*vx + y*vy + z*vz AS pv FROM ({LABELS}) l JOIN ({BASIS}) s USING (capture_id, plane_index)"""
CELLS = f"""SELECT capture_id, plane_index, CAST(floor(pu / 0.15) AS BIGINT) AS cx, CAST(floor(pv / 0.15) AS BIGINT) AS cy, count(*) AS n
    FROM ({TANGENT}) GROUP BY capture_id, plane_index, cx, cy"""


@query("occupied_cells", "cloud", "planes", sql=CELLS)
def occupied_cells(v):
    return sf.occupied_cells(sf.tangent_coordinates(sf.plane_labels(v.cloud, v.planes, WALL_DISTANCE), v.planes), 0.15)


@query("patch_extent", "cloud", "planes", sql=f"""
    SELECT capture_id, plane_index, cells, {r6('cells * 0.0225')} AS occupied_area_m2, {r6('a')} AS pu_min, {r6('b')} AS pv_min, {r6('su')} AS span_u_m, {r6('sv')} AS span_v_m
    FROM (SELECT capture_id, plane_index, min(pu) AS a, min(pv) AS b, max(pu) - min(pu) AS su, max(pv) - min(pv) AS sv FROM ({TANGENT}) GROUP BY ALL)
    JOIN (SELECT capture_id, plane_index, count(*) AS cells FROM ({CELLS}) GROUP BY ALL) USING (capture_id, plane_index)""")
def patch_extent(v):
    t = stage(sf.tangent_coordinates(labels(v), v.planes))
    return sf.patch_extent(t, sf.occupied_cells(t, 0.15), 0.15).select(
        "capture_id", "plane_index", "cells", *r6c("occupied_area_m2", "pu_min", "pv_min", "span_u_m", "span_v_m"))


# component label of each cell by repeated minimum over the 8 neighbours, on packed cell numbers
COMPONENTS = f"""WITH RECURSIVE c AS MATERIALIZED (SELECT capture_id, plane_index, cx, cy, (cx + 100000) * 1000000 + cy + 100000 AS id FROM ({CELLS})),
      e AS MATERIALIZED (SELECT a.capture_id, a.plane_index, a.id AS a, b.id AS b FROM c a JOIN c b ON a.capture_id = b.capture_id AND a.plane_index = b.plane_index
        AND b.cx BETWEEN a.cx - 1 AND a.cx + 1 AND b.cy BETWEEN a.cy - 1 AND a.cy + 1),
      walk AS (SELECT 0 AS step, capture_id, plane_index, id, id AS root FROM c UNION ALL
        SELECT step + 1, e.capture_id, e.plane_index, e.a, min(root) FROM walk w JOIN e ON e.capture_id = w.capture_id AND e.plane_index = w.plane_index AND e.b = w.id
        WHERE step < 120 GROUP BY step, e.capture_id, e.plane_index, e.a)
    SELECT c.capture_id, c.plane_index, c.cx, c.cy, root // 1000000 - 100000 AS root_x, root % 1000000 - 100000 AS root_y
    FROM c JOIN walk w ON w.capture_id = c.capture_id AND w.plane_index = c.plane_index AND w.id = c.id AND step = 120"""


@query("cell_components", "cloud", "planes", sql=COMPONENTS)
def cell_components_query(v):
    cells = sf.occupied_cells(sf.tangent_coordinates(sf.plane_labels(v.cloud, v.planes, WALL_DISTANCE), v.planes), 0.15)
    return cell_components(stage(cells), ["capture_id", "plane_index"])


PATCHES = f"""SELECT capture_id, plane_index, root_x, root_y, count(*) AS cells, (max(cx) - min(cx) + 1) * CAST(0.15 AS DOUBLE) AS span_u_m,
      (max(cy) - min(cy) + 1) * CAST(0.15 AS DOUBLE) AS span_v_m, row_number() OVER (PARTITION BY capture_id, plane_index ORDER BY count(*) DESC, root_x, root_y) - 1 AS component
    FROM ({COMPONENTS}) GROUP BY capture_id, plane_index, root_x, root_y"""


@query("patch_components", "cloud", "planes", sql=f"""SELECT capture_id, plane_index, root_x, root_y, cells, {r6('span_u_m')} AS span_u_m, {r6('span_v_m')} AS span_v_m, component FROM ({PATCHES})""")
def patch_components(v):
    cells = stage(sf.occupied_cells(sf.tangent_coordinates(labels(v), v.planes), 0.15))
    return sf.patch_components(cells, 0.15).select("capture_id", "plane_index", "root_x", "root_y", "cells", *r6c("span_u_m", "span_v_m"), "component")


SUPPORT = f"""WITH l AS MATERIALIZED ({LABELS}), vs AS MATERIALIZED ({VIEWS}),
      q AS (SELECT capture_id, plane_index, count(*) AS voxel_points, quantile_cont(residual, 0.5) AS rm, quantile_cont(residual, 0.9) AS rp, median(y) AS my FROM l WHERE plane_index >= 0 GROUP BY ALL),
      eye AS (SELECT capture_id, median(oy) AS eye FROM stations GROUP BY ALL),
      g AS (SELECT capture_id, plane_index, rank, ox, oy, oz FROM vs JOIN stations USING (capture_id, rank) WHERE samples >= 5),
      n AS (SELECT capture_id, plane_index, count(*) AS qualified FROM g GROUP BY ALL),
      w AS (SELECT a.capture_id, a.plane_index, max(sqrt((a.ox-b.ox)*(a.ox-b.ox)+(a.oy-b.oy)*(a.oy-b.oy)+(a.oz-b.oz)*(a.oz-b.oz))) AS base
            FROM (SELECT DISTINCT capture_id, plane_index, ox, oy, oz FROM g) a JOIN (SELECT DISTINCT capture_id, plane_index, ox, oy, oz FROM g) b
            ON a.capture_id = b.capture_id AND a.plane_index = b.plane_index GROUP BY ALL),
      s AS (SELECT capture_id, plane_index, least(span_u_m, span_v_m) AS patch FROM ({PATCHES}) WHERE component = 0),
      j AS (SELECT p.*, coalesce(voxel_points, 0) AS voxel_points, rm, rp, my, eye - my AS cam, coalesce(qualified, 0) AS qualified, coalesce(base, 0) AS base, coalesce(patch, 0) AS patch,
              CASE WHEN abs(p.b) >= cos(radians(15)) THEN 'horizontal' WHEN abs(p.b) <= sin(radians(15)) THEN 'vertical' ELSE 'oblique' END AS orientation
            FROM planes p LEFT JOIN q USING (capture_id, plane_index) LEFT JOIN eye USING (capture_id) LEFT JOIN n USING (capture_id, plane_index)
            LEFT JOIN w USING (capture_id, plane_index) LEFT JOIN s USING (capture_id, plane_index)),
      r AS (SELECT *, CASE WHEN orientation = 'vertical' THEN 'wall_or_furniture' WHEN orientation = 'horizontal' AND cam >= 0.5 THEN 'floor_or_furniture'
              WHEN orientation = 'horizontal' AND cam < -0.2 THEN 'ceiling_or_other' WHEN orientation = 'horizontal' AND cam IS NOT NULL THEN 'furniture_or_other'
              ELSE 'oblique_or_nonarchitectural' END AS role FROM j)
    SELECT *, concat_ws(';', CASE WHEN qualified < 3 THEN 'INSUFFICIENT_SELECTED_VIEW_SUPPORT' END, CASE WHEN base < 0.15 THEN 'INSUFFICIENT_CAMERA_BASELINE' END,
      CASE WHEN patch < 0.75 THEN 'SMALL_OR_NARROW_CONNECTED_PATCH' END, CASE WHEN orientation = 'oblique' THEN 'NOT_GRAVITY_ALIGNED_ARCHITECTURAL_CANDIDATE' END,
      CASE WHEN role IN ('furniture_or_other', 'oblique_or_nonarchitectural') THEN 'NONARCHITECTURAL_OR_AMBIGUOUS_HEIGHT' END) AS flags FROM r"""


def support(v):
    lab = labels(v)
    vs = stage(sf.plane_view_samples(lab))
    comp = stage(sf.patch_components(stage(sf.occupied_cells(sf.tangent_coordinates(lab, v.planes), SURFACE.patch_cell_m)), SURFACE.patch_cell_m))
    return lab, sf.plane_support(lab, v.planes, v.stations, vs, comp, SURFACE)


@query("plane_support", "cloud", "planes", "stations", sql=f"""
    SELECT capture_id, plane_index, orientation, role, flags, CASE WHEN flags = '' THEN 'MULTIVIEW_CANDIDATE' ELSE 'WEAK' END AS evidence, voxel_points,
      {r6('rm')} AS residual_median_m, {r6('rp')} AS residual_p90_m, {r6('my')} AS median_y_m, {r6('cam')} AS camera_height_m, qualified AS qualified_views,
      {r6('base')} AS camera_baseline_m, {r6('patch')} AS patch_span_m FROM ({SUPPORT})""")
def plane_support(v):
    out = support(v)[1]
    return out.select("capture_id", "plane_index", "orientation", "role", F.array_join("flags", ";").alias("flags"), "evidence", "voxel_points",
                      *r6c("residual_median_m", "residual_p90_m", "median_y_m", "camera_height_m"), "qualified_views", *r6c("camera_baseline_m", "patch_span_m"))


@query("floor_choice", "cloud", "planes", "stations", sql=f"""
    SELECT capture_id, plane_index, {r6('cam')} AS camera_height_m FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY cam DESC, plane_index) AS pos
      FROM ({SUPPORT}) WHERE orientation = 'horizontal' AND flags = '' AND cam BETWEEN 0.3 AND 2.5 AND patch >= 1) WHERE pos = 1""")
def floor_choice(v):
    return sf.floor_choice(support(v)[1]).select("capture_id", "plane_index", *r6c("camera_height_m"))


@query("plane_views", "cloud", "planes", sql=f"""
    WITH vs AS (SELECT capture_id, plane_index, rank, samples, rank * CAST(0.05 AS DOUBLE) AS sec FROM ({VIEWS})),
      a AS (SELECT *, row_number() OVER (PARTITION BY capture_id, plane_index ORDER BY samples DESC, rank) AS pos FROM vs),
      p0 AS (SELECT * FROM a WHERE pos = 1),
      p1 AS (SELECT * FROM (SELECT a.*, row_number() OVER (PARTITION BY a.capture_id, a.plane_index ORDER BY a.samples DESC, a.rank) AS k FROM a JOIN p0 USING (capture_id, plane_index)
              WHERE abs(a.sec - p0.sec) >= 1) WHERE k = 1),
      p2 AS (SELECT * FROM (SELECT a.*, row_number() OVER (PARTITION BY a.capture_id, a.plane_index ORDER BY a.samples DESC, a.rank) AS k FROM a JOIN p0 USING (capture_id, plane_index)
              JOIN p1 USING (capture_id, plane_index) WHERE abs(a.sec - p0.sec) >= 1 AND abs(a.sec - p1.sec) >= 1) WHERE k = 1)
    SELECT capture_id, plane_index, rank, samples, 0 AS place FROM p0 UNION ALL SELECT capture_id, plane_index, rank, samples, 1 FROM p1
    UNION ALL SELECT capture_id, plane_index, rank, samples, 2 FROM p2""")
def plane_views(v):
    seconds = v.stations.select("capture_id", "rank", (F.col("rank") * 0.05).alias("relative_sec"))
    return sf.plane_views(stage(sf.plane_view_samples(labels(v))), seconds)


@query("plane_extraction", "cloud")
def plane_extraction(v):
    return sf.plane_extraction(v.cloud, SurfacePolicy(max_planes=4, iterations=128))


@query("trimmed_cloud", "cloud", sql=f"""
    WITH q AS (SELECT capture_id, quantile_cont(x, 0.02) AS x0, quantile_cont(x, 0.98) AS x1, quantile_cont(z, 0.02) AS z0, quantile_cont(z, 0.98) AS z1 FROM cloud GROUP BY ALL)
    SELECT capture_id, count(*) AS points, {r6('min(x)')} AS x_min, {r6('max(x)')} AS x_max, {r6('min(z)')} AS z_min, {r6('max(z)')} AS z_max
    FROM cloud JOIN q USING (capture_id) WHERE x BETWEEN x0 AND x1 AND z BETWEEN z0 AND z1 GROUP BY ALL""")
def trimmed_cloud(v):
    t = sf.trim_quantiles(v.cloud, ["x", "z"], 0.02)
    out = t.groupBy("capture_id").agg(F.count("*").alias("points"), *[f(c).alias(f"{c}_{n}") for c in "xz" for n, f in (("min", F.min), ("max", F.max))])
    return out.select("capture_id", "points", *r6c("x_min", "x_max", "z_min", "z_max"))


@query("even_sample", "frames", sql="""
    WITH n AS (SELECT capture_id, rank, count(*) OVER (PARTITION BY capture_id) AS n FROM frames)
    SELECT capture_id, rank FROM n WHERE n <= 20 OR rank IN (SELECT (i * (n.n - 1)) // 19 FROM range(20) t(i))""")
def even_sample(v):
    return sf.even_sample(v.frames.select("capture_id", "rank"), ["rank"], 20)


@query("step_sample", "frames", sql="""
    WITH n AS (SELECT capture_id, rank, count(*) OVER (PARTITION BY capture_id) AS n FROM frames)
    SELECT capture_id, rank FROM n WHERE n <= 10 OR rank % greatest(1, n // 10) = 0 OR rank = n - 1""")
def step_sample(v):
    return sf.step_sample(v.frames.select("capture_id", "rank"), ["rank"], 10)


@query("holdout_split", "frames", sql="SELECT capture_id, rank, CASE WHEN rank % 10 = 5 THEN 'validation' ELSE 'train' END AS split FROM frames")
def holdout_split(v):
    return sf.holdout_split(v.frames.select("capture_id", "rank"), ["rank"])


# --- boundaries -------------------------------------------------------------

FRAMES_SQL = f"""SELECT capture_id, mx - (mx*nx + my*ny + mz*nz + d) * nx AS ox_, my - (mx*nx + my*ny + mz*nz + d) * ny AS oy_, mz - (mx*nx + my*ny + mz*nz + d) * nz AS oz_,
      nx, ny, nz, d AS fd, ux/n AS ux, uy/n AS uy, uz/n AS uz, ny*(uz/n) - nz*(uy/n) AS vx, nz*(ux/n) - nx*(uz/n) AS vy, nx*(uy/n) - ny*(ux/n) AS vz FROM
    (SELECT *, sqrt(ux*ux + uy*uy + uz*uz) AS n FROM (SELECT *, 1 - nx*nx AS ux, -nx*ny AS uy, -nx*nz AS uz FROM
      (SELECT capture_id, a AS nx, b AS ny, c AS nz, d FROM planes WHERE plane_index = 0) JOIN
      (SELECT capture_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM ({LABELS}) WHERE plane_index = 0 GROUP BY ALL) USING (capture_id)))"""
COORDS = f"""SELECT l.capture_id, rank, x, y, z, plane_index, (x-ox_)*ux + (y-oy_)*uy + (z-oz_)*uz AS u, (x-ox_)*vx + (y-oy_)*vy + (z-oz_)*vz AS v,
      x*nx + y*ny + z*nz + fd AS h FROM ({LABELS}) l JOIN ({FRAMES_SQL}) f ON f.capture_id = l.capture_id"""


def frames_of(v, lab):
    floor = v.planes.where("plane_index = 0")
    return bd.floor_frames(floor, lab.where("plane_index = 0"))


@query("floor_frames", "cloud", "planes", sql=f"""SELECT capture_id, {r6('ox_')} AS fo_x, {r6('oy_')} AS fo_y, {r6('oz_')} AS fo_z,
    {r6('ux')} AS fu_x, {r6('uz')} AS fu_z, {r6('vx')} AS fv_x, {r6('vz')} AS fv_z FROM ({FRAMES_SQL})""")
def floor_frames(v):
    return frames_of(v, labels(v)).select("capture_id", *r6c("fo_x", "fo_y", "fo_z", "fu_x", "fu_z", "fv_x", "fv_z"))


@query("display_points", "cloud", "planes", sql=f"""SELECT capture_id, plane_index, count(*) AS points, {r6('min(u)')} AS dx_min, {r6('max(u)')} AS dx_max,
    {r6('min(h)')} AS dy_min, {r6('max(h)')} AS dy_max, {r6('min(-v)')} AS dz_min, {r6('max(-v)')} AS dz_max FROM ({COORDS}) GROUP BY ALL""")
def display_points(v):
    lab = labels(v)
    d = bd.display_points(bd.floor_coordinates(lab, stage(frames_of(v, lab))))
    out = d.groupBy("capture_id", "plane_index").agg(F.count("*").alias("points"), *[f(c).alias(f"{c}_{n}") for c in ("dx", "dy", "dz") for n, f in (("min", F.min), ("max", F.max))])
    return out.select("capture_id", "plane_index", "points", *r6c("dx_min", "dx_max", "dy_min", "dy_max", "dz_min", "dz_max"))


def _supported_sql(source, keys, minimum, per_view=3):
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    ks = ", ".join(keys)
    return f"""(WITH p AS ({source}), w AS (SELECT {ks}, rank FROM p GROUP BY ALL HAVING count(*) >= {per_view}),
      g AS (SELECT DISTINCT {', '.join('w.' + k for k in keys)}, ox, oy, oz FROM w JOIN stations s ON s.capture_id = w.capture_id AND s.rank = w.rank),
      b AS (SELECT {', '.join('a.' + k for k in keys)}, max(sqrt((a.ox-b.ox)*(a.ox-b.ox)+(a.oy-b.oy)*(a.oy-b.oy)+(a.oz-b.oz)*(a.oz-b.oz))) AS baseline_m FROM g a JOIN g b ON {on} GROUP BY ALL),
      n AS (SELECT {ks}, count(*) AS views FROM w GROUP BY ALL), o AS (SELECT {ks}, count(*) AS observations FROM p GROUP BY ALL)
    SELECT {ks}, observations, coalesce(views, 0) AS views, coalesce(baseline_m, 0) AS baseline_m,
      coalesce(views, 0) >= {minimum} AND coalesce(baseline_m, 0) >= 0.15 AS supported FROM o LEFT JOIN n USING ({ks}) LEFT JOIN b USING ({ks}))"""


@query("supported_views", "cloud", "planes", "stations", sql=f"""SELECT capture_id, plane_index, observations, views, {r6('baseline_m')} AS baseline_m, supported
    FROM {_supported_sql(f'SELECT * FROM ({LABELS}) WHERE plane_index >= 0', ['capture_id', 'plane_index'], 3)}""")
def supported_views(v):
    s = bd.supported_views(labels(v).where("plane_index >= 0"), v.stations, ["capture_id", "plane_index"], 3, BOUNDARY)
    return s.select("capture_id", "plane_index", "observations", "views", *r6c("baseline_m"), "supported")


# the given clouds are thin: half-metre cells, and one point lets a view count
FLOOR = BoundaryPolicy(cell_m=0.5, min_points_per_view=1, min_span_m=0.5)
FLOOR_CELLS = _supported_sql(f"SELECT *, CAST(floor(u / 0.5) AS BIGINT) AS cx, CAST(floor(v / 0.5) AS BIGINT) AS cy FROM ({COORDS}) WHERE plane_index = 0", ["capture_id", "cx", "cy"], 2, 1)


@query("floor_cells", "cloud", "planes", "stations", sql=f"""SELECT capture_id, cx, cy, observations, views, {r6('baseline_m')} AS baseline_m FROM {FLOOR_CELLS} WHERE supported""")
def floor_cells(v):
    lab = labels(v)
    coords = stage(bd.floor_coordinates(lab.where("plane_index = 0"), frames_of(v, lab)))
    return bd.floor_cells(coords, v.stations, FLOOR).select("capture_id", "cx", "cy", "observations", "views", *r6c("baseline_m"))


WALL = BoundaryPolicy(min_points_per_view=1, min_wall_views=2)
LINES = f"""SELECT capture_id, plane_index, lx, ly, lz, dx, dy, dz, ox_, oy_, oz_, ux, uy, uz, vx, vy, vz FROM
    (SELECT *, ((-fd)*(b*dz - c*dy) - ny*((-wd)*dz - c*k) + nz*((-wd)*dy - b*k)) / det AS lx, (nx*((-wd)*dz - c*k) - (-fd)*(a*dz - c*dx) + nz*(a*k - (-wd)*dx)) / det AS ly,
       (nx*(b*k - (-wd)*dy) - ny*(a*k - (-wd)*dx) + (-fd)*(a*dy - b*dx)) / det AS lz FROM
     (SELECT *, dx*ox_ + dy*oy_ + dz*oz_ AS k, nx*(b*dz - c*dy) - ny*(a*dz - c*dx) + nz*(a*dy - b*dx) AS det FROM
      (SELECT * EXCLUDE (dx, dy, dz), dx*sg AS dx, dy*sg AS dy, dz*sg AS dz FROM
       (SELECT *, CASE WHEN (CASE WHEN abs(dx*ux + dy*uy + dz*uz) > 1e-8 THEN dx*ux + dy*uy + dz*uz ELSE dx*vx + dy*vy + dz*vz END) < 0 THEN -1.0 ELSE 1.0 END AS sg FROM
        (SELECT * EXCLUDE (dx, dy, dz), dx/len AS dx, dy/len AS dy, dz/len AS dz FROM
         (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS len FROM (SELECT f.*, p.plane_index, p.a, p.b, p.c, p.d AS wd, ny*p.c - nz*p.b AS dx, nz*p.a - nx*p.c AS dy, nx*p.b - ny*p.a AS dz
           FROM ({FRAMES_SQL}) f JOIN planes p ON p.capture_id = f.capture_id WHERE p.plane_index IN (1, 2, 3))) WHERE len >= 1e-6)))))"""
ALONG = f"""SELECT c.*, l.* EXCLUDE (capture_id, plane_index), (x-lx)*dx + (y-ly)*dy + (z-lz)*dz AS t, CAST(floor(((x-lx)*dx + (y-ly)*dy + (z-lz)*dz) / 0.15) AS BIGINT) AS bin
    FROM ({COORDS}) c JOIN ({LINES}) l USING (capture_id, plane_index)"""
_ENDS = ", ".join(f"{r6(f'(lx+{t}*dx-ox_)*{a}x + (ly+{t}*dy-oy_)*{a}y + (lz+{t}*dz-oz_)*{a}z')} AS {a}{i}" for i, t in enumerate(("start_m", "end_m")) for a in "uv")


def walls(v, lab):
    frames = stage(frames_of(v, lab))
    return v.planes.where("plane_index in (1, 2, 3)"), frames, stage(bd.floor_coordinates(lab.where("plane_index in (1, 2, 3)"), frames))


@query("wall_lines", "cloud", "planes", sql=f"""SELECT capture_id, plane_index, {r6('lx')} AS lx, {r6('ly')} AS ly, {r6('lz')} AS lz, {r6('dx')} AS dx, {r6('dy')} AS dy, {r6('dz')} AS dz FROM ({LINES})""")
def wall_lines(v):
    lab = labels(v)
    w, frames, _ = walls(v, lab)
    return bd.wall_lines(w, frames).select("capture_id", "plane_index", *r6c("lx", "ly", "lz", "dx", "dy", "dz"))


WALL_SPANS = f"""WITH a AS MATERIALIZED ({ALONG}), s AS MATERIALIZED (SELECT * FROM {_supported_sql('SELECT * FROM a', ['capture_id', 'plane_index', 'bin'], 2, 1)}),
      r AS (SELECT capture_id, plane_index, bin, min(bin) OVER (PARTITION BY capture_id, plane_index, g) AS run FROM
        (SELECT *, bin - row_number() OVER (PARTITION BY capture_id, plane_index ORDER BY bin) AS g FROM s WHERE supported)),
      o AS MATERIALIZED (SELECT a.*, run FROM a JOIN r USING (capture_id, plane_index, bin)),
      m AS (SELECT capture_id, plane_index, run, min(t) AS start_m, max(t) AS end_m, count(DISTINCT bin) AS bins, min(h) AS h0, max(h) AS h1, count(*) FILTER (abs(h) <= 0.1) AS near,
              {', '.join(f'any_value({c}) AS {c}' for c in 'lx ly lz dx dy dz ox_ oy_ oz_ ux uy uz vx vy vz'.split())} FROM o GROUP BY ALL HAVING max(t) - min(t) >= 0.3),
      w AS (SELECT * FROM {_supported_sql('SELECT * FROM o', ['capture_id', 'plane_index', 'run'], 2, 1)})
    SELECT m.capture_id, m.plane_index, m.run, {r6('start_m')} AS start_m, {r6('end_m')} AS end_m, bins, {r6('h0')} AS height_min_m, {r6('h1')} AS height_max_m,
      near AS near_floor_observations, observations, views, {r6('baseline_m')} AS baseline_m, {_ENDS} FROM m JOIN w USING (capture_id, plane_index, run)"""


@query("wall_spans", "cloud", "planes", "stations", sql=WALL_SPANS)
def wall_spans(v):
    lab = labels(v)
    w, frames, coords = walls(v, lab)
    s = bd.wall_spans(coords, w, v.stations, frames, WALL)
    return s.select("capture_id", "plane_index", "run", *r6c("start_m", "end_m"), "bins", *r6c("height_min_m", "height_max_m"),
                    "near_floor_observations", "observations", "views", *r6c("baseline_m", "u0", "v0", "u1", "v1"))


@query("candidate_spans", "cloud", "planes", sql=f"""
    WITH a AS MATERIALIZED ({ALONG}), s AS (SELECT capture_id, plane_index, bin FROM a GROUP BY ALL HAVING count(*) >= 4),
      r AS (SELECT capture_id, plane_index, bin, min(bin) OVER (PARTITION BY capture_id, plane_index, g) AS run FROM
        (SELECT *, bin - row_number() OVER (PARTITION BY capture_id, plane_index ORDER BY bin) AS g FROM s)),
      m AS (SELECT capture_id, plane_index, run, min(t) AS start_m, max(t) AS end_m, count(*) AS voxel_points, {', '.join(f'any_value({c}) AS {c}' for c in 'lx ly lz dx dy dz ox_ oy_ oz_ ux uy uz vx vy vz'.split())}
            FROM a JOIN r USING (capture_id, plane_index, bin) GROUP BY ALL HAVING max(t) - min(t) >= 0.3)
    SELECT capture_id, plane_index, run, {r6('start_m')} AS start_m, {r6('end_m')} AS end_m, voxel_points, {_ENDS} FROM m""")
def candidate_spans(v):
    lab = labels(v)
    w, frames, coords = walls(v, lab)
    s = bd.candidate_spans(coords, w, frames, RoomPolicy(candidate_bin_points=4))
    return s.select("capture_id", "plane_index", "run", *r6c("start_m", "end_m"), "voxel_points", *r6c("u0", "v0", "u1", "v1"))


@query("boundary_report", "cloud", "planes", "stations", sql=f"""
    WITH f AS (SELECT * FROM {_supported_sql(f'SELECT * FROM ({LABELS}) WHERE plane_index = 0', ['capture_id'], 3)}),
      n AS (SELECT capture_id, count(*) AS cells FROM {FLOOR_CELLS} WHERE supported GROUP BY ALL),
      w AS (SELECT * FROM {_supported_sql(f'SELECT * FROM ({LABELS}) WHERE plane_index IN (1, 2, 3)', ['capture_id', 'plane_index'], 2, 1)}),
      s AS (SELECT capture_id, plane_index, count(*) AS spans FROM ({WALL_SPANS}) GROUP BY ALL),
      fl AS (SELECT capture_id, observations, views, baseline_m, CASE WHEN NOT supported THEN 'INSUFFICIENT_FLOOR_SUPPORT' WHEN cells > 0 THEN 'SUPPORTED_LOCAL_FLOOR'
              ELSE 'INSUFFICIENT_CELL_SUPPORT' END AS status, coalesce(cells, 0) AS parts FROM f LEFT JOIN n USING (capture_id))
    SELECT capture_id, CAST(NULL AS BIGINT) AS plane_index, observations, views, {r6('baseline_m')} AS baseline_m, status, parts FROM fl UNION ALL
    SELECT w.capture_id, w.plane_index, w.observations, w.views, {r6('w.baseline_m')}, CASE WHEN fl.status IS NULL OR fl.status <> 'SUPPORTED_LOCAL_FLOOR' THEN 'NO_SUPPORTED_FLOOR'
      WHEN NOT supported THEN 'INSUFFICIENT_WALL_SUPPORT' WHEN spans > 0 THEN 'SUPPORTED_PARTIAL_SPANS' ELSE 'INSUFFICIENT_SPAN_SUPPORT' END, coalesce(spans, 0)
    FROM w LEFT JOIN fl USING (capture_id) LEFT JOIN s ON s.capture_id = w.capture_id AND s.plane_index = w.plane_index""")
def boundary_report(v):
    lab = labels(v)
    w, frames, coords = walls(v, lab)
    floor_points = lab.where("plane_index = 0")
    cells = bd.floor_cells(bd.floor_coordinates(floor_points, frames), v.stations, FLOOR)
    floor = bd.supported_views(floor_points, v.stations, ["capture_id"], 3, BOUNDARY)
    wall = bd.supported_views(lab.where("plane_index in (1, 2, 3)"), v.stations, ["capture_id", "plane_index"], 2, WALL)
    out = bd.boundary_report(floor, cells, wall, bd.wall_spans(coords, w, v.stations, frames, WALL))
    return out.select("capture_id", "plane_index", "observations", "views", *r6c("baseline_m"), "status", "parts")


# --- rooms ------------------------------------------------------------------

def plan_points(v):
    """The cloud in floor coordinates: u = x, v = z, h = y."""
    return v.cloud.select("capture_id", F.col("x").alias("u"), F.col("z").alias("v"), F.col("y").alias("h"))


PLAN = PlanPolicy(cell_m=0.25, min_band_points=2)
PERSISTENT = """WITH RECURSIVE b AS (SELECT capture_id, CAST(floor(x / 0.25) AS BIGINT) AS cx, CAST(floor(z / 0.25) AS BIGINT) AS cy, floor((y - 0.6) / 0.4) AS band, count(*) AS n, min(y) AS lo, max(y) AS hi
        FROM cloud WHERE y BETWEEN 0.6 AND 2.4 GROUP BY ALL HAVING count(*) >= 2),
      c AS MATERIALIZED (SELECT capture_id, cx, cy, count(*) AS bands, min(lo) AS lo, max(hi) AS hi, CAST(sum(n) AS BIGINT) AS voxel_points FROM b GROUP BY ALL HAVING count(*) >= 2 AND max(hi) - min(lo) >= 0.8),
      s AS MATERIALIZED (SELECT a.*, n, (a.cx + 100000) * 1000000 + a.cy + 100000 AS id FROM c a JOIN (SELECT a.capture_id, a.cx, a.cy, count(*) AS n FROM c a JOIN c b ON a.capture_id = b.capture_id
          AND b.cx BETWEEN a.cx-1 AND a.cx+1 AND b.cy BETWEEN a.cy-1 AND a.cy+1 AND (a.cx <> b.cx OR a.cy <> b.cy) GROUP BY ALL HAVING count(*) >= 2) USING (capture_id, cx, cy)),
      e AS MATERIALIZED (SELECT a.capture_id, a.id AS a, b.id AS b FROM s a JOIN s b ON a.capture_id = b.capture_id AND b.cx BETWEEN a.cx-1 AND a.cx+1 AND b.cy BETWEEN a.cy-1 AND a.cy+1),
      w AS (SELECT 0 AS step, capture_id, id, id AS root FROM s UNION ALL SELECT step + 1, e.capture_id, e.a, min(root) FROM w JOIN e ON e.capture_id = w.capture_id AND e.b = w.id WHERE step < 60 GROUP BY step, e.capture_id, e.a),
      g AS (SELECT capture_id, root FROM w JOIN s USING (capture_id, id) WHERE step = 60 GROUP BY ALL HAVING count(*) >= 6 AND greatest(max(cx) - min(cx), max(cy) - min(cy)) * 0.25 >= 0.5)
    SELECT s.* FROM s JOIN w USING (capture_id, id) JOIN g USING (capture_id, root) WHERE step = 60"""


@query("persistent_cells", "cloud", sql=f"SELECT capture_id, cx, cy, bands, {r6('lo')} AS height_min_m, {r6('hi')} AS height_max_m, voxel_points, n AS neighbors FROM ({PERSISTENT})")
def persistent_cells(v):
    out = rm.persistent_cells(plan_points(v), PLAN)
    return out.select("capture_id", "cx", "cy", "bands", *r6c("height_min_m", "height_max_m"), "voxel_points", "neighbors")


@query("persistent_points", "cloud", sql=f"""
    WITH p AS (SELECT *, CAST(floor(x / 0.25) AS BIGINT) AS cx, CAST(floor(z / 0.25) AS BIGINT) AS cy, floor((y - 0.6) / 0.4) AS band FROM cloud WHERE y BETWEEN 0.6 AND 2.4),
      i AS (SELECT p.* FROM p JOIN (SELECT capture_id, cx, cy FROM ({PERSISTENT})) USING (capture_id, cx, cy)),
      n AS (SELECT *, count(*) OVER (PARTITION BY capture_id, cx, cy, band) AS k FROM i)
    SELECT capture_id, count(*) AS points, {r6('min(y)')} AS h_min, {r6('max(y)')} AS h_max FROM n WHERE k >= 2 GROUP BY ALL""")
def persistent_points(v):
    p = plan_points(v)
    out = rm.persistent_points(p, rm.persistent_cells(p, PLAN), PLAN).groupBy("capture_id").agg(
        F.count("*").alias("points"), F.min("h").alias("h_min"), F.max("h").alias("h_max"))
    return out.select("capture_id", "points", *r6c("h_min", "h_max"))


ROOMS = """SELECT capture_id, CAST(0.8 AS DOUBLE) AS ax, CAST(0.6 AS DOUBLE) AS ay, CAST(-0.6 AS DOUBLE) AS bx, CAST(0.8 AS DOUBLE) AS "by", 0.5 + 0.1 * capture_id::DOUBLE AS lo0,
    CAST(-2.5 AS DOUBLE) AS lo1, CAST(6.0 AS DOUBLE) AS hi0, 3.5 - 0.1 * capture_id::DOUBLE AS hi1 FROM (SELECT DISTINCT capture_id FROM stations)"""


def rooms(v):
    c = F.col("capture_id").cast("double")
    return v.stations.select("capture_id").distinct().select(
        "capture_id", F.lit(0.8).alias("ax"), F.lit(0.6).alias("ay"), F.lit(-0.6).alias("bx"), F.lit(0.8).alias("by"),
        (0.5 + 0.1 * c).alias("lo0"), F.lit(-2.5).alias("lo1"), F.lit(6.0).alias("hi0"), (3.5 - 0.1 * c).alias("hi1"))


@query("ceiling_height", "cloud", "stations", sql=f"""
    WITH r AS ({ROOMS}), p AS (SELECT c.capture_id, y AS h, x*ax + z*ay AS p0, x*bx + z*"by" AS p1, lo0, lo1, hi0, hi1 FROM cloud c JOIN r USING (capture_id)),
      e AS MATERIALIZED (SELECT * FROM p WHERE p0 BETWEEN lo0 AND hi0 AND p1 BETWEEN lo1 AND hi1 AND h BETWEEN 1.8 AND 4.0),
      t AS (SELECT capture_id, quantile_cont(h, 0.98) AS top FROM e GROUP BY capture_id, floor((p0 - lo0) / 0.25), floor((p1 - lo1) / 0.25) HAVING count(*) >= 2),
      q AS (SELECT capture_id, count(*) AS cells, quantile_cont(top, 0.9) AS est, quantile_cont(top, 0.85) AS b0, quantile_cont(top, 0.95) AS b1 FROM t GROUP BY ALL),
      n AS (SELECT capture_id, count(*) FILTER (abs(top - est) <= 0.08) AS near FROM t JOIN q USING (capture_id) GROUP BY ALL),
      g AS (SELECT capture_id, quantile_cont(h, 0.999) AS p999, count(*) AS vox FROM e GROUP BY ALL),
      j AS (SELECT r.capture_id, coalesce(cells, 0) AS cells, est, b0, b1, near, p999, coalesce(vox, 0) AS vox, (hi0 - lo0) * (hi1 - lo1) AS area
            FROM r LEFT JOIN q USING (capture_id) LEFT JOIN n USING (capture_id) LEFT JOIN g USING (capture_id))
    SELECT capture_id, CASE WHEN cells >= 12 THEN 'PROVISIONAL_UPPER_ENVELOPE' ELSE 'INSUFFICIENT_UPPER_COVERAGE' END AS status, vox AS upper_voxels, cells AS supported_cells,
      {', '.join(f"{r6(f'CASE WHEN cells >= 12 THEN {e} END')} AS {n}" for e, n in (('est', 'height_m'), ('b0', 'band_low_m'), ('b1', 'band_high_m'), ('p999', 'point_p999_m')))},
      CASE WHEN cells >= 12 THEN near END AS near_cells, {r6('CASE WHEN cells >= 12 THEN near * 0.0625 / area END')} AS near_area_fraction FROM j""")
def ceiling_height(v):
    out = rm.ceiling_height(plan_points(v), rooms(v), CeilingPolicy(min_upper_points_per_cell=2))
    return out.select("capture_id", "status", "upper_voxels", "supported_cells", *r6c("height_m", "band_low_m", "band_high_m", "point_p999_m"),
                      "near_cells", *r6c("near_area_fraction"))


@query("sparse_room", "cloud", sql=f"""
    WITH c AS (SELECT capture_id, x AS u, -z AS v, y FROM cloud),
      n AS (SELECT capture_id, count(*) AS points, quantile_cont(y, 0.02) AS floor_y, quantile_cont(u, 0.02) AS u0, quantile_cont(u, 0.98) AS u1, quantile_cont(v, 0.02) AS v0, quantile_cont(v, 0.98) AS v1 FROM c GROUP BY ALL),
      k AS MATERIALIZED (SELECT c.capture_id, u, v FROM c JOIN n USING (capture_id) WHERE u BETWEEN u0 AND u1 AND v BETWEEN v0 AND v1),
      t AS (SELECT capture_id, 0.5 * atan2(2 * covar_samp(u, v), var_samp(u) - var_samp(v)) AS t FROM k GROUP BY ALL),
      p AS (SELECT capture_id, u*cos(t) + v*sin(t) AS p0, -u*sin(t) + v*cos(t) AS p1 FROM k JOIN t USING (capture_id)),
      b AS (SELECT capture_id, quantile_cont(p0, 0.02) AS lo0, quantile_cont(p0, 0.98) AS hi0, quantile_cont(p1, 0.02) AS lo1, quantile_cont(p1, 0.98) AS hi1 FROM p GROUP BY ALL)
    SELECT capture_id, points, {r6('floor_y')} AS floor_y, {r6('cos(t)')} AS ax, {r6('sin(t)')} AS ay, {r6('hi0 - lo0')} AS width_m, {r6('hi1 - lo1')} AS depth_m,
      {r6('(hi0 - lo0) * (hi1 - lo1)')} AS area_m2, CASE WHEN points >= 100 AND hi0 - lo0 BETWEEN 0.5 AND 50 AND hi1 - lo1 BETWEEN 0.5 AND 50
      THEN 'AUTOMATIC_SPARSE_ENVELOPE' ELSE 'RECONSTRUCTION_SUPPORT_INSUFFICIENT' END AS status FROM n JOIN t USING (capture_id) JOIN b USING (capture_id)""")
def sparse_room(v):
    return rm.sparse_room(v.cloud).select("capture_id", "points", *r6c("floor_y", "ax", "ay", "width_m", "depth_m", "area_m2"), "status")


SPANS = """SELECT o_custkey AS capture_id, CAST(left(o_orderpriority, 1) AS BIGINT) AS plane_index, o_orderkey AS span_id, (o_orderkey % 7) / CAST(10 AS DOUBLE) AS u0,
    (o_orderkey % 11) / CAST(10 AS DOUBLE) AS v0, CASE WHEN o_orderkey % 2 = 0 THEN 3 + (o_orderkey % 5) / CAST(10 AS DOUBLE) ELSE (o_orderkey % 13) / CAST(100 AS DOUBLE) END AS u1,
    CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 17) / CAST(100 AS DOUBLE) ELSE 2 + (o_orderkey % 3) / CAST(10 AS DOUBLE) END AS v1 FROM orders"""
BEST = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, plane_index ORDER BY len DESC, span_id) AS pos FROM
    (SELECT *, sqrt((u1-u0)*(u1-u0) + (v1-v0)*(v1-v0)) AS len FROM ({SPANS})) WHERE len >= 0.3) WHERE pos = 1"""


def spans(v):
    k = F.col("o_orderkey")
    even = k % 2 == 0
    return v.table("orders").select(
        F.col("o_custkey").alias("capture_id"), F.substring("o_orderpriority", 1, 1).cast("bigint").alias("plane_index"), k.alias("span_id"),
        ((k % 7) / 10).alias("u0"), ((k % 11) / 10).alias("v0"), F.when(even, 3 + (k % 5) / 10).otherwise((k % 13) / 100).alias("u1"),
        F.when(even, (k % 17) / 100).otherwise(2 + (k % 3) / 10).alias("v1"))


@query("room_rectangle", sql=f"""
    WITH s AS ({BEST}), a AS (SELECT *, atan2(v1 - v0, u1 - u0) AS t FROM s),
      g AS (SELECT capture_id, count(*) AS planes, atan2(avg(sin(4*t)), avg(cos(4*t))) / 4 AS seed FROM a GROUP BY ALL),
      d AS (SELECT capture_id, any_value(planes) AS planes, any_value(seed) + median(m - pi()/4) AS angle FROM
        (SELECT a.capture_id, planes, seed, (t - seed + pi()/4) - (pi()/2) * floor((t - seed + pi()/4) / (pi()/2)) AS m FROM a JOIN g USING (capture_id)) GROUP BY ALL),
      x AS (SELECT a.*, cos(angle) AS c, sin(angle) AS n FROM a JOIN d USING (capture_id)),
      e AS (SELECT capture_id, CASE WHEN abs((u1-u0)*c + (v1-v0)*n) >= abs(-(u1-u0)*n + (v1-v0)*c) THEN 0 ELSE 1 END AS fam, u0*c + v0*n AS p0, -u0*n + v0*c AS p1 FROM x
            UNION ALL SELECT capture_id, CASE WHEN abs((u1-u0)*c + (v1-v0)*n) >= abs(-(u1-u0)*n + (v1-v0)*c) THEN 0 ELSE 1 END, u1*c + v1*n, -u1*n + v1*c FROM x),
      b AS (SELECT capture_id, count(DISTINCT fam) AS fams, quantile_cont(p0, 0.05) AS lo0, quantile_cont(p0, 0.95) AS hi0, quantile_cont(p1, 0.05) AS lo1, quantile_cont(p1, 0.95) AS hi1 FROM e GROUP BY ALL)
    SELECT capture_id, planes, {r6('hi0 - lo0')} AS width_m, {r6('hi1 - lo1')} AS depth_m, {r6('(hi0 - lo0) * (hi1 - lo1)')} AS area_m2,
      CASE WHEN planes < 3 THEN 'FEWER_THAN_THREE_PLANES' WHEN fams < 2 THEN 'ONE_ORIENTATION_FAMILY' WHEN least(hi0 - lo0, hi1 - lo1) < 1 THEN 'COVERAGE_TOO_NARROW'
      ELSE 'INFERRED_ROUGH_COMPLETION' END AS status FROM d JOIN b USING (capture_id)""")
def room_rectangle(v):
    return rm.room_rectangle(spans(v)).select("capture_id", "planes", *r6c("width_m", "depth_m", "area_m2"), "status")


@query("entry_crossing", "frame_poses", sql=f"""
    WITH p AS (SELECT capture_id, rank, px AS p0, py AS p1, px BETWEEN -0.12 AND 0.12 AND py BETWEEN -0.1 AND 0.1 AS inn FROM frame_poses),
      s AS (SELECT *, lag(inn) OVER w AS was, lag(p0) OVER w AS a0, lag(p1) OVER w AS a1 FROM p WINDOW w AS (PARTITION BY capture_id ORDER BY rank)),
      x AS (SELECT capture_id, rank, t, o, a0 + t*(p0-a0) AS q0, a1 + t*(p1-a1) AS q1 FROM (
        SELECT *, 0 AS o, (-0.12 - a0) / CASE WHEN abs(p0-a0) >= 1e-12 THEN p0-a0 END AS t FROM s WHERE inn AND NOT was UNION ALL
        SELECT *, 1, (0.12 - a0) / CASE WHEN abs(p0-a0) >= 1e-12 THEN p0-a0 END FROM s WHERE inn AND NOT was UNION ALL
        SELECT *, 2, (-0.1 - a1) / CASE WHEN abs(p1-a1) >= 1e-12 THEN p1-a1 END FROM s WHERE inn AND NOT was UNION ALL
        SELECT *, 3, (0.1 - a1) / CASE WHEN abs(p1-a1) >= 1e-12 THEN p1-a1 END FROM s WHERE inn AND NOT was)),
      h AS (SELECT * FROM x WHERE t BETWEEN 0 AND 1 AND q0 >= -0.12 - 1e-9 AND q0 <= 0.12 + 1e-9 AND q1 >= -0.1 - 1e-9 AND q1 <= 0.1 + 1e-9),
      f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY rank, t, o) AS pos FROM h) WHERE pos = 1),
      j AS (SELECT p.capture_id, coalesce(q0, p0) AS q0, coalesce(q1, p1) AS q1, q0 IS NOT NULL AS crossed FROM p LEFT JOIN f USING (capture_id) WHERE p.rank = 0),
      g AS (SELECT *, [abs(q1 + 0.1), abs(q0 - 0.12), abs(q1 - 0.1), abs(q0 + 0.12)] AS gaps FROM j),
      k AS (SELECT *, CAST(list_position(gaps, list_min(gaps)) - 1 AS INTEGER) AS side FROM g),
      m AS (SELECT *, CASE WHEN side IN (0, 2) THEN -0.12 ELSE -0.1 END::DOUBLE AS lo, CASE WHEN side IN (0, 2) THEN 0.12 ELSE 0.1 END::DOUBLE AS hi, CASE WHEN side IN (0, 2) THEN q0 ELSE q1 END AS at_ FROM k),
      w AS (SELECT *, least(0.08, (hi - lo) * 0.6) AS width FROM m)
    SELECT capture_id, side AS side_index, {r6('least(greatest(at_, lo + width / 2 + 0.05), hi - width / 2 - 0.05)')} AS center_m, {r6('width')} AS width_m,
      CASE WHEN crossed THEN 'FIRST_CAPTURE_PATH_ENTRY_CROSSING' ELSE 'NEAREST_EDGE_TO_CAPTURE_START' END AS method FROM w""")
def entry_crossing(v):
    path = v.poses.select("capture_id", F.col("rank").alias("seq"), F.col("px").alias("p0"), F.col("py").alias("p1"))
    box = v.frames.select("capture_id").distinct().select(
        "capture_id", F.lit(-0.12).alias("lo0"), F.lit(-0.1).alias("lo1"), F.lit(0.12).alias("hi0"), F.lit(0.1).alias("hi1"))
    return rm.entry_crossing(path, box, RoomPolicy(assumed_entry_width_m=0.08)).select("capture_id", "side_index", *r6c("center_m", "width_m"), "method")


@query("plan_raster", "cloud", sql="""
    WITH b AS (SELECT capture_id, min(x) - 0.15 AS u0, min(z) - 0.15 AS v0, greatest(max(x) + 0.15 - (min(x) - 0.15), 0.3) AS eu, greatest(max(z) + 0.15 - (min(z) - 0.15), 0.3) AS ev FROM cloud GROUP BY ALL),
      s AS (SELECT *, least(1320 / eu, 920 / ev) AS s FROM b),
      p AS (SELECT c.capture_id, CAST(floor((x - u0) * s + (1400 - eu * s) / 2) AS BIGINT) AS px, CAST(floor((z - v0) * s + (1000 - ev * s) / 2) AS BIGINT) AS py FROM cloud c JOIN s USING (capture_id) WHERE y BETWEEN 0.1 AND 2.2)
    SELECT capture_id, px, py, count(*) AS points, CAST(floor(greatest(least(228 - 28 * ln(1 + count(*)), 230), 75)) AS BIGINT) AS grey FROM p GROUP BY capture_id, px, py""")
def plan_raster(v):
    return rm.plan_raster(plan_points(v))


@query("line_suggestions", "cloud", "planes")
def line_suggestions(v):
    lab = labels(v)
    w, frames, coords = walls(v, lab)
    k = bd.wall_lines(w, frames).join(frames, "capture_id")
    lines = k.select("capture_id", "plane_index", (F.col("dx") * F.col("fu_x") + F.col("dy") * F.col("fu_y") + F.col("dz") * F.col("fu_z")).alias("su"),
                     (F.col("dx") * F.col("fv_x") + F.col("dy") * F.col("fv_y") + F.col("dz") * F.col("fv_z")).alias("sv"))
    diag, _ = rm.line_suggestions(coords, lines, PlanPolicy(min_line_points=20, min_line_bin_points=3))
    return diag.select("capture_id", "plane_index", "persistent_voxel_points", *r6c("refit_angle_degrees", "residual_p90_m"), "status")


@query("line_suggestion_spans", "cloud", "planes")
def line_suggestion_spans(v):
    lab = labels(v)
    w, frames, coords = walls(v, lab)
    k = bd.wall_lines(w, frames).join(frames, "capture_id")
    lines = k.select("capture_id", "plane_index", (F.col("dx") * F.col("fu_x") + F.col("dy") * F.col("fu_y") + F.col("dz") * F.col("fu_z")).alias("su"),
                     (F.col("dx") * F.col("fv_x") + F.col("dy") * F.col("fv_y") + F.col("dz") * F.col("fv_z")).alias("sv"))
    return rm.line_suggestions(coords, lines, PlanPolicy(min_line_points=20, min_line_bin_points=3))[1]


def planted(df, keys, moved, modulus, count, value):
    """A stored copy of derived rows with planted faults: rows lost, counts and values changed, keys moved."""
    m = sum((i + 1) * F.col(k) for i, k in enumerate(keys)) % modulus
    return df.withColumn("_m", m).where("_m <> 0").select(
        "capture_id", *[(F.col(k) + F.when(F.col("_m") == 3, 100000).otherwise(0)).alias(k) if k == moved else F.col(k) for k in keys],
        (F.col(count) + F.when(F.col("_m") == 1, 1).otherwise(0)).alias(count), (F.col(value) + F.when(F.col("_m") == 2, 0.001).otherwise(0.0)).alias(value))


def planted_sql(kind, source, keys, moved, modulus, count, value):
    m = " + ".join(f"{i + 1} * {k}" for i, k in enumerate(keys))
    item = lambda shift: "concat_ws(',', " + ", ".join(f"{k} + {shift}" if k == moved else k for k in keys) + ")"
    return f"""SELECT '{kind}' AS kind, capture_id, CASE WHEN d = 'STORED_ONLY' THEN {item(100000)} ELSE {item(0)} END AS item, d AS difference FROM
      (SELECT *, unnest(CASE ({m}) % {modulus} WHEN 0 THEN ['DERIVED_ONLY'] WHEN 1 THEN ['CHANGED:{count}'] WHEN 2 THEN ['CHANGED:{value}'] WHEN 3 THEN ['DERIVED_ONLY', 'STORED_ONLY'] ELSE [] END) AS d FROM ({source}))"""


_VOXELS = "SELECT capture_id, CAST(floor(x / 0.25) AS BIGINT) AS vx, CAST(floor(y / 0.25) AS BIGINT) AS vy, CAST(floor(z / 0.25) AS BIGINT) AS vz FROM cloud GROUP BY ALL"
#: Kind, keys behind capture_id, the key that is moved, modulus, integer and float column, and how each is derived again.
RECOMPUTED = [
    ("voxel", ["vx", "vy", "vz"], "vz", 31, "n", "x", lambda v: sf.voxel_average(v.cloud, 0.25)),
    ("plane", ["plane_index"], "plane_index", 4, "voxel_points", "residual_median_m", lambda v: support(v)[1]),
    ("span", ["plane_index", "run"], "run", 5, "bins", "start_m", lambda v: bd.wall_spans(*_span_inputs(v))),
]


def _span_inputs(v):
    w, frames, coords = walls(v, labels(v))
    return coords, w, v.stations, frames, WALL


@query("recompute_audit", "cloud", "planes", "stations", sql=" UNION ALL ".join([
    planted_sql("voxel", _VOXELS, ["vx", "vy", "vz"], "vz", 31, "n", "x"),
    planted_sql("plane", f"SELECT capture_id, plane_index FROM ({SUPPORT})", ["plane_index"], "plane_index", 4, "voxel_points", "residual_median_m"),
    planted_sql("span", f"SELECT capture_id, plane_index, run FROM ({WALL_SPANS})", ["plane_index", "run"], "run", 5, "bins", "start_m")]))
def recompute_audit(v):
    out = None
    for kind, keys, moved, modulus, count, value, derive in RECOMPUTED:
        cols = ["capture_id", *keys, count, value]
        derived = stage(derive(v).select(*cols))
        stored = stage(planted(derived, keys, moved, modulus, count, value))
        found = ig.tree_audit(stored, derived, "capture_id", ["capture_id", *keys], [count], [value])
        found = found.select(F.lit(kind).alias("kind"), "capture_id", F.concat_ws(",", *keys).alias("item"), "difference")
        out = found if out is None else out.unionByName(found)
    return out
