"""Queries over depth rasters, images and visible objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from capstrata.operators import boundaries as bd
from capstrata.operators import depth as dp
from capstrata.operators import grounding as gd
from capstrata.operators import room as rm
from capstrata.operators import surfaces as sf
from capstrata.plans.q_timeseries import r6c
from capstrata.plans.registry import query, r6
from capstrata.policies import DensePolicy
from capstrata.session import stage

POLICY = DensePolicy(neighbors=4)


def _ray(x, y, z, ox, oy):
    return f"sqrt(({x}-{ox})*({x}-{ox}) + ({y}-{oy})*({y}-{oy}) + {z}*{z})"


# cameras of this view look along +z without rotation, which the SQL uses
SUPPORT = f"""WITH p AS (SELECT * FROM depth_pixels WHERE z BETWEEN 0.1 AND 20),
      a AS (SELECT p.*, s.partner, (x + 0.5 - 20) / 50 * z - c.tx AS wx, (y + 0.5 - 15) / 50 * z - c.ty AS wy, c.ox AS aox, c.oy AS aoy, d.ox AS box, d.oy AS boy, d.tx AS btx, d.ty AS bty
            FROM p JOIN depth_schedule s ON s.capture_id = p.capture_id AND s.image = p.image JOIN depth_cameras c ON c.capture_id = p.capture_id AND c.image = p.image
            JOIN depth_cameras d ON d.capture_id = p.capture_id AND d.image = s.partner),
      b AS (SELECT *, 50 * (wx + btx) / z + 20 AS bu, 50 * (wy + bty) / z + 15 AS bv FROM a),
      m AS (SELECT b.*, q.z AS seen, floor(bu) AS gx, floor(bv) AS gy FROM b JOIN p q ON q.capture_id = b.capture_id AND q.image = b.partner
            AND q.x = CAST(floor(bu) AS BIGINT) AND q.y = CAST(floor(bv) AS BIGINT) WHERE bu >= 0 AND bu < 40 AND bv >= 0 AND bv < 30 AND abs(q.z - b.z) <= 0.02 * b.z),
      r AS (SELECT *, 50 * ((gx + 0.5 - 20) / 50 * seen - btx - aox) / seen + 20 AS ru, 50 * ((gy + 0.5 - 15) / 50 * seen - bty - aoy) / seen + 15 AS rv FROM m),
      g AS (SELECT capture_id, image, y, x, count(*) AS support FROM r WHERE sqrt((ru - x - 0.5)*(ru - x - 0.5) + (rv - y - 0.5)*(rv - y - 0.5)) <= 1
            AND degrees(acos(greatest(-1, least(1, ((wx-aox)*(wx-box) + (wy-aoy)*(wy-boy) + z*z) / ({_ray('wx', 'wy', 'z', 'aox', 'aoy')} * {_ray('wx', 'wy', 'z', 'box', 'boy')}))))) >= 1 GROUP BY ALL)
    SELECT capture_id, image, y, x, z, coalesce(support, 0) AS support, coalesce(support, 0) >= 2 AS accepted FROM p LEFT JOIN g USING (capture_id, image, y, x)"""


def support(v):
    return stage(dp.depth_support(v.depth_pixels, v.depth_cameras, v.depth_schedule, POLICY))


@query("depth_support", "depth_pixels", "depth_schedule", sql=f"SELECT capture_id, image, y, x, {r6('z')} AS z, support, accepted FROM ({SUPPORT})")
def depth_support(v):
    out = dp.depth_support(stage(v.depth_pixels), v.depth_cameras, v.depth_schedule, POLICY)
    return out.select("capture_id", "image", "y", "x", *r6c("z"), "support", "accepted")


@query("depth_view_report", "depth_pixels", "depth_schedule", sql=f"""
    WITH a AS (SELECT capture_id, image, count(*) AS valid_pixels, count(*) FILTER (accepted) AS accepted_pixels, count(*) FILTER (NOT accepted) AS rejected_valid_pixels,
        {', '.join(f'count(*) FILTER (support = {n}) AS support_{n}' for n in range(5))} FROM ({SUPPORT}) GROUP BY ROLLUP (capture_id, image)),
      c AS (SELECT capture_id, image, CAST(sum(width * height) AS BIGINT) AS pixels FROM depth_cameras GROUP BY ROLLUP (capture_id, image))
    SELECT c.capture_id, c.image, pixels, valid_pixels, accepted_pixels, rejected_valid_pixels, {', '.join(f'support_{n}' for n in range(5))}, {r6('accepted_pixels / CAST(pixels AS DOUBLE)')} AS accepted_fraction
    FROM c JOIN a ON a.capture_id = c.capture_id AND a.image IS NOT DISTINCT FROM c.image WHERE c.capture_id IS NOT NULL""")
def depth_view_report(v):
    out = dp.depth_view_report(support(v), v.depth_cameras, POLICY)
    return out.select(*[c for c in out.columns if c != "accepted_fraction"], *r6c("accepted_fraction"))


@query("accepted_points", "depth_pixels", "depth_schedule", sql=f"""
    SELECT s.capture_id, s.image, y AS py, x AS px, {r6('(x + 0.5 - 20) / 50 * z - tx')} AS x, {r6('(y + 0.5 - 15) / 50 * z - ty')} AS y, {r6('z')} AS z
    FROM ({SUPPORT}) s JOIN depth_cameras c ON c.capture_id = s.capture_id AND c.image = s.image WHERE accepted AND y % 2 = 0 AND x % 2 = 0""")
def accepted_points(v):
    return dp.accepted_points(support(v), v.depth_cameras, 2).select("capture_id", "image", "py", "px", *r6c("x", "y", "z"))


SEEN = """SELECT l_orderkey // 5000 AS capture_id, CAST(l_linenumber AS BIGINT) AS image, (l_partkey % 40 + 0.25 - 20) / 50 * (2 + l_discount) + CAST(0.1 AS DOUBLE) * l_linenumber AS wx,
    (l_suppkey % 30 + 0.25 - 15) / 50 * (2 + l_discount) + CAST(0.02 AS DOUBLE) * (l_linenumber % 3) AS wy, 2 + l_discount AS wz FROM lineitem"""


@query("sparse_depth_agreement", "depth_pixels", "depth_schedule", sql=f"""
    WITH p AS (SELECT s.capture_id, s.image, wz, CAST(floor(50 * (wx + tx) / wz + 20) AS BIGINT) AS x, CAST(floor(50 * (wy + ty) / wz + 15) AS BIGINT) AS y
               FROM ({SEEN}) s JOIN depth_cameras c ON c.capture_id = s.capture_id AND c.image = s.image),
      e AS (SELECT p.capture_id, p.image, abs(q.z - wz) / wz AS error FROM p JOIN ({SUPPORT}) q ON q.capture_id = p.capture_id AND q.image = p.image AND q.x = p.x AND q.y = p.y WHERE accepted),
      g AS (SELECT capture_id, image, count(*) AS n, median(error) AS m, quantile_cont(error, 0.9) AS p FROM e GROUP BY ALL)
    SELECT capture_id, image, {r6('m')} AS error_median, {r6('p')} AS error_p90, coalesce(n, 0) AS sparse_samples FROM (SELECT capture_id, image FROM depth_cameras) LEFT JOIN g USING (capture_id, image)""")
def sparse_depth_agreement(v):
    n = F.col("l_linenumber")
    z = 2 + F.col("l_discount")
    seen = v.table("lineitem").select(
        F.floor(F.col("l_orderkey") / 5000).alias("capture_id"), n.cast("bigint").alias("image"),
        ((F.col("l_partkey") % 40 + 0.25 - 20) / 50 * z + 0.1 * n).alias("wx"), ((F.col("l_suppkey") % 30 + 0.25 - 15) / 50 * z + 0.02 * (n % 3)).alias("wy"), z.alias("wz"))
    out = dp.sparse_depth_agreement(seen, support(v), v.depth_cameras)
    return out.select("capture_id", "image", *r6c("error_median", "error_p90"), "sparse_samples")


@query("resampled_depth", "depth_pixels", "depth_cameras", sql=f"""
    SELECT c.capture_id, c.image, ty_ AS ty, tx_ AS tx, {r6('coalesce(z, 0)')} AS z FROM
      (SELECT capture_id, image, j.r AS ty_, i.r AS tx_, CAST(floor((i.r + 0.5 - 10) / 25 * fx + cx - 0.5 + 0.5) AS BIGINT) AS x, CAST(floor((j.r + 0.5 - 7.5) / 25 * fy + cy - 0.5 + 0.5) AS BIGINT) AS y
       FROM depth_cameras, range(20) i(r), range(15) j(r)) c LEFT JOIN depth_pixels p ON p.capture_id = c.capture_id AND p.image = c.image AND p.x = c.x AND p.y = c.y""")
def resampled_depth(v):
    lit = lambda x, n: F.lit(x).alias(n)
    grids = v.depth_cameras.select("capture_id", "image", "fx", "fy", "cx", "cy", lit(25.0, "tfx"), lit(25.0, "tfy"), lit(10.0, "tcx"), lit(7.5, "tcy"), lit(20, "twidth"), lit(15, "theight"))
    return dp.resample_depth(v.depth_pixels, grids).select("capture_id", "image", "ty", "tx", *r6c("z"))


def rasters(v):
    """Raw raster values: the tax percentage in millimetres, zero where untaxed."""
    return v.table("lineitem").select(F.floor(F.col("l_orderkey") / 5000).alias("capture_id"), F.col("l_linenumber").cast("bigint").alias("frame"),
                                      F.round(F.col("l_tax") * 1000).cast("bigint").alias("value"))


@query("raster_stats", sql="""
    WITH p AS (SELECT l_orderkey // 5000 AS capture_id, l_linenumber AS frame, CAST(round(l_tax * 1000) AS BIGINT) AS value FROM lineitem)
    SELECT capture_id, count(DISTINCT frame) AS sampled_frames, count(*) FILTER (value = 0) AS invalid_values, min(value) FILTER (value <> 0) AS valid_min,
      max(value) FILTER (value <> 0) AS valid_max FROM p GROUP BY ALL""")
def raster_stats(v):
    return dp.raster_stats(rasters(v))


@query("level_counts", sql="""SELECT l_orderkey // 5000 AS capture_id, CAST(round(l_tax * 1000) AS BIGINT) AS value, count(*) AS pixels FROM lineitem GROUP BY ALL""")
def level_counts(v):
    return dp.level_counts(rasters(v))


GREY = """SELECT g.capture_id, g.image, g.y, g.x, coalesce(v, 0) AS value FROM (SELECT capture_id, image, j.r AS y, i.r AS x FROM depth_cameras, range(40) i(r), range(30) j(r)) g LEFT JOIN
    (SELECT l_orderkey // 5000 AS capture_id, CAST(l_linenumber AS BIGINT) AS image, l_suppkey % 30 AS y, l_partkey % 40 AS x, max(l_orderkey % 256) AS v FROM lineitem GROUP BY ALL) p
    ON p.capture_id = g.capture_id AND p.image = g.image AND p.y = g.y AND p.x = g.x"""


def grey(v):
    """A grey image per depth view; pixels nobody wrote are black."""
    full = v.depth_cameras.select("capture_id", "image", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("y"))
    full = full.select("capture_id", "image", F.col("y").cast("bigint").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("x")).withColumn("x", F.col("x").cast("bigint"))
    p = v.table("lineitem").groupBy(F.floor(F.col("l_orderkey") / 5000).alias("capture_id"), F.col("l_linenumber").cast("bigint").alias("image"),
                                    (F.col("l_suppkey") % 30).alias("y"), (F.col("l_partkey") % 40).alias("x")).agg(F.max(F.col("l_orderkey") % 256).alias("value"))
    return full.join(p, ["capture_id", "image", "y", "x"], "left").fillna(0, ["value"])


@query("image_metrics", "depth_cameras", sql=f"""
    WITH p AS MATERIALIZED ({GREY}),
      l AS (SELECT capture_id, image, coalesce(lag(value) OVER c, lead(value) OVER c) + coalesce(lead(value) OVER c, lag(value) OVER c)
          + coalesce(lag(value) OVER r, lead(value) OVER r) + coalesce(lead(value) OVER r, lag(value) OVER r) - 4 * value AS lap FROM p
        WINDOW c AS (PARTITION BY capture_id, image, x ORDER BY y), r AS (PARTITION BY capture_id, image, y ORDER BY x)),
      m AS (SELECT capture_id, image, count(*) FILTER (value < 8) / CAST(count(*) AS DOUBLE) AS dark, count(*) FILTER (value > 247) / CAST(count(*) AS DOUBLE) AS bright, avg(value) AS mean,
        count(*) FILTER (value // 8 = 0) / CAST(count(*) AS DOUBLE) AS h0, count(*) FILTER (value // 8 = 31) / CAST(count(*) AS DOUBLE) AS h31 FROM p GROUP BY ALL)
    SELECT capture_id, image, {r6('dark')} AS dark_fraction, {r6('bright')} AS bright_fraction, {r6('mean')} AS mean_luminance, {r6('h0')} AS first_bin, {r6('h31')} AS last_bin, {r6('v')} AS laplacian_variance
    FROM m JOIN (SELECT capture_id, image, var_pop(lap) AS v FROM l GROUP BY ALL) USING (capture_id, image)""")
def image_metrics(v):
    out = dp.image_metrics(grey(v)).withColumn("first_bin", F.col("luminance_histogram")[0]).withColumn("last_bin", F.col("luminance_histogram")[31])
    return out.select("capture_id", "image", *r6c("dark_fraction", "bright_fraction", "mean_luminance", "first_bin", "last_bin", "laplacian_variance"))


PSNR = """WITH t AS (SELECT o_orderkey // 5000 AS capture_id, o_orderkey % 7 AS rank, o_orderkey % 53 AS y, o_custkey % 71 AS x, min(o_totalprice) / 600000 AS truth FROM orders GROUP BY ALL),
      r AS (SELECT l_orderkey // 5000 AS capture_id, l_orderkey % 7 AS rank, l_orderkey % 53 AS y, l_partkey % 71 AS x, CASE WHEN l_returnflag = 'A' THEN 'initial' ELSE 'final' END AS phase,
              max(l_extendedprice) / 110000 AS value, min(l_discount) * 10 AS alpha FROM lineitem GROUP BY ALL)
    SELECT capture_id, rank, phase, avg((value - truth) * (value - truth)) AS mse, count(*) FILTER (alpha > 0.5) / CAST(count(*) AS DOUBLE) AS coverage,
      -10 * log10(greatest(avg((value - truth) * (value - truth)), 1e-12)) AS psnr_db FROM r JOIN t USING (capture_id, rank, y, x) GROUP BY ALL"""


def pair_errors(v):
    k = F.col("o_orderkey")
    truth = v.table("orders").groupBy(F.floor(k / 5000).alias("capture_id"), (k % 7).alias("rank"), (k % 53).alias("y"), (F.col("o_custkey") % 71).alias("x")).agg(
        (F.min("o_totalprice") / 600000).alias("truth"))
    k = F.col("l_orderkey")
    shown = v.table("lineitem").groupBy(
        F.floor(k / 5000).alias("capture_id"), (k % 7).alias("rank"), (k % 53).alias("y"), (F.col("l_partkey") % 71).alias("x"),
        F.when(F.col("l_returnflag") == "A", "initial").otherwise("final").alias("phase")).agg(
        (F.max("l_extendedprice") / 110000).alias("value"), (F.min("l_discount") * 10).alias("alpha"))
    return dp.image_pair_error(shown, truth)


@query("image_pair_psnr", sql=f"SELECT capture_id, rank, phase, {r6('mse')} AS mse, {r6('coverage')} AS coverage, {r6('psnr_db')} AS psnr_db FROM ({PSNR})")
def image_pair_psnr(v):
    return pair_errors(v).select("capture_id", "rank", "phase", *r6c("mse", "coverage", "psnr_db"))


@query("gain_gate", sql=f"""
    SELECT capture_id, {r6('i')} AS initial_db, {r6('f')} AS final_db, CASE WHEN coalesce(f > i + 1, false) THEN 'PASSED' ELSE 'GAUSSIAN_QUALITY' END AS status FROM
      (SELECT capture_id, avg(psnr_db) FILTER (phase = 'initial') AS i, avg(psnr_db) FILTER (phase = 'final') AS f FROM ({PSNR}) GROUP BY ALL)""")
def gain_gate(v):
    return dp.gain_gate(pair_errors(v)).select("capture_id", *r6c("initial_db", "final_db"), "status")


# --- regions and objects ------------------------------------------------------

POINTS = """SELECT l_orderkey // 5000 AS capture_id, l_partkey * 10000000 + l_suppkey AS point_id, (min(l_quantity) - 25) / 25 + CAST(0.4 AS DOUBLE) AS x,
    min(l_discount) * 10 - CAST(0.5 AS DOUBLE) AS y, min(l_extendedprice) / 100000 + CAST(1.5 AS DOUBLE) AS z FROM lineitem GROUP BY 1, 2"""


def object_points(v):
    return v.table("lineitem").groupBy(F.floor(F.col("l_orderkey") / 5000).alias("capture_id"), (F.col("l_partkey") * 10000000 + F.col("l_suppkey")).alias("point_id")).agg(
        F.min("l_quantity").alias("q"), F.min("l_discount").alias("e"), F.min("l_extendedprice").alias("p")).select(
        "capture_id", "point_id", ((F.col("q") - 25) / 25 + 0.4).alias("x"), (F.col("e") * 10 - 0.5).alias("y"), (F.col("p") / 100000 + 1.5).alias("z"))


VISIBLE = f"""WITH j AS (SELECT p.*, image AS rank, 50 * (x + tx) / z + 20 AS px, 50 * (y + ty) / z + 15 AS py FROM ({POINTS}) p JOIN depth_cameras c ON c.capture_id = p.capture_id),
      f AS (SELECT *, min(z) OVER (PARTITION BY capture_id, rank, floor(px / 3), floor(py / 3)) AS near FROM j WHERE px >= 0 AND px < 40 AND py >= 0 AND py < 30)
    SELECT capture_id, point_id, x, y, z, rank, px, py FROM f WHERE z <= near + 0.12"""


def visible(v):
    return rm.zbuffer_visible(object_points(v), v.depth_cameras.withColumnRenamed("image", "rank"))


@query("zbuffer_visible", "depth_cameras", sql=f"SELECT capture_id, point_id, rank, {r6('px')} AS px, {r6('py')} AS py FROM ({VISIBLE})")
def zbuffer_visible(v):
    return visible(v).select("capture_id", "point_id", "rank", *r6c("px", "py"))


# Marked polygons of four objects per capture, drawn from the orders of its key range.
OBJECT_POLYGONS = """SELECT o_orderkey // 5000 AS capture_id, 1 + o_custkey % 7 AS image, o_custkey % 4 AS object_id, min(o_orderkey) % 11 AS k FROM orders GROUP BY ALL"""


def object_polygons(v):
    k = F.col("k")
    corner = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), F.lit(float(y)).alias("y"))
    marked = v.table("orders").groupBy(F.floor(F.col("o_orderkey") / 5000).alias("capture_id"), (1 + F.col("o_custkey") % 7).alias("image"),
                                       (F.col("o_custkey") % 4).alias("object_id")).agg((F.min("o_orderkey") % 11).alias("k"))
    return marked.select("capture_id", "image", "object_id", F.array(corner(k + 1.3, 2), corner(36.1, 4), corner(33.7, 27), corner(k + 3.4, 25)).alias("polygon"))


def _clear(ax, ay, bx, by):
    return f"(({bx} - ({ax})) * (y + 0.5 - {ay}) - ({by} - {ay}) * (x + 0.5 - ({ax}))) / sqrt(({bx} - ({ax})) * ({bx} - ({ax})) + ({by} - {ay}) * ({by} - {ay})::DOUBLE) >= 3"


_INSIDE = " AND ".join(_clear(*e) for e in (("k + 1.3::DOUBLE", 2, "36.1::DOUBLE", 4), ("36.1::DOUBLE", 4, "33.7::DOUBLE", 27),
                                            ("33.7::DOUBLE", 27, "(k + 3.4::DOUBLE)", 25), ("k + 3.4::DOUBLE", 25, "(k + 1.3::DOUBLE)", 2)))


@query("object_plane_distance", "depth_pixels", "depth_schedule", sql=f"""
    WITH o AS ({OBJECT_POLYGONS}),
      i AS (SELECT o.capture_id, o.object_id, o.image, 0.6::DOUBLE * ((x + 0.5 - 20) / 50 * z - tx) + 0.8::DOUBLE * z - (1.7::DOUBLE + 0.01::DOUBLE * object_id) AS d
            FROM o JOIN ({SUPPORT}) s ON s.capture_id = o.capture_id AND s.image = o.image JOIN depth_cameras c ON c.capture_id = o.capture_id AND c.image = o.image WHERE accepted AND {_INSIDE}),
      g AS (SELECT capture_id, object_id, image, median(d) AS m, quantile_cont(abs(d), 0.9) AS p, count(*) AS n FROM i GROUP BY ALL)
    SELECT capture_id, object_id, image, {r6('m')} AS signed_median_m, {r6('p')} AS absolute_p90_m, coalesce(n, 0) AS accepted_object_pixels,
      CASE WHEN n > 0 THEN 'SUPPORTED_PIXELS_ONLY' ELSE 'MISSING_STEREO_SUPPORT' END AS status FROM (SELECT capture_id, object_id, image FROM o) LEFT JOIN g USING (capture_id, object_id, image)""")
def object_plane_distance(v):
    polygons = stage(object_polygons(v))
    planes = polygons.select("capture_id", "object_id").distinct().select(
        "capture_id", "object_id", F.lit(0.6).alias("normal_x"), F.lit(0.0).alias("normal_y"), F.lit(0.8).alias("normal_z"), (-(1.7 + 0.01 * F.col("object_id"))).alias("plane_d"))
    inside = stage(gd.polygon_pixels(polygons, support(v)))
    out = gd.polygon_plane_distance(inside, v.depth_cameras, planes, polygons)
    return out.select("capture_id", "object_id", "image", *r6c("signed_median_m", "absolute_p90_m"), "accepted_object_pixels", "status")


OBJECT_REGIONS = """SELECT capture_id, image AS rank, image % 2 AS object_id, 4 + image AS x0, CAST(0 AS DOUBLE) AS h0, 2.0 - (image % 2) * 0.6::DOUBLE AS h1 FROM depth_cameras"""


def object_regions(v):
    i = F.col("image")
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(float(y)).alias("y"))
    poly = F.array(corner(4 + i, 3), corner(F.lit(36), 5), corner(F.lit(30), 27), corner(F.lit(9), 26))
    return v.depth_cameras.select("capture_id", i.alias("rank"), (i % 2).alias("object_id"), poly.alias("polygon"), F.lit(0.0).alias("h0"), (2.0 - (i % 2) * 0.6).alias("h1"))


def object_rooms(v):
    return v.depth_cameras.select("capture_id").distinct().select(
        "capture_id", F.lit(0.8).alias("ax"), F.lit(0.6).alias("ay"), F.lit(-0.6).alias("bx"), F.lit(0.8).alias("by"),
        F.lit(0.6).alias("lo0"), F.lit(0.4).alias("lo1"), F.lit(2.4).alias("hi0"), F.lit(2.2).alias("hi1"))


def _edge(ax, ay, bx, by):
    return f"CASE WHEN (({ay} > gy) <> ({by} > gy)) AND gx < ({bx} - {ax}) * (gy - {ay}) / ({by} - {ay}) + {ax} THEN 1 ELSE 0 END"


_EDGES = " + ".join(_edge(*e) for e in (("x0", "3.0", "36.0", "5.0"), ("36.0", "5.0", "30.0", "27.0"), ("30.0", "27.0", "9.0", "26.0"), ("9.0", "26.0", "x0", "3.0")))


@query("object_footprints", "depth_cameras", sql=f"""
    WITH v AS (SELECT *, x AS u, z AS v_, y + 0.5 AS h, floor(px) + 0.5 AS gx, floor(py) + 0.5 AS gy FROM ({VISIBLE})),
      i AS (SELECT *, u * 0.8 + v_ * 0.6 AS p0, u * -0.6 + v_ * 0.8 AS p1 FROM v),
      s AS (SELECT DISTINCT i.capture_id, object_id, point_id, p0, p1, h FROM i JOIN ({OBJECT_REGIONS}) r ON r.capture_id = i.capture_id AND r.rank = i.rank
            WHERE p0 BETWEEN 0.6 AND 2.4 AND p1 BETWEEN 0.4 AND 2.2 AND h BETWEEN h0 AND h1 AND ({_EDGES}) % 2 = 1),
      q AS (SELECT capture_id, object_id, count(*) AS n, {', '.join(f'quantile_cont({c}, {p}) AS {a}' for c, a, p in (('p0', 'x0', 0.05), ('p0', 'x1', 0.95), ('p1', 'y0', 0.05), ('p1', 'y1', 0.95), ('h', 'z0', 0.05), ('h', 'z1', 0.95)))} FROM s GROUP BY ALL),
      b AS (SELECT *, (x0+x1)/2 - greatest(x1-x0, 0.5)/2 AS xa, (x0+x1)/2 + greatest(x1-x0, 0.5)/2 AS xb, (y0+y1)/2 - greatest(y1-y0, 0.5)/2 AS ya, (y0+y1)/2 + greatest(y1-y0, 0.5)/2 AS yb FROM
            (SELECT DISTINCT capture_id, object_id FROM ({OBJECT_REGIONS})) o LEFT JOIN q USING (capture_id, object_id))
    SELECT capture_id, object_id, coalesce(n, 0) AS source_voxels, CASE WHEN coalesce(n, 0) >= 80 THEN 'APPROXIMATE_IMAGE_ASSISTED_FOOTPRINT' ELSE 'INSUFFICIENT_VISIBLE_SUPPORT' END AS status,
      {', '.join(f"{r6(f'CASE WHEN n >= 80 THEN {e} END')} AS {a}" for e, a in (('least(greatest(xa, 0.6), 2.4)', 'box_lo0'), ('least(greatest(xb, 0.6), 2.4)', 'box_hi0'), ('least(greatest(ya, 0.4), 2.2)', 'box_lo1'), ('least(greatest(yb, 0.4), 2.2)', 'box_hi1'), ('z0', 'height_lo_m'), ('z1', 'height_hi_m')))} FROM b""")
def object_footprints(v):
    vis = visible(v).select("*", F.col("x").alias("u"), F.col("z").alias("v"), (F.col("y") + 0.5).alias("h"))
    regions, rooms = object_regions(v), object_rooms(v)
    s = stage(rm.object_support(vis, regions, rooms))
    objects = regions.select("capture_id", "object_id").distinct().select("*", F.lit(0.5).alias("min0"), F.lit(0.5).alias("min1"))
    out = rm.object_footprints(s, objects, rooms)
    return out.select("capture_id", "object_id", "source_voxels", "status", *r6c("box_lo0", "box_hi0", "box_lo1", "box_hi1", "height_lo_m", "height_hi_m"))


# regions: rectangles per view and plane, one of each kind
REGION_SQL = """SELECT capture_id, image AS rank, k.k AS region_index, CASE WHEN k.k < 3 THEN 0 ELSE 1 END AS plane_index, ['FLOOR', 'MIXED', 'FURNITURE', 'WALL', 'UNKNOWN', 'FLOOR'][k.k + 1] AS role,
    CAST(2 + 5 * k.k AS DOUBLE) AS x0, CAST(14 + 5 * k.k AS DOUBLE) AS x1, CAST(3 + k.k AS DOUBLE) AS y0, CAST(20 + image AS DOUBLE) AS y1 FROM depth_cameras, range(6) k(k)"""


def samples(v):
    return v.depth_pixels.select("capture_id", F.col("image").alias("rank"), (F.col("y") * 40 + F.col("x")).alias("sample_id"), "x", "y", ((F.col("x") + F.col("y")) % 2).alias("plane_index"))


def regions(v):
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("k")
    r = v.depth_cameras.select("capture_id", F.col("image").alias("rank"), k)
    role = F.element_at(F.array(*[F.lit(x) for x in ("FLOOR", "MIXED", "FURNITURE", "WALL", "UNKNOWN", "FLOOR")]), (F.col("k") + 1).cast("int"))
    r = r.select("capture_id", "rank", F.col("k").alias("region_index"), F.when(F.col("k") < 3, 0).otherwise(1).cast("bigint").alias("plane_index"), role.alias("role"),
                 (2 + 5 * F.col("k")).cast("double").alias("x0"), (14 + 5 * F.col("k")).cast("double").alias("x1"), (3 + F.col("k")).cast("double").alias("y0"), (20 + F.col("rank")).cast("double").alias("y1"))
    c = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return r.withColumn("polygon", F.array(c("x0", "y0"), c("x1", "y0"), c("x1", "y1"), c("x0", "y1"))).drop("x0", "x1", "y0", "y1")


ROLES_SQL = f"""WITH s AS (SELECT capture_id, image AS rank, y * 40 + x AS sample_id, x, y, (x + y) % 2 AS plane_index FROM depth_pixels),
      h AS (SELECT s.capture_id, s.rank, s.sample_id, region_index, role, CASE role WHEN 'FURNITURE' THEN 3 WHEN 'MIXED' THEN 2 WHEN 'UNKNOWN' THEN 1 ELSE 0 END AS w
            FROM s JOIN ({REGION_SQL}) r ON r.capture_id = s.capture_id AND r.rank = s.rank AND r.plane_index = s.plane_index
            WHERE x + 0.5 BETWEEN x0 AND x1 AND y + 0.5 BETWEEN y0 AND y1),
      b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, rank, sample_id ORDER BY w DESC, region_index) AS pos,
              bool_or(role = 'FLOOR') OVER (PARTITION BY capture_id, rank, sample_id) AND bool_or(role = 'WALL') OVER (PARTITION BY capture_id, rank, sample_id) AS conflict FROM h) WHERE pos = 1)
    SELECT s.capture_id, s.rank, s.sample_id, s.plane_index, coalesce(role, 'UNREVIEWED') AS role, coalesce(region_index, -1) AS region_index, coalesce(conflict, false) AS conflict
    FROM s LEFT JOIN b USING (capture_id, rank, sample_id)"""


@query("region_roles", "depth_pixels", "depth_cameras", sql=ROLES_SQL)
def region_roles(v):
    return bd.region_roles(samples(v), regions(v)).drop("x", "y")


@query("region_observations", "depth_pixels", "depth_cameras", sql=f"""
    SELECT r.capture_id, r.region_index, r.role, coalesce(n, 0) AS observations FROM (SELECT capture_id, rank * 10 + region_index AS region_index, role FROM ({REGION_SQL})) r LEFT JOIN
      (SELECT capture_id, rank * 10 + region_index AS region_index, count(*) AS n FROM ({ROLES_SQL}) WHERE region_index >= 0 GROUP BY ALL) USING (capture_id, region_index)""")
def region_observations(v):
    number = lambda df: df.withColumn("region_index", F.when(F.col("region_index") >= 0, F.col("rank") * 10 + F.col("region_index")).otherwise(-1))
    return bd.region_observations(number(bd.region_roles(samples(v), regions(v))), number(regions(v)))


@query("region_conflicts", "depth_pixels", "depth_cameras", sql=f"""
    SELECT capture_id, count(*) AS samples, 'BOUNDARY_REGION_CONFLICT' AS code FROM ({ROLES_SQL}) WHERE conflict GROUP BY capture_id""")
def region_conflicts(v):
    return bd.region_conflicts(bd.region_roles(samples(v), regions(v)))


@query("role_counts", "depth_pixels", "depth_cameras", sql=f"SELECT capture_id, role, count(*) AS samples FROM ({ROLES_SQL}) GROUP BY ALL")
def role_counts(v):
    return bd.role_counts(bd.region_roles(samples(v), regions(v)))


@query("sample_stride", "depth_pixels", sql=f"SELECT capture_id, image, y, x, {r6('z')} AS z FROM depth_pixels WHERE y % 4 = 0 AND x % 4 = 0")
def sample_stride(v):
    return sf.sample_stride(v.depth_pixels, 4).select("capture_id", "image", "y", "x", *r6c("z"))
