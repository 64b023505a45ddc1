"""Queries over the row contracts of cameras, rasters, annotations and asset bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from capstrata.operators import depth as dp
from capstrata.operators import tracks as tr
from capstrata.operators import validate as va
from capstrata.plans.registry import query
from capstrata.plans.views import Views

# One camera row per line item, one capture per supplier; some rows break the contract, some suppliers have no media.
ROWS = """SELECT l_suppkey AS capture_id, l_orderkey * 10 + l_linenumber AS rank, CASE WHEN l_partkey % 41 = 0 THEN 480 ELSE 640 END AS width, 480 AS height,
    CAST(l_quantity AS DOUBLE) - 3 AS fx, CAST(50 + l_partkey % 3 AS DOUBLE) AS fy, CAST(l_partkey % 700 AS DOUBLE) AS cx, CAST(10 AS DOUBLE) AS cy,
    CAST(l_tax AS DOUBLE) AS exposure_sec, CASE l_linenumber WHEN 6 THEN NULL WHEN 7 THEN '' ELSE 'normal' END AS tracking_state FROM lineitem"""


def camera_rows(v: Views):
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    return v.table("lineitem").select(
        F.col("l_suppkey").alias("capture_id"), (F.col("l_orderkey") * 10 + line).alias("rank"), F.when(part % 41 == 0, 480).otherwise(640).alias("width"), F.lit(480).alias("height"),
        (F.col("l_quantity").cast("double") - 3).alias("fx"), (50 + part % 3).cast("double").alias("fy"), (part % 700).cast("double").alias("cx"), F.lit(10.0).alias("cy"),
        F.col("l_tax").cast("double").alias("exposure_sec"), F.when(line == 7, "").when(line != 6, "normal").alias("tracking_state"))


@query("camera_row_violations", sql=f"""
    WITH r AS ({ROWS}), j AS (SELECT r.*, s_suppkey % 17 > 0 AS known FROM r LEFT JOIN supplier ON s_suppkey = capture_id)
    SELECT capture_id, rank, code FROM (SELECT capture_id, rank, unnest([
      CASE WHEN NOT known OR width <> 640 THEN 'CALIBRATION_GRID_MISMATCH' END,
      CASE WHEN NOT known OR fx <= 0 OR cx >= 640 THEN 'INVALID_INTRINSICS' END,
      CASE WHEN exposure_sec <= 0 THEN 'INVALID_EXPOSURE' END,
      CASE WHEN coalesce(tracking_state, '') = '' THEN 'MISSING_TRACKING_STATE' END]) AS code FROM j) WHERE code IS NOT NULL""")
def camera_row_violations(v):
    media = v.table("supplier").where("s_suppkey % 17 > 0").select(F.col("s_suppkey").alias("capture_id"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    return va.camera_row_violations(camera_rows(v), media)


@query("matrix_violations", sql=f"""
    WITH r AS ({ROWS}), last AS (SELECT capture_id, arg_max(fy, rank) AS fy, max(rank) AS rank FROM (SELECT capture_id, rank, max(fy) AS fy FROM r GROUP BY ALL) GROUP BY ALL)
    SELECT s_suppkey AS capture_id, 'CALIBRATION_MISMATCH' AS code FROM supplier LEFT JOIN last ON capture_id = s_suppkey
    WHERE fy IS DISTINCT FROM 50 + s_suppkey % 3 OR rank IS NULL""")
def matrix_violations(v):
    rows = camera_rows(v).groupBy("capture_id", "rank").agg(F.lit(50.0).alias("fx"), F.max("fy").alias("fy"), F.lit(320.0).alias("cx"), F.lit(10.0).alias("cy"))
    matrices = v.table("supplier").select(
        F.col("s_suppkey").alias("capture_id"), F.lit(50.0).alias("fx"), (50 + F.col("s_suppkey") % 3).cast("double").alias("fy"), F.lit(320.0).alias("cx"), F.lit(10.0).alias("cy"))
    return va.matrix_violations(matrices, rows)


@query("raster_grid_violations", sql="""
    WITH d AS (SELECT o_custkey AS capture_id, CASE WHEN o_orderkey % 31 = 0 THEN 320 ELSE 256 END AS width, CASE WHEN o_orderkey % 53 = 0 THEN 8 ELSE 16 END AS bits FROM orders),
      c AS (SELECT o_custkey AS capture_id, CASE WHEN o_orderkey % 43 = 0 THEN 320 ELSE 256 END AS width, CASE WHEN o_orderkey % 47 = 0 THEN 16 ELSE 8 END AS bits FROM orders WHERE o_orderkey % 2 = 0),
      g AS (SELECT capture_id, min(width) AS least, count(DISTINCT width) AS n FROM d GROUP BY ALL)
    SELECT DISTINCT capture_id, code FROM (
      SELECT capture_id, 'DEPTH_ENCODING_MISMATCH' AS code FROM d WHERE bits <> 16
      UNION ALL SELECT capture_id, 'DEPTH_GRID_MISMATCH' FROM g WHERE n > 1
      UNION ALL SELECT capture_id, 'CONFIDENCE_ENCODING_MISMATCH' FROM c WHERE bits <> 8
      UNION ALL SELECT capture_id, 'CONFIDENCE_GRID_MISMATCH' FROM c JOIN g USING (capture_id) WHERE width <> least)""")
def raster_grid_violations(v):
    k = F.col("o_orderkey")

    def rasters(df, odd_grid, odd_bits, bits, other):
        return df.select(F.col("o_custkey").alias("capture_id"), F.when(k % odd_grid == 0, 320).otherwise(256).alias("width"), F.lit(192).alias("height"),
                         F.when(k % odd_bits == 0, other).otherwise(bits).alias("bit_depth"))

    orders = v.table("orders")
    return dp.grid_violations(rasters(orders, 31, 53, 16, 8), rasters(orders.where(k % 2 == 0), 43, 47, 8, 16))


@query("annotation_violations", "frames", "annotations", sql="""
    WITH a AS (SELECT capture_id, object_id % 1000 AS object_id, start_sec, CASE WHEN object_id % 37 = 0 THEN start_sec ELSE end_sec END AS end_sec,
        capture_id % 7 = 0 AND object_id % 3 = 0 AS other, object_id % 19 AS width_m FROM annotations),
      n AS (SELECT *, count(*) OVER (PARTITION BY capture_id, object_id) AS n FROM a)
    SELECT DISTINCT capture_id, object_id, code FROM (
      SELECT capture_id, object_id, 'ANNOTATION_SOURCE_MISMATCH' AS code FROM n WHERE other
      UNION ALL SELECT capture_id, object_id, 'INVALID_ANNOTATION' FROM n WHERE n > 1 OR width_m = 0 OR start_sec >= end_sec OR NOT EXISTS
        (SELECT 1 FROM frames f WHERE f.capture_id = n.capture_id AND CAST(f.relative_sec AS DOUBLE) BETWEEN start_sec AND end_sec))""")
def annotation_violations(v):
    k, c = F.col("object_id"), F.col("capture_id")
    a = v.annotations.select(
        "capture_id", (k % 1000).alias("object_id"), "start_sec", F.when(k % 37 == 0, F.col("start_sec")).otherwise(F.col("end_sec")).alias("end_sec"),
        F.when((c % 7 == 0) & (k % 3 == 0), "other").otherwise(F.md5(c.cast("string"))).alias("source_video_sha256"), (k % 19).cast("double").alias("width_m"), F.lit(1.0).alias("height_m"))
    videos = v.annotations.select("capture_id").distinct().withColumn("sha256", F.md5(c.cast("string")))
    return va.annotation_violations(a, v.frames, videos)


@query("camera_changes", sql="""
    WITH b AS (SELECT DISTINCT l_suppkey AS capture_id, l_orderkey * 10 + l_linenumber AS rank, l_orderkey % 43 = 0 AS unknown FROM lineitem)
    SELECT capture_id, CASE change WHEN 'ADDED' THEN -rank ELSE rank END AS rank, change, 'RECONSTRUCTION_CAMERAS_CHANGED' AS code FROM (
      SELECT capture_id, rank, 'LOST' AS change FROM b WHERE rank % 31 = 0 OR rank % 41 = 0
      UNION ALL SELECT capture_id, rank, 'ADDED' FROM b WHERE rank % 31 <> 0 AND rank % 41 = 0
      UNION ALL SELECT capture_id, rank, 'MOVED' FROM b WHERE rank % 31 <> 0 AND rank % 41 <> 0 AND (rank % 37 = 0 OR unknown))""")
def camera_changes(v):
    line = v.table("lineitem")
    before = line.groupBy(F.col("l_suppkey").alias("capture_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rank")).agg(
        F.max("l_quantity").cast("double").alias("tx"), F.max(F.when(F.col("l_orderkey") % 43 != 0, F.col("l_tax").cast("double"))).alias("ty"))
    r = F.col("rank")
    after = before.where(r % 31 != 0).select(
        "capture_id", F.when(r % 41 == 0, -r).otherwise(r).alias("rank"), (F.col("tx") + F.when(r % 37 == 0, 1e-6).when(r % 47 == 0, 1e-12).otherwise(0.0)).alias("tx"), "ty")
    return tr.camera_changes(before, after)


def streams(v: Views):
    """Frames, calibrations and poses of orders, the latter two with gaps."""
    k = F.col("frame_id")
    frames = v.table("orders").select(F.col("o_custkey").alias("capture_id"), F.col("o_orderkey").alias("frame_id"))
    return frames, frames.where(k % 101 != 0).withColumn("fx", (k % 11).cast("double")), frames.where(k % 103 != 0).withColumn("px", (k % 13).cast("double"))


@query("associated_frames", sql="""
    SELECT o_custkey AS capture_id, o_orderkey AS frame_id, CAST(o_orderkey % 11 AS DOUBLE) AS fx, CAST(o_orderkey % 13 AS DOUBLE) AS px FROM orders
    WHERE o_orderkey % 101 <> 0 AND o_orderkey % 103 <> 0""")
def associated_frames(v):
    return va.associated_frames(*streams(v))[0]


@query("association_failures", sql="""
    SELECT DISTINCT o_custkey AS capture_id, 'PREPROCESS_ASSOCIATION_FAILED' AS code FROM orders WHERE o_orderkey % 101 = 0 OR o_orderkey % 103 = 0""")
def association_failures(v):
    return va.associated_frames(*streams(v))[1]


@query("asset_binding", sql="""
    SELECT o_custkey AS capture_id, o_orderkey AS frame, CASE WHEN o_orderkey % 3 <> 0 THEN 'depth-' || o_orderkey END AS depth_asset_id,
      CASE WHEN o_orderkey % 5 = 0 THEN 'confidence-' || o_orderkey END AS confidence_asset_id, 'video-' || c_custkey AS rgb_asset_id
    FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 11 > 0) ON c_custkey = o_custkey""")
def asset_binding(v):
    k = F.col("frame")
    seen = v.table("orders").select(F.col("o_custkey").alias("capture_id"), F.col("o_orderkey").alias("frame"))
    named = lambda kind: F.concat(F.lit(f"{kind}-"), k)
    rgb = v.table("customer").where("c_custkey % 11 > 0").select(F.col("c_custkey").alias("capture_id"), F.concat(F.lit("video-"), "c_custkey").alias("asset_id"))
    return va.bind_assets(seen, seen.where(k % 3 != 0).withColumn("asset_id", named("depth")), seen.where(k % 5 == 0).withColumn("asset_id", named("confidence")), rgb)
