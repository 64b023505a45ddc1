"""Queries over review, annotation and selection contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from capstrata.operators import boundaries as bd
from capstrata.operators import grounding as gd
from capstrata.operators import reviews as rv
from capstrata.operators.ordered import sequence_over
from capstrata.plans.registry import query
from capstrata.session import stage

# One review per customer, one region per order; some orders carry an id, hash, time or plane that breaks the contract.
REGIONS = """SELECT o_custkey AS capture_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position, o_orderkey AS ok,
    'r' || lpad(CAST(o_orderkey - (CASE WHEN o_orderkey % 37 = 0 THEN 20000 ELSE 0 END) AS VARCHAR), 12, '0') AS region_id,
    CASE WHEN o_orderkey % 59 = 0 THEN '' ELSE o_orderpriority END AS reason, o_orderkey % 9 AS rank, o_orderkey % 4 AS plane_index,
    ['FLOOR', 'WALL', 'FURNITURE', 'UNREVIEWED', 'WALL'][o_orderkey % 5 + 1] AS role, o_orderkey % 13 * 50 AS x0, o_orderkey % 45 AS w FROM orders"""
REVIEWS = f"""SELECT c_custkey AS capture_id, CASE WHEN c_custkey % 31 = 0 THEN '' ELSE c_name END AS reviewer,
    ['ASSISTANT_VISUAL_REVIEW', 'USER_VISUAL_REVIEW', 'USER_VISUAL_REVIEW', 'NOBODY'][c_nationkey % 4 + 1] AS authority, c_custkey % 3 = 0 AS human_confirmed,
    CASE WHEN c_custkey % 5 < 4 THEN c_custkey % 5 END AS floor_plane FROM customer"""


def regions(v):
    o = sequence_over(v.table("orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], ["o_orderkey"], rank="position")
    k = F.col("o_orderkey")
    pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))
    return stage(o.select(
        F.col("o_custkey").alias("capture_id"), "position", k.alias("ok"),
        F.concat(F.lit("r"), F.lpad((k - F.when(k % 37 == 0, 20000).otherwise(0)).cast("string"), 12, "0")).alias("region_id"),
        F.when(k % 59 == 0, "").otherwise(F.col("o_orderpriority")).alias("reason"), (k % 9).alias("rank"), (k % 4).alias("plane_index"),
        pick("FLOOR", "WALL", "FURNITURE", "UNREVIEWED", "WALL").alias("role"), (k % 13 * 50).alias("x0"), (k % 45).alias("w")))


def planes(v):
    at = F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(3)]))
    return v.table("customer").select(F.col("c_custkey").alias("capture_id"), at.alias("plane_index")).withColumn(
        "orientation", F.element_at(F.array(F.lit("horizontal"), F.lit("vertical"), F.lit("oblique")), (F.col("plane_index") + 1).cast("int")))


def views(v):
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint")))
    return v.table("customer").select(F.col("c_custkey").alias("capture_id"), at.alias("rank")).select(
        "capture_id", "rank", F.concat(F.lit("view"), "rank").alias("image"), (F.col("rank") * 10).alias("frame_id"), F.col("rank").cast("double").alias("relative_sec"),
        F.lit(640).alias("width"), F.lit(480).alias("height"), F.md5(F.concat("capture_id", F.lit("/"), "rank")).alias("sha256"))


@query("review_violations", sql=f"""
    WITH r AS ({REGIONS}), v AS ({REVIEWS}), s AS (SELECT *, lag(region_id) OVER (PARTITION BY capture_id ORDER BY position) AS before FROM r)
    SELECT DISTINCT capture_id, code FROM (
      SELECT capture_id, 'BOUNDARY_REVIEW_INVALID' AS code FROM v WHERE len(reviewer) NOT BETWEEN 1 AND 200 OR authority = 'NOBODY' OR (human_confirmed AND authority <> 'USER_VISUAL_REVIEW')
      UNION ALL SELECT capture_id, 'BOUNDARY_REVIEW_INVALID' FROM s WHERE region_id <= before OR reason = ''
      UNION ALL SELECT capture_id, 'BOUNDARY_REVIEW_INVALID' FROM r GROUP BY capture_id HAVING count(*) > 200
      UNION ALL SELECT capture_id, 'BOUNDARY_FLOOR_INVALID' FROM v WHERE floor_plane IS NOT NULL AND (floor_plane > 2 OR NOT EXISTS (
        SELECT 1 FROM r WHERE r.capture_id = v.capture_id AND role = 'FLOOR' AND plane_index = floor_plane)))""")
def review_violations(v):
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    reviews = v.table("customer").select(
        k.alias("capture_id"), F.when(k % 31 == 0, "").otherwise(F.col("c_name")).alias("reviewer"),
        F.element_at(F.array(F.lit(rv.ASSISTANT), F.lit(rv.USER), F.lit(rv.USER), F.lit("NOBODY")), (nation % 4 + 1).cast("int")).alias("authority"),
        (k % 3 == 0).alias("human_confirmed"), F.when(k % 5 < 4, k % 5).alias("floor_plane"))
    return rv.review_violations(reviews, regions(v), planes(v))


@query("region_violations", sql=f"""
    WITH r AS ({REGIONS}) SELECT capture_id, ok AS region_index, code FROM (
      SELECT capture_id, ok, 'BOUNDARY_REVIEW_INVALID' AS code FROM r WHERE rank > 7 OR plane_index > 2 OR role = 'UNREVIEWED'
      UNION ALL SELECT capture_id, ok, 'BOUNDARY_REVIEW_SOURCE_CHANGED' FROM r WHERE rank <= 7 AND plane_index <= 2 AND role <> 'UNREVIEWED' AND ok % 41 = 0
      UNION ALL SELECT capture_id, ok, 'BOUNDARY_REGION_INVALID' FROM r WHERE w < 2 OR x0 + w > 640 OR (plane_index <= 2 AND (role = 'FLOOR' AND plane_index <> 0 OR role = 'WALL' AND plane_index <> 1)))""")
def region_violations(v):
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(float(y)).alias("y"))
    x, far = F.col("x0"), F.col("x0") + F.col("w")
    r = regions(v).select("capture_id", F.col("ok").alias("region_index"), "rank", "plane_index", "role", F.concat(F.lit("view"), "rank").alias("image"),
                          F.lit(640).alias("width"), F.lit(480).alias("height"),
                          F.md5(F.concat("capture_id", F.when(F.col("ok") % 41 == 0, "?").otherwise("/"), "rank")).alias("sha256"),
                          F.array(corner(x, 20), corner(far, 20), corner(far, 60), corner(x, 60)).alias("polygon"))
    return bd.region_violations(r, views(v), planes(v))


@query("selection_order_violations", sql=f"""
    WITH r AS ({REGIONS}), s AS (SELECT capture_id, (ok - ok % 32) // 4 + ok % 4 AS rank, position FROM r WHERE capture_id % 2 = 0 UNION ALL SELECT capture_id, ok % 9, position FROM r WHERE capture_id % 2 = 1),
      l AS (SELECT *, lag(rank) OVER (PARTITION BY capture_id ORDER BY position) AS before FROM s)
    SELECT DISTINCT capture_id, 'RECONSTRUCTION_SELECTION_INVALID' AS code FROM (
      SELECT capture_id FROM l WHERE rank <= before OR rank = 8 UNION ALL SELECT capture_id FROM l GROUP BY ALL HAVING count(*) NOT BETWEEN 3 AND 300)""")
def selection_order_violations(v):
    k = F.col("ok")
    even = F.col("capture_id") % 2 == 0
    chosen = regions(v).select("capture_id", "position", F.when(even, F.floor((k - k % 32) / 4) + k % 4).otherwise(k % 9).alias("rank"))
    prepared = chosen.where("rank <> 8").select("capture_id", "rank")
    return rv.selection_order_violations(stage(chosen), prepared, 300)


MARKED = f"SELECT capture_id, capture_id % 7 AS object_id, position, CASE WHEN ok % 23 = 0 THEN position - 1 ELSE position END AS rank, ok FROM ({REGIONS})"


def marked(v):
    r = F.col("position")
    return regions(v).select("capture_id", (F.col("capture_id") % 7).alias("object_id"), "position", F.when(F.col("ok") % 23 == 0, r - 1).otherwise(r).alias("rank"), "ok")


@query("corner_violations", sql=f"""
    WITH m AS ({MARKED}), s AS (SELECT *, lag(rank) OVER (PARTITION BY capture_id ORDER BY position, rank) AS before FROM m)
    SELECT capture_id, object_id, CASE WHEN code <> 'ORDER' THEN rank END AS rank, replace(code, 'ORDER', 'GROUNDING_SELECTION_INVALID') AS code FROM (
      SELECT capture_id, object_id, rank, 'GROUNDING_SELECTION_INVALID' AS code FROM m WHERE rank NOT BETWEEN 0 AND 7
      UNION ALL SELECT capture_id, object_id, rank, 'GROUNDING_ANNOTATION_SOURCE_CHANGED' FROM m WHERE rank BETWEEN 0 AND 7 AND ok % 29 = 0
      UNION ALL SELECT capture_id, object_id, rank, 'GROUNDING_CORNERS_INVALID' FROM m WHERE ok % 45 < 5
      UNION ALL SELECT DISTINCT capture_id, object_id, NULL, 'ORDER' FROM (SELECT capture_id, object_id FROM s WHERE rank <= before
        UNION ALL SELECT capture_id, object_id FROM m GROUP BY ALL HAVING count(*) > 12))""")
def corner_violations(v):
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(float(y)).alias("y"))
    far = F.col("ok") % 45 + 20
    m = marked(v).select("capture_id", "object_id", "position", "rank", (F.col("rank") * 10).alias("frame_id"),
                         (F.col("rank") + F.when(F.col("ok") % 29 == 0, 0.5).otherwise(0.0)).cast("double").alias("relative_sec"), F.lit(640).alias("width"), F.lit(480).alias("height"),
                         F.md5(F.concat("capture_id", F.lit("/"), "rank")).alias("sha256"),
                         F.array(corner(F.lit(20), 20), corner(far, 20), corner(far, 60), corner(F.lit(20), 60)).alias("polygon"))
    return gd.corner_violations(m, views(v))


@query("annotation_limits", sql="""
    SELECT o_orderkey AS capture_id, o_custkey AS object_id, 'GROUNDING_ANNOTATION_INVALID' AS code FROM orders
    WHERE o_orderkey % 61 = 0 OR o_custkey % 47 > 30 OR o_orderkey % 50 > 40""")
def annotation_limits(v):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    a = v.table("orders").select(
        k.alias("capture_id"), c.alias("object_id"), F.when(k % 61 == 0, "").otherwise("a").alias("annotator"), F.lit(False).alias("human_reviewed"), F.col("o_orderpriority").alias("notes"),
        (c % 47).cast("double").alias("uncertainty_px"), (k % 50 / 200.0).alias("cover_m"))
    return rv.annotation_limit_violations(a)


@query("confirmation_violations", sql=f"""
    WITH m AS ({MARKED}), d AS (SELECT capture_id, object_id, bool_or(ok % 101 = 0) OR max(position) > 20 AS differ FROM m GROUP BY ALL),
      c AS (SELECT d.*, capture_id % 8 AS lo, capture_id % 11 AS hi, capture_id % 2 = 0 AS li, capture_id % 3 = 0 AS ui, CASE WHEN capture_id % 5 > 0 THEN capture_id % 9 END AS ex FROM d)
    SELECT capture_id, object_id, 'GROUNDING_REVIEW_SOURCE_CHANGED' AS code FROM c WHERE differ OR capture_id % 53 = 0
    UNION ALL SELECT capture_id, object_id, 'GROUNDING_REVIEW_INVALID' FROM c WHERE capture_id % 43 = 0 OR lo >= hi OR NOT coalesce((ex > lo OR li AND ex = lo) AND (ex < hi OR ui AND ex = hi), true)""")
def confirmation_violations(v):
    m = stage(marked(v))
    k = F.col("capture_id")
    keys = m.select("capture_id", "object_id").distinct()
    annotations = keys.select("*", F.md5(k.cast("string")).alias("corners_sha256"), F.when(k % 5 > 0, (k % 9) / 100).alias("cover_m"))
    confirmations = keys.select(
        "*", F.when(k % 53 == 0, "changed").otherwise(F.md5(k.cast("string"))).alias("corners_sha256"), F.when(k % 43 == 0, "").otherwise("seen").alias("statement"),
        ((k % 8) / 100).alias("lower_m"), ((k % 11) / 100).alias("upper_m"), (k % 2 == 0).alias("lower_inclusive"), (k % 3 == 0).alias("upper_inclusive"))
    reviewed = m.where("position <= 20").withColumn("rank", F.when(F.col("ok") % 101 == 0, F.col("rank") + 1).otherwise(F.col("rank")))
    return rv.confirmation_violations(confirmations, annotations, reviewed, m)
