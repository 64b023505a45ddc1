"""Queries over tracks, view graphs and descriptors."""

from __future__ import annotations

from pyspark.sql import functions as F

from capstrata.operators import graph as gr
from capstrata.operators import matching as mt
from capstrata.operators import tracks as tr
from capstrata.plans.q_timeseries import r6c
from capstrata.plans.registry import query, r6
from capstrata.policies import TrackPolicy
from capstrata.session import stage

PAIRS = """SELECT a.capture_id, a.rank AS first_rank, b.rank AS second_rank, count(*) AS shared
    FROM (SELECT DISTINCT capture_id, point_id, rank FROM {t}) a JOIN (SELECT DISTINCT capture_id, point_id, rank FROM {t}) b
    ON a.capture_id = b.capture_id AND a.point_id = b.point_id AND a.rank < b.rank GROUP BY ALL"""


@query("covisible_partners", "track_obs", sql=f"""
    WITH p AS ({PAIRS.format(t='track_obs')}),
      s AS (SELECT capture_id, first_rank AS rank, second_rank AS partner, shared FROM p UNION ALL
            SELECT capture_id, second_rank, first_rank, shared FROM p)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, rank ORDER BY shared DESC, partner) AS place FROM s) WHERE place <= 6""")
def covisible_partners(v):
    return tr.covisible_partners(tr.covisible_pairs(v.track_obs), 6)


@query("overlap_violations", "sparse_tracks", sql=f"""
    WITH p AS ({PAIRS.format(t='sparse_tracks')}),
      s AS (SELECT capture_id, first_rank AS rank FROM p UNION ALL SELECT capture_id, second_rank FROM p),
      n AS (SELECT capture_id, rank, count(*) AS partners FROM s GROUP BY ALL)
    SELECT capture_id, rank, coalesce(partners, 0) AS partners, 'DENSE_OVERLAP_INSUFFICIENT' AS code
    FROM (SELECT DISTINCT capture_id, rank FROM sparse_tracks) LEFT JOIN n USING (capture_id, rank) WHERE coalesce(partners, 0) < 2""")
def overlap_violations(v):
    views = v.sparse_tracks.select("capture_id", "rank").distinct()
    return tr.overlap_violations(views, tr.covisible_partners(tr.covisible_pairs(v.sparse_tracks), 6))


REVISIT = TrackPolicy(revisit_distance_m=0.5, revisit_degrees=60.0, revisit_seconds=200000.0)
_D = "sqrt((a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py)+(a.pz-b.pz)*(a.pz-b.pz))"
_T = " + ".join(f"a.w{k}{i}*b.w{k}{i}" for i in range(3) for k in range(3))


@query("revisit_pairs", "frame_poses", sql=f"""
    WITH f AS (SELECT *, CAST(relative_sec AS DOUBLE) AS sec, count(*) OVER (PARTITION BY capture_id) AS n FROM frame_poses),
      w AS (SELECT a.capture_id, a.rank AS first_rank, b.rank AS second_rank FROM f a JOIN f b ON a.capture_id = b.capture_id
            AND b.rank > a.rank AND (a.n <= 24 OR b.rank - a.rank <= 8)),
      c AS (SELECT a.capture_id, a.rank AS first_rank, b.rank AS second_rank, row_number() OVER (PARTITION BY a.capture_id, a.rank ORDER BY {_D}, b.rank) AS place
            FROM f a JOIN f b ON a.capture_id = b.capture_id AND b.rank > a.rank + 8 WHERE a.n > 24 AND b.sec - a.sec >= 200000
            AND {_D} < 0.5 AND degrees(acos(greatest(-1.0, least(1.0, ({_T} - 1) / 2)))) < 60)
    SELECT * FROM w UNION SELECT capture_id, first_rank, second_rank FROM c WHERE place <= 6""")
def revisit_pairs(v):
    return tr.revisit_pairs(v.poses, REVISIT)


GEOM = """SELECT o.capture_id, o.point_id, o.rank, z + tz AS depth,
      sqrt((fx*(x+tx)/(z+tz)+cx-px)*(fx*(x+tx)/(z+tz)+cx-px) + (fy*(y+ty)/(z+tz)+cy-py)*(fy*(y+ty)/(z+tz)+cy-py)) AS residual,
      (x-ox)/sqrt((x-ox)*(x-ox)+(y-oy)*(y-oy)+(z-oz)*(z-oz)) AS dx, (y-oy)/sqrt((x-ox)*(x-ox)+(y-oy)*(y-oy)+(z-oz)*(z-oz)) AS dy,
      (z-oz)/sqrt((x-ox)*(x-ox)+(y-oy)*(y-oy)+(z-oz)*(z-oz)) AS dz
    FROM track_obs o JOIN track_points p ON p.capture_id = o.capture_id AND p.point_id = o.point_id
    JOIN track_cameras c ON c.capture_id = o.capture_id AND c.rank = o.rank"""
METRICS = f"""WITH g AS MATERIALIZED ({GEOM}),
      a AS (SELECT capture_id, point_id, count(*) AS observations, count(DISTINCT rank) AS views, min(depth) AS min_depth, max(residual) AS max_residual FROM g GROUP BY ALL),
      c AS (SELECT a.capture_id, a.point_id, max(sqrt((a.dx-b.dx)*(a.dx-b.dx)+(a.dy-b.dy)*(a.dy-b.dy)+(a.dz-b.dz)*(a.dz-b.dz))) AS chord
            FROM g a JOIN g b ON a.capture_id = b.capture_id AND a.point_id = b.point_id GROUP BY ALL),
      m AS (SELECT *, degrees(2 * asin(least(chord / 2, 1.0))) AS max_angle_degrees FROM a JOIN c USING (capture_id, point_id))
    SELECT capture_id, point_id, observations, min_depth, max_residual, max_angle_degrees,
      concat_ws(';', CASE WHEN views <> observations THEN 'DUPLICATE_IMAGE_IN_TRACK' END, CASE WHEN observations < 3 THEN 'SHORT_TRACK' END,
        CASE WHEN min_depth <= 0 THEN 'NONPOSITIVE_DEPTH' END, CASE WHEN max_residual > 4 THEN 'REPROJECTION' END,
        CASE WHEN max_angle_degrees < 1.5 THEN 'LOW_PARALLAX' END) AS reasons FROM m"""


def geometry(v):
    return tr.observation_geometry(v.track_points, v.track_obs, v.track_cameras)


@query("track_metrics", "track_obs", sql=f"""SELECT capture_id, point_id, observations, {r6('min_depth')} AS min_depth,
    {r6('max_residual')} AS max_residual, {r6('max_angle_degrees')} AS max_angle_degrees, reasons, reasons = '' AS accepted FROM ({METRICS})""")
def track_metrics(v):
    m = tr.track_metrics(geometry(v))
    return m.select("capture_id", "point_id", "observations", *r6c("min_depth", "max_residual", "max_angle_degrees"),
                    F.array_join("reasons", ";").alias("reasons"), "accepted")


@query("rejection_reasons", "track_obs", sql=f"""
    SELECT capture_id, reason, count(*) AS points FROM (SELECT capture_id, unnest(string_split(reasons, ';')) AS reason
    FROM ({METRICS}) WHERE reasons <> '') GROUP BY ALL""")
def rejection_reasons(v):
    return tr.rejection_reasons(tr.track_metrics(geometry(v)))


@query("track_report", "track_obs", sql=f"""
    WITH RECURSIVE m AS MATERIALIZED ({METRICS}), k AS MATERIALIZED (SELECT g.* FROM ({GEOM}) g JOIN m USING (capture_id, point_id) WHERE reasons = ''),
      edges AS MATERIALIZED (SELECT DISTINCT a.capture_id, a.rank AS a, b.rank AS b FROM k a JOIN k b ON a.capture_id = b.capture_id AND a.point_id = b.point_id),
      reach AS (SELECT capture_id, rank AS a, rank AS b FROM track_cameras UNION SELECT r.capture_id, r.a, e.b FROM reach r JOIN edges e ON e.capture_id = r.capture_id AND e.a = r.b),
      root AS (SELECT capture_id, a, min(b) AS root FROM reach GROUP BY ALL),
      comp AS (SELECT capture_id, max(n) AS largest, count(*) AS components FROM (SELECT capture_id, root, count(*) AS n FROM root GROUP BY ALL) GROUP BY ALL),
      v AS (SELECT capture_id, count(*) AS input_views FROM track_cameras GROUP BY ALL),
      t AS (SELECT capture_id, count(*) AS candidate_points, count(*) FILTER (reasons = '') AS accepted_points,
              median(CAST(observations AS DOUBLE)) FILTER (reasons = '') AS length_median, quantile_cont(max_angle_degrees, 0.9) FILTER (reasons = '') AS angle_p90 FROM m GROUP BY ALL),
      d AS (SELECT capture_id, count(DISTINCT rank) AS supported_images, median(residual) AS residual_median, quantile_cont(residual, 0.9) AS residual_p90, max(depth) AS depth_max FROM k GROUP BY ALL)
    SELECT capture_id, input_views, candidate_points, accepted_points, candidate_points - accepted_points AS rejected_points,
      coalesce(supported_images, 0) AS supported_images, CASE WHEN accepted_points > 0 THEN largest ELSE 0 END AS largest_component, components,
      {r6('residual_median')} AS residual_median, {r6('residual_p90')} AS residual_p90, {r6('length_median')} AS length_median,
      {r6('angle_p90')} AS angle_p90, {r6('depth_max')} AS depth_max,
      CASE WHEN coalesce(supported_images / CAST(input_views AS DOUBLE) >= 0.7 AND largest / CAST(input_views AS DOUBLE) >= 0.7 AND accepted_points > 0
        AND residual_median <= 2 AND residual_p90 <= 4, false) THEN 'SUPPORTED' ELSE 'WEAK' END AS geometry_signal
    FROM v JOIN t USING (capture_id) LEFT JOIN comp USING (capture_id) LEFT JOIN d USING (capture_id)""")
def track_report(v):
    g = stage(geometry(v))
    out = tr.track_report(v.track_cameras, g, stage(tr.track_metrics(g)))
    return out.select("capture_id", "input_views", "candidate_points", "accepted_points", "rejected_points", "supported_images",
                      "largest_component", "components", *r6c("residual_median", "residual_p90", "length_median", "angle_p90", "depth_max"),
                      "geometry_signal")


@query("view_components", "sparse_tracks", sql="""
    WITH RECURSIVE s AS (SELECT DISTINCT capture_id, point_id, rank FROM sparse_tracks),
      e AS MATERIALIZED (SELECT DISTINCT a.capture_id, a.rank AS a, b.rank AS b FROM s a JOIN s b ON a.capture_id = b.capture_id AND a.point_id = b.point_id),
      reach AS (SELECT DISTINCT capture_id, rank AS a, rank AS b FROM s UNION SELECT r.capture_id, r.a, e.b FROM reach r JOIN e ON e.capture_id = r.capture_id AND e.a = r.b)
    SELECT capture_id, a AS rank, min(b) AS component FROM reach GROUP BY ALL""")
def view_components(v):
    views = v.sparse_tracks.select("capture_id", "rank").distinct()
    return tr.view_components(views, v.sparse_tracks)


CORE = f"""WITH RECURSIVE p AS (SELECT capture_id, first_rank AS a, second_rank AS b FROM ({PAIRS.format(t='sparse_tracks')})),
      e AS MATERIALIZED (SELECT capture_id, a, b FROM p UNION ALL SELECT capture_id, b, a FROM p),
      peel AS (SELECT 0 AS step, capture_id, a FROM (SELECT DISTINCT capture_id, a FROM e) UNION ALL
        SELECT step + 1, capture_id, a FROM (SELECT x.step, e.capture_id, e.a FROM e JOIN peel x ON x.capture_id = e.capture_id AND x.a = e.a
          JOIN peel y ON y.capture_id = e.capture_id AND y.a = e.b GROUP BY x.step, e.capture_id, e.a HAVING count(*) >= 2) WHERE step < 60)
    SELECT capture_id, a AS rank FROM peel WHERE step = 60"""


@query("two_core_views", "sparse_tracks", sql=CORE)
def two_core_views(v):
    return tr.two_core_views(v.sparse_tracks)


@query("core_violations", "sparse_tracks", sql=f"""SELECT capture_id, coalesce(n, 0) AS kept, 'DENSE_OVERLAP_INSUFFICIENT' AS code
    FROM (SELECT DISTINCT capture_id FROM sparse_tracks) LEFT JOIN (SELECT capture_id, count(*) AS n FROM ({CORE}) GROUP BY ALL) USING (capture_id)
    WHERE coalesce(n, 0) < 60""")
def core_violations(v):
    views = v.sparse_tracks.select("capture_id", "rank").distinct()
    return tr.core_violations(views, tr.two_core_views(v.sparse_tracks), 60)


@query("feature_lineage", "track_obs", sql="""
    WITH k AS (SELECT capture_id, rank, keypoint_index, min(px) AS kx, min(py) AS ky, count(*) AS uses FROM track_obs GROUP BY ALL)
    SELECT capture_id, code, count(*) AS observations FROM
      (SELECT capture_id, 'KEYPOINT_MOVED' AS code FROM track_obs JOIN k USING (capture_id, rank, keypoint_index) WHERE abs(px - kx) > 1e-6 OR abs(py - ky) > 1e-6
       UNION ALL SELECT capture_id, 'KEYPOINT_ASSIGNED_TWICE' FROM track_obs JOIN k USING (capture_id, rank, keypoint_index) WHERE uses > 1) GROUP BY ALL""")
def feature_lineage(v):
    obs = stage(v.track_obs)
    keys = obs.groupBy("capture_id", "rank", "keypoint_index").agg(F.min("px").alias("kx"), F.min("py").alias("ky"))
    return tr.feature_lineage(obs, keys)


@query("partition_complete", "track_obs", sql=f"""
    WITH s AS (SELECT o_orderkey % 3 AS capture_id, o_orderkey AS point_id FROM orders WHERE o_orderstatus = 'F'),
      m AS MATERIALIZED (SELECT capture_id, point_id, reasons FROM ({METRICS})), x AS (SELECT capture_id, point_id FROM m WHERE reasons = '')
    SELECT *, 'STORED_ONLY' AS side FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM x) UNION ALL
    SELECT *, 'RECOMPUTED_ONLY' FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM s) UNION ALL
    SELECT *, 'NOT_A_CANDIDATE' FROM (SELECT * FROM s EXCEPT ALL SELECT capture_id, point_id FROM m)""")
def partition_complete(v):
    m = stage(tr.track_metrics(geometry(v)).select("capture_id", "point_id", "accepted"))
    stored = v.table("orders").where("o_orderstatus = 'F'").select(
        (F.col("o_orderkey") % 3).alias("capture_id"), F.col("o_orderkey").alias("point_id"))
    return tr.partition_difference(m.select("capture_id", "point_id"), stored, m.where("accepted").select("capture_id", "point_id"))


@query("excluded_views", "sparse_tracks", sql=f"""SELECT DISTINCT capture_id, rank FROM sparse_tracks EXCEPT ({CORE})""")
def excluded_views(v):
    """Prepared minus selected."""
    return v.sparse_tracks.select("capture_id", "rank").subtract(tr.two_core_views(v.sparse_tracks))


@query("selection_violations", "sparse_tracks", sql="""
    WITH s AS (SELECT l_orderkey // 20 AS capture_id, l_suppkey % 100 AS rank FROM lineitem),
      n AS (SELECT capture_id, count(*) AS n, count(DISTINCT rank) AS u FROM s GROUP BY ALL)
    SELECT DISTINCT capture_id, 'RECONSTRUCTION_SELECTION_INVALID' AS code FROM
      (SELECT capture_id FROM n WHERE n <> u OR u < 3 OR u > 300 UNION ALL
       SELECT capture_id FROM s WHERE NOT EXISTS (SELECT 1 FROM sparse_tracks t WHERE t.capture_id = s.capture_id AND t.rank = s.rank))""")
def selection_violations(v):
    chosen = v.table("lineitem").select(F.floor(F.col("l_orderkey") / 20).alias("capture_id"), (F.col("l_suppkey") % 100).alias("rank"))
    return tr.selection_violations(chosen, v.sparse_tracks.select("capture_id", "rank").distinct())


RATIO = 0.97
MATCHES = f"""WITH p AS (SELECT capture_id, image AS first_image, lead(image) OVER (PARTITION BY capture_id ORDER BY image) AS second_image
      FROM (SELECT DISTINCT capture_id, image FROM descriptors)),
    d AS (SELECT p.capture_id, first_image, second_image, a.feature_id AS query_id, b.feature_id AS target_id,
            list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance
          FROM p JOIN descriptors a ON a.capture_id = p.capture_id AND a.image = p.first_image JOIN descriptors b ON b.capture_id = p.capture_id AND b.image = p.second_image),
    t AS (SELECT *, row_number() OVER (PARTITION BY capture_id, first_image, query_id ORDER BY distance, target_id) AS place FROM d),
    q AS (SELECT capture_id, first_image, second_image, query_id, arg_min(target_id, place) AS target_id, min(distance) AS distance, max(distance) AS second, count(*) AS n
          FROM t WHERE place <= 2 GROUP BY ALL)
    SELECT capture_id, first_image, second_image, query_id, target_id, distance FROM
      (SELECT *, row_number() OVER (PARTITION BY capture_id, first_image, target_id ORDER BY distance, query_id) AS pos FROM q WHERE n = 2 AND distance < {RATIO} * second) WHERE pos = 1"""


@query("ratio_matches", "descriptors", sql=f"SELECT capture_id, first_image, second_image, query_id, target_id, {r6('distance')} AS distance FROM ({MATCHES})")
def ratio_matches(v):
    m = mt.ratio_matches(v.descriptors, mt.adjacent_images(v.descriptors), RATIO)
    return m.select("capture_id", "first_image", "second_image", "query_id", "target_id", *r6c("distance"))


BOUND = 7
# Parts seen in the images of a capture: 64 bits spread from the part, two bits flipped in each word by the order.
BINARY = """SELECT l_orderkey // 5000 AS capture_id, CAST(l_linenumber AS BIGINT) AS image, l_orderkey AS feature_id,
    xor(xor((l_partkey * 2654435761) % 4294967296, 1::BIGINT << (CAST(l_quantity AS BIGINT) % 32)), 1::BIGINT << (l_suppkey % 31)) AS w0,
    xor(xor((l_partkey * 2246822519) % 4294967296, 1::BIGINT << (l_orderkey % 29)), 1::BIGINT << (CAST(l_quantity AS BIGINT) * 7 % 30)) AS w1 FROM lineitem"""
NEAR_CODES = f"""WITH b AS ({BINARY}), p AS (SELECT capture_id, image AS first_image, lead(image) OVER (PARTITION BY capture_id ORDER BY image) AS second_image
      FROM (SELECT DISTINCT capture_id, image FROM b)),
    c AS (SELECT capture_id, image, w0, w1, min(feature_id) AS id, count(*) AS n FROM b GROUP BY ALL),
    d AS (SELECT p.capture_id, first_image, second_image, a.id AS query_id, b.id AS target_id, b.n AS copies, CAST(bit_count(xor(a.w0, b.w0)) + bit_count(xor(a.w1, b.w1)) AS BIGINT) AS distance
          FROM p JOIN c a ON a.capture_id = p.capture_id AND a.image = p.first_image JOIN c b ON b.capture_id = p.capture_id AND b.image = p.second_image)
    SELECT * FROM d WHERE distance <= {BOUND}"""


def binary_descriptors(v):
    bit = lambda at: F.expr(f"shiftleft(1L, cast({at} as int))")
    spread = lambda by: F.col("l_partkey") * by % 4294967296
    w0 = spread(2654435761).bitwiseXOR(bit("cast(l_quantity as bigint) % 32")).bitwiseXOR(bit("l_suppkey % 31"))
    w1 = spread(2246822519).bitwiseXOR(bit("l_orderkey % 29")).bitwiseXOR(bit("cast(l_quantity as bigint) * 7 % 30"))
    return v.table("lineitem").select(F.floor(F.col("l_orderkey") / 5000).alias("capture_id"), F.col("l_linenumber").cast("bigint").alias("image"),
                                      F.col("l_orderkey").alias("feature_id"), F.array(w0, w1).alias("code"))


@query("hamming_pairs", sql=NEAR_CODES)
def hamming_pairs(v):
    d = stage(binary_descriptors(v))
    out = mt.hamming_pairs(d, mt.adjacent_images(d), 2, BOUND)
    return out.withColumn("distance", F.col("distance").cast("bigint"))


@query("hamming_matches", sql=f"""
    WITH d AS ({NEAR_CODES}),
      t AS (SELECT *, row_number() OVER (PARTITION BY capture_id, first_image, query_id ORDER BY distance, target_id) AS place FROM d),
      q AS (SELECT capture_id, first_image, second_image, query_id, arg_min(target_id, place) AS target_id, arg_min(copies, place) AS n, min(distance) AS distance, min(distance) FILTER (place = 2) AS second
            FROM t WHERE place <= 2 GROUP BY ALL),
      g AS (SELECT *, row_number() OVER (PARTITION BY capture_id, first_image, target_id ORDER BY distance, query_id) AS pos FROM q
            WHERE distance < 0.75::DOUBLE * least(coalesce(second, {BOUND + 1}), CASE WHEN n > 1 THEN distance ELSE {BOUND + 1} END))
    SELECT capture_id, first_image, second_image, query_id, target_id, distance FROM g WHERE pos = 1""")
def hamming_matches(v):
    d = stage(binary_descriptors(v))
    m = mt.hamming_matches(d, mt.adjacent_images(d), 2, BOUND)
    return m.withColumn("distance", F.col("distance").cast("bigint"))


@query("sampson_medians", "descriptors", sql=f"""
    WITH m AS ({MATCHES}), f AS (SELECT feature_id, 320 + 200 * CAST(embedding[8] AS DOUBLE) AS u, 240 + 200 * CAST(embedding[9] AS DOUBLE) AS v FROM descriptors),
      n AS (SELECT m.*, (a.u - 320) / 500 AS xa, (a.v - 240) / 500 AS ya, (b.u - 320) / 500 AS xb, (b.v - 240) / 500 AS yb,
              CAST(0.1 AS DOUBLE) * first_image - CAST(0.1 AS DOUBLE) * second_image AS tx,
              CAST(0.02 AS DOUBLE) * (first_image % 3) - CAST(0.02 AS DOUBLE) * (second_image % 3) AS ty FROM m JOIN f a ON a.feature_id = query_id JOIN f b ON b.feature_id = target_id),
      l AS (SELECT *, ty AS la0, -tx AS la1, tx * ya - ty * xa AS la2, -ty AS lb0, tx AS lb1 FROM n),
      e AS (SELECT capture_id, first_image, second_image, sqrt((xb*la0 + yb*la1 + la2) * (xb*la0 + yb*la1 + la2) /
              greatest((la0*la0 + la1*la1 + lb0*lb0 + lb1*lb1) / 250000.0, 1e-20)) AS error FROM l WHERE sqrt(tx*tx + ty*ty) > 1e-5)
    SELECT capture_id, first_image, second_image, {r6('median(error)')} AS median_sampson_px, count(*) AS matches FROM e GROUP BY ALL HAVING count(*) >= 8""")
def sampson_medians(v):
    m = stage(mt.ratio_matches(v.descriptors, mt.adjacent_images(v.descriptors), RATIO))
    feats = v.descriptors.select("capture_id", "image", "feature_id",
                                 (320 + 200 * F.col("embedding")[7].cast("double")).alias("u"),
                                 (240 + 200 * F.col("embedding")[8].cast("double")).alias("v"))
    i = F.col("image")
    cams = v.descriptors.select("capture_id", "image").distinct().select(
        "capture_id", "image", F.lit(500.0).alias("fx"), F.lit(500.0).alias("fy"), F.lit(320.0).alias("cx"), F.lit(240.0).alias("cy"),
        (0.1 * i).alias("ox"), (0.02 * (i % 3)).alias("oy"), F.lit(0.0).alias("oz"),
        *[F.lit(1.0 if a == b else 0.0).alias(f"w{a}{b}") for a in range(3) for b in range(3)])
    return mt.sampson_medians(m, feats, cams).select("capture_id", "first_image", "second_image", *r6c("median_sampson_px"), "matches")
