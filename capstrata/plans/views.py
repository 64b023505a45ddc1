"""Capture-shaped views over the given tables, as DataFrames and as the same SQL.

The tables hold no captures, so each view maps columns onto the capture model. Every view
reads its whole table; the number of captures, or the rows per capture, grows with it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capstrata.functions import geometry as G
from capstrata.operators.ordered import sequence_over
from capstrata.session import stage


def _micros(ts: str):
    return F.expr(f"unix_micros(cast({ts} as timestamp))")


def _seconds(ts: str):
    return F.expr(f"cast(unix_micros(cast({ts} as timestamp)) * 0.000001BD as decimal(20,6))")


SQL_SECONDS = "CAST(epoch_us({0}) * 0.000001 AS DECIMAL(20,6))"


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # --- time series ------------------------------------------------------

    @cached_property
    def _events(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("capture_id"), "event_id", "event_type", "value",
            _seconds("ts").alias("sensor_sec"),
            F.get_json_object("props", "$.k").cast("bigint").alias("k"))

    @cached_property
    def sensor_samples(self) -> DataFrame:
        e = self._events.select(
            "capture_id", F.col("event_type").alias("stream"), "event_id", "sensor_sec",
            F.col("value").alias("x"), F.col("k").cast("double").alias("y"),
            (F.col("event_id") % 7).cast("double").alias("z"))
        return sequence_over(e, ["capture_id", "stream"], ["sensor_sec", "event_id"],
                             rank="source_row").drop("event_id")

    @cached_property
    def frames(self) -> DataFrame:
        seq = sequence_over(
            self._events, ["capture_id"], ["sensor_sec", "event_id"],
            rank="rank", running_sum={"slot": 1 + F.col("k") % 3},
            total_min={"origin_sec": F.col("sensor_sec")})
        return stage(seq.select(
            "capture_id", "rank", "slot", "sensor_sec",
            (F.col("sensor_sec") - F.col("origin_sec")).cast("decimal(20,6)").alias("relative_sec"),
            F.when(F.col("event_type") == "error", "not_available")
            .when(F.col("event_type") == "purchase", "limited").otherwise("normal").alias("tracking_state"),
            (F.col("value") / 1000).alias("exposure_sec"), "k", "event_id"))

    def _posed(self, *wide) -> DataFrame:
        n = self.table("embeddings").count()
        emb = self.table("embeddings").select(
            F.col("vec_id").alias("pose_no"),
            *[F.col("embedding")[i].cast("double").alias(c)
              for i, c in enumerate(("px", "py", "pz", "qw", "qx", "qy", "qz"))], *wide)
        joined = self.frames.withColumn("pose_no", F.col("event_id") % n).join(emb, "pose_no")
        q = G.vec("qw", "qx", "qy", "qz")
        size = F.sqrt(G.dot(q, q))
        unit = joined.select(
            *self.frames.columns, *emb.columns[8:], "px", "py", "pz",
            *[(F.col(c) / size).alias(c) for c in ("qw", "qx", "qy", "qz")])
        rot, _, _ = G.quaternion_to_pose(G.vec("qw", "qx", "qy", "qz"), 1e-4)
        return stage(unit.select("*", *[rot[i][j].alias(f"w{i}{j}") for i in range(3) for j in range(3)]))

    @cached_property
    def poses(self) -> DataFrame:
        """Frames with a world-from-camera pose."""
        return self._posed()

    @cached_property
    def frame_poses(self) -> DataFrame:
        """Poses with the histogram of their image, which is wider than all else; only its own query reads it."""
        return self._posed(F.transform("embedding", lambda v: v.cast("double")).alias("histogram"))

    @cached_property
    def order_stream(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").alias("capture_id"), F.lit("orders").alias("stream"),
            F.col("o_orderkey").alias("source_row"), _seconds("o_orderdate").alias("sensor_sec"))

    @cached_property
    def media_constant(self) -> DataFrame:
        return self.frames.select(
            "capture_id", F.col("rank").alias("decoded_rank"),
            ((F.col("relative_sec") * 1000000).cast("bigint") + F.col("event_id") % 3 - 1).alias("ticks"))

    @cached_property
    def media_affine(self) -> DataFrame:
        rel = (F.col("relative_sec") * 1000000).cast("bigint")
        return self.frames.where(F.col("rank") >= 1).select(
            "capture_id", (F.col("rank") - 1).alias("decoded_rank"),
            (rel + F.floor(rel / 2000) + F.col("event_id") % 5).alias("ticks"))

    @cached_property
    def annotations(self) -> DataFrame:
        start = (F.col("o_orderkey") % 500) * 3600
        return self.table("orders").select(
            F.floor(F.col("o_custkey") / 10).alias("capture_id"), F.col("o_orderkey").alias("object_id"),
            start.cast("double").alias("start_sec"),
            (start + 86400 * (1 + F.col("o_orderkey") % 3)).cast("double").alias("end_sec"))

    @cached_property
    def stage_history(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("seq"),
            F.col("o_orderpriority").alias("stage"), _seconds("o_orderdate").alias("started_sec"))

    # --- clouds -----------------------------------------------------------

    @cached_property
    def cloud(self) -> DataFrame:
        return self.table("lineitem").select(
            (F.col("l_suppkey") % 4).alias("capture_id"), F.col("l_suppkey").alias("rank"),
            (F.col("l_quantity") / 10).alias("x"), (F.col("l_discount") * 25).alias("y"),
            (F.col("l_extendedprice") / 20000).alias("z"),
            (F.col("l_linenumber") * 30).cast("bigint").alias("r"),
            (F.col("l_partkey") % 256).alias("g"), (F.col("l_orderkey") % 256).alias("b"))

    @cached_property
    def stations(self) -> DataFrame:
        """Camera centres of the cloud, one per rank."""
        k = F.floor(F.col("s_suppkey") / 4)
        return self.table("supplier").select(
            (F.col("s_suppkey") % 4).alias("capture_id"), F.col("s_suppkey").alias("rank"),
            (2.5 + 0.3 * (k % 7 - 3)).alias("ox"), (1.4 + 0.05 * (F.col("s_suppkey") % 3)).alias("oy"),
            (2.5 + 0.25 * (k % 5 - 2)).alias("oz"))

    @cached_property
    def planes(self) -> DataFrame:
        p = F.floor(F.col("s_suppkey") / 4) % 5
        grouped = self.table("supplier").groupBy(
            (F.col("s_suppkey") % 4).alias("capture_id"), p.alias("plane_index")).agg(
            (F.min("s_acctbal") / 100000).alias("shift"))
        p = F.col("plane_index")
        pick = lambda *v: F.element_at(F.array(*[F.lit(float(x)) for x in v]), (p + 1).cast("int"))
        return grouped.select(
            "capture_id", "plane_index", pick(0, 1, 0, 0.6, 0.6).alias("a"), pick(1, 0, 0, 0, 0.8).alias("b"),
            pick(0, 0, 1, 0.8, 0).alias("c"), (-(pick(0.25, 2.0, 3.0, 4.0, 3.5) + F.col("shift"))).alias("d"))

    # --- tracks -----------------------------------------------------------

    @cached_property
    def track_cameras(self) -> DataFrame:
        rank = F.col("rank")
        return self.table("part").groupBy(
            (F.col("p_partkey") % 3).alias("capture_id"), (F.col("p_partkey") % 40).alias("rank")).agg(
            F.min("p_partkey").alias("_first")).select(
            "capture_id", "rank",
            F.lit(500.0).alias("fx"), F.lit(500.0).alias("fy"), F.lit(320.0).alias("cx"), F.lit(240.0).alias("cy"),
            *[F.lit(1.0 if i == j else 0.0).alias(f"r{i}{j}") for i in range(3) for j in range(3)],
            (-(0.1 * (rank % 10))).alias("tx"), (-(0.05 * (rank % 4))).alias("ty"), (-(0.02 * (rank % 7))).alias("tz"),
            (0.1 * (rank % 10)).alias("ox"), (0.05 * (rank % 4)).alias("oy"), (0.02 * (rank % 7)).alias("oz"))

    @cached_property
    def track_points(self) -> DataFrame:
        return self.table("lineitem").groupBy((F.col("l_orderkey") % 3).alias("capture_id"), F.col("l_orderkey").alias("point_id")).agg(
            F.max("l_quantity").alias("q"), F.max("l_discount").alias("e"), F.max("l_extendedprice").alias("p")).select(
            "capture_id", "point_id",
            (F.col("q") / 25 - 1).alias("x"), (F.col("e") * 10 - 0.5).alias("y"), (F.col("p") / 50000 + 0.05).alias("z"))

    @cached_property
    def track_obs(self) -> DataFrame:
        seen = self.table("lineitem").select(
            (F.col("l_orderkey") % 3).alias("capture_id"), F.col("l_orderkey").alias("point_id"),
            (F.col("l_partkey") % 40).alias("rank"), F.col("l_linenumber").cast("bigint").alias("keypoint_index"),
            (F.col("l_tax") * 100 - 4).alias("nx"), ((F.col("l_linenumber") - 4) * 0.5).alias("ny"))
        joined = seen.join(self.track_points, ["capture_id", "point_id"]).join(
            self.track_cameras, ["capture_id", "rank"])
        px, py, _ = G.project_pixel(G.vec("x", "y", "z"))
        return joined.select("capture_id", "point_id", "rank", "keypoint_index",
                             (px + F.col("nx")).alias("px"), (py + F.col("ny")).alias("py"))

    @cached_property
    def sparse_tracks(self) -> DataFrame:
        """Many small captures, so that view graphs have several components."""
        return self.table("lineitem").select(
            F.floor(F.col("l_orderkey") / 20).alias("capture_id"), F.col("l_orderkey").alias("point_id"),
            (F.col("l_partkey") % 100).alias("rank"))

    # --- depth ------------------------------------------------------------

    @cached_property
    def depth_pixels(self) -> DataFrame:
        return self.table("lineitem").groupBy(
            F.floor(F.col("l_orderkey") / 5000).alias("capture_id"), F.col("l_linenumber").cast("bigint").alias("image"),
            (F.col("l_suppkey") % 30).alias("y"), (F.col("l_partkey") % 40).alias("x")).agg(
            (F.min("l_tax") * 0.5 + 2.0).alias("z"))

    @cached_property
    def depth_cameras(self) -> DataFrame:
        i = F.col("image")
        return self.table("lineitem").select(
            F.floor(F.col("l_orderkey") / 5000).alias("capture_id"),
            F.col("l_linenumber").cast("bigint").alias("image")).distinct().select(
            "capture_id", "image", F.lit(50.0).alias("fx"), F.lit(50.0).alias("fy"), F.lit(20.0).alias("cx"),
            F.lit(15.0).alias("cy"), F.lit(40).cast("bigint").alias("width"), F.lit(30).cast("bigint").alias("height"),
            *[F.lit(1.0 if a == b else 0.0).alias(f"r{a}{b}") for a in range(3) for b in range(3)],
            (-(0.1 * i)).alias("tx"), (-(0.02 * (i % 3))).alias("ty"), F.lit(0.0).alias("tz"),
            (0.1 * i).alias("ox"), (0.02 * (i % 3)).alias("oy"), F.lit(0.0).alias("oz"))

    @cached_property
    def depth_schedule(self) -> DataFrame:
        c = self.depth_cameras.select("capture_id", "image")
        near = c.select("capture_id", "image", F.explode(F.array(*[F.lit(o) for o in (-2, -1, 1, 2)])).alias("o"))
        near = near.select("capture_id", "image", (F.col("image") + F.col("o")).alias("partner"))
        return near.join(c.select("capture_id", F.col("image").alias("partner")), ["capture_id", "partner"], "left_semi"
                         ).select("capture_id", "image", "partner")

    # --- descriptors, assets, jobs -----------------------------------------

    @cached_property
    def descriptors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.floor(F.col("vec_id") / 5000).alias("capture_id"), F.col("label").cast("bigint").alias("image"),
            F.col("vec_id").alias("feature_id"), "embedding")

    @cached_property
    def assets(self) -> DataFrame:
        docs = self.table("documents").select(
            F.concat(F.lit("doc-"), F.col("doc_id")).alias("asset_id"), F.col("source").alias("capture_id"),
            F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/IMG_"), F.col("doc_id"), F.lit(".jpg")).alias("path"),
            F.col("lang").alias("room_id"), F.col("text").alias("content"))
        pages = self.table("pages").select(
            F.concat(F.lit("page-"), F.col("page_id")).alias("asset_id"),
            F.concat(F.lit("web"), F.col("page_id") % 5).alias("capture_id"), F.col("url").alias("path"),
            F.lit("web").alias("room_id"), F.col("html").alias("content"))
        return docs.union(pages).select(
            "asset_id", "capture_id", "path", "room_id", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"),
            F.octet_length("content").cast("bigint").alias("bytes"))

    @cached_property
    def jobs(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("owner_id"),
            F.when(F.col("o_orderstatus") == "O", "QUEUED").when(F.col("o_orderstatus") == "P", "RECONSTRUCTING")
            .otherwise("SUCCEEDED").alias("state"),
            _seconds("o_orderdate").alias("created_sec"), F.col("o_orderpriority").alias("modality"))


_K = "CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT)"
_ROT1 = ", ".join(f"CAST({1 if i == j else 0} AS DOUBLE) AS r{i}{j}" for i in range(3) for j in range(3))

# name -> (views it needs, SQL)
SQL_VIEWS: dict[str, tuple[list[str], str]] = {
    "ev": ([], f"""SELECT user_id AS capture_id, event_id, event_type, value,
        {SQL_SECONDS.format('ts')} AS sensor_sec, {_K} AS k FROM events"""),
    "sensor_samples": (["ev"], """SELECT capture_id, event_type AS stream, sensor_sec, value AS x,
        CAST(k AS DOUBLE) AS y, CAST(event_id % 7 AS DOUBLE) AS z,
        row_number() OVER (PARTITION BY capture_id, event_type ORDER BY sensor_sec, event_id) - 1 AS source_row
        FROM ev"""),
    "frames": (["ev"], """SELECT capture_id,
        row_number() OVER (PARTITION BY capture_id ORDER BY sensor_sec, event_id) - 1 AS rank,
        CAST(sum(1 + k % 3) OVER (PARTITION BY capture_id ORDER BY sensor_sec, event_id) AS BIGINT) AS slot,
        sensor_sec, sensor_sec - min(sensor_sec) OVER (PARTITION BY capture_id) AS relative_sec,
        CASE event_type WHEN 'error' THEN 'not_available' WHEN 'purchase' THEN 'limited' ELSE 'normal' END AS tracking_state,
        value / 1000 AS exposure_sec, k, event_id FROM ev"""),
    "frame_poses": (["frames"], """SELECT f.*, px, py, pz, histogram, qw, qx, qy, qz,
        1 - 2*(qy*qy + qz*qz) AS w00, 2*(qx*qy - qz*qw) AS w01, 2*(qx*qz + qy*qw) AS w02,
        2*(qx*qy + qz*qw) AS w10, 1 - 2*(qx*qx + qz*qz) AS w11, 2*(qy*qz - qx*qw) AS w12,
        2*(qx*qz - qy*qw) AS w20, 2*(qy*qz + qx*qw) AS w21, 1 - 2*(qx*qx + qy*qy) AS w22
        FROM frames f JOIN (SELECT vec_id, px, py, pz, histogram, w/n AS qw, x/n AS qx, y/n AS qy, z/n AS qz FROM
          (SELECT vec_id, e[1] AS px, e[2] AS py, e[3] AS pz, e AS histogram, e[4] AS w, e[5] AS x, e[6] AS y, e[7] AS z,
             sqrt(e[4]*e[4] + e[5]*e[5] + e[6]*e[6] + e[7]*e[7]) AS n
           FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))) p
        ON f.event_id % (SELECT count(*) FROM embeddings) = p.vec_id"""),
    "order_stream": ([], f"""SELECT o_custkey AS capture_id, 'orders' AS stream, o_orderkey AS source_row,
        {SQL_SECONDS.format('o_orderdate')} AS sensor_sec FROM orders"""),
    "media_constant": (["frames"], """SELECT capture_id, rank AS decoded_rank,
        CAST(relative_sec * 1000000 AS BIGINT) + event_id % 3 - 1 AS ticks FROM frames"""),
    "media_affine": (["frames"], """SELECT capture_id, rank - 1 AS decoded_rank,
        CAST(relative_sec * 1000000 AS BIGINT) + CAST(relative_sec * 1000000 AS BIGINT) // 2000 + event_id % 5 AS ticks
        FROM frames WHERE rank >= 1"""),
    "annotations": ([], """SELECT o_custkey // 10 AS capture_id, o_orderkey AS object_id,
        CAST((o_orderkey % 500) * 3600 AS DOUBLE) AS start_sec,
        CAST((o_orderkey % 500) * 3600 + 86400 * (1 + o_orderkey % 3) AS DOUBLE) AS end_sec FROM orders"""),
    "stage_history": ([], f"""SELECT o_custkey AS job_id, o_orderkey AS seq, o_orderpriority AS stage,
        {SQL_SECONDS.format('o_orderdate')} AS started_sec FROM orders"""),
    "cloud": ([], """SELECT l_suppkey % 4 AS capture_id, l_suppkey AS rank, l_quantity / 10 AS x,
        l_discount * 25 AS y, l_extendedprice / 20000 AS z, CAST(l_linenumber * 30 AS BIGINT) AS r,
        l_partkey % 256 AS g, l_orderkey % 256 AS b FROM lineitem"""),
    "stations": ([], """SELECT s_suppkey % 4 AS capture_id, s_suppkey AS rank,
        CAST(2.5 AS DOUBLE) + CAST(0.3 AS DOUBLE) * ((s_suppkey // 4) % 7 - 3) AS ox,
        CAST(1.4 AS DOUBLE) + CAST(0.05 AS DOUBLE) * (s_suppkey % 3) AS oy,
        CAST(2.5 AS DOUBLE) + CAST(0.25 AS DOUBLE) * ((s_suppkey // 4) % 5 - 2) AS oz FROM supplier"""),
    "planes": ([], """SELECT capture_id, plane_index,
        CAST([0, 1, 0, 0.6, 0.6][plane_index + 1] AS DOUBLE) AS a, CAST([1, 0, 0, 0, 0.8][plane_index + 1] AS DOUBLE) AS b,
        CAST([0, 0, 1, 0.8, 0][plane_index + 1] AS DOUBLE) AS c,
        -(CAST([0.25, 2.0, 3.0, 4.0, 3.5][plane_index + 1] AS DOUBLE) + shift) AS d FROM
        (SELECT s_suppkey % 4 AS capture_id, (s_suppkey // 4) % 5 AS plane_index, min(s_acctbal) / 100000 AS shift
         FROM supplier GROUP BY ALL)"""),
    "track_cameras": ([], f"""SELECT capture_id, rank, CAST(500 AS DOUBLE) AS fx, CAST(500 AS DOUBLE) AS fy,
        CAST(320 AS DOUBLE) AS cx, CAST(240 AS DOUBLE) AS cy, {_ROT1},
        -ox AS tx, -oy AS ty, -oz AS tz, ox, oy, oz FROM
        (SELECT capture_id, rank, CAST(0.1 AS DOUBLE) * (rank % 10) AS ox, CAST(0.05 AS DOUBLE) * (rank % 4) AS oy,
           CAST(0.02 AS DOUBLE) * (rank % 7) AS oz FROM
         (SELECT DISTINCT p_partkey % 3 AS capture_id, p_partkey % 40 AS rank FROM part))"""),
    "track_points": ([], """SELECT l_orderkey % 3 AS capture_id, l_orderkey AS point_id,
        max(l_quantity) / 25 - 1 AS x, max(l_discount) * 10 - CAST(0.5 AS DOUBLE) AS y,
        max(l_extendedprice) / 50000 + CAST(0.05 AS DOUBLE) AS z FROM lineitem GROUP BY l_orderkey"""),
    "track_obs": (["track_points", "track_cameras"], """SELECT s.capture_id, s.point_id, s.rank, s.keypoint_index,
        fx * (x + tx) / (z + tz) + cx + nx AS px, fy * (y + ty) / (z + tz) + cy + ny AS py FROM
        (SELECT l_orderkey % 3 AS capture_id, l_orderkey AS point_id, l_partkey % 40 AS rank,
           CAST(l_linenumber AS BIGINT) AS keypoint_index, l_tax * 100 - 4 AS nx,
           (l_linenumber - 4) * CAST(0.5 AS DOUBLE) AS ny FROM lineitem) s
        JOIN track_points p ON p.capture_id = s.capture_id AND p.point_id = s.point_id
        JOIN track_cameras c ON c.capture_id = s.capture_id AND c.rank = s.rank"""),
    "sparse_tracks": ([], """SELECT l_orderkey // 20 AS capture_id, l_orderkey AS point_id,
        l_partkey % 100 AS rank FROM lineitem"""),
    "depth_pixels": ([], """SELECT l_orderkey // 5000 AS capture_id, CAST(l_linenumber AS BIGINT) AS image,
        l_suppkey % 30 AS y, l_partkey % 40 AS x, min(l_tax) * CAST(0.5 AS DOUBLE) + 2 AS z
        FROM lineitem GROUP BY ALL"""),
    "depth_cameras": ([], f"""SELECT capture_id, image, CAST(50 AS DOUBLE) AS fx, CAST(50 AS DOUBLE) AS fy,
        CAST(20 AS DOUBLE) AS cx, CAST(15 AS DOUBLE) AS cy, CAST(40 AS BIGINT) AS width, CAST(30 AS BIGINT) AS height,
        {_ROT1}, -ox AS tx, -oy AS ty, CAST(0 AS DOUBLE) AS tz, ox, oy, CAST(0 AS DOUBLE) AS oz FROM
        (SELECT capture_id, image, CAST(0.1 AS DOUBLE) * image AS ox, CAST(0.02 AS DOUBLE) * (image % 3) AS oy FROM
          (SELECT DISTINCT l_orderkey // 5000 AS capture_id, CAST(l_linenumber AS BIGINT) AS image FROM lineitem))"""),
    "depth_schedule": (["depth_cameras"], """SELECT a.capture_id, a.image, b.image AS partner
        FROM depth_cameras a JOIN depth_cameras b ON a.capture_id = b.capture_id
        AND b.image <> a.image AND abs(b.image - a.image) <= 2"""),
    "descriptors": ([], """SELECT vec_id // 5000 AS capture_id, CAST(label AS BIGINT) AS image,
        vec_id AS feature_id, embedding FROM embeddings"""),
    "assets": ([], """SELECT asset_id, capture_id, path, room_id, sha256(content) AS sha256,
        CAST(octet_length(encode(content)) AS BIGINT) AS bytes FROM
        (SELECT 'doc-' || doc_id AS asset_id, source AS capture_id, source || '/' || lang || '/IMG_' || doc_id || '.jpg' AS path,
           lang AS room_id, text AS content FROM documents
         UNION ALL
         SELECT 'page-' || page_id, 'web' || (page_id % 5), url, 'web', html FROM pages)"""),
    "jobs": ([], f"""SELECT o_orderkey AS job_id, o_custkey AS owner_id,
        CASE o_orderstatus WHEN 'O' THEN 'QUEUED' WHEN 'P' THEN 'RECONSTRUCTING' ELSE 'SUCCEEDED' END AS state,
        {SQL_SECONDS.format('o_orderdate')} AS created_sec, o_orderpriority AS modality FROM orders"""),
}
