"""Feature tracks: co-visibility, track geometry, reports and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capstrata.functions import geometry as G
from capstrata.operators.graph import component_sizes, connected_components, k_core
from capstrata.operators.ordered import distribution, sequence_over, with_diameter
from capstrata.policies import TrackPolicy
from capstrata.session import stage


def covisible_pairs(obs: DataFrame) -> DataFrame:
    """Number of points two views share.

    Ranks are made distinct per point first, so one point adds at most one row per pair of
    views that see it, and the count combines before its shuffle. A long track is split by
    AQE's skew join like any hot join key.
    """
    seen = obs.select("capture_id", "point_id", "rank").distinct()
    other = seen.withColumnRenamed("rank", "other")
    return (seen.join(other, ["capture_id", "point_id"]).where("rank < other")
            .groupBy("capture_id", F.col("rank").alias("first_rank"), F.col("other").alias("second_rank"))
            .agg(F.count(F.lit(1)).alias("shared")))


def covisible_partners(pairs: DataFrame, k: int) -> DataFrame:
    """The k partners sharing most points with each view, smaller rank first on ties."""
    both = pairs.select("capture_id", F.col("first_rank").alias("rank"), F.col("second_rank").alias("partner"), "shared").union(
        pairs.select("capture_id", "second_rank", "first_rank", "shared"))
    place = F.row_number().over(Window.partitionBy("capture_id", "rank").orderBy(F.desc("shared"), "partner"))
    return both.withColumn("place", place).where(F.col("place") <= k)


def overlap_violations(views: DataFrame, partners: DataFrame, minimum: int = 2) -> DataFrame:
    """Views with fewer partners than dense matching needs."""
    n = partners.groupBy("capture_id", "rank").agg(F.count("*").alias("partners"))
    return views.select("capture_id", "rank").join(n, ["capture_id", "rank"], "left").fillna(0, ["partners"]).where(
        F.col("partners") < minimum).select("capture_id", "rank", "partners", F.lit("DENSE_OVERLAP_INSUFFICIENT").alias("code"))


def revisit_pairs(views: DataFrame, policy: TrackPolicy = TrackPolicy()) -> DataFrame:
    """Pairs to match: all pairs of a small capture, else a rank window plus near revisits.

    ``views`` has rank, relative_sec, px, py, pz and the rotation w00..w22. Both kinds meet in blocks:
    positions in blocks of the reach, so a view goes to its block and the next, and revisits in square
    columns of twice the distance limit, so a view goes to the four it may touch.
    """
    rot = [f"w{i}{j}" for i in range(3) for j in range(3)]
    keyed = stage(sequence_over(views.select("capture_id", "rank", "relative_sec", "px", "py", "pz", *rot), ["capture_id"], ["rank"],
                                rank="_i", total_sum={"_n": F.lit(1)}))
    small = policy.exhaustive_views
    reach = F.when(F.col("_n") <= small, small).otherwise(policy.temporal_window)
    block = F.floor(F.col("_i") / max(small, policy.temporal_window))
    ahead = keyed.select("capture_id", F.col("rank").alias("first_rank"), F.col("_i").alias("_a"), (F.col("_i") + reach).alias("_to"), F.explode(F.array(block, block + 1)).alias("_b"))
    window = ahead.join(keyed.select("capture_id", "_i", F.col("rank").alias("second_rank"), block.alias("_b")), ["capture_id", "_b"]).where(
        "_i > _a AND _i <= _to").select("capture_id", "first_rank", "second_rank")

    size = policy.revisit_distance_m
    cell = lambda c, off=0.0: F.floor((F.col(c) + off) / (2 * size))
    base = keyed.where(F.col("_n") > small).select(
        "capture_id", "_i", "rank", F.col("relative_sec").cast("double").alias("sec"), "px", "py", "pz", *rot)
    # a margin keeps rounding from losing a pair at the limit
    near_cells = lambda c: F.explode(F.sequence(cell(c, -1.001 * size), cell(c, 1.001 * size)))
    spread = base.withColumn("_x", near_cells("px")).withColumn("_z", near_cells("pz"))
    later = base.select("capture_id", cell("px").alias("_x"), cell("pz").alias("_z"), *[F.col(c).alias(f"b_{c}") for c in ("_i", "rank", "sec", "px", "py", "pz", *rot)])
    met = spread.join(later, ["capture_id", "_x", "_z"]).where(
        (F.col("b__i") > F.col("_i") + policy.temporal_window) & (F.col("b_sec") - F.col("sec") >= policy.revisit_seconds)
        & (F.abs(F.col("b_py") - F.col("py")) < size))
    ra = [[F.col(f"w{i}{j}") for j in range(3)] for i in range(3)]
    rb = [[F.col(f"b_w{i}{j}") for j in range(3)] for i in range(3)]
    distance, angle = G.pose_delta(G.vec("px", "py", "pz"), ra, G.vec("b_px", "b_py", "b_pz"), rb)
    near = met.withColumn("_d", distance).where((F.col("_d") < policy.revisit_distance_m) & (angle < policy.revisit_degrees))
    place = F.row_number().over(Window.partitionBy("capture_id", "_i").orderBy("_d", "b__i"))
    revisits = near.withColumn("_place", place).where(F.col("_place") <= policy.revisit_neighbors).select(
        "capture_id", F.col("rank").alias("first_rank"), F.col("b_rank").alias("second_rank"))
    return window.union(revisits).distinct()


def observation_geometry(points: DataFrame, obs: DataFrame, cameras: DataFrame) -> DataFrame:
    """Residual, depth and unit viewing direction of every track observation."""
    j = obs.join(points.select("capture_id", "point_id", "x", "y", "z"), ["capture_id", "point_id"]).join(
        cameras, ["capture_id", "rank"])
    px, py, depth = G.project_pixel(G.vec("x", "y", "z"))
    ray = G.minus(G.vec("x", "y", "z"), G.vec("ox", "oy", "oz"))
    size = F.when(G.norm(ray) > 1e-15, G.norm(ray))
    return j.select("capture_id", "point_id", "rank", depth.alias("depth"),
                    F.sqrt((px - F.col("px")) * (px - F.col("px")) + (py - F.col("py")) * (py - F.col("py"))).alias("residual"),
                    *[F.coalesce(c / size, F.lit(0.0)).alias(n) for c, n in zip(ray, ("dx", "dy", "dz"))])


def track_metrics(geometry: DataFrame, policy: TrackPolicy = TrackPolicy()) -> DataFrame:
    """Acceptance of each track with its reasons; nothing is dropped.

    A track is gathered once, with the distinct tips of its directions: tracks are many and short, and where
    ``geometry`` comes dealt by track they are summed up without another shuffle.
    """
    k = ["capture_id", "point_id"]
    bad = F.col("residual").isNull() | F.isnan("residual") | (F.col("residual") > policy.max_reprojection_pixels)
    tip = ["dx", "dy", "dz"]
    agg = geometry.groupBy(*k).agg(
        F.count("*").alias("observations"), F.size(F.collect_set("rank")).cast("bigint").alias("views"), F.min("depth").alias("min_depth"),
        F.max("residual").alias("max_residual"), F.max(bad).alias("_bad"), F.collect_set(F.struct(*tip)).alias("_tips"))
    # the widest angle between unit directions is the longest chord between their tips
    m = with_diameter(agg.where("capture_id IS NOT NULL AND point_id IS NOT NULL"), "_tips", tip, "_chord").withColumn(
        "max_angle_degrees", F.degrees(2 * F.asin(F.least(F.col("_chord") / 2, F.lit(1.0)))))
    flag = lambda c, n: F.when(c, F.lit(n))
    reasons = F.array_compact(F.array(
        flag(F.col("views") != F.col("observations"), "DUPLICATE_IMAGE_IN_TRACK"),
        flag(F.col("observations") < policy.min_track_length, "SHORT_TRACK"),
        flag(F.col("min_depth") <= 0, "NONPOSITIVE_DEPTH"),
        flag(F.col("_bad"), "REPROJECTION"),
        flag(F.col("max_angle_degrees") < policy.min_angle_degrees, "LOW_PARALLAX")))
    return m.select(*k, "observations", "min_depth", "max_residual", "max_angle_degrees", reasons.alias("reasons"),
                    (F.size(reasons) == 0).alias("accepted"))


def rejection_reasons(metrics: DataFrame) -> DataFrame:
    return metrics.select("capture_id", F.explode("reasons").alias("reason")).groupBy("capture_id", "reason").agg(
        F.count("*").alias("points"))


def _tracks(obs: DataFrame) -> DataFrame:
    """Each view of each track once, dealt by track, so that windows over a track need no second shuffle."""
    seen = obs.select("capture_id", "point_id", "rank").where("capture_id IS NOT NULL AND point_id IS NOT NULL AND rank IS NOT NULL")
    return seen.repartition("capture_id", "point_id").distinct()


def view_edges(obs: DataFrame) -> DataFrame:
    """Enough edges to join the views of each track: every view to the track's first view."""
    first = F.min("rank").over(Window.partitionBy("capture_id", "point_id"))
    return _tracks(obs).withColumn("anchor", first).where("rank <> anchor").select("capture_id", "anchor", "rank").distinct()


def view_components(views: DataFrame, obs: DataFrame) -> DataFrame:
    return connected_components(views, view_edges(obs), ["capture_id"], "rank", "anchor", "rank")


def two_core_views(obs: DataFrame) -> DataFrame:
    """Views that keep two co-visible partners after pruning.

    The views of a track of three or more always keep each other, so they stay without forming its pairs;
    only the links of tracks of two views are peeled against them.
    """
    track = Window.partitionBy("capture_id", "point_id")
    n, low, high = F.count(F.lit(1)).over(track), F.min("rank").over(track), F.max("rank").over(track)
    links = _tracks(obs).select("capture_id", "rank", n.alias("_n"), low.alias("_low"), high.alias("_high")).where("_n > 1").select(
        "capture_id", "rank", F.when(F.col("_n") == 2, F.when(F.col("rank") == F.col("_low"), F.col("_high")).otherwise(F.col("_low"))).alias("partner"))
    links = stage(links.distinct())
    stays = links.where("partner IS NULL").select("capture_id", F.col("rank").alias("vertex"))
    pairs = links.where("rank < partner").select("capture_id", F.col("rank").alias("first_rank"), F.col("partner").alias("second_rank"))
    return k_core(pairs, ["capture_id"], "first_rank", "second_rank", 2, stays).withColumnRenamed("vertex", "rank")


def core_violations(views: DataFrame, core: DataFrame, minimum: int = 3) -> DataFrame:
    n = core.groupBy("capture_id").agg(F.count("*").alias("kept"))
    return views.select("capture_id").distinct().join(n, "capture_id", "left").fillna(0, ["kept"]).where(
        F.col("kept") < minimum).select("capture_id", "kept", F.lit("DENSE_OVERLAP_INSUFFICIENT").alias("code"))


def track_report(cameras: DataFrame, geometry: DataFrame, metrics: DataFrame) -> DataFrame:
    """Counts, distributions, component support and the geometry signal of each capture."""
    k = "capture_id"
    kept = geometry.join(metrics.where("accepted").select(k, "point_id"), [k, "point_id"], "left_semi")
    views = cameras.select(k, "rank").distinct()
    sizes = component_sizes(view_components(views, kept), [k]).groupBy(k).agg(
        F.max("size").alias("largest_component"), F.count("*").alias("components"))
    totals = metrics.groupBy(k).agg(F.count("*").alias("candidate_points"), F.count_if("accepted").alias("accepted_points"))
    out = views.groupBy(k).agg(F.count("*").alias("input_views"))
    out = out.join(totals, k, "left").join(sizes, k, "left")
    out = out.join(kept.groupBy(k).agg(F.count_distinct("rank").alias("supported_images")), k, "left")
    good = metrics.where("accepted")
    for df, col, name in ((kept, "residual", "residual"), (good, "observations", "length"),
                          (good, "max_angle_degrees", "angle"), (kept, "depth", "depth")):
        out = out.join(distribution(df, [k], col, name), k, "left")
    out = out.fillna(0, ["candidate_points", "accepted_points", "supported_images"])
    largest = F.when(F.col("accepted_points") > 0, F.col("largest_component")).otherwise(0)
    strong = ((F.col("supported_images") / F.col("input_views") >= 0.7) & (largest / F.col("input_views") >= 0.7)
              & (F.col("residual_median") <= 2) & (F.col("residual_p90") <= 4))
    return out.withColumn("largest_component", largest).withColumn(
        "rejected_points", F.col("candidate_points") - F.col("accepted_points")).withColumn(
        "geometry_signal", F.when(F.coalesce(strong, F.lit(False)), "SUPPORTED").otherwise("WEAK"))


def feature_lineage(obs: DataFrame, keypoints: DataFrame) -> DataFrame:
    """Observations without their keypoint, moved from it, or sharing it with another."""
    k = ["capture_id", "rank", "keypoint_index"]
    use = obs.groupBy(*k).agg(F.count("*").alias("uses"))
    j = obs.join(keypoints, k, "left").join(use, k)
    moved = (F.abs(F.col("px") - F.col("kx")) > 1e-6) | (F.abs(F.col("py") - F.col("ky")) > 1e-6)
    codes = F.array_compact(F.array(
        F.when(F.col("kx").isNull(), F.lit("KEYPOINT_MISSING")), F.when(moved, F.lit("KEYPOINT_MOVED")),
        F.when(F.col("uses") > 1, F.lit("KEYPOINT_ASSIGNED_TWICE"))))
    return j.select("capture_id", F.explode(codes).alias("code")).groupBy("capture_id", "code").agg(F.count("*").alias("observations"))


def partition_difference(candidates: DataFrame, accepted: DataFrame, expected: DataFrame) -> DataFrame:
    """Stored accepted ids against the recomputed ones; both sides must come out empty."""
    extra = accepted.exceptAll(expected).withColumn("side", F.lit("STORED_ONLY"))
    missing = expected.exceptAll(accepted).withColumn("side", F.lit("RECOMPUTED_ONLY"))
    unknown = accepted.exceptAll(candidates).withColumn("side", F.lit("NOT_A_CANDIDATE"))
    return extra.unionByName(missing).unionByName(unknown)


def camera_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cameras that a backend added, lost or moved by more than 1e-10."""
    k = ["capture_id", "rank"]
    values = [c for c in before.columns if c not in k]
    b = before.select(*k, *[F.col(c).alias(f"_b_{c}") for c in values], F.lit(True).alias("_in_b"))
    a = after.select(*k, *[F.col(c).alias(f"_a_{c}") for c in values], F.lit(True).alias("_in_a"))
    moved = F.lit(False)
    for c in values:
        moved = moved | ~F.coalesce(F.abs(F.col(f"_b_{c}") - F.col(f"_a_{c}")) <= 1e-10, F.lit(False))
    j = b.join(a, k, "full_outer")
    status = F.when(F.col("_in_a").isNull(), "LOST").when(F.col("_in_b").isNull(), "ADDED").when(moved, "MOVED")
    return j.select(*k, status.alias("change"), F.lit("RECONSTRUCTION_CAMERAS_CHANGED").alias("code")).where("change IS NOT NULL")


def selection_violations(selected: DataFrame, prepared: DataFrame, policy: TrackPolicy = TrackPolicy()) -> DataFrame:
    """Requested view lists must hold 3..max unique ranks, all of them prepared."""
    k = "capture_id"
    n = selected.groupBy(k).agg(F.count("*").alias("n"), F.count_distinct("rank").alias("u"))
    size = n.where((F.col("n") != F.col("u")) | ~F.col("u").between(3, policy.max_views)).select(k)
    unknown = selected.join(prepared.select(k, "rank"), [k, "rank"], "left_anti").select(k).distinct()
    return size.union(unknown).distinct().withColumn("code", F.lit("RECONSTRUCTION_SELECTION_INVALID"))
