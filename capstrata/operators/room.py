"""Room-level statistics: persistent cells, ceilings, rectangles, entries, rasters, objects.

Points carry floor coordinates u, v and the height h; a room carries its axes
(ax, ay) / (bx, by) and the bounds lo0, lo1, hi0, hi1 along them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capstrata.functions import geometry as G
from capstrata.operators.graph import cell_components, grid_neighbors
from capstrata.operators.ordered import quantiles, runs_of, sequence_over
from capstrata.policies import CeilingPolicy, PlanPolicy, RoomPolicy
from capstrata.session import stage


def persistent_cells(points: DataFrame, policy: PlanPolicy = PlanPolicy()) -> DataFrame:
    """Columns of the plan occupied over enough height, with neighbours and a large component."""
    k = ["capture_id", "cx", "cy"]
    p = points.where(F.col("h").between(policy.height_min_m, policy.height_max_m)).select(
        "capture_id", F.floor(F.col("u") / policy.cell_m).alias("cx"), F.floor(F.col("v") / policy.cell_m).alias("cy"),
        F.floor((F.col("h") - policy.height_min_m) / policy.height_band_m).alias("band"), "h")
    bands = p.groupBy(*k, "band").agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high")).where(
        F.col("n") >= policy.min_band_points)
    cells = bands.groupBy(*k).agg(F.count("*").alias("bands"), F.min("low").alias("height_min_m"),
                                  F.max("high").alias("height_max_m"), F.sum("n").alias("voxel_points"))
    tall = stage(cells.where((F.col("bands") >= policy.min_bands)
                             & (F.col("height_max_m") - F.col("height_min_m") >= policy.min_height_span_m)))
    company = grid_neighbors(tall, ["capture_id"], "cx", "cy").groupBy(*k).agg(F.count("*").alias("neighbors"))
    social = stage(tall.join(company.where(F.col("neighbors") >= policy.min_neighbors), k))
    roots = cell_components(social, ["capture_id"])
    r = ["capture_id", "root_x", "root_y"]
    span = F.greatest(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy")) * policy.cell_m
    big = roots.groupBy(*r).agg(F.count("*").alias("_cells"), span.alias("_span")).where(
        (F.col("_cells") >= policy.min_component_cells) & (F.col("_span") >= policy.min_component_span_m))
    kept = roots.join(big.select(*r), r).select(*k)
    return social.join(kept, k)


def persistent_points(points: DataFrame, cells: DataFrame, policy: PlanPolicy = PlanPolicy()) -> DataFrame:
    """Points inside persistent cells whose height band is reliable there."""
    k = ["capture_id", "_cx", "_cy"]
    p = points.where(F.col("h").between(policy.height_min_m, policy.height_max_m)).select(
        "*", F.floor(F.col("u") / policy.cell_m).alias("_cx"), F.floor(F.col("v") / policy.cell_m).alias("_cy"),
        F.floor((F.col("h") - policy.height_min_m) / policy.height_band_m).alias("_band"))
    inside = p.join(cells.select("capture_id", F.col("cx").alias("_cx"), F.col("cy").alias("_cy")), k, "left_semi")
    reliable = inside.groupBy(*k, "_band").agg(F.count("*").alias("_n")).where(F.col("_n") >= policy.min_band_points)
    return inside.join(reliable.select(*k, "_band"), [*k, "_band"], "left_semi").select(*points.columns)


def room_coordinates(points: DataFrame, rooms: DataFrame) -> DataFrame:
    """Coordinates along the room axes and whether the point lies inside the bounds."""
    cols = ["ax", "ay", "bx", "by", "lo0", "lo1", "hi0", "hi1"]
    j = points.join(rooms.select("capture_id", *cols), "capture_id")
    j = j.withColumn("p0", F.col("u") * F.col("ax") + F.col("v") * F.col("ay")).withColumn(
        "p1", F.col("u") * F.col("bx") + F.col("v") * F.col("by"))
    inside = F.col("p0").between(F.col("lo0"), F.col("hi0")) & F.col("p1").between(F.col("lo1"), F.col("hi1"))
    return j.withColumn("inside", inside)


def ceiling_height(points: DataFrame, rooms: DataFrame, policy: CeilingPolicy = CeilingPolicy()) -> DataFrame:
    """Upper envelope: a high quantile over the tops of well-filled cells, or no value at all."""
    k = "capture_id"
    p = room_coordinates(points, rooms).where(
        F.col("inside") & F.col("h").between(policy.upper_height_min_m, policy.upper_height_max_m)).select(
        k, F.floor((F.col("p0") - F.col("lo0")) / policy.cell_m).alias("cx"),
        F.floor((F.col("p1") - F.col("lo1")) / policy.cell_m).alias("cy"), "h")
    tops = stage(quantiles(p, [k, "cx", "cy"], "h", {"top_m": policy.cell_top_quantile}, count="n").where(
        F.col("n") >= policy.min_upper_points_per_cell))
    env = quantiles(tops, [k], "top_m", {"_est": policy.envelope_quantile, "_b0": 0.85, "_b1": 0.95}, count="supported_cells")
    near = tops.join(env, k).groupBy(k).agg(
        F.count_if(F.abs(F.col("top_m") - F.col("_est")) <= policy.near_estimate_m).alias("_near"))
    high = quantiles(p, [k], "h", {"_p999": 0.999}, count="upper_voxels")
    area = rooms.select(k, ((F.col("hi0") - F.col("lo0")) * (F.col("hi1") - F.col("lo1"))).alias("_area"))
    out = area.join(env, k, "left").join(near, k, "left").join(high, k, "left").fillna(0, ["supported_cells", "upper_voxels"])
    ok = F.col("supported_cells") >= policy.min_supported_cells
    show = lambda c: F.when(ok, F.col(c))
    return out.select(
        k, F.when(ok, "PROVISIONAL_UPPER_ENVELOPE").otherwise("INSUFFICIENT_UPPER_COVERAGE").alias("status"),
        "upper_voxels", "supported_cells", show("_est").alias("height_m"), show("_b0").alias("band_low_m"),
        show("_b1").alias("band_high_m"), show("_p999").alias("point_p999_m"), show("_near").alias("near_cells"),
        F.when(ok, F.col("_near") * (policy.cell_m * policy.cell_m) / F.col("_area")).alias("near_area_fraction"))


def sparse_room(points: DataFrame, min_points: int = 100) -> DataFrame:
    """Gravity-aligned envelope of a sparse cloud: lower floor quantile, trimmed PCA axes and bounds."""
    k = "capture_id"
    n = points.groupBy(k).agg(F.count("*").alias("points"))
    floor = quantiles(points, [k], "y", {"floor_y": 0.02})
    # floor coordinates are u = x and v = -z for a world with +Y up
    uv = points.select(k, F.col("x").alias("u"), (-F.col("z")).alias("v"))
    # one row per capture, staged: Spark knows its size and does not sort the points of a capture in one task to meet it
    lim = stage(quantiles(uv, [k], "u", {"u0": 0.02, "u1": 0.98}).join(quantiles(uv, [k], "v", {"v0": 0.02, "v1": 0.98}), k))
    core = uv.join(lim, k).where(F.col("u").between(F.col("u0"), F.col("u1")) & F.col("v").between(F.col("v0"), F.col("v1"))).select(k, "u", "v")
    cov = core.groupBy(k).agg(F.var_samp("u").alias("_a"), F.covar_samp("u", "v").alias("_b"), F.var_samp("v").alias("_c"))
    turn = 0.5 * F.atan2(2 * F.col("_b"), F.col("_a") - F.col("_c"))
    axes = stage(cov.select(k, F.cos(turn).alias("ax"), F.sin(turn).alias("ay"), (-F.sin(turn)).alias("bx"), F.cos(turn).alias("by")))
    local = core.join(axes, k).select(k, (F.col("u") * F.col("ax") + F.col("v") * F.col("ay")).alias("p0"),
                                      (F.col("u") * F.col("bx") + F.col("v") * F.col("by")).alias("p1"))
    b = quantiles(local, [k], "p0", {"lo0": 0.02, "hi0": 0.98}).join(quantiles(local, [k], "p1", {"lo1": 0.02, "hi1": 0.98}), k)
    out = n.join(floor, k).join(axes, k).join(b, k).withColumn("width_m", F.col("hi0") - F.col("lo0")).withColumn(
        "depth_m", F.col("hi1") - F.col("lo1"))
    ok = (F.col("points") >= min_points) & F.col("width_m").between(0.5, 50) & F.col("depth_m").between(0.5, 50)
    return out.withColumn("area_m2", F.col("width_m") * F.col("depth_m")).withColumn(
        "status", F.when(ok, "AUTOMATIC_SPARSE_ENVELOPE").otherwise("RECONSTRUCTION_SUPPORT_INSUFFICIENT"))


def longest_spans(spans: DataFrame, minimum_m: float) -> DataFrame:
    """One vote per plane: its longest interval, the first of equals."""
    length = F.sqrt((F.col("u1") - F.col("u0")) ** 2 + (F.col("v1") - F.col("v0")) ** 2)
    s = spans.withColumn("length_m", length).where(F.col("length_m") >= minimum_m)
    return s.groupBy("capture_id", "plane_index").agg(
        F.max(F.struct("length_m", (-F.col("span_id")).alias("_i"), "u0", "v0", "u1", "v1")).alias("_b")).select(
        "capture_id", "plane_index", *[F.col(f"_b.{c}").alias(c) for c in ("length_m", "u0", "v0", "u1", "v1")])


def room_rectangle(spans: DataFrame, reviewed: DataFrame | None = None, policy: RoomPolicy = RoomPolicy()) -> DataFrame:
    """Rectangle of a room from its plane intervals; captures without support get a code.

    Directions vote modulo 90 degrees. One row per plane remains after the first aggregate,
    and a capture has few planes, so the quantiles here run on short groups.
    """
    k = "capture_id"
    best = stage(longest_spans(spans, policy.minimum_interval_m))
    a = best.withColumn("_t", F.atan2(F.col("v1") - F.col("v0"), F.col("u1") - F.col("u0")))
    seed = a.groupBy(k).agg(F.count("*").alias("planes"), (F.atan2(F.avg(F.sin(4 * F.col("_t"))), F.avg(F.cos(4 * F.col("_t")))) / 4).alias("_seed"))
    half, quarter = math.pi / 2, math.pi / 4
    dev = F.pmod(F.col("_t") - F.col("_seed") + quarter, F.lit(half)) - quarter
    turn = a.join(seed, k).withColumn("_dev", dev)
    turn = turn.groupBy(k).agg(F.first("planes").alias("planes"), (F.first("_seed") + F.percentile("_dev", F.lit(0.5))).alias("angle"))
    t = F.col("angle")
    axes = turn.select(k, "planes", "angle", F.cos(t).alias("ax"), F.sin(t).alias("ay"), (-F.sin(t)).alias("bx"), F.cos(t).alias("by"))
    j = best.join(axes, k)
    du, dv = F.col("u1") - F.col("u0"), F.col("v1") - F.col("v0")
    family = F.when(F.abs(du * F.col("ax") + dv * F.col("ay")) >= F.abs(du * F.col("bx") + dv * F.col("by")), 0).otherwise(1)
    ends = j.withColumn("_family", family).select(
        k, "_family", "ax", "ay", "bx", "by", F.explode(F.array(
            F.struct(F.col("u0").alias("u"), F.col("v0").alias("v")), F.struct(F.col("u1").alias("u"), F.col("v1").alias("v")))).alias("e"))
    p0 = F.col("e.u") * F.col("ax") + F.col("e.v") * F.col("ay")
    p1 = F.col("e.u") * F.col("bx") + F.col("e.v") * F.col("by")
    q = policy.endpoint_trim_quantile
    pct = lambda c, p: F.percentile(c, F.lit(float(p)))
    b = ends.groupBy(k).agg(F.count_distinct("_family").alias("families"), pct(p0, q).alias("lo0"), pct(p0, 1 - q).alias("hi0"),
                            pct(p1, q).alias("lo1"), pct(p1, 1 - q).alias("hi1"))
    out = axes.join(b, k)
    if reviewed is not None:
        # the few reviewed points widen the bounds and are never trimmed
        r = reviewed.join(axes, k).select(k, (F.col("u") * F.col("ax") + F.col("v") * F.col("ay")).alias("r0"),
                                          (F.col("u") * F.col("bx") + F.col("v") * F.col("by")).alias("r1"))
        r = r.groupBy(k).agg(*[f(c).alias(f"_{n}{c}") for c in ("r0", "r1") for n, f in (("lo", F.min), ("hi", F.max))])
        out = out.join(r, k, "left")
        for i in "01":
            out = out.withColumn(f"lo{i}", F.least(f"lo{i}", f"_lor{i}")).withColumn(f"hi{i}", F.greatest(f"hi{i}", f"_hir{i}"))
    out = out.withColumn("width_m", F.col("hi0") - F.col("lo0")).withColumn("depth_m", F.col("hi1") - F.col("lo1"))
    status = (F.when(F.col("planes") < 3, "FEWER_THAN_THREE_PLANES").when(F.col("families") < 2, "ONE_ORIENTATION_FAMILY")
              .when(F.least("width_m", "depth_m") < policy.minimum_extent_m, "COVERAGE_TOO_NARROW")
              .otherwise("INFERRED_ROUGH_COMPLETION"))
    return out.select(k, "planes", "angle", "ax", "ay", "bx", "by", "lo0", "lo1", "hi0", "hi1", "width_m", "depth_m",
                      (F.col("width_m") * F.col("depth_m")).alias("area_m2"), status.alias("status"))


def entry_crossing(path: DataFrame, rooms: DataFrame, policy: RoomPolicy = RoomPolicy()) -> DataFrame:
    """Side and position where a capture path first enters the room.

    ``path`` has seq, p0, p1 in room axes. Without a crossing the start's nearest edge is a
    stated guess.
    """
    k = "capture_id"
    bounds = ["lo0", "lo1", "hi0", "hi1"]
    p = path.join(rooms.select(k, *bounds), k)
    p = p.withColumn("_in", F.col("p0").between(F.col("lo0"), F.col("hi0")) & F.col("p1").between(F.col("lo1"), F.col("hi1")))
    seq = sequence_over(p, [k], ["seq"], lag={"_was": "_in", "_a0": "p0", "_a1": "p1"})
    hits = []
    for i, j in ((0, 1), (1, 0)):
        a, b = F.col(f"_a{i}"), F.col(f"p{i}")
        for side in ("lo", "hi"):
            t = (F.col(f"{side}{i}") - a) / F.when(F.abs(b - a) >= 1e-12, b - a)
            q = {n: F.col(f"_a{n}") + t * (F.col(f"p{n}") - F.col(f"_a{n}")) for n in (0, 1)}
            ok = t.between(0, 1)
            for n in (0, 1):
                ok = ok & (q[n] >= F.col(f"lo{n}") - 1e-9) & (q[n] <= F.col(f"hi{n}") + 1e-9)
            hits.append(F.when(ok, F.struct(t.alias("t"), F.lit(len(hits)).alias("o"), q[0].alias("q0"), q[1].alias("q1"))))
    crossing = seq.where(F.col("_in") & ~F.col("_was")).withColumn("_hit", F.array_min(F.array_compact(F.array(*hits)))).where("_hit IS NOT NULL")
    first = crossing.groupBy(k).agg(F.min_by("_hit", "seq").alias("_hit"))
    start = p.groupBy(k).agg(F.min_by(F.struct("p0", "p1"), "seq").alias("_s"))
    j = start.join(first, k, "left").join(rooms.select(k, *bounds), k)
    q0, q1 = F.coalesce("_hit.q0", "_s.p0"), F.coalesce("_hit.q1", "_s.p1")
    gaps = F.array(F.abs(q1 - F.col("lo1")), F.abs(q0 - F.col("hi0")), F.abs(q1 - F.col("hi1")), F.abs(q0 - F.col("lo0")))
    side = F.array_position(gaps, F.array_min(gaps)).cast("int") - 1
    j = j.select(k, *bounds, q0.alias("_q0"), q1.alias("_q1"), side.alias("side_index"),
                 F.when(F.col("_hit").isNotNull(), "FIRST_CAPTURE_PATH_ENTRY_CROSSING")
                 .otherwise("NEAREST_EDGE_TO_CAPTURE_START").alias("method"))
    along = lambda a, b: F.when(F.col("side_index").isin(0, 2), a).otherwise(b)
    lo, hi, at = along(F.col("lo0"), F.col("lo1")), along(F.col("hi0"), F.col("hi1")), along(F.col("_q0"), F.col("_q1"))
    width = F.least(F.lit(policy.assumed_entry_width_m), (hi - lo) * 0.6)
    center = F.least(F.greatest(at, lo + width / 2 + 0.05), hi - width / 2 - 0.05)
    return j.select(k, "side_index", center.alias("center_m"), width.alias("width_m"), "method")


def plan_raster(points: DataFrame, width: int = 1400, height: int = 1000) -> DataFrame:
    """Occupied plan pixels with their point count and grey level; empty pixels stay absent."""
    k = "capture_id"
    box = points.groupBy(k).agg((F.min("u") - 0.15).alias("u0"), (F.min("v") - 0.15).alias("v0"),
                                (F.max("u") + 0.15).alias("u1"), (F.max("v") + 0.15).alias("v1"))
    eu, ev = F.greatest(F.col("u1") - F.col("u0"), F.lit(0.3)), F.greatest(F.col("v1") - F.col("v0"), F.lit(0.3))
    scale = F.least(F.lit(width - 80) / eu, F.lit(height - 80) / ev)
    box = box.select(k, "u0", "v0", scale.alias("s"), ((width - eu * scale) / 2).alias("pu"), ((height - ev * scale) / 2).alias("pv"))
    p = points.where(F.col("h").between(0.1, 2.2)).join(box, k)
    px = p.groupBy(k, F.floor((F.col("u") - F.col("u0")) * F.col("s") + F.col("pu")).alias("px"),
                   F.floor((F.col("v") - F.col("v0")) * F.col("s") + F.col("pv")).alias("py")).agg(F.count("*").alias("points"))
    grey = F.greatest(F.least(228 - 28 * F.log1p("points"), F.lit(230.0)), F.lit(75.0))
    return px.withColumn("grey", F.floor(grey))


def line_suggestions(points: DataFrame, lines: DataFrame, policy: PlanPolicy = PlanPolicy(), tolerance: float = 1e-9,
                     huber_m: float = 1.345) -> tuple[DataFrame, DataFrame]:
    """Robust lines through persistent wall points, and their supported spans.

    ``points`` has plane_index, u, v, h and a source row per voxel; ``lines`` has the source
    direction su, sv per plane. Each round is one weighted covariance aggregate; only one
    row per plane is kept between rounds. Reweighting goes on until no line's robust cost falls
    by more than ``tolerance`` of itself; the cost never rises, so it ends. Returns (diagnostics, spans).
    """
    k = ["capture_id", "plane_index"]
    pts = stage(points.join(lines.select(*k), k, "left_semi").select(*k, "u", "v", "h"))
    weighted = pts.withColumn("_w", F.lit(1.0))
    fit = cost = None
    while True:
        w, u, v = F.col("_w"), F.col("u"), F.col("v")
        m = weighted.groupBy(*k).agg(
            F.count("*").alias("n"), F.sum(w).alias("sw"), F.sum(w * u).alias("su"), F.sum(w * v).alias("sv"),
            F.sum(w * u * u).alias("suu"), F.sum(w * u * v).alias("suv"), F.sum(w * v * v).alias("svv"))
        cu, cv = F.col("su") / F.col("sw"), F.col("sv") / F.col("sw")
        a = F.col("suu") / F.col("sw") - cu * cu
        b = F.col("suv") / F.col("sw") - cu * cv
        c = F.col("svv") / F.col("sw") - cv * cv
        turn = 0.5 * F.atan2(2 * b, a - c)
        fit = stage(m.select(*k, "n", cu.alias("ou"), cv.alias("ov"), F.cos(turn).alias("fu"), F.sin(turn).alias("fv")))
        off = F.abs((F.col("v") - F.col("ov")) * F.col("fu") - (F.col("u") - F.col("ou")) * F.col("fv"))
        weighted = pts.join(fit.drop("n"), k).withColumn("_r", off).withColumn(
            "_w", F.when(F.col("_r") <= huber_m, 1.0).otherwise(F.lit(huber_m) / F.col("_r"))).drop("ou", "ov", "fu", "fv")
        loss = F.when(F.col("_r") <= huber_m, F.col("_r") * F.col("_r") / 2).otherwise(huber_m * (F.col("_r") - huber_m / 2))
        before, cost = cost, stage(weighted.groupBy(*k).agg(F.sum(loss).alias("cost")))
        weighted = weighted.drop("_r")
        if before is not None and cost.join(before.withColumnRenamed("cost", "before"), k).where(F.col("before") - F.col("cost") > tolerance * F.col("before")).isEmpty():
            break
    f = fit.join(lines, k)
    cosine = F.col("fu") * F.col("su") + F.col("fv") * F.col("sv")
    flip = F.when(cosine < 0, -1.0).otherwise(1.0)
    f = f.select(*k, "n", "ou", "ov", (F.col("fu") * flip).alias("fu"), (F.col("fv") * flip).alias("fv"),
                 F.degrees(F.acos(G.clamp(F.abs(cosine), 0.0, 1.0))).alias("refit_angle_degrees"))
    on = pts.join(f, k).withColumn("_r", F.abs((F.col("v") - F.col("ov")) * F.col("fu") - (F.col("u") - F.col("ou")) * F.col("fv"))
                                   ).withColumn("t", (F.col("u") - F.col("ou")) * F.col("fu") + (F.col("v") - F.col("ov")) * F.col("fv"))
    spread = quantiles(on, k, "_r", {"residual_p90_m": 0.9})
    ok = on.where((F.col("n") >= policy.min_line_points) & (F.col("refit_angle_degrees") <= policy.max_refit_angle_degrees)
                  & (F.col("_r") <= policy.line_distance_m)).withColumn("bin", F.floor(F.col("t") / policy.line_bin_m))
    bins = ok.groupBy(*k, "bin").agg(F.count("*").alias("_n"), (F.max("h") - F.min("h")).alias("_s")).where(
        (F.col("_n") >= policy.min_line_bin_points) & (F.col("_s") >= policy.min_height_span_m))
    span = ok.join(runs_of(bins, k, "bin"), [*k, "bin"]).groupBy(*k, "run").agg(
        F.min("t").alias("start_m"), F.max("t").alias("end_m"), F.count("*").alias("voxel_points"), F.min("h").alias("height_min_m"),
        F.max("h").alias("height_max_m"), F.first("ou").alias("ou"), F.first("ov").alias("ov"), F.first("fu").alias("fu"), F.first("fv").alias("fv"))
    span = span.where(F.col("end_m") - F.col("start_m") >= policy.min_line_span_m).select(
        *k, "run", "start_m", "end_m", (F.col("ou") + F.col("start_m") * F.col("fu")).alias("u0"),
        (F.col("ov") + F.col("start_m") * F.col("fv")).alias("v0"), (F.col("ou") + F.col("end_m") * F.col("fu")).alias("u1"),
        (F.col("ov") + F.col("end_m") * F.col("fv")).alias("v1"), "voxel_points", "height_min_m", "height_max_m")
    found = span.groupBy(*k).agg(F.count("*").alias("_spans"))
    status = (F.when(F.col("n") < policy.min_line_points, "INSUFFICIENT_HEIGHT_PERSISTENCE")
              .when(F.col("refit_angle_degrees") > policy.max_refit_angle_degrees, "REFIT_DISAGREES_WITH_SOURCE_PLANE")
              .when(F.col("_spans") > 0, "GEOMETRIC_SUGGESTIONS_ONLY").otherwise("NO_CONTIGUOUS_SUPPORTED_SPAN"))
    diag = f.join(spread, k, "left").join(found, k, "left").select(
        *k, F.col("n").alias("persistent_voxel_points"), "refit_angle_degrees", "residual_p90_m", status.alias("status"))
    return diag, span


# --- objects ----------------------------------------------------------------

def tiles_in_view(tiles: DataFrame, cameras: DataFrame, tile_m: float, min_depth: float = 0.0, fold: int = 8) -> DataFrame:
    """Every camera with the occupied tiles (_i, _j, _k) that may hold a point of its image.

    Cameras meet blocks of ``fold`` x ``fold`` x ``fold`` tiles first and only the tiles of blocks
    in view afterwards. Tiles are tested as balls, so no visible tile is missed.
    """
    side = ("_i", "_j", "_k")
    block = [F.floor(F.col(c) / fold).alias(f"_b{c}") for c in side]
    keyed = tiles.select("capture_id", *side, *block)
    key = ["capture_id", *[f"_b{c}" for c in side]]
    ball = lambda size: size * math.sqrt(3) / 2
    centre = lambda p, size: [(F.col(f"{p}{c}") + 0.5) * size for c in side]
    near = keyed.select(*key).distinct().join(cameras, "capture_id").where(G.may_see(centre("_b", fold * tile_m), ball(fold * tile_m), min_depth))
    return keyed.join(near, key).where(G.may_see(centre("", tile_m), ball(tile_m), min_depth)).drop(*key[1:])


def zbuffer_visible(points: DataFrame, cameras: DataFrame, pixel_bin: int = 3, tolerance_m: float = 0.12, tile_m: float = 0.25) -> DataFrame:
    """Points of each view at most ``tolerance_m`` behind the nearest one of their pixel bin.

    A point meets only the cameras that may see its tile of ``tile_m`` metres, so the rows before
    the frame test follow the visible pairs, and they are made twice where the points of a tile are.
    First only the nearest depth of each tile in each pixel bin leaves, to be compared with the bin's
    other tiles. Then tiles in front meet their cameras again, with the depths of their open bins, by
    which hidden points stay behind; what is left meets its own bin.
    """
    side = ["_i", "_j", "_k"]
    place = ["capture_id", *side]
    tiled = points.withColumns({t: F.floor(F.col(c) / tile_m) for t, c in zip(side, "xyz")})
    views = tiles_in_view(tiled.select(*place).distinct(), cameras, tile_m, min_depth=0.05)
    dealt = tiled.repartition(*place)
    bins = ["_bx", "_by"]

    def seen(by: DataFrame, *more: str) -> DataFrame:
        px, py, depth = G.project_pixel(G.vec("x", "y", "z"))
        p = dealt.join(by, place).where((depth > 0.05) & (px >= 0) & (px < F.col("width")) & (py >= 0) & (py < F.col("height")))
        # both passes read one shuffle of the points: this column keeps one pass from pruning it and from pushing filters below it
        whole = F.when(F.spark_partition_id() >= 0, F.xxhash64(*points.columns)).alias("_whole")
        p = p.select(*points.columns, *side, "rank", px.alias("px"), py.alias("py"), depth.alias("depth"), *more, whole)
        return p.withColumns({b: F.floor(F.col(c) / pixel_bin) for b, c in zip(bins, ("px", "py"))})

    tile = seen(views).groupBy(*place, "rank", *bins).agg(F.min("depth").alias("_tile"), F.max("_whole").alias("_whole")).where("_whole IS NOT NULL")
    ahead = Window.partitionBy("capture_id", "rank", *bins)
    near = tile.withColumn("_near", F.min("_tile").over(ahead)).where(F.col("_tile") <= F.col("_near") + tolerance_m)
    near = near.where(" AND ".join(f"{c} IS NOT NULL" for c in (*place, "rank", *bins))).select(*place, "rank", *bins, "_near")
    # bins of a tile share 64 slots: exact for a tile of up to 8 x 8 bins, else a few hidden points go on
    slot = F.pmod("_bx", F.lit(8)) * 8 + F.pmod("_by", F.lit(8))
    slots = near.groupBy(*place, "rank", slot.alias("_slot")).agg(F.max("_near").alias("_far"))
    slots = slots.groupBy(*place, "rank").agg(F.map_from_entries(F.collect_list(F.struct("_slot", "_far"))).alias("_open"))
    p = seen(slots.join(cameras, ["capture_id", "rank"]).repartition(*place), "_open")
    p = p.where(F.col("_whole").isNotNull() & (F.col("depth") <= F.try_element_at("_open", slot) + tolerance_m))
    p = p.select(*points.columns, "rank", "px", "py", "depth", *bins).join(
        near.groupBy("capture_id", "rank", *bins).agg(F.min("_near").alias("_near")), ["capture_id", "rank", *bins])
    return p.where(F.col("depth") <= F.col("_near") + tolerance_m).select(*points.columns, "rank", "px", "py", "depth")


def object_support(visible: DataFrame, regions: DataFrame, rooms: DataFrame) -> DataFrame:
    """Distinct supporting points of each object over all of its image regions.

    ``visible`` has point_id, rank, px, py, u, v, h; ``regions`` has object_id, rank, polygon
    and the height interval h0, h1.
    """
    v = room_coordinates(visible, rooms).where("inside")
    hit = v.join(regions, ["capture_id", "rank"]).where(
        F.col("h").between(F.col("h0"), F.col("h1")) & G.in_polygon_even_odd(F.floor("px") + 0.5, F.floor("py") + 0.5, F.col("polygon")))
    return hit.select("capture_id", "object_id", "point_id", "p0", "p1", "h").distinct()


def object_footprints(support: DataFrame, objects: DataFrame, rooms: DataFrame, min_points: int = 80) -> DataFrame:
    """5-95 % extents of the support, widened to a minimum size and clipped to the room."""
    k = ["capture_id", "object_id"]
    q = None
    for c, name in (("p0", "x"), ("p1", "y"), ("h", "z")):
        one = quantiles(support, k, c, {f"{name}0": 0.05, f"{name}1": 0.95}, count=f"_{name}")
        q = one if q is None else q.join(one, k)
    j = objects.join(q, k, "left").join(rooms.select("capture_id", "lo0", "lo1", "hi0", "hi1"), "capture_id")
    n = F.coalesce("_x", F.lit(0))
    ok = n >= min_points
    out = [n.alias("source_voxels"), F.when(ok, "APPROXIMATE_IMAGE_ASSISTED_FOOTPRINT").otherwise("INSUFFICIENT_VISIBLE_SUPPORT").alias("status")]
    clipped = F.lit(False)
    for name, i in (("x", "0"), ("y", "1")):
        a, b = F.col(f"{name}0"), F.col(f"{name}1")
        mid, ext = (a + b) / 2, F.greatest(b - a, F.col(f"min{i}"))
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        left, right = _clip(mid - ext / 2, lo, hi), _clip(mid + ext / 2, lo, hi)
        clipped = clipped | (left != mid - ext / 2) | (right != mid + ext / 2)
        out += [F.when(ok, left).alias(f"box_lo{i}"), F.when(ok, right).alias(f"box_hi{i}")]
    out += [F.when(ok, F.col("z0")).alias("height_lo_m"), F.when(ok, F.col("z1")).alias("height_hi_m"),
            F.when(ok, clipped).alias("clipped_to_room")]
    return j.select(*k, *out)


def _clip(c: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(c, lo), hi)
