"""Floor frames, supported cells, wall spans and reviewed image regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capstrata.functions import geometry as G
from capstrata.operators.ordered import group_diameter, runs_of
from capstrata.policies import BoundaryPolicy, RoomPolicy
from capstrata.session import stage

# Review roles in their stored order.
ROLES = ["UNREVIEWED", "FLOOR", "WALL", "FURNITURE", "MIXED", "UNKNOWN"]

FRAME = ["fn_x", "fn_y", "fn_z", "f_d", "fo_x", "fo_y", "fo_z", "fu_x", "fu_y", "fu_z", "fv_x", "fv_y", "fv_z"]


def floor_frames(floor_planes: DataFrame, floor_points: DataFrame) -> DataFrame:
    """Floor coordinate frame of each capture: upward normal, projected world X, projected mean."""
    size = G.norm(G.vec("a", "b", "c"))
    sign = F.when(F.col("b") < 0, -1.0).otherwise(1.0)
    p = floor_planes.select("capture_id", *[(F.col(c) / size * sign).alias(n)
                                            for c, n in zip("abcd", ("fn_x", "fn_y", "fn_z", "f_d"))])
    mean = floor_points.groupBy("capture_id").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    j = p.join(mean, "capture_id")
    n = G.vec("fn_x", "fn_y", "fn_z")
    m = G.vec("mx", "my", "mz")
    u, v = G.floor_axes(n)
    lift = G.dot(m, n) + F.col("f_d")
    cols = [*[(m[i] - lift * n[i]).alias(f"fo_{a}") for i, a in enumerate("xyz")],
            *[u[i].alias(f"fu_{a}") for i, a in enumerate("xyz")], *[v[i].alias(f"fv_{a}") for i, a in enumerate("xyz")]]
    return j.select("capture_id", "fn_x", "fn_y", "fn_z", "f_d", *cols).where("fu_x IS NOT NULL")


def floor_coordinates(points: DataFrame, frames: DataFrame, xyz=("x", "y", "z")) -> DataFrame:
    """Rigid floor coordinates: u and v along the floor, h above it."""
    p = G.vec(*xyz)
    rel = G.minus(p, G.vec("fo_x", "fo_y", "fo_z"))
    return points.join(frames, "capture_id").withColumn("u", G.dot(rel, G.vec("fu_x", "fu_y", "fu_z"))).withColumn(
        "v", G.dot(rel, G.vec("fv_x", "fv_y", "fv_z"))).withColumn(
        "h", G.dot(p, G.vec("fn_x", "fn_y", "fn_z")) + F.col("f_d")).drop(*FRAME)


def display_points(coords: DataFrame) -> DataFrame:
    """Right-handed display axes: u, height, minus v."""
    return coords.select("*", F.col("u").alias("dx"), F.col("h").alias("dy"), (-F.col("v")).alias("dz"))


def supported_views(points: DataFrame, stations: DataFrame, keys: list[str], minimum: int,
                    policy: BoundaryPolicy = BoundaryPolicy()) -> DataFrame:
    """Views with enough points per group and the widest distance between their cameras."""
    views = points.groupBy(*keys, "rank").agg(F.count("*").alias("_n")).where(F.col("_n") >= policy.min_points_per_view)
    at = views.join(stations.select("capture_id", "rank", "ox", "oy", "oz"), ["capture_id", "rank"])
    wide = group_diameter(at, keys, ["ox", "oy", "oz"], "baseline_m")
    n = views.groupBy(*keys).agg(F.count("*").alias("views"))
    every = points.groupBy(*keys).agg(F.count("*").alias("observations"))
    out = every.join(n, keys, "left").join(wide, keys, "left").fillna(0, ["views", "baseline_m"])
    return out.withColumn("supported", (F.col("views") >= minimum) & (F.col("baseline_m") >= policy.min_baseline_m))


def floor_cells(coords: DataFrame, stations: DataFrame, policy: BoundaryPolicy = BoundaryPolicy()) -> DataFrame:
    """Floor grid cells seen by enough views from far enough apart."""
    c = coords.withColumn("cx", F.floor(F.col("u") / policy.cell_m)).withColumn("cy", F.floor(F.col("v") / policy.cell_m))
    s = supported_views(c, stations, ["capture_id", "cx", "cy"], policy.min_cell_views, policy)
    return s.where("supported").drop("supported")


def wall_lines(walls: DataFrame, frames: DataFrame) -> DataFrame:
    """Line of each wall plane on the floor; NULL direction when parallel."""
    j = G.with_plane_line(walls.join(frames, "capture_id"), ["lx", "ly", "lz"], ["dx", "dy", "dz"])
    return stage(j.select("capture_id", "plane_index", "lx", "ly", "lz", "dx", "dy", "dz"))


def along_lines(points: DataFrame, lines: DataFrame, bin_m: float) -> DataFrame:
    """Distance of each labelled point along its wall line, and its bin."""
    j = points.join(lines.where("dx IS NOT NULL"), ["capture_id", "plane_index"])
    t = G.dot(G.minus(G.vec("x", "y", "z"), G.vec("lx", "ly", "lz")), G.vec("dx", "dy", "dz"))
    return j.withColumn("t", t).withColumn("bin", F.floor(F.col("t") / bin_m))


def endpoint_uv(spans: DataFrame, frames: DataFrame) -> DataFrame:
    """Floor coordinates of both span ends."""
    j = spans.join(frames, "capture_id")
    out = []
    for i, t in enumerate(("start_m", "end_m")):
        p = [F.col(f"l{a}") + F.col(t) * F.col(f"d{a}") for a in "xyz"]
        rel = G.minus(p, G.vec("fo_x", "fo_y", "fo_z"))
        out += [G.dot(rel, G.vec("fu_x", "fu_y", "fu_z")).alias(f"u{i}"), G.dot(rel, G.vec("fv_x", "fv_y", "fv_z")).alias(f"v{i}")]
    return j.select(*spans.columns, *out).drop("lx", "ly", "lz", "dx", "dy", "dz")


def wall_spans(wall_points: DataFrame, walls: DataFrame, stations: DataFrame, frames: DataFrame,
               policy: BoundaryPolicy = BoundaryPolicy()) -> DataFrame:
    """Runs of adjacent supported bins along each wall; gaps are never bridged.

    ``wall_points`` carries plane_index, rank, x, y, z and the floor height h.
    """
    k = ["capture_id", "plane_index"]
    lines = wall_lines(walls, frames)
    t = stage(along_lines(wall_points, lines, policy.cell_m))
    good = supported_views(t, stations, [*k, "bin"], policy.min_wall_views, policy).where("supported")
    runs = runs_of(good, k, "bin")
    on = stage(t.join(runs, [*k, "bin"]))
    span = on.groupBy(*k, "run").agg(
        F.min("t").alias("start_m"), F.max("t").alias("end_m"), F.count_distinct("bin").alias("bins"), F.min("h").alias("height_min_m"),
        F.max("h").alias("height_max_m"), F.count_if(F.abs("h") <= policy.near_floor_m).alias("near_floor_observations"),
        *[F.min(c).alias(c) for c in ("lx", "ly", "lz", "dx", "dy", "dz")])
    span = span.where(F.col("end_m") - F.col("start_m") >= policy.min_span_m)
    views = supported_views(on, stations, [*k, "run"], policy.min_wall_views, policy).select(*k, "run", "observations", "views", "baseline_m")
    return endpoint_uv(span.join(views, [*k, "run"]), frames)


def candidate_spans(points: DataFrame, walls: DataFrame, frames: DataFrame, policy: RoomPolicy = RoomPolicy()) -> DataFrame:
    """Occupied extents along each vertical candidate plane, without any semantic admission."""
    k = ["capture_id", "plane_index"]
    t = along_lines(points, wall_lines(walls, frames), policy.candidate_bin_m)
    dense = t.groupBy(*k, "bin").agg(F.count("*").alias("_n")).where(F.col("_n") >= policy.candidate_bin_points)
    on = t.join(runs_of(dense, k, "bin"), [*k, "bin"])
    span = on.groupBy(*k, "run").agg(F.min("t").alias("start_m"), F.max("t").alias("end_m"), F.count("*").alias("voxel_points"),
                                     *[F.min(c).alias(c) for c in ("lx", "ly", "lz", "dx", "dy", "dz")])
    return endpoint_uv(span.where(F.col("end_m") - F.col("start_m") >= policy.minimum_interval_m), frames)


def region_roles(samples: DataFrame, regions: DataFrame) -> DataFrame:
    """Role of each sample from the reviewed regions of its view and plane.

    Rejections beat architecture, furniture beats mixed beats unknown, and the first region
    of the winning role is kept. Samples in no region stay UNREVIEWED; a sample marked both
    floor and wall is a conflict.
    """
    k = ["capture_id", "rank", "plane_index"]
    hit = samples.select(*k, "sample_id", "x", "y").join(regions, k).where(
        G.in_convex_polygon(F.col("x") + 0.5, F.col("y") + 0.5, F.col("polygon")))
    weight = (F.when(F.col("role") == "FURNITURE", 3).when(F.col("role") == "MIXED", 2)
              .when(F.col("role") == "UNKNOWN", 1).otherwise(0))
    best = hit.groupBy("capture_id", "rank", "sample_id").agg(
        F.max(F.struct(weight.alias("w"), (-F.col("region_index")).alias("i"), "role")).alias("_b"),
        (F.max(F.col("role") == "FLOOR") & F.max(F.col("role") == "WALL")).alias("conflict"))
    return samples.join(best, ["capture_id", "rank", "sample_id"], "left").select(
        *samples.columns, F.coalesce("_b.role", F.lit("UNREVIEWED")).alias("role"),
        F.coalesce(-F.col("_b.i"), F.lit(-1)).alias("region_index"), F.coalesce("conflict", F.lit(False)).alias("conflict"))


def region_conflicts(roles: DataFrame) -> DataFrame:
    return roles.where("conflict").groupBy("capture_id").agg(F.count("*").alias("samples")).withColumn(
        "code", F.lit("BOUNDARY_REGION_CONFLICT"))


def role_counts(roles: DataFrame) -> DataFrame:
    return roles.groupBy("capture_id", "role").agg(F.count("*").alias("samples"))


def region_observations(roles: DataFrame, regions: DataFrame) -> DataFrame:
    """Samples credited to each region; regions without any stay with zero."""
    n = roles.where("region_index >= 0").groupBy("capture_id", "region_index").agg(F.count("*").alias("observations"))
    return regions.select("capture_id", "region_index", "role").join(n, ["capture_id", "region_index"], "left").fillna(0, ["observations"])


def region_violations(regions: DataFrame, views: DataFrame, planes: DataFrame) -> DataFrame:
    """Regions whose view identity, role or polygon breaks the review contract.

    ``regions`` and ``views`` share image, width, height and sha256 as identity columns.
    """
    ident = ["image", "width", "height", "sha256"]
    v = views.select("capture_id", "rank", *[F.col(c).alias(f"_v_{c}") for c in ident])
    # views and planes grow with the captures, and Spark guesses exploded tables too small: never broadcast them
    j = regions.join(v.hint("merge"), ["capture_id", "rank"], "left").join(
        planes.select("capture_id", "plane_index", "orientation").hint("merge"), ["capture_id", "plane_index"], "left")
    changed = F.lit(False)
    for c in ident:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_v_{c}"))
    bad = (F.col("_v_image").isNull() | F.col("orientation").isNull() | ~F.col("role").isin(ROLES[1:]))
    flag = lambda c, n: F.when(F.coalesce(c, F.lit(False)), F.lit(n))
    codes = F.array_distinct(F.array_compact(F.array(
        flag(bad, "BOUNDARY_REVIEW_INVALID"), flag(~bad & changed, "BOUNDARY_REVIEW_SOURCE_CHANGED"),
        flag(~G.valid_polygon(F.col("polygon"), F.col("width"), F.col("height")), "BOUNDARY_REGION_INVALID"),
        flag((F.col("role") == "FLOOR") & (F.col("orientation") != "horizontal"), "BOUNDARY_REGION_INVALID"),
        flag((F.col("role") == "WALL") & (F.col("orientation") != "vertical"), "BOUNDARY_REGION_INVALID"))))
    return j.select("capture_id", "region_index", F.explode(codes).alias("code"))


def boundary_report(floor: DataFrame, cells: DataFrame, walls: DataFrame, spans: DataFrame) -> DataFrame:
    """Status of the floor and of every wall of a capture.

    ``floor`` and ``walls`` are supported_views results per capture and per wall plane.
    """
    n = cells.groupBy("capture_id").agg(F.count("*").alias("_cells"))
    f = floor.join(n, "capture_id", "left").select(
        "capture_id", F.lit(None).cast("bigint").alias("plane_index"), "observations", "views", "baseline_m",
        F.when(~F.col("supported"), "INSUFFICIENT_FLOOR_SUPPORT").when(F.col("_cells") > 0, "SUPPORTED_LOCAL_FLOOR")
        .otherwise("INSUFFICIENT_CELL_SUPPORT").alias("status"), F.coalesce("_cells", F.lit(0)).alias("parts"))
    s = spans.groupBy("capture_id", "plane_index").agg(F.count("*").alias("_spans"))
    ready = f.where("status = 'SUPPORTED_LOCAL_FLOOR'").select("capture_id", F.lit(True).alias("_floor"))
    w = walls.join(ready, "capture_id", "left").join(s, ["capture_id", "plane_index"], "left").select(
        "capture_id", "plane_index", "observations", "views", "baseline_m",
        F.when(F.col("_floor").isNull(), "NO_SUPPORTED_FLOOR").when(~F.col("supported"), "INSUFFICIENT_WALL_SUPPORT")
        .when(F.col("_spans") > 0, "SUPPORTED_PARTIAL_SPANS").otherwise("INSUFFICIENT_SPAN_SUPPORT").alias("status"),
        F.coalesce("_spans", F.lit(0)).alias("parts"))
    return f.unionByName(w)
